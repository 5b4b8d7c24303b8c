"""First decisions for a new ledger, by the first word of a merchant's key, and a generator of statements that is the same for a seed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# First words of well-known merchants, by category.
SEEDS = {
    "Groceries": "fairprice giant coldstorage cold sheng redmart aldi lidl tesco carrefour kroger safeway costco spinneys woolworths",
    "Dining": "mcdonalds kfc starbucks subway foodpanda deliveroo toastbox koufu jollibee dominos pizzahut nandos burger chipotle dunkin",
    "Transport": "grab gojek comfort uber lyft bolt shell esso caltex petronas bluesg simplygo ezlink transitlink",
    "Shopping": "amazon lazada shopee ikea uniqlo zara decathlon daiso watsons muji zalora etsy ebay",
    "Bills & Utilities": "singtel starhub m1 vodafone verizon sp netlink geneco comcast",
    "Health": "guardian unity raffles walgreens cvs boots specsavers",
    "Entertainment": "netflix spotify disney steam nintendo playstation cathay shaw youtube hbo",
    "Travel": "scoot airbnb agoda booking expedia emirates qantas lufthansa hilton marriott klook ryanair",
    "Education": "coursera udemy kumon duolingo pearson",
}


def seeds(spark: SparkSession) -> DataFrame:
    """(merchant_normalized, category, source): memory rows of source seed, to be added with ``fill_gaps``."""
    return spark.createDataFrame([(w, c, "seed") for c, words in SEEDS.items() for w in words.split()], "merchant_normalized string, category string, source string")


#: Name, charges a cycle at least, further ones at most, usual amount in minor units.
HABITS = [("GROCER", 4, 5, 4200), ("COFFEE BAR", 6, 7, 650), ("BUS RIDE", 8, 9, 190), ("STREAMING", 1, 1, 1598), ("BOOKSHOP", 0, 3, 2700)]
#: Percent of the usual amount, by month.
SEASON = (100, 96, 98, 100, 102, 110, 104, 100, 98, 102, 118, 130)
_PRIME = 2147483647


def _draw(seed: int, *parts: Column) -> Column:
    """A whole number below 2^31 - 1 from the seed and the parts."""
    x = F.lit(seed).cast("long")
    for p in parts:
        x = (x * 48271 + p.cast("long") * 16807 + 11) % _PRIME
    return (x * 48271 + 7) % _PRIME


def generate_rows(spark: SparkSession, seed: int, cycles: int, epoch: str = "2024-01-01") -> DataFrame:
    """(cycle, habit, k, txn_date, description_raw, amount_minor, balance_minor): charges of the cycles (months) since the epoch; the balance runs on through all of them. A cycle's rows depend on the seed and its number alone, so overlapping runs agree."""
    c = spark.range(cycles).select(F.col("id").cast("int").alias("cycle"))
    habits = F.array(*[F.struct(F.lit(i).alias("habit"), F.lit(n).alias("name"), F.lit(a).alias("least"), F.lit(b).alias("more"), F.lit(m).alias("usual")) for i, (n, a, b, m) in enumerate(HABITS)])
    t = c.select("cycle", F.add_months(F.lit(epoch).cast("date"), F.col("cycle")).alias("first"), F.explode(habits).alias("h")).select("cycle", "first", "h.*")
    t = t.withColumn("n", (F.col("least") + _draw(seed, F.col("cycle"), F.col("habit")) % F.col("more")).cast("int")).where("n > 0").withColumn("k", F.explode(F.expr("sequence(1, n)")))
    day, amount = _draw(seed + 1, F.col("cycle"), F.col("habit"), F.col("k")) % 28, _draw(seed + 2, F.col("cycle"), F.col("habit"), F.col("k"))
    season = F.element_at(F.array(*[F.lit(s) for s in SEASON]), F.month("first"))
    t = t.select("cycle", "habit", "k", F.date_add("first", day.cast("int")).alias("txn_date"), F.col("name").alias("description_raw"), F.expr("1").alias("_"), (F.floor(F.col("usual") * season / 100) + amount % 300).cast("long").alias("amount_minor")).drop("_")
    within = Window.partitionBy("cycle").orderBy("txn_date", "habit", "k").rowsBetween(Window.unboundedPreceding, 0)
    sums = t.groupBy("cycle").agg(F.sum("amount_minor").alias("s"))  # a row per cycle
    before = sums.select("cycle", (F.sum("s").over(Window.orderBy("cycle")) - F.col("s")).alias("before"))
    return t.join(before, "cycle").withColumn("balance_minor", F.col("before") + F.sum("amount_minor").over(within)).drop("before")
