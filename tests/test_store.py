import os
import random
import threading

import pytest
from pyspark.sql import functions as F

from ledgerstone.operators import kept, reports
from ledgerstone.sources import ingest
from ledgerstone.sources.store import Conflict, Store

SCHEMA = "id long, month string, v long"


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def files_of(store):
    return {p: sorted(os.listdir(f.removeprefix("file:"))) for p, f in store.folders().items()}


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, f"file:{tmp_path}/t")


def test_versions(spark, store):
    df = lambda *r: spark.createDataFrame(r, SCHEMA)
    assert store.version() == 0 and store.partitions() == []
    with pytest.raises(FileNotFoundError):
        store.read()
    assert store.write(df((1, "a", 1), (2, "b", 2), (3, None, 3), (4, "ä/=%", 4))) == 1
    assert set(store.partitions()) == {"a", "b", None, "ä/=%"}
    before = files_of(store)
    assert store.upsert(df((2, "b", 20), (5, "c", 5)), "id") == (2, ["b", "c"])
    assert rows_of(store.read()) == sorted([(1, "a", 1), (2, "b", 20), (3, None, 3), (4, "ä/=%", 4), (5, "c", 5)], key=repr)
    assert {p: f for p, f in files_of(store).items() if p not in ("b", "c")} == {p: f for p, f in before.items() if p != "b"}  # untouched files keep their names
    assert rows_of(store.read(1)) == sorted([(1, "a", 1), (2, "b", 2), (3, None, 3), (4, "ä/=%", 4)], key=repr)
    assert rows_of(store.read(partitions=["b", None, "none"])) == sorted([(2, "b", 20), (3, None, 3)], key=repr)
    assert store.upsert(df(), "id") == (2, [])
    assert store.upsert(df((1, "b", 1)), "id", deleted=df((3, None, 0))) == (3, [None, "a", "b"])  # a row moves, a partition empties
    assert set(store.partitions()) == {"b", "c", "ä/=%"}
    assert rows_of(store.read()) == sorted([(1, "b", 1), (2, "b", 20), (4, "ä/=%", 4), (5, "c", 5)], key=repr)
    store.write(df())
    assert store.partitions() == [] and store.read().collect() == []


def test_upsert_equals_plain(spark, store):
    rng = random.Random(6)
    model = {i: (i, f"m{rng.randrange(5)}", rng.randrange(9)) for i in range(60)}
    store.write(spark.createDataFrame(list(model.values()), SCHEMA))
    for _ in range(4):
        new = [(i, rng.choice([None, *"xyz", f"m{rng.randrange(5)}"]), rng.randrange(9)) for i in rng.sample(range(90), 8)]
        gone = rng.sample(range(90), 5)
        keep = files_of(store)
        was = {model[k][1] for k in [r[0] for r in new] + gone if k in model}
        store.upsert(spark.createDataFrame(new, SCHEMA), "id", spark.createDataFrame([(g,) for g in gone], "id long"))
        model = {k: r for k, r in model.items() if k not in gone} | {r[0]: r for r in new}
        assert rows_of(store.read()) == sorted(model.values(), key=repr)
        still = set(keep) - was - {r[1] for r in new}
        assert {p: f for p, f in files_of(store).items() if p in still} == {p: keep[p] for p in still}


def test_of_two_writers_one_is_refused(spark, store):
    store.write(spark.createDataFrame([(1, "a", 1)], SCHEMA))
    other, said = Store(spark, store.path), []
    row = lambda v: spark.createDataFrame([(1, "a", v)], SCHEMA)

    def run(s, v):
        try:
            said.append(s.commit(row(v), ["a"], since=1))
        except Conflict:
            said.append("refused")

    threads = [threading.Thread(target=run, args=x) for x in ((store, 7), (other, 8))]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert sorted(map(str, said)) == ["2", "refused"]
    assert rows_of(store.read())[0][2] in (7, 8) and store.versions() == [1, 2]
    with pytest.raises(Conflict):
        other.commit(row(9), ["a"], since=1)
    with pytest.raises(ValueError, match="not to be replaced"):
        store.commit(row(9), ["b"], since=2)
    store._publish({"schema": None, "folders": {}}, 3)
    with pytest.raises(Conflict):
        other._publish({"schema": None, "folders": {}}, 3)
    assert not os.listdir(f"{store.path.removeprefix('file:')}/drafts")


def test_a_failed_job_changes_nothing(spark, store):
    store.write(spark.createDataFrame([(1, "a", 1)], SCHEMA))
    bad = spark.createDataFrame([(1, "a", 1)], SCHEMA).withColumn("v", F.raise_error(F.lit("stop")).cast("long"))
    with pytest.raises(Exception, match="stop"):
        store.commit(bad, ["a"], 1)
    assert store.version() == 1 and rows_of(store.read()) == [(1, "a", 1)]


TXN = "id long, account_id long, txn_date date, amount_minor long, flow_type string, category string"


def test_kept_cube_equals_recompute(spark, store):
    import datetime

    rng = random.Random(8)

    def row(i):
        day = None if rng.random() < 0.03 else datetime.date(2024, rng.randint(1, 6), rng.randint(1, 28))
        return (i, rng.randint(1, 3), day, rng.randint(1, 999), rng.choice(["spend", "refund", "transfer"]), rng.choice([None, "Dining"]))

    ledger = {i: row(i) for i in range(80)}
    df = lambda rows: spark.createDataFrame(list(rows), TXN)
    kept.build_cube(store, df(ledger.values()))
    for k in range(5):
        went = rng.sample(sorted(ledger), 10)
        came = {1000 * (k + 1) + i: row(1000 * (k + 1) + i) for i in range(9)}
        before = store.folders()
        months = kept.refresh_cube(store, df(came.values()), df(ledger[i] for i in went))
        ledger = {i: r for i, r in ledger.items() if i not in went} | came
        assert rows_of(kept.read_cube(store)) == rows_of(reports.daily_cube(df(ledger.values())))
        assert all(store.folders()[m] == f for m, f in before.items() if m not in months)
    some = list(ledger.values())[:3]
    assert kept.refresh_cube(store, df(some), df(some)) == [] and kept.refresh_cube(store) == []
    version = store.version()
    with pytest.raises(Exception, match="more rows taken out"):
        kept.refresh_cube(store, went=df([(1, 99, datetime.date(2024, 1, 1), 5, "spend", None)]))
    assert store.version() == version
    kept.refresh_cube(store, went=df(ledger.values()))
    assert store.partitions() == []


def test_dump_files(spark, tmp_path):
    table = spark.createDataFrame([(1, "a b/%", None), (2, "c", "x"), (3, "c", "ß"), (4, None, "y")], "id long, name string, v string")
    path = f"file:{tmp_path}/dump"
    told = ingest.dump_files(table, "name", path, dry_run=True).collect()
    assert not os.path.exists(f"{tmp_path}/dump")
    assert [(r.key, r.bytes) for r in told] == [("a b/%", len('{"id":1,"name":"a b/%"}\n')), ("c", len('{"id":2,"name":"c","v":"x"}\n{"id":3,"name":"c","v":"ß"}\n'.encode()))]
    assert ingest.dump_files(table, "name", path).collect() == told

    def there():
        out = {}
        for d, _, names in os.walk(f"{tmp_path}/dump"):
            for n in names:
                if n.startswith("part-"):
                    out.setdefault(os.path.basename(d), []).append(open(f"{d}/{n}", encoding="utf-8").read())  # noqa: SIM115
        return out

    want = {"key=c": ['{"id":2,"name":"c","v":"x"}\n{"id":3,"name":"c","v":"ß"}\n']}
    assert {k: v for k, v in there().items() if k == "key=c"} == want and len(there()) == 2
    bad = spark.createDataFrame([(9, "c", "new"), (10, "d", "new")], "id long, name string, v string").withColumn("v", F.when(F.col("id") == 10, F.raise_error(F.lit("stop"))).otherwise(F.col("v")))
    before = there()
    with pytest.raises(Exception, match="stop"):
        ingest.dump_files(bad, "name", path)
    assert there() == before  # neither the failed task's file nor those of the others
    ingest.dump_files(table.where("id = 2"), "name", path)
    assert there() == before | {"key=c": ['{"id":2,"name":"c","v":"x"}\n']}
