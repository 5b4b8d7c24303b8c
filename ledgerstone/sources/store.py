"""Tables kept on disk by partition, in numbered versions.

Spark writes the rows of the partitions that change to a new folder, one folder a partition below it; a small list then says which folders are the table. The list of
version n + 1 is written apart and renamed to its name only if no such version is there yet, so of two writers that began from one version one succeeds and the other is
refused, a reader sees whole versions only, and a job that fails leaves the table as it was. Folders of partitions that do not change stay the same files. A list has a line a partition: months, or
accounts, not keys.

Renaming without replacing is one step in HDFS and on a local disk. A store in which it is not needs a lock around ``commit``.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: The folder name of a partition's rows; the value itself is a column of the files.
FOLDER = "_part"


class Conflict(RuntimeError):
    """Another writer has committed since this one looked."""


class Store:
    """A table below ``path``, whose rows are kept together by the column ``by``, a string. A null is a partition of its own."""

    def __init__(self, spark: SparkSession, path: str, by: str = "month"):
        self.spark, self.path, self.by = spark, path.rstrip("/"), by
        jvm, self._conf = spark._jvm, spark._jsc.hadoopConfiguration()
        self._path = jvm.org.apache.hadoop.fs.Path
        self._files = self._path(self.path).getFileSystem(self._conf)

    def versions(self) -> list[int]:
        """Numbers of the versions there are, in order."""
        folder = self._path(f"{self.path}/versions")
        if not self._files.exists(folder):
            return []
        names = [s.getPath().getName() for s in self._files.listStatus(folder)]
        return sorted(int(n) for n in names if n.isdecimal())

    def version(self) -> int:
        """The newest version; 0 before the first."""
        return max(self.versions(), default=0)

    def _listed(self, version: int) -> dict:
        if not version:
            return {"schema": None, "folders": {}}
        stream = self._files.open(self._path(f"{self.path}/versions/{version}"))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def partitions(self, version: int | None = None) -> list[str | None]:
        """Values of ``by`` that have rows."""
        return [_value(k) for k in self._listed(self.version() if version is None else version)["folders"]]

    def folders(self, version: int | None = None) -> dict[str | None, str]:
        """Where each partition's files are."""
        return {_value(k): f"{self.path}/{v}" for k, v in self._listed(self.version() if version is None else version)["folders"].items()}

    def read(self, version: int | None = None, partitions: Iterable[str | None] | None = None) -> DataFrame:
        """The rows of a version (the newest), of some partitions (all). Only the files of those are opened."""
        listed = self._listed(self.version() if version is None else version)
        if listed["schema"] is None:
            raise FileNotFoundError(f"{self.path} has no version yet")
        schema = StructType.fromJson(json.loads(listed["schema"]))
        some = None if partitions is None else {_key(p) for p in partitions}
        paths = [f"{self.path}/{v}" for k, v in sorted(listed["folders"].items()) if some is None or k in some]
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(*paths)

    def commit(self, rows: DataFrame, replaced: Iterable[str | None], since: int) -> int:
        """Make a version whose partitions ``replaced`` hold these rows (none left: the partition goes) and whose others are those of version ``since``. Returns its number.

        Raises Conflict, and changes nothing, if there is a newer version than ``since``. Rows of other partitions than the replaced ones are an error.
        """
        if self.version() != since:
            raise Conflict(f"version {self.version()} was committed after {since}")
        listed, replaced = self._listed(since), {_key(p) for p in replaced}
        run = f"data/{uuid.uuid4().hex}"
        rows.hint("rebalance", self.by).withColumn(FOLDER, _named(F.col(self.by))).write.partitionBy(FOLDER).parquet(f"{self.path}/{run}")
        made = {s.getPath().getName().removeprefix(f"{FOLDER}=") for s in self._files.listStatus(self._path(f"{self.path}/{run}")) if s.isDirectory()}
        if extra := made - replaced:
            raise ValueError(f"rows of partitions that are not to be replaced: {sorted(map(_value, extra), key=str)}")
        folders = {k: v for k, v in listed["folders"].items() if k not in replaced} | {k: f"{run}/{FOLDER}={k}" for k in made}
        schema = listed["schema"] or json.dumps(_nullable(rows.schema).jsonValue())
        self._publish({"schema": schema, "folders": folders}, since + 1)
        return since + 1

    def _publish(self, listed: dict, version: int) -> None:
        fs = self.spark._jvm.org.apache.hadoop.fs
        draft, name = self._path(f"{self.path}/drafts/{uuid.uuid4().hex}"), self._path(f"{self.path}/versions/{version}")
        stream = self._files.create(draft, False)
        stream.write(bytearray(json.dumps(listed).encode()))
        stream.close()
        self._files.mkdirs(name.getParent())
        kind = getattr(fs, "Options$Rename")
        never = self.spark._sc._gateway.new_array(kind, 1)
        never[0] = kind.NONE
        context = fs.FileContext.getFileContext(self._files.getUri(), self._conf)
        try:
            context.rename(draft, name, never)
        except Exception as e:
            self._files.delete(draft, False)
            if self._files.exists(name):
                raise Conflict(f"version {version} was committed meanwhile") from None
            raise e

    def write(self, rows: DataFrame) -> int:
        """The whole table anew, as the next version."""
        since = self.version()
        named = {_value(r[0]) for r in rows.select(_named(F.col(self.by))).distinct().collect()}  # a row a partition
        return self.commit(rows, named | set(self.partitions(since)), since)

    def upsert(self, changes: DataFrame, key: str, deleted: DataFrame | None = None) -> tuple[int, list[str | None]]:
        """Put changed rows in place of the stored ones of equal key, add those of new keys, and take out the keys of ``deleted``. Returns the version and the partitions rewritten.

        Only partitions are rewritten in which such a row is or was; a row whose partition changes leaves the old one. Of several changes of one key the last by all
        its columns counts, a null key is never replaced. No changes, no version.
        """
        since = self.version()
        stored = self.read(since)
        new = changes.select(*stored.columns)
        order = F.struct(*[F.col(c).cast("string") for c in stored.columns])
        new = new.where(F.col(key).isNull()).unionByName(new.where(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(F.struct(*stored.columns), order).alias("r")).select("r.*"))
        gone = new.select(key) if deleted is None else new.select(key).unionAll(deleted.select(key))
        gone = gone.where(F.col(key).isNotNull()).distinct()
        touched = stored.join(gone, key, "left_semi").select(self.by).unionAll(new.select(self.by)).select(_named(F.col(self.by))).distinct().collect()
        touched = sorted((_value(r[0]) for r in touched), key=lambda v: (v is not None, v))
        if not touched:
            return since, []
        rows = self.read(since, touched).join(gone, key, "left_anti").select(*stored.columns).unionByName(new)
        return self.commit(rows, touched, since), touched


def _named(value: Column) -> Column:
    """A partition's value as a folder name, whatever its characters."""
    return F.coalesce(F.concat(F.lit("v"), F.hex(F.encode(value.cast("string"), "utf-8"))), F.lit("null"))


def _key(value: str | None) -> str:
    return "null" if value is None else "v" + value.encode().hex().upper()


def _value(key: str) -> str | None:
    return None if key == "null" else bytes.fromhex(key[1:]).decode()


def _nullable(schema: StructType) -> StructType:
    out = StructType.fromJson(schema.jsonValue())
    for f in out.fields:
        f.nullable = True
    return out
