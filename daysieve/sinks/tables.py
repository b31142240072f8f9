"""Stored tables that are changed by whole versions: merges that rewrite only what differs, snapshots, documents with backups.

A table is a folder. Its rows are dealt to buckets by a hash of their keys; a version is a manifest that names, for each
bucket, the folder of its Parquet files. A writer puts new buckets into a folder of its own and at last the manifest in
its place, by a rename; a writer that dies before leaves the last version as it was, and two writers can't both put the same
version. Readers take the folders that their manifest names, so one that began before a change ends with the old
rows; the version before the current one is kept, what only older ones name is removed.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.evidence import insert_new, upsert

BUCKETS = 64
#: Versions that are kept.
KEPT = 2


@dataclass
class Manifest:
    version: int
    schema: str  # as JSON
    folders: dict[str, str] = field(default_factory=dict)  # by bucket, relative to the table
    at_us: int | None = None


class Folder:
    """Files of a table, by Spark's own file systems."""

    def __init__(self, spark: SparkSession, path: str):
        self.jvm, self.path = spark._jvm, path.rstrip("/")
        self.fs = self._path("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def names(self, name: str) -> list[str]:
        p = self._path(name)
        return [x.getPath().getName() for x in self.fs.listStatus(p)] if self.fs.exists(p) else []

    def read(self, name: str) -> str:
        stream = self.fs.open(self._path(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def put(self, name: str, text: str) -> None:
        """Writes a file that isn't there yet, in whole or not at all."""
        own = f"{name}.{uuid.uuid4().hex}.tmp"
        stream = self.fs.create(self._path(own), False)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        if self.fs.exists(self._path(name)) or not self.fs.rename(self._path(own), self._path(name)):
            self.fs.delete(self._path(own), False)
            raise FileExistsError(f"{self.path}/{name} was written by another")

    def remove(self, name: str) -> None:
        self.fs.delete(self._path(name), True)


class Table:
    """A stored table with keys; without keys it only holds whole snapshots."""

    def __init__(self, spark: SparkSession, path: str, keys: tuple[str, ...] = (), buckets: int = BUCKETS):
        self.spark, self.keys, self.buckets = spark, list(keys), buckets if keys else 1
        self.folder = Folder(spark, path)

    def versions(self) -> list[int]:
        return sorted(int(x.removesuffix(".json")) for x in self.folder.names("_versions") if x.endswith(".json") and x[:-5].isdigit())

    def manifest(self, version: int | None = None) -> Manifest | None:
        """The last one, or that of a version."""
        known = self.versions()
        if not known:
            return None
        return Manifest(**json.loads(self.folder.read(f"_versions/{version or known[-1]}.json")))

    def _rows(self, m: Manifest, folders: list[str]) -> DataFrame:
        schema = StructType.fromJson(json.loads(m.schema))
        if not folders:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*(f"{self.folder.path}/{x}" for x in folders))

    def read(self, version: int | None = None) -> DataFrame | None:
        """The rows of the last version, or of another that is kept; None if there is none."""
        m = self.manifest(version)
        return m and self._rows(m, sorted(set(m.folders.values())))

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int") if self.keys else F.lit(0)

    def _sums(self, rows: DataFrame) -> DataFrame:
        """(bucket, n, digest): what tells whether two states of a bucket are the same, in any order of rows."""
        whole = F.xxhash64(*rows.columns, *(F.col(c).isNull() for c in rows.columns))  # a hash passes nulls over
        return rows.groupBy(self.bucket().alias("bucket")).agg(F.count("*").alias("n"), F.sum(whole.cast("decimal(38,0)")).alias("digest"))

    def _write(self, rows: DataFrame, m: Manifest | None, changed: list[int], at_us: int | None) -> int:
        version = m.version + 1 if m else 1
        own = f"data/{version}-{uuid.uuid4().hex[:8]}"
        dealt = rows.withColumn("__bucket", self.bucket())
        if self.keys:
            dealt = dealt.repartition(max(1, len(changed)), "__bucket")
        dealt.write.partitionBy("__bucket").parquet(f"{self.folder.path}/{own}")
        there = {x.partition("=")[2] for x in self.folder.names(own) if x.startswith("__bucket=")}
        folders = dict(m.folders) if m else {}
        for b in map(str, changed):
            folders.pop(b, None)
            if b in there:
                folders[b] = f"{own}/__bucket={b}"
        self.folder.put(f"_versions/{version}.json", json.dumps(asdict(Manifest(version, rows.schema.json(), folders, at_us))))
        self._tidy()
        return version

    def _tidy(self) -> None:
        """Removes versions beyond the kept ones, and data folders that none of those refers to and that are older than the last version."""
        known = self.versions()
        for v in known[:-KEPT]:
            self.folder.remove(f"_versions/{v}.json")
        used = {f.split("/")[1] for v in known[-KEPT:] for f in self.manifest(v).folders.values()}
        for x in self.folder.names("data"):
            if x not in used and int(x.partition("-")[0]) <= known[-1] - KEPT:
                self.folder.remove(f"data/{x}")

    def replace(self, rows: DataFrame, at_us: int | None = None) -> int:
        """All rows anew; the version that they are."""
        m = self.manifest()
        return self._write(rows, m and Manifest(m.version, m.schema), list(range(self.buckets)), at_us)

    def merge(self, new: DataFrame, how: dict[str, str] | None = None) -> list[int]:
        """The buckets that were rewritten, none if all rows are as they were; then no version is written.

        Rows of keys that aren't stored are added. With how (column to rule, see upsert()) the others are updated, else
        they stay; of several new rows of a key one counts. Only the buckets that new rows fall into are read, and only those that differ afterwards are written.
        """
        m = self.manifest()
        new = new.dropDuplicates(self.keys).persist()
        try:
            asked = [r.b for r in new.select(self.bucket().alias("b")).distinct().collect()]  # as many as there are buckets at most
            stored = self._rows(m, [m.folders[str(b)] for b in asked if str(b) in m.folders]) if m else new.limit(0)
            merged = insert_new(stored, new, self.keys) if how is None else upsert(stored, new, self.keys, how)
            merged = merged.select(*stored.columns).persist()
            try:
                before = self._sums(stored).withColumnsRenamed({"n": "n0", "digest": "d0"})
                differs = ~(F.col("n").eqNullSafe(F.col("n0")) & F.col("digest").eqNullSafe(F.col("d0")))
                changed = sorted(r.bucket for r in self._sums(merged).join(before, "bucket", "full").where(differs).select("bucket").collect())
                if changed:
                    self._write(merged.where(self.bucket().isin(changed)), m, changed, None)
                return changed
            finally:
                merged.unpersist()
        finally:
            new.unpersist()


def snapshot(rows: DataFrame, path: str, now_us: int, seconds: int = 120) -> DataFrame:
    """rows as stored at path if they were taken less than `seconds` before, else stored anew. Who reads an earlier snapshot goes on with it."""
    table = Table(rows.sparkSession, path)
    m = table.manifest()
    if m is None or m.at_us is None or now_us - m.at_us >= seconds * 1_000_000:
        table.replace(rows, now_us)
    return table.read()


def publish(docs: DataFrame, path: str, stamp: Column, key: str = "day", text: str = "markdown") -> list[int]:
    """Stores docs (key, text, ...) at path/documents and what they replace at path/backups, with replaced_at; a document that is as it was is not written again."""
    from ..operators.state import changed_documents

    spark = docs.sparkSession
    table, backups = Table(spark, f"{path}/documents", (key,)), Table(spark, f"{path}/backups", (key, "replaced_at"))
    stored = table.read()
    if stored is not None:
        gone = changed_documents(docs, stored, key, text).where("previous IS NOT NULL").select(key, F.col("previous").alias(text), stamp.alias("replaced_at"))
        backups.merge(gone)  # first, so that nothing is lost if the second isn't reached
    return table.merge(docs, {c: "new" for c in docs.columns if c != key})
