"""Versions of a keyed table, stored by key bucket, with one digest per bucket and a change feed.

Two versions are compared digest by digest first: buckets that agree are neither read nor joined.
The change rows of each version lie in a folder of their own, so a range of versions can be read as
a batch or followed as a stream.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodgelens.operators.chunks import snapshot_diff
from lodgelens.sources.tables import require_columns
from lodgelens.streaming.drain import file_stream

BUCKET, VERSION = "_bucket", "_version"
#: A SHA-256 is summed in four pieces of 15 hex digits, which decimals hold for any number of rows.
_PIECES = range(4)


@dataclass(frozen=True)
class VersionedTable:
    """A table with the columns of ``schema``, one row per value of ``key`` (never null).

    ``buckets`` belongs to the stored table and must stay the same; choose it so that a bucket
    holds some hundred megabytes, as whole buckets are read where a row changed. Every folder is
    overwritten as a whole, so a publication that failed can be repeated.
    """

    spark: SparkSession
    root: str
    schema: T.StructType
    key: str = "chunk_id"
    buckets: int = 256

    def _folder(self, kind: str, version: int) -> str:
        return f"{self.root}/{kind}/{VERSION}={version}"

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")

    def _stored(self, version: int) -> DataFrame:
        fields = [*self.schema.fields, T.StructField(BUCKET, T.IntegerType())]
        return self.spark.read.schema(T.StructType(fields)).parquet(self._folder("data", version))

    def read(self, version: int) -> DataFrame:
        """All rows of a version."""
        return self._stored(version).drop(BUCKET)

    def _digest(self, version: int) -> DataFrame:
        """Rows and the sum of their SHA-256 per bucket; the order of rows does not matter."""
        names = sorted(self.schema.fieldNames())
        content = F.sha2(F.to_json(F.struct(*names), {"ignoreNullFields": "false"}), 256)
        rows = self._stored(version).select(BUCKET, content.alias("sha"))
        piece = [F.conv(F.substring("sha", 1 + 15 * i, 15), 16, 10).cast("decimal(19,0)") for i in _PIECES]
        return rows.groupBy(BUCKET).agg(F.count("*").alias("n"), *[F.sum(p).alias(f"d{i}") for i, p in enumerate(piece)])

    def publish(self, df: DataFrame, version: int, previous: int | None = None) -> DataFrame:
        """Write a version, its digests and its change rows; return the change rows.

        Without ``previous`` every row is an insert. Other columns of ``df`` are left out.
        """
        rows = require_columns(df, *self.schema.fieldNames()).to(self.schema).withColumn(BUCKET, self._bucket())
        # AQE splits buckets that are too large for one task and merges small ones.
        rows.hint("rebalance", BUCKET).write.mode("overwrite").partitionBy(BUCKET).parquet(self._folder("data", version))
        self._digest(version).coalesce(1).write.mode("overwrite").parquet(self._folder("digests", version))
        if previous is None:
            changes = self.read(version).withColumn("_change_type", F.lit("insert"))
        else:
            changes = self.diff(previous, version)
        changes.select(*self.schema.fieldNames(), "_change_type").write.mode("overwrite").parquet(self._folder("changes", version))
        return self.changes(version, version)

    def differing(self, old: int, new: int) -> list[int]:
        """Buckets whose rows differ between two versions: at most ``buckets`` numbers."""
        marks = ["n", *[f"d{i}" for i in _PIECES]]
        kind = f"{BUCKET} int, n long, " + ", ".join(f"d{i} decimal(29,0)" for i in _PIECES)
        one, two = (self.spark.read.schema(kind).parquet(self._folder("digests", v)) for v in (old, new))
        two = two.select(BUCKET, F.struct(*marks).alias("after"))
        both = one.select(BUCKET, F.struct(*marks).alias("before")).join(two, BUCKET, "full_outer")
        return sorted(r[BUCKET] for r in both.filter(~F.col("before").eqNullSafe(F.col("after"))).select(BUCKET).collect())

    def diff(self, old: int, new: int) -> DataFrame:
        """Rows inserted, updated or deleted from ``old`` to ``new``, any two versions.

        Only folders of differing buckets are read; within them keys and content hashes decide.
        """
        wanted = F.col(BUCKET).isin(self.differing(old, new))
        before, after = (self._stored(v).filter(wanted).drop(BUCKET) for v in (old, new))
        return snapshot_diff(before, after, self.key)

    def _change_schema(self) -> T.StructType:
        extra = [T.StructField("_change_type", T.StringType()), T.StructField(VERSION, T.LongType())]
        return T.StructType([*self.schema.fields, *extra])

    def changes(self, first: int, last: int) -> DataFrame:
        """Change rows of the versions from ``first`` to ``last``; other folders are not read."""
        feed = self.spark.read.schema(self._change_schema()).parquet(f"{self.root}/changes")
        return feed.filter(F.col(VERSION).between(first, last))

    def change_stream(self, first: int = 1, files_per_batch: int = 1000) -> DataFrame:
        """Change rows from version ``first`` on, as a stream.

        With its checkpoint a query gets each change once, also over restarts and versions
        published in between. A version must not be published again once a stream has seen it.
        """
        feed = file_stream(self.spark, f"{self.root}/changes", self._change_schema(), files_per_batch, recursive=False)
        return feed.filter(F.col(VERSION) >= first)
