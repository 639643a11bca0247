"""An index of rows kept in hash buckets and brought up to date by micro-batches.

Every row carries a mark (a hash of its columns) and the number of the run that wrote it. A micro-batch reads and
rewrites only the buckets of its own keys; a bucket's files are replaced by a new version and a small table says which
version of each bucket holds. So the work of a run follows what it brings, not what is there, and a repeated run
writes the same version again.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from convolake.functions.fixed import SYNC_BATCH


@dataclass
class BucketedIndex:
    """Rows (key, columns, mark, run, unit, bucket) below ``path``; ``unit`` numbers batches of a run within a bucket."""

    spark: SparkSession
    path: str
    key: str
    columns: list[T.StructField]  # the key's among them
    buckets: int = 64
    batch: int = SYNC_BATCH

    @property
    def names(self) -> list[str]:
        return [f.name for f in self.columns]

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")

    def _schema(self) -> T.StructType:
        more = [("mark", T.LongType()), ("run", T.LongType()), ("unit", T.LongType()), ("bucket", T.IntegerType())]
        return T.StructType([*self.columns, *[T.StructField(n, k) for n, k in more]])

    def versions(self, run: int) -> dict[int, int]:
        """The version that holds each bucket after ``run``: at most one row per bucket."""
        if run < 0:
            return {}
        return {r.bucket: r.version for r in self.spark.read.parquet(f"{self.path}/versions/run={run}").collect()}

    def read(self, run: int, buckets: list[int] | None = None) -> DataFrame:
        """The rows after ``run``, of the given buckets or of all; other buckets' files are not opened."""
        held = [(b, v) for b, v in self.versions(run).items() if buckets is None or b in set(buckets)]
        if not held:
            return self.spark.createDataFrame([], self._schema())
        paths = [f"{self.path}/rows/version={v}/bucket={b}" for b, v in held]
        return self.spark.read.schema(self._schema()).option("basePath", f"{self.path}/rows").parquet(*paths).select(*self._schema().names)

    def apply(self, rows: DataFrame, source: DataFrame, run: int, order: str, every: bool = False) -> list[int]:
        """Brings the buckets of ``rows`` up to date and returns them.

        ``rows`` has the index's columns, ``gone`` for rows that were removed, and ``order``: of several rows with one key
        the last counts. A row whose mark is unchanged stays as it is. In the buckets touched (in all with ``every``),
        rows whose key ``source`` no longer has go as well.
        """
        last = rows.groupBy(self.key).agg(F.max_by(F.struct(*[n for n in self.names if n != self.key], "gone"), order).alias("_r"))
        fresh = last.select(self.key, "_r.*").withColumns({"mark": F.xxhash64(*self.names), "bucket": self._bucket()})
        touched = list(range(self.buckets)) if every else sorted(r.bucket for r in fresh.select("bucket").distinct().collect())
        if not touched:
            held = self.versions(run - 1)
        else:
            now = self.read(run - 1, touched)
            named = {n: f"_{n}" for n in [*self.names, "mark", "bucket"] if n != self.key}
            new = fresh.withColumnsRenamed(named).withColumn("_fed", F.lit(True))
            both = now.join(new, self.key, "full")
            fed, same = F.coalesce("_fed", F.lit(False)), F.coalesce(F.col("mark") == F.col("_mark"), F.lit(False))
            changed = fed & ~same
            merged = both.filter(~(fed & F.coalesce("gone", F.lit(False)))).select(
                self.key, *[F.when(changed, F.col(f"_{n}")).otherwise(F.col(n)).alias(n) for n in [*self.names, "mark", "bucket"] if n != self.key],
                F.when(changed, F.lit(run).cast("bigint")).otherwise(F.col("run")).alias("run"), "unit", changed.alias("_changed"),
            )
            kept = merged.join(source.select(self.key).withColumn("_b", self._bucket()).filter(F.col("_b").isin(touched)).select(self.key).distinct(), self.key, "left_semi")
            number = F.row_number().over(Window.partitionBy("bucket", "_changed").orderBy(self.key)) - 1
            unit = F.when(F.col("_changed"), F.floor(number / self.batch)).otherwise(F.col("unit"))
            out = kept.withColumn("unit", unit).select(*self._schema().names)
            version = f"{self.path}/rows/version={run}"
            out.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(version)
            filled = self.spark.read.schema(self._schema()).parquet(version).select("bucket").distinct().collect()
            held = {b: v for b, v in self.versions(run - 1).items() if b not in set(touched)} | {r.bucket: run for r in filled}
        rows = [(b, v) for b, v in sorted(held.items())]
        self.spark.createDataFrame(rows, "bucket int, version bigint").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/versions/run={run}")
        return touched

    def sweep(self, source: DataFrame, run: int) -> None:
        """Removes all rows whose key ``source`` no longer has."""
        none = self.spark.createDataFrame([], T.StructType([*self.columns, T.StructField("gone", T.BooleanType())]))
        self.apply(none.withColumn("_order", F.lit(0)), source, run, "_order", every=True)
