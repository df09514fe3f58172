"""Parquet tables cut by the hash of a key, so that a merge rewrites the buckets it touches and no others."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


class BucketTable:
    """Rows below ``path/<by>=.../bucket=<n>``, the bucket being a hash of ``key``.

    The number of buckets is fixed when the table is made; about a gigabyte a bucket is a good size. Merges are
    Spark's dynamic partition overwrites: tasks write beside the table, and only the commit replaces the touched
    folders. Opening and merging ask the driver for one row per touched bucket, never for data.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, key: str, buckets: int, by: tuple[str, ...] = ()):
        self.spark, self.path, self.key, self.buckets, self.by = spark, path, key, buckets, by
        self.schema = T.StructType.fromDDL(schema)
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._at = lambda *parts: hadoop("/".join((path, *parts)))
        self._fs = self._at().getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int").alias("bucket")

    def rows(self) -> DataFrame:
        """All rows with their ``bucket``; an empty table before the first merge."""
        full = T.StructType([*self.schema, T.StructField("bucket", T.IntegerType())])
        if not self._fs.exists(self._at()):
            return self.spark.createDataFrame([], full)
        return self.spark.read.schema(full).parquet(self.path)

    def files(self) -> dict[tuple, set[str]]:
        """File names by bucket."""
        places = self.rows().select(*self.by, "bucket", F.col("_metadata.file_name").alias("f")).distinct()
        out: dict[tuple, set[str]] = {}
        for *place, name in places.collect() if self._fs.exists(self._at()) else []:
            out.setdefault(tuple(place), set()).add(name)
        return out

    def merge(self, gone: DataFrame, rows: DataFrame, reset: list[tuple] = ()) -> list[tuple]:
        """Take away the rows whose ``by`` and key are in ``gone``, add ``rows``; returns the touched buckets.

        ``rows`` belong to keys in ``gone`` too. Nothing that is stored in the buckets ``reset`` is kept. A merge
        that is repeated after a failure has the same result.
        """
        keys = [*self.by, self.key]
        places = gone.select(*self.by, self.bucket()).distinct().collect()  # at most one row for each bucket
        touched = sorted({tuple(p) for p in places} | set(reset))
        if not touched:
            return []
        kept = self.rows().where(self._within([t for t in touched if t not in set(reset)]))
        kept = kept.join(gone.select(*keys).distinct(), keys, "left_anti").drop("bucket")
        names = self.schema.names
        merged = kept.select(*names).unionByName(rows.select(*names)).withColumn("bucket", self.bucket())
        before = {t: self._list(t) for t in touched}
        writer = merged.hint("rebalance", *self.by, "bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        writer.partitionBy(*self.by, "bucket").parquet(self.path)
        for t in touched:
            if before[t] and self._list(t) == before[t]:  # nothing is left for it, so the overwrite passed it by
                self._fs.delete(self._folder(t), True)
        return touched

    def _within(self, touched: list[tuple]) -> Column:
        """A filter on partition columns alone, so that other buckets aren't even listed for reading."""
        groups: dict[tuple, list[int]] = {}
        for *place, bucket in touched:
            groups.setdefault(tuple(place), []).append(bucket)
        found = F.lit(False)
        for place, some in groups.items():
            here = F.col("bucket").isin(some)
            for column, value in zip(self.by, place, strict=True):
                here &= F.col(column) == value
            found |= here
        return found

    def _folder(self, place: tuple):
        return self._at(*(f"{c}={v}" for c, v in zip((*self.by, "bucket"), place, strict=True)))

    def _list(self, place: tuple) -> set[str]:
        folder = self._folder(place)
        return {f.getPath().getName() for f in self._fs.listStatus(folder)} if self._fs.exists(folder) else set()
