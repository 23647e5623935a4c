"""Content-addressed store of sources and revisions in Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


class BlobStore:
    """``blobs`` by hash, each content once, and ``versions`` partitioned by revision."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _read(self, name: str, schema: str) -> DataFrame:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        there = path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)
        return self.spark.read.schema(schema).parquet(f"{self.root}/{name}") if there else self.spark.createDataFrame([], schema)

    def blobs(self) -> DataFrame:
        return self._read("blobs", "blob_hash string, source binary")

    def versions(self) -> DataFrame:
        return self._read("versions", "path string, lang string, size bigint, blob_hash string, rev string")

    def add_revision(self, rev: str, files: DataFrame) -> None:
        """Adds the contents not yet known and replaces the revision's rows; doing it again changes nothing."""
        new = files.select("blob_hash", "source").dropDuplicates(["blob_hash"]).join(self.blobs().select("blob_hash"), "blob_hash", "left_anti")
        new.write.mode("append").parquet(f"{self.root}/blobs")
        rows = files.select("path", "lang", F.col("size").cast("bigint").alias("size"), "blob_hash", F.lit(rev).alias("rev"))
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("rev").parquet(f"{self.root}/versions")

    def at(self, rev: str) -> DataFrame:
        """A revision's files with their contents; files of equal content all have it (Q1)."""
        return self.versions().where(F.col("rev") == rev).join(self.blobs(), "blob_hash")

    def stats(self) -> dict[str, int]:
        return {"blobs": self.blobs().count(), "versions": self.versions().count()}
