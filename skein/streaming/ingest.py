"""Incremental ingest: new files of rows become the latest row per key, document by document."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skein.session import cut_lineage


def latest(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The last row of each key by ``order``; rows with a null key are left out."""
    turn = F.row_number().over(Window.partitionBy(key).orderBy(*[F.desc_nulls_last(c) for c in order]))
    return rows.where(F.col(key).isNotNull()).withColumn("__turn", turn).where("__turn = 1").drop("__turn")


def _exists(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def ingested(spark: SparkSession, target: str, like: DataFrame) -> DataFrame:
    """What ingest_latest holds in ``target``, in the columns of ``like``; empty if nothing has come yet."""
    if not _exists(spark, target):
        return spark.createDataFrame([], like.schema)
    return spark.read.parquet(target).select(*like.columns)


def open_files(spark: SparkSession, path: str) -> DataFrame:
    """A stream of the Parquet file or folder of files at ``path``; the schema is the one it has now."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = place.getFileSystem(spark._jsc.hadoopConfiguration())
    schema = spark.read.parquet(path).schema
    if system.getFileStatus(place).isDirectory():
        return spark.readStream.schema(schema).parquet(path)
    return spark.readStream.schema(schema).option("pathGlobFilter", place.getName()).parquet(str(place.getParent().toString()))


def ingest_latest(stream: DataFrame, target: str, checkpoint: str, key: str, order: list[str], buckets: int = 64, writers: int = 4) -> None:
    """Take in all that a stream has now, then stop. ``target`` holds the latest row per key.

    Keys are spread over ``buckets`` partitions, to be chosen for the size the table will have, and kept; a
    batch rewrites those it touches, each by up to ``writers`` tasks, and is made whole before anything is
    replaced. A batch taken in twice changes nothing, so a retry is safe.
    """

    def merge(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        new = batch.where(F.col(key).isNotNull()).withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))
        touched = [r["bucket"] for r in new.select("bucket").distinct().collect()]
        if not touched:
            return
        if _exists(spark, target):
            new = new.unionByName(spark.read.parquet(target).where(F.col("bucket").isin(touched)).select(*new.columns))
        merged = cut_lineage(latest(new, key, order))
        merged.repartition("bucket", F.pmod(F.xxhash64(key, F.lit(1)), F.lit(writers))).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(target)

    stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
