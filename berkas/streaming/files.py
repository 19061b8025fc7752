"""Words and files as streams. An addition: the same operators on readStream, with late words bounded by a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from berkas.sources.files import sniffed, supported


def file_stream(spark: SparkSession, folder: str) -> DataFrame:
    """New files of a folder with their format, as they come."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    s = spark.readStream.format("binaryFile").schema(schema).load(folder).withColumn("format", sniffed(F.col("content")))
    return s.withColumn("supported", supported(F.col("format")))


def table_stream(spark: SparkSession, folder: str, schema: StructType) -> DataFrame:
    """Parquet files of a folder as a stream."""
    return spark.readStream.schema(schema).parquet(folder)


def timing_counts(rows: DataFrame, *, late: str = "1 hour", window: str = "1 day") -> DataFrame:
    """Documents, mean and largest total time per worker and window; each document once, rows that come later than `late`
    left out. State is dropped with the watermark."""
    ts = rows.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).dropDuplicatesWithinWatermark(["doc"])
    ok = ts.where(F.col("total_ms") >= 0).where(~F.isnan("total_ms"))
    return ok.groupBy(F.window("ts", window), "worker_id").agg(F.count("*").alias("n"), F.avg("total_ms").alias("mean_ms"), F.max("total_ms").alias("max_ms"))
