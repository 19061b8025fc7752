"""Queries of the general training-data operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from berkas.operators.packed_fields import known_values, split_packed
from berkas.sources.tables import table


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """Every value of the packed card fields; a record delivered twice gives its rows once."""
    ktp, sim = table(spark, folder, "ktp_data"), table(spark, folder, "sim_data")
    units = known_values((ktp, "kota_kabupaten")).withColumn("wide", F.lit(False)).unionAll(known_values((ktp, "provinsi")).withColumn("wide", F.lit(True)))
    words = units.groupBy("word").agg(F.max("wide").alias("wide"))
    a = split_packed(ktp, "rec_id", {"tempat_tgl_lahir": "birth", "rt_rw": "hood"}, words).withColumn("tbl", F.lit("ktp_data"))
    b = split_packed(sim, "rec_id", {"tempat_tgl_lahir": "birth"}, words).withColumn("tbl", F.lit("sim_data"))
    return a.unionAll(b).select("tbl", "rec_id", "field_name", "pos", "piece").distinct()


QUERIES = {"p1_found": p1_found}
SQL: dict[str, str] = {}
