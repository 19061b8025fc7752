"""Overlapping boxes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from berkas.functions.geometry import iou


def overlapping_pairs(boxes: DataFrame, keys: list[str], least: float = 0.0) -> DataFrame:
    """(keys, idx_a, idx_b, iou) of boxes (keys, idx, b) of one image that overlap by more than `least`. The join is on
    the image, and boxes meet only inside it."""
    a = boxes.select(*keys, F.col("idx").alias("idx_a"), F.col("b").alias("a"))
    b = boxes.select(*keys, F.col("idx").alias("idx_b"), F.col("b").alias("b"))
    x = a.join(b, keys).where("idx_a < idx_b and a.min_x < b.max_x and b.min_x < a.max_x and a.min_y < b.max_y and b.min_y < a.max_y")
    return x.select(*keys, "idx_a", "idx_b", iou(F.col("a"), F.col("b")).alias("iou")).where(F.col("iou") > least)


def kept_boxes(boxes: DataFrame, keys: list[str], threshold: float = 0.4) -> DataFrame:
    """(keys, idx, conf, rank) of the boxes that stay: by falling confidence (then as given), a box stays if none that
    stayed before overlaps it by more than the threshold. One fold per image, inside the JVM."""
    b = F.struct(*[F.col(f"b.{c}").cast("double").alias(c) for c in ("min_x", "min_y", "max_x", "max_y")])
    item = F.struct((-F.col("conf").cast("double")).alias("n"), F.col("idx").cast("int").alias("idx"), b.alias("b"))
    images = boxes.groupBy(*keys).agg(F.sort_array(F.collect_list(item)).alias("items"))
    start = F.array().cast("array<struct<n:double,idx:int,b:struct<min_x:double,min_y:double,max_x:double,max_y:double>>>")
    kept = F.aggregate("items", start, lambda acc, it: F.when(F.exists(acc, lambda k: iou(k["b"], it["b"]) > threshold), acc).otherwise(F.concat(acc, F.array(it))))
    x = images.select(*keys, F.posexplode(kept).alias("rank", "k"))
    return x.select(*keys, F.col("k.idx").alias("idx"), (-F.col("k.n")).alias("conf"), (F.col("rank") + 1).cast("int").alias("rank"))
