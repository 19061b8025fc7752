"""Filters, lookups and summaries on results of reading."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def by_confidence(regions: DataFrame, line_rows: DataFrame, keys: list[str], least: float) -> DataFrame:
    """(keys, n_regions, n_lines, confidence, text): regions and lines are filtered apart from each other; the text is that
    of the lines that stay, the confidence the mean of the regions that stay, 0 if none does. Pages of which nothing stays
    have a row too."""
    r = regions.groupBy(*keys).agg(F.count_if(F.col("conf") >= least).alias("n_regions"), F.coalesce(F.avg(F.when(F.col("conf") >= least, F.col("conf"))), F.lit(0.0)).alias("confidence"))
    kept = F.filter(F.sort_array(F.collect_list(F.struct("line_no", "text", "conf"))), lambda x: x["conf"] >= least)
    ls = line_rows.groupBy(*keys).agg(kept.alias("ls")).select(*keys, F.size("ls").cast("long").alias("n_lines"), F.array_join(F.transform("ls", lambda x: x["text"]), "\n").alias("text"))
    return r.join(ls, keys, "full_outer").fillna({"n_regions": 0, "n_lines": 0, "confidence": 0.0, "text": ""}).select(*keys, "n_regions", "n_lines", "confidence", "text")


def found(text: Column, query: str) -> Column:
    """Whether a text holds a query, in whatever case."""
    return F.contains(F.lower(text), F.lit(query.lower()))


def batch_summary(items: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, total, succeeded, failed, all_succeeded, total_duration_ms) of items (keys, success, duration_ms)."""
    g = items.groupBy(*keys).agg(F.count("*").alias("total"), F.count_if("success").alias("succeeded"), F.count_if(~F.col("success")).alias("failed"), F.sum("duration_ms").alias("total_duration_ms"))
    return g.withColumn("all_succeeded", F.col("failed") == 0)


def batch_texts(items: DataFrame, *keys: str) -> DataFrame:
    """(keys, text) of the items (keys, text, success) that succeeded; an item whose success is null did not."""
    return items.where("success").select(*keys, "text")


def page(pages: DataFrame, number: int) -> DataFrame:
    """The page of a number, counted from 1."""
    return pages.where(F.col("page_number") == number)
