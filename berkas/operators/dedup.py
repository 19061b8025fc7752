"""Text from several sources, and equal contents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from berkas.functions.text import byte_length, lines, normalized


def native_lines(pages: DataFrame, keys: list[str], text: str = "native_text") -> DataFrame:
    """(keys, native): normalised lines of the pages' own text, each once."""
    return pages.select(*keys, F.explode(F.transform(lines(F.col(text)), normalized)).alias("native")).where("native <> ''").distinct()


def new_text(ocr: DataFrame, native: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ocr (keys, text, ...) that the page's own text does not hold: not empty, equal to no native line, and, where
    both are longer than five bytes, neither inside the other. The lines of a page travel as one array to its rows (a page
    is small), so the comparison is a projection after one equi-join and never a nested loop over pages."""
    n = native.groupBy(*keys).agg(F.collect_set("native").alias("_native"))
    x = ocr.join(n, keys, "left").withColumn("_t", normalized(F.col("text")))
    same = lambda l: (l == F.col("_t")) | ((byte_length(l) > 5) & (byte_length(F.col("_t")) > 5) & (F.contains(l, F.col("_t")) | F.contains(F.col("_t"), l)))
    held = F.coalesce(F.exists("_native", same), F.lit(False))
    return x.where((F.col("_t") != "") & ~held).drop("_t", "_native")


def appended_text(kept: DataFrame, keys: list[str], order: str = "idx") -> DataFrame:
    """(keys, appended, n_kept, confidence) of rows that stayed, in their order."""
    g = kept.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.col("text").alias("t")))).alias("ts"), F.count("*").alias("n_kept"), F.avg("conf").alias("confidence"))
    return g.select(*keys, F.array_join(F.transform("ts", lambda t: t["t"]), "\n").alias("appended"), "n_kept", "confidence")


def content_key(content):
    """SHA-256 of bytes or text, as the key of a cache."""
    return F.sha2(content, 256)


def scored_once(df: DataFrame, content: str, score, columns: list[str]) -> DataFrame:
    """df with `key` and the columns that `score` (a DataFrame with key and content -> the same with `columns`) adds,
    computed once per different content. The result table takes the place of a cache: it is as large as the different
    contents, and nothing is evicted. Equal contents meet by key, in each task before the shuffle; the join moves keys
    alone where the content is not asked for, as column pruning leaves it behind."""
    keyed = df.withColumn("key", content_key(F.col(content)))
    once = keyed.select("key", content).dropDuplicates(["key"])
    return keyed.join(score(once).select("key", *columns), "key", "left")
