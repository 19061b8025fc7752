"""Reading order, lines and text of pages. Words are rows (key columns, idx, text, min_x, min_y, max_x, max_y, conf)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def reading_columns(words: DataFrame, keys: list[str]) -> DataFrame:
    """Words with `two_column`, `side` (left, right, spanning) and `pos`, the place in reading order (by side, then as
    given). A page has two columns if left and right hold three boxes each and under a fifth span the gutter; spanning
    boxes of such a page are left out. One window per page serves all."""
    p = Window.partitionBy(*keys)
    lo, hi = F.min("min_x").over(p), F.max("max_x").over(p)
    width = F.greatest(hi - lo, F.lit(1.0))
    gutter = F.greatest(width * 0.05, F.avg(F.greatest(F.col("max_y") - F.col("min_y"), F.lit(1.0))).over(p) * 0.5)
    mid = lo + width / 2
    x = words.withColumn("side", F.when(F.col("max_x") < mid - gutter, "left").when(F.col("min_x") > mid + gutter, "right").otherwise("spanning"))
    n = F.count("*").over(p)
    two = (F.count_if(F.col("side") == "left").over(p) >= 3) & (F.count_if(F.col("side") == "right").over(p) >= 3) & (F.count_if(F.col("side") == "spanning").over(p) / n < 0.2)
    x = x.withColumn("two_column", two).where(~F.col("two_column") | (F.col("side") != "spanning"))
    order = F.when(F.col("two_column") & (F.col("side") == "right"), 1).otherwise(0)
    return x.withColumn("pos", F.row_number().over(p.orderBy(order, "idx")).cast("int"))


def _fold(items: Column, belongs, height: Column | None = None) -> Column:
    """Assign items (in order) to the first group whose first member they belong to; array of (group, item) per item."""
    start = F.struct(F.array().cast("array<struct<idx:int,min_x:double,min_y:double,max_x:double,max_y:double,g:int>>").alias("out"), F.array().cast("array<struct<min_y:double,max_y:double>>").alias("anchors"))

    def step(acc, it):
        hit = F.array_position(F.transform(acc["anchors"], lambda a: belongs(a, it)), True).cast("int")
        g = F.when(hit > 0, hit - 1).otherwise(F.size(acc["anchors"]))
        anchors = F.when(hit > 0, acc["anchors"]).otherwise(F.concat(acc["anchors"], F.array(F.struct(it["min_y"].alias("min_y"), it["max_y"].alias("max_y")))))
        out = F.concat(acc["out"], F.array(F.struct(it["idx"].alias("idx"), it["min_x"].alias("min_x"), it["min_y"].alias("min_y"), it["max_x"].alias("max_x"), it["max_y"].alias("max_y"), g.alias("g"))))
        return F.struct(out.alias("out"), anchors.alias("anchors"))

    return F.aggregate(items, start, step)


def _overlaps(a: Column, b: Column) -> Column:
    over = F.least(a["max_y"], b["max_y"]) - F.greatest(a["min_y"], b["min_y"])
    small = F.least(F.greatest(a["max_y"] - a["min_y"], F.lit(1.0)), F.greatest(b["max_y"] - b["min_y"], F.lit(1.0)))
    return F.coalesce((over > 0) & (over / small >= 0.5), F.lit(False))


def sorted_lines(words: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, idx, line_no, pos): words in reading order. Taken from top to bottom, a word joins the first line whose
    first word it overlaps by half of the smaller height; lines stand by the middle of their first word, words by
    min_x; of equals the one found first stands first. One fold per page, inside the JVM."""
    item = F.struct(F.col("min_y").cast("double").alias("min_y"), F.col("idx").cast("int").alias("idx"), F.col("min_x").cast("double").alias("min_x"), F.col("max_x").cast("double").alias("max_x"), F.col("max_y").cast("double").alias("max_y"))
    pages = words.groupBy(*keys).agg(F.sort_array(F.collect_list(item)).alias("items"))
    x = pages.select(*keys, _fold(F.col("items"), _overlaps).alias("f"))
    x = x.select(*keys, F.col("f.anchors").alias("anchors"), F.posexplode("f.out").alias("rank", "w"))
    cy = F.element_at("anchors", F.col("w.g") + 1)
    x = x.select(*keys, F.col("w.idx").alias("idx"), F.col("w.g").alias("g"), F.col("w.min_x").alias("min_x"), "rank", ((cy["min_y"] + cy["max_y"]) / 2).alias("cy"))
    order = Window.partitionBy(*keys).orderBy("cy", "g", "min_x", "rank")
    line = Window.partitionBy(*keys).orderBy("cy", "g")
    return x.select(*keys, "idx", F.dense_rank().over(line).cast("int").alias("line_no"), F.row_number().over(order).cast("int").alias("pos"))


def grouped_lines(words: DataFrame, keys: list[str], order: str = "idx") -> DataFrame:
    """Words with `line_no` from 1: a new line begins where min_y differs from that of the word before by more than half
    of the word's own height (at least 1)."""
    w = Window.partitionBy(*keys).orderBy(order)
    gap = F.abs(F.col("min_y") - F.lag("min_y").over(w))
    new = F.when(gap > F.greatest(F.col("max_y") - F.col("min_y"), F.lit(1.0)) * 0.5, 1).otherwise(0)
    return words.withColumn("_new", new).withColumn("line_no", (F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)) + 1).cast("int")).drop("_new")


def line_table(grouped: DataFrame, keys: list[str], order: str = "idx") -> DataFrame:
    """(keys, line_no, text, conf, min_x, min_y, max_x, max_y, n_words): words joined by a blank, mean confidence, bounds."""
    g = grouped.groupBy(*keys, "line_no").agg(
        F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.coalesce("text", F.lit("")).alias("t")))).alias("ws"),
        F.avg("conf").alias("conf"), F.min("min_x").alias("min_x"), F.min("min_y").alias("min_y"), F.max("max_x").alias("max_x"), F.max("max_y").alias("max_y"), F.count("*").alias("n_words"),
    )
    return g.select(*keys, "line_no", F.array_join(F.transform("ws", lambda w: w["t"]), " ").alias("text"), "conf", "min_x", "min_y", "max_x", "max_y", "n_words")


def page_text(line_rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, text, n_lines): lines joined by line feeds."""
    g = line_rows.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("line_no", "text"))).alias("ls"), F.count("*").alias("n_lines"))
    return g.select(*keys, F.array_join(F.transform("ls", lambda x: x["text"]), "\n").alias("text"), "n_lines")


def page_confidence(words: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, confidence): mean over regions, 0 if there is none."""
    return words.groupBy(*keys).agg(F.coalesce(F.avg("conf"), F.lit(0.0)).alias("confidence"))
