"""Tables from boxes, and tables as text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from berkas.operators.layout import _fold


def reconstructed(items: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, idx, row_no, col_no): boxes (keys, idx, min_x, min_y, max_x, max_y) as cells. From top to bottom by middle, a
    box joins the first row whose first box's middle is nearer than 0.6 of the mean height (at least 8); cells stand by
    the middle of their width. Rows may differ in length; columns are places in the row."""
    item = F.struct(((F.col("min_y") + F.col("max_y")) / 2).cast("double").alias("cy"), F.col("idx").cast("int").alias("idx"), F.col("min_x").cast("double").alias("min_x"), F.col("min_y").cast("double").alias("min_y"), F.col("max_x").cast("double").alias("max_x"), F.col("max_y").cast("double").alias("max_y"))
    g = items.groupBy(*keys).agg(F.sort_array(F.collect_list(item)).alias("items"), F.avg(F.col("max_y") - F.col("min_y")).alias("h"))
    g = g.withColumn("tol", F.greatest(F.col("h") * 0.6, F.lit(8.0)))
    near = lambda a, b: F.coalesce(F.abs((a["min_y"] + a["max_y"]) / 2 - (b["min_y"] + b["max_y"]) / 2) < F.col("tol"), F.lit(False))
    x = g.select(*keys, F.posexplode(_fold(F.col("items"), near)["out"]).alias("rank", "w"))
    x = x.select(*keys, F.col("w.idx").alias("idx"), F.col("w.g").alias("row_no"), ((F.col("w.min_x") + F.col("w.max_x")) / 2).alias("cx"), "rank")
    return x.select(*keys, "idx", "row_no", (F.row_number().over(Window.partitionBy(*keys, "row_no").orderBy("cx", "rank")) - 1).cast("int").alias("col_no"))


def matrix(cells: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, rows): cells (keys, row_no, col_no, text) as array of arrays of text; a null cell is empty."""
    r = cells.groupBy(*keys, "row_no").agg(F.sort_array(F.collect_list(F.struct("col_no", F.coalesce("text", F.lit("")).alias("t")))).alias("c"))
    r = r.select(*keys, "row_no", F.transform("c", lambda x: x["t"]).alias("c"))
    return r.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("row_no", "c"))).alias("r")).select(*keys, F.transform("r", lambda x: x["c"]).alias("rows"))


def csv_text(rows: Column) -> Column:
    """Rows as comma-separated text; a cell with a comma, quote or line feed is quoted, quotes doubled."""
    cell = lambda c: F.when(c.rlike('[,"\n]'), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c)
    return F.array_join(F.transform(rows, lambda r: F.concat(F.array_join(F.transform(r, cell), ","), F.lit("\n"))), "")


def markdown_text(rows: Column) -> Column:
    """Rows as a Markdown table, the first as head. A column is as wide as its longest cell in bytes, at least 3; cells are
    padded by characters; missing cells are empty. No rows, no text."""
    cols = F.array_max(F.transform(rows, F.size))
    at = lambda r, i: F.coalesce(F.try_element_at(r, i), F.lit(""))
    index = F.sequence(F.lit(1), cols)
    width = F.transform(index, lambda i: F.greatest(F.lit(3), F.array_max(F.transform(rows, lambda r: F.octet_length(at(r, i))))))

    def line(r):
        return F.concat(F.lit("|"), F.array_join(F.transform(index, lambda i: F.concat(F.lit(" "), pad(at(r, i), F.element_at(width, i)), F.lit(" |"))), ""), F.lit("\n"))

    def pad(c, w):
        return F.concat(c, F.repeat(F.lit(" "), F.greatest(w - F.length(c), F.lit(0))))

    rule = F.concat(F.lit("|"), F.array_join(F.transform(width, lambda w: F.concat(F.lit("-"), F.repeat(F.lit("-"), w), F.lit("-|"))), ""), F.lit("\n"))
    body = F.array_join(F.transform(F.slice(rows, 2, F.greatest(F.size(rows), F.lit(1))), line), "")
    return F.when(F.coalesce(cols, F.lit(0)) > 0, F.concat(line(F.element_at(rows, 1)), rule, body)).otherwise("")


def table_json(cells: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, json): {"rows": [[{text, confidence, row, col}]]}, pretty-printed, nulls kept."""
    c = F.struct(F.coalesce("text", F.lit("")).alias("text"), F.col("confidence"), F.col("row_no").alias("row"), F.col("col_no").alias("col"))
    r = cells.groupBy(*keys, "row_no").agg(F.sort_array(F.collect_list(F.struct("col_no", c.alias("c")))).alias("c")).select(*keys, "row_no", F.transform("c", lambda x: x["c"]).alias("c"))
    t = r.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("row_no", "c"))).alias("r"))
    return t.select(*keys, F.to_json(F.struct(F.transform("r", lambda x: x["c"]).alias("rows")), {"pretty": "true", "ignoreNullFields": "false"}).alias("json"))
