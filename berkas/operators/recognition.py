"""Around the recogniser: batches by width, decoding of its output, the second pass, the detector's map. The networks
themselves are pluggable (`scored`): none is shipped, and without one a row gets an error, never an invented text."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def width_batches(crops: DataFrame, keys: list[str], size: int = 16) -> DataFrame:
    """Crops (keys, idx, target_w) with `batch` (by rising width, `size` each) and `batch_w`, the width they are padded
    to. The input order is kept in idx."""
    w = Window.partitionBy(*keys).orderBy("target_w", "idx")
    x = crops.withColumn("batch", F.floor((F.row_number().over(w) - 1) / size).cast("int"))
    return x.withColumn("batch_w", F.max("target_w").over(Window.partitionBy(*keys, "batch")))


def step_class(probs: Column) -> Column:
    """The first class of highest score, from 0."""
    return (F.array_position(probs, F.array_max(probs)) - 1).cast("int")


def step_confidence(probs: Column) -> Column:
    """The highest score if it is a probability, else its softmax."""
    top = F.array_max(probs).cast("double")
    return F.when((top >= 0) & (top <= 1), top).otherwise(1 / F.aggregate(F.transform(probs, lambda v: F.exp(v.cast("double") - top)), F.lit(0.0), lambda s, x: s + x))


def greedy_text(steps: DataFrame, keys: list[str], alphabet: list[str]) -> DataFrame:
    """(keys, text, conf) of steps (keys, t, cls, p). A class is written where it differs from the step before; class 0 is
    the blank; a class beyond the alphabet is a space; a space after a space is left out and does not count; conf is the
    mean over written steps, 0 if there are none. Steps of a crop form one array; crops are small."""
    g = steps.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(F.col("t").alias("t"), F.col("cls").cast("int").alias("cls"), F.col("p").cast("double").alias("p")))).alias("s"))
    letters = F.array(*[F.lit(c) for c in alphabet]) if alphabet else F.array().cast("array<string>")
    moved = F.transform("s", lambda x, i: F.struct(x["cls"].alias("cls"), x["p"].alias("p"), F.when(i == 0, F.lit(0)).otherwise(F.coalesce(F.try_element_at(F.col("s"), i)["cls"], F.lit(0))).alias("before")))
    out = F.filter(moved, lambda x: (x["cls"] != x["before"]) & (x["cls"] != 0))
    ch = F.transform(out, lambda x: F.struct(F.when(x["cls"] <= len(alphabet), F.try_element_at(letters, x["cls"])).otherwise(" ").alias("c"), x["p"].alias("p")))
    x = g.select(*keys, ch.alias("ch"))
    kept = F.filter("ch", lambda c, i: ~((c["c"] == " ") & (i > 0) & (F.coalesce(F.try_element_at(F.col("ch"), i)["c"], F.lit("")) == " ")))
    x = x.select(*keys, kept.alias("ch"))
    mean = F.when(F.size("ch") > 0, F.aggregate("ch", F.lit(0.0), lambda s, c: s + c["p"]) / F.size("ch")).otherwise(0.0)
    return x.select(*keys, F.trim(F.array_join(F.transform("ch", lambda c: c["c"]), "")).alias("text"), mean.alias("conf"))


def legible(rows: DataFrame, least: float = 0.4) -> DataFrame:
    """Rows with text and a confidence of at least `least`."""
    return rows.where((F.col("text") != "") & (F.col("conf") >= least))


def second_pass(rows: DataFrame, again: DataFrame, keys: list[str], below: float = 0.65) -> DataFrame:
    """rows (keys, text, conf, ...) with the reading of `again` (keys, re_text, re_conf) where the first was below the
    threshold and the second is better and not empty; `replaced` tells which."""
    x = rows.join(again, keys, "left")
    better = F.coalesce((F.col("conf") < below) & (F.col("re_conf") > F.col("conf")) & (F.col("re_text") != ""), F.lit(False))
    return x.withColumn("replaced", better).withColumn("text", F.when(better, F.col("re_text")).otherwise(F.col("text"))).withColumn("conf", F.when(better, F.col("re_conf")).otherwise(F.col("conf"))).drop("re_text", "re_conf")


def binarised(probs: Column, threshold: float = 0.25) -> Column:
    """The detector's map as booleans."""
    return F.transform(probs, lambda v: v >= threshold)


def region_score(pixels: DataFrame, keys: list[str], threshold: float = 0.25, least: float = 0.4) -> DataFrame:
    """(keys, score) of regions: mean over the pixels (keys, p) of the box that are on; regions under `least` left out."""
    g = pixels.groupBy(*keys).agg(F.avg(F.when(F.col("p") >= threshold, F.col("p"))).alias("score"))
    return g.where(F.col("score") >= least)


def scored(crops: DataFrame, column: str, scorer: Callable[[list], list[tuple[str, float]]] | None) -> DataFrame:
    """crops with `text`, `conf` and `error` from a scorer (a batch of contents -> (text, conf) each), run in Arrow
    batches; a batch that fails is tried item by item, and an item that fails has its error in the row."""
    schema = "text string, conf double, error string"

    @F.pandas_udf(f"struct<{schema.replace(' string', ':string').replace(' double', ':double')}>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in batches:
            items = s.to_list()
            if scorer is None:
                got = [(None, None, "Model not found: no recognition model was given")] * len(items)
            else:
                try:
                    got = [(t, c, None) for t, c in scorer(items)]
                except Exception:
                    got = []
                    for it in items:
                        try:
                            t, c = scorer([it])[0]
                            got.append((t, c, None))
                        except Exception as e:  # noqa: BLE001
                            got.append((None, None, f"Inference failed: {e}"))
            yield pd.DataFrame(got, columns=["text", "conf", "error"])

    x = crops.withColumn("_r", run(F.col(column)))
    return x.select(*crops.columns, "_r.text", "_r.conf", "_r.error")
