"""Quality and time measures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from berkas.functions.text import let, words
from berkas.session import stored

STAGES = ["parsing_ms", "rendering_ms", "preprocessing_ms", "detection_ms", "orientation_ms", "recognition_ms", "second_pass_ms", "postprocessing_ms", "total_ms"]


def edit_distance(a: Column, b: Column) -> Column:
    """Least insertions, deletions and substitutions of characters."""
    return F.levenshtein(a, b)


def character_error(ref: Column, hyp: Column) -> Column:
    """Edit distance over the length of the reference, at most 1; without a reference 0 if the other is empty too, else 1."""
    return F.when(F.length(ref) == 0, F.when(F.length(hyp) == 0, 0.0).otherwise(1.0)).otherwise(F.least(F.levenshtein(ref, hyp) / F.length(ref), F.lit(1.0)))


#: marks that stand for the first words of a pair; further words have code points beyond the basic plane
_MARKS = "".join(map(chr, range(0x3400, 0x3600)))


def word_error(ref: Column, hyp: Column) -> Column:
    """As character_error over words. The different words of a pair are numbered and written as one mark each, so the edit
    distance of the JVM counts words; up to a million different words in a pair."""
    cut = F.struct(words(ref).alias("a"), words(hyp).alias("b"))
    known = let(cut, lambda c: F.struct(c["a"].alias("a"), c["b"].alias("b"), F.array_distinct(F.concat(c["a"], c["b"])).alias("u")))

    def marks(ws: Column, u: Column) -> Column:
        one = lambda k: F.when(k <= len(_MARKS), F.substring(F.lit(_MARKS), k, F.lit(1))).otherwise(F.decode(F.unhex(F.lpad(F.hex(k + 0x10000), 8, "0")), "UTF-32"))
        return F.array_join(F.transform(ws, lambda w: one(F.array_position(u, w).cast("int"))), "")

    rate = lambda x: F.when(F.size(x["a"]) == 0, F.when(F.size(x["b"]) == 0, 0.0).otherwise(1.0)).otherwise(F.least(F.levenshtein(marks(x["a"], x["u"]), marks(x["b"], x["u"])) / F.size(x["a"]), F.lit(1.0)))
    return F.when(ref.isNotNull() & hyp.isNotNull(), let(known, rate))


def nearest_rank(df: DataFrame, keys: list[str], value: str, probs: tuple[int, ...] = (50, 90, 95, 99), *, sortable: int = 2_000_000) -> DataFrame:
    """(keys, n, min, p.., max, mean): the percentile p is the value at place round(p / 100 * (n - 1)) of the sorted values,
    half away from zero. Nulls and NaN are left out; a group without values gives no row.

    A group of up to `sortable` values is ranked by a window. Of a larger one, values are counted in ranges first, with
    map-side combination, and only the range that holds the wanted place is looked into, until it is small enough; so no
    task sorts a large group, and the result is the same, exactly."""
    ks = [f"_k{i}" for i in range(max(1, len(keys)))]
    group = [F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)] or [F.lit(0).alias("_k0")]
    v = df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).select(*group, F.col(value).cast("double").alias("v"))
    n = v.groupBy(*ks).agg(F.count("*").alias("n"), F.min("v").alias("min"), F.max("v").alias("max"), F.avg("v").alias("mean"))
    place = lambda p: F.round(F.lit(p) / 100 * (F.col("n") - 1)).cast("long")
    large = n.where(F.col("n") > sortable)
    split = not large.isEmpty()
    few = _beside(v, n.where(F.col("n") <= sortable), ks, []) if split else v
    ranked = few.withColumn("i", F.row_number().over(Window.partitionBy(*ks).orderBy("v")) - 1)
    rows = _beside(ranked, n, ks, ["n"]).groupBy(*ks).agg(*[F.max(F.when(F.col("i") == place(p), F.col("v"))).alias(f"p{p}") for p in probs])
    if split:
        todo = large.select(*ks, F.col("min").alias("lo"), F.col("max").alias("hi"), F.explode(F.array(*[F.struct(F.lit(p).alias("q"), place(p).alias("k")) for p in probs])).alias("w"))
        got = _in_large(v, todo.select(*ks, "lo", "hi", "w.q", "w.k"), ks, sortable)
        rows = rows.unionByName(got.groupBy(*ks).agg(*[F.max(F.when(F.col("q") == p, F.col("v"))).alias(f"p{p}") for p in probs]))
    out = _beside(n, rows, ks, [f"p{p}" for p in probs])
    return out.select(*[F.col(f"_k{i}").alias(k) for i, k in enumerate(keys)], "n", "min", *[f"p{p}" for p in probs], "max", "mean")


def _beside(x: DataFrame, y: DataFrame, ks: list[str], more: list[str], test: Column | None = None) -> DataFrame:
    """x with the columns `more` of y where their keys agree; null keys agree too."""
    y = y.select(*[F.col(c).alias(f"_{c}") for c in ks], *more)
    same = _all([F.col(c).eqNullSafe(F.col(f"_{c}")) for c in ks] + ([] if test is None else [test]))
    return x.join(y, same).select(*x.columns, *more)


def _in_large(v: DataFrame, todo: DataFrame, ks: list[str], sortable: int) -> DataFrame:
    """(ks, q, v): the value at place k of each range (lo, hi) of `todo`."""
    found = None
    todo = stored(todo)
    while not todo.isEmpty():
        todo = stored(_narrowed(v, todo, ks))
        one = todo.where("lo = hi").select(*ks, "q", F.col("lo").alias("v"))
        small = _inside(v, todo.where((F.col("m") <= sortable) & (F.col("lo") < F.col("hi"))), ks)
        small = small.withColumn("i", F.row_number().over(Window.partitionBy(*ks, "q").orderBy("v")) - 1).where("i = k").select(*ks, "q", "v")
        got = one.unionByName(small)
        found = got if found is None else found.unionByName(got)
        todo = todo.where((F.col("m") > sortable) & (F.col("lo") < F.col("hi")))
    return found


def _inside(v: DataFrame, todo: DataFrame, ks: list[str]) -> DataFrame:
    """Values with each range (q, lo, hi, k) of their group that holds them."""
    return _beside(v, todo, ks, ["q", "lo", "hi", "k"], (F.col("v") >= F.col("lo")) & (F.col("v") <= F.col("hi")))


def _narrowed(v: DataFrame, todo: DataFrame, ks: list[str], slots: int = 1024) -> DataFrame:
    """todo with each range cut down to the slot of `slots` equal ones that holds the place k; lo and hi are values of the
    slot, so the range always shrinks."""
    x = _inside(v, todo, ks)
    slot = F.least(F.floor((F.col("v") / 2 - F.col("lo") / 2) / (F.col("hi") / 2 - F.col("lo") / 2) * slots), F.lit(slots - 1))
    g = x.groupBy(*ks, "q", "k", slot.alias("slot")).agg(F.count("*").alias("m"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    below = F.sum("m").over(Window.partitionBy(*ks, "q").orderBy("slot")) - F.col("m")
    g = g.withColumn("below", below).where((F.col("below") <= F.col("k")) & (F.col("k") < F.col("below") + F.col("m")))
    return g.select(*ks, "lo", "hi", "m", "q", (F.col("k") - F.col("below")).alias("k"))


def _all(tests: list[Column]) -> Column:
    out = tests[0]
    for t in tests[1:]:
        out = out & t
    return out


def timing_summary(row: str = "") -> Column:
    """Text report of the stage times of a row; stages that need not run appear only if they took time."""
    c = lambda n: F.coalesce(F.col(f"{row}{n}").cast("double"), F.lit(0.0))
    rule = "-" * 40 + "\n"
    line = lambda label, n: F.format_string(f"{label:<19}%8.2f ms\n", c(n))
    maybe = lambda label, n: F.when(c(n) > 0, line(label, n)).otherwise("")
    return F.concat(
        F.lit(rule + "          STAGE TIMING BREAKDOWN        \n" + rule), maybe("Parsing:", "parsing_ms"), maybe("Rendering:", "rendering_ms"), line("Preprocessing:", "preprocessing_ms"), line("Detection:", "detection_ms"),
        maybe("Orientation:", "orientation_ms"), line("Recognition:", "recognition_ms"), maybe("Second Pass Re-OCR:", "second_pass_ms"), line("Postprocessing:", "postprocessing_ms"), F.lit(rule), line("TOTAL:", "total_ms"), F.lit(rule),
    )
