"""Queries of the training-data operators and SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from berkas.llm.addresses import same_houses
from berkas.llm.cards import addresses, city_names, persons
from berkas.llm.names import linked_merchants, linked_persons
from berkas.llm.pagenoise import _FIRST, _SECOND, corrections, cut_cells, following, joined_cell, labelled_lines, lexicon, paragraphs, plain_word, rejoined, repaired, word_rows, repeated_headings, whole_words, _cased
from berkas.llm.pii import name_contexts, name_tokens, placeholders, previous_line, spans, with_tokens
from berkas.llm.mixing import mixed, shares
from berkas.llm.packing import packed, token_count
from berkas.llm.percentiles import bounds, merged, multi_select, summaries
from berkas.llm.subjects import SHARE, fitted, passages, subject_shares
from berkas.operators.packed_fields import known_values
from berkas.session import stored
from berkas.sources.tables import table


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of card records of one person, and of a reference merchant with each of its receipts."""
    people = linked_persons(persons(spark, folder))
    shops = linked_merchants(table(spark, folder, "receipt_data"), table(spark, folder, "merchant_ref"), city_names(spark, folder))
    shops = shops.select(F.least("merchant_id", "rec_id").alias("rec_a"), F.greatest("merchant_id", "rec_id").alias("rec_b"))
    return people.unionAll(shops)


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of card records at the same house."""
    return same_houses(stored(addresses(spark, folder)))


def _register(spark: SparkSession, folder: str) -> tuple[list[str] | DataFrame, list[str]]:
    """Name tokens and names of places (administrative units) of the register of identity cards."""
    ktp = table(spark, folder, "ktp_data")
    places = [r[0] for r in known_values((ktp, "kota_kabupaten"), (ktp, "kel_desa")).limit(200_001).collect()]
    if len(places) > 200_000:
        raise ValueError("more than 200,000 names of places: not a list of administrative units")
    texts = table(spark, folder, "ocr_text").select("text").unionAll(table(spark, folder, "documents").select("text"))
    return name_tokens(ktp, "nama", texts=texts), places


P5_KINDS = ["person_name", "phone", "email", "id_number", "address"]


def _texts(spark: SparkSession, folder: str) -> tuple[DataFrame, list[str] | Column, list[str], list[str]]:
    """(carrier, row_id, text, before) of every scanned line and document, each once and spread over the tasks, with the
    name tokens, places and words that announce names to search them by. Lines are moved once, by page: copies fall together and the line before is
    at hand."""
    tokens, places = _register(spark, folder)
    lines = table(spark, folder, "ocr_text").select("ocr_id", "doc", "page", "idx", "text").where("text is not null").repartition("doc", "page").distinct()
    lines = previous_line(lines, ["doc", "page"], ["idx", "ocr_id"], "text").select(F.lit("ocr_text").alias("carrier"), F.col("ocr_id").alias("row_id"), "text", "before")
    docs = table(spark, folder, "documents").where("text is not null").select(F.lit("documents").alias("carrier"), F.col("doc_id").alias("row_id"), "text", F.lit("").alias("before"))
    texts, own = with_tokens(lines.unionAll(docs.repartition("row_id")), tokens)
    every = table(spark, folder, "ocr_text").select("text").unionAll(table(spark, folder, "documents").select("text")).where("text is not null")
    return texts, own, places, name_contexts(*with_tokens(every, tokens))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """Personal information in scanned lines and documents, with its place in the text."""
    texts, own, places, contexts = _texts(spark, folder)
    found = texts.select("carrier", "row_id", F.explode(spans(F.col("text"), F.col("before"), own, places, contexts)).alias("s")).select("carrier", "row_id", "s.kind", "s.start_pos", "s.end_pos")
    return found.where(F.col("kind").isin(P5_KINDS)).distinct()


def p5_redacted(spark: SparkSession, folder: str) -> DataFrame:
    """Every scanned line and document with typed placeholders in the place of personal information."""
    texts, own, places, contexts = _texts(spark, folder)
    return texts.select("carrier", "row_id", placeholders(F.col("text"), F.col("before"), own, places, contexts).alias("text")).distinct()


class _Noise:
    """The tables that the queries on page noise share: labelled lines, cells, the lexicon and the corrections."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        lines = table(spark, folder, "ocr_text").where("trim(text) <> ''").select("ocr_id", "doc", "page", "idx", "text", "min_y")
        self.labels = stored(labelled_lines(lines))
        cells = stored(table(spark, folder, "table_cells").select("cell_id", "doc", "row_no", "col_no", "text").distinct())
        self.heads = stored(repeated_headings(cells))
        self.cells = stored(cut_cells(cells.join(self.heads, "cell_id", "left_anti").where("text is not null")))
        docs = table(spark, folder, "documents").where("text is not null").select("text")
        self.lexicon = stored(lexicon([self.labels, self.cells], [docs]))
        self.fixes = stored(corrections(self.lexicon))

    def halves(self) -> DataFrame:
        """(carrier, row_id, a, b) of words broken over lines, and inside cells."""
        over = following(self.labels.where("broken or first")).where("broken")
        a, b = F.regexp_extract("text", _FIRST, 1), F.regexp_extract("next_text", _SECOND, 1)
        h1 = over.select(F.lit("ocr_text").alias("carrier"), F.col("ocr_id").alias("row_id"), a.alias("a"), b.alias("b"))
        h2 = self.cells.select(F.lit("table_cells").alias("carrier"), F.col("cell_id").alias("row_id"), F.explode("halves").alias("h")).select("carrier", "row_id", "h.a", "h.b")
        return h1.unionAll(h2).where("a <> '' and b <> '' and a rlike '[A-Za-z]' and b rlike '[A-Za-z]'")

    def whole(self) -> DataFrame:
        return whole_words(self.halves(), self.lexicon, self.fixes).select("carrier", "row_id", "a", "b", "fixed")


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """Page furniture, broken words and misread words in scanned lines and table cells."""
    x = _Noise(spark, folder)
    f1 = x.labels.where("state in ('header', 'footer')").select(F.lit("ocr_text").alias("carrier"), F.col("ocr_id").alias("row_id"))
    f2 = x.heads.select(F.lit("table_cells").alias("carrier"), F.col("cell_id").alias("row_id"))
    furniture = f1.unionAll(f2).select("carrier", "row_id", F.lit("furniture").alias("kind"), F.lit("").alias("fixed"))
    hyphen = x.whole().select("carrier", "row_id", F.lit("hyphen").alias("kind"), "fixed")
    # misread words and figures; the halves of broken words are not words
    t1 = x.labels.where("cut is not null").select(F.lit("ocr_text").alias("carrier"), F.col("ocr_id").alias("row_id"), "cut", "figs")
    texts = t1.unionAll(x.cells.select(F.lit("table_cells").alias("carrier"), F.col("cell_id").alias("row_id"), "cut", "figs"))
    words = word_rows(texts, "carrier", "row_id").withColumn("word", plain_word(F.col("raw")))
    char = words.join(x.fixes, "word").select("carrier", "row_id", F.lit("char").alias("kind"), _cased(F.col("raw"), F.col("fixed")).alias("fixed"))
    figs = texts.where("figs is not null").select("carrier", "row_id", F.lit("char").alias("kind"), F.explode(F.split("figs", " ")).alias("fixed"))
    return furniture.unionAll(hyphen).unionAll(char).unionAll(figs).distinct()


def p4_paragraphs(spark: SparkSession, folder: str) -> DataFrame:
    """The continuous paragraphs of every document: without furniture, broken words whole, misread words corrected."""
    x = _Noise(spark, folder)
    body = following(x.labels.withColumn("next_of_page", F.col("next_text"))).select("ocr_id", "doc", "page", "idx", "text", "state", "next_text", "first", "next_of_page", "cut", "figs")
    return paragraphs(rejoined(repaired(body, "ocr_id", x.fixes), x.whole().where("carrier = 'ocr_text'")))


def p4_cells(spark: SparkSession, folder: str) -> DataFrame:
    """Every table cell that is no repeated heading, broken words whole and misread words corrected."""
    x = _Noise(spark, folder)
    whole = x.whole().where("carrier = 'table_cells'").groupBy("row_id").agg(F.collect_list(F.struct("a", "b", "fixed")).alias("w"))
    t = repaired(x.cells.select("cell_id", "doc", "text", "cut", "figs"), "cell_id", x.fixes).join(whole.withColumnRenamed("row_id", "cell_id"), "cell_id", "left")
    return t.select("cell_id", "doc", F.coalesce(joined_cell(F.col("text"), F.col("w")), F.col("text")).alias("text"))


MOST_SUBJECTS = 1000  #: subjects and capacities are short lists; a table with more of them is refused, not cut
MOST_CAPACITIES = 1000


def _subject_shares(spark: SparkSession, folder: str, least: float) -> DataFrame:
    docs = stored(table(spark, folder, "documents").where("text is not null").select("doc_id", passages(F.col("text")).alias("p")).where("size(p) > 0"))
    names = sorted(r[0] for r in table(spark, folder, "subjects").select("subject").distinct().limit(MOST_SUBJECTS + 1).collect() if r[0])
    if len(names) > MOST_SUBJECTS:
        raise ValueError(f"more than {MOST_SUBJECTS} subjects")
    return subject_shares(docs, fitted(docs, table(spark, folder, "subject_labels"), names), least)


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    """The subjects that a good part of each document deals with."""
    return _subject_shares(spark, folder, SHARE).select("doc_id", "subject").distinct()


def p9_composition(spark: SparkSession, folder: str) -> DataFrame:
    """The make-up of the corpus: documents and summed shares per subject."""
    s = _subject_shares(spark, folder, 0.0).distinct()
    return s.groupBy("subject").agg(F.count("*").alias("n_docs"), F.sum("share").alias("share_sum"))


P2_KINDS = ["worker_id", "doc_format", "account_id", "day"]
P2_MEASURES = ["total_ms", "detection_ms", "recognition_ms"]
P2_SLICES = 1024  #: slices of a day summary: the rank of a combined percentile is off by less than a thousandth of the values
P2_PROBS = [0.5, 0.9, 0.95, 0.99]


def _timings(spark: SparkSession, folder: str) -> DataFrame:
    """One row per document with the group keys as strings; copies of a record agree in all these columns."""
    t = table(spark, folder, "stage_timing")
    keys = ["worker_id", "doc_format", F.col("account_id").cast("string").alias("account_id"), F.date_format("ts", "yyyy-MM-dd").alias("day")]
    return t.select("doc", *keys, *P2_MEASURES).distinct()


def _named(df: DataFrame) -> DataFrame:
    """The places in P2_KINDS and P2_MEASURES as names."""
    pick = lambda names, c: F.element_at(F.array(*[F.lit(x) for x in names]), F.col(c) + 1)
    return df.withColumn("grouping", pick(P2_KINDS, "kind")).withColumn("measure", pick(P2_MEASURES, "m"))


def _wide(df: DataFrame, value: str, *more: str) -> DataFrame:
    """One row per group and measure, the percentiles side by side."""
    cols = [F.max(F.when(F.col("q") == i, F.col(value))).cast("double").alias(f"p{round(p * 100)}") for i, p in enumerate(P2_PROBS)]
    return _named(df).groupBy("grouping", "grp", "measure", "n").agg(*cols, *[F.max(m).alias(m) for m in more])


def p2_percentiles(spark: SparkSession, folder: str) -> DataFrame:
    """Exact percentiles of the stage times by worker, format, account and day; the error bound is 0 ranks."""
    rows = multi_select(stored(_timings(spark, folder)), P2_KINDS, P2_MEASURES, P2_PROBS)
    return _wide(rows, "value").withColumn("max_rank_error", F.lit(0).cast("long"))


def _days(spark: SparkSession, folder: str) -> DataFrame:
    return merged(summaries(_timings(spark, folder), P2_KINDS[:3], P2_MEASURES, part="day", slices=P2_SLICES), slices=P2_SLICES)


def p2_day_summaries(spark: SparkSession, folder: str) -> DataFrame:
    """Summaries of each day by worker, format and account, a row per slice: the form in which days are kept and later
    combined. The rank of a value between two slice ends is off by less than max_rank_error and their distance."""
    s = _named(_days(spark, folder)).select("grouping", "grp", "measure", F.col("part").alias("day"), "n", F.col("err").alias("max_rank_error"), F.explode(F.arrays_zip("cum", "vals")).alias("z"))
    return s.select("grouping", "grp", "measure", "day", "n", "max_rank_error", F.col("z.cum").alias("rank"), F.col("z.vals").cast("double").alias("slice_end"))


def p2_combined(spark: SparkSession, folder: str) -> DataFrame:
    """Percentiles from the day summaries put together, without the measurements, each with its error bound in ranks."""
    return _wide(bounds(_days(spark, folder), P2_PROBS), "hi", "error").withColumnRenamed("error", "max_rank_error")


def p7_packed(spark: SparkSession, folder: str) -> DataFrame:
    """Every document with its containers of each capacity."""
    docs = stored(table(spark, folder, "documents").select("doc_id", token_count(F.col("text")).alias("n_tokens")))
    out = None
    sizes = table(spark, folder, "pack_sizes").where("capacity_tokens > 0").limit(MOST_CAPACITIES + 1).collect()
    if len(sizes) > MOST_CAPACITIES:
        raise ValueError(f"more than {MOST_CAPACITIES} capacities")
    for r in sizes:
        x = packed(docs, r["capacity_tokens"]).select(F.lit(r["size_name"]).alias("size_name"), F.lit(r["capacity_tokens"]).alias("capacity_tokens"), "bin_id", "doc_id", "piece", "start_token", "n_tokens")
        out = x if out is None else out.unionAll(x)
    return out if out is not None else spark.createDataFrame([], "size_name string, capacity_tokens int, bin_id long, doc_id long, piece int, start_token int, n_tokens int")


def p7_fill(spark: SparkSession, folder: str) -> DataFrame:
    """Containers used, tokens and the share of space filled, with the fewest containers that the tokens could need."""
    g = p7_packed(spark, folder).where("bin_id is not null").groupBy("size_name", "capacity_tokens").agg(F.count_distinct("bin_id").alias("n_bins"), F.sum("n_tokens").alias("n_tokens"))
    return g.withColumn("fill", F.col("n_tokens") / (F.col("n_bins") * F.col("capacity_tokens"))).withColumn("least_bins", F.ceil(F.col("n_tokens") / F.col("capacity_tokens")))


def _mixed(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").where("source is not null and text is not null")
    return mixed(docs.select("doc_id", "source", F.md5(F.trim("text")).alias("text_key"), token_count(F.col("text")).alias("n_tokens")), table(spark, folder, "mix_targets"))


def p8_mixed(spark: SparkSession, folder: str) -> DataFrame:
    """The documents drawn for each source, with repeats."""
    return _mixed(spark, folder)


def p8_shares(spark: SparkSession, folder: str) -> DataFrame:
    """The share of all tokens that each source reaches, beside its target."""
    return shares(_mixed(spark, folder), table(spark, folder, "mix_targets"))


QUERIES = {
    "p2_percentiles": p2_percentiles, "p2_day_summaries": p2_day_summaries, "p2_combined": p2_combined, "p7_packed": p7_packed, "p7_fill": p7_fill,
    "p8_mixed": p8_mixed, "p8_shares": p8_shares, "p3_found": p3_found, "p4_found": p4_found, "p4_paragraphs": p4_paragraphs, "p4_cells": p4_cells, "p5_found": p5_found, "p5_redacted": p5_redacted, "p6_found": p6_found, "p9_found": p9_found, "p9_composition": p9_composition}
_RANKED = """
with t as (select distinct doc, worker_id, doc_format, cast(account_id as varchar) as account_id, strftime(ts, '%Y-%m-%d') as "day",
                  total_ms, detection_ms, recognition_ms from stage_timing),
k as (select 'worker_id' as "grouping", worker_id as grp, * from t union all select 'doc_format', doc_format, * from t
      union all select 'account_id', account_id, * from t union all select 'day', "day", * from t),
m as (select "grouping", grp, "day", 'total_ms' as measure, total_ms as v from k union all select "grouping", grp, "day", 'detection_ms', detection_ms from k
      union all select "grouping", grp, "day", 'recognition_ms', recognition_ms from k),
ok as (select * from m where v is not null and not isnan(v) and v >= 0),
r as (select "grouping", grp, "day", measure, v, row_number() over (partition by "grouping", grp, measure order by v) as i,
             count(*) over (partition by "grouping", grp, measure) as n from ok)
"""
_PICKED = """select "grouping", grp, measure, n,
       cast(max(case when i = greatest(1, ceil(round(n * 0.5, 9))) then v end) as double) as p50, cast(max(case when i = greatest(1, ceil(round(n * 0.9, 9))) then v end) as double) as p90,
       cast(max(case when i = greatest(1, ceil(round(n * 0.95, 9))) then v end) as double) as p95, cast(max(case when i = greatest(1, ceil(round(n * 0.99, 9))) then v end) as double) as p99,
       cast(0 as bigint) as max_rank_error
from r"""
SQL: dict[str, str] = {
    "p2_percentiles": f"{_RANKED} {_PICKED} group by all",
    # at the size of the check a day's summary holds every value, so the summaries and what is combined of them are exact
    "p2_combined": f"""{_RANKED} {_PICKED} where "grouping" <> 'day' group by all""",
    "p2_day_summaries": _RANKED.replace('partition by "grouping", grp, measure', 'partition by "grouping", grp, measure, "day"') + """ select "grouping", grp, measure, "day", n, cast(0 as bigint) as max_rank_error, i as rank, cast(v as double) as slice_end from r where "grouping" <> 'day'""",
}
