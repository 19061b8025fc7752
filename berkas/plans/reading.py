"""Queries on layout, geometry, decoding and results of reading, with SQL to check them by."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from berkas.config import ERRORS, error_text, language_of, languages
from berkas.engine import Engine
from berkas.functions import geometry as geo
from berkas.functions.text import normalized
from berkas.operators import dedup, export, layout, metrics, nms, pages, recognition, results, tables, vision
from berkas.sources import files
from berkas.sources.tables import table

PAGE = ["doc", "page"]


def words(spark: SparkSession, folder: str) -> DataFrame:
    """Recognised regions of scanned pages, a record delivered twice counted once."""
    t = table(spark, folder, "ocr_text").where("text is not null")
    return t.select("doc", "page", "idx", "text", F.round("conf", 4).alias("conf"), *[F.round(c).alias(c) for c in ("min_x", "min_y", "max_x", "max_y")]).distinct()


_WORDS = """w as (select distinct doc, page, idx, text, round(conf, 4) as conf, round(min_x) as min_x, round(min_y) as min_y, round(max_x) as max_x, round(max_y) as max_y
from ocr_text where text is not null)"""

#: grouped lines in SQL, for several queries
_GROUPED = f"""{_WORDS}, l as (select *, case when abs(min_y - lag(min_y) over p) > greatest(max_y - min_y, 1) * 0.5 then 1 else 0 end as nl from w window p as (partition by doc, page order by idx)),
g as (select *, cast(sum(nl) over (partition by doc, page order by idx rows unbounded preceding) + 1 as integer) as line_no from l)"""
_LINES = f"""{_GROUPED}, ln as (select doc, page, line_no, string_agg(text, ' ' order by idx) as text, avg(conf) as conf, min(min_x) as min_x, min(min_y) as min_y, max(max_x) as max_x,
max(max_y) as max_y, count(*) as n_words from g group by all)"""


def group_lines(spark: SparkSession, folder: str) -> DataFrame:
    return layout.grouped_lines(words(spark, folder), PAGE).select("doc", "page", "idx", "line_no")


def line_agg(spark: SparkSession, folder: str) -> DataFrame:
    return layout.line_table(layout.grouped_lines(words(spark, folder), PAGE), PAGE).withColumn("conf", F.round("conf", 6))


def page_text(spark: SparkSession, folder: str) -> DataFrame:
    w = words(spark, folder)
    t = layout.page_text(layout.line_table(layout.grouped_lines(w, PAGE), PAGE), PAGE)
    return t.join(layout.page_confidence(w, PAGE), PAGE).withColumn("confidence", F.round("confidence", 6))


def cells(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "table_cells").select("cell_id", "doc", "row_no", "col_no", "text", "confidence").distinct()


def cell_boxes(spark: SparkSession, folder: str) -> DataFrame:
    """Table cells as boxes on a page, uneven in place, width and height."""
    c = cells(spark, folder).withColumn("idx", F.col("cell_id").cast("int")).withColumn("k", F.col("cell_id") % 7)
    x, y = (F.col("col_no") * 120 + F.col("k") * 3).cast("double"), (F.col("row_no") * 26 + F.col("k") * 2).cast("double")
    return c.select("doc", "idx", "text", x.alias("min_x"), y.alias("min_y"), (x + 40 + F.col("cell_id") % 90).alias("max_x"), (y + 10 + F.col("cell_id") % 13).alias("max_y"), F.col("confidence").alias("conf"))


_CELL_BOXES = """c as (select distinct cell_id, doc, row_no, col_no, text, confidence from table_cells),
b as (select doc, cast(cell_id as integer) as idx, text, confidence as conf, cast(col_no * 120 + (cell_id % 7) * 3 as double) as min_x, cast(row_no * 26 + (cell_id % 7) * 2 as double) as min_y,
cast(col_no * 120 + (cell_id % 7) * 3 + 40 + cell_id % 90 as double) as max_x, cast(row_no * 26 + (cell_id % 7) * 2 + 10 + cell_id % 13 as double) as max_y from c)"""


def reading_columns(spark: SparkSession, folder: str) -> DataFrame:
    return layout.reading_columns(cell_boxes(spark, folder), ["doc"]).select("doc", "idx", "two_column", "side", "pos")


def sorted_lines(spark: SparkSession, folder: str) -> DataFrame:
    return layout.sorted_lines(cell_boxes(spark, folder), ["doc"])


def table_from_boxes(spark: SparkSession, folder: str) -> DataFrame:
    return tables.reconstructed(cell_boxes(spark, folder), ["doc"])


def order_boxes(spark: SparkSession, folder: str) -> DataFrame:
    """Boxes from order lines, a handful an image, many overlapping."""
    x = (F.col("l_partkey") % 60).cast("double")
    y = (F.col("l_suppkey") % 40).cast("double")
    li = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_discount")
    # line numbers come more than once in an order
    li = li.withColumn("i", F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_discount")))
    w = 20 + F.col("l_quantity")
    return li.select(F.col("l_orderkey").alias("img"), F.col("i").alias("idx"), geo.box(x, y, x + w, y + 30).alias("b"), ((100 - 5 * F.round(F.col("l_discount") * 100)) / 100).alias("conf"))


_BOXES = """b as (select l_orderkey as img, cast(row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity, l_discount) as integer) as idx, cast(l_partkey % 60 as double) as x0, cast(l_suppkey % 40 as double) as y0, l_partkey % 60 + 20 + l_quantity as x1,
cast(l_suppkey % 40 + 30 as double) as y1, (100 - 5 * round(l_discount * 100)) / 100 as conf from lineitem)"""
_IOU = "greatest(least({a}.x1, {b}.x1) - greatest({a}.x0, {b}.x0), 0) * greatest(least({a}.y1, {b}.y1) - greatest({a}.y0, {b}.y0), 0)"


def iou_pairs(spark: SparkSession, folder: str) -> DataFrame:
    return nms.overlapping_pairs(order_boxes(spark, folder), ["img"]).withColumn("iou", F.round("iou", 6))


def nms_boxes(spark: SparkSession, folder: str) -> DataFrame:
    return nms.kept_boxes(order_boxes(spark, folder), ["img"])


def polygons(spark: SparkSession, folder: str) -> DataFrame:
    """Regions of pages as four corners, tilted a little."""
    w = words(spark, folder).withColumn("d", F.col("idx") % 7 - 3)
    pt = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    d = F.col("d")
    return w.select("doc", "page", "idx", "min_x", "min_y", "max_x", "max_y", F.array(pt(F.col("min_x"), F.col("min_y")), pt(F.col("max_x"), F.col("min_y") + d), pt(F.col("max_x"), F.col("max_y") + d), pt(F.col("min_x"), F.col("max_y"))).alias("polygon"))


def polygon_measures(spark: SparkSession, folder: str) -> DataFrame:
    p = polygons(spark, folder)
    r = lambda c: F.round(c, 4)
    return p.select("doc", "page", "idx", r(geo.polygon_area(F.col("polygon"))).alias("area"), r(geo.polygon_perimeter(F.col("polygon"))).alias("perimeter"), r(geo.unclip_distance(F.col("polygon"))).alias("unclip"), geo.aabb(F.col("polygon"))["max_y"].alias("aabb_max_y"))


def skew_angle(spark: SparkSession, folder: str) -> DataFrame:
    p = polygons(spark, folder).withColumn("a", geo.skew_degrees(F.col("polygon")))
    return p.groupBy("doc", "page").agg(F.round(F.coalesce(F.avg("a"), F.lit(0.0)), 6).alias("skew"), F.count("a").alias("n_edges"))


def crop_boxes(spark: SparkSession, folder: str) -> DataFrame:
    p = polygons(spark, folder)
    c = geo.padded_crop(geo.box("min_x", "min_y", "max_x", "max_y"), F.lit(800.0), F.lit(1800.0))
    q = geo.quad_crop_size(F.col("polygon"))
    return p.select("doc", "page", "idx", c["x"].alias("x"), c["y"].alias("y"), c["w"].alias("w"), c["h"].alias("h"), q["w"].alias("quad_w"), q["h"].alias("quad_h"))


def input_sizes(spark: SparkSession, folder: str) -> DataFrame:
    p = table(spark, folder, "part").select("p_partkey", (F.col("p_partkey") % 2000 + 1).cast("double").alias("w"), (F.col("p_size") * 37 + 5).cast("double").alias("h"))
    s = geo.detection_size(F.col("w"), F.col("h"))
    return p.select("p_partkey", s["w"].alias("det_w"), s["h"].alias("det_h"), s["scale_x"].alias("scale_x"), geo.recognition_width(F.col("w"), F.col("h")).alias("rec_w"))


def rec_batches(spark: SparkSession, folder: str) -> DataFrame:
    w = words(spark, folder).select("doc", "page", "idx", geo.recognition_width(F.col("max_x") - F.col("min_x"), F.greatest(F.col("max_y") - F.col("min_y"), F.lit(1.0))).alias("target_w"))
    b = recognition.width_batches(w, PAGE)
    return b.withColumn("steps", geo.sequence_length(F.col("target_w"), F.col("batch_w"), F.lit(40)))


ALPHABET = [chr(97 + i) for i in range(26)]


def ctc_steps(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "embeddings")
    p = F.col("embedding")
    return e.select((F.col("vec_id") / 20).cast("int").alias("crop"), (F.col("vec_id") % 20).cast("int").alias("t"), (recognition.step_class(p) % 31).alias("cls"), recognition.step_confidence(p).alias("p"))


def ctc_argmax(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "embeddings")
    scaled = F.transform("embedding", lambda v: v.cast("double") * 100)
    return e.select("vec_id", recognition.step_class(F.col("embedding")).alias("cls"), F.round(recognition.step_confidence(F.col("embedding")), 5).alias("p"), F.round(recognition.step_confidence(scaled), 5).alias("p_softmax"))


def ctc_decode(spark: SparkSession, folder: str) -> DataFrame:
    return recognition.greedy_text(ctc_steps(spark, folder), ["crop"], ALPHABET).withColumn("conf", F.round("conf", 5))


def second_pass_merge(spark: SparkSession, folder: str) -> DataFrame:
    w = words(spark, folder).select("doc", "page", "idx", "text", "conf")
    again = w.select("doc", "page", "idx", F.when(F.length("text") % 2 == 0, "").otherwise(F.upper("text")).alias("re_text"), (1 - F.col("conf") / 2).alias("re_conf"))
    return recognition.second_pass(w, again, [*PAGE, "idx"], below=0.9)


def legible_regions(spark: SparkSession, folder: str) -> DataFrame:
    return recognition.legible(words(spark, folder), 0.8).groupBy("doc").agg(F.count("*").alias("n"))


def filter_confidence(spark: SparkSession, folder: str) -> DataFrame:
    w = words(spark, folder)
    ln = layout.line_table(layout.grouped_lines(w, PAGE), PAGE)
    return results.by_confidence(w, ln, PAGE, 0.9).withColumn("confidence", F.round("confidence", 9))


def search_regions(spark: SparkSession, folder: str) -> DataFrame:
    return words(spark, folder).where(results.found(F.col("text"), "Catatan")).select("doc", "page", "idx", "text")


def batch_summary(spark: SparkSession, folder: str) -> DataFrame:
    t = table(spark, folder, "stage_timing").select("doc", "doc_format", "total_ms").distinct()
    ok = F.coalesce((F.col("total_ms") >= 0) & ~F.isnan("total_ms"), F.lit(False))
    return results.batch_summary(t.select(F.coalesce("doc_format", F.lit("unknown")).alias("doc_format"), ok.alias("success"), F.when(ok, F.floor(F.col("total_ms").cast("double"))).otherwise(0).cast("long").alias("duration_ms")), ["doc_format"])


#: lines that stand for the text that the file itself holds; every line is also one that was read from the scan
NATIVE = "conf >= 0.95"


def dedup_native_ocr(spark: SparkSession, folder: str) -> DataFrame:
    w = words(spark, folder)
    native = w.where(NATIVE).select("doc", "page", normalized(F.col("text")).alias("native")).where("native <> ''").distinct()
    return dedup.new_text(w.select("doc", "page", "idx", "text", "conf"), native, PAGE).select("doc", "page", "idx", "text")


def _pages(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    w = words(spark, folder)
    own = w.groupBy("doc", "page").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.expr(NATIVE), F.struct("idx", "text")))), lambda x: x["text"]), "\n").alias("native_text"))
    kind = F.pmod(F.col("doc") / 2 + F.col("page"), F.lit(4)).cast("int")
    p = own.withColumn("kind", kind).select(
        "doc", "page", F.when(F.col("kind") < 2, F.col("native_text")).otherwise("-").alias("native_text"), F.when(F.col("kind").isin(1, 2), 1).otherwise(0).alias("n_images"),
        F.when(F.col("kind") == 3, F.concat(F.lit("page "), F.col("page").cast("string"))).alias("rendered_text"), F.when(F.col("kind") == 3, 0.5).alias("rendered_conf"), F.lit(700).alias("rendered_width"), F.lit(900).alias("rendered_height"),
    )
    ocr = w.join(p.where("n_images > 0").select("doc", "page"), PAGE).select("doc", "page", "idx", "text", "conf")
    return p, ocr


def page_routing(spark: SparkSession, folder: str) -> DataFrame:
    p, ocr = _pages(spark, folder)
    return pages.routed_pages(p, ocr, PAGE).withColumn("confidence", F.round("confidence", 9))


def pdf_document(spark: SparkSession, folder: str) -> DataFrame:
    p, ocr = _pages(spark, folder)
    routed = pages.routed_pages(p, ocr, PAGE).withColumnRenamed("page", "page_number")
    return pages.document(routed, ["doc"]).withColumn("confidence", F.round("confidence", 6))


def batch_texts(spark: SparkSession, folder: str) -> DataFrame:
    """The texts of the documents of a batch that were read, in order."""
    d = table(spark, folder, "documents").select("doc_id", "text", (F.length("text") > 0).alias("success"))
    return results.batch_texts(d, "doc_id")


def hash_cache(spark: SparkSession, folder: str) -> DataFrame:
    d = table(spark, folder, "documents").where("text is not null").select("doc_id", "text")
    return dedup.scored_once(d, "text", lambda once: once.withColumn("n_chars_scored", F.length("text").cast("long")), ["n_chars_scored"]).select("doc_id", "n_chars_scored", "key")


def char_error(spark: SparkSession, folder: str) -> DataFrame:
    return _line_pairs(spark, folder).select("doc", "page", "idx", metrics.edit_distance(F.col("ref"), F.col("hyp")).alias("distance"), F.round(metrics.character_error(F.col("ref"), F.col("hyp")), 6).alias("cer"))


def _line_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Each line with the next one of its page, other letters than ASCII replaced."""
    plain = F.regexp_replace("text", r"[^\x20-\x7E]", "?")
    w = words(spark, folder).select("doc", "page", "idx", plain.alias("t"))
    return w.select("doc", "page", "idx", F.col("t").alias("ref")).join(w.select("doc", "page", (F.col("idx") - 1).alias("idx"), F.col("t").alias("hyp")), [*PAGE, "idx"])


def word_error(spark: SparkSession, folder: str) -> DataFrame:
    return _line_pairs(spark, folder).select("doc", "page", "idx", F.round(metrics.word_error(F.col("ref"), F.col("hyp")), 6).alias("wer"))


def percentiles(spark: SparkSession, folder: str) -> DataFrame:
    t = table(spark, folder, "stage_timing").select("doc", "worker_id", "total_ms").distinct().where("total_ms >= 0")
    return metrics.nearest_rank(t, ["worker_id"], "total_ms").withColumn("mean", F.round("mean", 3))


def timing_summary(spark: SparkSession, folder: str) -> DataFrame:
    t = table(spark, folder, "stage_timing").select("doc", *metrics.STAGES).distinct()
    # tenths of milliseconds, which no engine has to round for printing
    tenths = t.select("doc", *[F.when(F.isnan(c) | F.col(c).isNull(), 0.0).otherwise(F.floor(F.col(c).cast("double") * 10) / 10).cast("double").alias(c) for c in metrics.STAGES])
    return tenths.select("doc", metrics.timing_summary().alias("summary"))


HEADS = ["25504446", "89504E470D0A1A0A", "FFD8FFE0", "524946460000000057454250", "5249464600000000574542", "424D0000", "49492A00", "4D4D002A", "504B0304", "4944", ""]


def sniff_format(spark: SparkSession, folder: str) -> DataFrame:
    p = table(spark, folder, "part").select("p_partkey")
    h = F.element_at(F.array(*[F.lit(x) for x in HEADS]), (F.col("p_partkey") % len(HEADS) + 1).cast("int"))
    x = p.withColumn("head", h).withColumn("format", files.sniffed(F.unhex("head")))
    return x.select("p_partkey", "head", "format", files.supported(F.col("format")).alias("supported"), files.mime_type(F.col("format")).alias("mime"))


ENDINGS = ["scan.PNG", "a.b/scan.jpeg", "page.tif", "letter.docx", "noending", "x.pdf", "photo.WebP", "list.csv"]


def path_checks(spark: SparkSession, folder: str) -> DataFrame:
    p = table(spark, folder, "part").select("p_partkey", "p_size")
    path = F.concat(F.lit("in/"), F.col("p_partkey").cast("string"), F.lit("_"), F.element_at(F.array(*[F.lit(x) for x in ENDINGS]), (F.col("p_partkey") % len(ENDINGS) + 1).cast("int")))
    f = p.select("p_partkey", path.alias("path"), (F.col("p_partkey") * 30_000).cast("long").alias("length"), ((F.col("p_partkey") % 7) * 800).cast("int").alias("width"), (F.col("p_size") * 100).cast("int").alias("height"), F.col("p_size").cast("int").alias("pages"))
    g = files.guarded(f)
    return g.select("p_partkey", files.extension(F.col("path")).alias("extension"), files.extension_accepted(F.col("path")).alias("accepted"), files.kind_of_source(F.concat(F.when(F.col("p_partkey") % 3 == 0, " https://x.test/").otherwise(""), F.col("path"))).alias("kind"), "error")


def supported_formats(spark: SparkSession, folder: str) -> DataFrame:
    return files.formats(spark)


def language_list(spark: SparkSession, folder: str) -> DataFrame:
    return languages(spark)


def language_codes(spark: SparkSession, folder: str) -> DataFrame:
    d = table(spark, folder, "documents").groupBy("lang").agg(F.count("*").alias("n"))
    return d.select("lang", language_of(F.col("lang")).alias("language"), "n")


def error_messages(spark: SparkSession, folder: str) -> DataFrame:
    kinds = sorted(ERRORS)
    n = table(spark, folder, "nation").select("n_nationkey", "n_name")
    out = F.lit(None).cast("string")
    for i, k in enumerate(kinds):
        msg = error_text(k, F.col("n_name"), files.SUPPORTED) if k == "UnsupportedFormat" else error_text(k, F.col("n_name"))
        out = F.when(F.col("n_nationkey") % len(kinds) == i, msg).otherwise(out)
    return n.select("n_nationkey", out.alias("message"))


def confidence_bands(spark: SparkSession, folder: str) -> DataFrame:
    return words(spark, folder).groupBy(geo.confidence_band(F.col("conf")).alias("band")).agg(F.count("*").alias("n"))


def pixel_variance(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "embeddings").select("vec_id", F.explode("embedding").alias("v"))
    px = F.pmod(F.round(F.col("v").cast("double") * 1000), F.lit(256.0))
    px = px.cast("long")
    # whole sums, as of a grey image: n * sum of squares - square of the sum
    g = e.groupBy("vec_id").agg(F.count("*").alias("n"), F.sum(px).alias("s"), F.sum(px * px).alias("q"))
    return g.select("vec_id", (F.col("n") * F.col("q") - F.col("s") * F.col("s")).alias("n2_variance"), ((F.col("n") * F.col("q") - F.col("s") * F.col("s")) < 500 * F.col("n") * F.col("n")).alias("enhance"))


def _grids(spark: SparkSession, folder: str) -> DataFrame:
    """Grey images of eight by eight pixels; every second one of little contrast."""
    px = F.transform("embedding", lambda v: F.pmod(F.round(v.cast("double") * 1000), F.lit(256.0)).cast("int"))
    return table(spark, folder, "embeddings").select("vec_id", F.when(F.col("vec_id") % 2 == 0, F.transform(px, lambda p: (p / 3 + 60).cast("int"))).otherwise(px).alias("pixels"))


def _pixels(df: DataFrame) -> DataFrame:
    return df.select("vec_id", F.array_join("pixels", ",").alias("pixels"))


def pixel_blur(spark: SparkSession, folder: str) -> DataFrame:
    return _pixels(vision.mapped_grids(_grids(spark, folder), "pixels", 8, vision.box_blur))


def pixel_threshold(spark: SparkSession, folder: str) -> DataFrame:
    return _pixels(vision.mapped_grids(_grids(spark, folder), "pixels", 8, vision.adaptive_threshold))


def pixel_contrast(spark: SparkSession, folder: str) -> DataFrame:
    return _pixels(vision.mapped_grids(_grids(spark, folder), "pixels", 8, lambda g: vision.luma(vision.auto_contrast(vision.coloured(g)))))


def pixel_turned(spark: SparkSession, folder: str) -> DataFrame:
    """A quarter turn, and a tilt too small to be undone."""
    return _pixels(vision.mapped_grids(_grids(spark, folder), "pixels", 8, lambda g: vision.deskewed(vision.quarter_turns(g, 1)[..., None], 0.4)[..., 0]))


def pixel_contours(spark: SparkSession, folder: str) -> DataFrame:
    """Areas of the probability map: number and border points of those that are large enough."""
    return vision.grid_contours(_grids(spark, folder), "pixels", 8, threshold=90)


def quad_crops(spark: SparkSession, folder: str) -> DataFrame:
    """The six by four pixels at column one, row two."""
    quad = [(1, 2), (7, 2), (7, 6), (1, 6)]
    return _pixels(vision.mapped_grids(_grids(spark, folder), "pixels", 8, lambda g: vision.quad_crop(g[..., None], quad)[..., 0]))


def det_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Regions of a probability map, four of sixteen pixels to a vector."""
    e = table(spark, folder, "embeddings").select("vec_id", F.posexplode("embedding").alias("i", "v"))
    px = e.select("vec_id", (F.col("i") / 16).cast("int").alias("region"), F.abs(F.col("v").cast("double")).alias("p"))
    g = recognition.region_score(px, ["vec_id", "region"], threshold=0.1, least=0.12)
    on = table(spark, folder, "embeddings").select("vec_id", F.size(F.filter(recognition.binarised(F.transform("embedding", lambda v: F.abs(v.cast("double"))), 0.1), lambda b: b)).alias("n_on"))
    return g.join(on, "vec_id").select("vec_id", "region", F.round("score", 6).alias("score"), "n_on")


def moment_angles(spark: SparkSession, folder: str) -> DataFrame:
    """Main axis and turned box of the cells of each table as points."""
    c = cell_boxes(spark, folder)
    g = c.groupBy("doc").agg(F.sort_array(F.collect_list(F.struct((F.col("min_x") + F.col("idx") % 5).alias("x"), F.col("min_y").alias("y")))).alias("pts"))
    box = geo.oriented_box(F.col("pts"), F.lit(2.0), F.lit(900.0), F.lit(900.0), F.lit(1.5), F.lit(2.0))
    return g.select("doc", F.round(F.degrees(geo.moment_angle(F.col("pts"))), 4).alias("angle"), F.round(box[0]["x"], 3).alias("x0"), F.round(box[2]["y"], 3).alias("y2"))


def pdf_page(spark: SparkSession, folder: str) -> DataFrame:
    p, ocr = _pages(spark, folder)
    return results.page(pages.routed_pages(p, ocr, PAGE).withColumnRenamed("page", "page_number"), 2).select("doc", "source", "text")


def export_tsv(spark: SparkSession, folder: str) -> DataFrame:
    w = layout.grouped_lines(words(spark, folder), PAGE)
    return export.tsv(w.withColumn("conf", F.round("conf", 2)), PAGE)


def export_hocr(spark: SparkSession, folder: str) -> DataFrame:
    w = layout.grouped_lines(words(spark, folder), PAGE)
    p = w.groupBy(*PAGE).agg(F.max("max_x").alias("width"), F.max("max_y").alias("height"))
    return export.hocr(w.withColumn("conf", F.round("conf", 2)), p, PAGE)


def export_table_csv(spark: SparkSession, folder: str) -> DataFrame:
    return tables.matrix(cells(spark, folder), ["doc"]).select("doc", tables.csv_text(F.col("rows")).alias("csv"))


def export_table_markdown(spark: SparkSession, folder: str) -> DataFrame:
    return tables.matrix(cells(spark, folder), ["doc"]).select("doc", tables.markdown_text(F.col("rows")).alias("markdown"))


def export_table_json(spark: SparkSession, folder: str) -> DataFrame:
    return tables.table_json(cells(spark, folder).withColumn("confidence", F.round("confidence", 2)), ["doc"])


def export_line_json(spark: SparkSession, folder: str) -> DataFrame:
    ln = layout.line_table(layout.grouped_lines(words(spark, folder), PAGE), PAGE)
    return ln.select("doc", "page", "line_no", export.as_json("line_no", "text", "n_words").alias("json"))


def export_result_json(spark: SparkSession, folder: str) -> DataFrame:
    """Whole results as JSON, read again."""
    j = export.document_json(layout.grouped_lines(words(spark, folder), PAGE), PAGE)
    at = lambda path: F.get_json_object("json", path)
    return j.select("doc", "page", at("$.text").alias("text"), F.round(at("$.confidence").cast("double"), 6).alias("confidence"), F.json_array_length(at("$.lines")).alias("n_lines"), F.json_array_length(at("$.regions")).alias("n_regions"),
                    at("$.lines[0].text").alias("first_line"), at("$.regions[0].bbox.max_x").cast("double").alias("first_max_x"), at("$.regions[0].line_number").cast("int").alias("first_line_no"))


def _pictures(spark: SparkSession, folder: str) -> DataFrame:
    """Pictures of 96 by 64 pixels, each with a bar of one of three colours in one of four places; every fifth is blank, every
    seventh has no pixels."""

    @F.pandas_udf("binary")
    def drawn(ids: pd.Series) -> pd.Series:
        out = []
        for i in ids:
            if i % 7 == 0:
                out.append(None)
                continue
            px = np.full((64, 96, 3), 250, np.uint8)
            if i % 5:
                x, y = 10 + 20 * (i % 2), 10 + 24 * (i // 2 % 2)
                px[y : y + 14, x : x + 50] = 20
                px[y : y + 14, x : x + 50, 2 - i % 3] = 220
            out.append(px.tobytes())
        return pd.Series(out, dtype=object)

    e = table(spark, folder, "embeddings").select("vec_id")
    return e.select("vec_id", F.lit(64).alias("height"), F.lit(96).alias("width"), drawn("vec_id").alias("data"))


def recognise_images(spark: SparkSession, folder: str) -> DataFrame:
    """The way from pixels to text with stand-in models: to the detector coloured pixels are text, and the recogniser names
    the colour. A picture without pixels has an error and the others go on."""

    def detector(tensor):
        rgb = tensor[0].transpose(1, 2, 0) * vision.DEVIATION + vision.MEAN
        return np.where(rgb.max(2) - rgb.min(2) > 0.3, 0.9, 0.0)

    def recogniser(crops):
        out = []
        for c in crops:
            px = c.reshape(-1, 3).astype(int)
            out.append((["merah", "hijau", "biru"][px[(px.max(1) - px.min(1)).argmax()].argmax()], 0.9))
        return out

    found = Engine(spark, recogniser=recogniser, detector=detector).recognise(_pictures(spark, folder))
    return found.select("vec_id", F.size("regions").alias("n_regions"), F.array_join(F.transform("regions", lambda r: r["text"]), " ").alias("text"), "error")


def export_text_layer(spark: SparkSession, folder: str) -> DataFrame:
    ln = layout.line_table(layout.grouped_lines(words(spark, folder), PAGE), PAGE)
    p = ln.groupBy(*PAGE).agg(F.max("max_x").alias("width"), F.max("max_y").alias("height"))
    return export.text_layer(ln, p, PAGE)


QUERIES = {
    f.__name__: f
    for f in (
        page_text, group_lines, line_agg, reading_columns, sorted_lines, table_from_boxes, iou_pairs, nms_boxes, polygon_measures, skew_angle, crop_boxes, input_sizes, rec_batches, ctc_argmax, ctc_decode,
        second_pass_merge, legible_regions, filter_confidence, search_regions, batch_summary, dedup_native_ocr, page_routing, pdf_document, hash_cache, char_error, word_error, percentiles, timing_summary,
        sniff_format, path_checks, supported_formats, language_list, language_codes, error_messages, confidence_bands, pixel_variance, pixel_blur, pixel_threshold, pixel_contrast, pixel_turned, pixel_contours, quad_crops, batch_texts, det_scores, moment_angles, pdf_page, export_tsv, export_hocr, export_table_csv, export_table_markdown,
        export_table_json, export_line_json, export_result_json, export_text_layer, recognise_images,
    )
}

_Q = "'"
_norm = "lower(trim(regexp_replace({}, '\\s+', ' ', 'g')))"
_PLAIN = "regexp_replace(text, '[^\\x20-\\x7E]', '?', 'g')"
_HELD = "(nl = t or (strlen(nl) > 5 and strlen(t) > 5 and (contains(nl, t) or contains(t, nl))))"
_ROUTE = f"""with {_WORDS},
own as (select doc, page, coalesce(string_agg(text, chr(10) order by idx) filter (where conf >= 0.95), '') as own, cast((doc / 2.0 + page) as bigint) % 4 as kind from w group by doc, page),
p as (select doc, page, kind, case when kind < 2 then own else '-' end as native_text, kind in (1, 2) as imaged from own),
o as (select w.doc, w.page, idx, text, conf, {_norm.format('text')} as t from w join p on w.doc = p.doc and w.page = p.page and imaged),
n as (select doc, page, {_norm.format('unnest(string_split(native_text, chr(10)))')} as nl from p where native_text is not null),
kept as (select * from o where t <> '' and not exists (select 1 from n where n.doc = o.doc and n.page = o.page and nl <> '' and {_HELD})),
k as (select doc, page, string_agg(text, chr(10) order by idx) as appended, count(*) as n_kept, avg(conf) as ck from kept group by doc, page),
e as (select doc, page, string_agg(case when text <> '' then text end, chr(10) order by idx) as text_all, count(*) as n_all, avg(conf) as ca from o group by doc, page),
r as (select p.doc, p.page, kind, native_text, appended, n_kept, ck, text_all, n_all, ca, regexp_matches(native_text, '[\\p{{L}}\\p{{N}}]') as usable, imaged, kind = 3 as rendered from p left join k on p.doc = k.doc and p.page = k.page left join e on p.doc = e.doc and p.page = e.page),
x as (select doc, page, case when usable and imaged and n_kept > 0 then 'mixed' when not usable and (rendered or imaged) then 'ocr' else 'native_text' end as source,
case when usable and imaged and n_kept > 0 then trim(native_text) || chr(10) || appended when not usable and rendered then 'page ' || page when not usable and imaged then coalesce(text_all, '') when usable then trim(native_text) else '' end as text,
case when usable and imaged and n_kept > 0 then ck when not usable and rendered then 0.5 when not usable and imaged then coalesce(ca, 0) else 1.0 end as confidence,
case when usable and imaged and n_kept > 0 then n_kept when not usable and rendered then null when not usable and imaged then coalesce(n_all, 0) else 0 end as n_regions,
case when not usable and rendered then 700 else 1024 end as width, case when not usable and rendered then 900 else 1448 end as height from r)"""
_MAT = """c as (select distinct cell_id, doc, row_no, col_no, coalesce(text, '') as text, confidence from table_cells)"""


def _fold_sql(order: str, test: str, extra: str = "") -> str:
    """A recursive query that assigns boxes, in order, to the first group whose first box passes a test."""
    return f"""with recursive {_CELL_BOXES}{extra}, s as (select *, row_number() over (partition by doc order by {order}, idx) as rn from b),
f as (select doc, rn, idx, min_x, max_x, [{{'y0': min_y, 'y1': max_y}}] as an, 0 as g from s where rn = 1
union all
select s.doc, s.rn, s.idx, s.min_x, s.max_x, case when h > 0 then an else list_append(an, {{'y0': s.min_y, 'y1': s.max_y}}) end, case when h > 0 then h - 1 else len(an) end
from (select f.doc, f.rn, f.an, coalesce(list_position(list_transform(f.an, lambda a: {test}), true), 0) as h from f join s on f.doc = s.doc and s.rn = f.rn + 1) q
join s on s.doc = q.doc and s.rn = q.rn + 1),
fin as (select doc, an from f qualify row_number() over (partition by doc order by rn desc) = 1)"""


_GRID = """g0 as (select vec_id, unnest(embedding) as v, generate_subscripts(embedding, 1) - 1 as i from embeddings),
g as (select vec_id, i % 8 as x, i // 8 as y, case when vec_id % 2 = 0 then cast(trunc(p / 3.0 + 60) as integer) else p end as p from (select vec_id, i, cast(((round(cast(v as double) * 1000) % 256) + 256) % 256 as integer) as p from g0)),
n as (select a.vec_id, a.x, a.y, a.p, b.p as q from g a join (select unnest([-1, 0, 1]) as dx) on true join (select unnest([-1, 0, 1]) as dy) on true join g b on b.vec_id = a.vec_id and b.x = least(greatest(a.x + dx, 0), 7) and b.y = least(greatest(a.y + dy, 0), 7)),
f as (select vec_id, x, y, any_value(p) as p, cast(sum(q) as integer) // 9 as blur from n group by vec_id, x, y)"""
_OVER = "(least(a.y1, s.max_y) - greatest(a.y0, s.min_y) > 0 and (least(a.y1, s.max_y) - greatest(a.y0, s.min_y)) / least(greatest(a.y1 - a.y0, 1), greatest(s.max_y - s.min_y, 1)) >= 0.5)"
SQL = {
    "group_lines": f"with {_GROUPED} select doc, page, idx, line_no from g",
    "line_agg": f"with {_LINES} select doc, page, line_no, text, round(conf, 6) as conf, min_x, min_y, max_x, max_y, n_words from ln",
    "page_text": f"with {_LINES} select t.doc, t.page, text, n_lines, confidence from (select doc, page, string_agg(text, chr(10) order by line_no) as text, count(*) as n_lines from ln group by all) t join (select doc, page, round(coalesce(avg(conf), 0), 6) as confidence from w group by all) c on t.doc = c.doc and t.page = c.page",
    "reading_columns": f"""with {_CELL_BOXES}, m as (select *, min(min_x) over p as lo, greatest(max(max_x) over p - min(min_x) over p, 1) as wd, avg(greatest(max_y - min_y, 1)) over p as ah, count(*) over p as n from b window p as (partition by doc)),
s as (select *, case when max_x < lo + wd / 2 - greatest(wd * 0.05, ah * 0.5) then 'left' when min_x > lo + wd / 2 + greatest(wd * 0.05, ah * 0.5) then 'right' else 'spanning' end as side from m),
t as (select *, count(*) filter (where side = 'left') over p >= 3 and count(*) filter (where side = 'right') over p >= 3 and count(*) filter (where side = 'spanning') over p / n < 0.2 as two_column from s window p as (partition by doc))
select doc, idx, two_column, side, cast(row_number() over (partition by doc order by case when two_column and side = 'right' then 1 else 0 end, idx) as integer) as pos from t where not two_column or side <> 'spanning'""",
    "sorted_lines": _fold_sql("min_y", _OVER) + """, y as (select f.doc, f.idx, f.g, f.min_x, f.rn, (fin.an[f.g + 1].y0 + fin.an[f.g + 1].y1) / 2 as cy from f join fin on f.doc = fin.doc)
select doc, idx, cast(dense_rank() over (partition by doc order by cy, g) as integer) as line_no, cast(row_number() over (partition by doc order by cy, g, min_x, rn) as integer) as pos from y""",
    "table_from_boxes": _fold_sql("(min_y + max_y) / 2", "abs((a.y0 + a.y1) / 2 - (s.min_y + s.max_y) / 2) < s.tol", "").replace("s as (select *, row_number()", "s as (select *, greatest(avg(max_y - min_y) over (partition by doc) * 0.6, 8) as tol, row_number()")
    + " select doc, idx, cast(g as integer) as row_no, cast(row_number() over (partition by doc, g order by (min_x + max_x) / 2, rn) - 1 as integer) as col_no from f",
    "iou_pairs": f"""with {_BOXES}, p as (select a.img, a.idx as idx_a, c.idx as idx_b, {_IOU.format(a='a', b='c')} as i, (a.x1 - a.x0) * (a.y1 - a.y0) as aa, (c.x1 - c.x0) * (c.y1 - c.y0) as ac from b a join b c on a.img = c.img and a.idx < c.idx)
select img, idx_a, idx_b, round(i / (aa + ac - i), 6) as iou from p where i > 0""",
    "nms_boxes": f"""with recursive {_BOXES}, s as (select *, row_number() over (partition by img order by conf desc, idx) as rn from b),
f as (select img, rn, idx, conf, [{{'x0': x0, 'y0': y0, 'x1': x1, 'y1': y1}}] as k, true as stays from s where rn = 1
union all select s.img, s.rn, s.idx, s.conf, case when q.o then k else list_append(k, {{'x0': s.x0, 'y0': s.y0, 'x1': s.x1, 'y1': s.y1}}) end, not q.o from
(select f.img, f.rn, f.k, list_bool_or(list_transform(f.k, lambda a: {_IOU.format(a='a', b='s')} / ((a.x1 - a.x0) * (a.y1 - a.y0) + (s.x1 - s.x0) * (s.y1 - s.y0) - {_IOU.format(a='a', b='s')}) > 0.4)) as o from f join s on f.img = s.img and s.rn = f.rn + 1) q
join s on s.img = q.img and s.rn = q.rn + 1)
select img, idx, conf, cast(row_number() over (partition by img order by rn) as integer) as rank from f where stays""",
    "polygon_measures": f"""with {_WORDS}, p as (select *, idx % 7 - 3 as d, max_x - min_x as ww, max_y - min_y as hh from w),
m as (select *, greatest(abs(min_x * (min_y + d) - max_x * min_y + max_x * (max_y + d) - max_x * (min_y + d) + max_x * max_y - min_x * (max_y + d) + min_x * min_y - min_x * max_y) / 2, 1) as area, greatest(2 * sqrt(ww * ww + d * d) + 2 * hh, 1) as per from p)
select doc, page, idx, round(area, 4) as area, round(per, 4) as perimeter, round(area * 1.6 / per, 4) as unclip, greatest(max_y, max_y + d, min_y + d, min_y) as aabb_max_y from m""",
    "skew_angle": f"""with {_WORDS}, a as (select doc, page, case when sqrt((max_x - min_x) ** 2 + (idx % 7 - 3) ** 2) > 20 and abs(degrees(atan2(idx % 7 - 3, max_x - min_x))) < 45 then degrees(atan2(idx % 7 - 3, max_x - min_x)) end as a from w)
select doc, page, round(coalesce(avg(a), 0), 6) as skew, count(a) as n_edges from a group by doc, page""",
    "crop_boxes": f"""with {_WORDS}, p as (select *, greatest(max_y - min_y, 1) as h0, idx % 7 - 3 as d from w),
c as (select *, cast(floor(greatest(min_x - greatest(h0 * 0.15, 3), 0)) as integer) as x, cast(floor(greatest(min_y - greatest(h0 * 0.1, 2), 0)) as integer) as y,
cast(least(ceil(max_x + greatest(h0 * 0.15, 3)), 800) as integer) as x1, cast(least(ceil(max_y + greatest(h0 * 0.1, 2)), 1800) as integer) as y1,
cast(round(sqrt((max_x - min_x) ** 2 + d ** 2)) as integer) as qw, cast(round(max_y - min_y) as integer) as qh from p)
select doc, page, idx, case when ok then x end as x, case when ok then y end as y, case when ok then x1 - x end as w, case when ok then y1 - y end as h, case when q then qw end as quad_w, case when q then qh end as quad_h
from (select *, x1 - x >= 3 and y1 - y >= 3 as ok, qw >= 3 and qh >= 3 as q from c)""",
    "input_sizes": """with p as (select p_partkey, cast(p_partkey % 2000 + 1 as double) as w, cast(p_size * 37 + 5 as double) as h from part), r as (select *, case when greatest(w, h) > 960 then 960.0 / greatest(w, h) else 1.0 end as r from p),
d as (select *, cast(greatest(round(w * r / 32) * 32, 32) as integer) as det_w, cast(greatest(round(h * r / 32) * 32, 32) as integer) as det_h from r)
select p_partkey, det_w, det_h, w / det_w as scale_x, cast(greatest(least(round(48.0 * w / h), 320), 16) as integer) as rec_w from d""",
    "rec_batches": f"""with {_WORDS}, t as (select doc, page, idx, cast(greatest(least(round(48.0 * (max_x - min_x) / greatest(max_y - min_y, 1)), 320), 16) as integer) as target_w from w),
b as (select *, cast((row_number() over (partition by doc, page order by target_w, idx) - 1) // 16 as integer) as batch from t), m as (select *, max(target_w) over (partition by doc, page, batch) as batch_w from b)
select doc, page, idx, target_w, batch, batch_w, cast(least(ceil(target_w * 1.0 / batch_w * 40) + 2, 40) as integer) as steps from m""",
    "ctc_argmax": """select vec_id, cast(list_position(embedding, list_max(embedding)) - 1 as integer) as cls, round(case when list_max(embedding) between 0 and 1 then cast(list_max(embedding) as double) else 1 / list_sum(list_transform(embedding, lambda v: exp(cast(v as double) - cast(list_max(embedding) as double)))) end, 5) as p,
round(case when list_max(embedding) * 100 between 0 and 1 then cast(list_max(embedding) as double) * 100 else 1 / list_sum(list_transform(embedding, lambda v: exp((cast(v as double) - cast(list_max(embedding) as double)) * 100))) end, 5) as p_softmax from embeddings""",
    "ctc_decode": """with s as (select vec_id // 20 as crop, vec_id % 20 as t, (list_position(embedding, list_max(embedding)) - 1) % 31 as cls, case when list_max(embedding) between 0 and 1 then cast(list_max(embedding) as double) else 1 / list_sum(list_transform(embedding, lambda v: exp(cast(v as double) - cast(list_max(embedding) as double)))) end as p from embeddings),
l as (select *, lag(cls, 1, 0) over (partition by crop order by t) as prev from s),
c as (select crop, t, p, case when cls <= 26 then chr(cast(96 + cls as integer)) else ' ' end as ch from l where cls <> prev and cls <> 0),
d as (select *, lag(ch, 1, '') over (partition by crop order by t) as before from c), k as (select * from d where not (ch = ' ' and before = ' '))
select cast(a.crop as integer) as crop, coalesce(trim(string_agg(ch, '' order by t)), '') as text, round(coalesce(avg(p), 0), 5) as conf from (select distinct crop from s) a left join k on a.crop = k.crop group by a.crop""",
    "second_pass_merge": f"""with {_WORDS}, a as (select doc, page, idx, case when length(text) % 2 = 0 then '' else upper(text) end as rt, 1 - conf / 2 as rc from w),
j as (select w.doc, w.page, w.idx, w.text, w.conf, rt, rc, coalesce(w.conf < 0.9 and rc > w.conf and rt <> '', false) as replaced from w left join a on w.doc = a.doc and w.page = a.page and w.idx = a.idx)
select doc, page, idx, case when replaced then rt else text end as text, case when replaced then rc else conf end as conf, replaced from j""",
    "legible_regions": f"with {_WORDS} select doc, count(*) as n from w where text <> '' and conf >= 0.8 group by doc",
    "filter_confidence": f"""with {_LINES}, r as (select doc, page, count(*) filter (where conf >= 0.9) as n_regions, round(coalesce(avg(conf) filter (where conf >= 0.9), 0), 9) as confidence from w group by all),
k as (select doc, page, count(*) filter (where conf >= 0.9) as n_lines, coalesce(string_agg(text, chr(10) order by line_no) filter (where conf >= 0.9), '') as text from ln group by all)
select r.doc, r.page, n_regions, n_lines, confidence, text from r join k on r.doc = k.doc and r.page = k.page""",
    "search_regions": f"with {_WORDS} select doc, page, idx, text from w where contains(lower(text), 'catatan')",
    "batch_summary": """with t as (select distinct doc, doc_format, total_ms from stage_timing), s as (select coalesce(doc_format, 'unknown') as doc_format, coalesce(total_ms >= 0 and not isnan(total_ms), false) as ok, total_ms from t)
select doc_format, count(*) as total, count(*) filter (where ok) as succeeded, count(*) filter (where not ok) as failed, cast(sum(case when ok then floor(cast(total_ms as double)) else 0 end) as bigint) as total_duration_ms, count(*) filter (where not ok) = 0 as all_succeeded from s group by doc_format""",
    "dedup_native_ocr": f"""with {_WORDS}, n as (select distinct doc, page, {_norm.format('text')} as nl from w where conf >= 0.95), o as (select doc, page, idx, text, {_norm.format('text')} as t from w)
select doc, page, idx, text from o where t <> '' and not exists (select 1 from n where n.doc = o.doc and n.page = o.page and nl <> '' and {_HELD})""",
    "page_routing": f"{_ROUTE} select doc, page, source, text, round(confidence, 9) as confidence, n_regions, width, height from x",
    "pdf_document": f"{_ROUTE} select doc, count(*) as n_pages, coalesce(string_agg(case when text <> '' then text end, chr(10) || chr(10) order by page), '') as text, round(avg(confidence), 6) as confidence from x group by doc",
    "hash_cache": "select doc_id, length(text) as n_chars_scored, sha256(text) as key from documents where text is not null",
    "batch_texts": "select doc_id, text from documents where length(text) > 0",
    "char_error": f"""with {_WORDS}, p as (select doc, page, idx, {_PLAIN} as t from w) select a.doc, a.page, a.idx, cast(levenshtein(a.t, b.t) as integer) as distance,
round(case when a.t = '' then case when b.t = '' then 0.0 else 1.0 end else least(levenshtein(a.t, b.t) / length(a.t), 1.0) end, 6) as cer from p a join p b on a.doc = b.doc and a.page = b.page and b.idx = a.idx + 1""",
    "word_error": f"""with {_WORDS}, p as (select doc, page, idx, list_filter(string_split_regex({_PLAIN}, '\\s+'), lambda x: x <> '') as t from w),
j as (select a.doc, a.page, a.idx, a.t as r, b.t as h, list_distinct(list_concat(a.t, b.t)) as u from p a join p b on a.doc = b.doc and a.page = b.page and b.idx = a.idx + 1),
s as (select doc, page, idx, len(r) as n, len(h) as m, coalesce(list_aggregate(list_transform(r, lambda x: chr(cast(34 + list_position(u, x) as integer))), 'string_agg', ''), '') as rs, coalesce(list_aggregate(list_transform(h, lambda x: chr(cast(34 + list_position(u, x) as integer))), 'string_agg', ''), '') as hs from j)
select doc, page, idx, round(case when n = 0 then case when m = 0 then 0.0 else 1.0 end else least(levenshtein(rs, hs) / n, 1.0) end, 6) as wer from s""",
    "percentiles": """with t as (select distinct doc, worker_id, total_ms from stage_timing where total_ms >= 0 and not isnan(total_ms)), g as (select worker_id, count(*) as n, list_sort(list(cast(total_ms as double))) as v from t group by worker_id)
select worker_id, n, v[1] as "min", v[cast(round(0.5 * (n - 1)) as bigint) + 1] as p50, v[cast(round(0.9 * (n - 1)) as bigint) + 1] as p90, v[cast(round(0.95 * (n - 1)) as bigint) + 1] as p95, v[cast(round(0.99 * (n - 1)) as bigint) + 1] as p99, v[n] as "max", round(list_avg(v), 3) as mean from g""",
    "timing_summary": "with t as (select distinct doc, " + ", ".join(metrics.STAGES) + " from stage_timing), z as (select doc, " + ", ".join(f"case when {c} is null or isnan({c}) then 0.0 else floor(cast({c} as double) * 10) / 10 end as {c}" for c in metrics.STAGES) + " from t) select doc, "
    + "repeat('-', 40) || chr(10) || '          STAGE TIMING BREAKDOWN        ' || chr(10) || repeat('-', 40) || chr(10) || "
    + " || ".join((f"case when {c} > 0 then " if cond else "") + f"printf('{label:<19}%8.2f ms', {c}) || chr(10)" + (" else '' end" if cond else "") for label, c, cond in (("Parsing:", "parsing_ms", 1), ("Rendering:", "rendering_ms", 1), ("Preprocessing:", "preprocessing_ms", 0), ("Detection:", "detection_ms", 0), ("Orientation:", "orientation_ms", 1), ("Recognition:", "recognition_ms", 0), ("Second Pass Re-OCR:", "second_pass_ms", 1), ("Postprocessing:", "postprocessing_ms", 0)))
    + " || repeat('-', 40) || chr(10) || printf('TOTAL:             %8.2f ms', total_ms) || chr(10) || repeat('-', 40) || chr(10) as summary from z",
    "sniff_format": f"""with p as (select p_partkey, {HEADS!r}[cast(p_partkey % {len(HEADS)} as integer) + 1] as head from part),
f as (select *, case when length(head) < 8 then 'empty_or_too_small' when head like '25504446%' then 'pdf' when head like '89504E47%' then 'png' when head like 'FFD8FF%' then 'jpeg' when head like '52494646________57454250%' then 'webp' when head like '424D%' then 'bmp' when head like '49492A00%' or head like '4D4D002A%' then 'tiff' else 'magic_bytes(' || substr(head, 1, 8) || ')' end as format from p)
select p_partkey, head, format, format in ('jpeg', 'png', 'webp', 'bmp', 'tiff', 'pdf') as supported, case when format in ('jpeg', 'png', 'webp', 'bmp', 'tiff') then 'image/' || format when format = 'pdf' then 'application/pdf' else 'application/octet-stream' end as mime from f""",
    "path_checks": f"""with p as (select p_partkey, p_size, 'in/' || p_partkey || '_' || {ENDINGS!r}[cast(p_partkey % {len(ENDINGS)} as integer) + 1] as path from part),
e as (select *, lower(regexp_extract(regexp_replace(path, '^.*/', ''), '^.+\\.([^.]*)$', 1)) as extension, p_partkey * 30000 as len, (p_partkey % 7) * 800 as wd, p_size * 100 as hg from p)
select p_partkey, extension, extension in ('', 'jpeg', 'jpg', 'png', 'webp', 'bmp', 'tiff', 'tif', 'pdf') as accepted, case when p_partkey % 3 = 0 then 'url' else 'file' end as kind,
case when extension not in ('', 'jpeg', 'jpg', 'png', 'webp', 'bmp', 'tiff', 'tif', 'pdf') then 'Unsupported file format ''' || extension || '''. Supported formats: jpeg, jpg, png, webp, bmp, tiff, tif, pdf' when len > 52428800 then 'Image too large: ' || len || ' bytes exceeds limit of 52428800'
when wd = 0 or hg = 0 then 'Invalid image: Image has zero dimensions' when wd > 4096 or hg > 4096 then 'Image too large: ' || wd || 'x' || hg || ' exceeds 4096x4096' when p_size > 50 then 'PDF too many pages: ' || p_size || ' pages exceeds limit of 50' end as error from e""",
    "supported_formats": "select cast(pos as integer) as pos, format from (values " + ", ".join(f"({i}, '{f}')" for i, f in enumerate(files.FORMATS)) + ") t(pos, format)",
    # the values that these queries must give, written out apart from the tables of berkas.config
    "language_list": """select * from (values ('id', 'Indonesian', 'Indonesian (Latin)', 'PP-OCRv6_rec_small.onnx', 18708, 'Unified PP-OCRv6 model supporting 50 languages. Optimized for Indonesian documents (KTP, SIM, NPWP, receipts, invoices).', true),
('en', 'English', 'English (Latin)', 'PP-OCRv6_rec_small.onnx', 18708, 'Unified PP-OCRv6 model supporting 50 languages. Full Latin alphabet, numbers, and punctuation support.', true),
('multi', 'Multilingual', 'Multilingual (50 Languages)', 'PP-OCRv6_rec_small.onnx', 18708, 'Unified PP-OCRv6 model supporting 50 languages with native script recognition.', true),
('ch', 'Chinese', 'Chinese (Hanzi)', 'PP-OCRv6_rec_small.onnx', 18708, 'Unified PP-OCRv6 model supporting Simplified and Traditional Chinese.', true)) t(id, name, display_name, model_name, character_count, description, auto_download)""",
    "language_codes": """select d.lang, m.language, n from (select lang, count(*) as n from documents group by lang) d left join (values ('id', 'id'), ('ind', 'id'), ('indonesia', 'id'), ('indonesian', 'id'), ('en', 'en'), ('eng', 'en'), ('english', 'en'), ('multi', 'multi'), ('multilingual', 'multi'), ('all', 'multi'), ('ch', 'ch'), ('zh', 'ch'), ('chinese', 'ch'), ('mandarin', 'ch')) m(code, language) on lower(trim(d.lang)) = m.code""",
    "error_messages": """select n_nationkey, case n_nationkey % 12
when 0 then 'Download failed: ' || n_name || ''
when 1 then 'Image too large: ' || n_name || ''
when 2 then 'Inference failed: ' || n_name || ''
when 3 then 'Invalid image: ' || n_name || ''
when 4 then 'Invalid PDF: ' || n_name || ''
when 5 then 'IO error: ' || n_name || ''
when 6 then 'Model loading failed: ' || n_name || ''
when 7 then 'Model not found: ' || n_name || ''
when 8 then 'Network error: ' || n_name || ''
when 9 then 'PDF rendering failed: ' || n_name || ''
when 10 then 'PDF too many pages: ' || n_name || ''
when 11 then 'Unsupported file format ''' || n_name || '''. Supported formats: jpeg, jpg, png, webp, bmp, tiff, tif, pdf' end as message from nation""",
    "confidence_bands": f"with {_WORDS} select case when conf >= 0.9 then 'green' when conf >= 0.75 then 'blue' when conf >= 0.5 then 'amber' else 'red' end as band, count(*) as n from w group by 1",
    "pixel_variance": "with e as (select vec_id, unnest(embedding) as v from embeddings), p as (select vec_id, cast(((round(cast(v as double) * 1000) % 256) + 256) % 256 as bigint) as px from e), g as (select vec_id, count(*) as n, cast(sum(px) as bigint) as s, cast(sum(px * px) as bigint) as q from p group by vec_id) select vec_id, n * q - s * s as n2_variance, n * q - s * s < 500 * n * n as enhance from g",
    "pixel_blur": f"with {_GRID} select vec_id, string_agg(blur, ',' order by y, x) as pixels from f group by vec_id",
    "pixel_threshold": f"with {_GRID} select vec_id, string_agg(case when p > blur - 10 then 255 else 0 end, ',' order by y, x) as pixels from f group by vec_id",
    "pixel_contrast": f"""with {_GRID}, r as (select vec_id, min(p) as lo, max(p) as hi from g group by vec_id)
select g.vec_id, string_agg(case when hi - lo >= 200 or hi = lo then p else (p - lo) * 255 // (hi - lo) end, ',' order by y, x) as pixels from g join r on g.vec_id = r.vec_id group by g.vec_id""",
    "pixel_turned": f"with {_GRID} select vec_id, string_agg(p, ',' order by x, 7 - y) as pixels from g group by vec_id",
    "quad_crops": f"with {_GRID} select vec_id, string_agg(p, ',' order by y, x) as pixels from g where x between 1 and 6 and y between 2 and 5 group by vec_id",
    "pixel_contours": f"""with recursive {_GRID}, o as (select vec_id, x, y from g where p >= 90),
c as (select vec_id, x, y, y * 8 + x as label from o union select o.vec_id, o.x, o.y, c.label from c join o on o.vec_id = c.vec_id and abs(o.x - c.x) <= 1 and abs(o.y - c.y) <= 1 and (o.x <> c.x or o.y <> c.y)),
a as (select vec_id, x, y, min(label) as area from c group by vec_id, x, y),
b as (select *, not ((vec_id, area, x - 1, y) in (select (vec_id, area, x, y) from a) and (vec_id, area, x + 1, y) in (select (vec_id, area, x, y) from a) and (vec_id, area, x, y - 1) in (select (vec_id, area, x, y) from a) and (vec_id, area, x, y + 1) in (select (vec_id, area, x, y) from a)) as border from a),
e as (select vec_id, area, count(*) filter (where border) as n, max(x) - min(x) + 1 as w, max(y) - min(y) + 1 as h, max(x) filter (where border) - min(x) filter (where border) + 1 as bw, max(y) filter (where border) - min(y) filter (where border) + 1 as bh from b group by vec_id, area)
select g.vec_id, cast(coalesce(k, 0) as integer) as n_contours, cast(coalesce(pts, 0) as integer) as n_points from (select distinct vec_id from g) g left join (select vec_id, count(*) as k, sum(n) as pts from e where n >= 3 and bw >= 3 and bh >= 3 group by vec_id) e on g.vec_id = e.vec_id""",
    "pdf_page": f"{_ROUTE} select doc, source, text from x where page = 2",
    "det_scores": """with e as (select vec_id, unnest(embedding) as v, generate_subscripts(embedding, 1) - 1 as i from embeddings), p as (select vec_id, cast(i // 16 as integer) as region, abs(cast(v as double)) as p from e),
s as (select vec_id, region, avg(p) filter (where p >= 0.1) as score from p group by all), o as (select vec_id, cast(count(*) filter (where p >= 0.1) as integer) as n_on from p group by vec_id)
select s.vec_id, region, round(score, 6) as score, n_on from s join o on s.vec_id = o.vec_id where score >= 0.12""",
    "moment_angles": f"""with {_CELL_BOXES}, p as (select doc, min_x + idx % 5 as x, min_y as y from b), m as (select doc, avg(x) as mx, avg(y) as my from p group by doc),
q as (select p.doc, x, y, 0.5 * atan2(2 * sum((x - mx) * (y - my)) over w, sum((x - mx) ** 2) over w - sum((y - my) ** 2) over w) as t from p join m on p.doc = m.doc window w as (partition by p.doc)),
r as (select doc, any_value(t) as t, min(x) - 2 as x0, max(y) + 2 as y1, min(x * cos(t) + y * sin(t)) - 2 as u0, max(x * cos(t) + y * sin(t)) + 2 as u1, min(-x * sin(t) + y * cos(t)) - 2 as v0, max(-x * sin(t) + y * cos(t)) + 2 as v1 from q group by doc),
z as (select doc, degrees(t) as angle, abs(degrees(t)) between 1.5 and 45 as turned, u0 * cos(t) - v0 * sin(t) as ux, u1 * sin(t) + v1 * cos(t) as uy, x0, y1 from r)
select doc, round(angle, 4) as angle, round(least(greatest(case when turned then ux else x0 end, 0), 900) * 1.5, 3) as x0, round(least(greatest(case when turned then uy else y1 end, 0), 900) * 2, 3) as y2 from z""",
    "export_tsv": f"""with {_GROUPED} select doc, page, 'line' || chr(9) || 'confidence' || chr(9) || 'min_x' || chr(9) || 'min_y' || chr(9) || 'max_x' || chr(9) || 'max_y' || chr(9) || 'text' || chr(10) || string_agg(line_no || chr(9) || printf('%.4f', round(conf, 2)) || chr(9) || printf('%.1f', min_x) || chr(9) || printf('%.1f', min_y) || chr(9) || printf('%.1f', max_x) || chr(9) || printf('%.1f', max_y) || chr(9) || text || chr(10), '' order by idx) as tsv from g group by doc, page""",
    "export_table_csv": f"""with {_MAT}, r as (select doc, row_no, string_agg(case when regexp_matches(text, '[,"\\n]') then '"' || replace(text, '"', '""') || '"' else text end, ',' order by col_no) as l from c group by all) select doc, string_agg(l || chr(10), '' order by row_no) as csv from r group by doc""",
    "export_table_markdown": f"""with {_MAT}, k as (select *, row_number() over (partition by doc, row_no order by col_no) as j, dense_rank() over (partition by doc order by row_no) as i from c),
s as (select doc, max(i) as n, max(j) as m from k group by doc), wd as (select doc, j, greatest(3, max(strlen(text))) as w from k group by doc, j),
grid as (select s.doc, i, wd.j, w from s, unnest(range(1, n + 1)) t(i), wd where wd.doc = s.doc), full_ as (select g.doc, g.i, g.j, w, coalesce(text, '') as text from grid g left join k on k.doc = g.doc and k.i = g.i and k.j = g.j),
l as (select doc, i, '|' || string_agg(' ' || text || repeat(' ', greatest(cast(w - length(text) as integer), 0)) || ' |', '' order by j) || chr(10) as line from full_ group by doc, i),
h as (select doc, '|' || string_agg('-' || repeat('-', cast(w as integer)) || '-|', '' order by j) || chr(10) as rule from wd group by doc)
select l.doc, string_agg(line || case when i = 1 then rule else '' end, '' order by i) as markdown from l join h on l.doc = h.doc group by l.doc""",
    "export_line_json": f"""with {_LINES} select doc, page, line_no, '{{"line_no":' || line_no || ',"text":' || cast(to_json(text) as varchar) || ',"n_words":' || n_words || '}}' as json from ln""",
    "export_table_json": f"""with {_MAT}, k as (select doc, row_no, col_no, '{{' || chr(10) || '    "text" : ' || cast(to_json(text) as varchar) || ',' || chr(10) || '    "confidence" : ' || coalesce(cast(round(confidence, 2) as varchar), 'null') || ',' || chr(10) || '    "row" : ' || row_no || ',' || chr(10) || '    "col" : ' || col_no || chr(10) || '  }}' as j from c),
r as (select doc, row_no, '[ ' || string_agg(j, ', ' order by col_no) || ' ]' as j from k group by doc, row_no) select doc, '{{' || chr(10) || '  "rows" : [ ' || string_agg(j, ', ' order by row_no) || ' ]' || chr(10) || '}}' as json from r group by doc""",
    "export_result_json": f"""with {_LINES}, c as (select doc, page, round(coalesce(avg(conf), 0), 6) as confidence, count(*) as n_regions from g group by all),
t as (select doc, page, string_agg(text, chr(10) order by line_no) as text, count(*) as n_lines, arg_min(text, line_no) as first_line from ln group by all),
f as (select doc, page, arg_min(max_x, idx) as first_max_x, arg_min(line_no, idx) as first_line_no from g group by all)
select t.doc, t.page, text, confidence, cast(n_lines as integer) as n_lines, cast(n_regions as integer) as n_regions, first_line, first_max_x, first_line_no from t join c on t.doc = c.doc and t.page = c.page join f on t.doc = f.doc and t.page = f.page""",
    "recognise_images": """select vec_id, case when vec_id % 7 = 0 or vec_id % 5 = 0 then 0 else 1 end as n_regions, case when vec_id % 7 = 0 or vec_id % 5 = 0 then '' else ['merah', 'hijau', 'biru'][cast(vec_id % 3 as integer) + 1] end as text,
case when vec_id % 7 = 0 then 'Invalid image: Image has zero width or height' end as error from embeddings""",
    "export_text_layer": f"""with {_LINES}, p as (select doc, page, max(max_x) as w, max(max_y) as h from ln group by doc, page),
t as (select ln.doc, ln.page, line_no, greatest(max_y - min_y, 6) as lh, min_x, h - min_y as up, text from ln join p on ln.doc = p.doc and ln.page = p.page where trim(regexp_replace(text, '\\s+', ' ', 'g')) <> ''),
ly as (select doc, page, string_agg('/F1 ' || printf('%.2f', lh * 0.9) || ' Tf' || chr(10) || '1 0 0 1 ' || printf('%.2f', min_x) || ' ' || printf('%.2f', up - lh) || ' Tm' || chr(10) || '(' || regexp_replace(replace(replace(replace(text, '\\', '\\\\'), '(', '\\('), ')', '\\)'), '[^\\x20-\\x7E]', ' ', 'g') || ') Tj' || chr(10), '' order by line_no) as b from t group by doc, page)
select p.doc, p.page, printf('q' || chr(10) || '%d 0 0 %d 0 0 cm' || chr(10) || '/Im0 Do' || chr(10) || 'Q' || chr(10) || 'BT' || chr(10) || '3 Tr' || chr(10), cast(w as integer), cast(h as integer)) || coalesce(b, '') || 'ET' || chr(10) as stream from p left join ly on p.doc = ly.doc and p.page = ly.page""",
    "export_hocr": f"""with {_LINES}, g2 as (select *, row_number() over (partition by doc, page, line_no order by idx) as i from g),
wd as (select doc, page, line_no, string_agg('          <span class=''ocrx_word'' id=''word_' || line_no || '_' || i || ''' title=''bbox ' || printf('%.0f %.0f %.0f %.0f', min_x, min_y, max_x, max_y) || '; x_wconf ' || cast(round(round(conf, 2) * 100) as integer) || '''>' || replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;') || '</span>' || chr(10), '' order by i) as ws, avg(round(conf, 2)) as lc from g2 group by all),
p as (select ln.doc, ln.page, string_agg('      <p class=''ocr_par'' id=''par_' || ln.line_no || ''' title=''bbox ' || printf('%.0f %.0f %.0f %.0f', min_x, min_y, max_x, max_y) || '''>' || chr(10) || '        <span class=''ocr_line'' id=''line_' || ln.line_no || ''' title=''bbox ' || printf('%.0f %.0f %.0f %.0f', min_x, min_y, max_x, max_y) || '; x_wconf ' || cast(round(lc * 100) as integer) || '''>' || chr(10) || ws || '        </span>' || chr(10) || '      </p>' || chr(10), '' order by ln.line_no) as b, max(max_x) as mx, max(max_y) as my from ln join wd on ln.doc = wd.doc and ln.page = wd.page and ln.line_no = wd.line_no group by ln.doc, ln.page)
select doc, page, '{export.HOCR_HEAD.replace(_Q, _Q * 2)}' || printf('  <div class=''ocr_page'' id=''page_1'' title=''bbox 0 0 %d %d''>', cast(mx as integer), cast(my as integer)) || chr(10) || '    <div class=''ocr_carea'' id=''block_1_1''>' || chr(10) || b || '    </div>' || chr(10) || '  </div>' || chr(10) || '</body>' || chr(10) || '</html>' || chr(10) as hocr from p""",
}
