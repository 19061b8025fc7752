"""Results as text: TSV, hOCR, JSON, and the text layer of a searchable PDF."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from berkas.functions.text import escaped_html, trimmed


def fixed(c: Column, places: int) -> Column:
    """A number with fixed places; exact ties go to the even digit."""
    return F.format_string(f"%.{places}f", F.bround(c.cast("double"), places))


def tsv(words: DataFrame, keys: list[str], order: str = "idx") -> DataFrame:
    """(keys, tsv) of words (keys, idx, line_no, conf, box columns, text); the text stands as it is."""
    row = F.concat_ws("\t", F.col("line_no").cast("string"), fixed(F.col("conf"), 4), *[fixed(F.col(c), 1) for c in ("min_x", "min_y", "max_x", "max_y")], F.coalesce("text", F.lit("")))
    g = words.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), row.alias("r")))).alias("rs"))
    head = "line\tconfidence\tmin_x\tmin_y\tmax_x\tmax_y\ttext\n"
    return g.select(*keys, F.concat(F.lit(head), F.array_join(F.transform("rs", lambda r: F.concat(r["r"], F.lit("\n"))), "")).alias("tsv"))


def _bbox(prefix: str = "") -> Column:
    return F.concat(F.lit("bbox "), F.concat_ws(" ", *[fixed(F.col(f"{prefix}{c}"), 0) for c in ("min_x", "min_y", "max_x", "max_y")]))


def _percent(c: Column) -> Column:
    return F.round(c.cast("double") * 100).cast("int").cast("string")


HOCR_HEAD = (
    '<?xml version="1.0" encoding="UTF-8"?>\n<!DOCTYPE html PUBLIC "-//W3C//DTD XHTML 1.0 Transitional//EN" "http://www.w3.org/TR/xhtml1/DTD/xhtml1-transitional.dtd">\n'
    '<html xmlns="http://www.w3.org/1999/xhtml" xml:lang="en" lang="en">\n<head>\n  <title>OCR Output</title>\n  <meta http-equiv="Content-Type" content="text/html;charset=utf-8" />\n'
    "  <meta name='ocr-system' content='berkas' />\n</head>\n<body>\n"
)


def hocr(words: DataFrame, pages: DataFrame, keys: list[str], order: str = "idx") -> DataFrame:
    """(keys, hocr) of words (keys, idx, line_no, conf, box, text) on pages (keys, width, height): page, area, paragraph,
    line and word with boxes and whole percent of confidence. A page without words has an empty area."""
    w = words.select(*keys, "line_no", F.col(order).alias("o"), "conf", "min_x", "min_y", "max_x", "max_y", _bbox().alias("bb"), _percent(F.col("conf")).alias("pc"), escaped_html(F.coalesce("text", F.lit(""))).alias("t"))
    l = w.groupBy(*keys, "line_no").agg(F.sort_array(F.collect_list(F.struct("o", "bb", "pc", "t"))).alias("ws"), F.avg("conf").alias("conf"), *[f("%s" % c).alias(c) for f, c in ((F.min, "min_x"), (F.min, "min_y"), (F.max, "max_x"), (F.max, "max_y"))])
    no = F.col("line_no").cast("string")
    word = lambda x, i: F.concat(F.lit("          <span class='ocrx_word' id='word_"), no, F.lit("_"), (i + 1).cast("string"), F.lit("' title='"), x["bb"], F.lit("; x_wconf "), x["pc"], F.lit("'>"), x["t"], F.lit("</span>\n"))
    par = F.concat(
        F.lit("      <p class='ocr_par' id='par_"), no, F.lit("' title='"), _bbox(), F.lit("'>\n        <span class='ocr_line' id='line_"), no, F.lit("' title='"), _bbox(), F.lit("; x_wconf "), _percent(F.col("conf")), F.lit("'>\n"),
        F.array_join(F.transform("ws", word), ""), F.lit("        </span>\n      </p>\n"),
    )
    d = l.select(*keys, "line_no", par.alias("p")).groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("line_no", "p"))).alias("ps"))
    x = pages.join(d, keys, "left")
    body = F.coalesce(F.array_join(F.transform("ps", lambda p: p["p"]), ""), F.lit(""))
    text = F.concat(F.lit(HOCR_HEAD), F.format_string("  <div class='ocr_page' id='page_1' title='bbox 0 0 %d %d'>\n    <div class='ocr_carea' id='block_1_1'>\n", F.col("width").cast("int"), F.col("height").cast("int")), body, F.lit("    </div>\n  </div>\n</body>\n</html>\n"))
    return x.select(*keys, text.alias("hocr"))


def as_json(*columns: str | Column, pretty: bool = False) -> Column:
    """Columns as one JSON object, nulls kept."""
    return F.to_json(F.struct(*columns), {"pretty": str(pretty).lower(), "ignoreNullFields": "false"})


def _box(prefix: str = "") -> Column:
    return F.struct(*[F.col(f"{prefix}{c}").cast("double").alias(c) for c in ("min_x", "min_y", "max_x", "max_y")])


def document_json(words: DataFrame, keys: list[str], *, pretty: bool = False, order: str = "idx") -> DataFrame:
    """(keys, json): whole results as {"text", "confidence", "lines", "regions"}, nulls kept. words: keys, idx, line_no, conf,
    box columns, text. Lines and regions have text, confidence, bounds and line number, in reading order."""
    region = F.struct(F.coalesce("text", F.lit("")).alias("text"), F.col("conf").alias("confidence"), F.col("line_no").alias("line_number"), _box().alias("bbox"))
    r = words.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), region.alias("r")))).alias("rs"), F.coalesce(F.avg("conf"), F.lit(0.0)).alias("confidence"))
    g = words.groupBy(*keys, "line_no").agg(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.coalesce("text", F.lit("")).alias("t")))).alias("ts"), F.avg("conf").alias("c"), F.min("min_x").alias("min_x"), F.min("min_y").alias("min_y"), F.max("max_x").alias("max_x"), F.max("max_y").alias("max_y"))
    line = F.struct(F.col("line_no").alias("n"), F.struct(F.array_join(F.transform("ts", lambda t: t["t"]), " ").alias("text"), F.col("c").alias("confidence"), F.col("line_no").alias("line_number"), _box().alias("bbox")).alias("l"))
    x = g.groupBy(*keys).agg(F.sort_array(F.collect_list(line)).alias("ls")).join(r, keys)
    lines = F.transform("ls", lambda x: x["l"])
    whole = F.struct(F.array_join(F.transform(lines, lambda x: x["text"]), "\n").alias("text"), F.col("confidence"), lines.alias("lines"), F.transform("rs", lambda x: x["r"]).alias("regions"))
    return x.select(*keys, F.to_json(whole, {"pretty": str(pretty).lower(), "ignoreNullFields": "false"}).alias("json"))


def batch_json(items: DataFrame, keys: list[str], *, pretty: bool = False) -> DataFrame:
    """(keys, json) of batches of items (keys, pos, source, success, text, error, duration_ms): the items in order and their
    counts. A batch is one JSON text, so it has to fit into a row; use the rows themselves for anything larger."""
    item = F.struct("pos", F.struct("source", "success", "text", "error", "duration_ms").alias("i"))
    g = items.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(item)), lambda x: x["i"]).alias("items"), F.count("*").alias("total"), F.count_if("success").alias("succeeded"), F.count_if(~F.coalesce("success", F.lit(False))).alias("failed"), F.sum("duration_ms").alias("total_duration_ms"))
    return g.select(*keys, as_json("items", "total", "succeeded", "failed", "total_duration_ms", pretty=pretty).alias("json"))


def pages_json(pages: DataFrame, keys: list[str], *, pretty: bool = False) -> DataFrame:
    """(keys, json) of documents made of pages (keys, page_number, source, text, confidence, width, height)."""
    page = F.struct("page_number", "source", "text", "confidence", F.array("width", "height").alias("dimensions"))
    g = pages.groupBy(*keys).agg(F.sort_array(F.collect_list(page)).alias("pages"), F.count("*").alias("total_pages"), F.coalesce(F.avg("confidence"), F.lit(0.0)).alias("confidence"))
    text = F.array_join(F.filter(F.transform("pages", lambda p: p["text"]), lambda t: t != ""), "\n\n")
    return g.select(*keys, as_json("pages", "total_pages", text.alias("text"), "confidence", pretty=pretty).alias("json"))


def pdf_escaped(text: Column) -> Column:
    """Text of a PDF string: parentheses and backslashes escaped, line feed, return and tab named, all else outside
    printable ASCII a blank."""
    t = F.regexp_replace(text, r"([\\()])", r"\\$1")
    for a, b in (("\r", r"\\r"), ("\n", r"\\n"), ("\t", r"\\t")):
        t = F.regexp_replace(t, a, b.replace("\\\\", "\\\\\\\\"))
    return F.regexp_replace(t, r"[^\x20-\x7E]", " ")


def text_layer(line_rows: DataFrame, pages: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, stream): the page's content stream, the image and over it the lines as invisible text, each at the foot of its
    box, nine tenths of its height (at least 6) high."""
    h = F.greatest(F.col("max_y") - F.col("min_y"), F.lit(6.0))
    x = line_rows.join(pages, keys).where(trimmed(F.col("text")) != "")
    line = F.concat(F.lit("/F1 "), fixed(h * 0.9, 2), F.lit(" Tf\n1 0 0 1 "), fixed(F.col("min_x"), 2), F.lit(" "), fixed(F.col("height") - F.col("min_y") - h, 2), F.lit(" Tm\n("), pdf_escaped(F.col("text")), F.lit(") Tj\n"))
    g = x.select(*keys, "line_no", line.alias("l")).groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("line_no", "l"))).alias("ls"))
    y = pages.join(g, keys, "left")
    head = F.format_string("q\n%d 0 0 %d 0 0 cm\n/Im0 Do\nQ\nBT\n3 Tr\n", F.col("width").cast("int"), F.col("height").cast("int"))
    return y.select(*keys, F.concat(head, F.coalesce(F.array_join(F.transform("ls", lambda l: l["l"]), ""), F.lit("")), F.lit("ET\n")).alias("stream"))


def searchable_pdf(rgb: bytes, width: int, height: int, stream: str) -> bytes:
    """A PDF of one page from raw RGB pixels and a content stream. The image is stored losslessly (Flate), as there is no
    JPEG encoder here; all else is laid out as six objects with a cross-reference table."""
    if width <= 0 or height <= 0:
        raise ValueError("Invalid image: Image has zero dimensions")
    image, content = zlib.compress(rgb), stream.encode("ascii", "replace")
    objects = [
        b"<< /Type /Catalog /Pages 2 0 R >>",
        b"<< /Type /Pages /Kids [3 0 R] /Count 1 >>",
        b"<< /Type /Page /Parent 2 0 R /MediaBox [0 0 %d %d] /Resources << /ProcSet [/PDF /Text /ImageC] /Font << /F1 4 0 R >> /XObject << /Im0 5 0 R >> >> /Contents 6 0 R >>" % (width, height),
        b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica /Encoding /StandardEncoding >>",
        b"<< /Type /XObject /Subtype /Image /Width %d /Height %d /ColorSpace /DeviceRGB /BitsPerComponent 8 /Filter /FlateDecode /Length %d >>\nstream\n%s\nendstream" % (width, height, len(image), image),
        b"<< /Length %d >>\nstream\n%sendstream" % (len(content), content),
    ]
    out, at = bytearray(b"%PDF-1.4\n%\xe2\xe3\xcf\xd3\n"), []
    for i, body in enumerate(objects, 1):
        at.append(len(out))
        out += b"%d 0 obj\n%s\nendobj\n" % (i, body)
    xref = len(out)
    out += b"xref\n0 7\n0000000000 65535 f \n" + b"".join(b"%010d 00000 n \n" % a for a in at)
    out += b"trailer\n<< /Size 7 /Root 1 0 R >>\nstartxref\n%d\n%%%%EOF\n" % xref
    return bytes(out)


def searchable_pdfs(images: DataFrame, layers: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, pdf, error): a PDF per image (keys, height, width, data in blue-green-red or grey) with the text layer of its
    content stream (keys, stream of `text_layer`). An image that cannot be laid out has an error; one without a stream an
    empty text layer."""

    @F.pandas_udf("struct<pdf:binary,error:string>")
    def run(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for cols in batches:
            out = []
            for h, w, data, stream in zip(*cols):
                try:
                    px = np.frombuffer(data, np.uint8).reshape(h, w, -1)
                    rgb = np.repeat(px[..., :1], 3, 2) if px.shape[2] == 1 else px[..., 2::-1]
                    out.append((searchable_pdf(rgb.tobytes(), w, h, stream or "q\nBT\n3 Tr\nET\n"), None))
                except Exception as e:  # noqa: BLE001
                    out.append((None, f"Invalid image: {e}"))
            yield pd.DataFrame(out, columns=["pdf", "error"])

    x = images.select(*keys, "height", "width", "data").join(layers.select(*keys, "stream"), keys, "left")
    return x.withColumn("p", run("height", "width", "data", "stream")).select(*keys, "p.pdf", "p.error")
