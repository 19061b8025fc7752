"""Pages of documents: where their text comes from, and documents from pages."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from berkas.config import Config
from berkas.operators.dedup import appended_text, native_lines, new_text


def routed_pages(pages: DataFrame, ocr: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, source, text, confidence, n_regions, width, height). pages: keys, native_text, n_images, and the reading of the
    rendered page: rendered_text, rendered_conf (null if not rendered), rendered_width, rendered_height. ocr: keys, idx,
    text, conf, readings of embedded images.

    Own text with a letter or digit and no images: native text, confidence 1. With images: their readings that the own text
    lacks are appended (mixed, mean confidence of these); without any, native text. No own text: the rendered page, else
    the images, else empty native text."""
    letter = F.regexp_replace(F.coalesce("native_text", F.lit("")), r"(?U)[^\p{L}\p{N}]", "") != ""
    p = pages.withColumn("usable", letter).withColumn("imaged", F.col("n_images") > 0)
    kept = appended_text(new_text(ocr, native_lines(pages.where("native_text is not null"), keys), keys), keys)
    every = ocr.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("idx", "text"))).alias("ts"), F.count("*").alias("n_all"), F.avg("conf").alias("conf_all"))
    every = every.select(*keys, F.array_join(F.filter(F.transform("ts", lambda t: t["text"]), lambda t: t != ""), "\n").alias("text_all"), "n_all", "conf_all")
    x = p.join(kept, keys, "left").join(every, keys, "left")
    mixed = F.col("usable") & F.col("imaged") & (F.coalesce("n_kept", F.lit(0)) > 0)
    rendered = ~F.col("usable") & F.col("rendered_text").isNotNull()
    images = ~F.col("usable") & F.col("rendered_text").isNull() & F.col("imaged")
    own = F.when(F.col("usable"), F.trim("native_text")).otherwise("")
    pick = lambda m, r, i, o: F.when(mixed, m).when(rendered, r).when(images, i).otherwise(o)
    return x.select(
        *keys,
        pick(F.lit("mixed"), F.lit("ocr"), F.lit("ocr"), F.lit("native_text")).alias("source"),
        pick(F.concat(own, F.lit("\n"), F.col("appended")), F.col("rendered_text"), F.coalesce("text_all", F.lit("")), own).alias("text"),
        pick(F.col("confidence"), F.col("rendered_conf"), F.coalesce("conf_all", F.lit(0.0)), F.lit(1.0)).alias("confidence"),
        pick(F.col("n_kept"), F.lit(None).cast("long"), F.coalesce("n_all", F.lit(0)), F.lit(0)).alias("n_regions"),
        F.when(rendered, F.col("rendered_width")).otherwise(1024).alias("width"),
        F.when(rendered, F.col("rendered_height")).otherwise(1448).alias("height"),
    )


def document(pages: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n_pages, text, confidence): texts of the pages that have one, in page order, with an empty line between; mean
    of the page confidences. Text that came from the file itself is kept."""
    g = pages.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("page_number", F.coalesce("text", F.lit("")).alias("text")))).alias("ps"), F.count("*").alias("n_pages"), F.coalesce(F.avg("confidence"), F.lit(0.0)).alias("confidence"))
    return g.select(*keys, "n_pages", F.array_join(F.filter(F.transform("ps", lambda p: p["text"]), lambda t: t != ""), "\n\n").alias("text"), "confidence")


def document_or_error(pages: DataFrame, keys: list[str]) -> DataFrame:
    """As `document`, where a page with an error (column error) fails its document: text is null and error the first
    page's."""
    bad = pages.where("error is not null").groupBy(*keys).agg(F.min_by("error", "page_number").alias("error"))
    return document(pages, keys).join(bad, keys, "left").withColumn("text", F.when(F.col("error").isNull(), F.col("text")))


_PAGE = "page_number int, native_text string, images array<struct<height:int,width:int,data:binary>>, rendered struct<height:int,width:int,data:binary>, error string"


def extracted(files: DataFrame, parser: Callable | None, config: Config = Config(), *, render_width: int = 1024) -> DataFrame:
    """files (content, ...) of PDF documents as rows of pages: own text, embedded images of enough area, and the page
    rendered where it has neither. parser: bytes -> pages, each with `text`, `images` (height, width, blue-green-red bytes)
    and `render(width)`; no library comes along, and without one, or for a document that it cannot read, there is one row
    with an error. A document with too many pages is not read."""
    keep = [f for f in files.schema.fields if f.name not in ("content", "page_number", "native_text", "images", "rendered", "error")]

    def pages(content) -> list[tuple]:
        if parser is None:
            return [(None, None, [], None, "Invalid PDF: no PDF library was given")]
        try:
            found = list(parser(content))
        except Exception as e:  # noqa: BLE001
            return [(None, None, [], None, f"Invalid PDF: {e}")]
        if len(found) > config.max_pdf_pages:
            return [(None, None, [], None, f"PDF too many pages: {len(found)} pages exceeds limit of {config.max_pdf_pages}")]
        out = []
        for i, p in enumerate(found, 1):
            text = (p.text or "").strip()
            images = [{"height": h, "width": w, "data": d} for h, w, d in p.images if h * w >= config.pdf_embedded_img_min_area]
            shot, error = None, None
            if not images and not any(c.isalnum() for c in text):
                try:
                    h, w, d = p.render(render_width)
                    shot = {"height": h, "width": w, "data": d}
                except Exception as e:  # noqa: BLE001
                    error = f"PDF rendering failed: {e}"
            out.append((i, text, images, shot, error))
        return out

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for k in range(len(b)):
                rows = pd.DataFrame(pages(b["content"].iloc[k]), columns=["page_number", "native_text", "images", "rendered", "error"])
                rows["page_number"] = rows["page_number"].astype("Int32")
                for f in keep:
                    rows[f.name] = [b[f.name].iloc[k]] * len(rows)
                yield rows[[*(f.name for f in keep), "page_number", "native_text", "images", "rendered", "error"]]

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in keep), _PAGE])
    return files.select(*[f.name for f in keep], "content").mapInPandas(run, schema)
