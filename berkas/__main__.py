"""Command line: `python -m berkas info`, or `python -m berkas INPUT` with --format text|json|tsv|hocr|csv and --schema
ktp|npwp|sim|receipt|table|entities|key-values. INPUT is a Parquet table of recognised words (doc, page, idx, text, conf,
box), or an image, a pattern of images or an address, which the models of the model folder read (see `models`).
--searchable-pdf and --annotate write a PDF and a marked picture per image to a folder."""

from __future__ import annotations

import argparse
import os
import sys

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from berkas.config import LANGUAGES, Config, language_of
from berkas.engine import Engine
from berkas.operators import export, layout, pipeline, tables, vision
from berkas.session import session
from berkas.sources.files import FORMATS, extension, read_images

KEYS = ["doc", "page"]


def info() -> None:
    """Formats and languages."""
    print("Supported File Formats:", FORMATS)
    print("Available Languages:")
    for lang in LANGUAGES:
        print(f"  [{lang[0]}] {lang[1]} ({lang[4]} characters)")


def written(e: Engine, words: DataFrame, form: str, schema: str | None) -> DataFrame:
    """(doc, page, out) of words in a format or with the fields of a schema."""
    lines = layout.grouped_lines(words, KEYS)
    if schema == "table":
        cells = words.join(tables.reconstructed(words, KEYS), [*KEYS, "idx"]).withColumnRenamed("conf", "confidence")
        if form == "json":
            return tables.table_json(cells, KEYS).withColumnRenamed("json", "out")
        text = tables.csv_text if form == "csv" else tables.markdown_text
        return tables.matrix(cells, KEYS).select(*KEYS, text(F.col("rows")).alias("out"))
    if schema == "key-values":
        pairs = e.key_values(e.lines(words, KEYS)).groupBy(*KEYS).agg(F.sort_array(F.collect_list(F.struct("line_no", "key", "value"))).alias("key_values"))
        return pairs.select(*KEYS, export.as_json(F.transform("key_values", lambda x: F.struct(x["key"].alias("key"), x["value"].alias("value"))).alias("key_values"), pretty=True).alias("out"))
    if schema:
        name = "receipt" if schema == "invoice" else schema
        return getattr(e, name)(e.text(words, KEYS)).select(*KEYS, export.as_json(name, pretty=True).alias("out"))
    if form == "tsv":
        return export.tsv(lines, KEYS).withColumnRenamed("tsv", "out")
    if form == "hocr":
        pages = words.groupBy(*KEYS).agg(F.max("max_x").alias("width"), F.max("max_y").alias("height"))
        return export.hocr(lines, pages, KEYS).withColumnRenamed("hocr", "out")
    if form == "json":
        return export.document_json(lines, KEYS, pretty=True).withColumnRenamed("json", "out")
    return e.text(words, KEYS).select(*KEYS, F.col("text").alias("out"))


def main(argv: list[str] | None = None, engine: Engine | None = None) -> int:
    p = argparse.ArgumentParser(prog="berkas", description=__doc__)
    p.add_argument("input", help="'info', a Parquet table of words, or images")
    p.add_argument("--format", default="text", choices=["text", "json", "tsv", "hocr", "csv"])
    p.add_argument("--schema", choices=["ktp", "npwp", "sim", "receipt", "invoice", "table", "entities", "key-values"])
    p.add_argument("--lang", default="id", help="language of the documents")
    p.add_argument("--output", help="folder to write Parquet to, instead of printing")
    p.add_argument("--searchable-pdf", metavar="FOLDER", help="write a searchable PDF per image")
    p.add_argument("--annotate", metavar="FOLDER", help="write the images with their regions marked, as Parquet of pixels")
    p.add_argument("--deskew", action=argparse.BooleanOptionalAction, default=True, help="straighten tilted images (default)")
    a = p.parse_args(argv)
    if a.input == "info":
        info()
        return 0
    spark = engine.spark if engine else session()
    lang = spark.range(1).select(language_of(F.lit(a.lang))).first()[0]
    if lang is None:
        print(f"error: unknown language {a.lang}", file=sys.stderr)
        return 2
    e = engine or Engine.auto(spark, lang, Config(deskew_enabled=a.deskew))
    e.config = e.config.with_(deskew_enabled=a.deskew)
    ending = spark.range(1).select(extension(F.lit(a.input))).first()[0]
    if a.input.startswith(("http://", "https://")):
        r = e.recognise_files([a.input]).first()
        print(r["text"] if r["error"] is None else f"error: {r['error']}", file=sys.stdout if r["error"] is None else sys.stderr)
        return int(r["error"] is not None)
    if ending in FORMATS and ending != "pdf":
        images = read_images(spark, a.input).withColumn("doc", F.col("path")).withColumn("page", F.lit(1))
        found = e.recognise(images.select(*KEYS, "height", "width", "data"))
        failed = found.where("error is not null").select("doc", "error").collect()
        for r in failed:
            print(f"error: {r['doc']}: {r['error']}", file=sys.stderr)
        raw = pipeline.words(found, KEYS)
        order = layout.sorted_lines(raw, KEYS)
        words = raw.join(order.select(*KEYS, "idx", "pos"), [*KEYS, "idx"]).drop("idx").withColumnRenamed("pos", "idx")
        if a.searchable_pdf:
            layers = export.text_layer(e.lines(words, KEYS), images.select(*KEYS, "width", "height"), KEYS)
            os.makedirs(a.searchable_pdf, exist_ok=True)
            for r in export.searchable_pdfs(images, layers, KEYS).toLocalIterator():
                if r["pdf"] is not None:
                    with open(os.path.join(a.searchable_pdf, os.path.basename(r["doc"]) + ".pdf"), "wb") as f:
                        f.write(r["pdf"])
        if a.annotate:
            vision.annotated(images.select(*KEYS, "height", "width", "data"), raw, KEYS).write.mode("errorifexists").parquet(a.annotate)
        if failed and found.where("error is null").isEmpty():
            return 1
    elif ending == "pdf":
        print("error: Invalid PDF: no PDF library was given", file=sys.stderr)
        return 1
    else:
        words = spark.read.parquet(a.input)
    out = written(e, words, a.format, a.schema)
    if a.output:
        out.write.mode("errorifexists").parquet(a.output)
    else:
        for r in out.orderBy(*KEYS).toLocalIterator():
            print(r["out"])
    return 0


if __name__ == "__main__":
    sys.exit(main())
