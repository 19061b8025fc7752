"""One object over the operators, for those who read documents and not tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from berkas import models
from berkas.config import Config, error_text
from berkas.functions.geometry import box
from berkas.operators import cards, dedup, entities, export, layout, nms, pages, pipeline, recognition, tables
from berkas.session import clear_stored
from berkas.sources.files import SUPPORTED, decoded_images, fetched, guarded, kind_of_source, read_files, read_images, read_paths, sniffed, supported


@dataclass
class Engine:
    """Reading of images into regions, text, fields and exports. detector, recogniser and pdf_parser are functions (see
    `models` and `pages.extracted`); none comes along, and without them rows have an error. Regions read elsewhere come in
    as DataFrames."""

    spark: SparkSession
    config: Config = field(default_factory=Config)
    recogniser: Callable | None = None
    detector: Callable | None = None
    pdf_parser: Callable | None = None

    @classmethod
    def auto(cls, spark: SparkSession, language: str = "id", config: Config | None = None) -> Engine:
        """An engine with the models of the model folder; a model that is missing shows as an error in the rows."""
        config = models.resolved((config or Config()).with_(language=language))
        return cls(spark, config, recogniser=models.onnx_recogniser(config), detector=models.onnx_detector(config))

    def warm(self) -> None:
        """Opens the models of this process on an empty image; errors are left to the first real one."""
        models.warmed(self.detector, self.recogniser)

    def recognise(self, images: DataFrame) -> DataFrame:
        """Images (height, width, data in blue-green-red, ...) with regions and error (`pipeline.read`); equal images are
        read once where the cache is on."""
        if not self.config.cache_enabled:
            return pipeline.read(images, self.detector, self.recogniser, self.config)
        once = lambda df: pipeline.read(df.select("key", "data", "height", "width"), self.detector, self.recogniser, self.config)
        shape = F.concat_ws("x", "height", "width")
        keyed = images.drop("error") if "error" in images.columns else images
        keyed = keyed.withColumn("key", F.concat_ws(":", shape, dedup.content_key(F.col("data"))))
        found = once(keyed.select("key", "data", "height", "width").dropDuplicates(["key"]))
        out = keyed.drop("data").join(found.select("key", "regions", "error"), "key", "left").drop("key")
        return out

    def recognise_files(self, sources: list[str]) -> DataFrame:
        """(pos, source, kind, text, confidence, n_regions, error) of paths and addresses, in their order: every one is read
        or carries its error, and none stops the others."""
        found = self.sources(sources)
        bytes_ = found.withColumn("format", sniffed(F.col("content")))
        bad = F.when(F.col("error").isNotNull(), F.col("error")).when(~supported(F.col("format")), error_text("UnsupportedFormat", F.col("format"), SUPPORTED)).when(F.col("format") == "pdf", error_text("InvalidPdf", "its pages are read by pdf_pages"))
        images = decoded_images(bytes_.withColumn("error", bad).select("pos", "path", "format", "content", "error"))
        # what Python cannot decode the image source of the JVM may
        left = [r[0] for r in images.where("path is not null and error like 'Invalid image%'").select("path").distinct().collect()]
        if left:
            other = read_images(self.spark, left).where("width > 0").select("path", F.col("height").alias("h"), F.col("width").alias("w"), F.col("data").alias("d"))
            images = images.join(other, "path", "left")
            for c, o in (("height", "h"), ("width", "w"), ("data", "d")):
                images = images.withColumn(c, F.coalesce(o, c))
            images = images.withColumn("error", F.when(F.col("d").isNull(), F.col("error"))).drop("h", "w", "d")
        images = images.select(F.col("pos").alias("at"), "height", "width", "data", "error")
        seen = self.recognise(images.where("error is null"))
        w = pipeline.words(seen, ["at"])
        ordered = w.join(layout.sorted_lines(w, ["at"]), ["at", "idx"]).drop("idx", "line_no").withColumnRenamed("pos", "idx")
        text = self.text(ordered, ["at"])
        n = w.groupBy("at").agg(F.avg("conf").alias("confidence"), F.count("*").cast("int").alias("n_regions"))
        good = seen.select("at", "error").join(text.select("at", "text"), "at", "left").join(n, "at", "left")
        rows = good.unionByName(images.where("error is not null").select("at", "error"), allowMissingColumns=True).withColumnRenamed("at", "pos")
        out = found.select("pos", "source", "kind").join(rows, "pos", "left")
        fine = F.col("error").isNull()
        return out.select("pos", "source", "kind", F.when(fine, F.coalesce("text", F.lit(""))).alias("text"), F.when(fine, F.coalesce("confidence", F.lit(0.0))).alias("confidence"), F.when(fine, F.coalesce("n_regions", F.lit(0))).alias("n_regions"), "error").orderBy("pos")

    def pdf_pages(self, files: DataFrame) -> DataFrame:
        """Rows of pages of PDF files (content, ...) from the parser."""
        return pages.extracted(files, self.pdf_parser, self.config)

    @staticmethod
    def clear_cache() -> int:
        """Deletes the intermediate tables of results that are no longer needed, and gives their count."""
        return clear_stored()

    def files(self, path: str) -> DataFrame:
        """Files with their format; what may not be read has an error."""
        return read_files(self.spark, path, self.config)

    def sources(self, sources: list[str]) -> DataFrame:
        """Paths and addresses (pos keeps their order) with content and error: addresses are fetched, files read; what is
        missing, too large or of a wrong ending has an error."""
        df = self.spark.createDataFrame(list(enumerate(sources)), "pos int, source string").withColumn("kind", kind_of_source(F.col("source")))
        urls = fetched(df.where("kind = 'url'"), "source", self.config)
        return urls.withColumn("path", F.lit(None).cast("string")).unionByName(read_paths(self.spark, df.where("kind = 'file'"), "source", self.config))

    def guard(self, files: DataFrame) -> DataFrame:
        return guarded(files, self.config)

    def read(self, crops: DataFrame, column: str = "content") -> DataFrame:
        """Crops with text and confidence from the recogniser."""
        return recognition.scored(crops, column, self.recogniser)

    def regions(self, words: DataFrame, keys: list[str]) -> DataFrame:
        """Regions without the overlapping ones, in reading order with line numbers."""
        b = words.withColumn("b", box("min_x", "min_y", "max_x", "max_y"))
        kept = nms.kept_boxes(b.select(*keys, "idx", "b", "conf"), keys, self.config.nms_iou_threshold).select(*keys, "idx")
        words = words.join(kept, [*keys, "idx"])
        order = layout.sorted_lines(words, keys)
        return words.join(order, [*keys, "idx"])

    def lines(self, words: DataFrame, keys: list[str]) -> DataFrame:
        return layout.line_table(layout.grouped_lines(words, keys), keys)

    def text(self, words: DataFrame, keys: list[str]) -> DataFrame:
        return layout.page_text(self.lines(words, keys), keys)

    @staticmethod
    def ktp(texts: DataFrame, column: str = "text") -> DataFrame:
        return texts.withColumn("ktp", cards.ktp(F.col(column)))

    @staticmethod
    def npwp(texts: DataFrame, column: str = "text") -> DataFrame:
        return texts.withColumn("npwp", cards.npwp(F.col(column)))

    @staticmethod
    def sim(texts: DataFrame, column: str = "text") -> DataFrame:
        return texts.withColumn("sim", cards.sim(F.col(column)))

    @staticmethod
    def receipt(texts: DataFrame, column: str = "text") -> DataFrame:
        return texts.withColumn("receipt", cards.receipt(F.col(column)))

    @staticmethod
    def entities(texts: DataFrame, column: str = "text") -> DataFrame:
        return texts.withColumn("entities", entities.entities(F.col(column)))

    @staticmethod
    def key_values(line_rows: DataFrame, column: str = "text") -> DataFrame:
        x = line_rows.withColumn("_kv", cards.key_value(F.col(column))).where("_kv is not null")
        return x.select(*line_rows.columns, "_kv.key", "_kv.value")

    @staticmethod
    def table(words: DataFrame, keys: list[str]) -> DataFrame:
        return words.join(tables.reconstructed(words, keys), [*keys, "idx"])

    @staticmethod
    def tsv(words: DataFrame, keys: list[str]) -> DataFrame:
        return export.tsv(words, keys)

    @staticmethod
    def hocr(words: DataFrame, pages: DataFrame, keys: list[str]) -> DataFrame:
        return export.hocr(words, pages, keys)
