"""Settings, languages and errors."""

from __future__ import annotations

import os
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Languages (id, name, display name, model, characters, description, fetched by itself) and their codes.
_MODEL = "PP-OCRv6_rec_small.onnx"
LANGUAGES = [
    ("id", "Indonesian", "Indonesian (Latin)", _MODEL, 18708, "Unified PP-OCRv6 model supporting 50 languages. Optimized for Indonesian documents (KTP, SIM, NPWP, receipts, invoices).", True),
    ("en", "English", "English (Latin)", _MODEL, 18708, "Unified PP-OCRv6 model supporting 50 languages. Full Latin alphabet, numbers, and punctuation support.", True),
    ("multi", "Multilingual", "Multilingual (50 Languages)", _MODEL, 18708, "Unified PP-OCRv6 model supporting 50 languages with native script recognition.", True),
    ("ch", "Chinese", "Chinese (Hanzi)", _MODEL, 18708, "Unified PP-OCRv6 model supporting Simplified and Traditional Chinese.", True),
]
CODES = {"id": "id", "ind": "id", "indonesia": "id", "indonesian": "id", "en": "en", "eng": "en", "english": "en", "multi": "multi", "multilingual": "multi", "all": "multi", "ch": "ch", "zh": "ch", "chinese": "ch", "mandarin": "ch"}
ERRORS = {
    "ModelNotFound": "Model not found: {0}", "ModelLoadFailed": "Model loading failed: {0}", "InferenceFailed": "Inference failed: {0}", "InvalidImage": "Invalid image: {0}", "InvalidPdf": "Invalid PDF: {0}",
    "PdfRenderingFailed": "PDF rendering failed: {0}", "UnsupportedFormat": "Unsupported file format '{0}'. Supported formats: {1}", "Network": "Network error: {0}", "IoError": "IO error: {0}",
    "ImageTooLarge": "Image too large: {0}", "PdfTooManyPages": "PDF too many pages: {0}", "DownloadFailed": "Download failed: {0}",
}


@dataclass(frozen=True)
class Config:
    """All settings with their defaults; `with_(...)` gives a changed copy. Frozen, so it can go along with any task."""

    language: str = "id"
    detection_model_path: str | None = None
    recognition_model_path: str | None = None
    dictionary_path: str | None = None
    det_threshold: float = 0.25
    det_box_thresh: float = 0.4
    unclip_ratio: float = 1.6
    det_max_side_len: int = 960
    rec_threshold: float = 0.4
    nms_iou_threshold: float = 0.4
    enhancement_enabled: bool = True
    enhancement_variance_threshold: float = 500.0
    deskew_enabled: bool = True
    second_pass_enabled: bool = True
    second_pass_threshold: float = 0.65
    intra_threads: int = 0
    inter_threads: int = 0
    max_image_width: int = 4096
    max_image_height: int = 4096
    max_file_size: int = 50 * 1024 * 1024
    max_url_download_size: int = 25 * 1024 * 1024
    url_timeout_secs: int = 15
    pdf_library_path: str | None = None
    max_pdf_pages: int = 50
    pdf_embedded_img_min_area: int = 10_000
    cache_enabled: bool = True
    cache_capacity: int = 64

    def with_(self, **changes) -> Config:
        return replace(self, **changes)

    def threads(self) -> tuple[int, int]:
        """Threads inside and across operations of a model: up to six cores and one, where not set."""
        return self.intra_threads or min(os.cpu_count() or 1, 6), self.inter_threads or 1


def languages(spark: SparkSession) -> DataFrame:
    """The supported languages."""
    return spark.createDataFrame(LANGUAGES, "id string, name string, display_name string, model_name string, character_count int, description string, auto_download boolean")


def language_of(code: Column) -> Column:
    """The language id of a code in any case, null for an unknown one."""
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in CODES.items() for x in kv]), F.lower(F.trim(code)))


def error_text(kind: str, *parts) -> Column:
    """The message of an error as a column; parts are columns or values."""
    pieces, rest = [], ERRORS[kind]
    for i, p in enumerate(parts):
        head, rest = rest.split("{%d}" % i, 1)
        pieces += [F.lit(head), (p if isinstance(p, Column) else F.lit(str(p))).cast("string")]
    return F.concat(*pieces, F.lit(rest))
