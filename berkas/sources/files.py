"""Files and bytes as rows: what they are, whether they may be read, and what failed."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from berkas.config import Config, error_text

# Formats, media types and file endings.
FORMATS = ["jpeg", "jpg", "png", "webp", "bmp", "tiff", "tif", "pdf"]
MIME = {"jpeg": "image/jpeg", "png": "image/png", "webp": "image/webp", "bmp": "image/bmp", "tiff": "image/tiff", "pdf": "application/pdf", "unknown": "application/octet-stream"}
SUPPORTED = ", ".join(FORMATS)


def kind_of_source(source: Column) -> Column:
    """'url' or 'file'."""
    s = F.trim(source)
    return F.when(s.startswith("http://") | s.startswith("https://"), "url").otherwise("file")


def sniffed(content: Column) -> Column:
    """The format of bytes by their first ones; `empty_or_too_small` under four, `magic_bytes(...)` for unknown ones."""
    h = F.hex(F.substring(content, 1, 12))
    n = F.octet_length(content)
    at = lambda a, b: F.substring(h, 2 * a + 1, 2 * (b - a))
    return (
        F.when(F.coalesce(n, F.lit(0)) < 4, "empty_or_too_small").when(at(0, 4) == "25504446", "pdf").when(at(0, 4) == "89504E47", "png").when(at(0, 3) == "FFD8FF", "jpeg")
        .when((at(0, 4) == "52494646") & (n >= 12) & (at(8, 12) == "57454250"), "webp").when(at(0, 2) == "424D", "bmp").when(at(0, 4).isin("49492A00", "4D4D002A"), "tiff")
        .otherwise(F.concat(F.lit("magic_bytes("), at(0, 4), F.lit(")")))
    )


def supported(fmt: Column) -> Column:
    return fmt.isin([f for f in MIME if f != "unknown"])


def mime_type(fmt: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in MIME.items() for x in kv]), fmt), F.lit(MIME["unknown"]))


def extension(path: Column) -> Column:
    """The ending of a file name without its point, lower case; '' where there is none."""
    name = F.regexp_replace(path, r"^.*[/\\]", "")
    return F.lower(F.regexp_extract(name, r"^.+\.([^.]*)$", 1))


def extension_accepted(path: Column) -> Column:
    """Whether a path has a supported ending or none."""
    e = extension(path)
    return (e == "") | e.isin(FORMATS)


def formats(spark: SparkSession) -> DataFrame:
    """The supported endings, in order."""
    return spark.createDataFrame([(i, f) for i, f in enumerate(FORMATS)], "pos int, format string")


def guarded(files: DataFrame, config: Config = Config()) -> DataFrame:
    """files (path, length, width, height, pages; nulls where not known) with `error`, the first reason against reading."""
    big = F.col("length") > config.max_file_size
    over = (F.col("width") > config.max_image_width) | (F.col("height") > config.max_image_height)
    return files.withColumn(
        "error",
        F.when(~extension_accepted(F.col("path")), error_text("UnsupportedFormat", extension(F.col("path")), SUPPORTED))
        .when(big, error_text("ImageTooLarge", F.concat(F.col("length").cast("string"), F.lit(f" bytes exceeds limit of {config.max_file_size}"))))
        .when((F.col("width") == 0) | (F.col("height") == 0), error_text("InvalidImage", "Image has zero dimensions"))
        .when(over, error_text("ImageTooLarge", F.concat(F.col("width").cast("string"), F.lit("x"), F.col("height").cast("string"), F.lit(f" exceeds {config.max_image_width}x{config.max_image_height}"))))
        .when(F.col("pages") > config.max_pdf_pages, error_text("PdfTooManyPages", F.concat(F.col("pages").cast("string"), F.lit(f" pages exceeds limit of {config.max_pdf_pages}")))),
    )


def read_files(spark: SparkSession, path: str, config: Config = Config()) -> DataFrame:
    """Files of a folder or pattern as (path, length, modificationTime, content, format, error); a file that is too large
    is not read: the limit is pushed down to the listing, and such files come with an error and no content."""
    every = spark.read.format("binaryFile").load(path)
    small = every.where(F.col("length") <= config.max_file_size).withColumn("format", sniffed(F.col("content")))
    fine = small.withColumn("error", F.when(~supported(F.col("format")), error_text("UnsupportedFormat", F.col("format"), SUPPORTED)))
    large = every.where(F.col("length") > config.max_file_size).select("path", "length", "modificationTime", F.lit(None).cast("binary").alias("content"), F.lit(None).cast("string").alias("format"), error_text("ImageTooLarge", F.concat(F.col("length").cast("string"), F.lit(f" bytes exceeds limit of {config.max_file_size}"))).alias("error"))
    return fine.select(*large.columns).unionAll(large)


def read_paths(spark: SparkSession, df: DataFrame, column: str, config: Config = Config()) -> DataFrame:
    """df (paths in `column`, as many as the caller listed) with path, content and error: the contents of all paths that
    exist are read in one job; a path that does not, is too large or has a wrong ending has an error and no content."""
    rows = [r[0] for r in df.select(column).distinct().collect() if r[0] and r[0].strip()]
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    real = {}
    for p in rows:
        try:
            at = jvm.org.apache.hadoop.fs.Path(p.strip())
            fs = at.getFileSystem(conf)
            if fs.exists(at) and fs.getFileStatus(at).isFile():
                real[p] = fs.makeQualified(at).toString()
        except Exception:  # noqa: BLE001, S112
            continue
    there = spark.createDataFrame(list(real.items()) or [("", "")], f"{column} string, path string")
    if not real:
        return df.withColumns({"path": F.lit(None).cast("string"), "content": F.lit(None).cast("binary"), "error": error_text("IoError", F.concat(F.lit("no such file: "), F.coalesce(column, F.lit(""))))})
    got = spark.read.format("binaryFile").load(sorted(set(real.values())))
    small = got.where(F.col("length") <= config.max_file_size).select("path", "content")
    size = got.select("path", "length")
    x = df.join(there, column, "left").join(size, "path", "left").join(small, "path", "left")
    e = guarded(x.withColumns({c: F.lit(None).cast("int") for c in ("width", "height", "pages")}), config)
    missing = error_text("IoError", F.concat(F.lit("no such file: "), F.coalesce(column, F.lit(""))))
    return e.withColumn("error", F.when(F.col("path").isNull(), missing).otherwise(F.col("error"))).select(*df.columns, "path", "content", "error")


def decoded(content: bytes) -> tuple[int, int, bytes]:
    """(height, width, blue-green-red bytes) of an image; PNG and BMP by themselves, other formats where Pillow is there."""
    import struct
    import zlib

    import numpy as np

    if content[:8] == b"\x89PNG\r\n\x1a\n" and content[28:29] == b"\0" and content[24] == 8:
        w, h = struct.unpack(">II", content[16:24])
        colours = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[content[25]]
        at, data, palette = 8, b"", b""
        while at < len(content):
            n, kind = struct.unpack(">I4s", content[at : at + 8])
            body = content[at + 8 : at + 8 + n]
            data, palette = data + body if kind == b"IDAT" else data, body if kind == b"PLTE" else palette
            at += 12 + n
        raw = np.frombuffer(zlib.decompress(data), np.uint8).reshape(h, 1 + w * colours)
        px = np.zeros((h, w * colours), np.uint8)
        for y in range(h):
            kind, row, up = raw[y, 0], raw[y, 1:], px[y - 1] if y else np.zeros(w * colours, np.uint8)
            if kind == 0:
                px[y] = row
            elif kind == 2:
                px[y] = row + up
            elif kind == 1:
                px[y] = np.add.accumulate(row.reshape(w, colours), axis=0, dtype=np.uint8).ravel()
            else:
                out = [0] * (w * colours)
                for i, v in enumerate(row.tolist()):
                    a = out[i - colours] if i >= colours else 0
                    b = int(up[i])
                    c = int(up[i - colours]) if i >= colours else 0
                    if kind == 3:
                        guess = (a + b) // 2
                    else:
                        pa, pb, pc = abs(b - c), abs(a - c), abs(a + b - 2 * c)
                        guess = a if pa <= pb and pa <= pc else b if pb <= pc else c
                    out[i] = (v + guess) & 255
                px[y] = out
        px = px.reshape(h, w, colours)
        rgb = np.frombuffer(palette, np.uint8).reshape(-1, 3)[px[..., 0]] if content[25] == 3 else px[..., :3] if colours >= 3 else np.repeat(px[..., :1], 3, 2)
        return h, w, rgb[..., ::-1].tobytes()
    if content[:2] == b"BM" and struct.unpack("<H", content[28:30])[0] in (24, 32) and struct.unpack("<I", content[30:34])[0] == 0:
        start, w, h, bits = struct.unpack("<I", content[10:14])[0], *struct.unpack("<ii", content[18:26]), struct.unpack("<H", content[28:30])[0]
        step = (w * bits // 8 + 3) // 4 * 4
        px = np.frombuffer(content, np.uint8, step * abs(h), start).reshape(abs(h), step)[:, : w * bits // 8].reshape(abs(h), w, bits // 8)[..., :3]
        return abs(h), w, (px[::-1] if h > 0 else px).tobytes()
    try:
        import io

        from PIL import Image
    except ImportError:
        raise ValueError("no decoder for this format") from None
    img = np.asarray(Image.open(io.BytesIO(content)).convert("RGB"))
    return img.shape[0], img.shape[1], img[..., ::-1].tobytes()


def decoded_images(files: DataFrame) -> DataFrame:
    """files (content, format, error, path or null) with height, width and data in place of the content. Files with a path
    in a format that Python has no decoder for are left to the JVM's image source by `Engine.recognise_files`."""

    @F.pandas_udf("struct<height:int,width:int,data:binary,error:string>")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for contents, errors in batches:
            out = []
            for c, e in zip(contents, errors):
                if isinstance(e, str) or c is None:
                    out.append((None, None, None, e if isinstance(e, str) else "Invalid image: no content"))
                    continue
                try:
                    out.append((*decoded(bytes(c)), None))
                except Exception as x:  # noqa: BLE001
                    out.append((None, None, None, f"Invalid image: {x}"))
            yield pd.DataFrame(out, columns=["height", "width", "data", "error"]).astype({"height": "Int32", "width": "Int32"})

    x = files.withColumn("_d", run("content", "error"))
    return x.select(*[c for c in files.columns if c not in ("content", "error")], "_d.height", "_d.width", "_d.data", "_d.error")


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """Images as (path, height, width, n_channels, mode, data), pixels blue-green-red; an image that cannot be decoded has
    width -1."""
    return spark.read.format("image").option("dropInvalid", False).load(path).select(F.col("image.origin").alias("path"), "image.height", "image.width", F.col("image.nChannels").alias("n_channels"), "image.mode", "image.data")


def fetched(urls: DataFrame, column: str, config: Config = Config()) -> DataFrame:
    """urls with `content` and `error`: each fetched with a time limit; one that is larger than allowed or fails has an
    error, and the others go on."""
    limit, timeout = config.max_url_download_size, config.url_timeout_secs

    @F.pandas_udf("struct<content:binary,error:string>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        from urllib.request import Request, urlopen

        for s in batches:
            out = []
            for u in s:
                try:
                    with urlopen(Request((u or "").strip(), headers={"User-Agent": "berkas"}), timeout=timeout) as r:
                        data = r.read(limit + 1)
                    out.append((None, f"Image too large: download exceeds limit of {limit} bytes") if len(data) > limit else (data, None))
                except Exception as e:  # noqa: BLE001
                    out.append((None, f"Network error: {e}"))
            yield pd.DataFrame(out, columns=["content", "error"])

    return urls.withColumn("_f", run(F.col(column))).select(*urls.columns, "_f.content", "_f.error")
