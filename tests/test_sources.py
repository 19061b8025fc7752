"""Files, settings, the queries' SQL, and streams."""

import re
import struct
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from berkas.config import Config, error_text, language_of
from berkas.engine import Engine
from berkas.operators import vision
from berkas.sources import files
from berkas.streaming.files import file_stream, timing_counts


def png(w, h, rgb):
    raw = b"".join(b"\0" + bytes(rgb) * w for _ in range(h))
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def test_files_and_images(spark, tmp_path):
    (tmp_path / "a.png").write_bytes(png(6, 4, (10, 20, 30)))
    (tmp_path / "b.bin").write_bytes(b"PK\x03\x04rest")
    (tmp_path / "c.pdf").write_bytes(b"%PDF-1.4 " + bytes(100))
    got = {r["path"].rsplit("/", 1)[1]: (r["format"], r["error"]) for r in files.read_files(spark, str(tmp_path), Config(max_file_size=90)).collect()}
    assert got["a.png"] == ("png", None) and got["b.bin"][1].startswith("Unsupported file format 'magic_bytes(504B0304)'") and got["c.pdf"][1].startswith("Image too large")
    img = files.read_images(spark, str(tmp_path / "a.png"))
    out = vision.mapped_pixels(img, lambda x: x + 1).first()
    assert (out["width"], out["height"], list(out["data"][:3]), out["error"]) == (6, 4, [31, 21, 11], None)


def test_settings(spark):
    c = Config().with_(rec_threshold=0.5)
    assert (c.rec_threshold, Config().rec_threshold, c.threads()[1]) == (0.5, 0.4, 1)
    df = spark.createDataFrame([(" EN ",), ("zh",), ("xx",), (None,)], "c string")
    assert [r[0] for r in df.select(language_of(F.col("c"))).collect()] == ["en", "ch", None, None]
    assert df.select(error_text("Network", "down")).first()[0] == "Network error: down"


def test_failed_downloads_stay_in_rows(spark):
    df = spark.createDataFrame([("http://127.0.0.1:9/x",), (None,)], "u string")
    assert files.fetched(df, "u", Config(url_timeout_secs=1)).where("error like 'Network error%'").count() == 2
    e = Engine(spark, Config(url_timeout_secs=1)).sources(["http://127.0.0.1:9/x", "a.png"])
    assert {r["kind"] for r in e.collect()} == {"url", "file"}


def test_file_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.png").write_bytes(png(2, 2, (0, 0, 0)))
    q = file_stream(spark, str(tmp_path / "in")).select("format", "supported").writeStream.format("memory").queryName("fs").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert [tuple(r) for r in spark.table("fs").collect()] == [("png", True)]


def test_timing_stream(spark, tmp_path):
    df = spark.createDataFrame([(1, "w", "2025-01-01 00:00:00", 5.0), (1, "w", "2025-01-01 00:00:00", 5.0), (2, "w", "2025-01-01 01:00:00", -1.0), (3, "w", "2025-01-03 01:00:00", 7.0)], "doc long, worker_id string, ts string, total_ms double").withColumn("ts", F.col("ts").cast("timestamp"))
    df.write.parquet(str(tmp_path / "t"))
    s = timing_counts(spark.readStream.schema(df.schema).parquet(str(tmp_path / "t")))
    q = s.writeStream.format("memory").queryName("tc").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert [(r["n"], r["max_ms"]) for r in spark.table("tc").collect()][:1] == [(1, 5.0)]


SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    import glob
    import os

    c = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return c


def _plain(v):
    if isinstance(v, float):
        return "nan" if v != v else round(v, 6)
    return tuple(_plain(x) for x in v) if isinstance(v, (list, tuple)) else v


@pytest.mark.parametrize("name", sorted(k for k in entry.oracle_sql() if not re.match(r"p\d", k)))
def test_queries_agree_with_sql(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    cols = sorted(df.columns)
    rel = duck.execute(entry.oracle_sql()[name])
    names = [d[0] for d in rel.description]
    assert sorted(names) == cols
    want = sorted((tuple(_plain(r[names.index(c)]) for c in cols) for r in rel.fetchall()), key=repr)
    assert sorted((tuple(_plain(r[c]) for c in cols) for r in df.collect()), key=repr) == want


def test_queries_without_sql_run(spark):
    assert entry.queries()["p1_found"](spark, SF).count() > 0
