"""Images to text with stand-in models, files with errors, PDF pages, annotated images and searchable PDFs."""

import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from berkas import models
from berkas.config import Config
from berkas.engine import Engine
from berkas.operators import export, pages, pipeline, vision
from berkas.session import clear_stored, scratch, stored
from berkas.sources.files import decoded


def picture(boxes, w=320, h=192):
    img = np.full((h, w, 3), 250, np.uint8)
    for (x0, y0, x1, y1), value in boxes:
        img[y0:y1, x0:x1] = value
    return img


BOXES = [((20, 20, 140, 44), (200, 10, 10)), ((180, 22, 300, 46), (10, 200, 10)), ((20, 100, 200, 130), (10, 10, 200))]


def stand_ins():
    """A detector to which coloured pixels are text, and a recogniser that names the colour; nested, so that they travel."""

    def detector(tensor):
        rgb = tensor[0].transpose(1, 2, 0) * vision.DEVIATION + vision.MEAN
        return np.where(rgb.max(2) - rgb.min(2) > 0.3, 0.9, 0.0)

    def recogniser(crops):
        names = {0: "merah", 1: "hijau", 2: "biru"}
        return [(names[int(c.reshape(-1, 3).min(0).argmax())], 0.5 if c.shape[1] > 180 else 0.95) for c in crops]

    return detector, recogniser


detector, recogniser = stand_ins()


def png(img, kind=0):
    h, w = img.shape[:2]
    raw, prev = b"", np.zeros(w * 3, np.uint8)
    for row in img.reshape(h, -1):
        raw += bytes([kind]) + (row if kind == 0 else row - prev).tobytes()
        prev = row
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def test_read_image():
    got = pipeline.read_image(picture(BOXES), detector, recogniser, Config())
    assert sorted(t for _, t, _ in got) == ["biru", "hijau", "merah"]
    for (x0, y0, x1, y1), _ in BOXES:
        assert any(np.abs(q.min(0) - [x0, y0]).max() < 25 and np.abs(q.max(0) - [x1, y1]).max() < 25 for q, _, _ in got)
    # a reading that is worse is not taken, one below the threshold is left out
    assert {t: s for _, t, s in got}["biru"] == 0.5
    assert len(pipeline.read_image(picture(BOXES), detector, recogniser, Config(rec_threshold=0.6))) == 2
    assert pipeline.read_image(picture([]), detector, recogniser) == []


def test_second_pass_and_skew():
    calls = []

    def better(crops):
        calls.append(len(crops))
        return [("a" if len(calls) == 1 else "b", 0.5 if len(calls) == 1 else 0.8)] * len(crops)

    assert {(t, s) for _, t, s in pipeline.read_image(picture(BOXES), detector, better, Config())} == {("b", 0.8)}
    tilted = vision.deskewed(picture([((60, 80, 260, 104), (200, 10, 10))]), -6)
    regions = pipeline.detected(tilted, detector, Config())
    assert 4 < pipeline.skew(regions) < 8
    (quad, _, _), = pipeline.read_image(tilted, detector, recogniser, Config(enhancement_enabled=False))
    assert abs(pipeline.skew([(quad, 1.0)])) < 1.5


def test_recognise_files(spark, tmp_path):
    a, b = tmp_path / "a.png", tmp_path / "b.png"
    a.write_bytes(png(picture(BOXES)))
    b.write_bytes(png(picture([]), 2))
    (tmp_path / "c.png").write_bytes(b"\x89PNG broken file")
    (tmp_path / "d.docx").write_bytes(b"PK")
    e = Engine(spark, Config(url_timeout_secs=1), recogniser=recogniser, detector=detector)
    sources = [str(b), "http://127.0.0.1:9/x", str(a), str(tmp_path / "none.png"), str(tmp_path / "c.png"), str(tmp_path / "d.docx"), str(a)]
    got = e.recognise_files(sources).collect()
    assert [r["source"] for r in got] == sources
    assert [r["text"] for r in got] == ["", None, "merah hijau\nbiru", None, None, None, "merah hijau\nbiru"]
    assert [r["n_regions"] for r in got] == [0, None, 3, None, None, None, 3]
    errors = [r["error"] for r in got]
    assert errors[1].startswith("Network error") and errors[3].startswith("IO error: no such file") and errors[4].startswith("Invalid image") and errors[5].startswith("Unsupported file format 'docx'")
    none = Engine(spark).recognise_files([str(a)]).first()
    assert none["text"] is None and none["error"].startswith("Model not found")
    assert Engine.auto(spark).recognise_files([str(a)]).first()["error"].startswith("Model not found")


def test_decoding():
    img = picture(BOXES)
    for kind in (0, 2):
        h, w, data = decoded(png(img, kind))
        assert (h, w) == img.shape[:2] and data == img[..., ::-1].tobytes()
    with pytest.raises(ValueError):
        decoded(b"GIF89a")


def test_models(tmp_path, monkeypatch):
    monkeypatch.setenv("OCR_MODEL_DIR", str(tmp_path))
    (tmp_path / "ppocrv6_small_det.onnx").write_bytes(b"x")
    (tmp_path / "ppocrv6_keys.txt").write_text("a\nb\n")
    c = models.resolved(Config())
    assert c.detection_model_path.endswith("ppocrv6_small_det.onnx") and c.recognition_model_path.endswith("PP-OCRv6_rec_small.onnx")
    assert models.characters(str(tmp_path / "other.txt")) == ["a", "b"]
    probs = np.array([[0.1, 0.9, 0, 0], [0.1, 0.9, 0, 0], [0.9, 0.1, 0, 0], [0, 0.8, 0, 0.1], [0, 0, 0, 0.6]])
    assert models.greedy(probs, ["a", "b"]) == ("aa", pytest.approx((0.9 + 0.8 + 0.6) / 3))
    models.warmed(None, None)
    assert models.pdf_library(Config()) is None
    monkeypatch.setenv("PDFIUM_PATH", str(tmp_path / "ppocrv6_keys.txt"))
    assert models.pdf_library(Config()).endswith("keys.txt") and models.pdf_library(Config(pdf_library_path=str(tmp_path / "ppocrv6_small_det.onnx"))).endswith("det.onnx")


def test_pdf_pages(spark):
    df = spark.createDataFrame([(1, b"good"), (2, b"bad"), (3, b"long")], "id long, content binary")

    class Page:
        def __init__(self, text, images=(), broken=False):
            self.text, self.images, self.broken = text, images, broken

        def render(self, width):
            if self.broken:
                raise OSError("no")
            return 2, width, bytes(2 * width * 3)

    def parser(content):
        if content == b"bad":
            raise ValueError("cut")
        if content == b"long":
            return [Page("x")] * 60
        return [Page(" Teks "), Page("", [(200, 100, b"i"), (3, 3, b"j")]), Page("..."), Page(None, broken=True)]

    got = pages.extracted(df, parser).orderBy("id", "page_number").collect()
    assert [(r["id"], r["page_number"], r["native_text"], len(r["images"]), r["rendered"] is not None, r["error"]) for r in got] == [
        (1, 1, "Teks", 0, False, None), (1, 2, "", 1, False, None), (1, 3, "...", 0, True, None), (1, 4, "", 0, False, "PDF rendering failed: no"),
        (2, None, None, 0, False, "Invalid PDF: cut"), (3, None, None, 0, False, "PDF too many pages: 60 pages exceeds limit of 50"),
    ]
    assert pages.extracted(df, None).where("error = 'Invalid PDF: no PDF library was given'").count() == 3


def test_drawn_and_searchable(spark):
    img = picture([], 40, 30)
    images = spark.createDataFrame([(1, 30, 40, bytearray(img[..., ::-1].tobytes())), (2, 0, 0, None)], "doc long, height int, width int, data binary")
    quad = [{"x": x, "y": y} for x, y in ((5.0, 5.0), (30.0, 5.0), (30.0, 20.0), (5.0, 20.0))]
    regions = spark.createDataFrame([(1, quad, 0.95)], "doc long, polygon array<struct<x:double,y:double>>, conf double")
    out = {r["doc"]: r["data"] for r in vision.annotated(images, regions, ["doc"]).collect()}
    drawn = np.frombuffer(out[1], np.uint8).reshape(30, 40, 3)
    assert tuple(drawn[5, 10][::-1]) == (34, 197, 94) and tuple(drawn[12, 12]) == (250, 250, 250) and out[2] is None
    lines = spark.createDataFrame([(1, 1, "Nilai (satu)", 5.0, 5.0, 30.0, 20.0)], "doc long, line_no int, text string, min_x double, min_y double, max_x double, max_y double")
    layer = export.text_layer(lines, images.select("doc", "width", "height"), ["doc"])
    pdf = {r["doc"]: (r["pdf"], r["error"]) for r in export.searchable_pdfs(images, layer, ["doc"]).collect()}
    assert bytes(pdf[1][0]).startswith(b"%PDF-1.4") and b"(Nilai \\(satu\\)) Tj" in bytes(pdf[1][0]) and pdf[2][1].startswith("Invalid image")


def test_stored_tables_can_be_deleted(spark):
    clear_stored()
    with scratch():
        t = stored(spark.range(5))
        path = t.inputFiles()[0]
        assert t.count() == 5
    assert clear_stored() == 0
    with pytest.raises(Exception):
        spark.read.parquet(path).count()


def test_json(spark):
    import json

    w = spark.createDataFrame([(1, 0, 1, "a", 0.5, 0.0, 0.0, 5.0, 5.0), (1, 1, 1, "b", 1.0, 6.0, 0.0, 9.0, 6.0), (1, 2, 2, None, 0.9, 0.0, 9.0, 5.0, 12.0)], "doc long, idx int, line_no int, text string, conf double, min_x double, min_y double, max_x double, max_y double")
    d = json.loads(export.document_json(w, ["doc"]).first()["json"])
    assert d["text"] == "a b\n" and d["confidence"] == pytest.approx(0.8) and [x["text"] for x in d["lines"]] == ["a b", ""] and d["regions"][1]["bbox"] == {"min_x": 6.0, "min_y": 0.0, "max_x": 9.0, "max_y": 6.0}
    items = spark.createDataFrame([(1, 1, "y", False, None, "bad", 3), (1, 0, "x", True, "t", None, 4)], "doc long, pos int, source string, success boolean, text string, error string, duration_ms long")
    b = json.loads(export.batch_json(items, ["doc"]).first()["json"])
    assert [i["source"] for i in b["items"]] == ["x", "y"] and (b["total"], b["succeeded"], b["failed"], b["total_duration_ms"]) == (2, 1, 1, 7) and b["items"][1]["text"] is None
    p = spark.createDataFrame([(1, 2, "ocr", "dua", 0.5, 10, 20), (1, 1, "native_text", "satu", 1.0, 10, 20)], "doc long, page_number int, source string, text string, confidence double, width int, height int")
    j = json.loads(export.pages_json(p, ["doc"], pretty=True).first()["json"])
    assert j["text"] == "satu\n\ndua" and j["confidence"] == 0.75 and j["pages"][0]["dimensions"] == [10, 20]


def test_command_line(spark, tmp_path, capsys):
    import json

    from berkas.__main__ import main

    a = tmp_path / "a.png"
    a.write_bytes(png(picture(BOXES)))
    e = Engine(spark, recogniser=recogniser, detector=detector)
    assert main([str(a), "--searchable-pdf", str(tmp_path / "pdf"), "--annotate", str(tmp_path / "marked")], e) == 0
    assert capsys.readouterr().out == "merah hijau\nbiru\n"
    assert (tmp_path / "pdf" / "a.png.pdf").read_bytes().count(b"Tj") == 2
    assert spark.read.parquet(str(tmp_path / "marked")).count() == 1
    assert main([str(a), "--format", "json", "--no-deskew"], e) == 0
    assert [x["text"] for x in json.loads(capsys.readouterr().out)["lines"]] == ["merah hijau", "biru"]
    assert main([str(a)], Engine(spark)) == 1 and "Model not found" in capsys.readouterr().err
    assert main(["x.pdf"], e) == 1 and main(["info"]) == 0 and main([str(a), "--lang", "xx"], e) == 2
    words = spark.createDataFrame([(1, 1, 0, "Nama: Sari", 0.9, 0.0, 0.0, 9.0, 9.0)], "doc long, page int, idx int, text string, conf double, min_x double, min_y double, max_x double, max_y double")
    words.write.parquet(str(tmp_path / "w"))
    capsys.readouterr()
    assert main([str(tmp_path / "w"), "--schema", "key-values"], e) == 0
    assert json.loads(capsys.readouterr().out) == {"key_values": [{"key": "Nama", "value": "Sari"}]}
