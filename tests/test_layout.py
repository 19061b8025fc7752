"""Layout, geometry, suppression, decoding, tables and exports."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from berkas.functions import geometry as geo
from berkas.operators import dedup, export, layout, metrics, nms, pages, recognition, results, tables, vision


def words(spark, rows):
    return spark.createDataFrame(rows, "doc int, idx int, text string, min_x double, min_y double, max_x double, max_y double, conf double")


def lines_by_rule(boxes):
    """Reading order of one page, written out with loops: boxes (idx, x0, y0, x1, y1)."""
    groups = []
    for b in sorted(boxes, key=lambda b: (b[2], b[0])):
        for g in groups:
            a = g[0]
            over = min(a[4], b[4]) - max(a[2], b[2])
            if over > 0 and over / min(max(a[4] - a[2], 1), max(b[4] - b[2], 1)) >= 0.5:
                g.append(b)
                break
        else:
            groups.append([b])
    groups.sort(key=lambda g: (g[0][2] + g[0][4]) / 2)
    return [b[0] for g in groups for b in sorted(g, key=lambda b: b[1])]


def test_sorted_lines_against_the_rule(spark):
    rng, rows, want = random.Random(1), [], {}
    for doc in range(60):
        bs = []
        for i in range(rng.randint(1, 14)):
            x, y = rng.randint(0, 5) * 20.0, rng.randint(0, 8) * 5.0
            bs.append((i, x, y, x + 15, y + rng.choice([0, 8, 10])))
        want[doc] = lines_by_rule(bs)
        rows += [(doc, i, "w", a, b, c, d, 0.9) for i, a, b, c, d in bs]
    got = {}
    for r in layout.sorted_lines(words(spark, rows), ["doc"]).orderBy("doc", "pos").collect():
        got.setdefault(r["doc"], []).append(r["idx"])
    assert got == want


def test_grouped_lines_edges(spark):
    rows = [(1, 0, "a", 0.0, 0.0, 9.0, 10.0, 0.5), (1, 1, "b", 10.0, 5.0, 19.0, 15.0, 1.0), (1, 2, "c", 0.0, 10.1, 9.0, 20.1, 1.0), (2, 0, None, 0.0, 0.0, 1.0, 0.0, 0.2)]
    g = layout.grouped_lines(words(spark, rows), ["doc"])
    assert [r["line_no"] for r in g.orderBy("doc", "idx").collect()] == [1, 1, 2, 1]  # exactly half a height stays on the line
    t = {r["doc"]: r["text"] for r in layout.page_text(layout.line_table(g, ["doc"]), ["doc"]).collect()}
    assert t == {1: "a b\nc", 2: ""}
    assert layout.page_text(layout.line_table(g.limit(0), ["doc"]), ["doc"]).count() == 0


def test_two_columns(spark):
    left = [(1, i, "l", 0.0, i * 20.0, 100.0, i * 20.0 + 10, 1.0) for i in range(3)]
    right = [(1, 3 + i, "r", 200.0, i * 20.0, 300.0, i * 20.0 + 10, 1.0) for i in range(3)]
    head = [(1, 6, "h", 50.0, 0.0, 250.0, 10.0, 1.0)]
    got = layout.reading_columns(words(spark, right + left + head), ["doc"]).orderBy("pos").collect()
    assert [r["idx"] for r in got] == [0, 1, 2, 3, 4, 5]  # the spanning box is left out
    got = layout.reading_columns(words(spark, right[:2] + left + head), ["doc"]).orderBy("pos").collect()
    assert [r["idx"] for r in got] == [0, 1, 2, 3, 4, 6]


def test_suppression(spark):
    b = [(1, 0, 0.8, 0.0, 0.0, 10.0, 10.0), (1, 1, 0.9, 1.0, 1.0, 11.0, 11.0), (1, 2, 0.7, 50.0, 50.0, 60.0, 60.0)]
    df = spark.createDataFrame(b, "doc int, idx int, conf double, x0 double, y0 double, x1 double, y1 double").withColumn("b", geo.box("x0", "y0", "x1", "y1"))
    got = nms.kept_boxes(df, ["doc"], 0.5).orderBy("rank").collect()
    assert [(r["idx"], r["conf"]) for r in got] == [(1, 0.9), (2, 0.7)]
    assert nms.kept_boxes(df.limit(0), ["doc"]).count() == 0


def test_decoding(spark):
    steps = [(1, t, c, p) for t, (c, p) in enumerate([(1, 0.9), (1, 0.9), (0, 0.9), (1, 0.8), (99, 0.5), (0, 0.9), (99, 0.1), (2, 0.7)])]
    r = recognition.greedy_text(spark.createDataFrame(steps, "crop int, t int, cls int, p double"), ["crop"], ["a", "b"]).first()
    assert r["text"] == "aa b" and abs(r["conf"] - (0.9 + 0.8 + 0.5 + 0.7) / 4) < 1e-9
    r = recognition.greedy_text(spark.createDataFrame([(1, 0, 0, 0.9)], "crop int, t int, cls int, p double"), ["crop"], ["a"]).first()
    assert (r["text"], r["conf"]) == ("", 0.0)


def test_scorer_errors_stay_in_rows(spark):
    df = spark.createDataFrame([(1, "x"), (2, "bad"), (3, "y")], "i int, content string")

    def scorer(items):
        if "bad" in items:
            raise ValueError("no")
        return [(s.upper(), 0.9) for s in items]

    got = {r["i"]: (r["text"], r["error"]) for r in recognition.scored(df, "content", scorer).collect()}
    assert got[1] == ("X", None) and got[3] == ("Y", None) and got[2] == (None, "Inference failed: no")
    assert recognition.scored(df, "content", None).where("error like 'Model not found%'").count() == 3


def test_nearest_rank(spark):
    df = spark.createDataFrame([("a", float(v)) for v in (4, 1, 3, 2)] + [("b", 5.0), ("b", None), ("c", None), (None, 2.0)], "k string, v double")
    got = {r["k"]: (r["n"], r["p50"], r["p99"]) for r in metrics.nearest_rank(df, ["k"], "v").collect()}
    assert got == {"a": (4, 3.0, 4.0), "b": (1, 5.0, 5.0), None: (1, 2.0, 2.0)}
    assert metrics.nearest_rank(df, [], "v").first()["n"] == 6


def test_nearest_rank_of_large_groups(spark):
    """Groups above the size that a task sorts are narrowed down range by range, with the same result."""
    rows = [(g, float(x)) for g, xs in (("a", range(-400, 900)), (None, [5.0] * 700 + [7.5, 1e300, -1e300, 0.1]), ("b", [x**3 / 7 for x in range(600)]), ("c", [1.0, 2.0])) for x in xs]
    df = spark.createDataFrame(rows, "k string, v double")
    for keys in (["k"], []):
        whole, parts = (sorted((tuple(r)[:-1] for r in metrics.nearest_rank(df, keys, "v", sortable=k).collect()), key=str) for k in (10_000, 20))
        assert whole == parts


def test_word_error_of_long_texts(spark):
    many = [f"w{i}" for i in range(700)]
    df = spark.createDataFrame([(" ".join(many), " ".join(many[1:] + ["x"])), (None, "a"), ("", ""), ("a", "")], "r string, h string")
    got = [r[0] for r in df.select(metrics.word_error(F.col("r"), F.col("h"))).collect()]
    assert abs(got[0] - 2 / 700) < 1e-12 and got[1:] == [None, 0.0, 1.0]


def test_error_rates(spark):
    df = spark.createDataFrame([("", ""), ("", "x"), ("abcd", "abxd"), ("a b c", "a x c d"), ("ab", "zzzzzz")], "r string, h string")
    got = df.select(metrics.character_error(F.col("r"), F.col("h")).alias("c"), metrics.word_error(F.col("r"), F.col("h")).alias("w")).collect()
    assert [r["c"] for r in got] == [0.0, 1.0, 0.25, pytest.approx(3 / 5), 1.0] and [round(r["w"], 4) for r in got] == [0.0, 1.0, 1.0, 0.6667, 1.0]


def test_tables(spark):
    df = spark.createDataFrame([(1, 0, 0, 'a,"b'), (1, 0, 1, "é"), (1, 1, 0, "x")], "doc int, row_no int, col_no int, text string")
    m = tables.matrix(df, ["doc"])
    assert m.select(tables.csv_text(F.col("rows"))).first()[0] == '"a,""b",é\nx\n'
    assert m.select(tables.markdown_text(F.col("rows"))).first()[0] == '| a,"b | é   |\n|------|-----|\n| x    |     |\n'
    assert spark.createDataFrame([([],)], "rows array<array<string>>").select(tables.markdown_text(F.col("rows"))).first()[0] == ""


def test_new_text(spark):
    native = spark.createDataFrame([(1, "Hello   World\nabc")], "page int, native_text string")
    ocr = spark.createDataFrame([(1, 0, "hello world", 0.9), (1, 1, "say hello world now", 0.9), (1, 2, "abc", 0.8), (1, 3, "abcd", 0.8), (1, 4, " ", 0.1), (1, 5, "new", 0.7), (1, 6, "new", 0.5), (2, 0, "abc", 0.5)], "page int, idx int, text string, conf double")
    kept = dedup.new_text(ocr, dedup.native_lines(native, ["page"]), ["page"])
    assert sorted((r["page"], r["idx"]) for r in kept.collect()) == [(1, 3), (1, 5), (1, 6), (2, 0)]


def test_page_routes(spark):
    p = spark.createDataFrame([(1, "own", 0, None, None), (2, "own", 1, None, None), (3, "...", 0, "read", 0.5), (4, None, 1, None, None), (5, "", 0, None, None)], "page int, native_text string, n_images int, rendered_text string, rendered_conf double").withColumn("rendered_width", F.lit(10)).withColumn("rendered_height", F.lit(20))
    ocr = spark.createDataFrame([(2, 0, "extra words", 0.6), (4, 0, "a", 0.4), (4, 1, "", 0.2)], "page int, idx int, text string, conf double")
    got = {r["page"]: (r["source"], r["text"], round(r["confidence"], 4)) for r in pages.routed_pages(p, ocr, ["page"]).collect()}
    assert got == {1: ("native_text", "own", 1.0), 2: ("mixed", "own\nextra words", 0.6), 3: ("ocr", "read", 0.5), 4: ("ocr", "a", 0.3), 5: ("native_text", "", 1.0)}
    d = pages.document_or_error(spark.createDataFrame([(1, 1, "a", 1.0, None), (1, 2, "", 0.5, "bad page")], "doc int, page_number int, text string, confidence double, error string"), ["doc"]).first()
    assert d["text"] is None and d["error"] == "bad page" and d["n_pages"] == 2


def test_filter_by_confidence(spark):
    w = words(spark, [(1, 0, "a", 0.0, 0.0, 1.0, 1.0, 0.9), (1, 1, "b", 0.0, 9.0, 1.0, 10.0, 0.1), (2, 0, "c", 0.0, 0.0, 1.0, 1.0, 0.2)])
    ln = layout.line_table(layout.grouped_lines(w, ["doc"]), ["doc"])
    got = {r["doc"]: (r["n_regions"], r["n_lines"], r["confidence"], r["text"]) for r in results.by_confidence(w, ln, ["doc"], 0.5).collect()}
    assert got == {1: (1, 1, 0.9, "a"), 2: (0, 0, 0.0, "")}


def test_searchable_pdf(spark):
    w = words(spark, [(1, 0, "a (b) \\ é", 1.0, 2.0, 30.0, 12.0, 0.9)])
    p = spark.createDataFrame([(1, 40, 20)], "doc int, width int, height int")
    s = export.text_layer(layout.line_table(layout.grouped_lines(w, ["doc"]), ["doc"]), p, ["doc"]).first()["stream"]
    assert "/F1 9.00 Tf\n1 0 0 1 1.00 8.00 Tm\n(a \\(b\\) \\\\  ) Tj\n" in s and s.startswith("q\n40 0 0 20 0 0 cm\n")
    pdf = export.searchable_pdf(bytes(40 * 20 * 3), 40, 20, s)
    at = int(pdf.split(b"startxref\n")[1].split(b"\n")[0])
    assert pdf[at : at + 4] == b"xref" and pdf.startswith(b"%PDF-1.4") and pdf.endswith(b"%%EOF\n")
    with pytest.raises(ValueError):
        export.searchable_pdf(b"", 0, 1, s)


def test_pixels():
    rng = np.random.default_rng(0)
    g = rng.integers(0, 256, (9, 11)).astype(np.uint8)
    assert abs(vision.variance(g) - g.astype(float).var()) < 1e-6
    assert (vision.box_blur(np.full((4, 4), 7, np.uint8)) == 7).all()
    flat = np.full((20, 20, 3), 100, np.uint8)
    assert (vision.enhanced(flat) == flat).all() and (vision.deskewed(flat, 0.2) == flat).all()
    assert vision.resized(flat, 7, 5).shape == (5, 7, 3) and (vision.resized(flat, 7, 5) == 100).all()
    x, sx, sy = vision.detector_input(np.zeros((100, 1920, 3), np.uint8))
    assert x.shape == (3, 64, 960) and sx == 2.0
    assert vision.recogniser_batch([np.zeros((48, 20, 3), np.uint8), np.zeros((48, 100, 3), np.uint8)]).shape == (2, 3, 48, 100)
    prob = np.zeros((12, 12))
    prob[1:5, 1:6] = prob[8:11, 8:12] = 0.9
    prob[6, 0] = 0.9
    assert len(vision.contours(prob)) == 2
    assert vision.quad_crop(flat, np.array([[2, 2], [12, 4], [12, 9], [2, 7]])).shape[2] == 3
    assert vision.quad_crop(flat, np.array([[2, 2], [3, 2], [3, 3], [2, 3]])) is None
    assert (vision.outlined(flat, [(np.array([[5, 5], [10, 5], [10, 10]]), (1, 2, 3))])[5, 7] == (1, 2, 3)).all()
    assert vision.quarter_turns(g, 1).shape == (11, 9)
