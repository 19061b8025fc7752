"""Page noise, personal information and subjects."""

import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from berkas.llm import pagenoise as pn
from berkas.llm import pii
from berkas.llm import subjects as sj
from berkas.session import stored

NAMES = pii.Names(["LIDAR", "KUSOKUSU", "MALONI", "SITI", "KEMITA"], ["BUMIBALA", "TEGALWENING"])


def found(text, before=None):
    return [(s.kind, text[s.start : s.end]) for s in pii.find(text, NAMES, before)]


def test_kinds():
    t = "Hubungi Bapak Lidar Kusokusu di +62 (0)813 69884741 atau surel a.b-c @ pos.example. NIK 9776 0405 0680 1111; NPWP 95.625.898.5-849.567, No. SIM 258757457612."
    assert found(t) == [("person_name", "Lidar Kusokusu"), ("phone", "+62 (0)813 69884741"), ("email", "a.b-c @ pos.example"), ("id_number", "9776 0405 0680 1111"), ("id_number", "95.625.898.5-849.567"), ("id_number", "258757457612")]
    assert found("Rumah di Jl. Melati Raya, No 12A, RT 3/RW 4, Kel. Sari, Bumibala 90210 dijual. Jalan Melati ditutup.") == [("address", "Jl. Melati Raya, No 12A, RT 3/RW 4, Kel. Sari, Bumibala 90210")]


def test_what_is_none():
    for t in ("Kode resi 71545599548 bukan untuk umum", "kode unggah 07799000000095120", "Pesanan ORD0000069659", "TANGGAL: 08.01.2025", "PT Lidar Jaya menang", "nod@ tinta. Saldo", "", "Rp 42.842.500 per 23-01-2024"):
        assert found(t) == []
    assert pii.find(None, NAMES) == []


def test_context_before_and_misreadings():
    assert found("258757457612 habis") == [] and found("258757457612 habis", "No. SIM") == [("id_number", "258757457612")]
    assert found("atas nama Lidaar Kusokusu.") == [("person_name", "Lidaar Kusokusu")]
    assert found("H. Siti Maloni, S.H. dan K. Kemita hadir") == [("person_name", "Siti Maloni"), ("person_name", "K. Kemita")]


def test_checks():
    assert pii.luhn("4111111111111111") and not pii.luhn("4111111111111112") and pii.mod97("GB82 WEST 1234 5698 7654 32") and not pii.mod97("GB82WEST12345698765431")
    assert pii.nik_valid("9776044506801111") and not pii.nik_valid("9776043206801111")


def test_placeholders_and_long_texts(spark):
    t = "x Lidar, 0812-3456-7890 😀 Maloni."
    df = spark.createDataFrame([(t,), (None,), ("",), ((t + " ") * 2000,)], "t string")
    got = [r[0] for r in df.select(pii.placeholders(F.col("t"), F.lit(""), sorted(NAMES.tokens), [])).collect()]
    assert got[0] == "x [PERSON_NAME], [PHONE] 😀 [PERSON_NAME]." and got[1] is None and got[2] == "" and got[3].count("[PHONE]") == 2000
    s = df.limit(1).select(F.explode(pii.spans(F.col("t"), F.lit(""), sorted(NAMES.tokens), [])).alias("s")).collect()
    assert [t[r["s"]["start_pos"] - 1 : r["s"]["end_pos"]] for r in s] == ["Lidar", "0812-3456-7890", "Maloni"]


def test_skeletons(spark):
    pairs = [("nilai", "ni1ai"), ("surat", "5urat"), ("menunggu", "meniinggu"), ("dibahas", "dibalias"), ("kasasi", "lcasasi"), ("tahun", "taliun"), ("number", "num6er"), ("times", "tirnes"), ("daerah", "claerah"), ("perhatian", "perh@tiari")]
    assert all(pn.skeleton(a) == pn.skeleton(b) for a, b in pairs)
    df = spark.createDataFrame(pairs, "a string, b string")
    assert df.where(pn.skeleton_column(F.col("a")) != pn.skeleton_column(F.col("b"))).count() == 0
    assert all(pn._readable(b, a) for a, b in pairs) and not pn._readable("hari", "ban")


def test_numbers_and_figures():
    assert pn.page_number("- 12 -") == ("deco", 12) and pn.page_number("Halaman 3 dari 6") == ("deco", 3) and pn.page_number("iv") == ("roman", 4) and pn.page_number("pages.") == ("", -1)
    assert pn.split_number("LAPORAN X  iv") == ("LAPORAN X", "roman", 4) and pn.split_number("5  BERITA") == ("BERITA", "bare", 5)
    assert pn.figures("S.534.000 and 13.412.5OO of KB-33O5, 18 B, 12A") == [("S.534.000", "5.534.000"), ("13.412.5OO", "13.412.500"), ("KB-33O5", "KB-3305")]


def test_viterbi_against_all_paths():
    import itertools

    rng = np.random.default_rng(1)
    page = np.array([0, 0, 0, 0, 1, 2, 2])
    s = rng.normal(size=(7, len(pn.STATES))) * 3
    got = pn.viterbi(s, page, pn.MOVES)
    for p in range(3):
        at = np.flatnonzero(page == p)

        def score(path):
            t = pn.MOVES["start"][pn.STATES[path[0]]] + s[at[0], path[0]]
            for a, b, i in zip(path, path[1:], at[1:]):
                t += pn.MOVES[pn.STATES[a]][pn.STATES[b]] + s[i, b]
            return t

        best = max(itertools.product(range(len(pn.STATES)), repeat=len(at)), key=score)
        assert tuple(got[at]) == best
    assert len(pn.viterbi(np.zeros((0, 5)), np.zeros(0, int), pn.MOVES)) == 0


def scan(spark):
    """Two documents of four pages with headers, page numbers, a lone figure and a broken word."""
    rows, k = [], 0
    for doc in (1, 2):
        for page in range(1, 5):
            body = ["Menurut catatan petugas arsip, laporan ini disusun kem-", "bali oleh panitia tahun lalu. Berikutnya disampaikan", "27" if page == 2 else "secara bertahap kepada semua pihak yang hadir.", "Penutup sidang berlangsung singkat, dan semua setu-"]
            text = (["LAPORAN ARSIP"] if page > 1 else []) + body + [f"- {page} -"]
            for i, t in enumerate(text):
                rows.append((k, doc, page, i, t, 20.0 * i, 20.0 * i + 12))
                k += 1
    return spark.createDataFrame(rows, "ocr_id long, doc long, page int, idx int, text string, min_y double, max_y double")


def test_labels_and_joins(spark):
    df = scan(spark)
    lab = pn.labelled_lines(df)
    furniture = {r["text"] for r in lab.where("state in ('header', 'footer')").collect()}
    assert furniture == {"LAPORAN ARSIP", "- 1 -", "- 2 -", "- 3 -", "- 4 -"}
    f = pn.following(lab)
    nxt = {(r["doc"], r["page"], r["idx"]): r["next_text"] for r in f.collect()}
    assert nxt[1, 1, 3].startswith("Menurut") and nxt[1, 4, 4] is None
    assert any("kembali oleh" in r["text"] for r in pn.paragraphs(lab).collect())
    assert pn.labelled_lines(df.limit(0)).count() == 0


def test_steps_between_lines_without_moving_all(spark):
    rng = random.Random(3)
    texts = ["BERITA ACARA", "Selesai.", "secara bertahap kepada semua pihak yang hadir, lalu", "Penutup sidang berlangsung singkat, dan semua setuju.", "27", "kem-"]
    rows = [(1, p, i, rng.choice(texts)) for p, n in enumerate([1, 3, 6, 7, 8, 9, 25], 1) for i in range(n)]
    df = spark.createDataFrame([(k, *r, 20.0 * r[2]) for k, r in enumerate(rows)], "ocr_id long, doc long, page int, idx int, text string, min_y double")
    y = stored(pn.featured(df))
    seen, last = Counter(), {}
    for r in y.orderBy("page", "idx").collect():
        if r["seed"] is not None and last.get(r["page"], "start") is not None:
            seen[last.get(r["page"], "start"), pn.STATES[r["seed"]]] += 1
        last[r["page"]] = None if r["seed"] is None else pn.STATES[r["seed"]]
    move = pn.fitted(y)["move"]
    for a, row in pn.MOVES.items():
        prior = {b: np.exp(w) for b, w in row.items() if w > pn._NO}
        c = {b: seen[a, b] + w * pn.PRIOR / sum(prior.values()) for b, w in prior.items()}
        assert all(abs(move[a][b] - np.log(c[b] / sum(c.values()))) < 1e-9 for b in c)
    assert sum(seen[a, b] for a in ("body", "break") for b in ("body", "break")) > 20
    # lines between the edges are counted where they lie; a line that does not end in a hyphen does not carry the next one along
    assert y.where("rim").count() == sum(min(n, 8) for n in [1, 3, 6, 7, 8, 9, 25]) and y.where("after >= 0").count() == 1 + 2 + 18
    assert pn.labelled_lines(df).where("not broken and next_text is not null").count() == 0


def test_repaired_paragraphs(spark):
    rows = [(1, 1, 1, 0, "Menurut catatan, laporan ini disu-"), (2, 1, 1, 1, "sun, lalu meniinggu 13.412.5OO rupiah yang"), (3, 1, 1, 2, "disampaikan secara berta-"), (4, 1, 2, 0, "hap. Sidang selesai dengan baik dan lancar.")]
    df = spark.createDataFrame(rows, "ocr_id long, doc long, page int, idx int, text string")
    body = df.withColumn("next_text", F.expr("case ocr_id when 1 then 'sun, lalu meniinggu 13.412.5OO rupiah yang' when 3 then 'hap. Sidang selesai dengan baik dan lancar.' end"))
    body = body.withColumn("next_of_page", F.expr("case when ocr_id = 1 then next_text when ocr_id = 2 then 'x' end")).withColumn("first", F.col("idx") == 0).withColumn("state", F.lit("body"))
    cut = {r[0]: pn.cut_line(r[4]) for r in rows}
    body = body.join(spark.createDataFrame([(k, *v) for k, v in cut.items()], "ocr_id long, cut string, figs string"), "ocr_id")
    fixes = spark.createDataFrame([("meniinggu", "menunggu")], "word string, fixed string")
    whole = spark.createDataFrame([(1, "disu", "sun", "disusun"), (3, "berta", "hap", "bertahap")], "row_id long, a string, b string, fixed string")
    got = pn.paragraphs(pn.rejoined(pn.repaired(body, "ocr_id", fixes), whole)).collect()
    assert [tuple(r) for r in got] == [(1, 1, 1, "Menurut catatan, laporan ini disusun, lalu menunggu 13.412.500 rupiah yang disampaikan secara bertahap. Sidang selesai dengan baik dan lancar.")]
    cell = spark.createDataFrame([("nilai ke- luar (x)", [("ke", "luar", "keluar")]), ("tetap", None)], "t string, w array<struct<a:string,b:string,fixed:string>>")
    assert [r[0] for r in cell.select(pn.joined_cell(F.col("t"), F.col("w"))).collect()] == ["nilai keluar (x)", None]


def test_words_and_counts(spark):
    assert pn.words_of("Surat 12 (resmi), a.b@c.id dan 'KB-33O5' x") == ["Surat", "resmi", "dan", "KB-33O5"]
    assert pn.cut_line("setu-") == ("", None) and pn.cut_line("nilai 13.412.5OO. 5urat itu")[1] == "13.412.500"
    t = spark.createDataFrame([("Satu dua-dua\u00a0SATU, é",), (None,), ("",)], "text string")
    assert {r["word"]: r["n"] for r in pn.lexicon([], [t]).collect()} == {"satu": 2, "dua-dua": 1}


def test_whole_words(spark):
    lex = spark.createDataFrame([("kembali", 9), ("berturut-turut", 9), ("kesaksian", 20)], "word string, n long")
    fixes = spark.createDataFrame([("lcesaksian", "kesaksian")], "word string, fixed string")
    h = spark.createDataFrame([(1, "kem", "bali"), (2, "Berturut", "turut"), (3, "hal", "hal"), (4, "Lcesak", "sian"), (5, "pita", "lun")], "row_id int, a string, b string")
    assert {r["row_id"]: r["fixed"] for r in pn.whole_words(h, lex, fixes).collect()} == {1: "kembali", 2: "Berturut-turut", 3: "hal-hal", 4: "Kesaksian", 5: "pitalun"}


def test_corrections(spark):
    lex = spark.createDataFrame([("menunggu", 50), ("meniinggu", 1), ("hari", 30), ("han", 40), ("g1liran", 1), ("giliran", 30), ("ab1", 2)], "word string, n long")
    assert {r["word"]: r["fixed"] for r in pn.corrections(lex).collect()} == {"meniinggu": "menunggu", "g1liran": "giliran"}


def test_repeated_headings(spark):
    rows = [(1, 0, 0, "No"), (1, 0, 1, "Uraian"), (1, 1, 0, "1"), (1, 1, 1, "x"), (1, 2, 0, "N0"), (1, 2, 1, "URAIAN"), (2, 0, 0, "A"), (2, 1, 0, None)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "cell_id long, doc long, row_no int, col_no int, text string")
    assert sorted(r[0] for r in pn.repeated_headings(df).collect()) == [4, 5]


def corpus(spark, n=600):
    rng = random.Random(9)
    themes = {"sport": "kiper wasit turnamen medali stadion pelari".split(), "law": "hakim jaksa gugatan kasasi notaris panitera".split(), "health": "dokter pasien vaksin infeksi perawat rontgen".split()}
    common = "menurut catatan bahwa dengan untuk pada tanpa oleh laporan sementara".split()
    docs, labels = [], []
    for i in range(n):
        mine = rng.sample(sorted(themes), 1 if i % 4 else 2)
        sents = []
        for k in range(6):
            s = mine[k % len(mine)]
            a = rng.sample(themes[s], 2)
            sents.append(" ".join([*rng.sample(common, 4), a[0], a[0], a[1]]))
        docs.append((i, ". ".join(sents) + "."))
        if i % 3 == 0:
            labels += [(i, s) for s in (mine if i % 30 else ["law"])]  # a few labels are wrong
    return docs, labels, themes


def test_subjects_held_out(spark):
    docs, labels, themes = corpus(spark)
    d = spark.createDataFrame([*docs, (9000, ""), (9001, "..."), (9002, None)], "doc_id long, text string")
    p = d.where("text is not null").select("doc_id", sj.passages(F.col("text")).alias("p")).where("size(p) > 0")
    model = sj.fitted(p, spark.createDataFrame(labels, "doc_id long, subject string"), sorted(themes))
    got = {}
    for r in sj.subject_shares(p, model, sj.SHARE).collect():
        got.setdefault(r["doc_id"], set()).add(r["subject"])
    right = total = 0
    for i, t in docs:
        if i % 3:  # not labelled
            want = {s for s, ws in themes.items() if any(w in t.split() for w in ws)}
            right, total = right + (got.get(i) == want), total + 1
    assert right / total > 0.9 and not {9000, 9001, 9002} & set(got)
    assert sj.subject_shares(p.limit(0), model).count() == 0


def test_queries_run(spark):
    from berkas.llm import queries

    for name in ("p3_found", "p4_paragraphs", "p4_cells", "p6_found", "p7_fill", "p8_shares", "p2_combined", "p5_redacted", "p9_composition"):
        assert queries.QUERIES[name](spark, "/root/testdata/sf0.001").count() > 0


def test_names_that_are_rare_in_the_register(spark):
    register = spark.createDataFrame([("MALONI SAPINA",), ("MALONI SAPINA",), ("QUXORBANE WIDLETTO",), (None,)], "nama string")
    texts = ["Kemarin Quxorbane Widletto datang ke kantor.", "Saudara Malon1 Sapina hadir.", "nama: Maloni Sapna", "Tanpa nama.", None]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    got = []
    for limit in (100, 2):  # the list fits a closure, or the words of the texts are joined with the table
        t, own = pii.with_tokens(df, pii.name_tokens(register, "nama", limit=limit))
        s = pii.spans(F.col("text"), F.lit(""), own, [])
        rows = t.select("id", s.alias("s"), pii.placeholders(F.col("text"), F.lit(""), own, []).alias("r")).orderBy("id").collect()
        got.append([(r["id"], [tuple(x) for x in r["s"]], r["r"]) for r in rows])
    assert got[0] == got[1]
    assert got[0][0][2] == "Kemarin [PERSON_NAME] datang ke kantor." and all(x[1] for x in got[0][:3])


def test_plain_words_in_the_register(spark):
    register = spark.createDataFrame([("MALONI SAPINA",)] * 5 + [("SUDI JAYA",)], "nama string")
    texts = spark.createDataFrame([("Toko Lestari Jaya",)] * 60 + [("Sudi Maloni",)], "text string")
    assert sorted(pii.name_tokens(register, "nama", texts=texts)) == ["MALONI", "SAPINA", "SUDI"]


def test_words_that_are_names_too(spark):
    register = spark.createDataFrame([(f"{n} {f}",) for n in ("BUNGA", "MURNI", "SINAR", "MALONI") for f in ("SAPINA", "KEMITA", "LIDARBEYA")] * 2, "nama string")
    said = ["Bunga bank naik.", "Emas Murni itu bunga.", "Sinar matahari murni."] * 30 + ["Maloni Sapina hadir.", "Kemita dan Lidarbeya hadir."] * 8
    tokens = pii.name_tokens(register, "nama", texts=spark.createDataFrame([(t,) for t in said], "text string"))
    names = pii.Names(tokens, [])
    for t in ("Bunga bank naik", "emas Murni", "Sinar matahari"):
        assert pii.find(t, names) == []
    for t in ("Maloni hadir", "Bunga Sapina hadir", "Yth. Sdr. Bunga"):
        assert [s.kind for s in pii.find(t, names)] == ["person_name"]


def test_a_larger_register_has_no_pieces(spark):
    """Misread letters inside a name leave no pieces in the dictionary, however large the register."""
    register = spark.createDataFrame([("WERAOBOBANG MAR1NOJAYA",), ("NA5UTAMA KEL0TI",), ("PAN1OBOBEYA, H. PUR0ASENA",)] * 1000, "nama string")
    assert sorted(pii.name_tokens(register, "nama")) == ["KELOTI", "MARINOJAYA", "NASUTAMA", "PANIOBOBEYA", "PUROASENA", "WERAOBOBANG"]


def test_words_that_announce_names_are_learnt(spark):
    tokens = ["MALONI", "SAPINA", "KEMITA", "LIDAR", "BUNGA?"]
    said = ["Saksi Maloni Sapina hadir."] * 12 + ["Saksi Kemita Lidar hadir."] * 12 + ["Menurut Maloni Sapina."] * 10 + ["Menurut Undang-undang."] * 30 + [None, "", "Saksi Bunga Lidar"]
    df = spark.createDataFrame([(t,) for t in said], "text string")
    assert pii.name_contexts(df, tokens) == ["saksi"]
    assert pii.name_contexts(df, tokens, least=100) == [] and pii.name_contexts(df.limit(0), tokens) == []
    own = df.withColumn("own", F.array(*map(F.lit, tokens)))
    assert pii.name_contexts(own, F.col("own")) == ["saksi"]
    names = pii.Names(tokens, [], ["saksi"])
    assert [(s.kind, s.start) for s in pii.find("Saksi Bunga hadir", names)] == [("person_name", 6)] and pii.find("Dekat Bunga hadir", names) == []
    assert [s.start for s in pii.find("Saksi Malonii hadir", names)] == [6] and pii.find("Dekat Malonii hadir", names) == []


def test_subjects_of_empty_tables(spark):
    docs = spark.createDataFrame([(1, [[1, 2], [3]]), (2, [[1, 2]]), (3, [[2]])], "doc_id long, p array<array<int>>")
    labels = spark.createDataFrame([(1, "law"), (9, "law"), (1, None)], "doc_id long, subject string")
    for d, l, names in ((docs.limit(0), labels, ["law"]), (docs, labels.limit(0), ["law"]), (docs, labels, []), (docs.limit(0), labels.limit(0), [])):
        model = sj.fitted(d, l, names)
        assert sj.subject_shares(docs, model).count() == 0


def test_tree_splits_far_groups(spark, monkeypatch):
    """Two kinds of documents end in different leaves, whichever way the rows lie."""
    rng = random.Random(3)
    rows = [(i, [[(500 if i % 2 else 0) + rng.randrange(40) for _ in range(12)]]) for i in range(200)]
    w = np.ones(sj.BUCKETS, dtype=np.float32)
    used = np.r_[0:40, 500:540]
    found = []
    for n in (1, 7):
        df = spark.createDataFrame(rows, "doc_id long, p array<array<int>>").repartition(n)
        tree = sj.bisected(sj.vectors(df, w, sj.Tree(used).place).cache(), used, leaves=4)
        at, sim = tree.near(sj.Rows([np.concatenate(p) for _, p in rows], w))
        assert len(set(at[::2]) & set(at[1::2])) == 0 and (sim > 0.3).all() and (tree.kids < 0).sum() == 4
        found.append(at.tolist())
    assert found[0] == found[1]


def test_queries_on_empty_tables(spark, tmp_path):
    import os

    from berkas.llm import queries

    src = "/root/testdata/sf0.001"
    for f in os.listdir(src):
        spark.read.parquet(f"{src}/{f}").limit(0).write.parquet(str(tmp_path / f))
    for name in ("p2_percentiles", "p2_day_summaries", "p3_found", "p4_found", "p4_paragraphs", "p5_found", "p6_found", "p7_packed", "p8_shares", "p9_found"):
        assert queries.QUERIES[name](spark, str(tmp_path)).count() == 0
