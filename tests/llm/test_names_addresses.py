"""Names and addresses: parts, and whole results against brute force."""

import itertools

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from berkas.llm import addresses as ad
from berkas.llm import names as nm
from berkas.llm.graph import components, meetings
from berkas.session import _STORED, stored

CITIES = frozenset(["BUMIBALA", "TEGALWENING"])


@pytest.mark.parametrize(
    "text, want",
    [
        ("JL MELATI RAYA NO.342", ("MELATI", "RAYA", "342", "")), ("No. 221 Jl.  Kristal Indah, Desa X Y", ("KRISTAL", "INDAH", "221", "")), ("Gg. Bulan 2 #504 RT. 5 / RW. 7", ("BULAN", "2", "504", "")),
        ("JL LAUTAN V NO 18 B", ("LAUTAN", "5", "18", "B")), ("JL. MUTIARA IDH. 28-B,KEL. SARI", ("MUTIARA", "INDAH", "28", "B")), ("Jl Sirsak 3, 176, Kab. Bumibala", ("SIRSAK", "3", "176", "")),
        ("Durian Indah, No.118, Muara, Kec. Tegal Lor", ("DURIAN", "INDAH", "118", "")), ("NO.500 G. KAMBOJA IV", ("KAMBOJA", "4", "500", "")),
    ],
)
def test_street_and_number(text, want):
    p = ad.parse(text, CITIES)
    assert (p["street"], p["suffix"], p["number"], p["letter"]) == want


def test_other_components_in_any_order():
    a = ad.parse("Kab. Bumibala - Kec. Banyu Lor - RT 011/RW 001 - Kel. Sari - Jl. Durian Raya #338, 90210", CITIES)
    assert (a["city"], a["district"], a["rt"], a["rw"], a["village"], a["postcode"]) == ("BUMIBALA", "BANYU LOR", "11", "1", "SARI", "90210")
    for t in (None, "", "   ", "-", "RT/RW", "x" * 20000):
        assert set(ad.parse(t)) == set(ad.FIELDS)


@given(st.text("ABC", max_size=6), st.text("ABC", max_size=6))
def test_distance_with_swaps(a, b):
    def rule(x, y):
        d = {}
        for i in range(-1, len(x)):
            for j in range(-1, len(y)):
                if i < 0 or j < 0:
                    d[i, j] = max(i, j) + 1
                    continue
                d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (x[i] != y[j]))
                if i and j and x[i] == y[j - 1] and x[i - 1] == y[j]:
                    d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
        return d[len(x) - 1, len(y) - 1]

    assert ad.osa(a, b, 9) == rule(a, b)


ADDRESSES = [
    (1, "JL MELATI RAYA NO.12, KEL. SARI"), (2, "Jln. Melaati Ry. 12 Kel. Sari"), (3, "JL MELATI RAYA NO.12A, KEL. SARI"), (4, "JL MELATI RAYA NO.12, KEL. LEMBAH"), (5, "NO 12 JL MELATI RAYA, KOTA BUMIBALA"),
    (6, "JL MELATI RAYA NO.12, KEL. SARI"), (7, None), (8, ""), (9, "JL MELATI RAYA"), (10, "JL MELATI RAYA 12"), (11, "JL MELATI INDAH NO.12, KEL. SARI"), (12, "JL MELATI RAYA 12, KEL SARI, KOTA BUMIBALA"),
]


def test_same_houses(spark):
    df = spark.createDataFrame(ADDRESSES, "rec_id long, t string").select("rec_id", ad.parsed(F.col("t"), list(CITIES)).alias("a"))
    got = {tuple(r) for r in ad.same_houses(df).collect()}
    want = {tuple(sorted(p)) for p in itertools.combinations([1, 2, 6, 12], 2)} | {(5, 12), (1, 5), (2, 5), (5, 6)}
    assert got == want
    assert ad.same_houses(df.limit(0)).count() == 0


def test_many_forms_of_one_house(spark):
    rows = [(i, f"JL MELATI RAYA NO.12, RT {i}/1, KEL. SARI") for i in range(1, 90)]
    df = spark.createDataFrame(rows, "rec_id long, t string").select("rec_id", ad.parsed(F.col("t"), []).alias("a"))
    assert ad.same_houses(df, window=8).count() == 89 * 88 // 2  # far more forms than the window holds


@pytest.mark.parametrize(
    "a, b, same",
    [
        ("TADEMBARA PURALIRIA", "PURALIRIA, TADEBARA", True), ("DR. LUSYAH N LEGEKABANG", "LUSYAH NIHUTUTO LEGEKABANG", True), ("joririyemyosobodono", "YOSOBODONO JORIRIYEM", True), ("ABD. MALONI", "ABDUL MALONI, S.E.", True),
        ("RADEN GATO HAROSENA", "RADEN SUNGGATO HAROSENA", True), ("KOESOKUSU LIDAR", "LIDAR KUSOKUSU", True), ("LU8UKUSU YULEDAR", "YULEDAR LUBUKUSU", True), ("SITI LIDAR", "SITI MALONI", False), ("SRI", "SRI LIDAR", False), ("", "X", False),
    ],
)
def test_spellings(a, b, same):
    assert (nm.name_match(nm.name_tokens(a), nm.name_tokens(b)) > 0) is same


def test_assignment_is_optimal():
    import random

    rng = random.Random(5)
    for _ in range(60):
        n, m = rng.randint(1, 5), rng.randint(1, 5)
        s = [[rng.choice([0, 0.6, 0.9, 1.0]) for _ in range(m)] for _ in range(n)]
        got = sum(s[i][j] for i, j in nm.assignment(s))
        k = min(n, m)
        best = max(sum(s[i][j] for i, j in zip(rows, cols)) for rows in itertools.combinations(range(n), k) for cols in itertools.permutations(range(m), k))
        assert abs(got - best) < 1e-9


def test_birth_and_numbers():
    assert nm.birth("KAB. TEGALWENING, 05-06-1980, LAKI-LAKI") == ("050680", "TEGALWENING") and nm.birth("1980-06-05 | Bumibala") == ("050680", "BUMIBALA") and nm.birth("5 JUNI 1980") == ("050680", "")
    assert nm.nik_birth("9976014506809824") == "050680" and nm.fold_digits("99O6l1") == "990611" and nm.birth(None) == ("", "")


def test_linked_persons(spark):
    rows = [
        (1, "LIDAR KUSOKUSU", "9976010506801111", "BUMIBALA, 05-06-1980", None), (2, "LIDR KUSOKUSU", None, "05.06.1980 BUMIBALA", None), (3, "LIDAR KUSOKUSU", None, "BUMIBALA, 06-11-1990", None), (4, "K. LIDAR", "9976010506801111", None, None),
        (5, "MALONI SAPINA", None, None, "JL MELATI RAYA NO.12, KEL. SARI"), (6, "MALONI", None, None, "JL MELATI RY 12 KEL SARI"), (7, "SUPIT SAPINA", None, None, "JL MELATI RY 12 KEL SARI"), (8, "", None, None, None), (9, "MALONI SAPINA", None, None, None), (10, "LIDAR KUSOKUSU", "9976010506801111", "BUMIBALA, 05-06-1980", None),
    ]
    df = spark.createDataFrame(rows, "rec_id long, nama string, nik string, ttl string, alamat string")
    a = F.when(F.col("alamat").isNotNull(), ad.parsed(F.col("alamat"), []))
    df = df.select("rec_id", nm.profiled(F.col("nama"), F.col("nik"), F.col("ttl")).alias("p"), a.alias("a"))
    got = {tuple(r) for r in nm.linked_persons(df).collect()}
    assert got == {tuple(sorted(p)) for p in itertools.combinations([1, 2, 4, 10], 2)} | {(5, 6)}
    assert nm.linked_persons(df.limit(0)).count() == 0


def test_merchants(spark):
    ref = spark.createDataFrame([(1, "Warung Drosaka Lestari"), (2, "Toko Buku Umbunatala Mandiri"), (3, "CV Sagvio Utama"), (4, "Toko Kanzka")], "merchant_id long, merchant_name string")
    names = ["WRG DROSAKA L.", "Drosaka Lestari, Warung #12", "TB UMBUNATALA MAN - CAB. BUMIBALA", "C.V. SAGVVIO UTAMA (TEGALWENING)", "CVSAGVIO UTAMA", "TOKO DROSAKA LESTARI", "WARUNG DROSAKA MAKMUR", None, "", "TK KANZKA BUMIBALA", "Apotek Lain Sekali"]
    rec = spark.createDataFrame([(100 + i, n) for i, n in enumerate(names)], "rec_id long, merchant_name string")
    got = {tuple(r) for r in nm.linked_merchants(rec, ref, sorted(CITIES)).collect()}
    assert got == {(1, 100), (1, 101), (2, 102), (3, 103), (3, 104), (4, 109)}
    assert nm.linked_merchants(rec.limit(0), ref, []).count() == 0


def test_components(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7)], "a long, b long")
    got = {r["node"]: r["label"] for r in components(e, "a", "b").collect()}
    assert all(got[i] == 0 for i in range(41)) and got[101] == 100
    assert components(e.limit(0), "a", "b").count() == 0


@pytest.mark.parametrize("ttl, address", [(None, "JL MELATI RAYA NO.12, KEL. {}"), ("BUMIBALA, 05-06-1980", None)])
def test_persons_far_apart_in_a_bucket(spark, ttl, address):
    words = ["".join(p) + "TUNO" for p in itertools.product(["MA", "NO", "PU", "RI"], ["BE", "GO", "KI", "SU"], ["DA", "FO", "LE"])]
    names = ["LIDAR KUSOKUSU", "LIDAR XUSOKUSU", *[f"LIDAR {w}" for w in words]]  # 48 others lie between the two spellings
    villages = ["SARI", "SARI", *[w[::-1] for w in words]]
    rows = [(i, n, None, ttl, address and address.format(v)) for i, (n, v) in enumerate(zip(names, villages))]
    df = spark.createDataFrame(rows, "rec_id long, nama string, nik string, ttl string, alamat string")
    a = F.when(F.col("alamat").isNotNull(), ad.parsed(F.col("alamat"), []))
    df = stored(df.select("rec_id", nm.profiled(F.col("nama"), F.col("nik"), F.col("ttl")).alias("p"), a.alias("a")))
    people = [r.asDict(True) for r in df.orderBy("rec_id").collect()]
    people = [(r["rec_id"], r["p"] | {"a": r["a"]}) for r in people]
    want = {(i, j) for (i, p), (j, q) in itertools.combinations(people, 2) if nm.same_person(p, q)}
    assert (0, 1) in want and want <= {tuple(r) for r in nm.linked_persons(df).collect()}


def test_meetings_in_blocks(spark):
    x = spark.createDataFrame([(k, i) for k in (1, 2) for i in range(30)], "k long, x long")
    y = spark.createDataFrame([(k, i) for k in (1, 3) for i in range(40)], "k long, y long")
    got = [tuple(r) for r in meetings(x, y, "k", "y", block=7).collect()]
    assert sorted(got) == [(i, j) for i in range(30) for j in range(40)]


def test_houses_far_apart_in_every_order(spark):
    words = ["".join(p) for p in itertools.product(["MA", "NO", "PU", "RI"], ["BE", "GO", "KI", "SU"], ["DAWET", "FOLIR", "LEPUN"])]
    texts = ["JL KENCANA NO.12, KOTA BUMIBALA", "JL XENCANA NO.12, KOTA BUMIBALA", *[f"JL {w} NO.12, KOTA BUMIBALA" for w in words]]
    df = stored(spark.createDataFrame(list(enumerate(texts)), "rec_id long, t string").select("rec_id", ad.parsed(F.col("t"), list(CITIES)).alias("a")))
    a = [r["a"].asDict() for r in df.orderBy("rec_id").collect()]
    want = {(i, j) for (i, p), (j, q) in itertools.combinations(enumerate(a), 2) if ad.agreement(p, q) > 0}
    got = {tuple(r) for r in ad.same_houses(df).collect()}
    assert (0, 1) in want and want <= got


def test_rare_spellings_meet(spark):
    rows = [(1, "SENGGOPIPIT", "9976010506801111", None), (2, "SENGGPAIPIT", "9976010506801111", None), (3, "QUXORBANE", None, "BUMIBALA, 06-11-1990"), (4, "QUXORBANI", None, "BUMIBALA, 06-11-1990"), (5, "LIDAR", None, "BUMIBALA, 06-11-1990")]
    df = spark.createDataFrame(rows, "rec_id long, nama string, nik string, ttl string")
    df = df.select("rec_id", nm.profiled(F.col("nama"), F.col("nik"), F.col("ttl")).alias("p"), ad.parsed(F.lit(None).cast("string"), []).alias("a"))
    assert {tuple(r) for r in nm.linked_persons(df).collect()} == {(1, 2), (3, 4)}


def _cards(spark, rows):
    df = spark.createDataFrame(rows, "rec_id long, nama string, nik string, ttl string")
    return df.select("rec_id", nm.profiled(F.col("nama"), F.col("nik"), F.col("ttl")).alias("p"), ad.parsed(F.lit(None).cast("string"), []).alias("a"))


def test_tokens_that_match_share_a_key():
    words = ["LIDAR", "LIDR", "LDIAR", "KUSOKUSU", "KOESOKUSU", "KSOKUSO", "JORIRIYEM", "JORYRIJEM", "JORIRIYEMLIDAR", "JORIRIJEMLIDAR", "SENGGOPIPIT", "SENGGPAIPIT", "ADI", "ADE", "H"]
    for a, b in itertools.combinations(words, 2):
        met = len(np.intersect1d(nm.name_keys(a), nm.name_keys(b))) > 0
        assert met or nm.name_match([a], [b]) == 0 or min(len(a), len(b)) < 4, (a, b)


def test_persons_in_buckets_dealt_out(spark):
    df = stored(_cards(spark, [(i, f"LIDAR KUSO{w}SU", None, "BUMIBALA, 05-06-1980") for i, w in enumerate(["KU", "GU", "KO", "KI"] * 5)]))
    whole = {tuple(r) for r in nm.linked_persons(df).collect()}
    assert whole == set(itertools.combinations(range(20), 2)) and {tuple(r) for r in nm.linked_persons(df, block=1).collect()} == whole


def test_linking_persons_writes_no_table_of_keys(spark):
    # one birth date, all tokens within an edit of many others: what is written follows the profiles, not their forms and pairs
    names = ["LI" + "".join(p) + "DAR" for p in itertools.product("BDGKL", "AEIO", "MNRST", "AEIO")]
    df = stored(_cards(spark, [(i, n, f"{i // 20:02d}" * 3 + f"{i % 20:02d}" * 3 + "0000", "BUMIBALA, 05-06-1980") for i, n in enumerate(names)]))
    since = len(_STORED)
    assert nm.linked_persons(df).count() == 0
    assert max(spark.read.parquet(path).count() for _, path in _STORED[since:]) == len(names)
