"""Several values packed in one field."""

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from berkas.operators.packed_fields import automaton, known_values, split_packed, unpack

PLACES = ["BUMIBALA", "TEGALWENING", "LOKAWERU", "NUSA MAKIRU", "TANJUNG-SARI"]


@pytest.mark.parametrize(
    "text, pieces",
    [
        ("BUMIBALA, 05-06-1980", [(1, "BUMIBALA"), (2, "05-06-1980")]),
        ('"Bumibala, Nusa Makiru" | 5 Mei 1980 | LAKI-LAKI', [(1, "Bumibala, Nusa Makiru"), (2, "5 Mei 1980"), (3, "LAKI-LAKI")]),
        ("Tempat/Tgl Lahir: KAB. TEGALWENING;1980-05-06;GOL. DARAH AB", [(1, "KAB. TEGALWENING"), (2, "1980-05-06"), (3, "GOL. DARAH AB")]),
        ("05 06 1980 TEGALWENING", [(1, "05 06 1980"), (2, "TEGALWENING")]),
        ("TANJUNG-SARI-05-06-1980", [(1, "TANJUNG-SARI"), (2, "05-06-1980")]),  # a delimiter inside a known value
        (" ; 11-06-1972", [(2, "11-06-1972")]),
        ("Tegalwening, ", [(1, "Tegalwening")]),
        ("", []), ("   ", []), (" , / ", []), (None, []),
    ],
)
def test_birth_fields(text, pieces):
    assert unpack(text, "birth", automaton(PLACES)) == pieces


@pytest.mark.parametrize(
    "text, pieces",
    [
        ("004/003", [(1, "004"), (2, "003")]), ("RTO14 RW002", [(1, "O14"), (2, "002")]), ("Rt. 9, Rw. 11", [(1, "9"), (2, "11")]), ("009 & 010 / 012", [(1, "009"), (2, "010"), (3, "012")]),
        ("- / 010", [(2, "010")]), ("/006", [(2, "006")]), ("011/", [(1, "011")]), ("RT 015", [(1, "015")]), ("RW 003", [(2, "003")]), ('"008","010"', [(1, "008"), (2, "010")]),
        ("KARTU KELUARGA", []), ("SERTIFIKAT NO 12", []), ("-", []), (None, []),
    ],
)
def test_neighbourhood_fields(text, pieces):
    assert unpack(text, "hood") == pieces


@given(st.lists(st.sampled_from(PLACES), min_size=1, max_size=4), st.sampled_from([", ", ";", " | ", " / "]))
def test_known_values_come_back(values, sep):
    if "NUSA MAKIRU" in values[1:]:  # a larger unit qualifies the place before it
        return
    assert [p for _, p in unpack(sep.join(values), "birth", automaton(PLACES))] == values


def test_long_text():
    text = ", ".join(["BUMIBALA"] * 3000)
    assert len(unpack(text, "birth", automaton(PLACES))) == 3000


def test_both_ways_agree_and_columns_may_clash(spark):
    rows = [(1, "BUMIBALA, 05-06-1980", "x", "y"), (2, None, "x", None), (3, "KAB. LOKAWERU/1980-01-02", None, "z"), (1, "BUMIBALA, 05-06-1980", "x", "y"), (4, "", "", "")]
    df = spark.createDataFrame(rows, "rec_id long, born string, pos string, piece string")
    words = spark.createDataFrame([(p,) for p in PLACES], "word string")
    a = split_packed(df, "rec_id", {"born": "birth"}, words).distinct()
    b = split_packed(df, "rec_id", {"born": "birth"}, words, broadcast_limit=1).distinct()
    got = {tuple(r) for r in a.collect()}
    assert got == {tuple(r) for r in b.collect()} and (3, "born", 1, "KAB. LOKAWERU") in got and len(got) == 4
    assert split_packed(df.limit(0), "rec_id", {"born": "birth"}, words).count() == 0


def test_both_ways_agree_on_marks_and_long_names(spark):
    """Dictionary values with points, commas, hyphens and more than four words, on either side of the limit."""
    places = [("ST. MARIA, BARU", False), ("MUARA-SARI, UTARA", False), ("D.I. KOTA LAMA DI ATAS BUKIT TINGGI", False), ("SARI", False), ("KEP. LOR", True), ("BARU", False)]
    texts = ["ST. MARIA, BARU 01-02-1990", "MUARA-SARI, UTARA / 1 Mei 1990", "Kab. Sari, Kep. Lor; 02-03-1991", "D.I. KOTA LAMA DI ATAS BUKIT TINGGI, 1990-01-02", "st maria baru, 01-02-1990", "SARI BARU", "KEP. LOR, SARI", ", 01-02-1990"]
    df = spark.createDataFrame(list(enumerate(texts)), "rec_id long, born string")
    words = spark.createDataFrame(places, "word string, wide boolean")
    a, b = ({tuple(r) for r in split_packed(df, "rec_id", {"born": "birth"}, words, broadcast_limit=k).collect()} for k in (100, 1))
    assert a == b
    assert {(0, "born", 1, "ST. MARIA, BARU"), (1, "born", 1, "MUARA-SARI, UTARA"), (2, "born", 1, "Kab. Sari, Kep. Lor"), (3, "born", 1, "D.I. KOTA LAMA DI ATAS BUKIT TINGGI"), (7, "born", 2, "01-02-1990")} <= a


def test_dictionary_counts_all_rows(spark):
    df = spark.createDataFrame([("KOTA BUMIBALA",), ("KABUPATEN BUMIBALA",), ("KOTA X",), (None,), ("",)], "k string")
    assert [r[0] for r in known_values((df, "k")).collect()] == ["BUMIBALA"]
    assert known_values((df.where(F.lit(False)), "k")).count() == 0
