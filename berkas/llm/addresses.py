"""Postal addresses that denote the same house.

An address is parsed into street, direction or street number, house number, letter, neighbourhood numbers, village,
district, city and postcode, in whatever order they stand. Equal parses are one form; all forms of equal house number,
letter and street number that share a place (a village, district or city within typing errors, a postcode or
neighbourhood numbers) are scored by edit-distance with transpositions.

Edge cases: a null, empty or unparsable address (no street or no house number) has no partners; an address that names
neither village, district, neighbourhood, city nor postcode in common with the other is not linked (street and number
alone do not denote a house); repeated rows count once; copies of a form are linked without being compared again.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from berkas.llm.graph import components, dealt, sharing, shortened, whole_buckets
from berkas.session import stored

# Abbreviations in addresses.
SUFFIXES = {
    "RAYA": "RAYA", "RY": "RAYA", "INDAH": "INDAH", "IDH": "INDAH", "INDH": "INDAH", "IND": "INDAH", "TIMUR": "TIMUR", "TIM": "TIMUR", "TMR": "TIMUR", "TI": "TIMUR",
    "BARAT": "BARAT", "BRT": "BARAT", "BAR": "BARAT", "UTARA": "UTARA", "UTR": "UTARA", "UT": "UTARA", "SELATAN": "SELATAN", "SLT": "SELATAN", "SEL": "SELATAN", "SLTN": "SELATAN",
    "DALAM": "DALAM", "DLM": "DALAM", "DAL": "DALAM", "TENGAH": "TENGAH", "TGH": "TENGAH", "TENG": "TENGAH", "BARU": "BARU", "LAMA": "LAMA", "BESAR": "BESAR", "KECIL": "KECIL",
}
ROMAN = {"I": "1", "II": "2", "III": "3", "IV": "4", "V": "5", "VI": "6", "VII": "7", "VIII": "8", "IX": "9", "X": "10", "XI": "11", "XII": "12"}
STREET_WORDS = r"(?:JALAN|JLN|JL|GANG|GG|G|LORONG|LRG)"
DISTRICT_SIDES = ("LOR", "KIDUL", "WETAN", "KULON", "TENGAH", "UTARA", "SELATAN", "TIMUR", "BARAT", "KOTA")

_RT = re.compile(r"\bRT(?:\s*/\s*RW)?[.:\s]*([0-9OIL]{1,3})(?:\s*[/,.\-]?\s*(?:RW)?[.:\s]*/?\s*([0-9OIL]{1,3})(?![0-9]))?(?![0-9])")
_RW = re.compile(r"\bRW[.:\s]*([0-9OIL]{1,3})(?![0-9])")
_POST = re.compile(r"(?<![0-9])(\d{5})(?![0-9])")
_NO = re.compile(r"(?:\b(?:NOMOR|NOMER|NMR|NO)\b[.:\s]*|#\s*)([0-9OIL]*[0-9][0-9OIL]*)(?:\s*[-/]?\s*([A-HJ-Z]))?(?![A-Z0-9]|\.\s*[A-Z])")
_NO_GLUED = re.compile(r"\bNO([0-9]+)\s*([A-HJ-Z])?(?![A-Z0-9])")
_VILLAGE = re.compile(r"\b(?:KELURAHAN|KEL|DESA|DS)\b[.:\s]*([A-Z][A-Z']+)")
_DISTRICT = re.compile(rf"\b(?:KECAMATAN|KEC)\b[.:\s]*([A-Z][A-Z']+(?:\s+(?:{'|'.join(DISTRICT_SIDES)})\b)?)")
_CITY = re.compile(r"\b(?:KABUPATEN|KAB|KODYA|KOTAMADYA|KOTA)\b[.:\s]*([A-Z][A-Z']+)")
_STREET = re.compile(rf"\b{STREET_WORDS}\b[.:\s]*([A-Z][A-Z'.]*(?:\s+[A-Z][A-Z'.]*|\s+[0-9]{{1,2}}(?=\s*(?:,|-|#|\bNO|\s[0-9]|$)))*)")
_FOLD = str.maketrans("OIL", "011")

FIELDS = ["street", "suffix", "number", "letter", "rt", "rw", "village", "district", "city", "postcode"]


def _num(s: str | None) -> str:
    if not s:
        return ""
    d = re.sub(r"[^0-9]", "", s.translate(_FOLD))
    return d.lstrip("0") or ("0" if d else "")


def _street(words: list[str]) -> tuple[str, str]:
    """(name, suffix) of the words of a street; the suffix is a direction or the street's own number."""
    name, suffix = [], ""
    for w in words:
        w = w.strip(".'")
        if not w:
            continue
        if name and w in ROMAN:
            suffix = ROMAN[w]
        elif name and w.isdigit():
            suffix = _num(w)
        elif name and w in SUFFIXES:
            suffix = SUFFIXES[w]
        elif name and len(w) >= 3 and (near := next((s for s in ("RAYA", "INDAH", "TIMUR", "BARAT", "UTARA", "SELATAN", "DALAM", "TENGAH") if osa(w, s, 1) <= 1), None)):
            suffix = near
        else:
            name.append(w)
    return "".join(name), suffix


def osa(a: str, b: str, limit: int) -> int:
    """Edit distance in which the swap of two neighbours costs one; limit + 1 when it is greater than the limit."""
    if a == b:
        return 0
    if abs(len(a) - len(b)) > limit:
        return limit + 1
    prev2, prev, cur = None, list(range(len(b) + 1)), None
    for i, x in enumerate(a, 1):
        cur = [i] + [0] * len(b)
        low = i
        for j, y in enumerate(b, 1):
            v = min(prev[j] + 1, cur[j - 1] + 1, prev[j - 1] + (x != y))
            if prev2 is not None and j > 1 and x == b[j - 2] and a[i - 2] == y:
                v = min(v, prev2[j - 2] + 1)
            cur[j] = v
            low = min(low, v)
        if low > limit:
            return limit + 1
        prev2, prev = prev, cur
    return min(prev[-1], limit + 1)


def near(a: str, b: str, sure: bool = False) -> bool:
    """Equal up to typing errors for the length: one edit from four letters on, two from nine on. sure: where all else
    agrees, one edit more from six letters on, as both sides may be mistyped."""
    if a == b:
        return True
    n = min(len(a), len(b))
    return n >= 4 and osa(a, b, 3) <= (2 if n >= 9 else 1) + (sure and n >= 5)


def parse(text: str | None, cities: frozenset[str] = frozenset()) -> dict[str, str]:
    """Components of an address, upper case, '' where missing. cities: known city names, for cities without a label."""
    out = dict.fromkeys(FIELDS, "")
    if not text or not text.strip():
        return out
    t = re.sub(r"\s+", " ", text.upper().replace("“", " ").replace("”", " ").replace('"', " ")).strip()
    t = re.sub(r"(?<=[0-9])\s?-\s?([A-HJ-Z])(?![A-Z0-9])", r"\1", t)

    def take(rx, *names, fold=False):
        nonlocal t
        m = rx.search(t)
        if m:
            for k, g in zip(names, m.groups()):
                if g:
                    out[k] = _num(g) if fold else g.strip(" .'")
            t = f"{t[: m.start()]} , {t[m.end() :]}"
        return m

    take(_RT, "rt", "rw", fold=True)
    if not out["rw"]:
        take(_RW, "rw", fold=True)
    take(_POST, "postcode")
    take(_DISTRICT, "district")
    take(_VILLAGE, "village")
    take(_CITY, "city")
    # the house number; a street's own number stands between its name and the house number
    m = _NO.search(t) or _NO_GLUED.search(t)
    if m:
        out["number"], out["letter"] = _num(m.group(1)), m.group(2) or ""
        t = f"{t[: m.start()]} # {t[m.end() :]}"
    s = re.search(rf"\b{STREET_WORDS}\b[.:\s]*(?=[A-Z])", t)
    rest = []
    if s:
        tail = t[s.end() :]
        stop = re.search(r"[,;#|]|\s-\s|\s-|-\s", tail)
        body, after = (tail[: stop.start()], tail[stop.start() :]) if stop else (tail, "")
        rest = [t[: s.start()], after]
    else:
        parts = [p.strip(" -.") for p in re.split(r"[,;|]|\s-\s|(?=#)|(?<=#)", t)]
        at = next((i for i, p in enumerate(parts) if p == "#"), len(parts))
        words = [i for i, p in enumerate(parts) if re.search(r"[A-Z]{3}", p)]
        pick = next((i for i in words if any(w.strip(".") in SUFFIXES or w in ROMAN for w in p_words(parts[i])[1:])), None)
        if pick is None:
            before = [i for i in words if i < at]
            pick = before[-1] if before else (words[0] if words else None)
        body = parts[pick] if pick is not None else ""
        rest = [", ".join(p for i, p in enumerate(parts) if i != pick and p != "#")]
    words = p_words(body)
    cut = len(words)
    if not out["number"]:
        nums = [i for i, w in enumerate(words) if re.fullmatch(r"[0-9]{1,4}[A-Z]?", w)]
        later = re.match(r"\s*,\s*([0-9]{1,4})\s*([A-HJ-Z])?(?![A-Z0-9])", rest[-1] if s else f" , {rest[-1].lstrip(' ,')}")
        if len(nums) == 1 and nums[0] == len(words) - 1 and later:
            out["number"], out["letter"] = _num(later[1]), later[2] or ""
            rest[-1] = rest[-1].replace(later[1], " ", 1)
        elif nums:
            i = nums[-1] if len(nums) > 1 else nums[0]
            g = re.fullmatch(r"([0-9]{1,4})([A-Z]?)", words[i])
            out["number"], out["letter"] = _num(g[1]), g[2]
            cut = i
            extra = words[i + 1 :]
            if extra and len(extra[0]) == 1 and extra[0].isalpha() and not out["letter"]:
                out["letter"], extra = extra[0], extra[1:]
            rest.append(" ".join(extra))
        else:
            joined = " , ".join(rest)
            g = re.search(r"(?<![0-9A-Z])([0-9]{1,4})\s*([A-HJ-Z])?(?![A-Z0-9])", joined)
            if g:
                out["number"], out["letter"] = _num(g[1]), g[2] or ""
                rest = [joined[: g.start()] + " , " + joined[g.end() :]]
    street = words[:cut]
    # words after the direction belong to the next component
    for i in range(1, len(street)):
        w = street[i].strip(".")
        if w in SUFFIXES or w in ROMAN or w.isdigit():
            rest.append(" ".join(street[i + 1 :]))
            street = street[: i + 1]
            break
    out["street"], out["suffix"] = _street(street)
    for p in re.split(r"[,;|#]|\s-\s", " , ".join(rest)):
        for w in p_words(p):
            w = w.strip(".'-")
            if len(w) < 4 or not w.isalpha():
                continue
            if w in cities and not out["city"]:
                out["city"] = w
            elif not out["village"] and w not in SUFFIXES:
                out["village"] = w
            elif not out["city"]:
                out["city"] = w
    return out


def p_words(s: str) -> list[str]:
    return [w for w in re.split(r"[\s.]+", s) if w and w not in ("-", "/", ":")]


_PARSED = "struct<" + ",".join(f"{f}:string" for f in FIELDS) + ">"


def parsed(address: Column, cities: list[str]) -> Column:
    """Struct of components of an address column. cities: a list of bounded size (administrative units)."""

    @F.pandas_udf(_PARSED)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        known = frozenset(cities)
        for s in batches:
            yield pd.DataFrame([parse(x, known) for x in s], columns=FIELDS)

    return run(address)


def agreement(a: dict, b: dict) -> int:
    """-1 where two addresses contradict each other, else how many components that place the street they share.
    Strict on house number, letter and street number, tolerant of typing errors in names."""
    if not a["number"] or a["number"] != b["number"] or a["letter"] != b["letter"] or a["suffix"] != b["suffix"] or not a["street"] or not b["street"]:
        return -1
    common = 0
    hood = bool(a["rt"] and b["rt"] and a["rw"] and b["rw"]) and a["rt"] == b["rt"] and a["rw"] == b["rw"]
    if a["village"] and b["village"]:
        if not near(a["village"], b["village"]):
            return -1
        return 4 if near(a["street"], b["street"], a["village"] == b["village"] or hood) else -1
    if not near(a["street"], b["street"], hood or bool(a["district"] and a["district"] == b["district"])):
        return -1
    for f in ("district", "city"):
        if a[f] and b[f]:
            if not near(a[f], b[f]):
                return -1
            common += 1
    if a["rt"] and b["rt"] and (a["rt"] != b["rt"] or (a["rw"] and b["rw"] and a["rw"] != b["rw"])):
        return -1
    if a["postcode"] and b["postcode"]:
        if a["postcode"] != b["postcode"]:
            return -1
        common += 1
    return common + hood


def agreeing(a: Column, b: Column) -> Column:
    """agreement of two component structs."""

    @F.pandas_udf("int")
    def run(batches: Iterator[tuple[pd.DataFrame, pd.DataFrame]]) -> Iterator[pd.Series]:
        for x, y in batches:
            yield pd.Series([agreement(p, q) for p, q in zip(x.to_dict("records"), y.to_dict("records"))], dtype="int32")

    return run(a, b)


def forms(records: DataFrame) -> DataFrame:
    """`records` (rec_id, a: struct of components) with `form`, a hash that equal parses share; rows without street or
    number are left out."""
    return records.where("a.street <> '' and a.number <> ''").withColumn("form", F.xxhash64(*[F.col(f"a.{f}") for f in FIELDS]))


@lru_cache(200_000)
def _place_keys(kind: str, name: str) -> np.ndarray:
    """Hashes of the forms by which the name of a place is met: `near` names share one, as each edit takes a letter of either."""
    return np.array([hash((kind, x)) for x in shortened(name, 2 if len(name) >= 9 else 1)], np.int64)


def _keyed(rows: list[list[str]], kinds: str) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of components in the order of FIELDS: V village, D district, C city, P postcode, R neighbourhood."""
    row, key = [], []
    for i, r in enumerate(rows):
        for kind in kinds:
            name = (r[4] and r[5] and f"{r[4]}/{r[5]}") if kind == "R" else r[{"V": 6, "D": 7, "C": 8, "P": 9}[kind]]
            if name:
                key.append(_place_keys(kind, name) if kind in "VDC" else np.array([hash((kind, name))], np.int64))
                row.append(i)
    if not row:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.repeat(np.array(row), [len(k) for k in key]), np.concatenate(key)


def _agreeing_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(fa, fb) of forms of one bucket that agree. Rows: bucket, part, cross, form, a (components joined)."""
    for group, t in whole_buckets(batches):
        part, cross, form = (t.column(c).to_numpy() for c in ("part", "cross", "form"))
        rows = [x.split("\x1f") for x in t.column("a").to_pylist()]
        village = np.array([bool(r[6]) for r in rows])
        out: list[tuple[int, int]] = []
        for kinds in ("V", "DCPR"):
            for x, y in sharing(group, *_keyed(rows, kinds)):
                # two that name their villages meet by these alone
                ok = ((village[x] & village[y]) == (kinds == "V")) & (~cross[x] | (part[x] != part[y])) & (form[x] != form[y])
                x, y = x[ok], y[ok]
                known = {i: dict(zip(FIELDS, rows[i])) for i in np.unique(np.r_[x, y]).tolist()}
                out += [(i, j) for i, j in zip(x.tolist(), y.tolist()) if abs(len(rows[i][0]) - len(rows[j][0])) <= 3 and agreement(known[i], known[j]) > 0]
        if out:
            ends = np.unique(np.sort(form[np.array(out)], 1), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(ends[:, 0]), pa.array(ends[:, 1])], names=["fa", "fb"])


def agreeing_forms(distinct_forms: DataFrame, *, block: int = 20_000) -> DataFrame:
    """(fa, fb), fa < fb: every pair of different forms whose `agreement` is above 0. Such forms share number, letter and
    suffix, by which they are gathered, and either have villages that are near or, where one names no village, a near district or
    city, an equal postcode or equal neighbourhood numbers; all forms of a bucket that share one of these are compared inside its
    task, so a form moves once. block: a bucket of more forms is dealt out by pairs of such blocks."""
    f = distinct_forms.where("a.street <> '' and a.number <> ''")
    house = F.xxhash64("a.number", "a.letter", "a.suffix").alias("bucket")
    f = f.select(house, "form", F.concat_ws("\x1f", *[F.coalesce(F.col(f"a.{x}"), F.lit("")) for x in FIELDS]).alias("a"))
    return dealt(stored(f), "form", block).mapInArrow(_agreeing_rows, "fa long, fb long")


def same_houses(records: DataFrame, *, window: int = 20_000) -> DataFrame:
    """Pairs (rec_a, rec_b), rec_a < rec_b, of records at the same house. records: rec_id, a (components), one row per
    rec_id. window: forms of one house number, letter and suffix that go to one task, more are dealt out; it
    changes how the work is spread, not the result. The pairs of a house are the result itself, so their number is that of the rows out."""
    recs = forms(records)
    uniq = stored(recs.groupBy("form").agg(F.first("a").alias("a")))
    linked = stored(agreeing_forms(uniq, block=window))
    # the house of a form is also that of the forms linked to its links, where nothing contradicts
    known = stored(components(linked, "fa", "fb").join(uniq.withColumnRenamed("form", "node"), "node"))
    x, y = known.select("label", F.col("node").alias("fa"), "a"), known.select("label", F.col("node").alias("fb"), F.col("a").alias("b"))
    linked = x.join(y, "label").where("fa < fb").where(agreeing(F.col("a"), F.col("b")) >= 0).select("fa", "fb")
    # a form links to its own copies where it says where the street is
    own = uniq.where("a.village <> '' or a.district <> '' or a.city <> '' or a.postcode <> '' or (a.rt <> '' and a.rw <> '')").select(F.col("form").alias("fa"), F.col("form").alias("fb"))
    ids = recs.select("form", "rec_id")
    left = ids.select(F.col("form").alias("fa"), F.col("rec_id").alias("x"))
    right = ids.select(F.col("form").alias("fb"), F.col("rec_id").alias("y"))
    both = linked.unionAll(own).join(left, "fa").join(right, "fb").where((F.col("fa") != F.col("fb")) | (F.col("x") < F.col("y")))
    return both.select(F.least("x", "y").alias("rec_a"), F.greatest("x", "y").alias("rec_b")).distinct()
