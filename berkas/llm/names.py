"""Spellings of a name that mean the same person or merchant.

Candidates are found through symmetric deletes: two tokens meet in a form that is left of both when a letter, of long ones
two letters, are taken out; a token made of several glued ones meets its parts. Records of persons are gathered by one piece
of evidence (birth date, identity number, house), and those whose tokens meet are compared there and then: a pair counts
if its tokens align under an optimal assignment that admits edits, initials and short forms, and if no evidence contradicts.
Spellings of merchants have no evidence beside them and meet in an index of all tokens.

Edge cases: null and empty names, and names of marks only, link to nothing; a name of one token needs stronger
evidence; repeated rows count once; records whose name, numbers, birth and house are all equal form one profile, which
is compared once however many copies it has; tokens and names may be of any length.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from berkas.llm.addresses import FIELDS, agreeing_forms, agreement, forms, near, osa
from berkas.llm.graph import components, dealt, sharing, shortened, spread, whole_buckets
from berkas.operators.packed_fields import _DATE, MONTHS
from berkas.session import _STORED, clear_stored, stored

# Titles and degrees around names, and short forms of given names.
TITLES = frozenset("H HJ HAJI HAJJAH DR DRG DRH DRS DRA IR PROF MR MRS MS BAPAK IBU SDR SDRI".split())
DEGREES = frozenset("SE SH ST MM SKOM SPD SSI SIP SSOS SPSI MSI MKES MPD MH MT MBA AMD AMDKEB SKED SAG SKEP NS PHD MSC BSC".split())
SHORT_NAMES = {
    "ABD": "ABDUL", "ABDL": "ABDUL", "MUH": "MUHAMMAD", "MOH": "MUHAMMAD", "MHD": "MUHAMMAD", "MD": "MUHAMMAD", "MUHAMAD": "MUHAMMAD", "MOHAMMAD": "MUHAMMAD", "MOHAMAD": "MUHAMMAD",
    "MOCHAMAD": "MUHAMMAD", "MOHAMMED": "MUHAMMAD", "MUHAMMED": "MUHAMMAD", "MOCH": "MUHAMMAD", "RD": "RADEN", "SR": "SRI", "ST": "SITI", "SITTI": "SITI",
}
COMMON = frozenset(["ABDUL", "MUHAMMAD", "RADEN", "SRI", "SITI"])
MERCHANT_TYPES = {
    "TOKO BUKU": "TOKO BUKU", "TK BUKU": "TOKO BUKU", "TB": "TOKO BUKU", "KEDAI KOPI": "KEDAI KOPI", "KD KOPI": "KEDAI KOPI", "KEDAIKOPI": "KEDAI KOPI", "KEDAI": "KEDAI KOPI", "KK": "KEDAI KOPI", "KD": "KEDAI KOPI",
    "RUMAH MAKAN": "RUMAH MAKAN", "RM": "RUMAH MAKAN", "RUMAHMAKAN": "RUMAH MAKAN", "WARUNG": "WARUNG", "WRG": "WARUNG", "WR": "WARUNG", "WRNG": "WARUNG", "CV": "CV", "PT": "PT", "MINIMARKET": "MINIMARKET", "MINI MARKET": "MINIMARKET",
    "MINIMART": "MINIMARKET", "MM": "MINIMARKET", "KLINIK": "KLINIK", "KLNK": "KLINIK", "KLN": "KLINIK", "TOKO": "TOKO", "TK": "TOKO", "RESTORAN": "RESTORAN", "RESTO": "RESTORAN", "REST": "RESTORAN", "RST": "RESTORAN",
    "BENGKEL": "BENGKEL", "BKL": "BENGKEL", "BGKL": "BENGKEL", "APOTEK": "APOTEK", "APOTIK": "APOTEK", "APT": "APOTEK", "UD": "UD",
}
_LETTERS = str.maketrans("0158463@$", "OISBAGEAS")
NIK_FOLD = {"O": "0", "o": "0", "D": "0", "I": "1", "i": "1", "l": "1", "|": "1", "Z": "2", "z": "2", "A": "4", "S": "5", "s": "5", "b": "6", "G": "6", "B": "8", "g": "9", "q": "9"}
_MONTH = {m[:3]: i + 1 for i, m in enumerate(MONTHS)} | {"AGT": 8, "AUG": 8, "MAY": 5, "OCT": 10, "DEC": 12, "NOP": 11}


@lru_cache(100_000)
def sound(token: str) -> str:
    """Old and new spellings in one form, doubled letters single."""
    t = token
    for a, b in (("OE", "U"), ("DJ", "J"), ("TJ", "C"), ("NJ", "NY"), ("TH", "T"), ("DH", "D"), ("BH", "B"), ("KH", "K"), ("PH", "F"), ("Q", "K"), ("Z", "S"), ("X", "KS"), ("V", "F")):
        t = t.replace(a, b)
    t = re.sub(r"(.)\1+", r"\1", t)
    return re.sub(r"(?<=[^AEIOU])Y(?![AEIOU])", "I", t) if len(t) > 2 else t


def name_tokens(name: str | None) -> list[str]:
    """Tokens of a person's name in upper case, letters restored, titles and degrees left out."""
    if not name:
        return []
    out = []
    raw = name.upper()
    # a degree stands after a comma or has points inside; its letters are glued before comparing
    for part in re.split(r"[\s,;/]+", re.sub(r"(?<=[A-Z0-9]{3})\.(?=[A-Z0-9])", " ", raw)):
        bare = re.sub(r"[^A-Z0-9@$]", "", part)
        t = bare.translate(_LETTERS)
        if not t or not re.search(r"[A-Z]", t):
            continue
        if "." in part.strip(".") and t in DEGREES | TITLES or (t in TITLES and (part.endswith(".") or len(t) > 1)) or (t in ("H", "HJ") and not out):
            continue
        if "." in part.strip(".") and len(t) >= 3 and len(part.split(".")[0]) <= 2:
            for x in part.split("."):
                x = re.sub(r"[^A-Z0-9]", "", x).translate(_LETTERS)
                if x and x not in TITLES | DEGREES:
                    out.append(SHORT_NAMES.get(x, x))
            continue
        if t in DEGREES and len(out) >= 1 and t not in SHORT_NAMES:
            continue
        out.append(SHORT_NAMES.get(t, t))
    return out


@lru_cache(200_000)
def token_score(a: str, b: str) -> float:
    """How well one token stands for another: 1 equal, less for edits, short forms and initials, 0 for none."""
    if a == b:
        return 1.0
    if len(a) > len(b):
        a, b = b, a
    if len(a) == 1:
        return 0.6 if b[0] == a else 0.0
    sa, sb = sound(a), sound(b)
    if sa == sb:
        return 0.95
    n = min(len(sa), len(sb))
    if n >= 4 and osa(sa, sb, 2) <= (2 if n >= 9 else 1):
        return 0.9
    if n >= 4 and osa(a, b, 2) <= (2 if len(a) >= 8 else 1):
        return 0.85
    if len(a) >= 3 and (b.startswith(a) or b.endswith(a)):
        return 0.75
    if len(sa) >= 3 and (sb.startswith(sa) or sb.endswith(sa)):
        return 0.7
    return 0.0


def assignment(score: list[list[float]]) -> list[tuple[int, int]]:
    """Pairs of rows and columns of highest total score (shortest augmenting paths)."""
    rows, cols = len(score), len(score[0]) if score else 0
    n = max(rows, cols)
    if not rows or not cols:
        return []
    cost = [[-(score[i][j] if i < rows and j < cols else 0.0) for j in range(n)] for i in range(n)]
    u, v, p, way = [0.0] * (n + 1), [0.0] * (n + 1), [0] * (n + 1), [0] * (n + 1)
    for i in range(1, n + 1):
        p[0], j0 = i, 0
        least, used = [float("inf")] * (n + 1), [False] * (n + 1)
        while True:
            used[j0] = True
            i0, delta, j1 = p[j0], float("inf"), 0
            for j in range(1, n + 1):
                if not used[j]:
                    c = cost[i0 - 1][j - 1] - u[i0] - v[j]
                    if c < least[j]:
                        least[j], way[j] = c, j0
                    if least[j] < delta:
                        delta, j1 = least[j], j
            for j in range(n + 1):
                if used[j]:
                    u[p[j]] += delta
                    v[j] -= delta
                else:
                    least[j] -= delta
            j0 = j1
            if p[j0] == 0:
                break
        while j0:
            p[j0] = p[way[j0]]
            j0 = way[j0]
    return [(p[j] - 1, j - 1) for j in range(1, n + 1) if p[j] - 1 < rows and j - 1 < cols and score[p[j] - 1][j - 1] > 0]


def _unglue(a: list[str], b: list[str]) -> list[str]:
    """Tokens of a, where one begins or ends with a token of b it is cut there."""
    out = []
    for t in a:
        cut = next((u for u in sorted(b, key=len, reverse=True) if 4 <= len(u) <= len(t) - 2 and (t.startswith(u) or t.endswith(u))), None)
        if cut is None and len(t) >= 9:
            cut_at = next((k for u in b if 5 <= len(u) <= len(t) - 2 for k in (len(u), len(u) - 1, len(u) + 1) if 2 <= k <= len(t) - 2 and osa(t[:k], u, 1) <= 1), None)
            if cut_at:
                out += [t[:cut_at], t[cut_at:]]
                continue
            cut_at = next((k for u in b if 5 <= len(u) <= len(t) - 2 for k in (len(u), len(u) - 1, len(u) + 1) if 2 <= k <= len(t) - 2 and osa(t[-k:], u, 1) <= 1), None)
            if cut_at:
                out += [t[:-cut_at], t[-cut_at:]]
                continue
        if cut is None:
            out.append(t)
        elif t.startswith(cut):
            out += _unglue([cut], []) + _unglue([t[len(cut) :]], b)
        else:
            out += _unglue([t[: -len(cut)]], b) + [cut]
    return out


def name_match(a: list[str], b: list[str]) -> float:
    """0 where two names are not spellings of one; else the mean score of the shorter name's tokens, raised to 1.x by
    the number of strong tokens, so that callers can ask for more than one."""
    if not a or not b:
        return 0.0
    if sorted(a) == sorted(b):
        return 1.0 + len([t for t in a if len(t) > 2])
    ga, gb = _unglue(a, b), _unglue(b, a)
    if len(ga) > len(gb):
        ga, gb = gb, ga
    score = [[token_score(x, y) for y in gb] for x in ga]
    pairs = assignment(score)
    if len(pairs) < len(ga):
        if osa("".join(sorted(a)), "".join(sorted(b)), 2) <= 2 and min(len("".join(a)), len("".join(b))) >= 8:
            return 2.0
        return 0.0
    strong = sum(score[i][j] >= 0.8 and len(ga[i]) >= 3 for i, j in pairs)
    own = sum(score[i][j] >= 0.7 and ga[i] not in COMMON for i, j in pairs)
    if not own:
        return 0.0
    return sum(score[i][j] for i, j in pairs) / len(pairs) * 0.5 + strong


def fold_digits(s: str | None) -> str:
    """Digits of a number, letters read as the digits they resemble."""
    return "".join(NIK_FOLD.get(c, c if c.isdigit() else "") for c in s) if s else ""


def nik_birth(nik: str) -> str:
    """ddmmyy in an identity number, '' if there is none."""
    if len(nik) < 12:
        return ""
    d, m, y = int(nik[6:8]), int(nik[8:10]), nik[10:12]
    d -= 40 * (d > 40)
    return f"{d:02d}{m:02d}{y}" if 1 <= d <= 31 and 1 <= m <= 12 else ""


def birth(text: str | None) -> tuple[str, str]:
    """(ddmmyy, place) of a birth field, '' where missing."""
    if not text:
        return "", ""
    m = _DATE.search(text)
    day = ""
    rest = text
    if m:
        s = m.group()
        rest = text[: m.start()] + " , " + text[m.end() :]
        word = re.search(r"[A-Za-z]{3,}", s)
        if word and word.group()[:3].upper() in _MONTH and re.search(r"[A-Za-z]{3}", s):
            nums = re.findall(r"[0-9OoIlSZBD]+", s[: word.start()] + " " + s[word.end() :])
            if len(nums) >= 2:
                day = f"{fold_digits(nums[0]).zfill(2)}{_MONTH[word.group()[:3].upper()]:02d}{fold_digits(nums[-1])[-2:]}"
        else:
            nums = [fold_digits(x) for x in re.findall(r"[0-9OoIlSZBD]+", s)]
            if len(nums) == 3:
                nums = nums[::-1] if len(nums[0]) == 4 else nums
                day = f"{nums[0].zfill(2)}{nums[1].zfill(2)}{nums[2][-2:]}"
    rest = re.sub(r"(?i)tempat|tgl\.?|lahir|\bkab(?:upaten|\.)?(?=\s)|\bkota(?=\s)|gol\.?\s*darah\s*\w*|laki.laki|perempuan", " ", rest)
    p = re.search(r"[A-Za-z]{4,}(?: [A-Za-z]{4,})?", rest)
    return day, p.group().upper() if p else ""


_PROFILE = "struct<tokens:array<string>,nik:string,dob:string,place:string,born:string>"


def profiled(name: Column, nik: Column, ttl: Column) -> Column:
    """Struct of tokens, folded identity number, birth date and place from the birth field, date in the number."""

    @F.pandas_udf(_PROFILE)
    def run(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for n, k, t in batches:
            rows = []
            for x, y, z in zip(n, k, t):
                digits = fold_digits(y)
                day, place = birth(z)
                rows.append((name_tokens(x), digits if len(digits) >= 10 else "", day, place, nik_birth(digits)))
            yield pd.DataFrame(rows, columns=["tokens", "nik", "dob", "place", "born"])

    return run(name, nik, ttl)


def token_index(tokens: DataFrame, *, frequent: int = 3) -> DataFrame:
    """(token, rep): each distinct token with itself and all tokens one edit away (symmetric deletes), and with the
    frequent tokens it is glued from. tokens: (token, n). The joins are on hashes of deletes of distinct tokens, so
    a token that a third of all names hold costs as much as any other."""
    sounded = tokens.select("token", F.col("n"), sounding(F.col("token")).alias("s"))
    s = F.col("s")
    cut = F.transform(F.sequence(F.lit(1), F.length(s)), lambda i: F.concat(F.substring(s, F.lit(1), i - 1), F.substring(s, i + 1, F.length(s))))
    deletes = sounded.where(F.length(s) >= 4).select("token", "n", "s", F.explode(F.array_distinct(F.concat(F.array(s), cut))).alias("d"))
    others = deletes.select(F.col("token").alias("rep"), F.col("s").alias("rs"), F.col("n").alias("rn"), "d")
    # of two rare tokens the one with fewer rows goes to the other, so that both meet once
    towards = (F.col("rn") >= frequent) | (F.struct("n", "token") < F.struct("rn", "rep"))
    near1 = deletes.join(others, "d").where(towards & (F.levenshtein("s", "rs", 2) >= 0) & (F.abs(F.length("s") - F.length("rs")) <= 1)).select("token", "rep")
    words = tokens.where((F.col("n") >= frequent) & (F.length("token") >= 4)).select(F.col("token").alias("rep"))
    t = F.col("token")
    rare = tokens.where((F.length(t) >= 7) & (F.col("n") < frequent))
    ends = F.transform(F.sequence(F.lit(4), F.length(t) - 2), lambda i: F.substring(t, F.lit(1), i))
    tails = F.transform(F.sequence(F.lit(3), F.length(t) - 3), lambda i: F.substring(t, i, F.length(t)))
    parts = rare.select("token", F.explode(F.concat(ends, tails)).alias("rep")).join(words, "rep").select("token", "rep")
    self = tokens.select("token", F.col("token").alias("rep"))
    return self.unionAll(near1).unionAll(parts).distinct()


def sounding(token: Column) -> Column:
    """`sound` of a token column."""

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(sound)

    return run(token)


def same_person(a: dict, b: dict) -> bool:
    """Whether two profiles are one person: names that align, no contradiction, and evidence that suffices."""
    m = name_match(list(a["tokens"]), list(b["tokens"]))
    na, nb = a["nik"], b["nik"]
    if na and nb:
        if len(na) == 16 and len(nb) == 16:
            miss = sum(x != y for x, y in zip(na, nb))
            if miss > 2:
                return False
            if miss == 0:
                return m > 0 or not a["dob"] or not b["dob"] or a["dob"] == b["dob"]
            if m >= 1:
                return True
        else:
            short, long = sorted((na, nb), key=len)
            if len(short) < 16 and m >= 1 and (long.startswith(short) or long.endswith(short)):
                return True
            if len(short) >= 12 and short[:6] != long[:6] and short[6:12] != long[6:12]:
                return False
    if m <= 0:
        return False
    days = [(x, y) for x in (a["dob"], a["born"]) if x for y in (b["dob"], b["born"]) if y]
    same_day = any(x == y for x, y in days)
    if days and not same_day and not any(sum(p != q for p, q in zip(x, y)) <= 1 for x, y in days):
        return False
    house = agreement(a["a"], b["a"]) if a["a"] and b["a"] and a["a"]["street"] and b["a"]["street"] else None
    place = bool(a["place"] and b["place"] and near(a["place"], b["place"]))
    if a["place"] and b["place"] and not place and same_day and (house is None or house <= 0):
        return False
    if same_day:
        return place or (house is not None and house > 0) or m >= 2.4
    return house is not None and house > 0 and m >= 1


@lru_cache(100_000)
def name_keys(token: str) -> np.ndarray:
    """Hashes of the forms by which a token is met, among them one that it shares with every token that `name_match` lets
    stand for it: itself, the token and its sound with up to as many letters left out as `token_score` admits edits, and the
    beginnings and ends that `_unglue` would cut off."""
    keys = shortened(token, 2 if len(token) >= 8 else 1) | shortened(s := sound(token), 2 if len(s) >= 9 else 1) | {token}
    for k in range(4, len(token) - 1):
        for part in (token[:k], token[-k:]):
            keys |= shortened(part, 1) if len(token) >= 9 and k >= 5 else {part}
    return np.array([hash(k) for k in keys], np.int64)


def _met_before(kind: int, a: dict, b: dict) -> bool:
    """Whether two profiles share evidence of an earlier kind, by which they have been compared already."""
    if kind > 0 and ({a["dob"], a["born"]} & {b["dob"], b["born"]}) - {""}:
        return True
    na, nb = a["nik"], b["nik"]
    return bool(na and nb) and (kind > 1 and na[:10] == nb[:10] or kind > 2 and na[-8:] == nb[-8:])


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(x, y) of profiles of one bucket that are one person. Rows: bucket, kind, own, part, cross, pid, p (`_packed`)."""
    for group, t in whole_buckets(batches):
        kind, own, part, cross, pid = (t.column(c).to_numpy() for c in ("kind", "own", "part", "cross", "pid"))
        p = [x.split(_FIELD, 2) for x in t.column("p").to_pylist()]
        code: dict[str, int] = {}
        words = [[code.setdefault(w, len(code)) for w in x[0].split(_ITEM)] for x in p]
        keys = [name_keys(w) for w in code]
        size = np.array([len(k) for k in keys])
        flat = np.fromiter(itertools.chain.from_iterable(words), np.int64)
        n = size[flat]
        key = np.concatenate(keys)[spread((np.cumsum(size) - size)[flat], n)]
        row = np.repeat(np.repeat(np.arange(len(p)), [len(w) for w in words]), n)
        # equal full numbers meet whatever the names
        full = np.array([len(x[1]) == 16 for x in p])
        at = np.flatnonzero(full)
        digits = np.zeros((len(p), 16), np.uint8)
        if len(at):
            digits[at] = np.frombuffer("".join(p[i][1] for i in at).encode(), np.uint8).reshape(-1, 16)
            key, row = np.r_[key, np.array([hash(p[i][1]) for i in at], np.int64)], np.r_[row, at]
        out: list[tuple[int, int]] = []
        for x, y in sharing(group, row, key):
            # two that know a house only by its neighbour, or that lie in the same part of a bucket dealt out, meet elsewhere
            ok = (own[x] | own[y]) & (pid[x] != pid[y]) & (~cross[x] | (part[x] != part[y]))
            x, y = x[ok], y[ok]
            # full numbers that differ in more than two digits contradict each other
            ok = ~(full[x] & full[y]) | ((digits[x] != digits[y]).sum(1) <= 2)
            x, y = x[ok], y[ok]
            known = {i: _unpacked(p[i]) for i in np.unique(np.r_[x, y]).tolist()}
            out += [(i, j) for i, j in zip(x.tolist(), y.tolist()) if not _met_before(kind[i], known[i], known[j]) and same_person(known[i], known[j])]
        if out:
            ends = pid[np.array(out)]
            yield pa.RecordBatch.from_arrays([pa.array(ends.min(1)), pa.array(ends.max(1))], names=["x", "y"])


_FIELD, _ITEM = "\x1f", "\x1e"


def _packed(p: Column) -> Column:
    """A profile as one text, a third of the bytes of the struct: tokens, number, birth date, place, date in the number and,
    where there is an address, its components."""
    some = lambda c: F.coalesce(c, F.lit(""))
    house = F.when(p["a"].isNotNull(), F.concat_ws(_FIELD, *[some(p["a"][f]) for f in FIELDS]))
    return F.concat_ws(_FIELD, F.array_join(p["tokens"], _ITEM), *[some(p[f]) for f in ("nik", "dob", "place", "born")], house)


def _unpacked(p: list[str]) -> dict:
    dob, place, born, *a = p[2].split(_FIELD)
    return {"tokens": p[0].split(_ITEM), "nik": p[1], "dob": dob, "place": place, "born": born, "a": dict(zip(FIELDS, a)) if a else None}


def linked_persons(records: DataFrame, *, block: int = 20_000) -> DataFrame:
    """Pairs (rec_a, rec_b), rec_a < rec_b, of records of one person. records: rec_id, p (profile), a (components of the
    address or null), one row per rec_id. All profiles that share a piece of evidence and a form of a token (`name_keys`) or
    a full number are compared; the evidence of a house is an address that agrees in number, street and place. A profile moves once
    per piece of evidence; forms and pairs live only inside the task that holds the bucket, and what is written is the links.
    block: a bucket of more rows is dealt out by pairs of such blocks; it changes how the work is spread, not the result."""
    rec = records.select("rec_id", F.struct("p.tokens", "p.nik", "p.dob", "p.place", "p.born", "a").alias("p")).where(F.size("p.tokens") > 0)
    rec = stored(rec.withColumn("pid", F.xxhash64("p.tokens", "p.nik", "p.dob", "p.place", "p.born", F.col("p.a"))))
    prof = stored(rec.groupBy("pid").agg(F.first("p").alias("p")))
    housed = forms(prof.select("pid", F.col("p.a").alias("a")))
    since = len(_STORED)
    near_by = stored(agreeing_forms(housed.select("form", "a").dropDuplicates(["form"])))
    clear_stored(since, -1)
    piece = lambda kind, c: F.struct(F.lit(kind).cast("byte").alias("kind"), F.xxhash64(F.lit(kind), c).alias("ev"))
    day = lambda c: F.when(F.col(c) != "", piece(0, F.col(c)))
    number = F.when(F.col("p.nik") != "", piece(1, F.substring("p.nik", 1, 10)))
    tail = F.when(F.length("p.nik") >= 10, piece(2, F.substring("p.nik", -8, 8)))
    evidence = F.array_distinct(F.filter(F.array(day("p.dob"), day("p.born"), number, tail), lambda x: x.isNotNull()))
    pack = prof.withColumn("a", F.col("p.a")).withColumn("text", _packed(F.col("p")))
    ev = pack.select("pid", F.col("text").alias("p"), F.explode(evidence).alias("e"), F.lit(True).alias("own"))
    at_home = forms(pack).select("pid", F.col("text").alias("p"), "form")
    ev = ev.unionAll(at_home.select("pid", "p", piece(3, F.col("form")).alias("e"), F.lit(True).alias("own")))
    ev = ev.unionAll(at_home.join(near_by, F.col("form") == F.col("fa")).select("pid", "p", piece(3, F.col("fb")).alias("e"), F.lit(False).alias("own")))
    ev = ev.select("e.kind", F.col("e.ev").alias("bucket"), "own", "pid", "p")
    links = stored(dealt(ev, "pid", block).mapInArrow(_linked, "x long, y long"))
    one = components(links, "x", "y").select(F.col("label").alias("g"), F.col("node").alias("pid"))
    alone = prof.select("pid").join(one, "pid", "left").select("pid", F.coalesce("g", "pid").alias("g"))
    # pairs of profiles of a component that contradict each other stay apart; equal copies need certain evidence
    full = prof.select("pid", F.col("p.nik").alias("nik"), F.array_remove(F.array("p.dob", "p.born"), "").alias("days")).join(alone, "pid")
    a = full.select("g", F.col("pid").alias("pa"), F.col("nik").alias("na"), F.col("days").alias("da"))
    b = full.select("g", F.col("pid").alias("pb"), F.col("nik").alias("nb"), F.col("days").alias("db"))
    numbers = (F.length("na") == 16) & (F.length("nb") == 16)
    close = F.exists("da", lambda x: F.exists("db", lambda y: F.levenshtein(x, y) <= 2))
    against = (numbers & (F.levenshtein("na", "nb") > 2)) | (~(numbers & (F.col("na") == F.col("nb"))) & (F.size("da") > 0) & (F.size("db") > 0) & ~close)
    pairs = a.join(b, "g").where("pa < pb").where(~against).select("pa", "pb").unionAll(distinctive(prof).select(F.col("pid").alias("pa"), F.col("pid").alias("pb")))
    ids = rec.select("pid", "rec_id")
    left, right = ids.select(F.col("pid").alias("pa"), F.col("rec_id").alias("x")), ids.select(F.col("pid").alias("pb"), F.col("rec_id").alias("y"))
    out = pairs.join(left, "pa").join(right, "pb").where("pa <> pb or x < y")
    return out.select(F.least("x", "y").alias("rec_a"), F.greatest("x", "y").alias("rec_b")).distinct()


def distinctive(prof: DataFrame) -> DataFrame:
    """Profiles whose equal copies are certainly one person: they hold a number, a birth date with place, or a house."""
    housed = (F.col("p.a.number") != "") & ((F.col("p.a.village") != "") | (F.col("p.a.district") != "") | (F.col("p.a.city") != ""))
    return prof.where((F.length("p.nik") >= 12) | ((F.col("p.dob") != "") & (F.col("p.place") != "")) | F.coalesce(housed, F.lit(False))).select("pid")


# --- merchants -----------------------------------------------------------------------------------------------------


def merchant_parts(name: str | None, cities: frozenset[str]) -> tuple[str, list[str]]:
    """(kind of business, other tokens); branch, branch number and city are left out."""
    if not name:
        return "", []
    t = name.upper()
    t = re.sub(r"\(.*?\)?$", " ", t) if "(" in t else t
    t = re.sub(r"[-,\s]*\b(?:CABANG|CAB)\b.*$", " ", t)
    t = re.sub(r"#\s*[0-9OIl]+", " ", t)
    t = re.sub(r"\b([A-Z])\.(?=[A-Z]\.)", r"\1", t)  # C.V. -> CV.
    t = re.sub(r"\b([A-Z]{2})\.", r"\1 ", t)
    words = [w for w in re.split(r"[^A-Z0-9@$]+", t) if w]
    words = [w if w.isdigit() else w.translate(_LETTERS) for w in words]
    words = [w for w in words if not w.isdigit()]
    while len(words) > 2 and (words[-1] in cities or any(near(words[-1], c) for c in cities if abs(len(c) - len(words[-1])) <= 1 and len(c) >= 7)):
        words.pop()
    for k in (2, 1):
        for i in (0, len(words) - k):
            if 0 <= i and len(words) > k and " ".join(words[i : i + k]) in MERCHANT_TYPES:
                return MERCHANT_TYPES[" ".join(words[i : i + k])], words[:i] + words[i + k :]
    for k in (2, 1):  # mistyped or glued kind
        for i in (0, len(words) - k):
            if 0 <= i and len(words) > k:
                w = " ".join(words[i : i + k])
                hit = next((v for c, v in MERCHANT_TYPES.items() if len(c) >= 5 and len(c.split()) == k and osa(w, c, 2) <= (2 if len(c) >= 9 else 1)), None)
                if hit:
                    return hit, words[:i] + words[i + k :]
    if words:
        w = words[0]
        hit = next((c for c in sorted(MERCHANT_TYPES, key=len, reverse=True) if " " not in c and len(w) - len(c) >= 4 and w.startswith(c) and len(c) >= 2), None)
        if hit:
            return "?" + MERCHANT_TYPES[hit], [w[len(hit) :], *words[1:]]
    return "", words


def merchant_match(kind_a: str, a: list[str], kind_b: str, b: list[str]) -> float:
    """Score of a spelling (a) against a reference merchant (b), 0 for none. b: core and, mostly, a second word."""
    if not a or not b:
        return 0.0
    if kind_a.startswith("?"):  # a kind glued to the core: only if it is the reference's kind
        if kind_a[1:] != kind_b:
            return 0.0
        kind_a = kind_b
    if kind_a and kind_a != kind_b:
        return 0.0
    core, second = b[0], (b[1] if len(b) > 1 else "")
    best = 0.0
    for i, w in enumerate(a):
        others = a[:i] + a[i + 1 :]
        forms = [(w, others)]
        if second and len(w) > len(second) + 3 and w.endswith(second):
            forms.append((w[: -len(second)], [*others, second]))
        elif second and len(others) == 0 and len(w) > len(core):
            tail = w[len(core) :]
            if second.startswith(tail) and len(tail) >= 1 and w.startswith(core):
                forms.append((core, [tail]))
        for c, rest in forms:
            d = osa(c, core, 2)
            n = min(len(c), len(core))
            if d > 2 or (d == 2 and n < 8 and sound(c) != sound(core)) or (d == 1 and n < 4):
                if not (len(c) >= 5 and sound(c) == sound(core)):
                    continue
                d = 1
            if len(rest) > 1:
                continue
            if rest and not second:
                continue
            s = 1.0 - 0.1 * d
            if rest:
                r = rest[0]
                fits = second.startswith(r) or osa(r, second, 2) <= (2 if len(second) >= 7 else 1) or (len(r) >= 3 and osa(r, second[: len(r)], 1) <= 1)
                if not fits:
                    continue
                s += 0.2
            best = max(best, s + 0.1 * bool(kind_a))
    return best


_PARTS = "struct<kind:string,words:array<string>>"


def merchant_parsed(name: Column, cities: list[str]) -> Column:
    @F.pandas_udf(_PARTS)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        known = frozenset(cities)
        for s in batches:
            yield pd.DataFrame([merchant_parts(x, known) for x in s], columns=["kind", "words"])

    return run(name)


def _merchant_score(a: Column, b: Column) -> Column:
    @F.pandas_udf("double")
    def run(batches: Iterator[tuple[pd.DataFrame, pd.DataFrame]]) -> Iterator[pd.Series]:
        for x, y in batches:
            yield pd.Series([merchant_match(k, list(w), l, list(v)) for k, w, l, v in zip(x["kind"], x["words"], y["kind"], y["words"])], dtype=float)

    return run(a, b)


def linked_merchants(receipts: DataFrame, reference: DataFrame, cities: list[str]) -> DataFrame:
    """Pairs (merchant_id, rec_id) of receipts whose name means a merchant of the reference. Distinct spellings are
    matched, not rows, so a merchant with a third of all receipts costs no more than another; the best merchant wins,
    and a spelling that fits two equally well is left out."""
    spell = stored(receipts.where("merchant_name is not null").select("merchant_name").distinct().withColumn("m", merchant_parsed(F.col("merchant_name"), cities)))
    ref = stored(reference.select("merchant_id", merchant_parsed(F.col("merchant_name"), []).alias("r")))
    seen = spell.select(F.explode("m.words").alias("token")).where("length(token) >= 3").distinct().select("token", F.lit(0).alias("n"))
    cores = ref.select(F.col("r.words")[0].alias("token")).distinct().select("token", F.lit(9).alias("n"))
    vocabulary = seen.unionAll(cores).groupBy("token").agg(F.max("n").alias("n"))
    # two edits for long cores: deletes on both sides, on tokens and cores
    index = stored(token_index(stored(vocabulary)).unionAll(two_edits(vocabulary)).distinct())
    pairs = spell.select("merchant_name", "m", F.explode(F.array_distinct("m.words")).alias("token")).join(index, "token")
    pairs = pairs.join(ref.withColumn("rep", F.col("r.words")[0]), "rep").select("merchant_name", "m", "merchant_id", "r").dropDuplicates(["merchant_name", "merchant_id"])
    scored = pairs.withColumn("s", _merchant_score(F.col("m"), F.col("r"))).where("s > 0")
    best = scored.groupBy("merchant_name").agg(F.max(F.struct("s", "merchant_id")).alias("top"), F.max(F.struct("s", (-F.col("merchant_id")).alias("other"))).alias("tie"))
    best = best.where(F.col("top.merchant_id") == -F.col("tie.other")).select("merchant_name", F.col("top.merchant_id").alias("merchant_id"))
    return receipts.select("merchant_name", "rec_id").join(best, "merchant_name").select("merchant_id", "rec_id").distinct()


def two_edits(vocabulary: DataFrame) -> DataFrame:
    """(token, rep) of tokens of eight letters or more within two edits of a frequent one, by deletes of up to two."""
    base = vocabulary.where(F.length("token") >= 8)
    one = lambda c: F.transform(F.sequence(F.lit(1), F.length(c)), lambda i: F.concat(F.substring(c, F.lit(1), i - 1), F.substring(c, i + 1, F.length(c))))
    d1 = F.array_distinct(F.concat(F.array(F.col("token")), one(F.col("token"))))
    d2 = F.array_distinct(F.concat(d1, F.flatten(F.transform(d1, one))))
    deletes = base.select("token", "n", F.explode(d2).alias("d"))
    often = deletes.where("n > 0").select(F.col("token").alias("rep"), "d")
    return deletes.select("token", "d").join(often, "d").select("token", "rep").distinct().where(F.levenshtein("token", "rep", 4) >= 0)
