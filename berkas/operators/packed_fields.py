"""Several values packed in one field: one row per value, with its position.

The field is covered by segments: whole values that a dictionary knows (found by a multi-pattern automaton), values
that a shape gives away (dates, quoted text, numbers), labels and separators. Dynamic programming picks the cover of
highest weight, so a delimiter inside a known or quoted value is never taken for a separator.

Edge cases: null, empty and blank fields give no rows; a field of only separators gives no rows; a value that is
missing before another keeps its place (the next one has position 2); repeated rows give the same rows again, which the
query makes distinct; text of any length is processed whole in time linear in it (segments have bounded length except
quoted and unknown runs, of which there is one per start).
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Labels, qualifiers and further items printed on the cards.
BIRTH_LABELS = ("TEMPAT/TGL LAHIR", "TEMPAT/TGL. LAHIR", "TEMPAT, TGL LAHIR", "TEMPAT TGL LAHIR", "TEMPAT & TGL LAHIR", "TTL", "LAHIR")
QUALIFIERS = ("KABUPATEN", "KAB.", "KAB", "KOTA", "KODYA", "KOTAMADYA", "KOTIP")
SEXES = ("LAKI-LAKI", "LAKI LAKI", "LAKI - LAKI", "PEREMPUAN", "PRIA", "WANITA")
MONTHS = ("JANUARI", "FEBRUARI", "MARET", "APRIL", "MEI", "JUNI", "JULI", "AGUSTUS", "SEPTEMBER", "OKTOBER", "NOVEMBER", "DESEMBER")

QUOTES = {'"': '"', "'": "'", "“": "”", "‘": "’", "«": "»"}
_D = "[0-9OoIlSZBD]"
_DATE = re.compile(
    rf"(?<![0-9A-Za-z])(?:{_D}{{1,2}}(?P<s>[-/. ])\s?{_D}{{1,2}}(?P=s)\s?{_D}{{4}}|{_D}{{4}}[-/.]{_D}{{1,2}}[-/.]{_D}{{1,2}}|{_D}{{1,2}}[-. ]\s?[A-Za-z0-9@]{{3,9}}\.?[-. ]\s?{_D}{{4}}|{_D}{{8}})(?![0-9A-Za-z])"
)
_BLOOD = re.compile(r"GOL(?:ONGAN|\.)?\s*DARAH\s*:?\s*(?:AB|A|B|O|0|-)[+-]?(?![A-Za-z])|GOL\.?\s*(?:AB|A|B|O)(?![A-Za-z])", re.I)
_NUMBER = re.compile(r"[0-9OoIlSZBD]{1,3}(?![0-9A-Za-z])")
_HOOD_LABEL = re.compile(r"RT\s*/\s*RW|RT|RW", re.I)
_WORD = re.compile(r"[^\s,;|/\\\-.:=\"“”]+")
_RUN = re.compile(rf"{_WORD.pattern}(?:(?:[ ]|-|\. ?){_WORD.pattern})*")
_QUALIFIED = re.compile(rf"(?:^|[^A-Z])({'|'.join(map(re.escape, sorted(QUALIFIERS, key=len, reverse=True)))})\s*$")
#: words without which a text need not be searched for sexes and labels
_SEXED, _LABELLED = re.compile("LAKI|PEREM|PRIA|WANITA"), re.compile("LAHIR|TTL")
_HARD = ",;|/\\&"
_SOFT = " \t\r\n-.:=_"


def automaton(words):
    """A multi-pattern automaton over upper-cased values; None for an empty dictionary. words: values, or pairs of a value
    and whether it is a wider unit, which qualifies the place before it."""
    import ahocorasick

    a = ahocorasick.Automaton()
    for w in words:
        w, wide = (w, False) if isinstance(w, str) else w
        if w:
            a.add_word(_upper(w), (len(w), bool(wide)))
    if not len(a):
        return None
    a.make_automaton()
    return a


def _upper(text: str) -> str:
    u = text.upper()
    return u if len(u) == len(text) else "".join(c.upper() if len(c.upper()) == 1 else c for c in text)


def _edge(text: str, a: int, b: int) -> bool:
    """Whether [a, b) begins and ends at word edges."""
    return not (a > 0 and text[a - 1].isalnum() and text[a].isalnum()) and not (b < len(text) and text[b].isalnum() and text[b - 1].isalnum())


def _quoted(text: str) -> list[tuple[int, int]]:
    """Spans from an opening quote to the first matching closing one that a separator or the end follows."""
    out = []
    i, n = 0, len(text)
    while i < n:
        close = QUOTES.get(text[i])
        if close and (i == 0 or not text[i - 1].isalnum()):
            j = text.find(close, i + 1)
            if j > i + 1:
                out.append((i, j + 1))
                i = j + 1
                continue
        i += 1
    return out


def birth_segments(text: str, known) -> list[tuple[int, int, str, float]]:
    """Candidate segments (start, end, kind, weight) of a birth field. known: an automaton or None."""
    up, n = _upper(text), len(text)
    segs: list[tuple[int, int, str, float]] = []
    places, wide = [], set()
    if known is not None:
        for end, (length, wider) in known.iter(up):
            a, b = end - length + 1, end + 1
            if _edge(up, a, b):
                places.append((a, b))
                if wider:
                    wide.add((a, b))
    grown = []
    for a, b in places:
        head = up[max(0, a - 14) : a]
        if (m := _QUALIFIED.search(head)) is not None:
            grown.append((a - len(head) + m.start(1), b))
            if (a, b) in wide:
                wide.add(grown[-1])
    spans = {*places, *grown}
    starts = {}
    for a, b in spans:
        starts.setdefault(a, []).append(b)
    for a, b in sorted(spans):
        segs.append((a, b, "value", 4.0 * (b - a) - 2))
        # a larger unit after a comma qualifies the place before it
        m = re.compile(r"\s*,\s*").match(text, b)
        if m:
            for c in starts.get(m.end(), ()):
                if (m.end(), c) in wide and (a, b) not in wide:
                    segs.append((a, c, "value", 4.0 * (c - a)))
    for m in _DATE.finditer(text):
        if sum(c.isdigit() for c in m.group()) >= 4:
            segs.append((m.start(), m.end(), "date", 5.0 * (m.end() - m.start())))
    for m in _BLOOD.finditer(text) if "GOL" in up else ():
        segs.append((m.start(), m.end(), "item", 4.0 * (m.end() - m.start())))
    for s in SEXES if _SEXED.search(up) else ():
        i = up.find(s)
        while i >= 0:
            if _edge(up, i, i + len(s)):
                segs.append((i, i + len(s), "item", 4.0 * len(s)))
            i = up.find(s, i + 1)
    for label in BIRTH_LABELS if _LABELLED.search(up) else ():
        i = up.find(label)
        while i >= 0:
            if _edge(up, i, i + len(label)):
                j = i + len(label)
                while j < n and text[j] in " :=-":
                    j += 1
                segs.append((i, j, "label", 4.5 * (j - i)))
            i = up.find(label, i + 1)
    for a, b in _quoted(text):
        segs.append((a, b, "quoted", 8.0 * (b - a)))
    # unknown runs: words up to the next separator, for values the dictionary lacks
    for m in _RUN.finditer(text):
        segs.append((m.start(), m.end(), "unknown", 1.0 * (m.end() - m.start()) - 0.5))
        for w in _WORD.finditer(text, m.start(), m.end()):
            segs.append((w.start(), w.end(), "unknown", 0.9 * (w.end() - w.start()) - 1))
    return segs


def hood_segments(text: str) -> list[tuple[int, int, str, float]]:
    """Candidate segments of a neighbourhood-number field."""
    segs = []
    for m in re.finditer(r"[A-Za-z]{2,}", text):
        word = m.group().upper()
        if word not in ("RT", "RW", "RTO", "RWO") and not re.fullmatch(r"[OISZBDL]{1,3}|R[TW][OISZBDL]{0,3}", word):
            return []  # running text, no neighbourhood number
    for m in _HOOD_LABEL.finditer(text):
        segs.append((m.start(), m.end(), "rw" if m.group().upper() == "RW" else "label", 6.0 * (m.end() - m.start())))
    for a in range(len(text)):
        m = _NUMBER.match(text, a)
        if m and any(c.isdigit() for c in m.group()) and (a == 0 or not text[a - 1].isdigit()):
            segs.append((a, m.end(), "value", 5.0 * (m.end() - a) - 1))
    for a, b in _quoted(text):
        inner = text[a + 1 : b - 1].strip()
        if _NUMBER.fullmatch(inner):
            segs.append((a, b, "quoted", 8.0 * (b - a)))
    return segs


def best_cover(n: int, segs: list[tuple[int, int, str, float]]) -> list[tuple[int, int, str]]:
    """The non-overlapping segments of highest total weight; of equals the one found first."""
    by_start: dict[int, list[tuple[int, str, float]]] = {}
    for a, b, kind, w in segs:
        by_start.setdefault(a, []).append((b, kind, w))
    best: list[float] = [-1.0] * (n + 1)
    back: list[tuple[int, str] | None] = [None] * (n + 1)
    best[0] = 0.0
    for i in range(n):
        if best[i] > best[i + 1]:
            best[i + 1], back[i + 1] = best[i], (i, "")
        for b, kind, w in by_start.get(i, ()):
            if best[i] + w > best[b]:
                best[b], back[b] = best[i] + w, (i, kind)
    out, i = [], n
    while i > 0:
        a, kind = back[i]
        if kind:
            out.append((a, i, kind))
        i = a
    return out[::-1]


def _clean(text: str, a: int, b: int, kind: str) -> str:
    piece = text[a:b].strip()
    if kind == "quoted":
        piece = piece[1:-1].strip()
    return piece


def unpack(text: str | None, kind: str, known=None) -> list[tuple[int, str]]:
    """(position, value) of each value in `text`."""
    if text is None or not text.strip():
        return []
    segs = birth_segments(text, known) if kind == "birth" else hood_segments(text)
    cover = [s for s in best_cover(len(text), segs)]
    out: list[tuple[int, str]] = []
    pos, last = 0, 0
    kinds = [k for _, _, k in cover]
    for at, (a, b, k) in enumerate(cover):
        between = text[last:a]
        last = b
        if k == "label":
            continue
        if k == "rw":
            if pos == 0:
                pos = 1
            continue
        piece = _clean(text, a, b, k)
        if not piece or not any(c.isalnum() for c in piece):
            continue
        hard = sum(between.count(c) for c in _HARD)
        if not out and pos == 0:
            lead = hard or between.strip(" \t\r\n:=.") not in ("",)
            if kind == "birth":
                dated = k == "date" or (k == "quoted" and _DATE.fullmatch(piece) is not None)
                later = any(x in ("value", "unknown") or (x == "quoted" and _DATE.fullmatch(_clean(text, c, d, x)) is None) for (c, d, _), x in zip(cover[at + 1 :], kinds[at + 1 :]))
                pos = 1 if lead and dated and not later else 0
            else:
                pos = 1 if hard else 0
        elif hard > 1:
            pos += hard - 1
        pos += 1
        out.append((pos, piece))
    return out


_PIECES = "array<struct<pos:int,piece:string>>"


def unpacked(value: Column, kind: str, words: list) -> Column:
    """Array of (pos, piece) of a text column. words: the dictionary, small enough to go along with each task."""

    @F.pandas_udf(_PIECES)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known = automaton(words)
        for s in batches:
            # a value that many records share is cut once a batch
            cut = {t: [{"pos": p, "piece": v} for p, v in unpack(t, kind, known)] for t in set(s.dropna())}
            yield s.map(lambda t: cut.get(t, []))  # noqa: B023

    return run(value)


def unpacked_by_hits(value: Column, hits: Column, kind: str) -> Column:
    """As unpacked, where each row brings the dictionary values (word, wide) that it may hold."""

    @F.pandas_udf(_PIECES)
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for s, h in batches:
            known = [automaton([] if w is None else [(x["word"], x["wide"]) for x in w]) for w in h]
            yield pd.Series([[{"pos": p, "piece": v} for p, v in unpack(t, kind, k)] for t, k in zip(s, known)], dtype=object)

    return run(value, hits)


def known_values(*columns: tuple[DataFrame, str], min_rows: int = 2) -> DataFrame:
    """The dictionary: distinct values of reference columns (administrative units) without their qualifier, seen in at
    least `min_rows` rows so that a single misreading is no entry. One column, `word`; counted over all rows."""
    out = None
    for df, name in columns:
        part = df.select(F.upper(F.trim(F.col(name))).alias("word"))
        out = part if out is None else out.unionAll(part)
    bare = F.regexp_replace("word", r"^(KABUPATEN|KAB\.|KAB|KOTA|KODYA|PROVINSI)\s+", "")
    return out.where(F.col("word").rlike(r"[\p{L}\p{N}]")).groupBy(bare.alias("word")).agg(F.count("*").alias("n")).where(F.col("n") >= min_rows).select("word")


def _runs(text: Column) -> Column:
    """The runs of letters and digits of a text, upper case."""
    return F.filter(F.split(F.upper(text), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def split_packed(df: DataFrame, key: str, fields: dict[str, str], words: DataFrame, *, broadcast_limit: int = 50_000) -> DataFrame:
    """One row (key, field_name, pos, piece) per value in the columns `fields` (column -> kind) of `df`. words: the
    dictionary (word and, if there, wide: a unit that qualifies the place before it).

    A dictionary of up to `broadcast_limit` words goes to each task in the closure. Beyond that each row brings the words
    that it may hold: runs of letters and digits of dictionary and field are joined, in sequences as long as the longest
    word of the dictionary. A word can stand in a field at word edges only where its runs do, so no hit is missing, and the
    same automaton and cover decide: the result is the same."""
    words = words if "wide" in words.columns else words.withColumn("wide", F.lit(False))
    words = words.select("word", "wide")
    got = [(r["word"], r["wide"]) for r in words.limit(broadcast_limit + 1).collect()]
    parts = None
    for name, kind in fields.items():
        src = df.select(F.col(key).alias("key"), F.col(name).alias("packed")).where("packed is not null")
        if len(got) <= broadcast_limit or kind != "birth":
            found = src.withColumn("p", unpacked(F.col("packed"), kind, got if kind == "birth" else []))
        else:
            entries = words.withColumn("runs", _runs(F.col("word"))).where("size(runs) > 0").select("word", "wide", F.size("runs").alias("n"), F.array_join("runs", " ").alias("gram"))
            longest = entries.agg(F.max("n")).first()[0] or 1
            grams = F.flatten(F.transform(F.sequence(F.lit(1), F.least(F.lit(longest), F.size("runs"))), lambda n: F.transform(F.sequence(F.lit(1), F.size("runs") - n + 1), lambda i: F.array_join(F.slice("runs", i, n), " "))))
            texts = src.select("packed").distinct().withColumn("runs", _runs(F.col("packed"))).where("size(runs) > 0")
            hits = texts.select("packed", F.explode(F.array_distinct(grams)).alias("gram")).join(entries, "gram")
            hits = hits.groupBy("packed").agg(F.collect_set(F.struct("word", "wide")).alias("hits"))
            found = src.join(hits, "packed", "left").withColumn("p", unpacked_by_hits(F.col("packed"), F.col("hits"), kind))
        rows = found.select("key", F.lit(name).alias("field_name"), F.explode("p").alias("p")).select(F.col("key").alias(key), "field_name", "p.pos", "p.piece")
        parts = rows if parts is None else parts.unionAll(rows)
    return parts
