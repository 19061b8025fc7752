"""Personal information in free text: found, typed, and replaced by placeholders.

Regular expressions propose spans. Validators confirm or reject them: the date inside an identity number, Luhn for
payment cards, mod-97 for bank accounts, digit counts for phone and tax numbers. Words near the span raise or lower its
score; a span counts from `THRESHOLD` on. Names are proposed by a dictionary of name tokens and joined with their
neighbours; misread letters are allowed for. Which words announce a name is learnt from the texts (`name_contexts`). Of overlapping spans the one with the higher score stays.

Edge cases: a null or empty text has no spans and stays as it is; texts of any length are searched whole; the same value
twice gives two spans; repeated rows give the same spans, which the query makes distinct; an empty dictionary of names
finds no names and everything else as before. Positions are counted in code points.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from berkas.session import stored

THRESHOLD = 0.5
#: a token of the register said more than WORD_LEAST times, and WORD_RATE times as often a row as names are, is a plain word too
#: and PLAIN_RATE times as often no name at all
WORD_LEAST = 20
WORD_RATE = 2.5
PLAIN_RATE = 8.0
#: mark of such a token in a list of tokens
WEAK = "?"
#: what stands between the tokens of a register name; any other sign inside a token is a misread letter
NAME_BREAK = r"[\s.,;:/()\"]+"
# Digits and signs that scanning puts for letters.
MISREAD_FROM, MISREAD_TO = "0158@43+|", "OISBAAETI"

# Words that speak for or against a kind of number, and labels of names.
PHONE_WORDS = re.compile(r"(?i)telp|telepon|phone|hp\b|kontak|contact|hubungi|layanan|darurat|wa\b|fax|call")
CODE_WORDS = re.compile(r"(?i)\b(?:resi|unggah|seri|serial|pesanan|order|tracking|kode|code|upload|parcel|faktur|invoice|inv|po|agenda|halaman|page)\b[^.;]{0,12}$")
NIK_WORDS = re.compile(r"(?i)nik|identitas|identity|ktp")
TAX_WORDS = re.compile(r"(?i)npwp|tax|pajak")
SIM_WORDS = re.compile(r"(?i)\bsim\b|licen[cs]e|mengemudi")
TITLE_BEFORE = frozenset("H HJ DR DRG DRS DRA IR PROF MR MRS MS BAPAK IBU PAK BU SDR SDRI YTH TN NY NN".split())
FIRM_BEFORE = frozenset("PT CV UD TOKO WARUNG KLINIK APOTEK BENGKEL RESTORAN RESTO RUMAH MAKAN MINIMARKET KEDAI KOPI FA FIRMA YAYASAN KOPERASI".split())
NAME_LABELS = re.compile(r"(?i)(?:\bnam[ae]|atas nama|a\.n\.)\s*:?\s*$")
COMMON = frozenset(["ABDUL", "MUHAMMAD", "RADEN", "SRI", "SITI"])

_D = "[0-9OoIlSZB]"
_EMAIL = re.compile(r"(?<![\w.@+-])[A-Za-z0-9][\w.+-]*(?:\s?@\s?|\s?\[\s?at\s?\]\s?|\s?\(at\)\s?)[A-Za-z0-9][A-Za-z0-9-]*(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}(?![\w@])")
_PHONES = [
    re.compile(rf"(?<![\w+/.-])(?:\+?6[2Z])[ .-]?(?:\([0O]\))?[ .-]?[8B]{_D}{{1,2}}(?:[ .-]?{_D}{{2,11}}){{1,3}}(?![0-9A-Za-z]|[-.][0-9])"),
    re.compile(rf"(?<![\w+.-])[0O][8B]{_D}{{1,2}}(?:[ .-]?{_D}{{2,9}}){{1,3}}(?![0-9A-Za-z]|[-.][0-9])"),
    re.compile(rf"(?<![\w])\([0O]{_D}{{2,3}}\)\s?{_D}{{3,4}}[ .-]?{_D}{{3,4}}(?![0-9A-Za-z])"),
    re.compile(rf"(?<![\w+.-])[0O][2-7]{_D}{{1,2}}[ .-]{_D}{{3,4}}[ .-]?{_D}{{3,4}}(?![0-9A-Za-z]|[-.][0-9])"),
]
_SLASHED = re.compile(rf"(?<=/)(?:\+?62|[0O])[ .-]?(?:\([0O]\))?[ .-]?[0-9(][0-9 ().-]{{6,16}}[0-9](?![0-9A-Za-z])")
_NIK = re.compile(rf"(?<![0-9A-Za-z+])(?<![0-9][.-])(?:{_D}{{16}}|{_D}{{4}}(?:[ .-]{_D}{{4}}){{3}}|{_D}{{6}}[-. ]{_D}{{6}}[-. ]{_D}{{4}})(?![0-9A-Za-z]|[.-][0-9])")
_TAX = re.compile(rf"(?<![0-9A-Za-z+])(?:{_D}{{2}}\.{_D}{{3}}\.{_D}{{3}}\.{_D}[-.]{_D}{{3}}\.{_D}{{3}}|{_D}{{15}})(?![0-9A-Za-z])")
_SIM = re.compile(rf"(?<![0-9A-Za-z+.-])(?:{_D}{{12}}|{_D}{{4}}(?:[ .-]{_D}{{4}}){{2}})(?![0-9A-Za-z]|[ .-][0-9]{{4}})")
_CUT = re.compile(rf"(?<![0-9A-Za-z+.-]){_D}{{10,17}}(?![0-9A-Za-z])")
_CARD = re.compile(r"(?<![0-9A-Za-z])[0-9]{4}(?:[ -]?[0-9]{4}){2}[ -]?[0-9]{1,7}(?![0-9A-Za-z])")
_IBAN = re.compile(r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?:\s?[A-Z0-9]{4}){2,7}(?:\s?[A-Z0-9]{1,3})?(?![0-9A-Za-z])")
_FOLD = str.maketrans("OoIlSZB", "0011528")
#: a stretch of digits, letters that resemble them, and signs inside numbers
_RUN = re.compile(r"[+(]?[0-9OoIlSZB][0-9OoIlSZB .()/+-]{6,}")
_AT = re.compile(r"@|\[\s?at\s?\]|\(at\)")
_STREET = re.compile(
    r"(?<![\w])(?:Jalan|JALAN|jalan|Jln|JLN|jln|J[lL1I]|jl|Gang|GANG|gang|Gg|GG|gg)(?:\.\s{0,2}|\s{1,2})"
    r"(?P<name>[A-Z0-9@+][\w@+'-]*(?:\s(?!(?:[Nn][Oo0]|NOMOR|[Nn]omor)\b)[A-Z@+][\w@+'-]*\.?|\s[IVX]{1,4}|\s[0-9]{1,2}(?=[\s,]))*)"
    r"(?:\s*,\s*|\s+)(?:(?:[Nn][Oo0]m[o0]r|N[O0]M[O0]R|[Nn][Oo0])[.:]?\s*|#\s*)?(?P<no>[0-9OIlZSB]*[0-9][0-9OIlZSB]*(?:\s?-?\s?[A-F](?![\w]))?)(?![0-9A-Za-z])"
)
_PARTS = [
    re.compile(r"R[Tt][.:\s]*[0-9OIlSZB]{1,3}\s*(?:/|,|\s)\s*(?:R[Ww][.:\s]*)?[0-9OIlSZB]{1,3}(?![0-9A-Za-z])"),
    re.compile(r"R[TtWw][.:\s]*[0-9OIlSZB]{1,3}(?![0-9A-Za-z])"),
    re.compile(r"(?:Kelurahan|KELURAHAN|kelurahan|Kel|KEL|kel|Desa|DESA|desa|Ds|DS|ds)(?:\.\s*|\s)[A-Za-z][\w@+]+"),
    re.compile(r"(?:Kecamatan|KECAMATAN|kecamatan|Kec|KEC|kec)(?:\.\s*|\s)[A-Za-z][\w@+]+(?:\s(?:Lor|LOR|lor|Kidul|KIDUL|Wetan|WETAN|Kulon|KULON))?"),
    re.compile(r"(?:Kabupaten|KABUPATEN|kabupaten|Kab|KAB|kab|Kota|KOTA|kota|Kodya|KODYA|kodya)(?:\.\s*|\s)[A-Z][\w@+]+"),
    re.compile(r"[0-9]{5}(?![0-9A-Za-z]|[.,][0-9])"),
]
_WORD = re.compile(r"[A-Za-z0-9@+'|]+")
_CAP = re.compile(r"(?<![\w@.+-])[A-Z0-9@][A-Za-z0-9@+|']*")


class Span(NamedTuple):
    start: int
    end: int
    kind: str
    score: float


def luhn(digits: str) -> bool:
    """Whether the last digit is the Luhn check of the others."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c)
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def mod97(account: str) -> bool:
    """Whether an international account number has remainder 1 (ISO 7064)."""
    s = re.sub(r"\s", "", account).upper()
    return len(s) >= 15 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def nik_valid(digits: str) -> bool:
    """Whether 16 digits hold a day (women's by 40 more) and month at the places of the birth date."""
    if len(digits) != 16:
        return False
    d, m = int(digits[6:8]), int(digits[8:10])
    return (1 <= d <= 31 or 41 <= d <= 71) and 1 <= m <= 12


def _digits(s: str) -> str:
    return re.sub(r"[^0-9]", "", s.translate(_FOLD))


def _real(s: str) -> int:
    return sum(c.isdigit() for c in s)


# Letters that scanning confuses, as read -> as written.
MISREAD = (("rn", "m"), ("rri", "m"), ("lc", "k"), ("cl", "d"), ("li", "h"), ("ri", "n"), ("ii", "u"), ("vv", "w"), ("1", "l"), ("1", "i"), ("0", "o"), ("5", "s"), ("6", "b"), ("8", "b"), ("3", "e"), ("4", "a"), ("@", "a"), ("+", "t"), ("c", "e"), ("e", "c"), ("q", "g"), ("9", "g"), ("f", "t"), ("l", "i"), ("i", "l"), ("u", "v"), ("F", "E"), ("|", "l"), ("7", "t"), ("$", "s"))


def deletes(word: str) -> list[str]:
    return [word] + [word[:i] + word[i + 1 :] for i in range(len(word))]


_LAST = re.compile(r"\S+(?=\s*$)")


def _context(text: str, at: int) -> str:
    """The last word before a place, with the marks at it, lower case."""
    m = _LAST.search(text[max(0, at - 24) : at])
    return m.group().lower() if m else ""


class Names:
    """Name tokens with a symmetric-delete index for misspelt ones, and names of places. A token marked `WEAK` is a plain
    word too: it makes a name only beside another token or after words that announce a name."""

    def __init__(self, tokens, places, contexts=()) -> None:
        self.contexts = frozenset(contexts)
        self.weak = frozenset(t[: -len(WEAK)] for t in tokens if t.endswith(WEAK))
        self.tokens = frozenset(t for t in tokens if not t.endswith(WEAK)) | self.weak
        self.places = frozenset(places)
        self.index: set[str] | None = None
        self.memo: dict[str, bool] = {}

    def announced(self, text: str, at: int) -> bool:
        """Whether the words before a place announce a name."""
        return _context(text, at) in self.contexts or NAME_LABELS.search(text, max(0, at - 18), at) is not None

    def misspelt(self, word: str) -> bool:
        """Whether a word is within one edit, or one misreading, of a name token."""
        w = word.upper()
        if w in self.memo:
            return self.memo[w]
        if self.index is None:
            self.index = {d for t in self.tokens if len(t) >= 5 for d in deletes(t)}
        ok = len(w) >= 5 and any(d in self.index for d in deletes(w))
        if not ok and len(w) >= 4:
            low = word.lower()
            ok = any((low[:i] + b.lower() + low[i + len(a) :]).upper() in self.tokens for a, b in MISREAD for i in range(len(low)) if low.startswith(a.lower(), i))
        if len(self.memo) < 500_000:
            self.memo[w] = ok
        return ok

    def place(self, word: str) -> bool:
        w = word.upper()
        if w in self.places:
            return True
        low = word.lower()
        return len(w) >= 5 and any((low[:i] + b.lower() + low[i + len(a) :]).upper() in self.places for a, b in MISREAD for i in range(len(low)) if low.startswith(a.lower(), i))


def _numbers(text: str, before: str) -> list[Span]:
    out: list[Span] = []

    def near(i: int, n: int = 28) -> str:
        return text[i - n : i] if i >= n else (before[-n:] + " " + text[:i])[-n:]

    # the patterns run on the stretches that could hold a number, not on the whole text
    for r in _RUN.finditer(text):
        if _real(r.group()) >= 7:
            _numbers_in(text, max(0, r.start() - 1), min(len(text), r.end() + 6), near, out)
    for m in _IBAN.finditer(text):
        if mod97(m.group()):
            out.append(Span(m.start(), m.end(), "bank_account", 0.9))
    return out


def _numbers_in(text: str, a: int, b: int, near, out: list[Span]) -> None:
    for m in _NIK.finditer(text, a, b):
        raw = m.group()
        d = _digits(raw)
        ctx = near(m.start())
        s = 0.75 * nik_valid(d) + 0.5 * bool(NIK_WORDS.search(ctx)) - 0.6 * bool(CODE_WORDS.search(ctx)) + 0.1 * (text[m.end() : m.end() + 1] == "/" or text[m.start() - 1 : m.start()] == "/")
        if _real(raw) >= 11:
            out.append(Span(m.start(), m.end(), "id_number", s + 0.05))
    for m in _TAX.finditer(text, a, b):
        raw, ctx = m.group(), near(m.start())
        s = 0.7 * ("." in raw) + 0.6 * bool(TAX_WORDS.search(ctx)) + 0.2 * (raw[0] == "9") - 0.6 * bool(CODE_WORDS.search(ctx))
        if _real(raw) >= 11:
            out.append(Span(m.start(), m.end(), "id_number", s))
    for m in _SIM.finditer(text, a, b):
        raw, ctx = m.group(), near(m.start())
        s = 0.7 * bool(SIM_WORDS.search(ctx)) - 0.5 * bool(CODE_WORDS.search(ctx))
        if _real(raw) >= 8:
            out.append(Span(m.start(), m.end(), "id_number", s))
    for m in _CUT.finditer(text, a, b):
        ctx = near(m.start(), 22)
        if _real(m.group()) >= 9 and (NIK_WORDS.search(ctx) or TAX_WORDS.search(ctx) or re.search(r"(?i)no\.?\s*sim|licen[cs]e no", ctx)) and not CODE_WORDS.search(ctx):
            out.append(Span(m.start(), m.end(), "id_number", 0.55))
    for i, rx in enumerate([*_PHONES, _SLASHED]):
        for m in rx.finditer(text, a, b):
            raw = m.group().rstrip(" .-(")
            d = _digits(raw)
            ctx = near(m.start(), 24)
            mobile = (d.startswith("628") and 10 <= len(d) <= 14) or (d.startswith("6208") and 12 <= len(d) <= 15) or (d.startswith("08") and 9 <= len(d) <= 13)
            fixed = re.match(r"0[2-7]", d) is not None and 8 <= len(d) <= 12 and i in (2, 3, 4)
            if _real(raw) < len(d) - 3 or not (mobile or fixed):
                continue
            s = 0.6 + 0.2 * bool(PHONE_WORDS.search(ctx)) - 0.5 * bool(CODE_WORDS.search(ctx)) - 0.3 * bool(NIK_WORDS.search(ctx[-8:]))
            out.append(Span(m.start(), m.start() + len(raw), "phone", s + 0.01 * len(raw)))
    for m in _CARD.finditer(text, a, b):
        d = _digits(m.group())
        if 13 <= len(d) <= 19 and luhn(d) and not nik_valid(d) and re.search(r"(?i)kartu kredit|card|visa|master", near(m.start(), 40)):
            out.append(Span(m.start(), m.end(), "card", 0.8))


def _emails(text: str) -> list[Span]:
    """Addresses around each sign that joins their parts; the local part may be of any length."""
    out: list[Span] = []
    for m in _AT.finditer(text):
        a = m.start()
        if a and text[a - 1].isspace():
            a -= 1
        while a and (text[a - 1].isalnum() or text[a - 1] in "._+-"):
            a -= 1
        e = _EMAIL.search(text, a, min(len(text), m.end() + 256))
        if e and e.start() < m.start() < e.end() and (not out or out[-1].start != e.start()):
            out.append(Span(e.start(), e.end(), "email", 1.0))
    return out


def _addresses(text: str, names: Names) -> list[Span]:
    out = []
    for m in _STREET.finditer(text):
        at = m.end()
        while True:
            sep = re.compile(r"\s*,\s*|\s+-\s+|[ \t]+|\s?\n(?=[A-Z0-9])").match(text, at)
            if not sep:
                break
            hit = next((h for rx in _PARTS if (h := rx.match(text, sep.end()))), None)
            if hit is None:
                w = re.compile(r"[A-Z][A-Za-z@0-9+]{3,}").match(text, sep.end())
                if w and names.place(w.group()):
                    hit = w
            if hit is None or "\n" in sep.group() and re.match(r"\w+\s*[:/]", hit.group() + text[hit.end() : hit.end() + 2]):
                break
            at = hit.end()
        out.append(Span(m.start(), at, "address", 0.95))
    return out


def _names(text: str, names: Names, taken: list[tuple[int, int]]) -> list[Span]:
    words = [(m.start(), m.end(), m.group()) for m in _CAP.finditer(text)]
    free = lambda a, b: all(b <= x or a >= y for x, y in taken)
    known, memo = names.tokens, names.memo
    sure = [w.upper() in known and len(w) > 2 and w[0].isupper() for _, _, w in words]
    out, i = [], 0
    n = len(words)

    def gap(p: int, q: int, initial: bool) -> bool:
        g = text[words[p][1] : words[q][0]]
        return g.strip(" \n\r\t") == "" and 1 <= len(g) <= 3 or (initial and g.strip() == "." and len(g) <= 3)

    def initial(k: int) -> bool:
        return len(words[k][2]) == 1 and words[k][2].isupper()

    def fits(k: int) -> bool:
        w = words[k][2]
        return sure[k] or initial(k) or (len(w) >= 4 and w.upper() not in FIRM_BEFORE | TITLE_BEFORE and not names.place(w) and names.misspelt(w))

    used = -1
    while i < n:
        if not sure[i]:
            w = words[i][2]
            if len(w) < 4 or memo.get(w.upper()) is False or not names.misspelt(w) or names.place(w) or not names.announced(text, words[i][0]):
                i += 1
                continue
        a, b, w = words[i]
        if i <= used or not free(a, b):
            i += 1
            continue
        lo = i
        while lo - 1 > used and gap(lo - 1, lo, initial(lo - 1)) and fits(lo - 1) and free(words[lo - 1][0], words[lo - 1][1]):
            if initial(lo - 1) and words[lo - 1][2] in "H":
                break
            lo -= 1
        hi = i
        while hi + 1 < n and gap(hi, hi + 1, initial(hi)) and fits(hi + 1) and free(words[hi + 1][0], words[hi + 1][1]):
            if initial(hi + 1) and not (text[words[hi + 1][1] : words[hi + 1][1] + 1] in (".", "", ",", ";", "/") or (hi + 2 < n and gap(hi + 1, hi + 2, True) and fits(hi + 2))):
                break
            hi += 1
        # a degree after the name: S. H.
        start, end = words[lo][0], words[hi][1]
        if hi > lo and initial(hi) and text[end : end + 1] == ".":
            if re.match(r"\.\s?[A-Z]", text[end:]) and not re.match(r"\.\s[A-Z][a-z]", text[end:]):
                end = words[hi - 1][1]
            else:
                end += 1
        prior = [x.group().upper().strip(".") for x in _WORD.finditer(text[max(0, start - 24) : start])]
        firm = bool(prior) and prior[-1] in FIRM_BEFORE and text[max(0, start - 3) : start].strip(" .") .isalpha()
        own = any(words[k][2].upper() not in COMMON and len(words[k][2]) > 1 for k in range(lo, hi + 1))
        strong = sum(sure[k] for k in range(lo, hi + 1))
        ctx = names.announced(text, start) or (bool(prior) and prior[-1] in TITLE_BEFORE)
        plain = strong > 0 and all(words[k][2].upper() in names.weak for k in range(lo, hi + 1) if sure[k])
        score = 0.5 * own + 0.1 * strong + 0.3 * ctx - 0.9 * firm - 0.5 * (plain and not ctx)
        if score >= THRESHOLD:
            out.append(Span(start, end, "person_name", min(0.9, score)))
        used = hi
        i = hi + 1
    return out


def find(text: str | None, names: Names, before: str | None = None) -> list[Span]:
    """Spans of personal information, in order and without overlap. before: text that stands before this one."""
    if not text:
        return []
    before = before or ""
    spans = _emails(text)
    spans += _numbers(text, before) if re.search(r"[0-9]{3}", text) else []
    spans += _addresses(text, names)
    spans = [s for s in spans if s.score >= THRESHOLD]
    spans += _names(text, names, [(s.start, s.end) for s in spans])
    kept: list[Span] = []
    for s in sorted(spans, key=lambda s: (-s.score, s.start - s.end)):
        if all(s.end <= k.start or s.start >= k.end for k in kept):
            kept.append(s)
    return sorted(kept)


def redacted(text: str | None, spans: list[Span]) -> str | None:
    """The text with each span replaced by [KIND]."""
    if text is None:
        return None
    out, at = [], 0
    for s in spans:
        out += [text[at : s.start], f"[{s.kind.upper()}]"]
        at = s.end
    return "".join(out) + text[at:]


_SPANS = "array<struct<kind:string,start_pos:int,end_pos:int,score:double>>"


def spans(text: Column, before: Column, tokens: list[str] | Column, places: list[str], contexts: list[str] = ()) -> Column:
    """Array of spans of a text column, positions of first and last character from 1. tokens: the name tokens, or a
    column with those that the row needs (`with_tokens`); contexts: the words that announce a name (`name_contexts`)."""

    def positions(t: str | None, p: str | None, names: Names) -> list[dict]:
        return [{"kind": x.kind, "start_pos": x.start + 1, "end_pos": x.end, "score": float(x.score)} for x in find(t, names, p)]

    @F.pandas_udf(_SPANS)
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        names = Names(tokens, places, contexts)
        for s, b in batches:
            yield pd.Series([positions(t, p, names) for t, p in zip(s, b)])

    @F.pandas_udf(_SPANS)
    def run_own(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        known, announce = frozenset(places), frozenset(contexts)
        for s, b, own in batches:
            yield pd.Series([positions(t, p, Names(() if w is None else w, known, announce)) for t, p, w in zip(s, b, own)])

    return run_own(text, before, tokens) if isinstance(tokens, Column) else run(text, before)


def placeholders(text: Column, before: Column, tokens: list[str] | Column, places: list[str], contexts: list[str] = ()) -> Column:
    """The text column with typed placeholders. before, tokens, contexts: as in `spans`."""

    def replaced(t: str | None, p: str | None, names: Names) -> str | None:
        return redacted(t, find(t, names, p)) if t is not None else None

    @F.pandas_udf("string")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        names = Names(tokens, places, contexts)
        for s, b in batches:
            yield pd.Series([replaced(t, p, names) for t, p in zip(s, b)], dtype=object)

    @F.pandas_udf("string")
    def run_own(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        known, announce = frozenset(places), frozenset(contexts)
        for s, b, own in batches:
            yield pd.Series([replaced(t, p, Names(() if w is None else w, known, announce)) for t, p, w in zip(s, b, own)], dtype=object)

    return run_own(text, before, tokens) if isinstance(tokens, Column) else run(text, before)


def name_tokens(names: DataFrame, column: str, *, texts: DataFrame | None = None, limit: int = 300_000) -> list[str] | DataFrame:
    """Every token of three letters or more of the names of a register, however rare, misread letters led back: a list
    where it fits a closure, above `limit` a table (token, weak), from which `with_tokens` gives each text the tokens that
    bear on it. Both find the same spans. texts: the texts (column text) to search; a token that they have far more often,
    against its rows in the register, than names as a whole, or more often in lower case than as a name, is marked `WEAK`."""
    folded = F.translate(F.upper(column), MISREAD_FROM, MISREAD_TO)
    tok = names.select(F.explode(F.split(folded, NAME_BREAK)).alias("token")).where("token rlike '^[A-Z]{3,}$'").groupBy("token").agg(F.count("*").alias("r"))
    weak = F.lit(False)
    if texts is not None:
        tok = stored(tok)
        word = texts.select(F.explode(F.split("text", r"[^A-Za-z]+")).alias("w")).where("length(w) >= 3")
        said = word.groupBy("w").agg(F.count("*").alias("n")).groupBy(F.upper("w").alias("token")).agg(F.sum(F.when(F.col("w").rlike("^[A-Z]"), F.col("n")).otherwise(0)).alias("t"), F.sum("n").alias("every"))
        tok = stored(tok.join(said, "token", "left").select("token", "r", F.coalesce("t", F.lit(0)).alias("t"), F.coalesce("every", F.lit(0)).alias("every")))
        # the rate of names is that of the median row of the register, which single words cannot move
        rate = tok.agg(F.expr("percentile(t / r, 0.5, r)")).first()[0] or 0.0
        often = lambda k: (F.col("t") > WORD_LEAST) & (F.col("t") > k * max(1.0, rate) * F.col("r"))
        tok = tok.where(~often(PLAIN_RATE))
        weak = often(WORD_RATE) | (F.col("every") > F.col("t") * 2)
    tok = tok.select("token", weak.alias("weak"))
    got = [r["token"] + WEAK * r["weak"] for r in tok.limit(limit + 1).collect()]
    return got if len(got) <= limit else tok


def with_tokens(texts: DataFrame, tokens: list[str] | DataFrame) -> tuple[DataFrame, list[str] | Column]:
    """`texts` (column text) and the tokens to give to `spans` and `placeholders`. A table of tokens is joined with the
    capitalised words of the texts: each text gets its words that are tokens and, for each misspelt or misread word, a
    token that shows it. Deletes of words meet deletes of tokens one to one, so no key is held by many rows."""
    if isinstance(tokens, list):
        return texts, tokens

    @F.pandas_udf("array<string>")
    def words(s: pd.Series) -> pd.Series:
        return pd.Series([sorted({m.group() for m in _CAP.finditer(t)}) if t else [] for t in s], dtype=object)

    @F.pandas_udf("array<string>")
    def cut(s: pd.Series) -> pd.Series:
        return pd.Series([sorted(set(deletes(w.upper()))) if len(w) >= 5 else [] for w in s], dtype=object)

    @F.pandas_udf("array<string>")
    def read(s: pd.Series) -> pd.Series:
        def forms(low: str) -> list[str]:
            return sorted({(low[:i] + b.lower() + low[i + len(a) :]).upper() for a, b in MISREAD for i in range(len(low)) if low.startswith(a.lower(), i)})

        return pd.Series([[w.upper(), *(forms(w.lower()) if len(w) >= 4 else [])] for w in s], dtype=object)

    once = texts.where("text is not null").select("text").distinct().select("text", F.explode(words("text")).alias("word"))
    seen = once.select("word").distinct()
    as_is = seen.select("word", F.explode(read("word")).alias("token")).join(tokens.select("token"), "token")
    index = tokens.select("token", F.explode(cut("token")).alias("d")).groupBy("d").agg(F.min("token").alias("token"))
    near = seen.select("word", F.explode(cut("word")).alias("d")).join(index, "d").groupBy("word").agg(F.min("token").alias("token"))
    shown = as_is.select("word", "token").unionAll(near.select("word", "token")).join(tokens, "token")
    own = once.join(shown, "word").groupBy("text").agg(F.collect_set(F.concat("token", F.when(F.col("weak"), WEAK).otherwise(""))).alias("own_tokens"))
    return texts.join(own, "text", "left"), F.col("own_tokens")


#: a word before a capitalised one, and the capitalised word right after that
_BEFORE = re.compile(r"(\S+)\s+(?=([A-Z][A-Za-z0-9@+|']*)(?: ([A-Z][A-Za-z0-9@+|']*))?)")


def _followed(text: str | None, sure: frozenset, named: Counter, every: Counter) -> None:
    """Counts the words before capitalised ones, and before certain names."""
    for c, w, x in _BEFORE.findall(text or ""):
        if c.upper() not in sure:
            every[c] += 1
            if x and w.upper() in sure and x.upper() in sure:
                named[c] += 1


def name_contexts(texts: DataFrame, tokens: list[str] | Column, *, least: int = 20, share: float = 1e-4, part: float = 0.5) -> list[str]:
    """The words that announce a name, learnt from all texts (column text, and the column of tokens if it is one): of the
    capitalised words after such a word at least `part` begin a certain name (two tokens of the register on end, no plain
    words), at least `least` times and as a `share` of all certain names, so they are 1 / share at most. Counted in each
    task first."""
    own = isinstance(tokens, Column)
    listed = () if own else tuple(tokens)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sure, named, every = known, Counter(), Counter()

        def rows() -> pd.DataFrame:
            total, hits = Counter(), Counter()
            for out, raw in ((total, every), (hits, named)):
                for c, n in raw.items():
                    out[c.lower()] += n
            every.clear(), named.clear()
            return pd.DataFrame([(c, hits[c], n) for c, n in total.items()], columns=["word", "named", "n"])

        for b in batches:
            if own:
                for t, w in zip(b["text"], b["own"]):
                    sure = frozenset(() if w is None else (x for x in w if not x.endswith(WEAK)))
                    _followed(t, sure, named, every)
            else:
                for t in b["text"]:
                    _followed(t, sure, named, every)
            if len(every) > 500_000:
                yield rows()
        yield rows()

    known = frozenset() if own else frozenset(t for t in listed if not t.endswith(WEAK))
    x = texts.select("text", *([tokens.alias("own")] if own else []))
    got = stored(x.mapInPandas(run, "word string, named long, n long").groupBy("word").agg(F.sum("named").alias("named"), F.sum("n").alias("n")))
    total = got.agg(F.sum("named")).first()[0] or 0
    return [r[0] for r in got.where((F.col("named") >= max(least, total * share)) & (F.col("named") >= F.col("n") * part)).select("word").collect()]


def previous_line(lines: DataFrame, group: list[str], order: list[str], text: str) -> DataFrame:
    """`lines` with `before`: the text of the line before on the same page, '' for the first."""
    return lines.withColumn("before", F.coalesce(F.lag(text).over(Window.partitionBy(*group).orderBy(*order)), F.lit("")))
