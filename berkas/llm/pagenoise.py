"""Noise of scanned pages: running headers, page numbers, words broken over lines, misread characters.

Lines are labelled page by page with a hidden Markov model (header, title, body, break, footer) over layout features:
place on the page, gap to the neighbours, page-number shape and whether the numbers run on from page to page, repetition
on other pages of the document and at page edges of the corpus. Its tables are counted over all pages from lines whose
kind is beyond doubt, with a prior on how the parts of a page follow each other. Broken words are joined with the next
text line, also over a page end; misread words are led back to the frequent word of the same skeleton (letters that
scanning confuses count as one), with counts over all texts.

Lines pass through Python twice, page by page in Arrow batches: once for what a line shows by itself, once for its label
and its words; cutting words and telling letter cases there costs a fifth of the regular expressions of the JVM. All that
is counted, joined and compared over the corpus is DataFrame work on the few columns it needs.

Edge cases: null and empty lines carry nothing and are skipped when the next text line is sought; a page of one line, a
document of one page and an empty table are labelled like others; repeated rows count once; a break that no text follows
is left alone; a word with no frequent word of the same skeleton is left as it is. Pages are labelled one by one, so no
document has to fit into one task.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from berkas.llm.graph import components
from berkas.session import stored

HYPHENS = "-­¬‐"
# Letters that scanning confuses. Each is written as the strokes it may be read as (m as rn, n as ri, h as
# li, u as ii, k as lc, d as cl, w as vv), so that letters and their misreadings have one skeleton.
STROKES = {
    "m": "rri", "n": "ri", "h": "ii", "u": "ii", "k": "ie", "d": "ei", "w": "vv", "c": "e", "l": "i", "1": "i", "|": "i", "!": "i", "@": "a", "4": "a",
    "0": "o", "5": "s", "$": "s", "6": "b", "8": "b", "3": "e", "9": "g", "q": "g", "+": "t", "7": "t", "f": "t", "2": "z",
}
_STROKES = str.maketrans(STROKES)
DIGIT_FORMS = str.maketrans("OoDQlIi|ZzSsBbGgq", "00001111225586699")
PLAIN = {"@": "a", "0": "o", "5": "s", "6": "b", "+": "t", "4": "a", "8": "b", "3": "e", "9": "g", "$": "s", "7": "t", "|": "l", "1": "l"}
STATES = ["header", "title", "body", "break", "footer"]
_NUMBER_SHAPES = [
    ("deco", re.compile(r"^(?:hal(?:aman)?|page|pg|hlm)\.?\s*([0-9OolI]{1,5})(?:\s*(?:dari|of|/)\s*[0-9OolI]{1,5})?$", re.I)),
    ("deco", re.compile(r"^([0-9OolI]{1,5})\s*/\s*[0-9OolI]{1,5}$")),
    ("deco", re.compile(r"^[-–—\[(<]\s*([0-9OolI]{1,5}|[ivxlc]{1,7})\s*[-–—\])>]$")),
    ("bare", re.compile(r"^([0-9lIoO]{1,4})$")),
    ("roman", re.compile(r"^([ivxlc]{1,7})$")),
]


def skeleton(word: str) -> str:
    """The strokes of a word, the same for every misreading of its letters; lower case."""
    return word.lower().translate(_STROKES)


def skeleton_column(c: Column) -> Column:
    """`skeleton` inside code generation: one pass for the letters that become one letter, then those that become two."""
    one = {a: b for a, b in STROKES.items() if len(b) == 1}
    c = F.translate(F.lower(c), "".join(one), "".join(one.values()))
    for a, b in STROKES.items():
        if len(b) > 1:
            c = F.replace(c, F.lit(a), F.lit(b))
    return c


def _roman(s: str) -> int:
    v = {"i": 1, "v": 5, "x": 10, "l": 50, "c": 100}
    n = [v[c] for c in s]
    return sum(-x if i + 1 < len(n) and x < n[i + 1] else x for i, x in enumerate(n))


def page_number(text: str) -> tuple[str, int]:
    """(shape, number) of a line that may be a page number, ('', -1) otherwise."""
    t = text.strip()
    for shape, rx in _NUMBER_SHAPES:
        if m := rx.match(t):
            g = m.group(1)
            if re.fullmatch(r"[ivxlc]+", g) and not g.isdigit() and "l" not in g[:1]:
                return (shape if shape != "roman" else "roman"), _roman(g)
            g = g.translate(DIGIT_FORMS)
            if g.isdigit():
                return shape, int(g)
    return "", -1


def split_number(text: str) -> tuple[str, str, int]:
    """(text without its page number, shape, number) of a header that has one beside it."""
    shape, n = page_number(text)
    if shape:
        return "", shape, n
    parts = re.split(r"\s{2,}", text.strip())
    if len(parts) > 1:
        for part, rest in ((parts[-1], parts[:-1]), (parts[0], parts[1:])):
            shape, n = page_number(part)
            if shape:
                return " ".join(rest), shape, n
    return text.strip(), "", -1


#: a line of running text: a mark inside or at its end
LONG = re.compile(r"[.:;,] [A-Za-z0-9]|[.:;,]$")
NO_LETTERS = re.compile(r"[\s0-9.,;:()/\"!?#%&*<=>\[\]\\^_`{}~@+|$'\u00A0-\u00BF\u2010-\u2026-]+")
_SMALL = re.compile("[a-z]")
_LINE = "ocr_id long, doc long, page int, idx int, text string, place byte, gap byte, case byte, ending byte, size byte, after byte, rim boolean, rest string, shape string, number int, norm string"


def _norm(text: str) -> str:
    return NO_LETTERS.sub("", skeleton(text))


def _whole_pages(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Batches of rows sorted by doc and page, cut where pages end."""
    rest = None
    for b in batches:
        b = b if rest is None else pd.concat([rest, b], ignore_index=True)
        if b.empty:
            continue
        same = ((b["doc"] == b["doc"].iloc[-1]) & (b["page"] == b["page"].iloc[-1])).to_numpy()
        cut = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0
        rest, done = b.iloc[cut:], b.iloc[:cut]
        if len(done):
            yield done
    if rest is not None and len(rest):
        yield rest


def _pages(b: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Number of the page of each row, from 0; first row and length of each page."""
    doc, page = b["doc"].to_numpy(), b["page"].to_numpy()
    new = np.r_[True, (doc[1:] != doc[:-1]) | (page[1:] != page[:-1])]
    start = np.flatnonzero(new)
    return np.cumsum(new) - 1, start, np.diff(np.r_[start, len(b)])


def _case(text: str, size: str) -> str:
    up, low = text.upper(), text.lower()
    if up == low:
        return "none"
    if text == up:
        return "upper"
    # headings with a misread letter or two are capitals still
    if size == "short" and len(small := _SMALL.findall(text)) * 5 <= len(text) and len(small) * 5 <= len(NO_LETTERS.sub("", low)):
        return "upper"
    return "lower" if "a" <= text[0] <= "z" else "mixed"


def edges(lines: DataFrame) -> DataFrame:
    """`lines` (ocr_id, doc, page, idx, text, min_y; no nulls in text), each once, with what they show by themselves: rank
    from top and bottom, gaps against the usual pitch, letter case, ending, length; for the three lines at each edge of a
    page the rest beside a page number, its shape and number. Features are places in their `VALUES`. norm: letters by
    skeleton, of edge lines and of the short lines between them. after: the seed (`_seed`) of the line before, where both lie
    between the edges, else -1; rim tells the lines at the edges and those beside them. Lines are moved once, by page; copies of a line fall together and are dropped."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in _whole_pages(batches):
            b = b[b["ocr_id"].ne(b["ocr_id"].shift())] if len(b) > 1 else b
            at, start, n = _pages(b)
            top = np.arange(len(b)) - start[at] + 1
            bottom = n[at] - top + 1
            y = b["min_y"].to_numpy(dtype=float)
            pitch = ((np.fmax.reduceat(y, start) - np.fmin.reduceat(y, start)) / np.maximum(n - 1, 1))[at]
            with np.errstate(invalid="ignore"):
                above, below = np.r_[np.nan, np.diff(y)], np.r_[np.diff(y), np.nan]
                above[start], below[start + n - 1] = np.nan, np.nan
                wide = (above > pitch * 1.6) | (below > pitch * 1.6)
            texts = b["text"].to_list()
            size = ["short" if len(t) <= 60 and not LONG.search(t) else "long" for t in texts]
            edge = (top <= 3) | (bottom <= 3)
            rest, shape, number, norm = ([None] * len(b) for _ in range(4))
            for i in np.flatnonzero(edge):
                rest[i], shape[i], number[i] = split_number(texts[i])
                norm[i] = _norm(rest[i])
            for i in np.flatnonzero(~edge):
                if size[i] == "short" or (texts[i].endswith(":") and len(texts[i]) <= 60 and not LONG.search(texts[i][:-1])):
                    norm[i] = _norm(texts[i])
            place = np.where(top <= 3, top - 1, np.where(bottom <= 3, 7 - bottom, MID))
            ending = np.array([0 if t[-1] in ".!?" else 1 if t[-1] in HYPHENS else 2 for t in texts], np.int8)
            brief = np.array([len(t) <= BREAK for t in texts])
            seed = np.where((ending == 0) & brief, STATES.index("break"), STATES.index("body"))
            after = np.where(~edge & (top > 4), np.r_[-1, seed[:-1]], -1)
            out = b[["ocr_id", "doc", "page", "idx", "text"]]
            yield out.assign(
                place=place.astype(np.int8), gap=np.where(wide, 0, 1).astype(np.int8), case=np.array([_CASES[_case(t, z)] for t, z in zip(texts, size)], np.int8), ending=ending,
                size=np.array([z == "long" for z in size], np.int8), after=after.astype(np.int8), rim=(top <= 4) | (bottom <= 4), rest=rest, shape=shape, number=pd.array(number, dtype="Int32"), norm=norm,
            )

    page = lines.select("ocr_id", "doc", "page", "idx", "text", "min_y").repartition("doc", "page").sortWithinPartitions("doc", "page", "idx", "ocr_id")
    return page.mapInPandas(run, _LINE)


def featured(lines: DataFrame) -> DataFrame:
    """Every line with its features (`FEATURES`) as one number, code, and its seed, the state of lines beyond doubt. Repetition and page numbers
    that run on are counted over the edge lines of all pages; the other lines are not moved."""
    x = stored(edges(lines))
    edge = x.where("shape is not null").select("ocr_id", "doc", "page", "rest", "shape", "number", "norm")
    # page numbers that run on: the same difference to the page on two pages, or the page itself
    run = edge.where("shape <> ''").groupBy("doc", "shape", (F.col("number") - F.col("page")).alias("shift")).agg(F.count_distinct("page").alias("run"))
    # repetition at edges of other pages of the document, and of the corpus; a norm too short to tell is not looked up, so
    # the bare page numbers, which share the empty norm, are no hot key
    lettered = edge.where("length(norm) >= 3")
    rep = lettered.groupBy("doc", "norm").agg(F.count_distinct("page").alias("pages"))
    corpus = rep.groupBy("norm").agg(F.count("*").alias("docs"), F.max("pages").alias("most"), F.sum("pages").alias("edge_pages"))
    inside = x.where("shape is null and norm is not null").groupBy("norm").agg(F.count("*").alias("inside"))
    corpus = corpus.join(inside, "norm", "left").select("norm", "docs", "most", (F.coalesce("inside", F.lit(0)) * 10 > F.col("edge_pages")).alias("inside"))
    known = stored(rep.join(corpus, "norm").select("doc", "norm", ((F.col("pages") >= 2) & ~F.col("inside")).alias("many"), ((F.col("docs") >= 3) & (F.col("most") >= 2) & ~F.col("inside")).alias("common")))
    pages = edge.groupBy("doc").agg(F.min("page").alias("page_1"), F.count_distinct("page").alias("page_n"))
    e = x.where("shape is not null").withColumn("shift", F.col("number") - F.col("page")).join(run, ["doc", "shape", "shift"], "left").join(pages, "doc").join(known, ["doc", "norm"], "left")
    bare = F.col("shape").isin("bare", "roman") & (F.col("rest") == "")
    on = F.coalesce((F.col("run") >= 2) | ((F.col("page_n") == 1) & (F.col("shift") == 0)), F.lit(False))
    none, runs, lone, deco_runs, deco, beside = map(F.lit, range(len(NUMBERS)))
    number = F.when(F.col("shape") == "", none).when(bare & on, runs).when(bare, lone).when(F.col("rest") == "", F.when(on, deco_runs).otherwise(deco)).otherwise(F.when(on | (F.col("shape") == "deco"), beside).otherwise(none))
    many, common, no = map(F.lit, range(len(REPEATS)))
    repeat = F.when(F.col("many"), many).when(F.col("common"), common).otherwise(no)
    keep = ["ocr_id", "doc", "page", "idx", "text", "place", "gap", "case", "ending", "size", "after", "rim"]
    y = e.select(*keep, number.alias("number"), repeat.alias("repeat"), (F.col("page") != F.col("page_1")).cast("int").alias("first"))
    y = y.unionAll(x.where("shape is null").select(*keep, none.alias("number"), no.alias("repeat"), (F.col("page") != 1).cast("int").alias("first")))
    y = y.withColumn("mark", (F.col("number") * len(REPEATS) + F.col("repeat")) * 2 + F.col("size"))
    code = F.lit(0)
    for f in FEATURES:
        code = code * len(VALUES[f]) + F.col(f)
    return y.select("ocr_id", "doc", "page", "idx", "text", code.alias("code"), _seed().cast("byte").alias("seed"), "after", "rim")


_LABEL = "ocr_id long, doc long, page int, idx int, text string, state string, next_text string, first boolean, broken boolean, cut string, figs string"


def labelled_lines(lines: DataFrame) -> DataFrame:
    """(ocr_id, doc, page, idx, text, state, next_text, first, broken, cut, figs) of every line with text: broken tells
    whether it ends in a hyphen, next_text is then the next line of the page that is no furniture, first tells the first such
    line of a page; cut holds its words and figs its figures with letters in them, as of `words_of` and `figures`."""
    y = stored(featured(lines))
    model = fitted(y)

    def label(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in _whole_pages(batches):
            yield _label_pages(b, model)

    rows = y.select("ocr_id", "doc", "page", "idx", "text", "code")
    return rows.repartition("doc", "page").sortWithinPartitions("doc", "page", "idx", "ocr_id").mapInPandas(label, _LABEL)


#: mark: page number, repetition and length of the line as one feature, since they depend on each other
FEATURES = ["mark", "place", "gap", "case", "ending", "first"]


def _seed() -> Column:
    """The state of lines whose kind is beyond doubt, as its place in `STATES`, null for the others."""
    at = lambda f, *vs: F.col(f).isin([NAMED[f].index(v) for v in vs])
    state = lambda s: F.lit(STATES.index(s))
    top, low = at("place", "t1", "t2"), at("place", "b1", "b2")
    number = at("number", "deco_runs", "runs", "beside")
    brief = at("size", "short") & ~at("case", "lower")
    return (
        F.when((top & at("first", "first") & at("case", "upper") & at("number", "none")), state("title"))
        .when(top & (number | (at("repeat", "many") & brief)), state("header"))
        .when(low & (number | (at("repeat", "many") & brief)), state("footer"))
        .when(at("place", "mid") & at("ending", "stop") & (F.length("text") <= BREAK), state("break"))
        .when(at("place", "mid") | (at("number", "none") & at("size", "long")), state("body"))
        .when(at("number", "none") & at("repeat", "no") & ~at("case", "upper"), state("body"))
        .when(at("number", "lone") & at("repeat", "no"), state("body"))
    )


def fitted(y: DataFrame) -> dict:
    """Log-probabilities of the features in each state and of the states after each other, counted over all lines. What
    reaches the driver has a row per combination of feature values that occurs (some hundreds, 72,576 at most) and per pair
    of states. The prior on the order of states (`MOVES`) weighs as much as `PRIOR` lines; what it rules out stays so."""
    counts: dict[str, Counter] = {s: Counter() for s in STATES}
    total: Counter = Counter()
    for r in y.where("seed is not null").groupBy("seed", "code").agg(F.count("*").alias("n")).collect():
        state = STATES[r["seed"]]
        total[state] += r["n"]
        for f, v in zip(FEATURES, np.unravel_index(r["code"], [len(VALUES[f]) for f in FEATURES])):
            counts[state][f, VALUES[f][v]] += r["n"]
    emit = {s: {f: {v: math.log((counts[s][f, v] + 0.5) / (total[s] + 0.5 * len(vs))) for v in vs} for f, vs in VALUES.items()} for s in STATES}
    # steps between lines inside a page stand in the line; only the lines at its rim are sorted
    order = Window.partitionBy("doc", "page").orderBy("idx", "ocr_id")
    rim = y.where("rim").select("doc", "page", "idx", "ocr_id", "after", F.coalesce("seed", F.lit(-2).cast("byte")).alias("seed"))
    rim = rim.select(F.lag("seed", 1, -1).over(order).alias("a"), F.col("seed").alias("b"), "after").where("after < 0 and a <> -2 and b <> -2").select("a", "b")
    steps = rim.unionAll(y.where("after >= 0").select(F.col("after").alias("a"), F.col("seed").alias("b"))).groupBy("a", "b").agg(F.count("*").alias("n"))
    seen = {("start" if r["a"] < 0 else STATES[r["a"]], STATES[r["b"]]): r["n"] for r in steps.collect()}
    move = {}
    for a, row in MOVES.items():
        prior = {b: math.exp(w) for b, w in row.items() if w > _NO}
        scale = PRIOR / sum(prior.values())
        c = {b: seen.get((a, b), 0) + w * scale for b, w in prior.items()}
        move[a] = {b: math.log(c[b] / sum(c.values())) if b in c else _NO for b in row}
    return {"emit": emit, "move": move}


NUMBERS = ["none", "runs", "lone", "deco_runs", "deco", "beside"]
REPEATS = ["many", "corpus", "no"]
VALUES = {
    "mark": [f"{n}/{r}/{z}" for n in NUMBERS for r in REPEATS for z in ("short", "long")],
    "place": ["t1", "t2", "t3", "mid", "b3", "b2", "b1"],
    "gap": ["wide", "usual"],
    "case": ["upper", "mixed", "lower", "none"],
    "ending": ["stop", "hyphen", "open"],
    "first": ["first", "later"],
}
NAMED = VALUES | {"number": NUMBERS, "repeat": REPEATS, "size": ["short", "long"]}
MID = VALUES["place"].index("mid")
_CASES = {v: i for i, v in enumerate(VALUES["case"])}
BREAK = 36  #: a line that ends a sentence and has no more letters ends a paragraph
_NO = -1e9
PRIOR = 200.0
#: Prior on the structure of a page: headers, a title, text with paragraph ends, footers.
MOVES = {
    "start": {"header": -0.9, "title": -2.5, "body": -1.0, "break": -3.0, "footer": _NO},
    "header": {"header": -1.5, "title": -3.0, "body": -0.5, "break": -2.5, "footer": -6.0},
    "title": {"header": -2.5, "title": -3.0, "body": -0.3, "break": -2.0, "footer": -6.0},
    "body": {"header": _NO, "title": -6.0, "body": -0.2, "break": -2.0, "footer": -3.0},
    "break": {"header": _NO, "title": -4.0, "body": -0.3, "break": -2.5, "footer": -2.5},
    "footer": {"header": _NO, "title": _NO, "body": _NO, "break": _NO, "footer": -0.7},
}


def viterbi(scores: np.ndarray, page: np.ndarray, move: dict) -> np.ndarray:
    """The most probable state of every line: scores (lines, states) of lines sorted by page, page numbers from 0. All
    pages advance together, line by line."""
    n_pages = int(page[-1]) + 1 if len(page) else 0
    start = np.searchsorted(page, np.arange(n_pages))
    length = np.diff(np.r_[start, len(page)])
    first = np.array([move["start"][s] for s in STATES])
    step = np.array([[move[p][s] for s in STATES] for p in STATES])
    best = first + scores[start]
    back = np.zeros((len(page), len(STATES)), np.int8)
    last = best.argmax(1) if n_pages else np.zeros(0, int)
    for t in range(1, int(length.max()) if n_pages else 0):
        on = np.flatnonzero(length > t)
        way = best[on][:, :, None] + step[None]
        at = start[on] + t
        back[at] = way.argmax(1)
        best[on] = way.max(1) + scores[at]
    last = best.argmax(1) if n_pages else last
    out = np.zeros(len(page), np.int8)
    for t in range((int(length.max()) if n_pages else 0) - 1, -1, -1):
        on = np.flatnonzero(length > t)
        at = start[on] + t
        out[at] = last[on]
        if t:
            last[on] = back[at, last[on]]
    return out


def _label_pages(done: pd.DataFrame, model: dict) -> pd.DataFrame:
    score = np.zeros((len(done), len(STATES)))
    for f, v in zip(FEATURES, np.unravel_index(done["code"].to_numpy(), [len(VALUES[f]) for f in FEATURES])):
        table = np.array([[model["emit"][s][f][v] for s in STATES] for v in VALUES[f]])
        score += table[v]
    number, _, _ = _pages(done)
    states = np.array(STATES, dtype=object)[viterbi(score, number, model["move"])]
    body = np.flatnonzero((states != "header") & (states != "footer"))
    on = number[body]
    follows = np.r_[on[1:] == on[:-1], False] if len(body) else np.zeros(0, bool)
    text = done["text"].to_numpy(dtype=object)
    nxt, first = np.full(len(done), None, dtype=object), np.zeros(len(done), bool)
    broken = np.array([t.rstrip()[-1:] in _HYPHENS for t in text], bool)
    nxt[body[follows]] = text[body[1:][follows[:-1]]] if len(body) else []
    nxt[~broken] = None
    first[body] = np.r_[True, on[1:] != on[:-1]] if len(body) else []
    cut, figs = np.full(len(done), None, dtype=object), np.full(len(done), None, dtype=object)
    for i in body:
        cut[i], figs[i] = cut_line(text[i])
    return done[["ocr_id", "doc", "page", "idx", "text"]].assign(state=states, next_text=nxt, first=first, broken=broken, cut=cut, figs=figs)


# --- broken words ---------------------------------------------------------------------------------------------------

_FIRST = rf"([\p{{L}}0-9@+|$'’]+(?:[-'][\p{{L}}0-9@+|$]+)*)[{HYPHENS}]\s*$"
_SECOND = r"^\s*[\"'(]?([\p{Ll}0-9@+|$][\p{L}0-9@+|$]*(?:[-'][\p{L}0-9@+|$]+)*)"
_MARKS = r"^[.,;:!?)\"']+"
_HYPHENS = frozenset(HYPHENS)
_END = regex.compile(_FIRST)
_INSIDE = regex.compile(rf"[\p{{L}}0-9@+|$-]+[{HYPHENS}]\s+[\p{{Ll}}0-9@+|$]+")
_HALVES = regex.compile(rf"((?:[\p{{L}}0-9@+|$]+-)*[\p{{L}}0-9@+|$]+)[{HYPHENS}]\s+([\p{{Ll}}0-9@+|$]+)")
_SPACED = re.compile(f"[{HYPHENS}][ \n\r]")


def following(labels: DataFrame) -> DataFrame:
    """Text lines of labelled_lines with `next_text` over a page end too. Only the last lines of pages that end in a hyphen
    are joined with the first line of the next page, so a document may be of any size."""
    body = labels.where("state not in ('header', 'footer')")
    open_ = F.col("next_text").isNull() & F.col("broken")
    heads = body.where("first").select("doc", (F.col("page") - 1).alias("page"), F.col("text").alias("over_page"))
    over = body.where(open_).drop("next_text").join(heads, ["doc", "page"], "left").withColumnRenamed("over_page", "next_text")
    return body.where(~open_).unionByName(over)


_ADDRESS = re.compile(r"\S+(?:@|\[at\])\S*\.\S+|https?://\S+|www\.\S+")
_LINKED = re.compile(r"@|\[at\]|://|www\.")
#: what stands between words
_BETWEEN = ".,;:()/\"!?#%&*<=>[]\\^_`{}~\u00A0\u00AD\u00AC\u00B0\u00AB\u00BB" + "".join(map(chr, range(0x2010, 0x2027)))
_BLANKED = str.maketrans(_BETWEEN, " " * len(_BETWEEN))
#: a mark before a word that begins a sentence with a misread letter: the letter was a capital
OPENED = "\uE000"
_OPENS = re.compile(r"([.!?] )(?=[0-9@+|$][a-z]{2})")
_MIXED = re.compile(r"[0-9][.,/:-]?[OoDlIiZSBbgq]|[OoDlIiZSBbgq][.,/:-]?[0-9]")


def without_halves(text: str) -> str:
    """A text without the halves of broken words, at its end and inside."""
    if text.rstrip()[-1:] in _HYPHENS:
        text = _END.sub(" ", text)
    return _INSIDE.sub(" ", text) if _SPACED.search(text) else text


def words_of(text: str) -> list[str]:
    """The words of a text: two marks or more with a letter among them, addresses and links left out."""
    if _LINKED.search(text):
        text = _ADDRESS.sub(" ", text)
    words = text.translate(_BLANKED).split()
    return [w for w in (w.strip("-'") if w[0] in "-'" or w[-1] in "-'" else w for w in words) if len(w) > 1 and not w.isdigit()]


def cut_line(text: str) -> tuple[str, str | None]:
    """Words of a line or cell, and its figures with letters in them as they were, each list joined by blanks."""
    whole = without_halves(text)
    figs = " ".join(b for _, b in figures(whole)) if _MIXED.search(text) else ""
    return " ".join(words_of(_OPENS.sub(rf"\1{OPENED}", whole))), figs or None


_CELL = "cell_id long, doc long, text string, cut string, figs string, halves array<struct<a:string,b:string>>"


def cut_cells(cells: DataFrame) -> DataFrame:
    """`cells` (cell_id, doc, text; no nulls in text) with words, figures and the halves of words broken inside."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if b.empty:
                continue
            both = [cut_line(t) for t in b["text"]]
            halves = [[{"a": m.group(1), "b": m.group(2)} for m in _HALVES.finditer(t)] if _SPACED.search(t) else [] for t in b["text"]]
            yield b.assign(cut=[c for c, _ in both], figs=[f for _, f in both], halves=halves)

    return cells.select("cell_id", "doc", "text").mapInPandas(run, _CELL)


def lexicon(cut: list[DataFrame], texts: list[DataFrame] = ()) -> DataFrame:
    """(word, n) over all rows of tables with a column `cut` of words joined by blanks, and of tables with a column `text`;
    lower case. Every task counts its words first, so that a frequent word costs one row per task."""
    parts = [_counted(t.select("cut")) for t in cut] + [_counted(t.select("text")) for t in texts]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return out.groupBy("word").agg(F.sum("n").alias("n"))


_ASCII_BLANKED = bytes(32 if i < 128 and chr(i) in _BETWEEN else i for i in range(256))
_WIDE_BLANKS = re.compile(rb"\xe2\x80[\x90-\xa6]|\xc2[\xa0\xad\xac\xb0\xab\xbb]")


def _counted(texts: DataFrame) -> DataFrame:
    """Partial counts (word, n) of the words of the one column of `texts`, on the bytes of whole batches."""

    def rows(counts: Counter) -> pa.RecordBatch:
        out: Counter = Counter()
        for raw, n in counts.items():
            w = raw.decode("utf-8", "ignore").lstrip(OPENED).lower().strip("-'")
            if len(w) > 1:
                out[w] += n
        return pa.RecordBatch.from_arrays([pa.array(list(out), pa.string()), pa.array(list(out.values()), pa.int64())], names=["word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for b in batches:
            raw = "\n".join(t for t in b.column(0).to_pylist() if t).encode()
            counts.update(_WIDE_BLANKS.sub(b" ", raw).translate(_ASCII_BLANKED).split())
            if len(counts) > 500_000:
                yield rows(counts)
                counts = Counter()
        yield rows(counts)

    return texts.mapInArrow(run, "word string, n long")


def plain_word(raw: Column) -> Column:
    """Lower case, without the mark of a capital."""
    return F.lower(F.when(raw.startswith(OPENED), F.ltrim(raw, F.lit(OPENED))).otherwise(raw))


def word_rows(df: DataFrame, *keep: str) -> DataFrame:
    """A row (keep, raw) per word of the column `cut`."""
    return df.select(*keep, F.explode(F.split("cut", " ")).alias("raw"))


def ends_broken(text: Column) -> Column:
    """Whether the last mark of a line is a hyphen of whatever kind."""
    return F.substring(F.rtrim(text), -1, 1).isin(list(HYPHENS))


def corrections(lex: DataFrame, *, ratio: float = 0.12, frequent: int = 8) -> DataFrame:
    """(word, fixed) of misread words: the most frequent word of the same skeleton that readings of letters lead to; a
    word of letters alone must be `ratio` rarer than it. The join is on skeletons of distinct words, where only the
    frequent words of a skeleton, a handful, stand on one side."""
    s = lex.select("word", "n", skeleton_column(F.col("word")).alias("s"), F.regexp_count("word", F.lit(r"[0-9@+|$]")).alias("odd"))
    often = s.where((F.col("odd") == 0) & (F.col("n") >= frequent) & (F.length("word") >= 3)).select("s", F.col("word").alias("w"), F.col("n").alias("m"))
    rare = s.where(F.col("word").rlike("[a-z].*[a-z]") & (F.col("odd") * 2 <= F.length("word")))
    hit = rare.join(often, "s").where((F.col("word") != F.col("w")) & ((F.col("odd") > 0) | (F.col("n") <= F.col("m") * ratio)))
    hit = hit.where(readable(F.col("word"), F.col("w")))
    return hit.groupBy("word").agg(F.max_by("w", "m").alias("fixed"))


# As read, as written; what a scan makes of a letter. Those of ALONE lead to too many words to be combined.
READINGS = (("rn", "m"), ("ri", "n"), ("ii", "u"), ("cl", "d"), ("li", "h"), ("lc", "k"), ("vv", "w"), ("c", "e"), ("q", "g"), ("f", "t"))
ALONE = (("l", "i"), ("i", "l"), ("m", "rn"), ("v", "u"), ("f", "e"), ("h", "b"), ("e", "c"))
ODD = (("1", "i"), ("1", "l"), ("0", "o"), ("@", "a"), ("5", "s"), ("6", "b"), ("+", "t"), ("4", "a"), ("8", "b"), ("3", "e"), ("9", "g"), ("$", "s"), ("7", "t"), ("|", "l"), ("|", "i"))


def readable(word: Column, fixed: Column) -> Column:
    """Whether up to three readings of letters, or one of `ALONE`, lead from the fixed word to the word as read."""

    @F.pandas_udf("boolean")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for a, b in batches:
            yield pd.Series([_readable(x, y) for x, y in zip(a, b)], dtype=bool)

    return run(word, fixed)


def _readable(word: str, fixed: str, depth: int = 3) -> bool:
    if word == fixed:
        return True
    if depth == 3 and any(word[:i] + b + word[i + len(a) :] == fixed for a, b in ALONE for i in range(len(word)) if word.startswith(a, i)):
        return True
    if depth == 0:
        return False
    i = 0
    while i < min(len(word), len(fixed)) and word[i] == fixed[i]:
        i += 1
    for k in (i, i - 1):
        if k < 0 or (k < i and word[k] != fixed[k]):
            continue
        for a, b in (*ODD, *READINGS):
            if word.startswith(a, k) and fixed.startswith(b, k) and _readable(word[k + len(a) :], fixed[k + len(b) :], depth - 1):
                return True
    return False


def cased(word: str, fixed: str) -> str:
    """`fixed` in the letter case of `word`."""
    if word[:1] == OPENED:
        return fixed[:1].upper() + fixed[1:]
    up = sum(c.isupper() for c in word)
    low = sum(c.islower() for c in word)
    if up > 1 and up > low:
        return fixed.upper()
    if word[:1].isupper() or (fixed[:1].isalpha() and not word[:1].isalpha() and up and not low):
        return fixed[:1].upper() + fixed[1:]
    return fixed


_FIGURE = re.compile(r"(?<![A-Za-z0-9@.,/-])(?:[A-Z]{2,3}-)?[0-9OoDlIiZSBbgq]+(?:[.,/:-][0-9OoDlIiZSBbgq]+)*(?![A-Za-z0-9@])")


def figures(text: str) -> list[tuple[str, str]]:
    """(as read, corrected) of figures with letters in them."""
    out = []
    for m in _FIGURE.finditer(text):
        raw = m.group()
        head = re.match(r"[A-Z]{2,3}-(?=[0-9OolISB])", raw)
        body = raw[head.end() :] if head else raw
        digits, letters = sum(c.isdigit() for c in body), sum(c.isalpha() for c in body)
        if letters and (digits >= 2 or (digits == 1 and len(body) == 2 and letters == 1 and body[0].isdigit() and body[1] in "OolI")) and letters <= max(1, digits // 2) and not re.fullmatch(r"[0-9]+[A-Za-z]", body.replace("O", "0").replace("o", "0").replace("l", "1").replace("I", "1").replace("S", "5").replace("D", "0")) and not re.match(r"0[A-Z]", body):
            fixed = body.translate(DIGIT_FORMS)
            if re.fullmatch(r"[0-9.,/:-]+", fixed):
                out.append((raw, (head.group() if head else "") + fixed))
    return out


def _cased(word: Column, fixed: Column) -> Column:
    @F.pandas_udf("string")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for a, b in batches:
            yield pd.Series([cased(x, y) for x, y in zip(a, b)])

    return run(word, fixed)


def whole_words(halves: DataFrame, lex: DataFrame, fixes: DataFrame) -> DataFrame:
    """`halves` (row_id, a, b) with `fixed`, the whole word: with a hyphen where the lexicon has it so, or where the halves repeat
    each other; misread letters corrected; letter case kept. Joins on distinct words only."""
    h = halves.withColumn("plain", F.lower(F.concat("a", "b"))).withColumn("dashed", F.lower(F.concat_ws("-", "a", "b")))
    distinct = h.select("plain", "dashed").distinct()
    with_n = distinct.join(lex.select(F.col("word").alias("plain"), F.col("n").alias("np")), "plain", "left").join(lex.select(F.col("word").alias("dashed"), F.col("n").alias("nd")), "dashed", "left")
    fp = fixes.select(F.col("word").alias("plain"), F.col("fixed").alias("fp"))
    fd = fixes.select(F.col("word").alias("dashed"), F.col("fixed").alias("fd"))
    with_n = with_n.join(fp, "plain", "left").join(fd, "dashed", "left")
    x = h.join(with_n, ["plain", "dashed"])
    la, lb = F.lower("a"), F.lower("b")
    twice = (F.length("a") >= 3) & (lb.startswith(la) | la.endswith(lb) | (F.substring(lb, 1, 4) == F.substring(la, -4, 4)) | (skeleton_column(la) == skeleton_column(lb)))
    keep = F.when(F.coalesce("nd", F.lit(0)) != F.coalesce("np", F.lit(0)), F.coalesce("nd", F.lit(0)) > F.coalesce("np", F.lit(0))).otherwise(twice)
    keep = F.when(F.col("fp").isNotNull() & F.col("np").isNull(), False).when(F.col("fd").isNotNull() & F.col("nd").isNull() & F.col("np").isNull(), True).otherwise(keep)
    raw = F.when(keep, F.concat_ws("-", "a", "b")).otherwise(F.concat("a", "b"))
    low = F.when(keep, F.coalesce("fd", "dashed")).otherwise(F.coalesce("fp", "plain"))
    return x.withColumn("fixed", F.when(F.lower(raw) == low, raw).otherwise(_cased(raw, low)))


def repaired(texts: DataFrame, row: str, fixes: DataFrame) -> DataFrame:
    """`texts` (row, text, cut, figs) with misread words and figures of the text replaced. fixes: (word, fixed) of
    distinct words; only rows that hold a misread word are moved."""
    hit = word_rows(texts.select(row, "cut"), row).join(fixes.withColumnRenamed("fixed", "w"), plain_word(F.col("raw")) == F.col("word"))
    hit = hit.groupBy(row).agg(F.collect_set(F.struct("raw", "w")).alias("hit"))

    @F.pandas_udf("string")
    def run(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for t, f, h in batches:
            yield pd.Series([_replaced(x, y is not None, () if z is None else z) for x, y, z in zip(t, f, h)], dtype=object)

    touched = F.col("hit").isNotNull() | F.col("figs").isNotNull()
    x = texts.join(hit, row, "left")
    return x.withColumn("text", F.when(touched, run(F.col("text"), F.col("figs"), F.col("hit"))).otherwise(F.col("text"))).drop("hit")


def _replaced(text: str, figs: bool, hit) -> str:
    for raw, fixed in figures(text) if figs else ():
        text = text.replace(raw, fixed)
    for h in hit:
        raw = h["raw"].lstrip(OPENED)
        text = re.sub(rf"(?<![^\W_]){re.escape(raw)}(?![^\W_])", lambda _, r=h["raw"], w=h["w"]: cased(r, w), text)
    return text


def joined_cell(text: Column, whole: Column) -> Column:
    """A cell with its broken words (array of a, b, fixed) whole; null where there is none."""
    gap = F.lit(rf"[{HYPHENS}]\s+")
    quoted = lambda c: F.concat(F.lit("\\Q"), c, F.lit("\\E"))
    return F.aggregate(whole, text, lambda t, w: F.regexp_replace(t, F.concat(quoted(w["a"]), gap, quoted(w["b"])), w["fixed"]))


def rejoined(lines: DataFrame, whole: DataFrame) -> DataFrame:
    """Lines (ocr_id, doc, page, idx, text, next_text, next_of_page, first, state) with every broken word whole in the line of its first
    half, and its second half gone from the next line. whole: (row_id, a, b, fixed)."""
    w = whole.select(F.col("row_id").alias("ocr_id"), "a", F.col("b").alias("_b"), "fixed")
    x = lines.join(w, "ocr_id", "left")
    # the line after a broken one: the next one of the page, or the first one of the next page
    order = Window.partitionBy("doc", "page").orderBy("idx", "ocr_id")
    x = x.withColumn("half", F.lag("_b").over(order))
    over = x.where("next_of_page is null and _b is not null").select("doc", (F.col("page") + 1).alias("page"), F.col("_b").alias("over"))
    x = x.join(over, ["doc", "page"], "left").withColumn("half", F.coalesce("half", F.when(F.col("first"), F.col("over"))))
    # the second half and the marks that follow it move to the word
    marks = F.coalesce(F.regexp_extract(F.expr("substring(ltrim(next_text), length(_b) + 1)"), _MARKS, 0), F.lit(""))
    text = F.when(F.col("fixed").isNotNull(), F.concat(F.regexp_replace("text", _FIRST, ""), F.col("fixed"), marks)).otherwise(F.col("text"))
    begun = F.coalesce(F.startswith(F.ltrim("text"), F.col("half")), F.lit(False))
    rest = F.when(begun, F.ltrim(F.regexp_replace(F.expr("substring(ltrim(text), length(half) + 1)"), _MARKS, ""))).otherwise(F.col("text"))
    x = x.withColumns({"goes_on": begun & F.col("first"), "text": rest})
    return x.withColumn("text", text).select("ocr_id", "doc", "page", "idx", "text", "state", "goes_on")


def paragraphs(labels: DataFrame) -> DataFrame:
    """(doc, page, par, text): the lines without furniture joined into paragraphs that end at breaks, titles and the ends of
    sentences before a page end; a paragraph that a page cuts goes on over the page end and has the place of its start.
    labels: (ocr_id, doc, page, idx, text, state) and, from `rejoined`, goes_on: the line lost the half of a word to the
    page before. Lines are gathered page by page; only paragraphs that pages cut are
    linked, by components, so a document may have any number of pages."""
    x = labels.where("state in ('body', 'break', 'title')")
    x = x if "goes_on" in x.columns else x.withColumn("goes_on", F.lit(False))
    order = Window.partitionBy("doc", "page").orderBy("idx", "ocr_id")
    ends = F.lag(F.when(F.col("state").isin("break", "title"), 1).otherwise(0), 1, 0).over(order)
    x = x.withColumn("ends", ends).withColumn("par", F.sum("ends").over(order.rowsBetween(Window.unboundedPreceding, 0)).cast("int") + 1)
    g = x.groupBy("doc", "page", "par").agg(F.sort_array(F.collect_list(F.struct("idx", "ocr_id", "text", "state", "goes_on"))).alias("l"))
    text = F.array_join(F.transform("l", lambda r: r["text"]), "\n")
    text = F.regexp_replace(text, f"(\\p{{L}})[­¬‐-]\\s*\\n(?=\\p{{Ll}})", "$1")
    g = g.select("doc", "page", "par", F.regexp_replace(F.trim(text), r"\s*\n\s*", " ").alias("text"), F.element_at("l", -1)["state"].alias("state"), F.element_at("l", 1)["goes_on"].alias("goes_on"))
    g = stored(g.withColumn("last", F.max("par").over(Window.partitionBy("doc", "page")) == F.col("par")))
    open_ = (F.col("state") == "body") & ~F.col("text").rlike(r"[.!?:][\"')]*$")
    head = g.where("last").select("doc", "page", "par", open_.alias("open"))
    tail = g.where("par = 1").select("doc", (F.col("page") - 1).alias("page"), "goes_on", F.col("text").rlike(r"^[\"'(]?[\p{Ll}0-9]").alias("low"))
    name = lambda page, par: F.concat_ws("/", F.lpad(F.col("doc").cast("string"), 20, "0"), F.lpad(page.cast("string"), 10, "0"), F.lpad(par.cast("string"), 10, "0"))
    link = stored(head.join(tail, ["doc", "page"]).where("goes_on or (open and low)").select(name(F.col("page"), F.col("par")).alias("a"), name(F.col("page") + 1, F.lit(1)).alias("b")))
    g = g.withColumn("node", name(F.col("page"), F.col("par")))
    if link.isEmpty():
        return g.select("doc", "page", "par", "text").where("text <> ''")
    g = g.join(components(link, "a", "b"), "node", "left")
    alone = g.where("label is null").select("doc", "page", "par", "text")
    cut = g.where("label is not null").groupBy("doc", "label").agg(F.sort_array(F.collect_list(F.struct("page", "par", "text"))).alias("l"))
    whole = cut.select("doc", F.col("l")[0]["page"].alias("page"), F.col("l")[0]["par"].alias("par"), F.array_join(F.transform("l", lambda r: r["text"]), " ").alias("text"))
    return alone.unionByName(whole).where("text <> ''")


# --- tables ---------------------------------------------------------------------------------------------------------


def repeated_headings(cells: DataFrame) -> DataFrame:
    """cell_id of cells of rows that repeat the first row of their table: most cells equal its cells by skeleton."""
    first = cells.groupBy("doc").agg(F.min("row_no").alias("r0"))
    c = cells.join(first, "doc").withColumn("s", F.regexp_replace(skeleton_column(F.coalesce("text", F.lit(""))), r"[^a-z]+", ""))
    head = c.where("row_no = r0 and s <> ''").select("doc", "col_no", F.col("s").alias("h")).distinct()
    later = c.where("row_no > r0").join(head, ["doc", "col_no"], "left")
    same = F.count_if((F.col("s") == F.col("h")) | ((F.length("h") >= 5) & (F.levenshtein("s", "h", 2) >= 0)))
    rows = later.groupBy("doc", "row_no").agg(same.alias("same"), F.count("*").alias("n"), F.count("h").alias("nh"))
    return cells.join(rows.where("same >= 2 and same * 2 > nh"), ["doc", "row_no"]).select("cell_id")
