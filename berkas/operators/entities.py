"""Phones, e-mail addresses, dates, amounts, identity numbers, plates and links in text, each list distinct and in order of
first sight. All on arrays inside the row; null text gives null lists, empty text empty ones."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from berkas.functions.text import let, lines, words

# Month names and short forms; the first letters of vehicle plates.
MONTHS = ["JANUARI", "FEBRUARI", "MARET", "APRIL", "MEI", "JUNI", "JULI", "AGUSTUS", "SEPTEMBER", "OKTOBER", "NOVEMBER", "DESEMBER", "JAN", "FEB", "MAR", "APR", "JUN", "JUL", "AUG", "AGU", "SEP", "OKT", "NOV", "DES"]
PLATES = [
    "BL", "BB", "BK", "BA", "BM", "BH", "BD", "BP", "BG", "BN", "BE", "A", "B", "D", "E", "F", "T", "Z", "G", "H", "K", "R", "AA", "AD", "AB", "L", "M", "N", "P", "S", "W", "AE", "AG",
    "DK", "DR", "EA", "DH", "EB", "ED", "KB", "DA", "KH", "KT", "KU", "DB", "DL", "DM", "DN", "DT", "DD", "DC", "DP", "DE", "DG", "PA", "PB",
]


class Cut:
    """A text that has been cut: the words of each line, and the tokens of the whole."""

    def __init__(self, line_words: Column, tokens: Column) -> None:
        self.line_words, self.tokens = line_words, tokens


def _line_words(text: Column) -> Column:
    return F.transform(lines(text), words)


def _per_line(text: Column | Cut, find) -> Column:
    each = text.line_words if isinstance(text, Cut) else _line_words(text)
    return F.array_distinct(F.flatten(F.transform(each, lambda ws: let(ws, find))))


def _tokens(text: Column | Cut) -> Column:
    return text.tokens if isinstance(text, Cut) else F.transform(words(text), lambda t: F.regexp_replace(t, r"^[,.;:()\[\]]+|[,.;:()\[\]]+$", ""))


def emails(text: Column) -> Column:
    """Tokens with one @, a local part, and a domain with a point."""
    return F.array_distinct(F.filter(_tokens(text), lambda t: t.rlike(r"^[^@]+@[^@]*\.[^@]*$") & (F.octet_length(F.regexp_replace(t, "^.*@", "")) >= 3)))


def urls(text: Column) -> Column:
    """Tokens that begin with http://, https:// or www."""
    return F.array_distinct(F.filter(_tokens(text), lambda t: t.rlike(r"^(http://|https://|www\.)")))


def niks(text: Column) -> Column:
    """Numbers of 16 digits, alone in their token or with points or dashes, as digits."""

    def find(ws):
        clean = F.transform(ws, lambda t: F.regexp_replace(t, r"^[^A-Za-z0-9]+|[^A-Za-z0-9]+$", ""))
        ok = F.filter(clean, lambda t: (F.length(F.regexp_replace(t, "[^0-9]", "")) == 16) & ((F.octet_length(t) == 16) | t.rlike(r"[-.]")))
        return F.transform(ok, lambda t: F.regexp_replace(t, "[^0-9]", ""))

    return _per_line(text, find)


def amounts(text: Column) -> Column:
    """Rp, IDR or $ with the number that follows or is attached, as written."""

    def find(ws):
        def one(w, i):
            up = F.upper(w)
            nxt = F.try_element_at(ws, i + 2)
            apart = F.when(nxt.rlike("[0-9]"), F.concat(w, F.lit(" "), nxt))
            glued = F.when(up.rlike(r"^(RP|IDR|\$)") & w.rlike("[0-9]"), w)
            return F.when(up.isin("RP", "RP.", "IDR", "$"), apart).otherwise(glued)

        return F.filter(F.transform(ws, one), lambda a: a.isNotNull())

    return _per_line(text, find)


def dates(text: Column) -> Column:
    """Dates in figures, then those with a month name, line by line."""
    names = "|".join(MONTHS)

    def find(ws):
        clean = F.transform(ws, lambda t: F.regexp_replace(t, r"^[,.;:()]+|[,.;:()]+$", ""))
        digits = F.filter(clean, lambda t: t.rlike(r"^([0-9]{2}|[0-9]{4})(/[0-9]{2}/|-[0-9]{2}-)([0-9]{2}|[0-9]{4})$"))

        def named(w, i):
            strip = lambda c: F.regexp_replace(c, r"^[^0-9]+|[^0-9]+$", "")
            month, year = F.try_element_at(ws, i + 2), F.try_element_at(ws, i + 3)
            day = strip(w)
            ok = day.rlike("^[0-9]+$") & day.try_cast("long").between(1, 31) & F.upper(month).rlike(names) & (F.octet_length(strip(year)) == 4)
            return F.when(ok, F.concat(w, F.lit(" "), month, F.lit(" "), year))

        return F.concat(digits, F.filter(F.transform(ws, named), lambda d: d.isNotNull()))

    return _per_line(text, find)


def vehicle_plates(text: Column) -> Column:
    """An area code, one to four digits, and one to three letters, in three words; the code in upper case."""

    def find(ws):
        def one(w, i):
            num, tail = F.try_element_at(ws, i + 2), F.try_element_at(ws, i + 3)
            count = lambda c, rx: F.length(F.regexp_replace(c, rx, ""))
            ok = F.upper(w).isin(PLATES) & count(num, "[^0-9]").between(1, 4) & count(tail, "[^A-Za-z]").between(1, 3) & (F.octet_length(tail) <= 4)
            return F.when(ok, F.concat(F.upper(w), F.lit(" "), num, F.lit(" "), tail))

        return F.filter(F.transform(ws, one), lambda p: p.isNotNull())

    return _per_line(text, find)


def phone_numbers(text: Column) -> Column:
    """Words that begin like a telephone number, with the groups of digits that follow; a word taken into a number does not
    begin another. A fold over the words of a line."""

    def find(ws):
        head = F.transform(ws, lambda t: F.regexp_replace(t, r"^[,.;:()]+|[,.;:()]+$", ""))
        tail = F.transform(ws, lambda t: F.regexp_replace(t, r"^[,.;]+|[,.;]+$", ""))
        goes = F.transform(tail, lambda t: t.rlike(r"^[0-9-]{3,6}$"))
        heads = F.filter(F.transform(head, lambda h, i: F.struct(i.alias("i"), h.alias("h"))), lambda x: x["h"].rlike(r"^(\+62|08|628|021)"))

        def whole(x):
            rest = F.slice(goes, x["i"] + 2, F.size(goes))
            stop = F.array_position(rest, False).cast("int")
            run = F.when(stop > 0, stop - 1).otherwise(F.size(rest))
            text = F.when(run > 0, F.concat(x["h"], F.lit(" "), F.array_join(F.slice(tail, x["i"] + 2, run), " "))).otherwise(x["h"])
            return F.struct(x["i"].alias("i"), (x["i"] + 1 + run).alias("end"), text.alias("t"))

        good = F.filter(F.transform(heads, whole), lambda x: F.length(F.regexp_replace(x["t"], "[^0-9]", "")).between(10, 15))
        start = F.struct(F.array().cast("array<string>").alias("out"), F.lit(0).alias("free"))
        step = lambda acc, x: F.when(x["i"] >= acc["free"], F.struct(F.concat(acc["out"], F.array(x["t"])).alias("out"), x["end"].alias("free"))).otherwise(acc)
        return F.aggregate(good, start, step, lambda acc: acc["out"])

    return _per_line(text, find)


LISTS = {"phone_numbers": phone_numbers, "emails": emails, "dates": dates, "amounts": amounts, "niks": niks, "vehicle_plates": vehicle_plates, "urls": urls}


def entities(text: Column) -> Column:
    """Struct of all seven lists; the text is cut into lines and words once for all of them."""
    cut = F.struct(_line_words(text).alias("w"), _tokens(text).alias("t"))
    return let(cut, lambda c: F.struct(*[f(Cut(c["w"], c["t"])).alias(n) for n, f in LISTS.items()]))


def none_found(e: Column) -> Column:
    """Whether all lists are empty."""
    out = F.lit(True)
    for f in LISTS:
        out = out & (F.size(e[f]) == 0)
    return out
