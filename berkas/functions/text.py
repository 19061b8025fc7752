"""Text functions: lines, words, normal forms, digit folding, values after keys, money."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Letters that stand for digits in scanned numbers, and the digits.
FOLD_FROM = "OoDIli|ZzASsbGBgq"
FOLD_TO = "00011112245566899"


def let(value: Column, body) -> Column:
    """`body` of a value that is computed once, however often body names it."""
    return F.transform(F.array(value), body)[0]


def trimmed(c: Column) -> Column:
    """Without white space (Unicode) at both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def raw_lines(text: Column) -> Column:
    """Array of lines as they stand; a carriage return before the line feed belongs to the break, and a break at the
    end opens no further line."""
    parts = F.split(F.regexp_replace(text, r"\r?\n$", ""), r"\r?\n")
    return F.when(text == "", F.array().cast("array<string>")).otherwise(parts)


def lines(text: Column) -> Column:
    """Array of trimmed lines, empty ones left out; null for null."""
    return F.filter(F.transform(raw_lines(text), trimmed), lambda x: x != "")


def words(text: Column) -> Column:
    """Array of words between white space (Unicode)."""
    return F.filter(F.split(text, r"(?U)\s+"), lambda x: x != "")


def normalized(text: Column) -> Column:
    """White space runs as one blank, trimmed, lower case."""
    return F.lower(trimmed(F.regexp_replace(text, r"(?U)\s+", " ")))


def digits_folded(text: Column) -> Column:
    """Digits only; letters that resemble digits are read as them."""
    return F.regexp_replace(F.translate(text, FOLD_FROM, FOLD_TO), "[^0-9]", "")


def _after(line: Column, key: str) -> Column:
    return trimmed(F.regexp_replace(line, rf"(?isU)^.*?{key}[:=\-\s]*", ""))


def value_after(line: Column, key: str) -> Column:
    """What follows a key; without the key, what follows the first colon; without both, the line. Matching is on the
    line itself, so letters whose upper case is longer cannot shift the cut."""
    up = F.upper(line)
    colon = trimmed(F.regexp_replace(line, r"(?s)^[^:]*:", ""))
    return F.when(F.contains(up, F.lit(key)), _after(line, key)).when(F.contains(line, F.lit(":")), colon).otherwise(trimmed(line))


def value_after_key(line: Column, key: str) -> Column:
    """What follows a key; without the key the line; separators in front are left out."""
    lead = trimmed(F.regexp_replace(line, r"(?U)^[:=\-\s]+", ""))
    return F.when(F.contains(F.upper(line), F.lit(key)), _after(line, key)).otherwise(lead)


def money(text: Column) -> Column:
    """An amount as DOUBLE: of dot and comma the later one is the decimal sign; a comma alone is one if two characters
    follow the last; a dot alone separates thousands if three or more follow the last. Null if no number results. All
    digits of the text count, those of a rate or a date too."""
    c = F.regexp_replace(text, r"[^0-9.,]", "")
    after_comma = F.instr(F.reverse(c), ",")
    after_dot = F.instr(F.reverse(c), ".")
    both = F.when(after_comma < after_dot, F.replace(F.replace(c, F.lit("."), F.lit("")), F.lit(","), F.lit("."))).otherwise(F.replace(c, F.lit(","), F.lit("")))
    comma = F.when(after_comma == 3, F.replace(c, F.lit(","), F.lit("."))).otherwise(F.replace(c, F.lit(","), F.lit("")))
    dot = F.when(after_dot > 3, F.replace(c, F.lit("."), F.lit(""))).otherwise(c)
    text = F.when((after_comma > 0) & (after_dot > 0), both).when(after_comma > 0, comma).when(after_dot > 0, dot).otherwise(c)
    return text.try_cast("double")


def npwp_formatted(d: Column) -> Column:
    """15 digits as 2.3.3.1-3.3; other lengths unchanged."""
    return F.when(F.length(d) == 15, F.regexp_replace(d, r"^(..)(...)(...)(.)(...)(...)$", r"$1.$2.$3.$4-$5.$6")).otherwise(d)


def byte_length(text: Column) -> Column:
    return F.octet_length(text)


def escaped_html(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text
