"""Text and path expressions used by every layer."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Private-use characters that mark matches; in texts they become UNKNOWN, so lengths and neighbours stay.
OPEN, CLOSE, UNKNOWN = "\ue000", "\ue001", "\ufffd"

# Where Python's str.splitlines() breaks, after newline normalisation.
LINE_BREAKS = "[\n\u000b\u000c\u001c\u001d\u001e\u0085\u2028\u2029]"

SPACE_AROUND = r"(?U)^\s+|\s+$"


def clean_text(text: Column) -> Column:
    """Newlines become ``\\n``, the marker characters UNKNOWN."""
    for old, new in (("\r\n", "\n"), ("\r", "\n"), (OPEN, UNKNOWN), (CLOSE, UNKNOWN)):
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def decode_text(raw: Column) -> Column:
    """Bytes to text: invalid UTF-8 is dropped, then :func:`clean_text`.

    A genuine U+FFFD is set aside as a marker, which ``clean_text`` turns back, so that
    only the bytes that could not be decoded are dropped.
    """
    aside = F.replace(raw.cast("string"), F.lit(UNKNOWN), F.lit(OPEN))
    return clean_text(F.replace(F.make_valid_utf8(aside), F.lit(UNKNOWN), F.lit("")))


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def suffix(name: Column) -> Column:
    """Lower-cased last extension; a leading dot alone starts none."""
    return F.lower(F.regexp_extract(name, r"(?s)^.+(\.[^.]+)$", 1))


def stem(name: Column) -> Column:
    extension = F.regexp_extract(name, r"(?s)^.+(\.[^.]+)$", 1)
    return F.left(name, F.length(name) - F.length(extension))


def directories(path: Column) -> Column:
    parts = F.split(path, "/")
    return F.slice(parts, 1, F.size(parts) - 1)


def path_order(path: Column) -> Column:
    """Sorting by this equals a depth-first walk in name order."""
    return F.split(path, "/")


def strip(text: Column) -> Column:
    return F.regexp_replace(text, SPACE_AROUND, "")


def lines(text: Column) -> Column:
    return F.split(text, LINE_BREAKS, -1)


def newline_count(text: Column) -> Column:
    return F.octet_length(text) - F.octet_length(F.replace(text, F.lit("\n"), F.lit("")))


def contains_any(text: Column, words) -> Column:
    """True when one of a fixed list of words is in the text."""
    found = F.lit(False)
    for word in words:
        found = found | text.contains(word)
    return found


def slugify(name: Column) -> Column:
    slug = F.regexp_replace(F.lower(name), "[^a-z0-9]+", "-")
    slug = F.regexp_replace(slug, "^-+|-+$", "")
    return F.when(slug == "", F.lit("feature")).otherwise(slug)


def percent_1(part: Column, whole: Column) -> Column:
    """``part / whole * 100`` rounded to one decimal from the exact binary value.

    ``round`` works on the shortest decimal text of a double, so a value such as
    0.35, which lies just below its text, would go up. The fraction is scaled by
    a power of two, which is exact, and rounded half to even in integers.
    """
    unit = 1 << 57
    value = part.cast("double") / whole.cast("double") * F.lit(100.0)
    whole_part = F.floor(value)
    tenths = ((value - whole_part) * F.lit(float(unit))).cast("bigint") * 10
    digit = F.shiftright(tenths, 57)
    rest = (tenths - digit * F.lit(unit)) * 2
    number = whole_part * 10 + digit
    up = (rest > unit) | ((rest == unit) & (number % 2 == 1))
    return (number + F.when(up, 1).otherwise(0)).cast("double") / F.lit(10.0)
