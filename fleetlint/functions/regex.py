"""Regular-expression scans as JVM expressions.

Python patterns run in ``java.util.regex`` with flags that give the same matches:
``d`` lets ``.`` and ``$`` see only ``\\n``, ``U`` makes classes and case folding
Unicode-aware as they are for Python ``str`` patterns. Where the classes still differ
they are spelled out.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Sequence
from re import _constants as _sre

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from fleetlint.catalog.rules import Rule
from fleetlint.functions.tables import sql_literal
from fleetlint.functions.text import CLOSE, OPEN, newline_count

try:
    from re import _parser as _sre_parser
except ImportError:  # Python before 3.11
    import sre_parse as _sre_parser

_BLOCK = 256
TAIL_CHARS = 4

# Letters that case folding maps onto ASCII although lower() does not.
_ODD_LETTERS = {"\u0130": "i", "\u0131": "i", "\u017f": "s", "\u212a": "k"}


# Python's classes in Java's terms. Java would count combining marks as word
# characters and would not count the separators 1C-1F as space.
_WORD = r"\p{L}\p{N}_"
_SPACE = r"\s\x1c-\x1f"
_OUTSIDE = {
    "w": f"[{_WORD}]", "W": f"[^{_WORD}]", "s": f"[{_SPACE}]", "S": f"[^{_SPACE}]",
    "b": f"(?:(?<=[{_WORD}])(?![{_WORD}])|(?<![{_WORD}])(?=[{_WORD}]))", "Z": r"\z",
}
_INSIDE = {"w": _WORD, "s": _SPACE}
_TOKEN = re.compile(r"\\(.)|\(\?P<|\[\^?\]?|\]|.", re.S)


def to_java(pattern: str) -> str:
    """A Python pattern in Java's syntax, with the same meaning of its classes."""
    out, inside = [], False
    for token in _TOKEN.finditer(pattern):
        text, escaped = token.group(0), token.group(1)
        if escaped is not None:
            out.append((_INSIDE if inside else _OUTSIDE).get(escaped, text))
        elif inside:
            inside = text != "]"
            out.append(text if text in ("]", "^") or not text.startswith("[") else "\\" + text)
        elif text.startswith("["):
            inside = True
            out.append(text.replace("]", "\\]"))
        else:
            out.append("(?<" if text == "(?P<" else text)
    return "".join(out)


def _first_characters(items) -> tuple[set[int], bool] | None:
    """Code points that a match of parsed ``items`` may begin with, and whether it may be empty; None: too many."""
    found: set[int] = set()
    for op, value in items:
        if op is _sre.LITERAL:
            return found | {value}, False
        if op in (_sre.AT, _sre.ASSERT, _sre.ASSERT_NOT):
            continue
        if op is _sre.IN:
            if any(kind not in (_sre.LITERAL, _sre.RANGE) for kind, _ in value):
                return None
            ranges = [(v, v) if kind is _sre.LITERAL else v for kind, v in value]
            return None if any(high > 127 for _, high in ranges) else (
                found | {c for low, high in ranges for c in range(low, high + 1)}, False)
        if op is _sre.BRANCH:
            parts = [_first_characters(part) for part in value[1]]
        elif op is _sre.SUBPATTERN and not value[1] and not value[2]:
            parts = [_first_characters(value[3])]
        elif op in (_sre.MAX_REPEAT, _sre.MIN_REPEAT, getattr(_sre, "POSSESSIVE_REPEAT", None)):
            parts = [_first_characters(value[2])] + [(set(), True)] * (value[0] == 0)
        else:
            return None
        if any(part is None for part in parts):
            return None
        found = found.union(*[part[0] for part in parts])
        if not any(part[1] for part in parts):
            return found, False
    return found, True


def _first_look(pattern: str, ignore_case: bool) -> str:
    """A look at one character, without flags, that spares most places of a text the pattern itself."""
    try:
        parsed = _sre_parser.parse(pattern)
    except re.error:  # a form for the JVM only
        return ""
    ignore_case = ignore_case or bool(parsed.state.flags & re.I)
    first = _first_characters(parsed)
    if first is None or first[1] or any(c > 127 for c in first[0]):
        return ""
    letters = {chr(c) for c in first[0]}
    if ignore_case:
        letters |= {x for c in letters for x in (c.lower(), c.upper())}
        letters |= {odd for odd in _ODD_LETTERS if _ODD_LETTERS[odd] in letters}
    return "(?-iU:(?=[" + "".join(c if c.isalnum() else f"\\x{{{ord(c):x}}}" for c in sorted(letters)) + "]))"


def java_pattern(rule: Rule) -> str:
    flags = ("i" if rule.ignore_case else "") + ("m" if rule.multiline else "")
    pattern = rule.jvm or rule.pattern
    return f"(?{flags}dU){_first_look(pattern, rule.ignore_case)}(?:{to_java(pattern)})"


def repeats_group(pattern: str) -> bool:
    """True when a group may repeat without bound (see ``jvm`` of a rule)."""
    plain = re.sub(r"\\.|\[\^?\]?(?:\\.|[^\]\\])*\]", "x", pattern, flags=re.S)
    return re.search(r"\)(?:[*+]|\{\d*,\})", plain) is not None


def python_only(pattern: str) -> bool:
    """True for forms that the JVM engine lacks: named back references, conditions, ``_`` in a group's name."""
    plain = re.sub(r"\\.|\[\^?\]?(?:\\.|[^\]\\])*\]", "x", pattern, flags=re.S)
    return re.search(r"\(\?P=|\(\?\(|\(\?P<[^>]*[^A-Za-z0-9>]", plain) is not None


def runs_in_jvm(rule: Rule) -> bool:
    return bool(rule.jvm) or not (repeats_group(rule.pattern) or python_only(rule.pattern))


def python_matches(rules: Sequence[Rule], match_chars: int):
    """Matches by Python's engine, which keeps repetitions on the heap, in Arrow batches."""
    compiled = [
        (re.compile(r.pattern, (re.I if r.ignore_case else 0) | (re.M if r.multiline else 0)), r.exists_only)
        for r in rules
    ]

    def rows(index: int, text: str) -> list[tuple]:
        pattern, exists_only = compiled[index]
        if exists_only:
            return [(None, None, None, None)] if pattern.search(text) else []
        found, line, last = [], 1, 0
        for m in pattern.finditer(text):
            line += text.count("\n", last, m.start())
            last = m.start()
            found.append((line, m.group(0)[:match_chars], m.group(0)[-TAIL_CHARS:], hashlib.sha256(m.group(0).encode()).hexdigest()))
        return found

    @F.pandas_udf("array<struct<line:int,match:string,match_end:string,match_key:string>>")
    def match(index: pd.Series, text: pd.Series) -> pd.Series:
        return pd.Series([rows(i, t) for i, t in zip(index, text)], dtype=object)

    return match


def has_odd_letters(text: Column) -> Column:
    found = F.lit(False)
    for letter in _ODD_LETTERS:
        found = found | text.contains(letter)
    return found


# Conditions and branches of a scan are SQL text: a catalog has about a hundred rules
# with many words each, and one parsed text is built far faster than a Column per word.


def any_word(subject: str, words: Sequence[str]) -> str:
    return "(" + " OR ".join(f"contains({subject}, {sql_literal(w)})" for w in words) + ")"


#: From this many words on, one pass that collects them is cheaper than a search for each;
#: bytes at which a word is looked for, bits of the table of beginnings, places that are looked at together.
MANY_WORDS, HEAD, HEAD_BITS, PLACES = 32, 3, 16, 1 << 16


def _word_finder(words: Sequence[str]):
    """A function from an Arrow array of texts to the words found in each, joined by line breaks.

    Every place of all texts is looked up in a table of the hashed first ``HEAD`` bytes; the few places
    that are left are compared with the words of that beginning. Only shorter words are searched one by one.
    """
    coded = [word.encode() for word in words]
    short = [k for k, word in enumerate(coded) if len(word) < HEAD]
    by_head: dict[int, list[int]] = {}
    for k, word in enumerate(coded):
        if len(word) >= HEAD:
            by_head.setdefault(int.from_bytes(word[:HEAD], "little"), []).append(k)
    heads = np.array(sorted(by_head), np.uint64)
    longest, head_bits, places = max(map(len, coded)), HEAD_BITS, PLACES
    low = np.uint32(32 - 8 * HEAD), np.uint32(0x9E3779B1), np.uint32(32 - HEAD_BITS)
    head_mask = np.uint64((1 << 8 * HEAD) - 1)

    def slot(window):
        return ((window << low[0]) * low[1]) >> low[2]

    def table(texts):
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
        first, size = int(offsets[0]), int(offsets[-1] - offsets[0])
        has = np.zeros((len(texts), len(coded)), bool)
        if not size:
            return has
        offsets, whole = offsets - first, memoryview(texts.buffers()[2])[first:first + size]
        for row, (low_end, end) in enumerate(zip(offsets, offsets[1:]) if short else ()):
            text = bytes(whole[low_end:end])
            for k in short:
                has[row, k] = coded[k] in text
        if not len(heads):
            return has
        # bytes behind the end, so that a window of eight may begin at each place of a word
        data = np.zeros(size + longest + 16, np.uint8)
        data[:size] = np.frombuffer(whole, np.uint8)
        four, eight = (np.ndarray(len(data) - n, f"<u{n}", data, strides=(1,)) for n in (4, 8))
        begins = np.zeros(1 << head_bits, bool)
        begins[slot(heads.astype(np.uint32))] = True
        at = np.concatenate([
            np.flatnonzero(begins[slot(four[i:min(i + places, size)])]) + i for i in range(0, size, places)])
        begin = eight[at] & head_mask
        head = np.minimum(np.searchsorted(heads, begin), len(heads) - 1)
        real = heads[head] == begin
        at, head = at[real], head[real]
        order = np.argsort(head, kind="stable")
        at, ends = at[order], np.searchsorted(head[order], np.arange(len(heads) + 1))
        for h, low_end, end in zip(heads, ends, ends[1:]):
            for k in by_head[int(h)] if end > low_end else ():
                found = at[low_end:end]
                for i in range(0, len(coded[k]), 8):
                    part = coded[k][i:i + 8]
                    mask = np.uint64((1 << 8 * len(part)) - 1)
                    found = found[eight[found + i] & mask == np.uint64(int.from_bytes(part, "little"))]
                rows = np.searchsorted(offsets, found, "right") - 1
                has[rows[found + len(coded[k]) <= offsets[rows + 1]], k] = True
        return has

    def find(texts: pa.Array) -> pa.Array:
        if not len(texts):
            return pa.array([], pa.string())
        texts = texts.cast(pa.large_string())
        has = table(texts)
        ends = np.concatenate([[0], np.cumsum(has.sum(1))])
        lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(words, pa.string()).take(pa.array(np.nonzero(has)[1])))
        return pc.if_else(texts.is_null(), pa.scalar(None, pa.string()), pc.binary_join(lists, "\n"))

    return find


def needed_words(rules: Sequence[Rule]) -> list[str]:
    return sorted({w.lower() for rule in rules for group in rule.needs for w in group})


def words_in(text: Column, words: Sequence[str]) -> Column:
    """A short text that contains the same of ``words`` as ``text`` does: those that it contains, joined by line breaks.

    The texts go through Python workers once, in Arrow batches; what comes back is a few words a text.
    """
    words = [w for w in words if w]
    if len(words) < MANY_WORDS or any("\n" in w for w in words):
        return text
    find = _word_finder(words)

    @F.arrow_udf("string")
    def found(texts: pa.Array) -> pa.Array:
        return find(texts)

    return found(text)


def may_match(rule: Rule, text: str = "content", lowered: str = "_lower", odd: str = "_odd") -> str | None:
    """A cheap condition that is false only where the pattern surely has no match."""
    if rule.gate:
        return f"rlike({text}, {sql_literal('(?dU)' + to_java(rule.gate))})"
    if not rule.needs:
        return None
    gate = " AND ".join(any_word(lowered, [w.lower() for w in group]) for group in rule.needs)
    if not rule.ignore_case:
        return gate + " AND " + " AND ".join(any_word(text, group) for group in rule.needs)
    return f"({odd} OR ({gate}))"


def found_in(rule: Rule, text: str = "content") -> str:
    return f"rlike({text}, {sql_literal(java_pattern(rule))})"


def match_pieces(rule: Rule, text: str = "content") -> str:
    """Text before the first match, then for each match: it, CLOSE, the text up to the next."""
    marked = f"regexp_replace({text}, {sql_literal(java_pattern(rule))}, {sql_literal(OPEN + '$0' + CLOSE)})"
    return f"split({marked}, {sql_literal(OPEN)}, -1)"


def bind(value: Column, body) -> Column:
    """Evaluate ``value`` once and use it inside lambdas (a lambda would repeat it)."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _sum(numbers: Column) -> Column:
    return F.aggregate(numbers, F.lit(0), lambda acc, n: acc + n)


def match_rows(pieces: Column, match_chars: int = 120) -> Column:
    """``array<struct<line, match, match_end, match_key>>`` from :func:`match_pieces`.

    The line of match k is one more than the newlines before it. Newlines are
    counted once per piece and summed in blocks, so that a text with very many
    matches does not cost the square of their number.
    """

    def rows(counts: Column) -> Column:
        blocks = F.transform(
            F.sequence(F.lit(0), F.floor((F.size(counts) - 1) / _BLOCK).cast("int")),
            lambda b: _sum(F.slice(counts, b * _BLOCK + 1, F.lit(_BLOCK))),
        )
        return bind(blocks, lambda sums: bind(
            F.transform(sums, lambda _, i: _sum(F.slice(sums, F.lit(1), i))),
            lambda before: F.transform(
                F.slice(pieces, F.lit(2), F.size(pieces) - 1),
                lambda piece, k: F.struct(
                    (
                        F.lit(1)
                        + F.get(before, F.floor(k / _BLOCK).cast("int"))
                        + _sum(F.slice(counts, k - k % _BLOCK + 1, k % _BLOCK + 1))
                    ).alias("line"),
                    F.left(F.substring_index(piece, CLOSE, 1), F.lit(match_chars)).alias("match"),
                    F.right(F.substring_index(piece, CLOSE, 1), F.lit(TAIL_CHARS)).alias("match_end"),
                    F.sha2(F.substring_index(piece, CLOSE, 1), 256).alias("match_key"),
                ),
            ),
        ))

    return bind(F.transform(pieces, newline_count), rows)
