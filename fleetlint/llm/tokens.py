"""Token ids of texts, with a bounded memory of the stretches between spaces.

The tokenizers split a text before each space that stands between two other characters, so
what lies between such places can be encoded alone. They also split between a letter and the
marks behind it. ``StretchCache`` keeps the ids of what lies between both kinds of places, per
worker process; a text with other white space than single spaces and line breaks is encoded as a whole.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from fleetlint.llm.tables import kept_between_tasks

#: Stretches that a worker remembers; when half of them are new, the older half goes.
CACHE_ENTRIES = 800_000
#: White space that no cut text has stands before each stretch; letters of any version of Unicode; one of them and the mark behind it.
_CUT, _LETTERS = "\x1f", "A-Za-zÀ-ÖØ-öø-ʯА-я"
_MARK, _WORD = f"([{_LETTERS}])([.,;:!?])", re.compile(f" ?[{_LETTERS}]+")
#: Characters of a joined text of stretches.
JOINED_CHARS = 16_384
#: White space other than a space or a line break, and two of these in a row.
_OTHER_SPACE = [chr(c) for c in range(0x3001) if chr(c).isspace() and chr(c) not in " \n"] + ["  ", " \n", "\n ", "\n\n"]
_OTHER_ASCII = [c for c in _OTHER_SPACE if c.isascii()]


def has_other_space(text: str) -> bool:
    return any(map(text.__contains__, _OTHER_ASCII if text.isascii() else _OTHER_SPACE))


class StretchCache:
    """Ids of texts as little-endian unsigned 32-bit integers in bytes."""

    def __init__(self, encode: Callable[[list[str]], list[bytes]], entries: int = CACHE_ENTRIES,
                 encode_stretches: Callable[[list[str]], list[bytes]] | None = None):
        self.encode_strings, self.entries = encode, entries
        self.encode_stretches = encode_stretches or encode  # of strings that begin with their only white space
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def encode_texts(self, texts: list[str]) -> list[bytes]:
        """The ids of each text."""
        out: list[bytes | None] = [None] * len(texts)
        whole = [i for i, text in enumerate(texts) if has_other_space(text)]
        cut = sorted(set(range(len(texts))).difference(whole))
        for rows, encode in ((whole, self.encode_strings), (cut, self._encode_cut)):
            for i, ids in zip(rows, encode([texts[i] for i in rows]) if rows else [], strict=True):
                out[i] = ids
        return out

    def _encode_cut(self, texts: list[str]) -> list[bytes]:
        """The ids of texts, cut into stretches, of which each different one is looked up once."""
        marked = pc.replace_substring_regex(pa.array(texts, pa.large_string()), _MARK, rf"\1{_CUT}\2")
        for space in " \n":
            marked = pc.replace_substring(marked, space, _CUT + space)
        lists = pc.split_pattern(marked, _CUT)
        coded = lists.flatten().dictionary_encode()
        ids = self._ids(coded.dictionary.to_numpy(zero_copy_only=False).tolist())
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        starts = np.cumsum(sizes) - sizes
        index = coded.indices.to_numpy()
        lengths = sizes[index]
        ends = np.concatenate([[0], np.cumsum(lengths)])
        places = np.repeat(starts[index] - ends[:-1], lengths)
        places += np.arange(len(places))
        data = np.frombuffer(b"".join(ids), "<u4")[places].tobytes()
        bounds = (4 * ends[lists.offsets.to_numpy()]).tolist()
        return [data[a:b] for a, b in zip(bounds, bounds[1:], strict=False)]

    def _ids(self, stretches: list[str]) -> list[bytes]:
        """The ids of different stretches, encoded where they are not remembered, and remembered."""
        found = list(map(self.known.get, stretches))
        new = {s: self.older.get(s) for s, ids in zip(stretches, found, strict=True) if ids is None}
        missing = [s for s, ids in new.items() if ids is None]
        begun = [s for s in missing if s[:1] in (" ", "\n")]
        others = [s for s in missing if s[:1] not in (" ", "\n")]
        for strings, encode in ((begun, self.encode_stretches), (others, self.encode_strings)):
            new.update(zip(strings, encode(strings) if strings else [], strict=True))
        if len(self.known) + len(new) > self.entries // 2:
            self.known, self.older = {}, self.known
        self.known.update(new)
        return [new[s] if ids is None else ids for s, ids in zip(stretches, found, strict=True)]


def batches_of_texts(texts: list[str], chars: int = 2_000_000):
    """Ranges of texts with a bounded number of characters, or one text."""
    first, size = 0, 0
    for i, text in enumerate(texts):
        if size and size + len(text) > chars:
            yield first, i
            first, size = i, 0
        size += len(text)
    if first < len(texts):
        yield first, len(texts)


@kept_between_tasks
@lru_cache(maxsize=2)
def library_encoder(path: str) -> tuple[StretchCache, int]:
    """An encoder by the tokenizers library for a tokenizer file, and the size of its vocabulary."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the cores of a machine are shared by its tasks
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True  # a special token's name in a text is ordinary text

    def encode(strings: list[str]) -> list[bytes]:
        out = []
        for i in range(0, len(strings), 1024):
            out += [np.array(e.ids, "<u4").tobytes() for e in tokenizer.encode_batch_fast(strings[i:i + 1024], add_special_tokens=False)]
        return out

    # the vocabulary is byte-level: a token has a character for each of its bytes
    n_bytes = np.zeros(tokenizer.get_vocab_size(with_added_tokens=True), np.int64)
    for token, i in tokenizer.get_vocab(with_added_tokens=False).items():
        n_bytes[i] = len(token)
    if splits_words(tokenizer):
        return StretchCache(encode, encode_stretches=words_apart(tokenizer, encode, n_bytes)), len(n_bytes)
    return StretchCache(encode, encode_stretches=lambda strings: encode_joined(strings, encode, n_bytes)), len(n_bytes)


def splits_words(tokenizer) -> bool:
    """True for a byte-level tokenizer whose pieces are letters with a space before them, numbers, marks and white space."""
    file = json.loads(tokenizer.to_str())
    splitter = file["pre_tokenizer"] or {}
    return (not file["normalizer"] and not file["post_processor"] and splitter.get("type") == "ByteLevel"
            and splitter.get("use_regex", True) and not splitter.get("add_prefix_space", True))


def words_apart(tokenizer, encode: Callable[[list[str]], list[bytes]], n_bytes: np.ndarray) -> Callable[[list[str]], list[bytes]]:
    """:func:`encode_joined`, but words go to the library's model itself: a word with its space is one piece."""
    # byte-level: each byte is shown as a letter, itself if it is printable in Latin-1, else one from U+0100 on
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in printable]
    letters = {b: chr(256 + i) for i, b in enumerate(hidden)}
    model, is_word = tokenizer.model, _WORD.fullmatch

    def encode_stretches(strings: list[str]) -> list[bytes]:
        out: list[bytes | None] = [None] * len(strings)
        others = []
        for i, text in enumerate(strings):
            if is_word(text):
                shown = text.replace(" ", "Ġ") if text.isascii() else text.encode().decode("latin-1").translate(letters)
                out[i] = array("I", [t.id for t in model.tokenize(shown)]).tobytes()
            else:
                others.append(i)
        for i, ids in zip(others, encode_joined([strings[i] for i in others], encode, n_bytes), strict=True):
            out[i] = ids
        return out

    return encode_stretches


def encode_joined(strings: list[str], encode: Callable[[list[str]], list[bytes]], n_bytes: np.ndarray) -> list[bytes]:
    """``encode(strings)`` for strings that begin with their only white space.

    They are encoded as one text, which splits before each of them, and cut where the bytes of
    the tokens reach their ends. A text whose tokens do not end there is encoded string by string,
    and so is white space alone, which would meet that of the next string.
    """
    out = [b""] * len(strings)
    groups: list[list[int]] = [[]]
    alone, chars = [], 0
    for i, text in enumerate(strings):
        if len(text) < 2:
            alone.append(i)
            continue
        if chars > JOINED_CHARS:
            groups.append([])
            chars = 0
        groups[-1].append(i)
        chars += len(text)
    joined = ["".join([strings[i] for i in group]) for group in groups]
    for group, text, data in zip(groups, joined, encode(joined), strict=True):
        parts = [strings[i] for i in group]
        ends = np.cumsum([len(p) for p in parts] if text.isascii() else [len(p.encode()) for p in parts])
        reached = np.cumsum(n_bytes[np.frombuffer(data, "<u4")])
        at = np.searchsorted(reached, ends)
        if len(reached) == 0 or reached[-1] != ends[-1] or (reached[at] != ends).any():
            alone += group
            continue
        a = 0
        for i, b in zip(group, (4 * (at + 1)).tolist(), strict=True):
            out[i] = data[a:b]
            a = b
    for i, data in zip(alone, encode([strings[i] for i in alone]), strict=True):
        out[i] = data
    return out
