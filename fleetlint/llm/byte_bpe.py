"""Byte-level BPE by ranks: exact merges in linear time, by backtracking over longest matches.

The bytes of a token are read as Latin-1, so an Aho-Corasick automaton over strings finds
every token at every place of a piece. From the left the longest token is taken whose
neighbour before it is compatible, that is, merging the bytes of both alone gives just these
two. Where none fits, the place can be reached by no valid sequence and is never tried
again, so each place is entered at most once. Compatibility is remembered per pair. Pieces are
the matches of the splitting pattern, and pieces between spaces are remembered too.

Defined results: null is empty and has no ids; ids decode to the bytes of the text; ids and
rows may repeat; further columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from functools import lru_cache

import ahocorasick
import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from fleetlint.llm.tables import kept_between_tasks, map_arrow, whole_text
from fleetlint.llm.tokens import StretchCache, batches_of_texts

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN
#: Pairs whose compatibility a worker remembers.
PAIR_ENTRIES = 1_000_000


class ByteBpe:
    """Encoder and decoder for a vocabulary given as ``token bytes -> rank``."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN):
        self.ranks = ranks
        self.tokens = {rank: token for token, rank in ranks.items()}
        self.split = regex.compile(pattern)
        self.pairs: dict[tuple[bytes, bytes], bool] = {}
        self.automaton = ahocorasick.Automaton()
        for token in ranks:
            self.automaton.add_word(token.decode("latin-1"), token)
        self.automaton.make_automaton()

    def merged(self, data: bytes) -> list[bytes]:
        """Merges of a short string by their definition: always the pair of least rank, leftmost first."""
        parts = [data[i:i + 1] for i in range(len(data))]
        while len(parts) > 1:
            rank, at = min((self.ranks.get(a + b, len(self.ranks) + 1), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
            if rank > len(self.ranks):
                break
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def compatible(self, left: bytes, right: bytes) -> bool:
        known = self.pairs.get((left, right))
        if known is None:
            if len(self.pairs) >= PAIR_ENTRIES:
                self.pairs = {}
            known = self.pairs[left, right] = self.merged(left + right) == ([left, right] if left else [right])
        return known

    def encode_piece(self, data: bytes) -> list[int]:
        if data in self.ranks:
            return [self.ranks[data]]
        at: list[list[bytes]] = [[] for _ in range(len(data))]
        for end, token in self.automaton.iter(data.decode("latin-1")):
            at[end + 1 - len(token)].append(token)  # by rising length
        chosen: list[tuple[bytes, int]] = []  # token, and how many shorter ones are left at its place
        dead, place, left = bytearray(len(data) + 1), 0, len(at[0])
        while place < len(data):
            before = chosen[-1][0] if chosen else b""
            while left:
                left -= 1
                token = at[place][left]
                if not dead[place + len(token)] and self.compatible(b"", token) and (not before or self.compatible(before, token)):
                    chosen.append((token, left))
                    place += len(token)
                    left = len(at[place]) if place < len(data) else 0
                    break
            else:
                dead[place] = 1
                token, left = chosen.pop()
                place -= len(token)
        return [self.ranks[token] for token, _ in chosen]

    def encode_strings(self, strings: list[str]) -> list[bytes]:
        out = []
        for text in strings:
            ids: list[int] = []
            for piece in self.split.findall(text):
                ids += self.encode_piece(piece.encode())
            out.append(np.array(ids, "<u4").tobytes())
        return out

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


@kept_between_tasks
@lru_cache(maxsize=2)
def load(path: str, pattern: str = PATTERN) -> tuple[ByteBpe, StretchCache]:
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    bpe = ByteBpe(ranks, pattern)
    return bpe, StretchCache(bpe.encode_strings)


def encoded(docs: DataFrame, path: str = RANKS, pattern: str = PATTERN, id_column: str = "doc_id",
            text_column: str = "text", with_ids: bool = True) -> DataFrame:
    """``doc_id, ids, n_tokens, ids_sha256, decoded_sha256`` of each document; ``ids`` only ``with_ids``."""

    def run(batches):
        bpe, cache = load(path, pattern)
        for batch in batches:
            rows, texts = batch.column("doc_id"), batch.column("text").to_pylist()
            for first, last in batches_of_texts(texts):
                packed = cache.encode_texts(texts[first:last])
                lists = [np.frombuffer(p, "<u4").tolist() for p in packed]
                columns = [rows.slice(first, last - first), pa.array([len(x) for x in lists], pa.int64()),
                           pa.array([hashlib.sha256(p).hexdigest() for p in packed]),
                           pa.array([hashlib.sha256(bpe.decode(x)).hexdigest() for x in lists])]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if with_ids:
                    columns.append(pa.array(lists, pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names)

    texts = docs.select(docs[id_column].cast("long").alias("doc_id"), whole_text(docs, text_column).alias("text"))
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return map_arrow(texts, run, schema, uses_kept=True)
