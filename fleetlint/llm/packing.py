"""Vector best-fit packing of documents into training sequences.

Each sequence has three capacities: tokens, documents, and attention cost (the sum of
squared piece lengths). Pieces are taken by falling length; each goes to the open sequence
that has room under every capacity and scores best, by the smallest weighted norm of what
is left (``residual``) or the largest weighted product of demand and room (``dot``).

Groups of ``GROUP_ROWS`` pieces are dealt by hash and packed independently. The pieces of the
sequences that stay under ``FULL`` are then dealt and packed again, so the number of poorly
filled sequences depends on the last round only, not on the number of groups.

Defined results: a null text is empty; each document ends with the end id, so an empty one is
one token; a document longer than a sequence is cut into full pieces, of which only the
first may be shorter; equal or repeated rows are pieces of their own; an empty table gives
none; further columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlint.llm.tables import map_arrow, map_groups, whole_text
from fleetlint.llm.tokens import batches_of_texts, library_encoder
from fleetlint.plans.storage import materialise

#: Tokens and documents of a sequence; attention cost is bounded by tokens squared unless given.
TOKENS, DOCUMENTS = 2048, 2048
#: Weights of tokens, documents and attention cost in the score.
WEIGHTS = (1.0, 0.001, 0.001)
#: Pieces packed by one call, fill under which a sequence is packed again, and rounds of that.
GROUP_ROWS, FULL, ROUNDS = 8192, 0.97, 2
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
END_ID = 0


def token_pieces(docs: DataFrame, tokenizer: str = TOKENIZER, tokens: int = TOKENS, end_id: int = END_ID,
                 id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` of each piece of each document."""

    def run(batches):
        encoder, _ = library_encoder(tokenizer)
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            ids, texts = batch.column("doc_id"), batch.column("text").to_pylist()
            for first, last in batches_of_texts(texts):
                rows, piece, start, length, crc = [], [], [], [], []
                for i, data in enumerate(encoder.encode_texts(texts[first:last]), first):
                    data += end
                    n = len(data) // 4
                    at, k = 0, 0
                    while at < n:
                        to = min(n, at + ((n - 1) % tokens + 1 if k == 0 else tokens))
                        rows.append(i), piece.append(k), start.append(at), length.append(to - at)
                        crc.append(zlib.crc32(memoryview(data)[4 * at:4 * to]))
                        at, k = to, k + 1
                yield pa.RecordBatch.from_arrays([
                    ids.take(pa.array(rows)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                    pa.array(length, pa.int64()), pa.array(crc, pa.int64())], ["doc_id", "piece", "start", "length", "ids_crc32"])

    texts = docs.select(docs[id_column].cast("long").alias("doc_id"), whole_text(docs, text_column).alias("text"))
    return map_arrow(texts, run, "doc_id long, piece int, start long, length long, ids_crc32 long", uses_kept=True)


def best_fit(lengths: np.ndarray, tokens: int, documents: int, cost: float, weights: tuple = WEIGHTS,
             score: str = "residual") -> np.ndarray:
    """Number of the sequence of each piece; ``lengths`` are at most ``tokens``."""
    capacity = np.array([tokens, documents, cost], float)
    scale = np.array(weights) / capacity ** 2
    order = np.argsort(-lengths, kind="stable")
    smallest = lengths.min() if len(lengths) else 0
    place = np.empty(len(lengths), np.int64)
    room, names, used, opened = np.empty((1024, 3)), np.empty(1024, np.int64), 0, 0
    for item in order:
        need = np.array([lengths[item], 1, float(lengths[item]) ** 2])
        left = room[:used] - need
        fits = (left >= 0).all(1)
        if fits.any():
            points = -(left * left) @ scale if score == "residual" else (room[:used] * need) @ scale
            k = int(np.argmax(np.where(fits, points, -np.inf)))
        else:
            if used == len(room):
                room, names = np.concatenate([room, np.empty_like(room)]), np.concatenate([names, np.empty_like(names)])
            k, names[used], room[used] = used, opened, capacity
            used, opened = used + 1, opened + 1
        place[item] = names[k]
        room[k] -= need
        if room[k, 0] < smallest or room[k, 1] < 1:  # nothing fits any more
            used -= 1
            room[k], names[k] = room[used], names[used]
    return place


def _packed(pieces: DataFrame, round_: int, tokens: int, documents: int, cost: float, weights: tuple, score: str) -> DataFrame:
    n = pieces.count()
    groups = max(1, -(-n // GROUP_ROWS))

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("doc_id", "ascending"), ("piece", "ascending"), ("ids_crc32", "ascending")])
        lengths = table.column("length").to_numpy()
        place = best_fit(lengths, tokens, documents, cost, weights, score)
        order = np.argsort(place, kind="stable")
        totals = np.cumsum(lengths[order]) - lengths[order]
        firsts = np.searchsorted(place[order], place[order], "left")
        offset = np.empty(len(place), np.int64)
        offset[order] = totals - totals[firsts]
        fill = np.bincount(place, lengths)[place] / tokens
        group = table.column("group")[0].as_py()
        return table.drop_columns(["group"]).append_column(
            "sequence_id", pa.array(place + (round_ << 56) + (group << 24))).append_column(
            "offset", pa.array(offset)).append_column("fill", pa.array(fill))

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long, fill double"
    dealt = pieces.withColumn("group", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(groups)))
    return materialise(map_groups(dealt, ["group"], run, schema), f"packed-{round_}")


def pack(pieces: DataFrame, tokens: int = TOKENS, documents: int = DOCUMENTS, cost: float | None = None,
         weights: tuple = WEIGHTS, score: str = "residual") -> DataFrame:
    """The pieces with ``sequence_id`` and ``offset``. Each piece fits an empty sequence alone."""
    cost = float(tokens) ** 2 if cost is None else cost
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    done, rest = None, pieces.select(*columns)
    for round_ in range(ROUNDS + 1):
        packed = _packed(rest, round_, tokens, documents, cost, weights, score)
        good = packed if round_ == ROUNDS else packed.where(F.col("fill") >= FULL)
        done = good if done is None else done.unionByName(good)
        rest = packed.where(F.col("fill") < FULL).select(*columns)
    return done.drop("fill")


def pack_documents(docs: DataFrame, tokenizer: str = TOKENIZER, tokens: int = TOKENS, documents: int = DOCUMENTS,
                   cost: float | None = None, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Tokenize, cut and pack."""
    pieces = materialise(token_pieces(docs, tokenizer, tokens, END_ID, id_column, text_column), "token-pieces")
    return pack(pieces, tokens, documents, cost)
