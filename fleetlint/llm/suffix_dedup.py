"""Repeated byte strings by suffix order: longest previous (and next) factors of a corpus.

Every byte covered by a string of ``length`` bytes that also starts anywhere else is
removed, or, with ``keep_first``, all but the first such string in (id, place) order.

No suffix array of a whole corpus is made. A window of ``length`` bytes is keyed by the
smallest hash among its 64-byte grams, which depends on the window's bytes alone, so equal
windows have equal keys. Neighbouring windows share a key, which makes runs of about 170
windows:

1. runs are counted by key (sums with partial aggregation); a window whose key occurs once
   occurs once;
2. of the rest, runs with equal bytes are one piece, however many copies there are;
3. the distinct pieces of a key meet in one task, in batches of whole keys, where the
   suffixes that begin a window are sorted (prefix doubling up to ``length`` bytes). In suffix
   order, with equal ones in text order, the previous smaller position of a suffix gives
   its longest earlier match and the next larger one its longest later match, cut at
   ``length``;
4. a key with more than ``HOT_PIECES`` distinct pieces is dealt out further: its windows are
   counted by the hash of their bytes, with partial sums, so no task holds it;
5. matched windows become byte ranges of documents.

Matches never cross documents. Keys, pieces and hot windows are named by 64-bit hashes, pieces
and hot windows only within one key.

Defined results: null is empty; texts shorter than ``length`` are kept; equal rows are two
documents, whose texts repeat each other; a null id is an id like others; further columns
are ignored. Cuts may fall inside a character, so what is kept is bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlint.llm.tables import map_arrow, shuffle_partitions, whole_text
from fleetlint.llm.words import mix, span_hashes, steps, text_buffers
from fleetlint.plans.storage import materialise

#: Bytes of a gram (a power of two), distinct pieces of a key that one task may sort, bytes sorted at once.
GRAM, HOT_PIECES, BATCH_BYTES = 64, 20_000, 1_000_000
_RANGES = "array<struct<from:int,to:int>>"


def _sliding(values: np.ndarray, width: int, least: bool) -> np.ndarray:
    """Smallest (or largest) of each ``width`` values in a row."""
    pick, size = (np.minimum if least else np.maximum), 1
    while size * 2 <= width:
        values = pick(values[:-size], values[size:])
        size *= 2
    return pick(values[:len(values) - (width - size)], values[width - size:]) if width > size else values


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """Hash of the ``GRAM`` bytes from each place on."""
    values, size = mix(data.astype(np.uint64) + np.uint64(1)), 1
    while size < GRAM:
        values = values[:-size] * np.uint64(pow(0xD6E8FEB86659FD93, size, 2**64)) + values[size:]
        size *= 2
    return mix(values)


def runs(data: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Rows, starts, numbers of windows, keys, weights and piece hashes of the runs of some texts.

    ``ends`` are the row offsets. The weight counts the places of the key's gram, so one run
    of a periodic text weighs more than 1.
    """
    none = tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, np.int64, np.uint64))
    width = length - GRAM + 1
    if len(data) < length:
        return none
    grams = gram_hashes(data)
    keys = _sliding(grams, width, True)  # one for each window of the buffer
    row_of = np.repeat(np.arange(len(ends) - 1), np.diff(ends))[:len(keys)]
    valid = np.arange(len(keys)) + length <= ends[row_of + 1]
    change = np.ones(len(keys), bool)
    change[1:] = (keys[1:] != keys[:-1]) | (row_of[1:] != row_of[:-1]) | (valid[1:] != valid[:-1])
    starts = np.flatnonzero(change)
    counts = np.diff(np.append(starts, len(keys)))
    starts, counts = starts[valid[starts]], counts[valid[starts]]
    if not len(starts):
        return none
    key = keys[starts]
    padded = np.zeros(len(grams) + width - 1, np.uint64)
    padded[width - 1:width - 1 + len(keys)] = np.where(valid, keys, 0)
    at = np.flatnonzero(_sliding(padded, width, False)[:len(grams)] == grams)  # grams that are the least of some window
    names, name_of = np.unique(key, return_inverse=True)
    found = np.minimum(np.searchsorted(names, grams[at]), len(names) - 1)
    here = names[found] == grams[at]
    span = np.int64(len(data) + 1)
    marks = np.sort(found[here] * span + at[here])
    weights = (np.searchsorted(marks, name_of * span + starts + counts - 1 + width - 1, "right")
               - np.searchsorted(marks, name_of * span + starts, "left"))
    pieces = span_hashes(data, starts, starts + counts - 1 + length)
    return row_of[starts], starts - ends[row_of[starts]], counts, key, weights, pieces


def run_table(docs: DataFrame, length: int) -> DataFrame:
    """``doc_id, text_key, start, windows, key, weight, piece`` of each run. ``docs`` has ``doc_id, text_key, text``."""

    def run(batches):
        for batch in batches:
            data, offsets = text_buffers(batch.column("text"))
            for first, last in steps(offsets, BATCH_BYTES):
                base = offsets[first]
                row, start, count, key, weight, piece = runs(
                    data[base:offsets[last]], offsets[first:last + 1] - base, length)
                rows = pa.array(row + first)
                yield pa.RecordBatch.from_arrays([
                    batch.column("doc_id").take(rows), batch.column("text_key").take(rows), pa.array(start.astype(np.int32)),
                    pa.array(count.astype(np.int32)), pa.array(key.view(np.int64)), pa.array(weight.astype(np.int32)),
                    pa.array(piece.view(np.int64))], ["doc_id", "text_key", "start", "windows", "key", "weight", "piece"])

    return map_arrow(docs, run, "doc_id long, text_key long, start int, windows int, key long, weight int, piece long")


def cut_pieces(docs: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """The bytes of wanted pieces: ``key, piece, copies, place, bytes``, in any order.

    ``wanted`` has ``key, piece, copies, doc_id, text_key, start, windows``.
    """
    per = wanted.groupBy(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key")).agg(
        F.collect_list(F.struct("key", "piece", "copies", "start", "windows")).alias("pieces"))
    joined = docs.join(per, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_key") == F.col("_key")))
    return joined.withColumn("p", F.explode("pieces")).select(
        "p.key", "p.piece", "p.copies", "doc_id", "p.start",
        F.expr(f"substring(encode(text, 'UTF-8'), p.start + 1, p.windows + {length - 1})").alias("bytes"))


def suffix_order(data: np.ndarray, length: int) -> np.ndarray:
    """Rank of the ``length`` bytes from each place on; equal strings have equal ranks."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    first = np.zeros(len(data), np.uint64)
    for k in range(8):
        first = (first << np.uint64(8)) | padded[k:k + len(data)].astype(np.uint64)
    ranks, size = np.unique(first, return_inverse=True)[1].astype(np.int64), 8
    while size < length:
        shift = min(size, length - size)
        behind = np.zeros(len(ranks), np.int64)
        behind[:len(ranks) - shift] = ranks[shift:] + 1
        ranks = np.unique(ranks * np.int64(len(ranks) + 1) + behind, return_inverse=True)[1].astype(np.int64)
        size += shift
    return ranks


def factors(ranks: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each suffix at ``places`` (ascending) has an earlier and a later match of full length.

    Suffixes are put in suffix order, equal ones by place; there the previous smaller place of
    a suffix is the entry before it exactly if that has the same rank, and likewise the
    next larger one behind it.
    """
    order = np.lexsort((places, ranks[places]))
    sorted_ranks = ranks[places][order]
    same = sorted_ranks[1:] == sorted_ranks[:-1]
    earlier, later = np.zeros(len(places), bool), np.zeros(len(places), bool)
    earlier[order[1:]], later[order[:-1]] = same, same
    return earlier, later


def _ranges(flags: np.ndarray, length: int) -> list[dict]:
    """Byte ranges covered by the windows that are set."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return [{"from": int(a), "to": int(b) - 1 + length} for a, b in zip(edge[::2], edge[1::2], strict=True)]


def sorted_pieces(pieces: DataFrame, length: int, keep_first: bool) -> DataFrame:
    """``key, piece, ranges`` of distinct pieces: byte ranges that another window repeats."""

    def solve(group: list[tuple]) -> pa.RecordBatch:
        group.sort(key=lambda p: (p[3] is not None, p[3] or 0, p[4]))  # text order
        data = np.frombuffer(b"".join(p[5] for p in group), np.uint8)
        offsets = np.concatenate([[0], np.cumsum([len(p[5]) for p in group])])
        places = np.concatenate([np.arange(a, b - length + 1) for a, b in zip(offsets[:-1], offsets[1:], strict=True)])
        earlier, later = factors(suffix_order(data, length), places)
        flags = earlier if keep_first else earlier | later
        cuts, at = [], 0
        for p in group:
            n = len(p[5]) - length + 1
            cuts.append(_ranges(flags[at:at + n], length))
            at += n
        return pa.RecordBatch.from_arrays([
            pa.array([p[0] for p in group], pa.int64()), pa.array([p[1] for p in group], pa.int64()),
            pa.array(cuts, pa.list_(pa.struct([("from", pa.int32()), ("to", pa.int32())])))], ["key", "piece", "ranges"])

    def whole_keys(batches) -> Iterator[list[tuple]]:
        group, size = [], 0
        for batch in batches:
            for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if size >= BATCH_BYTES and row[0] != group[-1][0]:
                    yield group
                    group, size = [], 0
                group.append(row)
                size += len(row[5])
        if group:
            yield group

    def run(batches):
        for group in whole_keys(batches):
            yield solve(group)

    ordered = pieces.repartition(shuffle_partitions(pieces.sparkSession), "key").sortWithinPartitions("key")
    return map_arrow(ordered, run, f"key long, piece long, ranges {_RANGES}")


def hot_pieces(pieces: DataFrame, length: int, keep_first: bool) -> DataFrame:
    """The same for keys with very many distinct pieces, whose windows are counted one by one."""

    def explode(batches):
        for batch in batches:
            for key, piece, _, doc, start, data in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                values = np.frombuffer(data, np.uint8)
                at = np.arange(len(values) - length + 1)
                hashes = span_hashes(values, at, at + length).view(np.int64)
                n = len(at)
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(n, key)), pa.array(np.full(n, piece)), pa.array([doc] * n, pa.int64()),
                    pa.array(at.astype(np.int32) + start, pa.int32()), pa.array(at.astype(np.int32)), pa.array(hashes)],
                    ["key", "piece", "doc_id", "start", "at", "window"])

    rows = materialise(map_arrow(pieces, explode, "key long, piece long, doc_id long, start int, at int, window long"), "hot-windows")
    seen = rows.groupBy("key", "window").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "start")).alias("first")).where("n > 1")
    found = rows.join(seen, ["key", "window"])
    if keep_first:
        found = found.where(~F.struct("doc_id", "start").eqNullSafe(F.col("first")))
    return found.groupBy("key", "piece").agg(F.collect_list(
        F.struct(F.col("at").alias("from"), (F.col("at") + length).alias("to"))).cast(_RANGES).alias("ranges"))


def repeats(docs: DataFrame, length: int = 400, keep_first: bool = False, id_column: str = "doc_id",
            text_column: str = "text", hot: int = HOT_PIECES) -> DataFrame:
    """Per document with repeated bytes: ``doc_id, text_key`` and its ``ranges``, unmerged and in any order."""
    texts = docs.select(docs[id_column].cast("long").alias("doc_id"), whole_text(docs, text_column).alias("text"))
    texts = texts.withColumn("text_key", F.xxhash64("text"))
    all_runs = materialise(run_table(texts, length), "runs")
    keys = all_runs.groupBy("key").agg(F.sum("weight").alias("n")).where("n > 1").select("key")
    shared = materialise(all_runs.join(keys, "key"), "shared-runs")
    pieces = shared.groupBy("key", "piece").agg(
        F.count("*").alias("copies"), F.min(F.struct("doc_id", "text_key", "start", "windows")).alias("at"))
    pieces = materialise(pieces.select("key", "piece", "copies", "at.*"), "pieces")
    # a key all of whose pieces have copies needs no sorting, unless only the first may stay
    per_key = pieces.groupBy("key").agg(F.count("*").alias("n"), F.min("copies").alias("least"))
    sortable = per_key if keep_first else per_key.where("least = 1")
    wanted = pieces.join(sortable.select("key", "n"), "key")
    bytes_ = materialise(cut_pieces(
        texts, wanted.select("key", "piece", "copies", "doc_id", "text_key", "start", "windows"), length).dropDuplicates(["key", "piece"]),
        "piece-bytes")
    hot_keys = per_key.where(F.col("n") > hot).select("key")
    found = sorted_pieces(bytes_.join(hot_keys, "key", "left_anti"), length, keep_first)
    many = materialise(bytes_.join(hot_keys, "key"), "hot-pieces")
    if not many.isEmpty():
        found = found.unionByName(hot_pieces(many, length, keep_first))
    whole = F.array(F.struct(F.lit(0).alias("from"), (F.col("windows") - 1 + length).alias("to"))).cast(_RANGES)
    decided = materialise(pieces.join(found, ["key", "piece"], "left").select(
        "key", "piece", F.col("copies") > 1, "doc_id", "text_key", "start", "ranges").toDF(
        "key", "piece", "copied", "first_id", "first_key", "first_start", "ranges"), "decided-pieces")
    is_first = F.struct("doc_id", "text_key", "start").eqNullSafe(F.struct("first_id", "first_key", "first_start"))
    all_of_it = F.col("copied") & (~is_first if keep_first else F.lit(True))
    hits = shared.join(decided, ["key", "piece"]).select(
        "doc_id", "text_key", F.explode(F.when(all_of_it, whole).otherwise(F.col("ranges"))).alias("r"), "start")
    return hits.groupBy("doc_id", "text_key").agg(F.collect_set(F.struct(
        (F.col("start") + F.col("r.from")).alias("from"), (F.col("start") + F.col("r.to")).alias("to"))).alias("ranges"))


def without_repeats(docs: DataFrame, length: int = 400, keep_first: bool = False, id_column: str = "doc_id",
                    text_column: str = "text", hot: int = HOT_PIECES) -> DataFrame:
    """Per document: ``doc_id, n_bytes, n_removed, n_spans, kept`` (the remaining bytes)."""
    found = repeats(docs, length, keep_first, id_column, text_column, hot).toDF("_id", "_key", "ranges")
    texts = docs.select(docs[id_column].cast("long").alias("doc_id"), whole_text(docs, text_column).alias("text"))
    joined = texts.join(found, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.xxhash64("text") == F.col("_key")), "left")

    def run(batches):
        for batch in batches:
            kept, removed, spans, sizes = [], [], [], []
            for text, ranges in zip(batch.column("text").to_pylist(), batch.column("ranges").to_pylist(), strict=True):
                data, out, at, n, gone = text.encode(), [], 0, 0, -1
                for r in sorted(ranges or [], key=lambda r: r["from"]):
                    if r["from"] > gone:
                        n += 1
                        out.append(data[at:r["from"]])
                    gone = at = max(at, r["to"])
                out.append(data[at:])
                kept.append(b"".join(out))
                spans.append(n)
                sizes.append(len(data))
                removed.append(len(data) - len(kept[-1]))
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), *[pa.array(x, pa.int64()) for x in (sizes, removed, spans)], pa.array(kept, pa.binary())],
                ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    return map_arrow(joined.select("doc_id", "text", "ranges"), run,
                     "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")
