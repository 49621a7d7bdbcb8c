"""Near duplicates by SetSketch registers: banded candidates, joint likelihood, exact check.

A document is the set of its distinct word shingles. Register ``i`` of its sketch is the
minimum, over the set, of exponentially distributed values, truncated to exponentially
spaced steps (base ``b``): ``K_i = floor(1 - log_b(min))``, kept within 16 bits. Registers
of a union are the maxima of both (``merge``), and two registers agree with about the
Jaccard likeness, so bands of registers make buckets.

Equal sets are one class first. Within a bucket classes are compared with one pivot, not
with each other; links join classes to components, and only members of a bucket that are
still in different components are compared further, first with a new pivot, at last block by
block with all that their buckets join, on full sets. A pair with a pivot passes a joint estimate (likelihood of the numbers of larger, smaller
and equal registers, given both set sizes, which are known) with a margin of ``MARGIN``
standard deviations, then the exact test on full sets: ``100 * |A & B| >= 80 * |A | B|``.

A link at exactly 0.8 shares no band with probability ``(1 - 0.8^4)^32 = 5e-8``; no bucket
or candidate is capped.

Defined results: A-Z are lower-cased; words are runs without ``[ \\t-\\r]``; fewer words than a
shingle are one shingle; null and empty texts have no shingles, link with nothing and are
kept; rows with a null id are in no group of others; rows that repeat an id share its
component; further columns are ignored by ``groups`` and carried by ``deduplicate``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlint.llm.components import components
from fleetlint.llm.tables import map_arrow, map_groups, whole_text
from fleetlint.llm.words import mix, shingle_sets, steps, text_buffers, word_hashes
from fleetlint.plans.storage import materialise

#: Sketch: registers, base and rate of the exponential values, largest register.
REGISTERS, BASE, RATE, LARGEST = 128, 1.001, 20.0, 2**16 - 1
#: Registers of a band; standard deviations that an estimate may lie below the threshold.
BAND, MARGIN = 4, 6.0
#: Rounds in which the rest of a bucket meets a new pivot, before what is left is compared in blocks.
PIVOT_ROUNDS = 1
#: Documents of a block, and shingles that are compared at once.
BLOCK_ROWS, STRIPE = 256, 8192
_RNG = np.random.default_rng(77)
_FACTORS = _RNG.integers(0, 2**63, REGISTERS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SHIFTS = _RNG.integers(0, 2**63, REGISTERS, dtype=np.uint64)


def sketches(sets: list[np.ndarray]) -> np.ndarray:
    """Registers of non-empty sets of 64-bit hashes, one row per set."""
    flat = np.concatenate(sets)
    starts = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]])
    least = np.empty((len(sets), REGISTERS), np.uint64)
    values = np.empty_like(flat)
    for j in range(REGISTERS):
        np.multiply(flat, _FACTORS[j], out=values)
        np.add(values, _SHIFTS[j], out=values)
        least[:, j] = np.minimum.reduceat(values, starts)
    uniform = (least.astype(np.float64) + 0.5) / 2.0**64
    steps_below = np.floor(1 - np.log(-np.log1p(-uniform) / RATE) / np.log(BASE))
    return np.clip(steps_below, 0, LARGEST).astype(np.uint16)


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Registers of the union."""
    return np.maximum(a, b)


def _agree(x: np.ndarray) -> np.ndarray:
    return -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)


def joint_estimate(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Most likely Jaccard likeness of pairs of sketches with known set sizes (rows are pairs)."""
    above, below = (a > b).sum(1)[:, None], (a < b).sum(1)[:, None]
    equal = a.shape[1] - above - below
    u = (n_a / (n_a + n_b))[:, None]
    v = 1 - u
    grid = np.linspace(0, 1, 201)[None, :] * np.minimum(u / v, v / u)
    p_above, p_below = _agree(u - v * grid), _agree(v - u * grid)
    with np.errstate(divide="ignore", invalid="ignore"):
        score = sum(np.where(k > 0, k * np.log(p), 0.0) for k, p in (
            (above, p_above), (below, p_below), (equal, np.clip(1 - p_above - p_below, 0, 1))))
    return np.take_along_axis(grid, np.nanargmax(score, 1)[:, None], 1)[:, 0]


def _sets(batch: pa.RecordBatch, n: int) -> Iterator[tuple[int, int, list[np.ndarray]]]:
    data, offsets = text_buffers(batch.column("text"))
    for first, last in steps(offsets):
        hashes, counts = word_hashes(data, offsets[first:last + 1])
        yield first, last, shingle_sets(hashes, counts, n)


def sketch_table(docs: DataFrame, words: int) -> DataFrame:
    """``doc_id, n_shingles, set_key, registers, bands`` of each document; the last two null for empty sets."""

    def run(batches):
        places = np.arange(REGISTERS // BAND, dtype=np.uint64)
        for batch in batches:
            for first, last, sets in _sets(batch, words):
                full = [i for i, s in enumerate(sets) if len(s)]
                keys, registers, bands = ([None] * len(sets) for _ in range(3))
                if full:
                    rows = sketches([sets[i] for i in full])
                    hashed = places[None, :] + np.uint64(1)
                    for k in range(BAND):
                        hashed = mix(hashed * np.uint64(0x9E3779B97F4A7C15) + rows[:, k::BAND].astype(np.uint64))
                    hashed = hashed.view(np.int64)
                    for k, i in enumerate(full):
                        keys[i] = hashlib.blake2b(sets[i].tobytes(), digest_size=16).digest()
                        registers[i], bands[i] = rows[k].tobytes(), hashed[k]
                yield pa.RecordBatch.from_arrays([
                    batch.column("doc_id").slice(first, last - first), pa.array([len(s) for s in sets], pa.int64()),
                    pa.array(keys, pa.binary()), pa.array(registers, pa.binary()), pa.array(bands, pa.list_(pa.int64())),
                ], ["doc_id", "n_shingles", "set_key", "registers", "bands"])

    return map_arrow(docs, run, "doc_id long, n_shingles long, set_key binary, registers binary, bands array<long>")


def set_table(docs: DataFrame, words: int) -> DataFrame:
    """``doc_id, hashes`` of each document."""

    def run(batches):
        for batch in batches:
            for first, last, sets in _sets(batch, words):
                yield pa.RecordBatch.from_arrays([
                    batch.column("doc_id").slice(first, last - first),
                    pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], ["doc_id", "hashes"])

    return map_arrow(docs, run, "doc_id long, hashes array<long>")


def likely(pairs: DataFrame, classes: DataFrame, threshold: float) -> DataFrame:
    """The pairs ``(a, b)`` whose sizes allow the threshold and whose joint estimate is not far below it."""
    side = classes.select("doc_id", "n_shingles", "registers")
    both = pairs.join(side.toDF("a", "n_a", "r_a"), "a").join(side.toDF("b", "n_b", "r_b"), "b").where(
        F.least("n_a", "n_b") >= F.greatest("n_a", "n_b") * threshold)

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(-1, REGISTERS) for c in ("r_a", "r_b"))
            n_a, n_b = (batch.column(c).to_numpy(zero_copy_only=False).astype(float) for c in ("n_a", "n_b"))
            for i in range(0, len(a), 2000):
                k = slice(i, i + 2000)
                found = joint_estimate(a[k], b[k], n_a[k], n_b[k])
                slack = MARGIN * np.sqrt(threshold * (1 - threshold) / REGISTERS)
                keep = pa.array(found + slack >= threshold)
                yield batch.slice(i, len(found)).select(["a", "b"]).filter(keep)

    return map_arrow(both.select("a", "b", "n_a", "n_b", "r_a", "r_b"), run, "a long, b long")


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose full sets reach the threshold."""
    side_a, side_b = sets.toDF("a", "set_a"), sets.toDF("b", "set_b")
    both = pairs.join(side_a, "a").join(side_b, "b").withColumn("common", F.size(F.array_intersect("set_a", "set_b")))
    union = F.size("set_a") + F.size("set_b") - F.col("common")
    return both.where(F.col("common") * 100 >= union * percent).select("a", "b")


def block_links(members: DataFrame, labels: DataFrame, sets: DataFrame, percent: int, rows: int = BLOCK_ROWS) -> DataFrame:
    """Links ``(a, b)`` between components that share a cluster of buckets, by exact comparison in blocks.

    A cluster is what buckets join without any check, so it holds each pair of one bucket. Its
    largest component is linked already; every other document is compared with the whole
    cluster, block by block, so rows grow with documents times blocks and no pair is a row.
    One link is returned per document and foreign component of a block.
    """
    pivots = members.groupBy("band").agg(F.min("doc_id").alias("p"))
    loose = components(members.join(pivots, "band").select(F.col("doc_id").alias("a"), F.col("p").alias("b")), "clusters")
    nodes = members.select("doc_id").distinct().join(loose.toDF("doc_id", "cluster"), "doc_id", "left").join(
        labels.toDF("doc_id", "component"), "doc_id", "left").select(
        "doc_id", F.coalesce("cluster", "doc_id").alias("cluster"), F.coalesce("component", "doc_id").alias("component"))
    nodes = materialise(nodes, "cluster-nodes")
    sizes = nodes.groupBy("cluster", "component").agg(F.count("*").alias("n"))
    per = sizes.groupBy("cluster").agg(
        F.max(F.struct("n", "component")).alias("largest"), F.sum("n").alias("total"), F.count("*").alias("parts")).where("parts > 1")
    per = per.select("cluster", F.col("largest.component").alias("main"),
                     F.ceil((F.col("total") - F.col("largest.n")) / rows).alias("n_side"), F.ceil(F.col("largest.n") / rows).alias("n_main"))
    placed = nodes.join(per, "cluster").withColumn("is_main", F.col("component") == F.col("main")).withColumn(
        "block", F.pmod(F.xxhash64("doc_id"), F.when(F.col("is_main"), F.col("n_main")).otherwise(F.col("n_side"))))

    def upto(n: Column, make: Callable[[Column], Column]) -> Column:
        return F.transform(F.sequence(F.lit(0).cast("bigint"), n - 1), make)

    def tile(row: Column, kind: int, column: Column, left: Column) -> Column:
        return F.struct(row.alias("row"), F.lit(kind).alias("kind"), column.alias("column"), left.alias("left"))

    block = F.col("block")
    of_side = F.concat(
        upto(F.col("n_side"), lambda j: tile(F.least(block, j), 0, F.greatest(block, j), block <= j)),
        upto(F.col("n_main"), lambda j: tile(block, 1, j, F.lit(True))))
    tiles = F.when(F.col("is_main"), upto(F.col("n_side"), lambda i: tile(i, 1, block, F.lit(False)))).otherwise(of_side)
    spread = placed.join(sets, "doc_id").select("cluster", "doc_id", "component", "hashes", F.explode(tiles).alias("t")).select(
        "cluster", "t.*", "doc_id", "component", "hashes")

    def run(table: pa.Table) -> pa.Table:
        ids, parts = (table.column(c).to_numpy() for c in ("doc_id", "component"))
        left = table.column("left").to_numpy(zero_copy_only=False).astype(bool)
        hashes = table.column("hashes").combine_chunks()
        hashes = hashes.combine_chunks() if isinstance(hashes, pa.ChunkedArray) else hashes
        counts = np.diff(hashes.offsets.to_numpy())
        owner = np.repeat(np.arange(len(ids)), counts)
        names, place, times = np.unique(hashes.flatten().to_numpy(), return_inverse=True, return_counts=True)
        shared = times[place] > 1
        owner, place = owner[shared], (np.cumsum(times > 1) - 1)[place[shared]]
        rows_, columns = (np.flatnonzero(left), np.flatnonzero(~left)) if not left.all() else (np.arange(len(ids)),) * 2
        common = np.zeros((len(rows_), len(columns)), np.float32)
        order = np.argsort(place, kind="stable")
        owner, place = owner[order], place[order]
        for low in range(0, int(place[-1]) + 1 if len(place) else 0, STRIPE):
            a, b = np.searchsorted(place, [low, low + STRIPE])
            has = np.zeros((len(ids), STRIPE), np.float32)
            has[owner[a:b], place[a:b] - low] = 1
            common += has[rows_] @ has[columns].T
        union = counts[rows_][:, None] + counts[columns][None, :] - common
        linked = (common * 100 >= union * percent) & (parts[rows_][:, None] != parts[columns][None, :])
        i, j = np.nonzero(linked)
        _, once = np.unique(np.stack([ids[rows_[i]], parts[columns[j]]]), axis=1, return_index=True)
        return pa.table({"a": ids[rows_[i[once]]], "b": ids[columns[j[once]]]})

    return materialise(map_groups(spread, ["cluster", "row", "kind", "column"], run, "a long, b long"), "block-links")


def links(docs: DataFrame, classes: DataFrame, words: int, percent: int) -> DataFrame:
    """``(node, component)`` of the classes that join a smaller one. ``docs`` has ``doc_id, text``."""
    threshold = percent / 100
    bands = materialise(
        classes.select("doc_id", F.explode("bands").alias("band")), "bands")
    shared = bands.groupBy("band").agg(F.count("*").alias("n")).where("n > 1").select("band")
    members = materialise(bands.join(shared, "band"), "band-members")
    involved = members.select("doc_id").distinct()
    sets = materialise(set_table(docs.join(involved, "doc_id", "left_semi"), words).dropDuplicates(["doc_id"]), "shingle-sets")
    classes = classes.select("doc_id", "n_shingles", "registers")

    def confirm(pairs: DataFrame) -> DataFrame:
        return materialise(verified(likely(pairs, classes, threshold), sets, percent), "links")

    def against_pivots(rows: DataFrame, order: Callable[[Column], Column]) -> DataFrame:
        pivots = rows.groupBy("band").agg(F.min(F.struct(order(F.col("doc_id")).alias("o"), "doc_id", "component")).alias("p"))
        joined = rows.join(pivots, "band").where((F.col("component") != F.col("p.component")) & (F.col("doc_id") != F.col("p.doc_id")))
        return joined.select(F.least("doc_id", "p.doc_id").alias("a"), F.greatest("doc_id", "p.doc_id").alias("b")).distinct()

    def open_buckets(labels: DataFrame | None) -> DataFrame:
        """Rows of buckets that still hold more than one component."""
        rows = members.withColumn("component", F.col("doc_id"))
        if labels is None:
            return rows
        rows = members.join(labels, members["doc_id"] == labels["node"], "left").select(
            "band", "doc_id", F.coalesce("component", "doc_id").alias("component"))
        split = rows.groupBy("band").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x != y").select("band")
        return materialise(rows.join(split, "band"), "open-buckets")

    labels = components(confirm(against_pivots(open_buckets(None), lambda c: c)))
    for k in range(PIVOT_ROUNDS):
        rest = open_buckets(labels)
        more = confirm(against_pivots(rest, lambda c: F.xxhash64(c, F.lit(k))))
        if more.isEmpty():
            continue
        labels = components(labels.toDF("a", "b").union(more))
    more = block_links(members, labels, sets, percent)
    return labels if more.isEmpty() else components(labels.toDF("a", "b").union(more))


def groups(docs: DataFrame, words: int = 5, percent: int = 80, id_column: str = "doc_id",
           text_column: str = "text") -> DataFrame:
    """Per document: ``doc_id, n_shingles, component_id, kept``."""
    docs = docs.select(docs[id_column].cast("long").alias("doc_id"), whole_text(docs, text_column).alias("text"))
    rows = materialise(sketch_table(docs, words), "sketches")
    keyed = rows.where(F.col("set_key").isNotNull() & F.col("doc_id").isNotNull())
    heads = materialise(keyed.groupBy("set_key").agg(F.min("doc_id").alias("class_id")), "set-classes")
    classes = rows.join(heads.select(F.col("class_id").alias("doc_id"), "set_key"), ["doc_id", "set_key"]).dropDuplicates(["doc_id"])
    labels = links(docs, classes, words, percent)
    heads = heads.join(labels, heads["class_id"] == labels["node"], "left").select(
        "set_key", F.coalesce("component", "class_id").alias("component_id"))
    return rows.join(heads, "set_key", "left").select(
        "doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id")
    ).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def deduplicate(docs: DataFrame, words: int = 5, percent: int = 80, id_column: str = "doc_id",
                text_column: str = "text") -> DataFrame:
    """The documents without those whose group has a smaller id, with their own columns."""
    dropped = groups(docs, words, percent, id_column, text_column).where("not kept").select(
        F.col("doc_id").alias("_dropped")).distinct()
    return docs.join(dropped, docs[id_column] == dropped["_dropped"], "left_anti")
