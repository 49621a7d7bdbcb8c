"""Hard-negative mining with anchor spanning-tree bounds (op13).

Rows take part when label, vector and ``vec_id`` are not null and every component is
finite. Where ``vec_id % flip_every == 0`` the label becomes ``(label + 1) % 10``. A
component ``x`` becomes ``floor(scale * x)`` (``x`` as double); a row's score against an
anchor is the integer inner product (over the positions both vectors have). Order: higher
score first, ties by the smaller ``vec_id``. Anchors are rows with ``vec_id % anchor_every
== 0``. An anchor's positives are its first ``positives`` rows of the same label with another
``vec_id``; for each positive the negatives are its first ``negatives`` rows of another
label with ``low * positive_score <= 100 * score <= high * positive_score``.

Method. Anchors are range-partitioned by a fixed random projection into blocks of about
``block_anchors``; inside a block, Prim's algorithm links them into a minimum spanning tree.
Candidates are hashed into blocks of about ``block_rows``. Each (anchor block, candidate
block) pair is one group of a cogrouped ``applyInArrow``: the root anchor scores every
candidate exactly; a child's score of candidate ``x`` lies within the parent's score (or
bound) plus or minus ``|child - parent| * |x|`` (Cauchy-Schwarz), and only candidates whose
bound overlaps the child's window are scored again. The window is the 5th largest lower
bound and above for positives (pass 1); for negatives (pass 2) it is the union of the
positives' score ranges. Each pass keeps a block's first rows per anchor (or per anchor and
positive); ``plans.skew.top_k`` ranks them over all blocks with salted pre-cuts. Every
anchor meets every candidate block, which is the stated query set against all rows, in
blocks; no pair table is formed.

Defined results: rows that do not take part are ignored; repeated rows are rows of their
own (equal scores, so both may be returned); an anchor with fewer positives or negatives
returns what there is; an empty table or one without anchors gives no rows; extra columns
are ignored. Scores are exact int64 (components up to about 2^20 in magnitude for 64
dimensions).
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlint.llm.tables import find_package
from fleetlint.plans.skew import top_k
from fleetlint.plans.storage import materialise

RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
_PASS1 = "akey long, anchor_id long, positive_id long, positive_score long"
_PASS2 = "akey long, anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long"


def prepared(emb: DataFrame, flip_every: int = 7, scale: int = 256) -> DataFrame:
    """Rows that take part: ``row_key, vec_id, label, ivec`` (integer components), stored once."""
    vector = F.col("embedding")
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) != F.lit(float("inf"))))
    label = F.when(F.col("vec_id") % flip_every == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = emb.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & vector.isNotNull() & finite).select(
        F.col("vec_id").cast("bigint").alias("vec_id"), label.cast("int").alias("label"),
        F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("bigint")).alias("ivec"))
    return materialise(rows.withColumn("row_key", F.monotonically_increasing_id()), "hard-negative-rows")


def _projection(seed: int):
    sign = lambda i: F.when(F.pmod(F.xxhash64(F.lit(seed), i), F.lit(2)) == 0, 1).otherwise(-1)
    return F.aggregate(F.transform("ivec", lambda x, i: x * sign(i)), F.lit(0).cast("bigint"), lambda a, b: a + b)


def mine(emb: DataFrame, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100, anchor_every: int = 100,
         flip_every: int = 7, scale: int = 256, block_anchors: int = 256, block_rows: int = 4096, seed: int = 7) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score`` (see the module)."""
    spark = emb.sparkSession
    rows = prepared(emb, flip_every, scale)
    anchors = rows.where(F.col("vec_id") % anchor_every == 0)
    n_rows, n_anchors = rows.count(), anchors.count()
    if n_anchors == 0:
        return spark.createDataFrame([], RESULT)
    n_ab = max(1, math.ceil(n_anchors / block_anchors))
    n_cb = max(1, math.ceil(n_rows / block_rows))
    blocked = materialise(
        anchors.withColumn("_proj", _projection(seed)).repartitionByRange(n_ab, "_proj", "row_key")
        .select(F.spark_partition_id().alias("ablock"), F.col("row_key").alias("akey"), "vec_id", "label", "ivec"),
        "hard-negative-anchors")
    # The partitions actually made decide the blocks: a session may raise the count given to repartitionByRange.
    n_ab = blocked.agg(F.max("ablock")).first()[0] + 1
    cands = rows.select(F.pmod(F.xxhash64("row_key"), F.lit(n_cb)).cast("int").alias("cblock"), "vec_id", "label", "ivec")
    find_package(spark)

    def pairs(left: DataFrame, right: DataFrame, function, schema: str) -> DataFrame:
        a = left.withColumn("cblock", F.explode(F.sequence(F.lit(0), F.lit(n_cb - 1))))
        c = right.withColumn("ablock", F.explode(F.sequence(F.lit(0), F.lit(n_ab - 1))))
        return a.groupBy("ablock", "cblock").cogroup(c.groupBy("ablock", "cblock")).applyInArrow(function, schema)

    first = pairs(blocked, cands, lambda a, c: _block(a, c, positives, None, negatives, low, high), _PASS1)
    best = top_k(first, ["akey"], [F.desc("positive_score"), F.asc("positive_id")], positives, ["positive_id"], rank="_p")
    chosen = best.groupBy("akey").agg(F.sort_array(F.collect_list(F.struct("positive_id", "positive_score"))).alias("pos"))
    with_pos = blocked.join(chosen, "akey")
    second = pairs(with_pos, cands, lambda a, c: _block(a, c, positives, "pos", negatives, low, high), _PASS2)
    ranked = top_k(second, ["akey", "positive_id"], [F.desc("negative_score"), F.asc("negative_id")], negatives,
                   ["negative_id"], rank="rank")
    return ranked.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id",
                         "positive_score", "negative_score")


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """A list<long> column as an int64 matrix, shorter rows padded with zeros."""
    array = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    offsets = array.offsets.to_numpy()
    values = array.values.to_numpy(zero_copy_only=False).astype(np.int64)
    lengths = np.diff(offsets)
    width = int(lengths.max()) if len(lengths) else 0
    if len(lengths) and (lengths == width).all():
        return values.reshape(len(lengths), width)
    out = np.zeros((len(lengths), width), dtype=np.int64)
    for i, (s, n) in enumerate(zip(offsets[:-1], lengths)):
        out[i, :n] = values[s:s + n]
    return out


def spanning_tree(vectors: np.ndarray) -> tuple[list[int], np.ndarray, np.ndarray]:
    """Prim's minimum spanning tree: visiting order, parent of each node (-1 at the root), edge lengths."""
    m = len(vectors)
    x = vectors.astype(np.float64)
    parent = np.full(m, -1)
    edge = np.zeros(m)
    inside = np.zeros(m, dtype=bool)
    best = np.full(m, np.inf)
    via = np.zeros(m, dtype=int)
    order = []
    node = 0
    for _ in range(m):
        inside[node] = True
        order.append(node)
        d = np.sqrt(((x - x[node]) ** 2).sum(axis=1))
        closer = (d < best) & ~inside
        best[closer], via[closer] = d[closer], node
        if len(order) == m:
            break
        node = int(np.argmin(np.where(inside, np.inf, best)))
        parent[node], edge[node] = via[node], best[node]
    return order, parent, edge


def _first(idx: np.ndarray, scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """The first ``k`` of ``idx`` by score (higher first), ties by smaller id."""
    order = np.lexsort((ids[idx], -scores[idx]))
    return idx[order[:k]]


def _block(a: pa.Table, c: pa.Table, positives: int, pos_column: str | None, negatives: int, low: int, high: int) -> pa.Table:
    schema = _PASS1 if pos_column is None else _PASS2
    names = [f.split()[0] for f in schema.split(", ")]
    if a.num_rows == 0 or c.num_rows == 0:
        return pa.table({n: pa.array([], pa.int64()) for n in names})
    A, X = _matrix(a["ivec"]), _matrix(c["ivec"])
    width = max(A.shape[1], X.shape[1])
    A = np.pad(A, ((0, 0), (0, width - A.shape[1])))
    X = np.pad(X, ((0, 0), (0, width - X.shape[1])))
    akey, aid, alab = (a[n].to_numpy() for n in ("akey", "vec_id", "label"))
    cid, clab = c["vec_id"].to_numpy(), c["label"].to_numpy()
    norm = np.sqrt((X.astype(np.float64) ** 2).sum(axis=1))
    pos = [[(p["positive_id"], p["positive_score"]) for p in ps] for ps in a[pos_column].to_pylist()] if pos_column else None
    order, parent, edge = spanning_tree(A)
    lo, hi = {}, {}
    out = {n: [] for n in names}
    for j in order:
        if parent[j] < 0:
            exact = X @ A[j]
            lo[j], hi[j] = exact.astype(np.float64), exact.astype(np.float64)
            rescored = np.ones(len(X), dtype=bool)
        else:
            slack = edge[j] * (1 + 1e-9) * norm + 1.0
            lo[j], hi[j] = lo[parent[j]] - slack, hi[parent[j]] + slack
            if pos_column is None:
                mates = np.flatnonzero((clab == alab[j]) & (cid != aid[j]))
                if len(mates) > positives:
                    floor = np.partition(lo[j][mates], len(mates) - positives)[len(mates) - positives]
                    mates = mates[hi[j][mates] >= floor]
                rescored = np.zeros(len(X), dtype=bool)
                rescored[mates] = True
            else:
                ranges = [(-(-low * s // 100), s * high // 100) for _, s in pos[j] if low * s <= high * s]
                rescored = np.zeros(len(X), dtype=bool)
                if ranges:
                    wl, wh = min(r[0] for r in ranges), max(r[1] for r in ranges)
                    rescored = (clab != alab[j]) & (hi[j] >= wl) & (lo[j] <= wh)
            if rescored.any():
                exact = X[rescored] @ A[j]
                lo[j], hi[j] = lo[j].copy(), hi[j].copy()
                lo[j][rescored], hi[j][rescored] = exact, exact
        scores = lo[j].astype(np.int64)
        if pos_column is None:
            found = _first(np.flatnonzero(rescored & (clab == alab[j]) & (cid != aid[j])), scores, cid, positives)
            for i in found:
                for n, v in zip(names, (akey[j], aid[j], cid[i], scores[i])):
                    out[n].append(int(v))
        else:
            other = np.flatnonzero(rescored & (clab != alab[j]))
            for p_id, p_score in pos[j]:
                fit = other[(100 * scores[other] >= low * p_score) & (100 * scores[other] <= high * p_score)]
                for i in _first(fit, scores, cid, negatives):
                    for n, v in zip(names, (akey[j], aid[j], p_id, p_score, cid[i], scores[i])):
                        out[n].append(int(v))
    return pa.table({n: pa.array(v, pa.int64()) for n, v in out.items()})


def brute_force(rows: list[tuple], positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100,
                anchor_every: int = 100, flip_every: int = 7, scale: int = 256) -> list[tuple]:
    """The same result by plain Python over ``(vec_id, embedding, label)`` rows, for tests."""
    clean = []
    for vec_id, vec, label in rows:
        if vec_id is None or label is None or vec is None or any(x is None or not math.isfinite(x) for x in vec):
            continue
        label = (label + 1) % 10 if vec_id % flip_every == 0 else label
        clean.append((vec_id, label, [math.floor(scale * float(x)) for x in vec]))
    out = []
    for aid, alab, av in clean:
        if aid % anchor_every:
            continue
        scored = sorted(((-sum(p * q for p, q in zip(av, v)), vid, lab) for vid, lab, v in clean), key=lambda t: (t[0], t[1]))
        pos = [(vid, -s) for s, vid, lab in scored if lab == alab and vid != aid][:positives]
        for pid, ps in pos:
            neg = [(vid, -s) for s, vid, lab in scored if lab != alab and low * ps <= -100 * s <= high * ps][:negatives]
            out += [(aid, pid, r + 1, nid, ps, ns) for r, (nid, ns) in enumerate(neg)]
    return out

