"""Shared conversation prefixes as an adaptive radix tree (op11).

Turns of a conversation are ordered by ``turn`` (null first; ties by role, then text);
null role or text is empty. Conversation ``c`` is rebuilt from the first ``h`` turns of
conversation ``c - c % 100`` (all if fewer, none if absent) followed by ``c``'s own turns
after its first ``h``, with ``h = crc32(decimal c) % 6``. Every distinct sequence of the
first ``d`` rebuilt turns is a node of depth ``d`` (the root has ``d = 0``).

Method. A turn becomes a fixed-width id: the first ``ID_BYTES`` bytes of the SHA-256 of
``role \\0 text``, read as big-endian words, so no join of texts is needed and a very
common turn is no hot key. A rebuilt conversation is the concatenation of its turn ids.
Keys are hash-partitioned by the whole key and sorted; each partition inserts its
distinct keys into an adaptive radix tree (inner nodes of 4, 16, 48 and 256 children that
grow as needed, prefixes compressed on single-child paths, leaves expanded lazily) and
streams the ascending ``conv_id`` of equal keys into one SHA-256, so a conversation with a
third of all copies needs constant memory. A walk of the tree emits only nodes at
turn-aligned byte depths (multiples of ``ID_BYTES``), also inside compressed paths, with
the partition's counts; Spark merges the partial nodes by prefix (partial aggregation),
counts children by parent prefix and sums leaves and saved tokens over each node's
ancestors.

Result per node: ``conv_id`` (smallest member), ``depth``, ``parent_conv_id`` (null at
the root), ``n_convs``, ``n_children``, ``n_leaves`` (childless nodes of its subtree,
itself included), ``saved_tokens`` (over its subtree, ``(n_convs - 1)`` times the code
points of each node's last text; 0 at the root), ``ends_sha256`` (SHA-256 of the
comma-joined ascending ids of members with exactly ``d`` turns; of the empty string if
none).

Defined results: rows with a null ``conv_id`` belong to no conversation and are ignored;
a conversation whose rebuilt sequence is empty is a member of the root only; repeated
rows are turns of their own; an empty table gives no rows; extra columns are ignored.
Equal turns are decided by 128-bit SHA-256 prefixes (a collision is not expected below
2^64 distinct turns).
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fleetlint.llm.tables import find_package, shuffle_partitions

ID_BYTES = 16
BASE_EVERY = 100
SHARED_MOD = 6
EMPTY_SHA = hashlib.sha256(b"").hexdigest()
_NODES = "prefix binary, depth long, n long, first long, ends string, last_len long"


def rebuilt_turns(conversations: DataFrame, base_every: int = BASE_EVERY, shared_mod: int = SHARED_MOD) -> tuple[DataFrame, DataFrame]:
    """``(convs, turns)``: every conversation ``conv_id``; rebuilt turns ``conv_id, pos, tid, n_chars``."""
    role = F.coalesce(F.col("role").cast("string"), F.lit(""))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "_role", "_text")
    turns = (conversations.where(F.col("conv_id").isNotNull())
             .select(F.col("conv_id").cast("bigint").alias("conv_id"), "turn", role.alias("_role"), text.alias("_text"))
             .withColumn("rank", F.row_number().over(order) - 1)
             .select("conv_id", "rank",
                     F.unhex(F.substring(F.sha2(F.concat_ws("\u0000", "_role", "_text"), 256), 1, 2 * ID_BYTES)).alias("tid"),
                     F.length("_text").cast("bigint").alias("n_chars")))
    counts = turns.groupBy("conv_id").agg(F.count("*").alias("n"))
    convs = counts.select("conv_id", (F.crc32(F.col("conv_id").cast("string")) % shared_mod).alias("h"),
                          (F.col("conv_id") - F.col("conv_id") % base_every).alias("b"))
    base = counts.select(F.col("conv_id").alias("b"), F.col("n").alias("n_b"))
    convs = convs.join(base, "b", "left").withColumn("k", F.least("h", F.coalesce("n_b", F.lit(0))))
    own = turns.join(convs.select("conv_id", "h", "k"), "conv_id").where(F.col("rank") >= F.col("h")).select(
        "conv_id", (F.col("k") + F.col("rank") - F.col("h")).alias("pos"), "tid", "n_chars")
    borrowed = convs.select("conv_id", "b", "h").join(
        turns.select(F.col("conv_id").alias("b"), "rank", "tid", "n_chars"), "b").where(F.col("rank") < F.col("h")).select(
        "conv_id", F.col("rank").alias("pos"), "tid", "n_chars")
    return convs.select("conv_id"), own.unionByName(borrowed)


def keys(conversations: DataFrame) -> DataFrame:
    """``conv_id, key`` (concatenated turn ids, empty for a turnless one), ``lens`` (code points of each turn)."""
    convs, turns = rebuilt_turns(conversations)
    grouped = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("pos", "tid", "n_chars"))).alias("t"))
    return convs.join(grouped, "conv_id", "left").select(
        "conv_id",
        F.coalesce(F.aggregate(F.transform("t", lambda x: x["tid"]), F.lit(bytearray()), lambda a, b: F.concat(a, b)),
                   F.lit(bytearray())).alias("key"),
        F.coalesce(F.transform("t", lambda x: x["n_chars"]), F.array().cast("array<bigint>")).alias("lens"))


class Leaf:
    __slots__ = ("key", "count", "first", "ends", "lens")

    def __init__(self, key: bytes, count: int, first: int, ends: str, lens: list):
        self.key, self.count, self.first, self.ends, self.lens = key, count, first, ends, lens


class Inner:
    """An inner node: compressed ``prefix``, children by byte in a layout of 4, 16, 48 or 256 slots."""

    __slots__ = ("prefix", "size", "keys", "slots", "children", "end")

    def __init__(self, prefix: bytes):
        self.prefix, self.size, self.keys, self.children, self.slots, self.end = prefix, 4, bytearray(), [], None, None

    def find(self, byte: int):
        if self.size == 256:
            return self.children[byte]
        if self.size == 48:
            slot = self.slots[byte]
            return self.children[slot] if slot >= 0 else None
        i = self.keys.find(bytes([byte]))
        return self.children[i] if i >= 0 else None

    def replace(self, byte: int, child) -> None:
        if self.size == 256:
            self.children[byte] = child
        elif self.size == 48:
            self.children[self.slots[byte]] = child
        else:
            self.children[self.keys.find(bytes([byte]))] = child

    def add(self, byte: int, child) -> None:
        if self.size in (4, 16) and len(self.keys) == self.size:
            self._grow()
        elif self.size == 48 and len(self.children) == 48:
            self._grow()
        if self.size == 256:
            self.children[byte] = child
        elif self.size == 48:
            self.slots[byte] = len(self.children)
            self.children.append(child)
        else:
            at = next((i for i, k in enumerate(self.keys) if k > byte), len(self.keys))
            self.keys.insert(at, byte)
            self.children.insert(at, child)

    def _grow(self) -> None:
        items = list(self.items())
        if self.size == 4:
            self.size = 16
            return
        if self.size == 16:
            self.size, self.slots, self.children, self.keys = 48, [-1] * 256, [], bytearray()
            for i, (b, c) in enumerate(items):
                self.slots[b] = i
                self.children.append(c)
            return
        self.size, self.slots, self.children = 256, None, [None] * 256
        for b, c in items:
            self.children[b] = c

    def items(self):
        """Children in byte order."""
        if self.size == 256:
            return ((b, c) for b, c in enumerate(self.children) if c is not None)
        if self.size == 48:
            return ((b, self.children[s]) for b, s in enumerate(self.slots) if s >= 0)
        return zip(self.keys, self.children)


def insert(root: Inner, leaf: Leaf) -> None:
    """Insert a leaf of a key that is not in the tree yet."""
    key, node, depth = leaf.key, root, 0
    parent, via = None, -1
    while True:
        p = node.prefix
        m = 0
        while m < len(p) and depth + m < len(key) and p[m] == key[depth + m]:
            m += 1
        if m < len(p):
            split = Inner(p[:m])
            node.prefix = p[m + 1:]
            split.add(p[m], node)
            if depth + m == len(key):
                split.end = leaf
            else:
                split.add(key[depth + m], leaf)
            parent.replace(via, split)
            return
        depth += len(p)
        if depth == len(key):
            node.end = leaf
            return
        child = node.find(key[depth])
        if child is None:
            node.add(key[depth], leaf)
            return
        if isinstance(child, Leaf):
            other = child.key
            m = 0
            while depth + 1 + m < min(len(key), len(other)) and key[depth + 1 + m] == other[depth + 1 + m]:
                m += 1
            split = Inner(key[depth + 1:depth + 1 + m])
            for one in (child, leaf):
                if len(one.key) == depth + 1 + m:
                    split.end = one
                else:
                    split.add(one.key[depth + 1 + m], one)
            node.replace(key[depth], split)
            return
        parent, via, node, depth = node, key[depth], child, depth + 1


def nodes(root: Inner, width: int = ID_BYTES):
    """Rows ``(prefix, depth, n, first, ends, last_len)`` of every turn-aligned depth of the tree."""
    totals = {}
    stack = [(root, False)]
    while stack:
        node, done = stack.pop()
        if isinstance(node, Leaf):
            continue
        if not done:
            stack.append((node, True))
            stack.extend((c, False) for _, c in node.items())
            continue
        parts = [node.end] if node.end else []
        parts += [c for _, c in node.items()]
        count = first = rep = None
        for c in parts:
            n, f, r = (c.count, c.first, c) if isinstance(c, Leaf) else totals[id(c)]
            count = n if count is None else count + n
            first = f if first is None else min(first, f)
            rep = rep or r
        totals[id(node)] = (count, first, rep)
    walk = [(root, -1, 0)]
    while walk:
        node, branch, start = walk.pop()
        if isinstance(node, Leaf):
            end, (count, first, rep) = len(node.key), (node.count, node.first, node)
        else:
            end, (count, first, rep) = start + len(node.prefix), totals[id(node)]
            walk.extend((c, end, end + 1) for _, c in node.items())
        t = -(-(branch + 1) // width) * width
        while t <= end:
            if isinstance(node, Leaf):
                ends = node.ends if t == len(node.key) else None
            else:
                ends = node.end.ends if (node.end is not None and t == end) else None
            d = t // width
            yield rep.key[:t], d, count, first, ends, (rep.lens[d - 1] if d else 0)
            t += width


def _partition_nodes(batches):
    """Distinct keys of a sorted partition into one tree; equal keys stream their ids into one hash."""
    root = Inner(b"")
    current = None
    digest = None
    for batch in batches:
        ids = batch.column("conv_id").to_pylist()
        ks = batch.column("key").to_pylist()
        lens = batch.column("lens").to_pylist()
        for c, k, ln in zip(ids, ks, lens):
            if current is not None and current.key == k:
                current.count += 1
                digest.update(b"," + str(c).encode())
                continue
            if current is not None:
                current.ends = digest.hexdigest()
                insert(root, current)
            current = Leaf(k, 1, c, None, ln)
            digest = hashlib.sha256(str(c).encode())
    if current is None:
        return
    current.ends = digest.hexdigest()
    insert(root, current)
    rows = list(zip(*nodes(root)))
    names = ["prefix", "depth", "n", "first", "ends", "last_len"]
    types = [pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64()]
    for start in range(0, len(rows[0]), 65536):
        yield pa.RecordBatch.from_arrays([pa.array(col[start:start + 65536], t) for col, t in zip(rows, types)], names=names)


def trie(conversations: DataFrame, partitions: int | None = None) -> DataFrame:
    """One row per node (see the module)."""
    find_package(conversations.sparkSession)
    parts = partitions or shuffle_partitions(conversations.sparkSession)
    keyed = keys(conversations).repartition(parts, "key").sortWithinPartitions("key", "conv_id")
    partial = keyed.mapInArrow(_partition_nodes, _NODES)
    merged = partial.groupBy("prefix").agg(
        F.first("depth").alias("depth"), F.sum("n").alias("n_convs"), F.min("first").alias("conv_id"),
        F.max("ends").alias("ends"), F.first("last_len").alias("last_len"))
    parent_of = F.when(F.col("depth") > 0, F.substring("prefix", 1, (F.col("depth") - 1) * ID_BYTES))
    merged = merged.withColumn("parent", parent_of)
    children = merged.where(F.col("depth") > 0).groupBy(F.col("parent").alias("prefix")).agg(F.count("*").alias("n_children"))
    nodes_ = merged.join(children, "prefix", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    own = nodes_.select(
        "prefix", "depth", F.when(F.col("n_children") == 0, 1).otherwise(0).alias("leaf"),
        F.when(F.col("depth") > 0, (F.col("n_convs") - 1) * F.col("last_len")).otherwise(0).alias("saved"))
    up = own.select(F.explode(F.sequence(F.lit(0), F.col("depth"))).alias("k"), "prefix", "leaf", "saved").select(
        F.substring("prefix", 1, F.col("k") * ID_BYTES).alias("prefix"), "leaf", "saved")
    sums = up.groupBy("prefix").agg(F.sum("leaf").alias("n_leaves"), F.sum("saved").alias("saved_tokens"))
    parents = nodes_.select(F.col("prefix").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    return nodes_.join(sums, "prefix").join(parents, "parent", "left").select(
        F.col("conv_id").cast("bigint").alias("conv_id"), F.col("depth").cast("bigint").alias("depth"),
        F.col("parent_conv_id").cast("bigint").alias("parent_conv_id"), F.col("n_convs").cast("bigint").alias("n_convs"),
        F.col("n_children").cast("bigint").alias("n_children"), F.col("n_leaves").cast("bigint").alias("n_leaves"),
        F.col("saved_tokens").cast("bigint").alias("saved_tokens"), F.coalesce("ends", F.lit(EMPTY_SHA)).alias("ends_sha256"))


def brute_force(rows: list[tuple], base_every: int = BASE_EVERY, shared_mod: int = SHARED_MOD) -> list[tuple]:
    """The same result by plain Python over ``(conv_id, turn, role, text)`` rows, for tests."""
    import zlib

    by = {}
    for c, turn, role, text in rows:
        if c is not None:
            by.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [(r, t) for _, _, r, t in sorted(v)] for c, v in by.items()}
    rebuilt = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % shared_mod
        b = c - (abs(c) % base_every) * (1 if c >= 0 else -1)
        rebuilt[c] = tuple(own.get(b, [])[:h]) + tuple(turns[h:])
    members = {}
    for c, seq in rebuilt.items():
        for d in range(len(seq) + 1):
            members.setdefault(seq[:d], []).append(c)
    kids = {}
    for p in members:
        if p:
            kids.setdefault(p[:-1], []).append(p)
    out = []
    for p, ms in members.items():
        sub = [q for q in members if q[:len(p)] == p]
        leaves = sum(1 for q in sub if q not in kids)
        saved = sum((len(members[q]) - 1) * len(q[-1][1]) for q in sub if q)
        ends = ",".join(str(c) for c in sorted(c for c in ms if len(rebuilt[c]) == len(p)))
        out.append((min(ms), len(p), min(members[p[:-1]]) if p else None, len(ms), len(kids.get(p, [])), leaves, saved,
                    hashlib.sha256(ends.encode()).hexdigest()))
    return out
