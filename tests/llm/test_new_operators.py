"""Prefix trie, quality rules and hard negatives against brute force, with awkward rows."""

import math
import random
import re

import numpy as np
import pytest

from fleetlint.llm import hard_negatives, prefix_trie, quality

CONV = "conv_id long, turn long, role string, text string, _salt string, key string"


def conversation_rows():
    rng = random.Random(3)
    texts = ["hi", "hello there", "", None, "é" * 40, "x" * 5000]
    rows = []
    for c in [0, 1, 2, 3, 5, 17, 100, 101, 102, 150, 199, 200, 201, 305, 999]:
        for t in range(rng.randint(0, 7)):
            rows.append((c, t, rng.choice(["user", "assistant", None]), rng.choice(texts), "x", "y"))
    rows += [(1, None, "user", "null turn", "x", "y"), (2, 3, "user", "dup", "x", "y"), (2, 3, "user", "dup", "x", "y"),
             (None, 0, "user", "no id", "x", "y"), (400, None, None, None, "x", "y")]
    rows += [(500 + i, 0, "user", "common first turn", "x", "y") for i in range(40)]
    rows += [(500 + i, 1, "assistant", "same answer", "x", "y") for i in range(40)]
    return rows


def key(r):
    return tuple((x is None, x) for x in r)


def test_prefix_trie_equals_brute_force(spark):
    rows = conversation_rows()
    got = sorted((tuple(r) for r in prefix_trie.trie(spark.createDataFrame(rows, CONV), partitions=3).collect()), key=key)
    want = sorted(prefix_trie.brute_force([r[:4] for r in rows]), key=key)
    assert got == want
    root = [r for r in got if r[1] == 0]
    assert len(root) == 1 and root[0][3] == len({r[0] for r in rows if r[0] is not None})


def test_prefix_trie_empty(spark):
    assert prefix_trie.trie(spark.createDataFrame([], CONV)).count() == 0


def test_adaptive_radix_tree_layouts():
    root = prefix_trie.Inner(b"")
    keys = sorted({bytes([a, b]) * 8 for a in range(0, 256, 3) for b in (1, 2)} | {b"", bytes(16)})
    for i, k in enumerate(keys):
        prefix_trie.insert(root, prefix_trie.Leaf(k, 1, i, str(i), [1] * (len(k) // 16)))
    assert root.size == 256
    found = {(p, d) for p, d, *_ in prefix_trie.nodes(root)}
    want = {(k[:t], t // 16) for k in keys for t in range(0, len(k) + 1, 16)}
    assert found == want


def words(text):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]


def brute_counts(text):
    ws = words(text)
    lines = [s for s in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", s)]
    windows = [" ".join(ws[i:i + 3]) for i in range(len(ws) - 2)]
    seen = {}
    for w in windows:
        seen[w] = seen.get(w, 0) + 1
    covered = {i + k for i, w in enumerate(windows) if seen[w] >= 2 for k in range(3)}
    dup = sum(1 for i, s in enumerate(lines) if s in lines[:i])
    return (len(ws), sum(len(w) for w in ws), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(covered))


def quality_rows():
    rng = random.Random(5)
    vocab = [f"w{i}" for i in range(500)]
    rows = []
    for i in range(300):
        rows.append((i, " ".join(rng.choices(vocab, k=rng.randint(60, 200))), "en", f"s{i % 3}", "clash"))
    rows += [(1000, "$$ ## ** " * 40 + " ".join(rng.choices(vocab, k=60)), "en", "s0", "clash"),
             (1001, None, "en", "s0", "clash"), (1002, "", None, None, "clash"), (1003, "a b c " * 30, "en", "s1", "clash"),
             (1004, ("line one here\n" * 30) + " ".join(rng.choices(vocab, k=80)), "fr", None, "clash"),
             (1005, " ".join(rng.choices(vocab, k=200000)), "en", "s2", "clash"), (7, "dup row " * 30, "en", "s0", "clash")]
    return rows


def test_quality_base_counts(spark):
    rows = quality_rows()
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, _salt string")
    got = {(r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.kept)
           for r in quality.judged(df).collect()}
    assert len(got) == len(rows)
    for doc_id, text, *_ in rows:
        n, chars, sym, dup, rep = brute_counts(text)
        failed = n < 50 or 100 * rep > 50 * n
        assert any(g[:7] == (doc_id, n, chars, sym, dup, rep, failed) for g in got), doc_id
    kept = {g[0]: g[7] for g in got}
    assert not kept[1000] and not kept[1001] and not kept[1002] and not kept[1003]
    assert sum(kept[i] for i in range(300)) >= 295


def test_quality_verdict_follows_fences(spark):
    rows = quality_rows()
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, _salt string")
    out = quality.judged(df, min_group=50).toPandas()
    for _, r in out.iterrows():
        if r.base_failed:
            assert not r.kept
    assert set(out.fence_level.dropna()) <= {0, 1, 3}
    assert quality.judged(spark.createDataFrame([], "doc_id long, text string, lang string, source string")).count() == 0


def embedding_rows(n=700, dim=8, seed=1):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        v = [float(x) for x in rng.normal(0, 0.3, dim)]
        rows.append((i, v, int(rng.integers(0, 4)), "clash"))
    rows += [(1000, [0.1] * dim, 1, "c"), (1100, [0.1] * dim, 1, "c"), (1200, None, 1, "c"), (1300, [0.1] * dim, None, "c"),
             (1400, [float("nan")] + [0.1] * (dim - 1), 1, "c"), (1500, [None] + [0.1] * (dim - 1), 1, "c"),
             (None, [0.2] * dim, 1, "c"), (300, rows[300][1], rows[300][2], "c"), (1600, [0.5] * (dim - 2), 2, "c")]
    return rows


def test_hard_negatives_equal_brute_force(spark):
    rows = embedding_rows()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, akey string")
    want = sorted(hard_negatives.brute_force([(v, [None if x is None else float(np.float32(x)) for x in e] if e else e, lab)
                                              for v, e, lab, _ in rows]))
    for anchors, cands in [(256, 4096), (2, 50)]:
        got = sorted(tuple(r) for r in hard_negatives.mine(df, block_anchors=anchors, block_rows=cands).collect())
        assert got == want
    assert want


def test_hard_negatives_empty(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert hard_negatives.mine(df).count() == 0


def test_spanning_tree_bounds():
    rng = np.random.default_rng(2)
    anchors = rng.integers(-50, 50, (30, 6))
    order, parent, edge = hard_negatives.spanning_tree(anchors)
    assert sorted(order) == list(range(30)) and (parent >= 0).sum() == 29
    x = rng.integers(-50, 50, (100, 6))
    for j in range(30):
        if parent[j] >= 0:
            gap = np.abs(x @ anchors[j] - x @ anchors[parent[j]])
            assert (gap <= edge[j] * np.sqrt((x.astype(float) ** 2).sum(1)) + 1e-6).all()
            assert math.isclose(edge[j], float(np.sqrt(((anchors[j] - anchors[parent[j]]) ** 2).sum())))


def test_hard_negatives_when_the_session_raises_partition_counts(spark, monkeypatch):
    from pyspark.sql import DataFrame

    rows = embedding_rows(n=400)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, akey string")
    want = sorted(hard_negatives.brute_force([(v, [None if x is None else float(np.float32(x)) for x in e] if e else e, lab)
                                              for v, e, lab, _ in rows]))
    original = DataFrame.repartitionByRange
    monkeypatch.setattr(DataFrame, "repartitionByRange", lambda self, n, *cols: original(self, max(n, 11), *cols))
    got = sorted(tuple(r) for r in hard_negatives.mine(df, block_anchors=2, block_rows=50).collect())
    assert got == want


def test_exact_deduplicate_keeps_one_row_per_group(spark):
    from fleetlint.llm import exact_dedup

    rows = [(5, "a b", "x"), (5, "a  b", "y"), (6, "a b", "z"), (7, None, "n"), (8, "", "e"), (9, "c", "c"), (9, "c", "c")]
    df = spark.createDataFrame(rows, "doc_id long, text string, _dedup_sha string")
    got = sorted(r.doc_id for r in exact_dedup.deduplicate(df).collect())
    assert got == [5, 7, 9]
    assert exact_dedup.deduplicate(df).columns == df.columns
