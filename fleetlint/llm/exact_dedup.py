"""Exact duplicates by digest: heavy digests are removed map-side, the rest by one shuffle.

A Misra-Gries sketch (Spark's ``approx_top_k``) names the digests that may hold more than
a small share of all rows. Their exact counts and smallest ids come from one aggregation
with partial sums, so a group of any size is a few numbers per task. The verified winners,
at most ``HEAVY`` rows, are broadcast and settle their rows where these are read. Each
digest that is left has few rows, because the sketch names every more frequent one, and
goes through an ordinary shuffle. Only ids and digests move, never texts.

Defined results: a null text is empty; texts are equal after each run of ``[ \\t-\\r]`` is
one space; a null id is smaller than none (it stays only if its whole group has none);
rows that repeat the smallest id of their group are all kept, as the id names one document
(``deduplicate`` then keeps one of them); an empty table gives an empty table; further
columns are ignored by ``duplicate_groups`` and carried by ``deduplicate``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlint.llm.tables import whole_text
from fleetlint.plans.storage import materialise

#: Most digests that are broadcast, and counters of the sketch (its error is rows / counters).
HEAVY, COUNTERS = 1024, 65_536
#: A heavy digest must hold at least this share of the rows.
HEAVY_SHARE = 1 / 4096


def normalised(text: Column) -> Column:
    return F.regexp_replace(text, "[\\x20\\x09-\\x0D]+", " ")


def digests(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per document: id, SHA-256 of the normalised text and a 64-bit key of it."""
    digest = F.sha2(normalised(whole_text(docs, text_column)), 256)
    return docs.select(docs[id_column].alias("doc_id"), digest.alias("text_sha256")).withColumn(
        "key", F.xxhash64("text_sha256"))


def heavy_digests(rows: DataFrame, heavy: int = HEAVY, counters: int = COUNTERS,
                  share: float = HEAVY_SHARE) -> DataFrame:
    """Exact size and smallest id of the digests with at least ``share`` of all rows."""
    named = rows.select(F.expr(f"approx_top_k(key, {heavy}, {counters})").alias("top"), F.count("*").alias("n"))
    named = named.select(F.explode("top.item").alias("key"), "n")
    sized = rows.join(F.broadcast(named), "key").groupBy("text_sha256").agg(
        F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size"), F.max("n").alias("n"))
    return sized.where((F.col("group_size") >= F.col("n") * share) & (F.col("group_size") > 1)).drop("n")


def duplicate_groups(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text",
                     heavy: int = HEAVY) -> DataFrame:
    """Each document with the id that stays, the size of its group and whether it is the one."""
    rows = materialise(digests(docs, id_column, text_column), "digests")
    winners = materialise(heavy_digests(rows, heavy).limit(heavy), "heavy-digests")
    hot = rows.join(F.broadcast(winners), "text_sha256")
    rest = rows.join(F.broadcast(winners.select("text_sha256")), "text_sha256", "left_anti")
    sizes = rest.groupBy("text_sha256").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    cold = rest.join(sizes, "text_sha256")
    columns = ["doc_id", "keep_id", "group_size", "text_sha256"]
    return hot.select(*columns).unionByName(cold.select(*columns)).select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def deduplicate(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The documents whose row stays, with their own columns: exactly one row of each group of equal texts.

    Rows that repeat the kept id with a text equal after normalising (white space aside)
    are one row; which of them stays is not defined. Repeats are found by the id and the
    digest of the normalised text, so no whole text is a key.
    """
    dropped = duplicate_groups(docs, id_column, text_column).where("not kept").select(
        F.col("doc_id").alias("_id"), F.col("text_sha256").alias("_sha")).distinct()
    digest = F.sha2(normalised(whole_text(docs, text_column)), 256)
    left = docs.join(dropped, docs[id_column].eqNullSafe(dropped["_id"]) & (digest == dropped["_sha"]), "left_anti")
    inner = "_dedup_sha"
    while inner in docs.columns:  # a name of the caller's is never replaced
        inner += "_"
    return left.withColumn(inner, digest).dropDuplicates([id_column, inner]).drop(inner)
