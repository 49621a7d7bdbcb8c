"""One-permutation MinHash fingerprints of texts, in SQL expressions only.

Each shingle of five words is hashed once. The top bits of the hash name a bin, the
smallest hash of a bin is its value. An empty bin takes the value of a filled bin that its
own pseudo-random order of bins names first (optimal densification: each filled bin is
equally likely, and equal sets choose alike). Of each value the low four bits are stored,
one hexadecimal digit per bin. The likeness of two fingerprints is the share of equal
digits, corrected by the share ``1/16`` that agrees by chance.

The bins are found without a loop: one marker per bin, larger than any hash of that bin, is
added to the hashes; after sorting, the first entry of each bin is its minimum or, in an
empty bin, the marker.

Defined results: null is empty; a text with one to four words is one shingle; a text
without words has the fingerprint ``-``, whose likeness is 1 to itself and 0 to any other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetlint.llm.tables import let, whole_text

#: Bins (a power of two), stored bits per bin, words of a shingle.
BINS, BITS, WORDS = 128, 4, 5
#: Documents per ordered bucket when neighbours are looked up, and most buckets (beyond, buckets grow and spill).
BUCKET_ROWS, MAX_BUCKETS = 4096, 8192
_HASH_BITS = 63
_EMPTY = "-"


def words(text: Column) -> Column:
    """Words between runs of white space."""
    return F.split(F.trim(F.regexp_replace(F.lower(text), "[\\x20\\x09-\\x0D]+", " ")), " ")


def shingle_hashes(text: Column, n: int = WORDS) -> Column:
    """Non-negative 63-bit hashes of the shingles of ``n`` words; empty without words."""

    def of_words(hashes: Column) -> Column:
        count = F.size(hashes)
        longer = F.transform(
            F.sequence(F.lit(1), F.greatest(count - n + 1, F.lit(1))),
            lambda i: F.xxhash64(*[F.element_at(hashes, i + k) for k in range(n)]).bitwiseAND(F.lit(2 ** _HASH_BITS - 1)))
        short = F.array(F.xxhash64(F.concat_ws(",", hashes.cast("array<string>"))).bitwiseAND(F.lit(2 ** _HASH_BITS - 1)))
        return F.when(count >= n, longer).otherwise(short)

    hashes = F.transform(F.filter(words(text), lambda w: w != ""), lambda w: F.xxhash64(w))
    return let(hashes, lambda h: F.when(F.size(h) == 0, F.array().cast("array<bigint>")).otherwise(of_words(h)))


def bin_minima(hashes: Column, bins: int = BINS) -> Column:
    """Smallest hash of each bin in bin order; the marker of the bin where it is empty."""
    shift = _HASH_BITS - (bins.bit_length() - 1)
    markers = F.array(*[F.lit(((b + 1) << shift) - 1) for b in range(bins)])
    return let(
        F.sort_array(F.concat(hashes, markers)),
        lambda s: F.filter(s, lambda x, i: (i == 0) | (
            F.shiftright(x, shift) != F.shiftright(F.get(s, F.greatest(i - 1, F.lit(0))), shift))))


def densified(minima: Column, bins: int = BINS, bits: int = BITS) -> Column:
    """Low bits of each bin, empty bins filled from the filled ones."""
    shift = _HASH_BITS - (bins.bit_length() - 1)
    low = (1 << shift) - 1

    def is_empty(x: Column) -> Column:
        return x.bitwiseAND(F.lit(low)) == low

    def from_filled(filled: Column, i: Column) -> Column:
        ranked = F.transform(filled, lambda y: F.struct(
            F.xxhash64(i, F.shiftright(y, shift)).alias("rank"), y.alias("value")))
        return F.array_min(ranked)["value"]

    def fill(m: Column) -> Column:
        return let(F.filter(m, lambda y: ~is_empty(y)), lambda filled: F.transform(
            m, lambda x, i: F.when(is_empty(x), from_filled(filled, i)).otherwise(x).bitwiseAND(F.lit((1 << bits) - 1))))

    return let(minima, fill)


def fingerprint(text: Column, bins: int = BINS) -> Column:
    """The packed fingerprint of a text, one hexadecimal digit per bin."""

    def packed(hashes: Column) -> Column:
        digits = F.transform(densified(bin_minima(hashes, bins), bins), lambda v: F.lower(F.hex(v)))
        return F.when(F.size(hashes) == 0, F.lit(_EMPTY)).otherwise(F.array_join(digits, ""))

    return let(shingle_hashes(text), packed)


def likeness(a: Column, b: Column, bins: int = BINS) -> Column:
    """Estimated Jaccard likeness of two fingerprints, 0 to 1."""
    equal = F.aggregate(
        F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: F.when(x == y, 1).otherwise(0)),
        F.lit(0), lambda s, x: s + x)
    chance = 1 / (1 << BITS)
    corrected = (equal / F.lit(float(bins)) - chance) / (1 - chance)
    return F.when((a == _EMPTY) | (b == _EMPTY), (a == b).cast("double")).otherwise(
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), corrected)))


def fingerprints(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per document: id and fingerprint."""
    return docs.select(docs[id_column].alias("doc_id"), fingerprint(whole_text(docs, text_column)).alias("fingerprint"))


def _bucket(value: Column, edges: list[int]) -> Column:
    """Number of sorted ``edges`` below ``value``, by bisection."""
    if not edges:
        return F.lit(0)
    steps = [1 << k for k in reversed(range(len(edges).bit_length()))]
    table = F.array(*[F.lit(e) for e in edges])
    return F.aggregate(
        F.array(*[F.lit(s) for s in steps]), F.lit(0),
        lambda found, step: F.when(
            (found + step <= len(edges)) & (F.get(table, found + step - 1) < value), found + step).otherwise(found))


def with_next(docs: DataFrame, rows_per_bucket: int = BUCKET_ROWS) -> DataFrame:
    """Each row of ``doc_id, text, fingerprint`` with the next one by descending id.

    Ids are cut into buckets at ids that occur. A row whose id is such an edge is the first
    of its bucket, and a copy of it ends the bucket above, so neighbours never cross a
    bucket and texts move once. The row with the largest id also ends the lowest bucket.
    Equal ids are ordered by text; a null id comes after all others.
    """
    known = docs.select(F.coalesce("doc_id", F.lit(-(2 ** 63))).alias("doc_id"))
    n = known.count()
    if n == 0:
        return docs.withColumns({"next_text": F.lit(None).cast("string"), "next_fingerprint": F.lit(None).cast("string")})
    parts = max(1, min(MAX_BUCKETS, n // rows_per_bucket))
    shares = [i / parts for i in range(1, parts)]
    top, edges = known.agg(
        F.max("doc_id"), F.percentile_approx("doc_id", shares, 100 * parts) if shares else F.array().cast("array<bigint>")).first()
    edges = sorted({e for e in edges if e < top})
    rows = docs.withColumn("_at", F.coalesce("doc_id", F.lit(-(2 ** 63)))).withColumn("_bucket", _bucket(F.col("_at"), edges))
    is_edge = F.get(F.array(*[F.lit(e) for e in edges]), F.col("_bucket")) == F.col("_at") if edges else F.lit(False)
    places = F.filter(F.array(
        F.struct(F.col("_bucket").alias("bucket"), F.lit(0).alias("copy")),
        F.when(is_edge, F.struct((F.col("_bucket") + 1).alias("bucket"), F.lit(1).alias("copy"))),
        F.when(F.col("_at") == top, F.struct(F.lit(0).alias("bucket"), F.lit(2).alias("copy"))),
    ), lambda p: p.isNotNull())
    rows = rows.withColumn("_place", F.explode(places)).withColumn("_bucket", F.col("_place.bucket"))
    order = Window.partitionBy("_bucket").orderBy("_place.copy", F.desc("_at"), "text")
    return rows.withColumns({
        "next_text": F.lead("text").over(order), "next_fingerprint": F.lead("fingerprint").over(order),
    }).where(F.col("_place.copy") == 0).drop("_at", "_bucket", "_place")


def edited_fingerprints(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Fingerprints of each text, of its edited text, and their likeness.

    The last third of a text is replaced by as many code points of the next document.
    """
    rows = docs.select(docs[id_column].alias("doc_id"), whole_text(docs, text_column).alias("text"))
    rows = with_next(rows.withColumn("fingerprint", fingerprint(F.col("text"))))
    n = F.length("text")
    third = F.floor(n / 3).cast("int")
    rows = rows.withColumn("n_chars", n.cast("bigint")).withColumn("edited", F.concat(
        F.substring(F.col("text"), F.lit(1), n - third), F.substring(F.coalesce("next_text", F.lit("")), F.lit(1), third)))
    rows = rows.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint",
                       fingerprint(F.col("edited")).alias("edited_fingerprint"), "next_fingerprint")
    return rows.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
                       likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
                       likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"))
