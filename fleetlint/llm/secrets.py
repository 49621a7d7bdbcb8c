"""Secrets in texts, and multipart credentials whose parts occur close together.

Three base kinds are always reported: ``assign`` (a secret name, a sign and a long value),
``access`` (an access key id) and ``hex`` (a long hexadecimal run). Three weak kinds are
reported only where complementary parts of a credential meet within ``SCOPE`` code points:

* ``ident``, a named user, account or key id: with any secret in scope;
* ``weak``, a secret name with a value too short for ``assign``, or a looser secret name:
  with an identifier or an endpoint in scope;
* ``endpoint``, an address or a named host: with an identifier and a secret in scope.

The distance of two parts is the gap between them, 0 where they overlap; their lengths do not count.
The parts of a document are rows; the largest end before and the smallest start after each part are the
interval join, so its work is linear in the number of parts and no pair is formed. Only documents with a
weak part take part in it.

Positions are code points, end exclusive. Matches are found with SQL expressions: the pieces
between matches and the matches themselves, whose lengths add up to positions.

Defined results: null is empty; a text without findings has counts of 0 and empty spans;
rows that repeat an id and a text get the same spans each; ids may be null; further columns
are ignored by ``find`` and carried by ``redact``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetlint.llm.tables import let, whole_text
from fleetlint.plans.storage import materialise

ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"  # all of a run of capitals and digits, 18 characters or more
HEX = r"[0-9a-f]{16,}"
IDENT = (r"""(?i:client_?id|user_?name|user|account|login|key_?id)["']?\x20*[:=]\x20*["']?"""
         r"""([A-Za-z0-9@._-]{3,})""")
WEAK = (r"""(?i:password|passwd|passphrase|pwd|secret|token|api_?key|private_?key|credential)["']?\x20*[:=]\x20*["']?"""
        r"""([A-Za-z0-9+/_.=!@#$%^&*-]{6,})""")
ENDPOINT = (r"""(?:(?i:https?|ftp|ssh|jdbc|postgres|postgresql|mysql|mongodb|redis|amqp)://[^\s"'<>]{3,}"""
            r"""|(?i:host|hostname|endpoint|server)["']?\x20*[:=]\x20*["']?[A-Za-z0-9.:_-]{4,})""")
#: Order of the kinds among spans with the same start.
KINDS = ("assign", "access", "hex", "ident", "weak", "endpoint")
BASE = KINDS[:3]
#: Shortest value of an ``assign`` match; largest distance of parts that belong together.
ASSIGN_CHARS, SCOPE = 12, 300
_SPAN = "array<struct<start:int,rank:int,end:int>>"


def spans(text: Column, pattern: str, kind: str, value_group: int = 0, least: int = 0) -> Column:
    """Start, rank of the kind and end of each match whose value has ``least`` characters."""

    def placed(parts: Column) -> Column:
        lengths = F.zip_with(parts["pieces"], parts["found"], lambda p, m: F.struct(
            F.length(p).alias("gap"), F.length(m).alias("size")))
        walk = F.aggregate(
            lengths, F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("out")),
            lambda s, x: F.struct(
                (s["at"] + x["gap"] + F.coalesce(x["size"], F.lit(0))).alias("at"),
                F.when(x["size"].isNull(), s["out"]).otherwise(F.concat(s["out"], F.array(F.struct(
                    (s["at"] + x["gap"]).alias("start"), (s["at"] + x["gap"] + x["size"]).alias("end"))))).alias("out")),
            lambda s: s["out"])
        kept = F.zip_with(walk, parts["values"], lambda s, v: F.when(
            F.length(v) >= least, F.struct(s["start"], F.lit(KINDS.index(kind)).alias("rank"), s["end"])))
        return F.filter(kept, lambda s: s.isNotNull())

    parts = F.struct(
        F.split(text, pattern, -1).alias("pieces"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(value_group)).alias("values"))
    return F.when(text.rlike(pattern), let(parts, placed)).otherwise(F.array()).cast(_SPAN)


def candidates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per document its id, a hash of its text, the base spans and the weak spans."""
    text = whole_text(docs, text_column)
    base = F.concat(spans(text, ASSIGN, "assign", 2, ASSIGN_CHARS), spans(text, ACCESS, "access"), spans(text, HEX, "hex"))
    weak = F.concat(spans(text, IDENT, "ident"), spans(text, WEAK, "weak"), spans(text, ENDPOINT, "endpoint"))
    return docs.select(docs[id_column].alias("doc_id"), F.xxhash64(text).alias("text_key"),
                       F.sort_array(base).alias("base"), weak.alias("weak"))


def linked(parts: DataFrame, scope: int = SCOPE) -> DataFrame:
    """Weak spans that meet complementary parts, per document with weak parts."""
    keys = ["doc_id", "text_key"]
    rows = parts.where(F.size("weak") > 0).dropDuplicates(keys).select(
        *keys, F.explode(F.concat("base", "weak")).alias("span")).select(*keys, "span.*")
    ordered = Window.partitionBy(*keys).orderBy("start")
    back = ordered.rangeBetween(Window.unboundedPreceding, Window.currentRow)
    ahead = Window.partitionBy(*keys).orderBy(F.col("start").desc()).rangeBetween(Window.unboundedPreceding, Window.currentRow)

    def there(*kinds: str) -> Column:
        of_kind = F.col("rank").isin([KINDS.index(k) for k in kinds])
        before = F.col("start") - F.max(F.when(of_kind, F.col("end"))).over(back) <= scope
        after = F.min(F.when(of_kind, F.col("start"))).over(ahead) - F.col("end") <= scope
        return F.coalesce(before, F.lit(False)) | F.coalesce(after, F.lit(False))

    # a weak match that repeats a base match is that match, not another secret
    strong = F.max(F.when(F.col("rank") < len(BASE), F.col("end"))).over(
        ordered.rangeBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumns({
        "has_ident": there("access", "ident"), "has_secret": there("assign", "hex", "weak"),
        "has_endpoint": there("endpoint"), "covered": F.coalesce(strong, F.lit(0)) > F.col("start")})
    kept = rows.where(
        F.when(F.col("rank") == KINDS.index("ident"), F.col("has_secret"))
        .when(F.col("rank") == KINDS.index("weak"), (F.col("has_ident") | F.col("has_endpoint")) & ~F.col("covered"))
        .when(F.col("rank") == KINDS.index("endpoint"), F.col("has_ident") & F.col("has_secret"))
        .otherwise(False))
    return kept.groupBy(*keys).agg(F.collect_list(F.struct("start", "rank", "end")).alias("linked"))


def find(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", scope: int = SCOPE) -> DataFrame:
    """Per document: ``doc_id``, ``text_key``, its base spans and all spans, in order."""
    parts = materialise(candidates(docs, id_column, text_column), "secret-parts")
    links = linked(parts, scope).withColumnsRenamed({"doc_id": "_id", "text_key": "_key"})
    return parts.join(links, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_key") == F.col("_key")), "left").select(
        "doc_id", "text_key", "base",
        F.sort_array(F.concat("base", F.coalesce("linked", F.array().cast(_SPAN)))).alias("spans"))


def as_text(column: str) -> Column:
    """``kind:start:end``, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(column, lambda s: F.concat_ws(
        ":", F.get(names, s["rank"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(docs: DataFrame, mark: str = "[SECRET]", id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The documents with each reported span replaced by ``mark``; overlapping spans share one."""
    found = find(docs, id_column, text_column).where(F.size("spans") > 0).select(
        F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"), F.col("spans").alias("_spans"))
    found = found.dropDuplicates(["_id", "_key"])
    text = whole_text(docs, text_column)
    joined = docs.join(found, docs[id_column].eqNullSafe(found["_id"]) & (F.xxhash64(text) == found["_key"]), "left")

    def masked(state_and_tail: Column) -> Column:
        return F.concat(state_and_tail["out"], F.substring(text, state_and_tail["at"] + 1, F.length(text)))

    body = F.aggregate(
        "_spans", F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        lambda s, x: F.struct(
            F.greatest(s["at"], x["end"]).alias("at"),
            F.when(x["start"] < s["at"], s["out"]).otherwise(F.concat(
                s["out"], F.substring(text, s["at"] + 1, x["start"] - s["at"]), F.lit(mark))).alias("out")),
        masked)
    changed = F.when(F.col("_spans").isNotNull(), body).otherwise(docs[text_column])
    return joined.select(*[changed.alias(c) if c == text_column else docs[c] for c in docs.columns])
