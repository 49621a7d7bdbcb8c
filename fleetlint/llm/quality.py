"""Quality rules whose cut-offs adapt to each language and source (op12).

Per document, built-in expressions only: ``n_words`` (runs of ``[^\\x20\\x09-\\x0D]``),
``word_chars`` (code points in words), ``n_symbols`` (characters of ``[#*$%&|<>]``),
``n_dup_lines`` (``\\n``-split lines with a word that equal an earlier line) and
``n_repeat_words`` (word positions inside a 3-word window that occurs twice or more
in the text, the first occurrence included). ``base_failed`` is ``n_words < 50`` or
``100 * n_repeat_words > 50 * n_words``.

The method's verdict replaces fixed cut-offs by fences from mergeable quantile
sketches (Spark's ``percentile_approx``, merged by partial aggregation, so a source
with a third of all rows is summed map-side and never meets one task). Sketches are
built over the documents that pass the base rules, per (lang, source), per lang and
over all, in one ``GROUPING SETS`` aggregation; a document takes the most specific of
these groups that holds at least ``min_group`` documents. For each ratio the fence is
Tukey's far-out fence ``q75 + far * max(q75 - q25, floor)`` (and the lower one for the
mean word length). ``kept`` is false when ``base_failed``, else true exactly when every
ratio lies within its fences. The thresholds meet the documents by a salted join, so
no (lang, source) group is one task.

Defined results: null text has no words (fails the base rules); null lang or source is
a group of its own (null-safe keys); rows that repeat a ``doc_id`` are scored each; an
empty table gives no rows; extra columns are kept out of the result, which has only
the columns listed in ``COLUMNS``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlint.llm.tables import let
from fleetlint.plans.storage import materialise

# Fixed values of the base rules (the contract's patterns and limits).
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]"
SYMBOLS = r"[#*$%&|<>]"
MIN_WORDS = 50
REPEAT_PERCENT = 50
WINDOW = 3

RATIOS = ("word_length", "symbol_ratio", "dup_line_ratio", "repeat_ratio")
COLUMNS = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]


def base_counts(docs: DataFrame) -> DataFrame:
    """``doc_id, lang, source`` and the base counts of each document, row by row (no shuffle).

    Built-in expressions that Spark compiles: ``regexp_count`` for words, ``array_distinct``
    for repeated lines and windows. Only texts with a repeated 3-word window evaluate the
    per-element form that finds which words such windows cover.
    """
    text = F.coalesce(docs["text"].cast("string"), F.lit(""))
    lines = F.array_remove(F.split(F.regexp_replace(text, _BLANK_LINE, ""), "\n", -1), "")
    flat = F.trim(F.regexp_replace(text, SPACE + "+", " "))
    counted = docs.select(
        docs["doc_id"].cast("bigint").alias("doc_id"),
        docs["lang"].cast("string").alias("lang") if "lang" in docs.columns else F.lit(None).cast("string").alias("lang"),
        docs["source"].cast("string").alias("source") if "source" in docs.columns else F.lit(None).cast("string").alias("source"),
        text.alias("_text"), lines.alias("_lines"), F.regexp_extract_all(flat, F.lit(_WINDOWS), 1).alias("_windows"))
    return counted.select(
        "doc_id", "lang", "source",
        F.regexp_count("_text", F.lit(WORD + "+")).cast("bigint").alias("n_words"),
        F.length(F.regexp_replace("_text", SPACE, "")).cast("bigint").alias("word_chars"),
        (F.length("_text") - F.length(F.regexp_replace("_text", SYMBOLS, ""))).cast("bigint").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("bigint").alias("n_dup_lines"),
        F.size("_lines").cast("bigint").alias("n_word_lines"),
        F.when(F.size(F.array_distinct("_windows")) < F.size("_windows"), _covered(F.col("_windows")))
        .otherwise(F.lit(0)).cast("bigint").alias("n_repeat_words"),
    )


# A line without a word (only white space other than \n); the windows: each word start with the two words after it.
_BLANK_LINE = r"(?m)^[\x20\x09\x0B\x0C\x0D]*$"
_WINDOWS = r"(?:^| )(?=([^ ]+ [^ ]+ [^ ]+))"


def _covered(windows: Column) -> Column:
    """Word positions covered by a 3-word window that occurs at least twice in the text.

    Windows are sorted with their start; a window repeats when a sorted neighbour is
    equal. The covered positions are the union of each repeating window's three words.
    The sorted array is bound once (``let``); a higher-order body would otherwise sort again per element.
    """
    tagged = F.transform(windows, lambda w, i: F.struct(w.alias("w"), i.alias("i")))

    def repeated(ordered: Column) -> Column:
        last = F.size(ordered) - 1
        same = lambda a, b: F.get(ordered, a)["w"] == F.get(ordered, b)["w"]
        repeating = F.filter(F.sequence(F.lit(0), last), lambda k: ((k > 0) & same(F.greatest(k - 1, F.lit(0)), k))
                             | ((k < last) & same(F.least(k + 1, last), k)))
        starts = F.transform(repeating, lambda k: F.get(ordered, k)["i"])
        return F.size(F.array_distinct(F.flatten(F.transform(starts, lambda i: F.sequence(i, i + (WINDOW - 1))))))

    return let(F.sort_array(tagged), repeated)


def with_ratios(counts: DataFrame) -> DataFrame:
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    words = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    return counts.select(
        "*", failed.alias("base_failed"),
        (F.col("word_chars") / words).alias("word_length"),
        (F.col("n_symbols") / words).alias("symbol_ratio"),
        (F.col("n_dup_lines") / F.greatest(F.col("n_word_lines"), F.lit(1)).cast("double")).alias("dup_line_ratio"),
        (F.col("n_repeat_words") / words).alias("repeat_ratio"))


def thresholds(scored: DataFrame, far: float = 3.0, floor: float = 0.05, accuracy: int = 10000) -> DataFrame:
    """Fences per (lang, source), per lang and overall from quantile sketches of passing documents.

    ``level`` is 0 for (lang, source), 1 for lang, 3 for all (``grouping_id`` of a rollup).
    """
    passing = scored.where(~F.col("base_failed"))
    sketches = [F.percentile_approx(r, [0.25, 0.5, 0.75], accuracy).alias(r) for r in RATIOS]
    cube = passing.rollup("lang", "source").agg(F.grouping_id().alias("level"), F.count("*").alias("n_docs"), *sketches)
    fences = []
    for r in RATIOS:
        q25, q50, q75 = F.col(r)[0], F.col(r)[1], F.col(r)[2]
        spread = F.greatest(q75 - q25, F.lit(floor) * F.greatest(F.abs(q50), F.lit(1.0)))
        fences += [(q75 + far * spread).alias(f"{r}_hi"), (q25 - far * spread).alias(f"{r}_lo")]
    return cube.select("lang", "source", "level", "n_docs", *fences)


def resolved(fences: DataFrame, min_group: int) -> DataFrame:
    """One row of fences per (lang, source): its own if it has ``min_group`` documents, else its lang's, else all.

    The fences are stored first (one row per group); the single overall row is read back
    and enters as literals, so no join with a constant key is planned.
    """
    names = [f"{r}_{e}" for r in RATIOS for e in ("hi", "lo")]
    stored = materialise(fences, "quality-fences")
    overall = stored.where(F.col("level") == 3).select(*names).collect()
    every = overall[0].asDict() if overall else dict.fromkeys(names)
    own = stored.where(F.col("level") == 0).alias("p")
    lang = stored.where(F.col("level") == 1).alias("l")
    both = own.join(lang, F.col("p.lang").eqNullSafe(F.col("l.lang")), "left")
    pick = [F.when(F.col("p.n_docs") >= min_group, F.col(f"p.{c}"))
            .when(F.col("l.n_docs") >= min_group, F.col(f"l.{c}")).otherwise(F.lit(every[c]).cast("double")).alias(c) for c in names]
    level = F.when(F.col("p.n_docs") >= min_group, 0).when(F.col("l.n_docs") >= min_group, 1).otherwise(3)
    return both.select(F.col("p.lang").alias("lang"), F.col("p.source").alias("source"), level.alias("level"), *pick)


def judged(docs: DataFrame, min_group: int = 50, far: float = 3.0, salts: int = 32) -> DataFrame:
    """Every document row with its base counts, ``base_failed``, ``kept``, its ratios and the level of its fences."""
    scored = materialise(with_ratios(base_counts(docs)), "quality-counts")
    fences = resolved(thresholds(scored, far=far), min_group)
    rows = scored.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "n_words", "word_chars"), F.lit(salts)).cast("int"))
    copies = fences.select(*[F.col(c).alias(f"_t_{c}") for c in fences.columns]).withColumn(
        "_t_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    joined = rows.join(copies, (F.col("_t_salt") == F.col("_salt")) & F.col("_t_lang").eqNullSafe(F.col("lang"))
                       & F.col("_t_source").eqNullSafe(F.col("source")), "left")
    inside = F.col("word_length") >= F.col("_t_word_length_lo")
    for r in RATIOS:
        inside = inside & (F.col(r) <= F.col(f"_t_{r}_hi"))
    kept = F.when(F.col("base_failed"), F.lit(False)).otherwise(F.coalesce(inside, F.lit(True)))
    return joined.select(*COLUMNS[:-1], kept.alias("kept"), *RATIOS, F.col("_t_level").alias("fence_level"))
