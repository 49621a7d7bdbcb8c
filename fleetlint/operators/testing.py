"""Test-quality layer: ratio, kinds, smells, and critical files that no test mentions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlint.catalog import testing
from fleetlint.catalog.rules import WARNING, Rule
from fleetlint.functions.regex import bind
from fleetlint.functions.text import contains_any, percent_1
from fleetlint.operators import walk
from fleetlint.plans.skew import join_per_repo

# One existence rule per category: a word in the text and a word in the path.
CRITICAL_RULES = tuple(
    Rule("critical_path", "critical_path", category, WARNING, "|".join(words), needs=(words,), exists_only=True)
    for category, words in testing.CRITICAL_WORDS.items()
)


def _counts_as_source(suffix: Column, languages: Column) -> Column:
    found = F.lit(False)
    for language, suffixes in testing.RATIO_SUFFIXES.items():
        found = found | (F.array_contains(languages, language) & suffix.isin(*suffixes))
    return found


def test_files(files: DataFrame, language_names: DataFrame) -> DataFrame:
    """``repo, path`` of the files that are tests for their repository's languages."""
    candidates = files.select("repo", "path", walk.test_languages().alias("test_langs")).where(F.size("test_langs") > 0)
    return _keep_tests(candidates, language_names).select("repo", "path")


def _keep_tests(rows: DataFrame, language_names: DataFrame, spread: str = "path") -> DataFrame:
    joined = join_per_repo(rows, language_names, spread=[spread])
    known = F.coalesce("language_names", walk.strings(()))
    return joined.where(walk.is_test_for(F.col("test_langs"), known)).drop("language_names")


def test_counts(files: DataFrame, language_names: DataFrame) -> DataFrame:
    """Source and test counts, ratio, band and kinds of tests of every repository.

    One pass over paths: files are grouped by repository and by what decides about
    them (suffix, test languages, kinds), so the join with the languages and the final
    sums see a few rows per repository, whatever its size.
    """
    lower = F.lower("path")
    kinds = {kind: contains_any(lower, words) for kind, words in testing.TEST_KIND_WORDS.items()}
    groups = (
        files.select(
            "repo", "suffix", walk.is_ratio_source().alias("source"), walk.test_languages().alias("test_langs"),
            *[test.alias(kind) for kind, test in kinds.items()])
        .groupBy("repo", F.when(F.col("source"), F.col("suffix")).alias("suffix"), "test_langs", *kinds)
        .agg(F.count("*").alias("n"))
    )
    known = F.coalesce("language_names", walk.strings(()))
    is_source = F.col("suffix").isNotNull() & _counts_as_source(F.col("suffix"), known)
    is_test = walk.is_test_for(F.col("test_langs"), known)
    counts = (
        groups.join(language_names, "repo", "left")
        .groupBy("repo").agg(
            F.sum(F.when(is_source, F.col("n")).otherwise(0)).alias("source_file_count"),
            F.sum(F.when(is_test, F.col("n")).otherwise(0)).alias("test_file_count"),
            *[F.coalesce(F.bool_or(is_test & F.col(kind)), F.lit(False)).alias(f"has_{kind}_tests") for kind in kinds])
    )
    ratio = percent_1(F.col("test_file_count"), F.greatest("source_file_count", F.lit(1)))
    band = F.when(F.col("test_ratio_percent") == 0, "none")
    for bound, name in testing.COVERAGE_BANDS:
        band = band.when(F.col("test_ratio_percent") < bound, name)
    missing = F.array_compact(F.array(*[F.when(~F.col(f"has_{kind}_tests"), F.lit(kind)) for kind in kinds]))
    return (
        counts.withColumn("test_ratio_percent", ratio)
        .withColumn("coverage_estimate", band.otherwise(testing.COVERAGE_TOP))
        .withColumn("missing_test_types", missing)
    )


def smell_findings(hits: DataFrame, language_names: DataFrame) -> DataFrame:
    """Hits of the test rules in files that are tests for their repository."""
    rows = _keep_tests(hits.where(F.col("kind") == "test"), language_names)
    return rows.select(
        "repo", F.lit("test_anti_pattern").alias("type"), "rule", F.col("path").alias("file"), "line",
        "severity", "message", "fix")


def critical_files(hits: DataFrame, language_names: DataFrame) -> DataFrame:
    """``repo, path, stem, category`` of critical source files (hits carry suffix and stem)."""
    rows = hits.where(F.col("kind") == "critical_path")
    joined = join_per_repo(rows, language_names, spread=["path"])
    known = F.coalesce("language_names", walk.strings(()))
    return joined.where(_counts_as_source(F.col("suffix"), known)).select(
        "repo", "path", F.lower("stem").alias("stem"), F.col("rule").alias("category"))


# Characters of ordinary file stems; a stem of these lies inside one run of them.
_PLAIN = r"[\w.\-]"
_ALL_PLAIN = f"(?U)^{_PLAIN}+$"
_ANY = r"[^\n]"
# A run is read in steps, each with as many characters behind it as the longest stem has,
# so every substring of up to that length lies inside one piece.
_PIECES = r"(?U)(?=({0}{{1,%d}})){0}{{1,%d}}"
_LEAST_STEP = 256
# Unusual characters of stems up to this number are looked for in pieces before these are moved.
MAX_ANCHORS = 100


def _substrings(piece: Column, lengths: Column) -> Column:
    """All substrings of a piece whose length is one of ``lengths``."""
    fitting = F.filter(lengths, lambda n: n <= F.length(piece))
    return F.flatten(F.transform(fitting, lambda n: F.transform(
        F.sequence(F.lit(1), F.length(piece) - n + 1), lambda i: F.substring(piece, i, n))))


def _anchored(piece: Column, shapes: Column) -> Column:
    """Substrings of a piece with one of the ``shapes`` (anchor character, its offset, length)."""
    usable = F.filter(shapes, lambda s: piece.contains(s["anchor"]) & (s["n"] <= F.length(piece)))

    def cut(chars: Column, s: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.size(chars) - s["n"]),
                          lambda i: F.get(chars, i + s["offset"]) == s["anchor"])
        return F.transform(starts, lambda i: F.array_join(F.slice(chars, i + 1, s["n"]), ""))

    return F.when(F.size(usable) > 0, bind(
        F.split(piece, ""), lambda chars: F.flatten(F.transform(usable, lambda s: cut(chars, s)))))


def mentioned_stems(critical: DataFrame, files: DataFrame, language_names: DataFrame, plain: bool) -> DataFrame:
    """``repo, stem``: critical stems that are part of some test text of their repository.

    A join on "text contains stem" would pair every test with every stem of a
    repository. Instead test texts are cut into runs of stem characters, distinct runs
    into substrings of the lengths that occur among the repository's stems, and those
    meet the stems by equality. The work grows with the texts, not with pairs.

    Stems with other characters need whole lines as runs; there only substrings with
    such a character at the right place are formed.
    """
    is_plain = F.col("stem").rlike(_ALL_PLAIN)
    stems = critical.where(is_plain if plain else ~is_plain).select("repo", "stem").distinct()
    offset = F.length(F.regexp_extract("stem", f"(?U)^{_PLAIN}*", 0))
    anchor = F.substring(F.col("stem"), offset + 1, F.lit(1))
    bounds = stems.agg(F.min(F.length("stem")), F.max(F.length("stem"))).first()
    shortest, longest = bounds[0] or 1, bounds[1] or 1
    step = max(_LEAST_STEP, longest)
    shape = F.length("stem") if plain else F.struct(
        anchor.alias("anchor"), offset.alias("offset"), F.length("stem").alias("n"))
    shapes = stems.groupBy("repo").agg(F.collect_set(shape).alias("shapes"))
    pieces = F.regexp_extract_all(
        F.lower("content"), F.lit((_PIECES % (step + longest, step)).format(_PLAIN if plain else _ANY)), 1)
    # a piece that no stem fits in is left out before pieces are moved
    fits, has_anchor = F.length("piece") >= shortest, F.lit(True)
    if not plain:
        anchors = [row[0] for row in stems.select(anchor).distinct().limit(MAX_ANCHORS + 1).collect()]
        if len(anchors) <= MAX_ANCHORS:
            fits, has_anchor = fits & contains_any(F.col("piece"), anchors), contains_any(F.lower("content"), anchors)
    tests = (
        files.withColumn("test_langs", walk.test_languages())
        .where(F.col("suffix").isin(*walk.TEST_SUFFIXES) & (F.size("test_langs") > 0) & F.col("content").isNotNull() & has_anchor)
        .select("repo", "test_langs", F.explode(F.array_distinct(pieces)).alias("piece"))
        .where(fits)
        .distinct()
    )
    known = shapes.join(language_names, "repo", "left")
    kept = join_per_repo(tests, known, spread=["piece"], how="inner").where(
        walk.is_test_for(F.col("test_langs"), F.coalesce("language_names", walk.strings(()))))
    parts = (_substrings if plain else _anchored)(F.col("piece"), F.col("shapes"))
    found = kept.select("repo", F.explode(parts).alias("stem"))
    return stems.join(found.distinct(), ["repo", "stem"], "left_semi")


def untested_findings(critical: DataFrame, files: DataFrame, language_names: DataFrame) -> DataFrame:
    """Critical files whose stem occurs in no test of the repository.

    ``critical`` should be a stored table: it is read several times. The pass for stems
    with unusual characters is planned only where such stems exist.
    """
    mentioned = mentioned_stems(critical, files, language_names, plain=True)
    if not critical.where(~F.col("stem").rlike(_ALL_PLAIN)).isEmpty():
        mentioned = mentioned.unionByName(mentioned_stems(critical, files, language_names, plain=False))
    return (
        critical.join(mentioned, ["repo", "stem"], "left_anti")
        .select("repo", F.lit("untested_critical_path").alias("type"), "category", F.col("path").alias("file"),
                F.lit(WARNING).alias("severity"),
                F.format_string("No test mentions this %s code.", "category").alias("message"),
                F.format_string("Test the %s logic of this file.", "category").alias("fix"))
    )


def test_summary(counts: DataFrame, toolchain: DataFrame, untested: DataFrame, smells: DataFrame) -> DataFrame:
    """All numbers of the layer, one row per repository."""
    none = walk.strings(())
    return (
        counts.join(toolchain.select("repo", "test_runners"), "repo", "left")
        .join(untested.groupBy("repo").agg(F.count("*").alias("untested_critical_paths")), "repo", "left")
        .join(smells.groupBy("repo").agg(F.count("*").alias("test_anti_patterns")), "repo", "left")
        .withColumn("test_runners", F.coalesce("test_runners", none))
        .na.fill(0, ["untested_critical_paths", "test_anti_patterns"])
        .withColumn("total_findings", F.col("untested_critical_paths") + F.col("test_anti_patterns")
                    + F.size("missing_test_types"))
    )
