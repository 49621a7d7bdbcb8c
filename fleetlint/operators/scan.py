"""The rule scan: any set of rules over all texts in one pass.

Plan of one scan: paths decide which rules may look at a file; the words that rules need are
collected in one pass over the lower-cased text, which drops most of those; what is left is one row per (file, rule),
and one regular expression runs on each. Texts are read once and never shuffled;
what leaves the scan are narrow hits.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlint.catalog import paths
from fleetlint.catalog.rules import ALWAYS_SETS, PATTERN_RULES, SET_CATEGORIES, Rule
from fleetlint.functions import regex
from fleetlint.functions.tables import sql_literal, values_table
from fleetlint.operators import walk
from fleetlint.plans.skew import join_per_repo

MATCH_CHARS = 120  # fixed value: how much of a match is shown

# Suffixes each kind of rule can look at, as a plain test that parquet can check on a
# stored ``suffix`` column; the exact tests follow.
_SUFFIXES = {
    "pattern": paths.SOURCE_SUFFIXES,
    "secret": paths.SECRET_SUFFIXES,
    "auth": paths.CODE_SUFFIXES,
    "trap": paths.CODE_SUFFIXES,
    "service": paths.CODE_SUFFIXES,
    "critical_path": walk.RATIO_SUFFIXES,
    "test": walk.TEST_SUFFIXES,
}

# Which files each kind of rule looks at.
_ELIGIBLE = {
    "pattern": walk.is_rule_source,
    "secret": walk.is_secret_source,
    "auth": walk.is_code,
    "trap": walk.is_code,
    "service": walk.is_code,
    "critical_path": walk.is_ratio_source,
    "test": lambda: F.size("test_langs") > 0,
    "text": lambda: F.lit(True),
}


def scan(files: DataFrame, rules: Sequence[Rule], match_chars: int = MATCH_CHARS,
         carry: Sequence[str] = ()) -> DataFrame:
    """``repo, path, test_langs, rule_ix, line, match, match_end, match_key`` plus the columns in ``carry``.

    One row per match; rules that only ask for existence give one row per file with
    neither line nor match. ``match_key`` is the SHA-256 of the whole match. ``rule_ix`` is the position in ``rules``. Where ``files``
    has a flag ``in_first``, pattern rules read flagged files only.
    """
    kinds = sorted({rule.kind for rule in rules})
    eligible = dict(_ELIGIBLE)
    if "in_first" in files.columns:
        eligible["pattern"] = lambda: walk.is_rule_source() & F.col("in_first")
    by_path = files.withColumn("test_langs", walk.test_languages()) if "test" in kinds else files.withColumn(
        "test_langs", walk.strings(()))
    if all(kind in _SUFFIXES for kind in kinds):
        suffixes = sorted({suffix for kind in kinds for suffix in _SUFFIXES[kind]})
        named = F.col("suffix").isin(*suffixes)
        by_path = by_path.where(named | F.col("name").startswith(".env") if "secret" in kinds else named)
    by_path = by_path.where(reduce(lambda a, b: a | b, [eligible[k]() for k in kinds]))
    texts = by_path.select(
        *dict.fromkeys(["repo", "path", "suffix", *carry]), "test_langs", "content",
        regex.words_in(F.lower("content"), regex.needed_words(rules)).alias("_lower"),
        regex.has_odd_letters(F.col("content")).alias("_odd"),
        *[eligible[k]().alias(f"_{k}") for k in kinds],
    )

    def wanted(rule: Rule) -> str:
        tests = [f"_{rule.kind}"]
        if rule.extensions is not None:
            tests.append("suffix IN (" + ", ".join(sql_literal(e) for e in rule.extensions) + ")")
        if rule.kind == "critical_path":
            return " AND ".join(tests + [regex.any_word("lower(path)", rule.needs[0]),
                                         regex.any_word("_lower", rule.needs[0])])
        tests.append(regex.may_match(rule) or "content IS NOT NULL")
        if rule.exists_only and regex.runs_in_jvm(rule):
            tests.append(regex.found_in(rule))
        return " AND ".join(tests)

    def pairs(chosen) -> DataFrame:
        candidates = F.expr("array_compact(array(" + ", ".join(
            f"CASE WHEN {wanted(rule)} THEN {i} END" for i, rule in chosen) + "))")
        return texts.select("repo", "path", *carry, "test_langs", "content", F.explode(candidates).alias("rule_ix"))

    numbered = list(enumerate(rules))
    native = [(i, rule) for i, rule in numbered if regex.runs_in_jvm(rule)]
    in_python = [(i, rule) for i, rule in numbered if not regex.runs_in_jvm(rule)]
    keep = ["repo", "path", *carry, "test_langs", "rule_ix"]
    branches = []
    if native:
        branches.append(_native_hits(pairs(native), native, keep, match_chars))
    if in_python:
        # Only rules of user packs that repeat a group and state no form for the JVM.
        position = F.array_position(F.array(*[F.lit(i) for i, _ in in_python]), F.col("rule_ix")) - 1
        match = regex.python_matches([rule for _, rule in in_python], match_chars)
        branches.append(pairs(in_python).select(*keep, F.inline(match(position, F.col("content")))))
    return reduce(DataFrame.unionByName, branches)


def _native_hits(pairs: DataFrame, rules, keep: Sequence[str], match_chars: int) -> DataFrame:
    nothing = F.array(F.struct(
        F.lit(None).cast("int").alias("line"), F.lit(None).cast("string").alias("match"),
        F.lit(None).cast("string").alias("match_end"), F.lit(None).cast("string").alias("match_key")))
    scanned = [(i, rule) for i, rule in rules if not rule.exists_only]
    if not scanned:
        return pairs.select(*keep, F.inline(nothing))
    pieces = F.expr("CASE rule_ix " + " ".join(
        f"WHEN {i} THEN {regex.match_pieces(rule)}" for i, rule in scanned) + " END")
    found = F.when(F.col("_pieces").isNull(), nothing).otherwise(regex.match_rows(F.col("_pieces"), match_chars))
    # The generator holds the expression itself: on a named column Spark would add a
    # size filter and evaluate the regular expressions twice.
    return pairs.select(*keep, pieces.alias("_pieces")).select(*keep, F.inline(found))


def rule_table(spark, rules: Sequence[Rule]) -> DataFrame:
    """The catalog of a scan as a table, one row per rule."""
    return values_table(
        spark, ("rule_ix", "kind", "rule_set", "rule", "severity", "message", "fix"),
        [(i, r.kind, r.rule_set, r.rule_id, r.severity, r.message, r.fix) for i, r in enumerate(rules)])


def with_rule(hits: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Attach the catalog columns (a fixed number of rows, safe to broadcast)."""
    return hits.join(F.broadcast(rule_table(hits.sparkSession, rules)), "rule_ix")


def scan_rules(files: DataFrame, rules: Sequence[Rule], **options) -> DataFrame:
    """:func:`scan` with the catalog columns attached."""
    return with_rule(scan(files, rules, **options), rules)


def pattern_findings(hits: DataFrame, language_names: DataFrame, dedupe: bool = False) -> DataFrame:
    """Rule hits of the sets each repository uses, one row per category.

    General, performance and database rules always count. A language's rules count
    where the language was detected; JavaScript rules count once for JavaScript and
    once for TypeScript unless ``dedupe`` is set. The narrow hits meet the stack
    after the scan, so that texts need not be shuffled by repository.
    """
    sets = F.create_map(*[x for name, cats in SET_CATEGORIES.items() for x in (F.lit(name), walk.strings(cats))])
    used = F.array_intersect(F.element_at(sets, F.col("rule_set")), F.col("language_names"))
    used = F.coalesce(used, walk.strings(()))
    if dedupe:
        used = F.slice(used, 1, 1)
    category = F.when(F.col("rule_set").isin(*ALWAYS_SETS), F.array("rule_set")).otherwise(used)
    joined = join_per_repo(hits, language_names, spread=["path"])
    return joined.select(
        "repo", "rule", F.explode(category).alias("category"), "severity", "message", "fix",
        F.col("path").alias("file"), "line", "match", "match_key")


def scan_project(files: DataFrame, language_names: DataFrame, rules: Sequence[Rule] = PATTERN_RULES,
                 max_files: int | None = None, dedupe: bool = False, match_chars: int = MATCH_CHARS) -> DataFrame:
    """The pattern layer over all sources, or the first ``max_files`` of each repository if that is given."""
    if max_files is not None:
        files = mark_first_files(files, max_files)
    hits = scan_rules(files, rules, match_chars=match_chars)
    return pattern_findings(hits, language_names, dedupe)


# Repositories up to this number are broadcast with their cutoff: about 20 MB.
MAX_BROADCAST_REPOS = 100_000


def mark_first_files(files: DataFrame, n: int) -> DataFrame:
    """Add ``in_first``: not after the first ``n`` rule sources of the repository.

    Repositories are counted first, from paths alone; only those with more than ``n``
    sources are ranked. When they are few, their cutoffs are broadcast and the texts
    stay where they are; otherwise the join is by repository, salted.
    """
    large = walk.large_repos(files, n)
    count = large.limit(MAX_BROADCAST_REPOS + 1).count()
    if count == 0:
        return files.withColumn("in_first", F.lit(True))
    small = count <= MAX_BROADCAST_REPOS
    ranked = files.join(F.broadcast(large) if small else large, "repo", "left_semi")
    cutoffs = walk.file_cutoffs(ranked, n)
    joined = (
        files.join(F.broadcast(cutoffs), "repo", "left") if small
        else join_per_repo(files, cutoffs, spread=["path"])
    )
    return joined.withColumn("in_first", walk.within_cutoff()).drop("last_path")
