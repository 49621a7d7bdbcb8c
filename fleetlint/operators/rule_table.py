"""Rule packs as data: any number of rules scanned by one plan.

A rule is a row (``pack, rule_id, severity, pattern, message, fix, extensions,
ignore_case, multiline``), so user packs of thousands of rules do not grow the query
plan. Patterns are checked by a pass over the rule rows in tasks (:func:`checked`):
a pattern that does not compile is reported with its reason and takes no part; no Spark
job is started per rule.

The scan has a single prefilter for all rules: from each parsed pattern comes a set of
literals of which every match contains one (:func:`required_literals`), lower-cased;
one Aho-Corasick automaton over all of them, built once per Python worker from the
broadcast rule rows (bounded by the rule count), names the candidate rules of a text in
one pass. Rules without such literals are candidates of every text. Candidates then run
in Python's engine (the engine the patterns are written for), leftmost and
non-overlapping, as ``re.finditer`` does. Texts that hold letters whose case folding
reaches ASCII (Kelvin sign, long s, dotted and dotless i) skip the prefilter.

Result rows: ``repo, path, pack, rule_id, severity, line, match`` (first ``match_chars``
characters), ``match_end`` (last four), ``match_key`` (SHA-256 of the whole match). Null
texts have no matches; files are those the pattern layer reads (source suffixes outside
skipped folders), further gated by a rule's extensions.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlint.catalog.rules import Rule
from fleetlint.functions.tables import find_package
from fleetlint.operators import walk

RULE_SCHEMA = ("pack string, rule_id string, severity string, pattern string, message string, fix string, "
               "extensions array<string>, ignore_case boolean, multiline boolean")
HIT_SCHEMA = ("repo string, path string, pack string, rule_id string, severity string, line int, match string, "
              "match_end string, match_key string")
MATCH_CHARS = 120
MIN_LITERAL = 3
_ODD = "İıſK"


def rules_table(spark: SparkSession, packs: dict) -> DataFrame:
    """The rules of ``packs`` (``name -> {"extends", "rules"}``) as rows; a pack's rows include those it extends."""
    from fleetlint.operators.packs import pack_rules

    rows = [(name, r.rule_id, r.severity, r.pattern, r.message, r.fix, list(r.extensions) if r.extensions else None,
             r.ignore_case, r.multiline) for name in packs for r in pack_rules(name, packs)]
    return spark.createDataFrame(rows, RULE_SCHEMA)


def as_rules(rules: Iterable[Rule], pack: str) -> list[tuple]:
    return [(pack, r.rule_id, r.severity, r.pattern, r.message, r.fix, list(r.extensions) if r.extensions else None,
             r.ignore_case, r.multiline) for r in rules]


def _flags(ignore_case, multiline) -> int:
    return (re.I if ignore_case else 0) | (re.M if multiline else 0)


def checked(rules: DataFrame) -> DataFrame:
    """The rule rows with ``problem`` (null for a usable pattern) and ``literals`` of the prefilter."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            problems, literals = [], []
            for pattern, ic, ml in zip(*(batch.column(c).to_pylist() for c in ("pattern", "ignore_case", "multiline"))):
                try:
                    re.compile(pattern or "", _flags(ic, ml))
                    problems.append(None if pattern else "empty pattern")
                    literals.append(required_literals(pattern, bool(ic)) if pattern else None)
                except (re.error, RecursionError, OverflowError) as error:
                    problems.append(str(error))
                    literals.append(None)
            yield batch.append_column("problem", pa.array(problems, pa.string())).append_column(
                "literals", pa.array(literals, pa.list_(pa.string())))

    find_package(rules.sparkSession)
    return rules.mapInArrow(run, RULE_SCHEMA + ", problem string, literals array<string>")


def rejected(rules: DataFrame) -> DataFrame:
    """``pack, rule_id, problem`` of the rules whose pattern cannot be used."""
    return checked(rules).where(F.col("problem").isNotNull()).select("pack", "rule_id", "problem")


def required_literals(pattern: str, ignore_case: bool = True) -> list[str] | None:
    """Literals of which every match of ``pattern`` contains one, lower-cased; None if there are none."""
    try:
        from re import _parser as parser
    except ImportError:  # Python before 3.11
        import sre_parse as parser
    from re import _constants as c

    def seq(items) -> list[str] | None:
        best, run = None, []

        def close():
            nonlocal best, run
            if len(run) >= MIN_LITERAL:
                best = pick(best, ["".join(run)])
            run = []

        for op, arg in items:
            if op is c.LITERAL:
                run.append(chr(arg))
                continue
            close()
            if op is c.SUBPATTERN:
                best = pick(best, seq(arg[-1]))
            elif op in (c.MAX_REPEAT, c.MIN_REPEAT, getattr(c, "POSSESSIVE_REPEAT", None)) and arg[0] >= 1:
                best = pick(best, seq(arg[2]))
            elif op is c.BRANCH:
                branches = [seq(b) for b in arg[1]]
                if all(branches):
                    best = pick(best, sorted({x for b in branches for x in b}))
            elif op is getattr(c, "ATOMIC_GROUP", None):
                best = pick(best, seq(arg))
        close()
        return best

    def pick(a, b):
        if not b:
            return a
        if not a:
            return b
        return a if min(map(len, a)) >= min(map(len, b)) else b

    found = seq(parser.parse(pattern, re.I if ignore_case else 0))
    if not found or not all(x.isascii() for x in found):
        return None  # no literal, or letters whose case folding lower() does not follow
    return sorted({x.lower() for x in found})


def scan_table(files: DataFrame, rules: DataFrame, match_chars: int = MATCH_CHARS) -> DataFrame:
    """Every match of every usable rule in the files the pattern layer reads (see the module)."""
    spark = files.sparkSession
    usable = [tuple(r) for r in checked(rules).where(F.col("problem").isNull()).select(
        "pack", "rule_id", "severity", "pattern", "extensions", "ignore_case", "multiline", "literals").collect()]
    shared = spark.sparkContext.broadcast(usable)
    texts = files.where(walk.is_rule_source() & F.col("content").isNotNull()).select("repo", "path", "suffix", "content")

    def run(batches):
        import ahocorasick
        import pyarrow as pa

        rows = shared.value
        compiled = [re.compile(p, _flags(ic, ml)) for _, _, _, p, _, ic, ml, _ in rows]
        always = [i for i, r in enumerate(rows) if not r[7]]
        owners = {}
        for i, r in enumerate(rows):
            for literal in r[7] or ():
                owners.setdefault(literal, []).append(i)
        automaton = ahocorasick.Automaton()
        for literal, ids in owners.items():
            automaton.add_word(literal, tuple(ids))
        if len(automaton):
            automaton.make_automaton()
        names = HIT_SCHEMA.replace(" string", "").replace(" int", "").split(", ")
        for batch in batches:
            out = {n: [] for n in names}
            for repo, path, suffix, text in zip(*(batch.column(c).to_pylist() for c in ("repo", "path", "suffix", "content"))):
                if any(ch in text for ch in _ODD) or not len(automaton):
                    candidates = range(len(rows))
                else:
                    hit = set(always)
                    for _, ids in automaton.iter(text.lower()):
                        hit.update(ids)
                    candidates = sorted(hit)
                for i in candidates:
                    pack, rule_id, severity, _, extensions, _, _, _ = rows[i]
                    if extensions and suffix not in extensions:
                        continue
                    line, last = 1, 0
                    for m in compiled[i].finditer(text):
                        line += text.count("\n", last, m.start())
                        last = m.start()
                        whole = m.group(0)
                        for n, v in zip(names, (repo, path, pack, rule_id, severity, line, whole[:match_chars], whole[-4:],
                                                hashlib.sha256(whole.encode("utf-8", "surrogatepass")).hexdigest())):
                            out[n].append(v)
            yield pa.RecordBatch.from_pydict(out, schema=pa.schema(
                [(n, pa.int32() if n == "line" else pa.string()) for n in names]))

    find_package(spark)
    return texts.mapInArrow(run, HIT_SCHEMA)
