"""Rule packs: built-in ones and YAML folders, with ``extends``."""

from __future__ import annotations

import re
from collections.abc import Sequence
from pathlib import Path

from pyspark.errors import PySparkException
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from fleetlint.catalog.packs import PACKS
from fleetlint.catalog.rules import Rule
from fleetlint.functions.regex import java_pattern, runs_in_jvm


def pack_rules(name: str, packs: dict = PACKS) -> tuple[Rule, ...]:
    """The rules of a pack and of the pack it extends; on equal ids the child wins."""
    chain, seen = [], set()
    while name is not None:
        if name in seen:
            raise ValueError(f"pack {name!r} extends itself")
        seen.add(name)
        chain.append(packs[name])
        name = packs[name].get("extends")
    merged: dict[str, Rule] = {}
    for pack in reversed(chain):
        merged.update({rule.rule_id: rule for rule in pack["rules"]})
    return tuple(merged.values())


def load_packs(folder: str, spark: SparkSession | None = None) -> tuple[dict, list[tuple[str, str, str]]]:
    """Read ``*.yaml`` packs; rules with a bad pattern are left out and reported.

    Returns the packs and ``(pack, rule, problem)`` rows. A pack is a mapping with
    ``name``, optional ``extends`` and ``patterns: {rule_id: {pattern, severity,
    message, fix, extensions}}``. Patterns are tried in the JVM of ``spark``, or of the
    active session, so that one bad rule cannot fail the scan of all.
    """
    import yaml  # an optional dependency, needed for YAML packs only

    spark = spark or SparkSession.getActiveSession()
    packs, problems = {}, []
    for file in sorted(Path(folder).glob("*.yaml")):
        data = yaml.safe_load(file.read_text(encoding="utf-8")) or {}
        name, rules = data.get("name", file.stem), []
        for rule_id, body in (data.get("patterns") or {}).items():
            extensions = tuple(body["extensions"]) if body.get("extensions") else None
            rules.append(Rule("pattern", name, rule_id, body.get("severity", "info"), body["pattern"],
                              body.get("message", ""), body.get("fix", ""), extensions))
        good, bad = valid_rules(rules, spark)
        packs[name] = {"extends": data.get("extends"), "rules": good}
        problems += [(name, rule_id, why) for rule_id, why in bad]
    return packs, problems


def valid_rules(rules: Sequence[Rule], spark: SparkSession | None = None) -> tuple[tuple[Rule, ...], list[tuple[str, str]]]:
    """Split rules into usable ones and ``(rule_id, problem)``.

    A pattern must be valid Python; with a session it must compile in the JVM too
    (evaluated once on an empty text), unless Python's engine will run it.
    """
    good, bad = [], []
    for rule in rules:
        try:
            re.compile(rule.pattern)
            if spark is not None and runs_in_jvm(rule):
                spark.range(1).select(F.lit("").rlike(java_pattern(rule))).collect()
            good.append(rule)
        except re.error as error:
            bad.append((rule.rule_id, str(error)))
        except PySparkException as error:
            bad.append((rule.rule_id, str(error).split("\n", 1)[0]))
    return tuple(good), bad
