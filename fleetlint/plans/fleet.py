"""The whole analysis of a fleet: texts are scanned once, every layer draws on the hits."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlint.catalog.rules import AUTH, PATTERN_RULES, SECRETS, TEST_SMELLS, TRAPS
from fleetlint.catalog.services import SERVICE_RULES
from fleetlint.operators import (
    cost, dependencies, manifests, performance, report, scan, security, stack, testing,
)
from fleetlint.plans.storage import materialise

ALL_RULES = PATTERN_RULES + SECRETS + AUTH + TRAPS + SERVICE_RULES + TEST_SMELLS + testing.CRITICAL_RULES


class FleetScan:
    """Lazy tables of all seven layers over one ``files`` table.

    ``hits`` (one pass over all texts with every rule), ``languages``, ``deps``, ``stack`` and
    ``test_counts`` are written to the shared folder on first use, since several layers read them.
    """

    def __init__(self, files: DataFrame, max_files: int | None = None, dedupe: bool = False,
                 rules=ALL_RULES):
        self.files = files
        self.max_files = max_files
        self.dedupe = dedupe
        self.rules = tuple(rules)

    @cached_property
    def hits(self) -> DataFrame:
        files = self.files
        if self.max_files is not None:
            files = scan.mark_first_files(files, self.max_files)
        raw = scan.scan(files, self.rules, carry=("suffix", "stem"))
        return scan.with_rule(materialise(raw, "hits"), self.rules)

    @cached_property
    def deps(self) -> DataFrame:
        return materialise(manifests.dependencies(self.files), "deps")

    @cached_property
    def repos(self) -> DataFrame:
        return self.languages.select("repo")

    @cached_property
    def merged_deps(self) -> DataFrame:
        return manifests.merged_dependencies(self.deps)

    @cached_property
    def language_names(self) -> DataFrame:
        """What most layers need of the stack."""
        return self.languages.select("repo", F.transform("languages", lambda x: x["name"]).alias("language_names"))

    @cached_property
    def languages(self) -> DataFrame:
        return materialise(stack.languages(self.files), "languages")

    @cached_property
    def stack(self) -> DataFrame:
        return materialise(stack.stack(self.files, self.deps, self.languages), "stack")

    @cached_property
    def dependency_findings(self) -> DataFrame:
        return dependencies.dependency_findings(self.merged_deps)

    @cached_property
    def patterns(self) -> DataFrame:
        hits = self.hits.where(F.col("kind") == "pattern")
        return scan.pattern_findings(hits, self.language_names, self.dedupe)

    @cached_property
    def bundle(self) -> DataFrame:
        return dependencies.bundle_findings(self.deps)

    @cached_property
    def images(self) -> DataFrame:
        return performance.large_images(self.files)

    @cached_property
    def missing_optimizations(self) -> DataFrame:
        return performance.missing_optimizations(self.files, self.stack)

    @cached_property
    def secrets(self) -> DataFrame:
        return security.secret_findings(self.hits)

    @cached_property
    def dangerous_files(self) -> DataFrame:
        return security.dangerous_files(self.files)

    @cached_property
    def auth(self) -> DataFrame:
        return security.auth_findings(self.hits)

    @cached_property
    def services(self) -> DataFrame:
        return cost.service_findings(cost.env_evidence(self.files), cost.code_evidence(self.hits))

    @cached_property
    def traps(self) -> DataFrame:
        return cost.trap_findings(self.hits)

    @cached_property
    def critical_files(self) -> DataFrame:
        return materialise(testing.critical_files(self.hits, self.language_names), "critical")

    @cached_property
    def untested(self) -> DataFrame:
        return testing.untested_findings(self.critical_files, self.files, self.language_names)

    @cached_property
    def smells(self) -> DataFrame:
        return testing.smell_findings(self.hits, self.language_names)

    @cached_property
    def test_counts(self) -> DataFrame:
        """One row per repository, stored: the task queue reads it for its rows, its infos and their count."""
        return materialise(testing.test_counts(self.files, self.language_names), "test-counts")

    @cached_property
    def findings(self) -> DataFrame:
        """Every finding of every layer, in the common schema."""
        return report.union_findings({
            "dependencies": [self.dependency_findings],
            "patterns": [self.patterns],
            "performance": [self.bundle, self.images, self.missing_optimizations],
            "security": [self.secrets, self.dangerous_files, self.auth],
            "cost": [self.services, self.traps],
            "tests": [self.untested, self.smells],
        })

    @cached_property
    def stored_findings(self) -> DataFrame:
        """:attr:`findings`, written once for reports that read them several times."""
        return materialise(self.findings, "findings")

    @cached_property
    def summaries(self) -> DataFrame:
        """One wide row per repository."""
        stored = self.stored_findings
        layer = {name: stored.where(F.col("layer") == name) for name in report.REPORT_LAYERS}
        kind = {name: stored.where(F.col("type") == name) for name in (
            "cost_service", "scaling_trap", "untested_critical_path", "test_anti_pattern")}
        return report.summaries(
            self.stack,
            dependencies.dependency_summary(self.repos, self.merged_deps, layer["dependencies"]),
            security.security_summary(self.repos, layer["security"]),
            cost.cost_summary(self.repos, kind["cost_service"], kind["scaling_trap"]),
            performance.performance_summary(self.repos, layer["performance"]),
            testing.test_summary(self.test_counts, self.stack,
                                 kind["untested_critical_path"], kind["test_anti_pattern"]),
            layer["patterns"])

    @cached_property
    def tasks(self) -> DataFrame:
        return report.task_findings(self.stored_findings, self.test_counts)
