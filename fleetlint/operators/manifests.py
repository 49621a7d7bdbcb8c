"""Dependency manifests to ``deps(repo, ecosystem, name, version)``, in one pass.

Each manifest is one row and is parsed inside that row. The only shuffle carries the
parsed names of manifests, to pick one package.json and to drop repeated names.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlint.catalog import stacks
from fleetlint.functions import text
from fleetlint.functions.regex import to_java

_PACKAGE_JSON = "array<struct<dependencies: map<string,string>, devDependencies: map<string,string>>>"

# Where each ecosystem's manifests are; only package.json has alternatives.
_PATHS = {
    "js": stacks.PACKAGE_JSON_PATHS,
    "py": ("requirements.txt", "pyproject.toml"),
    "go": ("go.mod",),
    "cargo": ("Cargo.toml",),
}


def _package_json(content: Column) -> Column:
    """Names and versions, dev versions last; null where the text is no such object.

    The text is read as the only element of an array, so anything behind the object makes
    it unreadable. Entries of the maps are listed, not merged: a name may be repeated within
    a map, and the last one wins when the names of a repository are grouped.
    """
    parsed = F.from_json(F.concat(F.lit("["), content, F.lit("]")), _PACKAGE_JSON, {"allowSingleQuotes": "false"})
    keys = F.coalesce(F.json_object_keys(content), F.array().cast("array<string>"))
    none = F.array().cast("array<struct<name:string,version:string>>")

    def entries(json: Column, name: str) -> Column:
        return F.coalesce(F.transform(F.map_entries(json[name]), lambda e: F.struct(
            e["key"].alias("name"), e["value"].alias("version"))), none)

    def listed(pair: Column) -> Column:
        json = F.get(pair["parsed"], F.lit(0))
        unusable = [F.array_contains(pair["keys"], name) & json[name].isNull() for name in ("dependencies", "devDependencies")]
        return F.when((F.size(pair["parsed"]) == 1) & json.isNotNull() & ~unusable[0] & ~unusable[1],
                      F.concat(entries(json, "dependencies"), entries(json, "devDependencies")))

    pair = F.array(F.struct(parsed.alias("parsed"), keys.alias("keys")))
    return F.when(content.rlike(r"^\s*\{"), F.element_at(F.transform(pair, listed), 1))


def _requirements(content: Column, compatible_operator: bool) -> Column:
    cut = stacks.REQUIREMENT_CUT.replace("[>", "[~>", 1) if compatible_operator else stacks.REQUIREMENT_CUT
    stripped = F.transform(text.lines(content), text.strip)
    kept = F.filter(stripped, lambda s: (s != "") & ~s.startswith("#") & ~s.startswith("-"))
    names = F.transform(kept, lambda s: F.lower(text.strip(F.get(F.split(s, cut, 2), F.lit(0)))))
    return F.filter(names, lambda n: n != "")


def _pyproject(content: Column) -> Column:
    return F.transform(F.regexp_extract_all(content, F.lit(stacks.PYPROJECT_NAME), 1), F.lower)


def _go_mod(content: Column) -> Column:
    stripped = F.transform(text.lines(content), text.strip)
    kept = F.filter(stripped, lambda s: ~s.rlike("^(module|go |//)"))
    first = F.transform(kept, lambda s: F.get(F.split(s, "(?U)" + to_java(r"\s+"), 2), F.lit(0)))
    return F.filter(first, lambda w: w.contains("/"))


def _cargo_toml(content: Column) -> Column:
    """Keys below a ``[…dependencies…]`` head: a fold over the lines remembers the head."""
    start = F.struct(F.lit(False).alias("on"), F.array().cast("array<string>").alias("keys"))

    def state(on: Column, keys: Column) -> Column:
        return F.struct(on.alias("on"), keys.alias("keys"))

    def step(before: Column, line: Column) -> Column:
        key = F.regexp_extract(line, "(?U)" + to_java(stacks.CARGO_KEY), 1)
        return (
            F.when(line.rlike("(?d)" + stacks.CARGO_SECTION), state(F.lit(True), before["keys"]))
            .when(before["on"] & line.startswith("["), state(F.lit(False), before["keys"]))
            .when(before["on"] & (key != ""), state(before["on"], F.array_append(before["keys"], key)))
            .otherwise(before)
        )

    relevant = F.filter(text.lines(content), lambda line: line.startswith("[") | line.contains("="))
    return F.aggregate(relevant, start, step, lambda last: last["keys"])


def dependencies(files: DataFrame, ecosystems: Sequence[str] = tuple(_PATHS),
                 compatible_operator: bool = False) -> DataFrame:
    """One row per repository, ecosystem and name.

    JavaScript names come from the first package.json that can be read. With
    ``compatible_operator`` requirement lines are also cut at ``~`` (``x~=1`` gives ``x``).
    """
    path, content = F.col("path"), F.col("content")
    place = F.array_position(F.array(*[F.lit(p) for p in stacks.PACKAGE_JSON_PATHS]), path)

    def any_version(names: Column) -> Column:
        return F.transform(F.array_distinct(names), lambda n: F.struct(n.alias("name"), F.lit("*").alias("version")))

    parsed = (
        F.when(place > 0, _package_json(content))
        .when(path == "requirements.txt", any_version(_requirements(content, compatible_operator)))
        .when(path == "pyproject.toml", any_version(_pyproject(content)))
        .when(path == "go.mod", any_version(_go_mod(content)))
        .when(path == "Cargo.toml", any_version(_cargo_toml(content)))
    )
    ecosystem = F.element_at(F.create_map(*[
        F.lit(x) for name, paths in _PATHS.items() for p in paths for x in (p, name)]), path)
    manifests = (
        files.where(path.isin(*[p for name in ecosystems for p in _PATHS[name]]))
        .select("repo", ecosystem.alias("ecosystem"), F.when(place > 0, "package.json").otherwise(path).alias("manifest"),
                place.alias("place"), parsed.alias("entries"))
        .where(F.col("entries").isNotNull())
    )
    chosen = manifests.groupBy("repo", "ecosystem", "manifest").agg(F.min_by("entries", "place").alias("entries"))
    return (
        chosen.select("repo", "ecosystem", F.posexplode("entries").alias("place", "entry"))
        .groupBy("repo", "ecosystem", F.col("entry.name").alias("name")).agg(
            F.max_by("entry.version", "place").alias("version"))
    )


def package_json_deps(files: DataFrame) -> DataFrame:
    return dependencies(files, ("js",))


def python_deps(files: DataFrame, compatible_operator: bool = False) -> DataFrame:
    return dependencies(files, ("py",), compatible_operator)


def go_deps(files: DataFrame) -> DataFrame:
    return dependencies(files, ("go",))


def cargo_deps(files: DataFrame) -> DataFrame:
    return dependencies(files, ("cargo",))


def merged_dependencies(deps: DataFrame) -> DataFrame:
    """One row per repository and name; a name outside JavaScript takes the version ``*``."""
    return deps.groupBy("repo", "name").agg(
        F.when(F.bool_or(F.col("ecosystem") != "js"), F.lit("*"))
        .otherwise(F.max("version")).alias("version"))
