"""The same results in ANSI SQL for the other engine (RE2 regular expressions).

RE2 has no lookahead: six patterns are stated as a head plus a test on the text after it.
"""

from __future__ import annotations

from checks import corpus, queries
from fleetlint.catalog import dependencies as D
from fleetlint.catalog import paths as P
from fleetlint.catalog import rules as R
from fleetlint.catalog import stacks as S
from fleetlint.catalog import testing as T
from fleetlint.catalog.packs import PACKS
from fleetlint.catalog.services import SERVICE_RULES, SERVICES
from fleetlint.operators import packs
from fleetlint.operators.cost import MAX_EVIDENCE
from fleetlint.operators.performance import NEXT_DIRS, NEXT_FEATURES
from fleetlint.operators.report import (
    NOTE_CHARS, REPORT_INFO_CAP, REPORT_LAYERS, SHOWN_FRAMEWORKS, SHOWN_LANGUAGES, TASK_CATEGORY, TASK_INFO_CAP,
)

A, B = "chr(57344)", "chr(57345)"


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def names(values) -> str:
    return ", ".join(q(v) for v in values)


def array(values) -> str:
    return "[" + names(values) + "]::VARCHAR[]"


def not_below(values, dirs="dirs") -> str:
    return f"NOT list_has_any({dirs}, {array(values)})"


RULE_SOURCE = f"(suffix IN ({names(P.SOURCE_SUFFIXES)}) AND {not_below(P.PATTERN_SKIP_DIRS)})"
SECRET_SOURCE = (
    f"((suffix IN ({names(P.SECRET_SUFFIXES)}) OR starts_with(name, '.env')) AND {not_below(P.CORE_SKIP_DIRS)})")
CODE = f"(suffix IN ({names(P.CODE_SUFFIXES)}) AND {not_below(P.CORE_SKIP_DIRS)})"
RATIO = (
    f"(suffix IN ({names(sorted({s for v in T.RATIO_SUFFIXES.values() for s in v}))}) AND {not_below(P.CORE_SKIP_DIRS)})")
COUNTED = not_below(P.STACK_SKIP_DIRS)


def test_match(languages) -> str:
    return " OR ".join(f"regexp_matches(path, {q('|'.join(T.TEST_PATHS[x]))})" for x in languages)


ANY_TEST = f"({not_below(P.CORE_SKIP_DIRS)} AND ({test_match(T.TEST_PATHS)}))"
ELIGIBLE = {
    "pattern": RULE_SOURCE, "secret": SECRET_SOURCE, "auth": CODE, "trap": CODE, "service": CODE,
    "critical_path": RATIO, "test": ANY_TEST, "text": "TRUE",
}

# Heads of the patterns with lookahead, and what must hold for the text behind the match.
HEADS = {
    r"jwt\.sign\([^)]*(?!expiresIn)": (r"jwt\.sign\([^)]*", "TRUE"),
    R.AUTH[4].pattern: (r"(?:cookie|setCookie|set-cookie)",
                        "NOT regexp_matches(rest, '(?i)^[^\\n]*(?:secure|httponly)')"),
    R.GO[1].pattern: (r"go\s+func\s*\([^)]*\)\s*\{", "NOT contains(lower(rest), 'recover')"),
    R.JAVASCRIPT[7].pattern: (
        r"await\s+fetch\([^)]+\)\s*(?:;|\n)",
        "NOT regexp_matches(rest, '(?i)^\\s*(?:\\.then|\\.catch|if\\s*\\(!|const\\s+\\{?\\s*(?:ok|status))')"),
    R.TEST_SMELLS[1].pattern: (r"""it\s*\(\s*['\"].*['\"].*\{[^}]*\}\s*\)""",
                               "NOT regexp_matches(rest, '^[^\\n]*(?:expect|assert|should)')"),
    R.PERFORMANCE[2].pattern: (
        r"""(?:JSON\.parse\(\s*(?:fs\.)?readFileSync)|(?:\.read\(\)\.split\()|(?:pd\.read_csv\([^)]*\))""",
        # After the call: spaces, then no "chunksize" on the line they end on; else the
        # spaces end before their last newline.
        "(NOT regexp_matches(m, '(?i)^pd') OR NOT regexp_matches(rest, '(?i)^\\s*[^\\n]*chunksize')"
        " OR contains(regexp_extract(rest, '^\\s*'), chr(10)))"),
}
READ_CSV = (
    "CASE WHEN regexp_matches(m, '(?i)^pd') THEN m || CASE"
    " WHEN regexp_matches(rest, '(?i)^\\s*[^\\n]*chunksize') THEN regexp_replace(regexp_extract(rest, '^\\s*'), '\\n[^\\n]*$', '')"
    " ELSE regexp_extract(rest, '^\\s*') END ELSE m END")


def re2(rule: R.Rule) -> tuple[str, str]:
    pattern, condition = HEADS.get(rule.pattern, (rule.pattern, "TRUE"))
    flags = ("i" if rule.ignore_case else "") + ("m" if rule.multiline else "")
    return (f"(?{flags}-s)" if flags else "(?-s)") + pattern, condition


def hits_sql(rules, name="hits", source="files", carry="suffix") -> str:
    """CTEs ending in ``name(repo, path, rule_ix, kind, rule_set, rule, severity, message, line, match, match_end)``."""
    pieces, exists, conditions, texts = [], [], [], []
    for i, rule in enumerate(rules):
        where = ELIGIBLE[rule.kind] + " AND content IS NOT NULL"
        if rule.extensions is not None:
            where += f" AND suffix IN ({names(rule.extensions)})"
        head, condition = re2(rule)
        if rule.kind == "critical_path":
            words = rule.needs[0]
            has = [" OR ".join(f"contains(lower({c}), {q(w)})" for w in words) for c in ("path", "content")]
            exists.append(f"SELECT repo, path, {carry}, {i} AS rule_ix FROM {source} WHERE {where} AND ({has[0]}) AND ({has[1]})")
        elif rule.exists_only:
            exists.append(f"SELECT repo, path, {carry}, {i} AS rule_ix FROM {source} WHERE {where} AND regexp_matches(content, {q(head)})")
        else:
            pieces.append(
                f"SELECT repo, path, {carry}, {i} AS rule_ix, string_split(regexp_replace(content, {q(head)},"
                f" {A} || '\\0' || {B}, 'g'), {A}) AS pieces FROM {source} WHERE {where}")
            if condition != "TRUE":
                conditions.append(f"WHEN {i} THEN {condition}")
            if rule.pattern == R.PERFORMANCE[2].pattern:
                texts.append(f"WHEN {i} THEN {READ_CSV}")
    table = corpus.values_sql([(i, r.kind, r.rule_set, r.rule_id, r.severity, r.message) for i, r in enumerate(rules)])
    parts = [f"{name}_rules(rule_ix, kind, rule_set, rule, severity, message) AS ({table})"]
    branches = []
    keep = f"CASE rule_ix {' '.join(conditions)} ELSE TRUE END" if conditions else "TRUE"
    whole = f"CASE rule_ix {' '.join(texts)} ELSE m END" if texts else "m"
    if pieces:
        parts.append(f"{name}_pieces AS ({' UNION ALL '.join(pieces)})")
        parts.append(f"""{name}_spans AS (
  SELECT repo, path, {carry}, rule_ix, array_to_string(pieces[:k], '') AS before,
    string_split(pieces[k + 1], {B})[1] AS m,
    string_split(pieces[k + 1], {B})[2] || coalesce(replace(array_to_string(pieces[k + 2:], ''), {B}, ''), '') AS rest
  FROM {name}_pieces, LATERAL (SELECT unnest(range(1, len(pieces))) AS k))""")
        branches.append(f"""SELECT repo, path, {carry}, rule_ix,
    1 + length(before) - length(replace(before, chr(10), '')) AS line, {whole} AS whole
  FROM {name}_spans WHERE {keep}""")
    if exists:
        branches.append(f"SELECT repo, path, {carry}, rule_ix, NULL AS line, NULL AS whole FROM ({' UNION ALL '.join(exists)})")
    parts.append(f"""{name} AS (
  SELECT repo, path, {carry}, kind, rule_set, rule, severity, message, CAST(line AS INTEGER) AS line,
    left(whole, 120) AS match, right(whole, 4) AS match_end
  FROM ({' UNION ALL '.join(branches)}) JOIN {name}_rules USING (rule_ix))""")
    return ",\n".join(parts)


def with_ctes(*parts: str, select: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n" + select


FILES = corpus.files_sql()

SUFFIX_LANGUAGE = "suffix_language(suffix, language, ord) AS (" + corpus.values_sql([
    (suffix, language, list(S.LANGUAGES).index(language)) for suffix, language in S.SUFFIX_LANGUAGE.items()]) + ")"

LANG_NAMES = f"""{SUFFIX_LANGUAGE},
lang_names AS (
  SELECT repo, list(DISTINCT language) AS langs FROM files JOIN suffix_language USING (suffix)
  WHERE {COUNTED} GROUP BY repo)"""

ENTRIES = f"""entries AS (
  SELECT DISTINCT repo, entry FROM (
    SELECT repo, path AS entry FROM files
    UNION ALL SELECT repo, dirs[1] FROM files WHERE len(dirs) >= 1
    UNION ALL SELECT repo, dirs[1] || '/' || dirs[2] FROM files WHERE len(dirs) >= 2)
  WHERE entry IN ({names(S.ROOT_MARKERS)}))"""

_markers = [(language, m) for language, ms in S.LANGUAGE_MARKERS.items() for m in ms]
_endings = " OR ".join(
    f"(language = {q(language)} AND ends_with(name, {q(e)}))"
    for language, es in S.LANGUAGE_MARKER_ENDINGS.items() for e in es)
LANGUAGES = f"""{SUFFIX_LANGUAGE},
{ENTRIES},
language_markers(language, marker) AS ({corpus.values_sql(_markers)}),
marked AS (
  SELECT DISTINCT repo, language FROM entries JOIN language_markers ON entry = marker
  UNION SELECT DISTINCT repo, language FROM files, (SELECT unnest({array(S.LANGUAGE_MARKER_ENDINGS)}) AS language)
  WHERE {COUNTED} AND ({_endings})),
langs AS (
  SELECT c.repo, c.language AS name, c.file_count, m.language IS NOT NULL AS has_marker,
    CASE WHEN m.language IS NOT NULL OR c.file_count > {S.CONFIDENT_FILE_COUNT} THEN 'high' ELSE 'low' END AS confidence,
    CAST(row_number() OVER (PARTITION BY c.repo ORDER BY c.file_count DESC, c.ord) AS INTEGER) AS position
  FROM (SELECT repo, language, ord, count(*) AS file_count FROM files JOIN suffix_language USING (suffix)
        WHERE {COUNTED} GROUP BY ALL) c
  LEFT JOIN marked m ON m.repo = c.repo AND m.language = c.language)"""

_places = ", ".join(f"({q(p)}, {i})" for i, p in enumerate(S.PACKAGE_JSON_PATHS))
DEPS_JS = f"""places(path, place) AS (VALUES {_places}),
pkg AS (
  SELECT repo, place, json_extract(content, '$.dependencies') AS deps, json_extract(content, '$.devDependencies') AS dev,
    row_number() OVER (PARTITION BY repo ORDER BY place) AS rn
  FROM files JOIN places USING (path)
  WHERE json_valid(content)),
js_rows AS (
  SELECT repo, unnest(json_keys(coalesce(deps, '{{}}'))) AS name, deps AS obj, 0 AS dev FROM pkg WHERE rn = 1
  UNION ALL SELECT repo, unnest(json_keys(coalesce(dev, '{{}}'))), dev, 1 FROM pkg WHERE rn = 1),
deps_js AS (
  SELECT repo, 'js' AS ecosystem, name, json_extract_string(obj, '$."' || name || '"') AS version
  FROM js_rows QUALIFY row_number() OVER (PARTITION BY repo, name ORDER BY dev DESC) = 1)"""

DEPS_PY = f"""req AS (
  SELECT repo, trim(unnest(string_split(content, chr(10))), ' ' || chr(9)) AS line FROM files WHERE path = 'requirements.txt'),
deps_py AS (
  SELECT DISTINCT repo, 'py' AS ecosystem, name, '*' AS version FROM (
    SELECT repo, lower(trim(regexp_extract(line, '^[^>=<!\\[\\];]*'), ' ' || chr(9))) AS name FROM req
    WHERE line <> '' AND NOT starts_with(line, '#') AND NOT starts_with(line, '-')
    UNION ALL
    SELECT repo, lower(unnest(regexp_extract_all(content, {q(S.PYPROJECT_NAME)}, 1))) FROM files WHERE path = 'pyproject.toml')
  WHERE name <> '')"""

DEPS_GO = """gomod AS (
  SELECT repo, trim(unnest(string_split(content, chr(10))), ' ' || chr(9)) AS line FROM files WHERE path = 'go.mod'),
deps_go AS (
  SELECT DISTINCT repo, 'go' AS ecosystem, regexp_extract(line, '^\\S+') AS name, '*' AS version FROM gomod
  WHERE NOT regexp_matches(line, '^(module|go |//)') AND contains(regexp_extract(line, '^\\S+'), '/'))"""

DEPS_CARGO = f"""cargo AS (
  SELECT repo, unnest(string_split(content, chr(10))) AS line, generate_subscripts(string_split(content, chr(10)), 1) AS pos
  FROM files WHERE path = 'Cargo.toml'),
cargo_sections AS (
  SELECT *, last_value(CASE WHEN starts_with(line, '[') THEN line END IGNORE NULLS) OVER (PARTITION BY repo ORDER BY pos) AS section
  FROM cargo),
deps_cargo AS (
  SELECT DISTINCT repo, 'cargo' AS ecosystem, regexp_extract(line, {q(S.CARGO_KEY)}, 1) AS name, '*' AS version
  FROM cargo_sections
  WHERE regexp_matches(section, {q(S.CARGO_SECTION)}) AND NOT starts_with(line, '[')
    AND regexp_matches(line, {q(S.CARGO_KEY)}))"""

DEPS = f"""{DEPS_JS},
{DEPS_PY},
{DEPS_GO},
{DEPS_CARGO},
deps AS (SELECT * FROM deps_js UNION ALL SELECT * FROM deps_py UNION ALL SELECT * FROM deps_go UNION ALL SELECT * FROM deps_cargo),
merged AS (
  SELECT repo, name, CASE WHEN bool_or(ecosystem <> 'js') THEN '*' ELSE max(version) END AS version
  FROM deps GROUP BY repo, name)"""

_frameworks = list(S.FRAMEWORKS)
FRAMEWORKS = f"""{ENTRIES},
framework_parts(framework, ord, part) AS ({corpus.values_sql([
    (name, i, part) for i, (name, (parts, _)) in enumerate(S.FRAMEWORKS.items()) for part in parts])}),
framework_configs(framework, ord, config) AS ({corpus.values_sql([
    (name, i, config) for i, (name, (_, configs)) in enumerate(S.FRAMEWORKS.items()) for config in configs])}),
framework_rows AS (
  SELECT repo, framework, ord FROM deps JOIN framework_parts ON contains(name, part)
  UNION SELECT repo, framework, ord FROM entries JOIN framework_configs ON entry = config),
frameworks AS (SELECT repo, string_agg(framework, ',' ORDER BY ord) AS frameworks FROM framework_rows GROUP BY repo)"""


def tools_cte(name: str, table: dict) -> str:
    rows = [(tool, i, m) for i, (tool, ms) in enumerate(table.items()) for m in ms]
    return f"""{name}_catalog(tool, ord, marker) AS ({corpus.values_sql(rows)}),
{name} AS (
  SELECT r.repo, coalesce(t.tools, '') AS tools, t.first AS first FROM (SELECT DISTINCT repo FROM entries) r
  LEFT JOIN (SELECT repo, string_agg(tool, ',' ORDER BY ord) AS tools, arg_min(tool, ord) AS first FROM
    (SELECT DISTINCT repo, tool, ord FROM entries JOIN {name}_catalog ON entry = marker) GROUP BY repo) t USING (repo))"""


AUDIT = [("heavy_dependency", n, s, "", m) for n, s, m in D.HEAVY_JS + D.HEAVY_PYTHON]
AUDIT += [("deprecated", n, "warning", "", m) for n, m in D.DEPRECATED]
AUDIT += [("cost_risk", n, s, service, m) for n, service, s, m in D.METERED]
ADVICE = [("heavy_dependency", n, s, "", m) for n, s, m in D.ADVICE_ONLY_HEAVY]
GROUPS = [(g, i, member, advice) for g, (advice, members) in enumerate(D.SAME_PURPOSE) for i, member in enumerate(members)]


def audit_cte(rows=AUDIT) -> str:
    return f"""audit_catalog(type, package_key, severity, service, message) AS ({corpus.values_sql(rows)}),
audit AS (
  SELECT repo, type, name AS package, severity, service, message FROM merged JOIN audit_catalog ON lower(name) = package_key)"""


DUPLICATES = f"""groups(group_id, ord, member, advice) AS ({corpus.values_sql(GROUPS)}),
duplicates AS (
  SELECT repo, string_agg(member, ',' ORDER BY ord) AS packages,
    any_value(advice) || ': ' || string_agg(member, ', ' ORDER BY ord) AS message
  FROM (SELECT DISTINCT repo, group_id, ord, member, advice FROM merged JOIN groups ON lower(name) = member)
  GROUP BY repo, group_id HAVING count(*) > 1)"""
BUNDLE = f"""sizes(package_key, size_kb) AS ({corpus.values_sql(D.BUNDLE_KB)}),
bundle AS (
  SELECT repo, name AS package, CAST(size_kb AS INTEGER) AS estimated_size_kb,
    CASE WHEN size_kb >= {D.BUNDLE_WARNING_KB} THEN 'warning' ELSE 'info' END AS severity,
    name || ' puts about ' || size_kb || ' KB into the bundle.' AS message
  FROM deps_js JOIN sizes ON lower(name) = package_key)"""

CATEGORIES = [(s, s, True) for s in R.ALWAYS_SETS] + [
    (s, c, False) for s, cats in R.SET_CATEGORIES.items() for c in cats]


def patterns_cte(hits="hits", where="TRUE") -> str:
    return f"""categories(rule_set, category, always) AS ({corpus.values_sql(CATEGORIES)}),
patterns AS (
  SELECT h.repo, h.rule, c.category, h.severity, h.path AS file, h.line, h.match
  FROM {hits} h JOIN categories c USING (rule_set) LEFT JOIN lang_names l ON l.repo = h.repo
  WHERE h.kind = 'pattern' AND (c.always OR list_contains(l.langs, c.category)) AND {where})"""


FIRST_FILES = f"""first_files AS (
  SELECT repo, path, CAST(row_number() OVER (PARTITION BY repo ORDER BY string_split(path, '/')) AS INTEGER) AS file_rank
  FROM files WHERE {RULE_SOURCE})"""

IMAGES = f"""images AS (
  SELECT repo, path AS file, CAST(round_even(size_bytes / 1024, 0) AS INTEGER) AS size_kb FROM files
  WHERE suffix IN ({names(P.IMAGE_SUFFIXES)}) AND size_bytes > {P.LARGE_IMAGE_BYTES} AND {not_below(P.IMAGE_SKIP_DIRS)})"""

_features = [(f, i, s) for i, (f, s) in enumerate(NEXT_FEATURES.items())]
MISSING = f"""next_features(rule, ord, severity) AS ({corpus.values_sql(_features)}),
is_next AS (SELECT DISTINCT repo FROM framework_rows WHERE framework = 'next.js'),
is_react AS (SELECT DISTINCT repo FROM framework_rows WHERE framework IN ('next.js', 'react')),
missing_opts AS (
  SELECT r.repo, f.rule, f.severity FROM is_next r, next_features f
  WHERE NOT EXISTS (SELECT 1 FROM files x WHERE x.repo = r.repo AND ends_with(x.name, '.tsx')
    AND x.dirs[1] IN ({names(NEXT_DIRS)}) AND contains(x.content, f.rule))
  UNION ALL
  SELECT r.repo, 'Suspense', 'info' FROM is_react r
  WHERE NOT EXISTS (SELECT 1 FROM files x WHERE x.repo = r.repo AND (ends_with(x.name, '.tsx') OR ends_with(x.name, '.jsx'))
    AND {not_below(P.REACT_SKIP_DIRS, 'x.dirs')} AND contains(x.content, 'Suspense')))"""

DANGEROUS = f"""endings(ending) AS (SELECT unnest({array(P.SENSITIVE_ENDINGS)})),
all_entries AS (
  SELECT repo, path AS file FROM files
  UNION SELECT repo, array_to_string(dirs[:n], '/') FROM files, LATERAL (SELECT unnest(range(1, len(dirs) + 1)) AS n)),
dangerous AS (
  SELECT e.repo, e.file, d.ending AS rule, 'critical' AS severity
  FROM all_entries e JOIN endings d ON ends_with(string_split(e.file, '/')[-1], d.ending)
  LEFT JOIN files g ON g.repo = e.repo AND g.path = '.gitignore'
  WHERE {not_below(P.CORE_SKIP_DIRS, "string_split(e.file, '/')")}
    AND NOT coalesce(contains(g.content, d.ending) OR contains(g.content, string_split(e.file, '/')[-1]), FALSE))"""

_keys = [(s.service_id, i, key) for s in SERVICES for i, key in enumerate(s.env_keys)]
ENV = f"""env_keys(service_id, ord, key) AS ({corpus.values_sql(_keys)}),
env_found AS (
  SELECT DISTINCT repo, service_id, CAST(ord AS INTEGER) AS ord, 'env:' || key AS evidence
  FROM files JOIN env_keys ON contains(content, key) WHERE path IN ({names(P.ENV_FILES)}))"""
_profiles = [(s.service_id, i, s.name, s.billing_model, s.risk_level, s.severity, s.message) for i, s in enumerate(SERVICES)]


def services_cte(hits="hits") -> str:
    return f"""{ENV},
profiles(service_id, service_ord, service, billing_model, risk_level, severity, message) AS ({corpus.values_sql(_profiles)}),
evidence AS (
  SELECT repo, service_id, ord, [] AS place, evidence FROM env_found
  UNION ALL SELECT repo, rule, 99, string_split(path, '/'), 'code:' || path FROM {hits} WHERE kind = 'service'),
services AS (
  SELECT repo, service_id, service, billing_model, risk_level, severity, message, service_ord,
    array_to_string(list(evidence ORDER BY ord, place)[:{MAX_EVIDENCE}], ',') AS detected_via
  FROM evidence JOIN profiles USING (service_id) GROUP BY ALL)"""


COST = """cost_summary AS (
  SELECT r.repo,
    CASE WHEN coalesce(s.high, 0) >= 2 THEN 'high' WHEN coalesce(s.high, 0) >= 1 OR coalesce(s.n, 0) >= 3 THEN 'medium'
      ELSE 'low' END AS total_monthly_risk,
    coalesce(s.n, 0) AS service_count, coalesce(s.high, 0) AS high_risk_services, coalesce(t.n, 0) AS scaling_traps,
    coalesce(s.n, 0) + coalesce(t.n, 0) AS total_findings
  FROM (SELECT DISTINCT repo FROM files) r
  LEFT JOIN (SELECT repo, count(*) AS n, count(*) FILTER (risk_level = 'high') AS high FROM services GROUP BY repo) s USING (repo)
  LEFT JOIN (SELECT repo, count(*) AS n FROM hits WHERE kind = 'trap' GROUP BY repo) t USING (repo))"""

_known = array(T.TEST_PATHS)
_by_language = " OR ".join(
    f"(list_contains(l.langs, {q(x)}) AND ({test_match([x]).replace('path', 'f.path')}))" for x in T.TEST_PATHS)
TESTS = f"""tests AS (
  SELECT f.repo, f.path, f.content FROM files f LEFT JOIN lang_names l ON l.repo = f.repo
  WHERE {not_below(P.CORE_SKIP_DIRS, 'f.dirs')}
    AND CASE WHEN list_has_any(coalesce(l.langs, []), {_known}) THEN {_by_language}
      ELSE {test_match(T.TEST_PATHS).replace('path', 'f.path')} END)"""
RATIO_SQL = "(" + " OR ".join(
    f"(list_contains(l.langs, {q(x)}) AND f.suffix IN ({names(s)}))" for x, s in T.RATIO_SUFFIXES.items()) + ")"
_kind = {k: " OR ".join(f"contains(lower(path), {q(w)})" for w in ws) for k, ws in T.TEST_KIND_WORDS.items()}
_bands = " ".join(f"WHEN ratio < {bound} THEN {q(name)}" for bound, name in T.COVERAGE_BANDS)
TEST_COUNTS = f"""{TESTS},
sources AS (
  SELECT f.repo, count(*) AS n FROM files f JOIN lang_names l ON l.repo = f.repo
  WHERE {not_below(P.CORE_SKIP_DIRS, 'f.dirs')} AND {RATIO_SQL} GROUP BY f.repo),
test_counts AS (
  SELECT *, CASE WHEN ratio = 0 THEN 'none' {_bands} ELSE {q(T.COVERAGE_TOP)} END AS coverage_estimate,
    array_to_string(list_filter([CASE WHEN NOT has_unit_tests THEN 'unit' END,
      CASE WHEN NOT has_integration_tests THEN 'integration' END, CASE WHEN NOT has_e2e_tests THEN 'e2e' END],
      lambda x: x IS NOT NULL), ',') AS missing_test_types
  FROM (
    SELECT r.repo, coalesce(s.n, 0) AS source_file_count, coalesce(t.n, 0) AS test_file_count,
      round(coalesce(t.n, 0) / greatest(coalesce(s.n, 0), 1) * 100, 1) AS ratio,
      coalesce(t.unit, FALSE) AS has_unit_tests, coalesce(t.integration, FALSE) AS has_integration_tests,
      coalesce(t.e2e, FALSE) AS has_e2e_tests
    FROM (SELECT DISTINCT repo FROM files) r LEFT JOIN sources s USING (repo)
    LEFT JOIN (SELECT repo, count(*) AS n, {', '.join(f'bool_or({c}) AS {k}' for k, c in _kind.items())}
      FROM tests GROUP BY repo) t USING (repo)))"""
UNTESTED = f"""critical AS (
  SELECT h.repo, h.path, h.rule AS category,
    lower(regexp_replace(string_split(h.path, '/')[-1], '(.)\\.[^.]+$', '\\1')) AS stem
  FROM hits h JOIN lang_names l ON l.repo = h.repo, (SELECT 1) one
  WHERE h.kind = 'critical_path' AND {RATIO_SQL.replace('f.suffix', 'h.suffix')}),
untested AS (
  SELECT c.repo, c.category, c.path AS file FROM critical c
  WHERE NOT EXISTS (SELECT 1 FROM tests t WHERE t.repo = c.repo AND contains(lower(t.content), c.stem)))"""
SMELLS = """smells AS (
  SELECT h.repo, h.rule, h.path AS file, h.line, h.severity, h.message FROM hits h JOIN tests t ON t.repo = h.repo AND t.path = h.path
  WHERE h.kind = 'test')"""

ALL_RULES = R.PATTERN_RULES + R.SECRETS + R.AUTH + R.TRAPS + SERVICE_RULES + R.TEST_SMELLS + queries.testing.CRITICAL_RULES

EVERYTHING = [
    FILES, LANG_NAMES, DEPS, FRAMEWORKS, audit_cte(), DUPLICATES, BUNDLE, FIRST_FILES, hits_sql(ALL_RULES),
    patterns_cte(),
    IMAGES, MISSING, DANGEROUS, services_cte(), COST, TEST_COUNTS, UNTESTED, SMELLS,
    """findings AS (
  SELECT repo, 'dependencies' AS layer, type, '' AS rule, '' AS category, severity, '' AS file, 0 AS line, package,
    '' AS service_id, '' AS secret_type, '' AS trap, message FROM audit
  UNION ALL SELECT repo, 'dependencies', 'duplicate_functionality', '', '', 'info', '', 0, '', '', '', '', message FROM duplicates
  UNION ALL SELECT repo, 'patterns', '', rule, category, severity, file, line, '', '', '', '', '' FROM patterns
  UNION ALL SELECT repo, 'performance', 'heavy_import', '', '', severity, '', 0, package, '', '', '', '' FROM bundle
  UNION ALL SELECT repo, 'performance', 'large_image', '', '', 'warning', file, 0, '', '', '', '', '' FROM images
  UNION ALL SELECT repo, 'performance', 'missing_optimization', rule, '', severity, '', 0, '', '', '', '', '' FROM missing_opts
  UNION ALL SELECT repo, 'security', 'exposed_secret', '', '', severity, path, line, '', '', rule, '', '' FROM hits WHERE kind = 'secret'
  UNION ALL SELECT repo, 'security', 'dangerous_file', rule, '', severity, file, 0, '', '', '', '', '' FROM dangerous
  UNION ALL SELECT repo, 'security', 'auth_risk', rule, '', severity, path, line, '', '', '', '', '' FROM hits WHERE kind = 'auth'
  UNION ALL SELECT repo, 'cost', 'cost_service', '', '', severity, '', 0, '', service_id, '', '', '' FROM services
  UNION ALL SELECT repo, 'cost', 'scaling_trap', '', '', severity, path, 0, '', '', '', rule, '' FROM hits WHERE kind = 'trap'
  UNION ALL SELECT repo, 'tests', 'untested_critical_path', '', category, 'warning', file, 0, '', '', '', '', '' FROM untested
  UNION ALL SELECT repo, 'tests', 'test_anti_pattern', rule, '', severity, file, line, '', '', '', '', '' FROM smells)""",
]


def everything(select: str, *more: str) -> str:
    parts = [p for p in EVERYTHING]
    return with_ctes(*parts, *more, select=select)


LINES = "CASE WHEN content = '' THEN 0 ELSE length(content) - length(replace(content, chr(10), '')) + CASE WHEN ends_with(content, chr(10)) THEN 0 ELSE 1 END END"
DOCS = "files AS (SELECT source AS repo, 'doc_' || doc_id || '.txt' AS path, '.txt' AS suffix, regexp_replace(text, '\\r\\n?', chr(10), 'g') AS content FROM documents)"
PAGES = "files AS (SELECT regexp_extract(url, '^[a-z]+://([^/]+)', 1) AS repo, page_id || '.html' AS path, '.html' AS suffix, regexp_replace(html, '\\r\\n?', chr(10), 'g') AS content FROM pages)"
TURNS = "files AS (SELECT CAST(conv_id AS VARCHAR) AS repo, role || '_' || turn AS path, '' AS suffix, text AS content FROM conversations)"


def _scan_set(rules) -> str:
    return with_ctes(FILES, LANG_NAMES, hits_sql(rules), patterns_cte(),
                     select="SELECT repo, rule, category, severity, file, line, match FROM patterns")


def _diff() -> list[str]:
    rules = R.GENERAL + R.DATABASE
    return [
        FILES, corpus.files_sql(1, "files2"), hits_sql(rules, "h1"), hits_sql(rules, "h2", "files2"),
        """diff AS (
  SELECT repo, rule, path AS file, match, severity, CAST(sum(b) AS BIGINT) AS before_count, CAST(sum(a) AS BIGINT) AS after_count,
    CASE WHEN sum(b) = 0 THEN 'new' WHEN sum(a) = 0 THEN 'fixed' ELSE 'kept' END AS status
  FROM (SELECT *, 1 AS b, 0 AS a FROM h1 UNION ALL SELECT *, 0, 1 FROM h2) GROUP BY repo, rule, path, match, severity)""",
    ]


def _capped(order, cap: int, extra: str, source: str) -> str:
    return f"""SELECT repo, severity, {extra}, count(*) AS shown, max(more) AS more FROM (
  SELECT *, CASE WHEN severity = 'info' THEN greatest(n - {cap}, 0) ELSE 0 END AS more FROM (
    SELECT *, list_position({array(order)}, layer) AS layer_ord,
      count(*) OVER (PARTITION BY repo, severity) AS n FROM {source})
  QUALIFY severity <> 'info' OR row_number() OVER (PARTITION BY repo, severity ORDER BY layer_ord, {extra}) <= {cap})
GROUP BY ALL"""


def _popular() -> str:
    return ", ".join(f"({q(n)})" for n in D.POPULAR_NAMES)


def build() -> dict[str, str]:
    sql = {}
    sql["corpus_scan"] = with_ctes(FILES, select="SELECT repo, path, name, suffix, array_to_string(dirs, ',') AS dirs, size_bytes, coalesce(md5(content), '') AS content_md5 FROM files")
    sql["tree_roundtrip"] = sql["corpus_scan"]
    flags = {
        "rule_source": RULE_SOURCE, "secret_source": SECRET_SOURCE, "code": CODE, "ratio_source": RATIO,
        "stack_counted": COUNTED, "image_dirs": not_below(P.IMAGE_SKIP_DIRS), "react_dirs": not_below(P.REACT_SKIP_DIRS),
    }
    sql["eligible_files"] = with_ctes(FILES, select="SELECT repo, count(*) AS files, " + ", ".join(
        f"count(*) FILTER ({test}) AS {name}" for name, test in flags.items()) + " FROM files GROUP BY repo")
    sql["first_n_files"] = with_ctes(FILES, FIRST_FILES, select=f"SELECT * FROM first_files WHERE file_rank <= {queries.FIRST_N}")
    sql["root_markers"] = with_ctes(FILES, ENTRIES, select="SELECT * FROM entries")
    sql["test_files"] = with_ctes(FILES, LANG_NAMES, TESTS, select="SELECT repo, path FROM tests")

    sql["lang_counts"] = with_ctes(FILES, select=f"SELECT repo, suffix, count(*) AS file_count FROM files WHERE {COUNTED} GROUP BY repo, suffix")
    sql["lang_table"] = with_ctes(FILES, LANGUAGES, select="SELECT repo, position, name, file_count, has_marker, confidence FROM langs")
    sql["deps_js"] = with_ctes(FILES, DEPS_JS, select="SELECT * FROM deps_js")
    sql["deps_py"] = with_ctes(FILES, DEPS_PY, select="SELECT * FROM deps_py")
    sql["deps_go"] = with_ctes(FILES, DEPS_GO, select="SELECT * FROM deps_go")
    sql["deps_cargo"] = with_ctes(FILES, DEPS_CARGO, select="SELECT * FROM deps_cargo")
    sql["deps_merged"] = with_ctes(FILES, DEPS, select="SELECT * FROM merged")
    sql["frameworks"] = with_ctes(FILES, DEPS, FRAMEWORKS, select="SELECT * FROM frameworks")
    sql["package_manager"] = with_ctes(FILES, ENTRIES, tools_cte("pm", S.PACKAGE_MANAGERS),
                                       select="SELECT repo, coalesce(first, 'unknown') AS package_manager FROM pm")
    for key, table in (("build_tools", S.BUILD_TOOLS), ("runtimes", S.RUNTIMES), ("test_runners", S.TEST_RUNNERS)):
        sql[key] = with_ctes(FILES, ENTRIES, tools_cte("t", table), select=f"SELECT repo, tools AS {key} FROM t")
    sql["stack_row"] = with_ctes(
        FILES, LANGUAGES, DEPS, FRAMEWORKS.replace(ENTRIES + ",\n", ""), tools_cte("pm", S.PACKAGE_MANAGERS),
        tools_cte("bt", S.BUILD_TOOLS), tools_cte("rt", S.RUNTIMES), select=f"""
SELECT r.repo, coalesce(l.primary_language, 'unknown') AS primary_language, coalesce(l.languages, '') AS languages,
  coalesce(nullif(replace(f.frameworks, ',', ', '), ''), 'None detected') AS frameworks,
  coalesce(pm.first, 'unknown') AS package_manager,
  coalesce(nullif(replace(bt.tools, ',', ', '), ''), 'None detected') AS build_tools,
  coalesce(nullif(replace(rt.tools, ',', ', '), ''), 'None detected') AS runtimes,
  coalesce(d.n, 0) AS total_deps
FROM (SELECT DISTINCT repo FROM files) r
LEFT JOIN (SELECT repo, string_agg(name || ' (' || file_count || ' files)', ', ' ORDER BY position) FILTER (position <= {SHOWN_LANGUAGES}) AS languages,
  arg_min(name, position) AS primary_language FROM langs GROUP BY repo) l USING (repo)
LEFT JOIN frameworks f USING (repo) LEFT JOIN pm USING (repo) LEFT JOIN bt USING (repo) LEFT JOIN rt USING (repo)
LEFT JOIN (SELECT repo, count(*) AS n FROM merged GROUP BY repo) d USING (repo)""")

    sql["dep_heavy"] = with_ctes(FILES, DEPS, audit_cte(AUDIT + ADVICE), select="SELECT repo, package, severity, message FROM audit WHERE type = 'heavy_dependency'")
    sql["dep_deprecated"] = with_ctes(FILES, DEPS, audit_cte(), select="SELECT repo, package, severity, message FROM audit WHERE type = 'deprecated'")
    sql["dep_payg"] = with_ctes(FILES, DEPS, audit_cte(), select="SELECT repo, package, severity, service, message FROM audit WHERE type = 'cost_risk'")
    sql["dep_duplicates"] = with_ctes(FILES, DEPS, DUPLICATES, select="SELECT * FROM duplicates")
    sql["dep_rollup"] = with_ctes(FILES, DEPS, audit_cte(), DUPLICATES, select="""
SELECT r.repo, coalesce(t.n, 0) AS total_deps, coalesce(a.heavy, 0) AS heavy_count, coalesce(a.deprecated, 0) AS deprecated_count,
  coalesce(a.cost, 0) AS cost_risk_count, coalesce(d.n, 0) AS duplicate_count, coalesce(a.critical, 0) AS critical_count
FROM (SELECT DISTINCT repo FROM files) r
LEFT JOIN (SELECT repo, count(*) AS n FROM merged GROUP BY repo) t USING (repo)
LEFT JOIN (SELECT repo, count(*) FILTER (type = 'heavy_dependency') AS heavy, count(*) FILTER (type = 'deprecated') AS deprecated,
  count(*) FILTER (type = 'cost_risk') AS cost, count(*) FILTER (severity = 'critical') AS critical FROM audit GROUP BY repo) a USING (repo)
LEFT JOIN (SELECT repo, count(*) AS n FROM duplicates GROUP BY repo) d USING (repo)""")
    sql["bundle_risks"] = with_ctes(FILES, DEPS_JS, BUNDLE, select="SELECT repo, package, estimated_size_kb, severity, message FROM bundle")
    sql["typosquats"] = with_ctes(FILES, DEPS, f"popular(imitates) AS (VALUES {_popular()})", select="""
SELECT repo, ecosystem, name, imitates, CAST(levenshtein(lower(name), imitates) AS INTEGER) AS distance FROM deps, popular
WHERE levenshtein(lower(name), imitates) BETWEEN 1 AND 2 AND lower(name) NOT IN (SELECT imitates FROM popular)""")

    for name, rules in R.RULE_SETS.items():
        sql[f"scan_{name}"] = _scan_set(rules)
    sql["scan_project"] = with_ctes(
        FILES, LANG_NAMES, hits_sql(R.PATTERN_RULES), patterns_cte(),
        select="SELECT repo, rule, category, severity, file, line, match FROM patterns")
    sql["scan_dedupe"] = with_ctes(
        FILES, LANG_NAMES, hits_sql(R.JAVASCRIPT),
        select="""SELECT h.repo, rule, path AS file, line, match FROM hits h JOIN lang_names l ON l.repo = h.repo
WHERE list_has_any(l.langs, ['javascript', 'typescript'])""")
    for name in PACKS:
        sql[f"pack_{name}"] = with_ctes(FILES, hits_sql(packs.pack_rules(name)),
                                        select="SELECT repo, rule_set, rule, severity, path AS file, line, match FROM hits")
    for key, source in (("scan_documents", DOCS), ("scan_pages", PAGES)):
        sql[key] = with_ctes(source, hits_sql(queries.TEXT_GENERAL),
                             select="SELECT repo, rule, severity, path AS file, line, match FROM hits")
    sql["scan_pages_custom"] = with_ctes(PAGES, hits_sql(queries.MARKUP_RULES),
                                         select="SELECT repo, rule, severity, path AS file, line, match FROM hits")
    sql["scan_turns_custom"] = with_ctes(TURNS, hits_sql(queries.TURN_RULES),
                                         select="SELECT repo, rule, path AS file, line, match FROM hits")
    sql["document_secret_counts"] = with_ctes(DOCS, hits_sql(queries.HARDCODED), select="""
SELECT repo, count(*) FILTER (severity = 'critical') AS critical, count(*) FILTER (severity = 'warning') AS warning,
  count(*) FILTER (severity = 'info') AS info, count(*) AS total FROM hits GROUP BY repo""")
    sql["scan_conversations"] = with_ctes(TURNS, hits_sql(queries.HARDCODED + queries.TEXT_SECRETS),
                                          select="SELECT repo, rule, severity, path AS file, line, match FROM hits")

    sql["large_images"] = with_ctes(FILES, IMAGES, select="SELECT repo, file, size_kb, 'An image of ' || size_kb || ' KB.' AS message FROM images")
    sql["missing_opts"] = with_ctes(FILES, DEPS, FRAMEWORKS, MISSING, select="SELECT * FROM missing_opts")
    sql["performance_rollup"] = with_ctes(FILES, DEPS, FRAMEWORKS, MISSING, IMAGES, BUNDLE, select="""
SELECT r.repo, coalesce(b.n, 0) AS bundle_risks, coalesce(i.n, 0) AS image_issues, coalesce(m.n, 0) AS missing_optimizations,
  coalesce(b.n, 0) + coalesce(i.n, 0) + coalesce(m.n, 0) AS total_findings
FROM (SELECT DISTINCT repo FROM files) r
LEFT JOIN (SELECT repo, count(*) AS n FROM bundle GROUP BY repo) b USING (repo)
LEFT JOIN (SELECT repo, count(*) AS n FROM images GROUP BY repo) i USING (repo)
LEFT JOIN (SELECT repo, count(*) AS n FROM missing_opts GROUP BY repo) m USING (repo)""")

    sql["scan_secrets"] = with_ctes(FILES, hits_sql(R.SECRETS), select="SELECT repo, rule AS secret_type, path AS file, line, severity, left(match, 8) || '...' || match_end AS match_preview FROM hits")
    sql["mask_secrets"] = with_ctes(DOCS, hits_sql(queries.HARDCODED), select="SELECT repo, path AS file, line, left(match, 8) || '...' || match_end AS match_preview FROM hits")
    sql["dangerous_files"] = with_ctes(FILES, DANGEROUS, select="SELECT * FROM dangerous")
    sql["scan_auth"] = with_ctes(FILES, hits_sql(R.AUTH), select="SELECT repo, rule, path AS file, line, severity FROM hits")
    sql["security_rollup"] = with_ctes(FILES, hits_sql(R.SECRETS + R.AUTH), DANGEROUS, select="""
SELECT r.repo, coalesce(h.secrets, 0) AS secrets, coalesce(d.n, 0) AS dangerous_files, coalesce(h.auth, 0) AS auth_risks,
  coalesce(h.secrets, 0) + coalesce(h.auth, 0) + coalesce(d.n, 0) AS total_findings,
  coalesce(h.secrets, 0) + coalesce(d.n, 0) AS critical_count
FROM (SELECT DISTINCT repo FROM files) r
LEFT JOIN (SELECT repo, count(*) FILTER (kind = 'secret') AS secrets, count(*) FILTER (kind = 'auth') AS auth FROM hits GROUP BY repo) h USING (repo)
LEFT JOIN (SELECT repo, count(*) AS n FROM dangerous GROUP BY repo) d USING (repo)""")

    sql["env_evidence"] = with_ctes(FILES, ENV, select="SELECT * FROM env_found")
    sql["service_evidence"] = with_ctes(FILES, hits_sql(SERVICE_RULES), services_cte(), select=f"""SELECT repo, service_id,
  count(*) AS n_evidence, least(count(*), {MAX_EVIDENCE}) AS shown, greatest(count(*) - {MAX_EVIDENCE}, 0) AS more_evidence
FROM evidence GROUP BY repo, service_id""")
    sql["service_usage"] = with_ctes(FILES, hits_sql(SERVICE_RULES), services_cte(), select="SELECT repo, service_id, service, billing_model, risk_level, severity, detected_via FROM services")
    sql["detected_services"] = with_ctes(FILES, hits_sql(SERVICE_RULES), services_cte(), select=f"SELECT repo, service, billing_model, upper(risk_level) AS risk, left(message, {NOTE_CHARS}) AS notes FROM services")
    sql["scaling_traps"] = with_ctes(FILES, hits_sql(R.TRAPS), select="SELECT repo, rule AS trap, path AS file, severity FROM hits")
    sql["monthly_risk"] = with_ctes(FILES, hits_sql(SERVICE_RULES + R.TRAPS), services_cte(), COST, select="SELECT * FROM cost_summary")

    sql["test_ratio"] = with_ctes(FILES, LANG_NAMES, TEST_COUNTS, select="SELECT repo, source_file_count, test_file_count, ratio AS test_ratio_percent, coverage_estimate FROM test_counts")
    sql["test_kinds"] = with_ctes(FILES, LANG_NAMES, TEST_COUNTS, select="SELECT repo, has_unit_tests, has_integration_tests, has_e2e_tests, missing_test_types FROM test_counts")
    sql["test_antipatterns"] = with_ctes(FILES, LANG_NAMES, TESTS, hits_sql(R.TEST_SMELLS), SMELLS, select="SELECT repo, rule, file, line, severity FROM smells")
    critical = hits_sql(queries.testing.CRITICAL_RULES)
    sql["untested_critical"] = with_ctes(FILES, LANG_NAMES, TESTS, critical, UNTESTED, select="SELECT * FROM untested")
    sql["test_rollup"] = with_ctes(
        FILES, LANG_NAMES, TEST_COUNTS, hits_sql(queries.testing.CRITICAL_RULES + R.TEST_SMELLS), UNTESTED, SMELLS, ENTRIES,
        tools_cte("t", S.TEST_RUNNERS), select="""
SELECT c.repo, c.source_file_count, c.test_file_count, coalesce(u.n, 0) AS untested_critical_paths,
  coalesce(s.n, 0) AS test_anti_patterns, coalesce(t.tools, '') AS test_runners,
  coalesce(u.n, 0) + coalesce(s.n, 0) + CASE WHEN has_unit_tests THEN 0 ELSE 1 END
    + CASE WHEN has_integration_tests THEN 0 ELSE 1 END + CASE WHEN has_e2e_tests THEN 0 ELSE 1 END AS total_findings
FROM test_counts c LEFT JOIN (SELECT repo, count(*) AS n FROM untested GROUP BY repo) u USING (repo)
LEFT JOIN (SELECT repo, count(*) AS n FROM smells GROUP BY repo) s USING (repo) LEFT JOIN t USING (repo)""")

    sql["findings_union"] = everything("SELECT repo, layer, type, rule, category, severity, file, line, package, service_id, secret_type, trap FROM findings")
    sql["findings_ordered"] = everything("""SELECT *, row_number() OVER (ORDER BY CASE severity WHEN 'critical' THEN 0
  WHEN 'warning' THEN 1 WHEN 'info' THEN 2 ELSE 3 END, repo NULLS FIRST, layer NULLS FIRST, file, line, type, rule, category,
  package, service_id, secret_type, trap) AS position FROM (SELECT repo, layer, severity, coalesce(line, 0) AS line,
  coalesce(type, '') AS type, coalesce(rule, '') AS rule, coalesce(category, '') AS category, coalesce(file, '') AS file,
  coalesce(package, '') AS package, coalesce(service_id, '') AS service_id, coalesce(secret_type, '') AS secret_type,
  coalesce(trap, '') AS trap FROM findings)""")
    sql["findings_cube"] = everything("""SELECT severity, layer, category, CAST(GROUPING(severity, layer, category) AS INTEGER) AS level,
  count(*) AS findings, count(DISTINCT repo) AS repos FROM findings GROUP BY CUBE (severity, layer, category)""")
    sql["severity_rollup"] = everything("""SELECT repo, count(*) FILTER (severity = 'critical') AS critical,
  count(*) FILTER (severity = 'warning') AS warning, count(*) FILTER (severity = 'info') AS info, count(severity) AS total
FROM (SELECT DISTINCT repo FROM files) LEFT JOIN findings USING (repo) GROUP BY repo""")
    sql["report_capped"] = everything(_capped(REPORT_LAYERS, REPORT_INFO_CAP, "layer", "findings"))
    category = "CASE layer " + " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in TASK_CATEGORY.items()) + " ELSE category END"
    order = ("dependencies", "patterns", "security", "cost", "performance", "tests")
    sql["critical_gate"] = everything("""SELECT repo, count(*) FILTER (severity = 'critical' AND layer IN ('security', 'dependencies', 'patterns')) AS critical_count,
  count(*) FILTER (severity = 'critical' AND layer IN ('security', 'dependencies', 'patterns')) > 0 AS blocked
FROM (SELECT DISTINCT repo FROM files) LEFT JOIN findings USING (repo) GROUP BY repo""")
    sql["task_queue"] = everything(f"""SELECT repo, CAST(CASE severity WHEN 'critical' THEN 0 WHEN 'warning' THEN 1 ELSE 2 END AS INTEGER) AS severity_rank,
  severity, category, count(*) AS shown, max(more) AS more FROM (
  SELECT *, CASE WHEN severity = 'info' THEN greatest(n - {TASK_INFO_CAP}, 0) ELSE 0 END AS more FROM (
    SELECT *, list_position({array(order)}, layer) AS layer_ord, count(*) OVER (PARTITION BY repo, severity) AS n FROM tasks)
  QUALIFY severity <> 'info' OR row_number() OVER (PARTITION BY repo, severity
    ORDER BY layer_ord, type, string_split(file, '/'), line, rule, category) <= {TASK_INFO_CAP})
GROUP BY ALL""", f"""tasks AS (
  SELECT repo, layer, type, file, line, rule, {category} AS category, severity FROM findings
  UNION ALL SELECT repo, 'tests', 'missing_test_type', '', 0, '', 'testing', 'warning'
  FROM (SELECT repo, unnest(string_split(missing_test_types, ',')) AS kind FROM test_counts) WHERE kind <> '')""")

    langs = LANGUAGES.replace(SUFFIX_LANGUAGE + ",\n", "").replace(ENTRIES + ",\n", "")
    wide = f"""wide AS (
  SELECT r.repo, coalesce(l.primary_language, 'unknown') AS primary_language, coalesce(f.frameworks, '') AS frameworks,
    coalesce(d.n, 0) AS total_deps, coalesce(c.heavy, 0) AS heavy, coalesce(c.deprecated, 0) AS deprecated,
    coalesce(c.sec_critical, 0) AS sec_critical, coalesce(c.sec, 0) AS sec, coalesce(c.perf, 0) AS perf,
    coalesce(c.pat, 0) AS pat, upper(cs.total_monthly_risk) AS risk, cs.service_count, cs.scaling_traps,
    upper(t.coverage_estimate) AS coverage, t.test_file_count, t.source_file_count
  FROM (SELECT DISTINCT repo FROM files) r
  LEFT JOIN (SELECT repo, arg_min(name, position) AS primary_language FROM langs GROUP BY repo) l USING (repo)
  LEFT JOIN frameworks f USING (repo) LEFT JOIN (SELECT repo, count(*) AS n FROM merged GROUP BY repo) d USING (repo)
  LEFT JOIN (SELECT repo, count(*) FILTER (type = 'heavy_dependency') AS heavy, count(*) FILTER (type = 'deprecated') AS deprecated,
    count(*) FILTER (layer = 'security' AND severity = 'critical') AS sec_critical, count(*) FILTER (layer = 'security') AS sec,
    count(*) FILTER (layer = 'performance') AS perf, count(*) FILTER (layer = 'patterns') AS pat FROM findings GROUP BY repo) c USING (repo)
  LEFT JOIN cost_summary cs USING (repo) LEFT JOIN test_counts t USING (repo))"""
    sql["scan_summary"] = everything(f"""SELECT repo, CAST(position AS INTEGER) AS position, category, status, findings FROM (
  SELECT repo, 1 AS position, 'Stack' AS category, primary_language || ' / ' ||
    coalesce(nullif(array_to_string(string_split(frameworks, ',')[:{SHOWN_FRAMEWORKS}], ', '), ''), 'N/A') AS status, '' AS findings FROM wide
  UNION ALL SELECT repo, 2, 'Dependencies', total_deps || ' total', heavy || ' heavy, ' || deprecated || ' deprecated' FROM wide
  UNION ALL SELECT repo, 3, 'Security', CASE WHEN sec_critical > 0 THEN 'CRITICAL' ELSE 'OK' END, sec || ' findings (' || sec_critical || ' critical)' FROM wide
  UNION ALL SELECT repo, 4, 'Cost Risk', risk, service_count || ' services, ' || scaling_traps || ' traps' FROM wide
  UNION ALL SELECT repo, 5, 'Performance', perf || ' issues', '' FROM wide
  UNION ALL SELECT repo, 6, 'Tests', coverage, test_file_count || '/' || source_file_count || ' ratio' FROM wide
  UNION ALL SELECT repo, 7, 'Patterns', pat || ' findings', '' FROM wide)""", langs, wide)
    sql["layer_summaries"] = everything("""SELECT repo, total_deps, heavy, deprecated, sec, sec_critical, perf, pat, service_count,
  scaling_traps, test_file_count, source_file_count FROM wide""", langs, wide)
    sql["plan_header"] = everything("""SELECT repo, primary_language, coalesce(nullif(replace(frameworks, ',', ', '), ''), 'None') AS frameworks,
  sec_critical AS security_critical, risk AS cost_risk, coverage AS test_coverage FROM wide""", langs, wide)

    sql["findings_diff"] = with_ctes(*_diff(), select="SELECT * FROM diff")
    sql["findings_replaced"] = with_ctes(*_diff(), select="SELECT repo, rule, path AS file, line, severity, match FROM h2")
    sql["quality_gate"] = with_ctes(*_diff(), select="""SELECT repo, coalesce(new_critical, 0) AS new_critical, coalesce(new_critical, 0) = 0 AS passed
FROM (SELECT DISTINCT repo FROM files) LEFT JOIN (
  SELECT repo, CAST(sum(CASE WHEN severity = 'critical' AND after_count > before_count THEN after_count - before_count ELSE 0 END) AS BIGINT) AS new_critical
  FROM diff GROUP BY repo) USING (repo)""")
    sql["area_findings"] = with_ctes(FILES, hits_sql(R.GENERAL), select=f"SELECT repo, rule, path AS file, line, match FROM hits WHERE contains(lower(path), {q(queries.AREA)})")
    sql["feature_slugs"] = """SELECT p_partkey, coalesce(nullif(trim(regexp_replace(lower(p_name || ' / ' || p_type), '[^a-z0-9]+', '-', 'g'), '-'), ''), 'feature') AS slug FROM part"""

    sql["rescan_stream"] = with_ctes(DOCS, hits_sql(queries.HARDCODED), select="SELECT repo, rule, path AS file, line, match FROM hits")
    windows = f"""SELECT date_trunc('minute', ts) AS window_start, date_trunc('minute', ts) + INTERVAL 1 MINUTE AS window_end,
  event_type, count(*) AS requests FROM events GROUP BY ALL HAVING count(*) > {queries.STREAM_LIMIT}"""
    sql["rate_limit_windows"] = windows
    sql["rate_limit_stream"] = windows
    sql["oversized_files"] = with_ctes(DOCS, select=f"SELECT repo, path AS file, CAST({LINES} AS INTEGER) AS lines FROM files WHERE {LINES} >= {queries.MIN_LINES}")
    k = queries.COPY_LINES
    sql["copy_paste"] = with_ctes(DOCS, f"""normal AS (
  SELECT repo, path, list_filter(list_transform(string_split(content, chr(10)),
    lambda x: lower(trim(regexp_replace(x, '[ \\t]+', ' ', 'g'), ' '))), lambda x: x <> '') AS ls FROM files),
blocks AS (
  SELECT repo, path, md5(array_to_string(ls[i:i + {k - 1}], chr(10))) AS digest
  FROM normal, LATERAL (SELECT unnest(range(1, len(ls) - {k} + 2)) AS i))""", select="""
SELECT digest, count(DISTINCT (repo, path)) AS files, count(*) AS occurrences,
  min((repo, path))[1] AS first_repo, min((repo, path))[2] AS first_path
FROM blocks GROUP BY digest HAVING count(DISTINCT (repo, path)) > 1""")
    return sql
