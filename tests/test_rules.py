"""Every rule against Python's ``re`` with the flags the rules are written for."""

import random
import re
from collections import Counter
from dataclasses import replace

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from checks.corpus import SNIPPETS
from fleetlint.catalog.packs import PACKS
from fleetlint.catalog.rules import AUTH, GENERAL, JAVASCRIPT, PATTERN_RULES, PYTHON, SECRETS, TEST_SMELLS, TRAPS, Rule
from fleetlint.catalog.services import SERVICE_RULES, SERVICES
from fleetlint.functions import regex
from fleetlint.operators import scan

RULES = PATTERN_RULES + SECRETS + AUTH + TRAPS + SERVICE_RULES + TEST_SMELLS + tuple(
    rule for pack in PACKS.values() for rule in pack["rules"])
TEXT_RULES = tuple(replace(rule, kind="text", extensions=None) for rule in RULES)

EXTRA = [
    "", "\n", "no match at all", "if x == 12345\u0661:\n", "i\u017f token = 'abcdefghijklmnop12'",
    "PA\u017f\u017fWORD = 'abcdefghijklmnop12'", "to\u212aen: \"ABCDEFGHIJKLMNOPQR\"", "WH\u0130LE (true)",
    "\u00e9t\u00e9, _ := os.Open(", "cookie\r\ncookie secure", " " * 16 + "if a:\n" + "\t" * 17 + "while b",
    "fetch\nawait fetch(a)\n\n  .then(b)\nawait fetch(b) ;\n", "pd.read_csv('a')  \n chunksize", "pd.read_csv('a') , chunksize",
    "\n".join("TODO" if i % 2 else "x" for i in range(2000)), "SELECT * FROM t", "SELECT * FROM t ;\nSELECT * FROM u\n",
    "it('a', () => { b }) it('c', () => { d }) expect", "console.log(" * 700 + "\n" + "console.log(\n" * 700,
    "for u in users:\n\n    x.objects.filter(1)", "useEffect(() => {\n\n}\n)\n;", "x = 5; while True :\npass",
    "upload_to='uploads'\nmulter({ dest: \"./x\" })", "knex({client: 'sqlite'})", "gh" + "p_" + "a" * 36,
    "debugger;\r\nimport  pdb\rpdb.set_trace()", "\u00e4\u00f6\u00fc password === gr\u00f6\u00dfe", "a\u0301_b, _ = c.d(",
    "SK-" + "a" * 30, "AK" + "IA" + "a" * 16, "process.env.next_public_x_secret", "exec\u0131t",
]
TEXTS = EXTRA + [body.replace("@PEER@", "7") for bodies in SNIPPETS.values() for body in bodies]


def flags_of(rule):
    return (re.I if rule.ignore_case else 0) | (re.M if rule.multiline else 0)


def expected(rule, text):
    text = re.sub("\r\n?", "\n", text)
    if rule.exists_only:
        return Counter([(None, None, None)] if re.search(rule.pattern, text, flags_of(rule)) else [])
    return Counter(
        (text[:m.start()].count("\n") + 1, m.group(0)[:120], m.group(0)[-4:])
        for m in re.finditer(rule.pattern, text, flags_of(rule)))


@pytest.fixture(scope="module")
def found(spark, make_files):
    files = make_files([("r", f"{i}.txt", text) for i, text in enumerate(TEXTS)]).repartition(4, "path")
    rows = {}
    for rules in (TEXT_RULES, tuple(replace(rule, needs=()) for rule in TEXT_RULES)):
        hits = scan.scan(files, rules).collect()
        result = {}
        for h in hits:
            key = (h.rule_ix, int(h.path.split(".")[0]))
            result.setdefault(key, Counter())[(h.line, h.match, h.match_end)] += 1
        rows[bool(rules[0].needs)] = result
    return rows


def test_every_rule_matches_like_python(found):
    wrong = []
    for i, rule in enumerate(TEXT_RULES):
        for j, text in enumerate(TEXTS):
            want = expected(rule, text)
            got = found[True].get((i, j), Counter())
            if want != got:
                wrong.append((rule.rule_id, j, list((want - got).items())[:2], list((got - want).items())[:2]))
    assert not wrong, wrong[:5]


def test_word_gates_change_nothing(found):
    assert found[True] == found[False]


def test_every_rule_has_a_hit_and_a_miss():
    for rule in RULES:
        hits = [bool(expected(rule, text)) for text in TEXTS]
        assert any(hits), rule.rule_id
        assert not all(hits), rule.rule_id


@pytest.mark.parametrize("rule_id, path, content, want", [
    ("star_import", "a.py", "import a\n\nfrom os import *\n", [(3, "from os import *")]),
    ("star_import", "a.js", "from os import *", []),
    ("bare_except", "a.py", "except :", [(1, "except :")]),
    ("bare_except", "a.py", "except ValueError:", []),
    ("no_pagination", "a.go", "x\nSELECT * FROM t;\ny", [(2, "SELECT * FROM t;")]),
    ("no_pagination", "a.go", "SELECT a FROM t", []),
    ("deep_nesting", "a.py", " " * 16 + "if x", [(1, " " * 16 + "if")]),
    ("deep_nesting", "a.py", " " * 12 + "if x", []),
    ("todo_fixme", "node_modules/a.py", "TODO", []),
    ("todo_fixme", "A.PY", "\r\n\r\nTODO", [(3, "TODO")]),
    ("todo_fixme", "a.md", "TODO", []),
])
def test_examples(spark, make_files, rule_id, path, content, want):
    rules = [r for r in PATTERN_RULES if r.rule_id == rule_id]
    rows = scan.scan(make_files([("r", path, content)]), rules).collect()
    assert sorted((r.line, r.match) for r in rows) == want


def test_secrets_are_case_sensitive(spark, make_files):
    body = "AK" + "IA" + "ABCDEFGHIJKLMNOP"
    files = make_files([("r", "a.py", body), ("r", "b.py", body.lower()), ("r", ".env.old", body), ("r", "prod.env", body),
                        ("r", "notes.txt", body), ("r", "dist/a.py", body)])
    assert sorted(h.path for h in scan.scan(files, SECRETS).collect()) == [".env.old", "a.py", "prod.env"]


def test_long_match_is_cut_but_its_end_is_kept(spark, make_files):
    token = "sk" + "-" + "a" * 300 + "WXYZ"
    row = scan.scan(make_files([("r", "a.py", "x " + token)]), SECRETS).first()
    assert row.match == token[:120] and row.match_end == "WXYZ"


def test_category_needs_the_language(spark, make_files):
    files = make_files([("both", "a.js", "eval(x)"), ("both", "b.ts", "x"), ("js", "a.js", "eval(x)"),
                        ("vue", "a.vue", "v-html"), ("vue", ".env/b.ts", "eval(x)")])
    from fleetlint.operators import stack
    names = stack.language_names(files)
    rules = JAVASCRIPT
    rows = scan.scan_project(files, names, rules, max_files=None).collect()
    assert sorted((r.repo, r.rule, r.category) for r in rows) == [
        ("both", "eval_usage", "javascript"), ("both", "eval_usage", "typescript"), ("js", "eval_usage", "javascript")]
    rows = scan.scan_project(files, names, rules, max_files=None, dedupe=True).collect()
    assert sorted(r.repo for r in rows) == ["both", "js"]


def test_only_the_first_files_are_scanned(spark, make_files):
    # "a/z" sorts before "a-b" as a file walk does: folder a comes first.
    paths = ["a/z.py", "a-b.py", "b/c/d.py", "b/c.py", "c.py", "skip.md", "dist/x.py"]
    files = make_files([("r", p, "TODO") for p in paths] + [("s", "c.py", "TODO")])
    from fleetlint.operators import stack
    names = stack.language_names(files)
    rows = scan.scan_project(files, names, GENERAL, max_files=3).collect()
    assert sorted((r.repo, r.file) for r in rows) == [("r", "a-b.py"), ("r", "a/z.py"), ("r", "b/c/d.py"), ("s", "c.py")]
    assert scan.scan_project(files, names, GENERAL, max_files=5).count() == 6
    assert scan.scan_project(files, names, GENERAL, max_files=None).count() == 6


def test_many_large_repositories_join_instead_of_broadcast(spark, make_files, monkeypatch):
    files = make_files([(repo, f"{i}.py", "TODO") for repo in "abc" for i in range(6)] + [("d", "x.py", "TODO")])
    broadcast = {tuple(r) for r in scan.mark_first_files(files, 4).select("repo", "path", "in_first").collect()}
    monkeypatch.setattr(scan, "MAX_BROADCAST_REPOS", 1)
    joined = {tuple(r) for r in scan.mark_first_files(files, 4).select("repo", "path", "in_first").collect()}
    assert joined == broadcast and len(joined) == 19
    assert sum(keep for _, _, keep in joined) == 13


def test_scan_does_not_depend_on_partitions(spark, make_files):
    files = make_files([("r", f"{i}.py", t) for i, t in enumerate(TEXTS)])
    one = Counter(map(str, scan.scan(files.coalesce(1), PYTHON + GENERAL).collect()))
    many = Counter(map(str, scan.scan(files.repartition(7), PYTHON + GENERAL).collect()))
    assert one == many and one


def test_scan_reads_texts_once_and_never_shuffles_them(spark, make_files):
    plan = scan.scan(make_files([("r", "a.py", "x")]), RULES)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    assert plan.count("regexp_replace(") == sum(not r.exists_only for r in RULES)


def test_files_without_text_have_no_hits(spark, make_files):
    assert scan.scan(make_files([("r", "a.py", None, 5), ("r", "b.py", "x", 1)]), RULES).count() == 0


def test_services_use_one_rule_each():
    assert [r.rule_id for r in SERVICE_RULES] == [s.service_id for s in SERVICES]


def test_every_rule_runs_in_the_jvm_without_recursion():
    assert all(regex.runs_in_jvm(rule) for rule in RULES)
    assert regex.repeats_group(r"(?:a\s*)+b") and regex.repeats_group("(a){2,}")
    assert not regex.repeats_group(r"(a)?[)*]\)*(b){2,3}")


@pytest.mark.parametrize("rule_id, path, text", [
    ("no_cache_layer", "a.js", "app.get('/x') " + "find x " * 30_000),
    ("no_type_hints", "a.py", "def f(self, a" + ", b" * 30_000 + "):"),
    ("test_implementation", "a.test.js", "jest.fn()" * 30_000),
    ("useeffect_no_deps", "a.tsx", "useEffect(() => {" + " x\n" * 30_000 + "});"),
    ("goroutine_no_recover", "a.go", "go func() {" + "\n x" * 30_000),
    ("mutable_default", "a.py", "def f(" + "a, " * 30_000 + "b=[])"),
    ("sql_string_format", "a.py", "execute('" + "{} " * 30_000),
])
def test_long_repetitions(spark, make_files, rule_id, path, text):
    rules = [r for r in RULES if r.rule_id == rule_id][:1]
    row = scan.scan(make_files([("r", path, text)]), rules).collect()
    assert [(r.line, r.match, r.match_end) for r in row] == list(expected(rules[0], text))


def test_repeated_groups_of_other_rules_run_in_python(spark, make_files):
    rules = [Rule("pattern", "x", "words", "info", r"(?:ab\s*)+c", extensions=(".py",)),
             Rule("pattern", "x", "seen", "info", r"(?:xy)*z", exists_only=True), GENERAL[4]]
    texts = {"a.py": "ab ab c\nTODO\nAB c z", "b.js": "xyxyz", "c.py": "ab " * 30_000 + "\nc"}
    rows = scan.scan(make_files([("r", p, t) for p, t in texts.items()]), rules).collect()
    got = Counter((r.path, r.rule_ix, r.line, r.match, r.match_end) for r in rows)
    want = Counter()
    for path, text in texts.items():
        for i, rule in enumerate(rules):
            if rule.extensions is None or path.endswith(rule.extensions):
                for key, n in expected(rule, text).items():
                    want[(path, i, *key)] += n
    assert got == want and len(want) >= 5


def test_words_of_a_text_are_collected_in_one_pass(spark):
    words = regex.needed_words(RULES)
    assert len(words) >= regex.MANY_WORDS
    texts = EXTRA + [b for bodies in SNIPPETS.values() for b in bodies] + [
        "".join(w[:k] + w for w in words[i::7]) for i in range(7) for k in (1, 2, 5)] + words
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, content string").selectExpr("i", "lower(content) AS low")
    found = rows.select("i", "low", regex.words_in(rows["low"], words).alias("few")).collect()
    for row in found:
        assert [w in row.low for w in words] == [w in row.few for w in words], row.low
    assert any(len(row.few) < len(row.low) for row in found)
    assert spark.range(1).selectExpr("CAST(NULL AS string) AS t").select(regex.words_in(F.col("t"), words)).first()[0] is None
    few = words[:regex.MANY_WORDS - 1]
    assert spark.range(1).selectExpr("'abc' AS t").select(regex.words_in(F.col("t"), few)).first()[0] == "abc"


def test_a_bare_number_is_looked_for_only_behind_its_last_character(spark, make_files):
    rule = next(r for r in GENERAL if r.rule_id == "magic_number")
    texts = ["WHILE\x1c 123", "x 123", "f١٢٣", "IF 1234 > 999", "a=12", "for\n\n456", "return(789)"]
    assert rule.gate and all(re.search(rule.gate, t) for t in texts if re.search(rule.pattern, t, re.I | re.M))
    files = make_files([("r", f"{i}.py", t) for i, t in enumerate(texts)])
    got = Counter((r.path, r.match) for r in scan.scan(files, [rule]).collect())
    assert got == Counter((f"{i}.py", m.group(0)) for i, t in enumerate(texts) for m in re.finditer(rule.pattern, t, re.I | re.M))


def test_words_are_found_within_single_texts_only(spark):
    words = sorted({f"w{i:02d}" + "abcdefghij"[:i % 11] * (1 + i % 3) for i in range(40)} | {"é", "=", "éa", "zz", "日本", "日本語の文"})
    rng = random.Random(7)
    texts = [None, ""] + ["".join(rng.choice([*words, *(w[:-1] for w in words), " ", "\n"]) for _ in range(rng.randrange(1, 9))) for _ in range(400)]
    texts += [part for w in words for part in (w[:2], w[2:])] + words
    find = regex._word_finder(words)
    want = [None if t is None else [w for w in words if w in t] for t in texts]
    column = pa.array(texts)
    for found in (find(column), *(pa.concat_arrays([find(column.slice(i, n)) for i in range(0, len(texts), n)]) for n in (1, 7, 300))):
        assert [None if t is None else t.split("\n") if t else [] for t in found.to_pylist()] == want
    rows = spark.createDataFrame([("x w03abc",)], "t string")
    plan = rows.select(regex.words_in(F.col("t"), words).alias("few"))
    assert "regexp" not in plan._jdf.queryExecution().toString() and plan.first()[0] == "w03abc" and words.count("w03abc") == 1


def test_places_are_passed_over_by_their_first_character():
    def look(pattern, ignore_case=True):
        return regex._first_look(pattern, ignore_case)

    assert look("(?:TODO|FIXME)\\b") == "(?-iU:(?=[FTft]))" and look("AKIA", False) == "(?-iU:(?=[A]))"
    assert look("if|skip") == "(?-iU:(?=[ISis\u0130\u0131\u017f]))" and look("(?i)kb", False) == "(?-iU:(?=[Kk\u212a]))"
    assert look("a?b+(?=c)") == "(?-iU:(?=[ABab]))" and look("[=!]=|^x", False) == "(?-iU:(?=[\\x{21}\\x{3d}x]))"
    assert not any(look(p) for p in (r"\w+x", ".x", "[^a]b", "a*", "(?:a|)", r"\s+a", "é", r"\p{L}", "(?:(?-i:a)|b)"))


def test_a_flag_inside_a_pattern_counts_for_its_first_character(spark, make_files):
    rules = [Rule("text", "x", "a", "info", "(?i)todo|kelvin", ignore_case=False), Rule("text", "x", "b", "info", "todo|kelvin", ignore_case=False)]
    got = Counter((r.rule_ix, r.match) for r in scan.scan(make_files([("r", "a.txt", "TODO todo \u212aelvin Kelvin")]), rules).collect())
    assert got == Counter([(0, "TODO"), (0, "todo"), (0, "\u212aelvin"), (0, "Kelvin"), (1, "todo")])
