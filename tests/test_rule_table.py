"""Rule packs as data: one plan for any number of rules, equal to Python's engine."""

import re

from fleetlint.operators import rule_table

RULES = [("p", "todo", "info", r"(?:TODO|FIXME)\b", "", "", None, True, True),
         ("p", "eval", "high", r"\beval\s*\(", "", "", [".js"], True, True),
         ("p", "digits", "low", r"\d{4,}", "", "", None, True, False),
         ("p", "kelvin", "low", r"kelvin", "", "", None, True, True),
         ("p", "bad", "low", r"(unclosed", "", "", None, True, True),
         ("p", "empty", "low", "", "", "", None, True, True)]
FILES = [("r", "a.js", "x = eval(1) // TODO\nfixme later 12345\n"), ("r", "b.py", "eval (2)\nKELVIN Kelvin 2024"),
         ("r", "c.py", None), ("r", "node_modules/d.js", "eval(3)"), ("s", "e.go", "todo todo\n" * 3000)]


def brute(files, rules):
    out = []
    for repo, path, text in files:
        if text is None or path.startswith("node_modules/"):
            continue
        for pack, rule_id, sev, pattern, _, _, ext, ic, ml in rules:
            try:
                compiled = re.compile(pattern, (re.I if ic else 0) | (re.M if ml else 0)) if pattern else None
            except re.error:
                continue
            if compiled is None or (ext and not path.endswith(tuple(ext))):
                continue
            for m in compiled.finditer(text):
                out.append((repo, path, rule_id, text.count("\n", 0, m.start()) + 1, m.group(0)))
    return sorted(out)


def test_scan_equals_python(spark, make_files):
    rules = spark.createDataFrame(RULES, rule_table.RULE_SCHEMA)
    got = sorted((r.repo, r.path, r.rule_id, r.line, r.match) for r in rule_table.scan_table(make_files(FILES), rules).collect())
    assert got == brute(FILES, RULES)
    assert any(r[2] == "kelvin" and "K" in r[4] for r in got)
    assert {(r.rule_id) for r in rule_table.rejected(rules).collect()} == {"bad", "empty"}


def test_required_literals():
    assert rule_table.required_literals(r"(?:api_?key|secret)\s*=") == ["api", "secret"]
    assert rule_table.required_literals(r"\d+") is None
    assert rule_table.required_literals(r"(?:ab|x)c") is None
    assert rule_table.required_literals(r"(?:foo)+bar") in (["foo"], ["bar"])
    for pattern in [r"(?i)hello\s+world", r"x(?:abc){2,}y", r"(?:catch|rescue)\s+Exception"]:
        for literal in rule_table.required_literals(pattern):
            assert any(literal in m.group(0).lower() for m in re.finditer(pattern, "HELLO   world xabcabcy catch Exception", re.I))


def test_plan_does_not_grow_with_rules(spark, make_files):
    files = make_files(FILES)

    def plan(n):
        rows = [("g", f"r{k}", "info", rf"\bold_api_{k}\(", "", "", None, True, True) for k in range(n)]
        df = rule_table.scan_table(files, spark.createDataFrame(rows, rule_table.RULE_SCHEMA))
        return re.sub(r"#\d+L?|\[plan_id=\d+\]", "", df._jdf.queryExecution().optimizedPlan().toString())

    assert plan(10) == plan(1000)
