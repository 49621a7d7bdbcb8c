"""Security, cost, performance and test layers on small fixtures."""

import random
import re

import pytest

from fleetlint.catalog import testing as T
from fleetlint.catalog.rules import TEST_SMELLS, TRAPS
from fleetlint.catalog.services import SERVICE_RULES
from fleetlint.operators import cost, knowledge, manifests, performance, scan, security, stack, testing
from fleetlint.plans.fleet import FleetScan


def test_dangerous_files(spark, make_files):
    files = make_files([
        ("a", ".gitignore", "node_modules\n.env\n"), ("a", ".env", ""), ("a", "x/my.env", ""), ("a", "k/server.key", ""),
        ("b", ".env", ""), ("b", ".env.local", ""), ("b", "certs.pem/a.txt", ""), ("b", "certs.pem/b.txt", ""),
        ("b", "dist/x.pem", ""), ("b", "sub/.gitignore", "*.pfx"), ("b", "y.pfx", ""), ("c", "readme", "")])
    rows = sorted((r.repo, r.file, r.rule) for r in security.dangerous_files(files).collect())
    assert rows == [("a", "k/server.key", ".key"), ("b", ".env", ".env"), ("b", ".env.local", ".env.local"),
                    ("b", "certs.pem", ".pem"), ("b", "y.pfx", ".pfx")]


def test_services(spark, make_files):
    files = make_files(
        [("r", ".env", "OPENAI_API_KEY=1\nVERCEL_TOKEN=2"), ("r", "sub/.env", "STRIPE_SECRET_KEY=1")]
        + [("r", f"f{i}.py", "openai.chat") for i in range(9)] + [("r", "dist/z.py", "twilio.x"), ("s", "a.go", "TWILIO(")])
    hits = scan.scan_rules(files, SERVICE_RULES)
    rows = {(r.repo, r.service_id): r for r in cost.service_findings(cost.env_evidence(files), cost.code_evidence(hits)).collect()}
    assert rows[("r", "openai")].detected_via == ["env:OPENAI_API_KEY"] + [f"code:f{i}.py" for i in range(4)]
    assert rows[("r", "vercel")].detected_via == ["env:VERCEL_TOKEN", "env:VERCEL"]
    assert set(rows) == {("r", "openai"), ("r", "vercel"), ("s", "twilio")}


@pytest.mark.parametrize("services, want", [
    (["high", "high"], "high"), (["high"], "medium"), (["low"] * 3, "medium"), (["low", "medium"], "low"), ([], "low")])
def test_monthly_risk(spark, make_files, services, want):
    rows = spark.createDataFrame([("r", s) for s in services], "repo string, risk_level string")
    traps = spark.createDataFrame([("r",)], "repo string")
    summary = cost.cost_summary(traps, rows, traps).first()
    assert summary.total_monthly_risk == want and summary.total_findings == len(services) + 1


def test_traps_count_once_per_file(spark, make_files):
    files = make_files([("r", "a.py", "sqlite3\nsqlite3\nsession = {}"), ("r", "a.md", "sqlite3")])
    rows = cost.trap_findings(scan.scan_rules(files, TRAPS)).collect()
    assert sorted((r.file, r.trap) for r in rows) == [("a.py", "in_memory_session"), ("a.py", "sqlite_production")]


def test_images(spark, make_files):
    rows = [("r", "a.PNG", None, 512001), ("r", "b.jpg", None, 512000), ("r", "c.svg", None, 512001 + 511), ("r", "dist/d.png", None, 10**6),
            ("r", "e.txt", None, 10**6), ("r", "f.gif", None, 1024 * 501 + 512), ("r", "g.gif", None, 1024 * 502 + 512)]
    got = {r.file: r.size_kb for r in performance.large_images(make_files(rows)).collect()}
    assert got == {p: round(s / 1024) for _, p, _, s in rows if p in ("a.PNG", "c.svg", "f.gif", "g.gif")}


def test_missing_optimizations(spark, make_files):
    files = make_files([
        ("n", "next.config.js", ""), ("n", "src/a.tsx", "next/image Suspense"), ("n", "lib/b.tsx", "next/font"), ("n", "app/c.jsx", "next/dynamic"),
        ("r", "package.json", '{"dependencies": {"react": "1"}}'), ("r", "dist/x.jsx", "Suspense"), ("v", "a.tsx", "")])
    rows = performance.missing_optimizations(files, stack.stack(files, manifests.dependencies(files))).collect()
    assert sorted((r.repo, r.rule) for r in rows) == [("n", "next/dynamic"), ("n", "next/font"), ("r", "Suspense")]


def brute_tests(rows, languages):
    patterns = [p for x in languages for p in T.TEST_PATHS.get(x, ())] or [p for ps in T.TEST_PATHS.values() for p in ps]
    return {path for _, path, _ in rows if not path.startswith("dist/") and any(re.search(p, path) for p in patterns)}


def test_test_files_follow_the_languages(spark, make_files):
    paths = ["a.test.ts", "tests/x.py", "pkg/a_test.go", "b.ts", "FooTest.java", "dist/c.test.ts"]
    rows = [("ts", p, "") for p in paths if not p.endswith((".py", ".go", ".java"))] + [("mix", p, "") for p in paths]
    files = make_files(rows)
    got = {(r.repo, r.path) for r in testing.test_files(files, stack.language_names(files)).collect()}
    # TypeScript has no patterns of its own: alone it falls back to all languages.
    assert got == {("ts", "a.test.ts")} | {("mix", p) for p in brute_tests([("mix", p, "") for p in paths], ["typescript", "python", "go", "java"])}
    assert ("mix", "a.test.ts") not in got


def test_counts_and_bands(spark, make_files):
    rows = [("none", "a.py", "")] + [("half", f"{i}.py", "") for i in range(4)] + [("half", "tests/integration_e2e.py", "")]
    rows += [("all", "test_a.py", ""), ("text", "a.md", "")]
    files = make_files(rows)
    got = {r.repo: r for r in testing.test_counts(files, stack.language_names(files)).collect()}
    assert (got["none"].test_ratio_percent, got["none"].coverage_estimate) == (0.0, "none")
    assert (got["half"].source_file_count, got["half"].test_file_count, got["half"].test_ratio_percent) == (5, 1, 20.0)
    assert got["half"].coverage_estimate == "moderate" and got["half"].missing_test_types == []
    assert got["all"].coverage_estimate == "excellent" and got["all"].missing_test_types == ["integration", "e2e"]
    assert got["text"].source_file_count == 0 and got["text"].missing_test_types == ["unit", "integration", "e2e"]


def test_untested_equals_brute_force(spark, make_files):
    rng = random.Random(3)
    stems = ["login", "Login2", "user.login", "[token]", "pay ment", "auth-\u00e9t\u00e9", "s" * 200 + "auth", "t" * 300 + "auth", "u[" * 400 + "auth", "v" * 1000 + "auth", "api+x", "auth_1", "a[1]auth"]
    rows = []
    for repo in ("a", "b", "c"):
        for i, stem in enumerate(stems):
            rows.append((repo, f"auth/api/{stem}.py", rng.choice(["login token", "route handler", "nothing", "LOGIN api"])))
        for i in range(4):
            words = [rng.choice(stems).upper() if rng.random() < 0.5 else rng.choice(["x", "lo gin", "mylogin3x", "[tok en]"]) for _ in range(3)]
            body = "z" * rng.choice([0, 250, 255, 256, 300, 511]) + rng.choice(["", " "]) + rng.choice(["\n", ""]).join(words)
            rows.append((repo, f"tests/t{i}.py", body))
    rows.append(("d", "auth/login.py", "token"))
    files = make_files(rows)
    got = {(r.repo, r.category, r.file) for r in FleetScan(files, None, rules=testing.CRITICAL_RULES).untested.collect()}
    want = set()
    for repo, path, body in rows:
        tests = "\n".join(b.lower() for r, p, b in rows if r == repo and (p.startswith("tests/") or "test_" in p))
        stem = path.rsplit("/", 1)[1][:-3].lower()
        for category, words in T.CRITICAL_WORDS.items():
            if any(w in body.lower() for w in words) and any(w in path.lower() for w in words) and stem not in tests:
                want.add((repo, category, path))
    assert got == want and len(want) > 10


def test_smells_only_in_tests(spark, make_files):
    files = make_files([("r", "test_a.py", "x\nsleep(1000)"), ("r", "a.py", "sleep(1000)"), ("r", "b_test.go", "sleep(1000)")])
    hits = scan.scan_rules(files, TEST_SMELLS)
    rows = testing.smell_findings(hits, stack.language_names(files)).collect()
    assert sorted((r.file, r.line) for r in rows) == [("b_test.go", 1), ("test_a.py", 2)]


def test_oversized_and_copied(spark, make_files):
    block = "\n".join(f"line {i}" for i in range(6))
    files = make_files([("r", "a.py", block + "\nx"), ("r", "b.py", "\n\n" + block.upper().replace(" ", "  \t ") + "\n"), ("r", "c.py", block[:20]),
                        ("r", "d.py", "a\n" * 500), ("r", "e.py", "a\n" * 498 + "b")])
    assert [(r.file, r.lines) for r in knowledge.oversized_files(files).collect()] == [("d.py", 500)]
    rows = knowledge.copied_blocks(files).collect()
    shared = [r for r in rows if r.first_path == "a.py"]
    assert [(r.files, r.occurrences) for r in shared] == [(2, 2)]
    same = [r for r in rows if r.first_path == "d.py"]
    assert [(r.files, r.occurrences) for r in same] == [(2, 495 + 493)]


def test_pieces_that_no_stem_fits_in_are_not_moved(spark, make_files, monkeypatch):
    stems = ["login_main", "pay[x]auth", "token{y}"]
    rows = [("r", f"auth/api/{stem}.py", "login token") for stem in stems]
    rows += [("r", "tests/test_a.py", "see login_main2 pay[x]aut\n" + "short words only in this line\n" * 3 + "a token{y} b")]
    files = make_files(rows)
    fleet = FleetScan(files, None, rules=testing.CRITICAL_RULES)
    got = {}
    for most in (testing.MAX_ANCHORS, 0):
        monkeypatch.setattr(testing, "MAX_ANCHORS", most)
        for plain in (True, False):
            found = testing.mentioned_stems(fleet.critical_files, files, fleet.language_names, plain)
            got[most > 0, plain] = {row.stem for row in found.collect()}
            plan = found._jdf.queryExecution().optimizedPlan().toString().lower()
            moved = next(line for line in plan.split("\n") if "filter" in line and "length(piece" in line and "generate" not in line)
            assert ("contains(piece" in moved) == bool(most and not plain)
    assert got == {(True, True): {"login_main"}, (True, False): {"token{y}"}, (False, True): {"login_main"}, (False, False): {"token{y}"}}
