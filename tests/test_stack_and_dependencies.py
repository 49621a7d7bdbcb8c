from fleetlint.operators import dependencies, knowledge, manifests, stack


def deps_of(df):
    return sorted((r.repo, r.name, r.version) for r in df.collect())


def test_package_json(spark, make_files):
    files = make_files([
        ("both", "package.json", '{"dependencies": {"a": "1", "b": "1"}, "devDependencies": {"b": "2"}}'),
        ("bad", "package.json", '{"dependencies": '), ("bad", "frontend/package.json", '{"dependencies": {"c": "1"}}'),
        ("bad", "client/package.json", '{"dependencies": {"d": "1"}}'),
        ("list", "package.json", '[1, 2]'), ("list", "apps/web/package.json", '{"devDependencies": {"e": "^1"}}'),
        ("wrong", "package.json", '{"dependencies": ["x"]}'), ("wrong", "client/package.json", '{"dependencies": {"f": "1"}}'),
        ("none", "package.json", '{"name": "n"}'), ("none", "client/package.json", '{"dependencies": {"g": "1"}}'),
        ("deep", "sub/package.json", '{"dependencies": {"h": "1"}}'),
        ("quotes", "package.json", "{'dependencies': {'i': '1'}}"),
    ])
    assert deps_of(manifests.package_json_deps(files)) == [
        ("bad", "c", "1"), ("both", "a", "1"), ("both", "b", "2"), ("list", "e", "^1"), ("wrong", "f", "1")]


def test_package_json_with_repeated_names_trailing_text_and_nulls(spark, make_files):
    files = make_files([
        ("twice", "package.json", '{"dependencies": {"a": "1", "a": "2", "b": "1"}, "devDependencies": {"b": "2", "b": "3"}}'),
        ("more", "package.json", '{"dependencies": {"c": "1"}} garbage'), ("more", "client/package.json", '{"dependencies": {"d": "1"}}'),
        ("null", "package.json", '{"dependencies": null}'), ("null", "client/package.json", '{"dependencies": {"e": "1"}}'),
        ("two", "package.json", '{"dependencies": {"f": "1"}}, {}'),
    ])
    assert deps_of(manifests.package_json_deps(files)) == [
        ("more", "d", "1"), ("null", "e", "1"), ("twice", "a", "2"), ("twice", "b", "3")]


def test_python_manifests(spark, make_files):
    files = make_files([
        ("r", "requirements.txt", "# c\n-r x\n\n  Flask >= 1\nboto3~=1\nx[y]>1;z\n=odd\nflask==2\npkg ; python>3\n"),
        ("r", "pyproject.toml", 'name = "My-App"\ndeps = ["uvicorn[standard]>=1", "a b", "flask"]'),
    ])
    assert [n for _, n, _ in deps_of(manifests.python_deps(files))] == ["boto3~", "flask", "my-app", "pkg", "uvicorn", "x"]
    assert "boto3" in [n for _, n, _ in deps_of(manifests.python_deps(files, compatible_operator=True))]


def test_go_and_cargo(spark, make_files):
    files = make_files([
        ("r", "go.mod", "module a/b\ngo 1.2\nrequire x/y v1\nrequire (\n\tp/q v1\n  r/s v2 // z\n//c/d\n)\n"),
        ("r", "Cargo.toml", '[package]\nname = "x"\n[dependencies]\na = "1"\n b = "2"\nc="3"\n[target.x.dev-dependencies]\n'
                            'd = { v = "1" }\n[features]\ne = []\n'),
    ])
    assert [n for _, n, _ in deps_of(manifests.go_deps(files))] == ["p/q", "r/s"]
    assert [n for _, n, _ in deps_of(manifests.cargo_deps(files))] == ["a", "c", "d"]


def test_merged_versions(spark, make_files):
    files = make_files([("r", "package.json", '{"dependencies": {"flask": "1", "a": "2"}}'), ("r", "requirements.txt", "flask")])
    assert deps_of(manifests.merged_dependencies(manifests.dependencies(files))) == [("r", "a", "2"), ("r", "flask", "*")]


def test_languages(spark, make_files):
    files = make_files([("r", f"{i}.go", "") for i in range(6)] + [
        ("r", "a.py", ""), ("r", "b.js", ""), ("r", "package.json", ""), ("r", "bin/x.rs", ""), ("r", "d/App.csproj", ""),
        ("r", "p.cs", ""), ("r", "q.R", ""), ("empty", "README", "")])
    rows = {r.repo: r for r in stack.languages(files).collect()}
    assert [(x.name, x.file_count, x.has_marker, x.confidence) for x in rows["r"].languages] == [
        ("go", 6, False, "high"), ("python", 1, False, "low"), ("javascript", 1, True, "high"),
        ("csharp", 1, True, "high"), ("r", 1, False, "low")]
    assert rows["r"].primary_language == "go" and rows["empty"].primary_language == "unknown"


def test_stack_row(spark, make_files):
    files = make_files([
        ("r", "package.json", '{"dependencies": {"next-auth": "1", "preact": "1"}}'), ("r", "yarn.lock", ""),
        ("r", "requirements.txt", "x"), ("r", "manage.py", ""), ("r", "Dockerfile", ""), ("r", "main.tf", ""), ("s", "a.txt", "")])
    rows = {r.repo: r for r in stack.stack(files, manifests.dependencies(files)).collect()}
    r = rows["r"]
    assert r.frameworks == ["next.js", "react", "django"] and r.package_manager == "yarn"
    assert r.build_tools == ["docker"] and r.runtimes == ["docker", "terraform"] and r.total_deps == 3
    s = rows["s"]
    assert (s.frameworks, s.package_manager, s.build_tools, s.total_deps) == ([], "unknown", [], 0)


def test_audit(spark, make_files):
    files = make_files([("r", "package.json", '{"dependencies": {"Moment": "1", "request": "1", "dayjs": "1", "boto3": "1", "d3": "1"}}'),
                        ("s", "a.txt", "")])
    deps = manifests.dependencies(files)
    merged = manifests.merged_dependencies(deps)
    found = dependencies.dependency_findings(merged)
    assert sorted((r.type, r.package or "", r.severity) for r in found.collect()) == [
        ("cost_risk", "boto3", "warning"), ("deprecated", "request", "warning"), ("duplicate_functionality", "", "info"),
        ("heavy_dependency", "Moment", "warning"), ("heavy_dependency", "boto3", "warning"), ("heavy_dependency", "request", "critical")]
    assert [r.packages for r in found.where("packages is not null").collect()] == [["moment", "dayjs"]]
    summary = {r.repo: r.asDict() for r in dependencies.dependency_summary(files, merged, found).collect()}
    assert summary["r"]["total_deps"] == 5 and summary["r"]["heavy_count"] == 3 and summary["s"]["total_deps"] == 0
    assert sorted((r.package, r.estimated_size_kb, r.severity) for r in dependencies.bundle_findings(deps).collect()) == [
        ("Moment", 300, "warning"), ("d3", 100, "warning")]


def test_typosquats(spark, make_files):
    files = make_files([("r", "package.json", '{"dependencies": {"crossenv": "1", "lodash": "1", "loadsh": "1", "zzz": "1"}}')])
    rows = knowledge.typosquats(manifests.dependencies(files)).collect()
    assert sorted((r.name, r.imitates, r.distance) for r in rows) == [("crossenv", "cross-env", 1), ("loadsh", "lodash", 2)]
