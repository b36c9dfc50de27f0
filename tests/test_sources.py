"""Readers on small files of each form, versions, and cases that must not fail."""

import functools
import json

import pytest
from pyspark.sql import functions as F

from revlens.functions import paths, text, versions
from revlens.operators import summary
from revlens.sources import diffs, files, packages, replies, tools

FILES = {
    "a/package.json": ('{"dependencies": {"x": "^1", "g": "github:o/g#main"}, "devDependencies": {"u": "https://h/u.tgz"}}', {"x": ("^1", "", True, ""), "g": ("github:o/g#main", "github:o/g#main", True, "main"), "u": ("https://h/u.tgz", "https://h/u.tgz", True, "")}),
    "package-lock.json": ('{"packages": {"": {"dependencies": {"x": "1"}}, "node_modules/x": {"version": "1.0", "resolved": "r"}, "node_modules/y/node_modules/x": {"version": "2.0"}}}', {"x": ("2.0", "", True, "")}),
    "b/package-lock.json": ('{"dependencies": {"x": {"version": "1", "dependencies": {"y": {"version": "2"}, "x": {"version": "9"}}}}}', {"x": ("1", "", True, ""), "y": ("2", "", False, "")}),
    "yarn.lock": ('# yarn\n\n"@s/p@^1.0.0", "@s/p@~1":\n  version "1.0.1"\n  resolved "https://h/p.tgz#abc"\n  integrity sha1\n\nq@git+ssh://g/q.git:\n  version "2"\n  resolved "git+ssh://g/q.git"\n', {"@s/p": ("1.0.1", "https://h/p.tgz#abc", False, ""), "q": ("2", "git+ssh://g/q.git", False, "HEAD")}),
    "requirements.txt": ("# c\n-r x\nFoo_Bar == 1.0 # c\nbaz\nq @ git+https://h/q?rev=abc\n", {"foo-bar": ("==", "", True, ""), "baz": ("", "", True, ""), "q": ("", "git+https://h/q?rev=abc", True, "abc")}),
    "pyproject.toml": ('[project]\ndependencies = ["A.b>=1"]\n[project.optional-dependencies]\nx = ["c"]\n[tool.poetry.dependencies]\npython = "^3"\nd = {git = "https://g/d", branch = "dev"}\n[tool.poetry.group.t.dependencies]\ne = "1"\n', {"a-b": (">=1", "", True, ""), "c": ("", "", True, ""), "d": ("", "https://g/d", True, "dev"), "e": ("1", "", True, "")}),
    "uv.lock": ('[[package]]\nname = "A"\nversion = "1"\nsource = {registry = "https://r"}\n[[package]]\nname = "b"\nversion = "2"\nsource = {git = "https://git/b?tag=v2#abc"}\n', {"a": ("1", "https://r", False, ""), "b": ("2", "https://git/b?tag=v2#abc", False, "v2#abc")}),
    "go.mod": ("module m\nreplace a/b => ../b\nrequire (\n\ta/b v1.0.0 // indirect\n\tc/d v2.0.0\n)\nrequire e/f v3.0.0\nreplace (\n\tc/d v2.0.0 => h/d v2.1.0\n)\n", {"a/b": ("v1.0.0", "../b", False, ""), "c/d": ("v2.0.0", "h/d", True, ""), "e/f": ("v3.0.0", "", True, "")}),
    "go.sum": ("a/b v1/go.mod h1:x\na/b v1 h1:y\nc/d v2/go.mod h1:z\n", {"a/b": ("v1", "", False, ""), "c/d": ("v2", "", False, "")}),
    "Cargo.toml": ('[dependencies]\na = "1"\n[workspace.dependencies]\nb = {git = "g", rev = "r"}\n', {"a": ("1", "", True, ""), "b": ("", "g", True, "r")}),
    "Cargo.lock": ('[[package]]\nname = "a"\nversion = "1"\nsource = "git+https://g#abc"\n', {"a": ("1", "git+https://g#abc", False, "abc")}),
    "composer.json": ('{"require": {"php": "8", "ext-x": "*", "v/p": "^1"}, "repositories": [{"url": "u"}]}', {"v/p": ("^1", "", True, ""), "(composer repositories)": ("", '[{"url": "u"}]', True, "")}),
    "composer.lock": ('{"packages": [{"name": "v/p", "version": "1", "source": {"type": "git", "url": "u", "reference": "abc"}, "dist": {"shasum": "s"}}]}', {"v/p": ("1", "u", False, "abc")}),
    "c/package.json": ("{broken", {}),
    "d/Cargo.lock": ("[1]", {}),
    "e/composer.json": ("[]", {}),
    "readme.md": ("hello", {}),
}


@pytest.mark.parametrize("path", sorted(FILES))
def test_package_files(path):
    body, want = FILES[path]
    got = {n: (str(f.get("version") or ""), str(f.get("source") or ""), bool(f.get("direct")), str(f.get("ref") or "")) for n, f in packages.read(path, body).items()}
    assert got == want


def test_yaml_locks():
    pytest.importorskip("yaml")
    pnpm = "lockfileVersion: 5\ndependencies:\n  x: 1\npackages:\n  /x/1.0.0:\n    resolution: {integrity: sha}\n  /@s/y@2.0.0(z@1):\n    resolution: {tarball: t}\n"
    assert {n: (f.get("version"), f.get("direct")) for n, f in packages.read("pnpm-lock.yaml", pnpm).items()} == {"x": ("1.0.0", True), "@s/y": ("2.0.0", False)}
    berry = '__metadata:\n  version: 6\n"p@npm:^1":\n  version: 1.2.3\n  resolution: "p@npm:1.2.3"\n  checksum: c\n'
    assert packages.read("yarn.lock", berry)["p"]["integrity"] == "c"


def test_snapshot_of_odd_files(spark):
    rows = [(i, p, t) for i, (p, (t, _)) in enumerate(FILES.items())] + [(99, None, "x"), (98, "go.sum", None)]
    df = spark.createDataFrame(rows, "id int, path string, text string")
    out = packages.snapshot(df, keep=["id"]).collect()
    assert len(out) == sum(len(w) for _, w in FILES.values()) and {r.dir for r in out} == {"", "a", "b"}
    assert packages.snapshot(df.limit(0)).count() == 0


@pytest.mark.parametrize(
    ("constraint", "version", "want"),
    [("^1.2.3", "1.9.0", True), ("^1.2.3", "2.0.0", False), ("^0.2.3", "0.3.0", False), ("^0.0.3", "0.0.3", True), ("^0.0.3", "0.0.4", False), ("^0", "0.9.9", True), ("^0.0", "0.0.9", True), ("^0.0", "0.1.0", False)]
    + [("~1.2", "1.2.9", True), ("~1.2", "1.3.0", False), ("~1", "1.9.0", True), ("1.x", "1.5.0", True), ("1.2.*", "1.3.0", False), ("*", "9.9.9", True), ("1", "1.0.0", True), ("=1.2", "1.2.7", True)]
    + [("1.0.0 - 2.1", "2.1.9", True), ("1.0.0 - 2.1.0", "2.1.1", False), (">=1 <2", "1.5.0", True), (">=1, <1.2", "1.5.0", False), ("<1 || >=3", "3.0.0", True), ("<1 || what", "3.0.0", None), ("<1 || what", "0.1.0", True)]
    + [(">1.x", "2.0.0", None), ("^1.0.0-rc1", "1.0.0", None), ("^1.0.0", "1.0.0-rc1", None), ("^1", "1.0", None), ("", "1.0.0", None), ("<1 ||", "0.1.0", None), ("1.x.3", "1.1.3", None), ("v1.2.3", "v1.2.3", True)],
)
def test_versions(spark, constraint, version, want):
    row = spark.createDataFrame([(constraint, version)], "c string, v string").select(versions.semver_satisfies(F.col("c"), F.col("v")).alias("x")).first()
    assert row.x is want


def test_dialects_and_moves(spark):
    df = spark.createDataFrame([("go", "v1", "v1"), ("cargo", "1.2", "1.9.0"), ("composer", "1.2.3", "1.2.4"), ("composer", "~1.2", "1.9.0"), ("python", "==1.0.0", "1.0.0"), ("npm", "", "1"), ("npm", "^1", None)], "e string, c string, v string")
    assert [r.x for r in df.select(versions.satisfies(F.col("e"), F.col("c"), F.col("v")).alias("x")).collect()] == [True, True, False, None, True, None, None]
    df = spark.createDataFrame([("1.2", "1.10"), ("v2.0", "1.9"), ("1.2.3", "1.2"), ("abc", "1"), ("1.20.3-rc1", "1.20.2")], "a string, b string")
    assert [r.x for r in df.select(versions.version_move(F.col("a"), F.col("b")).alias("x")).collect()] == ["upgraded", "downgraded", "upgraded", "upgraded", "downgraded"]


def test_diffs_of_odd_forms(spark):
    texts = {
        1: "noise\n--- a/x\n+++ b/x\n@@ -1,0 +1 @@\n+--- looks like a head\n\\ No newline at end of file\n@@ -9 +9,2 @@ tail\n-a\n+b\n",
        2: "diff --git a/a b/c.txt b/a b/c.txt\nBinary files differ\n",
        3: "diff --git a/p q b/p q\nnew file mode 1\ndeleted file mode 2\n",
        4: "",
        5: None,
        6: "diff --git a/d b/d\n--- a/d\tstamp\n+++ /dev/null\n@@ -1 +0,0 @@\r\n-x\r\n",
    }
    df = spark.createDataFrame([*texts.items()], "id int, diff string")
    lines = diffs.diff_lines(df, "id", "diff").cache()
    by = {(r.id, r.block): r for r in diffs.diff_files(lines, "id").collect()}
    assert {k: (r.path, r.change_type, r.is_binary, r.hunks, r.added) for k, r in by.items()} == {
        (1, 1): ("x", "modified", False, 2, 2), (2, 1): ("c.txt b/a b/c.txt", "modified", True, 0, 0), (3, 1): ("p q", "deleted", False, 0, 0), (6, 1): ("d", "modified", False, 1, 0),
    }
    assert [(r.hunk, r.old_lines, r.new_lines, r.header) for r in diffs.diff_hunks(lines.where("id = 1"), "id").orderBy("hunk").collect()] == [(1, 0, 1, ""), (2, 1, 2, "tail")]
    assert [(r.mark, r.position, r.new_line) for r in lines.where("id = 1 AND hunk > 0").orderBy("pos").collect()] == [("@", 1, None), ("+", 2, 1), ("\\", None, None), ("@", 3, None), ("-", 4, None), ("+", 5, 9)]
    pairs = spark.createDataFrame([("f", "a\nb\n", "a\nc\n"), ("g", "", ""), ("h", "x\0", "y"), ("i", None, "n")], "p string, o string, n string")
    out = {r.p: r["diff"] for r in diffs.recovered(pairs, "p", "o", "n").collect()}
    assert "-b\n+c" in out["f"] and out["g"] is None and out["h"] is None and "+n" in out["i"]


def test_directories_and_rules(spark, tmp_path):
    (tmp_path / "node_modules").mkdir()
    for name, data in {"a.py": b"x\r\ny", "node_modules/b.js": b"x", "c.bin": b"a\0b", "d.txt": b"\xff\xfe", "e.log": b"l", "big.txt": b"z" * (files.MOST_BYTES + 1), "keep.log": b"k"}.items():
        (tmp_path / name).write_bytes(data)
    found = files.eligible(files.directory(spark, str(tmp_path)), ["*.log"], ["keep.*"], 3)
    assert {r.path: r.omitted for r in found.collect()} == {"a.py": False, "big.txt": False, "c.bin": False, "d.txt": True, "keep.log": False}
    assert {r.path: (r.text, r.is_binary, r.omission) for r in files.decoded(found).collect()} == {"a.py": ("x\ny", False, None), "big.txt": (None, False, "too_large"), "c.bin": (None, True, None), "d.txt": (None, True, None), "keep.log": ("k", False, None)}
    rules = spark.createDataFrame([("r/one.md", "---\nid: on\nseverity: Major\nenabled: false\n---\nDo it.\n"), ("r/two.md", "Plain."), ("r/three.md", "---\nid: x\n---\n"), ("r/four.md", "---\nid: 'four x'\n---\nBody")], "path string, text string")
    assert {r.id: (r.severity, r.enabled, r.body) for r in files.rules(rules).collect()} == {"one": ("major", False, "Do it."), "two": ("minor", True, "Plain."), "four x": ("minor", True, "Body")}
    some = spark.createDataFrame([("tree", "A.md", "a"), ("base", "B.md", "b"), ("base", "A.md", " ")], "revision string, path string, text string")
    assert files.context_file(some, ["A.md", "B.md"]).collect()[0].text == "a"
    changed = spark.createDataFrame([("a", True, False, False), ("b", False, True, True), ("c.log", False, False, False), ("d", False, False, False)], "path string, zero_byte boolean, patch_unavailable boolean, is_binary boolean")
    assert {r.path: r.reason for r in files.drops(changed, changed.where("path = 'd'"), ["*.log"]).collect()} == {"a": "zero_byte", "b": "patch_unavailable", "c.log": "ignored"}


def test_tools_on_odd_output(spark):
    out = {
        "semgrep": json.dumps({"results": [{"check_id": "a.sql-injection", "path": "f", "start": {"line": 3}, "extra": {"severity": "INFO", "message": " m "}}, {"path": "g"}]}),
        "phpstan": 'Note: x\n{"files": {"p.php": {"messages": [{"message": "m", "line": 4, "ignorable": false, "identifier": "i"}, {"message": "n", "line": null}]}}}',
        "hadolint": json.dumps([{"code": "DL3002", "file": "Dockerfile", "level": "info", "line": 0, "message": "m"}, {"level": "style", "line": 2}]),
        "actionlint": json.dumps([{"kind": "shellcheck", "filepath": "w.yml", "line": 5, "message": "m"}]),
        "checkov": "[" + json.dumps({"results": {"failed_checks": [{"check_id": "C1", "check_name": "n", "severity": "HIGH", "file_path": "/t.tf", "file_line_range": [0, 4]}, {"check_id": "C2"}]}}) + "]",
        "osv-scanner": json.dumps({"results": [{"source": {"path": "l"}, "packages": [{"package": {"name": "p", "version": "1"}, "vulnerabilities": [{"id": "V1"}, {"id": "V2", "summary": "s"}]}]}]}),
        "ruff": "{broken", "mypy": "nothing", "eslint": "", "other": "[]",
    }
    rows = tools.findings(spark.createDataFrame([*out.items(), ("ruff", None)], "tool string, stdout string")).collect()
    got = [(r.tool, r.file, r.start_line, r.end_line, r.severity, r.category, r.kind, r.title, r.body, r.rule_id) for r in rows]
    order = lambda r: tuple(str(x) for x in r)
    assert sorted(got, key=order) == sorted([
        ("semgrep", "f", 3, 3, "major", "security", "potential_issue", "sql injection", "m", "semgrep/a.sql-injection"),
        ("phpstan", "p.php", 4, 4, "major", "bug", "potential_issue", "PHPStan: i", "m", "phpstan/i"),
        ("hadolint", "Dockerfile", 1, 1, "major", "security", "potential_issue", "DL3002", "m", "hadolint/DL3002"),
        ("hadolint", "", 2, 2, "info", "maintainability", "nitpick", "Dockerfile issue", "", None),
        ("actionlint", "w.yml", 5, 5, "major", "security", "potential_issue", "shellcheck", "m", "actionlint/shellcheck"),
        ("checkov", "t.tf", 1, 4, "major", "security", "potential_issue", "n", "n", "checkov/C1"),
        ("osv-scanner", "l", 1, 1, "major", "security", "potential_issue", "V1 in p", "p 1: V1", "osv/V1"),
        ("osv-scanner", "l", 1, 1, "major", "security", "potential_issue", "V2 in p", "p 1: s", "osv/V2"),
    ], key=order)


def test_replies(spark):
    texts = {
        1: json.dumps({"decisions": [{"candidate": "a", "disposition": "Drop", "rationale": "r"}, {"candidate": "a", "disposition": "confirm"}, {"candidate": "z", "disposition": "drop"}, {"candidate": "b", "disposition": "nonsense"}]}),
        2: json.dumps({"verdicts": [{"thread": "t", "state": "FIXED", "commits": ["abcdef1", "zz", "1234567"], "summary": "s"}]}),
        3: "not json: [", 4: "[]", 5: None,
        6: json.dumps({"requirement_evidence": [{"requirement": "r", "evidence": "x" * 400}, {"requirement": "", "evidence": "e"}] * 15}),
    }
    df = spark.createDataFrame([*texts.items()], "id int, reply string")
    known = spark.createDataFrame([(1, "a"), (1, "b")], "id int, candidate string")
    assert [(r.candidate, r.disposition) for r in replies.decisions(df, "id", "reply", known).collect()] == [("a", "drop")]
    threads = spark.createDataFrame([(2, "t", ["abcdef1" + "0" * 33, "1234567" + "a" * 33, "1234567" + "b" * 33])], "id int, thread string, shas array<string>")
    assert [(r.state, r.commits) for r in replies.verdicts(df, "id", "reply", threads).collect()] == [("fixed", ["abcdef1" + "0" * 33])]
    found = replies.evidence(df, "id", "reply", "requirement_evidence", ["requirement", "evidence"], ["requirement", "evidence"]).collect()
    assert len(found) == 15 and len(found[0].evidence) == 300


def test_truncated_yaml_reply(spark):
    pytest.importorskip("yaml")
    reply = "```yaml\nfindings:\n- file: a.py\n  start_line: 3\n  body: b\n- file: b.py\n  body: \"cut"
    assert [(r.file, r.start_line) for r in replies.findings(spark.createDataFrame([(1, reply)], "id int, reply string"), "id", "reply").collect()] == [("a.py", 3)]


def test_text_functions(spark):
    row = spark.createDataFrame([("```python\n+a\n b\n\n```", " x  y\n", "a.b|c\nd", "x```y````")], "s string, w string, c string, f string").select(
        text.clean_suggestion(F.col("s")).alias("suggestion"), text.flatten(F.col("w")).alias("flat"), text.escape_cell(F.col("c")).alias("cell"), text.fence_for(F.col("f")).alias("fence"),
        text.listed(F.array(*[F.lit(str(i)) for i in range(7)])).alias("listed"), text.cut_inside(F.lit("abcdef"), 3).alias("cut"), text.mutable_ref(F.lit("main")).alias("moving"), text.mutable_ref(F.lit("a" * 40)).alias("fixed"),
        text.grep_hit(F.lit("a/b.py:12:x:y")).alias("hit"), text.verdict_in(F.lit("hm\n  False positive: no\nwontfix"), {"wontfix": "w", "false positive": "f"}).alias("verdict"), text.verdict_in(F.lit("wontfixes"), {"wontfix": "w"}).alias("none"),
        text.mentions(F.lit("call $foo and foo.bar"), F.lit("foo")).alias("said"), text.mentions(F.lit("$foo foobar"), F.lit("foo")).alias("unsaid"), text.git_ref(F.lit("https://git/x?a=1&tag=v1#f")).alias("ref"),
        text.strip_fences(F.lit("```\nopen\n")).alias("open"), text.written_at(F.lit("nonsense")).cast("string").alias("never"), paths.language(F.lit("a/Dockerfile")).alias("lang"), text.common_directory(F.array(F.lit("a/b/c"), F.lit("a/bc/d"))).alias("dir"),
    ).first()
    assert row.suggestion == "a\nb" and row.flat == "x y" and row.cell == "a.b\\|c d" and row.fence == "`````" and row.listed == "0, 1, 2, 3, 4 and 2 more" and row.cut == "abc"
    assert row.moving and not row.fixed and (row.hit.path, row.hit.line, row.hit.text) == ("a/b.py", 12, "x:y") and row.verdict == "f" and row.none is None
    assert row.said and not row.unsaid and row.ref == "v1#f" and row.open == "open" and row.never.startswith("0001") and row.lang == "dockerfile" and row.dir == "a"


@pytest.mark.parametrize(("glob", "path", "want"), [("*.py", "a/b.py", True), ("**/x", "x", True), ("**/x", "a/x", True), ("a/**/x", "a/x", False), ("[!a]b", "ab", False), ("[a-c]?", "bz", True), ("a.b", "axb", False), ("x(", "x(", True)])
def test_globs(spark, glob, path, want):
    assert spark.range(1).select(paths.matches_any(F.lit(path), [glob]).alias("x")).first().x is want


def test_globs_together_are_as_each_alone(spark):
    globs = [g for kind in paths.ASSETS.values() for g in kind] + ["**/*", "docs/*", "a/**/x?.py", "**/[ab]c", "exact/name", "**/*b/c.d"]
    parts = [g.replace("**/", "").replace("*", "q").replace("?", "z").replace("[ab]", "b") for g in globs]
    names = sorted({q for p in parts for q in (p, "w/" + p, "w" + p, p + "w", p + "/w", p + "\n", p.upper())} | {"", "/", "é/Dockerfile.x/y.lock"})
    frame = spark.createDataFrame([(n,) for n in [*names, None]], "path string")
    for some in (globs[:11], globs[11:19], globs[19:34], globs[34:44], globs[45:], globs[44:45]):
        alone = functools.reduce(lambda a, b: a | b, [F.col("path").rlike(paths.glob_regex(g)) for g in some])
        assert frame.where(~paths.matches_any(F.col("path"), some).eqNullSafe(alone)).collect() == []
    assert frame.where(paths.matches_any(F.col("path"), [])).count() == 0


def test_the_kind_of_an_asset_is_told_once_a_row(spark):
    """A condition on the kind that Spark moves below it tells it again, and computes the path anew for every glob; a change without a key keeps its rows."""
    files = spark.createDataFrame([(1, 0, "Dockerfile", False), (1, 1, "x.tf", False), (1, 2, "a/.npmrc", None), (1, 3, "src/a.py", False), (None, 0, "uv.lock", False), (2, 0, "b/Gemfile.lock", False), (2, 1, "Gemfile.lock", False), (2, 2, "main.tf", True)], "id long, pos long, path string, is_binary boolean")
    first, unread = summary.listed_assets(files.withColumn("path", F.concat("path", F.lit(""))), "id", 2)
    assert sorted(map(tuple, first.select("id", "pos", "kind", "truncated").collect()), key=str) == [(1, 0, "container", True), (1, 1, "iac", True), (None, 0, "dependency_lock", False)]
    assert [tuple(r) for r in unread.collect()] == [(2, "Gemfile.lock", "b/Gemfile.lock", 0)]
    for frame in (first, unread):
        assert frame._jdf.queryExecution().executedPlan().toString().count("azure-pipelines.yml") == 1


def test_state(spark, tmp_path):
    from revlens.streaming.state import VersionedTable, publish_unseen

    seen = VersionedTable(spark, str(tmp_path / "seen"), "key string, fingerprint string")
    one = spark.createDataFrame([("k", "a", "a2"), ("k", "a", "a2"), ("k", "b", "b2")], "key string, fingerprint string, fingerprint_v2 string")
    two = spark.createDataFrame([("k", "x", "a2"), ("k", "b", "y"), ("k", "c", "c2"), ("j", "a", "a2")], "key string, fingerprint string, fingerprint_v2 string")
    publish_unseen(one, seen, str(tmp_path / "out"))
    publish_unseen(two, seen, str(tmp_path / "out"))
    publish_unseen(two, seen, str(tmp_path / "out"))
    assert sorted((r.key, r.fingerprint) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [("j", "a"), ("k", "a"), ("k", "b"), ("k", "c")]
    assert seen.versions() == [0, 1, 2] and (tmp_path / "seen" / "rows" / "unfinished").mkdir() is None and seen.versions() == [0, 1, 2]


def test_operators_keep_columns_of_any_name(spark):
    from revlens import operators as op

    df = spark.createDataFrame([(1, 5, 6, 7, 8), (1, 4, 1, 1, 1), (2, 3, 2, 2, 2)], "k int, nth int, before int, after int, newest int")
    assert sorted(op.keep_best(df, ["k"], F.col("nth")).columns) == sorted(df.columns)
    assert [tuple(r) for r in op.newest_wins(df, ["k"], F.col("nth")).orderBy("k").collect()] == [(1, 5, 6, 7, 8), (2, 3, 2, 2, 2)]
    assert set(op.nearest_within(df, "k", "nth", F.col("nth") == 5, 1).columns) == {*df.columns, "anchor"}
    assert op.smallest_containing(df, df, "k", "nth", "newest", 10).count() == 2
