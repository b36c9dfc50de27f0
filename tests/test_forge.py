"""Recorded answers, replacements, packing of joined texts and cut hunks, comments and checks: odd rows and plain loops."""

import random

from pyspark.sql import functions as F

from revlens import sinks
from revlens.functions import text as X
from revlens.operators import checks, comments, edits, packing, selection
from revlens.plans import catalog
from revlens.sources import forge
from revlens.streaming import state


def test_odd_entries(spark):
    items = [(1, 0, None), (1, 1, "[]"), (1, 2, "{}"), (1, 3, '{"filename": "a.png"}'), (1, 4, '{"filename": "b.py", "patch": "", "status": 7}'), (1, 5, '{"filename": "c.py", "patch": "@@ -1 +1 @@\\n-a\\n+b", "previous_filename": "", "status": "removed"}')]
    frame = spark.createDataFrame(items, "change long, pos long, item string")
    got = {r.pos: (r.path, r.previous_path, r.change_type, r.is_binary, r.needs_text, r.diff is not None) for r in forge.pull_files(frame).collect()}
    assert got == {2: ("", None, "modified", False, True, False), 3: ("a.png", None, "modified", True, False, False), 4: ("b.py", None, "modified", False, True, False), 5: ("c.py", None, "deleted", False, False, True)}
    merge = [(1, 0, '{"old_path": "x", "deleted_file": true}'), (1, 1, "{}"), (1, 2, '{"new_path": "n", "old_path": "o", "renamed_file": true, "new_file": "yes"}')]
    got = {r.pos: (r.path, r.previous_path, r.change_type) for r in forge.merge_files(spark.createDataFrame(merge, "change long, pos long, item string")).collect()}
    assert got == {0: ("x", None, "deleted"), 2: ("n", "o", "added")} or got == {0: ("x", None, "deleted"), 2: ("n", "o", "renamed")}
    assert forge.pull_files(frame.limit(0)).count() == 0


def _replaced(text, wanted):
    """Replacements from the last to the first, on lines that keep their ends."""
    plain = text.replace("\r\n", "\n")
    if "\r" in plain or ("\r\n" in text and "\n" in text.replace("\r\n", "")):
        return text
    lines = plain.split("\n")
    last = lines.pop() if lines[-1] == "" else None
    for start, end, new in sorted(wanted, reverse=True):
        if end <= len(lines):
            new = new.replace("\r\n", "\n")
            lines[start - 1 : end] = (new[:-1] if new.endswith("\n") else new).split("\n")
    out = "\n".join(lines) + ("\n" if last is not None else "")
    return out.replace("\n", "\r\n") if "\r\n" in text else out


def test_edits_equal_a_loop(spark):
    rng = random.Random(6)
    files, wanted, want = [], [], {}
    for file in range(40):
        n = rng.randint(1, 12)
        end = rng.choice(["\n", "\r\n"])
        text = end.join(rng.choice(["a", "b", "", "é x"]) for _ in range(n)) + rng.choice(["", end]) + rng.choice(["", "", "", "\rq"])
        own, at = [], 1
        while at <= n:
            stop = at + rng.choice([0, 0, 1, 4])
            if rng.random() < 0.4:
                own.append((at, stop, rng.choice(["a", "new", "two\nlines\n", "x\r\ny", "b\n"])))
            at = stop + 1
        files.append((file, text))
        wanted += [(file * 100 + k, file, *e) for k, e in enumerate(own)]
        if _replaced(text, own) != text:
            want[file] = _replaced(text, own)
    out, idle = edits.apply_edits(spark.createDataFrame(files, "file long, text string"), spark.createDataFrame(wanted, "pos long, file long, start_line long, end_line long, suggestion string"))
    assert {r.file: r.text for r in out.collect()} == want
    assert {r.reason for r in idle.collect()} == {"line_ends", "outside", "no_change"}


def test_bins_of_joined_text(spark):
    """Bins by the length of the joined text, against a loop that joins it."""
    rng = random.Random(7)
    items, want = [], {}
    for key in range(30):
        group, texts = 0, []
        for turn in range(rng.randint(1, 15)):
            group += rng.random() < 0.5
            texts.append((turn, group, "x" * rng.choice([0, 1, 5, 17, 39, 41, 90])))
        items += [(key, t, g, len(x)) for t, g, x in texts]
        tokens = lambda parts: len("--".join(parts)) // 4
        bins, current = [], []
        for g in dict.fromkeys(g for _, g, _ in texts):
            own = [(t, x) for t, h, x in texts if h == g]
            if current and tokens([x for _, x in current + own]) > 10:
                bins.append(current)
                current = []
            for one in own:
                if current and tokens([x for _, x in [*current, one]]) > 10:
                    bins.append(current)
                    current = []
                current.append(one)
        bins.append(current)
        want |= {(key, t): k + 1 for k, b in enumerate(bins) for t, _ in b}
    out = packing.pack(spark.createDataFrame(items, "k long, t long, g long, n long"), "k", "t", "g", "n", packing.budget_of(10), F.col("t"), joint=2)
    assert {(r.k, r.t): r.bin for r in out.collect()} == want


def _fragments(lines, budget, head):
    """Pieces of a hunk by trying windows, as long as they fit."""
    size = lambda a, b: head + sum(n for _, n in lines[a:b])
    changed = [i for i, (m, _) in enumerate(lines) if m != " "]
    if size(0, len(lines)) <= budget or not changed:
        return [(0, len(lines) - 1, changed[0] if changed else None, changed[-1] if changed else None, size(0, len(lines)), False)]
    out, k = [], 0
    while k < len(changed):
        best = k + 1
        while best < len(changed) and size(changed[k], changed[best] + 1) <= budget:
            best += 1
        a, b = changed[k], changed[best - 1] + 1
        first, last = a, b
        fits = size(a, b) <= budget
        for _ in range(3):
            if not fits or first == 0 or lines[first - 1][0] != " " or size(first - 1, last) > budget:
                break
            first -= 1
        for _ in range(3):
            if not fits or last == len(lines) or lines[last][0] != " " or size(first, last + 1) > budget:
                break
            last += 1
        out.append((first, last - 1, a, b - 1, size(first, last), not fits))
        k = best
    return out


def test_pieces_of_hunks(spark):
    rng = random.Random(8)
    rows, want = [], {}
    for key in range(60):
        lines = [(rng.choice(["+", "-", " ", " "]), rng.randint(1, 40)) for _ in range(rng.randint(1, 25))]
        rows += [(key, i, m, n) for i, (m, n) in enumerate(lines)]
        want |= {(key, k + 1): p for k, p in enumerate(_fragments(lines, 70, 6))}
    out = packing.fragments(spark.createDataFrame(rows, "k long, pos long, mark string, size long"), ["k"], "size", 70, head=6).collect()
    assert {(r.k, r.fragment): (r["first"], r["last"], r.from_, r.to, r.cost, r.too_large) for r in out} == want


COMMENT = "change long, surface string, thread string, nth long, ordinal long, id long, author string, is_bot boolean, body string, path string, line long, created_at string, head_sha string, positioned boolean, system boolean, state string, resolvable boolean, resolved boolean, thread_resolved boolean"


def _comment(**own):
    base = {"change": 1, "surface": "note", "thread": "t", "nth": 0, "ordinal": 0, "id": 1, "author": "ann", "is_bot": False, "body": "text", "path": "a.py", "line": 1, "created_at": "2024-01-01T00:00:00Z", "head_sha": None, "positioned": False, "system": False, "state": None, "resolvable": None, "resolved": None, "thread_resolved": None}
    return tuple((base | own).values())


def test_each_rule_of_the_discussion(spark):
    """One comment for each rule that leaves it out, and those that stay."""
    rows = [
        _comment(id=1), _comment(id=2, thread="r", thread_resolved=True), _comment(id=3, thread="q", resolvable=True, resolved=True), _comment(id=4, thread="q", nth=1), _comment(id=5, system=True), _comment(id=6, is_bot=True),
        _comment(id=7, body="x <!-- lens:v1:0123456789abcdef -->"), _comment(id=8, surface="line", positioned=False), _comment(id=9, surface="line", positioned=True, head_sha="old"), _comment(id=10, surface="line", positioned=True, head_sha="new"),
        _comment(id=11, state="pending"), _comment(id=12, body=" \n "), _comment(id=13, body=None), _comment(id=14, thread=None, body="  kept \n"), _comment(id=15, change=2, surface="line", positioned=True, head_sha="any"), _comment(id=16, resolvable=False, resolved=True),
    ]
    frame = spark.createDataFrame(rows, COMMENT)
    heads = spark.createDataFrame([(1, "new"), (2, "")], "change long, head string")
    assert {r.id: r.body for r in comments.discussion(frame, heads, "lens").collect()} == {1: "text", 10: "text", 14: "kept", 15: "text", 16: "text"}
    assert comments.discussion(frame.limit(0), heads, "lens").count() == 0


def test_whose_comment_it_is(spark):
    mark = "<!-- lens:summary -->"
    rows = [
        _comment(id=1, author="Lens", body=mark + "<!-- lens:flow:aa -->", created_at="2024-01-02T00:00:00"), _comment(id=2, author="lens", body=mark + "<!-- lens:flow:bb --><!-- lens:overview:QQ== -->", created_at="2024-01-02T00:00:00+00:00", ordinal=1),
        _comment(id=3, author="mallory", body=mark, created_at="2025-01-01T00:00:00Z"), _comment(id=4, author="lens", surface="line", body=mark, created_at="2026-01-01T00:00:00Z"), _comment(change=2, id=5, is_bot=True, body=mark, created_at="bad"), _comment(change=2, id=6, body=mark),
    ]
    viewers = spark.createDataFrame([(1, "LENS"), (2, "")], "change long, viewer string")
    got = {r.change: (r.id, r.flow, r.carried) for r in comments.newest_summary(spark.createDataFrame(rows, COMMENT), viewers, "lens").collect()}
    assert got == {1: (2, "bb", "QQ=="), 2: (5, None, None)}


def test_verdicts_without_proof_retire_nothing(spark):
    threads = spark.createDataFrame([(1, c, k) for k, c in enumerate("abcdef")], "change long, thread string, ordinal long")
    sha = "0123456789abcdef"
    history = spark.createDataFrame([(1, "a", [sha]), (1, "b", []), (1, "c", None), (1, "d", [sha, sha[:8] + "ff"]), (1, "e", [sha]), (1, "f", [sha])], "change long, thread string, shas array<string>")
    said = [(1, "a", 0, "maybe", [sha], "s"), (1, "a", 1, " Fixed", [sha[:7]], "s"), (1, "b", 0, "fixed", [sha], "s"), (1, "d", 0, "fixed", [sha[:8]], "s"), (1, "e", 0, "not_fixed", [], ""), (1, "f", 0, "fixed", [sha], "s")]
    verdicts = spark.createDataFrame(said, "change long, thread string, pos long, state string, commits array<string>, summary string")
    heads = spark.createDataFrame([(1, "h", True)], "change long, head string, readable boolean")
    got = {r.thread: (r.state, r.commits, r.attributable) for r in comments.retired(threads, history, verdicts, heads, 3).collect()}
    assert got == {"a": ("fixed", [sha], True), "b": ("inconclusive", [], False), "c": ("inconclusive", [], False), "d": ("fixed", [], False), "e": ("not_fixed", [], False), "f": ("inconclusive", [], False)}
    assert {r.state for r in comments.retired(threads, history, verdicts, heads.withColumn("readable", F.lit(False))).collect()} == {"inconclusive"}


def test_checks_that_fail_to_run_leave_the_others(spark):
    one = spark.createDataFrame([(1,)], "a int")
    out, notes = checks.run_checks({"good": ("error", lambda: one), "off": ("off", lambda: 1 / 0), "bad": ("warning", lambda: 1 / 0)})
    assert out.count() == 1 and notes == ["The bad check could not run: division by zero"]
    assert checks.run_checks({}) == (None, [])


def test_texts_of_authors(spark):
    rows = ["a <!-- b --> c <!-- d", "<!-- a <!-- b --> c", "x ```code #1 fixes #2``` y", "````", "# Head\ntext\n#nohead\n####### seven", "- [ ] todo\n* [X] done\n- item\n+[x] also", "> quote\n  > more\na > b", "<!-->", None]
    frame = spark.createDataFrame(list(enumerate(rows)), "k int, t string")
    assert [r.p for r in frame.select("k", X.prose(F.col("t")).alias("p")).orderBy("k").collect()] == ["a c <!-- d", "c", "x y", "````", "text #nohead ####### seven", "- item", "a > b", "<!-->", ""]
    links = ["Fixes #1, closes: #2 and prefix #3; refs\n#4", "see https://h/o/r/issues/5) and http://h/g/-/issues/6#note", "```fixes #7``` resolve #8 fix_ #9 #10", None, "implements#11"]
    frame = spark.createDataFrame(list(enumerate(links)), "k int, t string")
    assert [r.p for r in frame.select("k", X.issue_references(F.col("t")).alias("p")).orderBy("k").collect()] == [["1", "2", "4"], ["5", "6"], ["8"], [], ["11"]]
    titles = ["feat(a:b)!: teach it to read", "fix: two words", "chore(x):", "short", "wip update-fix", "a (b): c d e f", None]
    frame = spark.createDataFrame(list(enumerate(titles)), "k int, t string")
    assert [r.p for r in frame.select("k", X.title_problem(F.col("t")).alias("p")).orderBy("k").collect()] == [None, "few_words", "short", "short", "placeholder", None, "none"]
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        times = ["2024-01-01T05:00:00", "2024-01-01T00:00:00-05:00", "2024-01-01 05:00:00Z", "2024-01-01", "never", None]
        frame = spark.createDataFrame(list(enumerate(times)), "k int, t string")
        got = [r.p for r in frame.select("k", F.unix_seconds(X.written_at(F.col("t"))).alias("p")).orderBy("k").collect()]
        assert got == [1704085200, 1704085200, 1704085200, 1704067200, -62135596800, -62135596800]
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_reports_hold_every_finding(spark):
    rows = [(1, 1, "a.py", 3, 4, "minor", "bug", "nitpick", "T | x", "body ``` here", "```\ny = 1\n```", "outside_diff"), (1, 2, "a.py", 1, 1, "critical", "bug", "potential_issue", "U", None, None, "actionable")]
    frame = spark.createDataFrame(rows, "review long, pos long, file string, start_line long, end_line long, severity string, category string, kind string, title string, body string, suggestion string, bucket string")
    reviews = spark.createDataFrame([(1, "complete"), (2, 'par"tial')], "review long, status string")
    for full in (True, False):
        got = {r.review: r.text for r in sinks.markdown_documents(frame, reviews, full).collect()}
        assert got[1].index("`a.py:1`") < got[1].index("`a.py:3-4`") and "1 critical, 0 major, 1 minor, 0 info" in got[1] and "No findings." in got[2]
    assert "\n````\n```\ny = 1\n```\n````" in {r.review: r.text for r in sinks.markdown_documents(frame, reviews).collect()}[1]
    import json

    docs = {r.review: json.loads(r.json) for r in sinks.documents(frame, reviews).collect()}
    assert docs[2] == {"schema_version": 7, "status": 'par"tial', "summary": {"total": 0, "by_severity": {}}, "findings": []}
    assert [f["title"] for f in docs[1]["findings"]] == ["U", "T | x"] and docs[1]["summary"] == {"total": 2, "by_severity": {"critical": 1, "minor": 1}}


def test_state_files(spark):
    texts = ['{"version": 1, "reviews": {"k": {"fingerprints": ["b", "a", "b", null], "digest": 7}}}', '{"version": 2, "reviews": {"x": {}}}', "{", None, '{"version": 1}', '{"version": 1, "reviews": []}']
    out = state.stored_reviews(spark.createDataFrame([(t,) for t in texts], "text string")).collect()
    assert [(r.key, r.fingerprints, r.head_sha, r.digest, r.overview) for r in out] == [("k", ["a", "b"], "", "7", None)]


def test_gates(spark):
    changes = spark.createDataFrame([(1, "local", None), (2, "forge", "h"), (3, "forge", "h"), (4, "forge", None)], "change long, origin string, head string")
    trees = spark.createDataFrame([(2, "h\n", ""), (3, "h", " M a")], "change long, commit string, status string")
    runs = spark.createDataFrame([(c,) for c in (1, 2, 3, 4, 5)], "change long")
    got = {r.change: (r.state, r.note) for r in selection.gated(runs, selection.availability(changes, trees.withColumn("commit", F.regexp_replace("commit", "\n", "")))).collect()}
    assert got == {1: ("due", None), 2: ("due", None), 3: ("refused", "uncommitted changes"), 4: ("refused", "no head"), 5: ("refused", "unknown change")}


def test_verdicts_meet_their_threads_by_key(spark):
    """A join on either of two equalities compares all pairs, which a larger table doesn't bear."""
    plan = catalog.QUERIES["threads_retired"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
