"""What surrounds a change, against plain loops: settings, surfaces, groups, consumers, contracts, commands, budgets, pages, state."""

import json
import random
import zlib

import pytest
from pyspark.sql import functions as F

from revlens.functions import codec, paths
from revlens.operators import consumers, contracts, grouping, packing, search, selection, settings, surfaces
from revlens.sources import pages
from revlens.streaming import state


def _over(base, top):
    out = dict(base)
    for k, v in top.items():
        out[k] = _over(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out


def _random_map(rng, depth):
    value = lambda: _random_map(rng, depth - 1) if depth and rng.random() < 0.5 else rng.choice([None, True, 3, "x\n\"é", [1, {"a": {}}], [], {}])
    return {rng.choice(['a', 'b"', "c.d", "é"]): value() for _ in range(rng.randint(0, 3))}


def test_settings_are_merged_as_maps(spark):
    """Random documents over each other, as a recursive merge puts them together; what is no JSON counts for nothing."""
    rng = random.Random(1)
    rows, want = [], {}
    for key in range(60):
        layers = [_random_map(rng, 3) for _ in range(rng.randint(1, 4))]
        rows += [(key, k, json.dumps(x)) for k, x in enumerate(layers)] + [(key, 99, "{broken"), (key, 98, None)]
        merged = {}
        for x in layers:
            merged = _over(merged, x)
        want[key] = merged
    rows.append((1000, 0, None))
    out = settings.overlay_documents(spark.createDataFrame(rows, "key long, rank int, document string")).collect()
    assert {r.key: json.loads(r.document) for r in out} == want


def test_a_profile_lies_under_explicit_fields(spark):
    layers = [(1, 0, '{"profile": "strict", "n": {"a": 7}}'), (1, 1, '{"profile": "security", "n": {"list": ["bug"]}}'), (2, 0, '{"n": 1}'), (3, 0, '{"profile": "typo", "n": 1}')]
    profiles = [("strict", '{"n": {"a": 1, "z": 9}}'), ("security", '{"n": {"a": 2, "b": 3, "list": [1, 2]}}'), ("plain", '{"n": {"a": 0}, "m": 5}')]
    out = settings.with_profiles(spark.createDataFrame(layers, "key long, rank int, document string"), spark.createDataFrame(profiles, "profile string, document string"), "plain").collect()
    got = {(r.key, ".".join(r.path) if r.path is not None else None): (r.value, r.problem) for r in out}
    assert got == {(1, "profile"): ('"security"', None), (1, "n.a"): ("7", None), (1, "n.b"): ("3", None), (1, "n.list"): ('["bug"]', None), (2, "n"): ("1", None), (2, "m"): ("5", None), (3, None): (None, "typo")}


TOLD = {
    "db/migrations/1.py": ["migration"], "x/add_schema.sql": ["migration"], "x/schema.sqlx": ["public_contract"], "x/query.sql": [], "K8S/a.yml": ["deployment"], ".github/workflows/ci.yml": ["deployment"], "workflows/ci.yml": [],
    "Dockerfile.dev": ["deployment"], "a/compose.prod.yml": ["deployment"], "a/compose.a.b.yml": [], "values.yaml": ["deployment"], "m.tfvars": ["deployment"], "src/api/x.py": ["public_contract"], "src/schema.py": ["public_contract"],
    "src/schematic.py": [], "docs/openapi-2.json": ["public_contract"], "docs/openapi.txt": [], "a.proto": ["public_contract"], "src/workers/x.py": ["background_job"], "src/worker.py": [], "lib/flags.py": ["feature_flag"],
    "lib/flags": [], "lib/toggles/x.py": ["feature_flag"], "core/cache.py": ["cache"], "core/cached.py": [], "core/caches/x.py": ["cache"], "readme": [],
}


def test_surfaces_of_paths(spark):
    frame = spark.createDataFrame(list(TOLD.items()), "path string, want array<string>")
    assert {r.path: r.got for r in frame.select("path", surfaces.path_surfaces(F.col("path")).alias("got")).collect()} == TOLD


def test_surfaces_of_lines(spark):
    """Each surface from an added or a removed line, none from context; what is only removed needs an added line in its own hunk."""
    lines = [(1, 1, "+", "+retry(3)"), (2, 1, "-", "-KAFKA"), (3, 1, " ", " timeout"), (4, 1, "-", "-logger.info()"), (4, 2, "+", "+pass"), (5, 1, "-", "-logger.info()"), (5, 1, "+", "+pass"), (6, 1, "+", "+logger.info()")]
    lines += [(7, 1, "+", "+DEFAULT_CACHE_TTL"), (8, 1, "+", "+retryable cachet my_pool_size"), (9, 1, "+", "+++retry"), (10, 1, "+", "+x pool_size = feature_flags")]
    frame = spark.createDataFrame([(k, 1, h, m, t) for k, h, m, t in lines], "id long, block long, hunk long, mark string, line string")
    files = spark.createDataFrame([(11, "core/cache.py")], "id long, path string")
    got = {}
    for r in surfaces.surfaces(files, frame, "id").collect():
        got.setdefault(r.id, set()).add(r.surface)
    assert got == {1: {"retry_timeout"}, 2: {"background_job"}, 5: {"observability"}, 7: {"cache"}, 10: {"resource_limits", "feature_flag"}, 11: {"cache"}}


ROLES = {
    "a.min.js": "low_signal", "x/yarn.lock": "low_signal", "tests/a.py": "test", "src/test_a.py": "test", "src/a_test.go": "test", "Dockerfile": "schema_config", "pyproject.toml": "schema_config", "db/q.sql": "schema_config",
    "src/models.py": "schema_config", "src/remodels.py": "implementation", "app.config.json": "schema_config", "x.config": "implementation", "a/compose.dev.yaml": "schema_config", "src/routes/a.py": "contract", "pkg/__init__.py": "contract",
    "main.py": "contract", "docs/a.txt": "low_signal", "readme.md": "low_signal", "src/work.py": "implementation", ".github/workflows/a.yml": "schema_config",
}


def test_roles(spark):
    frame = spark.createDataFrame(list(ROLES.items()), "path string, want string")
    assert {r.path: r.got for r in frame.select("path", paths.role(F.col("path"), F.lit("")).alias("got")).collect()} == ROLES
    texts = [("class Open:", "contract"), ("  async def run(self):", "contract"), ("def _hidden():", "implementation"), ("x = 1\nexport const a = 1", "contract"), ("class lower:", "implementation"), ("publication", "implementation")]
    frame = spark.createDataFrame(texts, "text string, want string")
    assert [r.got for r in frame.select(paths.role(F.lit("src/a.py"), F.col("text"), boundary=F.lit(True)).alias("got")).collect()] == [w for _, w in texts]


def test_specifiers(spark):
    texts = {"from a.b import c": ["b"], "import x.y.z\nuse p::q": ["z", "q"], "import { l } from '../api.client.js'": ["api.client.js", "api.client"], "require( \"./n\")": ["n"], "from .x import (\n a)": ["x"], "reimport a; because b": []}
    frame = spark.createDataFrame([(k,) for k in texts], "text string")
    assert {r.text: r.got for r in frame.select("text", grouping.imported_stems(F.col("text")).alias("got")).collect()} == texts


def test_groups_equal_those_of_pairs(spark):
    """Every pair compared and united, against names that stand between files."""
    rng = random.Random(3)
    files, terms = [], []
    for change in range(12):
        for k in range(14):
            stem = rng.choice(["a", "b", "c", "d", "e", "index"])
            path = rng.choice([f"src/{k}/{stem}.py", f"tests/{k}/test_{stem}.py"])
            text = rng.choice(["nothing", f"import q.{rng.choice('abcdefg')}", f"call({rng.choice(['T1', 'T2', '$T1', 'T3'])})"])
            files.append((change, path, text, "test" if "test" in path else "implementation"))
            if rng.random() < 0.3:
                terms.append((change, path, rng.choice(["T1", "T2", "T3"])))
    got = grouping.grouped(spark.createDataFrame(files, "id long, path string, text string, role string"), spark.createDataFrame(terms, "id long, path string, term string"), "id").collect()
    want = {}
    for change in range(12):
        own = {p: (t, r) for c, p, t, r in files if c == change}
        parent = {p: p for p in own}

        def find(p, parent=parent):
            while parent[p] != p:
                p = parent[p]
            return p

        roles = {p: r for p, (_, r) in own.items()}
        stem = lambda p: p.rsplit("/", 1)[1][:-3].removeprefix("test_")
        for a, (text, _) in own.items():
            for b in own:
                mentions = any(c == change and p == b and text == f"call({t})" for c, p, t in terms)
                takes = a != b and (text == f"import q.{stem(b)}" or mentions)
                if takes or (a != b and own[a][1] == "test" != own[b][1] and stem(a) == stem(b)):
                    x, y = find(a), find(b)
                    parent[max(x, y)] = min(x, y)
                if takes and roles[a] == "implementation":
                    roles[a] = "consumer"
        rank = {}
        for p in own:
            rank[find(p)] = min(rank.get(find(p), 9), paths.ROLES.index(roles[p]))
        want |= {(change, p): (roles[p], find(p), rank[find(p)]) for p in own}
    assert {(r.id, r.path): (r.role, r.component, r.rank) for r in got} == want


def _looked_at(outcomes, most):
    """Uses, literals and whether any is code, by a loop over the hits in order."""
    used, literals, code, looked = [], 0, False, 0
    for k, outcome in enumerate(outcomes):
        if looked < 3 * most:
            looked += 1
            if outcome is False:
                literals += 1
                continue
            code = code or outcome is True
        used.append(k)
        if len(used) >= most and looked >= 3 * most:
            break
    return used[:most], len(used) > most, literals, code


@pytest.mark.parametrize("most", [1, 2, 5])
def test_consumers(spark, most):
    rng = random.Random(most)
    hits, nodes, want, status = [], [], {}, {}
    for node in range(80):
        outcomes = [rng.choice([True, False, False, None]) for _ in range(rng.choice([0, 1, 3 * most, 3 * most + 1, 20]))]
        hits += [(node, pos, "src/a.py", pos, "x()", o) for pos, o in enumerate(outcomes)]
        kind, parsed = rng.choice(["symbol", "route"]), rng.random() < 0.7
        nodes.append((node, kind, parsed))
        used, more, literals, code = _looked_at(outcomes, most)
        want[node] = used
        told = "consumers_found" if used else "contained" if kind == "symbol" and parsed and not literals else "no_references_found"
        status[node] = (told, "parsed" if (used and code) or told == "contained" else "textual", more, len(outcomes), literals, len(used))
    frame = spark.createDataFrame(hits, "node long, pos long, path string, line long, text string, outcome boolean")
    got = {}
    for r in consumers.select_consumers(frame, most).orderBy("node", "place").collect():
        got.setdefault(r.node, []).append(r.pos)
    assert got == {k: v for k, v in want.items() if v}
    out = consumers.consumer_status(spark.createDataFrame(nodes, "node long, kind string, parsed boolean"), frame, most, True).collect()
    assert {r.node: tuple(r)[1:] for r in out} == status


def test_relations_come_in_order(spark):
    rows = [(1, 0, "tests/a.py", "a()"), (1, 1, "conf/a.yaml", "a: 1"), (1, 2, "src/a.py", "from x import a"), (1, 3, "Makefile2", "a"), (1, 4, "src/b.py", "a()"), (1, 5, "src/c.py", "use a;"), (1, 6, "src/d.py", "important a")]
    frame = spark.createDataFrame([(*r, None) for r in rows], "node long, pos long, path string, text string, outcome boolean").withColumn("line", F.lit(1))
    assert [(r.pos, r.relation) for r in consumers.select_consumers(frame, 9).orderBy("place").collect()] == [(4, "call"), (6, "call"), (2, "import"), (5, "import"), (0, "test"), (1, "config"), (3, "config")]


@pytest.mark.parametrize("block", [2, 50_000])
def test_terms_in_lines(spark, block):
    lines = ["run(a)", "rerun(a)", "x = '/api/x'", "/api/xyz /api/x", "order.created", "é run", "runé", "$run", None, "", "a_run run_a"]
    terms = [("run",), ("/api/x",), ("order.created",), ("missing",), ("",), (None,), ("run",)]
    frame = spark.createDataFrame(list(enumerate(lines)), "pos long, text string").withColumn("term", F.lit(1))
    got = sorted((r.pos, r.term) for r in search.contract_hits(frame, "text", spark.createDataFrame(terms, "term string"), block=block).collect())
    assert got == [(0, "run"), (2, "/api/x"), (3, "/api/x"), (4, "order.created"), (5, "run"), (7, "run")]
    bound = search.containing(frame, "text", spark.createDataFrame([("run", True)], "term string, whole boolean"), also="$")
    assert sorted(r.pos for r in bound.collect()) == [0, 5]
    assert search.contract_hits(frame, "text", spark.createDataFrame([], "term string")).count() == 0


def test_names_worth_a_search(spark):
    rows = [("ab", True, False, False), ("abc", True, False, True), ("a.b.c", True, False, False), ("a.b.c", False, True, True), ("Path", True, True, False), ("path", True, False, True), ("self", True, False, False), (None, True, True, False)]
    frame = spark.createDataFrame(rows, "name string, identifier boolean, guessed boolean, want boolean")
    assert frame.where(search.traceable(F.col("name"), F.col("identifier"), F.col("guessed")) != F.col("want")).count() == 0
    hits = spark.createDataFrame([("a.md",), ("b.py",), ("c.py",)], "path string")
    assert [r.path for r in search.eligible(hits, spark.createDataFrame([("c.py",)], "path string")).collect()] == ["b.py"]


GRAMMARS = [
    ('os.getenv("A_B")', None, [("env_var", "A_B")]), ("os.environ['KEY_']", None, [("env_var", "KEY_")]), ('os.environ.get( "HOME_1", 1)', None, [("env_var", "HOME_1")]), ("a = process.env.NODE_ENV;", None, [("env_var", "NODE_ENV")]),
    ('getenv("GOT")', None, [("env_var", "GOT")]), ('x.getenv("NOT")', None, []), ('os.getenv("not-one")', None, []), ('@app.get("/x/{id}")', None, [("route", "/x/{id}")]), ("@ bp.route('/yy')", None, [("route", "/yy")]), ("@ bp.route('/y')", None, []),
    ('@a.b.route("/n")', None, []), ("router.use('/mid', f)", None, [("route", "/mid")]), ("Route::post('/pp', 'C')", None, [("route", "/pp")]), ("bus().emit('order.made', x)", None, [("event", "order.made")]), ("emit('no.owner')", None, []),
    ("bus.publish('two words')", None, []), ("timeout: 5", "yaml", [("config_key", "timeout")]), ("timeout: 5", "python", []), ('"max-age": 5', "json", [("config_key", "max-age")]), ("name: x", "yaml", []), ("  add column age int", "sql", [("schema_field", "age")]),
    ("MAX_ROWS: int = 5", "python", [("export", "MAX_ROWS")]), ("  MAX_ROWS = 5", "python", []), ("export default function loadAll() {", "javascript", [("export", "loadAll")]), ("export const a$ = 1", "vue", []), ("exported const abc", "vue", []),
    ('f(os.getenv("IN_F"), g("x"))', None, [("env_var", "IN_F")]), (None, "yaml", []), ("", None, []),
]


def test_contracts(spark):
    frame = spark.createDataFrame([(k, t, lang) for k, (t, lang, _) in enumerate(GRAMMARS)], "line int, text string, language string").withColumn("path", F.lit("a"))
    got = {}
    for r in contracts.contracts(frame).collect():
        got.setdefault(r.line, []).append((r.kind, r.name))
    assert got == {k: w for k, (_, _, w) in enumerate(GRAMMARS) if w}


def test_schema_fields(spark):
    text = "import x\nclass A(pydantic.BaseModel):\n    one: int\n\n    def run(self):\n        inner = 1\n    two = 3\nclass B(object):\n    bad: int\nclass C(Base, Generic[T]):\n    class D(Schema):\n        deep: str\n    after: int\nout = 1\nclass E(Model):\n\tlast: int"
    lines = spark.createDataFrame([(1, k + 1, t) for k, t in enumerate(text.split("\n"))], "id long, line long, text string")
    every = lines.select("id", "line")
    got = sorted(tuple(r)[1:] for r in contracts.schema_fields(lines, every, "id").collect())
    assert got == [("A", "one", 3), ("A", "two", 7), ("C", "after", 13), ("D", "deep", 12), ("E", "last", 16)]
    assert [r.name for r in contracts.schema_fields(lines, every.where("line IN (7, 9, 6)"), "id").collect()] == ["two"]


def test_commands(spark):
    files = [(1, "src/a.py", "modified", False), (2, "src/a.py", "deleted", False), (3, "b.bin", "added", True), (4, "setup.cfg", "modified", None), (4, "src/a.py", None, False), (5, "none.txt", "modified", False), (6, "tests/t.py", "modified", False), (6, "src/a.py", "modified", False)]
    frame = spark.createDataFrame(files, "id long, path string, change_type string, is_binary boolean")
    commands = [("tests", ["t"], ["tests/*"]), ("", ["lint", "."], ["**/*.py"]), ("second", ["t"], ["src/*"])]
    got = sorted((r.id, r.place, r.name, r.scope) for r in selection.select_commands(frame, commands, ["all"], ["*.cfg"], 4, "id").collect())
    assert got == [(1, 0, "lint .", "targeted"), (1, 1, "second", "targeted"), (4, 0, "all", "broad"), (5, 0, "all", "broad"), (6, 0, "tests", "targeted"), (6, 1, "lint .", "targeted")]
    assert [r.id for r in selection.select_commands(frame, commands, [], [], 1, "id").orderBy("id").collect()] == [1, 4, 6]


def _shrunk(lists, base, budget, most):
    a, b, c, d = lists["a"][:most], lists["b"][:most], lists["c"], lists["d"]
    while budget >= 1000 and base + sum(a) + sum(b) + sum(c) + sum(d) > budget:
        if a or b:
            if len(b) >= len(a):
                b = b[: len(b) // 2]
            else:
                a = a[: len(a) // 2]
        elif c:
            c = c[: len(c) // 2]
        elif len(d) > 1:
            d = d[: max(1, len(d) // 2)]
        else:
            break
    cost = base + sum(a) + sum(b) + sum(c) + sum(d)
    return (len(a), len(b), len(c), len(d), cost, cost <= budget)


def test_lists_shrink_to_fit(spark):
    rng = random.Random(4)
    items, budgets, want = [], [], {}
    for key in range(70):
        lists = {x: [rng.randint(0, 300) for _ in range(rng.choice([0, 1, 2, 5, 13, 40]))] for x in "abcd"}
        base, budget = rng.randint(0, 800), rng.choice([10, 999, 1000, 1500, 4000, 90_000])
        items += [(key, x, pos, cost) for x, costs in lists.items() for pos, cost in enumerate(costs)]
        budgets.append((key, base, budget))
        want[key] = _shrunk(lists, base, budget, 12)
    out = packing.shrink_to_fit(spark.createDataFrame(items, "id long, list string, pos long, cost long"), spark.createDataFrame(budgets, "id long, base long, budget long"), "id", most=12)
    assert {r.id: tuple(r)[1:] for r in out.collect()} == want


def test_tokens(spark):
    rng = random.Random(1)
    bomb = codec.pack(json.dumps("a" * (1 << 20)), 1 << 20)
    rows = [("{}",), ('{"a": "é\U0001f600"}',), (json.dumps([rng.random() for _ in range(2000)]),), (None,), ("no json",)]
    frame = spark.createDataFrame(rows, "document string").withColumn("token", codec.encoded(F.col("document")))
    got = {r.document: (r.token, r.back) for r in frame.withColumn("back", codec.decoded(F.col("token"))).collect()}
    assert got["{}"][1] == "{}" and got[rows[1][0]][1] == rows[1][0] and got[rows[2][0]] == ("", None) and got[None] == ("", None) and got["no json"][1] is None
    assert len(bomb) < codec.MOST_TOKEN and codec.unpack(bomb) is None and codec.unpack(bomb, most_bytes=1 << 21) is not None
    good = codec.pack('{"a": 1}')
    assert [codec.unpack(t) for t in (good, good[:8], "***", "A" * 9000, "", "é")] == ['{"a": 1}', None, None, None, None, None]
    assert zlib.decompress(__import__("base64").b64decode(good)) == b'{"a": 1}'


def test_recorded_pages(spark, tmp_path):
    pages.write_pages(str(tmp_path), "short", list(range(250)))
    pages.write_pages(str(tmp_path), "full", list(range(200)))
    pages.write_pages(str(tmp_path), "gap", list(range(300)))
    (tmp_path / "gap/2.json").unlink()
    pages.write_pages(str(tmp_path), "failed", list(range(150)))
    (tmp_path / "failed/2.json").write_text('{"errors": [{"message": "no"}, {"message": "way"}]}')
    pages.write_pages(str(tmp_path), "odd", list(range(150)))
    (tmp_path / "odd/2.json").write_text('{"total": 1}')
    pages.write_pages(str(tmp_path), "late", list(range(50)))
    (tmp_path / "late/3.json").write_text("[1]")
    pages.write_pages(str(tmp_path), "deep/er", [{"a": 1}])
    read = pages.recorded(spark, str(tmp_path))
    assert read.count() == len(list(tmp_path.rglob("*.json"))) == read.rdd.getNumPartitions()
    out = pages.listed(read)
    got = {r.listing: (r.n, r.problem) for r in out.groupBy("listing").agg(F.count("item").alias("n"), F.max("problem").alias("problem")).collect()}
    assert got == {"short": (250, None), "full": (200, None), "gap": (100, None), "failed": (0, "no; way"), "odd": (100, None), "late": (50, None), "deep/er": (1, None)}
    assert out.where("listing = 'deep/er'").first().item == '{"a":1}'
    assert pages.listed(read, most_pages=2).where("listing = 'short'").count() == 200
    (tmp_path / "none").mkdir()
    assert pages.recorded(spark, str(tmp_path / "none")).count() == 0


def test_answers(spark):
    rows = [(1, '{"data": {"a": 1}}'), (2, '{"data": {"a": 1}, "errors": [{"message": "denied"}]}'), (3, "[1]"), (4, None), (5, '{"data": null, "errors": []}')]
    got = {r.id: (r.data, r.problem) for r in pages.answers(spark.createDataFrame(rows, "id long, body string")).collect()}
    assert got[1] == ('{"a":1}', None) and got[2] == (None, "denied") and got[3][1] == got[4][1] == "no map" and got[5][1] is None


UNITS = "key string, signature string, identity string, completed boolean, detail string"


def test_two_writers_lose_nothing(spark, tmp_path):
    """The second writer commits while the first merges: the first reads anew, and both writers' rows stay; completed beats failed."""
    table = state.VersionedTable(spark, str(tmp_path / "t"), UNITS)
    run = lambda *rows: spark.createDataFrame([("k", "s", *r) for r in rows], UNITS)
    merges = []

    def slow(stored):
        merges.append(stored.count())
        if len(merges) == 1:
            state.commit_checkpoint(state.VersionedTable(spark, str(tmp_path / "t"), UNITS), run(("b", True, "two"), ("c", True, "two")))
        return state.save_checkpoint(stored, run(("a", True, "one"), ("c", False, "one")))

    assert table.commit(slow) == 1
    assert merges == [0, 2]
    assert sorted((r.identity, r.completed, r.detail) for r in table.read().collect()) == [("a", True, "one"), ("b", True, "two"), ("c", True, "two")]
    assert sorted(r.identity for r in table.read(0).collect()) == ["b", "c"]
    for k in range(6):
        state.commit_checkpoint(table, run((f"d{k}", True, "")))
    assert len(table.versions()) == table.keep and table.read().count() == 9
    assert len(list((tmp_path / "t/rows").iterdir())) == table.keep and not [p for p in (tmp_path / "t/drafts").iterdir() if not p.name.startswith(".")]


def test_an_overtaken_writer_gives_up(spark, tmp_path):
    table = state.VersionedTable(spark, str(tmp_path / "t"), "a int")
    one = spark.createDataFrame([(1,)], "a int")

    def always_late(stored):
        state.VersionedTable(spark, str(tmp_path / "t"), "a int").write(one)
        return stored

    with pytest.raises(state.Conflict):
        table.commit(always_late, tries=2)
    assert table.versions() == [0, 1]


FOUND = "key string, fingerprint string, fingerprint_v2 string, title string"


def test_a_replayed_batch_publishes_nothing_twice(spark, tmp_path):
    published = state.Published(spark, str(tmp_path / "p"), buckets=4)
    first = spark.createDataFrame([("k", "a", "A", "1"), ("k", "b", "B", "2"), ("k", "b", "B", "2"), ("l", "a", "A", "3")], FOUND)
    second = spark.createDataFrame([("k", "x", "A", "reworded"), ("k", "c", "C", "4"), ("l", "b", "B", "5")], FOUND)
    for batch, number in ((first, 0), (second, 1), (second, 1), (first, 0), (second, 1)):
        published.publish(batch, number)
    got = sorted((r.key, r.fingerprint, r.batch) for r in published.outbox().collect())
    assert got == [("k", "a", 0), ("k", "b", 0), ("k", "c", 1), ("l", "a", 0), ("l", "b", 1)]
    assert published.seen().count() == published.seen().distinct().count()


def test_a_stream_publishes_once(spark, tmp_path):
    """A stream over files, stopped and started again from a checkpoint whose last commit is gone, so that its batch is replayed."""
    source, published = tmp_path / "in", state.Published(spark, str(tmp_path / "p"), buckets=4)
    rows = lambda *r: spark.createDataFrame(list(r), FOUND).coalesce(1).write.mode("append").json(str(source))

    def run():
        stream = spark.readStream.schema(FOUND).json(str(source))
        state.publish_stream(stream, published, str(tmp_path / "check")).trigger(availableNow=True).start().awaitTermination()

    rows(("k", "a", "A", "1"), ("k", "b", "B", "2"))
    run()
    rows(("k", "a", "A", "again"), ("k", "c", "C", "3"))
    run()
    for old in (tmp_path / "check/commits").iterdir():
        if old.name.lstrip(".").startswith("1"):
            old.unlink()
    run()
    assert sorted((r.key, r.fingerprint) for r in published.outbox().collect()) == [("k", "a"), ("k", "b"), ("k", "c")]
