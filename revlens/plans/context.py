"""Queries of what surrounds a change: layered settings, surfaces, groups of files, consumers, contracts, plans."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from revlens.functions import codec
from revlens.functions import paths as P
from revlens.operators import consumers, contracts, grouping, packing, search, selection, settings, surfaces, symbols
from revlens.plans.inputs import Data, query
from revlens.sources import files, pages

#: Two kinds of layers for each key: a customer's document, then one for each of the key's orders. Maps, values and lists change places.
_LAYERS = """SELECT c_custkey % 700 AS key, c_custkey AS rank, CASE c_custkey % 5
WHEN 0 THEN concat('{{"profile":"', CASE c_nationkey % 4 WHEN 0 THEN 'fast' WHEN 1 THEN 'strict' ELSE 'typo' END, '","review":{{"floor":"minor","limits":{{"nodes":', CAST(c_custkey AS STRING), ',"names":["a","', c_mktsegment, '"]}}}}}}')
WHEN 1 THEN concat('{{"review":{{"limits":', CAST(c_nationkey AS STRING), '}},"s":"', c_mktsegment, '"}}')
WHEN 2 THEN '{{"review":{{"limits":{{}},"floor":"major"}}}}' WHEN 3 THEN '{{"review":7,"x":{{"y":{{"z":[1,{{"a":2}}]}}}}}}' ELSE '{{"x":{{}}}}' END AS document FROM {customer}
UNION ALL SELECT o_custkey % 700, 1000000 + o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN concat('{{"review":{{"limits":{{"nodes":', CAST(o_orderkey AS STRING), '}},"status":"', o_orderstatus, '"}}}}')
WHEN 1 THEN '{{"x":{{"y":"flat"}}}}' WHEN 2 THEN '{{"x":{{"w":{{"deep":true}}}}}}' ELSE '{{"review":{{"limits":{{"names":[]}}}}}}' END FROM {orders} WHERE o_orderkey % 5 = 0"""
_MERGED = "SELECT key, list_reduce(list(document::JSON ORDER BY rank), lambda a, b: json_merge_patch(a, b)) AS j FROM ({layers}) GROUP BY key"
_LEAVES = """WITH RECURSIVE m AS ({merged}), l(key, path, j) AS (
SELECT key, []::VARCHAR[], j FROM m UNION ALL
SELECT key, list_append(path, k), json_extract(j, '$."' || k || '"') FROM (SELECT key, path, j, unnest(json_keys(j)) AS k FROM l WHERE json_type(j) = 'OBJECT' AND j::VARCHAR <> '{{{{}}}}'))
SELECT key, array_to_string(path, '.') AS path, j::VARCHAR AS value{more} FROM l WHERE (json_type(j) <> 'OBJECT' OR j::VARCHAR = '{{{{}}}}')"""


@query("settings_merged", _LEAVES.format(merged=_MERGED.format(layers=_LAYERS), more=""))
def settings_merged(d: Data) -> DataFrame:
    """Layers of each key over each other, told by the paths of the merged document, which is put together and taken apart again."""
    whole = settings.overlay_documents(d(_LAYERS))
    return settings.leaves(whole.withColumn("rank", F.lit(0))).select("key", F.array_join("path", ".").alias("path"), "value")


_PROFILES = "SELECT 'fast' AS profile, '{{\"review\":{{\"floor\":\"critical\",\"rounds\":1}},\"depth\":2}}' AS document UNION ALL SELECT 'strict', '{{\"review\":{{\"floor\":\"info\",\"rounds\":9}},\"x\":{{\"y\":{{\"q\":1}}}}}}'"


@query(
    "settings_profiles",
    f"""WITH own AS ({_MERGED.format(layers=_LAYERS)}), named AS (SELECT key, j, coalesce(j->>'profile', 'fast') AS profile FROM own),
under AS (SELECT key, json_merge_patch(p.document::JSON, j) AS j FROM named JOIN ({_PROFILES}) p USING (profile))
SELECT key, path, value, NULL AS problem FROM ({_LEAVES.format(merged='SELECT * FROM under', more='')}) UNION ALL SELECT key, NULL, NULL, profile FROM named WHERE profile NOT IN ('fast', 'strict')""",
)
def settings_profiles(d: Data) -> DataFrame:
    out = settings.with_profiles(d(_LAYERS), d(_PROFILES.replace("{{", "{").replace("}}", "}")), "fast")
    return out.select("key", F.array_join("path", ".").alias("path"), "value", "problem")


#: A change for each order; its line items are hunks, which take a line away, and add one where the quantity is odd.
_PATHS = """SELECT l_orderkey AS id, CASE l_partkey % 29 WHEN 0 THEN 'src/Migrations/x.py' WHEN 1 THEN 'db/add_schema_v2.sql' WHEN 2 THEN 'db/schema.sql.txt' WHEN 3 THEN 'charts/app/Chart.yaml' WHEN 4 THEN '.github/workflows/ci.yml'
WHEN 5 THEN 'ops/Dockerfile.dev' WHEN 6 THEN 'ops/compose.prod.yml' WHEN 7 THEN 'main.tf' WHEN 8 THEN 'src/api/v1.py' WHEN 9 THEN 'docs/openapi-3.json' WHEN 10 THEN 'src/serializers.py' WHEN 11 THEN 'a.proto'
WHEN 12 THEN 'app/workers/mail.py' WHEN 13 THEN 'lib/feature_flags.rb' WHEN 14 THEN 'lib/flags/on.rb' WHEN 15 THEN 'core/cache.py' WHEN 16 THEN 'core/caching/x.py' WHEN 17 THEN 'core/cache' WHEN 18 THEN 'src/apiary.py'
WHEN 19 THEN 'task' WHEN 20 THEN 'values.yaml' ELSE concat('src/m', CAST(l_suppkey AS STRING), '.py') END AS path FROM {lineitem} WHERE l_linenumber = 1"""
_WORD = """CASE {n} % 31 WHEN 0 THEN 'x = retry(3)' WHEN 1 THEN 'retryable = 1' WHEN 2 THEN 'DEFAULT_CACHE_TTL = 5' WHEN 3 THEN 'cached_total' WHEN 4 THEN 'import CELERY' WHEN 5 THEN 'if Feature_Flag(a):' WHEN 6 THEN 'pool_size: 4'
WHEN 7 THEN 'my_pool_size' WHEN 8 THEN 'logger.info(1)' WHEN 9 THEN 'login()' WHEN 10 THEN 'log_ x' WHEN 11 THEN 'a.start_span()' WHEN 12 THEN 'lifespan' ELSE 'pass' END"""
_HUNKS = f"""SELECT l_orderkey AS id, l_suppkey % 2 AS block, l_linenumber AS hunk, '-' AS mark, concat('-', {_WORD.format(n='l_partkey')}) AS line FROM {{lineitem}}
UNION ALL SELECT l_orderkey, l_suppkey % 2, l_linenumber, '+', concat('+', {_WORD.format(n='(l_partkey + l_suppkey)')}) FROM {{lineitem}} WHERE CAST(l_quantity AS INT) % 2 = 1
UNION ALL SELECT l_orderkey, l_suppkey % 2, l_linenumber, ' ', ' timeout = 1' FROM {{lineitem}}"""
_SURFACE_SQL = {
    "migration": (r"(^|/)(migrations?|migrate|alembic|liquibase|flyway)(/|$)|(migrat|schema)[^/]*\.sql$", None),
    "deployment": (r"(^|/)(k8s|kubernetes|deploy|deployment|helm|charts?|terraform|infra|ansible)(/|$)|(^|/)\.github/workflows/|(^|/)(dockerfile[^/]*|(compose|values)(\.[^.]+)?\.ya?ml)$|\.(tf|tfvars)$", None),
    "public_contract": (r"(^|/)(apis?|routes?|endpoints?|interfaces?|contracts?|schemas?|proto)(/|$)|(^|/)(openapi|swagger)[^/]*\.(ya?ml|json)$|(^|/)(routes?|api|schema|serializers?)\.[^/]+$|\.proto$", None),
    "background_job": (r"(^|/)(jobs?|workers?|tasks?|queues?|consumers?|cron|schedulers?)(/|$)", r"\bcelery\b"),
    "feature_flag": (r"(^|/)(feature_?flags?|flags?|toggles?)(/|\.[^/]+$)", r"\bfeature_?flags?\b"),
    "cache": (r"(^|/)(caches?|caching)(/|\.[^/]+$)", r"(^|[^0-9a-z])(cached?|ttl)($|[^0-9a-z])"),
    "retry_timeout": (None, r"\b(retry|timeout)\b"),
    "resource_limits": (None, r"\bpool_size\b"),
}


@query(
    "operational_surfaces",
    " UNION ".join(
        [f"SELECT id, '{s}' AS surface FROM ({_PATHS}) WHERE regexp_matches(lower(path), '{p}')" for s, (p, _) in _SURFACE_SQL.items() if p]
        + [f"SELECT id, '{s}' FROM ({_HUNKS}) WHERE mark <> ' ' AND regexp_matches(lower(substr(line, 2)), '{w}')" for s, (_, w) in _SURFACE_SQL.items() if w]
        + [rf"SELECT id, 'observability' FROM ({_HUNKS}) GROUP BY id, block, hunk HAVING bool_or(mark = '+') AND bool_or(mark = '-' AND regexp_matches(lower(line), '\b(logger|log_|start_span)\b'))"]
    ),
)
def operational_surfaces(d: Data) -> DataFrame:
    return surfaces.surfaces(d(_PATHS), d(_HUNKS), "id")


#: Files of a customer's changes: modules, their tests and scripts that import by path; some texts call names that others declare.
_FILES = """SELECT o_custkey AS id, CASE o_orderkey % 4 WHEN 0 THEN concat('src/d', CAST(o_orderkey AS STRING), '/m', CAST(o_orderkey % 25 AS STRING), '.py') WHEN 1 THEN concat('tests/d', CAST(o_orderkey AS STRING), '/test_m', CAST(o_orderkey % 25 AS STRING), '.py')
WHEN 2 THEN concat('lib/d', CAST(o_orderkey AS STRING), '/n', CAST(o_orderkey % 9 AS STRING), '.js') ELSE concat('src/d', CAST(o_orderkey AS STRING), '/models.py') END AS path,
CASE o_orderkey % 4 WHEN 0 THEN 'implementation' WHEN 1 THEN 'test' WHEN 2 THEN 'implementation' ELSE 'schema_config' END AS role_told,
CASE o_orderkey % 5 WHEN 0 THEN concat('from pkg.m', CAST((o_orderkey * 7 + 3) % 25 AS STRING), ' import (a, b)') WHEN 1 THEN concat('import x.y.m', CAST((o_orderkey * 3 + 1) % 25 AS STRING), chr(10), 'use a::n', CAST(o_orderkey % 9 AS STRING))
WHEN 2 THEN concat('const a = require( ''../n', CAST((o_orderkey + 4) % 9 AS STRING), '.js'')') WHEN 3 THEN concat('Fn', CAST((o_orderkey * 3) % 30 AS STRING), '(1); $Fn1; Fn') ELSE 'nothing' END AS text,
CASE o_orderkey % 5 WHEN 0 THEN concat('m', CAST((o_orderkey * 7 + 3) % 25 AS STRING)) WHEN 1 THEN concat('m', CAST((o_orderkey * 3 + 1) % 25 AS STRING)) WHEN 2 THEN concat('n', CAST((o_orderkey + 4) % 9 AS STRING)) END AS imports,
CASE o_orderkey % 5 WHEN 1 THEN concat('n', CAST(o_orderkey % 9 AS STRING)) END AS uses, CASE o_orderkey % 5 WHEN 3 THEN concat('Fn', CAST((o_orderkey * 3) % 30 AS STRING)) END AS says,
CASE WHEN o_orderstatus = 'F' THEN concat('Fn', CAST(o_orderkey % 30 AS STRING)) END AS term,
CASE o_orderkey % 4 WHEN 2 THEN concat('n', CAST(o_orderkey % 9 AS STRING)) WHEN 3 THEN 'models' ELSE concat('m', CAST(o_orderkey % 25 AS STRING)) END AS stem FROM {orders}"""


@query(
    "file_groups",
    f"""WITH RECURSIVE f AS ({_FILES}), e AS (
SELECT a.id, a.path AS a, b.path AS b, TRUE AS takes FROM f a JOIN f b ON a.id = b.id AND a.path <> b.path AND (b.stem IN (a.imports, a.uses) OR b.term = a.says)
UNION ALL SELECT a.id, a.path, b.path, FALSE FROM f a JOIN f b ON a.id = b.id AND a.path <> b.path AND a.stem = b.stem AND a.role_told = 'test' AND b.role_told <> 'test'),
ways AS (SELECT id, a, b FROM e UNION SELECT id, b, a FROM e),
reach AS (SELECT id, path, path AS other FROM f UNION SELECT r.id, r.path, ways.b FROM reach r JOIN ways ON ways.id = r.id AND ways.a = r.other),
placed AS (SELECT f.id, f.path, min(other) AS component, any_value(CASE WHEN f.role_told = 'implementation' AND EXISTS (SELECT 1 FROM e WHERE e.id = f.id AND e.a = f.path AND takes) THEN 'consumer' ELSE f.role_told END) AS role FROM f JOIN reach r ON r.id = f.id AND r.path = f.path GROUP BY f.id, f.path)
SELECT id, path, role, component, min(list_position(['contract', 'schema_config', 'implementation', 'consumer', 'test', 'low_signal'], role) - 1) OVER (PARTITION BY id, component) AS rank FROM placed""",
)
def file_groups(d: Data) -> DataFrame:
    """Files that belong together, their roles told by path and text."""
    rows = d(_FILES)
    files = rows.select("id", "path", "text", P.role(F.col("path"), F.col("text")).alias("role"))
    return grouping.grouped(files, rows.where("term IS NOT NULL").select("id", "path", "term"), "id")


#: Uses of each part by its line items; whether a parser calls one code, a literal or nothing.
_HITS = """SELECT l_partkey AS node, l_orderkey * 1000 + l_linenumber * 100 + l_suppkey % 100 AS pos, CASE l_suppkey % 7 WHEN 0 THEN 'tests/a.py' WHEN 1 THEN 'conf/a.yaml' WHEN 2 THEN 'Unknown.zzz' WHEN 3 THEN 'src/x.spec.ts' ELSE 'src/a.py' END AS path, l_linenumber AS line,
CASE l_suppkey % 5 WHEN 0 THEN 'from a import b' WHEN 1 THEN '  import  b' WHEN 2 THEN 'imports(b)' WHEN 3 THEN 'require ("b")' ELSE 'x = b()' END AS text, CASE CAST(l_quantity AS INT) % 3 WHEN 0 THEN TRUE WHEN 1 THEN FALSE END AS outcome FROM {lineitem}"""
_RANKED = f"""SELECT *, row_number() OVER (PARTITION BY node ORDER BY list_position(['call', 'import', 'test', 'config'], relation), pos) AS nth FROM (
SELECT *, CASE WHEN path IN ('tests/a.py', 'src/x.spec.ts') THEN 'test' WHEN text IN ('from a import b', '  import  b', 'require ("b")') THEN 'import' WHEN path IN ('conf/a.yaml', 'Unknown.zzz') THEN 'config' ELSE 'call' END AS relation FROM ({_HITS}))"""


@query("consumers_shown", f"SELECT node, pos, path, line, relation, outcome, place FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY nth) AS place FROM ({_RANKED}) WHERE nth > 15 OR outcome IS NOT FALSE) WHERE place <= 5")
def consumers_shown(d: Data) -> DataFrame:
    return consumers.select_consumers(d(_HITS), 5)


_NODES = "SELECT p_partkey AS node, p_size % 30 AS change, CASE WHEN p_size % 4 = 0 THEN 'route' ELSE 'symbol' END AS kind, p_size % 3 > 0 AS parsed FROM {part}"


@query(
    "consumer_status",
    f"""WITH r AS ({_RANKED}), v AS (SELECT node, count(*) AS hits, count(*) FILTER (WHERE nth <= 15 AND outcome IS FALSE) AS literals, count(*) FILTER (WHERE nth <= 15 AND outcome IS NOT FALSE) AS seen,
bool_or(nth <= 15 AND outcome IS TRUE) AS code, bool_or(nth = 15 AND outcome IS FALSE) AS last_is_literal FROM r GROUP BY node),
n AS (SELECT n.*, coalesce(hits, 0) AS hits, coalesce(literals, 0) AS literals, code, CASE WHEN hits > 15 AND seen < 5 THEN least(5, seen + hits - 15) WHEN hits > 15 AND last_is_literal THEN seen + 1 ELSE coalesce(seen, 0) END AS uses FROM ({_NODES}) n LEFT JOIN v USING (node)),
s AS (SELECT *, CASE WHEN uses > 0 THEN 'consumers_found' WHEN kind = 'symbol' AND parsed AND literals = 0 THEN 'contained' ELSE 'no_references_found' END AS status FROM n)
SELECT node, status, CASE WHEN uses > 0 AND code OR status = 'contained' THEN 'parsed' ELSE 'textual' END AS verification, uses > 5 AS truncated, hits, literals, least(uses, 5) AS shown,
CASE WHEN bool_or(status = 'consumers_found') OVER w THEN 'consumers_found' WHEN bool_and(status = 'contained') OVER w THEN 'contained' ELSE 'no_references_found' END AS change_status FROM s WINDOW w AS (PARTITION BY change)""",
)
def consumer_status(d: Data) -> DataFrame:
    nodes = d(_NODES)
    told = consumers.consumer_status(nodes, d(_HITS), 5, True)
    whole = consumers.map_status(told.join(nodes.select("node", "change"), "node"), "change", F.lit(False)).withColumnRenamed("status", "change_status")
    return told.join(nodes.select("node", "change"), "node").join(whole, "change").drop("change")


_TERMS = "SELECT substr(text, 5, 12) AS term FROM {benchmark} UNION SELECT regexp_extract(text, '([A-Za-z]+)', 1) FROM {benchmark} UNION SELECT concat(l.w, ' ') FROM (SELECT regexp_extract(text, '([a-z]+)', 1) AS w FROM {benchmark}) AS l"


@query(
    "contract_join",
    f"""WITH t AS (SELECT term, regexp_full_match(term, '[A-Za-z_][A-Za-z0-9_]*') AS whole FROM ({_TERMS}) WHERE term <> '')
SELECT doc_id, term FROM {{documents}} JOIN t ON NOT whole AND contains(text, term)
UNION ALL SELECT doc_id, term FROM (SELECT doc_id, unnest(list_distinct(regexp_extract_all(text, '[\\p{{{{L}}}}\\p{{{{N}}}}_]+'))) AS term FROM {{documents}}) JOIN t USING (term) WHERE whole""",
)
def contract_join(d: Data) -> DataFrame:
    """Every document with every term of the benchmark that it holds; identifiers as whole words."""
    return search.contract_hits(d.table("documents").select("doc_id", "text"), "text", d(_TERMS)).select("doc_id", "term")


#: An added line for each line item, of one of ten grammars or none, with names of its own.
_ADDED = """SELECT l_orderkey AS id, concat('src/f', CAST(l_suppkey AS STRING)) AS path, l_linenumber AS line, CASE l_partkey % 5 WHEN 0 THEN 'python' WHEN 1 THEN 'yaml' WHEN 2 THEN 'sql' WHEN 3 THEN 'typescript' END AS language,
CASE l_partkey % 17 WHEN 0 THEN concat('x = os.getenv( "VAR_', n, '")') WHEN 1 THEN concat('os.environ["ENV_', n, '"] = os.environ.get(''data'')') WHEN 2 THEN concat('const a = process.env.NODE_', n, ';') WHEN 3 THEN concat('y = a.getenv("NO_', n, '")')
WHEN 4 THEN concat('if (getenv("GOT_', n, '"))') WHEN 5 THEN concat('@ bp.route("/r/', n, '")') WHEN 6 THEN concat('router.use(''/u/', n, ''', f)') WHEN 7 THEN concat('Route::get("/g/', n, '")') WHEN 8 THEN concat('bus().emit("order.', n, '", f("x"))')
WHEN 9 THEN concat('bus.emit("order ', n, '")') WHEN 10 THEN concat('key_', n, ': 1') WHEN 11 THEN concat('  ADD  COLUMN col_', n, ' int,') WHEN 12 THEN concat('LIMIT_', n, ': int = 5') WHEN 13 THEN concat('export default class Box', n, ' {{') WHEN 14 THEN 'id: 3'
WHEN 15 THEN concat('@a.b.route("/no/', n, '")') ELSE 'pass' END AS text, l_partkey, n FROM (SELECT *, CAST(l_suppkey AS STRING) AS n FROM {lineitem})"""
_CONTRACT_SQL = [
    ("env_var", "'VAR_' || n", "l_partkey % 17 = 0"), ("env_var", "'ENV_' || n", "l_partkey % 17 = 1"), ("env_var", "'NODE_' || n", "l_partkey % 17 = 2"), ("env_var", "'GOT_' || n", "l_partkey % 17 = 4"), ("route", "'/r/' || n", "l_partkey % 17 = 5"),
    ("route", "'/u/' || n", "l_partkey % 17 = 6"), ("route", "'/g/' || n", "l_partkey % 17 = 7"), ("event", "'order.' || n", "l_partkey % 17 = 8"), ("config_key", "'key_' || n", "l_partkey % 17 = 10 AND language = 'yaml'"),
    ("schema_field", "'col_' || n", "l_partkey % 17 = 11 AND language = 'sql'"), ("export", "'LIMIT_' || n", "l_partkey % 17 = 12 AND language = 'python'"), ("config_key", "'LIMIT_' || n", "l_partkey % 17 = 12 AND language = 'yaml'"),
    ("config_key", "'Route'", "l_partkey % 17 = 7 AND language = 'yaml'"), ("export", "'Box' || n", "l_partkey % 17 = 13 AND language = 'typescript'"),
]
_CONTRACTS = " UNION ALL ".join(f"SELECT id, path, line, '{k}' AS kind, {n} AS name FROM ({_ADDED}) WHERE {w}" for k, n, w in _CONTRACT_SQL)


@query("touched_contracts", _CONTRACTS)
def touched_contracts(d: Data) -> DataFrame:
    return contracts.contracts(d(_ADDED).select("id", "path", "line", "text", "language")).select("id", "path", "line", "kind", "name")


@query(
    "contracts_listed",
    f"""WITH one AS (SELECT id, kind, name, min((path, line)) AS place FROM ({_CONTRACTS}) GROUP BY id, kind, name),
r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY list_position(['symbol', 'export', 'route', 'event', 'schema_field', 'env_var', 'config_key'], kind), place, name) AS nth, count(*) OVER (PARTITION BY id) > 2 AS truncated FROM one)
SELECT id, kind, name, place[1] AS path, place[2] AS line, truncated FROM r WHERE nth <= 2""",
)
def contracts_listed(d: Data) -> DataFrame:
    return contracts.first_contracts(contracts.contracts(d(_ADDED).select("id", "path", "line", "text", "language")), "id", 2)


#: A class for each order, of a base that is a schema or isn't; its line items are fields, or lines of a method.
_CLASSES = """SELECT l_orderkey AS id, l_linenumber * 2 + 1 AS line, CASE WHEN l_linenumber % 4 = 3 THEN concat('        inner', CAST(l_suppkey AS STRING), ' = 1') WHEN l_linenumber % 4 = 2 THEN concat('    def run', CAST(l_suppkey AS STRING), '(self):') WHEN l_suppkey % 3 = 0 THEN concat('    f', CAST(l_suppkey AS STRING), ': int = 1')
WHEN l_suppkey % 3 = 1 THEN concat('    g', CAST(l_suppkey AS STRING), ' = 2') ELSE '    name: str' END AS text FROM {lineitem}
UNION ALL SELECT l_orderkey, l_linenumber * 2 + 2, '' FROM {lineitem}
UNION ALL SELECT o_orderkey, 1, concat('class C(', CASE o_custkey % 3 WHEN 0 THEN 'pydantic.BaseModel' WHEN 1 THEN 'Generic[T], Model[T]' ELSE 'object' END, '):') FROM {orders}
UNION ALL SELECT o_orderkey, 2, '    first: int' FROM {orders} UNION ALL SELECT o_orderkey, 100, concat('out', CAST(o_orderkey AS STRING), ' = 1') FROM {orders}"""
_NEW = "SELECT l_orderkey AS id, l_linenumber * 2 + 1 AS line FROM {lineitem} WHERE CAST(l_quantity AS INT) % 2 = 0 UNION ALL SELECT o_orderkey, 2 FROM {orders} WHERE o_orderstatus = 'F' UNION ALL SELECT o_orderkey, 100 FROM {orders}"


@query(
    "schema_fields",
    """SELECT l_orderkey AS id, 'C' AS class, CASE l_suppkey % 3 WHEN 0 THEN 'f' ELSE 'g' END || l_suppkey AS name, l_linenumber * 2 + 1 AS line FROM {lineitem} JOIN {orders} ON o_orderkey = l_orderkey
WHERE o_custkey % 3 < 2 AND l_linenumber % 4 IN (0, 1) AND l_suppkey % 3 < 2 AND (l_orderkey, l_linenumber) IN (SELECT (l_orderkey, l_linenumber) FROM {lineitem} WHERE CAST(l_quantity AS INT) % 2 = 0) AND length('f' || l_suppkey) >= 3 UNION ALL SELECT o_orderkey, 'C', 'first', 2 FROM {orders} WHERE o_orderstatus = 'F' AND o_custkey % 3 < 2""",
)
def schema_fields(d: Data) -> DataFrame:
    return contracts.schema_fields(d(_CLASSES), d(_NEW), "id")


_COMMANDS = [("unit", ["pytest", "-q"], ["src/*.py"]), ("", ["npm", "test"], ["*.ts", "web/**"]), ("again", ["pytest", "-q"], ["tests/*.py"]), ("lint", ["ruff"], ["**/*.py"])]
_CHANGED = """SELECT l_orderkey AS id, CASE l_suppkey % 11 WHEN 0 THEN 'src/a.py' WHEN 1 THEN 'web/b.css' WHEN 2 THEN 'tests/c.py' WHEN 3 THEN 'd.ts' WHEN 4 THEN 'pyproject.toml' WHEN 5 THEN 'top.py' ELSE 'README.md' END AS path,
CASE WHEN l_quantity < 10 THEN 'deleted' ELSE 'modified' END AS change_type, l_partkey % 7 = 0 AS is_binary FROM {lineitem}"""
_BROAD = "SELECT id, 0 AS place, 'make check' AS name, 'make check' AS command, 'broad' AS scope FROM"


@query(
    "command_selection",
    f"""WITH p AS (SELECT DISTINCT id, path FROM ({_CHANGED}) WHERE change_type <> 'deleted' AND NOT is_binary), wide AS (SELECT DISTINCT id FROM p WHERE path = 'pyproject.toml'),
m AS (SELECT DISTINCT id, n, name, command FROM p JOIN (VALUES ('src/a.py', 0, 'unit', 'pytest -q'), ('d.ts', 1, 'npm test', 'npm test'), ('web/b.css', 1, 'npm test', 'npm test'), ('tests/c.py', 2, 'again', 'pytest -q'),
('src/a.py', 3, 'lint', 'ruff'), ('tests/c.py', 3, 'lint', 'ruff'), ('top.py', 3, 'lint', 'ruff')) v(path, n, name, command) USING (path) WHERE id NOT IN (SELECT id FROM wide)),
one AS (SELECT id, min(n) AS n, command, min_by(name, n) AS name FROM m GROUP BY id, command), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY n) - 1 AS place FROM one)
SELECT id, place, name, command, 'targeted' AS scope FROM r WHERE place < 2 UNION ALL {_BROAD} wide UNION ALL {_BROAD} (SELECT DISTINCT id FROM p WHERE id NOT IN (SELECT id FROM wide) AND id NOT IN (SELECT id FROM m))""",
)
def command_selection(d: Data) -> DataFrame:
    out = selection.select_commands(d(_CHANGED), _COMMANDS, ["make", "check"], ["pyproject.toml"], 2, "id")
    return out.withColumn("command", F.array_join("command", " ")).withColumn("place", F.col("place").cast("long"))


_LISTS = "SELECT o_custkey AS id, CASE o_orderkey % 7 WHEN 0 THEN 'a' WHEN 1 THEN 'a' WHEN 2 THEN 'b' WHEN 3 THEN 'b' WHEN 4 THEN 'c' ELSE 'd' END AS list, o_orderkey AS pos, CAST(o_orderkey % 900 AS BIGINT) AS cost FROM {orders}"
_BUDGETS = "SELECT c_custkey AS id, CAST(c_nationkey * 30 AS BIGINT) AS base, CAST(900 + c_custkey % 40 * 150 AS BIGINT) AS budget FROM {customer}"


@query(
    "shrink_to_fit",
    f"""WITH RECURSIVE r AS (SELECT id, list, row_number() OVER w AS n, sum(cost) OVER w AS total FROM ({_LISTS}) WINDOW w AS (PARTITION BY id, list ORDER BY pos)),
t AS (SELECT id, list, list(total ORDER BY n) AS totals FROM r GROUP BY id, list),
k AS (SELECT b.id, base, budget, coalesce(a.totals, []) AS ta, coalesce(b2.totals, []) AS tb, coalesce(c.totals, []) AS tc, coalesce(d.totals, []) AS td FROM ({_BUDGETS}) b LEFT JOIN t a ON a.id = b.id AND a.list = 'a' LEFT JOIN t b2 ON b2.id = b.id AND b2.list = 'b'
LEFT JOIN t c ON c.id = b.id AND c.list = 'c' LEFT JOIN t d ON d.id = b.id AND d.list = 'd'),
s AS (SELECT id, least(len(ta), 3) AS a, least(len(tb), 3) AS b, len(tc) AS c, len(td) AS d, 0 AS step FROM k UNION ALL
SELECT id, CASE WHEN (a > 0 OR b > 0) AND b < a THEN a // 2 ELSE a END, CASE WHEN (a > 0 OR b > 0) AND b >= a THEN b // 2 ELSE b END, CASE WHEN a = 0 AND b = 0 AND c > 0 THEN c // 2 ELSE c END, CASE WHEN a = 0 AND b = 0 AND c = 0 AND d > 1 THEN d // 2 ELSE d END, step + 1
FROM s JOIN k USING (id) WHERE (a > 0 OR b > 0 OR c > 0 OR d > 1) AND budget >= 1000 AND base + coalesce(ta[a], 0) + coalesce(tb[b], 0) + coalesce(tc[c], 0) + coalesce(td[d], 0) > budget),
l AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY step DESC) AS back FROM s)
SELECT id, a::INTEGER AS a, b::INTEGER AS b, c::INTEGER AS c, d::INTEGER AS d, (base + coalesce(ta[a], 0) + coalesce(tb[b], 0) + coalesce(tc[c], 0) + coalesce(td[d], 0))::BIGINT AS cost, base + coalesce(ta[a], 0) + coalesce(tb[b], 0) + coalesce(tc[c], 0) + coalesce(td[d], 0) <= budget AS fits FROM l JOIN k USING (id) WHERE back = 1""",
)
def shrink_to_fit(d: Data) -> DataFrame:
    return packing.shrink_to_fit(d(_LISTS), d(_BUDGETS), "id", most=3)


@query(
    "paged_listing",
    f"""WITH p AS (SELECT id || '/' || half AS listing, floor(nth / 4)::INTEGER + 1 AS page, item, id FROM (SELECT o_custkey AS id, o_orderkey % 2 AS half, o_orderkey AS item, row_number() OVER (PARTITION BY o_custkey, o_orderkey % 2 ORDER BY o_orderkey) - 1 AS nth FROM {{orders}})),
there AS (SELECT * FROM p WHERE NOT (id % 5 = 0 AND page = 2)), n AS (SELECT listing, page, count(*) AS n FROM there GROUP BY listing, page),
upto AS (SELECT listing, least(coalesce(min(page) FILTER (WHERE n < 4), 3), coalesce(min(page) FILTER (WHERE (listing, page + 1) NOT IN (SELECT (listing, page) FROM n)), 3), 3) AS upto FROM n GROUP BY listing),
bad AS (SELECT DISTINCT listing FROM there JOIN upto USING (listing) WHERE id % 7 = 0 AND page = 1 AND upto >= 1)
SELECT listing, page, item::VARCHAR AS item, NULL AS problem FROM there JOIN upto USING (listing) WHERE page <= upto AND listing NOT IN (SELECT listing FROM bad) UNION ALL SELECT listing, NULL, NULL, 'no' FROM bad""",
)
def paged_listing(d: Data) -> DataFrame:
    """Listings recorded as JSON pages of 4; of every fifth customer page 2 isn't there, of every seventh page 1 is an error."""
    w = Window.partitionBy("id", "half").orderBy("item")
    rows = d("SELECT o_custkey AS id, o_orderkey % 2 AS half, o_orderkey AS item FROM {orders}").withColumn("page", F.floor((F.row_number().over(w) - 1) / 4).cast("int") + 1)
    rows = rows.where(~((F.col("id") % 5 == 0) & (F.col("page") == 2)))
    body = F.when((F.col("id") % 7 == 0) & (F.col("page") == 1), '{"message": "no"}').otherwise(F.to_json(F.col("items")))
    recorded = rows.groupBy("id", "half", "page").agg(F.array_sort(F.collect_list("item")).alias("items")).select(F.concat_ws("/", "id", "half").alias("listing"), "page", body.alias("body"))
    return pages.listed(recorded, per_page=4, most_pages=3).select("listing", "page", "item", "problem")


@query("marker_roundtrip")
def marker_roundtrip(d: Data) -> DataFrame:
    """Every document as a token and back; one whose token is too long has none."""
    packed = d.table("documents").select("doc_id", F.to_json(F.struct("text", "source")).alias("document")).withColumn("token", codec.encoded(F.col("document")))
    back = packed.withColumn("back", codec.decoded(F.col("token")))
    return back.select("doc_id", F.char_length("token").alias("n_token"), F.col("back").eqNullSafe(F.col("document")).alias("same"))


#: A file of one function for each order, documented by a text, by a comment above its decorator, or not at all; its body is the order's line items.
_SOURCE = """SELECT o_custkey AS change, concat('f', CAST(o_orderkey AS STRING), '.py') AS file, l.line, l.text FROM {orders} JOIN (SELECT o_orderkey AS k, 1 AS line, CASE o_orderkey % 5 WHEN 1 THEN '# told above' WHEN 2 THEN '# ---' ELSE 'import x' END AS text FROM {orders}
UNION ALL SELECT o_orderkey, 2, '@wrapped' FROM {orders} UNION ALL SELECT o_orderkey, 3, CASE WHEN o_orderkey % 2 = 0 THEN 'def run():' ELSE 'class Run(Base):  # open' END FROM {orders}
UNION ALL SELECT o_orderkey, 4, CASE o_orderkey % 5 WHEN 0 THEN '    "Tells."' WHEN 3 THEN '"no"' ELSE '    pass' END FROM {orders} UNION ALL SELECT o_orderkey, 6, '    last = 1' FROM {orders}
UNION ALL SELECT o_orderkey, 7, concat('    async def inner', CAST(o_orderkey AS STRING), '(a):') FROM {orders} UNION ALL SELECT o_orderkey, 8, CASE WHEN o_orderkey % 3 = 0 THEN '        r"Tells.' ELSE '        pass' END FROM {orders} UNION ALL SELECT o_orderkey, 10, 'end = 1' FROM {orders}) AS l ON l.k = o_orderkey"""
_ADDED_LINES = "SELECT o_custkey AS change, concat('f', CAST(o_orderkey AS STRING), '.py') AS file, CASE o_orderkey % 4 WHEN 0 THEN 2 WHEN 1 THEN 4 WHEN 2 THEN 8 ELSE 10 END AS line FROM {orders}"


@query(
    "documentation",
    """WITH s AS (SELECT o_custkey AS change, o_orderkey AS k, TRUE AS outer_, o_orderkey % 5 IN (0, 1) AS told, o_orderkey % 4 IN (1, 2) AND NOT (o_orderkey % 5 = 3) AS hit FROM {orders}
UNION ALL SELECT o_custkey, o_orderkey, FALSE, o_orderkey % 3 = 0, o_orderkey % 4 = 2 FROM {orders})
SELECT change, count(*) FILTER (WHERE told) AS documented, count(*) AS total FROM s WHERE hit GROUP BY change""",
)
def documentation(d: Data) -> DataFrame:
    return symbols.documentation(d(_SOURCE), d(_ADDED_LINES), "change", "file").select("change", "documented", "total")


_NOTES = """SELECT c_custkey AS change, CASE WHEN c_nationkey % 2 = 0 THEN 'base' ELSE 'tree' END AS revision, 'A.md' AS path, CASE c_custkey % 4 WHEN 0 THEN ' ' WHEN 1 THEN 'read B.md' ELSE c_name END AS text FROM {customer}
UNION ALL SELECT c_custkey, 'tree', 'A.md', 'late' FROM {customer} WHERE c_custkey % 6 = 0 UNION ALL SELECT c_custkey, 'base', 'B.md', CASE WHEN c_custkey % 3 = 0 THEN 'see C.md' ELSE 'b' END FROM {customer} UNION ALL SELECT c_custkey, 'tree', 'C.md', 'c rules' FROM {customer} WHERE c_custkey % 5 > 0"""


@query(
    "context_files",
    """WITH t AS (SELECT c_custkey AS k, CASE c_custkey % 4 WHEN 0 THEN '' WHEN 1 THEN 'read B.md' ELSE c_name END AS own, CASE WHEN c_custkey % 6 = 0 THEN 'late' ELSE '' END AS late, c_nationkey % 2 = 0 AS base, CASE WHEN c_custkey % 3 = 0 THEN 'see C.md' ELSE 'b' END AS b, CASE WHEN c_custkey % 5 > 0 THEN 'c rules' ELSE '' END AS c FROM {customer}),
a AS (SELECT *, CASE WHEN base THEN CASE WHEN own <> '' THEN own ELSE late END ELSE CASE WHEN late = '' THEN own WHEN own = '' THEN late ELSE least(own, late) END END AS a FROM t),
w AS (SELECT k, CASE WHEN a <> '' THEN 'A.md' ELSE 'B.md' END AS path, CASE WHEN a <> '' THEN CASE WHEN contains(a, 'B.md') THEN a || chr(10) || chr(10) || b ELSE a END ELSE b END AS text, c FROM a)
SELECT k AS change, path, substr(CASE WHEN contains(text, 'C.md') AND c <> '' THEN text || chr(10) || chr(10) || c ELSE text END, 1, 20) AS text FROM w""",
)
def context_files(d: Data) -> DataFrame:
    return files.context_files(d(_NOTES), ["A.md", "B.md", "C.md"], 20)
