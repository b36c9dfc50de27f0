"""Queries of package snapshots, locks, versions and tools' output."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revlens.functions import versions as V
from revlens.operators import graph
from revlens.operators import packages as op
from revlens.plans.inputs import Data, query
from revlens.sources import packages as read
from revlens.sources import tools


def _side(where: str, version: str, source: str, integrity: str, ref: str) -> str:
    return f"SELECT 'npm' AS ecosystem, p_brand AS dir, concat('pkg', CAST(p_partkey AS STRING)) AS name, {version} AS version, {source} AS source, {integrity} AS integrity, p_size % 2 = 0 AS direct, {ref} AS ref FROM {{part}} LEFT JOIN {{supplier}} ON s_suppkey = p_partkey WHERE {where}"


#: Parts that some supplier shares its number with are old; those without, or with a supplier in debt, are new.
_OLD = _side("s_suppkey IS NOT NULL OR p_size > 3", "concat(CAST(p_size % 3 AS STRING), '.', CAST(p_size % 5 AS STRING), '.1')", "CASE WHEN p_size % 7 = 0 THEN 'https://a.example.com' ELSE '' END", "CASE WHEN p_size % 4 = 0 THEN 'sha1' ELSE '' END", "CASE WHEN p_size % 9 = 0 THEN 'main' ELSE '' END")
_NEW = _side("s_suppkey IS NULL OR s_acctbal < 0", "concat(CAST(p_partkey % 3 AS STRING), '.', CAST(p_size % 5 AS STRING), CASE WHEN p_partkey % 2 = 0 THEN '' ELSE '.1' END)", "CASE WHEN p_size % 14 = 0 THEN 'https://b.example.com' WHEN p_size % 7 = 0 THEN 'https://a.example.com' ELSE '' END", "CASE WHEN p_size % 8 = 0 THEN '' WHEN p_size % 4 = 0 AND p_partkey % 3 = 0 THEN 'sha2' WHEN p_size % 4 = 0 THEN 'sha1' ELSE '' END", "CASE WHEN p_size % 9 = 0 THEN CASE WHEN p_partkey % 2 = 0 THEN 'main' ELSE 'dev' END ELSE '' END")
_MOVE = "CASE WHEN coalesce(list_extract(list_filter(list_transform(list_zip({a}, {b}), lambda x: CASE WHEN x[1] IS NULL OR x[2] IS NULL THEN 0 ELSE sign(x[2] - x[1]) END), lambda x: x <> 0), 1), 1) < 0 THEN 'downgraded' ELSE 'upgraded' END"
_PARTS = "list_transform(string_split({v}, '.'), lambda x: CAST(x AS INTEGER))"
_KIND = f"""CASE WHEN o.name IS NULL THEN 'added' WHEN n.name IS NULL THEN 'removed' WHEN o.source <> n.source THEN 'source_changed' WHEN o.integrity <> '' AND n.integrity = '' THEN 'integrity_lost'
WHEN o.integrity <> '' AND o.integrity <> n.integrity THEN 'integrity_changed' WHEN o.ref <> n.ref THEN 'source_changed' WHEN o.version <> n.version THEN {_MOVE.format(a=_PARTS.format(v='o.version'), b=_PARTS.format(v='n.version'))} END"""
_COMPARED = f"SELECT coalesce(o.dir, n.dir) AS dir, coalesce(o.name, n.name) AS name, {_KIND} AS kind, o.version AS old_version, n.version AS new_version, coalesce(o.direct, FALSE) OR coalesce(n.direct, FALSE) AS direct FROM ({_OLD}) o FULL JOIN ({_NEW}) n ON o.dir = n.dir AND o.name = n.name"


@query("package_changes", f"SELECT * FROM ({_COMPARED}) WHERE kind IS NOT NULL")
def package_changes(d: Data) -> DataFrame:
    return op.compare(d(_OLD), d(_NEW)).select("dir", "name", "kind", "old_version", "new_version", "direct")


@query(
    "package_changes_top",
    f"""SELECT dir, name, kind FROM ({_COMPARED}) WHERE kind IS NOT NULL ORDER BY list_position(['source_changed', 'integrity_lost', 'integrity_changed', 'manifest_lock_drift', 'added', 'downgraded', 'removed', 'upgraded'], kind), direct DESC, name, dir LIMIT 40""",
)
def package_changes_top(d: Data) -> DataFrame:
    return op.ranked(op.compare(d(_OLD), d(_NEW)), 40).select("dir", "name", "kind")


_MANIFEST = "SELECT 'npm' AS ecosystem, '' AS dir, concat('pkg', CAST(p_partkey AS STRING)) AS name, concat(CASE p_size % 6 WHEN 0 THEN '^' WHEN 1 THEN '~' WHEN 2 THEN '>=' WHEN 3 THEN '<' WHEN 4 THEN '=' ELSE 'what?' END, CAST(p_size % 3 AS STRING), '.', CAST(p_size % 4 AS STRING), '.', CAST(p_size % 5 AS STRING)) AS version, '' AS source, '' AS integrity, TRUE AS direct, '' AS ref, p_size FROM {part}"
_LOCK = "SELECT 'npm' AS ecosystem, '' AS dir, concat('pkg', CAST(ps AS STRING)) AS name, concat(CAST(ps % 3 AS STRING), '.', CAST(ps % 4 AS STRING), '.', CAST(ps % 7 AS STRING)) AS version, '' AS source, '' AS integrity, ps % 3 = 0 AS direct, '' AS ref, ps FROM (SELECT DISTINCT l_partkey + 5 AS ps FROM {lineitem})"
_LOW, _HAVE = "[p_size % 3, p_size % 4, p_size % 5]", "[ps % 3, ps % 4, ps % 7]"
_CARET = "CASE WHEN p_size % 3 > 0 THEN [p_size % 3 + 1, 0, 0] WHEN p_size % 4 > 0 THEN [0, p_size % 4 + 1, 0] ELSE [0, 0, p_size % 5 + 1] END"
_MEETS = f"CASE p_size % 6 WHEN 0 THEN {_HAVE} >= {_LOW} AND {_HAVE} < {_CARET} WHEN 1 THEN {_HAVE} >= {_LOW} AND {_HAVE} < [p_size % 3, p_size % 4 + 1, 0] WHEN 2 THEN {_HAVE} >= {_LOW} WHEN 3 THEN {_HAVE} < {_LOW} WHEN 4 THEN {_HAVE} = {_LOW} END"


@query(
    "lock_drift",
    f"""SELECT coalesce(m.name, l.name) AS name, CASE WHEN l.name IS NULL THEN 'missing' WHEN m.name IS NULL THEN 'undeclared' ELSE 'unsatisfied' END AS kind FROM ({_MANIFEST}) m FULL JOIN ({_LOCK}) l ON m.name = l.name
WHERE l.name IS NULL OR (m.name IS NULL AND l.direct) OR (m.name IS NOT NULL AND NOT ({_MEETS}))""",
)
def lock_drift(d: Data) -> DataFrame:
    return op.drift(d(_MANIFEST), d(_LOCK)).select("name", "kind")


@query("constraint_check", f"SELECT m.name, {_MEETS} AS meets FROM ({_MANIFEST}) m JOIN ({_LOCK}) l ON m.name = l.name")
def constraint_check(d: Data) -> DataFrame:
    have = d(_LOCK).select("name", F.col("version").alias("have"))
    return d(_MANIFEST).join(have, "name").select("name", V.semver_satisfies(F.col("version"), F.col("have")).alias("meets"))


_VERSIONS = "SELECT l_orderkey AS k, l_linenumber AS n, concat('v', CAST(l_linenumber AS STRING), '.', CAST(l_partkey % 12 AS STRING), '.', CAST(l_suppkey % 3 AS STRING)) AS a, concat(CAST(l_linenumber AS STRING), '.', CAST(l_suppkey % 12 AS STRING)) AS b, l_linenumber AS a1, l_partkey % 12 AS a2, l_suppkey % 12 AS b2 FROM {lineitem}"


@query("version_move", f"SELECT k, a, b, CASE WHEN b2 < a2 THEN 'downgraded' ELSE 'upgraded' END AS move FROM ({_VERSIONS})")
def version_move(d: Data) -> DataFrame:
    return d(_VERSIONS).select("k", "a", "b", V.version_move(F.col("a"), F.col("b")).alias("move"))


_LOCKFILES = "SELECT p_brand AS dir, CASE p_size % 3 WHEN 0 THEN 'uv.lock' WHEN 1 THEN 'poetry.lock' ELSE 'pdm.lock' END AS name, CASE WHEN p_size % 5 = 0 THEN ' ' ELSE p_name END AS text FROM {part}"


@query(
    "lock_counterpart",
    f"""SELECT s_name, list_extract(['poetry.lock', 'uv.lock'], min(list_position(['poetry.lock', 'uv.lock'], name))) AS counterpart FROM (SELECT s_name, concat('Brand#', CAST(s_nationkey % 60 AS STRING)) AS dir FROM supplier) s
LEFT JOIN (SELECT * FROM ({_LOCKFILES}) WHERE trim(text) <> '' AND name IN ('poetry.lock', 'uv.lock')) f ON f.dir = s.dir GROUP BY s_name""",
)
def lock_counterpart(d: Data) -> DataFrame:
    assets = d("SELECT s_name, concat('Brand#', CAST(s_nationkey % 60 AS STRING)) AS dir FROM {supplier}")
    return op.counterpart(assets, d(_LOCKFILES), ["poetry.lock", "uv.lock"]).select("s_name", "counterpart")


_TEXTS = """SELECT concat('d', CAST(p_partkey AS STRING), CASE p_size % 4 WHEN 0 THEN '/package.json' WHEN 1 THEN '/requirements.txt' WHEN 2 THEN '/go.sum' ELSE '/uv.lock' END) AS path,
CASE p_size % 4 WHEN 0 THEN concat('{{"dependencies": {{"a-', p_brand, '": "^1.', CAST(p_size AS STRING), '"}}, "devDependencies": {{"b": "git+https://x.example.com/b.git#main"}}}}')
WHEN 1 THEN concat('# none', chr(10), 'Foo.Bar>=1.', CAST(p_size AS STRING), ' # why', chr(10), '-r other.txt', chr(10), 'baz')
WHEN 2 THEN concat('m/x v1.', CAST(p_size AS STRING), '.0/go.mod h1:a', chr(10), 'm/x v1.', CAST(p_size AS STRING), '.0 h1:b', chr(10))
ELSE concat('[[package]]', chr(10), 'name = "A_b"', chr(10), 'version = "', CAST(p_size AS STRING), '"', chr(10)) END AS text, p_size AS k, p_brand AS brand, p_partkey AS id FROM {part}"""


@query(
    "package_files",
    f"""SELECT path AS file, name, version, source, integrity, direct, ref FROM (
SELECT path, 'a-' || brand AS name, '^1.' || k AS version, '' AS source, '' AS integrity, TRUE AS direct, '' AS ref FROM ({_TEXTS}) WHERE k % 4 = 0
UNION ALL SELECT path, 'b', 'git+https://x.example.com/b.git#main', 'git+https://x.example.com/b.git#main', '', TRUE, 'main' FROM ({_TEXTS}) WHERE k % 4 = 0
UNION ALL SELECT path, 'foo-bar', '>=1.' || k, '', '', TRUE, '' FROM ({_TEXTS}) WHERE k % 4 = 1
UNION ALL SELECT path, 'baz', '', '', '', TRUE, '' FROM ({_TEXTS}) WHERE k % 4 = 1
UNION ALL SELECT path, 'm/x', 'v1.' || k || '.0', '', 'h1:b', FALSE, '' FROM ({_TEXTS}) WHERE k % 4 = 2
UNION ALL SELECT path, 'a-b', CAST(k AS VARCHAR), '', '', FALSE, '' FROM ({_TEXTS}) WHERE k % 4 = 3)""",
)
def package_files(d: Data) -> DataFrame:
    files = d(_TEXTS).withColumn("file", F.col("path"))
    return read.snapshot(files, keep=["file"]).select("file", "name", "version", "source", "integrity", "direct", "ref")


_RUNS = """SELECT CASE event_id % 3 WHEN 0 THEN 'ruff' WHEN 1 THEN 'mypy' ELSE 'eslint' END AS tool, CASE event_id % 3
WHEN 0 THEN concat('[{{"code":"', CASE WHEN event_type = 'error' THEN 'F821' ELSE 'PERF1' END, '","name":"n","filename":"f', CAST(event_id AS STRING), '","location":{{"row":', CAST(event_id % 50 AS STRING), '}},"message":"m"}}]')
WHEN 1 THEN concat('noise', chr(10), '{{"file":"f', CAST(event_id AS STRING), '","line":', CAST(event_id % 50 AS STRING), ',"code":"c","severity":"', CASE WHEN event_type = 'view' THEN 'note' ELSE 'error' END, '","message":"m"}}', chr(10), '{{broken')
ELSE concat('[{{"filePath":"f', CAST(event_id AS STRING), '","messages":[{{"ruleId":"no-unused-x","severity":2,"line":', CAST(event_id % 50 AS STRING), ',"message":"m"}}]}}]') END AS stdout, event_id, event_type FROM {events}"""


@query(
    "tool_findings",
    f"""SELECT 'f' || event_id AS file, event_id % 50 AS start_line, CASE event_id % 3 WHEN 0 THEN CASE WHEN event_type = 'error' THEN 'critical' ELSE 'minor' END WHEN 1 THEN 'major' ELSE 'info' END AS severity,
CASE event_id % 3 WHEN 0 THEN CASE WHEN event_type = 'error' THEN 'bug' ELSE 'performance' END WHEN 1 THEN 'bug' ELSE 'style' END AS category,
CASE event_id % 3 WHEN 0 THEN CASE WHEN event_type = 'error' THEN 'ruff/F821' ELSE 'ruff/PERF1' END WHEN 1 THEN 'mypy/c' ELSE 'eslint/no-unused-x' END AS rule_id FROM ({_RUNS})
WHERE event_id % 50 > 0 AND NOT (event_id % 3 = 1 AND event_type = 'view')""",
)
def tool_findings(d: Data) -> DataFrame:
    return tools.findings(d(_RUNS).select("tool", "stdout")).select("file", "start_line", "severity", "category", "rule_id")


#: The same runs, of which some gave nothing, and a scanner's whose findings are reported whole.
_ALL_RUNS = f"SELECT tool, CASE WHEN event_id % 4 > 0 THEN stdout END AS stdout, 'timed out' AS reason, event_id FROM ({_RUNS}) UNION ALL SELECT 'osv-scanner', concat('{{{{\"results\":[{{{{\"source\":{{{{\"path\":\"l', CAST(s_suppkey AS STRING), '\"}}}},\"packages\":[{{{{\"package\":{{{{\"name\":\"p\",\"version\":\"1\"}}}},\"vulnerabilities\":[{{{{\"id\":\"V', CAST(s_suppkey AS STRING), '\",\"summary\":\"s\"}}}}]}}}}]}}}}]}}}}'), NULL, s_suppkey FROM {{supplier}}"
_TOUCHED = "SELECT concat('f', CAST(o_orderkey AS STRING)) AS file, CAST(o_custkey % 50 AS BIGINT) AS line FROM {orders}"


@query(
    "routed_findings",
    f"""SELECT 'inline' AS part, 'f' || event_id AS file, event_id % 50 AS line, tool AS told FROM ({_ALL_RUNS}) r WHERE tool <> 'osv-scanner' AND stdout IS NOT NULL AND event_id % 50 > 0 AND NOT (tool = 'mypy' AND stdout LIKE '%"note"%') AND EXISTS (SELECT 1 FROM ({_TOUCHED}) t WHERE t.file = 'f' || r.event_id AND t.line = r.event_id % 50)
UNION ALL SELECT 'reported', 'l' || s_suppkey, 1, 'osv-scanner/V' || s_suppkey FROM {{supplier}} UNION ALL SELECT DISTINCT 'unavailable', NULL, NULL, tool FROM ({_ALL_RUNS}) WHERE stdout IS NULL""",
)
def routed_findings(d: Data) -> DataFrame:
    inline, reported, missing = tools.routed(d(_ALL_RUNS).select("tool", "stdout", "reason"), d(_TOUCHED))
    row = lambda df, part, told: df.select(F.lit(part).alias("part"), "file", F.col("start_line").alias("line"), told.alias("told"))
    out = row(inline, "inline", F.col("tool")).unionByName(row(reported, "reported", F.concat(F.lit("osv-scanner/"), F.regexp_extract("rule_id", r"([^/]*)\z", 1))))
    return out.unionByName(missing.select(F.lit("unavailable").alias("part"), F.lit(None).cast("string").alias("file"), F.lit(None).cast("long").alias("line"), F.col("tool").alias("told")))


_CODES = "SELECT l_orderkey AS k, l_linenumber AS n, concat(CASE l_linenumber % 5 WHEN 0 THEN 'F8' WHEN 1 THEN 'PERF' WHEN 2 THEN 'E' WHEN 3 THEN 'SIM' ELSE 'QQ' END, CAST(l_partkey % 30 AS STRING)) AS code, l_partkey % 30 AS p FROM {lineitem}"


@query(
    "longest_prefix",
    f"""SELECT k, code, category, severity FROM (SELECT k, code, CASE n % 5 WHEN 0 THEN 'bug' WHEN 1 THEN 'performance' WHEN 2 THEN CASE WHEN code LIKE 'E9%' THEN 'bug' ELSE 'style' END ELSE 'maintainability' END AS category,
CASE n % 5 WHEN 0 THEN CASE WHEN code LIKE 'F82%' THEN 'critical' ELSE 'minor' END WHEN 2 THEN CASE WHEN code LIKE 'E9%' THEN 'critical' ELSE 'info' END ELSE 'minor' END AS severity FROM ({_CODES}))""",
)
def longest_prefix(d: Data) -> DataFrame:
    return graph.longest_prefix(d(_CODES).select("k", "code"), "code", tools.RUFF, ("maintainability", "minor"))
