"""Queries of text functions, paths, rules, discussions and replies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revlens.functions import paths as P
from revlens.functions import text as X
from revlens.operators import named_by_short, newest_wins, packing, relations
from revlens.plans.inputs import Data, query
from revlens.sources import files, replies, tools


@query(
    "text_cuts",
    r"""SELECT conv_id, turn, CASE WHEN length(text) <= 40 THEN text ELSE regexp_replace(substr(text, 1, 36), '\s+$', '') || ' […]' END AS inside, CASE WHEN length(text) <= 40 THEN text ELSE regexp_replace(substr(text, 1, 40), '\s+$', '') || '…' END AS past,
substr(text, 1, 40) AS hard, length(text) > 40 AS cut, trim(regexp_replace(text, '\s+', ' ', 'g')) AS flat, replace(replace(text, '|', '\|'), chr(10), ' ') AS cell, CAST(floor(length(text) / 4) AS BIGINT) AS tokens FROM {conversations}""",
)
def text_cuts(d: Data) -> DataFrame:
    t, hard = F.col("text"), X.cut_hard(F.col("text"), 40)
    return d.table("conversations").select("conv_id", "turn", X.cut_inside(t, 40).alias("inside"), X.cut_past(t, 40, "…").alias("past"), hard["text"].alias("hard"), hard["cut"].alias("cut"), X.flatten(t).alias("flat"), X.escape_cell(t).alias("cell"), X.tokens(t).alias("tokens"))


_FENCED = "SELECT p_partkey, concat('a ', repeat('`', CAST(p_size % 6 AS INT)), p_name, ' ``x``') AS text, p_size FROM {part}"


@query("fences", f"SELECT p_partkey, repeat('`', greatest(greatest(p_size % 6, 2) + 1, 3)) AS fence FROM ({_FENCED})")
def fences(d: Data) -> DataFrame:
    return d(_FENCED).select("p_partkey", X.fence_for(F.col("text")).alias("fence"))


_BODIES = "SELECT o_orderkey AS k, concat('<!-- x -->', chr(10), '## Closes #1', chr(10), '> refs #2', chr(10), 'Fixes #', CAST(o_custkey AS STRING), ' and ', o_orderpriority, chr(10), '- [ ] box', chr(10), '```', chr(10), 'closes #9', chr(10), '```', chr(10), 'see https://h/p/issues/', CAST(o_custkey % 5 AS STRING), ' resolves: #', CAST(o_custkey AS STRING)) AS body, o_custkey, o_orderpriority FROM {orders}"


@query("issue_refs", f"SELECT k, list_aggregate(list_distinct_in_order, 'string_agg', ',') AS refs FROM (SELECT k, CASE WHEN o_custkey IN (1, 2) THEN NULL END AS none, list_filter([ '1', '2', CAST(o_custkey AS VARCHAR), CAST(o_custkey % 5 AS VARCHAR)], lambda x, i: list_position(['1', '2', CAST(o_custkey AS VARCHAR), CAST(o_custkey % 5 AS VARCHAR)], x) = i) AS list_distinct_in_order FROM ({_BODIES}))")
def issue_refs(d: Data) -> DataFrame:
    return d(_BODIES).select("k", F.array_join(X.issue_references(F.col("body")), ",").alias("refs"))


@query("prose", f"SELECT k, 'Fixes #' || o_custkey || ' and ' || o_orderpriority || ' see https://h/p/issues/' || o_custkey % 5 || ' resolves: #' || o_custkey AS prose FROM ({_BODIES})")
def prose(d: Data) -> DataFrame:
    return d(_BODIES).select("k", X.prose(F.col("body")).alias("prose"))


_TITLES = "SELECT o_orderkey AS k, CASE o_orderkey % 6 WHEN 0 THEN repeat(' ', CAST(o_custkey % 4 AS INT)) WHEN 1 THEN substr(o_orderpriority, 3, 6) WHEN 2 THEN concat('chore(', o_orderpriority, '):    ') WHEN 3 THEN concat('fix: two ', CAST(o_orderkey AS STRING)) WHEN 4 THEN 'wip fix update' ELSE concat('feat: teach ', o_orderpriority, ' to read ', CAST(o_orderkey AS STRING)) END AS title FROM {orders}"


@query("title_checks", f"SELECT k, CASE k % 6 WHEN 0 THEN 'none' WHEN 1 THEN 'short' WHEN 2 THEN 'prefix_only' WHEN 3 THEN 'few_words' WHEN 4 THEN 'placeholder' END AS problem FROM ({_TITLES})")
def title_checks(d: Data) -> DataFrame:
    return d(_TITLES).select("k", X.title_problem(F.col("title")).alias("problem"))


_PATHS = """SELECT p_partkey AS k, CASE p_size % 8 WHEN 0 THEN concat('src/', CAST(p_partkey AS STRING), '/a.PY') WHEN 1 THEN concat('x', CAST(p_partkey AS STRING), '/Dockerfile.prod') WHEN 2 THEN concat('.github/workflows/d', CAST(p_partkey AS STRING), '/ci.yml') WHEN 3 THEN concat('k8s/b', CAST(p_partkey AS STRING), '/deploy.yaml')
WHEN 4 THEN concat('web', CAST(p_partkey AS STRING), '/package-lock.json') WHEN 5 THEN concat('requirements-', CAST(p_partkey AS STRING), '.txt') WHEN 6 THEN concat('docs/', CAST(p_partkey AS STRING), '/readme.md') ELSE concat('tests/t', CAST(p_partkey AS STRING), '/test_x.py') END AS path, p_size FROM {part}"""


@query(
    "path_kinds",
    f"""SELECT k, list_extract(['python', 'dockerfile', 'yaml', 'yaml', 'json', NULL, 'markdown', 'python'], p_size % 8 + 1) AS language, list_extract([NULL, 'container', 'ci_workflow', 'iac', 'dependency_lock', 'dependency_manifest', NULL, NULL], p_size % 8 + 1) AS kind,
list_extract(['implementation', 'implementation', 'schema_config', 'schema_config', 'implementation', 'implementation', 'low_signal', 'test'], p_size % 8 + 1) AS role, list_extract([10, 8, 5, 5, 4, 5, 1, 10], p_size % 8 + 1) AS priority FROM ({_PATHS})""",
)
def path_kinds(d: Data) -> DataFrame:
    p = F.col("path")
    return d(_PATHS).select("k", P.language(p).alias("language"), P.asset_kind(p).alias("kind"), P.role(p, F.lit("")).alias("role"), P.priority(p).alias("priority"))


@query("glob_match", "SELECT page_id, url LIKE 'http%://%.com/en/%' AS english, regexp_matches(url, '^https?://[^/]') AS any_ FROM {pages}")
def glob_match(d: Data) -> DataFrame:
    return d.table("pages").select("page_id", P.matches_any(F.col("url"), ["http*://*.com/en/*"]).alias("english"), P.matches_any(F.col("url"), ["nothing", "**/https://*", "http[!x]*"]).alias("any_"))


@query("change_targets", "SELECT page_id, CASE WHEN page_id % 9 > 0 THEN split_part(url, '/', 3) END AS host, CASE WHEN page_id % 9 > 0 THEN split_part(url, '/', 4) || '/' || source END AS project, CASE WHEN page_id % 9 > 0 THEN page_id END AS number FROM (SELECT *, 'p' || length(html) % 7 AS source FROM {pages})")
def change_targets(d: Data) -> DataFrame:
    """Addresses of changes at the pages' hosts and first folders; every ninth names none."""
    page = F.concat(F.substring_index("url", "/", 4), F.lit("/p"), F.length("html") % 7)
    at = F.concat(page, F.when(F.col("page_id") % 9 == 0, "/tree/").when(F.col("page_id") % 2 == 0, "/-/merge_requests/").otherwise("/pull/"), "page_id", F.lit("/files"))
    return d.table("pages").select("page_id", X.target_of(at).alias("t")).select("page_id", "t.*")


_SAID = "SELECT event_id AS k, concat(' ', CAST(event_id % 130 AS STRING), CASE WHEN event_id % 3 = 0 THEN '%' ELSE '' END) AS share, concat('line ', CAST(event_id AS STRING), ' of 9') AS number, CASE event_id % 3 WHEN 0 THEN 'Execution Path' WHEN 1 THEN 'STATIC-TOOL' ELSE 'guess' END AS label, CASE WHEN event_id % 2 = 0 THEN ' why ' ELSE '' END AS note FROM {events}"


@query(
    "reply_coercions",
    f"""SELECT k, CASE WHEN k % 3 = 0 THEN 0.8 WHEN k % 130 > 1 THEN least((k % 130) / 100, 1.0) ELSE (k % 130)::DOUBLE END AS confidence, k AS number, CASE WHEN k % 3 = 0 AND k % 2 = 0 THEN 'execution_path' ELSE 'unverified' END AS evidence, trim(note) AS note FROM ({_SAID})""",
)
def reply_coercions(d: Data) -> DataFrame:
    proof = X.as_evidence(F.col("label"), F.col("note"), replies.PROVEN, replies.EVIDENCE)
    return d(_SAID).select("k", X.as_confidence(F.col("share")).alias("confidence"), X.as_int(F.col("number")).alias("number"), proof["evidence"].alias("evidence"), proof["note"].alias("note"))


_REPLIES = """SELECT conv_id * 100 + turn AS id, turn, concat('```json', chr(10), '{{"findings": [{{"file": "f', CAST(turn AS STRING), '.py", "start_line": "', CAST(turn AS STRING), '", "severity": "Major", "body": "B. C", "confidence": 87, "evidence_files": ["f0.py", "a", "a", ""]}}, {{"file": "", "body": "x", "start_line": 1}}, 7], "n": 1}}', chr(10), '```') AS reply FROM {conversations}"""


@query("reply_findings", f"SELECT id, 'f' || turn || '.py' AS file, turn AS start_line, 'major' AS severity, 'B' AS title, 0.87::DOUBLE AS confidence, CASE WHEN turn = 0 THEN 'a' ELSE 'f0.py,a' END AS files FROM ({_REPLIES}) WHERE turn >= 1")
def reply_findings(d: Data) -> DataFrame:
    return replies.findings(d(_REPLIES), "id", "reply").select("id", "file", "start_line", "severity", "title", "confidence", F.array_join("evidence_files", ",").alias("files"))


#: Replies to threads: conversations as threads, roles as authors, markers in the text of even turns.
_NOTES = "SELECT conv_id, turn, role, CASE WHEN turn % 2 = 0 THEN concat('Well', chr(10), ' Wontfix: ', role) WHEN turn % 3 = 0 THEN 'falsehood' ELSE concat('False positive ', role) END AS body FROM {conversations}"


@query("dismissals", f"SELECT conv_id, CASE WHEN turn % 2 = 0 THEN 'wontfix' ELSE 'false_positive' END AS verdict, turn FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM ({_NOTES}) WHERE turn % 2 = 0 OR turn % 3 <> 0) WHERE n = 1")
def dismissals(d: Data) -> DataFrame:
    """The latest reply that begins a line with a marker."""
    said = d(_NOTES).withColumn("verdict", X.verdict_in(F.col("body"), {"false positive": "false_positive", "false": "other", "wontfix": "wontfix"})).where("verdict IS NOT NULL")
    return newest_wins(said.select("conv_id", "turn", "verdict"), ["conv_id"], F.col("turn")).select("conv_id", "verdict", "turn")


@query("discussion", "SELECT conv_id, turn, text FROM (SELECT conv_id, turn, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM {conversations} WHERE role <> 'assistant' AND trim(text) <> '') WHERE n <= 2")
def discussion(d: Data) -> DataFrame:
    people = d.table("conversations").where((F.col("role") != "assistant") & (X.strip(F.col("text")) != ""))
    return packing.latest_within(people.select("conv_id", "turn", "text"), "conv_id", "text", 2, 1 << 20, 1 << 24, F.col("turn"))


_RULES = "SELECT n_name AS id, CASE WHEN n_regionkey = 0 THEN 'major' ELSE 'minor' END AS severity, CASE WHEN n_nationkey % 3 = 0 THEN 'python' WHEN n_nationkey % 3 = 1 THEN 'cobol' END AS lang, CASE WHEN n_nationkey % 4 = 0 THEN 'docs/*' WHEN n_nationkey % 4 = 1 THEN 'nowhere/*' END AS pattern, n_nationkey FROM {nation}"


@query("matching_rules", f"SELECT id FROM ({_RULES}) r WHERE EXISTS (SELECT 1 FROM ({_PATHS}) WHERE (lang IS NULL OR (lang = 'python' AND p_size % 8 IN (0, 7))) AND (pattern IS NULL OR (pattern = 'docs/*' AND p_size % 8 = 6)))")
def matching_rules(d: Data) -> DataFrame:
    many = lambda c, use: F.when(F.col(c).isNull(), F.array().cast("array<string>")).otherwise(F.array(use))
    glob = F.when(F.col("pattern") == "docs/*", F.lit(P.glob_regex("docs/*"))).otherwise(F.lit(P.glob_regex("nowhere/*")))
    rules = d(_RULES).select("id", "severity", many("lang", F.col("lang")).alias("languages"), many("pattern", glob).alias("globs"))
    seen = d(_PATHS).select("path").distinct().withColumn("language", P.language(F.col("path")))
    return files.matching_rules(rules, seen).select("id")


@query("applicable_tools", f"SELECT 'by_glob' AS tool, path FROM ({_PATHS}) WHERE p_size % 8 = 6 UNION ALL SELECT 'by_language', path FROM ({_PATHS}) WHERE p_size % 8 IN (2, 3) UNION ALL SELECT 'all', path FROM ({_PATHS})")
def applicable_tools(d: Data) -> DataFrame:
    none = F.array().cast("array<string>")
    row = lambda name, globs, langs, network: F.struct(F.lit(name).alias("tool"), globs.alias("globs"), langs.alias("languages"), F.lit(network).alias("network"), F.lit(False).alias("named"))
    known = d.spark.range(1).select(F.explode(F.array(row("by_glob", F.array(F.lit(P.glob_regex("docs/*"))), F.array(F.lit("python")), False), row("by_language", none, F.array(F.lit("yaml")), False), row("all", none, none, False), row("network", none, none, True))).alias("t")).select("t.*")
    return tools.applicable(known, d(_PATHS).withColumn("language", P.language(F.col("path")))).select("tool", "path")


@query("common_directories", "SELECT user_id, CASE WHEN count(DISTINCT event_type) = 1 THEN 'root/' || user_id || '/' || min(event_type) ELSE 'root/' || user_id END AS dir FROM {events} GROUP BY user_id")
def common_directories(d: Data) -> DataFrame:
    path = F.concat(F.lit("root/"), "user_id", F.lit("/"), "event_type", F.lit("/f.py"))
    return d.table("events").groupBy("user_id").agg(X.common_directory(F.array_sort(F.collect_set(path))).alias("dir"))


@query("latest_links", "SELECT user_id, event_id AS last, first FROM (SELECT user_id, event_id, min(event_id) OVER (PARTITION BY user_id) AS first, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n FROM {events}) WHERE n = 1 ORDER BY first LIMIT 30")
def latest_links(d: Data) -> DataFrame:
    """The last event of each number, in the order in which numbers first appear."""
    events = d.table("events").select(F.lit(0).alias("change"), "user_id", "event_id")
    return relations.linked_changes(events, "change", "user_id", "event_id", most=30).select("user_id", F.col("event_id").alias("last"), "first")


@query("two_way_sets", "SELECT k, bool_or(side = 1) AS in_old, bool_or(side = 2) AS in_new FROM (SELECT c_nationkey AS k, 1 AS side FROM {customer} UNION ALL SELECT s_nationkey, 2 FROM {supplier}) GROUP BY k")
def two_way_sets(d: Data) -> DataFrame:
    return relations.sides(d.table("customer").select(F.col("c_nationkey").alias("k")), d.table("supplier").select(F.col("s_nationkey").alias("k")), "k")


@query("documented_share", "SELECT lang, count(DISTINCT n_chars) AS symbols, count(DISTINCT CASE WHEN source = 'src0' THEN n_chars END) / nullif(count(DISTINCT n_chars), 0) AS ratio FROM {documents} GROUP BY lang")
def documented_share(d: Data) -> DataFrame:
    return relations.documented_share(d.table("documents").select("lang", "n_chars", "source"), "lang", "n_chars", F.col("source") == "src0")


@query("usage", "SELECT sum(length(text)) AS tokens, string_agg(role, ',' ORDER BY first) AS models FROM (SELECT role, min(conv_id * 100 + turn) AS first FROM {conversations} GROUP BY role), (SELECT sum(length(text)) AS x FROM {conversations}) LEFT JOIN (SELECT 0 AS z) ON FALSE GROUP BY x".replace("sum(length(text)) AS tokens", "x::BIGINT AS tokens"))
def usage(d: Data) -> DataFrame:
    """Tokens summed, models in the order in which they first appear."""
    out = relations.usage_total(d.table("conversations"), "role", F.length("text"), F.col("conv_id") * 100 + F.col("turn"))
    return out.withColumn("models", F.array_join("models", ","))


@query("chunks_by_path", "SELECT chunk, string_agg(path, ',' ORDER BY path) AS paths FROM (SELECT user_id % 50 AS path, min(event_id % 20) AS chunk FROM {events} GROUP BY 1) GROUP BY chunk")
def chunks_by_path(d: Data) -> DataFrame:
    ranges = d.table("events").select((F.col("user_id") % 50).alias("path"), (F.col("event_id") % 20).alias("chunk"))
    return relations.paths_by_chunk(ranges, "path", "chunk").withColumn("paths", F.array_join("paths", ","))


@query("report_outputs", "SELECT event_id, CASE WHEN event_type <> 'view' THEN props END AS output FROM {events} WHERE event_type <> 'click'")
def report_outputs(d: Data) -> DataFrame:
    """Output is kept for runs that didn't pass; a run without anything relevant has no row."""
    runs = d.table("events").select("event_id", "event_type", F.col("props").alias("output"))
    return relations.kept_outputs(runs, "event_type", "output", passed="view", nothing="click").select("event_id", "output")


@query("check_views", "SELECT event_type, count(*) FILTER (WHERE value > 50 AND user_id % 2 = 0) AS blocking, count(*) FILTER (WHERE value > 50 AND user_id % 2 <> 0) AS warnings, count(*) FILTER (WHERE value <= 50) AS passed FROM {events} GROUP BY event_type")
def check_views(d: Data) -> DataFrame:
    return relations.outcome_views(d.table("events"), "event_type", F.col("value") > 50, F.col("user_id") % 2 == 0)


@query("prompt_cost", "SELECT conv_id, sum(length(role) + length(text)) + count(*) - 1 AS cost FROM {conversations} GROUP BY conv_id")
def prompt_cost(d: Data) -> DataFrame:
    return relations.joined_cost(d.table("conversations"), "conv_id", F.length("role") + F.length("text"))


@query("ranked_notes", "SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS place FROM {events}")
def ranked_notes(d: Data) -> DataFrame:
    return relations.placed(d.table("events"), "user_id", F.desc("value"), F.col("event_id")).select("event_id", "place")


_UNITS = "SELECT l_orderkey AS path, l_partkey AS part, l_suppkey AS supp FROM {lineitem}"
_FINISHED = "SELECT l_partkey AS part, l_suppkey AS supp FROM {lineitem} WHERE l_quantity > 10"


@query("complete_paths", f"SELECT DISTINCT path FROM ({_UNITS}) u WHERE path NOT IN (SELECT path FROM ({_UNITS}) WHERE (part, supp) NOT IN (SELECT (part, supp) FROM ({_FINISHED})))")
def complete_paths(d: Data) -> DataFrame:
    return relations.complete(d(_UNITS), d(_FINISHED), "path", ["part", "supp"])


#: Line items as what a check found; orders as what a scanner told.
_SPOTTED = "SELECT l_orderkey AS id, l_linenumber AS line, l_returnflag AS told FROM {lineitem}"
_SCANNED = "SELECT o_orderkey AS id, o_orderpriority AS told FROM {orders}"


@query("all_findings", f"SELECT id, line, told FROM ({_SPOTTED}) UNION ALL SELECT id, NULL, told FROM ({_SCANNED})")
def all_findings(d: Data) -> DataFrame:
    return relations.all_findings(d(_SPOTTED), d(_SCANNED))


#: Files of a change for each line item, with and without hunks and texts.
_CHANGED = """SELECT concat(CAST(l_orderkey AS STRING), '/', CAST(l_linenumber AS STRING), '-', CAST(l_partkey AS STRING), CASE l_suppkey % 4 WHEN 0 THEN '.lock' ELSE '.py' END) AS path, CASE l_partkey % 6 WHEN 0 THEN 'deleted' ELSE 'modified' END AS change_type, l_partkey % 5 = 0 AS is_binary, l_suppkey % 3 AS hunks, l_partkey % 7 = 0 AS zero_byte, l_partkey % 11 = 0 AS patch_unavailable,
l_suppkey % 4 = 0 AS locked, l_partkey AS part FROM {lineitem}"""
_STORED = "SELECT DISTINCT concat(CAST(l_orderkey AS STRING), '/', CAST(l_linenumber AS STRING), '-', CAST(l_partkey AS STRING), '.py') AS path, 'x' AS text FROM {lineitem} WHERE l_partkey % 4 > 0"
_TOLD = f"SELECT c.*, CASE WHEN NOT is_binary AND change_type <> 'deleted' THEN s.text END AS text FROM ({_CHANGED}) c LEFT JOIN ({_STORED}) s ON s.path = c.path"


@query(
    "reviewable_files",
    f"""WITH t AS ({_TOLD}), k AS (SELECT path FROM t WHERE NOT is_binary AND NOT locked AND (hunks > 0 OR text IS NOT NULL)) SELECT path, 'kept' AS reason FROM k UNION ALL
SELECT DISTINCT path, CASE WHEN zero_byte THEN 'zero_byte' WHEN patch_unavailable THEN 'patch_unavailable' WHEN is_binary THEN 'binary' WHEN locked THEN 'ignored' ELSE 'empty' END FROM t WHERE path NOT IN (SELECT path FROM k)""",
)
def reviewable_files(d: Data) -> DataFrame:
    """Files that are reviewed, and why the others aren't."""
    all_ = files.attach(d(_CHANGED), d(_STORED))
    kept = files.reviewable(all_, ["**/*.lock"])
    return kept.select("path", F.lit("kept").alias("reason")).unionByName(files.drops(all_, kept, ["**/*.lock"]))


@query(
    "told_rules",
    f"""WITH h AS (SELECT DISTINCT k % 90 AS change, id, severity FROM ({_RULES}) r JOIN ({_PATHS}) p ON (lang IS NULL OR (lang = 'python' AND p_size % 8 IN (0, 7))) AND (pattern IS NULL OR (pattern = 'docs/*' AND p_size % 8 = 6)))
SELECT change, id, row_number() OVER (PARTITION BY change ORDER BY CASE severity WHEN 'major' THEN 0 ELSE 1 END, id) AS place FROM h""",
)
def told_rules(d: Data) -> DataFrame:
    many = lambda c, use: F.when(F.col(c).isNull(), F.array().cast("array<string>")).otherwise(F.array(use))
    glob = F.when(F.col("pattern") == "docs/*", F.lit(P.glob_regex("docs/*"))).otherwise(F.lit(P.glob_regex("nowhere/*")))
    known = d(_RULES).select("id", "severity", many("lang", F.col("lang")).alias("languages"), many("pattern", glob).alias("globs"))
    changed = d(_PATHS).select((F.col("k") % 90).alias("change"), "path", P.language(F.col("path")).alias("language"))
    return files.told_rules(known, changed).withColumn("place", F.col("place").cast("long"))


_SHORT = "SELECT DISTINCT substr(md5(CAST(event_id AS STRING)), 1, CAST(2 + event_id % 6 AS INT)) AS short FROM {events}"
_FULL = "SELECT md5(CAST(o_orderkey AS STRING)) AS sha FROM {orders} UNION ALL SELECT md5(CAST(event_id AS STRING)) FROM {events}"


@query("short_names", f"SELECT short, min(sha) AS sha FROM ({_SHORT}) s JOIN (SELECT DISTINCT sha FROM ({_FULL})) f ON starts_with(sha, short) GROUP BY short HAVING count(*) = 1")
def short_names(d: Data) -> DataFrame:
    return named_by_short(d(_SHORT), d(_FULL), "short", "sha")


_GREP = "SELECT event_id AS k, CASE event_id % 4 WHEN 0 THEN concat('src/a.py:', CAST(event_id AS STRING), ':x: ', event_type) WHEN 1 THEN concat(':', CAST(event_id AS STRING), ':x') WHEN 2 THEN concat('b:x', CAST(event_id AS STRING), ':y') ELSE concat('c d:', CAST(event_id AS STRING), ':') END AS line, CASE event_id % 3 WHEN 0 THEN md5(CAST(event_id AS STRING)) WHEN 1 THEN concat(md5(event_type), '00000000') ELSE '' END AS ref FROM {events}"


@query("grep_hits", f"SELECT k, CASE k % 4 WHEN 0 THEN 'src/a.py' WHEN 3 THEN 'c d' END AS path, CASE WHEN k % 4 IN (0, 3) THEN k END AS at, CASE k % 4 WHEN 0 THEN substr(line, length('src/a.py:' || k || ':') + 1) WHEN 3 THEN '' END AS text, k % 3 = 0 AS moves FROM ({_GREP})")
def grep_hits(d: Data) -> DataFrame:
    hit = X.grep_hit(F.col("line"))
    return d(_GREP).select("k", hit["path"].alias("path"), hit["line"].alias("at"), hit["text"].alias("text"), X.mutable_ref(F.col("ref")).alias("moves"))


_ANSWERS = """SELECT conv_id * 100 + turn AS id, conv_id, turn, concat('{{"evidence": [{{"claim": "', CAST(turn AS STRING), '", "file": "f"}}, {{"claim": " ", "file": "g"}}, {{"claim": "second", "file": "', role, '"}}, {{"claim": "third"}}], "decisions": [{{"candidate": "c9", "disposition": "drop"}}, {{"candidate": "c', CAST(turn AS STRING), '", "disposition": "',
CASE turn % 3 WHEN 0 THEN 'Revise' WHEN 1 THEN 'maybe' ELSE 'confirm' END, '", "rationale": "r"}}, {{"candidate": "c', CAST(turn AS STRING), '", "disposition": "drop"}}]}}') AS reply, role FROM {conversations}"""


@query("reply_evidence", f"SELECT id, turn::VARCHAR AS claim, 'f' AS file FROM ({_ANSWERS}) UNION ALL SELECT id, 'second', role FROM ({_ANSWERS})")
def reply_evidence(d: Data) -> DataFrame:
    return replies.evidence(d(_ANSWERS), "id", "reply", "evidence", ["claim", "file"], ["claim"], most=2).select("id", "claim", "file")


@query("reply_decisions", f"SELECT id, 'c' || turn AS candidate, CASE turn % 3 WHEN 0 THEN 'revise' WHEN 1 THEN 'drop' ELSE 'confirm' END AS disposition FROM ({_ANSWERS}) WHERE conv_id % 2 = 0 AND turn <> 9")
def reply_decisions(d: Data) -> DataFrame:
    """The first decision of a known kind on each candidate that was asked about."""
    asked = d(_ANSWERS).where("conv_id % 2 = 0").select("id", F.concat(F.lit("c"), "turn").alias("candidate"))
    return replies.decisions(d(_ANSWERS), "id", "reply", asked).select("id", "candidate", "disposition")
