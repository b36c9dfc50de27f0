"""Queries of published comments, checks before a merge, and the bounded lists of a report."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revlens.operators import checks, comments, summary
from revlens.plans.inputs import FINDINGS, RANK, Data, query

MARK = "lens"
#: Every turn of a conversation is a comment of its thread; roots carry identities, some replies a verdict.
_COMMENTS = """SELECT conv_id % 40 AS change, CASE conv_id % 3 WHEN 0 THEN 'line' WHEN 1 THEN 'review' ELSE 'note' END AS surface, CASE WHEN conv_id % 5 > 0 THEN CAST(conv_id AS STRING) END AS thread, conv_id AS ordinal, CAST(turn AS BIGINT) AS nth,
conv_id * 1000 + turn AS id, CASE WHEN turn = 0 AND conv_id % 7 < 5 THEN 'Lens-Bot' WHEN turn % 5 = 4 THEN 'lens-bot' ELSE concat('u', CAST(conv_id % 9 AS STRING)) END AS author, turn = 3 OR (turn = 0 AND conv_id % 7 = 5) AS is_bot,
concat(CASE WHEN turn = 0 AND conv_id % 4 < 3 THEN concat('**Title ', CAST(conv_id AS STRING), '..**', chr(10), '<!-- lens:v1:', substr(md5(CAST(conv_id % 60 AS STRING)), 1, 16), ' --><!-- lens:v2:', substr(md5(CAST(conv_id AS STRING)), 1, 16), ' -->') ELSE '' END,
CASE WHEN turn = 0 AND conv_id % 6 = 2 THEN '<!-- lens:summary --><!-- lens:flow:abc123 -->' ELSE '' END, CASE WHEN turn = 1 AND conv_id % 3 < 2 THEN concat('  Won''t fix this', chr(10)) WHEN turn = 2 AND conv_id % 4 = 1 THEN concat('ok', chr(10), 'false positive: no') ELSE '' END,
CASE WHEN turn = 2 AND conv_id % 8 = 3 THEN '<!-- lens:resolution -->' ELSE '' END, CASE WHEN turn % 4 = 1 AND conv_id % 11 = 0 THEN '   ' ELSE substr(text, 1, 20) END) AS body,
CASE WHEN conv_id % 10 < 8 THEN concat('src/m', CAST(conv_id % 30 AS STRING), '.py') ELSE '' END AS path, CAST(conv_id % 50 AS BIGINT) AS line, CASE WHEN conv_id % 13 > 0 THEN concat('2024-01-', CAST(10 + (conv_id + turn) % 19 AS STRING), 'T00:00:00Z') END AS created_at,
CASE WHEN conv_id % 6 < 4 THEN concat('h', CAST(conv_id % 40 % 3 AS STRING)) WHEN conv_id % 6 = 4 THEN 'old' END AS head_sha, conv_id % 3 = 0 AND turn % 6 < 5 AS positioned, turn = 5 AS system, CASE WHEN conv_id % 17 = 0 THEN 'pending' ELSE 'COMMENTED' END AS state,
turn = 1 AS resolvable, conv_id % 9 = 0 AS resolved, conv_id % 14 = 0 AS thread_resolved FROM {conversations}"""
_HEADS = "SELECT DISTINCT conv_id % 40 AS change, CASE WHEN conv_id % 40 < 30 THEN concat('h', CAST(conv_id % 40 % 3 AS STRING)) ELSE '' END AS head, conv_id % 40 % 4 > 0 AS readable FROM {conversations}"
_VIEWERS = "SELECT DISTINCT conv_id % 40 AS change, CASE WHEN conv_id % 40 % 5 > 0 THEN 'LENS-bot' ELSE '' END AS viewer FROM {conversations}"
_WHITE = r"[\s\x1C-\x1F\x{{85}}\x{{A0}}\x{{3000}}]"
_MINE = "CASE WHEN viewer <> '' THEN lower(author) = lower(viewer) ELSE is_bot END"
_CLOSED = "SELECT change, thread FROM c WHERE thread IS NOT NULL GROUP BY change, thread HAVING bool_or(thread_resolved OR (resolvable AND resolved))"


@query(
    "discussion_kept",
    f"""WITH c AS ({_COMMENTS}), h AS ({_HEADS}) SELECT id, regexp_replace(regexp_replace(body, '^{_WHITE}+', ''), '{_WHITE}+$', '') AS body FROM c JOIN h USING (change) WHERE NOT system AND NOT is_bot AND regexp_replace(body, '{_WHITE}+', '', 'g') <> '' AND NOT contains(body, '<!-- lens:') AND state <> 'pending'
AND NOT (surface = 'line' AND NOT positioned) AND (thread IS NULL OR (change, thread) NOT IN ({_CLOSED.replace('change, thread FROM', '(change, thread) FROM')})) AND NOT (positioned AND head <> '' AND coalesce(head_sha, '') NOT IN ('', head))""",
)
def discussion_kept(d: Data) -> DataFrame:
    return comments.discussion(d(_COMMENTS), d(_HEADS), MARK).select("id", "body")


@query("published_identities", f"WITH c AS ({_COMMENTS}) SELECT DISTINCT change, unnest(regexp_extract_all(body, '<!-- lens:v[12]:([0-9a-f]+) -->', 1)) AS fingerprint FROM c")
def published_identities(d: Data) -> DataFrame:
    return comments.published(d(_COMMENTS), MARK)


@query(
    "newest_summary",
    f"""WITH c AS ({_COMMENTS}), v AS ({_VIEWERS}), s AS (SELECT *, row_number() OVER (PARTITION BY change ORDER BY coalesce(created_at, '') DESC, ordinal DESC, nth DESC) AS n FROM c JOIN v USING (change) WHERE contains(body, '<!-- lens:summary -->') AND surface <> 'line' AND {_MINE})
SELECT change, id, surface, 'abc123' AS flow, CAST(NULL AS VARCHAR) AS carried FROM s WHERE n = 1""",
)
def newest_summary(d: Data) -> DataFrame:
    return comments.newest_summary(d(_COMMENTS), d(_VIEWERS), MARK)


_ROOTS = f"SELECT *, regexp_extract_all(body, '<!-- lens:v[12]:([0-9a-f]+) -->', 1) AS prints FROM c JOIN v USING (change) WHERE nth = 0 AND thread IS NOT NULL AND contains(body, '<!-- lens:v1:') AND {_MINE}"


@query(
    "open_threads",
    f"""WITH c AS ({_COMMENTS}), v AS ({_VIEWERS}), r AS ({_ROOTS}), o AS (SELECT *, row_number() OVER (PARTITION BY change ORDER BY ordinal) AS place FROM r WHERE path <> '' AND (change, thread) NOT IN ({_CLOSED.replace('change, thread FROM', '(change, thread) FROM')}))
SELECT change, thread, CASE WHEN prints[1] = prints[2] THEN prints[1] ELSE array_to_string(prints, ',') END AS fingerprints, path, line, coalesce(head_sha, '') AS anchor_sha, (change, thread) IN (SELECT (change, thread) FROM c WHERE contains(body, '<!-- lens:resolution')) AS replied FROM o WHERE place <= 3""",
)
def open_threads(d: Data) -> DataFrame:
    return comments.open_threads(d(_COMMENTS), d(_VIEWERS), MARK, 3).select("change", "thread", F.array_join("fingerprints", ",").alias("fingerprints"), "path", "line", "anchor_sha", "replied")


@query(
    "thread_answers",
    f"""WITH c AS ({_COMMENTS}), v AS ({_VIEWERS}), r AS ({_ROOTS}), a AS (SELECT c.change, c.thread, r.ordinal, r.path, regexp_extract(r.body, '^\\*\\*(.+?)\\.*\\*\\*', 1) AS title, c.author, coalesce(c.created_at, '') AS told, c.nth, CASE WHEN c.nth = 1 THEN 'wontfix' ELSE 'false_positive' END AS verdict
FROM c JOIN r ON r.change = c.change AND r.thread = c.thread WHERE (c.nth = 1 AND c.ordinal % 3 < 2 OR c.nth = 2 AND c.ordinal % 4 = 1) AND NOT c.is_bot AND NOT CASE WHEN viewer <> '' THEN lower(c.author) = lower(viewer) ELSE c.is_bot END),
l AS (SELECT *, row_number() OVER (PARTITION BY change, thread ORDER BY told DESC, nth DESC) AS back FROM a), p AS (SELECT *, row_number() OVER (PARTITION BY change ORDER BY ordinal) AS place FROM l WHERE back = 1)
SELECT change, thread, verdict, author, path, title, told AS recorded_at FROM p WHERE place <= 4""",
)
def thread_answers(d: Data) -> DataFrame:
    out = comments.answers(d(_COMMENTS), d(_VIEWERS), MARK, {"false positive": "false_positive", "won't fix": "wontfix"}, 4)
    return out.select("change", "thread", "verdict", "author", "path", "title", "recorded_at")


_OPEN = "SELECT conv_id % 40 AS change, CAST(conv_id AS STRING) AS thread, conv_id AS ordinal FROM {conversations} WHERE turn = 0"
_SHA = "concat(md5(CAST(event_id AS STRING)), '00000000')"
_HISTORY = f"SELECT conv_id % 40 AS change, CAST(conv_id AS STRING) AS thread, {{shas}} AS shas FROM {{{{conversations}}}} LEFT JOIN (SELECT user_id, event_id, {_SHA} AS sha FROM {{{{events}}}}) e ON e.user_id = conv_id WHERE turn = 0 GROUP BY conv_id"
_VERDICTS = f"SELECT conv_id % 40 AS change, CAST(conv_id AS STRING) AS thread, event_id AS pos, CASE event_id % 4 WHEN 0 THEN 'Fixed' WHEN 1 THEN 'not_fixed' WHEN 2 THEN 'gone' ELSE 'fixed' END AS state, {{one}} AS commits, CASE WHEN event_id % 3 > 0 THEN 'done' ELSE ' ' END AS summary FROM {{{{conversations}}}} JOIN (SELECT user_id, event_id, {_SHA} AS sha FROM {{{{events}}}}) e ON e.user_id = conv_id OR e.user_id = conv_id + 1 WHERE turn = 0 AND event_id % 5 < 3"
#: The same rows for Spark, where a join on either of two equalities would compare all pairs: a thread stands once for each of its two users.
_SAID = _VERDICTS.replace("FROM {{conversations}} JOIN", "FROM (SELECT conv_id, turn, explode(array(conv_id, conv_id + 1)) AS who FROM {{conversations}}) JOIN").replace("e.user_id = conv_id OR e.user_id = conv_id + 1", "e.user_id = who")


@query(
    "threads_retired",
    f"""WITH t AS ({_OPEN}), hi AS ({_HISTORY.format(shas='list(sha) FILTER (WHERE sha IS NOT NULL)')}), he AS ({_HEADS}), ve AS ({_VERDICTS.format(one="substr(sha, 1, CASE WHEN event_id % 7 = 0 THEN 6 ELSE 9 END)")}),
j AS (SELECT *, row_number() OVER (PARTITION BY change ORDER BY ordinal) AS place FROM t JOIN hi USING (change, thread) JOIN he USING (change) WHERE len(shas) > 0 AND readable AND head <> ''),
f AS (SELECT *, row_number() OVER (PARTITION BY change, thread ORDER BY pos) AS n FROM ve WHERE lower(state) IN ('fixed', 'not_fixed')),
m AS (SELECT j.change, j.thread, lower(f.state) AS state, list_filter(shas, lambda s: starts_with(s, commits) AND length(commits) >= 7) AS found, summary FROM j JOIN f ON f.change = j.change AND f.thread = j.thread AND f.n = 1 WHERE place <= 2)
SELECT t.change, t.thread, coalesce(state, 'inconclusive') AS state, coalesce(array_to_string(found, ','), '') AS commits, coalesce(state = 'fixed' AND len(found) = 1 AND summary <> ' ', FALSE) AS attributable FROM t LEFT JOIN m USING (change, thread)""",
)
def threads_retired(d: Data) -> DataFrame:
    history = d(_HISTORY.format(shas="collect_list(sha)").replace("{{", "{").replace("}}", "}"))
    verdicts = d(_SAID.format(one="array(substr(sha, 1, CASE WHEN event_id % 7 = 0 THEN 6 ELSE 9 END))").replace("{{", "{").replace("}}", "}"))
    out = comments.retired(d(_OPEN), history, verdicts, d(_HEADS), 2)
    return out.withColumn("commits", F.array_join("commits", ","))


#: A change for each document: its first words are the title, its text the description, with or without a link.
_CHANGES = """SELECT doc_id AS change, CASE WHEN doc_id % 9 = 0 THEN 'local' ELSE 'forge' END AS origin, CASE doc_id % 4 WHEN 0 THEN substr(source, 1, 8) WHEN 1 THEN concat('fix(', source, '): ') WHEN 2 THEN concat('feat!: teach ', source, ' to read ', lang) ELSE 'two words-only' END AS title,
CASE doc_id % 5 WHEN 0 THEN '' WHEN 1 THEN concat('# Head', chr(10), '> quoted', chr(10), '- [ ] todo') WHEN 2 THEN concat('a <!-- ', replace(substr(text, 1, 200), '-', ''), ' --> b, fixes: #', CAST(doc_id AS STRING)) ELSE concat('Told at length: ', regexp_replace(lower(lang), '[^a-z]', ''), ' and on and on until it is enough', chr(10), 'see #1') END AS description,
CASE WHEN doc_id % 11 = 0 THEN 'x#1' END AS issue FROM {documents}"""
_COVERAGE = "SELECT doc_id AS change, CAST(n_chars % 7 AS BIGINT) AS documented, CAST(CASE WHEN n_chars % 6 = 0 THEN 0 ELSE 6 END AS BIGINT) AS total FROM {documents} WHERE doc_id % 3 > 0"
_LEVELS = {"title": "error", "description": "warning", "linked_issue": "warning", "docstring_coverage": "error"}
_RESULTS = f"""SELECT change, 'title' AS "check", 'error' AS level, CASE WHEN change % 9 = 0 THEN 'not_applicable' WHEN change % 4 >= 2 THEN 'passed' ELSE 'failed' END AS outcome, CASE WHEN change % 9 = 0 THEN NULL WHEN change % 4 = 0 THEN 'short' WHEN change % 4 = 1 THEN CASE WHEN length(trim(title)) < 10 THEN 'short' ELSE 'prefix_only' END END AS reason, NULL::DOUBLE AS measured, NULL::DOUBLE AS threshold FROM ch
UNION ALL SELECT change, 'description', 'warning', CASE WHEN change % 9 = 0 THEN 'not_applicable' WHEN change % 5 < 3 THEN 'failed' ELSE 'passed' END, CASE WHEN change % 9 = 0 THEN NULL WHEN change % 5 = 0 THEN 'none' WHEN change % 5 = 1 THEN 'template' WHEN change % 5 = 2 THEN 'short' END, NULL, NULL FROM ch
UNION ALL SELECT change, 'linked_issue', 'warning', CASE WHEN issue IS NOT NULL THEN 'passed' WHEN change % 9 = 0 THEN 'not_applicable' WHEN change % 5 = 2 THEN 'passed' ELSE 'failed' END, CASE WHEN issue IS NULL AND change % 9 > 0 AND change % 5 <> 2 THEN 'none' END, NULL, NULL FROM ch
UNION ALL SELECT ch.change, 'docstring_coverage', 'error', CASE WHEN coalesce(total, 0) = 0 THEN 'not_applicable' WHEN documented / total >= 0.8 THEN 'passed' ELSE 'failed' END, CASE WHEN total > 0 AND documented / total < 0.8 THEN 'low' END, CASE WHEN total > 0 THEN documented / total END, 0.8 FROM ch LEFT JOIN ({_COVERAGE}) co ON co.change = ch.change"""



@query("premerge_checks", f'WITH ch AS ({_CHANGES}) SELECT change, "check", level, outcome, reason, round(measured, 6) AS measured, threshold FROM ({_RESULTS})')
def premerge_checks(d: Data) -> DataFrame:
    out = checks.check_results(d(_CHANGES), d(_COVERAGE), _LEVELS)
    return out.select("change", "check", "level", "outcome", "reason", F.round("measured", 6).alias("measured"), "threshold")


_OVERVIEWS = "SELECT doc_id AS change, CASE WHEN doc_id % 8 = 1 THEN ' ' ELSE 'told' END AS overview FROM {documents} WHERE doc_id % 10 > 0"
_OPINIONS = "SELECT doc_id AS change, 'title' AS `check`, n_chars % 3 = 0 AS good, CASE WHEN n_chars % 2 = 0 THEN 'vague' ELSE ' ' END AS note FROM {documents} WHERE n_chars % 5 > 0 UNION ALL SELECT doc_id, 'description', n_chars % 2 = 0, NULL FROM {documents} WHERE n_chars % 7 > 0"


@query(
    "premerge_opinion",
    f"""WITH ch AS ({_CHANGES}), r AS ({_RESULTS}), asked AS (SELECT * FROM r WHERE "check" <> 'docstring_coverage' AND outcome = 'passed'), ov AS (SELECT change FROM ({_OVERVIEWS}) WHERE trim(overview) <> ''), op AS ({_OPINIONS.replace('`', '"')}),
live AS (SELECT a.change, a."check", good, note FROM asked a JOIN ov USING (change) JOIN op ON op.change = a.change AND op."check" = a."check"),
done AS (SELECT r.change, r.level, CASE WHEN NOT good THEN 'failed' ELSE r.outcome END AS outcome, coalesce(NOT good, FALSE) AS advisory, CASE WHEN NOT good THEN CASE WHEN trim(note) <> '' THEN note ELSE 'The model judged the ' || r."check" || ' inadequate.' END END AS said FROM r LEFT JOIN live ON live.change = r.change AND live."check" = r."check")
SELECT change, count(*) FILTER (WHERE outcome = 'passed') AS passed, count(*) FILTER (WHERE outcome = 'failed') AS failed, count(*) FILTER (WHERE outcome = 'not_applicable') AS not_applicable, count(*) FILTER (WHERE outcome = 'failed' AND level = 'error' AND NOT advisory) AS blocking, count(*) FILTER (WHERE advisory) AS advisory,
max(said) AS said, max(CASE WHEN change NOT IN (SELECT change FROM asked) THEN NULL WHEN change NOT IN (SELECT change FROM ov) THEN 'no overview' WHEN change NOT IN (SELECT change FROM op) THEN 'no usable opinion' END) AS note FROM done GROUP BY change""",
)
def premerge_opinion(d: Data) -> DataFrame:
    results = checks.check_results(d(_CHANGES), d(_COVERAGE), _LEVELS)
    out, notes = checks.with_opinion(results, d(_OVERVIEWS), d(_OPINIONS))
    said = out.groupBy("change").agg(F.max(F.when(F.col("advisory"), F.col("reason"))).alias("said"))
    return checks.views(out).join(said, "change").join(notes, "change", "left")


_ROLES = "SELECT o_custkey AS id, concat('p', CAST(o_orderkey AS STRING)) AS path, CASE o_orderkey % 5 WHEN 0 THEN 'contract' WHEN 1 THEN 'schema_config' WHEN 2 THEN 'test' ELSE 'implementation' END AS role, o_orderstatus = 'F' AS reviewed, CASE WHEN o_orderkey % 3 > 0 THEN o_orderkey % 90 END AS first_added FROM {orders}"


@query("omitted_roles", f"SELECT id, role, count(*) AS files FROM ({_ROLES}) WHERE NOT reviewed GROUP BY id, role")
def omitted_roles(d: Data) -> DataFrame:
    return summary.omitted_roles(d(_ROLES), "id")


_TRACED = "SELECT o_custkey AS id, l_orderkey * 1000000000 + l_partkey * 1000 + l_suppkey % 1000 AS pos, concat('p', CAST(l_orderkey AS STRING)) AS path, concat('n', CAST(l_partkey % 3 AS STRING)) AS name, CASE l_partkey % 2 WHEN 0 THEN 'symbol' ELSE 'route' END AS kind, l_suppkey AS line FROM {lineitem} JOIN {orders} ON o_orderkey = l_orderkey WHERE l_quantity < 20"


@query(
    "contract_contexts",
    f"""WITH f AS ({_ROLES}), b AS (SELECT * FROM f WHERE role IN ('contract', 'schema_config')), t AS (SELECT n.id, n.path, n.name, min((pos, kind, line)) AS spot FROM ({_TRACED}) n JOIN b ON b.id = n.id AND b.path = n.path GROUP BY n.id, n.path, n.name),
e AS (SELECT id, 0 AS part, spot[1] AS pos, path, name, spot[2] AS kind, spot[3] AS line FROM t UNION ALL SELECT id, 1, 0, path, path, CASE role WHEN 'contract' THEN 'export' ELSE 'config_key' END, coalesce(first_added, 1) FROM b WHERE (id, path) NOT IN (SELECT (id, path) FROM t))
SELECT * FROM (SELECT id, row_number() OVER (PARTITION BY id ORDER BY part, pos, path) AS place, path, name, kind, line::BIGINT AS line FROM e) WHERE place <= 4""",
)
def contract_contexts(d: Data) -> DataFrame:
    return summary.contract_contexts(d(_ROLES), d(_TRACED), "id", 4).withColumn("place", F.col("place").cast("long"))


_TOUCHED = "SELECT l_orderkey AS id, CAST(l_linenumber AS BIGINT) * 1000000000 + l_partkey * 1000 + l_suppkey % 1000 AS pos, CASE l_partkey % 9 WHEN 0 THEN 'a/package.json' WHEN 1 THEN 'uv.lock' WHEN 2 THEN 'Dockerfile' WHEN 3 THEN 'x/Pipfile.lock' WHEN 4 THEN 'y/Pipfile.lock' WHEN 5 THEN 'main.tf' WHEN 6 THEN '.npmrc' ELSE concat('src/', CAST(l_suppkey AS STRING), '.py') END AS path, l_quantity > 45 AS is_binary FROM {lineitem}"
_KIND = "CASE path WHEN 'a/package.json' THEN 'dependency_manifest' WHEN 'uv.lock' THEN 'dependency_lock' WHEN 'Dockerfile' THEN 'container' WHEN 'main.tf' THEN 'iac' WHEN '.npmrc' THEN 'package_manager_config' END"


@query(
    "listed_assets",
    f"""WITH t AS (SELECT *, {_KIND} AS kind FROM ({_TOUCHED}) WHERE NOT is_binary), a AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY pos) AS nth, count(*) OVER (PARTITION BY id) > 2 AS truncated FROM t WHERE kind IS NOT NULL)
SELECT id, pos, path, kind, truncated FROM a WHERE nth <= 2 UNION ALL SELECT id, min(pos), arg_min(path, pos), 'unread', NULL FROM t WHERE path LIKE '%Pipfile.lock' GROUP BY id""",
)
def listed_assets(d: Data) -> DataFrame:
    first, unread = summary.listed_assets(d(_TOUCHED), "id", 2)
    return first.select("id", "pos", "path", "kind", "truncated").unionByName(unread.select("id", "pos", "path", F.lit("unread").alias("kind"), F.lit(None).cast("boolean").alias("truncated")))


_USED = "SELECT o_custkey AS id, CASE WHEN o_orderkey % 3 > 0 THEN {array} END AS consumers FROM {{orders}}"
_RUN = "SELECT user_id AS id, CASE event_type WHEN 'error' THEN 'executed' ELSE 'refused' END AS outcome FROM {events}"


@query(
    "report_facts",
    f"""WITH a AS (SELECT id, {_KIND} AS kind FROM ({_TOUCHED}) WHERE {_KIND} IS NOT NULL), u AS ({_USED.format(array="['a', CAST(o_orderkey AS VARCHAR)]")}), r AS ({_RUN}), i AS (SELECT id FROM a UNION SELECT id FROM u UNION SELECT id FROM r)
SELECT i.id, coalesce((SELECT string_agg(DISTINCT kind, ',' ORDER BY kind) FROM a WHERE a.id = i.id), '') AS kinds, EXISTS (SELECT 1 FROM a WHERE a.id = i.id AND kind LIKE 'dependency%') AS has_dependencies, coalesce((SELECT sum(coalesce(len(consumers), 0)) FROM u WHERE u.id = i.id), 0)::BIGINT AS consumers,
EXISTS (SELECT 1 FROM r WHERE r.id = i.id AND outcome = 'executed') AS executed FROM i""",
)
def report_facts(d: Data) -> DataFrame:
    assets = d(f"SELECT id, {_KIND} AS kind FROM ({_TOUCHED})").where("kind IS NOT NULL")
    used = d(_USED.format(array="array('a', CAST(o_orderkey AS STRING))").replace("{{", "{").replace("}}", "}"))
    return summary.report_facts(assets, used, d(_RUN), "id").withColumn("kinds", F.array_join("kinds", ","))


@query(
    "investigated",
    f"""WITH f AS ({FINDINGS}) SELECT file, pos, place FROM (SELECT *, row_number() OVER (PARTITION BY file ORDER BY {RANK} DESC, confidence DESC, file, start_line, pos) AS place FROM f WHERE source = 'llm' AND {RANK} >= 2) WHERE place <= 10""",
)
def investigated(d: Data) -> DataFrame:
    """Of each file's findings, as if it were a review of its own."""
    return summary.investigated(d(FINDINGS), "file", 10).select("file", "pos", F.col("place").cast("long").alias("place"))


_SPOKEN = "SELECT source AS id, CASE WHEN lang = '' THEN NULL ELSE lang END AS language FROM {documents}"


@query("language_notes", f"SELECT id, string_agg(DISTINCT '- ' || language || ': ' || CASE language WHEN 'en' THEN 'plain' WHEN 'de' THEN 'knapp' END, chr(10) ORDER BY '- ' || language || ': ' || CASE language WHEN 'en' THEN 'plain' WHEN 'de' THEN 'knapp' END) AS notes FROM ({_SPOKEN}) WHERE language IN ('en', 'de') GROUP BY id")
def language_notes(d: Data) -> DataFrame:
    return summary.language_notes(d(_SPOKEN), {"en": "plain", "de": "knapp"}, "id")


_SKIPPED = "SELECT user_id AS id, event_id AS pos, CASE event_type WHEN 'error' THEN 'checkov' WHEN 'view' THEN 'ruff' ELSE 'hadolint' END AS tool, CAST(user_id AS STRING) AS reason FROM {events}"


@query("skipped_scanners", f"SELECT id, pos, 'Scanner `' || tool || '` did not run: ' || reason AS note FROM ({_SKIPPED}) WHERE tool <> 'ruff'")
def skipped_scanners(d: Data) -> DataFrame:
    return summary.skipped_scanners(d(_SKIPPED), "id")
