"""Queries of recorded answers of forges, replacements and gates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revlens.operators import edits, relations, selection
from revlens.plans.inputs import Data, query
from revlens.sources import diffs, forge

#: A file entry for each line item, as two forges write them.
_PULL = """SELECT l_orderkey AS change, l_linenumber AS pos, concat('{{"filename":"src/f', CAST(l_suppkey AS STRING), CASE l_partkey % 5 WHEN 0 THEN '.PNG' WHEN 1 THEN '.py' ELSE '.js' END, '","status":"', CASE l_partkey % 4 WHEN 0 THEN 'removed' WHEN 1 THEN 'renamed' WHEN 2 THEN 'odd' ELSE 'added' END, '"',
CASE WHEN l_partkey % 4 = 1 THEN concat(',"previous_filename":"old', CAST(l_suppkey AS STRING), '"') ELSE '' END, CASE l_suppkey % 3 WHEN 0 THEN concat(',"patch":"@@ -1,2 +1,2 @@ f', chr(92), 'n-a', chr(92), 'n+b', chr(92), 'n c"') WHEN 1 THEN ',"patch":7' ELSE '' END, '}}') AS item, l_partkey, l_suppkey FROM {lineitem} WHERE l_linenumber < 5"""
_HAS = "l_suppkey % 3 = 0"
_PATH = "'src/f' || l_suppkey || CASE l_partkey % 5 WHEN 0 THEN '.PNG' WHEN 1 THEN '.py' ELSE '.js' END"
_LEFT = "{lineitem} WHERE l_linenumber < 5"


@query(
    "pull_files",
    f"""SELECT l_orderkey AS change, l_linenumber AS pos, {_PATH} AS path, CASE WHEN l_partkey % 4 = 1 THEN 'old' || l_suppkey END AS previous_path, CASE l_partkey % 4 WHEN 0 THEN 'deleted' WHEN 1 THEN 'renamed' WHEN 2 THEN 'modified' ELSE 'added' END AS change_type,
CASE l_partkey % 5 WHEN 0 THEN NULL WHEN 1 THEN 'python' ELSE 'javascript' END AS language, NOT {_HAS} AND l_partkey % 5 = 0 AS is_binary, NOT {_HAS} AND l_partkey % 5 > 0 AS needs_text FROM {_LEFT}""",
)
def pull_files(d: Data) -> DataFrame:
    return forge.pull_files(d(_PULL)).drop("patch", "diff")


@query("pull_hunks", f"SELECT l_orderkey || '/' || l_linenumber || '/' || l_partkey || '/' || l_suppkey AS id, 1::BIGINT AS old_start, 2 AS old_lines, 1::BIGINT AS new_start, 2 AS new_lines, 'f' AS header FROM {_LEFT} AND {_HAS}")
def pull_hunks(d: Data) -> DataFrame:
    """The patches of the entries, read as diffs."""
    rows = d(_PULL)
    files = forge.pull_files(rows.withColumn("pos", F.concat_ws("/", "change", "pos", "l_partkey", "l_suppkey"))).where("diff IS NOT NULL").select(F.col("pos").alias("id"), "diff")
    return diffs.diff_hunks(diffs.diff_lines(files.distinct(), "id", "diff"), "id").join(files.select("id"), "id").drop("block", "hunk")


_MERGE = """SELECT o_orderkey AS change, 1 AS pos, concat('{{"new_path":"', CASE WHEN o_custkey % 5 = 0 THEN '' ELSE concat('n', CAST(o_custkey AS STRING), '.go') END, '","old_path":"', CASE WHEN o_custkey % 10 = 0 THEN '' ELSE concat('o', CAST(o_custkey AS STRING), '.pdf') END, '"',
CASE o_orderkey % 4 WHEN 0 THEN ',"new_file":true' WHEN 1 THEN ',"deleted_file":true' WHEN 2 THEN ',"renamed_file":true' ELSE '' END, CASE WHEN o_orderkey % 3 = 0 THEN concat(',"diff":"@@ -1 +1 @@', chr(92), 'n-a', chr(92), 'n+b"') ELSE ',"diff":""' END, '}}') AS item FROM {orders}"""


@query(
    "merge_files",
    """SELECT o_orderkey AS change, CASE WHEN o_custkey % 5 = 0 THEN 'o' || o_custkey || '.pdf' ELSE 'n' || o_custkey || '.go' END AS path, CASE WHEN o_orderkey % 4 = 2 AND o_custkey % 10 > 0 THEN 'o' || o_custkey || '.pdf' END AS previous_path, CASE o_orderkey % 4 WHEN 0 THEN 'added' WHEN 1 THEN 'deleted' WHEN 2 THEN 'renamed' ELSE 'modified' END AS change_type,
o_orderkey % 3 > 0 AND o_custkey % 5 = 0 AS is_binary, o_orderkey % 3 > 0 AND o_custkey % 5 > 0 AS needs_text FROM {orders} WHERE o_custkey % 10 > 0""",
)
def merge_files(d: Data) -> DataFrame:
    return forge.merge_files(d(_MERGE)).drop("pos", "patch", "diff", "language")


_SIDES = "SELECT o_orderkey AS change, concat('n', CAST(o_custkey AS STRING), '.go') AS path, CASE o_custkey % 6 WHEN 0 THEN 'a' WHEN 1 THEN '' WHEN 2 THEN concat('x', chr(0)) ELSE 'b' END AS old, CASE o_custkey % 4 WHEN 0 THEN 'a' WHEN 1 THEN '' ELSE 'c' END AS new, CAST(1 AS BIGINT) AS old_bytes, CAST(o_custkey * 1000 AS BIGINT) AS new_bytes, o_custkey % 7 > 0 AS readable FROM {orders} WHERE o_orderkey % 11 > 0"


@query(
    "recovered_states",
    f"""SELECT m.o_orderkey AS change, 'n' || m.o_custkey || '.go' AS path, CASE WHEN NOT coalesce(readable, FALSE) OR new_bytes > 1048576 THEN 'patch_unavailable' WHEN contains(old, chr(0)) THEN 'binary' WHEN old = '' AND new = '' THEN 'zero_byte' WHEN old = new AND m.o_orderkey % 4 <> 1 THEN 'patch_unavailable' ELSE 'text' END AS state
FROM {{orders}} m LEFT JOIN ({_SIDES}) s ON s.change = m.o_orderkey WHERE o_orderkey % 3 > 0 AND o_custkey % 5 > 0""",
)
def recovered_states(d: Data) -> DataFrame:
    return forge.recovered_states(forge.merge_files(d(_MERGE)), d(_SIDES))


_ISSUES = """SELECT c_custkey AS change, CASE c_custkey % 7 WHEN 0 THEN '[]' WHEN 1 THEN '{{"title":"t","pull_request":{{"url":"u"}}}}' ELSE concat('{{"title":"', c_name, '","body":', CASE WHEN c_custkey % 2 = 0 THEN 'null' ELSE '"b"' END, ',"state":"open","labels":[{{"name":"', c_mktsegment, '"}},{{"name":""}},7]}}') END AS item FROM {customer}"""
_NOTES = """SELECT o_custkey AS change, o_orderkey AS pos, CASE o_orderkey % 5 WHEN 0 THEN '{{"body":"moved","system":true}}' WHEN 1 THEN '{{"body":""}}' ELSE concat('{{"body":"n', CAST(o_orderkey AS STRING), '"}}') END AS item FROM {orders}"""


@query(
    "issues",
    """SELECT c_custkey AS change, CASE WHEN c_custkey % 7 > 1 THEN c_name END AS title, CASE WHEN c_custkey % 7 > 1 THEN CASE WHEN c_custkey % 2 = 0 THEN '' ELSE 'b' END END AS body, CASE WHEN c_custkey % 7 > 1 THEN c_mktsegment END AS labels, CASE WHEN c_custkey % 7 > 1 THEN coalesce(notes, '') END AS comments,
CASE c_custkey % 7 WHEN 0 THEN 'no issue' WHEN 1 THEN 'a pull request' END AS problem FROM {customer} LEFT JOIN (SELECT o_custkey, string_agg('n' || o_orderkey, ',' ORDER BY o_orderkey) AS notes FROM {orders} WHERE o_orderkey % 5 > 1 GROUP BY o_custkey) ON o_custkey = c_custkey""",
)
def issues(d: Data) -> DataFrame:
    out = forge.issues(d(_ISSUES), d(_NOTES))
    return out.select("change", "title", "body", F.array_join("labels", ",").alias("labels"), F.array_join("comments", ",").alias("comments"), "problem")


_TIMELINE = """SELECT user_id AS change, event_id AS pos, concat('{{"event":"', CASE WHEN event_type = 'view' THEN 'labeled' ELSE 'cross-referenced' END, '","source":{{"issue":{{"number":', CASE WHEN event_id % 9 = 0 THEN '"x"' ELSE CAST(event_id % 13 AS STRING) END, ',"state":"', event_type, '"',
CASE WHEN event_id % 4 > 0 THEN ',"pull_request":{{}}' ELSE '' END, CASE event_id % 5 WHEN 0 THEN ',"repository":{{"full_name":"other/p"}}' WHEN 1 THEN ',"repository":{{"full_name":"own/p"}}' ELSE '' END, '}}}}}}') AS item FROM {events}"""
_PROJECTS = "SELECT DISTINCT user_id AS change, 'own/p' AS project FROM {events}"


@query(
    "issue_links",
    """SELECT change, number, state, place FROM (SELECT user_id AS change, event_id % 13 AS number, arg_max(event_type, event_id) AS state, row_number() OVER (PARTITION BY user_id ORDER BY min(event_id)) AS place FROM {events} WHERE event_type <> 'view' AND event_id % 9 > 0 AND event_id % 4 > 0 AND event_id % 5 > 0 GROUP BY user_id, event_id % 13)""",
)
def issue_links(d: Data) -> DataFrame:
    found = forge.links(d(_TIMELINE), d(_PROJECTS))
    return relations.linked_changes(found, "change", "number", "pos").select("change", "number", "state", F.col("place").cast("long").alias("place"))


#: A file for each customer, its lines the customer's orders; every fifth order's line and the next are replaced.
_FILE_LINES = "SELECT o_custkey AS file, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS INT) AS n, concat('o', CAST(o_orderkey AS STRING)) AS line FROM {orders}"
_REPLACED = f"SELECT file * 1000 + n AS pos, file, n AS start_line, n + CASE WHEN n % 10 = 0 THEN 1 ELSE 0 END AS end_line, CASE WHEN n % 15 = 0 THEN line ELSE concat('new', CAST(n AS STRING), chr(13), chr(10), 'more', chr(10)) END AS suggestion FROM ({_FILE_LINES}) WHERE n % 5 = 0"


@query(
    "applied_edits",
    f"""WITH l AS ({_FILE_LINES}), size AS (SELECT file, max(n) AS last FROM l GROUP BY file), e AS ({_REPLACED}), ok AS (SELECT e.* FROM e JOIN size USING (file) WHERE end_line <= last AND file % 7 > 0 AND NOT (start_line = end_line AND start_line % 15 = 0)),
r AS (SELECT l.file, l.n, CASE WHEN ok.pos IS NULL THEN line WHEN l.n % 15 = 0 AND l.n = start_line THEN line ELSE 'new' || start_line || chr(10) || 'more' END AS line, ok.pos IS NOT NULL AND l.n > start_line AS covered FROM l LEFT JOIN ok ON ok.file = l.file AND l.n BETWEEN start_line AND end_line)
SELECT file, replace(string_agg(line, chr(10) ORDER BY n), chr(10), CASE WHEN file % 3 = 0 THEN chr(13) || chr(10) ELSE chr(10) END) || CASE WHEN file % 2 = 0 THEN CASE WHEN file % 3 = 0 THEN chr(13) || chr(10) ELSE chr(10) END ELSE '' END AS text, 'text' AS part, NULL AS pos FROM r WHERE NOT covered AND file IN (SELECT file FROM ok) GROUP BY file
UNION ALL SELECT NULL, CASE WHEN file % 7 = 0 THEN 'line_ends' WHEN end_line > last THEN 'outside' ELSE 'no_change' END, 'reason', pos FROM e JOIN size USING (file) WHERE pos NOT IN (SELECT pos FROM ok)""",
)
def applied_edits(d: Data) -> DataFrame:
    """Texts after the edits, and why the others did nothing. Every seventh file has single carriage returns, every third one ends lines with two characters."""
    lines = d(_FILE_LINES)
    sep = F.when(F.col("file") % 7 == 0, "\r").when(F.col("file") % 3 == 0, "\r\n").otherwise("\n")
    texts = lines.groupBy("file").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "line"))), lambda x: x["line"]).alias("all")).withColumn("sep", sep)
    text = F.concat(F.element_at("all", 1), F.coalesce(F.array_join(F.transform(F.slice("all", 2, 1 << 30), lambda x: F.concat(F.col("sep"), x)), ""), F.lit("")), F.when(F.col("file") % 2 == 0, F.col("sep")).otherwise(""))
    out, idle = edits.apply_edits(texts.select("file", F.when(F.col("file") % 7 == 0, F.concat(text, F.lit("\rx"))).otherwise(text).alias("text")), d(_REPLACED))
    done = out.select("file", "text", F.lit("text").alias("part"), F.lit(None).cast("long").alias("pos"))
    return done.unionByName(idle.select(F.lit(None).cast("long").alias("file"), F.col("reason").alias("text"), F.lit("reason").alias("part"), "pos"))


_REQUESTS = "SELECT o_orderkey AS change, CASE o_custkey % 6 WHEN 0 THEN 'local' ELSE 'forge' END AS origin, CASE WHEN o_custkey % 5 > 0 THEN concat('h', CAST(o_custkey % 3 AS STRING)) END AS head FROM {orders}"
_TREES = "SELECT o_orderkey AS change, CASE WHEN o_custkey % 7 > 0 THEN concat('h', CAST(o_orderkey % 3 AS STRING), chr(10)) ELSE '' END AS commit, CASE o_custkey % 4 WHEN 0 THEN NULL WHEN 1 THEN ' M a' ELSE '' END AS status FROM {orders} WHERE o_orderkey % 9 > 0"
_DUE = "SELECT l_orderkey AS change, l_partkey AS command FROM {lineitem}"


@query(
    "gated_runs",
    f"""SELECT change, command, CASE WHEN why IS NULL THEN 'due' ELSE 'refused' END AS state, why AS note FROM ({_DUE}) LEFT JOIN (SELECT r.change, TRUE AS known, CASE WHEN origin = 'local' THEN NULL WHEN head IS NULL THEN 'no head' WHEN trim(coalesce(commit, ''), chr(10)) = '' THEN 'no checkout' WHEN trim(commit, chr(10)) <> head THEN 'another commit'
WHEN status IS NULL THEN 'status unknown' WHEN trim(status) <> '' THEN 'uncommitted changes' END AS why FROM ({_REQUESTS}) r LEFT JOIN ({_TREES}) t ON t.change = r.change) USING (change)""",
)
def gated_runs(d: Data) -> DataFrame:
    trees = d(_TREES).withColumn("commit", F.regexp_replace("commit", "\n", ""))
    return selection.gated(d(_DUE), selection.availability(d(_REQUESTS), trees))
