"""Queries of diffs: texts are built from turns of conversations, so their lines are known."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revlens.plans.inputs import Data, query
from revlens.sources import diffs as read

#: One change a turn: a modified file of two hunks, a rename, or a new file; every line of the text is added.
_DIFFS = """SELECT conv_id * 100 + turn AS id, conv_id, turn, text, concat(
CASE turn % 3 WHEN 0 THEN concat('diff --git a/src/', role, '.py b/src/', role, '.py', chr(10), '--- a/src/', role, '.py', chr(10), '+++ b/src/', role, '.py', chr(10))
WHEN 1 THEN concat('diff --git a/old.md b/new.md', chr(10), 'rename from old.md', chr(10), 'rename to new.md', chr(10), '--- a/old.md', chr(10), '+++ b/new.md', chr(10))
ELSE concat('--- /dev/null', chr(10), '+++ b/Dockerfile.', role, chr(10), 'new file mode 100644', chr(10)) END,
'@@ -5,3 +', CAST(10 + turn AS STRING), ' @@ def f', chr(10), ' keep', chr(10), '-gone', chr(10), '+', replace(text, chr(10), concat(chr(10), '+')), chr(10), ' end', chr(10), chr(92), ' No newline', chr(10),
'@@ -90 +200,2 @@', chr(10), '+last', chr(10), 'diff --git a/x.bin b/x.bin', chr(10), 'Binary files differ', chr(10)) AS diff FROM {conversations}"""
_N = "length(text) - length(replace(text, chr(10), '')) + 1"


def _lines(d: Data) -> DataFrame:
    return read.diff_lines(d(_DIFFS).select("id", "diff"), "id", "diff")


@query(
    "diff_lines",
    f"""SELECT id, {_N} + 1 AS added, 10 + turn + 1 AS first_added, 10 + turn + {_N} + 1 AS end_line, {_N} + 4 AS end_position, 200 AS last_line, {_N} + 6 AS last_position FROM ({_DIFFS})""",
)
def diff_lines(d: Data) -> DataFrame:
    rows = _lines(d).where("block = 1")
    plus = F.col("mark") == "+"
    return rows.groupBy("id").agg(
        F.count_if(plus).alias("added"),
        F.min(F.when(plus, F.col("new_line"))).alias("first_added"),
        F.max(F.when(F.col("line") == " end", F.col("new_line"))).alias("end_line"),
        F.max(F.when(F.col("line") == " end", F.col("position"))).alias("end_position"),
        F.max("new_line").alias("last_line"),
        F.max("position").alias("last_position"),
    )


@query(
    "diff_files",
    f"""SELECT id, 1 AS block, CASE turn % 3 WHEN 0 THEN 'src/' || role || '.py' WHEN 1 THEN 'new.md' ELSE 'Dockerfile.' || role END AS path, CASE turn % 3 WHEN 1 THEN 'old.md' END AS previous_path, CASE turn % 3 WHEN 0 THEN 'modified' WHEN 1 THEN 'renamed' ELSE 'added' END AS change_type,
CASE turn % 3 WHEN 0 THEN 'python' WHEN 1 THEN 'markdown' ELSE 'dockerfile' END AS language, FALSE AS is_binary, 2 AS hunks, {_N} + 1 AS added FROM ({_DIFFS}) JOIN (SELECT conv_id, turn, role FROM {{conversations}}) USING (conv_id, turn)
UNION ALL SELECT id, 2, 'x.bin', NULL, 'modified', NULL, TRUE, 0, 0 FROM ({_DIFFS})""",
)
def diff_files(d: Data) -> DataFrame:
    return read.diff_files(_lines(d), "id").withColumn("block", F.col("block").cast("int"))


@query(
    "diff_hunks",
    f"SELECT id, 1 AS hunk, 5 AS old_start, 3 AS old_lines, 10 + turn AS new_start, 1 AS new_lines, 'def f' AS header FROM ({_DIFFS}) UNION ALL SELECT id, 2, 90, 1, 200, 2, '' FROM ({_DIFFS})",
)
def diff_hunks(d: Data) -> DataFrame:
    return read.diff_hunks(_lines(d), "id").drop("block")


@query("diff_sub_hunk", f"SELECT id, CASE WHEN {_N} >= 2 THEN 2 ELSE 1 END AS new_lines, CASE WHEN {_N} >= 2 THEN 0 ELSE 0 END AS old_lines, 12 + turn - 1 AS new_start, 7 AS old_start FROM ({_DIFFS}) WHERE {_N} >= 2")
def diff_sub_hunk(d: Data) -> DataFrame:
    part = read.sub_hunk(_lines(d).where("block = 1"), "id", F.lit(3), F.lit(4)).where("hunk = 1 AND new_lines = 2 AND old_lines = 0")
    return part.select("id", "new_lines", "old_lines", "new_start", "old_start")


@query("diff_numbered", f"SELECT id, lpad(CAST(10 + turn AS VARCHAR), 6, ' ') || '  keep' AS keep, '       -gone' AS gone FROM ({_DIFFS})")
def diff_numbered(d: Data) -> DataFrame:
    rows = read.numbered(_lines(d)).where("line IN (' keep', '-gone')")
    return rows.groupBy("id").agg(F.max(F.when(F.col("line") == " keep", F.col("shown"))).alias("keep"), F.max(F.when(F.col("line") == "-gone", F.col("shown"))).alias("gone"))


#: A hunk for each customer: an order is a line, a third of them changed; texts of orders.
_ROWS = "SELECT o_custkey AS id, 1 AS block, CAST(o_custkey % 2 + 1 AS BIGINT) AS hunk, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS BIGINT) AS pos, CASE WHEN o_orderkey % 7 = 0 AND o_custkey % 5 > 0 THEN '+' ELSE ' ' END AS mark, concat('l', CAST(o_orderkey AS STRING)) AS line, o_orderkey AS new_line FROM {orders}"
_KEPT = f"""SELECT *, pos - lag(pos, 1, 0) OVER (PARTITION BY id ORDER BY pos) - 1 AS gap, row_number() OVER (PARTITION BY id ORDER BY pos) AS k FROM (
SELECT *, CASE WHEN n <= 9 THEN TRUE WHEN NOT changed THEN pos <= 9 WHEN s6 <= 9 THEN n6 WHEN s4 <= 9 THEN n4 WHEN s3 <= 9 THEN n3 WHEN s2 <= 9 THEN n2 ELSE n1 END AS keep FROM (
SELECT *, count(*) OVER (PARTITION BY id) AS n, bool_or(mark = '+') OVER (PARTITION BY id) AS changed, {', '.join(f"count(*) FILTER (WHERE n{c}) OVER (PARTITION BY id) AS s{c}" for c in (6, 4, 3, 2, 1))} FROM (
SELECT *, {', '.join(f"bool_or(mark = '+') OVER (PARTITION BY id ORDER BY pos ROWS BETWEEN {c} PRECEDING AND {c} FOLLOWING) AS n{c}" for c in (6, 4, 3, 2, 1))} FROM ({_ROWS})))) WHERE keep"""


@query("diff_trim", f"""WITH k AS ({_KEPT}) SELECT id, pos, 1 AS place, lpad(CAST(new_line AS VARCHAR), CAST(greatest(6, length(CAST(new_line AS VARCHAR))) AS INTEGER), ' ') || ' ' || line AS shown FROM k UNION ALL SELECT id, pos, 0, '... ' || gap || ' unchanged lines omitted ...' FROM k WHERE gap > 0 AND k > 1""")
def diff_trim(d: Data) -> DataFrame:
    """At most 9 lines of a hunk as they are told, with a row for each gap."""
    return read.with_gaps(read.trimmed(d(_ROWS), "id", 9), "id").select("id", "pos", "place", "shown")


@query("whole_file", "SELECT doc_id, CASE WHEN text = '' THEN 0 ELSE length(rtrim(text, chr(10))) - length(replace(text, chr(10), '')) + 1 + (length(text) - length(rtrim(text, chr(10)))) - CASE WHEN text LIKE '%' || chr(10) THEN 1 ELSE 0 END END AS n FROM {documents} WHERE text <> ''")
def whole_file(d: Data) -> DataFrame:
    return read.whole_file(d.table("documents"), "doc_id", "text").groupBy("doc_id").agg(F.max("line").alias("n"))


@query(
    "flow_digest",
    f"""SELECT id, substr(sha256(CASE turn % 3 WHEN 0 THEN 'src/' || role || '.py||modified' WHEN 1 THEN 'new.md|old.md|renamed' ELSE 'Dockerfile.' || role || '||added' END || chr(10) || '5,3,' || (10 + turn) || ',1' || chr(10) || '90,1,200,2' || chr(10) || 'x.bin||modified'), 1, 16) AS digest
FROM ({_DIFFS}) JOIN (SELECT conv_id, turn, role FROM {{conversations}}) USING (conv_id, turn)""",
)
def flow_digest(d: Data) -> DataFrame:
    lines = _lines(d)
    return read.flow_digest(read.diff_files(lines, "id"), read.diff_hunks(lines, "id"), "id")


@query("diff_recovered")
def diff_recovered(d: Data) -> DataFrame:
    """Patches between a document and its text in lower case, read back: every line that differs is removed and added."""
    pairs = d("SELECT concat('d', CAST(doc_id AS STRING)) AS path, text AS old, lower(text) AS new FROM {documents}")
    lines = read.diff_lines(read.recovered(pairs, "path", "old", "new").where("diff IS NOT NULL"), "path", "diff")
    return lines.groupBy("path").agg(F.count_if(F.col("mark") == "+").alias("added"), F.count_if(F.col("mark") == "-").alias("removed"))


_POINTS = "SELECT conv_id * 100 + turn AS id, 1 AS block, CAST(CASE turn % 4 WHEN 0 THEN 10 + turn WHEN 1 THEN 200 WHEN 2 THEN 11 + turn ELSE 9999 END AS BIGINT) AS line FROM {conversations}"


@query("diff_positions", f"SELECT id, 1 AS block, CASE turn % 4 WHEN 0 THEN 10 + turn WHEN 1 THEN 200 WHEN 2 THEN 11 + turn ELSE 9999 END AS line, CAST(CASE turn % 4 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 1 END AS BIGINT) AS hunk, CASE turn % 4 WHEN 0 THEN 2 WHEN 1 THEN {_N} + 6 WHEN 2 THEN 4 END AS position FROM ({_DIFFS})")
def diff_positions(d: Data) -> DataFrame:
    return read.positions(d(_POINTS), _lines(d), "id")
