"""Queries of the validation chain, routing, feedback and verdicts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revlens import sinks
from revlens.functions import text as X
from revlens.operators import findings as op
from revlens.plans.inputs import CHANGED, FILES, FINDINGS, FP1, FP2, OTHERS, RANK, Data, query

_NEAR = f"""f AS ({FINDINGS}), c AS ({CHANGED}), k AS ({FILES}),
n AS (SELECT pos, bool_or(line BETWEEN start_line AND end_line) AS hit, arg_min(line, abs(line - start_line) * 100000 + line) AS near
  FROM f JOIN c USING (file) WHERE line BETWEEN start_line - 3 AND greatest(end_line, start_line + 3) GROUP BY pos),
anchored AS (SELECT f.* REPLACE (start_line + d AS start_line, end_line + d AS end_line) FROM
  (SELECT f.*, CASE WHEN kind = 'requirement_gap' OR hit THEN 0 ELSE near - start_line END AS d FROM f LEFT JOIN n USING (pos)
   WHERE file IN (SELECT file FROM k) AND (kind = 'requirement_gap' OR near IS NOT NULL)) f)"""
_WEAK = "source = 'llm' AND NOT (evidence <> 'unverified' AND trim(evidence_note) <> '') AND kind IN ('potential_issue', 'verification_needed') AND severity IN ('major', 'critical')"
_BEST = f"SELECT *, min(pos) OVER (PARTITION BY fingerprint) AS first_pos, row_number() OVER (PARTITION BY fingerprint ORDER BY {RANK} DESC, source = 'llm' DESC, confidence DESC, pos) AS place FROM"


def _kept(rows: str) -> str:
    """Recursive SQL for the rows of a table `rows` that overlap none kept before."""
    return f"""r AS (SELECT *, row_number() OVER (PARTITION BY file, category ORDER BY start_line, {RANK} DESC, first_pos) AS n FROM {rows} WHERE kind <> 'requirement_gap'),
w AS (SELECT file, category, n, pos, end_line AS reach, TRUE AS kept FROM r WHERE n = 1
  UNION ALL SELECT r.file, r.category, r.n, r.pos, CASE WHEN r.start_line > w.reach THEN greatest(r.end_line, w.reach) ELSE w.reach END, r.start_line > w.reach
  FROM w JOIN r ON r.file = w.file AND r.category = w.category AND r.n = w.n + 1),
free AS (SELECT * FROM {rows} WHERE kind = 'requirement_gap' OR pos IN (SELECT pos FROM w WHERE kept))"""


def _printed(d: Data, text: str = FINDINGS) -> DataFrame:
    one = X.fingerprint(F.col("file"), F.col("category"), F.col("rule_id"), F.col("body"))
    two = X.fingerprint_v2(F.col("file"), F.col("category"), F.col("kind"), F.col("rule_id"), F.col("tool"), F.col("title"))
    return d(text).withColumns({"fingerprint": one, "fingerprint_v2": two})


@query("anchor_snap", f"WITH {_NEAR} SELECT pos, file, start_line, end_line FROM anchored")
def anchor_snap(d: Data) -> DataFrame:
    return op.anchor(d(FINDINGS), d(FILES), d(CHANGED)).select("pos", "file", "start_line", "end_line")


@query("anchor_full_file", f"WITH f AS ({FINDINGS}) SELECT pos FROM f WHERE file IN (SELECT file FROM ({FILES})) AND (kind = 'requirement_gap' OR file IN (SELECT file FROM ({CHANGED})))")
def anchor_full_file(d: Data) -> DataFrame:
    return op.anchor(d(FINDINGS), d(FILES), d(CHANGED), full_file=True).select("pos")


@query("enforce_evidence", f"SELECT pos, CASE WHEN {_WEAK} THEN 'minor' ELSE severity END AS severity, CASE WHEN {_WEAK} THEN 'verification_needed' ELSE kind END AS kind FROM ({FINDINGS})")
def enforce_evidence(d: Data) -> DataFrame:
    return op.enforce_evidence(d(FINDINGS)).select("pos", "severity", "kind")


@query("finding_fingerprints", f"SELECT pos, {FP1} AS fingerprint, {FP2} AS fingerprint_v2, file || ':' || start_line || CASE WHEN end_line <> start_line THEN '-' || end_line ELSE '' END AS location FROM ({FINDINGS})")
def finding_fingerprints(d: Data) -> DataFrame:
    return _printed(d).select("pos", "fingerprint", "fingerprint_v2", X.location(F.col("file"), F.col("start_line"), F.col("end_line")).alias("location"))


@query("best_of_each", f"SELECT fingerprint, pos, first_pos FROM ({_BEST} (SELECT *, {FP1} AS fingerprint FROM ({FINDINGS}))) WHERE place = 1")
def best_of_each(d: Data) -> DataFrame:
    return op.best_of_each(_printed(d)).select("fingerprint", "pos", "first_pos")


@query("overlap_suppress", f"WITH RECURSIVE g AS (SELECT *, pos AS first_pos FROM ({FINDINGS})), {_kept('g')} SELECT pos FROM free")
def overlap_suppress(d: Data) -> DataFrame:
    return op.without_overlaps(d(FINDINGS).withColumn("first_pos", F.col("pos"))).select("pos")


@query(
    "validation_chain",
    f"""WITH RECURSIVE {_NEAR}, e AS (SELECT * REPLACE (CASE WHEN {_WEAK} THEN 'minor' ELSE severity END AS severity, CASE WHEN {_WEAK} THEN 'verification_needed' ELSE kind END AS kind) FROM anchored),
s AS (SELECT *, {FP1} AS fingerprint FROM e WHERE confidence >= 0.5 AND severity <> 'info'), b AS (SELECT * FROM ({_BEST} s) WHERE place = 1), {_kept('b')}
SELECT row_number() OVER (ORDER BY {RANK} DESC, confidence DESC, file, start_line, first_pos) AS place, pos, severity, start_line FROM free ORDER BY place LIMIT 25""",
)
def validation_chain(d: Data) -> DataFrame:
    out = op.validate(_printed(d), d(FILES), d(CHANGED), floor="minor")
    return out.select(F.col("place").cast("long").alias("place"), "pos", "severity", "start_line")


@query("tool_restrict", f"SELECT pos FROM ({FINDINGS}) f WHERE EXISTS (SELECT 1 FROM ({CHANGED}) c WHERE c.file = f.file AND line BETWEEN start_line AND end_line)")
def tool_restrict(d: Data) -> DataFrame:
    return op.only_changed(d(FINDINGS), d(CHANGED)).select("pos")


@query(
    "buckets",
    f"""SELECT pos, CASE WHEN kind = 'requirement_gap' THEN 'requirement_gap' WHEN k.file IS NULL OR (has_hunks AND c.file IS NULL) THEN 'outside_diff'
WHEN kind = 'nitpick' THEN 'nitpick' ELSE 'actionable' END AS bucket FROM ({FINDINGS}) f LEFT JOIN ({FILES}) k ON k.file = f.file LEFT JOIN ({CHANGED}) c ON c.file = f.file AND c.line = f.start_line""",
)
def buckets(d: Data) -> DataFrame:
    return op.bucket(d(FINDINGS), d(FILES), d(CHANGED)).select("pos", "bucket")


@query(
    "severity_table",
    f"""SELECT severity, sum(n)::BIGINT AS n, string_agg(CASE WHEN k <= 5 THEN file END, ', ' ORDER BY k) || CASE WHEN count(*) > 5 THEN ' and ' || (count(*) - 5) || ' more' ELSE '' END AS files
FROM (SELECT severity, file, n, row_number() OVER (PARTITION BY severity ORDER BY seen) AS k FROM (SELECT severity, file, count(*) AS n, min(pos) AS seen FROM ({FINDINGS}) GROUP BY severity, file)) GROUP BY severity""",
)
def severity_table(d: Data) -> DataFrame:
    return op.severity_table(d(FINDINGS))


@query("severity_counts", f"SELECT v AS severity, count(pos) AS n FROM (VALUES ('info'), ('minor'), ('major'), ('critical')) x(v) LEFT JOIN ({FINDINGS}) ON severity = v GROUP BY v")
def severity_counts(d: Data) -> DataFrame:
    return sinks.counts(d(FINDINGS)).select("severity", "n")


@query(
    "feedback_partition",
    f"""WITH f AS (SELECT *, {FP1} AS one, {FP2} AS two FROM ({FINDINGS})), e AS (SELECT fp, min(kind) AS verdict FROM (SELECT {FP1} AS fp, kind FROM ({OTHERS}) UNION ALL SELECT {FP2}, kind FROM ({OTHERS})) GROUP BY fp),
m AS (SELECT pos, source, CASE WHEN b.fp IS NOT NULL THEN b.fp ELSE a.fp END AS entry, CASE WHEN b.fp IS NOT NULL THEN b.verdict ELSE a.verdict END AS verdict FROM f LEFT JOIN e b ON b.fp = two LEFT JOIN e a ON a.fp = one)
SELECT pos, CASE WHEN entry IS NULL THEN 'kept' WHEN source = 'static' THEN 'static_kept' ELSE 'suppressed' END AS outcome, entry, verdict FROM m""",
)
def feedback_partition(d: Data) -> DataFrame:
    said = _printed(d, OTHERS)
    entries = said.select("fingerprint", "kind").unionByName(said.select(F.col("fingerprint_v2").alias("fingerprint"), "kind")).groupBy("fingerprint").agg(F.min("kind").alias("verdict"))
    return op.apply_feedback(_printed(d), entries).select("pos", "outcome", "entry", "verdict")


_CHECKS = "SELECT CASE o_orderstatus WHEN 'F' THEN 'error' WHEN 'O' THEN 'warning' ELSE 'off' END AS level, CASE WHEN o_orderpriority = '1-URGENT' THEN 'failed' ELSE 'passed' END AS outcome, o_totalprice < 50000 AS advisory FROM {orders}"


@query(
    "verdict",
    f"""SELECT CASE WHEN NOT (b > 0) THEN 'pass' ELSE 'blocked' END AS verdict, b AS blocking, c AS failed_checks FROM (SELECT count(*) FILTER (WHERE severity = 'critical') AS b FROM ({FINDINGS})),
(SELECT count(*) FILTER (WHERE level = 'error' AND outcome = 'failed' AND NOT advisory) AS c FROM ({_CHECKS}))""",
)
def verdict(d: Data) -> DataFrame:
    return op.gate(d(FINDINGS), d(_CHECKS), F.lit(True))


_OMISSIONS = "SELECT event_id AS pos, CAST(user_id % 300 AS STRING) AS path, CASE event_id % 5 WHEN 0 THEN 'budget' WHEN 1 THEN 'ignored' WHEN 2 THEN 'binary' WHEN 3 THEN 'failed' END AS reason FROM {events}"


@query(
    "coverage_reasons",
    f"""SELECT CASE WHEN k < 2 THEN 'omitted' ELSE 'excluded' END AS class, reason, count(*) AS paths FROM (SELECT path, k, reason, row_number() OVER (PARTITION BY path ORDER BY k, pos) AS n FROM
(SELECT *, CASE WHEN reason IN ('budget', 'failed') THEN 0 WHEN reason IS NULL THEN 1 ELSE 2 END AS k FROM ({_OMISSIONS}))) WHERE n = 1 GROUP BY 1, 2""",
)
def coverage_reasons(d: Data) -> DataFrame:
    return op.coverage(d(_OMISSIONS), ("budget", "failed"))


_EXPECTED = "SELECT concat('case ', CAST(p_partkey AS STRING)) AS \"case\", CASE p_partkey % 3 WHEN 0 THEN 'bug' WHEN 1 THEN 'style' ELSE 'security' END AS category, CASE WHEN p_size > 10 THEN concat('src/m', CAST(p_size % 45 AS STRING), '.py') ELSE '' END AS file, CAST(p_partkey % 5000 + 1 AS BIGINT) AS line FROM {part}"


@query(
    "near_expected",
    f"""SELECT "case", count(pos) AS candidates, count(*) FILTER (WHERE abs(start_line - line) <= 3) AS near FROM ({_EXPECTED}) e LEFT JOIN ({FINDINGS}) f ON f.category = e.category AND (e.file = '' OR e.file = f.file) GROUP BY 1""",
)
def near_expected(d: Data) -> DataFrame:
    return op.near_expected(d(FINDINGS), d(_EXPECTED.replace('"case"', "`case`")))


_DECISIONS = "SELECT o_orderkey % 3000 AS pos, o_orderkey AS ordinal, CASE o_orderstatus WHEN 'F' THEN 'drop' WHEN 'O' THEN 'revise' ELSE 'confirm' END AS disposition, CASE WHEN o_orderpriority < '3' THEN 'major' END AS severity, CASE WHEN o_orderpriority < '4' THEN 'contract' END AS evidence, CASE WHEN o_orderpriority < '2' THEN 'seen' ELSE '' END AS note FROM {orders}"


@query(
    "decisions_fold",
    f"""WITH f AS ({FINDINGS}), d AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY pos ORDER BY ordinal) AS n FROM ({_DECISIONS})) WHERE n = 1)
SELECT f.pos, CASE WHEN d.disposition = 'revise' THEN coalesce(d.severity, f.severity) ELSE f.severity END AS severity,
CASE WHEN d.disposition IN ('revise', 'confirm') AND NOT (f.evidence <> 'unverified' AND f.evidence_note <> '') THEN coalesce(d.evidence, f.evidence) ELSE f.evidence END AS evidence,
CASE WHEN d.disposition IN ('revise', 'confirm') AND d.note <> '' THEN d.note ELSE f.evidence_note END AS evidence_note
FROM f LEFT JOIN d ON d.pos = f.pos WHERE d.disposition IS NULL OR d.disposition <> 'drop'""",
)
def decisions_fold(d: Data) -> DataFrame:
    return op.decide(d(FINDINGS), d(_DECISIONS)).select("pos", "severity", "evidence", "evidence_note")


_EDITS = "SELECT (l_orderkey * 10 + l_linenumber) * 1000000000 + l_partkey * 1000 + l_suppkey % 1000 AS pos, concat('src/m', CAST(l_suppkey % 45 AS STRING), '.py') AS file, CAST(l_partkey * 7 % 5000 + 1 AS BIGINT) AS start_line, CAST(l_partkey * 7 % 5000 + 1 + l_partkey % 4 AS BIGINT) AS end_line, concat('Title: error #', CAST(l_partkey % 40 AS STRING)) AS title FROM {lineitem}"


@query(
    "edit_conflicts",
    f"""WITH e AS ({_EDITS}), k AS (SELECT DISTINCT file, start_line, end_line, title FROM ({FINDINGS})),
x AS (SELECT *, max(end_line) OVER (PARTITION BY file ORDER BY start_line, pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) >= start_line AS b, min(start_line) OVER (PARTITION BY file ORDER BY start_line, pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) <= end_line AS a FROM e),
h AS (SELECT DISTINCT e.pos FROM e JOIN ({CHANGED}) c ON c.file = e.file AND line BETWEEN start_line AND end_line)
SELECT x.pos, CASE WHEN k.file IS NULL THEN 'unknown' WHEN h.pos IS NULL THEN 'unchanged' WHEN coalesce(a, FALSE) OR coalesce(b, FALSE) THEN 'ambiguous' END AS reason
FROM x LEFT JOIN k USING (file, start_line, end_line, title) LEFT JOIN h ON h.pos = x.pos""",
)
def edit_conflicts(d: Data) -> DataFrame:
    return op.ambiguous_edits(d(_EDITS), d(FINDINGS), d(CHANGED)).select("pos", "reason")


@query(
    "finding_json",
    rf"""SELECT pos, '{{{{"file":"' || file || '","start_line":' || start_line || ',"end_line":' || end_line || ',"severity":"' || severity || '","category":"' || category || '","kind":"' || kind || '","title":"' || title
|| '","body":"' || replace(body, chr(10), '\n') || '","evidence":"' || evidence || '","evidence_note":"' || evidence_note || '"' || CASE WHEN suggestion <> '' THEN ',"suggestion":"' || suggestion || '"' ELSE '' END || '}}}}' AS json FROM ({FINDINGS})""",
)
def finding_json(d: Data) -> DataFrame:
    f = d(FINDINGS)
    return f.select("pos", sinks.finding_json(f, agent=True).alias("json"))


_TOP = f"SELECT * FROM (SELECT *, row_number() OVER (ORDER BY {RANK} DESC, confidence DESC, file, start_line, pos) AS place FROM ({FINDINGS})) WHERE place <= 25"


@query(
    "review_instructions",
    rf"""SELECT row_number() OVER (ORDER BY {RANK} DESC, file, start_line, pos) AS place, row_number() OVER (ORDER BY {RANK} DESC, file, start_line, pos) || '. ' || file || ':' || start_line || CASE WHEN end_line <> start_line THEN '-' || end_line ELSE '' END
|| chr(10) || '   severity: ' || severity || ' (' || category || ')' || chr(10) || '   problem: ' || title || chr(10) || '   detail: ' || trim(regexp_replace(body, '\s+', ' ', 'g'))
|| CASE WHEN suggestion <> '' THEN chr(10) || '   fix: replace those lines with:' || chr(10) || '     ' || suggestion ELSE '' END AS text FROM ({_TOP})""",
)
def review_instructions(d: Data) -> DataFrame:
    out = sinks.instructions(op.top(d(FINDINGS).withColumn("first_pos", F.col("pos")), 25).drop("place"))
    return out.select(F.col("place").cast("long").alias("place"), "text")


@query("finding_rows", f"SELECT pos, '| `' || file || ':' || start_line || CASE WHEN end_line <> start_line THEN '-' || end_line ELSE '' END || '` | ' || severity || ' | ' || replace(title, '|', '\\|') || ' |' AS row FROM ({FINDINGS})")
def finding_rows(d: Data) -> DataFrame:
    return sinks.markdown_rows(d(FINDINGS))


@query(
    "review_report",
    f"""WITH g AS (SELECT pos, severity, kind, file, {RANK} AS r FROM ({FINDINGS})), b AS (SELECT g.*, CASE WHEN kind = 'requirement_gap' THEN 0 WHEN k.file IS NULL THEN 1 WHEN kind = 'nitpick' THEN 2 ELSE 3 END AS bucket FROM g LEFT JOIN (SELECT DISTINCT file FROM ({FILES})) k ON k.file = g.file)
SELECT bucket, file, count(*) AS n, max(r) AS worst, count(*) FILTER (WHERE r >= 2) AS blockers FROM b GROUP BY bucket, file""",
)
def review_report(d: Data) -> DataFrame:
    """Of each bucket and file: how many findings, the worst severity, how many of major or more."""
    files = d(FILES).withColumn("has_hunks", F.lit(False))
    told = op.bucket(d(FINDINGS), files, d(CHANGED)).withColumn("r", X.rank_of(F.col("severity")))
    place = F.array_position(F.array(*[F.lit(b) for b in ("requirement_gap", "outside_diff", "nitpick", "actionable")]), F.col("bucket")) - 1
    return told.groupBy(place.cast("int").alias("bucket"), "file").agg(F.count("*").alias("n"), F.max("r").alias("worst"), F.count_if(F.col("r") >= 2).alias("blockers"))


_REVIEWED = FINDINGS.replace("SELECT event_id AS pos", "SELECT user_id % 300 AS review, event_id AS pos", 1)
_REVIEWS = "SELECT c_custkey AS review, CASE WHEN c_custkey % 2 = 0 THEN 'complete' ELSE 'partial' END AS status FROM {customer} WHERE c_custkey < 400"
_JSON = r"""'{{"file":"' || file || '","start_line":' || start_line || ',"end_line":' || end_line || ',"severity":"' || severity || '","category":"' || category || '","kind":"' || kind || '","title":"' || title
|| '","body":"' || replace(body, chr(10), '\n') || '","evidence":"' || evidence || '","evidence_note":"' || evidence_note || '"' || CASE WHEN suggestion <> '' THEN ',"suggestion":"' || suggestion || '"' ELSE '' END || '}}'"""


@query(
    "review_documents",
    f"""WITH f AS ({_REVIEWED}), a AS (SELECT review, string_agg({_JSON}, ',' ORDER BY {RANK} DESC, file, start_line, pos) AS listed, count(*) AS n,
concat_ws(',', {', '.join(f"CASE WHEN count(*) FILTER (WHERE severity = '{s}') > 0 THEN '\"{s}\":' || count(*) FILTER (WHERE severity = '{s}') END" for s in ('critical', 'major', 'minor', 'info'))}) AS by FROM f GROUP BY review)
SELECT review, '{{{{"schema_version":7,"status":"' || status || '","summary":{{{{"total":' || coalesce(n, 0) || ',"by_severity":{{{{' || coalesce("by", '') || '}}}}}}}},"findings":[' || coalesce(listed, '') || ']}}}}' AS json FROM ({_REVIEWS}) LEFT JOIN a USING (review)""".replace("AS by FROM", 'AS "by" FROM'),
)
def review_documents(d: Data) -> DataFrame:
    return sinks.documents(d(_REVIEWED), d(_REVIEWS), agent=True)


_AT = "'`' || file || ':' || start_line || CASE WHEN end_line <> start_line THEN '-' || end_line ELSE '' END || '`'"


@query(
    "review_markdown",
    f"""WITH f AS (SELECT *, CASE WHEN kind IN ('requirement_gap', 'nitpick') THEN kind ELSE 'actionable' END AS bucket FROM ({_REVIEWED})), s AS (SELECT review, bucket, '## ' || CASE bucket WHEN 'requirement_gap' THEN 'Requirement gaps' WHEN 'nitpick' THEN 'Nitpicks' ELSE 'Actionable' END || ' (' || count(*) || ')' || chr(10) || chr(10)
|| '| Place | Severity | Finding |' || chr(10) || '| --- | --- | --- |' || chr(10) || string_agg('| ' || {_AT} || ' | ' || severity || ' | ' || title || ' |', chr(10) ORDER BY {RANK} DESC, file, start_line, pos) AS section FROM f GROUP BY review, bucket),
t AS (SELECT review, string_agg(section, chr(10) || chr(10) ORDER BY list_position(['requirement_gap', 'actionable', 'nitpick'], bucket)) AS sections FROM s GROUP BY review),
n AS (SELECT review, concat_ws(', ', {', '.join(f"count(*) FILTER (WHERE severity = '{s}') || ' {s}'" for s in ('critical', 'major', 'minor', 'info'))}) AS line FROM f GROUP BY review)
SELECT review, '# Review: ' || status || chr(10) || chr(10) || coalesce(line, '0 critical, 0 major, 0 minor, 0 info') || chr(10) || chr(10) || coalesce(sections, 'No findings.') AS text FROM ({_REVIEWS}) LEFT JOIN n USING (review) LEFT JOIN t USING (review)""",
)
def review_markdown(d: Data) -> DataFrame:
    """Reports in the short form; each finding in the bucket that its kind gives it."""
    kind = F.col("kind")
    return sinks.markdown_documents(d(_REVIEWED).withColumn("bucket", F.when(kind.isin("requirement_gap", "nitpick"), kind).otherwise("actionable")), d(_REVIEWS), full=False)


#: A review for each customer: what events found there, and a check for each order.
_FOUND = "SELECT user_id AS review, CASE event_id % 9 WHEN 0 THEN 'critical' WHEN 1 THEN 'major' ELSE 'info' END AS severity FROM {events} WHERE user_id % 3 = 0"
_CHECKED = "SELECT o_custkey AS review, CASE o_orderstatus WHEN 'F' THEN 'error' ELSE 'warning' END AS level, CASE WHEN o_orderkey % 11 = 0 THEN 'failed' ELSE 'passed' END AS outcome, CASE WHEN o_totalprice < 50000 THEN TRUE END AS advisory FROM {orders}"
_RUNS = "SELECT c_custkey AS review, CASE WHEN c_custkey % 13 > 0 THEN c_custkey % 10 > 0 END AS complete FROM {customer}"


@query(
    "verdicts",
    f"""SELECT review, CASE WHEN NOT coalesce(complete, FALSE) THEN 'error' WHEN coalesce(b, 0) + coalesce(c, 0) > 0 THEN 'blocked' ELSE 'pass' END AS verdict, coalesce(b, 0) AS blocking, coalesce(c, 0) AS failed_checks FROM ({_RUNS})
LEFT JOIN (SELECT review, count(*) FILTER (WHERE severity = 'critical') AS b FROM ({_FOUND}) GROUP BY review) USING (review) LEFT JOIN (SELECT review, count(*) FILTER (WHERE level = 'error' AND outcome = 'failed' AND advisory IS NULL) AS c FROM ({_CHECKED}) GROUP BY review) USING (review)""",
)
def verdicts(d: Data) -> DataFrame:
    return op.verdicts(d(_RUNS), d(_FOUND), d(_CHECKED))
