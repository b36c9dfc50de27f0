"""Queries of an evaluation's scores."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revlens import operators
from revlens.operators import evaluation as op
from revlens.plans.inputs import Data, query

_ROWS = "SELECT event_type AS slot, CASE WHEN event_type IN ('error', 'purchase') THEN 'bug' END AS expected_category, CASE event_id % 4 WHEN 0 THEN TRUE WHEN 1 THEN FALSE END AS expect_blocker, event_id % 3 AS findings, event_id % 5 AS blockers, event_id % 7 > 0 AS matched, event_id % 6 > 0 AS matched_blocker, event_id % 9 > 0 AS exact_anchor, CASE WHEN event_id % 200 = 0 THEN 1 ELSE 0 END AS n_errors, event_id % 1000 AS tokens FROM {events}"


def _ratio(part: str, whole: str, empty: str) -> str:
    return f"coalesce(count(*) FILTER (WHERE ({part}) AND ({whole}))::DOUBLE / nullif(count(*) FILTER (WHERE {whole}), 0), {empty})"


_DEFECT, _CONTROL, _PROVABLE = "coalesce(expected_category <> '', FALSE)", "expect_blocker IS NOT DISTINCT FROM FALSE", "expect_blocker IS NOT DISTINCT FROM TRUE"
_SCORE = f"""count(*) AS cases, {_ratio('matched', _DEFECT, '1.0')} AS recall, {_ratio('findings > 0', f'NOT {_DEFECT} AND NOT {_CONTROL}', '0.0')} AS clean_false_positive_rate,
{_ratio('blockers > 0', _CONTROL, '0.0')} AS unproven_blocker_rate, {_ratio('matched_blocker', _PROVABLE, '1.0')} AS blocker_recall, {_ratio('exact_anchor', f'{_DEFECT} AND matched', '0.0')} AS anchor_accuracy,
{_ratio('n_errors = 0', 'TRUE', '1.0')} AS parse_success, coalesce(sum(tokens), 0)::BIGINT AS tokens"""


@query("eval_metrics", f"SELECT {_SCORE} FROM ({_ROWS})")
def eval_metrics(d: Data) -> DataFrame:
    return op.score(d(_ROWS))


@query("eval_metrics_by_slot", f"SELECT slot, {_SCORE} FROM ({_ROWS}) GROUP BY slot")
def eval_metrics_by_slot(d: Data) -> DataFrame:
    return op.score(d(_ROWS), ["slot"])


@query("eval_metrics_of_none", f"SELECT {_SCORE} FROM ({_ROWS}) WHERE tokens < 0")
def eval_metrics_of_none(d: Data) -> DataFrame:
    return op.score(d(_ROWS).where("tokens < 0"))


_LABELLED = "SELECT CASE WHEN quality = 1 THEN 'bug' END AS expected_category, CASE WHEN toxic = 1 THEN FALSE END AS expect_blocker, n_chars % 2 AS findings, n_chars % 20 / 19 AS blockers, n_chars > 100 AS matched, TRUE AS matched_blocker, n_chars > 200 AS exact_anchor, 0 AS n_errors, n_chars AS tokens FROM {labels} JOIN {documents} USING (doc_id)"


@query(
    "eval_gate",
    f"""SELECT m.recall < 0.80 OR m.clean_false_positive_rate > 0.10 OR m.unproven_blocker_rate > 0.10 OR m.blocker_recall < 0.80 OR m.anchor_accuracy < 0.95 OR m.parse_success < 0.99 OR s.recall < b.recall OR s.clean_false_positive_rate > b.clean_false_positive_rate AS failed
FROM (SELECT {_SCORE} FROM ({_ROWS})) m, (SELECT {_SCORE} FROM ({_LABELLED})) b, (SELECT {_SCORE} FROM ({_ROWS})) s""",
)
def eval_gate(d: Data) -> DataFrame:
    return op.gate_failed(op.score(d(_ROWS)), op.score(d(_LABELLED)), op.score(d(_ROWS)))


_CHECKS = ("states_trigger", "states_fix", "suggestion_safe")
_JUDGED = "SELECT CASE user_id % 3 WHEN 0 THEN 'clean_control' WHEN 1 THEN 'supported_defect' ELSE 'other' END AS kind, event_id % 5 > 0 AS judge_attempted, event_id % 7 > 0 AS answered, event_id % 2 = 0 AS one, event_id % 3 = 0 AS two, CASE WHEN event_id % 4 = 0 THEN event_id % 8 = 0 END AS three, event_id % 3 AS unsupported_claims FROM {events}"
_G = "judge_attempted AND answered"
_QUALITY = f"""count(judge_attempted) AS cases, count(*) FILTER (WHERE judge_attempted) AS judge_attempts, count(*) FILTER (WHERE {_G}) AS judged,
count(*) FILTER (WHERE {_G})::DOUBLE / nullif(count(*) FILTER (WHERE judge_attempted), 0) AS judge_completion,
sum(CASE WHEN {_G} THEN one::INT + two::INT + coalesce(three::INT, 0) END)::DOUBLE / nullif(sum(CASE WHEN {_G} THEN 2 + (three IS NOT NULL)::INT END), 0) AS overall, coalesce(sum(unsupported_claims), 0)::BIGINT AS unsupported_claims,
avg(CASE WHEN {_G} THEN one::INT END) AS states_trigger, avg(CASE WHEN {_G} THEN two::INT END) AS states_fix, avg(CASE WHEN {_G} THEN three::INT END) AS suggestion_safe"""


def _judged(d: Data) -> DataFrame:
    pairs = F.array(F.struct(F.lit("states_trigger").alias("k"), F.col("one").alias("v")), F.struct(F.lit("states_fix").alias("k"), F.col("two").alias("v")), F.struct(F.lit("suggestion_safe").alias("k"), F.col("three").alias("v")))
    return d(_JUDGED).withColumn("judge", F.when(F.col("answered"), F.map_from_entries(F.filter(pairs, lambda p: p["v"].isNotNull()))))


@query("quality_checks", f"SELECT {_QUALITY} FROM ({_JUDGED})")
def quality_checks(d: Data) -> DataFrame:
    return op.quality(_judged(d), _CHECKS)


@query("quality_by_kind", f"SELECT v AS kind, {_QUALITY} FROM (VALUES ('clean_control'), ('supported_defect'), ('unverified_concern')) x(v) LEFT JOIN ({_JUDGED}) ON kind = v GROUP BY v")
def quality_by_kind(d: Data) -> DataFrame:
    return op.quality(_judged(d), _CHECKS, ("clean_control", "supported_defect", "unverified_concern"))


@query("metric_deltas", "SELECT metric, a.mean - b.mean AS delta FROM (SELECT 'x' AS metric, avg(quality) AS mean FROM {labels} UNION ALL SELECT 'y', avg(toxic) FROM {labels}) a JOIN (SELECT 'y' AS metric, avg(p_size) AS mean FROM {part} UNION ALL SELECT 'z', 1) b USING (metric)")
def metric_deltas(d: Data) -> DataFrame:
    now = operators.metric_summary(d.table("labels").select(F.col("quality").alias("x"), F.col("toxic").alias("y")), ["x", "y"])
    then = operators.metric_summary(d.table("part").select(F.col("p_size").alias("y"), F.col("p_partkey").alias("z")), ["y", "z"])
    return op.deltas(now, then)


_RECORDED = """SELECT CASE c_custkey % 4 WHEN 0 THEN '{{broken' WHEN 1 THEN '[1]' ELSE concat('{{"s', CAST(c_custkey AS STRING), '":{{"recall":0.', CAST(10 + c_nationkey AS STRING), ',"n":', CAST(c_custkey AS STRING), ',"why":"x","none":null}},"flat":3}}') END AS text FROM {customer}"""


@query("baseline", "SELECT 's' || c_custkey AS suite, 'recall' AS metric, (10 + c_nationkey) / 100 AS value FROM {customer} WHERE c_custkey % 4 > 1 UNION ALL SELECT 's' || c_custkey, 'n', c_custkey FROM {customer} WHERE c_custkey % 4 > 1")
def baseline(d: Data) -> DataFrame:
    return op.baseline(d(_RECORDED))
