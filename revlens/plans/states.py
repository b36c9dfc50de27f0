"""Queries of durable state, publishing and history."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revlens import sinks
from revlens.plans.inputs import Data, query
from revlens.streaming import state as op

_STORED = "SELECT CAST(c_nationkey AS STRING) AS key, collected AS fingerprints, 'old' AS head_sha, CAST(c_nationkey % 3 AS STRING) AS digest, 'told' AS overview FROM (SELECT c_nationkey, {agg} AS collected FROM {{customer}} GROUP BY c_nationkey)"
_RUN = "SELECT CAST(s_nationkey AS STRING) AS key, collected AS fingerprints, 'new' AS head_sha, CASE WHEN s_nationkey % 5 = 0 THEN '' ELSE CAST(s_nationkey % 2 AS STRING) END AS digest, CASE WHEN s_nationkey % 4 = 0 THEN 'retold' END AS overview FROM (SELECT s_nationkey, {agg} AS collected FROM {{supplier}} GROUP BY s_nationkey)"
_SPARK = {"c": "collect_set(c_mktsegment)", "s": "collect_set(substr(s_name, -1))"}
_DUCK = {"c": "list_distinct(list(c_mktsegment))", "s": "list_distinct(list(substr(s_name, -1)))"}
_MOVED = "(coalesce(n.digest, '') <> '' AND n.digest IS DISTINCT FROM o.digest)"


@query(
    "review_record",
    f"""SELECT coalesce(o.key, n.key) AS key, array_to_string(list_sort(list_distinct(list_concat(coalesce(o.fingerprints, []), coalesce(n.fingerprints, [])))), ',') AS fingerprints, coalesce(n.head_sha, o.head_sha) AS head_sha,
CASE WHEN {_MOVED} THEN n.digest ELSE o.digest END AS digest, coalesce(n.overview, CASE WHEN NOT {_MOVED} THEN o.overview END) AS overview FROM ({_STORED.format(agg=_DUCK['c'])}) o FULL JOIN ({_RUN.format(agg=_DUCK['s'])}) n ON o.key = n.key""",
)
def review_record(d: Data) -> DataFrame:
    out = op.record(d(_STORED.format(agg=_SPARK["c"])), d(_RUN.format(agg=_SPARK["s"])))
    return out.withColumn("fingerprints", F.array_join("fingerprints", ","))


_OLD_ENTRIES = "SELECT concat('fp', CAST(o_custkey AS STRING)) AS fingerprint, min(o_orderstatus) AS verdict, max(o_orderdate) AS recorded_at FROM {orders} GROUP BY o_custkey"
_NEW_ENTRIES = "SELECT concat('fp', CAST(user_id AS STRING)) AS fingerprint, event_type AS verdict, ts AS recorded_at, event_id AS arrival FROM {events}"


@query(
    "feedback_newest",
    f"""SELECT fingerprint, verdict FROM (SELECT *, row_number() OVER (PARTITION BY fingerprint ORDER BY recorded_at DESC, arrival DESC) AS n FROM (SELECT *, -1 AS arrival FROM ({_OLD_ENTRIES}) UNION ALL SELECT * FROM ({_NEW_ENTRIES}))) WHERE n = 1 ORDER BY recorded_at DESC, fingerprint LIMIT 50""",
)
def feedback_newest(d: Data) -> DataFrame:
    return op.record_feedback(d(_OLD_ENTRIES), d(_NEW_ENTRIES), 50).select("fingerprint", "verdict")


_DONE = "SELECT CAST(o_custkey % 20 AS STRING) AS key, CASE WHEN o_custkey % 20 < 5 THEN 'b' ELSE 'a' END AS signature, CAST(o_orderkey % 300 AS STRING) AS identity, max(o_orderstatus) = 'P' AS completed, min(o_orderpriority) AS detail FROM {orders} GROUP BY 1, 2, 3"
_NOW = "SELECT CAST(user_id % 15 AS STRING) AS key, 'a' AS signature, CAST(event_id % 300 AS STRING) AS identity, max(event_type) = 'view' AS completed, min(event_type) AS detail FROM {events} GROUP BY 1, 2, 3"


@query(
    "checkpoint_merge",
    f"""WITH o AS ({_DONE}), n AS ({_NOW}), kept AS (SELECT * FROM o WHERE key NOT IN (SELECT key FROM n) OR signature = 'a')
SELECT key, signature, identity, completed, detail FROM (SELECT *, row_number() OVER (PARTITION BY key, signature, identity ORDER BY completed DESC, late DESC) AS p FROM (SELECT *, 0 AS late FROM kept UNION ALL SELECT *, 1 FROM n)) WHERE p = 1""",
)
def checkpoint_merge(d: Data) -> DataFrame:
    return op.save_checkpoint(d(_DONE), d(_NOW))


@query("overview_reuse", "SELECT CAST(o_orderkey AS STRING) AS key, coalesce(md5(o_orderstatus) = md5(l_linestatus), FALSE) AS reuse FROM {orders} LEFT JOIN (SELECT l_orderkey, min(l_linestatus) AS l_linestatus FROM {lineitem} GROUP BY l_orderkey) ON l_orderkey = o_orderkey")
def overview_reuse(d: Data) -> DataFrame:
    cached = d("SELECT CAST(l_orderkey AS STRING) AS key, md5(min(l_linestatus)) AS digest, 'x' AS overview FROM {lineitem} GROUP BY l_orderkey")
    return op.is_fresh(cached, d("SELECT CAST(o_orderkey AS STRING) AS key, md5(o_orderstatus) AS digest FROM {orders}"))


_COMMITS = "SELECT concat('sha', CAST(event_id AS STRING)) AS sha, event_id AS ordinal, CAST(user_id % 30 AS STRING) AS path FROM {events}"
_THREADS = "SELECT s_suppkey AS thread, CAST(s_nationkey AS STRING) AS path, concat('sha', CAST(s_suppkey * 3 AS STRING)) AS anchor, concat('sha', CAST(s_suppkey * 3 + 400 AS STRING)) AS head FROM {supplier}"


@query(
    "commits_touching",
    f"""WITH c AS ({_COMMITS}), t AS (SELECT t.*, a.ordinal AS low, h.ordinal AS high FROM ({_THREADS}) t LEFT JOIN c a ON a.sha = anchor LEFT JOIN c h ON h.sha = head)
SELECT thread, CASE WHEN any_value(low) IS NOT NULL AND any_value(high) IS NOT NULL THEN coalesce(string_agg(c.sha, ',' ORDER BY c.ordinal), '') END AS shas FROM t LEFT JOIN c ON c.path = t.path AND c.ordinal > low AND c.ordinal <= high GROUP BY thread""",
)
def commits_touching(d: Data) -> DataFrame:
    return op.touching(d(_COMMITS), d(_THREADS)).withColumn("shas", F.when(F.col("shas").isNotNull(), F.array_join("shas", ",")))


@query("status_upsert", "SELECT coalesce(s_nationkey, c) AS key, CASE WHEN s_nationkey IS NULL THEN 'kept' WHEN c IS NULL THEN 'inserted' ELSE 'updated' END AS action, coalesce(n, m) AS n FROM (SELECT s_nationkey, count(*) AS n FROM {supplier} GROUP BY 1) FULL JOIN (SELECT c_nationkey AS c, count(*) AS m FROM {customer} GROUP BY 1) ON c = s_nationkey")
def status_upsert(d: Data) -> DataFrame:
    stored = d.table("customer").groupBy(F.col("c_nationkey").alias("key")).agg(F.count("*").alias("n"))
    return sinks.upsert(stored, d.table("supplier").groupBy(F.col("s_nationkey").alias("key")).agg(F.count("*").alias("n")), ["key"])


_COMMENTS = "SELECT user_id AS key, event_id AS fingerprint FROM {events}"
_REJECTED = "SELECT o_custkey AS key, o_orderkey AS fingerprint FROM {orders} WHERE o_orderstatus = 'P'"


@query("batch_delivery", f"SELECT key, fingerprint, CASE WHEN key IN (SELECT key FROM ({_REJECTED})) THEN 'failed' ELSE 'posted' END AS state FROM ({_COMMENTS})")
def batch_delivery(d: Data) -> DataFrame:
    return sinks.delivered(d(_COMMENTS), d(_REJECTED), True)


@query("row_delivery", f"SELECT key, fingerprint, CASE WHEN EXISTS (SELECT 1 FROM ({_REJECTED}) r WHERE r.key = c.key AND r.fingerprint = c.fingerprint) THEN 'failed' ELSE 'posted' END AS state FROM ({_COMMENTS}) c")
def row_delivery(d: Data) -> DataFrame:
    return sinks.delivered(d(_COMMENTS), d(_REJECTED), False)


@query("resolution_steps", "SELECT o_orderkey AS thread, CASE WHEN o_custkey NOT IN (SELECT s_suppkey FROM {supplier}) THEN 'reply' WHEN o_orderstatus <> 'F' THEN 'resolve' ELSE 'done' END AS step FROM {orders}")
def resolution_steps(d: Data) -> DataFrame:
    threads = d("SELECT o_orderkey AS thread, o_orderstatus = 'F' AS resolved, o_custkey FROM {orders}")
    replied = threads.join(d("SELECT s_suppkey AS o_custkey FROM {supplier}"), "o_custkey", "left_semi")
    return sinks.resolutions(threads, replied)


@query("plan_signature", "SELECT doc_id, sha256('{{{{\"budget\":100,\"text\":\"' || md5(text) || '\"}}}}') AS signature FROM {documents}".replace("{{{{", "{{").replace("}}}}", "}}"))
def plan_signature(d: Data) -> DataFrame:
    return d.table("documents").select("doc_id", op.signature({"text": F.md5("text"), "budget": F.lit(100)}).alias("signature"))


#: A state file for each customer: of the version that is read, of another, or broken.
_STATES = """SELECT c_custkey AS id, CASE c_custkey % 5 WHEN 0 THEN concat('{{"version":2,"reviews":{{"k', CAST(c_custkey AS STRING), '":{{}}}}}}') WHEN 1 THEN '{{"version":1,"revi' WHEN 2 THEN '[1]'
ELSE concat('{{"version":1,"reviews":{{"k', CAST(c_custkey AS STRING), '":{{"fingerprints":["', c_mktsegment, '","a","a"],"digest":"d', CAST(c_nationkey AS STRING), '"}},"odd', CAST(c_custkey AS STRING), '":', CASE WHEN c_nationkey % 2 = 0 THEN '7' ELSE '{{"head_sha":"h"}}' END, '}}}}') END AS text FROM {customer}"""


@query(
    "stored_reviews",
    """SELECT 'k' || c_custkey AS key, c_mktsegment || ',a' AS fingerprints, '' AS head_sha, 'd' || c_nationkey AS digest FROM {customer} WHERE c_custkey % 5 > 2 UNION ALL SELECT 'odd' || c_custkey, '', 'h', '' FROM {customer} WHERE c_custkey % 5 > 2 AND c_nationkey % 2 = 1""",
)
def stored_reviews(d: Data) -> DataFrame:
    return op.stored_reviews(d(_STATES)).select("key", F.array_join("fingerprints", ",").alias("fingerprints"), "head_sha", "digest")


_KEPT_STATE = "SELECT CAST(c_custkey AS STRING) AS key, c_mktsegment AS told FROM {customer}"
_COMING = "SELECT CAST(o_custkey AS STRING) AS key, min(o_orderpriority) AS told FROM {orders} WHERE o_orderkey % 5 = 0 GROUP BY o_custkey"


@query("state_overlay", f"WITH c AS ({_COMING}) SELECT key, told FROM ({_KEPT_STATE}) WHERE key NOT IN (SELECT key FROM c) AND key <> '7' UNION ALL SELECT key, told FROM c WHERE key <> '7'")
def state_overlay(d: Data) -> DataFrame:
    """What a run sees of a state that it couldn't write, after one key was cleared."""
    return op.cleared(op.overlay(d(_KEPT_STATE), d(_COMING), "key"), "7")
