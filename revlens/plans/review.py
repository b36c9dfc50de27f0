"""Review operators over the driver's tables; SQL holds the DuckDB form of each."""

from __future__ import annotations

from pyspark.sql import functions as F

from revlens import operators as op
from revlens.operators import relations

_EVENTS = ["click", "purchase", "view", "error", "never_seen"]


def _t(spark, d, name):
    return spark.read.parquet(f"{d}/{name}.parquet")


def _scored(s, d):
    return _t(s, d, "labels").join(_t(s, d, "documents").select("doc_id", "lang", "n_chars"), "doc_id").select("lang", (F.col("quality") == 1).alias("expected"), (F.col("n_chars") > 1000).alias("found"))


def _before(s, d):
    return _t(s, d, "part").select(F.col("p_partkey").alias("k"), F.col("p_size").alias("v"))


def _after(s, d):
    """The part numbers that were ordered, each with its least line number as value."""
    return _t(s, d, "lineitem").groupBy(F.col("l_partkey").alias("k")).agg(F.min("l_linenumber").alias("v"))


QUERIES = {
    "dedupe_keep_best": lambda s, d: _t(s, d, "documents").groupBy(F.sha2("text", 256)).agg(F.min_by(F.struct("doc_id", "n_chars"), "doc_id").alias("r")).select("r.*"),
    "topk": lambda s, d: op.top_k(_t(s, d, "part"), ["p_brand"], 3, F.desc("p_retailprice"), F.asc("p_partkey")).select("p_brand", "p_partkey", "rank"),
    "newest_wins": lambda s, d: op.newest_wins(_t(s, d, "events").select("user_id", "event_id", "event_type", "ts"), ["user_id"], F.col("ts"), F.col("event_id")).select("user_id", "event_id", "event_type"),
    "zero_fill_counts": lambda s, d: op.zero_filled(_t(s, d, "events"), "event_type", _EVENTS),
    "snapshot_diff": lambda s, d: op.snapshot_diff(_before(s, d), _after(s, d), "k", "v"),
    "worst_of": lambda s, d: op.worst_of(_t(s, d, "orders"), "o_custkey", "o_orderstatus", {"F": 0, "P": 1, "O": 2}),
    "ordered_distinct": lambda s, d: op.ordered_distinct(_t(s, d, "events"), "user_id", "event_type", "ts"),
    "eval_score": lambda s, d: op.rates(_scored(s, d)),
    "eval_by_kind": lambda s, d: op.rates(_scored(s, d), ["lang"]),
    "gate": lambda s, d: op.rates(_scored(s, d)).select((F.coalesce("recall", F.lit(1.0)) >= 0.8).alias("recall_ok"), (F.coalesce("false_positive_rate", F.lit(0.0)) <= 0.1).alias("clean_ok")),
    "prefix_budget": lambda s, d: op.prefix_budget(_t(s, d, "conversations").select("conv_id", "turn", F.length("text").cast("long").alias("cost")), "conv_id", "cost", 2000, F.col("turn")).select("conv_id", "turn", "spent"),
    "nearest_snap": lambda s, d: op.nearest_before(_t(s, d, "events"), "user_id", "ts", F.col("event_type") == "purchase", "event_id").select("event_id", "nearest"),
    "seen_antijoin": lambda s, d: op.unseen(_t(s, d, "benchmark"), _t(s, d, "documents").join(_t(s, d, "benchmark").select("text").distinct(), "text", "left_semi"), "text").select("item_id"),
    "resume_merge": lambda s, d: op.merged(_t(s, d, "documents").select("doc_id", F.lit(-1).alias("quality")), _t(s, d, "labels").select("doc_id", "quality"), "doc_id", "quality"),
    "fingerprint": lambda s, d: _t(s, d, "documents").select("doc_id", F.substring(F.sha2(F.concat_ws("|", *[F.coalesce(c, F.lit("")) for c in ("source", "lang", "text")]), 256), 1, 16).alias("fingerprint")),
    "conditional_demote": lambda s, d: _t(s, d, "events").select("event_id", F.when((F.col("event_type") == "error") & (F.col("value") < 50), "minor").when(F.col("event_type") == "error", "critical").otherwise("info").alias("severity")),
    "glob_filter": lambda s, d: _t(s, d, "pages").where(F.col("url").rlike(r"^https?://[^/]+/(en|de)/[^/]+\.html$")).select("page_id", "url"),
    "division": lambda s, d: relations.complete(_t(s, d, "lineitem").select("l_orderkey", "l_shipdate"), _t(s, d, "lineitem").where(F.col("l_shipdate") < F.lit("1997-01-01").cast("timestamp")).select("l_shipdate"), "l_orderkey", ["l_shipdate"]),
    "first_reason_counts": lambda s, d: _t(s, d, "documents").select(F.when(F.col("n_chars") < 200, "short").when(F.col("n_chars") > 5000, "long").when(F.col("lang") != "en", "language").otherwise("none").alias("reason"), "text").groupBy("reason").agg(F.count("*").alias("n"), F.countDistinct("text").alias("distinct_texts")),
}


def _hashes(s, d):
    return _t(s, d, "benchmark").select(F.sha2("text", 256).alias("name"))


QUERIES |= {
    "nearest_within": lambda s, d: op.nearest_within(_t(s, d, "events").select("user_id", "event_id", "event_type"), "user_id", "event_id", F.col("event_type") == "error", 300).select("event_id", "anchor"),
    "enclosing_span": lambda s, d: op.smallest_containing(_t(s, d, "supplier"), _t(s, d, "part").select(F.col("p_partkey").alias("a"), (F.col("p_partkey") + F.col("p_size")).alias("b")), "s_suppkey", "a", "b", 40),
    "metric_summary": lambda s, d: op.metric_summary(_t(s, d, "labels").select("quality", "toxic", F.lit(None).cast("double").alias("never")), ["quality", "toxic", "never"]),
    "drift": lambda s, d: op.drift(_t(s, d, "orders").select(F.col("o_orderkey").alias("k"), "o_totalprice"), _t(s, d, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.bool_or(F.col("l_returnflag") == "R").alias("direct"), F.max("l_extendedprice").alias("most")), "k", F.col("most") <= F.col("o_totalprice")),
    "unseen_by_either": lambda s, d: op.unseen_by_either(_t(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"), _t(s, d, "nation"), ["l_partkey", "l_suppkey"], "n_nationkey").select("l_orderkey", "l_linenumber"),
    "unique_prefix": lambda s, d: op.unique_prefix(_hashes(s, d).select(F.substring("name", 1, 2).alias("prefix")), _hashes(s, d), "prefix", "name", 2),
    "running_numbers": lambda s, d: op.running_numbers(_t(s, d, "conversations").select("conv_id", "turn", "role"), "conv_id", "turn", F.col("role") == "user").select("conv_id", "turn", "new_line"),
    "around_changes": lambda s, d: op.around_changes(_t(s, d, "events").select("user_id", "event_id", "event_type"), "user_id", "event_id", F.col("event_type") == "error", 2).select("event_id"),
    "ordered_digest": lambda s, d: op.ordered_digest(_t(s, d, "lineitem").select("l_orderkey", "l_linenumber", F.concat("l_returnflag", "l_linestatus").alias("line")), "l_orderkey", "l_linenumber", "line"),
    "listed": lambda s, d: op.listed(_t(s, d, "documents").select("source", "lang"), "source", "lang", 2),
}

_SCORED = "(SELECT lang, quality = 1 AS expected, n_chars > 1000 AS found FROM labels JOIN documents USING (doc_id))"
_RATES = "count(*) AS n, count(*) FILTER (WHERE expected AND found)::DOUBLE / nullif(count(*) FILTER (WHERE expected), 0) AS recall, count(*) FILTER (WHERE NOT expected AND found)::DOUBLE / nullif(count(*) FILTER (WHERE NOT expected), 0) AS false_positive_rate"
SQL = {
    "dedupe_keep_best": "SELECT doc_id, n_chars FROM (SELECT doc_id, n_chars, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS k FROM documents) WHERE k = 1",
    "topk": "SELECT p_brand, p_partkey, rank FROM (SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS rank FROM part) WHERE rank <= 3",
    "newest_wins": "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k = 1",
    "zero_fill_counts": "SELECT v AS event_type, count(event_id) AS n FROM (VALUES ('click'), ('purchase'), ('view'), ('error'), ('never_seen')) AS x(v) LEFT JOIN events ON event_type = v GROUP BY v",
    "snapshot_diff": "WITH o AS (SELECT p_partkey AS k, p_size AS v FROM part), n AS (SELECT l_partkey AS k, min(l_linenumber) AS v FROM lineitem GROUP BY 1) SELECT coalesce(o.k, n.k) AS k, CASE WHEN o.k IS NULL THEN 'added' WHEN n.k IS NULL THEN 'removed' ELSE 'changed' END AS kind, o.v AS old_value, n.v AS new_value FROM o FULL JOIN n ON o.k = n.k WHERE o.k IS NULL OR n.k IS NULL OR o.v IS DISTINCT FROM n.v",
    "worst_of": "SELECT o_custkey, CASE max(CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'P' THEN 1 WHEN 'O' THEN 2 END) WHEN 0 THEN 'F' WHEN 1 THEN 'P' WHEN 2 THEN 'O' END AS worst FROM orders GROUP BY o_custkey",
    "ordered_distinct": "SELECT user_id, string_agg(event_type, ',' ORDER BY first_ts, event_type) AS seen_values FROM (SELECT user_id, event_type, min(ts) AS first_ts FROM events GROUP BY user_id, event_type) GROUP BY user_id",
    "eval_score": f"SELECT {_RATES} FROM {_SCORED}",
    "eval_by_kind": f"SELECT lang, {_RATES} FROM {_SCORED} GROUP BY lang",
    "gate": f"SELECT coalesce(recall, 1) >= 0.8 AS recall_ok, coalesce(false_positive_rate, 0) <= 0.1 AS clean_ok FROM (SELECT {_RATES} FROM {_SCORED})",
    "prefix_budget": "SELECT conv_id, turn, spent FROM (SELECT conv_id, turn, CAST(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS BIGINT) AS spent FROM conversations) WHERE spent <= 2000",
    "nearest_snap": "SELECT event_id, last_value(CASE WHEN event_type = 'purchase' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS nearest FROM events",
    "seen_antijoin": "SELECT item_id FROM benchmark b WHERE NOT EXISTS (SELECT 1 FROM documents d WHERE d.text = b.text)",
    "resume_merge": "SELECT coalesce(l.doc_id, d.doc_id) AS doc_id, CAST(coalesce(l.quality, -1) AS INTEGER) AS quality, l.quality IS NOT NULL AS is_fresh FROM documents d FULL JOIN labels l ON d.doc_id = l.doc_id",
    "fingerprint": "SELECT doc_id, substr(sha256(coalesce(source, '') || '|' || coalesce(lang, '') || '|' || coalesce(text, '')), 1, 16) AS fingerprint FROM documents",
    "conditional_demote": "SELECT event_id, CASE WHEN event_type = 'error' AND value < 50 THEN 'minor' WHEN event_type = 'error' THEN 'critical' ELSE 'info' END AS severity FROM events",
    "glob_filter": r"SELECT page_id, url FROM pages WHERE regexp_matches(url, '^https?://[^/]+/(en|de)/[^/]+\.html$')",
    "division": "SELECT l_orderkey FROM lineitem GROUP BY l_orderkey HAVING bool_and(l_shipdate < TIMESTAMP '1997-01-01')",
    "first_reason_counts": "SELECT CASE WHEN n_chars < 200 THEN 'short' WHEN n_chars > 5000 THEN 'long' WHEN lang <> 'en' THEN 'language' ELSE 'none' END AS reason, count(*) AS n, count(DISTINCT text) AS distinct_texts FROM documents GROUP BY 1",
}
_HASHES = "(SELECT DISTINCT sha256(text) AS name FROM benchmark)"
SQL |= {
    "nearest_within": "SELECT event_id, CASE WHEN abs(x - event_id) <= 300 THEN x END AS anchor FROM (SELECT event_id, CASE WHEN a IS NULL OR event_id - b <= a - event_id THEN b ELSE a END AS x FROM (SELECT event_id, max(CASE WHEN event_type = 'error' THEN event_id END) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS b, min(CASE WHEN event_type = 'error' THEN event_id END) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS a FROM events))",
    "enclosing_span": "SELECT s_suppkey, p_partkey AS span_start, p_size AS span_length FROM (SELECT s_suppkey, p_partkey, p_size, row_number() OVER (PARTITION BY s_suppkey ORDER BY p_size, p_partkey) AS k FROM supplier LEFT JOIN part ON p_size BETWEEN 0 AND 40 AND s_suppkey BETWEEN p_partkey AND p_partkey + p_size) WHERE k = 1",
    "metric_summary": "SELECT metric, avg(value) AS mean, min(value) AS low, max(value) AS high FROM (SELECT 'quality' AS metric, quality::DOUBLE AS value FROM labels UNION ALL SELECT 'toxic', toxic::DOUBLE FROM labels) WHERE value IS NOT NULL GROUP BY metric",
    "drift": "WITH l AS (SELECT l_orderkey AS k, bool_or(l_returnflag = 'R') AS direct, max(l_extendedprice) AS most FROM lineitem GROUP BY 1) SELECT o_orderkey AS k, 'missing' AS kind FROM orders WHERE o_orderkey NOT IN (SELECT k FROM l) UNION ALL SELECT k, 'undeclared' FROM l WHERE direct AND k NOT IN (SELECT o_orderkey FROM orders) UNION ALL SELECT k, 'unsatisfied' FROM l JOIN orders ON o_orderkey = k WHERE NOT (most <= o_totalprice)",
    "unseen_by_either": "SELECT l_orderkey, l_linenumber FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM nation WHERE n_nationkey = l_partkey OR n_nationkey = l_suppkey)",
    "unique_prefix": f"SELECT substr(name, 1, 2) AS prefix, min(name) AS name FROM {_HASHES} GROUP BY 1 HAVING count(*) = 1",
    "running_numbers": "SELECT conv_id, turn, CASE WHEN role <> 'user' THEN CAST(sum(CASE WHEN role = 'user' THEN 0 ELSE 1 END) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS BIGINT) END AS new_line FROM conversations",
    "around_changes": "SELECT event_id FROM (SELECT event_id, bool_or(event_type = 'error') OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS near FROM events) WHERE near",
    "ordered_digest": "SELECT l_orderkey, substr(sha256(string_agg(l_returnflag || l_linestatus, chr(10) ORDER BY l_linenumber, l_returnflag || l_linestatus)), 1, 16) AS digest FROM lineitem GROUP BY l_orderkey",
    "listed": "SELECT source, n, names FROM (SELECT source, count(*) AS n FROM documents GROUP BY source) JOIN (SELECT source, string_agg(CASE WHEN k <= 2 THEN lang END, ', ' ORDER BY k) || CASE WHEN count(*) > 2 THEN ' and ' || (count(*) - 2) || ' more' ELSE '' END AS names FROM (SELECT source, lang, row_number() OVER (PARTITION BY source ORDER BY lang) AS k FROM (SELECT DISTINCT source, lang FROM documents)) GROUP BY source) USING (source)",
}
