"""Queries of budgets, relations and spans."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revlens.operators import graph
from revlens.operators import packing as op
from revlens.plans.inputs import Data, query

#: Turns as items of one plan: pairs of turns are a group; costs are small numbers.
_ITEMS = "SELECT conv_id, turn, CAST(floor(turn / 2) AS BIGINT) AS pair, CAST(length(text) % 50 AS BIGINT) AS cost FROM {conversations}"
_NUMBERED = f"SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n, row_number() OVER (PARTITION BY conv_id, pair ORDER BY turn) = 1 AS lead, sum(cost) OVER (PARTITION BY conv_id, pair) + count(*) OVER (PARTITION BY conv_id, pair) - 1 AS total FROM ({_ITEMS})"


@query(
    "greedy_pack",
    f"""WITH RECURSIVE i AS ({_NUMBERED}), w AS (SELECT conv_id, turn, n, 1 AS bin, cost AS used FROM i WHERE n = 1 UNION ALL
SELECT i.conv_id, i.turn, i.n, w.bin + CASE WHEN (lead AND used + 1 + total > 80) OR used + 1 + cost > 80 THEN 1 ELSE 0 END,
CASE WHEN (lead AND used + 1 + total > 80) OR used + 1 + cost > 80 THEN cost ELSE used + 1 + cost END FROM w JOIN i ON i.conv_id = w.conv_id AND i.n = w.n + 1)
SELECT conv_id, turn, bin FROM w""",
)
def greedy_pack(d: Data) -> DataFrame:
    return op.pack(d(_ITEMS), "conv_id", "turn", "pair", "cost", 80, F.col("turn"))


@query(
    "greedy_knapsack",
    f"""WITH RECURSIVE i AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY cost DESC, turn) AS n FROM ({_ITEMS})),
w AS (SELECT conv_id, turn, n, cost <= 90 AS kept, CASE WHEN cost <= 90 THEN cost ELSE -1 END AS used FROM i WHERE n = 1 UNION ALL
SELECT i.conv_id, i.turn, i.n, used + 1 + cost <= 90, CASE WHEN used + 1 + cost <= 90 THEN used + 1 + cost ELSE used END FROM w JOIN i ON i.conv_id = w.conv_id AND i.n = w.n + 1)
SELECT conv_id, turn, kept FROM w""",
)
def greedy_knapsack(d: Data) -> DataFrame:
    return op.keep_fitting(d(_ITEMS), "conv_id", "turn", "cost", 90, -F.col("cost"), F.col("turn"))


@query(
    "recent_budget",
    """WITH RECURSIVE i AS (SELECT conv_id, turn, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM {conversations}),
c AS (SELECT * FROM i WHERE n <= 4), w AS (SELECT conv_id, turn, n, cut AS text, 700 - length(cut) AS rest FROM (SELECT *, CASE WHEN length(text) <= 300 THEN text ELSE rtrim(substr(text, 1, 296)) || ' […]' END AS cut FROM c WHERE n = 1)
UNION ALL SELECT conv_id, turn, n, cut, rest - length(cut) FROM (SELECT c.conv_id, c.turn, c.n, w.rest, CASE WHEN length(c.text) <= least(300, w.rest) THEN c.text WHEN least(300, w.rest) <= 4 THEN substr(c.text, 1, least(300, w.rest))
ELSE rtrim(substr(c.text, 1, CAST(least(300, w.rest) - 4 AS BIGINT))) || ' […]' END AS cut FROM w JOIN c ON c.conv_id = w.conv_id AND c.n = w.n + 1 WHERE w.rest > 0))
SELECT conv_id, turn, text FROM w""",
)
def recent_budget(d: Data) -> DataFrame:
    return op.latest_within(d("SELECT conv_id, turn, text FROM {conversations}"), "conv_id", "text", 4, 300, 700, F.col("turn"))


@query("tail_cut", "SELECT doc_id, right(array_to_string(list_slice(string_split(text, chr(10)), greatest(len(string_split(text, chr(10))) - 2, 1), len(string_split(text, chr(10)))), chr(10)), 400) AS tail FROM {documents}")
def tail_cut(d: Data) -> DataFrame:
    return d.table("documents").select("doc_id", op.tail(F.col("text"), 3, 400).alias("tail"))


_LINES = "SELECT o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n, o_orderkey, o_custkey % 9 + 1 AS at FROM {orders}"


@query("line_window", f"SELECT o_custkey, n FROM ({_LINES.replace(' AS at ', ' AS spot ')}) WHERE n BETWEEN greatest(spot - 2, 1) AND spot + 3 AND n < greatest(spot - 2, 1) + 4")
def line_window(d: Data) -> DataFrame:
    return op.window_of(d(_LINES), "o_custkey", "n", F.col("at"), F.col("at") + 1, 2, 4).select("o_custkey", F.col("n").cast("long").alias("n"))


@query(
    "largest_prefix",
    f"""SELECT conv_id, count(*) FILTER (WHERE t <= 100) AS items, coalesce(max(t) FILTER (WHERE t <= 100), 0)::BIGINT AS cost, count(*) FILTER (WHERE t <= 100) = 0 AS too_large
FROM (SELECT conv_id, sum(cost + 1) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) - 1 AS t FROM ({_ITEMS})) GROUP BY conv_id""",
)
def largest_prefix(d: Data) -> DataFrame:
    return op.largest_prefix(d(_ITEMS), "conv_id", "cost", 100, F.col("turn"))


_NODES = "SELECT conv_id, turn, CAST(length(role) AS BIGINT) AS base, CAST(length(text) % 40 AS BIGINT) AS extra FROM {conversations}"


@query(
    "shed_extras",
    f"""WITH n AS (SELECT *, sum(base + extra) OVER (PARTITION BY conv_id) AS everything, sum(base) OVER (PARTITION BY conv_id) AS bare, coalesce(sum(extra) OVER (PARTITION BY conv_id ORDER BY turn DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS shed,
sum(base) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS ahead FROM ({_NODES}))
SELECT conv_id, turn, CASE WHEN everything - shed <= 60 THEN 'whole' WHEN bare <= 60 OR ahead <= 60 THEN 'bare' ELSE 'gone' END AS state FROM n""",
)
def shed_extras(d: Data) -> DataFrame:
    return op.shed(d(_NODES), "conv_id", "base", "extra", 60, F.col("turn")).select("conv_id", "turn", "state")


@query("pending_units", "SELECT doc_id FROM {documents} WHERE doc_id NOT IN (SELECT doc_id FROM {labels}) ORDER BY n_chars DESC, doc_id LIMIT 12")
def pending_units(d: Data) -> DataFrame:
    return op.pending(d.table("documents"), d.table("labels"), "doc_id", 12, F.desc("n_chars"), F.col("doc_id")).select("doc_id")


#: Events next to each other are related where both are of one type, so runs of a type are the components.
_RUN_NODES = "SELECT event_id AS id FROM {events}"
_RUN_EDGES = "SELECT e.event_id AS a, f.event_id AS b FROM {events} AS e JOIN {events} AS f ON f.event_id = e.event_id + 1 AND f.event_type = e.event_type"


@query("components", "SELECT event_id AS id, min(event_id) OVER (PARTITION BY run) AS component FROM (SELECT event_id, sum(CASE WHEN event_type = before THEN 0 ELSE 1 END) OVER (ORDER BY event_id) AS run FROM (SELECT event_id, event_type, lag(event_type) OVER (ORDER BY event_id) AS before FROM {events}))")
def components(d: Data) -> DataFrame:
    return graph.components(d(_RUN_NODES), d(_RUN_EDGES))


_TERMS = "SELECT DISTINCT lang AS term FROM {documents} UNION SELECT DISTINCT r_name AS term FROM {region} UNION SELECT 'the' AS term UNION SELECT 'de' AS term"


@query("token_join", rf"SELECT doc_id, word AS term FROM (SELECT doc_id, unnest(list_distinct(regexp_extract_all(text, '[\p{{{{L}}}}_$][\p{{{{L}}}}\p{{{{N}}}}_$]*'))) AS word FROM {{documents}}) WHERE word IN (SELECT term FROM ({_TERMS}))")
def token_join(d: Data) -> DataFrame:
    return graph.mentions(d(_TERMS), d("SELECT doc_id, text FROM {documents}"), "text").select("doc_id", "term")


@query("top_hits", "SELECT p_brand, p_partkey, nth, truncated FROM (SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_size, p_partkey) AS nth, count(*) OVER (PARTITION BY p_brand) > 5 AS truncated FROM {part}) WHERE nth <= 5")
def top_hits(d: Data) -> DataFrame:
    return graph.top_hits(d.table("part"), "p_brand", 5, F.col("p_size"), F.col("p_partkey")).select("p_brand", "p_partkey", F.col("nth").cast("long").alias("nth"), "truncated")


_SYMBOLS = "SELECT p_partkey AS id, concat('src/m', CAST(p_size % 45 AS STRING), '.py') AS file, CAST(p_partkey * 3 % 5000 AS BIGINT) AS start_line, CAST(p_partkey * 3 % 5000 + p_size AS BIGINT) AS end_line FROM {part}"
_LINES_CHANGED = "SELECT DISTINCT concat('src/m', CAST(o_custkey % 42 AS STRING), '.py') AS file, CAST(o_orderkey % 5000 + 1 AS BIGINT) AS line FROM {orders}"


@query("touched_symbols", f"SELECT id FROM ({_SYMBOLS}) s WHERE EXISTS (SELECT 1 FROM ({_LINES_CHANGED}) c WHERE c.file = s.file AND line BETWEEN start_line AND end_line)")
def touched_symbols(d: Data) -> DataFrame:
    return graph.touched(d(_SYMBOLS), d(_LINES_CHANGED)).select("id")


_ONE = "SELECT s_nationkey AS code, 'symbol' AS kind, s_suppkey AS pos, s_name AS told FROM {supplier}"
_TWO = "SELECT c_nationkey AS code, 'symbol' AS kind, c_custkey AS pos, c_name AS told FROM {customer}"


@query("first_of_each", f"SELECT code, kind, told FROM (SELECT *, row_number() OVER (PARTITION BY code, kind ORDER BY source, pos) AS n FROM (SELECT *, 0 AS source FROM ({_ONE}) UNION ALL SELECT *, 1 FROM ({_TWO}))) WHERE n = 1")
def first_of_each(d: Data) -> DataFrame:
    return graph.first_of_each([d(_ONE), d(_TWO)], ["code", "kind"]).select("code", "kind", "told")


#: Turns as files of a plan by pairs; the cost is that of the joined text, in tokens.
_TEXTS = "SELECT conv_id, turn, CAST(floor(turn / 2) AS BIGINT) AS pair, CAST(length(text) AS BIGINT) AS chars FROM {conversations}"
_TEXT_ROWS = f"SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n, row_number() OVER (PARTITION BY conv_id, pair ORDER BY turn) = 1 AS lead, sum(chars) OVER (PARTITION BY conv_id, pair) + 2 * (count(*) OVER (PARTITION BY conv_id, pair) - 1) AS total FROM ({_TEXTS})"


@query(
    "joined_pack",
    f"""WITH RECURSIVE i AS ({_TEXT_ROWS}), w AS (SELECT conv_id, turn, n, 1 AS bin, chars AS used FROM i WHERE n = 1 UNION ALL
SELECT i.conv_id, i.turn, i.n, w.bin + CASE WHEN (lead AND (used + 2 + total) // 4 > 250) OR (used + 2 + chars) // 4 > 250 THEN 1 ELSE 0 END,
CASE WHEN (lead AND (used + 2 + total) // 4 > 250) OR (used + 2 + chars) // 4 > 250 THEN chars ELSE used + 2 + chars END FROM w JOIN i ON i.conv_id = w.conv_id AND i.n = w.n + 1)
SELECT conv_id, turn, bin FROM w""",
)
def joined_pack(d: Data) -> DataFrame:
    return op.pack(d(_TEXTS), "conv_id", "turn", "pair", "chars", op.budget_of(250), F.col("turn"), joint=2)


#: Orders of a customer as the lines of a hunk: some changed, some not; long ones are cut into pieces.
_HUNK = "SELECT o_custkey AS id, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS BIGINT) AS pos, CASE o_orderkey % 4 WHEN 0 THEN '+' WHEN 1 THEN '-' ELSE ' ' END AS mark, CAST(o_orderkey % 37 + 1 AS BIGINT) AS size FROM {orders}"


@query(
    "hunk_fragments",
    f"""WITH RECURSIVE l AS (SELECT *, sum(size) OVER w AS upto, sum(size) OVER (PARTITION BY id) AS whole, max(mark <> ' ') OVER (PARTITION BY id) AS alters, row_number() OVER (PARTITION BY id, mark <> ' ' ORDER BY pos) AS nth FROM ({_HUNK}) WINDOW w AS (PARTITION BY id ORDER BY pos)),
c AS (SELECT * FROM l WHERE mark <> ' ' AND whole + 8 > 60 AND alters),
g AS (SELECT id, pos, nth, upto, size, 1 AS fragment, upto - size AS base FROM c WHERE nth = 1 UNION ALL SELECT c.id, c.pos, c.nth, c.upto, c.size, fragment + CASE WHEN c.upto - base + 8 > 60 THEN 1 ELSE 0 END, CASE WHEN c.upto - base + 8 > 60 THEN c.upto - c.size ELSE base END FROM g JOIN c ON c.id = g.id AND c.nth = g.nth + 1),
p AS (SELECT id, fragment, min(pos) AS s, max(pos) AS e, max(upto) - min(upto - size) + 8 AS own FROM g GROUP BY id, fragment),
b AS (SELECT id, fragment, s, e, own, 0 AS k, own AS cost FROM p UNION ALL SELECT b.id, fragment, s, e, own, k + 1, cost + l.size FROM b JOIN l ON l.id = b.id AND l.pos = b.s - k - 1 WHERE k < 3 AND own <= 60 AND l.mark = ' ' AND cost + l.size <= 60),
bb AS (SELECT *, row_number() OVER (PARTITION BY id, fragment ORDER BY k DESC) AS r FROM b),
a AS (SELECT id, fragment, s, e, own, k, 0 AS m, cost FROM bb WHERE r = 1 UNION ALL SELECT a.id, fragment, s, e, own, k, m + 1, cost + l.size FROM a JOIN l ON l.id = a.id AND l.pos = a.e + m + 1 WHERE m < 3 AND own <= 60 AND l.mark = ' ' AND cost + l.size <= 60),
aa AS (SELECT *, row_number() OVER (PARTITION BY id, fragment ORDER BY m DESC) AS r FROM a)
SELECT id, fragment, s - k AS first, e + m AS last, s AS from_, e AS to_, cost::BIGINT AS cost, own > 60 AS too_large FROM aa WHERE r = 1
UNION ALL SELECT id, 1, min(pos), max(pos), min(pos) FILTER (WHERE mark <> ' '), max(pos) FILTER (WHERE mark <> ' '), (any_value(whole) + 8)::BIGINT, FALSE FROM l WHERE whole + 8 <= 60 OR NOT alters GROUP BY id""",
)
def hunk_fragments(d: Data) -> DataFrame:
    return op.fragments(d(_HUNK), ["id"], "size", 60, head=8).withColumnRenamed("to", "to_")
