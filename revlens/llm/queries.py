"""The thin queries opN_<name> over the driver's tables, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from revlens.llm import conversation_repair, decontaminate, filter_audit, html_extract, language, license_scan, line_dedup, mixing, near_dedup, order_minhash, quality, suffix_dedup, toxicity
from revlens.llm.common import table


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source"), max_times=3.0, share=1.0, weights=3)


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark")).select("doc_id", "items", (F.size("items") > 0).alias("contaminated"))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"), width=200)
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op7_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), min_docs=10, min_chars=1)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    out = toxicity.score_toxicity(docs, table(spark, sf_dir, "labels").where(~held).select("doc_id", F.col("toxic").alias("label")))
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(table(spark, sf_dir, "pages"), table(spark, sf_dir, "documents").select("text", "lang"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    out = quality.score_quality(docs, table(spark, sf_dir, "labels").where(~held).select("doc_id", F.col("quality").alias("label")))
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_dedup.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), width=4, percent=80)
    return out.select("doc_id", "n_shingles", "component_id", "kept")


def op9_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_minhash.fingerprints(table(spark, sf_dir, "documents"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents").select("doc_id", "text", "source"), table(spark, sf_dir, "labels"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    found = conversation_repair.repair(conversation_repair.damage(rows)).withColumnRenamed("conv_id", "_id")
    ids = rows.select("conv_id").distinct()
    every = ids.join(found, ids["conv_id"].eqNullSafe(found["_id"]), "left")
    counts = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return every.select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


def op13_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = license_scan.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def _templates_sql() -> str:
    """The licence templates as SQL rows: number, label, words, places of required words, whether bare."""
    row = lambda k, t: f"({k}, '{t.label}', {[w.decode() for w in t.words]}, {[q + 1 for q in t.must]}, {t.bare})"
    return "VALUES " + ", ".join(row(k, t) for k, t in enumerate(license_scan.templates()))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_language": op2_language,
    "op3_quality": op3_quality,
    "op10_near_dedup": op10_near_dedup,
    "op5_decontaminate": op5_decontaminate,
    "op6_suffix_dedup": op6_suffix_dedup,
    "op7_html_extract": op7_html_extract,
    "op9_order_minhash": op9_order_minhash,
    "op4_mixing": op4_mixing,
    "op8_line_dedup": op8_line_dedup,
    "op11_filter_audit": op11_filter_audit,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_license_scan": op13_license_scan,
}

ORACLE_SQL: dict[str, str] = {
    "op8_line_dedup": r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i
  FROM documents),
keyed AS (
  SELECT doc_id, i, line, translate(regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM lines),
frequent AS (SELECT k FROM keyed WHERE k <> '' GROUP BY k HAVING count(DISTINCT doc_id) >= 10),
marked AS (SELECT keyed.*, frequent.k IS NOT NULL AS drop FROM keyed LEFT JOIN frequent USING (k))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE drop) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT drop), '')) AS kept_sha256
FROM marked GROUP BY doc_id""",
    "op11_filter_audit": r"""
WITH words AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
good AS (SELECT doc_id, max(quality = 1) AS good, max(toxic = 1) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
masks AS (
  SELECT part, CASE WHEN len(w) < 200 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 2 ELSE 0 END
    + CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t) THEN 4 ELSE 0 END + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END
    + CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY t) THEN 16 ELSE 0 END AS m, coalesce(good, FALSE) AS good, coalesce(toxic, FALSE) AS toxic
  FROM words LEFT JOIN good USING (doc_id)),
n AS (SELECT part, m, count(*) AS n, count(*) FILTER (WHERE good) AS g, count(*) FILTER (WHERE toxic) AS x FROM masks GROUP BY part, m),
f AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) AS v(l, b)),
orders AS (
  SELECT concat(a.l, b.l, c.l, d.l, e.l) AS filter_order, [a.b, b.b, c.b, d.b, e.b] AS bits
  FROM f AS a, f AS b, f AS c, f AS d, f AS e WHERE a.b + b.b + c.b + d.b + e.b = 31 AND len(list_distinct([a.b, b.b, c.b, d.b, e.b])) = 5),
steps AS (SELECT filter_order, step, bits[step] AS bit, coalesce(list_sum(bits[1 : step - 1]), 0)::INTEGER AS before FROM orders, (SELECT unnest([1, 2, 3, 4, 5]) AS step)),
done AS (
  SELECT part, filter_order, step, bit, sum(CASE WHEN m & (before | bit) = 0 THEN n ELSE 0 END) AS kept,
    sum(CASE WHEN m & before = 0 AND m & bit > 0 THEN n ELSE 0 END) AS removed, sum(CASE WHEN m & before > 0 AND m & bit > 0 THEN n ELSE 0 END) AS redundant,
    sum(CASE WHEN m = bit THEN n ELSE 0 END) AS unique_fails, sum(CASE WHEN m & before = 0 AND m & bit > 0 THEN g ELSE 0 END) AS good_lost,
    sum(CASE WHEN m & before = 0 AND m & bit > 0 THEN x ELSE 0 END) AS toxic_lost
  FROM n, steps GROUP BY part, filter_order, step, bit)
SELECT part, filter_order, step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails,
  good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley
FROM done""",
    "op12_conversation_repair": r"""
WITH RECURSIVE keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    encode(concat(coalesce(conv_id::VARCHAR, ' '), ':', coalesce(turn::VARCHAR, ' '))) AS k FROM conversations),
fated AS (
  SELECT *, xor(list_reduce(flatten([[ord(chr(('0x' || hex(k)[2 * i - 1 : 2 * i])::INTEGER)), -1, -1, -1, -1, -1, -1, -1, -1] for i in range(1, octet_length(k) + 1)]),
    lambda c, x: CASE WHEN x >= 0 THEN xor(c, x::BIGINT) WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, 4294967295::BIGINT), 4294967295) % 20 AS fate
  FROM keyed),
damaged AS (
  SELECT conv_id, turn, CASE fate WHEN 4 THEN 'user' ELSE role END AS role, CASE fate WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(CASE fate WHEN 0 THEN [] WHEN 3 THEN [1, 2] ELSE [1] END) AS copy FROM fated),
ordered AS (
  SELECT *, row_number() OVER w AS i, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS nth, lag(substr(role, 1, 1)) OVER w AS earlier
  FROM damaged WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy)),
rows AS (
  SELECT *, substr(role, 1, 1) AS initial,
    CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'b' WHEN nth > 1 THEN 'd' WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') THEN 't' ELSE '' END AS fault
  FROM ordered),
moves AS (SELECT * FROM (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)) AS v(state, initial, after)),
next AS (SELECT * FROM (VALUES (0, 2, 'user'), (1, 2, 'user'), (2, 3, 'assistant'), (3, 2, 'user')) AS v(state, after, role)),
before AS (
  SELECT state, state AS at, 0 AS cost, '' AS audit, []::VARCHAR[] AS turns FROM (SELECT unnest([0, 1, 2, 3]) AS state)
  UNION ALL SELECT state, after, 3, 'I', [role || ':'] FROM next
  UNION ALL SELECT a.state, b.after, 6, 'II', [a.role || ':', b.role || ':'] FROM next AS a JOIN next AS b ON a.after = b.state),
edits AS (
  SELECT b.*, 'D' AS edit, 4 AS paid, b.at AS after, NULL::VARCHAR AS initial, NULL::VARCHAR AS role FROM before AS b
  UNION ALL SELECT b.*, 'K', 0, m.after, m.initial, NULL FROM before AS b JOIN moves AS m ON m.state = b.at
  UNION ALL SELECT b.*, 'R', 3, n.after, NULL, n.role FROM before AS b JOIN next AS n ON n.state = b.at),
reached AS (
  SELECT DISTINCT conv_id, 1::BIGINT AS i, 0 AS state, {'cost': 0, 'audit': '', 'turns': []::VARCHAR[]} AS best FROM rows
  UNION ALL
  SELECT r.conv_id, r.i + 1, e.after, min({'cost': r.best.cost + e.cost + e.paid + CASE WHEN t.fault = 't' AND e.edit <> 'D' THEN 3 ELSE 0 END, 'audit': r.best.audit || e.audit || e.edit,
    'turns': list_concat(r.best.turns, e.turns, CASE e.edit WHEN 'D' THEN [] WHEN 'K' THEN [t.role || ':' || t.text] ELSE [e.role || ':' || t.text] END)})
  FROM reached AS r JOIN rows AS t ON t.conv_id IS NOT DISTINCT FROM r.conv_id AND t.i = r.i JOIN edits AS e ON e.state = r.state
  WHERE e.edit = 'D' OR (t.fault NOT IN ('b', 'd') AND (e.edit = 'R' OR e.initial = t.initial))
  GROUP BY r.conv_id, r.i, e.after),
n AS (
  SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 'b') AS blank, count(*) FILTER (WHERE fault = 'd') AS duplicate,
    count(*) FILTER (WHERE fault = 't') AS truncated, count(*) FILTER (WHERE i > 1 AND earlier || initial NOT IN ('su', 'ua', 'au')) AS illegal FROM rows GROUP BY conv_id),
best AS (
  SELECT r.conv_id, min({'cost': r.best.cost + b.cost, 'audit': r.best.audit || b.audit, 'turns': list_concat(r.best.turns, b.turns)}) AS best
  FROM reached AS r JOIN n ON n.conv_id IS NOT DISTINCT FROM r.conv_id AND r.i = n.n + 1 JOIN before AS b ON b.state = r.state WHERE b.at IN (0, 3) GROUP BY r.conv_id)
SELECT c.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  coalesce(best.cost, 0)::BIGINT AS cost, coalesce(best.audit, '') AS audit, sha256(coalesce(array_to_string(best.turns, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) AS c LEFT JOIN n ON n.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN best ON best.conv_id IS NOT DISTINCT FROM c.conv_id""",
    "op13_license_scan": r"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
templates AS (SELECT * FROM ({templates}) AS v(t, label, tw, must, bare)),
vocabulary AS (SELECT DISTINCT unnest(tw) AS word FROM templates),
df AS (SELECT word, count(*) AS df FROM (SELECT unnest(list_distinct(w)) AS word FROM docs) JOIN vocabulary USING (word) GROUP BY word),
idf AS (SELECT word, ln(1 + ((SELECT count(*) FROM docs) + 1) / (coalesce(df, 0) + 1)) AS idf FROM vocabulary LEFT JOIN df USING (word)),
weights AS (SELECT t, q, tw[q] AS word, idf FROM (SELECT t, tw, unnest(range(1, len(tw) + 1)) AS q FROM templates) JOIN idf ON idf.word = tw[q]),
tokens AS (SELECT r, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM docs),
begins AS (SELECT tokens.r, t, i - must[1] AS b, w, tw, must FROM tokens JOIN templates ON tokens.word = tw[must[1]] JOIN docs ON docs.r = tokens.r),
places AS (
  SELECT r, t, b, w FROM begins
  WHERE len(list_filter(must, lambda q: CASE WHEN b + q >= 1 THEN w[b + q] = tw[q] ELSE FALSE END)) = len(must)),
shares AS (
  SELECT r, t, b, round(sum(CASE WHEN b + q >= 1 AND w[b + q] = word THEN idf ELSE 0 END) / sum(idf), 6) AS s FROM places JOIN weights USING (t) GROUP BY r, t, b),
found AS (
  SELECT r, count(*) FILTER (WHERE bare) AS n_base, min(b) FILTER (WHERE bare) AS first_word, max(b) FILTER (WHERE bare) AS last_word, max(s) AS score,
    string_agg(DISTINCT label, ',' ORDER BY label) FILTER (WHERE bare) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) FILTER (WHERE s >= 0.8) AS labels
  FROM shares JOIN templates USING (t) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0)::DOUBLE AS score
FROM docs LEFT JOIN found USING (r)""".replace("{templates}", _templates_sql()),
}
