"""What a review is written as: JSON, markdown, instructions, an outbox of comments and replies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from revlens.functions import text as X

SCHEMA_VERSION = 7
_ALWAYS = ("file", "start_line", "end_line", "severity", "category", "kind", "title", "body", "evidence")
_FILLED = ("evidence_note", "evidence_files", "suggestion")
_FULL = ("effort", "confidence", "source", "rule_id", "tool", "fingerprint")


def finding_json(findings: DataFrame, agent: bool = False) -> Column:
    """A finding as JSON: empty optional fields have no key, and an agent's form leaves out what it can't act on."""
    has = set(findings.columns)
    types = dict(findings.dtypes)
    empty = lambda c: F.when(F.size(c) > 0, F.col(c)) if types[c].startswith("array") else F.nullif(F.col(c), F.lit(""))
    cols = [F.col(c) for c in _ALWAYS if c in has] + [empty(c).alias(c) for c in _FILLED if c in has]
    if not agent:
        cols += [F.col(c) for c in _FULL if c in has]
    return F.to_json(F.struct(*cols))


def counts(findings: DataFrame) -> DataFrame:
    """(severity, n) for all severities, the most severe first, 0 where none."""
    dim = findings.sparkSession.range(1).select(F.posexplode(F.array(*[F.lit(s) for s in reversed(X.SEVERITIES)])).alias("place", "severity"))
    return dim.join(findings.groupBy("severity").agg(F.count("*").alias("n")), "severity", "left").select("place", "severity", F.coalesce("n", F.lit(0)).alias("n"))


def ordered(findings: DataFrame) -> list[Column]:
    return [X.rank_of(F.col("severity")).desc(), F.col("file"), F.col("start_line"), F.col("pos")]


def _order() -> Column:
    """The order of findings in a report, as a struct that sorts."""
    return F.struct((-X.rank_of(F.col("severity"))).alias("r"), F.col("file").alias("f"), F.col("start_line").alias("l"), F.col("pos").alias("p"))


def documents(findings: DataFrame, reviews: DataFrame, agent: bool = False) -> DataFrame:
    """(review, json): each of `reviews` (review, status) as one document with its findings (review, ...) in order; a review without findings has an empty list, and a severity without any no count.

    What one review reports is limited, so one row can hold it; reviews are dealt to tasks like any key.
    """
    own = findings.select("review", F.struct(_order().alias("o"), finding_json(findings, agent).alias("json"), "severity").alias("x"))
    met = own.groupBy("review").agg(F.array_sort(F.collect_list("x")).alias("all"), *[F.count_if(F.col("x.severity") == s).alias(f"n_{s}") for s in X.SEVERITIES])
    rows = reviews.join(met, "review", "left")
    counts_ = F.array_compact(F.array(*[F.when(F.col(f"n_{s}") > 0, F.concat(F.lit(f'"{s}":'), F.col(f"n_{s}").cast("string"))) for s in reversed(X.SEVERITIES)]))
    listed = F.coalesce(F.transform("all", lambda x: x["json"]), F.array().cast("array<string>"))
    json = F.concat(
        F.lit(f'{{"schema_version":{SCHEMA_VERSION},"status":'), F.regexp_replace(F.to_json(F.array("status")), r"(?s)\A\[(.*)\]\z", "$1"), F.lit(',"summary":{"total":'), F.size(listed).cast("string"),
        F.lit(',"by_severity":{'), F.array_join(counts_, ","), F.lit('}},"findings":['), F.array_join(listed, ","), F.lit("]}"),
    )
    return rows.select("review", json.alias("json"))


#: Parts of a report in the order in which they are told, and their heads.
BUCKETS = {"requirement_gap": "Requirement gaps", "actionable": "Actionable", "nitpick": "Nitpicks", "outside_diff": "Outside the diff"}


def markdown_documents(findings: DataFrame, reviews: DataFrame, full: bool = True) -> DataFrame:
    """(review, text): a report of each of `reviews` (review, status): how many findings of each severity, then every finding (review, bucket, ...) under the head of its bucket.

    The full form has each with its body and its replacement, in a fence that the text can't close; the short form a row of a table each. Both hold every finding.
    """
    at = F.concat(F.lit("`"), X.location(F.col("file"), F.col("start_line"), F.col("end_line")), F.lit("`"))
    fix = F.coalesce(F.col("suggestion"), F.lit(""))
    fence = X.fence_for(fix)
    long = F.concat(F.lit("### "), X.flatten(F.col("title")), F.lit("\n\n"), at, F.lit(" · "), F.col("severity"), F.lit("\n\n"), X.strip(F.coalesce("body", F.lit(""))), F.when(fix != "", F.concat(F.lit("\n\n"), fence, F.lit("\n"), fix, F.lit("\n"), fence)).otherwise(""))
    short = F.concat(F.lit("| "), at, F.lit(" | "), F.col("severity"), F.lit(" | "), X.escape_cell(X.flatten(F.col("title"))), F.lit(" |"))
    place = F.array_position(F.array(*[F.lit(b) for b in BUCKETS]), F.col("bucket"))
    parts = findings.groupBy("review", "bucket").agg(F.array_sort(F.collect_list(F.struct(_order().alias("o"), (long if full else short).alias("t")))).alias("all"), F.first(place).alias("place"))
    head = F.create_map(*[F.lit(x) for pair in BUCKETS.items() for x in pair])[F.col("bucket")]
    body = F.array_join(F.transform("all", lambda x: x["t"]), "\n\n" if full else "\n")
    table = F.lit("") if full else F.lit("| Place | Severity | Finding |\n| --- | --- | --- |\n")
    sections = parts.select("review", "place", F.concat(F.lit("## "), head, F.lit(" ("), F.size("all").cast("string"), F.lit(")\n\n"), table, body).alias("section"))
    texts = sections.groupBy("review").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "section"))), lambda x: x["section"]), "\n\n").alias("sections"))
    n = findings.groupBy("review").agg(*[F.count_if(F.col("severity") == s).alias(f"n_{s}") for s in X.SEVERITIES])
    line = F.array_join(F.array(*[F.concat(F.coalesce(F.col(f"n_{s}"), F.lit(0)).cast("string"), F.lit(f" {s}")) for s in reversed(X.SEVERITIES)]), ", ")
    met = reviews.join(n, "review", "left").join(texts, "review", "left")
    return met.select("review", F.concat(F.lit("# Review: "), "status", F.lit("\n\n"), line, F.lit("\n\n"), F.coalesce("sections", F.lit("No findings."))).alias("text"))


def instructions(findings: DataFrame) -> DataFrame:
    """(place, text): one numbered instruction for each finding, the most severe first."""
    from pyspark.sql import Window

    fix = F.when(F.coalesce(F.col("suggestion"), F.lit("")) != "", F.concat(F.lit("\n   fix: replace those lines with:\n     "), F.regexp_replace("suggestion", "\n", "\n     "))).otherwise("")
    place = F.row_number().over(Window.orderBy(*ordered(findings)))
    text = F.concat(
        F.col("place").cast("string"), F.lit(". "), X.location(F.col("file"), F.col("start_line"), F.col("end_line")), F.lit("\n   severity: "), F.col("severity"), F.lit(" ("), F.col("category"),
        F.lit(")\n   problem: "), F.col("title"), F.lit("\n   detail: "), X.flatten(F.col("body")), fix,
    )
    return findings.withColumn("place", place).select("place", text.alias("text"))


def markdown_rows(findings: DataFrame) -> DataFrame:
    """(pos, row): a line of a table for each finding; no cell can break its row."""
    cells = [F.concat(F.lit("`"), X.location(F.col("file"), F.col("start_line"), F.col("end_line")), F.lit("`")), F.col("severity"), X.escape_cell(F.col("title"))]
    return findings.select("pos", F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("row"))


def upsert(stored: DataFrame, incoming: DataFrame, key: list[str]) -> DataFrame:
    """`stored` with incoming rows in place of those of their key, and new ones added; `action` says which: kept, updated or inserted."""
    old = stored.select(*key).distinct().withColumn("was", F.lit(True))
    new = incoming.join(old, key, "left").withColumn("action", F.when(F.col("was"), "updated").otherwise("inserted")).drop("was")
    kept = stored.join(incoming.select(*key).distinct(), key, "left_anti").withColumn("action", F.lit("kept"))
    return kept.unionByName(new)


def delivered(comments: DataFrame, rejected: DataFrame, batch: bool) -> DataFrame:
    """`comments` (key, fingerprint, ...) with state. Sent as one batch, a rejected row fails its key's whole batch; row by row, only itself."""
    bad = rejected.select("key", *([] if batch else ["fingerprint"])).distinct().withColumn("bad", F.lit(True))
    met = comments.join(bad, ["key"] if batch else ["key", "fingerprint"], "left")
    return met.withColumn("state", F.when(F.col("bad"), "failed").otherwise("posted")).drop("bad")


def resolutions(threads: DataFrame, replied: DataFrame) -> DataFrame:
    """(thread, step): a reply comes before its thread is resolved, and neither is done twice. `threads` (thread, resolved); `replied` (thread)."""
    met = threads.join(replied.select("thread").distinct().withColumn("has_reply", F.lit(True)), "thread", "left")
    step = F.when(F.col("has_reply").isNull(), "reply").when(~F.col("resolved"), "resolve").otherwise("done")
    return met.select("thread", step.alias("step"))
