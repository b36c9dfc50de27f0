"""Findings of a review: anchoring to changed lines, the evidence rule, duplicates, overlaps, routing, feedback, verdicts.

A finding is a row (pos, file, start_line, end_line, severity, category, kind, source, confidence, ...); `pos` is its
order of arrival and unique. `changed` has a row (file, line) for each added line of a change.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from revlens.functions import text as X

#: How far a finding may miss an added line, and lines of a bin of the join between findings and added lines.
TOLERANCE, BIN = 3, 64


def _nearest(findings: DataFrame, changed: DataFrame, tolerance: int) -> DataFrame:
    """(pos, hit, line, away): whether an added line lies in the span, and the added line nearest to its start within the tolerance, of two as near the lower.

    Both sides are dealt to bins of lines, so the join is by equal (file, bin); a bin's lines are one array of BIN at most.
    """
    lines = changed.where("line IS NOT NULL").groupBy("file", F.floor(F.col("line") / BIN).alias("bin")).agg(F.collect_set("line").alias("lines"))
    first = F.col("start_line") - tolerance
    last = F.greatest(F.col("end_line"), F.col("start_line") + tolerance)
    spans = findings.select("pos", "file", "start_line", "end_line", F.explode(F.sequence(F.floor(first / BIN), F.floor(last / BIN))).alias("bin"))
    near = F.filter(F.transform("lines", lambda x: F.struct(F.abs(x - F.col("start_line")).alias("away"), x.alias("line"))), lambda s: s["away"] <= tolerance)
    met = spans.join(lines, ["file", "bin"])
    met = met.select("pos", F.exists("lines", lambda x: (x >= F.col("start_line")) & (x <= F.col("end_line"))).alias("hit"), F.array_min(near).alias("near"))
    return met.groupBy("pos").agg(F.bool_or("hit").alias("hit"), F.min("near").alias("near")).select("pos", "hit", "near.line", "near.away")


def anchor(findings: DataFrame, files: DataFrame, changed: DataFrame, full_file: bool = False, tolerance: int = TOLERANCE) -> DataFrame:
    """Findings of `files` (file) that point at added lines, moved onto one that is at most `tolerance` lines from their start.

    A requirement gap needs a file of the change only; another finding needs a file with added lines, and with
    `full_file` no more than that.
    """
    known = files.select("file").distinct()
    added = changed.where("line IS NOT NULL").groupBy("file").agg(F.lit(True).alias("has_added"))
    here = findings.join(known, "file", "left_semi").join(added, "file", "left")
    gap = F.col("kind") == "requirement_gap"
    if full_file:
        return here.where(gap | F.col("has_added")).select(*findings.columns)
    found = here.join(_nearest(findings, changed, tolerance).withColumnRenamed("line", "near_line"), "pos", "left")
    shift = F.when(gap | F.coalesce("hit", F.lit(False)), 0).otherwise(F.col("near_line") - F.col("start_line"))
    kept = found.where(gap | F.col("hit") | F.col("near_line").isNotNull()).withColumn("shift", shift)
    moved = {c: (F.col(c) + F.col("shift")).alias(c) for c in ("start_line", "end_line")}
    return kept.select(*[moved.get(c, F.col(c)) for c in findings.columns])


def only_changed(findings: DataFrame, changed: DataFrame) -> DataFrame:
    """Findings whose span holds an added line, without any tolerance: the rule for tools."""
    return findings.join(_nearest(findings, changed, 0).where("hit").select("pos"), "pos", "left_semi")


def is_unproven_blocker() -> Column:
    proven = F.col("evidence").isin("execution_path", "reproduction", "contract", "static_tool") & (X.strip(F.coalesce("evidence_note", F.lit(""))) != "")
    return (F.col("source") == "llm") & ~F.coalesce(proven, F.lit(False)) & F.col("kind").isin("potential_issue", "verification_needed") & X.at_least(F.col("severity"), "major")


def enforce_evidence(findings: DataFrame) -> DataFrame:
    """A model's claim of a blocker without proof becomes minor, to be verified."""
    weak = F.coalesce(is_unproven_blocker(), F.lit(False))
    return findings.withColumns({"severity": F.when(weak, "minor").otherwise(F.col("severity")), "kind": F.when(weak, "verification_needed").otherwise(F.col("kind"))})


def best_of_each(findings: DataFrame, key: str = "fingerprint") -> DataFrame:
    """One finding of each key: severity, then the model's over a tool's, then confidence, then the first. It takes the first one's place, `first_pos`."""
    order = [X.rank_of(F.col("severity")).desc(), (F.col("source") == "llm").desc(), F.col("confidence").desc(), F.col("pos")]
    w = Window.partitionBy(key)
    ranked = findings.select("*", F.row_number().over(w.orderBy(*order)).alias("place"), F.min("pos").over(w).alias("first_pos"))
    return ranked.where("place = 1").drop("place")


def without_overlaps(findings: DataFrame, by: tuple[str, str] = ("file", "category")) -> DataFrame:
    """Findings in order of (start, severity, first_pos) that overlap none kept before of their file and category; requirement gaps are exempt.

    A run of findings that reach into each other is a group of its own, found by a window; only within a run does one
    keep out another, so what is folded together follows the run and not the file.
    """
    gap = F.col("kind") == "requirement_gap"
    w = Window.partitionBy(*by).orderBy("start_line", X.rank_of(F.col("severity")).desc(), "first_pos")
    before = F.max("end_line").over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = findings.where(~gap).withColumn("opens", F.coalesce((F.col("start_line") > before).cast("int"), F.lit(1)))
    rows = rows.withColumn("run", F.sum("opens").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("nth", F.row_number().over(w))
    line = F.array_sort(F.collect_list(F.struct("nth", "start_line", "end_line", "pos")))
    empty = F.struct(F.lit(None).cast("bigint").alias("reach"), F.array().cast("array<bigint>").alias("kept"))

    def step(state: Column, x: Column) -> Column:
        free = state["reach"].isNull() | (x["start_line"] > state["reach"])
        return F.struct(F.when(free, F.greatest(x["end_line"], F.coalesce(state["reach"], x["end_line"]))).otherwise(state["reach"]).cast("bigint").alias("reach"), F.when(free, F.concat(state["kept"], F.array(x["pos"].cast("bigint")))).otherwise(state["kept"]).alias("kept"))

    kept = rows.groupBy(*by, "run").agg(F.aggregate(line, empty, step)["kept"].alias("kept")).select(F.explode("kept").alias("pos"))
    return findings.join(kept, "pos", "left_semi").unionByName(findings.where(gap))


def top(findings: DataFrame, most: int = 25) -> DataFrame:
    """The first findings by severity, confidence, file and line, numbered."""
    order = [X.rank_of(F.col("severity")).desc(), F.col("confidence").desc(), F.col("file"), F.col("start_line"), F.col("first_pos")]
    return findings.orderBy(*order).limit(most).withColumn("place", F.row_number().over(Window.orderBy(*order)))


def validate(findings: DataFrame, files: DataFrame, changed: DataFrame, min_confidence: float = 0.5, floor: str = "info", most: int = 25) -> DataFrame:
    """The whole chain, in this order: anchor, evidence, confidence, severity, duplicates, overlaps, the first `most`."""
    kept = enforce_evidence(anchor(findings, files, changed))
    kept = kept.where((F.col("confidence") >= min_confidence) & X.at_least(F.col("severity"), floor))
    return top(without_overlaps(best_of_each(kept)), most)


def bucket(findings: DataFrame, files: DataFrame, shown: DataFrame) -> DataFrame:
    """With bucket: requirement_gap, outside_diff, nitpick or actionable. `files` (file, has_hunks); `shown` (file, line) are all lines of the diff's new side."""
    known = files.groupBy("file").agg(F.bool_or("has_hunks").alias("has_hunks"))
    lines = shown.select("file", F.col("line").alias("start_line"), F.lit(True).alias("shown")).distinct()
    met = findings.join(known, "file", "left").join(lines, ["file", "start_line"], "left")
    outside = F.col("has_hunks").isNull() | (F.col("has_hunks") & F.col("shown").isNull())
    route = F.when(F.col("kind") == "requirement_gap", "requirement_gap").when(outside, "outside_diff").when(F.col("kind") == "nitpick", "nitpick").otherwise("actionable")
    return met.select(*findings.columns, route.alias("bucket"))


def severity_table(findings: DataFrame, most: int = 5) -> DataFrame:
    """(severity, n, files): a count, and files in order of first appearance, `most` of them named."""
    each = findings.groupBy("severity", "file").agg(F.min("pos").alias("at"), F.count("*").alias("n"))
    # Files beyond the named ones are only counted, so no list follows a severity's files.
    nth = F.row_number().over(Window.partitionBy("severity").orderBy("at"))
    told = each.withColumn("nth", nth).groupBy("severity").agg(F.sum("n").alias("n"), F.count("*").alias("of"), F.array_sort(F.collect_list(F.when(F.col("nth") <= most, F.struct("nth", "file")))).alias("some"))
    more = F.when(F.col("of") > most, F.concat(F.lit(" and "), (F.col("of") - most).cast("string"), F.lit(" more"))).otherwise("")
    return told.select("severity", "n", F.concat(F.array_join(F.transform("some", lambda s: s["file"]), ", "), more).alias("files"))


def apply_feedback(findings: DataFrame, entries: DataFrame, suppress_static: bool = False) -> DataFrame:
    """With outcome (kept, static_kept or suppressed) and the matched entry: the second fingerprint's before the first's. `entries` (fingerprint, verdict), one row each."""
    one, two = (entries.select(F.col("fingerprint").alias(k), F.col("verdict").alias(f"{k}_verdict"), F.lit(True).alias(f"{k}_met")) for k in ("fingerprint", "fingerprint_v2"))
    met = findings.join(two, "fingerprint_v2", "left").join(one, "fingerprint", "left")
    hit = F.coalesce("fingerprint_v2_met", "fingerprint_met", F.lit(False))
    outcome = F.when(~hit, "kept").when((F.col("source") == "static") & F.lit(not suppress_static), "static_kept").otherwise("suppressed")
    entry = F.when(F.col("fingerprint_v2_met"), F.col("fingerprint_v2")).when(F.col("fingerprint_met"), F.col("fingerprint"))
    verdict = F.when(F.col("fingerprint_v2_met"), F.col("fingerprint_v2_verdict")).when(F.col("fingerprint_met"), F.col("fingerprint_verdict"))
    return met.select(*findings.columns, outcome.alias("outcome"), entry.alias("entry"), verdict.alias("verdict"))


def gate(findings: DataFrame, checks: DataFrame, complete: Column, floor: str = "critical") -> DataFrame:
    """One row (verdict, blocking, failed_checks): error over blocked over pass. `checks` (level, outcome, advisory)."""
    blocking = findings.agg(F.count_if(X.at_least(F.col("severity"), floor)).alias("blocking"))
    failed = checks.agg(F.count_if((F.col("level") == "error") & (F.col("outcome") == "failed") & ~F.col("advisory")).alias("failed_checks"))
    verdict = F.when(~complete, "error").when((F.col("blocking") > 0) | (F.col("failed_checks") > 0), "blocked").otherwise("pass")
    return blocking.join(failed, F.lit(True)).select(verdict.alias("verdict"), "blocking", "failed_checks")


def verdicts(reviews: DataFrame, findings: DataFrame, checks: DataFrame, floor: str = "critical") -> DataFrame:
    """(review, verdict, blocking, failed_checks) of each of `reviews` (review, complete): error where it isn't complete, else blocked by findings (review, severity) of the floor or more or by checks (review, level, outcome, advisory) that fail at error, else pass."""
    worst = findings.groupBy("review").agg(F.count_if(X.at_least(F.col("severity"), floor)).alias("blocking"))
    failed = checks.groupBy("review").agg(F.count_if((F.col("level") == "error") & (F.col("outcome") == "failed") & ~F.coalesce("advisory", F.lit(False))).alias("failed_checks"))
    met = reviews.select("review", "complete").join(worst, "review", "left").join(failed, "review", "left")
    n, m = F.coalesce("blocking", F.lit(0)), F.coalesce("failed_checks", F.lit(0))
    return met.select("review", F.when(~F.coalesce("complete", F.lit(False)), "error").when((n > 0) | (m > 0), "blocked").otherwise("pass").alias("verdict"), n.alias("blocking"), m.alias("failed_checks"))


def coverage(omissions: DataFrame, losses: tuple[str, ...]) -> DataFrame:
    """(class, reason, paths): of each path its first loss, or its first reason where it has no loss; `omissions` (pos, path, reason), a null reason is a loss that beats none."""
    kind = F.when(F.col("reason").isin(*losses), 0).when(F.col("reason").isNull(), 1).otherwise(2)
    one = omissions.groupBy("path").agg(F.min(F.struct(kind.alias("kind"), "pos", "reason")).alias("first"))
    return one.groupBy(F.when(F.col("first.kind") < 2, "omitted").otherwise("excluded").alias("class"), F.col("first.reason").alias("reason")).agg(F.count("*").alias("paths"))


def near_expected(findings: DataFrame, expected: DataFrame, tolerance: int = TOLERANCE) -> DataFrame:
    """(case, candidates, near): findings of a case's category (and file, where it names one), and those within the tolerance of its line.

    Findings are counted by category, file and line first, once for their file and once for cases of any file. Candidates are sums of these
    counts; near ones meet a case by equal category, file and bin of lines, so no case is compared with all of its category.
    """
    any_file = F.coalesce("file", F.lit(""))
    by_line = findings.where("pos IS NOT NULL").select("category", F.explode(F.array_distinct(F.array(any_file, F.lit("")))).alias("of"), "start_line").groupBy("category", "of", "start_line").agg(F.count(F.lit(1)).alias("n"))
    sums = by_line.groupBy("category", "of").agg(F.sum("n").alias("candidates"))
    cases = expected.select("case", "category", any_file.alias("of"), "line")
    spread = F.sequence(F.floor((F.col("line") - tolerance) / BIN), F.floor((F.col("line") + tolerance) / BIN))
    lines = by_line.where("start_line IS NOT NULL").withColumn("bin", F.floor(F.col("start_line") / BIN))
    met = cases.where("line IS NOT NULL").withColumn("bin", F.explode(spread)).join(lines, ["category", "of", "bin"]).where(F.abs(F.col("start_line") - F.col("line")) <= tolerance)
    near = met.groupBy("case").agg(F.sum("n").alias("near"))
    told = cases.join(sums, ["category", "of"], "left").groupBy("case").agg(F.coalesce(F.sum("candidates"), F.lit(0)).alias("candidates"))
    return told.join(near, "case", "left").select("case", "candidates", F.coalesce("near", F.lit(0)).alias("near"))


def decide(findings: DataFrame, decisions: DataFrame) -> DataFrame:
    """Findings after decisions (pos, ordinal, disposition, severity, evidence, note): the first of each finding counts; drop removes, revise and confirm patch, none leaves alone.

    A patch never takes proof away: proven evidence stays, and an empty note changes nothing.
    """
    cols = ["disposition", "severity", "evidence", "note"]
    first = decisions.groupBy("pos").agg(F.min_by(F.struct(*cols), "ordinal").alias("d"))
    met = findings.join(first, "pos", "left").where("d.disposition IS NULL OR d.disposition <> 'drop'")
    revise, confirm = F.col("d.disposition") == "revise", F.col("d.disposition").isin("revise", "confirm")
    proven = (F.col("evidence") != "unverified") & (F.coalesce("evidence_note", F.lit("")) != "")
    patch = {
        "severity": F.when(revise, F.coalesce("d.severity", "severity")).otherwise(F.col("severity")),
        "evidence": F.when(confirm & ~proven, F.coalesce("d.evidence", "evidence")).otherwise(F.col("evidence")),
        "evidence_note": F.when(confirm & (F.coalesce("d.note", F.lit("")) != ""), F.col("d.note")).otherwise(F.col("evidence_note")),
    }
    return met.select(*[patch.get(c, F.col(c)).alias(c) for c in findings.columns])


def ambiguous_edits(edits: DataFrame, known: DataFrame, changed: DataFrame) -> DataFrame:
    """`edits` (pos, file, start_line, end_line, title) with why one can't be applied, the first reason: unknown (no equal row of `known`), range, unchanged (no added line), ambiguous (overlaps another edit of its file); null if it can."""
    keys = ["file", "start_line", "end_line", "title"]
    listed = known.select(*keys).distinct().withColumn("listed", F.lit(True))
    hit = _nearest(edits, changed, 0).select("pos", "hit")
    w = Window.partitionBy("file").orderBy("start_line", "pos")
    # In the order of their starts the next one starts first of all that follow.
    before, after = F.max("end_line").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lead("start_line").over(w)
    rows = edits.withColumn("clash", F.coalesce(before >= F.col("start_line"), F.lit(False)) | F.coalesce(after <= F.col("end_line"), F.lit(False)))
    met = rows.join(listed, keys, "left").join(hit, "pos", "left")
    why = F.when(F.col("listed").isNull(), "unknown").when((F.col("start_line") < 1) | (F.col("end_line") < F.col("start_line")), "range").when(~F.coalesce("hit", F.lit(False)), "unchanged").when(F.col("clash"), "ambiguous")
    return met.select(*edits.columns, why.alias("reason"))
