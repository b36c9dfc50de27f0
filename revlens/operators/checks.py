"""Checks before a merge: deterministic ones with four outcomes, and a model's opinion that can only add to them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from revlens.functions.text import issue_references, prose, strip, title_problem
from revlens.operators.tables import Rounds

# Characters of prose that a description needs; sources without a request; checks that a model may be asked about.
LEAST_DESCRIPTION = 50
LOCAL = ("local", "paths")
ASKABLE = ("title", "description", "linked_issue")
COLUMNS = "change, check, level, outcome, reason, measured, threshold, advisory, opinion"
SCHEMA = "check string, outcome string, reason string, measured double, threshold double"


def _row(check: str, outcome: Column, reason: Column, measured: Column | None = None, threshold: float | None = None) -> Column:
    return F.struct(F.lit(check).alias("check"), outcome.alias("outcome"), reason.alias("reason"), (F.lit(None) if measured is None else measured).cast("double").alias("measured"), F.lit(threshold).cast("double").alias("threshold"))


def check_results(changes: DataFrame, coverage: DataFrame, levels: dict[str, str], threshold: float = 0.8) -> DataFrame:
    """(change, check, level, outcome, reason, measured, threshold, advisory, opinion): a row for each check of `levels` that isn't off.

    `changes` (change, origin, title, description, issue) and `coverage` (change, documented, total). outcome is passed, failed or
    not_applicable: a local change has no title, description or link to check (an issue that it is reviewed against is a link all the same), and
    a change without symbols nothing to document, which is no full mark. The checks are columns of one pass over the changes,
    which become rows at its end.
    """
    local = F.coalesce("origin", F.lit("")).isin(*LOCAL)
    problem = title_problem(F.col("title"))
    told = prose(F.col("description"))
    blank = strip(F.coalesce("description", F.lit(""))) == ""
    short = F.when(told == "", F.when(blank, "none").otherwise("template")).when(F.char_length(told) < LEAST_DESCRIPTION, "short")
    linked = issue_references(F.concat_ws("\n", F.coalesce("title", F.lit("")), F.coalesce("description", F.lit(""))))
    ratio = F.when(F.col("total") > 0, F.col("documented") / F.col("total"))
    verdict = lambda reason: F.when(local, "not_applicable").when(reason.isNull(), "passed").otherwise("failed")
    no = F.lit(None).cast("string")
    known = {
        "docstring_coverage": _row("docstring_coverage", F.when(ratio.isNull(), "not_applicable").when(ratio >= threshold, "passed").otherwise("failed"), F.when(ratio < threshold, "low"), ratio, threshold),
        "title": _row("title", verdict(problem), F.when(~local, problem)),
        "description": _row("description", verdict(short), F.when(~local, short)),
        "linked_issue": _row("linked_issue", F.when(F.col("issue").isNotNull(), "passed").when(local, "not_applicable").when(F.size(linked) > 0, "passed").otherwise("failed"), F.when(F.col("issue").isNull() & ~local & (F.size(linked) == 0), "none").otherwise(no)),
    }
    asked = [c for c in known if levels.get(c, "off") != "off"]
    met = changes.join(coverage.select("change", "documented", "total"), "change", "left")
    rows = met.select("change", F.explode(F.array(*[known[c] for c in asked]) if asked else F.array().cast(f"array<struct<{SCHEMA.replace(' ', ':').replace(',:', ',')}>>")).alias("r"))
    level = reduce(lambda out, c: out.when(F.col("r.check") == c, levels[c]), asked[1:], F.when(F.col("r.check") == asked[0], levels[asked[0]])) if asked else F.lit("off")
    return rows.select("change", "r.check", level.alias("level"), "r.outcome", "r.reason", "r.measured", "r.threshold", F.lit(False).alias("advisory"), F.lit(None).cast("string").alias("opinion"))


def run_checks(checks: dict[str, tuple[str, callable]]) -> tuple[DataFrame | None, list[str]]:
    """The union of the checks that aren't off, and a note for each that could not be built; `checks` are name to (level, a function that returns its rows).

    A check that fails to run is no verdict: the others stand.
    """
    done, notes = [], []
    for name, (level, check) in checks.items():
        if level == "off":
            continue
        try:
            done.append(check())
        except Exception as e:  # noqa: BLE001 - whatever a check trips over is its own
            notes.append(f"The {name} check could not run: {e}"[:300])
    return (reduce(DataFrame.unionByName, done) if done else None), notes


def askable(results: DataFrame) -> DataFrame:
    """The results that a model may be asked about: passed checks of the text, of changes one of whose text checks is an error."""
    wants = results.where((F.col("level") == "error") & F.col("check").isin(*ASKABLE)).select("change").distinct()
    return results.where(F.col("check").isin(*ASKABLE) & (F.col("outcome") == "passed")).join(wants, "change", "left_semi")


def with_opinion(results: DataFrame, overviews: DataFrame, opinions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """`results` with a model's `opinions` (change, check, good, note) laid over those that passed, and (change, note) where there is none to be had.

    Only askable() results are touched: an opinion is kept with each, and a bad one makes it failed and advisory, so that it never
    blocks. Without an overview (change, overview) nothing is asked.
    """
    results = Rounds(results).put(results)
    asked = askable(results).select("change", "check").withColumn("asked", F.lit(True))
    told = overviews.where(strip(F.coalesce("overview", F.lit(""))) != "").select("change").distinct()
    said = opinions.where(F.col("good").isNotNull()).dropDuplicates(["change", "check"]).select("change", "check", "good", F.nullif(strip(F.coalesce("note", F.lit(""))), F.lit("")).alias("note"))
    live = asked.join(told, "change", "left_semi").join(said, ["change", "check"])
    met = results.join(live, ["change", "check"], "left")
    bad = F.coalesce(F.col("asked") & ~F.col("good"), F.lit(False))
    reason = F.when(bad, F.coalesce("note", F.concat(F.lit("The model judged the "), "check", F.lit(" inadequate.")))).otherwise(F.col("reason"))
    patch = {"outcome": F.when(bad, "failed").otherwise(F.col("outcome")), "reason": reason, "advisory": F.col("advisory") | bad, "opinion": F.when(F.col("asked"), F.col("note")).otherwise(F.col("opinion"))}
    out = met.select(*[patch.get(c, F.col(c)).alias(c) for c in results.columns])
    changes = asked.select("change").distinct()
    silent = changes.join(told, "change", "left_anti").select("change", F.lit("no overview").alias("note"))
    unusable = changes.join(told, "change", "left_semi").join(said.select("change").distinct(), "change", "left_anti").select("change", F.lit("no usable opinion").alias("note"))
    return out, silent.unionByName(unusable)


def views(results: DataFrame) -> DataFrame:
    """(change, passed, failed, not_applicable, blocking, advisory): the four views of a change's results as counts; what fails at error and isn't advisory blocks."""
    failed = F.col("outcome") == "failed"
    return results.groupBy("change").agg(
        F.count_if(F.col("outcome") == "passed").alias("passed"), F.count_if(failed).alias("failed"), F.count_if(F.col("outcome") == "not_applicable").alias("not_applicable"),
        F.count_if(failed & (F.col("level") == "error") & ~F.col("advisory")).alias("blocking"), F.count_if(failed & F.col("advisory")).alias("advisory"))
