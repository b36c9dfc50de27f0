"""Small relations that reports are made of: links, sides of a set, shares, sums in order of appearance, first places, divisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def linked_changes(events: DataFrame, key: str, number: str, pos: str, foreign: Column | None = None, most: int | None = None) -> DataFrame:
    """(key, number, columns of the last event, first): of each linked change its last event, numbered `place` in the order in which numbers first appear; links into other projects (`foreign`) go, and what is beyond the first `most`."""
    own = events if foreign is None else events.where(~F.coalesce(foreign, F.lit(False)))
    rest = [c for c in events.columns if c not in (key, number)]
    each = own.groupBy(key, number).agg(F.max_by(F.struct(*rest), pos).alias("last"), F.min(pos).alias("first"))
    ranked = each.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy("first")))
    kept = ranked if most is None else ranked.where(F.col("place") <= most)
    return kept.select(key, number, *[F.col(f"last.{c}").alias(c) for c in rest], "first", "place")


def sides(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """(key, in_old, in_new): where each key stands: in one set, in the other, or in both. Keys are gathered before they meet."""
    both = old.select(key, F.lit(True).alias("o"), F.lit(False).alias("n")).unionByName(new.select(key, F.lit(False).alias("o"), F.lit(True).alias("n")))
    return both.groupBy(key).agg(F.bool_or("o").alias("in_old"), F.bool_or("n").alias("in_new"))


def documented_share(symbols: DataFrame, by: str, symbol: str, documented: Column) -> DataFrame:
    """(by, symbols, ratio): how many distinct symbols there are, and which share of them is documented anywhere; null without symbols, since nothing to document is no full mark."""
    one = symbols.where(F.col(symbol).isNotNull()).groupBy(by, symbol).agg(F.bool_or(F.coalesce(documented, F.lit(False))).alias("told"))
    found = one.groupBy(by).agg(F.count(F.lit(1)).alias("symbols"), F.count_if("told").alias("n"))
    every = symbols.select(by).distinct().withColumnRenamed(by, "_by")
    met = every.join(found, every["_by"].eqNullSafe(found[by]), "left")
    return met.select(F.col("_by").alias(by), F.coalesce("symbols", F.lit(0)).alias("symbols"), F.try_divide("n", "symbols").alias("ratio"))


def usage_total(usage: DataFrame, model: str, tokens: Column, pos: Column) -> DataFrame:
    """One row (tokens, models): all tokens, and the distinct models in the order in which they were first used. Models are few; their sums are taken first."""
    each = usage.groupBy(model).agg(F.sum(tokens).alias("n"), F.min(pos).alias("first"))
    return each.agg(F.sum("n").alias("tokens"), F.transform(F.array_sort(F.collect_list(F.struct("first", model))), lambda x: x[model]).alias("models"))


def paths_by_chunk(ranges: DataFrame, path: str, chunk: str) -> DataFrame:
    """(chunk, paths): each path at the first chunk that has a part of it, in order."""
    return ranges.groupBy(path).agg(F.min(chunk).alias(chunk)).groupBy(chunk).agg(F.array_sort(F.collect_list(path)).alias("paths"))


def complete(units: DataFrame, done: DataFrame, path: str, unit: list[str]) -> DataFrame:
    """(path): those all of whose units are done: units that aren't are found by an anti-join, and paths that have one go."""
    open_ = units.join(done.select(*unit).distinct(), unit, "left_anti").select(path).distinct()
    return units.select(path).where(F.col(path).isNotNull()).distinct().join(open_, path, "left_anti")


def kept_outputs(runs: DataFrame, outcome: str, output: str, passed: str, nothing: str) -> DataFrame:
    """`runs` without those that had `nothing` to do; the output stays only where a run didn't pass."""
    return runs.where(~F.col(outcome).eqNullSafe(F.lit(nothing))).withColumn(output, F.when(~F.col(outcome).eqNullSafe(F.lit(passed)), F.col(output)))


def joined_cost(parts: DataFrame, key: str, cost: Column, joint: int = 1) -> DataFrame:
    """(key, cost): what all parts of a key cost when they are joined."""
    return parts.groupBy(key).agg((F.sum(cost) + (F.count(F.lit(1)) - 1) * joint).alias("cost"))


def placed(rows: DataFrame, key: str, *order: Column) -> DataFrame:
    """`rows` with their place, from 1, among those of their key."""
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(*order)).cast("long"))


def outcome_views(checks: DataFrame, by: str, failed: Column, blocks: Column) -> DataFrame:
    """(by, blocking, warnings, passed): what fails and blocks, what only fails, and what passes."""
    return checks.groupBy(by).agg(F.count_if(failed & blocks).alias("blocking"), F.count_if(failed & ~blocks).alias("warnings"), F.count_if(~failed).alias("passed"))


def all_findings(inline: DataFrame, reported: DataFrame) -> DataFrame:
    """Inline findings and those of the scanners, which are told whole, as one table."""
    return inline.unionByName(reported, allowMissingColumns=True)
