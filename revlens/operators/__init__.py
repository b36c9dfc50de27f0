"""Review operators as DataFrame transformations, free of driver-side loops over rows; only `search` uses Python workers."""

from __future__ import annotations

import sys

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Functions go to the workers by value, so that a cluster need not have the package installed.
cloudpickle.register_pickle_by_value(sys.modules["revlens.operators"])


def unused(df: DataFrame, stem: str) -> str:
    """A column name that `df` doesn't have, in any case."""
    names = {c.lower() for c in df.columns}
    while stem.lower() in names:
        stem += "_"
    return stem


def keep_best(df: DataFrame, key: list[str], *preference: Column) -> DataFrame:
    """One row for each key, the first by `preference`; the others go."""
    n = unused(df, "nth")
    return df.withColumn(n, F.row_number().over(Window.partitionBy(*key).orderBy(*preference))).where(F.col(n) == 1).drop(n)


def top_k(df: DataFrame, key: list[str], k: int, *order: Column) -> DataFrame:
    """The first `k` rows of each key, with their rank; a column of that name gives way."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*key).orderBy(*order)).cast("long")).where(F.col("rank") <= k)


def newest_wins(df: DataFrame, key: list[str], *newest: Column) -> DataFrame:
    """The newest row of each key by a combining aggregate, with no sort of a key's rows."""
    rest, row = [c for c in df.columns if c not in key], unused(df, "newest")
    return df.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(*newest)).alias(row)).select(*key, f"{row}.*")


def zero_filled(df: DataFrame, column: str, values: list[str]) -> DataFrame:
    """A count for each of a fixed list of values, 0 where none occurs."""
    dim = df.sparkSession.range(1).select(F.explode(F.array(*[F.lit(v) for v in values])).alias(column))
    return dim.join(df.groupBy(column).agg(F.count("*").alias("n")), column, "left").select(column, F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def snapshot_diff(old: DataFrame, new: DataFrame, key: str, value: str) -> DataFrame:
    """added, removed and changed keys between two snapshots; a key without change has no row."""
    o, n = old.select(key, F.col(value).alias("old_value"), F.lit(True).alias("_o")), new.select(key, F.col(value).alias("new_value"), F.lit(True).alias("_n"))
    kind = F.when(F.col("_o").isNull(), "added").when(F.col("_n").isNull(), "removed").when(~F.col("old_value").eqNullSafe(F.col("new_value")), "changed")
    return o.join(n, key, "full").withColumn("kind", kind).where("kind IS NOT NULL").select(key, "kind", "old_value", "new_value")


def worst_of(df: DataFrame, key: str, column: str, ranks: dict[str, int]) -> DataFrame:
    """The highest-ranked value of each key; a value without rank counts as lowest."""
    rank = F.coalesce(F.create_map(*[F.lit(x) for kv in ranks.items() for x in kv])[F.col(column)], F.lit(-1))
    return df.groupBy(key).agg(F.max_by(column, F.struct(rank, F.col(column))).alias("worst"))


def ordered_distinct(df: DataFrame, key: str, column: str, order: str) -> DataFrame:
    """Each key's distinct values in order of first appearance, joined by commas."""
    first = df.groupBy(key, column).agg(F.min(order).alias("_at"))
    return first.groupBy(key).agg(F.concat_ws(",", F.transform(F.array_sort(F.collect_list(F.struct("_at", column))), lambda s: s[column])).alias("seen_values"))


def rates(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Recall and false-positive rate of (expected, found) rows; NULL where there is nothing to measure."""
    ratio = lambda a, b: (a / F.nullif(b, F.lit(0))).cast("double")
    cases, clean = F.count_if("expected"), F.count_if(~F.col("expected"))
    g = df.groupBy(*by) if by else df.groupBy()
    return g.agg(F.count("*").alias("n"), ratio(F.count_if(F.col("expected") & F.col("found")), cases).alias("recall"), ratio(F.count_if(~F.col("expected") & F.col("found")), clean).alias("false_positive_rate"))


def prefix_budget(df: DataFrame, key: str, cost: str, budget: int, *order: Column) -> DataFrame:
    """Each key's longest prefix whose summed cost stays within the budget."""
    total = F.sum(cost).over(Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn("spent", total).where(F.col("spent") <= budget)


def nearest_before(df: DataFrame, key: str, order: str, is_target: Column, value: str) -> DataFrame:
    """For each row, the last earlier value of a target row of its key (as-of join by one window)."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("nearest", F.last(F.when(is_target, F.col(value)), ignorenulls=True).over(w))


def unseen(df: DataFrame, seen: DataFrame, key: str) -> DataFrame:
    """Rows whose key isn't in `seen`; a null key is never seen."""
    return df.join(seen.select(key).distinct(), key, "left_anti")


def merged(done: DataFrame, fresh: DataFrame, key: str, value: str) -> DataFrame:
    """State after a resumed run: fresh values win, older ones stay."""
    return done.select(key, F.col(value).alias("_d")).join(fresh.select(key, F.col(value).alias("_f")), key, "full").select(key, F.coalesce("_f", "_d").alias(value), F.col("_f").isNotNull().alias("is_fresh"))


def nearest_within(df: DataFrame, key: str, order: str, is_target: Column, tolerance: int) -> DataFrame:
    """For each row, the `order` of the nearest target of its key, before or after, itself included, within the tolerance; of two as near, the earlier."""
    w = Window.partitionBy(key).orderBy(order)
    mark = F.when(is_target, F.col(order))
    before = F.last(mark, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    # Backwards, so that the frame grows by a row at a time.
    after = F.last(mark, ignorenulls=True).over(Window.partitionBy(key).orderBy(F.col(order).desc()).rowsBetween(Window.unboundedPreceding, 0))
    b, a = unused(df, "before"), unused(df, "after")
    near = df.withColumns({b: before, a: after})
    pick = F.when(F.col(a).isNull() | (F.col(order) - F.col(b) <= F.col(a) - F.col(order)), F.col(b)).otherwise(F.col(a))
    return near.withColumn("anchor", F.when(F.abs(pick - F.col(order)) <= tolerance, pick)).drop(a, b)


def smallest_containing(points: DataFrame, spans: DataFrame, point: str, start: str, end: str, longest: int) -> DataFrame:
    """For each point, the shortest span of at most `longest` that holds it, then the first to start; NULL where none does.

    Spans are dealt to bins of half the greatest length, three at most each, so the join is by equal bins. Rows of
    one point are equal here: points are taken once each.
    """
    width = max(longest // 2, 1)
    fit = spans.select(F.col(start).alias("span_from"), F.col(end).alias("span_to")).where((F.col("span_to") >= F.col("span_from")) & (F.col("span_to") - F.col("span_from") <= longest)).distinct()
    bins = fit.withColumn("span_bin", F.explode(F.sequence(F.floor(F.col("span_from") / width), F.floor(F.col("span_to") / width))))
    at = points.select(F.col(point).alias("point_at")).distinct().withColumn("point_bin", F.floor(F.col("point_at") / width))
    best = F.min(F.when(F.col("span_from").isNotNull(), F.struct((F.col("span_to") - F.col("span_from")).alias("length"), F.col("span_from").alias("start"))))
    held = at.join(bins, (F.col("point_bin") == F.col("span_bin")) & F.col("point_at").between(F.col("span_from"), F.col("span_to")), "left")
    return held.groupBy(F.col("point_at").alias(point)).agg(best.alias("best_span")).select(point, F.col("best_span.start").alias("span_start"), F.col("best_span.length").alias("span_length"))


def metric_summary(df: DataFrame, metrics: list[str]) -> DataFrame:
    """Mean, minimum and maximum of each metric over the rows; NULLs are skipped, a metric without values is absent."""
    long = df.select([F.col(m).cast("double").alias(m) for m in metrics]).unpivot([], metrics, "metric", "value")
    return long.where("value IS NOT NULL").groupBy("metric").agg(F.avg("value").alias("mean"), F.min("value").alias("low"), F.max("value").alias("high"))


def drift(declared: DataFrame, locked: DataFrame, key: str, satisfied: Column) -> DataFrame:
    """missing (declared, not locked), undeclared (locked directly, not declared), unsatisfied (the constraint is false; NULL is unknown)."""
    missing = declared.join(locked, key, "left_anti").select(key, F.lit("missing").alias("kind"))
    extra = locked.where("direct").join(declared, key, "left_anti").select(key, F.lit("undeclared").alias("kind"))
    wrong = declared.join(locked, key).where(~satisfied).select(key, F.lit("unsatisfied").alias("kind"))
    return missing.unionByName(extra).unionByName(wrong)


def unseen_by_either(df: DataFrame, seen: DataFrame, keys: list[str], seen_key: str) -> DataFrame:
    """Rows none of whose `keys` is in `seen`: one equal-key anti-join for each key, in place of an OR."""
    known = seen.select(F.col(seen_key).alias("_k")).distinct()
    for k in keys:
        df = df.join(known, df[k] == known["_k"], "left_anti")
    return df


def unique_prefix(short: DataFrame, full: DataFrame, prefix: str, name: str, length: int) -> DataFrame:
    """Prefixes of `length` that begin exactly one of the distinct names, with that name."""
    only = full.select(name).distinct().groupBy(F.substring(name, 1, length).alias(prefix)).agg(F.count("*").alias("_n"), F.min(name).alias(name)).where("_n = 1")
    return short.select(prefix).distinct().join(only.select(prefix, name), prefix)


def running_numbers(df: DataFrame, key: str, order: str, removed: Column) -> DataFrame:
    """Line numbers on the new side: a removed line doesn't advance them and has none; one that may or may not be removed (null) isn't."""
    w, gone = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0), F.coalesce(removed, F.lit(False))
    return df.withColumn("new_line", F.when(~gone, F.sum(F.when(gone, 0).otherwise(1)).over(w)).cast("long"))


def around_changes(df: DataFrame, key: str, order: str, changed: Column, reach: int) -> DataFrame:
    """Rows at most `reach` rows from a changed row of their key."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(-reach, reach)
    near = unused(df, "near")
    return df.withColumn(near, F.max(F.when(changed, 1).otherwise(0)).over(w)).where(F.col(near) == 1).drop(near)


def ordered_digest(df: DataFrame, key: str, order: str, line: str, length: int = 16) -> DataFrame:
    """SHA-256 of each key's lines in order, joined by newlines, its first `length` hex digits. Memory follows one key's lines."""
    lines = F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(line).alias("t")))), lambda x: x["t"])
    return df.groupBy(key).agg(F.substring(F.sha2(F.concat_ws("\n", lines), 256), 1, length).alias("digest"))


def listed(df: DataFrame, key: str, column: str, most: int = 5) -> DataFrame:
    """A count, and the first `most` distinct values joined by commas with 'and n more' for the rest."""
    n = df.groupBy(key).agg(F.count("*").alias("n"))
    each = df.select(key, column).distinct()
    r = unused(each, "nth")
    ranked = each.withColumn(r, F.row_number().over(Window.partitionBy(key).orderBy(column)))
    names = F.concat_ws(", ", F.transform(F.array_sort(F.collect_list(F.when(F.col(r) <= most, F.struct(F.col(r).alias("r"), F.col(column).alias("v"))))), lambda x: x["v"].cast("string")))
    total = F.count(column)
    text = ranked.groupBy(key).agg(F.concat(names, F.when(total > most, F.concat(F.lit(" and "), total - most, F.lit(" more"))).otherwise("")).alias("names"))
    return n.join(text, key)


def named_by_short(short: DataFrame, full: DataFrame, prefix: str, name: str) -> DataFrame:
    """(prefix, name): each distinct `prefix`, of any length, that begins exactly one of the distinct names. Names are cut to the lengths that occur, so the join is by equal texts."""
    wanted = short.select(prefix).where(F.col(prefix) != "").distinct().withColumn("n", F.char_length(prefix))
    lengths = wanted.groupBy().agg(F.collect_set("n").alias("lengths"))
    cut = full.select(name).distinct().join(F.broadcast(lengths), F.lit(True)).select(name, F.explode("lengths").alias("n")).where(F.char_length(name) >= F.col("n"))
    keyed = cut.select(F.substr(F.col(name), F.lit(1), F.col("n")).alias(prefix), name)
    return keyed.join(wanted.select(prefix), prefix, "left_semi").groupBy(prefix).agg(F.count(F.lit(1)).alias("k"), F.min(name).alias(name)).where("k = 1").select(prefix, name)
