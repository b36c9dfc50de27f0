"""Mixing sources to target weights by Pareto order sampling.

A source whose target is r times its words takes floor(r) certain copies of each of its documents. The
rest, a part f of its words, is drawn without replacement: document i ranks by the odds of a random
number over the odds of its inclusion, (u / (1 - u)) / (f / (1 - f)), and documents are taken in that
order until the sample has its fixed size in words (the document at the edge goes to the nearer side).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from revlens.llm.common import Stored

#: Bits of the rank that one round of the search for the edge resolves.
STEP_BITS = 12


def n_words(text: Column) -> Column:
    """Number of maximal runs without ASCII white space; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(store: Stored, sizes: DataFrame, max_times: float = 3.0, share: float = 1.0, weights: int = 3) -> DataFrame:
    """(source, source_size, weight, target) from (source, size).

    Sources by code point, null last, weigh 1 .. `weights`, repeating. Targets are the level of water
    in vessels as wide as the weights and as high as `max_times` their size. The order of sources comes
    from a range-partitioned sort and the sizes of its partitions, so no task sees all sources.
    """
    ranked = store.put(sizes.groupBy("source").agg(F.sum("size").alias("source_size")).orderBy(F.col("source").asc_nulls_last()).withColumn("p", F.spark_partition_id()).withColumn("i", F.monotonically_increasing_id()))
    parts = {r.p: r.n for r in ranked.groupBy("p").agg(F.count("*").alias("n")).collect()}  # a row for each partition
    start, before = {}, 0
    for p in sorted(parts):
        start[p], before = before, before + parts[p]
    offset = F.create_map(*[F.lit(x) for p, n in start.items() for x in (p, n)])[F.col("p")] if start else F.lit(0)
    row = F.col("i").bitwiseAND(F.lit((1 << 33) - 1)) + offset
    held = ranked.select("source", "source_size", (row % weights + 1).cast("double").alias("weight"))
    cap = F.col("source_size") * F.lit(float(max_times))
    total = held.agg(F.sum("source_size")).first()[0] or 0
    goal, level = total * share, None
    while True:
        over = F.lit(False) if level is None else cap <= F.col("weight") * F.lit(level)
        used, free = held.agg(F.sum(F.when(over, cap).otherwise(0.0)), F.sum(F.when(over, 0.0).otherwise(F.col("weight")))).first()
        new = (goal - used) / free if free else level
        if not free or new == level or (level is not None and new <= level):
            break
        level = new
    target = F.lit(0.0) if level is None else F.least(cap, F.col("weight") * F.lit(level))
    return held.withColumn("target", target.cast("double"))


def mix(docs: DataFrame, max_times: float = 3.0, share: float = 1.0, weights: int = 3, seed: int = 17) -> DataFrame:
    """(doc_id, size, source_size, target, taken, copies), a row for each row of `docs` (doc_id, text, source); other columns are left out.

    Ranks come from a hash of doc_id, seed and text, so reruns agree. Rows equal in all three are interchangeable: of
    those at the edge, as many are taken as the target asks for. Null doc_id, text and source are values like others; a
    null or empty text has size 0 and is never taken; a long text counts whole. An empty table gives an empty table.
    """
    store = Stored(docs.sparkSession)
    u = (F.shiftrightunsigned(F.xxhash64(F.col("doc_id"), F.lit(seed), F.xxhash64("text")), 11).cast("double") + 0.5) / float(1 << 53)
    sized = store.put(docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), u.alias("u")))
    targets = store.put(source_targets(store, sized, max_times, share, weights).withColumn("times", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)).withColumn("whole", F.floor("times")).withColumn("part", F.col("times") - F.col("whole")).withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size")))
    same = sized["source"].eqNullSafe(targets["source"])
    odds = (F.col("u") / (1 - F.col("u"))) / F.when((F.col("part") > 0) & (F.col("part") < 1), F.col("part") / (1 - F.col("part"))).otherwise(1.0)
    # odds / (1 + odds) keeps the order of the odds and lies between 0 and 1: bits of it are the digits of the search.
    rank = F.floor(odds / (1 + odds) * F.lit(float(1 << 48))).cast("long")
    ranked = store.put(sized.join(targets, same).select(sized["source"], "doc_id", "size", "u", "source_size", "target", "whole", "rest", rank.alias("rank")))
    edge = _edge(store, ranked)
    same = ranked["source"].eqNullSafe(edge["source"])
    mine = F.struct("rank", "u", F.coalesce("doc_id", F.lit(0)))
    at = F.struct("edge_rank", "edge_u", "edge_id")
    met = ranked.join(edge.withColumnRenamed("source", "edge_source"), ranked["source"].eqNullSafe(F.col("edge_source")), "left")
    met = met.withColumn("tied", F.coalesce((mine == at) & (F.col("size") > 0), F.lit(False))).withColumn("drawn", F.coalesce(mine < at, F.lit(False)))
    some = F.col("tied") & (F.col("edge_take") < F.col("edge_rows"))

    def rows(df: DataFrame, drawn: Column) -> DataFrame:
        copies = F.when(F.col("size") == 0, 0).otherwise(F.col("whole") + drawn.cast("long"))
        return df.select("doc_id", "size", "source_size", "target", (F.col("size") * copies).cast("long").alias("taken"), copies.cast("long").alias("copies"))

    # Equal rows at the edge of which some are taken: numbered within the partition they are stored in, then by partition.
    equal = store.put(met.where(some).withColumn("part", F.spark_partition_id()))
    within = F.row_number().over(Window.partitionBy("source", "part").orderBy("doc_id"))
    before = equal.groupBy("source", "part").agg(F.count("*").alias("n")).withColumn("before", F.sum("n").over(_by("part")) - F.col("n"))
    before = before.select(F.col("source").alias("bs"), F.col("part").alias("bp"), "before")
    numbered = equal.withColumn("k", within).join(before, F.col("source").eqNullSafe(F.col("bs")) & (F.col("part") == F.col("bp")))
    return rows(met.where(~some), F.col("tied") | F.col("drawn")).unionByName(rows(numbered, F.col("k") + F.col("before") <= F.col("edge_take")))


def _edge(store: Stored, ranked: DataFrame) -> DataFrame:
    """(source, edge_rank, edge_u, edge_id): the last document taken from each source that takes a part.

    Rounds of grouped sums over STEP_BITS bits of the rank close in on the edge, so that no task
    orders a source; what is left in the last bin (one of 2**36) is ordered in a window.
    """
    left = ranked.where((F.col("rest") > 0) & (F.col("size") > 0)).select("source", "rank", "u", "size", F.coalesce("doc_id", F.lit(0)).alias("id"), F.col("rest").cast("double").alias("rest"))
    for shift in (36, 24, 12):
        bins = left.groupBy("source", F.shiftright("rank", shift).alias("bin")).agg(F.sum("size").alias("n"), F.first("rest").alias("rest"))
        up_to = F.sum("n").over(_by("bin"))
        bins = bins.withColumn("up_to", up_to).withColumn("before", F.col("up_to") - F.col("n"))
        last = F.max("bin").over(_all())
        hit = bins.withColumn("last", last).where(((F.col("up_to") >= F.col("rest")) | (F.col("bin") == F.col("last"))) & (F.col("before") < F.col("rest"))).select(F.col("source").alias("hs"), F.col("bin").alias("hb"), "before")
        # Where rest > all, the last bin is the hit; every source that has rows has one hit.
        nxt = left.join(hit, F.col("source").eqNullSafe(F.col("hs")) & (F.shiftright("rank", shift) == F.col("hb")))
        left = store.put(nxt.select("source", "rank", "u", "size", "id", (F.col("rest") - F.col("before")).alias("rest")))
    # Equal rows are one row here, with their number.
    rows = left.groupBy("source", "rank", "u", "id", "size", "rest").agg(F.count("*").alias("n"))
    rows = rows.withColumn("before", F.sum(F.col("n") * F.col("size")).over(_by("rank", "u", "id")) - F.col("n") * F.col("size"))
    # The document at the edge is taken if that comes nearer to the target.
    open_ = F.greatest(F.col("rest") - F.col("before"), F.lit(0.0))
    fit = F.floor(open_ / F.col("size"))
    rows = rows.withColumn("take", F.least(F.col("n"), fit + ((open_ > 0) & (2 * (open_ - fit * F.col("size")) >= F.col("size"))).cast("long")))
    taken = rows.where("take > 0").groupBy("source").agg(F.max(F.struct("rank", "u", "id", "take", "n")).alias("e"))
    # Where the last bin gives none, all of the bins before it are taken: the edge lies just before its first row.
    none = rows.groupBy("source").agg(F.min("rank").alias("lo"))
    out = none.join(taken.withColumnRenamed("source", "ts"), F.col("source").eqNullSafe(F.col("ts")), "left")
    return out.select("source", F.coalesce("e.rank", F.col("lo")).alias("edge_rank"), F.coalesce("e.u", F.lit(-1.0)).alias("edge_u"), F.coalesce("e.id", F.lit(0).cast("long")).alias("edge_id"), F.coalesce("e.take", F.lit(0).cast("long")).alias("edge_take"), F.coalesce("e.n", F.lit(0).cast("long")).alias("edge_rows"))


def _by(*cols: str):
    return Window.partitionBy("source").orderBy(*cols).rowsBetween(Window.unboundedPreceding, 0)


def _all():
    return Window.partitionBy("source")
