"""Who uses what a change touches: hits in an order of worth, confirmed within a budget, and what that proves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from revlens.functions import paths as P

#: Relations in the order in which a node's few places are given away.
RELATIONS = ("call", "import", "test", "config")
# Languages of settings.
CONFIG_LANGUAGES = ("yaml", "toml", "json", "ini")


def relation(path: Column, text: Column) -> Column:
    """How a line uses a name: as a test, by importing it, as a setting (or in a file of no known language), or by calling it."""
    bare = F.ltrim(F.coalesce(text, F.lit("")), F.lit(" \t\n\x0b\x0c\r"))
    words = F.split(bare, r"\s+", 4)
    named = (F.get(words, F.lit(0)) == "from") & (F.coalesce(F.get(words, F.lit(1)), F.lit("")) != "") & F.coalesce(F.get(words, F.lit(2)), F.lit("")).rlike(r"(?U)\Aimport\b")
    imports = named | bare.rlike(r"(?U)\A(?:import|export|#include)\b|\Ause\s|\Arequire\s*\(")
    language = P.language(path)
    return F.when(P.is_test(path), "test").when(imports, "import").when(language.isNull() | language.isin(*CONFIG_LANGUAGES), "config").otherwise("call")


def select_consumers(hits: DataFrame, most: int) -> DataFrame:
    """(node, pos, path, line, relation, outcome, place): at most `most` uses of each node, foremost first, from `hits` (node, pos, path, line, text, outcome).

    Hits stand in the order of their relation, then of `pos`. The first 3 x `most` of a node are looked at: outcome true is code, false a
    literal, which is no use, null unknown. Later ones fill what is left unseen, and one follows even a full list where the last
    that was looked at is a literal. Ranks are limited before the shuffle, so a name that stands in a third of all files sends a few rows from
    each task.
    """
    return _ranked(hits, most).where(F.col("use") & (F.col("place") <= most)).select("node", "pos", "path", "line", "relation", "outcome", "place")


def _ranked(hits: DataFrame, most: int) -> DataFrame:
    """The hits of each node that decide anything, with `use` and `place` among the uses."""
    budget = 3 * most
    told = hits.withColumn("relation", relation(F.col("path"), F.col("text"))).withColumn("rank", F.array_position(F.array(*[F.lit(r) for r in RELATIONS]), F.col("relation")))
    nth = F.row_number().over(Window.partitionBy("node").orderBy("rank", "pos"))
    top = told.select("node", "pos", "path", "line", "relation", "rank", "outcome").withColumn("nth", nth).where(F.col("nth") <= budget + max(most, 1))
    literal = (F.col("nth") <= budget) & F.coalesce(~F.col("outcome"), F.lit(False))
    ordered = Window.partitionBy("node").orderBy("nth")
    before = F.coalesce(F.sum((~literal).cast("int")).over(ordered.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    seen = F.lag(literal).over(ordered)
    rows = top.withColumns({"literal": literal, "before": before, "after_literal": F.coalesce(seen, F.lit(False))})
    # Beyond the budget a hit counts as long as there is room, or if it is the first and a literal stands before it.
    beyond = (F.col("nth") > budget) & (F.col("before") >= most) & ~((F.col("nth") == budget + 1) & F.col("after_literal"))
    return rows.withColumn("use", ~F.col("literal") & ~beyond).withColumn("place", F.col("before") + 1)


def consumer_status(nodes: DataFrame, hits: DataFrame, most: int, whole_search: bool) -> DataFrame:
    """(node, status, verification, truncated, hits, literals, shown) of each of `nodes` (node, kind, parsed).

    consumers_found where any use is shown, parsed if one that was looked at is code. Without one, contained needs four things at once: a
    symbol, found by a parser, a `whole_search` without limits, and not even a literal; else no_references_found.
    """
    total = hits.groupBy("node").agg(F.count(F.lit(1)).alias("hits"))
    looked = F.col("nth") <= 3 * most
    told = _ranked(hits, most).groupBy("node").agg(F.count_if("use").alias("uses"), F.count_if(F.col("literal")).alias("literals"), F.coalesce(F.bool_or(looked & F.coalesce("outcome", F.lit(False))), F.lit(False)).alias("code"))
    met = nodes.join(total, "node", "left").join(told, "node", "left")
    uses, literals = F.coalesce("uses", F.lit(0)), F.coalesce("literals", F.lit(0))
    found = F.least(uses, F.lit(most)) > 0
    contained = (F.col("kind") == "symbol") & F.col("parsed") & F.lit(whole_search) & (literals == 0)
    status = F.when(found, "consumers_found").when(contained, "contained").otherwise("no_references_found")
    proof = F.when(found, F.when(F.col("code"), "parsed").otherwise("textual")).when(contained, "parsed").otherwise("textual")
    return met.select("node", status.alias("status"), proof.alias("verification"), (uses > most).alias("truncated"), F.coalesce("hits", F.lit(0)).alias("hits"), literals.alias("literals"), F.least(uses, F.lit(most)).alias("shown"))


def map_status(statuses: DataFrame, key: str, limited: Column) -> DataFrame:
    """(key, status): of each change's nodes (key, status, ...): limited, any use found, all contained, else no reference found."""
    every = statuses.groupBy(key).agg(F.bool_or(limited).alias("limited"), F.bool_or(F.col("status") == "consumers_found").alias("found"), F.bool_and(F.col("status") == "contained").alias("contained"))
    return every.select(key, F.when(F.col("limited"), "limited").when(F.col("found"), "consumers_found").when(F.col("contained"), "contained").otherwise("no_references_found").alias("status"))
