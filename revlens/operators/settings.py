"""Layered settings: JSON documents laid over each other, maps merged key by key, anything else replaced as a whole."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revlens.operators.tables import Rounds


def leaves(layers: DataFrame) -> DataFrame:
    """(key, rank, path, value) from (key, rank, document): a row for each value of a JSON document that isn't a map with entries.

    path is the array of keys down to it, value its JSON. A list is one value; so is a map without entries. A document that is no JSON,
    or null, has none. Maps are opened level by level, each level a written table, until none is left.
    """
    rounds = Rounds(layers)
    left = layers.select("key", "rank", F.array().cast("array<string>").alias("path"), F.try_parse_json("document").alias("v")).where("v IS NOT NULL")
    done = []
    while True:
        kind = F.schema_of_variant("v")
        left = rounds.put(left.select("key", "rank", "path", "v", (kind.startswith("OBJECT<") & (kind != "OBJECT<>")).alias("opens")))
        done.append(left.where("NOT opens").select("key", "rank", "path", F.to_json("v").alias("value")))
        more = left.where("opens")
        if more.isEmpty():
            return reduce(DataFrame.unionAll, done)
        left = _opened(more)


def _opened(maps: DataFrame) -> DataFrame:
    """The entries of maps."""
    inner = maps.select(F.col("key").alias("k"), "rank", "path", "v")
    entry = maps.sparkSession.tvf.variant_explode(F.col("v").outer())
    return inner.lateralJoin(entry).select(F.col("k"), "rank", F.array_append("path", F.col("key")).alias("path"), F.col("value").alias("v")).withColumnRenamed("k", "key")


def merged(rows: DataFrame) -> DataFrame:
    """(key, path, value): what is left of leaves() (key, rank, path, value) when layers go over each other by rank, the greatest last.

    A value goes if a later layer has a value in its place or above it, or a map in its place. A map without
    entries replaces a value, but adds nothing to a map. A place knows the last layer that has a value there, and the last that
    has a map, as grouped maxima; a value meets those of the places above it by equal (key, path).
    """
    empty = F.col("value") == "{}"
    depth = F.size("path")
    above = rows.select("key", "rank", F.explode(F.when(depth > 0, F.transform(F.sequence(F.lit(0), depth - 1), lambda n: F.slice("path", F.lit(1), n))).otherwise(F.array().cast("array<array<string>>"))).alias("path"))
    marks = rows.select("key", "path", F.when(~empty, F.col("rank")).alias("as_value"), F.when(empty, F.col("rank")).alias("as_map")).unionByName(above.select("key", "path", F.lit(None).cast(rows.schema["rank"].dataType).alias("as_value"), F.col("rank").alias("as_map")))
    places = marks.groupBy("key", "path").agg(F.max("as_value").alias("last_value"), F.max("as_map").alias("last_map"))
    # Of one place, the last value, or else the last empty map.
    own = rows.groupBy("key", "path").agg(F.max_by(F.struct("rank", "value"), "rank").alias("last"), F.max("rank").alias("rank"))
    here = own.join(places, ["key", "path"]).where((F.col("last.value") == "{}") | F.col("last_map").isNull() | (F.col("rank") > F.col("last_map")))
    here = here.where((F.col("last.value") != "{}") | F.col("last_value").isNull() | (F.col("rank") > F.col("last_value")))
    chain = here.select("key", F.col("path").alias("at"), "rank", F.col("last.value").alias("value"), F.explode_outer(F.when(F.size("path") > 0, F.transform(F.sequence(F.lit(0), F.size("path") - 1), lambda n: F.slice("path", F.lit(1), n)))).alias("path"))
    blocks = places.where("last_value IS NOT NULL").select("key", "path", F.col("last_value").alias("block"))
    kept = chain.join(blocks, ["key", "path"], "left").groupBy("key", F.col("at").alias("path")).agg(F.max("block").alias("block"), F.first("rank").alias("rank"), F.first("value").alias("value"))
    kept = kept.where(F.col("block").isNull() | (F.col("block") < F.col("rank"))).select("key", "path", "value")
    # An empty map that got entries from another layer isn't empty.
    full = kept.select("key", F.explode(F.when(F.size("path") > 0, F.transform(F.sequence(F.lit(0), F.size("path") - 1), lambda n: F.slice("path", F.lit(1), n)))).alias("path")).distinct()
    bare = kept.where(F.col("value") == "{}").join(full, ["key", "path"], "left_anti")
    return kept.where(F.col("value") != "{}").unionByName(bare)


def documents(rows: DataFrame) -> DataFrame:
    """(key, document) from (key, path, value): maps are put together from the deepest up, keys in order; one round a level."""
    rounds = Rounds(rows)
    rows = rounds.put(rows.select("key", "path", "value"))
    deepest = rows.agg(F.max(F.size("path"))).first()[0] or 0
    for depth in range(deepest, 0, -1):
        low = F.size("path") == depth
        name = F.element_at("path", -1)
        quoted = F.regexp_replace(F.to_json(F.array(name)), r"(?s)\A\[(.*)\]\z", "$1")
        entry = F.struct(name.alias("name"), F.concat(quoted, F.lit(":"), F.col("value")).alias("text"))
        maps = rows.where(low).groupBy("key", F.slice("path", 1, depth - 1).alias("path")).agg(F.array_sort(F.collect_list(entry)).alias("entries"))
        text = F.concat(F.lit("{"), F.array_join(F.transform("entries", lambda e: e["text"]), ","), F.lit("}"))
        rows = rounds.put(rows.where(~low).unionByName(maps.select("key", "path", text.alias("value"))))
    return rows.select("key", F.col("value").alias("document"))


def overlay_documents(layers: DataFrame) -> DataFrame:
    """(key, document): JSON `layers` (key, rank, document) of each key over each other, the greatest rank last. A key without any readable document is absent."""
    return documents(merged(leaves(layers)))


def with_profiles(layers: DataFrame, profiles: DataFrame, default: str, field: str = "profile") -> DataFrame:
    """(key, path, value, problem): merged `layers` over the defaults of the profile that they name, or of `default`.

    `profiles` (profile, document) lie beneath everything explicit, whichever layer names the profile. A name that isn't among
    them gives one row for its key, with the name as `problem` and nothing else: settings that nobody asked for are worse than none.
    """
    own = Rounds(layers).put(merged(leaves(layers)))
    named = own.where(F.col("path") == F.array(F.lit(field))).select("key", F.get_json_object(F.concat(F.lit('{"v":'), F.col("value"), F.lit("}")), "$.v").alias("profile"))
    keys = layers.select("key").distinct().join(named, "key", "left").withColumn("profile", F.coalesce("profile", F.lit(default)))
    known = profiles.select("profile").distinct().withColumn("known", F.lit(True))
    keys = keys.join(known, "profile", "left")
    beneath = leaves(profiles.select(F.col("profile").alias("key"), F.lit(0).alias("rank"), "document")).select(F.col("key").alias("profile"), "path", "value")
    low = keys.where("known").join(beneath, "profile").select("key", F.lit(0).alias("rank"), "path", "value")
    high = own.join(keys.where("known").select("key"), "key", "left_semi").select("key", F.lit(1).alias("rank"), "path", "value")
    out = merged(low.unionByName(high)).withColumn("problem", F.lit(None).cast("string"))
    lost = keys.where("known IS NULL").select("key", F.lit(None).cast("array<string>").alias("path"), F.lit(None).cast("string").alias("value"), F.col("profile").alias("problem"))
    return out.unionByName(lost)
