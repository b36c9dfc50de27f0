"""Bounded lists and counts that a report takes from a change, each with word of what it left out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from revlens.functions import paths as P
from revlens.functions import text as X
from revlens.operators.findings import is_unproven_blocker
from revlens.operators.grouping import path_stem

# Locks that are known by name but not read; scanners of the supply chain.
UNREAD_LOCKS = ("Pipfile.lock", "Gemfile.lock", "packages.lock.json", "gradle.lockfile", "mix.lock", "pubspec.lock", "flake.lock")
SCANNERS = ("osv-scanner", "checkov", "hadolint", "actionlint")
#: Roles whose files tell others what they may rely on.
BOUNDARY_ROLES = ("contract", "schema_config")


def omitted_roles(files: DataFrame, key: str) -> DataFrame:
    """(key, role, files): how many files of each role were not reviewed; `files` (key, role, reviewed)."""
    return files.where(~F.coalesce("reviewed", F.lit(False))).groupBy(key, "role").agg(F.count(F.lit(1)).alias("files"))


def report_facts(assets: DataFrame, nodes: DataFrame, operations: DataFrame, key: str, dependency: tuple[str, ...] = ("dependency_manifest", "dependency_lock")) -> DataFrame:
    """(key, kinds, has_dependencies, consumers, executed) of each change named in any of `assets` (key, kind), `nodes` (key, consumers array), `operations` (key, outcome): distinct kinds in order, whether any is a dependency's, how many consumers in all, whether anything was run."""
    kinds = assets.groupBy(key).agg(F.array_sort(F.collect_set("kind")).alias("kinds"))
    used = nodes.groupBy(key).agg(F.sum(F.coalesce(F.size("consumers"), F.lit(0))).alias("consumers"))
    ran = operations.groupBy(key).agg(F.bool_or(F.col("outcome") == "executed").alias("executed"))
    every = assets.select(key).unionByName(nodes.select(key)).unionByName(operations.select(key)).distinct()
    met = every.join(kinds, key, "left").join(used, key, "left").join(ran, key, "left")
    none = F.array().cast("array<string>")
    return met.select(key, F.coalesce("kinds", none).alias("kinds"), F.arrays_overlap(F.coalesce("kinds", none), F.array(*[F.lit(d) for d in dependency])).alias("has_dependencies"), F.coalesce("consumers", F.lit(0)).cast("long").alias("consumers"), F.coalesce("executed", F.lit(False)).alias("executed"))


def listed_assets(files: DataFrame, key: str, most: int = 20) -> tuple[DataFrame, DataFrame]:
    """(key, pos, path, kind, truncated) of the first `most` assets of each change in its order, and (key, name, path, pos) of locks that can't be read, the first file of each name; `files` (key, pos, path, is_binary). Binary files are neither."""
    text, name = files.where(~F.coalesce("is_binary", F.lit(False))), P.base_name(F.col("path"))
    # A row's number, besides settling ties, keeps Spark from moving conditions on the kind below its computation, which would repeat the computation of path for every glob.
    told = lambda rows: rows.select(key, "pos", "path", P.asset_kind(F.col("path")).alias("kind"), F.monotonically_increasing_id().alias("row"))
    # One more than wanted tells that there are more.
    first = told(text).where("kind IS NOT NULL").withColumn("nth", F.row_number().over(Window.partitionBy(key).orderBy("pos", "row"))).where(F.col("nth") <= most + 1).drop("row")
    first = first.withColumn("truncated", F.max("nth").over(Window.partitionBy(key)) > most).where(F.col("nth") <= most).drop("nth")
    unread = told(text.where(name.isin(*UNREAD_LOCKS))).where("kind IS NULL").groupBy(key, name.alias("name")).agg(F.min(F.struct("pos", "path", "row")).alias("f")).select(key, "name", "f.path", "f.pos")
    return first, unread


def contract_contexts(files: DataFrame, nodes: DataFrame, key: str, most: int = 12) -> DataFrame:
    """(key, place, path, name, kind, line): the contracts that one pass hands to the next, `most` at most.

    First the `nodes` (key, pos, path, name, kind, line) that stand in a boundary file of `files` (key, path, role, first_added), in their order, each file and
    name once; then by path the boundary files that have no such node, by their stem.
    """
    boundary = files.where(F.col("role").isin(*BOUNDARY_ROLES)).select(key, "path", "role", "first_added").dropDuplicates([key, "path"])
    own = nodes.join(boundary.select(key, "path"), [key, "path"], "left_semi").groupBy(key, "path", "name").agg(F.min(F.struct("pos", "kind", "line")).alias("n"))
    traced = own.select(key, F.lit(0).alias("part"), F.col("n.pos").alias("pos"), "path", "name", "n.kind", F.col("n.line").cast("long").alias("line"))
    bare = boundary.join(own.select(key, "path").distinct(), [key, "path"], "left_anti")
    kind = F.when(F.col("role") == "schema_config", "config_key").otherwise("export")
    named = bare.select(key, F.lit(1).alias("part"), F.lit(0).cast("long").alias("pos"), "path", path_stem(F.col("path")).alias("name"), kind.alias("kind"), F.coalesce("first_added", F.lit(1)).cast("long").alias("line"))
    every = traced.withColumn("pos", F.col("pos").cast("long")).unionByName(named)
    place = F.row_number().over(Window.partitionBy(key).orderBy("part", "pos", "path"))
    return every.withColumn("place", place).where(F.col("place") <= most).select(key, "place", "path", "name", "kind", "line")


def investigated(findings: DataFrame, key: str, most: int) -> DataFrame:
    """The first `most` findings of each review that are worth another look, with `place`: a model's that the evidence rule would demote, or of major severity or more; the worst, surest and first first."""
    worth = (F.col("source") == "llm") & (F.coalesce(is_unproven_blocker(), F.lit(False)) | X.at_least(F.col("severity"), "major"))
    order = [X.rank_of(F.col("severity")).desc(), F.col("confidence").desc(), F.col("file"), F.col("start_line"), F.col("pos")]
    return findings.where(F.coalesce(worth, F.lit(False))).withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("place") <= most)


def skipped_scanners(skipped: DataFrame, key: str, scanners: tuple[str, ...] = SCANNERS) -> DataFrame:
    """(key, pos, note): a note for each scanner of the supply chain among `skipped` (key, pos, tool, reason)."""
    return skipped.where(F.col("tool").isin(*scanners)).select(key, "pos", F.concat(F.lit("Scanner `"), "tool", F.lit("` did not run: "), F.coalesce("reason", F.lit(""))).alias("note"))


def language_notes(files: DataFrame, instructions: dict[str, str], key: str) -> DataFrame:
    """(key, notes): a line for each language among a change's files that has instructions, in the order of their names."""
    named = F.create_map(*[F.lit(x) for pair in instructions.items() for x in pair]) if instructions else None
    if named is None:
        return files.select(key, F.lit("").alias("notes")).limit(0)
    told = files.groupBy(key).agg(F.array_sort(F.collect_set(F.when(F.col("language").isin(*instructions), F.col("language")))).alias("names"))
    line = F.transform("names", lambda n: F.concat(F.lit("- "), n, F.lit(": "), F.element_at(named, n)))
    return told.where(F.size("names") > 0).select(key, F.array_join(line, "\n").alias("notes"))


def for_unit(evidence: DataFrame, unit: DataFrame, key: list[str], most: int | None = None, *order: Column) -> DataFrame:
    """`evidence` of the files that a unit holds: those whose `key` is in it, at most `most` of each unit's first column of `key` in the order given."""
    met = evidence.join(unit.select(*key).distinct(), key, "left_semi")
    if most is None:
        return met
    return met.withColumn("nth", F.row_number().over(Window.partitionBy(key[0]).orderBy(*order))).where(F.col("nth") <= most).drop("nth")
