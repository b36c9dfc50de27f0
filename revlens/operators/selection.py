"""Which commands verify a change: the broad one, or the narrow ones whose paths it touches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revlens.functions.paths import matches_any


def select_commands(files: DataFrame, commands: list[tuple[str, list[str], list[str]]], broad: list[str], broaden: list[str], most: int, key: str) -> DataFrame:
    """(key, place, name, command, scope) of each change of `files` (key, path, change_type, is_binary).

    `commands` are (name, argv, globs) in the order of the settings. A path of `broaden` takes the broad command in place of all others; else every
    command one of whose globs meets a path counts, the first of equal argv; else the broad one; `most` at most. Deleted and binary files
    don't count, and a change without others takes none. A change's paths become one row of flags before
    anything is chosen, so a change of any number of files costs one small row for each task.
    """
    argv = [tuple(c) for _, c, _ in commands]
    # Settings of equal argv are one command with the globs of each; the first gives the name.
    firsts = [i for i, c in enumerate(argv) if c not in argv[:i]]
    real = files.where((F.coalesce("change_type", F.lit("")) != "deleted") & ~F.coalesce("is_binary", F.lit(False)))
    path = F.col("path")
    flags = [F.bool_or(matches_any(path, globs)).alias(f"hit_{i}") for i, (_, _, globs) in enumerate(commands)]
    met = real.groupBy(key).agg((F.bool_or(matches_any(path, broaden)) if broad else F.bool_or(F.lit(False))).alias("broadens"), *flags)
    row = lambda order, name, command, scope: F.struct(order.alias("order"), F.lit(name).alias("name"), F.array(*[F.lit(a) for a in command]).cast("array<string>").alias("command"), F.lit(scope).alias("scope"))
    narrow = []
    for i in firsts:
        same = [j for j, c in enumerate(argv) if c == argv[i]]
        # The setting that matches first names it and gives its place.
        for n, j in enumerate(same):
            earlier = F.lit(False)
            for k in same[:n]:
                earlier = earlier | F.col(f"hit_{k}")
            name, command, _ = commands[j]
            narrow.append(F.when(F.col(f"hit_{j}") & ~earlier, row(F.lit(j), name or " ".join(command), command, "targeted")))
    wide = F.array(row(F.lit(0), " ".join(broad), broad, "broad")) if broad else F.array().cast("array<struct<order:int,name:string,command:array<string>,scope:string>>")
    targeted = F.array_sort(F.array_compact(F.array(*narrow))) if narrow else wide
    chosen = F.when(F.col("broadens") | (F.size(targeted) == 0), wide).otherwise(targeted)
    rows = met.select(key, F.posexplode(F.slice(chosen, 1, most)).alias("place", "c"))
    return rows.select(key, "place", "c.name", "c.command", "c.scope")




#: Origins whose files lie in the working tree.
CHECKED_OUT = ("local", "paths")


def availability(changes: DataFrame, checkouts: DataFrame) -> DataFrame:
    """(change, reads, reason): whether the files on disk are those under review, of `changes` (change, origin, head) and `checkouts` (change, commit, status).

    A local change's are. Of another the checkout must be at its head, and clean, by a status that could be read; the first reason that speaks against it is given.
    """
    met = changes.select("change", "origin", "head").join(checkouts.select("change", "commit", "status").dropDuplicates(["change"]), "change", "left")
    told = lambda c: F.trim(F.coalesce(c, F.lit("")))
    reason = (
        F.when(F.col("origin").isin(*CHECKED_OUT), None)
        .when(told("head") == "", "no head")
        .when(told("commit") == "", "no checkout")
        .when(told("commit") != told("head"), "another commit")
        .when(F.col("status").isNull(), "status unknown")
        .when(told("status") != "", "uncommitted changes")
    )
    return met.select("change", reason.isNull().alias("reads"), reason.alias("reason"))


def gated(runs: DataFrame, access: DataFrame) -> DataFrame:
    """`runs` (change, ...) with state and note: those of a change whose files may not be read are refused, with the reason; the others are due."""
    met = runs.join(access.select("change", "reads", "reason"), "change", "left")
    free = F.coalesce("reads", F.lit(False))
    return met.select(*runs.columns, F.when(free, "due").otherwise("refused").alias("state"), F.when(~free, F.coalesce("reason", F.lit("unknown change"))).alias("note"))
