"""Package snapshots: what moved between two, where manifest and lock disagree, in what order that is told.

A snapshot has a row (ecosystem, dir, name, version, source, integrity, direct, ref) for each package; empty texts mean absent.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from revlens.functions import text as X
from revlens.functions import versions as V

KEY = ["ecosystem", "dir", "name"]
#: Kinds of change in the order in which they are told.
KINDS = ("source_changed", "integrity_lost", "integrity_changed", "manifest_lock_drift", "added", "downgraded", "removed", "upgraded")
_COLUMNS = ["version", "source", "integrity", "direct", "ref"]


def _side(df: DataFrame, name: str) -> DataFrame:
    return df.select(*KEY, F.struct(*[F.coalesce(c, F.lit(False) if c == "direct" else F.lit("")).alias(c) for c in _COLUMNS]).alias(name))


def note_for_new() -> Column:
    """Why a new package deserves a look: reasons joined, the first letter large and the rest as it is."""
    reasons = F.array_compact(
        F.array(
            F.when(~F.col("new.direct"), F.lit("pulled in transitively rather than declared")),
            F.when(X.mutable_ref(F.col("new.ref")), F.concat(F.lit("pinned to the mutable reference `"), F.col("new.ref"), F.lit("`"))),
            F.when((F.col("new.source") != "") & (F.col("new.integrity") == ""), F.lit("resolved from a source with no checksum recorded")),
        )
    )
    joined = F.array_join(reasons, "; ")
    return F.when(joined == "", "").otherwise(F.concat(F.upper(F.substring(joined, 1, 1)), F.substring(joined, 2, 1 << 20), F.lit(".")))


def compare(old: DataFrame, new: DataFrame) -> DataFrame:
    """A row for each package that was added, removed or moved; of several moves the first of: source, lost checksum, other checksum, reference, version."""
    both = _side(old, "old").join(_side(new, "new"), KEY, "full")
    o, n = F.col("old"), F.col("new")
    kind = (
        F.when(o.isNull(), "added")
        .when(n.isNull(), "removed")
        .when(o["source"] != n["source"], "source_changed")
        .when((o["integrity"] != "") & (n["integrity"] == ""), "integrity_lost")
        .when((o["integrity"] != "") & (o["integrity"] != n["integrity"]), "integrity_changed")
        .when(o["ref"] != n["ref"], "source_changed")
        .when(o["version"] != n["version"], V.version_move(o["version"], n["version"]))
    )
    place = lambda s: F.when(s == "", "the default registry").otherwise(s)
    ref_note = F.when(X.mutable_ref(n["ref"]), F.concat(F.lit("Pinned to the moving reference `"), n["ref"], F.lit("`."))).when(n["ref"] != "", F.concat(F.lit("Now pinned to `"), n["ref"], F.lit("`."))).otherwise("No longer pinned to a git reference.")
    note = (
        F.when(o.isNull(), note_for_new())
        .when(n.isNull(), "")
        .when(o["source"] != n["source"], F.concat(F.lit("Now resolved from "), place(n["source"]), F.lit(" instead of "), place(o["source"]), F.lit(".")))
        .when(F.col("kind") == "integrity_lost", "It had a checksum and has none now.")
        .when((F.col("kind") == "integrity_changed") & (o["version"] == n["version"]), "The artefact changed without its version.")
        .when(F.col("kind") == "source_changed", ref_note)
        .otherwise("")
    )
    direct = F.coalesce(n["direct"], F.lit(False)) | F.coalesce(o["direct"], F.lit(False))
    told = both.withColumn("kind", kind).where("kind IS NOT NULL").withColumn("note", note)
    return told.select(*KEY, "kind", o["version"].alias("old_version"), n["version"].alias("new_version"), o["source"].alias("old_source"), n["source"].alias("new_source"), direct.alias("direct"), "note")


def drift(manifest: DataFrame, lock: DataFrame) -> DataFrame:
    """Where a lock doesn't follow its manifest: missing, undeclared (direct ones only), unsatisfied (known to be; unknown forms stay quiet)."""
    both = _side(manifest, "old").join(_side(lock, "new"), KEY, "full")
    want, have = F.col("old.version"), F.col("new.version")
    kind = (
        F.when(F.col("new").isNull(), "missing")
        .when(F.col("old").isNull(), F.when(F.col("new.direct"), "undeclared"))
        .when(~V.satisfies(F.col("ecosystem"), want, have), "unsatisfied")
    )
    return both.withColumn("kind", kind).where("kind IS NOT NULL").select(*KEY, "kind", have.alias("locked"), want.alias("declared"))


def ranked(changes: DataFrame, most: int | None = None) -> DataFrame:
    """In the order of telling: kind, direct ones first, ecosystem, name. What is cut off is the tail of that order."""
    kind = F.coalesce(F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind")), F.lit(0))
    out = changes.orderBy(F.when(kind == 0, 9).otherwise(kind - 1), F.col("direct").desc(), "ecosystem", "name", "dir")
    return out.limit(most) if most is not None else out


def counterpart(assets: DataFrame, files: DataFrame, candidates: list[str]) -> DataFrame:
    """`assets` (ecosystem, dir) with the first of the candidate names that stands in `files` (dir, name, text) and isn't empty; null for none."""
    rank = F.array_position(F.array(*[F.lit(c) for c in candidates]), F.col("name"))
    first = files.where((rank > 0) & (F.trim(F.coalesce("text", F.lit(""))) != "")).groupBy("dir").agg(F.min_by("name", rank).alias("counterpart"))
    return assets.join(first, "dir", "left").select(*assets.columns, "counterpart")
