"""Recorded answers of code forges as tables: changed files, issues and the changes linked to them.

Items come from sources.pages as (change, pos, item), item being JSON. What can't be read has no row; a field of another type counts as absent.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from revlens.functions.paths import base_name, language
from revlens.sources.diffs import HUNK

# What a forge calls a change of a file; suffixes that are never text.
STATUSES = {"added": "added", "removed": "deleted", "modified": "modified", "renamed": "renamed", "changed": "modified", "copied": "added"}
BINARY = ("png", "jpg", "jpeg", "gif", "pdf", "zip")


def _field(name: str, kind: str = "string") -> Column:
    return F.try_variant_get("v", f"$.{name}", kind)


def _filled(value: Column) -> Column:
    return F.nullif(value, F.lit(""))


def _maps(items: DataFrame, *rest: str) -> DataFrame:
    """Items that are maps, as `v`."""
    rows = items.select(*rest, F.try_parse_json("item").alias("v"))
    return rows.where(F.coalesce(F.schema_of_variant("v").startswith("OBJECT"), F.lit(False)))


def _classified(rows: DataFrame) -> DataFrame:
    """Files (path, previous_path, change_type, patch, ...) with language, is_binary, needs_text and diff: a patch without hunks tells nothing, a file of a binary suffix is binary, and another one's patch must be made from its texts."""
    has_hunks = F.coalesce(F.col("patch"), F.lit("")).rlike(rf"(?m)^{HUNK[2:-2]}$")
    binary = ~has_hunks & F.lower(F.substring_index(base_name(F.col("path")), ".", -1)).isin(*BINARY) & base_name(F.col("path")).contains(".")
    old = F.coalesce("previous_path", "path")
    diff = F.concat(F.lit("diff --git a/"), old, F.lit(" b/"), "path", F.lit("\n--- a/"), old, F.lit("\n+++ b/"), "path", F.lit("\n"), "patch")
    return rows.withColumns({"language": language(F.col("path")), "is_binary": binary, "needs_text": ~has_hunks & ~binary, "diff": F.when(has_hunks, diff)})


def pull_files(items: DataFrame) -> DataFrame:
    """(change, pos, path, previous_path, change_type, patch, language, is_binary, needs_text, diff) of a listing of a pull request's files."""
    kinds = F.create_map(*[F.lit(x) for pair in STATUSES.items() for x in pair])
    rows = _maps(items, "change", "pos")
    kind = F.coalesce(F.element_at(kinds, F.coalesce(_field("status"), F.lit(""))), F.lit("modified"))
    return _classified(rows.select("change", "pos", F.coalesce(_field("filename"), F.lit("")).alias("path"), _filled(_field("previous_filename")).alias("previous_path"), kind.alias("change_type"), _field("patch").alias("patch")))


def merge_files(items: DataFrame) -> DataFrame:
    """The same of a merge request's changes: new before deleted before renamed, and a previous path only where the file was renamed. An entry without any path is left out."""
    rows = _maps(items, "change", "pos")
    yes = lambda name: F.coalesce(_field(name, "boolean"), F.lit(False))
    kind = F.when(yes("new_file"), "added").when(yes("deleted_file"), "deleted").when(yes("renamed_file"), "renamed").otherwise("modified")
    path = F.coalesce(_filled(_field("new_path")), _filled(_field("old_path")))
    told = rows.select("change", "pos", path.alias("path"), F.when(yes("renamed_file"), _filled(_field("old_path"))).alias("previous_path"), kind.alias("change_type"), _field("diff").alias("patch"))
    return _classified(told.where("path IS NOT NULL"))


def recovered_states(files: DataFrame, texts: DataFrame, most_bytes: int = 1 << 20) -> DataFrame:
    """(change, path, state) of files that need their texts: `texts` (change, path, old, new, old_bytes, new_bytes, readable) are what a revision holds of each side.

    binary: a side isn't text; zero_byte: both are empty; patch_unavailable: a side can't be read, is over `most_bytes`, or both are equal, unless the
    file is deleted; else text, from which a patch can be made.
    """
    met = files.where("needs_text").select("change", "path", "change_type").join(texts, ["change", "path"], "left")
    readable = F.coalesce("readable", F.lit(False))
    large = (F.coalesce("old_bytes", F.lit(0)) > most_bytes) | (F.coalesce("new_bytes", F.lit(0)) > most_bytes)
    side = lambda c: F.coalesce(F.col(c), F.lit(""))
    odd = F.contains(side("old"), F.lit("\0")) | F.contains(side("new"), F.lit("\0"))
    empty = (side("old") == "") & (side("new") == "")
    state = F.when(~readable | large, "patch_unavailable").when(odd, "binary").when(empty, "zero_byte").when(side("old") == side("new"), F.when(F.col("change_type") == "deleted", "text").otherwise("patch_unavailable")).otherwise("text")
    return met.select("change", "path", state.alias("state"))


def issues(payloads: DataFrame, comments: DataFrame, merge: bool = False) -> DataFrame:
    """(change, title, body, labels, state, comments, problem) of issues (change, item) with their comments (change, pos, item) in order.

    A pull request isn't an issue: it has a problem and nothing else, as has what is no map. System notes are left out, and comments and labels without text.
    """
    rows = payloads.select("change", F.try_parse_json("item").alias("v"))
    is_map = F.coalesce(F.schema_of_variant("v").startswith("OBJECT"), F.lit(False))
    request = F.lit(False) if merge else F.coalesce(F.schema_of_variant(F.try_variant_get("v", "$.pull_request", "variant")).startswith("OBJECT"), F.lit(False))
    problem = F.when(~is_map, "no issue").when(request, "a pull request")
    raw = F.coalesce(_field("labels", "array<variant>"), F.array().cast("array<variant>"))
    label = (lambda x: F.try_variant_get(x, "$", "string")) if merge else (lambda x: F.try_variant_get(x, "$.name", "string"))
    labels = F.filter(F.transform(raw, label), lambda x: F.coalesce(x, F.lit("")) != "")
    body = _field("description" if merge else "body")
    told = rows.select("change", *[F.when(problem.isNull(), c).alias(n) for n, c in (("title", F.coalesce(_field("title"), F.lit(""))), ("body", F.coalesce(body, F.lit(""))), ("labels", labels), ("state", F.coalesce(_field("state"), F.lit(""))))], problem.alias("problem"))
    said = _maps(comments, "change", "pos").where(~F.coalesce(_field("system", "boolean"), F.lit(False))).select("change", "pos", _filled(_field("body")).alias("body")).where("body IS NOT NULL")
    listed = said.groupBy("change").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "body"))), lambda x: x["body"]).alias("comments"))
    met = told.join(listed, "change", "left")
    return met.select("change", "title", "body", "labels", "state", F.when(F.col("problem").isNull(), F.coalesce("comments", F.array().cast("array<string>"))).alias("comments"), "problem")


def links(events: DataFrame, projects: DataFrame) -> DataFrame:
    """(change, pos, number, state, updated_at): cross references of pull requests in an issue's timeline (change, pos, item), those of other projects than its own (change, project) left out. linked_changes() takes the last of each number."""
    rows = _maps(events, "change", "pos").where(_field("event") == "cross-referenced")
    source = F.try_variant_get("v", "$.source.issue", "variant")
    rows = rows.select("change", "pos", source.alias("v")).where(F.coalesce(F.schema_of_variant("v").startswith("OBJECT"), F.lit(False)))
    rows = rows.where(F.coalesce(F.schema_of_variant(F.try_variant_get("v", "$.pull_request", "variant")).startswith("OBJECT"), F.lit(False)))
    whole = F.schema_of_variant(F.try_variant_get("v", "$.number", "variant")) == "BIGINT"
    told = rows.select("change", "pos", F.when(whole, _field("number", "long")).alias("number"), F.coalesce(_field("state"), F.lit("")).alias("state"), F.coalesce(_field("updated_at"), F.lit("")).alias("updated_at"), _filled(F.try_variant_get("v", "$.repository.full_name", "string")).alias("of"))
    met = told.where("number IS NOT NULL").join(projects.dropDuplicates(["change"]), "change", "left")
    return met.where(F.col("of").isNull() | F.col("of").eqNullSafe(F.col("project"))).select("change", "pos", "number", "state", "updated_at")
