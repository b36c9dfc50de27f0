"""Unified diffs as tables, by built-in expressions: lines become rows and running sums number them.

A diff's lines meet in one task, in order; a window spills, so memory doesn't follow a diff's length.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from revlens.functions.paths import language

HUNK = r"\A@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@(.*)\z"


def split_lines(text: Column) -> Column:
    """The lines of a text, without an empty one after its last newline; none of an empty text."""
    parts = F.split(F.regexp_replace(F.coalesce(text, F.lit("")), "\r\n?", "\n"), "\n")
    return F.when(F.get(parts, F.size(parts) - 1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)


def _count(text: Column, group: int) -> Column:
    """A hunk's number of lines: 1 where the header names none; a written 0 stays."""
    got = F.regexp_extract(text, HUNK, group)
    return F.when(got == "", 1).otherwise(got.try_cast("int"))


def diff_lines(diffs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, block, hunk, pos, line, mark, position, new_line, old_line): every line of every file block.

    A block begins at `diff --git`, or at the first `---` before any; lines ahead of it go. hunk 0 is a block's head.
    position counts hunk heads and body lines across a file's hunks; a line that begins with a backslash counts
    nowhere. mark is head, @, +, -, space or \\.
    """
    rows = diffs.select(key, F.posexplode(split_lines(F.col(text))).alias("pos", "line"))
    whole = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    git = F.col("line").startswith("diff --git ")
    either = F.sum((git | F.col("line").startswith("--- ")).cast("int")).over(whole)
    # A first --- opens a block only where no block is open yet.
    rows = rows.withColumn("either", either).withColumn("opens", (git | ((F.col("either") == 1) & F.col("line").startswith("--- "))).cast("int"))
    rows = rows.withColumn("block", F.sum("opens").over(whole)).where("block > 0").drop("either", "opens")
    in_block = Window.partitionBy(key, "block").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    head = F.col("line").rlike(HUNK)
    rows = rows.withColumn("hunk", F.sum(head.cast("int")).over(in_block))
    mark = F.when(F.col("hunk") == 0, "head").when(head, "@").when(F.substring("line", 1, 1).isin("+", "-", "\\"), F.substring("line", 1, 1)).otherwise(" ")
    rows = rows.withColumn("mark", mark)
    counts = F.col("mark").isin("@", "+", "-", " ")
    rows = rows.withColumn("position", F.when(counts, F.sum(counts.cast("int")).over(in_block)))
    in_hunk = Window.partitionBy(key, "block", "hunk").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    number = lambda group, marks: F.first(F.regexp_extract("line", HUNK, group).try_cast("long")).over(in_hunk) + F.sum(F.col("mark").isin(*marks).cast("int")).over(in_hunk) - 1
    return rows.withColumns({
        "new_line": F.when(F.col("mark").isin("+", " "), number(3, ("+", " "))),
        "old_line": F.when(F.col("mark").isin("-", " "), number(1, ("-", " "))),
    })


def _path(text: Column) -> Column:
    """A path of a head without a/ or b/ and without a tab's rest; /dev/null is none."""
    bare = F.trim(text)
    return F.when(bare != "/dev/null", F.regexp_replace(F.substring_index(bare, "\t", 1), r"\A[ab]/", ""))


def diff_files(lines: DataFrame, key: str) -> DataFrame:
    """(key, block, path, previous_path, change_type, language, is_binary, hunks, added): a row for each file block of diff_lines()."""
    head = F.col("mark") == "head"
    last = lambda prefix: F.max_by(F.substring("line", len(prefix) + 1, 1 << 20), F.when(head & F.col("line").startswith(prefix), F.col("pos")))
    last_at = lambda prefix: F.max(F.when(head & F.col("line").startswith(prefix), F.col("pos")))
    kinds = {"added": "new file mode", "deleted": "deleted file mode", "renamed": "rename to "}
    said = F.array_max(F.array_compact(F.array(*[F.when(F.col(f"said_{k}").isNotNull(), F.struct(F.col(f"said_{k}").alias("pos"), F.lit(k).alias("kind"))) for k in kinds])))
    files = lines.groupBy(key, "block").agg(
        last("--- ").alias("minus"),
        last("+++ ").alias("plus"),
        last("rename from ").alias("from"),
        last("rename to ").alias("to"),
        F.min_by("line", "pos").alias("first"),
        *[last_at(prefix).alias(f"said_{k}") for k, prefix in kinds.items()],
        F.coalesce(F.bool_or(head & (F.col("line").startswith("Binary files ") | F.col("line").startswith("GIT binary patch"))), F.lit(False)).alias("is_binary"),
        F.max("hunk").alias("hunks"),
        F.count_if(F.col("mark") == "+").alias("added"),
    )
    git = r"\Adiff --git (.*?) b/(.*)\z"
    bare = F.col("minus").isNull() & F.col("plus").isNull()
    old = F.coalesce(F.trim("from"), F.when(bare, _path(F.nullif(F.regexp_extract("first", git, 1), F.lit("")))).otherwise(_path(F.col("minus"))))
    new = F.coalesce(F.trim("to"), F.when(bare, F.nullif(F.regexp_extract("first", git, 2), F.lit(""))).otherwise(_path(F.col("plus"))))
    files = files.withColumns({"old": old, "new": new, "change_type": F.coalesce(said["kind"], F.lit("modified"))})
    files = files.withColumn("path", F.coalesce("new", "old", F.lit("")))
    previous = F.when((F.col("change_type") == "renamed") & ~F.col("old").eqNullSafe(F.col("new")), F.col("old"))
    none = F.when(F.col("is_binary"), 0)
    return files.select(key, "block", "path", previous.alias("previous_path"), "change_type", language(F.col("path")).alias("language"), "is_binary", F.coalesce(none, "hunks").cast("int").alias("hunks"), F.coalesce(none, "added").cast("long").alias("added"))


def diff_hunks(lines: DataFrame, key: str) -> DataFrame:
    """(key, block, hunk, old_start, old_lines, new_start, new_lines, header)."""
    number = lambda g: F.regexp_extract("line", HUNK, g).try_cast("long")
    return lines.where("mark = '@'").select(key, "block", "hunk", number(1).alias("old_start"), _count(F.col("line"), 2).alias("old_lines"), number(3).alias("new_start"), _count(F.col("line"), 4).alias("new_lines"), F.trim(F.regexp_extract("line", HUNK, 5)).alias("header"))


def sub_hunk(lines: DataFrame, key: str, first: Column, last: Column) -> DataFrame:
    """(key, block, hunk, old_start, old_lines, new_start, new_lines) of the lines of each hunk from its `first` to its `last` body line, counted from 1."""
    body = lines.where("mark IN ('+', '-', ' ')")
    nth = F.row_number().over(Window.partitionBy(key, "block", "hunk").orderBy("pos"))
    old, new = F.col("mark").isin("-", " "), F.col("mark").isin("+", " ")
    w = Window.partitionBy(key, "block", "hunk").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    heads = diff_hunks(lines, key).select(key, "block", "hunk", F.col("old_start").alias("o"), F.col("new_start").alias("n"))
    body = body.withColumns({"nth": nth, "old_before": F.coalesce(F.sum(old.cast("int")).over(w), F.lit(0)), "new_before": F.coalesce(F.sum(new.cast("int")).over(w), F.lit(0))})
    part = body.where(F.col("nth").between(first, last)).groupBy(key, "block", "hunk").agg(F.min("old_before").alias("ob"), F.min("new_before").alias("nb"), F.count_if(old).alias("old_lines"), F.count_if(new).alias("new_lines"))
    return part.join(heads, [key, "block", "hunk"]).select(key, "block", "hunk", (F.col("o") + F.col("ob")).alias("old_start"), "old_lines", (F.col("n") + F.col("nb")).alias("new_start"), "new_lines")


def numbered(lines: DataFrame) -> DataFrame:
    """With shown: body lines as a prompt shows them, the new side's number in six places before the line."""
    label = F.when(F.col("new_line").isNull(), F.repeat(F.lit(" "), F.lit(6))).otherwise(F.lpad(F.col("new_line").cast("string"), F.greatest(F.lit(6), F.char_length(F.col("new_line").cast("string"))), " "))
    return lines.where("mark IN ('+', '-', ' ')").withColumn("shown", F.concat(label, F.lit(" "), F.col("line")))


def trimmed(lines: DataFrame, key: str, most: int, reaches: tuple[int, ...] = (6, 4, 3, 2, 1)) -> DataFrame:
    """Body lines of hunks of at most `most` lines; of longer ones the changed lines and those around them, by the first reach that fits, else the last; `gap` lines went before a row. A hunk without changes keeps its first lines."""
    by = [key, "block", "hunk"]
    w, whole = Window.partitionBy(*by).orderBy("pos"), Window.partitionBy(*by)
    rows = lines.where("mark IN ('+', '-', ' ')")
    changed = F.col("mark").isin("+", "-").cast("int")
    rows = rows.withColumns({"nth": F.row_number().over(w), "of": F.count("*").over(whole), "any": F.max(changed).over(whole), **{f"near{r}": F.max(changed).over(w.rowsBetween(-r, r)) for r in reaches}})
    rows = rows.withColumns({f"size{r}": F.sum(f"near{r}").over(whole) for r in reaches})
    keep = F.col(f"near{reaches[-1]}")
    for r in reversed(reaches[:-1]):
        keep = F.when(F.col(f"size{r}") <= most, F.col(f"near{r}")).otherwise(keep)
    keep = F.when(F.col("of") <= most, 1).when(F.col("any") == 0, (F.col("nth") <= most).cast("int")).otherwise(keep)
    kept = rows.withColumn("keep", keep).where("keep = 1")
    gap = F.coalesce(F.col("nth") - F.lag("nth").over(w) - 1, F.lit(0))
    return kept.select(*lines.columns, gap.alias("gap"))


def positions(points: DataFrame, lines: DataFrame, key: str) -> DataFrame:
    """`points` (key, block, line) with hunk and position: where a line of the new side stands in the diff, in the first hunk that shows it; null where none does. `lines` are those of diff_lines()."""
    at = lines.where("new_line IS NOT NULL").groupBy(key, "block", F.col("new_line").alias("line")).agg(F.min(F.struct("hunk", "position")).alias("at"))
    return points.join(at, [key, "block", "line"], "left").select(*points.columns, "at.hunk", "at.position")


def with_gaps(kept: DataFrame, key: str) -> DataFrame:
    """(key, block, hunk, pos, place, shown): trimmed() as it is told: the lines in order, and before each that follows a gap a row that says how many were left out, at the same pos and one place before."""
    by = [key, "block", "hunk"]
    note = F.concat(F.lit("... "), F.col("gap").cast("string"), F.lit(" unchanged lines omitted ..."))
    rows = numbered(kept).select(*by, "pos", "gap", "shown")
    told = rows.select(*by, "pos", F.explode(F.when(F.col("gap") > 0, F.array(F.struct(F.lit(0).alias("place"), note.alias("shown")), F.struct(F.lit(1).alias("place"), F.col("shown")))).otherwise(F.array(F.struct(F.lit(1).alias("place"), F.col("shown"))))).alias("r"))
    return told.select(*by, "pos", "r.place", "r.shown")


def whole_file(files: DataFrame, path: str, text: str) -> DataFrame:
    """The lines of a text as one hunk of additions: (path, line, position, text), position one more than the line."""
    rows = files.select(path, F.posexplode(split_lines(F.col(text))).alias("i", "text"))
    return rows.select(path, (F.col("i") + 1).alias("line"), (F.col("i") + 2).alias("position"), F.concat(F.lit("+"), F.col("text")).alias("text"))


def flow_digest(files: DataFrame, hunks: DataFrame, key: str) -> DataFrame:
    """(key, digest) of a change's shape: files in order of path with their hunks' heads, not what is inside them. Memory follows one change's heads."""
    head = F.concat_ws("|", F.col("path"), F.coalesce("previous_path", F.lit("")), F.col("change_type"))
    top = files.select(key, "block", F.col("path"), F.lit(0).alias("hunk"), head.alias("part"))
    each = hunks.join(files.select(key, "block", "path"), [key, "block"]).select(key, "block", "path", "hunk", F.concat_ws(",", "old_start", "old_lines", "new_start", "new_lines").alias("part"))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("path", "block", "hunk", "part"))), lambda x: x["part"])
    return top.unionByName(each).groupBy(key).agg(F.substring(F.sha2(F.array_join(parts, "\n"), 256), 1, 16).alias("digest"))


def recovered(pairs: DataFrame, path: str, old: str, new: str, most_bytes: int = 1 << 20) -> DataFrame:
    """`pairs` with diff: a patch between two texts, by difflib in Arrow batches; null for a text over `most_bytes`, one with a NUL, or two empty ones."""
    @F.pandas_udf("string")
    def make(paths: pd.Series, olds: pd.Series, news: pd.Series) -> pd.Series:
        import difflib

        out = []
        for p, a, b in zip(paths, olds, news, strict=True):
            body = "\n".join(difflib.unified_diff((a or "").splitlines(), (b or "").splitlines(), f"a/{p}", f"b/{p}", lineterm=""))
            out.append(f"diff --git a/{p} b/{p}\n{body}\n")
        return pd.Series(out)

    a, b = F.coalesce(old, F.lit("")), F.coalesce(new, F.lit(""))
    fine = (F.octet_length(a) <= most_bytes) & (F.octet_length(b) <= most_bytes) & ~F.contains(a, F.lit("\0")) & ~F.contains(b, F.lit("\0")) & ((a != "") | (b != ""))
    return pairs.withColumn("diff", F.when(fine, make(F.col(path), F.when(fine, a), F.when(fine, b))))
