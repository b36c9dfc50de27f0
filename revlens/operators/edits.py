"""Replacements put into texts: what is left of a file's lines, and the replacements in the place of the others."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revlens.sources.diffs import split_lines


def apply_edits(files: DataFrame, edits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(file, text) of the `files` (file, text) that `edits` (pos, file, start_line, end_line, suggestion) change, and (pos, reason) of the edits that do nothing.

    Edits don't overlap (ambiguous_edits() tells which may be applied), so putting them in from the last to the first is the same as putting them all in at
    once: covered lines go by an anti-join, and each replacement stands where its first line stood. A file's line ends stay what they are;
    reasons are line_ends (of both kinds in one file, or single carriage returns), outside (no such lines) and no_change. The last line
    keeps or lacks its end as before.
    """
    crlf = F.contains("text", F.lit("\r\n"))
    plain = F.replace(F.col("text"), F.lit("\r\n"), F.lit("\n"))
    lone = F.contains(plain, F.lit("\r")) | (crlf & F.contains(F.replace(F.col("text"), F.lit("\r\n"), F.lit("")), F.lit("\n")))
    told = files.select("file", crlf.alias("crlf"), lone.alias("mixed"), plain.endswith("\n").alias("ends"), F.when(lone, F.array().cast("array<string>")).otherwise(split_lines(plain)).alias("lines"))
    wanted = edits.select("pos", "file", "start_line", "end_line", F.regexp_replace(F.replace(F.coalesce("suggestion", F.lit("")), F.lit("\r\n"), F.lit("\n")), r"\n\z", "").alias("new"))
    met = wanted.join(told.select("file", "mixed", F.size("lines").alias("n")), "file", "left")
    fits = F.coalesce((F.col("start_line") >= 1) & (F.col("start_line") <= F.col("end_line")) & (F.col("end_line") <= F.col("n")), F.lit(False))
    met = met.withColumn("reason", F.when(F.coalesce("mixed", F.lit(False)), "line_ends").when(~fits, "outside"))
    lines = told.where("NOT mixed").select("file", F.posexplode("lines").alias("at", "line")).select("file", (F.col("at") + 1).alias("at"), "line")
    covered = met.where("reason IS NULL").select("pos", "file", "new", "start_line", F.explode(F.sequence(F.col("start_line").cast("int"), F.col("end_line").cast("int"))).alias("at"))
    old = covered.join(lines, ["file", "at"]).groupBy("pos", "file", "new", "start_line").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "line"))), lambda x: x["line"]), "\n").alias("old"))
    same = old.where("old = new").select("pos", F.lit("no_change").alias("reason"))
    live = old.where("old <> new").select("pos", "file", "new", "start_line")
    gone = covered.join(live.select("pos"), "pos", "left_semi").select("file", "at")
    changed = live.select("file").distinct()
    rest = lines.join(changed, "file", "left_semi").join(gone, ["file", "at"], "left_anti")
    every = rest.unionByName(live.select("file", F.col("start_line").cast("int").alias("at"), F.col("new").alias("line")))
    text = every.groupBy("file").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "line"))), lambda x: x["line"]), "\n").alias("text"))
    whole = text.join(told.select("file", "crlf", "ends"), "file")
    body = F.concat("text", F.when(F.col("ends"), "\n").otherwise(""))
    out = whole.select("file", F.when(F.col("crlf"), F.replace(body, F.lit("\n"), F.lit("\r\n"))).otherwise(body).alias("text"))
    return out, met.where("reason IS NOT NULL").select("pos", "reason").unionByName(same)
