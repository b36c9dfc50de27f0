"""Functions and classes of Python texts by indentation, and which of those that a change touches are documented."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from revlens.operators.graph import touched

#: The head of a function or class that ends on its own line.
HEAD = r"(?U)\A[ \t]*(?:(?:async\s+)?def|class)\s+(\w+)\b.*:\s*(?:#.*)?\z"


def indentation(text: Column) -> Column:
    return F.char_length(F.regexp_extract(text, r"\A([ \t]*)", 1))


def blocks(lines: DataFrame, key: str, head: str) -> DataFrame:
    """(key, line, text, indent, next_indent, next_text, nth, above, end_line): the heads among `lines` (key, line, text) and where what they head ends; null at the end of a text.

    A block ends before the next line that isn't blank and stands no further in. For each indentation at which a text has a
    head, its lines as far in or less are one ordered window; a text has few of those. `above` is the last line before that is no decorator. Brackets and strings
    that run over lines aren't parsed.
    """
    rows = lines.where(F.col("text").rlike(r"\S")).select(key, "line", "text", indentation(F.col("text")).alias("indent"))
    w = Window.partitionBy(key).orderBy("line")
    here = F.when(~F.ltrim("text", F.lit(" \t")).startswith("@"), F.struct("line", "text", F.row_number().over(w).alias("nth")))
    rows = rows.withColumns({"next_indent": F.lead("indent").over(w), "next_text": F.lead("text").over(w), "nth": F.row_number().over(w), "is_head": F.col("text").rlike(head), "here": here})
    rows = rows.withColumn("above", F.last("here", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))).drop("here")
    levels = rows.where("is_head").select(key, F.col("indent").alias("level")).distinct()
    at_level = rows.join(levels, key).where("indent <= level")
    ended = at_level.withColumn("after", F.lead("line").over(Window.partitionBy(key, "level").orderBy("line"))).where("is_head AND indent = level")
    return ended.select(key, "line", "text", "indent", "next_indent", "next_text", "nth", "above", (F.col("after") - 1).alias("end_line"))


def python_symbols(lines: DataFrame, key: str) -> DataFrame:
    """(key, name, start_line, end_line, documented): functions and classes of `lines` (key, line, text).

    One is documented by a text that opens its body, or by a comment with words on the line right above it, or above its decorators. A block at
    the end of a text runs to its last line. A head that goes over several lines is none.
    """
    found = blocks(lines, key, HEAD)
    last = lines.groupBy(key).agg(F.max("line").alias("last_line"))
    opens = F.ltrim("next_text", F.lit(" \t")).rlike(r"""(?i)\A[rbuf]{0,2}["']""") & (F.col("next_indent") > F.col("indent"))
    # All lines between it and what stands above are decorators, without a blank one.
    between = F.col("nth") - F.col("above.nth") - 1
    comment = F.ltrim("above.text", F.lit(" \t"))
    told = (F.col("above.line") == F.col("line") - between - 1) & comment.startswith("#") & (F.trim(comment, F.lit(" \t/*#-")) != "")
    return found.join(last, key).select(key, F.regexp_extract("text", HEAD, 1).alias("name"), F.col("line").alias("start_line"), F.coalesce("end_line", "last_line").alias("end_line"), (F.coalesce(opens, F.lit(False)) | F.coalesce(told, F.lit(False))).alias("documented"))


def documentation(lines: DataFrame, changed: DataFrame, change: str, file: str) -> DataFrame:
    """(change, documented, total, undocumented): of the symbols of each change's files (`lines`: change, file, line, text) that an added line (`changed`: change, file, line) touches, how many are documented, and the places of the others in order; a change without such symbols has no row."""
    at = lambda df: df.withColumn("file", F.concat_ws("\x1f", F.col(change).cast("string"), F.col(file)))
    keyed = at(lines.withColumnRenamed(file, "_path").withColumn(file, F.col("_path")))
    symbols = python_symbols(keyed.select("file", "line", "text"), "file").withColumn("id", F.concat_ws("\x1f", "file", F.col("start_line").cast("string")))
    hit = touched(symbols, at(changed).select("file", "line"))
    own = keyed.select("file", F.col(change).alias("_change"), "_path").distinct()
    met = hit.join(own, "file")
    place = F.when(~F.col("documented"), F.struct(F.col("_path").alias("path"), F.col("start_line").alias("line"), "name"))
    return met.groupBy(F.col("_change").alias(change)).agg(F.count_if("documented").alias("documented"), F.count(F.lit(1)).alias("total"), F.array_sort(F.collect_list(place)).alias("undocumented"))
