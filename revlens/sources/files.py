"""A directory as a table of texts, and what is left out of it and why."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from revlens.functions.paths import matches_any
from revlens.functions.text import rank_of, strip

#: Directories that are never read.
PRUNED = (".git", ".hg", ".svn", ".bzr", "node_modules", "vendor", "dist", "build", "target", "out", "__pycache__", ".venv", "venv", ".tox", ".nox", ".mypy_cache", ".pytest_cache", ".ruff_cache", ".cache", ".next", ".nuxt", ".gradle", ".idea", ".terraform")
MOST_BYTES, HEAD = 512 * 1024, 8192


def directory(spark: SparkSession, root: str) -> DataFrame:
    """(path, length, content) of all files below a folder that Spark can read, pruned directories left out."""
    at = root.rstrip("/")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(at)
    path = F.regexp_replace(F.col("path"), rf"\A.*?\Q{at.split(':')[-1]}\E/", "")
    pruned = "|".join(rf"\Q{d}\E" for d in PRUNED)
    return files.select(path.alias("path"), "length", "content").where(~F.col("path").rlike(rf"(?:\A|/)(?:{pruned})/"))


def eligible(files: DataFrame, ignore: list[str], keep: list[str], most: int) -> DataFrame:
    """`files` with omitted: the first `most` paths in order stay, the rest are marked and still listed. Ignored paths go; kept globs stay whatever the budget or the ignores say."""
    kept = matches_any(F.col("path"), keep)
    rows = files.where(kept | ~matches_any(F.col("path"), ignore)).withColumn("is_kept", kept)
    # The rank is over paths alone: contents don't travel through the sort.
    rank = rows.where(~F.col("is_kept")).select("path").orderBy("path").limit(most).withColumn("in_budget", F.lit(True))
    return rows.join(rank, "path", "left").withColumn("omitted", ~(F.col("is_kept") | F.coalesce("in_budget", F.lit(False)))).drop("is_kept", "in_budget")


def decoded(files: DataFrame) -> DataFrame:
    """(path, text, is_binary, omission): a file over the limit is omitted, one with a NUL in its first bytes or no valid UTF-8 is binary, others are texts with plain newlines."""
    large = F.col("length") > MOST_BYTES
    binary = (F.locate("\0", F.substring("content", 1, HEAD).cast("string")) > 0) | ~F.is_valid_utf8(F.col("content").cast("string"))
    text = F.when(~large & ~binary, F.regexp_replace(F.decode("content", "UTF-8"), "\r\n?", "\n"))
    return files.select("path", text.alias("text"), (~large & binary).alias("is_binary"), F.when(large, "too_large").alias("omission"))


def attach(files: DataFrame, texts: DataFrame) -> DataFrame:
    """Changed files (path, change_type, is_binary) with their text; binary and deleted ones have none."""
    wanted = files.withColumn("wants", ~F.col("is_binary") & (F.col("change_type") != "deleted"))
    met = wanted.join(texts.select("path", "text"), "path", "left")
    return met.withColumn("text", F.when(F.col("wants"), F.col("text"))).drop("wants")


def reviewable(files: DataFrame, ignore: list[str]) -> DataFrame:
    """Files that aren't binary, don't match an ignored glob and have hunks or a text."""
    return files.where(~F.col("is_binary") & ~matches_any(F.col("path"), ignore) & ((F.col("hunks") > 0) | F.col("text").isNotNull()))


def drops(files: DataFrame, kept: DataFrame, ignore: list[str]) -> DataFrame:
    """(path, reason) of the files that aren't in `kept`: zero_byte, patch_unavailable, binary or ignored, the first that holds."""
    why = F.when(F.col("zero_byte"), "zero_byte").when(F.col("patch_unavailable"), "patch_unavailable").when(F.col("is_binary"), "binary").when(matches_any(F.col("path"), ignore), "ignored").otherwise("empty")
    return files.join(kept.select("path").distinct(), "path", "left_anti").select("path", why.alias("reason")).distinct()


def rules(files: DataFrame) -> DataFrame:
    """(id, severity, enabled, body, path) of markdown rules (path, text): head lines between --- are `name: value`; a rule without an id takes its file's name; one without a body goes."""
    has = r"(?s)\A---[ \t]*\n(.*?)\n---[ \t]*\n(.*)\z"
    head = F.when(F.col("text").rlike(has), F.regexp_extract("text", has, 1)).otherwise("")
    body = strip(F.when(F.col("text").rlike(has), F.regexp_extract("text", has, 2)).otherwise(F.col("text")))
    field = lambda name: F.nullif(F.regexp_replace(F.regexp_extract(head, rf"(?m)^{name}:[ \t]*(.*?)[ \t]*$", 1), r"\A[\"']|[\"']\z", ""), F.lit(""))
    stem = F.regexp_extract("path", r"([^/]*?)(?:\.[^./]*)?\z", 1)
    word = field("id")
    name = F.coalesce(F.when(~F.lower(word).isin("on", "off", "yes", "no", "true", "false"), word), stem)
    out = files.select(name.alias("id"), F.coalesce(F.lower(field("severity")), F.lit("minor")).alias("severity"), (F.coalesce(F.lower(field("enabled")), F.lit("true")) != "false").alias("enabled"), body.alias("body"), "path")
    return out.where("body <> ''")


def matching_rules(rules_: DataFrame, files: DataFrame) -> DataFrame:
    """Rules (id, severity, languages, globs as arrays of regexes) that hold for a file (path, language): its language is named, and its path matches one; an empty array holds for all."""
    on = ((F.size("languages") == 0) | F.array_contains("languages", F.col("language"))) & ((F.size("globs") == 0) | F.exists("globs", lambda g: F.regexp_like(F.col("path"), g)))
    # Rules are a project's own: few, and sent to the files only behind their count.
    return rules_.join(files.select("path", "language"), on, "left_semi")


def told_rules(rules_: DataFrame, files: DataFrame) -> DataFrame:
    """(change, id, place) of the rules that hold for any file of a change (`files`: change, path, language), the most severe first and then by id.

    What a rule asks of a path is asked once for each distinct path and language, and changes meet the answers by these.
    """
    kinds = files.select("path", "language").distinct()
    on = ((F.size("languages") == 0) | F.array_contains("languages", F.col("language"))) & ((F.size("globs") == 0) | F.exists("globs", lambda g: F.regexp_like(F.col("path"), g)))
    hits = kinds.join(rules_.select("id", "severity", "languages", "globs"), on).select("path", F.col("language").alias("_l"), "id", "severity")
    met = files.select("change", "path", "language").distinct().join(hits, "path").where(F.col("language").eqNullSafe(F.col("_l"))).select("change", "id", "severity").distinct()
    place = F.row_number().over(Window.partitionBy("change").orderBy(rank_of(F.col("severity")).desc(), "id"))
    return met.select("change", "id", place.alias("place"))


def context_file(files: DataFrame, names: list[str], most: int = 6000) -> DataFrame:
    """The first of `names` that isn't empty, the base revision's before the tree's, cut to `most` characters. `files` (revision: base or tree, path, text)."""
    rank: Column = F.array_position(F.array(*[F.lit(n) for n in names]), F.col("path"))
    rows = files.where((rank > 0) & (F.trim("text") != "")).select("path", F.substring("text", 1, most).alias("text"), F.struct(rank, (F.col("revision") != "base").cast("int")).alias("rank"))
    return rows.withColumn("n", F.row_number().over(Window.orderBy("rank"))).where("n = 1").select("path", "text")


def context_files(files: DataFrame, names: list[str], most: int = 6000) -> DataFrame:
    """(change, path, text): of each change the first of `names` that isn't blank, with the texts of later names that it, or what was added to it, points at by name, cut to `most` characters.

    `files` (change, revision: base or tree, path, text): the base revision's text of a name comes before the tree's. Names are few, so each
    is a column of one grouped row.
    """
    text = strip(F.coalesce("text", F.lit("")))
    rows = files.where(F.col("path").isin(*names)).select("change", "path", text.alias("text"), (F.col("revision") != "base").cast("int").alias("late")).where("text <> ''")
    one = rows.groupBy("change").agg(*[F.min_by(F.when(F.col("path") == n, F.col("text")), F.when(F.col("path") == n, F.struct("late", "text"))).alias(f"t{i}") for i, n in enumerate(names)])
    told = F.lit(None).cast("struct<path:string,text:string>")
    for i in reversed(range(len(names))):
        whole = F.col(f"t{i}")
        for j in range(i + 1, len(names)):
            whole = F.when(whole.contains(names[j]) & F.col(f"t{j}").isNotNull(), F.concat(whole, F.lit("\n\n"), F.col(f"t{j}"))).otherwise(whole)
        told = F.when(F.col(f"t{i}").isNotNull(), F.struct(F.lit(names[i]).alias("path"), F.substring(whole, 1, most).alias("text"))).otherwise(told)
    return one.select("change", told.alias("c")).where("c IS NOT NULL").select("change", "c.path", "c.text")


def at_revision(blobs: DataFrame, revision: str, most_bytes: int = 8 << 20) -> DataFrame:
    """(path, text) of a snapshot table (revision, path, text): larger texts are as good as missing."""
    return blobs.where((F.col("revision") == revision) & (F.octet_length("text") <= most_bytes)).select("path", "text")
