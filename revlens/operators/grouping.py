"""Groups of changed files that are read together: who mentions, imports or tests whom."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from revlens.functions import paths as P
from revlens.operators.graph import components
from revlens.operators.tables import Rounds

#: Sorts after every path, so that a group bears the name of its least file.
HUB = "\U0010ffff"


def path_stem(path: Column) -> Column:
    """A file's name without its last suffix; a name that only begins with a dot keeps it."""
    return F.regexp_replace(P.base_name(path), r"(?s)(?<=.)\.[^.]*\z", "")


def specifiers(text: Column) -> Column:
    """The distinct names that a text imports: dotted ones after from, import and use, quoted ones after require( and from."""
    text = F.coalesce(text, F.lit(""))
    named = r"(?U)\bfrom\s+([\w.]+)\s+import"
    # What from already told isn't told by import again.
    rest = F.regexp_replace(text, named, " ")
    found = [(text, named), (rest, r"(?U)\bimport\s+([\w.]+)"), (rest, r"""(?U)\b(?:require\(\s*|from\s+)["']([^"']+)["']"""), (rest, r"(?U)\buse\s+([\w:]+)")]
    return F.array_distinct(F.concat(*[F.regexp_extract_all(t, F.lit(p), F.lit(1)) for t, p in found]))


def imported_stems(text: Column) -> Column:
    """The file names that the specifiers of a text may mean: the last part of a path or of a dotted name, with and without its suffix."""

    def base(spec: Column) -> Column:
        slashed = F.regexp_replace(F.translate(spec, "\\", "/"), "/+\\z", "")
        return F.when(F.translate(spec, "\\", "/").contains("/"), F.substring_index(slashed, "/", -1)).otherwise(F.substring_index(F.translate(spec, ":", "."), ".", -1))

    bases = F.transform(specifiers(text), base)
    return F.filter(F.array_distinct(F.concat(bases, F.transform(bases, path_stem))), lambda s: s != "")


def words(text: Column) -> Column:
    """Runs of word characters and dollar signs: what an identifier is bounded by."""
    return F.array_distinct(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"(?U)([\w$]+)"), F.lit(1)))


def relations(files: DataFrame, terms: DataFrame, change: str) -> DataFrame:
    """(change, path, hub, gives, takes): what each file of `files` (change, path, text, role) has to do with a name.

    A file gives a term of `terms` (change, path, term), which others take by mentioning it as a whole; it gives its stem, which others take
    by importing it; and a test takes the stem of its subject, which a file that is no test gives. Names stand between
    files, so a name of many givers and takers costs a row for each and not one for each pair.
    """
    by_term = terms.select(change, "path", "term").join(files.select(change, "path"), [change, "path"], "left_semi").distinct()
    wanted = by_term.select(change, "term").distinct()
    spoken = files.select(change, "path", F.explode(words(F.col("text"))).alias("term")).join(wanted, [change, "term"], "left_semi")
    stem = F.regexp_replace(path_stem(F.col("path")), r"\Atest_", "")
    stems = files.select(change, "path", stem.alias("stem"), (F.col("role") == "test").alias("tests")).where("stem <> ''")
    imports = files.select(change, "path", F.explode(imported_stems(F.col("text"))).alias("stem")).join(stems.select(change, "stem").distinct(), [change, "stem"], "left_semi")
    row = lambda df, kind, name, gives, takes: df.select(change, "path", F.concat(F.lit(HUB + kind), name).alias("hub"), F.lit(gives).alias("gives") if isinstance(gives, bool) else gives.alias("gives"), F.lit(takes).alias("takes") if isinstance(takes, bool) else takes.alias("takes"))
    parts = [
        row(by_term, "m:", F.col("term"), True, False), row(spoken, "m:", F.col("term"), False, True),
        row(stems, "i:", F.col("stem"), True, False), row(imports, "i:", F.col("stem"), False, True),
        row(stems, "t:", F.col("stem"), ~F.col("tests"), F.col("tests")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy(change, "path", "hub").agg(F.bool_or("gives").alias("gives"), F.bool_or("takes").alias("takes"))


def grouped(files: DataFrame, terms: DataFrame, change: str) -> DataFrame:
    """(change, path, role, component, rank): each file's group by relations(), named after its least path, and the rank of the group's foremost role.

    An implementation that takes anything from another file becomes a consumer. Groups are read by rank and then name, the files of one by role
    and then path. Equal paths of one change count as one file.
    """
    rounds = Rounds(files)
    files = files.dropDuplicates([change, "path"])
    found = rounds.put(relations(files, terms, change))
    # How many give a name, and whether any takes it: a file that only takes what it alone gives takes nothing.
    of_name = found.groupBy(change, "hub").agg(F.count_if("gives").alias("givers"), F.count_if("takes").alias("takers"))
    live = rounds.put(found.join(of_name.where("givers > 0 AND takers > 0"), [change, "hub"]))
    consumes = live.where(F.col("takes") & (F.col("givers") > F.when(F.col("gives"), 1).otherwise(0))).select(change, "path").distinct().withColumn("consumes", F.lit(True))
    node = lambda c: F.concat_ws("\x1f", F.col(change).cast("string"), c)
    edges = live.select(node(F.col("path")).alias("a"), node(F.col("hub")).alias("b"))
    # A file without edges is its own group, and takes no part in the rounds.
    nodes = edges.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    named = components(nodes, edges).withColumnRenamed("id", "_node")
    roles = files.join(consumes, [change, "path"], "left").withColumn("role", F.when(F.col("consumes") & (F.col("role") == "implementation"), "consumer").otherwise(F.col("role")))
    order = F.array_position(F.array(*[F.lit(r) for r in P.ROLES]), F.col("role")) - 1
    placed = roles.withColumn("_node", node(F.col("path"))).join(named, "_node", "left").select(change, "path", "role", F.substring_index(F.coalesce("component", "_node"), "\x1f", -1).alias("component"), order.cast("int").alias("own"))
    least = placed.groupBy(change, "component").agg(F.min("own").alias("rank"))
    return placed.join(least, [change, "component"]).select(change, "path", "role", "component", "rank")
