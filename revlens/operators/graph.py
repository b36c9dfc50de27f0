"""Relations between files: whole-word mentions, connected components, spans and the lines they touch."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _folder(df: DataFrame) -> str:
    """A folder for tables between rounds: the session's shared one; a temporary one in local mode only."""
    sc = df.sparkSession.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir", None)
    if not named and sc.master.split("[")[0] != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    root = f"{(named or tempfile.gettempdir()).rstrip('/')}/revlens-{uuid.uuid4().hex}"
    jvm = df.sparkSession._jvm
    path = jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration())
    fs.mkdirs(path)
    fs.deleteOnExit(path)
    return root


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, component): of each node the least it reaches over `edges` (a, b), in either direction.

    Labels spread by grouped minima and then jump to their label's label, so rounds follow the logarithm of the
    longest path and a node of many edges combines before the shuffle. Each round is a written table; the loop ends
    at a fixed point. Edges to unknown nodes count for nothing.
    """
    spark, root = nodes.sparkSession, _folder(nodes)

    def put(df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{root}/{name}")
        return spark.read.schema(df.schema).parquet(f"{root}/{name}")

    ids = nodes.select("id").where("id IS NOT NULL").distinct()
    real = edges.select("a", "b").where("a <> b").join(ids.withColumnRenamed("id", "a"), "a", "left_semi").join(ids.withColumnRenamed("id", "b"), "b", "left_semi")
    both = put(real.unionByName(real.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels, n = put(ids.select("id", F.col("id").alias("component")), "0"), 0
    while True:
        near = both.join(labels.withColumnRenamed("id", "b"), "b").groupBy(F.col("a").alias("id")).agg(F.min("component").alias("near"))
        step = labels.join(near, "id", "left").select("id", F.col("component").alias("old"), F.least("component", "near").alias("via"))
        jump = labels.select(F.col("id").alias("via"), F.col("component").alias("beyond"))
        n += 1
        new = put(step.join(jump, "via", "left").select("id", F.least("via", "beyond").alias("component"), (F.least("via", "beyond") < F.col("old")).alias("moved")), str(n))
        if new.where("moved").isEmpty():
            return new.select("id", "component")
        labels = new.select("id", "component")


def whole_words(lines: DataFrame, text: str) -> DataFrame:
    """`lines` with a row for each distinct identifier of the text, as `word`."""
    return lines.withColumn("word", F.explode(F.array_distinct(F.regexp_extract_all(F.col(text), F.lit(r"([\p{L}_$][\p{L}\p{N}_$]*)"), F.lit(1)))))


def mentions(terms: DataFrame, lines: DataFrame, text: str) -> DataFrame:
    """(term, and the columns of `lines`): lines that hold a term as a whole identifier.

    Lines become their words, so the join is by equal words and never compares a term with every line. A word that a
    third of all lines hold meets the few rows of its term; AQE splits it.
    """
    return whole_words(lines, text).join(terms.select(F.col("term").alias("word")).distinct(), "word").withColumnRenamed("word", "term")


def top_hits(hits: DataFrame, node: str, most: int, *order) -> DataFrame:
    """The first hits of each node, with `truncated`: whether there were more."""
    w = Window.partitionBy(node)
    return hits.withColumns({"nth": F.row_number().over(w.orderBy(*order)), "truncated": F.count("*").over(w) > most}).where(F.col("nth") <= most)


def touched(symbols: DataFrame, changed: DataFrame, bin_: int = 64) -> DataFrame:
    """`symbols` (id, file, start_line, end_line) any of whose lines is in `changed` (file, line): a join by bins of lines."""
    lines = changed.groupBy("file", F.floor(F.col("line") / bin_).alias("bin")).agg(F.collect_set("line").alias("lines"))
    spans = symbols.select("id", "file", "start_line", "end_line", F.explode(F.sequence(F.floor(F.col("start_line") / bin_), F.floor(F.col("end_line") / bin_))).alias("bin"))
    met = spans.join(lines, ["file", "bin"]).where(F.exists("lines", lambda x: x.between(F.col("start_line"), F.col("end_line"))))
    return symbols.join(met.select("id").distinct(), "id", "left_semi")


def first_of_each(sources: list[DataFrame], key: list[str]) -> DataFrame:
    """The union of sources, the row of the earliest source and then the least `pos` for each key, with `source`."""
    parts = [s.withColumn("source", F.lit(i)) for i, s in enumerate(sources)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    rest = [c for c in out.columns if c not in key]
    return out.groupBy(*key).agg(F.min_by(F.struct(*rest), F.struct("source", "pos")).alias("first")).select(*key, "first.*")


def longest_prefix(codes: DataFrame, code: str, table: dict[str, tuple[str, str]], default: tuple[str, str]) -> DataFrame:
    """`codes` with category and severity of the longest prefix in a small fixed table."""
    best = F.struct(F.lit(-1).alias("n"), F.lit(default[0]).alias("category"), F.lit(default[1]).alias("severity"))
    for prefix, (category, severity) in sorted(table.items(), key=lambda x: len(x[0])):
        best = F.when(F.col(code).startswith(prefix), F.struct(F.lit(len(prefix)).alias("n"), F.lit(category).alias("category"), F.lit(severity).alias("severity"))).otherwise(best)
    return codes.withColumn("class", best).select(*codes.columns, "class.category", "class.severity")
