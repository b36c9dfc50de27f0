"""Shared helpers: schemas, written tables in the shared folder, connected components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: White space of the contracts: space and the controls 9 to 13.
SPACE = "\t\n\x0b\x0c\r "
SPACE_BYTES = SPACE.encode()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. A session that names none must be local, and gets a temporary one."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not sc.master.split("[")[0] == "local":
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    own = getattr(sc, "_revlens_shared", None)
    if own is None:
        own = sc._revlens_shared = tempfile.mkdtemp(prefix="revlens-")
    return own


class Stored:
    """Tables written to the shared folder, so that a lost executor costs no more than the stage in hand.

    A result may read them lazily, so what drop() leaves goes when the driver ends.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/revlens-{uuid.uuid4().hex}"
        self.n = 0
        path = spark._jvm.org.apache.hadoop.fs.Path(self.root)
        fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        fs.mkdirs(path)
        fs.deleteOnExit(path)

    def put(self, df: DataFrame, by: str | None = None) -> DataFrame:
        self.n += 1
        path = f"{self.root}/{self.n}"
        writer = df.write.mode("overwrite").option("compression", "zstd")
        (writer.partitionBy(by) if by else writer).parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._revlens_path = path
        if self.spark.sparkContext.master.split("[")[0] != "local":
            # Spark's cleaner deletes a query's shuffle files once the driver has collected the query.
            self.spark._jvm.System.gc()
        return out

    def drop(self, *dfs: DataFrame | None) -> None:
        """Delete tables that no later step reads."""
        jvm = self.spark._jvm
        for df in dfs:
            path = getattr(df, "_revlens_path", None)
            if path:
                p = jvm.org.apache.hadoop.fs.Path(path)
                p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)


def with_fields(schema: T.StructType, fields: Iterable[tuple[str, T.DataType]]) -> T.StructType:
    """`schema` and `fields`; a new field takes the place of a column that bears its name in any case."""
    fields = list(fields)
    names = {n.lower() for n, _ in fields}
    return T.StructType([f for f in schema.fields if f.name.lower() not in names] + [T.StructField(n, t, True) for n, t in fields])


def with_arrays(batch: pa.RecordBatch, arrays: dict[str, pa.Array]) -> pa.RecordBatch:
    """The batch with `arrays` appended, in the order of with_fields()."""
    names = {n.lower() for n in arrays}
    keep = [i for i, n in enumerate(batch.schema.names) if n.lower() not in names]
    return pa.RecordBatch.from_arrays([batch.column(i) for i in keep] + list(arrays.values()), [batch.schema.names[i] for i in keep] + list(arrays))


def map_texts(df: DataFrame, make: Callable[[], Callable[[list[str | None], pa.RecordBatch], dict[str, pa.Array]]], fields: list[tuple[str, T.DataType]], column: str = "text", rows: int = 1024) -> DataFrame:
    """Append `fields` to every row of `df` from its text; `make()` runs once for each task.

    Rows go through in slices of `rows`, so that memory follows the slice and not Spark's batch.
    """
    schema = with_fields(df.schema, fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for batch in batches:
            for i in range(0, batch.num_rows, rows):
                part = batch.slice(i, rows)
                yield with_arrays(part, f(part.column(column).to_pylist(), part))

    return df.mapInArrow(run, schema)


def one_text(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, label, text): a row for each of a bounded number of `labels` (doc_id, label) that `docs` has a text of, the first by hash where an id has several rows."""
    met = docs.select("doc_id", "text").join(F.broadcast(labels), "doc_id")
    return met.groupBy("doc_id", "label").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))


def connected(store: Stored, edges: DataFrame) -> DataFrame:
    """(id, component): the smallest id that each id of `edges` (a, b: long) reaches.

    Label propagation with pointer jumping. Labels of a round come from grouped minima, which combine
    before the shuffle, so a node with many links costs no task of its own. Each round is written to
    the shared folder. Rounds follow the logarithm of the longest path, roughly.
    """
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = store.put(both)
    labels = store.put(both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("m")).select("id", F.least("id", "m").alias("component")))
    while True:
        near = both.join(labels.withColumnRenamed("id", "b"), "b").groupBy(F.col("a").alias("id")).agg(F.min("component").alias("near"))
        step = labels.join(near, "id", "left").select("id", F.col("component").alias("old"), F.least("component", "near").alias("c"))
        jump = labels.select(F.col("id").alias("c"), F.col("component").alias("cc"))
        new = store.put(step.join(jump, "c", "left").select("id", F.least("c", "cc").alias("component"), (F.least("c", "cc") < F.col("old")).cast("int").alias("moved")))
        moved = new.agg(F.sum("moved")).first()[0]
        store.drop(labels)
        path, labels = new._revlens_path, new.select("id", "component")
        labels._revlens_path = path
        if not moved:
            store.drop(both)
            return labels
