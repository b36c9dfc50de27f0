"""Tables between the rounds of a loop, in the folder that the session's driver and executors share."""

from __future__ import annotations

from pyspark.sql import DataFrame

from revlens.operators.graph import _folder


class Rounds:
    """Writes the table of each round and reads it back, so that a lost executor costs no more than the round in hand."""

    def __init__(self, df: DataFrame):
        self.spark, self.root, self.n = df.sparkSession, _folder(df), 0

    def put(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.root}/{self.n}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)
