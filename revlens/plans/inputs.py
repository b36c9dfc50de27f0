"""Inputs of the queries, written once as SQL that both engines read, and the registry of queries.

The driver's tables hold none of the library's own entities, so each query derives rows of the shape that an operator
takes, from all rows of a table. `{events}` and the like stand for tables.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


class Data:
    """One session and folder of tables."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def __call__(self, text: str) -> DataFrame:
        names = set(re.findall(r"(?<!\{)\{(\w+)\}(?!\})", text))
        return self.spark.sql(text, **{n: self.table(n) for n in names})


def plain(text: str) -> str:
    """The same text with tables by their names."""
    names = set(re.findall(r"(?<!\{)\{(\w+)\}(?!\})", text))
    return text.format(**{n: n for n in names})


def query(name: str, sql: str | None = None) -> Callable:
    """Register a query over Data, and its SQL."""

    def add(f: Callable[[Data], DataFrame]) -> Callable:
        QUERIES[name] = lambda spark, folder: f(Data(spark, folder))
        if sql is not None:
            SQL[name] = plain(sql)
        return f

    return add


def findings_of(table: str, key: str, who: str, word: str) -> str:
    """Findings from any table with a number, a group and a word."""
    return f"""SELECT {key} AS pos, concat('src/m', CAST({who} % 45 AS STRING), '.py') AS file,
  CAST({key} * 7 % 5000 + 1 AS BIGINT) AS start_line, CAST({key} * 7 % 5000 + 1 + {key} % 4 AS BIGINT) AS end_line,
  CASE {key} % 4 WHEN 0 THEN 'info' WHEN 1 THEN 'minor' WHEN 2 THEN 'major' ELSE 'critical' END AS severity,
  CASE {key} % 3 WHEN 0 THEN 'bug' WHEN 1 THEN 'style' ELSE 'security' END AS category,
  CASE {key} % 11 WHEN 0 THEN 'requirement_gap' WHEN 1 THEN 'nitpick' WHEN 2 THEN 'verification_needed' WHEN 3 THEN 'refactor_suggestion' ELSE 'potential_issue' END AS kind,
  CASE WHEN {key} % 5 = 0 THEN 'static' ELSE 'llm' END AS source, CAST({key} % 11 AS DOUBLE) / 10 AS confidence,
  CASE WHEN {key} % 7 < 3 THEN 'execution_path' ELSE 'unverified' END AS evidence,
  CASE WHEN {key} % 2 = 0 THEN concat('note ', CAST({key} % 9 AS STRING)) ELSE '  ' END AS evidence_note,
  concat('Title: ', {word}, ' #', CAST({key} % 40 AS STRING)) AS title,
  concat('  The  ', {word}, chr(10), ' Body of ', CAST({key} % 40 AS STRING), ' ') AS body,
  CASE WHEN {key} % 5 = 0 THEN 'tool' END AS tool, CASE WHEN {key} % 6 = 0 THEN concat('R', CAST({key} % 3 AS STRING)) END AS rule_id,
  CASE WHEN {key} % 10 = 0 THEN 'x = 1' ELSE '' END AS suggestion
FROM {table}"""


FINDINGS = findings_of("{events}", "event_id", "user_id", "event_type")
OTHERS = findings_of("{customer}", "c_custkey", "c_nationkey", "'error'")
CHANGED = "SELECT DISTINCT concat('src/m', CAST(o_custkey % 42 AS STRING), '.py') AS file, CAST(o_orderkey % 5000 + 1 AS BIGINT) AS line FROM {orders}"
FILES = "SELECT DISTINCT concat('src/m', CAST(c_custkey % 44 AS STRING), '.py') AS file, c_custkey % 44 <> 43 AS has_hunks FROM {customer}"
RANK = "CASE severity WHEN 'info' THEN 0 WHEN 'minor' THEN 1 WHEN 'major' THEN 2 WHEN 'critical' THEN 3 END"
#: The two fingerprints, in DuckDB.
FP1 = r"substr(sha256(file || '|' || category || '|' || coalesce(rule_id, '') || '|' || substr(lower(trim(regexp_replace(body, '\s+', ' ', 'g'))), 1, 200)), 1, 16)"
FP2 = "substr(sha256(file || '|' || category || '|' || kind || '|' || coalesce(rule_id, tool, '') || '|' || trim(regexp_replace(lower(title), '[^a-z0-9]+', ' ', 'g'))), 1, 16)"
