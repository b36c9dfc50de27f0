"""Recorded listings: a folder for each listing, a JSON file for each page, read up to the page that ends it."""

from __future__ import annotations

import json
import posixpath
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

# Items of a full page, pages that are asked for at most.
PER_PAGE, MOST_PAGES = 100, 50
SCHEMA = "listing string, page int, body string"


def _files(path: str):
    """The file system of an address and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


class _Page(InputPartition):
    def __init__(self, listing: str, page: int, path: str):
        super().__init__((listing, page, path))


class _Reader(DataSourceReader):
    """A partition for each page: <path>/<listing>/<number>.json, or such files in the folder itself."""

    def __init__(self, options):
        self.path = options["path"].rstrip("/")

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs

        files, at = _files(self.path)
        found = []
        for info in files.get_file_info(fs.FileSelector(at, recursive=True)):
            number = re.search(r"(\d+)\.json\Z", info.path)
            if info.type == fs.FileType.File and number:
                listing = posixpath.relpath(posixpath.dirname(info.path), at)
                found.append(_Page("" if listing == "." else listing, int(number[1]), info.path))
        return sorted(found, key=lambda p: p.value) or [_Page("", 0, "")]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        listing, page, path = partition.value
        if path:
            files, _ = _files(self.path)
            with files.open_input_stream(path) as f:
                body = f.read().decode()
            yield pa.RecordBatch.from_arrays([pa.array([listing]), pa.array([page], pa.int32()), pa.array([body])], ["listing", "page", "body"])


class RecordedPages(DataSource):
    """spark.read.format("recorded_pages").load(folder): (listing, page, body), a task for each page."""

    @classmethod
    def name(cls) -> str:
        return "recorded_pages"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


def recorded(spark: SparkSession, folder: str) -> DataFrame:
    """(listing, page, body) of the recorded pages below a folder."""
    spark.dataSource.register(RecordedPages)
    return spark.read.format("recorded_pages").load(folder)


def listed(pages: DataFrame, per_page: int = PER_PAGE, most_pages: int = MOST_PAGES) -> DataFrame:
    """(listing, page, place, item, problem): the items (JSON) of listings whose `pages` (listing, page, body) are numbered from 1.

    A listing ends with the first page that isn't there, isn't a list, is empty or holds fewer than `per_page` items, or with page
    `most_pages`; pages after it don't count. A page that is no list is a failure where it names an error: its listing then has one
    row, with the problem and no items, since part of a listing would pass for all of it.
    """
    body = F.try_parse_json("body")
    is_list = F.coalesce(F.schema_of_variant("body").startswith("ARRAY"), F.lit(False))
    rows = pages.select("listing", "page", body.alias("body")).dropDuplicates(["listing", "page"])
    rows = rows.withColumn("items", F.when(is_list, F.try_variant_get("body", "$", "array<variant>"))).withColumn("n", F.coalesce(F.size("items"), F.lit(0)))
    # The last page before a gap or an end: pages 1 to k stand at places 1 to k as long as none is missing.
    ends = rows.where(F.col("n") < per_page).groupBy("listing").agg(F.min("page").alias("short"))
    after = rows.select("listing", (F.col("page") + 1).alias("page")).join(rows.select("listing", "page"), ["listing", "page"], "left_anti").groupBy("listing").agg(F.min(F.when(F.col("page") > 1, F.col("page"))).alias("gap"))
    begun = rows.where("page = 1").select("listing")
    upto = begun.join(ends, "listing", "left").join(after, "listing", "left").select("listing", F.least(F.coalesce("short", F.lit(most_pages)), F.coalesce(F.col("gap") - 1, F.lit(most_pages)), F.lit(most_pages)).alias("upto"))
    live = rows.join(upto, "listing").where(F.col("page") <= F.col("upto"))
    problem = _problem(F.col("body"))
    failed = live.where(F.col("items").isNull() & problem.isNotNull()).groupBy("listing").agg(F.min_by(problem, "page").alias("problem"))
    good = live.join(failed.select("listing"), "listing", "left_anti").where("n > 0").select("listing", "page", F.posexplode("items").alias("place", "item"))
    out = good.select("listing", "page", "place", F.to_json("item").alias("item"), F.lit(None).cast("string").alias("problem"))
    return out.unionByName(failed.select("listing", F.lit(None).cast("int").alias("page"), F.lit(None).cast("int").alias("place"), F.lit(None).cast("string").alias("item"), "problem"))


def _problem(body, most: int = 300):
    """What an error payload says: its message, or those of its errors, joined; null for any other body."""
    said = F.try_variant_get(body, "$.errors", "array<variant>")
    each = F.filter(F.transform(said, lambda e: F.coalesce(F.try_variant_get(e, "$.message", "string"), F.lit(""))), lambda m: m.isNotNull())
    joined = F.when(F.size(said) > 0, F.substring(F.array_join(each, "; "), 1, most))
    return F.coalesce(joined, F.substring(F.try_variant_get(body, "$.message", "string"), 1, most))


def answers(replies: DataFrame) -> DataFrame:
    """(columns but body, data, problem) of recorded answers to queries (body, ...): a non-empty list of errors is a failure even where data came with it; so is a body that is no map."""
    body = F.try_parse_json("body")
    rows = replies.withColumn("_v", body)
    is_map = F.coalesce(F.schema_of_variant("_v").startswith("OBJECT"), F.lit(False))
    said = F.try_variant_get("_v", "$.errors", "array<variant>")
    problem = F.when(~is_map, "no map").when(F.coalesce(F.size(said), F.lit(0)) > 0, _problem(F.col("_v")))
    rest = [c for c in replies.columns if c != "body"]
    return rows.withColumn("problem", problem).select(*rest, F.when(F.col("problem").isNull(), F.to_json(F.try_variant_get("_v", "$.data", "variant"))).alias("data"), "problem")


def write_pages(folder: str, listing: str, items: list, per_page: int = PER_PAGE) -> None:
    """Record a listing in a local folder, for tests and for replays."""
    from pathlib import Path

    at = Path(folder, listing)
    at.mkdir(parents=True, exist_ok=True)
    for k in range(len(items) // per_page + 1):
        (at / f"{k + 1}.json").write_text(json.dumps(items[k * per_page : (k + 1) * per_page]))
