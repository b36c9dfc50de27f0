"""Durable state between runs: versions of a table in a shared folder, merged and replaced as a whole.

A version is a folder of rows and a marker that names it. The rows are written first, under a name that no other writer has; the marker of
the next number is then put in place by a rename that fails where one is there already. So of two writers that read the same version one
commits, and the other reads anew, merges again and takes the number after. A run that dies leaves a folder without a marker, which no
reader sees.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class Conflict(RuntimeError):
    """Other writers kept committing first."""


class VersionedTable:
    """A table of `schema` below `root`; the newest `keep` versions stay, so a reader of one has as many commits' time."""

    def __init__(self, spark: SparkSession, root: str, schema: str, keep: int = 4):
        self.spark, self.root, self.schema, self.keep = spark, root.rstrip("/"), schema, keep

    def _fs(self):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), self.spark._jvm.org.apache.hadoop.fs.Path

    def versions(self) -> list[int]:
        fs, path = self._fs()
        if not fs.exists(path(f"{self.root}/log")):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(path(f"{self.root}/log"))]
        return sorted(int(n[1:]) for n in names if n[:1] == "v" and n[1:].isdigit())

    def _rows(self, version: int) -> str:
        """The folder that a version's marker names."""
        fs, path = self._fs()
        stream = fs.open(path(f"{self.root}/log/v{version}"))
        try:
            return f"{self.root}/rows/{stream.readUTF()}"
        finally:
            stream.close()

    def read(self, version: int | None = None) -> DataFrame:
        """A version, the newest if none is named; an empty table before the first."""
        if version is None:
            found = self.versions()
            if not found:
                return self.spark.createDataFrame([], self.schema)
            version = found[-1]
        return self.spark.read.schema(self.schema).parquet(self._rows(version))

    def _put(self, rows: DataFrame) -> str:
        name = uuid.uuid4().hex
        cols = [f.name for f in self.spark.createDataFrame([], self.schema).schema]
        rows.select(*cols).write.parquet(f"{self.root}/rows/{name}")
        return name

    def _claim(self, version: int, name: str) -> bool:
        """Whether this writer is the one whose rows are the version."""
        jvm = self.spark._jvm
        fs, path = self._fs()
        draft = path(f"{self.root}/drafts/{name}")
        stream = fs.create(draft, True)
        try:
            stream.writeUTF(name)
        finally:
            stream.close()
        fs.mkdirs(path(f"{self.root}/log"))
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self.spark._jsc.hadoopConfiguration())
        never = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(draft, path(f"{self.root}/log/v{version}"), never)
        except Py4JJavaError as e:
            if "FileAlreadyExistsException" not in str(e.java_exception):
                raise
            fs.delete(draft, False)
            return False
        return True

    def commit(self, merge: Callable[[DataFrame], DataFrame], tries: int = 20) -> int:
        """Write merge(newest rows) as the next version, and return its number; if another writer takes the number first, merge again with what it wrote."""
        for _ in range(tries):
            found = self.versions()
            last = found[-1] if found else None
            base = self.read(last) if found else self.spark.createDataFrame([], self.schema)
            name, new = self._put(merge(base)), 0 if last is None else last + 1
            if self._claim(new, name):
                self._forget([v for v in found if v <= new - self.keep])
                return new
            fs, path = self._fs()
            fs.delete(path(f"{self.root}/rows/{name}"), True)
        raise Conflict(f"{tries} commits to {self.root} were overtaken")

    def write(self, rows: DataFrame) -> None:
        """Rows as the next version, whatever is there. Rows may come from the version that is being replaced."""
        self.commit(lambda _: rows)

    def _forget(self, versions: list[int]) -> None:
        fs, path = self._fs()
        for v in versions:
            rows = self._rows(v)
            fs.delete(path(f"{self.root}/log/v{v}"), False)
            fs.delete(path(rows), True)


#: The version of stored review files that is read.
STATE_VERSION = 1


def stored_reviews(files: DataFrame) -> DataFrame:
    """(key, fingerprints, head_sha, digest, overview) of state files (text): a map of reviews under `reviews`, of version STATE_VERSION.

    A file that is missing, null, no JSON or of another version has none, as if nothing had been stored; a review that isn't a map is left out. Of a
    key that stands in several files the least record counts.
    """
    whole = files.select(F.try_parse_json("text").alias("v")).where(F.coalesce(F.schema_of_variant("v").startswith("OBJECT"), F.lit(False)) & (F.try_variant_get("v", "$.version", "int") == STATE_VERSION))
    reviews = whole.select(F.try_variant_get("v", "$.reviews", "map<string,variant>").alias("m")).where("m IS NOT NULL").select(F.explode("m").alias("key", "r"))
    text = lambda name: F.try_variant_get("r", f"$.{name}", "string")
    known = F.coalesce(F.try_variant_get("r", "$.fingerprints", "array<string>"), F.array().cast("array<string>"))
    rows = reviews.where(F.schema_of_variant("r").startswith("OBJECT")).select("key", F.array_sort(F.array_distinct(F.array_compact(known))).alias("fingerprints"), F.coalesce(text("head_sha"), F.lit("")).alias("head_sha"), F.coalesce(text("digest"), F.lit("")).alias("digest"), text("overview").alias("overview"))
    return rows.groupBy("key").agg(F.min(F.struct("fingerprints", "head_sha", "digest", "overview")).alias("x")).select("key", "x.*")


def record(stored: DataFrame, run: DataFrame) -> DataFrame:
    """Reviews (key, fingerprints, head_sha, digest, overview) after a run: fingerprints united, a cached overview only as long as the digest stays."""
    new = run.select("key", *[F.col(c).alias(f"new_{c}") for c in ("fingerprints", "head_sha", "digest", "overview")])
    met = stored.join(new, "key", "full")
    empty = F.array().cast("array<string>")
    moved = (F.coalesce("new_digest", F.lit("")) != "") & ~F.col("digest").eqNullSafe(F.col("new_digest"))
    return met.select(
        "key",
        F.array_sort(F.array_union(F.coalesce("fingerprints", empty), F.coalesce("new_fingerprints", empty))).alias("fingerprints"),
        F.coalesce("new_head_sha", "head_sha").alias("head_sha"),
        F.when(moved, F.col("new_digest")).otherwise(F.col("digest")).alias("digest"),
        F.coalesce("new_overview", F.when(~moved, F.col("overview"))).alias("overview"),
    )


def record_feedback(stored: DataFrame, incoming: DataFrame, most: int) -> DataFrame:
    """Entries (fingerprint, verdict, recorded_at, arrival): the newest of each fingerprint, of two as new the later arrival; then the newest `most`. Stored ones arrived first."""
    both = stored.withColumn("arrival", F.lit(-1).cast("long")).unionByName(incoming.withColumn("arrival", F.col("arrival").cast("long")))
    rest = [c for c in both.columns if c != "fingerprint"]
    newest = both.groupBy("fingerprint").agg(F.max_by(F.struct(*rest), F.struct("recorded_at", "arrival")).alias("e")).select("fingerprint", "e.*")
    return newest.orderBy(F.desc("recorded_at"), "fingerprint").limit(most)


def save_checkpoint(stored: DataFrame, run: DataFrame) -> DataFrame:
    """Units (key, signature, identity, completed, detail) after a run: another signature starts a key afresh; incoming rows win, and completed beats failed.

    A key that the run doesn't mention stays as it is.
    """
    keys = run.select("key", F.col("signature").alias("now")).distinct()
    old = stored.join(keys, "key", "left").where(F.col("now").isNull() | (F.col("now") == F.col("signature"))).drop("now")
    both = old.withColumn("late", F.lit(0)).unionByName(run.withColumn("late", F.lit(1)))
    best = both.groupBy("key", "signature", "identity").agg(F.max_by(F.struct("completed", "detail"), F.struct("completed", "late")).alias("u"))
    return best.select("key", "signature", "identity", "u.completed", "u.detail")


def cleared(stored: DataFrame, key: str | None = None) -> DataFrame:
    """State without one key, or without any."""
    return stored.where(F.lit(False)) if key is None else stored.where(~F.col("key").eqNullSafe(F.lit(key)))


def overlay(stored: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """Stored rows with the incoming ones in place of those of their key: what a run sees even if writing fails."""
    return stored.join(incoming.select(key).distinct(), key, "left_anti").unionByName(incoming)


def is_fresh(cached: DataFrame, now: DataFrame) -> DataFrame:
    """(key, reuse): whether a cached overview still tells the change: its digest is the present one."""
    met = now.select("key", F.col("digest").alias("present")).join(cached.select("key", "digest", "overview"), "key", "left")
    return met.select("key", (F.col("digest").eqNullSafe(F.col("present")) & F.col("overview").isNotNull()).alias("reuse"))


def touching(commits: DataFrame, threads: DataFrame) -> DataFrame:
    """(thread, shas): commits (sha, ordinal, path) after a thread's anchor and up to the head that touch its file, in order; null where the anchor isn't known. `threads` (thread, path, anchor, head)."""
    place = commits.groupBy("sha").agg(F.min("ordinal").alias("at"))
    known = threads.join(place.select(F.col("sha").alias("anchor"), F.col("at").alias("from_")), "anchor", "left").join(place.select(F.col("sha").alias("head"), F.col("at").alias("to_")), "head", "left")
    hit = known.join(commits, (known["path"] == commits["path"]) & (commits["ordinal"] > F.col("from_")) & (commits["ordinal"] <= F.col("to_")), "left")
    shas = F.transform(F.array_sort(F.collect_list(F.when(F.col("sha").isNotNull(), F.struct("ordinal", "sha")))), lambda x: x["sha"])
    out = hit.groupBy("thread").agg(shas.alias("found"), F.bool_and(F.col("from_").isNotNull() & F.col("to_").isNotNull()).alias("asked"))
    return out.select("thread", F.when(F.col("asked"), F.col("found")).alias("shas"))


def signature(parts: dict[str, Column]) -> Column:
    """A digest over named inputs and settings: what it doesn't cover doesn't invalidate a checkpoint."""
    return F.sha2(F.to_json(F.struct(*[parts[k].alias(k) for k in sorted(parts)])), 256)


def commit_checkpoint(table: VersionedTable, run: DataFrame) -> int:
    """save_checkpoint() of a run's units as a commit: of writers at the same time each keeps the other's units, and completed beats failed whoever comes last."""
    return table.commit(lambda stored: save_checkpoint(stored, run))


class Published:
    """What has been published, by buckets of keys: (key, fingerprint, batch, bucket), appended batch by batch and never rewritten.

    A batch reads only the buckets that its keys fall into, and writes only its own rows. Both the outbox and the buckets have a
    folder for each batch, which a replay overwrites: what a batch itself remembered doesn't count against it, so a replayed
    batch publishes the same rows into the same place, and nothing twice.
    """

    def __init__(self, spark: SparkSession, root: str, buckets: int = 64):
        self.spark, self.root, self.buckets = spark, root.rstrip("/"), buckets

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(F.col("key").cast("string")), F.lit(self.buckets)).cast("int")

    def seen(self) -> DataFrame:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/seen")
        if not path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path):
            return self.spark.createDataFrame([], "key string, fingerprint string, bucket int, batch long")
        return self.spark.read.schema("key string, fingerprint string, bucket int, batch long").parquet(f"{self.root}/seen")

    def publish(self, batch: DataFrame, batch_id: int) -> None:
        """For foreachBatch: of findings (key, fingerprint, fingerprint_v2, ...) those of neither fingerprint known from an earlier batch go to the outbox, once each.

        The outbox comes first, so a run that dies between the two writes publishes into the same folder again.
        """
        rows = batch.withColumn("key", F.col("key").cast("string")).withColumn("bucket", self._bucket())
        both = rows.select("key", "bucket", F.explode(F.array("fingerprint", "fingerprint_v2")).alias("fingerprint")).where("fingerprint IS NOT NULL").distinct()
        # At most as many as there are buckets.
        touched = [r.bucket for r in rows.select("bucket").distinct().collect()]
        known = self.seen().where(F.col("bucket").isin(touched) & (F.col("batch") < batch_id)).select("key", "fingerprint").distinct()
        fresh = rows.join(known, ["key", "fingerprint"], "left_anti").join(known.withColumnRenamed("fingerprint", "fingerprint_v2"), ["key", "fingerprint_v2"], "left_anti")
        once = fresh.drop("bucket").dropDuplicates(["key", "fingerprint"]).select(*batch.columns)
        once.write.mode("overwrite").parquet(f"{self.root}/outbox/batch={batch_id}")
        new = both.join(known, ["key", "fingerprint"], "left_anti").withColumn("batch", F.lit(batch_id).cast("long"))
        new.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket", "batch").parquet(f"{self.root}/seen")

    def outbox(self) -> DataFrame:
        """Everything published, with the batch."""
        return self.spark.read.parquet(f"{self.root}/outbox")


def publish_stream(findings: DataFrame, published: Published, checkpoint: str):
    """Start publishing a stream of findings; the writer that it returns takes a trigger and a start()."""
    return findings.writeStream.option("checkpointLocation", checkpoint).foreachBatch(published.publish)


def publish_unseen(batch: DataFrame, seen: VersionedTable, outbox: str) -> None:
    """One batch of findings (key, fingerprint, fingerprint_v2, ...) without a number: those that neither fingerprint has been published as go to the outbox, once each, and are remembered.

    The outbox is appended before the state, so a run that dies between the two publishes again rather than never. For
    streams, where batches are numbered and may be replayed, see Published.
    """
    known = seen.read()
    one = known.select("key", F.col("fingerprint"))
    fresh = batch.join(one, ["key", "fingerprint"], "left_anti").join(one.withColumnRenamed("fingerprint", "fingerprint_v2"), ["key", "fingerprint_v2"], "left_anti")
    fresh = fresh.dropDuplicates(["key", "fingerprint"])
    fresh.write.mode("append").parquet(outbox)
    both = batch.select("key", F.explode(F.array("fingerprint", "fingerprint_v2")).alias("fingerprint"))
    seen.commit(lambda stored: stored.unionByName(both).distinct())
