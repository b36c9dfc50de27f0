"""Published comments read back: whose they are, what they identify, what people answered, what is still open.

A comment is a row (change, surface, thread, nth, id, author, is_bot, body, path, line, created_at, head_sha, positioned, system, state, resolvable, resolved,
thread_resolved); `nth` is its place in its thread, 0 the root, and `ordinal` of a thread its place in the listing. Marks are hidden comments <!-- mark:kind ... -->.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from revlens.functions.text import strip, verdict_in, written_at

# Threads and answers that are read at most, characters of a thread's text, an author's and a title's.
MOST_THREADS, MOST_ANSWERS, MOST_BODY, MOST_AUTHOR, MOST_TITLE = 50, 100, 4000, 100, 200
STATES = ("fixed", "not_fixed", "inconclusive")
#: Hex digits of an identity in a mark.
_IDENTITY = "([0-9a-f]{8,64})"


def is_mine(author: Column, is_bot: Column, viewer: Column) -> Column:
    """Whether the library wrote a comment: its author is the viewer, whatever the case, or, where the viewer has no name, any bot."""
    named = F.coalesce(viewer, F.lit("")) != ""
    return F.when(named, F.lower(F.coalesce(author, F.lit(""))) == F.lower(viewer)).otherwise(F.coalesce(is_bot, F.lit(False)))


def identities(body: Column, mark: str) -> Column:
    """The distinct identities that a body's marks carry, of either version, in order."""
    return F.array_distinct(F.regexp_extract_all(F.coalesce(body, F.lit("")), F.lit(rf"<!-- \Q{mark}\E:v[12]:{_IDENTITY} -->"), F.lit(1)))


def discussion(comments: DataFrame, heads: DataFrame, mark: str) -> DataFrame:
    """`comments` of people that still bear on the change, by seven rules; `heads` (change, head) are the revisions under review.

    Out go the comments of resolved threads (by the thread's word, or that of any resolvable comment in it), system notes, bots, the library's
    own, those positioned on another revision than a known head (or on a line that is gone: `positioned` but without position), pending
    reviews, and blank bodies. Bodies come out without white space around them.
    """
    no = lambda c: F.coalesce(F.col(c), F.lit(False))
    closed = comments.where(no("thread_resolved") | (no("resolvable") & no("resolved"))).where("thread IS NOT NULL").select("change", "thread").distinct()
    body = strip(F.coalesce("body", F.lit("")))
    rows = comments.where(~no("system") & ~no("is_bot") & (body != "") & ~body.contains(f"<!-- {mark}:") & (F.upper(F.coalesce("state", F.lit(""))) != "PENDING"))
    rows = rows.where(~((F.col("surface") == "line") & ~no("positioned"))).join(closed, ["change", "thread"], "left_anti")
    met = rows.join(heads.select("change", "head").dropDuplicates(["change"]), "change", "left")
    at, head = F.coalesce("head_sha", F.lit("")), F.coalesce("head", F.lit(""))
    stale = no("positioned") & (head != "") & (at != "") & (at != head)
    return met.where(~stale).select(*[body.alias(c) if c == "body" else F.col(c) for c in comments.columns])


def published(comments: DataFrame, mark: str) -> DataFrame:
    """(change, fingerprint): every identity in any comment, whoever wrote it: what was said isn't said again."""
    return comments.select("change", F.explode(identities(F.col("body"), mark)).alias("fingerprint")).distinct()


def newest_summary(comments: DataFrame, viewers: DataFrame, mark: str) -> DataFrame:
    """(change, id, surface, flow, carried): of each change the newest owned comment that bears the overview's mark; of two as new the later one.

    `viewers` (change, viewer) name the account; `flow` and `carried` are what its other marks hold. Comments on lines, and those
    without a number, are no overview.
    """
    at = F.struct(written_at(F.col("created_at")).alias("at"), "ordinal", "nth")
    rows = comments.where(F.coalesce("body", F.lit("")).contains(f"<!-- {mark}:summary -->") & (F.col("surface") != "line") & F.col("id").isNotNull())
    own = rows.join(viewers.dropDuplicates(["change"]), "change", "left").where(is_mine(F.col("author"), F.col("is_bot"), F.col("viewer")))
    held = lambda kind: F.nullif(F.regexp_extract("body", rf"<!-- \Q{mark}\E:{kind}:([A-Za-z0-9+/=]+) -->", 1), F.lit(""))
    best = own.groupBy("change").agg(F.max_by(F.struct("id", "surface", held("flow").alias("flow"), held("overview").alias("carried")), at).alias("s"))
    return best.select("change", "s.*")


def _roots(comments: DataFrame, viewers: DataFrame, mark: str) -> DataFrame:
    """The first comments of threads that the library wrote about a finding, with what they identify."""
    rows = comments.where((F.col("nth") == 0) & F.col("thread").isNotNull()).join(viewers.dropDuplicates(["change"]), "change", "left")
    return rows.withColumn("fingerprints", identities(F.col("body"), mark)).where(is_mine(F.col("author"), F.col("is_bot"), F.col("viewer")) & (F.size("fingerprints") > 0))


def _first(rows: DataFrame, most: int) -> DataFrame:
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("change").orderBy("ordinal"))).where(F.col("place") <= most).drop("place")


def open_threads(comments: DataFrame, viewers: DataFrame, mark: str, most: int = MOST_THREADS) -> DataFrame:
    """(change, thread, ordinal, fingerprints, body, path, line, anchor_sha, replied): the first `most` threads of each change that the library opened on a file and nobody has closed; replied tells whether evidence is there already."""
    no = lambda c: F.coalesce(F.col(c), F.lit(False))
    of_thread = comments.where("thread IS NOT NULL").groupBy("change", "thread").agg(
        F.bool_or(no("thread_resolved") | (no("resolvable") & no("resolved"))).alias("closed"), F.bool_or(F.coalesce("body", F.lit("")).contains(f"<!-- {mark}:resolution")).alias("replied"))
    rows = _roots(comments, viewers, mark).where(F.coalesce("path", F.lit("")) != "").join(of_thread, ["change", "thread"]).where("NOT closed")
    out = rows.select("change", "thread", "ordinal", "fingerprints", F.substring("body", 1, MOST_BODY).alias("body"), "path", F.coalesce("line", F.lit(0)).alias("line"), F.coalesce("head_sha", F.lit("")).alias("anchor_sha"), "replied")
    return _first(out, most)


def answers(comments: DataFrame, viewers: DataFrame, mark: str, markers: dict[str, str], most: int = MOST_ANSWERS) -> DataFrame:
    """(change, thread, ordinal, fingerprints, verdict, author, path, title, recorded_at): of the first `most` threads that people answered with a marker, open or resolved, the latest such answer; of two as late the one that stands later.

    Times are compared as texts, as they were recorded.
    """
    roots = _roots(comments, viewers, mark).select("change", "thread", "ordinal", "fingerprints", "viewer", "path", F.substring(F.regexp_replace(F.regexp_extract(F.coalesce("body", F.lit("")), r"(?m)^\*\*(.+?)\*\*\s*$", 1), r"\.+\z", ""), 1, MOST_TITLE).alias("title"))
    replies = comments.where("nth > 0").select("change", "thread", "nth", "author", "is_bot", F.coalesce("created_at", F.lit("")).alias("created_at"), verdict_in(F.col("body"), markers).alias("verdict")).where("verdict IS NOT NULL")
    human = replies.join(roots, ["change", "thread"]).where(~F.coalesce("is_bot", F.lit(False)) & ~is_mine(F.col("author"), F.col("is_bot"), F.col("viewer")))
    rest = ["ordinal", "fingerprints", "verdict", "author", "path", "title", "created_at"]
    last = human.groupBy("change", "thread").agg(F.max_by(F.struct(*rest), F.struct("created_at", "nth")).alias("a")).select("change", "thread", "a.*")
    out = last.select("change", "thread", "ordinal", "fingerprints", "verdict", F.substring(F.coalesce("author", F.lit("")), 1, MOST_AUTHOR).alias("author"), F.coalesce("path", F.lit("")).alias("path"), "title", F.col("created_at").alias("recorded_at"))
    return _first(out, most)


def retired(threads: DataFrame, history: DataFrame, verdicts: DataFrame, heads: DataFrame, most: int = 10) -> DataFrame:
    """(change, thread, state, commits, attributable): what became of each of open_threads(), inconclusive unless evidence says otherwise.

    `history` (change, thread, shas) are the commits that touched a thread's file after its anchor, null where the range isn't known;
    `heads` (change, head, readable) tell whether the checkout is the reviewed head. Only the first `most` threads of a change that have such
    commits are judged, by the first of `verdicts` (change, thread, pos, state, commits, summary) that names a known state; a verdict on any other
    thread counts for nothing. Of the commits that it names those stay that begin exactly one of the thread's own. Only a fix with
    commits and a summary is attributable, and only such a thread may be answered and closed.
    """
    empty = F.array().cast("array<string>")
    known = heads.where(F.coalesce("readable", F.lit(False)) & (F.coalesce("head", F.lit("")) != "")).select("change").distinct()
    ranged = history.where(F.size(F.coalesce("shas", empty)) > 0).dropDuplicates(["change", "thread"])
    judged = _first(threads.join(known, "change", "left_semi").join(ranged, ["change", "thread"]).select("change", "thread", "ordinal", "shas"), most)
    state = F.lower(strip(F.coalesce("state", F.lit(""))))
    said = verdicts.where(state.isin(*STATES)).groupBy("change", "thread").agg(F.min_by(F.struct(state.alias("state"), F.coalesce("commits", empty).alias("named"), strip(F.coalesce("summary", F.lit(""))).alias("summary")), "pos").alias("v"))
    begins = F.transform("v.named", lambda n: F.filter("shas", lambda sha: sha.startswith(F.lower(n)) & n.rlike(r"(?i)\A[0-9a-f]{7,40}\z")))
    found = F.array_distinct(F.transform(F.filter(begins, lambda b: F.size(b) == 1), lambda b: b[0]))
    told = judged.join(said, ["change", "thread"]).select("change", "thread", F.col("v.state").alias("said"), found.alias("found"), "v.summary")
    met = threads.select("change", "thread").join(told, ["change", "thread"], "left")
    fixed = (F.col("said") == "fixed") & (F.size("found") > 0) & (F.col("summary") != "")
    return met.select("change", "thread", F.coalesce("said", F.lit("inconclusive")).alias("state"), F.coalesce("found", empty).alias("commits"), F.coalesce(fixed, F.lit(False)).alias("attributable"))
