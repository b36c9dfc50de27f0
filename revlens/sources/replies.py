"""A model's replies as rows: YAML or JSON text, untrusted. What can't be read is skipped; what is read is coerced by functions.text.

Parsing needs YAML where a reply isn't JSON; without that library only JSON replies give rows.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from revlens.functions import text as X

try:
    import yaml
except ImportError:
    yaml = None

#: Fixed values of the coerced fields.
CATEGORIES = ("security", "bug", "performance", "logic", "reliability", "maintainability", "testing", "style", "docs")
KINDS = ("potential_issue", "refactor_suggestion", "nitpick", "verification_needed", "requirement_gap")
EFFORTS = ("quick_win", "moderate", "heavy_lift")
PROVEN = ("execution_path", "reproduction", "contract", "static_tool")
EVIDENCE = (*PROVEN, "unverified")


def _load(text: str) -> Any:
    try:
        return json.loads(text)
    except ValueError:
        pass
    if yaml is None:
        return None
    try:
        return yaml.safe_load(text)
    except yaml.YAMLError:
        return _salvaged(text.splitlines())


def _salvaged(lines: list[str]) -> Any:
    """A reply that broke off: the longest part before an item's start that can be read as a mapping."""
    starts = [i for i in range(1, len(lines)) if lines[i].lstrip().startswith("- ")]
    for cut in reversed(starts):
        try:
            data = yaml.safe_load("\n".join(lines[:cut]))
        except yaml.YAMLError:
            continue
        if isinstance(data, dict):
            return data
    return None


def _text(value: Any) -> str | None:
    """A scalar as text; nothing for what has no sensible text. Truth values keep their word: coercions drop it where it means nothing."""
    if value is None or isinstance(value, (dict, list)):
        return None
    return ("true" if value else "false") if isinstance(value, bool) else str(value)


def entries(replies: DataFrame, key: str, text: str, section: str, fields: list[str], lists: list[str] = ()) -> DataFrame:
    """(key, pos, fields..., lists...): the mappings of one list of each reply, fields as text and lists as arrays of text."""
    cleaned = replies.select(key, X.strip_fences(F.coalesce(F.col(text), F.lit(""))).alias("cleaned"))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            at, pos, values, many = [], [], [], []
            for i, t in enumerate(part.column(1).to_pylist()):
                data = _load(t)
                items = data.get(section) if isinstance(data, dict) else None
                for n, item in enumerate(items if isinstance(items, list) else []):
                    if isinstance(item, dict):
                        at.append(i)
                        pos.append(n)
                        values.append([_text(item.get(f)) for f in fields])
                        many.append([[x for x in map(_text, v if isinstance(v, list) else [v]) if x is not None] if (v := item.get(f)) is not None else None for f in lists])
            if at:
                cols = [pa.array([v[j] for v in values], pa.string()) for j in range(len(fields))]
                cols += [pa.array([v[j] for v in many], pa.list_(pa.string())) for j in range(len(lists))]
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(at)), pa.array(pos, pa.int32()), *cols], [key, "pos", *fields, *lists])

    schema = f"`{key}` {replies.schema[key].dataType.simpleString()}, pos int" + "".join(f", `{f}` string" for f in fields) + "".join(f", `{f}` array<string>" for f in lists)
    return cleaned.mapInArrow(run, schema)


def _word(name: str) -> Column:
    """A field's text without white space at its ends; truth values are no text."""
    bare = X.strip(F.coalesce(name, F.lit("")))
    return F.when(F.lower(bare).isin("true", "false"), "").otherwise(bare)


def findings(replies: DataFrame, key: str, text: str, files: DataFrame | None = None) -> DataFrame:
    """Findings of the replies: rows without a file, a line from 1 or a body go, and those of files that aren't in `files` (file)."""
    raw = entries(replies, key, text, "findings", ["file", "start_line", "end_line", "severity", "category", "kind", "effort", "title", "body", "description", "suggestion", "rule_id", "confidence", "evidence", "evidence_note"], ["evidence_files"])
    start = X.as_int(F.col("start_line"))
    end = X.as_int(F.col("end_line"))
    body = F.coalesce(F.nullif(_word("body"), F.lit("")), _word("description"))
    title = F.coalesce(F.nullif(_word("title"), F.lit("")), F.nullif(X.first_sentence(body), F.lit("")), F.lit("Review comment"))
    proof = X.as_evidence(F.col("evidence"), F.col("evidence_note"), PROVEN, EVIDENCE)
    rows = raw.select(
        key, "pos", _word("file").alias("file"), start.alias("start_line"), F.greatest(F.coalesce(F.nullif(end, F.lit(0)), start), start).alias("end_line"),
        X.as_enum(F.col("severity"), X.SEVERITIES, "minor").alias("severity"), X.as_enum(F.col("category"), CATEGORIES, "maintainability").alias("category"),
        X.as_enum(F.col("kind"), KINDS, "potential_issue").alias("kind"), X.as_enum(F.col("effort"), EFFORTS, "moderate").alias("effort"),
        F.substring(title, 1, 120).alias("title"), body.alias("body"), X.clean_suggestion(F.coalesce("suggestion", F.lit(""))).alias("suggestion"),
        F.nullif(_word("rule_id"), F.lit("")).alias("rule_id"), X.as_confidence(F.coalesce("confidence", F.lit(""))).alias("confidence"), F.lit("llm").alias("source"),
        proof["evidence"].alias("evidence"), proof["note"].alias("evidence_note"), X.evidence_files(F.coalesce("evidence_files", F.array().cast("array<string>")), F.col("file")).alias("evidence_files"),
    ).where("file <> '' AND start_line >= 1 AND body <> ''")
    return rows if files is None else rows.join(files.select("file").distinct(), "file", "left_semi").select(rows.columns)


def evidence(replies: DataFrame, key: str, text: str, section: str, fields: list[str], needed: list[str], most: int = 20, longest: int = 300) -> DataFrame:
    """The first `most` entries of a list whose needed fields aren't empty, fields cut to `longest` characters."""
    raw = entries(replies, key, text, section, fields)
    cut = raw.select(key, "pos", *[F.substring(_word(f), 1, longest).alias(f) for f in fields])
    for f in needed:
        cut = cut.where(F.col(f) != "")
    from pyspark.sql import Window

    return cut.withColumn("nth", F.row_number().over(Window.partitionBy(key).orderBy("pos"))).where(F.col("nth") <= most).drop("nth")


def decisions(replies: DataFrame, key: str, text: str, known: DataFrame, dispositions: tuple[str, ...] = ("confirm", "revise", "drop", "inconclusive")) -> DataFrame:
    """The first known decision on each candidate of `known` (key, candidate)."""
    raw = entries(replies, key, text, "decisions", ["candidate", "disposition", "rationale", "severity", "evidence", "evidence_note"])
    rows = raw.select(key, "pos", _word("candidate").alias("candidate"), F.lower(_word("disposition")).alias("disposition"), F.substring(_word("rationale"), 1, 300).alias("rationale"), "severity", "evidence", "evidence_note")
    rows = rows.where(F.col("disposition").isin(*dispositions)).join(known, [key, "candidate"], "left_semi")
    rest = [c for c in rows.columns if c not in (key, "candidate")]
    return rows.groupBy(key, "candidate").agg(F.min_by(F.struct(*rest), "pos").alias("d")).select(key, "candidate", "d.*")


def verdicts(replies: DataFrame, key: str, text: str, threads: DataFrame, states: tuple[str, ...] = ("fixed", "not_fixed", "inconclusive"), most: int = 10) -> DataFrame:
    """The first verdict on each known thread, with the full names of the commits it quotes. `threads` (key, thread, shas): a short name counts if it begins exactly one of them."""
    raw = entries(replies, key, text, "verdicts", ["thread", "state", "summary"], ["commits"])
    rows = raw.select(key, "pos", _word("thread").alias("thread"), F.lower(_word("state")).alias("state"), F.substring(_word("summary"), 1, 600).alias("summary"), X.as_commits(F.coalesce("commits", F.array().cast("array<string>"))).alias("commits"))
    rows = rows.where(F.col("state").isin(*states)).groupBy(key, "thread").agg(F.min_by(F.struct("state", "summary", "commits"), "pos").alias("v")).select(key, "thread", "v.*")
    met = rows.join(threads, [key, "thread"])
    full = F.transform("commits", lambda c: F.filter("shas", lambda s: s.startswith(c)))
    one = F.array_distinct(F.transform(F.filter(full, lambda f: F.size(f) == 1), lambda f: f[0]))
    return met.select(key, "thread", "state", "summary", F.slice(one, 1, most).alias("commits"))
