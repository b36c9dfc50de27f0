"""Where names stand in texts: many terms at once, as whole words or anywhere, without comparing each term with each line."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from revlens.functions import paths as P
from revlens.operators.tables import Rounds

#: Terms that one automaton holds; more go in blocks, each a pass over the lines.
BLOCK = 50_000
IDENTIFIER = r"\A[A-Za-z_][A-Za-z0-9_]*\z"
# Names that an interpreter owns, and words too common to be evidence where a pattern guessed them.
RESERVED = ("self", "this", "None", "true", "false")
GENERIC = (
    "args", "body", "code", "config", "count", "data", "date", "end", "error", "file", "id", "index", "item", "items", "key", "kwargs", "line", "list", "message", "name",
    "path", "result", "size", "start", "status", "text", "time", "title", "type", "url", "user", "value", "version",
)
PROSE = ("markdown", "rst", "text")


def traceable(name: Column, identifier: Column, guessed: Column, shortest: int = 3) -> Column:
    """Whether searching for a name means anything: long enough, an identifier where it must be one, and no common word where it was guessed."""
    form = ~identifier | (name.rlike(IDENTIFIER) & ~name.isin(*RESERVED))
    return F.coalesce((F.char_length(name) >= shortest) & form & ~(guessed & F.lower(name).isin(*GENERIC)), F.lit(False))


def eligible(hits: DataFrame, changed: DataFrame) -> DataFrame:
    """`hits` (path, ...) that may be uses: not of the changed files (path) themselves, and not in prose."""
    prose = F.coalesce(P.language(F.col("path")).isin(*PROSE), F.lit(False))
    return hits.where(~prose).join(changed.select("path").distinct(), "path", "left_anti")


def _word(c: str, also: str) -> bool:
    return c.isalnum() or c == "_" or c in also


def containing(lines: DataFrame, text: str, terms: DataFrame, also: str = "", block: int = BLOCK) -> DataFrame:
    """(columns of `lines`, term): each line with each distinct term of `terms` (term, whole) that its `text` holds, once.

    A term with `whole` counts only where neither neighbour is a letter, digit, underscore or a character of `also`; another counts anywhere.
    A block of terms becomes an Aho-Corasick automaton, which reads a text once for all of them; texts go through in Arrow batches.
    Only a block of terms is ever at the driver; the hits of each block are a written table. Null or empty terms and null texts hit nothing.
    A term that is listed both ways counts anywhere.
    """
    rounds = Rounds(lines)
    known = rounds.put(terms.where("term <> ''").groupBy("term").agg(F.bool_and(F.coalesce("whole", F.lit(False))).alias("whole")))
    n = known.count()
    schema = T.StructType([f for f in lines.schema.fields if f.name.lower() != "term"] + [T.StructField("term", T.StringType())])
    kept = [f.name for f in schema.fields[:-1]]
    blocks = -(-n // block)
    done = []
    for b in range(blocks):
        part = known if blocks == 1 else known.where(F.pmod(F.xxhash64("term"), F.lit(blocks)) == b)
        pairs = lines.sparkSession.sparkContext.broadcast([(r.term, r.whole) for r in part.collect()])

        def find(batches: Iterator[pa.RecordBatch], pairs=pairs) -> Iterator[pa.RecordBatch]:
            import ahocorasick

            machine = ahocorasick.Automaton()
            for term, whole in pairs.value:
                machine.add_word(term, (term, whole))
            machine.make_automaton()
            for batch in batches:
                for i in range(0, batch.num_rows, 1024):
                    piece = batch.slice(i, 1024)
                    rows, hits = [], []
                    for k, line in enumerate(piece.column(text).to_pylist() if pairs.value else ()):
                        seen = set()
                        for end, (term, whole) in machine.iter(line or ""):
                            start = end - len(term)
                            if term not in seen and not (whole and ((start >= 0 and _word(line[start], also)) or (end + 1 < len(line) and _word(line[end + 1], also)))):
                                seen.add(term)
                                rows.append(k)
                                hits.append(term)
                    if rows:
                        taken = piece.take(pa.array(rows))
                        yield pa.RecordBatch.from_arrays([taken.column(c) for c in kept] + [pa.array(hits, pa.string())], [*kept, "term"])

        found = lines.mapInArrow(find, schema)
        done.append(found if blocks == 1 else rounds.put(found))
    return reduce(DataFrame.unionAll, done) if done else lines.sparkSession.createDataFrame([], schema)


def contract_hits(lines: DataFrame, text: str, terms: DataFrame, block: int = BLOCK) -> DataFrame:
    """containing(), where a term (term) that is an identifier counts as a whole word and any other, a route or an event's name, anywhere."""
    return containing(lines, text, terms.select("term", F.col("term").rlike(IDENTIFIER).alias("whole")), block=block)
