"""Conversations brought back to the form system? (user assistant)+ by the cheapest edits."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from revlens.llm.common import SPACE

#: Rows of one recursive query; longer conversations go through several, the last state of one being the first of the next.
CHUNK = 4096
DELETE, REROLE, INSERT, TRUNCATED = 4, 3, 3, 3
#: Grammar states: nothing yet, after system, after user, after assistant. What an initial leads to from each.
START, SYSTEM, USER, ASSISTANT = range(4)
MOVE = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
#: Where an inserted or reroled turn leads: only one role fits.
NEXT = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
BLANK, DUPLICATE, CUT = 1, 2, 3


def _moves() -> pa.Table:
    """(state, kind, after, cost, letters) of a row with any insertions before it; kind = 4 x initial's place in suax + fault."""
    rows = []
    for state in range(4):
        for initial in range(4):
            for fault in range(4):
                at, letters, paid = state, "", 0
                for _ in range(3):  # a third insertion only leads back to a state of the first
                    rows.append((state, 4 * initial + fault, at, paid + DELETE, letters + "D"))
                    if fault in (0, CUT):
                        extra = TRUNCATED if fault == CUT else 0
                        rows.append((state, 4 * initial + fault, NEXT[at], paid + REROLE + extra, letters + "R"))
                        if (at, "suax"[initial]) in MOVE:
                            rows.append((state, 4 * initial + fault, MOVE[at, "suax"[initial]], paid + extra, letters + "K"))
                    at, letters, paid = NEXT[at], letters + "I", paid + INSERT
    return pa.table(dict(zip(("state", "kind", "after", "cost", "letters"), map(list, zip(*rows, strict=True)), strict=True)))


#: One step takes every conversation's next row. `place` ranks what a conversation came in with, so that strings start anew.
ADVANCE = """
WITH RECURSIVE reached(conv, state, i, best) USING KEY (conv, state) AS (
  SELECT conv, state, 0, {'cost': cost, 'place': place, 'audit': ''} FROM entered
  UNION
  SELECT r.conv, m.after, r.i + 1, min({'cost': r.best.cost + m.cost, 'place': r.best.place, 'audit': r.best.audit || m.letters})
  FROM reached AS r JOIN turns AS t ON t.conv = r.conv AND t.i = r.i JOIN moves AS m ON m.state = r.state AND m.kind = t.kind
  GROUP BY r.conv, m.after, r.i)
SELECT conv, state, best.cost, best.place, best.audit FROM reached ORDER BY conv, state"""


class _Path:
    """The cheapest way to one state: cost, audit as a chain of pieces, hash and count of the turns that it kept."""

    __slots__ = ("audit", "cost", "digest", "kept", "place", "texts")

    def __init__(self, cost=0, place=0, audit=None, digest=None, kept=0, texts=None):
        self.cost, self.place, self.audit, self.digest, self.kept, self.texts = cost, place, audit, digest or hashlib.sha256(), kept, texts

    def whole(self) -> str:
        parts, at = [], self.audit
        while at:
            parts.append(at[1])
            at = at[0]
        return "".join(reversed(parts))


def _turns(letters: str, state: int, roles: list[str], texts: list[str]) -> list[str]:
    """role:text of the turns that remain."""
    out, k = [], 0
    for x in letters:
        if x == "K":
            out.append(f"{roles[k]}:{texts[k]}")
            state = MOVE[state, roles[k][0]]
        elif x in "RI":
            out.append(f"{'assistant' if state == USER else 'user'}:{texts[k] if x == 'R' else ''}")
            state = NEXT[state]
        k += x != "I"
    return out


def _extend(path: _Path, letters: str, state: int, roles: list[str], texts: list[str], keep: bool) -> _Path:
    turns = _turns(letters, state, roles, texts)
    digest = path.digest.copy()
    if turns:
        digest.update(("\n" * (path.kept > 0) + "\n".join(turns)).encode())
    return _Path(path.cost, path.place, (path.audit, letters), digest, path.kept + len(turns), (path.texts or []) + turns if keep else None)


class _Open:
    """A conversation whose rows have been read in part."""

    def __init__(self, conv):
        self.conv, self.paths = conv, {START: _Path()}
        self.counts = np.zeros(5, np.int64)  # blank, duplicate, truncated, illegal, distinct turns
        self.first = self.last = None

    def row(self, keep: bool) -> tuple:
        """The result. What is still missing at the end is inserted."""
        ends = []
        for state, path in self.paths.items():
            letters = {START: "", SYSTEM: "II", USER: "I", ASSISTANT: ""}[state]
            ends.append((path.cost + INSERT * len(letters), path.place, letters, state))
        cost, place, letters, state = min(ends)
        best = _extend(self.paths[state], letters, state, [], [], keep)
        blank, duplicate, cut, illegal, distinct = map(int, self.counts)
        gaps = 0 if self.first is None else self.last - self.first + 1 - distinct
        out = (self.conv, gaps, blank, duplicate, cut, illegal, cost, best.whole(), best.digest.hexdigest())
        return (*out, "\n".join(best.texts)) if keep else out


def _same(column: pa.Array) -> np.ndarray:
    """Whether each value but the first equals the one before; null equals null."""
    a, b = column[1:], column[:-1]
    both = pc.and_(pc.is_null(a), pc.is_null(b))
    return pc.or_(pc.fill_null(pc.equal(a, b), False), both).to_numpy(zero_copy_only=False)


class _Worker:
    """Reads rows sorted by conversation and turn; rows() takes a chunk and returns the conversations that it ended."""

    def __init__(self, keep: bool):
        import duckdb

        self.keep, self.open, self.before = keep, None, None
        self.db = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": "512MB", "temp_directory": ""})
        self.db.register("moves", _moves())

    def rows(self, batch: pa.RecordBatch) -> list[tuple]:
        held = self.before.num_rows if self.before is not None else 0
        seen = pa.Table.from_batches([self.before, batch] if held else [batch]).combine_chunks()
        columns = {c: seen.column(c).combine_chunks() for c in seen.column_names}
        columns = {c: a.chunk(0) if isinstance(a, pa.ChunkedArray) else a for c, a in columns.items()}
        self.before = batch.slice(batch.num_rows - 1, 1)
        n = batch.num_rows
        fresh = lambda same: np.concatenate([np.zeros(1 - held, bool), same])  # noqa: E731  for the rows of the batch, not the one held
        same_conv = fresh(_same(columns["conv"]))
        same_turn = same_conv & fresh(_same(columns["turn"]))
        repeat = same_turn & fresh(_same(columns["role"])) & fresh(_same(columns["text"]))
        fault = batch.column("fault").to_numpy(zero_copy_only=False).copy()
        fault[(fault != BLANK) & repeat] = DUPLICATE
        initial = batch.column("initial").to_numpy(zero_copy_only=False)
        earlier = fresh(columns["initial"].to_numpy(zero_copy_only=False)[:-1].astype(np.int64) * 4)
        illegal = same_conv & ~np.isin(earlier + initial, [1, 6, 9])  # su, ua, au
        has_turn = batch.column("turn").is_valid().to_numpy(zero_copy_only=False)
        starts = np.flatnonzero(np.concatenate([[True], ~same_conv[1:]]))
        ends = np.append(starts[1:], n)
        ids, out, opened = batch.column("conv"), [], []
        for k, a in enumerate(starts):
            if k or not same_conv[0]:
                opened.append(_Open(ids[int(a)].as_py()))
            else:
                opened.append(self.open)
        if self.open is not None and not same_conv[0]:
            out.append(self.open.row(self.keep))
        counts = [np.add.reduceat(x.astype(np.int64), starts) for x in (fault == BLANK, fault == DUPLICATE, fault == CUT, illegal, has_turn & ~same_turn)]
        turns = batch.column("turn")
        for k, conv in enumerate(opened):
            conv.counts += [c[k] for c in counts]
            known = np.flatnonzero(has_turn[starts[k] : ends[k]])
            if len(known):
                conv.first = turns[int(starts[k] + known[0])].as_py() if conv.first is None else conv.first
                conv.last = turns[int(ends[k]) - 1].as_py()
        at = np.repeat(np.arange(len(starts)), ends - starts)
        self.db.register("turns", pa.table({"conv": at, "i": np.arange(n) - starts[at], "kind": 4 * initial.astype(np.int64) + fault}))
        entered = [(k, state, p.cost, p.place) for k, conv in enumerate(opened) for state, p in conv.paths.items()]
        self.db.register("entered", pa.table(dict(zip(("conv", "state", "cost", "place"), map(list, zip(*entered, strict=True)), strict=True))))
        reached = self.db.execute(ADVANCE).fetchall()
        roles, texts = batch.column("role").to_pylist(), batch.column("text").to_pylist()
        for k, conv in enumerate(opened):
            came = {p.place: (state, p) for state, p in conv.paths.items()}
            own = [x[1:] for x in reached[_at(reached, k) : _at(reached, k + 1)]]
            order = {key: place for place, key in enumerate(sorted({(place, audit) for _, _, place, audit in own}))}
            if k + 1 < len(opened):  # it ends here: only the winner's turns are written
                own = [min(((cost + INSERT * len(more), place, audit + more, state) for state, cost, place, audit in own for more in ["", "II", "I", ""][state : state + 1]))]
                cost, place, letters, state = own[0]
                state_in, path = came[place]
                new = _extend(path, letters, state_in, roles[starts[k] : ends[k]], texts[starts[k] : ends[k]], self.keep)
                new.cost, conv.paths = cost, {ASSISTANT if state else START: new}
                out.append(conv.row(self.keep))
                continue
            paths = {}
            for state, cost, place, audit in own:
                state_in, path = came[place]
                new = _extend(path, audit, state_in, roles[starts[k] : ends[k]], texts[starts[k] : ends[k]], self.keep)
                new.cost, new.place = cost, order[place, audit]
                paths[state] = new
            conv.paths = paths
            self.open = conv
        return out


def _at(reached: list[tuple], conv: int) -> int:
    """Where the rows of a conversation begin."""
    low, high = 0, len(reached)
    while low < high:
        mid = (low + high) // 2
        low, high = (mid + 1, high) if reached[mid][0] < conv else (low, mid)
    return low


def _fault(text: Column, later: Column) -> Column:
    bare = F.rtrim(text, F.lit(SPACE))
    return F.when(F.char_length(bare) == 0, BLANK).when(later, DUPLICATE).when(~F.right(bare, F.lit(1)).isin(".", "!", "?"), CUT).otherwise(0)


def repair(conversations: DataFrame, texts: bool = False, chunk: int = CHUNK) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256), and `repaired` if `texts`, from (conv_id, turn, role, text).

    One row a conversation. Rows are taken by turn (nulls first), equal turns by role and text. A row's
    first fault counts: blank, duplicate (role and text seen earlier), truncated (no closing mark).
    Edits: keep 0, rerole 3, delete 4 (blank and duplicate rows must go), insert an empty turn 3; a truncated row that
    stays costs 3 more. audit holds the initials of the cheapest edits that give system? (user assistant)+ or nothing, the
    ASCII-least of several. illegal counts neighbours whose roles' initials aren't su, ua or au; gaps the turns missing
    between the least and the greatest.

    Rows are hash-partitioned by conversation and sorted. In each partition a recursive DuckDB query takes up to
    `chunk` rows and advances one turn of all their conversations a step, keeping the cheapest cost and audit for each
    grammar state. A conversation that goes on in the next chunk hands over four states, each with its audit so far
    and a running hash, so memory follows the chunk, and the audit that the result row holds anyhow. Which rows repeat an earlier one
    is settled before by minima for each text, gathered before the shuffle, so that no task remembers a conversation's texts. One conversation is read by
    one task, as its hash can only be taken in order.

    Null role or text counts as one space, null conv_id as one conversation. A repeated row is a duplicate. Columns of
    other names are ignored. An empty table gives none.
    """
    role, text = F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" "))
    rows = conversations.select(F.col("conv_id").alias("conv"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"))
    rows = rows.withColumn("key", F.sha2(F.concat(F.char_length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256)).withColumn("at", F.struct(F.col("turn").isNotNull().alias("known"), "turn"))
    firsts = rows.groupBy(F.col("conv").alias("c"), F.col("key").alias("k")).agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    met = rows.join(firsts, rows["conv"].eqNullSafe(firsts["c"]) & (rows["key"] == firsts["k"]), "left")
    initial = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for i, c in enumerate("sua") for x in (c, i)]), F.substring("role", 1, 1)), F.lit(3))
    met = met.select("conv", "turn", "role", "text", initial.cast("int").alias("initial"), _fault(F.col("text"), F.coalesce(F.col("at") > F.col("first"), F.lit(False))).cast("int").alias("fault"))
    order = [F.col("conv").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "text"]
    dealt = met.repartition("conv").sortWithinPartitions(*order)
    fields = [T.StructField("conv_id", conversations.schema["conv_id"].dataType)]
    fields += [T.StructField(c, T.LongType()) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    fields += [T.StructField(c, T.StringType()) for c in ("audit", "repaired_sha256", *["repaired"] * texts)]
    schema = T.StructType(fields)
    types = [pa.int64()] * 6 + [pa.string()] * (2 + texts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker, kind = None, None
        for batch in batches:
            kind = batch.schema.field("conv").type
            worker = worker or _Worker(texts)
            for i in range(0, batch.num_rows, chunk):
                done = worker.rows(batch.slice(i, chunk))
                if done:
                    yield _batch(done, [kind, *types], schema.names)
        if worker and worker.open:
            yield _batch([worker.open.row(texts)], [kind, *types], schema.names)

    return dealt.mapInArrow(run, schema)


def _batch(rows: list[tuple], types: list[pa.DataType], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)


def damage(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) with faults by crc32(`conv_id:turn`) % 20: 0 drops a row, 1 empties it, 2 takes its closing marks, 3 repeats it, 4 makes its role user.

    Nulls count as one space, also in the key.
    """
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fate = F.crc32(F.concat(name("conv_id"), F.lit(":"), name("turn"))) % 20
    rows = conversations.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), fate.alias("fate")).where("fate <> 0")
    text = F.when(F.col("fate") == 1, "").when(F.col("fate") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    times = F.when(F.col("fate") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return rows.select("conv_id", "turn", F.when(F.col("fate") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.explode(times).alias("_")).drop("_")
