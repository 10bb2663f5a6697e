"""Cheapest repair of conversations by a run-length DP (operator 11).

Rows of a conversation become symbols (role and fault). Equal neighbours are
collapsed to runs; a run advances by the binary powers of its min-plus
transition between four grammar states, which are cached; the choices are then
unrolled row by row for the audit.

A conversation may hold any share of all rows: rows are dealt by ranges of
(conversation, turn), so a long one lies in several tasks, each in chunks of
bounded size. Chunks are linked by two scans over one narrow row a chunk:
backwards for the costs to the end, forwards for the state that each begins in.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import discard, stored, table

#: the rows and bytes of text of a chunk; a longer text is a chunk by itself
ROWS, BYTES = 4096, 4 << 20
#: grammar states: nothing yet, after system, after user, after assistant
START, SYSTEM, USER, ASSISTANT = range(4)
FAR = 1 << 60
REROLE, DELETE, INSERT, CUT_OFF = 2, 3, 2, 1
#: what an inserted or reroled row leads to, and the cost of ending in a state
NEXT = (USER, USER, ASSISTANT, USER)
END = (0, 2 * INSERT, INSERT, 0)
ROLES = {USER: "user", ASSISTANT: "assistant"}
#: symbols: 4 * fault + kind of role; a row that must go has one symbol
FINE, TRUNCATED, GONE = 0, 1, 8
KINDS = {"s": 0, "u": 1, "a": 2}
FILLED, ENDED = r"[^\x20\x09-\x0D]", r"[.!?][\x20\x09-\x0D]*\z"
#: Arrow's names of the types in use; a conversation is named by any of the plain ones
ARROW = {"bigint": pa.int64(), "int": pa.int32(), "smallint": pa.int16(), "string": pa.string(), "boolean": pa.bool_(), "date": pa.date32()}
ARROW |= {f"array<{k}>": pa.list_(ARROW[k]) for k in ("bigint", "int", "string")}


def keeps(state: int, kind: int) -> int | None:
    """The state after a kept row of a role, or None where it cannot stand."""
    if kind == 0:
        return SYSTEM if state == START else None
    if kind == 1:
        return USER if state != USER else None
    return ASSISTANT if kind == 2 and state == USER else None


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The min-plus product of two transitions."""
    return np.minimum((a[:, :, None] + b[None, :, :]).min(axis=1), FAR)


@lru_cache(maxsize=None)  # nine symbols, 63 powers of each at most
def power(symbol: int, k: int) -> np.ndarray:
    """The cheapest costs between states over 2**k rows of one symbol."""
    if k:
        half = power(symbol, k - 1)
        return times(half, half)
    step = np.full((4, 4), FAR)
    more = CUT_OFF * (symbol // 4 == TRUNCATED)
    for s in range(4):
        step[s, s] = DELETE
        if symbol != GONE:
            step[s, NEXT[s]] = min(step[s, NEXT[s]], REROLE + more)
            if (to := keeps(s, symbol % 4)) is not None:
                step[s, to] = min(step[s, to], more)
    insert = np.full((4, 4), FAR)
    for s in range(4):
        insert[s, s], insert[s, NEXT[s]] = 0, INSERT
    return times(times(insert, insert), step)


def through(runs: list[tuple[int, int]]) -> np.ndarray:
    """The transition of a whole list of (symbol, length)."""
    out = np.where(np.eye(4, dtype=bool), 0, FAR)
    for symbol, n in runs:
        for k in range(n.bit_length()):
            if n >> k & 1:
                out = times(out, power(symbol, k))
    return out


def before(symbol: int, n: int, after: np.ndarray) -> np.ndarray:
    """The costs to the end before ``n`` rows of one symbol."""
    for k in range(n.bit_length()):
        if n >> k & 1:
            after = (power(symbol, k) + after).min(axis=1)
    return after


def unroll(runs: list[tuple[int, int]], state: int, after: np.ndarray) -> Iterator[tuple[str, int, int]]:
    """(edit, state after it, number) in order, the ASCII-least of the cheapest
    edits: D before I before K before R. Rows that must go come as one."""
    costs = [after]
    for symbol, n in reversed(runs):
        costs.append(before(symbol, n, costs[-1]))
    costs.reverse()
    for (symbol, n), then in zip(runs, costs[1:], strict=True):
        if symbol == GONE:  # inserts can wait until the rows that must go are gone
            yield "D", state, n
            continue
        rows = [then]
        for _ in range(n):
            rows.append(before(symbol, 1, rows[-1]))
        more = CUT_OFF * (symbol // 4 == TRUNCATED)
        for i in range(n, 0, -1):
            now, later = rows[i], rows[i - 1]
            while True:
                if now[state] == DELETE + later[state]:
                    yield "D", state, 1
                elif now[state] == INSERT + now[NEXT[state]]:
                    state = NEXT[state]
                    yield "I", state, 1
                    continue
                elif (to := keeps(state, symbol % 4)) is not None and now[state] == more + later[to]:
                    state = to
                    yield "K", state, 1
                else:
                    state = NEXT[state]
                    yield "R", state, 1
                break


def ending(state: int) -> Iterator[tuple[str, int, int]]:
    """The inserts that complete a conversation."""
    while END[state]:
        state = NEXT[state]
        yield "I", state, 1


# -------------------------------------------------------------------- chunks

_HEAD = (
    "conv_id {}, chunk long, symbols array<int>, lengths array<long>, cost array<long>, blank long, duplicate long, "
    "truncated long, illegal long, first_role string, last_role string, turns long, first_turn long, last_turn long"
)
_CHUNK = _HEAD + ", row_symbol array<int>, row_times array<long>, role array<string>, text array<string>"


def _runs(symbols, lengths) -> list[tuple[int, int]]:
    return list(zip(symbols, lengths, strict=True))


class _Chunk:
    """The rows of a chunk as they come."""

    def __init__(self, conv) -> None:
        self.conv, self.size = conv, 0
        self.runs: list[list[int]] = []
        self.rows: list[tuple[int, int, str, str]] = []
        self.counts = {"blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0}
        self.roles: list[str] = []
        self.turns: list[int] = []
        self.n_turns = 0

    def add(self, turn, role: str, text: str, n: int, fault: str, repeated: bool) -> None:
        """``n`` equal rows; all but the first are duplicates. ``fault`` is of
        the text alone, ``repeated`` says that role and text were seen."""
        gone = n if fault == "blank" or repeated else n - 1
        self.counts["blank" if fault == "blank" else "duplicate"] += gone
        if gone < n:
            self.counts["truncated"] += fault == "truncated"
            self._symbol(4 * (TRUNCATED if fault == "truncated" else FINE) + KINDS.get(role[:1], 3), 1, role, text)
        if gone:
            self._symbol(GONE, gone, role, text)
        first = role[:1]
        self.counts["illegal"] += n - 1 + (bool(self.roles) and self.roles[-1] + first not in ("su", "ua", "au"))
        self.roles = [self.roles[0] if self.roles else first, first]
        if turn is not None and (not self.turns or self.turns[-1] != turn):
            self.n_turns += 1
            self.turns = [self.turns[0] if self.turns else turn, turn]
        self.size += len(text)

    def _symbol(self, symbol: int, n: int, role: str, text: str) -> None:
        if self.runs and self.runs[-1][0] == symbol:
            self.runs[-1][1] += n
        else:
            self.runs.append([symbol, n])
        self.rows.append((symbol, n, role, text))

    def row(self, number: int) -> tuple:
        symbols, lengths = [s for s, _ in self.runs], [n for _, n in self.runs]
        cost = through(_runs(symbols, lengths)).reshape(-1).tolist()
        ends = self.turns if self.turns else [None, None]
        return (self.conv, number, symbols, lengths, cost, *self.counts.values(), self.roles[0], self.roles[-1], self.n_turns, *ends,
                *(list(x) for x in zip(*self.rows, strict=True)))


def _batches(rows: Iterator[tuple], schema: pa.Schema, size: int = 512) -> Iterator[pa.RecordBatch]:
    """Record batches of ``rows``; one ends after 8 MB of text too."""

    def weight(x) -> int:
        return len(x) if isinstance(x, str) else sum(map(len, x)) if isinstance(x, list) and x and isinstance(x[0], str) else 0

    def batch(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), schema.types, strict=True)], schema=schema)

    out, total = [], 0
    for r in rows:
        out.append(r)
        total += sum(map(weight, r))
        if len(out) == size or total > 8 << 20:
            yield batch(out)
            out, total = [], 0
    if out:
        yield batch(out)


def _each(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for b in batches:
        yield from zip(*(c.to_pylist() for c in b.columns), strict=True)


def _mapped(df: DataFrame, run, schema: str) -> DataFrame:
    """``df`` through ``run``, from an iterator of row tuples to another."""
    kind = StructType.fromDDL(schema)
    arrow = pa.schema([(f.name, ARROW[f.dataType.simpleString()]) for f in kind.fields])
    return df.mapInArrow(lambda batches: _batches(run(_each(batches)), arrow), kind)


def _chunks(rows: DataFrame, conv_type: str, most: int) -> DataFrame:
    """Chunk rows of ``rows`` (conv_id, turn, role, text, times and order), one
    row for each distinct row of a conversation."""
    order = ("turn", "order_role", "order_text")
    rows = rows.withColumn("digest", F.unhex(F.md5("text")))
    first = rows.groupBy("conv_id", "role", "digest").agg(F.min(F.struct(*order)).alias("o"))
    marks = first.select("conv_id", *[f"o.{c}" for c in order], F.lit(0).alias("kind"))
    both = rows.withColumn("kind", F.lit(1)).unionByName(marks, allowMissingColumns=True)
    fault = F.when(~F.col("text").rlike(FILLED), "blank").when(~F.col("text").rlike(ENDED), "truncated")
    both = both.select("conv_id", *order, "kind", "role", "text", "times", fault.alias("fault"))
    dealt = both.repartitionByRange("conv_id", *order).sortWithinPartitions("conv_id", *order, "kind")

    def run(rows):
        number, chunk, new = TaskContext.get().partitionId() << 32, None, False
        for conv, turn, _, _, kind, role, text, n, fault in rows:
            if not kind:
                new = True
                continue
            if chunk and (chunk.conv != conv or len(chunk.rows) >= most or chunk.size >= BYTES):
                yield chunk.row(number)
                number, chunk = number + 1, None
            chunk = chunk or _Chunk(conv)
            chunk.add(turn, role, text, n, fault, not new)
            new = False
        if chunk:
            yield chunk.row(number)

    return _mapped(dealt, run, _CHUNK.format(conv_type))


def _costs_after(heads: DataFrame, conv_type: str) -> DataFrame:
    """(conv_id, chunk, after, last): the costs from the end of each chunk to
    the end of its conversation, and whether it is the last. Chunks come last
    first, so one vector is kept."""
    by = heads.select("conv_id", "chunk", "cost").repartition("conv_id").sortWithinPartitions("conv_id", F.desc("chunk"))

    def run(rows):
        conv, after = object(), np.array(END)
        for c, chunk, cost in rows:
            last = c != conv
            conv, after = c, np.array(END) if last else after
            yield c, chunk, after.tolist(), last
            after = (np.array(cost).reshape(4, 4) + after).min(axis=1)

    return _mapped(by, run, f"conv_id {conv_type}, chunk long, after array<long>, last boolean")


def _entries(after: DataFrame, heads: DataFrame, conv_type: str) -> DataFrame:
    """(chunk, after, last, entry): the state that each chunk begins in. A chunk
    before the last is unrolled from each state, for the state it ends in; the
    choices between equal costs need that."""
    inner = heads.select("chunk", "symbols", "lengths").join(after.where("not last").select("chunk", "after"), "chunk")

    def ends(rows):
        for chunk, symbols, lengths, costs in rows:
            out = []
            for s in range(4):
                end = s
                for _, end, _ in unroll(_runs(symbols, lengths), s, np.array(costs)):
                    pass
                out.append(end)
            yield chunk, out

    exits = _mapped(inner, ends, "chunk long, exits array<int>")
    by = after.join(exits, "chunk", "left").select("conv_id", "chunk", "after", "last", "exits")

    def run(rows):
        conv, state = object(), START
        for c, chunk, costs, last, out in rows:
            conv, state = c, START if c != conv else state
            yield chunk, costs, last, state
            state = START if last else out[state]

    by = by.repartition("conv_id").sortWithinPartitions("conv_id", "chunk")
    return _mapped(by, run, "chunk long, after array<long>, last boolean, entry int")


def _edits(chunks: DataFrame, entries: DataFrame, conv_type: str) -> DataFrame:
    both = chunks.select("conv_id", "chunk", "symbols", "lengths", "row_symbol", "row_times", "role", "text").join(entries, "chunk")
    names = ("conv_id", "chunk", "symbols", "lengths", "row_symbol", "row_times", "role", "text", "after", "last", "entry")

    def run(rows):
        for conv, chunk, symbols, lengths, row_symbol, row_times, roles, texts, after, last, entry in rows:
            k, left, n = -1, 0, 0
            state = entry
            for edit, state, many in unroll(_runs(symbols, lengths), entry, np.array(after)):
                if edit == "I":
                    yield conv, chunk, n, edit, 1, INSERT, ROLES[state], ""
                    n += 1
                    continue
                while many:  # rows of one run of deletions may differ
                    if not left:
                        k += 1
                        left = row_times[k]
                    part = min(many, left)
                    role = ROLES[state] if edit == "R" else roles[k]
                    cost = {"K": 0, "R": REROLE, "D": DELETE}[edit] * part + CUT_OFF * (edit != "D" and row_symbol[k] // 4 == TRUNCATED)
                    yield conv, chunk, n, edit, part, cost, role, texts[k]
                    many, left, n = many - part, left - part, n + 1
            for edit, state, _ in ending(state) if last else ():
                yield conv, chunk, n, edit, 1, INSERT, ROLES[state], ""
                n += 1

    return _mapped(both.select(*names), run, f"conv_id {conv_type}, chunk long, n long, edit string, times long, cost long, role string, text string")


# ------------------------------------------------------------------ interface


def repair_conversations(turns: DataFrame, chunk_rows: int = ROWS) -> tuple[DataFrame, DataFrame]:
    """(edits, counts) of ``turns`` (conv_id, turn, role, text and, if there,
    ``times``, how often the row stands there).

    edits: (conv_id, chunk, n, edit, times, cost, role, text); in the order of
    chunk and n they are the audit of a conversation, and the rows that are not
    deleted (D) its repaired turns. counts: one row for each conversation that
    has rows: (conv_id, gaps, blank, duplicate, truncated, illegal).

    Rows come by turn, null first, then by role and by a digest of the text, so
    ties do not depend on the order of the input; equal rows are duplicates of
    one another. A null role or text is one space; a null conv_id is one
    conversation, and a null turn is in no gap. A role of another initial than
    s, u or a must be reroled or deleted. An empty table gives empty results;
    other columns are ignored.
    """
    conv_type = dict(turns.dtypes)["conv_id"]
    n = F.col("times").cast("long") if "times" in turns.columns else F.lit(1).cast("long")
    space = F.lit(" ")
    rows = turns.select(
        "conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"), n.alias("times")
    )
    rows = rows.groupBy("conv_id", "turn", "role", "text").agg(F.sum("times").alias("times"))
    rows = rows.withColumns({"order_role": F.col("role"), "order_text": F.unhex(F.md5("text"))})
    chunks = stored(_chunks(rows, conv_type, chunk_rows), "repair-chunks")
    heads = chunks.drop("row_symbol", "row_times", "role", "text")
    after = stored(_costs_after(heads, conv_type), "repair-after")
    edits = stored(_edits(chunks, _entries(after, heads, conv_type), conv_type), "repair-edits")
    counts = stored(_counts(heads), "repair-counts")
    discard(chunks)
    discard(after)
    return edits, counts


def _counts(heads: DataFrame) -> DataFrame:
    w = Window.partitionBy("conv_id").orderBy("chunk")
    role, turn = F.lag("last_role").over(w), F.last("last_turn", True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    joint = heads.withColumns({"r": F.concat(role, "first_role"), "same": (turn == F.col("first_turn")).cast("long")})
    g = joint.groupBy("conv_id").agg(
        *[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated")],
        (F.sum("illegal") + F.count_if(~F.col("r").isin("su", "ua", "au"))).alias("illegal"),
        (F.max("last_turn") - F.min("first_turn") + 1 - F.sum("turns") + F.coalesce(F.sum("same"), F.lit(0))).alias("gaps"),
    )
    return g.select("conv_id", F.coalesce("gaps", F.lit(0).cast("long")).alias("gaps"), "blank", "duplicate", "truncated", "illegal")


def audits(edits: DataFrame) -> DataFrame:
    """(conv_id, cost, audit, repaired_sha256) of ``edits``. A hash runs over a
    text in order, so one task streams a conversation; it keeps the audit and
    the state of the hash."""
    conv_type = dict(edits.dtypes)["conv_id"]
    by = edits.repartition("conv_id").sortWithinPartitions("conv_id", "chunk", "n")
    by = by.select("conv_id", "edit", "times", "cost", F.when(F.col("edit") != "D", F.concat_ws(":", "role", "text")).alias("line"))

    def run(rows):
        conv, cost, parts, sha, more = object(), 0, [], None, False
        for c, edit, n, price, line in rows:
            if c != conv:
                if sha:
                    yield conv, cost, "".join(parts), sha.hexdigest()
                conv, cost, parts, sha, more = c, 0, [], hashlib.sha256(), False
            cost += price
            parts.append(edit * n)
            if line is not None:
                sha.update(("\n" * more + line).encode())
                more = True
        if sha:
            yield conv, cost, "".join(parts), sha.hexdigest()

    return _mapped(by, run, f"conv_id {conv_type}, cost long, audit string, repaired_sha256 string")


def damaged(conversations: DataFrame) -> DataFrame:
    """The rows after the damage that the contract lays down: by the hash of
    conversation and turn a row in 20 each goes, loses its text or its final
    marks, stands twice (``times`` 2) or becomes the user's."""
    space = F.lit(" ")
    key = F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), space), F.coalesce(F.col("turn").cast("string"), space))
    kind = F.crc32(key) % 20
    rows = conversations.select("conv_id", "turn", F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"), kind.alias("kind"))
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    twice = F.when(F.col("kind") == 3, 2).otherwise(1).cast("long")
    return rows.where("kind <> 0").select("conv_id", "turn", role.alias("role"), text.alias("text"), twice.alias("times"))


def repair_report(original: DataFrame, turns: DataFrame, chunk_rows: int = ROWS) -> DataFrame:
    """One row for every conversation of ``original``, after the repair of
    ``turns``; zeros, an empty audit and the hash of nothing where it has no
    row left."""
    edits, counts = repair_conversations(turns, chunk_rows)
    found = counts.join(audits(edits).withColumnRenamed("conv_id", "_conv"), F.col("conv_id").eqNullSafe(F.col("_conv"))).drop("_conv")
    found = found.withColumnRenamed("conv_id", "_conv")
    out = original.select("conv_id").distinct().join(found, F.col("conv_id").eqNullSafe(F.col("_conv")), "left")
    zero = F.lit(0).cast("long")
    nothing = F.lit(hashlib.sha256().hexdigest())
    return out.select(
        "conv_id", *[F.coalesce(c, zero).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")],
        F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", nothing).alias("repaired_sha256"),
    )


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations")
    return repair_report(conversations, damaged(conversations))


QUERIES = {"op11_conversation_repair": op11}
