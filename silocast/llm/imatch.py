"""I-Match document fingerprints (operator 1).

Terms whose document share lies in a band form the lexicon. At most
(mean distinct terms of a document) / ``low`` terms can reach the band's lower
end, whatever the size of the corpus, so the lexicon is small enough to
broadcast. Randomised subsets of it, of several inclusion rates, give one hash
each over a document's sorted distinct terms.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored, table

TERM = re.compile(r"[^\W_]+")
#: a subset holds a lexicon term with one in so many; so many subsets of each rate.
#: Dense subsets tell nearly equal term sets apart, thin ones still agree after large edits.
RATES = ((4, 8), (64, 12), (256, 12))


def terms(text: str) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the lower-cased terms of ``text``."""
    h = xxhash.xxh3_64_intdigest
    found = {h(w.encode("utf-8", "surrogatepass")) for w in set(TERM.findall(text.lower()))}
    return np.sort(np.fromiter(found, dtype=np.uint64, count=len(found)))


def term_counts(docs: DataFrame) -> DataFrame:
    """(term, df): in how many rows of ``docs`` each term occurs. Every task
    adds up its own rows before the shuffle, in parts of bounded size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def summed() -> pa.RecordBatch:
            t, n = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(t.view(np.int64)), pa.array(n)], names=["term", "df"])

        for batch in batches:
            for text in batch.column(0).to_pylist():
                held.append(terms(text or ""))
                size += len(held[-1])
                if size > 4_000_000:
                    yield summed()
                    held, size = [], 0
        if held:
            yield summed()

    counts = docs.select("text").mapInArrow(run, "term long, df long")
    return counts.groupBy("term").agg(F.sum("df").alias("df"))


def lexicon(docs: DataFrame, low: float, high: float) -> np.ndarray:
    """Sorted hashes of the terms in ``low`` to ``high`` of all rows."""
    n = docs.count()
    found = term_counts(docs).where(F.col("df").between(max(2, int(np.ceil(low * n))), int(high * n))).select("term")
    return np.sort(np.array([r.term for r in found.collect()], dtype=np.int64).view(np.uint64))


class Printer:
    """Fingerprints of term sets under one lexicon."""

    def __init__(self, words: np.ndarray):
        self.words = words
        rates = [rate for rate, n in RATES for _ in range(n)]
        self.k = len(rates)
        self.inside = np.array([_mixed(words ^ np.uint64(j * 0x9E3779B97F4A7C15 % 2**64)) % np.uint64(r) == 0 for j, r in enumerate(rates)])

    def prints(self, t: np.ndarray) -> np.ndarray:
        """One 32-bit number per subset: the hash of those of the sorted
        distinct terms ``t`` that are in it, 0 where none is."""
        at = np.searchsorted(self.words, t)
        at = at[np.append(self.words, np.uint64(0))[at] == t] if len(self.words) else at[:0]
        subset, term = np.nonzero(self.inside[:, at])
        ends = np.searchsorted(subset, np.arange(self.k + 1)).tolist()
        kept = self.words[at[term]].tobytes()
        out = [max(1, xxhash.xxh3_64_intdigest(kept[8 * a : 8 * b], j) >> 32) if b > a else 0 for j, (a, b) in enumerate(zip(ends, ends[1:]))]
        return np.array(out, np.uint32)

    def text(self, text: str) -> tuple[str, np.ndarray]:
        """(fingerprint, numbers). With no lexicon term in the text, the hash
        of all its sorted terms (or, without any, of the text) is the one
        number, so that such texts are not all alike."""
        t = terms(text)
        p = self.prints(t)
        if not p.any():
            left = t.tobytes() or text.encode("utf-8", "surrogatepass")
            whole = xxhash.xxh3_64_intdigest(left)
            p = np.zeros(self.k, np.uint32)
            p[0] = max(1, whole >> 32)
            return f"all-{whole:016x}", p
        return p.astype(">u4").tobytes().hex(), p


def _mixed(z: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of equal numbers among the subsets that hold a term of either."""
    some = (a != 0) | (b != 0)
    return float((a == b)[some].sum() / some.sum()) if some.any() else 1.0


def imatch(docs: DataFrame, low: float = 0.002, high: float = 0.2) -> DataFrame:
    """(doc_id, fingerprint) per row of ``docs``: equal texts, equal
    fingerprints. A null text counts as empty; see ``edited_pairs`` for more."""
    words = docs.sparkSession.sparkContext.broadcast(lexicon(docs, low, high))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        printer = Printer(words.value)
        for batch in batches:
            out = [printer.text(x or "")[0] for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], names=["doc_id", "fingerprint"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, fingerprint string")


_OUT = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
    "near_edited double, near_next double"
)


def _record(printer: Printer, row: tuple, after: tuple) -> tuple:
    """The result for ``row`` = (doc_id, text, fingerprint, numbers)."""
    doc, text, mark, own = row
    half = len(text) // 2
    edited = text[: len(text) - half] + after[1][:half]
    e_mark, e = printer.text(edited)
    sha = hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest()
    return doc, len(text), sha, mark, e_mark, likeness(own, e), likeness(own, after[3])


def edited_pairs(docs: DataFrame, low: float = 0.002, high: float = 0.2) -> DataFrame:
    """Per row: its fingerprint, that of its edited text, and likenesses.

    The edited text replaces the last floor(n/2) code points by the first as
    many of the next row by (doc_id, hash of the text), the last row's next
    being the first. Rows are range-partitioned, so a row's next is in its own partition
    but for each partition's last, which meets the next partition's first in a
    join of one row per partition. Null texts count as empty, null ids come
    first, repeated rows are rows of their own; a single row is its own next.
    Empty input gives an empty result; other columns are ignored.
    """
    spark = docs.sparkSession
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    )
    words = spark.sparkContext.broadcast(lexicon(rows, low, high))
    kinds = pa.schema([
        ("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()),
        ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64()),
        ("pid", pa.int64()), ("end", pa.int32()), ("text", pa.string()),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        printer, pid, last, first = Printer(words.value), TaskContext.get().partitionId(), None, True
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                out = []
                part = batch.slice(at, 512)
                for doc, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    row = (doc, text, *printer.text(text))
                    if first:
                        out.append((doc, *[None] * 6, pid, 0, text))
                        first = False
                    else:
                        out.append((*_record(printer, last, row), pid, None, None))
                    last = row
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), kinds)], schema=kinds)
        if last:
            out = (last[0], *[None] * 6, pid, 1, last[1])
            yield pa.RecordBatch.from_arrays([pa.array([c], f.type) for c, f in zip(out, kinds)], schema=kinds)

    # the range bounds go to the driver, so they are of digests, not texts
    rows = rows.withColumn("mark", F.xxhash64("text"))
    ordered = rows.repartitionByRange("doc_id", "mark").sortWithinPartitions("doc_id", "mark", "text").drop("mark")
    done = stored(ordered.mapInArrow(run, _OUT + ", pid long, end int, text string"), "imatch")
    firsts = done.where("end = 0").select("pid", F.col("text").alias("next_text"))
    pids = sorted(r.pid for r in firsts.select("pid").collect())
    after = spark.createDataFrame(
        list(zip(pids, pids[1:] + pids[:1])) or [(-1, -1)], "pid long, next_pid long"
    )
    lasts = done.where("end = 1").join(after, "pid").join(firsts.withColumnRenamed("pid", "next_pid"), "next_pid")

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        printer = Printer(words.value)
        for batch in batches:
            for doc, text, other in zip(*(c.to_pylist() for c in batch.columns)):
                out = _record(printer, (doc, text, *printer.text(text)), (None, other, *printer.text(other)))
                columns = [pa.array([c], f.type) for c, f in zip(out, kinds)]
                yield pa.RecordBatch.from_arrays(columns, names=kinds.names[:7])

    closed = lasts.select("doc_id", "text", "next_text").mapInArrow(close, _OUT)
    return done.where("end is null").select(*closed.columns).union(closed)


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_pairs(table(spark, sf_dir, "documents"))


QUERIES = {"op1_imatch": op1}
