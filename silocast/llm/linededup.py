"""Exact substring dedup by hashing lines and runs of words (operator 9).

Units are whole texts and paragraphs, lines of ``min_words`` words or more,
shorter lines together with their neighbours and, so that a passage with other
line breaks or inside another line is found too, runs of ``RUN`` words chosen
by their own hashes. Units are normalised and hashed; digests are
grouped globally with a partial aggregate on the map side, the earliest ranked
occurrence is kept and the others are cut out of their texts. The few digests
that hold a large share of all units are broadcast, so no task gets all
occurrences of one.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from .common import discard, stored, table

WORD = re.compile(r"[^\W_]+")
LINE = re.compile(r"[^\n\r]+")
BLANK = re.compile(r"(?:\r\n?|\n)[ \t]*(?:\r\n?|\n)[ \t\r\n]*")
MARKS = re.compile(r"\S*")
#: words of a run that is hashed wherever the lines around it break
RUN = 25
#: digests with one in so many units or more are broadcast: there are no more than that
HEAVY = 2000
_UNITS = "h1 long, h2 long, key long, doc_id long, first int, last int"


def word_runs(text: str, size: int) -> Iterator[tuple[int, int, list[str]]]:
    """(start, end, words) of runs of ``size`` words, over line breaks: of each
    ``size`` + 1 runs that follow one another the one with the least hash. So
    any passage of 2 * size words has the same chosen runs wherever it stands.
    A run that overlaps its own copy is left out."""
    places = [m.span() for m in WORD.finditer(text)]
    if len(places) < 2 * size:
        return
    words = [text[a:b].lower() for a, b in places]
    h = np.fromiter((xxhash.xxh3_64_intdigest(x.encode("utf-8", "surrogatepass")) for x in words), "<u8", len(words))
    sums = np.zeros(len(h) - size + 1, "<u8")
    for j in range(size):
        sums = sums * np.uint64(0x9E3779B97F4A7C15) + h[j : j + len(sums)]
    sums = (sums ^ (sums >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    least = np.lib.stride_tricks.sliding_window_view(sums, size + 1).argmin(axis=1) + np.arange(len(sums) - size)
    ends: dict[int, int] = {}
    for a in np.unique(least).tolist():
        if ends.get(int(sums[a]), 0) <= a:
            ends[int(sums[a])] = a + size
            last, after = places[a + size - 1][1], places[a + size][0] if a + size < len(places) else len(text)
            yield places[a][0], MARKS.match(text, last, after).end(), words[a : a + size]


def _digest(kind: str, *lines: list[str]) -> bytes:
    """Of words; ``kind`` keeps units of different kinds apart."""
    return xxhash.xxh3_128_digest("\n".join([kind, *(" ".join(x) for x in lines)]).encode("utf-8", "surrogatepass"))


def line_units(text: str, min_words: int) -> Iterator[tuple[int, int, bytes]]:
    """(start, end, 16-byte digest), by place, of the units of a text:

    * the whole text, and each paragraph between blank lines, of any length;
    * each line of ``min_words`` words or more;
    * each three lines that follow one another, one of them shorter: a short
      line goes only together with its neighbours;
    * the runs of ``word_runs``.

    Lines without a word are passed over; three lines that overlap their own
    copy are left out. Units equal but for case, punctuation and white space
    have equal digests."""
    out = {(a, b, _digest("run", words)) for a, b, words in word_runs(text, RUN)}
    lines = [(m.start(), m.end(), WORD.findall(m.group().lower())) for m in LINE.finditer(text)]
    lines = [x for x in lines if x[2]]
    if lines:
        out.add((0, len(text), _digest("text", [w for x in lines for w in x[2]])))
    out.update((a, b, _digest("line", words)) for a, b, words in lines if len(words) >= min_words)
    ends: dict[bytes, int] = {}
    for three in zip(lines, lines[1:], lines[2:], strict=False):
        if min(len(x[2]) for x in three) < min_words:
            d = _digest("lines", *(x[2] for x in three))
            if ends.get(d, -1) < three[0][0]:
                ends[d] = three[2][1]
                out.add((three[0][0], three[2][1], d))
    if len(breaks := [m.span() for m in BLANK.finditer(text)]) > 0:
        for a, b in zip([0, *(e for _, e in breaks)], [*(s for s, _ in breaks), len(text)], strict=True):
            if words := WORD.findall(text[a:b].lower()):
                out.add((a, b, _digest("text", words)))
    yield from sorted(out)


def without_spans(text: str, spans: list[tuple[int, int]]) -> str:
    """``text`` without the ordered ranges ``spans`` (they may overlap), the blanks after each,
    and the line break of a line of which nothing is left."""
    kept, end = [], 0
    for first, last in spans:
        kept.append(text[end:first])
        end = max(end, last)
        while text[end : end + 1] in (" ", "\t"):
            end += 1
        so_far = next((k for k in reversed(kept) if k), "")
        if not so_far or so_far[-1] in "\n\r":
            end += 2 if text[end : end + 2] == "\r\n" else 1 if text[end : end + 1] in ("\n", "\r") else 0
    return "".join([*kept, text[end:]])


def repeated_lines(docs: DataFrame, min_words: int = 20) -> DataFrame:
    """(doc_id, key, spans): for each text the code point ranges [first, last)
    of its units that occurred before, in this text or one of a smaller
    (doc_id, key). ``docs`` has key, doc_id, text; key tells the texts of one
    doc_id apart. Texts without such units are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["h1", "h2", "key", "doc_id", "first", "last"]
        types = [pa.int64()] * 4 + [pa.int32()] * 2
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                out: list[list] = [[] for _ in names]
                for key, doc, text in zip(*(c.to_pylist() for c in batch.slice(at, 256).columns)):
                    for a, b, d in line_units(text or "", min_words):
                        row = (int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True))
                        for c, x in zip(out, (*row, key, doc, a, b)):
                            c.append(x)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], names=names)

    units = stored(docs.select("key", "doc_id", "text").mapInArrow(run, _UNITS), "lines")
    rank = F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "key", "first")
    kept = units.groupBy("h1", "h2").agg(F.min(rank).alias("kept"), F.count("*").alias("c")).where("c > 1")
    kept = stored(kept, "kept")
    share = max(2, units.count() // HEAVY)
    heavy = kept.where(F.col("c") >= share).select("h1", "h2", F.col("kept").alias("heavy"))  # HEAVY rows at most
    light = kept.where(F.col("c") < share).select("h1", "h2", "kept")
    marked = units.join(F.broadcast(heavy), ["h1", "h2"], "left")
    again = marked.where("heavy is null").join(light, ["h1", "h2"]).where(~rank.eqNullSafe(F.col("kept"))).select("doc_id", "key", "first", "last")
    more = marked.where(F.col("heavy").isNotNull() & ~rank.eqNullSafe(F.col("heavy"))).select("doc_id", "key", "first", "last")
    spans = again.union(more).groupBy("doc_id", "key").agg(F.sort_array(F.collect_set(F.struct("first", "last"))).alias("spans"))
    spans = stored(spans, "spans")
    discard(units)
    discard(kept)
    return spans


def without_lines(docs: DataFrame, min_words: int = 20) -> DataFrame:
    """``docs`` with repeated units cut out of ``text``, plus ``removed``:
    array of (first, last), ranges of code points of the original text.

    Units (``line_units``) are whole texts and paragraphs of any length, lines
    of ``min_words`` words or more, three lines in a row, and runs of ``RUN``
    words. A passage of 2 * RUN words or more is found whatever stands around
    it, but up to RUN words at each of its ends may stay; one or two repeated
    lines shorter than ``min_words`` stay, unless they are a text or paragraph.
    The earliest occurrence, by doc_id (null
    last) and place, stays. Blanks after a cut unit go with it, and so does the
    break of an emptied line. Null texts stay null; empty texts stay as they
    are; very long texts count whole. Rows of equal doc_id and text are one
    document and come out alike. Empty input gives an empty result. Other
    columns pass; columns named ``key``, ``spans`` or ``removed`` are replaced.
    """
    docs = docs.drop("key", "spans", "removed").withColumn("text", F.col("text").cast("string"))
    rows = docs.withColumn("doc_id", F.col("doc_id").cast("long")).withColumn("key", F.xxhash64("text"))
    spans = repeated_lines(rows, min_words).select(F.col("doc_id").alias("_doc"), F.col("key").alias("_key"), "spans")
    joined = rows.join(spans, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("key") == F.col("_key")), "left")
    names = [c for c in rows.columns if c != "key"]
    span = StructType([StructField("first", IntegerType()), StructField("last", IntegerType())])
    schema = StructType(rows.select(*names).schema.fields + [StructField("removed", ArrayType(span))])
    at = names.index("text")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for first in range(0, whole.num_rows, 512):
                batch, texts = whole.slice(first, 512), []
                for text, spans in zip(batch.column(at).to_pylist(), batch.column(len(names)).to_pylist()):
                    if spans and text is not None:
                        text = without_spans(text, [(x["first"], x["last"]) for x in spans])
                    texts.append(text)
                columns = list(batch.columns)
                columns[at] = pa.array(texts, pa.string())
                yield pa.RecordBatch.from_arrays(columns, names=[*names, "removed"])

    spans = F.coalesce("spans", F.array().cast("array<struct<first:int,last:int>>"))
    return joined.select(*names, spans.alias("removed")).mapInArrow(cut, schema)


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = without_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "text", F.size("removed").cast("long").alias("n_removed"), "removed")


QUERIES = {"op9_line_dedup": op9}
