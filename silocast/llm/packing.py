"""Harmonic packing of token sequences (operator 3).

A piece of a document belongs to class j when its length lies just below
capacity / j; a bin of class j takes j pieces, whichever they are. Documents
are cut so that pieces fill their class nearly whole. Workers number the
pieces of each class on their own; the counts give every worker its start, so
only the last bin of a class is short. Those few pieces, fewer than the sum of
all j, are packed by first fit.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator, Sequence
from itertools import chain

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer
from tokenizers.pre_tokenizers import ByteLevel

from .common import ranked, stored, table

CAPACITY, END_ID = 4096, 2
#: pieces per bin, by class: one by one, then in steps of about a quarter
COUNTS = (1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 16, 20, 24, 32, 40, 48, 64, 80, 96, 128, 192, 256, 512, 1024, 2048, 4096)


def piece_lengths(n: int, capacity: int = CAPACITY, spare: float = 0.02) -> list[tuple[int, int]]:
    """(length, pieces per bin) of the pieces of an ``n``-token document.

    A piece stays whole if it leaves at most ``spare`` of its slot free;
    else the slot of the next class is filled to the last token, and the rest
    is cut in the same way."""
    out = [(capacity, 1)] * (n // capacity)
    n %= capacity
    counts = [j for j in COUNTS if j <= capacity]
    while n:
        i = max(k for k, j in enumerate(counts) if n <= capacity // j)
        slot = capacity // counts[i]
        if slot - n <= spare * slot or i + 1 == len(counts):
            out.append((n, counts[i]))
            break
        take = capacity // counts[i + 1]
        out.append((take, counts[i + 1]))
        n -= take
    return out


#: beyond the letters whose lower case is the same in Python and in the tokenizer
WIDE = re.compile(r"[^\x00-\u024f]")
#: a full stop or comma that the tokenizer joins to a mark before it (the lower case of İ ends with one)
JOINED = re.compile(r"[.,] (?<=(?:[^\w \t-\r]|[_İ])[.,] )")
#: marks that, after letters, are a part of their own
MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
#: what must come out alike for words to be given to the BPE model itself
PROBES = ("the", "don", "übergrößen", "élève", "niñoſ", "word###", "cañón|", "ĳsƀɏ", "a.b", "é<|>")


def parted(text: str) -> str:
    """``text`` with the same ids and fewer distinct words between blanks:
    lower case, and stops and commas that end a word set apart."""
    text = text.replace("\n", " ")
    if "<|" not in text and (text.isascii() or not WIDE.search(text)):
        text = text.lower()
    if not JOINED.search(text):
        text = text.replace(". ", " . ").replace(", ", " , ")
    return text


class WordIds(dict):
    """Word to its place in a table of ids, so that each distinct word is
    encoded once a task. The tokenizer drops white space and no rule of it
    reaches over a blank, so the ids of a text are those of its words in turn.
    A word of lower-case letters, and the marks after it, are one part each of
    the tokenizer's: they go to its BPE model as they are, which takes a quarter
    of the time; other words are encoded, and so are all where a tokenizer has
    other parts. Beyond ``most`` words the table starts anew, between two calls."""

    def __init__(self, path: str, most: int = 500_000):
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tok, self.most = Tokenizer.from_file(path), most
        self.model = self.tok.model
        self.new: list[str] = []
        self.ids, self.ends = np.empty(1 << 16, "<u4"), np.zeros(1 << 16, np.int64)
        as_bytes = ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str
        self.bytes = {c: as_bytes(chr(c))[0][0] for c in range(128, 0x250)}
        self.parts = True
        self.parts = [self._part(w) or e for w, e in zip(PROBES, self._encoded(PROBES))] == self._encoded(PROBES)

    def __missing__(self, word: str) -> int:
        self[word] = at = len(self)
        self.new.append(word)
        return at

    def _encoded(self, words: Sequence[str]) -> list[list[int]]:
        return [e.ids for e in self.tok.encode_batch_fast(words, add_special_tokens=False)]

    def _part(self, word: str) -> list[int] | None:
        """The ids of lower-case letters and marks after them, else None."""
        letters = word if word.isalpha() else word.rstrip(MARKS)
        if not (self.parts and letters.isalpha() and letters.islower()):
            return None
        marks = word[len(letters) :]
        if not letters.isascii():
            if WIDE.search(letters):
                return None
            letters = letters.translate(self.bytes)
        ids = [t.id for t in self.model.tokenize(letters)]
        return ids + [t.id for t in self.model.tokenize(marks)] if marks else ids

    def _learn(self) -> None:
        """The ids of the new words, appended to the table."""
        done = len(self) - len(self.new)
        for at in range(0, len(self.new), 4096):
            found = [self._part(w) for w in self.new[at : at + 4096]]
            rest = [i for i, ids in enumerate(found) if ids is None]
            for i, ids in zip(rest, self._encoded([self.new[at + i] for i in rest]), strict=True):
                found[i] = ids
            flat = np.fromiter(chain.from_iterable(found), "<u4")
            ends = self.ends[done] + np.cumsum([len(x) for x in found])
            while len(self.ids) < ends[-1]:
                self.ids = np.append(self.ids, np.empty_like(self.ids))
            while len(self.ends) <= done + len(found):
                self.ends = np.append(self.ends, np.empty_like(self.ends))
            self.ids[self.ends[done] : ends[-1]] = flat
            self.ends[done + 1 : done + 1 + len(found)] = ends
            done += len(found)
        self.new = []

    def texts(self, texts: list[str | None]) -> Iterator[np.ndarray]:
        """Per text its ids and END_ID."""
        if len(self) > self.most:
            self.clear()
        places = []
        for text in texts:
            words = parted(text or "").split(" ")
            places.append(np.fromiter(map(self.__getitem__, words), np.int64, len(words)))
        self._learn()
        for at in places:
            first = self.ends[at]
            n = self.ends[at + 1] - first
            done = np.cumsum(n)
            out = np.empty(int(done[-1]) + 1, "<u4")
            out[:-1] = self.ids[np.arange(len(out) - 1) + np.repeat(first - done + n, n)]
            out[-1] = END_ID
            yield out


_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, class int"


def harmonic_pack(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset) per
    piece of a document.

    A document is its ids and END_ID; null and empty texts are END_ID alone.
    Very long texts become many full sequences and a rest. Repeated rows are
    packed one by one; null ids stay. Empty input gives an empty result; other
    columns are ignored. ``path``: a ``tokenizers`` file.
    """
    path = path or public_tokenizers.path("word_bpe_49k.json")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordIds(path)
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "class"]
        types = [pa.int64()] * 5 + [pa.int32()]
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part, out = batch.slice(at, 256), []
                for doc, ids in zip(part.column(0).to_pylist(), words.texts(part.column(1).to_pylist())):
                    start = 0
                    for length, j in piece_lengths(len(ids), capacity):
                        out.append((doc, start, length, zlib.crc32(ids[start : start + length]), len(ids), j))
                        start += length
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    pieces = ranked(rows.mapInArrow(run, _PIECES), "class", "pieces")
    pieces = stored(pieces, "ranked")
    totals = {r["class"]: r["count"] for r in pieces.groupBy("class").count().collect()}
    first, base, full = 0, F.lit(0).cast("long"), F.lit(0).cast("long")
    for j, n in sorted(totals.items()):
        base = F.when(F.col("class") == j, F.lit(first)).otherwise(base)
        full = F.when(F.col("class") == j, F.lit(n // j * j)).otherwise(full)
        first += n // j
    bins = pieces.where(F.col("rank") < full).withColumn(
        "sequence_id", (base + F.floor(F.col("rank") / F.col("class"))).cast("long")
    )

    def fit(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["length", "doc_id", "start", "rank"], ascending=[False, True, True, True])
        room, where = np.empty(0, np.int64), []
        for n in group["length"]:
            ok = np.flatnonzero(room >= n)
            if not len(ok):
                room, ok = np.append(room, capacity), [len(room)]
            room[ok[0]] -= n
            where.append(first + int(ok[0]))
        return group.assign(sequence_id=where)

    short = pieces.where(F.col("rank") >= full)
    # fewer pieces than the sum of COUNTS, whatever the input
    short = short.groupBy(F.col("class") < 0).applyInPandas(fit, bins.schema)
    before = Window.partitionBy("sequence_id").orderBy("class", "rank").rowsBetween(Window.unboundedPreceding, -1)
    return bins.unionByName(short).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id",
        F.coalesce(F.sum("length").over(before), F.lit(0)).cast("long").alias("offset"),
    )


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return harmonic_pack(table(spark, sf_dir, "documents"))


QUERIES = {"op3_harmonic_packing": op3}
