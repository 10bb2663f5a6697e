"""Language ID by word-first backoff (operator 5).

A known word scores by its log frequency in each language. An unseen word is
covered from left to right by character n-grams, the longest known one first,
shorter ones where it is unknown. The model is fitted on a bounded sample of
labelled rows, so what is broadcast does not grow with the corpus.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: characters that ``\w`` takes and that are neither letters nor decimal digits
OTHER = frozenset(
    c for c in map(chr, range(sys.maxunicode + 1)) if c.isalnum() and not c.isdecimal() and unicodedata.category(c)[0] != "L"
)
_RUN, _STRICT = re.compile(r"[^\W\d_]+"), re.compile(rf"[^\W\d_{''.join(sorted(OTHER))}]+")


def letters(text: str) -> list[str]:
    """The runs of letters of ``text`` in lower case."""
    text = text.lower()
    return (_RUN if text.isascii() or OTHER.isdisjoint(text) else _STRICT).findall(text)


#: labelled rows of each language that a model is fitted on (about); longest n-gram
SAMPLE_ROWS, LONGEST = 1500, 4
#: how a mean difference of log frequencies becomes a probability
SHARPNESS = 4.0


def held_out(fold_of: int = 4, fold: int = 2) -> Column:
    """Whether the row is of the held-out fold; a null doc_id is not."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % fold_of == fold, F.lit(False))


def chance(salt: str, *columns: str) -> Column:
    """A number from 0 to 1 by a 53-bit hash of ``columns``."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(salt), *columns), 11) / F.lit(float(2**53))


def sampled(rows: DataFrame, most: int, by: str, salt: str, *columns: str) -> DataFrame:
    """About ``most`` rows of each value of ``by``, chosen by a hash of
    ``columns``; all rows of a value that has no more. ``by`` has few values
    (languages, labels), so the table of their numbers is broadcast."""
    sizes = rows.groupBy(F.col(by).alias("_by")).agg(F.count("*").alias("_n"))
    picked = rows.join(F.broadcast(sizes), F.col(by).eqNullSafe(F.col("_by")))
    return picked.where(chance(salt, *columns) < F.lit(float(most)) / F.col("_n")).drop("_by", "_n")


def grams(word: str) -> Iterator[str]:
    """All n-grams of ``word`` with its ends marked."""
    padded = f"^{word}$"
    for k in range(1, LONGEST + 1):
        for i in range(len(padded) - k + 1):
            yield padded[i : i + k]


class Model:
    """Log frequencies of words and of n-grams by language, centred on their
    mean over the languages: one row of a matrix for each item."""

    def __init__(self, counts: dict[str, Counter]):
        self.langs = sorted(counts)
        parts: dict[str, Counter] = {x: Counter() for x in self.langs}
        for x in self.langs:
            for word, n in counts[x].items():
                for g in grams(word):
                    parts[x][g] += n
        self.words, self.word_rows = self._logs(counts)
        self.grams, self.gram_rows = self._logs(parts)

    def _logs(self, counts: dict[str, Counter]) -> tuple[dict[str, int], np.ndarray]:
        if not counts:
            return {}, np.zeros((0, 0), np.float32)
        place = {item: i for i, item in enumerate(sorted(set().union(*counts.values())))}
        n = np.zeros((len(place), len(self.langs)))
        for j, x in enumerate(self.langs):
            for item, c in counts[x].items():
                n[place[item], j] = c
        log = np.log((n + 0.5) / (n.sum(axis=0) + 0.5 * len(n)))
        return place, (log - log.mean(axis=1, keepdims=True)).astype(np.float32)

    def unseen(self, word: str) -> np.ndarray:
        """The score of a word by its n-grams."""
        padded, i, used = f"^{word}$", 0, []
        while i < len(padded):
            for k in range(min(LONGEST, len(padded) - i), 0, -1):
                at = self.grams.get(padded[i : i + k])
                if at is not None:
                    used.append(at)
                    i += k
                    break
            else:
                i += 1
        return self.gram_rows[used].sum(axis=0) / max(1.0, len(used) ** 0.5)


class Predictor(dict):
    """Word to its row of scores: the model's words, then unseen words as they
    come. Beyond ``most`` unseen ones the latter start anew."""

    def __init__(self, model: Model, most: int = 100_000):
        super().__init__(model.words)
        self.model, self.known, self.most = model, len(model.words), most
        self.rows = np.append(model.word_rows, np.empty((4096, len(model.langs)), np.float32), axis=0)

    def __missing__(self, word: str) -> int:
        at = len(self)
        if at == len(self.rows):
            self.rows = np.append(self.rows, np.empty((len(self.rows) // 2, self.rows.shape[1]), np.float32), axis=0)
        self.rows[at] = self.model.unseen(word)
        self[word] = at
        return at

    def predict(self, text: str | None) -> tuple[str, float]:
        """(language, score) by the mean score of the words of ``text``."""
        words = letters(text) if text else []
        if not words or not self.model.langs:
            return "und", 0.0
        if len(self) > self.known + self.most:
            self.clear()
            self.update(self.model.words)
            self.rows = self.rows[: self.known + 4096].copy()
        at = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        mean = self.rows[at].sum(axis=0, dtype=np.float64) / len(at)
        p = np.exp(SHARPNESS * (mean - mean.max()))
        return self.model.langs[int(p.argmax())], float(p.max() / p.sum())


def fit(rows: DataFrame, most: int = SAMPLE_ROWS) -> Model:
    """A model of ``rows`` (doc_id, text, lang), fitted on about ``most`` rows
    of each language, whole texts of them; all their words and n-grams count.
    Rows of null text or lang are left out; without rows the model has no
    language."""
    rows = rows.where("text is not null and lang is not null").select("doc_id", "text", "lang")
    rows = sampled(rows, most, "lang", "lang", "doc_id", "text").select("lang", "text")

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                found: Counter = Counter()
                for lang, text in zip(*(c.to_pylist() for c in batch.slice(at, 1024).columns)):
                    found.update((lang, w) for w in letters(text))
                lang, word = zip(*found) if found else ((), ())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(lang, pa.string()), pa.array(word, pa.string()), pa.array(found.values(), pa.int64())],
                    names=["lang", "word", "n"],
                )

    counts = rows.mapInArrow(counted, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    found: dict[str, Counter] = {}
    for r in counts.collect():
        found.setdefault(r["lang"], Counter())[r["word"]] = r["n"]
    return Model(found)


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with lang_pred and score (0 to 1), both from ``text`` alone.

    Null and empty texts and texts without a letter are ``und`` with score 0,
    as is all text under a model without languages. Ties go to the first
    language by name. Very long texts count whole. Repeated rows come out
    alike; null ids stay; empty input gives an empty result; columns named
    lang_pred or score are replaced, others pass.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    docs = docs.drop("lang_pred", "score").withColumn("text", F.col("text").cast("string"))
    names, at = docs.columns, docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        predictor = Predictor(shared.value)
        for batch in batches:
            for first in range(0, batch.num_rows, 512):
                part = batch.slice(first, 512)
                pred, score = zip(*map(predictor.predict, part.column(at).to_pylist()))
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(pred, pa.string()), pa.array(score, pa.float64())], names=[*names, "lang_pred", "score"]
                )

    schema = docs.withColumn("lang_pred", F.lit("")).withColumn("score", F.lit(0.0)).schema
    return docs.mapInArrow(run, schema)


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs.where(~held_out()))
    out = identify(docs.select("doc_id", "text"), model)
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


QUERIES = {"op5_langid": op5}
