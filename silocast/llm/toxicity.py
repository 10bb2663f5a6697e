"""Toxicity by weak supervision (operator 8).

Many voters look at a text: single words of a fixed lexicon, patterns, and
groups of words and word beginnings that go with the labels. A generative
label model (EM over class-conditional vote rates) estimates how accurate each
is; votes that go together beyond what the class explains count less. A linear
classifier over the words and word beginnings of the text, not over the votes,
is trained on the posterior labels and scores whole texts.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored, table
from .langid import held_out, letters, sampled

#: Insults, swear words and words of contempt.
LEXICON = (
    "idiot", "moron", "stupid", "pathetic", "worthless", "disgusting", "loser", "clown", "scum", "trash",
    "dumb", "fool", "imbecile", "jerk", "coward", "liar", "garbage", "filth", "vermin", "parasite", "pig", "rat",
    "bastard", "bitch", "asshole", "shit", "fuck", "fucking", "crap", "damn", "hate", "kill", "ugly", "freak", "creep",
)
_BAD = "(?:" + "|".join(LEXICON) + ")s?"
#: what a hostile sentence looks like
PATTERNS = tuple(
    re.compile(p)
    for p in (
        rf"\b(?:you|your|they|he|she)\b[^.!?\n]{{0,40}}\b{_BAD}\b",
        rf"\b{_BAD}\b[^.!?\n]{{0,40}}\b(?:you|your|them|him|her)\b",
        rf"\b(?:such|what|like|total|complete|utter) an? {_BAD}\b",
        r"\b(?:shut up|get lost|go away|drop dead|screw you|kill yourself|go to hell)\b",
        r"\bi (?:will|am going to|want to) (?:kill|hurt|find|beat|destroy) you\b",
        r"\b(?:nobody|no one) (?:likes|wants|cares about) (?:you|them|him|her)\b",
        rf"\b{_BAD}\b[^.\n]{{0,20}}!",
        rf"\b{_BAD}\b(?:\W+\w+){{0,8}}\W+{_BAD}\b",
    )
)
#: word beginnings have so many letters; voters over learned words and beginnings
STEMS, GROUPS = (4, 5, 6), 12
#: labelled rows that are learned from (about); how far from chance and in how
#: many of these rows an item must occur to be a feature
SAMPLE_ROWS, FAR, LEAST = 12_000, 4.0, 5


def items(words: set[str]) -> set[str]:
    """The words and their beginnings, as learned items are named."""
    return words.union(*({f"{w[:k]}-" for w in words if len(w) > k} for k in STEMS))


class Voters:
    """Votes of a text: 1 fires, 0 does not. ``learned``: items that go with
    toxic labels, each in one of a few groups that vote."""

    def __init__(self, learned: list[str]):
        self.at = {x: len(LEXICON) + zlib.crc32(x.encode()) % GROUPS + GROUPS * x.endswith("-") for x in learned}
        self.n = len(LEXICON) + 2 * GROUPS + len(PATTERNS) + 1

    def votes(self, text: str) -> np.ndarray:
        low, words = text.lower(), set(letters(text))
        v = np.zeros(self.n, np.int8)
        v[: len(LEXICON)] = [w in words for w in LEXICON]
        v[[self.at[x] for x in items(words) & self.at.keys()]] = 1
        v[-1 - len(PATTERNS) : -1] = [bool(p.search(low)) for p in PATTERNS]
        v[-1] = not v[:-1].any()
        return v


class Scorer:
    """A linear function of the items that a text has."""

    def __init__(self, weights: dict[str, float], constant: float):
        self.constant = constant
        self.words = {x: w for x, w in weights.items() if not x.endswith("-")}
        self.stems = [(k, {x[:-1]: w for x, w in weights.items() if x.endswith("-") and len(x) == k + 1}) for k in STEMS]

    def score(self, text: str) -> float:
        words = set(letters(text))
        z = self.constant + sum(self.words[w] for w in sorted(words & self.words.keys()))
        for k, weights in self.stems:
            z += sum(weights[w] for w in sorted({w[:k] for w in words if len(w) > k} & weights.keys()))
        return 1 / (1 + np.exp(-min(30.0, max(-30.0, z))))


class LabelModel:
    """Rates at which each voter fires in toxic and other texts, by EM.

    The given label is a voter like the others: how often it is right is
    estimated, in either class. Voters that agree beyond what the classes
    explain share one vote: each round works out the correlations of what the
    present rates leave unexplained, and weighs the voters by them.
    """

    def __init__(self, votes: np.ndarray, labels: np.ndarray, rounds: int = 30, trust: float = 0.95):
        """``labels``: 1, 0 or -1 (unknown); EM begins with ``trust`` in a known one."""
        n, k = votes.shape
        known = labels >= 0
        q = np.where(labels == 1, trust, np.where(labels == 0, 1 - trust, np.where(votes[:, : k - 1].any(axis=1), 0.6, 0.03)))
        for _ in range(rounds):
            self.prior = float(np.clip(q.mean(), 0.005, 0.5))
            self.rates = np.stack([(w @ votes + 0.1) / (w.sum() + 10) for w in (1 - q, q)])
            self.said = [float(np.clip(((w * (labels == 1)).sum() + 10 * p) / ((w * known).sum() + 10), 0.01, 0.99)) for w, p in ((1 - q, 1 - trust), (q, trust))]
            rest = votes - (q[:, None] * self.rates[1] + (1 - q)[:, None] * self.rates[0])
            size = np.sqrt((rest**2).sum(axis=0)) + 1e-9
            self.correlation = (rest.T @ rest) / np.outer(size, size)
            again = np.clip(np.abs(self.correlation) - np.eye(k), 0, None)
            self.share = 1 / (1 + np.where(again > 0.3, again, 0).sum(axis=1))
            q = self.posterior(votes, labels)
        self.labels = q

    def posterior(self, votes: np.ndarray, labels: np.ndarray | None = None) -> np.ndarray:
        """How likely each text is toxic, by its votes and, if given, its label."""
        r = np.clip(self.rates, 1e-4, 1 - 1e-4)
        fires, silent = np.log(r[1] / r[0]), np.log((1 - r[1]) / (1 - r[0]))
        score = np.log(self.prior / (1 - self.prior)) + (votes * fires + (1 - votes) * silent) @ self.share
        if labels is not None:
            yes, no = np.log(self.said[1] / self.said[0]), np.log((1 - self.said[1]) / (1 - self.said[0]))
            score = score + np.where(labels == 1, yes, np.where(labels == 0, no, 0))
        return 1 / (1 + np.exp(-np.clip(score, -30, 30)))


def linear_fit(row: np.ndarray, item: np.ndarray, y: np.ndarray, n_items: int, ridge: float = 1e-4, rounds: int = 120) -> np.ndarray:
    """Logistic regression on soft labels ``y`` over the pairs (row, item) of
    items present, by gradient steps of decreasing size; the last weight is
    the constant."""
    w, m, v = (np.zeros(n_items + 1) for _ in range(3))
    w[-1] = np.log(y.mean() / (1 - y.mean()))
    for t in range(1, rounds + 1):
        z = np.bincount(row, w[item], len(y)) + w[-1]
        off = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - y
        g = np.append(np.bincount(item, off[row], n_items) / len(y) + ridge * w[:-1], off.mean())
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w -= 0.3 * 0.97**t * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return w


def fit(docs: DataFrame, labels: DataFrame, most: int = SAMPLE_ROWS) -> Scorer:
    """The scorer learned from rows that are not held out and have a label,
    ``most`` of them (about), whole texts of them. Of several labels of an id the
    highest counts. Without labelled rows, or with one label only, all texts
    score alike."""
    rows = docs.where("text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.where(~held_out(3, 1))
    marks = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("y"))
    marks = sampled(marks.where(~held_out(3, 1)).withColumn("all", F.lit(0)), most, "all", "toxic", "doc_id").select("doc_id", "y")
    known = stored(rows.join(marks, "doc_id").withColumn("all", F.lit(0)), "labelled")
    known = sampled(known, most, "all", "rows", "doc_id", "text")  # where ids repeat
    known = known.select("text", "y", F.pmod(F.xxhash64("text"), F.lit(2)).cast("int").alias("fold"))

    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text, y, fold in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                out = sorted(items(set(letters(text))))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(out, pa.string()), pa.array(np.full(len(out), y, np.int32)), pa.array(np.full(len(out), fold, np.int32))],
                    names=["item", "y", "fold"],
                )

    # of both folds together (2) and of each alone: a text's voters are learned from the other fold
    sums = {r["fold"]: (r["n"], r["pos"]) for r in known.groupBy("fold").agg(F.count("*").alias("n"), F.sum("y").alias("pos")).collect()}
    sums[2] = tuple(map(sum, zip(*sums.values(), strict=True))) if sums else (0, 0)
    share = {f: pos / max(1, n) for f, (n, pos) in sums.items()}
    if not 0 < share[2] < 1:
        return Scorer({}, 4.0 if share[2] else -4.0)
    each = [F.sum(F.when(F.col("fold") == f, x).otherwise(0)).alias(f"{a}{f}") for f in (0, 1) for a, x in (("n", F.lit(1)), ("pos", F.col("y")))]
    counts = known.mapInArrow(seen, "item string, y int, fold int").groupBy("item").agg(*each)
    counts = counts.withColumns({"n2": F.col("n0") + F.col("n1"), "pos2": F.col("pos0") + F.col("pos1")})
    for f in (0, 1, 2):
        spread = share.get(f, 0) * (1 - share.get(f, 0))
        far = (F.col(f"pos{f}") - F.col(f"n{f}") * share.get(f, 0)) / F.sqrt(F.col(f"n{f}") * spread)
        counts = counts.withColumn(f"far{f}", F.when(F.col(f"n{f}") >= LEAST, far if spread else F.lit(0.0)).otherwise(0.0))
    found = counts.where(F.greatest(*[F.abs(f"far{f}") for f in (0, 1, 2)]) >= FAR).orderBy("item").collect()
    names = [r["item"] for r in found if abs(r["far2"]) >= FAR]
    place, voters = {x: i for i, x in enumerate(names)}, [Voters([r["item"] for r in found if r[f"far{1 - f}"] >= FAR]) for f in (0, 1)]

    def looked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(0).to_pylist()
            votes = [voters[f].votes(t).tobytes() for t, f in zip(texts, batch.column(2).to_pylist(), strict=True)]
            own = [sorted(place[x] for x in items(set(letters(t))) & place.keys()) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [pa.array(votes, pa.binary()), batch.column(1), pa.array(own, pa.list_(pa.int32()))], names=["v", "y", "items"]
            )

    got = known.mapInArrow(looked, "v binary, y int, items array<int>").orderBy("v", "y", "items").collect()
    votes = np.frombuffer(b"".join(bytes(r["v"]) for r in got), np.int8).reshape(-1, voters[0].n).astype(float)
    posterior = LabelModel(votes, np.array([r["y"] for r in got])).labels
    row = np.repeat(np.arange(len(got)), [len(r["items"]) for r in got])
    item = np.array([x for r in got for x in r["items"]], np.int64)
    w = linear_fit(row, item, posterior, len(names))
    return Scorer(dict(zip(names, w[:-1].tolist())), float(w[-1]))


def toxic_scores(docs: DataFrame, fitted: Scorer, threshold: float = 0.7) -> DataFrame:
    """(doc_id, score, predicted) per row of ``docs``, from its text alone.

    Null texts count as empty; empty texts get the score of no words. Very
    long texts count whole. Repeated rows come out alike; null ids stay; empty
    input gives an empty result; other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(fitted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                score = [scorer.score(t or "") for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(score, pa.float64())], names=["doc_id", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = rows.mapInArrow(run, "doc_id long, score double")
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = toxic_scores(docs, fit(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", held_out(3, 1).alias("held_out"), "score", "predicted")


QUERIES = {"op8_toxicity": op8}
