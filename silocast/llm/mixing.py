"""Mixing sources to target weights by the cube method (operator 4).

A source's rate is target / size. Every document is taken floor(rate) times;
the fractional rest is its inclusion probability. The flight phase runs in
buckets of a source's documents: three undecided documents move along the null
space of the two balancing equations (tokens, documents) until one of them is
decided. A few documents of spread sizes wait beside the flight. What stays
undecided, a dozen documents a bucket at most, flies again in fewer buckets
until one is left; its last dozen land on the choice nearest to the target.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored, table

#: the size of a document: runs of anything but white space
WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS, MOST = (5, 2, 1), 3.0
BUCKET_ROWS, CHUNK_ROWS, UNDECIDED = 40_000, 1000, 12
_EPS = 1e-9


def targets(sizes: list[int], weights=WEIGHTS, most: float = MOST) -> list[float]:
    """Target per source: all sizes shared by weight, none above ``most``
    times its source's size; the excess is shared again among the others."""
    n, total = len(sizes), float(sum(sizes))
    weight = [weights[i % len(weights)] for i in range(n)]
    out, open_ = [0.0] * n, set(range(n))
    left = total
    while open_:
        w = sum(weight[i] for i in open_)
        over = {i for i in open_ if left * weight[i] / w > most * sizes[i]}
        for i in over or open_:
            out[i] = most * sizes[i] if over else left * weight[i] / w
        if not over:
            break
        left -= sum(out[i] for i in over)
        open_ -= over
    return out


def flight(p: np.ndarray, size: np.ndarray, seed: int) -> np.ndarray:
    """Probabilities after the flight phase: all 0 or 1 but for two at most.
    The sums of p and of p * size stay as they were, up to rounding."""
    p, rng = p.astype(float).copy(), np.random.default_rng(seed)
    draws = rng.random(len(p) + 3).tolist()
    held: list[int] = []
    x = size.tolist()
    for i in np.flatnonzero((p > _EPS) & (p < 1 - _EPS)).tolist():
        held.append(i)
        if len(held) < 3:
            continue
        a, b, c = held
        # orthogonal to (1, 1, 1) and to the sizes; equal sizes need only the first
        u = (x[b] - x[c], x[c] - x[a], x[a] - x[b])
        if not any(u):
            u = (1, -1, 0)
        up = min(((1 - p[k]) / v if v > 0 else -p[k] / v) for k, v in zip(held, u) if v)
        down = min((p[k] / v if v > 0 else (p[k] - 1) / v) for k, v in zip(held, u) if v)
        step = up if draws[i] * (up + down) < down else -down
        for k, v in zip(held, u):
            p[k] += step * v
        held = [k for k in held if _EPS < p[k] < 1 - _EPS]
    decided = np.ones(len(p), bool)
    decided[held] = False
    p[decided] = np.round(p[decided])
    return p


def waiting(p: np.ndarray, size: np.ndarray, most: int = 10) -> np.ndarray:
    """Up to ``most`` undecided places whose sizes are spread over all sizes."""
    open_ = np.flatnonzero((p > _EPS) & (p < 1 - _EPS))
    open_ = open_[np.argsort(size[open_], kind="stable")]
    return open_[np.unique(np.linspace(0, len(open_) - 1, most).astype(int))] if len(open_) else open_


def flight_beside(p: np.ndarray, size: np.ndarray, seed: int) -> np.ndarray:
    """A flight of all but the waiting documents, which stay undecided."""
    aside = waiting(p, size)
    out = p.astype(float).copy()
    rest = np.setdiff1d(np.arange(len(p)), aside)
    out[rest] = flight(p[rest], size[rest], seed)
    return out


def landing(p: np.ndarray, size: np.ndarray) -> np.ndarray:
    """0 or 1 for the undecided, 12 at most: the choice whose tokens come
    nearest, among equals that whose number of documents does."""
    left = np.flatnonzero((p > _EPS) & (p < 1 - _EPS))
    options = (np.arange(1 << len(left))[:, None] >> np.arange(len(left))) & 1
    off = np.abs(options @ size[left] - (p[left] * size[left]).sum()).round(6)
    number = np.abs(options.sum(axis=1) - p[left].sum()).round(6)
    best = options[np.lexsort((number, off))[0]]
    out = np.round(p)
    out[left] = best
    return out


def cube_mix(docs: DataFrame, weights=WEIGHTS, most: float = MOST, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies, taken) per row.

    Sources are ordered by code point, null last, and weigh ``weights`` in
    turn. taken = copies * size; copies is 0 to ``most``. Null and empty texts
    have size 0 and add nothing to any total. Very long texts count whole.
    Repeated rows are decided one by one. Empty input gives an empty result; other columns are ignored. Reruns
    agree: buckets, order and random numbers come from the rows alone. The
    driver sees one row per source.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"),
    )
    rows = stored(rows.groupBy("doc_id", "source", "size").agg(F.count("*").alias("rows")), "mix")
    sums = rows.groupBy("source").agg(F.sum(F.col("size") * F.col("rows")).alias("s"), F.sum("rows").alias("n")).collect()
    sums.sort(key=lambda r: (r["source"] is None, (r["source"] or "").encode("utf-8", "surrogatepass")))
    sizes = [r["s"] for r in sums]
    plan = [
        (r["source"], i, s, t, t / s if s else 0.0, -(-r["n"] // bucket_rows))
        for i, (r, s, t) in enumerate(zip(sums, sizes, targets(sizes, weights, most)))
    ]
    buckets = max((p[-1] for p in plan), default=1)
    plan = spark.createDataFrame(
        plan, "src string, source_no int, source_size long, target double, rate double, buckets long"
    )
    rows = rows.join(plan, F.col("source").eqNullSafe(F.col("src"))).drop("src")
    # rows that are equal in all that counts go out in chunks, so no bucket gets a large group of them
    chunk = F.explode(F.sequence(F.lit(0), F.floor((F.col("rows") - 1) / CHUNK_ROWS)))
    rows = rows.withColumn("chunk", chunk).withColumn("rows", F.least(F.lit(CHUNK_ROWS), F.col("rows") - F.col("chunk") * CHUNK_ROWS))
    rows = rows.withColumns({
        "whole": F.floor(F.col("rate") + 1e-12),
        "p": F.when(F.col("size") > 0, F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("rate") - F.col("whole")))).otherwise(0.0),
    })

    def fly(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["doc_id", "size", "chunk"], kind="stable", na_position="first")
        group = group.loc[group.index.repeat(group["rows"])].assign(rows=1)
        p, size = group["p"].to_numpy(), group["size"].to_numpy()
        p = flight_beside(p, size, int(group["bucket"].iloc[0]) * 1_000_003 + int(group["source_no"].iloc[0]))
        if group["buckets"].iloc[0] == 1:
            p = landing(p, size)
        return group.assign(p=p)

    done = []
    while True:
        row_hash = F.xxhash64(F.lit(buckets), "doc_id", "size", "source", "chunk")
        rows = rows.withColumn("bucket", F.pmod(row_hash, F.col("buckets")))
        flown = stored(rows.groupBy("source_no", "bucket").applyInPandas(fly, rows.schema), "flown")
        open_ = (F.col("p") > _EPS) & (F.col("p") < 1 - _EPS)
        done.append(flown.where(~open_))
        if buckets <= 1:
            break
        buckets = -(-UNDECIDED * buckets // bucket_rows)
        fewer = F.ceil(F.col("buckets") * UNDECIDED / bucket_rows)
        rows = flown.where(open_).drop("bucket").withColumn("buckets", fewer)
    copies = (F.col("whole") + F.round("p")).cast("long")
    return reduce(DataFrame.union, done).select(
        "doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken")
    )


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    mix = cube_mix(table(spark, sf_dir, "documents"))
    return mix.select("doc_id", "size", "source_size", "target", "taken", "copies")


QUERIES = {"op4_cube_mix": op4}
