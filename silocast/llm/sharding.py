"""Shards of near-equal bytes by minimax contiguous partition (operator 2).

Atomic groups (equal texts) are ordered by size, largest first, then digest.
In that order a table of (range of sizes, number of groups, bytes) is all that
the search begins with: ranges are 1/256 of a size wide, so there are some
thousands whatever the table holds. The smallest feasible capacity is found by
binary search with a greedy check. Ranges into which a cut of that search fell
are then read size by size and the search is run again, until it has met none
that is not read: then its cuts are exact. The groups at which the shards
begin are looked up, and every row finds its shard by comparing its group with
these.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ranked, stored, table


class Runs:
    """Ordered groups as runs, with prefix sums. A run holds groups of one size,
    or a range of sizes of which ``sums`` gives the bytes and ``least`` the
    smallest; ``sizes`` are the largest. Inside a range the sums are estimated
    by its mean, and the run is noted in ``open``."""

    def __init__(self, sizes: list[int], counts: list[int], sums: list[int] | None = None, least: list[int] | None = None):
        self.size, self.count = np.array(sizes, np.int64), np.array(counts, np.int64)
        sums = self.size * self.count if sums is None else np.array(sums, np.int64)
        self.range = np.zeros(len(sizes), bool) if least is None else np.array(least, np.int64) < self.size
        self.ends = np.concatenate([[0], np.cumsum(self.count)])
        self.bytes = np.concatenate([[0], np.cumsum(sums)])
        self.n, self.total = int(self.ends[-1]), int(self.bytes[-1])
        self.open: set[int] = set()

    def run_of(self, group: int) -> int:
        return int(np.searchsorted(self.ends, group, side="right")) - 1

    def _estimate(self, i: int) -> int:
        """The size of a group of run ``i``."""
        if self.range[i]:
            self.open.add(i)
            return int(self.bytes[i + 1] - self.bytes[i]) // int(self.count[i])
        return int(self.size[i])

    def before(self, group: int) -> int:
        """Bytes of all groups before ``group``."""
        if group >= self.n:
            return self.total
        i = self.run_of(group)
        inside = group - int(self.ends[i])
        return int(self.bytes[i]) + (inside * self._estimate(i) if inside else 0)

    def within(self, size: int) -> int:
        """The most groups that ``size`` bytes hold, from the first on."""
        if size >= self.total:
            return self.n
        i = int(np.searchsorted(self.bytes, size, side="right")) - 1
        left = size - int(self.bytes[i])
        return int(self.ends[i]) + (min(left // self._estimate(i), int(self.count[i]) - 1) if left else 0)


def shard_starts(runs: Runs, shards: int) -> list[int]:
    """The first group of shard 1, 2, ... A group above the even share of what
    is left has a shard to itself; the rest is cut at the smallest capacity,
    each cut as near to the even share as that capacity allows."""
    starts, at = [], 0
    while len(starts) < shards - 1 and at < runs.n:
        left = shards - len(starts)
        if runs.before(at + 1) - runs.before(at) < (runs.total - runs.before(at)) / left:
            break
        at += 1
        starts.append(at)
    left = shards - len(starts)
    base = runs.before(at)
    rest = runs.total - base

    def fits(capacity: int) -> bool:
        g = at
        for _ in range(left):
            g = runs.within(runs.before(g) + capacity)
        return g >= runs.n

    low, high = -(-rest // left), rest
    while low < high:
        mid = (low + high) // 2
        low, high = (low, mid) if fits(mid) else (mid + 1, high)
    latest = [runs.n]  # from the end: where a shard may begin at the earliest
    for _ in range(left - 1):
        need = runs.before(latest[-1]) - low
        g = runs.within(need) if need > 0 else 0
        latest.append(g if need <= 0 or runs.before(g) == need else g + 1)
    latest.reverse()
    g = at
    for k in range(1, left):
        share = runs.before(g) + (runs.total - runs.before(g)) // (left - k + 1)
        cut = runs.within(share)
        if cut < runs.n and runs.before(cut + 1) - share < share - runs.before(cut):
            cut += 1
        g = max(g, latest[k - 1], min(cut, runs.within(runs.before(g) + low)))
        starts.append(g)
    return starts


def size_range(size: str) -> Column:
    """The smallest size of the range that ``size`` is in: its nine leading bits."""
    low = F.greatest(F.length(F.bin(size)) - 9, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", F.col(size), low), low)


def exact_starts(groups: DataFrame, shards: int) -> tuple[Runs, list[int]]:
    """The runs of ``groups`` (group_size, range) and the first groups of shard
    1, 2, ... Ranges are read size by size only where the search meets them."""

    def runs_of(rows: DataFrame, *by: str) -> list:
        found = F.max("group_size"), F.count("*"), F.sum("group_size"), F.min("group_size"), F.first("range")
        return [tuple(r)[len(by) :] for r in rows.groupBy(*by).agg(*found).collect()]

    known = sorted(runs_of(groups, "range"), reverse=True)
    while True:
        runs = Runs(*([r[j] for r in known] for j in range(4)))
        starts = shard_starts(runs, shards)
        if not runs.open:
            return runs, starts
        wanted = [known[i][4] for i in sorted(runs.open)]
        known = [r for i, r in enumerate(known) if i not in runs.open]
        known = sorted(known + runs_of(groups.where(F.col("range").isin(wanted)), "range", "group_size"), reverse=True)


def minimax_shards(docs: DataFrame, shards: int = 16) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) per row.

    size: UTF-8 bytes of the text plus 1; null and empty texts have size 1 and
    are two groups. Equal texts share a shard. law is ``bytes``, grown_shard
    null. Repeated rows are rows of their own; null ids stay. A shard may be
    empty when there are fewer groups than shards. Empty input gives an empty
    result; other columns are ignored.
    """
    text = F.col("text").cast("string")
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.coalesce(F.crc32(text.cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
        F.coalesce(F.unhex(F.md5(text.cast("binary"))), F.lit(b"")).alias("digest"),
    )
    rows = stored(rows, "sizes")
    groups = stored(rows.groupBy("digest").agg(F.sum("size").alias("group_size")), "groups")
    runs, starts = exact_starts(groups.select("group_size", size_range("group_size").alias("range")), shards)
    wanted: dict[int, set[int]] = {}
    for g in starts:
        if g < runs.n and (i := runs.run_of(g)) is not None and g > runs.ends[i]:
            wanted.setdefault(int(runs.size[i]), set()).add(g - int(runs.ends[i]))
    found = {}
    if wanted:
        cut = groups.where(F.col("group_size").isin(list(wanted)))
        cut = cut.repartitionByRange("group_size", "digest").sortWithinPartitions("group_size", "digest")
        hit = F.lit(False)
        for size, ranks in wanted.items():
            hit = hit | ((F.col("group_size") == size) & F.col("rank").isin(list(ranks)))
        for r in ranked(cut, "group_size", "cut").where(hit).collect():
            found[r.group_size, r["rank"]] = bytes(r.digest)
    shard = F.lit(0)
    for g in starts:
        if g < runs.n:
            i = runs.run_of(g)
            size = int(runs.size[i])
            first = found.get((size, g - int(runs.ends[i])), b"")
            past = (F.col("group_size") < size) | ((F.col("group_size") == size) & (F.col("digest") >= F.lit(first)))
            shard = shard + past.cast("int")
    placed = rows.join(groups, "digest").select("doc_id", "size", "text_crc32", shard.cast("int").alias("shard"))
    return ranked(placed, "shard", "placed").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("rank").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minimax_shards(table(spark, sf_dir, "documents"))


QUERIES = {"op2_minimax_shards": op2}
