"""SimHash near-duplicates by a binary-trie self-join (operator 7).

Every text gets a fingerprint of sign bits over its word shingles. Distinct
fingerprints are keys of a binary trie. The self-join walks pairs of trie
nodes together from the root, adds up the bits in which the two paths differ
and drops a pair as soon as the sum exceeds the error budget. The top of the
trie is cut into subtrees of bounded size; each pair of subtrees within the
budget is one group of the Spark job, inside which numpy walks on over sorted
keys. A group keeps only a spanning forest of the links it finds, so a large
set of near copies never comes out as all its pairs.

With ``tables`` > 1 each table joins on its own slice of a longer fingerprint.
That keeps the budget of each trie small where the wanted similarity allows
many differing bits.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import connected_components, discard, stored, table

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SEED = 42
#: for each byte its 8 bits, spread over the 8 bytes of a word
_SPREAD = (
    np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").copy().view("<u8").reshape(256)
)


def normalized(text: str | None) -> bytes:
    """Words of ``text``, A-Z lower-cased, joined by one space."""
    return " ".join(WORDS.findall((text or "").translate(LOWER))).encode("utf-8", "surrogatepass")


def shingle_hashes(norm: bytes, k: int) -> np.ndarray:
    """XXH64 of every ``k``-word shingle, repeats included; with fewer words
    the whole sequence is the one shingle, without words there is none."""
    if not norm:
        return np.empty(0, dtype="<u8")
    gaps = np.flatnonzero(np.frombuffer(norm, dtype=np.uint8) == 32)
    n = len(gaps) + 2 - k
    if n <= 1:
        return np.array([xxhash.xxh64_intdigest(norm, SEED)], dtype="<u8")
    starts = np.concatenate([[0], gaps[: n - 1] + 1]).tolist()
    ends = np.concatenate([gaps[k - 1 :], [len(norm)]]).tolist()
    h = xxhash.xxh64_intdigest
    return np.fromiter((h(norm[a:b], SEED) for a, b in zip(starts, ends)), dtype="<u8", count=n)


def _mixed(h: np.ndarray, words: int) -> np.ndarray:
    """(n, words) hashes; the first column is ``h`` itself, the others are
    ``h`` under splitmix64 with different increments."""
    out = np.empty((len(h), words), dtype="<u8")
    out[:, 0] = h
    for j in range(1, words):
        z = h + np.uint64((j * 0x9E3779B97F4A7C15) & (2**64 - 1))
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        out[:, j] = z ^ (z >> np.uint64(31))
    return out


def sign_bits(h: np.ndarray, words: int = 1) -> np.ndarray:
    """Fingerprint of ``words`` 64-bit words: a bit is 1 if it is set in over
    half of the hashes; no hashes give zero."""
    n = len(h)
    if not n:
        return np.zeros(words, dtype="<u8")
    counts = np.zeros(words * 64, dtype=np.int64)
    for at in range(0, n, 255 * 64):
        part = _SPREAD[_mixed(h[at : at + 255 * 64], words).view(np.uint8)]
        # 255 rows at most add up in a byte without overflow
        sums = np.add.reduceat(part, np.arange(0, len(part), 255), axis=0)
        counts += sums.view(np.uint8).reshape(len(sums), -1).sum(axis=0, dtype=np.int64)
    return np.packbits(counts * 2 > n, bitorder="little").view("<u8")


def fingerprints(docs: DataFrame, k: int, words: int = 1) -> DataFrame:
    """(doc_id, text_key, sig) per row of ``docs``: text_key is XXH64 of the
    normalised text, sig the fingerprint as little-endian bytes. A null text
    counts as empty. Other columns of ``docs`` are ignored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                ids, keys, sigs = batch.column(0)[at : at + 512], [], []
                for text in batch.column(1)[at : at + 512].to_pylist():
                    norm = normalized(text)
                    keys.append(xxhash.xxh64_intdigest(norm, SEED))
                    sigs.append(sign_bits(shingle_hashes(norm, k), words).tobytes())
                keys = np.array(keys, dtype=np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array(keys), pa.array(sigs, pa.binary())], names=["doc_id", "text_key", "sig"]
                )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, text_key long, sig binary")


# ---------------------------------------------------------------- the trie


def trie_links(
    a: np.ndarray, b: np.ndarray | None, budget: int, depth: int, err: int = 0, leaf: int = 256, most: int = 1 << 15,
    start: np.ndarray | None = None,
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (i, j) of keys that differ in ``budget`` bits at most.

    ``a`` and ``b`` are sorted uint64 keys, each below one trie node at
    ``depth`` (bits from the top); ``err`` bits of those two paths differ.
    ``b`` None: pairs within ``a``, i < j. Nodes are ranges of the sorted
    keys; ``start``: walk from these pairs of nodes at ``depth``, rows of first
    and end in ``a``, first and end in ``b``, differing bits. Pairs of small
    nodes are compared key by key.
    """
    own = b is None
    b = a if own else b
    full = np.array([[0, len(a), 0, len(b), err]], dtype=np.int64) if start is None else start
    todo = [(depth, full)]
    while todo:
        d, f = todo.pop()
        while len(f):
            if len(f) > most:
                todo.append((d, f[most:]))
                f = f[:most]
            done = ((f[:, 1] - f[:, 0]) * (f[:, 3] - f[:, 2]) <= leaf) | (d >= 64)
            yield from _compare(a, b, own, f[done], budget)
            f = f[~done]
            if not len(f):
                break
            bit = np.uint64(1) << np.uint64(63 - d)
            same = (f[:, 0] == f[:, 2]) & (f[:, 1] == f[:, 3]) if own else np.zeros(len(f), bool)
            cut = []
            for keys, lo, hi in ((a, f[:, 0], f[:, 1]), (b, f[:, 2], f[:, 3])):
                head = (keys[lo] >> np.uint64(63 - d) | np.uint64(1)) << np.uint64(63 - d)
                cut.append(np.clip(np.searchsorted(keys, head), lo, hi))
            x, y, e = cut[0], cut[1], f[:, 4]
            down = [
                np.stack([f[:, 0], x, f[:, 2], y, e], 1),
                np.stack([x, f[:, 1], y, f[:, 3], e], 1),
                np.stack([f[:, 0], x, y, f[:, 3], e + 1], 1),
                np.stack([x, f[:, 1], f[:, 2], y, e + 1], 1)[~same],  # the mirror image of a node's own pair
            ]
            f = np.concatenate(down)
            f = f[(f[:, 4] <= budget) & (f[:, 1] > f[:, 0]) & (f[:, 3] > f[:, 2])]
            d += 1


def _compare(a, b, own, f, budget, most: int = 1 << 18):
    """Links among the keys of small node pairs ``f``, in bounded steps."""
    na, nb = f[:, 1] - f[:, 0], f[:, 3] - f[:, 2]
    rows_to = np.cumsum(na)
    at = 0
    while at < len(f):
        # whole node pairs while they fit, else a slice of the rows of one
        step = max(1, int(np.searchsorted(np.cumsum(na[at:] * nb[at:]), most, side="right")))
        part = f[at : at + step]
        rows = np.arange(rows_to[at + step - 1] - (rows_to[at - 1] if at else 0))
        of = np.repeat(np.arange(step), na[at : at + step])
        first = np.concatenate([[0], np.cumsum(na[at : at + step])[:-1]])
        i_all, lo_all, n_all = part[of, 0] + rows - first[of], part[of, 2], nb[at : at + step][of]
        width = max(1, most // max(1, int(n_all.max()))) if len(n_all) else 1
        for r in range(0, len(rows), width if n_all.sum() > most else max(1, len(rows))):
            s = slice(r, r + (width if n_all.sum() > most else len(rows)))
            n, lo = n_all[s], lo_all[s]
            i = np.repeat(i_all[s], n)
            j = np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)
            ok = np.bitwise_count(a[i] ^ b[j]) <= budget
            if own:
                ok &= i < j
            if ok.any():
                yield i[ok], j[ok]
        at += step


class Forest:
    """A minimum spanning forest over nodes 0..n-1, fed with links in parts."""

    def __init__(self, n: int):
        self.n = n
        self.u = self.v = self.w = np.empty(0, dtype=np.int64)

    def add(self, u: np.ndarray, v: np.ndarray, w: np.ndarray) -> None:
        u, v, w = np.concatenate([self.u, u]), np.concatenate([self.v, v]), np.concatenate([self.w, w])
        parent = np.arange(self.n)
        kept = []
        for weight in np.unique(w):
            at = np.flatnonzero(w == weight)
            while len(at):
                at = at[parent[u[at]] != parent[v[at]]]
                if not len(at):
                    break
                head, at = at[:4096], at[4096:]
                kept.append(self._joined(parent, u, v, head))
        at = np.concatenate(kept) if kept else np.empty(0, dtype=np.int64)
        self.u, self.v, self.w = u[at], v[at], w[at]

    @staticmethod
    def _joined(parent: np.ndarray, u: np.ndarray, v: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Joins the ends of links ``at``; returns those that joined two trees.
        ``parent`` points straight to roots before and after."""
        up: dict[int, int] = {}

        def root(x: int) -> int:
            while x in up:
                if up[x] in up:
                    up[x] = up[up[x]]
                x = up[x]
            return x

        took = []
        for k, p, q in zip(at.tolist(), parent[u[at]].tolist(), parent[v[at]].tolist()):
            p, q = root(p), root(q)
            if p != q:
                up[max(p, q)] = min(p, q)
                took.append(k)
        if up:
            to = np.arange(len(parent))
            for x in up:
                to[x] = root(x)
            parent[:] = to[parent]
        return np.array(took, dtype=np.int64)


#: keys of a group up to which one task walks its trie; larger groups are divided first
GROUP = 1 << 16
#: keys that a task walks at once, and the groups up to which their names are broadcast
BLOCK, FEW = 1 << 14, 100_000


def _turned(keys: DataFrame, fixed: int, part: int, turns: int) -> DataFrame:
    """Each of ``keys`` (path, key, node; a binary key is eight bytes, the
    lowest first) ``turns`` times: the first ``fixed`` bits stay, the others
    are turned by 0, 1, ... times ``part`` bits, and the path says how."""
    rest = 64 - fixed
    low = np.uint64((1 << rest) - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            path, key = batch.column(0).to_numpy(), batch.column(1)
            raw = pa.types.is_binary(key.type)
            key = np.frombuffer(b"".join(key.to_pylist()), "<u8") if raw else key.to_numpy().view(np.uint64)
            for t in range(turns):
                at, inner = np.uint64(t * part), key & low
                new = key & ~low | (inner << at | inner >> np.uint64(rest - t * part)) & low if t else key
                yield pa.RecordBatch.from_arrays([pa.array(path * turns + t), pa.array(new.view(np.int64)), batch.column(2)], names=["path", "key", "node"])

    return keys.mapInArrow(run, "path long, key long, node long")


def _walked(keys: DataFrame, depth: int, budget: int) -> DataFrame:
    """Links (src, dst, bits) among ``keys`` (path, key, node) of one path that
    are equal in their first ``depth`` bits and differ in ``budget`` bits at
    most: a task walks the tries of its groups, some of them at a time, and
    returns a minimum spanning forest of their links."""

    def links(path: np.ndarray, key: np.ndarray, node: np.ndarray) -> pa.RecordBatch:
        order = np.lexsort((node, key, path))
        path, key, node = path[order], key[order], node[order]
        forest = Forest(len(key))
        ends = np.flatnonzero(np.diff(path)) + 1
        for a, b in zip([0, *ends.tolist()], [*ends.tolist(), len(path)], strict=True):
            head = key[a:b] >> np.uint64(64 - depth)
            cut = np.concatenate([[0], np.flatnonzero(np.diff(head)) + 1, [b - a]])
            nodes = np.stack([cut[:-1], cut[1:], cut[:-1], cut[1:], np.zeros(len(cut) - 1, np.int64)], 1)
            nodes = nodes[nodes[:, 1] - nodes[:, 0] > 1]
            for u, v in trie_links(key[a:b], None, budget, depth, start=nodes):
                forest.add(u + a, v + a, np.bitwise_count(key[u + a] ^ key[v + a]).astype(np.int64))
        return pa.RecordBatch.from_arrays([pa.array(node[forest.u]), pa.array(node[forest.v]), pa.array(forest.w.astype(np.int32))], names=["src", "dst", "bits"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.empty(0, np.int64)] * 3
        for batch in batches:
            held = [np.concatenate([h, c.to_numpy()]) for h, c in zip(held, batch.columns, strict=True)]
            if len(held[0]) < BLOCK:
                continue
            head = held[1].view(np.uint64) >> np.uint64(64 - depth)
            ends = np.flatnonzero((np.diff(held[0]) != 0) | (np.diff(head) != 0))
            if len(ends):  # the last group may go on
                yield links(held[0][: ends[-1] + 1], held[1][: ends[-1] + 1].view(np.uint64), held[2][: ends[-1] + 1])
                held = [h[ends[-1] + 1 :] for h in held]
        if len(held[0]):
            yield links(held[0], held[1].view(np.uint64), held[2])

    prefix = F.shiftrightunsigned("key", 64 - depth)
    dealt = keys.select("path", "key", "node").repartition("path", prefix).sortWithinPartitions("path", "key")
    return dealt.mapInArrow(run, "src long, dst long, bits int")


def trie_join(classes: DataFrame, budget: int, most: int = GROUP) -> DataFrame:
    """Links (src, dst, bits) between ``classes`` (node long, sig of 8 bytes,
    all different) whose keys differ in ``budget`` bits at most.

    A key is dealt ``budget`` + 1 times, turned by as many parts of its bits:
    two keys within the budget are equal in one of the parts, so they meet in
    the group of that part, whose trie one task walks. A group of more than
    ``most`` keys is divided in the same way by its other bits, and so on until
    none is left; 16 bits hold no more than 65,536 keys, so that ends. Spark
    counts the groups; the driver learns only whether one is too large. Of each
    block of groups a minimum spanning forest comes back.
    """
    turns = budget + 1

    rows, fixed, out = classes.select(F.lit(0).cast("long").alias("path"), F.col("sig").alias("key"), "node"), 0, []
    while True:
        part = max(1, (64 - fixed) // turns)
        rows, fixed = _turned(rows, fixed, part, turns), fixed + part
        prefix = F.shiftrightunsigned("key", 64 - fixed).alias("p")
        large = stored(rows.groupBy("path", prefix).agg(F.count("*").alias("c")).where(F.col("c") > most).select("path", "p"), "large-groups")
        n = large.count() if 64 - fixed > 16 else 0
        if not n:
            discard(large)
            out.append(_walked(rows, fixed, budget))
            break
        large = large.withColumn("large", F.lit(True))
        marked = rows.select("*", prefix).join(F.broadcast(large) if n <= FEW else large, ["path", "p"], "left")
        marked = stored(marked, "groups")
        out.append(_walked(marked.where("large is null"), fixed, budget))
        rows = marked.where("large").select("path", "key", "node")
    return reduce(DataFrame.union, out)


# ------------------------------------------------- links by exact similarity

#: bands of least hashes: a pair of Jaccard 0.8 shares one with probability 0.999
BANDS, BAND_ROWS = 24, 6
_FACTORS = np.random.default_rng(SEED).integers(0, 2**63, (2, BANDS * BAND_ROWS), dtype=np.uint64)


def band_keys(shingles: np.ndarray) -> np.ndarray:
    """One key per band: equal where ``BAND_ROWS`` least hashes are equal."""
    least = np.full(BANDS * BAND_ROWS, 2**64 - 1, dtype="<u8")
    for at in range(0, len(shingles), 4096):
        h = shingles[at : at + 4096, None] * (_FACTORS[0] * np.uint64(2) + np.uint64(1)) + _FACTORS[1]
        least = np.minimum(least, h.min(axis=0))
    rows = least.reshape(BANDS, BAND_ROWS)
    return np.array([xxhash.xxh64_intdigest(r.tobytes(), i) for i, r in enumerate(rows)], dtype=np.uint64).view(np.int64)


def shingle_sketches(docs: DataFrame, k: int) -> DataFrame:
    """(doc_id, key, node, sig, n, bands) per row of ``docs`` (doc_id, key,
    text): of the set of distinct ``k``-word shingles a hash, the 64-bit
    fingerprint, the size and the band keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                out: list[list] = [[] for _ in range(4)]
                for text in part.column(2).to_pylist():
                    h = shingle_hashes(normalized(text), k)
                    own = np.unique(h)
                    row = xxhash.xxh3_64_intdigest(own.tobytes(), SEED) - 2**63, sign_bits(h).tobytes(), len(own), band_keys(own)
                    for c, x in zip(out, row):
                        c.append(x)
                types = (pa.int64(), pa.binary(), pa.int32(), pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), *(pa.array(c, t) for c, t in zip(out, types))],
                    names=["doc_id", "key", "node", "sig", "n", "bands"],
                )

    schema = "doc_id long, key long, node long, sig binary, n int, bands array<long>"
    return docs.select("doc_id", "key", "text").mapInArrow(run, schema)


def shingle_sets(texts: DataFrame, k: int) -> DataFrame:
    """(node, shingles) per row of ``texts`` (node, text): the sorted hashes of
    the distinct ``k``-word shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                sets = [np.unique(shingle_hashes(normalized(t), k)).view(np.int64) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sets, pa.list_(pa.int64()))], names=["node", "shingles"])

    return texts.select("node", "text").mapInArrow(run, "node long, shingles array<long>")


def similar_components(docs: DataFrame, k: int = 5, low: float = 0.8, budget: int = 2) -> DataFrame:
    """(doc_id, key, component) per row of ``docs`` (doc_id, key, text); rows
    of equal key have equal texts.

    Rows are linked if the Jaccard similarity of their sets of ``k``-word
    shingles is ``low`` or more; component is equal within a component and
    differs between two. Candidates are pairs that share a band of least hashes
    or whose fingerprints differ in ``budget`` bits at most; every link is
    verified on the sets, which are made for candidates alone. A band is first
    linked as a star around its most central member, then, where that leaves
    it in parts, around a member chosen by hash. Then its pairs that are not yet
    in one component are verified if they share one of their rarest shingles,
    as pairs of similarity ``low`` must. So a large group of near copies is
    never compared pair by pair, and no link of a band is lost. Texts without words are one component. Null ids and
    repeated rows stay.
    """
    rows = stored(shingle_sketches(docs, k), "sketches")
    classes = rows.groupBy("node").agg(F.min("key").alias("key"), *(F.first(c).alias(c) for c in ("sig", "n", "bands")))
    classes = stored(classes, "classes")
    members = classes.select("node", "n", F.explode("bands").alias("band"))
    sizes = members.groupBy("band").agg(F.count("*").alias("c")).where("c > 1")
    bands = stored(members.join(sizes, "band"), "bands")
    central = bands.groupBy("node").agg(F.sum("c").alias("weight"))
    members = stored(bands.drop("c").join(central, "node"), "members")
    made = [rows, classes, bands, members]

    def verified(pairs: DataFrame) -> DataFrame:
        pairs = stored(pairs.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct(), "pairs")
        wanted = pairs.select(F.col("src").alias("node")).union(pairs.select("dst")).distinct().join(classes.select("node", "key"), "node")
        texts = docs.select("key", "text").join(wanted, "key").dropDuplicates(["node"])
        sets = stored(shingle_sets(texts, k), "sets")
        a = sets.select(F.col("node").alias("src"), F.col("shingles").alias("a"))
        b = sets.select(F.col("node").alias("dst"), F.col("shingles").alias("b"))
        both = F.size(F.array_intersect("a", "b"))
        ok = both >= F.lit(low) * (F.size("a") + F.size("b") - both)
        links = stored(pairs.join(a, "src").join(b, "dst").where(ok).select("src", "dst"), "links")
        discard(sets)
        discard(pairs)
        made.append(links)
        return links

    def near(m, n):  # sets of other sizes cannot reach ``low``
        return F.least(m, n) >= F.lit(low) * F.greatest(m, n)

    def star(of: DataFrame, *rank) -> DataFrame:
        """Pairs of each member of a band and the band's highest by ``rank``."""
        hubs = of.groupBy("band").agg(F.max_by(F.struct("node", "n", "root"), F.struct(*rank)).alias("hub"))
        pairs = of.join(hubs, "band").where((F.col("root") != F.col("hub.root")) & near(F.col("n"), F.col("hub.n")))
        return pairs.select(F.col("node").alias("src"), F.col("hub.node").alias("dst"))

    def joined(links: DataFrame) -> tuple[DataFrame, DataFrame]:
        """The roots of ``links``, and the members of bands that have several."""
        roots = stored(connected_components(links), "roots")
        at = members.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        open_ = at.groupBy("band").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x < y").select("band")
        at = stored(at.join(open_, "band"), "open")
        made.extend([roots, at])
        return roots, at

    def overlapping(at: DataFrame) -> DataFrame:
        """Pairs of members of open bands, of different components, that can
        reach ``low``. All sets are put in one order, rarest shingles first. Of
        a set of m, o common ones are needed: then a common one is among the
        first m - o + 1. So a text of which too much is its own meets no other."""
        nodes = at.select("node", "root").distinct()
        texts = docs.select("key", "text").join(nodes.join(classes.select("node", "key"), "node"), "key").dropDuplicates(["node"])
        sets = shingle_sets(texts, k).join(nodes, "node")
        each = stored(sets.select("node", "root", F.size("shingles").alias("n"), F.explode("shingles").alias("s")), "each")
        made.append(each)
        spread = each.groupBy("s").agg(F.count("*").alias("df"), (F.min("root") < F.max("root")).alias("across"))
        order = Window.partitionBy("node").orderBy("across", "df", "s")
        first = each.join(spread, "s").withColumn("at", F.row_number().over(order))
        first = first.where(F.col("across") & (F.col("at") <= F.col("n") - F.ceil(F.lit(low) * F.col("n") - 1e-6) + 1))
        first = stored(first.select("node", "root", "n", "s", "at"), "first")
        made.append(first)
        x, y = first.alias("x"), first.alias("y")
        least = F.ceil(F.lit(low / (1 + low)) * (F.col("x.n") + F.col("y.n")) - 1e-6)
        ok = (F.col("x.s") == F.col("y.s")) & (F.col("x.root") < F.col("y.root")) & near(F.col("x.n"), F.col("y.n"))
        ok &= (F.col("x.at") <= F.col("x.n") - least + 1) & (F.col("y.at") <= F.col("y.n") - least + 1)
        return x.join(y, ok).select(F.col("x.node").alias("src"), F.col("y.node").alias("dst"))

    # the text that near copies were made from is in the largest bands: it is the centre first
    first = star(members.withColumn("root", F.col("node")), "weight", F.xxhash64("node"))
    links = verified(first.union(trie_join(classes.select("node", "sig"), budget).select("src", "dst")))
    roots, at = joined(links)
    links = links.union(verified(star(at, F.xxhash64("node"))))
    roots, at = joined(links)
    more = verified(overlapping(at))
    if not more.isEmpty():
        roots = connected_components(links.union(more))
    out = rows.select("doc_id", "key", "node").join(roots, "node", "left").select(
        "doc_id", "key", F.coalesce("root", "node").alias("component")
    )
    out = stored(out, "components")
    for df in made:
        discard(df)
    return out


# ------------------------------------------------------------ the operators


def simhash_components(docs: DataFrame, k: int = 3, budget: int = 2) -> DataFrame:
    """(doc_id, fingerprint, component_id) per row of ``docs``.

    fingerprint: 16 hex digits of the 64-bit SimHash over ``k``-word shingles.
    Rows whose fingerprints differ in ``budget`` bits at most are linked;
    component_id is the smallest doc_id of the component.

    Null and empty texts and texts without words have fingerprint zero and are
    linked like others. Repeated rows come out as often as they came in. A null
    doc_id keeps its row and never is a component_id unless the whole component
    has none (then null). Empty input gives an empty result; other columns
    are ignored.
    """
    sig = fingerprints(docs, k)
    rows = stored(sig.select("doc_id", "sig"), "simhash")
    classes = rows.groupBy("sig").agg(F.min("doc_id").alias("first")).select(_as_long("sig").alias("node"), "sig", "first")
    links = trie_join(classes, budget).select("src", "dst")
    roots = connected_components(links)
    members = classes.select("node", "first").join(roots, "node")
    least = members.groupBy("root").agg(F.min("first").alias("component_id"))
    named = members.select("node", "root").join(least, "root").select(F.col("node").alias("n"), "component_id")
    own = classes.select("node", "first").join(named, F.col("node") == F.col("n"), "left").select(
        F.col("node").alias("n"), F.coalesce("component_id", "first").alias("component_id")
    )
    out = rows.select("doc_id", _as_long("sig").alias("node"))
    return out.join(own, F.col("node") == F.col("n"), "left").select(
        "doc_id", F.lower(F.lpad(F.hex("node"), 16, "0")).alias("fingerprint"), "component_id"
    )


def _as_long(sig: str):
    """The first eight little-endian bytes of a binary column as a long."""
    digits = F.hex(F.col(sig))
    big_endian = F.concat(*[F.substring(digits, 2 * i + 1, 2) for i in range(7, -1, -1)])
    return F.conv(big_endian, 16, -10).cast("long")


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(table(spark, sf_dir, "documents"), k=3, budget=2)


QUERIES = {"op7_simhash_components": op7}
