"""Embedding near-duplicates by a robust-pruned flat graph (operator 10).

Equal vectors are one class. Classes are dealt to overlapping cluster shards:
to each centre that is nearly as near as the nearest. A shard that is still
large is dealt again, to centres of its own, level by level. Every shard builds a
robust-pruned neighbour graph, and the adjacency lists of all shards are
united. In each shard, over the united lists, a greedy search from medoids
looks for the partners of every class and expands all nodes in range; the
neighbours outside the shard are fetched by a join and searched too. Every
pair found is verified in double precision. A pair whose ends share a shard
counts in the first shard they share, any other as a row of its own, so each
counts once. Tasks return sums and a spanning forest. The recall is audited
against exact cosines; where it is low, shards overlap more. A shard above the
block size that no level divides (it is one dense cluster) is dealt as pairs of
blocks, so none outgrows a task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import connected_components, discard, stored, table
from .langid import chance
from .simhash import Forest

#: rows of a shard (about), of a block; centres; how much less near a further centre may be, and how many there may be
SHARD_ROWS, BLOCK_ROWS, CENTRES, SLACK, OVERLAP = 1000, 1500, 4096, 0.1, 4
#: rows above which a shard is dealt again, centres that it gets at most, levels of such deals: so the
#: number of shards does not end where that of the first centres does
SPLIT_ROWS, SUB_CENTRES, LEVELS = 12_000, 256, 3
#: links a node keeps in a shard, candidates for them, links to far nodes, expansions before the range, medoids;
#: links of this similarity or more lead out of a shard: longer ones cannot end at a partner
DEGREE, CANDIDATES, FAR, STEPS, MEDOIDS, ALPHA, OUT = 16, 32, 4, 4, 16, 1.2, 0.8
#: queries of the audit (about), recall below which shards overlap more, and below which there is no result
AUDIT_ROWS, RECALL, LOWEST = 200, 0.99, 0.9


def unit_vectors(rows: DataFrame) -> DataFrame:
    """(vec_id, vec binary): 64-bit unit vectors, null where the vector is
    null, empty, zero, or has a null or non-finite component."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for v in batch.column(1).to_pylist():
                x = np.array(v, float) if v and None not in v else np.zeros(0)
                top = np.abs(x).max() if len(x) and np.isfinite(x).all() else 0.0
                x = x / top if top > 0 else x
                out.append((x / np.sqrt((x * x).sum())).tobytes() if top > 0 else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["vec_id", "vec"])

    cols = F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v")
    return rows.select(*cols).mapInArrow(run, "vec_id long, vec binary")


def robust_prune(x: np.ndarray, near: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """(n, degree) neighbours of every row, -1 where there are fewer: from the
    nearest candidate on, one is kept unless a kept one is ``alpha`` times
    nearer to it than the row itself is. ``near``: candidates by distance."""
    n, c = near.shape
    out = np.full((n, degree), -1, np.int64)
    for lo in range(0, n, 512):
        part = near[lo : lo + 512]
        v = x[part]
        between = 1 - np.einsum("nij,nkj->nik", v, v)
        own = 1 - np.einsum("nij,nj->ni", v, x[lo : lo + 512])
        open_, used = np.ones(part.shape, bool), np.zeros(len(part), int)
        rows = np.arange(len(part))
        for j in range(c):
            take = open_[:, j] & (used < degree)
            out[lo + rows[take], used[take]] = part[take, j]
            used += take
            open_ &= ~(take[:, None] & (alpha * between[:, j] <= own))
    return out


def greedy_search(x: np.ndarray, links: np.ndarray, queries: int, starts: np.ndarray, low: float) -> np.ndarray:
    """Pairs (q, v) of the first ``queries`` rows and rows within similarity
    ``low`` that a walk over ``links`` from the rows ``starts`` meets. Each
    query expands its ``STEPS`` best rows one by one, then itself and every
    row in range."""
    n = len(x)
    seen = np.zeros((queries, n), bool)
    everyone = np.arange(queries)
    near = x[:queries] @ x[starts].T
    seen[:, starts] = True
    q0, v0 = np.nonzero(near >= low)
    # a query is a row itself: the walk may miss it, its own neighbours are looked at all the same
    hits = [np.stack([q0, starts[v0]], 1)]
    best, at = near.max(axis=1), starts[near.argmax(axis=1)]
    todo = np.concatenate([np.stack([everyone, everyone], 1), hits[0]])

    def expand(q: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The unseen neighbours of ``v`` for each query, and how near they are."""
        to = links[v]
        q = np.repeat(q, to.shape[1])[to.ravel() >= 0]
        to = to[to >= 0]
        new = ~seen[q, to]
        flat = np.unique(q[new] * n + to[new])
        q, to = flat // n, flat % n
        seen[q, to] = True
        return q, to, np.einsum("ij,ij->i", x[q], x[to])

    for _ in range(STEPS):
        q, to, s = expand(everyone, at)
        order = np.argsort(s, kind="stable")
        top = np.full(queries, -3.0, np.float32)
        where = at.copy()
        top[q[order]], where[q[order]] = s[order], to[order]  # of each query the last is the nearest
        better = top > best
        best, at = np.where(better, top, best), np.where(better, where, at)
        hits.append(np.stack([q[s >= low], to[s >= low]], 1))
        todo = np.concatenate([todo, hits[-1]])
        if not better.any():
            break
    while len(todo):
        part, todo = todo[:4096], todo[4096:]
        q, to, s = expand(part[:, 0], part[:, 1])
        hits.append(np.stack([q[s >= low], to[s >= low]], 1))
        todo = np.concatenate([todo, hits[-1]])
    return np.concatenate(hits)


def _centres(classes: DataFrame, n: int, most: int) -> np.ndarray:
    """Centres of about n / SHARD_ROWS clusters, ``CENTRES`` at most, by a few
    rounds of spherical k-means on a hash sample of 16 rows per centre, ``most``
    rows at most. No two centres are nearer to each other than 0.9, so that a
    dense cluster is not torn into many shards."""
    k = max(1, min(CENTRES, n // SHARD_ROWS))
    share = min(1.0, min(most, 16 * k) / max(n, 1))
    rows = classes.where(chance("centres", "node") < F.lit(share)).orderBy("node").select("vec").limit(2 * most).collect()
    dims: dict[int, list] = {}
    for r in rows:
        dims.setdefault(len(r["vec"]), []).append(np.frombuffer(r["vec"]))
    if not dims:
        return np.zeros((1, 1))
    return _means(np.array(max(dims.values(), key=len)), k)


def _means(x: np.ndarray, k: int) -> np.ndarray:
    """``k`` means of ``x`` at most, by spherical k-means, without those near to another."""
    c = x[np.linspace(0, len(x) - 1, min(k, len(x))).astype(int)]
    for _ in range(6):
        at = (x @ c.T).argmax(axis=1)
        sums = np.zeros_like(c)
        np.add.at(sums, at, x)
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        c = np.where(size > 1e-9, sums / np.maximum(size, 1e-9), c)
    kept: list[int] = []
    for j in range(len(c)):
        if not kept or (c[kept] @ c[j]).max() < 0.9:
            kept.append(j)
    return c[kept]


def _nearest(x: np.ndarray, c: np.ndarray, slack: float, most: int) -> list[list[int]]:
    """For each row of ``x`` the centres nearly as near as the nearest."""
    s = x @ c.T
    top = np.argsort(-s, axis=1, kind="stable")[:, :most]
    ok = np.take_along_axis(s, top, 1) >= s.max(axis=1, keepdims=True) - slack
    return [np.sort(t[o]).tolist() for t, o in zip(top, ok)]


def _split(members: DataFrame, slack: float, most: int) -> DataFrame:
    """``members`` (node, vec, copies, shards) with the rows of shards above
    ``SPLIT_ROWS`` dealt to centres fitted in that shard, up to ``LEVELS``
    times. Each fit sees a hash sample of about 16 rows a centre; the deal is
    salted, so neither grows with the shard. A shard with one centre stays."""

    def fitted(key: tuple, group: pa.Table) -> pa.Table:
        group = group.sort_by("node")
        c = _means(np.frombuffer(b"".join(group.column("vec").to_pylist())).reshape(group.num_rows, -1), group.column("k")[0].as_py())
        return pa.table({"shard": [key[0].as_py()], "parts": [group.column("parts")[0].as_py()], "n": [len(c)], "centres": [c.tobytes()]}, schema=fit_schema)

    def dealt(key: tuple, group: pa.Table, own: pa.Table) -> pa.Table:
        shard, n = key[0].as_py(), group.num_rows
        if not n or not own.num_rows:
            return pa.table({"node": group.column("node"), "shard": pa.array([shard] * n, pa.int64())})
        c = np.frombuffer(own.column("centres")[0].as_py()).reshape(own.column("n")[0].as_py(), -1)
        node, to = [], []
        for at in range(0, n, 1024):
            part = group.slice(at, 1024)
            x = np.frombuffer(b"".join(part.column("vec").to_pylist())).reshape(part.num_rows, -1)
            for v, near in zip(part.column("node").to_pylist(), _nearest(x, c, slack, most)):
                node += [v] * len(near)
                to += [(shard + 1) * 4096 + j for j in near]
        return pa.table({"node": pa.array(node, pa.int64()), "shard": pa.array(to, pa.int64())})

    fit_schema = pa.schema([("shard", pa.int64()), ("parts", pa.int32()), ("n", pa.int32()), ("centres", pa.binary())])
    for level in range(LEVELS):
        each = members.select("node", "vec", F.explode("shards").alias("shard"))
        large = each.groupBy("shard").agg(F.count("*").alias("size")).where((F.col("size") > SPLIT_ROWS) & (F.col("shard") >= 0))
        large = stored(large.select("shard", "size", F.ceil(F.col("size") / SPLIT_ROWS).cast("int").alias("parts")), "large")
        if large.isEmpty():
            break
        k = F.least(F.lit(SUB_CENTRES), F.floor(F.col("size") / SHARD_ROWS)).cast("int")
        picked = each.join(large, "shard").withColumn("k", k).where(chance(f"level {level}", "node") * F.col("size") < 16 * F.col("k"))
        centres = picked.groupBy("shard").applyInArrow(fitted, "shard long, parts int, n int, centres binary").where("n > 1")
        centres = stored(centres, "centres")
        if centres.isEmpty():
            break
        each = each.join(centres.select("shard", "parts"), "shard", "left")
        rows = each.where("parts is not null").withColumn("part", F.pmod(F.xxhash64(F.lit(level), "node"), F.col("parts")).cast("int"))
        own = centres.select("shard", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "n", "centres")
        moved = rows.select("shard", "part", "node", "vec").groupBy("shard", "part").cogroup(own.groupBy("shard", "part"))
        moved = moved.applyInArrow(dealt, "node long, shard long").union(each.where("parts is null").select("node", "shard"))
        of = moved.groupBy(F.col("node").alias("of")).agg(F.sort_array(F.collect_set("shard")).alias("shards"))
        members = stored(members.drop("shards").join(of, F.col("node") == F.col("of")).select("node", "vec", "copies", "shards"), "members")
    return members


def audited_recall(rows: DataFrame, out: DataFrame, low: float, n: int) -> float:
    """Share of the exact links of a hash sample of about ``AUDIT_ROWS`` rows
    (vec_id, vec) that ``out`` counts; all rows are compared, in blocks."""
    picked = rows.where("vec is not null and vec_id is not null").where(chance("audit", "vec_id") < F.lit(AUDIT_ROWS / max(1, n)))
    picked = picked.limit(4 * AUDIT_ROWS).collect()
    if not picked:
        return 1.0
    by: dict[int, list] = {}
    for i, r in enumerate(picked):
        by.setdefault(len(r["vec"]), []).append((i, np.frombuffer(r["vec"])))
    shared = rows.sparkSession.sparkContext.broadcast({k: (np.array([i for i, _ in v]), np.array([x for _, x in v])) for k, v in by.items()})

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(len(picked), np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                vecs: dict[int, list] = {}
                for v in batch.column(0)[at : at + 1024].to_pylist():
                    if v is not None and len(v) in shared.value:
                        vecs.setdefault(len(v), []).append(np.frombuffer(v))
                for k, v in vecs.items():
                    own, q = shared.value[k]
                    sums[own] += (q @ np.array(v).T >= low).sum(axis=1)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(picked))), pa.array(sums)], names=["i", "n"])

    exact = {r["i"]: r["n"] - 1 for r in rows.select("vec").mapInArrow(count, "i long, n long").groupBy("i").agg(F.sum("n").alias("n")).collect()}
    ids = rows.sparkSession.createDataFrame([(r["vec_id"], i) for i, r in enumerate(picked)], "vec_id long, i int")
    found = {r["i"]: r["n_links"] for r in out.join(ids, "vec_id").groupBy("i").agg(F.max("n_links").alias("n_links")).collect()}
    total = sum(exact.values())
    return sum(min(found[i], exact[i]) for i in found) / total if total else 1.0


def near_vectors(rows: DataFrame, low: float = 0.95, sample_rows: int = 65_536) -> DataFrame:
    """(vec_id, n_links, component_id, kept, recall) per row of ``rows``.

    n_links: other rows linked directly, at cosine ``low`` or more; equal
    vectors link. component_id: the smallest vec_id that links reach, itself
    included; kept: vec_id is component_id; recall: the share of exact links
    that the audit found. Null, empty and zero vectors and those with null or
    non-finite components link with nothing. Vectors of different lengths
    never link. Repeated rows link with each other; a null vec_id counts as a
    link and is a component_id only where there is no other. Empty input gives
    an empty result; other columns are ignored. Centres are fitted on about
    ``sample_rows`` rows at most; all rows are indexed and searched. A recall that
    stays below ``LOWEST`` is an error.
    """
    unit = stored(unit_vectors(rows), "unit")
    classes = unit.where("vec is not null").groupBy("vec").agg(F.count("*").alias("copies"), F.min("vec_id").alias("least"))
    classes = stored(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
    n = classes.count()
    centres = _centres(classes, n, sample_rows)
    named = unit.join(classes.select(F.col("vec").alias("_vec"), "node"), F.col("vec") == F.col("_vec"), "left").select("vec_id", "vec", "node")
    named = stored(named, "named")
    slack, total = SLACK, named.count()
    while True:
        out = stored(_linked(named, classes, centres, slack, low), "vectors")
        recall = audited_recall(named, out, low, total)
        if recall >= RECALL or slack > 0.5 and recall >= LOWEST:
            return out.withColumn("recall", F.lit(float(recall)))
        if slack > 0.5:
            raise RuntimeError(f"the audit found a recall of {recall:.3f}, even with shards that overlap by {slack}; {LOWEST} is asked for")
        discard(out)
        slack *= 2


def _linked(named: DataFrame, classes: DataFrame, centres: np.ndarray, slack: float, low: float) -> DataFrame:
    """(vec_id, n_links, component_id, kept) by one graph over shards that
    overlap by ``slack``."""
    plan = classes.sparkSession.sparkContext.broadcast(centres)
    most = OVERLAP if slack <= SLACK else 4 * OVERLAP

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = plan.value
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                vecs = part.column(1).to_pylist()
                near = [[-len(v)] for v in vecs]  # vectors of another length: a shard of their own
                own = [i for i, v in enumerate(vecs) if len(v) == 8 * c.shape[1]]
                if own:
                    for i, to in zip(own, _nearest(np.frombuffer(b"".join(vecs[i] for i in own)).reshape(len(own), -1), c, slack, most)):
                        near[i] = to
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(near, pa.list_(pa.int64()))], names=["node", "vec", "copies", "shards"])

    members = classes.select("node", "vec", "copies").mapInArrow(dealt, "node long, vec binary, copies long, shards array<long>")
    members = _split(stored(members, "members"), slack, most)
    each = members.withColumn("shard", F.explode("shards"))
    sizes = each.groupBy("shard").agg(F.ceil(F.count("*") / F.lit(BLOCK_ROWS)).cast("int").alias("blocks"))
    # a block pair (i, j) is a task; row of block i goes to (0..i, i) and (i, i..)
    tasks = each.join(sizes, "shard").withColumn("block", F.pmod(F.xxhash64(F.lit(7), "node"), F.col("blocks")).cast("int"))
    tasks = tasks.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    tasks = tasks.select(
        "shard", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "node", "vec", "copies", "shards"
    )
    tasks = stored(tasks, "tasks")

    def ordered(group: pa.Table, *by: str):
        group = group.sort_by([(c, "ascending") for c in (*by, "node")])
        return group, np.frombuffer(b"".join(group.column("vec").to_pylist())).reshape(group.num_rows, -1)

    def build(group: pa.Table) -> pa.Table:
        group, x = ordered(group)
        node, n = group.column("node").to_numpy(), group.num_rows
        y, c = x.astype(np.float32), min(CANDIDATES, n - 1)
        if c < 1:
            return pa.table({"node": pa.array([], pa.int64()), "to": pa.array([], pa.int64()), "near": pa.array([], pa.bool_())})
        near = np.empty((n, c), np.int64)
        for lo in range(0, n, 512):  # the exact neighbours, of which the pruned graph keeps a few
            s = y[lo : lo + 512] @ y.T
            s[np.arange(len(s)), np.arange(lo, lo + len(s))] = -3
            top = np.argpartition(-s, c - 1, axis=1)[:, :c]
            near[lo : lo + 512] = np.take_along_axis(top, np.argsort(-np.take_along_axis(s, top, 1), axis=1, kind="stable"), 1)
        links = robust_prune(y, near, DEGREE, ALPHA)
        # the pruned lists may fall apart into dense groups: a few far nodes tie them together
        far = np.random.default_rng(n).integers(0, n, (n, FAR))
        links = np.concatenate([links, np.where(far == np.arange(n)[:, None], -1, far)], axis=1)
        u, at = np.nonzero(links >= 0)
        v = links[u, at]
        return pa.table({"node": node[u], "to": node[v], "near": np.einsum("ij,ij->i", y[u], y[v]) >= OUT})

    pairs = stored(tasks.groupBy("shard", "i", "j").applyInArrow(build, "node long, to long, near boolean"), "adjacency")
    both = pairs.union(pairs.select(F.col("to").alias("node"), F.col("node").alias("to"), "near"))
    both = both.groupBy("node", "to").agg(F.bool_or("near").alias("near"))
    # of the lists of all its shards, and of links that lead back, each node keeps those to near nodes first, then some by hash
    rank = F.row_number().over(Window.partitionBy("node").orderBy(F.desc("near"), F.xxhash64("node", "to")))
    both = both.withColumn("rank", rank).where(F.col("rank") <= 6 * DEGREE)
    lists = F.collect_list("to").alias("links"), F.collect_list(F.when(F.col("near"), F.col("to"))).alias("out")
    united = stored(both.groupBy("node").agg(*lists), "graph")
    # neighbours outside the shard come with their vectors; in a task they are reached, and lead on to none
    inside = tasks.select("shard", "i", "j", "node", "block", "vec", "copies", "shards").join(united, "node", "left")
    reached = inside.select("shard", "i", "j", F.explode("out").alias("node")).distinct()
    outer = members.withColumnRenamed("shards", "own").join(reached, "node").where(~F.array_contains("own", F.col("shard")))
    outer = outer.select("shard", "i", "j", "node", F.lit(-1).alias("block"), "vec", "copies", F.col("own").alias("shards"), F.lit(None).cast("array<long>").alias("links"))
    inside = inside.select(*outer.columns)
    whole = inside.withColumn("outer", F.lit(0)).union(outer.withColumn("outer", F.lit(1)))

    def search(group: pa.Table) -> pa.Table:
        group, x = ordered(group, "outer")
        node, y = group.column("node").to_numpy(), x.astype(np.float32)
        own = int((group.column("outer").to_numpy() == 0).sum())
        place = {v: k for k, v in enumerate(node.tolist())}
        lists = [[place[v] for v in to or () if v in place and place[v] != k] for k, to in enumerate(group.column("links").to_pylist())]
        width = max(1, max(map(len, lists)))
        links = np.full((len(node), width), -1, np.int64)
        for k, to in enumerate(lists):
            links[k, : len(to)] = to
        starts = _medoids(y[:own])
        hit = greedy_search(y, links, own, starts, low - 1e-5)
        # a row is a node itself, so its own links are searched as well
        hit = hit[hit[:, 0] != hit[:, 1]]
        u, v = hit.min(axis=1), hit.max(axis=1)
        flat = np.unique(u * len(node) + v)
        u, v = flat // len(node), flat % len(node)
        ok = np.zeros(len(u), bool)
        for lo in range(0, len(u), 100_000):
            ok[lo : lo + 100_000] = np.einsum("ij,ij->i", x[u[lo : lo + 100_000]], x[v[lo : lo + 100_000]]) >= low
        u, v = u[ok], v[ok]
        lists = group.column("shards").to_pylist()
        table_ = np.full((len(node), max(map(len, lists))), -(2**62), np.int64)
        for k, s in enumerate(lists):
            table_[k, : len(s)] = s
        shard, i, j = (group.column(c)[0].as_py() for c in ("shard", "i", "j"))
        block = group.column("block").to_numpy()
        here, apart = np.zeros(len(u), bool), np.zeros(len(u), bool)
        for lo in range(0, len(u), 50_000):
            a, b = table_[u[lo : lo + 50_000]], table_[v[lo : lo + 50_000]]
            common = np.where((a[:, :, None] == b[:, None, :]) & (a[:, :, None] > -(2**62)), a[:, :, None], 2**62).min(axis=(1, 2))
            here[lo : lo + 50_000] = common == shard
            apart[lo : lo + 50_000] = common == 2**62
        here &= (i == j) | (block[u] != block[v])
        copies = group.column("copies").to_numpy()
        more = np.bincount(u[here], copies[v[here]], len(node)) + np.bincount(v[here], copies[u[here]], len(node))
        forest = Forest(len(node))
        forest.add(u[here], v[here], np.zeros(int(here.sum()), np.int64))
        # sums of rows (src = dst), a forest of the links counted here, and pairs that share no shard
        src = np.concatenate([node[:own], node[forest.u], node[u[apart]]])
        dst = np.concatenate([node[:own], node[forest.v], node[v[apart]]])
        kind = np.repeat([0, 1, 2], [own, len(forest.u), int(apart.sum())])
        sums = np.concatenate([more[:own].astype(np.int64), np.zeros(len(kind) - own, np.int64)])
        return pa.table({"src": src, "dst": dst, "kind": pa.array(kind, pa.int32()), "more": sums})

    found = stored(whole.groupBy("shard", "i", "j").applyInArrow(search, "src long, dst long, kind int, more long"), "found")
    single = found.where("kind = 2").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()
    single = single.select(F.explode(F.array(F.struct(F.col("a").alias("src"), F.col("b").alias("to")), F.struct(F.col("b").alias("src"), F.col("a").alias("to")))).alias("x"))
    single = single.select("x.*").join(classes.select(F.col("node").alias("to"), "copies"), "to").select("src", F.col("copies").alias("more"))
    more = found.where("kind = 0").select("src", "more").union(single).groupBy("src").agg(F.sum("more").alias("more"))
    roots = connected_components(found.where("kind > 0").select("src", "dst"))
    of = classes.select("node", "copies", "least").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = of.groupBy("root").agg(F.min("least").alias("component"))
    of = of.join(least, "root").join(more, F.col("src") == F.col("node"), "left").select(
        F.col("node").alias("of"), (F.col("copies") - 1 + F.coalesce("more", F.lit(0))).alias("n_links"), "component"
    )
    out = named.select("vec_id", "node").join(of, F.col("of") == F.col("node"), "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "vec_id").alias("component_id")
    )
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def _medoids(y: np.ndarray) -> np.ndarray:
    """Rows nearest to the means of a few parts of ``y``."""
    c = y[np.linspace(0, len(y) - 1, min(MEDOIDS, len(y))).astype(int)]
    for _ in range(3):
        at = (y @ c.T).argmax(axis=1)
        sums = np.zeros_like(c)
        np.add.at(sums, at, y)
        c = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-9)
    return np.unique((y @ c.T).argmax(axis=0))


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


QUERIES = {"op10_flat_graph": op10}
