"""SimHash: fingerprints, trie self-join and components against brute force."""

import numpy as np
import pytest
import xxhash

from silocast.llm import simhash as S

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, sig string"


def plain_fingerprint(text, k=3):
    words = S.WORDS.findall((text or "").translate(S.LOWER))
    if not words:
        return 0
    parts = [" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(p.encode(), seed=42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(rows, budget=2):
    fps = [plain_fingerprint(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= budget:
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted((str(d), f"{f:016x}", str(least.get(find(i)))) for i, ((d, _), f) in enumerate(zip(rows, fps)))


def got(df):
    return sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in df.collect())


def test_query_against_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert got(S.op7(spark, SF)) == plain_components(rows)


def test_nulls_ties_long_texts_and_extra_columns(spark):
    long = " ".join(f"w{i % 977}" for i in range(60_000))
    rows = [
        (1, None), (2, ""), (3, " \n\t"), (4, "One"), (5, "one"), (5, "one"), (None, "a b c d"), (9, "a b c d"),
        (None, "lonely words stand here"), (7, long), (8, long + " end"), (6, "É é x"), (10, "a b c d e"),
    ]
    df = spark.createDataFrame([(d, t, "en", "x") for d, t in rows], SCHEMA)
    assert got(S.simhash_components(df)) == plain_components(rows)
    assert S.simhash_components(df.limit(0)).collect() == []


@pytest.mark.parametrize("budget, most", [(2, 16), (2, 1 << 16), (3, 150), (0, 40), (1, 4)])
def test_trie_join_finds_every_link(spark, budget, most):
    rng = np.random.default_rng(7)
    base = rng.integers(0, 2**63, 40, dtype=np.uint64)
    keys = np.concatenate([base, *[base ^ (np.uint64(1) << rng.integers(0, 64, 40, dtype=np.uint64)) for _ in range(8)]])
    keys = np.unique(np.concatenate([keys, np.arange(50, dtype=np.uint64), np.arange(50, dtype=np.uint64) << np.uint64(57)]))
    rows = [(i, k.tobytes()) for i, k in enumerate(keys.astype("<u8"))]
    classes = spark.createDataFrame(rows, "node long, sig binary").repartition(3)
    links = S.trie_join(classes, budget, most=most)
    bad = [r for r in links.collect() if int(keys[r.src] ^ keys[r.dst]).bit_count() != r.bits or r.bits > budget]
    assert not bad
    root = {}
    for r in S.connected_components(links.select("src", "dst")).collect():
        root[r.node] = r.root
    want = list(range(len(keys)))
    for i in range(len(keys)):
        for j in range(i):
            if int(keys[i] ^ keys[j]).bit_count() <= budget:
                a, b = want[i], want[j]
                want = [min(a, b) if x in (a, b) else x for x in want]
    assert [root.get(i, i) for i in range(len(keys))] == want


def test_links_of_a_large_near_copy_group_stay_a_forest(spark):
    keys = np.array([1 << i | 1 << j for i in range(64) for j in range(i)], dtype="<u8")
    classes = spark.createDataFrame([(i, k.tobytes()) for i, k in enumerate(keys)], "node long, sig binary")
    assert S.trie_join(classes, 2).count() <= len(keys) * 3
    assert S.trie_join(classes, 2, most=64).count() <= len(keys) * 40


def test_driver_learns_no_keys(spark):
    """140,000 keys, of which many share a part: what reaches the driver stays small."""
    rng = np.random.default_rng(1)
    keys = np.unique(np.concatenate([rng.integers(0, 2**63, 90_000, dtype=np.uint64), rng.integers(0, 2**40, 50_000, dtype=np.uint64)]))
    path = S.stored(spark.createDataFrame([(i, k.tobytes()) for i, k in enumerate(keys.astype("<u8"))], "node long, sig binary"), "keys")
    before, seen = type(path).collect, []
    type(path).collect = lambda self: seen.append(out := before(self)) or out
    try:
        links = S.trie_join(path, 2, most=16).count()
    finally:
        type(path).collect = before
    assert links >= 0 and sum(map(len, seen)) < 100


def test_open_bands_against_brute_force(spark):
    """Copies with few to many changed words: bands stay open after both stars,
    and a link away from every star's centre must still be found."""
    rng = np.random.default_rng(3)
    base, other = ([f"{c}{i}" for i in range(130)] for c in "wv")
    texts = []
    for i in range(140):
        words = list(base)
        for at in rng.choice(130, i % 12, replace=False):
            words[at] = f"x{i}-{at}"
        texts.append(" ".join(words))
    for i in range(4):  # two pairs that are near each other alone, and far from the rest
        words = base[:70] + [f"{w}.{i // 2}" for w in base[70:]]
        words[30 + i] = f"y{i}"
        texts.append(" ".join(words))
    texts += [" ".join(other), " ".join(other[:-3]), "", "", "w1 w2"]
    rows = [(i, i, t) for i, t in enumerate(texts)]
    sets = [set(S.shingle_hashes(S.normalized(t), 5).tolist()) for t in texts]
    want = list(range(len(texts)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a == b or len(a & b) >= 0.8 * len(a | b):
                x, y = want[i], want[j]
                want = [min(x, y) if w in (x, y) else w for w in want]
    out = S.similar_components(spark.createDataFrame(rows, "doc_id long, key long, text string"), 5, 0.8).collect()
    first = {}
    for r in sorted(out, key=lambda r: r.doc_id):
        first.setdefault(r.component, r.doc_id)
    assert [first[r.component] for r in sorted(out, key=lambda r: r.doc_id)] == want
    assert len(set(want)) > 20 and want.count(want[0]) > 20
