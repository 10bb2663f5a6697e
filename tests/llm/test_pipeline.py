"""The pipeline's stages: what each keeps, and the columns it returns."""

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline as P

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = [docs.count()]
    for name, stage in P.STAGES[:4]:
        docs = P.stored(stage(spark, docs, SF), name)
        assert docs.columns == list(P.COLUMNS)
        kept.append(docs.count())
    assert kept[0] >= kept[1] > 0.9 * kept[0] and kept[1] > kept[2] > 0.5 * kept[1]
    out = P.STAGES[4][1](spark, docs, SF)
    assert out.select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()


def test_near_copies_go(spark):
    """Copies at 0.8 to 0.95 of planted texts go; texts at 0.7 and fresh ones stay."""
    rng = np.random.default_rng(5)
    words = lambda n: [f"w{x}" for x in rng.integers(0, 50_000, n)]
    rows, want = [], set()
    for i in range(60):
        base = words(400)
        copy, low = list(base), (0.8, 0.85, 0.9, 0.95, 0.7)[i % 5]
        n = int(396 * (1 - low) / (1 + low) / 5)  # each changed word takes five shingles
        if low == 0.7:
            n += 1
        for at in rng.choice(np.arange(5, 390, 6), n, replace=False):
            copy[at] = f"new{i}x{at}"
        rows += [(2 * i, " ".join(base)), (2 * i + 1, " ".join(copy))]
        want |= {2 * i, 2 * i + 1} if low == 0.7 else {2 * i}
    docs = spark.createDataFrame([(d, t, "en", "a", len(t)) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    assert {r.doc_id for r in P.near_dedup(spark, docs, SF).collect()} == want


def test_chain_of_near_copies(spark):
    """Texts linked only in a chain are one component, whatever heads their band."""
    words = [f"w{i}" for i in range(700)]
    rows = [(i, " ".join(words[20 * i : 20 * i + 400])) for i in range(15)]
    docs = spark.createDataFrame([(d, t, "en", "a", len(t)) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    assert [r.doc_id for r in P.near_dedup(spark, docs, SF).collect()] == [0]


def test_null_and_repeated_ids(spark):
    """Null ids take part in both stages; texts that share an id are decided apart; empty input stays empty."""
    words = [f"w{i} " * 3 for i in range(90)]
    rows = [(None, " ".join(words[:60])), (None, " ".join(words[:59])), (None, "another text"), (3, "one text here"), (3, "two texts here")]
    docs = spark.createDataFrame([(d, t, "en", "a", len(t)) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    out = P.near_dedup(spark, docs, SF).collect()
    assert sorted(str((r.doc_id, r.text[:3])) for r in out) == ["(3, 'one')", "(3, 'two')", "(None, 'ano')", "(None, 'w0 ')"]
    mixed = P.mix(spark, docs.union(docs.limit(1)), SF).collect()  # one source: each row once
    assert sorted((str(r.doc_id), r.text) for r in mixed) == sorted((str(d), t) for d, t in [*rows, rows[0]])
    shared = docs.where("doc_id = 3").union(spark.createDataFrame([(i, "b c d e", "en", "b", 7) for i in range(40, 60)], docs.schema))
    want = {}
    for r in P.cube_mix(shared.withColumn("doc_id", F.xxhash64(*P.COLUMNS, *(F.col(c).isNull() for c in P.COLUMNS)))).collect():
        want[r.source] = want.get(r.source, 0) + r.copies
    got = [r.source for r in P.mix(spark, shared, SF).collect()]
    assert {k: got.count(k) for k in want} == want
    for stage in (P.near_dedup, P.mix):
        assert stage(spark, docs.limit(0), SF).count() == 0
