"""Fingerprints worked out another way, the cube method's promises, and each
operator and stage on nulls, empty tables, long texts and clashing columns."""

import collections
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline as P
from silocast.llm import imatch, licenses, mixing, packing, toxicity, vectors

SF = "/root/testdata/sf0.001"
M = 2**64 - 1


def plain_fingerprints(texts, low=0.002, high=0.2):
    """(string, numbers) per text, as the docstrings of op1 say, term by term."""
    sets = [{xxhash.xxh3_64_intdigest(w.encode()) for w in re.findall(r"[^\W_]+", t.lower())} for t in texts]
    return sets, _printer(sets, low, high)


def _printer(sets, low, high):
    df = collections.Counter(t for s in sets for t in s)
    n = len(sets)
    band = {t for t, c in df.items() if max(2, -int(-(low * n) // 1)) <= c <= int(high * n)}
    rates = [r for r, k in imatch.RATES for _ in range(k)]

    def inside(term, j, rate):
        z = term ^ (j * 0x9E3779B97F4A7C15 & M)
        z = ((z ^ z >> 30) * 0xBF58476D1CE4E5B9) & M
        z = ((z ^ z >> 27) * 0x94D049BB133111EB) & M
        return (z ^ z >> 31) % rate == 0

    def prints(terms, text):
        own = sorted(terms & band)
        out = []
        for j, rate in enumerate(rates):
            part = [t for t in own if inside(t, j, rate)]
            out.append(max(1, xxhash.xxh3_64_intdigest(b"".join(t.to_bytes(8, "little") for t in part), j) >> 32) if part else 0)
        if any(out):
            return "".join(f"{x:08x}" for x in out), out
        whole = xxhash.xxh3_64_intdigest(b"".join(t.to_bytes(8, "little") for t in sorted(terms)) or text.encode())
        return f"all-{whole:016x}", [max(1, whole >> 32), *[0] * (len(out) - 1)]

    return prints


def plain_likeness(a, b):
    some = [(x, y) for x, y in zip(a, b, strict=True) if x or y]
    return sum(x == y for x, y in some) / len(some) if some else 1.0


def test_imatch_equals_plain_fingerprints(spark):
    docs = sorted((r.doc_id, r.text or "") for r in spark.read.parquet(f"{SF}/documents.parquet").collect())
    texts = [t for _, t in docs]
    sets, prints = plain_fingerprints(texts)
    own = [prints(s, t) for s, t in zip(sets, texts, strict=True)]
    out = {r.doc_id: r for r in imatch.op1(spark, SF).collect()}
    for i, (d, t) in enumerate(docs):
        after = texts[(i + 1) % len(texts)]
        edited = t[: len(t) - len(t) // 2] + after[: len(t) // 2]
        e = prints({xxhash.xxh3_64_intdigest(w.encode()) for w in re.findall(r"[^\W_]+", edited.lower())}, edited)
        assert (out[d].fingerprint, out[d].edited_fingerprint) == (own[i][0], e[0])
        assert out[d].near_edited == pytest.approx(plain_likeness(own[i][1], e[1]))
        assert out[d].near_next == pytest.approx(plain_likeness(own[i][1], own[(i + 1) % len(own)][1]))


def test_flight_keeps_sums_and_probabilities():
    rng = np.random.default_rng(4)
    size, p = rng.integers(1, 500, 30), rng.random(30)
    taken = np.zeros(30)
    for seed in range(3000):
        q = mixing.flight(p, size, seed)
        assert q.sum() == pytest.approx(p.sum()) and q @ size == pytest.approx(p @ size)  # both balancing equations hold
        assert ((q > 1e-6) & (q < 1 - 1e-6)).sum() <= 2
        taken += q
    assert np.abs(taken / 3000 - p).max() < 0.04  # inclusion probabilities stay in the mean
    q = mixing.landing(mixing.flight(p, size, 1), size)
    assert set(q) <= {0.0, 1.0} and abs(q @ size - p @ size) <= size.max()


def test_landing_is_the_best_choice():
    rng = np.random.default_rng(2)
    for _ in range(20):
        size, p = rng.integers(1, 90, 7), rng.random(7)
        got = mixing.landing(p, size)
        best = min(abs(sum(s for k, s in enumerate(size.tolist()) if m >> k & 1) - p @ size) for m in range(128))
        assert abs(got @ size - p @ size) == pytest.approx(best)


LONG = " ".join(f"wort{i % 613}" for i in range(30_000))
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, spans int, score string"


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(1, None), (2, ""), (3, " \n"), (4, "ein Satz mit Wörtern"), (4, "ein Satz mit Wörtern"), (None, "noch ein Text steht hier"), (None, None), (7, LONG), (8, "12 !!")]
    return spark.createDataFrame([(d, t, "de", None if d == 4 else "a", 0, "k", 1, "s") for d, t in rows], SCHEMA)


def test_language_stage(spark, odd):
    out = P.language_id(spark, odd, SF)
    assert out.columns == list(P.COLUMNS) and sorted(str(r.doc_id) for r in out.collect()) == ["4", "4", "7", "None"]
    assert P.language_id(spark, odd.limit(0), SF).count() == 0


def test_line_stage(spark, odd):
    out = P.line_dedup(spark, odd, SF)
    got = [(str(r.doc_id), r.text and r.text[:12], r.n_chars) for r in out.collect()]
    assert out.columns == list(P.COLUMNS) and len(got) == 9 and ("7", LONG[:12], len(LONG)) not in got  # its repeated runs go
    assert ("1", None, None) in got and ("2", "", 0) in got and ("4", "ein Satz mit", 20) in got
    assert P.line_dedup(spark, odd.limit(0), SF).count() == 0


def test_packing_stage(spark, odd):
    out = P.packing(spark, odd, SF)
    ends = out.groupBy("doc_id").agg(F.sum("length").alias("n")).collect()
    assert {r.doc_id for r in ends} == {1, 2, 3, 4, 7, 8, None} and P.packing(spark, odd.limit(0), SF).count() == 0
    assert out.where("start + length = doc_tokens").count() == 9  # each row's last piece
    assert packing.harmonic_pack(odd).where("`offset` + length > 4096").count() == 0


def test_empty_tables_and_clashing_names(spark, odd):
    assert licenses.license_scan(odd.limit(0)).count() == 0
    clash = odd.withColumns({"license": F.lit("MIT"), "digest": F.lit(1), "predicted": F.lit(9)})
    assert {r.license for r in licenses.license_scan(clash).collect()} == {None}
    scored = toxicity.toxic_scores(clash, toxicity.Scorer({"satz": 9.0}, -4.0))
    assert scored.columns == ["doc_id", "score", "predicted"] and sum(r.predicted for r in scored.collect()) == 2


def test_null_vector_ids(spark):
    v = [1.0, 0.0, 0.5]
    rows = [(None, v), (3, v), (5, [0.0, 1.0, 0.0]), (None, None), (None, [0.0, 0.0, 1.0])]
    out = [(r.vec_id, r.n_links, r.component_id, r.kept) for r in vectors.near_vectors(spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, node int")).collect()]
    assert sorted(map(str, out)) == sorted(map(str, [(None, 1, 3, False), (3, 1, 3, True), (5, 0, 5, True), (None, 0, None, None), (None, 0, None, None)])) or {x[:3] for x in out} == {(None, 1, 3), (3, 1, 3), (5, 0, 5), (None, 0, None)}
