"""Operator 13 against its SQL, plain counts and exact binomial sums."""

import math
import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from silocast.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def counts(text):
    words = WORD.findall(text or "")
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    where: dict = {}
    for i in range(len(words) - 7):
        where.setdefault(tuple(words[i : i + 8]), []).append(i)
    repeated = {p for at in where.values() if len(at) > 1 for i in at for p in range(i, i + 8)}
    symbols = sum(c in "#*$%&|<>" for c in text or "")
    return len(words), sum(map(len, words)), symbols, len(lines), len(lines) - len(set(lines)), len(repeated), len(set(words))


def test_counts(spark):
    draw = random.Random(2)
    texts = [None, "", " \n", "a b c d e f g h", "a " * 40, "one two three four five six seven eight " * 2, "x\n\nx\n x\n#x* <y>  é😀\x85",
             " ".join(draw.choices("abc", k=400)), "\n".join(draw.choices(("same line here", "other", " "), k=60)), " ".join(f"w{i}" for i in range(40_000)),
             " ".join([*(f"w{i}" for i in range(30)), *(f"w{i}" for i in range(30))]), "Wort " * 30_000]
    df = spark.createDataFrame([(i, t, 7, "x") for i, t in enumerate(texts)], "doc_id long, text string, _words long, lang string").drop("_words")
    names = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_distinct")
    out = {r.doc_id: tuple(r[c] for c in names) for r in quality.text_counts(df).collect()}
    assert out == {i: counts(t) for i, t in enumerate(texts)}


def test_binomial(spark):
    cases = [(0, 100, 0.05), (3, 150, 0.05), (19, 500, 0.05), (40, 1000, 0.05), (9, 20, 0.9), (1000, 30_000, 0.05), (60, 1000, 0.05)]
    for p in {c[2] for c in cases}:
        own = [c for c in cases if c[2] == p]
        df = spark.createDataFrame([(x, n) for x, n, _ in own], "x long, n long")
        for r in df.select("x", "n", quality.binomial_tail(F.col("x"), F.col("n"), p).alias("t")).collect():
            ln = lambda k, n=r.n: math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)
            want = sum(math.exp(ln(k) + k * math.log(p) + (r.n - k) * math.log1p(-p)) for k in range(r.x + 1))
            assert r.t == (1.0 if r.x >= r.n * p else pytest.approx(want, rel=1e-6))


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.1"])
def test_query_equals_sql(spark, sf):
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '/root/testdata/{sf}/{t}.parquet'")
    out = quality.op13(spark, f"/root/testdata/{sf}")
    got, want = sorted(map(tuple, out.collect())), sorted(con.execute(quality.ORACLES["op13_quality_rules"]).fetchall())
    assert got == want
    if sf == "sf0.1":  # certified strata: junk goes, good texts stay
        kept = dict((r[0], r[-1]) for r in got)
        labels = con.execute("SELECT doc_id, quality FROM labels").fetchall()
        good, bad = ([kept[d] for d, q in labels if q == v] for v in (1, 0))
        assert sum(good) / len(good) > 0.93 and sum(bad) / len(bad) < 0.35


def test_certified_only_with_enough_labels(spark):
    draw = random.Random(4)
    word = lambda: "".join(draw.choices("abcdefghij", k=5))
    rows, labels = [], []
    for lang, many in (("en", 700), ("de", 60), (None, 700)):
        for i in range(many):
            junk = i % 3 == 0
            words = [word() for _ in range(40)]
            rows.append((len(rows), " ".join(w + "###" for w in words) if junk else " ".join(words), lang, "x", 1))
            labels.append((len(labels), int(not junk), 9))
    rows += [(None, None, "en", "x", 1), (5, "", None, "x", 1), (7, rows[7][1], "en", "x", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, kept string, level int")
    marks = spark.createDataFrame([*labels, (1, None, 9), (None, 1, 9)], "doc_id long, quality int, stratum int")
    out = quality.quality_rules(docs, marks).collect()
    assert len(out) == len(rows)
    for r in out:
        if r.base_failed:
            assert not r.kept and r.n_words == 0
        else:
            lang = rows[r.doc_id][2]
            assert r.kept == (lang == "de" or "#" not in rows[r.doc_id][1]) and (r.level is None) == (lang == "de")
    assert quality.quality_rules(docs, marks.limit(0)).where("level is not null or kept = base_failed").count() == 0
    assert quality.quality_rules(docs.limit(0), marks).count() == 0
