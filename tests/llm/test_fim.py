"""Operator 12 against the plain definition and its SQL."""

import hashlib
import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from silocast.llm import fim

SF = "/root/testdata/sf0.01"
TOKEN = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def plain(doc_id, text):
    text = text or ""
    tokens = TOKEN.findall(text)
    h = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in range(0, 32, 8))
    n = len(tokens)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    pre, mid, suf = "".join(tokens[:a]), "".join(tokens[a:b]), "".join(tokens[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return n, "plain", None, None, text
    if h4 % 100 < 80:
        return n, "spm", len(pre), len(mid), f"<S>{suf}<P>{pre}<M>{mid}"
    return n, "psm", len(pre), len(mid), f"<P>{pre}<S>{suf}<M>{mid}"


@pytest.fixture(scope="module")
def odd():
    draw = random.Random(3)
    texts = ["", None, " ", "\n\t ", "word", " word", "word ", "a  b", "x" * 9000, " " * 9000, "é" * 3000 + " " + "ü" * 3000, "a b\x1cc \x85d\xa0e",
             "has <S> inside", "ends with <", "<S <P <M", "😀 " * 4000, "ab " * 700_000]
    shared = " ".join("".join(draw.choices("abcdeé", k=draw.randrange(1, 9))) for _ in range(900))
    for _ in range(120):
        parts = [draw.choice((shared[a : a + draw.randrange(3000)], " " * draw.randrange(80), "q" * draw.randrange(5000))) for a in draw.choices(range(4000), k=3)]
        texts.append("".join(parts))
    return [(None if i % 50 == 7 else i % 100, t) for i, t in enumerate(texts)]


def test_equals_definition(spark, odd):
    df = spark.createDataFrame([(d, t, 1, "x", "y") for d, t in odd], "doc_id long, text string, n long, form string, at string")
    out = fim.fill_in_middle(df).select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output", fim.restored().alias("back")).collect()
    got = sorted((str(r.doc_id), r.back, *r[1:6]) for r in out)
    want = sorted((str(d), t or "", *plain(d, t)) for d, t in odd)
    assert sorted(map(repr, got)) == sorted(map(repr, want))
    assert len({r.form for r in out}) == 3


def test_every_cut():
    cache = fim.Summaries(most=200)  # so small that summaries go and come back
    for text in ("one two  three\n", " lead", "x" * 5000 + " y", "tail   ", "é ü " * 900):
        tokens = fim.Tokens(text.encode(), cache)
        parts = TOKEN.findall(text)
        assert tokens.n == len(parts)
        ends = [0]
        for p in parts:
            ends.append(ends[-1] + len(p))
        assert [tokens.cut(k) for k in range(len(ends))] == ends


def test_shared_chunks_are_found():
    draw = random.Random(1)
    passage = " ".join("".join(draw.choices("abcdefgh", k=5)) for _ in range(2000)).encode()
    cache = fim.Summaries()
    fim.Tokens(passage, cache)
    before = cache.found
    fim.Tokens(b"another beginning " + passage, cache)
    assert cache.found - before > 0.9 * len(fim.borders(passage))
    assert all(0 < b - a <= fim.MOST for a, b in zip([0, *fim.borders(passage)], fim.borders(passage), strict=False))


def test_query_equals_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    out = fim.op12(spark, SF)
    assert sorted(map(repr, map(tuple, out.collect()))) == sorted(map(repr, con.execute(fim.ORACLE).fetchall()))
    assert fim.fill_in_middle(spark.read.parquet(f"{SF}/documents.parquet").where(F.lit(False))).count() == 0
