"""Each operator against brute force or its contract; nulls, ties, empties."""

import collections
import re
import textwrap
import zlib

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from silocast.llm import imatch, langid, licenses, linededup, mixing, packing, sharding, toxicity, vectors

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, shard int"
LONG = " ".join(f"wort{i % 613}" for i in range(30_000))


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(1, None), (2, ""), (3, " \n"), (4, "one two three four five six\nrest"), (5, "one two three four five six"),
            (5, "one two three four five six"), (None, "null id here"), (7, LONG), (8, "12 34 !!"), (9, LONG)]
    return spark.createDataFrame([(d, t, "en", None if d == 4 else "a", 0, "x", 3) for d, t in rows], SCHEMA)


def test_imatch(spark, odd):
    docs = sorted((r.doc_id, r.text or "") for r in spark.read.parquet(f"{SF}/documents.parquet").collect())
    out = {r.doc_id: r for r in imatch.op1(spark, SF).collect()}
    assert len(out) == len(docs)
    import hashlib

    for (d, t), (_, after) in zip(docs, docs[1:] + docs[:1]):
        half = len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        assert out[d].n_chars == len(t) and out[d].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= out[d].near_next <= 1 and 0 <= out[d].near_edited <= 1
    same = collections.defaultdict(set)
    for d, t in docs:
        same[t].add(out[d].fingerprint)
    assert all(len(v) == 1 for v in same.values())
    assert imatch.edited_pairs(odd).count() == 10
    assert imatch.edited_pairs(odd.limit(0)).count() == 0


def test_sharding(spark, odd):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for out, n in ((sharding.op2(spark, SF).collect(), len(docs)), (sharding.minimax_shards(odd, 4).collect(), 10)):
        assert len(out) == n
        slots = collections.defaultdict(list)
        for r in out:
            slots[r.shard].append(r.slot)
        assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    where = collections.defaultdict(set)
    for r in sharding.op2(spark, SF).collect():
        where[docs[r.doc_id]].add(r.shard)
        assert r.text_crc32 == zlib.crc32((docs[r.doc_id] or "").encode())
    assert all(len(v) == 1 for v in where.values())
    assert sharding.minimax_shards(odd.limit(0)).count() == 0


def test_smallest_capacity_by_brute_force():
    rng = np.random.default_rng(1)
    for _ in range(30):
        sizes = sorted(rng.integers(1, 30, 12).tolist(), reverse=True)
        values = sorted(set(sizes), reverse=True)
        runs = sharding.Runs(values, [sizes.count(v) for v in values])
        cuts = [0, *sharding.shard_starts(runs, 3), 12]
        assert cuts == sorted(cuts)
        if sizes[0] < sum(sizes) / 3:
            got = max(sum(sizes[a:b]) for a, b in zip(cuts, cuts[1:]))
            assert got == min(max(sum(sizes[:a]), sum(sizes[a:b]), sum(sizes[b:])) for a in range(13) for b in range(a, 13))


@pytest.mark.parametrize("seed", range(3))
def test_ranges_of_sizes_give_the_same_cuts(spark, seed):
    """Sizes read range by range against all sizes at once."""
    rng = np.random.default_rng(seed)
    sizes = np.concatenate([rng.lognormal(7, 1.5, 3000).astype(int) + 1, [1] * 40, rng.integers(10**5, 10**6, 5 * seed)]).tolist()
    groups = spark.createDataFrame([(int(x),) for x in sizes], "group_size long")
    groups = groups.withColumn("range", sharding.size_range("group_size"))
    assert all(r["range"] <= r.group_size < r["range"] * 129 // 128 + 1 for r in groups.collect())
    all_sizes = sorted(collections.Counter(sizes).items(), reverse=True)
    whole = sharding.Runs([s for s, _ in all_sizes], [c for _, c in all_sizes])
    for shards in (1, 7, 16):
        runs, starts = sharding.exact_starts(groups, shards)
        assert starts == sharding.shard_starts(whole, shards)
        assert [runs.before(g) for g in starts] == [whole.before(g) for g in starts] and len(runs.size) <= len(whole.size)


def test_plain_words_go_to_the_model():
    """Lower-case letters and marks after them take the short way, with the ids of the long one."""
    words = packing.WordIds(packing.public_tokenizers.path("word_bpe_49k.json"))
    tok, seen = words.tok, []
    words._encoded = lambda rest: seen.extend(rest) or [tok.encode(w, add_special_tokens=False).ids for w in rest]
    text = "The übergrößen, élève### of ªº niño's a.b x2 <|endoftext|> word<|endoftext|> é<| ĳsƀ. ſt. \u0301e tİ. \u0301\U0001f600"
    assert next(words.texts([text])).tolist() == [*tok.encode(text, add_special_tokens=False).ids, 2]
    assert not {"übergrößen,", "élève###", "of", "ªº", "é<|", "ĳsƀ", "ĳsƀ."} & set(seen) and {"niño's", "a.b", "<|endoftext|>"} <= set(seen)


def test_packing_round_trip(spark, odd):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(packing.public_tokenizers.path("word_bpe_49k.json"))
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    pieces, bins = collections.defaultdict(list), collections.defaultdict(list)
    for r in packing.op3(spark, SF).collect():
        pieces[r.doc_id].append(r)
        bins[r.sequence_id].append(r)
    for d, t in texts.items():
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        at = 0
        for r in sorted(pieces[d], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    for rows in bins.values():
        at = 0
        for r in sorted(rows, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 4096
    assert sum(r.length for v in bins.values() for r in v) > 0.9 * 4096 * len(bins)
    words = packing.WordIds(packing.public_tokenizers.path("word_bpe_49k.json"), most=5)
    odd_texts = ["", " ", "a  b\n\nc\td\x1ce f\x1c. .\x1c. x", "I'll can't 'sX ' s", "é e\u0301 E\u0301. x\u00a0a b\u3000c d\x85e", "a., b,. c.. d_. e_, ½. x’. y",
                 "foo<|endoftext|>bar <|startoftext|> <|ENDOFTEXT|> A.", "ΑΣ Σ ΣΑΣ. Ab", "İ İ ẞ Ă, b", "一二三。" * 50, "\r\n x\x0b\x0cy "]
    for _ in range(2):
        for text in odd_texts:
            want = [*tok.encode(text, add_special_tokens=False).ids, 2]
            assert next(words.texts([text])).tolist() == want, repr(text)
    assert packing.harmonic_pack(odd).select("doc_id").distinct().count() == 9
    assert packing.harmonic_pack(odd.limit(0)).count() == 0


def test_mixing(spark, odd):
    out = mixing.op4(spark, SF).collect()
    assert sorted(out) == sorted(mixing.op4(spark, SF).collect())
    mix = mixing.cube_mix(mixing.table(spark, SF, "documents")).select("source", "target").distinct().collect()
    assert sum(r.target for r in mix) == pytest.approx(sum(r["size"] for r in out))
    assert all(0 <= r.taken <= 3 * r["size"] for r in out)
    by = collections.defaultdict(int)
    for r in out:
        by[r.target, r.source_size] += r.taken
    assert all(abs(v - t) <= max(0.05 * t, 50) for (t, _), v in by.items())
    ties = spark.createDataFrame([(None, "one two three", "a")] * 2500 + [(i, "w " * (i % 50), "bc"[i % 2]) for i in range(500)], "doc_id long, text string, source string")
    small = mixing.cube_mix(ties, bucket_rows=60)  # flies three times
    assert sorted(map(str, small.collect())) == sorted(map(str, mixing.cube_mix(ties.repartition(5), bucket_rows=60).collect()))
    sums = small.groupBy("source").agg(F.sum("taken").alias("t"), F.first("target").alias("target"), F.count("*").alias("n")).collect()
    assert sum(r.n for r in sums) == 3000 and all(abs(r.t - r.target) <= 0.02 * r.target + 50 for r in sums)
    assert mixing.cube_mix(odd).count() == 10 and mixing.cube_mix(odd.limit(0)).count() == 0
    assert mixing.targets([1, 100, 100]) == [3.0, pytest.approx(198 * 2 / 3), pytest.approx(198 / 3)]


def test_langid(spark, odd):
    docs = {r.doc_id: r.lang for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    out = [r for r in langid.op5(spark, "/root/testdata/sf0.01").collect() if r.held_out]
    assert sum(docs[r.doc_id] == r.lang_pred for r in out) > 0.97 * len(out)
    model = langid.fit(odd)
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.identify(odd, model).collect()}
    assert got[1] == got[2] == got[3] == got[8] == ("und", 0.0) and got[4][0] == "en"
    assert langid.identify(odd, langid.fit(odd.limit(0))).count() == 10


def test_licenses(spark, odd):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = con.execute(licenses.ORACLES["op6_license_digests"]).fetchall()
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in licenses.op6(spark, SF).collect())
    assert licenses.license_scan(odd).count() == 10
    text = "  Copyright 2020 Someone\nRELEASED under the MIT Licence"
    one = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert licenses.license_scan(one).first().license == "MIT"


def test_license_files_and_notices(spark):
    """Files in their usual wrapping, and notices in a line of another text."""
    texts = {p.stem: p.read_text() for p in (licenses.Path(licenses.__file__).parent / "license_texts").glob("*.txt")}
    isc = textwrap.fill(licenses.NOTICES[-1][1], 76)
    assert "\ncopyright notice" in isc
    head = "Copyright (c) 2019, Jane Doe\nAll rights reserved.\n\n"
    want = [
        ("ISC", f"ISC License\n\nCopyright 2019 Jane Doe <jane@example.org>\n\n{isc}\n"),
        ("ISC", f"Copyright  Jane Doe\n\n{textwrap.fill(licenses.NOTICES[-1][1], 40)}"),
        ("MIT", f"MIT License\n\nCopyright (c) 2019 Jane Doe\n\n{texts['MIT']}"),
        ("MIT", f"© 2019 Jane Doe\n{textwrap.fill(' '.join(texts['MIT'].split()), 50)}"),
        ("BSD-2-Clause", head + texts["BSD-2-Clause"]),
        ("BSD-3-Clause", "BSD 3-Clause License\n\n" + head + texts["BSD-3-Clause"]),
        *((k, t.replace("\n", "\r\n")) for k, t in texts.items()),
        (None, f"{texts['MIT']}\nand more"), (None, "Copyright notice"), (None, "Copyright law\n"),
    ]
    lines = [
        ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."), ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons "
         "Attribution-NonCommercial 4.0 International License."), ("Apache-2.0", "License: Apache 2.0"),
        ("BSD-2-Clause", " ".join(texts["BSD-2-Clause"].split())), ("", "Licensed under CC BY-NC 4.0 or not"),
    ]
    rows = [(i, t) for i, (_, t) in enumerate(want)] + [(100 + i, f"Some text.\n{t}\nMore.") for i, (_, t) in enumerate(lines)]
    got = {r.doc_id: r for r in licenses.license_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[i].license for i in range(len(want))] == [k for k, _ in want]
    assert [got[100 + i].line_licenses for i in range(len(lines))] == [k for k, _ in lines]


def test_toxicity(spark, odd):
    sf = "/root/testdata/sf0.01"
    toxic = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    out = toxicity.op8(spark, sf).collect()
    held = [(toxic[r.doc_id], r.predicted) for r in out if r.held_out and r.doc_id in toxic]
    assert sum(p for y, p in held if not y) <= 0.03 * len(held)
    assert sum(p for y, p in held if y) >= 0.6 * sum(y for y, _ in held)
    none = spark.createDataFrame([], "doc_id long, toxic int")
    scorer = toxicity.Scorer({"bad": 6.0, "nasty": 3.0, "nast-": 2.0}, -4.0)
    got = {r.doc_id: r for r in toxicity.toxic_scores(odd, scorer).collect()}
    assert got[1].score == got[2].score == pytest.approx(1 / (1 + np.exp(4))) and got[None].predicted == 0
    assert scorer.score("so Bad") == pytest.approx(1 / (1 + np.exp(-2))) and scorer.score("nasty nastier") == pytest.approx(1 / (1 + np.exp(-1)))
    assert toxicity.toxic_scores(odd.limit(0), scorer).count() == 0
    assert toxicity.toxic_scores(odd, toxicity.fit(odd, none)).count() == 10


def test_label_model_finds_planted_rates():
    """Voters of known rates, two that are one, and a label that is wrong one time in ten."""
    rng = np.random.default_rng(6)
    true = rng.random(6000) < 0.15
    rates = np.array([[0.02, 0.7], [0.05, 0.6], [0.01, 0.4], [0.1, 0.5]])
    votes = (rng.random((6000, 4)) < rates[:, true.astype(int)].T).astype(float)
    votes = np.column_stack([votes, votes[:, 0], np.zeros(6000)])  # a copy of the first, and a voter that never fires
    labels = np.where(rng.random(6000) < 0.1, ~true, true).astype(int)
    labels[rng.random(6000) < 0.5] = -1
    model = toxicity.LabelModel(votes, labels)
    assert np.abs(model.rates[:, :4].T - rates).max() < 0.08 and abs(model.prior - 0.15) < 0.04
    assert abs(model.said[1] - 0.9) < 0.06 and abs(model.said[0] - 0.1) < 0.06  # the label's own rates are found
    assert model.correlation[0, 4] > 0.9 and model.share[0] < 0.6 < model.share[2]
    known = labels >= 0
    wrong = (labels[known] == 1) != true[known]
    fixed = (model.labels[known] > 0.5) == true[known]
    assert fixed.mean() > 0.93 > 1 - wrong.mean() and fixed[wrong].mean() > 0.4
    assert ((model.posterior(votes) > 0.5) == true).mean() > 0.9


def test_patterns_need_no_lexicon_word():
    voters = toxicity.Voters(["achli-"])
    for text in ("nobody likes you, go away and drop dead", "shut up and get lost", "AchlichE"):
        assert voters.votes(text).any() and not voters.votes(text)[-1] and not voters.votes(text)[: len(toxicity.LEXICON)].any()
    assert voters.votes("a calm text")[-1] == 1


def plain_units(text, size=25, least=20):
    """The units of operator 9 as its docstring has them, step by step: each as
    (start, end, what it is)."""
    text, units = text or "", []
    marks = [(m.start(), m.end(), m.group().lower()) for m in re.finditer(r"[^\W_]+", text)]
    mask = 2**64 - 1
    if len(marks) >= 2 * size:
        h = [xxhash.xxh3_64_intdigest(w.encode()) for *_, w in marks]
        value = []
        for i in range(len(h) - size + 1):
            x = 0
            for y in h[i : i + size]:
                x = (x * 0x9E3779B97F4A7C15 + y) & mask
            value.append(((x ^ x >> 29) * 0xBF58476D1CE4E5B9) & mask)
        chosen = sorted({min(range(i, i + size + 1), key=lambda j: (value[j], j)) for i in range(len(value) - size)})
        last: dict = {}
        for i in chosen:
            if last.get(value[i], 0) <= i:
                last[value[i]] = i + size
                end = marks[i + size - 1][1]
                stop = marks[i + size][0] if i + size < len(marks) else len(text)
                while end < stop and not text[end].isspace():
                    end += 1
                units.append((marks[i][0], end, ("run", *(w for *_, w in marks[i : i + size]))))
    lines, at = [], 0
    for line in re.split(r"[\n\r]", text):
        words = tuple(re.findall(r"[^\W_]+", line.lower()))
        if words:
            lines.append((at, at + len(line), words))
        at += len(line) + 1
    if lines:
        units.append((0, len(text), ("text", *(w for x in lines for w in x[2]))))
    units += [(a, b, ("line", *w)) for a, b, w in lines if len(w) >= least]
    until: dict = {}
    for i in range(len(lines) - 2):
        what = ("lines", *(x[2] for x in lines[i : i + 3]))
        if any(len(x[2]) < least for x in lines[i : i + 3]) and until.get(what, -1) < lines[i][0]:
            until[what] = lines[i + 2][1]
            units.append((lines[i][0], lines[i + 2][1], what))
    return units


def plain_spans(rows):
    """By doc_id the repeated ranges of rows (doc_id, text) in order."""
    seen, out = {}, {}
    for d, text in rows:
        own = sorted(plain_units(text), key=lambda u: u[0])
        for a, _, what in own:
            seen.setdefault(what, (d, a))
        out[d] = sorted({(a, b) for a, b, what in own if seen[what] != (d, a)})
    return out


def test_line_dedup(spark, odd):
    rows = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect())
    assert {r.doc_id: [tuple(x) for x in r.removed] for r in linededup.op9(spark, SF).collect()} == plain_spans(rows)
    got = sorted(str((r.doc_id, r.text and r.text[:9])) for r in linededup.without_lines(odd).collect())
    assert len(got) == 10 and "(4, 'one two t')" in got and "(9, '')" in got


def test_short_copies_go(spark):
    """Whole copies, paragraphs and short lines among repeated neighbours go; a short line alone stays."""
    lines = [" ".join(f"{a}{i}" for i in range(10)) for a in "abcd"]
    para = "Nineteen words of a note: " + " ".join(f"n{i}" for i in range(14)) + "."
    rows = [(1, "\n".join(lines)), (2, "\n".join(lines)), (3, "Own text first.\n" + "\n".join(lines).upper() + "\nMore of its own."), (4, "Hi."), (5, "hi"), (6, "Hi.\nthere"),
            (7, f"{para}\n\nIts own one."), (8, f"Another text.\n \n{para}\n\nEnd."), (9, lines[0] + "\nsomething else"), (10, "x y\n" * 7), (11, " \n.")]
    out = {r.doc_id: r.text for r in linededup.without_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out[1] == rows[0][1] and out[2] == "" and out[3].split() == "Own text first. More of its own.".split()
    assert out[4] == "Hi." and out[5] == "" and out[6] == "Hi.\nthere" and out[7] == rows[6][1] and out[8].split() == ["Another", "text.", "End."]
    assert out[9] == rows[8][1] and out[10].split() == ["x", "y"] * 4 and out[11] == " \n."


def test_lines_of_enough_words(spark):
    line = " ".join(f"word{i}" for i in range(20))
    rows = [(1, f"Top\n{line}\nEnd"), (2, f"  {line.upper()}!\r\nOther end"), (3, " ".join(line.split()[:19]) + "\nshort\nshort"), (None, line)]
    out = {r.doc_id: r for r in linededup.without_lines(spark.createDataFrame(rows, "doc_id int, text string")).collect()}
    assert out[1].text == rows[0][1] and out[3].text == rows[2][1]
    assert out[2].text == "Other end" and out[None].text == ""
    short = {r.doc_id: r.text for r in linededup.without_lines(spark.createDataFrame(rows, "doc_id int, text string"), min_words=1).collect()}
    assert short[3] == rows[2][1][: rows[2][1].rindex("short")]
    clash = spark.createDataFrame([(1, line, 5, 6), (2, line, 7, 8)], "doc_id int, text string, key int, spans int")
    assert sorted(linededup.without_lines(clash).columns) == ["doc_id", "removed", "text"]
    assert linededup.without_lines(clash.limit(0)).count() == 0


def test_passages_with_other_borders(spark):
    """Passages of 60 words without sentence ends, in other lines, and in lines of under five words."""
    rng = np.random.default_rng(2)
    words = lambda n: [f"word{x}" for x in rng.integers(0, 9999, n)]
    passage, rows = words(60), []
    for i, width in enumerate((60, 60, 7, 3, 13)):
        lines = "\n".join(" ".join(passage[at : at + width]) for at in range(0, 60, width))
        rows.append((i, f"{' '.join(words(9))} {lines} {' '.join(words(9))}. The end of number {i} is here."))
    rows.append((9, " ".join(["again"] * 80)))
    out = {r.doc_id: r for r in linededup.without_lines(spark.createDataFrame(rows, "doc_id int, text string")).collect()}
    assert out[0].text == rows[0][1]
    assert len(out[9].text.split()) >= linededup.RUN and rows[-1][1].startswith(out[9].text.strip())  # one copy of the run stays
    for i, text in rows[1:5]:
        own = [w for w in text.split() if w not in passage]
        left = out[i].text.split()
        assert [w for w in left if w not in passage] == own and sum(w in passage for w in left) <= 2 * linededup.RUN
        assert linededup.without_spans(text, [tuple(x) for x in out[i].removed]) == out[i].text


def test_vectors(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(60, 16))
    x = np.concatenate([base + 0.08 * rng.normal(size=base.shape) for _ in range(12)])
    rows = [(i, [float(c) for c in v], 0) for i, v in enumerate(x)] + [(900, [float(c) for c in x[0]], 0)]
    rows += [(901, None, 0), (902, [0.0] * 16, 0), (903, [1.0, None], 0), (904, [float("nan")] * 16, 0), (905, [], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    out = {r.vec_id: r for r in vectors.near_vectors(df).collect()}
    assert len(out) == len(rows)
    y = np.array([r[1] for r in rows[:721]], np.float32).astype(float)
    y /= np.linalg.norm(y, axis=1)[:, None]
    true = (y @ y.T >= 0.95).sum(axis=1) - 1
    found = np.array([out[r[0]].n_links for r in rows[:721]])
    assert (found <= true).all() and found.sum() >= 0.9 * true.sum()
    assert all(out[k].n_links == 0 and out[k].kept for k in range(901, 906))
    assert vectors.near_vectors(df.limit(0)).count() == 0


def test_links_over_many_shards(spark, monkeypatch):
    """Dense clusters, several shards and blocks: recall, and sums that agree with components."""
    monkeypatch.setattr(vectors, "SHARD_ROWS", 150)
    monkeypatch.setattr(vectors, "BLOCK_ROWS", 200)
    rng = np.random.default_rng(4)
    base = rng.normal(size=(20, 24))
    base /= np.linalg.norm(base, axis=1)[:, None]
    x = base[rng.integers(0, 20, 1500)] + 0.045 * rng.normal(size=(1500, 24))
    df = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    y = x / np.linalg.norm(x, axis=1)[:, None]
    true = (y @ y.T >= 0.95).sum(axis=1) - 1
    got = {r.vec_id: r for r in vectors.near_vectors(df).collect()}
    found = np.array([got[i].n_links for i in range(len(x))])
    assert (found <= true).all() and found.sum() >= 0.95 * true.sum()
    size = collections.Counter(r.component_id for r in got.values())
    assert all((r.n_links > 0) == (size[r.component_id] > 1) for r in got.values())


def test_small_clusters_over_levels_of_shards(spark, monkeypatch):
    """Two first centres, shards dealt again below them: every link of small clusters is found."""
    for name, value in {"SHARD_ROWS": 100, "BLOCK_ROWS": 150, "CENTRES": 2, "SPLIT_ROWS": 300, "SUB_CENTRES": 3}.items():
        monkeypatch.setattr(vectors, name, value)
    taken = []
    split = vectors._split
    monkeypatch.setattr(vectors, "_split", lambda *a: taken.append(split(*a)) or taken[-1])
    rng = np.random.default_rng(7)
    base = rng.normal(size=(400, 32))
    x = np.repeat(base / np.linalg.norm(base, axis=1)[:, None], 4, axis=0) + 0.15 / np.sqrt(32) * rng.normal(size=(1600, 32))
    df = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    y = x / np.linalg.norm(x, axis=1)[:, None]
    true = (y @ y.T >= 0.95).sum(axis=1) - 1
    got = {r.vec_id: r for r in vectors.near_vectors(df).collect()}
    found = np.array([got[i].n_links for i in range(len(x))])
    assert (found <= true).all() and found.sum() >= 0.99 * true.sum()
    assert len({r.component_id for r in got.values()}) <= 402
    assert taken[0].select(F.explode("shards").alias("s")).where("s >= 4096").distinct().count() > 3
    assert taken[0].count() == len(x)


def test_langid_scores_whole_words():
    """What follows the first 64 letters of a run counts; numbers are no letters."""
    model = langid.Model({"a": collections.Counter({"xyxy": 5}), "b": collections.Counter({"uvuv": 5})})
    predict = langid.Predictor(model, most=1).predict
    for _ in range(2):
        assert predict("q" * 64 + "uvuv" * 20)[0] == "b" and predict("q" * 64 + "xyxy" * 20)[0] == "a"
    assert predict("½ ² 12 _ Ⅷ") == ("und", 0.0) and predict("½xyxy²")[0] == "a"


def test_sample_never_vanishes(spark):
    """The threshold of a sample is above 0 at any number of rows."""
    rows = spark.range(2000).select((F.col("id") % 2).alias("by"), "id")
    assert langid.sampled(rows, 100, "by", "s", "id").count() in range(140, 260)
    assert langid.sampled(rows, 5000, "by", "s", "id").count() == 2000
    least = spark.range(1).select((langid.chance("s", "id") < F.lit(6000.0) / F.lit(10**12)).alias("x"), (F.lit(6000.0) / F.lit(10**12) > F.lit(2.0**-53)).alias("some")).first()
    assert least.some


def test_langid_columns_that_clash(spark):
    rows = spark.createDataFrame([(None, "one", "en", 1), (2, None, "en", 2)], "doc_id long, text string, lang_pred string, score int")
    model = langid.Model({"en": collections.Counter({"one": 5}), "de": collections.Counter({"eins": 5})})
    got = langid.identify(rows, model).collect()
    assert sorted((str(r.doc_id), r.lang_pred) for r in got) == [("2", "und"), ("None", "en")]
    assert langid.identify(rows.limit(0), model).count() == 0


def test_langid_against_plain_scores():
    """The predictor equals sums over the plain definition."""
    texts = [("a", "alpha beta gamma alpha"), ("b", "delta beta omega"), ("b", "omega psi")]
    counts = {"a": collections.Counter(), "b": collections.Counter()}
    for lang, text in texts:
        counts[lang].update(text.split())

    def log(table, item):
        n = {x: table[x][item] for x in "ab"}
        size = len(set(table["a"]) | set(table["b"]))
        v = {x: np.log((n[x] + 0.5) / (sum(table[x].values()) + 0.5 * size)) for x in "ab"}
        return np.array([v["a"], v["b"]]) - (v["a"] + v["b"]) / 2

    parts = {x: collections.Counter(g for w, n in counts[x].items() for g in langid.grams(w) for _ in range(n)) for x in "ab"}

    def word(w):
        if counts["a"][w] + counts["b"][w]:
            return log(counts, w)
        padded, at, used = f"^{w}$", 0, []
        while at < len(padded):
            for k in range(4, 0, -1):
                g = padded[at : at + k]
                if len(g) == k and parts["a"][g] + parts["b"][g]:
                    used.append(log(parts, g))
                    at += k
                    break
            else:
                at += 1
        return sum(used, np.zeros(2)) / max(1, len(used) ** 0.5)

    predictor = langid.Predictor(langid.Model(counts))
    for text in ("alpha", "beta beta omega", "alphabet soup", "zzz delt", "gamma delta psi unknown"):
        mean = np.mean([word(w) for w in text.split()], axis=0)
        p = np.exp(4 * (mean - mean.max()))
        assert predictor.predict(text)[1] == pytest.approx(p.max() / p.sum(), abs=1e-4)
