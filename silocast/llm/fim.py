"""Fill-in-middle transformation by content-defined chunks (operator 12).

A rolling hash of the last 32 bytes cuts a text into chunks, so passages that
texts share give the same chunks wherever they stand. What a chunk adds to the
token count is worked out once and kept under the chunk's bytes, which verify
each later use. The counts of a text's chunks are combined at their borders,
and only the chunk in which a cut falls is looked into.
"""

from __future__ import annotations

import re
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import table

#: bytes of the rolling window, least and most bytes of a chunk; one position in 256 is a border
WINDOW, LEAST, MOST, MASK = 32, 32, 2048, np.uint32(0xFF000000)
#: bytes that are hashed at once, so a very long text needs little memory
BLOCK = 1 << 20
#: bytes of chunks that a Python worker keeps the summaries of
CACHE = 32 << 20
SPACE = b" \t\n\x0b\x0c\r"
RUN = re.compile(rb"[^\x20\x09-\x0D]+")
CONTINUED = bytes(range(0x80, 0xC0))
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: a random number for each byte, the same in every task
GEAR = np.random.default_rng(42).integers(0, 1 << 32, 256, dtype=np.uint32)


def borders(text: bytes) -> list[int]:
    """The ends of the chunks of a text, content-defined."""
    found = []
    for at in range(0, len(text), BLOCK):
        since = max(0, at - WINDOW + 1)
        h = GEAR[np.frombuffer(text, np.uint8, min(len(text), at + BLOCK) - since, since)]
        width = 1
        while width < WINDOW:  # the sum of 2**age * gear over the window, by doubling
            h[width:] += h[:-width] << np.uint32(width)
            width *= 2
        own = h[at - since :]
        found.append(np.flatnonzero((own & MASK) == 0) + at + 1)
    out, last = [], 0
    for end in np.concatenate(found).tolist() if found else []:
        while end - last > MOST:
            last += MOST
            out.append(last)
        if end - last >= LEAST:
            out.append(end)
            last = end
    while last < len(text):
        last = min(last + MOST, len(text))
        out.append(last)
    return out


class Summary(NamedTuple):
    """What a chunk adds: runs of words in it, whether it begins and ends
    inside one, and its code points."""

    words: int
    begins: bool
    ends: bool
    chars: int


def code_points(text: bytes) -> int:
    return len(text.translate(None, CONTINUED))


class Summaries:
    """The summaries of the chunks seen last, by content. Two generations: what
    is used again moves to the younger, the older goes when that is full."""

    def __init__(self, most: int = CACHE) -> None:
        self.most, self.size, self.found = most // 2, 0, 0
        self.young: dict[bytes, Summary] = {}
        self.old: dict[bytes, Summary] = {}

    def of(self, chunk: bytes) -> Summary:
        out = self.young.get(chunk)
        if out is not None:
            self.found += 1
            return out
        out = self.old.get(chunk)
        if out is None:
            out = Summary(len(chunk.split()), chunk[0] not in SPACE, chunk[-1] not in SPACE, code_points(chunk))
        else:
            self.found += 1
        if self.size > self.most:
            self.old, self.young, self.size = self.young, {}, 0
        self.young[chunk] = out
        self.size += len(chunk)
        return out


class Tokens:
    """The token count of a text and the places of its cuts, from summaries."""

    def __init__(self, text: bytes, cache: Summaries) -> None:
        ends = borders(text)
        self.text, self.starts = text, [0, *ends][: len(ends)]
        self.parts = [cache.of(text[a:b]) for a, b in zip(self.starts, ends, strict=True)]
        joined = [False, *(a.ends and b.begins for a, b in zip(self.parts, self.parts[1:], strict=False))][: len(self.parts)]
        self.joined = joined
        self.words = np.cumsum([p.words - j for p, j in zip(self.parts, joined, strict=True)], dtype=np.int64)
        self.chars = np.cumsum([0, *(p.chars for p in self.parts)], dtype=np.int64)
        last = int(self.words[-1]) if ends else 0
        self.n_words, self.n = last, last + bool(text and text[-1] in SPACE)

    def cut(self, k: int) -> int:
        """The code points before the end of the k-th token."""
        if k <= 0:
            return 0
        if k > self.n_words:
            return int(self.chars[-1])
        i = int(np.searchsorted(self.words, k))  # the chunk in which the word begins
        nth = k - (int(self.words[i - 1]) if i else 0) + self.joined[i]
        part = self.parts[i]
        if nth < part.words or not part.ends:
            return int(self.chars[i]) + self._end(i, nth)
        while i + 1 < len(self.parts) and self.joined[i + 1]:  # the word goes on in the next chunks
            i += 1
            part = self.parts[i]
            if part.words > 1 or not part.ends:
                return int(self.chars[i]) + self._end(i, 1)
        return int(self.chars[i + 1])

    def _end(self, i: int, nth: int) -> int:
        """The code points of chunk i before the end of its nth run."""
        start = self.starts[i]
        chunk = self.text[start : self.starts[i + 1] if i + 1 < len(self.starts) else len(self.text)]
        for m in RUN.finditer(chunk):
            nth -= 1
            if not nth:
                return code_points(chunk[: m.end()])
        raise AssertionError("a summary does not fit its chunk")


_CACHE = Summaries()
_PLACES = StructType([StructField(k, LongType()) for k in ("n", "first", "second")])


@F.arrow_udf(_PLACES)
def cuts(text: pa.Array, a: pa.Array, b: pa.Array) -> pa.Array:
    """Tokens of each text, and the code points before its two cuts, a and b
    modulo one more than the tokens."""
    out = ([], [], [])
    raw = text.cast(pa.binary() if pa.types.is_string(text.type) else pa.large_binary())
    for t, x, y in zip(raw, a.to_pylist(), b.to_pylist(), strict=True):
        tokens = Tokens(t.as_py(), _CACHE)
        low, high = sorted((x % (tokens.n + 1), y % (tokens.n + 1)))
        for column, v in zip(out, (tokens.n, tokens.cut(low), tokens.cut(high)), strict=True):
            column.append(v)
    return pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in out], ["n", "first", "second"])


def _draw(doc_id: Column, i: int) -> Column:
    """The i-th number from 0 to 2**32 - 1 that a document draws."""
    digest = F.sha2(F.concat(F.lit("42:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long")


def fill_in_middle(docs: DataFrame, rate: int = 50, spm: int = 80) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output) per row of
    ``docs``: ``rate`` per cent of the texts transformed, ``spm`` per cent of
    these with the suffix first.

    A token is a word with the blanks before it, or the blanks at the end. A
    null or empty text, and one that contains a sentinel, stays plain. A null
    doc_id draws like the empty string; equal ids draw alike; repeated rows
    stay; very long texts are cut whole; an empty table gives an empty result;
    other columns are ignored.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    draws = {f"h{i + 1}": _draw(F.col("doc_id"), i) for i in range(4)}
    rows = docs.select("doc_id", text.alias("text"), *[c.alias(k) for k, c in draws.items()])
    rows = rows.withColumn("at", cuts("text", "h1", "h2"))
    marked = F.col("text").contains(PREFIX) | F.col("text").contains(SUFFIX) | F.col("text").contains(MIDDLE)
    plain = (F.col("text") == "") | marked | (F.col("h3") % 100 >= rate)
    rows = rows.withColumn("form", F.when(plain, "plain").when(F.col("h4") % 100 < spm, "spm").otherwise("psm"))
    first, size = F.col("at.first").cast("int"), (F.col("at.second") - F.col("at.first")).cast("int")
    prefix = F.substring("text", F.lit(1), first)
    middle = F.substring("text", first + 1, size)
    suffix = F.substring("text", F.col("at.second").cast("int") + 1, F.lit(2**31 - 1))
    p, s, m = (F.lit(x) for x in (PREFIX, SUFFIX, MIDDLE))
    output = F.when(F.col("form") == "plain", F.col("text")).when(F.col("form") == "psm", F.concat(p, prefix, s, suffix, m, middle))
    output = output.otherwise(F.concat(s, suffix, p, prefix, m, middle))
    cut = F.col("form") != "plain"
    return rows.select(
        "doc_id", F.col("at.n").alias("n"), "form", F.when(cut, F.col("at.first")).alias("prefix_chars"),
        F.when(cut, F.col("at.second") - F.col("at.first")).alias("middle_chars"), output.alias("output"),
    )


def restored(form: str = "form", output: str = "output") -> Column:
    """The text that an output was made of. No sentinel stands in a text that
    was cut, so the first of each is the border."""
    out = F.col(output)
    before_m = F.locate(MIDDLE, out)
    middle = F.substring(out, before_m + len(MIDDLE), F.lit(2**31 - 1))

    def between(first: str, second: str) -> tuple[Column, Column]:
        border = F.locate(second, out)
        return F.substring(out, F.lit(len(first) + 1), border - len(first) - 1), F.substring(out, border + len(second), before_m - border - len(second))

    (prefix, suffix), (tail, head) = between(PREFIX, SUFFIX), between(SUFFIX, PREFIX)
    return F.when(F.col(form) == "psm", F.concat(prefix, middle, suffix)).when(F.col(form) == "spm", F.concat(head, middle, tail)).otherwise(out)


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fill_in_middle(table(spark, sf_dir, "documents"))
    return out.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(), 256).alias("restored_sha256")
    )


ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
t AS (SELECT doc_id, text, regexp_extract_all(text, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS tokens,
  CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2, CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4 FROM d),
c AS (SELECT *, CAST(len(tokens) AS BIGINT) AS n, least(h1 % (len(tokens) + 1), h2 % (len(tokens) + 1)) AS a, greatest(h1 % (len(tokens) + 1), h2 % (len(tokens) + 1)) AS b,
  CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 50 THEN 'plain'
    WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM t),
p AS (SELECT doc_id, text, n, form, array_to_string(tokens[1:a], '') AS pre, array_to_string(tokens[a + 1:b], '') AS mid, array_to_string(tokens[b + 1:], '') AS suf FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN concat('<P>', pre, '<S>', suf, '<M>', mid) ELSE concat('<S>', suf, '<P>', pre, '<M>', mid) END) AS output_sha256,
  sha256(CASE form WHEN 'plain' THEN text ELSE concat(pre, mid, suf) END) AS restored_sha256 FROM p
"""

QUERIES = {"op12_fill_in_middle": op12}
ORACLES = {"op12_fill_in_middle": ORACLE}
