"""Quality rules with risk-controlled thresholds (operator 13).

Every rule gives a document an integer score, higher is worse. Labelled texts
are dealt into two folds by their digests. From the good texts of the first
fold come, per stratum (language) and level, the cutoffs of all rules; the
second fold tests each level: it is certified if an exact binomial bound shows
that at most ``risk`` of the good texts are rejected, at a confidence that is
corrected for all strata and levels tested. Of the certified levels a stratum
takes the one that parts bad from good best; without any, nothing is rejected.

All of it is DataFrame functions: no Python runs on the executors.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stored, table

BLANKS = r"[\x20\x09-\x0D]+"
WINDOW = 8
#: at most this share of a stratum's good texts may be rejected, but for this probability over all tests
RISK, DOUBT = 0.05, 0.05
#: the share of good texts, in thousandths, that each rule may reject in the first fold, by level; at the
#: first level (None) cutoffs lie a quarter, and MARGIN, above the highest score of a good text
LEVELS, MARGIN = (None, 0, 1, 2, 5, 10), 25
#: good texts in the second fold from which a stratum is tested; scores end here
LEAST, TOP = 100, 10_000
#: terms of a binomial sum that are added one by one; the rest is bounded from above
TERMS = 5000
#: strata up to which the policy is broadcast
SMALL = 10_000

#: Rules: a score of the columns of ``text_counts``, by name.
RULES = {
    "long_words": "least({top}, word_chars * 100 div n_words)",
    "short_words": "{top} - least({top}, word_chars * 100 div n_words)",
    "symbols": "least({top}, n_symbols * 1000 div n_words)",
    "dup_lines": "n_dup_lines * 1000 div n_lines",
    "repeats": "n_repeat_words * 1000 div n_words",
    "capitals": "n_capitals * 1000 div word_chars",
    "same_words": "1000 - n_distinct * 1000 div n_words",
}
COUNTS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_capitals", "n_distinct")


def _twins(a: str) -> Column:
    """The entries of the sorted array ``a`` whose key ``k`` a neighbour has."""
    return F.filter(a, lambda x, j: (F.get(a, j - 1)["k"] == x["k"]) | (F.get(a, j + 1)["k"] == x["k"]))


def _with_repeats(rows: DataFrame) -> DataFrame:
    """``rows`` with n_repeat_words, the words of ``_words`` in windows that
    stand twice or more. Where the hashes of all windows differ, none repeats;
    windows with a hash in common are compared word by word. Each step is a
    column of its own, as a lambda would work it out for every entry."""
    by_hash = F.array_sort(F.transform("_windows", lambda h, i: F.struct(h.alias("k"), i.alias("i"))))
    by_words = F.transform(_twins("_by_hash"), lambda x: F.struct(F.slice("_words", x["i"] + 1, WINDOW).alias("k"), x["i"].alias("i")))
    rows = rows.withColumn("_by_hash", F.when(F.size(F.array_distinct("_windows")) < F.size("_windows"), by_hash))
    rows = rows.withColumn("_by_words", F.when(F.col("_by_hash").isNotNull(), F.array_sort(by_words)))
    places = F.array_sort(F.transform(_twins("_by_words"), lambda x: x["i"]))
    start = F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).alias("n"))
    step = lambda s, i: F.struct(i.alias("last"), (s["n"] + F.least(F.lit(WINDOW), i - s["last"])).alias("n"))
    return rows.withColumn("n_repeat_words", F.coalesce(F.aggregate(places, start, step, lambda s: s["n"]), F.lit(0)))


def text_counts(docs: DataFrame) -> DataFrame:
    """``docs`` with the counts of its ``text`` (null: empty), as longs: words,
    their code points, symbols, lines with a word and those equal to an earlier
    one, words in 8-word windows that repeat, capitals and distinct words."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.withColumn("_t", text)
    rows = rows.withColumns({
        "_words": F.filter(F.split("_t", BLANKS), lambda w: w != ""),
        "_lines": F.filter(F.split("_t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")),
        "_symbols": F.length("_t") - F.length(F.regexp_replace("_t", r"[#*$%&|<>]+", "")),
        "_capitals": F.length("_t") - F.length(F.regexp_replace("_t", r"[A-ZÀ-ÖØ-Þ]+", "")),
    })
    rows = rows.withColumn("_hashes", F.transform("_words", lambda w: F.xxhash64(w)))
    at = F.sequence(F.lit(1), F.size("_hashes") - WINDOW + 1)
    windows = F.when(F.size("_hashes") >= WINDOW, F.transform(at, lambda i: F.xxhash64(F.slice("_hashes", i, WINDOW))))
    rows = _with_repeats(rows.withColumn("_windows", windows))
    out = {
        "n_words": F.size("_words"), "word_chars": F.length(F.array_join("_words", "")), "n_symbols": F.col("_symbols"),
        "n_lines": F.size("_lines"), "n_dup_lines": F.size("_lines") - F.size(F.array_distinct("_lines")),
        "n_repeat_words": F.col("n_repeat_words"), "n_capitals": F.col("_capitals"),
        "n_distinct": F.size(F.array_distinct("_hashes")),
    }
    return rows.select(*docs.columns, *[c.cast("long").alias(k) for k, c in out.items()])


def base_failed() -> Column:
    return F.expr("n_words < 20 OR 100 * n_repeat_words > 30 * n_words")


def log_factorial(n: Column) -> Column:
    """ln n!, exact to rounding: Stirling's series from 20 on."""
    x = n.cast("double")
    series = x * F.log(x) - x + F.log(2 * math.pi * x) / 2 + 1 / (12 * x) - 1 / (360 * x * x * x) + 1 / (1260 * F.pow(x, F.lit(5.0)))
    return F.when(n < 20, F.log(F.factorial(n.cast("int")).cast("double"))).otherwise(series)


def binomial_tail(x: Column, n: Column, p: float) -> Column:
    """P(X <= x) of n draws at p, or a little more where x > ``TERMS``: terms
    from x down by their ratio, the rest bounded by a geometric series. 1 where
    x is at least the mean, which no test passes."""
    top = log_factorial(n) - log_factorial(x) - log_factorial(n - x) + x * math.log(p) + (n - x) * math.log1p(-p)
    ratio = lambda k: k * (1 - p) / ((n - k + 1) * p)
    down = F.sequence(x.cast("long"), F.greatest(F.lit(0), x - TERMS + 1).cast("long"), F.lit(-1).cast("long"))
    start = F.struct(F.exp(top).alias("term"), F.lit(0.0).alias("sum"), F.lit(0.0).alias("left"))

    def add(s: Column, k: Column) -> Column:
        r = ratio(k)
        return F.struct((s["term"] * r).alias("term"), (s["sum"] + s["term"]).alias("sum"), (s["term"] * r / (1 - r)).alias("left"))

    added = F.aggregate(down, start, add, lambda s: s["sum"] + s["left"])
    return F.when(x >= n * p, 1.0).otherwise(added)


def _policy(counted: DataFrame, labels: DataFrame) -> DataFrame:
    """(stratum, cutoff_<rule>, level): the certified cutoffs of each stratum."""
    known = labels.where(F.col("quality").isNotNull()).groupBy(F.col("doc_id").alias("_doc")).agg(F.min("quality").alias("good"))
    rows = counted.where(~base_failed()).join(known, F.col("doc_id") == F.col("_doc"))
    keys = ("stratum", "digest", *RULES)
    rows = rows.select("stratum", "digest", "good", *[F.expr(e.format(top=TOP)).alias(k) for k, e in RULES.items()])
    rows = rows.groupBy(*keys).agg(F.min("good").alias("good"))  # a text counts once, however many copies it has
    rows = rows.withColumn("fold", F.when(F.col("digest") < "8", 0).otherwise(1))
    rows = stored(rows.groupBy("stratum", "fold", "good", *RULES).count(), "quality-labelled")

    # cutoffs: per rule the least score that no more than the level's share of the good texts exceed
    scores = F.explode(F.array(*[F.struct(F.lit(k).alias("rule"), F.col(k).alias("score")) for k in RULES]))
    seen = rows.where("fold = 0 AND good = 1").select("stratum", "count", scores.alias("s"))
    seen = seen.groupBy("stratum", "s.rule", "s.score").agg(F.sum("count").alias("c"))
    w = Window.partitionBy("stratum", "rule")
    above = F.coalesce(F.sum("c").over(w.orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    seen = seen.select("stratum", "rule", "score", above.alias("above"), F.sum("c").over(w).alias("all"))
    at = [F.max("score") + F.expr("max(score) div 4") + MARGIN if q is None else F.min(F.when(F.col("above") * 1000 <= F.col("all") * q, F.col("score"))) for q in LEVELS]
    cuts = seen.groupBy("stratum").pivot("rule", list(RULES)).agg(F.array(*at).alias("c"))
    cuts = cuts.withColumnsRenamed({k: f"cuts_{k}" for k in RULES})

    # tests: the first level at which any rule rejects a text
    held = rows.where("fold = 1").join(_sized(cuts), "stratum")
    first = F.lit(len(LEVELS))
    for j in reversed(range(len(LEVELS))):
        bad = F.lit(False)
        for k in RULES:
            bad |= F.col(k) > F.col(f"cuts_{k}")[j]
        first = F.when(bad, j).otherwise(first)
    n = F.sum(F.when(F.col("good") == 1, F.col("count")).otherwise(0))
    m = F.sum(F.when(F.col("good") == 0, F.col("count")).otherwise(0))
    caught = [F.struct(F.lit(j).alias("level"), *[F.sum(F.when((F.col("good") == g) & (F.col("first") <= j), F.col("count")).otherwise(0)).alias(a) for g, a in ((1, "x"), (0, "y"))]) for j in range(len(LEVELS))]
    tests = held.withColumn("first", first).groupBy("stratum").agg(n.alias("n"), m.alias("m"), F.array(*caught).alias("t"))
    tests = tests.where(F.col("n") >= LEAST)
    tests = tests.withColumn("tests", F.count("*").over(Window.partitionBy()) * len(LEVELS))  # one row a stratum
    tests = tests.select("stratum", "n", "m", "tests", F.explode("t").alias("t")).select("stratum", "n", "m", "tests", "t.*")
    tests = tests.where(binomial_tail(F.col("x"), F.col("n"), RISK) * F.col("tests") <= DOUBT)
    gain = F.coalesce(F.try_divide("y", "m"), F.lit(0.0)) - F.col("x") / F.col("n")
    best = tests.groupBy("stratum").agg(F.max_by("level", F.struct(gain, -F.col("level"))).alias("level"))
    return best.join(cuts, "stratum").select("stratum", "level", *[F.get(f"cuts_{k}", F.col("level")).alias(f"cutoff_{k}") for k in RULES])


def _sized(small: DataFrame) -> DataFrame:
    """``small``, stored, to be broadcast if it has few rows."""
    small = stored(small, "quality-strata")
    return F.broadcast(small) if small.count() <= SMALL else small


def quality_rules(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, the counts, base_failed, level, kept) per row of ``docs``.

    labels: (doc_id, quality 0 or 1); of several labels of a document or text
    the least counts, a null one not at all. kept: the base rules hold and no
    score exceeds a cutoff of the stratum ``lang`` (null is a stratum); level
    is the certified one, null where a stratum has none, and then all that pass
    the base are kept. A null or empty text has no word and fails the base;
    very long texts count whole; repeated rows and null ids stay; ties take the
    milder level; an empty table gives an empty result, without labels only the
    base counts; other columns are ignored.
    """
    stratum = F.coalesce(F.concat(F.lit("="), F.col("lang").cast("string")), F.lit("null"))
    rows = docs.select("doc_id", "text", stratum.alias("stratum"), F.md5(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("digest"))
    counted = stored(text_counts(rows).drop("text"), "quality-counts")
    policy = _sized(_policy(counted, labels))
    out = counted.join(policy, "stratum", "left").withColumn("base_failed", base_failed())
    bad = F.lit(False)
    for k, e in RULES.items():
        bad |= F.expr(e.format(top=TOP)) > F.col(f"cutoff_{k}")
    kept = F.when(F.col("base_failed"), False).otherwise(~F.coalesce(bad, F.lit(False)))
    return out.select("doc_id", *COUNTS, "base_failed", "level", kept.alias("kept"))


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def _sql() -> str:
    rule = {k: e.format(top=TOP).replace(" div ", " // ") for k, e in RULES.items()}
    scores = ", ".join(f"{e} AS {k}" for k, e in rule.items())
    long = " UNION ALL ".join(f"SELECT stratum, '{k}' AS rule, {k} AS score FROM labelled WHERE fold = 0 AND good = 1" for k in RULES)
    levels = ", ".join(f"({j}, {q})" for j, q in enumerate(LEVELS) if q is not None)
    over = " OR ".join(f"(rule = '{k}' AND {k} > cutoff)" for k in RULES)
    over_doc = " OR ".join(f"(p.rule = '{k}' AND b.{k} > p.cutoff)" for k in RULES)
    return rf"""
WITH docs AS (SELECT row_number() OVER () AS rid, doc_id, coalesce('=' || lang, 'null') AS stratum, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words,
  list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM docs),
win AS (SELECT rid, i, array_to_string(words[i:i + {WINDOW - 1}], ' ') AS g FROM w, unnest(range(1, len(words) - {WINDOW - 2})) t(i)),
rep AS (SELECT rid, i FROM win QUALIFY count(*) OVER (PARTITION BY rid, g) > 1),
cov AS (SELECT rid, count(DISTINCT p) AS n FROM rep, unnest(range(i, i + {WINDOW})) t(p) GROUP BY 1),
c AS (SELECT w.rid, doc_id, stratum, md5(text) AS digest, CAST(len(words) AS BIGINT) AS n_words, length(array_to_string(words, '')) AS word_chars,
  length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols, CAST(len(lines) AS BIGINT) AS n_lines,
  CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, coalesce(cov.n, 0) AS n_repeat_words,
  length(text) - length(regexp_replace(text, '[A-ZÀ-ÖØ-Þ]', '', 'g')) AS n_capitals, CAST(len(list_distinct(words)) AS BIGINT) AS n_distinct
  FROM w LEFT JOIN cov USING (rid)),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM c),
s AS (SELECT *, {scores} FROM b WHERE NOT base_failed),
known AS (SELECT doc_id, min(quality) AS good FROM labels WHERE quality IS NOT NULL GROUP BY 1),
labelled AS (SELECT stratum, digest, {", ".join(RULES)}, min(good) AS good, CASE WHEN digest < '8' THEN 0 ELSE 1 END AS fold
  FROM s JOIN known USING (doc_id) GROUP BY ALL),
seen AS (SELECT stratum, rule, score, count(*) AS c FROM ({long}) GROUP BY ALL),
a AS (SELECT *, coalesce(sum(c) OVER (PARTITION BY stratum, rule ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS above,
  sum(c) OVER (PARTITION BY stratum, rule) AS total FROM seen),
cuts AS (SELECT stratum, rule, level, min(score) AS cutoff FROM a, (VALUES {levels}) q(level, share) WHERE above * 1000 <= total * share GROUP BY ALL
  UNION ALL SELECT stratum, rule, 0 AS level, max(score) + max(score) // 4 + {MARGIN} AS cutoff FROM a GROUP BY ALL),
hit AS (SELECT h.stratum, h.digest, h.good, level, bool_or({over}) AS bad FROM labelled h JOIN cuts USING (stratum) WHERE fold = 1 GROUP BY h.stratum, h.digest, h.good, level),
tests AS (SELECT stratum, level, count(*) FILTER (good = 1) AS n, count(*) FILTER (good = 0) AS m, count(*) FILTER (good = 1 AND bad) AS x, count(*) FILTER (good = 0 AND bad) AS y FROM hit GROUP BY ALL HAVING n >= {LEAST}),
tails AS (SELECT *, count(*) OVER () AS tests, CASE WHEN x >= n * {RISK} THEN 1.0 ELSE list_sum(list_transform(range(0, x + 1), lambda k:
  exp(lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1) + k * ln({RISK}) + (n - k) * ln(1 - {RISK})))) END AS tail FROM tests),
best AS (SELECT stratum, level FROM tails WHERE tail * tests <= {DOUBT}
  QUALIFY row_number() OVER (PARTITION BY stratum ORDER BY coalesce(y / nullif(m, 0), 0) - x / n DESC, level) = 1),
p AS (SELECT * FROM best JOIN cuts USING (stratum, level)),
failed AS (SELECT DISTINCT rid FROM s b JOIN p ON b.stratum = p.stratum AND ({over_doc}))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND rid NOT IN (SELECT rid FROM failed) AS kept FROM b
"""


QUERIES = {"op13_quality_rules": op13}
ORACLES = {"op13_quality_rules": _sql()}
