"""A corpus pipeline of five stages over ``documents``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is
written as Parquet and read again as the next stage's docs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from silocast.llm.common import discard, stored
from silocast.llm.langid import fit, held_out, identify
from silocast.llm.linededup import without_lines
from silocast.llm.mixing import cube_mix
from silocast.llm.packing import harmonic_pack
from silocast.llm.simhash import similar_components

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def row_key() -> Column:
    """A hash of all columns of a row; a hash alone skips nulls."""
    return F.xxhash64(*COLUMNS, *(F.col(c).isNull() for c in COLUMNS))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known; ``lang`` becomes the predicted one.
    Those without a letter (null and empty texts among them) go. Null ids and
    repeated rows stay, each by itself; very long texts count whole; ties go
    to the first language by name. An empty table, or one without labels,
    gives an empty one; columns other than those of documents are dropped."""
    model = fit(docs.where(~held_out()))
    found = identify(docs.select(*COLUMNS), model).where("lang_pred <> 'und'")
    return found.withColumn("lang", F.col("lang_pred")).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies (Jaccard similarity 0.8
    or more of their five-word shingles): the one with the smallest id, null
    last, and of rows with that id one chosen by a hash of the row. Texts
    without words are one component. Equal rows are copies; rows of equal id
    and different texts, and rows of null id, are documents of their own.
    Very long texts count whole; an empty table stays empty; columns other
    than those of documents are dropped."""
    rows = docs.select(*COLUMNS).withColumn("key", row_key())
    rank = F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "key")
    classes = similar_components(rows.select(F.col("doc_id").cast("long").alias("doc_id"), "key", "text"), k=5, low=0.8)
    kept = classes.groupBy("component").agg(F.min(rank).alias("first")).select("first.key")
    return rows.join(kept, "key", "left_semi").dropDuplicates(["key"]).select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines and runs of words that an earlier document has;
    documents that lose all their words go. Null and empty texts stay as they
    are. Null ids are last in rank; rows of equal id and text come out alike;
    very long texts count whole; an empty table stays empty; columns other
    than those of documents are dropped."""
    out = without_lines(docs.select(*COLUMNS))
    out = out.where((F.size("removed") == 0) | F.col("text").rlike(r"\S"))
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it, up to three times. The mix
    decides by row: null ids count like others, texts that share an id are
    decided apart, and equal rows come out as often as their decisions add up
    to. Null and empty texts have size 0 and are taken as often as their
    source's rate has whole units; null is a source of its own, the last. Very
    long texts count whole; an empty table stays empty; columns other than
    those of documents are dropped."""
    rows = docs.select(*COLUMNS).withColumn("key", row_key())
    taken = cube_mix(rows.select(F.col("key").alias("doc_id"), "text", "source")).groupBy(F.col("doc_id").alias("key"))
    taken = taken.agg(F.sum("copies").alias("copies"), F.count("*").alias("rows")).where("copies > 0")
    rows = rows.join(taken, "key")
    rows = rows.where("rows = 1").union(rows.where("rows > 1").dropDuplicates(["key"]))
    return rows.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(*COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of token sequences. Null and empty texts are an end id alone;
    null ids and repeated rows are packed one by one; very long texts become
    many pieces; an empty table gives no piece; other columns are ignored."""
    return harmonic_pack(docs)


STAGES = [
    ("language_id", language_id),
    ("simhash_near_dedup", near_dedup),
    ("line_dedup", line_dedup),
    ("mix_sources", mix),
    ("harmonic_packing", packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the ``documents`` of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
        if before is not None:
            discard(before)
        before = docs
    return docs


#: language models and tokenizers are beyond SQL
ORACLE_SQL = None
