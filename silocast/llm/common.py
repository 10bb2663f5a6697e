"""What the operators share: tables, shared storage, connected components."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where that is unset and everything runs in one process on one machine
    (``local[...]``, as in tests), a temporary folder is made and set, so that
    later calls find it. On a cluster an unset folder is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="silocast-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again.

    Cuts the lineage: work that several later jobs need is done once, and a
    lost executor costs nothing that was finished.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_path = path
    return out


def discard(df: DataFrame) -> None:
    """Deletes the folder of a ``stored`` frame that nothing will read again."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df._stored_path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) for every node of ``edges`` (src, dst longs); root is the
    smallest node reachable.

    Alternates the large-star and small-star steps of Kiveris et al. (2014),
    each a grouped minimum and an equi-join, until the edges are stars whose
    centres are the roots. Each step is stored, so nothing is computed twice.
    Each round lowers the number of edges that are no stars by a constant
    factor, so 60 rounds settle any graph that fits a cluster; a graph that
    did not settle raises an error, and no edge is dropped. The joins are
    plain shuffled joins: a hot centre is split by AQE.
    """
    edges = stored(
        edges.where("src <> dst")
        .select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst"))
        .distinct(),
        "edges",
    )
    last = None
    for _ in range(rounds):
        both = edges.union(edges.select("dst", "src"))
        least = both.groupBy("src").agg(F.least(F.col("src"), F.min("dst")).alias("m")).withColumnRenamed("src", "u")
        large = (
            both.where("dst > src")
            .join(least, F.col("src") == F.col("u"))
            .select(F.col("dst").alias("src"), F.col("m").alias("dst"))
            .distinct()
        )
        least = large.groupBy("src").agg(F.min("dst").alias("m")).withColumnRenamed("src", "u")
        small = (
            large.join(least, F.col("src") == F.col("u"))
            .select(F.explode(F.array(F.struct("src", "m"), F.struct(F.col("dst").alias("src"), "m"))).alias("e"))
            .select("e.src", F.col("e.m").alias("dst"))
            .where("src <> dst")
            .distinct()
        )
        after = stored(small, "edges")
        discard(edges)
        edges = after
        now = edges.agg(
            F.count("*"), F.sum(F.xxhash64("src", "dst").cast("decimal(38,0)"))
        ).first()
        if now == last:
            break
        last = now
    else:
        raise RuntimeError(f"components not settled after {rounds} rounds")
    stars = edges.select(F.col("src").alias("node"), F.col("dst").alias("root"))
    return stars.union(stars.select(F.col("root").alias("node"), "root").distinct())


def ranked(df: DataFrame, key: str, name: str) -> DataFrame:
    """``df`` with ``rank``: each row's gapless number from 0 within its
    ``key`` (a non-null integer column of few values), in partition order.

    Two phases: every partition numbers its own rows and stores them, then the
    counts per (partition, key) give each partition its start. No key's rows
    meet in one task. The numbers are stored, so a lost executor or a second
    reading changes nothing.
    """
    schema = StructType(df.schema.fields + [StructField("pid", LongType()), StructField("n", LongType())])
    names, at = schema.fieldNames(), df.columns.index(key)

    def run(batches):
        pid, seen = TaskContext.get().partitionId(), {}
        for batch in batches:
            keys = batch.column(at).to_numpy(zero_copy_only=False)
            n = np.empty(len(keys), dtype=np.int64)
            for k in np.unique(keys).tolist():
                own = np.flatnonzero(keys == k)
                first = seen.get(k, 0)
                n[own] = np.arange(first, first + len(own))
                seen[k] = first + len(own)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(np.full(len(n), pid, np.int64)), pa.array(n)], names=names
            )

    rows = stored(df.mapInArrow(run, schema), name)
    before = Window.partitionBy(key).orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy(key, "pid").agg(F.count("*").alias("c"))
    starts = starts.select(key, "pid", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("_first"))
    return rows.join(starts, [key, "pid"]).withColumn("rank", F.col("_first") + F.col("n")).drop("pid", "n", "_first")
