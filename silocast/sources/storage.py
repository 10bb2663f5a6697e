"""Frames that are written once and read many times, in the shared folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: rows up to which a side of a join is broadcast
BROADCAST_ROWS = 100_000


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share; where none is
    named and all runs on one machine, in a temporary one. The application's
    folder goes when it ends."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        top = "file://" + tempfile.mkdtemp(prefix="silocast-")
        spark.conf.set("spark.checkpoint.dir", top)
    own = spark._jvm.org.apache.hadoop.fs.Path(f"{top.rstrip('/')}/silocast-{spark.sparkContext.applicationId}")
    files = own.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(own):
        files.mkdirs(own)
        files.deleteOnExit(own)
    return f"{own.toString()}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str = "frame") -> DataFrame:
    """``df`` written to a new path and read from there: what several later
    jobs need is worked out once, and its rows stay as they are."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def sized(df: DataFrame, name: str = "small", most: int = BROADCAST_ROWS) -> DataFrame:
    """``df``, stored, and marked for broadcast if it has ``most`` rows at most."""
    seen = Observation()
    out = stored(df.observe(seen, F.count("*").alias("n")), name)
    return F.broadcast(out) if seen.get["n"] <= most else out
