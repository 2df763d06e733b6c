"""Helpers shared by the training-data operators: tables, shared folder, keys."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_KEY = "spark.checkpoint.dir"
#: Drops the shuffle files of a query when it ends; a staged table no longer needs them.
CLEANUP_KEY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the cluster names it.

    Only a local master, where everything runs in one process on one machine,
    may go without the setting; it then gets a temporary folder.
    """
    base = spark.conf.get(CHECKPOINT_KEY, None)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError(f"{CHECKPOINT_KEY} must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="ledgerline-")
        spark.conf.set(CHECKPOINT_KEY, base)
    return base.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/ledgerline-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
    before = spark.conf.get(CLEANUP_KEY, "false")
    spark.conf.set(CLEANUP_KEY, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(CLEANUP_KEY, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._ledgerline_path = path
    return out


def unstage(*frames: DataFrame) -> None:
    """Delete staged tables that no later plan reads."""
    for df in frames:
        if path := getattr(df, "_ledgerline_path", None):
            jvm = df.sparkSession.sparkContext._jvm
            conf = df.sparkSession.sparkContext._jsc.hadoopConfiguration()
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(conf).delete(p, True)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: A key is heavy when it holds this share of the rows, so at most 1 / HEAVY_SHARE keys are.
HEAVY_SHARE = 0.002


def attach_by_key(rows: DataFrame, groups: DataFrame, keys: Sequence[str], count: str, n_rows: int, spread: Column) -> DataFrame:
    """Left-join one row per key onto ``rows`` without dealing a hot key to one task.

    ``groups`` (one row per key) has the number of rows of each key in ``count``.
    Keys with at least HEAVY_SHARE of ``n_rows`` go by a broadcast of at most
    1 / HEAVY_SHARE rows.  Their rows then carry a unique value in the extra
    join key ``spread``, so that the shuffled join deals them evenly.
    """
    least = max(1000, int(n_rows * HEAVY_SHARE))
    values = [c for c in groups.columns if c not in keys]
    heavy = groups.where(F.col(count) >= least).select(*keys, F.struct(*values).alias("_heavy"))
    light = groups.where(F.col(count) < least).select(*keys, F.struct(*values).alias("_light"), F.lit(0).cast("long").alias("_spread"))
    marked = rows.join(F.broadcast(heavy), list(keys), "left")
    marked = marked.withColumn("_spread", F.when(F.col("_heavy").isNull(), F.lit(0).cast("long")).otherwise(F.xxhash64(spread).bitwiseOR(F.lit(1).cast("long"))))
    joined = marked.join(light, [*keys, "_spread"], "left")
    picked = F.coalesce(F.col("_heavy"), F.col("_light"))
    return joined.select(*rows.columns, *[picked[v].alias(v) for v in values])
