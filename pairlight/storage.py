"""Reliable materialisation: checkpoints go to the folder that the cluster names."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The session's shared checkpoint folder; a temporary one only where the master is local and none is set."""
    sc = spark.sparkContext
    if current := sc.getCheckpointDir():
        return current
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="pairlight-ckpt-")
    sc.setCheckpointDir(named)
    return named


def materialize(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder and read from there: cuts lineage, survives lost executors.

    Written is a compressed parquet table, of which later steps read only the columns they need and whose size the
    planner knows; it is removed when the application ends. Rows keep no order, nor their partitions. What parquet cannot
    hold, void columns and names that differ by case alone, is checkpointed as it is.
    """
    spark = df.sparkSession
    folder = ensure_checkpoint_dir(spark)
    if "void" in str(df.dtypes) or len({c.lower() for c in df.columns}) < len(df.columns):
        return df.checkpoint(eager=True)
    path = f"{folder}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """``df`` over at least as many partitions as there are cores, for costly work on each row.

    A table in a few small files is dealt out anew; one with enough partitions, as any large table has, is left as it is
    and not shuffled. Meant for tables as they are read from files: asking for the partitions plans the table.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)
