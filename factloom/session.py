"""Session helpers: reading tables, and cutting lineage through the cluster's shared folder."""

from __future__ import annotations

import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def reachable(spark: SparkSession) -> None:
    """Lets Python workers find this package where it runs from a checkout that is not on their path."""
    root, env = str(Path(__file__).resolve().parents[1]), spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (root, env.get("PYTHONPATH")) if x)


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    reachable(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir; a temporary one only where none is set (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    if found:
        if sc._jsc.sc().getCheckpointDir().isEmpty():
            sc.setCheckpointDir(found)
        return found
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    if not sc.master.startswith("local[") and sc.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    made = tempfile.mkdtemp(prefix="factloom-checkpoint-")
    sc.setCheckpointDir(made)
    return made


def stored(df: DataFrame) -> DataFrame:
    """df with its lineage cut by a table of its own in the checkpoint folder, computed once and compressed; see ``forget``.

    The folder goes when the application ends, if not before.
    """
    spark = df.sparkSession
    home = f"{ensure_checkpoint_dir(spark).rstrip('/')}/tables-{spark.sparkContext.applicationId}"
    place = f"{home}/{uuid.uuid4().hex}"
    names = [f"c{k}" for k in range(len(df.columns))]
    df.toDF(*names).write.option("compression", "zstd").parquet(place)
    path, fs = _hadoop(spark, home)
    fs.deleteOnExit(path)
    out = spark.read.schema(T.StructType([T.StructField(n, f.dataType) for n, f in zip(names, df.schema)])).parquet(place).toDF(*df.columns)
    out._place = place
    return out


cut = stored


def _hadoop(spark: SparkSession, place: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(place)
    return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def forget(df: DataFrame) -> None:
    """Deletes the table behind a result of ``stored`` that nothing will read any more."""
    path, fs = _hadoop(df.sparkSession, df._place)
    fs.delete(path, True)


def spread(df: DataFrame, *by: str) -> DataFrame:
    """df over as many partitions as there are cores, if a scan gives fewer; for work that is heavy a row. ``df`` must be a plain scan or projection."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df._jdf.queryExecution().toRdd().getNumPartitions() >= cores else df.repartition(cores, *by)
