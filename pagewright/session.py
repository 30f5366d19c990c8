"""Session helpers shared by all operators."""

from __future__ import annotations

import sys
import uuid

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

_FALLBACK_CHECKPOINTS = "file:///tmp/pagewright-checkpoints"


def ship_package() -> None:
    """Let worker functions travel with the plan, so that executors need no copy of the package."""
    cloudpickle.register_pickle_by_value(sys.modules[__name__.partition(".")[0]])


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``. Where it is unset, a local folder serves a local master, as in tests; on a cluster that is an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    master = spark.sparkContext.master
    if not folder and not (master == "local" or master.startswith("local[")):
        raise ValueError(f"spark.checkpoint.dir isn't set: the executors of {master} need a folder that they share")
    return folder or _FALLBACK_CHECKPOINTS


def scratch(spark: SparkSession, kind: str) -> str:
    """A new folder in the shared one, which is deleted when the application ends."""
    folder = f"{shared_folder(spark)}/{kind}-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    system = path.getFileSystem(spark._jsc.hadoopConfiguration())
    system.mkdirs(path)
    system.deleteOnExit(path)
    return folder


def delete(spark: SparkSession, folder: str) -> None:
    """Delete a folder that nothing reads any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def durable(df: DataFrame) -> DataFrame:
    """Cut the lineage by a reliable checkpoint in the shared folder."""
    safe_unions(df.sparkSession)
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def safe_unions(spark: SparkSession) -> None:
    """Spark 4.1 can take a union of parts that are partitioned alike for partitioned itself, and then lose rows of a group; that is turned off."""
    spark.conf.set("spark.sql.unionOutputPartitioning", "false")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    safe_unions(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
