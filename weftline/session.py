"""Session helpers: the shared checkpoint folder and table loading."""

from __future__ import annotations

import os
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession

#: Settings for local tests and benches; on a cluster the submitter's own settings hold.
LOCAL_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.showConsoleProgress": "false",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def local_session(cores: int | str = 8, shuffle: int = 8, memory: str = "8g") -> SparkSession:
    """A local session for tests, benches and the command line."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("weftline")
    for key, value in LOCAL_CONF.items():
        builder = builder.config(key, value)
    return (
        builder.config("spark.sql.shuffle.partitions", str(shuffle))
        .config("spark.driver.memory", memory)
        .getOrCreate()
    )


def session() -> SparkSession:
    """The submitter's session, or a local one on all cores where no master is set."""
    if SparkSession.getActiveSession() is not None or os.environ.get("MASTER") or "--master" in os.environ.get("PYSPARK_SUBMIT_ARGS", "") or os.environ.get("SPARK_ENV_LOADED"):
        return SparkSession.builder.appName("weftline").getOrCreate()
    return local_session("*")


def shared_dir(spark: SparkSession) -> str:
    """The folder for checkpoints that all executors share.

    The cluster names it in ``spark.checkpoint.dir``. Only where that is unset, as in local tests, a folder of
    this machine is made.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        named = getattr(shared_dir, "_local", None) or tempfile.mkdtemp(prefix="weftline-")
        shared_dir._local = named
    return named


def checkpoint(df: DataFrame, eager: bool = True) -> DataFrame:
    """Cut the lineage of ``df`` with a reliable checkpoint in the shared folder."""
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint(eager)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the Parquet tables of a data folder."""
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def spread(df: DataFrame) -> DataFrame:
    """``df`` over at least as many tasks as there are cores; data of more input splits than that stay where they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(2 * cores) if df.rdd.getNumPartitions() < cores else df


def ship(spark: SparkSession) -> None:
    """Send the package to Python workers that would not find it by their own path."""
    context = spark.sparkContext
    if getattr(context, "_weftline_shipped", False):
        return
    package = os.path.dirname(os.path.abspath(__file__))
    folder = tempfile.mkdtemp(prefix="weftline-package-")
    archive = shutil.make_archive(os.path.join(folder, "weftline-package"), "zip", os.path.dirname(package), os.path.basename(package))
    context.addPyFile(archive)
    context._weftline_shipped = True
