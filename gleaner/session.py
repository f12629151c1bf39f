"""Session set-up, table access and scratch storage shared by all operators."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "8", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A local session for tests and benchmarks; on a cluster the caller brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("gleaner")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ship(spark: SparkSession) -> None:
    """Let the Python workers import this package, wherever the driver was started.

    Nothing is done where PYTHONPATH names it already, as on a cluster where it is installed. Else the
    path is handed to the workers, and a cluster is sent the package as an archive.
    """
    context, root = spark.sparkContext, str(Path(__file__).resolve().parent.parent)
    if getattr(context, "_gleaner_shipped", False) or root in os.environ.get("PYTHONPATH", "").split(":"):
        return
    context.environment["PYTHONPATH"] = ":".join(filter(None, [root, context.environment.get("PYTHONPATH", "")]))
    if not context.master.startswith("local"):
        folder = tempfile.mkdtemp()
        context.addPyFile(shutil.make_archive(f"{folder}/gleaner", "zip", root, "gleaner"))
        shutil.rmtree(folder)
    context._gleaner_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """A stored table, narrowed to the named columns so that the scan reads only those."""
    ship(spark)
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def spread(df: DataFrame) -> DataFrame:
    """A plain scan in at least as many partitions as half the cores, for costly work on each row.

    Only a small input, in fewer files and splits than that, is shuffled; a large one has enough.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if 2 * df.rdd.getNumPartitions() < cores else df


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder for cut lineage.

    It is the one the session names in ``spark.checkpoint.dir``. Only a local master, as in tests,
    falls back to a temporary folder of this machine; a cluster without the setting is an error.
    """
    context = spark.sparkContext
    named = context.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not context.master.startswith("local[") and context.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    named = tempfile.mkdtemp(prefix="gleaner-")
    atexit.register(shutil.rmtree, named, True)
    context.setCheckpointDir(named)
    return context.getCheckpointDir()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, below one folder for each application."""
    return f"{scratch_dir(spark)}/gleaner/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def clear_scratch(spark: SparkSession) -> None:
    """Delete all that this application wrote to the shared folder; results that still read it can't be used any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{scratch_dir(spark)}/gleaner/{spark.sparkContext.applicationId}")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def materialise(df: DataFrame, name: str = "step") -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts the lineage, so a lost executor costs only the tasks it ran, and gives the planner the
    true size of the step.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._scratch_path = path
    return back


def discard(df: DataFrame) -> None:
    """Delete what ``materialise`` wrote for ``df``; only for steps that nothing reads any more."""
    path = getattr(df, "_scratch_path", None)
    if path is None:
        return
    jvm_path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(jvm_path, True)
