"""Session helpers: settings, table loading, checkpoints."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def get_spark(master: str = "local[8]", name: str = "wirelake", **conf: str) -> SparkSession:
    """A session with the settings the engine is written for; ``conf`` overrides them."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.execution.arrow.maxRecordsPerBatch": "10000",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    } | conf
    builder = SparkSession.builder.master(master).appName(name)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the parquet tables of a directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _shared_folder(spark: SparkSession) -> str:
    """The shared folder for intermediate tables and checkpoints.

    A cluster names it in ``spark.checkpoint.dir``. Only a session on one machine that names none gets
    a folder of its own, as in tests; on a cluster that would be a folder of one machine, so it raises.
    """
    sc = spark.sparkContext
    known = sc._jsc.sc().getCheckpointDir()
    if known.isEmpty():
        named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        if not named:
            named = tempfile.mkdtemp(prefix="wirelake-", dir=os.environ.get("TMPDIR"))
            atexit.register(shutil.rmtree, named, True)
        sc.setCheckpointDir(named)
        known = sc._jsc.sc().getCheckpointDir()
    return known.get()


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage of ``df``, a small one, through the shared folder."""
    _shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def kept(df: DataFrame) -> DataFrame:
    """``df`` written as a table of the shared folder and read from there, for rows that are read more
    than once: later passes prune columns, and lost executors cost nothing but the pass. The table goes
    when the session ends."""
    spark = df.sparkSession
    path = f"{_shared_folder(spark)}/kept-{uuid.uuid4().hex}"
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    df.write.parquet(path)
    jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jvm_path)
    return spark.read.schema(df.schema).parquet(path)


def forget(df: DataFrame) -> None:
    """Remove the files of a :func:`kept` table that is read no more."""
    spark = df.sparkSession
    for name in {name.rpartition("/")[0] for name in df.inputFiles()}:
        jvm_path = spark._jvm.org.apache.hadoop.fs.Path(name)
        jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jvm_path, True)


def shuffle_width(spark: SparkSession) -> int:
    """Number of partitions that a shuffle of the session makes."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def small_side(df: DataFrame, most_rows: int = 200_000) -> DataFrame:
    """``df`` with a broadcast hint if it is small, which is found out by counting its rows; as it is
    otherwise, so that Spark chooses a join that shuffles. ``df`` should be cheap to count, such as
    one read back from a checkpoint."""
    return F.broadcast(df) if df.limit(most_rows + 1).count() <= most_rows else df


def spread(df: DataFrame) -> DataFrame:
    """``df`` over at least as many partitions as there are cores, for work in Python that costs far
    more than moving the rows. Inputs of that many splits stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
