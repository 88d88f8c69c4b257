"""Session defaults and the few runtime helpers every operator shares."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The folder the package lies in.
HOME = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
#: Rows of a side that may be broadcast without asking the optimiser; beyond it the join shuffles.
BROADCAST_ROWS = 200_000


def session(app: str = "colloquy", cores: str = "*", **conf: str) -> SparkSession:
    """A local session with the settings the tests and the bench use."""
    b = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
    )
    for k, v in conf.items():
        b = b.config(k.replace("__", "."), v)
    return b.getOrCreate()


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` once into the shared checkpoint folder and go on from there.

    The folder is the one the cluster names in ``spark.checkpoint.dir``. Only where that is unset
    and the master is a single local process does this make a temporary one.
    """
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        named = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if named:
            sc.setCheckpointDir(named)
        elif sc.master.startswith("local["):
            made = tempfile.mkdtemp(prefix="colloquy-ckpt-")
            atexit.register(shutil.rmtree, made, True)
            sc.setCheckpointDir(made)
        else:
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return df.checkpoint(eager=True)


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``rows`` rows, else unchanged."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def reachable(spark: SparkSession) -> None:
    """Let Python workers import the package from the folder the driver has it in.

    That serves one machine and shared folders, whatever the working directory; elsewhere the package is
    shipped with --py-files.
    """
    includes = getattr(spark.sparkContext, "_python_includes", None)
    if includes is not None and HOME not in includes:
        includes.append(HOME)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One parquet table of a data folder."""
    reachable(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slots(spark: SparkSession) -> int:
    """Tasks that run at once, for fanning a small input out to Python work."""
    return max(2, spark.sparkContext.defaultParallelism)


def fan(df: DataFrame, *cols: str) -> DataFrame:
    """``df`` by hash of ``cols`` (or at random) over at least all task slots.

    Adaptive execution merges shuffle partitions by their bytes; before work in Python, whose cost is
    not in the bytes, they are kept apart.
    """
    spark = df.sparkSession
    n = max(slots(spark), int(spark.conf.get("spark.sql.shuffle.partitions")))
    return df.repartition(n, *cols)


def spread(df: DataFrame) -> DataFrame:
    """``df``, a scan, over all task slots if it was read in fewer partitions, else unchanged.

    A large table is read in many partitions and stays as it is; only a small one is dealt out anew
    before work in Python.
    """
    n = slots(df.sparkSession)
    return df.repartition(n) if df.rdd.getNumPartitions() < n else df
