"""Session helpers shared by all operators."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def session(app: str = "quarrylens", cores: int | str = 8, **conf: str) -> SparkSession:
    """A local session with the settings the tests and the bench use; on a cluster pass an own one instead."""
    base = {
        "spark.sql.shuffle.partitions": str(cores if cores != "*" else 8),
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.driver.memory": "12g",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        # checkpoints go with the frames that hold them
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    }
    b = SparkSession.builder.master(f"local[{cores}]").appName(app)
    for k, v in (base | conf).items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    share_code(spark)
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def share_code(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver has it, whatever folder they start in."""
    env, root = spark.sparkContext.environment, str(Path(__file__).resolve().parents[1])
    have = env.get("PYTHONPATH", "")
    if root not in have.split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (root, have) if x)


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where that is unset and the session is local, a temporary one that goes with the process."""
    sc = spark.sparkContext
    set_ = spark.conf.get("spark.checkpoint.dir", None)
    if set_ is not None:
        return set_
    if sc.getCheckpointDir() is not None:
        return sc.getCheckpointDir().rsplit("/", 1)[0]
    if not (sc.master or "").startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="quarrylens-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder


def _ensure_checkpoint_dir(spark: SparkSession) -> None:
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_folder(spark))


def materialize(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the folder of spark.checkpoint.dir."""
    _ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


# A node of a plan that a shuffle has put out; a path or a column may have such a name, but does not begin a line of the plan.
_SHUFFLED = re.compile(r"(?m)^[\s:+\-|]*(?:\*\(\d+\) )?(?:Exchange|ShuffleQueryStage|AQEShuffleRead)\b")


def spread(df: DataFrame, per_core: int = 3) -> DataFrame:
    """Repartition only where the scan yields fewer partitions than the cores need.

    For operators that burn Python CPU a row. A large scan has partitions enough and is left alone, so
    the extra shuffle never grows with the data. What comes out of a shuffle is left alone too: it is spread
    already, and counting its partitions would run it.
    """
    if _SHUFFLED.search(df._jdf.queryExecution().executedPlan().toString()):
        return df
    want = df.sparkSession.sparkContext.defaultParallelism * per_core
    return df.repartition(want) if df.rdd.getNumPartitions() < want else df
