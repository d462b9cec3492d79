"""What the operators of this package share."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Checkpoint into the shared folder that the session names in spark.checkpoint.dir.

    Where none is named, a cluster gets an error: a machine's own folder would be lost with it. Only a session of a
    single machine (tests) gets a folder of its own, which goes when the program ends. Spark removes checkpoints that
    are out of use if spark.cleaner.referenceTracking.cleanCheckpoints is set.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        shared = context.getConf().get("spark.checkpoint.dir")
        if not shared:
            if not re.match(r"local(\[|$)", context.master):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            shared = tempfile.mkdtemp(prefix="spark-checkpoint-")
            atexit.register(shutil.rmtree, shared, ignore_errors=True)
        context.setCheckpointDir(shared)
    return df.checkpoint(eager=True)


def model_path(name: str) -> str:
    """A trained model's file beside this module."""
    return os.path.join(os.path.dirname(os.path.abspath(__file__)), "models", name)
