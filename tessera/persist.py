"""Cutting lineage in iterative operators."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the checkpoint folder that the executors share.

    The cluster names the folder in spark.checkpoint.dir; where a session on one machine has none
    (tests) a temporary one is made.
    """
    shared_dir(df.sparkSession)
    return df.checkpoint()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = tempfile.mkdtemp(prefix="tessera-")
        spark.sparkContext.setCheckpointDir(_own[app])
    return _own[app]
