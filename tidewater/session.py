"""Session matters that several modules need."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def importable(spark: SparkSession) -> None:
    """Lets Python workers import this package where it is not installed; workers started later see it."""
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if _REPO not in paths:
        env["PYTHONPATH"] = os.pathsep.join([_REPO, *paths])


_own: list[str] = []


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder's path below spark.checkpoint.dir, which driver and executors share.

    Only a local master may go without that setting; it gets a temporary folder, gone when Python ends.
    """
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not (spark.sparkContext.master == "local" or spark.sparkContext.master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        if not _own:
            _own.append(tempfile.mkdtemp(prefix="tidewater-"))
            atexit.register(shutil.rmtree, _own[0], ignore_errors=True)
        root = "file://" + _own[0]
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows of df, written once to the shared folder, for plans that read them several times."""
    path = shared_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
