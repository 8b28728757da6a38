"""Durable lineage cuts.

Iterative plans and results that several later steps read are cut with
``checkpoint()``: the files go to the folder the cluster names in
``spark.checkpoint.dir``, which outlives any executor.
"""

from __future__ import annotations

import functools
import itertools
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from typing import TypeVar

from pyspark.sql import DataFrame, SparkSession


def checkpoint_dir(spark: SparkSession) -> str:
    """The session's shared checkpoint folder.

    A folder of our own is set only where none is named and driver and
    executors are one machine (tests, notebooks); a cluster has to name one.
    """
    context = spark.sparkContext._jsc.sc()
    current = context.getCheckpointDir()
    if current.isDefined():
        return current.get()
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
    spark.sparkContext.setCheckpointDir(named or tempfile.mkdtemp(prefix="gridloom-"))
    return context.getCheckpointDir().get()


#: With this setting Spark removes an execution's shuffle files when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

Made = TypeVar("Made", bound=Callable[..., DataFrame])


def tidy(operator: Made) -> Made:
    """Let each step of an operator remove its shuffle files when it ends.

    For operators that cut what they read again. Their result is a plan made
    under the session's own setting, so it can be run any number of times.
    """

    @functools.wraps(operator)
    def run(df: DataFrame, *args, **kwargs) -> DataFrame:
        conf = df.sparkSession.conf
        before = conf.get(CLEANUP, "false")
        conf.set(CLEANUP, "true")
        try:
            result = operator(df, *args, **kwargs)
        finally:
            conf.set(CLEANUP, before)
        return result.select("*")

    return run


def cut(df: DataFrame) -> DataFrame:
    """Compute ``df`` once, keep it in the checkpoint folder, forget its lineage."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[str]:
    """A folder below the checkpoint folder, removed on leaving.

    For written tables that only the work inside needs; what leaves has to be
    cut.
    """
    folder = f"{checkpoint_dir(spark)}/scratch-{uuid.uuid4().hex}"
    try:
        yield folder
    finally:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def written(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """A function that computes a frame once as a written table of the shared folder; the tables go on leaving, what leaves has to be cut.

    For loops that join what they have made with itself: a checkpoint keeps
    the planner's estimate of a frame's size, which such joins square in each
    round, a table has the size of its files and is broadcast while small.
    """
    with scratch(spark) as folder:
        names = itertools.count()

        def keep(df: DataFrame) -> DataFrame:
            path = f"{folder}/{next(names)}"
            df.write.parquet(path)
            return spark.read.schema(df.schema).parquet(path)

        yield keep
