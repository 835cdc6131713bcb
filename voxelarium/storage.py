"""Where derived tables and checkpoints go: the folder the cluster shares."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    """Folder named by ``spark.checkpoint.dir``.

    A local session without the setting gets a fresh temporary folder; on a
    cluster a missing setting is an error, since a local folder would be lost
    with its machine.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        context = spark.sparkContext
        root = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
        if not root:
            if not context.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a shared folder")
            root = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


# Folders made inside each open ``scratch``, innermost last.
_OWNED: list[list[str]] = []


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Own the folders made inside and remove them at the end.

    Results that read intermediate tables have to be written or collected before.
    """
    made: list[str] = []
    _OWNED.append(made)
    try:
        yield
    finally:
        _OWNED.pop()
        context = spark.sparkContext
        for folder in made:
            path = context._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def new_folder(spark: SparkSession, purpose: str) -> str:
    """Unused path below the shared folder, owned by the innermost ``scratch``."""
    folder = f"{shared_root(spark)}/{purpose}-{uuid.uuid4().hex}"
    if _OWNED:
        _OWNED[-1].append(folder)
    return folder


def materialise(df: DataFrame, purpose: str) -> DataFrame:
    """Write an intermediate result that several passes read, and read it back.

    Unlike a cache it needs no executor memory and outlives lost executors; its
    size is known to the planner.  Without a ``scratch`` around it the folder
    stays until the shared root is cleaned.
    """
    path = new_folder(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cut_lineage(df: DataFrame) -> DataFrame:
    """``df`` written and read back; iterative jobs call it once per round."""
    return materialise(df, "round")
