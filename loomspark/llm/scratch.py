"""Intermediate tables in the folder that the cluster shares.

Iterative operators cut their lineage by writing a table and reading it again.
The folder is the one named by ``spark.checkpoint.dir``; a private one is made
only where that setting is missing (tests, single machines).
"""

from __future__ import annotations

import atexit
import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder for intermediate tables, as a Hadoop path."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    made = tempfile.mkdtemp(prefix="loomspark-")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the session is gone; its folder goes with it
        return


class Scratch:
    """Tables written during one run of an operator.

    ``save`` writes and rereads; ``drop`` removes a table that nothing needs any
    more.  What is left (a lazily returned result may still read it) goes when
    the interpreter ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{checkpoint_root(spark)}/{name}-{uuid.uuid4().hex}"
        self._n = 0
        self._paths: dict[int, str] = {}
        atexit.register(_remove, spark, self.root)

    def save(self, frame: DataFrame) -> DataFrame:
        self._n += 1
        path = f"{self.root}/{self._n:03d}"
        frame.write.option("compression", "zstd").parquet(path)
        again = self.spark.read.schema(frame.schema).parquet(path)
        self._paths[id(again)] = path
        return again

    def tidy(self) -> None:
        """Let the session's cleaner remove the shuffles of plans that nothing refers to any more.

        It does so when the driver collects garbage, which in a long iteration may come late.
        The session refers to its last plan, so that has to be another one.
        """
        self.spark.range(1).count()
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()

    def drop(self, frame: DataFrame) -> None:
        path = self._paths.pop(id(frame), None)
        if path:
            _remove(self.spark, path)
