"""Intermediate tables in the folder that all executors share. They cut lineage and survive lost executors."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from ..errors import fail


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``. Where it is unset, a folder of our own that goes with the process; only for a local master."""
    sc = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not path:
        if not sc.master.startswith("local"):
            fail("Io", "executors need a shared folder: set spark.checkpoint.dir")
        own = tempfile.mkdtemp(prefix="tallygate-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        sc.setCheckpointDir(own)
        path = sc.getCheckpointDir()
    return path


class Table:
    """A table written as Parquet in the shared folder, there until :meth:`drop`."""

    def __init__(self, df: DataFrame, name: str):
        self.spark, self.schema = df.sparkSession, df.schema
        self.path = f"{shared_folder(self.spark)}/tables/{name}-{uuid.uuid4().hex}"
        df.write.parquet(self.path)

    @property
    def df(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.path)

    def drop(self) -> None:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
