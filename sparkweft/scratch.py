"""Written tables in the shared folder of the session."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch_root(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names; in local mode without one, a temporary folder.

    On a cluster the setting is needed: executors and driver don't share local folders.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return tempfile.mkdtemp(prefix="spark-")


class Scratch:
    """Tables of one job. A written table cuts the lineage, outlives lost executors and can be
    read many times; those that a returned DataFrame still reads stay until the folder is cleared."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.base = f"{scratch_root(spark)}/{label}-{uuid.uuid4().hex}"
        self.names: list[str] = []

    def save(self, df: DataFrame, name: str, *by: str) -> DataFrame:
        """Writes the rows, in a folder for each value of ``by``, and reads them again."""
        path = f"{self.base}/{name}"
        df.write.option("compression", "zstd").partitionBy(*by).parquet(path)
        self.names.append(name)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str) -> None:
        """Frees a table that no later step reads."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.base}/{name}")
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def release(self) -> None:
        """Frees shuffled files of steps that are over. Spark removes them when the driver collects its
        garbage, which a driver with room to spare may not do before disks are full."""
        gc.collect()
        self.spark._jvm.System.gc()

    def keep(self, *names: str) -> None:
        """Frees all tables but these."""
        for name in self.names:
            if name not in names:
                self.drop(name)
