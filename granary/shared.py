"""Tables in the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder; a temporary one is taken only where there is none and all runs in one process."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="granary-"))
    return sc.getCheckpointDir()


def parts(spark: SparkSession, rows: int, each: int = 500_000) -> int:
    """How many partitions give every task about `each` of so many rows, and every core one at least.

    A number that is asked for is kept, while partitions of plain joins and sums are merged up to a size in bytes: the
    memory of a task then follows that size, and how well its rows compress.
    """
    return max(spark.sparkContext.defaultParallelism, -(-rows // each))


class Tables:
    """Tables between the steps of one operator. `drop` removes those that nothing reads any more."""

    def __init__(self, spark: SparkSession):
        self.spark, self._path = spark, {}

    def write(self, df: DataFrame) -> DataFrame:
        """The rows of `df`, evaluated once, and safe from lost executors."""
        path = f"{shared_dir(self.spark)}/{uuid.uuid4().hex}"
        df.write.parquet(path)
        table = self.spark.read.schema(df.schema).parquet(path)
        self._path[id(table)] = (table, path)
        return table

    def drop(self, *tables: DataFrame) -> None:
        jvm = self.spark._jvm
        for table in tables:
            path = jvm.org.apache.hadoop.fs.Path(self._path.pop(id(table))[1])
            path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)

    def keep(self, df: DataFrame) -> DataFrame:
        """`df` as the last table; all others go."""
        result = self.write(df)
        self.drop(*[t for t, _ in self._path.values() if t is not result])
        return result
