"""Tables written to the shared checkpoint folder, to cut lineage and share results of a scan."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a temporary one only where that setting is absent, as in tests."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = f"file://{_local_folder()}"
    return folder.rstrip("/")


_made: list[str] = []


def _local_folder() -> str:
    if not _made:
        _made.append(tempfile.mkdtemp(prefix="pagelens-"))
    return _made[0]


class Scratch:
    """Intermediate tables of one operator call. They outlive lost executors, as each is Parquet in the shared folder."""

    def __init__(self, spark: SparkSession, owner: str):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/pagelens/{owner}-{uuid.uuid4().hex}"
        self._count = 0

    def table(self, df: DataFrame, name: str = "t") -> DataFrame:
        """Runs the plan of df once and gives a DataFrame that reads the rows it made."""
        self._count += 1
        path = f"{self.root}/{self._count:02d}-{name}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path  # type: ignore[attr-defined]
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Deletes tables that nothing reads any more."""
        jvm = self.spark.sparkContext._jvm
        for df in tables:
            where = jvm.org.apache.hadoop.fs.Path(df._scratch_path)
            where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
