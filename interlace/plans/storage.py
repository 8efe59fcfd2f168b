"""Written intermediate tables and size checks shared by the operators."""

from __future__ import annotations

import re
import tempfile
import uuid
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side may be broadcast, or collected, up to so many bytes; beyond, the operators join by shuffling.
BROADCAST_BYTES = 32 * 1024 * 1024


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: the session's spark.checkpoint.dir. Only where it is unset and all tasks run in this
    process, as in tests, a folder of its own."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


class Written:
    """The tables that operators wrote inside a `with`: `drop` deletes them, once no result that reads them is needed.

    with Written(spark) as tables:
        result = operator(...)
    result.write.parquet(...)
    tables.drop()
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def __enter__(self) -> Written:
        self._before = _CURRENT.set(self.paths)
        return self

    def __exit__(self, *_) -> None:
        _CURRENT.reset(self._before)

    def drop(self) -> int:
        """Deletes the tables; returns their number."""
        n = len(self.paths)
        while self.paths:
            path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.paths.pop())
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        return n


_CURRENT: ContextVar[list[str] | None] = ContextVar("written", default=None)


def written(df: DataFrame, name: str) -> DataFrame:
    """`df` written once as a compressed table in the shared folder and read back: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    held = _CURRENT.get()
    if held is not None:
        held.append(path)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fits(df: DataFrame, size: str, bytes_: int = BROADCAST_BYTES) -> bool:
    """Whether the rows of `df`, each of `size` (an SQL expression) bytes, fit in `bytes_`. Runs a count; `df` should be a written table."""
    total = df.agg(F.sum(F.expr(f"cast({size} as bigint) + 16"))).first()[0]
    return (total or 0) <= bytes_
