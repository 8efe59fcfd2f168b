"""Usage counted from a stream of calls."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from interlace.operators.usage import by_hour


def hourly_usage(spark: SparkSession, path: str, schema, late: str = "21 days") -> DataFrame:
    """Tokens by hour and model from Parquet files as they arrive. Calls that were sent twice count once while the watermark holds
    them; calls later than `late` are dropped."""
    calls = spark.readStream.schema(schema).parquet(path)
    return by_hour(calls.withWatermark("called_at", late).dropDuplicates(["call_id", "called_at"]))
