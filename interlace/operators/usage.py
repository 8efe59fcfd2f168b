"""Tokens used by calls to models: totals, by model and by task, by hour."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COUNTS = ("input_tokens", "cached_tokens", "output_tokens", "reasoning_tokens", "total_tokens")


def _sums() -> list[Column]:
    return [F.count("*").alias("calls"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in COUNTS]]


def distinct_calls(calls: DataFrame) -> DataFrame:
    """Calls without their exact duplicates."""
    return calls.dropDuplicates()


def rollup(calls: DataFrame, jobs: DataFrame) -> DataFrame:
    """(level, model_name, task, sums): all calls, by model, and by the task of their job, in one pass over the calls."""
    rows = distinct_calls(calls).join(jobs.select(F.col("id").alias("job_id"), "task"), "job_id", "left")
    named = rows.withColumns({"model_name": F.coalesce("model_name", F.lit("unknown")), "task": F.coalesce("task", F.lit("unknown"))})
    sets = named.groupingSets([[], [F.col("model_name")], [F.col("task")]], F.col("model_name"), F.col("task")).agg(F.grouping_id().alias("g"), *_sums())
    level = F.when(F.col("g") == 3, "total").when(F.col("g") == 1, "model").otherwise("task")
    return sets.select(level.alias("level"), F.coalesce("model_name", F.lit("")).alias("model_name"), F.coalesce("task", F.lit("")).alias("task"), "calls", *COUNTS)


def by_hour(calls: DataFrame) -> DataFrame:
    """(hour, model_name, sums) of the calls; also of a stream with a watermark on called_at."""
    w = F.window("called_at", "1 hour")
    return calls.where("called_at is not null").groupBy(w.alias("w"), "model_name").agg(*_sums()).select(F.col("w.start").alias("hour"), "model_name", "calls", *COUNTS)
