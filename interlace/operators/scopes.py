"""Scopes of evidence: ranges of consecutive sentences, and what is held out."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Width of the stretches of IDs by which ranges and sentences meet.
STRETCH = 4096


def islands(ids: DataFrame, by: str = "dataset_id", key: str = "sentence_id") -> DataFrame:
    """(by, first_id, last_id, n): runs of consecutive positive IDs of each group.

    A group may hold a third of all rows, so runs are found inside stretches of IDs, and those that meet at a stretch's edge are
    joined afterwards: the second step sees runs, at least STRETCH times fewer where IDs are dense.
    """
    distinct = ids.where((F.col(by) > 0) & (F.col(key) > 0)).select(by, F.col(key).cast("long").alias("id")).distinct()
    near = Window.partitionBy(by, F.floor(F.col("id") / STRETCH)).orderBy("id")
    runs = distinct.withColumn("__g", F.col("id") - F.row_number().over(near)).groupBy(by, F.floor(F.col("id") / STRETCH).alias("__s"), "__g").agg(F.min("id").alias("a"), F.max("id").alias("b"))
    edge = (F.col("a") % STRETCH == 0) | (F.col("b") % STRETCH == STRETCH - 1)
    inner, outer = runs.where(~edge).select(by, "a", "b"), runs.where(edge).select(by, "a", "b")
    order = Window.partitionBy(by).orderBy("a")
    joined = outer.withColumn("__new", (F.col("a") != F.lag("b").over(order) + 1).cast("int")).withColumn("__k", F.sum(F.coalesce("__new", F.lit(1))).over(order))
    whole = joined.groupBy(by, "__k").agg(F.min("a").alias("a"), F.max("b").alias("b")).select(by, "a", "b")
    return inner.unionByName(whole).select(by, F.col("a").alias("first_id"), F.col("b").alias("last_id"), (F.col("b") - F.col("a") + 1).alias("n"))


def without_ranges(df: DataFrame, ranges: DataFrame, by: str = "dataset_id", key: str = "sentence_id") -> DataFrame:
    """The rows of `df` outside the ranges (by, first_id, last_id), both ends included; null keys are outside any.

    Ranges are spread over the stretches of IDs that they touch, so that rows and ranges meet by equality.
    """
    spread = ranges.select(F.col(by).alias("__by"), "first_id", "last_id", F.explode(F.sequence(F.floor(F.col("first_id") / STRETCH), F.floor(F.col("last_id") / STRETCH))).alias("__s"))
    inside = (F.col(by) == F.col("__by")) & (F.floor(F.col(key) / STRETCH) == F.col("__s")) & F.col(key).between(F.col("first_id"), F.col("last_id"))
    return df.join(spread, inside, "left_anti")


def without_texts(df: DataFrame, datasets: DataFrame, texts: DataFrame) -> DataFrame:
    """The rows of `df` whose dataset, and whose text of a dataset, isn't held out."""
    return df.join(datasets.select("dataset_id").distinct(), "dataset_id", "left_anti").join(texts.select("dataset_id", "text_id").distinct(), ["dataset_id", "text_id"], "left_anti")
