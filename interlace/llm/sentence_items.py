"""The annotation IDs of each distinct sentence."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from interlace.operators.packed import rules_of, with_values
from interlace.plans.storage import written


def sentence_items(sentences: DataFrame, control: tuple[str, ...] = ("r", "?")) -> DataFrame:
    """(sentence_id, ids): the values of each distinct sentence's annotation in order, without control IDs; written once. Copies of a
    sentence hold the same annotation, and are one after a `distinct` that combines them before the shuffle."""
    given = sentences.where("annotation is not null and annotation <> ''").select("sentence_id", "annotation")
    ids = with_values(given.distinct(), {"annotation": "ids"}, rules_of(given, ["annotation"]))
    return written(ids.select("sentence_id", F.filter("ids", lambda x: ~x.isin(*control)).alias("ids")).where(F.size("ids") > 0), "sentence-items")
