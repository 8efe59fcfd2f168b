"""Records of items as arrays of codes, for the operators that count with bit vectors."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from interlace.plans.storage import fits, written


@dataclass
class Encoded:
    """records: (codes array<long>), items in record order, without those left out; vocabulary: (item, code, n_records), written."""

    records: DataFrame
    vocabulary: DataFrame
    n_records: int
    n_items: int


def encode(records: DataFrame, items: str, min_count: int, min_share: float) -> Encoded:
    """Codes for the items of `records` (one array per record, written table) that occur in at least `min_count` records and in
    a share of `min_share` of the records that have any item. Rarer items can be in no pair or pattern of that support; null items
    are left out.

    Their number is at most the mean number of items per record over `min_share`, but items may be long: they are sent to the tasks
    only if their measured bytes allow, and otherwise looked up by a shuffled join.
    """
    records = records.select(F.filter(items, lambda x: x.isNotNull()).alias("items")).where(F.size("items") > 0)
    n = records.count()
    least = max(min_count, -(-int(round(n * min_share * 1e9)) // 10**9), 1)
    counts = records.select(F.explode(F.array_distinct("items")).alias("item")).groupBy("item").agg(F.count("*").alias("n_records")).where(F.col("n_records") >= least)
    vocabulary = written(counts.select("item", F.monotonically_increasing_id().alias("code"), "n_records"), "vocabulary")
    n_items = vocabulary.count()
    if fits(vocabulary, "octet_length(item) + 24"):
        coded = _looked_up(records, vocabulary)
    else:
        each = records.withColumn("record", F.monotonically_increasing_id()).select("record", F.posexplode("items").alias("at", "item"))
        coded = each.join(vocabulary.select("item", "code"), "item").groupBy("record").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "code"))), lambda x: x["code"]).alias("codes")).select("codes")
    return Encoded(coded.where(F.size("codes") > 0), vocabulary, n, n_items)


def _looked_up(records: DataFrame, vocabulary: DataFrame) -> DataFrame:
    table = vocabulary.select("item", "code").toArrow()
    items, codes = table.column("item").combine_chunks(), np.asarray(table.column("code"), np.int64)
    sent = records.sparkSession.sparkContext.broadcast((items, codes))

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, codes = sent.value
        for batch in batches:
            lists = batch.column(0)
            at = pc.index_in(lists.flatten().cast(items.type), value_set=items)
            known = np.asarray(at.is_valid())
            before = np.r_[0, np.cumsum(known)]
            ends = np.asarray(lists.offsets, np.int64) - lists.offsets[0].as_py()
            own = codes[np.asarray(at.drop_null(), np.int64)] if len(codes) else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(before[ends].astype(np.int32)), pa.array(own))], ["codes"])

    return records.select("items").mapInArrow(look_up, "codes array<long>")
