"""Frequency of every distinct term, by a range-partitioned sort of (term, record) pairs and a run-length scan.

Pairs that recur are first combined batch by batch in each map task, so that one that is repeated very often stays small; then they
are range-partitioned on term and record together, the one shuffle of the pairs, so that a term of any frequency spreads over as many
partitions as it needs, while all pairs of one term and record meet. Each partition is sorted (Spark spills to disk as it must) and
scanned once: the ends of runs give occurrences and distinct records. Terms cut by a partition's edge have partial results on either
side, which the last, small aggregation adds.

Defined cases: null terms and null records are left out; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per run of equal terms in sorted batches (term, record, n): the term, the sum of n, and the changes of record."""
    open_term, open_record = None, None
    occurrences = records = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        runs = pc.run_end_encode(batch.column(0))
        ends = np.asarray(runs.run_ends, np.int64)
        starts = np.r_[0, ends[:-1]]
        code = batch.column(1)
        fresh = np.r_[True, np.asarray(pc.not_equal(code[1:], code[:-1]))] if len(code) > 1 else np.array([True])
        fresh[starts] = True
        n = np.add.reduceat(np.asarray(batch.column(2), np.int64), starts)
        distinct = np.add.reduceat(fresh.astype(np.int64), starts)
        terms = runs.values.to_pylist()
        if open_term is not None and terms[0] == open_term:
            n[0] += occurrences
            distinct[0] += records - int(code[0].as_py() == open_record)
        elif open_term is not None:
            yield pa.RecordBatch.from_arrays([pa.array([open_term], pa.string()), pa.array([occurrences]), pa.array([records])], ["term", "n", "r"])
        open_term, open_record, occurrences, records = terms[-1], code[len(code) - 1].as_py(), int(n[-1]), int(distinct[-1])
        if len(terms) > 1:
            yield pa.RecordBatch.from_arrays([pa.array(terms[:-1], pa.string()), pa.array(n[:-1]), pa.array(distinct[:-1])], ["term", "n", "r"])
    if open_term is not None:
        yield pa.RecordBatch.from_arrays([pa.array([open_term], pa.string()), pa.array([occurrences]), pa.array([records])], ["term", "n", "r"])


def _combined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each pair of a batch once, with its number."""
    for batch in batches:
        found = pa.table({"term": batch.column(0), "record": batch.column(1)}).group_by(["term", "record"]).aggregate([([], "count_all")])
        yield from found.rename_columns(["term", "record", "n"]).to_batches()


def term_frequencies(pairs: DataFrame, term: str, record: str) -> DataFrame:
    """(term, occurrences, n_records) from one row per occurrence; `record` may be of any type that orders."""
    each = pairs.select(F.col(term).cast("string").alias("term"), F.col(record).alias("record")).where("term is not null and record is not null")
    counted = each.mapInArrow(_combined, f"term string, record {each.schema['record'].dataType.simpleString()}, n long")
    runs = counted.repartitionByRange("term", "record").sortWithinPartitions("term", "record").mapInArrow(_scan, "term string, n long, r long")
    return runs.groupBy("term").agg(F.sum("n").alias("occurrences"), F.sum("r").alias("n_records"))


def frequency_mark(n_records: Column | str, total: Column, rare_below: int = 3, common_share: float = 1 / 20) -> Column:
    """'rare' below so many records, else 'common' above that share of all records, else null."""
    n = F.col(n_records) if isinstance(n_records, str) else n_records
    return F.when(n < rare_below, "rare").when(n * round(1 / common_share) > total, "common")
