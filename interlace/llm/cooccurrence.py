"""Items that appear together: pair counts and lift by heavy-light decomposition.

Within a block of records, the few frequent (heavy) items form a dense bit matrix whose rows are intersected and popcounted; pairs
of rare (light) items are counted by hashing; mixed pairs are counted by probing the bit matrix with each light item's list of
records. Blocks give partial counts, which Spark sums.

A block ends before its bit matrix has more than CELLS cells or its light items form more than BUFFER pairs; counts are handed on as
soon as BUFFER pairs have been found, so a record of any number of items needs no more memory than that and its own items.

Defined cases: an item counts once per record; null and empty records count for nothing; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from interlace.llm.encoding import encode
from interlace.plans.storage import fits

BLOCK = 32_768  # most records of a block
CELLS = 8_000_000  # of a bit matrix, a byte each while it is filled
BUFFER = 1_000_000  # pairs counted at a time

Counts = tuple[np.ndarray, np.ndarray, np.ndarray]


def _counted(keys: list[np.ndarray], names: np.ndarray, counts: list[np.ndarray] | None = None) -> Counts:
    """(a, b, n) of pairs of local codes, each pair once."""
    width = np.int64(len(names))
    k, inverse, n = np.unique(np.concatenate(keys), return_inverse=True, return_counts=True)
    if counts is not None:
        n = np.bincount(inverse, weights=np.concatenate(counts), minlength=len(k)).astype(np.int64)
    a, b = names[k // width], names[k % width]
    return np.minimum(a, b), np.maximum(a, b), n.astype(np.int64)


def count_block(offsets: np.ndarray, codes: np.ndarray, heavy: np.ndarray) -> Iterator[Counts]:
    """(a, b, n): records of the block that hold both codes, a < b, in parts. offsets: where each record's codes begin; heavy: sorted
    codes."""
    if not len(codes):
        return
    n_rec = len(offsets) - 1
    names, local = np.unique(codes, return_inverse=True)
    width = np.int64(len(names))
    pairs = np.unique(np.repeat(np.arange(n_rec), np.diff(offsets)) * width + local)  # an item once a record
    rec, local = pairs // width, pairs % width
    is_heavy = np.isin(names, heavy)
    row_of = np.cumsum(is_heavy) - 1
    h_names, n_heavy = np.flatnonzero(is_heavy), int(is_heavy.sum())
    hot = is_heavy[local]
    l_rec, l_item = rec[~hot], local[~hot]

    if n_heavy:
        dense = np.zeros((n_heavy, -(-n_rec // 64) * 64), np.uint8)
        dense[row_of[local[hot]], rec[hot]] = 1
        bits = np.packbits(dense, axis=1).view(np.uint64)
        keys: list[np.ndarray] = []
        counts: list[np.ndarray] = []
        kept = 0
        for i in range(n_heavy - 1):
            both = np.bitwise_count(bits[i] & bits[i + 1 :]).sum(axis=1, dtype=np.int64)
            hit = np.flatnonzero(both)
            keys.append(h_names[i] * width + h_names[i + 1 + hit])
            counts.append(both[hit])
            kept += len(hit)
            if kept > BUFFER or (kept and i == n_heavy - 2):
                yield _counted(keys, names, counts)
                keys, counts, kept = [], [], 0
        order = np.argsort(l_item, kind="stable")
        item, at = l_item[order], l_rec[order]
        step = max(1, CELLS // n_heavy)
        for lo in range(0, len(item), step):
            part = item[lo : lo + step]
            starts = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
            both = np.add.reduceat(dense[:, at[lo : lo + step]], starts, axis=1, dtype=np.int32)
            y, x = np.nonzero(both)
            for k in range(0, len(x), BUFFER):
                light, high = part[starts][x[k : k + BUFFER]], h_names[y[k : k + BUFFER]]
                yield _counted([np.minimum(light, high) * width + np.maximum(light, high)], names, [both[y[k : k + BUFFER], x[k : k + BUFFER]]])

    keys, kept, step = [], 0, 1
    while step < len(l_item):  # light items of a record follow one another, in order of their codes
        any_same = False
        for lo in range(0, len(l_item) - step, BUFFER):
            hi = min(lo + BUFFER, len(l_item) - step)
            same = np.flatnonzero(l_rec[lo + step : hi + step] == l_rec[lo:hi]) + lo
            any_same |= len(same) > 0
            keys.append(l_item[same] * width + l_item[same + step])
            kept += len(same)
            if kept > BUFFER:
                yield _counted(keys, names)
                keys, kept = [], 0
        if not any_same:
            break
        step += 1
    if kept:
        yield _counted(keys, names)


def blocks_of(batches: Iterator[pa.RecordBatch], heavy: np.ndarray) -> Iterator[pa.ListArray]:
    """The records of the batches in blocks within the bounds; a record beyond them is a block of its own."""
    kept: list[pa.Array] = []
    n = pairs = 0
    most = max(64, min(BLOCK, CELLS // max(len(heavy), 1)))
    for batch in batches:
        lists = batch.column(0)
        offsets = np.asarray(lists.offsets, np.int64) - lists.offsets[0].as_py()
        light = np.r_[0, np.cumsum(~np.isin(np.asarray(lists.flatten(), np.int64), heavy))]
        own = np.r_[0, np.cumsum((light[offsets[1:]] - light[offsets[:-1]]) ** 2 // 2)]  # pairs up to each record
        at = 0
        while at < len(lists):
            end = min(len(lists), at + most - n, max(int(np.searchsorted(own, own[at] + BUFFER - pairs, "right")) - 1, at + (n == 0)))
            if end > at:
                kept.append(lists.slice(at, end - at))
                n, pairs, at = n + end - at, pairs + int(own[end] - own[at]), end
            if at < len(lists) or n >= most:
                yield pa.concat_arrays(kept)
                kept, n, pairs = [], 0, 0
    if kept:
        yield pa.concat_arrays(kept)


def pair_counts(records: DataFrame, heavy: list[int]) -> DataFrame:
    """(a, b, n): over all records, from an array column `codes`."""
    heavy_codes = np.sort(np.array(heavy, np.int64))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in blocks_of(batches, heavy_codes):
            offsets = np.asarray(whole.offsets, np.int64)
            for a, b, n in count_block(offsets - offsets[0], np.asarray(whole.flatten(), np.int64), heavy_codes):
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(n)], ["a", "b", "n"])

    return records.select("codes").mapInArrow(count, "a long, b long, n long").groupBy("a", "b").agg(F.sum("n").alias("n_ab"))


def cooccurring_pairs(records: DataFrame, items: str, min_count: int = 5, min_share: float = 1 / 2000, min_lift: float = 0.0, heavy_share: float = 1 / 64) -> DataFrame:
    """(id_a, id_b, n_a, n_b, n_ab, n_records, lift): pairs of items, id_a < id_b by code points, in at least `min_count` records and
    a share of `min_share`, together at least `min_lift` times as often as by chance. `records` has an array of strings per record.

    heavy_share: items in that share of the records are heavy; there are at most (mean items per record) / heavy_share of them.
    """
    found = encode(records, items, min_count, min_share)
    n = found.n_records
    hot = [r[0] for r in found.vocabulary.where(F.col("n_records") >= max(1.0, n * heavy_share)).select("code").collect()]
    pairs = pair_counts(found.records, hot).where((F.col("n_ab") >= min_count) & (F.col("n_ab") >= F.lit(n * min_share) - 1e-9))
    names = F.broadcast(found.vocabulary) if fits(found.vocabulary, "length(item) * 4 + 16") else found.vocabulary
    a, b = (names.select(F.col("code").alias(x), F.col("item").alias(f"item_{x}"), F.col("n_records").alias(f"n_{x}_")) for x in "ab")
    joined = pairs.join(a, "a").join(b, "b")
    swapped = F.col("item_a") > F.col("item_b")
    lift = F.col("n_ab") * F.lit(float(n)) / (F.col("n_a_") * F.col("n_b_"))
    return joined.where(F.col("n_ab") * F.lit(n) >= F.lit(min_lift) * F.col("n_a_") * F.col("n_b_")).select(
        F.least("item_a", "item_b").alias("id_a"), F.greatest("item_a", "item_b").alias("id_b"),
        F.when(swapped, F.col("n_b_")).otherwise(F.col("n_a_")).alias("n_a"), F.when(swapped, F.col("n_a_")).otherwise(F.col("n_b_")).alias("n_b"),
        "n_ab", F.lit(n).cast("long").alias("n_records"), F.round(lift, 6).alias("lift"),
    )
