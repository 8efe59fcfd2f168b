"""Frequent subsequences with gaps, by bitmap sequence mining.

The positions of each event in a block of sequences are bits, a sequence having as many 64-bit words as its length needs. A pattern
is extended by an event by keeping, of each sequence, the bits after the pattern's first end and intersecting them with the event's
bits; sequences with a bit left contain the extended pattern. Patterns are extended depth-first. The bit vectors are sparse: a word
has entries only for the events that occur in it, so a block needs memory for its occurrences, not for events times words.

A pattern with a share s of all sequences has that share in at least one block. So one pass mines each block for the patterns with
the share s there, and a second pass counts exactly these candidates over all blocks. Nothing is capped: candidates beyond a bound
are counted in several passes. A block ends at EVENTS occurrences, but not before it has LEAST_SEQUENCES sequences, as the candidates
of very small blocks are many; what is left at the end of a partition joins its last block.

Defined cases: empty and null sequences count for nothing; an event may recur in a pattern; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from interlace.llm.encoding import encode
from interlace.plans.storage import fits, written

BLOCK = 16_384  # most sequences mined together
EVENTS, LEAST_SEQUENCES = 1_000_000, 400
CANDIDATES = 200_000  # patterns counted in one pass

Found = tuple[int, int, np.ndarray, np.ndarray]


class Bitmaps:
    """Sparse bit vectors of the events of a block of sequences: entries (event, bits), sorted by word."""

    def __init__(self, offsets: np.ndarray, codes: np.ndarray):
        lengths = np.diff(offsets)
        words = -(-lengths // 64)
        first = np.cumsum(words) - words
        seq = np.repeat(np.arange(len(lengths)), lengths)
        at = np.arange(len(codes)) - np.repeat(offsets[:-1], lengths)
        self.names, local = np.unique(codes, return_inverse=True)
        self.seq_of = np.repeat(np.arange(len(lengths)), words)
        self.n_words = len(self.seq_of)
        self.last_of = (first + words - 1)[self.seq_of] if len(lengths) else self.seq_of
        self.single = bool((words <= 1).all())
        key = (first[seq] + at // 64) * np.int64(max(len(self.names), 1)) + local
        entry, inverse = np.unique(key, return_inverse=True)
        self.bits = np.zeros(len(entry), np.uint64)
        np.bitwise_or.at(self.bits, inverse, np.uint64(1) << (at % 64).astype(np.uint64))
        self.event = (entry % max(len(self.names), 1)).astype(np.int32)
        self.start_of = np.searchsorted(entry // max(len(self.names), 1), np.arange(self.n_words + 1))

    def after(self, words: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Words, and their bits, that lie after the first of `bits` in each sequence."""
        if not self.single:
            head = np.r_[True, self.seq_of[words[1:]] != self.seq_of[words[:-1]]]
            words, bits = words[head], bits[head]
        low = bits & (~bits + np.uint64(1))
        rest = ~(low | (low - np.uint64(1)))
        if self.single:
            return words, rest
        more = self.last_of[words] - words
        out = np.repeat(words, more + 1)
        step = np.arange(len(out)) - np.repeat(np.cumsum(more + 1) - (more + 1), more + 1)
        return out + step, np.where(step == 0, np.repeat(rest, more + 1), ~np.uint64(0))

    def extend(self, allowed: np.ndarray, words: np.ndarray, rest: np.ndarray, keep: Callable[[np.ndarray], np.ndarray]) -> Iterator[Found]:
        """(event, support, words, bits) for the allowed events (a mask) after a prefix, where `keep` holds for the support."""
        counts = self.start_of[words + 1] - self.start_of[words]
        at = np.repeat(self.start_of[words] - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
        both = self.bits[at] & np.repeat(rest, counts)
        event = self.event[at]
        hit = np.flatnonzero((both != 0) & allowed[event])
        if not len(hit):
            return
        hit = hit[np.argsort(event[hit], kind="stable")]
        event, word, both = event[hit], np.repeat(words, counts)[hit], both[hit]
        edges = np.flatnonzero(np.r_[True, event[1:] != event[:-1], True])
        if self.single:
            support = np.diff(edges)
        else:
            seq = self.seq_of[word]
            fresh = np.r_[True, (event[1:] != event[:-1]) | (seq[1:] != seq[:-1])]
            support = np.add.reduceat(fresh.astype(np.int64), edges[:-1])
        for k in np.flatnonzero(keep(support)):
            lo, hi = edges[k], edges[k + 1]
            yield int(event[lo]), int(support[k]), word[lo:hi], both[lo:hi]


def mine(maps: Bitmaps, least: int, min_length: int, max_length: int) -> Iterator[tuple[tuple[int, ...], int]]:
    """Patterns, as numbers of the block's events, that at least `least` sequences of the block contain."""
    keep = lambda n: n >= least
    allowed = np.ones(len(maps.names), bool)
    open_ = [((e,), n, w, b) for e, n, w, b in maps.extend(allowed, np.arange(maps.n_words), np.full(maps.n_words, ~np.uint64(0)), keep)]
    allowed = np.isin(np.arange(len(maps.names)), [p[0] for p, *_ in open_])
    while open_:
        pattern, n, words, bits = open_.pop()
        if len(pattern) >= min_length:
            yield pattern, n
        if len(pattern) < max_length:
            open_ += [((*pattern, e), m, w, b) for e, m, w, b in maps.extend(allowed, *maps.after(words, bits), keep)]


def count_candidates(maps: Bitmaps, tree: dict) -> Iterator[tuple[int, int]]:
    """(candidate number, sequences of the block) for a tree of patterns by code; ends under the key None."""
    number_of = {int(c): i for i, c in enumerate(maps.names)}
    open_ = [(tree, np.arange(maps.n_words), np.full(maps.n_words, ~np.uint64(0)))]
    while open_:
        node, words, rest = open_.pop()
        allowed = np.zeros(len(maps.names), bool)
        allowed[[number_of[c] for c in node if c is not None and c in number_of]] = True
        for e, n, w, b in maps.extend(allowed, words, rest, lambda n: n > 0):
            child = node[int(maps.names[e])]
            if None in child:
                yield child[None], n
            if len(child) > (None in child):
                open_.append((child, *maps.after(w, b)))


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[Bitmaps]:
    kept: list[pa.Array] = []
    full: list[pa.Array] = []  # a block that may be the last, which takes what is left
    n = events = 0
    for batch in batches:
        lists = batch.column(0)
        ends = np.asarray(lists.offsets, np.int64)[1:] - lists.offsets[0].as_py()
        at = 0
        while at < len(lists):
            before = int(ends[at - 1]) if at else 0
            most = int(np.searchsorted(ends, before + max(EVENTS - events, 0), "right")) - at
            take = min(len(lists) - at, BLOCK - n, max(most, LEAST_SEQUENCES - n, 1))
            kept.append(lists.slice(at, take))
            n, events, at = n + take, events + int(ends[at + take - 1]) - before, at + take
            if n >= BLOCK or (events >= EVENTS and n >= LEAST_SEQUENCES):
                if full:
                    yield _maps(full)
                kept, full, n, events = [], kept, 0, 0
    if n >= LEAST_SEQUENCES and full:
        yield _maps(full)
        full = []
    if full or kept:
        yield _maps(full + kept)


def _maps(arrays: list[pa.Array]) -> Bitmaps:
    whole = pa.concat_arrays(arrays)
    offsets = np.asarray(whole.offsets, np.int64)
    return Bitmaps(offsets - offsets[0], np.asarray(whole.flatten(), np.int64))


def frequent_subsequences(records: DataFrame, items: str, min_count: int = 5, min_share: float = 1 / 100, min_length: int = 3, max_length: int = 3) -> DataFrame:
    """(pattern array<string>, support): ordered patterns of `min_length` to `max_length` events, gaps allowed, that at least
    `min_count` sequences and a share of `min_share` of the non-empty ones contain."""
    spark = records.sparkSession
    found = encode(records, items, min_count, min_share)
    sequences = written(found.records, "sequences")
    n = found.n_records

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for maps in _blocks(batches):
            size = len(np.unique(maps.seq_of))  # sequences without a frequent event only raise the true share's bound
            least = max(1, int(np.ceil(size * min_share - 1e-9)))
            patterns = [[int(maps.names[r]) for r in p] for p, _ in mine(maps, least, min_length, max_length)]
            yield pa.RecordBatch.from_arrays([pa.array(patterns, pa.list_(pa.int64()))], ["pattern"])

    candidates = written(sequences.mapInArrow(local, "pattern array<long>").distinct().withColumn("candidate", F.monotonically_increasing_id()), "candidates")
    n_candidates = candidates.count()
    passes = -(-n_candidates // CANDIDATES) or 1
    counted = None
    for k in range(passes):
        part = candidates.where(F.pmod(F.xxhash64("pattern"), F.lit(passes)) == k) if passes > 1 else candidates
        tree: dict = {}
        for row in part.collect():
            node = tree
            for code in row["pattern"]:
                node = node.setdefault(code, {})
            node[None] = row["candidate"]
        sent = spark.sparkContext.broadcast(tree)

        def exact(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for maps in _blocks(batches):
                hits = list(count_candidates(maps, sent.value))
                yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in hits], pa.int64()), pa.array([s for _, s in hits], pa.int64())], ["candidate", "n"])

        one = sequences.mapInArrow(exact, "candidate long, n long").groupBy("candidate").agg(F.sum("n").alias("support"))
        counted = one if counted is None else counted.unionByName(one)
    names = found.vocabulary.select("code", "item")
    kept = counted.where((F.col("support") >= min_count) & (F.col("support") >= F.lit(n * min_share) - 1e-9)).join(candidates, "candidate")
    steps = kept.select("candidate", "support", F.posexplode("pattern").alias("at", "code")).join(F.broadcast(names) if fits(names, "length(item) * 4 + 8") else names, "code")
    return steps.groupBy("candidate", "support").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "item"))), lambda x: x["item"]).alias("pattern")).select("pattern", "support")
