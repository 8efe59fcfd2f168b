"""Evaluation texts leaking into training text: rare n-gram seeds join passages of documents to evaluation items, and Smith-Waterman
alignment in bands around the seeds scores exact, partial and edited copies.

Texts are reduced to their letters and digits (NFKC, lower case). All n-grams of the items are candidates for seeds; in how many
documents each occurs is counted over all documents. Of every stretch of `run` letters of an item the rarest n-gram of SEED letters
is a seed, whatever its frequency, so every shared run of that length is met and nothing common is dropped; for edited copies the
n-grams of SHORT letters that few documents and few items hold are seeds as well, and two of them that don't overlap must lie on
neighbouring diagonals. Documents are looked through with a Bloom filter of a bounded size, and what passes is joined with the seeds
by hash. There is one way for evaluation texts of any size, and nothing of them is collected.

A document is known by the hash of its text, so copies are aligned once, and texts meet only for pairs of a document and an item that
seeds connect. An alignment follows a band of diagonals around its seeds, so its cost grows with the length of the passage only.

Defined cases: null and empty texts leak nothing; rows with a null key leak under it; an item or document that recurs leaks each
time; an empty table gives an empty result; the columns besides key and text are never read.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from interlace.plans.storage import fits, written

MATCH, MISMATCH, GAP = 2, -3, 3
SEED, SHORT = 25, 8
#: An edited copy is a leak from this score on, that of 30 equal letters.
LEAST_SCORE = 60
#: A short seed is rare in up to that share of the documents and of the items, and in up to so many anyway.
RARE_SHARE, RARE_ITEMS, RARE_LEAST = 1 / 1000, 1 / 20, 10
#: Hits whose diagonals are no further apart lie on one band; a band takes in so many diagonals, and letters of the item, on either
#: side, and is cut where it would be wider.
NEAR, PAD, ROWS, WIDEST = 16, 16, 256, 512
#: Bits of the filter: so many for each n-gram, between these powers of two; at most 16 MB.
FILTER_BITS, FILTER_LEAST, FILTER_MOST, FILTER_PROBES = 32, 20, 27, 4
#: Copies of the seed table that a hot seed's hits are spread over.
SALTS = 16
CHARS = 2_000_000  # letters hashed at a time
CELLS = 32_768  # cells of a row of bands aligned at a time
_PRIME, _SPREAD, _MIX = 1_000_003, 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9

_OTHER = re.compile(r"[\W_]+")


def plain(text: str | None) -> str:
    """Letters and digits only, of one width and case."""
    return _OTHER.sub("", unicodedata.normalize("NFKC", text).lower()) if text else ""


@lru_cache(maxsize=1)
def _kept() -> np.ndarray:
    """Of every code point, whether `plain` keeps it."""
    return np.array([chr(c).isalnum() for c in range(0x110000)])


def letters_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The letters of the plain forms of all texts in one array, and where each text's begin and the last ends."""
    lines = np.cumsum([0] + [t.count("\n") + 1 for t in texts])  # normalising neither makes nor takes away line ends
    codes = np.frombuffer((unicodedata.normalize("NFKC", "\n".join(texts)).lower() + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)
    kept = _kept()[codes]
    before = np.cumsum(kept) - kept
    ends = np.flatnonzero(codes == 10)
    starts = np.r_[0, before[ends[lines[1:] - 1]]]
    return codes[kept], starts


def hashes(codes: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit number for each n-gram, put together from those of halves."""
    if len(codes) < n:
        return np.empty(0, np.uint64)
    whole, done = None, 0
    power, size = codes.astype(np.uint64) + np.uint64(1), 1
    while True:
        if n & size:
            m = len(codes) - (done + size) + 1
            part = power[done : done + m] if done else power[:m]
            whole = part.copy() if whole is None else whole[:m] * np.uint64(pow(_PRIME, size, 1 << 64)) + part
            done += size
        if done == n:
            break
        power = power[: len(power) - size] * np.uint64(pow(_PRIME, size, 1 << 64)) + power[size:]
        size *= 2
    whole += np.uint64(n)
    whole *= np.uint64(_SPREAD)
    whole ^= whole >> np.uint64(32)
    whole *= np.uint64(_MIX)
    whole ^= whole >> np.uint64(29)
    return whole


def _bits_of(h: np.ndarray, bits: int, probe: int) -> np.ndarray:
    return (h * np.uint64(2 * probe + 1) + np.uint64(probe)) >> np.uint64(64 - bits) if probe else h >> np.uint64(64 - bits)


def passing(h: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Places of the numbers that the filter lets through: all that it was made of, and few others."""
    bits = (len(words) * 64).bit_length() - 1
    at = None
    for probe in range(FILTER_PROBES):
        bit = _bits_of(h if at is None else h[at], bits, probe)
        ok = (words[bit >> np.uint64(6)] >> (bit & np.uint64(63))) & np.uint64(1) != 0
        at = np.flatnonzero(ok) if at is None else at[ok]
    return at


def _filter(seeds: DataFrame, n: int) -> Broadcast:
    """The Bloom filter of a table's hashes, at most `n`, as 64-bit words."""
    bits = min(FILTER_MOST, max(FILTER_LEAST, (FILTER_BITS * max(n, 1) - 1).bit_length()))

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = np.asarray(batch.column(0)).view(np.uint64)
            bit = np.concatenate([_bits_of(h, bits, k) for k in range(FILTER_PROBES)])
            word, inverse = np.unique(bit >> np.uint64(6), return_inverse=True)
            value = np.zeros(len(word), np.uint64)
            np.bitwise_or.at(value, inverse, np.uint64(1) << (bit & np.uint64(63)))
            yield pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), pa.array(value.view(np.int64))], ["word", "value"])

    found = seeds.select("h").mapInArrow(mark, "word long, value long").groupBy("word").agg(F.bit_or("value").alias("value")).toArrow()
    words = np.zeros(1 << (bits - 6), np.uint64)
    words[np.asarray(found.column(0))] = np.asarray(found.column(1)).view(np.uint64)
    return seeds.sparkSession.sparkContext.broadcast(words)


def _stretches(texts: pa.Array) -> Iterator[tuple[int, list[str]]]:
    """Runs of texts of at most CHARS letters together, or single ones, each with the number of its first."""
    part: list[str] = []
    first = size = 0
    for k, t in enumerate(texts):
        t = t.as_py()
        if part and size + len(t) > CHARS:
            yield first, part
            part, first, size = [], k, 0
        part.append(t)
        size += len(t)
    if part:
        yield first, part


def _hits(texts: pa.Array, sizes: tuple[int, ...], words: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(text number, place, hash) of the n-grams that pass the filter."""
    for first, part in _stretches(texts):
        codes, starts = letters_of(part)
        for n in sizes:
            found = []
            for lo in range(0, max(len(codes), 1), CHARS):  # of a text beyond that, a piece at a time
                h = hashes(codes[lo : lo + CHARS + n - 1], n)
                at = passing(h, words)
                text = np.searchsorted(starts, at + lo, "right") - 1
                inside = at + lo + n <= starts[text + 1]
                found.append((first + text[inside], at[inside] + lo - starts[text[inside]], h[at[inside]]))
            yield tuple(np.concatenate(c) for c in zip(*found))


def _seeds(held: DataFrame, sizes: tuple[int, ...]) -> DataFrame:
    """(h, size, item_no, j): every n-gram of every item."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for no, t in zip(batch.column(0).to_pylist(), batch.column(1)):
                codes = np.frombuffer(t.as_py().encode("utf-32-le", "surrogatepass"), np.uint32)
                for n in sizes:
                    h = hashes(codes, n)
                    yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(np.full(len(h), n, np.int32)), pa.array(np.full(len(h), no, np.int64)), pa.array(np.arange(len(h), dtype=np.int32))], ["h", "size", "item_no", "j"])

    return held.select("item_no", "plain").mapInArrow(cut, "h long, size int, item_no long, j int")


def _document_counts(docs: DataFrame, sizes: tuple[int, ...], sent: Broadcast) -> DataFrame:
    """(h, n): in how many documents each n-gram that passes the filter occurs, over all documents; all documents under a null."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = [(np.empty(0, np.int64), np.empty(0, np.uint64))] + [(text, h) for text, _, h in _hits(batch.column(0), sizes, sent.value)]
            text, h = (np.concatenate(c) for c in zip(*kept))
            order = np.lexsort((text, h))
            text, h = text[order], h[order]
            fresh = np.r_[True, (h[1:] != h[:-1]) | (text[1:] != text[:-1])][: len(h)]
            known, n = np.unique(h[fresh], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array([None, *known.view(np.int64).tolist()], pa.int64()), pa.array(np.r_[batch.num_rows, n].astype(np.int64))], ["h", "n"])

    return docs.select("text").mapInArrow(count, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))


def rarest(counts: np.ndarray, window: int) -> np.ndarray:
    """Places that hold the least count of any window of so many places; every window has one."""
    if len(counts) < window:
        return np.empty(0, np.int64)
    windows = np.lib.stride_tricks.sliding_window_view(counts, window)
    found = [np.unique(lo + np.arange(len(part)) + part.argmin(axis=1)) for lo in range(0, len(windows), 65_536) if len(part := windows[lo : lo + 65_536])]
    return np.unique(np.concatenate(found))


def _chosen(seeds: DataFrame, counts: DataFrame, n_items: int, run: int) -> DataFrame:
    """(h, size, item_no, js): the seeds, with the places of the item where each stands."""
    total = counts.where("h is null").agg(F.sum("n")).first()[0] or 0
    known = seeds.join(counts.where("h is not null"), "h", "left").na.fill(0, ["n"])
    short = known.where(F.col("size") == SHORT).where(F.col("n").between(1, max(RARE_LEAST, RARE_SHARE * total)))
    spread = short.groupBy("h").agg(F.count_distinct("item_no").alias("m")).where(F.col("m") <= max(RARE_LEAST, RARE_ITEMS * n_items))
    few = short.join(spread.select("h"), "h", "left_semi").groupBy("h", "size", "item_no").agg(F.collect_list("j").alias("js"))

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for no, places in zip(batch.column(0).to_pylist(), batch.column(1)):
                h, j, n = (np.asarray(places.values.field(c)) for c in ("h", "j", "n"))
                order = np.argsort(j)
                at = order[rarest(n[order], run - SEED + 1)]
                at = at[n[at] > 0]  # in no document
                own: dict[int, list[int]] = {}
                for x, y in zip(h[at].tolist(), j[at].tolist()):
                    own.setdefault(x, []).append(y)
                yield pa.RecordBatch.from_arrays([pa.array(list(own), pa.int64()), pa.array([SEED] * len(own), pa.int32()), pa.array([no] * len(own), pa.int64()), pa.array(list(own.values()), pa.list_(pa.int32()))], ["h", "size", "item_no", "js"])

    by_item = known.where(F.col("size") == SEED).groupBy("item_no").agg(F.collect_list(F.struct("h", "j", "n")).alias("places"))
    return written(by_item.mapInArrow(pick, few.schema).unionByName(few), "chosen-seeds")


def _probes(docs: DataFrame, sizes: tuple[int, ...], sent: Broadcast) -> DataFrame:
    """(d1, d2, h, is): the seeds of each document, with the places where they stand. Of short seeds only, a document needs two that
    don't overlap."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text, at, h in _by_text(batch.column(2), sizes, sent.value):
                order = np.lexsort((at, h, text))
                text, at, h = text[order], at[order], h[order]
                first = np.flatnonzero(np.r_[True, (h[1:] != h[:-1]) | (text[1:] != text[:-1])][: len(h)])
                lists = pa.ListArray.from_arrays(pa.array(np.r_[first, len(h)].astype(np.int32)), pa.array(at.astype(np.int32)))
                no = pa.array(text[first])
                yield pa.RecordBatch.from_arrays([batch.column(0).take(no), batch.column(1).take(no), pa.array(h[first].view(np.int64)), lists], ["d1", "d2", "h", "is"])

    return docs.select("d1", "d2", "text").mapInArrow(find, "d1 long, d2 long, h long, is array<int>")


def _by_text(texts: pa.Array, sizes: tuple[int, ...], words: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The hits of all sizes in the texts that can leak."""
    stretch: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for k, found in enumerate(_hits(texts, sizes, words)):
        stretch.append(found)
        if (k + 1) % len(sizes) == 0:
            text, at, h = (np.concatenate(c) for c in zip(*stretch))
            if len(text):
                names, own = np.unique(text, return_inverse=True)
                least, most = np.full(len(names), 1 << 60), np.full(len(names), -1)
                np.minimum.at(least, own, at)
                np.maximum.at(most, own, at)
                sure = np.zeros(len(names), bool)
                sure[np.searchsorted(names, stretch[0][0])] = True  # the first size is SEED
                good = (sure | (most - least >= SHORT))[own]
                yield text[good], at[good], h[good]
            stretch = []


def bands(i: np.ndarray, j: np.ndarray, sure: np.ndarray) -> list[tuple[int, int, int, int]]:
    """(first diagonal, last, first letter of the item, last) around hits at document places i and item places j, where one of them
    is sure, or two don't overlap."""
    out = []
    d = i - j
    order = np.argsort(d, kind="stable")
    d, j, sure = d[order], j[order], sure[order]
    edges = np.flatnonzero(np.r_[True, d[1:] - d[:-1] > NEAR, True])
    for lo, hi in zip(edges[:-1], edges[1:]):
        at = lo
        while at < hi:  # cut where it would be too wide, half a width on
            end = int(np.searchsorted(d[lo:hi], d[at] + WIDEST, "right")) + lo
            if sure[at:end].any() or j[at:end].max() - j[at:end].min() >= SHORT:
                out.append((int(d[at]), int(d[end - 1]), int(j[at:end].min()), int(j[at:end].max())))
            if end >= hi:
                break
            at = int(np.searchsorted(d[lo:hi], d[at] + WIDEST // 2, "right")) + lo
    return out


def longest_run(doc: np.ndarray, item: np.ndarray, diagonals: np.ndarray) -> int:
    """Of equal letters on any of the diagonals."""
    best = 0
    for d in diagonals.tolist():
        lo, hi = max(0, -d), min(len(item), len(doc) - d)
        differ = np.flatnonzero(np.r_[True, item[lo:hi] != doc[lo + d : hi + d], True])
        best = max(best, int(np.diff(differ).max()) - 1)
    return best


def smith_waterman(passages: list[tuple[np.ndarray, np.ndarray, int]]) -> list[int]:
    """Best local alignment score of each passage: letters of an item, letters of a document, and a number of diagonals. Letter r of
    the item meets the document's letters r to r + diagonals - 1. One row of many bands at a time."""
    scores = [0] * len(passages)
    order = sorted((k for k, p in enumerate(passages) if len(p[0])), key=lambda k: (passages[k][2], len(passages[k][0])))
    at = 0
    while at < len(order):
        width = passages[order[at]][2]
        part = [order[at]]
        while at + len(part) < len(order) and passages[order[at + len(part)]][2] <= width * 2 and (len(part) + 1) * passages[order[at + len(part)]][2] <= CELLS:
            part.append(order[at + len(part)])
        at += len(part)
        width = max(passages[k][2] for k in part)
        rows = max(len(passages[k][0]) for k in part)
        item, doc = np.full((rows, len(part)), 0xFFFFFFFF, np.uint32), np.full((rows + width - 1, len(part)), 0xFFFFFFFE, np.uint32)
        inside = np.zeros((width, len(part)), bool)
        for c, k in enumerate(part):
            a, b, w = passages[k]
            item[: len(a), c] = a
            doc[: len(b), c] = b
            inside[:w, c] = True
        slope = (np.arange(width, dtype=np.int32) * GAP)[:, None]
        h = np.zeros((width + 1, len(part)), np.int32)  # the last row stands for the diagonal beyond
        best = np.zeros((width, len(part)), np.int32)
        new = np.empty((width, len(part)), np.int32)
        for r in range(rows):
            np.multiply(doc[r : r + width] == item[r], np.int32(MATCH - MISMATCH), out=new)
            new += h[:-1]
            new += np.int32(MISMATCH)
            np.maximum(new, h[1:] - np.int32(GAP), out=new)
            np.maximum(new, 0, out=new)
            new *= inside
            new += slope
            np.maximum.accumulate(new, axis=0, out=new)
            new -= slope
            new *= inside
            h[:-1] = new
            np.maximum(best, new, out=best)
        for k, s in zip(part, best.max(axis=0).tolist()):
            scores[k] = s
    return scores


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _passage(doc: np.ndarray, item: np.ndarray, band: tuple[int, int, int, int]) -> tuple[np.ndarray, np.ndarray, int]:
    """What a band aligns, with its margins."""
    first, last, j0, j1 = band
    first, last = first - PAD, last + PAD
    lo, hi = max(0, j0 - ROWS), min(len(item), j1 + SEED + ROWS)
    a, b = lo + first, hi - 1 + last + 1
    before = max(0, -a)
    out = np.full(b - a, 0xFFFFFFFE, np.uint32)
    own = doc[max(0, a) : max(0, b)]
    out[before : before + len(own)] = own
    return item[lo:hi], out, last - first + 1


def _aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per document and item, from the plain item, the text and the seeds they share: the longest run, the best score."""
    names = ["d1", "d2", "item_no", "longest_run", "score", "item_share"]
    for batch in batches:
        for lo in range(0, batch.num_rows, 1024):
            part = batch.slice(lo, 1024)
            rows, passages = [], []
            last: tuple[str, np.ndarray] = ("", np.empty(0, np.uint32))
            for d1, d2, no, item, text, met in zip(*[part.column(c).to_pylist() for c in ("d1", "d2", "item_no", "plain", "text", "met")]):
                if last[0] is not text and last[0] != text:
                    last = (text, _codes(plain(text)))
                doc, own = last[1], _codes(item)
                i = np.concatenate([np.repeat(m["is"], len(m["js"])) for m in met]).astype(np.int64)
                j = np.concatenate([np.tile(m["js"], len(m["is"])) for m in met]).astype(np.int64)
                sure = np.concatenate([np.full(len(m["is"]) * len(m["js"]), m["size"] == SEED) for m in met])
                found = bands(i, j, sure)
                rows.append((d1, d2, no, longest_run(doc, own, np.unique(i - j)) if found else 0, len(own), len(passages), len(found)))
                passages += [_passage(doc, own, b) for b in found]
            scores = smith_waterman(passages)
            best = [max(scores[r[5] : r[5] + r[6]], default=0) for r in rows]
            columns = [*zip(*[r[:4] for r in rows])] or [[]] * 4
            yield pa.RecordBatch.from_arrays([*[pa.array(c, pa.int64()) for c in columns], pa.array(best, pa.int64()), pa.array([round(s / (MATCH * r[4]), 4) for s, r in zip(best, rows)], pa.float64())], names)


def leaks(documents: DataFrame, items: DataFrame, doc_key: str = "doc_id", item_key: str = "item_id", text: str = "text", run: int = 50, edited: bool = False) -> DataFrame:
    """({doc_key}, {item_key}, longest_run, score, item_share): each document and each item that share a run of `run` letters and
    digits; with `edited` also those whose alignment, through two rare seeds at least, scores LEAST_SCORE.

    longest_run: the longest shared run on the seeds' diagonals, exact from `run` on; score: of the best local alignment (2 a match, -3
    a mismatch or gap) in a band around seeds; item_share: score against that of a whole, unchanged copy. Rows with a null key leak
    under it. The two keys need different names.
    """
    if doc_key == item_key:
        raise ValueError("the keys of documents and items need different names")
    if run < SEED:
        raise ValueError(f"runs under {SEED} letters and digits hold no seed")
    sizes = (SEED, SHORT) if edited else (SEED,)
    plain_of = F.pandas_udf(lambda texts: texts.map(plain), "string")
    docs = documents.where(F.col(text).isNotNull()).select(F.col(doc_key).alias("key"), F.col(text).alias("text"), F.xxhash64(text).alias("d1"), F.xxhash64(F.lit(1), text).alias("d2"))
    held = written(items.where(F.col(text).isNotNull()).select(F.monotonically_increasing_id().alias("item_no"), F.col(item_key).alias("item_key"), plain_of(F.col(text)).alias("plain")), "eval-items")
    n_items, letters = held.agg(F.count("*"), F.coalesce(F.sum(F.length("plain")), F.lit(0))).first()
    seeds = _seeds(held, sizes)
    counts = written(_document_counts(docs, sizes, _filter(seeds, letters * len(sizes))), "seed-counts")
    chosen = _chosen(seeds, counts, n_items, run)
    salted = chosen.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    probes = _probes(docs, sizes, _filter(chosen, letters * len(sizes))).withColumn("salt", F.pmod("d2", F.lit(SALTS)).cast("int"))
    met = probes.join(salted, ["h", "salt"]).groupBy("d1", "d2", "item_no").agg(F.collect_list(F.struct("is", "js", "size")).alias("met"))
    ample = F.exists("met", lambda m: m["size"] == SEED) | (F.array_max(F.transform("met", lambda m: F.array_max(m["js"]))) - F.array_min(F.transform("met", lambda m: F.array_min(m["js"]))) >= SHORT)
    pairs = written(met.where(ample), "met-seeds")
    ids = pairs.select("d1", "d2").distinct()
    leaking = written(docs.join(F.broadcast(ids) if fits(ids, "16") else ids, ["d1", "d2"], "left_semi"), "leaking-documents")
    texts = leaking.groupBy("d1", "d2").agg(F.any_value("text").alias("text"))
    aligned = pairs.join(texts, ["d1", "d2"]).join(held.select("item_no", "plain"), "item_no").mapInArrow(_aligned, "d1 long, d2 long, item_no long, longest_run long, score long, item_share double")
    found = aligned.where(((F.col("longest_run") >= run) & (F.col("score") >= MATCH * run)) | (F.col("score") >= LEAST_SCORE if edited else F.lit(False)))
    named = found.join(leaking.select("d1", "d2", "key"), ["d1", "d2"]).join(held.select("item_no", "item_key"), "item_no")
    return named.select(F.col("key").alias(doc_key), F.col("item_key").alias(item_key), "longest_run", "score", "item_share")
