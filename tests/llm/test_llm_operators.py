import itertools
import random
from collections import Counter

import numpy as np
import pytest

pytest.importorskip("interlace.llm")

from pyspark.sql import functions as F  # noqa: E402

from interlace.llm import cooccurrence, crf, encoding, leakage, lookalikes, mixing, pair_defects, splitting, subsequences, term_frequency  # noqa: E402
from tests.conftest import rows  # noqa: E402

RNG = random.Random(11)
RECORDS = [[RNG.choice("aabbbcdefghijklmnop") for _ in range(RNG.randrange(0, 9))] for _ in range(400)] + [[], None, ["z"] * 200 + ["a", "b"]]


def frame(spark, records=RECORDS):
    return spark.createDataFrame([(k, r) for k, r in enumerate(records)], "id int, items array<string>")


def expected_pairs(records, least):
    n = Counter(x for r in records for x in set(r or []))
    both = Counter(p for r in records for p in itertools.combinations(sorted(set(r or [])), 2))
    return {(a, b, n[a], n[b], c) for (a, b), c in both.items() if c >= least}


@pytest.mark.parametrize("heavy_share", [0.0001, 0.3, 2.0])
def test_pairs(spark, heavy_share):
    got = cooccurrence.cooccurring_pairs(frame(spark), "items", min_count=3, min_share=0.0, heavy_share=heavy_share)
    assert {tuple(r)[:5] for r in got.collect()} == expected_pairs(RECORDS, 3)


def test_pairs_by_shuffled_vocabulary(spark, monkeypatch):
    monkeypatch.setattr(encoding, "fits", lambda *a: False)
    got = cooccurrence.cooccurring_pairs(frame(spark), "items", min_count=3, min_share=0.0)
    assert {tuple(r)[:5] for r in got.collect()} == expected_pairs(RECORDS, 3)


def test_pairs_of_small_blocks(spark, monkeypatch):
    """Bounds end blocks and hand counts on early; nothing is lost."""
    import pyarrow as pa

    lists = [[RNG.randrange(40) for _ in range(RNG.randrange(0, 30))] for _ in range(300)] + [list(range(40))]
    heavy = np.arange(5)
    expected = Counter(p for r in lists for p in itertools.combinations(sorted(set(r)), 2))
    for cells, buffer, block in ((10**6, 10**6, 10**6), (500, 50, 70), (10, 1, 1)):
        monkeypatch.setattr(cooccurrence, "CELLS", cells)
        monkeypatch.setattr(cooccurrence, "BUFFER", buffer)
        monkeypatch.setattr(cooccurrence, "BLOCK", block)
        batches = [pa.RecordBatch.from_arrays([pa.array(lists[i : i + 90], pa.list_(pa.int64()))], ["codes"]) for i in range(0, len(lists), 90)]
        got, blocks = Counter(), list(cooccurrence.blocks_of(iter(batches), heavy))
        assert sum(map(len, blocks)) == len(lists)
        for whole in blocks:
            offsets = np.asarray(whole.offsets, np.int64)
            for a, b, n in cooccurrence.count_block(offsets - offsets[0], np.asarray(whole.flatten(), np.int64), heavy):
                assert len(a) <= max(buffer * 2, 400)
                for x, y, m in zip(a.tolist(), b.tolist(), n.tolist()):
                    got[x, y] += m
        assert got == expected


def test_memory_of_blocks():
    """Records of 40 items, half of them light, and sequences of 500 events: under 300 MB at the peak."""
    import tracemalloc

    import pyarrow as pa

    rng = np.random.default_rng(1)
    heavy = np.arange(1000)
    records = np.concatenate([rng.integers(0, 1000, (32_768, 20)), rng.integers(1000, 40_000, (32_768, 20))], axis=1)
    lists = pa.ListArray.from_arrays(pa.array(np.arange(0, records.size + 1, 40, dtype=np.int32)), pa.array(records.ravel()))
    tracemalloc.start()
    for whole in itertools.islice(cooccurrence.blocks_of(iter([pa.RecordBatch.from_arrays([lists], ["codes"])]), heavy), 2):
        offsets = np.asarray(whole.offsets, np.int64)
        for _ in cooccurrence.count_block(offsets - offsets[0], np.asarray(whole.flatten(), np.int64), heavy):
            pass
    pairs_peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.reset_peak()
    events = rng.integers(0, 1000, 4_096 * 500)
    lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(events) + 1, 500, dtype=np.int32)), pa.array(events))
    maps = next(subsequences._blocks(iter([pa.RecordBatch.from_arrays([lists], ["codes"])])))
    assert sum(1 for _ in itertools.islice(subsequences.mine(maps, 600, 1, 2), 50)) == 50
    mine_peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert pairs_peak < 300e6 and mine_peak < 300e6, (pairs_peak, mine_peak)


def test_blocks_of_sequences(monkeypatch):
    import pyarrow as pa

    lists = [[1] * RNG.randrange(1, 9) for _ in range(500)]
    batches = [pa.RecordBatch.from_arrays([pa.array(lists[i : i + 64])], ["codes"]) for i in range(0, 500, 64)]
    for block, events, least in ((16_384, 10**6, 400), (100, 10**6, 10), (100, 60, 20), (10, 5, 3)):
        monkeypatch.setattr(subsequences, "BLOCK", block)
        monkeypatch.setattr(subsequences, "EVENTS", events)
        monkeypatch.setattr(subsequences, "LEAST_SEQUENCES", least)
        sizes = [len(np.unique(m.seq_of)) for m in subsequences._blocks(iter(batches))]
        assert sum(sizes) == 500 and min(sizes) >= min(least, 500) and max(sizes) < block + least


def test_pairs_of_nothing(spark):
    assert rows(cooccurrence.cooccurring_pairs(frame(spark, [[], None]), "items")) == [] and rows(cooccurrence.cooccurring_pairs(frame(spark).limit(0), "items")) == []


def test_null_items_and_other_columns(spark):
    df = spark.createDataFrame([(k, ["x", None, "y"], k, "q") for k in range(6)], "id int, items array<string>, codes int, record string")
    assert [tuple(r)[:5] for r in cooccurrence.cooccurring_pairs(df, "items").collect()] == [("x", "y", 6, 6, 6)]
    assert [tuple(r) for r in subsequences.frequent_subsequences(df, "items", min_length=2).collect()] == [(["x", "y"], 6)]


def contains(record, pattern):
    rest = iter(record)
    return all(any(x == y for y in rest) for x in pattern)


@pytest.mark.parametrize("block", [16_384, 50])
def test_subsequences(spark, monkeypatch, block):
    monkeypatch.setattr(subsequences, "BLOCK", block)
    records = [[RNG.choice("abcd") for _ in range(RNG.randrange(0, 7))] for _ in range(250)] + [["a", "b"] * 70 + ["c"], [], None]
    least = -(-sum(bool(r) for r in records) // 10)
    expected = {(p, n) for p in itertools.product("abcd", repeat=3) if (n := sum(contains(r or [], p) for r in records)) >= least}
    got = subsequences.frequent_subsequences(frame(spark, records), "items", min_count=5, min_share=0.1)
    assert {(tuple(r["pattern"]), r["support"]) for r in got.collect()} == expected


def test_subsequences_in_several_passes(spark, monkeypatch):
    expected = rows(subsequences.frequent_subsequences(frame(spark), "items", min_share=0.05, min_length=2))
    monkeypatch.setattr(subsequences, "CANDIDATES", 100)
    assert rows(subsequences.frequent_subsequences(frame(spark), "items", min_share=0.05, min_length=2)) == expected != []
    assert rows(subsequences.frequent_subsequences(frame(spark).limit(0), "items")) == []


def test_long_sequences_use_several_words():
    codes = np.array([1] + [2] * 130 + [3, 1, 3])
    maps = subsequences.Bitmaps(np.array([0, 132, 134]), codes)
    found = {tuple(int(maps.names[x]) for x in p): n for p, n in subsequences.mine(maps, 1, 2, 3)}
    assert found[1, 3] == 2 and found[2, 2, 3] == 1 and (3, 1) not in found and (1, 1) not in found


def test_terms(spark):
    pairs = [(RNG.choice(["a"] * 30 + list("bcdefg") + [None]), RNG.choice([1, 2, 3, 4, 5, 6, None])) for _ in range(3000)]
    df = spark.createDataFrame(pairs, "t string, r int").repartition(5)
    n, m = Counter(t for t, r in pairs if t and r), Counter(t for t, r in set(pairs) if t and r)
    assert rows(term_frequency.term_frequencies(df, "t", "r")) == sorted((t, n[t], m[t]) for t in n)
    assert rows(term_frequency.term_frequencies(df.limit(0), "t", "r")) == []


def test_run_scan_over_batches():
    import pyarrow as pa

    data = sorted((RNG.choice("abc"), RNG.randrange(4), RNG.randrange(1, 3)) for _ in range(60))
    merged = {}
    for t, r, c in data:
        merged.setdefault((t, r), []).append(c)
    for size in (1, 7, 60):
        batches = [pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*data[i : i + size])], ["t", "r", "n"]) for i in range(0, 60, size)]
        got = [tuple(r.values()) for b in term_frequency._scan(iter(batches)) for r in b.to_pylist()]
        assert sorted(got) == [(t, sum(c for x, _, c in data if x == t), len({r for x, r, _ in data if x == t})) for t in sorted({x[0] for x in data})]


def test_lookalikes(spark):
    same = ["pa:za ku", "ра:za ku", "ｐａ：ｚａ　ｋｕ", "pa:​za ku", "pa:za ku"]
    other = ["Pa:za ku", "pá:za ku", "paza ku", "pa:zaku", "pa:za ku.", "pa:za  ku"]
    data = [(k, t) for k, t in enumerate(same + other + ["pa:za ku", None, ""])]
    got = rows(lookalikes.lookalike_pairs(spark.createDataFrame(data, "k long, text string"), "k", ["text"]))
    expected = [(k, t) for k, t in data if t in same]
    assert {r[1:] for r in got} == {(a, b) for a, x in expected for b, y in expected if a < b and x != y}
    for a, b in [("ｶ\uff9eり", "ガリ"), ("c\u00efx", "ci\u0308x"), ("\ufa26", "都"), ("\u2f2d", "山"), ("ｶ力ロ口", "カカロロ")]:
        df = spark.createDataFrame([(1, a), (2, b)], "k long, text string")
        assert len(rows(lookalikes.lookalike_pairs(df, "k", ["text"]))) == 1, (a, b)
    alike = "a\u3164b a\uffa0b|ab ab;eﬃx|effix;ﬄ|ffl;ﬆ|st;Ⅳ|IV;℃|°C;ĳ|ij;ǆ|dž;ꓮᎪՏη|AASn;才千丿|オチノ;㎏|kg"
    data = [(k, side) for k, pair in enumerate(alike.split(";")) for side in pair.split("|")]
    df = spark.createDataFrame([(2 * k + i % 2, t) for i, (k, t) in enumerate(data)], "k long, text string")
    assert {(r[1], r[2]) for r in rows(lookalikes.lookalike_pairs(df, "k", ["text"]))} == {(2 * k, 2 * k + 1) for k in range(len(data) // 2)}
    df = spark.createDataFrame([(1, "ハ"), (2, "バ"), (3, "パ"), (4, "x" * 100_000)], "k long, text string").withColumns({"canon": F.lit(1), "value": F.lit(2), "odd": F.lit(3)})
    assert rows(lookalikes.lookalike_pairs(spark.createDataFrame([(None, "ａ"), (1, "a"), (2, "ａ")], "k long, text string"), "k", ["text"])) == [("text", 1, 2)]
    assert rows(lookalikes.lookalike_pairs(df, "k", ["text"])) == [] == rows(lookalikes.lookalike_pairs(df.limit(0), "k", ["text"]))


def test_lookalike_classes(spark, monkeypatch):
    """Every row of a class, by broadcast or by shuffling; one text many times is no class."""
    data = [(1, "ab"), (2, "ａb"), (3, "ab"), (4, "ａｂ"), (5, "c"), (6, "c"), (None, "a\u200bb"), (7, None), (8, "ｃd")]
    df = spark.createDataFrame(data, "k long, text string").withColumns({"c1": F.lit(1), "v": F.lit(2), "canon": F.lit("x")})
    expected = sorted([("text", k, "ab", 5, 4) for k in (1, 2, 3, 4, None)], key=repr)
    assert rows(lookalikes.lookalike_classes(df, "k", ["text"])) == expected
    pairs = rows(lookalikes.lookalike_pairs(df, "k", ["text"]))
    monkeypatch.setattr(lookalikes, "fits", lambda *a: False)
    assert rows(lookalikes.lookalike_classes(df, "k", ["text"])) == expected and rows(lookalikes.lookalike_pairs(df, "k", ["text"])) == pairs == [("text", 1, 2), ("text", 1, 4), ("text", 2, 3), ("text", 2, 4), ("text", 3, 4)]
    assert rows(lookalikes.lookalike_classes(df.limit(0), "k", ["text"])) == []


def test_smith_waterman_in_bands():
    """All diagonals give the whole table's score; fewer give that of the cells on them."""

    def slow(a, b, width):
        h = np.full((len(a) + 1, len(b) + 1), 0)
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                if 0 <= j - i < width:
                    side = h[i, j - 1] - 3 if j - 1 - i >= 0 else 0
                    over = h[i - 1, j] - 3 if j - i + 1 < width else 0
                    h[i, j] = max(0, h[i - 1, j - 1] + (2 if a[i - 1] == b[j - 1] else -3), side, over)
        return int(h.max())

    passages = []
    for _ in range(150):
        a = np.array([RNG.randrange(3) for _ in range(RNG.randrange(1, 25))], np.uint32)
        width = RNG.randrange(1, 12)
        passages.append((a, np.array([RNG.randrange(3) for _ in range(len(a) + width - 1)], np.uint32), width))
    assert leakage.smith_waterman(passages) == [slow(*p) for p in passages] and leakage.smith_waterman([]) == []


def test_letters_and_hashes():
    texts = ["Ａb, c\nd\n", "", "…", "ｶﾞΣ", "x_yΣ"]
    codes, starts = leakage.letters_of(texts)
    assert ["".join(map(chr, codes[a:b])) for a, b in zip(starts, starts[1:])] == [leakage.plain(t) for t in texts] == ["abcd", "", "", "ガσ", "xyς"]
    codes = np.array([RNG.randrange(4) for _ in range(300)], np.uint32)
    for n in (1, 7, 8, 25):
        h = leakage.hashes(codes, n)
        grams = [tuple(codes[i : i + n]) for i in range(len(codes) - n + 1)]
        assert len(set(zip(grams, h.tolist()))) == len(set(grams)) == len(set(h.tolist()))
    assert len(leakage.hashes(codes[:3], 8)) == 0


def test_rarest_seeds_cover_every_run():
    for _ in range(20):
        counts = np.array([RNG.randrange(5) for _ in range(RNG.randrange(0, 90))])
        at = set(leakage.rarest(counts, 26).tolist())
        for lo in range(len(counts) - 25):
            assert any(counts[k] == counts[lo : lo + 26].min() for k in at & set(range(lo, lo + 26)))


def test_wide_bands_are_cut():
    i = np.arange(0, 20_000, 8)
    found = leakage.bands(i, np.arange(len(i)) % 50 * 10, np.zeros(len(i), bool))
    assert found and all(b - a <= leakage.WIDEST for a, b, _, _ in found)
    assert leakage.bands(np.array([5, 6]), np.array([0, 1]), np.array([False, False])) == [] and len(leakage.bands(np.array([5]), np.array([0]), np.array([True]))) == 1


@pytest.mark.parametrize("edited", [False, True])
def test_leaks(spark, edited):
    item = "".join(RNG.choice("abcdefgh") for _ in range(120))
    dressed = " ".join(item[i : i + 3].upper() for i in range(20, 71, 3))[:-1]
    texts = [item, "x" * 33 + dressed + "y", item[:49], None, "", "…" * 100, item[:24], "z".join([item[:60], item[60:]]), "q" * 100_000 + item[40:92]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumns({"item_no": F.lit("clash"), "d1": F.lit(1), "h": F.lit(2)})
    items = spark.createDataFrame([(7, item), (8, None), (9, ""), (10, item)], "item_id long, text string").withColumn("plain", F.lit("clash"))
    got = leakage.leaks(docs, items, edited=edited)
    assert {(r["doc_id"], r["item_id"]) for r in got.where("longest_run >= 50").collect()} == {(d, i) for d in (0, 1, 7, 8) for i in (7, 10)}
    best = {r["doc_id"]: r for r in got.where("item_id = 7").collect()}
    assert set(best) == ({0, 1, 2, 7, 8} if edited else {0, 1, 7, 8})
    assert best[0]["longest_run"] == 120 and best[0]["item_share"] == 1.0 and best[7]["score"] == 237
    assert rows(leakage.leaks(docs.limit(0), items, edited=edited)) == [] == rows(leakage.leaks(docs, items.limit(0), edited=edited))


def test_leaks_of_null_and_repeated_keys(spark):
    item = "".join(RNG.choice("abcdefgh") for _ in range(120))
    docs = spark.createDataFrame([(None, item), (1, item[:80]), (1, item[30:]), (1, item[:80]), (2, "other")], "doc_id long, text string")
    items = spark.createDataFrame([(None, item), (5, item)], "item_id long, text string")
    got = rows(leakage.leaks(docs, items).select("doc_id", "item_id", "longest_run"))
    assert got == rows(leakage.leaks(docs, items, edited=True).select("doc_id", "item_id", "longest_run")) and len(got) == 8
    assert sorted((r[0] or 0, r[2]) for r in got if r[1] == 5) == [(0, 120), (1, 80), (1, 80), (1, 90)]


def test_leaks_of_a_run_that_a_third_of_all_documents_hold(spark):
    """A common passage isn't dropped, whatever the frequency of its seeds; a common phrase is no edited copy."""
    new = lambda n: "".join(RNG.choice("abcdefghijklmnop") for _ in range(n))
    passage, phrase = new(50), new(20)
    docs = spark.createDataFrame([(k, new(40) + (passage if k % 3 == 0 else phrase if k % 3 == 1 else "") + new(30)) for k in range(900)], "doc_id long, text string")
    items = spark.createDataFrame([(1, new(30) + passage), (2, phrase + new(90))], "item_id long, text string")
    for edited in (False, True):
        assert {tuple(r) for r in leakage.leaks(docs, items, edited=edited).select("doc_id", "item_id").collect()} == {(k, 1) for k in range(0, 900, 3)}


def edited_copy(text, every, kind):
    """`text` with a letter changed, taken out or put in after each `every` - 1 letters."""
    out = []
    for i, c in enumerate(text):
        edit = i % every == every - 1
        out.append(("#q" if c != "q" else "#z")[1] if edit and kind == "change" else "" if edit and kind == "delete" else c + "q" if edit else c)
    return "".join(out)


def test_leaks_of_edited_copies(spark, sf):
    """Of whole items with an edit in every 10, 15, 20 and 24 letters at least 9 in 10 are found, of either kind, and nothing else."""
    items = spark.read.parquet(f"{sf}/eval_items.parquet").where("text is not null")
    plain = {r["item_id"]: leakage.plain(r["text"]) for r in items.collect()}
    cases = [(every, kind) for every in (10, 15, 20, 24) for kind in ("change", "delete", "insert")]
    made = [(c, k, edited_copy(t, *case)) for c, case in enumerate(cases) for k, t in plain.items()]
    other = spark.read.parquet(f"{sf}/documents.parquet").select(F.lit("").alias("doc_id"), "text")
    docs = spark.createDataFrame([(f"{c}:{k}", t) for c, k, t in made], "doc_id string, text string").unionByName(other)
    got = {(r["doc_id"], r["item_id"]) for r in leakage.leaks(docs, items, edited=True).where("doc_id <> ''").collect()}
    for c, case in enumerate(cases):
        assert sum((f"{c}:{k}", k) in got for k in plain) >= 0.9 * len(plain), case
    assert sum(int(d.split(":")[1]) != i for d, i in got) <= 0.02 * len(got)


def test_leaks_refuse_one_name(spark):
    df = spark.createDataFrame([(1, "a")], "id long, text string")
    with pytest.raises(ValueError):
        leakage.leaks(df, df, "id", "id")


def test_weights():
    own, target = {"a": 0.7, "b": 0.2, "c": 0.1}, {"a": 0.2, "b": 0.4, "c": 0.4}
    assert mixing.tempered(own, 1.0, target) == pytest.approx(target) and mixing.tempered(own, 0.0, target) == pytest.approx(own)
    x, w = mixing.weights_for_entropy(own, 1.0)
    assert 0 < x < 1 and mixing.entropy(w) == pytest.approx(1.0)
    made = mixing.plan({"a": 700, "b": 200, "c": 100}, {"a": (0.2, 1), "b": (0.4, 2), "c": (0.4, 2), "none": (0.1, 9)}, None)
    assert made.exponent == 1.0 and made.budget == 500 and made.sources["c"][4] == 200 and made.sources["none"][4] == 0
    tight = mixing.plan({"a": 700, "b": 200, "c": 100}, {"a": (0.2, 1), "b": (0.4, 2), "c": (0.4, 2)}, 800)
    assert 0 < tight.exponent < 1 and tight.sources["c"][4] in (199, 200)
    assert mixing.plan({}, {"a": (1.0, 1)}, None).budget == 0 and mixing.plan({}, {"a": (1.0, 1)}, None, 0.5).budget == 0
    even = mixing.plan({"a": 700, "b": 200, "c": 100}, {"a": (0.2, 1), "b": (0.4, 2), "c": (0.4, 2)}, None, 1.0)
    weights = {s: w for s, (_, w, *_) in even.sources.items()}
    assert 0 < even.exponent < 1 and mixing.entropy(weights) == pytest.approx(1.0) and all(q <= n * m for _, _, n, m, q in even.sources.values()) and any(q >= n * m - 1 for _, _, n, m, q in even.sources.values())


def test_mix_of_nothing(spark):
    docs = spark.createDataFrame([(1, "a b c", "s"), (2, None, "s"), (3, "", "s"), (4, "x", None), (5, "y", "other")], "doc_id long, text string, source string")
    targets = spark.createDataFrame([("s", 0.5, 2), ("gone", 0.5, 3), (None, 0.1, 1)], "source string, target_share double, max_repeats int")
    tokens = mixing.token_table(docs, targets)
    made = mixing.planned(tokens, targets)
    mix = mixing.mixed(tokens, made)
    assert [r[:4] for r in rows(mix)] == [(1, "s", 0, 3), (1, "s", 1, 3)] and [0 <= r[4] <= 0.5 for r in rows(mix)] == [True, False]
    shares = {r["source"]: r for r in mixing.reached_shares(mix, made).collect()}
    assert shares["s"]["actual_share"] == 1.0 and shares["gone"]["mixed_tokens"] == 0
    none = mixing.token_table(docs.limit(0), targets)
    assert rows(mixing.mixed(none, mixing.planned(none, targets))) == []


def test_strongest_cut():
    s = np.array([RNG.randrange(4) for _ in range(100)])
    table = splitting.StrongestCut(s, 40)
    for a in range(0, 90, 7):
        for b in range(a, min(a + 40, 100)):
            place, best = table.query(a, b)
            assert best == s[a : b + 1].max() and place == max(i for i in range(a, b + 1) if s[i] == best)


def test_split_edges(spark):
    limits = spark.createDataFrame([("en", 16, 4), (None, 5, 1), ("ja", 16, 3)], "lang string, max_tokens int, overlap_tokens int")
    texts = [("en", "One two. " * 40), ("en", ""), ("en", None), ("xx", "a " * 500), (None, "b " * 50), ("ja", "漢字かな。" * 40), ("ja", "😀" * 60), ("en", "a" * 4000), ("en", "x\n\n" * 30)]
    docs = spark.createDataFrame([(k, *t) for k, t in enumerate(texts)], "doc_id long, lang string, text string").withColumns({"most": F.lit(1), "piece": F.lit(2)})
    got = {}
    for r in splitting.split_texts(docs, limits).orderBy("piece_no").collect():
        got.setdefault(r["doc_id"], []).append(r)
    assert set(got) == {0, 1, 3, 4, 5, 6, 7, 8} and [len(got[k]) for k in (1, 3, 4)] == [1, 1, 1]
    for k, own in got.items():
        text = texts[k][1]
        assert own[0]["begin_char"] == 0 and own[-1]["end_char"] == len(text) and all(b["begin_char"] <= a["end_char"] for a, b in zip(own, own[1:]))
        assert k in (3, 4) or all(r["n_tokens"] <= 16 for r in own)
    assert all(r["piece"].rstrip().endswith(".") for r in got[0]) and all(r["piece"].endswith("。") for r in got[5][:-1])
    assert rows(splitting.split_texts(docs.limit(0), limits)) == []


def test_early_boundaries_beat_words(spark):
    limits = spark.createDataFrame([("en", 16, 4)], "lang string, max_tokens int, overlap_tokens int")
    docs = spark.createDataFrame([(0, "en", "One two three four five. " + "and so on " * 30), (1, "en", "one two three four five " + "x" * 200)], "doc_id long, lang string, text string")
    first = {r["doc_id"]: r for r in splitting.split_texts(docs, limits).where("piece_no = 0").collect()}
    assert first[0]["piece"].rstrip() == "One two three four five." and first[0]["cut_strength"] >= splitting.SENTENCE_CUT
    assert first[1]["piece"].rstrip() in ("one two three four five", "one two three four") and first[1]["cut_strength"] == splitting.WORD_CUT


def test_crf_learns_transitions():
    sequences, tags = [], []
    for _ in range(200):
        n = RNG.randrange(1, 6)
        state = RNG.choice("AB")
        sequences.append([([f"start:{state}"] if i == 0 else ["same"], "") for i in range(n)])
        tags.append([state] * n)
    model = crf.Crf("AB").fit(crf.encode(sequences[:100]), tags[:100], rounds=60)
    assert model.tag(crf.encode(sequences[100:])) == tags[100:] and model.tag(crf.encode([[], sequences[0]])) == [[], tags[0]]
    assert crf.Crf("AB").fit(crf.encode([]), []).tag(crf.encode([[]])) == [[]]


def test_crf_learns_from_characters_but_not_of_tied_labels():
    """A label's weights of characters are those of the label it is tied to; named features tell the two apart."""
    words = {"A": "上下左右", "B": "山川草木"}
    data = [([(["cut"] if k % 2 else [], "".join(RNG.choice(words[t]) for _ in range(5)))], ["U" if t == "A" and k % 2 else t]) for k in range(200) for t in "AB"]
    model = crf.Crf("ABU", ("U", "A")).fit(crf.encode([s for s, _ in data]), [t for _, t in data], rounds=60)
    assert model.tag(crf.encode([s for s, _ in data])) == [t for _, t in data]
    assert (model.weights[crf.NAMED :, 0] == model.weights[crf.NAMED :, 2]).all() and model.weights[crf.NAMED :, 0].any()


def test_crf_gradient():
    """Marginals and moves against all paths."""
    model = crf.Crf("AB")
    score, moves = np.array([[[0.3, -0.2], [1.0, 0.5], [0.1, 0.7]], [[0.2, 0.4], [-1.0, 0.3], [0.0, 0.0]]]), np.array([[0.1, -0.3], [0.4, 0.2], [0.5, 0.0], [0.3, -0.1]])
    lengths = np.array([3, 2])
    marginal, moved = model._expect(score, moves, lengths)
    expected, steps = np.zeros_like(score), np.zeros_like(moves)
    for k, n in enumerate(lengths):
        paths = list(itertools.product((0, 1), repeat=int(n)))
        weight = np.exp([moves[2, p[0]] + moves[3, p[-1]] + sum(score[k, t, p[t]] for t in range(n)) + sum(moves[p[t], p[t + 1]] for t in range(n - 1)) for p in paths])
        for p, w in zip(paths, weight / weight.sum()):
            steps[2, p[0]] += w
            steps[3, p[-1]] += w
            for t in range(n):
                expected[k, t, p[t]] += w
            for t in range(n - 1):
                steps[p[t], p[t + 1]] += w
    assert np.allclose(marginal[0], expected[0]) and np.allclose(marginal[1, :2], expected[1, :2]) and np.allclose(moved, steps)


PAIRS = [
    ("ka mu:ba ya", None, "empty"), ("ka mu:ba ya", "", "empty"), ("ka mu:ba ya", "N/A", "empty"), ("ka mu:ba ya", "「」", "empty"), ("ka mu:ba ya", "（なし）", "empty"), ("ka mu:ba ya", "​", "empty"),
    ("ka mu:ba ya", "申し訳ありませんが、この文は訳せません。", "refusal"), ("ka mu:ba ya", "I'm sorry, but I can't translate this sentence.", "refusal"),
    ("ka mu:ba ya dunyi", "ka mu:ba ya dunyi", "copy"), ("ka mu:ba ya dunyi", "訳：KA MU:BA YA DUNYI", "copy"), ("ka mu:ba ya dunyi", "ｋａ　ｍｕ：ｂａ　ｙａ　ｄｕｎｙｉ。", "copy"),
    ("ka mu:ba ya", "The boat is what the story calls 「舟」.", "other_language"), ("ka mu:ba ya", "他们昨天看见了贝壳。", "other_language"), ("ka mu:ba ya", "우리는 지붕을 찾았습니다.", "other_language"),
    ("ka mu:ba ya", "「申し訳ありません」と言って、舟を数えた。", None), ("ka mu:ba ya dunyi", "「dunyi」というものの話で、塩を買った。", None), ("ka mu:ba ya", "舟を買った", None), (None, "舟を買いました。", None),
]


def test_pair_defects(spark):
    good = [(f"p{i} q{i % 7}", f"{a}{c}{b}を{v}") for i, (a, c, b, v) in enumerate(itertools.product(["舟", "塩", "祖父"], ["は", "が"], ["海", "月", "道", "風"], ["見た。", "買った。", "焼いた。", "運ぶ。", "叩いた。", "数えました。"]))]
    data = [(k, p, r) for k, (p, r) in enumerate(good)] + [(1000 + k, p, r) for k, (p, r, _) in enumerate(PAIRS)] + [(2000, "a b", "舟は海を焼い"), (2001, "a b", "舟は海を、"), (2002, "a b", "舟を見た。" * 20_000)]
    df = spark.createDataFrame(data, "k long, p string, r string").withColumns({"defect": F.lit("x"), "e": F.lit("y"), "rate": F.lit(1)})
    got = {r["k"]: r["defect"] for r in pair_defects.pair_defects(df, "k", "p", "r").collect()}
    assert [got[1000 + k] for k in range(len(PAIRS))] == [d for *_, d in PAIRS]
    assert got[2000] == got[2001] == "truncated" and got[2002] is None and all(got[k] is None for k in range(len(good)))
    assert len(got) == len(data)
    assert rows(pair_defects.pair_defects(df.limit(0), "k", "p", "r")) == []


def test_pair_defects_of_any_length(spark):
    """Length changes nothing: long nothing is empty, and every place where an answer can be cut has its ending looked up."""
    nothing = [" \n" * 600, "…" * 1000, "\u200b" * 1500, "　" * 5000 + "なし"]
    assert all(map(pair_defects.is_empty, nothing)) and not pair_defects.is_empty("舟" * 2000)
    answers = ["舟を、見た。「塩」を買った。\n" * 3, "あ" * 450 + "塩を買った。", "。。。", "ab", "", None]
    cut = {pair_defects.ending(t[:i]) for t in answers if t for i in range(3, len(t))}
    assert pair_defects._cut_endings([{"r": t} for t in answers]) == sorted(cut) and "塩を" in cut
    df = spark.createDataFrame([(k, "a b c", t) for k, t in enumerate(nothing)] + [(10 + k, f"p{k} q", "舟を見た。") for k in range(20)], "k long, p string, r string")
    assert {r["k"] for r in pair_defects.pair_defects(df, "k", "p", "r").where("defect = 'empty'").collect()} == set(range(4))


def test_foreign_clauses(spark):
    """Clauses are foreign by their own letters: a gloss in brackets or one Japanese clause doesn't make an English answer Japanese."""
    texts = [("They watched it (祭り) beside the field.", "other_language"), ("They came home late, 舟を見た。 They left the lamp near the old well.", "other_language"), ("舟を見た (the boat near the field).", None), ("昨日、舟を見た。", None), ("「舟を見た。」", None)]
    assert pair_defects.native_clauses("舟を見た。 The boat.") == [True, False] and pair_defects.native_clauses("昨日、舟を見た。") == [True, True]
    good = [(100 + k, f"p{k} q", f"{a}は{b}を見た。") for k, (a, b) in enumerate(itertools.product("舟塩月道風", "海山川村家"))]
    foreign = [(200 + k, f"p{k} q", f"She saw the {w} near the well.") for k, w in enumerate(["lamp", "boat", "roof", "field", "shell", "salt"])]
    df = spark.createDataFrame([(k, "ka mu:ba ya", t) for k, (t, _) in enumerate(texts)] + good + foreign, "k long, p string, r string")
    got = {r["k"]: r["defect"] for r in pair_defects.pair_defects(df, "k", "p", "r").collect()}
    assert [got[k] for k in range(len(texts))] == [d for _, d in texts]
