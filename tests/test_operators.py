import random

import pytest
from pyspark.sql import functions as F

from interlace.functions import alignment
from interlace.functions import annotation as A
from interlace.operators import critics, evaluation, evidence, items, licensed, proposals, scopes
from tests.conftest import rows


def one(spark, col, *values, schema="a string, b string"):
    return spark.createDataFrame([values], schema).select(col).first()[0]


def test_annotation_literals(spark):
    get = lambda f, a, b=None: one(spark, f, a, b)
    assert get(A.annotation_ids("a"), "A;cvb-B C-dat") == ["A", "cvb", "B", "C", "dat"]
    assert get(A.annotation_ids("a"), "A-r B;r C") == ["A", "B", "C"]
    assert get(A.annotation_ids("a"), None) == [] and get(A.annotation_ids("a"), "　A　B ") == ["A", "B"]
    assert get(A.alignment_error("a", "b"), "kja-ti", "x;cvb") == "segment count 2 for 1 in phrase 1"
    assert get(A.alignment_error("a", "b"), "a--b", "x-y-z") == "empty segment in phrase 1"
    assert get(A.alignment_error("a", "b"), "a b", "x") == "phrase count 2 for 1"
    assert get(A.alignment_error("a", "b"), "a-b c", "x-y z") is None
    assert get(A.boundary_offsets("a"), "-ab-cd e-f") == [2, 5]
    assert get(A.morph_surfaces("a"), "a-b a-c") == ["a", "b", "c"]
    assert get(A.sanitize_query("a", "b"), "食べる 宮古方言", "宮古") == "食べる"
    assert get(A.sanitize_query("a", "b"), None, None) == ""
    for text, rejected in (("A-B", False), ("", True), (None, True), ("A--B", True), ("-".join("ABCDEFGHI"), True), (";".join("ABCDEFGHI"), True), ("x" * 257, True)):
        assert get(A.expression_rejected("a"), text) is rejected
    assert get(A.english_key("a"), "2nd Word!") == "grammar_2nd_word"
    assert get(A.scoped_name("a", "b"), "Potential marker", "ppt>2") == "potential_marker_ppt_2"
    assert get(A.scoped_name("a", "b"), "!!", "x") is None and get(A.scoped_name("a", "b"), "x", None) is None
    assert get(A.clip("a", 2), "日本語") == "日本…" and get(A.clip("a", 3), None) is None


@pytest.mark.parametrize(("units", "shown"), [(["u", "Q_stop", "t", "a"], "utta"), (["a", "Q_fricative_s", "ʃ", "i"], "aʃʃi"), (["Q_x"], "Q_x"), (["Q_x", "a"], "Q_xa"), ([], "")])
def test_compact_units(spark, units, shown):
    assert one(spark, A.compact_units("u"), units, schema="u array<string>") == shown


def levenshtein(gold, predicted):
    """Errors of the best alignment by a table walked backwards."""
    n, m = len(gold), len(predicted)
    cost = [[i + j if not i * j else 0 for j in range(m + 1)] for i in range(n + 1)]
    for i in range(1, n + 1):
        for j in range(1, m + 1):
            cost[i][j] = cost[i - 1][j - 1] if gold[i - 1] == predicted[j - 1] else 1 + min(cost[i - 1][j - 1], cost[i - 1][j], cost[i][j - 1])
    i, j, errors = n, m, []
    while i or j:
        if i and j and gold[i - 1] == predicted[j - 1]:
            i, j = i - 1, j - 1
        elif i and j and cost[i][j] == cost[i - 1][j - 1] + 1:
            i, j = i - 1, j - 1
            errors.append((gold[i], predicted[j]))
        elif i and cost[i][j] == cost[i - 1][j] + 1:
            i -= 1
            errors.append((gold[i], alignment.MISSING))
        else:
            j -= 1
            errors.append((alignment.EXTRA, predicted[j]))
    return errors[::-1]


def test_alignment(spark):
    rng = random.Random(3)
    pairs = [([rng.choice("ABCD") for _ in range(rng.randrange(8))], [rng.choice("ABCD") for _ in range(rng.randrange(8))]) for _ in range(150)] + [([], []), (["A"], []), ([], ["A"])]
    df = spark.createDataFrame([(k, *p) for k, p in enumerate(pairs)], "k int, g array<string>, p array<string>")
    got = df.select("k", alignment.align(F.col("p"), F.col("g")).alias("a"), alignment.edit_distance(F.col("g"), F.col("p")).alias("d")).collect()
    for r in got:
        g, p = pairs[r["k"]]
        errors = levenshtein(g, p)
        a = r["a"]
        assert [tuple(e) for e in a["confusions"]] == errors and a["edits"] == len(errors) == r["d"]
        assert a["matches"] + a["substitutions"] + a["deletions"] == len(g) and a["matches"] + a["substitutions"] + a["insertions"] == len(p)


def test_segmentation_half(spark):
    df = spark.createDataFrame([(1, "ab-cd-e f", "a-bcd-e f"), (2, "x", None), (3, None, "a-b"), (4, "ab", "ac")], "k int, ai_segmented string, gold_segmented string")
    got = {r["k"]: r for r in evaluation.segmentation_rows(df, ["k"]).collect()}
    assert set(got) == {1, 3, 4} and (got[1]["precision"], got[1]["recall"], got[1]["f1"]) == (0.5, 0.5, 0.5)
    assert (got[4]["precision"], got[4]["recall"], got[4]["exact"]) == (1.0, 1.0, False)


def test_job_metrics(spark):
    df = spark.createDataFrame([(1, "A-B", "A-B"), (1, "A-X B-C", "A-Y B-C"), (1, "A", None), (1, "A", "")], "job_id int, ai_annotation string, gold_annotation string")
    r = evaluation.annotation_metrics(df, ["job_id"]).first()
    assert (r["scored"], r["gold_ids"], r["matches"], r["id_match_rate"]) == (2, 6, 5, round(5 / 6, 6))


def test_nbest(spark):
    lists = spark.createDataFrame([("u", '[{"rank":1,"units":["a","b"]},{"rank":2,"unit_text":"a c"}]'), ("v", "[]"), ("w", None)], "id string, nbest_json string")
    h = evaluation.explode_nbest(lists, "id")
    assert rows(h.select("id", "rank", "units")) == [("u", 1, ["a", "b"]), ("u", 2, ["a", "c"])]
    scored = evaluation.scored_lists(h, spark.createDataFrame([("u", ["a", "c"])], "id string, ref array<string>"), "id")
    c = h.withColumns({"alerts": F.lit(0), "confidence": F.col("rank") / 10, "score": F.lit(None).cast("double"), "failed": F.lit(None).cast("boolean")})
    s = evaluation.error_summary(scored, evaluation.best_hypothesis(c, "id"), "id").first()
    assert (s["top1_uer"], s["baseline_uer"], s["headroom_recovered"]) == (0.5, 0.0, 1.0)


def test_islands_over_stretches(spark):
    ids = {1: [*range(4090, 12300), 5, 6, 20000], 2: [4095, 4096], 3: [-1, 0]}
    df = spark.createDataFrame([(d, i) for d, v in ids.items() for i in v] + [(1, 5), (None, 3), (1, None)], "dataset_id int, sentence_id long")
    assert rows(scopes.islands(df)) == [(1, 20000, 20000, 1), (1, 4090, 12299, 8210), (1, 5, 6, 2), (2, 4095, 4096, 2)]


def test_without_ranges(spark):
    df = spark.createDataFrame([(1, 4), (1, 5), (1, 9000), (2, 5), (None, 5), (1, None)], "dataset_id int, sentence_id long")
    held = spark.createDataFrame([(1, 5, 8999)], "dataset_id int, first_id long, last_id long")
    assert len(rows(scopes.without_ranges(df, held))) == 5
    assert len(rows(scopes.without_ranges(df, held.limit(0)))) == 6


def test_top_k_matches_a_plain_window(spark):
    df = spark.createDataFrame([(g, v) for g in "ab" for v in range(50)] + [("a", 3), (None, 1)], "g string, v int")
    got = rows(evidence.top_k(df, ["g"], [F.col("v")], 4))
    assert got == sorted([("a", 0), ("a", 1), ("a", 2), ("a", 3), ("b", 0), ("b", 1), ("b", 2), ("b", 3), (None, 1)], key=repr)


def test_repair(spark):
    s = spark.createDataFrame([(1, 7, "a-mmagi b", "X-? Y"), (2, 7, "mmagi mmagi", "? ?"), (3, 8, "mmagi", "?"), (4, 7, "zz", "?"), (5, 7, None, None)], "sentence_id long, dialect_id int, segmented string, annotation string")
    lex = spark.createDataFrame([(1, 7, "mmagi", "mma-gi", "M-g"), (2, 7, "zz", "zz", "P"), (3, 7, "zz", "zz", "Q"), (4, 7, None, None, None)], "lexeme_id int, dialect_id int, form2 string, form2_seg string, annotation string")
    assert rows(licensed.repaired(s, lex)) == [(1, "a-mma-gi b", "X-M-g Y")]


def test_contained(spark):
    t = spark.createDataFrame([(1, "xabcabc"), (2, "ab"), (3, None), (4, "")], "sentence_id long, text string")
    lex = spark.createDataFrame([(9, "abc"), (8, "bcab"), (7, "ab"), (6, None)], "lexeme_id int, form2 string")
    assert rows(licensed.contained(t, lex)) == [(1, 8, "bcab", 1, 2), (1, 9, "abc", 2, 1)]


def test_proposals(spark):
    refs = spark.createDataFrame([(1, 10), (2, 11), (3, None)], "k int, ref long")
    there = spark.createDataFrame([(10,), (10,), (None,)], "sid long")
    assert rows(proposals.grounded(refs, there, "ref", "sid").select("k")) == [(1,)] and rows(proposals.missing(refs, there, "ref", "sid").select("k")) == [(2,)]
    a = spark.createDataFrame([("x", None, 5), ("x", None, 3)], "label string, s string, id int")
    b = spark.createDataFrame([("x", None, 1), ("y", "s", 2)], "label string, s string, id int")
    assert rows(proposals.united(a, b, ["label", "s"], "id")) == [("x", None, 3), ("y", "s", 2)]


def test_items(spark):
    df = spark.createDataFrame([(1, "a", "b", "c"), (2, None, "b", " "), (3, "　", "b", "c")], "row_id int, segmented string, annotation string, translation_jp string")
    assert [len(rows(items.needing(df, n))) for n in ("any", "annotation", "translation", "either", "both")] == [3, 2, 1, 2, 1]
    with pytest.raises(ValueError):
        items.needing(df, "all")
    seg = spark.createDataFrame([(k, s, "faira") for k, s in enumerate(["fai-ra", "fa-ira", "fai--ra", "fai-r", None])], "k int, s string, t string")
    assert rows(items.accepted_segmentations(seg, "k", "s", "t")) == [(0, True), (1, True), (2, False), (3, False)]
    payload = spark.createDataFrame([(1, '```json\n{"decision":"Proposed","confidence":0.5,"segmented":" a "}\n```'), (2, '{"decision":"maybe"}'), (3, None), (4, '{"decision":"failed","confidence":2}')], "k int, p string")
    assert [(r["k"], r["valid"], r["segmented"]) for r in sorted(items.parsed_payload(payload, "p", "k").collect())] == [(1, True, "a"), (2, False, ""), (3, False, ""), (4, False, "")]


def test_pattern_search_finds_atoms(spark):
    texts = ["akk", "x-add;akk y", "akk;add", "akkx;add", "A;cvb-dat", "A-dat", "r", None]
    sentences = spark.createDataFrame(list(enumerate(texts)), "sentence_id int, annotation string")
    expressions = spark.createDataFrame([("akk",), ("akk;add",), ("A",), ("A-dat",), ("dat",)], "expression string")
    assert rows(evidence.pattern_search(sentences, expressions)) == [("A", 4), ("A", 5), ("A-dat", 5), ("akk", 0), ("akk", 1), ("akk", 2), ("akk;add", 2), ("dat", 4), ("dat", 5)]
    assert rows(evidence.pattern_search(sentences, expressions, most=2).where("expression = 'akk'")) == [("akk", 0), ("akk", 1)]


def test_target_probes_of_all_labels(spark):
    """The first probes of each label and dialect, as from the full product."""
    rng = random.Random(4)
    lexemes = spark.createDataFrame([(k, k % 3, f"w{k}", f"w{k}", f"L{k}", rng.choice("nvao")) for k in range(100)], "lexeme_id int, dialect_id int, form2 string, form2_seg string, annotation string, pos string")
    forms = spark.createDataFrame([(k, k % 4, rng.choice(["corpus", "lexicon", None]), rng.choice(["akk", "akk", "akk", "dat", "cvb", None]), f"s{k}") for k in range(200)], "form_row_id int, dialect_id int, form_source string, label string, surface string")
    every = proposals.probes(proposals.hosts(lexemes), forms.where("label is not null"))
    groups = {}
    for r in every.collect():
        groups.setdefault((r["annotation"].split("-")[1], r["dialect_id"]), ([], []))[r["form_source"] != "corpus"].append((r["lexeme_id"], r["form_row_id"]))
    expected = set()
    for target, (own, other) in groups.items():
        q = min(len(own), 8 if other else 24)
        expected |= {(*target, *p) for p in sorted(own)[:q] + sorted(other)[: 24 - q]}
    got = [(r["label"], r["dialect_id"], r["lexeme_id"], r["form_row_id"]) for r in proposals.target_probes(proposals.hosts(lexemes), forms).collect()]
    assert set(got) == expected and len(got) == len(expected) and {g[0] for g in got} == {"akk", "dat", "cvb"}


def test_edit_distance_of_many_tokens(spark):
    """Tokens beyond the 16-bit characters, surrogates left out, have a character of their own too; more than there are is an error."""
    def distance(a, b):
        return one(spark, alignment.edit_distance(F.col("a"), F.col("b")), a, b, schema="a array<string>, b array<string>")

    first = 0xD800 - alignment._FIRST
    words = [f"w{i}" for i in range(first + 3000)]
    few = words[first - 2 : first + 3] + words[-2:]
    assert distance(["x"], words[:2]) == 2 and distance([], []) == 0 and distance(None, ["x"]) is None
    coded = [alignment._FIRST + i + (alignment._SURROGATES[1] if i >= first else 0) for i in range(len(words))]
    assert len(set(coded)) == len(coded) and not any(0xD800 <= c < 0xE000 for c in coded) and few
    got = spark.range(1).select(F.array_join(F.transform(F.array(*[F.lit(c) for c in (0x4E00, 0xD7FF, 0xE000, 0x10000, 0x10FFFF)]), lambda n: F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32")), "")).first()[0]
    assert list(map(ord, got)) == [0x4E00, 0xD7FF, 0xE000, 0x10000, 0x10FFFF]


def test_alignment_against_the_table(spark):
    """Errors read off on the way back are those that a table of whole alignments holds."""
    rng = random.Random(4)

    def table(g, p):
        best = [[None] * (len(p) + 1) for _ in range(len(g) + 1)]
        for i in range(len(g) + 1):
            for j in range(len(p) + 1):
                if i and j and g[i - 1] == p[j - 1]:
                    best[i][j] = best[i - 1][j - 1]
                    continue
                ways = ([(best[i - 1][j - 1], (g[i - 1], p[j - 1]))] if i and j else []) + ([(best[i - 1][j], (g[i - 1], alignment.MISSING))] if i else []) + ([(best[i][j - 1], (alignment.EXTRA, p[j - 1]))] if j else [])
                best[i][j] = [] if not ways else min(((len(b), k, [*b, e]) for k, (b, e) in enumerate(ways)), key=lambda w: w[:2])[2]
        return best[-1][-1]

    data = [([rng.choice("abc") for _ in range(rng.randrange(0, 8))], [rng.choice("abc") for _ in range(rng.randrange(0, 8))]) for _ in range(120)]
    df = spark.createDataFrame([(k, g, p) for k, (g, p) in enumerate(data)], "k int, g array<string>, p array<string>")
    for r in df.select("k", alignment.align(F.col("p"), F.col("g")).alias("a")).collect():
        g, p = data[r["k"]]
        assert [tuple(e) for e in r["a"]["confusions"]] == table(g, p)


def test_probe_outcomes(spark):
    lexicon = spark.createDataFrame([(1, "R", "abc", None), (2, "R", None, "a-bd"), (3, None, "abe", "abe")], "lexeme_id int, region string, form2 string, form2_seg string")
    base = {"text": "abc", "segmented": "a-bc", "annotation": "X-Y", "dialect_id": 7, "region": "R", "model_segmented": "a-bc", "model_annotation": "X-Y"}
    cases = [
        ({}, "model_exact", 1), ({"region": " "}, "missing_probe_scope", 0), ({"dialect_id": None}, "missing_probe_scope", 1), ({"annotation": "X"}, "validation_rejected", 1), ({"segmented": None}, "validation_rejected", 1), ({"segmented": "a--bc"}, "validation_rejected", 1),
        ({"model_segmented": None, "model_annotation": ""}, "model_error", 1), ({"model_segmented": None}, "model_failed_already_licensed", 1), ({"text": "abd", "segmented": "a-bd", "model_annotation": "Z"}, "model_failed_already_licensed", 1),
        ({"text": "abe", "segmented": "a-be"}, "model_failed_candidate", 0),
    ]
    names = ["k", *base]
    df = spark.createDataFrame([(k, *(base | change).values()) for k, (change, _, _) in enumerate(cases)], "k int, text string, segmented string, annotation string, dialect_id int, region string, model_segmented string, model_annotation string")
    assert names == df.columns
    assert rows(proposals.probe_outcomes(df, lexicon, "k")) == [(k, kind, n) for k, (_, kind, n) in enumerate(cases)]
    assert rows(proposals.probe_outcomes(df.limit(0), lexicon, "k")) == [] and proposals.probe_outcomes(df, lexicon.limit(0), "k").count() == len(cases)


def test_surprises_and_triage(spark):
    """A step that the model hasn't seen is a hotspot for its own result's segments only."""
    corpus = spark.createDataFrame([(k, "A-B C" if k else "A-B;D C") for k in range(30)], "sentence_id long, annotation string")
    results = spark.createDataFrame([(1, "a-b c", "A-B C", 0.9), (2, "a-b c", "A-C C", 0.9), (3, "a-x", "A-?;B", 0.5), (4, None, None, 0.1)], "result_id long, ai_segmented string, ai_annotation string, confidence double")
    both = [critics.surprises(results, critics.sequence_model(corpus, unit=u), "result_id", "ai_annotation", u) for u in ("atom", "segment")]
    found = both[0].unionByName(both[1])
    places = {(r["result_id"], r["unit"], r["previous"], r["token"]): r["alternatives"] for r in found.collect()}
    assert places[2, "atom", "A", "C"] == "B:30" and (2, "segment", "A", "C") in places and not any(k[0] == 1 for k in places)
    assert places[3, "segment", "?;B", "<EOS>"] is None
    segments = evidence.segment_pairs(results.selectExpr("result_id as sentence_id", "ai_segmented as segmented", "ai_annotation as annotation")).withColumnRenamed("sentence_id", "result_id")
    margin = spark.createDataFrame([("b", 0.01), ("c", None)], "surface string, margin double")
    got = {(r["result_id"], r["surface"], r["label"]): r["reasons"] for r in critics.segment_triage(results, segments, margin, found).collect()}
    assert got[1, "b", "B"] == "small_alternative_margin" and (1, "c", "C") not in got
    assert got[2, "b", "C"] == "small_alternative_margin,id_sequence_hotspot" and got[2, "a", "A"] == "id_sequence_hotspot" and got[3, "x", "?;B"].startswith("low_confidence,unknown_id")


def test_context_review(spark):
    """The narrowest context with enough evidence decides; other dialects only where the own has too little."""
    pairs = [(k, 7, "p", "x", "e", "L", False) for k in range(5)] + [(10 + k, 7, "p", "y", "e", "L", False) for k in range(2)] + [(20 + k, 8, "q", "z", "f", "L", False) for k in range(9)] + [(40, 9, "q", "x", "f", "L", True), (41, None, "q", "w", "f", "M", True)]
    df = spark.createDataFrame(pairs, "sentence_id int, dialect_id int, previous_surface string, surface string, next_label string, label string, phrase_start boolean")
    got = {(r["dialect_id"], r["surface"], r["label"]): (r["level"], r["best"], r["strong"]) for r in critics.context_scores(df).collect()}
    assert got == {(7, "x", "L"): (0, "x", False), (7, "y", "L"): (0, "x", True), (8, "z", "L"): (0, "z", False), (9, "x", "L"): (3, "z", False), (-1, "w", "M"): (None, None, False)}
    review = {r["sentence_id"]: tuple(r)[1:] for r in critics.context_review(df).collect()}
    assert review[10] == (1, 1, 1) and review[41] == (1, 0, 0) and len(review) == len(pairs)
    assert rows(critics.context_review(df.limit(0))) == []


def test_revisions_are_reviewed(spark):
    data = [(1, "a-b", "X-Y", "ab", "X", "ab"), (2, "a-b", "X-Y", "a-b", "X-Y", "ab"), (3, "ab", "X", "a-b", "X", "ab"), (4, None, None, None, None, None)]
    df = spark.createDataFrame([(*r, 0.4, 0.9) for r in data], "k int, s0 string, a0 string, s1 string, a1 string, text string, c0 double, c1 double")
    got = rows(critics.reviewed(df, "k", ("s0", "a0"), ("s1", "a1"), "text", ("c0", "c1")))
    assert [(r[1], r[2], r[3], r[5]) for r in got] == [("revise", "changed", "ab", 0.9), ("keep", "unchanged", "a-b", 0.4), ("keep", "unsound", "ab", 0.4), ("keep", "unchanged", "", 0.4)]


def test_sequences_across_phrases_and_exclusion(spark):
    df = spark.createDataFrame([(1, "A-B C"), (2, "B;D-C"), (3, "B C")], "sentence_id long, annotation string")
    asked = spark.createDataFrame([("B-C",), ("D",), (None,)], "expression string")
    held = spark.createDataFrame([(3,), (None,)], "sentence_id long")
    assert rows(evidence.pattern_search(df, asked)) == [("D", 2)]
    assert rows(evidence.pattern_search(df, asked, across=True)) == [("B-C", 1), ("B-C", 3), ("D", 2)]
    assert rows(evidence.pattern_search(df, asked, across=True, excluded=held)) == [("B-C", 1), ("D", 2)]


def test_lookup_hosts_phrases_and_forms(spark):
    forms = spark.createDataFrame([("L", 1), ("L", 1), ("L", 2), (None, 1)], "label string, annotation_schema_id int")
    lexicon = spark.createDataFrame([(5, "M", " n ", "R", "ab", "a-b"), (6, None, "v", "R", "c", "a-c")], "lexeme_id int, annotation string, pos string, region string, form2 string, form2_seg string")
    asked = spark.createDataFrame([("L", 1), ("L", 3), ("M", 1), ("N", 1), ("N", 1)], "label string, annotation_schema_id int")
    assert rows(evidence.looked_up(asked, forms, lexicon).select("label", "annotation_schema_id", "local_forms", "global_forms", "lexemes", "scope")) == [("L", 1, 2, 3, 0, "local"), ("L", 3, 0, 3, 0, "global"), ("M", 1, 0, 0, 1, "global"), ("N", 1, 0, 0, 0, "none")]
    claims = spark.createDataFrame([(1, 5, "n"), (1, 5, "n"), (2, 5, "v"), (3, 9, "n"), (4, None, "n")], "k int, lexeme_id int, pos string")
    assert rows(proposals.cited_hosts(claims, lexicon, "pos").select("k")) == [(1,)]
    phrases = spark.createDataFrame([(1, "A", "A-B"), (2, "A", "A")], "k int, id string, phrase string")
    assert rows(proposals.grounded_phrases(phrases, phrases.where("k = 1"))) == [("A", "A-B", 1)]
    sentences = spark.createDataFrame([(1, "R", "ac-ab"), (2, None, "ab")], "sentence_id long, dialect_region string, segmented string")
    assert rows(licensed.exact(sentences, lexicon)) == [(1, 5, "ab")] and rows(licensed.exact(sentences, lexicon, ["form2", "form2_seg"])) == [(1, 5, "ab"), (1, 6, "ac")]


def test_broken_answers(spark):
    whole = '{"decision": "Proposed", "confidence": 0.5, "segmented": "a", "annotation": "X", "trsl_ai": "y"}'
    texts = [whole, f"```json\n{whole}\n```", whole[:40], f"[{whole}]", "sorry", None, "", '{"decision": "other"}', '{"confidence": "x"}', whole + whole[:5]]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, payload string")
    got = rows(items.parsed_payload(df, "payload", "k"))
    assert [r[-1] for r in got] == [True, True] + [False] * 8 and [r[1] for r in got[2:7]] == [None] * 5 and got[7][1] == "other"


def test_containment_over_stretches(spark, monkeypatch):
    """Forms at the edges of stretches are found once, by broadcast and by shuffling."""
    text = "".join(random.Random(3).choice("ab") for _ in range(700))
    texts = spark.createDataFrame([(1, text), (2, "ab"), (3, None), (4, ""), (None, "xabab")], "sentence_id long, text string")
    lexicon = spark.createDataFrame([(k, f) for k, f in enumerate(["aba", " abba ", "bb", text[250:262], text[511:520], None, "aba"])], "lexeme_id int, form2 string")
    expected = sorted(((key, k, f, n, at) for key, t in [(1, text), (None, "xabab")] for k, f in enumerate(["aba", "abba", None, text[250:262], text[511:520], None, "aba"]) if f and (n := sum(t.startswith(f, i) for i in range(len(t)))) and (at := t.find(f)) >= 0), key=repr)
    assert rows(licensed.contained(texts, lexicon)) == expected
    monkeypatch.setattr(licensed, "fits", lambda *a: False)
    assert rows(licensed.contained(texts, lexicon)) == expected and rows(licensed.contained(texts.limit(0), lexicon)) == []


def test_support_of_proposals(spark):
    pairs = spark.createDataFrame([("R", "a", "X")] * 20 + [("R", "a", "Y")] + [("S", "a", "Z"), (None, "a", "Q"), ("R", "b", "X")], "dialect_region string, surface string, label string")
    lexicon = spark.createDataFrame([("R", "a", "W"), ("R", "a", None)], "region string, form2 string, annotation string")
    asked = [("a", "X", "R"), ("a", "Y", "R"), ("a", "Z", "R"), ("a", "W", "R"), ("b", "Z", "R"), ("q", "X", "R"), ("a", "X", None)]
    got = {(r["surface"], r["label"], r["region"]): (r["candidate_count"], r["surface_total"], r["penalty"]) for r in evidence.proposal_support(spark.createDataFrame(asked, "surface string, label string, region string"), pairs, lexicon).collect()}
    assert got == dict(zip(asked, [(20, 22, "none"), (1, 22, "weak"), (0, 22, "strong"), (1, 22, "weak"), (0, 1, "none"), (0, 0, "none"), (0, 0, "none")]))


def test_selection_summary(spark):
    lists = spark.createDataFrame([("u", 1, ["a", "x"], ["a", "b"], 0.2), ("u", 2, ["a", "b"], ["a", "b"], 0.9), ("v", 1, ["c"], ["c"], None), ("v", 2, ["d"], ["c"], 0.1), ("w", 1, ["e"], ["e"], 0.5), ("w", 2, ["e"], ["e"], 0.5)], "k string, rank int, units array<string>, ref array<string>, confidence double")
    scored = evaluation.scored_lists(lists, None, "k")
    first = lists.groupBy("k").agg(F.min("rank").alias("baseline_rank"))
    got = evaluation.selection_summary(scored, first, evaluation.chosen_hypothesis(lists, "k"), "k").first().asDict()
    assert {c: got[c] for c in ("lists", "ref_units", "top1_edits", "agent_edits", "oracle_edits", "rank1_retained", "agent_changed", "improved", "harmful", "neutral", "oracle_selected")} == {
        "lists": 3, "ref_units": 4, "top1_edits": 1, "agent_edits": 1, "oracle_edits": 0, "rank1_retained": 1, "agent_changed": 2, "improved": 1, "harmful": 1, "neutral": 1, "oracle_selected": 2,
    }
    assert got["baseline_headroom_recovered"] == 0.0 and evaluation.selection_summary(scored.limit(0), first, first.withColumnRenamed("baseline_rank", "agent_rank"), "k").first()["agent_headroom_recovered"] is None
