"""Queries with SQL against DuckDB, the others against brute force over the whole small tables."""

import pytest

pytest.importorskip("interlace.llm")

from interlace.llm.queries import ORACLES, QUERIES  # noqa: E402
from tests.conftest import compare, rows  # noqa: E402


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(name, spark, sf):
    got, expected = compare(name, QUERIES, ORACLES, spark, sf)
    assert got == expected


def test_leaks_against_all_pairs(spark, sf):
    from interlace.llm.leakage import plain

    grams = {}
    for r in spark.read.parquet(f"{sf}/eval_items.parquet").collect():
        p = plain(r["text"])
        for i in range(len(p) - 49):
            grams.setdefault(p[i : i + 50], set()).add(r["item_id"])
    expected = set()
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        p = plain(r["text"])
        expected |= {(r["doc_id"], k) for i in range(len(p) - 49) for k in grams.get(p[i : i + 50], ())}
    got = rows(QUERIES["p7_found"](spark, sf))
    assert set(got) == expected and len(got) == len(expected) > 0


def test_lookalikes_against_all_pairs(spark, sf):
    import re
    import unicodedata

    invisible = re.compile("[​-‏⁠﻿\xad]")
    letters = dict(zip("аіїѕурνоһесхј力口工卜八夕二りへべぺ一", "aiïsypvohecxjカロエトハタニリヘベペー"))

    def seen(text):
        text = re.sub(r"\s", " ", unicodedata.normalize("NFKC", invisible.sub("", text)))
        return unicodedata.normalize("NFC", "".join(letters.get(c, c) for c in text))

    expected = set()
    table = spark.read.parquet(f"{sf}/sentences.parquet").select("row_id", "text", "translation_jp").collect()
    for field in ("text", "translation_jp"):
        groups = {}
        for r in table:
            if r[field] is not None:
                groups.setdefault(seen(r[field]), []).append((r["row_id"], r[field]))
        expected |= {(field, min(a, b), max(a, b)) for g in groups.values() for a, x in g for b, y in g if a < b and x != y}
    got = rows(QUERIES["p3_found"](spark, sf))
    assert set(got) == expected and len(got) == len(expected)


@pytest.mark.parametrize("kind", ["targets", "budget", "entropy"])
def test_mix_holds_its_limits(spark, sf, kind):
    from interlace.llm.mixing import mixed, token_table
    from interlace.llm.queries import _mixes

    targets = spark.read.parquet(f"{sf}/mix_targets.parquet")
    tokens = token_table(spark.read.parquet(f"{sf}/documents.parquet"), targets)
    mix, made = _mixes(tokens, targets, kind)
    assert made.exponent == 1.0 if kind == "targets" else 0 < made.exponent < 1
    uses = rows(mix)
    assert len({(r[0], r[2]) for r in uses}) == len(uses)
    longest = max(r["n_tokens"] for r in tokens.collect())
    for source, (target, weight, available, repeats, quota) in made.sources.items():
        own = [r for r in uses if r[1] == source]
        assert all(r[2] < repeats for r in own)
        assert abs(sum(r[3] for r in own) - quota) <= longest / 2 + 1 if available else not own
        if kind == "budget" and available:
            assert quota <= available * repeats
    assert rows(mixed(tokens.repartition(7), made)) == uses
    assert all(0 <= r[4] <= 1 for r in uses)


def test_mix_is_even_in_its_order(spark, sf):
    """In the order of `at` each half of the mix has a large source's tokens in about the same share."""
    uses = sorted(QUERIES["p8_mix"](spark, sf).collect(), key=lambda r: r["at"])
    half = [uses[: len(uses) // 2], uses[len(uses) // 2 :]]
    for source in {r["source"] for r in uses}:
        n = [sum(r["source"] == source for r in part) for part in half]
        assert abs(n[0] - n[1]) <= 4 * (sum(n) ** 0.5) + 2


def test_shares_of_the_mixes(spark, sf):
    got = {(r["mix"], r["source"]): r for r in QUERIES["p8_shares"](spark, sf).collect()}
    mixes = {m for m, _ in got}
    assert mixes == {"targets", "budget", "entropy"} and len({r["exponent"] for r in got.values()}) == 3
    assert all(abs(sum(r["actual_share"] for (m, _), r in got.items() if m == mix) - 1) < 1e-6 for mix in mixes)
    assert all(r["most_uses"] <= r["max_repeats"] for r in got.values())


def test_pieces_of_all_documents(spark, sf):
    from interlace.llm.tokens import encoding

    enc = encoding()
    limits = {r["lang"]: (r["max_tokens"], r["overlap_tokens"]) for r in spark.read.parquet(f"{sf}/piece_limits.parquet").collect()}
    documents = {r["doc_id"]: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    pieces = {}
    for r in QUERIES["p9_pieces"](spark, sf).collect():
        pieces.setdefault(r["doc_id"], []).append(r)
    assert set(pieces) == {k for k, r in documents.items() if r["text"] is not None}
    for k, own in pieces.items():
        own.sort(key=lambda r: r["piece_no"])
        text, lang = documents[k]["text"], documents[k]["lang"]
        most, overlap = limits.get(lang, (10**9, 0))
        assert own[0]["begin_char"] == 0 and own[-1]["end_char"] == len(text)
        for r in own:
            assert r["piece"] == text[r["begin_char"] : r["end_char"]]
            assert len(enc.encode_ordinary(r["piece"])) <= r["n_tokens"] <= most
        for a, b in zip(own, own[1:]):
            assert a["begin_char"] < b["begin_char"] <= a["end_char"] < b["end_char"]
            shared = len(enc.encode_ordinary(text[b["begin_char"] : a["end_char"]]))
            assert overlap - 2 <= shared <= overlap + 3


def test_pair_defects_held_out(spark, sf):
    """Answers of the table made defective in known ways, none of them in the fit's own dress: at least 95 % of each kind are found."""
    import random

    from interlace.llm.pair_defects import pair_defects

    rng = random.Random(5)
    judged = {r["result_id"]: r["defect"] for r in QUERIES["p4_pairs"](spark, sf).collect()}
    table = spark.read.parquet(f"{sf}/job_results.parquet").select("result_id", "text", "trsl_ai").where("text is not null").collect()
    whole = [r for r in table if r["result_id"] in judged and judged[r["result_id"]] is None and r["trsl_ai"].endswith("。") and len(r["trsl_ai"]) > 9]
    assert len(whole) > 60
    broken = {
        "empty": lambda p, a: rng.choice(["null", "【】", "\n \n", "（なし）", "N/A"]), "refusal": lambda p, a: rng.choice(["恐れ入りますが、翻訳は差し控えます。", "Sorry, I am unable to provide this.", "この文は訳せません。申し訳ありません。"]),
        "copy": lambda p, a: rng.choice(["<{}>", "answer: {}", "{} {}", "{}?"]).replace("{}", rng.choice([p, p.title()])), "other_language": lambda p, a: rng.choice(["She left the lamp near the old well.", "他把灯笼放在旁边了。", "El barco no vuelve hoy."]),
        "truncated": lambda p, a: a[: a.rindex(next(c for c in "をがはにと" if c in a)) + 1] if any(c in a for c in "をがはにと") else a[:3] + "を",
    }
    data, truth = [], {}
    for r in whole:
        for kind, make in (*broken.items(), (None, lambda p, a: a)):
            if kind != "copy" or len(r["text"].split()) > 1:
                truth[len(data)] = kind
                data.append((len(data), r["text"], make(r["text"], r["trsl_ai"])))
    got = {r["k"]: r["defect"] for r in pair_defects(spark.createDataFrame(data, "k long, p string, r string"), "k", "p", "r").collect()}
    for kind in (*broken, None):
        own = [k for k, v in truth.items() if v == kind]
        assert sum(got[k] == kind for k in own) >= 0.95 * len(own), (kind, [(data[k], got[k]) for k in own if got[k] != kind][:5])


#: A development set, not held out: the parts that the fit uses were widened, and its settings chosen, while looking at what of these was
#: missed. README has the figures of lists that were written afterwards and used once.
UNSEEN_REFUSALS = [
    "訳は控えます。", "翻訳は難しいです。", "原文には「ka」と書かれていますが、翻訳できません。", "この一文を訳すのは私の力を超えています。", "お力になれず申し訳ございません。", "訳出は差し控えたく存じます。", "ちょっと分かりかねます。", "翻訳しかねる文です。", "日本語に直すことは不可能です。", "この発話の翻訳はご容赦ください。", "意味が取れませんので、訳は付けられません。",
    "この文章の意味は判明しませんでした。", "訳すことができない文です。", "この部分は翻訳不能です。", "対応する日本語が見つかりません。", "お答えは致しません。", "翻訳結果を返すことができませんでした。", "ご期待に沿えませんが、訳は用意できません。", "申し訳ないのですが、これを日本語にするのは無理があります。", "解読に失敗したため、訳文をご用意できませんでした。", "私どもでは、この言い回しをお訳しできかねます。", "すみません、意味を把握できていません。",
    "I'd rather not translate this.", "I have no idea what this says, so I'll skip it.", "Translation declined.", "That is something I'm not going to translate.", "I will pass on this one, sorry.", "My apologies, this one cannot be put into Japanese.", "Je ne traduirai pas cette phrase.", "No puedo traducir esto.", "我没有办法翻译这个。", "이건 번역하지 못합니다.",
]
REPORTING_ANSWERS = [
    "村の祭りは見送りとなった。", "会議は保留となった。", "父はお断りの手紙を書いた。", "先生は翻訳を断った。", "祖母は答えられなかった。", "兄は申し訳ない顔をした。", "訳もなく泣いた。", "客は誘いを断って帰った。", "彼は原文を読めなかった。", "「訳せません」と先生が言った。", "父は酒を飲みません。", "娘は返事をしないと言われた。", "旅は延期となりました。", "役場は許可を出しませんでした。",
    "その話はできないと村長が言った。", "母は「ごめんなさい」と書いて送った。", "医者は往診を断りました。", "祖父は質問に答えない人だった。", "この村には学校がありません。", "雨で祭りは中止です。", "舟は来ません。", "言葉が分からず困った。", "彼女は翻訳の仕事を辞めた。", "空は暗く、海は見えません。", "漁師は網を貸すのを嫌がった。", "嫁は里帰りを許されなかった。", "店主は値引きに応じなかった。",
    "「もう無理です」と弟が叫んだ。", "役人は書類の受け取りを拒否した。", "村人は井戸の使用を控えた。", "残念そうに祖父は首を振った。", "船頭は申し訳なさそうに頭を下げた。",
]


def test_pair_defects_of_other_wording(spark):
    """Refusals in other words than the data's, and whole answers that report of declining, among the results of a table: at least 9 in
    10 are found, and of the answers at most one is taken for defective. It guards against falling back; it measures nothing unseen."""
    from pyspark.sql import functions as F

    from interlace.llm.pair_defects import pair_defects
    from interlace.llm.queries import _pairs

    base = _pairs(spark, "/root/testdata/sf0.01").select(F.lit("").alias("k"), F.col("text").alias("p"), F.col("trsl_ai").alias("r"))
    own = spark.createDataFrame([(f"{k}{i}", "ka mu:ba ya dunyi", t) for k, texts in (("R", UNSEEN_REFUSALS), ("A", REPORTING_ANSWERS)) for i, t in enumerate(texts)], "k string, p string, r string")
    got = {r["k"]: r["defect"] for r in pair_defects(base.unionByName(own), "k", "p", "r").where("k <> ''").collect()}
    missed = [t for i, t in enumerate(UNSEEN_REFUSALS) if got[f"R{i}"] != "refusal"]
    false = [t for i, t in enumerate(REPORTING_ANSWERS) if got[f"A{i}"]]
    assert len(missed) <= 0.1 * len(UNSEEN_REFUSALS) and len(false) <= 1, (missed, false)


def test_mixed_answers_have_mixed_tags(spark):
    """A refusal beside an answer of the same length covers half, a short remark doesn't."""
    from interlace.llm.pair_defects import pair_defects
    from interlace.llm.queries import _pairs

    from pyspark.sql import functions as F

    texts = [("舟を見た。申し訳ありませんが、後の文は訳せません。", "refusal"), ("祖父は昨日の朝早くに山の畑で芋を掘って、村の市場へ運んで、夕方に塩と魚を買って帰って来た。申し訳ありませんが、この先は翻訳できません。", None)]
    base = _pairs(spark, "/root/testdata/sf0.01").select(F.lit("").alias("k"), F.col("text").alias("p"), F.col("trsl_ai").alias("r"))
    own = spark.createDataFrame([(str(i), "ka mu:ba ya dunyi", t) for i, (t, _) in enumerate(texts)], "k string, p string, r string")
    got = {r["k"]: r for r in pair_defects(base.unionByName(own), "k", "p", "r").where("k <> ''").collect()}
    assert [got[str(i)]["defect"] for i in range(len(texts))] == [d for _, d in texts] and [0 < got[str(i)]["answer_share"] < 1 for i in range(len(texts))] == [True, True], got
