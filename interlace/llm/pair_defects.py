"""Broken prompt and response pairs: a conditional random field tags the clauses of each response, and the coverage of the tags
gives the pair's defect.

Tags are answer, refusal, echo, foreign and unfinished. A clause's features are its own: its characters in runs of one to four (what
stands in quotation marks or brackets counts as one sign), its script, how much of it is the prompt's and how much of the prompt it
is, and of the last one how it ends. The field is fitted in two rounds. First on made sentences (refusals, reports of them, plain
narrative, prompts given back, whole answers cut off, mixtures of these) and on the clear part of a bounded sample of the given
pairs; then on the whole sample, whose doubtful part the first round has tagged, so that it takes in the words that the data use.

How often an ending (its last two letters) is followed by a final mark is counted over all responses; it tells endings of sentences
from places where a response broke off.

Defined cases: a null or empty response is 'empty'; a null prompt can't be copied; repeated rows are each judged; an empty table
gives an empty result; texts are judged whole, whatever their length.
"""

from __future__ import annotations

import random
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from interlace.llm import pair_sentences as made
from interlace.llm.crf import Crf, encode
from interlace.plans.storage import fits, written

#: At most so many pairs are labelled for the fit; their order is a hash of the key.
FIT_ROWS = 4000
#: So many responses are made for the fit.
SENTENCES = 6000
#: Longer pairs are judged, but not among those.
FIT_CHARS = 4000
#: A clause with that share of the prompt in it, or of a clause with Japanese around it that larger one, and responses with that share
#: of the prompt give it back.
COPIED, COPIED_NATIVE = (0.6, 0.5), 0.75
TAGS = ("answer", "refusal", "echo", "foreign", "unfinished")
#: The words of an answer that breaks off are those of any answer.
TIED = ("unfinished", "answer")

# Words that stand for nothing; what an echo may be dressed in; final marks; marks and blanks after an ending.
NOTHING = {"", "none", "null", "na", "nil", "nan", "nothing", "empty", "blank", "undefined", "tbd", "なし", "無し", "無", "該当なし", "訳なし", "訳無し", "空", "空白", "空欄", "未訳", "未記入", "未入力", "不明", "特になし", "無回答", "回答なし", "没有", "无", "無い", "ない", "없음"}
DRESS = ("日本語訳", "日本語翻訳", "日本語", "翻訳結果", "翻訳", "和訳", "訳文", "未訳", "原文", "回答", "答え", "出力", "訳", "translation", "japanese", "answer", "output")
FINAL = "。.!?！？｡"
TRAILING = re.compile(r"[\s…‥・。．.!?！？｡、，,､」』）)\]\"”’~〜ー―—-]+$")
#: In a text with any of these it may be its own translation that is spoken of; such texts wait for the second round.
TALK = re.compile(r"訳|翻|原文|回答|答え|応じ|控え|断|保留|対象|空欄|お手伝い|言語モデル|アシスタント|申し訳|ごめん|すみません|恐れ入り|残念|ません|かね|いたし|ください|\b(?:i|i'm|we|my|me|sorry|unfortunately|please|translat\w*|answer|request|sentence|text|unable|cannot|can't|won't|help|provide)\b|译|抱歉|번역|죄송|traduc|traduz|tradu|übersetz|перев|menerjemah", re.I)
_TRAILING = re.compile(TRAILING.pattern.removesuffix("+$"))
CLAUSE = re.compile(r"[^、。！？!?…‥\n｡､]+[、。！？!?…‥\n｡､」』）)\"”]*|[、。！？!?…‥\n｡､]+")
_KANA, _HAN = re.compile("[ぁ-ゖァ-ヺｦ-ﾝ]"), re.compile("[㐀-鿿々]")
_OTHER = re.compile(r"[\W_]+")
_LATIN, _CYRILLIC, _HANGUL, _WORD = re.compile("[A-Za-zÀ-ɏ]"), re.compile("[Ѐ-ӿ]"), re.compile("[가-힣]"), re.compile(r"\w")
_QUOTED = re.compile("「[^」]*」|『[^』]*』|“[^”]*”|\"[^\"]*\"")


_BRACKETED = re.compile(_QUOTED.pattern + r"|（[^）]*）|\([^)]*\)|【[^】]*】|\[[^\]]*\]")


def native_clauses(text: str) -> list[bool]:
    """Of each clause, whether it is Japanese by its own letters outside quotation marks and brackets, where there are any. Clauses
    without a script of their own, or of Chinese characters only, are as the others."""
    bare = _BRACKETED.sub(lambda m: " " * len(m[0]), text)
    if not plain(bare):
        bare = text
    kana = bool(_KANA.search(bare))
    out = []
    for m in CLAUSE.finditer(text):
        own = bare[m.start() : m.end()]
        other = _LATIN.search(own) or _HANGUL.search(own) or _CYRILLIC.search(own)
        out.append(bool(_KANA.search(own)) or (kana and (bool(_HAN.search(own)) or not other)))
    return out


def plain(text: str | None) -> str:
    """Letters and digits only, of one width and case."""
    return _OTHER.sub("", unicodedata.normalize("NFKC", text).lower()) if text else ""


def is_empty(response: str | None) -> bool:
    """Nothing, or only blanks, marks or a word for nothing."""
    return plain(response) in NOTHING


def ending(text: str) -> str:
    """The last two letters before trailing marks and blanks."""
    return TRAILING.sub("", text)[-2:]


def shared(text: str, other: set[str]) -> int:
    """Characters of a plain text that lie in a trigram of the set."""
    marks = bytearray(len(text))
    for i in range(len(text) - 2):
        if text[i : i + 3] in other:
            marks[i : i + 3] = b"\1\1\1"
    return sum(marks)


def trigrams(text: str) -> set[str]:
    return {text[i : i + 3] for i in range(len(text) - 2)}


@dataclass
class Pair:
    """A pair's response in clauses, with their features, how much of the prompt each gives back, and whether it is Japanese."""

    clauses: list[str]
    places: list[tuple[list[str], str]]
    echoed: list[float]
    back: list[float]
    native: list[bool]


def _often(rate: float | None) -> str:
    return "?" if rate is None else "never" if rate < 0.1 else "seldom" if rate < 0.4 else "often"


def _step(x: float) -> str:
    return str(min(4, int(x * 5)))


def describe(prompt: str | None, response: str | None, finished: float | None) -> Pair:
    """The clauses of a response and their features."""
    text = response or ""
    asked = plain(prompt)
    known = trigrams(asked)
    clauses = CLAUSE.findall(text)
    native = native_clauses(text)
    masked = _BRACKETED.sub(lambda m: "\3" * len(m[0]), text)
    last = text.rstrip()[-1:]
    cut_off = text[-1:].isspace() or text.count("「") > text.count("」") or text.count("（") > text.count("）") or text.count("『") > text.count("』")
    places, echoed, back = [], [], []
    at = 0
    for i, clause in enumerate(clauses):
        letters = plain(clause)
        for word in DRESS if asked else ():
            letters = letters.replace(word, "")
        kana, han, latin, hangul = (len(p.findall(clause)) for p in (_KANA, _HAN, _LATIN, _HANGUL))
        if known:
            echo = shared(letters, known) / len(letters) if letters else 0.0
            given = shared(asked, trigrams(letters)) / len(asked)
        else:
            echo = given = float(bool(asked and letters) and letters.replace(asked, "") == "")
        own = [f"script:{max((kana + han if kana else -1, 'jp'), (han if not kana else -1, 'han'), (latin, 'latin'), (hangul, 'hangul'))[1] if letters else 'none'}", f"native:{native[i]}", f"echo:{_step(echo)}", f"echo:{_step(echo)}:{_step(given)}:{native[i]}"]
        if i == len(clauses) - 1:
            marked = last in FINAL
            own += ["last", f"last:{native[i]}:{'marked' if marked else _often(finished)}:{cut_off}", f"last:cut:{cut_off}", f"last:comma:{last in '、，,､'}"]
        else:
            own.append("inner")
        begin, at = at, at + len(clause)
        places.append((own, re.sub("\3+", "\3", unicodedata.normalize("NFKC", masked[begin:at]).lower())))
        echoed.append(echo)
        back.append(given)
    return Pair(clauses, places, echoed, back, native)


def _breaks_off(text: str, finished: float | None) -> bool:
    if text.count("（") > text.count("）") or text.count("「") > text.count("」"):
        return True
    return text.rstrip()[-1:] not in FINAL and (finished or 0.0) < 0.25


def evident(pair: Pair, text: str, finished: float | None) -> list[str]:
    """The tags of the clauses of a response that doesn't speak of its own translation."""
    tags = ["echo" if e >= (COPIED_NATIVE if n else COPIED[0]) and (b >= COPIED[1] or not n) else "answer" if n else "foreign" for e, b, n in zip(pair.echoed, pair.back, pair.native)]
    if tags and tags[-1] == "answer" and _breaks_off(text, finished):
        tags[-1] = "unfinished"
    return tags


class TrainingSet:
    """Places and tags of responses."""

    def __init__(self):
        self.places: list[list[tuple[list[str], str]]] = []
        self.tags: list[list[str]] = []

    def add(self, pair: Pair, tags: list[str]) -> None:
        if pair.clauses and len(tags) == len(pair.clauses):
            self.places.append(pair.places)
            self.tags.append(tags)

    def put(self, prompt: str | None, parts: list[tuple[str, str]], finished: float | None) -> None:
        """A response of tagged parts."""
        tags = [tag for text, tag in parts for _ in CLAUSE.findall(text)]
        self.add(describe(prompt, "".join(text for text, _ in parts), finished), tags)


def made_pairs(rows: list[tuple[str | None, str | None, float | None]], rate_of, rng: random.Random) -> TrainingSet:
    """Responses made from parts and from the sample's whole answers. rate_of: how often an ending is final, or None."""
    out = TrainingSet()
    whole = []
    for prompt, response, finished in rows:
        text = (response or "").rstrip()
        if text[-1:] == "。" and len(text.rstrip("。")) > 7 and not TALK.search(text) and set(evident(describe(prompt, text, finished), text, finished)) == {"answer"}:
            whole.append((prompt, text))
    prompts = [p for p, *_ in rows if p and len(plain(p)) > 3] or [None]
    answer = lambda: rng.choice(whole)[1] if whole else made.narrative(rng)
    for prompt, text in rng.choices(whole, k=SENTENCES // 3) if whole else []:
        bare, rate = text.rstrip("。"), rate_of(ending(text))
        if rng.random() < 0.2 and (rate or 0.0) >= 0.4:  # whole, though without its mark
            out.put(prompt, [(bare, "answer")], rate)
            continue
        short = bare[: rng.randrange(3, len(bare) - 1)]
        rate = rate_of(ending(short))
        if _KANA.search(_QUOTED.sub("", short)) and rate in (None, 0.0):
            clauses = CLAUSE.findall(short)
            out.add(describe(prompt, short + rng.choice(["", "", "…", "、", "　"]), rate), ["answer"] * (len(clauses) - 1) + ["unfinished"])
    for prompt in rng.choices(prompts, k=SENTENCES // 4) if prompts != [None] else []:
        dress = rng.choice(["{}", "「{}」", "訳：{}", "{}（未訳）", "{} / {}", "{}。", "日本語訳 → {}", "原文「{}」", "{}です。", "{}のままです。"]).replace("{}", rng.choice([prompt, prompt.upper(), prompt.replace(" ", ", "), prompt.replace(" ", "、")]))
        out.put(prompt, [(dress, "echo")], rate_of(ending(dress)))
    for _ in range(SENTENCES):
        prompt = rng.choice(prompts)
        quote = rng.choice((plain(prompt)[:6], "その文")) if prompt else "その文"
        shape = rng.random()
        some = answer()
        at = rng.randrange(len(some))
        words = re.sub(r"\W", "", some[at : at + rng.randrange(2, 10)])
        no = made.refusal(rng, words).replace("「Q」", f"「{quote}」")
        if shape < 0.33:
            parts = [(no, "refusal")]
        elif shape < 0.38:
            parts = [(f"「{quote}」について", "refusal"), (rng.choice(("：", "は、", "ですが、")) + no, "refusal")]
        elif shape < 0.58:
            own = [(rng.choice((answer(), made.narrative(rng))), "answer") for _ in range(rng.randrange(1, 4))]
            parts = [*own, (no, "refusal")] if rng.random() < 0.6 else [(no.rstrip("\n！。") + "。", "refusal"), *own]
        elif shape < 0.68:
            parts = [(made.report(rng), "answer"), (rng.choice((answer(), made.narrative(rng, words))), "answer")]
        elif shape < 0.72 and prompt:
            parts = [(f"「{max(prompt.split(), key=len)}」{rng.choice(made.QUOTING)}", "answer"), (answer(), "answer")]
        elif shape < 0.84:
            parts = [(made.narrative(rng, words), "answer")] + ([(answer(), "answer")] if rng.random() < 0.3 else [])
        else:
            parts = [(made.foreign(rng), "foreign")]
        text = "".join(t for t, _ in parts)
        out.put(prompt, parts, 1.0 if text.rstrip()[-1:] in FINAL else rate_of(ending(text)))
    return out


def fitted(rows: list[tuple[str | None, str | None, float | None]], rate_of, seed: int = 7) -> Crf:
    """The field for a sample of (prompt, response, how often its ending is final)."""
    rng = random.Random(seed)
    own = made_pairs(rows, rate_of, rng)
    doubtful: list[tuple[Pair, str, float | None]] = []
    for prompt, response, finished in rows:
        if not is_empty(response):
            pair = describe(prompt, response, finished)
            if TALK.search(response):
                doubtful.append((pair, response, finished))
            else:
                own.add(pair, evident(pair, response, finished))
    first = Crf(TAGS, TIED).fit(encode(own.places), own.tags)
    if not doubtful:
        return first
    for (pair, response, finished), tags in zip(doubtful, first.tag(encode([p.places for p, *_ in doubtful]))):
        plainly = evident(pair, response, finished)
        refused = [t == "refusal" and e != "echo" for t, e in zip(tags, plainly)]
        share = sum(len(c) for c, no in zip(pair.clauses, refused) if no) / len(response)
        if share >= 0.5 or not any(refused):  # what the first round takes for less of a refusal may be half understood
            own.add(pair, ["refusal"] * len(tags) if any(refused) else plainly)
    return Crf(TAGS, TIED).fit(encode(own.places), own.tags)


def verdict(pair: Pair, tags: list[str], response: str | None) -> str | None:
    """The first defect that fits, from the characters that each tag covers."""
    if is_empty(response):
        return "empty"
    covered = dict.fromkeys(TAGS, 0)
    for clause, tag, native in zip(pair.clauses, tags, pair.native):  # letters tell for certain that a clause isn't Japanese
        covered["foreign" if not native and tag in ("answer", "unfinished") else tag] += len(_WORD.findall(clause))
    total = sum(covered.values()) or 1
    if covered["refusal"] * 2 >= total:
        return "refusal"
    if covered["echo"] * 2 >= total and sum(b for b, tag in zip(pair.back, tags) if tag == "echo") >= COPIED[1]:
        return "copy"
    if (covered["foreign"] + sum(len(_WORD.findall(c)) for c, n, tag in zip(pair.clauses, pair.native, tags) if tag == "echo" and not n)) * 2 >= total:
        return "other_language"
    if tags and tags[-1] == "unfinished":
        return "truncated"
    return None


def pair_defects(pairs: DataFrame, key: str, prompt: str, response: str, fit_rows: int = FIT_ROWS) -> DataFrame:
    """({key}, defect, answer_share): every pair with its defect, null where there is none, and the share of its response's letters
    in answer clauses."""
    spark = pairs.sparkSession
    key_type = pairs.schema[key].dataType.simpleString()
    found = pairs.select(F.col(key).alias("k"), F.col(prompt).alias("p"), F.col(response).alias("r"))

    ends = F.right(F.regexp_replace("r", "(?U)" + TRAILING.pattern.removesuffix("$") + "\\z", ""), F.lit(2))
    given = found.withColumn("e", ends)
    trimmed = F.regexp_replace("r", r"(?U)\s+$", "")
    counted = given.where("r is not null").groupBy("e").agg(F.count("*").alias("n"), F.count_if(trimmed.rlike(f"[{FINAL}]$")).alias("marked"))
    rates = written(counted.select("e", (F.col("marked") / F.col("n")).alias("rate")), "endings")
    rated = given.join(F.broadcast(rates) if fits(rates, "length(e) * 4 + 8") else rates, "e", "left").select("k", "p", "r", "rate")
    short = F.coalesce(F.length("r"), F.lit(0)) + F.coalesce(F.length("p"), F.lit(0)) <= FIT_CHARS
    sample = rated.where(short).orderBy(F.xxhash64("k"), "k").limit(fit_rows).collect()
    seen = {r["e"]: r["rate"] for r in rates.join(spark.createDataFrame([(e,) for e in _cut_endings(sample)], "e string"), "e").collect()}
    model = fitted([(x["p"], x["r"], x["rate"]) for x in sample], seen.get)
    sent = spark.sparkContext.broadcast(model)

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        crf, names = sent.value, {}
        for batch in batches:
            prompts, responses, rate = (c.to_pylist() for c in batch.columns[1:])
            described = [describe(p, r, e) for p, r, e in zip(prompts, responses, rate)]
            tagged = crf.tag(encode([d.places for d in described], names))
            defects = [verdict(d, t, r) for d, t, r in zip(described, tagged, responses)]
            shares = []
            for d, t in zip(described, tagged):
                each = [len(_WORD.findall(c)) for c in d.clauses]
                shares.append(round(sum(n for n, x in zip(each, t) if x == "answer") / (sum(each) or 1), 4))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(defects, pa.string()), pa.array(shares, pa.float64())], [key, "defect", "answer_share"])

    return rated.mapInArrow(judged, f"{key} {key_type}, defect string, answer_share double")


def _cut_endings(sample: list) -> list[str]:
    """Endings that the sample's answers can have when they are cut anywhere: at most its number of characters."""
    out = set()
    for x in sample:
        text, end = x["r"] or "", 0
        for i, c in enumerate(text[:-1], 1):
            end = end if _TRAILING.match(c) else i  # of the part before i, without trailing marks
            if i >= 3:
                out.add(text[max(0, end - 2) : end])
    return sorted(out)
