"""Visually identical text with different characters: one consistent form, made by DuckDB expressions inside Arrow partitions.

In the consistent form, invisible characters are gone, characters are composed (NFC), full-width and half-width forms, compatibility
forms, blanks and look-alike letters are mapped to one character each, and forms of several letters to those letters. Case,
punctuation, length marks, accents, voicing marks and the presence of a blank stay as they are.

Texts are compared by 128-bit hashes of their form, so that no text is shuffled or written.

Defined cases: null stays null; empty and very long texts are treated whole; repeated rows are treated alike.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator, Sequence
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StringType, StructField, StructType

from interlace.plans.storage import fits, written

#: Pairs of a letter and the Latin letter that looks the same.
LATIN = (
    "аa еe оo рp сc хx уy іi јj ѕs һh ԁd ԛq ԝw ӏl кk ѵv ӓä ёë їï ӧö "
    "АA ВB ЕE КK МM НH ОO РP СC ТT ХX УY ІI ЈJ ЅS ԚQ ԜW ЇÏ ЁË ӒÄ ӦÖ "
    "οo νv ρp αa ιi κk υu ϲc ϳj γy ϊï όó άá ΑA ΒB ΕE ΖZ ΗH ΙI ΚK ΜM ΝN ΟO ΡP ΤT ΥY ΧX ΪÏ "
    "օo ոn սu հh զq ցg ɡg ɑa ıi ηn ՏS ՍU ՕO "
    "ᎪA ᏴB ᏟC ᎠD ᎬE ᏀG ᎻH ᎫJ ᏦK ᏞL ᎷM ᏢP ᏒR ᏚS ᎢT ᏙV ᎳW ᏃZ "
    "ꓮA ꓐB ꓚC ꓓD ꓰE ꓝF ꓖG ꓧH ꓲI ꓙJ ꓗK ꓡL ꓟM ꓠN ꓳO ꓑP ꓣR ꓢS ꓔT ꓴU ꓦV ꓪW ꓫX ꓬY ꓜZ"
)
#: Pairs of a kanji or hiragana and the katakana that looks the same.
KANA = "力カ 口ロ 工エ 卜ト 八ハ 夕タ 二ニ 一ー 才オ 千チ 丿ノ りリ へヘ べベ ぺペ"
#: Characters that do not show.
INVISIBLE = r"[\p{Cf}\x{00}-\x{08}\x{0E}-\x{1F}\x{7F}-\x{84}\x{86}-\x{9F}\x{034F}\x{115F}\x{1160}\x{17B4}\x{17B5}\x{180B}-\x{180F}\x{3164}\x{FFA0}\x{FE00}-\x{FE0F}\x{E0100}-\x{E01EF}]+"


@lru_cache(maxsize=1)
def mappings() -> list[tuple[str, str, str]]:
    """(class, characters, what each becomes), by the character database and the fixed pairs: first what occurs in most texts, with
    an empty class; then what few texts hold, each with a character class that tells which. Translating by a long list is slow."""
    pairs = {pair[0]: pair[1] for pair in (LATIN + " " + KANA).split()}
    kana = {pair[0]: pair[1] for pair in KANA.split()}
    width, rest = {"ﾞ": "゙", "ﾟ": "゚"}, {}
    letters = {c: x for c, x in pairs.items() if c not in kana} | {"\t": " "}
    for c, kind in _compatible():
        if unicodedata.category(c) == "Zs":
            letters[c] = " "
        elif c not in pairs and kind and len(one := unicodedata.normalize("NFKC", c)) == 1:
            (width if 0xFF00 <= ord(c) <= 0xFFEF else rest).setdefault(c, pairs.get(one, one))
    return [("", "".join(kana), "".join(kana.values()))] + [(_class(m), "".join(m), "".join(m.values())) for m in (letters, width, rest)]


@lru_cache(maxsize=1)
def ligatures() -> dict[str, str]:
    """Characters that look like several letters or digits: ligatures, digraphs, roman numerals, units."""
    found = {c: unicodedata.normalize("NFKC", c) for c, kind in _compatible() if kind}
    return {c: x for c, x in found.items() if len(x) > 1 and all(unicodedata.category(y)[0] in "LN" or y == "°" for y in x)}


def _compatible() -> Iterator[tuple[str, bool]]:
    """All characters beyond ASCII, and whether each stands for a form of others that looks the same."""
    for code in range(0x80, sys.maxunicode + 1):
        kind, _, to = unicodedata.decomposition(chr(code)).partition("> ")
        yield chr(code), bool(to) and kind in ("<wide", "<narrow", "<font", "<compat", "<square")


def _class(chars) -> str:
    """A regular expression for any of the characters, by ranges."""
    codes = sorted(map(ord, chars))
    starts = [c for k, c in enumerate(codes) if not k or codes[k - 1] != c - 1]
    ends = [c for k, c in enumerate(codes) if k == len(codes) - 1 or codes[k + 1] != c + 1]
    return "[" + "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in zip(starts, ends)) + "]"


def _literal(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def consistent_sql(column: str) -> str:
    """The DuckDB expression for the consistent form."""
    seen = f"nfc_normalize(regexp_replace({column}, '{INVISIBLE}', '', 'g'))"
    several = ligatures()
    table = "map([" + ", ".join(map(_literal, several)) + "], [" + ", ".join(map(_literal, several.values())) + "])"
    spelled = f"array_to_string(list_transform(regexp_extract_all(v, '(?s).'), lambda c: coalesce(element_at({table}, c)[1], c)), '')"
    seen = f"list_transform([{seen}], lambda v: CASE WHEN regexp_matches(v, '{_class(several)}') THEN {spelled} ELSE v END)[1]"
    for k, (which, source, target) in enumerate(mappings()):
        mapped = f"translate(v{k}, {_literal(source)}, {_literal(target)})"
        seen = f"list_transform([{seen}], lambda v{k}: {f"CASE WHEN regexp_matches(v{k}, '{which}') THEN {mapped} ELSE v{k} END" if which else mapped})[1]"
    return f"nfc_normalize({seen})"


def with_consistent(df: DataFrame, keys: Sequence[str], fields: Sequence[str], changed_only: bool = False) -> DataFrame:
    """(*keys, field_name, value, canon): the consistent form of every non-null text in `fields`; with `changed_only` null where the text is
    in that form already, so that few texts come back from the partitions' DuckDB."""
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f).alias("value")) for f in fields])).alias("__f")
    texts = df.select(*keys, each).select(*keys, "__f.field_name", "__f.value").where("value is not null")
    if changed_only:
        texts = texts.withColumns({"v1": F.xxhash64("value"), "v2": F.xxhash64(F.lit(1), "value")})
    found = consistent_sql("value")  # made once, and sent to the tasks
    query = f"SELECT * EXCLUDE (value), nullif({found}, value) AS canon FROM batch" if changed_only else f"SELECT *, {found} AS canon FROM batch"
    out = StructType([*[f for f in texts.schema.fields if not (changed_only and f.name == "value")], StructField("canon", StringType())])
    schema = to_arrow_schema(out)

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb

        con = duckdb.connect(config={"threads": 1, "memory_limit": "256MB"})
        for batch in batches:
            con.register("batch", pa.Table.from_batches([batch]))
            found = con.sql(query).to_arrow_table()
            con.unregister("batch")
            yield from found.cast(schema).to_batches()
        con.close()

    return texts.mapInArrow(mapped, out)


def _forms(df: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """(key, field_name, c1, c2, odd, v): hashes of each text's form, whether it is in another form, and a hash of itself."""
    found = with_consistent(df, [key], fields, changed_only=True)
    hashes = [F.coalesce(F.when(F.col("canon").isNotNull(), h), v).alias(c) for c, h, v in (("c1", F.xxhash64("canon"), F.col("v1")), ("c2", F.xxhash64(F.lit(1), "canon"), F.col("v2")))]
    return written(found.select(F.col(key).alias("key"), "field_name", *hashes, F.col("canon").isNotNull().alias("odd"), F.when(F.col("canon").isNotNull(), F.col("v1")).alias("v")), "forms")


def lookalike_pairs(df: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """(field_name, {key}_a, {key}_b), a < b: rows whose texts differ but have the same consistent form.

    Of two different texts with the same form, at least one isn't in that form. So such rows, a small part, are joined to all
    rows of the same field and form, by hashes; they are broadcast only if their measured size allows, and adaptive execution splits
    a form that many rows share. Rows without a key are left out.
    """
    forms = _forms(df.where(F.col(key).isNotNull()), key, fields)
    odd = forms.where("odd").select("field_name", "c1", "c2", F.col("key").alias("key_odd"), F.col("v").alias("v_odd"))
    same = forms.join(F.broadcast(odd) if fits(odd, "160") else odd, ["field_name", "c1", "c2"]).where("not odd or (v <> v_odd and key_odd < key)")
    return same.select("field_name", F.least("key_odd", "key").alias(f"{key}_a"), F.greatest("key_odd", "key").alias(f"{key}_b"))


def lookalike_classes(df: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """(field_name, {key}, canon, n_rows, n_values): each row of a class of texts that look the same but aren't, with their form, the
    number of the class's rows and of its different texts."""
    forms = _forms(df, key, fields)
    counted = forms.groupBy("field_name", "c1", "c2", "v", "odd").agg(F.count("*").alias("n"))
    classes = written(counted.groupBy("field_name", "c1", "c2").agg(F.sum("n").alias("n_rows"), F.count("*").alias("n_values")).where("n_values > 1"), "classes")
    texts = with_consistent(df, [key], fields).select(key, "field_name", "canon", F.xxhash64("canon").alias("c1"), F.xxhash64(F.lit(1), "canon").alias("c2"))
    return texts.join(F.broadcast(classes) if fits(classes, "160") else classes, ["field_name", "c1", "c2"]).select("field_name", key, "canon", "n_rows", "n_values")
