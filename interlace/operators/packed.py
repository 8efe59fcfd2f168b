"""Several values packed in one field: one row per value, with its position.

Method: runs of ordinary characters are masked, each to one x, and every other character stays, which leaves a field's delimiter
skeleton; a splitting rule (the spans of the skeleton that hold a value, and whether quotation marks enclose them) is resolved once
per distinct skeleton; the rules are broadcast and joined back to all rows, and the values are cut out by position with built-in
array functions: a character of the skeleton is a part of the field.

Defined cases: null and empty fields give no rows; empty quoted values are left out; a quotation mark without its partner
separates; repeated rows give repeated values; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from interlace.plans.storage import fits, written

#: The characters of an unquoted value.
ORDINARY = r"\p{L}\p{M}\p{Nd}:>._?"
#: A field's parts: runs of ordinary characters, and single characters of any other kind.
PART = f"[{ORDINARY}]+|[^{ORDINARY}]"
#: Quotation marks with the marks that may close them.
PAIRS = {
    '"': '"', "'": "'", "＂": "＂", "＇": "＇", "“": "”", "‘": "’", "”": "”", "’": "’", "„": "“”", "‚": "‘’", "‟": "”", "‛": "’",
    "«": "»", "»": "«»", "‹": "›", "›": "‹›", "「": "」", "『": "』", "｢": "｣", "〝": "〞〟", "﹁": "﹂", "﹃": "﹄", "❝": "❞", "❛": "❜", "⹂": "”",
}
#: A span of a rule is one number: its first part, its last, and its kind in the lowest two bits.
RULE = "array<bigint>"
BARE, QUOTED, DOUBLED = range(3)


def skeleton(col: Column | str) -> Column:
    """The field with each run of ordinary characters folded to x; null for a null or empty field."""
    return F.nullif(F.regexp_replace(col, f"[{ORDINARY}]+", "x"), F.lit(""))


def resolve(skel: str) -> list[tuple[int, int, int]]:
    """Spans (from 0, both ends included, and their kind) of a skeleton that hold values, from left to right."""
    spans: list[tuple[int, int, int]] = []
    unclosed: set[str] = set()
    at = 0
    while at < len(skel):
        mark = skel[at]
        end = -1
        if mark in PAIRS and mark not in unclosed:
            end = _closing(skel, at)
            if end < 0:
                unclosed.add(mark)
        if end > 0:
            if end > at + 1:
                spans.append((at + 1, end - 1, DOUBLED if mark == '"' else QUOTED))
            at = end + 1
            continue
        if mark == "x":
            spans.append((at, at, BARE))
        at += 1
    return spans


def _closing(skel: str, at: int) -> int:
    """Where the quotation opened at `at` closes, or -1. Two straight double marks in a row stand for one inside."""
    if skel[at] != '"':
        return min((p for c in PAIRS[skel[at]] if (p := skel.find(c, at + 1)) > 0), default=-1)
    p = skel.find('"', at + 1)
    while p >= 0 and skel[p : p + 2] == '""':
        p = skel.find('"', p + 2)
    return p


def _rules(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        yield pd.DataFrame({"skel": pdf["skel"], "rule": [[first << 33 | last << 2 | kind for first, last, kind in resolve(s)] for s in pdf["skel"]]})


def rules_of(df: DataFrame, fields: Sequence[str]) -> DataFrame:
    """(skel, rule): one row per distinct skeleton in any of `fields`."""
    each = df.select(F.explode(F.array(*[skeleton(f) for f in fields])).alias("skel")).where("skel is not null").distinct()
    return written(each.mapInPandas(_rules, f"skel string, rule {RULE}"), "packed-rules")


def values_by_rule(rule: Column, parts: Column) -> Column:
    """The values that a rule cuts out of the parts of a field."""

    def cut(span: Column) -> Column:
        kind = span.bitwiseAND(F.lit(3))
        first, last = F.shiftright(span, 33).cast("int"), F.shiftright(span, 2).bitwiseAND(F.lit((1 << 31) - 1)).cast("int")
        whole = F.array_join(F.slice(parts, first + 1, last - first + 1), "")
        return F.when(kind == BARE, F.element_at(parts, first + 1)).when(kind == DOUBLED, F.replace(whole, F.lit('""'), F.lit('"'))).otherwise(whole)

    return F.transform(rule, cut)


def with_values(df: DataFrame, fields: dict[str, str], rules: DataFrame | None = None) -> DataFrame:
    """`df` with an array column of values for each packed field (`fields`: field -> name of the array column). `rules`, where they
    have been resolved already, must cover all skeletons of `df`.

    The table of rules is broadcast only if its measured size allows; beyond, the rows are joined by shuffling, null fields beside
    the join; adaptive execution splits a skeleton that many rows share. Names in `df` may clash with nothing but the new columns.
    """
    rules = rules_of(df, list(fields)) if rules is None else rules
    small = fits(rules, "length(skel) * 4 + size(rule) * 8")
    out = df
    for field, name in fields.items():
        mine = rules.select(F.col("skel").alias("__skel"), F.col("rule").alias("__rule"))
        keyed = out.withColumn("__key", skeleton(field))
        if small:
            joined = keyed.join(F.broadcast(mine), F.col("__key") == F.col("__skel"), "left")
        else:
            joined = keyed.where("__key is not null").join(mine, F.col("__key") == F.col("__skel"))
            joined = joined.unionByName(keyed.where("__key is null").withColumns({"__skel": F.lit(None).cast("string"), "__rule": F.lit(None).cast(RULE)}))
        values = values_by_rule(F.col("__rule"), F.col("__parts"))
        cut = joined.withColumn("__parts", F.regexp_extract_all(F.col(field), F.lit(PART), F.lit(0))).withColumn(name, F.coalesce(values, F.array().cast("array<string>")))
        out = cut.drop("__key", "__skel", "__rule", "__parts")
    return out


def split_packed(df: DataFrame, keys: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """(*keys, field_name, pos, item_value): one row per value of each field; `pos` counts a field's values from 0."""
    names = {f: f"__values_{i}" for i, f in enumerate(fields)}
    wide = with_values(df.select(*dict.fromkeys([*keys, *fields])), names)
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(v).alias("values")) for f, v in names.items()]))
    return wide.select(*keys, each.alias("__f")).select(*keys, F.col("__f.field_name").alias("field_name"), F.posexplode("__f.values").alias("pos", "item_value"))
