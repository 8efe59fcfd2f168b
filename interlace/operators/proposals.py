"""Proposals held against the evidence: what they cite, what they combine, what is new."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from interlace.functions import annotation as A
from interlace.functions.text import blank, strip
from interlace.operators.evidence import top_k


def grounded(references: DataFrame, available: DataFrame, reference: str, key: str) -> DataFrame:
    """The references whose cited row exists."""
    return references.join(available.select(F.col(key).alias(reference)).where(F.col(reference).isNotNull()).distinct(), reference, "left_semi")


def missing(references: DataFrame, available: DataFrame, reference: str, key: str) -> DataFrame:
    """The references whose cited row doesn't exist; those that cite nothing aren't among them."""
    return references.where(F.col(reference).isNotNull()).join(available.select(F.col(key).alias(reference)).distinct(), reference, "left_anti")


def hosts(lexicon: DataFrame, pos: Sequence[str] | None = None) -> DataFrame:
    """Lexemes of the given parts of speech, or of all, each once."""
    return (lexicon if pos is None else lexicon.where(strip("pos").isin(*pos))).dropDuplicates(["lexeme_id"])


def probes(lexemes: DataFrame, forms: DataFrame, position: str = "after") -> DataFrame:
    """(lexeme_id, form_row_id, dialect_id, form_source, text, segmented, annotation): forms of a label after, or before, the lexemes of
    their dialect. Hosts with a blank part or a blank in one are left out, as are forms that aren't one segment."""
    return _combined(_usable(lexemes), _ends(forms), position).drop("label")


def cited_hosts(claims: DataFrame, lexicon: DataFrame, pos: str) -> DataFrame:
    """The claims (lexeme_id and a declared part of speech `pos`) whose lexeme exists and is of that part of speech, each once."""
    known = lexicon.select("lexeme_id", strip("pos").alias("__pos")).distinct()
    return claims.join(known, "lexeme_id").where(F.col("__pos") == strip(pos)).drop("__pos").distinct()


def grounded_phrases(claims: DataFrame, evidence: DataFrame) -> DataFrame:
    """The claims (with id and phrase) whose exact phrase is attested for the ID."""
    return claims.join(evidence.select("id", "phrase").distinct(), ["id", "phrase"], "left_semi")


def probe_outcomes(expected: DataFrame, licensed: DataFrame, key: str) -> DataFrame:
    """(key, failure_type, n_licensed): how an analyser did on an expected analysis. `expected` has text, segmented, annotation,
    dialect_id, region and the analyser's model_segmented and model_annotation; `licensed` has lexeme_id, region and two form columns,
    either of which may be the text.

    In this order: missing_probe_scope, validation_rejected (the expected analysis isn't sound), model_error (no answer), model_exact,
    model_failed_already_licensed, model_failed_candidate.
    """
    forms = licensed.select("lexeme_id", "region", F.explode(F.array_distinct(F.array(strip("form2"), F.replace(strip("form2_seg"), F.lit("-"), F.lit(""))))).alias("text")).where("text <> '' and region is not null")
    matches = forms.groupBy("region", "text").agg(F.count_distinct("lexeme_id").alias("n_licensed"))
    rows = expected.join(matches, ["region", "text"], "left").na.fill(0, ["n_licensed"])
    failure = (
        F.when(F.col("dialect_id").isNull() | blank("region"), "missing_probe_scope").when(~A.sound_analysis(F.col("text"), F.coalesce("segmented", F.lit("")), F.coalesce("annotation", F.lit(""))), "validation_rejected")
        .when(blank("model_segmented") & blank("model_annotation"), "model_error").when((F.col("model_segmented") == F.col("segmented")) & (F.col("model_annotation") == F.col("annotation")), "model_exact")
        .when(F.col("n_licensed") > 0, "model_failed_already_licensed").otherwise("model_failed_candidate")
    )
    return rows.select(key, failure.alias("failure_type"), "n_licensed")


def _usable(lexemes: DataFrame) -> DataFrame:
    part = {c: strip(c) for c in ("form2", "form2_seg", "annotation")}
    usable = lexemes.select("lexeme_id", "dialect_id", *[v.alias(c) for c, v in part.items()])
    for c in part:
        usable = usable.where(~F.col(c).rlike(r"(?U)\s") & (F.col(c) != ""))
    return usable


def _ends(forms: DataFrame) -> DataFrame:
    return forms.select("form_row_id", "dialect_id", "form_source", "label", strip("surface").alias("surface")).where("surface <> ''").where(~F.col("surface").rlike(r"(?U)[\s\-]"))


def _combined(usable: DataFrame, ends: DataFrame, position: str = "after") -> DataFrame:
    order = {"after": lambda host, end: (host, end), "before": lambda host, end: (end, host)}[position]
    return usable.join(ends, "dialect_id").select(
        "lexeme_id", "form_row_id", "dialect_id", "form_source", F.concat(*order("form2", "surface")).alias("text"), F.concat_ws("-", *order("form2_seg", "surface")).alias("segmented"), F.concat_ws("-", *order("annotation", "label")).alias("annotation"), "label"
    )


def target_probes(lexemes: DataFrame, forms: DataFrame, limit: int = 24, position: str = "after") -> DataFrame:
    """`probes` within the budget of each target, a label in a dialect, with `label` and `attested`.

    Of the pairs in the order of lexeme and form, the first `limit` have only the first `limit` hosts of a dialect and the first `limit`
    forms of a target; so these are taken before they meet, and no full product of a dialect is made.
    """
    attested = F.coalesce(F.col("form_source") == "corpus", F.lit(False))
    ends = _ends(forms).where("label is not null").withColumn("attested", attested)
    few = top_k(ends, ["label", "dialect_id", "attested"], [F.col("form_row_id")], limit).drop("attested")
    rows = _combined(top_k(_usable(lexemes), ["dialect_id"], [F.col("lexeme_id")], limit), few, position).withColumn("attested", attested)
    target = F.struct("label", "dialect_id")
    return within_budget(rows.withColumn("target", target), "target", "attested", ["lexeme_id", "form_row_id"], limit).drop("target")


def within_budget(rows: DataFrame, by: str, attested: str, order: Sequence[str], limit: int) -> DataFrame:
    """The first rows of each group up to `limit`: attested ones first, up to a third of it (8 at most, 1 at least) where there are
    others too, the rest from the others."""
    reserve = min(8, max(1, limit // 3))
    counts = rows.groupBy(by).agg(F.count_if(attested).alias("__a"), F.count_if(~F.col(attested)).alias("__b"))
    quota = counts.select(by, F.least(F.col("__a"), F.when(F.col("__b") > 0, reserve).otherwise(limit)).alias("__q"))
    first = top_k(rows, [by, attested], [F.col(c) for c in order], limit)
    numbered = first.withColumn("__n", F.row_number().over(Window.partitionBy(by, attested).orderBy(*order))).join(quota, by)
    return numbered.where(F.col("__n") <= F.when(F.col(attested), F.col("__q")).otherwise(F.lit(limit) - F.col("__q"))).drop("__n", "__q")


def first_seen(rows: DataFrame, key: Sequence[str], order: str) -> DataFrame:
    """The first row of each key; nulls are a key of their own."""
    rest = [c for c in rows.columns if c not in key and c != order]
    best = rows.groupBy(*key).agg(F.min_by(F.struct(order, *rest), order).alias("__r"))
    return best.select(*key, *[F.col(f"__r.{c}").alias(c) for c in (order, *rest)])


def united(first: DataFrame, second: DataFrame, key: Sequence[str], order: str) -> DataFrame:
    """All rows of `first`, then those of `second` with a key that `first` lacks; each key once."""
    both = first.withColumn("__o", F.lit(0)).unionByName(second.withColumn("__o", F.lit(1)))
    return first_seen(both.withColumn("__k", F.struct("__o", order)), key, "__k").drop("__k").drop("__o")


def audits(results: DataFrame, given: str, needed: str, key: str) -> DataFrame:
    """(key, complete, n_missing, n_extra): whether the distinct IDs of one annotation are those of the other."""
    g, n = F.array_distinct(A.annotation_ids(given)), F.array_distinct(A.annotation_ids(needed))
    rows = results.where(F.col(needed).isNotNull()).select(key, F.size(F.array_except(n, g)).alias("n_missing"), F.size(F.array_except(g, n)).alias("n_extra"))
    return rows.withColumn("complete", (F.col("n_missing") == 0) & (F.col("n_extra") == 0))
