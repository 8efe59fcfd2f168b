"""Predictions against gold: alignment, confusions, boundaries; by row, by job, and of n-best lists."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from interlace.functions import annotation as A
from interlace.functions.alignment import align, boundary_scores, edit_distance, error_rate, match_rate, trailing_matches
from interlace.functions.text import blank


def aligned(results: DataFrame, keys: Sequence[str], predicted: str = "ai_annotation", gold: str = "gold_annotation") -> DataFrame:
    """(*keys, a): the alignment of the IDs, of rows that have gold."""
    rows = results.where(~F.coalesce(F.col(gold) == "", F.lit(True))).select(*keys, A.annotation_ids(predicted).alias("p"), A.annotation_ids(gold).alias("g"))
    cut = rows.withColumn("m", trailing_matches(F.col("p"), F.col("g")))
    short = cut.select(*keys, "m", *[F.slice(c, F.lit(1), F.size(c) - F.col("m")).alias(c) for c in "pg"])
    return short.select(*keys, align(F.col("p"), F.col("g"), F.col("m")).alias("a"))


def alignment_rows(results: DataFrame, key: str) -> DataFrame:
    """One row per scored result: operation counts, rates, and the errors as one text."""
    a = aligned(results, [key]).select(key, "a.*")
    return a.select(
        key, "matches", "substitutions", "insertions", "deletions", "edits", "gold_ids", "predicted_ids", (F.col("edits") == 0).alias("exact"),
        F.round(match_rate(F.col("matches"), F.col("gold_ids"), F.col("predicted_ids")), 6).alias("id_match_rate"), F.round(error_rate(F.col("edits"), F.col("gold_ids"), F.col("predicted_ids")), 6).alias("id_error_rate"),
        F.array_join(F.transform("confusions", lambda e: F.concat_ws("→", e["gold"], e["predicted"])), " ").alias("errors"),
    )


def confusion_matrix(results: DataFrame) -> DataFrame:
    """(gold, predicted, n): how often an ID was mistaken for another, left out or put in."""
    return aligned(results, []).select(F.explode("a.confusions").alias("e")).groupBy("e.gold", "e.predicted").agg(F.count("*").alias("n"))


def annotation_metrics(results: DataFrame, by: Sequence[str]) -> DataFrame:
    """Sums and rates by group; rates are of the sums."""
    names = ["gold_ids", "predicted_ids", "matches", "substitutions", "insertions", "deletions", "edits"]
    a = aligned(results, by).select(*by, "a.*").groupBy(*by).agg(F.count("*").alias("scored"), F.count_if(F.col("edits") == 0).alias("exact_matches"), *[F.sum(n).alias(n) for n in names])
    return a.withColumns({
        "exact_accuracy": F.round(F.try_divide("exact_matches", "scored"), 6), "id_match_rate": F.round(F.try_divide("matches", F.greatest("gold_ids", "predicted_ids")), 6), "id_error_rate": F.round(F.try_divide("edits", "gold_ids"), 6),
    })


def segmentation_rows(results: DataFrame, keys: Sequence[str], predicted: str = "ai_segmented", gold: str = "gold_segmented") -> DataFrame:
    """(*keys, boundary counts and rates) of rows that have gold."""
    rows = results.where(~F.coalesce(F.col(gold) == "", F.lit(True))).select(
        *keys, A.surface(predicted).alias("ps"), A.boundary_offsets(predicted).alias("pb"), A.surface(gold).alias("gs"), A.boundary_offsets(gold).alias("gb")
    )
    scored = rows.select(*keys, boundary_scores(F.col("ps"), F.col("pb"), F.col("gs"), F.col("gb")).alias("b")).select(*keys, "b.*")
    return scored.withColumns({c: F.round(c, 6) for c in ("precision", "recall", "f1")})


def segmentation_metrics(results: DataFrame, by: Sequence[str]) -> DataFrame:
    """Boundary counts and micro-averaged rates by group; null where undefined."""
    s = segmentation_rows(results, by).groupBy(*by).agg(
        F.count("*").alias("scored"), F.count_if("exact").alias("exact_matches"), F.count_if(~F.col("surface_match")).alias("surface_mismatches"),
        *[F.sum(c).alias(c) for c in ("gold_boundaries", "predicted_boundaries", "correct", "false_positive", "false_negative")],
    )
    p, r = F.try_divide(F.col("correct"), F.col("correct") + F.col("false_positive")), F.try_divide(F.col("correct"), F.col("correct") + F.col("false_negative"))
    return s.withColumns({"precision": F.round(p, 6), "recall": F.round(r, 6), "f1": F.round(F.try_divide(2 * p * r, p + r), 6)})


NBEST = "array<struct<rank:int,units:array<string>,unit_text:string,combined_score:double>>"


def explode_nbest(lists: DataFrame, key: str, json: str = "nbest_json", most: int | None = None) -> DataFrame:
    """(key, rank, units, combined_score): hypotheses of JSON lists; malformed JSON fails, an empty list or null gives no rows."""
    parsed = F.from_json(F.coalesce(F.nullif(F.col(json), F.lit("")), F.lit("[]")), NBEST, {"mode": "FAILFAST"})
    kept = parsed if most is None else F.slice(parsed, 1, max(1, most))
    h = lists.select(key, F.explode(kept).alias("h"))
    text = F.filter(F.split(F.coalesce("h.unit_text", F.lit("")), r"(?U)\s+"), lambda u: u != "")
    return h.select(key, F.coalesce("h.rank", F.lit(0)).alias("rank"), F.coalesce("h.units", text).alias("units"), "h.combined_score")


def best_hypothesis(candidates: DataFrame, key: str) -> DataFrame:
    """(key, baseline_rank): the fewest alerts, then the surest analysis, then the best scores, then the first rank. Candidates have
    rank, alerts, confidence, score (a mean log-probability; null and 0 count as -100) and failed; failed ones come last."""
    failed = F.coalesce("failed", F.lit(False))
    order = F.struct(
        failed, F.when(failed, 0).otherwise(F.coalesce("alerts", F.lit(0))), F.when(failed, 0.0).otherwise(-F.coalesce("confidence", F.lit(0.0))),
        F.when(failed, 0.0).otherwise(-F.coalesce(F.nullif(F.col("score"), F.lit(0.0)), F.lit(-100.0))), F.col("rank"),
    )
    return candidates.groupBy(key).agg(F.min_by("rank", order).alias("baseline_rank"))


def scored_lists(hypotheses: DataFrame, references: DataFrame | None, key: str) -> DataFrame:
    """(key, rank, units, edits, ref_units): edits of each hypothesis against its list's reference units, or where there are no
    `references` against those of its own column `ref`."""
    joined = hypotheses if references is None else hypotheses.join(references.select(key, "ref"), key)
    return joined.withColumns({"edits": edit_distance(F.col("ref"), F.col("units")), "ref_units": F.size("ref")}).drop("ref")


def oracle_hypothesis(scored: DataFrame, key: str) -> DataFrame:
    """(key, top1_rank, top1_edits, oracle_rank, oracle_edits, ref_units): the first and the best that the list holds."""
    return scored.groupBy(key).agg(
        F.min("rank").alias("top1_rank"), F.min_by("edits", "rank").alias("top1_edits"), F.min_by("rank", F.struct("edits", "rank")).alias("oracle_rank"), F.min("edits").alias("oracle_edits"), F.max("ref_units").alias("ref_units")
    )


def error_summary(scored: DataFrame, baseline: DataFrame, key: str) -> DataFrame:
    """One row: unit error rates of the first, the selected and the best hypotheses, and how much of the headroom selection gains."""
    chosen = scored.join(baseline, key).groupBy(key).agg(F.max("baseline_rank").alias("baseline_rank"), F.max(F.when(F.col("rank") == F.col("baseline_rank"), F.col("edits"))).alias("baseline_edits"))
    rows = oracle_hypothesis(scored, key).join(chosen, key)
    better = F.col("baseline_edits") - F.col("top1_edits")
    total = rows.agg(
        F.count("*").alias("lists"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("ref_units", "top1_edits", "baseline_edits", "oracle_edits")],
        F.count_if(F.col("baseline_rank") == F.col("top1_rank")).alias("retained"), F.count_if(better < 0).alias("improved"), F.count_if(better > 0).alias("harmed"), F.count_if(F.col("baseline_rank") == F.col("oracle_rank")).alias("oracle_selected"),
    )
    rate = lambda c: F.coalesce(F.try_divide(F.col(c), F.col("ref_units")), F.lit(0.0))
    gain = F.try_divide(F.col("top1_edits") - F.col("baseline_edits"), F.col("top1_edits") - F.col("oracle_edits"))
    return total.withColumns({"top1_uer": F.round(rate("top1_edits"), 6), "baseline_uer": F.round(rate("baseline_edits"), 6), "oracle_uer": F.round(rate("oracle_edits"), 6), "headroom_recovered": F.round(gain, 6)})


def chosen_hypothesis(candidates: DataFrame, key: str) -> DataFrame:
    """(key, agent_rank): the hypothesis of the highest confidence, the first of equals; one without confidence comes last."""
    return candidates.groupBy(key).agg(F.min_by("rank", F.struct(-F.coalesce("confidence", F.lit(-1.0)), F.col("rank"))).alias("agent_rank"))


def selection_summary(scored: DataFrame, baseline: DataFrame, agent: DataFrame, key: str) -> DataFrame:
    """One row: unit error rates of the first, the baseline's, an agent's and the best hypotheses, how many lists the agent changed,
    bettered, harmed or left alike against the first, and how much of the headroom either gains (null without any)."""
    rank = lambda c: F.max(F.when(F.col("rank") == F.col(c), F.col("edits")))
    picked = scored.join(baseline, key).join(agent, key).groupBy(key).agg(F.max("baseline_rank").alias("baseline_rank"), F.max("agent_rank").alias("agent_rank"), rank("baseline_rank").alias("baseline_edits"), rank("agent_rank").alias("agent_edits"))
    rows = oracle_hypothesis(scored, key).join(picked, key)
    gain = F.col("top1_edits") - F.col("agent_edits")
    total = rows.agg(
        F.count("*").alias("lists"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("ref_units", "top1_edits", "baseline_edits", "agent_edits", "oracle_edits")], F.count_if(F.col("agent_rank") == F.col("top1_rank")).alias("rank1_retained"),
        F.count_if(F.col("agent_rank") != F.col("top1_rank")).alias("agent_changed"), F.count_if(gain > 0).alias("improved"), F.count_if(gain < 0).alias("harmful"), F.count_if(gain == 0).alias("neutral"), F.count_if(F.col("agent_rank") == F.col("oracle_rank")).alias("oracle_selected"),
    )
    rate = lambda c: F.round(F.coalesce(F.try_divide(F.col(c), F.col("ref_units")), F.lit(0.0)), 6)
    recovered = lambda c: F.round(F.try_divide(F.col("top1_edits") - F.col(c), F.nullif(F.col("top1_edits") - F.col("oracle_edits"), F.lit(0))), 6)
    return total.withColumns({f"{x}_uer": rate(f"{x}_edits") for x in ("top1", "baseline", "agent", "oracle")} | {f"{x}_headroom_recovered": recovered(f"{x}_edits") for x in ("baseline", "agent")})


def attempts_as_lists(results: DataFrame, key: str = "sentence_id") -> DataFrame:
    """(key, rank, units, confidence, ref, alerts, failed): the attempts at a sentence as its n-best list, the newest first; units are segments,
    alerts are unknown labels."""
    usable = results.where(~blank("ai_segmented") & ~blank("gold_segmented"))
    units = lambda c: F.filter(F.split(F.col(c), r"(?U)[\s\-]+"), lambda u: u != "")
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.col("finished_at").desc_nulls_last(), F.col("result_id").desc()))
    return usable.select(
        key, rank.alias("rank"), units("ai_segmented").alias("units"), "confidence", units("gold_segmented").alias("ref"),
        F.size(F.filter(A.annotation_ids("ai_annotation"), lambda t: t == A.UNKNOWN)).alias("alerts"), F.coalesce(F.col("decision") == "failed", F.lit(False)).alias("failed"),
    )
