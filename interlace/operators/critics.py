"""Count models of ID sequences and of surface forms, and what they find doubtful."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from interlace.functions import annotation as A
from interlace.functions.text import blank
from interlace.operators.evidence import top_k
from interlace.plans.storage import fits, written

#: Beginning and end of a sentence, and the place between two phrases.
BEGIN, END, BREAK = "<BOS>", "<EOS>", "<PB>"


def steps(sentences: DataFrame, key: str, annotation: str = "annotation", unit: str = "atom") -> DataFrame:
    """(key, place, previous, token): every token with the one before it, with marks for beginning, end and phrase breaks. Tokens are
    IDs, or with unit 'segment' the labels of whole segments."""
    own = {"atom": A.annotation_ids, "segment": A.labels}[unit]
    words = F.flatten(F.transform(A.phrases(annotation), lambda p, i: F.concat(F.when(i > 0, F.array(F.lit(BREAK))).otherwise(F.array().cast("array<string>")), own(p))))
    line = sentences.where(~blank(annotation)).select(key, F.concat(F.array(F.lit(BEGIN)), words, F.array(F.lit(END))).alias("w"))
    pairs = F.transform(F.sequence(F.lit(1), F.size("w") - 1), lambda i: F.struct(F.element_at("w", i).alias("previous"), F.element_at("w", i + 1).alias("token")))
    return line.select(key, F.posexplode(pairs).alias("place", "s")).select(key, "place", "s.*")


def sequence_model(sentences: DataFrame, key: str = "sentence_id", add: float = 0.1, unit: str = "atom") -> DataFrame:
    """(previous, token, n, log_p): add-k estimates over the tokens seen; written once."""
    counts = written(steps(sentences, key, unit=unit).groupBy("previous", "token").agg(F.count("*").alias("n")), "steps")
    known = counts.select(F.count_distinct("token")).first()[0] or 1
    total = counts.groupBy("previous").agg(F.sum("n").alias("total"))
    return written(counts.join(total, "previous").select("previous", "token", "n", F.log((F.col("n") + add) / (F.col("total") + add * known)).alias("log_p")), "sequence-model")


def surprises(sentences: DataFrame, model: DataFrame, key: str, annotation: str = "annotation", unit: str = "atom", surprise: float = -6.0, unseen: float = -12.0, k: int = 3) -> DataFrame:
    """(key, unit, place, previous, token, log_p, alternatives): the surprising steps, with the k tokens that most often follow the same
    one instead; `alternatives` is null where the model knows none."""
    small = model.select("previous", "token", "log_p")
    found = steps(sentences, key, annotation, unit).join(F.broadcast(small) if fits(small, "length(previous) * 4 + length(token) * 4 + 8") else small, ["previous", "token"], "left")
    found = found.withColumn("log_p", F.coalesce("log_p", F.lit(unseen))).where(F.col("log_p") < surprise)
    best = top_k(model.select("previous", "token", "n"), ["previous"], [F.col("n").desc(), F.col("token")], k)
    listed = best.groupBy("previous").agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("k"), "token"))).alias("l"))
    text = listed.select("previous", F.array_join(F.transform("l", lambda x: F.concat(x["token"], F.lit(":"), (-x["k"]).cast("string"))), "|").alias("alternatives"))
    return found.join(text, "previous", "left").select(key, F.lit(unit).alias("unit"), "place", "previous", "token", F.round("log_p", 6).alias("log_p"), "alternatives")


def sequence_scores(sentences: DataFrame, model: DataFrame, key: str, annotation: str = "annotation", surprise: float = -6.0, unseen: float = -12.0) -> DataFrame:
    """(key, steps, mean_log_p, surprises): a step below `surprise` is one; a step that the model hasn't seen counts as `unseen`."""
    small = model.select("previous", "token", "log_p")
    s = steps(sentences, key, annotation).join(F.broadcast(small) if fits(small, "length(previous) * 4 + length(token) * 4 + 8") else small, ["previous", "token"], "left")
    log_p = F.coalesce("log_p", F.lit(unseen))
    return s.groupBy(key).agg(F.count("*").alias("steps"), F.round(F.avg(log_p), 6).alias("mean_log_p"), F.count_if(log_p < surprise).alias("surprises"))


def revisions(before: DataFrame, after: DataFrame, key: str, unit: str) -> DataFrame:
    """(key, accepted): scores `after` of proposals against `before` of their unit; fewer surprises, or as many and a better mean."""
    joined = after.join(before.select(unit, F.col("surprises").alias("s0"), F.col("mean_log_p").alias("m0")), unit)
    return joined.select(key, unit, ((F.col("surprises") < F.col("s0")) | ((F.col("surprises") == F.col("s0")) & (F.col("mean_log_p") > F.col("m0")))).alias("accepted"))


def suggested_forms(pairs: DataFrame, dialect_id: int, k: int = 3) -> DataFrame:
    """(label, form, n, scope): a label's k most frequent forms in a dialect, or of all dialects where it has none there."""
    counts = pairs.groupBy("label", F.col("surface").alias("form")).agg(F.count("*").alias("all_n"), F.count_if(F.col("dialect_id") == dialect_id).alias("own_n"))
    has = counts.groupBy("label").agg((F.max("own_n") > 0).alias("own"))
    n = counts.join(has, "label").withColumn("n", F.when(F.col("own"), F.col("own_n")).otherwise(F.col("all_n"))).where("n > 0")
    best = top_k(n.select("label", "form", "n", F.when(F.col("own"), "dialect").otherwise("schema_pool").alias("scope")), ["label"], [F.col("n").desc(), F.col("form")], k)
    return best


def disagreements(pairs: DataFrame, key: str = "sentence_id", k: int = 3, gap: float = 0.75) -> DataFrame:
    """(key, segments, strong): segments whose form isn't their label's most frequent and either not among its k, or behind by `gap`
    in log-frequency."""
    counts = written(pairs.groupBy("label", "surface").agg(F.count("*").alias("n")), "form-counts")
    top = top_k(counts, ["label"], [F.col("n").desc(), F.col("surface")], k)
    first = top.groupBy("label").agg(F.max("n").alias("best_n"), F.min_by("surface", F.struct(-F.col("n"), F.col("surface"))).alias("best"))
    each = counts.join(first, "label").join(top.select("label", "surface", F.lit(True).alias("among")), ["label", "surface"], "left")
    strong = each.select("label", "surface", ((F.col("surface") != F.col("best")) & (F.col("among").isNull() | (F.log(F.col("best_n")) - F.log(F.col("n")) >= gap))).alias("strong"))
    return pairs.join(strong, ["label", "surface"]).groupBy(key).agg(F.count("*").alias("segments"), F.count_if("strong").alias("strong"))


def margins(pairs: DataFrame) -> DataFrame:
    """(surface, n, margin): share of a surface's most frequent label less that of its second; null with one label only."""
    counts = written(pairs.groupBy("surface", "label").agg(F.count("*").alias("n")), "label-counts")
    two = top_k(counts, ["surface"], [F.col("n").desc(), F.col("label")], 2).groupBy("surface").agg(F.sort_array(F.collect_list("n"), asc=False).alias("t"))
    total = counts.groupBy("surface").agg(F.sum("n").alias("n"))
    return total.join(two, "surface").select("surface", "n", F.round((F.get("t", F.lit(0)) - F.get("t", F.lit(1))) / F.col("n"), 6).alias("margin"))


def triage(results: DataFrame, margin: DataFrame, sure: float = 0.80, clear: float = 0.15) -> DataFrame:
    """(result_id, reasons): results that are doubtful, and why; an unknown confidence isn't."""
    surfaces = results.where(~blank("ai_segmented")).select("result_id", F.explode(A.morph_surfaces("ai_segmented")).alias("surface"))
    close = surfaces.join(margin.where(F.col("margin") < clear).select("surface"), "surface", "left_semi").select("result_id").distinct().withColumn("close", F.lit(True))
    reasons = F.concat_ws(
        ",", F.when(F.col("confidence") < sure, "low_confidence"), F.when(F.array_contains(A.annotation_ids("ai_annotation"), A.UNKNOWN), "unknown_id"), F.when(F.col("close"), "small_alternative_margin")
    )
    return results.join(close, "result_id", "left").select("result_id", reasons.alias("reasons")).where("reasons <> ''")


def segment_triage(results: DataFrame, segments: DataFrame, margin: DataFrame, surprising: DataFrame, sure: float = 0.80, clear: float = 0.15) -> DataFrame:
    """(result_id, surface, label, reasons): segments that are doubtful, each once, and why: besides confidence, unknown labels and close
    alternatives, a label or atom of one that stands in a surprising step of its result."""
    words = surprising.select("result_id", F.explode(F.array("previous", "token")).alias("id")).where(~F.col("id").isin(BEGIN, END, BREAK))
    hot = words.groupBy("result_id").agg(F.collect_set("id").alias("hot"))  # a result has few
    close = margin.where(F.col("margin") < clear).select("surface", F.lit(True).alias("close"))
    atoms = F.transform(F.split("label", ";"), lambda a: F.trim(a))
    each = segments.select("result_id", "surface", "label").distinct().join(results.select("result_id", "confidence"), "result_id").join(hot, "result_id", "left").join(close, "surface", "left")
    reasons = F.concat_ws(
        ",", F.when(F.col("confidence") < sure, "low_confidence"), F.when(F.array_contains(atoms, A.UNKNOWN), "unknown_id"), F.when(F.col("close"), "small_alternative_margin"),
        F.when(F.arrays_overlap(F.concat(F.array("label"), atoms), "hot"), "id_sequence_hotspot"),
    )
    return each.where("surface <> ''").select("result_id", "surface", "label", reasons.alias("reasons")).where("reasons <> ''")


#: Contexts of a form, from the narrowest; the first with enough evidence counts. All but the last are of one dialect.
CONTEXTS = (("label", "dialect_id", "previous_surface", "next_label", "phrase_start"), ("label", "dialect_id", "next_label"), ("label", "dialect_id"), ("label",))


def context_scores(pairs: DataFrame, enough: int = 3, k: int = 3, gap: float = 0.75) -> DataFrame:
    """Segment pairs in context, each kind once, with n (how often), level (of CONTEXTS, null without enough evidence), best (the form
    that is most frequent there), score_gap (in log-frequency) and strong: another form than the best that is either not among the k
    most frequent, or behind by `gap`.

    Kinds are counted first, so a context's counts come from kinds, not from segments.
    """
    kinds = written(pairs.withColumn("dialect_id", F.coalesce("dialect_id", F.lit(-1))).groupBy(*CONTEXTS[0], "surface").agg(F.count("*").alias("n")), "kinds")
    out = kinds
    for level, by in enumerate(CONTEXTS):
        counts = kinds.groupBy(*by, "surface").agg(F.sum("n").alias(f"n{level}"))
        totals = counts.groupBy(*by).agg(F.sum(f"n{level}").alias("total")).where(F.col("total") >= enough)
        top = top_k(counts, by, [F.col(f"n{level}").desc(), F.col("surface")], k)
        first = top.groupBy(*by).agg(F.max(f"n{level}").alias(f"best_n{level}"), F.min_by("surface", F.struct(-F.col(f"n{level}"), F.col("surface"))).alias(f"best{level}"), F.collect_set("surface").alias(f"top{level}"))
        out = out.join(counts.join(totals.join(first, list(by)), list(by)).drop("total"), [*by, "surface"], "left")
    chosen = [F.when(F.col(f"best{level}").isNotNull(), F.struct(F.lit(level).alias("level"), F.col(f"best{level}").alias("best"), F.log(F.col(f"best_n{level}") / F.col(f"n{level}")).alias("score_gap"), F.array_contains(f"top{level}", F.col("surface")).alias("among"))) for level in range(len(CONTEXTS))]
    rows = out.select(*CONTEXTS[0], "surface", "n", F.coalesce(*chosen).alias("c"))
    strong = (F.col("surface") != F.col("c.best")) & (~F.col("c.among") | (F.col("c.score_gap") >= gap))
    return rows.select(*CONTEXTS[0], "surface", "n", "c.level", "c.best", F.round("c.score_gap", 6).alias("score_gap"), F.coalesce(strong, F.lit(False)).alias("strong"))


def context_review(pairs: DataFrame, key: str = "sentence_id") -> DataFrame:
    """(key, segments, reviewed, strong): of a sentence's segments those with evidence for their label, and strong disagreements."""
    scored = context_scores(pairs).select(*CONTEXTS[0], "surface", "level", "strong")
    own = pairs.withColumn("dialect_id", F.coalesce("dialect_id", F.lit(-1))).select(key, *CONTEXTS[0], "surface")
    return own.join(scored, [*CONTEXTS[0], "surface"]).groupBy(key).agg(F.count("*").alias("segments"), F.count("level").alias("reviewed"), F.count_if("strong").alias("strong"))


def reviewed(results: DataFrame, key: str, before: tuple[str, str], after: tuple[str, str], text: str, confidence: tuple[str, str]) -> DataFrame:
    """(key, action, reason, segmented, annotation, confidence): a revision is taken where it changes the analysis and is sound (its
    segments give the text, its labels align), with the higher of both confidences; else the analysis is kept."""
    had, new = [F.coalesce(c, F.lit("")) for c in before], [F.coalesce(c, F.lit("")) for c in after]
    same = (had[0] == new[0]) & (had[1] == new[1])
    revise = ~same & A.sound_analysis(F.col(text), new[0], new[1])
    bounded = [A.bounded(c) for c in confidence]
    return results.select(
        key, F.when(revise, "revise").otherwise("keep").alias("action"), F.when(same, "unchanged").when(~revise, "unsound").otherwise("changed").alias("reason"),
        F.when(revise, new[0]).otherwise(had[0]).alias("segmented"), F.when(revise, new[1]).otherwise(had[1]).alias("annotation"), F.when(revise, F.greatest(*bounded)).otherwise(bounded[0]).alias("confidence"),
    )


def unobserved(proposed: DataFrame, observed: DataFrame) -> DataFrame:
    """Proposed (surface, label) pairs of surfaces that the corpus knows, but not with this label."""
    known = observed.select("surface", "label").distinct()
    return proposed.join(known.select("surface").distinct(), "surface", "left_semi").join(known, ["surface", "label"], "left_anti")
