"""Items and results as tables: what is missing, what to take, what to hand out."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from interlace.functions.text import blank, strip


def first_of(df: DataFrame, names: Sequence[str]) -> Column:
    """The first of the columns that exist whose value isn't blank, trimmed; else an empty text."""
    found = [F.nullif(strip(F.col(c).cast("string")), F.lit("")) for c in names if c in df.columns]
    return F.coalesce(*found, F.lit(""))


def needing(df: DataFrame, needs: str) -> DataFrame:
    """Items that lack annotation (surfaces and labels both given), translation, either or both; 'any' takes all."""
    no_annotation, no_translation = blank("segmented") | blank("annotation"), blank("translation_jp")
    keep = {"any": F.lit(True), "annotation": no_annotation, "translation": no_translation, "either": no_annotation | no_translation, "both": no_annotation & no_translation}
    if needs not in keep:
        raise ValueError(f"needs must be one of {', '.join(keep)}")
    return df.where(keep[needs])


def in_scope(df: DataFrame, dataset_id: int, first: int, last: int) -> DataFrame:
    """Sentences of a dataset from `first` to `last`, both included; both are pushed down to the scan."""
    return df.where((F.col("dataset_id") == dataset_id) & F.col("sentence_id").between(first, last))


def latest(df: DataFrame, key: str, n: int) -> DataFrame:
    """The n rows of the highest keys, in ascending order."""
    return df.orderBy(F.col(key).desc()).limit(n).orderBy(key)


def page(df: DataFrame, key: str, after: int, n: int) -> DataFrame:
    """The next n rows after a key."""
    return df.where(F.col(key) > after).orderBy(key).limit(n)


def parsed_payload(df: DataFrame, payload: str, *keep: str) -> DataFrame:
    """(*keep, decision, confidence, segmented, annotation, trsl_ai, valid) of a JSON answer, with or without a code fence."""
    bare = F.regexp_replace(F.regexp_replace(strip(F.coalesce(payload, F.lit(""))), r"^```(?:json)?\s*", ""), r"\s*```$", "")
    # what isn't one whole JSON object gives nulls, whatever could be read of it
    fields = F.when(bare.endswith("}") & F.get_json_object(bare, "$").isNotNull(), F.from_json(bare, "decision string, confidence double, segmented string, annotation string, trsl_ai string"))
    out = df.select(*keep, fields.alias("f")).select(*keep, F.lower("f.decision").alias("decision"), F.coalesce("f.confidence", F.lit(0.0)).alias("confidence"), *[strip(F.coalesce(f"f.{c}", F.lit(""))).alias(c) for c in ("segmented", "annotation", "trsl_ai")])
    ok = F.coalesce(F.col("decision").isin("proposed", "uncertain", "failed"), F.lit(False)) & F.col("confidence").between(0, 1)
    return out.withColumn("valid", ok)


def accepted_segmentations(df: DataFrame, key: str, segmented: str, text: str) -> DataFrame:
    """(key, accepted): whether the segments, put together, give the text, none being empty; phrases keep their blanks."""
    s = F.coalesce(segmented, F.lit(""))
    sound = F.forall(F.split(s, " "), lambda p: (p != "") & F.forall(F.split(p, "-"), lambda v: v != ""))
    return df.where(F.col(segmented).isNotNull() & F.col(text).isNotNull()).select(key, (sound & (F.replace(s, F.lit("-"), F.lit("")) == F.col(text))).alias("accepted"))


def output_rows(df: DataFrame, original: Sequence[str]) -> DataFrame:
    """Original columns, and a result's as texts: missing ones empty, a result without any answer failed."""
    failed = blank("ai_segmented") & blank("ai_annotation") & blank("trsl_ai")
    return df.select(
        *original, *[F.coalesce(c, F.lit("")).alias(c) for c in ("ai_segmented", "ai_annotation")], F.coalesce("trsl_ai", F.lit("")).alias("ai_translation"),
        F.when(failed, "failed").otherwise(F.coalesce("decision", F.lit(""))).alias("ai_decision"), F.when(F.col("confidence").isNull(), "").otherwise(F.format_string("%.6f", "confidence")).alias("ai_confidence"),
    )


def chosen_analysis(sentences: DataFrame, results: DataFrame) -> DataFrame:
    """(sentence_id, source, segmented, annotation): a sentence's own analysis where both parts are given, else that of its latest
    result with both, else none."""
    usable = results.where(~blank("ai_segmented") & ~blank("ai_annotation"))
    best = usable.groupBy("sentence_id").agg(F.max_by(F.struct("ai_segmented", "ai_annotation"), F.struct("finished_at", "result_id")).alias("p"))
    own = ~blank("segmented") & ~blank("annotation")
    rows = sentences.select("sentence_id", "segmented", "annotation", own.alias("own")).join(best, "sentence_id", "left")
    pick = lambda mine, theirs: F.when(F.col("own"), F.col(mine)).otherwise(F.coalesce(F.col(theirs), F.lit("")))
    return rows.select("sentence_id", F.when(F.col("own"), "existing").when(F.col("p").isNotNull(), "predicted").otherwise("none").alias("source"), pick("segmented", "p.ai_segmented").alias("segmented"), pick("annotation", "p.ai_annotation").alias("annotation"))


def export_rows(results: DataFrame, sentences: DataFrame, jobs: DataFrame) -> DataFrame:
    """Results of jobs with their sentences' own texts and translations, for hand-out; results of unknown sentences or jobs stay."""
    own = sentences.select("sentence_id", "example_id", F.col("text").alias("own_text"), F.col("translation_jp").alias("human_translation_jp"))
    job = jobs.select(F.col("id").alias("job_id"), "task", "model_name", "dataset_name")
    return results.join(own, "sentence_id", "left").join(job, "job_id", "left").select(
        "result_id", "job_id", "sentence_id", "example_id", F.coalesce("text", "own_text").alias("source_text"), "human_translation_jp", "ai_segmented", "ai_annotation", F.col("trsl_ai").alias("ai_translation"),
        "decision", "confidence", "gold_segmented", "gold_annotation", F.coalesce(F.col("exact_match").cast("string"), F.lit("")).alias("exact_match"), "task", "model_name", "dataset_name",
    )


def attempts_with_last(results: DataFrame) -> DataFrame:
    """Attempts of a job at a sentence, from the second on, with text, analysis and confidence of the one before as last_*."""
    w = Window.partitionBy("sentence_id", "job_id").orderBy(F.col("attempt").asc_nulls_last(), "result_id")
    before = F.lag(F.struct("text", "ai_segmented", "ai_annotation", "confidence")).over(w)
    rows = results.where("sentence_id is not null and job_id is not null").withColumn("__b", before).where("__b is not null")
    return rows.select("result_id", "ai_segmented", "ai_annotation", "confidence", F.col("__b.text").alias("last_text"), F.col("__b.ai_segmented").alias("last_segmented"), F.col("__b.ai_annotation").alias("last_annotation"), F.col("__b.confidence").alias("last_confidence"))


def counters(results: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by, selected, completed, failed): results by whether they came to an answer."""
    failed = F.coalesce(F.col("decision") == "failed", F.lit(False))
    return results.groupBy(*by).agg(F.count("*").alias("selected"), F.count_if(~failed).alias("completed"), F.count_if(failed).alias("failed"))
