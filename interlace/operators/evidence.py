"""Corpus evidence about IDs and forms: counts, patterns, n-grams, support, search, samples."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from interlace.functions import annotation as A
from interlace.functions.text import blank, strip


def one_per_sentence(sentences: DataFrame) -> DataFrame:
    """The latest export of each sentence: re-exports would count twice.

    Rows beyond the first are dropped in each task before the shuffle (a limit on the window's groups), so a sentence exported very
    often stays small; columns that aren't used later aren't read.
    """
    newest = Window.partitionBy("sentence_id").orderBy(F.col("ingested_at").desc_nulls_last(), F.col("row_id").desc())
    return sentences.withColumn("__n", F.row_number().over(newest)).where("__n = 1").drop("__n")


def tokens(sentences: DataFrame, *keep: str) -> DataFrame:
    """(sentence_id, *keep, phrase_no, phrase, id): one row per ID and place, with the phrase it stands in."""
    phrases = sentences.select("sentence_id", *keep, F.posexplode(A.phrases("annotation")).alias("phrase_no", "phrase"))
    return phrases.select("sentence_id", *keep, "phrase_no", "phrase", F.explode(A.annotation_ids("phrase")).alias("id"))


def summary(sentences: DataFrame) -> DataFrame:
    """Per ID: tokens, tokens in translated sentences, distinct sentences, datasets and dialects.

    Counted first per ID, sentence, dataset and dialect, so that a frequent ID's rows are few before they meet.
    """
    t = tokens(sentences.withColumn("translated", ~blank("translation_jp")), "dataset_id", "dialect_id", "translated")
    each = t.groupBy("id", "sentence_id", "dataset_id", "dialect_id").agg(F.count("*").alias("n"), F.sum(F.col("translated").cast("int")).alias("m"))
    return each.groupBy("id").agg(F.sum("n").alias("tokens"), F.sum("m").alias("translated_tokens"), F.count_distinct("sentence_id").alias("sentences"), F.count_distinct("dataset_id").alias("datasets"), F.count_distinct("dialect_id").alias("dialects"))


def phrase_patterns(sentences: DataFrame, least: int = 2) -> DataFrame:
    """(id, phrase, tokens): the exact phrases in which an ID stands."""
    return tokens(sentences).groupBy("id", "phrase").agg(F.count("*").alias("tokens")).where(F.col("tokens") >= least)


def ngrams(sentences: DataFrame, n: int, least: int = 3) -> DataFrame:
    """(token_1 .. token_n, tokens): runs of n IDs inside a phrase, without control IDs."""
    ids = sentences.select(F.explode(A.phrases("annotation")).alias("phrase")).select(A.annotation_ids("phrase").alias("ids")).where(F.size("ids") >= n)
    grams = ids.select(F.explode(F.transform(F.sequence(F.lit(1), F.size("ids") - n + 1), lambda i: F.slice("ids", i, n))).alias("g"))
    names = [f"token_{i + 1}" for i in range(n)]
    return grams.select(*[F.col("g")[i].alias(c) for i, c in enumerate(names)]).groupBy(*names).agg(F.count("*").alias("tokens")).where(F.col("tokens") >= least)


def segment_pairs(sentences: DataFrame, *keep: str) -> DataFrame:
    """(sentence_id, *keep, phrase_no, segment_no, surface, label) of sentences whose surfaces and labels can be aligned."""
    fit = sentences.where(~blank("segmented") & ~blank("annotation") & A.alignment_error("segmented", "annotation").isNull())
    zipped = F.arrays_zip(A.skeleton("segmented").alias("s"), A.skeleton("annotation").alias("a"))
    phrases = fit.select("sentence_id", *keep, F.posexplode(zipped).alias("phrase_no", "z"))
    both = phrases.select("sentence_id", *keep, "phrase_no", F.posexplode(F.arrays_zip(F.col("z.s").alias("surface"), F.col("z.a").alias("label"))).alias("segment_no", "p"))
    return both.select("sentence_id", *keep, "phrase_no", "segment_no", F.col("p.surface").alias("surface"), F.col("p.label").alias("label"))


def in_context(pairs: DataFrame) -> DataFrame:
    """Segment pairs with the surface before ('' first in its phrase), the label after ('<EOS>' last) and whether they begin one."""
    w = Window.partitionBy("sentence_id", "phrase_no").orderBy("segment_no")
    return pairs.withColumns({"previous_surface": F.lag("surface", 1, "").over(w), "next_label": F.lead("label", 1, "<EOS>").over(w), "phrase_start": F.col("segment_no") == 0})


def form_support(pairs: DataFrame, lexicon: DataFrame, enough: int = 5) -> DataFrame:
    """(surface, label, corpus_count, lexicon_count, candidate_count, surface_total, candidate_rate, alternatives): how often a
    surface carries a label, in corpus and lexicon. A surface's total is joined from its own aggregate, not from a window over it."""
    corpus = pairs.groupBy("surface", "label").agg(F.count("*").alias("corpus_count"))
    lexical = lexicon.select(F.col("form2").alias("surface"), F.col("annotation").alias("label")).where("surface is not null and label is not null").groupBy("surface", "label").agg(F.count("*").alias("lexicon_count"))
    counts = corpus.join(lexical, ["surface", "label"], "full").na.fill(0, ["corpus_count", "lexicon_count"]).withColumn("candidate_count", F.col("corpus_count") + F.col("lexicon_count"))
    totals = counts.groupBy("surface").agg(F.sum("candidate_count").alias("surface_total"), F.count("*").alias("alternatives"))
    out = counts.join(totals, "surface")
    weak = F.col("candidate_count") * 10 < F.col("surface_total")
    return out.withColumns({"candidate_rate": F.round(F.col("candidate_count") / F.col("surface_total"), 6), "penalty": F.when((F.col("surface_total") >= enough) & weak, "weak").otherwise("none")})


def proposal_support(proposed: DataFrame, pairs: DataFrame, lexicon: DataFrame, enough: int = 5) -> DataFrame:
    """Proposed pairs (surface, label, region) with what the region's corpus and lexicon say of them: candidate_count, surface_total,
    candidate_rate and penalty. Strong: the surface is well attested there, never with the label; weak: in less than a tenth."""
    corpus = pairs.select(F.col("dialect_region").alias("region"), "surface", "label")
    lexical = lexicon.select("region", F.col("form2").alias("surface"), F.col("annotation").alias("label")).where("label is not null")
    counts = corpus.unionByName(lexical).where("region is not null and surface is not null").groupBy("region", "surface", "label").agg(F.count("*").alias("candidate_count"))
    totals = counts.groupBy("region", "surface").agg(F.sum("candidate_count").alias("surface_total"))
    out = proposed.join(totals, ["region", "surface"], "left").join(counts, ["region", "surface", "label"], "left").na.fill(0, ["surface_total", "candidate_count"])
    known = F.col("surface_total") >= enough
    penalty = F.when(known & (F.col("candidate_count") == 0), "strong").when(known & (F.col("candidate_count") * 10 < F.col("surface_total")), "weak").otherwise("none")
    return out.withColumns({"candidate_rate": F.round(F.try_divide(F.col("candidate_count"), F.col("surface_total")), 6), "penalty": penalty})


def looked_up(asked: DataFrame, forms: DataFrame, lexicon: DataFrame) -> DataFrame:
    """(label, annotation_schema_id, local_forms, global_forms, lexemes, scope): what is known of a label: forms of its own schema
    (local), of any (global), and lexemes that carry it. Scope: local, else global, else none."""
    local = forms.groupBy("label", "annotation_schema_id").agg(F.count("*").alias("local_forms"))
    everywhere = local.groupBy("label").agg(F.sum("local_forms").alias("global_forms"))
    lexemes = lexicon.groupBy(F.col("annotation").alias("label")).agg(F.count_distinct("lexeme_id").alias("lexemes"))
    out = asked.select("label", "annotation_schema_id").distinct().join(local, ["label", "annotation_schema_id"], "left").join(everywhere, "label", "left").join(lexemes, "label", "left")
    out = out.na.fill(0, ["local_forms", "global_forms", "lexemes"])
    return out.withColumn("scope", F.when(F.col("local_forms") > 0, "local").when(F.col("global_forms") + F.col("lexemes") > 0, "global").otherwise("none"))


def label_sets(pairs: DataFrame) -> DataFrame:
    """(surface, labels, n_labels): the distinct labels of a surface, sorted."""
    return pairs.select("surface", "label").distinct().groupBy("surface").agg(F.array_join(F.array_sort(F.collect_list("label")), "|").alias("labels"), F.count("*").alias("n_labels"))


def pattern_search(sentences: DataFrame, expressions: DataFrame, most: int = 8, atoms: bool = True, excluded: DataFrame | None = None, across: bool = False) -> DataFrame:
    """(expression, sentence_id): up to `most` sentences, the first by ID, in which the segments of an expression follow one another,
    inside a phrase or with `across` from one phrase to the next. An expression of one atom is also found inside conflated segments,
    unless `atoms` is off. Sentences whose ID is in `excluded` aren't searched.

    Runs of segments are made only of the lengths that expressions have and met by equality. Per expression the first `most` are
    kept in each task before they meet.
    """
    wanted = expressions.where(~A.expression_rejected("expression")).select(strip("expression").alias("expression")).distinct()
    lengths = sorted(r[0] for r in wanted.select(F.size(F.split("expression", "-"))).distinct().collect())  # at most 8, by the guard
    searched = sentences if excluded is None else sentences.join(excluded.select("sentence_id").distinct(), "sentence_id", "left_anti")
    phrases = searched.select("sentence_id", A.segments("annotation").alias("p")) if across else searched.select("sentence_id", F.explode(A.skeleton("annotation")).alias("p"))

    def joined(n: int) -> Column:
        return F.when(F.size("p") >= n, F.transform(F.sequence(F.lit(1), F.size("p") - n + 1), lambda i: F.array_join(F.slice("p", i, n), "-"))).otherwise(F.array().cast("array<string>"))

    runs = [joined(n) for n in lengths] + ([F.flatten(F.transform("p", lambda s: F.split(s, ";")))] if atoms else [])
    found = phrases.select("sentence_id", F.explode(F.array_distinct(F.concat(*runs) if runs else F.array().cast("array<string>"))).alias("expression")).join(wanted, "expression", "left_semi").distinct()
    return top_k(found, ["expression"], [F.col("sentence_id")], most)


def top_k(df: DataFrame, by: Sequence[str], order: Sequence[Column], k: int, salts: int = 64) -> DataFrame:
    """The first k rows of each group. A group's rows are first spread over `salts` parts, each of which keeps its first k."""
    rows = df.withColumn("__salt", F.pmod(F.xxhash64(*df.columns), F.lit(salts)))
    kept = rows.withColumn("__n", F.row_number().over(Window.partitionBy(*by, "__salt").orderBy(*order))).where(F.col("__n") <= k)
    return kept.withColumn("__n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("__n") <= k).drop("__n", "__salt")


def examples(sentences: DataFrame, k: int = 6) -> DataFrame:
    """(id, sentence_id, phrase, translated): examples of an ID, one per phrase pattern, translated ones first."""
    t = tokens(sentences.withColumn("translated", ~blank("translation_jp")), "translated")
    best = F.struct((~F.col("translated")).alias("bare"), F.col("sentence_id"))
    one = t.groupBy("id", "phrase").agg(F.min(best).alias("b")).select("id", "phrase", (~F.col("b.bare")).alias("translated"), F.col("b.sentence_id").alias("sentence_id"))
    return top_k(one, ["id"], [F.col("translated").desc(), F.col("sentence_id"), F.col("phrase")], k)


def seeded_sample(df: DataFrame, by: Sequence[str], key: str, k: int, seed: int) -> DataFrame:
    """k rows of each group, the same for the same seed: the first by a hash of key and seed."""
    return top_k(df.withColumn("__h", F.md5(F.concat(F.col(key).cast("string"), F.lit(f":{seed}")))), by, [F.col("__h"), F.col(key)], k).drop("__h")


def dialect_fallback(forms: DataFrame, dialect_id: int, region: str) -> DataFrame:
    """A label's forms of the dialect if there are any, else those of its region, with the scope they come from."""
    asked = F.col("dialect_id").eqNullSafe(dialect_id)
    some = forms.where(asked).select("label").distinct().withColumn("__own", F.lit(True))
    near = forms.where(asked | (F.col("dialect_region") == region)).join(some, "label", "left")
    return near.where(asked | F.col("__own").isNull()).withColumn("scope", F.when(asked, "requested_dialect").otherwise("same_region")).drop("__own")


def preferred(forms: DataFrame, dialects: Sequence[int]) -> DataFrame:
    """(label, dialect_id, form_source): the first listed dialect with a form of its own corpus, else the first with any, else -1 and none."""
    order = F.array_position(F.array(*[F.lit(d) for d in dialects]), F.col("dialect_id"))
    listed = forms.where(F.col("dialect_id").isin(*dialects)).withColumn("__o", F.struct(F.when(F.col("form_source") == "corpus", 0).otherwise(1), order))
    best = listed.groupBy("label").agg(F.min_by(F.struct("dialect_id", "form_source"), "__o").alias("b")).select("label", F.col("b.dialect_id").alias("dialect_id"), F.when(F.col("b.form_source") == "corpus", "requested_dialect").otherwise("schema_pool").alias("scope"))
    return forms.select("label").where("label is not null").distinct().join(best, "label", "left").na.fill({"dialect_id": -1, "scope": "none"})


def region_dialects(sentences: DataFrame) -> DataFrame:
    """(dialect_region, dialects, representative): the dialects of a region, those with most sentences first."""
    counts = sentences.where("dialect_region is not null and dialect_id is not null").groupBy("dialect_region", "dialect_id").agg(F.count_distinct("sentence_id").alias("n"))
    listed = counts.groupBy("dialect_region").agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("k"), F.col("dialect_id").alias("d")))).alias("l"))
    return listed.select("dialect_region", F.array_join(F.transform("l", lambda x: x["d"].cast("string")), ",").alias("dialects"), F.get("l", F.lit(0))["d"].alias("representative"))


def notes(sentences: DataFrame, k: int = 3) -> DataFrame:
    """(id, note): up to k examples of an ID in one text, a line each."""
    chosen = examples(sentences, k).join(sentences.select("sentence_id", "text", "translation_jp"), "sentence_id")
    line = F.struct((~F.col("translated")).alias("bare"), F.col("sentence_id"), F.col("phrase"), A.example_note(F.col("text"), F.col("phrase"), F.col("translation_jp")).alias("line"))
    return chosen.groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(line)), lambda x: x["line"]), "\n").alias("note"))
