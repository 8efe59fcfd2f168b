"""Queries over the project's tables for the operators of the core, and their SQL where there is one."""

from __future__ import annotations

from pyspark.sql import functions as F

from interlace.functions import annotation as A
from interlace.functions import oracle as O
from interlace.functions.alignment import edit_distance
from interlace.operators import critics, evaluation, evidence, items, licensed, proposals, scopes, usage
from interlace.operators.packed import split_packed
from interlace.plans.registry import Registry

registry = Registry()
query = registry.add
QUERIES, ORACLES = registry.queries, registry.oracles


def _bar(col):
    return F.array_join(col, "|")


# Several values in one field


@query(
    " UNION ALL ".join(
        f"SELECT row_id, '{f}' AS field_name, CAST(unnest(range(len(v))) AS INTEGER) AS pos, unnest(v) AS item_value FROM (SELECT row_id, {O.packed_values(f)} AS v FROM sentences)" for f in ("annotation", "segmented")
    )
)
def p1_found(t):
    return split_packed(t.sentences, ["row_id"], ["annotation", "segmented"])


# Annotation algebra


@query(f"SELECT row_id, array_to_string({O.ids('annotation')}, '|') AS ids, len({O.ids('annotation')})::INTEGER AS n FROM sentences")
def annotation_ids(t):
    return t.sentences.select("row_id", _bar(A.annotation_ids("annotation")).alias("ids"), F.size(A.annotation_ids("annotation")).alias("n"))


@query(f"SELECT row_id, array_to_string(list_transform({O.skeleton('annotation')}, lambda x: array_to_string(x, '|')), '/') AS shape FROM sentences")
def skeleton(t):
    return t.sentences.select("row_id", F.array_join(F.transform(A.skeleton("annotation"), _bar), "/").alias("shape"))


@query(f"SELECT row_id, {O.alignment_error('s', 'a')} AS error FROM (SELECT row_id, {O.skeleton('segmented')} AS s, {O.skeleton('annotation')} AS a FROM sentences)")
def alignment_error(t):
    return t.sentences.select("row_id", A.alignment_error("segmented", "annotation").alias("error"))


@query(f"SELECT row_id, {O.surface('segmented')} AS surface, array_to_string({O.offsets('segmented')}, '|') AS offsets FROM sentences")
def boundary_offsets(t):
    return t.sentences.select("row_id", A.surface("segmented").alias("surface"), _bar(A.boundary_offsets("segmented").cast("array<string>")).alias("offsets"))


@query(f"SELECT row_id, array_to_string({O.first_seen('x')}, '|') AS surfaces FROM (SELECT row_id, list_filter(flatten({O.skeleton('segmented')}), lambda v: v <> '') AS x FROM sentences)")
def morph_surfaces(t):
    return t.sentences.select("row_id", _bar(A.morph_surfaces("segmented")).alias("surfaces"))


#: One row per sentence, its latest export.
_LATEST = "latest AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY sentence_id ORDER BY ingested_at DESC, row_id DESC) AS rn FROM sentences) WHERE rn = 1)"
_PAIRS = f"""{_LATEST},
    fit AS (SELECT *, {O.skeleton('segmented')} AS s, {O.skeleton('annotation')} AS a FROM latest WHERE NOT {O.blank('segmented')} AND NOT {O.blank('annotation')}),
    zipped AS (SELECT sentence_id, dialect_id, unnest(range(len(s))) AS phrase_no, unnest(s) AS ps, unnest(a) AS pa FROM fit WHERE {O.alignment_error('s', 'a')} IS NULL),
    pairs AS (SELECT sentence_id, dialect_id, phrase_no, unnest(range(len(ps))) AS segment_no, unnest(ps) AS surface, unnest(pa) AS label FROM zipped)"""
_TOKENS = f"""{_LATEST},
    ph AS (SELECT sentence_id, dataset_id, dialect_id, NOT {O.blank('translation_jp')} AS translated, unnest({O.phrases('annotation')}) AS phrase FROM latest),
    tokens AS (SELECT *, unnest({O.ids('phrase')}) AS id FROM ph)"""


def _latest(t):
    return evidence.one_per_sentence(t.sentences)


def _pairs(t, *keep):
    return evidence.segment_pairs(_latest(t), *keep)


@query(f"WITH {_PAIRS} SELECT sentence_id, phrase_no::INTEGER AS phrase_no, segment_no::INTEGER AS segment_no, surface, label FROM pairs")
def segment_zip(t):
    return _pairs(t)


@query(
    f"""WITH {_PAIRS} SELECT sentence_id, phrase_no::INTEGER AS phrase_no, segment_no::INTEGER AS segment_no, surface, label, coalesce(lag(surface) OVER w, '') AS previous_surface,
    coalesce(lead(label) OVER w, '<EOS>') AS next_label, segment_no = 0 AS phrase_start FROM pairs WINDOW w AS (PARTITION BY sentence_id, phrase_no ORDER BY segment_no)"""
)
def context_lag_lead(t):
    return evidence.in_context(_pairs(t))


@query(
    r"""WITH u AS (SELECT row_id, list_transform(string_split(regexp_replace(coalesce(segmented, ''), '(.)(:)', 'Q_\2 \1', 'g'), ' '), lambda v: v) AS x FROM sentences)
    SELECT row_id, array_to_string(list_transform(x, lambda v, i: CASE WHEN NOT starts_with(v, 'Q_') THEN v WHEN coalesce(x[i + 1], '') = '' OR substring(x[i + 1], 1, 1) IN ('a', 'i', 'u', 'e', 'o', 'ɿ', 'ə', 'ː') THEN v
        WHEN starts_with(x[i + 1], 'ts') OR starts_with(x[i + 1], 'tʃ') THEN 't' WHEN starts_with(x[i + 1], 'dz') OR starts_with(x[i + 1], 'dʒ') THEN 'd' ELSE substring(x[i + 1], 1, 1) END), '') AS compact FROM u"""
)
def compact_units(t):
    units = F.split(F.regexp_replace(F.coalesce("segmented", F.lit("")), "(.)(:)", "Q_$2 $1"), " ")
    return t.sentences.select("row_id", units.alias("u")).select("row_id", A.compact_units("u").alias("compact"))


@query(
    f"""SELECT row_id, trim(regexp_replace(CASE WHEN r = '' THEN q ELSE replace(q, r, ' ') END, '[\\s\\p{{Z}}]+', ' ', 'g'), ' 、,，・') AS query FROM (SELECT row_id, {O.strip("coalesce(dialect_region, '')")} AS r,
    replace(replace(replace(replace(replace(replace(regexp_replace({O.strip("coalesce(translation_jp, '')")}, '[\\s\\p{{Z}}]+', ' ', 'g'), '方言', ' '), '琉球', ' '), '琉球語', ' '), '琉球諸語', ' '), 'Miyako', ' '), 'miyako', ' ') AS q FROM sentences)"""
)
def sanitize_query(t):
    return t.sentences.select("row_id", A.sanitize_query("translation_jp", "dialect_region").alias("query"))


@query(f"SELECT row_id, contains(query, ' ') AS compound FROM ({ORACLES['sanitize_query']})")
def compound_query(t):
    return t.sentences.select("row_id", A.compound_query("translation_jp", "dialect_region").alias("compound"))


@query(
    f"""WITH p AS (SELECT row_id, {O.strip("coalesce(annotation, '')")} AS x FROM sentences), s AS (SELECT row_id, x, string_split(x, '-') AS parts FROM p)
    SELECT row_id, x = '' OR length(x) > 256 OR len(parts) > 8 OR len(list_filter(parts, lambda p: len(list_filter(string_split(p, ';'), lambda a: {O.strip('a')} <> '')) NOT BETWEEN 1 AND 8)) > 0 AS rejected FROM s"""
)
def expression_guard(t):
    return t.sentences.select("row_id", A.expression_rejected("annotation").alias("rejected"))


@query("SELECT row_id, CASE WHEN length(translation_jp) > 12 THEN substring(translation_jp, 1, 12) || '…' ELSE translation_jp END AS clipped FROM sentences")
def clip_project(t):
    return t.sentences.select("row_id", A.clip("translation_jp", 12).alias("clipped"))


_KEY = "trim(regexp_replace(lower(coalesce({0}, '')), '[^a-z0-9]+', '_', 'g'), '_')"
_ENGLISH = "CASE WHEN regexp_matches({0}, '^[0-9]') THEN 'grammar_' || {0} ELSE {0} END"


@query(f"SELECT form_row_id, {_ENGLISH.format('k')} AS english_key FROM (SELECT form_row_id, {_KEY.format('surface')} AS k FROM surface_forms_for_id)")
def english_key(t):
    return t.surface_forms_for_id.select("form_row_id", A.english_key("surface").alias("english_key"))


@query(
    f"""WITH k AS (SELECT form_row_id, {_KEY.format('surface')} AS a, {_KEY.format('dialect_name')} AS b FROM surface_forms_for_id), e AS (SELECT form_row_id, {_ENGLISH.format('a')} AS a, '_' || {_ENGLISH.format('b')} AS b FROM k),
    s AS (SELECT form_row_id, rtrim(substring(a, 1, greatest(20 - length(b), 0)), '_') AS a, b FROM e) SELECT form_row_id, CASE WHEN a <> '' AND length(b) > 1 THEN a || b END AS scoped_name FROM s"""
)
def scoped_name(t):
    return t.surface_forms_for_id.select("form_row_id", A.scoped_name("surface", "dialect_name", 20).alias("scoped_name"))


@query(f"SELECT form_row_id, CASE WHEN length(s) > 255 OR regexp_matches(s, '[\\s\\p{{Z}}\\-]') THEN '' ELSE s END AS surface FROM (SELECT form_row_id, {O.strip("coalesce(surface, '')")} AS s FROM surface_forms_for_id)")
def single_surface(t):
    return t.surface_forms_for_id.select("form_row_id", A.single_surface("surface").alias("surface"))


@query(f"SELECT form_row_id, s <> '' AND length(s) <= 128 AND NOT regexp_matches(s, '[\\s\\p{{Z}}]') AS groundable FROM (SELECT form_row_id, {O.strip("coalesce(label, '')")} AS s FROM surface_forms_for_id)")
def grounding_labels(t):
    return t.surface_forms_for_id.select("form_row_id", A.groundable("label").alias("groundable"))


@query("SELECT row_id, array_to_string(list_filter([dialect_id, dataset_id, annotation_schema_id], lambda v, i: v > 0 AND list_position([dialect_id, dataset_id, annotation_schema_id], v) = i), '|') AS ids FROM sentences")
def positive_ids(t):
    packed = F.concat_ws(", ", F.col("dialect_id").cast("string"), F.lit("x"), F.lit("-3"), F.col("dataset_id").cast("string"), F.col("annotation_schema_id").cast("string"), F.col("dialect_id").cast("string"))
    return t.sentences.select("row_id", _bar(A.positive_ids(packed).cast("array<string>")).alias("ids"))


@query("SELECT result_id, greatest(0, least(1, coalesce(confidence, 0)))::DOUBLE AS confidence FROM job_results")
def bounded_confidence(t):
    return t.job_results.select("result_id", A.bounded("confidence").alias("confidence"))


# Evaluation

_IDPAIRS = f"scored AS (SELECT result_id, job_id, {O.ids('gold_annotation')} AS g, {O.ids('ai_annotation')} AS p FROM job_results WHERE coalesce(gold_annotation, '') <> '')"
_ALIGNED = f"""{_IDPAIRS}, uneven AS (SELECT result_id AS k, g, p FROM scored WHERE g <> p),
    a AS (SELECT result_id, job_id, len(g) AS gold_ids, len(p) AS predicted_ids, coalesce(o, []) AS o FROM scored LEFT JOIN {O.alignments('uneven')} ON k = result_id),
    b AS (SELECT *, len(list_filter(o, lambda e: starts_with(e, '<extra>→'))) AS insertions, len(list_filter(o, lambda e: ends_with(e, '→<missing>'))) AS deletions, len(o) AS edits FROM a),
    c AS (SELECT *, edits - insertions - deletions AS substitutions, gold_ids - edits + insertions AS matches FROM b)"""


@query(
    f"""WITH {_ALIGNED} SELECT result_id, matches::INTEGER AS matches, substitutions::INTEGER AS substitutions, insertions::INTEGER AS insertions, deletions::INTEGER AS deletions, edits::INTEGER AS edits, gold_ids::INTEGER AS gold_ids, predicted_ids::INTEGER AS predicted_ids,
    edits = 0 AS exact, CASE WHEN greatest(gold_ids, predicted_ids) = 0 THEN 1 ELSE round(matches / greatest(gold_ids, predicted_ids), 6) END::DOUBLE AS id_match_rate,
    CASE WHEN gold_ids > 0 THEN round(edits / gold_ids, 6) WHEN predicted_ids = 0 THEN 0 ELSE 1 END::DOUBLE AS id_error_rate, array_to_string(o, ' ') AS errors FROM c"""
)
def align_ids(t):
    return evaluation.alignment_rows(t.job_results, "result_id")


@query(f"WITH {_ALIGNED}, e AS (SELECT unnest(o) AS e FROM c) SELECT string_split(e, '→')[1] AS gold, string_split(e, '→')[2] AS predicted, count(*) AS n FROM e GROUP BY ALL")
def confusion_matrix(t):
    return evaluation.confusion_matrix(t.job_results)


@query(
    f"""WITH {_ALIGNED}, s AS (SELECT job_id, count(*) AS scored, count(*) FILTER (edits = 0) AS exact_matches, sum(gold_ids)::BIGINT AS gold_ids, sum(predicted_ids)::BIGINT AS predicted_ids, sum(matches)::BIGINT AS matches, sum(substitutions)::BIGINT AS substitutions,
        sum(insertions)::BIGINT AS insertions, sum(deletions)::BIGINT AS deletions, sum(edits)::BIGINT AS edits FROM c GROUP BY 1)
    SELECT *, round(exact_matches / scored, 6) AS exact_accuracy, round(matches / nullif(greatest(gold_ids, predicted_ids), 0), 6) AS id_match_rate, round(edits / nullif(gold_ids, 0), 6) AS id_error_rate FROM s"""
)
def job_annotation_metrics(t):
    return evaluation.annotation_metrics(t.job_results, ["job_id"])


@query(f"WITH {_IDPAIRS}, src AS (SELECT result_id AS k, g AS x, p AS y FROM scored) SELECT k AS result_id, edits::INTEGER AS edits FROM {O.distances('src')}")
def token_edit_distance(t):
    rows = t.job_results.where(F.coalesce("gold_annotation", F.lit("")) != "")
    return rows.select("result_id", edit_distance(A.annotation_ids("gold_annotation"), A.annotation_ids("ai_annotation")).alias("edits"))


_BOUNDS = f"""b AS (SELECT result_id, job_id, {O.surface('ai_segmented')} = {O.surface('gold_segmented')} AS surface_match, {O.offsets('ai_segmented')} AS p, {O.offsets('gold_segmented')} AS g FROM job_results WHERE coalesce(gold_segmented, '') <> ''),
    c AS (SELECT result_id, job_id, surface_match, len(g)::INTEGER AS gold_boundaries, len(p)::INTEGER AS predicted_boundaries, CASE WHEN surface_match THEN len(list_intersect(p, g)) ELSE 0 END::INTEGER AS correct FROM b),
    d AS (SELECT *, predicted_boundaries - correct AS false_positive, gold_boundaries - correct AS false_negative FROM c)"""


@query(
    f"""WITH {_BOUNDS}, r AS (SELECT *, CASE WHEN predicted_boundaries > 0 THEN correct / predicted_boundaries WHEN gold_boundaries = 0 THEN 1 ELSE 0 END AS p, CASE WHEN gold_boundaries > 0 THEN correct / gold_boundaries ELSE 1 END AS q FROM d)
    SELECT result_id, surface_match, surface_match AND false_positive = 0 AND false_negative = 0 AS exact, gold_boundaries, predicted_boundaries, correct, false_positive, false_negative, round(p, 6)::DOUBLE AS precision, round(q, 6)::DOUBLE AS recall,
    coalesce(round(2 * p * q / nullif(p + q, 0), 6), 0)::DOUBLE AS f1 FROM r"""
)
def segmentation_metrics(t):
    return evaluation.segmentation_rows(t.job_results, ["result_id"])


@query(
    f"""WITH {_BOUNDS}, s AS (SELECT job_id, count(*) AS scored, count(*) FILTER (surface_match AND false_positive = 0 AND false_negative = 0) AS exact_matches, count(*) FILTER (NOT surface_match) AS surface_mismatches,
        sum(gold_boundaries)::BIGINT AS gold_boundaries, sum(predicted_boundaries)::BIGINT AS predicted_boundaries, sum(correct)::BIGINT AS correct, sum(false_positive)::BIGINT AS false_positive, sum(false_negative)::BIGINT AS false_negative FROM d GROUP BY 1),
    r AS (SELECT *, correct / nullif(correct + false_positive, 0) AS p, correct / nullif(correct + false_negative, 0) AS q FROM s)
    SELECT * EXCLUDE (p, q), round(p, 6) AS precision, round(q, 6) AS recall, round(2 * p * q / nullif(p + q, 0), 6) AS f1 FROM r"""
)
def job_segmentation_metrics(t):
    return evaluation.segmentation_metrics(t.job_results, ["job_id"])


# N-best lists: the attempts at a sentence

_UNITS = r"list_filter(regexp_split_to_array({0}, '[\s\p{{Z}}\-]+'), lambda u: u <> '')"
_LISTS = f"""lists AS (SELECT sentence_id, row_number() OVER (PARTITION BY sentence_id ORDER BY finished_at DESC NULLS LAST, result_id DESC) AS rank, {_UNITS.format('ai_segmented')} AS units, confidence, {_UNITS.format('gold_segmented')} AS ref,
    len(list_filter({O.ids('ai_annotation')}, lambda t: t = '?')) AS alerts, coalesce(decision = 'failed', false) AS failed FROM job_results WHERE NOT {O.blank('ai_segmented')} AND NOT {O.blank('gold_segmented')})"""
_BASELINE = "baseline AS (SELECT sentence_id, rank AS baseline_rank FROM (SELECT *, row_number() OVER (PARTITION BY sentence_id ORDER BY failed, CASE WHEN failed THEN 0 ELSE alerts END, CASE WHEN failed THEN 0 ELSE -coalesce(confidence, 0) END, rank) AS rn FROM lists) WHERE rn = 1)"
_SCORED = f"""src AS (SELECT sentence_id || ':' || rank AS k, ref AS x, units AS y FROM lists),
    scored AS (SELECT sentence_id, rank, edits, len(ref) AS ref_units FROM lists JOIN {O.distances('src')} ON k = sentence_id || ':' || rank)"""
_ORACLE = """best AS (SELECT sentence_id, min(rank) AS top1_rank, arg_min(edits, rank) AS top1_edits, min(edits) AS oracle_edits, max(ref_units) AS ref_units FROM scored GROUP BY 1),
    oracle AS (SELECT b.*, min(rank) AS oracle_rank FROM best b JOIN scored s ON s.sentence_id = b.sentence_id AND s.edits = b.oracle_edits GROUP BY ALL)"""


def _lists(t):
    return evaluation.attempts_as_lists(t.job_results).withColumn("score", F.lit(None).cast("double"))


def _scored(t):
    return evaluation.scored_lists(_lists(t).select("sentence_id", "rank", "units", "ref"), None, "sentence_id")


@query(f"WITH {_LISTS} SELECT sentence_id, rank::INTEGER AS rank, array_to_string(units, ' ') AS units, round(confidence, 6) AS combined_score FROM lists")
def nbest_explode(t):
    h = F.struct("rank", "units", F.round("confidence", 6).alias("combined_score"))
    packed = _lists(t).groupBy("sentence_id").agg(F.to_json(F.collect_list(h)).alias("nbest_json"))
    return evaluation.explode_nbest(packed, "sentence_id").withColumn("units", F.array_join("units", " "))


@query(f"WITH {_LISTS}, {_BASELINE} SELECT sentence_id, baseline_rank::INTEGER AS baseline_rank FROM baseline")
def nbest_baseline(t):
    return evaluation.best_hypothesis(_lists(t), "sentence_id")


@query(f"WITH {_LISTS}, {_SCORED}, {_ORACLE} SELECT sentence_id, top1_rank::INTEGER AS top1_rank, top1_edits::INTEGER AS top1_edits, oracle_rank::INTEGER AS oracle_rank, oracle_edits::INTEGER AS oracle_edits, ref_units::INTEGER AS ref_units FROM oracle")
def nbest_oracle(t):
    return evaluation.oracle_hypothesis(_scored(t), "sentence_id")


@query(
    f"""WITH {_LISTS}, {_BASELINE}, {_SCORED}, {_ORACLE}, r AS (SELECT o.*, baseline_rank, s.edits AS baseline_edits FROM oracle o JOIN baseline b USING (sentence_id) JOIN scored s ON s.sentence_id = o.sentence_id AND s.rank = b.baseline_rank),
    a AS (SELECT count(*) AS lists, sum(ref_units)::BIGINT AS ref_units, sum(top1_edits)::BIGINT AS top1_edits, sum(baseline_edits)::BIGINT AS baseline_edits, sum(oracle_edits)::BIGINT AS oracle_edits, count(*) FILTER (baseline_rank = top1_rank) AS retained,
        count(*) FILTER (baseline_edits < top1_edits) AS improved, count(*) FILTER (baseline_edits > top1_edits) AS harmed, count(*) FILTER (baseline_rank = oracle_rank) AS oracle_selected FROM r)
    SELECT *, round(top1_edits / ref_units, 6) AS top1_uer, round(baseline_edits / ref_units, 6) AS baseline_uer, round(oracle_edits / ref_units, 6) AS oracle_uer, round((top1_edits - baseline_edits) / nullif(top1_edits - oracle_edits, 0), 6) AS headroom_recovered FROM a"""
)
def asr_uer_summary(t):
    return evaluation.error_summary(_scored(t), evaluation.best_hypothesis(_lists(t), "sentence_id"), "sentence_id")


@query(
    f"""WITH {_LISTS}, {_BASELINE}, {_SCORED}, {_ORACLE}, agent AS (SELECT sentence_id, rank AS agent_rank FROM (SELECT *, row_number() OVER (PARTITION BY sentence_id ORDER BY coalesce(confidence, -1) DESC, rank) AS rn FROM lists) WHERE rn = 1),
    r AS (SELECT o.*, baseline_rank, agent_rank, s.edits AS baseline_edits, g.edits AS agent_edits FROM oracle o JOIN baseline b USING (sentence_id) JOIN agent a USING (sentence_id) JOIN scored s ON s.sentence_id = o.sentence_id AND s.rank = b.baseline_rank JOIN scored g ON g.sentence_id = o.sentence_id AND g.rank = a.agent_rank),
    t AS (SELECT count(*) AS lists, sum(ref_units)::BIGINT AS ref_units, sum(top1_edits)::BIGINT AS top1_edits, sum(baseline_edits)::BIGINT AS baseline_edits, sum(agent_edits)::BIGINT AS agent_edits, sum(oracle_edits)::BIGINT AS oracle_edits, count(*) FILTER (agent_rank = top1_rank) AS rank1_retained,
        count(*) FILTER (agent_rank <> top1_rank) AS agent_changed, count(*) FILTER (agent_edits < top1_edits) AS improved, count(*) FILTER (agent_edits > top1_edits) AS harmful, count(*) FILTER (agent_edits = top1_edits) AS neutral, count(*) FILTER (agent_rank = oracle_rank) AS oracle_selected FROM r)
    SELECT *, round(top1_edits / ref_units, 6) AS top1_uer, round(baseline_edits / ref_units, 6) AS baseline_uer, round(agent_edits / ref_units, 6) AS agent_uer, round(oracle_edits / ref_units, 6) AS oracle_uer,
        round((top1_edits - baseline_edits) / nullif(top1_edits - oracle_edits, 0), 6) AS baseline_headroom_recovered, round((top1_edits - agent_edits) / nullif(top1_edits - oracle_edits, 0), 6) AS agent_headroom_recovered FROM t"""
)
def asr_agent_summary(t):
    """The attempt of the highest confidence as the agent's choice."""
    lists = _lists(t)
    return evaluation.selection_summary(_scored(t), evaluation.best_hypothesis(lists, "sentence_id"), evaluation.chosen_hypothesis(lists, "sentence_id"), "sentence_id")


# Evidence


@query(f"WITH {_TOKENS} SELECT id, count(*) AS tokens, count(*) FILTER (translated) AS translated_tokens, count(DISTINCT sentence_id) AS sentences, count(DISTINCT dataset_id) AS datasets, count(DISTINCT dialect_id) AS dialects FROM tokens GROUP BY 1")
def evidence_summary(t):
    return evidence.summary(_latest(t))


@query(f"WITH {_TOKENS} SELECT id, phrase, count(*) AS tokens FROM tokens GROUP BY ALL HAVING count(*) >= 2")
def phrase_patterns(t):
    return evidence.phrase_patterns(_latest(t))


def _gram_sql(n):
    names = [f"x[{i + 1}] AS token_{i + 1}" for i in range(n)]
    return f"""WITH {_LATEST}, p AS (SELECT unnest({O.phrases('annotation')}) AS phrase FROM latest), i AS (SELECT {O.ids('phrase')} AS ids FROM p),
        g AS (SELECT unnest(list_transform(range(1, len(ids) - {n - 2}), lambda i: ids[i:i + {n - 1}])) AS x FROM i WHERE len(ids) >= {n}) SELECT {', '.join(names)}, count(*) AS tokens FROM g GROUP BY ALL HAVING count(*) >= 3"""


@query(_gram_sql(2))
def anchored_bigrams(t):
    return evidence.ngrams(_latest(t), 2)


@query(_gram_sql(3))
def anchored_trigrams(t):
    return evidence.ngrams(_latest(t), 3)


@query(
    f"""WITH {_PAIRS}, c AS (SELECT surface, label, count(*) AS corpus_count FROM pairs GROUP BY ALL), l AS (SELECT form2 AS surface, annotation AS label, count(*) AS lexicon_count FROM provider_lexemes WHERE form2 IS NOT NULL AND annotation IS NOT NULL GROUP BY ALL),
    b AS (SELECT surface, label, coalesce(corpus_count, 0) AS corpus_count, coalesce(lexicon_count, 0) AS lexicon_count, coalesce(corpus_count, 0) + coalesce(lexicon_count, 0) AS candidate_count FROM c FULL JOIN l USING (surface, label)),
    d AS (SELECT *, (sum(candidate_count) OVER w)::BIGINT AS surface_total, count(*) OVER w AS alternatives FROM b WINDOW w AS (PARTITION BY surface))
    SELECT *, round(candidate_count / surface_total, 6) AS candidate_rate, CASE WHEN surface_total >= 5 AND candidate_count * 10 < surface_total THEN 'weak' ELSE 'none' END AS penalty FROM d"""
)
def form_support(t):
    return evidence.form_support(_pairs(t), t.provider_lexemes)


@query(
    f"""WITH {_PAIRS}, own AS (SELECT sentence_id, dialect_region AS region FROM latest), c AS (SELECT region, surface, label, count(*) AS n FROM (SELECT region, surface, label FROM pairs JOIN own USING (sentence_id) UNION ALL SELECT region, form2, annotation FROM provider_lexemes WHERE annotation IS NOT NULL) WHERE region IS NOT NULL AND surface IS NOT NULL GROUP BY ALL),
    s AS (SELECT region, surface, sum(n)::BIGINT AS t FROM c GROUP BY ALL), jf AS (SELECT result_id, sentence_id, {O.skeleton('ai_segmented')} AS s, {O.skeleton('ai_annotation')} AS a FROM job_results WHERE NOT {O.blank('ai_segmented')} AND NOT {O.blank('ai_annotation')}),
    jz AS (SELECT result_id, sentence_id, unnest(s) AS ps, unnest(a) AS pa FROM jf WHERE {O.alignment_error('s', 'a')} IS NULL), jp AS (SELECT DISTINCT result_id, sentence_id, unnest(ps) AS surface, unnest(pa) AS label FROM jz),
    r AS (SELECT result_id, jp.surface, jp.label, own.region, coalesce(c.n, 0) AS candidate_count, coalesce(s.t, 0) AS surface_total FROM jp JOIN own USING (sentence_id) LEFT JOIN s ON s.region = own.region AND s.surface = jp.surface LEFT JOIN c ON c.region = own.region AND c.surface = jp.surface AND c.label = jp.label)
    SELECT *, round(candidate_count / nullif(surface_total, 0), 6) AS candidate_rate, CASE WHEN surface_total >= 5 AND candidate_count = 0 THEN 'strong' WHEN surface_total >= 5 AND candidate_count * 10 < surface_total THEN 'weak' ELSE 'none' END AS penalty FROM r"""
)
def proposal_support(t):
    latest = _latest(t)
    results = t.job_results.select(F.col("result_id"), "sentence_id").join(latest.select("sentence_id", F.col("dialect_region").alias("region")), "sentence_id").drop("sentence_id")
    proposed = _result_pairs(t).select("result_id", "surface", "label").distinct().join(results, "result_id")
    return evidence.proposal_support(proposed, evidence.segment_pairs(latest, "dialect_region"), t.provider_lexemes).select("result_id", "surface", "label", "region", "candidate_count", "surface_total", "candidate_rate", "penalty")


@query("SELECT coalesce(pos, '') AS pos, count(DISTINCT lexeme_id) AS lexemes FROM provider_lexemes GROUP BY 1")
def pos_counts(t):
    return t.provider_lexemes.groupBy(F.coalesce("pos", F.lit("")).alias("pos")).agg(F.count_distinct("lexeme_id").alias("lexemes"))


@query(f"WITH {_PAIRS} SELECT surface, string_agg(label, '|' ORDER BY label) AS labels, count(*) AS n_labels FROM (SELECT DISTINCT surface, label FROM pairs) GROUP BY 1")
def surface_label_sets(t):
    return evidence.label_sets(_pairs(t))


@query(
    f"""WITH {_LATEST}, e AS (SELECT DISTINCT {O.strip('annotation')} AS x FROM provider_lexemes WHERE NOT {O.blank('annotation')}), k AS (SELECT x, string_split(x, '-') AS parts FROM e WHERE length(x) <= 256 AND len(string_split(x, '-')) <= 8
        AND len(list_filter(string_split(x, '-'), lambda p: len(list_filter(string_split(p, ';'), lambda a: {O.strip('a')} <> '')) NOT BETWEEN 1 AND 8)) = 0), p AS (SELECT sentence_id, unnest({O.skeleton('annotation')}) AS s FROM latest),
    r AS (SELECT DISTINCT sentence_id, unnest(flatten(list_transform(range(1, 9), lambda n: list_transform(range(1, len(s) - n + 2), lambda i: array_to_string(s[i:i + n - 1], '-'))))) AS x FROM p),
    f AS (SELECT x AS expression, sentence_id, row_number() OVER (PARTITION BY x ORDER BY sentence_id) AS n FROM r SEMI JOIN k USING (x)) SELECT expression, sentence_id FROM f WHERE n <= 8"""
)
def corpus_pattern_search(t):
    """Whole segments only, as its SQL; `corpus_atom_search` finds atoms of conflated segments too."""
    return evidence.pattern_search(_latest(t), t.provider_lexemes.select(F.col("annotation").alias("expression")), atoms=False)


@query(
    f"""WITH {_LATEST}, e AS (SELECT DISTINCT {O.strip('annotation')} AS x FROM provider_lexemes WHERE NOT {O.blank('annotation')}), k AS (SELECT x, string_split(x, '-') AS parts FROM e WHERE length(x) <= 256 AND len(string_split(x, '-')) <= 8
        AND len(list_filter(string_split(x, '-'), lambda p: len(list_filter(string_split(p, ';'), lambda a: {O.strip('a')} <> '')) NOT BETWEEN 1 AND 8)) = 0), p AS (SELECT sentence_id, unnest({O.skeleton('annotation')}) AS s FROM latest),
    r AS (SELECT DISTINCT sentence_id, unnest(flatten(list_transform(range(1, 9), lambda n: list_transform(range(1, len(s) - n + 2), lambda i: array_to_string(s[i:i + n - 1], '-')))) || flatten(list_transform(s, lambda v: string_split(v, ';')))) AS x FROM p),
    f AS (SELECT x AS expression, sentence_id, row_number() OVER (PARTITION BY x ORDER BY sentence_id) AS n FROM r SEMI JOIN k USING (x)) SELECT expression, sentence_id FROM f WHERE n <= 8"""
)
def corpus_atom_search(t):
    return evidence.pattern_search(_latest(t), t.provider_lexemes.select(F.col("annotation").alias("expression")))


@query(f"WITH {_TOKENS} SELECT DISTINCT sentence_id, id, lexeme_id FROM tokens JOIN provider_lexemes l ON l.annotation = tokens.id AND (l.dialect_id IS NULL OR l.dialect_id = tokens.dialect_id)")
def trigger_join(t):
    rows = t.provider_lexemes.select(F.col("annotation").alias("id"), F.col("dialect_id").alias("d"), "lexeme_id").where("id is not null")
    return evidence.tokens(_latest(t), "dialect_id").join(rows, "id").where("d is null or d = dialect_id").select("sentence_id", "id", "lexeme_id").distinct()


@query(
    f"""WITH {_TOKENS}, o AS (SELECT id, phrase, max(translated::INTEGER) AS tr FROM tokens GROUP BY ALL), q AS (SELECT o.id, o.phrase, tr = 1 AS translated, min(sentence_id) AS sentence_id FROM o JOIN tokens t ON t.id = o.id AND t.phrase = o.phrase AND t.translated = (tr = 1) GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY translated DESC, sentence_id, phrase) AS n FROM q) SELECT id, phrase, translated, sentence_id FROM r WHERE n <= 6"""
)
def topk_examples(t):
    return evidence.examples(_latest(t))


@query(f"WITH {_LATEST}, r AS (SELECT dataset_id, sentence_id, row_number() OVER (PARTITION BY dataset_id ORDER BY md5(sentence_id || ':7'), sentence_id) AS n FROM latest) SELECT dataset_id, sentence_id FROM r WHERE n <= 5")
def seeded_sample(t):
    return evidence.seeded_sample(_latest(t).select("dataset_id", "sentence_id"), ["dataset_id"], "sentence_id", 5, 7)


@query(
    """WITH f AS (SELECT *, max((dialect_id IS NOT DISTINCT FROM 17)::INTEGER) OVER (PARTITION BY label) AS own FROM surface_forms_for_id)
    SELECT form_row_id, label, surface, CASE WHEN dialect_id IS NOT DISTINCT FROM 17 THEN 'requested_dialect' ELSE 'same_region' END AS scope FROM f WHERE dialect_id IS NOT DISTINCT FROM 17 OR ((own = 0 OR label IS NULL) AND dialect_region = '白瀬')"""
)
def dialect_fallback(t):
    return evidence.dialect_fallback(t.surface_forms_for_id, 17, "白瀬").select("form_row_id", "label", "surface", "scope")


@query(
    """WITH p AS (SELECT label, dialect_id, form_source, row_number() OVER (PARTITION BY label ORDER BY CASE WHEN form_source = 'corpus' THEN 0 ELSE 1 END, list_position([17, 57, 28], dialect_id)) AS n FROM surface_forms_for_id WHERE dialect_id IN (17, 57, 28))
    SELECT l.label, coalesce(dialect_id, -1)::INTEGER AS dialect_id, CASE WHEN dialect_id IS NULL THEN 'none' WHEN form_source = 'corpus' THEN 'requested_dialect' ELSE 'schema_pool' END AS scope FROM (SELECT DISTINCT label FROM surface_forms_for_id WHERE label IS NOT NULL) l LEFT JOIN p ON p.label = l.label AND n = 1"""
)
def priority_pick(t):
    return evidence.preferred(t.surface_forms_for_id, [17, 57, 28])


@query(
    f"""WITH {_LATEST}, c AS (SELECT dialect_region, dialect_id, count(DISTINCT sentence_id) AS n FROM latest WHERE dialect_region IS NOT NULL AND dialect_id IS NOT NULL GROUP BY ALL)
    SELECT dialect_region, string_agg(dialect_id, ',' ORDER BY n DESC, dialect_id) AS dialects, (list(dialect_id ORDER BY n DESC, dialect_id))[1] AS representative FROM c GROUP BY 1"""
)
def region_dialects(t):
    return evidence.region_dialects(_latest(t))


@query(
    f"""WITH {_TOKENS}, o AS (SELECT id, phrase, max(translated::INTEGER) AS tr FROM tokens GROUP BY ALL), q AS (SELECT o.id, o.phrase, tr = 1 AS translated, min(sentence_id) AS sentence_id FROM o JOIN tokens t ON t.id = o.id AND t.phrase = o.phrase AND t.translated = (tr = 1) GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY translated DESC, sentence_id, phrase) AS n FROM q)
    SELECT id, string_agg('例（文訳）: ' || coalesce(text, '') || ' [' || phrase || '] → ' || coalesce(translation_jp, ''), chr(10) ORDER BY n) AS note FROM r JOIN latest USING (sentence_id) WHERE n <= 3 GROUP BY 1"""
)
def example_notes(t):
    return evidence.notes(_latest(t))


_EXPRESSIONS = f"""e AS (SELECT DISTINCT {O.strip('annotation')} AS x FROM provider_lexemes WHERE NOT {O.blank('annotation')}), k AS (SELECT x, string_split(x, '-') AS parts FROM e WHERE length(x) <= 256 AND len(string_split(x, '-')) <= 8
        AND len(list_filter(string_split(x, '-'), lambda p: len(list_filter(string_split(p, ';'), lambda a: {O.strip('a')} <> '')) NOT BETWEEN 1 AND 8)) = 0)"""


@query(
    f"""WITH {_LATEST}, {_EXPRESSIONS}, p AS (SELECT sentence_id, flatten({O.skeleton('annotation')}) AS s FROM latest ANTI JOIN (SELECT sentence_id FROM job_results WHERE decision = 'failed') x USING (sentence_id)),
    r AS (SELECT DISTINCT sentence_id, unnest(flatten(list_transform(range(1, 9), lambda n: list_transform(range(1, len(s) - n + 2), lambda i: array_to_string(s[i:i + n - 1], '-')))) || flatten(list_transform(s, lambda v: string_split(v, ';')))) AS x FROM p),
    f AS (SELECT x AS expression, sentence_id, row_number() OVER (PARTITION BY x ORDER BY sentence_id) AS n FROM r SEMI JOIN k USING (x)) SELECT expression, sentence_id FROM f WHERE n <= 8"""
)
def corpus_sequence_search(t):
    """Sequences from one phrase to the next too, in sentences that no job has failed on."""
    failed = t.job_results.where("decision = 'failed'").select("sentence_id")
    return evidence.pattern_search(_latest(t), t.provider_lexemes.select(F.col("annotation").alias("expression")), excluded=failed, across=True)


# Scopes

_ISLANDS = """i AS (SELECT DISTINCT dataset_id, sentence_id FROM {0} WHERE dataset_id > 0 AND sentence_id > 0), g AS (SELECT *, sentence_id - row_number() OVER (PARTITION BY dataset_id ORDER BY sentence_id) AS g FROM i),
    islands AS (SELECT dataset_id, min(sentence_id) AS first_id, max(sentence_id) AS last_id, count(*) AS n FROM g GROUP BY dataset_id, g)"""


@query(f"WITH {_ISLANDS.format('sentences')} SELECT * FROM islands")
def islands(t):
    return scopes.islands(t.sentences)


@query("SELECT row_id FROM sentences s WHERE NOT EXISTS (SELECT 1 FROM jobs j WHERE j.status = 'failed' AND j.dataset_id = s.dataset_id) AND NOT EXISTS (SELECT 1 FROM sentences h WHERE h.source_status = 'unannotated' AND h.dataset_id = s.dataset_id AND h.text_id = s.text_id)")
def exclusion_antijoin(t):
    return scopes.without_texts(t.sentences, t.jobs.where("status = 'failed'"), t.sentences.where("source_status = 'unannotated'")).select("row_id")


@query(
    f"""WITH held AS (SELECT s.dataset_id, s.sentence_id FROM sentences s SEMI JOIN job_results r ON r.sentence_id = s.sentence_id AND r.decision = 'failed'), {_ISLANDS.format('held')}
    SELECT row_id FROM sentences s WHERE NOT EXISTS (SELECT 1 FROM islands i WHERE i.dataset_id = s.dataset_id AND s.sentence_id BETWEEN i.first_id AND i.last_id)"""
)
def exclusion_range_antijoin(t):
    failed = t.job_results.where("decision = 'failed'").select("sentence_id").distinct()
    held = t.sentences.select("dataset_id", "sentence_id").join(failed, "sentence_id", "left_semi")
    return scopes.without_ranges(t.sentences.select("row_id", "dataset_id", "sentence_id"), scopes.islands(held)).select("row_id")


# Licensed forms

_LEX = f"lex AS (SELECT lexeme_id, region, dialect_id, {O.strip('form2')} AS surface, coalesce(nullif({O.strip('form2_seg')}, ''), {O.strip('form2')}) AS seg, {O.strip('annotation')} AS ann FROM provider_lexemes)"
_EXACT = f"""{_LATEST}, {_LEX}, w AS (SELECT DISTINCT sentence_id, dialect_region AS region, unnest(flatten({O.skeleton('segmented')})) AS surface FROM latest WHERE NOT {O.blank('segmented')}),
    exact AS (SELECT DISTINCT sentence_id, lexeme_id, surface FROM w JOIN lex USING (region, surface) WHERE surface <> '')"""


@query(f"WITH {_EXACT} SELECT * FROM exact")
def licensed_exact(t):
    return licensed.exact(_latest(t), t.provider_lexemes)


@query(
    f"""WITH {_LATEST}, f AS (SELECT DISTINCT lexeme_id, region, unnest([{O.strip('form2')}, replace({O.strip('form2_seg')}, '-', '')]) AS surface FROM provider_lexemes), w AS (SELECT DISTINCT sentence_id, dialect_region AS region, unnest(flatten({O.skeleton('segmented')})) AS surface FROM latest WHERE NOT {O.blank('segmented')})
    SELECT DISTINCT sentence_id, lexeme_id, surface FROM w JOIN f USING (region, surface) WHERE surface <> ''"""
)
def licensed_either_form(t):
    return licensed.exact(_latest(t), t.provider_lexemes, ["form2", "form2_seg"])


@query(
    f"""WITH {_LATEST}, f AS (SELECT DISTINCT lexeme_id, {O.strip('form2')} AS form FROM provider_lexemes WHERE length({O.strip('form2')}) >= 3), p AS (SELECT sentence_id, lexeme_id, form, list_filter(range(0, length(text) - length(form) + 1), lambda i: substring(text, i + 1, length(form)) = form) AS places
        FROM latest JOIN f ON contains(text, form)) SELECT sentence_id, lexeme_id, form, len(places)::BIGINT AS n_occurrences, places[1]::INTEGER AS first_at FROM p"""
)
def licensed_containment(t):
    return licensed.contained(_latest(t), t.provider_lexemes)


@query(f"WITH {_LEX} SELECT region, surface, count(DISTINCT (seg, ann)) AS analyses, count(DISTINCT lexeme_id) AS n_lexemes FROM lex WHERE surface <> '' AND ann <> '' GROUP BY ALL")
def licensed_ambiguity(t):
    return licensed.ambiguity(t.provider_lexemes)


@query(
    f"""WITH {_LATEST}, {_LEX}, one AS (SELECT dialect_id, surface, min(seg) AS seg, min(ann) AS ann FROM lex WHERE surface <> '' AND ann <> '' AND len(string_split(seg, '-')) = len(string_split(ann, '-')) GROUP BY ALL HAVING count(DISTINCT (seg, ann)) = 1),
    fit AS (SELECT sentence_id, dialect_id, {O.skeleton('segmented')} AS s, {O.skeleton('annotation')} AS a FROM latest WHERE NOT {O.blank('segmented')} AND NOT {O.blank('annotation')}),
    u AS (SELECT *, list_position(list_transform(a, lambda x: list_contains(x, '?')), true) AS i FROM fit WHERE {O.alignment_error('s', 'a')} IS NULL AND len(list_filter(flatten(a), lambda v: v = '?')) = 1),
    k AS (SELECT *, list_position(a[i], '?') AS k FROM u), f AS (SELECT sentence_id, s, a, i, k, one.seg, one.ann FROM k JOIN one ON one.dialect_id = k.dialect_id AND one.surface = s[i][k])
    SELECT sentence_id, array_to_string(list_transform(s, lambda x, n: array_to_string(CASE WHEN n = i THEN x[1:k - 1] || string_split(seg, '-') || x[k + 1:] ELSE x END, '-')), ' ') AS segmented,
    array_to_string(list_transform(a, lambda x, n: array_to_string(CASE WHEN n = i THEN x[1:k - 1] || string_split(ann, '-') || x[k + 1:] ELSE x END, '-')), ' ') AS annotation FROM f"""
)
def unknown_repair(t):
    return licensed.repaired(_latest(t), t.provider_lexemes)


@query(
    f"""WITH {_EXACT}, one AS (SELECT lexeme_id, max({{'seg': seg, 'ann': ann}}) AS l FROM lex GROUP BY 1), j AS (SELECT e.sentence_id, e.lexeme_id, {O.skeleton('segmented')} AS s, {O.skeleton('annotation')} AS a, string_split(l.seg, '-') AS ns, string_split(l.ann, '-') AS na
        FROM exact e JOIN one USING (lexeme_id) JOIN latest USING (sentence_id))
    SELECT sentence_id, lexeme_id FROM j WHERE NOT coalesce(len(ns) = len(na) AND len(list_filter(range(1, len(s) + 1), lambda i: len(list_filter(range(1, len(s[i]) - len(ns) + 2), lambda k: s[i][k:k + len(ns) - 1] = ns AND a[i][k:k + len(ns) - 1] = na)) > 0)) > 0, false)"""
)
def retrieved_except_applied(t):
    return licensed.unapplied(_latest(t), t.provider_lexemes)


# Proposals


@query("SELECT form_row_id, label, example_sentence_id FROM surface_forms_for_id f SEMI JOIN sentences s ON s.sentence_id = f.example_sentence_id")
def evidence_grounding(t):
    return proposals.grounded(t.surface_forms_for_id.select("form_row_id", "label", "example_sentence_id"), t.sentences, "example_sentence_id", "sentence_id")


@query("SELECT form_row_id, label, example_sentence_id FROM surface_forms_for_id f ANTI JOIN (SELECT * FROM sentences WHERE source_status = 'annotated') s ON s.sentence_id = f.example_sentence_id WHERE example_sentence_id IS NOT NULL")
def evidence_missing(t):
    return proposals.missing(t.surface_forms_for_id.select("form_row_id", "label", "example_sentence_id"), t.sentences.where("source_status = 'annotated'"), "example_sentence_id", "sentence_id")


@query(f"SELECT DISTINCT lexeme_id FROM provider_lexemes WHERE {O.strip('pos')} IN ('n', 'v')")
def provider_pos_join(t):
    return proposals.hosts(t.provider_lexemes, ["n", "v"]).select("lexeme_id")


_PROBES = f"""h AS (SELECT DISTINCT lexeme_id, dialect_id, {O.strip('form2')} AS form2, {O.strip('form2_seg')} AS form2_seg, {O.strip('annotation')} AS annotation FROM provider_lexemes WHERE {O.strip('pos')} IN ('n')),
    e AS (SELECT form_row_id, dialect_id, form_source, label, {O.strip('surface')} AS surface FROM surface_forms_for_id WHERE label IN ('akk', 'nom')),
    probes AS (SELECT lexeme_id, form_row_id, e.dialect_id, form_source, form2 || surface AS text, form2_seg || '-' || surface AS segmented, annotation || '-' || label AS annotation FROM h JOIN e ON e.dialect_id = h.dialect_id
        WHERE surface <> '' AND NOT regexp_matches(surface, '[\\s\\p{{Z}}\\-]') AND form2 <> '' AND form2_seg <> '' AND annotation <> '' AND NOT regexp_matches(form2 || form2_seg || annotation, '[\\s\\p{{Z}}]'))"""


def _probes(t):
    return proposals.probes(proposals.hosts(t.provider_lexemes, ["n"]), t.surface_forms_for_id.where(F.col("label").isin("akk", "nom")))


@query(f"WITH {_PROBES} SELECT lexeme_id, form_row_id, text, segmented, annotation FROM probes")
def probe_forms(t):
    return _probes(t).select("lexeme_id", "form_row_id", "text", "segmented", "annotation")


@query(
    f"""WITH {_PROBES}, c AS (SELECT *, form_source = 'corpus' AS attested, row_number() OVER (PARTITION BY dialect_id, form_source = 'corpus' ORDER BY lexeme_id, form_row_id) AS n FROM probes),
    q AS (SELECT dialect_id, least(count(*) FILTER (attested), CASE WHEN count(*) FILTER (NOT attested) > 0 THEN 8 ELSE 24 END) AS q FROM c GROUP BY 1)
    SELECT lexeme_id, form_row_id, dialect_id, attested FROM c JOIN q USING (dialect_id) WHERE n <= CASE WHEN attested THEN q ELSE 24 - q END"""
)
def probe_budget(t):
    rows = _probes(t).withColumn("attested", F.col("form_source") == "corpus").select("lexeme_id", "form_row_id", "dialect_id", "attested")
    return proposals.within_budget(rows, "dialect_id", "attested", ["lexeme_id", "form_row_id"], 24)


_ALL_PROBES = f"""h AS (SELECT DISTINCT lexeme_id, dialect_id, {O.strip('form2')} AS form2, {O.strip('form2_seg')} AS form2_seg, {O.strip('annotation')} AS annotation FROM provider_lexemes),
    e AS (SELECT form_row_id, dialect_id, form_source, label, {O.strip('surface')} AS surface FROM surface_forms_for_id),
    probes AS (SELECT lexeme_id, form_row_id, e.dialect_id, form_source, label, form2 || surface AS text, form2_seg || '-' || surface AS segmented, annotation || '-' || label AS annotation FROM h JOIN e ON e.dialect_id = h.dialect_id
        WHERE label IS NOT NULL AND surface <> '' AND NOT regexp_matches(surface, '[\\s\\p{{Z}}\\-]') AND form2 <> '' AND form2_seg <> '' AND annotation <> '' AND NOT regexp_matches(form2 || form2_seg || annotation, '[\\s\\p{{Z}}]'))"""


@query(
    f"""WITH {_ALL_PROBES}, c AS (SELECT *, coalesce(form_source = 'corpus', false) AS attested, row_number() OVER (PARTITION BY label, dialect_id, coalesce(form_source = 'corpus', false) ORDER BY lexeme_id, form_row_id) AS n FROM probes),
    q AS (SELECT label, dialect_id, least(count(*) FILTER (attested), CASE WHEN count(*) FILTER (NOT attested) > 0 THEN 8 ELSE 24 END) AS q FROM c GROUP BY ALL)
    SELECT label, dialect_id, lexeme_id, form_row_id, attested, text, segmented, annotation FROM c JOIN q USING (label, dialect_id) WHERE n <= CASE WHEN attested THEN q ELSE 24 - q END"""
)
def probe_targets(t):
    """Probes of all labels and parts of speech, within the budget of each label in each dialect; the two above have one of each."""
    return proposals.target_probes(proposals.hosts(t.provider_lexemes), t.surface_forms_for_id).select("label", "dialect_id", "lexeme_id", "form_row_id", "attested", "text", "segmented", "annotation")


@query(
    f"""WITH {_ALL_PROBES.replace("form2 || surface AS text", "surface || form2 AS text").replace("form2_seg || '-' || surface AS segmented", "surface || '-' || form2_seg AS segmented").replace("annotation || '-' || label AS annotation", "label || '-' || annotation AS annotation")},
    c AS (SELECT *, coalesce(form_source = 'corpus', false) AS attested, row_number() OVER (PARTITION BY label, dialect_id, coalesce(form_source = 'corpus', false) ORDER BY lexeme_id, form_row_id) AS n FROM probes),
    q AS (SELECT label, dialect_id, least(count(*) FILTER (attested), CASE WHEN count(*) FILTER (NOT attested) > 0 THEN 8 ELSE 24 END) AS q FROM c GROUP BY ALL)
    SELECT label, dialect_id, lexeme_id, form_row_id, attested, text, segmented, annotation FROM c JOIN q USING (label, dialect_id) WHERE n <= CASE WHEN attested THEN q ELSE 24 - q END"""
)
def probe_targets_before(t):
    """The same with the forms before their hosts."""
    return proposals.target_probes(proposals.hosts(t.provider_lexemes), t.surface_forms_for_id, position="before").select("label", "dialect_id", "lexeme_id", "form_row_id", "attested", "text", "segmented", "annotation")


@query("SELECT label, dialect_id, surface, min(form_row_id) AS form_row_id FROM surface_forms_for_id GROUP BY ALL")
def first_seen_dedup(t):
    return proposals.first_seen(t.surface_forms_for_id.select("label", "dialect_id", "surface", "form_row_id"), ["label", "dialect_id", "surface"], "form_row_id")


@query(
    """WITH b AS (SELECT label, surface, form_row_id, form_source, row_number() OVER (PARTITION BY label, surface ORDER BY CASE WHEN form_source = 'corpus' THEN 0 ELSE 1 END, form_row_id) AS n FROM surface_forms_for_id WHERE form_source IN ('corpus', 'lexicon'))
    SELECT label, surface, form_row_id, form_source FROM b WHERE n = 1"""
)
def candidate_union(t):
    rows = t.surface_forms_for_id.select("label", "surface", "form_row_id", "form_source")
    return proposals.united(rows.where("form_source = 'corpus'"), rows.where("form_source = 'lexicon'"), ["label", "surface"], "form_row_id").select("label", "surface", "form_row_id", "form_source")


@query("SELECT label, string_agg(surface, ' | ' ORDER BY surface) AS surfaces FROM (SELECT DISTINCT label, surface FROM surface_forms_for_id WHERE surface IS NOT NULL) GROUP BY 1")
def string_agg(t):
    distinct = t.surface_forms_for_id.where("surface is not null").select("label", "surface").distinct()
    return distinct.groupBy("label").agg(F.expr("listagg(surface, ' | ') within group (order by surface)").alias("surfaces"))


@query(
    f"""WITH a AS (SELECT result_id, list_distinct({O.ids('ai_annotation')}) AS g, list_distinct({O.ids('gold_annotation')}) AS n FROM job_results WHERE gold_annotation IS NOT NULL),
    m AS (SELECT result_id, len(list_filter(n, lambda v: NOT list_contains(g, v)))::INTEGER AS n_missing, len(list_filter(g, lambda v: NOT list_contains(n, v)))::INTEGER AS n_extra FROM a) SELECT *, n_missing = 0 AND n_extra = 0 AS complete FROM m"""
)
def audit_completeness(t):
    return proposals.audits(t.job_results, "ai_annotation", "gold_annotation", "result_id")


@query(
    f"""WITH {_TOKENS}, c AS (SELECT result_id, phrase, unnest({O.ids('phrase')}) AS id FROM (SELECT result_id, unnest({O.phrases('ai_annotation')}) AS phrase FROM job_results))
    SELECT DISTINCT result_id, id, phrase FROM c WHERE EXISTS (SELECT 1 FROM tokens t WHERE t.id = c.id AND t.phrase = c.phrase)"""
)
def phrase_grounding(t):
    claims = evidence.tokens(t.job_results.select(F.col("result_id").alias("sentence_id"), F.col("ai_annotation").alias("annotation"))).select(F.col("sentence_id").alias("result_id"), "id", "phrase").distinct()
    return proposals.grounded_phrases(claims, evidence.tokens(_latest(t)))


@query(
    f"""WITH c AS (SELECT DISTINCT form_row_id, lexeme_id, {O.strip('f.form_source')} AS pos FROM surface_forms_for_id f JOIN provider_lexemes l ON l.annotation = f.label AND l.dialect_id = f.dialect_id),
    d AS (SELECT form_row_id, lexeme_id, unnest(['n', 'v']) AS pos FROM c) SELECT DISTINCT d.* FROM d JOIN provider_lexemes l ON l.lexeme_id = d.lexeme_id AND {O.strip('l.pos')} = d.pos"""
)
def cited_hosts(t):
    """The lexemes that a form's label and dialect lead to, declared once a noun and once a verb."""
    lexemes = t.provider_lexemes.select(F.col("annotation").alias("label"), "dialect_id", "lexeme_id")
    claims = t.surface_forms_for_id.select("form_row_id", "label", "dialect_id").join(lexemes, ["label", "dialect_id"]).select("form_row_id", "lexeme_id", F.explode(F.array(F.lit("n"), F.lit("v"))).alias("pos"))
    return proposals.cited_hosts(claims, t.provider_lexemes, "pos")


def _sound_sql(text, s, a):
    sk = lambda c: O.skeleton(c)
    return f"""coalesce({s} <> '' AND {a} <> '' AND len(list_filter(flatten(list_transform(string_split({s}, ' '), lambda p: string_split(p, '-'))), lambda v: v = '')) = 0 AND replace({s}, '-', '') = {text} AND {O.alignment_error(sk(s), sk(a))} IS NULL, false)"""


_OUTCOMES = f"""{_LATEST}, f AS (SELECT DISTINCT region, lexeme_id, unnest([{O.strip('form2')}, replace({O.strip('form2_seg')}, '-', '')]) AS text FROM provider_lexemes WHERE region IS NOT NULL), l AS (SELECT region, text, count(DISTINCT lexeme_id) AS n_licensed FROM f WHERE text <> '' GROUP BY ALL),
    x AS (SELECT r.result_id, r.job_id, r.text, coalesce(gold_segmented, '') AS s, coalesce(gold_annotation, '') AS a, s.dialect_id, s.dialect_region AS region, ai_segmented, ai_annotation FROM job_results r LEFT JOIN latest s USING (sentence_id) WHERE gold_segmented IS NOT NULL OR gold_annotation IS NOT NULL),
    outcomes AS (SELECT result_id, job_id, CASE WHEN dialect_id IS NULL OR {O.blank('x.region')} THEN 'missing_probe_scope' WHEN NOT {_sound_sql('x.text', 's', 'a')} THEN 'validation_rejected' WHEN {O.blank('ai_segmented')} AND {O.blank('ai_annotation')} THEN 'model_error' WHEN ai_segmented = s AND ai_annotation = a THEN 'model_exact'
        WHEN n_licensed > 0 THEN 'model_failed_already_licensed' ELSE 'model_failed_candidate' END AS failure_type, coalesce(n_licensed, 0) AS n_licensed FROM x LEFT JOIN l ON l.region = x.region AND l.text = x.text)"""


def _outcomes(t):
    places = _latest(t).select("sentence_id", "dialect_id", F.col("dialect_region").alias("region"))
    expected = t.job_results.where("gold_segmented is not null or gold_annotation is not null").join(places, "sentence_id", "left")
    expected = expected.select("result_id", "text", F.col("gold_segmented").alias("segmented"), F.col("gold_annotation").alias("annotation"), "dialect_id", "region", F.col("ai_segmented").alias("model_segmented"), F.col("ai_annotation").alias("model_annotation"))
    return proposals.probe_outcomes(expected, t.provider_lexemes, "result_id")


@query(f"WITH {_OUTCOMES} SELECT result_id, failure_type, n_licensed FROM outcomes")
def probe_outcomes(t):
    """The gold analyses as what the analyser should have found."""
    return _outcomes(t)


@query(f"WITH {_OUTCOMES} SELECT job_id, failure_type, count(*) AS n FROM outcomes GROUP BY ALL")
def outcome_counts(t):
    return _outcomes(t).join(t.job_results.select("result_id", "job_id"), "result_id").groupBy("job_id", "failure_type").agg(F.count("*").alias("n"))


@query(
    f"""WITH {_TOKENS}, q AS (SELECT DISTINCT id AS label, annotation_schema_id FROM tokens JOIN latest USING (sentence_id)), f AS (SELECT label, annotation_schema_id, count(*) AS n FROM surface_forms_for_id GROUP BY ALL), g AS (SELECT label, sum(n)::BIGINT AS n FROM f GROUP BY 1),
    l AS (SELECT annotation AS label, count(DISTINCT lexeme_id) AS n FROM provider_lexemes GROUP BY 1), r AS (SELECT q.label, q.annotation_schema_id, coalesce(f.n, 0) AS local_forms, coalesce(g.n, 0) AS global_forms, coalesce(l.n, 0) AS lexemes FROM q LEFT JOIN f ON f.label = q.label AND f.annotation_schema_id = q.annotation_schema_id LEFT JOIN g ON g.label = q.label LEFT JOIN l ON l.label = q.label)
    SELECT *, CASE WHEN local_forms > 0 THEN 'local' WHEN global_forms + lexemes > 0 THEN 'global' ELSE 'none' END AS scope FROM r"""
)
def lookup_id(t):
    asked = evidence.tokens(_latest(t), "annotation_schema_id").select(F.col("id").alias("label"), "annotation_schema_id")
    return evidence.looked_up(asked, t.surface_forms_for_id, t.provider_lexemes)


# Critics

_STEPS = """{0} AS (SELECT k, unnest(list_transform(range(1, len(w)), lambda i: w[i])) AS previous, unnest(list_transform(range(1, len(w)), lambda i: w[i + 1])) AS token FROM (SELECT {1} AS k, ['<BOS>'] || flatten(list_transform({2}, lambda p, i: CASE WHEN i > 1 THEN ['<PB>'] ELSE [] END || {3})) || ['<EOS>'] AS w FROM {4} WHERE NOT {5}))"""


_LABELS = "list_filter(string_split(p, '-'), lambda t: t <> '' AND t <> 'r')"


def _steps_sql(name, key, column, table, own=O.ids("p")):
    return _STEPS.format(name, key, O.phrases(column), own, table, O.blank(column))


_MODEL = f"""{_LATEST}, {_steps_sql('st', 'sentence_id', 'annotation', 'latest')}, n2 AS (SELECT previous, token, count(*) AS n FROM st GROUP BY ALL), n1 AS (SELECT previous, sum(n) AS total FROM n2 GROUP BY 1), v AS (SELECT count(DISTINCT token) AS v FROM n2),
    model AS (SELECT previous, token, n, ln((n + 0.1::DOUBLE) / (total + 0.1::DOUBLE * v)) AS log_p FROM n2 JOIN n1 USING (previous) CROSS JOIN v)"""
_SCORE = "SELECT k AS {1}, count(*) AS steps, round(avg(coalesce(log_p, -12)), 6) AS mean_log_p, count(*) FILTER (coalesce(log_p, -12) < -6) AS surprises FROM {0} LEFT JOIN model USING (previous, token) GROUP BY 1"


@query(f"WITH {_MODEL} SELECT previous, token, n, round(log_p, 6) AS log_p FROM model")
def sequence_model(t):
    return critics.sequence_model(_latest(t)).withColumn("log_p", F.round("log_p", 6))


@query(f"WITH {_MODEL} {_SCORE.format('st', 'sentence_id')}")
def id_sequence_score(t):
    latest = _latest(t)
    return critics.sequence_scores(latest, critics.sequence_model(latest), "sentence_id")


@query(
    f"""WITH {_MODEL}, s0 AS ({_SCORE.format('st', 'sentence_id')}), {_steps_sql('pr', 'result_id', 'ai_annotation', 'job_results')}, s1 AS ({_SCORE.format('pr', 'result_id')})
    SELECT result_id, r.sentence_id, s1.surprises < s0.surprises OR (s1.surprises = s0.surprises AND s1.mean_log_p > s0.mean_log_p) AS accepted FROM s1 JOIN job_results r USING (result_id) JOIN s0 ON s0.sentence_id = r.sentence_id"""
)
def revision_accept(t):
    latest = _latest(t)
    model = critics.sequence_model(latest)
    after = critics.sequence_scores(t.job_results, model, "result_id", "ai_annotation").join(t.job_results.select("result_id", "sentence_id"), "result_id")
    return critics.revisions(critics.sequence_scores(latest, model, "sentence_id"), after, "result_id", "sentence_id")


@query(
    f"""WITH {_PAIRS}, c AS (SELECT label, surface AS form, count(*) AS a, count(*) FILTER (dialect_id = 17) AS o FROM pairs GROUP BY ALL), h AS (SELECT *, max(o) OVER (PARTITION BY label) > 0 AS own FROM c),
    n AS (SELECT label, form, CASE WHEN own THEN o ELSE a END AS n, CASE WHEN own THEN 'dialect' ELSE 'schema_pool' END AS scope FROM h), r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY n DESC, form) AS rn FROM n WHERE n > 0) SELECT label, form, n, scope FROM r WHERE rn <= 3"""
)
def surface_suggest_topk(t):
    return critics.suggested_forms(_pairs(t, "dialect_id"), 17)


@query(
    f"""WITH {_PAIRS}, c AS (SELECT label, surface, count(*) AS n FROM pairs GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY n DESC, surface) AS rn, max(n) OVER (PARTITION BY label) AS best FROM c),
    s AS (SELECT label, surface, rn > 1 AND (rn > 3 OR ln(best) - ln(n) >= 0.75) AS strong FROM r) SELECT sentence_id, count(*) AS segments, count(*) FILTER (strong) AS strong FROM pairs JOIN s USING (label, surface) GROUP BY 1"""
)
def surface_disagreement(t):
    return critics.disagreements(_pairs(t))


_MARGIN = f"""{_PAIRS}, mc AS (SELECT surface, label, count(*) AS n FROM pairs GROUP BY ALL), mr AS (SELECT surface, n, row_number() OVER (PARTITION BY surface ORDER BY n DESC, label) AS rn FROM mc),
    margins AS (SELECT surface, sum(n)::BIGINT AS n, round((max(n) FILTER (rn = 1) - max(n) FILTER (rn = 2)) / sum(n), 6) AS margin FROM mr GROUP BY 1)"""


@query(f"WITH {_MARGIN} SELECT * FROM margins")
def top2_margin(t):
    return critics.margins(_pairs(t))


def _surprises_sql(unit, own):
    """CTEs for the surprising steps of the results by the model of one unit."""
    u = unit
    return f"""{_steps_sql('st_' + u, 'sentence_id', 'annotation', 'latest', own)}, n2_{u} AS (SELECT previous, token, count(*) AS n FROM st_{u} GROUP BY ALL), n1_{u} AS (SELECT previous, sum(n) AS total FROM n2_{u} GROUP BY 1), v_{u} AS (SELECT count(DISTINCT token) AS v FROM n2_{u}),
    m_{u} AS (SELECT previous, token, n, ln((n + 0.1::DOUBLE) / (total + 0.1::DOUBLE * v)) AS log_p FROM n2_{u} JOIN n1_{u} USING (previous) CROSS JOIN v_{u}),
    w_{u} AS (SELECT result_id AS k, ['<BOS>'] || flatten(list_transform({O.phrases('ai_annotation')}, lambda p, i: CASE WHEN i > 1 THEN ['<PB>'] ELSE [] END || {own})) || ['<EOS>'] AS w FROM job_results WHERE NOT {O.blank('ai_annotation')}),
    p_{u} AS (SELECT k, unnest(range(0, len(w) - 1)) AS place, unnest(w[1:len(w) - 1]) AS previous, unnest(w[2:]) AS token FROM w_{u}),
    a_{u} AS (SELECT previous, string_agg(token || ':' || n, '|' ORDER BY n DESC, token) AS alternatives FROM (SELECT *, row_number() OVER (PARTITION BY previous ORDER BY n DESC, token) AS rn FROM n2_{u}) WHERE rn <= 3 GROUP BY 1),
    s_{u} AS (SELECT k AS result_id, '{u}' AS unit, place::INTEGER AS place, previous, token, round(coalesce(log_p, -12), 6) AS log_p, alternatives FROM p_{u} LEFT JOIN m_{u} USING (previous, token) LEFT JOIN a_{u} USING (previous) WHERE coalesce(log_p, -12) < -6)"""


_SURPRISES = f"{_LATEST}, {_surprises_sql('atom', O.ids('p'))}, {_surprises_sql('segment', _LABELS)}, surprises AS (SELECT * FROM s_atom UNION ALL SELECT * FROM s_segment)"


def _surprising(t):
    latest = _latest(t)
    each = [critics.surprises(t.job_results, critics.sequence_model(latest, unit=unit), "result_id", "ai_annotation", unit) for unit in ("atom", "segment")]
    return each[0].unionByName(each[1])


@query(f"WITH {_SURPRISES} SELECT * FROM surprises")
def id_surprises(t):
    return _surprising(t)


@query(
    f"""WITH {_SURPRISES}, hot AS (SELECT result_id, list(DISTINCT id) AS hot FROM (SELECT result_id, unnest([previous, token]) AS id FROM surprises) WHERE id NOT IN ('<BOS>', '<EOS>', '<PB>') GROUP BY 1), {_MARGIN.replace(_LATEST + ',', '', 1)},
    jf AS (SELECT result_id, {O.skeleton('ai_segmented')} AS s, {O.skeleton('ai_annotation')} AS a FROM job_results WHERE NOT {O.blank('ai_segmented')} AND NOT {O.blank('ai_annotation')}), jz AS (SELECT result_id, unnest(s) AS ps, unnest(a) AS pa FROM jf WHERE {O.alignment_error('s', 'a')} IS NULL),
    jp AS (SELECT DISTINCT result_id, unnest(ps) AS surface, unnest(pa) AS label FROM jz), x AS (SELECT jp.*, confidence, coalesce(margin < 0.15, false) AS close, hot, list_transform(string_split(label, ';'), lambda v: trim(v)) AS atoms FROM jp JOIN job_results USING (result_id) LEFT JOIN hot USING (result_id) LEFT JOIN margins USING (surface)),
    r AS (SELECT result_id, surface, label, concat_ws(',', CASE WHEN confidence < 0.8 THEN 'low_confidence' END, CASE WHEN list_contains(atoms, '?') THEN 'unknown_id' END, CASE WHEN close THEN 'small_alternative_margin' END, CASE WHEN list_has_any(atoms || [label], hot) THEN 'id_sequence_hotspot' END) AS reasons FROM x WHERE surface <> '')
    SELECT * FROM r WHERE reasons <> ''"""
)
def segment_triage(t):
    return critics.segment_triage(t.job_results, _result_pairs(t), critics.margins(_pairs(t)), _surprising(t))


def _result_pairs(t):
    results = t.job_results.select(F.col("result_id").alias("sentence_id"), F.col("ai_segmented").alias("segmented"), F.col("ai_annotation").alias("annotation"))
    return evidence.segment_pairs(results).withColumnRenamed("sentence_id", "result_id")


_CTX = [", ".join(c) for c in critics.CONTEXTS]
_KINDS = f"""{_PAIRS}, ctx AS (SELECT sentence_id, coalesce(dialect_id, -1) AS dialect_id, surface, label, coalesce(lag(surface) OVER w, '') AS previous_surface, coalesce(lead(label) OVER w, '<EOS>') AS next_label, segment_no = 0 AS phrase_start FROM pairs WINDOW w AS (PARTITION BY sentence_id, phrase_no ORDER BY segment_no)),
    kinds AS (SELECT {_CTX[0]}, surface, count(*) AS n FROM ctx GROUP BY ALL), """ + ", ".join(
    f"""c{i} AS (SELECT {c}, surface, sum(n) AS n FROM kinds GROUP BY ALL), r{i} AS (SELECT *, row_number() OVER (PARTITION BY {c} ORDER BY n DESC, surface) AS rn, sum(n) OVER (PARTITION BY {c}) AS total, max(n) OVER (PARTITION BY {c}) AS best_n, first_value(surface) OVER (PARTITION BY {c} ORDER BY n DESC, surface) AS best FROM c{i}),
    v{i} AS (SELECT {c}, surface, {{'level': {i}, 'best': best, 'gap': ln(best_n / n), 'among': rn <= 3}} AS c FROM r{i} WHERE total >= 3)"""
    for i, c in enumerate(_CTX)
) + f""", scored AS (SELECT k.*, coalesce({', '.join(f'v{i}.c' for i in range(len(_CTX)))}) AS c FROM kinds k {' '.join(f"LEFT JOIN v{i} ON v{i}.surface = k.surface AND " + ' AND '.join(f'v{i}.{x} = k.{x}' for x in critics.CONTEXTS[i]) for i in range(len(_CTX)))}),
    judged AS (SELECT {_CTX[0]}, surface, n, c.level AS level, c.best AS best, round(c.gap, 6) AS score_gap, coalesce(surface <> c.best AND (NOT c.among OR c.gap >= 0.75), false) AS strong FROM scored)"""


def _in_context(t):
    return evidence.in_context(_pairs(t, "dialect_id"))


@query(f"WITH {_KINDS} SELECT * FROM judged")
def surface_context_scores(t):
    return critics.context_scores(_in_context(t))


@query(f"WITH {_KINDS} SELECT sentence_id, count(*) AS segments, count(level) AS reviewed, count(*) FILTER (strong) AS strong FROM ctx JOIN judged USING ({_CTX[0]}, surface) GROUP BY 1")
def surface_context_review(t):
    return critics.context_review(_in_context(t))


@query(
    f"""WITH o AS (SELECT *, row_number() OVER (PARTITION BY sentence_id, job_id ORDER BY attempt, result_id) AS n FROM job_results), p AS (SELECT b.result_id, a.text, coalesce(a.ai_segmented, '') AS s0, coalesce(a.ai_annotation, '') AS a0, coalesce(b.ai_segmented, '') AS s1, coalesce(b.ai_annotation, '') AS a1,
        greatest(0, least(1, coalesce(a.confidence, 0)))::DOUBLE AS c0, greatest(0, least(1, coalesce(b.confidence, 0)))::DOUBLE AS c1 FROM o a JOIN o b ON a.sentence_id = b.sentence_id AND a.job_id = b.job_id AND b.n = a.n + 1),
    q AS (SELECT *, s0 = s1 AND a0 = a1 AS same, {_sound_sql('text', 's1', 'a1')} AS sound FROM p)
    SELECT result_id, CASE WHEN NOT same AND sound THEN 'revise' ELSE 'keep' END AS action, CASE WHEN same THEN 'unchanged' WHEN NOT sound THEN 'unsound' ELSE 'changed' END AS reason, CASE WHEN NOT same AND sound THEN s1 ELSE s0 END AS segmented,
        CASE WHEN NOT same AND sound THEN a1 ELSE a0 END AS annotation, CASE WHEN NOT same AND sound THEN greatest(c0, c1) ELSE c0 END AS confidence FROM q"""
)
def revision_review(t):
    """Each attempt of a job at a sentence as the revision of the attempt before it."""
    return critics.reviewed(items.attempts_with_last(t.job_results), "result_id", ("last_segmented", "last_annotation"), ("ai_segmented", "ai_annotation"), "last_text", ("last_confidence", "confidence"))


@query(
    f"""WITH {_MARGIN}, w AS (SELECT DISTINCT result_id, unnest(flatten({O.skeleton('ai_segmented')})) AS surface FROM job_results WHERE NOT {O.blank('ai_segmented')}), k AS (SELECT DISTINCT result_id FROM w JOIN margins USING (surface) WHERE margin < 0.15),
    r AS (SELECT j.result_id, concat_ws(',', CASE WHEN confidence < 0.8 THEN 'low_confidence' END, CASE WHEN list_contains({O.ids('ai_annotation')}, '?') THEN 'unknown_id' END, CASE WHEN k.result_id IS NOT NULL THEN 'small_alternative_margin' END) AS reasons FROM job_results j LEFT JOIN k USING (result_id))
    SELECT * FROM r WHERE reasons <> ''"""
)
def uncertainty_triage(t):
    return critics.triage(t.job_results, critics.margins(_pairs(t)))


@query(
    f"""WITH {_PAIRS}, jf AS (SELECT result_id, {O.skeleton('ai_segmented')} AS s, {O.skeleton('ai_annotation')} AS a FROM job_results WHERE NOT {O.blank('ai_segmented')} AND NOT {O.blank('ai_annotation')}), jz AS (SELECT result_id, unnest(s) AS ps, unnest(a) AS pa FROM jf WHERE {O.alignment_error('s', 'a')} IS NULL),
    jp AS (SELECT DISTINCT result_id, unnest(ps) AS surface, unnest(pa) AS label FROM jz) SELECT result_id, surface, label FROM jp SEMI JOIN pairs p USING (surface) ANTI JOIN pairs q USING (surface, label)"""
)
def query_gating(t):
    results = t.job_results.select(F.col("result_id").alias("sentence_id"), F.col("ai_segmented").alias("segmented"), F.col("ai_annotation").alias("annotation"))
    proposed = evidence.segment_pairs(results).select(F.col("sentence_id").alias("result_id"), "surface", "label").distinct()
    return critics.unobserved(proposed, _pairs(t)).select("result_id", "surface", "label")


@query(
    """SELECT result_id, replace(ai_segmented, '-', '') = text AND len(list_filter(flatten(list_transform(string_split(ai_segmented, ' '), lambda p: string_split(p, '-'))), lambda v: v = '')) = 0 AS accepted
    FROM job_results WHERE ai_segmented IS NOT NULL AND text IS NOT NULL"""
)
def segmentation_accept(t):
    return items.accepted_segmentations(t.job_results, "result_id", "ai_segmented", "text")


# Usage

_SUMS = ", ".join(f"coalesce(sum({c}), 0)::BIGINT AS {c}" for c in usage.COUNTS)


@query(
    f"""WITH c AS (SELECT DISTINCT * FROM usage_calls), r AS (SELECT c.*, coalesce(c.model_name, 'unknown') AS m, coalesce(j.task, 'unknown') AS t FROM c LEFT JOIN jobs j ON j.id = c.job_id)
    SELECT CASE WHEN grouping(m) = 1 AND grouping(t) = 1 THEN 'total' WHEN grouping(m) = 0 THEN 'model' ELSE 'task' END AS level, coalesce(m, '') AS model_name, coalesce(t, '') AS task, count(*) AS calls, {_SUMS} FROM r GROUP BY GROUPING SETS ((), (m), (t))"""
)
def usage_rollup(t):
    return usage.rollup(t.usage_calls, t.jobs)


@query(f"WITH c AS (SELECT DISTINCT * FROM usage_calls) SELECT (floor(epoch(called_at) / 3600) * 3600)::BIGINT AS hour, model_name, count(*) AS calls, {_SUMS} FROM c WHERE called_at IS NOT NULL GROUP BY ALL")
def usage_by_hour(t):
    return usage.by_hour(usage.distinct_calls(t.usage_calls)).withColumn("hour", F.col("hour").cast("long"))


# Items and results


@query(f"SELECT row_id, coalesce(nullif({O.strip('translation_jp')}, ''), nullif({O.strip('text')}, ''), nullif({O.strip('example_id')}, ''), '') AS value FROM sentences")
def alias_coalesce(t):
    return t.sentences.select("row_id", items.first_of(t.sentences, ["trsl", "translation_jp", "text", "example_id"]).alias("value"))


_NEEDS = {"any": "true", "annotation": "{a}", "translation": "{b}", "either": "{a} OR {b}", "both": "{a} AND {b}"}
for _need, _where in _NEEDS.items():
    registry.add(
        "SELECT row_id FROM sentences WHERE " + _where.format(a=f"({O.blank('segmented')} OR {O.blank('annotation')})", b=O.blank("translation_jp")), name=f"needs_filter_{_need}"
    )(lambda t, need=_need: items.needing(t.sentences, need).select("row_id"))


@query("SELECT row_id, sentence_id FROM sentences WHERE dataset_id = 1046 AND sentence_id BETWEEN 100 AND 20000")
def scope_range(t):
    return items.in_scope(t.sentences, 1046, 100, 20000).select("row_id", "sentence_id")


@query("SELECT id, task, model_name FROM jobs ORDER BY id DESC LIMIT 20")
def latest_jobs(t):
    return items.latest(t.jobs, "id", 20).select("id", "task", "model_name")


@query("SELECT row_id, sentence_id FROM sentences WHERE row_id > 1000 ORDER BY row_id LIMIT 500")
def keyset_page(t):
    return items.page(t.sentences, "row_id", 1000, 500).select("row_id", "sentence_id")


@query(
    f"""SELECT result_id, sentence_id, coalesce(ai_segmented, '') AS ai_segmented, coalesce(ai_annotation, '') AS ai_annotation, coalesce(trsl_ai, '') AS ai_translation,
    CASE WHEN {O.blank('ai_segmented')} AND {O.blank('ai_annotation')} AND {O.blank('trsl_ai')} THEN 'failed' ELSE coalesce(decision, '') END AS ai_decision, coalesce(printf('%.6f', confidence), '') AS ai_confidence FROM job_results"""
)
def output_projection(t):
    return items.output_rows(t.job_results, ["result_id", "sentence_id"])


@query(
    f"""WITH {_LATEST} SELECT r.result_id, r.job_id, r.sentence_id, s.example_id, coalesce(r.text, s.text) AS source_text, s.translation_jp AS human_translation_jp, ai_segmented, ai_annotation, trsl_ai AS ai_translation, decision, confidence, gold_segmented, gold_annotation, coalesce(exact_match::VARCHAR, '') AS exact_match, j.task, j.model_name, j.dataset_name
    FROM job_results r LEFT JOIN latest s USING (sentence_id) LEFT JOIN jobs j ON j.id = r.job_id"""
)
def job_export(t):
    return items.export_rows(t.job_results, _latest(t), t.jobs)


@query("SELECT job_id, count(*) AS selected, count(*) FILTER (NOT coalesce(decision = 'failed', false)) AS completed, count(*) FILTER (decision = 'failed') AS failed FROM job_results GROUP BY 1")
def batch_counters(t):
    return items.counters(t.job_results, ["job_id"])


@query(
    f"""WITH {_LATEST}, p AS (SELECT *, row_number() OVER (PARTITION BY sentence_id ORDER BY finished_at DESC NULLS LAST, result_id DESC) AS n FROM job_results WHERE NOT {O.blank('ai_segmented')} AND NOT {O.blank('ai_annotation')}),
    r AS (SELECT l.sentence_id, l.segmented, l.annotation, NOT {O.blank('l.segmented')} AND NOT {O.blank('l.annotation')} AS own, p.sentence_id IS NOT NULL AS has, ai_segmented, ai_annotation FROM latest l LEFT JOIN p ON p.sentence_id = l.sentence_id AND n = 1)
    SELECT sentence_id, CASE WHEN own THEN 'existing' WHEN has THEN 'predicted' ELSE 'none' END AS source, CASE WHEN own THEN segmented ELSE coalesce(ai_segmented, '') END AS segmented, CASE WHEN own THEN annotation ELSE coalesce(ai_annotation, '') END AS annotation FROM r"""
)
def morph_source_choice(t):
    return items.chosen_analysis(_latest(t), t.job_results)


@query(
    f"""SELECT result_id, lower(decision) AS decision, coalesce(round(confidence, 6), 0) AS confidence, {O.strip("coalesce(ai_segmented, '')")} AS segmented, {O.strip("coalesce(ai_annotation, '')")} AS annotation, {O.strip("coalesce(trsl_ai, '')")} AS trsl_ai,
    coalesce(lower(decision) IN ('proposed', 'uncertain', 'failed'), false) AND coalesce(round(confidence, 6), 0) BETWEEN 0 AND 1 AS valid FROM job_results"""
)
def parse_final_json(t):
    fields = F.struct("decision", F.round("confidence", 6).alias("confidence"), F.col("ai_segmented").alias("segmented"), F.col("ai_annotation").alias("annotation"), "trsl_ai")
    payload = F.concat(F.lit("```json\n"), F.to_json(fields), F.lit("\n```"))
    return items.parsed_payload(t.job_results.withColumn("payload", payload), "payload", "result_id")


@query(
    f"""WITH x AS (SELECT *, confidence IS NOT NULL AND NOT coalesce(decision = 'failed', false) AS whole FROM job_results) SELECT result_id, CASE WHEN whole THEN lower(decision) END AS decision, CASE WHEN whole THEN round(confidence, 6) ELSE 0 END AS confidence, CASE WHEN whole THEN {O.strip("coalesce(ai_segmented, '')")} ELSE '' END AS segmented,
    CASE WHEN whole THEN {O.strip("coalesce(ai_annotation, '')")} ELSE '' END AS annotation, CASE WHEN whole THEN {O.strip("coalesce(trsl_ai, '')")} ELSE '' END AS trsl_ai, coalesce(whole AND lower(decision) IN ('proposed', 'uncertain', 'failed') AND round(confidence, 6) BETWEEN 0 AND 1, false) AS valid FROM x"""
)
def parse_broken_json(t):
    """Answers of which those without confidence are plain text, and those that failed break off in the middle."""
    fields = F.struct("decision", F.round("confidence", 6).alias("confidence"), F.col("ai_segmented").alias("segmented"), F.col("ai_annotation").alias("annotation"), "trsl_ai")
    whole = F.to_json(fields)
    cut = F.concat(F.lit("```json\n"), F.substring(whole, F.lit(1), F.floor(F.length(whole) / 2).cast("int")))
    payload = F.when(F.col("confidence").isNull(), F.coalesce("trsl_ai", F.lit("no answer"))).when(F.col("decision") == "failed", cut).otherwise(whole)
    return items.parsed_payload(t.job_results.withColumn("payload", payload), "payload", "result_id")
