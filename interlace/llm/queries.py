"""Queries over the project's tables for the operators of this package, and their SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from interlace.functions.oracle import packed_values
from interlace.functions.text import strip
from interlace.llm.cooccurrence import cooccurring_pairs
from interlace.llm.leakage import leaks
from interlace.llm.lookalikes import consistent_sql, lookalike_classes, lookalike_pairs
from interlace.llm.mixing import Plan, entropy, mixed, planned, reached_shares, target_entropy, token_table
from interlace.llm.pair_defects import pair_defects
from interlace.llm.sentence_items import sentence_items
from interlace.llm.splitting import split_texts
from interlace.llm.subsequences import frequent_subsequences
from interlace.llm.term_frequency import frequency_mark, term_frequencies


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def p2_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cooccurring_pairs(sentence_items(_table(spark, sf_dir, "sentences")), "ids", min_lift=0.0)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cooccurring_pairs(sentence_items(_table(spark, sf_dir, "sentences")), "ids", min_lift=3.0).select("id_a", "id_b")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookalike_pairs(_table(spark, sf_dir, "sentences"), "row_id", ["text", "translation_jp"])


def p3_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookalike_classes(_table(spark, sf_dir, "sentences"), "row_id", ["text", "translation_jp"])


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    jobs = _table(spark, sf_dir, "jobs").where(F.col("task").isin("translate", "morph-translate")).select(F.col("id").alias("job_id"))
    return _table(spark, sf_dir, "job_results").join(jobs, "job_id", "left_semi")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pair_defects(_pairs(spark, sf_dir), "result_id", "text", "trsl_ai").where("defect is not null").select("result_id", "defect")


def p4_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pair_defects(_pairs(spark, sf_dir), "result_id", "text", "trsl_ai")


def _frequencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = sentence_items(_table(spark, sf_dir, "sentences"))
    n = items.count()
    ids = term_frequencies(items.select("sentence_id", F.explode("ids").alias("term")), "term", "sentence_id").withColumn("field_name", F.lit("annotation")).withColumn("total", F.lit(n).cast("long"))
    record = F.to_json(F.struct("label", "annotation_schema_id", "dialect_id"), {"ignoreNullFields": "false"})
    forms = _table(spark, sf_dir, "surface_forms_for_id").select(record.alias("record"), strip("surface").alias("term")).where("term <> ''")
    m = forms.select("record").distinct().count()
    surfaces = term_frequencies(forms, "term", "record").withColumn("field_name", F.lit("surface")).withColumn("total", F.lit(m).cast("long"))
    both = ids.unionByName(surfaces)
    return both.select("field_name", "term", "occurrences", "n_records", "total", frequency_mark("n_records", F.col("total")).alias("freq_mark"))


def p5_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _frequencies(spark, sf_dir)


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _frequencies(spark, sf_dir).where("freq_mark is not null").select("field_name", "term", "freq_mark")


def _patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frequent_subsequences(sentence_items(_table(spark, sf_dir, "sentences")), "ids")


def p6_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _patterns(spark, sf_dir).select(*[F.col("pattern")[i].alias(f"step_{i + 1}") for i in range(3)], "support")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p6_patterns(spark, sf_dir).drop("support")


def p7_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edited copies too."""
    return leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "eval_items"), edited=True)


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "eval_items")).select("doc_id", "item_id")


def _tokens(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    targets = _table(spark, sf_dir, "mix_targets")
    return token_table(_table(spark, sf_dir, "documents"), targets), targets


def _mixes(tokens: DataFrame, targets: DataFrame, kind: str) -> tuple[DataFrame, Plan]:
    """A mix and its plan: the target shares; a budget of all tokens, at which the repetition limits bound the exponent; or own shares
    tempered to an entropy half-way from theirs to that of the target shares."""
    made = planned(tokens, targets)
    if kind == "budget":
        made = planned(tokens, targets, budget=sum(n for _, _, n, _, _ in made.sources.values()))
    elif kind == "entropy":
        own = {s: n for s, (_, _, n, _, _) in made.sources.items() if n > 0}
        shares = {s: n / sum(own.values()) for s, n in own.items()}
        made = planned(tokens, targets, target_entropy=(entropy(shares) + target_entropy(targets)) / 2)
    return mixed(tokens, made), made


def p8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mixes(*_tokens(spark, sf_dir), "targets")[0]


def p8_budgeted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As many tokens as the documents have: the exponent is the largest that the repetition limits permit at that budget."""
    return _mixes(*_tokens(spark, sf_dir), "budget")[0]


def p8_tempered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sources' own token shares, tempered to a target entropy."""
    return _mixes(*_tokens(spark, sf_dir), "entropy")[0]


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares and exponent of the three mixes."""
    tokens, targets = _tokens(spark, sf_dir)
    each = [reached_shares(*_mixes(tokens, targets, kind)).withColumn("mix", F.lit(kind)) for kind in ("targets", "budget", "entropy")]
    return each[0].unionByName(each[1]).unionByName(each[2])


def p9_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_texts(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "piece_limits"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (p2_found, p2_pairs, p3_found, p3_forms, p4_found, p4_pairs, p5_found, p5_terms, p6_found, p6_patterns, p7_found, p7_leaks, p8_mix, p8_budgeted, p8_tempered, p8_shares, p9_pieces)
}

def sentence_ids() -> str:
    """DuckDB: CTEs `one` (sentence_id, ids: list in order) and `n` (n: sentences with an ID)."""
    return f"""one AS (SELECT sentence_id, list_filter({packed_values('annotation')}, lambda v: v NOT IN ('r', '?')) AS ids
        FROM (SELECT sentence_id, max(annotation) AS annotation FROM sentences WHERE annotation IS NOT NULL GROUP BY 1)),
    n AS (SELECT count(*) AS n FROM one WHERE len(ids) > 0)"""


_P2 = f"""WITH {sentence_ids()},
    each AS (SELECT DISTINCT sentence_id, unnest(ids) AS id FROM one),
    k AS (SELECT id, count(*) AS k FROM each GROUP BY 1),
    ab AS (SELECT x.id AS id_a, y.id AS id_b, count(*) AS n_ab FROM each x JOIN each y ON x.sentence_id = y.sentence_id AND x.id < y.id GROUP BY 1, 2),
    p AS (SELECT id_a, id_b, a.k AS n_a, b.k AS n_b, n_ab, n AS n_records, round(n_ab * n::DOUBLE / (a.k * b.k), 6) AS lift
        FROM ab JOIN k a ON a.id = id_a JOIN k b ON b.id = id_b CROSS JOIN n WHERE n_ab >= 5 AND 2000 * n_ab >= n)"""

_P5 = f"""WITH {sentence_ids()},
    e AS (SELECT 'annotation' AS field_name, id AS term, CAST(sentence_id AS VARCHAR) AS record FROM (SELECT sentence_id, unnest(ids) AS id FROM one)
        UNION ALL SELECT 'surface', trim(surface), concat_ws('|', coalesce(label, '~'), coalesce(annotation_schema_id::VARCHAR, '~'), coalesce(dialect_id::VARCHAR, '~')) FROM surface_forms_for_id WHERE trim(surface) <> ''),
    t AS (SELECT field_name, count(DISTINCT record) AS total FROM e GROUP BY 1),
    f AS (SELECT field_name, term, count(*) AS occurrences, count(DISTINCT record) AS n_records FROM e GROUP BY 1, 2),
    m AS (SELECT field_name, term, occurrences, n_records, total, CASE WHEN n_records < 3 THEN 'rare' WHEN n_records * 20 > total THEN 'common' END AS freq_mark FROM f JOIN t USING (field_name))"""

_P6 = f"""WITH {sentence_ids()},
    each AS (SELECT sentence_id, unnest(ids) AS id, generate_subscripts(ids, 1) AS at FROM one),
    k AS (SELECT id FROM each CROSS JOIN n GROUP BY id, n HAVING count(DISTINCT sentence_id) >= 5 AND 100 * count(DISTINCT sentence_id) >= n),
    e AS (SELECT each.* FROM each SEMI JOIN k USING (id)),
    p AS (SELECT x.id AS step_1, y.id AS step_2, z.id AS step_3, count(DISTINCT x.sentence_id) AS support
        FROM e x JOIN e y ON x.sentence_id = y.sentence_id AND x.at < y.at JOIN e z ON y.sentence_id = z.sentence_id AND y.at < z.at GROUP BY 1, 2, 3)"""

_P3 = "WITH f AS (" + " UNION ALL ".join(f"SELECT '{f}' AS field_name, row_id, {f} AS value, {consistent_sql(f)} AS canon FROM sentences WHERE {f} IS NOT NULL" for f in ("text", "translation_jp")) + ")"

ORACLES: dict[str, str] = {
    "p3_found": f"{_P3} SELECT a.field_name, a.row_id AS row_id_a, b.row_id AS row_id_b FROM f a JOIN f b ON a.field_name = b.field_name AND a.canon = b.canon AND a.value <> b.value AND a.row_id < b.row_id",
    "p3_forms": f"{_P3}, c AS (SELECT field_name, canon, count(*) AS n_rows, count(DISTINCT value) AS n_values FROM f GROUP BY ALL HAVING count(DISTINCT value) > 1) SELECT field_name, row_id, canon, n_rows, n_values FROM f JOIN c USING (field_name, canon)",
    "p2_found": f"{_P2} SELECT id_a, id_b FROM p WHERE n_ab * n_records >= 3 * n_a * n_b",
    "p2_pairs": f"{_P2} SELECT * FROM p",
    "p5_found": f"{_P5} SELECT field_name, term, freq_mark FROM m WHERE freq_mark IS NOT NULL",
    "p5_terms": f"{_P5} SELECT * FROM m",
    "p6_found": f"{_P6} SELECT step_1, step_2, step_3 FROM p CROSS JOIN n WHERE support >= 5 AND 100 * support >= n",
    "p6_patterns": f"{_P6} SELECT step_1, step_2, step_3, support FROM p CROSS JOIN n WHERE support >= 5 AND 100 * support >= n",
}
