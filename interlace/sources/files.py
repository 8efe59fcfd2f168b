"""Tables from and to the files that annotators exchange."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from interlace.functions.text import strip
from interlace.operators.items import first_of

#: Names that a column may have, the first with a value counting.
ALIASES = {
    "example_id": ("id", "example_id", "sentence_id", "row_id"), "text": ("trsc2", "text", "source_text", "transcription"), "dialect_id": ("dialect_id", "dialect"),
    "segmented": ("trsc2_seg", "segmented", "existing_segmented"), "annotation": ("annotation_r", "annotation", "existing_annotation"), "translation_jp": ("trsl", "translation_jp", "translation"),
}


def read_tsv(spark: SparkSession, path: str | Sequence[str], default_dialect: int | None = None) -> DataFrame:
    """Items of tab-separated files with a header, by the aliases of their columns; a byte-order mark is dropped.

    Rows with neither text nor translation are left out. Files are read in parallel, so a row without an ID of its own gets none
    from its place. All other columns are kept in the map `original`.
    """
    raw = spark.read.csv(path, sep="\t", header=True, encoding="UTF-8", quote='"', escape='"', multiLine=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    return _items(raw.toDF(*[c.lstrip("﻿").strip() for c in raw.columns]), default_dialect)


def _items(raw: DataFrame, default_dialect: int | None) -> DataFrame:
    original = F.create_map(*[x for c in raw.columns for x in (F.lit(c), F.col(f"`{c}`"))])
    rows = raw.select(*[first_of(raw, names).alias(name) for name, names in ALIASES.items()], original.alias("original"))
    status = F.when((F.col("segmented") != "") & (F.col("annotation") != ""), "annotated").otherwise("unannotated")
    dialect = F.coalesce(F.col("dialect_id").try_cast("int"), F.lit(default_dialect).cast("int"))
    return rows.where((F.col("text") != "") | (F.col("translation_jp") != "")).withColumns({"dialect_id": dialect, "source_status": status})


def read_items(spark: SparkSession, path: str, default_dialect: int | None = None) -> DataFrame:
    """Items of a file by its ending: tab-separated, or JSON lines under the same aliases of columns."""
    ending = path.rsplit(".", 1)[-1].lower()
    if ending in ("tsv", "txt"):
        return read_tsv(spark, path, default_dialect)
    if ending in ("json", "jsonl"):
        raw = spark.read.json(path)
        return _items(raw.select(*[F.col(f"`{c}`").cast("string").alias(c) for c in raw.columns]), default_dialect)
    raise ValueError(f"no items can be read from .{ending} files")


def read_nbest(spark: SparkSession, path: str) -> DataFrame:
    """(row_id, ref_units, nbest_json) of tab-separated predictions."""
    raw = spark.read.csv(path, sep="\t", header=True, encoding="UTF-8", quote="", multiLine=False)
    return raw.select(strip("row_id").alias("row_id"), "ref_units", "nbest_json")


def read_requests(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Requests of JSON files, one object each, in the given schema."""
    return spark.read.json(path, schema=schema, multiLine=True)


def write_tsv(tables: Sequence[DataFrame], path: str) -> None:
    """The rows of several tables under the union of their columns, in the order in which they first occur."""
    whole = tables[0]
    for t in tables[1:]:
        whole = whole.unionByName(t, allowMissingColumns=True)
    texts = [F.to_json(c) if t.startswith(("array", "map", "struct")) else F.col(c).cast("string") for c, t in whole.dtypes]
    whole.select(*[F.coalesce(x, F.lit("")).alias(c) for x, c in zip(texts, whole.columns)]).write.csv(path, sep="\t", header=True, emptyValue="", quote='"', escape='"')


def write_json(df: DataFrame, path: str) -> None:
    """One JSON object a line, with the fields that are null."""
    df.write.option("ignoreNullFields", "false").json(path)


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, sha256) of files, to hold them against the hashes they should have."""
    return spark.read.format("binaryFile").load(path).select("path", "length", F.sha2("content", 256).alias("sha256"))
