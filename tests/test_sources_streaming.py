import pytest
from pyspark.sql import functions as F

from interlace.operators.usage import by_hour, distinct_calls
from interlace.sources import files
from interlace.streaming.usage import hourly_usage
from tests.conftest import rows


def test_tsv_round(spark, tmp_path):
    (tmp_path / "in.tsv").write_text("﻿id\ttrsc2\tdialect_id\ttrsc2_seg\tannotation_r\ttrsl\nk1\tabc\t7\ta-bc\tX-Y\t\nk2\t\t\t\t\t\nk3\t\tx\t\t\t訳\n", encoding="utf-8")
    df = files.read_tsv(spark, str(tmp_path / "in.tsv"), default_dialect=3)
    assert rows(df.drop("original")) == [("k1", "abc", 7, "a-bc", "X-Y", "", "annotated"), ("k3", "", 3, "", "", "訳", "unannotated")]
    other = spark.createDataFrame([(1, [1, 2])], "n int, xs array<int>")
    files.write_tsv([df.select("example_id", "text"), other], str(tmp_path / "out"))
    back = spark.read.csv(str(tmp_path / "out"), sep="\t", header=True)
    assert back.columns == ["example_id", "text", "n", "xs"] and back.count() == 3
    files.write_json(other, str(tmp_path / "json"))
    assert spark.read.json(str(tmp_path / "json")).first()["xs"] == [1, 2]


def test_items_by_ending(spark, tmp_path):
    (tmp_path / "in.TSV").write_text("id\ttext\nk1\tabc\n", encoding="utf-8")
    (tmp_path / "in.jsonl").write_text('{"example_id": "k2", "trsl": "訳", "dialect": 4}\n{"example_id": "k3"}\n', encoding="utf-8")
    got = [rows(files.read_items(spark, str(tmp_path / n), 3).select("example_id", "text", "translation_jp", "dialect_id")) for n in ("in.TSV", "in.jsonl")]
    assert got == [[("k1", "abc", "", 3)], [("k2", "", "訳", 4)]]
    with pytest.raises(ValueError):
        files.read_items(spark, "in.xlsx")


def test_nbest_and_requests(spark, tmp_path):
    (tmp_path / "p.tsv").write_text('row_id\tref_units\tnbest_json\nu\ta c\t[{"rank":1,"units":["a"]}]\n')
    assert files.read_nbest(spark, str(tmp_path / "p.tsv")).first()["nbest_json"] == '[{"rank":1,"units":["a"]}]'
    (tmp_path / "r.json").write_text('{\n"task": "morph",\n"item": {"text": "a"}}')
    assert files.read_requests(spark, str(tmp_path / "r.json"), "task string, item struct<text:string>").first()["item"]["text"] == "a"


def test_stream_equals_batch(spark, sf, tmp_path):
    calls = spark.read.parquet(f"{sf}/usage_calls.parquet").where("called_at is not null")
    for i in range(3):
        calls.where(F.pmod(F.xxhash64("call_id"), F.lit(3)) == i).coalesce(1).write.mode("append").parquet(str(tmp_path / "calls"))
    stream = hourly_usage(spark, str(tmp_path / "calls"), calls.schema, late="3650 days")
    q = stream.writeStream.outputMode("complete").format("memory").queryName("usage").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert rows(spark.table("usage")) == rows(by_hour(distinct_calls(calls)))


def test_hashes(spark, tmp_path):
    (tmp_path / "a.bin").write_bytes(b"abc")
    assert files.file_hashes(spark, str(tmp_path / "a.bin")).first()["sha256"] == "ba7816bf8f01cfea414140de5dae2223b00361a396177a9cb410ff61f20015ad"
