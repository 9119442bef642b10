"""Binary shard commit protocol, text header and order."""

import os

import pytest
from pyspark.sql import functions as F

from lexaria.sinks import vectors as SK
from lexaria.sources import vectors as SV


def table(spark, n, d=3, prefix="w"):
    return spark.createDataFrame([(f"{prefix}{i:03d}", [float(i + k) for k in range(d)], i) for i in range(n)],
                                 "word string, vec array<double>, word_idx long")


def test_overwrite_with_fewer_shards(spark, tmp_path):
    p = str(tmp_path / "bin")
    SK.write_word2vec_binary(table(spark, 40), p, shards=4)
    assert SV.read_word2vec_binary(spark, p).count() == 40
    SK.write_word2vec_binary(table(spark, 3, prefix="x"), p, shards=1)
    got = SV.read_word2vec_binary(spark, p).collect()
    assert sorted(r["word"] for r in got) == ["x000", "x001", "x002"]
    assert not [f for f in os.listdir(p) if f.startswith("_attempt")]


def test_failed_write_changes_nothing(spark, tmp_path):
    p = str(tmp_path / "bin")
    SK.write_word2vec_binary(table(spark, 5), p)
    bad = table(spark, 40).repartition(4).withColumn(
        "word", F.when(F.col("word_idx") == 33, F.raise_error(F.lit("stop"))).otherwise(F.col("word")))
    with pytest.raises(Exception, match="stop"):
        SK.write_word2vec_binary(bad, p)
    assert SV.read_word2vec_binary(spark, p).count() == 5
    assert all(f.endswith((".bin", ".crc")) for f in os.listdir(p))


def test_text_header_and_order(spark, tmp_path):
    p = str(tmp_path / "txt")
    df = table(spark, 20).orderBy(F.desc("word_idx"))
    SK.write_word2vec_text(df, p)
    lines = [r["value"] for r in spark.read.text(p).select("value", F.col("_metadata.file_path").alias("f"),
                                                          F.monotonically_increasing_id().alias("m")).orderBy("f", "m").collect()]
    assert lines[0] == "20 3" and [x.split()[0] for x in lines[1:]] == [f"w{i:03d}" for i in reversed(range(20))]
    SK.write_glove_text(df, p, order="word_idx")
    assert spark.read.text(p).first()["value"].startswith("w000 ")


def test_one_dimension_and_ragged_lines(spark, tmp_path):
    p = tmp_path / "one.txt"
    p.write_text("2 1\na 0.5\nb 0.25\n")
    assert {r["word"]: r["vec"] for r in SV.read_word2vec_text(spark, str(p)).collect()} == {"a": [0.5], "b": [0.25]}
    q = tmp_path / "ragged.txt"
    q.write_text("3 2\na 1 2\nb 1 2 3\nc 4\n")
    assert {r["word"]: r["vec"] for r in SV.read_word2vec_text(spark, str(q)).collect()} == {"a": [1, 2], "b": [1, 2, 3], "c": [4]}
    bad = tmp_path / "none.txt"
    bad.write_text("a 1 2\n")
    with pytest.raises(ValueError):
        SV.read_word2vec_text(spark, str(bad))
