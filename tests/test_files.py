"""Readers, writers, logs that resume, and streams."""

import json

import pytest
from pyspark.sql import functions as F

from patchwright.sources import tables as R
from patchwright.streaming import logs as L


def test_json_array_and_lines(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps(["x", "", "वाघ"]))
    assert [tuple(r) for r in R.json_array(spark, str(tmp_path / "a.json")).orderBy("sentence_id").collect()] == [(0, "x"), (1, ""), (2, "वाघ")]
    (tmp_path / "l.txt").write_text("a\n\nb\n")
    assert [tuple(r) for r in R.lines(spark, str(tmp_path / "l.txt"), 3).orderBy("segment_id").collect()] == [(0, "a"), (1, ""), (2, "b")]
    with pytest.raises(ValueError, match="has 3 lines, not 4"):
        R.lines(spark, str(tmp_path / "l.txt"), 4)


def test_jsonl(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"id": 1, "s": "a"}\n\n{"id": 1, "s": "b"}\n{"id": 2, "s": "torn')
    rows = R.tolerant_jsonl(spark, str(tmp_path / "x.jsonl"), "id int, s string").collect()
    assert sorted((r["id"], r["s"]) for r in rows if r["id"]) == [(1, "a"), (1, "b")]


def test_metric_csv(spark, tmp_path):
    (tmp_path / "m.csv").write_text("Model,Noise,chrF++,extra\nbpe,0,40.0,1\nblt,,44.0,1\n")
    df = R.metric_csv(spark, str(tmp_path / "m.csv"), {"model": ["model"], "noise": ["noise"], "score": ["chrF++", "chrf"]})
    assert [(r["model"], r["source_csv"]) for r in df.collect()] == [("bpe", "m.csv")]
    with pytest.raises(ValueError, match="bleu"):
        R.metric_csv(spark, str(tmp_path / "m.csv"), {"bleu": ["BLEU"]})


def test_pairs(spark):
    flat = spark.createDataFrame([("a", "b"), ("a", " a "), ("", "b"), (None, "b")], "english string, marathi string")
    assert [tuple(r) for r in R.pairs(flat).collect()] == [("a", "b")]
    nested = spark.createDataFrame([(("x", "y"),)], "translation struct<en:string,mr:string>")
    assert [tuple(r) for r in R.pairs(nested).collect()] == [("x", "y")]
    assert R.side(flat, None, R.SOURCE_NAMES) == "english" and R.available(flat) == ["english", "marathi"]
    with pytest.raises(ValueError):
        R.side(flat, None, ["nope"])


def test_first_that_loads(spark, tmp_path):
    df = R.first_that_loads([lambda: spark.read.parquet(str(tmp_path / "none")), lambda: spark.range(3)])
    assert df.count() == 3
    with pytest.raises(Exception):  # noqa: B017
        R.first_that_loads([lambda: spark.read.parquet(str(tmp_path / "none"))])


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([(1, "a\nb", "x"), (0, None, "y")], "id int, s string, t string")
    R.write_parallel(df, "id", "s", "t", str(tmp_path / "s"), str(tmp_path / "t"))
    assert [r["value"] for r in spark.read.text(str(tmp_path / "s")).collect()] == ["", "a b"]
    R.write_csv(df, ["id", "t"], str(tmp_path / "c"))
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).columns == ["id", "t"]
    R.write_summary(df, str(tmp_path / "j"))
    assert {json.loads(r["value"])["id"] for r in spark.read.text(str(tmp_path / "j")).collect()} == {0, 1}


def test_checkpoint_order(spark):
    df = spark.createDataFrame([("m_epoch10.pth",), ("m_epoch2.pth",), ("m_best.pth",), ("m_a.pth",)], "path string")
    assert [r["path"] for r in R.checkpoints(df).collect()] == ["m_epoch2.pth", "m_epoch10.pth", "m_best.pth", "m_a.pth"]
    assert df.select(R.hypothesis_path(F.col("path"))).first()[0] == "m_epoch10.hyp.txt"


def test_fingerprint():
    a = R.fingerprint({"lr": 1, "out": "x"}, ["out"])
    assert len(a) == 16 and a == R.fingerprint({"out": "y", "lr": 1}, ["out"]) != R.fingerprint({"lr": 2}, ["out"])


def test_log_resumes(spark, tmp_path):
    rows = spark.createDataFrame([(i, str(i)) for i in range(10)], "k int, v string")
    log = L.Log(spark, str(tmp_path), "k", {"a": 1})
    log.append(rows.where("k < 4"))
    log.append(rows.unionByName(rows))
    log.append(rows)
    assert [r["k"] for r in log.rows(ordered=True).collect()] == list(range(10))
    other = L.Log(spark, str(tmp_path), "k", {"a": 2})
    assert not other.exists() and other.pending(rows).count() == 10


def test_stream_replays(spark, tmp_path):
    src = tmp_path / "in"
    spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string").write.parquet(str(src))
    log = L.Log(spark, str(tmp_path / "log"), "k", {})
    for checkpoint in ("c1", "c2"):  # the second run reads everything anew
        stream = spark.readStream.schema("k int, v string").parquet(str(src))
        log.follow(stream, str(tmp_path / checkpoint)).trigger(availableNow=True).start().awaitTermination()
    assert sorted(r["k"] for r in log.rows().collect()) == [1, 2]


def test_stream_windows(spark, tmp_path):
    src = tmp_path / "e"
    spark.sql("select * from values (1, timestamp'2024-01-01 00:10:00'), (1, timestamp'2024-01-01 00:20:00'), (2, timestamp'2024-01-01 02:00:00') as t(id, ts)").write.parquet(str(src))
    stream = spark.readStream.schema("id int, ts timestamp").parquet(str(src))
    q = L.tumbling(stream, "ts", [], "1 hour", "10 minutes").writeStream.outputMode("complete").format("memory").queryName("w").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(r["n"] for r in spark.table("w").collect()) == [1, 2]
    q = L.first_seen(stream, "id", "ts", "1 hour").writeStream.format("memory").queryName("d").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(r["id"] for r in spark.table("d").collect()) == [1, 2]


def test_memo(spark, tmp_path):
    built = []

    def build():
        built.append(1)
        return spark.range(3)

    for _ in range(2):
        assert L.memo(spark, str(tmp_path), "s", {"a": 1}, build).count() == 3
    L.memo(spark, str(tmp_path), "s", {"a": 2}, build)
    L.memo(spark, str(tmp_path), "s", {"a": 1}, build, valid=lambda df: df.count() > 5)
    assert len(built) == 3


def test_latest_upsert_retention(spark):
    df = spark.createDataFrame([(1, 1, "run"), (1, 2, "done"), (2, 1, None)], "id int, line int, status string")
    assert sorted((r["id"], r["status"]) for r in L.latest(df, ["id"], [F.col("line")]).collect()) == [(1, "done"), (2, None)]
    up = L.upserted(df.where("line = 1"), spark.createDataFrame([(2, 5, "x"), (3, 1, "y")], df.schema), "id")
    assert sorted((r["id"], r["line"]) for r in up.collect()) == [(1, 1), (2, 5), (3, 1)]
    names = spark.createDataFrame([("a", f"epoch{n}.pth") for n in (2, 9, 10, 11)], "g string, name string")
    assert sorted(r["name"] for r in L.kept_checkpoints(names, "g", "name", 2).collect()) == ["epoch10.pth", "epoch11.pth"]
    assert L.epoch_order(spark.range(10), "id", 1, 1, 4).count() == 6


def test_plateau_and_ema(spark):
    losses = [3.0, 2.0, float("nan"), 1.95, 1.0, 1.0, 1.0]
    df = spark.createDataFrame([("r", i, x) for i, x in enumerate(losses)] + [("s", 0, None)], "g string, o int, x double")
    got = {r["g"]: r for r in L.plateau(df, "g", "o", "x", 0.1, 2).collect()}
    assert (got["r"]["best"], got["r"]["best_at"], got["r"]["stopped_at"]) == (2.0, 1, 3)
    assert got["s"]["best"] is None and got["s"]["stopped_at"] is None
    assert abs(spark.range(1).select(L.ema(F.array(F.lit(1.0), F.lit(float("nan")), F.lit(2.0)))).first()[0] - 1.1) < 1e-12
