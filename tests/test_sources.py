"""What readers, writers, logs and suites do at their edges; the queries of plans.files show the rest."""

import pytest
from pyspark.sql import functions as F

from patchwright.plans import files
from patchwright.sources import shared as H
from patchwright.sources import tables as T
from patchwright.streaming import logs as L


def test_lines_of_many_blocks(spark, tmp_path):
    """A file that is read in many tasks keeps its line numbers, blank lines and carriage returns; the number of lines is checked."""
    texts = [f"line {i}\r" if i % 7 else "" for i in range(5000)]
    (tmp_path / "t.txt").write_text("\n".join(texts) + "\n", newline="")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        got = {r["segment_id"]: r["text"] for r in T.lines(spark, str(tmp_path / "t.txt"), expected=5000).collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == dict(enumerate(texts))
    with pytest.raises(ValueError, match="5000 lines"):
        T.lines(spark, str(tmp_path / "t.txt"), expected=4999)


def test_metric_csv_checks_numbers(spark, tmp_path):
    (tmp_path / "m.csv").write_text("Model,Noise_Level,CHRF\nblt,0.1,40\nblt, ,41\nbpe,0.2,x\n")
    names = {"model": ["model"], "noise": ["noise", "noise_level"], "score": ["chrF++", "chrf"]}
    m = T.metric_csv(spark, str(tmp_path / "m.csv"), names)
    assert [tuple(r)[:3] for r in m.where("model = 'blt'").collect()] == [("blt", 0.1, 40.0)]
    with pytest.raises(Exception, match="isn't a number"):
        m.collect()
    with pytest.raises(ValueError, match="no column for fraction"):
        T.metric_csv(spark, str(tmp_path / "m.csv"), {"fraction": ["fraction"]})


def test_pairs_prefer_what_the_rules_say(spark):
    kind = "translation struct<en:string,english:string,mr:string>, source string, english string, target struct<mr:string,target:string,en:string>, marathi string"
    rows = [
        (("a", "z", "b"), "c", None, (None, None, None), "d"),  # nested, both filled
        (("a", "z", None), "c", None, (None, " t ", "e"), "d"),  # one side missing: flat, and of a nested column the preferred field
        (None, " ", "f", ("m", "t", "e"), None),
        (None, "g", None, (None, None, None), "h"),
        (None, "x", None, (None, None, "x"), None),  # equal sides
        (None, None, None, (None, None, None), "h"),
    ]
    got = T.pairs(spark.createDataFrame(rows, kind)).collect()
    assert [tuple(r) for r in got] == [("a", "b"), ("c", "t"), ("f", "m"), ("g", "h")]


def test_fingerprint_of_a_row_is_that_of_its_configuration(spark):
    rows = [("m\"1", "s", 3), ("é", "", None)]
    df = spark.createDataFrame(rows, "mix string, source string, most int")
    got = [r[0] for r in df.select(T.fingerprint_of(mix=F.col("mix"), source=F.col("source"), most=F.col("most"))).collect()]
    assert got[0] == T.fingerprint({"mix": "m\"1", "source": "s", "most": 3})


def test_memo_never_builds_over_what_it_cannot_read(spark, tmp_path):
    build = lambda: spark.range(3)
    folder = str(tmp_path)
    assert L.memo(spark, folder, "s", {"a": 1}, build).count() == 3
    for f in tmp_path.rglob("*.parquet"):
        f.write_bytes(b"broken")
    with pytest.raises(Exception):  # noqa: B017
        L.memo(spark, folder, "s", {"a": 1}, lambda: pytest.fail("built again"), lambda t: t.count() == 3)


def test_checkpoints_without_hypotheses(spark, tmp_path):
    (tmp_path / "epoch1.hyp.txt").write_text("a b\nc\n")
    refs = spark.createDataFrame([(0, "a b"), (1, "d")], "segment_id bigint, text string")
    paths = lambda *e: spark.createDataFrame([(f"x/epoch{k}.pth",) for k in e], "path string")
    rows = files._suite(spark, paths(2, 1), refs, str(tmp_path), strict=False).collect()
    assert [(r["checkpoint"], r["num_sentences"], round(r["ter"], 4)) for r in rows] == [("epoch1.pth", 2, 33.3333)]
    with pytest.raises(FileNotFoundError, match="epoch2"):
        files._suite(spark, paths(2, 1), refs, str(tmp_path), strict=True)
    with pytest.raises(ValueError, match="no checkpoints"):
        files._suite(spark, paths(3), refs, str(tmp_path), strict=False)
    with pytest.raises(ValueError, match="rows"):
        files._suite(spark, paths(1), refs.limit(1), str(tmp_path), strict=False)


def test_scan_summary_on_a_stream(spark, sf, tmp_path):
    """The same over a stream, batch by batch, as over the whole table."""
    r = spark.read.parquet(f"{sf}/blt_marathi_patched.parquet").select("run_name", "num_bytes", "num_patches").where("num_bytes is not null and num_patches is not null")
    r.repartition(5).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(r.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = L.scan_summary(stream, "run_name").writeStream.outputMode("complete").format("memory").queryName("scan").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {tuple(x) for x in L.finished_summary(spark.table("scan")).collect()}
    assert got == {tuple(x) for x in L.finished_summary(L.scan_summary(r, "run_name")).collect()} and got


def test_no_private_folder_on_a_cluster(spark):
    class Conf:
        def get(self, *_):
            return None

    class Context:
        master = "spark://somewhere:7077"

        def getConf(self):
            return Conf()

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(ValueError, match="checkpoint"):
        H.shared_folder(Session())
