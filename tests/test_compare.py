"""Comparison tables, checked joins and file sniffing."""

import pytest
from pyspark.sql import functions as F

from patchwright.operators import compare as C
from patchwright.sources import tables as R

ROWS = [("Sys-A", 0.25, n, 40 - 50 * n, i) for i, n in enumerate((0.0, 0.1, 0.2))] + [("sys_b", 0.25, n, 44 - 50 * n, 9 + i) for i, n in enumerate((0.0, 0.1, 0.2))]


@pytest.fixture
def cells(spark):
    return spark.createDataFrame([*ROWS, ("sys_a", 0.25, 0.0, 41.0, 50), ("sys_b", 0.5, 0.0, 1.0, 51)], "model string, fraction double, noise double, score double, line int")


def test_curve(cells):
    got = [tuple(r) for r in C.curve(cells.where("line < 50"), ["sys_a", "sys_b"], [0, 0.1, 0.2], "score", "line").collect()]
    assert len(got) == 6 and got[0] == ("sys_a", 0.0, 40.0) and got[-1][:2] == ("sys_b", 0.2)
    with pytest.raises(ValueError, match="sys_b@0.1"):
        C.curve(cells.where("not (model = 'sys_b' and noise = 0.1)"), ["sys_a", "sys_b"], [0, 0.1, 0.2], "score", "line")


def test_pivot(cells):
    got = {r["noise"]: r.asDict() for r in C.metric_pivot(cells.where("not (model = 'sys_b' and noise = 0.2)"), 0.25, ["sys_a", "sys_b"], ["score"], "line").collect()}
    assert got[0.0] == {"noise": 0.0, "models_present": "sys_a;sys_b", "sys_a_score": 41.0, "sys_b_score": 44.0}
    assert got[0.2]["sys_b_score"] is None and got[0.2]["models_present"] == "sys_a"
    with pytest.raises(ValueError, match="sys_b@0.2"):
        C.metric_pivot(cells.where("not (model = 'sys_b' and noise = 0.2)"), 0.25, ["sys_a", "sys_b"], ["score"], "line", strict=True)


def test_significance(spark):
    ask = lambda d, p, same: tuple(spark.range(1).select(C.significance(F.lit(d), F.lit(p).cast("double"), F.lit(same)).alias("s")).first()["s"])
    assert ask(1e-7, 0.0001, False) == (False, "no measurable difference; p-value not meaningful")
    assert ask(0.0, 0.0001, True) == (False, "identical output to the baseline")
    assert ask(1.0, 0.01, False) == (True, "") and ask(1.0, None, False) == (False, "")


def test_best_row(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", float("nan")), ("c", 3.0), ("d", None)], "k string, m double")
    assert C.best_row(df, "m").first()["k"] == "c"


def test_checked_joins(spark):
    a, b = spark.range(3), spark.range(4).withColumn("x", F.lit(1))
    with pytest.raises(ValueError, match="3 and 4"):
        C.zipped(a, b, "id")
    assert C.zipped(a, b, "id", truncate=True).count() == 3
    assert C.subset(b, a, "id").count() == 3
    with pytest.raises(ValueError, match="out of range: 3"):
        C.subset(a, b.select("id"), "id")


def test_history(spark):
    df = spark.createDataFrame([(1, [3.0, 1.0, 2.0]), (2, [])], "id int, l array<double>")
    assert [tuple(r)[2:] for r in C.history_rollup(df, "l").orderBy("id").collect()] == [(2.0, 1.0, 3), (None, None, 0)]


def test_sniff(spark, tmp_path):
    for name, raw in {"a.txt": b"\0", "b.bin": b"x", "c": "मुला".encode(), "d": b"a\0b", "e": b"\xff\xfe\xfa\xfb\xfc", "f": ("x" * 8190 + "मुला").encode()}.items():
        (tmp_path / name).write_bytes(raw)
    got = {r["path"].rsplit("/", 1)[1]: r["is_text"] for r in R.sniffed(spark, str(tmp_path)).collect()}
    assert got == {"a.txt": True, "b.bin": False, "c": True, "d": False, "e": False, "f": True}


def test_summary_and_language(spark, tmp_path):
    (tmp_path / "s.json").write_text('{"classes": {"noun": {"fertility_lambda": 1.5, "num_words": 2}}}')
    assert [tuple(r) for r in R.fertility_summary(spark, str(tmp_path / "s.json")).collect()] == [("noun", 1.5, 2)]
    panel = {"mar_Deva": ["mr", "mar", "marathi"]}
    assert [R.language(x, panel) for x in ("mr", "Marathi", "mar_Deva")] == ["mar_Deva"] * 3
    for bad in ("", "xx"):
        with pytest.raises(ValueError):
            R.language(bad, panel)


def test_suite_covers_the_grid(spark, sf):
    from patchwright.plans import quality as Q

    cells = lambda df, *cols: {(r["seed"], r["noise"]): tuple(round(r[c], 5) for c in cols) for r in df.collect()}
    suite, edits = Q.metric_suite(spark, sf), Q.edit_metrics_by_noise(spark, sf)
    assert set(cells(suite)) == {(s, n) for s in Q.SEEDS for n in Q.NOISES}
    for name, other in (("chrfpp", Q.chrfpp_by_noise), ("bleu", Q.bleu_by_noise)):
        want = cells(other(spark, sf), name)
        assert all(abs(v[0] - want[k][0]) < 2e-5 for k, v in cells(suite, name).items())
    assert cells(suite, "ter", "meteor") == cells(edits, "ter", "meteor")
