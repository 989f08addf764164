"""The consistent form, copies and leaks."""

import random
import re

import pytest
from pyspark.sql import functions as F

from patchwright.llm import copies, forms, leak

EXAMPLES = {
    "frοm nеаr мир χαίρε θ Δ": "from near мир χαίρε θ Δ",
    "अाणि अोला अौजार अॉफिस मासमाेर": "आणि ओला औजार ऑफिस मासमोर",
    "दु:ख 10:30 टीप: x": "दुःख 10:30 टीप: x",
    "वार्‍यावर": "वाऱ्यावर",
    "ऱ": "ऱ",
    "ड़": "ड़",
    "👨‍🌾 ✍️ he‍l­lo️": "👨‍🌾 ✍️ hello",
    "ｔｈｅ ﬁrst　a b c！": "the first a b c!",
    "résumé": "résumé",
    "“a” – ‘b’ । «c»": "“a” – ‘b’ । «c»",
    "٣ ३ 3": "٣ ३ 3",
    "a\tb\nc": "a\tb\nc",
}


@pytest.mark.parametrize("text", EXAMPLES)
def test_examples(text):
    assert forms.to_consistent(text) == EXAMPLES[text]
    assert forms.to_consistent(EXAMPLES[text]) == EXAMPLES[text]


def test_defined_results(spark):
    long = "अाणि " * 50_000
    df = spark.createDataFrame([(1, None), (2, ""), (3, long), (4, "a b"), (4, "a b")], "id bigint, t string")
    got = df.select("id", forms.consistent(F.col("t")).alias("x"), forms.words(forms.consistent(F.col("t"))).alias("w")).collect()
    by = {r["id"]: r for r in got}
    assert by[1]["x"] is None and by[1]["w"] == [] and by[2]["x"] == "" and by[2]["w"] == []
    assert by[3]["x"] == "आणि " * 50_000 and len(by[3]["w"]) == 50_000
    out = {r["rec_id"]: r["text"] for r in forms.rewritten(df, "t", "id", ["t"]).collect()}
    assert out[1] is None and out[2] == "" and out[3] == "आणि " * 50_000 and out[4] == "a b"
    case = forms.found([forms.changed(df, "t", "id", ["t"]), forms.changed(df, "t", "id", ["t"])])
    assert [tuple(r) for r in case.collect()] == [("t", 3, "t")]
    assert forms.changed(df.limit(0), "t", "id", ["t"]).count() == 0


def test_the_pattern_misses_nothing(spark):
    random.seed(7)
    odd = "аеіοѕ​‍­﻿ 　́̈ाेैोौॅअआइउएऱऱ्:ｅﬁ👨🌾✍️োৗொொ"
    texts = ["".join(random.choice(odd if random.random() < 0.3 else "abc घरi. \n") for _ in range(12)) for _ in range(3000)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    bad = [r["t"] for r in df.where(~forms.needs_work(F.col("t"))).collect() if forms.to_consistent(r["t"]) != r["t"]]
    assert bad == []
    assert all(forms.to_consistent(forms.to_consistent(t)) == forms.to_consistent(t) for t in texts[:1000])
    words = df.select("t", forms.words(forms.consistent(F.col("t"))).alias("w")).collect()
    assert all(r["w"] == forms.words_of(r["t"]) for r in words)


def pairs(spark, rows):
    """With columns whose names are used inside."""
    return spark.createDataFrame([(*r, 1, "x", "y", "z") for r in rows], "pair_id bigint, source string, target string, record int, key string, form string, copies string")


ROWS = [
    (5, "A b.", "वाघ"), (3, "वाघ!", " a  B"), (9, "a b c", "वाघ"), (7, "a", "b वाघ"), (1, None, "x"), (2, "", "X"), (4, "?", "!"), (6, None, "-"), (8, "a b", "वाघ"), (8, "a b", "वाघ"),
    (11, "a b\n", "c"), (12, "a", "b\nc"), (13, "w " * 20_000, "x"), (14, "W, " * 20_000, "x"),
]


def brute_copies(rows):
    groups = {}
    for i, s, t in rows:
        groups.setdefault(tuple(sorted([tuple(forms.words_of(s)), tuple(forms.words_of(t))])), []).append(i)
    return {(min(g), x) for g in groups.values() for x in g if x > min(g)}


def test_copies(spark):
    keys = copies.keyed(pairs(spark, ROWS))
    assert {tuple(r) for r in copies.copies(keys).collect()} == brute_copies(ROWS)
    assert {r["first_id"]: r["copies"] for r in copies.collapsed(keys).collect()}[3] == 4
    assert copies.collisions(keys).count() == 0
    empty = copies.keyed(pairs(spark, ROWS).limit(0))
    assert copies.copies(empty).count() == 0 == copies.collapsed(empty).count()


def test_a_collision_stays_apart(spark):
    keys = copies.keyed(pairs(spark, ROWS[:3])).withColumn("key", F.lit(b"same"))
    assert {tuple(r) for r in copies.copies(keys).collect()} == {(3, 5)}
    assert copies.collisions(keys).count() == 1


def test_hot_copies(spark):
    rows = [(i, "the same  text" if i % 3 == 0 else f"text {i}", "x") for i in range(900)]
    assert {tuple(r) for r in copies.copies(copies.keyed(pairs(spark, rows))).collect()} == brute_copies(rows)


def test_automaton_against_brute_force():
    random.seed(1)
    for _ in range(200):
        letters = "abc"[: random.choice([1, 2, 3])]
        texts = [(i, [random.choice(letters) for _ in range(random.randint(1, 14))]) for i in range(random.randint(1, 6))]
        least = random.choice([2, 3, 4])
        automaton = leak.Automaton(texts, least)
        for _ in range(4):
            ws = [random.choice(letters + "z") for _ in range(random.randint(0, 20))]
            own = {tuple(ws[i : i + least]): i for i in range(len(ws) - least + 1)}
            spans = automaton.spans(ws)
            assert set().union(*(s[2] for s in spans)) == {i for i, t in texts if any(tuple(t[j : j + least]) in own for j in range(len(t) - least + 1))}
            held = {tuple(t[j : j + least]) for _, t in texts for j in range(len(t) - least + 1)}
            covered = {k for i in range(len(ws) - least + 1) if tuple(ws[i : i + least]) in held for k in range(i, i + least)}
            assert {k for first, n, _ in spans for k in range(first, first + n)} == covered


def test_leaks(spark, monkeypatch):
    text = "one two three four five six seven eight nine"
    items = spark.createDataFrame([(1, text, None), (2, "", "क ख ग घ च छ ज झ"), (3, "four five", None)], "item_id bigint, a string, b string")
    rows = [(1, "say ONE, two three four five six seven eight now", None), (2, "one two three four five six seven", ""), (3, None, "क ख ग घ च छ ज झ ट"), (4, "x " * 30_000 + text, "y"), (4, "x " * 30_000 + text, "y")]
    corpus = spark.createDataFrame([(*r, "k") for r in rows], "pair_id bigint, source string, target string, item_id string")
    args = (corpus, "pair_id", ["source", "target"], items, "item_id", ["a", "b"])
    want = {(1, 1), (3, 2), (4, 1)}
    assert {(r["record"], r["item_id"]) for r in leak.leaks(*args).collect()} == want
    span = leak.leaks(*args).where("record = 1").first()
    assert (span["field"], span["first_word"], span["n_words"], span["words"]) == ("source", 1, 8, 10)
    monkeypatch.setattr(leak, "MOST_WORDS", 3)  # several automata
    assert {(r["record"], r["item_id"]) for r in leak.leaks(*args).collect()} == want
    clean = {r["record"]: r for r in leak.cleaned(*args, most_coverage=0.9).collect()}
    assert clean[1]["source"] == "say  now" and clean[1]["cut_words"] == 8 and clean[2]["cut_words"] == 0
    assert re.sub(r"\s", "", clean[4]["source"]) == "x" * 30_000
    assert {r["record"]: r["source"] for r in leak.cleaned(*args).collect()}[1] is None
    assert leak.leaks(corpus.limit(0), *args[1:]).count() == 0
    assert leak.leaks(corpus, "pair_id", ["source"], items.limit(0), "item_id", ["a"]).count() == 0


def test_many_automata(spark, monkeypatch):
    """Test items of many automata: one scan of the corpus, the same leaks, the same cuts."""
    words = [f"w{i}" for i in range(900)]
    items = spark.createDataFrame([(i, " ".join(words[20 * i : 20 * i + 20]), None) for i in range(45)], "item_id bigint, a string, b string")
    rows = [(i, " ".join(["x", "y"] * 6 + words[20 * i + 3 : 20 * i + 3 + 6 + i % 5] + ["z"] * 9), " ".join(words[20 * i : 20 * i + 20]) if i % 3 else None) for i in range(45)]
    corpus = spark.createDataFrame(rows, "pair_id bigint, source string, target string")
    args = (corpus, "pair_id", ["source", "target"], items, "item_id", ["a", "b"])
    spans = lambda: sorted(map(tuple, leak.leaks(*args).collect()))
    clean = lambda: sorted(map(tuple, leak.cleaned(*args).select("record", F.coalesce("source", F.lit("")), F.coalesce("target", F.lit("")), "cut_words").collect()))
    one, cut = spans(), clean()
    assert len(one) == 27 + 30 and {r[3] for r in one} == {8, 9, 10, 20}
    monkeypatch.setattr(leak, "MOST_WORDS", 100)
    assert leak._coded(*args[3:])[1] >= 10
    assert spans() == one and clean() == cut
