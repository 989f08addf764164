"""Token ids, mixes and percentiles."""

import os
import random

from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from patchwright.llm import mix, ranks, tokens

needs_vocabulary = pytest.mark.skipif(not os.path.exists(tokens.VOCABULARY), reason="no vocabulary here")
TEXTS = [
    "", None, "<|endoftext|> hi", "aaaaaaaa a\x1c b c  \n\n x", "   ", " 　x y", "a" * 3000, "don't we'll I'M", "\x85 \x1f x", "वाऱ्यावर 👨‍🌾 १२३", "word " * 20_000, "\r\n\r\n a",
]


@needs_vocabulary
def test_ranks_of_byte_strings(sf):
    """A second vocabulary, of another kind of file, gives its own library's ids; a file of another kind raises."""
    tiktoken = pytest.importorskip("tiktoken")
    import base64

    import pyarrow.parquet as pq

    path = tokens.VOCABULARY_OF_MANY_LANGUAGES
    ranks_of = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    pattern = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"
    own, theirs = tokens.Merges.read(path), tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks_of, special_tokens={})
    texts = [t for t in pq.read_table(f"{sf}/documents.parquet", columns=["text"]).column(0).to_pylist() if t] + [t for t in TEXTS if t and "\x1c" not in t and "\x1f" not in t]
    chunks = own.encode(texts)
    for t, c in zip(texts, chunks):
        assert [i for x in c for i in own.cache[x]] == theirs.encode_ordinary(t)
    with pytest.raises(ValueError, match="byte-level"):
        tokens.Merges.read(path.replace("byte_bpe_multi_50k.tiktoken", "word_bpe_49k.json"))


@needs_vocabulary
def test_ids_are_those_of_the_library(spark, sf):
    library = pytest.importorskip("tokenizers").Tokenizer.from_file(tokens.VOCABULARY)
    library.encode_special_tokens = True
    texts = TEXTS + [r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    df = spark.createDataFrame([(i, t, [1]) for i, t in enumerate(texts)] + [(0, "", [1])], "doc_id bigint, text string, ids array<int>")
    got = {r["doc_id"]: r["ids"] for r in tokens.encoded(df).collect()}
    for i, t in enumerate(texts):
        assert got[i] == (library.encode(t, add_special_tokens=False).ids if t else [])
    sizes = {r["doc_id"]: r["tokens"] for r in tokens.sized(df, ["doc_id"]).collect()}
    assert sizes == {k: len(v) for k, v in got.items()}
    assert tokens.encoded(df.limit(0)).count() == 0


@needs_vocabulary
def test_cache_changes_nothing(monkeypatch):
    m = tokens.Merges.read()
    m.encode(["some words here", "and there"])
    before = dict(m.cache)
    monkeypatch.setattr(tokens, "MOST_CACHED", 0)
    m.encode(["other"])
    m.encode(["some words here", "and there"])
    assert all(m.cache[k] == v for k, v in before.items())


def test_merges_out_of_order():
    vocab = {c: i for i, c in enumerate(tokens._byte_characters())} | {"abc": 256, "bc": 257}
    with pytest.raises(ValueError):
        tokens.Merges(vocab, [("a", "bc"), ("b", "c")])


TARGETS = "mix_name string, source string, target_share double, max_repeats int, size_ratio double"


def docs(spark, rows):
    return spark.createDataFrame([(*r, "m", "s") for r in rows], "doc_id bigint, members array<string>, tokens bigint, mix_name string, source string")


def test_mix(spark):
    random.seed(6)
    rows = [(i, [random.choice("aaaaaab")], random.randint(1, 60)) for i in range(3000)] + [(9001, ["c"], 500), (9002, None, 7), (9003, ["a"], 0), (9004, ["a"], None)]
    targets = [("m", "a", 3.0, None, 1.0), ("m", "b", 6.0, 4, 1.0), ("m", "c", 1.0, 3, 1.0), ("m", "d", 0.5, 2, 1.0), ("m", "e", 0.0, 2, 1.0), ("z", "a", 0.0, 1, 0.5)]
    selection, shares = mix.mixed(docs(spark, rows), spark.createDataFrame(targets, TARGETS))
    size = {i: n for i, _, n in rows}
    picked = selection.collect()
    assert all(r["repeats"] <= {"a": 99, "b": 4, "c": 3}[r["source"]] and size[r["doc_id"]] for r in picked)
    by = {(r["mix_name"], r["source"]): r for r in shares.collect()}
    for s in "ab":
        got = sum(size[r["doc_id"]] * r["repeats"] for r in picked if r["source"] == s)
        assert got == by["m", s]["tokens"] and abs(got - by["m", s]["target_tokens"]) <= 60
    assert by["m", "c"]["tokens"] == 1500 and by["m", "d"]["tokens"] == by["m", "e"]["tokens"] == by["z", "a"]["tokens"] == 0
    assert selection.exceptAll(mix.mixed(docs(spark, rows), spark.createDataFrame(targets, TARGETS))[0]).count() == 0


def test_overlapping_sources(spark):
    assert mix.flow({("a",): 10, ("a", "b"): 10, ("b",): 2}, {"a": 10, "b": 12}, {"a": 1, "b": 1}) == {(("a",), "a"): 10, (("a", "b"), "b"): 10, (("b",), "b"): 2}
    routed = mix.flow({("a",): 10, ("b",): 1}, {"a": 35, "b": 9}, {"a": None, "b": 4})
    assert routed == {(("a",), "a"): 35, (("b",), "b"): 4}
    rows = [(i, ["a", "b"], 10) for i in range(100)] + [(1000 + i, ["a"], 10) for i in range(100)]
    selection, shares = mix.mixed(docs(spark, rows), spark.createDataFrame([("m", "a", 0.5, 1, 1.0), ("m", "b", 0.5, 1, 1.0)], TARGETS))
    assert {r["source"]: r["tokens"] for r in shares.collect()} == {"a": 1000, "b": 1000}
    assert selection.groupBy("doc_id").count().where("count > 1").count() == 0


def test_flow_of_many_copies():
    """A tiny pattern in a huge mix takes no longer, alone or beside another."""
    assert mix.flow({("a",): 10}, {"a": 10**12}, {"a": None}) == {(("a",), "a"): 10**12}
    routed = mix.flow({("a",): 10, ("a", "b"): 30}, {"a": 4 * 10**11, "b": 10}, {"a": None, "b": None})
    assert routed[("a",), "a"] + routed[("a", "b"), "a"] == 4 * 10**11 and abs(routed[("a",), "a"] / 10**11 - 1) < 0.01


def cost(patterns, routed):
    """The n-th copy of a token costs n."""
    total = 0
    for p, size in patterns.items():
        used = sum(n for (q, _), n in routed.items() if q == p)
        whole, rest = divmod(used, size)
        total += size * whole * (whole + 1) // 2 + rest * (whole + 1)
    return total


@pytest.mark.parametrize("seed", range(8))
def test_flow_against_all_flows(seed):
    """No other way of filling the quotas fills more, or as much at a lower cost."""
    rng = np.random.default_rng(seed)
    patterns = {("a",): int(rng.integers(1, 3)), ("a", "b"): int(rng.integers(1, 4)), ("b", "c"): int(rng.integers(1, 3))}
    quotas = {s: int(rng.integers(0, 6)) for s in "abc"}
    caps = {s: None if rng.random() < 0.3 else int(rng.integers(1, 4)) for s in "abc"}
    edges = [(p, s) for p in patterns for s in p]
    best = (0, 0)
    limits = [min(quotas[s], 99 if caps[s] is None else caps[s] * patterns[p]) for p, s in edges]
    for amounts in product(*(range(n + 1) for n in limits)):
        routed = dict(zip(edges, amounts))
        if all(sum(n for (_, t), n in routed.items() if t == s) <= quotas[s] for s in quotas):
            best = min(best, (-sum(amounts), cost(patterns, routed)))
    got = mix.flow(patterns, quotas, caps)
    assert (-sum(got.values()), cost(patterns, got)) == best


def test_no_documents(spark):
    selection, shares = mix.mixed(docs(spark, []), spark.createDataFrame([("m", "a", 0.5, 1, 1.0)], TARGETS))
    assert selection.count() == 0 and shares.first()["tokens"] == 0


def rank_off(values, v, q):
    x = np.sort(values)
    n = len(x)
    wanted = max(1, min(n, int(np.ceil(q * n - 1e-9))))
    lo, hi = np.searchsorted(x, v, "left") + 1, np.searchsorted(x, v, "right")
    return 0 if lo <= wanted <= hi else min(abs(wanted - lo), abs(wanted - hi))


def query(v, lo, hi, n, q):
    rank = max(1, min(n, int(np.ceil(q * n - 1e-9))))
    off = np.maximum(np.maximum(rank - lo, hi - rank), 0)
    return v[np.argmin(off)], off.min()


@pytest.mark.parametrize("seed", range(6))
def test_merged_summaries_keep_their_bound(seed):
    """Whatever the shape and the depth of the merges, no rank is off by more than epsilon."""
    rng = np.random.default_rng(seed)
    parts = [np.round(rng.normal(size=rng.integers(1, 3000)), rng.integers(0, 4)) for _ in range(20)]
    every, eps = np.concatenate(parts), (0.02, 0.05)[seed % 2]
    done = [ranks.exact(np.sort(p), eps) for p in parts]
    while len(done) > 1:
        k = rng.integers(2, 5)
        done = [*done[k:], ranks.merge(done[:k], eps)]
    v, lo, hi, n, level = done[0]
    assert n == len(every) and len(v) <= 2 ** (level + 1) / eps
    for q in (0.001, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99, 1.0):
        value, off = query(v, lo, hi, n, q)
        assert rank_off(every, value, q) <= off <= eps * n


def test_ten_thousand_parts(spark):
    """A group in very many parts goes up a tree; equal parts don't meet in one node."""
    parts = spark.range(10_000).selectExpr("'g' run", "'x' measure", "array(cast(id % 3 as double)) v", "array(1L) lo", "array(1L) hi", "1L n", "0 level", "id part")
    out = ranks.merged(parts, ["run"]).collect()
    assert len(out) == 1 and out[0]["n"] == 10_000 and len(out[0]["v"]) < 2000
    assert {r["value"] for r in ranks.percentiles(ranks.merged(parts, ["run"]), ["run"], (0.3, 0.6)).collect()} == {0.0, 1.0}


def test_percentiles(spark):
    rng = np.random.default_rng(1)
    nan = float("nan")
    rows = [("hot" if i % 3 else f"g{i % 7}", None if i % 5 == 0 else f"d{i % 4}", float(x), [int(x * 10), None], 1) for i, x in enumerate(rng.normal(size=4000))]
    rows += [("nothing", "d", None, None, 1), ("nothing", "d", nan, [], 1), (None, None, 1.5, [7], 1)]
    df = spark.createDataFrame(rows, "run string, day string, x double, a array<int>, n int").repartition(7)
    days = ranks.merged(ranks.partials(df, ["run", "day"], ["x"], ["a"]), ["run", "day"])
    out = ranks.percentiles(ranks.merged(days, ["run"]), ["run"]).collect()
    assert not any(r["run"] == "nothing" for r in out)
    assert [r["value"] for r in out if r["run"] is None and r["measure"] == "x"] == [1.5] * 6
    for run in ("hot", "g0"):
        x = np.array([r[2] for r in rows if r[0] == run])
        for r in out:
            if r["run"] == run and r["measure"] == "x":
                assert r["n"] == len(x) and rank_off(x, r["value"], r["percentile"]) <= r["rank_error"] <= ranks.EPSILON * len(x)
    few = [r for r in out if r["run"] == "g0" and r["measure"] == "a"]
    assert len(few) == 6
    assert ranks.percentiles(ranks.merged(ranks.partials(df.limit(0), ["run"], ["x"], ["a"]), ["run"]), ["run"]).count() == 0
