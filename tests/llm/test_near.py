"""Near-duplicates against comparison of all pairs."""

import random

import pyarrow as pa

from patchwright.llm import near
from patchwright.llm.forms import words_of

SCHEMA = "pair_id bigint, source string, target string, id int, tokens string, path string, n string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "a", "b", "c") for r in rows], SCHEMA)


def brute(rows):
    sets = [(i, set(words_of(s)) | set(words_of(t)), tuple(sorted([tuple(words_of(s)), tuple(words_of(t))]))) for i, s, t in rows]
    return {(min(i, j), max(i, j)) for x, (i, a, p) in enumerate(sets) for j, b, q in sets[:x] if i != j and p != q and a | b and 5 * len(a & b) >= 4 * len(a | b)}


def edited(rng, base, vocabulary):
    ws = list(base)
    for _ in range(rng.choice([0, 1, 1, 2, 3, 5])):
        k = rng.randrange(len(ws))
        ws[k : k + 1] = rng.choice([[], [rng.choice(vocabulary)], [ws[k], rng.choice(vocabulary)]])
    return ws or ["x"]


def corpus(seed, n, common=0.6):
    rng = random.Random(seed)
    often, rare = [f"w{i}" for i in range(60)], [f"r{i}" for i in range(5000)]
    pick = lambda: rng.choice(often if rng.random() < common else rare)
    bases = [[pick() for _ in range(rng.randint(4, 40))] for _ in range(n // 4)]
    rows = []
    for i in range(n):
        ws = edited(rng, rng.choice(bases), often + rare)
        cut = rng.randint(0, len(ws))
        rows.append((1000 + 3 * i, " ".join(ws[:cut]) or None, " ".join(ws[cut:])))
    return rows


def found(spark, rows):
    return {tuple(r) for r in near.id_pairs(near.links(near.prepared(frame(spark, rows)))).collect()}


def test_recall_and_precision(spark):
    rows = corpus(1, 1200)
    want, got = brute(rows), found(spark, rows)
    assert got <= want and len(got) >= 0.995 * len(want) > 300


def test_runs_are_repeated_until_the_target(spark, monkeypatch):
    """With one child a node a run misses many pairs; the estimate says so, and more runs follow."""
    monkeypatch.setattr(near, "FANOUT", (1, 1))
    monkeypatch.setattr(near, "DEEPER", (1, 1))
    sets = near.prepared(frame(spark, corpus(4, 800)))
    counts, records = near.slot_counts(sets), sets.count()
    one, rounds = near.candidates(sets, counts, records)
    n, lost = near.missing(near.verified(one, sets, counts, records), rounds, 1)
    want = len({(min(a, b), max(a, b)) for a, b in set_pairs(sets)})
    assert n < 0.99 * want and abs(n + lost - want) < 0.1 * want
    assert near.similar(sets).count() >= 0.99 * want


def set_pairs(sets):
    rows = {r["set_key"]: set(r["tokens"]) for r in sets.collect()}
    keys = sorted(k for k in rows if rows[k])
    return [(a, b) for i, a in enumerate(keys) for b in keys[:i] if 5 * len(rows[a] & rows[b]) >= 4 * len(rows[a] | rows[b])]


def test_met_counts_every_step():
    assert near.met(1.0) == 1 and near.met(0.8) > near.met(0.8, rounds=near.MORE_ROUNDS) > 0.9
    assert near.met(0.8, runs=2) > 0.999


def test_edges(spark):
    rows = [
        (1, None, ""), (2, "?", None), (3, "a", None), (4, "A!", "a"), (5, "a b c d", "e"), (6, "a b c d", None), (7, "d c b a", ""), (7, "d c b a", ""),
        (8, "w" + " w".join(map(str, range(30_000))), "x"), (9, "w" + " w".join(map(str, range(30_001))), "x"), (10, "a b c d", "e"),
    ]
    assert found(spark, rows) == brute(rows)
    assert found(spark, []) == set()


def test_hot_group_of_copies(spark):
    rows = [(i, "the hot text of many copies here", "x y z") for i in range(300)] + [(1000, "the hot text of many copies here now", "x y z")] + corpus(2, 100)
    assert found(spark, rows) == brute(rows)


def test_large_buckets_are_split(spark, monkeypatch):
    rng = random.Random(3)
    frame_words = [f"f{i}" for i in range(30)]
    rows = [(i, " ".join(frame_words + [f"u{rng.randrange(40)}", f"v{rng.randrange(40)}"]), "t") for i in range(150)]  # all alike: no split helps
    monkeypatch.setattr(near, "LIMIT", 8)
    want, got = brute(rows), found(spark, rows)
    assert got <= want and len(got) >= 0.999 * len(want) > 5000
    monkeypatch.setattr(near, "SAMPLE", 1)  # and with their paths known as hot before the shuffle
    monkeypatch.setattr(near, "HOT", 8)
    assert found(spark, rows) == got


def test_small_limit_keeps_the_recall(spark, monkeypatch):
    monkeypatch.setattr(near, "LIMIT", 4)
    rows = corpus(5, 1000, common=0.9)
    want, got = brute(rows), found(spark, rows)
    assert got <= want and len(got) >= 0.99 * len(want) > 200


def test_groups_of_long_chains(spark):
    """A chain that takes many steps comes out as one group."""
    words = [f"c{i}" for i in range(400)]
    rows = [(i, " ".join(words[i : i + 40]), None) for i in range(0, 300)]
    sets = near.prepared(frame(spark, rows))
    assert {r["group_id"] for r in near.groups(sets, near.links(sets)).collect()} == {0}


def test_groups(spark):
    rows = [(10, "a b c d e f g h i j", None), (11, "a b c d e f g h i x", None), (12, "a b c d e f g h y x", None), (13, "q r s", None), (9, "a b c d e f g h i j", "")]
    rows += [(14, "m n o p", "q"), (15, "Q!", "m n, o p"), (16, None, ""), (17, "?", None)]
    sets = near.prepared(frame(spark, rows))
    got = {r["id"]: (r["group_id"], r["links"]) for r in near.groups(sets, near.links(sets)).collect()}
    assert got == {9: (9, 1), 10: (9, 1), 11: (9, 2), 12: (9, 1), 13: (13, 0), 14: (14, 0), 15: (14, 0), 16: (16, 0), 17: (16, 0)}


def test_batches_cut_anywhere():
    """Buckets that go on in the next batch, repeated entries, and buckets beyond the limit."""
    entries = [(p, s, 5, s % 3, 0) for p, n in ((1, 1), (2, 3), (3, 9), (5, 2)) for s in range(n)]
    entries = sorted([*entries, entries[2]])
    want = {(a, b) for p in (2, 5) for _, a, *_ in [e for e in entries if e[0] == p] for _, b, *_ in [e for e in entries if e[0] == p] if a < b}
    for size in range(1, 8):
        batches = [pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*entries[i : i + size])], names=["path", "set_key", "n", "bits_a", "bits_b"]) for i in range(0, len(entries), size)]
        out = [r for b in near.compared(iter(batches), 4) for r in b.to_pylist()]
        assert {(r["a"], r["b"]) for r in out if r["kind"] == 0} <= want
        assert sorted(r["b"] for r in out if r["kind"] == 1) == list(range(9)) and {r["a"] for r in out if r["kind"] == 1} == {3}
