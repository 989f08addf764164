"""Near-duplicate records: a chosen-path join on sets of words.

Two records are linked if the sets of distinct words of both their sides have a Jaccard similarity of
at least 4/5. Comparing all pairs is out of the question, so every set walks down paths of its own tokens:
at a node it takes the few tokens with the smallest hash of (path, token), weighted against common
tokens; two similar sets share most tokens, so they take the same ones and meet again one step deeper. A
path ends once the frequencies of its tokens make its bucket small; the pairs of a bucket are then compared
by brute force, through a 128-bit parity sketch that bounds the symmetric difference from below and so
loses no pair. A bucket that came out large all the same is split further down the tree; what can't be
split after ``MORE_ROUNDS`` is compared in blocks, spread over tasks. All pairs left are verified on
their token sets.

Recall: runs (trees with other seeds) are repeated until the estimated recall reaches TARGET_RECALL. Each verified
pair has a known probability of being met in a run (``met``, from the weights of the tokens it shares and
doesn't, and the deepest path that any bucket of the run was split to); a pair met with probability p
stands for 1/p pairs, so the pairs not met are estimated from all that were, whatever the corpus is like.

What is gathered at one place is bounded: token frequencies are counted in SLOTS slots over all records
(a token's slot may hold others as well; that changes which tokens are taken, alike for every record, not
which pairs are found), and a bucket holds at most LIMIT sets. Paths that hold much of a run are known before
the shuffle from one set in SAMPLE, chosen by hash: at most MOST_HOT of them, whose sets are spread over all tasks and
split further instead of being gathered. That decides only which task a set goes to.

The operator's own result are links between classes (a class is a set of words in one sequence, with all its copies)
and the members of the linked classes; ``groups`` gives a row for every record. ``id_pairs`` expands them to pairs of
ids, for those who need them: as many rows as there are pairs, which a class of many copies squares.

Defined results: a null or empty side has no words; records without any words are similar to none;
repeated ids and repeated rows give one link; an empty table gives no links; very long texts are taken
whole; other columns aren't read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bits import BITS, is_set, marked
from .forms import consistent, words
from .workspace import dropped, written

#: A set and its partner share at least SHARED of the size of the larger.
NUM, DEN = 4, 5
TARGET_RECALL = 0.997
FANOUT = (5, 2, 1, 1)
#: Sets that a path's bucket should hold by its tokens' frequencies, and those it may hold before it is split further.
EXPECTED = 8
LIMIT = 512
MORE_ROUNDS = 3
SLOTS = 1 << 17
STEPS = 1_500_000
#: One set in so many shows which paths are hot: those with HOT or more of its entries, and at most MOST_HOT.
SAMPLE, HOT, MOST_HOT = 64, 64, 20_000
#: The weight of a token in (nearly) every set; one in 55 sets or fewer weighs 1.
LEAST_WEIGHT = 0.5
_C1, _C2, _C3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
#: The steps of the walk with as many further rounds as buckets may be split.
DEEPER = FANOUT[:2]


def met(similarity: np.ndarray | float, rounds: int = 0, runs: int = 1) -> np.ndarray:
    """The probability that a pair of this similarity (of weights) ends in a common bucket, at the deepest path of so many rounds."""
    alive = np.ones_like(np.asarray(similarity, np.float64))
    for k in reversed((*FANOUT, *(DEEPER * rounds))):
        alive = 1 - (1 - similarity * alive) ** k
    return 1 - (1 - alive) ** runs


def prepared(pairs: DataFrame, record: str = "pair_id", source: str = "source", target: str = "target") -> DataFrame:
    """id, tokens (sorted 64-bit hashes of the distinct words), set_key, seq_key (equal for copies), written."""
    sides = pairs.select(
        F.col(record).cast("bigint").alias("id"), words(consistent(F.col(source))).alias("s"), words(consistent(F.col(target))).alias("t")
    )
    one, other = F.xxhash64(F.lit(7), "s"), F.xxhash64(F.lit(7), "t")
    out = sides.select(  # a filter here, or the set key, would bring the words in twice
        "id",
        F.array_sort(F.transform(F.array_distinct(F.concat("s", "t")), lambda w: F.xxhash64(w))).alias("tokens"),
        F.xxhash64(F.least(one, other), F.greatest(one, other)).alias("seq_key"),
    )
    return written(out, "near-sets").withColumn("set_key", F.xxhash64("tokens"))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _C2
    x = (x ^ (x >> np.uint64(27))) * _C3
    return x ^ (x >> np.uint64(31))


def _slot(tokens: np.ndarray) -> np.ndarray:
    return ((tokens * _C1) >> np.uint64(64 - int(math.log2(SLOTS)))).astype(np.int64)


def slot_counts(sets: DataFrame) -> np.ndarray:
    """Records by slot of token: SLOTS numbers, whatever the size of the corpus."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SLOTS, np.int64)
        for b in batches:
            total += np.bincount(_slot(b.column(0).flatten().to_numpy(zero_copy_only=False).view(np.uint64)), minlength=SLOTS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["slot", "n"])

    rows = sets.select("tokens").mapInArrow(count, "slot bigint, n bigint").groupBy("slot").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(SLOTS, np.int64)
    out[rows["slot"].to_numpy(np.int64)] = rows["n"].to_numpy(np.int64)
    return out


def sketches(tokens: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Parities of 128 bins for each set; two sets differ in no more bins than tokens. No set is empty."""
    h = _mix(tokens)
    bit = np.uint64(1) << (h & np.uint64(63))
    high = (h & np.uint64(64)) != 0
    zero = np.uint64(0)
    return (np.bitwise_xor.reduceat(np.where(high, zero, bit), starts), np.bitwise_xor.reduceat(np.where(high, bit, zero), starts))


def _walk(tokens: np.ndarray, starts: np.ndarray, lens: np.ndarray, paths: np.ndarray, owner: np.ndarray, logs: np.ndarray, fanout: tuple[int, ...], ln_f: np.ndarray, inv_w: np.ndarray, end: float) -> tuple[np.ndarray, np.ndarray]:
    """Nodes (path, owner, log frequency) walk down; the paths they end at, and their owners."""
    ended_path, ended_owner = [], []
    taken: list[np.ndarray] = []
    for depth, k in enumerate(fanout):
        if not len(paths):
            break
        nxt = []
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(np.cumsum(lens[owner]) // STEPS)) + 1, [len(paths)]])
        for a, b in zip(cuts[:-1], cuts[1:]):
            if a == b:
                continue
            own, m = owner[a:b], lens[owner[a:b]]
            first = np.concatenate([[0], np.cumsum(m)[:-1]])
            t = tokens[np.repeat(starts[own] - first, m) + np.arange(m.sum())]
            score = (_mix(t ^ np.repeat(paths[a:b], m)) >> np.uint64(11)).astype(np.float64) * inv_w[_slot(t)]
            for old in taken:
                score[t == np.repeat(old[a:b], m)] = np.inf
            for _ in range(k):
                least = np.minimum.reduceat(score, first)
                at = np.flatnonzero(score == np.repeat(least, m))
                node = np.searchsorted(first, at, side="right") - 1
                at, node = at[np.concatenate([[True], np.diff(node) > 0])], np.unique(node)
                live = np.isfinite(least[node])
                at, node = at[live], node[live]
                score[at] = np.inf
                chosen = t[at]
                nxt.append((node + a, chosen, _mix(paths[a:b][node] * _C1 + chosen), logs[a:b][node] + ln_f[_slot(chosen)]))
        node, chosen, path, log = (np.concatenate(x) for x in zip(*nxt))
        own = owner[node]
        go = (log > end) & (lens[own] > depth + 1) & (depth + 1 < len(fanout))
        ended_path.append(path[~go])
        ended_owner.append(own[~go])
        taken = [x[node][go] for x in taken] + [chosen[go]]
        paths, owner, logs = path[go], own[go], log[go]
    return np.concatenate(ended_path), np.concatenate(ended_owner)


ENTRY = "path bigint, set_key bigint, n int, bits_a bigint, bits_b bigint"


def _entries(path: np.ndarray, own: np.ndarray, keys: np.ndarray, lens: np.ndarray, bits: tuple[np.ndarray, np.ndarray]) -> pa.RecordBatch:
    cols = [path.view(np.int64), keys[own], lens[own].astype(np.int32), bits[0][own].view(np.int64), bits[1][own].view(np.int64)]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["path", "set_key", "n", "bits_a", "bits_b"])


def _weights(counts: np.ndarray, records: int) -> tuple[np.ndarray, np.ndarray, float]:
    ln_f = np.log(np.maximum(counts, 1) / max(records, 1))
    return ln_f, 1 / np.clip(-ln_f / 4, LEAST_WEIGHT, 1), math.log(EXPECTED / max(records, 1))


def entries(sets: DataFrame, counts: np.ndarray, records: int, run: int) -> DataFrame:
    """Where the paths of every set end in one run, with the set's sketch."""
    held = sets.sparkSession.sparkContext.broadcast(counts)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ln_f, inv_w, end = _weights(held.value, records)
        for b in batches:
            keys = b.column(1).to_numpy(zero_copy_only=False)
            some = np.flatnonzero(b.column(0).value_lengths().to_numpy(zero_copy_only=False) > 0)
            keys, once = np.unique(keys[some], return_index=True)  # copies walk alike
            column = b.column(0).take(pa.array(some[once]))
            tokens = column.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
            lens = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            if not len(lens):
                continue
            starts = np.concatenate([[0], np.cumsum(lens)[:-1]])
            bits = sketches(tokens, starts)
            seed = np.full(len(lens), _mix(np.array([run + 1], np.uint64) * _C1)[0])
            yield _entries(*_walk(tokens, starts, lens, seed, np.arange(len(lens)), np.zeros(len(lens)), FANOUT, ln_f, inv_w, end), keys, lens, bits)

    return sets.select("tokens", "set_key").mapInArrow(emit, ENTRY)


def _deeper(large: DataFrame, sets: DataFrame, counts: np.ndarray, records: int) -> DataFrame:
    """The entries of large buckets, two more steps down the tree."""
    held = sets.sparkSession.sparkContext.broadcast(counts)
    wanted = large.select("set_key").distinct()
    tokens = _among(sets.select("set_key", "tokens"), wanted).join(wanted, "set_key", "left_semi").groupBy("set_key").agg(F.first("tokens").alias("tokens"))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ln_f, inv_w, _ = _weights(held.value, records)
        for b in batches:
            if not b.num_rows:
                continue
            flat = b.column(0).flatten().to_numpy(zero_copy_only=False).view(np.uint64)
            lens = b.column(0).value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            starts = np.concatenate([[0], np.cumsum(lens)[:-1]])
            path = b.column(2).to_numpy(zero_copy_only=False).view(np.uint64)
            walked = _walk(flat, starts, lens, path, np.arange(len(lens)), np.zeros(len(lens)), DEEPER, ln_f, inv_w, -math.inf)
            yield _entries(*walked, b.column(1).to_numpy(zero_copy_only=False), lens, sketches(flat, starts))

    return large.select("path", "set_key").join(tokens, "set_key").select("tokens", "set_key", "path").mapInArrow(emit, ENTRY)


def _close(n_a: np.ndarray, n_b: np.ndarray, a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Whether the sketches allow the similarity: the differing bins are no more than the differing tokens."""
    differ = sum(np.bitwise_count((x ^ y).view(np.uint64)).astype(np.int64) for x, y in zip(a, b))
    n_a, n_b = n_a.astype(np.int64), n_b.astype(np.int64)
    return (differ * (NUM + DEN) <= (n_a + n_b) * (DEN - NUM)) & (DEN * np.minimum(n_a, n_b) >= NUM * np.maximum(n_a, n_b))


OUT = "kind int, a bigint, b bigint, n int, bits_a bigint, bits_b bigint"


def _out(kind: int, *cols: np.ndarray) -> pa.RecordBatch:
    n = len(cols[0])
    given = [*cols, *(np.zeros(n, np.int64) for _ in range(5 - len(cols)))]
    kinds = [np.int64, np.int64, np.int32, np.int64, np.int64]
    arrays = [pa.array(np.full(n, kind, np.int32)), *(pa.array(c.astype(k)) for c, k in zip(given, kinds))]
    return pa.RecordBatch.from_arrays(arrays, names=["kind", "a", "b", "n", "bits_a", "bits_b"])


def compared(sorted_entries: Iterator[pa.RecordBatch], limit: int, hot: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
    """Entries sorted by path -> kind 0: candidate pairs of sets (a < b); kind 1: the entries (path, set) of hot paths (sorted) and of buckets beyond the limit."""
    names = ["path", "set_key", "n", "bits_a", "bits_b"]
    held = None
    overflowing = None  # the path whose entries are being passed on

    def work(c: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
        first = np.concatenate([[True], np.diff(c["path"]) != 0])
        bucket = np.cumsum(first) - 1
        size = np.bincount(bucket)[bucket]
        big = size > limit
        if hot is not None and len(hot):
            big |= hot[np.minimum(np.searchsorted(hot, c["path"]), len(hot) - 1)] == c["path"]
        if overflowing is not None:
            big |= c["path"] == overflowing
        if big.any():
            yield _out(1, *(c[x][big] for x in names))
            c = {k: v[~big] for k, v in c.items()}
        pairs = []
        left = np.arange(len(c["path"]))
        for d in range(1, limit):
            left = left[left + d < len(c["path"])]
            left = left[c["path"][left] == c["path"][left + d]]
            if not len(left):
                break
            i, j = left, left + d
            ok = _close(c["n"][i], c["n"][j], [c["bits_a"][i], c["bits_b"][i]], [c["bits_a"][j], c["bits_b"][j]])
            x, y = c["set_key"][i[ok]], c["set_key"][j[ok]]
            pairs.append(np.stack([np.minimum(x, y), np.maximum(x, y)]))
        if pairs:
            both = np.unique(np.concatenate(pairs, axis=1), axis=1)
            both = both[:, both[0] != both[1]]
            yield _out(0, both[0], both[1])

    for b in sorted_entries:
        c = {x: b.column(i).to_numpy(zero_copy_only=False) for i, x in enumerate(names)}
        if held is not None:
            c = {k: np.concatenate([held[k], v]) for k, v in c.items()}
        if not len(c["path"]):
            continue
        fresh = np.concatenate([[True], (np.diff(c["path"]) != 0) | (np.diff(c["set_key"]) != 0)])
        c = {k: v[fresh] for k, v in c.items()}
        at = np.searchsorted(c["path"], c["path"][-1], side="left")
        done = {k: v[:at] for k, v in c.items()}
        held = {k: v[at:] for k, v in c.items()}
        if at:
            yield from work(done)
        if len(held["path"]) > limit:  # pass it on now; what follows of this path goes after it
            overflowing = held["path"][0]
            yield from work(held)
            held = None
    if held is not None and len(held["path"]):
        yield from work(held)


def _hot(layer: DataFrame) -> np.ndarray:
    """The hot paths of a sampled layer, sorted; at most MOST_HOT."""
    sizes = layer.groupBy("path").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= HOT)
    return np.sort(sizes.orderBy(F.desc("n"), "path").limit(MOST_HOT).select("path").toPandas()["path"].to_numpy(np.int64))


def _bucketed(layer: DataFrame, hot: np.ndarray) -> DataFrame:
    """Buckets, compared; the sets of hot paths are spread over all tasks, by a key of their own each."""
    held = layer.sparkSession.sparkContext.broadcast(hot)
    placed = layer
    if len(hot):
        names = layer.sparkSession.createDataFrame([(int(x), True) for x in hot], "path bigint, hot boolean")
        placed = layer.join(F.broadcast(names), "path", "left").withColumn("place", F.when(F.col("hot"), F.xxhash64("path", "set_key")).otherwise(F.col("path"))).drop("hot")
    place = "place" if len(hot) else "path"
    return placed.repartition(place).sortWithinPartitions("path", "set_key").select("path", "set_key", "n", "bits_a", "bits_b").mapInArrow(lambda batches: compared(batches, LIMIT, held.value), OUT)


def _in_blocks(large: DataFrame) -> DataFrame:
    """Buckets that the tree can't split: blocks of at most about LIMIT sets, every two blocks of a bucket in one group."""
    sizes = large.groupBy("path").agg(F.ceil(F.count(F.lit(1)) / F.lit(max(1, LIMIT // 2))).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("set_key", F.lit(3)), F.col("blocks")).cast("int")
    placed = large.join(sizes, "path").withColumn("own", own)
    spread = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    path = F.xxhash64("path", F.least("own", "other"), F.greatest("own", "other"))
    return spread.select(path.alias("path"), "set_key", "n", "bits_a", "bits_b")


def candidates(sets: DataFrame, counts: np.ndarray, records: int, run: int = 0) -> tuple[DataFrame, int]:
    """(a, b: pairs of set keys that met in a bucket and whose sketches allow the similarity; rounds of splitting it took)."""
    sampled = lambda df: df.where(F.pmod(F.xxhash64("set_key", F.lit(5)), F.lit(SAMPLE)) == 0)
    found, grown, more = [], lambda pick: entries(pick(sets), counts, records, run), 0
    while True:
        out = written(_bucketed(grown(lambda df: df), _hot(grown(sampled))), f"near-buckets-{run}-{more}")
        found.append(out.where("kind = 0").select("a", "b"))
        large = out.where("kind = 1").select(F.col("a").alias("path"), F.col("b").alias("set_key"), "n", "bits_a", "bits_b")
        if large.isEmpty():
            break
        if more == MORE_ROUNDS:
            rest = _in_blocks(large).repartition("path").sortWithinPartitions("path", "set_key")
            found.append(rest.mapInArrow(lambda batches: compared(batches, 1 << 30), OUT).where("kind = 0").select("a", "b"))
            break
        more += 1
        grown = lambda pick, large=large: _deeper(pick(large), sets, counts, records)
    pairs = found[0]
    for x in found[1:]:
        pairs = pairs.unionByName(x)
    return pairs.distinct(), more


def _among(sets: DataFrame, ends: DataFrame) -> DataFrame:
    """The sets whose keys may be among the ends: most of those that aren't stay out of the shuffle that finds out."""
    held = sets.sparkSession.sparkContext.broadcast(marked(ends, F.shiftrightunsigned("set_key", 64 - (BITS.bit_length() - 1))))

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = held.value
        for b in batches:
            bit = b.column(0).to_numpy(zero_copy_only=False).view(np.uint64) >> np.uint64(64 - (BITS.bit_length() - 1))
            yield b.filter(pa.array(is_set(own, bit.astype(np.int64))))

    return sets.mapInArrow(look, sets.schema)


def verified(pairs: DataFrame, sets: DataFrame, counts: np.ndarray, records: int) -> DataFrame:
    """a, b, similarity (of weights, as the walk sees it) of the pairs that are similar on their token sets."""
    ends = pairs.select(F.explode(F.array("a", "b")).alias("set_key")).distinct()
    tokens = _among(sets.select("set_key", "tokens"), ends).join(ends, "set_key", "left_semi").groupBy("set_key").agg(F.first("tokens").alias("tokens"))
    common = F.array_intersect("tokens_a", "tokens_b")
    sure = (
        pairs.join(tokens.select(F.col("set_key").alias("a"), F.col("tokens").alias("tokens_a")), "a")
        .join(tokens.select(F.col("set_key").alias("b"), F.col("tokens").alias("tokens_b")), "b")
        .select("a", "b", "tokens_a", "tokens_b", common.alias("common"))
        .where((NUM + DEN) * F.size("common") >= NUM * (F.size("tokens_a") + F.size("tokens_b")))
    )
    held = sets.sparkSession.sparkContext.broadcast(counts)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight = 1 / _weights(held.value, records)[1]

        def total(column: pa.ListArray) -> np.ndarray:
            flat, sizes = column.flatten().to_numpy(zero_copy_only=False).view(np.uint64), column.value_lengths().to_numpy(zero_copy_only=False)
            return np.add.reduceat(weight[_slot(flat)], np.cumsum(sizes) - sizes)  # no set is empty

        for b in batches:
            if b.num_rows:
                x, y, c = (total(b.column(i)) for i in (2, 3, 4))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(c / (x + y - c))], names=["a", "b", "similarity"])

    return sure.mapInArrow(weigh, "a bigint, b bigint, similarity double")


def missing(similarities: DataFrame, rounds: int, runs: int) -> tuple[int, float]:
    """(pairs met, estimate of those that weren't): a pair met with probability p stands for (1 - p) / p others."""
    cells = similarities.groupBy(F.floor(F.col("similarity") * 1000).cast("int").alias("s")).agg(F.count(F.lit(1)).alias("n")).collect()  # 1001 rows at most
    s, n = np.array([r["s"] for r in cells]) / 1000, np.array([r["n"] for r in cells], np.int64)
    p = met(s, rounds, runs)
    return int(n.sum()), float((n * (1 - p) / p).sum())


def similar(sets: DataFrame) -> DataFrame:
    """a, b: the pairs of set keys that are similar, from as many runs as the target recall takes."""
    counts, records = slot_counts(sets), sets.count()
    known, runs, rounds = None, 0, 0
    while True:
        pairs, more = candidates(sets, counts, records, runs)
        runs, rounds = runs + 1, max(rounds, more)
        pairs = written(pairs if known is None else pairs.join(known, ["a", "b"], "left_anti"), "near-candidates")
        found = written(verified(pairs, sets, counts, records), "near-similar")
        dropped(pairs)
        known = found if known is None else written(known.unionByName(found), "near-similar")
        n, lost = missing(known, rounds, runs)
        if lost <= (1 - TARGET_RECALL) * (n + lost):
            return known.select("a", "b")


def links(sets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(links between classes, members): a class is a set of words in one sequence, key (set_key, seq_key).

    links: set_a, seq_a, set_b, seq_b, each link once; members: set_key, seq_key, id of the linked classes."""
    sure = similar(sets)
    ends = sure.select(F.explode(F.array("a", "b")).alias("set_key")).distinct()
    orders = sets.groupBy("set_key").agg(F.min("seq_key").alias("lo"), F.max("seq_key").alias("hi")).where("lo <> hi").select("set_key")
    members = written(_among(sets.select("set_key", "seq_key", "id"), ends.unionByName(orders)).join(ends.unionByName(orders).distinct(), "set_key", "left_semi"), "near-members")
    classes = members.select("set_key", "seq_key").distinct()
    left = classes.select(F.col("set_key").alias("set_a"), F.col("seq_key").alias("seq_a"))
    right = classes.select(F.col("set_key").alias("set_b"), F.col("seq_key").alias("seq_b"))
    between = sure.join(left, sure.a == left.set_a).join(right, sure.b == right.set_b)
    within = left.join(right, left.set_a == right.set_b).where("seq_a < seq_b")
    cols = ["set_a", "seq_a", "set_b", "seq_b"]
    return written(between.select(cols).unionByName(within.select(cols)), "near-links"), members


def id_pairs(linked: tuple[DataFrame, DataFrame]) -> DataFrame:
    """id_a < id_b for all members of linked classes."""
    pairs, members = linked
    side = lambda x: members.select(F.col("set_key").alias(f"set_{x}"), F.col("seq_key").alias(f"seq_{x}"), F.col("id").alias(f"id_{x}"))
    both = pairs.join(side("a"), ["set_a", "seq_a"]).join(side("b"), ["set_b", "seq_b"]).where("id_a <> id_b")
    return both.select(F.least("id_a", "id_b").alias("id_a"), F.greatest("id_a", "id_b").alias("id_b")).distinct()


def groups(sets: DataFrame, linked: tuple[DataFrame, DataFrame]) -> DataFrame:
    """A row for every record: id, group_id (the smallest id of the group), links (classes linked to the record's).

    A group holds the copies of a record and what is connected to them by links, found by alternating large-star and
    small-star steps on the links of classes until nothing changes; a record without any is a group of its own. Records without words are copies."""
    pairs, _ = linked
    name = lambda x: F.struct(F.col(f"set_{x}").alias("s"), F.col(f"seq_{x}").alias("q"))
    both = pairs.select(name("a").alias("u"), name("b").alias("v"))
    degree = both.select(F.explode(F.array("u", "v")).alias("c")).groupBy("c").agg(F.count(F.lit(1)).alias("links"))
    edges, before = both, None
    while True:
        around = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = around.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = around.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(least, "u")
        shorter = written(
            small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct(),
            "near-stars",
        )
        dropped(edges)
        edges = shorter
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    root = edges.select(F.col("u").alias("c"), F.col("v").alias("root"))
    named = sets.select(F.struct(F.col("set_key").alias("s"), F.col("seq_key").alias("q")).alias("c"), "id")
    rooted = named.join(degree, "c", "left").join(root, "c", "left").select("id", F.coalesce("root", "c").alias("root"), F.coalesce("links", F.lit(0)).alias("links"))
    rooted = written(rooted, "near-roots")
    ids = rooted.groupBy("root").agg(F.min("id").alias("group_id"))
    return rooted.join(ids, "root").select("id", "group_id", "links")
