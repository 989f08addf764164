"""Sources mixed to target shares of a total size, with capped repetition.

Method: documents are aggregated by membership pattern (the set of sources a document belongs to; one source
for most). A min-cost flow routes the patterns' tokens to the sources' quotas: a pattern's n-th copy costs n
per token, so repetition is spread before it grows, and a source takes at most its cap of copies from a
pattern. What flows from a pattern to a source is then filled with documents in a seeded order: the tokens
of a pattern lie on a circle in that order, each source takes the stretch that follows the one before it,
and a document is taken as often as its middle lies in the stretch. So no size is off by more than half a
document at either end of a stretch.

Positions on the circle come from sums in two steps (by bucket of the seeded hash, then within a bucket of about
IN_BUCKET documents), so no task sorts more than a bucket of a pattern, however large a source is.

Defined results: a quota that the caps don't allow is filled as far as they go, and the shares report it; it
is not moved to other sources. Shares count in proportion; if all are 0, nothing is selected. A source
without documents and one with a share of 0 appear in the shares with 0 tokens. Documents without tokens (null
and empty texts) and of sources outside the mix aren't selected. Repeated rows count as documents of
their own. Empty tables give empty selections and shares.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MOST_PATTERNS = 5_000
#: Documents that a bucket of the seeded order should hold, and how many buckets there are at least.
IN_BUCKET, LEAST_BUCKETS = 20_000, 4_096

Pattern = tuple[str, ...]


class _Flow:
    """What flows from patterns to sources, the quotas left, and paths to a quota that isn't filled."""

    def __init__(self, patterns: dict[Pattern, int], quotas: dict[str, int], caps: dict[str, int | None]):
        self.size, self.caps = patterns, caps
        self.out = {(p, s): 0 for p in sorted(patterns) for s in p if s in quotas}
        self.left = dict(quotas)
        self.into: dict[str, list[Pattern]] = {}
        for p, s in self.out:
            self.into.setdefault(s, []).append(p)

    def room(self, p: Pattern, s: str) -> int:
        return 1 << 62 if self.caps[s] is None else self.caps[s] * self.size[p] - self.out[p, s]

    def path(self, start: Pattern) -> list[tuple[Pattern, str]] | None:
        """A shortest way from a pattern to a source with quota left: steps forth over (pattern, source), and back from that source
        to another pattern that flows into it."""
        queue, how = [start], {start: None}
        for p in queue:
            for s in p:
                if s in self.left and s not in how and self.room(p, s) > 0:
                    how[s] = p
                    if self.left[s] > 0:
                        steps = [(p, s)]
                        while how[p] is not None:
                            s = how[p]
                            p = how[s]
                            steps.append((p, s))
                        return steps[::-1]
                    for q in self.into[s]:
                        if q not in how and self.out[q, s] > 0:
                            how[q] = s
                            queue.append(q)
        return None

    def push(self, start: Pattern, amount: int) -> int:
        """Send up to so many tokens of a pattern; returns how many went."""
        sent = 0
        while sent < amount and (steps := self.path(start)):
            n = min(amount - sent, self.left[steps[-1][1]], *(self.room(p, s) for p, s in steps), *(self.out[q, s] for (_, s), (q, _) in zip(steps, steps[1:])))
            for p, s in steps:
                self.out[p, s] += n
            for (_, s), (q, _) in zip(steps, steps[1:]):
                self.out[q, s] -= n
            self.left[steps[-1][1]] -= n
            sent += n
        return sent


def flow(patterns: dict[Pattern, int], quotas: dict[str, int], caps: dict[str, int | None]) -> dict[tuple[Pattern, str], int]:
    """Tokens from each pattern to each source: the most that quotas and caps allow, at the least convex cost of copies.

    A path's cost is the copy its pattern is at, all else is free; so successive shortest paths send all first copies that can
    go, then all second ones, and so on, and a pattern that can't send a copy whole never can again. Levels are taken many at
    a time, as many as all patterns can send whole (doubled while they can), so the number of copies doesn't matter."""
    f = _Flow(patterns, quotas, caps)
    active, copies = [p for p in sorted(patterns) if patterns[p] > 0], 1
    while active and any(f.left.values()):
        before = (dict(f.out), dict(f.left))
        sent = {p: f.push(p, copies * patterns[p]) for p in active}
        if all(n == copies * patterns[p] for p, n in sent.items()):
            copies *= 2
        elif copies > 1:
            f.out, f.left = before
            copies //= 2
        else:
            active = [p for p in active if sent[p] == patterns[p]]
    return {k: v for k, v in f.out.items() if v}


def quotas(targets: list[dict], corpus: int) -> dict[str, int]:
    """Tokens wanted of each source of one mix."""
    total = sum(t["target_share"] or 0 for t in targets)
    return {t["source"]: round(corpus * t["size_ratio"] * (t["target_share"] or 0) / total) if total > 0 else 0 for t in targets}


def mixed(docs: DataFrame, targets: DataFrame, members: str = "members", record: str = "doc_id", size: str = "tokens", seed: int = 1) -> tuple[DataFrame, DataFrame]:
    """(selection: mix_name, source, record, repeats, tokens of one copy; shares of each mix and source).

    docs: one row for a document, its sources as an array of strings, its size. targets: mix_name, source,
    target_share, max_repeats, size_ratio."""
    spark = docs.sparkSession
    base = docs.where(F.col(size) > 0).select(
        F.col(record).alias("record"),
        F.array_sort(F.array_distinct(F.filter(F.coalesce(members, F.array().cast("array<string>")), lambda x: x.isNotNull()))).alias("pattern"),
        F.col(size).cast("bigint").alias("n"),
        F.xxhash64(F.lit(seed), record).alias("h"),
    )
    buckets = max(LEAST_BUCKETS, -(-docs.count() // IN_BUCKET))
    base = base.withColumn("bucket", F.pmod(F.shiftrightunsigned("h", 20), F.lit(buckets)).cast("int"))
    sums = base.groupBy("pattern", "bucket").agg(F.sum("n").alias("n"))
    sums = sums.withColumn("start", F.sum("n").over(Window.partitionBy("pattern").orderBy("bucket")) - F.col("n"))
    totals = sums.groupBy("pattern").agg(F.sum("n").alias("n")).limit(MOST_PATTERNS + 1).collect()
    if len(totals) > MOST_PATTERNS:
        raise ValueError(f"documents belong to their sources in more than {MOST_PATTERNS} ways")
    patterns = {tuple(r["pattern"]): r["n"] for r in totals}
    corpus = sum(patterns.values())
    flows, wanted = [], []
    by_mix: dict[str, list[dict]] = {}
    for r in targets.collect():
        by_mix.setdefault(r["mix_name"], []).append(r.asDict())
    for mix, rows in sorted(by_mix.items()):
        quota = quotas(rows, corpus)
        routed = flow(patterns, quota, {r["source"]: r["max_repeats"] for r in rows})
        at: dict[tuple[str, ...], int] = {}
        for (p, s), n in sorted(routed.items()):
            flows.append((mix, s, list(p), at.get(p, 0), n, patterns[p]))
            at[p] = at.get(p, 0) + n
        share = sum(r["target_share"] or 0 for r in rows) or 1.0
        wanted += [(mix, r["source"], float((r["target_share"] or 0) / share), quota[r["source"]], r["max_repeats"]) for r in rows]
    routes = spark.createDataFrame(flows, "mix_name string, source string, pattern array<string>, first bigint, amount bigint, total bigint")
    within = Window.partitionBy("pattern", "bucket").orderBy("h", "record")
    placed = (
        base.join(sums.select("pattern", "bucket", "start"), ["pattern", "bucket"])  # the window then needs no shuffle of its own
        .withColumn("middle", 2 * (F.col("start") + F.sum("n").over(within) - F.col("n")) + F.col("n"))
        .join(routes, "pattern")
    )
    turns = lambda end: F.expr(f"-floor((middle - 2 * ({end})) / (2 * total))")  # noqa: E731  how often the circle's point came up before end
    chosen = placed.withColumn("repeats", (turns("first + amount") - turns("first")).cast("int")).where("repeats > 0")
    selection = chosen.select("mix_name", "source", F.col("record").alias(record), "repeats", F.col("n").alias("tokens"))
    want = spark.createDataFrame(wanted, "mix_name string, source string, target_share double, target_tokens bigint, max_repeats int")
    reached = selection.groupBy("mix_name", "source").agg(
        F.sum(F.col("tokens") * F.col("repeats")).alias("tokens"), F.count(F.lit(1)).alias("documents"), F.max("repeats").alias("most_repeats")
    )
    shares = want.join(reached, ["mix_name", "source"], "left").na.fill(0, ["tokens", "documents", "most_repeats"])
    shares = shares.withColumn("share", F.round(F.try_divide("tokens", F.sum("tokens").over(Window.partitionBy("mix_name"))), 9))
    return selection, shares
