"""Evaluation texts inside training text: a generalised suffix automaton over words.

All texts of all test items make one automaton (built once on the driver, broadcast). The words of the
corpus stream through it; at each word it knows the length of the longest match that ends there. Where that
length reaches ``least`` words, the state of the last ``least`` words tells the items that hold them. Spans
go by length, records by coverage.

Size bound: an automaton takes at most MOST_WORDS words of test items; larger test sets are split by item
into several automata, so what is broadcast never grows with the test set. The corpus is read once all the same: then
a bit array (``bits``) with the hashes of all runs of ``least`` test words passes the texts that may
hold one, these are written, and each automaton runs over them alone.

Defined results: null and empty texts (of items or records) match nothing; repeated records each
get their rows; very long texts stream through whole; an empty item or corpus table gives no rows.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bits import BITS, is_set, marked
from .forms import _WORDS, consistent, to_consistent, words, words_of
from .workspace import written

MOST_WORDS = 200_000
_ODD = np.uint64(0x9E3779B97F4A7C15)


class Automaton:
    """The substrings (of words) of many texts; for each, the longest match and the items that hold it."""

    def __init__(self, texts: list[tuple[int, list[str]]], least: int):
        self.least = least
        self.vocab: dict[str, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        coded = [(item, [self.vocab.setdefault(w, len(self.vocab)) for w in ws]) for item, ws in texts]
        for _, codes in coded:
            last = 0
            for c in codes:
                last = self._extend(last, c)
        holders: list[set[int]] = [set() for _ in self.next]
        for item, codes in coded:
            at = 0
            for c in codes:
                at = self.next[at][c]
                up = at
                while up > 0 and item not in holders[up]:
                    holders[up].add(item)
                    up = self.link[up]
        #: For a state, the items that hold the last `least` words of every match ending in it.
        self.items: list[tuple[int, ...]] = []
        for s in range(len(self.next)):
            up = s
            while up > 0 and self.length[self.link[up]] >= least:
                up = self.link[up]
            self.items.append(tuple(sorted(holders[up])) if self.length[s] >= least else ())
        #: state * words + word -> next state: one flat table, sent as arrays.
        self.go = {s * len(self.vocab) + c: to for s, table in enumerate(self.next) for c, to in table.items()}
        del self.next

    def __getstate__(self) -> dict:
        n = len(self.go)
        flat = {"go": (np.fromiter(self.go.keys(), np.int64, n), np.fromiter(self.go.values(), np.int32, n))}
        return self.__dict__ | flat | {k: np.array(getattr(self, k), np.int32) for k in ("link", "length")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state | {"go": dict(zip(*(x.tolist() for x in state["go"])))} | {k: state[k].tolist() for k in ("link", "length")})

    def _extend(self, last: int, c: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        if c in nxt[last]:  # another text went this way
            q = nxt[last][c]
            return q if length[q] == length[last] + 1 else self._clone(last, c, q)
        new = self._state(length[last] + 1)
        p = last
        while p >= 0 and c not in nxt[p]:
            nxt[p][c] = new
            p = link[p]
        if p < 0:
            link[new] = 0
        else:
            q = nxt[p][c]
            link[new] = q if length[q] == length[p] + 1 else self._clone(p, c, q)
        return new

    def _state(self, length: int) -> int:
        self.next.append({})
        self.link.append(0)
        self.length.append(length)
        return len(self.next) - 1

    def _clone(self, p: int, c: int, q: int) -> int:
        copy = self._state(self.length[p] + 1)
        self.next[copy] = dict(self.next[q])
        self.link[copy], self.link[q] = self.link[q], copy
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = copy
            p = self.link[p]
        return copy

    def spans(self, ws: list[str]) -> list[tuple[int, int, set[int]]]:
        """(first word, words, items) of the maximal stretches whose every word lies in a match of at least `least` words."""
        go, link, length, vocab, items, least, size = self.go, self.link, self.length, self.vocab, self.items, self.least, len(self.vocab)
        state = matched = 0
        out: list[tuple[int, int, set[int]]] = []
        for i, w in enumerate(ws):
            c = vocab.get(w)
            if c is None:
                state = matched = 0
                continue
            to = go.get(state * size + c)
            if to is None:
                while state and to is None:
                    state = link[state]
                    to = go.get(state * size + c)
                matched = length[state]
                if to is None:
                    continue
            state = to
            matched += 1
            if matched >= least:
                # the state may stand for longer strings only; the match's own suffix of `least` words counts
                start = i - matched + 1
                if out and start <= out[-1][0] + out[-1][1]:
                    first = min(out[-1][0], start)
                    out[-1] = (first, i - first + 1, out[-1][2].union(items[state]))
                else:
                    out.append((start, matched, set(items[state])))
        return out


def _coded(items: DataFrame, item: str, texts: list[str]) -> tuple[DataFrame, int]:
    """(item, t0, t1, ...; how many automata the items take)."""
    coded = items.select(F.col(item).cast("bigint").alias("item"), *(F.col(t).alias(f"t{k}") for k, t in enumerate(texts)))
    total = coded.agg(F.sum(sum(F.coalesce(F.length(f"t{k}"), F.lit(0)) for k in range(len(texts))))).first()[0] or 0
    return coded, 1 + total // (3 * MOST_WORDS)  # a word takes more than three characters, its space counted


def automata(items: DataFrame, item: str, texts: list[str], least: int) -> Iterator[Automaton]:
    """One automaton after the other over the test items, each of at most about MOST_WORDS words."""
    coded, shards = _coded(items, item, texts)
    for shard in range(shards):
        rows = coded.where(F.pmod(F.xxhash64("item"), F.lit(shards)) == shard).collect() if shards > 1 else coded.collect()
        yield Automaton([(r["item"], ws) for r in rows for k in range(len(texts)) if (ws := words_of(r[f"t{k}"]))], least)


def _runs(column: pa.ListArray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(bit, row) of every run of `least` words, from lists of word hashes."""
    flat, sizes = column.flatten().to_numpy(zero_copy_only=False).view(np.uint64), column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    row = np.repeat(np.arange(len(sizes)), sizes)
    inner = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    at = np.flatnonzero(inner + least <= sizes[row])
    h = np.zeros(len(at), np.uint64)
    for k in range(least):
        h = (h ^ (h >> np.uint64(31))) * _ODD + flat[at + k]
    return ((h ^ (h >> np.uint64(29))) * _ODD >> np.uint64(64 - BITS.bit_length() + 1)).astype(np.int64), row[at]


def _hashes(text: str) -> Column:
    return F.transform(F.split(text, " "), lambda w: F.xxhash64(w))


def runs_of_tests(items: DataFrame, texts: list[str], least: int) -> np.ndarray:
    """The packed bits of all runs of `least` words in test texts."""
    each = items.select(F.explode(F.array(*texts)).alias("t")).select(F.array_join(words(consistent(F.col("t"))), " ").alias("t"))

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(_runs(b.column(0), least)[0]))], names=["bit"])

    return marked(each.select(_hashes("t").alias("h")).mapInArrow(mark, "bit bigint"), F.col("bit"))


def _suspects(values: DataFrame, bits: np.ndarray, least: int) -> DataFrame:
    """The values that may hold a run of test words."""
    held = values.sparkSession.sparkContext.broadcast(bits)

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = held.value
        for b in batches:
            bit, row = _runs(b.column(3), least)
            yield b.take(pa.array(np.unique(row[is_set(own, bit)]))).select(["record", "field", "text"])

    return values.withColumn("h", _hashes("text")).mapInArrow(look, "record bigint, field string, text string")


def leaks(corpus: DataFrame, record: str, fields: list[str], items: DataFrame, item: str, texts: list[str], least: int = 8) -> DataFrame:
    """record, field, first_word, n_words, words (of the field), item_id: every leaked stretch and each item in it."""
    sides = corpus.select(
        F.col(record).cast("bigint").alias("record"),
        F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).alias("text")) for f in fields))).alias("x"),
    )
    values = sides.select("record", "x.field", F.array_join(words(consistent(F.col("x.text"))), " ").alias("text"))
    if _coded(items, item, texts)[1] > 1:
        values = written(_suspects(values, runs_of_tests(items, texts, least), least), "leak-suspects")
    parts = []
    for automaton in automata(items, item, texts, least):
        held = corpus.sparkSession.sparkContext.broadcast(pickle.dumps(automaton))

        def scan(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            own = pickle.loads(held.value)
            for b in batches:
                out: list[list] = [[], [], [], [], [], []]
                for i, text in enumerate(b.column(2).to_pylist()):
                    ws = text.split(" ")
                    if len(ws) < own.least:
                        continue
                    for first, n, found in own.spans(ws):
                        for x in found:
                            for col, v in zip(out, (i, first, n, len(ws), x)):
                                col.append(v)
                at = pa.array(out[0], pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(at), b.column(1).take(at), *(pa.array(c, pa.int32()) for c in out[1:4]), pa.array(out[4], pa.int64())],
                    names=["record", "field", "first_word", "n_words", "words", "item_id"],
                )

        parts.append(values.mapInArrow(scan, "record bigint, field string, first_word int, n_words int, words int, item_id bigint"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def cleaned(corpus: DataFrame, record: str, fields: list[str], items: DataFrame, item: str, texts: list[str], least: int = 8, most_coverage: float = 0.5) -> DataFrame:
    """The records with the leaked stretches cut out of their fields (which come in the consistent form).

    A field more than ``most_coverage`` of whose words leaked becomes null as a whole. Columns: record, the fields,
    cut_words. Texts without a leak stay as they are in the consistent form. The stretches come from ``leaks`` and
    meet their records by record and hash of the fields, so no more than one automaton is held anywhere."""
    rows = corpus.select(F.col(record).cast("bigint").alias("record"), *fields).withColumn("_key", F.xxhash64("record", *fields))
    spans = leaks(rows, "_key", fields, items, item, texts, least).groupBy(F.col("record").alias("_key"), "field").agg(F.sort_array(F.collect_set(F.struct("first_word", "n_words"))).alias("x"))
    by_field = spans.groupBy("_key").agg(*(F.max(F.when(F.col("field") == f, F.col("x"))).alias(f"_x{k}") for k, f in enumerate(fields)))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols, total = [], [0] * b.num_rows
            for k in range(len(fields)):
                new = []
                for i, (text, gone) in enumerate(zip(b.column(1 + k).to_pylist(), b.column(1 + len(fields) + k).to_pylist())):
                    text = to_consistent(text)
                    if gone:
                        text, n = cut_text(text, [(x["first_word"], x["n_words"]) for x in gone], most_coverage)
                        total[i] += n
                    new.append(text)
                cols.append(pa.array(new, pa.string()))
            yield pa.RecordBatch.from_arrays([b.column(0), *cols, pa.array(total, pa.int32())], names=["record", *fields, "cut_words"])

    schema = "record bigint, " + ", ".join(f"`{f}` string" for f in fields) + ", cut_words int"
    joined = rows.join(by_field, "_key", "left").select("record", *fields, *(f"_x{k}" for k in range(len(fields))))
    return joined.mapInArrow(cut, schema)


def cut_text(text: str, spans: list[tuple[int, int]], most_coverage: float) -> tuple[str | None, int]:
    """A text without its leaked stretches (first word, words), None if too much of it leaked; and how many words went."""
    at = [m.span() for m in _WORDS.finditer(text)]
    gone = sorted((f, f + n) for f, n in spans)
    merged: list[list[int]] = []
    for a, b in gone:
        if merged and a <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b])
    cut = sum(b - a for a, b in merged)
    if not cut:
        return text, 0
    if cut > most_coverage * len(at):
        return None, cut
    out, end = [], 0
    for a, b in merged:
        out.append(text[end : at[a][0]])
        end = at[b - 1][1]
    return "".join([*out, text[end:]]), cut
