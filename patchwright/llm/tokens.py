"""Token ids of a public byte-level BPE for every text of a corpus.

Method: merge replay. Texts are cut at white space into chunks, chunks by the tokenizer's pattern into
pieces; every distinct piece is encoded once. The distinct new pieces of a batch are laid out as one
sequence of symbols; an inverted index from a pair's rank to its positions then applies the merges in rank
order, touching only the neighbours of what it merged (a merge's result only takes part in later merges,
so one pass over the ranks is enough; with ranks of byte strings it may go back to a lower one). Chunks keep their ids in
a bounded cache of the worker.

The vocabulary is a parameter, read on the driver and broadcast; its size is that of the tokenizer, not of
the corpus. Served are byte-level BPE files of two kinds: JSON with merges, whose pre-tokenizer has to be the byte-level one
with its own pattern (others raise), and ranks of byte strings, where any two neighbours merge whose bytes together have a rank. No special tokens: their strings in a text are ordinary text.

Defined results: null and empty texts get an empty list; texts of any length are encoded whole;
repeated rows are encoded alike; other columns aren't read.
"""

from __future__ import annotations

import base64
import heapq
import json
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"
VOCABULARY_OF_MANY_LANGUAGES = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
MOST_CACHED = 300_000
#: Characters encoded at once in a worker.
BLOCK = 1_000_000

_SPACE = r"\t-\r \x85\xa0  -     　"
_CHUNKS = regex.compile(rf" ?[^{_SPACE}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+")
_PIECES = regex.compile(rf"'(?:s|t|re|ve|m|ll|d)| ?\p{{L}}+| ?\p{{N}}+| ?[^{_SPACE}\p{{L}}\p{{N}}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+")


def _byte_characters() -> list[str]:
    """The printable character that stands for each byte in the vocabulary file."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    table = {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}
    return [table[b] for b in range(256)]


class Merges:
    """Byte ids, and (left id, right id) -> (rank, merged id)."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]]):
        self.bytes = [vocab[c] for c in _byte_characters()]
        self.pairs: dict[tuple[int, int], tuple[int, int]] = {}
        self.whole: dict[bytes, int] = {}
        made: dict[str, int] = {}
        for rank, (a, b) in enumerate(merges):
            made.setdefault(a + b, rank)
            self.pairs[vocab[a], vocab[b]] = (rank, vocab[a + b])
        for rank, parts in enumerate(merges):
            if any(made.get(x, -1) >= rank for x in parts):
                raise ValueError("a merge comes before its parts")
        self.forget()

    def forget(self) -> None:
        self.cache: dict[str, tuple[int, ...]] = {}

    @classmethod
    def of_ranks(cls, ranks: dict[bytes, int]) -> Merges:
        """Every split of a byte string into two that have ranks may make it; a piece that has a rank as a whole is one id."""
        own = cls.__new__(cls)
        own.bytes = [ranks[bytes([b])] for b in range(256)]
        own.pairs = {(ranks[t[:k]], ranks[t[k:]]): (r, r) for t, r in ranks.items() for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks}
        own.whole = ranks
        own.forget()
        return own

    @classmethod
    def read(cls, path: str = VOCABULARY) -> Merges:
        if path.endswith(".tiktoken"):
            return cls.of_ranks({base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))})
        file = json.load(open(path, encoding="utf-8"))
        first, model = file["pre_tokenizer"] or {}, file["model"]
        if first.get("type") != "ByteLevel" or not first.get("use_regex", True) or first.get("add_prefix_space") or file.get("normalizer") or model.get("end_of_word_suffix"):
            raise ValueError(f"{path} isn't byte-level BPE with the byte-level pattern")
        return cls(model["vocab"], [tuple(m) if not isinstance(m, str) else tuple(m.split(" ")) for m in model["merges"]])

    def replay(self, pieces: list[str]) -> list[list[int]]:
        """The ids of each piece, by replaying all merges over all pieces together."""
        pairs = self.pairs
        symbols: list[int] = []
        ends = []
        for p in pieces:
            symbols += [self.bytes[b] for b in p.encode("utf-8", "surrogatepass")]
            symbols.append(-1)
            ends.append(len(symbols))
        n = len(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        where: dict[int, list[int]] = {}
        for i in range(n - 1):
            found = pairs.get((symbols[i], symbols[i + 1]))
            if found:
                rank = found[0]
                if rank in where:
                    where[rank].append(i)
                else:
                    where[rank] = [i]
        ranks = list(where)
        heapq.heapify(ranks)
        while ranks:
            rank = heapq.heappop(ranks)
            for i in sorted(where.pop(rank)):
                j = after[i]
                found = pairs.get((symbols[i], symbols[j])) if j < n else None
                if found is None or found[0] != rank:
                    continue  # another merge took one of them
                symbols[i], symbols[j] = found[1], -2
                k = after[i] = after[j]
                if k < n:
                    before[k] = i
                for a, b in ((before[i], i), (i, k)):
                    if a >= 0 and b < n:
                        found = pairs.get((symbols[a], symbols[b]))
                        if found:
                            if found[0] in where:
                                where[found[0]].append(a)
                            else:
                                where[found[0]] = [a]
                                heapq.heappush(ranks, found[0])
        out_ids, at = [], 0
        for e in ends:
            out_ids.append([s for s in symbols[at : e - 1] if s >= 0])
            at = e
        return out_ids

    def encode(self, texts: list[str]) -> list[list[str]]:
        """The chunks of each text; afterwards the cache holds the ids of all of them."""
        chunks = [_CHUNKS.findall(t) for t in texts]
        if len(self.cache) > MOST_CACHED:
            self.forget()
        new = sorted(set(chain.from_iterable(chunks)) - self.cache.keys())
        if new:
            cut = [_PIECES.findall(c) for c in new]
            pieces = sorted(set(chain.from_iterable(cut)))
            ids = {p: [self.whole[raw]] for p in pieces if (raw := p.encode("utf-8", "surrogatepass")) in self.whole} if self.whole else {}
            rest = [p for p in pieces if p not in ids]
            ids |= zip(rest, self.replay(rest))
            for c, parts in zip(new, cut):
                self.cache[c] = tuple(chain.from_iterable(ids[p] for p in parts))
        return chunks


def _blocks(texts: list[str | None]) -> Iterator[list[str]]:
    block, n = [], 0
    for t in texts:
        block.append(t or "")
        n += len(t or "")
        if n >= BLOCK:
            yield block
            block, n = [], 0
    if block:
        yield block


def _held(spark: SparkSession, vocabulary: str):
    return spark.sparkContext.broadcast(Merges.read(vocabulary))


def encoded(docs: DataFrame, record: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """record, ids: the token ids of each text."""
    held = _held(docs.sparkSession, vocabulary)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = held.value
        for b in batches:
            at = 0
            for block in _blocks(b.column(1).to_pylist()):
                chunks = own.encode(block)
                lookup = own.cache.__getitem__
                per_text = [list(chain.from_iterable(map(lookup, c))) for c in chunks]
                offsets = np.concatenate([[0], np.cumsum([len(x) for x in per_text])]).astype(np.int32)
                flat = np.fromiter(chain.from_iterable(per_text), np.int32, count=offsets[-1])
                ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, len(block)), ids], names=["record", "ids"])
                at += len(block)

    out = docs.select(F.col(record).cast("bigint").alias("record"), F.col(text).alias("text")).mapInArrow(encode, "record bigint, ids array<int>")
    return out.withColumnRenamed("record", record)


def sized(docs: DataFrame, keep: list[str], text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """The columns kept, tokens: how many tokens each text has."""
    held = _held(docs.sparkSession, vocabulary)
    kinds = dict(docs.dtypes)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = held.value
        for b in batches:
            sizes: list[int] = []
            for block in _blocks(b.column(b.num_columns - 1).to_pylist()):
                chunks = own.encode(block)
                length = {c: len(own.cache[c]) for c in set(chain.from_iterable(chunks))}
                sizes += [sum(map(length.__getitem__, c)) for c in chunks]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(sizes, pa.int64())], names=[*keep, "tokens"])

    return docs.select(*keep, F.col(text).alias("_text")).mapInArrow(count, ", ".join(f"`{c}` {kinds[c]}" for c in keep) + ", tokens bigint")
