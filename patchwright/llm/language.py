"""The languages of a text and of its stretches, whatever its label says.

Method: one bit-sliced Bloom filter holds the character n-grams of the sample sentences of all languages; a
slot is a bit mask of languages, so one look-up (the AND of a few slots) gives all languages that may hold an
n-gram. A slot has as many 64-bit words as the languages take. For every word the hits are counted per language (the words of a batch
that are new together) and corrected for the filter's false positives; the
share of n-grams that a language holds is the word's evidence for it. Words no language holds better than
another (names, digits) are neutral. A Viterbi search over words, with a price for changing the language that is
lower between sentences, finds the stretches; it is left out where it can't find more than one, because the
language with most evidence lacks less than the price. Evidence of a word is computed once per worker and kept in a bounded cache.

The filter is fitted on a bounded sample: the first MOST_SAMPLES labelled rows of each language by id.

Defined results: null, empty and blank texts, and texts without any word, have no language and give no
row; a text in which no word has evidence gets the language of the most neutral evidence, with a low
confidence; very long texts are taken whole; repeated rows give repeated results; extra columns aren't read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .forms import consistent, words_of

MOST_SAMPLES = 2_000
SLOTS = 1 << 20
HASHES = 3  # 20 bits of one 64-bit hash each
LONGEST = 5
MOST_CACHED = 400_000
#: A run of so many words makes a language one of the text's.
RUN = 5
#: Nats for another language from one word to the next, and from one sentence to the next.
CHANGE, CHANGE_SENTENCE = 5.0, 3.0
#: New words whose n-grams are looked up at once.
BLOCK = 4_096
_FLOOR = 0.02


def grams(word: str) -> list[str]:
    """The n-grams of a word with its ends marked, and the whole word, which is marked apart."""
    w = f"^{word}$"
    out = [w[i : i + n] for n in range(2, LONGEST + 1) for i in range(len(w) - n + 1)]
    return [*out, "=" + word, "=" + word]


class Filter:
    """The bit-sliced Bloom filter: a slot holds one bit for each language."""

    def __init__(self, samples: list[tuple[str, str]], langs: list[str]):
        self.langs = langs
        self.slots = np.zeros((SLOTS, -(-len(langs) // 64)), np.uint64)
        for k, lang in enumerate(langs):
            found = {w for own, text in samples if own == lang for w in words_of(text) if not w.isnumeric()}
            at = self._slots(sorted({g for w in found for g in grams(w)}))
            self.slots[at.ravel(), k // 64] |= np.uint64(1 << k % 64)
        #: The chance that a filter claims an n-gram it doesn't hold.
        self.false = np.array([(self.slots[:, k // 64] >> np.uint64(k % 64) & np.uint64(1)).mean() for k in range(len(langs))]) ** HASHES
        self.forget()

    def forget(self) -> None:
        """Start with an empty cache; it changes no result."""
        self.cache: dict[str, list[float]] = {}

    @staticmethod
    def _slots(found: list[str]) -> np.ndarray:
        h = np.fromiter(map(xxhash.xxh3_64_intdigest, found), np.uint64, len(found))
        return np.stack([(h >> np.uint64(20 * k) & np.uint64(SLOTS - 1)).astype(np.int64) for k in range(HASHES)])

    def learn(self, found: set[str]) -> None:
        """Put the evidence of words into the cache: log shares of the n-grams each language holds, less those of the best language."""
        if len(self.cache) + len(found) > MOST_CACHED:
            self.forget()
        new = sorted(found - self.cache.keys())
        for at in range(0, len(new), BLOCK):
            block = new[at : at + BLOCK]
            own = [grams(w) for w in block]
            sizes = np.array([len(g) for g in own])
            masks = np.bitwise_and.reduce(self.slots[self._slots([g for x in own for g in x])], axis=0)
            bits = np.unpackbits(masks.astype("<u8").view(np.uint8), axis=1, bitorder="little")[:, : len(self.langs)]
            hits = np.add.reduceat(bits.astype(np.int32), np.cumsum(sizes) - sizes, axis=0)
            share = np.maximum(0, (hits - sizes[:, None] * self.false) / (sizes[:, None] * (1 - self.false)))
            logs = np.log(_FLOOR + share)
            logs -= logs.max(axis=1, keepdims=True)
            logs[[w.isnumeric() for w in block]] = 0
            self.cache.update(zip(block, logs.tolist()))

    def word(self, w: str) -> list[float]:
        """Log evidence of a word for each language; 0 for the best."""
        if w not in self.cache:
            self.learn({w})
        return self.cache[w]

    def text(self, tokens: list[str]) -> list[tuple[int, int, int, float]]:
        """(first word, words, language, confidence) of the stretches; '.' ends a sentence and is no word."""
        found = [None if t == "." else self.word(t) for t in tokens]
        ws = [x for x in found if x is not None]
        if not ws:
            return []
        langs = range(len(self.langs))
        sums = [sum(x[i] for x in ws) for i in langs]
        at = sums.index(max(sums))
        if sums[at] >= -CHANGE_SENTENCE:  # a word's best language has 0: no change can win back what it costs
            return [(0, len(ws), at, self._sure(ws, at))]
        best = {i: 0.0 for i in langs}
        back: list[dict[int, int]] = []
        ended = False
        for x in found:
            if x is None:
                ended = True
                continue
            top = max(best, key=best.__getitem__)
            change = best[top] - (CHANGE_SENTENCE if ended else CHANGE)
            ended = False
            step, now = {}, {}
            for i in langs:
                if best[i] >= change:
                    step[i], now[i] = i, best[i] + x[i]
                else:
                    step[i], now[i] = top, change + x[i]
            back.append(step)
            best = now
        at = max(best, key=best.__getitem__)
        path = [at]
        for step in reversed(back[1:]):
            at = step[at]
            path.append(at)
        path.reverse()
        out, start = [], 0
        for j in range(1, len(path) + 1):
            if j == len(path) or path[j] != path[start]:
                out.append((start, j - start, path[start], self._sure(ws[start:j], path[start])))
                start = j
        return out

    @staticmethod
    def _sure(logs: list[list[float]], at: int) -> float:
        """Confidence: the language's share of the likelihood, by word on average and damped for short stretches."""
        sums = [sum(x[i] for x in logs) for i in range(len(logs[0]))]
        damp = 1 / math.sqrt(len(logs))
        top = sums[at]
        return 1 / sum(math.exp(min(50.0, (s - top) * damp)) for s in sums)


def fitted(samples: DataFrame, panel: DataFrame, lang: str = "lang", text: str = "sample_text", order: str = "sample_id") -> Filter:
    """A filter from labelled sample sentences, at most MOST_SAMPLES of each language of the panel."""
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy(lang).orderBy(order))
    rows = samples.where(F.col(text).isNotNull()).withColumn("rank", rank).where(F.col("rank") <= MOST_SAMPLES).select(lang, text).collect()
    langs = [r[0] for r in panel.select("lang_code").orderBy("lang_code").collect()]
    return Filter([(r[0], r[1]) for r in rows if r[0] in langs], langs)


def tokens(col: Column) -> Column:
    """The words of a text and '.' for what ends a sentence, as one spaced string."""
    found = F.regexp_extract_all(F.lower(consistent(col)), F.lit(r"[\p{L}\p{M}\p{Nd}]+|[.!?\x{964}\x{965}]"), F.lit(0))
    return F.regexp_replace(F.array_join(found, " "), r"[!?\x{964}\x{965}]", ".")


def stretches(df: DataFrame, record: str, text: str, fit: Filter, keep: list[str] | None = None) -> DataFrame:
    """rec_id, the columns kept, stretches: array of (first_word, n_words, lang, confidence); texts without words give no row."""
    keep = keep or []
    held = df.sparkSession.sparkContext.broadcast((fit.langs, fit.slots, fit.false))

    def tag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Filter.__new__(Filter)
        own.langs, own.slots, own.false = held.value
        own.forget()
        for b in batches:
            rows, out = [], []
            texts = b.column(b.num_columns - 1).to_pylist()
            own.learn({w for t in texts if t for w in t.split(" ")} - {"."})
            for i, t in enumerate(texts):
                found = own.text(t.split(" ")) if t else []
                if found:
                    rows.append(i)
                    out.append([{"first_word": f, "n_words": n, "lang": own.langs[at], "confidence": c} for f, n, at, c in found])
            at = pa.array(rows, pa.int32())
            cols = [b.column(k).take(at) for k in range(b.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(out, KIND)], names=["rec_id", *keep, "stretches"])

    kinds = dict(df.dtypes)
    schema = "rec_id bigint, " + "".join(f"`{k}` {kinds[k]}, " for k in keep) + "stretches array<struct<first_word:int,n_words:int,lang:string,confidence:double>>"
    return df.select(F.col(record).cast("bigint").alias("rec_id"), *keep, tokens(F.col(text)).alias("_tokens")).mapInArrow(tag, schema)


KIND = pa.list_(pa.struct([("first_word", pa.int32()), ("n_words", pa.int32()), ("lang", pa.string()), ("confidence", pa.float64())]))


def languages(tagged: DataFrame) -> DataFrame:
    """rec_id, kept columns, main (language of most words), langs: the languages with a run of RUN words, or the
    main one alone where the text holds but one."""
    weights = F.transform(
        F.array_distinct(F.transform("stretches", lambda x: x["lang"])),
        lambda lang: F.struct(
            F.aggregate(F.filter("stretches", lambda x: x["lang"] == lang), F.lit(0), lambda a, x: a + x["n_words"]).alias("n"), lang.alias("lang")
        ),
    )
    runs = F.array_distinct(F.transform(F.filter("stretches", lambda x: x["n_words"] >= RUN), lambda x: x["lang"]))
    main = F.array_max(weights)["lang"]
    kept = [c for c in tagged.columns if c != "stretches"]
    return tagged.select(*kept, main.alias("main"), runs.alias("runs")).select(*kept, "main", F.when(F.size("runs") > 1, F.col("runs")).otherwise(F.array("main")).alias("langs"))


def cases(df: DataFrame, tbl: str, record: str, text: str, label: str, panel: DataFrame, fit: Filter) -> DataFrame:
    """tbl, rec_id, lang of the records whose label is missing or wrong, or whose text is in several languages."""
    names = panel.select("lang_code", F.explode(F.concat(F.array("lang_code"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("name"))
    known = {r["name"].strip().lower(): r["lang_code"] for r in names.collect()}
    codes = F.create_map(*(F.lit(x) for kv in sorted(known.items()) for x in kv))
    given = F.lower(F.trim(F.coalesce(F.col(label), F.lit(""))))
    tagged = languages(stretches(df.withColumn("_label", given), record, text, fit, ["_label"]))
    missing = F.col("_label").isin("", "und")
    wrong = F.coalesce(codes[F.col("_label")] != F.col("main"), F.lit(True))
    return tagged.where(missing | wrong | (F.size("langs") > 1)).select(F.lit(tbl).alias("tbl"), "rec_id", F.explode("langs").alias("lang")).distinct()
