"""Quality of hypotheses against references: corpus BLEU, chrF++, TER, WER and exact-match METEOR.

Everything a score needs is counted by segment in one pass over (hyp, ref) rows; corpus scores are sums of those
counts, so no n-gram is ever shuffled; n-grams of a batch are compared as 64-bit hashes (for chrF++ of noised texts the bits are shared
by the row's number, the hash and the side). For a grid of noise the cells are made and counted within the batch, and the references'
n-grams are found once for all cells. A null side makes a segment null; it isn't counted.

BLEU follows Papineni et al. 2002 with the 13a word splitting and exponential smoothing of zero counts; chrF++
follows Popovic 2017 (characters to order 6 without white space, words to order 2, beta 2, precision and recall averaged over
the orders both sides have). TER follows Snover et al. 2006 with the shifts that tercom tries, on lower-case words. METEOR matches
lower-case words exactly only, without stems or synonyms, each with the last free one from the end on.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import noise as N

CHARS, WORDS, BETA = 6, 2, 2
GRAMS = 4
_ODD = np.uint64(0x9E3779B97F4A7C15)
# The 13a word splitting, as (pattern, replacement) in order.
SPLITTING = [
    (r"([\{-\~\[-\` -\&\(-\+\:-\@\/])", " {0} "),
    (r"([^0-9])([\.,])", "{0} {1} "),
    (r"([\.,])([^0-9])", " {0} {1}"),
    (r"([0-9])(-)", "{0} {1} "),
]


_SPLITTING = [(re.compile(p), stand_in.format("\\1", "\\2")) for p, stand_in in SPLITTING]


def words_13a(text: str) -> list[str]:
    """Words by white space after punctuation is set apart."""
    for pattern, stand_in in _SPLITTING:
        text = pattern.sub(stand_in, text)
    return text.split()


_PUNCT = frozenset("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")
_IS_PUNCT = np.array([chr(i) in _PUNCT for i in range(128)])


def chrf_words(text: str) -> list[str]:
    """Words by white space, one punctuation mark at an end of a word set apart."""
    out = []
    for w in text.split():
        if len(w) > 1 and w[-1] in _PUNCT:
            out += [w[:-1], w[-1]]
        elif len(w) > 1 and w[0] in _PUNCT:
            out += [w[0], w[1:]]
        else:
            out.append(w)
    return out


def _hashed(codes: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash of n codes and their row, row) at every place of a row where n codes begin."""
    size = np.diff(offsets)
    row = np.repeat(np.arange(len(size)), size)
    inner = np.arange(len(codes)) - offsets[:-1][row]
    at = np.flatnonzero(inner + n <= size[row])
    h = row[at].astype(np.uint64) + np.uint64(n)
    for k in range(n):
        h = (h ^ (h >> np.uint64(29))) * _ODD + codes[at + k]
    return h ^ (h >> np.uint64(32)), row[at]


Codes = tuple[np.ndarray, np.ndarray]


class Grams:
    """The n-grams of some rows of codes (flat, offsets): the distinct ones with their row and number, and how many a row has."""

    def __init__(self, codes: Codes, n: int):
        h, row = _hashed(*codes, n)
        self.hashes, first, self.times = np.unique(h, return_index=True, return_counts=True)
        self.rows = row[first]
        self.all = np.bincount(row, minlength=len(codes[1]) - 1)

    def shared(self, other: Grams) -> np.ndarray:
        """By row, the n-grams in both (each as often as in the side with fewer)."""
        _, a, b = np.intersect1d(self.hashes, other.hashes, assume_unique=True, return_indices=True)
        return np.bincount(self.rows[a], weights=np.minimum(self.times[a], other.times[b]), minlength=len(self.all)).astype(np.int64)


def _offsets(sizes: list[int]) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)]).astype(np.int64)


def _points(texts: list[str]) -> Codes:
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64), _offsets([len(t) for t in texts])


def _coded(rows: list[list[str]], known: dict[str, int]) -> Codes:
    """Lists of words as numbers, the same number for the same word."""
    return np.array([known.setdefault(w, len(known)) for ws in rows for w in ws], np.uint64), _offsets([len(ws) for ws in rows])


_GAPS = re.compile(r"\s+")


class Side:
    """What the metrics need of the texts of one side; words get their numbers from a table that both sides share."""

    def __init__(self, texts: list[str], what: tuple[str, ...], known: dict[str, int]):
        self.texts = texts
        if "chrf" in what:
            flat, words = _points([_GAPS.sub("", t) for t in texts]), _coded([chrf_words(t) for t in texts], known)
            self.chrf = [Grams(flat, n) for n in range(1, CHARS + 1)] + [Grams(words, n) for n in range(1, WORDS + 1)]
        if "bleu" in what:
            words = _coded([words_13a(t) for t in texts], known)
            self.size, self.bleu = np.diff(words[1]), [Grams(words, n) for n in range(1, GRAMS + 1)]
        if {"wer", "ter", "meteor"} & set(what):
            self.words = [t.lower().split() for t in texts]


_MIX = np.uint64(0xD6E8FEB86659FD93)


class Units:
    """Characters or words of some rows as codes, flat with their row: the hashes of their n-grams by order."""

    def __init__(self, codes: np.ndarray, row: np.ndarray, rows: int, orders: int):
        self.row, self.sizes = row, np.bincount(row, minlength=rows)
        self.left = np.cumsum(self.sizes)[row] - np.arange(len(row))  # the longest n-gram of the row that begins here
        self.hashes, h = [codes], codes
        for n in range(1, orders):
            h = h[:-1]
            h = (h ^ (h >> np.uint64(29))) * _ODD + codes[n:]
            self.hashes.append(h)

    def all(self, n: int) -> np.ndarray:
        """By row, how many n-grams there are."""
        return np.maximum(self.sizes - (n - 1), 0)

    def keys(self, n: int, at: np.ndarray, bits: int, side: int) -> np.ndarray:
        """For the n-grams at some places: the row in the highest bits, then a hash, then the side."""
        h = self.hashes[n - 1][at]
        h = (h ^ (h >> np.uint64(32))) * _MIX
        h = (h ^ (h >> np.uint64(29))) * _ODD
        return (self.row[at].astype(np.uint64) << np.uint64(64 - bits)) | (h >> np.uint64(bits + 1) << np.uint64(1)) | np.uint64(side)


def _in_both(h: Units, r: Units, n: int, h_at: np.ndarray, r_at: np.ndarray) -> np.ndarray:
    """By row, the n-grams that stand at the given places of both sides (each as often as in the side with fewer). Sorted together, the
    places with equal n-grams are neighbours, those of the reference first."""
    rows = len(r.sizes)
    bits = max(1, (rows - 1).bit_length())
    keys = np.concatenate([r.keys(n, r_at, bits, 0), h.keys(n, h_at, bits, 1)])
    keys.sort()
    at = np.flatnonzero(keys[1:] ^ keys[:-1] == 1)
    here, there = at + 1 - np.searchsorted(keys, keys[at]), np.searchsorted(keys, keys[at + 1], "right") - at - 1
    return np.bincount((keys[at] >> np.uint64(64 - bits)).astype(np.int64), weights=np.minimum(here, there), minlength=rows).astype(np.int64)


def _word_units(points: np.ndarray, gap: np.ndarray, row: np.ndarray, rows: int) -> Units:
    """The words (as `chrf_words` has them) of rows of characters without white space; gap: whether a word begins there."""
    if not len(points):
        return Units(np.zeros(0, np.uint64), row, rows, WORDS)
    punct = (points < 128) & _IS_PUNCT[np.minimum(points, 127)]
    first = np.flatnonzero(gap)
    last = np.append(first[1:], len(points)) - 1
    long, ends, begins = last > first, punct[last], punct[first]
    starts = gap.copy()
    starts[last[long & ends]] = True
    starts[first[long & ~ends & begins] + 1] = True
    first = np.flatnonzero(starts)
    place = np.arange(len(points)) - np.repeat(first, np.diff(np.append(first, len(points))))
    v = (points.astype(np.uint64) + (place.astype(np.uint64) << np.uint64(21))) * _ODD
    v = (v ^ (v >> np.uint64(29))) * _MIX
    return Units(np.add.reduceat(v ^ (v >> np.uint64(32)), first), row[first], rows, WORDS)


class Noised:
    """Texts whose chrF counts are wanted against themselves under noise.

    An n-gram of characters that noise left alone stands at its place on both sides and is counted as a match without looking: taking the
    same from both sides takes as much from the lesser of two counts. Only n-grams with a changed character or a gap are compared."""

    def __init__(self, points: np.ndarray, at: np.ndarray):
        self.points, self.at, self.rows = points, at, len(at) - 1
        white = np.isin(points, N.WHITE)
        self.kept = np.flatnonzero(~white)  # characters that count
        self.row = np.repeat(np.arange(self.rows), np.diff(at))[self.kept]
        self.word = np.cumsum(white)[self.kept] + self.row  # a number for each word
        flat = points[self.kept]
        self.chars, self.words = Units(flat.astype(np.uint64), self.row, self.rows, CHARS), _word_units(flat, self._gap(self.word), self.row, self.rows)

    @staticmethod
    def _gap(word: np.ndarray) -> np.ndarray:
        return np.concatenate([[True], word[1:] != word[:-1]])[: len(word)]

    def same(self) -> np.ndarray:
        """The counts without noise."""
        both = [u.all(n) for u, orders in ((self.chars, CHARS), (self.words, WORDS)) for n in range(1, orders + 1)]
        return np.stack([np.stack([x, x, x], 1) for x in both], 1)

    def counts(self, hit: np.ndarray, share: float) -> np.ndarray:
        """rows x orders x (in hyp, in ref, in both), for noise of a share with the given first draws."""
        out, gone = N.struck(self.points, hit, share)
        gone, out = gone[self.kept], out[self.kept]
        stays = np.flatnonzero(~gone)
        flat, row = out[stays], self.row[stays]
        h, r = Units(flat.astype(np.uint64), row, self.rows, CHARS), self.chars
        r_odd = gone | (out != self.points[self.kept])
        changed = r_odd[stays]
        h_odd, broken = changed, changed | np.concatenate([[False], np.diff(stays) > 1])[: len(stays)]
        lost, orders = r_odd, []
        for n in range(1, CHARS + 1):
            if n > 1:
                h_odd, r_odd = h_odd[:-1] | broken[n - 1 :], r_odd[:-1] | lost[n - 1 :]
            h_at, r_at = (np.flatnonzero(odd & (u.left[: len(odd)] >= n)) for odd, u in ((h_odd, h), (r_odd, r)))
            alone = r.all(n) - np.bincount(self.row[r_at], minlength=self.rows)
            orders.append((h.all(n), r.all(n), alone + _in_both(h, r, n, h_at, r_at)))
        h, r = _word_units(flat, self._gap(self.word[stays]), row, self.rows), self.words
        for n in range(1, WORDS + 1):
            h_at, r_at = (np.flatnonzero(u.left >= n) for u in (h, r))
            orders.append((h.all(n), r.all(n), _in_both(h, r, n, h_at, r_at)))
        return np.stack([np.stack(x, 1) for x in orders], 1)


def _chrf(h: Side, r: Side) -> np.ndarray:
    """rows x orders x (in hyp, in ref, in both): orders of characters, then of words."""
    return np.stack([np.stack([a.all, b.all, a.shared(b)], 1) for a, b in zip(h.chrf, r.chrf)], 1)


def _bleu(h: Side, r: Side) -> np.ndarray:
    """rows x (words of hyp, of ref, then for each order the n-grams of hyp and those in both)."""
    return np.stack([h.size, r.size, *(c for a, b in zip(h.bleu, r.bleu) for c in (a.all, a.shared(b)))], 1)


def chrf_counts(hyps: list[str], refs: list[str]) -> np.ndarray:
    known: dict[str, int] = {}
    return _chrf(Side(hyps, ("chrf",), known), Side(refs, ("chrf",), known))


def edits(hyp: list[str], ref: list[str]) -> int:
    """The least number of insertions, deletions and substitutions of words."""
    row = list(range(len(ref) + 1))
    for i, h in enumerate(hyp, 1):
        last, row[0] = row[0], i
        for j, r in enumerate(ref, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (h != r))
    return row[-1]


def _traced(hyp: list[int], ref: list[int]) -> tuple[int, dict[int, int], list[bool], list[bool]]:
    """(edits, ref place -> the hyp place it stands at or after, whether each hyp word and each ref word is in an edit)."""
    n, m = len(hyp), len(ref)
    cost, came = [list(range(m + 1))], [[2] * (m + 1)]
    for i in range(1, n + 1):
        last, row, how, h = cost[-1], [i], [1], hyp[i - 1]
        for j in range(1, m + 1):
            best, op = last[j - 1] + (h != ref[j - 1]), 0  # of equals a match or substitution, then a deletion
            if last[j] + 1 < best:
                best, op = last[j] + 1, 1
            if row[j - 1] + 1 < best:
                best, op = row[j - 1] + 1, 2
            row.append(best)
            how.append(op)
        cost.append(row)
        came.append(how)
    at: dict[int, int] = {}
    wrong_h, wrong_r = [True] * n, [True] * m
    i, j = n, m
    while i or j:
        op = came[i][j] if i else 2
        if op == 0:
            i, j = i - 1, j - 1
            at[j] = i
            wrong_h[i] = wrong_r[j] = hyp[i] != ref[j]
        elif op == 1:
            i -= 1
        else:
            j -= 1
            at[j] = i - 1
    return cost[n][m], at, wrong_h, wrong_r


def _shifted(words: list[int], start: int, n: int, to: int) -> list[int]:
    """Words with a stretch moved to before the place `to` (of the words as they are); into the stretch itself: past what follows it."""
    part = words[start : start + n]
    if to < start:
        return words[:to] + part + words[to:start] + words[start + n :]
    if to > start + n:
        return words[:start] + words[start + n : to] + part + words[to:]
    return words[:start] + words[start + n : n + to] + part + words[n + to :]


def ter_edits(hyp: list, ref: list, longest: int = 10, farthest: int = 50, most_tries: int = 1000) -> int:
    """Edits with shifts. In each round the shift that saves most is made, of equals the longest, the one from furthest in front, and the one
    to furthest in front, as long as one saves anything. Tried are stretches of up to `longest` words that stand elsewhere in the reference,
    no farther than `farthest` away, where neither place is right already. After `most_tries` tries no more shift is made."""
    known: dict = {}
    ref = [known.setdefault(w, len(known)) for w in ref]
    words = [known.setdefault(w, len(known)) for w in hyp]
    if not ref or not words:
        return len(words) + len(ref)
    places: dict[int, list[int]] = {}
    for j, r in enumerate(ref):
        places.setdefault(r, []).append(j)
    shifts = tries = 0
    while True:
        before, at, wrong_h, wrong_r = _traced(words, ref)
        if not before:
            return shifts
        best = None
        for i, w in enumerate(words):
            for j in places.get(w, ()):
                if abs(j - i) > farthest:
                    continue
                n = 0
                while n < longest and i + n < len(words) and j + n < len(ref) and words[i + n] == ref[j + n]:
                    n += 1
                    if not any(wrong_h[i : i + n]) or not any(wrong_r[j : j + n]) or i <= at[j] < i + n:
                        continue
                    seen = -1
                    for k in range(j - 1, j + n):
                        if k >= 0 and k not in at:
                            break
                        to = at[k] + 1 if k >= 0 else 0
                        if to == seen:
                            continue
                        seen = to
                        moved = _shifted(words, i, n, to)
                        option = (before - edits(moved, ref), n, -i, -to, moved)
                        tries += 1
                        if best is None or option[:4] > best[:4]:
                            best = option
            if tries >= most_tries:
                break
        if tries >= most_tries or best is None or best[0] <= 0:
            return before + shifts
        words, shifts = best[4], shifts + 1


def meteor_exact(hyp: list[str], ref: list[str]) -> float:
    """Exact unigram matches, recall weighed nine times, less a penalty for scattered matches."""
    if not hyp or not ref:
        return 0.0
    places: dict[str, list[int]] = {}
    for j, w in enumerate(ref):
        places.setdefault(w, []).append(j)
    at = [places[w].pop() if places.get(w) else -1 for w in reversed(hyp)][::-1]
    matched = [(i, j) for i, j in enumerate(at) if j >= 0]
    if not matched:
        return 0.0
    m = len(matched)
    chunks = 1 + sum(b != (a[0] + 1, a[1] + 1) for a, b in zip(matched, matched[1:]))
    p, r = m / len(hyp), m / len(ref)
    return 10 * p * r / (r + 9 * p) * (1 - 0.5 * (chunks / m) ** 3)


COUNTS = {
    "chrf": "array<struct<hyp:bigint,ref:bigint,both:bigint>>",
    "bleu": "array<bigint>",
    "wer": "bigint",
    "ter": "bigint",
    "ref_words": "bigint",
    "meteor": "double",
}
#: Characters counted at once in a worker; of noised texts, so many that what is sorted stays in the cache.
BLOCK, NOISED_BLOCK = 2_000_000, 100_000


def _blocks(texts: list[str], most: int = BLOCK) -> Iterator[slice]:
    start = n = 0
    for i, t in enumerate(texts):
        n += len(t)
        if n >= most:
            yield slice(start, i + 1)
            start, n = i + 1, 0
    if start < len(texts):
        yield slice(start, len(texts))


def _lists(counts: np.ndarray) -> pa.Array:
    """rows x n, or rows x n x 3 as structs."""
    offsets = pa.array(np.arange(len(counts) + 1, dtype=np.int32) * counts.shape[1])
    if counts.ndim == 2:
        return pa.ListArray.from_arrays(offsets, pa.array(counts.ravel().astype(np.int64)))
    flat = counts.reshape(-1, 3).astype(np.int64)
    return pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays([pa.array(flat[:, i].copy()) for i in range(3)], ["hyp", "ref", "both"]))


def _counts(h: Side, r: Side, what: tuple[str, ...]) -> list[pa.Array]:
    made = {
        "chrf": lambda: _lists(_chrf(h, r)),
        "bleu": lambda: _lists(_bleu(h, r)),
        "wer": lambda: pa.array([edits(x, y) for x, y in zip(h.words, r.words)], pa.int64()),
        "ter": lambda: pa.array([ter_edits(x, y) for x, y in zip(h.words, r.words)], pa.int64()),
        "ref_words": lambda: pa.array([len(y) for y in r.words], pa.int64()),
        "meteor": lambda: pa.array([meteor_exact(x, y) for x, y in zip(h.words, r.words)], pa.float64()),
    }
    return [made[w]() for w in what]


def counted(df: DataFrame, keep: list[str], hyp: str, ref: str, what: tuple[str, ...] = ("chrf",)) -> DataFrame:
    """The columns kept, and the counts asked for: chrf and bleu by order, wer and ter (edits), ref_words (what they are divided by), meteor."""
    kinds = dict(df.dtypes)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            k = len(keep)
            hyps, refs = b.column(k).to_pylist(), b.column(k + 1).to_pylist()
            for s in _blocks(hyps):
                known: dict[str, int] = {}
                counts = _counts(Side(hyps[s], what, known), Side(refs[s], what, known), what)
                yield pa.RecordBatch.from_arrays([*(c.slice(s.start, s.stop - s.start) for c in b.columns[:k]), *counts], names=[*keep, *what])

    both = df.where(F.col(hyp).isNotNull() & F.col(ref).isNotNull()).select(*keep, F.col(hyp).alias("_h"), F.col(ref).alias("_r"))
    return both.mapInArrow(count, ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), *(f"{w} {COUNTS[w]}" for w in what)]))


def _noised(texts: list[str], keys: np.ndarray, cells: list[tuple[int, float]], what: tuple[str, ...]) -> Iterator[tuple[slice, int, float, np.ndarray | None, Side, Side]]:
    """(texts, seed, noise, chrF counts if wanted, both sides for what else is wanted) for each cell of some texts at once."""
    listed = tuple(w for w in what if w != "chrf")
    for s in _blocks(texts, BLOCK if listed else NOISED_BLOCK):
        known: dict[str, int] = {}
        ref, (points, at) = Side(texts[s], listed, known), N.decoded(texts[s])
        chars = Noised(points, at) if "chrf" in what else None
        hits: dict[int, np.ndarray] = {}
        for seed, noise in cells:
            if noise > 0 and seed not in hits:
                hits = {seed: N.hits(at, keys[s], seed)}
            chrf = chars and (chars.counts(hits[seed], noise) if noise > 0 else chars.same())
            hyp = Side(N.encoded(*N.noised(points, at, keys[s], noise, seed)), listed, known) if listed and noise > 0 else ref
            yield s, seed, noise, chrf, hyp, ref


def noised_counts(df: DataFrame, key: str, text: str, cells: list[tuple[int, float]], what: tuple[str, ...] = ("chrf",)) -> DataFrame:
    """key, seed, noise, and the counts of every text, noised for each cell (seed, noise), against itself."""
    kind = dict(df.dtypes)[key]
    listed = tuple(w for w in what if w != "chrf")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, keys = b.column(1).to_pylist(), b.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            for s, seed, noise, chrf, hyp, ref in _noised(texts, keys, cells, what):
                own = b.column(0).slice(s.start, s.stop - s.start)
                counts = dict(zip(listed, _counts(hyp, ref, listed)))
                if chrf is not None:
                    counts["chrf"] = _lists(chrf)
                cell = [pa.array(np.full(len(own), seed, np.int32)), pa.array(np.full(len(own), noise))]
                yield pa.RecordBatch.from_arrays([own, *cell, *(counts[w] for w in what)], names=[key, "seed", "noise", *what])

    schema = f"`{key}` {kind}, seed int, noise double, " + ", ".join(f"{w} {COUNTS[w]}" for w in what)
    return df.where(F.col(text).isNotNull()).select(key, text).mapInArrow(count, schema)


def noised_sums(df: DataFrame, key: str, text: str, cells: list[tuple[int, float]], what: tuple[str, ...] = ("chrf",)) -> DataFrame:
    """seed, noise, and the counts (chrf, bleu) of the same, summed over the texts of each partition: enough for corpus scores, and a row for
    each partition and cell instead of each text and cell."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, float], dict[str, np.ndarray]] = {}
        for b in batches:
            texts, keys = b.column(1).to_pylist(), b.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            for _, seed, noise, chrf, hyp, ref in _noised(texts, keys, cells, what):
                own = sums.setdefault((seed, noise), dict.fromkeys(what, 0))
                for w in what:
                    own[w] = own[w] + (chrf if w == "chrf" else _bleu(hyp, ref)).sum(0, dtype=np.int64)
        if sums:
            cell = [pa.array([s for s, _ in sums], pa.int32()), pa.array([p for _, p in sums], pa.float64())]
            yield pa.RecordBatch.from_arrays([*cell, *(_lists(np.stack([x[w] for x in sums.values()])) for w in what)], names=["seed", "noise", *what])

    schema = "seed int, noise double, " + ", ".join(f"{w} {COUNTS[w]}" for w in what)
    return df.where(F.col(text).isNotNull()).select(key, text).mapInArrow(count, schema)


def chrf_score(sums: list[tuple[Column, Column, Column]]) -> Column:
    """chrF++ from sums of (hyp, ref, both) by order."""
    used = [F.when((h > 0) & (r > 0), 1).otherwise(0) for h, r, _ in sums]
    n = sum(used[1:], used[0])
    zero = F.lit(0.0)
    p = sum((F.when(u == 1, m / h).otherwise(0.0) for u, (h, _, m) in zip(used, sums)), zero) / n
    r = sum((F.when(u == 1, m / f).otherwise(0.0) for u, (_, f, m) in zip(used, sums)), zero) / n
    f = BETA * BETA
    return F.when(n == 0, 0.0).when(p + r > 0, 100 * (1 + f) * p * r / (f * p + r)).otherwise(0.0)


def chrf_sums(col: str = "chrf", weight: Column | None = None) -> list[tuple[Column, Column, Column]]:
    w = F.lit(1) if weight is None else weight
    return [tuple(F.sum(F.get(col, F.lit(i))[part] * w) for part in ("hyp", "ref", "both")) for i in range(CHARS + WORDS)]


def bleu_of(s: list[Column]) -> Column:
    """Corpus BLEU from sums: words of hyp, of ref, then for each order the n-grams of hyp and those in both."""
    logs, zeros = F.lit(0.0), F.lit(0)
    for n in range(GRAMS):
        total, both = s[2 + 2 * n], s[3 + 2 * n]
        zeros = zeros + F.when(both == 0, 1).otherwise(0)
        logs = logs + F.when(both == 0, F.ln(100 / (F.pow(F.lit(2.0), zeros) * total))).otherwise(F.ln(100 * both / total))
    none = s[3] == 0
    short = s[8] == 0  # no n-grams of the highest order at all
    brevity = F.when(s[0] < s[1], F.exp(1 - s[1] / s[0])).otherwise(1.0)
    return F.when(none | short, 0.0).otherwise(brevity * F.exp(logs / GRAMS))


def bleu_score(col: str = "bleu") -> Column:
    """Corpus BLEU from the segments' counts."""
    return bleu_of([F.sum(F.get(col, F.lit(i))) for i in range(2 + 2 * GRAMS)])
