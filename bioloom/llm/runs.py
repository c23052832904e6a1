"""Periodic runs of words in texts, and texts without the repetitions.

Every run has a Lyndon root under one order of the words or its reverse: the longest Lyndon word that starts at some place. So two
Lyndon arrays name all candidates. Each comes from the first phase of a suffix sorter by grouping (Baier): places are grouped by
their word and groups are taken from the highest down. A taken place joins the nearest place to its left that is still there,
whose group is split by how many it is joined by; the split part moves to a group of its own right above. When a place is taken, the
distance to the next one still there is the length of its longest Lyndon word. Each candidate is extended to both sides as far as
its words repeat (longest common extensions by hashes and halving, vectorised), and what comes out is proved word by word.

Words in runs belong to six words that stand twice in the text, so only stretches of such words are searched, which loses no run.
"""

from __future__ import annotations

from array import array
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from bioloom.llm.blocks import MULTIPLIER, apart, mix64

#: A run has at least so many words and at least two periods.
LEAST_WORDS = 12
#: In a run of period q, length - q >= 6 words stand again q later.
GRAM = LEAST_WORDS // 2
BLOCK_WORDS = 1 << 18
#: Beyond so many places links are packed integers: slower, a tenth of the memory.
PACKED_FROM = 1 << 20
RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"


def lyndon_lengths(x: np.ndarray) -> np.ndarray:
    """The length of the longest Lyndon word that starts at each place; the end is less than any word."""
    n = len(x)
    symbols, x = np.unique(x, return_inverse=True)

    def links(values: np.ndarray) -> list[int] | array:
        return values.tolist() if n < PACKED_FROM else array("i", values.astype(np.int32).tobytes())

    group = links(x)
    left, right = links(np.arange(-1, n - 1)), links(np.arange(1, n + 1))
    length = links(np.zeros(n, np.int64))
    members = [m.tolist() for m in np.split(np.argsort(x, kind="stable"), np.cumsum(np.bincount(x, minlength=len(symbols)))[:-1])] if n else []
    below, above = list(range(-1, len(symbols) - 1)), list(range(1, len(symbols) + 1))
    g = len(symbols) - 1
    while g >= 0:
        joined = []
        for i in members[g]:
            before = left[i]
            # Some have moved up meanwhile; those behind one of their own group are taken with the first of them.
            if group[i] != g or (before >= 0 and group[before] == g):
                continue
            at, times = i, 0
            while at < n and group[at] == g:
                after = right[at]
                length[at] = after - at
                at = after
                times += 1
            if at < n:
                left[at] = before
            if before >= 0:
                right[before] = at
                joined.append((times, before))
        members[g] = ()
        if len(joined) > 1:
            joined.sort(reverse=True)
        made: dict[int, int] = {}
        last = 0
        for times, place in joined:
            if times != last:
                made, last = {}, times
            old = group[place]
            new = made.get(old)
            if new is None:
                new = made[old] = len(members)
                members.append([])
                higher = above[old]
                below.append(old)
                above.append(higher)
                above[old] = below[higher] = new
            group[place] = new
            members[new].append(place)
        g = below[g]
    return np.array(length, np.int64)


class _Extensions:
    """How far words repeat at two places, to the right or to the left, for many pairs of places at once."""

    def __init__(self, x: np.ndarray):
        self.n = len(x)
        powers = np.full(self.n + 1, MULTIPLIER, np.uint64)
        powers[0] = 1
        self.powers = np.cumprod(powers, dtype=np.uint64)
        self.sums = np.zeros(self.n + 1, np.uint64)
        np.cumsum(mix64(x.astype(np.uint64) + np.uint64(1)) * self.powers[: self.n], out=self.sums[1:])

    def _equal(self, a: np.ndarray, apart: np.ndarray, length: np.ndarray) -> np.ndarray:
        one = (self.sums[a + length] - self.sums[a]) * self.powers[apart]
        return one == self.sums[a + apart + length] - self.sums[a + apart]

    def right(self, a: np.ndarray, apart: np.ndarray) -> np.ndarray:
        most, found = self.n - a - apart, np.zeros(len(a), np.int64)
        for bit in range(int(self.n).bit_length() - 1, -1, -1):
            some = np.flatnonzero(found + (1 << bit) <= most)
            equal = self._equal(a[some] + found[some], apart[some], np.int64(1 << bit))
            found[some[equal]] += 1 << bit
        return found

    def left(self, a: np.ndarray, apart: np.ndarray) -> np.ndarray:
        found = np.zeros(len(a), np.int64)
        for bit in range(int(self.n).bit_length() - 1, -1, -1):
            some = np.flatnonzero(found + (1 << bit) <= a)
            equal = self._equal(a[some] - found[some] - (1 << bit), apart[some], np.int64(1 << bit))
            found[some[equal]] += 1 << bit
        return found


def _first(mismatch: np.ndarray) -> int:
    return int(mismatch.argmax()) if mismatch.any() else len(mismatch)


def _proved(x: np.ndarray, start: int, end: int, period: int, place: int) -> tuple[int, int]:
    """The run through ``place``; hashes can only have made it too long, and then it is found word by word."""
    if (x[start : end - period] == x[start + period : end]).all():
        return start, end
    return place - _first(x[:place][::-1] != x[period : place + period][::-1]), place + period + _first(x[place : len(x) - period] != x[place + period :])


def maximal_runs(x: np.ndarray, least: int = LEAST_WORDS) -> list[tuple[int, int, int]]:
    """``start, length, period`` of the runs of at least ``least`` symbols and two periods, by start, then period."""
    n = len(x)
    if n < least:
        return []
    extend, found = _Extensions(x), set()
    for order in (x, -x):
        period = lyndon_lengths(order)
        place = np.flatnonzero(2 * period <= n)
        place = place[place + period[place] <= n]
        period = period[place]
        # What repeats around the root has least - period words or more in all, so one side has half of them.
        right, left = extend.right(place, period), extend.left(place, period)
        long = right + left >= np.maximum(period, least - period)
        runs = np.unique(np.stack([(place - left)[long], (place + period + right)[long], period[long]], 1), axis=0, return_index=True)
        first = place[long][runs[1]]
        for (start, end, q), at in zip(runs[0].tolist(), first.tolist(), strict=True):
            start, end = _proved(x, start, end, q, at)
            if end - start >= max(least, 2 * q):
                found.add((start, q, end - start))
    return [(start, length, q) for start, q, length in sorted(found)]


def _stretches(words: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[int, int]]:
    """Stretches, inside a text, of words that belong to ``GRAM`` words standing twice; no run leaves one."""
    n = len(words) - GRAM + 1
    if n < 2:
        return
    mixed, grams = mix64(words.astype(np.uint64) + np.uint64(1)), np.zeros(n, np.uint64)
    for i in range(GRAM):
        grams = grams * np.uint64(MULTIPLIER) + mixed[i : i + n]
    order = np.argsort(grams, kind="stable")
    again = np.zeros(n, bool)
    same = grams[order][1:] == grams[order][:-1]
    again[order[1:][same]] = again[order[:-1][same]] = True
    edge = np.zeros(len(words) + 1, np.int64)
    at = np.flatnonzero(again)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + GRAM, -1)
    inside = np.cumsum(edge[:-1]) > 0
    cut = np.zeros(len(words) + 1, bool)
    cut[1:-1] = inside[1:] != inside[:-1]
    cut[bounds] = True
    places = np.flatnonzero(cut)
    some = inside[places[:-1]] & (np.diff(places) >= LEAST_WORDS)
    yield from zip(places[:-1][some].tolist(), places[1:][some].tolist(), strict=True)


def text_runs(texts: list[list[bytes]]) -> list[list[tuple[int, int, int]]]:
    """The runs of each of some texts, given as words."""
    number: defaultdict[bytes, int] = defaultdict()
    number.default_factory = number.__len__
    sizes = np.array([len(t) for t in texts], np.int64)
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    words = np.fromiter((i for t in texts for i in map(number.__getitem__, t)), np.int64, int(bounds[-1]))
    # Equal words of two texts differ, so nothing reaches from one into the other.
    words += np.repeat(np.arange(len(texts)), sizes) * max(len(number), 1)
    found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for begin, end in _stretches(words, bounds):
        text = int(np.searchsorted(bounds, begin, "right")) - 1
        found[text] += [(start + begin - int(bounds[text]), length, q) for start, length, q in maximal_runs(words[begin:end])]
    return found


def arranged(words: list[bytes], seed: int | None) -> list[bytes]:
    """The words, or, where the seed is divisible by ten, with a stretch of them repeated from some place to the end."""
    n = len(words)
    if seed is None or seed % 10 or not n:
        return words
    g = seed // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * ((n - a) // p + 1))[: n - a]


def without_repetitions(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words that no run has after its first period."""
    dropped = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        dropped[start + period] += 1
        dropped[start + length] -= 1
    kept = np.cumsum(dropped[:-1]) == 0
    return [w for w, k in zip(words, kept.tolist(), strict=True) if k]


def find_runs(docs: DataFrame, text: str = "text", seed: Column | None = None) -> DataFrame:
    """``docs`` without ``text``, with ``runs`` (start, length, period in words, by start, then period) and ``collapsed``, the kept
    words joined by single spaces.

    Null and empty texts and those without a word have no runs and keep nothing (an empty text). Rows stay as they are, repeated
    rows too; given columns ``runs`` and ``collapsed`` are replaced, all others stay. Equal words are equal bytes. A ``seed`` that
    ten divides arranges the words first (see ``arranged``), a null one doesn't. An empty table gives no rows. A text is never cut.
    """
    names = [c for c in docs.columns if c not in (text, "runs", "collapsed")]
    own = docs.select(*[F.col(f"`{c}`") for c in names], (F.lit(None) if seed is None else seed).cast("long").alias("seed of runs"), F.col(f"`{text}`").cast("string").alias("text of runs"))
    named = apart(own, "text of runs", "seed of runs")
    kinds = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in named.schema.fields[:-2])
    runs_kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made(rows: pa.RecordBatch, texts: list[list[bytes]]) -> pa.RecordBatch:
            found = text_runs(texts)
            kept = [b" ".join(without_repetitions(t, r) if r else t) for t, r in zip(texts, found, strict=True)]
            listed = pa.array([[{"start": s, "length": n, "period": q} for s, n, q in r] for r in found], runs_kind)
            return pa.RecordBatch.from_arrays([*rows.columns[:-2], listed, pa.array(kept, pa.binary()).cast(pa.string())], [*rows.schema.names[:-2], "runs", "collapsed"])

        for batch in batches:
            texts: list[list[bytes]] = []
            first = words = 0
            for i, (seed_, value) in enumerate(zip(batch.column(batch.num_columns - 2).to_pylist(), batch.column(batch.num_columns - 1), strict=True)):
                # Without arguments bytes are split at just the six white spaces of ASCII.
                texts.append(arranged(value.as_buffer().to_pybytes().split() if value.is_valid else [], seed_))
                words += len(texts[-1])
                if words >= BLOCK_WORDS:
                    yield made(batch.slice(first, i + 1 - first), texts)
                    texts, first, words = [], i + 1, 0
            if texts:
                yield made(batch.slice(first), texts)

    return named.mapInArrow(run, f"{kinds}runs {RUNS}, collapsed string").toDF(*names, "runs", "collapsed")


def run_documents(docs: DataFrame) -> DataFrame:
    """Per document: how many runs, the longest one (of equal ones the first, then of the smallest period), digests of all runs and of
    what is left without their repetitions."""
    seed = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    found = find_runs(docs.select("doc_id", "text"), "text", seed)
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    rows = found.select("doc_id", "runs", best.alias("best"), F.sha2(lines.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))
    return rows.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("best.start")).alias("start"), F.col("best.length").alias("length"), (-F.col("best.period")).alias("period"),
        F.expr("1000 * best.length div -best.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256",
    )
