"""Language-model scores by context-tree weighting over bytes.

A text is scored as its words, A-Z lowered, each followed by one space, and an end symbol, so that it stands
for the same event as the word baseline's. Each byte is eight binary decisions. For every context of up to
``DEPTH`` bytes and every node of the byte's decision tree there is a Krichevsky-Trofimov estimator; bottom up,

    P(node) = 1/2 KT(node) + 1/2 * product of P(child contexts),

and the posterior weight of each depth along a context gives the mixed probability of the next bit.

Nothing is pruned, so the model grows with the corpus, and the tree never leaves Spark:

1. Tasks count byte strings (a longest context with its next byte) and words of all documents, those that teach
   apart; Spark sums them.
2. Strings meet by the last ``SPLIT`` bytes of their context. All deeper nodes of such a context are in one group, of
   at most 256 ** (DEPTH - SPLIT + 1) strings however large the corpus is, and are weighted there. The nodes above
   are sums over their children, one shuffle a depth; there are at most 256 ** SPLIT contexts of them.
3. Down again, each node gets the two numbers that turn the mixed probability below it into that of the root, and the
   groups give each string its log probability. Strings that only held-out texts have are among them, uncounted.
4. The ``FREQUENT`` strings and words that most places have go to the tasks, which add up a text's places; what
   is rarer is joined by a shuffle. Where that line lies changes no score.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from bioloom.llm.blocks import SubstringHashes, lower_ascii, mix64, text_pieces, word_spans
from bioloom.llm.langid import held_out
from bioloom.session import stored

DEPTH = 5
SPLIT = 3
#: At most so many strings and so many words go to every task.
FREQUENT = 1 << 21
END, SPACE = 255, 32
STRINGS, WORDS = 0, 1
CHUNK = 1 << 20
#: Strings of whole groups that are weighted at once.
GROUPED = 1 << 18


class Table:
    """Positions of 64-bit keys by open addressing."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        size = 1 << max(4, (3 * max(1, len(keys)) - 1).bit_length())
        self.mask = np.uint64(size - 1)
        self.slots = np.full(size, -1, np.int32)
        at, left = mix64(keys) & self.mask, np.arange(len(keys), dtype=np.int32)
        while len(left):
            free = left[self.slots[at[left]] < 0]
            self.slots[at[free]] = free
            left = left[self.slots[at[left]] != left]
            at[left] = (at[left] + np.uint64(1)) & self.mask

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The position of each key, or -1."""
        if not len(self.keys):
            return np.full(len(keys), -1, np.int32)
        at = mix64(keys) & self.mask
        found = self.slots[at]
        open_ = np.flatnonzero((found >= 0) & (self.keys[found] != keys))
        while len(open_):
            at[open_] = (at[open_] + np.uint64(1)) & self.mask
            found[open_] = self.slots[at[open_]]
            open_ = open_[(found[open_] >= 0) & (self.keys[found[open_]] != keys[open_])]
        return found


# --- the tree -------------------------------------------------------------------------------------------------


def log_gamma(x: np.ndarray) -> np.ndarray:
    """By Stirling's series, after six steps of the recurrence."""
    shift = np.zeros_like(x)
    for _ in range(6):
        shift -= np.log(x)
        x = x + 1
    return shift + (x - 0.5) * np.log(x) - x + 0.5 * np.log(2 * np.pi) + 1 / (12 * x) - 1 / (360 * x**3) + 1 / (1260 * x**5)


def log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Log probability that the estimator gives a sequence with these counts."""
    return log_gamma(zeros + 0.5) + log_gamma(ones + 0.5) - np.log(np.pi) - log_gamma(zeros + ones + 1)


def weigh(zeros: np.ndarray, ones: np.ndarray, deeper: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of nodes with these counts, over children of these log probabilities: the estimate of a one, its weight, the log probability."""
    own = log_kt(zeros, ones)
    total = np.logaddexp(own, deeper) - np.log(2)
    return (ones + 0.5) / (zeros + ones + 1), np.exp(own - np.log(2) - total), total


class Branches:
    """All nodes from ``depth`` up to ``split`` of some strings; of a context of ``split`` bytes all strings must be there.

    A node's key is its context, then a byte of the decided bits behind a leading one. ``low`` to ``logs`` are those of the nodes
    at ``split``.
    """

    def __init__(self, strings: np.ndarray, counts: np.ndarray, depth: int, split: int):
        order = np.argsort(strings)
        self.strings, counts = strings[order], counts[order].astype(np.int64)
        self.order = order
        context, byte = self.strings >> np.uint64(8), self.strings & np.uint64(255)
        keys, zeros, ones, self.leaf, self.bits, n = [], [], [], [], [], 0
        for j in range(8):
            key = (context << np.uint64(8)) | np.uint64(1 << j) | (byte >> np.uint64(8 - j))
            fresh = np.ones(len(key), bool)
            fresh[1:] = key[1:] != key[:-1]
            first = np.flatnonzero(fresh)
            bit = (byte >> np.uint64(7 - j)) & np.uint64(1) == 1
            one, both = (np.add.reduceat(x, first) if len(key) else x for x in (np.where(bit, counts, 0), counts))
            self.leaf.append(n + np.cumsum(fresh) - 1)
            self.bits.append(bit)
            n += len(first)
            keys.append(key[first])
            ones.append(one)
            zeros.append(both - one)
        key, zero, one = np.concatenate(keys), np.concatenate(zeros).astype(float), np.concatenate(ones).astype(float)
        logs, at = log_kt(zero, one), np.arange(len(key))
        self.mixed = (one + 0.5) / (zero + one + 1)
        for d in range(depth - 1, split - 1, -1):
            key, parent = np.unique(key & np.uint64((1 << (8 * (d + 1))) - 1), return_inverse=True)
            zero, one, deeper = (np.bincount(parent, x, minlength=len(key)) for x in (zero, one, logs))
            estimate, weight, logs = weigh(zero, one, deeper)
            at = parent[at]
            self.mixed = weight[at] * estimate[at] + (1 - weight[at]) * self.mixed
        self.at, self.keys, self.zeros, self.ones, self.logs = at, key, zero, one, logs

    def string_logs(self, above: np.ndarray, share: np.ndarray) -> np.ndarray:
        """log10 of the probability of each string's last byte, in the order given, from what the nodes at ``split`` have above them."""
        one = above[self.at] + share[self.at] * self.mixed
        total = sum(np.log10(np.where(bit, one[leaf], 1 - one[leaf])) for leaf, bit in zip(self.leaf, self.bits, strict=True))
        out = np.empty(len(self.strings))
        out[self.order] = total
        return out


def whole_groups(batches: Iterator[pa.RecordBatch], size: int = GROUPED) -> Iterator[list[np.ndarray]]:
    """Columns of about ``size`` rows or more, sorted by the first column, of which no value is cut."""
    held: list[list[np.ndarray]] = []
    rows = 0
    for batch in batches:
        if batch.num_rows:
            held.append([c.to_numpy(zero_copy_only=False) for c in batch.columns])
            rows += batch.num_rows
        if rows > size:
            columns = [np.concatenate(c) for c in zip(*held, strict=True)]
            cut = int(np.searchsorted(columns[0], columns[0][-1]))
            if cut:
                yield [c[:cut] for c in columns]
            held, rows = [[c[cut:] for c in columns]], len(columns[0]) - cut
    if rows:
        yield [np.concatenate(c) for c in zip(*held, strict=True)]


def _context(key: Column, split: int) -> Column:
    """The last ``split`` bytes of the context of a string or node."""
    return F.shiftrightunsigned(key, 8).bitwiseAND(F.lit((1 << (8 * split)) - 1))


NODES = "key long, zeros double, ones double, logs double"


def _lowest(strings: DataFrame, depth: int, split: int) -> DataFrame:
    """Nodes at ``split`` from strings ``key, taught``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, key, taught in whole_groups(batches):
            made = Branches(key.view(np.uint64), taught, depth, split)
            yield pa.RecordBatch.from_arrays([pa.array(made.keys.view(np.int64)), *map(pa.array, (made.zeros, made.ones, made.logs))], ["key", "zeros", "ones", "logs"])

    grouped = strings.select(_context(F.col("key"), split).alias("context"), "key", "taught").repartition("context").sortWithinPartitions("context")
    return grouped.mapInArrow(run, NODES)


def _upper(nodes: DataFrame, depth: int) -> DataFrame:
    """Nodes of contexts of ``depth`` bytes from those one byte deeper, with ``estimate`` and ``weight``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            zeros, ones, deeper = (batch.column(i).to_numpy(zero_copy_only=False) for i in (1, 2, 3))
            made = weigh(zeros, ones, deeper)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *map(pa.array, made)], ["key", "zeros", "ones", "estimate", "weight", "logs"])

    summed = nodes.groupBy(F.col("key").bitwiseAND(F.lit((1 << (8 * (depth + 1))) - 1)).alias("key")).agg(*[F.sum(c).alias(c) for c in ("zeros", "ones", "logs")])
    return summed.mapInArrow(run, "key long, zeros double, ones double, estimate double, weight double, logs double")


def string_values(strings: DataFrame, depth: int = DEPTH) -> DataFrame:
    """``strings`` (``key, n, taught``) as ``key, n, value``: log10 of the probability of each string's last byte after the others."""
    split = min(SPLIT, depth)
    lowest = stored(_lowest(strings, depth, split), "nodes")
    levels = [lowest]
    for d in range(split - 1, -1, -1):
        levels.insert(0, stored(_upper(levels[0], d), "nodes"))
    # The probability at the root is above + share * that of a node's own mixture below.
    down = None
    for d, level in enumerate(levels[:-1]):
        rows, above, share = level, F.lit(0.0), F.lit(1.0)
        if down is not None:
            parents = down.select(F.col("key").alias("of"), F.col("above").alias("up"), F.col("share").alias("part"))
            rows = level.join(parents, F.col("key").bitwiseAND(F.lit((1 << (8 * d)) - 1)) == F.col("of"))
            above, share = F.col("up"), F.col("part")
        down = rows.select("key", (above + share * F.col("weight") * F.col("estimate")).alias("above"), (share * (1 - F.col("weight"))).alias("share"))
    ends = lowest.select("key", F.lit(0.0).alias("above"), F.lit(1.0).alias("share"))
    if down is not None:
        parents = stored(down, "above").withColumnRenamed("key", "of")
        ends = lowest.select("key").join(parents, F.col("key").bitwiseAND(F.lit((1 << (8 * split)) - 1)) == F.col("of")).drop("of")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, key, n, taught, above, share in whole_groups(batches):
            node = np.isnan(taught)
            made = Branches(key[~node].view(np.uint64), taught[~node], depth, split)
            # Nodes and the keys at ``split`` are the same set.
            order = np.argsort(key[node].view(np.uint64))
            place = np.argsort(np.argsort(made.keys))
            value = made.string_logs(above[node][order][place], share[node][order][place])
            yield pa.RecordBatch.from_arrays([pa.array(key[~node]), pa.array(n[~node]), pa.array(value)], ["key", "n", "value"])

    nothing = F.lit(float("nan"))
    both = strings.select("key", "n", F.col("taught").cast("double").alias("taught"), F.lit(0.0).alias("above"), F.lit(0.0).alias("share")).unionByName(
        ends.select("key", F.lit(0).cast("long").alias("n"), nothing.alias("taught"), "above", "share")
    )
    grouped = both.select(_context(F.col("key"), split).alias("context"), "key", "n", "taught", "above", "share").repartition("context").sortWithinPartitions("context")
    return grouped.mapInArrow(run, "key long, n long, value double")


# --- counting -------------------------------------------------------------------------------------------------


class Prepared(NamedTuple):
    """The words of a block and its normalised bytes, end symbols included, with the last of them for the next piece."""

    words: np.ndarray
    word_doc: np.ndarray
    strings: np.ndarray
    bounds: np.ndarray
    tail: np.ndarray


def prepare(buf: np.ndarray, bounds: np.ndarray, depth: int = DEPTH, head: np.ndarray | None = None, ended: bool = True) -> Prepared:
    """``head``: normalised bytes that the first text has before this; not ``ended``: the last text goes on after it."""
    buf = lower_ascii()[buf]
    docs = len(bounds) - 1
    starts, ends, doc = word_spans(buf, bounds)
    words = SubstringHashes(buf).of(starts, ends) & ~np.uint64(1)
    width = ends - starts + 1
    size = np.bincount(doc, width, minlength=docs).astype(np.int64)
    n = int(size.sum())
    stops = np.cumsum(width)
    # Where each byte of a word goes: one end symbol stands after each document before it.
    source = np.arange(n) + np.repeat(starts - (stops - width), width)
    line = buf[np.minimum(source, max(len(buf) - 1, 0))] if n else np.zeros(0, np.uint8)
    line[stops - 1] = SPACE
    flat = np.full(n + docs, END, np.uint8)
    flat[np.arange(n) + np.repeat(np.arange(docs), size)] = line
    edges = np.concatenate([[0], np.cumsum(size + 1)])
    # An end symbol before a text, and nothing before that, is its context.
    padded = np.concatenate([np.full(depth, END, np.uint8) if head is None else head, flat])
    strings = np.zeros(len(flat), np.uint64)
    for i in range(depth + 1):
        strings = (strings << np.uint64(8)) | padded[i : i + len(flat)]
    fresh = np.arange(docs) >= (0 if head is None else 1)
    for i in range(depth - 1):
        # Byte i of a text sees i bytes of it; older ones belong to the text before and become end symbols.
        at = edges[:-1][(size + 1 > i) & fresh] + i
        seen = np.uint64((1 << (8 * (i + 2))) - 1)
        strings[at] = (strings[at] & seen) | (np.uint64((1 << (8 * (depth + 1))) - 1) & ~seen)
    if not ended:
        strings, edges[-1] = strings[:-1], edges[-1] - 1
        padded = padded[:-1]
    return Prepared(words, doc, strings, edges, padded[len(padded) - depth :])


def prepared(column: pa.Array, depth: int) -> Iterator[tuple[int, int, bool, Prepared]]:
    """First and last text, whether the last one ends, and what ``prepare`` makes, over all pieces of a column."""
    head = None
    for block in text_pieces(column, CHUNK):
        made = prepare(block.buf, block.bounds, depth, head if block.start else None, block.ended)
        head = made.tail
        yield block.first, block.last, block.ended, made


def _merge(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, back = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
    return keys, np.bincount(back, np.concatenate([n for _, n in parts]), minlength=len(keys)).astype(np.int64)


def corpus_counts(docs: DataFrame, depth: int = DEPTH) -> DataFrame:
    """``kind, key, n, taught``: counts over all rows, and over those not ``held_out``, of the longest byte strings and of words and ends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[list[tuple[np.ndarray, np.ndarray]]] = [[], []]

        def emit() -> Iterator[pa.RecordBatch]:
            for kind, parts in enumerate(kept):
                if parts:
                    # The lowest bit of a kept key tells that it is held out.
                    flagged, n = _merge(parts)
                    key = flagged >> np.uint64(1) if kind == STRINGS else flagged & ~np.uint64(1)
                    taught = np.where(flagged & np.uint64(1) == 0, n, 0)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(key), kind, np.int32)), pa.array(key.view(np.int64)), pa.array(n), pa.array(taught)], ["kind", "key", "n", "taught"])
                parts.clear()

        for batch in batches:
            held = batch.column(0).to_numpy(zero_copy_only=False).astype(bool)
            for first, last, _, made in prepared(batch.column(1), depth):
                flag = held[first:last].astype(np.uint64)
                kept[STRINGS].append(np.unique((made.strings << np.uint64(1)) | np.repeat(flag, np.diff(made.bounds)), return_counts=True))
                kept[WORDS].append(np.unique(made.words | flag[made.word_doc], return_counts=True))
                for parts in kept:
                    if len(parts) >= 8:
                        parts[:] = [_merge(parts)]
                # A task's memory stays bounded; Spark sums what several rounds give.
                if sum(len(parts[0][0]) for parts in kept) > 1 << 21:
                    yield from emit()
        yield from emit()

    counted = docs.select("held_out", "text").mapInArrow(run, "kind int, key long, n long, taught long")
    return counted.groupBy("kind", "key").agg(F.sum("n").alias("n"), F.sum("taught").alias("taught"))


# --- scoring --------------------------------------------------------------------------------------------------


def with_frequent(values: DataFrame, most: int) -> DataFrame:
    """Adds ``frequent``: whether a row is among the ``most`` rows of its kind with the greatest ``n``, ties left out.

    The line is drawn by a histogram of ``n`` in quarters of a doubling: at most 256 rows a kind go to the driver.
    """
    grade = F.floor(4 * F.log2("n"))
    histogram = sorted(map(tuple, values.groupBy("kind", grade.alias("grade")).agg(F.count(F.lit(1)).alias("rows")).collect()), reverse=True)
    lines = {}
    for kind in (STRINGS, WORDS):
        total, lines[kind] = 0, 1 << 20
        for _, g, rows in (h for h in histogram if h[0] == kind):
            total += rows
            if total > most:
                break
            lines[kind] = g
    return values.withColumn("frequent", grade >= F.when(F.col("kind") == STRINGS, lines[STRINGS]).otherwise(lines[WORDS]))


def _arrays(values: DataFrame, kind: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys, values and whether they are known, of the frequent rows of a kind."""
    got = values.where(F.col("frequent") & (F.col("kind") == kind)).select("key", "value", "known").toArrow()
    return got.column("key").to_numpy().astype(np.int64).view(np.uint64), got.column("value").to_numpy(), got.column("known").to_numpy().astype(bool)


#: What the last job sent to this worker, by the job's name.
_loaded: dict[str, tuple] = {}

SCHEMA = "row long, doc_id long, held_out boolean, n_tokens long, n_known long, n_bytes long, base_score double, score double, kinds array<int>, keys array<long>, times array<int>"


def _scored(docs: DataFrame, values: DataFrame, end_value: float, end_known: bool, depth: int) -> DataFrame:
    """Rows with all but the part of rarer strings and words, whose keys and counts are listed."""
    sent, name = docs.sparkSession.sparkContext.broadcast([_arrays(values, kind) for kind in (STRINGS, WORDS)]), uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if name not in _loaded:
            _loaded.clear()
            _loaded[name] = tuple((Table(keys), value, known) for keys, value, known in sent.value)
        (strings, string_value, _), (words, word_value, word_known) = _loaded[name]
        for batch in batches:
            rows = batch.num_rows
            score, base, tokens, known, length = np.zeros(rows), np.full(rows, end_value), np.ones(rows, np.int64), np.full(rows, int(end_known)), np.zeros(rows, np.int64)
            rare: list[tuple[np.ndarray, np.ndarray, int]] = []
            for first, last, _, made in prepared(batch.column(3), depth):
                part, size = slice(first, last), last - first
                doc = np.repeat(np.arange(size), np.diff(made.bounds))
                length[part] += np.diff(made.bounds)
                at = strings.find(made.strings)
                got = at >= 0
                score[part] += np.bincount(doc[got], string_value[at[got]], minlength=size)
                rare.append((first + doc[~got], made.strings[~got], STRINGS))
                at = words.find(made.words)
                got = at >= 0
                base[part] += np.bincount(made.word_doc[got], word_value[at[got]], minlength=size)
                tokens[part] += np.bincount(made.word_doc, minlength=size)
                known[part] += np.bincount(made.word_doc[got], word_known[at[got]], minlength=size).astype(np.int64)
                rare.append((first + made.word_doc[~got], made.words[~got], WORDS))
            # Rarer ones, once for each text.
            doc, key = (np.concatenate([r[i] for r in rare]) for i in (0, 1))
            kind = np.concatenate([np.full(len(r[0]), r[2], np.int32) for r in rare])
            order = np.lexsort((key, kind, doc))
            doc, key, kind = doc[order], key[order], kind[order]
            fresh = np.ones(len(doc), bool)
            fresh[1:] = (doc[1:] != doc[:-1]) | (key[1:] != key[:-1]) | (kind[1:] != kind[:-1])
            once = np.flatnonzero(fresh)
            offsets = pa.array(np.concatenate([[0], np.cumsum(np.bincount(doc[once], minlength=rows))]).astype(np.int32))
            lists = [pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (kind[once], key[once].view(np.int64), np.diff(np.append(once, len(doc))).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], *map(pa.array, (tokens, known.astype(np.int64), length, base, score)), *lists],
                ["row", "doc_id", "held_out", "n_tokens", "n_known", "n_bytes", "base_score", "score", "kinds", "keys", "times"],
            )

    return docs.select("row", "doc_id", "held_out", "text").mapInArrow(run, SCHEMA)


def score_documents(docs: DataFrame, depth: int = DEPTH, frequent: int = FREQUENT) -> DataFrame:
    """Per document the word baseline and the tree's log10 probability, learned from the rows that are not held out.

    ``bits_per_byte`` is the code length of the text for each byte of its normal form. Null texts count as empty; repeated rows
    repeat in learning and in the result; an empty table gives no rows. With nothing to learn from, every bit has
    probability one half and every token's share is 1. A long text is read in pieces, cut between words.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", held_out(F.col("doc_id"), 10, 0).alias("held_out"), "text")
    counts = stored(corpus_counts(rows, depth), "counts")
    words = counts.where(F.col("kind") == WORDS)
    ends = rows.where(~F.col("held_out")).count()
    n, v = words.agg(F.coalesce(F.sum("taught"), F.lit(0)) + ends, F.count_if(F.col("taught") > 0) + int(ends > 0)).first()
    unit = n + 0.1 * (v + 1)
    strings = counts.where(F.col("kind") == STRINGS)
    both = string_values(strings.select("key", "n", "taught"), depth).select(F.lit(STRINGS).alias("kind"), "key", "n", "value", F.lit(True).alias("known"))
    both = both.unionByName(words.select("kind", "key", "n", F.log10((F.col("taught") + 0.1) / F.lit(unit)).alias("value"), (F.col("taught") > 0).alias("known")))
    values = with_frequent(stored(both, "values"), frequent)
    scored = stored(_scored(rows, values, float(np.log10((ends + 0.1) / unit)), ends > 0, depth), "scored")
    pairs = scored.select("row", F.explode(F.arrays_zip("kinds", "keys", "times")).alias("p")).select("row", F.col("p.kinds").alias("of_kind"), F.col("p.keys").alias("of_key"), F.col("p.times").alias("times"))
    rest = values.where(~F.col("frequent")).select("kind", "key", "value", "known")
    gain, is_string = F.col("times") * F.col("value"), F.col("kind") == STRINGS
    gains = pairs.join(rest, (F.col("of_kind") == F.col("kind")) & (F.col("of_key") == F.col("key"))).groupBy(F.col("row").alias("of_row")).agg(
        F.sum(F.when(is_string, gain)).alias("more_score"), F.sum(F.when(~is_string, gain)).alias("more_base"), F.sum(F.when(~is_string & F.col("known"), F.col("times"))).alias("more_known")
    )
    joined = scored.drop("kinds", "keys", "times").join(gains, F.col("row") == F.col("of_row"), "left")
    score = F.col("score") + F.coalesce("more_score", F.lit(0.0))
    return joined.select(
        "doc_id", "held_out", "n_tokens",
        (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base_score") + F.coalesce("more_base", F.lit(0.0))).alias("base_score"),
        score.alias("score"),
        (-score * F.lit(float(np.log2(10))) / F.col("n_bytes")).alias("bits_per_byte"),
    )
