"""Improbable-feature digests of texts and their likeness.

Every window of 16 bytes has an entropy, and an entropy is the rarer the fewer windows of the corpus have it. A window that is the rarest of
32 neighbours, or of all where there are fewer, is a feature (of equally rare ones that of the least hash, then the leftmost). A text of under 16 bytes
is one feature as a whole. The same holds for texts of every length, so any two digests compare. Features go, in order and each once, into a chain of
Bloom filters of 2,048 bits, up to 64 in each. Two digests are as like as the bits of their filters overlap beyond chance: each filter of
the shorter chain takes its best partner, weighted by its features. A text without bytes has no feature: two such are alike, and
unlike any other.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, functions as F

from bioloom.llm.blocks import SubstringHashes, mix64, text_pieces
from bioloom.session import shuffle_partitions

WINDOW = 16
NEIGHBOURS = 32
BITS = 2048
PROBES = 5
PER_FILTER = 64
#: Share of the span between chance and full overlap that counts as unlike.
CUTOFF = 0.1
LEVELS = 1001
NEVER = np.uint64(2**64 - 1)
CHUNK = 1 << 19


def entropy_levels(buf: np.ndarray) -> np.ndarray:
    """The entropy of each window of a buffer, in thousandths of the greatest.

    Sliding by one byte changes only the counts of the byte that leaves and of the byte that enters. Those
    counts come from comparing the buffer with itself at every shift under the window's length.
    """
    n = len(buf) - WINDOW + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    ahead, behind = np.ones(len(buf), np.uint8), np.ones(len(buf), np.uint8)
    for shift in range(1, WINDOW):
        same = (buf[:-shift] == buf[shift:]).view(np.uint8)
        ahead[:-shift] += same
        behind[shift:] += same
    counts = np.arange(WINDOW + 1, dtype=np.float64)
    weight = np.zeros(WINDOW + 1, np.int64)
    weight[1:] = np.rint(counts[1:] * np.log2(counts[1:]) * 65536)
    step = np.zeros(WINDOW + 1, np.int64)
    step[1:] = np.diff(weight)
    sums = np.empty(n, np.int64)
    sums[0] = weight[np.bincount(buf[:WINDOW], minlength=256)].sum()
    sums[1:] = step[behind[WINDOW:]] - step[ahead[: n - 1]]
    np.cumsum(sums, out=sums)
    # The counts ahead are those of the window itself; the entropy is log2(WINDOW) - sums / WINDOW bits.
    most = np.log2(WINDOW)
    return np.clip(np.rint((most - sums / (WINDOW * 65536)) * ((LEVELS - 1) / most)), 0, LEVELS - 1).astype(np.int64)


def _window_starts(bounds: np.ndarray, window: int, n: int) -> np.ndarray:
    """Which positions start a window that stays in its document."""
    edge = np.zeros(n + 1, np.int32)
    counts = np.maximum(np.diff(bounds) - window + 1, 0)
    some = counts > 0
    np.add.at(edge, bounds[:-1][some], 1)
    np.add.at(edge, (bounds[:-1] + counts)[some], -1)
    return np.cumsum(edge[:n]) > 0


def rarity(docs: DataFrame, text: str = "text") -> np.ndarray:
    """Ranks of the entropy levels, rarest first, counted over all windows of all texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(LEVELS, np.int64)
        for batch in batches:
            for block in text_pieces(batch.column(0), CHUNK, WINDOW - 1):
                levels = entropy_levels(block.buf)
                total += np.bincount(levels[_window_starts(block.bounds, WINDOW, len(levels))], minlength=LEVELS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["level", "n"])

    rows = docs.select(text).mapInArrow(count, "level long, n long").groupBy("level").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(LEVELS, np.int64)
    for row in rows:
        counts[row["level"]] = row["n"]
    ranks = np.empty(LEVELS, np.uint16)
    ranks[np.argsort(counts, kind="stable")] = np.arange(LEVELS)
    return ranks


def _rarest(value: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The place of the leftmost least value among the ``NEIGHBOURS`` from each start."""
    offset, span = np.zeros(len(value), np.uint8), 1
    while span < NEIGHBOURS:
        left, right = value[:-span], value[span:]
        less = right < left
        offset = np.where(less, offset[span:] + np.uint8(span), offset[:-span])
        value = np.where(less, right, left)
        span *= 2
    return starts + offset[starts]


def features_at(buf: np.ndarray, bounds: np.ndarray, ranks: np.ndarray, hashes: SubstringHashes) -> tuple[np.ndarray, np.ndarray]:
    """Where features of joined texts start and end."""
    lengths = np.diff(bounds)
    tiny = (lengths > 0) & (lengths < WINDOW)
    starts, ends = [bounds[:-1][tiny]], [bounds[1:][tiny]]
    if (lengths >= WINDOW).any():
        value = ranks[entropy_levels(buf)].astype(np.uint64) << np.uint64(48) | hashes.windows(WINDOW) >> np.uint64(16)
        value[~_window_starts(bounds, WINDOW, len(value))] = NEVER
        # A text with fewer windows than a neighbourhood is one of its own.
        few = (lengths >= WINDOW) & (lengths < WINDOW + NEIGHBOURS - 1)
        at = [np.flatnonzero(_window_starts(bounds, WINDOW + NEIGHBOURS - 1, len(value)))]
        if len(at[0]):
            at[0] = np.unique(_rarest(value, at[0]))
        for lo, n in zip(bounds[:-1][few].tolist(), lengths[few].tolist(), strict=True):
            at.append(np.array([lo + int(value[lo : lo + n - WINDOW + 1].argmin())]))
        at = np.concatenate(at)
        starts.append(at)
        ends.append(at + WINDOW)
    return np.concatenate(starts), np.concatenate(ends)


class Digest:
    """A chain of filters with the number of features in each."""

    __slots__ = ("filters", "features")

    def __init__(self, filters: np.ndarray, features: np.ndarray):
        self.filters, self.features = filters, features

    def __str__(self) -> str:
        last = int(self.features[-1]) if len(self.features) else 0
        return f"{len(self.features)}:{last}:{base64.b64encode(self.filters.tobytes()).decode()}"

    def likeness(self, other: Digest) -> float:
        few, many = sorted((self, other), key=lambda d: int(d.features.sum()))
        if not len(few.features) or not len(many.features):
            return float(len(few.features) == len(many.features))
        if few.filters.shape == many.filters.shape and np.array_equal(few.filters, many.filters):
            return 1.0
        a, b = few.filters.view(np.uint64), many.filters.view(np.uint64)
        size_a = np.bitwise_count(a).sum(1, dtype=np.int64)[:, None]
        size_b = np.bitwise_count(b).sum(1, dtype=np.int64)[None, :]
        shared = np.stack([np.bitwise_count(row & b).sum(1, dtype=np.int64) for row in a])
        most, chance = np.minimum(size_a, size_b), size_a * size_b / BITS
        floor = chance + CUTOFF * (most - chance)
        score = np.clip((shared - floor) / np.maximum(most - floor, 1e-9), 0.0, 1.0)
        return float(min(1.0, (score.max(1) * few.features).sum() / few.features.sum()))


def digests(texts: list[bytes], ranks: np.ndarray) -> list[Digest]:
    """Digests of several texts at once."""
    buf = np.frombuffer(b"".join(texts), np.uint8)
    bounds = np.concatenate([[0], np.cumsum([len(x) for x in texts], dtype=np.int64)])
    hashes = SubstringHashes(buf)
    starts, ends = features_at(buf, bounds, ranks, hashes)
    doc = np.searchsorted(bounds, starts, "right") - 1
    feature = hashes.of(starts, ends)
    order = np.lexsort((starts, feature, doc))
    first = np.ones(len(order), bool)
    first[1:] = (doc[order][1:] != doc[order][:-1]) | (feature[order][1:] != feature[order][:-1])
    once = np.sort(order[first]) if len(order) else order
    once = once[np.lexsort((starts[once], doc[once]))]
    doc, feature = doc[once], feature[once]
    counts = np.bincount(doc, minlength=len(texts))
    nth = np.arange(len(doc)) - np.repeat(np.cumsum(counts) - counts, counts)
    chain = -(-counts // PER_FILTER)
    first_filter = np.cumsum(chain) - chain
    at = (first_filter[doc] + nth // PER_FILTER) * BITS
    bits = np.zeros(int(chain.sum()) * BITS, bool)
    mixed = mix64(feature)
    for i in range(PROBES):
        bits[at + (mixed >> np.uint64(11 * i) & np.uint64(BITS - 1)).astype(np.int64)] = True
    filters = np.packbits(bits).reshape(-1, BITS // 8)
    out = []
    for i, n in enumerate(counts.tolist()):
        k = int(chain[i])
        features = np.full(k, PER_FILTER)
        if k:
            features[-1] = n - (k - 1) * PER_FILTER
        out.append(Digest(filters[first_filter[i] : first_filter[i] + k], features))
    return out


def edit(text: str, following: str) -> str:
    """``text`` with its last half, rounded down, replaced by as much of the start of ``following``."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def with_next(docs: DataFrame) -> DataFrame:
    """Rows ``part, carried, doc_id, text`` laid out so that each row's successor stands behind it.

    The order is by ``doc_id`` descending (null last), then by a hash of the text; after the last comes the
    first. Rows are cut into ranges of ids, and each range also gets the first row of the next, marked as
    ``carried``. Texts are shuffled once; only one id for each range goes to the driver.
    """
    spark = docs.sparkSession
    key = F.coalesce(F.col("doc_id").cast("double"), F.lit(float("-inf")))
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("tie"), key.alias("place"))
    wanted = 2 * shuffle_partitions(spark)
    cuts = docs.where("doc_id IS NOT NULL").select(key.alias("place")).approxQuantile("place", [i / wanted for i in range(1, wanted)], 0.1 / wanted)
    splits = [float("-inf"), *sorted(set(cuts)), float("inf")]
    parts = Bucketizer(splits=splits, inputCol="place", outputCol="range", handleInvalid="keep") if len(splits) > 2 else None
    placed = parts.transform(rows) if parts else rows.withColumn("range", F.lit(0.0))
    placed = placed.withColumn("part", (F.lit(len(splits)) - F.col("range")).cast("int")).drop("range")
    lead = F.max_by(F.struct("doc_id", "tie"), F.struct("place", F.col("doc_id"), -F.col("tie").cast("double")))
    heads = sorted((r["part"], r["head"]["doc_id"], r["head"]["tie"]) for r in placed.groupBy("part").agg(lead.alias("head")).collect())
    moved = [(h[1], h[2], heads[i - 1][0]) for i, h in enumerate(heads)]
    carried = F.broadcast(spark.createDataFrame(moved, "head_id long, head_tie long, before int"))
    same = F.col("doc_id").eqNullSafe(F.col("head_id")) & (F.col("tie") == F.col("head_tie"))
    copies = F.when(F.col("before").isNull(), F.array(F.struct(F.col("part").alias("part"), F.lit(0).alias("carried")))).otherwise(
        F.array(F.struct(F.col("part").alias("part"), F.lit(0).alias("carried")), F.struct(F.col("before").alias("part"), F.lit(1).alias("carried")))
    )
    laid = placed.join(carried, same, "left").withColumn("copy", F.explode(copies))
    return (
        laid.select("copy.part", "copy.carried", "doc_id", "text", "tie")
        .repartition(wanted, "part")
        .sortWithinPartitions("part", "carried", F.col("doc_id").desc_nulls_last(), "tie")
        .drop("tie")
    )


SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def compare_edits(docs: DataFrame) -> DataFrame:
    """Per document: digests of its text and of its edited text, and how like its own digest is to the edited text's and the next document's.

    Null texts count as empty. Rows that share an id follow each other in the order of a hash of their texts.
    A table of one row has itself as its next; an empty table gives no rows.
    """
    import hashlib

    sent = docs.sparkSession.sparkContext.broadcast(rarity(docs))

    def results(rows: list[tuple[int, int | None, str]], ranks: np.ndarray) -> pa.RecordBatch:
        """Of all rows but the last of each part, whose successors follow them."""
        at = [i for i in range(len(rows) - 1) if rows[i][0] == rows[i + 1][0]]
        edited = [edit(rows[i][2], rows[i + 1][2]).encode() for i in at]
        raw = [r[2].encode() for r in rows]
        own = digests(raw + edited, ranks)
        of_edit = own[len(rows) :]
        return pa.RecordBatch.from_arrays(
            [
                pa.array([rows[i][1] for i in at], pa.int64()),
                pa.array([len(rows[i][2]) for i in at], pa.int64()),
                pa.array([hashlib.sha256(x).hexdigest() for x in edited], pa.string()),
                pa.array([str(own[i]) for i in at], pa.string()),
                pa.array([str(x) for x in of_edit], pa.string()),
                pa.array([own[i].likeness(x) for i, x in zip(at, of_edit, strict=True)], pa.float64()),
                pa.array([own[i].likeness(own[i + 1]) for i in at], pa.float64()),
            ],
            ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = sent.value
        rows: list[tuple[int, int | None, str]] = []
        size, ended = 0, None
        for batch in batches:
            for part, carried, doc, text in zip(*(c.to_pylist() if i < 3 else c for i, c in enumerate(batch.columns)), strict=True):
                if part == ended:
                    continue  # a repeated head
                text = text.as_py() or ""
                rows.append((part, doc, text))
                size += len(text)
                ended = part if carried else None
                if size > CHUNK and len(rows) > 1:
                    yield results(rows, ranks)
                    rows = rows[-1:]
                    size = len(text)
        if len(rows) > 1:
            yield results(rows, ranks)

    return with_next(docs).mapInArrow(run, SCHEMA)
