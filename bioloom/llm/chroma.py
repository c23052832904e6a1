"""Chroma fingerprints of media columns and their alignment.

Samples become frames of twelve pitch classes. Rectangle filters over an integral image of the frames compare
neighbouring regions in time and pitch; each gives two bits in Gray code, and sixteen of them one packed
integer for each place. Two recordings are aligned by the histogram of the offsets at which their integers
agree, and accepted by the rate of wrong bits at the best offset. Equal fingerprints are one class.

A media column holds little-endian 16-bit PCM, or anything that ``decode`` turns into samples.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from bioloom.session import stored

RATE = 4000
FRAME, HOP = 512, 256
SPAN = 16
LOWEST_HZ, HIGHEST_HZ = 100.0, 1800.0
FILTERS = 16
#: A key is one byte of the integers at a place and at these distances behind it; the searched side has one at every ``STRIDE``-th place.
LAGS, STRIDE = (8, 16, 24), 2
MIN_VOTES = 1
#: Recordings link at this rate of wrong bits at most, over so many places at least (or all of the shorter one). Strangers of the
#: given table come no nearer than 0.25.
MAX_ERROR = 0.12
MIN_OVERLAP = 32
QUERY_MODULUS = 50


def frames(samples: np.ndarray) -> np.ndarray:
    """Energy of the twelve pitch classes in each frame, of unit sum; a silent frame is all zero."""
    n = (len(samples) - FRAME) // HOP + 1
    if n <= 0:
        return np.zeros((0, 12))
    cut = np.lib.stride_tricks.sliding_window_view(np.asarray(samples, np.float32), FRAME)[::HOP][:n]
    power = np.abs(np.fft.rfft(cut * np.hanning(FRAME).astype(np.float32), axis=1)) ** 2
    hertz = np.arange(power.shape[1]) * RATE / FRAME
    heard = np.flatnonzero((hertz >= LOWEST_HZ) & (hertz <= HIGHEST_HZ))
    pitch = np.rint(12 * np.log2(hertz[heard] / 440.0)).astype(int) % 12
    to_class = np.zeros((len(heard), 12), np.float32)
    to_class[np.arange(len(heard)), pitch] = 1
    chroma = power[:, heard].astype(np.float32) @ to_class
    total = chroma.sum(1, keepdims=True)
    return np.where(total > 1e-6, chroma / np.maximum(total, 1e-12), 0.0)


def filters(n: int = FILTERS) -> list[list[tuple[int, int, int, int, int]]]:
    """Filter ``i`` as signed rectangles (sign, first and last frame, first and last class, ends open).

    Shapes take turns: earlier against later, low against high, diagonal quarters, the middle third in time,
    the middle third in pitch. Widths and heights grow with ``i``.
    """
    out = []
    for i in range(n):
        width, height, low = 4 + 4 * (i % 4), 4 + 2 * (i // 4), 3 * i % 12
        low = min(low, 12 - height)
        w2, h2, w3, h3 = width // 2, height // 2, max(1, width // 3), max(1, height // 3)
        whole = (0, width, low, low + height)
        shape = i % 5
        if shape == 0:
            parts = [(1, 0, w2, *whole[2:]), (-1, w2, width, *whole[2:])]
        elif shape == 1:
            parts = [(1, 0, width, low, low + h2), (-1, 0, width, low + h2, low + height)]
        elif shape == 2:
            parts = [(1, 0, w2, low, low + h2), (1, w2, width, low + h2, low + height), (-1, 0, w2, low + h2, low + height), (-1, w2, width, low, low + h2)]
        elif shape == 3:
            parts = [(1, w3, width - w3, *whole[2:]), (-1, 0, w3, *whole[2:]), (-1, width - w3, width, *whole[2:])]
        else:
            parts = [(1, 0, width, low + h3, low + height - h3), (-1, 0, width, low, low + h3), (-1, 0, width, low + height - h3, low + height)]
        out.append(parts)
    return out


def packed(chroma: np.ndarray) -> np.ndarray:
    """One packed integer for each place where ``SPAN`` frames fit."""
    n = len(chroma) - SPAN + 1
    if n <= 0:
        return np.zeros(0, np.uint32)
    image = np.zeros((len(chroma) + 1, 13))
    image[1:, 1:] = chroma.cumsum(0).cumsum(1)
    codes = np.zeros(n, np.uint32)
    for parts in filters():
        plus, minus = np.zeros(n), np.zeros(n)
        for sign, t0, t1, y0, y1 in parts:
            area = image[t1 : t1 + n, y1] - image[t0 : t0 + n, y1] - image[t1 : t1 + n, y0] + image[t0 : t0 + n, y0]
            if sign > 0:
                plus += area
            else:
                minus += area
        level = np.digitize(np.log((1 + plus) / (1 + minus)), [-0.4, 0.0, 0.4])
        codes = (codes << np.uint32(2)) | (level ^ (level >> 1)).astype(np.uint32)
    return codes


def pcm(value: bytes | None) -> np.ndarray:
    return np.frombuffer((value or b"")[: len(value or b"") // 2 * 2], "<i2").astype(np.float32) / 32768


def melody(vector: list[float] | None, note_samples: int = 640) -> np.ndarray:
    """A vector as a recording: one note for each component, its pitch from the component's value."""
    if not vector:
        return np.zeros(0, np.float32)
    values = np.array([0.0 if v is None or not np.isfinite(v) else v for v in vector])
    hertz = 220.0 * 2.0 ** ((np.floor(values * 64).astype(np.int64) % 24) / 12.0)
    phase = np.cumsum(np.repeat(2 * np.pi * hertz / RATE, note_samples))
    return np.sin(phase).astype(np.float32)


def fingerprints(rows: DataFrame, key: str, media: str, decode: Callable[..., np.ndarray] = pcm) -> DataFrame:
    """``key, codes``: the packed integers of each recording; none for a null, empty or too short one."""
    kind = rows.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                codes = [packed(frames(decode(x.as_py()))).view(np.int32) for x in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(codes, pa.list_(pa.int32()))], [key, "codes"])

    return rows.select(key, media).mapInArrow(run, f"`{key}` {kind}, codes array<int>")


def keys(codes: Column, stride: int = 1) -> Column:
    """Structs ``place, key`` of all keys: for each of the four bytes, its values at a place and at ``LAGS`` behind it.

    A byte is left whole where an integer seldom is, and four that stand apart hardly recur by chance: about once in a thousand
    pairs of strangers of 144 codes. A longer ``LAGS`` makes keys for more recordings.
    """
    n = F.greatest(F.size(codes) - LAGS[-1], F.lit(0))
    places = F.filter(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: (i < n) & (i % stride == 0))

    def of_byte(b: int) -> Column:
        def key(i: Column) -> Column:
            made = F.lit(b).cast("long")
            for lag in (0, *LAGS):
                made = made * 256 + F.shiftrightunsigned(F.get(codes, i + lag), 8 * b).bitwiseAND(F.lit(255))
            return made

        return F.transform(places, lambda i: F.struct(i.alias("place"), key(i).alias("key")))

    return F.flatten(F.array(*[of_byte(b) for b in range(4)]))


def align(prints: DataFrame, key: str, is_query, min_votes: int = MIN_VOTES, max_error: float = MAX_ERROR, min_overlap: int = MIN_OVERLAP) -> DataFrame:
    """Per recording: its class, and for queries how many other classes it links to and the best of them.

    Classes of equal codes are named by their least key. For each class with a query the offsets at which its keys agree
    with another class's are counted; each offset with ``min_votes`` is verified over the whole overlap by its bit errors, and the
    best decides (ties: the least offset). A recording without codes links to nothing; one of up to ``LAGS[-1]``
    codes has no keys, so only equal ones are found, as its class. Rows that repeat a key repeat in the result.
    """
    made = stored(prints.withColumn("class", F.xxhash64("codes", F.size("codes"))).withColumn("asked", is_query), "prints")
    classes = stored(made.groupBy("class").agg(F.min(key).alias("class_id"), F.first("codes").alias("codes"), F.max("asked").alias("asked")), "classes")
    places = classes.select("class", F.explode(keys(F.col("codes"), STRIDE)).alias("k")).select("class", "k.*")
    asked = classes.where("asked").select(F.col("class").alias("q"), F.explode(keys(F.col("codes"))).alias("k")).select("q", F.col("k.place").alias("q_place"), "k.key")
    votes = (
        places.join(asked, "key").where(F.col("class") != F.col("q"))
        .groupBy("q", "class", (F.col("q_place") - F.col("place")).alias("offset")).agg(F.count(F.lit(1)).alias("votes")).where(F.col("votes") >= min_votes)
    )
    own = classes.select(F.col("class").alias("q"), F.col("codes").alias("q_codes"))
    pairs = votes.join(classes.select("class", "class_id", "codes"), "class").join(own, "q")
    # Place i of the other stands at i + offset of the query.
    first = F.greatest(F.lit(0), -F.col("offset"))
    overlap = F.least(F.size("codes") - first, F.size("q_codes") - first - F.col("offset"))
    pairs = pairs.where(overlap >= F.least(F.lit(min_overlap), F.size("codes"), F.size("q_codes")))
    a, b = F.slice("codes", first + 1, overlap), F.slice("q_codes", first + F.col("offset") + 1, overlap)
    wrong = F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y).cast("long").bitwiseAND(F.lit(0xFFFFFFFF)))), F.lit(0), lambda n, x: n + x)
    close = pairs.withColumn("error", wrong / (32 * overlap)).where(F.col("error") <= max_error)
    linked = close.groupBy("q", "class").agg(F.min_by(F.struct("class_id", "offset", "error"), F.struct("error", "offset")).alias("best")).select("q", "best.*")
    top = F.min_by(F.struct("class_id", "offset", "error"), F.struct("error", "class_id"))
    answers = linked.groupBy(F.col("q").alias("of_class")).agg(F.count(F.lit(1)).alias("n"), top.alias("top"))
    named = classes.select(F.col("class").alias("of"), "class_id")
    joined = made.join(named, F.col("class") == F.col("of")).join(answers, (F.col("class") == F.col("of_class")) & F.col("asked"), "left")
    return joined.select(
        key, F.size("codes").alias("n_codes"), "class_id", "asked",
        F.when(F.col("asked"), F.coalesce("n", F.lit(0))).alias("n_links"),
        F.col("top.class_id").alias("best_class_id"), F.col("top.offset").alias("best_offset"), F.round("top.error", 6).alias("best_error"),
    )


def align_embeddings(embeddings: DataFrame) -> DataFrame:
    """Every vector played as a melody; those with an id divisible by 50 are searched among all.

    A null or empty vector has no codes, and all of these are one class; a null or infinite component counts as zero. Repeated rows
    repeat; a null id is no query; an empty table gives no rows.
    """
    prints = fingerprints(embeddings, "vec_id", "embedding", melody)
    return align(prints, "vec_id", F.coalesce(F.col("vec_id") % QUERY_MODULUS == 0, F.lit(False)))
