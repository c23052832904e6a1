"""Embedding drift: nearest distances, kernels and outliers, with numpy blocks."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from bioloom.session import stored

BLOCK = 1024


def l2_normalize(v: Column) -> Column:
    v = v.cast("array<double>")
    norm = F.greatest(F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x)), F.lit(1e-12))
    return F.transform(v, lambda x: x / norm)


def blocks(rows: DataFrame, vector: str, name: str, *others: str) -> DataFrame:
    """``{name}_block`` and ``{name}``, the ``others`` and vectors of up to about ``BLOCK`` different rows, dealt by hash.

    Equal rows are one, with their number as ``n``, so no block grows with repeats. A block is sorted: what is drawn from it by a seed is
    the same in every run.
    """
    once = rows.groupBy(*others, vector).agg(F.count(F.lit(1)).alias("n"))
    n = max(1, math.ceil(once.count() / BLOCK))
    dealt = once.withColumn("block_", F.pmod(F.xxhash64(*others, vector), F.lit(n)))
    return dealt.groupBy(F.col("block_").alias(f"{name}_block")).agg(F.array_sort(F.collect_list(F.struct(*others, F.col(vector).alias("v"), "n"))).alias(name))


#: Tiles of a task at most, where there are more than the cores need.
TILES = 256


def tiles(left: DataFrame, right: DataFrame, a: str, b: str, half: bool = False) -> DataFrame:
    """Every block of ``left`` beside every block of ``right``: one row, and so a bounded piece of work, for each two; of two equal
    sides that are met by ``half`` only those of no lesser number. Tiles are dealt over all cores by their numbers: small blocks lie in few files,
    and whoever reads one of these would have all its tiles.
    """
    last, here = right.agg(F.max(f"{b}_block")).first()[0], left.count()
    if last is None:
        return left.join(right, F.lit(False))
    number = here * (last + 1)
    tasks = min(max(1, number), max(3 * left.sparkSession.sparkContext.defaultParallelism, math.ceil(number / TILES)))
    # So many copies of a right block that there are keys enough for all tasks.
    copies = min(max(1, here), math.ceil(4 * tasks / (last + 1)))
    to = F.explode(F.sequence(F.col(f"{a}_block") if half else F.lit(0).cast("long"), F.lit(last).cast("long")))
    sent = left.withColumn("to", to).withColumn("copy", F.pmod(f"{a}_block", F.lit(copies).cast("long"))).repartition(tasks, "to", "copy")
    met = right.withColumn("of", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(copies - 1).cast("long")))).repartition(tasks, f"{b}_block", "of")
    return sent.join(met, (F.col("to") == F.col(f"{b}_block")) & (F.col("copy") == F.col("of"))).drop("to", "copy", "of")


def _stack(entries) -> np.ndarray:
    return np.array([e["v"] for e in entries], float)


def _numbers(entries) -> np.ndarray:
    return np.array([e["n"] for e in entries], np.int64)


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * a @ b.T, 0)


#: Most pivots that cells are built around, and rings of a cell.
PIVOTS, RINGS = 1024, 64


def _cells(rows: DataFrame, pivots: np.ndarray) -> DataFrame:
    """``v`` with ``cell``, its nearest pivot (of equally near ones the first), and ``apart``, the distance to it."""
    kind = rows.schema["v"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                squares = _squares(np.array(batch["v"].tolist(), float), pivots)
                cell = squares.argmin(1)
                yield batch.assign(cell=cell, apart=np.sqrt(squares[np.arange(len(cell)), cell]))

    return rows.select("v").mapInPandas(run, f"v {kind}, cell long, apart double")


def _rings(cells: DataFrame) -> DataFrame:
    """Blocks of up to about ``BLOCK`` vectors of a cell at about the same distance from its pivot: ``block, cell, low, high, t``."""
    sizes = cells.groupBy("cell").agg(F.count(F.lit(1)).alias("held"), F.percentile_approx("apart", [i / RINGS for i in range(1, RINGS)], 1000).alias("marks"))
    step = F.greatest(F.lit(1), F.floor(F.lit(RINGS) / F.least(F.lit(RINGS), F.ceil(F.col("held") / BLOCK))))
    ring = F.floor(F.size(F.filter("marks", lambda m: m < F.col("apart"))) / step)
    dealt = cells.join(sizes, "cell").withColumn("ring", ring).drop("marks", "held")
    # Rings of cells so large, or of distances so equal, that they hold too many are dealt by hash.
    many = dealt.groupBy("cell", "ring").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("parts"))
    dealt = dealt.join(many, ["cell", "ring"]).withColumn("part", F.pmod(F.xxhash64("v"), "parts"))
    held = dealt.groupBy("cell", "ring", "part").agg(F.min("apart").alias("low"), F.max("apart").alias("high"), F.collect_list("v").alias("t"))
    return held.select(F.xxhash64("cell", "ring", "part").alias("block"), "cell", "low", "high", "t")


def _met(asked: DataFrame, blocks_: DataFrame) -> DataFrame:
    """``id, squared, pairs``: of each query row, ``id, q, block``, the least squared distance in the block, and how many were computed."""
    many = asked.groupBy("block").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("parts"))
    groups = asked.join(many, "block").groupBy("block", F.pmod(F.xxhash64("id"), "parts").alias("part")).agg(F.collect_list(F.struct("id", "q")).alias("asked"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for queries, train in zip(batch["asked"], batch["t"], strict=True):
                squared = _nearest(np.array([e["q"] for e in queries], float), np.array(train.tolist(), float))
                yield pd.DataFrame({"id": [e["id"] for e in queries], "squared": squared, "pairs": len(train)})

    return groups.join(blocks_.select("block", "t"), "block").select("asked", "t").mapInPandas(run, "id long, squared double, pairs long")


def _nearest(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least squared distance of each row of ``a`` to a row of ``b``; the nearest by products is measured by differences."""
    at = _squares(a, b).argmin(1)
    return ((a - b[at]) ** 2).sum(1)


def nearest_distance(queries: DataFrame, train: DataFrame, key: str, vector: str, pivots: int = PIVOTS) -> DataFrame:
    """``key, distance, computed``: the least Euclidean distance of each query to the training vectors, exact, and to how many it was computed.

    Training vectors lie in cells around pivots (a drawn sample of at most ``pivots``), cut into rings by their distance to the pivot. A query
    first meets the blocks of its own cell, at the ring where it would lie. Then only those blocks are met that by the triangle inequality
    can hold a nearer vector: those whose ring is nearer to the query's distance from the pivot than what was found. Equal vectors are
    met once. Null vectors are neither asked nor found; without a training vector there is no row. The table of rings that tasks
    get has some twenty bytes for a thousand vectors.
    """
    once = train.where(F.col(vector).isNotNull()).select(F.col(vector).alias("v")).distinct()
    drawn = once.orderBy(F.xxhash64("v"), "v").limit(max(1, min(pivots, math.isqrt(once.count())))).collect()
    asked_kind = queries.schema[key].dataType.simpleString()
    if not drawn:
        return queries.sparkSession.createDataFrame([], f"`{key}` {asked_kind}, distance double, computed long")
    points = np.array([r["v"] for r in drawn], float)
    held = stored(_rings(_cells(once, points)), "rings")
    table = held.select("block", "cell", "low", "high").orderBy("cell", "low", "block").toPandas()
    block, cell = table["block"].to_numpy(), table["cell"].to_numpy()
    low, high = table["low"].to_numpy(), table["high"].to_numpy()
    different = queries.where(F.col(vector).isNotNull()).select(F.col(vector).alias("q")).distinct()
    named = stored(different.withColumn("id", F.monotonically_increasing_id()), "asked")
    kind = named.schema["q"].dataType.simpleString()

    def bounds(q: np.ndarray) -> np.ndarray:
        apart = np.sqrt(_squares(q, points))[:, cell]
        return np.maximum(np.maximum(low - apart, apart - high), 0)

    def first(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for lo in range(0, len(batch), 256):
                part = batch.iloc[lo : lo + 256]
                q = np.array(part["q"].tolist(), float)
                apart = _squares(q, points)[:, cell]
                # The nearest pivot's block whose ring is nearest.
                best = np.where(apart <= apart.min(1)[:, None], bounds(q), np.inf).argmin(1)
                yield part.assign(block=block[best])

    def others(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for lo in range(0, len(batch), 256):
                part = batch.iloc[lo : lo + 256]
                reach = np.sqrt(part["squared"].to_numpy(float)) * (1 + 1e-9) + 1e-7
                row, at = np.nonzero((bounds(np.array(part["q"].tolist(), float)) <= reach[:, None]) & (block[None, :] != part["block"].to_numpy()[:, None]))
                yield pd.DataFrame({"id": part["id"].to_numpy()[row], "q": [part["q"].iloc[i] for i in row], "block": block[at]})

    begun = stored(named.select("id", "q").mapInPandas(first, f"id long, q {kind}, block long"), "first")
    found = stored(_met(begun, held), "found")
    near = begun.join(found.select("id", "squared"), "id").select("id", "q", "block", "squared")
    rest = _met(near.mapInPandas(others, f"id long, q {kind}, block long"), held)
    best = found.unionByName(rest).groupBy("id").agg(F.sqrt(F.min("squared")).alias("distance"), F.sum("pairs").alias("computed"))
    answered = named.join(best, "id").select("q", "distance", "computed")
    return queries.select(key, F.col(vector).alias("q")).join(answered, "q").select(key, "distance", "computed")


def _pair_squares(a: np.ndarray, b: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Squared distances by differences, some rows of ``a`` at a time: the first row and the distances."""
    step = max(1, (1 << 20) // max(1, b.size))
    for lo in range(0, len(a), step):
        yield lo, ((a[lo : lo + step, None, :] - b[None]) ** 2).sum(2)


#: Bounds between which pairs are counted in each round, and how many pairs may come to the driver at last.
BOUNDS, GATHERED = 64, 1 << 16


def median_bandwidth(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """One row: the exact median of positive squared distances over unordered pairs of rows; 1 if there is none.

    The median is selected by counting: in each round tasks count, tile by tile, how many pairs lie between ``BOUNDS`` bounds, and the
    next round looks into the interval that holds the median, until it has few distances or one. No pair is a row before that. A round is quadratic
    in different vectors; rounds are about ten at most, whatever the data. Null vectors make no pair.
    """
    held = stored(blocks(rows.where(F.col(vector).isNotNull()), vector, "a"), "blocks")
    other = held.select(F.col("a_block").alias("b_block"), F.col("a").alias("b"))
    met = tiles(held, other, "a", "b", half=True).select((F.col("a_block") == F.col("b_block")).alias("same"), "a", "b")

    def each(a, b, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Positive distances of the tile's pairs and how many pairs of rows are so far apart."""
        n, m = _numbers(a), _numbers(b)
        for lo, squares in _pair_squares(_stack(a), _stack(b)):
            weights = n[lo : lo + len(squares), None] * m[None, :]
            some = squares > 0
            if same:
                some &= np.arange(lo, lo + len(squares))[:, None] < np.arange(len(m))[None, :]
            yield squares[some], weights[some]

    def counts(bounds: np.ndarray) -> np.ndarray:
        """How many pairs are at most each bound, and all."""

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total = np.zeros(len(bounds) + 1, np.int64)
            for batch in batches:
                for same, a, b in zip(batch["same"], batch["a"], batch["b"], strict=True):
                    for squares, weights in each(a, b, same):
                        # Weights are whole numbers; sums of doubles below 2**53 are exact.
                        total += np.bincount(np.searchsorted(bounds, squares), weights, len(bounds) + 1).astype(np.int64)
            yield pd.DataFrame({"at": np.arange(len(total)), "n": total})

        summed = {r["at"]: r["n"] for r in met.mapInPandas(run, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).collect()}
        return np.cumsum([summed.get(i, 0) for i in range(len(bounds) + 1)])

    def between(low: float, high: float) -> list[tuple[float, int]]:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for same, a, b in zip(batch["same"], batch["a"], batch["b"], strict=True):
                    for squares, weights in each(a, b, same):
                        some = (squares > low) & (squares <= high)
                        yield pd.DataFrame({"value": squares[some], "n": weights[some]})

        found = met.mapInPandas(run, "value double, n long").groupBy("value").agg(F.sum("n").alias("n")).collect()
        return sorted((r["value"], r["n"]) for r in found)

    def ranked(rank: int) -> float:
        """The distance of a rank, from 1. Bounds are spaced by the bits of doubles, so each round gains as many of them."""
        low, high, below, inside = 0, int(np.array(np.inf).view(np.int64)) - 1, 0, total
        while high - low > 1 and inside > GATHERED:
            # In whole numbers: doubles can't tell neighbours of this size apart.
            bits = np.unique([max(low + 1, low + (high - low) * i // BOUNDS) for i in range(1, BOUNDS)]).astype(np.int64)
            upto = counts(bits.view(np.float64))[:-1]
            at = int(np.searchsorted(upto, rank))
            before = int(upto[at - 1]) if at else below
            inside = (int(upto[at]) if at < len(bits) else below + inside) - before
            low, high, below = int(bits[at - 1]) if at else low, int(bits[at]) if at < len(bits) else high, before
        if high - low == 1:
            return float(np.array(high).view(np.float64))
        for value, n in between(*np.array([low, high]).view(np.float64).tolist()):
            below += n
            if below >= rank:
                return value
        raise AssertionError("the interval holds the rank")

    total = int(counts(np.array([np.inf]))[-1])
    if total:
        # Of an even number the median lies between the middle two.
        middle = ranked((total + 1) // 2)
        value = middle if total % 2 else (middle + ranked(total // 2 + 1)) / 2
    else:
        value = 1.0
    return rows.sparkSession.createDataFrame([(value,)], "bandwidth double")


def mmd2(rows: DataFrame, group: str, vector: str, real, bandwidth: float) -> DataFrame:
    """``group, mmd2``: biased squared discrepancy of each group from the real one; groups are matched subsamples in size.

    Kernel sums come from tiles, of each group with itself and with the real one, in one job. Groups are the few sets that are
    compared; a null is none. No row if the real group is empty.
    """
    rows = rows.where(F.col(group).isNotNull())
    sizes = {r[0]: max(1, math.ceil(r[1] / BLOCK)) for r in rows.groupBy(group).agg(F.count(F.lit(1))).collect()}
    if real not in sizes:
        return rows.select(group, F.lit(0.0).alias("mmd2")).limit(0)
    number = F.create_map(*[F.lit(x) for kv in sizes.items() for x in kv])
    once = rows.groupBy(group, vector).agg(F.count(F.lit(1)).alias("n")).withColumn("block", F.pmod(F.xxhash64(vector), number[F.col(group)]))
    held = stored(once.groupBy(F.col(group).alias("g"), "block").agg(F.collect_list(F.struct(F.col(vector).alias("v"), "n")).alias("a")), "blocks")
    to = lambda g: F.transform(F.sequence(F.lit(0), number[g] - 1), lambda i: F.struct(g.alias("h"), i.cast("long").alias("to")))
    meets = F.array_distinct(F.concat(to(F.col("g")), to(F.lit(real).cast(rows.schema[group].dataType))))
    right = held.select(F.col("g").alias("h2"), F.col("block").alias("b2"), F.col("a").alias("b"))
    every = held.select("g", "a", F.explode(meets).alias("m")).select("g", "a", "m.*").join(right, (F.col("h") == F.col("h2")) & (F.col("to") == F.col("b2")))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for g, h, a, b in zip(batch["g"], batch["h"], batch["a"], batch["b"], strict=True):
                n, m = (np.array([e["n"] for e in x], float) for x in (a, b))
                kernel = np.exp(-_squares(_stack(a), _stack(b)) / (2 * bandwidth))
                yield pd.DataFrame({"g": [g], "h": [h], "sum": [float(n @ kernel @ m)], "pairs": [float(n.sum() * m.sum())]})

    kind = rows.schema[group].dataType.simpleString()
    sums = every.select("g", "h", "a", "b").mapInPandas(run, f"g {kind}, h {kind}, sum double, pairs double")
    means = stored(sums.groupBy("g", "h").agg((F.sum("sum") / F.sum("pairs")).alias("mean")), "means")
    own = means.where("g = h").select(F.col("g").alias(group), F.col("mean").alias("xx"))
    cross = means.where(F.col("h") == F.lit(real)).select(F.col("g").alias("of"), F.col("mean").alias("xy"))
    yy = means.where((F.col("g") == F.lit(real)) & (F.col("h") == F.lit(real))).first()["mean"]
    return own.join(cross, F.col(group) == F.col("of")).select(group, (F.col("xx") + F.lit(yy) - 2 * F.col("xy")).alias("mmd2"))


def split_sizes(sizes: np.ndarray, drawn: int, first: int, block: int, seed: list[int]) -> tuple[int, int]:
    """How many of ``drawn`` rows, taken without replacement from blocks of these sizes, are the block's, and how many of these are among the
    ``first`` ones.

    The numbers are dealt down a tree of halves of the blocks, each time between two halves by the hypergeometric law and by a seed of its
    own. So every block finds its own numbers alone, and over all blocks they add up.
    """
    ends = np.concatenate([[0], np.cumsum(sizes)])
    lo, hi = 0, len(sizes)
    while hi - lo > 1:
        mid = (lo + hi) // 2
        left, right = int(ends[mid] - ends[lo]), int(ends[hi] - ends[mid])
        rng = np.random.default_rng([*seed, lo, hi])
        drawn_left = int(rng.hypergeometric(left, right, drawn))
        first_left = int(rng.hypergeometric(drawn_left, drawn - drawn_left, first))
        if block < mid:
            hi, drawn, first = mid, drawn_left, first_left
        else:
            lo, drawn, first = mid, drawn - drawn_left, first - first_left
    return drawn, first


def members(numbers: np.ndarray, sizes: np.ndarray, block: int, drawn: int, first: int, repeats: int, seed: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """For each repeat and vector of a block, how many of its equal rows are among the ``first`` rows drawn, and among the others."""
    one, two = np.zeros((2, repeats, len(numbers)))
    for run in range(repeats):
        here, early = split_sizes(sizes, drawn, first, block, [*seed, run])
        rng = np.random.default_rng([*seed, run, len(sizes), block])
        taken = rng.multivariate_hypergeometric(numbers, here, method="marginals")
        one[run] = rng.multivariate_hypergeometric(taken, early, method="marginals")
        two[run] = taken - one[run]
    return one, two


def pack_counts(counts: np.ndarray) -> bytes:
    """Whole numbers as planes of bits, the lowest first; mostly there is one. The first byte is the number of planes."""
    whole = counts.astype(np.int64).ravel()
    planes = max(1, int(whole.max(initial=0)).bit_length())
    return bytes([planes]) + b"".join(np.packbits(whole >> p & 1 == 1).tobytes() for p in range(planes))


def unpack_counts(raw: bytes, repeats: int, width: int) -> np.ndarray:
    planes = np.frombuffer(raw, np.uint8, offset=1).reshape(raw[0], -1)
    bits = np.unpackbits(planes, axis=1, count=repeats * width)
    return sum(row.astype(float) * float(1 << p) for p, row in enumerate(bits)).reshape(repeats, width)


#: What the draws are for, as part of their seeds: halves of the real set, real rows and generated rows of a comparison.
HALVES, REAL, MADE = 0, 1, 2


def mmd_bootstrap(rows: DataFrame, group: str, vector: str, real, bandwidth: float, repeats: int = 200, seed: int = 42) -> DataFrame:
    """A row a group but the real one: median, 0.025 and 0.975 quantile of its discrepancy from the real group over subsamples, the median
    and 0.95 quantile of halves of the real group against each other, and the share of the first above the last.

    Each repeat draws without replacement and to the row as many of either side as the lesser of the group and half the real one, and
    for the baseline two disjoint halves of the real group. Blocks know their part of each draw by themselves (``split_sizes``); it is drawn once
    and stored with the block. A tile's kernel is computed once for all repeats and groups, and of two blocks of one group in one order only;
    a task's sums leave it. Groups are the few sets that are compared, each of under 10**9
    rows; null groups and vectors are none. Fewer than two real rows, or none at all, give no row.
    """
    rows = rows.where(F.col(group).isNotNull() & F.col(vector).isNotNull())
    names = sorted(r[0] for r in rows.groupBy(group).count().collect())
    held = {}
    for name in names:
        dealt = stored(blocks(rows.where(F.col(group) == F.lit(name)), vector, "a"), "blocks")
        counted = {r["a_block"]: r["n"] for r in dealt.select("a_block", F.aggregate("a.n", F.lit(0).cast("long"), lambda t, n: t + n).alias("n")).collect()}
        held[name] = (dealt, np.array([counted.get(b, 0) for b in range(max(counted, default=-1) + 1)], np.int64))
    schema = f"`{group}` {rows.schema[group].dataType.simpleString()}, n long, size long, median double, q025 double, q975 double, real_median double, real_q95 double, exceeds double"
    n_real = int(held[real][1].sum()) if real in held else 0
    half = n_real // 2
    order = {g: i for i, g in enumerate(names)}
    made = [g for g in names if g != real]
    if not half or not made:
        return rows.sparkSession.createDataFrame([], schema)
    drawn = {g: min(int(held[g][1].sum()), half) for g in made}

    def with_draws(name, draws: list[tuple[int, int, list[int]]]) -> DataFrame:
        """A group's blocks with ``w``: of each draw (rows drawn, first ones, seed) the packed members among the first ones, and the others."""
        dealt, sizes = held[name]

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for block, numbers in zip(batch["a_block"], batch["n"], strict=True):
                    found = [members(np.array(numbers, np.int64), sizes, int(block), n, first, repeats, seeds) for n, first, seeds in draws]
                    yield pd.DataFrame({"of": [block], "w": [[pack_counts(x) for both in found for x in both]]})

        numbers = dealt.select("a_block", F.col("a.n").alias("n")).repartition(min(len(sizes), max(rows.sparkSession.sparkContext.defaultParallelism, math.ceil(len(sizes) / 16))), "a_block")
        weights = numbers.mapInPandas(run, "of long, w array<binary>")
        return stored(dealt.join(weights, F.col("a_block") == F.col("of")).drop("of"), "draws")

    with_weights = {g: with_draws(g, [(drawn[g], drawn[g], [seed, MADE, order[g]])]) for g in made}
    # Of the real group the first two are halves; draw i then is at 2 * i.
    with_weights[real] = with_draws(real, [(2 * half, half, [seed, HALVES]), *((drawn[g], drawn[g], [seed, REAL, order[g]]) for g in made)])

    def summed(left, right, u: list[int], w: list[int], sides, whats: list[str]) -> DataFrame:
        """Sums of kernels over tiles of two groups for each of ``whats``: ``sides`` makes its weights from the numbers ``u`` and ``w`` of the draws."""
        alike = left == right

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total = np.zeros((len(whats), repeats))
            for batch in batches:
                for x, y, a, b, of_a, of_b in zip(batch["a_block"], batch["b_block"], batch["a"], batch["b"], batch["u"], batch["w"], strict=True):
                    kernel = np.exp(-_squares(_stack(a), _stack(b)) / (2 * bandwidth))
                    these, those = (np.stack(sides([unpack_counts(r, repeats, len(e)) for r in raw])) for raw, e in ((of_a, a), (of_b, b)))
                    met = (these.reshape(-1, len(a)) @ kernel).reshape(these.shape[:2] + (len(b),))
                    total += np.einsum("kij,kij->ki", met, those) * (2 if alike and x != y else 1)
            yield pd.DataFrame({"what": np.repeat(whats, repeats), "run": np.tile(np.arange(repeats), len(whats)), "sum": total.ravel()})

        picked = lambda at: F.array(*[F.col("w")[i] for i in at])
        one = with_weights[left].select("a_block", "a", picked(u).alias("u"))
        other = with_weights[right].select(F.col("a_block").alias("b_block"), F.col("a").alias("b"), picked(w).alias("w"))
        return tiles(one, other, "a", "b", half=alike).select("a_block", "b_block", "a", "b", "u", "w").mapInPandas(run, "what string, run long, sum double")

    as_drawn = lambda x: x
    draws = {g: 2 * (i + 1) for i, g in enumerate(made)}
    # Halves x and z are as far apart as (x - z) K (x - z).
    real_draws = [0, 1, *draws.values()]
    every = summed(real, real, real_draws, real_draws, lambda x: [x[0] - x[1], *x[2:]], ["h", *(f"r{order[g]}" for g in made)])
    for g in made:
        every = every.unionByName(summed(g, g, [0], [0], as_drawn, [f"m{order[g]}"]))
        every = every.unionByName(summed(real, g, [draws[g]], [0], as_drawn, [f"c{order[g]}"]))
    # A few sums for each repeat: what is left fits the driver by its numbers of groups and repeats alone.
    sums: dict[str, np.ndarray] = {}
    for r in every.groupBy("what", "run").agg(F.sum("sum").alias("sum")).collect():
        sums.setdefault(r["what"], np.zeros(repeats))[r["run"]] = r["sum"]
    baseline = sums["h"] / half**2
    limit, out = float(np.quantile(baseline, 0.95)), []
    for g in made:
        values = (sums[f"r{order[g]}"] + sums[f"m{order[g]}"] - 2 * sums[f"c{order[g]}"]) / drawn[g] ** 2
        figures = [float(np.quantile(values, q)) for q in (0.5, 0.025, 0.975)]
        out.append((g, int(held[g][1].sum()), drawn[g], *figures, float(np.median(baseline)), limit, float((values > limit).mean())))
    return rows.sparkSession.createDataFrame(out, schema)


def assess(median: Column, real_q95: Column, outlier_rate: Column) -> Column:
    """How a group compares: ``compatible`` with the real one, ``outliers`` where over a fifth lie beyond it, else ``partial``."""
    return F.when((median <= real_q95) & (outlier_rate <= 0.05), "compatible").when(outlier_rate > 0.2, "outliers").otherwise("partial")
