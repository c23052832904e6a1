"""Baseline generators: letter frequencies and k-mer chains."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from bioloom.functions import residues as R


def letter_counts(rows: DataFrame, seq: str) -> DataFrame:
    """``aa, n`` over all sequences: twenty sums a task, no explode."""
    sums = F.array(*[F.struct(F.lit(a).alias("aa"), F.sum(F.col("n_")[i]).alias("n")) for i, a in enumerate(R.AMINO)])
    return rows.select(R.letter_counts(seq).alias("n_")).agg(sums.alias("x")).select(F.explode("x").alias("x")).select("x.*")


def uniform(seed: int, *parts: Column) -> Column:
    """A uniform number in [0, 1) from a digest of seed and parts: the same on every engine and partitioning."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), *[p.cast("string") for p in parts]).cast("binary"))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def length_counts(rows: DataFrame, seq: str) -> DataFrame:
    """``length, n``: how many sequences have each length above zero."""
    return rows.where(F.length(seq) > 0).groupBy(F.length(seq).cast("long").alias("length")).agg(F.count(F.lit(1)).alias("n"))


def _ends(counts: DataFrame, what: str) -> tuple[list, np.ndarray]:
    """The values of a small table of counts, in order, and the share of all up to each."""
    rows = counts.where("n > 0").orderBy(what).collect()
    n = [r["n"] for r in rows]
    return [r[what] for r in rows], np.cumsum(n) / max(1, sum(n))


def sample_letters(spark: SparkSession, counts: DataFrame, lengths: DataFrame, n: int, seed: int) -> DataFrame:
    """``idx, seq``: each of a length drawn as often as ``lengths`` has it, of independent letters by their frequencies.

    Every draw is a number made from seed, index and place, so the result is the same however rows are dealt. The driver holds one number for each
    letter and each different length. Without letters or lengths there is no sequence.
    """
    letters, letter_ends = _ends(counts, "aa")
    sizes, size_ends = _ends(lengths, "length")
    if not letters or not sizes:
        return spark.createDataFrame([], "idx long, seq string")

    @F.pandas_udf("long")
    def length_of(u: pd.Series) -> pd.Series:
        return pd.Series(np.array(sizes)[np.minimum(np.searchsorted(size_ends, u.to_numpy(), "right"), len(sizes) - 1)])

    pick = F.lit(letters[-1])
    u = uniform(seed, F.col("idx"), F.col("pos"))
    for aa, end in reversed(list(zip(letters[:-1], letter_ends[:-1].tolist(), strict=True))):
        pick = F.when(u < end, aa).otherwise(pick)
    drawn = spark.range(n).select(F.col("id").alias("idx"), length_of(uniform(seed, F.col("id"), F.lit("length"))).alias("size"))
    cells = drawn.select("idx", F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1)).alias("pos"))
    made = cells.select("idx", F.struct("pos", pick.alias("aa")).alias("c")).groupBy("idx").agg(F.array_sort(F.collect_list("c")).alias("c"))
    return made.select("idx", F.array_join(F.transform("c", lambda x: x["aa"]), "").alias("seq"))


def kmer_counts(rows: DataFrame, seq: str, k: int) -> DataFrame:
    """``context, next, n``: transitions of padded sequences, and letters under the empty context.

    With ``k = 1`` both share the empty context, so letters count twice there.
    """
    padded = F.concat(F.lit("^" * (k - 1)), F.col(seq), F.lit("$"))
    grams = rows.select(F.explode(R.kmers(padded, k)).alias("g")).groupBy("g").agg(F.count(F.lit(1)).alias("n"))
    chain = grams.select(F.left("g", F.lit(k - 1)).alias("context"), F.right("g", F.lit(1)).alias("next"), "n")
    letters = letter_counts(rows, seq).where("n > 0").select(F.lit("").alias("context"), F.col("aa").alias("next"), "n")
    return chain.unionByName(letters).groupBy("context", "next").agg(F.sum("n").alias("n"))


def sample_kmers(spark: SparkSession, counts: DataFrame, n: int, length: int, k: int, seed: int) -> DataFrame:
    """``idx, seq``: walks over the chain, each with a seed of its own. The model has at most 21 rows for each context seen."""
    model: dict[str, tuple[list[str], np.ndarray]] = {}
    for context, part in counts.orderBy("context", "next").toPandas().groupby("context"):
        model[str(context)] = part["next"].tolist(), part["n"].to_numpy(float)
    sent = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = sent.value
        for batch in batches:
            out = []
            for idx in batch["id"]:
                rng = np.random.default_rng((seed, int(idx)))
                context, made = "^" * (k - 1), []
                while len(made) < length:
                    symbols, weights = model.get(context) or model[""]
                    if len(made) < max(1, length - 5):
                        inner = np.array([s != "$" for s in symbols])
                        if not (weights * inner).sum():
                            symbols, weights = model[""]
                            inner = np.array([s != "$" for s in symbols])
                        weights = weights * inner
                    symbol = symbols[int(np.searchsorted(np.cumsum(weights), rng.random() * weights.sum(), "right"))]
                    if symbol == "$":
                        break
                    made.append(symbol)
                    context = (context + symbol)[-(k - 1) :] if k > 1 else ""
                out.append((idx, "".join(made)))
            yield pd.DataFrame(out, columns=["idx", "seq"])

    return spark.range(n).mapInPandas(run, "idx long, seq string")
