"""Sequence features that give several values or rows."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, LongType, StringType

from bioloom.functions import residues as R
from bioloom.session import numbered, stored


def window_complexity(seq: Column, window: int) -> dict[str, Column]:
    """Distinct residues over width in each sliding window: mean, least and number of windows (nulls if there is none)."""

    @F.pandas_udf(ArrayType(LongType()))
    def figures(texts: pd.Series) -> pd.Series:
        return pd.Series(distinct_in_windows(texts.tolist(), window), dtype=object)

    found = figures(seq)
    n = found[2]
    return {"mean_complexity": found[0] / (F.when(n > 0, n) * window), "min_complexity": F.when(n > 0, found[1]) / window, "n_windows": n.cast("int")}


def distinct_in_windows(texts: list[str | None], window: int) -> list[list[int] | None]:
    """Of each text the sum and the least of the numbers of distinct letters in its windows, and how many windows there are.

    A letter counts in a window if its last occurrence lies before the window, in one pass over all texts for each place in it.
    """
    sizes = np.array([len(t or "") for t in texts], np.int64)
    codes = np.frombuffer("".join(t or "" for t in texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    codes = codes.astype(np.uint8) if codes.max(initial=0) < 256 else codes
    order = np.argsort(codes, kind="stable")
    last = np.full(len(codes), -1, np.int64)
    same = codes[order[1:]] == codes[order[:-1]]
    last[order[1:][same]] = order[:-1][same]
    starts = np.arange(max(0, len(codes) - window + 1))
    distinct = np.zeros(len(starts), np.int64)
    for at in range(window):
        distinct += last[at : at + len(starts)] < starts
    ends = np.cumsum(sizes)
    out: list[list[int] | None] = []
    for text, first, end in zip(texts, (ends - sizes).tolist(), ends.tolist(), strict=True):
        mine = distinct[first : max(first, end - window + 1)]
        out.append(None if text is None else [int(mine.sum()), int(mine.min(initial=window)), len(mine)])
    return out


def tokenized(seq: Column) -> dict[str, Column]:
    """Token ids, the shifted input and labels, and what they decode to."""
    first, last = F.lit(str(R.BOS)), F.lit(str(R.EOS))
    body = F.when(F.length(seq) > 0, spelled_ids(seq)).when(seq.isNotNull(), "")
    return {
        "n_tokens": F.length(seq) + 2, "tokens": F.concat(first, body, F.lit(" "), last), "inputs": F.concat(first, body),
        "labels": F.ltrim(F.concat(body, F.lit(" "), last)), "decoded": F.regexp_replace(seq, f"(?s)[^{R.AMINO}]", "X"),
    }


class _Ids(dict):
    """What each character's id is written as; a character that is no residue is unknown."""

    def __missing__(self, _: int) -> str:
        return f" {R.UNK}"


@F.pandas_udf(StringType())
def spelled_ids(seq: pd.Series) -> pd.Series:
    """The ids of a sequence's residues in one pass, each behind a space."""
    ids = _Ids({ord(a): f" {i + 4}" for i, a in enumerate(R.AMINO)})
    return pd.Series([None if s is None else s.translate(ids) for s in seq], dtype=object)


def pad_batches(rows: DataFrame, ids: str, group: str, order: str, size: int) -> DataFrame:
    """Adds ``batch, width, padded, mask``: rows of a group in order, ``size`` to a batch, padded to its longest.

    Places come from ranges over all groups, less what stands before a group, one number that goes to all tasks: rows dealt by group would
    meet in as few tasks as there are groups. Widths are reduced a batch at a time. No task holds a group.
    """
    placed = stored(numbered(rows, F.col(group), F.col(order), name="place_"), "places")
    first = placed.groupBy(F.col(group).alias("of_")).agg(F.min("place_").alias("first_"))
    batched = placed.join(F.broadcast(first), F.col(group).eqNullSafe(F.col("of_"))).withColumn("batch", F.floor((F.col("place_") - F.col("first_")) / size).cast("int")).drop("of_", "first_", "place_")
    widths = batched.groupBy(F.col(group).alias("of_"), F.col("batch").alias("batch_")).agg(F.max(F.size(ids)).alias("width"))
    joined = batched.join(widths, F.col(group).eqNullSafe(F.col("of_")) & (F.col("batch") == F.col("batch_"))).drop("of_", "batch_")
    fill = F.array_repeat(F.lit(R.PAD), F.col("width") - F.size(ids))
    real = F.array_repeat(F.lit(1), F.size(ids))
    return joined.withColumn("padded", F.concat(ids, fill)).withColumn("mask", F.concat(real, F.array_repeat(F.lit(0), F.col("width") - F.size(ids))))


def find_motifs(rows: DataFrame, key: str, seq: str, motifs: dict[str, str]) -> DataFrame:
    """One row for each match: key, motif, 0-based start and text. Regex positions need Python, in Arrow batches."""
    kind = rows.schema[key].dataType.simpleString()
    compiled = {name: re.compile(p) for name, p in motifs.items()}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            hits = [(k, name, m.start(), m.group()) for k, s in zip(batch[key], batch[seq], strict=True) if s for name, p in compiled.items() for m in p.finditer(s)]
            yield pd.DataFrame(hits, columns=[key, "motif", "start", "text"])

    return rows.select(key, seq).mapInPandas(run, f"{key} {kind}, motif string, start int, text string")


def motif_counts(rows: DataFrame, group: str, seq: str, motifs: dict[str, str]) -> DataFrame:
    """Hits and sequences with a hit for each group and motif, in one pass."""
    counts = F.array(*[F.struct(F.lit(k).alias("motif"), F.regexp_count(seq, F.lit(p)).alias("n")) for k, p in motifs.items()])
    return rows.select(group, F.explode(counts).alias("m")).groupBy(group, F.col("m.motif").alias("motif")).agg(F.sum("m.n").alias("n_hits"), F.count_if(F.col("m.n") > 0).alias("n_sequences"))
