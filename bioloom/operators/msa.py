"""Columns and rows of multiple alignments. Tasks count residues in dense tables, group by column by letter; no residue is a row."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import ArrayType, IntegerType

from bioloom.functions import residues as R

LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Cells of counts that a task holds before it sends them.
HELD_CELLS = 1 << 22
#: Letters of all groups' consensus that tasks get at once; more are joined to the rows.
SENT_LETTERS = 1 << 26
_NEVER = np.iinfo(np.int64).max


def _residues(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of joined texts: the number of each residue's letter, its column from 0, and its text. All but capital letters are gaps."""
    sizes = np.array([len(t) for t in texts], np.int64)
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64) - ord("A")
    at = np.flatnonzero((codes >= 0) & (codes < len(LETTERS)))
    text = np.repeat(np.arange(len(texts)), sizes)[at]
    return codes[at], at - (np.cumsum(sizes) - sizes)[text], text


def residue_counts(aligned: DataFrame, group: str, key: str, column: str) -> DataFrame:
    """``grp, pos, aa, n, first``: how often each residue stands in each column (from 1) of a group, and the least key that has it.

    Tasks add up a table of columns by letters for each group, sent when they are done or hold ``HELD_CELLS``; at most 26 rows a column leave
    a task then. Only capital letters are residues; all else, and what a short row lacks, are gaps. Null rows have none; keys are
    whole numbers, and null ones never come first.
    """
    kind = aligned.schema[group].dataType.simpleString()
    width = len(LETTERS)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[object, tuple[np.ndarray, np.ndarray]] = {}

        def sent() -> Iterator[pd.DataFrame]:
            for name, (n, first) in held.items():
                at = np.flatnonzero(n)
                least = pd.array(first[at], "Int64")
                least[first[at] == _NEVER] = pd.NA
                yield pd.DataFrame({"grp": pd.Series([name] * len(at), dtype=object), "pos": at // width + 1, "aa": np.array(list(LETTERS), object)[at % width], "n": n[at], "first": least})
            held.clear()

        for batch in batches:
            batch = batch[batch["text"].notna()]
            for name, part in batch.groupby("grp", dropna=False, sort=False):
                name = None if pd.isna(name) else name
                code, pos, text = _residues(part["text"].tolist())
                cells = pos * width + code
                n, first = held.get(name, (np.zeros(0, np.int64), np.zeros(0, np.int64)))
                size = max(len(n), int(cells.max(initial=-1)) + 1)
                n, first = np.pad(n, (0, size - len(n))), np.pad(first, (0, size - len(first)), constant_values=_NEVER)
                n += np.bincount(cells, minlength=size)
                keys = part["key"].astype("Int64").fillna(_NEVER).to_numpy(np.int64)
                np.minimum.at(first, cells, keys[text])
                held[name] = n, first
            if sum(len(n) for n, _ in held.values()) > HELD_CELLS:
                yield from sent()
        yield from sent()

    rows = aligned.select(F.col(group).alias("grp"), F.col(key).cast("long").alias("key"), F.col(column).alias("text"))
    partial = rows.mapInPandas(run, f"grp {kind}, pos long, aa string, n long, first long")
    return partial.groupBy("grp", "pos", "aa").agg(F.sum("n").alias("n"), F.min("first").alias("first"))


def column_stats(counts: DataFrame, rows: DataFrame) -> DataFrame:
    """Consensus (ties: the residue met first) and coverage; ``rows`` has ``grp, n_rows``."""
    top = F.max_by("aa", F.struct("n", -F.col("first")))
    stats = counts.groupBy("grp", "pos").agg(top.alias("consensus"), F.sum("n").alias("n_residues"))
    return stats.join(rows, "grp").withColumn("coverage", F.col("n_residues") / F.col("n_rows")).drop("n_rows")


def row_metrics(aligned: DataFrame, group: str, key: str, column: str, stats: DataFrame) -> DataFrame:
    """Per row: length without gaps, identity to the consensus, leading, internal and trailing gaps, outlier reasons.

    Each group's consensus goes to the tasks as one string and rows are compared with it there. Rows without a residue have no metrics.
    """
    letters = stats.groupBy("grp").agg(F.max("pos").alias("width"), F.array_sort(F.collect_list(F.struct("pos", "consensus"))).alias("c"))
    total = stats.agg(F.count(F.lit(1))).first()[0]
    rows = aligned.select(F.col(group).alias("grp"), F.col(key).alias("key"), F.col(column).alias("text")).where("text IS NOT NULL")
    rows_kind = f"grp {rows.schema['grp'].dataType.simpleString()}, key {rows.schema['key'].dataType.simpleString()}"

    def line(width: int, cells) -> np.ndarray:
        made = np.full(int(width), -1, np.int64)
        for c in cells:
            made[c["pos"] - 1] = ord(c["consensus"]) - ord("A")
        return made

    sent = None
    if total <= SENT_LETTERS:
        sent = {r["grp"]: line(r["width"], r["c"]) for r in letters.collect()}
    else:
        rows = rows.join(letters, rows["grp"].eqNullSafe(letters["grp"])).select(rows["grp"], "key", "text", "width", "c")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for name, part in batch.groupby("grp", dropna=False, sort=False):
                name = None if pd.isna(name) else name
                consensus = sent.get(name, np.zeros(0, np.int64)) if sent is not None else line(part["width"].iloc[0], part["c"].iloc[0])
                code, pos, text = _residues(part["text"].tolist())
                inside = pos < len(consensus)
                hits = np.bincount(text[inside][consensus[pos[inside]] == code[inside]], minlength=len(part))
                length = np.bincount(text, minlength=len(part))
                some = np.flatnonzero(length)
                ends = np.cumsum(length)
                lo, hi = pos[(ends - length)[some]], pos[ends[some] - 1]
                out.append(pd.DataFrame({"grp": pd.Series([name] * len(some), dtype=object), "key": part["key"].to_numpy()[some], "length": length[some], "hits": hits[some], "lo": lo + 1, "hi": hi + 1, "width": len(consensus)}))
            if out:
                yield pd.concat(out, ignore_index=True)

    per = rows.mapInPandas(run, f"{rows_kind}, length long, hits long, lo long, hi long, width long")
    made = per.select(
        "grp", "key", "length", (1 - F.col("length") / F.col("width")).alias("gap_fraction"), F.round(F.col("hits") / F.col("length"), 6).alias("identity"),
        (F.col("lo") - 1).alias("leading"), (F.col("hi") - F.col("lo") + 1 - F.col("length")).alias("internal"), (F.col("width") - F.col("hi")).alias("trailing"),
    )
    reasons = F.array_compact(F.array(F.when(F.col("identity") < 0.75, "low_identity"), F.when(~F.col("length").between(50, 100), "length")))
    return made.withColumn("outlier", F.array_join(reasons, ";"))


def truncated(aligned: DataFrame, group: str, column: str) -> DataFrame:
    """Adds ``width``, the length of the shortest row of the group, and ``cut``, the row up to there. Lengths are reduced and go to all tasks: rows
    dealt by group would meet in as few tasks as there are groups."""
    widths = aligned.groupBy(F.col(group).alias("grp_")).agg(F.min(F.length(column)).alias("width"))
    joined = aligned.join(F.broadcast(widths), F.col(group).eqNullSafe(F.col("grp_"))).drop("grp_")
    return joined.withColumn("cut", F.col(column).substr(F.lit(1), F.col("width")))


def _share(alphabet: str) -> Column:
    return F.sum(F.when(F.col("aa").isin(*alphabet), F.col("n")).otherwise(0)) / F.sum("n")


def position_entropy(counts: DataFrame) -> DataFrame:
    """Per column: Shannon entropy in bits, top share, property class, and whether it is conserved, hypervariable or a constrained variation."""
    total = F.sum("n").over(Window.partitionBy("grp", "pos"))
    shares = counts.withColumn("p", F.col("n") / total)
    hydropathy = F.try_element_at(F.create_map(*[F.lit(x) for kv in R.HYDROPATHY.items() for x in kv]), F.col("aa"))
    made = shares.groupBy("grp", "pos").agg(
        F.round(F.sum(-F.col("p") * F.log2("p")), 10).alias("entropy"), F.max_by("aa", F.struct("n", -F.col("first"))).alias("consensus"), F.max("p").alias("top_share"),
        F.count(F.lit(1)).alias("n_distinct"), F.stddev_pop(hydropathy).alias("spread"), _share("KRHDE").alias("charged"),
        *[_share(a).alias(f"p_{k}") for k, a in R.PROPERTIES.items()],
    )
    names = list(R.PROPERTIES)
    best = F.greatest(*[f"p_{k}" for k in names])
    dominant = F.coalesce(*[F.when(F.col(f"p_{k}") == best, k) for k in names])
    label = F.when(best > 0.7, F.concat(F.lit("strong_"), dominant)).when(best > 0.4, F.concat(F.lit("mixed_"), dominant)).otherwise("balanced")
    constrained = ((F.col("n_distinct") > 1) & (F.col("spread") < 1.5)) | (F.col("charged") > 0.8) | (F.col("charged") < 0.2)
    h = F.col("entropy")
    return made.select(
        "grp", "pos", "consensus", "entropy", "top_share", label.alias("property"), ((h < 0.5) & (F.col("top_share") > 0.9)).alias("conserved"),
        (h > 2.5).alias("hypervariable"), ((h > 1.0) & (h < 2.5) & constrained).alias("novel"),
    )


def conserved_blocks(stats: DataFrame, min_len: int) -> DataFrame:
    """Runs of columns of one kind (0-based ends): a change of kind ends a run, columns of gaps only don't.

    A run ends before the next column that is there; the last run of all is measured to the number of columns.
    """
    by = Window.partitionBy("grp").orderBy("pos")
    kind = F.when(F.col("conserved"), "strict_conserved").when(F.col("novel"), "functional_constrained").otherwise("")
    marked = stats.withColumn("kind", kind).withColumn("fresh", (F.coalesce(F.lag("kind").over(by), F.lit("?")) != F.col("kind")).cast("int"))
    marked = marked.withColumn("run", F.sum("fresh").over(by)).withColumn("after", F.lead("pos").over(by)).withColumn("n_stats", F.count(F.lit(1)).over(Window.partitionBy("grp")))
    runs = marked.groupBy("grp", "run", "kind").agg((F.min("pos") - 1).alias("start"), F.max_by("after", "pos").alias("after"), F.first("n_stats").alias("n_stats"))
    stop = F.coalesce(F.col("after") - 1, F.col("n_stats"))
    return runs.where((F.col("kind") != "") & (stop - F.col("start") >= min_len)).select("grp", "kind", "start", (stop - 1).alias("end"))


def property_switches(stats: DataFrame) -> DataFrame:
    """Columns of a strong property unlike the column before them, with an entropy over 1."""
    before = F.lag("property").over(Window.partitionBy("grp").orderBy("pos"))
    return stats.withColumn("before", before).where((F.col("before") != F.col("property")) & F.col("property").startswith("strong") & (F.col("entropy") > 1.0))


def low_hydropathy_windows(seq: Column, window: int = 15, limit: float = -1.0) -> Column:
    """Starts (from 0) of windows of low mean hydropathy, from the left, none inside a span (ends included) taken before; the last start is
    never tested. Other letters count as zero, null sequences have none. One pass over sums from the left, in whole tenths."""
    tenths = np.zeros(256, np.int64)
    for a, v in R.HYDROPATHY.items():
        tenths[ord(a)] = round(10 * v)

    @F.pandas_udf(ArrayType(IntegerType()))
    def starts(texts: pd.Series) -> pd.Series:
        out = []
        for text in texts:
            raw = np.frombuffer((text or "").encode("latin-1", "replace"), np.uint8)
            sums = np.concatenate([[0], np.cumsum(tenths[raw])])
            low = np.flatnonzero(sums[window:-1] - sums[: len(sums) - window - 1] < 10 * limit * window) if len(raw) > window else np.zeros(0, np.int64)
            taken, at = [], 0
            while at < len(low):
                taken.append(int(low[at]))
                at = int(np.searchsorted(low, low[at] + window, "right"))
            out.append(taken)
        return pd.Series(out)

    return starts(seq)


def functional_regions(stats: DataFrame, examples: DataFrame, min_len: int = 4, window: int = 15) -> DataFrame:
    """All regions of each group, columns from 1, ends included: ``grp, kind, start, end, note, sequence``.

    ``block``: runs of columns of one kind (the note) of at least ``min_len``, with the example's letters; ``adaptive``: columns of medium entropy with a
    leading residue (the note); ``switch``: columns of a strong property unlike the column before; ``disordered``: windows of low hydropathy of the
    example, none overlapping. ``examples`` has ``grp, example``, one sequence a group.
    """
    none = F.lit(None).cast("string")
    cut = F.col("example").substr(F.col("start").cast("int"), (F.col("end") - F.col("start") + 1).cast("int"))
    runs = conserved_blocks(stats, min_len).select(F.col("grp").alias("g"), F.lit("block").alias("kind"), (F.col("start") + 1).alias("start"), (F.col("end") + 1).alias("end"), F.col("kind").alias("note"))
    blocks = runs.join(examples, F.col("g").eqNullSafe(F.col("grp"))).select("grp", "kind", "start", "end", "note", cut.alias("sequence"))
    medium = (F.col("entropy") > 1.5) & (F.col("entropy") < 3.0) & (F.col("top_share") > 0.5) & (F.col("top_share") < 0.9)
    column = lambda kind, note: [F.col("grp"), F.lit(kind).alias("kind"), F.col("pos").alias("start"), F.col("pos").alias("end"), note.alias("note"), none.alias("sequence")]
    adaptive = stats.where(medium).select(*column("adaptive", F.col("consensus")))
    switches = property_switches(stats).select(*column("switch", F.concat("before", F.lit(" -> "), "property")))
    low = examples.select("grp", "example", F.explode(low_hydropathy_windows(F.col("example"), window)).alias("at"))
    low = low.select("grp", "example", F.lit("disordered").alias("kind"), (F.col("at") + 1).cast("long").alias("start"), (F.col("at") + window).cast("long").alias("end"), none.alias("note"))
    return blocks.unionByName(adaptive).unionByName(switches).unionByName(low.select("grp", "kind", "start", "end", "note", cut.alias("sequence")))
