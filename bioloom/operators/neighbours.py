"""Similar sequences by indexes of short words: exact for edit distances, by seeds for alignments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from bioloom.functions import residues as R
from bioloom.operators.align import PLAIN, global_identity
from bioloom.session import shuffle_partitions, stored

#: Postings of one key beyond which the key is dealt over several tasks.
HOT = 2000
#: Fixed groups of residues that replace each other often; a word of groups survives more mutations than one of residues.
GROUPS = ("LVIM", "C", "A", "G", "ST", "P", "FYW", "EDNQ", "KR", "H")
#: Groups in a word, and the share of its words, the rarest, that a sequence is looked up by.
WORD, SHARE = 3, 0.7
#: Two hits count if their places differ by as much, give or take this.
DRIFT = 4


def distinct_sequences(rows: DataFrame, key: str, seq: str) -> DataFrame:
    """``k, s, n``: each distinct sequence with a letter, its least key and its length."""
    return rows.where(F.length(seq) > 0).groupBy(F.col(seq).alias("s")).agg(F.min(key).alias("k")).select("k", "s", F.length("s").alias("n"))


def _met(left: DataFrame, right: DataFrame, keys: list[str], hot: int) -> DataFrame:
    """``left`` and ``right`` joined on ``keys``. The ``right`` rows of a key with over ``hot`` of them are dealt into parts by their ``k2``;
    the ``left`` ones go to each part, so no task holds a key's rows whole."""
    many = stored(right.groupBy(*keys).count().where(F.col("count") > hot).select(*keys, F.ceil(F.col("count") / hot).cast("int").alias("parts")), "hot")
    one = F.lit(1)
    dealt = right.join(many, keys, "left").withColumn("part", F.pmod(F.xxhash64("k2"), F.coalesce("parts", one)).cast("int")).drop("parts")
    asked = left.join(many, keys, "left").withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", one) - 1))).drop("parts")
    return asked.join(dealt, [*keys, "part"]).drop("part")


def edits(length: Column, least: float) -> Column:
    """How many edits a sequence of some length may be away from a shorter one at a similarity of ``least``."""
    return F.floor((1 - least) * length + 1e-9).cast("int")


def edit_neighbours(rows: DataFrame, key: str, seq: str, least: float, hot: int = HOT) -> DataFrame:
    """``query, target, distance, identity, qcov, tcov`` of all pairs of distinct sequences (``query < target`` by least key) whose edit
    distance is at most ``1 - least`` of the longer length.

    Lossless: the longer sequence is cut into one piece more than it may have edits, so one piece stands unchanged in the
    shorter one, no further away than the edits on both of its sides allow. Pieces are indexed by length of the sequence, number and letters;
    each sequence is looked up by its words of those lengths and places. ``identity`` is one minus distance over the longer length, both
    coverages the shorter over the own length. Null and empty sequences have no pairs; equal ones are one, named by their least key.
    """
    if not 0 < least <= 1:
        raise ValueError("least must be above 0 and at most 1")
    nodes = stored(distinct_sequences(rows, key, seq), "nodes")
    # Piece i of a sequence of n letters begins at i * n / (edits + 1), rounded down.
    pieces = F.transform(F.sequence(F.lit(0), edits(F.col("n"), least)), lambda i: F.struct(i.alias("i"), F.floor(i * F.col("n") / (edits(F.col("n"), least) + 1)).cast("int").alias("at")))
    end = F.floor((F.col("p.i") + 1) * F.col("n") / (edits(F.col("n"), least) + 1)).cast("int")
    index = nodes.withColumn("p", F.explode(pieces)).select(F.col("k").alias("k2"), F.col("s").alias("s2"), F.col("n").alias("size"), F.col("p.i").alias("i"), F.substring("s", F.col("p.at") + 1, end - F.col("p.at")).alias("word"))
    # A sequence meets those of its own and of greater lengths, as far as there are any.
    sizes = nodes.select(F.col("n").alias("size")).distinct()
    longer = nodes.select("k", "s", "n", F.explode(F.sequence("n", F.floor(F.col("n") / least + 1e-9).cast("int"))).alias("size")).join(F.broadcast(sizes), "size")
    allowed = longer.withColumn("most", edits(F.col("size"), least)).where(F.col("size") - F.col("n") <= F.col("most"))
    parts = allowed.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("most"))))
    parts = parts.withColumn("from", F.floor(F.col("i") * F.col("size") / (F.col("most") + 1)).cast("int")).withColumn("width", F.floor((F.col("i") + 1) * F.col("size") / (F.col("most") + 1)).cast("int") - F.col("from"))
    shorter = F.col("size") - F.col("n")
    low = F.greatest(F.lit(0), F.col("from") - F.floor((F.col("most") + shorter) / 2).cast("int"))
    high = F.least(F.col("n") - F.col("width"), F.col("from") + F.floor((F.col("most") - shorter) / 2).cast("int"))
    asked = parts.where(low <= high).withColumn("at", F.explode(F.sequence(low, high))).select("k", "s", "n", "size", "most", "i", F.substring("s", F.col("at") + 1, F.col("width")).alias("word")).distinct()
    pairs = _met(asked, index, ["size", "i", "word"], hot).where((F.col("n") < F.col("size")) | (F.col("k") < F.col("k2")))
    distance = F.levenshtein("s", "s2", 1 << 30)
    found = pairs.dropDuplicates(["k", "k2"]).withColumn("distance", distance).where(F.col("distance") <= F.col("most"))
    first = F.col("k") < F.col("k2")
    own, other = F.col("n") / F.col("n"), F.col("n") / F.col("size")
    return found.select(
        F.least("k", "k2").alias("query"), F.greatest("k", "k2").alias("target"), "distance", (1 - F.col("distance") / F.col("size")).alias("identity"),
        F.when(first, own).otherwise(other).alias("qcov"), F.when(first, other).otherwise(own).alias("tcov"),
    )


def reduced(seq: Column) -> Column:
    """A sequence by groups of residues, each as its first member."""
    return F.translate(seq, "".join(GROUPS), "".join(g[0] * len(g) for g in GROUPS))


def seeded_neighbours(rows: DataFrame, key: str, seq: str, identity: float, coverage: float, scoring: tuple[int, int, int] = PLAIN, word: int = WORD, share: float = SHARE, hot: int = HOT) -> DataFrame:
    """As ``near_duplicates``, but only pairs that share two words, on a reduced alphabet, at about one distance of places are aligned.

    Lossy: with gaps between them two accepted sequences need share no word, so some pairs are missed; all that is returned is exact.
    Each sequence is looked up by the rarest ``share`` of its words, so words that all have make no pairs, and postings of over ``hot``
    entries are dealt over tasks. Alignments keep to the band that the coverage leaves. Sequences of fewer than ``word`` + 1
    letters have less than two words and are left to the exact way.
    """
    nodes = distinct_sequences(rows, key, seq).where(F.col("n") > word)
    counts = [R.count_of(F.col("s"), a).alias(f"n_{a}") for a in R.AMINO]
    nodes = stored(nodes.select("k", "s", "n", *counts), "nodes")
    places = nodes.withColumn("r", reduced(F.col("s"))).select("k", "n", F.explode(F.transform(F.sequence(F.lit(1), F.col("n") - word + 1), lambda i: F.struct(i.alias("at"), F.substring("r", i, F.lit(word)).alias("word")))).alias("w")).select("k", "n", "w.*")
    often = places.groupBy("word").agg(F.count_distinct("k").alias("df"))
    # A sequence's words are gathered, never a word's sequences.
    ranked = places.join(often, "word").groupBy("k", "n").agg(F.array_sort(F.collect_list(F.struct("df", "word", "at"))).alias("all"))
    rare = ranked.select("k", "n", F.explode(F.slice("all", 1, F.ceil(F.size("all") * share).cast("int"))).alias("w")).select("k", "n", "w.word", "w.at")
    rare = stored(rare, "words")
    other = rare.select(F.col("k").alias("k2"), F.col("n").alias("n2"), "word", F.col("at").alias("at2"))
    hits = _met(rare, other, ["word"], hot).where((F.col("k") < F.col("k2")) & (F.least("n", "n2") >= coverage * F.greatest("n", "n2") - 1e-9))
    # Two grids, half a step apart, hold any two hits that drift by less than half a step in the same cell of one.
    apart = F.col("at") - F.col("at2")
    cells = F.explode(F.array(*[F.struct(F.lit(g).alias("grid"), F.floor((apart + g * DRIFT) / (2 * DRIFT)).alias("cell")) for g in (0, 1)]))
    twice = hits.select("k", "k2", "at", cells.alias("c")).groupBy("k", "k2", "c").agg((F.min("at") < F.max("at")).alias("two")).where("two").select("k", "k2").distinct()
    sides = [nodes.select(*[F.col(c).alias(f"{name}_{c}") for c in nodes.columns]) for name in ("a", "b")]
    pairs = twice.join(sides[0], F.col("k") == F.col("a_k")).join(sides[1], F.col("k2") == F.col("b_k"))
    longest = F.greatest("a_n", "b_n")
    overlap = R.total([F.least(f"a_n_{a}", f"b_n_{a}") for a in R.AMINO])
    pairs = pairs.where(overlap >= identity * coverage * longest - 1e-9).select(F.col("k").alias("query"), F.col("k2").alias("target"), F.col("a_s").alias("q"), F.col("b_s").alias("t"))
    found = global_identity(pairs.repartition(shuffle_partitions(rows.sparkSession), "query", "target"), "q", "t", scoring, identity * coverage, coverage)
    return found.where((F.col("identity") >= identity) & (F.col("qcov") >= coverage) & (F.col("tcov") >= coverage)).drop("q", "t")
