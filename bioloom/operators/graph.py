"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from bioloom.session import stored

MAX_ROUNDS = 60


def _star(edges: DataFrame) -> DataFrame:
    """Each node with the least of itself and its neighbours (``node, low``).

    It is stored before a join, so that both sides of the join have an exchange of their own and a hub's
    partition can be split."""
    return edges.groupBy("node").agg(F.least(F.min("other"), F.col("node")).alias("low"))


def _both(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("b").alias("other")), F.struct(F.col("b").alias("node"), F.col("a").alias("other")))).alias("e")).select("e.*")


def _large_star(edges: DataFrame) -> DataFrame:
    """Link every larger neighbour of a node to the least of its neighbourhood."""
    both = _both(edges)
    low = stored(_star(both).withColumnRenamed("node", "hub"), "lows")
    return both.join(low, F.col("node") == F.col("hub")).where("other > node AND other != low").select(F.col("other").alias("a"), F.col("low").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Link a node and its smaller neighbours to the least of them. ``a > b`` in every edge."""
    down = edges.select(F.col("a").alias("node"), F.col("b").alias("other"))
    low = stored(_star(down).withColumnRenamed("node", "hub"), "lows")
    linked = down.join(low, F.col("node") == F.col("hub"))
    both = linked.select(F.explode(F.array(F.struct(F.col("other").alias("a"), F.col("low").alias("b")), F.struct(F.col("node").alias("a"), F.col("low").alias("b")))).alias("e"))
    return both.select("e.*").where("a != b").distinct()


def components(edges: DataFrame, left: str = "a", right: str = "b") -> DataFrame:
    """``node, component`` for every node with a link to another; the component is its least node.

    Alternating large and small stars: each round every node learns of a lower one, a hub's links are joined
    (and split where skewed) and never gathered, and the rounds grow as the logarithm of the longest chain. Each
    round is written to the shared folder, so lineage stays short and survives lost executors. Loops and
    repeated links are dropped; nulls link nothing. A run that doesn't settle raises an error.
    """
    now = edges.select(F.greatest(left, right).alias("a"), F.least(left, right).alias("b"), F.col(left).alias("l"), F.col(right).alias("r"))
    now = stored(now.where("l IS NOT NULL AND r IS NOT NULL AND a != b").select("a", "b").distinct(), "edges")
    seen = None
    for _ in range(MAX_ROUNDS):
        now = stored(_small_star(_large_star(now)), "stars")
        state = now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()
        if state == seen:
            roots = now.select(F.col("b").alias("node")).distinct()
            return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots.select("node", F.col("node").alias("component")))
        seen = state
    raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
