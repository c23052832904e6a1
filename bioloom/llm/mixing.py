"""Mixing sources to target weights by capped water-filling.

A source may be repeated at most ``max_epochs`` times. Sources whose share would need more are clamped there
and the excess goes to the others by weight until none is above. With ``level`` for the common height of the
water, a target is ``least(cap, weight * level)``; sorted by ``cap / weight``, the clamped sources are a
prefix, so the level follows from running sums over the sources: the first source in this order that the
level of the unclamped rest does not overfill ends the prefix (from there on the quotients only fall, so it is
the greatest that qualifies).

A document is taken ``floor(target / size of source)`` times whole. What is then missing is taken from
documents in a seeded order until it is full; the document on the edge gives its first words only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from bioloom.llm.blocks import apart

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5.0, 2.0, 1.0)
MAX_EPOCHS = 3
SEED = 7


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sources: DataFrame, weights: tuple[float, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """Adds ``weight``, ``target`` to one row per source (``source, source_size``).

    Weights repeat over the sources in code point order, null last. The windows run over the table of
    sources, which is an aggregate with one row each, not over documents. An empty source has target 0.
    """
    order = F.pmod(F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1, F.lit(len(weights)))
    weighed = sources.withColumn("weight", F.array(*map(F.lit, weights))[order])
    everything = Window.partitionBy()
    by_ratio = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    up_to = by_ratio.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    filled = (
        weighed.withColumn("cap", F.col("source_size") * F.lit(max_epochs))
        .withColumn("ratio", F.col("cap") / F.col("weight"))
        .withColumn("total", F.sum("source_size").over(everything))
        .withColumn("all_weight", F.sum("weight").over(everything))
        .withColumn("cap_before", F.coalesce(F.sum("cap").over(up_to), F.lit(0)) - F.col("cap"))
        .withColumn("weight_from", F.col("all_weight") - (F.sum("weight").over(up_to) - F.col("weight")))
        .withColumn("own_level", (F.col("total") - F.col("cap_before")) / F.col("weight_from"))
    )
    level = F.max(F.when(F.col("own_level") <= F.col("ratio"), F.col("own_level"))).over(everything)
    return filled.select(
        "source", "source_size", "weight", F.least(F.col("cap").cast("double"), F.col("weight") * level).alias("target")
    )


def mix(
    sizes: DataFrame,
    weights: tuple[float, ...] = WEIGHTS,
    max_epochs: int = MAX_EPOCHS,
    seed: int = SEED,
    key: str = "doc_id",
) -> DataFrame:
    """Adds ``source_size, target, whole, extra, taken`` to rows of ``key, source, size``.

    ``whole`` is the number of full repetitions, ``extra`` the words of one more that are taken besides.
    The order of the last repetition is by ``md5(seed:key)``. It is summed in two steps, first over 4,096
    slots of the digest for each source, then inside a slot, so that no task gets a whole source. Rows that
    are equal in key and size share their place; a null key counts as the text ``null``.
    """
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit("null"))).cast("binary"))
    # The text column is gone here; what follows shuffles a few dozen bytes a row.
    rows = sizes.withColumn("digest", digest).withColumn("slot", F.substring("digest", 1, 3))
    slots = rows.groupBy("source", "slot").agg(F.sum("size").alias("slot_size"))
    filled = targets(slots.groupBy("source").agg(F.sum("slot_size").alias("source_size")), weights, max_epochs)
    before = Window.partitionBy("source").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    slots = (
        slots.withColumn("slots_before", F.coalesce(F.sum("slot_size").over(before), F.lit(0)))
        .join(F.broadcast(filled).withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of")))
        .drop("of", "slot_size")
        .select(F.col("source").alias("of"), F.col("slot").alias("at"), "slots_before", "source_size", "target")
    )
    inside = Window.partitionBy("source", "slot").orderBy("digest", "size", key).rowsBetween(Window.unboundedPreceding, -1)
    joined = rows.join(slots, F.col("source").eqNullSafe(F.col("of")) & (F.col("slot") == F.col("at"))).drop("of", "at")
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    rest = F.round("target").cast("long") - F.col("whole") * F.col("source_size")
    return (
        joined.withColumn("words_before", F.col("slots_before") + F.coalesce(F.sum("size").over(inside), F.lit(0)))
        .withColumn("whole", whole.cast("long"))
        .withColumn("extra", F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("words_before"))).cast("long"))
        .withColumn("taken", F.col("whole") * F.col("size") + F.col("extra"))
        .drop("digest", "slot", "slots_before", "words_before")
    )


def row_hash() -> Column:
    """What tells rows of one id apart."""
    return F.xxhash64("text", "source")


def apply_mix(docs: DataFrame, mixed: DataFrame, key: str = "doc_id") -> DataFrame:
    """The documents of the mix: each as often as it was taken, the partial repetition cut after its words.

    ``n_chars`` follows the text where the column is there. Documents of no words are never taken.
    Other columns pass through under any name. Where ids repeat, ``mixed`` has a column ``row_hash`` as well.
    """
    hashed = "row_hash" in mixed.columns
    keys = [F.col(key).alias("mix_key"), *([F.col("row_hash").alias("mix_row")] if hashed else [])]
    reps = mixed.filter("taken > 0").groupBy(*keys).agg(F.first("whole").alias("whole"), F.first("extra").alias("extra"), F.first("size").alias("words"))
    own = apart(docs, key, "text", "n_chars", "source")
    same = F.col(key).eqNullSafe(F.col("mix_key"))
    joined = own.join(reps, same & (row_hash() == F.col("mix_row")) if hashed else same)
    copies = F.transform(F.sequence(F.lit(1), F.col("whole") + F.lit(1)), lambda i: F.when(i <= F.col("whole"), F.col("words")).otherwise(F.col("extra")))
    rows = joined.withColumn("mix_words", F.explode(F.filter(copies, lambda n: n > 0)))
    # Each part is a word with the white space before it.
    parts = F.split("text", r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])")
    cut = F.array_join(F.slice(parts, F.lit(1), F.col("mix_words").cast("int")), "")
    rows = rows.withColumn("text", F.when(F.col("mix_words") >= F.col("words"), F.col("text")).otherwise(cut))
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return rows.select(*own.columns).toDF(*docs.columns)


def mix_documents(docs: DataFrame) -> DataFrame:
    """Per document: its size in words, its source's size and target, and the words the mix takes of it."""
    sizes = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"))
    return mix(sizes).select("doc_id", "size", "source_size", "target", "taken")


#: The same by closed form in DuckDB.
MIX_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5(concat('7:', coalesce(doc_id::VARCHAR, 'null'))) AS digest
  FROM documents),
src AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
weighed AS (
  SELECT source, source_size,
         ([5.0, 2.0, 1.0]::DOUBLE[])[1 + (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3] AS weight
  FROM src),
levels AS (
  SELECT *, 3 * source_size AS cap, 3 * source_size / weight AS ratio,
         sum(source_size) OVER ()::BIGINT AS total, sum(weight) OVER () AS all_weight
  FROM weighed),
own AS (
  SELECT *, (total - (sum(cap) OVER w - cap)::BIGINT) / (all_weight - (sum(weight) OVER w - weight)) AS own_level
  FROM levels WINDOW w AS (ORDER BY ratio, source NULLS LAST ROWS UNBOUNDED PRECEDING)),
filled AS (
  SELECT source, source_size,
         least(cap::DOUBLE, weight * (SELECT max(own_level) FROM own WHERE own_level <= ratio)) AS target
  FROM own),
placed AS (
  SELECT s.doc_id, s.size, f.source_size, f.target,
         CASE WHEN f.source_size > 0 THEN floor(f.target / f.source_size) ELSE 0 END::BIGINT AS whole,
         coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.digest, s.size, s.doc_id
                                    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS words_before
  FROM sized s JOIN filled f ON s.source IS NOT DISTINCT FROM f.source)
SELECT doc_id, size, source_size, target,
       (whole * size + greatest(0, least(size, round(target)::BIGINT - whole * source_size - words_before)))::BIGINT AS taken
FROM placed
"""
