"""The record database: normalising, merging, filtering, ranking and profiling wide records."""

from __future__ import annotations

from pyspark.errors import ParseException
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from bioloom.session import cumulated, stored


def as_flag(value: Column) -> Column:
    """true/false/1/0/yes/no in any case to a boolean, anything else to null."""
    v = F.lower(F.trim(value))
    return F.when(v.isin("true", "1", "yes"), True).when(v.isin("false", "0", "no"), False)


def as_number(value: Column) -> Column:
    return value.try_cast("double")


def clean_organism(value: Column) -> Column:
    """``un`` for an empty name or an uncultured organism."""
    return F.when(F.coalesce(F.trim(value), F.lit("")) == "", "un").when(F.lower(value).contains("uncultur"), "un").otherwise(value)


def upsert(old: DataFrame, new: DataFrame, keys: list[str], mode: str) -> DataFrame:
    """``append`` keeps the old row of a key, ``update`` the new one, ``overwrite`` only new rows; the first or last of a load."""
    if mode == "overwrite":
        return new
    both = old.withColumn("load_", F.lit(0)).unionByName(new.withColumn("load_", F.lit(1)), allowMissingColumns=True)
    order = [F.col("load_"), F.col("load_order")] if mode == "append" else [F.col("load_").desc(), F.col("load_order").desc()]
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return both.withColumn("place_", place).where("place_ = 1").drop("place_", "load_")


def filter_records(
    rows: DataFrame,
    types: dict[str, list] | None = None,
    contains: tuple[str, list[str]] | None = None,
    ranges: dict[str, tuple[float | None, float | None]] | None = None,
    flags: list[str] | None = None,
) -> DataFrame:
    """Conjunction of in-lists, one literal case-blind search over several columns, ranges (nulls fail) and flags."""
    for column, values in (types or {}).items():
        rows = rows.where(F.col(column).isin(values))
    if contains:
        word, columns = contains
        hit = F.lit(False)
        for c in columns:
            hit = hit | F.coalesce(F.lower(F.col(c)).contains(word.lower()), F.lit(False))
        rows = rows.where(hit)
    for column, (low, high) in (ranges or {}).items():
        if low is not None:
            rows = rows.where(F.col(column) >= low)
        if high is not None:
            rows = rows.where(F.col(column) <= high)
    for flag in flags or []:
        rows = rows.where(F.col(flag) == 1)
    return rows


def by_accession(rows: DataFrame, column: str, accession: str) -> DataFrame:
    """Rows of exactly this accession, white space around either left out."""
    return rows.where(F.trim(column) == accession.strip())


def by_subsequence(rows: DataFrame, sequence: str, part: str, first: int | None = None, last: int | None = None) -> DataFrame:
    """Rows whose sequence holds ``part`` in any case, with its first ``position``; between places ``first`` and ``last`` if given, from 1."""
    start = max(1, first or 1)
    text = F.upper(sequence) if last is None else F.substring(F.upper(sequence), start, max(0, last - start + 1))
    text = text if last is not None or start == 1 else F.substring(text, start, 2**31 - 1)
    at = F.instr(text, part.upper())
    return rows.withColumn("position", (at + (start - 1)).cast("long")).where((at > 0) & F.lit(bool(part)))


def fixed_rank(value: Column, order: list[str]) -> Column:
    """Place in a fixed order; 9999 if unknown."""
    out = F.when(F.lit(False), 0)
    for i, name in enumerate(order):
        out = out.when(value == name, i)
    return out.otherwise(9999)


def readonly_sql(spark: SparkSession, tables: dict[str, DataFrame], statement: str, limit: int | None = 100) -> DataFrame:
    """One SELECT or WITH over registered tables; anything else is refused. ``limit`` is the feature's row cap."""
    text = statement.strip().rstrip(";").strip()
    if not text.lower().startswith(("select", "with")) or ";" in text:
        raise ValueError("only one SELECT or WITH statement is allowed")
    for name, df in tables.items():
        df.createOrReplaceTempView(name)
    try:
        # Only a query can stand in brackets; one that writes, also behind WITH, is no syntax there.
        spark.sql(f"EXPLAIN SELECT * FROM (\n{text}\n) AS asked")
        found = spark.sql(text)
    except ParseException as wrong:
        raise ValueError("only one SELECT or WITH statement is allowed") from wrong
    finally:
        for name in tables:
            spark.catalog.dropTempView(name)
    return found if limit is None else found.limit(limit)


def null_profile(rows: DataFrame) -> DataFrame:
    """``column, n_rows, n_null, completeness`` for every column, in one pass."""
    counts = F.array(*[F.struct(F.lit(c).alias("column"), F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col(c).isNull()).alias("n_null")) for c in rows.columns])
    return rows.agg(counts.alias("c")).select(F.explode("c").alias("c")).select("c.*").withColumn("completeness", (F.col("n_rows") - F.col("n_null")) / F.col("n_rows") * 100)


def histogram(rows: DataFrame, column: str, bins: int = 20) -> DataFrame:
    """Equal-width counts between the least and the greatest value (the greatest is in the last bin)."""
    ends = rows.agg(F.min(column).alias("low"), F.max(column).alias("high"))
    place = F.least(F.lit(bins), F.floor((F.col(column) - F.col("low")) / ((F.col("high") - F.col("low")) / bins)) + 1)
    return rows.crossJoin(F.broadcast(ends)).where(F.col(column).isNotNull()).groupBy(place.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def top_values(rows: DataFrame, columns: list[str], n: int) -> DataFrame:
    """``column, value, n, place``: the ``n`` most frequent values of each column as text, ties by value; nulls don't count."""
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns])
    counts = rows.select(F.explode(cells).alias("x")).select("x.*").where("value IS NOT NULL").groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    place = F.row_number().over(Window.partitionBy("column").orderBy(F.col("n").desc(), "value"))
    return counts.withColumn("place", place).where(F.col("place") <= n)


def correlations(rows: DataFrame, columns: list[str]) -> DataFrame:
    """``a, b, r``: Pearson's correlation of each two columns, in one pass."""
    pairs = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.corr(a, b).alias("r")) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    return rows.agg(F.array(*pairs).alias("x")).select(F.explode("x").alias("x")).select("x.*")


def quantiles(rows: DataFrame, columns: list[str], at: dict[str, float]) -> DataFrame:
    """``column`` and an exact quantile, between neighbours in proportion, for each name in ``at``."""
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for c in columns])
    return grouped_quantiles(rows.select(F.explode(cells).alias("x")).select("x.*"), "column", "value", at)


def grouped_quantiles(rows: DataFrame, group: str, column: str, at: dict[str, float]) -> DataFrame:
    """``group`` and an exact quantile of its values, between neighbours in proportion, for each name in ``at``; nulls are left out.

    Equal values are counted first and then summed along ranges of groups and values, so no task holds all values of a group.
    """
    counts = rows.select(F.col(group).alias("of_"), F.col(column).cast("double").alias("value")).where("value IS NOT NULL").groupBy("of_", "value").agg(F.count(F.lit(1)).alias("n"))
    summed = stored(cumulated(counts, "n", F.col("of_"), F.col("value")), "summed")
    ends = summed.groupBy(F.col("of_").alias("of2")).agg(F.min(F.col("upto") - F.col("n")).alias("start"), F.sum("n").alias("total"))
    joined = summed.join(ends, F.col("of_").eqNullSafe(F.col("of2")))
    place = {name: F.lit(q) * (F.col("total") - 1) for name, q in at.items()}
    value = lambda rank: F.min(F.when(F.col("upto") > F.col("start") + rank, F.col("value")))
    found = joined.groupBy(F.col("of_").alias(group)).agg(
        *[value(F.floor(p)).alias(f"{name}_low") for name, p in place.items()], *[value(F.ceil(p)).alias(f"{name}_high") for name, p in place.items()],
        *[F.first(p - F.floor(p)).alias(f"{name}_part") for name, p in place.items()],
    )
    return found.select(group, *[((1 - F.col(f"{n}_part")) * F.col(f"{n}_low") + F.col(f"{n}_part") * F.col(f"{n}_high")).alias(n) for n in at])


def describe(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Count, mean, deviation, least, exact quartiles and greatest of each column."""
    stats = [F.struct(F.lit(c).alias("column"), F.count(c).alias("n"), F.avg(c).alias("mean"), F.stddev(c).alias("std"), F.min(c).cast("double").alias("min"), F.max(c).cast("double").alias("max")) for c in columns]
    whole = rows.agg(F.array(*stats).alias("s")).select(F.explode("s").alias("s")).select("s.*")
    quarters = quantiles(rows, columns, {"q25": 0.25, "q50": 0.5, "q75": 0.75})
    return whole.join(quarters, "column", "left").select("column", "n", "mean", "std", "min", "q25", "q50", "q75", "max")
