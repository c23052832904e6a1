"""Frozen versions of a dataset: tagged split tables, and a manifest that is written last and checked whenever they are read."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

SPLITS = ("train", "valid", "test")


def row_digest(columns: list[str]) -> Column:
    """Sixty bits of the MD5 of a row's values as text, each with its length, so that neither nulls nor separators are mistaken."""
    text = [F.col(f"`{c}`").cast("string") for c in columns]
    cells = [F.coalesce(F.concat(F.length(t), F.lit(":"), t), F.lit("-")) for t in text]
    return F.conv(F.substring(F.md5(F.concat_ws("|", *cells).cast("binary")), 1, 15), 16, 10).cast("long")


def table_hash(columns: list[str]) -> list[Column]:
    """Exclusive or and sum of all row digests: the same in any order of rows and however they are dealt; repeated rows change the sum."""
    return [F.bit_xor(row_digest(columns)).alias("hash_xor"), F.sum(row_digest(columns).cast("decimal(38,0)")).cast("string").alias("hash_sum")]


def manifest_of(rows: DataFrame, seq: str) -> DataFrame:
    """A row a split, and one for ``all``: records, letters, least and greatest length, and the hash of the rows."""
    columns = sorted(rows.columns)
    figures = [
        F.count(F.lit(1)).alias("n_records"), F.sum(F.length(seq)).alias("n_residues"), F.min(F.length(seq)).cast("long").alias("min_length"),
        F.max(F.length(seq)).cast("long").alias("max_length"), *table_hash(columns),
    ]
    figures.append(F.max("dataset_version").alias("dataset_version"))
    whole = rows.agg(*figures).select(F.lit("all").alias("split"), "*")
    return rows.groupBy("split").agg(*figures).unionByName(whole)


def problems(rows: DataFrame, key: str, seq: str) -> dict[str, int]:
    """What must not be in a frozen dataset, with how often it is: null keys, repeated keys, repeated or empty sequences, unknown splits."""
    counts = rows.agg(F.count_if(F.col(key).isNull()).alias("null_keys"), F.count_if(F.coalesce(F.length(seq), F.lit(0)) == 0).alias("empty_sequences"), F.count_if(~F.coalesce(F.col("split").isin(*SPLITS), F.lit(False))).alias("unknown_splits")).first()
    found = counts.asDict()
    for name, column in (("repeated_keys", F.col(key)), ("repeated_sequences", F.md5(F.col(seq).cast("binary")))):
        found[name] = rows.groupBy(column.alias("value")).count().where("value IS NOT NULL AND count > 1").count()
    return {name: n for name, n in found.items() if n}


def _checked(found: DataFrame, expected: DataFrame, what: str) -> None:
    differs = found.exceptAll(expected).unionByName(expected.exceptAll(found)).limit(1).count()
    if differs:
        raise ValueError(what)


def freeze(rows: DataFrame, path: str, version: str, key: str, seq: str) -> DataFrame:
    """Writes ``rows`` (with a ``split``) as ``path/version`` and gives its manifest.

    Rows get ``dataset_version`` and ``frozen``, and lie in a table a split, in ranges of the key. They are read back and hashed; only if they
    are what was given the manifest is written, so a version without one isn't whole. Rows that must not be frozen are an error before anything
    is written, and so is a version that exists already, whole or not. ``rows`` are read several times: give stored ones.
    """
    spark = rows.sparkSession
    bad = problems(rows, key, seq)
    if bad:
        raise ValueError(f"not fit to be frozen: {bad}")
    tagged = rows.withColumn("dataset_version", F.lit(version)).withColumn("frozen", F.lit(True))
    dealt = tagged.repartitionByRange(F.col("split"), F.col(key)).sortWithinPartitions("split", key)
    dealt.write.mode("errorifexists").partitionBy("split").parquet(f"{path}/{version}/records")
    expected = manifest_of(tagged, seq)
    written = spark.read.parquet(f"{path}/{version}/records").select(*tagged.columns)
    _checked(manifest_of(written, seq), expected, "the files don't hold the rows that were given")
    expected.coalesce(1).write.mode("errorifexists").json(f"{path}/{version}/manifest")
    return manifest(spark, path, version)


def manifest(spark: SparkSession, path: str, version: str) -> DataFrame:
    return spark.read.schema(MANIFEST).json(f"{path}/{version}/manifest")


MANIFEST = "split string, n_records long, n_residues long, min_length long, max_length long, hash_xor long, hash_sum string, dataset_version string"


def read_frozen(spark: SparkSession, path: str, version: str, seq: str) -> DataFrame:
    """The rows of a frozen version. It is an error if its manifest is missing or doesn't fit what the files hold."""
    try:
        stated = manifest(spark, path, version)
    except AnalysisException as error:
        raise FileNotFoundError(f"version {version} has no manifest: it isn't whole") from error
    rows = spark.read.parquet(f"{path}/{version}/records")
    _checked(manifest_of(rows, seq), stated, f"version {version} isn't what its manifest says")
    return rows
