"""Readers and writers of sequence files, as Spark sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T


def read_fasta(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``source_file, sequence_id, description, sequence`` from FASTA files; upper-cased, chunks joined.

    Files stay splittable: a record ends where a line starts with ``>``. Records without an id are
    dropped; blank lines, carriage returns and byte order marks go. Files start with a header. Row order is
    not kept.
    """
    raw = spark.read.option("lineSep", "\n>").text(path).select("*", F.col("_metadata.file_path").alias("source_file"))
    text = F.regexp_replace("value", "[\r﻿]", "")
    # Only a file's first piece keeps its own ">".
    head = F.regexp_replace(F.split_part(text, F.lit("\n"), F.lit(1)), "^>", "")
    body = F.upper(F.regexp_replace(F.regexp_replace(text, "^[^\n]*", ""), r"\s+", ""))
    named = raw.select("source_file", F.regexp_extract(F.trim(head), r"^(\S+)", 1).alias("sequence_id"), F.trim(F.regexp_extract(F.trim(head), r"^\S+\s+(.*)$", 1)).alias("description"), body.alias("sequence"))
    return named.where("sequence_id != ''")


def fasta_problems(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``source_file, problem, sequence_id, n``: what makes a file unfit for strict reading.

    ``empty_header`` (a line with nothing behind ``>``), ``text_before_header`` (sequence text that no header names) and
    ``repeated_id`` (an id that several records of the file have).
    """
    raw = spark.read.option("lineSep", "\n>").text(path).select("*", F.col("_metadata.file_path").alias("source_file"))
    # Pieces behind the first of a file have lost their mark; only the first may lack one.
    text = F.regexp_replace("value", "[\r\ufeff]", "")
    opens, before = text.startswith(">"), F.trim(F.regexp_extract(text, r"(?s)^([^>]*)", 1))
    head = F.trim(F.regexp_replace(F.split_part(text, F.lit("\n"), F.lit(1)), "^>", ""))
    first = F.col("_metadata.file_block_start") == 0
    pieces = raw.select("source_file", opens.alias("opens"), head.alias("head"), (before != "").alias("stray"), first.alias("first_block"), F.monotonically_increasing_id().alias("at"))
    starts = pieces.where("first_block").groupBy("source_file").agg(F.min("at").alias("start"))
    named = pieces.join(starts, "source_file").withColumn("is_first", F.col("first_block") & (F.col("at") == F.col("start")))
    kind = F.when(F.col("is_first") & ~F.col("opens") & F.col("stray"), "text_before_header").when(((~F.col("is_first")) | F.col("opens")) & (F.col("head") == ""), "empty_header")
    lost = named.withColumn("problem", kind).where("problem IS NOT NULL").groupBy("source_file", "problem").agg(F.lit(None).cast("string").alias("sequence_id"), F.count(F.lit(1)).alias("n"))
    repeated = read_fasta(spark, path).groupBy("source_file", "sequence_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return lost.unionByName(repeated.withColumn("problem", F.lit("repeated_id")).select(*lost.columns))


def read_fasta_strict(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """As ``read_fasta``; raises ``ValueError`` with the first of ``fasta_problems`` if there is any."""
    found = fasta_problems(spark, path).orderBy("source_file", "problem", "sequence_id").first()
    if found is not None:
        raise ValueError(f"{found['source_file']}: {found['problem']}" + (f" {found['sequence_id']}" if found["sequence_id"] else ""))
    return read_fasta(spark, path)


def fasta_lines(rows: DataFrame, key: str, description: Column, sequence: str, width: int = 80) -> DataFrame:
    """Adds ``record``: header and wrapped sequence; rows of empty sequences go."""
    wrapped = F.regexp_replace(sequence, f"(.{{{width}}})(?!$)", "$1\n")
    return rows.where(F.col(sequence) != "").withColumn("record", F.concat(F.lit(">"), F.trim(F.concat_ws(" ", F.col(key).cast("string"), description)), F.lit("\n"), wrapped))


def write_fasta(rows: DataFrame, path: str, key: str, description: Column, sequence: str, mode: str = "errorifexists") -> None:
    fasta_lines(rows, key, description, sequence).select("record").write.mode(mode).text(path)


HITS = T.StructType([T.StructField(n, t) for n, t in (("query", T.StringType()), ("target", T.StringType()), ("identity", T.DoubleType()), ("alnlen", T.IntegerType()), ("qcov", T.DoubleType()), ("tcov", T.DoubleType()), ("evalue", T.DoubleType()))])


def read_alignment_hits(spark: SparkSession, path: str) -> DataFrame:
    """Seven tab-separated columns; identity over 1 is a percentage; a wrong number of fields fails."""
    hits = spark.read.schema(HITS).option("sep", "\t").option("mode", "FAILFAST").csv(path)
    return hits.withColumn("identity", F.when(F.col("identity") > 1, F.col("identity") / 100).otherwise(F.col("identity")))


def read_profile_hits(spark: SparkSession, path: str) -> DataFrame:
    """``target, evalue, bitscore`` of white-space tables; comments and blank lines go."""
    line = F.trim("value")
    part = F.split(line, r"\s+")
    return spark.read.text(path).where((line != "") & ~line.startswith("#")).select(part[0].alias("target"), part[4].cast("double").alias("evalue"), part[5].cast("double").alias("bitscore"))


def read_cluster_map(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("representative string, member string").option("sep", "\t").option("mode", "FAILFAST").csv(path)


def read_json_records(spark: SparkSession, path: str) -> DataFrame:
    """``sequence`` of each object, else that of its representative annotation; empty ones go."""
    schema = "sequence string, representative_annotation struct<sequence: string>"
    rows = spark.read.schema(schema).option("multiLine", True).json(path)
    return rows.select(F.coalesce(F.nullif(F.trim("sequence"), F.lit("")), F.nullif(F.trim("representative_annotation.sequence"), F.lit(""))).alias("sequence")).where("sequence IS NOT NULL")


QUALIFIER = "struct<GBQualifier_name: string, GBQualifier_value: string>"
FEATURE = f"struct<GBFeature_key: string, GBFeature_location: string, GBFeature_partial5: struct<_value: string>, GBFeature_partial3: struct<_value: string>, GBFeature_quals: struct<GBQualifier: array<{QUALIFIER}>>>"
ANNOTATION = f"`GBSeq_accession-version` string, GBSeq_length int, GBSeq_definition string, GBSeq_organism string, GBSeq_taxonomy string, GBSeq_comment string, GBSeq_sequence string, `GBSeq_update-date` string, `GBSeq_feature-table` struct<GBFeature: array<{FEATURE}>>"


def read_annotation_xml(spark: SparkSession, path: str) -> DataFrame:
    """One row for each annotated record: names, taxon, products, genes, regions, cross references, completeness.

    Repeated values are kept once, in order, joined by `` | ``. A protein feature that spans the whole record
    and is partial at neither end makes it complete.
    """
    rows = spark.read.format("xml").option("rowTag", "GBSeq").schema(ANNOTATION).load(path)
    features = F.coalesce(F.col("GBSeq_feature-table.GBFeature"), F.array())
    quals = F.flatten(F.transform(features, lambda f: F.coalesce(f["GBFeature_quals"]["GBQualifier"], F.array())))

    def values(name: str, of: Column = quals) -> Column:
        picked = F.filter(of, lambda q: q["GBQualifier_name"] == name)
        return F.array_distinct(F.transform(picked, lambda q: q["GBQualifier_value"]))

    joined = lambda a: F.array_join(a, " | ")
    xrefs = values("db_xref")
    protein = F.filter(features, lambda f: f["GBFeature_key"] == "Protein")[0]
    whole = protein["GBFeature_location"] == F.concat(F.lit("1.."), F.col("GBSeq_length").cast("string"))
    partial5, partial3 = protein["GBFeature_partial5"].isNotNull(), protein["GBFeature_partial3"].isNotNull()
    return rows.select(
        F.col("GBSeq_accession-version").alias("accession"), F.col("GBSeq_definition").alias("definition"), F.col("GBSeq_organism").alias("organism"), F.col("GBSeq_taxonomy").alias("taxonomy"),
        F.col("GBSeq_comment").alias("comments"), F.upper("GBSeq_sequence").alias("meta_sequence"), F.col("GBSeq_length").alias("length"), F.col("GBSeq_update-date").alias("update_date"),
        F.regexp_replace(F.filter(xrefs, lambda x: x.startswith("taxon:"))[0], "^taxon:", "").alias("taxid"), joined(values("product")).alias("products"), joined(values("gene")).alias("genes"),
        joined(values("region_name")).alias("region_names"), joined(F.filter(xrefs, lambda x: x.startswith("CDD:"))).alias("cdd_xrefs"), protein["GBFeature_location"].alias("protein_location"),
        F.coalesce(partial5, F.lit(False)).alias("partial5"), F.coalesce(partial3, F.lit(False)).alias("partial3"), F.coalesce(whole & ~partial5 & ~partial3, F.lit(False)).alias("complete_by_feature"),
    )


def write_reports(rows: DataFrame, path: str, by: str = "decision", fmt: str = "parquet", mode: str = "errorifexists") -> None:
    """Audit rows split by a column; arrays are joined by ``;`` for CSV."""
    if fmt == "csv":
        rows = rows.select(*[F.array_join(F.col(c).cast("array<string>"), ";").alias(c) if t.startswith("array") else F.col(c) for c, t in rows.dtypes])
    writer = rows.write.mode(mode).partitionBy(by)
    writer.option("header", True).csv(path) if fmt == "csv" else writer.format(fmt).save(path)
