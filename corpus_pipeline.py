"""A training corpus in five stages: language, near copies, repeated passages, mixture, tokens.

Each stage takes and gives documents (the last one gives token digests), works on all that the stage before
it kept, and applies one operator of ``bioloom.llm`` with production parameters. Columns that a stage does not
need pass through it under any name.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from bioloom.llm import bpe, langid, mixing, simhash, suffix
from bioloom.llm.blocks import apart
from bioloom.llm.queries import RANKS
from bioloom.session import bounded_batches, stored, table

#: The SQL check has no SimHash and no BPE; tests compare each stage with brute force.
ORACLE_SQL = None


#: Least share of a text's n-grams, corrected, that its language must hold.
LEAST_SCORE = 0.25


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents of which ``LEAST_SCORE`` of the n-grams or more are of the language that they are found to be in.

    The languages are those of the documents that name one. Null texts and texts without a letter go. Where no document
    names a language there is nothing to tell by, and all texts with a letter stay. Repeated rows stay repeated.
    """
    bounded_batches(spark)
    filters = langid.learn(docs)
    own = apart(docs, "text")
    if filters.languages:
        kept = langid.predict(own, filters).where((F.col("lang_pred") != langid.UNDECIDED) & (F.col("score") >= LEAST_SCORE))
    else:
        kept = own.where(F.col("text").rlike(r"\p{L}"))
    return kept.select(*own.columns).toDF(*docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the least id of each group of near copies, once.

    Ids may repeat or be null: a document is its id and its text. Of rows equal in both, the one with the least hash of all
    columns stays.
    """
    bounded_batches(spark)
    # Join and removal of repeated rows have the same keys, so texts are shuffled once. A null id is zero that is no id.
    keys = ["id", "no_id", "text_hash"]
    identity = [F.coalesce("doc_id", F.lit(0)).alias("id"), F.isnull("doc_id").alias("no_id")]
    columns = [F.col(f"`{c}`") for c in docs.columns]
    hashed = [c for c, (_, kind) in zip(columns, docs.dtypes, strict=True) if "map<" not in kind]
    rows = docs.select(*identity, F.xxhash64("text").alias("text_hash"), F.xxhash64(*hashed).alias("order"), F.struct(*columns).alias("doc"))
    kept = rows.join(simhash.keepers(docs).select(*identity, "text_hash"), keys, "left_semi")
    return kept.groupBy(*keys).agg(F.min_by("doc", "order").alias("doc")).select("doc.*")


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes passages that an earlier document has; documents of which nothing is left go.

    What is left of a character that lost some of its bytes goes with them. ``n_chars`` follows the text.
    """
    bounded_batches(spark)
    own = apart(docs, "doc_id", "text", "n_chars")
    # Decoded where they are cut: a step of its own would be a second Python worker beside each task's first.
    left = suffix.remove_repeats(own, decoded=True)
    texts = left.where((suffix.lost() < F.col("n_bytes")) | (F.size("removed") == 0)).withColumnRenamed("kept", "text")
    if "n_chars" in docs.columns:
        texts = texts.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return texts.select(*own.columns).toDF(*docs.columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats, samples and drops documents so that sources come to their target shares."""
    sizes = docs.select("doc_id", "source", mixing.word_count(F.col("text")).alias("size"), mixing.row_hash().alias("row_hash"))
    return mixing.apply_mix(docs, stored(mixing.mix(sizes), "mix"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encodes every document of the mixture and proves the round trip."""
    bounded_batches(spark)
    return bpe.round_trip_digests(docs, public_tokenizers.path(RANKS), public_tokenizers.PATTERN)


STAGES = [
    ("language ID", language),
    ("SimHash near-dedup", near_copies),
    ("suffix-array dedup", repeats),
    ("mixing sources to target weights", mixture),
    ("byte-level BPE encoding and decoding", tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each stored before the next reads it."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), "stage")
    return STAGES[-1][1](spark, docs, sf_dir)
