"""The registered queries: each operator with production parameters over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from bioloom.llm import bpe, chroma, ctw, digest, langid, mixing, runs, secrets, simhash, suffix, urls, whiten, wordpiece
from bioloom.session import table

RANKS = "byte_bpe_50k.tiktoken"


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip_digests(table(spark, sf_dir, "documents"), public_tokenizers.path(RANKS), public_tokenizers.PATTERN)


def op2_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"))


def op3_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest.compare_edits(table(spark, sf_dir, "documents"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_documents(table(spark, sf_dir, "documents"))


def op5_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.strip_documents(table(spark, sf_dir, "documents"))


def op6_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.group_documents(table(spark, sf_dir, "documents"))


def op8_ctw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ctw.score_documents(table(spark, sf_dir, "documents"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wordpiece.piece_counts(table(spark, sf_dir, "documents"), public_tokenizers.path(RANKS))


def op10_chroma(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chroma.align_embeddings(table(spark, sf_dir, "embeddings"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten.whiten_embeddings(table(spark, sf_dir, "embeddings"))


def op12_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan_documents(table(spark, sf_dir, "documents"))


def op13_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.run_documents(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_bpe": op1_bpe,
    "op2_urls": op2_urls,
    "op3_digest": op3_digest,
    "op4_mixing": op4_mixing,
    "op5_suffix": op5_suffix,
    "op6_langid": op6_langid,
    "op7_simhash": op7_simhash,
    "op8_ctw": op8_ctw,
    "op9_token_counts": op9_token_counts,
    "op10_chroma": op10_chroma,
    "op11_whitening": op11_whitening,
    "op12_secrets": op12_secrets,
    "op13_runs": op13_runs,
}

ORACLES: dict[str, str] = {"op4_mixing": mixing.MIX_SQL}
