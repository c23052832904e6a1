"""Byte-level BPE encoding and decoding with the tiktoken library and a local rank file.

Texts are cut at safe boundaries first, so no call handles more than a bounded piece of a long text: every
match of the splitting pattern holds white space only at its start or nothing but white space, so the place
between a visible character and a following space or line feed always ends a match, and no look-ahead
reaches across it. A text without such a place stays whole.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame, functions as F

from bioloom.llm.blocks import lean

PIECE_CHARS = 1 << 16
#: A cut goes before this: a space or line feed after a character that is white space in no Unicode version.
SAFE = regex.compile(r"(?<=[^\s\x1c-\x1f\x85᠎​⁠﻿])[ \n]")


@lru_cache(4)
def encoding(rank_file: str, pattern: str) -> tiktoken.Encoding:
    """The encoding of a rank file: one base64 token and its rank on each line; no special tokens."""
    with open(rank_file, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding(rank_file, pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def safe_pieces(text: str, size: int = PIECE_CHARS) -> Iterator[str]:
    """``text`` in pieces that encode one by one as the whole does."""
    start = 0
    while len(text) - start > size:
        cut = SAFE.search(text, start + size)
        if cut is None:
            break
        yield text[start : cut.start()]
        start = cut.start()
    yield text[start:] if start else text


def encode_text(enc: tiktoken.Encoding, text: str | None, size: int = PIECE_CHARS) -> list[int]:
    if not text:
        return []
    if len(text) <= size:
        return enc.encode_ordinary(text)
    return [token for piece in safe_pieces(text, size) for token in enc.encode_ordinary(piece)]


def _extended(df: DataFrame, column: str, field: str) -> str:
    kept = [f for f in df.schema.fields if f.name != column]
    return ", ".join([*(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in kept), f"`{column}` {field}"])


def encode(docs: DataFrame, rank_file: str, pattern: str, text: str = "text", out: str = "token_ids") -> DataFrame:
    """``docs`` without ``text``, with ``out``: the token ids of the whole text.

    A null or empty text gives an empty list. Other columns pass through; one named ``out`` is replaced.
    """
    rest = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c != out or c == text])
    return rest.mapInArrow(_encoder(rank_file, pattern, text, out), _extended(rest.drop(text), out, "array<int>"))


def _encoder(rank_file: str, pattern: str, text: str, out: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(rank_file, pattern)
        for batch in batches:
            at = batch.schema.get_field_index(text)
            others = [i for i in range(batch.num_columns) if i != at and batch.schema.names[i] != out]
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                ids = pa.array([encode_text(enc, x) for x in part.column(at).to_pylist()], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in others), ids], [*(batch.schema.names[i] for i in others), out])

    return run


def decode(docs: DataFrame, rank_file: str, pattern: str, ids: str = "token_ids", out: str = "decoded") -> DataFrame:
    """``docs`` with ``out``: the bytes that the ids in ``ids`` stand for (null ids: no bytes).

    Bytes, not a string: an id may hold part of a character. An id that is not in the rank file fails the job.
    """
    rest = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c != out])
    return rest.mapInArrow(_decoder(rank_file, pattern, ids, out), _extended(rest, out, "binary"))


def _decoder(rank_file: str, pattern: str, ids: str, out: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(rank_file, pattern)
        for batch in batches:
            at = batch.schema.get_field_index(ids)
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                raw = pa.array([enc.decode_bytes(x) if x else b"" for x in part.column(at).to_pylist()], pa.binary())
                yield pa.RecordBatch.from_arrays([*part.columns, raw], [*batch.schema.names, out])

    return run


def round_trip_digests(docs: DataFrame, rank_file: str, pattern: str) -> DataFrame:
    """Per document: the number of ids and digests of the ids and of the bytes they decode to.

    Null texts count as empty, repeated rows give repeated results, an empty table gives no rows. One worker a task does both ways:
    two steps would each have their own, with its own ranks.
    """
    rest = docs.select("doc_id", "text")
    to, back = _encoder(rank_file, pattern, "text", "token_ids"), _decoder(rank_file, pattern, "token_ids", "decoded")
    kind = rest.schema["doc_id"].dataType.simpleString()
    coded = rest.mapInArrow(lean(lambda batches: back(to(batches))), f"doc_id {kind}, token_ids array<int>, decoded binary")
    return coded.select(
        "doc_id",
        F.size("token_ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("token_ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
