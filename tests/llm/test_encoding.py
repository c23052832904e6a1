"""Byte-level BPE and longest-match counts against brute force and exact round trips."""

import hashlib
import re

import public_tokenizers as vocab
import pytest
from hypothesis import given, settings, strategies as st

from bioloom.llm import bpe, wordpiece

RANKS = vocab.path("byte_bpe_50k.tiktoken")
ENC = bpe.encoding(RANKS, vocab.PATTERN)
AUTOMATON = wordpiece.automaton(RANKS)
TEXTS = st.text(alphabet=st.sampled_from("ab é1's \n\t.,\u00a0\u2003\x1c\x85\u4e2d\U0001f600"), max_size=60)


@settings(max_examples=300, deadline=None)
@given(TEXTS, st.integers(1, 12))
def test_safe_pieces_encode_as_the_whole(text, size):
    assert "".join(bpe.safe_pieces(text, size)) == text
    assert bpe.encode_text(ENC, text, size) == ENC.encode_ordinary(text)
    assert ENC.decode_bytes(bpe.encode_text(ENC, text, size)) == text.encode()


@pytest.mark.parametrize("text", [" " * 20_000, "a" * 100_000, "ab " * 60_000, "<|endoftext|>"])
def test_long_texts_round_trip(text):
    assert ENC.decode_bytes(bpe.encode_text(ENC, text)) == text.encode()


def test_digests_of_rows(spark):
    rows = [(1, "Hello  world's end.\n", "x"), (1, "Hello  world's end.\n", "x"), (2, None, "x"), (3, "", None), (None, "é", "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, token_ids string")
    found = sorted(map(tuple, bpe.round_trip_digests(docs, RANKS, vocab.PATTERN).collect()), key=str)

    def expected(i, text):
        ids = ENC.encode_ordinary(text or "")
        return i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()

    assert found == sorted((expected(i, t) for i, t, _ in rows), key=str)
    assert bpe.round_trip_digests(docs.limit(0), RANKS, vocab.PATTERN).collect() == []
    kept = bpe.decode(bpe.encode(docs, RANKS, vocab.PATTERN), RANKS, vocab.PATTERN)
    assert kept.columns == ["doc_id", "token_ids", "decoded"]


def greedy(word: bytes, pieces: set[bytes]) -> int:
    at = count = 0
    while at < len(word):
        end = next((e for e in range(len(word), at, -1) if word[at:e] in pieces), None)
        if end is None:
            return -1
        at, count = end, count + 1
    return count


@settings(max_examples=300, deadline=None)
@given(st.sets(st.binary(min_size=1, max_size=5).map(lambda b: bytes(x % 3 + 97 for x in b)), max_size=12), st.binary(max_size=20).map(lambda b: bytes(x % 3 + 97 for x in b)))
def test_automaton_is_greedy(pieces, word):
    assert wordpiece.Automaton(pieces).count(word) == (greedy(word, pieces) if word else 0)


def test_piece_counts_of_rows(spark):
    rows = [(1, "The unbelievable  thing\n\u00e9t\u00e9", 0), (1, "The unbelievable  thing\n\u00e9t\u00e9", 0), (2, None, 0), (3, " \t", 0), (None, "a" * 5000, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_words int")
    pieces = set(ENC.token_byte_values())
    words = lambda t: re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode())
    expected = [(i, len(words(t)), sum(greedy(b" " + w, pieces) for w in words(t)), 0) for i, t, _ in rows]
    assert sorted(map(tuple, wordpiece.piece_counts(docs, RANKS).collect()), key=str) == sorted(expected, key=str)
