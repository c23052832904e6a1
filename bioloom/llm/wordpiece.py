"""Greedy longest-match piece counts by a linear automaton, without building the pieces.

A trie over the vocabulary gets failure links: where no longer piece fits, the link pops the pieces that are
certain by then and goes on with what is left, and how many it pops is precomputed. Each byte of a word is
read once. Every distinct word of a block is counted once.
"""

from __future__ import annotations

import base64
from collections import deque
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from bioloom.llm.blocks import SubstringHashes, text_blocks, word_spans

CACHE_WORDS = 500_000


class Automaton:
    """Longest-match counts for one vocabulary of byte strings."""

    def __init__(self, vocabulary: Iterable[bytes]):
        children: list[dict[int, int]] = [{}]
        final = [False]
        for piece in vocabulary:
            node = 0
            for byte in piece:
                step = children[node].get(byte)
                if step is None:
                    step = children[node][byte] = len(children)
                    children.append({})
                    final.append(False)
                node = step
            final[node] = node != 0
        # Breadth first, so the link of every shorter string is there.
        link: list[int] = [-1] * len(children)
        popped = [0] * len(children)
        queue = deque([0])
        while queue:
            parent = queue.popleft()
            for byte, node in children[parent].items():
                queue.append(node)
                if final[node]:
                    link[node], popped[node] = 0, 1
                    continue
                at, count = link[parent], popped[parent]
                while at >= 0 and byte not in children[at]:
                    count += popped[at]
                    at = link[at]
                if at >= 0:
                    link[node], popped[node] = children[at][byte], count
        self._children, self._link, self._popped = children, link, popped

    def count(self, word: bytes) -> int:
        """How many pieces greedy longest match makes of ``word``; -1 if a part of it fits no piece."""
        children, link, popped = self._children, self._link, self._popped
        node = count = 0
        for byte in word:
            step = children[node].get(byte)
            while step is None:
                count += popped[node]
                node = link[node]
                if node < 0:
                    return -1
                step = children[node].get(byte)
            node = step
        while node:
            count += popped[node]
            node = link[node]
            if node < 0:
                return -1
        return count


@lru_cache(2)
def automaton(rank_file: str) -> Automaton:
    """Over a rank file: pieces with a leading space start a word, all others continue it."""
    with open(rank_file, "rb") as lines:
        return Automaton(base64.b64decode(line.split()[0]) for line in lines)


def piece_counts(docs: DataFrame, rank_file: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Per row: key, ``n_words``, ``n_pieces`` and ``n_unknown`` (words that no pieces cover; one piece each).

    A word is matched with one space before it. Null and empty texts have no words; repeated rows give
    repeated results; an empty table gives no rows.
    """
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = automaton(rank_file)
        known: dict[bytes, int] = {}
        for batch in batches:
            sums = np.zeros((3, batch.num_rows), np.int64)
            for block in text_blocks(batch.column(1)):
                starts, ends, doc = word_spans(block.buf, block.bounds)
                _, one, back = np.unique(SubstringHashes(block.buf).of(starts, ends), return_index=True, return_inverse=True)
                raw = block.buf.tobytes()
                if len(known) > CACHE_WORDS:
                    known.clear()
                counts = np.zeros(len(one), np.int64)
                for i, (s, e) in enumerate(zip(starts[one].tolist(), ends[one].tolist(), strict=True)):
                    word = raw[s:e]
                    n = known.get(word)
                    if n is None:
                        n = known[word] = machine.count(b" " + word)
                    counts[i] = n
                each, size = counts[back], block.last - block.first
                sums[0, block.first : block.last] = np.bincount(doc, minlength=size)
                sums[1, block.first : block.last] = np.bincount(doc, np.abs(each), minlength=size).astype(np.int64)
                sums[2, block.first : block.last] = np.bincount(doc, each < 0, minlength=size).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, sums)], [key, "n_words", "n_pieces", "n_unknown"])

    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, n_words long, n_pieces long, n_unknown long")
