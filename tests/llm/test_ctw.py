"""Context-tree weighting against a recursion over dictionaries, and the word baseline against its formula."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from bioloom.llm import ctw

def normal(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return [w.encode() for w in re.findall(r"[^\x20\x09-\x0D]+", low)]


def events(text, depth):
    """(context bytes, latest last; byte) of each symbol."""
    flat = b"".join(w + b" " for w in normal(text)) + b"\xff"
    padded = b"\xff" * depth + flat
    return [(padded[i : i + depth], padded[i + depth]) for i in range(len(flat))]


class PlainTree:
    def __init__(self, texts, depth):
        self.depth = depth
        self.counts = defaultdict(lambda: [0, 0])
        for context, byte in (e for t in texts for e in events(t, depth)):
            for d in range(depth + 1):
                for j in range(8):
                    self.counts[context[depth - d :], (1 << j) | (byte >> (8 - j))][byte >> (7 - j) & 1] += 1
        self.children = defaultdict(list)
        for context, prefix in list(self.counts):
            if context:
                self.children[context[1:], prefix].append((context, prefix))
        self.logs = {}

    @staticmethod
    def kt(a, b):
        return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.log(math.pi) - math.lgamma(a + b + 1)

    def log(self, node):
        if node not in self.logs:
            own = self.kt(*self.counts[node])
            deeper = sum(map(self.log, self.children[node]))
            self.logs[node] = own if len(node[0]) == self.depth else np.logaddexp(own, deeper) - math.log(2)
        return self.logs[node]

    def one(self, context, prefix, d=0):
        node = context[self.depth - d :], prefix
        if node not in self.counts:
            return 0.5
        a, b = self.counts[node]
        own = (b + 0.5) / (a + b + 1)
        if d == self.depth:
            return own
        weight = math.exp(self.kt(a, b) - math.log(2) - self.log(node))
        return weight * own + (1 - weight) * self.one(context, prefix, d + 1)

    def score(self, text):
        total = 0.0
        for context, byte in events(text, self.depth):
            for j in range(8):
                one = self.one(context, (1 << j) | (byte >> (8 - j)))
                total += math.log10(one if byte >> (7 - j) & 1 else 1 - one)
        return total


@pytest.mark.parametrize(("depth", "frequent"), [(5, 1 << 21), (5, 60), (4, 0), (2, 30), (0, 9)])
def test_scores(spark, depth, frequent):
    rng = random.Random(2)
    texts = [" ".join(rng.choice(["Ab", "abba", "b", "cab", "é", "x1"]) for _ in range(rng.randint(0, 12))) for _ in range(25)]
    rows = [(i, t, 0) for i, t in enumerate(texts)] + [(100, None, 0), (101, "", 0), (102, " zzz\tzzz Ab ", 0), (3, texts[3], 0), (None, "b cab", 0)]
    held = {i: zlib.crc32(str(i).encode()) % 10 == 0 if i is not None else True for i, _, _ in rows}
    docs = spark.createDataFrame(rows, "doc_id long, text string, row int")
    found = ctw.score_documents(docs, depth, frequent).collect()
    training = [t for i, t, _ in rows if not held[i]]
    tree = PlainTree(training, depth)
    counts = Counter(w for t in training for w in [*normal(t), None])
    n, v = sum(counts.values()), len(counts)
    expected = []
    for i, text, _ in rows:
        tokens = [*normal(text), None]
        base = sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in tokens)
        expected.append((str(i), held[i], len(tokens), sum(w in counts for w in tokens), n, base, tree.score(text)))
    got = sorted((str(r["doc_id"]), r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"], r["score"]) for r in found)
    for a, b in zip(got, sorted(expected), strict=True):
        assert a[:5] == b[:5]
        assert a[5:] == pytest.approx(b[5:], rel=1e-8)
    assert all(r["bits_per_byte"] * len(events(dict((x, y) for x, y, _ in rows)[r["doc_id"]], 0)) == pytest.approx(-r["score"] * math.log2(10)) for r in found)


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    held = next(i for i in range(1000) if zlib.crc32(str(i).encode()) % 10 == 0)
    only = docs.selectExpr(f"{held}L AS doc_id", "text")
    row = ctw.score_documents(only).first()
    assert (row["train_tokens"], row["n_known"], row["base_score"]) == (0, 0, 0.0)
    assert row["score"] == pytest.approx(-5 * 8 * math.log10(2)) and row["bits_per_byte"] == pytest.approx(8)
    assert ctw.score_documents(docs.limit(0)).collect() == []


def test_probabilities_sum_to_one(spark):
    """Over all bytes that may follow a context, seen or not."""
    seen = "the cat sat on the mat the end"
    raw = seen.encode() + b" \xff"
    strings = Counter((raw[i] << 16) | (raw[i + 1] << 8) | raw[i + 2] for i in range(len(raw) - 2))
    rows = [((ord("t") << 16) | (ord("h") << 8) | b, 1, strings.pop((ord("t") << 16) | (ord("h") << 8) | b, 0)) for b in range(256)] + [(k, n, n) for k, n in strings.items()]
    found = ctw.string_values(spark.createDataFrame(rows, "key long, n long, taught long"), 2).where(f"shiftright(key, 8) = {(ord('t') << 8) | ord('h')}").collect()
    assert len(found) == 256 and sum(10 ** r["value"] for r in found) == pytest.approx(1.0, rel=1e-8)


@pytest.mark.parametrize("depth", [0, 1, 5])
def test_pieces_of_long_texts(monkeypatch, depth):
    texts = ["A bb  cccc\td " * 30, "", None, " x", "y" * 90 + " z", "end"]
    column = pa.array(texts, pa.string())
    whole = [(f, la, e, m) for f, la, e, m in ctw.prepared(column, depth)]
    monkeypatch.setattr(ctw, "CHUNK", 17)
    parts = list(ctw.prepared(column, depth))
    assert len(parts) > len(whole) == 1
    for name in ("strings", "words"):
        assert np.array_equal(np.concatenate([getattr(m, name) for *_, m in parts]), getattr(whole[0][3], name))
