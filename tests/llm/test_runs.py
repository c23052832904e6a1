"""Runs of words against plain definitions."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from bioloom.llm import runs

SF = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string, lang string, runs int, `collapsed` string"


def table(spark, texts, ids=None):
    return spark.createDataFrame([(i, t, "x", 3, "y") for i, t in zip(range(len(texts)) if ids is None else ids, texts, strict=True)], SCHEMA)


def plain_lyndon(x):
    n = len(x)
    return [max(k for k in range(1, n - i + 1) if all(x[i : i + k] < x[i + j : i + k] for j in range(1, k))) for i in range(n)]


def plain_runs(x, least=12):
    """Every period tried at every place."""
    found = []
    for q in range(1, len(x) // 2 + 1):
        i = 0
        while i + q < len(x):
            start = i
            while i + q < len(x) and x[i] == x[i + q]:
                i += 1
            if i + q - start >= max(least, 2 * q):
                run = x[start : i + q]
                if not any(run[k:] == run[:-k] for k in range(1, q)):
                    found.append((start, i + q - start, q))
            i += 1
    return sorted(found, key=lambda r: (r[0], r[2]))


def plain_row(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(words)
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = plain_runs(words)
    dropped = {i for s, m, q in found for i in range(s + q, s + m)}
    best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=None)
    lines = "".join(f"{s},{m},{q}\n" for s, m, q in found)
    kept = " ".join(w for i, w in enumerate(words) if i not in dropped)
    longest = (None,) * 4 if best is None else (*best, 1000 * best[1] // best[2])
    return (doc_id, len(found), *longest, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest())


@pytest.mark.parametrize("packed", [1 << 20, 4])
def test_lyndon_lengths(monkeypatch, packed):
    monkeypatch.setattr(runs, "PACKED_FROM", packed)
    rng = random.Random(1)
    for _ in range(300):
        x = [rng.randint(0, rng.choice([1, 2, 3])) for _ in range(rng.randint(0, 18))]
        assert runs.lyndon_lengths(np.array(x, np.int64)).tolist() == plain_lyndon(x)


def test_runs_of_random_periodic_and_classic_words():
    rng = random.Random(2)
    cases = [[rng.randint(0, k) for _ in range(rng.randint(0, 80))] for k in (1, 1, 2, 3) for _ in range(150)]
    cases += [[x[i] if i < a else x[a + (i - a) % p] for i in range(80)] for x in ([rng.randint(0, 9) for _ in range(99)] for _ in range(100)) for a in (rng.randint(0, 60),) for p in (rng.randint(1, 9),)]
    fibonacci, before = [0, 1], [0]
    while len(fibonacci) < 500:
        fibonacci, before = fibonacci + before, fibonacci
    thue_morse = [bin(i).count("1") & 1 for i in range(1024)]
    cases += [fibonacci, thue_morse, thue_morse[:600] * 2, [5] * 400, [5] * 11, [5] * 12, list(range(40)) * 3]
    for x in cases:
        for least in (2, 12):
            assert runs.maximal_runs(np.array(x, np.int64), least) == plain_runs(x, least)
        words = [str(v).encode() for v in x]
        assert runs.text_runs([words, [], words]) == [plain_runs(x), [], plain_runs(x)]


def test_colliding_hashes_change_nothing(monkeypatch):
    """With a multiplier of one the hashes know which words stand in a stretch, not their order."""
    monkeypatch.setattr(runs, "MULTIPLIER", 1)
    rng = random.Random(3)
    for _ in range(200):
        x = [rng.randint(0, 1) for _ in range(60)]
        found = set(runs.maximal_runs(np.array(x, np.int64), 4))
        assert found <= set(plain_runs(x, 4))


CASES = [
    None, "", " \t\n", "one", "a " * 11, "a " * 12, "a b " * 6, "a b c " * 4 + "a b", "x " * 5 + "a b c d e f g " * 2, "a b c d e f " * 2, "a b c d e f " * 2 + "a",
    "a b " * 12, "a\x00 b\x1f " * 7, "ä ö ü  " * 5, "A a " * 6, "a b " * 6 + "c " + "a b " * 6, "a a b a a b a a b a a b a a b c", "w " * 3000, " ".join(map(str, range(3000))),
]


def test_against_plain_version_with_planted_periods(spark):
    texts = CASES * 12
    rows = runs.run_documents(table(spark, texts).repartition(3)).collect()
    assert sorted(map(tuple, rows)) == sorted(plain_row(i, t) for i, t in enumerate(texts))
    assert sum(zlib.crc32(str(i).encode()) % 10 == 0 for i in range(len(texts))) > 10


def test_given_table_against_plain_version(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect() if len(r["text"]) < 4000}
    rows = {r["doc_id"]: tuple(r) for r in runs.run_documents(docs).collect()}
    assert len(rows) == 1000 and len(texts) > 700
    assert all(rows[i] == plain_row(i, t) for i, t in texts.items())
    assert sum(r[1] > 0 for r in rows.values()) > 50


def test_empty_table_null_and_repeated_ids(spark):
    df = runs.run_documents(table(spark, []))
    assert df.collect() == [] and df.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert dict(df.dtypes)["exponent_milli"] == "bigint"
    rows = runs.run_documents(table(spark, ["a " * 20, "a " * 20, "b"], [None, None, None])).collect()
    assert sorted(tuple(r)[1:6] for r in rows if r["n_runs"]) == [(1, 0, 20, 1, 20000)] * 2


def test_other_columns_stay_and_texts_collapse(spark):
    row = runs.find_runs(table(spark, ["x  a b " + "a\tb " * 6 + "y"])).collect()[0]
    assert row.asDict(True) == {"doc_id": 0, "lang": "x", "runs": [{"start": 1, "length": 14, "period": 2}], "collapsed": "x a b y"}


def test_very_long_texts(spark):
    period = " ".join(f"w{i}" for i in range(7001))
    texts = [f"{period} " * 60, "word " * 2_000_000, " ".join(f"v{i * i % 1000003}" for i in range(500_000))]
    rows = {r["doc_id"]: r for r in runs.run_documents(table(spark, texts, [1, 2, 3])).collect()}
    assert (rows[1]["n_runs"], rows[1]["length"], rows[1]["period"]) == (1, 7001 * 60, 7001)
    assert (rows[2]["n_runs"], rows[2]["length"], rows[2]["exponent_milli"]) == (1, 2_000_000, 2_000_000_000)
    assert rows[1]["collapsed_sha256"] == hashlib.sha256(period.encode()).hexdigest()
