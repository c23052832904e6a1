"""Indexes of short words against all pairs."""

import random

import numpy as np
import pytest

from bioloom.operators import align, neighbours
from bioloom.plans import views

SHORT = "/root/testdata/sf0.1"


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def families(seed):
    rng = random.Random(seed)
    rows = []
    for _ in range(12):
        base = [rng.choice("ACDEFGHIKLMNPQRSTVWY") for _ in range(rng.randint(3, 45))]
        for _ in range(rng.randint(1, 7)):
            s = list(base)
            for _ in range(rng.randint(0, 6)):
                at = rng.randrange(len(s) + 1)
                kind = rng.randrange(3)
                if kind == 0:
                    s.insert(at, rng.choice("ACD"))
                elif at < len(s) and len(s) > 1:
                    if kind == 1:
                        del s[at]
                    else:
                        s[at] = rng.choice("ACD")
            rows.append("".join(s))
    rows += [None, "", "A", "AC", "A" * 30, "A" * 29, "A" * 33, "AC" * 15, rows[0], rows[0]]
    rng.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize(("seed", "least", "hot"), [(1, 0.9, 2000), (2, 0.8, 2), (3, 0.6, 1), (4, 1.0, 2000)])
def test_no_pair_within_the_edits_is_lost(spark, seed, least, hot):
    rows = families(seed)
    found = {(r["query"], r["target"]): r for r in neighbours.edit_neighbours(spark.createDataFrame(rows, "id long, seq string"), "id", "seq", least, hot).collect()}
    key = {}
    for i, s in rows:
        if s:
            key[s] = min(i, key.get(s, i))
    nodes = sorted((k, s) for s, k in key.items())
    expected = {(a, b): distance(x, y) for i, (a, x) in enumerate(nodes) for b, y in nodes[i + 1 :] if distance(x, y) <= int((1 - least) * max(len(x), len(y)) + 1e-9)}
    assert {p: r["distance"] for p, r in found.items()} == expected
    by = {k: s for s, k in key.items()}
    for (a, b), r in found.items():
        n, m = len(by[a]), len(by[b])
        assert (r["identity"], r["qcov"], r["tcov"]) == pytest.approx((1 - r["distance"] / max(n, m), min(n, m) / n, min(n, m) / m))


def test_least_must_be_a_share(spark):
    with pytest.raises(ValueError):
        neighbours.edit_neighbours(spark.createDataFrame([], "id long, seq string"), "id", "seq", 0)


def test_bands_as_wide_as_the_gaps_change_nothing():
    rng = random.Random(5)
    pairs = [("".join(rng.choice("ACD") for _ in range(rng.randint(0, 12))), "".join(rng.choice("ACD") for _ in range(rng.randint(0, 12)))) for _ in range(400)]
    q, t = zip(*pairs, strict=True)
    for scoring in (align.PLAIN, align.STRICT):
        whole = np.array(align.align_batch(q, t, scoring))
        for band in ((12, 12), (3, 2), (1, 4)):
            inside = (np.array([len(x) for x in q]) - whole[1] <= band[0]) & (np.array([len(x) for x in t]) - whole[1] <= band[1])
            assert inside.sum() > 50 and (np.array(align.align_batch(q, t, scoring, band))[:, inside] == whole[:, inside]).all()


@pytest.mark.parametrize("hot", [neighbours.HOT, 40])
def test_seeds_find_what_the_exact_way_finds(spark, hot):
    """Every pair is one of the exact way, and at least 0.95 of its pairs over a whole table are found."""
    rows = views.short(spark, SHORT)
    exact = {tuple(r) for r in align.near_duplicates(rows, "page_id", "seq", 0.95, 0.8).collect()}
    found = {tuple(r) for r in neighbours.seeded_neighbours(rows, "page_id", "seq", 0.95, 0.8, hot=hot).collect()}
    assert found <= exact and len(found) >= 0.95 * len(exact) > 1000


def test_empty_tables_and_short_sequences(spark):
    empty = spark.createDataFrame([(1, None), (2, ""), (3, "ACD"), (4, "ACD")], "id long, seq string")
    assert neighbours.seeded_neighbours(empty, "id", "seq", 0.9, 0.8).collect() == []
    assert neighbours.edit_neighbours(empty.limit(0), "id", "seq", 0.9).collect() == []
