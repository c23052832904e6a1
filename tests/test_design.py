"""Greedy diverse choice against a plain one: ties, chunks, short pools."""

import random

import pytest

from bioloom.operators import design


def plain(rows, k, most, least):
    pool = sorted((r for r in rows if r[2] is not None and r[2] >= least), key=lambda r: (-r[2], r[0]))
    if not pool:
        pool = sorted((r for r in rows if r[2] is not None), key=lambda r: (-r[2], r[0]))[: 3 * k]
    taken = []
    for row in pool:
        alike = lambda a, b: sum(x == y for x, y in zip(a or "", b or "", strict=False)) / (min(len(a or ""), len(b or "")) or 1)
        if len(taken) < k and all(alike(row[1], t[1]) < most for t in taken):
            taken.append(row)
    return [(r[0], r[2], i + 1) for i, r in enumerate(taken)]


@pytest.mark.parametrize(("seed", "k", "most", "least", "chunk"), [(1, 6, 0.4, 0.5, 32), (2, 6, 0.4, 0.5, 1), (3, 30, 0.3, 0.2, 1), (4, 4, 0.5, 2.0, 1), (5, 3, 0.0, 0.1, 2)])
def test_as_a_plain_greedy_choice(spark, monkeypatch, seed, k, most, least, chunk):
    monkeypatch.setattr(design, "CHUNK", chunk)
    rng = random.Random(seed)
    rows = [(i, "".join(rng.choice("ACD") for _ in range(rng.randint(0, 12))), rng.choice([0.1, 0.5, 0.7, 0.7, 0.9])) for i in range(80)]
    rows += [(90, None, 0.9), (91, "ACD", None), (92, None, 0.95)]
    found = design.select_diverse(spark.createDataFrame(rows, "id long, seq string, overall double").repartition(3), "id", k, most, least)
    assert [(r["id"], r["overall"], r["rank"]) for r in found] == plain(rows, k, most, least)


def test_empty(spark):
    assert design.select_diverse(spark.createDataFrame([], "id long, seq string, overall double"), "id", 3, 0.5, 0.1) == []
