"""Whitening against plain numpy on whole numbers."""

import math

import numpy as np
import pytest

from bioloom.llm import whiten

SCHEMA = "vec_id long, embedding array<float>, label int, `key` string, block int"


def table(spark, vectors, ids=None):
    ids = range(len(vectors)) if ids is None else ids
    return spark.createDataFrame([(i, v, 0, "k", 1) for i, v in zip(ids, vectors, strict=True)], SCHEMA)


def plain(vectors):
    """Whole numbers, deviations, places on the components (up to their sign) and shares, by Python's integers and numpy."""
    x = [[math.floor(float(np.float32(c)) * 64) + 1_000_000 for c in v] for v in vectors]
    fit = sorted(set(map(tuple, x)))
    n, sums = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    apart = [[n * c - s for c, s in zip(row, sums, strict=True)] for row in x]
    centred = np.array([[n * c - s for c, s in zip(row, sums, strict=True)] for row in fit], float) / n
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    return n, [sum(d * d for d in row) for row in apart], (np.array(apart, float) / n) @ vectors / np.sqrt(np.maximum(values, 1e-300)), values / values.sum()


def found(df):
    rows = {}
    for r in df.collect():
        rows.setdefault((r["vec_id"], r["deviation"], r["n"]), []).append((r["component"], r["whitened"], r["explained"], r["identity_error"]))
    return rows


@pytest.mark.parametrize("cells", [1 << 17, 40])
def test_equal_to_numpy_with_copies_and_many_blocks(spark, cells):
    rng = np.random.default_rng(5)
    vectors = (rng.normal(0, 0.2, (300, 5)) * [1, 2, 3, 0.5, 0.2]).tolist()
    vectors += [vectors[0]] * 150 + [vectors[7]]
    fit, rows, error = whiten.fit_and_project(table(spark, vectors).repartition(3), cells=cells)
    n, deviation, places, shares = plain(vectors)
    got = {r["key"]: r for r in rows.collect()}
    assert fit.n == n == 300 and len(got) == 451 and error < 1e-9
    assert [got[i]["deviation"] for i in range(451)] == deviation
    assert np.abs(np.abs([got[i]["whitened"] for i in range(451)]) - np.abs(places)).max() < 1e-8
    assert np.abs(fit.values / fit.trace - shares).max() < 1e-12
    # One sign a component for all rows.
    ratio = np.array([got[i]["whitened"] for i in range(451)]) * places
    assert ((ratio > -1e-12).all(axis=0) | (ratio < 1e-12).all(axis=0)).all()


def test_at_most_sixteen_components_and_all_columns(spark):
    vectors = np.random.default_rng(1).normal(0, 1, (80, 20)).tolist()
    df = whiten.whiten_embeddings(table(spark, vectors))
    assert df.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    rows = found(df)
    assert len(rows) == 80 and all(sorted(c[0] for c in r) == list(range(1, 17)) for r in rows.values())
    shares = [c[2] for c in sorted(next(iter(rows.values())))]
    assert shares == sorted(shares, reverse=True) and sum(shares) < 1


def test_nulls_infinities_other_lengths_null_and_repeated_ids(spark):
    vectors = [[0.5, 1.0], [0.25, -1.0], [1.0, 0.0], None, [None, 1.0], [float("nan"), 1.0], [float("inf"), 1.0], [], [1.0, 2.0, 3.0], [0.5, 1.0], [0.5, 1.0]]
    ids = [0, 1, 2, 3, 4, 5, 6, 7, 8, None, 0]
    rows = found(whiten.whiten_embeddings(table(spark, vectors, ids)))
    assert {k[0] for k in rows} == {0, 1, 2, None} and all(k[2] == 3 for k in rows)
    # Id 0 is there twice with the same vector, and each row has both components.
    assert sum(len(r) for r in rows.values()) == 5 * 2


def test_empty_constant_flat_and_huge(spark):
    assert whiten.whiten_embeddings(table(spark, [])).collect() == []
    assert whiten.whiten_embeddings(table(spark, [None, []])).collect() == []
    assert whiten.whiten_embeddings(table(spark, [[1.0, 2.0]] * 4)).collect() == []
    # The second dimension follows the first: one component.
    rows = found(whiten.whiten_embeddings(table(spark, [[float(i), 2.0 * i] for i in range(9)])))
    assert all([c[0] for c in r] == [1] and abs(c[2] - 1) < 1e-9 for r in rows.values() for c in r)
    rows = found(whiten.whiten_embeddings(table(spark, [[1e30, 0.0], [-1e30, 1.0], [3e30, 2.0]])))
    assert {k[1] for k in rows} == {None}


def test_deviations_beyond_a_long_are_null_and_below_exact(spark):
    x = np.array([[3_000_000_000, 0], [10**10, 10**10]])
    assert whiten.deviations(x, 1, [0, 0]) == [9 * 10**18, None]
