"""Splits, drift, records and readers that SQL can't express, against plain Python."""

import random

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from bioloom.operators import align, cluster, design, embed, evaluate, features, records
from bioloom.plans import registry
from bioloom.session import numbered
from bioloom.sources import sequences

SF = "/root/testdata/sf0.001"


def plain_half(sizes):
    """Totals in the order in which components reach them, each with the places that do; the nearest to half, then the least list."""
    possible = {0: ()}
    for i, size in enumerate(sizes):
        for total, places in list(possible.items()):
            possible.setdefault(total + size, (*places, i))
    return min(((abs(2 * t - sum(sizes)), p) for t, p in possible.items() if 0 < t < sum(sizes)))[1]


def places_of(classes, taken):
    at = np.cumsum([0, *(n for _, n in classes)])
    return tuple(int(a) + j for a, k in zip(at, taken, strict=False) for j in range(k))


@settings(max_examples=500, deadline=None)
@given(st.dictionaries(st.integers(1, 30), st.integers(1, 4), min_size=1, max_size=6).filter(lambda d: sum(d.values()) > 1))
def test_nearest_half(numbers):
    classes = sorted(numbers.items(), reverse=True)
    assert places_of(classes, cluster.nearest_half(classes)) == plain_half([size for size, n in classes for _ in range(n)])


def test_halves_of_many_components():
    taken = cluster.nearest_half([(1000, 3), (7, 10**6), (1, 10**6)])
    assert abs(2 * sum(t * s for t, s in zip(taken, (1000, 7, 1), strict=True)) - 8_003_000) <= 1
    assert cluster.nearest_half([(10**6, 5)]) == [2]
    taken = cluster.nearest_half([(2000 - i, 3) for i in range(990)])
    assert abs(sum((2 * t - 3) * (2000 - i) for i, t in enumerate(taken))) <= 1


def test_leakfree_split(spark):
    rng = random.Random(4)
    sizes = {c: rng.choice([1, 1, 2, 3, 9]) for c in range(60)}
    comps = spark.createDataFrame([(i, c) for c, n in sizes.items() for i in range(n)], "row long, component long")
    found = {r["component"]: r["split"] for r in cluster.leakfree_split(comps).collect()}
    total, before, train = sum(sizes.values()), 0, set()
    for c in sorted(sizes, key=lambda c: (-sizes[c], c)):
        if before < round(total * 0.7):
            train.add(c)
        before += sizes[c]
    assert {c for c, s in found.items() if s == "train"} == train and set(found) == set(sizes)
    held = [c for c in sorted(sizes, key=lambda c: (-sizes[c], c)) if c not in train]
    chosen = plain_half([sizes[c] for c in held])
    assert [c for c in held if found[c] == "valid"] == [held[i] for i in chosen] and "test" in found.values()
    with pytest.raises(ValueError):
        cluster.leakfree_split(comps.where("component = 3"))


def test_numbered(spark):
    rows = spark.range(0, 500, 1, 7).selectExpr("id", "id * 7919 % 101 AS a")
    found = [(r["a"], r["id"], r["place"]) for r in numbered(rows, F.col("a").desc(), F.col("id")).orderBy("place").collect()]
    assert [x[:2] for x in found] == sorted((x[:2] for x in found), key=lambda x: (-x[0], x[1])) and [x[2] for x in found] == list(range(1, 501))
    assert numbered(rows.limit(0), F.col("a")).collect() == []


def test_drift(spark, monkeypatch):
    monkeypatch.setattr(embed, "BLOCK", 7)
    rng = np.random.default_rng(5)
    rows = [(i, int(i % 3), [float(np.float32(x)) for x in rng.normal(i % 3, 1, 4)]) for i in range(60)]
    rows += [rows[0], rows[1], rows[1]]
    df = spark.createDataFrame(rows, "id long, g int, v array<float>")
    v = {g: np.array([r[2] for r in rows if r[1] == g]) for g in range(3)}
    near = {r["id"]: r["distance"] for r in embed.nearest_distance(df, df.where("g = 0"), "id", "v").collect()}
    for i, _, x in rows:
        assert near[i] == pytest.approx(np.sqrt(((v[0] - np.array(x)) ** 2).sum(1).min()), abs=1e-6)
    kernel = lambda a, b: np.exp(-((a[:, None] - b[None]) ** 2).sum(2) / 4.0)
    for r in embed.mmd2(df, "g", "v", 0, 2.0).collect():
        a, b = v[r["g"]], v[0]
        assert r["mmd2"] == pytest.approx(kernel(a, a).mean() + kernel(b, b).mean() - 2 * kernel(a, b).mean(), abs=1e-9)
    assert embed.mmd2(df, "g", "v", 9, 2.0).collect() == []


def test_nearest_distances_skip_most_of_clustered_vectors(spark, monkeypatch):
    monkeypatch.setattr(embed, "BLOCK", 20)
    rng = np.random.default_rng(7)
    centres = rng.normal(0, 20, (40, 6))
    train = [np.float32(centres[i % 40] + rng.normal(0, 0.3, 6)).tolist() for i in range(2000)]
    asked = [np.float32(centres[i % 40] + rng.normal(0, 0.3, 6)).tolist() for i in range(150)] + [[0.0] * 6, [1000.0] * 6, train[5], train[5]]
    frame = lambda x: spark.createDataFrame(list(enumerate(x)), "id long, v array<float>")
    found = embed.nearest_distance(frame([*asked, None]), frame([*train, train[0], None]), "id", "v").collect()
    assert len(found) == len(asked)
    points = np.array(train)
    for r in found:
        assert r["distance"] == pytest.approx(np.sqrt(((points - asked[r["id"]]) ** 2).sum(1).min()), abs=1e-9)
    assert sum(r["computed"] for r in found) < 0.2 * len(asked) * len(train)
    assert embed.nearest_distance(frame(asked), frame([None]), "id", "v").collect() == []


@pytest.mark.parametrize("gathered", [1 << 16, 3, 0])
def test_median_by_counting(spark, monkeypatch, gathered):
    monkeypatch.setattr(embed, "GATHERED", gathered)
    monkeypatch.setattr(embed, "BLOCK", 6)
    rng = np.random.default_rng(8)
    some = [[float(np.float32(x)) for x in rng.normal(0, 1, 3)] for _ in range(24)]
    cases = {1 << 16: (some + some[:5], some[:3], [[1.0, 2.0]] * 4, []), 3: (some + some[:5], [None, [1.0], [4.0]]), 0: ([[float(i)] for i in range(9)] * 2,)}
    for vectors in cases[gathered]:
        present = np.array([v for v in vectors if v is not None])
        squares = [float(((a - b) ** 2).sum()) for i, a in enumerate(present) for b in present[:i]]
        positive = [x for x in squares if x > 0]
        df = spark.createDataFrame(list(enumerate(vectors)), "id long, v array<float>")
        assert embed.median_bandwidth(df, "id", "v").first()[0] == pytest.approx(float(np.median(positive)) if positive else 1.0, rel=1e-12)


def test_draws_are_exact_in_size_and_without_replacement():
    rng = np.random.default_rng(9)
    numbers = [rng.integers(1, 9, rng.integers(1, 6)) for _ in range(11)] + [np.array([400])]
    sizes = np.array([int(n.sum()) for n in numbers])
    seen = np.zeros(12)
    for seed in range(20):
        drawn = [embed.members(n, sizes, b, 120, 50, 10, [seed]) for b, n in enumerate(numbers)]
        for run in range(10):
            assert sum(one[run].sum() for one, _ in drawn) == 50 and sum(two[run].sum() for _, two in drawn) == 70
        assert all((one + two <= n).all() for (one, two), n in zip(drawn, numbers, strict=True))
        seen += [(one + two).sum() for one, two in drawn]
    # Each block gets its share of all draws.
    assert np.abs(seen / (120 * 200) - sizes / sizes.sum()).max() < 0.01


def test_bootstrap_is_that_of_plain_subsamples(spark, monkeypatch):
    monkeypatch.setattr(embed, "BLOCK", 5)
    rng = np.random.default_rng(6)
    groups = {g: [[float(np.float32(x)) for x in rng.normal(g / 2, 1, 3)] for _ in range(n)] for g, n in ((0, 25), (1, 7), (2, 40))}
    groups[0] += groups[0][:4]
    df = spark.createDataFrame([(g, v) for g, x in groups.items() for v in x] + [(None, [0.0] * 3), (1, None)], "g int, v array<float>")
    found = {r["g"]: r for r in embed.mmd_bootstrap(df, "g", "v", 0, 1.5, 12, 3).collect()}
    assert {g: (r["n"], r["size"]) for g, r in found.items()} == {1: (7, 7), 2: (40, 14)}
    held = {g: {r["a_block"]: r["a"] for r in embed.blocks(df.where(f"g = {g} AND v IS NOT NULL"), "v", "a").collect()} for g in groups}
    sizes = {g: np.array([sum(e["n"] for e in h.get(b, [])) for b in range(max(h) + 1)]) for g, h in held.items()}

    def sample(g, drawn, first, purpose):
        """The rows of each repeat, the first and the others."""
        picked = [([], []) for _ in range(12)]
        for b, entries in held[g].items():
            for which, counts in enumerate(embed.members(np.array([e["n"] for e in entries]), sizes[g], b, drawn, first, 12, purpose)):
                for run in range(12):
                    picked[run][which].extend(e["v"] for e, n in zip(entries, counts[run], strict=True) for _ in range(int(n)))
        return picked

    kernel = lambda a, b: np.exp(-((np.array(a)[:, None] - np.array(b)[None]) ** 2).sum(2) / 3.0).mean()
    apart = lambda a, b: kernel(a, a) + kernel(b, b) - 2 * kernel(a, b)
    halves = sample(0, 28, 14, [3, embed.HALVES])
    assert all(len(x) == len(z) == 14 for x, z in halves)
    baseline = [apart(x, z) for x, z in halves]
    for g, size in ((1, 7), (2, 14)):
        order = sorted(groups).index(g)
        values = [apart(x, y) for (x, _), (y, _) in zip(sample(0, size, size, [3, embed.REAL, order]), sample(g, size, size, [3, embed.MADE, order]), strict=True)]
        expected = [*np.quantile(values, [0.5, 0.025, 0.975]), np.median(baseline), np.quantile(baseline, 0.95), (np.array(values) > np.quantile(baseline, 0.95)).mean()]
        assert list(found[g])[3:] == pytest.approx(expected, abs=1e-9)
    assert found[2]["exceeds"] > 0.9
    assert embed.mmd_bootstrap(df.where("g != 0"), "g", "v", 0, 1.5).collect() == []


def test_bootstrap_draws_once_a_block_and_deals_its_tiles(spark, monkeypatch):
    """Draws for each tile, and tiles in as few tasks as the blocks have files, took most of the time."""
    monkeypatch.setattr(embed, "BLOCK", 5)
    rng = np.random.default_rng(8)
    df = spark.createDataFrame([(g, [float(x) for x in rng.normal(g, 1, 3)]) for g in (0, 1) for _ in range(60)], "g int, v array<double>")
    calls, members = spark.sparkContext.accumulator(0), embed.members

    def counted(*given):
        calls.add(1)
        return members(*given)

    monkeypatch.setattr(embed, "members", counted)
    assert len(embed.mmd_bootstrap(df, "g", "v", 0, 1.5, 4).collect()) == 1
    n = [embed.blocks(df.where(f"g = {g}"), "v", "a").count() for g in (0, 1)]
    assert calls.value == 2 * n[0] + n[1]
    held = embed.stored(embed.blocks(df.where("g = 0"), "v", "a"))
    other = held.select(F.col("a_block").alias("b_block"), F.col("a").alias("b"))
    for half in (False, True):
        met = embed.tiles(held, other, "a", "b", half)
        numbers = sorted(r["a_block"] for r in held.collect())
        assert sorted(tuple(r) for r in met.select("a_block", "b_block").collect()) == [(x, y) for x in numbers for y in numbers if not half or x <= y]
        assert met.select(F.spark_partition_id().alias("p")).distinct().count() > 4


def test_packed_counts():
    rng = np.random.default_rng(9)
    for most in (1, 2, 300, 10**9):
        counts = rng.integers(0, most + 1, (7, 13))
        assert (embed.unpack_counts(embed.pack_counts(counts.astype(float)), 7, 13) == counts).all()


def test_assessments(spark):
    rows = spark.createDataFrame([(0.1, 0.2, 0.05), (0.1, 0.2, 0.1), (0.1, 0.2, 0.3), (0.3, 0.2, 0.0)], "m double, q double, r double")
    assert [r[0] for r in rows.select(embed.assess(F.col("m"), F.col("q"), F.col("r"))).collect()] == ["compatible", "partial", "outliers", "partial"]


def test_readonly_sql(spark):
    df = spark.createDataFrame([(1, "a")], "id long, t string")
    assert records.readonly_sql(spark, {"recs": df}, "WITH q AS (SELECT * FROM recs) SELECT id FROM q ORDER BY id; ").collect()[0]["id"] == 1
    spark.sql("CREATE TABLE IF NOT EXISTS target_of_writes (id long, t string) USING parquet")
    for bad in ("WITH q AS (SELECT * FROM recs) INSERT INTO target_of_writes SELECT * FROM q", "DROP TABLE target_of_writes", "SELECT 1; SELECT 2", "SELECT 1) AS a, (SELECT 2"):
        with pytest.raises(ValueError):
            records.readonly_sql(spark, {"recs": df}, bad)
    assert spark.table("target_of_writes").count() == 0 and not any(t.name == "recs" for t in spark.catalog.listTables())
    spark.sql("DROP TABLE target_of_writes")


def test_strict_fasta(spark, tmp_path):
    cases = {"good": ">a x\nAC\n>b\nDE\n", "empty": ">a\nAC\n>\nDE\n", "stray": "ACD\n>a\nAC\n", "twice": ">a\nAC\n>a q\nDE\n"}
    for name, text in cases.items():
        (tmp_path / f"{name}.fa").write_text(text)
    path = lambda n: str(tmp_path / f"{n}.fa")
    assert sequences.read_fasta_strict(spark, path("good")).count() == 2
    problems = {n: [(r["problem"], r["sequence_id"], r["n"]) for r in sequences.fasta_problems(spark, path(n)).collect()] for n in cases}
    assert problems == {"good": [], "empty": [("empty_header", None, 1)], "stray": [("text_before_header", None, 1)], "twice": [("repeated_id", "a", 2)]}
    for name in ("empty", "stray", "twice"):
        with pytest.raises(ValueError):
            sequences.read_fasta_strict(spark, path(name))


def identity(a, b):
    """Matches over pairs, of one pair on its own; ``test_align`` holds the alignment against a plain one."""
    matches, paired = align.align_batch([a], [b])
    return int(matches[0]) / max(1, int(paired[0]))


def test_nearest_and_novelty_of_runs(spark):
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("ACDE") for _ in range(rng.randint(4, 9)))
    refs, made = [(i, word()) for i in range(6)], [(100 + i, word(), "r" if i % 2 else "s") for i in range(10)] + [(200, "", "s")]
    train, generated = spark.createDataFrame(refs, "id long, seq string"), spark.createDataFrame(made, "id long, seq string, run string")
    best = {i: max(identity(s, t) for _, t in refs) for i, s, _ in made if s}
    for r in evaluate.run_identity(generated, train, "run", "id", "seq", 0.9).collect():
        mine = [(i, s) for i, s, run in made if run == r["run"]]
        known = [best[i] for i, s in mine if s]
        assert r["mean_identity"] == pytest.approx(sum(known) / len(known)) and r["max_identity"] == pytest.approx(max(known))
        assert r["novel_rate"] == pytest.approx(sum(best.get(i, 0) < 0.9 for i, _ in mine) / len(mine))


def test_letters_beyond_latin_and_long_pairs(spark):
    matches, _ = align.align_batch(["жы"], ["qw"])
    assert matches[0] == 0
    rows = [(1, "A" * 3000, "A" * 2999 + "C"), (2, "AC", "AC"), (3, "", "A"), (4, "CA" * 800, "CA" * 800)]
    found = {r["id"]: r["identity"] for r in align.global_identity(spark.createDataFrame(rows, "id long, a string, b string"), "a", "b").collect()}
    assert found[1] == pytest.approx(2999 / 3000) and found[2] == found[4] == 1.0 and found[3] == 0.0


def test_select_diverse(spark):
    rng = random.Random(9)
    rows = [(i, "".join(rng.choice("AC") for _ in range(8)), round(rng.random(), 3)) for i in range(40)]
    found = design.select_diverse(spark.createDataFrame(rows, "id long, seq string, overall double"), "id", 6, 0.6, 0.2)
    taken = []
    for i, s, score in sorted(rows, key=lambda r: (-r[2], r[0])):
        if score >= 0.2 and len(taken) < 6 and all(sum(a == b for a, b in zip(s, t, strict=True)) / 8 < 0.6 for _, t in taken):
            taken.append((i, s))
    assert [r["id"] for r in found] == [i for i, _ in taken]


def test_find_motifs(spark):
    import re

    rows = [(1, "AACDAACD"), (2, ""), (3, "CDCDCD"), (4, None)]
    motifs = {"m": "CD", "n": "A+"}
    found = {tuple(r) for r in features.find_motifs(spark.createDataFrame(rows, "id long, seq string"), "id", "seq", motifs).select("id", "motif", "start").collect()}
    starts = {(i, k, m.start()) for i, s in rows for k, p in motifs.items() for m in re.finditer(p, s or "")}
    shift = min((x[2] for x in found), default=0) - min(x[2] for x in starts)
    assert {(i, k, at + shift) for i, k, at in starts} == found


@pytest.mark.parametrize("name", ["representatives", "leakage_check", "integrated_evaluation", "sample_kmer_markov", "project_pca", "ridge_expression", "max_identity_novelty"])
def test_queries_without_oracle_run_and_repeat(spark, name):
    once, again = (sorted(map(str, registry.QUERIES[name](spark, SF).collect())) for _ in range(2))
    assert once == again and once


def test_representatives(spark):
    rows = spark.createDataFrame([(1, "AAA"), (2, "AAAA"), (3, "CCCC"), (4, "C")], "id long, seq string")
    comps = spark.createDataFrame([(1, 1), (2, 1), (3, 1), (4, 4)], "id long, component long")
    assert {tuple(r) for r in cluster.representatives(rows, "id", "seq", comps).collect()} == {(1, 2, 3), (4, 4, 1)}


def test_leakage(spark):
    pairs = [(1, 2, 0.99, 0.9, 0.9), (2, 1, 0.97, 1.0, 1.0), (1, 3, 0.96, 0.5, 1.0), (1, 4, 1.0, 1.0, 1.0)]
    splits = spark.createDataFrame([(1, "train"), (2, "test"), (3, "valid"), (4, "train")], "id long, split string")
    found = cluster.leakage_check(spark.createDataFrame(pairs, "query long, target long, identity double, qcov double, tcov double"), splits, "id", 0.8, 0.95).first()
    assert tuple(found) == (2, 0.99, 1)


def test_ridge(spark):
    rng = np.random.default_rng(3)
    rows = [[*map(float, rng.normal(0, 1, 9)), float(rng.normal())] for _ in range(50)]
    df = spark.createDataFrame(rows, [*design.FEATURES, "y"])
    x, y = np.array(rows)[:, :9], np.array(rows)[:, 9]
    assert design.ridge_fit(df) == pytest.approx(np.linalg.solve(x.T @ x + 0.15 * np.eye(9), x.T @ y).tolist())
