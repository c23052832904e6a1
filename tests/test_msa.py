"""Dense counts of alignments, rows against the consensus, windows and grouped quantiles, against plain Python."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from bioloom.functions import residues as R
from bioloom.operators import msa, records

ROWS = [
    (3, "a", "AC-DE"), (1, "a", "AC-DF"), (2, "a", "GCA"), (9, "a", None), (8, "a", ""), (7, "a", "--"), (None, "a", "K"), (4, None, "AéZ"), (5, None, "A😀Z"), (4, "b", "acDE"), (6, "b", "AC\x00DE"), (6, "b", "AC\x00DE"),
]


def frame(spark, rows=ROWS):
    return spark.createDataFrame(rows, "key long, grp string, text string").repartition(3)


def plain_counts(rows):
    found = {}
    for key, grp, text in rows:
        for i, c in enumerate(text or ""):
            if "A" <= c <= "Z":
                n, first = found.get((grp, i + 1, c), (0, None))
                found[grp, i + 1, c] = n + 1, key if first is None else first if key is None else min(first, key)
    return found


@pytest.mark.parametrize("held", [1 << 22, 1])
def test_counts(spark, monkeypatch, held):
    monkeypatch.setattr(msa, "HELD_CELLS", held)
    rng = random.Random(2)
    rows = ROWS + [(i, rng.choice(["a", "b", "c"]), "".join(rng.choice("ACDE-xZ") for _ in range(rng.randint(0, 40)))) for i in range(200)]
    found = {(r["grp"], r["pos"], r["aa"]): (r["n"], r["first"]) for r in msa.residue_counts(frame(spark, rows), "grp", "key", "text").collect()}
    assert found == plain_counts(rows)
    assert msa.residue_counts(frame(spark, rows).limit(0), "grp", "key", "text").collect() == []


@pytest.mark.parametrize("sent", [1 << 26, 0])
def test_rows_against_the_consensus(spark, monkeypatch, sent):
    monkeypatch.setattr(msa, "SENT_LETTERS", sent)
    rows = [r for r in ROWS if r[0] is not None]
    numbers = spark.createDataFrame([("a", 5), ("b", 3), (None, 2)], "grp string, n_rows long")
    counts = msa.residue_counts(frame(spark, rows), "grp", "key", "text")
    stats = counts.groupBy("grp", "pos").agg(F.max_by("aa", F.struct("n", -F.col("first"))).alias("consensus"))
    assert msa.column_stats(counts, numbers).where("grp = 'a' AND pos = 1").first()["consensus"] == "A"
    found = [(r["key"], r["length"], r["identity"], r["leading"], r["internal"], r["trailing"], r["gap_fraction"], r["outlier"]) for r in msa.row_metrics(frame(spark, rows), "grp", "key", "text", stats).collect()]
    consensus = {(r["grp"], r["pos"]): r["consensus"] for r in stats.collect()}
    expected = []
    for key, grp, text in rows:
        at = [i + 1 for i, c in enumerate(text or "") if "A" <= c <= "Z"]
        if at:
            width = max(p for g, p in consensus if g == grp)
            hits = sum(consensus[grp, p] == text[p - 1] for p in at)
            reasons = (["low_identity"] if round(hits / len(at), 6) < 0.75 else []) + ["length"]
            expected.append((key, len(at), round(hits / len(at), 6), at[0] - 1, at[-1] - at[0] + 1 - len(at), width - at[-1], pytest.approx(1 - len(at) / width), ";".join(reasons)))
    assert sorted(found, key=lambda r: r[:3]) == sorted(expected, key=lambda r: r[:3])


def plain_windows(text, window=15):
    taken = []
    for i in range(len(text) - window):
        if sum(round(10 * R.HYDROPATHY.get(c, 0)) for c in text[i : i + window]) < -10 * window and not any(a <= i <= a + window for a in taken):
            taken.append(i)
    return taken


def test_windows_from_the_left_in_linear_time(spark):
    rng = random.Random(4)
    texts = ["".join(rng.choice("KKRDENLAGé") for _ in range(rng.randint(0, 90))) for _ in range(60)] + ["K" * 15, "K" * 16, "K" * 33, "", None]
    long = "".join(rng.choice("KKRDENLAG") for _ in range(1_000_000))
    rows = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, long])], "id long, seq string").select("id", msa.low_hydropathy_windows(F.col("seq")).alias("w")).collect()
    found = {r["id"]: r["w"] for r in rows}
    assert [found[i] for i in range(len(texts))] == [plain_windows(t or "") for t in texts]
    assert len(found[len(texts)]) > 30_000 and found[len(texts)][:50] == plain_windows(long[:5000])[:50]


def test_rows_cut_to_the_shortest_of_their_group(spark):
    found = {(r["grp"], r["key"], r["text"]): (r["width"], r["cut"]) for r in msa.truncated(frame(spark, [(1, "a", "ACDE"), (2, "a", "AC"), (3, None, "A"), (4, None, "GGG"), (5, "c", None)]), "grp", "text").collect()}
    assert found == {("a", 1, "ACDE"): (2, "AC"), ("a", 2, "AC"): (2, "AC"), (None, 3, "A"): (1, "A"), (None, 4, "GGG"): (1, "G"), ("c", 5, None): (None, None)}


def test_quantiles_inside_groups(spark):
    rng = np.random.default_rng(5)
    rows = [(g, float(v)) for g, n in (("a", 1), ("b", 2), ("c", 101), (None, 8)) for v in rng.integers(0, 9, n)] + [("a", None), ("d", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    found = {r["g"]: (r["mid"], r["high"]) for r in records.grouped_quantiles(df, "g", "v", {"mid": 0.5, "high": 0.9}).collect()}
    for g in ("a", "b", "c", None):
        values = [v for h, v in rows if h == g and v is not None]
        assert found.pop(g) == pytest.approx((np.quantile(values, 0.5), np.quantile(values, 0.9)))
    assert found == {}


def test_all_kinds_of_regions(spark):
    stats = spark.createDataFrame([("g", i, "K", 0.1 if i < 7 else 2.0, 0.95 if i < 7 else 0.6, "strong_basic" if i != 9 else "balanced", i < 7, False, False) for i in range(1, 12)], "grp string, pos long, consensus string, entropy double, top_share double, property string, conserved boolean, hypervariable boolean, novel boolean")
    examples = spark.createDataFrame([("g", "K" * 17)], "grp string, example string")
    found = sorted(((r["kind"], r["start"], r["end"], r["note"], r["sequence"]) for r in msa.functional_regions(stats, examples).collect()), key=lambda r: r[:2])
    assert found == [*[("adaptive", i, i, "K", None) for i in range(7, 12)], ("block", 1, 6, "strict_conserved", "K" * 6), ("disordered", 1, 15, None, "K" * 15), ("switch", 10, 10, "balanced -> strong_basic", None)]
