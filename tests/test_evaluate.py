"""Judging runs against plain Python: nulls of empty runs, profile rates, screens, nearest references."""

import random

import pytest
from pyspark.sql import functions as F

from bioloom.operators import align, evaluate


def plain(q, t, scoring):
    """Matches and paired residues of the best alignment by a traceback; ties take diagonal, up, left."""
    match, mismatch, gap = scoring
    score, move = {(0, 0): 0}, {}
    for i in range(len(q) + 1):
        for j in range(len(t) + 1):
            options = []
            if i and j:
                options.append((score[i - 1, j - 1] + (match if q[i - 1] == t[j - 1] else mismatch), 2, "d"))
            if i:
                options.append((score[i - 1, j] + gap, 1, "u"))
            if j:
                options.append((score[i, j - 1] + gap, 0, "l"))
            if options:
                score[i, j], _, move[i, j] = max(options)
    i, j, matches, paired = len(q), len(t), 0, 0
    while i or j:
        step = move[i, j]
        if step == "d":
            matches, paired = matches + (q[i - 1] == t[j - 1]), paired + 1
        i, j = i - (step != "l"), j - (step != "u")
    return matches, paired


def test_best_references_lose_nothing(spark):
    rng = random.Random(3)
    base = ["".join(rng.choice("ACDE") for _ in range(n)) for n in (4, 8, 9, 15, 16, 30)]
    refs = [*base, "", base[0]]
    asked = sorted({"".join(rng.choice("ACDE") if rng.random() < 0.2 else c for c in b)[: rng.randint(2, 40)] for b in base for _ in range(6)} | {"A", "ACDE" * 12})
    frame = lambda x, c: spark.createDataFrame([(s,) for s in x], f"{c} string")
    found = {r["s"]: (r["best"], r["full"]) for r in evaluate.best_references(frame(asked, "s"), frame(refs, "t"), 0.8).collect()}
    for s in asked:
        pairs = [(*plain(s, t, align.STRICT), t) for t in base]
        covered = [m / p for m, p, t in pairs if p >= 0.8 * len(s) and p >= 0.8 * len(t)]
        assert found[s][0] == (pytest.approx(max(covered)) if covered else None)
        assert found[s][1] == pytest.approx(max(m / max(len(s), len(t)) for m, _, t in pairs))


def runs(spark):
    rows = [(1, "a", "ACDEFG"), (2, "a", "ACDEFG"), (3, "a", "ACDXFG"), (4, "a", ""), (5, "a", None), (6, "b", "ACD"), (7, "b", "WWWWWW")]
    train = spark.createDataFrame([(90, "ACDEFG"), (91, "ACDEFGHI")], "id long, seq string")
    real = spark.createDataFrame([("ACD",)], "seq string")
    return spark.createDataFrame(rows, "id long, run string, seq string"), train, real


def test_run_report_with_an_empty_run_and_unanswered_hits(spark):
    generated, train, real = runs(spark)
    hits = spark.createDataFrame([(1, True), (2, False), (3, None), (1, True), (77, True)], "id long, hit boolean")
    names = spark.createDataFrame([("a",), ("b",), ("none",), ("a",)], "run string")
    found = {r["run"]: r.asDict() for r in evaluate.run_report(generated, train, "run", "id", "seq", real, names, hits).collect()}
    a, b, none = found["a"], found["b"], found["none"]
    assert len(a) == 19 and set(found) == {"a", "b", "none"}
    assert (a["n_generated"], a["legal_char_rate"], a["length_in_train_range_rate"], a["mean_length"]) == (5, 0.4, 0.6, 3.6)
    assert (a["exact_copy_train_rate"], a["unique_ratio"], a["max_duplicate_fraction"]) == (0.4, 0.6, 0.4)
    assert (a["family_profile_hit_rate"], b["family_profile_hit_rate"]) == (0.5, None)
    assert (b["exact_copy_train_rate"], b["exact_copy_any_real_rate"]) == (0.0, 0.5)
    assert (a["max_nearest_train_identity"], a["novel_sequence_rate"], b["novel_sequence_rate"]) == (1.0, 0.6, 0.5)
    assert {k for k, v in none.items() if v is not None} == {"run", "n_generated", "train_length_min", "train_length_max", "novelty_threshold", "family_profile_status"}
    assert (none["n_generated"], none["train_length_min"], none["train_length_max"], none["family_profile_status"]) == (0, 6, 8, "run")
    without = evaluate.run_report(generated, train, "run", "id", "seq").where("run = 'a'").first()
    assert without["family_profile_hit_rate"] is None and without["family_profile_status"] == "not_run" and without["exact_copy_any_real_rate"] == 0.4


def test_screen_and_reading(spark):
    rows = [(1.0, 0.95, 0.1, 0.5), (0.99, 1.0, 0.1, 0.5), (None, 1.0, None, None), (1.0, None, 0.1, 0.5), (1.0, 0.9, 0.1, 0.5), (1.0, 1.0, 0.2, 0.0), (1.0, 1.0, 0.1, 0.05), (1.0, 1.0, None, None)]
    df = spark.createDataFrame(rows, "v double, p double, l double, n double").withColumn("s", evaluate.fidelity_screen(F.col("v"), F.col("p")))
    found = [tuple(r) for r in df.select("s", evaluate.interpretation(F.col("s"), F.col("l"), F.col("n"))).collect()]
    assert found == [
        ("pass", "eligible"), ("fail_invalid", "not_comparable"), ("fail_invalid", "not_comparable"), ("unassessed", "not_comparable"), ("fail_profile", "not_comparable"),
        ("pass", "drifted"), ("pass", "conservative"), ("pass", "eligible"),
    ]


def test_integrated_runs_without_valid_candidates_have_nulls(spark):
    generated, train, _ = runs(spark)
    found = {r["run"]: r for r in evaluate.integrated(generated, train, "run", "id", "seq").collect()}
    assert (found["a"]["valid_candidate_rate"], found["a"]["mean_full_identity"], found["a"]["novel_95"]) == (0.4, 1.0, 0.0)
    assert (found["b"]["valid_candidate_rate"], found["b"]["fidelity_screen"]) == (0.5, "fail_invalid") and found["b"]["novel_90"] == 1.0
    found = evaluate.integrated(generated.where("id = 6"), train, "run", "id", "seq").first()
    assert found["valid_candidate_rate"] == 0 and found["mean_full_identity"] is None and found["novel_98"] is None
