"""Windows and tokens against plain Python, and steps that must not be worked out once for each use."""

from pyspark.sql import functions as F

from bioloom.functions import residues as R
from bioloom.operators import curate, features


def test_distinct_in_windows():
    texts = ["ACDACDAAAA", "AAAA", "", None, "ABCDEFGHIJKL", "Aé" * 9]
    expected = []
    for t in texts:
        n = [len(set(t[i : i + 4])) for i in range(len(t) - 3)] if t is not None else []
        expected.append(None if t is None else [sum(n), min(n, default=4), len(n)])
    assert features.distinct_in_windows(texts, 4) == expected


def test_tokens(spark):
    rows = spark.createDataFrame([("ACX",), ("",), (None,)], "seq string")
    made = [tuple(r) for r in rows.select(*[c.alias(n) for n, c in features.tokenized(F.col("seq")).items()]).collect()]
    assert made[0] == (5, "1 4 5 3 2", "1 4 5 3", "4 5 3 2", "ACX") and made[1] == (2, "1 2", "1", "2", "") and made[2] == (None,) * 5


def test_candidates_work_rules_out_once(spark):
    rows = spark.createDataFrame([(1, "a", "ACD", ["x"]), (2, "a", "ACD", ["x", "bad:1"]), (3, "b", "AC", ["y"])], "seq_order long, sequence_id string, sequence string, reasons array<string>")
    found = curate.candidates(rows, "x", "bad", {"legal": R.is_legal(F.col("sequence"))})
    assert "RLIKE" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(found.select("seq_order", "unique_id", "unique_sequence", "legal").collect()) == [(1, False, False, True), (2, False, False, True)]
