"""Frozen datasets: order-free hashes, refusals, torn versions; and reports by decision."""

import json
import os

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from bioloom.operators import freeze
from bioloom.sources import sequences


def records(spark, rows=None):
    rows = [(i, "ACDEF" + "GHIKL"[i % 5] * (i + 1), ("train", "valid", "test")[i % 3], None if i % 4 else "x|y") for i in range(12)] if rows is None else rows
    return spark.createDataFrame(rows, "id long, seq string, split string, note string")


def test_freeze_and_read(spark, tmp_path):
    rows = records(spark)
    made = {r["split"]: r for r in freeze.freeze(rows, str(tmp_path), "v1", "id", "seq").collect()}
    assert {s: r["n_records"] for s, r in made.items()} == {"train": 4, "valid": 4, "test": 4, "all": 12}
    assert made["all"]["n_residues"] == sum(6 + i for i in range(12)) and {r["dataset_version"] for r in made.values()} == {"v1"}
    back = freeze.read_frozen(spark, str(tmp_path), "v1", "seq")
    assert sorted((r["id"], r["seq"], r["split"], r["note"]) for r in back.collect()) == sorted(map(tuple, rows.collect()))
    assert sorted(os.listdir(tmp_path / "v1" / "records"))[-3:] == ["split=test", "split=train", "split=valid"]


def test_a_second_freeze_fails_and_changes_nothing(spark, tmp_path):
    freeze.freeze(records(spark), str(tmp_path), "v1", "id", "seq")
    before = sorted(tuple(r) for r in freeze.manifest(spark, str(tmp_path), "v1").collect())
    with pytest.raises(AnalysisException):
        freeze.freeze(records(spark).limit(3), str(tmp_path), "v1", "id", "seq")
    assert sorted(tuple(r) for r in freeze.manifest(spark, str(tmp_path), "v1").collect()) == before
    freeze.freeze(records(spark), str(tmp_path), "v2", "id", "seq")


def test_torn_and_changed_versions_are_refused(spark, tmp_path):
    rows = records(spark).withColumn("dataset_version", F.lit("v0")).withColumn("frozen", F.lit(True))
    rows.write.partitionBy("split").parquet(str(tmp_path / "v0" / "records"))
    with pytest.raises(FileNotFoundError):
        freeze.read_frozen(spark, str(tmp_path), "v0", "seq")
    freeze.freeze(records(spark), str(tmp_path), "v1", "id", "seq")
    folder = tmp_path / "v1" / "records" / "split=test"
    for name in os.listdir(folder):
        if name.endswith(".parquet"):
            os.remove(folder / name)
    with pytest.raises(ValueError, match="isn't what its manifest says"):
        freeze.read_frozen(spark, str(tmp_path), "v1", "seq")


def test_hashes_know_rows_and_not_their_order(spark):
    columns = ["id", "note", "seq", "split"]
    of = lambda df: tuple(df.agg(*freeze.table_hash(columns)).first())
    rows = records(spark)
    assert of(rows) == of(rows.repartition(7).orderBy(F.desc("seq"))) == of(rows.coalesce(1))
    assert of(rows) != of(rows.withColumn("note", F.coalesce("note", F.lit("")))) and of(rows) != of(rows.limit(11)) and of(rows.unionByName(rows)) != of(rows)
    # A separator inside a value is no separator.
    a, b = records(spark, [(1, "A|1:B", "train", "C")]), records(spark, [(1, "A", "train", "B|C")])
    assert of(a) != of(b)


@pytest.mark.parametrize(("row", "problem"), [((None, "AC", "train", ""), "null_keys"), ((0, "AC", "train", ""), "repeated_keys"), ((99, "ACDEFG", "train", ""), "repeated_sequences"), ((99, "", "train", ""), "empty_sequences"), ((99, None, "train", ""), "empty_sequences"), ((99, "AC", "other", ""), "unknown_splits"), ((99, "AC", None, ""), "unknown_splits")])
def test_unfit_rows(spark, row, problem):
    assert freeze.problems(records(spark).unionByName(records(spark, [row])), "id", "seq") == {problem: 1}


def test_unfit_rows_are_refused_before_anything_is_written(spark, tmp_path):
    with pytest.raises(ValueError, match="repeated_keys"):
        freeze.freeze(records(spark).unionByName(records(spark)), str(tmp_path), "v1", "id", "seq")
    assert not (tmp_path / "v1").exists()


def test_reports_by_decision(spark, tmp_path):
    rows = spark.createDataFrame([(1, "include", ["a", "b"], None), (2, "exclude", [], 0.5), (3, "exclude", None, 1.5)], "id long, decision string, reasons array<string>, score double")
    sequences.write_reports(rows, str(tmp_path / "csv"), fmt="csv")
    back = spark.read.option("header", True).csv(str(tmp_path / "csv"))
    assert sorted((r["id"], r["decision"], r["reasons"], r["score"]) for r in back.collect()) == [("1", "include", "a;b", None), ("2", "exclude", None, "0.5"), ("3", "exclude", None, "1.5")]
    sequences.write_reports(rows, str(tmp_path / "json"), fmt="json")
    lines = [json.loads(line) for name in sorted((tmp_path / "json" / "decision=include").glob("*.json")) for line in name.read_text().splitlines()]
    assert lines == [{"id": 1, "reasons": ["a", "b"]}]
    sequences.write_reports(rows, str(tmp_path / "parquet"))
    assert sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "parquet")).select("id", "decision").collect()) == [(1, "include"), (2, "exclude"), (3, "exclude")]
    with pytest.raises(AnalysisException):
        sequences.write_reports(rows, str(tmp_path / "parquet"))
