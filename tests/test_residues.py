"""Functions of sequences on empty ones."""

from pyspark.sql import functions as F

from bioloom.functions import residues as R


def test_blockiness_of_empty(spark):
    rows = spark.createDataFrame([("",), ("ACD",), (None,)], "seq string")
    assert [tuple(r) for r in rows.select(*[v.alias(k) for k, v in R.blockiness(F.col("seq")).items()]).collect()] == [(None, None, 0), (2, 1.5, 2), (None, None, None)]


def test_structure_of_empty(spark):
    rows = spark.createDataFrame([("",), ("DDKK",)], "seq string").withColumn("n_", R.letter_counts("seq"))
    for seq in (F.col("seq"), R.Counted(F.col("seq"), F.col("n_"))):
        assert [tuple(r) for r in rows.select(*[v.alias(k) for k, v in R.structure_propensity(seq).items()]).collect()] == [(0.0, 0.0, 0.0, 0.0), (0.5, 0.0, 0.5, 1.0)]
