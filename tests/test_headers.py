"""Headers and file names by plain rules."""

import pytest
from pyspark.sql import functions as F

from bioloom.functions import headers


def test_tags_and_organisms(spark):
    rows = ["run_id=a model=b=c run_id=z", "x =none run_id= y=1", "", None, "protein [Aa bb] [Cc dd]  ", "[only]x", "no [brackets"]
    df = spark.createDataFrame([(r,) for r in rows], "h string")
    found = df.select(F.transform(headers.tags(F.col("h")), lambda t: F.concat_ws(":", t["name"], t["value"])).alias("t"), headers.tag(F.col("h"), "run_id").alias("r"), headers.trailing_organism(F.col("h")).alias("o")).collect()
    assert [r["t"] for r in found] == [["run_id:a", "model:b=c", "run_id:z"], ["run_id:", "y:1"], [], None, [], [], []]
    assert [r["r"] for r in found] == ["a", "", None, None, None, None, None] and [r["o"] for r in found] == ["", "", "", None, "Cc dd", "", ""]


@pytest.mark.parametrize(("header", "file_name", "species", "chain"), [
    ("sp|P33957.1|GVPM2_METJA", None, "METJA", "M"), ("tr|X|Y", None, "unknown", None), ("WP_010869123.1", None, "unknown", None), ("GvpA_Halobacterium_sp", None, "Halobacterium_sp", "A"),
    ("gvpAc_x", None, "x", "AC"), ("other", "/data/set/GvpF.fasta", "unknown", "F"), ("GvpA_x", "b/gvp.fa", "x", "A"), ("GvpA_x", "GvpC", "x", "C"), ("", None, "unknown", None), (None, None, None, None),
])
def test_species_and_chains(spark, header, file_name, species, chain):
    df = spark.createDataFrame([(header, file_name)], "h string, f string")
    row = df.select(headers.species(F.col("h")).alias("s"), headers.chain(F.col("h"), F.col("f")).alias("c")).first()
    assert (row["s"] if header is not None else None, row["c"]) == (species, chain)
