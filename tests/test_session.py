"""Stored steps."""

import os

import pyarrow as pa
from pyspark.sql import functions as F

from bioloom.session import ARROW_BYTES, bounded_batches, stored


def shuffled(spark) -> set[str]:
    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    return {os.path.basename(x) for x in disk.getAllFiles().mkString("\n").split("\n") if "shuffle_" in x}


def test_shuffles_of_a_stored_step_go(spark):
    before = shuffled(spark)
    made = stored(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).agg(F.count(F.lit(1)).alias("n")))
    assert not shuffled(spark) - before
    assert made.count() == 7 and made.agg(F.sum("n")).first()[0] == 1000


def test_batches_of_wide_rows_are_small(spark):
    bounded_batches(spark)

    def held(batches):
        for batch in batches:
            yield batch.select(["id"]).set_column(0, "id", pa.array([batch.nbytes] * batch.num_rows, pa.int64()))

    wide = spark.range(0, 40, 1, 1).select("id", F.repeat(F.lit("x"), F.lit(1 << 20)).alias("text"))
    assert wide.mapInArrow(held, "id long").agg(F.max("id")).first()[0] <= ARROW_BYTES + (2 << 20)
