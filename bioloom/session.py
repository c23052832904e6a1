"""Session and storage helpers shared by all jobs."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    A cluster names it in ``spark.checkpoint.dir``. Only where that is unset, as in tests on one machine,
    a temporary folder is taken.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    current = spark.sparkContext.getCheckpointDir()
    if current is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
        current = spark.sparkContext.getCheckpointDir()
    return current.rstrip("/")


#: Whether a query's shuffle files go when it ends.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, label: str = "step") -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Later steps read the files, so a lost executor costs only the tasks it was running, and a plan that is
    used twice is computed once. What the write shuffled goes as soon as it is done: Spark would keep it on disk until the
    driver happens to collect garbage.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    before = spark.conf.get(SHUFFLE_CLEANUP, None)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.unset(SHUFFLE_CLEANUP) if before is None else spark.conf.set(SHUFFLE_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


ARROW_ROWS = 1000
#: Bytes after which a batch for Python ends: a row may hold two blocks of vectors, and a thousand of these are a gigabyte.
ARROW_BYTES = 4 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Let Python tasks get at most ``ARROW_ROWS`` rows and about ``ARROW_BYTES`` at a time, as rows here hold whole texts or blocks.

    Spark's default of 10,000 rows means tens of megabytes of text in the JVM's buffers, in Python's and in
    what is made of them, all at once.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name, "10000")) <= ARROW_ROWS:
        spark.conf.set(name, str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def size_of(df: DataFrame) -> int:
    """What Spark estimates ``df`` to hold, in bytes; files count as they are stored."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


#: Below this size a core, a table may be stored in fewer row groups than there are cores.
SMALL = 32 << 20


def spread(df: DataFrame, key: str) -> DataFrame:
    """``df`` over all cores, for work on each text that costs far more than a shuffle of a small table.

    A file of one row group is one task, however many cores wait. Tables of over ``SMALL`` bytes a core have row groups enough
    and are read where they lie: what is shuffled here doesn't grow with the data. Rows are the same either way.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if cores > 1 and size_of(df) < SMALL * cores else df


def shuffle_partitions(spark: SparkSession) -> int:
    """How many partitions the session gives a shuffle."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def _before(ranges: DataFrame, part: str) -> DataFrame:
    """``part, before_``: the sum of ``n_`` over the ranges before each. There is a row a shuffle partition, whatever the data."""
    earlier = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    return ranges.select(part, F.coalesce(F.sum("n_").over(earlier), F.lit(0)).alias("before_"))


def numbered(rows: DataFrame, *order: Column, name: str = "place") -> DataFrame:
    """``rows`` with their place, from 1, in one order over all of them.

    Rows are dealt by ranges and sorted there; a place is what the ranges before hold, one number each, and the place inside the
    range. No task gets more than its range.
    """
    # The upper bits of these ids are the range, the lower 33 the place in it.
    dealt = stored(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at_", F.monotonically_increasing_id()), "ranges")
    part = F.shiftrightunsigned("at_", 33)
    offsets = _before(dealt.groupBy(part.alias("part_")).agg(F.count(F.lit(1)).alias("n_")), "part_")
    place = (F.col("before_") + F.col("at_").bitwiseAND(F.lit((1 << 33) - 1)) + 1).alias(name)
    return dealt.join(F.broadcast(offsets), part == F.col("part_")).select(*[F.col(f"`{c}`") for c in rows.columns], place)


def cumulated(rows: DataFrame, weight: str, *order: Column, name: str = "upto") -> DataFrame:
    """``rows`` with the sum of ``weight`` up to and with each, in one order over all of them; no task gets more than its range."""
    dealt = stored(rows.repartitionByRange(*order).withColumn("range_", F.spark_partition_id()), "ranges")
    offsets = _before(dealt.groupBy("range_").agg(F.sum(weight).alias("n_")), "range_")
    inside = F.sum(weight).over(Window.partitionBy("range_").orderBy(*order))
    summed = dealt.withColumn("inside_", inside).join(F.broadcast(offsets), "range_")
    return summed.select(*[F.col(f"`{c}`") for c in rows.columns], (F.col("before_") + F.col("inside_")).alias(name))
