"""Helpers that several operators share.

Joins have no hints: a written table's size is known from its files, and Spark sends it to every executor if that is
within spark.sql.autoBroadcastJoinThreshold (10 MB by default), else the join is a shuffle join with the same result."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import scratch, written  # noqa: F401

#: Rows of one key that meet in one task of hot_join().
HOT_ROWS = 100_000

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def hot_join(left: DataFrame, right: DataFrame, on: list[str], by: str, counts: DataFrame | None = None, per: int = HOT_ROWS, how: str = "inner") -> DataFrame:
    """The inner or left join of two written tables on the columns `on`, where `right` has a row or few a key. A key
    with more than `per` rows on the left is cut into pieces by a hash of `by`, and its rows on the right are
    repeated for each, so that no key meets in one task. `counts` (`on`, n) saves counting the left side."""
    counts = left.groupBy(*on).agg(F.count(F.lit(1)).alias("n")) if counts is None else counts
    hot = written(counts.where(F.col("n") > per).select(*on, F.ceil(F.col("n") / per).cast("int").alias("_cuts")))
    cuts = F.coalesce("_cuts", F.lit(1))
    left = left.join(hot, on, "left").withColumn("_cut", F.pmod(F.xxhash64(by), cuts).cast("int")).drop("_cuts")
    right = right.join(hot, on, "left").withColumn("_cut", F.explode(F.sequence(F.lit(0), cuts - 1))).drop("_cuts")
    return left.join(right, [*on, "_cut"], how).drop("_cut")


def named(c: str) -> Column:
    """A column by its very name, dots and all."""
    return F.col("`" + c.replace("`", "``") + "`")


def whole_row(docs: DataFrame) -> Column:
    """All columns of `docs` as one struct, so that their names cannot clash with an operator's own."""
    return F.struct(*[named(c) for c in docs.columns])


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows and bytes of an Arrow batch to and from Python, where the session has Spark's defaults (10,000 rows, 64 MB).
ARROW_ROWS, ARROW_BYTES = 512, 8 << 20


class small_batches:
    """Jobs that run within have small Arrow batches, which the executor and its Python workers hold outside
    the heap. The session's settings come back after it."""

    SETTINGS = (("maxRecordsPerBatch", "10000", ARROW_ROWS), ("maxBytesPerBatch", "67108864b", ARROW_BYTES))

    def __init__(self, spark: SparkSession):
        self.conf, self.before = spark.conf, {}

    def __enter__(self):
        for name, default, value in self.SETTINGS:
            key = f"spark.sql.execution.arrow.{name}"
            if self.conf.get(key) == default:
                self.before[key] = default
                self.conf.set(key, str(value))

    def __exit__(self, *_):
        for key, value in self.before.items():
            self.conf.set(key, value)


def mapped_table(df: DataFrame, run, schema) -> DataFrame:
    """df.mapInArrow(run, schema) as a written table, made with small batches."""
    with small_batches(df.sparkSession):
        return written(df.mapInArrow(run, schema))


def pieces(batches, rows: int = ARROW_ROWS):
    """Arrow batches cut to at most `rows` rows, so that a task holds few texts as Python objects at a
    time. At the end of a task Arrow returns the memory that it keeps for reuse: the worker lives on."""
    for b in batches:
        for start in range(0, b.num_rows, rows):
            yield b.slice(start, rows)
    pa.default_memory_pool().release_unused()
