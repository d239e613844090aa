"""Mixing sources to target weights by a time-varying curriculum.

Each source has a weight, hence a target of words, and a schedule of how its share changes over
training. A source's documents, repeated in passes, form one stream ordered by a hash of doc_id; a
copy that starts at word x of the stream is taken while x plus half its size is within the target.
The schedule's integral F gives the demand target * F(t) up to time t; the copy's training position
is the t at which the demand reaches x, and the mix is range-sorted by position.

Prefix sums over a source of any size are taken in two steps: within shards, which are ranges of the
hash, and over the shards' sums, so a source of a third of all rows is spread over 4,096 groups.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import scratch, whole_row, written

#: Weights of the sources in order of their names, repeating; and start and end of their shares' schedule.
WEIGHTS = (5, 2, 1)
SCHEDULES = ((1.0, 3.0), (1.0, 1.0), (3.0, 1.0))
MAX_PASSES = 3
WORDS = r"[^\x20\x09-\x0D]+"


def targets(sizes: DataFrame, weights=WEIGHTS, schedules=SCHEDULES, passes: int = MAX_PASSES) -> DataFrame:
    """key, source, source_size -> with target and slope. One row a source; the windows below run over
    sources, not documents. Targets follow the weights and stop at `passes` times the source's size;
    in order of cap per weight, a source is capped while its cap is below what is left at its weight."""
    by_name, by_cap = Window.orderBy(F.col("source").asc_nulls_last()), Window.orderBy("cap_per_weight", F.col("source").asc_nulls_last())
    ahead, behind = by_cap.rowsBetween(Window.unboundedPreceding, -1), by_cap.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    turn = (F.row_number().over(by_name) - 1) % len(weights)
    slopes = [(b - a) / (a + b) for a, b in schedules]
    df = (
        sizes.withColumn("turn", turn)
        .withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), F.col("turn") + 1))
        .withColumn("slope", F.element_at(F.array(*map(F.lit, slopes)), F.col("turn") % len(slopes) + 1))
        .withColumn("cap", F.col("source_size") * passes)
        .withColumn("cap_per_weight", F.col("cap") / F.col("weight"))
        .withColumn("all_words", F.sum("source_size").over(everything))
        .withColumn("left", F.col("all_words") - F.coalesce(F.sum("cap").over(ahead), F.lit(0)))
        .withColumn("weight_left", F.sum("weight").over(behind))
        .withColumn("capped", F.col("cap") * F.col("weight_left") <= F.col("left") * F.col("weight"))
        .withColumn("words_free", F.col("all_words") - F.sum(F.when(F.col("capped"), F.col("cap")).otherwise(0)).over(everything))
        .withColumn("weight_free", F.sum(F.when(F.col("capped"), 0).otherwise(F.col("weight"))).over(everything))
    )
    share = F.col("weight") * F.try_divide("words_free", "weight_free")
    target = F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(share)
    return df.select("key", "source", "source_size", target.alias("target"), "slope")


def position(x: Column, target: Column, slope: Column) -> Column:
    """The time t in [0, 1] at which target * F(t) = x, for F(t) = t + slope * (t^2 - t)."""
    y = F.try_divide(x, target)
    root = F.try_divide(slope - 1.0 + F.sqrt((1.0 - slope) * (1.0 - slope) + 4.0 * slope * y), 2.0 * slope)
    return F.when(slope == 0.0, y).otherwise(root)


def allot(docs: DataFrame, weights=WEIGHTS, schedules=SCHEDULES, passes: int = MAX_PASSES) -> DataFrame:
    """One row per row of `docs` (columns doc_id, text, source; others are ignored): doc_id, source, size, source_size,
    target, copies, taken (copies * size) and position (of the first copy; null without), and for mix() h, hash (of the
    text), at and slope. A written table of sizes stands between the texts and all that follows.

    Null text has size 0 and null source is a source of its own, last. Rows that repeat a doc_id are
    placed one after the other. Documents without words may be taken, which takes no words. If no
    document has words, all targets are 0. No rows give no rows."""
    h = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    text = F.coalesce("text", F.lit(""))
    rows = written(docs.select("doc_id", "source", F.regexp_count(text, F.lit(WORDS)).cast("long").alias("size"), h.alias("h"), F.xxhash64(text).alias("hash")))
    rows = rows.withColumn("shard", F.substring("h", 1, 3)).withColumn("key", F.coalesce(F.concat(F.lit("="), "source"), F.lit("")))
    sums = rows.groupBy("key", "source", "shard").agg(F.sum("size").alias("shard_size"))
    before = Window.partitionBy("key").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    plan = targets(sums.groupBy("key", "source").agg(F.sum("shard_size").alias("source_size")), weights, schedules, passes)
    start = F.coalesce(F.sum("shard_size").over(before), F.lit(0))
    shards = sums.select("key", "shard", start.alias("start")).join(plan.drop("source"), "key")
    within = Window.partitionBy("key", "shard").orderBy("h", "doc_id", "size", "hash").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("ahead", F.coalesce(F.sum("size").over(within), F.lit(0)))
    rows = rows.join(shards, ["key", "shard"]).withColumn("at", F.col("start") + F.col("ahead"))
    taken = [F.when(2 * (e * F.col("source_size") + F.col("at")) + F.col("size") <= 2 * F.col("target"), 1).otherwise(0) for e in range(passes)]
    rows = rows.withColumn("copies", sum(taken[1:], taken[0]))
    first = F.when((F.col("copies") > 0) & (F.col("target") > 0), position(F.col("at"), F.col("target"), F.col("slope")))
    return rows.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"),
                       first.alias("position"), "h", "hash", "at", "slope")


def mix(docs: DataFrame, **how) -> DataFrame:
    """The columns of `docs`, one row for each copy that the mix takes, sorted by training position. Rows that agree in
    doc_id, source and text share their copies, dealt in turn."""
    with scratch(docs.sparkSession):
        rows = allot(docs, **how)
        x = lambda copy: copy * F.col("source_size") + F.col("at")
        at = lambda copy: F.when(F.col("target") > 0, position(x(copy), F.col("target"), F.col("slope"))).otherwise(F.lit(0.0))
        times = F.when(F.col("copies") > 0, F.transform(F.sequence(F.lit(0), F.col("copies") - 1), at)).otherwise(F.array().cast("array<double>"))
        same = rows.groupBy("doc_id", "source", "hash").agg(F.count(F.lit(1)).alias("alike"), F.sort_array(F.flatten(F.collect_list(times))).alias("times"))
        places = written(same.where(F.size("times") > 0).select(F.col("doc_id").alias("id_"), F.col("source").alias("source_"), F.col("hash").alias("hash_"), "alike", "times"), keep=True)
    rows = docs.select(whole_row(docs).alias("row"), F.col("doc_id").alias("id"), F.col("source").alias("of"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("hash"))
    on = F.col("id").eqNullSafe(F.col("id_")) & F.col("of").eqNullSafe(F.col("source_")) & (F.col("hash") == F.col("hash_"))
    one = rows.join(places.where("alike = 1"), on).select("row", "id", "times")
    turn = F.row_number().over(Window.partitionBy("id", "of", "hash").orderBy("hash"))
    more = rows.join(places.where("alike > 1"), on).withColumn("turn", turn)
    more = more.select("row", "id", F.filter("times", lambda t, i: i % F.col("alike") == F.col("turn") - 1).alias("times"))
    taken = one.unionByName(more).select("row", "id", F.explode("times").alias("t"))
    return taken.orderBy("t", F.md5(F.coalesce(F.col("id").cast("string"), F.lit("")))).select("row.*")
