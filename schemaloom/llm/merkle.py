"""Merkle manifest of a dataset, by ranks in bitmaps.

1. Every row becomes a leaf digest. Its tree is its group (here: lang); its place in it follows its id.
2. Places come from ranks, not from sorting: the ids of a tree are bitmaps, one 64-bit word for every 64 ids that hold
   any, so absent ranges cost nothing. Above the words lie popcount directories, each entry the count of 65,536 entries
   below it; running sums within one entry give each word the number of leaves before it. A leaf's place is that
   number and the bits below its own. Words where rows repeat an id (or have none) are rare; their rows are put in order by
   ranges, ties by the digest.
3. Level by level, groups of FAN nodes are keyed by place / FAN and hold arrays of slots, whose digests are hashed in the order of
   the slots. Trees' roots, ordered by group, are leaves of the tree above them, made in the same way.
4. From the top down every group hands its path (what stands left and right of it at each level above) to its slots.

A window holds 65,536 rows at most; no step depends on how many rows a group or an id has."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ascii_lower, hot_join, written

#: Nodes under one parent; FAN is 1 << STEP. An entry of a directory counts 1 << WIDE entries below it.
STEP, WIDE, DIRECTORIES = 3, 16, 3
FAN = 1 << STEP
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def field(c: Column) -> Column:
    """`-` for null, else the length in bytes, a colon and the value."""
    s = c.cast("string")
    return F.when(s.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s))


def leaves(docs: DataFrame) -> DataFrame:
    """tree, doc_id, leaf, tampered (the leaf with changed text, where that is asked for), word and bit (of the id), own
    (tells rows apart); a written table."""
    doc_id = F.col("doc_id").cast("long")
    changed = F.crc32(F.col("doc_id").cast("string")) % 3 == 0
    others = [field(F.col(c)) for c in FIELDS[:-1]]
    out = docs.select(
        F.when(F.col("lang").isNull(), "-").otherwise(F.concat(F.lit("="), "lang")).alias("tree"), doc_id.alias("doc_id"),
        digest(*others, field(F.col("text"))).alias("leaf"), F.when(changed, digest(*others, field(ascii_lower(F.col("text"))))).alias("tampered"),
        # Rows without an id come first, in a word before all others.
        F.coalesce(F.shiftright(doc_id, 6), F.lit(-(1 << 57) - 1)).alias("word"), F.coalesce(doc_id.bitwiseAND(F.lit(63)), F.lit(0)).cast("int").alias("bit"))
    return written(out.withColumn("own", F.monotonically_increasing_id()))


def words(rows: DataFrame) -> DataFrame:
    """tree, word, bits (the ids that are there), n (rows), base (leaves of the tree before the word), total (leaves of the tree); a written table."""
    found = written(rows.groupBy("tree", F.col("word").alias("at")).agg(F.expr("bit_or(shiftleft(1L, bit))").alias("bits"), F.count(F.lit(1)).alias("n")))
    levels = [found]
    for _ in range(DIRECTORIES):
        levels.append(written(levels[-1].groupBy("tree", F.shiftright("at", WIDE).alias("at")).agg(F.sum("n").alias("n"))))
    whole = Window.partitionBy("tree")
    base = levels[-1].withColumn("total", F.sum("n").over(whole))
    base = base.withColumn("base", F.coalesce(F.sum("n").over(whole.orderBy("at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    for level in reversed(levels[:-1]):
        above = base.select("tree", F.col("at").alias("up"), F.col("base").alias("before"), "total")
        level = level.withColumn("up", F.shiftright("at", WIDE)).join(above, ["tree", "up"])
        run = Window.partitionBy("tree", "up").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
        base = level.withColumn("base", F.col("before") + F.coalesce(F.sum("n").over(run), F.lit(0)))
    return written(base.select("tree", F.col("at").alias("word"), "bits", "n", "base", "total"))


def ranked(rows: DataFrame, *by: str) -> DataFrame:
    """`rows` (with `own`, unique) with pos, their places in the order of `by`, from 0: dealt out by ranges, counted by range; a written table."""
    dealt = written(rows.repartitionByRange(*by, "own").withColumn("part", F.spark_partition_id()))
    # One row a partition.
    sizes = dealt.groupBy("part").count()
    start = sizes.select("part", F.coalesce(F.sum("count").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("start"))
    place = F.row_number().over(Window.partitionBy("part").orderBy(*by, "own")) - 1
    return written(dealt.join(start, "part").withColumn("pos", F.col("start") + place).drop("part", "start"))


def placed(rows: DataFrame) -> DataFrame:
    """tree, pos (place in the tree), total, doc_id, leaf, tampered of every row of leaves(); a written table."""
    found = words(rows)
    key, alone = ["tree", "word"], F.col("n") == F.bit_count("bits")
    columns = ["tree", "pos", "total", "doc_id", "leaf", "tampered"]
    below = F.bit_count(F.col("bits").bitwiseAND(F.expr("~shiftleft(-1L, bit)")))
    out = rows.join(found.where(alone), key).withColumn("pos", F.col("base") + below).select(*columns)
    crowded = written(found.where(~alone))
    if not crowded.isEmpty():
        many = ranked(hot_join(rows, crowded, key, "own", crowded.select(*key, "n")), *key, "doc_id", "leaf")
        first = many.groupBy(*key).agg(F.min("pos").alias("first"))
        many = hot_join(many, written(first), key, "own", crowded.select(*key, "n"))
        out = out.unionByName(many.withColumn("pos", F.col("base") + F.col("pos") - F.col("first")).select(*columns))
    return written(out)


def _digests(slots: Column) -> Column:
    return F.array_join(F.transform(slots, lambda s: s["digest"]), "")


def reduced(nodes: DataFrame, extra: list[str]) -> tuple[list[DataFrame], DataFrame]:
    """`nodes` (tree, pos, total, digest and `extra`; a written table) -> the levels above them, each a written table of
    groups (tree, pos, total, slots, digest), and the trees' roots (tree, digest). Slots of the first level hold `extra`."""
    levels, roots, at = [], nodes.where("total = 1").select("tree", "digest"), nodes
    while not at.where("total > 1").isEmpty():
        slot = F.struct(F.col("pos").bitwiseAND(F.lit(FAN - 1)).alias("slot"), "digest", *([] if levels else extra))
        groups = at.where("total > 1").groupBy("tree", F.shiftright("pos", STEP).alias("pos"), F.shiftright(F.col("total") + (FAN - 1), STEP).alias("total"))
        groups = groups.agg(F.sort_array(F.collect_list(slot)).alias("slots"))
        levels.append(written(groups.withColumn("digest", F.sha2(_digests(F.col("slots")), 256))))
        at = levels[-1]
        roots = roots.unionByName(at.where("total = 1").select("tree", "digest"))
    return levels, written(roots)


def _slots(groups: DataFrame, above: DataFrame) -> DataFrame:
    """A row for each slot of the groups, with its path: what stands at its left and right in its group, then its group's path."""
    rows = groups.select("tree", "pos", "slots").join(above, ["tree", "pos"])
    rows = rows.withColumn("s", F.explode("slots"))
    side = lambda keep: _digests(F.filter("slots", keep))
    step = F.struct(side(lambda x: x["slot"] < F.col("s.slot")).alias("left"), side(lambda x: x["slot"] > F.col("s.slot")).alias("right"))
    return rows.withColumn("path", F.concat(F.array(step), "path")).withColumn("pos", F.shiftleft("pos", STEP) + F.col("s.slot")).drop("slots")


def paths(nodes: DataFrame, levels: list[DataFrame], ends: DataFrame, extra: list[str]) -> DataFrame:
    """digest, `extra` and path of every node, with the columns of `ends` (tree, path and more; the trees' own paths, a written table)."""
    rest = [c for c in ends.columns if c != "tree"]
    alone = nodes.where("total = 1").join(ends, "tree").select("digest", *extra, *rest)
    if not levels:
        return alone
    top = lambda groups: groups.where("total = 1").select("tree", "pos").join(ends, "tree")
    above = top(levels[-1])
    for upper, lower in zip(levels[:0:-1], levels[-2::-1]):
        above = written(_slots(upper, above).select("tree", "pos", *rest).unionByName(top(lower)))
    low = _slots(levels[0], above)
    return low.select("s.digest", *[f"s.{c}" for c in extra], *rest).unionByName(alone)


def manifest(docs: DataFrame) -> DataFrame:
    """One row per row of `docs` (the columns of documents; others are ignored): doc_id, leaf, subroot (of its lang), root,
    proof_sha256 (of all siblings on the way up), folded_root (from the leaf, of changed text where crc32(doc_id) is divisible by 3,
    and its siblings), verified.

    Nulls in any column are leaves of their own kind. Rows without a doc_id come before all others of their lang and are never changed; rows that
    repeat a doc_id are in the order of their leaves. No rows give no rows."""
    extra = ["doc_id", "tampered"]
    nodes = placed(leaves(docs)).withColumnRenamed("leaf", "digest")
    levels, subroots = reduced(nodes, extra)
    # One row a lang.
    trees = ranked(subroots.withColumn("own", F.lit(0)), "tree")
    n = trees.count()
    trees = trees.select(F.lit("").alias("tree"), "pos", F.lit(n).cast("long").alias("total"), "digest", F.col("tree").alias("of"))
    upper, tops = reduced(trees, ["of"])
    root = F.lit(tops.first()["digest"] if n else None).cast("string")
    ends = written(docs.sparkSession.range(1).select(F.lit("").alias("tree"), F.array().cast("array<struct<left:string,right:string>>").alias("path")))
    ends = paths(trees, upper, ends, ["of"]).select(F.col("of").alias("tree"), F.col("digest").alias("subroot"), "path")
    rows = paths(nodes, levels, written(ends), extra).withColumn("root", root)
    proof = F.array_join(F.transform("path", lambda p: F.concat(p["left"], p["right"])), "")
    folded = F.aggregate("path", F.coalesce("tampered", "digest"), lambda at, p: digest(p["left"], at, p["right"]))
    rows = rows.select("doc_id", F.col("digest").alias("leaf"), "subroot", "root", F.sha2(proof, 256).alias("proof_sha256"), folded.alias("folded_root"))
    return rows.withColumn("verified", F.col("folded_root") == F.col("root"))
