"""MinHash near-dedup with b-bit signatures.

1. Documents with the same set of shingles form a class; one row a class goes on, so groups of
   copies of any size cost one row each.
2. Each class has KEYS minima. BANDS groups of ROWS of them are its bucket keys; the low BITS bits of
   all of them, packed by bit planes into longs, are its signature.
3. In every bucket each class is compared with the smallest one, its hub, only. Pairs whose sizes or
   whose estimate (share of equal places by bit counts, corrected for chance agreement) rule a link
   out are dropped; the rest are confirmed on the full sets. Their components are parts.
4. Buckets that still hold several parts go into one group for each part of a hub, and groups that share
   nodes into the smallest of them. A group's centre is the set of shingles that more than half of its
   classes hold, and each class goes on as its differences from the centre. Two sets differ exactly where
   their differences do, so classes link if they share at least as many differences as their numbers ask
   for. Differences that the same classes hold (of one filled-in slot, say) are one weighted element.
   Elements are in order of rarity, and classes meet by paths: the first elements that they may share. All
   classes of a group share the empty path. What only one part holds among the classes of a path, and what a
   path leaves out, no partner there shares: a class whose weight of it is too much even for the best partner
   from another part goes no further. Where a path has many classes, each meets only the one nearest to the
   centre, and their paths grow by an element; where it has few, all of them meet. Elements, their order and
   weights are found anew for each path. Parts that links have joined count as one in the next round.
   All of it is exact: every pair of a bucket is confirmed, ruled out, or joined by other links.

For a link at the similarity 0.85 the chance to share no bucket is 8e-7, and to be ruled out by the
estimate's margin of five deviations 3e-7; at 0.80 and with 40 bands the first is 1e-7. The second
does not touch pairs of step 4.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import hot_join, mapped_table, pieces, scratch, whole_row, written

SHINGLE, PERCENT = 5, 85
KEYS, ROWS, BANDS, BITS = 512, 5, 24, 2
#: Rows of a path that all meet each other in step 4.
FEW = 8
PATH = ["g", "path"]
_M = np.uint64(0x9E3779B97F4A7C15)
_rng = np.random.default_rng(20240)
FACTORS, SHIFTS = (_rng.integers(0, 2**63, KEYS, dtype=np.uint64) * np.uint64(2) + np.uint64(1) for _ in range(2))
_words: dict[bytes, int] = {}


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def shingles(text: str, k: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of k words; of the whole sequence if it is shorter."""
    words = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z only, ASCII blanks only
    if not words:
        return np.empty(0, np.uint64)
    if len(_words) > 150_000:
        _words.clear()
    for w in {w for w in words if w not in _words}:
        _words[w] = xxhash.xxh3_64_intdigest(w)
    h = np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))
    n = max(1, len(words) - k + 1)
    out = np.full(n, min(len(words), k), np.uint64)
    for i in range(min(k, len(words))):
        out = out * _M + h[i : i + n]
    return np.unique(_mixed(out))


def minima(h: np.ndarray) -> np.ndarray:
    out = np.full(KEYS, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(h), 512):
        out = np.minimum(out, ((h[i : i + 512, None] + SHIFTS) * FACTORS).min(axis=0))
    return out


def signature(low: np.ndarray) -> np.ndarray:
    """BITS planes of KEYS bits as int64."""
    low = _mixed(low)
    return np.concatenate([np.packbits(((low >> np.uint64(b)) & np.uint64(1)).astype(np.uint8)).view(np.int64) for b in range(BITS)])


def bands(low: np.ndarray, n: int = BANDS) -> np.ndarray:
    keys = np.arange(n, dtype=np.uint64)
    for r in range(ROWS):
        keys = _mixed(keys * _M + low[: n * ROWS].reshape(n, ROWS)[:, r])
    return keys.view(np.int64)


def _longs(rows: list[np.ndarray]) -> pa.Array:
    """Arrow lists of 64-bit values."""
    ends = pa.array(np.cumsum([0, *map(len, rows)]), pa.int32())
    return pa.ListArray.from_arrays(ends, pa.array(np.concatenate(rows).view(np.int64) if rows else [], pa.int64()))


def _set_id(h: np.ndarray) -> bytes | None:
    return xxhash.xxh3_128_digest(h.tobytes()) if len(h) else None


def _sets(k: int, n_bands: int):
    def run(batches):
        for b in pieces(batches):
            n, ids, sigs, keys = [], [], [], []
            for t in b.column("text").to_pylist():
                h = shingles(t or "", k)
                n.append(len(h))
                ids.append(_set_id(h))
                low = minima(h)
                sigs.append(signature(low) if len(h) else np.empty(0, np.int64))
                keys.append(bands(low, n_bands) if len(h) else np.empty(0, np.int64))
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("text_hash"), pa.array(n, pa.int64()), pa.array(ids, pa.binary()), _longs(sigs), _longs(keys)],
                ["doc_id", "text_hash", "n_shingles", "set_id", "sig", "bands"])

    return run


def _hashes(k: int):
    def run(batches):
        for b in pieces(batches, 64):
            rows = [shingles(t, k) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([_set_id(h) for h in rows], pa.binary()), _longs(rows)], ["set_id", "h"])

    return run


def estimate(x: Column, y: Column) -> Column:
    """Similarity from two signatures: share of places where all bits agree, less chance agreement."""
    words = KEYS // 64
    differ = None
    for i in range(words):
        planes = None
        for b in range(BITS):
            d = F.get(x, F.lit(b * words + i)).bitwiseXOR(F.get(y, F.lit(b * words + i)))
            planes = d if planes is None else planes.bitwiseOR(d)
        differ = F.bit_count(planes) if differ is None else differ + F.bit_count(planes)
    chance = 2.0**-BITS
    return (1 - differ / KEYS - chance) / (1 - chance)


def _likely(a: str, b: str, percent: int) -> Column:
    at = percent / 100
    same = at + (1 - at) * 2.0**-BITS  # how often places agree at the similarity asked for
    margin = 5 * (same * (1 - same) / KEYS) ** 0.5 / (1 - 2.0**-BITS)
    sizes = (100 * F.least(f"{a}_n", f"{b}_n")) >= percent * F.greatest(f"{a}_n", f"{b}_n")
    return sizes & (estimate(F.col(f"{a}_sig"), F.col(f"{b}_sig")) >= at - margin)


def full_sets(docs: DataFrame, classes: DataFrame, k: int) -> DataFrame:
    """node, n, h (the shingles' hashes) of `classes` (a written table: node, set_id, rep, n, texts), each read from a text
    of its own; a written table. Only a class of several texts can have several rows with its doc_id."""
    ids = written(classes.select(F.col("rep").alias("doc_id")).distinct())
    texts = docs.select("doc_id", "text").join(ids, "doc_id", "left_semi").select("text")
    found = mapped_table(texts, _hashes(k), "set_id binary, h array<long>")
    own = lambda which: found.join(classes.where(which).select("node", "set_id", "n"), "set_id").select("node", "n", "h")
    return written(own("texts = 1").unionByName(own("texts > 1").dropDuplicates(["node"])))


def _ends(rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """The `rows` of nodes that `pairs` (a, b; a written table) have, so that joins with pairs deal out no others."""
    ends = written(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct())
    return rows.join(ends, "node", "left_semi")


def confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough; a written table. Many pairs may share a b."""
    of = lambda c: sets.select(F.col("node").alias(c), F.col("n").alias(f"{c}_n"), F.col("h").alias(f"{c}_h"))
    sets = _ends(sets, pairs)
    both = hot_join(pairs, of("b"), ["b"], "a").join(of("a"), "a")
    shared = F.size(F.array_intersect("a_h", "b_h"))
    return written(both.where(100 * shared >= percent * (F.col("a_n") + F.col("b_n") - shared)).select("a", "b"))


def components(links: DataFrame) -> DataFrame:
    """node, component (the smallest node reachable) of every node of the links (a, b). Large-star and
    small-star rounds: neighbours' minima come from map-side aggregation, links move to the minimum, and
    rounds grow with the logarithm of the longest path. Each round is a written table."""
    edges = written(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())

    def state(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first())

    now = state(edges)
    while now[0]:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = written(large)
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        edges = written(moved.select("e.*").where("u <> v").distinct())
        before, now = now, state(edges)
        if before == now:
            break
    return edges.groupBy("u").agg(F.min("v").alias("component")).select(F.col("u").alias("node"), "component")


def _stars(members: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Pairs of classes with their buckets' hubs that sizes and estimate leave possible; a written table (a, b)."""
    of = lambda c: classes.select(F.col("node").alias(c), F.col("n").alias(f"{c}_n"), F.col("sig").alias(f"{c}_sig"))
    pairs = written(members.where("node <> hub").select(F.col("node").alias("a"), F.col("hub").alias("b")).distinct())
    return written(hot_join(pairs, of("b"), ["b"], "a").join(of("a"), "a").where(_likely("a", "b", percent)).select("a", "b"))


def _in_parts(rows: DataFrame, found: DataFrame) -> DataFrame:
    """`rows` (part, ...) with the parts that further links (node, component: of parts) have joined."""
    to = written(found.select(F.col("node").alias("part"), "component"))
    return rows.join(to, "part", "left").withColumn("part", F.coalesce("component", "part")).drop("component")


def _merged(groups: DataFrame) -> DataFrame:
    """`groups` (g, node, part) where each group has gone into the smallest group that one of its nodes is in, so that
    a node is in few groups; a written table. Nodes that were in one group still are."""
    least = groups.groupBy("node").agg(F.min("g").alias("least"))
    to = written(groups.join(least, "node").groupBy("g").agg(F.min("least").alias("to"), F.count(F.lit(1)).alias("n")))
    return written(hot_join(groups, to.select("g", "to"), ["g"], "node", to.select("g", "n")).select(F.col("to").alias("g"), "node", "part").distinct())


def differences(groups: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """g, node, part (a written table) -> with n, d (number of differences from the group's centre), diff (them)
    and x: classes link if 2 * (100 + percent) times the differences they share reach the sum of their x. Any set
    can be the centre; a group of few classes has that of its smallest one, which takes no counting."""
    sizes = written(groups.groupBy("g").agg(F.count(F.lit(1)).alias("size"), F.min("node").alias("node")))
    large = sizes.where(F.col("size") > FEW).select("g", "size")
    rows = written(groups.join(sets, "node"))
    held = rows.join(large.select("g"), "g", "left_semi").select("g", F.explode("h").alias("e"))
    held = written(held.groupBy("g", "e").count().where("count > 1"))
    most = hot_join(held, large, ["g"], "e").where("2 * count > size").groupBy("g").agg(F.collect_list("e").alias("centre"))
    most = large.join(most, "g", "left").select("g", F.coalesce("centre", F.array().cast("array<bigint>")).alias("centre"))
    small = sizes.where(F.col("size") <= FEW)
    centres = written(most.unionByName(small.join(sets, "node").select("g", F.col("h").alias("centre"))))
    diff = F.concat(F.array_except("h", "centre"), F.array_except("centre", "h"))
    rows = hot_join(rows, centres, ["g"], "node", sizes.withColumnRenamed("size", "n")).select("g", "node", "part", "n", diff.alias("diff"))
    rows = rows.withColumn("d", F.size("diff").cast("long"))
    return written(rows.withColumn("x", (100 + percent) * F.col("d") - (100 - percent) * F.col("n")))


def _opened(diffs: DataFrame, percent: int) -> DataFrame:
    """A row for each class of a group on the empty path: g, path (a hash of the elements that a pair shares first), node,
    part, n, x, els (the elements that may come next: e, of weight w), left (their weight) and y: classes link only if
    the sum of their y is 0 or less. y grows with the weight of a class's differences that no partner can share."""
    els = F.transform("diff", lambda e: F.struct(e.alias("e"), F.lit(1).cast("long").alias("w")))
    y = -(100 - percent) * F.col("n")
    return diffs.select("g", F.lit(0).cast("long").alias("path"), "node", "part", "n", "x", y.alias("y"), F.col("d").alias("left"), els.alias("els"))


def _narrowed(rows: DataFrame, percent: int) -> DataFrame:
    """Of `rows` those that the best row of another part with the same path can link with. Their els are those that
    several parts with this path hold, rarest first; those that the same classes hold are one element, and `before` is the
    weight of all that precede it. more: number of elements that can come next, with all before them not shared. A
    written table."""
    each = rows.select(*PATH, "node", "part", F.inline("els"))
    holders = [F.bit_xor(F.xxhash64("node", F.lit(i))).alias(f"h{i}") for i in range(2)]
    freq = each.groupBy(*PATH, "e").agg(F.count(F.lit(1)).alias("n"), F.min("part").alias("least"), F.max("part").alias("most"), F.first("w").alias("w"), *holders).where("least <> most")
    freq = written(freq.groupBy(*PATH, "n", "h0", "h1").agg(F.min("e").alias("e"), F.sum("w").alias("w")).withColumnRenamed("n", "often"))
    shared = hot_join(each.drop("part", "w"), freq.drop("h0", "h1"), [*PATH, "e"], "node", freq.select(*PATH, "e", F.col("often").alias("n")))
    earlier = Window.partitionBy(*PATH, "node").orderBy("often", "e").rowsBetween(Window.unboundedPreceding, -1)
    shared = shared.withColumn("before", F.coalesce(F.sum("w").over(earlier), F.lit(0)))
    els = shared.groupBy(*PATH, "node").agg(F.array_sort(F.collect_list(F.struct("often", "e", "w", "before"))).alias("now"), F.sum("w").alias("kept"))
    rows = rows.join(els, [*PATH, "node"], "left").withColumn("kept", F.coalesce("kept", F.lit(0)))
    y = F.col("y") + (100 + percent) * (F.col("left") - F.col("kept"))
    empty = F.array().cast("array<struct<often:bigint,e:bigint,w:bigint,before:bigint>>")
    rows = written(rows.select(*PATH, "node", "part", "n", "x", y.alias("y"), F.col("kept").alias("left"), F.coalesce("now", empty).alias("els")))

    parts = written(rows.groupBy(*PATH, "part").agg(F.min("y").alias("y"), F.count(F.lit(1)).alias("rows")))
    first = written(parts.groupBy(*PATH).agg(F.min(F.struct("y", "part")).alias("b"), F.count(F.lit(1)).alias("n"), F.sum("rows").alias("rows")).where("n > 1"))
    second = hot_join(parts, first.select(*PATH, "b"), PATH, "part", first.select(*PATH, "n")).where("part <> b.part").groupBy(*PATH).agg(F.min("y").alias("second"))
    best = written(first.join(second, PATH).select(*PATH, "b", "second", "rows"))
    rows = hot_join(rows, best.drop("rows"), PATH, "node", best.select(*PATH, F.col("rows").alias("n")))
    rows = rows.withColumn("room", -F.col("y") - F.when(F.col("part") == F.col("b.part"), F.col("second")).otherwise(F.col("b.y"))).where("room >= 0")
    more = F.expr(f"size(filter(els, t -> {100 + percent} * t.before <= room))")
    return written(rows.withColumn("more", more).drop("b", "second"))


def _extended(rows: DataFrame, percent: int) -> DataFrame:
    """Rows of paths that are one element longer, of rows of _narrowed(); a written table."""
    rows = rows.select("*", F.posexplode(F.slice("els", F.lit(1), F.col("more"))).alias("k", "next"))
    rest = F.transform(F.slice("els", F.col("k") + 2, F.size("els")), lambda t: F.struct(t["e"].alias("e"), t["w"].alias("w")))
    y = F.col("y") + (100 + percent) * F.col("next.before")
    left = F.col("left") - F.col("next.before") - F.col("next.w")
    return written(rows.select("g", F.xxhash64("path", "next.e").alias("path"), "node", "part", "n", "x", y.alias("y"), left.alias("left"), rest.alias("els")))


def _checked(pairs: DataFrame, diffs: DataFrame, percent: int) -> DataFrame:
    """The pairs (g, a, b, a_part, b_part) that link, by their differences; each is checked in one group only. A
    written table (a, b) of parts."""
    of = lambda c: diffs.select("g", F.col("node").alias(c), F.col("x").alias(f"{c}_x"), F.col("diff").alias(f"{c}_diff"))
    pairs = written(pairs.groupBy("a", "b").agg(F.min(F.struct("g", "a_part", "b_part")).alias("at")).select("a", "b", "at.*"))
    diffs = _ends(diffs, pairs)
    both = hot_join(pairs, of("b"), ["g", "b"], "a").join(of("a"), ["g", "a"])
    both = both.where(2 * (100 + percent) * F.size(F.array_intersect("a_diff", "b_diff")) >= F.col("a_x") + F.col("b_x"))
    return written(both.select(F.col("a_part").alias("a"), F.col("b_part").alias("b")).distinct())


def _bucketed(rows: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """Pairs (g, a, b, a_part, b_part) of rows of one path that can link, and the rows whose path has to grow. Few rows
    of a path meet each other; many meet only the one of smallest x, which links with both of any pair that shares the
    path alone, and then go on with longer paths."""
    least = F.min(F.struct("x", "node", "part", "n", "y")).alias("b")
    buckets = rows.groupBy(*PATH).agg(F.count(F.lit(1)).alias("rows"), F.min("part").alias("p"), F.max("part").alias("q"), F.avg("more").alias("more"), least)
    many = (F.col("rows") > FEW) & (F.col("rows") > 2 * F.col("more"))
    buckets = written(buckets.where("p <> q").select(*PATH, many.alias("many"), "b", "rows"))
    rows = written(hot_join(rows, buckets.select(*PATH, "many", "b"), PATH, "node", buckets.select(*PATH, F.col("rows").alias("n"))))
    side = lambda t: [*PATH, *[F.col(c).alias(f"{t}_{c}") for c in ("node", "part", "n", "x", "y")]]
    few = rows.where("not many")
    few = few.select(*side("a")).join(few.select(*side("b")), PATH).where("a_node < b_node")
    met = rows.where("many").select(*side("a"), *[F.col(f"b.{c}").alias(f"b_{c}") for c in ("node", "part", "n", "x", "y")])
    # x - 2 * y is the largest x of a partner that shares all that it can.
    can = F.expr("a_part <> b_part and a_x <= b_x - 2 * b_y and b_x <= a_x - 2 * a_y")
    can &= 100 * F.least("a_n", "b_n") >= percent * F.greatest("a_n", "b_n")
    ordered = [F.least("a_node", "b_node").alias("a"), F.greatest("a_node", "b_node").alias("b")]
    return few.unionByName(met).where(can).select("g", *ordered, "a_part", "b_part"), rows.where("many").drop("many", "b")


def links_across(groups: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """node, component of the parts that links within the groups (g, node, part; a written table) join."""
    diffs = differences(groups, sets, percent)
    rows, found = _opened(diffs, percent), None
    while True:
        pairs, rows = _bucketed(_narrowed(rows, percent), percent)
        new = written(components(_checked(pairs, diffs, percent)))
        found = new if found is None else _joined_up(found, new)
        rows = _extended(_in_parts(rows.where("more > 0"), new), percent)
        if rows.isEmpty():
            return found


def _joined_up(first: DataFrame, second: DataFrame) -> DataFrame:
    """node, component of links found in two steps, the second between the components of the first; a written table."""
    moved = _in_parts(first.select("node", F.col("component").alias("part")), second).select("node", F.col("part").alias("component"))
    return written(moved.unionByName(second))


def _classified(docs: DataFrame, k: int, percent: int, n_bands: int) -> DataFrame:
    """near_duplicates() with the hash of each row's text (text_hash; of "" for null)."""
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("text_hash", F.xxhash64("text"))
    sets = mapped_table(slim, _sets(k, n_bands), "doc_id long, text_hash long, n_shingles long, set_id binary, sig array<long>, bands array<long>")
    classes = written(
        sets.where("n_shingles > 0 and doc_id is not null").groupBy("set_id")
        .agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("texts"), F.first("n_shingles").alias("n"), F.first("sig").alias("sig"), F.first("bands").alias("bands")))
    # A class goes by its smallest doc_id, or by a hash of its own where a doc_id has texts of several classes.
    twice = written(classes.groupBy("rep").count().where("count > 1"))
    classes = classes.join(twice, "rep", "left").withColumn("node", F.when(F.col("count").isNull(), F.col("rep")).otherwise(F.xxhash64("set_id"))).drop("count")

    places = classes.select("node", F.explode("bands").alias("bucket"))
    hubs = written(places.groupBy("bucket").agg(F.min("node").alias("hub"), F.count(F.lit(1)).alias("n")).where("n > 1"))
    members = written(hot_join(places, hubs.select("bucket", "hub"), ["bucket"], "node", hubs.select("bucket", "n")))
    met = written(members.select("node").distinct())
    met = written(classes.select("node", "set_id", "rep", "texts", "n", "sig").join(met, "node", "left_semi"))
    full = full_sets(slim, met, k)
    first = written(components(confirm(_stars(members, met, percent), full, percent)))

    part = written(members.select("bucket", "node").join(first, "node", "left").select("bucket", "node", F.coalesce("component", "node").alias("part")))
    split = written(part.groupBy("bucket").agg(F.min("part").alias("g"), F.max("part").alias("q"), F.count(F.lit(1)).alias("n")).where("g <> q"))
    groups = written(hot_join(part, split.select("bucket", "g"), ["bucket"], "node", split.select("bucket", "n")).select("g", "node", "part").distinct())
    across = links_across(_merged(groups), full, percent)

    linked = _joined_up(first, across)
    everyone = linked.unionByName(linked.select(F.col("component").alias("node"), "component").distinct())
    least = classes.select("node", "rep").join(everyone, "node").groupBy("component").agg(F.min("rep").alias("component_id"))
    linked = written(hot_join(everyone, least, ["component"], "node").select("node", "component_id"))
    named = classes.select("set_id", "node", "rep").join(linked, "node", "left").select("set_id", F.coalesce("component_id", "rep").alias("component_id"))
    out = sets.select("doc_id", "text_hash", "n_shingles", "set_id").join(named, "set_id", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "text_hash", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def near_duplicates(docs: DataFrame, k: int = SHINGLE, percent: int = PERCENT, n_bands: int = BANDS) -> DataFrame:
    """One row per row of `docs` (columns doc_id, text; others are ignored): doc_id, n_shingles,
    component_id, kept.

    Texts without words (null, empty, blank) have no shingles and link with nothing. Rows with a null
    doc_id link with nothing, have a null component_id and are kept. Rows that repeat a doc_id with
    the same text are one document; with different texts each row's set links on its own. Links hold
    at 100 * intersection >= percent * union. No rows give no rows."""
    return _classified(docs, k, percent, n_bands).drop("text_hash")


def dedup(docs: DataFrame, k: int = SHINGLE, percent: int = PERCENT, n_bands: int = BANDS) -> DataFrame:
    """The rows of `docs` that near_duplicates() keeps, with all their columns. Rows that repeat a doc_id
    are told apart by their texts."""
    text_hash = F.xxhash64(F.coalesce("text", F.lit("")))
    row = docs.select(whole_row(docs).alias("row"), F.col("doc_id").cast("long").alias("id"), text_hash.alias("hash"))
    with scratch(docs.sparkSession):
        gone = _classified(docs, k, percent, n_bands).where("not kept").select(F.col("doc_id").alias("id"), F.col("text_hash").alias("hash"))
        gone = written(gone.distinct(), keep=True)
    return row.join(gone, ["id", "hash"], "left_anti").select("row.*")
