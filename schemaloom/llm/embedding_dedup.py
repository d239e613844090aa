"""Near-duplicate vectors by cosine: an inverted file with product-quantised residuals, probed far enough.

Vectors are scaled to length 1, where a cosine of at least the bound is a distance of at most `reach`. Rows of the very same vector are
one class with a weight. Coarse centroids and codebooks are fitted on a bounded sample; every class is in the list of its nearest
centroid, with the code of its residual and the code's error.

* Which lists are probed: q and a link x lie on the two sides of the plane between their centroids, so their distances from it add up
  to at most what they differ by across it. q asks the list of x if its own distance from that plane is within half of that (or x asks that of q): `margin`,
  SIGMAS deviations of an even difference of length `reach`, and at most reach / 2, at which no link at all can be missed.
* In a list, distance tables give every code's distance from q; less the code's error that is a lower bound, and what lies within reach
  by it meets the vector itself. So codes lose nothing, and exact cosines decide.
* Dense groups: where several vectors of the sample lie within half the angle of the bound of one pivot, the pivot has a list of its own, a
  ball. All its members link with each other, so they are counted, not compared; other vectors ask a ball exactly if it can hold a link.

Lists are cut into shards and their askers into blocks by hashes, so no task holds more than SHARD members and about BLOCK askers. A task returns
counts and a spanning forest of its links, never the links, so a dense group gives a row or two for each of its vectors."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ann import cut, kmeans, nearest
from .common import hot_join, small_batches, whole_row, written
from .minhash import components

PERCENT = 95
#: Vectors that the index is fitted on, and that pivots are looked for among.
SAMPLE, SAMPLE_PER_LIST, PIVOT_SAMPLE, PIVOT_LEAST = 20_000, 8, 20_000, 5
LISTS_PER_ROOT, MAX_LISTS, PARTS, CODES, SEED = 2, 16_384, 16, 64, 11
SHARD, BLOCK, SIGMAS = 2048, 2048, 5.0
#: What decisions that must hold for certain give up for rounding.
SLACK = 1e-9


def n_lists(n: int) -> int:
    return int(min(MAX_LISTS, max(1, round(LISTS_PER_ROOT * n**0.5))))


def angles(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(x @ y.T, -1, 1))


def find_pivots(x: np.ndarray, angle: float) -> np.ndarray:
    """Centres of dense groups of unit vectors: means of what lies within `angle` of one, if PIVOT_LEAST lie within half of it."""
    times, near, half = np.zeros(len(x), np.int64), np.cos(angle), np.cos(angle / 2)
    for b in cut(len(x), len(x)):
        times[b] = (x[b] @ x.T >= near).sum(axis=1)
    free, found = np.ones(len(x), bool), []
    for i in np.argsort(-times, kind="stable"):
        if times[i] < PIVOT_LEAST:
            break
        if free[i]:
            centre = x[x @ x[i] >= near].mean(axis=0)
            centre /= np.linalg.norm(centre)
            mine = (x @ centre >= half) & free
            if mine.sum() >= PIVOT_LEAST:
                free &= ~mine
                found.append(centre)
    return np.array(found).reshape(-1, x.shape[1])


class Index:
    """Lists 0 to len(centers) - 1 are cells, later ones balls. Ball facts (weight, widest angle, a member) come with settle()."""

    def __init__(self, sample: np.ndarray, n: int, percent: int = PERCENT, sigmas: float | None = SIGMAS):
        self.dim, self.width = sample.shape[1], -(-sample.shape[1] // PARTS)
        self.angle, self.reach = float(np.arccos(percent / 100)), float(np.sqrt(2 - percent / 50))
        self.percent, self.margin = percent, self.reach / 2
        if sigmas:
            self.margin = min(self.margin, sigmas * self.reach / self.dim**0.5 / 2)
        self.centers = kmeans(sample, min(n_lists(n), len(sample)), seed=SEED)
        self.pivots = find_pivots(sample[:PIVOT_SAMPLE], self.angle)
        rest = self._parts(sample - self.centers[nearest(sample, self.centers)])
        self.books = np.stack([kmeans(np.ascontiguousarray(rest[:, p]), min(CODES, len(sample)), seed=SEED) for p in range(PARTS)])
        self.weights, self.widest, self.members = np.zeros(len(self.pivots), np.int64), np.zeros(len(self.pivots)), np.zeros(len(self.pivots), np.int64)

    def _squares(self, x: np.ndarray) -> np.ndarray:
        """Squared distances from the centroids."""
        return np.maximum((x * x).sum(axis=1)[:, None] - 2 * x @ self.centers.T + (self.centers * self.centers).sum(axis=1), 0)

    def _parts(self, x: np.ndarray) -> np.ndarray:
        return np.pad(x, ((0, 0), (0, PARTS * self.width - self.dim))).reshape(len(x), PARTS, self.width)

    def settle(self, rows) -> None:
        for r in rows:
            b = r["list"] - len(self.centers)
            self.weights[b], self.widest[b], self.members[b] = r["weight"], r["widest"], r["member"]

    def home(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The list of each vector and its angle from the pivot, if that is a ball."""
        at, far = nearest(x, self.centers), np.zeros(len(x))
        if len(self.pivots):
            for b in cut(len(x), len(self.pivots)):
                a = angles(x[b], self.pivots)
                best = a.argmin(axis=1)
                least = a[np.arange(len(a)), best]
                inside = least <= self.angle / 2 - SLACK
                at[b] = np.where(inside, len(self.centers) + best, at[b])
                far[b] = np.where(inside, least, 0)
        return at, far

    def centre(self, lists: np.ndarray) -> np.ndarray:
        return np.concatenate([self.centers, self.pivots])[lists]

    def encode(self, x: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes of the residuals, and how far from the vectors they are."""
        rest = self._parts(x - self.centre(at))
        codes = np.stack([nearest(np.ascontiguousarray(rest[:, p]), self.books[p]) for p in range(PARTS)], axis=1)
        return codes.astype(np.uint8), np.sqrt(((rest - self.books[np.arange(PARTS), codes]) ** 2).sum(axis=(1, 2)))

    def asks(self, x: np.ndarray, at: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, list[np.ndarray]]:
        """For each vector: the lists to look through, the weight of balls that it links with as a whole, and a member of each such ball."""
        lists, whole, linked = [], np.zeros(len(x), np.int64), []
        for b in cut(len(x), len(self.centers) + len(self.pivots)):
            d = self._squares(x[b])
            own = d.argmin(axis=1)
            least, apart = d[np.arange(len(d)), own][:, None], self._squares(self.centers[own])
            # How far from the plane to another centroid, times twice the centroids' distance.
            cells = d - least <= (2 * self.margin + SLACK) * np.sqrt(apart) + SLACK
            a = angles(x[b], self.pivots)
            balls = (a <= self.angle + self.widest + SLACK) & (self.weights > 0)
            mine = at[b][:, None] == len(self.centers) + np.arange(len(self.pivots))
            # Wholly within reach: the own ball, and others for members of balls (which ask each other's ball always).
            wholly = mine | (balls & (a + self.widest <= self.angle - SLACK) & (at[b] >= len(self.centers))[:, None])
            for i in range(len(d)):
                lists.append(np.concatenate([np.flatnonzero(cells[i]), len(self.centers) + np.flatnonzero(balls[i] & ~wholly[i])]).astype(np.int32))
                linked.append(self.members[wholly[i]])
            whole[b] = (wholly * self.weights).sum(axis=1)
        return lists, whole, linked

    def rough(self, q: np.ndarray, at: int, codes: np.ndarray) -> np.ndarray:
        """Distances of vectors from codes of a list, by tables."""
        rest = self._parts(q - self.centre(np.array([at]))).transpose(1, 0, 2)
        tables = (rest * rest).sum(axis=2)[:, :, None] - 2 * rest @ self.books.transpose(0, 2, 1) + (self.books**2).sum(axis=2)[:, None, :]
        return np.sqrt(np.maximum(sum(tables[p][:, codes[:, p]] for p in range(PARTS)), 0))


def _stack(column: pd.Series, kind=np.float64) -> np.ndarray:
    return np.frombuffer(b"".join(column), kind).reshape(len(column), -1)


CODED = "node long, weight long, x binary, list int, far double, code binary, error double"


def _coded(index: Index):
    def run(batches):
        for b in batches:
            if len(b):
                x = np.stack(b["embedding"].to_numpy())
                x = x / np.abs(x).max(axis=1)[:, None]  # else squares of very large or small numbers are lost
                x = x / np.sqrt((x * x).sum(axis=1))[:, None]
                at, far = index.home(x)
                codes, error = index.encode(x, at)
                yield b[["node", "weight"]].assign(x=[v.tobytes() for v in x], list=at.astype(np.int32), far=far, code=[c.tobytes() for c in codes], error=error)

    return run


def _asking(index: Index):
    def run(batches):
        for b in batches:
            if len(b):
                lists, whole, linked = index.asks(_stack(b["x"]), b["list"].to_numpy())
                # What is in a ball is in its weight too; a class's rows link with each other.
                in_ball = b["list"].to_numpy() >= len(index.centers)
                n = whole + np.where(in_ball, 0, b["weight"].to_numpy()) - 1
                yield b.drop(columns="far").assign(asked=lists, n=n, linked=linked)

    return run


FOUND = "node long, n long, other long"


def _compared(index: Index):
    bound = index.percent / 100

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        counts, edges = {}, []
        if len(left) and len(right):
            at, home = int(right["list"].iloc[0]), left["home"].to_numpy()
            q, q_node, q_weight = _stack(left["x"]), left["node"].to_numpy(), left["weight"].to_numpy()
            x, node, weight, codes, error = _stack(right["x"]), right["node"].to_numpy(), right["weight"].to_numpy(), _stack(right["code"], np.uint8), right["error"].to_numpy()
            # Do the members ask the askers' lists as well? Then these links are counted there for them; balls are always asked.
            asked, part = [set(a) for a in right["asked"]], np.arange(len(x))
            q_n, n = np.zeros(len(q), np.int64), np.zeros(len(x), np.int64)
            for start in range(0, len(q), 64):
                near = index.rough(q[start : start + 64], at, codes) - error <= index.reach + SLACK
                near &= q_node[start : start + 64, None] != node
                i, j = np.nonzero(near)
                if not len(i):
                    continue
                good = np.concatenate([np.einsum("ij,ij->i", q[start + i[b]], x[j[b]]) for b in cut(len(i), 2 * x.shape[1])]) >= bound
                i, j = start + i[good], j[good]
                np.add.at(q_n, i, weight[j])
                one_way = np.array([home[a] < len(index.centers) and home[a] not in asked[b] for a, b in zip(i, j)], bool)
                np.add.at(n, j[one_way], q_weight[i[one_way]])
                for a, end in zip(*np.unique(i, return_index=True)):
                    met = np.unique(part[j[end : end + int(np.searchsorted(i, a, "right") - end)]])
                    edges += [(q_node[a], node[p]) for p in met]
                    if len(met) > 1:
                        part[np.isin(part, met)] = met[0]
            counts = {"node": np.concatenate([q_node, node]), "n": np.concatenate([q_n, n])}
        out = pd.DataFrame(counts, columns=["node", "n"]).astype("int64")
        out = out[out["n"] > 0].assign(other=pd.Series(dtype="Int64"))
        links = pd.DataFrame(edges, columns=["node", "other"]).assign(n=0)[["node", "n", "other"]]
        return pd.concat([out, links.astype({"other": "Int64"})]) if len(links) else out

    return run


def _linked(classes: DataFrame, percent: int, sigmas: float | None) -> tuple[DataFrame, DataFrame]:
    """Of classes (node, weight, embedding; all of one length, a written table): node, n (links of each of its rows), and links (a, b) that connect the components."""
    n = classes.count()
    sample = classes.select("node", "embedding").orderBy(F.xxhash64("node", F.lit(SEED)), "node").limit(max(SAMPLE, SAMPLE_PER_LIST * n_lists(n))).toPandas()
    x = np.stack(sample["embedding"].to_numpy())
    x = x / np.abs(x).max(axis=1)[:, None]
    index = Index(x / np.sqrt((x * x).sum(axis=1))[:, None], n, percent, sigmas)
    del sample, x
    spark, cells = classes.sparkSession, len(index.centers)
    with small_batches(spark):
        coded = written(classes.mapInPandas(_coded(index), CODED))
        # At most one row for every PIVOT_LEAST vectors of the sample.
        index.settle(coded.where(F.col("list") >= cells).groupBy("list").agg(F.sum("weight").alias("weight"), F.max("far").alias("widest"), F.min("node").alias("member")).collect())
        asking = written(coded.mapInPandas(_asking(index), CODED.replace("far double, ", "") + ", asked array<int>, n long, linked array<long>"))
    asks = asking.select("node", "weight", "x", F.col("list").alias("home"), F.explode("asked").alias("list"))
    cuts = lambda df, per, name: df.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / per).cast("int").alias(name))
    # A row for each list.
    plan = written(cuts(asking, SHARD, "shards").join(cuts(asks.select("list"), BLOCK, "blocks"), "list"))
    piece = lambda name: F.pmod(F.xxhash64("node"), name).cast("int")
    every = lambda name: F.explode(F.sequence(F.lit(0), F.col(name) - 1))
    key = ["list", "shard", "block"]
    fresh = lambda df: df.select(*[F.col(c).alias(c) for c in df.columns])  # noqa: E731  columns of their own, since both sides come from one table
    left = asks.join(plan, "list").withColumn("block", piece("blocks")).withColumn("shard", every("shards")).drop("shards", "blocks")
    right = asking.drop("n", "linked").join(plan, "list").withColumn("shard", piece("shards")).withColumn("block", every("blocks")).drop("shards", "blocks")
    found = written(fresh(left).groupBy(*key).cogroup(fresh(right).groupBy(*key)).applyInPandas(_compared(index), FOUND))
    n = asking.select("node", "n").unionByName(found.where("n > 0").select("node", "n")).groupBy("node").agg(F.sum("n").alias("n"))
    links = found.where("other is not null").select(F.col("node").alias("a"), F.col("other").alias("b"))
    return n, links.unionByName(asking.select(F.col("node").alias("a"), F.explode("linked").alias("b")))


def near_duplicates(vectors: DataFrame, column: str = "embedding", percent: int = PERCENT, sigmas: float | None = SIGMAS) -> DataFrame:
    """One row per row of `vectors` (columns vec_id and `column`; others are ignored): vec_id, n_links, component_id, kept.

    Links hold between different rows at a cosine of percent / 100 or more, in double precision. `sigmas` None probes so far that no link can
    be missed whatever the vectors; by default a link at the very bound whose difference has no preferred direction is missed with a
    chance of about 6e-7 (closer ones less). Vectors that are null, empty, zero or hold null or non-finite components link with nothing,
    nor do rows without a vec_id, which are kept with a null component_id. Vectors link within one length only; each length is an index of
    its own. Rows that repeat a vec_id are rows of their own; kept says whether vec_id is its component's. No rows give no rows."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col(column).cast("array<double>").alias("embedding"))
    finite = F.forall("embedding", lambda v: v.isNotNull() & (F.abs(v) < float("inf")) & ~F.isnan(v)) & F.exists("embedding", lambda v: v != 0)
    usable = F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & F.coalesce(finite, F.lit(False))
    # 128 bits stand for a vector where rows meet their classes.
    key = ["h", "g"]
    rows = rows.withColumn("usable", usable).withColumn("h", F.when(usable, F.xxhash64("embedding"))).withColumn("g", F.when(usable, F.xxhash64(F.lit("second"), "embedding")))
    slim = written(rows.select("vec_id", *key))
    classes = rows.where("usable").groupBy(*key).agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("weight"), F.first("embedding").alias("embedding"))
    classes = written(classes.withColumn("length", F.size("embedding")))
    # A class goes by its smallest vec_id, or by a hash where a vec_id has several vectors.
    twice = written(classes.groupBy("rep").count().where("count > 1"))
    classes = written(classes.join(twice, "rep", "left").withColumn("node", F.when(F.col("count").isNull(), F.col("rep")).otherwise(F.xxhash64(*key))).drop("count"))
    counts, links = None, None
    for r in classes.groupBy("length").count().orderBy("length").collect():
        n, some = _linked(classes.where(F.col("length") == r["length"]).select("node", "weight", "embedding"), percent, sigmas)
        counts, links = (n, some) if counts is None else (counts.unionByName(n), links.unionByName(some))
    if counts is None:
        return slim.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    parts = written(components(links))
    parts = written(parts.unionByName(parts.select(F.col("component").alias("node"), "component").distinct()))
    least = parts.join(classes.select("node", "rep"), "node").groupBy("component").agg(F.min("rep").alias("least"))
    parts = hot_join(parts, written(least), ["component"], "node").select("node", "least")
    known = classes.select(*key, "node", "rep", "weight").join(counts, "node").join(parts, "node", "left")
    known = written(known.select(*key, "weight", "n", F.coalesce("least", "rep").alias("component")))
    out = hot_join(slim, known.drop("weight"), key, "vec_id", known.select(*key, F.col("weight").alias("n")), how="left")
    component = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("n", F.lit(0)).alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))


def dedup(vectors: DataFrame, column: str = "embedding", percent: int = PERCENT, sigmas: float | None = SIGMAS) -> DataFrame:
    """The rows of `vectors` that near_duplicates() keeps, with all their columns. Of rows that repeat a vec_id all stay or go."""
    gone = written(near_duplicates(vectors, column, percent, sigmas).where("not kept").select(F.col("vec_id").alias("id")).distinct())
    rows = vectors.select(whole_row(vectors).alias("row"), F.col("vec_id").cast("long").alias("id"))
    return rows.join(gone, "id", "left_anti").select("row.*")
