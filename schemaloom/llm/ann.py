"""Approximate nearest neighbours: an inverted file with product-quantised residuals.

The coarse centroids and the codebooks are fitted on the driver, on a bounded sample; the number of lists
follows the square root of the number of vectors, and the number of lists that a query probes is the
smallest that finds RECALL of the true neighbours within the sample. Every vector is indexed: its list,
and its residual's code. Lists are cut into shards of about SHARD codes by a hash of the id and their
queries into blocks of BLOCK, so neither a hot list nor a hot query group meets in one task; what meets
is ids and codes of a few bytes, no vectors but the queries'. In each shard, distance tables rank the
codes, and the best SHORTLIST a query go on; of those of all its lists the best RERANK meet the original
vectors and are ranked by exact distance.

Of rows with the very same vector only the k + 1 of smallest id can be among anyone's k nearest, so those
are the candidates, picked before the shuffle; a vector that a third of all rows share costs k + 1 rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import hot_join, written

#: Vectors that the index is fitted on: SAMPLE, or SAMPLE_PER_LIST for each of at most MAX_LISTS lists.
SAMPLE, SAMPLE_PER_LIST, MAX_LISTS, PARTS, CODES, ROUNDS, SEED = 20_000, 8, 16_384, 16, 256, 8, 11
#: Bytes of a matrix that a task or the driver makes at a time.
BYTES = 16 << 20
SHARD, BLOCK, SHORTLIST, RERANK, RECALL = 8192, 1024, 100, 300, 0.97


def n_lists(n: int) -> int:
    return int(min(MAX_LISTS, max(1, round(n**0.5))))


def cut(n: int, width: int) -> list[slice]:
    """Ranges of n rows, such that a matrix of `width` doubles a row has about BYTES."""
    step = max(1, BYTES // (8 * max(1, width)))
    return [slice(i, min(n, i + step)) for i in range(0, n, step)]


def nearest(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    half = (centers * centers).sum(axis=1) / 2
    return np.concatenate([np.argmin(half - x[b] @ centers.T, axis=1) for b in cut(len(x), len(centers))]) if len(x) else np.empty(0, int)


def kmeans(x: np.ndarray, k: int, rounds: int = ROUNDS, seed: int = SEED) -> np.ndarray:
    r = np.random.default_rng(seed)
    centers = x[r.choice(len(x), k, replace=len(x) < k)].copy()
    for _ in range(rounds):
        at = nearest(x, centers)
        n = np.bincount(at, minlength=k)
        sums = np.zeros_like(centers)
        np.add.at(sums, at, x)
        centers = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centers)
        empty = np.flatnonzero(n == 0)
        centers[empty] = x[r.choice(len(x), len(empty))]
    return centers


class Index:
    """Centroids, codebooks and the number of lists to probe."""

    def __init__(self, sample: np.ndarray, n: int, recall: float = RECALL):
        self.dim, self.width = sample.shape[1], -(-sample.shape[1] // PARTS)
        x = self.padded(sample)
        self.centers = kmeans(x, min(n_lists(n), len(x)))
        rest = x - self.centers[nearest(x, self.centers)]
        self.books = np.stack([kmeans(rest[:, p * self.width : (p + 1) * self.width], min(CODES, len(x))) for p in range(PARTS)])
        self.probes = self.calibrated(x, recall)

    def padded(self, x: np.ndarray) -> np.ndarray:
        return np.pad(x.astype(np.float64), ((0, 0), (0, PARTS * self.width - self.dim)))

    def calibrated(self, x: np.ndarray, recall: float, k: int = 10) -> int:
        """Lists to probe so that queries of the sample find `recall` of their k nearest in it."""
        at, q = nearest(x, self.centers), x[:: max(1, len(x) // 200)]
        needed = []
        for b in cut(len(q), 3 * (len(x) + len(self.centers))):
            rank = np.argsort(np.argsort(self.distances(q[b], self.centers), axis=1, kind="stable"), axis=1)
            near = np.argsort(self.distances(q[b], x), axis=1, kind="stable")[:, 1 : k + 1]
            needed.append(np.take_along_axis(rank, at[near], axis=1).ravel())
        needed = np.sort(np.concatenate(needed))
        return int(needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))))]) + 1 if len(needed) else len(self.centers)

    @staticmethod
    def distances(q: np.ndarray, c: np.ndarray) -> np.ndarray:
        return np.maximum((q * q).sum(axis=1)[:, None] - 2 * q @ c.T + (c * c).sum(axis=1), 0)

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        x = self.padded(x)
        at = nearest(x, self.centers)
        rest = x - self.centers[at]
        return at, np.stack([nearest(rest[:, p * self.width : (p + 1) * self.width], self.books[p]) for p in range(PARTS)], axis=1).astype(np.uint8)

    def probed(self, x: np.ndarray) -> np.ndarray:
        x = self.padded(x)
        parts = [np.argsort(self.distances(x[b], self.centers), axis=1, kind="stable")[:, : self.probes].astype(np.int32) for b in cut(len(x), 3 * len(self.centers))]
        return np.concatenate(parts) if parts else np.empty((0, self.probes), np.int32)

    def tables(self, q: np.ndarray, center: np.ndarray) -> np.ndarray:
        """Squared distances of each query's residual to each code, by part."""
        rest = (self.padded(q) - center).reshape(len(q), PARTS, 1, self.width)
        return ((rest - self.books[None]) ** 2).sum(axis=3)


def usable(vectors: DataFrame, column: str) -> DataFrame:
    """vec_id, embedding (doubles), h (its hash) and length of the vectors that take part: not empty or zero, without
    null or non-finite components, and with an id. Rows that repeat both count once. A written table."""
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col(column).cast("array<double>").alias("embedding"))
    finite = F.forall("embedding", lambda x: x.isNotNull() & (F.abs(x) < float("inf")) & ~F.isnan(x))
    v = v.where("vec_id is not null and embedding is not null").where(finite & F.exists("embedding", lambda x: x != 0))
    v = v.select("vec_id", "embedding", F.xxhash64("embedding").alias("h"), F.size("embedding").alias("length"))
    return written(v.dropDuplicates(["vec_id", "h"]))


def _stack(s: pd.Series) -> np.ndarray:
    return np.stack(s.to_numpy()) if len(s) else np.empty((0, 1))


def _indexed(index: Index):
    def run(batches):
        for b in batches:
            if len(b):
                at, codes = index.encode(_stack(b["embedding"]))
                yield b[["vec_id", "h"]].assign(list_id=at.astype(np.int32), code=[c.tobytes() for c in codes])

    return run


def _probes(index: Index):
    def run(batches):
        for b in batches:
            if len(b):
                lists = index.probed(_stack(b["embedding"]))
                yield b.rename(columns={"vec_id": "query_id", "h": "query_h"}).assign(list_id=list(lists))

    return run


FOUND = "query_id long, query_h long, vec_id long, h long, rough double"


def _searched(index: Index):
    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(left) and len(right):
            ids, hs, codes = right["vec_id"].to_numpy(), right["h"].to_numpy(), np.frombuffer(b"".join(right["code"]), np.uint8).reshape(-1, PARTS)
            order = np.lexsort((hs, ids))
            ids, hs, codes = ids[order], hs[order], codes[order]
            center = index.centers[left["list_id"].iloc[0]]
            queries, query_h, q = left["query_id"].to_numpy(), left["query_h"].to_numpy(), _stack(left["embedding"])
            for start in range(0, len(q), 64):
                tables = index.tables(q[start : start + 64], center)
                rough = sum(tables[:, p, :][:, codes[:, p]] for p in range(PARTS))
                rough[queries[start : start + 64, None] == ids[None]] = np.inf  # not oneself
                # A stable sort: of equal estimates the smallest ids stay.
                best = np.argsort(rough, axis=1, kind="stable")[:, :SHORTLIST]
                rows = np.repeat(np.arange(start, start + len(best)), best.shape[1])
                best, far = best.ravel(), np.take_along_axis(rough, best, axis=1).ravel()
                near = np.isfinite(far)
                found.append(pd.DataFrame({"query_id": queries[rows], "query_h": query_h[rows], "vec_id": ids[best], "h": hs[best], "rough": far})[near])
        return pd.concat(found) if found else pd.DataFrame({c.split()[0]: pd.Series(dtype="int64" if "long" in c else "float64") for c in FOUND.split(", ")})

    return run


def _search_length(rows: DataFrame, asked: DataFrame, k: int, recall: float) -> DataFrame:
    """query_id, query_h, vec_id, score of the k nearest among vectors of one length (written tables)."""
    n = rows.count()
    same = Window.partitionBy("h", "embedding").orderBy("vec_id")
    rows = written(rows.withColumn("copy", F.row_number().over(same)).where(F.col("copy") <= k + 1).drop("copy"))
    sample = rows.orderBy(F.xxhash64("vec_id", "h"), "vec_id", "h").limit(max(SAMPLE, SAMPLE_PER_LIST * n_lists(n))).toPandas()
    index = Index(_stack(sample["embedding"]), n, recall)
    codes = written(rows.mapInPandas(_indexed(index), "vec_id long, h long, list_id int, code binary"))
    probes = written(
        asked.select("vec_id", "h", "embedding").mapInPandas(_probes(index), "query_id long, query_h long, embedding array<double>, list_id array<int>")
        .select("query_id", "query_h", "embedding", F.explode("list_id").alias("list_id")))
    # At most MAX_LISTS lists: one row each.
    lists = codes.groupBy("list_id").agg(F.ceil(F.count(F.lit(1)) / SHARD).cast("int").alias("shards"))
    blocks = probes.groupBy("list_id").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    plan = F.broadcast(written(lists.join(blocks, "list_id")))
    shard = lambda key, n: F.pmod(F.xxhash64(*key), F.col(n)).cast("int")
    left = probes.join(plan, "list_id").withColumn("block", shard(("query_id", "query_h"), "blocks"))
    left = left.withColumn("shard", F.explode(F.sequence(F.lit(0), F.col("shards") - 1))).select("list_id", "shard", "block", "query_id", "query_h", "embedding")
    right = codes.join(plan, "list_id").withColumn("shard", shard(("vec_id", "h"), "shards"))
    right = right.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("list_id", "shard", "block", "vec_id", "h", "code")
    key = ["list_id", "shard", "block"]
    near = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInPandas(_searched(index), FOUND)
    mine = Window.partitionBy("query_id", "query_h")
    near = written(near.withColumn("place", F.row_number().over(mine.orderBy("rough", "vec_id", "h"))).where(F.col("place") <= RERANK).select("query_id", "query_h", "vec_id", "h"))
    near = hot_join(near, rows.select("vec_id", "h", F.col("embedding").alias("x")), ["vec_id", "h"], "query_id")
    near = near.join(asked.select(F.col("vec_id").alias("query_id"), F.col("h").alias("query_h"), F.col("embedding").alias("q")), ["query_id", "query_h"])
    square = F.aggregate(F.zip_with("x", "q", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda a, b: a + b)
    return near.select("query_id", "query_h", "vec_id", F.sqrt(square).alias("score"))


def search(vectors: DataFrame, k: int = 10, query=None, column: str = "embedding", recall: float = RECALL) -> DataFrame:
    """The k nearest found by Euclidean distance, for every vector for which `query` (a condition; by
    default vec_id divisible by 100) holds, among all others: query_id, rank, vec_id, score.

    Ties go to the smaller vec_id. Vectors that are null, empty, zero, or hold null or non-finite components
    take no part. Distances are between vectors of one length: each length is an index of its own (lengths
    are listed on the driver). Rows that repeat a vec_id with the same vector are one row; with different
    vectors each is a candidate and, where it is asked for, a query of its own under the same query_id; rows of
    the query's own vec_id are never its neighbours. No usable vectors, or no queries, give no rows."""
    found, v = None, usable(vectors, column)
    for r in v.groupBy("length").count().orderBy("length").collect():
        rows = v.where(F.col("length") == r["length"]).drop("length")
        asked = rows.where(F.col("vec_id") % 100 == 0 if query is None else query)
        if r["count"] > 1 and not asked.isEmpty():
            one = _search_length(rows, asked, k, recall)
            found = one if found is None else found.unionByName(one)
    if found is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    best = Window.partitionBy("query_id", "query_h").orderBy("score", "vec_id")
    near = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return near.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
