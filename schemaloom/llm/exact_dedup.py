"""Exact dedup by an exchange of Golomb-coded fingerprints.

1. Every row gets a 64-bit fingerprint, computed in the JVM and written to a slim table.
2. Tasks read it in blocks of at most BLOCK_ROWS rows, sort each block's distinct fingerprints and send
   every *owner* (a range of the 64-bit space) one Golomb-Rice coded message per block, so the number of
   messages follows the blocks and the owners, and their bytes the rows.
3. Owners decode and merge their messages and answer each with a bitmap: bit i is set if the i-th
   fingerprint of the message also came from another block, or several times from this one.
4. Bitmaps meet their messages again and become suspects. Sent to all tasks if the size of their table
   allows it, they are looked up where texts are read.
5. So only suspects' texts are shuffled, grouped by the text itself (bytes are compared, no hash
   decides) with map-side aggregation, and a huge group of copies is one row per task.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hot_join, whole_row, written

MESSAGE = "block string, owner int, n int, k int, data binary, multi binary"
#: Rows of a block, and fingerprints that one owner merges in memory.
BLOCK_ROWS, OWNER_ROWS = 4_000_000, 2_000_000


def golomb_encode(values: np.ndarray) -> tuple[int, bytes]:
    """Golomb-Rice code of sorted distinct uint64: the differences' quotients in unary, then their
    remainders of k bits."""
    if not len(values):
        return 0, b""
    d = np.diff(values, prepend=np.uint64(0))
    k = min(62, max(0, int(values[-1] // len(values)).bit_length() - 1))
    q = (d >> np.uint64(k)).astype(np.int64)
    unary = np.ones(int(q.sum()) + len(q), np.uint8)
    unary[np.cumsum(q + 1) - 1] = 0
    shifts = np.arange(k - 1, -1, -1, dtype=np.uint64)
    rest = ((d[:, None] >> shifts) & np.uint64(1)).astype(np.uint8).ravel()
    return k, np.packbits(np.concatenate([unary, rest])).tobytes()


def golomb_decode(data: bytes, n: int, k: int) -> np.ndarray:
    if not n:
        return np.empty(0, np.uint64)
    bits = np.unpackbits(np.frombuffer(data, np.uint8))
    ends = np.flatnonzero(bits == 0)[:n]
    q = np.diff(ends, prepend=-1) - 1
    rest = bits[ends[-1] + 1 : ends[-1] + 1 + n * k].reshape(n, k).astype(np.uint64)
    r = (rest << np.arange(k - 1, -1, -1, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)
    return np.cumsum((q.astype(np.uint64) << np.uint64(k)) + r, dtype=np.uint64)


def owner_start(owner: int, owners: int) -> int:
    return -(-(owner << 32) // owners) << 32


def owners_of(fp: np.ndarray, owners: int) -> np.ndarray:
    return ((fp >> np.uint64(32)) * np.uint64(owners) >> np.uint64(32)).astype(np.int64)


def _block(name: str, fp: np.ndarray, owners: int) -> pd.DataFrame:
    """The messages of one block."""
    own, times = np.unique(fp, return_counts=True)
    cuts = np.searchsorted(owners_of(own, owners), np.arange(owners + 1))
    rows = []
    for o, (a, b) in enumerate(zip(cuts, cuts[1:])):
        if b > a:
            k, data = golomb_encode(own[a:b] - np.uint64(owner_start(o, owners)))
            rows.append((name, o, b - a, k, data, np.packbits(times[a:b] > 1).tobytes()))
    return pd.DataFrame(rows, columns=["block", "owner", "n", "k", "data", "multi"])


def _messages(owners: int):
    def run(batches):
        from pyspark import TaskContext

        task, n_blocks, held, size = TaskContext.get().partitionId(), 0, [], 0
        for b in batches:
            held.append(b["fp"].to_numpy().view(np.uint64))
            size += len(b)
            if size >= BLOCK_ROWS:
                yield _block(f"{task}.{n_blocks}", np.concatenate(held), owners)
                n_blocks, held, size = n_blocks + 1, [], 0
        if size:
            yield _block(f"{task}.{n_blocks}", np.concatenate(held), owners)

    return run


def _answers(pdf: pd.DataFrame) -> pd.DataFrame:
    sent = [golomb_decode(d, n, k) for d, n, k in zip(pdf["data"], pdf["n"], pdf["k"])]
    _, at, times = np.unique(np.concatenate(sent), return_inverse=True, return_counts=True)
    bits, cut = times[at] > 1, np.cumsum([0, *map(len, sent)])
    pdf["bitmap"] = [
        np.packbits(bits[a:b] | np.unpackbits(np.frombuffer(m, np.uint8), count=b - a).astype(bool)).tobytes()
        for a, b, m in zip(cut, cut[1:], pdf["multi"])
    ]
    return pdf[["block", "owner", "bitmap"]]


def _flagged(owners: int):
    def run(batches):
        for b in batches:
            for o, n, k, data, bitmap in zip(b["owner"], b["n"], b["k"], b["data"], b["bitmap"]):
                bits = np.unpackbits(np.frombuffer(bitmap, np.uint8), count=n).astype(bool)
                if bits.any():
                    fp = golomb_decode(data, n, k)[bits] + np.uint64(owner_start(int(o), owners))
                    yield pd.DataFrame({"fp": fp.view(np.int64)})

    return run


def suspects(prints: DataFrame, owners: int | None = None) -> DataFrame:
    """The fingerprints (column fp of a written table) that occur more than once; a written table."""
    if owners is None:
        owners = max(int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions")), prints.count() // OWNER_ROWS + 1)
    messages = written(prints.select("fp").mapInPandas(_messages(owners), MESSAGE))
    # Written, so that no task has a Python worker for this and another for what follows.
    answers = written(messages.groupBy("owner").applyInPandas(_answers, "block string, owner int, bitmap binary"))
    met = messages.drop("multi").join(answers, ["block", "owner"])
    return written(met.select("owner", "n", "k", "data", "bitmap").mapInPandas(_flagged(owners), "fp long").distinct())


def _sketch(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """doc_id, fp, text_sha256 of every row, and fp, text_sha256, keep_id, group_size of every text that occurs more
    than once; written tables."""
    text = F.coalesce(F.col("text"), F.lit(""))
    slim = docs.select("doc_id", text.alias("text")).withColumn("fp", F.xxhash64("text"))
    sketch = written(slim.select("doc_id", "fp", F.sha2("text", 256).alias("text_sha256")))
    groups = (
        slim.join(suspects(sketch), "fp", "left_semi")
        .groupBy("fp", "text").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        .where("group_size > 1"))
    return sketch, written(groups.select("fp", F.sha2("text", 256).alias("text_sha256"), "keep_id", "group_size"))


def classify(docs: DataFrame) -> DataFrame:
    """One row per row of `docs` (columns doc_id, text; others are ignored): doc_id, keep_id,
    group_size, kept, text_sha256.

    Null text counts as empty text. Of equal texts the largest doc_id stays; a null doc_id counts as
    smallest. Rows that repeat a doc_id with the same text count in group_size and share the verdict.
    No rows give no rows."""
    sketch, groups = _sketch(docs)
    counts = groups.select("fp", "text_sha256", F.col("group_size").alias("n"))
    out = hot_join(sketch.withColumn("own", F.xxhash64("doc_id")), groups, ["fp", "text_sha256"], "own", counts, how="left")
    keep_id = F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    return out.select(
        "doc_id", keep_id.alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.col("doc_id").eqNullSafe(keep_id).alias("kept"), "text_sha256")


def dedup(docs: DataFrame) -> DataFrame:
    """The rows of `docs` whose text is the kept one of its group, with all their columns; of rows
    that repeat both doc_id and text, one stays. Texts that occur once pass where they are read."""
    sketch, groups = _sketch(docs)
    counts = groups.select("fp", "text_sha256", F.col("group_size").alias("n"))
    held = hot_join(sketch.withColumn("own", F.xxhash64("doc_id")), groups, ["fp", "text_sha256"], "own", counts)
    held = held.groupBy("doc_id", "fp", "text_sha256", "keep_id").agg(F.count(F.lit(1)).alias("times"))
    held = written(held.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("keep_id"))))
    again = written(held.where("kept and times > 1").select(F.col("doc_id").alias("id_"), F.col("fp").alias("fp_")))
    gone = written(held.where("not kept").select(F.col("doc_id").alias("id_"), F.col("fp").alias("fp_")).unionByName(again))
    rows = docs.select(whole_row(docs).alias("row"), F.col("doc_id").alias("id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("fp"))
    on = F.col("id").eqNullSafe(F.col("id_")) & (F.col("fp") == F.col("fp_"))
    alone = rows.join(gone, on, "left_anti")
    one = rows.join(again, on, "left_semi").dropDuplicates(["id", "fp"])
    return alone.unionByName(one).select("row.*")
