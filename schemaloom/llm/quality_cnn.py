"""Quality classifier: a byte-level convolutional network in numpy.

A text's UTF-8 bytes are cut into chunks of CHUNK bytes that overlap by OVERLAP and cover all of it.
Learned filters run over the embedded bytes of each chunk, their responses are max-pooled, a small
dense layer reads each chunk's pooled responses, and the mean and maximum over the chunks give one
probability. Scoring runs in tasks over all texts; training runs on the driver, on whole texts of a
bounded sample of labelled rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pieces, whole_row

CHUNK, OVERLAP, STRIDE, DIM, FILTERS, HIDDEN = 512, 32, 4, 8, 48, 16
#: Bounds of the training sample: labelled rows, and bytes of their texts (rows that would pass it stay out, later ones that
#: fit do not). Texts of the sample are used whole.
TRAIN_DOCS, TRAIN_BYTES, EPOCHS, SEED = 2500, 64 << 20, 8, 7
#: Chunks whose responses are held at once.
BLOCK = 128
THRESHOLD = 0.3
PAD = 256


def chunks(text: str) -> np.ndarray:
    """Rows of CHUNK byte values; PAD after the text's end. An empty text is one row of PAD."""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    step = CHUNK - OVERLAP
    n = max(1, -(-(len(raw) - OVERLAP) // step))
    padded = np.full((n - 1) * step + CHUNK, PAD, np.int16)
    padded[: len(raw)] = raw
    return np.lib.stride_tricks.sliding_window_view(padded, CHUNK)[::step]


def new_weights(seed: int = SEED) -> dict[str, np.ndarray]:
    r = np.random.default_rng(seed)
    w = {
        "embed": r.normal(0, 0.5, (257, DIM)), "conv": r.normal(0, (2 * STRIDE * DIM) ** -0.5, (2 * STRIDE * DIM, FILTERS)), "conv_b": np.zeros(FILTERS),
        "dense": r.normal(0, (FILTERS + 1) ** -0.5, (FILTERS + 1, HIDDEN)), "dense_b": np.zeros(HIDDEN),
        "out": r.normal(0, (2 * HIDDEN) ** -0.5, 2 * HIDDEN), "out_b": np.zeros(1),
    }
    return {k: v.astype(np.float32) for k, v in w.items()}


def responses(w: dict, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each chunk and filter the place of the largest response (in strides) and the response, a block of chunks at a time."""
    half, at, top = STRIDE * DIM, [], []
    filters = np.concatenate([w["conv"][:half], w["conv"][half:]], axis=1)
    for i in range(0, len(x), BLOCK):
        blocks = w["embed"][x[i : i + BLOCK]].reshape(-1, half)
        own = (blocks @ filters).reshape(-1, CHUNK // STRIDE, 2 * FILTERS)
        response = own[:, :-1, :FILTERS] + own[:, 1:, FILTERS:]
        at.append(response.argmax(axis=1))
        top.append(np.take_along_axis(response, at[-1][:, None, :], axis=1)[:, 0] + w["conv_b"])
    return np.concatenate(at), np.concatenate(top)


def forward(w: dict, x: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, tuple]:
    """Probabilities of documents whose chunks are rows of x, document i from row starts[i]."""
    at, top = responses(w, x)
    pooled = np.concatenate([np.maximum(top, 0), (x != PAD).mean(axis=1, dtype=np.float32)[:, None]], axis=1)
    hidden = np.maximum(pooled @ w["dense"] + w["dense_b"], 0)
    count = np.diff(np.append(starts, len(x))).astype(np.float32)[:, None]
    both = np.concatenate([np.add.reduceat(hidden, starts) / count, np.maximum.reduceat(hidden, starts)], axis=1)
    logit = both @ w["out"] + w["out_b"]
    return 1 / (1 + np.exp(-np.clip(logit, -30, 30))), (at, top, pooled, hidden, count, both)


def gradients(w: dict, x: np.ndarray, starts: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
    p, (at, top, pooled, hidden, count, both) = forward(w, x, starts)
    g, d = {}, ((p - y) / len(y)).astype(np.float32)
    g["out"], g["out_b"] = both.T @ d, d.sum(keepdims=True)
    of = np.repeat(np.arange(len(starts)), count[:, 0].astype(int))
    db = d[:, None] * w["out"]
    share = hidden == both[of, HIDDEN:]
    dh = db[of, :HIDDEN] / count[of] + db[of, HIDDEN:] * share / np.maximum(np.add.reduceat(share.astype(np.float32), starts)[of], 1)
    dh *= hidden > 0
    g["dense"], g["dense_b"] = pooled.T @ dh, dh.sum(axis=0)
    dt = (dh @ w["dense"].T)[:, :FILTERS] * (top > 0)
    g["conv_b"], g["conv"], g["embed"] = dt.sum(axis=0), np.zeros_like(w["conv"]), np.zeros_like(w["embed"])
    for i in range(0, len(x), BLOCK):  # only the largest response has a gradient
        d_top, rows = dt[i : i + BLOCK], np.arange(i, min(i + BLOCK, len(x)))
        bytes_at = x[rows[:, None, None], at[rows][:, :, None] * STRIDE + np.arange(2 * STRIDE)]
        window = w["embed"][bytes_at].reshape(len(rows), FILTERS, -1)
        g["conv"] += np.einsum("nfk,nf->kf", window, d_top, optimize=True)
        dw = d_top[:, :, None] * w["conv"].T[None]
        np.add.at(g["embed"], bytes_at.ravel(), dw.reshape(-1, DIM))
    return g


def train(docs: list[np.ndarray], labels: np.ndarray, epochs: int = EPOCHS, seed: int = SEED, rate: float = 0.004) -> dict[str, np.ndarray]:
    """Adam over shuffled batches of 32 documents; the same input gives the same weights."""
    w, r = new_weights(seed), np.random.default_rng(seed)
    m, v, step = {k: np.zeros_like(a) for k, a in w.items()}, {k: np.zeros_like(a) for k, a in w.items()}, 0
    for epoch in range(epochs):
        order = r.permutation(len(docs))
        for batch in np.split(order, range(32, len(order), 32)):
            x, starts = np.concatenate([docs[i] for i in batch]), np.cumsum([0, *(len(docs[i]) for i in batch[:-1])])
            g, step = gradients(w, x, starts, labels[batch]), step + 1
            now = rate * (1 - epoch / epochs)
            for k in w:
                m[k] = 0.9 * m[k] + 0.1 * g[k]
                v[k] = 0.999 * v[k] + 0.001 * g[k] ** 2
                w[k] -= (now * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return w


def held_out(doc_id):
    """Whether a row is kept from training: crc32 of doc_id as text is divisible by 5."""
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, n_docs: int = TRAIN_DOCS, n_bytes: int = TRAIN_BYTES) -> dict[str, np.ndarray]:
    """Weights learnt from at most `n_docs` labelled documents of at most `n_bytes` together that are not held
    out, the first by a hash of doc_id. Rows without doc_id, quality or text teach nothing; of labels that
    disagree on a doc_id the larger counts; with no labelled rows the weights are the initial ones and all
    scores lie near one half."""
    known = labels.where(F.col("quality").isin(0, 1)).groupBy("doc_id").agg(F.max("quality").cast("int").alias("quality"))
    known = known.where(~held_out(F.col("doc_id"))).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n_docs)
    rows = docs.select("doc_id", "text").where(F.col("text").isNotNull()).join(F.broadcast(known), "doc_id")  # n_docs slim rows
    rows = rows.select("doc_id", F.xxhash64("text").alias("hash"), F.octet_length("text").cast("long").alias("n"), "text", "quality")
    slim = rows.orderBy(F.xxhash64("doc_id"), "doc_id", "hash").select("doc_id", "hash", "n").limit(n_docs).toPandas()
    left, fits = n_bytes, []
    for n in slim["n"]:
        fits.append(n <= left)
        left -= n * fits[-1]
    slim = slim[np.array(fits, bool)]
    if slim.empty:
        return new_weights()
    chosen = docs.sparkSession.createDataFrame(slim[["doc_id", "hash"]].drop_duplicates(), "doc_id long, hash long")
    found = rows.join(F.broadcast(chosen), ["doc_id", "hash"]).select("text", "quality").toPandas()
    found = found.sort_values(["text", "quality"])  # an order of its own, however the rows came
    return train([chunks(t) for t in found["text"]], found["quality"].to_numpy(np.float32))


def score_text(w: dict, text: str) -> float:
    """The network over one text of any length."""
    return float(forward(w, chunks(text), np.zeros(1, int))[0][0])


def _scored(w: dict, column: str):
    def run(batches):
        for b in pieces(batches):
            row = b.column("row")
            texts = row.field(row.type.get_field_index(column)).to_pylist() if column != "text_" else b.column("text_").to_pylist()
            scores, held, starts, at = [], [], [], 0

            def flush():
                if held:
                    scores.extend(forward(w, np.concatenate(held), np.array(starts))[0].tolist())

            for t in texts:
                x = chunks(t or "")
                if at + len(x) > 96:
                    flush()
                    held, starts, at = [], [], 0
                held.append(x)
                starts.append(at)
                at += len(x)
            flush()
            yield pa.RecordBatch.from_arrays([row, pa.array(scores, pa.float64())], ["row", "score"])

    return run


def judged(docs: DataFrame, weights: dict, threshold: float = THRESHOLD) -> DataFrame:
    """Every row of `docs` with all its columns as struct `row`, and score and predicted, by the column text
    alone; null text counts as empty, repeated rows repeat, no rows give no rows. Other columns may
    have any names."""
    rows = docs.select(whole_row(docs).alias("row"))
    out = rows.mapInArrow(_scored(weights, "text"), rows.withColumn("score", F.lit(0.0)).schema)
    return out.withColumn("predicted", F.when(F.col("score") >= threshold, 1).otherwise(0))


def score(docs: DataFrame, weights: dict, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, score and predicted of every row of `docs`, as judged() has them."""
    rows = docs.select(F.struct("doc_id").alias("row"), F.col("text").alias("text_"))
    out = rows.mapInArrow(_scored(weights, "text_"), rows.select("row").withColumn("score", F.lit(0.0)).schema)
    return out.select("row.doc_id", "score", F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"))
