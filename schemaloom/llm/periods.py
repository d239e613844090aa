"""Periodic runs of words, by longest common extensions in suffix trees.

A run is a stretch of words with smallest period q, of at least MIN_LENGTH words and MIN_TIMES periods, that no neighbouring
word extends. In each text:

1. Stretches that may hold a run are found: in a run every sequence of three words, from the second period on, has come q words
   before. What has not, or only farther back than a run in its stretch allows, is in no run. Most texts end here.
2. For each stretch, Ukkonen's algorithm makes the suffix trees of its words and of their reversal. A tour of a tree gives the order
   of the suffixes and, between neighbours, the depth of their lowest common ancestor; a sparse table of minima over it
   answers a longest common extension in constant time, for whole arrays of pairs at once.
3. Every run has a Lyndon root, a longest Lyndon word at some place in one of the two orders of the words. Such
   a word ends where the next smaller suffix starts. Each is extended to the right by the first tree, to the left by the second.

All of it is exact. One text is worked on at a time; memory is in proportion to its longest stretch (about 0.5 KB a word)."""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pieces

MIN_LENGTH, MIN_TIMES = 6, 4
SCHEMA = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def stretches(ids: np.ndarray) -> list[tuple[int, int]]:
    """Ranges of words, apart from each other; each run is within one, with a word of the text to spare on both sides of it or at the text's end."""
    n = len(ids) - 2
    if n < 3:
        return []
    base = np.uint64(int(ids.max()) + 1)
    x = ids.astype(np.uint64)
    keys = (x[:-2] * base + x[1:-1]) * base + x[2:]
    order = np.argsort(keys, kind="stable")
    back = np.full(n, np.iinfo(np.int64).max)
    same = keys[order][1:] == keys[order][:-1]
    back[order[1:][same]] = np.diff(order)[same]
    open_, found = [(0, n)], []
    while open_:
        a, b = open_.pop()
        # A run of period q has at least 3 q - 2 such places, and three if q is 1.
        far = np.flatnonzero(back[a:b] > (b - a + 2) // 3)
        if b - a < 3:
            continue
        if not len(far):
            found.append((max(0, a - (b - a + 2) // 3 - 1), min(len(ids), b + 3)))
            continue
        cuts = np.concatenate([[-1], far, [b - a]])
        long = np.flatnonzero(np.diff(cuts) > 3)
        open_ += [(a + int(cuts[i]) + 1, a + int(cuts[i + 1])) for i in long]
    merged: list[tuple[int, int]] = []
    for a, b in sorted(found):
        if merged and a < merged[-1][1]:
            merged[-1] = merged[-1][0], max(b, merged[-1][1])
        else:
            merged.append((a, b))
    return merged


def suffix_tree(s: list[int]) -> tuple[list[int], list[int], list[dict | None]]:
    """start, end and children of the nodes of the suffix tree of `s`, whose last value occurs once. Node 0 is the root; children
    of a leaf are None, and leaves stand in the order of their suffixes."""
    start, end, link, children = [0], [0], [0], [{}]
    n, node, edge, length, rest = len(s), 0, 0, 0, 0
    for i, c in enumerate(s):
        last, rest = 0, rest + 1
        while rest:
            if not length:
                edge = i
            below = children[node]
            child = below.get(s[edge])
            if child is None:
                below[s[edge]] = len(start)
                start.append(i), end.append(n), link.append(0), children.append(None)
                if last:
                    link[last] = node
                last = 0
            else:
                at = start[child]
                span = end[child] - at
                if length >= span:
                    node, edge, length = child, edge + span, length - span
                    continue
                if s[at + length] == c:
                    length += 1
                    if last:
                        link[last] = node
                    break
                new = len(start)
                below[s[edge]] = new
                start.append(at), end.append(at + length), link.append(0), children.append({s[at + length]: child, c: new + 1})
                start[child] = at + length
                start.append(i), end.append(n), link.append(0), children.append(None)
                if last:
                    link[last] = new
                last = new
            rest -= 1
            if node:
                node = link[node]
            elif length:
                length, edge = length - 1, i - rest + 1
    return start, end, children


def tour(tree: tuple, n: int, sign: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes in order, and for each the depth of the lowest common ancestor with the one before it. With sign -1 the order of the
    values is reversed; the last value is the smallest in both."""
    start, end, children = tree
    order, depths, low = np.empty(n, np.int64), np.zeros(n, np.int64), 0
    key = lambda c: (c >= 0, sign * c)
    stack, k = [(0, 0, iter([children[0][c] for c in sorted(children[0], key=key)]))], 0
    while stack:
        depth, _, rest = stack[-1]
        child = next(rest, None)
        if child is None:
            stack.pop()
            if stack:
                low = min(low, stack[-1][0])
        elif children[child] is None:
            # A leaf's edge reaches the end of s.
            order[k], depths[k] = start[child] - depth, min(low, depth)
            k, low = k + 1, depth
        else:
            d = depth + end[child] - start[child]
            below = children[child]
            stack.append((d, child, iter([below[c] for c in sorted(below, key=key)])))
    return order, depths


class Extensions:
    """Longest common prefixes of pairs of suffixes: the shallowest ancestor between them in the tour."""

    def __init__(self, order: np.ndarray, depths: np.ndarray):
        self.rank = np.empty(len(order), np.int64)
        self.rank[order] = np.arange(len(order))
        self.table = [depths.astype(np.int32)]
        while 2 << (len(self.table) - 1) <= len(order):
            t, half = self.table[-1], 1 << (len(self.table) - 1)
            self.table.append(np.minimum(t[:-half], t[half:]))

    def of(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """For places i <> j."""
        a, b = self.rank[i], self.rank[j]
        low, high = np.minimum(a, b) + 1, np.maximum(a, b) + 1
        level = np.frexp((high - low).astype(np.float64))[1] - 1
        out = np.empty(len(low), np.int64)
        for k in np.unique(level):
            at = level == k
            out[at] = np.minimum(self.table[k][low[at]], self.table[k][high[at] - (1 << int(k))])
        return out


def next_smaller(rank: np.ndarray) -> np.ndarray:
    """The next place with a smaller rank; the last place has the smallest of all."""
    out, waiting = np.full(len(rank), len(rank) - 1, np.int64), []
    for i, r in enumerate(rank.tolist()):
        while waiting and waiting[-1][0] > r:
            out[waiting.pop()[1]] = i
        waiting.append((r, i))
    return out


def runs_of(s: np.ndarray) -> np.ndarray:
    """start, length and period of the runs of `s` (values from 0 on), by start, then period."""
    n = len(s)
    tree = suffix_tree([*s.tolist(), -1])
    order, depths = tour(tree, n + 1)
    other, _ = tour(tree, n + 1, -1)
    right = Extensions(order, depths)
    rank = np.empty(n + 1, np.int64)
    rank[other] = np.arange(n + 1)
    i = np.arange(n)
    roots = np.concatenate([np.stack([i, next_smaller(r)[:n]]) for r in (right.rank, rank)], axis=1)
    roots = np.unique(roots[:, (roots[1] - roots[0]) * MIN_TIMES <= n], axis=1)
    tree = suffix_tree([*s[::-1].tolist(), -1])
    left = Extensions(*tour(tree, n + 1))
    i, j = roots
    begin, finish = i - left.of(n - i, n - j), j + right.of(i, j)
    period, length = j - i, finish - begin
    good = (length >= MIN_LENGTH) & (length >= MIN_TIMES * period)
    out = np.unique(np.stack([begin, length, period], axis=1)[good], axis=0)
    return out[np.lexsort((out[:, 2], out[:, 0]))]


def runs(ids: np.ndarray) -> np.ndarray:
    """start, length and period of all runs of the words `ids`, by start, then period."""
    found = [np.empty((0, 3), np.int64)]
    for a, b in stretches(ids):
        _, s = np.unique(ids[a:b], return_inverse=True)
        found.append(runs_of(s) + np.array([a, 0, 0]))
    return np.concatenate(found)


def numbered(words: list[bytes]) -> np.ndarray:
    known: dict[bytes, int] = {}
    return np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))


def looped(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """The words with the end repeated that the contract plants in one of ten texts, by the CRC-32 of the id."""
    h = 0 if doc_id is None else zlib.crc32(str(doc_id).encode())
    if doc_id is None or h % 10 or not words:
        return words
    n, g = len(words), h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    times = -(-(n - a) // p)
    return words[:a] + (words[a : a + p] * times)[: n - a]


def _sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def _report(doc_id: int | None, text: str | None, loops: bool) -> tuple:
    words = (text or "").encode("utf-8", "surrogatepass").split()
    words = looped(words, doc_id) if loops else words
    found = runs(numbered(words)).tolist()
    best = None
    for s, n, q in found:
        # Exact comparison of n / q; runs come by start, then period.
        if best is None or n * best[2] > best[1] * q:
            best = s, n, q
    if found:
        keep = np.zeros(len(words) + 1, np.int64)
        for s, n, q in found:
            keep[s + q] += 1
            keep[s + n] -= 1
        words = [words[i] for i in np.flatnonzero(np.cumsum(keep)[:-1] == 0)]
    lines = "".join(f"{s},{n},{q}\n" for s, n, q in found)
    s, n, q = best or (None, None, None)
    return len(found), s, n, q, best and 1000 * n // q, _sha(lines.encode()), b" ".join(words), found


def _mapped(loops: bool):
    def run(batches):
        for b in pieces(batches, 64):
            rows = [_report(d, t, loops) for d, t in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist())]
            columns = [pa.array([r[i] for r in rows], pa.int64()) for i in range(5)]
            columns += [pa.array([r[5] for r in rows]), pa.array([_sha(r[6]) for r in rows])]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *columns], [c.split()[0] for c in SCHEMA.split(", ")])

    return run


def _full(batches):
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
    for b in pieces(batches, 64):
        rows = [_report(d, t, False) for d, t in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist())]
        found = pa.array([[dict(zip(("start", "length", "period"), x)) for x in r[7]] for r in rows], kind)
        texts = pa.array([r[6].decode("utf-8", "surrogatepass") for r in rows])
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), found, texts], ["doc_id", "runs", "collapsed"])


def _slim(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")


def collapse(docs: DataFrame) -> DataFrame:
    """One row per row of `docs` (columns doc_id, text; others are ignored): doc_id, runs (start, length and period of each, in words from 0)
    and collapsed, the words that stay when each run keeps its first period only, joined by blanks.

    Null and empty texts have no words and no runs. Rows that repeat count on their own. No rows give no rows."""
    return _slim(docs).mapInArrow(_full, "doc_id long, runs array<struct<start:long,length:long,period:long>>, collapsed string")


def digests(docs: DataFrame, loops: bool = True) -> DataFrame:
    """One row per row of `docs`: doc_id, n_runs, start, length, period and exponent_milli of the run with the most periods, runs_sha256,
    collapsed_sha256. With `loops` one of ten texts (by its doc_id) first gets a repeated end. A null doc_id gets none."""
    return _slim(docs).mapInArrow(_mapped(loops), SCHEMA)
