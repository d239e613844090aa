"""Token counts with a whole-token shortcut.

A byte-level BPE vocabulary is read once per worker. Every vocabulary string is encoded
alone; those that come out as one token are proven whole, and pre-tokens that equal one count
as one token without merging. Only the other pre-tokens are merged, once each per worker while the
cache has room. Texts whose spaces all stand single before a non-space are cut at spaces first: a
pre-token never spans such a cut, so the count of a cut piece (with its space) is kept as well.
"""

from __future__ import annotations

import json
import re

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import Merges
from .common import pieces

CACHE = 200_000
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The same pattern for texts of code points up to U+024F, with the classes written out.
SPACE, LETTER, NUMBER = r"\t-\r \x85\xa0", r"A-Za-zªµºÀ-ÖØ-öø-ɏ", "0-9²³¹¼½¾"
LATIN = re.compile(
    rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{LETTER}]+| ?[{NUMBER}]+| ?[^{SPACE}{LETTER}{NUMBER}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")
BEYOND = re.compile("[^\x00-ɏ]")
ANY = regex.compile(PATTERN)
UNEVEN = re.compile(r" (?:\s|\Z)")


class Counter(dict):
    """Pre-token -> number of tokens; starts with the proven whole tokens and learns the others."""

    def __init__(self, path: str):
        spec = json.load(open(path, encoding="utf-8"))
        self.merges = Merges(spec["model"])
        for token in self.merges.text:
            if len(self.merges.tokens(token)) == 1:
                try:
                    self[token.encode("latin-1").decode()] = 1
                except UnicodeDecodeError:
                    pass  # part of a character: never a whole pre-token
        self.whole = len(self)
        self.spaced = Spaced(self)
        special = [t["content"] for t in spec["added_tokens"]]
        self.special = re.compile("|".join(map(re.escape, sorted(special, key=len, reverse=True)))) if special else None

    def __missing__(self, piece: str) -> int:
        n = len(self.merges.tokens(piece.encode().decode("latin-1")))
        if len(self) < self.whole + CACHE:
            self[piece] = n
        return n

    def pieces(self, text: str) -> int:
        return sum(map(self.__getitem__, (ANY if BEYOND.search(text) else LATIN).findall(text)))

    def count(self, text: str) -> int:
        if self.special and self.special.search(text):
            parts = self.special.split(text)
            return len(parts) - 1 + sum(map(self.count, parts))
        if UNEVEN.search(text):
            return self.pieces(text)
        first, *rest = text.split(" ")
        return self.pieces(first) + sum(map(self.spaced.__getitem__, rest))


class Spaced(dict):
    """What stands between two spaces -> number of tokens of it and the space before it."""

    def __init__(self, counter: Counter):
        self.counter = counter

    def __missing__(self, piece: str) -> int:
        n = self.counter.pieces(" " + piece)
        if len(self) < CACHE:
            self[piece] = n
        return n


_loaded: dict[str, Counter] = {}


def counter(path: str) -> Counter:
    if path not in _loaded:
        _loaded[path] = Counter(path)
    return _loaded[path]


def _count(path: str):
    def run(batches):
        c = counter(path)
        for b in pieces(batches):
            n = [c.count(t or "") for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("n_bytes"), pa.array(n, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    return run


def count_tokens(docs: DataFrame, path: str, limit: int = 512) -> DataFrame:
    """One row per row of `docs` (columns doc_id, text; others are ignored): doc_id, n_bytes,
    n_tokens, over_limit.

    `path` is a byte-level BPE tokenizer file that every worker can read. Null and empty texts have 0
    tokens. A text of any length is one row in memory. Repeated rows repeat; no rows give no rows."""
    id_type = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("n_bytes", F.octet_length("text").cast("long"))
    out = rows.mapInArrow(_count(path), f"doc_id {id_type}, n_bytes long, n_tokens long")
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
