"""BPE encoding and decoding with a backtracking encoder, for vocabularies with word ends.

One Aho-Corasick pass over a word finds the longest token that starts at each place. The encoder
takes the longest token whose neighbour to the left it can stand beside in a true merge result, else
its next shorter prefix token, else it steps back; places that once failed are not tried again, so
the work is linear. Whether two tokens can stand side by side is decided by undoing merges at their
border and kept in a table. Decoding slices one string of all tokens by a table of offsets.
"""

from __future__ import annotations

import json
import re
import unicodedata
from array import array
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Regex, normalizers, pre_tokenizers

from .common import named, pieces

#: Words, and four times as many pairs of tokens, that a worker remembers.
CACHE = 200_000
LETTER, NUMBER, SPACE = r"A-Za-zªµºÀ-ÖØ-öø-ɏ", "0-9²³¹¼½¾", r"\t-\r \x85\xa0"
WORDS = re.compile(rf"[{LETTER}]+|'(?:[stmd]|re|ve|ll)|[{NUMBER}]|[^{SPACE}{LETTER}{NUMBER}]+")
BEYOND, CONTROL = re.compile("[^\x00-ɏ]"), re.compile("[\x1c-\x1f]")


class Classes(dict):
    """Code point -> a character up to U+024F of the same class, as the tokenizer library classes it."""

    def __init__(self):
        kinds = ((r"\p{L}", "ª"), (r"\p{N}", "²"), (r"\s", " "))
        self.kinds = [(pre_tokenizers.Split(Regex(p), "removed", invert=True), c) for p, c in kinds]

    def __missing__(self, code: int) -> str:
        c = chr(code)
        self[code] = c if code < 0x250 else next((to for kind, to in self.kinds if kind.pre_tokenize_str(c)), "§")
        return self[code]


def byte_chars() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = [b for b in range(256) if b not in plain]
    return [chr(b) if b in plain else chr(256 + others.index(b)) for b in range(256)]


class Merges:
    """The tokens of one vocabulary as strings of symbols below 512: a byte, plus 256 at a word's end
    if the vocabulary marks ends."""

    def __init__(self, model: dict):
        byte_of, end = {c: b for b, c in enumerate(byte_chars())}, model.get("end_of_word_suffix") or ""

        def spelled(token: str) -> str:
            last = bool(end) and token.endswith(end)
            own = [byte_of[c] for c in (token[: -len(end)] if last else token)]
            return "".join(map(chr, own[:-1])) + chr(own[-1] + 256 * last)

        #: Tokens by age: single symbols, then merges in order; `ids` has the vocabulary's ids by age.
        vocab, merges = model["vocab"], [tuple(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
        made = [a + b for a, b in merges]
        first = sorted(set(vocab) - set(made), key=vocab.get)
        names = first + made
        assert len(set(names)) == len(names), "two merges make the same token"
        age = {name: i for i, name in enumerate(names)}
        self.ids = [vocab[name] for name in names]
        self.parts = [(i, i) for i in range(len(first))] + [(age[a], age[b]) for a, b in merges]
        self.pairs = {p: len(first) + i for i, p in enumerate(self.parts[len(first):])}
        self.text = [spelled(name) for name in names]
        self.length, self.at = [len(t) for t in self.text], {t: i for i, t in enumerate(self.text)}
        self.shorter = [next((self.at[t[:n]] for n in range(len(t) - 1, 0, -1) if t[:n] in self.at), -1) for t in self.text]
        self.finder = ahocorasick.Automaton()
        for i, t in enumerate(self.text):
            self.finder.add_word(t, i)
        self.finder.make_automaton()
        self.beside: dict[tuple[int, int], bool] = {}

    def compatible(self, a: int, b: int) -> bool:
        """Whether merging leaves a and b side by side: no pair across their border, at any stage of
        their making, merges before both sides are made."""
        known = self.beside.get((a, b))
        if known is None:
            x, y, before, known = a, b, len(self.parts), True
            while True:
                if self.pairs.get((x, y), before) < before:
                    known = False
                    break
                # Undo the younger side; a single symbol cannot be undone.
                undo_left = x > y
                if undo_left and self.parts[x] == (x, x) or not undo_left and self.parts[y] == (y, y):
                    undo_left = not undo_left
                if undo_left:
                    if self.parts[x] == (x, x):
                        break
                    before, x = x, self.parts[x][1]
                else:
                    if self.parts[y] == (y, y):
                        break
                    before, y = y + 1, self.parts[y][0]
            if len(self.beside) < 4 * CACHE:
                self.beside[a, b] = known
        return known

    def tokens(self, symbols: str) -> list[int]:
        """The tokens of one word, by age. The longest matches one after the other are the result if
        all neighbours are compatible; else the search steps back."""
        out = [token for _, token in self.finder.iter_long(symbols)]
        if all(map(self.compatible, out, out[1:])):
            return out
        n, longest = len(symbols), [-1] * len(symbols)
        length = self.length
        for last, token in self.finder.iter(symbols):
            start = last - length[token] + 1
            if longest[start] < 0 or length[longest[start]] < length[token]:
                longest[start] = token
        open_at, out, at = [True] * (n + 1), [], 0
        token = longest[0]
        while at < n:
            while token >= 0:
                stop = at + length[token]
                if open_at[stop] and (not out or self.compatible(out[-1], token)):
                    break
                token = self.shorter[token]
            if token >= 0:
                out.append(token)
                at = stop
                token = longest[at] if at < n else -1
            else:
                open_at[at] = False
                token = out.pop()
                at -= length[token]
        return out


class Encoder(dict):
    """What stands between white space -> ids."""

    def __init__(self, path: str):
        spec = json.load(open(path, encoding="utf-8"))
        self.merges = Merges(spec["model"])
        added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.added = added
        self.special = re.compile("|".join(map(re.escape, sorted(added, key=len, reverse=True)))) if added else None
        self.classes = Classes()
        self.normalizer = normalizers.Sequence([normalizers.NFC(), normalizers.Lowercase()])

    def word(self, word: str) -> tuple[int, ...]:
        raw = word.encode()
        return tuple(map(self.merges.ids.__getitem__, self.merges.tokens(raw[:-1].decode("latin-1") + chr(256 + raw[-1]))))

    def __missing__(self, piece: str) -> tuple[int, ...]:
        if piece.isalpha() and not BEYOND.search(piece):
            ids = self.word(piece)
        else:
            like = piece.translate(self.classes) if BEYOND.search(piece) else piece
            words = [piece[slice(*m.span())] for m in WORDS.finditer(like)]
            ids = tuple(chain.from_iterable(self.word(w) if w == piece else self[w] for w in words))
        if len(self) < CACHE:
            self[piece] = ids
        return ids

    def encode(self, text: str):
        """An iterable of ids. Special strings in the text become their tokens; the rest is
        normalised (NFC, lower case by character) and split into words."""
        if self.special and self.special.search(text):
            out, start = [], 0
            for m in self.special.finditer(text):
                out += [*self.encode(text[start : m.start()]), self.added[m[0]]]
                start = m.end()
            return chain(out, self.encode(text[start:]))
        if text.isascii():
            text = text.lower()
        elif BEYOND.search(text):
            text = self.normalizer.normalize_str(text)  # its Unicode version may differ from Python's
        else:
            text = unicodedata.normalize("NFC", text).lower()
        # No word spans white space; these four are white space to str.split() only.
        pieces = [text] if CONTROL.search(text) else text.split()
        return chain.from_iterable(map(self.__getitem__, pieces))


class Decoder:
    """One buffer of all tokens' strings, each with a space, and the table of their offsets."""

    def __init__(self, path: str):
        spec = json.load(open(path, encoding="utf-8"))
        vocab, added = spec["model"]["vocab"], {t["content"]: t["id"] for t in spec["added_tokens"]}
        by_id = {i: name for name, i in {**vocab, **added}.items()}
        every = [by_id.get(i, "").encode() + b" " for i in range(max(by_id) + 1)]
        self.all_text = np.frombuffer(b"".join(every), np.uint8)
        self.offsets = np.cumsum([0, *map(len, every)])

    def decode(self, ids: np.ndarray) -> bytes:
        """UTF-8 text of the tokens, joined by spaces: gathered from `all_text` by the offset table."""
        if not len(ids):
            return b""
        start, length = self.offsets[ids], self.offsets[ids + 1] - self.offsets[ids]
        ends = np.cumsum(length)
        return self.all_text[np.repeat(start - ends + length, length) + np.arange(ends[-1])].tobytes()[:-1]


_loaded: dict[str, Encoder] = {}
_decoders: dict[str, Decoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _loaded:
        _loaded[path] = Encoder(path)
    return _loaded[path]


def decoder(path: str) -> Decoder:
    if path not in _decoders:
        _decoders[path] = Decoder(path)
    return _decoders[path]


def _encode(path: str):
    def run(batches):
        e = encoder(path)
        for b in pieces(batches):
            ids, ends = array("i"), [0]
            for t in b.column("text").to_pylist():
                ids.extend(e.encode(t or ""))
                ends.append(len(ids))
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(ids, np.int32) if ids else [], pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column("row"), lists], ["row", "ids"])

    return run


def _decode(path: str):
    def run(batches):
        d = decoder(path)
        for b in pieces(batches):
            ids = b.column("ids")
            flat, ends = ids.flatten().to_numpy(zero_copy_only=False), np.cumsum([0, *(n or 0 for n in ids.value_lengths().to_pylist())]).tolist()
            texts = pa.array([d.decode(flat[a:z]) for a, z in zip(ends, ends[1:])], pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([b.column("row"), ids, texts], ["row", "ids", "decoded"])

    return run


def encode(docs: DataFrame, path: str, column: str = "text", keep=("doc_id",)) -> DataFrame:
    """Columns `keep` of `docs` and ids, the token ids of `column`. Null and empty texts have no ids;
    a text of any length is one row in memory; repeated rows repeat; no rows give no rows."""
    rows = docs.select(F.struct(*[named(c) for c in keep]).alias("row"), F.col(column).alias("text"))
    schema = rows.select("row").withColumn("ids", F.array().cast("array<int>")).schema
    return rows.mapInArrow(_encode(path), schema).select("row.*", "ids")


def decode(encoded: DataFrame, path: str, keep=("doc_id",)) -> DataFrame:
    """Columns `keep` of `encoded`, ids, and decoded: the tokens' strings, joined as the tokenizer's
    file says (no decoder: by spaces). Null ids decode to the empty string."""
    rows = encoded.select(F.struct(*[named(c) for c in keep]).alias("row"), "ids")
    schema = rows.withColumn("decoded", F.lit("")).schema
    return rows.mapInArrow(_decode(path), schema).select("row.*", "ids", "decoded")


def round_trip(docs: DataFrame, path: str, column: str = "text", keep=("doc_id",)) -> DataFrame:
    """decode(encode(docs)), with both in one Python worker: a task starts one worker instead of two, and
    ids do not pass through the JVM in between."""
    rows = docs.select(F.struct(*[named(c) for c in keep]).alias("row"), F.col(column).alias("text"))
    schema = rows.select("row").withColumn("ids", F.array().cast("array<int>")).withColumn("decoded", F.lit("")).schema
    to_ids, to_texts = _encode(path), _decode(path)
    return rows.mapInArrow(lambda batches: to_texts(to_ids(batches)), schema).select("row.*", "ids", "decoded")
