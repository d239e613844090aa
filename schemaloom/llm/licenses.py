"""License scans by ordered signature rules.

Rules are the regexes of signatures.py over a text's words (lower-case, one space between). A rule runs
only on texts that hold its keyword. Detections are intervals of words with a priority; one that lies
inside another of at least its priority is suppressed (of equal intervals and priorities the earlier
rule's stays). The base phrases are counted at every place and their labels always stay.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import pieces
from .signatures import IDENTIFIERS, SIGNATURES

#: Phrases (as words) and their labels.
BASE = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)
#: How sure a detection of each priority is.
GRANTS = {6: 0.95, 5: 0.9, 4: 0.8, 3: 0.6, 2: 0.4, 1: 0.2}

#: Lower-cases A-Z, keeps digits, a-z and every byte of other characters, and blanks the rest.
TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def _version(m: re.Match) -> str:
    number = m[1].split(".")
    return r"(?:version |v ?)?" + (" ".join(number) if len(number) > 1 else f"{m[1]}(?: 0)?")


def rules() -> list[tuple[str, str, int, str]]:
    """Ordered rules (keyword, label, priority, regex). Those with the keyword SPDX are members of an expression."""
    out = []
    for line in SIGNATURES.strip().splitlines():
        label, priority, pattern = line.split(" | ")
        keyword = re.search(r"~(\w+)", pattern)[1]
        pattern = re.sub(r"<([0-9.]+)>", _version, pattern.replace("~", "").replace("LIC", "(?:license|licence)"))
        out.append((keyword, label, int(priority), pattern))
    for name in IDENTIFIERS:
        words = " ".join(re.findall("[0-9a-z]+", name.lower()))
        out.append((SPDX, name.lower(), 5, words))
    return out


#: The keyword of rules for members of an expression after `SPDX-License-Identifier:`, and what stands before and between
#: members. Members of one's own and exceptions have no label.
SPDX, SPDX_HEAD, SPDX_OPERATOR = "spdx", "spdx (?:license|licence) identifier", "(?:or|and|with)"
SPDX_OTHER = r"licenseref(?: \w+){1,4}?|(?:\w+ ){1,4}?exception(?: [0-9]+)*"


def _compiled() -> dict[bytes, list]:
    by: dict[bytes, list] = {}
    for order, (keyword, label, priority, pattern) in enumerate(rules()):
        if keyword != SPDX:
            by.setdefault(keyword.encode(), []).append((order, label, priority, re.compile(rf" (?:{pattern})(?= )".encode())))
    return by


class Expressions:
    """Members of expressions of any length: known ones, each joined to the next by an operator."""

    def __init__(self):
        own = [(order, label, priority, words) for order, (keyword, label, priority, words) in enumerate(rules()) if keyword == SPDX]
        self.by = {words.encode(): (order, label, priority) for order, label, priority, words in own}
        known = "|".join(sorted((words for *_, words in own), key=len, reverse=True))
        one = rf"(?:(?:{known})(?= )|{SPDX_OTHER})"
        self.whole = re.compile(rf" {SPDX_HEAD}(?P<all> {one}(?: {SPDX_OPERATOR} {one})*)(?= )".encode())
        self.member = re.compile(rf"(?:(?<= identifier)|(?<= or)|(?<= and)|(?<= with)) (?P<at>{known})(?= )".encode())

    def find(self, flat: bytes):
        """Start (of the blank before), end, priority, label, order of each member."""
        for m in self.whole.finditer(flat):
            for x in self.member.finditer(flat, m.start("all"), m.end("all") + 1):
                order, label, priority = self.by[x["at"]]
                yield x.start(), x.end(), priority, label, order


def suppressed(found: list[tuple]) -> list[tuple]:
    """Detections (start, end, priority, label, order) without those inside another of at least their priority."""
    found = sorted(found, key=lambda d: (d[0], -d[1], -d[2], d[4]))
    kept, near = [], []
    for d in found:
        # They come by start, longer first, so what holds one comes before it. A rule's own matches do not overlap:
        # no more than one a rule is still open here.
        near = [k for k in near if k[1] > d[0]]
        if not any(k[1] >= d[1] and k[2] >= d[2] for k in near):
            near.append(d)
            kept.append(d)
    return kept


_state: dict = {}


def scan(text: str) -> tuple[int, list[tuple[int, str]], list[tuple]]:
    """Number of words; base places (word, label); detections that stay (start, end, priority, label,
    order of the rule), in words."""
    if not _state:
        _state["rules"] = _compiled()
        _state["base"] = [(p.split()[0].encode(), re.compile(rf" {p}(?= )".encode()), label) for p, label in BASE]
        _state["spdx"] = Expressions()
        _state["words"] = frozenset({*_state["rules"], SPDX.encode()}) | {first for first, _, _ in _state["base"]}
    words = text.encode("utf-8", "surrogatepass").translate(TABLE).split()
    held = _state["words"].intersection(words)
    if not held:
        return len(words), [], []
    flat = b" " + b" ".join(words) + b" "
    blanks = np.flatnonzero(np.frombuffer(flat, np.uint8) == 32)  # the i-th is the one before word i
    at = lambda place: int(np.searchsorted(blanks, place))
    base = [(at(m.start()), label) for word, p, label in _state["base"] if word in held for m in p.finditer(flat)]
    found = []
    for keyword in held:
        for order, label, priority, p in _state["rules"].get(keyword, ()):
            for m in p.finditer(flat):
                found.append((at(m.start()), at(m.end()), priority, label, order))
    if SPDX.encode() in held:
        found += [(at(a), at(b), *rest) for a, b, *rest in _state["spdx"].find(flat)]
    return len(words), base, suppressed(found)


def _scan(batches):
    for b in pieces(batches):
        rows = []
        for text in b.column("text").to_pylist():
            n, base, found = scan(text or "")
            at = [w for w, _ in base]
            missing = 1.0
            for d in found:
                missing *= 1 - GRANTS[d[2]]
            rows.append((
                n, len(base), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in base})),
                ",".join(sorted({x for _, x in base} | {d[3] for d in found})), 1 - missing,
                [{"start": d[0], "end": d[1], "label": d[3], "priority": d[2]} for d in found]))
        cols = list(zip(*rows)) or [()] * 8
        kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), DETECTIONS]
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(list(c), k) for c, k in zip(cols, kinds))], ["doc_id", *COLUMNS])


COLUMNS = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "detections")
DETECTIONS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("label", pa.string()), ("priority", pa.int32())]))


def scan_licenses(docs: DataFrame) -> DataFrame:
    """One row per row of `docs` (columns doc_id, text; others are ignored): doc_id, n_words, n_base,
    first_word, last_word, base_labels, labels, score (1 less the product of what each detection
    leaves open) and detections (start, end, label, priority; in words).

    Null and empty texts have no words, no labels (empty strings) and score 0. A text of any length is
    one row in memory. Repeated rows repeat; no rows give no rows."""
    id_type = docs.schema["doc_id"].dataType.simpleString()
    schema = (f"doc_id {id_type}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, "
              "detections array<struct<start: long, end: long, label: string, priority: int>>")
    return docs.select("doc_id", "text").mapInArrow(_scan, schema)
