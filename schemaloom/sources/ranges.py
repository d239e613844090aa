"""Plain SQL dumps of any size, read by all cores: byte ranges are scanned before it is known what holds where they start.

1. Spark's text reader deals out each file's splits. A task joins the lines of a split to ranges of about RANGE bytes.
2. Each range is scanned from a guess: the first place at which a statement seems to start (or COPY data to go on), found by trying the ways in which
   a range can start: in a statement, a quote, a comment or COPY data. What stands before that place is the range's head; what stands
   after its last full statement, its tail. Only heads, tails, DDL and counters leave the task.
3. A range's tail and the next one's head are scanned together. If that ends where the next range was started, in the same state, the
   guess is proven, by induction from the start of the file. A wrong guess about backslashes does no harm to a range that has none.
4. Ranges after a join that does not fit are scanned again, from the tail before them (or with what the file's first range says about
   backslashes), until all fit. So the result is that of one scan of the whole file, for ranges of any size.

Windows go over slim rows, one a range of a file. A statement has to fit into memory, and longer lines than RANGE are not cut."""

from __future__ import annotations

import hashlib
import re
import zlib
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import scratch, written
from .statements import STATEMENTS, STATS, Script

#: Bytes of a range, and characters that a guess looks at.
RANGE, PROBE = 16 << 20, 1 << 18
#: Ranges that are scanned one after the other in a task, where guesses failed.
CHAIN = 16
_starts = re.compile(r"\s*(?:--|/\*|#|\Z|GO\s*$|\\|(?:INSERT|REPLACE|CREATE|ALTER|DROP|SET|COPY|COMMENT|UPDATE|DELETE|SELECT|LOCK|UNLOCK|BEGIN|START|COMMIT|GRANT|REVOKE|USE|PRAGMA|DELIMITER|EXEC|IF|DECLARE|TRUNCATE|ANALYZE|VALUES|WITH)\b)", re.I | re.M)

RANGED = ("file string, block long, seq int, bytes long, chars long, encoding string, nul boolean, lead string, head string, start string, label string, slashes boolean, sets boolean, "
          "carried string, kept array<struct<kind:string,sql:string>>, statements long, inserts long, copies long, tail string, tail_start string, at_line boolean")
KEY = ["file", "block", "seq"]


def _plausible(text: str, marks: list[int]) -> float:
    return sum(bool(_starts.match(text, at)) for at in marks) / len(marks) if marks else 0.0


def guess(text: str, label: str) -> tuple[int, str]:
    """Where a range may be cut, and the state there, for backslashes as `label` says."""
    probe, best = text[:PROBE], (0.0, 0, label)
    for prefix in ("", "'", '"', "`", "/*"):
        s = Script(prefix + probe, label, at_line=False, most=6)
        at = [m - len(prefix) for m in s.marks if m > len(prefix)]
        score = _plausible(probe, at)
        if score > best[0]:
            best = score, at[0], label
    copy = "copy_escapes" if label == "escapes" else "copy"
    end = probe.find("\n\\.\n")
    lines = probe[: end if end >= 0 else None].split("\n", 12)[:10]
    even = len({line.count("\t") for line in lines[:-1] or lines}) == 1 and not any(_starts.match(line) for line in lines if line)
    score = 0.9 * even * (_plausible(probe, [end + 3]) if end >= 0 else 1.0)
    if score > best[0]:
        best = score, 0, copy
    return best[1], best[2]


def _swapped(state: str, label: str) -> str:
    """The state with backslashes as `label` says."""
    mode, blank, delimiter = state.partition(" ")
    return ("copy_escapes" if label == "escapes" else "copy") + blank + delimiter if mode.startswith("copy") else label + blank + delimiter


def label_of(state: str | None) -> str:
    return "literal" if (state or "").partition(" ")[0] in ("literal", "copy") else "escapes"


class Scanned:
    """A text from a state: DDL and counters up to the last safe place, and what is left. With `last` the text is all that is left of its file."""

    def __init__(self, text: str, start: str, at_line: bool, last: bool = False):
        s = Script(text, start, at_line=at_line)
        n, self.statements, self.inserts, self.copies = (len(s.kept), s.total, s.inserts, s.copies) if last else s.counted
        self.kept = [{"kind": k, "sql": sql} for k, sql in s.kept[:n]]
        at, state = s.safe
        self.tail, self.start = ("", state) if last else (text[at:], state)
        self.at_line = at_line and not at
        self.sets = label_of(state) != label_of(start)


def _row(key: tuple, size: int, raw: tuple, text: str, lead: str, head: str, start: str, at_line: bool, carried: str | None) -> tuple:
    s = Scanned(text, start, at_line)
    encoding, nul, chars = raw
    return (*key, size, chars, encoding, nul, lead, head, start, label_of(start), "\\" in text, s.sets, carried, s.kept, s.statements, s.inserts, s.copies, s.tail, s.start, s.at_line)


def _decoded(raw: bytes, first: bool) -> tuple[str, tuple]:
    """Text, and what the first range says about its file: encoding and whether it is binary; and UTF-16 units."""
    encoding, nul = "utf-8", False
    if first:
        odd = raw[:2] in (b"\xff\xfe", b"\xfe\xff") or raw[1:2] == raw[3:4] == b"\0"
        encoding, nul = "utf-16" if odd else "utf-8", b"\0" in raw[:4096]
        raw = raw.removeprefix(b"\xef\xbb\xbf")
    text = raw.decode("utf-8", "replace")
    return text, (encoding, nul, len(text) + sum(c > "￿" for c in text) if not text.isascii() else len(text))


def _ranges(batches, size: int):
    """(file, block, seq, bytes) of ranges; lines come in order."""
    key, lines, held, seq = None, [], 0, 0
    for b in batches:
        for file, block, line in zip(b["file"], b["block"], b["line"]):
            if key != (file, block):
                if lines:
                    yield (*key, seq), b"\n".join(lines) + b"\n"
                key, lines, held, seq = (file, block), [], 0, 0
            elif held >= size:
                yield (*key, seq), b"\n".join(lines) + b"\n"
                lines, held, seq = [], 0, seq + 1
            lines.append(line)
            held += len(line) + 1
    if lines:
        yield (*key, seq), b"\n".join(lines) + b"\n"


_columns = [c.split()[0] for c in re.sub(r"<[^ ]*>", "", RANGED).split(", ")]


def _first_scan(size: int):
    def run(batches):
        for (file, block, seq), raw in _ranges(batches, size):
            first = block == 0 and seq == 0
            text, facts = _decoded(raw, first)
            if first:
                yield pd.DataFrame([_row((file, block, seq), len(raw), facts, text, "", "", "escapes", True, None)], columns=_columns)
                continue
            g, start = guess(text, "escapes")
            lead = "" if g else "\n"  # what is cut at its start has the line end before it
            yield pd.DataFrame([_row((file, block, seq), len(raw), facts, lead + text[g:], lead, text[:g], start, False, None)], columns=_columns)

    return run


def _texts(size: int):
    def run(batches):
        for (file, block, seq), raw in _ranges(batches, size):
            yield pd.DataFrame([(file, block, seq, raw)], columns=["file", "block", "seq", "raw"])

    return run


def _again(pdf: pd.DataFrame) -> pd.DataFrame:
    """Ranges one after the other (file, block, seq, raw), from what is known now: the tail of the range before (tail, tail_start, at_line of
    the first row), or a label (hint) to guess with."""
    out, known = [], None
    for r in pdf.sort_values(["block", "seq"]).itertuples(index=False):
        text, facts = _decoded(bytes(r.raw), False)
        if r.hint is not None:
            g, start = guess(text, r.hint)
            lead = "" if g else "\n"
            out.append(_row((r.file, r.block, r.seq), len(r.raw), facts, lead + text[g:], lead, text[:g], start, False, None))
        else:
            tail, start, at_line = known or (r.tail, r.tail_start, bool(r.at_line))
            out.append(_row((r.file, r.block, r.seq), len(r.raw), facts, tail + text, "", "", start, at_line, carry(tail, start, at_line)))
            known = out[-1][-3:]
    return pd.DataFrame(out, columns=_columns)


def carry(tail: str, start: str, at_line: bool) -> str:
    """Stands for a tail; as _carry() makes it."""
    return hashlib.md5(f"{start}|{str(at_line).lower()}|{tail}".encode("utf-8", "replace")).hexdigest()


JOINED = "file string, block long, seq int, fits boolean, f_slashes boolean, f_kept array<struct<kind:string,sql:string>>, f_statements long, f_inserts long, f_copies long"


def _join(batches):
    """Each range's tail with the next one's head: whether it ends where that was started, and what is in it."""
    for b in batches:
        out = []
        for r in b.itertuples(index=False):
            text = r.tail + (r.next_head or "")
            if r.last:
                s, fits = Scanned(text, r.tail_start, r.at_line, last=True), True
            elif r.next_carried is not None:
                s, fits, text = None, r.next_carried == r.carry, ""
            else:
                fits = text.endswith(r.next_lead)
                text = text.removesuffix(r.next_lead)
                s = Scanned(text, r.tail_start, r.at_line)
                fits = fits and not s.tail.strip(" \t\r\n\f") and s.start == r.next_start
            if s is None or not fits:
                out.append((r.file, r.block, r.seq, fits, False, [], 0, 0, 0))
            else:
                out.append((r.file, r.block, r.seq, fits, "\\" in text, s.kept, s.statements, s.inserts, s.copies))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in re.sub(r"<[^ ]*>", "", JOINED).split(", ")])


def _next(ranges: DataFrame) -> DataFrame:
    """Slim: each range's key, its place in the file, and the key of the one after it."""
    order = Window.partitionBy("file").orderBy("block", "seq")
    slim = ranges.select(*KEY)
    return slim.withColumn("place", F.row_number().over(order)).withColumn("next_block", F.lead("block").over(order)).withColumn("next_seq", F.lead("seq").over(order))


def _carry():
    return F.md5(F.concat_ws("|", "tail_start", F.col("at_line").cast("string"), "tail"))


def _relabelled(ranges: DataFrame) -> DataFrame:
    """Ranges without backslashes (and so without a difference) have the label of their file's first range at its end, until a range sets another."""
    order = Window.partitionBy("file").orderBy("block", "seq")
    first = order.rowsBetween(Window.unboundedPreceding, -1)
    slim = ranges.select(*KEY, "label", "slashes", "carried", F.when(F.col("sets") | (F.row_number().over(order) == 1), F.when(F.col("tail_start").rlike("^(literal|copy)( |$)"), "literal").otherwise("escapes")).alias("says"))
    slim = written(slim.withColumn("true_label", F.coalesce(F.last("says", ignorenulls=True).over(first), F.lit("escapes"))).where("true_label <> label and carried IS NULL").select(*KEY, "true_label", "slashes"))
    if slim.isEmpty():
        return ranges.withColumn("hint", F.lit(None).cast("string"))
    both = ranges.join(slim.select(*KEY, "true_label"), KEY, "left")
    swap = lambda c: F.when(F.col(c).startswith("copy"), F.concat(F.when(F.col("true_label") == "escapes", "copy_escapes").otherwise("copy"), F.regexp_extract(c, "( .*)?$", 1))).otherwise(F.concat("true_label", F.regexp_extract(c, "( .*)?$", 1)))
    toggled = F.col("true_label").isNotNull() & ~F.col("slashes")
    return both.withColumns({
        "hint": F.when(F.col("slashes"), F.col("true_label")), "tail_start": F.when(toggled & ~F.col("sets"), swap("tail_start")).otherwise(F.col("tail_start")),
        "start": F.when(toggled, swap("start")).otherwise(F.col("start")), "label": F.when(toggled, F.col("true_label")).otherwise(F.col("label"))}).drop("true_label")


def _joined(ranges: DataFrame) -> DataFrame:
    """`ranges` with what joins each to the next one."""
    after = ranges.select("file", F.col("block").alias("next_block"), F.col("seq").alias("next_seq"), F.col("head").alias("next_head"), F.col("lead").alias("next_lead"), F.col("start").alias("next_start"), F.col("carried").alias("next_carried"))
    rows = ranges.select(*KEY, "tail", "tail_start", "at_line", _carry().alias("carry")).join(written(_next(ranges)), KEY).join(after, ["file", "next_block", "next_seq"], "left")
    rows = rows.withColumn("last", F.col("next_block").isNull()).drop("next_block", "next_seq")
    return rows.mapInPandas(_join, JOINED)


@dataclass
class Dumps:
    """statements and stats as split_statements() and scan_stats() have them, one entry a file; notes (project, file, file_idx, note) of files that are
    not plain UTF-8 text."""

    statements: DataFrame
    stats: DataFrame
    notes: DataFrame


def scan_lines(lines: DataFrame, size: int = RANGE) -> DataFrame:
    """Of lines (file, block, line as binary; those of one (file, block) in order within one task, however often the frame is run): a written
    table of ranges that fit, with what joins them."""
    ranges = written(lines.mapInPandas(_first_scan(size), RANGED))
    while True:
        ranges = written(_relabelled(ranges))
        joined = written(_joined(ranges.drop("hint")))
        ahead = written(_next(ranges))
        # What follows a join that does not fit starts from the tail before it; what has only the wrong label, from a new guess.
        lost = joined.where("not fits").select(*KEY).join(ahead, KEY).join(ranges.select(*KEY, "tail", "tail_start", "at_line"), KEY)
        lost = lost.select("file", F.col("next_block").alias("block"), F.col("next_seq").alias("seq"), (F.col("place") + 1).alias("place"), "tail", "tail_start", "at_line", F.lit(None).cast("string").alias("hint"))
        hints = ranges.where("hint is not null").select(*KEY, "hint").join(ahead.select(*KEY, "place"), KEY)
        hints = hints.select(*KEY, "place", F.lit("").alias("tail"), F.lit("").alias("tail_start"), F.lit(False).alias("at_line"), "hint")
        # Lost ranges that follow each other are one chain, up to CHAIN of them.
        lost = lost.join(hints.select(*KEY), KEY, "left_anti").withColumn("run", F.col("place") - F.row_number().over(Window.partitionBy("file").orderBy("place")))
        lost = lost.withColumn("chain", F.col("place") - (F.row_number().over(Window.partitionBy("file", "run").orderBy("place")) - 1) % CHAIN).drop("run")
        todo = written(hints.withColumn("chain", F.col("place")).unionByName(lost).drop("place"))
        if todo.isEmpty():
            return written(ranges.drop("hint").join(joined, KEY).join(ahead.select(*KEY, "place"), KEY), keep=True)
        # Blocks that hold such a range; their other ranges are cut again, but not scanned.
        some = lines.join(todo.select("file", "block").distinct(), ["file", "block"], "left_semi")
        fresh = written(some.mapInPandas(_texts(size), "file string, block long, seq int, raw binary").join(todo, KEY).groupBy("file", "chain").applyInPandas(_again, RANGED))
        first = ranges.select(*KEY, F.col("encoding").alias("e"), F.col("nul").alias("n"), F.col("chars").alias("c"))
        fresh = fresh.join(first, KEY).withColumns({"encoding": F.col("e"), "nul": F.col("n"), "chars": F.col("c")}).drop("e", "n", "c")
        ranges = ranges.drop("hint").join(todo.select(*KEY), KEY, "left_anti").unionByName(fresh)


def read_dumps(spark: SparkSession, paths, size: int = RANGE) -> Dumps:
    """The statements of plain dumps (also .gz, read by one task each, and .bz2, whose blocks Spark deals out), of any size.

    project is a file's folder and file_idx its place by path in it, as read_sql_files() has them. Files without a byte are not seen (by any of Spark's readers of files). A line end at
    the end of a file counts as a character whether it is there or not."""
    lines = spark.read.option("lineSep", "\n").text(paths).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("line"))
    return _dumps(spark, lines, paths, size)


def _dumps(spark: SparkSession, lines: DataFrame, paths, size: int) -> Dumps:
    """What the lines (file, block, line) of the files at `paths` hold."""
    with scratch(spark):
        found = scan_lines(lines, size)
    files = spark.read.format("binaryFile").load(paths).select("path")  # the content is not read
    order = Window.partitionBy("project").orderBy("path")
    files = files.withColumn("project", F.regexp_extract("path", "([^/]+)/[^/]*$", 1)).withColumn("name", F.url_decode(F.regexp_replace(F.regexp_extract("path", "([^/]*)$", 1), r"\+", "%2B")))
    files = written(files.withColumn("file_idx", (F.row_number().over(order) - 1).cast("long")))
    at = F.url_decode(F.regexp_replace(F.regexp_replace("file", "^file:/+", "file:/"), r"\+", "%2B"))
    found = found.withColumn("path", at)
    files = files.withColumn("key", F.url_decode(F.regexp_replace(F.regexp_replace("path", "^file:/+", "file:/"), r"\+", "%2B"))).drop("path")
    known = files.select("key", "project", F.col("name").alias("file"), "file_idx", F.lit(0).cast("long").alias("entry_idx"))
    bad = found.where("block = 0 and seq = 0 and (nul or encoding <> 'utf-8')").select("path", "encoding")
    note = F.when(F.col("encoding") == "utf-16", "it is UTF-16 text, which is read whole").otherwise("it is not a text file")
    notes = known.join(bad, known["key"] == bad["path"]).select("project", "file", "file_idx", note.alias("note"))
    good = found.join(bad.select("path"), "path", "left_anti").drop("file")

    n = F.size("kept") + F.size("f_kept")
    before = F.coalesce(F.sum(n).over(Window.partitionBy("path").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = good.select("path", "place", before.alias("before"))
    held = good.where(n > 0).select("path", "place", F.concat("kept", "f_kept").alias("kept")).join(offsets, ["path", "place"])
    rows = held.select("path", "before", F.posexplode("kept").alias("at", "s"))
    rows = known.join(rows, known["key"] == rows["path"])
    statements = rows.select("project", "file", "file_idx", "entry_idx", (F.col("before") + F.col("at")).cast("long").alias("stmt_idx"), "s.kind", "s.sql")

    total = lambda *c: F.sum(sum(map(F.col, c[1:]), F.col(c[0]))).alias(c[0])
    created = F.size(F.filter(F.concat("kept", "f_kept"), lambda s: s["kind"] == "create_table"))
    sums = good.groupBy("path").agg(total("chars"), total("statements", "f_statements"), F.sum(n).alias("kept"), total("inserts", "f_inserts"), total("copies", "f_copies"), F.sum(created).alias("created"))
    rows = known.join(sums, known["key"] == sums["path"], "left").join(bad.withColumnRenamed("path", "key").select("key"), "key", "left_anti")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    names = [c.split()[0] for c in STATS.split(", ")]
    stats = rows.select("project", "file", "file_idx", "entry_idx", *[zero(F.col("copies" if c == "copy_blocks" else c)).alias(c) for c in names[4:]])
    return Dumps(statements.select(*[c.split()[0] for c in STATEMENTS.split(", ")]), stats, notes)


#: Bytes of compressed members that one task unpacks.
MEMBERS = 8 << 20
_member = re.compile(rb"\x1f\x8b\x08[\x00-\x1f]")


def _decodes(raw: memoryview) -> bool:
    """Whether a gzip member starts here: its first bytes can be unpacked."""
    d = zlib.decompressobj(31)
    try:
        d.decompress(bytes(raw[:65536]), 4096)
    except zlib.error:
        return False
    return d.eof or bool(d.unconsumed_tail) or len(raw) > 65536


def member_runs(raw: bytes, size: int) -> list[tuple[int, int]]:
    """Ranges of a gzip file of at least `size` bytes (but for the last), each of whole members."""
    cuts, view = [0], memoryview(raw)
    for m in _member.finditer(raw, 1):
        if m.start() - cuts[-1] >= size and _decodes(view[m.start() :]):
            cuts.append(m.start())
    return list(zip(cuts, [*cuts[1:], len(raw)]))


def _runs(size: int):
    def run(batches):
        for b in batches:
            for path, content in zip(b["path"], b["content"]):
                raw = bytes(content)
                for start, end in member_runs(raw, size) if raw[:2] == b"\x1f\x8b" else [(0, len(raw))]:
                    yield pd.DataFrame([(path, start, raw[start:end])], columns=["file", "block", "packed"])

    return run


def unpacked(packed: bytes) -> tuple[bytes, bool]:
    """What the members hold, and whether they end where the bytes do. What is left of a broken file is what came before the fault."""
    out = []
    while packed:
        d = zlib.decompressobj(31)
        try:
            out.append(d.decompress(packed))
        except zlib.error:
            return b"".join(out), False
        if not d.eof:
            return b"".join(out), False
        packed = d.unused_data.lstrip(b"\0")
    return b"".join(out), True


def _unpack(batches):
    for b in batches:
        for file, block, packed in zip(b["file"], b["block"], b["packed"]):
            raw, whole = unpacked(bytes(packed)) if bytes(packed[:2]) == b"\x1f\x8b" else (bytes(packed), True)
            cut = raw.find(b"\n") + 1 or len(raw)
            yield pd.DataFrame([(file, block, raw, raw[:cut], cut == len(raw) and not raw.endswith(b"\n"), whole)], columns=["file", "block", "raw", "first", "open", "whole"])


def _lines(batches):
    """The lines that start in a run: not the one that started before it, but the end of its last one."""
    for b in batches:
        for r in b.itertuples(index=False):
            text = bytes(r.raw)[0 if r.block == 0 else len(r.first) :] + bytes(r.rest or b"")
            if text:
                lines = text.removesuffix(b"\n").split(b"\n")
                yield pd.DataFrame({"file": r.file, "block": r.block, "line": lines})


def read_gzip_dumps(spark: SparkSession, paths, size: int = RANGE, members: int = MEMBERS) -> Dumps:
    """read_dumps() for gzip files of several members (of dumps that were appended to each other, or packed in blocks): each file is read by
    one task, which finds the members; runs of them are unpacked and scanned by all. Files of up to 2 GB; of one member each is one task.

    Files with a fault are read up to it, with a note."""
    files = spark.read.format("binaryFile").load(paths).select("path", "content")
    cores, order = spark.sparkContext.defaultParallelism, Window.partitionBy("file").orderBy("block")

    def unpack(some: DataFrame, size: int) -> DataFrame:
        runs = written(some.mapInPandas(_runs(size), "file string, block long, packed binary"))
        return runs.repartition(4 * cores, "file", "block").mapInPandas(_unpack, "file string, block long, raw binary, first binary, open boolean, whole boolean")

    parts = written(unpack(files, members))
    # Where a run does not end with a member, the next start was none (or the file is broken): such a file is one run.
    last = parts.select("file", "whole", F.lead("block").over(order).isNull().alias("last"))
    wrong = written(last.where("not whole and not last").select("file").distinct())
    if not wrong.isEmpty():
        again = unpack(files.join(wrong.withColumnRenamed("file", "path"), "path", "left_semi"), 1 << 62)
        parts = written(parts.join(wrong, "file", "left_anti").unionByName(again))
    slim = parts.select("file", "block", "open", (F.row_number().over(order) == 1).alias("head"))
    # A line may go on through runs that hold no line end at all: these belong to the run before them.
    group = F.count_if(~F.col("open") | F.col("head")).over(order)
    slim = written(slim.withColumn("group", group))
    ends = parts.select("file", "block", "first").join(slim.select("file", "block", "group", "open", "head"), ["file", "block"])
    rest = ends.where("not head").withColumn("to", F.when(F.col("open"), F.col("group")).otherwise(F.col("group") - 1))
    rest = rest.groupBy("file", "to").agg(F.transform(F.array_sort(F.collect_list(F.struct("block", "first"))), lambda s: s["first"]).alias("firsts"))
    rest = rest.withColumn("rest", F.aggregate("firsts", F.lit(b""), lambda a, b: F.concat(a, b))).drop("firsts")
    held = slim.where("not open or head").select("file", "block", "group")
    held = held.join(rest.withColumnRenamed("to", "group"), ["file", "group"], "left").drop("group")
    lines = parts.select("file", "block", "raw", "first").join(written(held), ["file", "block"]).mapInPandas(_lines, "file string, block long, line binary")
    found = _dumps(spark, lines, paths, size)
    bad = parts.where("not whole").groupBy("file").agg(F.min("block").alias("block"))
    known = bad.select(F.regexp_extract("file", "([^/]+)/[^/]*$", 1).alias("project"), F.regexp_extract("file", "([^/]*)$", 1).alias("file"))
    named = found.stats.select("project", "file", "file_idx").join(known.distinct(), ["project", "file"])
    return Dumps(found.statements, found.stats, found.notes.unionByName(named.withColumn("note", F.lit("stopped partway: its data is damaged"))))
