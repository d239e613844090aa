"""`spark.read.format("sql_entries")`: the text entries of SQL files, plain, compressed or in archives, as a table.

    register(spark)
    spark.read.format("sql_entries").load("/dumps/*/*").where("project = 'shop'").select("file", "name", "text")

Partitions are planned from the files' sizes, and from the directories of zip archives, whose members are dealt to tasks of their own.
Filters on project, file and name are pushed down: files of other projects are not opened, members of other names not unpacked. A
query that needs no text says so with the option content=false: then nothing is unpacked that an archive's directory tells. Entries of an
archive have the order, but not the numbers, that expand_entries() gives them.

The reader opens paths as local or mounted files, as Python sources do; for stores that only Spark can read there is
read_sql_files() with expand_entries()."""

from __future__ import annotations

import glob
import os
import re
import zipfile
import zlib
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, StringStartsWith

from .files import STOPPED, UNREADABLE, _kind, _opened, _wanted, entries_of

SCHEMA = "project string, file string, file_idx long, entry_idx long, name string, layers array<string>, encrypted boolean, note string, start string, text_bytes long, text string"
#: Bytes of files, or of a zip archive's members, that a task reads.
SPLIT = 64 << 20
#: Names of members that are no archives; members of a zip archive have numbers so far apart.
PLAIN, WITHIN = r"(?i)\.(?:sql|ddl|psql|pgsql|mysql|dump)$", 1_000_000
_text, _long = pa.string(), pa.int64()
ARROW = (("project", _text), ("file", _text), ("file_idx", _long), ("entry_idx", _long), ("name", _text), ("layers", pa.list_(_text)), ("encrypted", pa.bool_()), ("note", _text), ("start", _text), ("text_bytes", _long), ("text", _text))


def text_of(content: bytes) -> str | None:
    """As readable_entries() decodes entries; None for a binary one."""
    for mark, encoding in ((b"\xff\xfe", "utf-16le"), (b"\xfe\xff", "utf-16be")):
        if content.startswith(mark):
            return content[2:].decode(encoding, "replace")
    if content[1:2] == content[3:4] == b"\0":
        return content.decode("utf-16le", "replace")
    return None if b"\0" in content[:4096] else content.removeprefix(b"\xef\xbb\xbf").decode("utf-8", "replace")


@dataclass
class Task(InputPartition):
    """Files (path, project, file, file_idx), or some members (by place) of one zip archive."""

    files: list = field(default_factory=list)
    members: list | None = None

    def __post_init__(self):
        super().__init__(None)


def allowed(f: Filter):
    """(column, test) of a filter that is pushed down, or None."""
    column = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
    if column not in ("project", "file", "name"):
        return None
    if isinstance(f, EqualTo):
        return column, f.value.__eq__
    if isinstance(f, In):
        return column, set(f.value).__contains__
    if isinstance(f, StringStartsWith):
        start = f.value
        return column, lambda v: v.startswith(start)
    return None


class Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.paths = [p for p in options.get("path", "").split(",") if p]
        self.content = options.get("content", "true").lower() != "false"
        self.split = int(options.get("split", SPLIT))
        self.passwords = tuple(x for x in options.get("passwords", "").split("\n") if x)
        self.pushed: list[Filter] = []

    def pushFilters(self, filters):
        for f in filters:
            found = allowed(f)
            if found:
                self.pushed.append(f)
            else:
                yield f

    def _passes(self, column: str, value: str) -> bool:
        return all(test(value) for f in self.pushed for c, test in [allowed(f)] if c == column)

    def _files(self) -> list[tuple[str, str, str, int]]:
        """Files that the filters leave, with their places among all of their project."""
        found = sorted({os.path.abspath(p) for pattern in self.paths for g in glob.glob(re.sub("^file:/+", "/", pattern)) for p in ([g] if os.path.isfile(g) else [os.path.join(g, x) for x in os.listdir(g)]) if os.path.isfile(p)})
        out, count = [], {}
        for p in found:
            project, file = os.path.basename(os.path.dirname(p)), os.path.basename(p)
            i = count[project] = count.get(project, -1) + 1
            if self._passes("project", project) and self._passes("file", file):
                out.append((p, project, file, i))
        return out

    def partitions(self):
        tasks, held, size = [], [], 0
        for f in self._files():
            n = os.path.getsize(f[0])
            if n > self.split and (cut := self._cut(f)):
                tasks += cut
                continue
            if held and size + n > self.split:
                tasks.append(Task(held))
                held, size = [], 0
            held.append(f)
            size += n
        return [*tasks, *([Task(held)] if held else [])] or [Task([])]

    def _cut(self, f: tuple) -> list[Task]:
        """A large zip archive as runs of members."""
        try:
            with zipfile.ZipFile(f[0]) as z:
                sizes = [m.compress_size for m in z.infolist()]
        except (OSError, zipfile.BadZipFile):
            return []
        tasks, run, size = [], [], 0
        for i, n in enumerate(sizes):
            if run and size + n > self.split:
                tasks.append(Task([f], run))
                run, size = [], 0
            run.append(i)
            size += n
        return [*tasks, *([Task([f], run)] if run else [])]

    def _opens(self, name: str) -> bool:
        """Whether this member, or one within it, can pass the filters on names."""
        return all(f.value == name or f.value.startswith(f"{name}/") for f in self.pushed if isinstance(f, EqualTo) and f.attribute == ("name",))

    def _entries(self, path: str, file: str, members: list | None):
        """(entry_idx, name, layers, content or size, encrypted, note, start) of a file, or of some members of a zip archive."""
        with open(path, "rb") as f:
            raw = f.read(512)
            if _kind(raw) != "zip":
                reason = next((why for _, magic, why in UNREADABLE if raw.startswith(bytes.fromhex(magic))), None)
                found = [(file, (), None, False, reason, None)] if reason else entries_of(file, raw + f.read(), (), self.passwords)
                yield from ((i, *e) for i, e in enumerate(found))
                return
        try:
            z = zipfile.ZipFile(path)
        except zipfile.BadZipFile as e:
            yield 0, file, ("zip",), None, False, f"{STOPPED}: {e}", None
            return
        with z:
            every = z.infolist()
            for i in range(len(every)) if members is None else members:
                m, name = every[i], f"{file}/{every[i].filename}"
                if m.is_dir() or not self._opens(name):
                    continue
                locked = bool(m.flag_bits & 1)
                if not _wanted(m.filename):
                    found = [(name, ("zip",), None, locked, "not an SQL file", None)]
                elif not self.content and re.search(PLAIN, m.filename):
                    found = [(name, ("zip",), m.file_size, locked, None, None)]
                else:
                    found = self._member(z, m, name, locked)
                yield from ((i * WITHIN + k, *e) for k, e in enumerate(found))

    def _member(self, z: zipfile.ZipFile, m: zipfile.ZipInfo, name: str, locked: bool) -> list:
        for word in self.passwords if locked else (None,):
            try:
                with z.open(m, pwd=word.encode() if word else None) as f:
                    return list(_opened(name, f, ("zip",), self.passwords, locked))
            except (RuntimeError, NotImplementedError, zipfile.BadZipFile, zlib.error):
                continue
        return [(name, ("zip",), None, locked, "encrypted; no password fits" if locked else "cannot be read", None)]

    def read(self, task: Task):
        for path, project, file, i in task.files:
            for at, name, layers, content, encrypted, note, start in self._entries(path, file, task.members):
                if not self._passes("name", name):
                    continue
                text, size = None, content if isinstance(content, int) else None
                if isinstance(content, bytes):
                    size, text = len(content), text_of(content)
                    note = "it is not a text file" if text is None else note
                row = [project, file, i, at, name, list(layers), encrypted, note, start, size, text if self.content else None]
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, (_, t) in zip(row, ARROW)], names=[n for n, _ in ARROW])


class SqlEntries(DataSource):
    """Options: path (also several, by commas), content (false: sizes and names only), passwords (by lines), split (bytes of a task)."""

    @classmethod
    def name(cls):
        return "sql_entries"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return Reader(self.options)


def register(spark: SparkSession) -> None:
    """Makes the format known, and lets Python sources have filters pushed down."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(SqlEntries)
