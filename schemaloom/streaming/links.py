"""References between tables as they become known, in a stream with state.

State is kept for every last part of a table's name in a project (`bare`): the tables of that name, and references that wait for one. So it is
spread over the tables, not the projects, and a row costs what its name has waiting. A reference that comes before its table says that it waits, and
says that it is linked once the table is there, in whatever file and batch that comes."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..functions.columns import DEFAULT_SCHEMAS
from ..sources.ddl import events_of
from .ingest import BINARY, statements_of

FACT = "project string, bare string, what string, place string, file string, name string, child string, columns string, item int"
LINK = "project string, status string, child string, columns string, parent string, file string"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _name(parts: list[str]) -> str:
    """A table's name in lower case, without a default schema, as table_key() has it."""
    low = [p.lower() for p in parts[-2:]]
    return low[-1] if low[0] in DEFAULT_SCHEMAS else ".".join(low)


def _facts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Definitions and references of statement rows."""
    for b in batches:
        out = []
        for r in b.itertuples(index=False):
            made = None
            for i, e in enumerate(events_of(r.sql or "", r.kind)):
                parts, place = e.get("parts"), f"{r.path}/{r.entry_idx:012}/{r.stmt_idx:012}"
                if e["event"] == "create":
                    made = parts
                    out.append((r.project, parts[-1].lower(), "define", place, r.file, _name(parts), None, None, i))
                elif e["event"] == "fk" and e.get("ref_parts") and (made or parts):
                    to = e["ref_parts"]
                    out.append((r.project, to[-1].lower(), "refer", place, r.file, _name(to), _name(made or parts), ",".join(e["columns"]).lower(), i))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in FACT.split(", ")])


class Links(StatefulProcessor):
    """tables: name -> file of the last definition and a running number; redefined: the table that a bare name means, if one was defined again; waiting:
    references without a table."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.tables = handle.getMapState("tables", "name string", "file string, n long")
        self.redefined = handle.getValueState("redefined", "name string")
        self.waiting = handle.getListState("waiting", "child string, columns string, name string, file string")

    def _target(self, name: str) -> str | None:
        """The table of that very name, else the one that was defined again last, else the first of the bare name."""
        if self.tables.containsKey((name,)):
            return name
        if self.redefined.exists():
            return self.redefined.get()[0]
        return min(((n, k[0]) for k, (_, n) in self.tables.iterator()), default=(0, None))[1]

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        every = pd.concat(list(rows)).sort_values(["place", "item"]) if rows else pd.DataFrame()
        out = []
        defined = every[every["what"] == "define"]
        for r in defined.itertuples(index=False):
            known = self.tables.getValue((r.name,)) if self.tables.containsKey((r.name,)) else None
            number = known[1] if known else sum(1 for _ in self.tables.keys())
            self.tables.updateValue((r.name,), (r.file, number))
            if known:
                self.redefined.update((r.name,))
                # A file that comes again replaces its table; another file defines it again.
                out.append(("replaced" if known[0] == r.file else "redefined", None, None, r.name, r.file))
        still = []
        if len(defined):
            for child, columns, name, file in list(self.waiting.get()):
                to = self._target(name)
                out.append(("linked", child, columns, to, file)) if to else still.append((child, columns, name, file))
        else:
            still = None  # as it was
        more = []
        for r in every[every["what"] == "refer"].itertuples(index=False):
            to = self._target(r.name)
            out.append(("linked" if to else "waiting", r.child, r.columns, to or r.name, r.file))
            if not to:
                more.append((r.child, r.columns, r.name, r.file))
        if still is not None:
            self.waiting.put([*still, *more]) if still or more else self.waiting.clear()
        elif more:
            self.waiting.appendList(more)
        yield pd.DataFrame([(key[0], *o) for o in out], columns=[c.split()[0] for c in LINK.split(", ")])

    def close(self) -> None:
        pass


def links(files: DataFrame) -> DataFrame:
    """What a stream of files (binaryFile rows) says of references: project, status (linked; waiting for a table; redefined and replaced tables), child,
    columns, parent (the table, or the name that is waited for) and file. Names are in lower case. The state store has to be RocksDB."""
    facts = statements_of(files).select("project", "path", "file", "entry_idx", "stmt_idx", "kind", "sql").mapInPandas(_facts, FACT)
    return facts.groupBy("project", "bare").transformWithStateInPandas(Links(), LINK, "append", "none")


def stream_links(spark: SparkSession, folder: str, out: str, checkpoint: str, per_batch: int | None = None):
    """A query that reads new files and appends their links to Parquet in `out`. State and progress are in `checkpoint`: started again, it goes on where
    it was."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    reader = spark.readStream.format("binaryFile").schema(BINARY)
    files = (reader.option("maxFilesPerTrigger", per_batch) if per_batch else reader).load(folder)
    return links(files).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
