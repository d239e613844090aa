"""SQL corpora made of table rows, for jobs over DDL text."""

from __future__ import annotations

import bz2
import gzip
import io
import lzma
import tarfile
import zipfile

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import written


def _zero():
    return F.lit(0).cast("long")


def _spread(rows: DataFrame, key: str) -> DataFrame:
    """Slim rows dealt to all cores: reading their statements costs far more than moving them."""
    return rows.repartition(2 * rows.sparkSession.sparkContext.defaultParallelism, key)


def tree(documents: DataFrame) -> DataFrame:
    """One CREATE TABLE a document: table k = doc_id mod 250 of project doc_id div 250 references the tables
    k div 2 (column a_id) and k - 1 (b_id); see the oracles for the variants by k."""
    i, k = F.col("doc_id"), F.col("doc_id") % 250
    text = lambda c: c.cast("string")
    linked = (k % 11 == 0) & (k >= 2)
    a = F.concat(
        F.lit(", a_id bigint"), F.when(k % 3 == 0, " NOT NULL").otherwise(""), F.lit(" REFERENCES "),
        F.when(k % 7 == 0, F.concat(F.lit("missing"), text(k))).otherwise(F.concat(F.lit('"t'), text(F.floor(k / 2)), F.lit('"'))), F.lit("(ID)"))
    b = F.concat(F.lit(", `b_id` bigint"), F.when(k % 5 == 0, " UNIQUE").otherwise(""), F.lit(", CONSTRAINT fk_b FOREIGN KEY (B_ID) REFERENCES public.T"), text(k - 1), F.lit(" ON DELETE SET NULL"))
    key = F.when(linked, ", PRIMARY KEY (a_id, b_id)").otherwise("")
    head = F.concat(F.lit("CREATE TABLE IF NOT EXISTS t"), text(k), F.lit(" (id bigint"), F.when(linked, "").otherwise(" PRIMARY KEY"), F.lit(", name text NOT NULL DEFAULT 'a, (b'"))
    body = F.concat(head, F.when(k > 0, F.concat(a, b, key)).otherwise(""))
    again = F.when(k % 13 == 0, F.array(F.struct(F.lit(1).alias("n"), F.concat(body, F.lit(", extra decimal(10, 2))")).alias("sql"))))
    once = F.array(F.struct(F.lit(0).alias("n"), F.concat(body, F.lit(")")).alias("sql")))
    rows = _spread(documents.select("doc_id"), "doc_id").select(F.concat(F.lit("p"), text(F.floor(i / 250))).alias("project"), k.alias("k"), F.explode(F.concat(once, F.coalesce(again, F.array().cast("array<struct<n:int,sql:string>>")))).alias("s"))
    return rows.select(
        "project", F.concat(F.lit("f"), text(F.col("k") % 4 + F.col("s.n"))).alias("file"), _zero().alias("file_idx"), _zero().alias("entry_idx"),
        (F.col("k") * 2 + F.col("s.n")).cast("long").alias("stmt_idx"), F.lit("create_table").alias("kind"), F.col("s.sql").alias("sql"))


#: Bytes of INSERTs that one row of dumps() holds, about.
PART_BYTES = 1 << 20


def dumps(documents: DataFrame) -> DataFrame:
    """One dump file a source: a table, an INSERT a document that quotes its text and a fake CREATE, a COPY block.

    Files of more than PART_BYTES come as parts, dealt by doc_id, which are one entry together: each starts between
    two INSERTs or two COPY lines, and `start` says what the parts before it leave open (see Script)."""
    literal = F.concat(F.lit("INSERT INTO docs VALUES ("), F.col("doc_id").cast("string"), F.lit(", '"), F.regexp_replace(F.coalesce("text", F.lit("")), "'", "''"),
                       F.lit("; CREATE TABLE fake (x int); -- /* $a$');\n"))
    docs = documents.select(F.coalesce("source", F.lit("none")).alias("file"), "doc_id", "text")
    head = F.lit("SET standard_conforming_strings = on;\n-- a dump; CREATE TABLE fake (x int);\nCREATE TABLE docs (id bigint PRIMARY KEY, /* ; */ body text);\n")
    copy, tail = F.lit("COPY docs (id) FROM stdin;\n"), F.lit("\n\\.\nALTER TABLE docs ADD COLUMN n int;")

    size = F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 80)
    n_parts = F.ceil(size / PART_BYTES).cast("int")
    sizes = written(docs.groupBy("file").agg(n_parts.alias("n_parts"), F.min("doc_id").alias("first_id")))
    few = sizes.count() <= 200_000  # a row a source; beyond that the join is a shuffle join
    docs = docs.join(F.broadcast(sizes) if few else sizes, "file").withColumn("part", F.pmod(F.xxhash64("doc_id"), F.col("n_parts")).cast("int"))
    ordered = lambda c: F.array_sort(F.collect_list(c))
    lines = F.array_join(F.transform(ordered(F.struct("doc_id", literal.alias("line"))), lambda s: s["line"]), "")
    parts = docs.groupBy("file", "n_parts", "part").agg(
        lines.alias("lines"), F.array_join(ordered(F.col("doc_id").cast("string")), "\t;'\n").alias("ids"), F.min("doc_id").alias("least"), F.first("first_id").alias("first_id"))
    one = lambda idx, start, text: F.struct(idx.cast("long").alias("entry_idx"), F.lit(start).cast("string").alias("start"), text.alias("text"))
    n, k = F.col("n_parts"), F.col("part")
    # The ids of all parts but the first id's begin with the end of the line before them.
    ids = F.when(F.col("least") == F.col("first_id"), F.col("ids")).when(F.col("least").isNotNull(), F.concat(F.lit("\t;'\n"), F.col("ids"))).otherwise("")
    whole = F.array(one(F.lit(0), None, F.concat(head, F.col("lines"), copy, F.col("ids"), tail)))
    cut = F.array(one(k + 1, "literal", F.col("lines")), one(n + 2 + k, "copy", ids))
    rows = parts.select("file", F.explode(F.when(n == 1, whole).otherwise(cut)).alias("e"))
    ends = sizes.where("n_parts > 1").select("file", F.explode(F.array(one(F.lit(0), None, head), one(n + 1, "literal", copy), one(2 * n + 2, "copy", tail))).alias("e"))
    return rows.unionByName(ends).select(F.lit("dump").alias("project"), "file", _zero().alias("file_idx"), "e.entry_idx", "e.text", F.lit("utf-8").alias("encoding"),
                                         F.octet_length("e.text").cast("long").alias("text_bytes"), "e.start")


def migrations(events: DataFrame) -> DataFrame:
    """A table u{user_id} for each user and one ALTER an event, by time: ADD a column named by the event type if
    event_id mod 3 is 0, MODIFY it (NOT NULL if event_id is even) if 1, COMMENT ON it if 2."""
    user, at = F.col("user_id").cast("string"), F.unix_micros(F.col("ts").cast("timestamp"))
    name = F.concat(F.lit("c_"), "event_type")
    table = F.concat(F.lit("u"), user)
    add = F.concat(F.lit("ALTER TABLE "), table, F.lit(" ADD COLUMN "), name, F.lit(" int"))
    modify = F.concat(F.lit("ALTER TABLE "), table, F.lit(" MODIFY "), name, F.lit(" bigint"), F.when(F.col("event_id") % 2 == 0, " NOT NULL").otherwise(""))
    comment = F.concat(F.lit("COMMENT ON COLUMN "), table, F.lit("."), name, F.lit(" IS 'event "), F.col("event_id").cast("string"), F.lit("'"))
    turn = F.col("event_id") % 3
    project = F.concat(F.lit("m"), (F.col("user_id") % 8).cast("string"))
    alter = _spread(events.select("event_id", "user_id", "event_type", "ts"), "event_id").select(
        project.alias("project"), F.lit("events").alias("file"), F.floor(at / 1_000_000).alias("file_idx"), (at % 1_000_000).alias("entry_idx"), F.col("event_id").cast("long").alias("stmt_idx"),
        F.when(turn == 2, "comment_on").otherwise("alter_table").alias("kind"), F.when(turn == 0, add).when(turn == 1, modify).otherwise(comment).alias("sql"))
    create = events.select("user_id").distinct().select(
        project.alias("project"), F.lit("users").alias("file"), _zero().alias("file_idx"), _zero().alias("entry_idx"), F.col("user_id").cast("long").alias("stmt_idx"), F.lit("create_table").alias("kind"),
        F.concat(F.lit("CREATE TABLE u"), user, F.lit(" (id int PRIMARY KEY)")).alias("sql"))
    return create.unionByName(alter)


#: What archives() packs a document's script in, by doc_id mod 8: file name, and layers as expand_entries() names them.
PACKED = ("d.sql", "d.sql.gz", "d.sql.bz2", "d.sql.xz", "d.zip", "d.tgz", "d.bin.sql", "d.7z")


def _packed(batches):
    """doc_id, script -> content, packed by doc_id mod 8."""
    for b in batches:
        ids, out = b.column("doc_id").to_pylist(), []
        for i, script in zip(ids, b.column("script").to_pylist()):
            raw, kind = script.encode(), i % len(PACKED)
            if kind == 4:
                made = io.BytesIO()
                with zipfile.ZipFile(made, "w", zipfile.ZIP_DEFLATED) as z:
                    z.writestr("in/a.sql.gz", gzip.compress(raw, mtime=0))
                    z.writestr("in/b.sql", raw)
                    z.writestr("README.md", "no SQL")
                raw = made.getvalue()
            elif kind == 5:
                made = io.BytesIO()
                with tarfile.open(fileobj=made, mode="w:gz") as t:
                    info = tarfile.TarInfo("in/a.sql")
                    info.size = len(raw)
                    t.addfile(info, io.BytesIO(raw))
                raw = made.getvalue()
            out.append({0: lambda: raw, 1: lambda: gzip.compress(raw, mtime=0), 2: lambda: bz2.compress(raw), 3: lambda: lzma.compress(raw)}.get(
                kind, lambda: b"\0" + raw if kind == 6 else b"7z\xbc\xaf\x27\x1c" + raw if kind == 7 else raw)())
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("script"), pa.array(out, pa.binary())], ["doc_id", "script", "content"])


def archives(documents: DataFrame) -> DataFrame:
    """One input file a document, as read_sql_files() has them: a script with an INSERT of its text and a CREATE, packed
    in one of eight ways. 64 files are a project."""
    literal = F.regexp_replace(F.coalesce("text", F.lit("")), "'", "''")
    i = F.col("doc_id")
    script = F.concat(F.lit("SET standard_conforming_strings = on;\nINSERT INTO d VALUES ('"), literal, F.lit("');\nCREATE TABLE t"), i.cast("string"), F.lit(" (x int);\n"))
    files = documents.where("doc_id is not null").select(i, script.alias("script")).mapInArrow(_packed, "doc_id long, script string, content binary")
    name = F.element_at(F.array(*map(F.lit, PACKED)), (i % len(PACKED) + 1).cast("int"))
    return files.select(
        F.concat(F.lit("a"), F.floor(i / 64).cast("string")).alias("project"), F.concat(i.cast("string"), F.lit("."), name).alias("file"), (i % 64).alias("file_idx"),
        F.octet_length("content").cast("long").alias("length"), F.timestamp_seconds(i).alias("modificationTime"), "content")


def oddities(documents: DataFrame) -> DataFrame:
    """Four to six statements a document, 50 documents a project: two tables of one bare name in two schemas, by k = doc_id
    mod 50 a redefinition of the second (k mod 4 is 0), a reference to the bare name, an ALTER of an unknown table (k
    mod 3 is 0), a unique index on the reference's column (k mod 5 is 0; it names the table after ONLY), a comment that is
    taken back by NULL, which does nothing."""
    i, k = F.col("doc_id"), F.col("doc_id") % 50
    n = k.cast("string")
    say = lambda kind, *parts: F.struct(F.lit(kind).alias("kind"), F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts]).alias("sql"))
    every = [
        say("create_table", "CREATE TABLE a.n", n, " (id int PRIMARY KEY)"), say("create_table", "CREATE TABLE b.n", n, " (id int PRIMARY KEY)"),
        F.when(k % 4 == 0, say("create_table", "CREATE TABLE b.n", n, " (id int PRIMARY KEY, more int)")),
        say("create_table", "CREATE TABLE r", n, " (x int REFERENCES N", n, ")"),
        F.when(k % 3 == 0, say("alter_table", "ALTER TABLE lost", n, " ADD y int")),
        F.when(k % 5 == 0, say("create_unique", "CREATE UNIQUE INDEX i ON ONLY public.r", n, " (X)")),
        say("comment_on", "COMMENT ON TABLE r", n, " IS 'said ", n, "'"), say("comment_on", "COMMENT ON TABLE r", n, " IS NULL")]
    rows = documents.where("doc_id is not null").select(i, k.alias("k"), F.posexplode(F.array(*every)).alias("at", "s")).where("s is not null")
    return rows.select(
        F.concat(F.lit("o"), F.floor(i / 50).cast("string")).alias("project"), F.lit("odd.sql").alias("file"), _zero().alias("file_idx"), _zero().alias("entry_idx"),
        (F.col("k") * 10 + F.col("at")).alias("stmt_idx"), "s.kind", "s.sql")
