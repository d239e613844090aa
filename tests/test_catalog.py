import bz2
import gzip
import io
import lzma
import tarfile
import zipfile

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from schemaloom.operators import checks, render, reports
from schemaloom.plans import assemble
from schemaloom.sources import ddl, files
from schemaloom.sources.statements import Script, classify_statement, read_statements, retained_ddl, split_statements

LIBRARY = """
CREATE TABLE members (id BIGSERIAL PRIMARY KEY, card VARCHAR(20) NOT NULL UNIQUE, joined TIMESTAMP WITH TIME ZONE NOT NULL DEFAULT now());
COMMENT ON TABLE members IS 'Readers; who borrow';
CREATE TABLE badges (member_id BIGINT PRIMARY KEY REFERENCES members(id) ON DELETE CASCADE, photo TEXT);
CREATE TABLE shelves (id SERIAL PRIMARY KEY, inside INT REFERENCES shelves(id), label TEXT NOT NULL UNIQUE);
CREATE TABLE books (id BIGSERIAL PRIMARY KEY, isbn TEXT NOT NULL, worth NUMERIC(10, 2) NOT NULL);
CREATE TABLE shelved (book_id BIGINT NOT NULL REFERENCES books, shelf_id INT NOT NULL REFERENCES shelves, PRIMARY KEY (book_id, shelf_id));
CREATE TABLE deposits (id BIGSERIAL PRIMARY KEY, member_id BIGINT NOT NULL UNIQUE);
CREATE UNIQUE INDEX isbn_once ON ONLY books (isbn);
ALTER TABLE deposits ADD CONSTRAINT fk_dep FOREIGN KEY (member_id) REFERENCES members (id), ADD COLUMN note text COMMENT 'it''s';
COMMENT ON TABLE members IS NULL;
ALTER TABLE gone ADD COLUMN x int;
"""


def entries(spark, *texts):
    rows = [("p", f"f{i}.sql", i, 0, t) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "project string, file string, file_idx int, entry_idx int, text string")


def build(spark, *texts):
    return assemble.build(split_statements(entries(spark, *texts)))


def rows(df, *cols):
    return sorted(map(tuple, df.select(*cols).collect()), key=repr)


def test_library(spark):
    c = build(spark, LIBRARY)
    got = {r.rel_id: r for r in c.relationships.collect()}
    assert set(got) == {"badges(member_id)->members", "shelves(inside)->shelves", "shelved(book_id)->books", "shelved(shelf_id)->shelves", "deposits(member_id)->members"}
    one = got["badges(member_id)->members"]
    assert (one.cardinality, one.optional, one.identifying, one.on_delete) == ("one-to-one", False, True, "CASCADE")
    dep = got["deposits(member_id)->members"]
    assert (dep.cardinality, dep.identifying, dep.name) == ("one-to-one", False, "fk_dep")
    assert got["shelves(inside)->shelves"].optional
    assert rows(c.many_to_many, "via", "a", "b") == [("shelved", "books", "shelves")]
    assert rows(c.warnings, "message") == [('ALTER TABLE on unknown table "gone" was ignored.',)]
    cols = {(r.table_id, r.name): r for r in c.columns.collect()}
    assert cols["books", "worth"].type == "NUMERIC(10, 2)" and cols["books", "isbn"].unique
    assert cols["members", "joined"].type == "TIMESTAMP WITH TIME ZONE" and cols["members", "joined"].default_value == "now()"
    assert cols["members", "id"].auto_increment and not cols["members", "id"].nullable
    assert cols["deposits", "note"].comment == "it's"
    assert {r.table_id: r.comment for r in c.tables.collect()}["members"] == "Readers; who borrow"
    roles = dict(rows(reports.connectivity(c.tables, c.relationships), "table_id", "role"))
    assert roles["shelved"] == "Link table" and roles["members"] == "Root / lookup" and roles["badges"] == "Leaf"
    er = render.document(c, "er").first().text
    assert er.startswith("erDiagram\n  members {\n    BIGSERIAL id PK\n") and '  badges |o--|| members : "member_id"' in er
    assert "## books\n\n_Source: f0.sql_\n\n| Column |" in render.document(c, "dictionary").first().text


def test_order_of_files_does_not_matter_and_ddl_reads_back(spark):
    parts = ["ALTER TABLE b ADD FOREIGN KEY (a_id) REFERENCES a (id);", "CREATE TABLE a (id int PRIMARY KEY);", "CREATE TABLE b (id int, a_id int);INSERT INTO b VALUES (1, ';');"]
    want = rows(build(spark, *parts).relationships, "rel_id", "optional")
    assert want == [("b(a_id)->a", True)]
    for turn in (parts[::-1], parts[1:] + parts[:1]):
        assert rows(build(spark, *turn).relationships, "rel_id", "optional") == want
    text = [r.ddl for r in retained_ddl(split_statements(entries(spark, *parts))).collect()]
    assert rows(build(spark, *text).relationships, "rel_id", "optional") == want


def test_duplicate_definitions(spark):
    c = build(spark, "CREATE TABLE users (a int, b int);", "CREATE TABLE public.users (a int, b int, c int);")
    assert rows(c.tables, "table_id", "n_columns") == [("users", 3)]
    assert rows(c.warnings, "message") == [('Table "users" is defined more than once (f0.sql and f1.sql); the last definition is used.',)]


def test_renames_and_references(spark):
    c = build(spark, "CREATE TABLE t (a int, b int NOT NULL); ALTER TABLE t CHANGE a z bigint NOT NULL, MODIFY b text; ALTER TABLE t ALTER COLUMN b SET DEFAULT 'q';"
                     "CREATE TABLE p (x int, y int, PRIMARY KEY (x, y)); CREATE TABLE ch (m int, n int, FOREIGN KEY (M, N) REFERENCES P, FOREIGN KEY (m, n) REFERENCES p);")
    assert rows(c.columns.where("table_id = 't'"), "name", "type", "nullable", "default_value") == [("b", "text", True, "'q'"), ("z", "bigint", False, None)]
    assert rows(c.relationships, "rel_id", "to_columns") == [("ch(m,n)->p", ["x", "y"])]


@pytest.mark.parametrize("text, kept, total, inserts, copies", [
    ("", 0, 0, 0, 0), (";;;", 0, 3, 0, 0), ("-- only\n/* c */", 0, 0, 0, 0), ("CREATE TABLE a (x int)", 1, 1, 0, 0),
    ("INSERT INTO a VALUES ('it''s; \\'x');CREATE TABLE b (y int);", 1, 2, 1, 0),
    ("SET standard_conforming_strings = on;INSERT INTO a VALUES ('c:\\');CREATE TABLE b (y int);", 1, 3, 1, 0),
    ("SET standard_conforming_strings = on;INSERT INTO a VALUES (E'c\\';');CREATE TABLE b (y int);", 1, 3, 1, 0),
    ("COPY t FROM stdin;\n1\t;'\n\\.\nCREATE TABLE b (y int);", 1, 2, 0, 1),
    ("CREATE FUNCTION f() AS $x$ CREATE TABLE no (a int); $x$;CREATE TABLE b (y int);", 1, 2, 0, 0),
    ("DELIMITER //\nCREATE TRIGGER t BEGIN x; END//\nDELIMITER ;\nCREATE TABLE b (y int);", 1, 2, 0, 0),
    ("CREATE TABLE [a;b] (x int)\nGO\nCREATE TABLE c (y int)\nGO\n", 2, 2, 0, 0),
    ("CREATE TABLE a (x int -- ; no\n, y int) # tail; more\n;", 1, 2, 0, 0), ("# c;\nCREATE TABLE a (x int);", 1, 1, 0, 0),
    ("CREATE TABLE a (x text DEFAULT 'open; CREATE TABLE b (y int);", 1, 1, 0, 0),
])
def test_splitting(text, kept, total, inserts, copies):
    s = Script(text)
    assert (len(s.kept), s.total, s.inserts, s.copies) == (kept, total, inserts, copies)


def test_splitting_is_linear():
    assert Script("INSERT INTO t VALUES ('" + "x" * 5_000_000 + "');" + "INSERT INTO t VALUES ('a');" * 50_000).inserts == 50_001


def test_partitions_do_not_matter(spark):
    e = entries(spark, LIBRARY, "CREATE TABLE x (y int);" * 3, "")
    want = rows(split_statements(e), "file", "stmt_idx", "sql")
    for n in (1, 2, 7):
        assert rows(split_statements(e.repartition(n)), "file", "stmt_idx", "sql") == want


def test_ddl_helpers():
    cut = lambda s: [" ".join(t.text for t in item) for item in ddl.tokens(s)]
    assert cut("a, (b, c), 'd, e', \"f,g\"") == ["a", "(b, c)", "'d, e'", '"f,g"']
    assert ddl.ident_parts('[dbo]."x""y".`z`') == ["dbo", 'x"y', "z"]
    assert [e["event"] for e in ddl.events_of("CREATE TABLE a AS SELECT 1", "create_table")] == ["warning"]
    assert ddl.events_of("CREATE TABLE a (n text DEFAULT 'n/a'::text, m [int] IDENTITY(1,1))", "create_table")[1]["default_value"] == "'n/a'::text"


def test_diagram_ids_collide(spark):
    c = build(spark, 'CREATE TABLE "a b" (x int); CREATE TABLE "a.b" (x int); CREATE TABLE a_b_ (x int); CREATE TABLE z (x int);')
    ids = {r.key: r.diagram_id for r in render.diagram_ids(c.tables).collect()}
    assert len({v.lower() for v in ids.values()}) == 4 and ids["a b"] == "a_b" and ids["z"] == "z"


def test_containers(spark, tmp_path):
    sql = b"CREATE TABLE a (x int);"
    z = io.BytesIO()
    with zipfile.ZipFile(z, "w") as f:
        f.writestr("in/schema.sql.gz", gzip.compress(sql))
        f.writestr("README.md", b"no")
    t = io.BytesIO()
    with tarfile.open(fileobj=t, mode="w:gz") as f:
        info = tarfile.TarInfo("d/x.sql")
        info.size = len(sql)
        f.addfile(info, io.BytesIO(sql))
    (tmp_path / "p").mkdir()
    for name, raw in (("a.zip", z.getvalue()), ("b.tgz", t.getvalue()), ("c.sql", "\ufeffCREATE TABLE é (x int);".encode("utf-16")), ("d.7z", b"7z\xbc\xaf\x27\x1c00"),
                      ("e.sql", b"\0\1\2"), ("f.sql.gz", gzip.compress(sql)[:-9])):
        (tmp_path / "p" / name).write_bytes(raw)
    found = files.readable_entries(files.expand_entries(files.read_sql_files(spark, f"{tmp_path}/p"))).cache()
    got = {r.name: (r.layers, r.text, r.note) for r in found.collect()}
    assert got["a.zip/in/schema.sql.gz"] == (["zip", "gzip"], sql.decode(), None) and got["a.zip/README.md"][2] == "not an SQL file"
    assert got["b.tgz/d/x.sql"][0] == ["gzip", "tar"] and got["c.sql"][1].endswith("TABLE é (x int);")
    assert "7-Zip" in got["d.7z"][2] and got["e.sql"][2] == "it is not a text file" and got["f.sql.gz"][2].startswith("stopped")
    assert {r.file for r in files.skipped_files(found).where("skipped").collect()} == {"d.7z", "e.sql", "f.sql.gz"}


def test_streaming_rebuild(spark, tmp_path):
    from schemaloom.streaming.ingest import read_catalog, stream_sql_files

    (tmp_path / "in" / "p").mkdir(parents=True)
    args = (f"{tmp_path}/in/p", f"{tmp_path}/store", f"{tmp_path}/out", f"{tmp_path}/ck")
    steps = [
        ("2.sql", "ALTER TABLE b ADD FOREIGN KEY (x) REFERENCES a (x); CREATE TABLE b (x int);", 0, [("b", "x")]),
        ("3.sql", "CREATE TABLE a (x int PRIMARY KEY);", 1, [("a", "x"), ("b", "x")]),
        ("1.sql", "CREATE TABLE b (x int, gone int);", 1, [("a", "x"), ("b", "x")])]  # 2.sql defines b after it, though it came first
    for name, text, n_links, columns in steps:
        (tmp_path / "in" / "p" / name).write_text(text)
        stream_sql_files(spark, *args).awaitTermination()
        c = read_catalog(spark, args[2])
        said = [r.message for r in c.warnings.collect()]
        assert c.relationships.count() == n_links and rows(c.columns, "table_id", "name") == columns
        assert any("unknown table" in m for m in said) == (n_links == 0), "what was wrong before is not said again"
    assert [r.rel_id for r in c.relationships.collect()] == ["b(x)->a"] and any("1.sql and 2.sql" in m for m in said)


def test_checks(spark):
    child = spark.createDataFrame([(1, 1), (2, 1), (3, None), (3, 9)], "id int, fk int")
    parent = spark.createDataFrame([(1,), (2,)], "id int")
    assert rows(checks.key_violations(child, ["id"]), "id", "n_rows") == [(3, 2)]
    assert rows(checks.orphans(child, ["fk"], parent, ["id"]), "fk") == [(9,)]
    assert rows(checks.observed_cardinality(child, ["fk"]), "max_children", "null_rows", "cardinality", "optional") == [(2, 1, "many-to-one", True)]


def test_verified_catalogs(spark):
    child = spark.createDataFrame([(1, 1, 1), (2, 1, 2), (3, None, 3), (3, 9, 3)], "id int, fk int, own int")
    parent = spark.createDataFrame([(1,), (2,)], "id bigint")
    assert checks.verify_catalog(spark, [], {}).count() == 0
    declared = [dict(rel_id=f"c({f})->p", from_table="c", from_columns=[f], to_table="p", to_columns=["id"], cardinality="many-to-one", optional=False) for f in ("fk", "own")]
    got = checks.verify_catalog(spark, [*declared, {**declared[0], "to_table": "elsewhere"}], {"c": child, "p": parent})
    assert rows(got, "relationship", "observed", "observed_optional", "max_children", "null_rows", "n_orphans") == [
        ("c(fk)->p", "many-to-one", True, 2, 1, 1), ("c(own)->p", "many-to-one", False, 2, 0, 2)]
    assert checks.verify_catalog(spark, declared, {"c": child.limit(0), "p": parent}).count() == 2


def test_bare_names(spark):
    """Without its schema a name means the first table that has it, or the latest redefinition."""
    fk = "CREATE TABLE r (x int REFERENCES t (id));"
    first = build(spark, "CREATE TABLE a.t (id int); CREATE TABLE b.t (id int);" + fk)
    assert rows(first.relationships, "to_table") == [("a.t",)]
    again = build(spark, "CREATE TABLE a.t (id int); CREATE TABLE b.t (id int); CREATE TABLE b.t (id int, z int);" + fk)
    assert rows(again.relationships, "to_table") == [("b.t",)]
    own = build(spark, "CREATE TABLE a.t (id int); CREATE TABLE public.t (id int); CREATE TABLE a.t (id int);" + fk)
    assert rows(own.relationships, "to_table") == [("t",)]


def test_details_of_a_table(spark):
    c = build(spark, LIBRARY)
    got = reports.table_details(c, "SHELVES")
    assert rows(got["columns"], "name") == [("id",), ("inside",), ("label",)]
    assert rows(got["outgoing"], "rel_id") == [("shelves(inside)->shelves",)] and rows(got["incoming"], "rel_id") == [("shelved(shelf_id)->shelves",)]
    assert rows(reports.find_table(c.tables, "Shelves"), "table_id") == [("shelves",)] and reports.related_edges(c.relationships, "shelves").count() == 2
    assert rows(reports.isolated_count(c.tables, c.relationships), "isolated") == [(0,)]


def test_imports_are_reported(spark, tmp_path):
    z = io.BytesIO()
    with zipfile.ZipFile(z, "w") as f:
        f.writestr("a.sql", "CREATE TABLE a (x int);INSERT INTO a VALUES (1);")
        f.writestr("b.bin.sql", b"\0\1\2")
    for project, made in (("p", {"1.zip": z.getvalue(), "2.sql": b"\0\1", "3.7z": b"7z\xbc\xaf\x27\x1c00", "4.sql": b"BZh is no archive; CREATE TABLE q (x int);"}), ("q", {"x.sql": b"\0"})):
        (tmp_path / "in" / project).mkdir(parents=True)
        for name, raw in made.items():
            (tmp_path / "in" / project / name).write_bytes(raw)
    found = files.read_sql_files(spark, [f"{tmp_path}/in/p", f"{tmp_path}/in/q"]).cache()
    e = files.readable_entries(files.expand_entries(found)).cache()
    skipped = files.skipped_files(e).cache()
    assert rows(skipped.where("skipped"), "file", "file_idx") == [("2.sql", 1), ("3.7z", 2), ("x.sql", 0)]
    assert rows(files.all_skipped(found, skipped), "project", "all_skipped") == [("p", False), ("q", True)]
    assert rows(reports.first_skipped(skipped, 1), "file") == [("2.sql",), ("x.sql",)]
    from schemaloom.sources.statements import scan_stats

    read = {r.file: r for r in reports.import_reports(found, e, scan_stats(e.where("text is not null"))).collect()}
    assert (read["1.zip"].format_label, read["1.zip"].tables, read["1.zip"].inserts, read["1.zip"].entries) == ("zip · 1 .sql", 1, 1, 1)
    assert (read["2.sql"].skipped, read["2.sql"].entries, read["4.sql"].entries, read["4.sql"].format_label, read["4.sql"].skipped) == ("it is not a text file", 0, 1, None, None)
    c = assemble.build(split_statements(e.where("text is not null")), files.import_notes(e))
    said = [r.message for r in c.warnings.where("project = 'p'").orderBy("rank", "at").collect()]
    assert said[:2] == ['Skipped "1.zip/b.bin.sql": it is not a text file.', 'Skipped "2.sql": it is not a text file.'] and said[2].startswith('Skipped "3.7z": 7-Zip')
    kept = retained_ddl(split_statements(e.where("text is not null")))
    assert rows(files.persistable(e, kept), "project") == [("p",), ("q",)] and rows(files.persistable(e, kept, 5), "project") == [("q",)]
    assert rows(files.sensitive_flag(e), "sensitive") == [(False,), (False,)]
    known = found.where("file <> '4.sql'")
    assert rows(files.new_files(found, known), "file") == [("4.sql",)]
    text = files.read_plain_dumps(spark, f"{tmp_path}/in/p/4.sql")
    assert rows(split_statements(text), "file", "kind") == [("4.sql", "create_table")]


def test_statements_are_replaced_and_removed(spark):
    s = split_statements(entries(spark, "CREATE TABLE a (x int);", "CREATE TABLE b (x int);"))
    assert rows(files.remove_file(s, "p", "f0.sql"), "file") == [("f1.sql",)]
    other = split_statements(entries(spark, "CREATE TABLE c (x int);").withColumn("file", F.lit("new.sql")))
    assert rows(files.replace_files(s, other), "file") == [("new.sql",)] and files.replace_files(s, other.withColumn("project", F.lit("q"))).count() == 3


def test_catalogs_are_written(spark, tmp_path):
    c = build(spark, LIBRARY)
    files.write_catalog(c, f"{tmp_path}/out")
    assert spark.read.parquet(f"{tmp_path}/out/relationships").count() == 5
    for kind in render.DOCUMENTS:
        render.write_document(c, kind, f"{tmp_path}/{kind}")
        assert "\n".join(r.value for r in spark.read.text(f"{tmp_path}/{kind}/project=p", wholetext=True).collect()).rstrip("\n") == render.document(c, kind).first().text.rstrip("\n")


def test_scalar_helpers(spark):
    from schemaloom.functions import columns as f

    row = lambda c: spark.range(1).select(c).first()[0]
    assert [row(f.format_bytes(F.lit(n))) for n in (12, 2048, 50 * 1024, 3 * 1024**3)] == ["12 B", "2.0 KB", "50 KB", "3.0 GB"]
    assert row(f.layers_label(F.array(F.lit("gzip"), F.lit("tar"), F.lit("gzip")))) == "gzip → tar"
    assert row(f.unquote_string(F.lit("'it''s \\\\ x'"))) == "it's \\ x" and row(f.normalise_type(F.lit("[int]  unsigned"))) == "int unsigned"
    assert row(f.is_auto_increment(F.lit("bigserial"), F.lit(None).cast("string"))) and not row(f.is_auto_increment(F.lit("int"), F.lit("1")))
    assert [row(files.wanted_entry(F.lit(n))) for n in ("a/b.sql", "b.SQL.gz", "x.tgz", ".a.sql", "__MACOSX/a.sql", "a.txt")] == [True, True, True, False, False, False]
    assert [row(files.detect_format(F.lit(b))) for b in (b"BZh9", b"BZh is", b"\x1f\x8b", b"PK\3\4", b"x" * 257 + b"ustar")] == ["bzip2", "text", "gzip", "zip", "tar"]


def test_classify(spark):
    df = read_statements(spark.createDataFrame([("create  table x (a int)", "s"), ("select 1", "s"), ("ALTER TABLE x ADD y int", "s")], "sql string, source string"))
    assert rows(df, "kind") == [("alter_table",), ("create_table",)]
    assert spark.range(1).select(classify_statement(F.lit("REPLACE INTO x"))).first()[0] == "data"


def test_columns_fold_as_events_in_order(spark, monkeypatch):
    import random

    r = random.Random(4)
    name = lambda: r.choice(["a", "A", "b", "c", "D"])
    alter = lambda t: r.choice([
        f"ALTER TABLE {t} ADD COLUMN {name()} int{r.choice(['', ' UNIQUE', ' DEFAULT 4'])}", f"ALTER TABLE {t} MODIFY {name()} bigint{r.choice(['', ' NOT NULL', ' AUTO_INCREMENT', ' PRIMARY KEY'])}",
        f"ALTER TABLE {t} ALTER COLUMN {name()} {r.choice(['SET NOT NULL', 'DROP NOT NULL', 'TYPE text', 'SET DEFAULT 7', 'ADD GENERATED ALWAYS AS IDENTITY'])}",
        f"COMMENT ON COLUMN {t}.{name()} IS 'n{r.randint(0, 9)}'"])
    texts = [";\n".join([f"CREATE TABLE t{i} (id int, b text COMMENT 'x')", *[alter(f"t{i}") for _ in range(r.randint(0, 12))]]) + ";" for i in range(60)]
    events = ddl.extract_ddl(split_statements(entries(spark, *texts))).withColumn("key", assemble.table_key(F.col("parts"))).withColumn("ord", F.struct(*assemble.STATEMENT)).cache()
    mine = events.where(F.col("event").isin("column", "add", "modify", "set", "comment_column")).toPandas()
    mine = mine.astype(object).where(mine.notna(), None)
    want = [tuple(x) for _, g in mine.groupby("key") for x in assemble._fold(g).astype(object).itertuples(index=False)]

    def refused(pdf):
        raise AssertionError("one group in memory")

    with monkeypatch.context() as m:
        m.setattr(assemble, "_fold", refused)
        got = rows(assemble.fold_columns(events), *[c.split()[0] for c in assemble.COLUMN.split(", ")])
    clean = lambda x: tuple(None if v is None or v != v else v for v in x)
    assert got == sorted(map(clean, want), key=repr) and len(got) > 150
    changed = build(spark, "CREATE TABLE t (a int, b int); ALTER TABLE t CHANGE a z text; ALTER TABLE t MODIFY z bigint; CREATE TABLE d (x int, X text);")
    assert rows(changed.columns, "key", "name", "type", "pos") == sorted([("t", "z", "bigint", 0), ("t", "b", "int", 1), ("d", "x", "int", 0), ("d", "X", "text", 1)], key=repr)


@pytest.mark.parametrize("name", ["dump_file_reports", "dump_retained_ddl"])
def test_dumps_come_in_bounded_parts(spark, tmp_path, monkeypatch, name):
    import duckdb

    from schemaloom.plans import corpora, oracles, queries

    monkeypatch.setattr(corpora, "PART_BYTES", 5000)
    texts = ["it's a \\", "'", "x\n\\.\n", None, "é " * 30, "\\' -- /*", "$a$ ; CREATE TABLE no (x int);"]
    made = [(i, texts[i % 7], "hot" if i % 3 else f"s{i % 5}" if i % 2 else None) for i in range(900)]
    docs = spark.createDataFrame(made, "doc_id long, text string, source string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    entries = corpora.dumps(docs).cache()
    assert entries.agg(F.max("text_bytes")).first()[0] < 12_000 and entries.where("file = 'hot'").count() > 10
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    got = queries.QUERIES[name](spark, str(tmp_path))
    assert rows(got, *got.columns) == sorted(con.execute(f"SELECT {', '.join(got.columns)} FROM ({oracles.ORACLES[name]})").fetchall(), key=repr)


def test_long_entries_come_in_parts(spark, monkeypatch):
    monkeypatch.setattr(files, "PART", 40)
    sql = (LIBRARY + "COPY t FROM stdin;\n" + "1\t;'é\n" * 60 + "\\.\nSET standard_conforming_strings = on;\nINSERT INTO t VALUES ('c:\\');\n" * 3 + "CREATE TABLE last (x int)")
    sql = sql.replace("\\.\nSET", "\\.\n-- ; '\nSET", 1)
    t = io.BytesIO()
    with tarfile.open(fileobj=t, mode="w") as f:
        info = tarfile.TarInfo("x.sql")
        info.size = len(sql.encode())
        f.addfile(info, io.BytesIO(sql.encode()))
    z = io.BytesIO()
    with zipfile.ZipFile(z, "w") as f:
        f.writestr("x.sql", sql.encode())
    made = {"a.gz": gzip.compress(sql.encode()), "b.bz2": bz2.compress(("\ufeff" + sql).encode("utf-16le")), "c.xz": lzma.compress(sql.encode()), "d.tar": t.getvalue(), "e.zip": z.getvalue(),
            "f.zst": pa.compress(sql.encode(), codec="zstd", asbytes=True)}
    want = Script(sql)
    for name, raw in made.items():
        found = list(files.entries_of(name, raw))
        assert len(found) > 20 and found[0][5] is None and all(e[5] for e in found[1:])
        scripts = [Script(e[2].decode(), e[5]) for e in found]
        for what in ("total", "inserts", "copies", "chars"):
            assert sum(getattr(s, what) for s in scripts) == getattr(want, what), (name, what)
        assert [k for s in scripts for k in s.kept] == want.kept


def test_entries_cut_at_the_limit_say_so(spark, monkeypatch):
    monkeypatch.setattr(files, "PART", 20)
    monkeypatch.setattr(files, "MAX_ENTRY", 30)
    sql, long = b"CREATE TABLE a (x int);\n" * 4, b"CREATE TABLE a (number integer, other integer, more integer, last integer);"
    made = [("1.gz", gzip.compress(sql)), ("2.gz", gzip.compress(sql + long)), ("3.gz", gzip.compress(gzip.compress(b"".join(b"%d;" % (i * i) for i in range(99)))))]
    out = [("p", name, k, i, *e) for k, (name, raw) in enumerate(made) for i, e in enumerate(files.entries_of(name, raw))]
    assert {(o[1], o[8]) for o in out if o[8]} >= {("2.gz", files.TOO_LONG), ("3.gz", files.TOO_LONG)} and not any(o[8] for o in out if o[1] == "1.gz")
    found = files.readable_entries(spark.createDataFrame([(*o[:5], list(o[5]), *o[6:]) for o in out], files.ENTRY))
    assert rows(files.skipped_files(found), "file", "skipped", "reason")[0] == ("2.gz", False, files.TOO_LONG.removeprefix("stopped partway: "))
