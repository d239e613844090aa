"""Dumps read by ranges of bytes against one scan of each whole file."""

import gzip
import os
import random

import pytest

from schemaloom.operators import checks
from schemaloom.sources import files, ranges
from schemaloom.sources.statements import Script, parts


def literal(r, slashes):
    some = ["it''s", "; CREATE TABLE fake (x int);\n", "a\nb", "-- no", "/* no", "$$", "\nINSERT INTO q VALUES (1);\n", "plain words", "\n\\.\n", "GO\n"]
    return "'" + "".join(r.choice(some + ["\\'", "\\\\"] * slashes) for _ in range(r.randint(0, 6))) + "'"


def dump(r, kind, n):
    out = [{"pg": "SET standard_conforming_strings = on;\n", "ms": "SET ANSI_NULLS ON\nGO\n", "my": ""}[kind]]
    lit = lambda: literal(r, kind == "my")
    for i in range(n):
        x = r.random()
        if x < 0.5:
            out.append(f"INSERT INTO t VALUES ({i}, {lit()}, {lit()});\n")
        elif x < 0.6:
            out.append(f"CREATE TABLE t{i} (id int, /* ; ' */ b text DEFAULT {lit()});\n")
        elif x < 0.65:
            out.append(f"-- a comment's ; {i}\n/* several\n ; ' lines */\n")
        elif x < 0.75:
            out.append({
                "pg": "COPY c (a, b) FROM stdin;\n" + "".join(f"{j}\tx;'{j}\n" for j in range(r.randint(0, 30))) + "\\.\nCREATE FUNCTION f() AS $b$ begin; CREATE TABLE no (x int); ' end $b$;\n",
                "my": f"DELIMITER ;;\nCREATE TRIGGER x BEGIN INSERT INTO y VALUES ('a'); CREATE TABLE no(x int); END;;\nCREATE TABLE yes{i} (x int);;\nDELIMITER ;\n# hash ' comment\n",
                "ms": f"CREATE TABLE [g;{i}] (x int)\nGO\n"}[kind])
        else:
            out.append(f"ALTER TABLE t{i} ADD c int;")
    return "".join(out)


@pytest.mark.parametrize("size", [4000, 1 << 24])
def test_ranges_give_what_one_scan_gives(spark, tmp_path, size):
    r, texts = random.Random(size), {}
    for kind in ("pg", "my", "ms"):
        os.makedirs(tmp_path / kind)
        for i, end in enumerate(("\n", "")):
            texts[kind, f"d {i}+é.sql"] = text = dump(r, kind, 250).rstrip("\n") + end
            (tmp_path / kind / f"d {i}+é.sql").write_bytes(text.encode())
    (tmp_path / "my" / "bin.sql").write_bytes(b"a\0b" * 100)
    (tmp_path / "my" / "wide.sql").write_bytes("CREATE TABLE x (y int);".encode("utf-16"))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "13000b")
    spark.conf.set("spark.sql.files.openCostInBytes", "1000b")
    try:
        found = ranges.read_dumps(spark, f"{tmp_path}/*/*", size)
        got = {}
        for s in found.statements.orderBy("project", "file", "stmt_idx").collect():
            got.setdefault((s.project, s.file), []).append((s.stmt_idx, s.kind, s.sql))
        stats, notes = found.stats.collect(), {n.file: n.note for n in found.notes.collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert notes == {"bin.sql": "it is not a text file", "wide.sql": "it is UTF-16 text, which is read whole"} and len(stats) == len(texts)
    for s in stats:
        one = Script(texts[s.project, s.file])
        assert got[s.project, s.file] == [(i, *k) for i, k in enumerate(one.kept)]
        assert (s.statements, s.kept, s.inserts, s.copy_blocks) == (one.total, len(one.kept), one.inserts, one.copies) and s.chars - one.chars in (0, 1)
        assert s.file_idx == int(s.file[2]) + (s.project == "my")


def test_parts_know_delimiters_batches_and_line_starts():
    """Wherever a text is cut, what starts after a semicolon is not the start of a line."""
    text = "DELIMITER //\nCREATE TABLE a (x int);//\n CREATE TABLE b (x int)// GO\nDELIMITER ;\nCREATE TABLE c (x int); # no comment; CREATE TABLE d (x int);\nCREATE TABLE e (x int)\nGO\nCREATE TABLE f (x int); GO\n ALTER TABLE f ADD y int;"
    for step in (1, 7, 20, 1000):
        got = [k for t, s in parts((text[i : i + step] for i in range(0, len(text), step)), 10_000) for k in Script(t, s).kept]
        assert got == Script(text).kept


def test_new_files_are_those_of_their_project(spark):
    row = lambda p: (p, "a.sql", 5, "2024-01-01")
    df = lambda *ps: spark.createDataFrame([row(p) for p in ps], "project string, file string, length long, modificationTime string")
    assert [r.project for r in files.new_files(df("a", "b"), df("a", "a")).collect()] == ["b"]


def test_keys_of_different_types_are_equal(spark):
    child = spark.sql("SELECT * FROM VALUES (1, '1', 1.5D, DATE'2024-01-02', CAST(NULL AS INT), 9), (2, '02', 2D, DATE'2024-01-03', 1, 9), (3, 'x', 3D, NULL, 2, 9) AS t(a, s, d, day, n, z)")
    parent = spark.sql("SELECT * FROM VALUES (1.00BD, 1.5BD, TIMESTAMP'2024-01-02 00:00:00', 'p'), (2.00BD, 2.0BD, TIMESTAMP'2024-01-03 00:00:00', 'q') AS t(id, k, at, extra)")
    ref = lambda f, t: {"rel_id": f[0], "from_table": "c", "from_columns": list(f), "to_table": "p", "to_columns": list(t), "cardinality": "many-to-one", "optional": True}
    got = {r.relationship: (r.n_orphans, r.null_rows, r.max_children) for r in checks.verify_catalog(spark, [ref(["a"], ["id"]), ref(["s"], ["ID"]), ref(["d"], ["k"]), ref(["day"], ["at"]), ref(["N"], ["id"]), ref(["z", "a"], ["id", "k"])], {"c": child, "p": parent}).collect()}
    assert got == {"a": (1, 0, 1), "s": (1, 0, 1), "d": (1, 0, 1), "day": (0, 1, 1), "N": (0, 1, 1), "z": (3, 0, 1)}
    for c, p in (("a", "id"), ("d", "k"), ("n", "id")):
        assert checks.orphans(child, [c], parent, [p]).count() == got[c.upper() if c == "n" else c][0]


@pytest.mark.parametrize("members", [1, 3000, 1 << 20])
def test_members_of_gzip_files_are_read_by_many_tasks(spark, tmp_path, members):
    """Wherever a text is cut into members, within lines too, and with bytes in the data that look like a member's first."""
    r, texts = random.Random(9), {}
    os.makedirs(tmp_path / "my")
    for i in range(3):
        text = dump(r, "my", 80) + "INSERT INTO t VALUES ('" + "x" * 9000 + "');\nCREATE TABLE last (x int)"
        raw, cuts = text.encode(), sorted(r.sample(range(len(text)), 25)) if i else []
        cuts = [0, *cuts, len(raw)]
        texts[f"{i}.sql.gz"] = text
        (tmp_path / "my" / f"{i}.sql.gz").write_bytes(b"".join(gzip.compress(raw[a:b], 0 if k % 2 else 6) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))))
    whole = (tmp_path / "my" / "2.sql.gz").read_bytes()
    assert len(ranges.member_runs(whole, 1)) >= 25 and ranges.member_runs(b"\x1f\x8b\x08\x00" * 50, 1) == [(0, 200)]
    inner = gzip.compress(b"x" * 30)
    texts["inner.sql.gz"] = "CREATE TABLE a (x int); " + "-- pad\n" * 900 + "INSERT INTO t VALUES ('" + inner.decode("latin-1").replace("'", "''") + "');\nCREATE TABLE b (x int);"
    (tmp_path / "my" / "inner.sql.gz").write_bytes(gzip.compress(texts["inner.sql.gz"].encode("latin-1"), 0))
    (tmp_path / "my" / "bad.sql.gz").write_bytes(gzip.compress(b"CREATE TABLE good (x int);\n") + gzip.compress(b"CREATE TABLE lost (x int);\n" * 9)[:-12])
    found = ranges.read_gzip_dumps(spark, f"{tmp_path}/my", 5000, members)
    got = {}
    for s in found.statements.orderBy("file", "stmt_idx").collect():
        got.setdefault(s.file, []).append((s.kind, s.sql))
    for name, text in texts.items():
        assert got[name] == Script(text).kept if name != "inner.sql.gz" else [k for _, k in got[name]] == ["CREATE TABLE a (x int)", "CREATE TABLE b (x int)"]
    assert got["bad.sql.gz"][0] == ("create_table", "CREATE TABLE good (x int)") and [n.file for n in found.notes.collect()] == ["bad.sql.gz"]
