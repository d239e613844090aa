"""References that become known in a stream with state, over restarts of the query."""

from schemaloom.streaming.links import stream_links


def test_late_tables_replaced_files_and_restarts(spark, tmp_path):
    top = tmp_path / "in" / "p"
    top.mkdir(parents=True)
    seen, steps = 0, [
        ([("1.sql", "CREATE TABLE child (a int REFERENCES parent(id), b int REFERENCES nowhere); ALTER TABLE other ADD FOREIGN KEY (c) REFERENCES s.parent (id);")],
         [("waiting", "child", "a", "parent"), ("waiting", "child", "b", "nowhere"), ("waiting", "other", "c", "s.parent")]),
        ([("2.sql", "CREATE TABLE Parent (id int PRIMARY KEY); CREATE TABLE more (x int REFERENCES public.PARENT);")],
         [("linked", "child", "a", "parent"), ("linked", "more", "x", "parent"), ("linked", "other", "c", "parent")]),
        ([("3.sql", "CREATE TABLE parent (id int PRIMARY KEY, n int);"), ("4.sql", "CREATE TABLE s.parent (id int PRIMARY KEY); CREATE TABLE last (y int REFERENCES s.parent, z int REFERENCES t.parent);")],
         [("linked", "last", "y", "s.parent"), ("linked", "last", "z", "parent"), ("redefined", None, None, "parent")]),
        ([("new/3.sql", "CREATE TABLE parent (id int PRIMARY KEY, n int, m int);")], [("replaced", None, None, "parent")]),
        ([], [])]
    for files, want in steps:
        for name, text in files:
            folder = top if "/" not in name else tmp_path / "in" / "new" / "p"
            folder.mkdir(parents=True, exist_ok=True)
            (folder / name.split("/")[-1]).write_text(text)
        stream_links(spark, f"{tmp_path}/in/{{p,new/p}}" if (tmp_path / "in" / "new").exists() else f"{tmp_path}/in/p", f"{tmp_path}/out", f"{tmp_path}/ck").awaitTermination()
        got = spark.read.parquet(f"{tmp_path}/out").select("status", "child", "columns", "parent").collect()
        assert len(got) == seen + len(want)
        key = lambda rows: sorted(map(tuple, rows), key=repr)
        assert key(got) == key([x for _, w in steps[: steps.index((files, want)) + 1] for x in w])
        seen = len(got)
