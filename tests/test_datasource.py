"""The data source against expand_entries() on the same files."""

import bz2
import gzip
import io
import os
import zipfile

from pyspark.sql import functions as F

from schemaloom.sources import datasource, files


def zipped(members):
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in members:
            z.writestr(name, text)
    return raw.getvalue()


def sample(top):
    inner = zipped([("deep.sql", "CREATE TABLE deep (x int);")])
    made = {
        "a/1.sql": b"CREATE TABLE one (x int);", "a/2.sql.gz": gzip.compress(b"CREATE TABLE two (x int);") + gzip.compress(b"CREATE TABLE three (x int);"), "a/3.bin": b"\0\1\2\3" * 99,
        "b/1.zip": zipped([("x.sql", "CREATE TABLE x (x int);"), ("in.zip", inner), ("no.md", "text"), *[(f"m{i}.sql", f"CREATE TABLE m{i} (x int);" * 40) for i in range(20)]]),
        "b/2.sql": "CREATE TABLE wide (x int);".encode("utf-16"), "c/1.7z": b"7z\xbc\xaf\x27\x1c" + b"x" * 50, "c/2.sql.bz2": bz2.compress(b"\xef\xbb\xbfCREATE TABLE bom (x int);"), "c/3.zip": zipped([("x.sql", "SELECT 1")])[:60]}
    for name, raw in made.items():
        os.makedirs(top / os.path.dirname(name), exist_ok=True)
        (top / name).write_bytes(raw)


def read(spark, top, **options):
    return spark.read.format("sql_entries").options(**options).load(f"{top}/*")


def test_entries_are_those_of_the_files(spark, tmp_path):
    sample(tmp_path)
    datasource.register(spark)
    want = files.readable_entries(files.expand_entries(files.read_sql_files(spark, f"{tmp_path}/*/*")))
    cols = ["project", "file", "file_idx", "name", "layers", "note", "encrypted", "start", "text_bytes", "text"]
    key = lambda rows: sorted((tuple(r) for r in rows), key=repr)
    stopped = lambda df: df.withColumn("note", F.regexp_extract("note", "^[a-zA-Z ]+", 0)).select(*cols).collect()
    for split in ("100", "100000000"):
        assert key(stopped(read(spark, tmp_path, split=split))) == key(stopped(want))
    cut = read(spark, tmp_path, split="100")
    assert cut.rdd.getNumPartitions() > 10
    order = lambda df: [r.name for r in df.where("file = '1.zip'").orderBy("entry_idx").collect()]
    assert order(cut) == order(want) and order(cut)[1] == "1.zip/in.zip/deep.sql"


def test_filters_reach_the_files(spark, tmp_path):
    sample(tmp_path)
    datasource.register(spark)
    os.chmod(tmp_path / "a", 0o755)
    (tmp_path / "b" / "3.zip").write_bytes(zipped([("x.sql", "broken")]).replace(b"broken", b"BROKEN"))
    one = read(spark, tmp_path, split="100").where("project = 'a' and file in ('1.sql', '2.sql.gz')")
    assert sorted(r.file for r in one.collect()) == ["1.sql", "2.sql.gz"] and one.rdd.getNumPartitions() <= 2
    assert [(r.name, r.text) for r in read(spark, tmp_path).where("name = '1.zip/in.zip/deep.sql'").collect()] == [("1.zip/in.zip/deep.sql", "CREATE TABLE deep (x int);")]
    assert read(spark, tmp_path).where("project like 'c%' and text_bytes > 3").count() == 1
    slim = read(spark, tmp_path, content="false").where("project = 'b' and name = '3.zip/x.sql'").collect()
    assert [(r.text_bytes, r.text) for r in slim] == [(6, None)], "its broken data is not looked at"
    assert read(spark, tmp_path).where("project = 'none'").collect() == []


def test_pushed_filters_are_only_those_understood():
    from pyspark.sql.datasource import EqualTo, GreaterThan, In, StringStartsWith

    r = datasource.Reader({"path": "x"})
    given = [EqualTo(("project",), "a"), In(("file",), ("x", "y")), StringStartsWith(("name",), "q"), GreaterThan(("file_idx",), 3), EqualTo(("note",), "z")]
    assert list(r.pushFilters(given)) == given[3:] and r._passes("project", "a") and not r._passes("file", "z") and r._passes("name", "q/x")
