"""Registered queries over the given tables, with the same results as DuckDB SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import columns
from ..operators import checks, render, reports
from ..sources import datasource, files, ranges
from ..sources import statements as st
from ..sources.shared import shared_dir, written
from ..streaming import ingest
from . import assemble, corpora


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_built: dict = {}


def tree_catalog(spark: SparkSession, sf_dir: str) -> assemble.Catalog:
    """The catalog of the tree corpus; its tables are written, so queries of one session share them while the ids that
    the corpus is made of stay the same and the tables can still be read."""
    ids = table(spark, sf_dir, "documents").where("doc_id is not null").select("doc_id")
    stamp = tuple(ids.agg(F.count("doc_id"), F.bit_xor(F.xxhash64("doc_id")), F.sum(F.xxhash64("doc_id").cast("decimal(38,0)"))).first())
    key = (spark.sparkContext.applicationId, sf_dir, stamp)
    if key in _built:
        try:
            for df in (_built[key].tables, _built[key].relationships):
                df.isEmpty()
        except Exception:  # cleared by the owner of the folder
            del _built[key]
    if key not in _built:
        _built.clear()
        _built[key] = assemble.build(corpora.tree(ids))
    return _built[key]


def tree_relationships(spark, sf_dir):
    return reports.relationship_list(tree_catalog(spark, sf_dir).relationships)


def tree_tables(spark, sf_dir):
    t = tree_catalog(spark, sf_dir).tables
    return t.select("project", "table_id", "source", F.array_join("primary_key", ",").alias("primary_key"), F.size("uniques").alias("n_uniques"), "is_junction", "n_columns")


def tree_connectivity(spark, sf_dir):
    c = tree_catalog(spark, sf_dir)
    return reports.sort_connectivity(reports.connectivity(c.tables, c.relationships))


def tree_many_to_many(spark, sf_dir):
    return tree_catalog(spark, sf_dir).many_to_many


def tree_warnings(spark, sf_dir):
    return tree_catalog(spark, sf_dir).warnings.select("project", "message")


def tree_dictionary(spark, sf_dir):
    return reports.dictionary(tree_catalog(spark, sf_dir)).select("project", "table_id", "position", "name", "type", "nullable", "unique", "key", "ref", "line")


def tree_search(spark, sf_dir):
    found = reports.search_dictionary(tree_catalog(spark, sf_dir), " T1 ")
    return found.select("project", "table_id", "name", "hit")


def tree_table_sets(spark, sf_dir):
    """Root, isolated, loose and linked tables of each project, with the neighbours' count."""
    c = tree_catalog(spark, sf_dir)
    count = lambda df, n: df.groupBy("project").agg(F.count(F.lit(1)).alias(n))
    out = c.tables.select("project").distinct()
    for df, n in ((reports.root_tables(c.tables, c.relationships), "roots"), (reports.isolated_tables(c.tables, c.relationships), "isolated"),
                  (reports.loose_tables(c.tables, c.relationships), "loose"), (reports.linked_tables(c.relationships), "linked"),
                  (reports.neighbours(c.relationships), "neighbours")):
        out = out.join(count(df, n), "project", "left")
    return out.fillna(0)


def tree_totals(spark, sf_dir):
    return reports.catalog_totals(tree_catalog(spark, sf_dir))


def tree_er_edges(spark, sf_dir):
    return render.er_edges(tree_catalog(spark, sf_dir)).select("project", "line")


def tree_class_edges(spark, sf_dir):
    return render.class_edges(tree_catalog(spark, sf_dir)).select("project", "line")


def tree_graph_edges(spark, sf_dir):
    return render.graph_edges(tree_catalog(spark, sf_dir)).select("project", "line")


def tree_diagram_sizes(spark, sf_dir):
    """Lines of each diagram's document and of the dictionary, by project."""
    return render.document_lengths(tree_catalog(spark, sf_dir))


def tree_places(spark, sf_dir):
    """Each table's place in the connectivity report of its project."""
    c = tree_catalog(spark, sf_dir)
    return reports.placed_connectivity(reports.connectivity(c.tables, c.relationships)).select("project", "place", "table_id", "n_in", "role")


def tree_document_lines(spark, sf_dir):
    """Every line of each project's graph and dictionary, with its number."""
    d, out = render.Drawing(tree_catalog(spark, sf_dir)), None
    for kind in ("graph", "dictionary"):
        one = render.numbered_lines(d, kind).select("project", F.lit(kind).alias("kind"), "line_no", "line")
        out = one if out is None else out.union(one)
    return out


def dump_file_reports(spark, sf_dir):
    entries = corpora.dumps(table(spark, sf_dir, "documents"))
    return reports.file_reports(entries, st.scan_stats(entries))


def dump_retained_ddl(spark, sf_dir):
    return st.retained_ddl(st.split_statements(corpora.dumps(table(spark, sf_dir, "documents"))))


def dump_ranges(spark, sf_dir):
    """Plain dump files, a folder a source, read by ranges of bytes: what each folder's files hold. Each document is an INSERT that quotes its text, of as many
    lines as that has, and a CREATE."""
    top = f"{shared_dir(spark)}/dumps-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents").where("doc_id is not null")
    quoted = F.regexp_replace(F.regexp_replace(F.coalesce("text", F.lit("")), r"\\", r"\\\\"), "'", "''")
    sql = F.concat(F.lit("INSERT INTO docs VALUES ("), "doc_id", F.lit(", '"), quoted, F.lit(";\nCREATE TABLE fake (x int); -- /* $a$');\nCREATE TABLE t"), "doc_id", F.lit(" (x int);"))
    docs.select(F.coalesce("source", F.lit("none")).alias("source"), sql.alias("sql")).write.partitionBy("source").text(top)
    found = ranges.read_dumps(spark, f"{top}/*")
    counts = [F.sum(c).alias(c) for c in ("statements", "kept", "inserts", "copy_blocks", "created")]
    number = F.regexp_extract("sql", "^CREATE TABLE t([0-9]+) ", 1).try_cast("long")
    tables = found.statements.groupBy("project").agg(F.min(number).alias("first_table"), F.max(number).alias("last_table"), F.sum(number.cast("decimal(38,0)")).cast("string").alias("all_tables"))
    return found.stats.groupBy("project").agg(*counts).join(tables, "project").withColumn("project", F.regexp_replace("project", "^source=", ""))


def source_entries(spark, sf_dir):
    """Compressed scripts, a folder a source, read through the data source (or as files, where Python cannot open the shared folder):
    entries' bytes and the statements in them."""
    top = f"{shared_dir(spark)}/entries-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents").where("doc_id is not null")
    quoted = F.regexp_replace(F.regexp_replace(F.coalesce("text", F.lit("")), r"\\", r"\\\\"), "'", "''")
    sql = F.concat(F.lit("CREATE TABLE t"), "doc_id", F.lit(" (x int, note text DEFAULT '"), quoted, F.lit("');"))
    docs.select(F.coalesce("source", F.lit("none")).alias("source"), sql.alias("sql")).write.option("compression", "gzip").partitionBy("source").text(top)
    if top.startswith("file:"):
        datasource.register(spark)
        entries = spark.read.format("sql_entries").load(f"{top}/*").where("project like 'source=%' and file like 'part-%'")
    else:
        entries = files.readable_entries(files.expand_entries(files.read_sql_files(spark, f"{top}/*")))
    entries = entries.where("text is not null")
    made = st.split_statements(entries).groupBy("project").agg(F.count(F.lit(1)).alias("n_tables"), F.sum(F.length("sql")).alias("n_chars"))
    out = entries.groupBy("project").agg(F.sum("text_bytes").alias("n_bytes")).join(made, "project")
    return out.withColumn("project", F.regexp_replace("project", "^source=", ""))


def migration_columns(spark, sf_dir):
    c = assemble.build(corpora.migrations(table(spark, sf_dir, "events")))
    return c.columns.where("name <> 'id'").select("table_id", "name", "type", "nullable", "comment")


def migration_kinds(spark, sf_dir):
    rows = corpora.migrations(table(spark, sf_dir, "events")).withColumn("kind", st.classify_statement(F.col("sql")))
    return rows.groupBy("project", "kind").agg(F.count(F.lit(1)).alias("n"))


def check_nullable(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    return checks.observed_nullable(lines, lines.columns)


def check_keys(spark, sf_dir):
    return checks.key_violations(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


def check_orphans(spark, sf_dir):
    parent = table(spark, sf_dir, "orders").where("o_orderstatus <> 'F'")
    return checks.orphans(table(spark, sf_dir, "lineitem"), ["l_orderkey"], parent, ["o_orderkey"]).select("l_orderkey", "l_linenumber", "l_quantity")


def check_cardinality(spark, sf_dir):
    return checks.observed_cardinality(table(spark, sf_dir, "orders"), ["o_custkey"])


def check_optional(spark, sf_dir):
    return checks.observed_optional(table(spark, sf_dir, "orders"), ["o_custkey"])


def check_link_pairs(spark, sf_dir):
    return checks.observed_link_pairs(table(spark, sf_dir, "lineitem"), "l_partkey", "l_suppkey")


#: Keys and references of the star tables: table, key, then (columns, parent, its columns).
STAR = (
    ("region", "r_regionkey", ()),
    ("nation", "n_nationkey", (("n_regionkey", "region", "r_regionkey"),)),
    ("customer", "c_custkey", (("c_nationkey", "nation", "n_nationkey"),)),
    ("supplier", "s_suppkey", (("s_nationkey", "nation", "n_nationkey"),)),
    ("part", "p_partkey", ()),
    ("orders", "o_orderkey", (("o_custkey", "customer", "c_custkey"),)),
    ("lineitem", "", (("l_orderkey", "orders", "o_orderkey"), ("l_partkey", "part", "p_partkey"), ("l_suppkey", "supplier", "s_suppkey"), ("L_ORDERKEY", "Orders", "O_ORDERKEY"))),
)


def star_ddl() -> list[tuple[str, str, int]]:
    out = []
    for i, (name, key, fks) in enumerate(STAR):
        columns = dict.fromkeys([c for c in (key, *(f[0].lower() for f in fks)) if c])
        items = [f"{c} bigint NOT NULL" for c in columns] + ([f"PRIMARY KEY ({key})"] if key else [])
        items += [f"FOREIGN KEY ({c}) REFERENCES {p} ({q})" for c, p, q in fks]
        out.append((f"CREATE TABLE {name} ({', '.join(items)})", "star.sql", i))
    return out


def check_star_schema(spark, sf_dir):
    """The star schema as declared in DDL, each reference beside what the rows show."""
    ddl = spark.createDataFrame(star_ddl(), "sql string, source string, n int")
    catalog = assemble.build(st.read_statements(ddl, order="n"))
    declared = [r.asDict() for r in catalog.relationships.collect()]  # the seven references of the declaration above
    return checks.verify_catalog(spark, declared, {name: table(spark, sf_dir, name) for name, *_ in STAR})


def tree_documents(spark, sf_dir):
    """The text of each project's diagrams and dictionary, as a digest."""
    texts = render.documents(tree_catalog(spark, sf_dir))
    return texts.select("project", "kind", F.length("text").cast("long").alias("n_chars"), F.sha2("text", 256).alias("sha256"))


def tree_details(spark, sf_dir):
    """Of table T22 of each project: its id, columns, references out and in, and edges at it."""
    c = tree_catalog(spark, sf_dir)
    parts = {**reports.table_details(c, "T22"), "edges": reports.related_edges(c.relationships, "t22"), "itself": reports.find_table(c.tables, "T22")}
    out = None
    for name, df in parts.items():
        one = df.groupBy("project").agg(F.count(F.lit(1)).alias("n")).select("project", F.lit(name).alias("part"), "n")
        out = one if out is None else out.union(one)
    return out


def tree_isolated(spark, sf_dir):
    c = tree_catalog(spark, sf_dir)
    return reports.isolated_count(c.tables, c.relationships)


def _imports(spark, sf_dir):
    """Files, entries and statements of the packed corpus."""
    found = written(corpora.archives(table(spark, sf_dir, "documents")))
    entries = written(files.readable_entries(files.expand_entries(found)).drop("content"))
    return found, entries, entries.where("text is not null")


def archive_reports(spark, sf_dir):
    found, entries, readable = _imports(spark, sf_dir)
    out = reports.import_reports(found, entries, st.scan_stats(readable))
    return out.select("project", "file", "file_idx", "format", "format_label", "encoding", "entries", "tables", "kept", "statements", "inserts", "data_skipped", "chars", "text_bytes", "encrypted", "skipped")


def archive_warnings(spark, sf_dir):
    """What the import of each project has to say, in order, before its catalog's own warnings."""
    _, entries, readable = _imports(spark, sf_dir)
    c = assemble.build(st.split_statements(readable), files.import_notes(entries))
    place = F.row_number().over(Window.partitionBy("project").orderBy("rank", "at")).cast("long")
    return c.warnings.select("project", place.alias("place"), "message")


def archive_projects(spark, sf_dir):
    """Projects by what may be kept of them, with their first skipped file."""
    found, entries, readable = _imports(spark, sf_dir)
    skipped = files.skipped_files(entries)
    first = reports.first_skipped(skipped, 1).select("project", F.col("file").alias("first_skipped"))
    kept = files.persistable(entries, st.retained_ddl(st.split_statements(readable)), 1540).withColumn("persistable", F.lit(True))
    out = files.all_skipped(found, skipped).join(files.sensitive_flag(entries), "project").join(first, "project", "left").join(kept, "project", "left")
    return out.fillna(False, ["persistable"])


def archive_new_files(spark, sf_dir):
    """Files that an earlier import of those with even numbers did not hold, by project."""
    found = corpora.archives(table(spark, sf_dir, "documents")).drop("content")
    return files.new_files(found, found.where("file_idx % 2 = 0")).groupBy("project").agg(F.count(F.lit(1)).alias("n_new"))


def replaced_statements(spark, sf_dir):
    """Kept statements a file after projects p1 and up are replaced by their first files, and file f2 of p0 is removed."""
    every = corpora.tree(table(spark, sf_dir, "documents").where("doc_id is not null"))
    now = files.replace_files(every, every.where("project <> 'p0' and file = 'f1'"))
    return files.remove_file(now, "p0", "f2").groupBy("project", "file").agg(F.count(F.lit(1)).alias("n"))


def _odd(spark, sf_dir):
    return assemble.build(corpora.oddities(table(spark, sf_dir, "documents")))


def odd_relationships(spark, sf_dir):
    """References by bare names, and what a unique index makes of them."""
    return reports.relationship_list(_odd(spark, sf_dir).relationships).select("project", "child", "child_columns", "parent", "ratio", "meaning")


def odd_tables(spark, sf_dir):
    return _odd(spark, sf_dir).tables.select("project", "table_id", "comment", "n_columns")


def odd_warnings(spark, sf_dir):
    w = _odd(spark, sf_dir).warnings
    place = F.row_number().over(Window.partitionBy("project").orderBy("rank", "at")).cast("long")
    return w.select("project", place.alias("place"), "message")


def stream_tables(spark, sf_dir):
    """The tree corpus as files of a stream that come in two turns, tables that others reference last: tables of the catalogs that it leaves, with
    how many references each has. Every statement is in it, in order."""
    top = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    every = corpora.tree(table(spark, sf_dir, "documents").where("doc_id is not null")).withColumn("sql", F.concat("sql", F.lit(";")))
    for late in (False, True):
        turn = every.where((F.col("stmt_idx") < 250) == late).repartition("project").sortWithinPartitions("project", "file", "stmt_idx")
        turn.select("project", "sql").write.mode("append").partitionBy("project").text(f"{top}/in")
        ingest.stream_sql_files(spark, f"{top}/in/*", f"{top}/store", f"{top}/out", f"{top}/checkpoint").awaitTermination()
    c = ingest.read_catalog(spark, f"{top}/out")
    links = c.relationships.groupBy("project", F.col("from_table").alias("table_id")).agg(F.count(F.lit(1)).alias("n_references"))
    found = c.tables.join(links, ["project", "table_id"], "left").fillna(0, ["n_references"])
    return found.select(F.regexp_replace("project", "^project=", "").alias("project"), "table_id", "n_columns", "is_junction", "n_references")


def document_sizes(spark, sf_dir):
    """How large each document is, for people, and how its text would stand in an SQL script and come out of it again."""
    size = F.octet_length(F.coalesce("text", F.lit(""))).cast("long")
    back = columns.unquote_string(F.concat(F.lit("'"), F.regexp_replace(F.regexp_replace(F.coalesce("text", F.lit("")), r"\\", r"\\\\"), "'", "''"), F.lit("'")))
    kind = columns.normalise_type(F.concat(F.lit("[varchar]  ("), F.col("n_chars").cast("string"), F.lit(")")))
    auto = columns.is_auto_increment(F.concat(F.lit("big"), F.when(F.col("doc_id") % 2 == 0, "serial").otherwise("int")), F.when(F.col("doc_id") % 3 == 0, "nextval('s')"))
    return table(spark, sf_dir, "documents").select(
        "doc_id", columns.format_bytes(size).alias("size"), columns.format_bytes(size * size).alias("square"), (back == F.coalesce("text", F.lit(""))).alias("same"), kind.alias("kind"), auto.alias("auto"))


QUERIES = {f.__name__: f for f in (
    tree_relationships, tree_tables, tree_connectivity, tree_many_to_many, tree_warnings, tree_dictionary, tree_search, tree_table_sets, tree_totals,
    tree_places, tree_document_lines, tree_er_edges, tree_class_edges, tree_graph_edges, tree_diagram_sizes, dump_file_reports, dump_retained_ddl, dump_ranges, source_entries, migration_columns, migration_kinds, tree_documents, tree_details, tree_isolated, archive_reports, archive_warnings, archive_projects,
    archive_new_files, replaced_statements, odd_relationships, odd_tables, odd_warnings, stream_tables, document_sizes,
    check_nullable, check_keys, check_orphans, check_cardinality, check_optional, check_link_pairs, check_star_schema)}
