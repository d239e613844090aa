"""Reports on a catalog: relationship list, degrees and roles, neighbourhoods, dictionary, search, totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import cardinality_sentence, file_format_label, key_label, layers_label, markdown
from ..plans.assemble import Catalog
from ..sources.files import skipped_files
from ..sources.ordered import numbered


def relationship_list(relationships: DataFrame) -> DataFrame:
    dash = lambda c: F.coalesce(c, F.lit("—"))
    return relationships.select(
        "project", F.col("from_table").alias("child"), F.array_join("from_columns", ", ").alias("child_columns"), F.col("to_table").alias("parent"),
        F.array_join("to_columns", ", ").alias("parent_columns"), F.when(F.col("cardinality") == "one-to-one", "1 : 1").otherwise("N : 1").alias("ratio"),
        "optional", "identifying", (F.col("from_table") == F.col("to_table")).alias("self_reference"), dash(F.col("on_delete")).alias("on_delete"),
        dash(F.col("on_update")).alias("on_update"), F.col("name").alias("constraint_name"),
        cardinality_sentence(F.col("cardinality"), F.col("optional")).alias("meaning"))


def degrees(tables: DataFrame, relationships: DataFrame) -> DataFrame:
    """Outgoing and incoming references of every table; a self-reference counts in both."""
    side = lambda c, n: relationships.groupBy("project", F.col(c).alias("table_id")).agg(F.count(F.lit(1)).alias(n))
    out = tables.select("project", "table_id", "is_junction").join(side("from_table", "n_out"), ["project", "table_id"], "left")
    out = out.join(side("to_table", "n_in"), ["project", "table_id"], "left")
    return out.withColumns({c: F.coalesce(c, F.lit(0)).cast("long") for c in ("n_out", "n_in")})


def connectivity(tables: DataFrame, relationships: DataFrame) -> DataFrame:
    role = (
        F.when(F.col("is_junction"), "Link table").when((F.col("n_in") == 0) & (F.col("n_out") == 0), "Isolated")
        .when(F.col("n_out") == 0, "Root / lookup").when(F.col("n_in") == 0, "Leaf").otherwise("Intermediate"))
    return degrees(tables, relationships).withColumn("role", role).drop("is_junction")


def sort_connectivity(report: DataFrame) -> DataFrame:
    return report.orderBy(F.desc("n_in"), "table_id", "project")


def placed_connectivity(report: DataFrame) -> DataFrame:
    """The report with `place`, from 1: each project's tables by incoming references, then by name as people sort names (upper and lower
    case together, letters with marks by their letter)."""
    named = numbered(report, F.expr("-n_in"), F.collate("table_id", "UNICODE"), "table_id")
    return named.withColumn("place", F.col("number") + 1).drop("number")


def _without(tables: DataFrame, ends: DataFrame) -> DataFrame:
    return tables.select("project", "table_id").join(ends, ["project", "table_id"], "left_anti")


def _ends(edges: DataFrame, *sides: str) -> DataFrame:
    out = None
    for s in sides:
        one = edges.select("project", F.col(s).alias("table_id"))
        out = one if out is None else out.union(one)
    return out.distinct()


def root_tables(tables: DataFrame, relationships: DataFrame) -> DataFrame:
    return _without(tables, _ends(relationships.where("from_table <> to_table"), "from_table"))


def isolated_tables(tables: DataFrame, relationships: DataFrame) -> DataFrame:
    return _without(tables, _ends(relationships, "from_table", "to_table"))


def loose_tables(tables: DataFrame, relationships: DataFrame) -> DataFrame:
    return _without(tables, _ends(relationships.where("from_table <> to_table"), "from_table", "to_table"))


def linked_tables(relationships: DataFrame) -> DataFrame:
    return _ends(relationships.where("from_table <> to_table"), "from_table", "to_table")


def isolated_count(tables: DataFrame, relationships: DataFrame) -> DataFrame:
    gone = isolated_tables(tables, relationships).groupBy("project").agg(F.count(F.lit(1)).alias("isolated"))
    return tables.select("project").distinct().join(gone, "project", "left").select("project", F.coalesce("isolated", F.lit(0)).alias("isolated"))


def neighbours(relationships: DataFrame) -> DataFrame:
    """Every table with itself, its parents and its children, once each."""
    edge = relationships.select("project", F.col("from_table").alias("table_id"), F.col("to_table").alias("neighbour"))
    back = edge.select("project", F.col("neighbour").alias("table_id"), F.col("table_id").alias("neighbour"))
    own = edge.union(back).select("project", "table_id", F.col("table_id").alias("neighbour"))
    return edge.union(back).union(own).distinct()


def related_edges(relationships: DataFrame, table: str) -> DataFrame:
    return relationships.where((F.col("from_table") == table) | (F.col("to_table") == table))


def find_table(tables: DataFrame, table: str) -> DataFrame:
    return tables.where(F.lower("table_id") == table.lower())


def table_details(catalog: Catalog, table: str) -> dict[str, DataFrame]:
    """Columns of a table, its outgoing references (with those to itself), its incoming ones (without)."""
    mine = F.lower(F.lit(table))
    return {
        "columns": catalog.columns.where(F.lower("table_id") == mine).orderBy("project", "pos"),
        "outgoing": catalog.relationships.where(F.lower("from_table") == mine),
        "incoming": catalog.relationships.where((F.lower("to_table") == mine) & (F.lower("from_table") != mine)),
    }


def column_references(relationships: DataFrame) -> DataFrame:
    """project, table_id, low (a column's lower-case name) -> the `parent.column` of its last relationship."""
    each = relationships.select("project", F.col("from_table").alias("table_id"), "to_table", "to_columns", "table_ord", "fk_ord", F.posexplode("from_columns").alias("i", "col"))
    target = F.coalesce(F.get("to_columns", F.col("i")), F.get("to_columns", F.lit(0)), F.lit(""))
    each = each.withColumn("ref", F.concat("to_table", F.lit("."), target))
    return each.groupBy("project", "table_id", F.lower("col").alias("low")).agg(F.max_by("ref", F.struct("table_ord", "fk_ord", "i")).alias("ref"))


def dictionary(catalog: Catalog) -> DataFrame:
    """One row a column, in order, with key label, reference, and its Markdown row."""
    refs = column_references(catalog.relationships)
    rows = catalog.columns.withColumn("low", F.lower("name")).join(refs, ["project", "table_id", "low"], "left")
    key = key_label(F.col("primary_key"), F.col("ref").isNotNull(), F.col("unique"))
    rows = rows.withColumn("position", F.col("pos") + 1).withColumn("key", key)
    cells = [markdown(F.col("name")), markdown(F.col("type")), F.col("key"), F.when(F.col("nullable"), "YES").otherwise("NO"),
             F.concat(markdown(F.col("default_value")), F.when(F.col("auto_increment"), " (auto)").otherwise("")), F.coalesce("ref", F.lit("")), markdown(F.col("comment"))]
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))
    return rows.select("project", "table_id", "position", "name", "type", "nullable", "primary_key", "unique", "auto_increment", "default_value", "comment", "key", F.coalesce("ref", F.lit("")).alias("ref"), line.alias("line"))


def search_dictionary(catalog: Catalog, text: str) -> DataFrame:
    """Columns of the tables whose id, or any column, holds the trimmed text; hit flags the columns that do."""
    q = text.strip().lower()
    has = lambda c: F.lower(c).contains(q)
    own = dictionary(catalog).withColumn("hit", has("name") if q else F.lit(False))
    if not q:
        return own
    keep = own.where(has("table_id") | F.col("hit")).select("project", "table_id").distinct()
    return own.join(keep, ["project", "table_id"], "left_semi")


def catalog_totals(catalog: Catalog) -> DataFrame:
    """Tables, columns, relationships and warnings of each project, and of all (project null)."""
    kinds = {"tables": catalog.tables, "columns": catalog.columns, "relationships": catalog.relationships, "warnings": catalog.warnings}
    each = None
    for kind, df in kinds.items():
        one = df.select("project", F.lit(kind).alias("kind"))
        each = one if each is None else each.union(one)
    count = lambda k: F.count_if(F.col("kind") == k).alias(f"n_{k}")
    return each.rollup("project").agg(*map(count, kinds))


def file_reports(entries: DataFrame, stats: DataFrame) -> DataFrame:
    """One row a file: counters summed over its entries, the last entry's encoding. Rows with a `start` are parts of
    the entry before them."""
    start = F.col("start") if "start" in entries.columns else F.lit(None)
    both = stats.join(entries.select("project", "file", "entry_idx", "encoding", "text_bytes", start.alias("start")), ["project", "file", "entry_idx"])
    return both.groupBy("project", "file").agg(
        F.sum("created").alias("tables"), F.sum("kept").alias("kept"), F.sum("statements").alias("statements"), F.sum("inserts").alias("inserts"),
        F.sum("copy_blocks").alias("copy_blocks"), F.sum("chars").alias("chars"), F.sum("text_bytes").alias("text_bytes"), F.count_if(F.col("start").isNull()).alias("entries"),
        F.max_by("encoding", "entry_idx").alias("encoding"), (F.sum("inserts") + F.sum("copy_blocks")).alias("data_skipped"))


def import_reports(files: DataFrame, entries: DataFrame, stats: DataFrame) -> DataFrame:
    """file_reports() for every input file (project, file, file_idx, length), also those without a readable entry, with its
    size, the layers of its last entry up to an archive (format), whether anything was decrypted, and why it was skipped."""
    layers = F.when(F.size("layers") > 0, layers_label(F.col("layers")))
    seen = entries.groupBy("project", "file").agg(F.max_by(layers, F.when(layers.isNotNull(), F.col("entry_idx"))).alias("format"), F.bool_or("encrypted").alias("encrypted"))
    read = file_reports(entries.where("text is not null"), stats)
    gone = skipped_files(entries).where("skipped").select("project", "file", F.col("reason").alias("skipped"))
    out = files.select("project", "file", "file_idx", F.col("length").alias("size"))
    for more in (seen, read, gone):
        out = out.join(more, ["project", "file"], "left")
    counts = [c for c in read.columns if c not in ("project", "file", "encoding")]
    out = out.fillna(0, counts).fillna(False, ["encrypted"]).fillna("utf-8", ["encoding"])
    return out.withColumn("format_label", file_format_label(F.col("format"), F.col("entries")))


def first_skipped(skipped: DataFrame, k: int = 3) -> DataFrame:
    """The first k files of each project that were skipped as a whole (rows of skipped_files()), in file order."""
    order = Window.partitionBy("project").orderBy("file_idx")
    return skipped.where("skipped").withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)
