"""From DDL event rows to a schema catalog: joins, windows and aggregations by project.

A project is an import: its files, tables and columns may be any number, one table's columns fit in a row."""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import lowered, relationship_id, same_set, subset, table_id, table_key
from ..sources.ddl import extract_ddl
from ..sources.shared import written

STATEMENT = ("phase", "file_idx", "entry_idx", "stmt_idx")
COLUMN = "project string, key string, pos int, name string, type string, nullable boolean, primary_key boolean, unique boolean, auto_increment boolean, default_value string, comment string"


@dataclass
class Catalog:
    tables: DataFrame
    columns: DataFrame
    relationships: DataFrame
    many_to_many: DataFrame
    warnings: DataFrame


def latest_definitions(creates: DataFrame) -> DataFrame:
    """The last create of each (project, key), with the source and place of every earlier one as `before`;
    rows that are not last have last = false."""
    by = Window.partitionBy("project", "key")
    return creates.withColumn("before", F.lag(F.struct("file", "ord")).over(by.orderBy("ord"))).withColumn("last", F.row_number().over(by.orderBy(F.desc("ord"))) == 1)


def bare_names(definitions: DataFrame) -> DataFrame:
    """project, bare -> key: the latest redefinition with the name if there is one, else the first table."""
    again = F.col("before").isNotNull()
    first = definitions.groupBy("project", F.lower("name").alias("bare")).agg(
        F.max_by("key", F.when(again, F.col("ord"))).alias("again"), F.min_by("key", "ord").alias("first"), F.bool_or(again).alias("any"))
    return first.select("project", "bare", F.when(F.col("any"), F.col("again")).otherwise(F.col("first")).alias("bare_key"))


def resolve_table(refs: DataFrame, keys: DataFrame, bare: DataFrame, parts: str, to: str) -> DataFrame:
    """`refs` with column `to`: the key of the table that `parts` names, or null. Both look-ups are unique."""
    refs = refs.withColumn("_key", table_key(F.col(parts))).withColumn("_bare", F.lower(F.get(parts, F.size(parts) - 1)))
    own = keys.select(F.col("project").alias("_p"), F.col("key").alias("_own"))
    bare = bare.select(F.col("project").alias("_q"), F.col("bare").alias("_b"), "bare_key")
    refs = refs.join(own, (F.col("project") == F.col("_p")) & (F.col("_key") == F.col("_own")), "left")
    refs = refs.join(bare, (F.col("project") == F.col("_q")) & (F.col("_bare") == F.col("_b")), "left")
    return refs.withColumn(to, F.coalesce("_own", "bare_key")).drop("_key", "_bare", "_p", "_own", "_q", "_b", "bare_key")


def _fold(pdf: pd.DataFrame) -> pd.DataFrame:
    """One table's column events in order; runs only on tables with a renamed or a twice declared column."""
    pdf = pdf.sort_values(["phase", "file_idx", "entry_idx", "stmt_idx", "item_idx"])
    fields = ["name", "type", "nullable", "primary_key", "unique", "auto_increment", "default_value", "comment"]
    cols: list[dict] = []
    for e in pdf.astype(object).where(pdf.notna(), None).to_dict("records"):
        found = next((c for c in cols if c["name"].lower() == (e["old"] if e["old"] is not None else e["name"] or "").lower()), None)
        if e["event"] == "column" or e["event"] == "add" and not found:
            cols.append({f: e[f] for f in fields})
        elif e["event"] == "modify" and found:
            found |= {"name": e["name"], "type": e["type"] or found["type"], "nullable": e["nullable"]}
            found |= {f: bool(found[f] or e[f]) for f in ("primary_key", "unique", "auto_increment")}
            found |= {f: found[f] if e[f] is None else e[f] for f in ("default_value", "comment")}
        elif e["event"] in ("set", "comment_column") and found:
            found |= {f: e[f] for f in ("type", "nullable", "auto_increment", "default_value", "comment") if e[f] is not None}
    out = pd.DataFrame(cols, columns=fields)
    return out.assign(project=pdf["project"].iloc[0], key=pdf["key"].iloc[0], pos=range(len(cols)))[[c.split()[0] for c in COLUMN.split(", ")]]


def _folded(mine: DataFrame) -> DataFrame:
    """One row per (project, key, low = lower-case name): the column after all its events (null `born` where nothing
    adds it), and whether the table needs _fold, as a CHANGE renames it or it is declared twice. Only aggregates, so
    that a table with any number of events costs each task one row a column."""
    at, event = F.struct(*STATEMENT, "item_idx"), F.col("event")
    born, modified, changed = event.isin("column", "add"), event == "modify", event.isin("set", "comment_column")
    said = lambda c: F.col(c).isNotNull()
    last = lambda c, when: F.max(F.when(when, F.struct(at.alias("at"), F.col(c).alias("v"))))
    fields = ("name", "type", "nullable", "primary_key", "unique", "auto_increment", "default_value", "comment")
    renames = modified & (F.lower("old") != F.lower("name"))
    found = mine.groupBy("project", "key", "low").agg(
        F.min(F.when(born, F.struct(at.alias("at"), *[F.col(f) for f in fields]))).alias("born"),
        last("name", modified).alias("_name"), last("type", modified & (F.col("type") != "") | changed & said("type")).alias("_type"),
        last("nullable", modified | changed & said("nullable")).alias("_nullable"), last("auto_increment", changed & said("auto_increment")).alias("_auto"),
        *[last(c, (modified | changed) & said(c)).alias(f"_{c}") for c in ("default_value", "comment")],
        *[last(c, modified & F.col(c)).alias(f"_{c}") for c in ("primary_key", "unique", "auto_increment")],
        (F.coalesce(F.bool_or(renames), F.lit(False)) | (F.count_if(event == "column") > 1)).alias("hard"))
    later = lambda c: F.coalesce(F.col(f"{c}.at") > F.col("born.at"), F.lit(False))
    value = lambda c: F.when(later(f"_{c}"), F.col(f"_{c}.v")).otherwise(F.col(f"born.{c}")).alias(c)
    flag = lambda c: (F.col(f"born.{c}") | later(f"_{c}")).alias(c)
    since = F.when(later("_auto"), F.col("_auto.at")).otherwise(F.col("born.at"))
    auto = F.when(later("_auto"), F.col("_auto.v")).otherwise(F.col("born.auto_increment")) | F.coalesce(F.col("_auto_increment.at") > since, F.lit(False))
    return found.select("project", "key", "hard", F.col("born.at").alias("born"), value("name"), value("type"), value("nullable"), flag("primary_key"), flag("unique"),
                        auto.alias("auto_increment"), value("default_value"), value("comment"))


def fold_columns(events: DataFrame) -> DataFrame:
    """Columns of each table after all its ALTERs and column comments, in order (pos)."""
    mine = events.where(F.col("event").isin("column", "add", "modify", "set", "comment_column"))
    mine = mine.withColumn("low", F.lower(F.coalesce("old", "name", F.lit(""))))
    folded = written(_folded(mine))
    hard = folded.where("hard").select("project", "key").distinct()
    order = Window.partitionBy("project", "key").orderBy("born")
    names = [c.split()[0] for c in COLUMN.split(", ")]
    easy = folded.where("born is not null")
    if hard.isEmpty():
        return easy.withColumn("pos", F.row_number().over(order) - 1).select(*names)
    easy = easy.join(hard, ["project", "key"], "left_anti").withColumn("pos", F.row_number().over(order) - 1)
    one_by_one = mine.join(hard, ["project", "key"], "left_semi").drop("parts", "columns", "ref_parts", "ref_columns", "ord", "low").groupBy("project", "key").applyInPandas(_fold, COLUMN)
    return easy.select(*names).unionByName(one_by_one.select(*names))


def keyed_tables(live: DataFrame, known: DataFrame, columns: DataFrame) -> DataFrame:
    """The tables with their keys, comments and columns (cols, in order), one row each. A key is the last one declared,
    else the columns flagged; its members are not null. Unique lists are those of tables and indexes, then one for each
    unique column."""
    at, is_ = F.struct(*STATEMENT, "item_idx"), lambda e: F.col("event") == e
    said = known.groupBy("project", "key").agg(
        F.max_by("columns", F.when(is_("pk") & (F.size("columns") > 0), at)).alias("declared"),
        F.sort_array(F.collect_list(F.when(is_("unique"), F.struct(at.alias("at"), "columns")))).alias("lists"),
        F.max_by("comment", F.when(is_("comment_table") & F.col("comment").isNotNull(), at)).alias("said"))
    fields = ["pos", "name", "type", "nullable", "primary_key", "unique", "auto_increment", "default_value", "comment"]
    cols = columns.groupBy("project", "key").agg(F.sort_array(F.collect_list(F.struct(*fields))).alias("cols"))
    none = F.array().cast(cols.schema["cols"].dataType)
    t = live.join(said, ["project", "key"], "left").join(cols, ["project", "key"], "left").withColumn("cols", F.coalesce("cols", none))
    flagged = lambda f: F.transform(F.filter("cols", lambda c: c[f]), lambda c: c["name"])
    lists = F.coalesce(F.transform("lists", lambda u: u["columns"]), F.array().cast("array<array<string>>"))
    t = t.withColumn("pk", F.coalesce("declared", flagged("primary_key"))).withColumn("uniques", F.concat(lists, F.transform(flagged("unique"), lambda n: F.array(n))))
    t = t.withColumn("low_pk", lowered(F.col("pk"))).withColumn("alone", F.transform(F.filter("uniques", lambda u: F.size(u) == 1), lambda u: F.lower(u[0])))
    of = lambda c: F.struct(
        c["pos"].alias("pos"), c["name"].alias("name"), c["type"].alias("type"), (c["nullable"] & ~F.array_contains("low_pk", F.lower(c["name"]))).alias("nullable"),
        (c["primary_key"] | F.array_contains("low_pk", F.lower(c["name"]))).alias("primary_key"), (c["unique"] | F.array_contains("alone", F.lower(c["name"]))).alias("unique"),
        c["auto_increment"].alias("auto_increment"), c["default_value"].alias("default_value"), c["comment"].alias("comment"))
    return written(t.select(
        "project", "key", "ord", "table_id", "name", "schema", F.col("file").alias("source"), F.coalesce("said", "comment").alias("comment"), "pk", "uniques",
        F.transform("cols", of).alias("cols")))


def related(fks: DataFrame, tables: DataFrame) -> DataFrame:
    """Relationships of the foreign keys (a written table with their resolved targets, to_key), the first of each id."""
    child = tables.select("project", "key", F.col("ord").alias("table_ord"), "table_id", "pk", "uniques", "cols")
    parent = tables.select("project", F.col("key").alias("to_key"), F.col("table_id").alias("to_table"), F.col("pk").alias("to_pk"), F.transform("cols", lambda c: c["name"]).alias("to_names"))
    rel = fks.where("to_key is not null").join(child, ["project", "key"]).join(parent, ["project", "to_key"])
    first = lambda n: F.get(F.filter("cols", lambda c: F.lower(c["name"]) == F.lower(n)), F.lit(0))
    own = F.transform("columns", lambda n: F.struct(F.coalesce(first(n)["name"], n).alias("name"), F.coalesce(first(n)["nullable"], F.lit(True)).alias("nullable")))
    wanted = F.when(F.size("ref_columns") > 0, F.col("ref_columns")).otherwise(F.col("to_pk"))
    spelled = F.transform(wanted, lambda n: F.coalesce(F.get(F.filter("to_names", lambda c: F.lower(c) == F.lower(n)), F.lit(0)), n))
    rel = rel.withColumn("own", own).withColumn("to_columns", spelled).withColumn("from_columns", F.transform("own", lambda c: c["name"]))
    one = same_set(F.col("from_columns"), F.col("pk")) | F.exists("uniques", lambda u: same_set(F.col("from_columns"), u))
    rel = rel.select(
        "project", relationship_id(F.col("table_id"), F.col("from_columns"), F.col("to_table")).alias("rel_id"), F.col("fk_name").alias("name"), F.col("key").alias("from_key"),
        F.col("table_id").alias("from_table"), "from_columns", "to_key", "to_table", "to_columns", F.when(one, "one-to-one").otherwise("many-to-one").alias("cardinality"),
        F.exists("own", lambda c: c["nullable"]).alias("optional"), subset(F.col("from_columns"), F.col("pk")).alias("identifying"), "on_delete", "on_update",
        (F.size("pk") >= 2).alias("wide"), "table_ord", "fk_ord")
    by = Window.partitionBy("project", "rel_id").orderBy("table_ord", "fk_ord")
    return written(rel.withColumn("nth", F.row_number().over(by)).where("nth = 1").drop("nth"))


def build(statements: DataFrame, notes: DataFrame | None = None) -> Catalog:
    """The catalog of statement rows (project, file, file_idx, entry_idx, stmt_idx, kind, sql). `notes` (project, seq,
    message: what the import has to say, as files.import_notes() has it) lead the warnings."""
    c = assembled(written(extract_ddl(statements)))
    said = c.warnings.drop("bare")
    if notes is not None:
        said = said.unionByName(notes.select("project", F.lit(0).alias("rank"), F.lpad(F.col("seq").cast("string"), 12, "0").alias("at"), "message"))
    return Catalog(c.tables, c.columns, c.relationships, c.many_to_many, said)


def assembled(events: DataFrame) -> Catalog:
    """The catalog of event rows (a written table); its warnings have the bare name of the table that they are about, if any."""
    events = events.withColumn("ord", F.struct(*STATEMENT))
    creates = events.where("event = 'create'").select("project", "file", "ord", "parts", "comment")
    creates = creates.withColumn("key", table_key(F.col("parts"))).withColumn("table_id", table_id(F.col("parts")))
    creates = creates.withColumn("name", F.element_at("parts", -1)).withColumn("schema", F.get("parts", F.size("parts") - 2))
    definitions = written(latest_definitions(creates))
    live = definitions.where("last")
    keys, bare = live.select("project", "key"), bare_names(definitions)

    # Events of the live CREATE statements, and those of other statements by the table that they name.
    own = events.where("phase = 0").join(live.select("project", "ord", "key"), ["project", "ord"])
    named = resolve_table(events.where("phase = 1 and parts is not null"), keys, bare, "parts", "key")
    known = written(own.unionByName(named.select(*own.columns)))
    ignored = known.where("key is null")
    known = known.where("key is not null")
    tables = keyed_tables(live, known, fold_columns(known))
    columns = tables.select("project", "key", "table_id", F.explode("cols").alias("c")).select("project", "key", "table_id", "c.*")

    fks = known.where("event = 'fk'").select(
        "project", "key", F.struct(*[F.col(c).alias(f"fk_{c}") for c in STATEMENT], "item_idx").alias("fk_ord"), "columns", "ref_parts", "ref_columns", F.col("name").alias("fk_name"), "on_delete", "on_update")
    fks = written(resolve_table(fks, keys, bare, "ref_parts", "to_key"))
    rel = related(fks, tables)

    # Link tables: a key of two or more columns whose parts reference exactly two other tables.
    inside = rel.where((F.col("from_key") != F.col("to_key")) & F.col("identifying") & F.col("wide"))
    ends = inside.groupBy("project", "from_key", "from_table", "to_table").agg(F.min(F.struct("table_ord", "fk_ord")).alias("o"))
    ends = ends.groupBy("project", "from_key", "from_table").agg(F.transform(F.array_sort(F.collect_list(F.struct("o", "to_table"))), lambda s: s["to_table"]).alias("ends"))
    links = ends.where("size(ends) = 2")
    many = links.select("project", F.col("from_table").alias("via"), F.get("ends", F.lit(0)).alias("a"), F.get("ends", F.lit(1)).alias("b"))
    junction = links.select("project", F.col("from_key").alias("key"), F.lit(True).alias("is_junction"))
    shown = tables.withColumn("n_columns", F.size("cols").cast("long")).drop("cols").join(junction, ["project", "key"], "left")
    # Reports read it several times each; written, their plans do not repeat how link tables are found.
    shown = written(shown.withColumn("is_junction", F.coalesce("is_junction", F.lit(False))).withColumnRenamed("pk", "primary_key"))
    lost = fks.where("to_key is null").join(tables.select("project", "key", "table_id", F.col("name").alias("table_name"), F.col("ord").alias("table_ord")), ["project", "key"])
    return Catalog(shown, columns, rel.drop("wide"), many, warnings(events, definitions, ignored, lost))


def _place(*c: str) -> Column:
    """Numbers as text that sorts like them."""
    return F.concat_ws("/", *[F.lpad(F.col(x).cast("string"), 12, "0") for x in c])


def unread(events: DataFrame) -> DataFrame:
    """What statements that could not be read, or not as tables, have to say."""
    return events.where("event = 'warning'").select("project", F.lit(1).alias("rank"), _place(*STATEMENT).alias("at"), "message", F.lit(None).cast("string").alias("bare"))


def warnings(events: DataFrame, definitions: DataFrame, ignored: DataFrame, lost: DataFrame) -> DataFrame:
    """project, rank, at, message, bare: statement warnings in order, then unknown references by table."""
    two = F.when(F.col("before.file") != F.col("file"), F.concat(F.lit(" ("), F.col("before.file"), F.lit(" and "), F.col("file"), F.lit(")"))).otherwise("")
    of = lambda s: _place(*[f"{s}.{c}" for c in STATEMENT])
    twice = definitions.where("before is not null").select(
        "project", F.lit(1).alias("rank"), of("ord").alias("at"),
        F.concat(F.lit('Table "'), "table_id", F.lit('" is defined more than once'), two, F.lit("; the last definition is used.")).alias("message"), F.lower("name").alias("bare"))
    joined = F.array_join("parts", ".")
    ignored = ignored.where("event = 'alter'").select(
        "project", F.lit(1).alias("rank"), of("ord").alias("at"), F.concat(F.lit('ALTER TABLE on unknown table "'), joined, F.lit('" was ignored.')).alias("message"), F.lower(F.element_at("parts", -1)).alias("bare"))
    fk_at = _place(*[f"fk_ord.fk_{c}" for c in STATEMENT], "fk_ord.item_idx")
    orphan = lost.select(
        "project", F.lit(2).alias("rank"), F.concat_ws("/", of("table_ord"), fk_at).alias("at"),
        F.concat("table_id", F.lit(': foreign key references unknown table "'), F.array_join("ref_parts", "."), F.lit('".')).alias("message"), F.lower("table_name").alias("bare"))
    return twice.unionByName(unread(events)).unionByName(ignored).unionByName(orphan)
