"""Scalar functions on catalog columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DEFAULT_SCHEMAS = ("public", "dbo", "main")


def table_id(parts: Column) -> Column:
    """`schema.name`, without a schema that is absent or a default one; only the last two parts count."""
    name, schema = F.get(parts, F.size(parts) - 1), F.get(parts, F.size(parts) - 2)
    plain = (F.size(parts) < 2) | F.lower(schema).isin(*DEFAULT_SCHEMAS)
    return F.when(plain, name).otherwise(F.concat(schema, F.lit("."), name))


def table_key(parts: Column) -> Column:
    return F.lower(table_id(parts))


def lowered(names: Column) -> Column:
    return F.transform(names, F.lower)


def same_set(a: Column, b: Column) -> Column:
    """Equal as case-insensitive lists of one length whose members of `a` all occur in `b`."""
    return (F.size(a) == F.size(b)) & F.forall(lowered(a), lambda x: F.array_contains(lowered(b), x))


def subset(a: Column, b: Column) -> Column:
    return F.forall(lowered(a), lambda x: F.array_contains(lowered(b), x))


def normalise_type(kind: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(kind, r"\[([A-Za-z_]\w*)\]", "$1"), r"\s+", " ")


def unquote_string(s: Column) -> Column:
    inner = F.regexp_replace(F.substring(s, F.lit(2), F.length(s) - 2), "''", "'")
    return F.when(s.startswith("'") & s.endswith("'"), F.regexp_replace(inner, r"\\(.)", "$1")).otherwise(s)


def is_auto_increment(kind: Column, default: Column) -> Column:
    return kind.rlike(r"(?i)^(small|big)?serial\d?$") | F.coalesce(default.rlike(r"(?i)nextval\s*\("), F.lit(False))


def relationship_id(child: Column, columns: Column, parent: Column) -> Column:
    return F.concat(child, F.lit("("), F.array_join(columns, ","), F.lit(")->"), parent)


def relationship_label(columns: Column) -> Column:
    return F.array_join(columns, ", ")


def key_label(pk: Column, fk: Column, unique: Column, unique_name: str = "UQ") -> Column:
    return F.concat_ws(", ", F.when(pk, "PK"), F.when(fk, "FK"), F.when(unique & ~pk, unique_name))


def markdown(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), r"\|", r"\\\\|"), "\n", " ")


def safe_id(name: Column) -> Column:
    out = F.regexp_replace(name, "[^A-Za-z0-9_]", "_")
    return F.when(out.rlike("^[A-Za-z_]"), out).otherwise(F.concat(F.lit("_"), out))


def quoted_label(text: Column) -> Column:
    return F.regexp_replace(text, '"', "#quot;")


def er_type(kind: Column) -> Column:
    out = F.regexp_replace(F.regexp_replace(F.regexp_replace(kind, r"\s+", "_"), ",", "_"), r"[^\w\-()\[\]]", "")
    return F.when(F.length(out) > 0, out).otherwise("unknown")


def class_type(kind: Column) -> Column:
    known = F.when(F.length(kind) > 0, kind).otherwise("unknown")
    return F.regexp_replace(F.translate(known, "()", "[]"), "[{}~]", "")


def er_edge(cardinality: Column, optional: Column, identifying: Column) -> Column:
    return F.concat(
        F.when(cardinality == "one-to-one", "|o").otherwise("}o"), F.when(identifying, "--").otherwise(".."), F.when(optional, "o|").otherwise("||"))


def cardinality_sentence(cardinality: Column, optional: Column) -> Column:
    parent = F.when(optional, "zero or one").otherwise("exactly one")
    most = F.when(cardinality == "one-to-one", "at most one").otherwise("many")
    return F.concat(F.lit("Each row has "), parent, F.lit(" parent; parent has "), most)


def format_bytes(n: Column) -> Column:
    """Bytes for people: B to TB, one decimal under 10."""
    out = F.concat(n.cast("string"), F.lit(" B"))
    for power, unit in enumerate(("KB", "MB", "GB", "TB"), 1):
        v = n / float(1024**power)
        text = F.when(v < 10, F.format_string("%.1f", v)).otherwise(F.floor(v + 0.5).cast("string"))
        out = F.when(n >= 1024**power, F.concat(text, F.lit(f" {unit}"))).otherwise(out)
    return out


def file_format_label(label: Column, entries: Column) -> Column:
    """A file's layers_label(), with the number of its entries if it is an archive; null without layers."""
    return F.when(label.rlike("(^|→ )(zip|tar)$"), F.concat(label, F.lit(" · "), entries.cast("string"), F.lit(" .sql"))).otherwise(label)


def layers_label(layers: Column) -> Column:
    """Outer layers up to the first archive, joined by arrows."""
    at = F.array_position(F.transform(layers, lambda x: x.isin("zip", "tar")), True).cast("int")
    return F.array_join(F.when(at > 0, F.slice(layers, F.lit(1), F.greatest(at, F.lit(1)))).otherwise(layers), " → ")
