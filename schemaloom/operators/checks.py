"""The catalog's facts checked on actual rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, DateType, DoubleType, FloatType, NumericType, StringType, TimestampType


def observed_nullable(df: DataFrame, cols: list[str]) -> DataFrame:
    """column_name, n_null, nullable, from one pass."""
    counts = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in cols])
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("n_null")) for c in cols]))
    return counts.select(pairs.alias("p")).select("p.column_name", "p.n_null", (F.col("p.n_null") > 0).alias("nullable"))


def key_violations(df: DataFrame, key: list[str]) -> DataFrame:
    """Keys that occur more than once or hold a null, with their number of rows."""
    null = reduce(lambda a, b: a | b, [F.col(c).isNull() for c in key])
    return df.groupBy(*key).agg(F.count(F.lit(1)).alias("n_rows")).where((F.col("n_rows") > 1) | null)


def orphans(child: DataFrame, fk: list[str], parent: DataFrame, pk: list[str]) -> DataFrame:
    """Rows whose reference (no column null) has no parent."""
    full = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in fk])
    known = parent.select(*[F.col(p).alias(f) for f, p in zip(fk, pk)])
    return child.where(full).join(known, fk, "left_anti")


def observed_cardinality(child: DataFrame, fk: list[str]) -> DataFrame:
    """max_children, null_rows, cardinality, optional: one aggregation by the key, one over its result."""
    null = reduce(lambda a, b: a | b, [F.col(c).isNull() for c in fk])
    each = child.groupBy(*fk).agg(F.count(F.lit(1)).alias("n")).withColumn("null", null)
    out = each.agg(F.coalesce(F.max(F.when(~F.col("null"), F.col("n"))), F.lit(0)).alias("max_children"), F.coalesce(F.sum(F.when(F.col("null"), F.col("n"))), F.lit(0)).alias("null_rows"))
    return out.select("*", F.when(F.col("max_children") <= 1, "one-to-one").otherwise("many-to-one").alias("cardinality"), (F.col("null_rows") > 0).alias("optional"))


def observed_optional(child: DataFrame, fk: list[str]) -> DataFrame:
    null = reduce(lambda a, b: a | b, [F.col(c).isNull() for c in fk])
    return child.agg((F.count_if(null) > 0).alias("optional"))


def observed_link_pairs(link: DataFrame, a: str, b: str) -> DataFrame:
    """n_pairs, max_b_of_a, max_a_of_b over the distinct pairs of two parents."""
    pairs = link.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(a, b).distinct()
    most = lambda c, n: pairs.groupBy(c).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n").alias(n))
    return pairs.agg(F.count(F.lit(1)).alias("n_pairs")).crossJoin(most(a, "max_b_of_a")).crossJoin(most(b, "max_a_of_b"))  # one row each


VERIFIED = "relationship string, declared string, observed string, declared_optional boolean, observed_optional boolean, max_children long, null_rows long, n_orphans long"


def _canonical(c: Column, own: DataType, other: DataType) -> Column:
    """A key column as a string that is equal for equal values, also of two types that Spark compares by casting."""
    numeric, when = any(isinstance(x, NumericType) for x in (own, other)), any(isinstance(x, (DateType, TimestampType)) for x in (own, other))
    if numeric:
        if isinstance(own, (StringType, FloatType, DoubleType)):
            c = F.coalesce(c.try_cast("decimal(38,18)").cast("string"), c.cast("string"))
        return F.regexp_replace(F.regexp_replace(c.cast("string"), r"(\.[0-9]*?)0+$", "$1"), r"\.$", "")
    return (c.cast("timestamp") if when else c).cast("string")


def _type(df: DataFrame, name: str) -> DataType:
    return next(f.dataType for f in df.schema if f.name.lower() == name.lower())


def verify_catalog(spark: SparkSession, relationships: list[dict], tables: dict[str, DataFrame]) -> DataFrame:
    """Every declared relationship (rel_id, from_table, from_columns, to_table, to_columns, cardinality, optional) between tables at hand beside
    what their rows show.

    Each table is read once as a child, its keys counted by grouping sets on their own types, and once for each key that others refer to. All
    counted keys then meet all parents' keys in one join, in a form that is equal for equal values of different types. No relationships
    give no rows."""
    declared = [r for r in relationships if r["from_table"] in tables and r["to_table"] in tables]
    if not declared:
        return spark.createDataFrame([], VERIFIED)
    by: dict[str, list[tuple[int, dict]]] = {}
    for i, r in enumerate(declared):
        by.setdefault(r["from_table"], []).append((i, r))
    counted, parents = [], {}
    for name, mine in by.items():
        child = tables[name]
        sets = list(dict.fromkeys(tuple(c.lower() for c in r["from_columns"]) for _, r in mine))
        columns = list(dict.fromkeys(c for s in sets for c in s))
        # One more column of constants for each set tells the sets apart, whatever nulls their keys hold.
        marks = [f"_set{k}" for k in range(len(sets))]
        slim = child.select(*[F.col(c).alias(f"_{columns.index(c)}") for c in columns], *[F.lit(1).alias(m) for m in marks])
        grouped = slim.groupingSets([[F.col(m), *[F.col(f"_{columns.index(c)}") for c in s]] for m, s in zip(marks, sets)], *[F.col(f"_{k}") for k in range(len(columns))], *[F.col(m) for m in marks])
        grouped = grouped.agg(F.count(F.lit(1)).alias("n"))
        rows = []
        for i, r in mine:
            own = tuple(c.lower() for c in r["from_columns"])
            pairs = [(_type(child, a), _type(tables[r["to_table"]], b)) for a, b in zip(r["from_columns"], r["to_columns"])]
            shape = (r["to_table"], tuple(c.lower() for c in r["to_columns"]), tuple(a.simpleString() for a, _ in pairs))
            j, _ = parents.setdefault(shape, (len(parents), [(b, a) for a, b in pairs]))
            k = F.array(*[_canonical(F.col(f"_{columns.index(c)}"), *types) for c, types in zip(own, pairs)])
            rows.append(F.when(F.col(marks[sets.index(own)]) == 1, F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), k.alias("k"))))
        counted.append(grouped.select("n", F.explode(F.array_compact(F.array(*rows))).alias("e")).select("e.i", "e.j", "e.k", "n"))
    null = ~F.forall("k", lambda v: v.isNotNull())
    counted = reduce(DataFrame.unionByName, counted).withColumn("k", F.when(~null, F.col("k")))
    known = [
        tables[name].select(F.lit(j).alias("j"), F.array(*[_canonical(F.col(c), *t) for c, t in zip(columns, types)]).alias("k"), F.lit(True).alias("known"))
        for (name, columns, _), (j, types) in parents.items()]
    met = counted.join(reduce(DataFrame.unionByName, known).dropDuplicates(["j", "k"]), ["j", "k"], "left")
    null = F.col("k").isNull()
    seen = met.groupBy("i").agg(
        F.coalesce(F.max(F.when(~null, F.col("n"))), F.lit(0)).alias("max_children"), F.coalesce(F.sum(F.when(null, F.col("n"))), F.lit(0)).alias("null_rows"),
        F.coalesce(F.sum(F.when(~null & F.col("known").isNull(), F.col("n"))), F.lit(0)).alias("n_orphans"))
    said = spark.createDataFrame([(i, r["rel_id"], r["cardinality"], r["optional"]) for i, r in enumerate(declared)], "i int, relationship string, declared string, declared_optional boolean")
    out = said.join(seen, "i", "left").fillna(0)
    return out.select(
        "relationship", "declared", F.when(F.col("max_children") <= 1, "one-to-one").otherwise("many-to-one").alias("observed"), "declared_optional",
        (F.col("null_rows") > 0).alias("observed_optional"), "max_children", "null_rows", "n_orphans")
