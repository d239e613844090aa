"""Line dedup by a log-template tree, in DataFrame functions only.

A line's leaf in the tree of fixed depth is its number of tokens and its first tokens, where tokens with
digits count as variable. A leaf holds any number of templates. A line starts as its tokens with those
that hold digits masked (as its raw tokens, if that would leave less than `min_constant` of them). A
position beyond the leading ones is a variable field of a line if at least `min_values` different lines
of its leaf, itself included, agree everywhere else; it becomes a wildcard, and the lines that come of it
are looked at once more, for a second field. What other lines a leaf holds does not matter, so more data
finds more templates, never fewer, and prose that shares an opening does not melt into wildcards.

A template recurs if lines of at least two different texts have it; if it has fewer than `long_line`
tokens, of at least `min_docs`: on the documents of sf0.1 186 lines of one or two tokens recur in just two
texts ("To.", "And."), against 106 lines of 50 or more. All lines of recurring templates are dropped.

Each text is split and masked once, into a table; all counting reads hashes from it, and only lines of
leaves with `min_values` or more different lines are cut into tokens. Tables of recurring lines are sent
to all tasks if the size of their files allows it, and joined by a shuffle otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import whole_row, written

MIN_DOCS, LONG_LINE, DEPTH, MIN_VALUES, MIN_CONSTANT, ROUNDS = 5, 5, 3, 5, 0.5, 2
ANY = "<*>"
#: A token with a digit, from its first character on.
WITH_DIGIT = r"(?<![^ ])[^ 0-9]*+[0-9][^ ]*"


def _times(line: Column, what: str) -> Column:
    """How often `what` stands in a line."""
    return (F.length(line) - F.length(F.replace(line, F.lit(what)))) / len(what)


def _enough(line: Column, n: Column, min_constant: float) -> Column:
    return n - _times(line, ANY) >= min_constant * n


def _lines(docs: DataFrame, depth: int, min_constant: float) -> DataFrame:
    """doc_id, text_hash, pos, n (tokens), leaf, line (masked), h (its hash) of every line with a token."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = docs.select("doc_id", F.xxhash64(text).alias("text_hash"), F.posexplode(F.split(text, "\n")).alias("pos", "line"))
    plain = F.trim(F.translate("line", "\t\r\f", "   "))
    lines = lines.withColumn("line", plain).where("line <> ''")
    lines = lines.withColumn("line", F.when(F.instr("line", "  ") > 0, F.regexp_replace("line", " +", " ")).otherwise(F.col("line")))
    lines = lines.withColumn("n", _times(F.col("line"), " ").cast("int") + 1)
    masked = F.when(F.col("line").rlike("[0-9]"), F.regexp_replace("line", WITH_DIGIT, ANY)).otherwise(F.col("line"))
    lines = lines.withColumn("masked", masked).withColumn("leaf", F.xxhash64("n", F.substring_index("masked", " ", depth)))
    lines = lines.withColumn("line", F.when(_enough(F.col("masked"), F.col("n"), min_constant), F.col("masked")).otherwise(F.col("line"))).drop("masked")
    return written(lines.withColumn("h", F.xxhash64("line")))


def _generalised(lines: DataFrame, depth: int, min_values: int, min_constant: float) -> DataFrame:
    """leaf, h, line of different lines -> leaf, h, to, line: the lines in which fields are found, with the hash and
    the text of what they become. A written table."""
    tokens = lines.withColumn("tokens", F.split("line", " ")).withColumn("hashes", F.transform("tokens", lambda t, i: F.xxhash64(i, t)))
    whole = F.aggregate("hashes", F.lit(0).cast("long"), lambda a, x: a.bitwiseXOR(x))
    each = tokens.select("leaf", "h", whole.alias("whole"), F.posexplode("hashes").alias("i", "own")).where(F.col("i") >= depth)
    each = written(each.select("leaf", "h", "i", F.col("whole").bitwiseXOR(F.col("own")).alias("rest")))
    fields = written(each.groupBy("leaf", "i", "rest").count().where(F.col("count") >= min_values).drop("count"))
    own = written(each.join(fields, ["leaf", "i", "rest"], "left_semi").groupBy("leaf", "h").agg(F.collect_set("i").alias("fields")))
    found = tokens.select("leaf", "h", "tokens").join(own, ["leaf", "h"])
    general = F.array_join(F.transform("tokens", lambda t, i: F.when(F.array_contains("fields", i), ANY).otherwise(t)), " ")
    found = found.select("leaf", "h", general.alias("line"), F.size("tokens").alias("n"))
    return written(found.where(_enough(F.col("line"), F.col("n"), min_constant)).select("leaf", "h", F.xxhash64("line").alias("to"), "line"))


def recurring(docs: DataFrame, min_docs: int = MIN_DOCS, long_line: int = LONG_LINE, depth: int = DEPTH, min_values: int = MIN_VALUES,
              min_constant: float = MIN_CONSTANT, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, text_hash, pos of every line to drop (pos counts from 0)."""
    lines = _lines(docs, depth, min_constant)
    seen = written(lines.select("leaf", "h", "n", "text_hash").distinct())
    kinds = written(seen.where(F.col("n") > depth).select("leaf", "h").distinct().groupBy("leaf").count().where(F.col("count") >= min_values).select("leaf"))
    now = written(lines.join(kinds, "leaf", "left_semi").groupBy("leaf", "h").agg(F.first("line").alias("line")))
    names = None  # leaf, h -> to: the lines that have become another template
    for _ in range(rounds):
        found = _generalised(now, depth, min_values, min_constant)
        fresh = found.select("leaf", "h", "to")
        if names is None:
            names = fresh
        else:
            step = fresh.select("leaf", F.col("h").alias("to"), F.col("to").alias("next"))
            moved = names.join(step, ["leaf", "to"], "left").select("leaf", "h", F.coalesce("next", "to").alias("to"))
            names = written(moved.unionByName(fresh.join(names.select("leaf", "h"), ["leaf", "h"], "left_anti")))
        kept = now.join(found.select("leaf").distinct(), "leaf", "left_semi").join(fresh, ["leaf", "h"], "left_anti").select("leaf", "h", "line")
        now = written(kept.unionByName(found.select("leaf", F.col("to").alias("h"), "line")).dropDuplicates(["leaf", "h"]))
    named = seen.join(names, ["leaf", "h"], "left").select("leaf", "h", "n", "text_hash", F.coalesce("to", "h").alias("to"))
    often = F.when(F.col("n") >= long_line, 2).otherwise(min_docs)
    often = written(named.select("leaf", "to", "n", "text_hash").distinct().groupBy("leaf", "to", "n").count().where(F.col("count") >= often).select("leaf", "to"))
    gone = written(named.join(often, ["leaf", "to"], "left_semi").select("leaf", "h").distinct())
    return lines.select("doc_id", "text_hash", "pos", "leaf", "h").join(gone, ["leaf", "h"], "left_semi").select("doc_id", "text_hash", "pos")


def clean(docs: DataFrame, **how) -> DataFrame:
    """One row per row of `docs`: its columns as struct `row`, doc_id, n_lines, n_dropped and
    clean_text, the text without the dropped lines (null for null text).

    Lines are split at newlines, tokens at blanks, tabs, returns and form feeds; lines without tokens always
    stay. Rows with equal doc_id and text count as one document and get the same result; rows of one doc_id
    with different texts, or with a null doc_id, are documents of their own; exact copies count as one text.
    No rows give no rows."""
    gone = recurring(docs, **how).groupBy("doc_id", "text_hash").agg(F.collect_set("pos").alias("gone"))
    gone = written(gone.select(F.col("doc_id").alias("id"), F.col("text_hash").alias("hash"), "gone"))
    rows = docs.select(whole_row(docs).alias("row"), F.col("doc_id").alias("doc_id"), F.col("text").alias("text"))
    rows = rows.withColumn("text_hash", F.xxhash64(F.coalesce("text", F.lit(""))))
    on = F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("text_hash") == F.col("hash"))
    rows = rows.join(gone, on, "left")
    kept = F.filter(F.split("text", "\n"), lambda line, i: ~F.array_contains("gone", i))
    n_lines = F.length("text") - F.length(F.replace("text", F.lit("\n"))) + 1
    return rows.select(
        "row", "doc_id", F.coalesce(n_lines, F.lit(0)).cast("long").alias("n_lines"),
        F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_dropped"),
        F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n")).alias("clean_text"))
