"""URL filters: fixed rules first, then a path-template tree judged by labelled purity.

The tree is built level by level with DataFrame aggregations over distinct (host, path shape) rows, as
deep as paths go. Digits are variable in any segment. At a node with more than `max_children` children,
children with less than `min_share` of its pages become a wildcard. Siblings are alike in shape if their
pages are within the same power of ten, have as many kinds of next segments (none, one, few, many), the
same share of next segments with digits and the same mean depth below them (both rounded). Siblings alike
in shape merge into one branch; labelled ones of different smoothed purity (in tenths) keep apart, and
unlabelled ones then stay by themselves. A template that holds one shape, or fewer pages than it would
need labels, is not cut further; the rest of its paths is part of its name.

Pages that a rule decides are the labelled examples. A branch's smoothed purity is (blocked + strength *
the parent's purity) / (labelled + strength), from the host down. A template is rejected if it has at
least `min_labelled` labelled pages, these are at least `min_known` of its pages, and its purity reaches
`reject`; so unlabelled pages are blocked where most pages alike are known and nearly all of those are bad.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, hot_join, written

#: Rules as (host, path, verdict); a rule fits its host and all subdomains.
RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)
MAX_CHILDREN, MIN_SHARE, STRENGTH, MIN_LABELLED, MIN_KNOWN, REJECT = 20, 0.05, 4.0, 5, 0.5, 0.8


def parse(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty if it is null or has no `://`."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url)))
    host = F.regexp_extract(rest, "^([^/?#]*)", 1)
    path = F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)
    return F.coalesce(ascii_lower(host), F.lit("")), F.coalesce(path, F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, as text, and its verdict; null if none fits."""
    texts = verdicts = None
    for own, start, verdict in sorted(rules, key=lambda r: -len(r[0] + r[1])):
        fits = ((host == own) | host.endswith("." + own)) & path.startswith(start)
        texts = F.when(fits, own + start) if texts is None else texts.when(fits, own + start)
        verdicts = F.when(fits, verdict) if verdicts is None else verdicts.when(fits, verdict)
    return (texts, verdicts) if rules else (F.lit(None).cast("string"), F.lit(None).cast("string"))


def shape(path: Column) -> Column:
    """The path's segments with digits as #."""
    return F.split(F.regexp_replace(F.regexp_replace(path, "^/", ""), "[0-9]+", "#"), "/")


def _counts() -> list[Column]:
    return [F.sum(c).alias(c) for c in ("n", "labelled", "blocked")]


def _smooth(prior: str, strength: float) -> Column:
    return (F.col("blocked") + strength * F.col(prior)) / (F.col("labelled") + strength)


def _level(rows: DataFrame, level: int, max_children: int, min_share: float, strength: float, min_labelled: int) -> DataFrame:
    """Open rows of the tree (a written table) one segment further; `done` marks those that are not cut again."""
    node, child, branch = ["host", "template"], ["host", "template", "segment"], ["host", "template", "general"]
    rows = rows.withColumn("segment", F.get("segments", F.lit(level)))
    children = written(rows.groupBy(*child).agg(F.sum("n").alias("n")))
    nodes = children.groupBy(*node).agg(F.count(F.lit(1)).alias("n_children"), F.sum("n").alias("n_node"))
    wild = (F.col("n_children") > max_children) & (F.col("n") < min_share * F.col("n_node"))
    children = hot_join(children, nodes, node, "segment").withColumn("general", F.when(wild, "*").otherwise(F.col("segment")))
    rows = written(hot_join(rows, children.select(*child, "general"), child, "segments"))

    after = rows.withColumn("next", F.get("segments", F.lit(level + 1))).withColumn("below", F.col("n") * (F.size("segments") - level - 1))
    after = after.groupBy(*branch, "next").agg(*_counts(), F.sum("below").alias("below"), F.max("purity").alias("above"))
    found = after.groupBy(*branch).agg(
        F.count("next").alias("kinds"), F.sum(F.when(F.contains("next", F.lit("#")), F.col("n")).otherwise(0)).alias("digits"), F.sum("below").alias("below"),
        F.max("above").alias("above"), *_counts())
    kinds = F.when(F.col("kinds") <= 1, F.col("kinds").cast("string")).when(F.col("kinds") <= max_children, "few").otherwise("many")
    rounded = lambda c: F.floor(c + 0.5).cast("string")
    like = F.concat_ws(".", F.length(F.col("n").cast("string")).cast("string"), kinds, rounded(10 * F.col("digits") / F.col("n")), rounded(F.col("below") / F.col("n")))
    like = F.when(F.col("general").isin("*", ""), F.col("general")).otherwise(like)
    known = F.when(F.col("labelled") > 0, F.floor(_smooth("above", strength) * 10))
    found = written(found.withColumn("like", like).withColumn("known", known))
    known = found.groupBy(*node, "like").agg(F.min("known").alias("least"), F.max("known").alias("most"))
    found = hot_join(found, known, [*node, "like"], "general")
    joins = F.when(F.col("least") == F.col("most"), F.col("most"))
    found = written(found.withColumn("profile", F.concat_ws(".", "like", F.coalesce(F.coalesce("known", joins).cast("string"), F.lit("u")))))
    alike = found.groupBy(*node, "profile").agg(F.count(F.lit(1)).alias("alike"), *_counts(), F.max("above").alias("above"))
    alike = alike.select(*node, "profile", "alike", _smooth("above", strength).alias("own"))
    name = F.when(F.col("alike") > 1, F.concat(F.lit("{"), "profile", F.lit("}"))).otherwise(F.col("general"))
    merged = hot_join(found.select(*branch, "profile"), alike, [*node, "profile"], "general").select(*branch, name.alias("name"), "own")
    rows = hot_join(rows, written(merged), branch, "segments")
    rows = written(rows.select("host", "segments", "n", "labelled", "blocked", F.concat("template", F.lit("/"), "name").alias("template"), F.col("own").alias("purity")))

    held = rows.groupBy(*node).agg(F.sum("n").alias("n_held"), F.count(F.lit(1)).alias("shapes"))
    rows = hot_join(rows, held, node, "segments")
    rest = F.array_join(F.slice("segments", F.lit(level + 2), F.size("segments")), "/")
    done = (F.size("segments") == level + 1) | (F.col("shapes") == 1) | (F.col("n_held") < min_labelled)
    template = F.when(done & (F.size("segments") > level + 1), F.concat("template", F.lit("/"), rest)).otherwise(F.col("template"))
    return written(rows.select("host", "segments", "n", "labelled", "blocked", template.alias("template"), "purity", done.alias("done")))


def templates(shapes: DataFrame, max_children: int = MAX_CHILDREN, min_share: float = MIN_SHARE, strength: float = STRENGTH, min_labelled: int = MIN_LABELLED) -> DataFrame:
    """host, segments, n, labelled, blocked (a written table) -> host, segments, template, n, labelled and blocked
    pages of the template, purity."""
    whole = F.when(F.sum("labelled") > 0, F.sum("blocked") / F.sum("labelled")).otherwise(0.0)
    prior = shapes.agg(whole.alias("prior")).first()["prior"]
    hosts = shapes.groupBy("host").agg(*_counts()).withColumn("prior", F.lit(prior))
    open_rows = written(hot_join(shapes, hosts.select("host", _smooth("prior", strength).alias("purity")), ["host"], "segments").withColumn("template", F.lit("")))
    level, ended = 0, []
    while level == 0 or not open_rows.isEmpty():
        rows = _level(open_rows, level, max_children, min_share, strength, min_labelled)
        ended.append(rows.where("done").drop("done"))
        open_rows, level = rows.where("not done").drop("done"), level + 1
    tree = ended[0]
    for more in ended[1:]:
        tree = tree.unionByName(more)
    own = tree.groupBy("host", "template").agg(*[F.sum(c).alias(f"t_{c}") for c in ("n", "labelled", "blocked")])
    tree = hot_join(tree.select("host", "segments", "template", "purity"), own, ["host", "template"], "segments")
    return tree.select("host", "segments", "template", F.col("t_n").alias("n"), F.col("t_labelled").alias("labelled"), F.col("t_blocked").alias("blocked"), "purity")


def judge(pages: DataFrame, rules=RULES, min_known: float = MIN_KNOWN, reject: float = REJECT, min_labelled: int = MIN_LABELLED, **tree) -> DataFrame:
    """One row per row of `pages` (columns page_id, url; others are ignored): page_id, host, path, rule,
    verdict, template, purity. Null urls and urls without `://` have an empty host and path, no rule, and are
    allowed unless such urls' template is rejected. Repeated rows repeat. No rows give no rows."""
    host, path = parse(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    rows = rows.select("*", rule.alias("rule"), verdict.alias("ruled"), shape(F.col("path")).alias("segments"))
    shapes = written(rows.groupBy("host", "segments").agg(
        F.count(F.lit(1)).alias("n"), F.count("ruled").alias("labelled"), F.count_if(F.col("ruled") == "block").alias("blocked")))
    found = templates(shapes, min_labelled=min_labelled, **tree)
    rejected = (F.col("labelled") >= min_labelled) & (F.col("labelled") >= min_known * F.col("n")) & (F.col("purity") >= reject)
    found = written(found.select("host", "segments", "template", "purity", F.when(rejected, "block").otherwise("allow").alias("judged")))
    out = hot_join(rows, found, ["host", "segments"], "page_id", shapes.select("host", "segments", "n"))
    return out.select("page_id", "host", "path", "rule", F.coalesce("ruled", "judged").alias("verdict"), "template", "purity")
