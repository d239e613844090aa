"""DuckDB SQL for the queries that SQL can express."""

from . import line_dedup as ld
from . import merkle, mixing, url_tree
from .common import LOWER, UPPER

def _rounds() -> str:
    """One group of CTEs for each look at the lines of a leaf, from now0 (leaf, line) and names0."""
    out = []
    for r in range(ld.ROUNDS):
        out.append(f"""
each{r} AS (
  SELECT leaf, line, i, array_to_string(list_transform(string_split(line, ' '), lambda t, j: CASE WHEN i = j THEN '' ELSE t END), ' ') AS rest
  FROM (SELECT leaf, line, unnest(range({ld.DEPTH + 1}, len(string_split(line, ' ')) + 1)) AS i FROM now{r})),
fields{r} AS (SELECT leaf, i, rest FROM each{r} GROUP BY ALL HAVING count(*) >= {ld.MIN_VALUES}),
own{r} AS (SELECT leaf, line, list(i) AS fields FROM each{r} SEMI JOIN fields{r} USING (leaf, i, rest) GROUP BY leaf, line),
made{r} AS (SELECT leaf, line, array_to_string(list_transform(string_split(line, ' '), lambda t, j: CASE WHEN list_contains(fields, j) THEN '{ld.ANY}' ELSE t END), ' ') AS became FROM own{r}),
found{r} AS (SELECT * FROM made{r} WHERE {_ENOUGH.format("became", "len(string_split(became, ' '))")}),
names{r + 1} AS (
  SELECT n.leaf, n.line, coalesce(f.became, n.became) AS became FROM names{r} n LEFT JOIN found{r} f ON f.leaf = n.leaf AND f.line = n.became
  UNION ALL SELECT leaf, line, became FROM found{r} ANTI JOIN names{r} USING (leaf, line)),
now{r + 1} AS (
  SELECT leaf, line FROM now{r} WHERE leaf IN (SELECT leaf FROM found{r}) AND (leaf, line) NOT IN (SELECT (leaf, line) FROM found{r}) UNION SELECT leaf, became FROM found{r})""")
    return ",".join(out)


_ENOUGH = "{1} - (length({0}) - length(replace({0}, '" + ld.ANY + "', ''))) / " + str(len(ld.ANY)) + " >= " + str(ld.MIN_CONSTANT) + " * {1}"

LINE_DEDUP = rf"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
cut AS (
  SELECT doc_id, text AS whole, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM docs),
plain AS (
  SELECT doc_id, whole, pos, regexp_replace(trim(translate(line, chr(9) || chr(13) || chr(12), '   '), ' '), ' +', ' ', 'g') AS line FROM cut),
sized AS (
  SELECT *, len(string_split(line, ' ')) AS n, regexp_replace(line, '(^| )[^ 0-9]*[0-9][^ ]*', '{ld.ANY}', 'g') AS masked FROM plain WHERE line <> ''),
lines AS (
  SELECT doc_id, whole, pos, n, concat_ws(' ', n::VARCHAR, array_to_string(string_split(masked, ' ')[1:{ld.DEPTH}], ' ')) AS leaf,
    CASE WHEN {_ENOUGH.format("masked", "n")} THEN masked ELSE line END AS line FROM sized),
now0 AS (
  SELECT DISTINCT leaf, line FROM lines WHERE leaf IN (SELECT leaf FROM lines WHERE n > {ld.DEPTH} GROUP BY leaf HAVING count(DISTINCT line) >= {ld.MIN_VALUES})),
names0 AS (SELECT '' AS leaf, '' AS line, '' AS became WHERE false),
{_rounds()},
named AS (SELECT l.*, coalesce(became, l.line) AS template FROM lines l LEFT JOIN names{ld.ROUNDS} n ON n.leaf = l.leaf AND n.line = l.line),
often AS (SELECT leaf, template FROM named GROUP BY leaf, template, n HAVING count(DISTINCT whole) >= CASE WHEN n >= {ld.LONG_LINE} THEN 2 ELSE {ld.MIN_DOCS} END),
gone AS (SELECT doc_id, whole, list(DISTINCT pos) AS gone FROM named SEMI JOIN often USING (leaf, template) GROUP BY doc_id, whole)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN 0 ELSE len(string_split(d.text, chr(10))) END AS n_lines, coalesce(len(gone), 0) AS n_dropped,
  sha256(CASE WHEN gone IS NULL THEN coalesce(d.text, '')
    ELSE array_to_string(list_filter(string_split(d.text, chr(10)), lambda x, i: NOT list_contains(gone, i)), chr(10)) END) AS clean_sha256
FROM documents d LEFT JOIN gone g ON d.doc_id IS NOT DISTINCT FROM g.doc_id AND coalesce(d.text, '') = g.whole
"""

EXACT_DEDUP = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id IS NOT DISTINCT FROM max(doc_id) OVER w AS kept,
  sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""

_list = lambda xs: "[" + ", ".join(map(str, xs)) + "]"
_SLOPES = _list((b - a) / (a + b) for a, b in mixing.SCHEDULES)


def mixing_sql(documents: str = "documents", name: str = "mixed") -> str:
    """CTEs that end in `name`: all columns of `documents`, size, source_size, target, slope, ahead, h, copies."""
    return rf"""
sized AS (
  SELECT *, coalesce(len(regexp_extract_all(text, '{mixing.WORDS}')), 0) AS size, md5(coalesce(doc_id::VARCHAR, '')) AS h FROM {documents}),
sources AS (SELECT source, sum(size)::HUGEINT AS source_size FROM sized GROUP BY source),
ranked AS (SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1)::INT AS turn FROM sources),
weighed AS (
  SELECT *, {_list(mixing.WEIGHTS)}[turn % {len(mixing.WEIGHTS)} + 1] AS weight,
    {_SLOPES}[turn % {len(mixing.WEIGHTS)} % {len(mixing.SCHEDULES)} + 1]::DOUBLE AS slope, {mixing.MAX_PASSES} * source_size AS cap, sum(source_size) OVER () AS all_words FROM ranked),
levels AS (
  SELECT *, all_words - coalesce(sum(cap) OVER (ORDER BY cap::DOUBLE / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS words_left,
    sum(weight) OVER (ORDER BY cap::DOUBLE / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weight_left FROM weighed),
capped AS (SELECT *, cap * weight_left <= words_left * weight AS capped FROM levels),
plan AS (
  SELECT source, source_size, slope, CASE WHEN capped THEN cap::DOUBLE ELSE weight * (
    (all_words - sum(CASE WHEN capped THEN cap ELSE 0 END) OVER ())::DOUBLE / sum(CASE WHEN capped THEN 0 ELSE weight END) OVER ()) END AS target FROM capped),
placed AS (
  SELECT s.*, p.source_size, p.target, p.slope,
    coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY h, doc_id, s.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS ahead
  FROM sized s JOIN plan p ON s.source IS NOT DISTINCT FROM p.source),
{name} AS (
  SELECT *, {" + ".join(f"(2 * ({e} * source_size + ahead) + size <= 2 * target)::INT" for e in range(mixing.MAX_PASSES))} AS copies FROM placed)"""


MIXING = f"""
WITH {mixing_sql()}
SELECT doc_id, size, source_size::BIGINT AS source_size, target, copies * size AS taken,
  CASE WHEN copies > 0 AND target > 0 THEN round(CASE WHEN slope = 0 THEN ahead / target ELSE
    (slope - 1.0::DOUBLE + sqrt((1.0::DOUBLE - slope) * (1.0::DOUBLE - slope) + 4.0::DOUBLE * slope * (ahead / target))) / (2.0::DOUBLE * slope) END, 9) + 0.0::DOUBLE END AS position
FROM mixed
"""


def _rules(what: int) -> str:
    whens = []
    for host, path, verdict in sorted(url_tree.RULES, key=lambda r: -len(r[0] + r[1])):
        then = (host + path, verdict)[what]
        whens.append(f"WHEN (host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '{path}') THEN '{then}'")
    return "CASE " + " ".join(whens) + " END"


#: Segments of the longest path that the SQL below follows; the tree itself goes as deep as paths go.
LEVELS = 6


def _levels() -> str:
    """One group of CTEs for each level of the tree, as templates() does it."""
    u, out = url_tree, []
    smooth = lambda b, n, above: f"(({b} + {u.STRENGTH}::DOUBLE * {above}) / ({n} + {u.STRENGTH}::DOUBLE))"
    for i in range(LEVELS):
        out.append(f"""
at{i} AS (SELECT *, segments[{i + 1}] AS segment FROM tree{i} WHERE NOT done),
child{i} AS (SELECT host, template, segment, sum(n) AS n_child FROM at{i} GROUP BY ALL),
node{i} AS (SELECT host, template, count(*) AS n_children, sum(n_child) AS n_node FROM child{i} GROUP BY ALL),
wild{i} AS (
  SELECT a.*, CASE WHEN n_children > {u.MAX_CHILDREN} AND n_child < {u.MIN_SHARE}::DOUBLE * n_node THEN '*' ELSE a.segment END AS general
  FROM at{i} a JOIN child{i} USING (host, template, segment) JOIN node{i} USING (host, template)),
branch{i} AS (
  SELECT host, template, general, sum(n) AS n, sum(labelled) AS labelled, sum(blocked) AS blocked, max(purity) AS above,
    count(DISTINCT segments[{i + 2}]) AS kinds, sum(CASE WHEN contains(segments[{i + 2}], '#') THEN n ELSE 0 END) AS digits, sum(n * (len(segments) - {i + 1})) AS below
  FROM wild{i} GROUP BY ALL),
like{i} AS (
  SELECT *, CASE WHEN general IN ('*', '') THEN general ELSE concat_ws('.', length(n::BIGINT::VARCHAR)::VARCHAR,
      CASE WHEN kinds <= 1 THEN kinds::VARCHAR WHEN kinds <= {u.MAX_CHILDREN} THEN 'few' ELSE 'many' END,
      floor(10 * digits / n + 0.5::DOUBLE)::BIGINT::VARCHAR, floor(below / n + 0.5::DOUBLE)::BIGINT::VARCHAR) END AS like_,
    CASE WHEN labelled > 0 THEN floor({smooth("blocked", "labelled", "above")} * 10)::BIGINT END AS known FROM branch{i}),
profile{i} AS (
  SELECT *, concat_ws('.', like_, coalesce(coalesce(known, CASE WHEN min(known) OVER w = max(known) OVER w THEN max(known) OVER w END)::VARCHAR, 'u')) AS profile
  FROM like{i} WINDOW w AS (PARTITION BY host, template, like_)),
alike{i} AS (
  SELECT host, template, profile, count(*) AS alike, {smooth("sum(blocked)", "sum(labelled)", "max(above)")} AS own FROM profile{i} GROUP BY ALL),
merged{i} AS (
  SELECT p.host, p.template, p.general, CASE WHEN alike > 1 THEN '{{' || profile || '}}' ELSE general END AS name, own
  FROM profile{i} p JOIN alike{i} USING (host, template, profile)),
made{i} AS (
  SELECT host, segments, n, labelled, blocked, template || '/' || name AS template, own AS purity FROM wild{i} JOIN merged{i} USING (host, template, general)),
tree{i + 1} AS (
  SELECT host, segments, n, labelled, blocked, CASE WHEN done AND len(segments) > {i + 1} THEN template || '/' || array_to_string(segments[{i + 2}:], '/') ELSE template END AS template,
    purity, done FROM (
    SELECT *, len(segments) = {i + 1} OR count(*) OVER w = 1 OR sum(n) OVER w < {u.MIN_LABELLED} AS done FROM made{i} WINDOW w AS (PARTITION BY host, template)))""")
    return ",".join(out)


URL_FILTER = rf"""
WITH cut AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) END AS rest FROM pages),
parsed AS (
  SELECT page_id, coalesce(translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM cut),
rows AS (
  SELECT *, {_rules(0)} AS rule, {_rules(1)} AS ruled,
    string_split(regexp_replace(regexp_replace(path, '^/', ''), '[0-9]+', '#', 'g'), '/') AS segments FROM parsed),
shapes AS (SELECT host, segments, count(*) AS n, count(ruled) AS labelled, count(*) FILTER (ruled = 'block') AS blocked FROM rows GROUP BY ALL),
prior AS (SELECT CASE WHEN sum(labelled) > 0 THEN sum(blocked) / sum(labelled) ELSE 0.0 END::DOUBLE AS prior FROM shapes),
tree0 AS (
  SELECT s.*, '' AS template, h.purity, false AS done FROM shapes s JOIN (
    SELECT host, (sum(blocked) + {url_tree.STRENGTH}::DOUBLE * max(prior)) / (sum(labelled) + {url_tree.STRENGTH}::DOUBLE) AS purity FROM shapes, prior GROUP BY host) h USING (host)),
{_levels()},
tree AS ({" UNION ALL ".join(f"SELECT * FROM tree{i} WHERE done" for i in range(1, LEVELS + 1))}),
own AS (SELECT host, template, sum(n) AS t_n, sum(labelled) AS t_labelled FROM tree GROUP BY ALL)
SELECT page_id, r.host, path, rule, coalesce(ruled, CASE WHEN t_labelled >= {url_tree.MIN_LABELLED} AND t_labelled >= {url_tree.MIN_KNOWN}::DOUBLE * t_n
  AND purity >= {url_tree.REJECT} THEN 'block' ELSE 'allow' END) AS verdict, t.template
FROM rows r JOIN tree t ON r.host = t.host AND r.segments = t.segments JOIN own o ON t.host = o.host AND t.template = o.template
"""

ORACLES = {"op1_line_dedup": LINE_DEDUP, "op5_exact_dedup": EXACT_DEDUP, "op6_mixing": MIXING, "op9_url_filter": URL_FILTER}


def _nodes(name: str, n: int) -> str:
    """CTEs of the levels {name}0 (tree, pos, total, digest) to {name}{n} and of what stands beside each node ({name}_at0 ...)."""
    out = []
    for i in range(n):
        out.append(f"""
{name}_at{i} AS (
  SELECT tree, pos, total, coalesce(string_agg(digest, '') OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
    coalesce(string_agg(digest, '') OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r
  FROM {name}{i} WINDOW w AS (PARTITION BY tree, pos // {merkle.FAN} ORDER BY pos)),
{name}{i + 1} AS (
  SELECT tree, pos // {merkle.FAN} AS pos, any_value((total + {merkle.FAN - 1}) // {merkle.FAN}) AS total,
    CASE WHEN any_value(total) = 1 THEN any_value(digest) ELSE sha256(string_agg(digest, '' ORDER BY pos)) END AS digest
  FROM {name}{i} GROUP BY 1, 2)""")
    return ",".join(out)


def _walk(name: str, n: int, source: str) -> str:
    """CTEs that carry rows (tree, at_pos, proof, folded, ...) from `source` up the levels of `name`."""
    out = []
    for i in range(n):
        out.append(f"""
{name}_up{i} AS (
  SELECT f.* REPLACE (at_pos // {merkle.FAN} AS at_pos, CASE WHEN a.total > 1 THEN proof || l || r ELSE proof END AS proof,
    CASE WHEN a.total > 1 THEN sha256(l || folded || r) ELSE folded END AS folded)
  FROM {source if i == 0 else f"{name}_up{i - 1}"} f JOIN {name}_at{i} a ON a.tree = f.tree AND a.pos = f.at_pos)""")
    return ",".join(out)


_field = lambda c: f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen({c}::VARCHAR) || ':' || {c} END"
_LEAF = " || ".join(_field(c) for c in merkle.FIELDS)
_LOW = f"translate(text, '{UPPER}', '{LOWER}')"
#: CRC-32 with its usual polynomial, bit by bit: each byte is followed by eight steps (-1).
_CRC = """xor(4294967295, list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: [unicode(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
  lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) ELSE xor(c >> 1, 3988292384 * (c & 1)) END))"""
#: Levels for up to a thousand million rows a lang and 4,096 langs.
_DEEP, _TOP = 10, 4

MERKLE = f"""
WITH leaves AS (
  SELECT doc_id, CASE WHEN lang IS NULL THEN '-' ELSE '=' || lang END AS tree, sha256({_LEAF}) AS leaf,
    CASE WHEN {_CRC} % 3 = 0 THEN sha256({_LEAF.replace("text", _LOW)}) END AS tampered FROM documents),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY tree) AS total FROM leaves),
n0 AS (SELECT tree, pos, total, leaf AS digest FROM placed),
{_nodes("n", _DEEP)},
m0 AS (SELECT '' AS tree, row_number() OVER (ORDER BY tree) - 1 AS pos, count(*) OVER () AS total, digest, tree AS of FROM n{_DEEP}),
{_nodes("m", _TOP)},
start AS (SELECT doc_id, leaf, tree, pos AS at_pos, '' AS proof, coalesce(tampered, leaf) AS folded FROM placed),
{_walk("n", _DEEP, "start")},
middle AS (SELECT u.* REPLACE ('' AS tree, m0.pos AS at_pos), digest AS subroot FROM n_up{_DEEP - 1} u JOIN m0 ON of = u.tree),
{_walk("m", _TOP, "middle")}
SELECT doc_id, leaf, subroot, digest AS root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = digest AS verified
FROM m_up{_TOP - 1}, m{_TOP}
"""

ORACLES["op12_merkle_manifest"] = MERKLE
