"""DuckDB SQL for the registered queries: expected results from the same rows, without reading any DDL."""

TREE = """
WITH k AS (SELECT 'p' || (doc_id // 250) AS project, doc_id % 250 AS k, doc_id % 250 >= 2 AND doc_id % 250 % 11 = 0 AS linked FROM documents WHERE doc_id IS NOT NULL),
e AS (
  SELECT project, k, linked, k // 2 AS p, 'a_id' AS c, NOT (k % 3 = 0 OR linked) AS optional, false AS one FROM k WHERE k > 0 AND k % 7 <> 0
  UNION ALL SELECT project, k, linked, k - 1, 'b_id', NOT linked, k % 5 = 0 FROM k WHERE k > 0),
r AS (
  SELECT e.*, 't' || e.k AS child, 't' || e.p AS parent, CASE WHEN c = 'a_id' THEN CASE WHEN e.p > 0 OR true THEN 'id' END
    WHEN q.linked THEN 'a_id,b_id' ELSE 'id' END AS to_cols FROM e JOIN k q ON e.project = q.project AND e.p = q.k)
"""

NULLABLE = "(NOT (name IN ('name') OR (name = 'id' AND NOT linked) OR (name = 'a_id' AND (k % 3 = 0 OR linked)) OR (name = 'b_id' AND linked)))"
COLUMNS = f""",
cols AS (
  SELECT k.*, 't' || k AS table_id, u.pos AS position, u.name, u.type FROM k, (VALUES (1, 'id', 'bigint'), (2, 'name', 'text'), (3, 'a_id', 'bigint'), (4, 'b_id', 'bigint'), (5, 'extra', 'decimal(10, 2)')) u(pos, name, type)
  WHERE (k > 0 OR u.name NOT IN ('a_id', 'b_id')) AND (k % 13 = 0 OR u.name <> 'extra')),
flags AS (
  SELECT *, {NULLABLE} AS nullable, (name = 'id' AND NOT linked) OR (name IN ('a_id', 'b_id') AND linked) AS pk, name = 'b_id' AND k % 5 = 0 AS uq,
    coalesce(CASE WHEN name = 'a_id' AND k % 7 <> 0 THEN 't' || (k // 2) || '.id'
      WHEN name = 'b_id' THEN 't' || (k - 1) || CASE WHEN k - 1 >= 2 AND (k - 1) % 11 = 0 THEN '.a_id' ELSE '.id' END END, '') AS ref FROM cols)
"""

_card = "CASE WHEN one THEN 'one-to-one' ELSE 'many-to-one' END"
RELATIONSHIPS = TREE + """
SELECT project, child, c AS child_columns, parent, replace(to_cols, ',', ', ') AS parent_columns, CASE WHEN one THEN '1 : 1' ELSE 'N : 1' END AS ratio, optional, linked AS identifying,
  false AS self_reference, CASE WHEN c = 'b_id' THEN 'SET NULL' ELSE '—' END AS on_delete, '—' AS on_update, CASE WHEN c = 'b_id' THEN 'fk_b' END AS constraint_name,
  'Each row has ' || CASE WHEN optional THEN 'zero or one' ELSE 'exactly one' END || ' parent; parent has ' || CASE WHEN one THEN 'at most one' ELSE 'many' END AS meaning
FROM r
"""

ROLES = """, d AS (
  SELECT k.project, 't' || k.k AS table_id, linked AND k % 7 <> 0 AS junction, (SELECT count(*) FROM r WHERE r.project = k.project AND r.k = k.k) AS n_out,
    (SELECT count(*) FROM r WHERE r.project = k.project AND r.p = k.k) AS n_in FROM k)
"""

ORACLES = {
    "tree_relationships": RELATIONSHIPS,
    "tree_tables": TREE + COLUMNS + """
SELECT project, 't' || k AS table_id, 'f' || (k % 4 + CASE WHEN k % 13 = 0 THEN 1 ELSE 0 END) AS source, CASE WHEN linked THEN 'a_id,b_id' ELSE 'id' END AS primary_key,
  CASE WHEN k > 0 AND k % 5 = 0 THEN 1 ELSE 0 END AS n_uniques, linked AND k % 7 <> 0 AS is_junction, (SELECT count(*) FROM cols c WHERE c.project = k.project AND c.k = k.k) AS n_columns FROM k
""",
    "tree_connectivity": TREE + ROLES + """
SELECT project, table_id, n_out, n_in, CASE WHEN junction THEN 'Link table' WHEN n_in = 0 AND n_out = 0 THEN 'Isolated' WHEN n_out = 0 THEN 'Root / lookup'
  WHEN n_in = 0 THEN 'Leaf' ELSE 'Intermediate' END AS role FROM d
""",
    "tree_many_to_many": TREE + "SELECT project, 't' || k AS via, 't' || (k // 2) AS a, 't' || (k - 1) AS b FROM k WHERE linked AND k % 7 <> 0",
    "tree_warnings": TREE + """
SELECT project, 'Table "t' || k || '" is defined more than once (f' || (k % 4) || ' and f' || (k % 4 + 1) || '); the last definition is used.' AS message FROM k WHERE k % 13 = 0
UNION ALL SELECT project, 't' || k || ': foreign key references unknown table "missing' || k || '".' FROM k WHERE k > 0 AND k % 7 = 0
""",
    "tree_dictionary": TREE + COLUMNS + """
SELECT project, table_id, row_number() OVER (PARTITION BY project, k ORDER BY position) AS position, name, type, nullable, uq AS "unique",
  concat_ws(', ', CASE WHEN pk THEN 'PK' END, CASE WHEN ref <> '' THEN 'FK' END, CASE WHEN uq AND NOT pk THEN 'UQ' END) AS key, ref,
  '| ' || name || ' | ' || type || ' | ' || concat_ws(', ', CASE WHEN pk THEN 'PK' END, CASE WHEN ref <> '' THEN 'FK' END, CASE WHEN uq AND NOT pk THEN 'UQ' END) || ' | ' ||
  CASE WHEN nullable THEN 'YES' ELSE 'NO' END || ' | ' || CASE WHEN name = 'name' THEN '''a, (b''' ELSE '' END || ' | ' || ref || ' |  |' AS line FROM flags
""",
    "tree_search": TREE + COLUMNS + "SELECT project, table_id, name, contains(name, 't1') AS hit FROM flags WHERE contains(table_id, 't1')",
    "tree_table_sets": TREE + ROLES + """, n AS (
  SELECT DISTINCT project, a, b FROM (SELECT project, k AS a, p AS b FROM r UNION ALL SELECT project, p, k FROM r UNION ALL SELECT project, k, k FROM r UNION ALL SELECT project, p, p FROM r))
SELECT project, count(*) FILTER (n_out = 0) AS roots, count(*) FILTER (n_out = 0 AND n_in = 0) AS isolated, count(*) FILTER (n_out = 0 AND n_in = 0) AS loose,
  count(*) FILTER (n_out + n_in > 0) AS linked, (SELECT count(*) FROM n WHERE n.project = d.project) AS neighbours FROM d GROUP BY project
""",
    "tree_totals": TREE + COLUMNS + """, c AS (
  SELECT project, 1 AS t, 0 AS c, 0 AS r, (k % 13 = 0)::INT + (k > 0 AND k % 7 = 0)::INT AS w FROM k UNION ALL SELECT project, 0, 1, 0, 0 FROM cols UNION ALL SELECT project, 0, 0, 1, 0 FROM r)
SELECT project, sum(t)::BIGINT AS n_tables, sum(c)::BIGINT AS n_columns, sum(r)::BIGINT AS n_relationships, sum(w)::BIGINT AS n_warnings FROM c GROUP BY ROLLUP (project)
""",
    "tree_er_edges": TREE + """
SELECT project, '  ' || child || ' ' || CASE WHEN one THEN '|o' ELSE '}o' END || CASE WHEN linked THEN '--' ELSE '..' END || CASE WHEN optional THEN 'o|' ELSE '||' END || ' ' || parent || ' : "' || c || '"' AS line FROM r
""",
    "tree_class_edges": TREE + """, m AS (SELECT *, CASE WHEN optional THEN '0..1' ELSE '1' END AS lo, CASE WHEN one THEN CASE WHEN optional THEN '0..1' ELSE '1' END ELSE '*' END AS hi FROM r)
SELECT project, CASE WHEN linked THEN '  ' || parent || ' "' || lo || '" *-- "' || hi || '" ' || child || ' : ' || c
  ELSE '  ' || child || ' "' || hi || '" --> "' || lo || '" ' || parent || ' : ' || c END AS line FROM m
""",
    "tree_graph_edges": TREE + """, o AS (SELECT project, k, row_number() OVER (PARTITION BY project ORDER BY k) - 1 AS n FROM k)
SELECT r.project, '  t' || x.n || CASE WHEN optional THEN ' -.->' ELSE ' -->' END || '|"' || c || CASE WHEN one THEN ' (1:1)' ELSE ' (N:1)' END || '"| t' || y.n AS line
FROM r JOIN o x ON x.project = r.project AND x.k = r.k JOIN o y ON y.project = r.project AND y.k = r.p
""",
    "tree_diagram_sizes": TREE + ROLES + COLUMNS + """, s AS (
  SELECT d.project, count(*) AS t, count(*) FILTER (junction) AS j, count(*) FILTER (n_out = 0) AS roots, (SELECT count(*) FROM cols WHERE cols.project = d.project) AS c,
    (SELECT count(*) FROM r WHERE r.project = d.project) AS e FROM d GROUP BY d.project)
SELECT project, unnest(['er', 'class', 'graph', 'dictionary']) AS kind, unnest([1 + 2 * t + c + e, 2 + 2 * t + j + c + e, 1 + t + e + 2 + (roots > 0)::INT + (j > 0)::INT, 2 + 7 * t + c]) AS n_lines FROM s
""",
    "dump_file_reports": r"""
WITH d AS (SELECT coalesce(source, 'none') AS file, doc_id, replace(coalesce(text, ''), '''', '''''') AS t FROM documents),
x AS (SELECT file, 'INSERT INTO docs VALUES (' || doc_id || ', ''' || t || '; CREATE TABLE fake (x int); -- /* $a$'');' || chr(10) AS line, doc_id FROM d),
y AS (
  SELECT file, 'SET standard_conforming_strings = on;' || chr(10) || '-- a dump; CREATE TABLE fake (x int);' || chr(10) || 'CREATE TABLE docs (id bigint PRIMARY KEY, /* ; */ body text);' || chr(10)
    || string_agg(line, '') || 'COPY docs (id) FROM stdin;' || chr(10) || string_agg(doc_id::VARCHAR, chr(9) || ';''' || chr(10)) || chr(10) || '\.' || chr(10) || 'ALTER TABLE docs ADD COLUMN n int;' AS text, count(*) AS n
  FROM x GROUP BY file)
SELECT 'dump' AS project, file, 1 AS tables, 2 AS kept, n + 4 AS statements, n AS inserts, 1 AS copy_blocks, length(text) AS chars, strlen(text) AS text_bytes, 1 AS entries, 'utf-8' AS encoding, n + 1 AS data_skipped FROM y
""",
    "dump_retained_ddl": r"""
SELECT DISTINCT 'dump' AS project, coalesce(source, 'none') AS file, 'CREATE TABLE docs (id bigint PRIMARY KEY,   body text);' || chr(10) || chr(10) || 'ALTER TABLE docs ADD COLUMN n int;' || chr(10) AS ddl FROM documents
""",
    "migration_columns": """
WITH e AS (SELECT *, event_id % 3 AS turn FROM events),
f AS (SELECT user_id, event_type, min((ts, event_id)) AS born FROM e WHERE turn = 0 GROUP BY ALL),
l AS (SELECT e.*, (ts, event_id) AS moment FROM e JOIN f USING (user_id, event_type) WHERE (ts, event_id) > born)
SELECT 'u' || f.user_id AS table_id, 'c_' || f.event_type AS name, CASE WHEN count(*) FILTER (turn = 1) > 0 THEN 'bigint' ELSE 'int' END AS type,
  coalesce(max_by(event_id % 2 = 1, moment) FILTER (turn = 1), true) AS nullable, 'event ' || (max_by(event_id, moment) FILTER (turn = 2)) AS comment
FROM f LEFT JOIN l USING (user_id, event_type) GROUP BY f.user_id, f.event_type
""",
    "migration_kinds": """
SELECT 'm' || (user_id % 8) AS project, kind, count(*) AS n FROM (
  SELECT user_id, CASE WHEN event_id % 3 = 2 THEN 'comment_on' ELSE 'alter_table' END AS kind FROM events UNION ALL SELECT DISTINCT user_id, 'create_table' FROM events) GROUP BY ALL
""",
    "check_nullable": """
SELECT column_name, n_null, n_null > 0 AS nullable FROM (
  UNPIVOT (SELECT count(*) - count(COLUMNS(*)) FROM lineitem) ON COLUMNS(*) INTO NAME column_name VALUE n_null)
""",
    "check_keys": "SELECT l_orderkey, l_linenumber, count(*) AS n_rows FROM lineitem GROUP BY ALL HAVING count(*) > 1 OR l_orderkey IS NULL OR l_linenumber IS NULL",
    "check_orphans": """
SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem l WHERE l_orderkey IS NOT NULL AND NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l.l_orderkey AND o_orderstatus <> 'F')
""",
    "check_cardinality": """
SELECT max(n) AS max_children, 0 AS null_rows, CASE WHEN max(n) <= 1 THEN 'one-to-one' ELSE 'many-to-one' END AS cardinality, false AS optional
FROM (SELECT count(*) AS n FROM orders WHERE o_custkey IS NOT NULL GROUP BY o_custkey)
""",
    "check_optional": "SELECT count(*) FILTER (o_custkey IS NULL) > 0 AS optional FROM orders",
    "check_link_pairs": """
WITH p AS (SELECT DISTINCT l_partkey AS a, l_suppkey AS b FROM lineitem)
SELECT (SELECT count(*) FROM p) AS n_pairs, (SELECT max(n) FROM (SELECT count(*) AS n FROM p GROUP BY a)) AS max_b_of_a, (SELECT max(n) FROM (SELECT count(*) AS n FROM p GROUP BY b)) AS max_a_of_b
""",
}


def _star() -> str:
    parts = []
    for child, fk, parent, pk in (
        ("nation", "n_regionkey", "region", "r_regionkey"), ("customer", "c_nationkey", "nation", "n_nationkey"), ("supplier", "s_nationkey", "nation", "n_nationkey"),
        ("orders", "o_custkey", "customer", "c_custkey"), ("lineitem", "l_orderkey", "orders", "o_orderkey"), ("lineitem", "l_partkey", "part", "p_partkey"),
        ("lineitem", "l_suppkey", "supplier", "s_suppkey"),
    ):
        parts.append(f"""
SELECT '{child}({fk})->{parent}' AS relationship, 'many-to-one' AS declared, CASE WHEN max(n) FILTER (k IS NOT NULL) <= 1 THEN 'one-to-one' ELSE 'many-to-one' END AS observed, false AS declared_optional,
  coalesce(sum(n) FILTER (k IS NULL), 0) > 0 AS observed_optional, max(n) FILTER (k IS NOT NULL) AS max_children, coalesce(sum(n) FILTER (k IS NULL), 0)::BIGINT AS null_rows,
  (SELECT count(*) FROM {child} WHERE {fk} IS NOT NULL AND {fk} NOT IN (SELECT {pk} FROM {parent})) AS n_orphans FROM (SELECT {fk} AS k, count(*) AS n FROM {child} GROUP BY 1)""")
    return " UNION ALL ".join(parts)


ORACLES["check_star_schema"] = _star()


#: Lines of each document by section, table, part and place, from the same facts.
ORACLES["tree_documents"] = TREE + ROLES + COLUMNS + """,
o AS (SELECT project, k, row_number() OVER (PARTITION BY project ORDER BY k) - 1 AS n FROM k),
t AS (
  SELECT d.*, substr(table_id, 2)::BIGINT AS k, n, (SELECT count(*) FROM cols c WHERE c.project = d.project AND c.table_id = d.table_id) AS n_cols FROM d JOIN o ON o.project = d.project AND 't' || o.k = table_id),
m AS (
  SELECT *, row_number() OVER (PARTITION BY project, k ORDER BY position) AS nth, concat_ws(', ', CASE WHEN pk THEN 'PK' END, CASE WHEN ref <> '' THEN 'FK' END, CASE WHEN uq AND NOT pk THEN 'UQ' END) AS keys FROM flags),
links AS (
  SELECT r.project, r.k, r.c, r.child, r.parent, r.one, r.optional, r.linked, x.n AS child_n, y.n AS parent_n, CASE WHEN r.optional THEN '0..1' ELSE '1' END AS lo,
    CASE WHEN r.one THEN CASE WHEN r.optional THEN '0..1' ELSE '1' END ELSE '*' END AS hi FROM r JOIN o x ON x.project = r.project AND x.k = r.k JOIN o y ON y.project = r.project AND y.k = r.p),
p AS (SELECT DISTINCT project FROM k),
node AS (SELECT *, table_id || '<br/><small>' || n_cols || ' column' || CASE WHEN n_cols = 1 THEN '' ELSE 's' END || '</small>' AS label FROM t),
lines AS (
  SELECT project, 'er' AS kind, 0 AS section, 0 AS ord, 0 AS sub, 0 AS pos, 'erDiagram' AS line FROM p
  UNION ALL SELECT project, 'er', 1, k, 0, 0, '  ' || table_id || ' {' FROM t
  UNION ALL SELECT project, 'er', 1, k, 1, nth, '    ' || replace(replace(type, ' ', '_'), ',', '_') || ' ' || name || CASE WHEN keys = '' THEN '' ELSE ' ' || replace(keys, 'UQ', 'UK') END FROM m
  UNION ALL SELECT project, 'er', 1, k, 2, 0, '  }' FROM t
  UNION ALL SELECT project, 'er', 2, k, 0, ascii(c), '  ' || child || ' ' || CASE WHEN one THEN '|o' ELSE '}o' END || CASE WHEN linked THEN '--' ELSE '..' END ||
    CASE WHEN optional THEN 'o|' ELSE '||' END || ' ' || parent || ' : "' || c || '"' FROM links
  UNION ALL SELECT project, 'class', 0, 0, 0, 0, 'classDiagram' || chr(10) || '  direction LR' FROM p
  UNION ALL SELECT project, 'class', 1, k, 0, 0, '  class ' || table_id || '["' || table_id || '"] {' FROM t
  UNION ALL SELECT project, 'class', 1, k, 1, -1, '    <<link table>>' FROM t WHERE junction
  UNION ALL SELECT project, 'class', 1, k, 1, nth, '    ' || CASE WHEN pk THEN '+' WHEN ref <> '' THEN '#' ELSE '-' END || name || ' : ' || translate(type, '()', '[]') ||
    CASE WHEN nullable THEN '?' ELSE '' END || CASE WHEN keys = '' THEN '' ELSE ' [' || keys || ']' END FROM m
  UNION ALL SELECT project, 'class', 1, k, 2, 0, '  }' FROM t
  UNION ALL SELECT project, 'class', 2, k, 0, ascii(c), CASE WHEN linked THEN '  ' || parent || ' "' || lo || '" *-- "' || hi || '" ' || child || ' : ' || c
    ELSE '  ' || child || ' "' || hi || '" --> "' || lo || '" ' || parent || ' : ' || c END FROM links
  UNION ALL SELECT project, 'graph', 0, 0, 0, 0, 'flowchart LR' FROM p
  UNION ALL SELECT project, 'graph', 1, k, 0, 0, '  t' || n || CASE WHEN junction THEN '{{"' || label || '"}}' ELSE '["' || label || '"]' END FROM node
  UNION ALL SELECT project, 'graph', 2, k, 0, ascii(c), '  t' || child_n || CASE WHEN optional THEN ' -.->' ELSE ' -->' END || '|"' || c || CASE WHEN one THEN ' (1:1)' ELSE ' (N:1)' END || '"| t' || parent_n FROM links
  UNION ALL SELECT project, 'graph', 3, 0, 0, 0, '  classDef root stroke-width:2px' || chr(10) || '  classDef junction stroke-dasharray:4 3' FROM p
  UNION ALL SELECT project, 'graph', 3, 0, 0, 2, '  class ' || string_agg('t' || n, ',' ORDER BY k) || ' root' FROM t WHERE n_out = 0 GROUP BY project
  UNION ALL SELECT project, 'graph', 3, 0, 0, 3, '  class ' || string_agg('t' || n, ',' ORDER BY k) || ' junction' FROM t WHERE junction GROUP BY project
  UNION ALL SELECT project, 'dictionary', 0, 0, 0, 0, '# Data dictionary' || chr(10) FROM p
  UNION ALL SELECT project, 'dictionary', 1, k, 0, 0, '## ' || table_id || chr(10) || chr(10) || '_Source: f' || (k % 4 + CASE WHEN k % 13 = 0 THEN 1 ELSE 0 END) || '_' || chr(10) || chr(10) ||
    '| Column | Type | Key | Null | Default | References | Comment |' || chr(10) || '|---|---|---|---|---|---|---|' FROM t
  UNION ALL SELECT project, 'dictionary', 1, k, 1, nth, '| ' || name || ' | ' || type || ' | ' || keys || ' | ' || CASE WHEN nullable THEN 'YES' ELSE 'NO' END || ' | ' ||
    CASE WHEN name = 'name' THEN '''a, (b''' ELSE '' END || ' | ' || ref || ' |  |' FROM m
  UNION ALL SELECT project, 'dictionary', 1, k, 2, 0, '' FROM t),
texts AS (SELECT project, kind, string_agg(line, chr(10) ORDER BY section, ord, sub, pos) AS text FROM lines GROUP BY project, kind)
SELECT project, kind, length(text) AS n_chars, sha256(text) AS sha256 FROM texts
"""

ORACLES["tree_details"] = TREE + COLUMNS + """
SELECT project, 'columns' AS part, count(*) AS n FROM cols WHERE k = 22 GROUP BY project UNION ALL SELECT project, 'outgoing', count(*) FROM r WHERE k = 22 GROUP BY project
UNION ALL SELECT project, 'incoming', count(*) FROM r WHERE p = 22 GROUP BY project UNION ALL SELECT project, 'edges', count(*) FROM r WHERE p = 22 OR k = 22 GROUP BY project
UNION ALL SELECT project, 'itself', 1 FROM k WHERE k = 22
"""
ORACLES["tree_isolated"] = TREE + ROLES + "SELECT project, count(*) FILTER (n_in = 0 AND n_out = 0) AS isolated FROM d GROUP BY project"

#: Files of corpora.archives() and what they hold.
ARCHIVES = """
WITH f AS (
  SELECT doc_id AS i, doc_id % 8 AS kind, 'a' || (doc_id // 64) AS project, doc_id % 64 AS file_idx,
    doc_id || '.' || ['d.sql', 'd.sql.gz', 'd.sql.bz2', 'd.sql.xz', 'd.zip', 'd.tgz', 'd.bin.sql', 'd.7z'][doc_id % 8 + 1] AS file,
    [1, 1, 1, 1, 2, 1, 0, 0][doc_id % 8 + 1] AS n, [NULL, NULL, NULL, NULL, NULL, NULL, 'it is not a text file', '7-Zip archives are not supported; extract it first'][doc_id % 8 + 1] AS skipped,
    'SET standard_conforming_strings = on;' || chr(10) || 'INSERT INTO d VALUES (''' || replace(coalesce(text, ''), '''', '''''') || ''');' || chr(10) || 'CREATE TABLE t' || doc_id || ' (x int);' || chr(10) AS script
  FROM documents WHERE doc_id IS NOT NULL)
"""
ORACLES["archive_reports"] = ARCHIVES + """
SELECT project, file, file_idx, [NULL, 'gzip', 'bzip2', 'xz', 'zip', 'gzip → tar', NULL, NULL][kind + 1] AS format, [NULL, 'gzip', 'bzip2', 'xz', 'zip · 2 .sql', 'gzip → tar · 1 .sql', NULL, NULL][kind + 1] AS format_label,
  'utf-8' AS encoding, n AS entries, n AS tables, n AS kept, 3 * n AS statements, n AS inserts, n AS data_skipped, n * length(script) AS chars, n * strlen(script) AS text_bytes, false AS encrypted, skipped FROM f
"""
ORACLES["archive_warnings"] = ARCHIVES + """, w AS (
  SELECT project, 0 AS rank, file_idx, 'Skipped "' || file || CASE WHEN kind = 4 THEN '/README.md": not an SQL file.' ELSE '": ' || skipped || '.' END AS message FROM f WHERE kind IN (4, 6, 7)
  UNION ALL SELECT project, 1, file_idx, 'Table "t' || i || '" is defined more than once; the last definition is used.' FROM f WHERE kind = 4)
SELECT project, row_number() OVER (PARTITION BY project ORDER BY rank, file_idx) AS place, message FROM w
"""
ORACLES["archive_projects"] = ARCHIVES + """
SELECT project, count(*) = count(skipped) AS all_skipped, false AS sensitive, min_by(file, file_idx) FILTER (skipped IS NOT NULL) AS first_skipped,
  coalesce(sum(CASE WHEN n > 0 THEN n * (22 + length(i::VARCHAR)) + 3 * (n - 1) + 2 END), 0) <= 1540 AS persistable FROM f GROUP BY project
"""
ORACLES["archive_new_files"] = ARCHIVES + "SELECT project, count(*) AS n_new FROM f WHERE file_idx % 2 = 1 GROUP BY project"
ORACLES["replaced_statements"] = TREE + """, s AS (SELECT project, 'f' || (k % 4) AS file FROM k UNION ALL SELECT project, 'f' || (k % 4 + 1) FROM k WHERE k % 13 = 0)
SELECT project, file, count(*) AS n FROM s WHERE CASE WHEN project = 'p0' THEN file <> 'f2' ELSE file = 'f1' OR project NOT IN (SELECT project FROM s WHERE file = 'f1') END GROUP BY ALL
"""

#: Projects of corpora.oddities().
ODD = "WITH o AS (SELECT 'o' || (doc_id // 50) AS project, doc_id % 50 AS k FROM documents WHERE doc_id IS NOT NULL)"
ORACLES["odd_relationships"] = ODD + """
SELECT project, 'r' || k AS child, 'x' AS child_columns, CASE WHEN k % 4 = 0 THEN 'b' ELSE 'a' END || '.n' || k AS parent, CASE WHEN k % 5 = 0 THEN '1 : 1' ELSE 'N : 1' END AS ratio,
  'Each row has zero or one parent; parent has ' || CASE WHEN k % 5 = 0 THEN 'at most one' ELSE 'many' END AS meaning FROM o
"""
ORACLES["odd_tables"] = ODD + """
SELECT project, 'a.n' || k AS table_id, NULL::VARCHAR AS comment, 1 AS n_columns FROM o UNION ALL SELECT project, 'b.n' || k, NULL, CASE WHEN k % 4 = 0 THEN 2 ELSE 1 END FROM o
UNION ALL SELECT project, 'r' || k, 'said ' || k, 1 FROM o
"""
ORACLES["odd_warnings"] = ODD + """, w AS (
  SELECT project, 0 AS phase, k, 'Table "b.n' || k || '" is defined more than once; the last definition is used.' AS message FROM o WHERE k % 4 = 0
  UNION ALL SELECT project, 1, k, 'ALTER TABLE on unknown table "lost' || k || '" was ignored.' FROM o WHERE k % 3 = 0)
SELECT project, row_number() OVER (PARTITION BY project ORDER BY phase, k) AS place, message FROM w
"""
ORACLES["stream_tables"] = TREE + """
SELECT project, 't' || k AS table_id, CASE WHEN k > 0 THEN 4 ELSE 2 END + CASE WHEN k % 13 = 0 THEN 1 ELSE 0 END AS n_columns, linked AND k % 7 <> 0 AS is_junction,
  CASE WHEN k = 0 THEN 0 WHEN k % 7 = 0 THEN 1 ELSE 2 END AS n_references FROM k
"""

_bytes = "CASE WHEN {0} < 1024 THEN {0} || ' B' " + " ".join(
    f"WHEN {{0}} < {1024 ** (i + 1)} OR {i} = 4 THEN CASE WHEN {{0}} / {1024**i}.0 < 10 THEN printf('%.1f', floor({{0}} / {1024**i}.0 * 10 + 0.5) / 10) ELSE floor({{0}} / {1024**i}.0 + 0.5)::BIGINT::VARCHAR END || ' {unit}'"
    for i, unit in enumerate(("KB", "MB", "GB", "TB"), 1)) + " END"
ORACLES["document_sizes"] = f"""
WITH s AS (SELECT *, strlen(coalesce(text, ''))::BIGINT AS n FROM documents)
SELECT doc_id, {_bytes.format("n")} AS size, {_bytes.format("(n * n)")} AS square, true AS same, 'varchar (' || n_chars || ')' AS kind, doc_id % 2 = 0 OR doc_id % 3 = 0 AS auto FROM s
"""

ORACLES["dump_ranges"] = """
SELECT coalesce(source, 'none') AS project, 2 * count(*) AS statements, count(*) AS kept, count(*) AS inserts, 0 AS copy_blocks, count(*) AS created,
  min(doc_id) AS first_table, max(doc_id) AS last_table, sum(doc_id)::VARCHAR AS all_tables
FROM documents WHERE doc_id IS NOT NULL GROUP BY ALL
"""

ORACLES["source_entries"] = r"""
WITH s AS (
  SELECT coalesce(source, 'none') AS project, 'CREATE TABLE t' || doc_id || ' (x int, note text DEFAULT ''' || replace(replace(coalesce(text, ''), '\', '\\'), '''', '''''') || ''')' AS sql
  FROM documents WHERE doc_id IS NOT NULL)
SELECT project, sum(strlen(sql) + 2)::BIGINT AS n_bytes, count(*) AS n_tables, sum(length(sql))::BIGINT AS n_chars FROM s GROUP BY project
"""

ORACLES["tree_places"] = ORACLES["tree_connectivity"].replace("SELECT project, table_id, n_out,", "SELECT project, row_number() OVER (PARTITION BY project ORDER BY n_in DESC, table_id) AS place, table_id,")
ORACLES["tree_document_lines"] = ORACLES["tree_documents"][: ORACLES["tree_documents"].rindex("\nSELECT")] + """
SELECT project, kind, unnest(range(len(parts))) AS line_no, unnest(parts) AS line FROM (SELECT *, string_split(text, chr(10)) AS parts FROM texts WHERE kind IN ('graph', 'dictionary'))
"""
