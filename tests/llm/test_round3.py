"""Near-duplicate vectors, Merkle manifests and periodic runs against brute force, and faults found in review."""

import hashlib
import random
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pytest
from test_operators import docs, edge_rows

from schemaloom.llm import ann, embedding_dedup, exact_dedup, licenses, merkle, minhash, periods, quality_cnn
from schemaloom.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


def linked(rows, bound=0.95):
    """vec_id, n_links, component_id, kept of every row, by all pairs."""
    good = [i for i, (d, v) in enumerate(rows) if d is not None and v and all(c is not None and np.isfinite(c) for c in v) and any(v)]
    parent, count = list(range(len(rows))), [0] * len(rows)

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    scaled = {i: np.array(rows[i][1]) / np.abs(rows[i][1]).max() for i in good}
    for i in good:
        for j in good:
            x, y = scaled[i], scaled[j]
            if i < j and len(x) == len(y) and x @ y / np.sqrt((x @ x) * (y @ y)) >= bound:
                count[i] += 1
                count[j] += 1
                parent[find(i)] = find(j)
    low = defaultdict(lambda: 10**18)
    for i in good:
        low[find(i)] = min(low[find(i)], rows[i][0])
    at = [low[find(i)] if i in set(good) else rows[i][0] for i in range(len(rows))]
    return [(d, n, c, d is None or c == d) for (d, _), n, c in zip(rows, count, at)]


def test_near_duplicate_vectors_against_all_pairs(spark):
    r = np.random.default_rng(4)
    base = r.normal(size=(120, 12))
    rows = [(int(i), v.tolist()) for i, v in zip(r.permutation(1000), base)]
    for k, (noise, n) in enumerate([(0.02, 60), (0.15, 60), (0.3, 40)]):  # a ball, one with a rim, a group too wide for one
        centre = base[k] / np.linalg.norm(base[k])
        rows += [(2000 + 100 * k + i, (centre + noise * r.normal(size=12) / 12**0.5).tolist()) for i in range(n)]
    rows += [(5000 + i, rows[0][1]) for i in range(30)] + [(5100, [3 * c for c in rows[1][1]]), (5101, [-c for c in rows[1][1]])]
    rows += [(6000, None), (6001, []), (6002, [0.0] * 12), (6003, [None] + [1.0] * 11), (6004, [float("nan")] * 12), (6005, [float("inf")] * 12), (None, rows[0][1])]
    rows += [(7000, [1.0, 2.0]), (7001, [2.0, 4.0]), (7000, [5.0, -1.0]), (7002, [1e-200] * 12), (7003, [1e200] * 12)]
    df = spark.createDataFrame([(d, v, 1, "x") for d, v in rows], "vec_id long, embedding array<double>, label int, `h` string")
    key = lambda x: tuple((v is None, v) for v in x)
    for how in ({}, {"sigmas": None}):
        assert sorted(map(tuple, embedding_dedup.near_duplicates(df, **how).collect()), key=key) == sorted(linked(rows), key=key)
    kept = embedding_dedup.dedup(df)
    assert kept.columns == df.columns and kept.where("vec_id is null").count() == 1
    assert embedding_dedup.near_duplicates(df.limit(0)).collect() == []
    assert embedding_dedup.near_duplicates(df.where("vec_id = 6000")).collect()[0].kept


def test_matrices_are_cut_by_bytes():
    """With 16,384 lists no matrix of rows and lists has more than about BYTES."""
    assert all((s.stop - s.start) * 16_384 * 8 <= ann.BYTES for s in ann.cut(10_000, 16_384))
    x, centers = np.random.default_rng(0).normal(size=(500, 8)), np.random.default_rng(1).normal(size=(16_384, 8))
    assert (ann.nearest(x, centers) == ((x[:, None] - centers[None, :, :]) ** 2).sum(axis=2).argmin(axis=1)).all()


def manifest(rows):
    """The manifest of (doc_id, text, lang, source, n_chars), node by node."""
    H = lambda *x: hashlib.sha256("".join(x).encode()).hexdigest()
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda d, t, la, s, n: H(*map(field, (d, s, la, n, t)))
    lower = lambda t: t and "".join(c.lower() if c.isascii() else c for c in t)

    def tree(nodes):
        levels = [nodes]
        while len(levels[-1]) > 1:
            levels.append([H(*levels[-1][i : i + 8]) for i in range(0, len(levels[-1]), 8)])
        return levels

    def path(levels, i):
        for level in levels[:-1]:
            a = i // 8 * 8
            yield level[a:i], level[i + 1 : a + 8]
            i //= 8

    by = defaultdict(list)
    for r in rows:
        by[r[2]].append((r[0] is not None, r[0] or 0, leaf(*r), r))
    langs = sorted(by, key=lambda k: (k is not None, (k or "").encode()))
    trees = {k: tree([x[2] for x in sorted(by[k], key=lambda x: x[:3])]) for k in langs}
    top, out = tree([trees[k][-1][0] for k in langs]), []
    for j, k in enumerate(langs):
        for i, (_, _, own, r) in enumerate(sorted(by[k], key=lambda x: x[:3])):
            steps = [*path(trees[k], i), *path(top, j)]
            at = leaf(r[0], lower(r[1]), *r[2:]) if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 else own
            for a, b in steps:
                at = H(*a, at, *b)
            out.append((r[0], own, trees[k][-1][0], top[-1][0], H(*[x for a, b in steps for x in a + b]), at, at == top[-1][0]))
    return out


def test_manifest_against_a_plain_tree(spark):
    r = random.Random(1)
    rows = [(None, "Ab", None, None, None)] * 2 + [(None, "x", "en", "s", 1), (5, None, "en", None, 2), (5, "Q", "en", None, 2), (5, "Q", "en", None, 2), (-7, "", "é", "s", 0), (2**62, "Z", "en", "s", 1), (-(2**63), "Z", "en", "s", 1)]
    rows += [(r.choice([r.randrange(-300, 300), r.randrange(2**50)]), r.choice(["Hello World", "x", "ÀB"]), r.choice([None, "en", "de", *"abcdefghi"]), r.choice([None, "s"]), r.randrange(9)) for _ in range(600)]
    rows += [(i, f"T{i}", "big", "s", 1) for i in range(530)]
    key = lambda x: tuple((v is not None, v) for v in x)
    for some in (rows, rows[:1], []):
        df = spark.createDataFrame([(*x, 1) for x in some], "doc_id long, text string, lang string, source string, n_chars long, `tree` int")
        assert sorted(map(tuple, merkle.manifest(df).collect()), key=key) == sorted(manifest(some), key=key)


def test_manifest_against_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    df = QUERIES["op12_merkle_manifest"](spark, SF)
    want = con.execute(f"SELECT {', '.join(df.columns)} FROM ({ORACLES['op12_merkle_manifest']})").fetchall()
    assert sorted(map(tuple, df.collect())) == sorted(want)


def plain_runs(x):
    """Runs by trying every period at every place."""
    out = []
    for q in range(1, len(x) // 4 + 1):
        i = 0
        while i + q < len(x):
            j = i
            while j + q < len(x) and x[j] == x[j + q]:
                j += 1
            n = j - i + q
            if j > i and n >= max(6, 4 * q) and not any(all(x[k] == x[k + d] for k in range(i, i + n - d)) for d in range(1, q)):
                out.append((i, n, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda t: (t[0], t[2]))


def words_of(text):
    return [w for w in (text or "").translate({c: " " for c in range(9, 14)}).split(" ") if w]


def test_runs_against_every_period():
    r = random.Random(0)
    for _ in range(3000):
        x = []
        for _ in range(r.randint(0, 5)):
            root = [r.randrange(r.randint(1, 4)) for _ in range(r.randint(1, 5))]
            x += (root * r.randint(1, 7))[: r.randint(1, 35)] if r.random() < 0.6 else [r.randrange(9) for _ in range(r.randint(0, 8))]
        assert list(map(tuple, periods.runs(np.array(x, np.int64)).tolist())) == plain_runs(x), x
    x = np.tile(np.arange(3000), 8)
    assert periods.runs(x).tolist() == [[0, 24_000, 3000]] and not len(periods.runs(np.arange(50_000)))


def test_run_digests_against_plain_python(spark):
    rows = [*edge_rows(), *[(100 + i, " ".join(random.Random(i).choice("ab") for _ in range(60)), "a") for i in range(60)], (300, "x " * 5, "a"), (301, "Y\x0by y\ty y y", "b")]
    want = []
    for d, t, _ in rows:
        words = periods.looped(words_of(t), d)
        found, best, gone = plain_runs(words), None, set()
        for s, n, q in found:
            gone |= set(range(s + q, s + n))
            best = (s, n, q) if best is None or n * best[2] > best[1] * q else best
        sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
        want.append((d, len(found), *(best or (None,) * 3), best and best[1] * 1000 // best[2], sha("".join(f"{s},{n},{q}\n" for s, n, q in found)), sha(" ".join(w for i, w in enumerate(words) if i not in gone))))
    key = lambda x: tuple((v is not None, v) for v in x)
    assert sorted(map(tuple, periods.digests(docs(spark, rows)).collect()), key=key) == sorted(want, key=key)
    got = {r.doc_id: (r.runs, r.collapsed) for r in periods.collapse(docs(spark, [(1, "go a b a b a b a b end", "x"), (2, None, "x")])).collect()}
    assert [tuple(x) for x in got[1][0]] == [(1, 8, 2)] and got[1][1] == "go a b end" and got[2] == ([], "")


def test_planted_loops():
    words = [f"w{i}" for i in range(100)]
    d = next(d for d in range(1000) if zlib.crc32(str(d).encode()) % 10 == 0)
    g = zlib.crc32(str(d).encode()) // 10
    a = g % 100
    p = 1 + (100 - a) // (3 + g % 8)
    assert periods.looped(words, d) == [words[i] if i < a else words[a + (i - a) % p] for i in range(100)]
    assert periods.looped(words, None) == words and periods.looped([], d) == []


def labels_of(text):
    return {d[3] for d in licenses.scan(text)[2]}


def test_members_of_license_expressions_are_joined_by_operators():
    assert labels_of("SPDX-License-Identifier: Apache-2.0 OR BSD-3-Clause OR GPL-2.0-only OR MPL-2.0 OR ISC OR Zlib") == {"apache-2.0", "bsd-3-clause", "gpl-2.0-only", "mpl-2.0", "isc", "zlib"}
    assert labels_of("SPDX-License-Identifier: MIT\nThis file works with Vim") == {"mit"}
    assert labels_of("SPDX-License-Identifier: MIT\nPlease see x11 or ruby docs") == {"mit"}
    assert labels_of("SPDX-License-Identifier: (GPL-2.0-only WITH Classpath-exception-2.0) OR LicenseRef-Own OR MIT") == {"gpl-2.0-only", "mit"}
    assert "rail" in labels_of("under OpenRAIL-M") and "boost" in labels_of("the Boost License")


def test_a_labelled_text_over_the_bound_does_not_stop_training(spark):
    long = [(i, "good words here " * (4000 if i < 3 else 5), "a") for i in range(60)]
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(60)], "doc_id long, quality int, toxic int")
    weights = quality_cnn.fit(docs(spark, long), labels, n_bytes=10_000)
    start = quality_cnn.new_weights()
    assert any((weights[k] != start[k]).any() for k in weights)


def test_results_outlive_the_tables_between(spark):
    rows = [r for r in edge_rows() if r[0] is not None]
    kept = minhash.dedup(docs(spark, rows))
    assert kept.count() == kept.count() > 0 and exact_dedup.dedup(kept).count() <= kept.count()


def templated(n, seed, options=8, words=300, slots=10, skew=False):
    """Texts of one template; each slot has a word of `options`, some texts lose a stretch of the template."""
    r = random.Random(seed)
    base = [f"w{r.randrange(10**6)}" for _ in range(words)]
    out = []
    for d in range(n):
        own = list(base)
        for j in range(slots):
            own[5 + j * (words // slots)] = f"o{j}_{min(r.randrange(options), r.randrange(options)) if skew else r.randrange(options)}"
        if skew and r.random() < 0.3:
            del own[: r.randrange(40)]
        out.append((d, " ".join(own), "a"))
    return out


def grouped(rows, percent):
    sets, parent = [set(minhash.shingles(t).tolist()) for _, t, _ in rows], list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return {i: find(i) for i in range(len(rows))}


def test_near_duplicates_of_one_template_meet_few_others(spark, monkeypatch):
    met, checked = [], minhash._checked

    def counted(pairs, *rest):
        met.append(pairs.count())
        return checked(pairs, *rest)

    monkeypatch.setattr(minhash, "_checked", counted)
    rows = templated(400, 5)
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(docs(spark, rows)).collect()}
    want = grouped(rows, 85)
    assert got == want and 250 < len(set(want.values())) < 400
    assert sum(met) < 50 * len(rows)


@pytest.mark.parametrize("few,percent,n_bands,words,options", [(2, 85, 24, 300, 4), (2, 80, 40, 200, 5), (1, 85, 24, 120, 2)])
def test_near_duplicates_of_uneven_templates_against_brute_force(spark, monkeypatch, few, percent, n_bands, words, options):
    monkeypatch.setattr(minhash, "FEW", few)
    rows = templated(60, 6, options, words, skew=True) + templated(60, 7, options, words, skew=True)
    rows = [(i, t, s) for i, (_, t, s) in enumerate(rows)]
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(docs(spark, rows), percent=percent, n_bands=n_bands).collect()}
    assert got == grouped(rows, percent)


def test_near_copies_with_edits_at_the_same_places_have_few_paths(spark, monkeypatch):
    made, extended = [], minhash._extended

    def counted(*args):
        out = extended(*args)
        made.append(out.count())
        return out

    monkeypatch.setattr(minhash, "_extended", counted)
    r = random.Random(3)
    base, rows = [f"w{i}" for i in range(150)], []
    for d in range(300):
        own = list(base)
        for _ in range(r.choice([1, 2, 3, 3, 4, 5])):
            own[r.randrange(150)] = f"x{r.randrange(10**6)}"
        rows.append((d, " ".join(own), "a"))
    got = {x.doc_id: x.component_id for x in minhash.near_duplicates(docs(spark, rows)).collect()}
    want = grouped(rows, 85)
    assert got == want and 100 < len(set(want.values())) < 250
    assert sum(made) < 10 * len(rows), made


def test_sets_are_dealt_out_only_where_pairs_or_large_groups_need_them(spark):
    sets = spark.createDataFrame([(i, 3, [i, i + 1, i + 2]) for i in range(1, 6)], "node long, n long, h array<long>")
    pairs = spark.createDataFrame([(1, 3), (3, 4)], "a long, b long")
    assert {r.node for r in minhash._ends(sets, pairs).collect()} == {1, 3, 4}
    groups = spark.createDataFrame([(1, 1, 1), (1, 2, 2)], "g long, node long, part long")
    assert {r.node: sorted(r["diff"]) for r in minhash.differences(groups, sets, 85).collect()} == {1: [], 2: [1, 4]}
