import collections
import hashlib
import random

import duckdb
import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from schemaloom.llm import ann, bpe, exact_dedup, licenses, line_dedup, minhash, mixing, quality_cnn, token_counts, url_tree
from schemaloom.llm.queries import ORACLES, QUERIES

DOCS = "doc_id long, text string, lang string, source string, n_chars long, `row` int, `key` string"
SF = "/root/testdata/sf0.001"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, len(t or ""), 7, "x") for i, t, s in rows], DOCS)


def edge_rows():
    r = random.Random(3)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(2, 6)))
    base = " ".join(word() for _ in range(120))
    rows = [(1, None, None), (2, "", "b"), (3, " \n\t ", "a"), (None, "a b c", "a"), (4, base, "a"), (5, base, "b"), (5, base, "b"), (6, base + " end", None), (7, "one two", "a"),
            (8, "ONE two", "a"), (9, " ".join(word() for _ in range(30_000)), "c"), (10, "née Ünïcode É <|endoftext|> x", "c")]
    for i in range(20, 60):
        words = base.split()
        for _ in range(r.randint(0, 4)):
            words[r.randrange(len(words))] = word()
        rows.append((i, " ".join(words), r.choice("abc")))
    return rows


def shingled(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def test_near_duplicates_against_brute_force(spark):
    rows = [r for r in edge_rows() if r[0] is not None]
    sets, parent = [shingled(t) for _, t, _ in rows], list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 85 * len(a | sets[j]):
                parent[find(i)] = find(j)
    least = collections.defaultdict(lambda: 10**9)
    for i, (d, _, _) in enumerate(rows):
        least[find(i)] = min(least[find(i)], d)
    want = sorted((d, len(sets[i]), least[find(i)], d == least[find(i)]) for i, (d, _, _) in enumerate(rows))
    got = minhash.near_duplicates(docs(spark, edge_rows()))
    assert sorted(map(tuple, got.where("doc_id is not null").collect())) == want
    assert [r.kept for r in got.where("doc_id is null").collect()] == [True]
    assert minhash.dedup(docs(spark, edge_rows())).columns == docs(spark, []).columns


def test_exact_dedup_edges(spark):
    got = {(r.doc_id, r.text_sha256): r for r in exact_dedup.classify(docs(spark, edge_rows())).collect()}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert got[1, sha("")].keep_id == 2 and got[2, sha("")].kept and got[1, sha("")].group_size == 2
    assert got[None, sha("a b c")].kept and not got[7, sha("one two")].group_size > 1
    kept = exact_dedup.dedup(docs(spark, edge_rows()))
    assert kept.count() == len({t or "" for _, t, _ in edge_rows()}) and kept.columns[-2:] == ["row", "key"]


@settings(deadline=None)
@given(st.sets(st.integers(0, 2**64 - 1), max_size=300))
def test_golomb_round_trip(values):
    x = np.array(sorted(values), np.uint64)
    k, data = exact_dedup.golomb_encode(x)
    assert (exact_dedup.golomb_decode(data, len(x), k) == x).all()


def test_mixing_meets_targets_and_reruns_agree(spark):
    rows = [(i, "w " * (i % 9), f"s{i % 4}" if i % 11 else None) for i in range(800)]
    first, second = (mixing.allot(docs(spark, rows).repartition(n)).toPandas() for n in (1, 5))
    key = ["doc_id"]
    assert first.sort_values(key)["taken"].tolist() == second.sort_values(key)["taken"].tolist()
    assert (first["taken"] <= 3 * first["size"]).all()
    for _, g in first.groupby("source", dropna=False):
        assert abs(g["taken"].sum() - g["target"].iloc[0]) <= 8 and g["target"].iloc[0] <= 3 * g["source_size"].iloc[0] + 1e-9
    assert mixing.mix(docs(spark, rows)).count() == first["copies"].sum()


def test_line_dedup_generalises_fields(spark):
    rows = [(i, f"job {i} done in ms {i * 7} by node-{i}\n{chr(97 + i) * 3} has {chr(98 + i) * 4} of its own\n", "a") for i in range(8)] + [(99, None, "a"), (98, "", "a")]
    got = {r.doc_id: r for r in line_dedup.clean(docs(spark, rows)).collect()}
    assert got[3].clean_text == "ddd has eeee of its own\n" and got[3].n_dropped == 1
    assert got[99].clean_text is None and got[98].clean_text == ""


def test_url_filter_edges(spark):
    urls = [(1, None), (2, "no scheme"), (3, "http://WWW.Example.com/en/x?q#f"), (4, "http://a.example.com/en/x"), (5, "x://b.net/es/1"), (6, "http://b.net"), (7, "http://com/"), (8, "http://xcom/")]
    pages = spark.createDataFrame(urls, "page_id long, url string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_tree.judge(pages).collect()}
    assert got[1] == got[2] == ("", "", None, "allow")
    assert got[3] == ("www.example.com", "/en/x", "www.example.com/en/", "allow") and got[4][2:] == ("example.com/en/", "block")
    assert got[5][2:] == ("net/es/", "block") and got[6][1:] == ("", None, "allow") and got[7][2] == "com/" and got[8][2] is None


TEXTS = ["", "a" * 5000, "It's  two\n\n spaces ", "<|endoftext|>x <|startoftext|>", "ΟΔΟΣ É e\u0301 １２ ½", "日本語 text", *[t for _, t, _ in edge_rows() if t and len(t) < 2000]]


@settings(deadline=None)  # the first call loads the vocabularies
@given(st.text(alphabet=st.one_of(st.sampled_from("ab 's<|>\n\t1é!"), st.characters(exclude_categories=["Cs"])), max_size=60))
def test_tokenizers_agree(text):
    one, two = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
    assert token_counts.counter(one).count(text) == len(library(one).encode(text, add_special_tokens=False).ids)
    e, want = bpe.encoder(two), library(two).encode(text, add_special_tokens=False).ids
    assert list(e.encode(text)) == want and bpe.decoder(two).decode(np.array(want, np.int32)).decode() == library(two).decode(want, skip_special_tokens=False)


_libraries = {}


def library(path):
    return _libraries.setdefault(path, None) or _libraries.update({path: Tokenizer.from_file(path)}) or _libraries[path]


def test_tokenizers_agree_on_edge_texts(spark):
    one, two = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
    df = docs(spark, [(i, t, "a") for i, t in enumerate(TEXTS)] + [(900, None, "a")])
    counts = {r.doc_id: r for r in token_counts.count_tokens(df, one).collect()}
    coded = {r.doc_id: r for r in bpe.decode(bpe.encode(df, two), two).collect()}
    assert {r.doc_id: r for r in bpe.round_trip(df, two).collect()} == coded
    assert counts[900].n_tokens == 0 and coded[900].decoded == ""
    for i, t in enumerate(TEXTS):
        want = library(two).encode(t, add_special_tokens=False).ids
        assert counts[i].n_tokens == len(library(one).encode(t, add_special_tokens=False).ids) and counts[i].n_bytes == len(t.encode())
        assert coded[i].ids == want and coded[i].decoded == library(two).decode(want, skip_special_tokens=False)


def test_license_scan():
    n, base, found = licenses.scan("Licensed under the MIT License. CC BY-NC 4.0; gnu General\nPublic License, version 3. Mit license mit license")
    assert n == 20 and [x for _, x in sorted(base)] == ["mit", "cc-by", "gpl", "mit", "mit"] and sorted(w for w, _ in base)[:2] == [3, 5]
    labels = {d[3] for d in found}
    assert "cc-by-nc-4.0" in labels and "cc-by" not in labels and all(0 <= d[0] < d[1] <= n for d in found)
    assert len(licenses.rules()) > 200 and licenses.scan("") == (0, [], [])


def test_license_base_against_brute_force(spark):
    import re

    df = spark.read.parquet(f"{SF}/documents.parquet")
    got = {r.doc_id: r for r in licenses.scan_licenses(df).collect()}
    for r in df.collect():
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), r.text))
        at = [(i, label) for phrase, label in licenses.BASE for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
        g = got[r.doc_id]
        assert (g.n_words, g.n_base, g.first_word, g.last_word) == (len(words), len(at), min([i for i, _ in at], default=None), max([i for i, _ in at], default=None))
        assert g.base_labels == ",".join(sorted({x for _, x in at})) and {x for _, x in at} <= set(g.labels.split(",")) | {""}


def test_classifier_learns(spark):
    r = random.Random(5)
    good = lambda: " ".join(r.choice(["sun", "rivers", "green", "walks", "slowly", "under", "stone"]) for _ in range(r.randint(5, 80)))
    rows = [(i, good() if i % 2 else "".join(r.choice("#$%&*!@^") for _ in range(r.randint(20, 400))), "a") for i in range(300)] + [(900, None, "a"), (901, "", "a")]
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(300)], "doc_id long, quality int, toxic int")
    w = quality_cnn.fit(docs(spark, rows), labels)
    again = quality_cnn.fit(docs(spark, rows).repartition(3), labels)
    assert all((w[k] == again[k]).all() for k in w)
    got = {x.doc_id: x for x in quality_cnn.score(docs(spark, rows), w).withColumn("h", quality_cnn.held_out(F.col("doc_id"))).collect()}
    held = [x for x in got.values() if x.h and x.doc_id < 300]
    assert held and sum(x.predicted == x.doc_id % 2 for x in held) / len(held) > 0.95 and all(0 <= x.score <= 1 for x in got.values())


def test_long_texts_score_alike(monkeypatch):
    w, text = quality_cnn.new_weights(), "some words here " * 3000
    whole = quality_cnn.score_text(w, text)
    monkeypatch.setattr(quality_cnn, "BLOCK", 7)
    assert abs(quality_cnn.score_text(w, text) - whole) < 1e-5


def test_gradients_against_differences():
    r = np.random.default_rng(1)
    w = {k: v.astype(np.float64) for k, v in quality_cnn.new_weights().items()}
    docs_ = [quality_cnn.chunks("".join(map(chr, r.integers(32, 127, n)))) for n in (40, 900, 2500)]
    x, starts, y = np.concatenate(docs_), np.cumsum([0, *map(len, docs_[:-1])]), np.array([1.0, 0.0, 1.0])

    def loss():
        p = quality_cnn.forward(w, x, starts)[0]
        return -(y * np.log(p) + (1 - y) * np.log(1 - p)).mean()

    g = quality_cnn.gradients(w, x, starts, y)
    for k in ("out", "dense", "conv", "embed"):
        i = np.unravel_index(np.abs(g[k]).argmax(), g[k].shape)
        before, step = w[k][i], 1e-4
        w[k][i] = before + step
        up = loss()
        w[k][i] = before - step
        down = loss()
        w[k][i] = before
        assert abs((up - down) / (2 * step) - g[k][i]) < 1e-3 * max(1, abs(g[k][i])) + 2e-4, k


def test_classifier_on_the_given_labels(spark):
    df, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    w = quality_cnn.fit(df, labels)
    held = quality_cnn.score(df, w).join(labels, "doc_id").where(quality_cnn.held_out(F.col("doc_id"))).toPandas()
    assert len(held) >= 50 and (held["predicted"] == held["quality"]).mean() >= 0.9


def test_classifier_and_pipeline_with_clashing_names(spark):
    import corpus_pipeline

    df = docs(spark, [(1, "some text", "a"), (2, None, "b")]).withColumn("score", F.lit("x")).withColumn("predicted", F.lit(3)).withColumn("a.b", F.lit(1))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, df, SF).columns == df.columns


def near_copies(n, edits, words=200, seed=4):
    r = random.Random(seed)
    base = [f"w{i}" for i in range(words)]
    out = []
    for d in range(n):
        own = list(base)
        for _ in range(edits):
            own[r.randrange(words)] = f"x{r.random()}"
        out.append((d, " ".join(own), "a"))
    return out


@pytest.mark.parametrize("n,edits", [(150, 4), (120, 3), (90, 6)])
def test_near_duplicates_of_one_hot_group_against_brute_force(spark, n, edits):
    rows = near_copies(n, edits)
    sets, parent = [shingled(t) for _, t, _ in rows], list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(n):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(docs(spark, rows)).collect()}
    assert got == {i: find(i) for i in range(n)}


def test_near_dedup_keeps_another_text_of_the_same_id(spark):
    base = " ".join(f"w{i}" for i in range(50))
    other = " ".join(f"v{i}" for i in range(50))
    got = minhash.dedup(docs(spark, [(1, base, "a"), (2, base, "a"), (2, other, "a"), (2, other, "a")]))
    assert sorted((r.doc_id, r.text) for r in got.collect()) == [(1, base), (2, other), (2, other)]


def test_hot_join_splits_a_key(spark):
    from schemaloom.llm.common import hot_join

    left = spark.range(1000).selectExpr("if(id < 900, 7, id) as k", "id as v")
    right = spark.range(1000).selectExpr("id as k", "id * 2 as w")
    got = hot_join(left, right, ["k"], "v", per=50)
    assert sorted(map(tuple, got.select("k", "v", "w").collect())) == sorted((7 if i < 900 else i, i, 14 if i < 900 else 2 * i) for i in range(1000))


def test_neighbours_recall_and_edges(spark):
    r = np.random.default_rng(2)
    x = r.normal(size=(3000, 24)) + r.integers(0, 6, 3000)[:, None]
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)] + [(4000, None, 0), (4100, [0.0] * 24, 0), (4200, [float("nan")] * 24, 0), (4300, [None] * 24, 0)]
    got = ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"))
    by = collections.defaultdict(dict)
    for q in got.collect():
        by[q.query_id][q.rank] = (q.score, q.vec_id)
    assert set(by) == set(range(0, 3000, 100))
    hits = 0
    for q, own in by.items():
        d = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
        want = sorted((v, i) for i, v in enumerate(d) if i != q)[:10]
        hits += len({i for _, i in want} & {i for _, i in own.values()})
        assert list(own) == sorted(own) and all(abs(s - d[i]) < 1e-9 for s, i in own.values())
    assert hits >= 0.9 * 10 * len(by)


@pytest.mark.parametrize("name", QUERIES)
def test_empty_tables(spark, tmp_path, name):
    docs(spark, []).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "vec_id long, embedding array<double>").write.parquet(f"{tmp_path}/embeddings.parquet")
    spark.createDataFrame([], "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert QUERIES[name](spark, str(tmp_path)).count() == 0


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_duckdb(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = QUERIES[name](spark, SF)
    got = sorted((tuple(r) for r in df.collect()), key=repr)
    want = sorted(con.execute(f"SELECT {', '.join(df.columns)} FROM ({ORACLES[name]})").fetchall(), key=repr)
    near = lambda a, b: a == b or isinstance(a, float) and abs(a - float(b)) < 1e-6
    assert len(got) == len(want) and all(near(a, b) for x, y in zip(got, want) for a, b in zip(x, y))


def test_pipeline_runs_stage_by_stage(spark):
    import corpus_pipeline

    start = spark.read.parquet(f"{SF}/documents.parquet")
    out, columns = start, start.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, out, SF)
        assert out.columns == columns, name
    assert corpus_pipeline.run(spark, SF).columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]


def test_license_suppression_against_brute_force():
    r = random.Random(8)
    for _ in range(200):
        found = [(a := r.randint(0, 12), a + r.randint(1, 6), r.randint(1, 3), "x", i) for i in range(r.randint(0, 25))]
        order = lambda d: (-d[2], d[4])
        holds = lambda k, d: k[0] <= d[0] and k[1] >= d[1] and (k[2] > d[2] or k[2] == d[2] and (k[:2] != d[:2] or order(k) < order(d)))
        assert sorted(licenses.suppressed(found)) == sorted(d for d in found if not any(holds(k, d) for k in found))


def test_license_bodies_identifiers_and_ends():
    labels = lambda t: {d[3] for d in licenses.scan(t)[2]}
    assert labels("Permission is hereby granted, free of charge, to any person obtaining a copy\n of this software and associated documentation files (the") == {"mit"}
    assert labels("SPDX-License-Identifier: Apache-2.0 OR MIT") == {"apache-2.0", "mit"}
    assert labels("SPDX-License-Identifier: (MIT-0 AND GPL-2.0-or-later)") == {"mit-0", "gpl-2.0-or-later"}
    assert labels("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:") == {"bsd"}
    assert [d[:2] for d in licenses.scan("gpl 2 01")[2]] == [(0, 2)] and len(licenses.SIGNATURES.strip().splitlines()) > 200


def test_license_scan_of_a_very_long_text():
    n, base, found = licenses.scan("gnu general public license " * 100_000)
    assert n == 400_000 and len(base) == len(found) == 100_000 and found[-1][:2] == (399_996, 400_000)


def test_small_batches_leave_the_session_alone(spark):
    from schemaloom.llm.common import ARROW_ROWS, mapped_table

    def sizes_of(batches):
        import pyarrow as pa

        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64())], ["id"])

    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    try:
        for own, want in ((10000, ARROW_ROWS), (77, 77)):
            spark.conf.set(key, own)
            sizes = [r.id for r in mapped_table(spark.range(0, 2000, 1, 1), sizes_of, "id long").collect()]
            assert max(sizes) == want and sum(sizes) == 2000 and spark.conf.get(key) == str(own)
    finally:
        spark.conf.set(key, before)


def test_pipeline_drops_near_copies_from_080_on(spark):
    import corpus_pipeline

    rows = []
    for i in range(16):
        words = [f"w{i}x{j}" for j in range(204)]  # 200 shingles
        other = 20 if i % 2 else 24  # similarity 180 / 220 = 0.82, or 176 / 224 = 0.79
        rows += [(10 * i, " ".join(words), "a"), (10 * i + 1, " ".join(words[:-other] + [f"o{i}x{j}" for j in range(other)]), "a")]
    got = corpus_pipeline.near(spark, docs(spark, rows), SF)
    assert sorted(r.doc_id for r in got.collect()) == sorted(d for d, _, _ in rows if d % 10 == 0 or d // 10 % 2 == 0)
