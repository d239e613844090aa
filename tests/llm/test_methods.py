"""Each operator's method on small planted cases, against brute force."""

import collections
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_operators import docs, edge_rows

from schemaloom.llm import ann, exact_dedup, line_dedup, mixing, url_tree


def cleaned(spark, rows, **how):
    return {r.doc_id: (r.clean_text, r.n_dropped) for r in line_dedup.clean(docs(spark, rows), **how).collect()}


def test_lines_with_one_and_two_variable_words_are_one_template(spark):
    names, places = [f"user{c}" for c in "abcdefg"], [f"host{c}" for c in "pqrstu"]
    rows = [(i, f"the job of user {names[i % 7]} has been moved to\n{chr(97 + i) * 3} own line of it", "a") for i in range(7)]
    rows += [(100 + i, f"the login of {names[i % 7]} from {places[i % 6]} has been seen today", "a") for i in range(42)]
    got = cleaned(spark, rows)
    assert all(got[i] == (f"{chr(97 + i) * 3} own line of it", 1) for i in range(7))
    assert all(got[100 + i] == ("", 1) for i in range(42))


def test_hot_leaves_do_not_lose_their_templates(spark):
    """What else a leaf holds does not matter, and prose with a common opening stays."""
    r = random.Random(2)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(5))
    prose = [f"Copyright of {r.randint(1000, 2000)} {word()} {word()} {word()}" for _ in range(60)]
    rows = [(i, p, "a") for i, p in enumerate(prose)] + [(100 + i, f"Copyright of {1990 + i} Acme Inc all", "a") for i in range(4)]
    got = cleaned(spark, rows)
    assert all(got[i] == (p, 0) for i, p in enumerate(prose)) and all(got[100 + i] == ("", 1) for i in range(4))


def test_long_lines_recur_from_two_texts_on_short_ones_from_five(spark):
    passage = " ".join(f"p{c}" * 2 for c in "abcdefghijklmnopqrstuvwxyz" * 2)
    rows = [(i, f"{passage}\nshort one\nof document number{chr(97 + i)} only this line tells\n", "a") for i in range(4)] + [(9, "copied copied copied copied copied copied", "a"), (10, "copied copied copied copied copied copied", "a")]
    got = cleaned(spark, rows)
    assert all(t.startswith("short one\nof document") and n == 1 for d, (t, n) in got.items() if d < 9)
    assert got[9] == got[10] == (rows[-1][1], 0), "exact copies are one text"
    assert cleaned(spark, rows[:4] + [(5, "short one", "a")])[5] == ("", 1)


def test_lines_against_an_outright_search(spark):
    """Every line: dropped exactly if its template, found pair by pair, is in enough texts."""
    r = random.Random(6)
    line = lambda: " ".join([r.choice(["alpha", "beta"]), "x", "y", *(r.choice("abc") for _ in range(r.randint(1, 3)))])
    rows = [(i, "\n".join(line() for _ in range(r.randint(1, 4))), "a") for i in range(60)]
    lines = sorted({x for _, t, _ in rows for x in t.split("\n")})

    def step(own):
        out = {}
        for x in own:
            tokens = x.split()
            same = lambda i: sum(len(y.split()) == len(tokens) and all(a == b for j, (a, b) in enumerate(zip(tokens, y.split())) if j != i) for y in own)  # noqa: E731, B023
            made = ["<*>" if i >= 3 and same(i) >= 5 else t for i, t in enumerate(tokens)]
            if made != tokens and 2 * made.count("<*>") <= len(made):
                out[x] = " ".join(made)
        return out

    one = step(lines)
    touched = {(len(x.split()), *x.split()[:3]) for x in one}
    two = step({y for y in ({*lines} - {*one}) | {*one.values()} if (len(y.split()), *y.split()[:3]) in touched})
    of = {x: two.get(one.get(x, x), one.get(x, x)) for x in lines}
    texts = collections.defaultdict(set)
    for _, t, _ in rows:
        for x in t.split("\n"):
            texts[of[x]].add(t)
    enough = lambda x: len(texts[of[x]]) >= (2 if len(x.split()) >= 5 else 5)
    got = cleaned(spark, rows)
    assert {d: "\n".join(x for x in t.split("\n") if not enough(x)) for d, t, _ in rows} == {d: t for d, (t, _) in got.items()}


def test_exact_dedup_of_hot_texts_and_repeated_rows(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "BLOCK_ROWS", 50)
    rows = [(i, "hot" if i % 3 == 0 else f"text {i % 150}", "a") for i in range(400)] + [(7, "again", "a")] * 3 + [(None, "hot", "a"), (None, None, "a")]
    by = collections.defaultdict(list)
    for d, t, _ in rows:
        by[t or ""].append(d)
    best = {t: max((d for d in ds if d is not None), default=None) for t, ds in by.items()}
    got = exact_dedup.classify(docs(spark, rows).repartition(7)).collect()
    assert sorted((r.doc_id or -1, r.keep_id or -1, r.group_size, r.kept) for r in got) == sorted(
        (d or -1, best[t or ""] or -1, len(by[t or ""]), d == best[t or ""]) for d, t, _ in rows)
    kept = exact_dedup.dedup(docs(spark, rows).repartition(5))
    assert sorted((r.text or "", r.doc_id or -1) for r in kept.collect()) == sorted((t, d or -1) for t, d in best.items())


def test_suspects_are_the_repeated_fingerprints(spark):
    prints = spark.range(3000).select(F.when(F.col("id") < 1000, F.col("id") % 300).otherwise(F.col("id")).alias("fp")).repartition(9)
    assert sorted(r.fp for r in exact_dedup.suspects(prints, owners=13).collect()) == list(range(300))


def near_of(spark, rows, **how):
    out = collections.defaultdict(list)
    for r in ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>, h string"), **how).orderBy("query_id", "rank").collect():
        out[r.query_id].append((r.vec_id, r.score))
    return out


def test_neighbours_ties_repeats_and_lengths(spark):
    rows = [(i, [1.0, 2.0, 3.0], "x") for i in range(0, 60)] + [(100, [1.0, 2.0, 4.0], "x"), (100, [1.0, 2.0, 4.0], "x"), (100, [9.0, 2.0, 4.0], "x")]
    rows += [(200, [1.0, 0.0], "x"), (201, [0.0, 1.0], "x"), (202, [], "x"), (300, [1.0, 2.0, None], "x"), (400, None, "x"), (None, [1.0, 1.0, 1.0], "x")]
    got = near_of(spark, rows)
    assert got[0] == [(i, 0.0) for i in range(1, 11)], "of equal vectors the smallest ids"
    far = (8**2 + 1) ** 0.5
    assert sorted(got[100]) == sorted((i, s) for i in range(10) for s in (1.0, far)), "each vector of an id asks"
    assert len(got[100]) == 20 and got[200] == [(201, 2**0.5)] and set(got) == {0, 100, 200}


def test_neighbours_of_an_empty_table(spark):
    assert near_of(spark, []) == {}


def test_neighbours_recall_on_the_given_vectors(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    pdf = df.select("vec_id", "embedding").toPandas().dropna()
    ids, x = pdf["vec_id"].to_numpy(), np.stack(pdf["embedding"].to_numpy()).astype(float)
    got, hits, asked = collections.defaultdict(set), 0, 0
    for r in ann.search(df, query=F.col("vec_id") % 20 == 0).collect():
        got[r.query_id].add(r.vec_id)
    for i in np.flatnonzero(ids % 20 == 0):
        d = ((x - x[i]) ** 2).sum(axis=1)
        want = [v for v in ids[np.lexsort((ids, d))] if v != ids[i]][:10]
        hits, asked = hits + len(got[ids[i]] & set(want)), asked + 10
    assert hits >= 0.9 * asked


def test_url_tree_rejects_and_spares(spark):
    rules = (("bad.org", "/shop/", "block"), ("good.org", "/news/", "allow"), ("mixed.org", "/a/", "block"), ("mixed.org", "/b/", "allow"))
    urls = [f"http://bad.org/{s}/{i}" for s in ("shop",) for i in range(40)] + [f"http://bad.org/store/{i}" for i in range(12)]
    urls += [f"http://good.org/news/{i}" for i in range(40)] + [f"http://good.org/blog/{i}" for i in range(12)]
    urls += [f"http://mixed.org/{s}/{i}" for s in "ab" for i in range(30)] + [f"http://mixed.org/c/{i}" for i in range(15)]
    urls += [f"http://other.org/{s}/{i}" for s in ("shop", "x") for i in range(20)]
    deep = "/".join("abcdefghijkl")
    urls += [f"http://bad.org/z/{deep}/{i}" for i in range(3)] + ["http://bad.org/", "http://bad.org/about/team/us"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("host", F.lit(1)).withColumn("template", F.lit("x"))
    got = {urls[r.page_id]: r for r in url_tree.judge(pages, rules=rules).collect()}
    verdict = lambda part: {r.verdict for u, r in got.items() if part in u}
    assert verdict("bad.org/store/") == {"block"}, "alike in shape and mostly known to be bad"
    assert verdict("good.org/") == verdict("other.org/") == verdict("mixed.org/c/") == verdict("about/team") == {"allow"}
    assert {got[u].template.count("/") for u in urls if deep in u} == {14}, "no level is cut off"


def test_mixing_of_clashing_names_and_nulls(spark):
    df = docs(spark, edge_rows()).withColumn("size", F.lit("s")).withColumn("a.b", F.lit(1)).withColumn("h", F.lit(None).cast("int"))
    assert mixing.mix(df).columns == df.columns


def test_mixing_of_repeated_rows(spark):
    rows = [(1, "a b c d", "x"), (1, "a b c d", "x"), (1, "a b c d", "x"), (2, "e f g h", "x"), (3, " ".join("ijklmnopqrst"), "y"), (None, "u v", None)]
    df = docs(spark, rows)
    taken = collections.Counter(r.text for r in mixing.mix(df).collect())
    want = collections.Counter()
    for r in mixing.allot(df).collect():
        want[next(t for d, t, s in rows if d == r.doc_id and s == r.source)] += r.copies
    assert taken == want and sum(taken.values()) > 0


@pytest.mark.parametrize("n", [0, 1])
def test_smallest_tables(spark, n):
    rows = docs(spark, [(1, "only one line here", "a")][:n])
    assert line_dedup.clean(rows).count() == exact_dedup.dedup(rows).count() == n


def test_pipeline_against_plain_python(spark):
    """Each stage's rows from its own input, by the plainest way to them."""
    import hashlib

    import corpus_pipeline
    import public_tokenizers
    from test_operators import SF, library, shingled

    from schemaloom.llm import quality_cnn

    start = spark.read.parquet(f"{SF}/documents.parquet")
    kept = {r.doc_id: r.text or "" for r in corpus_pipeline.quality(spark, start, SF).collect()}
    w = quality_cnn.fit(start, spark.read.parquet(f"{SF}/labels.parquet"))
    assert set(kept) == {r.doc_id for r in start.collect() if quality_cnn.score_text(w, r.text or "") >= quality_cnn.THRESHOLD}
    largest = {t: max(d for d, u in kept.items() if u == t) for t in kept.values()}
    good = start.where(F.col("doc_id").isin(list(kept)))
    assert {r.doc_id for r in corpus_pipeline.exact(spark, good, SF).collect()} == set(largest.values())

    ids = sorted(largest.values())
    sets, least = {d: shingled(kept[d]) for d in ids}, {d: d for d in ids}

    def find(d):
        while least[d] != d:
            d = least[d]
        return d

    for i, a in enumerate(ids):
        for b in ids[:i]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                least[y] = x
    alone = good.where(F.col("doc_id").isin(ids))
    near = {r.doc_id for r in corpus_pipeline.near(spark, alone, SF).collect()}
    assert near == {d for d in ids if find(d) == d}
    last = good.where(F.col("doc_id").isin(list(near)))
    taken = collections.Counter(r.doc_id for r in corpus_pipeline.mix(spark, last, SF).collect())
    assert taken == {r.doc_id: r.copies for r in mixing.allot(last).collect() if r.copies} and max(taken.values()) <= 3
    coder = library(public_tokenizers.path("word_bpe_49k.json"))
    for r in corpus_pipeline.encode(spark, last.limit(40), SF).collect():
        got = coder.encode(kept[r.doc_id], add_special_tokens=False).ids
        sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(got), sha(" ".join(map(str, got))), sha(coder.decode(got, skip_special_tokens=False)))
