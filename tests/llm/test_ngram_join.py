import random
import re

import numpy as np
import pyarrow as pa

from sluice.llm import ngram_join
from sluice.llm.ngram_join import join_documents, keep_one_of_each

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text, size=4):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} or ({tuple(w)} if w else set())


def brute(docs, size=4, percent=85):
    sets = [(i, shingles(t, size)) for i, t in docs]
    root = {i: i for i, _ in docs}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {i: (len(a), find(i)) for i, a in sets}


def edited(rng, text, p):
    return " ".join(w if rng.random() > p else rng.choice([w + "x", w.upper(), "new"]) for w in text.split(" "))


def made(rng, n, copies):
    vocabulary = ["".join(rng.choices("etaoinshrdlué", k=rng.randint(2, 6))) for _ in range(150)]
    texts = [" ".join(rng.choices(vocabulary, k=rng.randint(1, 150))) for _ in range(n)]
    passage = " ".join(rng.choices(vocabulary, k=60))
    texts += [passage + " " + " ".join(rng.choices(vocabulary, k=rng.randint(5, 60))) for _ in range(n // 2)]
    texts += [edited(rng, rng.choice(texts), rng.choice([0, 0.01, 0.02, 0.03, 0.05])) for _ in range(copies)]
    hot = " ".join(rng.choices(vocabulary, k=90))
    texts += [edited(rng, hot, 0.012) for _ in range(copies)]
    texts += ["", None, "   \n", "a b", "A  b", "a b c", "\x00 \x00"]
    rng.shuffle(texts)
    return list(enumerate(texts))


def got(spark, docs):
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("doc_id", "text", "1 AS n", "2 AS id", "3 AS bucket").repartition(3)
    return {r.doc_id: (r.n_shingles, r.component_id) for r in join_documents(df).collect()}


def test_against_all_pairs(spark):
    docs = made(random.Random(5), 150, 150)
    want = brute(docs)
    assert len({c for _, c in want.values()}) < len(docs) - 100
    assert got(spark, docs) == want


def test_many_tiles_and_frequent_shingles(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "TILE", 4)
    monkeypatch.setattr(ngram_join, "MOST_FREQUENT", 0)
    docs = made(random.Random(6), 60, 90)
    assert got(spark, docs) == brute(docs)


def test_bound_never_excludes_a_link():
    rng = np.random.default_rng(0)
    for _ in range(50):
        a = np.unique(rng.integers(0, 1 << 62, rng.integers(1, 4000)).astype(np.uint64))
        keep = a[rng.random(len(a)) < rng.choice([1, 0.95, 0.9])]
        b = np.union1d(keep, rng.integers(0, 1 << 62, rng.integers(0, max(1, len(a) // 10))).astype(np.uint64))
        common = len(np.intersect1d(a, b))
        packed = ngram_join.folded([ngram_join.bitmap(x) for x in (a, b)])
        linked = 100 * common >= 85 * (len(a) + len(b) - common)
        assert not linked or ngram_join.may_link(np.array([len(a)]), packed[:1], np.array([len(b)]), packed[1:])[0, 0]


def test_edges(spark):
    text = "one two three four five six seven"
    docs = [(1, text), (1, text), (2, text.upper()), (None, text), (3, None), (4, "x " * 50_000), (5, "x " * 50_000 + "y")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    found = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in join_documents(df).collect()), key=str)
    assert found == sorted([(1, 4, 1), (1, 4, 1), (2, 4, 1), (None, 4, None), (3, 0, 3), (4, 1, 4), (5, 2, 5)], key=str)
    assert sorted(r.doc_id or 0 for r in keep_one_of_each(df).collect()) == [0, 1, 1, 3, 4, 5]
    assert join_documents(df.limit(0)).count() == 0


def test_kernel_sets():
    texts = ["a b c d e", "A\tb", None, "é ü  ß\nx y", "a b c d a b c d a b c d"]
    h, rows = ngram_join.distinct_shingles(pa.array(texts), 4)
    assert np.diff(rows).tolist() == [len(shingles(t)) for t in texts]


def test_small_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in join_documents(docs).collect()} == brute(rows)


def test_buckets_have_short_names(spark, monkeypatch):
    # prefixes were shuffled as whole hashes
    names, keep = [], ngram_join.Scratch.keep

    def seen(self, df):
        out = keep(self, df)
        if set(out.columns) == {"bucket", "id", "c"}:
            names.extend(r.bucket for r in out.collect())
        return out

    monkeypatch.setattr(ngram_join.Scratch, "keep", seen)
    text = " ".join(f"w{i}" for i in range(60))
    docs = spark.createDataFrame([(0, text), (1, text + " more"), (2, "other " + text), (3, "alone")], "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in ngram_join.join_documents(docs).collect()} == {0: 0, 1: 0, 2: 0, 3: 3}
    assert names and all(0 <= x < 1 << 40 for x in names)
