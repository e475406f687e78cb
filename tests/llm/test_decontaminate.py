import random
import re

from sluice.llm import decontaminate
from sluice.llm.decontaminate import drop_contaminated, find_matches

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def tokens(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, window=10):
    windows = {}
    for i, t in items:
        w = tokens(t)
        n = min(window, len(w))
        if i is not None and n:
            for k in range(len(w) - n + 1):
                windows.setdefault(tuple(w[k : k + n]), set()).add(str(i))
    out = {}
    for i, t in docs:
        w = tokens(t)
        hit, found = set(), set()
        for k in range(len(w)):
            for n in {len(x) for x in windows}:
                if tuple(w[k : k + n]) in windows and k + n <= len(w):
                    hit |= set(range(k, k + n))
                    found |= windows[tuple(w[k : k + n])]
        out[i] = (len(w), len(hit), sorted(found))
    return out


def cases():
    rng = random.Random(3)
    vocabulary = ["a", "bc", "déjà", "x1", "the", "of", "Zu", "ß"]
    text = lambda n: " ".join(rng.choices(vocabulary, k=n))
    items = [(i, text(rng.randint(1, 30))) for i in range(3, 12)] + [(20, None), (21, "..."), (22, "Solo-word, pair"), (None, "a bc"), (30, text(14)), (30, text(14))]
    docs = [(i, text(rng.randint(0, 120))) for i in range(60)]
    docs += [(100, None), (101, ""), (102, "!!"), (103, items[0][1].upper()), (104, "solo WORD"), (105, "solo word pair solo word pair"), (106, text(5000))]
    docs += [(107 + k, f"zzz {items[k][1]} yyy {items[k][1]}") for k in range(9)] + [(120, "\x00a\x00b " + items[1][1].replace(" ", ",\n"))]
    return docs, items


def check(spark, docs, items):
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    m = spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_hit, r["items"]) for r in find_matches(d, m).collect()}
    want = brute(docs, items)
    assert got == want
    kept = drop_contaminated(d.selectExpr("doc_id AS item_id", "text", "1 AS row"), m)
    assert {r.item_id for r in kept.collect()} == {i for i, x in want.items() if not x[1]}
    assert kept.columns == ["item_id", "text", "row"]


def test_against_brute_force(spark):
    check(spark, *cases())


def test_blocks_of_items(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 100)
    check(spark, *cases())


def test_shards(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "SHARD_BYTES", 300)
    check(spark, *cases())


def test_longest_match_and_places(spark):
    item = "one two three four five six seven eight nine ten eleven twelve"
    docs = [(1, f"lead {item} tail"), (2, "nothing here"), (3, " ".join(item.split()[1:]))]
    got = find_matches(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(7, item)], "item_id long, text string"))
    found = {r.doc_id: [tuple(m) for m in r.matches] for r in got.collect()}
    assert found == {1: [("7", 0, 1, 12)], 2: [], 3: [("7", 1, 0, 11)]}


def test_empty_tables(spark):
    d, m = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    assert find_matches(d, m).count() == 0
    one = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert [tuple(r)[:3] for r in find_matches(one, m).collect()] == [(1, 2, 0)]


def test_whole_table(spark):
    docs, items = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "benchmark"))
    want = brute([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()])
    got = {r.doc_id: (r.n_words, r.n_hit, r["items"]) for r in find_matches(docs, items).collect()}
    assert got == want and any(x[1] for x in got.values())
