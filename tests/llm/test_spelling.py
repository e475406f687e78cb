import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from sluice.llm import spelling
from sluice.llm.base import Scratch
from sluice.llm.spelling import count_words, group_variants, near_pairs


def counted(rows, noise):
    total = Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if noise and h % noise == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            total[run] += 1
    return {w: n for w, n in total.items() if len(w) >= 6 and n >= 5}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(a) + 1 == len(b) and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def grouped(words):
    near = {w: [v for v in words if one_edit(w, v)] for w in words}
    form = {w: (min(near[w], key=lambda v: (-words[v], v)) if near[w] else None) for w in words}
    form = {w: f if f and words[f] >= 5 * words[w] else None for w, f in form.items()}
    out = set()
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, n, len(near[w]), words[form[w]] if form[w] else None))
    return out


def made(seed, n, letters="abcé", sizes=(6, 9)):
    rng = random.Random(seed)
    out = {}
    for _ in range(n):
        w = "".join(rng.choices(letters, k=rng.randint(*sizes)))
        out[w] = 5 + rng.choice([0, 1, 20, 25, 150, 5000])
        for _ in range(rng.randint(0, 2)):
            i = rng.randrange(len(w))
            v = rng.choice([w[:i] + rng.choice(letters) + w[i + 1 :], w[:i] + rng.choice(letters) + w[i:], w[:i] + w[i + 1 :]])
            if len(v) >= 6:
                out[v] = 5 + rng.choice([0, 20, 900])
    return out


@pytest.mark.parametrize(("letters", "crowded"), [("abcé", 1000), ("abcé", 2), ("ab", 4), ("aÿ", 1), ("abcdefghijklmnopqrstuvwxyzé", 64)])
def test_groups_against_brute_force(spark, letters, crowded):
    words = made(len(letters) + crowded, 250, letters)
    df = spark.createDataFrame(list(words.items()), "word string, n long").repartition(3)
    assert {tuple(r) for r in group_variants(df, crowded=crowded).collect()} == grouped(words)


def test_long_chains_and_ties(spark):
    words = {"aaaaaa" + "b" * k: 5 ** (k + 1) for k in range(12)} | {"zzzzza": 5, "zzzzzb": 25, "zzzzzc": 25, "yyyyyy": 5, "yyyyyyy": 24, "x" * 3000: 7, "x" * 2999: 40}
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    got = {tuple(r) for r in group_variants(df).collect()}
    assert got == grouped(words)
    found = {r[0]: r for r in got}
    assert found["aaaaaa"][2] == "aaaaaa" + "b" * 11
    assert found["zzzzza"][1] == "zzzzzb" and found["yyyyyy"][1] is None and found["x" * 3000][1] == "x" * 2999


def test_no_pairs_within_crowded_keys(spark):
    # thousands of words share their first half, hardly any are near each other
    rng = random.Random(3)
    words = {"commonstem" + "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=10)): 5 for _ in range(4000)}
    words |= {"commonstemabcdefghi" + c: 9 for c in "xyz"}
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    got = near_pairs(df, Scratch(spark, "test")).collect()
    assert {(r.u, r.v) for r in got} >= {("commonstemabcdefghi" + a, "commonstemabcdefghi" + b) for a, b in ("xy", "xz", "yz")}
    assert len(got) == 3
    rows = spelling._segments(spelling._roles(df))
    pairs = rows.groupBy("key").agg((F.count_if("probe") * F.count_if(~F.col("probe"))).alias("k"), F.count_if("probe").alias("p"), F.count_if(~F.col("probe")).alias("i"))
    assert pairs.agg(F.sum("k")).first()[0] > 8_000_000  # what the first level alone would compare
    assert pairs.filter(f"p <= {spelling.CROWDED} OR i <= {spelling.CROWDED}").agg(F.sum("k")).first()[0] < 400_000


@pytest.mark.parametrize("noise", [None, 3, 199])
def test_counts_against_brute_force(spark, noise):
    rng = random.Random(4)
    words = ["Straßenbahn", "éÀÿ×÷abc", "UPPERcase", "hello", "sevens", "sixsix", "ÀÉÎÕÜß", "日本語abcdefg", "it's-a-hyphenword"]
    rows = [(i, " ".join(rng.choices(words, k=40))) for i in range(60)] + [(None, "nullid " * 9), (70, None), (71, ""), (72, "a" * 100_000)] + [(73, "again and againagain")] * 6
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, word string, n int").repartition(3)
    assert {r.word: r.n for r in count_words(df, noise=noise).collect()} == counted(rows, noise)


def test_counts_are_passed_on_in_blocks(spark, monkeypatch):
    # the function that goes to the workers reads the module's bounds, so they are small texts in one process here
    monkeypatch.setattr(spelling, "PIECE_BYTES", 64)
    rows = [(i, f"repeated wording{'abcde'[i % 5] * 3}") for i in range(50)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.word: r.n for r in count_words(df).collect()} == counted(rows, None)


def test_empty(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert group_variants(count_words(empty)).count() == 0
    assert group_variants(count_words(spark.createDataFrame([(1, None)], "doc_id long, text string"))).columns == ["word", "form", "root", "n", "n_near", "form_n"]


def test_bad_ratio(spark):
    with pytest.raises(ValueError, match="twice"):
        group_variants(spark.createDataFrame([("abcdef", 5)], "word string, n long"), ratio=1)
