"""Spelling variants: words of a corpus at one edit from each other, and the frequent form of rare ones (operator 12).

Words are counted per task (a hash of id and run may plant a misspelling, see ``count_words``), added up, and those that
are long and frequent enough are compared.

The pairs come from a pigeonhole join on even partitions. A word of length l is cut into two segments. If another word
of length l or l + 1 arises from it by one edit, the edit lies in one of them, so the other one is there unchanged: the
first at its place, the second moved by the difference of the lengths. Every word is indexed by (l, segment) twice, and
probes with its substrings at those places for l and for l - 1. Candidates that meet are verified by their distance, and
a pair that meets twice is kept once.

Short segments are shared by many words. A key that many index rows and many probes have is not joined; its rows go to
the next level, where the segment that holds the edit is cut in two again, so that all but a quarter of a word must
match, then all but an eighth, until few rows share a key or the open segment has one letter. There, all who share a key
are variants of each other, bounded by the alphabet. No key's rows are paired with each other beyond that, and none are dropped.

A word's form is its most frequent near word, if that is ``ratio`` times as frequent. Forms of forms get more frequent by
that ratio, so a few rounds of pointer doubling lead each word to its root.

Defined results: null and empty texts have no words. A null id counts as an empty text where misspellings are planted.
Repeated rows count as often as they occur; ties between forms go to the smaller word in the order of code points; an
empty table gives no rows. Other columns are not read. A text, and a word, are in memory at once.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.llm.base import Scratch, map_texts, pieces

MIN_LENGTH, MIN_COUNT, RATIO = 6, 5, 5
PIECE_BYTES = 1 << 20
#: Distinct words that a counting task adds up before it passes them on, and bytes of the texts that they come from.
COUNTED_WORDS, COUNTED_BYTES = 400_000, 64 << 20
#: A key that more index rows and more probes than this have goes to the next level.
CROWDED = 64


def count_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT, noise: int | None = None) -> DataFrame:
    """word and n of runs of letters from A to U+00FF, A-Z lower-cased, that are long and frequent enough.

    With ``noise``, a run for which that number divides h, the crc32 of "id:run", first loses its letter h % length.
    """
    # a run that loses a letter must be long enough then
    run = re.compile(f"[a-zÀ-ÿ]{{{max(1, min_length)},}}")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[str] = Counter()
        nbytes = 0

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_pydict({"word": pa.array(list(total), pa.string()), "n": pa.array(list(total.values()), pa.int64())})
            total.clear()
            return out

        for batch in pieces(batches, "text", PIECE_BYTES):
            for doc, text in zip(batch.column("id").to_pylist(), pc.ascii_lower(batch.column("text")).to_pylist(), strict=True):
                words = run.findall(text or "")
                if noise is None:
                    total.update(words)
                    continue
                before = zlib.crc32(f"{doc}:".encode())
                for word, n in Counter(words).items():
                    h = zlib.crc32(word.encode(), before)
                    if not h % noise:
                        at = h % len(word)
                        word = word[:at] + word[at + 1 :]
                        if len(word) < min_length:
                            continue
                    total[word] += n
            nbytes += batch.nbytes
            if len(total) > COUNTED_WORDS or nbytes > COUNTED_BYTES:
                yield flush()
                nbytes = 0
        yield flush()

    words = map_texts(docs, count, "word string, n long", id=F.coalesce(F.col(id_col).cast("string"), F.lit("")), text=F.col(text_col))
    return words.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_count)


def _segments(rows: DataFrame) -> DataFrame:
    """Each row's open segment, from a to b of the indexed word, cut in two, with the key of all that must match."""
    middle = F.expr("(a + b) div 2")
    rows = rows.withColumn("half", F.explode(F.array(F.struct(F.col("a"), middle.alias("b")), F.struct(middle.alias("a"), F.col("b")))))
    rows = rows.select("word", "n", "size", "moved", "probe", "half.a", "half.b")
    before, after = F.substr("word", F.lit(1), F.col("a")), F.substr("word", F.expr("b + moved + 1"), F.col("size"))
    return rows.withColumn("key", F.xxhash64("size", "a", "b", before, after))


def _roles(words: DataFrame) -> DataFrame:
    """Every word as indexed, as a probe of its own length, and as a probe of the next shorter one."""
    size = F.length("word")
    role = lambda n, moved, probe: F.struct(n.alias("size"), F.lit(moved).alias("moved"), F.lit(probe).alias("probe"))
    rows = words.withColumn("role", F.explode(F.array(role(size, 0, False), role(size, 0, True), role(size - 1, 1, True))))
    return rows.select("word", "n", "role.*").filter(F.col("size") > 0).withColumns({"a": F.lit(0), "b": F.col("size")})


def near_pairs(words: DataFrame, scratch: Scratch, crowded: int = CROWDED) -> DataFrame:
    """u, u_n, v, v_n of all pairs of distinct words at exactly one edit, each pair once."""
    found: list[DataFrame] = []
    rows = _roles(words)
    while True:
        rows = scratch.keep(_segments(rows))
        counts = rows.groupBy("key").agg(F.count_if(~F.col("probe")).alias("indexed"), F.count_if("probe").alias("probes"), F.max(F.col("b") - F.col("a")).alias("open"))
        hot = scratch.keep(counts.filter((F.col("indexed") > crowded) & (F.col("probes") > crowded) & (F.col("open") > 1)).select("key"))
        some = not hot.isEmpty()
        closed = rows.join(hot, "key", "left_anti") if some else rows
        indexed = closed.filter(~F.col("probe")).select("key", F.col("word").alias("u"), F.col("n").alias("u_n"))
        probes = closed.filter("probe").select("key", F.col("word").alias("v"), F.col("n").alias("v_n"), "moved")
        # words of equal length meet in both roles
        met = indexed.join(probes, "key").filter((F.col("moved") == 1) | (F.col("u") < F.col("v"))).filter(F.levenshtein("u", "v", 1) == 1)
        found.append(scratch.keep(met.select("u", "u_n", "v", "v_n")))
        if not some:
            return reduce(DataFrame.unionByName, found).distinct()
        rows = rows.join(hot, "key", "left_semi").drop("key")


def _doublings(words: DataFrame, ratio: int) -> int:
    """Rounds after which pointers reach the end: n grows by ``ratio`` with each form."""
    n = words.agg(F.min("n").alias("least"), F.max("n").alias("most")).first()
    depth = math.floor(math.log(n.most / n.least, ratio) + 1e-9) if n.most else 0
    return max(0, math.ceil(math.log2(depth))) if depth > 1 else 0


def group_variants(words: DataFrame, ratio: int = RATIO, crowded: int = CROWDED) -> DataFrame:
    """word, form, root, n, n_near, form_n of each word of a table of distinct words and their counts n."""
    if ratio < 2:
        raise ValueError("a form must be at least twice as frequent")
    scratch = Scratch(words.sparkSession, "spelling")
    words = scratch.keep(words)
    pairs = near_pairs(words, scratch, crowded)
    side = lambda a, b: F.struct(F.col(a).alias("word"), F.col(f"{a}_n").alias("own"), F.struct((-F.col(f"{b}_n")).alias("less"), F.col(b).alias("near")).alias("near"))
    both = pairs.select(F.explode(F.array(side("u", "v"), side("v", "u"))).alias("s")).select("s.*")
    best = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min("near").alias("best"), F.first("own").alias("own"))
    enough = -F.col("best.less") >= ratio * F.col("own")
    forms = scratch.keep(best.select("word", "n_near", F.when(enough, F.col("best.near")).alias("form"), F.when(enough, -F.col("best.less")).alias("form_n")))
    links = forms.filter("form IS NOT NULL").select("word", F.col("form").alias("root"))
    for _ in range(_doublings(words, ratio)):
        further = links.select(F.col("word").alias("root"), F.col("root").alias("next"))
        links = scratch.keep(links.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root")))
    out = words.join(forms, "word", "left").join(links, "word", "left")
    zero: Column = F.lit(0).cast("long")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", zero).alias("n_near"), "form_n")
