"""Benchmark decontamination by suffix arrays over training shards (operator 1).

Each shard (a few MB of documents) becomes one sequence of word ids, in which words that no test item has
are 0. Its suffix array is sorted by the first words of each suffix; only suffixes that start like a window
are in it, since no other can match. Every test suffix with a whole window is looked up by binary search,
which gives the interval of the training suffixes that begin with it, and so all verbatim occurrences.
Matches are joined along the item, which gives the longest ones with their places.

Word ids come from 64-bit hashes; each word of a match is then compared by its bytes.

Scale: documents are read once and never shuffled. Test items are taken in blocks of BLOCK_BYTES, of which the
driver and the executors hold one at a time; a larger benchmark means more passes, not a larger broadcast. With
more than one block, documents are written once with row numbers, so that all passes see the same rows, and each
pass writes only the rows that have matches.

Defined results: null texts and texts without words have no words and no hits. An item without words, or with
a null id, matches nothing; rows of one item id count as one item. Repeated documents each give a row.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.llm.base import Scratch, bounded_batches, map_texts, pieces
from sluice.llm.kernels import Words, alnum_table, words

WINDOW = 10
SHARD_BYTES = 512 << 10
#: Bytes of test items in a block, which bound what is sent to the executors at once.
BLOCK_BYTES = 8 << 20
_LUT = alnum_table()


class ItemIndex:
    """Windows of a block of test items as sorted keys of word ids."""

    def __init__(self, items: list[tuple[str, str]], window: int = WINDOW):
        self.window = window
        w = words(pa.array([t for _, t in items], pa.string()), _LUT)
        vocabulary: dict[bytes, int] = {}
        ids = np.array([vocabulary.setdefault(w.text(i), len(vocabulary) + 1) for i in range(len(w.starts))], np.int64)
        hashes = np.zeros(len(vocabulary), np.uint64)
        hashes[ids - 1] = w.hashes()
        order = np.argsort(hashes)
        self.texts = [b"", *vocabulary]
        self.hashes, self.hash_ids = hashes[order], order + 1
        self.items = [i for i, _ in items]
        # one row for each window: its words padded with zeros, item, position
        rows: dict[bytes, int] = {}
        sizes, self.places = [], []
        for k in range(len(items)):
            seq = ids[w.rows[k] : w.rows[k + 1]]
            n = min(window, len(seq))
            for at in range(len(seq) - n + 1) if n else ():
                key = self.key(seq[at : at + n])
                if key not in rows:
                    rows[key] = len(rows)
                    sizes.append(n)
                    self.places.append([])
                self.places[rows[key]].append((k, at))
        self.sizes = np.array(sizes, np.int64)
        width = 4 * window
        self.low = np.array([k.ljust(width, b"\0") for k in rows], f"S{width}")
        self.high = np.array([k.ljust(width, b"\xff") for k in rows], f"S{width}")
        starts = np.array([np.frombuffer(k[:4], ">u4")[0] for k in rows], np.int64)
        second = np.array([np.frombuffer(k[4:8], ">u4")[0] if len(k) > 4 else 0 for k in rows], np.int64)
        self.pairs = np.unique(starts[second > 0] << 32 | second[second > 0])
        self.single = np.unique(starts[second == 0])

    @staticmethod
    def key(ids: np.ndarray) -> bytes:
        return ids.astype(">u4").tobytes()

    def word_ids(self, w: Words) -> np.ndarray:
        """Ids of the words of a shard, 0 for those that no item has."""
        h = w.hashes()
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        return np.where(self.hashes[at] == h, self.hash_ids[at], 0)

    def occurrences(self, w: Words) -> tuple[np.ndarray, np.ndarray]:
        """(word of the shard, window) of every occurrence."""
        none = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if not len(self.low) or not len(w.starts):
            return none
        ids, row = self.word_ids(w), w.row_of_word()
        # a zero after each row keeps matches inside it
        seq = np.zeros(len(ids) + len(w.rows) + self.window, np.int64)
        place = np.arange(len(ids)) + row
        seq[place] = ids
        following = seq[place + 1]
        pair = ids << 32 | following
        begins = (ids > 0) & (following > 0)
        begins[begins] = self._has(self.pairs, pair[begins])
        if len(self.single):
            begins |= self._has(self.single, ids)
        suffixes = np.flatnonzero(begins)
        if not len(suffixes):
            return none
        matrix = seq[place[suffixes][:, None] + np.arange(self.window)].astype(">u4")
        keys = np.ascontiguousarray(matrix).view(f"S{4 * self.window}").ravel()
        array = np.argsort(keys, kind="stable")  # the suffix array
        keys = keys[array]
        lo, hi = np.searchsorted(keys, self.low, "left"), np.searchsorted(keys, self.high, "right")
        found = np.flatnonzero(hi > lo)
        n = (hi - lo)[found]
        window = np.repeat(found, n)
        at = np.repeat(lo[found] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        word = suffixes[array[at]]
        return self._verified(w, ids, word, window)

    def _verified(self, w: Words, ids: np.ndarray, word: np.ndarray, window: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        covered = np.flatnonzero(cover(len(ids), word, self.sizes[window]))
        wrong = np.zeros(len(ids) + 1, np.int64)
        wrong[covered + 1] = [w.text(i) != self.texts[ids[i]] for i in covered.tolist()]
        before = np.cumsum(wrong)
        right = before[word + self.sizes[window]] == before[word]
        return word[right], window[right]

    @staticmethod
    def _has(among: np.ndarray, x: np.ndarray) -> np.ndarray:
        if not len(among):
            return np.zeros(len(x), bool)
        return among[np.minimum(np.searchsorted(among, x), len(among) - 1)] == x


def cover(n: int, at: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Which of ``n`` words lie in a span."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + sizes, -1)
    return np.cumsum(edge[:-1]) > 0


def longest_matches(index: ItemIndex, places: list[tuple[int, int]]) -> list[dict]:
    """Maximal matches of one document from its (word, window) pairs: item, places and number of words."""
    runs: dict[tuple[int, int], list[tuple[int, int]]] = {}
    for word, window in places:
        for item, at in index.places[window]:
            runs.setdefault((item, word - at), []).append((word, int(index.sizes[window])))
    out = []
    for (item, shift), spans in sorted(runs.items()):
        begin, end = None, None
        for word, n in sorted(spans):
            if begin is not None and word == last + 1:
                end, last = word + n, word
                continue
            if begin is not None:
                out.append({"item_id": index.items[item], "item_word": begin - shift, "doc_word": begin, "n_words": end - begin})
            begin, end, last = word, word + n, word
        out.append({"item_id": index.items[item], "item_word": begin - shift, "doc_word": begin, "n_words": end - begin})
    return out


def _usable(items: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, int]:
    """Items with an id and a text, and the number of blocks of about BLOCK_BYTES that they make, one at least."""
    rows = items.select(F.col(id_col).cast("string").alias("i"), F.col(text_col).alias("t")).filter("i IS NOT NULL AND t IS NOT NULL")
    total = rows.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    return rows, max(1, -(-total // BLOCK_BYTES))


def _index(rows: DataFrame, block: int, blocks: int, window: int) -> Broadcast[ItemIndex]:
    """The index of one block, sent to the executors; the driver keeps no block."""
    found = rows.filter(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == block).distinct().collect()
    return rows.sparkSession.sparkContext.broadcast(ItemIndex([(r.i, r.t) for r in sorted(found)], window))


def _scan(batches: Iterator[pa.RecordBatch], index: ItemIndex) -> Iterator[tuple[pa.RecordBatch, Words, np.ndarray, np.ndarray]]:
    for batch in pieces(batches, "text", SHARD_BYTES):
        w = words(batch.column("text"), _LUT)
        yield batch, w, *index.occurrences(w)


MATCH = "array<struct<item_id:string,item_word:long,doc_word:long,n_words:long>>"


def _matches_of(keyed: DataFrame, sent: Broadcast[ItemIndex], only_hits: bool) -> DataFrame:
    """id (row), n_words, spans of hit words, items and longest matches of each row, or of those that have any."""
    schema = f"id {keyed.schema['id'].dataType.simpleString()}, n_words long, spans array<struct<s:long,e:long>>, items array<string>, matches {MATCH}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = sent.value
        for batch, w, word, span in _scan(batches, index):
            hit = cover(len(w.starts), word, index.sizes[span])
            row = np.searchsorted(w.rows, word, "right") - 1
            order = np.argsort(row, kind="stable")
            word, span, row = word[order], span[order], row[order]
            bounds = np.searchsorted(row, np.arange(batch.num_rows + 1))
            spans, found, matches, keep = [], [], [], []
            for i, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)):
                if a == b and only_hits:
                    continue
                keep.append(i)
                local = hit[w.rows[i] : w.rows[i + 1]].astype(np.int8) if a < b else np.zeros(0, np.int8)
                change = np.flatnonzero(np.diff(local, prepend=0, append=0))
                spans.append([{"s": s, "e": e} for s, e in change.reshape(-1, 2).tolist()])
                found.append(sorted({index.items[k] for s in set(span[a:b].tolist()) for k, _ in index.places[s]}))
                matches.append(longest_matches(index, list(zip((word[a:b] - w.rows[i]).tolist(), span[a:b].tolist(), strict=True))))
            keep = np.array(keep, np.int64)
            yield pa.RecordBatch.from_pydict({
                "id": batch.column("id").take(pa.array(keep)), "n_words": pa.array(np.diff(w.rows)[keep], pa.int64()),
                "spans": pa.array(spans, pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64())]))), "items": pa.array(found, pa.list_(pa.string())),
                "matches": pa.array(matches, pa.list_(pa.struct([("item_id", pa.string()), ("item_word", pa.int64()), ("doc_word", pa.int64()), ("n_words", pa.int64())]))),
            })

    return map_texts(keyed, run, schema, id=F.col("id"), text=F.col("text"))


def find_matches(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """One row per document: id, n_words, n_hit, items (ids as sorted strings) and matches.

    ``matches`` has the longest verbatim matches, in no given order: item_id, item_word, doc_word, n_words.
    """
    rows, blocks = _usable(items, item_id_col, item_text_col)
    keyed = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    if blocks == 1:
        out = _matches_of(keyed, _index(rows, 0, 1, window), only_hits=False)
    else:
        scratch = Scratch(docs.sparkSession, "matches")
        texts = scratch.keep(keyed.withColumnRenamed("id", "own").withColumn("id", F.monotonically_increasing_id()))
        parts = []
        for block in range(blocks):
            sent = _index(rows, block, blocks, window)
            parts.append(scratch.keep(_matches_of(texts.select("id", "text"), sent, only_hits=True)))
            sent.destroy()
        found = reduce(DataFrame.unionByName, parts).groupBy("id").agg(
            F.flatten(F.collect_list("spans")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), F.flatten(F.collect_list("matches")).alias("matches")
        )
        counted = map_texts(texts, _word_counts, f"own {docs.schema[id_col].dataType.simpleString()}, id long, n_words long", own=F.col("own"), id=F.col("id"), text=F.col("text"))
        empty = lambda c: F.coalesce(c, F.array().cast(found.schema[c].dataType)).alias(c)
        out = counted.join(found, "id", "left").select(F.col("own").alias("id"), "n_words", *(empty(c) for c in ("spans", "items", "matches")))
    return out.select(F.col("id").alias(id_col), "n_words", _covered("spans").alias("n_hit"), "items", "matches")


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches, "text", SHARD_BYTES):
        yield pa.RecordBatch.from_pydict({"own": batch.column("own"), "id": batch.column("id"), "n_words": pa.array(np.diff(words(batch.column("text"), _LUT).rows), pa.int64())})


def _covered(spans: str) -> Column:
    """Number of words in the union of spans."""
    start = F.struct(F.lit(0).cast("long").alias("total"), F.lit(0).cast("long").alias("end"))
    add = lambda acc, x: F.struct(
        (acc["total"] + F.greatest(F.lit(0).cast("long"), x["e"] - F.greatest(x["s"], acc["end"]))).alias("total"), F.greatest(acc["end"], x["e"]).alias("end")
    )
    return F.aggregate(F.array_sort(spans), start, add, lambda acc: acc["total"])


def drop_contaminated(docs: DataFrame, items: DataFrame, text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """The documents, with all their columns, that hold no window of any item; no shuffle."""
    rows, blocks = _usable(items, item_id_col, item_text_col)
    if blocks == 1:
        return _without_hits(docs, _index(rows, 0, 1, window), text_col)
    scratch, out = Scratch(docs.sparkSession, "clean"), docs
    for block in range(blocks):
        sent, before = _index(rows, block, blocks, window), out
        out = scratch.keep(_without_hits(before, sent, text_col))
        sent.destroy()
        if block:
            scratch.drop(before)
    return out


def _without_hits(docs: DataFrame, sent: Broadcast[ItemIndex], text_col: str) -> DataFrame:
    """The rows without an occurrence of any window of one block."""
    bounded_batches(docs.sparkSession)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = [f"c{i}" for i in range(batch.num_columns)]
            names[at] = "text"
            for part in pieces([pa.RecordBatch.from_arrays(batch.columns, names=names)], "text", SHARD_BYTES):
                w = words(part.column("text"), _LUT)
                word, _ = sent.value.occurrences(w)
                keep = np.ones(part.num_rows, bool)
                keep[np.searchsorted(w.rows, word, "right") - 1] = False
                yield pa.RecordBatch.from_arrays(part.filter(pa.array(keep)).columns, names=batch.schema.names)

    return docs.mapInArrow(run, docs.schema)
