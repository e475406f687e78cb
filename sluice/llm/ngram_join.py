"""Exact n-gram Jaccard join of documents by prefixes, size-banded tiles and bitmap signatures (operator 4).

A document's set is its distinct SIZE-word shingles as 64-bit hashes. Two documents link when
``100 * common >= PERCENT * union``.

1. Documents with one set are a class, represented by its smallest id; classes come from a grouped minimum.
2. Of linked sets, the first ``n - ceil(0.85 n) + 1`` shingles in any fixed order share one. The order is by
   hash, with frequent shingles last: those that many documents of a window have, found in a scan of all rows.
   The order affects speed alone. A shingle that two representatives have in these prefixes is a bucket.
3. First pass: each representative is compared with the least id among its buckets' members, and links are
   joined to components. A bucket whose members are in one component then needs no further comparison.
4. Second pass, for the other buckets, one of each set of members: members meet by size bands, in tiles of
   bounded size; a bucket of any size is split over as many tile pairs as it needs. Bitmap signatures bound
   the overlap from above: ``common <= n - |bits of one that the other lacks|``. Pairs of different
   components that may reach the threshold go on.
5. Pairs are verified by intersecting the sorted arrays.

So no link between different texts is lost, but links inside a component need not be found one by one.
Broadcasts: the frequent shingles (at most MOST_FREQUENT) and a bit table of fixed size.

Defined results: a null text or one without words has an empty set and is its own component; a null id has a
null component; rows with one id are one node, linked by any of its texts.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.llm.base import Scratch, bit_table, has_slot, map_texts, pieces, slot
from sluice.llm.components import connected_components
from sluice.llm.kernels import mix, shingle_hashes, spaced_table, words

SIZE, PERCENT = 4, 85
PIECE_BYTES = 512 << 10
#: Documents of a window of WINDOW_BYTES that must have a shingle for it to count as frequent there.
WINDOW_BYTES, FREQUENT = 16 << 20, 3
MOST_FREQUENT = 1 << 17
#: A bitmap has the least power of two of bits that is BITS_EACH times the set's size, within these bounds.
BITS_EACH, LEAST_BITS, MOST_BITS = 2, 256, 1 << 20
TILE = 512
#: Bits of a prefix shingle that name its bucket: shingles that fall together only add pairs to compare, and fewer bytes are shuffled.
BUCKET_BITS = 40
#: Members up to which a bucket's pairs are listed by size alone, before bitmaps are joined to distinct pairs.
SMALL = 32
_LUT = spaced_table()


def prefix_length(n: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """Shingles of a set of ``n`` of which one must be shared by every linked set."""
    return np.where(n > 0, n - (percent * n + 99) // 100 + 1, 0)


def distinct_shingles(column: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct hashes of each row, first of each row)."""
    h, rows = shingle_hashes(words(column, _LUT), size)
    row = np.repeat(np.arange(len(rows) - 1), np.diff(rows))
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    h, row = h[new], row[new]
    return h, np.searchsorted(row, np.arange(len(rows)))


def bitmap(h: np.ndarray) -> bytes:
    """A set's hashed bitmap. Its width is a power of two, so it can be folded to any smaller one."""
    width = min(MOST_BITS, max(LEAST_BITS, 1 << (BITS_EACH * len(h) - 1).bit_length())) if len(h) else LEAST_BITS
    bits = np.zeros(width, bool)
    bits[((h >> np.uint64(20)) & np.uint64(width - 1)).astype(np.int64)] = True
    return np.packbits(bits).tobytes()


def folded(bitmaps: list[bytes]) -> np.ndarray:
    """Bitmaps as rows of 64-bit words, folded to the narrowest."""
    least = min(map(len, bitmaps))
    out = np.empty((len(bitmaps), least), np.uint8)
    for i, x in enumerate(bitmaps):
        out[i] = np.bitwise_or.reduce(np.frombuffer(x, np.uint8).reshape(-1, least))
    return out.view(np.uint64)


def frequent_shingles(docs: DataFrame, text_col: str, size: int) -> np.ndarray:
    """At most MOST_FREQUENT hashes in ascending order of their counts, over all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        nbytes = 0

        def flush() -> pa.RecordBatch:
            h = np.concatenate(held) if held else np.zeros(0, np.uint64)
            held.clear()
            h.sort()
            # a hash that occurs n times is equal to the one FREQUENT - 1 places later n - FREQUENT + 1 times
            often, n = np.unique(h[: max(0, len(h) - FREQUENT + 1)][h[FREQUENT - 1 :] == h[: max(0, len(h) - FREQUENT + 1)]], return_counts=True)
            return pa.RecordBatch.from_pydict({"h": pa.array(often.view(np.int64)), "n": pa.array(n + FREQUENT - 1, pa.int64())})

        for batch in pieces(batches, "text", PIECE_BYTES):
            h, _ = distinct_shingles(batch.column("text"), size)
            held.append(h)
            nbytes += pc.sum(pc.binary_length(batch.column("text"))).as_py() or 0
            if nbytes > WINDOW_BYTES:
                yield flush()
                nbytes = 0
        yield flush()

    found = map_texts(docs, run, "h long, n long", text=F.col(text_col)).groupBy("h").agg(F.sum("n").alias("n"))
    rows = found.orderBy(F.desc("n"), "h").limit(MOST_FREQUENT).toArrow()
    order = np.lexsort((rows.column("h").to_numpy(), rows.column("n").to_numpy()))
    return rows.column("h").to_numpy()[order].view(np.uint64)


def _sketches(docs: DataFrame, id_col: str, text_col: str, size: int, percent: int) -> DataFrame:
    """id, n, two hashes of the set, prefix, bitmap of each document."""
    frequent = frequent_shingles(docs, text_col, size)
    by_hash = np.argsort(frequent)
    sent = docs.sparkSession.sparkContext.broadcast((frequent[by_hash], by_hash + 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, place = sent.value
        for batch in pieces(batches, "text", PIECE_BYTES):
            h, rows = distinct_shingles(batch.column("text"), size)
            n = np.diff(rows)
            row = np.repeat(np.arange(len(n)), n)
            late = np.zeros(len(h), np.int64)
            if len(known):
                at = np.minimum(np.searchsorted(known, h), len(known) - 1)
                late = np.where(known[at] == h, place[at], 0)
            order = np.lexsort((h, late, row))
            first = prefix_length(n, percent)
            inside = np.arange(len(h)) - rows[row] < first[row]
            prefix = h[order][inside].view(np.int64)
            sums = [np.concatenate([[np.uint64(0)], np.cumsum(mix(h ^ np.uint64(s)), dtype=np.uint64)]) for s in (1, 2)]
            yield pa.RecordBatch.from_pydict({
                "id": batch.column("id"), "n": pa.array(n, pa.int64()), **{f"s{k}": pa.array((x[rows[1:]] - x[rows[:-1]]).view(np.int64)) for k, x in enumerate(sums)},
                "prefix": pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(first)]), pa.int32()), pa.array(prefix)),
                "bitmap": pa.array([bitmap(h[a:b]) for a, b in zip(rows[:-1].tolist(), rows[1:].tolist(), strict=True)], pa.binary()),
            })

    kind = docs.schema[id_col].dataType.simpleString()
    return map_texts(docs, run, f"id {kind}, n long, s0 long, s1 long, prefix array<long>, bitmap binary", id=F.col(id_col), text=F.col(text_col))


def _arrays(docs: DataFrame, ids: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """id and sorted shingles of documents that pass the bit table of ``ids``; others are skipped in the scan."""
    sent = docs.sparkSession.sparkContext.broadcast(bit_table(ids, "id"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pa.array(has_slot(sent.value, batch.column("slot").to_numpy())))
            for part in pieces([batch], "text", PIECE_BYTES):
                h, rows = distinct_shingles(part.column("text"), size)
                yield pa.RecordBatch.from_pydict({"id": part.column("id"), "shingles": pa.ListArray.from_arrays(pa.array(rows, pa.int32()), pa.array(h.view(np.int64)))})

    kind = docs.schema[id_col].dataType.simpleString()
    return map_texts(docs.filter(F.col(id_col).isNotNull()), run, f"id {kind}, shingles array<long>", id=F.col(id_col), slot=slot(F.col(id_col)), text=F.col(text_col))


def _screened(pairs: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """Pairs (u, v) that sizes and bitmaps do not rule out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = [batch.column(c).to_numpy() for c in ("na", "nb")]
            keep = np.zeros(batch.num_rows, bool)
            for i, pair in enumerate(zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True)):
                x = folded(list(pair))
                keep[i] = may_link(n[0][i : i + 1], x[:1], n[1][i : i + 1], x[1:], percent)[0, 0]
            yield batch.filter(pa.array(keep)).select(["u", "v"])

    side = lambda c, x: reps.select(F.col("id").alias(c), F.col("n").alias(f"n{x}"), F.col("bitmap").alias(x))
    both = pairs.join(side("v", "b"), "v").join(side("u", "a"), "u")
    kind = pairs.schema["u"].dataType.simpleString()
    return map_texts(both, run, f"u {kind}, v {kind}", **{c: F.col(c) for c in ("u", "v", "a", "b", "na", "nb")})


def _verified(pairs: DataFrame, arrays: DataFrame, percent: int) -> DataFrame:
    """Pairs (u, v) whose sets reach the threshold, by intersection of sorted arrays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            (a, ra), (b, rb) = ((x.flatten().to_numpy().view(np.uint64), np.concatenate([[0], np.cumsum(x.value_lengths().to_numpy())])) for x in (batch.column("a"), batch.column("b")))
            keep = np.zeros(batch.num_rows, bool)
            for i in range(batch.num_rows):
                x, y = a[ra[i] : ra[i + 1]], b[rb[i] : rb[i + 1]]
                at = np.minimum(np.searchsorted(x, y), len(x) - 1)
                common = int((x[at] == y).sum())
                keep[i] = 100 * common >= percent * (len(x) + len(y) - common)
            yield batch.filter(pa.array(keep)).select(["u", "v"])

    both = pairs.join(arrays.select(F.col("id").alias("v"), F.col("shingles").alias("b")), "v").join(arrays.select(F.col("id").alias("u"), F.col("shingles").alias("a")), "u")
    kind = pairs.schema["u"].dataType.simpleString()
    return map_texts(both, run, f"u {kind}, v {kind}", u=F.col("u"), v=F.col("v"), a=F.col("a"), b=F.col("b")).distinct()


def _exact(pairs: DataFrame, docs: DataFrame, scratch: Scratch, id_col: str, text_col: str, size: int, percent: int) -> DataFrame:
    """Those pairs that reach the threshold; shingles are made anew for their documents alone."""
    ids = pairs.select(F.col("u").alias("id")).unionByName(pairs.select(F.col("v").alias("id"))).distinct()
    arrays = scratch.keep(_arrays(docs, ids, id_col, text_col, size).join(ids, "id"))
    links = scratch.keep(_verified(pairs, arrays, percent))
    scratch.drop(arrays)
    return links


def may_link(na: np.ndarray, a: np.ndarray, nb: np.ndarray, b: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """Matrix of pairs whose sizes and bitmaps do not rule out the threshold."""
    pa_, pb = (np.bitwise_count(x).sum(1, dtype=np.int64) for x in (a, b))
    out = np.zeros((len(na), len(nb)), bool)
    # a block of pairs' common bits takes about 16 MB
    rows = max(1, (2 << 20) // (a.shape[1] * max(1, len(nb))))
    for at in range(0, len(na), rows):
        s = slice(at, at + rows)
        common = np.bitwise_count(a[s, None, :] & b[None]).sum(-1, dtype=np.int64)
        most = np.minimum(na[s, None] - (pa_[s, None] - common), nb[None] - (pb[None] - common))
        out[s] = (100 + percent) * most >= percent * (na[s, None] + nb[None])
    return out


def _tile_pairs(rows: DataFrame, percent: int) -> DataFrame:
    """Candidate pairs from rows (bucket, id, comp, n and, if there, bitmap): each with its own and the next smaller size band."""
    # a little wider than the ratio of linked sizes, so that rounding never puts linked sizes two bands apart
    band = F.floor(F.log(F.col("n").cast("double")) / (math.log(100 / percent) * (1 + 1e-9))).cast("int")
    rows = rows.withColumn("band", band)
    own = rows.withColumn("own", F.lit(True))
    lower = rows.withColumn("band", F.col("band") + 1).withColumn("own", F.lit(False))
    placed = own.unionByName(lower)
    # a count of pairs of bucket and band, so that large ones are cut into tiles
    counts = placed.groupBy("bucket", "band").agg(F.count(F.lit(1)).alias("g"), F.max("own").alias("any_own")).filter("any_own AND g > 1").select("bucket", "band", F.ceil(F.col("g") / TILE).cast("int").alias("k"))
    tiled = placed.join(counts, ["bucket", "band"]).withColumn("s", F.pmod(F.xxhash64("id"), F.col("k")).cast("int"))
    other = tiled.select("*", F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("x"))
    mine = other.filter("own").select("*", F.lit(0).alias("kind"), F.least("s", "x").alias("i"), F.greatest("s", "x").alias("j"), (F.col("s") <= F.col("x")).alias("first"))
    across = other.select("*", F.lit(1).alias("kind"), F.when(F.col("own"), F.col("s")).otherwise(F.col("x")).alias("i"), F.when(F.col("own"), F.col("x")).otherwise(F.col("s")).alias("j"), F.col("own").alias("first"))
    cells = mine.unionByName(across).select("bucket", "band", "kind", "i", "j", "first", "id", "comp", "n", *(c for c in rows.columns if c in ("bitmap", "mine")))
    key = ["bucket", "band", "kind", "i", "j"]
    sorted_cells = cells.repartition(*key).sortWithinPartitions(*key)
    id_type = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            table = pa.Table.from_batches([batch] if rest is None else [*rest.to_batches(), batch]).combine_chunks()
            cell = np.stack([table.column(c).to_numpy() for c in key], 1)
            cut = np.flatnonzero((cell[1:] != cell[:-1]).any(1)) + 1
            for a, b in zip([0, *cut[:-1].tolist()], cut.tolist(), strict=False):
                yield from _cell(table.slice(a, b - a), percent)
            rest = table.slice(int(cut[-1]) if len(cut) else 0)
        if rest is not None:
            yield from _cell(rest, percent)

    return map_texts(sorted_cells, run, f"u {id_type}, v {id_type}", **{c: F.col(c) for c in cells.columns}).distinct()


def _cell(t: pa.Table, percent: int) -> Iterator[pa.RecordBatch]:
    """Candidate pairs of one tile pair: the first side with the second, or one tile with itself."""
    if t.num_rows < 2:
        return
    first = t.column("first").to_numpy()
    kind, i, j = (t.column(c)[0].as_py() for c in ("kind", "i", "j"))
    alone = kind == 0 and i == j
    a = np.flatnonzero(first) if not alone else np.arange(t.num_rows)
    b = np.flatnonzero(~first) if not alone else a
    if not len(a) or not len(b):
        return
    n, comp, ids = (t.column(c).to_numpy() for c in ("n", "comp", "id"))
    if "bitmap" in t.column_names:
        bits = folded(t.column("bitmap").to_pylist())
        found = may_link(n[a], bits[a], n[b], bits[b], percent)
    else:
        found = 100 * np.minimum(n[a][:, None], n[b][None]) >= percent * np.maximum(n[a][:, None], n[b][None])
    found &= comp[a][:, None] != comp[b][None]
    x, y = np.nonzero(found)
    x, y = a[x], b[y]
    keep = ids[x] > ids[y] if alone else ids[x] != ids[y]
    x, y = x[keep], y[keep]
    if "mine" in t.column_names:
        own, bucket = [set(m) for m in t.column("mine").to_pylist()], t.column("bucket")[0].as_py()
        first_common = [min(own[i] & own[j]) == bucket for i, j in zip(x.tolist(), y.tolist(), strict=True)]
        x, y = x[np.array(first_common, bool)], y[np.array(first_common, bool)]
    x, y = ids[x], ids[y]
    yield pa.RecordBatch.from_pydict({"u": pa.array(np.maximum(x, y)), "v": pa.array(np.minimum(x, y))})


def join_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, percent: int = PERCENT) -> DataFrame:
    """id, n_shingles, component_id of every document."""
    scratch = Scratch(docs.sparkSession, "ngrams")
    sketches = scratch.keep(_sketches(docs, id_col, text_col, size, percent))
    usable = sketches.filter("n > 0 AND id IS NOT NULL")
    classes = usable.groupBy("n", "s0", "s1").agg(F.min("id").alias("rep"))
    members = scratch.keep(usable.select("id", "n", "s0", "s1").join(classes, ["n", "s0", "s1"]).select("id", "n", "rep"))
    others = scratch.keep(sketches.filter("n = 0 OR id IS NULL").select("id", "n"))
    reps = usable.join(members.filter("id = rep").select("id").distinct(), "id", "left_semi")
    bitmaps = scratch.keep(reps.select("id", "n", "bitmap"))
    short = F.transform("prefix", lambda x: x.bitwiseAND(F.lit((1 << BUCKET_BITS) - 1)))
    tokens = reps.select("id", F.explode(F.array_distinct(short)).alias("bucket")).repartition("bucket")
    least = tokens.groupBy("bucket").agg(F.min("id").alias("c"), F.max("id").alias("most")).filter("c <> most").select("bucket", "c")
    buckets = scratch.keep(tokens.join(least, "bucket"))
    scratch.drop(sketches)
    least = buckets.groupBy("id").agg(F.min("c").alias("v")).filter("id <> v").select(F.col("id").alias("u"), "v")
    likely = scratch.keep(_screened(least, bitmaps, percent))
    links = _exact(likely, docs, scratch, id_col, text_col, size, percent)
    roots = connected_components(links, scratch).withColumnsRenamed({"node": "id", "root": "comp"})
    placed = buckets.join(roots, "id", "left").select("bucket", "id", F.coalesce("comp", "id").alias("comp"))
    # of buckets with the same members one is enough
    open_buckets = (
        placed.groupBy("bucket").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.count(F.lit(1)).alias("g"), F.bit_xor(F.xxhash64("id")).alias("m0"), F.bit_xor(F.xxhash64(F.lit(7), "id")).alias("m1"))
        .filter("low <> high").groupBy("low", "high", "g", "m0", "m1").agg(F.min("bucket").alias("bucket")).select("bucket", "g")
    )
    rows = scratch.keep(placed.join(open_buckets, "bucket").join(bitmaps.select("id", "n"), "id"))
    # bitmaps are as large as half a byte for each shingle, so they go with members of large buckets only; pairs of
    # small ones, often met in several buckets, are made distinct first
    small = scratch.keep(_tile_pairs(rows.filter(F.col("g") <= SMALL), percent))
    large = rows.filter(F.col("g") > SMALL)
    # a document's own large buckets, at most as many as its prefix has shingles: a pair is made in the first common one
    mine = large.groupBy("id").agg(F.sort_array(F.collect_set("bucket")).alias("mine"))
    large = _tile_pairs(large.join(mine, "id").join(bitmaps.select("id", "bitmap"), "id"), percent)
    pairs = scratch.keep(_screened(small, bitmaps, percent).unionByName(large).distinct())
    more = _exact(pairs, docs, scratch, id_col, text_col, size, percent)
    roots = connected_components(links.unionByName(more), scratch).withColumnRenamed("node", "rep")
    # the result reads members, others and roots alone
    scratch.drop(bitmaps, buckets, likely, links, rows, small, pairs, more)
    found = members.join(roots, "rep", "left").select("id", F.coalesce("root", "rep").alias("component")).groupBy("id").agg(F.min("component").alias("component"))
    out = members.select("id", "n").join(found, "id").unionByName(others.withColumn("component", F.col("id")))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, percent: int = PERCENT) -> DataFrame:
    """The documents, with all their columns, that have the smallest id of their component; null ids stay."""
    found = join_documents(docs, id_col, text_col, size, percent)
    # only ids that go are joined: a document that is not listed stays
    gone = found.filter(F.col(id_col) != F.col("component_id")).select(F.col(id_col)).distinct()
    return docs.join(gone, id_col, "left_anti").select(*docs.columns)
