"""Vectors as codes of a product codebook, learned in integers (operator 13).

Components become floor(4096 x). A vector is cut into equal parts; the codebook of a part position starts as that part of
the smallest ids, and each round assigns parts to the nearest entry (squared Euclidean distance, ties to the lower index)
and replaces an entry by the floor of the mean of its parts. Everything is in integers, so the result does not depend on
the order in which sums are made.

The nearest entry is found from coarse to fine. A part is cut into one block, then two, then four and so on. With block
sums S, block size b and residuals r (what is left when each component has its block's mean taken away),

    |x - c|^2 >= sum over blocks of (S_x - S_c)^2 / b + (|r_x| - |r_c|)^2

At each level the entry with the least bound gets its exact distance, and entries whose bound exceeds the least distance
so far are out; the survivors' exact integer distances decide. Block sums and b |r|^2 are exact integers; what is rounded
after them is paid for by a margin far above the error of doubles, so no entry is lost.

A round is a pass over the vectors: tasks add up their parts by entry, Spark adds up the tasks, and the sums of one
codebook (parts x entries x components, whatever the number of vectors) reach the driver. A lost task is repeated with
the same codebooks. Sums over equal labels are made before the shuffle and joined back under a salt.

Defined results: rows whose vector is null or holds null or non-finite components are dropped. Repeated rows each have a
code and count as often as they occur; the codebooks start from distinct ids, of an id's vectors from the smallest one;
a null id comes after all others. With fewer distinct ids than entries there are fewer entries. Labels that are null are
equal. An empty table gives no rows, and the codebooks of no component. Other columns are not read.
Vectors of different lengths, of a length that the parts do not divide, or with components beyond 2^30 / (4096 x the
part's length) in size are errors, since their distances would not be exact.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.llm.base import Scratch, bounded_batches

SCALE, PARTS, ENTRIES, ROUNDS = 4096, 8, 16, 6
#: Copies of each label's sum, so that rows of one label meet them in as many places.
SALTS = 32
#: Parts that are compared at a time.
TILE = 1 << 14
#: Above the relative error of a few operations in doubles by a factor of a thousand.
_MARGIN = 1e-12

Codebooks = np.ndarray  # parts x entries x components, int64


def usable(vector: Column) -> Column:
    """Whether a vector is there and all its components are finite numbers."""
    return F.coalesce(F.forall(vector, lambda x: x.isNotNull() & (F.abs(x) < float("inf"))), F.lit(False))


def _blocks(x: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(block sums, norm of the residual) of each row, for blocks of ``size`` components; the last may be shorter, and is then widened by zeros."""
    n, m = x.shape
    if m % size:
        x = np.concatenate([x, np.zeros((n, size - m % size), x.dtype)], axis=1)
    cut = x.reshape(n, -1, size)
    sums = cut.sum(axis=2)
    spread = size * (cut * cut).sum(axis=(1, 2)) - (sums * sums).sum(axis=1)
    return sums, np.sqrt(spread.astype(np.float64) / size)


class Nearest:
    """Finds the nearest of some entries, by bounds from coarse to fine."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        m = entries.shape[1]
        # each level halves the blocks; the last one has blocks of two
        sizes = [m]
        while sizes[-1] > 2:
            sizes.append((sizes[-1] + 1) // 2)
        self.levels = [(size, *_blocks(entries, size)) for size in sizes]
        #: Pairs of a part and an entry: all of them, and those with an exact distance.
        self.pairs = self.exact = 0

    @staticmethod
    def _bound(size: int, sums: np.ndarray, norm: np.ndarray, other_sums: np.ndarray, other_norm: np.ndarray) -> np.ndarray:
        gap = np.maximum(np.abs(norm - other_norm) - _MARGIN * (norm + other_norm), 0.0)
        off = (sums - other_sums).astype(np.float64)
        return ((off * off).sum(axis=-1) / size + gap * gap) * (1 - _MARGIN)

    def __call__(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index of the nearest entry, squared distance) of each row."""
        n, every = len(x), len(self.entries)
        row, entry = np.repeat(np.arange(n), every), np.tile(np.arange(every), n)
        most = np.full(n, np.iinfo(np.int64).max)
        for k, (size, sums, norm) in enumerate(self.levels):
            own_sums, own_norm = _blocks(x, size)
            if k:
                bound = self._bound(size, own_sums[row], own_norm[row], sums[entry], norm[entry])
            else:
                bound = self._bound(size, own_sums[:, None, :], own_norm[:, None], sums[None], norm[None]).ravel()
            # pairs stay in the order of rows and entries, and the nearest entry is never out, so each row has one
            starts = np.searchsorted(row, np.arange(n))
            least = np.minimum.reduceat(bound, starts) if n else bound
            guess = np.flatnonzero(bound == least[row])
            guess = guess[np.unique(row[guess], return_index=True)[1]]
            off = x - self.entries[entry[guess]]
            most = np.minimum(most, (off * off).sum(axis=1))
            keep = bound <= most[row]
            row, entry = row[keep], entry[keep]
        off = x[row] - self.entries[entry]
        exact = (off * off).sum(axis=1)
        self.pairs += n * every
        self.exact += len(exact)
        starts = np.searchsorted(row, np.arange(n))
        least = np.minimum.reduceat(exact, starts) if n else exact
        first = np.flatnonzero(exact == least[row])
        _, at = np.unique(row[first], return_index=True)
        return entry[first[at]], least


def quantise(vectors: pa.Array, parts: int, scale: int, dimension: int | None) -> np.ndarray:
    """Integers of a list column without nulls: rows x parts x components."""
    sizes = np.diff(np.asarray(vectors.offsets))
    m = dimension if dimension is not None else int(sizes[0]) if len(sizes) else parts
    if (sizes != m).any() or m == 0 or m % parts:
        raise ValueError(f"vectors must all have the same number of components, a multiple of {parts}; found {sorted(set(sizes.tolist()) | {m})[:5]}")
    values = np.asarray(vectors.values)[vectors.offsets[0].as_py() : vectors.offsets[-1].as_py()]
    x = np.floor(values.astype(np.float64) * scale)
    if len(x) and np.abs(x).max() * (m // parts) >= 2.0**30:
        raise ValueError("components are too large for exact distances in 64 bits")
    return x.astype(np.int64).reshape(len(sizes), parts, m // parts)


def _tiles(batches: Iterator[pa.RecordBatch], books: Codebooks, scale: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, their integers, codes, distances by part)."""
    parts, _, m = books.shape
    nearest = [Nearest(b) for b in books]
    for batch in batches:
        step = max(1, TILE // parts)
        for at in range(0, batch.num_rows, step):
            rows = batch.slice(at, step)
            x = quantise(rows.column("v"), parts, scale, parts * m)
            found = [f(x[:, p]) for p, f in enumerate(nearest)]
            yield rows, x, np.stack([c for c, _ in found], axis=1), np.stack([d for _, d in found], axis=1)


def starting_codebooks(kept: DataFrame, parts: int = PARTS, entries: int = ENTRIES, scale: int = SCALE) -> Codebooks:
    """The parts of the vectors of the smallest distinct ids; ``kept`` has columns id and v."""

    def smallest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least = None
        for batch in batches:
            ids = pc.unique(batch.column("id") if least is None else pa.concat_arrays([least, batch.column("id")]))
            least = ids.take(pc.array_sort_indices(ids, null_placement="at_end")[:entries])
        if least is not None:
            yield pa.RecordBatch.from_arrays([least], ["id"])

    kind = kept.schema["id"].dataType.simpleString()
    ids = kept.select("id").mapInArrow(smallest, f"id {kind}").distinct().orderBy(F.col("id").asc_nulls_last()).limit(entries)
    first = kept.join(F.broadcast(ids.withColumnRenamed("id", "first")), F.col("id").eqNullSafe(F.col("first")))
    rows = first.groupBy("id").agg(F.min("v").alias("v")).orderBy(F.col("id").asc_nulls_last()).collect()
    if not rows:
        return np.zeros((parts, 0, 0), np.int64)
    x = quantise(pa.array([r.v for r in rows], pa.list_(pa.float64())), parts, scale, None)
    return np.ascontiguousarray(x.transpose(1, 0, 2))


def improved(kept: DataFrame, books: Codebooks, scale: int = SCALE) -> Codebooks:
    """One round: every entry becomes the floor of the mean of its parts; entries without parts stay."""
    parts, entries, m = books.shape
    sent = kept.sparkSession.sparkContext.broadcast(books)

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros((parts, entries, m), np.int64), np.zeros((parts, entries), np.int64)
        for _, x, codes, _ in _tiles(batches, sent.value, scale):
            for p in range(parts):
                np.add.at(total[p], codes[:, p], x[:, p])
                count[p] += np.bincount(codes[:, p], minlength=entries)
        cell = np.flatnonzero(count.ravel())
        place = np.concatenate([cell[:, None] * (m + 1) + k for k in range(m + 1)], axis=1).ravel()
        values = np.concatenate([total.reshape(-1, m), count.reshape(-1, 1)], axis=1)[cell].ravel()
        yield pa.RecordBatch.from_pydict({"place": pa.array(place, pa.int64()), "s": pa.array(values, pa.int64())})

    rows = kept.select("v").mapInArrow(add_up, "place long, s long").groupBy("place").agg(F.sum("s").alias("s")).toArrow()
    sums = np.zeros(parts * entries * (m + 1), np.int64)
    sums[rows.column("place").to_numpy()] = rows.column("s").to_numpy()
    sums = sums.reshape(parts, entries, m + 1)
    count = sums[:, :, m:]
    return np.where(count > 0, sums[:, :, :m] // np.maximum(count, 1), books)


def codebooks_digest(books: Codebooks) -> str:
    """SHA-256 of all components in decimal by part, entry and place, with commas between."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def compress(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str | None = "label",
    parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE,
) -> tuple[DataFrame, Codebooks]:
    """(id, code, error and, with labels, label_error of each kept row; the final codebooks)."""
    spark = vectors.sparkSession
    bounded_batches(spark)
    scratch = Scratch(spark, "codes")
    label = {"label": F.col(label_col)} if label_col else {}
    kept = vectors.filter(usable(F.col(vector_col))).select(F.col(id_col).alias("id"), F.col(vector_col).alias("v"), *(c.alias(k) for k, c in label.items()))
    books = starting_codebooks(kept, parts, entries, scale)
    for _ in range(rounds if books.shape[1] else 0):
        books = improved(kept, books, scale)
    sent = spark.sparkContext.broadcast(books)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digits = [f"{k:02x}" for k in range(max(256, entries))]
        for rows, _, codes, distances in _tiles(batches, sent.value, scale) if sent.value.shape[1] else ():
            columns = {k: rows.column(k) for k in rows.schema.names if k != "v"}
            text = ["".join(map(digits.__getitem__, c)) for c in codes.tolist()]
            yield pa.RecordBatch.from_pydict(columns | {"code": pa.array(text, pa.string()), "error": pa.array(distances.sum(axis=1), pa.int64())})

    kinds = {f.name: f.dataType.simpleString() for f in kept.schema if f.name != "v"}
    coded = kept.select(*kinds, "v").mapInArrow(assign, ", ".join(f"{k} {t}" for k, t in kinds.items()) + ", code string, error long")
    if not label:
        return coded.withColumnRenamed("id", id_col), books
    coded = scratch.keep(coded)
    sums = coded.groupBy("label").agg(F.sum("error").alias("label_error"))
    sums = sums.select(F.col("label").alias("of"), "label_error", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("copy"))
    salted = coded.withColumn("salt", F.pmod(F.xxhash64("id", "code"), F.lit(SALTS)).cast("int"))
    out = salted.join(sums, F.col("label").eqNullSafe(F.col("of")) & (F.col("salt") == F.col("copy"))).select(F.col("id").alias(id_col), "code", "error", "label_error")
    return out, books
