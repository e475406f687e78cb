"""Embedding near-duplicates by int8 tile products with error bounds (operator 3).

Two vectors link when their cosine in double precision is at least ``threshold``.

1. Equal vectors become one with a weight. Null vectors, those with a null or non-finite component and zero
   vectors link with nothing; so do vectors of different lengths.
2. Vectors go to the nearest of some centres, at most CELLS and more for larger tables, which a bounded sample
   gives. Two cells whose centres are farther apart than both radii and the threshold's angle allow cannot hold
   a link, by the triangle inequality of angles. Neighbouring small cells are taken together and large ones cut,
   so that a tile has as many vectors as fit into TILE_BYTES; groups of cells of which no two can link are not
   compared. A vector is sent once for each tile that its own is compared with, which large tiles keep few.
3. In each pair of tiles, unit vectors are quantised to int8 with one scale each, and the integer products are
   exact: they are summed in single precision over at most DIMS components, whose sums stay below 2 ** 24, and
   then in double. With ``e = |x - s q|`` for each vector, the product of unit vectors x, y differs from that of
   their quantised forms by at most ``e_x |s_y q_y| + e_y``; only pairs that this leaves possibly at or above
   the threshold are recomputed in double precision, always with the same sum where they are close to it.
4. A task returns counts of links and, for components, one edge for each vector that is linked in a pair of
   tiles, never all pairs.

The number of products stays quadratic in the vectors of cells that lie near each other, as the method has it.

Defined results: a vector without links has itself as component; a null id has no links and a null component;
repeated rows are separate vectors that link.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.llm.base import Scratch, bounded_batches
from sluice.llm.components import connected_components

THRESHOLD = 0.9
#: Most centres, bounds of the sample that gives them (rows and bytes), rounds of its clustering.
CELLS, SAMPLE_ROWS, SAMPLE_BYTES, ROUNDS = 256, 16384, 32 << 20, 6
#: Bytes of the vectors of a tile, fewest vectors, tiles that a small table is cut into so that several tasks share it.
TILE_BYTES, LEAST_TILE, TILES = 16 << 20, 1024, 8
BLOCK, DIMS = 1024, 1024
#: Allowance for rounding in the bounds, far above that of doubles and far below that of int8.
SLACK = 1e-6
#: Cosines of which different orders of summation may fall on different sides of the threshold are nearer to it than this.
CLOSE = 1e-9


def quantise(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """int8 values as float32, scale, exact error norm and norm of the quantised vector, for each row."""
    scale = np.abs(unit).max(1) / 127
    q = np.rint(unit / scale[:, None])
    near = q * scale[:, None]
    return q.astype(np.float32), scale, np.linalg.norm(unit - near, axis=1) + 1e-12, np.linalg.norm(near, axis=1)


def integer_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact products of rows of int8 values given as float32."""
    if a.shape[1] <= DIMS:
        return a @ b.T
    out = np.zeros((len(a), len(b)))
    for k in range(0, a.shape[1], DIMS):
        out += a[:, k : k + DIMS] @ b[:, k : k + DIMS].T
    return out


def join(label: np.ndarray, u: np.ndarray, v: np.ndarray) -> None:
    """Make ``label`` (the least member of each member's component) hold for further edges between members."""
    while True:
        x, y = label[u], label[v]
        apart = x != y
        if not apart.any():
            return
        u, v, x, y = u[apart], v[apart], x[apart], y[apart]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while (label[label] != label).any():
            label[:] = label[label]


def centres(sample: np.ndarray, cells: int) -> np.ndarray:
    """Unit centres of a sample of unit vectors by a few rounds of spherical k-means; the first ones are spread out."""
    chosen = [0]
    best = sample @ sample[0]
    while len(chosen) < min(cells, len(sample)):
        far = int(np.argmin(best))
        if best[far] > 1 - 1e-9:
            break
        chosen.append(far)
        best = np.maximum(best, sample @ sample[far])
    c = sample[chosen]
    for _ in range(ROUNDS):
        cell = np.argmax(sample @ c.T, axis=1)
        sums = np.zeros_like(c)
        np.add.at(sums, cell, sample)
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        c = np.where(size > 1e-9, sums / np.maximum(size, 1e-9), c)
    return c


def _matrix(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy().astype(np.float64).reshape(-1, dim)


def _scaled(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Vectors times a power of two each, by which very small and very large ones keep their direction, and their squared lengths."""
    x = np.ldexp(x, -np.frexp(np.abs(x).max(1))[1][:, None])
    return x, np.einsum("ij,ij->i", x, x)


def _unit(x: np.ndarray) -> np.ndarray:
    x, square = _scaled(x)
    return x / np.sqrt(square)[:, None]


def _linked(a: np.ndarray, aa: np.ndarray, b: np.ndarray, bb: np.ndarray, threshold: float) -> np.ndarray:
    """Whether rows and rows have a cosine of at least the threshold: product by root of the squared lengths' product."""
    return np.einsum("ij,ij->i", a, b) / np.sqrt(aa * bb) >= threshold


def tile_links(ids_a: np.ndarray, a: np.ndarray, weight_a: np.ndarray, ids_b: np.ndarray, b: np.ndarray, weight_b: np.ndarray, same: bool, threshold: float) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Rows (u, v, links) of a pair of tiles of vectors: sums of linked weights (v null) and edges."""
    (xa, aa), (xb, bb) = _scaled(a), _scaled(b)
    a, b = xa / np.sqrt(aa)[:, None], xb / np.sqrt(bb)[:, None]
    qa, sa, ea, _ = quantise(a)
    qb, sb, eb, nb = quantise(b)
    links_a, links_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
    nodes = ids_a if same else np.concatenate([ids_a, ids_b])
    # members in the order of their ids, so that the least label is the least id
    order = np.argsort(nodes, kind="stable")
    place = np.empty(len(nodes), np.int64)
    place[order] = np.arange(len(nodes))
    label, at_b = np.arange(len(nodes)), 0 if same else len(a)
    for i in range(0, len(a), BLOCK):
        r = slice(i, i + BLOCK)
        for j in range(i if same else 0, len(b), BLOCK):
            c = slice(j, j + BLOCK)
            products = integer_products(qa[r], qb[c])
            # no pair below this can reach the threshold, whatever its scales and errors are in this block
            least = (threshold - SLACK - ea[r].max() * nb[c].max() - eb[c].max()) / (sa[r].max() * sb[c].max())
            x, y = np.nonzero(products >= least - 1) if least > 0 else np.indices(products.shape).reshape(2, -1)
            upper = products[x, y] * (sa[r][x] * sb[c][y]) + ea[r][x] * nb[c][y] + eb[c][y]
            may = upper >= threshold - SLACK
            if same and i == j:
                may &= x < y
            x, y = x[may], y[may]
            if not len(x):
                continue
            if len(x) * 8 > products.size:
                cosine = (a[r] @ b[c].T)[x, y]
                linked = cosine >= threshold
                close = np.flatnonzero(np.abs(cosine - threshold) < CLOSE)
            else:
                linked, close = np.zeros(len(x), bool), np.arange(len(x))
            for k in range(0, len(close), 8192):
                at = close[k : k + 8192]
                u, v = x[at] + i, y[at] + j
                linked[at] = _linked(xa[u], aa[u], xb[v], bb[v], threshold)
            x, y = x[linked] + i, y[linked] + j
            links_a += np.bincount(x, weight_b[y], len(a)).astype(np.int64)
            links_b += np.bincount(y, weight_a[x], len(b)).astype(np.int64)
            join(label, place[x], place[y + at_b])
    n = [np.concatenate([ids_a, ids_b]), np.concatenate([links_a, links_b])]
    some = n[1] > 0
    other = np.flatnonzero(label != np.arange(len(label)))
    edges = nodes[order[other]], nodes[order[label[other]]]
    u = np.concatenate([n[0][some], edges[0]])
    v = pa.array(np.concatenate([np.zeros(int(some.sum()), np.int64), edges[1]]), pa.int64(), mask=np.arange(len(u)) < some.sum())
    return u, v, np.concatenate([n[1][some], np.zeros(len(other), np.int64)])


def link_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = THRESHOLD) -> DataFrame:
    """id, n_links (other vectors linked directly), component_id of every vector. Ids are integers."""
    spark = vectors.sparkSession
    bounded_batches(spark)
    scratch = Scratch(spark, "vectors")
    x = F.col("x")
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))) & F.exists(x, lambda c: c != 0)
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("x"))
    keyed = rows.withColumn("key", F.when(x.isNotNull() & F.col("id").isNotNull() & finite, F.struct(F.xxhash64("x").alias("a"), F.xxhash64(F.lit(1), "x").alias("b"))))
    classes = keyed.filter("key IS NOT NULL").groupBy("key").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("weight"), F.first("x").alias("x"))
    distinct = scratch.keep(classes.select("key", "rep", "weight", "x", F.size("x").alias("dim")))
    sizes = distinct.groupBy("dim").agg(F.count(F.lit(1)).alias("n")).collect()
    parts = [_links_of(distinct.filter(F.col("dim") == r.dim), r.dim, r.n, threshold) for r in sizes]
    found = parts[0] if parts else spark.createDataFrame([], "u long, v long, links long")
    for p in parts[1:]:
        found = found.unionByName(p)
    found = scratch.keep(found)
    roots = connected_components(found.filter("v IS NOT NULL"), scratch).withColumnRenamed("node", "rep")
    direct = found.filter("v IS NULL").groupBy(F.col("u").alias("rep")).agg(F.sum("links").alias("links"))
    per_class = distinct.select("key", "rep", "weight").join(direct, "rep", "left").join(roots, "rep", "left").select("key", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("root", "rep").alias("component"))
    out = keyed.select("id", "key").join(per_class, "key", "left")
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "id").alias("component_id"))


def grouped(centre: np.ndarray, sizes: dict[int, int], tile: int) -> dict[int, int]:
    """The group of each cell: neighbouring cells that fit into one tile together; a larger cell is one alone."""
    left, out, group, held = set(sizes), {}, -1, tile
    now = min(left, default=None)
    while left:
        if held + sizes[now] > tile:
            group, held = group + 1, 0
        out[now], held = group, held + sizes[now]
        left.remove(now)
        near = np.argsort(-(centre @ centre[now]))
        now = next((int(c) for c in near if int(c) in left), None)
    return out


def _links_of(distinct: DataFrame, dim: int, n: int, threshold: float) -> DataFrame:
    """(u, v, links) rows of the ``n`` distinct vectors of one length."""
    spark = distinct.sparkSession
    tile = min(max(LEAST_TILE, n // TILES), max(1, TILE_BYTES // (8 * dim)))
    sample = distinct.select("x").orderBy(F.col("key.a"), F.col("key.b")).limit(min(SAMPLE_ROWS, max(1, SAMPLE_BYTES // (8 * dim)))).toArrow()
    centre = centres(_unit(_matrix(sample.column("x"), dim)), min(CELLS, max(8, math.isqrt(n // 16))))
    sent = spark.sparkContext.broadcast(centre)

    def place(batches):
        for batch in batches:
            if batch.num_rows:
                near = _unit(_matrix(batch.column("x"), dim)) @ sent.value.T
                cell = np.argmax(near, axis=1)
                angle = np.arccos(np.clip(near[np.arange(len(cell)), cell], -1, 1))
                yield pa.RecordBatch.from_pydict({"rep": batch.column("rep"), "weight": batch.column("weight"), "x": batch.column("x"), "cell": pa.array(cell, pa.int32()), "angle": pa.array(angle)})

    placed = distinct.select("rep", "weight", "x").mapInArrow(place, "rep long, weight long, x array<double>, cell int, angle double")
    # one row for each of at most CELLS cells
    cells = {r.cell: (r.n, r.radius) for r in placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("angle").alias("radius")).collect()}
    reach = np.arccos(threshold) + 1e-6
    near = {(c, d) for c in cells for d in cells if np.arccos(np.clip(centre[c] @ centre[d], -1, 1)) <= cells[c][1] + cells[d][1] + reach}
    group = grouped(centre, {c: m for c, (m, _) in cells.items()}, tile)
    size: dict[int, int] = {}
    for c, g in group.items():
        size[g] = size.get(g, 0) + cells[c][0]
    tiles = {g: -(-m // tile) for g, m in size.items()}
    met = {(group[c], group[d]) for c, d in near}
    # at most CELLS rows for the one and CELLS ** 2 for the other
    groups = spark.createDataFrame(sorted(group.items()), "cell int, own int")
    partners = spark.createDataFrame(sorted((g, tiles[g], h, tiles[h]) for g, h in met), "own int, own_tiles long, other int, other_tiles long")
    tiled = placed.join(F.broadcast(groups), "cell").join(F.broadcast(partners), "own").withColumn("tile", F.pmod(F.xxhash64("rep"), F.col("own_tiles")))
    each = tiled.select("rep", "weight", "x", "own", "tile", "other", F.explode(F.sequence(F.lit(0), F.col("other_tiles") - 1)).alias("other_tile"))
    mine, other = F.struct(F.col("own").alias("c"), F.col("tile").alias("t")), F.struct(F.col("other").alias("c"), F.col("other_tile").alias("t"))
    pairs = each.select("rep", "weight", "x", F.least(mine, other).alias("p"), F.greatest(mine, other).alias("q"), (mine <= other).alias("first"))

    def compare(table: pa.Table) -> pa.Table:
        first = table.column("first").to_numpy()
        ids, weight, x = table.column("rep").to_numpy(), table.column("weight").to_numpy(), _matrix(table.column("x"), dim)
        same = bool(first.all()) and table.column("p")[0].as_py() == table.column("q")[0].as_py()
        b = first if same else ~first
        u, v, links = tile_links(ids[first], x[first], weight[first], ids[b], x[b], weight[b], same, threshold) if first.any() and b.any() else (ids[:0], ids[:0], ids[:0])
        return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64()), "links": pa.array(links, pa.int64())})

    return pairs.groupBy("p", "q").applyInArrow(compare, "u long, v long, links long")
