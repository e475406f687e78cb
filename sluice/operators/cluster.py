"""Online leader clustering of step embeddings, one state for each sample."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluice.session import ship_path

MODES = ("all", "first", "centroid", "medoid")
SCHEMA = "sample_id long, ord long, text string, cluster long, correct boolean"


#: Products of unit vectors closer to a threshold than this are taken again from the members themselves.
SLACK = 1e-9
#: Steps whose products with all representatives are taken at once.
BLOCK = 256


class Rows:
    """Vectors in order of arrival, in an array that doubles when it is full."""

    def __init__(self, width: int):
        self.n, self._data = 0, np.empty((4, width))

    def append(self, x: np.ndarray | tuple[float, float]) -> None:
        if self.n == len(self._data):
            self._data = np.concatenate([self._data, np.empty_like(self._data)])
        self._data[self.n] = x
        self.n += 1

    def fill(self, x: np.ndarray) -> None:
        """Take other vectors instead."""
        self.n, self._data = len(x), x

    @property
    def all(self) -> np.ndarray:
        return self._data[: self.n]


class Cluster:
    """Members of a cluster in the order of arrival, with their sum and their parts along and across an axis.

    The axis is the direction of the mean at the time when the number of members last doubled, so taking all parts
    again costs time linear in the members. A member whose parts are a and b has m.x >= a x_a - b x_b, where x_a and x_b
    are the parts of x. The least a and greatest b settle most items for all members at once, the parts of each member
    settle most others, and products are taken with the rest. The mean product is mean.x, never below the least one.
    """

    def __init__(self, x: np.ndarray):
        self.members, self.right, self.total = Rows(len(x)), 0, np.zeros(len(x))
        self.axis, self.parts, self.along, self.across, self._next = np.zeros(len(x)), Rows(2), np.inf, 0.0, 1

    def _part(self, x: np.ndarray) -> tuple[float, float]:
        """Parts along and across the axis."""
        along = float(x @ self.axis)
        rest = x - along * self.axis
        return along, math.sqrt(rest @ rest)

    def add(self, x: np.ndarray, right: bool) -> None:
        self.members.append(x)
        self.total = self.total + x
        self.right += bool(right)
        if self.members.n == self._next:
            length = np.linalg.norm(self.total)
            self.axis, self._next = self.total / length if length else self.total, 2 * self.members.n
            along = self.members.all @ self.axis
            self.parts.fill(np.stack([along, np.linalg.norm(self.members.all - along[:, None] * self.axis, axis=1)], 1))
            self.along, self.across = float(self.parts.all[:, 0].min()), float(self.parts.all[:, 1].max())
        else:
            part = self._part(x)
            self.parts.append(part)
            self.along, self.across = min(self.along, part[0]), max(self.across, part[1])

    def mean_if_all_above(self, x: np.ndarray, threshold: float) -> float | None:
        """The mean product with the members if each is above the threshold."""
        mean = float(self.total @ x) / self.members.n
        if mean < threshold - SLACK:
            return None
        along, across = self._part(x)
        if along >= 0 and self.along * along - self.across * across > threshold + SLACK:
            return mean
        open_ = np.flatnonzero(self.parts.all @ np.array([along, -across]) <= threshold + SLACK)
        return mean if (self.members.all[open_] @ x > threshold).all() else None


class Leader:
    """State of one sample: items join the best cluster above the threshold, or start a new one."""

    def __init__(self, threshold: float, correct_threshold: float = 0.5, mode: str = "all"):
        if mode not in MODES:
            raise ValueError(f"no such mode: {mode}")
        self.threshold, self.correct_threshold, self.mode, self.clusters = threshold, correct_threshold, mode, []
        self.reps: Rows | None = None

    def _home(self, x: np.ndarray, sims: np.ndarray) -> int | None:
        if not self.clusters:
            return None
        if self.mode != "all":
            best = int(np.argmax(sims))
            return best if sims[best] > self.threshold else None
        means = {int(i): self.clusters[i].mean_if_all_above(x, self.threshold) for i in np.flatnonzero(sims > self.threshold)}
        means = {i: m for i, m in means.items() if m is not None and m > -1.0}
        # means of equal height but for rounding are taken from the members, and the first cluster wins
        close = [i for i, m in means.items() if m >= max(means.values()) - SLACK]
        if len(close) > 1:
            exact = [float((self.clusters[i].members.all @ x).mean()) for i in close]
            return close[int(np.argmax(exact))]
        return close[0] if close else None

    def _represent(self, at: int) -> None:
        """Renew the representative of a cluster that grew."""
        c = self.clusters[at]
        if c.members.n > 1 and self.mode in ("centroid", "medoid"):
            mean = c.total / c.members.n
            m = c.members.all
            self.reps.all[at] = mean / (np.linalg.norm(mean) + 1e-8) if self.mode == "centroid" else m[int(np.argmax(m @ mean))]

    def put_all(self, vectors: np.ndarray, right: list[bool]) -> list[tuple[int, bool]]:
        """(cluster, whether it counts as correct at that time) of each item.

        Products of a block of items with the representatives are one matrix product; those with representatives
        that the block itself makes or changes are taken item by item.
        """
        out = []
        self.reps = self.reps or Rows(vectors.shape[1])
        for start in range(0, len(vectors), BLOCK):
            block = vectors[start : start + BLOCK]
            known, changed = self.reps.n, set()
            products = block @ self.reps.all.T
            for k, x in enumerate(block):
                sims = np.concatenate([products[k], self.reps.all[known:] @ x]) if self.reps.n > known else products[k]
                if changed:
                    renewed = list(changed)
                    sims[renewed] = self.reps.all[renewed] @ x
                at = self._home(x, sims)
                new = at is None
                if new:
                    at = len(self.clusters)
                    self.clusters.append(Cluster(x))
                    self.reps.append(x)
                c = self.clusters[at]
                c.add(x, right[start + k])
                self._represent(at)
                if at < known and self.mode in ("centroid", "medoid"):
                    changed.add(at)
                out.append((at, bool(right[start + k]) if new else c.right / c.members.n > self.correct_threshold))
        return out


def cluster_steps(steps: DataFrame, threshold: float, correct_threshold: float = 0.5, mode: str = "all") -> DataFrame:
    """Cluster and correctness of each step, in the order of ``ord`` in its sample.

    ``steps`` has sample_id, ord, text, embedding (unit length), lead_correct. A sample is the unit of state, as
    the result depends on the order inside it; samples spread over tasks. In the mode "all" bounds from parts along
    and across a cluster's axis settle most steps without a look at its members.
    """
    Leader(threshold, correct_threshold, mode)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ord")
        state = Leader(threshold, correct_threshold, mode)
        put = state.put_all(np.stack([np.asarray(x, float) for x in pdf["embedding"]]), [bool(r) for r in pdf["lead_correct"]])
        return pd.DataFrame({"sample_id": pdf["sample_id"], "ord": pdf["ord"], "text": pdf["text"], "cluster": [c for c, _ in put], "correct": [k for _, k in put]})

    return steps.groupBy("sample_id").applyInPandas(run, SCHEMA)


def look_up_correctness(queries: DataFrame, clusters: DataFrame) -> DataFrame:
    """``correct`` for (sample_id, text) by the lowest cluster that has the text; an unknown one is an error.

    ``clusters`` has sample_id, text, cluster, correct.
    """
    first = Window.partitionBy("sample_id", "text").orderBy("cluster")
    best = clusters.withColumn("_r", F.row_number().over(first)).filter("_r = 1").select("sample_id", "text", "correct")
    found = queries.join(best, ["sample_id", "text"], "left")
    return found.withColumn("correct", F.when(F.col("correct").isNull(), F.raise_error(F.lit("text is in no cluster"))).otherwise(F.col("correct")))


#: Vectors of a tile of ``similar_pairs``, about.
TILE = 1024


def tile_pairs(vectors: DataFrame, key: str, id_col: str, vector: str) -> DataFrame:
    """(g, d, same, x, y): two tiles of the vectors with key g and d components, the same one for the pairs inside a tile.

    A tile is a list of (id, v) of about TILE rows, dealt by hash, so a key of any size is many rows of bounded size and
    a vector is sent once for each tile of its key. Vectors with nulls, and null keys or ids, are left out.
    """
    kind = vectors.schema[vector].dataType.elementType
    value = F.col(vector) if isinstance(kind, T.FloatType) else F.col(vector).cast("array<double>")
    rows = vectors.filter(F.col(key).isNotNull() & F.col(id_col).isNotNull()).select(F.col(key).alias("g"), F.col(id_col).alias("id"), value.alias("v"))
    rows = rows.filter(F.col("v").isNotNull() & ~F.exists("v", lambda x: x.isNull())).withColumn("d", F.size("v"))
    tiles = rows.groupBy("g", "d").agg(F.ceil(F.count(F.lit(1)) / TILE).cast("int").alias("k"))
    dealt = rows.join(tiles, ["g", "d"]).withColumn("s", F.pmod(F.xxhash64("id", "v"), F.col("k")).cast("int"))
    tile = dealt.groupBy("g", "d", "k", "s").agg(F.collect_list(F.struct("id", "v")).alias("t"))
    # a fixed number of partitions, as adaptive execution goes by bytes and would give few tasks all products
    n, cell = 4 * vectors.sparkSession.sparkContext.defaultParallelism, ["g", "d", "i", "j"]
    x = tile.select("g", "d", F.col("s").alias("i"), F.explode(F.sequence("s", F.col("k") - 1)).alias("j"), F.col("t").alias("x")).repartition(n, *cell)
    y = tile.select("g", "d", F.explode(F.sequence(F.lit(0), "s")).alias("i"), F.col("s").alias("j"), F.col("t").alias("y")).repartition(n, *cell)
    return x.join(y, cell).select("g", "d", (F.col("i") == F.col("j")).alias("same"), "x", "y")


def _above(x: np.ndarray, y: np.ndarray, same: bool, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places and product of the pairs above the threshold (not-a-number is), of a tile with itself each once.

    Products of matrices choose; those near or above the threshold are summed again from the first component on.
    """
    with np.errstate(all="ignore"):
        most = np.sqrt((x * x).sum(1))[:, None] * np.sqrt((y * y).sum(1))
        keep = ~(x @ y.T < threshold - SLACK * np.maximum(1.0, most))
        i, j = np.nonzero(np.triu(keep, 1) if same else keep)
        sim = np.zeros(len(i))
        for c in range(x.shape[1]):
            sim += x[i, c] * y[j, c]
    found = (sim > threshold) | np.isnan(sim)
    return i[found], j[found], sim[found]


def similar_pairs(vectors: DataFrame, key: str, id_col: str, vector: str, dot: Column | None, threshold: float) -> DataFrame:
    """Pairs (key, a, b, sim) of a key's vectors with a product above the threshold, a < b.

    Products are those of tiles, so neither rows nor memory grow with a key's pairs, but the products do. Vectors of
    different lengths or with nulls, and null keys or ids, are in no pair.
    """
    of, id_type = vectors.schema[key].dataType, vectors.schema[id_col].dataType
    schema = T.StructType([T.StructField("g", of), T.StructField("p", id_type), T.StructField("q", id_type), T.StructField("sim", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                row = batch.slice(r, 1)
                d, same = row.column("d")[0].as_py(), row.column("same")[0].as_py()
                ids, each = zip(*(row.column(c).flatten().flatten() for c in ("x", "y")), strict=True)
                x, y = (v.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(v), d) for v in each)
                # a tile is made for either side, and shuffles may bring its rows in another order for each
                ids, y = ((ids[0], ids[0]), x) if same else (ids, y)
                # a tile may be larger than most, so its products are taken in parts
                for at in range(0, len(x), TILE):
                    rest = y[at:] if same else y
                    i, j, sim = _above(x[at : at + TILE], rest, same, threshold)
                    if len(i):
                        left, right = ids[0].take(pa.array(i + at)), ids[1].take(pa.array(j + at if same else j))
                        yield pa.RecordBatch.from_arrays([row.column("g").take(pa.array(np.zeros(len(i), int))), left, right, pa.array(sim)], names=schema.names)

    ship_path(vectors.sparkSession)
    found = tile_pairs(vectors, key, id_col, vector).mapInArrow(run, schema)
    return found.filter("p <> q").select(F.col("g").alias(key), F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b"), "sim")
