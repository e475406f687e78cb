"""Affine subspaces of groups of vectors and their residuals."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from sluice.session import batched, groups, in_groups, ship_path


def leading_basis(x: np.ndarray, rank: int | None = None, energy: float | None = None, tol: float = 1e-6) -> np.ndarray:
    """Orthonormal columns of the leading directions of centred rows, limited by rank, energy and a relative cut."""
    _, s, vt = np.linalg.svd(x, full_matrices=False)
    keep = int((s > tol * s[0]).sum()) if len(s) and s[0] > 0 else 0
    if energy is not None and keep:
        keep = min(keep, int(np.searchsorted(np.cumsum(s**2) / (s**2).sum(), energy) + 1))
    return vt[: keep if rank is None else min(keep, rank)].T


def projector(x: np.ndarray, rank: int | None = None, energy: float | None = None) -> tuple[np.ndarray, np.ndarray, bool]:
    """(mean, basis, valid) of rows; valid if the basis has a direction."""
    mean = x.mean(0)
    basis = leading_basis(x - mean, rank, energy)
    return mean, basis, basis.shape[1] > 0


def residual_energy(x: np.ndarray, mean: np.ndarray, basis: np.ndarray, valid: bool) -> float:
    """Mean squared distance of rows from the affine subspace; from the mean if it has no direction."""
    d = x - mean
    if valid:
        d = d - (d @ basis) @ basis.T
    return float((d * d).sum(1).mean())


class Moments:
    """Count, mean and matrix of centred products of rows; two of them merge into that of all their rows."""

    def __init__(self, n: int, mean: np.ndarray, products: np.ndarray):
        self.n, self.mean, self.products = n, mean, products

    @classmethod
    def of(cls, x: np.ndarray) -> Moments:
        mean = x.mean(0)
        d = x - mean
        return cls(len(x), mean, d.T @ d)

    def merge(self, other: Moments) -> Moments:
        n, gap = self.n + other.n, other.mean - self.mean
        return Moments(n, self.mean + gap * (other.n / n), self.products + other.products + np.outer(gap, gap) * (self.n * other.n / n))

    def projector(self, rank: int | None = None, energy: float | None = None, tol: float = 1e-6) -> tuple[np.ndarray, float]:
        """(orthonormal directions as rows, mean squared distance of the rows from the subspace), as ``leading_basis`` has them."""
        values, vectors = np.linalg.eigh(self.products)
        s = np.sqrt(np.maximum(values[::-1], 0.0))
        keep = int((s > tol * s[0]).sum()) if len(s) and s[0] > 0 else 0
        if energy is not None and keep:
            keep = min(keep, int(np.searchsorted(np.cumsum(s**2) / (s**2).sum(), energy) + 1))
        keep = keep if rank is None else min(keep, rank)
        return vectors.T[::-1][:keep], float((s[keep:] ** 2).sum() / self.n)


#: Numbers in the moments that a task holds before it passes them on, and first merges of a group's moments.
HELD, SALTS = 4_000_000, 32


def _merged(rows: Iterable[tuple[int, list, list]]) -> Moments:
    total = None
    for n, mean, products in rows:
        mean = np.asarray(mean, float)
        one = Moments(int(n), mean, np.asarray(products, float).reshape(len(mean), len(mean)))
        total = one if total is None else total.merge(one)
    return total


def group_projectors(df: DataFrame, group: str, vector: str, rank: int | None, energy: float | None = None) -> DataFrame:
    """group, mu, rank, basis (its directions) and energy outside the leading subspace of each group.

    Tasks make the moments of their rows of each group, a group's moments are merged under a salt and then once more, and
    its directions are eigenvectors of the merged products. So a group of any size is never in one task; a task holds
    moments of HELD numbers, and a group's take the square of its vectors' length. Null vectors are left out.
    """
    kind = df.schema[group].dataType.simpleString()
    partial = "grp {}, salt int, n long, mean array<double>, products array<double>".format(kind)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[object, Moments] = {}
        context = TaskContext.get()
        salt = (context.partitionId() if context else 0) % SALTS

        def flush() -> pa.RecordBatch:
            rows = {"grp": list(held), "salt": [salt] * len(held), "n": [m.n for m in held.values()], "mean": [m.mean for m in held.values()], "products": [m.products.ravel() for m in held.values()]}
            out = pa.RecordBatch.from_pydict({k: pa.array(v, keys if k == "grp" else None) for k, v in rows.items()})
            held.clear()
            return out.set_column(1, "salt", out.column("salt").cast(pa.int32()))

        for batch in batches:
            keys = batch.column("grp").type
            coded = batch.column("grp").dictionary_encode("encode")
            order = np.argsort(coded.indices.to_numpy(), kind="stable")
            codes = coded.indices.to_numpy()[order]
            cuts = np.flatnonzero(np.diff(codes)) + 1
            names, vectors = coded.dictionary.to_pylist(), batch.column("v")
            for rows in np.split(order, cuts) if len(order) else ():
                own = vectors.take(pa.array(rows))
                x = np.asarray(own.flatten()).astype(float).reshape(len(rows), -1)
                name, one = names[coded.indices[int(rows[0])].as_py()], Moments.of(x)
                held[name] = held[name].merge(one) if name in held else one
            if held and len(held) * (next(iter(held.values())).products.size + 1) > HELD:
                yield flush()
        if held:
            yield flush()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each() -> Iterator[tuple]:
            for rows in groups(batches, 2):
                m = _merged(x[2:] for x in rows)
                yield rows[0][0], 0, m.n, m.mean, m.products.ravel()

        yield from batched(each(), partial_arrow)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each() -> Iterator[tuple]:
            for rows in groups(batches, 1):
                m = _merged(x[2:] for x in rows)
                basis, residual = m.projector(rank, energy)
                yield rows[0][0], m.mean, len(basis), basis.tolist(), residual

        yield from batched(each(), out_arrow)

    ship_path(df.sparkSession)
    moments = df.filter(F.col(vector).isNotNull()).select(F.col(group).alias("grp"), F.col(vector).alias("v")).mapInArrow(measure, partial)
    moments = in_groups(moments, ["grp", "salt"])
    partial_arrow = to_arrow_schema(moments.schema)
    out = T._parse_datatype_string(f"{group} {kind}, mu array<double>, rank int, basis array<array<double>>, residual double")
    out_arrow = to_arrow_schema(out)
    return in_groups(moments.mapInArrow(merge, partial), ["grp"]).mapInArrow(finish, out)
