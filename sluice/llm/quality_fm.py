"""Quality classifier: a factorisation machine over hashed words, structure and size of a text (operator 6).

A text's features: its distinct words hashed to WORD_DIMS places, each with the same share of a unit vector,
and bins of STATS, one place for each. The score is the logistic of
``w0 + sum_i w_i x_i + 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2)``, in time linear in the features.

Learning: labelled rows whose crc32(id as text) mod 5 is not 0, of which SAMPLE_ROWS with the smallest hashed
ids, and of these the first ones whose features number at most SAMPLE_VALUES; features are made on the executors
and only these rows reach the driver, where the weights are fitted by minibatch descent in the order of the
hashed ids, so that a model does not depend on how the table is laid out. Labels, language, source and id are
no inputs of a score.

Defined results: a null text scores as an empty one; rows without a label or with a null id do not train;
with no training rows, or one class only, the weights hold just the base rate.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.llm.base import Scratch, crc_mod5, map_texts, pieces
from sluice.llm.kernels import spaced_table, words

WORD_BITS = 16
WORD_DIMS = 1 << WORD_BITS
#: Bounds of the training sample: rows, and features of all its rows (12 bytes each on the driver).
SAMPLE_ROWS, SAMPLE_VALUES = 8000, 16_000_000
FACTORS, EPOCHS, BATCH, RATE, DECAY, SEED = 4, 6, 64, 0.08, 1e-5, 11
PIECE_BYTES = 512 << 10
#: Bins of each statistic: shares are cut evenly on a square-root scale, sizes by powers of two.
BINS = 24
STATS = ("upper", "digit", "mark", "newline", "space", "beyond_ascii", "word_size", "distinct", "n_words", "n_bytes", "capitalised", "ends_in_mark")
DIMS = WORD_DIMS + len(STATS) * BINS
_CLASSES = {"upper": [*range(65, 91)], "digit": [*range(48, 58)], "mark": [*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)], "newline": [10], "space": [9, 32], "beyond_ascii": [*range(192, 256)]}
_LUT = spaced_table()


def features(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(places, values, first of each row); every row has one place for each statistic."""
    n = len(column)
    column = pc.fill_null(column, "")
    w = words(column, _LUT)
    sizes = pc.binary_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
    edges = np.concatenate([[0], np.cumsum(sizes)])
    raw = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    first = np.frombuffer(column.buffers()[1], np.int32)[column.offset] if n else 0
    raw = raw[first : first + edges[-1]]
    stats = []
    for members in _CLASSES.values():
        flag = np.zeros(256, bool)
        flag[members] = True
        count = np.concatenate([[0], np.cumsum(flag[raw])])
        stats.append(_share(count[edges[1:]] - count[edges[:-1]], sizes))
    n_words = np.diff(w.rows)
    row = w.row_of_word()
    # case matters for quality, so it is part of the hash
    upper = flag_of(raw, w.starts, 65, 91)
    place = ((w.hashes() + upper * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - WORD_BITS)).astype(np.int64)
    pair = np.unique(row * WORD_DIMS + place)
    row_of, place = pair // WORD_DIMS, pair % WORD_DIMS
    distinct = np.bincount(row_of, minlength=n)
    letters = np.bincount(row, w.ends - w.starts, minlength=n)
    last = raw[w.ends - 1] if len(w.ends) else raw[:0]
    marks = ((last >= 33) & (last < 48)) | ((last >= 58) & (last < 65)) | (last == 124)
    stats += [
        np.minimum(BINS - 1, _share_of(letters, n_words)), _share(distinct, n_words), _log(n_words), _log(sizes),
        _share(np.bincount(row, upper, minlength=n), n_words), _share(np.bincount(row, marks, minlength=n), n_words),
    ]
    k = len(STATS)
    rows = np.concatenate([[0], np.cumsum(distinct + k)])
    places, values = np.empty(rows[-1], np.int64), np.empty(rows[-1], np.float32)
    at = np.arange(len(place)) + row_of * k
    places[at], values[at] = place, 1 / np.sqrt(np.maximum(distinct, 1))[row_of]
    for i, s in enumerate(stats):
        places[rows[1:] - k + i] = WORD_DIMS + i * BINS + s
        values[rows[1:] - k + i] = 0.5
    return places, values, rows


def flag_of(raw: np.ndarray, at: np.ndarray, low: int, high: int) -> np.ndarray:
    return ((raw[at] >= low) & (raw[at] < high)).astype(np.uint64) if len(at) else np.zeros(0, np.uint64)


def _share(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    return np.minimum(BINS - 1, (np.sqrt(part / np.maximum(whole, 1)) * BINS).astype(np.int64))


def _share_of(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    return (part / np.maximum(whole, 1)).astype(np.int64)


def _log(x: np.ndarray) -> np.ndarray:
    return np.minimum(BINS - 1, np.log2(x + 1.0).astype(np.int64))


class FactorisationMachine:
    """Weights of the model; ``fit`` and ``scores`` take features as places, values and row bounds."""

    def __init__(self):
        rng = np.random.default_rng(SEED)
        self.bias, self.linear = 0.0, np.zeros(DIMS, np.float32)
        self.factors = (rng.standard_normal((DIMS, FACTORS)) * 0.05).astype(np.float32)

    def _sums(self, places: np.ndarray, values: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        vx = self.factors[places] * values[:, None]
        s = np.add.reduceat(vx, starts)
        pairs = 0.5 * (s * s - np.add.reduceat(vx * vx, starts)).sum(1)
        return self.bias + np.add.reduceat(self.linear[places] * values, starts) + pairs, s

    def scores(self, places: np.ndarray, values: np.ndarray, rows: np.ndarray) -> np.ndarray:
        if len(rows) == 1:
            return np.zeros(0)
        return 1 / (1 + np.exp(-self._sums(places, values, rows[:-1])[0].astype(np.float64)))

    def fit(self, places: np.ndarray, values: np.ndarray, rows: np.ndarray, labels: np.ndarray) -> FactorisationMachine:
        n = len(labels)
        base = (labels.sum() + 1) / (n + 2)
        self.bias = float(np.log(base / (1 - base)))
        if n == 0 or labels.min() == labels.max():
            self.factors[:] = 0
            return self
        rng = np.random.default_rng(SEED)
        g_linear, g_factors = np.full(DIMS, 1e-4, np.float32), np.full((DIMS, FACTORS), 1e-4, np.float32)
        for _ in range(EPOCHS):
            order = rng.permutation(n)
            for at in range(0, n, BATCH):
                chosen = order[at : at + BATCH]
                size = np.diff(rows)[chosen]
                starts = np.concatenate([[0], np.cumsum(size)])
                where = np.repeat(rows[chosen] - starts[:-1], size) + np.arange(starts[-1])
                p, v = places[where], values[where]
                y, s = self._sums(p, v, starts[:-1])
                error = (1 / (1 + np.exp(-y)) - labels[chosen]).astype(np.float32)
                e = np.repeat(error, size)
                self.bias -= 0.02 * float(error.mean())
                used, inverse = np.unique(p, return_inverse=True)
                d = np.bincount(inverse, e * v).astype(np.float32) + DECAY * self.linear[used]
                g_linear[used] += d * d
                self.linear[used] -= RATE * d / np.sqrt(g_linear[used])
                near = np.repeat(s, size, axis=0) - self.factors[p] * v[:, None]
                for f in range(FACTORS):
                    d = np.bincount(inverse, e * v * near[:, f]).astype(np.float32) + DECAY * self.factors[used, f]
                    g_factors[used, f] += d * d
                    self.factors[used, f] -= RATE * d / np.sqrt(g_factors[used, f])
        return self


def _feature_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches, "text", PIECE_BYTES):
        places, values, rows = features(batch.column("text"))
        bounds = pa.array(rows, pa.int32())
        yield pa.RecordBatch.from_pydict({
            "at": batch.column("at"), "label": batch.column("label"), "n": pa.array(np.diff(rows), pa.int64()),
            "places": pa.ListArray.from_arrays(bounds, pa.array(places, pa.int32())), "values": pa.ListArray.from_arrays(bounds, pa.array(values, pa.float32())),
        })


def learn_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample_rows: int = SAMPLE_ROWS, sample_values: int = SAMPLE_VALUES) -> FactorisationMachine:
    """A model from at most ``sample_rows`` labelled rows with at most ``sample_values`` features, which the driver may hold at once."""
    chosen = (
        labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & (crc_mod5(F.col(id_col)) != 0))
        .select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label"))
        .orderBy(F.xxhash64("id"), "id", "label").limit(sample_rows)
    )
    # at most sample_rows pairs of id and label are broadcast
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "id")
    # an order of rows that holds for any layout; rows that are equal in all of it have equal features
    at = F.struct(F.xxhash64("id").alias("h"), F.col("id").cast("string").alias("i"), F.xxhash64("text").alias("a"), F.xxhash64(F.lit(1), "text").alias("b"))
    made = map_texts(rows, _feature_rows, f"at {rows.select(at.alias('at')).schema['at'].dataType.simpleString()}, label int, n long, places array<int>, values array<float>", at=at, label=F.col("label"), text=F.col("text"))
    made = Scratch(docs.sparkSession, "quality").keep(made)
    # repeated ids may make the sample larger, so rows are bounded here as well
    sizes = made.select("at", "label", "n").orderBy("at", "label").limit(sample_rows).toArrow()
    fits = int((np.cumsum(sizes.column("n").to_numpy()) <= sample_values).sum())
    got = made.orderBy("at", "label").limit(fits).select("label", "places", "values").toArrow().combine_chunks() if fits else None
    if got is None:
        return FactorisationMachine().fit(np.zeros(0, np.int64), np.zeros(0, np.float32), np.zeros(1, np.int64), np.zeros(0))
    size = pc.list_value_length(got.column("places")).to_numpy().astype(np.int64)
    flat = lambda c: pc.list_flatten(got.column(c)).to_numpy()
    return FactorisationMachine().fit(flat("places").astype(np.int64), flat("values").astype(np.float32), np.concatenate([[0], np.cumsum(size)]), got.column("label").to_numpy().astype(np.float64))


def score_quality(docs: DataFrame, model: FactorisationMachine, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and score (0 to 1) of each whole text; the model's size is fixed by DIMS and FACTORS; no shuffle."""
    sent = docs.sparkSession.sparkContext.broadcast((model.bias, model.linear, model.factors))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = FactorisationMachine.__new__(FactorisationMachine)
        m.bias, m.linear, m.factors = sent.value
        for batch in pieces(batches, "text", PIECE_BYTES):
            yield pa.RecordBatch.from_pydict({"id": batch.column("id"), "score": pa.array(m.scores(*features(batch.column("text"))), pa.float64())})

    kind = docs.schema[id_col].dataType.simpleString()
    return map_texts(docs, run, f"id {kind}, score double", id=F.col(id_col), text=F.col(text_col)).withColumnRenamed("id", id_col)
