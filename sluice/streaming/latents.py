"""The latent event stream: binary frames, request ids, keyed accumulation and decoding state.

Delivery is exactly once through Structured Streaming's checkpoints; events are ordered by step and arrival and
deduplicated on request and step, so replays do not change a trajectory.
"""

from __future__ import annotations

import bisect
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

EVENT = "ts double, pid int, rank int, step int, req_ids array<string>, latents array<array<float>>"
#: Fixed values of the frame format: magic, big-endian headers of both versions.
MAGIC, HEADERS = b"AVTB", {1: ">4sBBHIHIi", 2: ">4sBBHIHIii"}


def encode_frame(req_ids: list[str], latents: list, step: int = -1, rank: int = -1, half: bool = True) -> bytes:
    """A version 2 frame; vectors are cut or padded with zeros to the length of the first one."""
    kind = np.dtype(">f2" if half else ">f4").newbyteorder("<")
    dim = next((len(v) for v in latents if v is not None), 0)
    body = bytearray()
    for rid, v in zip(req_ids, latents, strict=True):
        name = rid.encode()
        body += struct.pack(">H", len(name)) + name
        body += struct.pack(">B", v is not None and dim > 0)
        if v is not None and dim:
            x = np.zeros(dim, kind)
            x[: min(dim, len(v))] = np.asarray(v, float)[:dim]
            body += x.tobytes()
    size = struct.calcsize(HEADERS[2]) + len(body)
    return struct.pack(HEADERS[2], MAGIC, 2, int(half), 0, size, len(req_ids), dim, step, rank) + bytes(body)


def decode_frames(data: bytes) -> tuple[list[dict], bytes]:
    """(events, bytes of an incomplete frame); a wrong magic or version drops what is left; short bodies give nulls."""
    out = []
    while len(data) >= 8:
        version = data[4]
        if data[:4] != MAGIC or version not in HEADERS:
            return out, b""
        head = struct.calcsize(HEADERS[version])
        if len(data) < head:
            break
        _, _, flags, _, size, n, dim, step, *rank = struct.unpack(HEADERS[version], data[:head])
        if size < head or len(data) < size:
            break
        body, data = data[head:size], data[size:]
        out.append({"req_ids": [], "latents": [], "step": step, "rank": rank[0] if rank else None})
        kind, at = np.dtype("<f2" if flags & 1 else "<f4"), 0
        for _ in range(n):
            if at + 2 > len(body):
                out[-1]["req_ids"].append("")
                out[-1]["latents"].append(None)
                break
            length = struct.unpack_from(">H", body, at)[0]
            name, at = body[at + 2 : at + 2 + length].decode(errors="ignore"), at + 2 + length
            vector = None
            if at < len(body) and body[at] and dim:
                raw = body[at + 1 : at + 1 + dim * kind.itemsize]
                vector = np.frombuffer(raw, kind).astype("f4").tolist() if len(raw) == dim * kind.itemsize else None
                at += dim * kind.itemsize
            out[-1]["req_ids"].append(name)
            out[-1]["latents"].append(vector)
            if at >= len(body):
                break
            at += 1
    return out, data


def encode_events(df: DataFrame) -> DataFrame:
    """frame (binary) of each event row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            frames = [encode_frame(list(r), [None if v is None else list(v) for v in x], int(s), int(k)) for r, x, s, k in zip(pdf["req_ids"], pdf["latents"], pdf["step"], pdf["rank"], strict=True)]
            yield pd.DataFrame({"frame": frames})

    return df.select("req_ids", "latents", "step", "rank").mapInPandas(run, "frame binary")


def decode_events(df: DataFrame, column: str = "frame") -> DataFrame:
    """Events of each row's bytes."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            events = [e for x in pdf[column] for e in decode_frames(bytes(x))[0]]
            yield pd.DataFrame(events, columns=["req_ids", "latents", "step", "rank"])

    return df.select(column).mapInPandas(run, "req_ids array<string>, latents array<array<float>>, step int, rank int")


def parse_request(rid: Column) -> Column:
    """Struct parent, sample: ``s_p`` or ``s-p`` is (p, s), digits alone (id, 0), else the last two numeric parts, else (id, 0)."""
    two = F.regexp_extract(rid, r"^([0-9]+)[_-]([0-9]+)$", 1) != ""
    tail = r"([0-9]+)[_-]([0-9]+)$"
    more = F.regexp_extract(rid, r"[_-]" + tail, 2) != ""
    pick = lambda i: F.regexp_extract(rid, tail, i)
    parent = F.when(two | more, pick(2)).otherwise(rid)
    sample = F.when(two | more, pick(1).try_cast("int")).otherwise(0)
    return F.struct(parent.alias("parent"), F.coalesce(sample, F.lit(0)).alias("sample"))


def exploded(events: DataFrame, rank: int | None = None) -> DataFrame:
    """One row for each request of each event with a vector that is not empty; events of other ranks, or without rank, go."""
    kept = events if rank is None else events.filter(F.col("rank") == rank)
    flat = kept.select("ts", "step", F.explode(F.arrays_zip("req_ids", "latents")).alias("x")).select("ts", "step", F.col("x.req_ids").alias("req_id"), F.col("x.latents").alias("latent"))
    return flat.filter(F.size("latent") > 0).withColumn("id", parse_request(F.col("req_id")))


def _steps(events: DataFrame, rank: int | None) -> DataFrame:
    """parent, sample, step, ts, latent of each request and step: of events that say the same step, the one with the least time,
    then the least vector."""
    first = F.min(F.struct("ts", "latent")).alias("x")
    return exploded(events, rank).groupBy("id.parent", "id.sample", "step").agg(first).select("parent", "sample", "step", "x.ts", "x.latent")


def _in_order(steps: DataFrame) -> DataFrame:
    ordered = F.array_sort(F.collect_list(F.struct("step", "ts", "latent")))
    return steps.groupBy("parent", "sample").agg(F.transform(ordered, lambda x: x["latent"]).alias("vectors"))


def trajectories(events: DataFrame, rank: int | None = None) -> DataFrame:
    """parent, sample, vectors in order of steps: the batch form of the recorder."""
    return _in_order(_steps(events, rank))


#: The state store that a recording stream needs, for keyed state of several variables.
STATE_STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
_RECORD = "parent string, sample int, step int, ts double, latent array<float>"


class _Recorder(StatefulProcessor):
    """Keeps a vector for each step of a request, as a map in the state store, of which a batch reads only the steps that it has."""

    def __init__(self, ttl: int | None):
        self.ttl = ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.steps = handle.getMapState("steps", "step int", "ts double, latent array<float>", self.ttl)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        best: dict[int, tuple] = {}
        for pdf in rows:
            for step, ts, latent in zip(pdf["step"], pdf["ts"], pdf["latent"], strict=True):
                # what has no time is before what has one, as in the batch form
                found = (None if ts is None or ts != ts else float(ts), [float(x) for x in latent])
                if int(step) not in best or _earlier(found, best[int(step)]):
                    best[int(step)] = found
        new = []
        for step, found in sorted(best.items()):
            before = self.steps.getValue((step,)) if self.steps.containsKey((step,)) else None
            if before is None:
                new.append((key[0], int(key[1]), step, *found))
            if before is None or _earlier(found, (before[0], list(before[1]))):
                self.steps.updateValue((step,), found)
        yield pd.DataFrame(new, columns=["parent", "sample", "step", "ts", "latent"])

    def close(self) -> None:
        pass


def _earlier(a: tuple, b: tuple) -> bool:
    rank = lambda x: (x[0] is not None, x[0] or 0.0, x[1])
    return rank(a) < rank(b)


def record_trajectories(events: DataFrame, rank: int | None = None, ttl: int | None = None) -> DataFrame:
    """The recorder as a stream: a row (parent, sample, step, ts, latent) when a request's step is seen for the first time.

    The vectors are in the state store, one entry for each step of a request, so a request may have any number of them and
    a batch touches only its own. An event that comes late but has an earlier time replaces the step's vector there, so
    ``stored_trajectories`` gives what ``trajectories`` gives for the same events, in whatever order and batches they
    came, also with some of them twice. Entries that nothing has written for ``ttl`` milliseconds go; without it a
    query may end with its input. The session needs the settings of ``STATE_STORE``.
    """
    rows = exploded(events, rank).select("id.parent", "id.sample", "step", "ts", "latent")
    grouped = rows.groupBy("parent", "sample")
    return grouped.transformWithStateInPandas(_Recorder(ttl), _RECORD, "append", "None" if ttl is None else "ProcessingTime")


def stored_trajectories(spark: SparkSession, checkpoint: str, batch: int | None = None) -> DataFrame:
    """parent, sample, vectors in order of steps, from the state that a recording stream's checkpoint has after its last, or a given, batch."""
    read = spark.read.format("statestore").option("path", checkpoint).option("stateVarName", "steps")
    state = (read if batch is None else read.option("batchId", batch)).load()
    # with a lifetime, the vector is in a field beside its end
    value = "user_map_value.value" if "ttlExpirationMs" in state.schema["user_map_value"].dataType.names else "user_map_value"
    return _in_order(state.select("key.parent", "key.sample", F.col("user_map_key.step").alias("step"), f"{value}.ts", f"{value}.latent"))


#: Milliseconds without an event after which a request's state goes.
IDLE = 3_600_000


def add_step(ranges: list[int], step: int) -> bool:
    """Add a step to sorted half-open ranges, given as start, end, start, end; whether it is new."""
    k = bisect.bisect_right(ranges, step)
    if k % 2:
        return False
    joins_left, joins_right = k > 0 and ranges[k - 1] == step, k < len(ranges) and ranges[k] == step + 1
    if joins_left and joins_right:
        del ranges[k - 1 : k + 1]
    elif joins_left:
        ranges[k - 1] = step + 1
    elif joins_right:
        ranges[k] = step
    else:
        ranges[k:k] = [step, step + 1]
    return True


def stream_trajectories(events: DataFrame, rank: int | None = None, idle: int | None = IDLE) -> DataFrame:
    """The recorder as a stateful stream: (parent, sample, step, n): the count of vectors after each new step.

    A request's state is the ranges of its steps, so it does not grow while they follow each other; it goes when no
    event has come for ``idle`` milliseconds, after which a step that comes again counts anew. A query that ends with its
    input (``availableNow``) takes None for ``idle``: with timeouts Spark always runs another batch.
    """
    rows = exploded(events, rank).select("id.parent", "id.sample", "step", "ts")
    timeout = GroupStateTimeout.NoTimeout if idle is None else GroupStateTimeout.ProcessingTimeTimeout

    def advance(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        ranges = list(state.get[0]) if state.exists else []
        n, out = sum(ranges[1::2]) - sum(ranges[::2]), []
        for pdf in batches:
            for step in pdf.sort_values(["step", "ts"])["step"]:
                if add_step(ranges, int(step)):
                    n += 1
                    out.append((key[0], int(key[1]), int(step), n))
        state.update((ranges,))
        if idle is not None:
            state.setTimeoutDuration(idle)
        yield pd.DataFrame(out, columns=["parent", "sample", "step", "n"])

    return rows.groupBy("parent", "sample").applyInPandasWithState(advance, "parent string, sample int, step int, n int", "steps array<int>", "append", timeout)


def decode_states(tokens: list[int], start: int, end: int, size: int) -> list[bool]:
    """Whether latent decoding is active at each token: the start token turns it on, the end token or ``size`` steps off."""
    out, active, n = [], False, 0
    for x in tokens:
        if active:
            n += 1
            if x == end or n >= size:
                active = False
        elif x == start:
            active, n = True, 0
        out.append(active)
    return out


def decoded_states(df: DataFrame, key: str, tokens: str, start: int, end: int, size: int) -> DataFrame:
    """``active`` of each row: whether latent decoding is on at each of its tokens."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({key: pdf[key], "active": [decode_states(list(x), start, end, size) for x in pdf[tokens]]})

    return df.select(key, tokens).mapInPandas(run, f"{key} {df.schema[key].dataType.simpleString()}, active array<boolean>")


def online_selection(rollouts: DataFrame, key: str, correct: str, threshold: float, least_keys: int) -> DataFrame:
    """Whole groups of a macro-batch whose success rate is above 0 and at most the threshold; none if too few keys."""
    from sluice.operators.metrics import select_by_difficulty

    chosen = select_by_difficulty(rollouts, key, correct, threshold)
    enough = chosen.limit(least_keys).count() >= least_keys
    kept = rollouts.join(chosen.select(key), key, "left_semi")
    return kept if enough else kept.limit(0)


def latest_step(listing: DataFrame) -> int | None:
    """The newest step of a checkpoint listing."""
    return listing.agg(F.max("step")).first()[0]


def append_metrics(spark: SparkSession, path: str, step: int, values: dict[str, float]) -> None:
    """Append (step, name, value) rows to a metrics table."""
    rows = [(step, k, float(v)) for k, v in values.items()]
    spark.createDataFrame(rows, "step long, name string, value double").coalesce(1).write.mode("append").parquet(path)
