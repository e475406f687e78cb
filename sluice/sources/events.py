"""A data source of latent events over sockets: TCP with binary frames, TCP with JSON lines, UDP with one event a datagram.

``spark.read.format("latent_events")`` and ``readStream`` have a partition for each endpoint. Options: ``protocol``
(tcp_binary, tcp_json or udp), ``endpoints`` ("host:port,host:port", or ``host`` and ``port`` of one), ``mode`` (listen or
connect), ``idle`` seconds.

A batch reads an endpoint in a task until its sender closes, or ``count`` events have come. Nothing for ``idle`` seconds
before that, or a close in the middle of a frame or line, is an error, so no events are missing from a result. Datagrams
have no end: without ``count`` they end after ``idle`` seconds, with it too few are an error.

A stream receives in threads of the driver, one for each endpoint, and writes what comes to ``log``, a folder that driver
and executors share, as numbered segments; only whole segments are handed out, and executors read them from there. A
segment is sealed at ``segment_bytes``, or when a batch is planned, and deleted when a later batch has been committed. With
``most_segments`` of an endpoint not committed, its thread stops to receive, so neither memory nor the log grow without
bound. A query that is started anew with the same log and checkpoint finds the segments again: batches that were not
committed read the same events, and numbers go on. What was received but not sealed when the driver was lost is not
durable. With ``resume``, a connection therefore begins with the receiver's count of durable events of the endpoint
(8 bytes, big-endian), from which the sender goes on, so that nothing is lost or doubled; without it, a close in the
middle of a frame stops the query, and what a sender sent to nobody is lost, as sockets have it.
"""

from __future__ import annotations

import json
import re
import socket
import struct
import threading
import time
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

from sluice.streaming.latents import EVENT, decode_frames

PROTOCOLS = ("tcp_binary", "tcp_json", "udp")
#: Bytes read at a time; a datagram is never larger.
CHUNK = 1 << 16
SEGMENT_BYTES, MOST_SEGMENTS = 1 << 20, 256
#: Seconds that a thread waits for bytes before it looks whether it should stop.
BEAT = 0.2
ARROW = pa.schema([("ts", pa.float64()), ("pid", pa.int32()), ("rank", pa.int32()), ("step", pa.int32()), ("req_ids", pa.list_(pa.string())), ("latents", pa.list_(pa.list_(pa.float32())))])


def event_rows(protocol: str, data: bytes) -> tuple[list[tuple], bytes]:
    """(rows, bytes of what is not whole yet). What does not parse is dropped; binary frames have no time and no process."""
    if protocol == "tcp_binary":
        events, rest = decode_frames(data)
        return [(None, None, e["rank"], e["step"], e["req_ids"], e["latents"]) for e in events], rest
    lines, rest = (data.split(b"\n")[:-1], data.split(b"\n")[-1]) if protocol == "tcp_json" else ([data], b"")
    rows = []
    for line in lines:
        try:
            e = json.loads(line)
            vectors = [None if v is None else [float(x) for x in v] for v in e.get("latents", [])]
            rows.append((float(e.get("ts", 0)), int(e.get("pid", -1)), int(e.get("rank", -1)), int(e.get("step", -1)), [str(x) for x in e.get("req_ids", [])], vectors))
        except (ValueError, TypeError, AttributeError):
            continue
    return rows, rest


def endpoints(options: dict[str, str]) -> list[tuple[str, int]]:
    """(host, port) of each endpoint."""
    named = options.get("endpoints") or f"{options.get('host', '127.0.0.1')}:{options['port']}"
    return [(host, int(port)) for host, _, port in (x.strip().rpartition(":") for x in named.split(","))]


def _protocol(options: dict[str, str]) -> str:
    protocol = options.get("protocol", "tcp_binary")
    if protocol not in PROTOCOLS:
        raise ValueError(f"no such protocol: {protocol}")
    return protocol


def _connected(host: str, port: int, patience: float) -> socket.socket:
    end = time.time() + patience
    while True:
        try:
            return socket.create_connection((host, port), timeout=patience)
        except OSError:
            if time.time() > end:
                raise
            time.sleep(0.1)


def received(protocol: str, host: str, port: int, mode: str, idle: float) -> Iterator[list[tuple]]:
    """Lists of rows as they come, up to the sender's close; of datagrams, up to a pause."""
    if protocol == "udp":
        with socket.socket(socket.AF_INET, socket.SOCK_DGRAM) as s:
            s.bind((host, port))
            s.settimeout(idle)
            while True:
                try:
                    yield event_rows(protocol, s.recv(CHUNK))[0]
                except TimeoutError:
                    return
    if mode == "listen":
        with socket.create_server((host, port)) as server:
            server.settimeout(idle)
            try:
                peer = server.accept()[0]
            except TimeoutError as e:
                raise TimeoutError(f"no sender has come to {host}:{port} in {idle:g} seconds") from e
    else:
        peer = _connected(host, port, idle)
    with peer:
        peer.settimeout(idle)
        rest = b""
        while True:
            try:
                data = peer.recv(CHUNK)
            except TimeoutError as e:
                raise TimeoutError(f"nothing has come to {host}:{port} for {idle:g} seconds, and its sender has not closed") from e
            if not data:
                break
            rows, rest = event_rows(protocol, rest + data)
            yield rows
    if rest.strip():
        raise ValueError(f"the sender closed {host}:{port} in the middle of an event")


@dataclass
class Endpoint(InputPartition):
    """What of an endpoint a task reads: all that comes, or segments from ``first`` to before ``end``."""

    host: str
    port: int
    first: int = 0
    end: int = 0


class EventReader(DataSourceReader):
    """One partition for each endpoint."""

    def __init__(self, options: dict[str, str]):
        self.options = options
        _protocol(options)

    def partitions(self) -> list[InputPartition]:
        return [Endpoint(host, port) for host, port in endpoints(self.options)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        o = self.options
        count = int(o["count"]) if "count" in o else None
        n = 0
        for rows in received(_protocol(o), partition.host, partition.port, o.get("mode", "listen"), float(o.get("idle", 10))):
            yield from rows if count is None else rows[: count - n]
            n += len(rows)
            if count is not None and n >= count:
                return
        if count is not None:
            raise ValueError(f"{n} of {count} events have come to {partition.host}:{partition.port}")


class SegmentLog:
    """Numbered segments of one endpoint's events below a shared folder; a name has the segment's number and the events up to its end."""

    def __init__(self, folder: str, host: str, port: int):
        self.fs, root = pafs.FileSystem.from_uri(folder)
        self.path = f"{root.rstrip('/')}/{re.sub('[^A-Za-z0-9.]', '_', host)}-{port}"

    def segments(self) -> dict[int, tuple[str, int]]:
        """(path, events up to its end) of each whole segment by its number."""
        out = {}
        for info in self.fs.get_file_info(pafs.FileSelector(self.path, allow_not_found=True)):
            if m := re.fullmatch(r"segment-([0-9]+)-([0-9]+)\.arrow", info.base_name):
                out[int(m[1])] = (info.path, int(m[2]))
        return out

    def write(self, number: int, upto: int, rows: list[tuple]) -> None:
        """A segment is there as a whole or not at all."""
        self.fs.create_dir(self.path, recursive=True)
        columns = [pa.array([r[k] for r in rows], f.type) for k, f in enumerate(ARROW)]
        part = f"{self.path}/part-{number}"
        with self.fs.open_output_stream(part) as out, pa.ipc.new_stream(out, ARROW) as writer:
            writer.write_batch(pa.RecordBatch.from_arrays(columns, schema=ARROW))
        self.fs.move(part, f"{self.path}/segment-{number:012d}-{upto}.arrow")

    def read(self, first: int, end: int) -> Iterator[pa.RecordBatch]:
        found = self.segments()
        for number in range(first, end):
            with self.fs.open_input_stream(found[number][0]) as data, pa.ipc.open_stream(data) as batches:
                yield from batches

    def forget(self, end: int) -> None:
        """Delete segments below ``end``; the last one stays, for the numbers to go on."""
        found = self.segments()
        for number, (path, _) in found.items():
            if number < min(end, max(found)):
                self.fs.delete_file(path)


class Receiver(threading.Thread):
    """Receives one endpoint's events and seals them as segments of a log."""

    def __init__(self, options: dict[str, str], host: str, port: int):
        super().__init__(daemon=True)
        self.options, self.host, self.port = options, host, port
        self.protocol, self.resume = _protocol(options), options.get("resume", "false").lower() == "true"
        self.log = SegmentLog(options["log"], host, port)
        found = self.log.segments()
        #: Number of the next segment, durable events, and the first segment that is not committed.
        self.next = max(found, default=-1) + 1
        self.durable = found[self.next - 1][1] if found else 0
        self.committed = min(found, default=0)
        self.rows: list[tuple] = []
        self.nbytes, self.error = 0, None
        self.changed, self.stopped = threading.Condition(), threading.Event()

    def seal(self) -> int:
        """Make all that has come durable; the number of segments."""
        with self.changed:
            if self.error:
                raise self.error
            self._seal()
            return self.next

    def _seal(self) -> None:
        if self.rows:
            self.log.write(self.next, self.durable + len(self.rows), self.rows)
            self.durable, self.next = self.durable + len(self.rows), self.next + 1
            self.rows, self.nbytes = [], 0

    def commit(self, end: int) -> None:
        with self.changed:
            self.committed = max(self.committed, end)
            self.log.forget(end)
            self.changed.notify_all()

    def _keep(self, rows: list[tuple], nbytes: int) -> None:
        with self.changed:
            self.rows += rows
            self.nbytes += nbytes
            if self.nbytes >= int(self.options.get("segment_bytes", SEGMENT_BYTES)):
                self._seal()
            # the sender waits as long as too much is not committed
            while self.next - self.committed >= int(self.options.get("most_segments", MOST_SEGMENTS)) and not self.stopped.is_set():
                self.changed.wait(BEAT)

    def run(self) -> None:
        try:
            if self.protocol == "udp":
                self._datagrams()
            elif self.options.get("mode", "listen") == "listen":
                with socket.create_server((self.host, self.port)) as server:
                    server.settimeout(BEAT)
                    while not self.stopped.is_set():
                        try:
                            peer = server.accept()[0]
                        except TimeoutError:
                            continue
                        self._connection(peer)
            else:
                self._connection(_connected(self.host, self.port, float(self.options.get("idle", 10))))
        except Exception as e:  # raised where the query asks for more
            self.error = e

    def _datagrams(self) -> None:
        with socket.socket(socket.AF_INET, socket.SOCK_DGRAM) as s:
            s.bind((self.host, self.port))
            s.settimeout(BEAT)
            while not self.stopped.is_set():
                try:
                    data = s.recv(CHUNK)
                except TimeoutError:
                    continue
                self._keep(event_rows(self.protocol, data)[0], len(data))

    def _connection(self, peer: socket.socket) -> None:
        rest = b""
        with peer:
            if self.resume:
                self.seal()
                peer.sendall(struct.pack(">Q", self.durable))
            peer.settimeout(BEAT)
            while not self.stopped.is_set():
                try:
                    data = peer.recv(CHUNK)
                except TimeoutError:
                    continue
                except ConnectionError:
                    data = b""
                if not data:
                    break
                rows, rest = event_rows(self.protocol, rest + data)
                self._keep(rows, len(data))
        if rest.strip() and not self.resume and not self.stopped.is_set():
            raise ValueError(f"the sender closed {self.host}:{self.port} in the middle of an event")


class EventStreamReader(DataSourceStreamReader):
    """Offsets are numbers of segments by endpoint."""

    def __init__(self, options: dict[str, str]):
        if not options.get("log"):
            raise ValueError("a stream of events needs a log, a folder that driver and executors share")
        _protocol(options)
        # the reader is sent to executors, so threads are made where offsets are asked for
        self.options, self.receivers = options, None

    def initialOffset(self) -> dict:
        return {f"{host}:{port}": 0 for host, port in endpoints(self.options)}

    def latestOffset(self) -> dict:
        if self.receivers is None:
            self.receivers = {f"{host}:{port}": Receiver(self.options, host, port) for host, port in endpoints(self.options)}
            for r in self.receivers.values():
                r.start()
        return {name: r.seal() for name, r in self.receivers.items()}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        out = [Endpoint(host, port, start.get(f"{host}:{port}", 0), end[f"{host}:{port}"]) for host, port in endpoints(self.options)]
        return [p for p in out if p.first < p.end]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        return SegmentLog(self.options["log"], partition.host, partition.port).read(partition.first, partition.end)

    def commit(self, end: dict) -> None:
        for name, r in (self.receivers or {}).items():
            r.commit(end.get(name, 0))

    def stop(self) -> None:
        for r in (self.receivers or {}).values():
            r.stopped.set()

    def __getstate__(self) -> dict:
        return {"options": self.options, "receivers": None}


class EventSource(DataSource):
    """Registered by ``spark.dataSource.register(EventSource)``."""

    @classmethod
    def name(cls) -> str:
        return "latent_events"

    def schema(self) -> str:
        return EVENT

    def reader(self, schema: StructType) -> DataSourceReader:
        return EventReader(dict(self.options))

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return EventStreamReader(dict(self.options))
