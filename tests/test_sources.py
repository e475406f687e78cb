import json
import os
import signal
import socket
import struct
import subprocess
import sys
import threading
import time

import pytest
from pyspark.errors import PySparkException

from sluice.sources import events as sources_events
from sluice.sources.events import BEAT, EventSource, Receiver, SegmentLog, event_rows
from sluice.streaming import latents
from sluice.streaming.latents import encode_frame

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def free_port(kind=socket.SOCK_STREAM):
    with socket.socket(socket.AF_INET, kind) as s:
        s.bind(("127.0.0.1", 0))
        return s.getsockname()[1]


def test_rows_of_parts():
    frames = encode_frame(["1_2", "x"], [[0.5, 1.0], None], 3, 0) + encode_frame(["9"], [[2.0]], 4, 1)
    rows, rest = event_rows("tcp_binary", frames[:-1])
    assert [(r[2:]) for r in rows] == [(0, 3, ["1_2", "x"], [[0.5, 1.0], None])] and rest
    rows, rest = event_rows("tcp_binary", rest + frames[-1:])
    assert rows[0][3:] == (4, ["9"], [[2.0]]) and rest == b""
    rows, rest = event_rows("tcp_json", b'{"step": 1, "req_ids": [7], "latents": [null]}\nnot json\n[1]\n{"st')
    assert [r[3:] for r in rows] == [(1, ["7"], [None])] and rest == b'{"st'


def test_udp_and_listening_tcp(spark):
    spark.dataSource.register(EventSource)
    for protocol, kind in (("udp", socket.SOCK_DGRAM), ("tcp_json", socket.SOCK_STREAM)):
        port = free_port(kind)
        sent = threading.Event()

        def send(protocol=protocol, kind=kind, port=port, sent=sent):
            data = json.dumps({"step": 5, "rank": 1, "req_ids": ["3_4"], "latents": [[0.25]]}).encode()
            while not sent.is_set():
                try:
                    with socket.socket(socket.AF_INET, kind) as s:
                        s.connect(("127.0.0.1", port))
                        s.sendall(data + b"\n" * (protocol == "tcp_json"))
                except OSError:
                    pass
                time.sleep(0.2)

        thread = threading.Thread(target=send, daemon=True)
        thread.start()
        got = spark.read.format("latent_events").option("protocol", protocol).option("port", port).option("count", 1).option("idle", 30).load().collect()
        sent.set()
        assert [(r.step, r["rank"], r.req_ids, r.latents) for r in got] == [(5, 1, ["3_4"], [[0.25]])]


def serve_once(data, pause=0.0):
    """An endpoint that sends some bytes to who connects, waits and closes."""
    server = socket.create_server(("127.0.0.1", 0))

    def send():
        with server, server.accept()[0] as peer:
            peer.sendall(data)
            time.sleep(pause)

    threading.Thread(target=send, daemon=True).start()
    return f"127.0.0.1:{server.getsockname()[1]}"


def batch(spark, ends, **options):
    spark.dataSource.register(EventSource)
    return spark.read.format("latent_events").option("mode", "connect").option("endpoints", ends).options(**options).load()


def test_endpoints_are_partitions(spark):
    frames = lambda k: b"".join(encode_frame([f"{k}_{s}"], [[1.0]], s, k) for s in range(100))
    found = batch(spark, ",".join(serve_once(frames(k)) for k in range(3)))
    assert found.rdd.getNumPartitions() == 3
    rows = batch(spark, ",".join(serve_once(frames(k)) for k in range(3))).select("rank", "step").collect()
    assert sorted(map(tuple, rows)) == [(k, s) for k in range(3) for s in range(100)]


@pytest.mark.parametrize(("data", "pause", "said"), [(encode_frame(["a"], [[1.0]], 1, 0), 4, "has not closed"), (encode_frame(["a"], [[1.0]], 1, 0) + b"AVTB\x02", 0, "middle of an event"), (b"", 0, "0 of 1 events")])
def test_what_is_missing_is_an_error(spark, data, pause, said):
    options = {"count": 1} if not data else {}
    with pytest.raises(PySparkException, match=said):
        batch(spark, serve_once(data, pause), idle=1, **options).collect()


def test_log_of_segments(tmp_path):
    log = SegmentLog(f"file://{tmp_path}", "::1", 5)
    assert log.segments() == {} and list(log.read(0, 0)) == []
    row = lambda i: (0.5, 1, 2, i, ["a", None], [[1.5, 2.0], None])
    log.write(0, 2, [row(0), row(1)])
    log.write(1, 3, [row(2)])
    assert [b.num_rows for b in log.read(0, 2)] == [2, 1] and next(log.read(1, 2)).to_pylist()[0]["latents"] == [[1.5, 2.0], None]
    (tmp_path / "__1-5" / "part-2").write_bytes(b"half a segment")
    assert {n: upto for n, (_, upto) in log.segments().items()} == {0: 2, 1: 3}
    log.forget(2)
    assert list(log.segments()) == [1]  # the last one keeps the numbers


def receiver(tmp_path, port, **options):
    r = Receiver({"log": f"file://{tmp_path}", "protocol": "tcp_binary", **options}, "127.0.0.1", port)
    r.start()
    return r


def until(f, seconds=30):
    end = time.time() + seconds
    while not (got := f()) and time.time() < end:
        time.sleep(0.05)
    return got


def sent(port, data, resume=False):
    """Send to a port as soon as it listens; the count that the receiver said."""
    end = time.time() + 30
    while True:
        try:
            with socket.create_connection(("127.0.0.1", port)) as s:
                n = struct.unpack(">Q", s.recv(8, socket.MSG_WAITALL))[0] if resume else 0
                s.sendall(data[n:] if not resume else b"".join(data[n:]))
                return n
        except ConnectionRefusedError:
            assert time.time() < end
            time.sleep(0.05)


def test_receiver_resumes_and_holds_back(tmp_path, monkeypatch):
    monkeypatch.setattr(sources_events, "CHUNK", 64)
    port = free_port()
    frames = [encode_frame([str(i)], [[float(i)]], i, 0) for i in range(40)]
    r = receiver(tmp_path, port, resume="true", segment_bytes="200", most_segments="3")
    # half a frame at the end is not an event; the sender goes on with that one
    assert sent(port, [*frames[:5], frames[5][:7]], resume=True) == 0
    assert until(lambda: r.seal() > 0)
    assert sent(port, frames, resume=True) in range(1, 6)
    # with three segments that no one has committed, no more is taken
    assert until(lambda: r.next >= 3)
    time.sleep(3 * BEAT)
    held = r.next
    r.commit(r.next)
    assert until(lambda: r.next > held)
    # what was sealed is found by another process, and goes on from there
    until(lambda: r.commit(r.next) or r.durable == 40)
    r.seal()
    r.stopped.set()
    r.join()
    again = receiver(tmp_path, port, resume="true")
    assert again.next == r.next and again.durable == 40
    assert sent(port, frames, resume=True) == 40
    again.stopped.set()
    again.join()


def test_a_half_frame_stops_a_stream_without_resume(tmp_path):
    port = free_port()
    r = receiver(tmp_path, port)
    sent(port, encode_frame(["a"], [[1.0]], 1, 0)[:-3])
    assert until(lambda: r.error is not None)
    with pytest.raises(ValueError, match="middle of an event"):
        r.seal()


def test_stream(spark, tmp_path):
    spark.dataSource.register(EventSource)
    port = free_port()
    events = spark.readStream.format("latent_events").option("protocol", "tcp_binary").option("port", port).option("log", f"file://{tmp_path}/log").load()
    run = events.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/c").option("path", f"{tmp_path}/o").trigger(processingTime="200 milliseconds").start()
    try:
        end = time.time() + 60
        while time.time() < end:
            try:
                with socket.create_connection(("127.0.0.1", port)) as s:
                    for step in range(50):
                        s.sendall(encode_frame([f"1_{step}"], [[1.0]], step, 0))
                break
            except OSError:
                time.sleep(0.2)
        while time.time() < end and (not run.lastProgress or sum(p["numInputRows"] for p in run.recentProgress) < 50):
            time.sleep(0.2)
        run.processAllAvailable()
    finally:
        run.stop()
    assert sorted(r.step for r in spark.read.schema(latents.EVENT).parquet(f"{tmp_path}/o").collect()) == list(range(50))


#: A driver that streams events to files until it is killed, or all steps are there.
DRIVER = """
import sys
sys.path.insert(0, {root!r})
from sluice.session import get_session
from sluice.sources.events import EventSource
spark = get_session("killed", cores=2, **{{"spark.sql.shuffle.partitions": 2}})
spark.dataSource.register(EventSource)
events = spark.readStream.format("latent_events").options(endpoints={ends!r}, log="file://{at}/log", resume="true", segment_bytes="2000").load()
events.select("rank", "step").writeStream.format("parquet").option("checkpointLocation", "{at}/check").trigger(processingTime="100 milliseconds").start("{at}/out").awaitTermination()
"""


def test_a_killed_driver_loses_and_doubles_nothing(spark, tmp_path):
    ports, total = [free_port(), free_port()], 3000
    ends = ",".join(f"127.0.0.1:{p}" for p in ports)
    over = threading.Event()

    def send(port, rank):
        # slowly, and from where the receiver says, whenever the connection breaks
        while not over.is_set():
            try:
                with socket.create_connection(("127.0.0.1", port)) as s:
                    n = struct.unpack(">Q", s.recv(8, socket.MSG_WAITALL))[0]
                    for step in range(n, total):
                        s.sendall(encode_frame(["r"], [[1.0]], step, rank))
                        if step % 20 == 0:
                            time.sleep(0.05)
                    over.wait(1)
            except (OSError, struct.error):
                time.sleep(0.1)

    threads = [threading.Thread(target=send, args=(p, k), daemon=True) for k, p in enumerate(ports)]
    for t in threads:
        t.start()
    out = lambda: spark.read.schema("rank int, step int").parquet(f"{tmp_path}/out").collect() if (tmp_path / "out" / "_spark_metadata").exists() else []
    script = tmp_path / "driver.py"
    script.write_text(DRIVER.format(root=ROOT, ends=ends, at=tmp_path))
    for enough in (300, 2500, 2 * total):
        run = subprocess.Popen([sys.executable, str(script)], stdout=subprocess.DEVNULL, stderr=subprocess.DEVNULL, start_new_session=True)
        try:
            assert until(lambda enough=enough: len(out()) >= enough, 120)
        finally:
            os.killpg(run.pid, signal.SIGKILL)
            run.wait()
    over.set()
    assert sorted(map(tuple, out())) == [(k, s) for k in range(2) for s in range(total)]


def test_ranges_of_steps():
    ranges, seen = [], set()
    for step in [5, 3, 4, 4, 9, 0, 8, 1, 2, 7, 6, 5]:
        assert latents.add_step(ranges, step) == (step not in seen)
        seen.add(step)
        flat = [x for a, b in zip(ranges[::2], ranges[1::2], strict=True) for x in range(a, b)]
        assert flat == sorted(seen)
    assert ranges == [0, 10]
