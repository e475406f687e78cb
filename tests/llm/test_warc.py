import base64
import gzip
import hashlib
import io

import pytest

from sluice.llm import queries, warc
from sluice.session import shared_dir


def digest(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


PAGES = [
    (5, "http://a/", "one\ntwo"), (3, "http://b/", "one\ntwo"), (9, "http://c/", None), (8, "u r\nl", ""), (1, None, "é\r\n\r\nWARC/1.1\r\n\n"),
    (2, "x", "line\n"), (4, "x", "\n"), (6, "x", "\r"), (7, "x", "long " * 300_000 + "\n" + "y\n" * 900_000), (10, "one line", "zé" * 900_000), (11, "x", "q" * warc.CHUNK_BYTES), (12, "x", "q" * (warc.CHUNK_BYTES - 1) + "\n"), (3, "http://b/", "one\ntwo"), (None, "n", "one\ntwo"), (None, "n", "alone"),
]


def write(spark, tmp_path, rows, n=3, least=0):
    path = f"file://{tmp_path}/archive"
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 AS id", "2 AS digest").repartition(n)
    warc.write_archives(warc.plan_records(pages, min_revisit_bytes=least), path)
    return path


def test_round_trip(spark, tmp_path):
    path = write(spark, tmp_path, PAGES)
    got = sorted((tuple(r)[:5] for r in warc.read_records(spark, path).collect()), key=str)
    want = []
    for i, _, t in PAGES:
        ids = [p for p, _, x in PAGES if (x or "") == (t or "") and p is not None]
        first = min(ids, default=None)
        revisit = first is not None and i != first
        want.append((str(i) if i is not None else "null", len((t or "").encode()), digest(t), "revisit" if revisit else "response", str(first) if revisit else None))
    assert got == sorted(want, key=str)
    rows = warc.read_chunks(spark, path).orderBy("chunk_no").collect()
    whole = {}
    for r in rows:
        if r.record_type == "response":
            whole.setdefault(r.record_id, []).append(bytes(r.data))
    for i, n in (("1", 1), ("7", 4), ("10", 3), ("11", 1), ("12", 1)):
        assert b"".join(whole[i]).decode() == next(t for p, _, t in PAGES if str(p) == i) and len(whole[i]) == n
        assert all(len(x) == warc.CHUNK_BYTES for x in whole[i][:-1])
    seen = {}
    for r in rows:
        if r.record_id == "10":
            assert r.chunk_start == len(seen.get("10", b"")) and r.is_last == (r.chunk_no == 2)
            seen["10"] = seen.get("10", b"") + bytes(r.data)
            assert r.digest_so_far == base64.b32encode(hashlib.sha1(seen["10"]).digest()).decode()


def test_files_are_warc(spark, tmp_path):
    write(spark, tmp_path, PAGES[:4], n=1)
    data = b"".join(gzip.open(f).read() for f in (tmp_path / "archive").glob("part-*"))
    stream, n = io.BytesIO(data), 0
    while line := stream.readline():
        assert line == b"WARC/1.1\r\n"
        head = {}
        while (line := stream.readline()) != b"\r\n":
            key, _, value = line.decode().strip().partition(": ")
            head[key] = value
        assert len(stream.read(int(head["Content-Length"]))) == int(head["Content-Length"])
        assert stream.read(4) == b"\r\n\r\n"
        n += 1
    assert n == 4


def test_least_size_of_revisits_and_empty_table(spark, tmp_path):
    path = write(spark, tmp_path, PAGES, least=3)
    assert {r.record_type for r in warc.read_records(spark, path).collect() if r.payload_bytes < 3} == {"response"}
    (tmp_path / "e").mkdir()
    assert warc.read_records(spark, write(spark, tmp_path / "e", [])).count() == 0


def test_damage_is_seen(spark, tmp_path):
    write(spark, tmp_path, [(1, "u", "hello world")], n=1)
    f = next((tmp_path / "archive").glob("part-*"))
    data = gzip.decompress(f.read_bytes()).replace(b"hello", b"jello")
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "x.txt.gz").write_bytes(gzip.compress(data))
    with pytest.raises(Exception, match="another digest"):
        warc.read_records(spark, f"file://{tmp_path}/bad").collect()


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    assert shared_dir(spark)
    got = {r.page_id: r for r in queries.op7_warc(spark, sf).collect()}
    pages = spark.read.parquet(f"{sf}/pages.parquet").collect()
    first = {}
    for p in sorted(pages, key=lambda r: r.page_id):
        first.setdefault(p.html, p.page_id)
    for p in pages:
        r = got[p.page_id]
        assert (r.payload_bytes, r.payload_digest) == (len(p.html.encode()), digest(p.html))
        assert (r.record_type, r.refers_to) == (("response", None) if first[p.html] == p.page_id else ("revisit", first[p.html]))
