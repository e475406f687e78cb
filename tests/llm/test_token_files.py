import glob
import random
import tempfile
import zlib

import numpy as np
import public_tokenizers as P
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sluice.llm import queries, token_files
from sluice.llm.token_files import checksums, read_positions, read_shards, read_token_files, write_token_files

TOKENIZER = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
TOKENIZER.encode_special_tokens = True
TEXTS = [
    None, "", " ", "a", "don't  stop \n\n now ", "tab\t\tx  y", "日本語の文章 ½ Ⅷ", "x" * 20000, "word " * 5000 + "end", "<|endoftext|> is text <|endoftext|>", "a  b \n \n c ",
    "same", "same", "é́ ø ​ z  q", "12 345 6789'll we've", "퟿\U0001f600 ok",
]


def folder():
    return tempfile.mkdtemp(prefix="tokens-") + "/t"


def whole(text):
    return TOKENIZER.encode(text or "", add_special_tokens=False).ids + [2]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_query_against_the_library(spark):
    sf = "/root/testdata/sf0.001"
    rows = sorted(queries.op11_token_files(spark, sf).collect(), key=lambda r: r.doc_id)
    docs = sorted(spark.read.parquet(f"{sf}/documents.parquet").collect(), key=lambda r: r.doc_id)
    assert [r.doc_id for r in rows] == [d.doc_id for d in docs]
    at = 0
    for r, d in zip(rows, docs, strict=True):
        ids = whole(d.text)
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), crc(ids))
        at += len(ids)


@pytest.mark.parametrize("encoding", token_files.ENCODINGS)
def test_round_trip_of_odd_texts(spark, encoding):
    # nulls, empty and long texts, repeated rows, clashing names
    rows = [(100 - i, t, "x", i) for i, t in enumerate(TEXTS)] + [(3, "same", "y", 0)] * 3 + [(None, "no id", "z", 1)] * 2
    df = spark.createDataFrame(rows, "doc_id long, text string, part string, ids int").repartition(4)
    path = folder()
    write_token_files(df, path, meta_cols=("part", "ids"), encoding=encoding, shards=5)
    back = read_token_files(spark, path).collect()
    assert len(back) == len(rows)
    got = sorted((r.start, r.n_tokens, r.id, list(r.ids), tuple(r.meta)) for r in back)
    at = 0
    for start, n, _, ids, _ in got:
        assert start == at and n == len(ids)
        at += n
    assert [x[2] for x in got] == sorted((r[0] for r in rows), key=lambda i: -1 if i is None else i)
    want = sorted(((i, whole(t), (a, b)) for i, t, a, b in rows), key=repr)
    assert sorted(((x[2], x[3], x[4]) for x in got), key=repr) == want
    sums = {(r.id, r.start): r.ids_crc32 for r in checksums(read_token_files(spark, path)).collect()}
    assert sums == {(x[2], x[0]): crc(x[3]) for x in got}
    stream = [t for x in got for t in x[3]]
    for first, last in ((0, 1), (3, 17), (0, len(stream)), (len(stream) - 5, len(stream) + 9), (1000, 9000), (50, 50)):
        found = sorted((r.start, list(r.ids)) for r in read_positions(spark, path, first, last).collect())
        assert [t for _, ids in found for t in ids] == stream[first:last], (first, last)
        assert all(stream[s : s + len(ids)] == ids for s, ids in found)


def test_files_have_the_stated_layout(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    for encoding, name in (("dictionary", "RLE_DICTIONARY"), ("delta", "DELTA_BINARY_PACKED")):
        path = folder()
        write_token_files(docs, path, encoding=encoding, shards=2, row_group_bytes=256 << 10, page_bytes=16 << 10, page_rows=50)
        files = glob.glob(f"{path}/tokens/*.parquet")
        assert len(files) == 2
        for f in files:
            meta = pq.ParquetFile(f).metadata
            assert meta.num_row_groups > 1
            for g in range(meta.num_row_groups):
                columns = {meta.row_group(g).column(c).path_in_schema: meta.row_group(g).column(c) for c in range(meta.num_columns)}
                assert all(c.has_offset_index and c.has_column_index for c in columns.values())
                assert name in columns["ids.list.element"].encodings
                assert all("DELTA_BINARY_PACKED" in columns[c].encodings for c in ("id", "start", "n_tokens"))
        shards = sorted(read_shards(spark, path).collect())
        assert [s.base for s in shards] == [0, shards[0].n_tokens]


def test_reads_are_selective(spark):
    path = folder()
    write_token_files(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), path, shards=4, page_rows=20)
    plan = lambda df: df._jdf.queryExecution().toString()
    light = plan(read_token_files(spark, path).select("id", "start"))
    assert "ids" not in light.split("== Physical Plan ==")[1]
    assert "GreaterThanOrEqual(id,10)" in plan(read_token_files(spark, path).filter(F.col("id").between(10, 12)))
    assert read_token_files(spark, path).filter(F.col("id").between(10, 12)).count() == 3


def test_empty_table(spark):
    path = folder()
    write_token_files(spark.createDataFrame([], "doc_id string, text string"), path)
    assert read_token_files(spark, path).count() == 0
    assert checksums(read_token_files(spark, path)).count() == 0
    assert read_positions(spark, path, 0, 10).count() == 0


def test_memory_is_bounded(monkeypatch):
    monkeypatch.setattr(token_files, "MOST_WORDS", 5)
    monkeypatch.setattr(token_files, "GATHERED", 3)
    encoder = token_files.ChunkEncoder(open(P.path("byte_bpe_50k.json"), "rb").read())
    for k in range(4):
        text = " ".join(f"w{chr(97 + k)}{chr(97 + i)}" for i in range(9)) + " again"
        assert np.frombuffer(encoder.encode([text])[0], "<u4").tolist() == whole(text)[:-1]
        assert len(encoder.words) <= 9


def test_cuts_change_nothing():
    rng = random.Random(8)
    encoder = token_files.ChunkEncoder(open(P.path("byte_bpe_50k.json"), "rb").read())
    signs = " \n\t\r\x0b\x1c\x1f\x85\xa0\u180e\u200b\u2003\u3000ab'sé日½Ⅷ́.<|9\x00\x7f\U0001f600"
    texts = ["".join(rng.choices(signs, weights=[12, 3] + [1] * (len(signs) - 2), k=rng.randint(0, 60))) for _ in range(4000)]
    texts += [f"ab{c}{d}{e}cd {c}ef{d} g" for c in signs for d in signs for e in " \nx"]
    assert [np.frombuffer(p, "<u4").tolist() for p in encoder.encode(texts)] == [whole(t)[:-1] for t in texts]
