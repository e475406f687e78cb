"""Token ids as Parquet files of list columns, for reads of chosen tokens and columns (operator 11).

Layout below a path:

* ``tokens``: one file for each partition, rows in ascending order of ids. Columns ``part`` (the file's number),
  ``id``, ``start`` (tokens before the row in its file), ``n_tokens``, ``ids`` (a list) and, where asked for, ``meta``
  (a struct of further columns). Token ids are dictionary or delta encoded, numbers delta encoded. Row groups and pages
  have the given sizes, and Parquet's column and offset indexes tell a reader which pages hold a range of ids or starts.
* ``shards``: one row for each file: ``part``, ``n_rows``, ``n_tokens`` and ``base``, the tokens of all files before it.
  It is written last, from the files, so its marker of success stands for the whole.

Spark writes and reads the files, so a lost executor's tasks are repeated and only whole files are committed. Texts are
dealt over partitions by ranges of ids and sorted once; the order is total (id, hash of the text, place in the input), so
a repeated task writes the same rows. One row for each file reaches the driver, whatever the number of documents.

The tokenizers library encodes. Texts are cut at spaces where that cannot change its pre-tokens, and a batch's distinct
chunks are looked at once. Chunks of signs whose kind is the same in all versions of Unicode are cut into words, of which
a worker remembers the ids of a bounded number and has the tokenizer's model encode the others; other chunks go to the
whole tokenizer as they are. Strings of special tokens in a text are ordinary text.

Defined results: a null or empty text has the end id alone. Rows with a null id come first. Rows of equal id are in the
order of the hash of their texts; repeated rows each have tokens of their own. Extra columns are not read, unless
``meta_cols`` names them, and then cannot clash. An empty table gives files without rows. A text, and its ids, are in
memory at once.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from array import array
from collections.abc import Iterator, Sequence

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.llm import pretokens
from sluice.llm.base import bounded_batches, map_texts, pieces
from sluice.session import ship_path

TOKENIZER = "byte_bpe_50k.json"
END_ID = 2
#: Bytes of text that are handled at a time, and chunks whose ids are brought together at a time.
PIECE_BYTES, GATHERED = 4 << 20, 1 << 18
#: Words after which a worker starts to remember anew, and their bytes.
MOST_WORDS, MOST_BYTES = 800_000, 24 << 20
ROW_GROUP_BYTES, PAGE_BYTES, PAGE_ROWS = 32 << 20, 128 << 10, 1000
ENCODINGS = ("dictionary", "delta")


#: Without a space before what is white space by some version of Unicode, a text can be cut before each space; else before one
#: between two characters that are white space by none.
_RUN = re.compile(r" (?:[\s\x00-\x20\u180e\u200b]|\Z)")
_CUT = re.compile(r"(?<=[^\s\x00-\x20\u180e\u200b]) (?=[^\s\x00-\x20\u180e\u200b])")
#: Chunks of characters that are letters, digits, white space or other signs in every version of Unicode.
_PLAIN = r"\A[\t\n\r!-~\x{a1}-\x{24f}\x{2010}-\x{2027}]*\z"


def byte_level() -> dict[int, str]:
    """The character that stands for each byte in a byte-level vocabulary: visible Latin-1 for itself, others from 256 on."""
    out, more = {}, 256
    for byte in range(256):
        visible = 33 <= byte <= 126 or 161 <= byte <= 172 or 174 <= byte <= 255
        out[byte] = chr(byte if visible else more)
        more += not visible
    return out


def _gathered(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> bytes:
    """The runs of ``flat`` one after the other, made in blocks."""
    out = []
    for at in range(0, len(starts), GATHERED):
        size = sizes[at : at + GATHERED]
        first = np.cumsum(size) - size
        out.append(flat[np.arange(size.sum()) + np.repeat(starts[at : at + GATHERED] - first, size)].tobytes())
    return b"".join(out)


class ChunkEncoder:
    """Packed ids (little-endian, 32 bits) of texts by the tokenizers library, which sees each remembered word once."""

    def __init__(self, definition: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has a task for each core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_buffer(definition)
        self.tokenizer.encode_special_tokens = True
        stated = json.loads(definition)
        step = stated.get("pre_tokenizer") or {}
        # only the byte-level pattern lets texts be cut
        self.cuts = step.get("type") == "ByteLevel" and step.get("use_regex", True) and not step.get("add_prefix_space") and not stated.get("normalizer")
        self._model, self._map = self.tokenizer.model, byte_level()
        self._forget()

    def _forget(self) -> None:
        # the place of each word, where its ids end, whether it begins with a space, and all ids
        self.words: dict[str, int] = {}
        self._ends, self._spaced, self._store, self._nbytes = array("q"), array("b"), array("I"), 0

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def _learn(self, words: list[str]) -> None:
        """Remember the ids of new words."""
        tokenize, ends, store = self._model.tokenize, self._ends, self._store
        self._spaced.extend([w[0] == " " for w in words])
        self.words.update(zip(words, range(len(ends), len(ends) + len(words)), strict=True))
        for word in words:
            # of visible ASCII, only a space has another character
            stands = word.replace(" ", self._map[32]) if word.isascii() and word.isprintable() else word.encode().decode("latin-1").translate(self._map)
            store.extend([t.id for t in tokenize(stands)])
            ends.append(len(store))
        self._nbytes += sum(map(len, words))

    def _chunk_ids(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(all ids, start, size) of distinct chunks and the space before each."""
        plain = pc.match_substring_regex(chunks, _PLAIN)
        starts, sizes = np.zeros(len(chunks), np.int64), np.zeros(len(chunks), np.int64)
        flat = b""
        easy = chunks.filter(plain)
        if len(easy):
            # a plain chunk has no space, so each word that begins with one begins a chunk
            words = pretokens.split(" " + pc.binary_join(pa.ListArray.from_arrays([0, len(easy)], easy), " ")[0].as_py())
            place = list(map(self.words.get, words))
            if None in place:
                self._learn(list(dict.fromkeys(w for w, p in zip(words, place, strict=True) if p is None)))
                place = list(map(self.words.__getitem__, words))
            place = np.array(place, np.int64)
            ends = np.frombuffer(self._ends, np.int64)
            first = np.where(place > 0, ends[place - 1], 0)
            size = ends[place] - first
            begins = np.flatnonzero(np.frombuffer(self._spaced, np.int8)[place])
            flat = _gathered(np.frombuffer(self._store, "<u4"), first, size)
            sizes[plain.to_numpy(zero_copy_only=False)] = np.add.reduceat(size, begins)
        odd = np.flatnonzero(~plain.to_numpy(zero_copy_only=False))
        more = self._ids([" " + c for c in chunks.take(pa.array(odd)).to_pylist()])
        at = len(flat) // 4
        mask = np.ones(len(chunks), bool)
        mask[odd] = False
        starts[mask] = np.cumsum(sizes[mask]) - sizes[mask]
        sizes[odd] = [len(m) // 4 for m in more]
        starts[odd] = at + np.cumsum(sizes[odd]) - sizes[odd]
        return np.frombuffer(flat + b"".join(more), "<u4"), starts, sizes

    def _joined(self, firsts: list[str], chunks: pa.Array, counts: np.ndarray, lasts: list[str]) -> list[bytes]:
        """Packed ids of texts of a first part, so many chunks and a last part."""
        coded = chunks.dictionary_encode()
        flat, starts, sizes = self._chunk_ids(coded.dictionary)
        index = coded.indices.to_numpy()
        packed = _gathered(flat, starts[index], sizes[index])
        cuts = 4 * np.concatenate([[0], np.cumsum(sizes[index])])[np.concatenate([[0], np.cumsum(counts)])]
        parts = [*firsts, *lasts]
        distinct = list(dict.fromkeys(parts))
        edge = dict(zip(distinct, self._ids(distinct), strict=True))
        return [edge[a] + packed[i:j] + edge[b] for a, b, i, j in zip(firsts, lasts, cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Packed ids of each text."""
        if not self.cuts:
            return self._ids(texts)
        if len(self.words) > MOST_WORDS or self._nbytes > MOST_BYTES:
            self._forget()
        out: list[bytes] = [b""] * len(texts)
        runs = [_RUN.search(t) is not None for t in texts]
        simple, others = [i for i, r in enumerate(runs) if not r], [i for i, r in enumerate(runs) if r]
        if simple:
            cut = pc.split_pattern(pa.array([texts[i] for i in simple], pa.string()), " ")
            offsets = np.asarray(cut.offsets, np.int64)
            rest = np.ones(len(cut.values), bool)
            rest[offsets[:-1]] = False
            firsts = cut.values.take(pa.array(offsets[:-1])).to_pylist()
            for i, ids in zip(simple, self._joined(firsts, cut.values.filter(pa.array(rest)), np.diff(offsets) - 1, [""] * len(simple)), strict=True):
                out[i] = ids
        if others:
            cut = [_CUT.split(texts[i]) for i in others]
            lasts = [" " + c.pop() if len(c) > 1 else "" for c in cut]
            chunks = pa.array([x for c in cut for x in c[1:]], pa.string())
            for i, ids in zip(others, self._joined([c[0] for c in cut], chunks, np.array([len(c) - 1 for c in cut]), lasts), strict=True):
                out[i] = ids
        return out


_ENCODERS: dict[int, ChunkEncoder] = {}


def encoder_of(definition: bytes) -> ChunkEncoder:
    """One encoder for each tokenizer in a worker's process."""
    key = hash(definition)
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = ChunkEncoder(definition)
    return _ENCODERS[key]


def write_token_files(
    docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", tokenizer_path: str | None = None, end_id: int | None = END_ID, meta_cols: Sequence[str] = (),
    encoding: str = "dictionary", shards: int | None = None, row_group_bytes: int = ROW_GROUP_BYTES, page_bytes: int = PAGE_BYTES, page_rows: int = PAGE_ROWS,
) -> None:
    """Encode all texts and write them below ``path``, which must not exist. ``shards``: files, else as Spark deals a shuffle."""
    if encoding not in ENCODINGS:
        raise ValueError(f"encoding must be one of {ENCODINGS}")
    spark = docs.sparkSession
    bounded_batches(spark)
    with open(tokenizer_path or public_tokenizers.path(TOKENIZER), "rb") as f:
        sent = spark.sparkContext.broadcast(f.read())  # a few MB, whatever the data
    end = b"" if end_id is None else int(end_id).to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, context, start = encoder_of(sent.value), TaskContext.get(), 0
        part = context.partitionId() if context else 0
        for batch in pieces(batches, "text", PIECE_BYTES):
            packed = [ids + end for ids in encoder.encode([t or "" for t in batch.column("text").to_pylist()])]
            sizes = np.array([len(p) // 4 for p in packed], np.int64)
            ends = np.cumsum(sizes)
            columns = {
                "part": pa.array(np.full(len(packed), part, np.int32)),
                "id": batch.column("id"),
                "start": pa.array(start + ends - sizes),
                "n_tokens": pa.array(sizes),
                "ids": pa.ListArray.from_arrays(np.concatenate([[0], ends]).astype(np.int32), np.frombuffer(b"".join(packed), "<i4")),
            }
            start += int(ends[-1]) if len(ends) else 0
            yield pa.RecordBatch.from_pydict(columns | {k: batch.column(k) for k in batch.schema.names if k == "meta"})

    meta = {"meta": F.struct(*meta_cols)} if meta_cols else {}
    kind = {f.name: f.dataType.simpleString() for f in docs.select(F.col(id_col).alias("id"), *(c.alias(k) for k, c in meta.items())).schema}
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), *(c.alias(k) for k, c in meta.items()))
    rows = rows.withColumn("h", F.xxhash64("text")).withColumn("k", F.monotonically_increasing_id())
    order = [F.col("id").asc_nulls_first(), F.col("h"), F.col("k")]
    dealt = (rows.repartitionByRange(shards, *order) if shards else rows.repartitionByRange(*order)).sortWithinPartitions(*order)
    schema = f"part int, id {kind['id']}, start long, n_tokens long, ids array<int>" + (f", meta {kind['meta']}" if meta else "")
    tokens = map_texts(dealt, run, schema, id=F.col("id"), text=F.col("text"), **{k: F.col(k) for k in meta})
    options = {
        "compression": "snappy", "parquet.writer.version": "v2", "parquet.enable.dictionary": "false", "parquet.enable.dictionary#ids.list.element": str(encoding == "dictionary").lower(),
        "parquet.block.size": row_group_bytes, "parquet.page.size": page_bytes, "parquet.page.row.count.limit": page_rows, "parquet.page.size.row.check.min": 10,
    }
    tokens.write.options(**options).parquet(f"{path}/tokens")
    _write_shards(spark, path)


def _write_shards(spark: SparkSession, path: str) -> None:
    counted = spark.read.parquet(f"{path}/tokens").groupBy("part").agg(F.count("*").alias("n_rows"), F.sum("n_tokens").alias("n_tokens")).collect()
    rows, base = [], 0
    for r in sorted(counted, key=lambda r: r.part):
        rows.append((r.part, r.n_rows, r.n_tokens, base))
        base += r.n_tokens
    spark.createDataFrame(rows, "part int, n_rows long, n_tokens long, base long").coalesce(1).write.parquet(f"{path}/shards")


def read_shards(spark: SparkSession, path: str) -> DataFrame:
    """part, n_rows, n_tokens and base of each file."""
    return spark.read.parquet(f"{path}/shards")


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """id, start (tokens of all rows before it), n_tokens, ids and meta of each row; columns not selected are not read.

    Filters on ``id`` reach the scan, which skips row groups and pages by their indexes.
    """
    tokens = spark.read.parquet(f"{path}/tokens")
    bases = F.broadcast(read_shards(spark, path).select(F.col("part"), F.col("base")))  # a row for each file
    meta = [c for c in tokens.columns if c == "meta"]
    return tokens.join(bases, "part").select("id", (F.col("base") + F.col("start")).alias("start"), "n_tokens", "ids", *meta)


def read_positions(spark: SparkSession, path: str, first: int, last: int) -> DataFrame:
    """id, start and ids of what lies at positions ``first`` (included) to ``last`` (excluded) of all tokens.

    Only files that overlap are opened, in them only pages that may.
    """
    parts = [r for r in read_shards(spark, path).filter((F.col("base") < last) & (F.col("base") + F.col("n_tokens") > first)).collect()]
    tokens = spark.read.parquet(f"{path}/tokens")
    # a condition for each file that overlaps: the inner ones whole, starts in the outer ones below ``last``
    wanted = F.lit(False)
    inner = [r.part for r in parts if r.base >= first and r.base + r.n_tokens <= last]
    if inner:
        wanted = wanted | F.col("part").isin(inner)
    for r in parts:
        if r.part not in inner:
            wanted = wanted | ((F.col("part") == r.part) & (F.col("start") < last - r.base) & (F.col("start") + F.col("n_tokens") > first - r.base))
    bases = F.broadcast(read_shards(spark, path).select("part", "base"))
    found = tokens.filter(F.col("part").isin([r.part for r in parts])).filter(wanted).join(bases, "part").withColumn("at", F.col("base") + F.col("start"))
    skip = F.greatest(F.lit(first) - F.col("at"), F.lit(0)).cast("int")
    upto = F.least(F.lit(last) - F.col("at"), F.col("n_tokens")).cast("int")
    return found.select("id", (F.col("at") + skip).alias("start"), F.slice("ids", skip + 1, upto - skip).alias("ids"))


def checksums(tokens: DataFrame) -> DataFrame:
    """id, start, n_tokens and ids_crc32 of rows from ``read_token_files``: the crc32 of the ids as little-endian unsigned 32-bit integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("ids")
            data = ids.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False).view(np.uint8)
            ends = np.asarray(ids.offsets, np.int64) * 4
            crc = [zlib.crc32(data[a:b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
            columns = {k: batch.column(k) for k in ("id", "start", "n_tokens")}
            yield pa.RecordBatch.from_pydict(columns | {"ids_crc32": pa.array(crc, pa.int64())})

    ship_path(tokens.sparkSession)
    bounded_batches(tokens.sparkSession)
    kind = tokens.schema["id"].dataType.simpleString()
    return tokens.select("id", "start", "n_tokens", "ids").mapInArrow(run, f"id {kind}, start long, n_tokens long, ids_crc32 long")
