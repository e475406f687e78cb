"""Byte-level BPE encoding and decoding by longest matches with backtracking (operator 10).

A sequence of tokens is the BPE encoding of its bytes exactly if each adjacent pair is compatible:
merging the bytes of both never joins across their border. The encoder takes the longest token at each
position, goes to shorter ones while the pair is not compatible, and steps back when none is left.
Positions from which no encoding goes on are marked, so each is left at most once and the time is linear.

Defined results: a null or empty text has no ids; the digests are those of empty bytes. Repeated rows and
ids each give a row. Memory: a batch of texts, and remembered results for a bounded number of pre-tokens.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.llm import pretokens
from sluice.llm.base import map_texts, pieces

_NEVER = 1 << 60
#: Bytes of text that are handled at a time.
PIECE_BYTES = 512 << 10
#: Ids that are decoded at a time.
DECODED = 1 << 16
#: Remembered pairs of adjacent tokens; beyond, they start anew.
MOST_PAIRS = 400_000


class BytePairCodec:
    """Encoder and decoder for one vocabulary of ranks."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = {rank: token for token, rank in ranks.items()}
        self._sizes = {rank: len(token) for token, rank in ranks.items()}
        order = sorted(self.tokens)
        # all tokens' bytes in one array, and where those of each rank begin and end in it
        self._bytes = np.frombuffer(b"".join(map(self.tokens.__getitem__, order)), np.uint8)
        self._ends = np.zeros(order[-1] + 2, np.int64)
        self._ends[np.array(order) + 1] = [len(self.tokens[r]) for r in order]
        self._ends = np.cumsum(self._ends)
        self._halves: dict[int, tuple[int, int] | None] = {}
        self._compatible: dict[int, bool] = {}
        self._shorter: dict[int, int] = {}
        self._pieces, self._chunks = pretokens.Memo(pretokens.MEMO_ENTRIES), pretokens.Memo(pretokens.MEMO_CHUNKS)
        self._matcher = ahocorasick.Automaton()
        for token, rank in ranks.items():
            self._matcher.add_word(token.decode("latin-1"), rank)
        self._matcher.make_automaton()

    def halves(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes this one; None for a single byte.

        For a token that merging never makes (its bytes end as other tokens), (-1, -1).
        """
        if token not in self._halves:
            data = self.tokens[token]
            self._halves[token] = None if len(data) == 1 else self._merged_below(data, token)
        return self._halves[token]

    def _merged_below(self, data: bytes, own: int) -> tuple[int, int]:
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 2:
            best = min(range(len(parts) - 1), key=lambda i: self.ranks.get(parts[i] + parts[i + 1], _NEVER))
            if self.ranks.get(parts[best] + parts[best + 1], _NEVER) == _NEVER:
                return -1, -1
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        a, b = (self.ranks.get(p, -1) for p in parts)
        return (a, b) if a >= 0 and b >= 0 else (-1, -1)

    def _border(self, token: int, right: bool) -> list[tuple[int, int, int]]:
        """(token, rank at which it forms, rank at which it is absorbed) of the nested parts at one end."""
        out, until = [], _NEVER
        while True:
            parts = self.halves(token)
            out.append((token, -1 if parts is None else token, until))
            if parts is None:
                return out
            token, until = parts[1 if right else 0], token

    def compatible(self, a: int, b: int) -> bool:
        """Whether both are tokens that merging makes, and merging their bytes keeps the border between them."""
        key = a << 32 | b
        known = self._compatible.get(key)
        if known is None:
            if len(self._compatible) >= MOST_PAIRS:
                self._compatible.clear()
            known = self._compatible[key] = self.usable(a) and self.usable(b) and self._keeps_border(a, b)
        return known

    def _keeps_border(self, a: int, b: int) -> bool:
        left, right = self._border(a, True), self._border(b, False)
        for x, x_from, x_to in left:
            for y, y_from, y_to in right:
                if x_from < y_to and y_from < x_to:
                    joined = self.ranks.get(self.tokens[x] + self.tokens[y])
                    # of equal ranks the leftmost pair merges first
                    if joined is not None and joined < x_to and joined <= y_to:
                        return False
        return True

    def usable(self, token: int) -> bool:
        return self.halves(token) != (-1, -1)

    def shorter(self, token: int) -> int:
        """The longest token that is a proper prefix of this one, or -1."""
        if token not in self._shorter:
            data = self.tokens[token]
            self._shorter[token] = next((self.ranks[data[:n]] for n in range(len(data) - 1, 0, -1) if data[:n] in self.ranks), -1)
        return self._shorter[token]

    def encode_piece(self, data: bytes) -> list[int]:
        """Ids of one pre-token; one that is a token itself is that token."""
        if data in self.ranks:
            return [self.ranks[data]]
        text = data.decode("latin-1")
        # the longest match at each position, one after the other, of which more than a third of pre-tokens consist
        matches = self._matcher.iter_long(text)
        greedy = [rank for _, rank in matches]
        known, last = self._compatible.get, -1
        for i, token in enumerate(greedy):
            if last >= 0:
                fits = known(last << 32 | token)
                if not (self.compatible(last, token) if fits is None else fits):
                    return self._backtracked(text, greedy, i)
            last = token
        if sum(map(self._sizes.__getitem__, greedy)) != len(text) or not self.usable(greedy[0]):
            return self._backtracked(text, greedy, 0)
        return greedy

    def _backtracked(self, text: str, greedy: list[int], right: int) -> list[int]:
        """The encoding, given the longest matches one after the other, of which the first ``right`` fit together."""
        sizes, n = self._sizes, len(text)
        longest: dict[int, int] = {}
        at = start = 0
        for i, token in enumerate(greedy):
            if i == right:
                start = at
            longest[at] = token
            at += sizes[token]
        if at != n:  # a byte that is no token
            raise ValueError("the vocabulary has no encoding for these bytes")
        closed: set[int] = set()
        out = greedy[:right]
        known, shorter = self._compatible.get, self._shorter.get
        at, token, last = start, greedy[right], out[-1] if out else -1
        while at < n:
            while token >= 0:
                end = at + sizes[token]
                if end not in closed:
                    fits = known(last << 32 | token) if last >= 0 else self.usable(token)
                    if fits or (fits is None and self.compatible(last, token)):
                        break
                less = shorter(token)
                token = self.shorter(token) if less is None else less
            if token >= 0:
                out.append(token)
                at, last = end, token
                if at < n:
                    token = longest.get(at, -1)
                    if token < 0:
                        token = longest[at] = next(self._matcher.iter_long(text, at))[1]
            else:
                closed.add(at)
                if not out:
                    raise ValueError("the vocabulary has no encoding for these bytes")
                token = out.pop()
                at -= sizes[token]
                last = out[-1] if out else -1
                less = shorter(token)
                token = self.shorter(token) if less is None else less
        return out

    def _piece(self, piece: str) -> bytes:
        """Packed ids of one pre-token: little-endian unsigned 32-bit integers."""
        got = self._pieces.get(piece)
        if got is None:
            ids = self.encode_piece(piece.encode())
            got = struct.pack(f"<{len(ids)}I", *ids)
            self._pieces.keep(piece, got, len(got))
        return got

    def _part(self, part: str) -> bytes:
        """Packed ids of a part of a text, cut by the pattern."""
        return b"".join(map(self._piece, pretokens.split(part)))

    def _after_space(self, part: str) -> bytes:
        """Packed ids of a space and a part."""
        got = self._part(" " + part)
        self._chunks.keep(part, got, len(got))
        return got

    def encode(self, text: str) -> bytes:
        """Packed ids of a whole text."""
        whole, others = pretokens.chunks(text)
        out = list(map(self._part, whole))
        known = self._chunks.get
        for part in others:
            out.append(known(part) or self._after_space(part))
        return b"".join(out)

    def decode(self, packed: bytes) -> bytes:
        """The bytes of packed ids, from blocks of ids whose bytes' places are held at a time."""
        ids, out = np.frombuffer(packed, "<u4").astype(np.int64), []
        for at in range(0, len(ids), DECODED):
            part = ids[at : at + DECODED]
            start, size = self._ends[part], self._ends[part + 1] - self._ends[part]
            end = np.cumsum(size)
            out.append(self._bytes[np.arange(end[-1]) + np.repeat(start - end + size, size)].tobytes())
        return b"".join(out)


_CODECS: dict[int, BytePairCodec] = {}


def codec_of(data: bytes) -> BytePairCodec:
    """One codec for each vocabulary in a worker's process."""
    key = hash(data)
    if key not in _CODECS:
        _CODECS.clear()
        _CODECS[key] = BytePairCodec(pretokens.read_ranks(data))
    return _CODECS[key]


def encode_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary_path: str | None = None, keep_ids: bool = True) -> DataFrame:
    """Ids and decoded bytes of each text: id, n_tokens, digests, and ids as an array if ``keep_ids``."""
    data = pretokens.vocabulary(docs.sparkSession, vocabulary_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(data.value)
        for batch in pieces(batches, "text", PIECE_BYTES):
            n, ids_digest, bytes_digest, ids = [], [], [], []
            for text in batch.column("text").to_pylist():
                packed = codec.encode(text or "")
                n.append(len(packed) // 4)
                ids_digest.append(hashlib.sha256(packed).hexdigest())
                bytes_digest.append(hashlib.sha256(codec.decode(packed)).hexdigest())
                if keep_ids:
                    ids.append(np.frombuffer(packed, "<u4").astype("i4"))
            columns = {"id": batch.column("id"), "n_tokens": pa.array(n, pa.int64()), "ids_sha256": pa.array(ids_digest, pa.string()), "decoded_sha256": pa.array(bytes_digest, pa.string())}
            if keep_ids:
                columns["ids"] = pa.array(ids, pa.list_(pa.int32()))
            yield pa.RecordBatch.from_pydict(columns)

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * keep_ids
    return map_texts(docs, run, schema, id=F.col(id_col), text=F.col(text_col)).withColumnRenamed("id", id_col)


def decode_ids(df: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", vocabulary_path: str | None = None) -> DataFrame:
    """The bytes of each id array; a null array gives null."""
    data = pretokens.vocabulary(df.sparkSession, vocabulary_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(data.value)
        for batch in batches:
            out = [None if ids is None else b"".join(map(codec.tokens.__getitem__, ids)) for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_pydict({"id": batch.column("id"), "data": pa.array(out, pa.binary())})

    kind = df.schema[id_col].dataType.simpleString()
    return map_texts(df, run, f"id {kind}, data binary", id=F.col(id_col), ids=F.col(ids_col)).withColumnRenamed("id", id_col)
