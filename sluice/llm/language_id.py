"""Language identification by compression with per-language dictionaries (operator 8).

For each language, pieces of labelled texts are joined to a raw-content dictionary of zstandard. A text is
lower-cased, all that is no letter or mark of one becomes one space, and it is encoded with each dictionary, in chunks so
that long texts keep using it; a short text is repeated, since zstandard stores a few bytes as they are.
The language whose sizes sum to the least wins. The score is the relative margin to the second best, ``1 - best / second``; a text whose
score is below ``min_margin`` is rejected, as is one without letters.

Learning: labelled rows whose crc32(id as text) mod 5 is not 0. One piece of at most PIECE_CHARS characters
comes from each of SLOTS hash slots of each language, so a dictionary has a bounded size; the choice is a
grouped minimum with partial aggregation over all such rows. Language, source and id of a text are no
inputs of its prediction.

Defined results: null texts and texts without a letter are ``und`` with score 0 and rejected; equal sizes go
to the language that sorts first, with score 0. Without any labelled row every text is ``und``.
With one language, the second size is that without a dictionary.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import regex
import zstandard
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.llm.base import bounded_batches, crc_mod5, map_texts, pieces

SLOTS, PIECE_CHARS = 96, 1300
CHUNK_BYTES = 2048
#: Texts of fewer bytes are repeated up to this size.
LEAST_BYTES = 400
LEVEL, MIN_MATCH = 5, 3
MIN_MARGIN = 0.005
BATCH_TEXT = 1 << 20
#: Vowel signs and accents that follow a letter are part of a word; numerals, even those that look like letters, are not.
_NO_LETTERS, _LETTER = regex.compile(r"[^\p{L}\p{M}]+"), regex.compile(r"\p{L}")
_PLAIN = bytes(c if c in b"abcdefghijklmnopqrstuvwxyz" else 32 for c in bytes(range(128)).lower()) + bytes(128)


def letters(text: str) -> str:
    """The text's words in lower case, without anything but letters and their marks; empty if it has no letter."""
    if text.isascii():
        return b" ".join(text.encode().translate(_PLAIN).split()).decode()
    return _NO_LETTERS.sub(" ", text).strip().lower() if _LETTER.search(text) else ""


def learn_dictionaries(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> dict[str, bytes]:
    """Dictionary bytes by language; collected size is at most SLOTS * PIECE_CHARS characters a language."""
    key = F.xxhash64(F.col(id_col).cast("string"))
    middle = F.greatest(F.lit(1), ((F.length("text") - PIECE_CHARS) / 2).cast("int"))
    rows = (
        docs.filter(F.col(lang_col).isNotNull() & F.col(text_col).rlike("\\p{L}") & (crc_mod5(F.col(id_col)) != 0))
        .select(F.col(lang_col).cast("string").alias("lang"), key.alias("key"), F.col(text_col).alias("text"))
        .select("lang", "key", F.substring("text", middle, F.lit(PIECE_CHARS)).alias("piece"))
        .groupBy("lang", F.pmod("key", F.lit(SLOTS)).alias("slot"))
        .agg(F.min_by("piece", F.struct("key", "piece")).alias("piece"))
    )
    out: dict[str, list[tuple[int, str]]] = {}
    for r in rows.collect():
        out.setdefault(r.lang, []).append((r.slot, r.piece))
    return {lang: "\n".join(letters(p) for _, p in sorted(out[lang])).encode() for lang in sorted(out)}


class CompressionClassifier:
    """Chooses the dictionary with which a text becomes smallest."""

    def __init__(self, dictionaries: dict[str, bytes]):
        self.langs = sorted(dictionaries)
        self._encoders = []
        for lang in self.langs:
            raw = zstandard.ZstdCompressionDict(dictionaries[lang], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            settings = zstandard.ZstdCompressionParameters.from_level(LEVEL, source_size=CHUNK_BYTES, dict_size=len(dictionaries[lang]), min_match=MIN_MATCH, write_content_size=False)
            raw.precompute_compress(compression_params=settings)
            self._encoders.append(zstandard.ZstdCompressor(dict_data=raw, compression_params=settings))
        self._plain = zstandard.ZstdCompressor(level=LEVEL, write_content_size=False)

    def predict(self, text: str | None) -> tuple[str, float]:
        data = letters(text or "").encode()
        if not data or not self.langs:
            return "und", 0.0
        data *= max(1, -(-LEAST_BYTES // len(data)))
        chunks = [data[i : i + CHUNK_BYTES] for i in range(0, len(data), CHUNK_BYTES)]
        sizes = [sum(len(e.compress(c)) for c in chunks) for e in self._encoders]
        best = min(sizes)
        at = sizes.index(best)
        others = sizes[:at] + sizes[at + 1 :] or [max(best, sum(len(self._plain.compress(c)) for c in chunks))]
        return self.langs[at], 1 - best / min(others)


_MODELS: dict[str, CompressionClassifier] = {}


def _sent(docs: DataFrame, dictionaries: dict[str, bytes]) -> Broadcast[tuple[str, dict[str, bytes]]]:
    """The dictionaries with a name of their content."""
    name = hashlib.sha256(repr(sorted(dictionaries.items())).encode()).hexdigest()
    return docs.sparkSession.sparkContext.broadcast((name, dictionaries))


def _model(sent: Broadcast[tuple[str, dict[str, bytes]]]) -> CompressionClassifier:
    """One classifier for each content in a worker's process."""
    name, dictionaries = sent.value
    if name not in _MODELS:
        _MODELS.clear()
        _MODELS[name] = CompressionClassifier(dictionaries)
    return _MODELS[name]


def predict_languages(docs: DataFrame, dictionaries: dict[str, bytes], id_col: str = "doc_id", text_col: str = "text", min_margin: float = MIN_MARGIN) -> DataFrame:
    """id, lang_pred, score, rejected of each whole text; no shuffle."""
    sent = _sent(docs, dictionaries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(sent)
        for batch in pieces(batches, "text", BATCH_TEXT):
            found = [model.predict(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_pydict({
                "id": batch.column("id"), "lang_pred": pa.array([x for x, _ in found], pa.string()), "score": pa.array([x for _, x in found], pa.float64()),
                "rejected": pa.array([x == "und" or s < min_margin for x, s in found], pa.bool_()),
            })

    kind = docs.schema[id_col].dataType.simpleString()
    return map_texts(docs, run, f"id {kind}, lang_pred string, score double, rejected boolean", id=F.col(id_col), text=F.col(text_col)).withColumnRenamed("id", id_col)


def keep_identified(docs: DataFrame, dictionaries: dict[str, bytes], text_col: str = "text", min_margin: float = MIN_MARGIN) -> DataFrame:
    """The documents, with all their columns, that are not rejected; no shuffle."""
    bounded_batches(docs.sparkSession)
    sent = _sent(docs, dictionaries)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(sent)
        for batch in batches:
            found = [model.predict(t.as_py()) for t in batch.column(at)]
            yield batch.filter(pa.array([x != "und" and s >= min_margin for x, s in found], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
