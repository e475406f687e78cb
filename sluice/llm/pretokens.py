"""Vocabulary files of public tokenizers, read on the driver and sent once to each executor; texts as pre-tokens and chunks.

A match of the pattern never goes on from a character that is no white space over a space, and only a run of
white space looks at what follows it. So where no white space follows a space, and the text does not end with
one, a text may be cut before each space without changing the matches: a chunk is a space with what follows it
up to the next one. Chunks repeat much like words, and are cut out without the pattern, which then sees each
distinct chunk once. Other texts are cut by the pattern as a whole.
"""

from __future__ import annotations

import base64

import public_tokenizers
import regex
from pyspark import Broadcast
from pyspark.sql import SparkSession

#: Pre-token pattern of the byte-level vocabularies.
PATTERN = public_tokenizers.PATTERN
DEFAULT_VOCABULARY = "byte_bpe_50k.tiktoken"
#: Distinct pre-tokens whose result a worker remembers, distinct chunks, and the bytes of each; beyond, it starts anew. Longer ones are not remembered.
MEMO_ENTRIES, MEMO_CHUNKS, MEMO_BYTES, MEMO_CHARS = 500_000, 300_000, 16 << 20, 64
_SPLIT = regex.compile(PATTERN)
_SPACE_IN_RUN = regex.compile(r" (?:\s|\Z)")


def split(text: str) -> list[str]:
    """The pattern's matches, which cover the text."""
    return _SPLIT.findall(text)


def chunks(text: str) -> tuple[list[str], list[str]]:
    """(whole parts, parts that follow a space): cutting each of them by the pattern, a space put before the latter,
    gives the pattern's matches of the text in order."""
    if _SPACE_IN_RUN.search(text):
        return [text], []
    first, *others = text.split(" ")
    return [first], others


def read_ranks(data: bytes) -> dict[bytes, int]:
    """Ranks by token bytes from the lines of a vocabulary file."""
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, data.splitlines())}


def vocabulary(spark: SparkSession, path: str | None = None) -> Broadcast[bytes]:
    """The file's bytes as a broadcast: its size is that of the vocabulary (about 1 MB), whatever the data."""
    with open(path or public_tokenizers.path(DEFAULT_VOCABULARY), "rb") as f:
        return spark.sparkContext.broadcast(f.read())


class Memo(dict):
    """What a worker remembers of short strings: at most ``entries``, and at most MEMO_BYTES of keys and results."""

    def __init__(self, entries: int):
        super().__init__()
        self.entries, self.nbytes = entries, 0

    def keep(self, key: str, value: object, size: int) -> None:
        if len(key) <= MEMO_CHARS:
            if len(self) >= self.entries or self.nbytes > MEMO_BYTES:
                self.clear()
                self.nbytes = 0
            self[key] = value
            self.nbytes += len(key) + size
