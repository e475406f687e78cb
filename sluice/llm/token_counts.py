"""Unigram token counts by dynamic programming over a trie of distinct pre-tokens (operator 9).

The model: a probability for every token of a byte-level vocabulary. A pre-token's segmentation has the largest
sum of log-probabilities; of equal sums the one whose last token is the longest, then likewise before it. The
vocabulary holds every byte, so each pre-token has one.

Learning: one step of expectation-maximisation in its hard form. Under starting scores, -ln(rank + 2.7), a Zipf
law over the vocabulary's ranks, all pre-tokens of all documents are segmented; the probability of a token is its
share of the tokens found, with one added to each count. Tasks count their pre-tokens, the counts of each distinct
one are added up, and it is segmented once; one row for each token of the vocabulary reaches the driver, whatever
the number of documents. The vocabulary itself stays as it is.

Distinct pre-tokens are the leaves of a trie, which is walked depth first in the order of their bytes: between two
neighbours in that order the walk goes back to their common prefix. It keeps, for each byte on the path, the best
score, the count of tokens and the size of the last token up to there, so a shared prefix is scored once, and no
more of the trie is held than the path to one leaf. A leaf stores its count, which a worker remembers for a bounded
number of pre-tokens. A text's count is the sum over its pre-tokens.

Defined results: null or empty texts have no pre-tokens and no tokens; repeated rows each give a row. Without
any text all tokens are equally likely.
"""

from __future__ import annotations

import math
from array import array
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.llm import pretokens
from sluice.llm.base import map_texts, pieces

PIECE_BYTES = 1 << 20
#: Offset of the Zipf law of the starting scores.
ZIPF_OFFSET = 2.7
#: Distinct chunks that a learning task adds up before it passes them on, and bytes of the texts that they come from.
COUNTED_CHUNKS, COUNTED_BYTES = 400_000, 64 << 20
#: Pre-tokens and chunks whose counts a worker remembers (each a short text and a small number), and the bytes of these texts.
KNOWN_PIECES, KNOWN_CHUNKS, KNOWN_BYTES = 1_000_000, 500_000, 32 << 20
#: Counts of pre-tokens and of tokens are one number, the former in the upper bits.
_TOKENS = 40


def zipf_scores(ranks: dict[bytes, int]) -> dict[bytes, float]:
    """The starting scores."""
    return {token: -math.log(rank + ZIPF_OFFSET) for token, rank in ranks.items()}


class UnigramTrie:
    """Segmentations of pre-tokens under the scores of a vocabulary."""

    def __init__(self, scores: dict[bytes, float]):
        self.scores = scores
        # sizes, the largest first, of the tokens that may end where given bytes do
        sizes: dict[bytes, set[int]] = {}
        for token in scores:
            for n in range(1, min(len(token), 3) + 1):
                if len(token) == n or n == 3:
                    sizes.setdefault(token[-n:], set()).add(len(token))
        down = lambda *found: tuple(sorted(set().union(*found), reverse=True))
        none: set[int] = set()
        self._one = {t: tuple(x) for t, x in sizes.items() if len(t) == 1}
        self._two = {t: down(x, sizes.get(t[1:], none)) for t, x in sizes.items() if len(t) == 2}
        self._three = {t: down(x, sizes.get(t[1:], none), sizes.get(t[2:], none)) for t, x in sizes.items() if len(t) == 3}
        self._pieces: dict[str, int] = {}
        self._chunks: dict[str, int] = {}
        self._nbytes = 0

    def walk(self, words: Iterable[bytes]) -> Iterator[tuple[array, array]]:
        """For each of the words, which come in order: for each of its prefixes, count of tokens and size of the last one."""
        scores, one, two, three = self.scores.get, self._one, self._two, self._three.get
        best, count, last = array("d", [0.0]), array("l", [0]), array("l", [0])
        before = b""
        for word in words:
            shared, most = 0, min(len(before), len(word))
            while shared < most and before[shared] == word[shared]:
                shared += 1
            del best[shared + 1 :], count[shared + 1 :], last[shared + 1 :]
            for end in range(shared + 1, len(word) + 1):
                sizes = three(word[end - 3 : end]) if end > 2 else None
                if sizes is None:
                    sizes = two.get(word[end - 2 : end]) if end > 1 else None
                    if sizes is None:
                        sizes = one[word[end - 1 : end]]
                top = -math.inf
                for n in sizes:
                    if n <= end:
                        score = scores(word[end - n : end])
                        if score is not None:
                            score += best[end - n]
                            if score > top:
                                top, width = score, n
                best.append(top)
                count.append(count[end - width] + 1)
                last.append(width)
            before = word
            yield count, last

    def _remember(self, parts: Iterable[str]) -> dict[str, int]:
        """Pre-tokens and tokens of parts; those of new pre-tokens come from the trie."""
        cut = {p: pretokens.split(p) for p in parts}
        new = sorted((w.encode(), w) for w in {w for words in cut.values() for w in words}.difference(self._pieces))
        for (data, w), (count, _) in zip(new, self.walk(data for data, _ in new), strict=True):
            self._pieces[w] = count[-1]
            self._nbytes += len(data)
        return {p: len(words) << _TOKENS | sum(map(self._pieces.__getitem__, words)) for p, words in cut.items()}

    def counts(self, texts: list[str | None]) -> list[tuple[int, int]]:
        """(pre-tokens, tokens) of each text."""
        # what is remembered may go only between batches
        if len(self._pieces) > KNOWN_PIECES or self._nbytes > KNOWN_BYTES:
            self._pieces, self._chunks, self._nbytes = {}, {}, 0
        elif len(self._chunks) > KNOWN_CHUNKS:
            self._chunks = {}
        cut = [pretokens.chunks(t or "") for t in texts]
        new = set().union(*(others for _, others in cut)).difference(self._chunks)
        for p, n in self._remember(" " + p for p in new).items():
            self._chunks[p[1:]] = n
            self._nbytes += len(p)
        whole = self._remember({p for parts, _ in cut for p in parts})
        totals = [sum(map(self._chunks.__getitem__, others)) + sum(map(whole.__getitem__, parts)) for parts, others in cut]
        return [(n >> _TOKENS, n & (1 << _TOKENS) - 1) for n in totals]


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct pre-tokens of a task's texts with their counts; one may come several times."""
    held: Counter[str] = Counter()
    nbytes = 0

    def flush() -> pa.RecordBatch:
        words: Counter[str] = Counter()
        for part, n in held.items():
            for w in pretokens.split(part):
                words[w] += n
        held.clear()
        return pa.RecordBatch.from_pydict({"word": pa.array(list(words), pa.string()), "n": pa.array(list(words.values()), pa.int64())})

    for batch in pieces(batches, "text", PIECE_BYTES):
        for text in batch.column("text").to_pylist():
            whole, others = pretokens.chunks(text or "")
            for part in whole:
                held.update(pretokens.split(part))
            held.update([" " + p for p in others])
        nbytes += batch.nbytes
        if len(held) > COUNTED_CHUNKS or nbytes > COUNTED_BYTES:
            yield flush()
            nbytes = 0
    yield flush()


def learn_scores(docs: DataFrame, data: Broadcast[bytes], text_col: str = "text") -> np.ndarray:
    """Log-probability of each token in the order of ranks, from all documents."""

    def segment(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = pretokens.read_ranks(data.value)
        total: Counter[bytes] = Counter()
        read: list[tuple[bytes, int]] = []

        def sorted_words() -> Iterator[bytes]:
            for batch in batches:
                for w, n in zip(batch.column("word").to_pylist(), batch.column("n").to_pylist(), strict=True):
                    read[:] = [(w.encode(), n)]
                    yield read[0][0]

        for _, last in UnigramTrie(zipf_scores(ranks)).walk(sorted_words()):
            word, n = read[0]
            end = len(word)
            while end:
                total[word[end - last[end] : end]] += n
                end -= last[end]
        yield pa.RecordBatch.from_pydict({"rank": pa.array([ranks[t] for t in total], pa.int64()), "n": pa.array(list(total.values()), pa.int64())})

    words = map_texts(docs, _words, "word string, n long", text=F.col(text_col)).groupBy("word").agg(F.sum("n").alias("n")).sortWithinPartitions("word")
    rows = words.mapInArrow(segment, "rank long, n long").groupBy("rank").agg(F.sum("n").alias("n")).toArrow()
    counts = np.ones(1 + max(pretokens.read_ranks(data.value).values()))
    counts[rows.column("rank").to_numpy()] += rows.column("n").to_numpy()
    return np.log(counts / counts.sum())


_TRIES: dict[int, UnigramTrie] = {}


def count_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary_path: str | None = None, scores: np.ndarray | None = None) -> DataFrame:
    """id, n_pretokens and n_tokens of each whole text, under ``scores`` or those learned from the documents."""
    data = pretokens.vocabulary(docs.sparkSession, vocabulary_path)
    learned = learn_scores(docs, data, text_col) if scores is None else scores
    sent = docs.sparkSession.sparkContext.broadcast(learned)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = hash((data.value, sent.value.tobytes()))
        if key not in _TRIES:
            _TRIES.clear()
            _TRIES[key] = UnigramTrie({token: float(sent.value[rank]) for token, rank in pretokens.read_ranks(data.value).items()})
        for batch in pieces(batches, "text", PIECE_BYTES):
            found = _TRIES[key].counts(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_pydict({"id": batch.column("id"), "n_pretokens": pa.array([x for x, _ in found], pa.int64()), "n_tokens": pa.array([x for _, x in found], pa.int64())})

    kind = docs.schema[id_col].dataType.simpleString()
    return map_texts(docs, run, f"id {kind}, n_pretokens long, n_tokens long", id=F.col(id_col), text=F.col(text_col)).withColumnRenamed("id", id_col)
