import base64
import hashlib
import random

import numpy as np
import public_tokenizers as P
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from sluice.llm.bpe import BytePairCodec, decode_ids, encode_documents

RANKS = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
PLAIN = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=RANKS, special_tokens={})
CODEC = BytePairCodec(RANKS)


def ids(text):
    return np.frombuffer(CODEC.encode(text), "<u4").tolist()


@settings(max_examples=400, deadline=None)
@given(st.text(max_size=60))
def test_any_text(text):
    assert ids(text) == PLAIN.encode_ordinary(text)
    assert CODEC.decode(CODEC.encode(text)) == text.encode()


def test_random_letters_and_long_runs():
    rng = random.Random(1)
    for alphabet in ("ab", "etaoin", "abcdefghijklmnopqrstuvwxyz", "éèàüßñ", "0123456789", "!?.,-*#", " \n\t  \u0085᠎\u001c\u001f​"):
        for _ in range(200):
            text = "".join(rng.choices(alphabet, k=rng.randint(1, 80)))
            assert ids(text) == PLAIN.encode_ordinary(text), repr(text)
    for text in ("a" * 5000, "ab" * 3000, " " * 3000 + "x", "\n" * 999, "é" * 2000, "the" * 2000, "<|endoftext|>"):
        assert ids(text) == PLAIN.encode_ordinary(text)


def test_edge_rows(spark):
    rows = [(1, "It's fine.", 7), (2, None, 7), (3, "", 7), (3, "", 7), (None, "x" * 200_000, 7)]
    got = encode_documents(spark.createDataFrame(rows, "doc_id long, text string, ids int"))
    found = {(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got.collect()}
    assert got.count() == 5
    for i, text, _ in rows:
        want = PLAIN.encode_ordinary(text or "")
        assert (i, len(want), hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()) in found
    back = {r.doc_id: bytes(r.data) for r in decode_ids(got).collect()}
    assert back[1] == b"It's fine." and back[2] == b""
    assert encode_documents(spark.createDataFrame([], "doc_id long, text string")).count() == 0
