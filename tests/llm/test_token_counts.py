import random
import tracemalloc
from collections import Counter

import numpy as np
import public_tokenizers as P

from sluice.llm import pretokens, token_counts
from sluice.llm.token_counts import UnigramTrie, count_tokens, learn_scores, zipf_scores

RANKS = pretokens.read_ranks(open(P.path("byte_bpe_50k.tiktoken"), "rb").read())
ZIPF = zipf_scores(RANKS)


def brute(word, scores):
    """Tokens of a pre-token's best segmentation, from all segmentations of all its prefixes."""
    data = word.encode()
    best = [(0.0, [])] + [None] * len(data)
    for j in range(1, len(data) + 1):
        for i in range(j):
            if data[i:j] in scores:
                s = best[i][0] + scores[data[i:j]]
                if best[j] is None or s > best[j][0]:
                    best[j] = (s, best[i][1] + [data[i:j]])
    return best[-1][1]


def learned(texts):
    """Scores from a count over all texts."""
    counts = Counter(t for x in texts for w in pretokens.split(x or "") for t in brute(w, ZIPF))
    n = np.array([counts[t] + 1 for t in sorted(RANKS, key=RANKS.get)], float)
    return dict(zip(sorted(RANKS, key=RANKS.get), np.log(n / n.sum()), strict=True))


def made():
    rng = random.Random(2)
    texts = [" ".join("".join(rng.choices("etaonihsré1!", k=rng.randint(1, 14))) for _ in range(40)) for _ in range(30)]
    return texts + [None, "", "a" * 900, texts[0], "\n\n  x", "a  b \n \n c ", " x", "tab\t y  ", "日本語の文章"]


def test_against_brute_force(spark):
    texts = made()
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    scores = learned(texts)
    assert np.allclose(learn_scores(df, pretokens.vocabulary(spark)), [scores[t] for t in sorted(RANKS, key=RANKS.get)], atol=1e-12)
    found = {r.doc_id: (r.n_pretokens, r.n_tokens) for r in count_tokens(df).collect()}
    for i, t in enumerate(texts):
        words = pretokens.split(t or "")
        assert found[i] == (len(words), sum(len(brute(w, scores)) for w in words))


def test_whole_table_and_empty(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert count_tokens(docs).count() == docs.count()
    assert count_tokens(docs.limit(0)).count() == 0


def test_memory_is_bounded():
    trie = UnigramTrie(ZIPF)
    trie._pieces.update({str(i): 1 for i in range(token_counts.KNOWN_PIECES + 1)})
    assert trie.counts(["hello there"]) == [(2, 2)]
    assert len(trie._pieces) <= 2
    trie._chunks.update({str(i): 1 for i in range(token_counts.KNOWN_CHUNKS + 1)})
    assert trie.counts(["hello there"]) == [(2, 2)] and len(trie._chunks) == 1
    tracemalloc.start()
    assert trie.counts(["x" * 300_000])[0][0] == 1
    assert tracemalloc.get_traced_memory()[1] < 60 << 20
    tracemalloc.stop()
