import base64
from collections import Counter

import public_tokenizers
import pytest
import tiktoken

from hardwood.llm import token_counts
from tests.llm.helpers import frame, odd_documents, tables


def lengths(texts):
    pairs = (x.split() for x in token_counts.load_ranks(token_counts.RANKS).splitlines())
    e = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in pairs}, special_tokens={})
    return [len(e.encode_ordinary(t or "")) for t in texts]


def test_histogram_and_answers(spark, tmp_path):
    rows = odd_documents() + [(600, "<|endoftext|> it's we'll", "en", "s", 1)]
    d = tables(spark, tmp_path, documents=frame(spark, rows))
    n = lengths([r[1] for r in rows])
    h = token_counts.op1_token_lengths(spark, d)
    got = {r.n_tokens: r for r in h.collect()}
    assert {k: r.n_docs for k, r in got.items()} == Counter(n)
    for k, r in got.items():
        assert (r.docs_longer, r.tokens_longer, r.docs_upto, r.truncated_tokens) == (sum(x > k for x in n), sum(x for x in n if x > k), sum(x <= k for x in n), sum(min(x, k) for x in n))
    t = token_counts.totals(h).first()
    assert (t.documents, t.tokens, t.longest, t.mean) == (len(n), sum(n), max(n), pytest.approx(sum(n) / len(n)))
    for r in token_counts.quantiles(h, [0.0, 0.25, 0.5, 0.99, 1.0]).collect():
        assert r.n_tokens == min(k for k in n if sum(x <= k for x in n) >= r.q * len(n))
    for r in token_counts.truncated(h, [0, 1, 50, 10**6]).collect():
        assert (r.documents_cut, r.tokens_kept, r.tokens_lost) == (sum(x > r.context for x in n), sum(min(x, r.context) for x in n), sum(max(x - r.context, 0) for x in n))


def test_empty_table(spark, tmp_path):
    d = tables(spark, tmp_path, documents=frame(spark, []))
    assert token_counts.op1_token_lengths(spark, d).count() == 0
