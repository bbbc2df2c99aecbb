import pyarrow as pa

from hardwood.llm import wordbytes
from tests.llm.helpers import odd_documents


def test_words_like_split():
    texts = [r[1] for r in odd_documents()] + ["a\x0bb\x0cc\rd\te", "é é", "A a"]
    by_hash, n = {}, 0
    for size in (1 << 20, 64):
        for lo, data, offsets in wordbytes.slices(pa.array(texts), size):
            w = wordbytes.words(data, offsets)
            for i in range(len(offsets) - 1):
                want = (texts[lo + i] or "").encode().lower().split()
                got = [bytes(data[a:b]).lower() for a, b in zip(w.start[w.row == i], w.end[w.row == i], strict=True)]
                assert got == want
                for x, h in zip(want, w.hash[w.row == i].tolist(), strict=True):
                    assert by_hash.setdefault(h, x) == x
                    n += 1
    assert n and len(set(by_hash.values())) == len(by_hash)
