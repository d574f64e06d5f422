import re

import numpy as np
import pyarrow as pa
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from sightline.llm import textbytes as tb

texts = st.lists(st.one_of(st.none(), st.text(alphabet="aB é\n\tß,.z1|", max_size=60)), min_size=1, max_size=6)


def plain(t, pattern):
    return re.findall(pattern, re.sub(rb"[A-Z]", lambda m: m[0].lower(), (t or "").encode()))


@settings(max_examples=60, deadline=None)
@given(texts)
def test_words(ts):
    for mask, pattern in ((tb.NOT_SPACE, rb"[^\x20\x09-\x0D]+"), (tb.ALNUM, rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")):
        w = tb.Words(pa.array(ts, pa.string()), mask, True)
        want = [plain(t, pattern) for t in ts]
        assert [w.text(i) for i in range(len(w))] == sum(want, [])
        assert w.counts().tolist() == [len(x) for x in want]
        by = {}
        for h, x in zip(w.hashes().tolist(), sum(want, []), strict=True):
            assert by.setdefault(x, h) == h
        assert len(set(by.values())) == len(by)


@settings(max_examples=40, deadline=None)
@given(st.lists(st.text(min_size=1, max_size=50).filter(lambda x: not re.search(r"\s|\x00", x)), min_size=3, max_size=8))
def test_xxh64(words):
    w = tb.Words(pa.array([" ".join(words)]), tb.NOT_SPACE, False)
    buf, at, size = w.joined()
    n = len(at) - 2
    h = tb.xxh64(buf, at[:n], at[2:] + size[2:] - at[:n])
    own = [w.text(i) for i in range(len(w))]
    assert h.tolist() == [xxhash.xxh64_intdigest(b" ".join(own[i : i + 3]), 42) for i in range(n)]


def test_sequences():
    h = np.random.default_rng(1).integers(0, 3, 400).astype(np.uint64)
    for k in (1, 2, 8, 13, 35):
        s = tb.sequence_hashes(h, k)
        assert len(s) == 400 - k + 1
        by = {}
        for i, x in enumerate(s.tolist()):
            assert by.setdefault(tuple(h[i : i + k].tolist()), x) == x
        assert len(set(by.values())) == len(by)
    assert len(tb.sequence_hashes(h[:3], 8)) == 0
