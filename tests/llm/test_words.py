from __future__ import annotations

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from alertmill.llm import words as W
from tests.llm import brute

TEXTS = st.lists(st.one_of(st.none(), st.text(alphabet="ab \n\té#", max_size=40)), max_size=12)


def _spans(texts, limit):
    out = []
    for part in W.slices(pa.array(texts, pa.string()), limit):
        starts, ends, bounds = W.word_spans(part)
        body = part.data.tobytes()
        for i in range(part.rows):
            out.append([body[a:b].decode() for a, b in zip(starts[bounds[i] : bounds[i + 1]], ends[bounds[i] : bounds[i + 1]])])
    return out


@given(TEXTS, st.sampled_from([1, 7, 1000]))
@settings(max_examples=150, deadline=None)
def test_words_of_each_text(texts, limit):
    assert _spans(texts, limit) == [brute.words(t) for t in texts]


@given(st.lists(st.text(alphabet="abAB ", max_size=30), min_size=1, max_size=8))
@settings(max_examples=100, deadline=None)
def test_equal_shingles_have_equal_hashes(texts):
    by_hash: dict[int, set] = {}
    for part in W.slices(pa.array(texts), 16):
        starts, ends, bounds = W.word_spans(part)
        h = W.spans_hash(W.byte_prefix(part.data, lower=True), starts, ends)
        runs, run_bounds = W.shingles(h, bounds, 4)
        for i in range(part.rows):
            want = brute.shingle_set(texts[part.first + i])
            got = set(runs[run_bounds[i] : run_bounds[i + 1]].tolist())
            assert len(got) == len(want)
            ws = brute.words(brute.lower(texts[part.first + i]))
            for k, hash_ in enumerate(runs[run_bounds[i] : run_bounds[i + 1]].tolist()):
                by_hash.setdefault(hash_, set()).add(tuple(ws[k : k + 4]))
    assert all(len(v) == 1 for v in by_hash.values())


def test_mix_is_injective_on_a_sample():
    x = np.arange(100_000, dtype=np.uint64)
    assert len(np.unique(W.mix(x))) == len(x)
