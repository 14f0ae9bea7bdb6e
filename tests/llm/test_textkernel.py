import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerline.llm import textkernel as K

TEXT = st.text(alphabet=st.sampled_from("ab \t\n\x0b\r\x1cÉ日A "), max_size=40)
WORD = "[^\x20\x09-\x0d]+"


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.none(), TEXT), max_size=12), st.integers(1, 30))
def test_words_and_lines(texts, limit):
    words, lines = [], []
    for part in K.slices(pa.array(texts, pa.string()), limit):
        s, e = part.words()
        d = part.doc_of(s)
        words += [(part.first + k, part.data[a:b].tobytes().decode()) for a, b, k in zip(s, e, d)]
        s, e, d = part.lines()
        lines += [(part.first + k, part.data[a:b].tobytes().decode()) for a, b, k in zip(s, e, d)]
    assert words == [(i, w) for i, t in enumerate(texts) for w in re.findall(WORD, t or "")]
    assert lines == [(i, x) for i, t in enumerate(texts) for x in (t or "").split("\n")]


def test_hashes_follow_content():
    texts = ["ab ba AB a b", "ab " * 5 + "é" * 3]
    (part,) = K.slices(pa.array(texts))
    s, e = part.words()
    raw, low = part.hashes(s, e, False), part.hashes(s, e, True)
    found = [part.data[a:b].tobytes() for a, b in zip(s, e)]
    assert len(set(raw.tolist())) == len(set(found))
    assert low[0] == low[2] != low[1]


def test_mix_is_one_to_one():
    from ledgerline.llm.kneser_ney import _unmix

    x = np.random.default_rng(0).integers(0, 1 << 63, 10_000, np.uint64)
    assert (_unmix(K.mix(x)) == x).all()


def test_shingles():
    texts = ["a b c d e f", "A b c\td e", "a b", "", "b a", "a b"]
    sets = [s.tolist() for p in K.slices(pa.array(texts)) for s in K.shingle_sets(p, 5)]
    assert [len(s) for s in sets] == [2, 1, 1, 0, 1, 1]
    assert set(sets[1]) < set(sets[0]) and sets[2] == sets[5] != sets[4]
