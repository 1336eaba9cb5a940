import re

import numpy as np
import pyarrow as pa
from hypothesis import given
from hypothesis import strategies as st

from trawl.llm import kernel

WORDS = re.compile(rb"[^\x20\x09-\x0D]+")


def words(text):
    return WORDS.findall(re.sub(rb"[A-Z]+", lambda m: m[0].lower(), (text or "").encode()))


@given(st.lists(st.one_of(st.none(), st.text(alphabet="aAbB \n\té", max_size=12)), max_size=8), st.integers(1, 4))
def test_shingles_match_plain_words(texts, k):
    values, at = kernel.text_shingles(pa.array(texts, pa.string()), k)
    known, back = {}, {}
    for i, text in enumerate(texts):
        own = words(text)
        want = [tuple(own[j : j + k]) for j in range(len(own) - k + 1)] if len(own) >= k else ([("short", *own)] if own else [])
        got = values[at[i] : at[i + 1]].tolist()
        assert len(got) == len(want)
        for w, g in zip(want, got, strict=True):
            assert known.setdefault(w, g) == g and back.setdefault(g, w) == w


def test_long_words_and_sliced_columns():
    texts = ["a" * (3 * kernel.BLOCK), "b c", None, "a" * (3 * kernel.BLOCK)]
    column = pa.array(["skip", *texts]).slice(1)
    values, at = kernel.text_shingles(column, 1)
    assert at.tolist() == [0, 1, 3, 3, 4] and values[0] == values[3] and len(np.unique(values)) == 3


def test_pieces_cover_all_rows():
    batch = pa.RecordBatch.from_arrays([pa.array(["x" * 10, None, "y" * 100, "", "z"])], ["text"])
    assert sum(p.num_rows for p in kernel.pieces(batch, "text", 20)) == 5
