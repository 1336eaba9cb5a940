import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from trawl.llm import packing, token_counts
from trawl.llm.tokenizers_ import default_path, load

ODD = ["", " ", "a  b", " a", "a ", "x\n\ny  z", "a \n b", "don't  it's\t x", "<|endoftext|> a <|endoftext|>b", "é́ a", "a\nb c\nd", "\na", "x  y", "tab\tx y"]


def check(docs, rows):
    tokenizer = load(default_path("byte_bpe_50k.json"))
    want = sorted(zlib.crc32(np.array([*tokenizer.encode(r["text"] or "", add_special_tokens=False).ids, 0], "<u4").tobytes()) for r in docs.collect())
    offsets, lengths = {}, {}
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == offsets.get(r["sequence_id"], 0)
        offsets[r["sequence_id"]] = r["offset"] + r["length"]
    assert sorted(offsets) == list(range(len(offsets))) and max(offsets.values(), default=0) <= 1024
    return want, sum(offsets.values()), len(offsets), lengths


def test_round_trip(docs):
    rows = packing.pack(docs).collect()
    _, total, sequences, _ = check(docs, rows)
    tokenizer = load(default_path("byte_bpe_50k.json"))
    by_doc = {}
    for r in sorted(rows, key=lambda r: r["start"]):
        by_doc.setdefault(r["doc_id"], []).append(r)
    for d in docs.collect():
        ids, at = np.array([*tokenizer.encode(d["text"] or "", add_special_tokens=False).ids, 0], "<u4"), 0
        for r in by_doc[d["doc_id"]]:
            assert r["start"] == at and r["doc_tokens"] == len(ids)
            at += r["length"]
            assert zlib.crc32(ids[r["start"] : at].tobytes()) == r["ids_crc32"]
        assert at == len(ids)
    assert total > 0.98 * 1024 * (sequences - 4)


def test_pack_edges(edges, empty):
    rows = packing.pack(edges).collect()
    check(edges, rows)
    assert sum(r["start"] == 0 for r in rows) == edges.count() and packing.pack(empty).count() == 0


def test_words_give_the_library_ids():
    words = packing.WordIds(default_path("byte_bpe_50k.json"))
    texts = [*ODD, "z" * 70_000 + " q  r " + "w " * 40_000]
    assert [x.tolist() for x in words.encode(texts)] == [words.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab \n\t'é,0", max_size=30))
def test_any_text_gives_the_library_ids(text):
    words = packing.word_ids(default_path("byte_bpe_50k.json"))
    assert words.encode([text])[0].tolist() == words.tokenizer.encode(text, add_special_tokens=False).ids


@given(st.lists(st.integers(1, 100), max_size=60))
def test_partition(sizes):
    at, windows = packing.partition(np.array(sizes, np.int64), 100)
    sums = np.bincount(at, weights=sizes, minlength=windows) if sizes else [0]
    assert max(sums) <= 100 and len(at) == len(sizes)


def test_partition_refuses_what_cannot_fit():
    with pytest.raises(ValueError):
        packing.partition(np.array([101]), 100)


def test_counts(docs, edges, empty):
    sp = load(default_path("piece_bpe_32k.model"))
    for rows in (docs, edges):
        got = sorted((r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in token_counts.token_counts(rows).collect())
        want = [(len((r["text"] or "").encode()), len(sp.encode(r["text"] or ""))) for r in rows.collect()]
        assert got == sorted((b, n, n > 4096) for b, n in want)
    assert token_counts.token_counts(empty).count() == 0


@settings(deadline=None, max_examples=400)
@given(st.text(alphabet="ab \n.é\u2581\u00a0\u200b\u3000\u037a", max_size=60))
def test_safe_splits(text):
    path = default_path("piece_bpe_32k.model")
    sp = load(path)
    assert not token_counts.spans_spaces(path)
    assert sum(len(sp.encode(p)) for p in token_counts.split_safely(text, 5)) == len(sp.encode(text))


@pytest.mark.parametrize("text", ["ab \u2581 cd " * 9000, "abcd\u2581 efgh " * 8000, "\u2581\u2581 " * 30_000, "x" * 70_000 + " \u2581" + "y z " * 9])
def test_long_texts_with_the_space_mark(text):
    path = default_path("piece_bpe_32k.model")
    assert len(text) > token_counts.LONG and token_counts.count_tokens([text], path) == [len(load(path).encode(text))]
