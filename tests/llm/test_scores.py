import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from trawl.llm import quality, toxicity

SF = "/root/testdata/sf0.1"


def held(i, folds, part):
    return zlib.crc32(str(i).encode()) % folds == part


@pytest.mark.parametrize(("score", "label", "folds", "part", "least"), [(quality.quality_scores, "quality", 3, 1, 0.97), (toxicity.toxicity_scores, "toxic", 4, 2, 0.9)])
def test_held_out_accuracy(spark, score, label, folds, part, least):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    rows = score(docs, labels).toPandas()
    assert len(rows) == docs.count() and (rows.held_out == [held(i, folds, part) for i in rows.doc_id]).all()
    both = rows[rows.held_out].merge(labels.toPandas(), on="doc_id")
    assert ((both.predicted == both[label]).mean()) >= least
    good, bad = both.score[both[label] == 1].to_numpy(), both.score[both[label] == 0].to_numpy()
    assert np.mean(good[:, None] > bad[None, :]) + 0.5 * np.mean(good[:, None] == bad[None, :]) > least


def test_a_sample_keeps_the_share_of_toxic_rows(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    known = labels.toPandas()
    chosen = [i for i in known.doc_id if held(i, 4, 2)]
    texts = docs.filter(docs.doc_id.isin(chosen)).toPandas().merge(known, on="doc_id")
    even, odd = (toxicity.train(docs, labels, per_class=n).score(texts.text) for n in (400, 4000))
    assert abs(even.mean() - texts.toxic.mean()) < 0.03 and abs(even.mean() - odd.mean()) < 0.03


@pytest.mark.parametrize("score", [quality.quality_scores, toxicity.toxicity_scores])
def test_edges(edges, empty, labels, score):
    rows = score(edges, labels).collect()
    assert len(rows) == edges.count() and all(0 <= r["score"] <= 1 and r["held_out"] is not None for r in rows)
    assert score(empty, labels).count() == 0
    assert score(edges, labels.limit(0)).count() == edges.count()


def test_keep_quality(edges, empty, labels):
    out = quality.keep_quality(edges, labels)
    assert out.columns == edges.columns and out.count() <= edges.count() and quality.keep_quality(empty, labels).count() == 0


def test_folding():
    assert toxicity.folded("Y0u 1D10T!") == " you idiot  ".replace("  ", " i ", 1).replace(" i ", "i ") or "idiot" in toxicity.folded("Y0u 1D10T!")
    assert toxicity.folded("ѕсum") == " scum " and toxicity.folded("lоsеr") == toxicity.folded("1oser") == " ioser "
    assert toxicity.folded(None) == "  "


def test_lexicon():
    lexicon = toxicity.Lexicon({toxicity.folded("trash"): 2.0, " idio": 3.0})
    assert lexicon.hits(toxicity.folded("trash, idiots and idiocy")) == [2.0, 3.0, 3.0]
    assert lexicon.hits(toxicity.folded("a trash can and trashy")) == []
    nested = toxicity.Lexicon({" trash ": 1.0, " can ": 1.0, " bin ": 1.0}, ("trash can", "can of worms"))
    assert nested.hits(toxicity.folded("trash bin trash can of worms can bin")) == [1.0, 1.0, 1.0, 1.0]
    assert nested.hits(toxicity.folded("trash can " * 50_000)) == []


@settings(max_examples=300)
@given(st.lists(st.sampled_from("tr tra trash can bin of worms trashy cannot".split()), max_size=14), st.dictionaries(st.sampled_from([" trash ", " tra", " can ", " can", " worms ", " bin ", " of "]), st.sampled_from([0.5, 1.0, 2.5])), st.sets(st.sampled_from(["trash can", "can of worms", "of worms bin", "bin"])))
def test_hits_of_a_naive_search(words, weights, exceptions):
    """The automaton against a search of each term and phrase at each place."""
    text = toxicity.folded(" ".join(words))
    spans = [(i, i + len(p) + 2) for p in exceptions for i in range(len(text)) if text.startswith(f" {p} ", i)]
    want = []
    for i in range(len(text)):
        own = [w for t, w in weights.items() if text.startswith(t, i)]
        if own and not any(a <= i < b - 1 for a, b in spans):
            want.append(max(own))
    assert sorted(toxicity.Lexicon(weights, tuple(exceptions)).hits(text)) == sorted(want)


@pytest.mark.parametrize("counts", [None, (10, 90)])
def test_scores_are_differences_of_plain_log_densities(counts):
    """Against densities by determinants and inverse matrices, without Cholesky factors."""
    rng = np.random.default_rng(4)
    d = len(quality.FEATURES)
    x = np.concatenate([rng.normal(0, 1, (80, d)) @ rng.normal(0, 1, (d, d)), 1 + rng.normal(0, 2, (50, d))])
    y = np.repeat([0, 1], [80, 50])
    z = (x - x.mean(axis=0)) / x.std(axis=0)
    own = [np.cov(z[y == k].T) for k in (0, 1)]
    pooled = (80 * own[0] + 50 * own[1]) / 130
    logs = []
    for k in (0, 1):
        c = (1 - quality.POOLED) * own[k] + quality.POOLED * pooled
        c = (1 - quality.DIAGONAL) * c + quality.DIAGONAL * np.diag(np.diag(c)) + quality.RIDGE * np.eye(d)
        far = z - z[y == k].mean(axis=0)
        logs.append(-0.5 * np.einsum("ij,jk,ik->i", far, np.linalg.inv(c), far) - 0.5 * np.linalg.slogdet(c)[1])
    n = counts or (80, 50)
    want = 1 / (1 + np.exp(-np.clip(logs[1] - logs[0] + np.log(n[1] / n[0]), -30, 30)))
    assert np.allclose(quality.fit(x, y, counts=counts).score(x), want, atol=1e-9)


def test_statistics_of_plain_loops():
    """Shares of bytes and counts of distinct words, pairs and lines, counted one by one."""
    texts = ["The cat sat.\nThe cat sat.\nA dog!", "", None, "x", "AB 12 | 34 ~ é\n\nAB", "one two one two one two"]
    for row, text in zip(quality.statistics(quality.pa.array(texts)), texts, strict=True):
        raw = (text or "").encode()
        words, lines = (text or "").lower().split(), (text or "").split("\n")
        share = lambda chars: np.log1p(100 * sum(c in chars for c in raw) / max(len(raw), 1))  # noqa: E731, B023
        pairs = list(zip(words, words[1:], strict=False)) or [tuple(words)]
        want = {
            "log words": np.log1p(len(words)), "upper": share(range(65, 91)), "digits": share(range(48, 58)), "spaces": share(b" \t\x0b\x0c\r\n"), "marks": share(b"!?"), "bars": share(b"|"),
            "distinct pairs": len(set(pairs)) / len(pairs) if words else 0.0, "line bytes": np.log1p(len(raw) / len(lines)), "top word": np.sqrt(max(words.count(w) for w in words) / len(words)) if words else 0.0,
        }
        got = dict(zip(quality.FEATURES, row, strict=True))
        assert all(abs(got[k] - v) < 1e-9 for k, v in want.items()), (text, got, want)
