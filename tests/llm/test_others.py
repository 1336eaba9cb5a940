import collections
import itertools
import pathlib
import random
import re
import textwrap

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from trawl.llm import chat_format, decontamination, license_scan, sharding


def test_shards(docs, edges, empty):
    for rows in (docs, edges):
        got = sharding.shard_documents(rows, 8).collect()
        by = collections.defaultdict(list)
        for r in got:
            by[r["shard"]].append(r["slot"])
        assert len(got) == rows.count() and max(map(len, by.values())) - min(map(len, by.values())) <= 1 and len(by) == 8
        assert all(sorted(s) == list(range(len(s))) for s in by.values())
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    homes = collections.defaultdict(set)
    for r in sharding.shard_documents(docs, 8).collect():
        homes[texts[r["doc_id"]]].add(r["shard"])
    assert max(map(len, homes.values())) == 1
    assert sharding.shard_documents(empty).count() == 0


def test_bound_of_rounds_follows_the_shards(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(sharding, "_rounds", lambda state, held, total, rounds: (state, seen.append(rounds)))
    assert sharding.propagate(spark.range(10).selectExpr("id as row", "id as grp"), 32).count() == 10 and seen == [128]


def test_hot_group(spark):
    """A group of more rows than a shard holds is split over as few shards as can hold it."""
    rows = spark.range(300).selectExpr("id as doc_id", "case when id % 3 = 0 then 'same' else cast(id as string) end as text")
    got = sharding.shard_documents(rows, 8).collect()
    counts = collections.Counter(r["shard"] for r in got)
    assert sorted(counts.values()) == [37] * 4 + [38] * 4
    assert len({r["shard"] for r in got if r["doc_id"] % 3 == 0}) <= 4


@pytest.mark.parametrize("sizes", [[2] * 400, [2] * 360 + [1] * 80, [3] * 100 + [5] * 60 + [200, 200, 150]])
def test_groups_of_a_table_of_copies(spark, sizes):
    """With few or no single rows groups are kept whole by exchanges; fewer than the shards stay cut."""
    rows = [(i, f"text {g}") for i, g in enumerate(g for g, n in enumerate(sizes) for _ in range(n))]
    random.Random(1).shuffle(rows)
    got = sharding.shard_documents(spark.createDataFrame(rows, "doc_id long, text string"), 8).collect()
    assert len(got) == len(rows)
    counts = collections.Counter(r["shard"] for r in got)
    assert max(counts.values()) - min(counts.values()) <= 1 and len(counts) == 8
    texts, homes = dict(rows), collections.defaultdict(set)
    for r in got:
        homes[texts[r["doc_id"]]].add(r["shard"])
    cut = [len(h) for h in homes.values() if len(h) > 1]
    assert len(cut) < 8 and max(cut, default=0) <= 4
    if 3 not in sizes:
        assert not cut


def best_cut(sizes, shards, total):
    """The least number of pairs of equal texts in different shards, over all ways to fill shards of equal rows."""
    rooms = tuple(total // shards + (s < total % shards) for s in range(shards))
    seen = {}

    def search(i, left):
        if i == len(sizes):
            return 0
        if (i, key := tuple(sorted(left))) not in seen:
            best = 10**9
            for parts in itertools.product(*[range(min(sizes[i], x) + 1) for x in key]):
                if sum(parts) == sizes[i]:
                    cut = (sizes[i] ** 2 - sum(x * x for x in parts)) // 2
                    best = min(best, cut + search(i + 1, tuple(a - b for a, b in zip(key, parts, strict=True))))
            seen[i, key] = best
        return seen[i, key]

    return search(0, rooms)


@pytest.mark.parametrize(("sizes", "shards"), [((4, 3, 3, 2), 3), ((5, 2, 2, 1, 1, 1), 2), ((3, 3, 3, 3, 1, 1, 1), 4)])
def test_cut_beside_the_best(spark, sizes, shards):
    """The cut edges against the best of all assignments of tiny tables, where dealing leaves fewer cut groups than shards."""
    rows = [(i, g) for i, g in enumerate(g for g, n in enumerate(sizes) for _ in range(n))]
    got = sharding.propagate(spark.createDataFrame(rows, "row long, grp long"), shards).collect()
    counts = collections.Counter(r["shard"] for r in got)
    assert max(counts.values()) - min(counts.values()) <= 1 and len(got) == len(rows)
    homes = collections.defaultdict(collections.Counter)
    for r in got:
        homes[r["grp"]][r["shard"]] += 1
    cut = sum((sum(h.values()) ** 2 - sum(n * n for n in h.values())) // 2 for h in homes.values())
    best = best_cut(sizes, shards, len(rows))
    assert best <= cut <= best + max(sizes) * (shards - 1) and sum(len(h) > 1 for h in homes.values()) < shards


@given(st.dictionaries(st.tuples(st.integers(0, 3), st.integers(0, 3)), st.integers(0, 20)), st.dictionaries(st.integers(0, 3), st.integers(0, 10)))
def test_quotas_balance(asked, free):
    moves, back = sharding.quotas(asked, free, 4)
    for s in range(4):
        gain = sum(v for (a, b), v in [*moves.items(), *back.items()] if b == s) - sum(v for (a, b), v in [*moves.items(), *back.items()] if a == s)
        assert gain == 0 and sum(v for (a, _), v in back.items() if a == s) <= free.get(s, 0)
    assert all(v <= asked[k] for k, v in moves.items())


def brute_windows(text, item):
    low = lambda t: "".join(c.lower() if c.isascii() else c for c in t).split()
    words, own = low(text), low(item)
    shingles = lambda w: {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
    n = min(len(own), len(words))
    return max((len(shingles(words[i : i + n]) & shingles(own)) / max(len(shingles(words[i : i + n]) | shingles(own)), 1) for i in range(len(words) - n + 1)), default=0)


def test_decontamination(docs, benchmark):
    items = {r["item_id"]: r["text"] for r in benchmark.collect()}
    rows = docs.collect()
    got = {(r["doc_id"], r["item_id"]) for r in decontamination.contaminated(docs, benchmark).collect()}
    want = {(d["doc_id"], i) for d in rows for i, t in items.items() if t in d["text"]}
    assert want and want <= got
    texts = {d["doc_id"]: d["text"] for d in rows}
    assert all(brute_windows(texts[d], items[i]) >= 0.75 for d, i in got)
    left = {r["doc_id"] for r in decontamination.drop_contaminated(docs, benchmark).collect()}
    assert left == set(texts) - {d for d, _ in got}


def test_decontamination_edges(spark, edges, empty, benchmark, monkeypatch):
    assert decontamination.contaminated(edges, benchmark).count() == 0 and decontamination.contaminated(empty, benchmark).count() == 0
    item = "a b c d e f g h i j k l m n o p q r s t u v w x y z 1 2 3 4"
    odd = spark.createDataFrame([(1, item), (2, None), (3, ""), (None, "x"), (4, "two words"), (5, item)], "item_id long, text string")
    near = item.replace(" 4", " four")
    docs = spark.createDataFrame([(1, f"before {item} after", 1), (2, f"x {near} y", 2), (None, item.upper(), 3), (4, "two words", 4), (5, "a b c d e f z", 5)], "doc_id long, text string, item_id int")
    monkeypatch.setattr(decontamination, "ITEM_BYTES", 64)  # several blocks of items
    got = collections.Counter((r["doc_id"], r["item_id"]) for r in decontamination.contaminated(docs, odd).collect())
    assert got == collections.Counter([(1, 1), (1, 5), (2, 1), (2, 5), (None, 1), (None, 5), (4, 4)])
    assert decontamination.contaminated(docs, odd.limit(0)).count() == 0
    accents = spark.createDataFrame([(1, "été ñandú über straße été où naïve")], "item_id long, text string")
    capitals = spark.createDataFrame([(1, "x ÉTÉ ÑANDÚ ÜBER STRASSE ÉTÉ OÙ NAÏVE y")], "doc_id long, text string")
    assert [(r["doc_id"], r["item_id"], r["start_word"]) for r in decontamination.contaminated(capitals, accents).collect()] == [(1, 1, 1)]


def test_decontamination_of_shared_passages(spark, monkeypatch):
    """Items that repeat or share text are found with a changed word, in the same way in one block and in several."""
    words = [f"w{i}" for i in range(54)]
    changed = " ".join([*words[:25], "other", *words[26:]])
    items = [(i, " ".join(words)) for i in range(3)] + [(10 + i, " ".join([*words, f"end{i}"])) for i in range(3)] + [(20 + i, f"{' '.join(words[:30])} " + " ".join(f"x{i}y{k}" for k in range(24))) for i in range(4)]
    docs = spark.createDataFrame([(1, f"before {changed} after"), (2, items[-1][1].replace("w20 ", "other ")), (3, " ".join(words[:40]))], "doc_id long, text string")
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    found = []
    for size in (4 << 20, 256):
        monkeypatch.setattr(decontamination, "ITEM_BYTES", size)
        found.append({(r["doc_id"], r["item_id"], r["similarity"]) for r in decontamination.contaminated(docs, benchmark).collect()})
    assert found[0] == found[1] and {(d, i) for d, i, _ in found[0]} == {(1, 0), (1, 1), (1, 2), (2, 23)}


def test_blocks_lose_no_fingerprint_within_the_radius():
    """The multi-index against all distances, and what it leaves of pairs at random."""
    rng = np.random.default_rng(11)
    prints = rng.integers(0, 1 << decontamination.WIDTH, (150, decontamination.BLOCKS), dtype=np.uint16)
    index = decontamination.BlockIndex(prints)
    near = []
    for i in range(400):
        flips = rng.permutation(decontamination.BITS)[: rng.integers(0, 50)]
        bits = np.zeros(decontamination.BITS, np.uint16)
        bits[flips] = 1
        near.append(prints[i % 150] ^ (bits.reshape(decontamination.BLOCKS, -1) << np.arange(decontamination.WIDTH, dtype=np.uint16)).sum(axis=1, dtype=np.uint16))
    other = np.concatenate([near, rng.integers(0, 1 << decontamination.WIDTH, (400, decontamination.BLOCKS), dtype=np.uint16)])
    want = {(x, y) for x in range(len(other)) for y in range(150) if decontamination.distances(other[x : x + 1], prints[y : y + 1])[0] <= decontamination.RADIUS}
    assert len(want) > 200 and set(zip(*map(np.ndarray.tolist, index.within(other)), strict=True)) == want
    assert len(index.candidates(other[400:])[0]) < 0.4 * 400 * 150


def test_recall_of_edited_items(benchmark):
    """Items with words replaced, deleted or put in, of similarity 0.8 or more by plain counts, are all found."""
    rng = random.Random(5)
    texts = {r["item_id"]: r["text"] for r in benchmark.collect()}
    items, asked = decontamination.Items(list(texts), list(texts.values())), 0
    for item, text in list(texts.items()) * 4:
        words = text.split()
        for _ in range(rng.randint(0, 3)):
            at = rng.randrange(len(words))
            words[at : at + rng.randint(0, 1)] = ["changed"] * rng.randint(0, 1)
        passage = " ".join(["before", "it", *words, "and", "after", "it"])
        values, _ = decontamination.kernel.text_shingles(decontamination.case_folded(pa.array([passage])), 5)
        size = len(items.sets[items.ids.index(item)])
        best = max((items.similarity(values[s : s + size], items.ids.index(item)) for s in range(len(values) - size + 1)), default=0)
        if best >= 0.8:
            asked += 1
            assert item in {m[0] for m in items.matches(values, items.hits(values), 0.8)}
    assert asked >= 20


def test_window_starts_of_a_long_text():
    """The best window of a text that repeats parts of an item, against similarities of all windows."""
    rng = np.random.default_rng(7)
    item = [f"w{i}" for i in range(30)]
    words = []
    for _ in range(60):
        a = int(rng.integers(0, 26))
        words += [f"o{i}" for i in rng.integers(0, 1000, int(rng.integers(0, 40)))] + item[a : a + int(rng.integers(5, 31))]
    words += ["between", *item[:14], "other", *item[15:], "after"] + item
    items = decontamination.Items([1], [" ".join(item)])
    values, _ = decontamination.kernel.text_shingles(pa.array([" ".join(words)]), 5)
    sims = [items.similarity(values[s : s + 26], 0) for s in range(len(values) - 25)]
    ((_, best, start, _),) = items.matches(values, items.hits(values), 0.8)
    assert best == round(max(sims), 6) and start == int(np.argmax(sims))


def pairs_of(text):
    """Word bigrams with their counts, made without the operator's functions."""
    words = "".join(c if c.isalnum() else " " for c in text.lower()).split()
    return collections.Counter(zip(words, words[1:], strict=False)) if len(words) > 1 else collections.Counter((w, w) for w in words)


def plain_dice(a, b):
    n = sum(a.values()) + sum(b.values())
    return 2 * sum(min(n, b[g]) for g, n in a.items()) / n if n else 0


def test_licenses(spark, docs, edges, empty):
    """Lines of the documents, by plain counts; licences found beside them are in runs over lines."""
    got = {r["doc_id"]: r["dice"] for r in license_scan.license_scan(docs).collect()}
    known = [(name, pairs_of(t)) for name, own in license_scan.TEMPLATES.items() for t in own]
    want = collections.defaultdict(float)
    for d in docs.collect():
        for line in {x for x in d["text"].split("\n") if len(x) < 2000}:
            own = pairs_of(line)
            for name, b in known:
                if (x := plain_dice(own, b)) >= license_scan.DICE:
                    want[d["doc_id"], name] = max(want[d["doc_id"], name], x)
    assert len(want) > 3 and {i for i, _ in want} <= set(got)
    lines = {"Released under the MIT License.": "MIT", "Licensed under the Apache License, Version 2.0.": "Apache-2.0", "Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0", "All rights reserved.": "Proprietary", "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0"}
    names = {(r["doc_id"], r["license"], r["dice"]) for r in license_scan.license_scan(docs).collect()}
    assert {(d["doc_id"], name, 1.0) for d in docs.collect() for line, name in lines.items() if line in d["text"].split("\n")} <= names
    assert license_scan.license_scan(edges).count() == 0 and license_scan.license_scan(empty).count() == 0


def test_license_units_of_any_shape():
    """Signs between words, whatever their number, and bigrams that repeat don't hide a licence."""
    known = license_scan.Templates(license_scan.TEMPLATES, license_scan.DICE)
    for text in ("Released_under-the.MIT/License", "Released under the MIT License. " + "-" * 9000, "Released\tunder\tthe\tMIT\tLicense"):
        assert known.search(text) and known.notices(text) == {"MIT": (1.0, 0, 1)}
    repeats = license_scan.Templates({"x": ("one two " * 6 + "three four",)}, license_scan.DICE)
    text = "one two " * 6 + "five six"
    assert repeats.search(text) == bool(repeats.notices(text)) is True


@pytest.mark.parametrize("name", ["MIT-text", "BSD-3-Clause", "GPL-3.0", "LGPL-2.1", "AGPL-3.0", "Apache-2.0", "ISC", "Zlib"])
def test_whole_licences_wrapped_in_comments(name):
    """The longest text of a licence, in lines of 60 characters behind comment signs after a copyright line."""
    known = license_scan.Templates(license_scan.TEMPLATES, license_scan.DICE)
    body = max(license_scan.TEMPLATES[name], key=len)
    text = "import os\n\n\n# Copyright (c) 2021 Some Body\n#\n" + "\n".join(f"# {x}" for x in textwrap.wrap(body, 60)) + "\n\nprint(1)\n"
    found = known.notices(text)
    best = max(found, key=lambda k: (found[k][0], k == name))
    assert known.search(text) and best == name and found[name][0] > 0.97 and found[name][1] == 5


def test_notices_of_any_layout(spark):
    """Notices wrapped in a comment header and in mid-sentence."""
    header = "/*\n * Copyright 2020 Foo Press\n * This program is free software: you can redistribute it\n * and/or modify it under the terms of the GNU General\n * Public License as published by the Free Software\n * Foundation, either version 3 of the License, or (at\n * your option) any later version.\n * This program comes without any warranty, to the extent\n * that the law permits it, not even an implied one.\n */"
    middle = "© 2020 Foo Press, licensed under CC BY 4.0."
    plain = "Nothing of that kind: the law of the land and the terms of the game."
    rows = spark.createDataFrame([(1, header), (2, middle), (3, plain), (4, f"{plain}\n\n{middle} {middle}\n{middle}")], "doc_id long, text string")
    got = {(r["doc_id"], r["license"]): (r["dice"], r["line"], r["n_lines"]) for r in license_scan.license_scan(rows).collect()}
    assert got == {(1, "GPL-3.0"): (1.0, 2, 1), (2, "CC-BY-4.0"): (1.0, 0, 1), (4, "CC-BY-4.0"): (1.0, 2, 2)}


@settings(max_examples=40, deadline=None)
@given(st.lists(st.sampled_from("released under the mit license this work is".split()), max_size=14))
def test_notices_are_the_best_runs(words):
    known = license_scan.Templates(license_scan.TEMPLATES | {"one": ("Work",)}, license_scan.DICE)
    best = {}
    for i, j in itertools.combinations(range(len(words) + 1), 2):
        own = pairs_of(" ".join(words[i:j]))
        for name, texts in (license_scan.TEMPLATES | {"one": ("Work",)}).items():
            best[name] = max(best.get(name, 0), *(plain_dice(own, pairs_of(t)) for t in texts))
    got = collections.defaultdict(float)
    for name, _, d, _, _ in known.runs(license_scan.normalise(" ".join(words)).split()):
        got[name] = max(got[name], d)
    assert got == {name: d for name, d in best.items() if d >= license_scan.DICE}
    assert not got or known.search(" ".join(words))
    shown = known.notices("\n".join(words))
    assert bool(shown) == bool(got) and all(d <= got[name] for name, (d, _, _) in shown.items())


ROWS = [
    ("c", 0, "user", "How do I sort?\nSecond line", 1),
    ("c", 1, "assistant", "> How do I sort?\nUse sorted().", 2),
    ("c", 2, "user", ">> How do I  SORT?\n> Use sorted().\nThanks\n> never said", 3),
    ("c", 3, "user", "> not found\nHm", 4),
    ("c", 4, "user", None, 5),
    ("c", None, "user", "> How do I sort?", 6),
    (None, 1, "user", "> x", 7),
    ("d", 0, "user", "> Use sorted().\nother conversation", 8),
    ("d", 1, "user", "", 9),
    ("d", 1, "user", "", 9),
]


def test_quotes(spark):
    messages = spark.createDataFrame(ROWS, "conv_id string, turn int, role string, text string, thread int")
    got = {(r["conv_id"], r["turn"]): r for r in chat_format.link_quotes(messages).collect()}
    assert chat_format.link_quotes(messages).count() == len(ROWS)
    assert (got["c", 1]["reply_to"], got["c", 1]["text"], got["c", 1]["depth"]) == (0, "Use sorted().", 1)
    assert (got["c", 2]["reply_to"], got["c", 2]["thread"], got["c", 2]["depth"], got["c", 2]["n_quotes"], got["c", 2]["n_linked"]) == (1, 0, 2, 3, 2)
    assert got["c", 2]["text"] == "Thanks\n" and got["c", 3]["reply_to"] is None and got["c", 3]["n_quotes"] == 1
    assert got["d", 0]["reply_to"] is None and got["c", 4]["text"] is None and got["c", 0]["thread"] == 0


def test_quotes_of_parts(spark):
    """Runs of lines within a paragraph, over paragraphs, and beside quoted lines of an interleaved reply."""
    lines = [f"line {i} of it" for i in range(5)]
    rows = [
        ("p", 0, "\n".join(lines) + "\n\nsecond\nparagraph\n\nthird one"),
        ("p", 1, f"> {lines[1]}\n> {lines[2].upper()}\nyes"),
        ("p", 2, "> second\n> paragraph\n>\n> third one\nno"),
        ("p", 3, f"> {lines[1]}\n> {lines[3]}\nnot a run"),
        ("i", 0, "a\nb"),
        ("i", 1, "> a\nr1a\nr1b\n> b\nr2a"),
        ("i", 2, "> r1a\n> r1b\nI see"),
        ("i", 3, "> r1a r1b\nI see"),
        ("i", 4, "> r1a\n> r2a\nnot a run"),
    ]
    got = chat_format.link_quotes(spark.createDataFrame([(c, t, "user", x) for c, t, x in rows], "conv_id string, turn long, role string, text string")).collect()
    replies = {(r["conv_id"], r["turn"]): (r["reply_to"], r["thread"]) for r in got}
    assert replies == {("p", 0): (None, 0), ("p", 1): (0, 0), ("p", 2): (0, 0), ("p", 3): (None, 3), ("i", 0): (None, 0), ("i", 1): (0, 0), ("i", 2): (1, 0), ("i", 3): (1, 0), ("i", 4): (None, 4)}
    assert next(r["text"] for r in got if (r["conv_id"], r["turn"]) == ("i", 1)) == "r1a\nr1b\nr2a"


def brute_quotes(rows):
    """(reply_to, n_quotes, n_linked) by (conv, turn), from plain loops."""
    normal = lambda t: re.sub(r"\s+", " ", t).strip(" ").lower()
    mark = re.compile(r"^((?:[ \t]{0,3}>)+)[ \t]?")
    out = {}
    for conv, turn, text in rows:
        lines = [(m.group(1).count(">"), x[m.end() :]) if (m := mark.match(x)) else (0, x) for x in text.split("\n")]
        runs = [(level, normal("\n".join(b for _, b in own))) for level, own in ((k, list(g)) for k, g in itertools.groupby(lines, key=lambda x: x[0]))]
        origins, quotes = [], [(level, body) for level, body in runs if level and body]
        for level, body in quotes:
            for c, t, other in sorted(r for r in rows if r[0] == conv):
                plain = "".join(x for x in other.splitlines(True) if not re.match(r"[ \t]{0,3}>", x))
                part = len(body.split()) >= 5 and f" {body} " in f" {normal(plain)} "
                if part or body in {normal(plain), *map(normal, re.split(r"\n\s*\n", plain)), *map(normal, plain.split("\n"))}:
                    origins += [(level, t)] if t < turn else []
                    break
        out[conv, turn] = (max((t for level, t in origins if level == 1), default=None), len(quotes), len(origins))
    return out


def test_quotes_of_parts_of_lines(spark):
    """Runs of five words or more within lines and over their breaks; none shorter, cut in a word, or with words left out."""
    own = "The quick brown fox jumps over\nthe lazy dog and runs away.\n\nNobody saw it."
    parts = {"brown fox jumps over the lazy": 0, "fox jumps over": None, "rown fox jumps over the lazy": None, "fox  jumps\nOVER the\nlazy dog": 0, "brown fox over the lazy dog": None, "dog and runs away. nobody saw": 0, "the quick brown fox jumps": 0, "runs away. Nobody saw it.": 0}
    rows = [("w", 0, own), *(("w", 1 + i, "".join(f"> {x}\n" for x in part.split("\n")) + f"reply {i}") for i, part in enumerate(parts))]
    rows += [("other", 0, "> quick brown fox jumps over\nanother conversation"), ("w", 50, None), ("w", 51, ""), ("w", 52, "> reply 3\nyes")]
    got = {(r["conv_id"], r["turn"]): r["reply_to"] for r in chat_format.link_quotes(spark.createDataFrame([(c, t, "user", x) for c, t, x in rows], "conv_id string, turn long, role string, text string")).collect()}
    assert len(got) == len(rows) and [got["w", 1 + i] for i in range(len(parts))] == list(parts.values())
    assert got["other", 0] is None and got["w", 52] == 4


def test_random_quotes_of_parts(spark):
    """Random cuts of few different words against plain loops, so that heads of passages stand in many places."""
    draw = random.Random(17)
    rows = []
    for conv in ("a", "b", "c"):
        said = []
        for turn in range(40):
            words = draw.choices(["so", "it", "is"], k=draw.randint(5, 40))
            quote = ""
            if turn:
                other = draw.choice(said)
                at, n = draw.randrange(len(other)), draw.randint(1, 14)
                quote = "".join(f"> {' '.join(other[i : i + 6])}\n" for i in range(at, min(at + n, len(other)), 6))
            said.append(words)
            rows.append((conv, turn, quote + "\n".join(" ".join(words[i : i + 9]) for i in range(0, len(words), 9))))
    got = chat_format.link_quotes(spark.createDataFrame([(c, t, "user", x) for c, t, x in rows], "conv_id string, turn long, role string, text string")).collect()
    want = brute_quotes(rows)
    assert sum(n for _, _, n in want.values()) > 60 and {(r["conv_id"], r["turn"]): (r["reply_to"], r["n_quotes"], r["n_linked"]) for r in got} == want


def test_quotes_in_a_hot_conversation(spark):
    """One conversation has most rows, one message most replies, and one text very many passages."""
    draw = random.Random(7)
    lines = [f"line {i} of words" for i in range(25)]
    rows = []
    for conv, n in (("hot", 100), *((f"c{i}", 6) for i in range(20))):
        for turn in range(n):
            own = draw.sample(lines, 2)
            quote = [">" * draw.randint(1, 2) + " " + draw.choice(lines) for _ in range(draw.randint(0, 2))] if turn % 3 else ["> " + lines[0]] * (turn > 0)
            rows.append((conv, turn, "\n".join([*quote, *own] if turn else [lines[0], "", *own])))
    rows.append(("long", 0, "start"))
    rows.append(("long", 1, "\n".join(f"{'>' * (1 + i % 2)} passage {i}" for i in range(20_000)) + "\n> start"))
    got = {(r["conv_id"], r["turn"]): r for r in chat_format.link_quotes(spark.createDataFrame([(c, t, "user", x) for c, t, x in rows], "conv_id string, turn long, role string, text string")).collect()}
    want = brute_quotes([r for r in rows if r[0] != "long"])
    assert {k: (r["reply_to"], r["n_quotes"], r["n_linked"]) for k, r in got.items() if k[0] != "long"} == want
    for (conv, turn), r in got.items():
        head, depth = turn, 0
        while (up := got[conv, head]["reply_to"]) is not None:
            head, depth = up, depth + 1
        assert (r["thread"], r["depth"]) == (head, depth)
    assert (got["long", 1]["n_quotes"], got["long", 1]["n_linked"], got["long", 1]["reply_to"]) == (20_001, 1, 0)


@pytest.mark.parametrize("long", [10, 1000])
def test_positions_follow_threads(spark, monkeypatch, long):
    """Gapless places by thread and turn, with long conversations cut into ranges and without; rows that repeat or lack keys."""
    monkeypatch.setattr(chat_format, "LONG", long)
    draw = random.Random(3)
    rows = [("hot", t, "u", f"say {t}" if t % 3 else f"> say {draw.randrange(t)}\nreply {t}" if t else "say 0") for t in range(300)]
    rows += [("replies", 0, "u", "first words")] + [("replies", t, "u", f"> first words\nno {t}") for t in range(1, 90)]
    rows += [(c, t, "u", f"{c} {t}") for c in "abc" for t in (5, 1, 1, -4)] + [(None, 1, "u", "x"), ("a", None, "u", "x")]
    got = chat_format.link_quotes(spark.createDataFrame(rows, "conv_id string, turn long, role string, text string")).collect()
    assert len(got) == len(rows)
    by = collections.defaultdict(list)
    for r in got:
        if r["conv_id"] is None or r["turn"] is None:
            assert r["position"] is None
        else:
            by[r["conv_id"]].append((r["position"], r["thread"], r["turn"]))
    for own in by.values():
        own.sort()
        assert [p for p, _, _ in own] == list(range(len(own))) and [k[1:] for k in own] == sorted(k[1:] for k in own)


def test_plain_conversations(spark):
    messages = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")
    got = chat_format.link_quotes(messages)
    assert {(r["conv_id"], r["turn"], r["text"]) for r in got.collect()} == {(r["conv_id"], r["turn"], r["text"]) for r in messages.collect()}
    assert chat_format.link_quotes(messages.limit(0)).count() == 0


def test_pipeline(spark, docs, benchmark):
    import corpus_pipeline

    left, columns = docs, docs.columns
    sizes = [docs.count()]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        left = stage(spark, left, "/root/testdata/sf0.001")
        assert left.columns == columns
        left = spark.createDataFrame(left.collect(), docs.schema)
        sizes.append(left.count())
    assert sizes == sorted(sizes, reverse=True) and sizes[-1] > 0.5 * sizes[0]
    texts = [r["text"].lower() for r in left.collect()]
    assert len(set(texts)) == len(texts)
    run = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert {r["doc_id"] for r in run.select("doc_id").distinct().collect()} == {r["doc_id"] for r in left.collect()}


def test_pipeline_leaves_stages_only(spark):
    import corpus_pipeline
    from trawl.scratch import shared_folder

    folder = pathlib.Path(shared_folder(spark).removeprefix("file://"), "trawl")
    before = set(folder.iterdir()) if folder.exists() else set()
    rows = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    left = sorted(p.name.rsplit("-", 1)[0] for p in set(folder.iterdir()) - before)
    assert left == ["packed", "stage-decontamination", "stage-exact_dedup", "stage-near_dedup", "stage-quality"]
    assert rows.count() == rows.select("doc_id", "start").distinct().count() > 0


def test_entry_registers_every_operator():
    import __spark_entry__

    names = set(__spark_entry__.queries())
    assert {n.split("_")[0] for n in names if n.startswith("op")} == {f"op{i}" for i in range(1, 11)} and "pipeline" in names


@pytest.mark.parametrize("name", ["sharding", "quality"])
def test_modules_import(name):
    assert __import__(f"trawl.llm.{name}")
