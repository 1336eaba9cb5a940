import collections
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from trawl.llm import bitmaps, exact_dedup, graph, near_dedup, skew
from trawl.llm.queries import SQL

from .conftest import SF


def lower(text):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")


def weak(column):
    return F.unhex(F.substring(F.sha2(column, 256), 1, 1 * 2))


def plain_groups(rows):
    groups = collections.defaultdict(list)
    for r in rows:
        groups[lower(r["text"])].append(r["doc_id"])
    return groups


@pytest.mark.parametrize("digest", [exact_dedup.sha256, weak])
@pytest.mark.parametrize("keep", ["min", "max"])
def test_exact_edges(edges, keep, digest):
    groups = plain_groups(edges.collect())
    want = []
    for ids in groups.values():
        known = [i for i in ids if i is not None]
        best = (min if keep == "min" else max)(known) if known else None
        want += [(i, best, len(ids), i == best) for i in ids]
    got = exact_dedup.exact_duplicates(edges, keep=keep, digest=digest).drop("digest").collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    kept = exact_dedup.drop_exact_duplicates(edges, keep=keep, digest=digest)
    assert kept.columns == edges.columns and sorted(lower(r["text"]) for r in kept.collect()) == sorted(groups)


def test_exact_oracle(spark, docs):
    got = exact_dedup.exact_duplicates(docs, keep="max").withColumn("text_sha256", F.lower(F.hex("digest"))).toPandas()
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = con.sql(SQL["op4_exact_dedup"]).df()
    assert sorted(map(tuple, got[want.columns].itertuples(index=False))) == sorted(map(tuple, want.itertuples(index=False)))


def test_index_runs_merge(spark):
    index = exact_dedup.DigestIndex(spark)
    rows = lambda *ids: spark.createDataFrame([(i,) for i in ids], "keep_id long").withColumn("digest", exact_dedup.sha256((F.col("keep_id") % 3).cast("string")))
    index.flush(rows(5, 8, 3))
    assert index.compact().filter("keep_id = 5").first()["n"] == 2
    index.flush(rows(2, 11))
    merged = index.compact()
    assert {(r["keep_id"], r["n"]) for r in merged.collect()} == {(2, 4), (3, 1)}
    assert index.find(merged.first()["digest"]).count() == 1


def test_levels_and_filters(spark, monkeypatch):
    """Runs are compacted level by level; filters hold all digests of their runs."""
    monkeypatch.setattr(exact_dedup, "FANOUT", 2)
    index = exact_dedup.DigestIndex(spark)
    keyed = lambda rows: rows.select(exact_dedup.sha256((F.col("id") % 300).cast("string")).alias("digest"), F.col("id").alias("keep_id"))
    shapes = []
    for k in range(5):
        index.flush(keyed(spark.range(100 * k, 100 * k + 100)))
        shapes.append([len(level) for level in index.levels])
    assert shapes == [[1], [0, 1], [1, 1], [0, 0, 1], [1, 0, 1]]
    assert sum(r.rows.agg(F.sum("n")).first()[0] for r in index.runs) == 500
    marked = index.maybe(keyed(spark.range(300))).groupBy("_maybe").count().collect()
    assert {r["_maybe"]: r["count"] for r in marked} == {True: 300}
    other = spark.range(1000).select(exact_dedup.sha256(F.concat(F.lit("x"), "id")).alias("digest"))
    assert index.maybe(other).filter("_maybe").count() < 500 and index.known(other).isEmpty() and index.known(keyed(spark.range(7))).count() == 7
    merged = {r["keep_id"]: r["n"] for r in index.compact().collect()}
    assert merged == {i: 2 if i < 200 else 1 for i in range(300)} and [len(level) for level in index.levels] == [0, 0, 1]


@pytest.mark.parametrize("digest", [exact_dedup.sha256, weak])
def test_several_memtables(spark, docs, edges, monkeypatch, digest):
    monkeypatch.setattr(exact_dedup, "MEMTABLE_ROWS", 5)
    rows = docs.select("doc_id", "text").limit(60).unionByName(edges.select("doc_id", "text")).repartition(12)
    rows = spark.createDataFrame(rows.unionByName(rows.filter("doc_id % 7 = 0")).collect(), rows.schema).repartition(12)
    groups = plain_groups(rows.collect())
    want = [(i, min((x for x in ids if x is not None), default=None), len(ids)) for ids in groups.values() for i in ids]
    got = exact_dedup.exact_duplicates(rows, digest=digest).select("doc_id", "keep_id", "group_size").collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_bitmap(spark):
    keys = spark.range(0, 1000, 7).select(F.xxhash64("id").alias("h"))
    bits = bitmaps.bits_for(143)
    out = bitmaps.probe(spark.range(1000), F.xxhash64("id"), bitmaps.build(keys, F.col("h"), bits), bits).collect()
    assert all(r["_maybe"] for r in out if r["id"] % 7 == 0) and sum(r["_maybe"] for r in out) < 200


def test_components(spark):
    links = [(i, i + 1) for i in range(100, 160)] + [(1, 9), (9, 5), (5, 1), (7, 7), (None, 3)] + [(1000, i) for i in range(1001, 1200)]
    got = dict(map(tuple, graph.components(spark.createDataFrame(links, "a long, b long")).collect()))
    assert {got[i] for i in range(100, 161)} == {100} and got[9] == got[5] == 1 and {got[i] for i in range(1000, 1200)} == {1000} and 7 not in got
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute(rows, words, percent):
    sets = {}
    for r in rows:
        own = re.findall(r"[^\x20\x09-\x0d]+", lower(r["text"]))
        sets.setdefault(r["doc_id"], frozenset(tuple(own[k : k + words]) for k in range(len(own) - words + 1)) if len(own) >= words else (frozenset([tuple(own)]) if own else frozenset()))
    label = {i: i for i in sets}

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    ids = sorted(sets)
    for x, i in enumerate(ids):
        for j in ids[:x]:
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                a, b = find(i), find(j)
                label[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize(("words", "percent"), [(3, 85), (5, 80)])
def test_near_brute_force(docs, words, percent):
    want = brute(docs.collect(), words, percent)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dedup.near_duplicates(docs, words=words, percent=percent).collect()}
    assert got == want


def test_near_edges(edges, empty):
    rows = near_dedup.near_duplicates(edges, words=3, percent=85).collect()
    assert len(rows) == edges.count()
    got = collections.defaultdict(set)
    for r in rows:
        got[r["doc_id"]].add(r["component_id"])
    assert got[4] == got[5] == got[6] == got[7] == {4} and got[1] == {1} and got[2] == {2} and got[3] == {3} and got[12] == {11}
    assert got[None] == {4, None}
    assert near_dedup.drop_near_duplicates(empty).count() == 0
    left = near_dedup.drop_near_duplicates(edges, words=3, percent=85)
    assert left.columns == edges.columns
    want = [(i, t) for i, t in ((r["doc_id"], r["text"]) for r in edges.collect()) if i not in (5, 6, 7, 12) and not (i is None and t != "only here once")]
    assert sorted(map(str, want)) == sorted(str((r["doc_id"], r["text"])) for r in left.collect())


def texts_of(n, seed=3):
    rng = np.random.default_rng(seed)
    return [" ".join(f"w{x}" for x in rng.integers(0, 10**6, 40)) for _ in range(n)]


def test_ids_that_repeat_or_are_null(spark):
    """Links go by text: an id on two texts hides neither, and copies without id are dropped beside one with an id."""
    a, b, c, d, e, f = texts_of(6)
    rows = [(5, a), (5, b), (9, b + " end"), (None, a + " end"), (None, a), (None, c), (None, c), (None, c + " end"), (7, d), (7, d), (8, e), (8, e + " end"), (3, f), (None, None), (None, ""), (4, None)]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, _set_key string")
    got = sorted(str((r["doc_id"], r["component_id"], r["kept"])) for r in near_dedup.near_duplicates(docs).collect())
    want = [(5, 5, True), (5, 5, True), (9, 5, False), (None, 5, False), (None, 5, False), *[(None, None, True)] * 5, (7, 7, True), (7, 7, True), (8, 8, True), (8, 8, True), (3, 3, True), (4, 4, True)]
    assert got == sorted(map(str, want))
    left = near_dedup.drop_near_duplicates(docs)
    assert left.columns == docs.columns
    left = [(r["doc_id"], r["text"]) for r in left.collect()]
    assert sorted(str(i) for i, _ in left) == sorted(map(str, [5, 5, None, 7, 8, 3, None, None, 4]))
    assert (5, a) in left and (5, b) in left and sum(t in (c, c + " end") for _, t in left) == 1 and sum(t in (e, e + " end") for _, t in left) == 1


def test_a_hot_class_without_ids(spark):
    a, b = texts_of(2)
    docs = spark.createDataFrame([(None, a)] * 300 + [(i, b if i % 2 else b + f" e{i}") for i in range(300)], "doc_id long, text string")
    got = collections.Counter((r["component_id"], r["kept"]) for r in near_dedup.near_duplicates(docs).collect())
    assert got == {(None, True): 300, (0, False): 299, (0, True): 1}
    assert sorted(str(r["doc_id"]) for r in near_dedup.drop_near_duplicates(docs).collect()) == ["0", "None"]


def test_pairs_beside_values_of_hot_ids(spark):
    pairs = [(0, i) for i in range(1, 700)] + [(i, 900) for i in range(800, 899)]
    one = spark.range(1000).selectExpr("id as cid", "id * 10 as v")
    got = skew.beside(spark.createDataFrame(pairs, "a long, b long"), one, "cid", "v", chunk=50).collect()
    assert sorted((r["a"], r["b"]) for r in got) == sorted(pairs) and all(r["x"] == 10 * r["a"] and r["y"] == 10 * r["b"] for r in got)


def test_large_buckets_lose_no_link(spark, monkeypatch):
    """One template with many edited copies: buckets above the small size, in several blocks."""
    monkeypatch.setattr(near_dedup, "BLOCK_ROWS", 16)
    rng = np.random.default_rng(5)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(150):
        own = list(base)
        for at in rng.integers(0, 120, rng.integers(0, 9)):
            own[at] = f"e{rng.integers(0, 10**9)}"
        rows.append((i, " ".join(own)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute(docs.collect(), 3, 85)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dedup.near_duplicates(docs, words=3, percent=85).collect()}
    assert got == want and 1 < len({c for _, c in want.values()}) < 150


def test_banding():
    for percent in (80, 85, 90, 100):
        bands, rows = near_dedup.banding(percent)
        assert (1 - (percent / 100) ** rows) ** bands <= near_dedup.MISS * 1.01 and bands * rows <= near_dedup.MOST_HASHES
    looks = near_dedup.least_matches(85, 180)
    assert looks[-1][0] == 180 and all(m < 0.85 * n for n, m in looks)
