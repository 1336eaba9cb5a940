"""Search against a row-at-a-time model of the same rules."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from trawl.functions import columns as fn
from trawl.model import CATALOG, Filters, Query, SortField, SortOrder
from trawl.operators import catalog_ops, search, trigrams
from trawl.operators.filters import excluded, glob
from trawl.plans.dsl import normalise, parse

NOW = datetime(2024, 1, 31, 12)
NAMES = ["main", "main.rs", "mainframe", "domain.txt", "a", "ab", "a ", "", "abcxbcd", "MAIN.RS", "rs", "x rs y", "straße.md", "README", ".bashrc", "foo.", "..foo", "a.tar.gz", "conf.d"]
AGES = [timedelta(0), timedelta(days=7), timedelta(days=7, hours=23, minutes=59, seconds=59), timedelta(days=8), timedelta(days=30, hours=23), timedelta(days=31), timedelta(days=-3)]


def ext(name):
    head, dot, tail = name.rpartition(".")
    return tail.lower() if dot and head and tail else ""


@pytest.fixture(scope="module")
def rows():
    return [(i, n, f"/x/{'abcd' if i % 2 else 'y'}/{n}", ext(n), i * 10, NOW - AGES[i % len(AGES)], i % 5 == 4, None) for i, n in enumerate(NAMES)]


@pytest.fixture(scope="module")
def catalog(spark, rows):
    return spark.createDataFrame(rows, CATALOG).cache()


def model(rows, keywords):
    out = []
    for i, name, path, _, _, at, _, _ in rows:
        low, tiers = name.lower(), []
        key = low.ljust(3) if 0 < len(low) < 3 else low
        stem = low.rpartition(".")[0] if "." in low else low
        for k in keywords:
            if not all(c in key for c in trigrams.codes_of(k)):
                tiers.append(0)
            else:
                tiers.append(100 if low == k else 90 if stem == k else 75 if low.startswith(k) else 50 if k in low else 25 if k in path.lower() else 0)
        if all(tiers):
            age = int((NOW - at).total_seconds() / 86400)
            out.append((i, (sum(tiers) / len(tiers) if tiers else 1.0) * (1.10 if age <= 7 else 1.05 if age <= 30 else 1.0)))
    return sorted(out, key=lambda x: (-x[1], x[0]))


@pytest.mark.parametrize("raw", ["main", "rs", "a", "ab", "abcd", "main rs", "x", "straße", "zzz", "", "README", "foo"])
def test_scores(catalog, rows, raw):
    q = normalise(parse(raw))
    got = [(r["id"], r["score"]) for r in search.search(catalog, q, NOW).collect()]
    assert got == pytest.approx(model(rows, q.keywords)) if not got else [g[0] for g in got] == [m[0] for m in model(rows, q.keywords)]
    assert [g[1] for g in got] == pytest.approx([m[1] for m in model(rows, q.keywords)])


def test_filters(catalog):
    ids = lambda raw: {r["id"] for r in search.search(catalog, normalise(parse(raw)), NOW).collect()}
    assert ids("size:>50") == {r for r in range(len(NAMES)) if r * 10 >= 50}
    assert ids("size:<50") == {r for r in range(len(NAMES)) if r * 10 <= 50}
    assert ids("size:50") == {5} and ids("size:>18446744073709551615") == set()
    assert ids("size:<18446744073709551615") == set(range(len(NAMES)))
    assert ids("ext:rs") == {1, 9} and ids("ext:") == set() and ids("type:dir") == {4, 9, 14}
    assert ids("path:ABCD") == {i for i, n in enumerate(NAMES) if i % 2 or "abcd" in n}


def test_sorts(catalog):
    def ids(field, order):
        return [r["id"] for r in search.ranked(search.matches(catalog, Query()), Query(sort_by=field, sort_order=order, limit=100), NOW).collect()]

    assert ids(SortField.SIZE, SortOrder.ASCENDING) == list(range(len(NAMES)))
    assert ids(SortField.SIZE, SortOrder.DESCENDING) == list(range(len(NAMES)))[::-1]
    by_name = sorted(range(len(NAMES)), key=lambda i: (NAMES[i].lower().encode(), i))
    assert ids(SortField.NAME, SortOrder.ASCENDING) == by_name and ids(SortField.NAME, SortOrder.DESCENDING) == by_name[::-1]


def test_trigrams(spark):
    assert trigrams.codes_of("hello") == ["ell", "hel", "llo"] == trigrams.codes_of("HELLO")
    assert trigrams.codes_of("a") == ["a  "] and trigrams.codes_of("") == []
    rows = spark.createDataFrame([(1, "main.rs"), (2, "main.py"), (3, "lib.rs"), (4, "maintenance.log"), (5, ""), (6, "a")], "id long, name string")
    table = trigrams.postings(rows)
    assert {r["id"] for r in trigrams.candidates(table, "main").collect()} == {1, 2, 4}
    assert {r["id"] for r in trigrams.candidates(table, "a").collect()} == {6}
    assert {r["id"] for r in rows.withColumn("name_key", fn.name_key(rows.name)).filter(trigrams.contains_all("main")).collect()} == {1, 2, 4}


def test_functions(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(n,) for n in NAMES], "name string")
    assert [r[0] for r in df.select(fn.extension(F.col("name"))).collect()] == [ext(n) for n in NAMES]
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(fn.parent(F.lit("/foo"))) == "" and one(fn.parent(F.lit("/a/b\\c"))) == "/a/b" and one(fn.display_parent(F.lit("/foo"))) == "/foo"
    assert one(fn.format_size(F.lit(1536).cast("long"))) == "1.50 KB" and one(fn.format_size(F.lit(0).cast("long"))) == "0 B"
    assert one(fn.from_file_time(F.lit(116_444_736_000_000_010).cast("long"))) == datetime(1970, 1, 1, 0, 0, 0, 1)
    text = "The quick systems language Rust is fast and reliable for programs"
    assert one(fn.snippet(F.lit(text), "rust", 10)) == "...systems language Rust is fast and..." and one(fn.snippet(F.lit(text), "java")) is None
    assert one(excluded(F.lit("/a/.Git/b"), [".git"])) and not one(excluded(F.lit("/a/x.git/b"), [".git"]))
    assert one(glob(F.lit("ab.txt"), "*.txt")) and one(glob(F.lit("ab.txt"), "ab*")) and not one(glob(F.lit("ab.txt"), "AB*"))


def test_catalog_ops(spark, catalog):
    assert [r["id"] for r in catalog_ops.by_ids(catalog, [5, 2, 5, 999]).orderBy("at").collect()] == [5, 2, 5]
    assert catalog_ops.by_ids(catalog, []).count() == 0
    new = catalog.limit(1).selectExpr("1000 as id", "name", "path", "extension", "size", "modified", "is_dir", "content_hash")
    out = catalog_ops.upsert(catalog, new)
    assert out.count() == len(NAMES) and out.filter("id = 1000").count() == 1
    assert catalog_ops.remove(catalog, new).count() == len(NAMES) - 1 and catalog_ops.contains(catalog, "/x/y/main")
    s = catalog_ops.index_stats(catalog).first()
    assert (s["total_documents"], s["total_directories"], s["total_size"]) == (len(NAMES), 3, sum(i * 10 for i in range(len(NAMES))))
    assert search.search(catalog, Query(filters=Filters(), limit=3), NOW).count() == 3


def test_fold(spark):
    at = datetime(2024, 1, 1)
    rows = [("Added", "/a", None, at, 1), ("Removed", "/a", None, at, 2), ("Added", "/a", None, at, 3), ("Renamed", "/c", "/b", at, 4), ("Added", "/b", None, at, 1), ("Removed", "/zzz", None, at, 9)]
    changes = spark.createDataFrame(rows, "event string, path string, origin string, at timestamp_ntz, seq long")
    assert {(r["path"], r["event"]) for r in catalog_ops.fold_changes(changes).collect()} == {("/a", "Added"), ("/b", "Removed"), ("/c", "Added"), ("/zzz", "Removed")}


def brute_snippet(text, keyword, context=60):
    """The snippet from plain loops over characters."""
    owner = [i for i, c in enumerate(text) for _ in c.lower()]
    low = "".join(c.lower() for c in text)
    at = low.find(keyword)
    if at < 0:
        return None
    first, last = max(owner[at] - context, 0), min(owner[at + len(keyword) - 1] + context, len(text) - 1)
    back = next((i for i in range(first - 1, -1, -1) if text[i].isspace()), None)
    ahead = next((i for i in range(last + 1, len(text)) if text[i].isspace()), None)
    first = first if back is None else back + 1
    last = last if ahead is None else ahead - 1
    return ("..." if first > 0 else "") + text[first : last + 1].strip() + ("..." if last < len(text) - 1 else "")


def test_snippets_of_any_text(spark):
    """Characters whose lower case is longer, long words around the cut, and matches at both ends."""
    dotted = "\u0130"
    texts = [dotted * 30 + " before the word " + dotted * 90, dotted + "THE end", "the", "x" * 1000 + " the " + "y" * 1000, "x" * 1000 + "the" + "y" * 1000, "ab " * 200 + "x" * 300 + "The" + "z" * 300 + " cd" * 200]
    texts += ["none", "", "a\u2003b " * 40 + "tHe" + " c\nd" * 40, "the " * 50, "q" * 70 + " the", "\U0001f600 " * 50 + "the" + " \U0001f600" * 50, ("i\u0307" + dotted) * 40 + " the x"]
    for keyword in ("the", "e e", "i\u0307"):
        rows = spark.createDataFrame(list(enumerate(texts)), "id int, content string").select("id", fn.snippet(F.col("content"), keyword).alias("s")).collect()
        assert {r["id"]: r["s"] for r in rows} == {i: brute_snippet(t, keyword) for i, t in enumerate(texts)}
