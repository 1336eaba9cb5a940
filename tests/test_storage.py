import json
import os

import pytest

from trawl.catalog import Catalog
from trawl.config import Config
from trawl.model import ConfigError, ScanError
from trawl.operators.hierarchy import resolve_paths
from trawl.plugins import Registry
from trawl.sources import files, storage
from trawl.streaming import changes


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "tree"
    (root / "src" / ".git").mkdir(parents=True)
    (root / "src" / "main.rs").write_text("fn main() { hello world }")
    (root / "src" / ".git" / "x.txt").write_text("x")
    (root / "notes.md").write_text("some hello text")
    (root / "bad.txt").write_bytes(b"\xff\xfe")
    os.symlink(root / "src", root / "link")
    os.symlink(root / "gone", root / "broken")
    return root


def test_scan(spark, tree):
    rows = {r["path"].removeprefix(str(tree)): r for r in files.scan(spark, str(tree), [".GIT"]).collect()}
    assert set(rows) == {"", "/src", "/src/main.rs", "/notes.md", "/bad.txt", "/link"}
    assert rows["/link"]["is_dir"] and rows["/src"]["size"] == 0 and rows["/notes.md"]["extension"] == "md"
    assert sorted(r["id"] for r in rows.values()) == list(range(1, 7))
    with pytest.raises(ScanError):
        files.scan(spark, str(tree / "none"))
    assert files.scan_roots(spark, [str(tree), str(tree / "src")], [".git"]).count() == 8
    text = {r["content"] for r in files.contents(files.scan(spark, str(tree), [".git"])).collect()}
    assert text == {"fn main() { hello world }", "some hello text"}


def test_service(spark, tree, tmp_path):
    c = Catalog(spark, str(tmp_path / "home"))
    assert c.stats().first()["total_documents"] == 0
    c.add_directory(str(tree))
    with pytest.raises(ConfigError):
        c.add_directory(str(tree))
    assert c.rebuild().first()["total_files"] == 3
    assert [r["name"] for r in c.search("main ext:rs").collect()] == ["main.rs"]
    hit = c.search("notes content:x").collect()
    assert len(hit) == 1 and hit[0]["snippet"] is None
    (tree / "src" / "new.rs").write_text("new")
    (tree / "notes.md").unlink()
    assert c.upsert_scan(str(tree)).first()["total_files"] == 4  # the vanished file stays
    assert storage.meta(c.index)["generation"] == 2 and storage.size(c.index) > 0
    c.remove_directory(str(tree))
    assert Config.load(c.config_path).directories == []


def test_log(spark, tmp_path):
    lines = ['{"event_type":"Added","path":"/a","timestamp":"2024-01-01T00:00:00Z"}', "", "{broken", '{"event_type":{"Renamed":{"from":"/a"}},"path":"/b","timestamp":"2024-01-02T00:00:00Z"}', '{"event_type":"Odd","path":"/c"}']
    (tmp_path / "log.txt").write_text("\n".join(lines))
    rows = changes.read_log(spark, str(tmp_path / "log.txt")).collect()
    assert [(r["event"], r["path"], r["origin"]) for r in rows] == [("Added", "/a", None), ("Renamed", "/b", "/a")]
    changes.append_log(changes.read_log(spark, str(tmp_path / "log.txt")), str(tmp_path / "copy"))
    assert changes.read_log(spark, str(tmp_path / "copy")).drop("seq").collect() == changes.read_log(spark, str(tmp_path / "log.txt")).drop("seq").collect()


def test_follow(spark, tmp_path, tree):
    from pyspark.sql import functions as F

    store, log = str(tmp_path / "store"), tmp_path / "log"
    log.mkdir()
    base = files.scan(spark, str(tree), [".git"])
    storage.save(base, store)
    (log / "1.txt").write_text(json.dumps({"event_type": "Removed", "path": str(tree / "notes.md"), "timestamp": "2024-01-01T00:00:00Z"}))
    changes.follow(spark, str(log), store, str(tmp_path / "state"), lambda paths: base.join(F.broadcast(paths), "path", "left_semi").select(*base.columns)).awaitTermination()
    assert "notes.md" not in {r["name"] for r in storage.load(spark, store).collect()}


def test_paths(spark):
    rows = [(1, 99, "top", True), (2, 1, "mid", True), (3, 2, "leaf", False), (5, 5, "root", True), (6, 5, "under", False), (7, 8, "x", True), (8, 7, "y", True)]
    rows += [(100 + i, 99 + i if i else 1, f"d{i}", True) for i in range(40)]
    got = {r["file_ref"]: r["path"] for r in resolve_paths(spark.createDataFrame(rows, "file_ref long, parent_ref long, name string, is_dir boolean"), "C:\\", order=None).collect()}
    assert got[3] == "C:\\top\\mid\\leaf" and got[6] == "C:\\under" and 5 not in got and 7 not in got
    assert got[139] == "C:\\top\\" + "\\".join(f"d{i}" for i in range(40))


def test_config(tmp_path):
    path = str(tmp_path / "c.json")
    assert Config.load(path) == Config() and len(Config().content_extensions) == 32
    Config.init(path)
    (tmp_path / "c.json").write_text("{")
    with pytest.raises(ConfigError):
        Config.load(path)


def test_plugins(spark):
    class Bad:
        name, version = "bad", "1"

        def init(self):
            raise ValueError

    class Hook(Bad):
        name = "hook"

        def init(self): ...

        def on_index(self, rows):
            raise ValueError

        def on_search(self, query, results):
            return results.limit(1)

        def shutdown(self): ...

    r = Registry()
    assert not r.register(Bad()) and r.register(Hook()) and len(r) == 1
    assert r.on_index(spark.range(3)).count() == 3 and r.on_search(None, spark.range(3)).count() == 1
    r.shutdown()
    assert len(r) == 0


def test_volumes(spark, tmp_path):
    (tmp_path / "mounts").write_text("proc /proc proc rw 0 0\n/dev/sda / ext4 rw 0 0\n/dev/sdb none ext4 rw 0 0\nshort line\n")
    assert [tuple(r) for r in files.volumes(spark, str(tmp_path / "mounts")).collect()] == [("/", "ext4")]


def test_paths_of_a_wide_directory_and_below_cycles(spark, monkeypatch):
    """Most rows in one directory, the last of repeated records, a deep chain that is cut and rows below a cycle."""
    from trawl.operators import hierarchy

    monkeypatch.setattr(hierarchy, "WIDE", 4)
    rows = [(1, 99, "top", 0), (2, 1, "old", 0), (2, 1, "wide", 1)] + [(10_000 + i, 2, f"f{i}", 0) for i in range(3000)]
    rows += [(20_000 + i, 20_001 + i if i < 2 else 20_000, f"c{i}", 0) for i in range(3)] + [(20_010, 20_000, "below", 0), (20_011, 20_010, "lower", 0)]
    rows += [(30_000 + i, 29_999 + i if i else 1, f"d{i}", 0) for i in range(600)] + [(5, 5, "root", 0), (6, 5, "under", 0)]
    got = {r["file_ref"]: (r["path"], r["depth"]) for r in resolve_paths(spark.createDataFrame(rows, "file_ref long, parent_ref long, name string, seq long"), "C:\\").collect()}
    assert got[10_007] == ("C:\\top\\wide\\f7", 3) and got[6] == ("C:\\under", 1) and not any(20_000 <= i < 30_000 for i in got) and 5 not in got
    assert max(d for _, d in got.values()) == hierarchy.DEPTH + 1 and got[30_511][1] == 513 and 30_512 not in got


def test_walk_in_parts(tmp_path):
    """The parts of a walk give each entry once, whatever their number."""
    for a in range(4):
        for b in range(3):
            (tmp_path / f"a{a}" / f"b{b}").mkdir(parents=True)
            (tmp_path / f"a{a}" / f"b{b}" / "x.txt").write_text("x")
    os.symlink(tmp_path / "a0", tmp_path / "link")
    want = sorted(files.walk(str(tmp_path)))
    for n in (1, 2, 5, 300):
        parts = files.split([str(tmp_path)], n)
        assert sorted(r for p in parts for r in files.walk(p.folder, (), p.own, p.deep)) == want and len(parts) >= min(n, 17)


def test_progress_counters_and_remembered_searches(spark, tree, tmp_path):
    c, said = Catalog(spark, str(tmp_path / "home")), []
    c.on_progress = lambda phase, done, message: said.append((phase, done))
    c.add_directory(str(tree))
    c.config.excluded_patterns = [".git"]
    c.rebuild()
    assert said == [("rebuild", False), ("rebuild", True)] and c.last_scan == {"indexed": 6, "skipped": 2, "error": 1}
    first = c.search("notes", as_of="2024-01-01")
    assert c.search("notes", as_of="2024-01-01") is first and c.search("notes") is not first
    hit = c.search("notes content:x", as_of="2024-01-01").collect()
    assert [r["score"] for r in hit] == [r["score"] for r in first.collect()]
    c.upsert_scan(str(tree / "src"))
    assert c.search("notes", as_of="2024-01-01") is not first


def test_changes_rewrite_their_buckets_alone(spark, tmp_path, tree):
    store = str(tmp_path / "store")
    rows = files.scan(spark, str(tree), [".git"])
    storage.save(rows, store)
    before = storage.meta(store)
    gone = spark.createDataFrame([(str(tree / "notes.md"),)], "path string")
    after = storage.replace(store, gone, lambda r: r.join(gone, "path", "left_anti").select(*r.columns))
    changed = {b for b in before["segments"] if before["segments"][b] != after["segments"].get(b)}
    assert len(changed) == 1 and after["doc_count"] == before["doc_count"] - 1
    assert {r["name"] for r in storage.load(spark, store).collect()} == {r["name"] for r in rows.collect()} - {"notes.md"}
    assert storage.replace(store, gone.limit(0), None) == after
    storage.delete(store)
    assert not storage.exists(store) and storage.size(store) == 0


def test_filters_reach_the_scan_of_a_stored_catalog(spark, tmp_path, tree):
    from trawl.operators import search
    from trawl.plans import dsl

    storage.save(files.scan(spark, str(tree)), str(tmp_path / "s"))
    query = dsl.normalise(dsl.parse("main ext:rs size:>1 path:/SRC modified:>2001-01-01"))
    formatted = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    plan = search.matches(storage.load(spark, str(tmp_path / "s")), query)._jdf.queryExecution().explainString(formatted)
    pushed = plan[plan.index("PushedFilters") :]
    assert all(x in pushed for x in ("EqualTo(extension,rs)", "GreaterThanOrEqual(size,1)", "StringContains(path_lower,/src)", "StringContains(name_key,mai)", "GreaterThanOrEqual(modified"))


def test_contents_that_have_grown(spark, tmp_path):
    (tmp_path / "a.txt").write_text("12345")
    rows = spark.createDataFrame([(1, str(tmp_path / "a.txt"), "txt", 3, False)], "id long, path string, extension string, size long, is_dir boolean")
    assert files.contents(rows, max_size=4).count() == 0 and files.contents(rows, max_size=5).first()["content"] == "12345"


def test_a_cluster_needs_a_shared_folder(spark):
    from types import SimpleNamespace

    from trawl.model import IndexStorageError
    from trawl.scratch import shared_folder

    def session(master):
        return SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=SimpleNamespace(master=master))

    assert shared_folder(session("local[2]")).startswith("file://")
    for master in ("yarn", "spark://host:7077", "local-cluster[2,1,1024]"):
        with pytest.raises(IndexStorageError):
            shared_folder(session(master))
