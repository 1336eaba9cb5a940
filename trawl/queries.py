"""Registered queries of the search engine, each with its SQL."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trawl import fixtures as fx
from trawl.functions import columns as fn
from trawl.model import SortField, SortOrder
from trawl.operators import catalog_ops, search, trigrams
from trawl.operators.filters import excluded, glob
from trawl.operators.hierarchy import clean_records, resolve_paths
from trawl.plans import dsl
from trawl.scratch import new_path
from trawl.sources import files, storage
from trawl.sources import records as volume_records
from trawl.streaming import changes as log

QUERIES: dict = {}
SQL: dict[str, str] = {}

_CATALOG = f"""
  f AS (SELECT doc_id AS id, lang, source, CASE doc_id % 5 WHEN 0 THEN 'txt' WHEN 1 THEN 'md' WHEN 2 THEN 'json' WHEN 3 THEN 'log' ELSE 'bin' END AS extension,
               CAST(octet_length(encode(text)) AS BIGINT) AS size, TIMESTAMP '{fx.BASE}' - to_hours(CAST(doc_id % 1200 AS INTEGER)) AS modified FROM documents),
  base AS (SELECT id, source || '_' || id || '.' || extension AS name, '/corpus/' || lang || '/' || source || '/' || source || '_' || id || '.' || extension AS path, extension, size, modified, false AS is_dir FROM f
           UNION ALL
           SELECT 1000000000 + row_number() OVER (ORDER BY lang, source), source, '/corpus/' || lang || '/' || source, '', 0, TIMESTAMP '{fx.BASE}', true FROM (SELECT DISTINCT lang, source FROM documents))"""
_DERIVED = """
  cat AS (SELECT *, lower(name) AS nl, lower(path) AS pl, regexp_replace(lower(name), '[.][^.]*\\z', '') AS stem,
                 CASE WHEN length(name) BETWEEN 1 AND 2 THEN rpad(lower(name), 3, ' ') ELSE lower(name) END AS nk FROM base)"""
_PARTS = """
  base AS (SELECT p_partkey AS id, p_name AS name, '/parts/' || p_brand || '/' || p_name AS path, '' AS extension, CAST(p_size AS BIGINT) AS size,
                  TIMESTAMP '2024-01-31 00:00:00' AS modified, false AS is_dir FROM part)"""
_SHOWN = ["id", "name", "path", "size", "score", "rank"]


def _search_sql(keywords=(), where="true", order="score DESC, id", boosted=True, base=_CATALOG) -> str:
    tests, tiers = [], []
    for k in keywords:
        tests += [f"contains(nk, '{c}')" for c in trigrams.codes_of(k)]
        tiers.append(f"CASE WHEN nl = '{k}' THEN 100 WHEN stem = '{k}' THEN 90 WHEN starts_with(nl, '{k}') THEN 75 WHEN contains(nl, '{k}') THEN 50 WHEN contains(pl, '{k}') THEN 25 ELSE 0 END")
    mean = f"({' + '.join(f'CAST({t} AS DOUBLE)' for t in tiers)}) / {len(tiers)}::DOUBLE" if tiers else "1::DOUBLE"
    least = f"least({', '.join(tiers)}, 100) > 0" if tiers else "true"
    boost = f"CASE WHEN datesub('day', modified, TIMESTAMP '{fx.AS_OF}') <= 7 THEN 1.10::DOUBLE WHEN datesub('day', modified, TIMESTAMP '{fx.AS_OF}') <= 30 THEN 1.05::DOUBLE ELSE 1::DOUBLE END" if boosted else "1::DOUBLE"
    return f"""WITH {base}, {_DERIVED},
      hit AS (SELECT *, ({mean}) * {boost} AS score FROM cat WHERE {' AND '.join([*tests, where, least])}),
      top AS (SELECT *, row_number() OVER (ORDER BY {order}) AS rank FROM hit)
      SELECT id, name, path, size, score, CAST(rank AS BIGINT) AS rank FROM top WHERE rank <= 500"""


def _shown(rows: DataFrame, order: list) -> DataFrame:
    """The limited rows with their rank; the window runs over at most a result's limit."""
    from pyspark.sql import Window

    return rows.withColumn("rank", F.row_number().over(Window.orderBy(*order)).cast("long")).select(*_SHOWN)


def _search(raw: str, base=fx.catalog):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        query = dsl.normalise(dsl.parse(raw))
        return _shown(search.search(base(spark, sf_dir), query, fx.AS_OF), [F.desc("score"), F.asc("id")])

    return run


def _add(name: str, query, sql: str) -> None:
    QUERIES[name], SQL[name] = query, sql


for _name, _raw, _words, _where, _base in (
    ("search_keyword", "src1", ["src1"], "true", fx.catalog),
    ("search_mixed", "src1 path:/en/ size:>100", ["src1"], "contains(pl, '/en/') AND size >= 100", fx.catalog),
    ("search_multi_keyword", "src json", ["src", "json"], "true", fx.catalog),
    ("search_short_keyword", "sr", ["sr"], "true", fx.catalog),
    ("search_directory_keyword", "corpus", ["corpus"], "true", fx.catalog),
    ("search_trigram_false_positive", "src10_1", ["src10_1"], "true", fx.catalog),
    ("search_match_all", "", [], "true", fx.catalog),
    ("search_phrase", '"widget" old', ["widget", "old"], "true", fx.parts),
    ("filter_ext", "ext:..MD", [], "extension = 'md'", fx.catalog),
    ("filter_ext_unknown", "ext:xyz", [], "extension = 'xyz'", fx.catalog),
    ("filter_path", "path:/FR/src1", [], "contains(pl, '/fr/src1')", fx.catalog),
    ("filter_size_min", "size:>2000", [], "size >= 2000", fx.catalog),
    ("filter_size_max", "size:<500", [], "size <= 500", fx.catalog),
    ("filter_size_exact", "size:0", [], "size = 0", fx.catalog),
    ("filter_modified_after", "modified:>2024-01-20", [], "modified >= TIMESTAMP '2024-01-20'", fx.catalog),
    ("filter_modified_before", "modified:<2024-01-05", [], "modified <= TIMESTAMP '2024-01-05'", fx.catalog),
    ("filter_modified_day", "modified:2024-01-10", [], "modified >= TIMESTAMP '2024-01-10' AND modified <= TIMESTAMP '2024-01-11'", fx.catalog),
    ("filter_modified_unpadded", "modified:>2024-1-5", [], "modified >= TIMESTAMP '2024-01-05'", fx.catalog),
    ("filter_prefix_in_capitals", "EXT:Md SIZE:>100", [], "extension = 'md' AND size >= 100", fx.catalog),
    ("filter_last_term_counts", "ext:md ext:txt size:>10 size:>900", [], "extension = 'txt' AND size >= 900", fx.catalog),
    ("filter_quoted_term", '"path:/en/src1"', [], "contains(pl, '/en/src1')", fx.catalog),
    ("filter_type_file", "type:file", [], "NOT is_dir", fx.catalog),
    ("filter_type_dir", "type:folder", [], "is_dir", fx.catalog),
):
    _add(_name, _search(_raw, _base), _search_sql(_words, _where, base=_CATALOG if _base is fx.catalog else _PARTS))


def _sorted(field: SortField, order: SortOrder, columns: list):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        query = replace(dsl.normalise(dsl.parse("")), sort_by=field, sort_order=order)
        return _shown(search.search(fx.catalog(spark, sf_dir), query, fx.AS_OF), columns)

    return run


def sort_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sorted(SortField.NAME, SortOrder.ASCENDING, [F.lower("name"), F.asc("id")])(spark, sf_dir)


def sort_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sorted(SortField.PATH, SortOrder.ASCENDING, [F.asc("path"), F.asc("id")])(spark, sf_dir)


def sort_size_desc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sorted(SortField.SIZE, SortOrder.DESCENDING, [F.desc("size"), F.desc("id")])(spark, sf_dir)


def sort_modified(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sorted(SortField.MODIFIED, SortOrder.ASCENDING, [F.asc("modified"), F.asc("id")])(spark, sf_dir)


for _f, _order in ((sort_name, "nl, id"), (sort_path, "path, id"), (sort_size_desc, "size DESC, id DESC"), (sort_modified, "modified, id")):
    _add(_f.__name__, _f, _search_sql(order=_order, boosted=False))


def exclude_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.catalog(spark, sf_dir).filter(~excluded(F.col("path"), ["EN", "src3"])).select("id", "path")


_add("exclude_components", exclude_components, f"WITH {_CATALOG} SELECT id, path FROM base WHERE NOT list_has_any(string_split(lower(path), '/'), ['en', 'src3'])")

_CODES = "list_distinct(list_transform(range(1, length(nk) - 1), lambda i: substr(nk, i, 3)))"


def trigram_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trigrams.postings(fx.parts(spark, sf_dir)).groupBy("trigram").agg(F.count("*").alias("n"), F.min("id").alias("first_id"), F.max("id").alias("last_id"))


_add("trigram_postings", trigram_postings, f"WITH {_PARTS}, {_DERIVED}, p AS (SELECT unnest({_CODES}) AS trigram, id FROM cat) SELECT trigram, count(*) AS n, min(id) AS first_id, max(id) AS last_id FROM p GROUP BY trigram")


def trigram_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trigrams.candidates(trigrams.postings(fx.parts(spark, sf_dir)), "widget")


_add("trigram_candidates", trigram_candidates, f"WITH {_PARTS}, {_DERIVED} SELECT id FROM cat WHERE list_has_all({_CODES}, ['wid', 'idg', 'dge', 'get'])")


def trigram_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trigrams.stats(trigrams.postings(fx.parts(spark, sf_dir)))


_add("trigram_stats", trigram_stats, f"WITH {_PARTS}, {_DERIVED}, p AS (SELECT unnest({_CODES}) AS trigram FROM cat) SELECT count(DISTINCT trigram) AS trigram_count, count(*) AS posting_count FROM p")


def index_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog_ops.index_stats(fx.catalog(spark, sf_dir))


_add(
    "index_stats",
    index_stats,
    f"""WITH {_CATALOG}, {_DERIVED}, p AS (SELECT unnest({_CODES}) AS trigram FROM cat)
    SELECT count(*) AS total_documents, count(*) FILTER (NOT is_dir) AS total_files, count(*) FILTER (is_dir) AS total_directories, CAST(sum(size) AS BIGINT) AS total_size,
           count(DISTINCT extension) FILTER (extension <> '') AS extension_count, (SELECT count(DISTINCT trigram) FROM p) AS trigram_count, (SELECT count(*) FROM p) AS posting_count, 1::BIGINT AS segment_count FROM cat""",
)


def extension_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog_ops.extension_groups(fx.catalog(spark, sf_dir))


_add("extension_groups", extension_groups, f"WITH {_CATALOG} SELECT extension, count(*) AS n, min(id) AS first_id, max(id) AS last_id, CAST(sum(size) AS BIGINT) AS total_size FROM base WHERE extension <> '' GROUP BY extension")


def derived_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names, extensions and parents of the URLs of pages."""
    path = F.regexp_replace("url", r"[?#].*\z", "")
    rows = fx.table(spark, sf_dir, "pages").select("page_id", path.alias("path"))
    name = fn.file_name(F.col("path"))
    return rows.select("page_id", name.alias("name"), fn.extension(name).alias("extension"), fn.parent(F.col("path")).alias("parent"), fn.stem(name).alias("stem"), fn.unix_path(F.col("path")).alias("unix_path"))


_add(
    "derived_columns",
    derived_columns,
    r"""WITH p AS (SELECT page_id, regexp_replace(url, '[?#].*\z', '') AS path FROM pages), n AS (SELECT *, regexp_extract(path, '([^/\\]*)\z', 1) AS name FROM p)
    SELECT page_id, name, lower(regexp_extract(name, '^.+\.([^.]*)\z', 1)) AS extension, regexp_extract(path, '^(.*)[/\\]', 1) AS parent, regexp_replace(lower(name), '[.][^.]*\z', '') AS stem, replace(path, '\', '/') AS unix_path FROM n""",
)


def format_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.file_rows(spark, sf_dir).select("id", "size", fn.format_size(F.col("size")).alias("shown"))


_add("format_size", format_size, f"WITH {_CATALOG} SELECT id, size, CASE WHEN size >= 1048576 THEN printf('%.2f MB', size / 1048576.0::DOUBLE) WHEN size >= 1024 THEN printf('%.2f KB', size / 1024.0::DOUBLE) ELSE size || ' B' END AS shown FROM base WHERE NOT is_dir")


def snippet(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fx.contents(spark, sf_dir).filter(F.lower("content").contains("the"))
    return rows.select("id", fn.snippet(F.col("content"), "the").alias("snippet"))


_add(
    "snippet",
    snippet,
    r"""WITH a AS (SELECT doc_id AS id, text AS c, instr(lower(text), 'the') AS pos, length(text) AS n FROM documents WHERE contains(lower(text), 'the')),
    b AS (SELECT *, greatest(pos - 60, 1) AS s, least(pos + 62, n) AS e FROM a), w AS (SELECT *, substr(c, 1, s - 1) AS head, substr(c, e + 1) AS tail FROM b),
    m AS (SELECT *, length(regexp_extract(head, '([^\s]*)\z', 1)) AS back, length(regexp_extract(tail, '^([^\s]*)', 1)) AS ahead FROM w),
    x AS (SELECT *, CASE WHEN back < length(head) THEN s - back ELSE s END AS s2, CASE WHEN ahead < length(tail) THEN e + ahead ELSE e END AS e2 FROM m)
    SELECT id, CASE WHEN s2 > 1 THEN '...' ELSE '' END || regexp_replace(substr(c, s2, e2 - s2 + 1), '^\s+|\s+\z', '', 'g') || CASE WHEN e2 < n THEN '...' ELSE '' END AS snippet FROM x""",
)


def search_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A search with content: snippets are made for the limited rows only."""
    query = dsl.normalise(dsl.parse("src1 ext:md content:yes"))
    out = search.search(fx.catalog(spark, sf_dir), query, fx.AS_OF, fx.contents(spark, sf_dir))
    return out.select("id", "score", F.col("snippet").isNotNull().alias("has_snippet"))


_add("search_content", search_content, f"WITH q AS ({_search_sql(['src1'], 'extension = chr(109) || chr(100)')}) SELECT q.id, q.score, contains(lower(d.text), 'src1') AS has_snippet FROM q JOIN documents d ON d.doc_id = q.id")


def point_lookup_ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog_ops.by_ids(fx.catalog(spark, sf_dir), [7, 3, 7, 99_999_999, 11]).select(F.col("at").cast("long").alias("at"), "id", "path")


_add("point_lookup_ordered", point_lookup_ordered, f"WITH {_CATALOG}, w AS (SELECT unnest([7, 3, 7, 99999999, 11]) AS id, unnest(range(0, 5)) AS at) SELECT w.at, base.id, base.path FROM w JOIN base ON base.id = w.id")


def union_roots_keep_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fx.catalog(spark, sf_dir)
    inner = rows.filter(F.col("path_lower").startswith("/corpus/en/"))
    return catalog_ops.union_roots([rows, inner]).groupBy("path").agg(F.count("*").alias("n"))


_add("union_roots_keep_duplicates", union_roots_keep_duplicates, f"WITH {_CATALOG} SELECT path, count(*) AS n FROM (SELECT path FROM base UNION ALL SELECT path FROM base WHERE starts_with(lower(path), '/corpus/en/')) GROUP BY path")


def mft_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve_paths(fx.records(spark, sf_dir), "C:\\").select("file_ref", "path", F.col("depth").cast("long").alias("depth"))


_RECORDS = r"""all_r AS (SELECT r_regionkey::BIGINT AS file_ref, -1::BIGINT AS parent_ref, r_name AS name, true AS is_dir, 0 AS seq FROM region UNION ALL SELECT 100 + n_nationkey, n_regionkey, n_name, true, 0 FROM nation
        UNION ALL SELECT 10000 + c_custkey, 100 + c_nationkey, c_name, false, 1 FROM customer UNION ALL SELECT 10000 + c_custkey, 0, 'old ' || c_name, false, 0 FROM customer WHERE c_custkey % 10 = 0
        UNION ALL SELECT 5000000 + s_suppkey, 5, s_name || '.TXT', false, 0 FROM supplier UNION ALL SELECT 5, 5, 'root', true, 0),
    r AS (SELECT file_ref, arg_max(parent_ref, seq) AS parent_ref, arg_max(name, seq) AS name, bool_or(is_dir) AS is_dir FROM all_r GROUP BY file_ref),
    t AS (SELECT file_ref, name AS path, 1::BIGINT AS depth, name, is_dir FROM r WHERE file_ref <> parent_ref AND parent_ref NOT IN (SELECT file_ref FROM r WHERE file_ref <> parent_ref)
          UNION ALL SELECT r.file_ref, t.path || '\' || r.name, t.depth + 1, r.name, r.is_dir FROM r JOIN t ON r.parent_ref = t.file_ref WHERE r.file_ref <> r.parent_ref)"""
_add("mft_paths", mft_paths, rf"WITH RECURSIVE {_RECORDS} SELECT file_ref, 'C:\' || path AS path, depth FROM t")


def mft_volumes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two volumes of the same records, one without files, and without a nation whose name is excluded."""
    rows = fx.records(spark, sf_dir)
    out = volume_records.scan_volumes({"C": rows, "D": rows.filter("is_dir")}, ["France"])
    return out.select("id", "name", "path", "extension", "size", "is_dir", F.col("modified").isNotNull().alias("has_time"))


_add(
    "mft_volumes",
    mft_volumes,
    rf"""WITH RECURSIVE {_RECORDS}, v AS (SELECT *, 'C:\' || path AS full_path FROM t UNION ALL SELECT *, 'D:\' || path FROM t WHERE is_dir)
    SELECT file_ref AS id, name, full_path AS path, CASE WHEN name LIKE '%.TXT' THEN 'txt' ELSE '' END AS extension, 0::BIGINT AS size, is_dir, true AS has_time FROM v WHERE NOT list_contains(string_split(lower(full_path), '\'), 'france')""",
)


def mft_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References whose upper bits hold something else, and names that don't count."""
    name = F.when(F.col("n_nationkey") == 3, ".").when(F.col("n_nationkey") == 4, "..").when(F.col("n_nationkey") == 5, "").otherwise(F.col("n_name"))
    upper = F.col("n_regionkey").cast("long") * F.lit(1 << 48)
    rows = fx.table(spark, sf_dir, "nation").select((F.col("n_nationkey") + upper).alias("file_ref"), (F.col("n_regionkey") + upper).alias("parent_ref"), name.alias("name"))
    return clean_records(rows)


_add("mft_clean", mft_clean, "SELECT n_nationkey::BIGINT AS file_ref, n_regionkey::BIGINT AS parent_ref, n_name AS name FROM nation WHERE n_nationkey NOT IN (3, 4, 5)")


def mft_timestamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    ticks = (F.col("o_orderkey") * 12_345_678_901 + 116_444_736_000_000_000).cast("long")
    at = fn.from_file_time(ticks)
    return fx.table(spark, sf_dir, "orders").select("o_orderkey", F.date_format(at.cast("timestamp_ntz"), "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("at"))


_add("mft_timestamps", mft_timestamps, "SELECT o_orderkey, strftime(make_timestamp(o_orderkey * 12345678901 // 10), '%Y-%m-%d %H:%M:%S.%f') AS at FROM orders")

_LAST = "SELECT '/users/' || user_id AS path, arg_max(CASE event_type WHEN 'signup' THEN 'Added' WHEN 'error' THEN 'Removed' ELSE 'Modified' END, (ts, event_id)) AS event, arg_max(event_id, (ts, event_id)) AS seq FROM events GROUP BY user_id"


def wal_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog_ops.fold_changes(fx.changes(spark, sf_dir)).select("path", "event", "seq")


_add("wal_fold", wal_fold, _LAST)


def _users(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = fx.table(spark, sf_dir, "events")
    return e.select(F.col("event_id").alias("id"), F.concat(F.lit("/users/"), "user_id").alias("path"), F.round("value").cast("long").alias("size"))


def catalog_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of purchases put into those of views, by path."""
    e = fx.table(spark, sf_dir, "events")
    rows = {k: _users(spark, sf_dir).join(e.filter(F.col("event_type") == k).select(F.col("event_id").alias("id")), "id", "left_semi") for k in ("view", "purchase")}
    return catalog_ops.upsert(catalog_ops.latest(rows["view"]), rows["purchase"]).select("path", "id")


_add("catalog_upsert", catalog_upsert, "WITH v AS (SELECT '/users/' || user_id AS path, max(event_id) AS id FROM events WHERE event_type = 'view' GROUP BY 1), p AS (SELECT '/users/' || user_id AS path, max(event_id) AS id FROM events WHERE event_type = 'purchase' GROUP BY 1) SELECT path, id FROM p UNION ALL SELECT path, id FROM v WHERE path NOT IN (SELECT path FROM p)")


def catalog_remove(spark: SparkSession, sf_dir: str) -> DataFrame:
    gone = catalog_ops.fold_changes(fx.changes(spark, sf_dir)).filter("event = 'Removed'")
    return catalog_ops.remove(catalog_ops.latest(_users(spark, sf_dir)), gone).select("path", "id")


_add("catalog_remove", catalog_remove, f"WITH l AS ({_LAST}) SELECT '/users/' || user_id AS path, max(event_id) AS id FROM events GROUP BY 1 HAVING path NOT IN (SELECT path FROM l WHERE event = 'Removed')")


def wal_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The change log written as lines and replayed by a stream that ends when it has read all."""
    base = new_path(spark, "wal")
    log.append_log(fx.changes(spark, sf_dir), f"{base}/log")
    lines = log.parse_lines(spark.readStream.text(f"{base}/log"))
    lines.drop("seq").writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{base}/out").groupBy("event").agg(F.count("*").alias("n"), F.count_distinct("path").alias("paths"))


_add("wal_stream", wal_stream, "SELECT CASE event_type WHEN 'signup' THEN 'Added' WHEN 'error' THEN 'Removed' ELSE 'Modified' END AS event, count(*) AS n, count(DISTINCT user_id) AS paths FROM events GROUP BY 1")


class _Doubling:
    """A plugin that marks rows when they are indexed and doubles scores of results."""

    name, version = "doubling", "1"

    def init(self) -> None: ...

    def on_index(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("content_hash", F.lit("seen"))

    def on_search(self, query, results: DataFrame) -> DataFrame:
        return results.withColumn("score", F.col("score") * 2)

    def shutdown(self) -> None: ...


def plugin_hooks(spark: SparkSession, sf_dir: str) -> DataFrame:
    from trawl.plugins import Registry

    registry = Registry()
    registry.register(_Doubling())
    query = dsl.normalise(dsl.parse("src2"))
    out = registry.on_search(query, search.search(registry.on_index(fx.catalog(spark, sf_dir)), query, fx.AS_OF))
    return out.select("id", "score", "content_hash")


_add("plugin_hooks", plugin_hooks, f"SELECT id, score * 2 AS score, 'seen' AS content_hash FROM ({_search_sql(['src2'])})")


def search_front_end_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    query = dsl.normalise(dsl.parse("src"))
    out = search.limited(search.search(fx.catalog(spark, sf_dir), query, fx.AS_OF), 50)
    return out.select("id", "score")


_add("search_front_end_limit", search_front_end_limit, f"SELECT id, score FROM ({_search_sql(['src'])}) WHERE rank <= 50")


def glob_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fx.catalog(spark, sf_dir)
    return rows.select("id", *[glob(F.col("name"), p).alias(c) for c, p in (("every", "*"), ("ends", "*7.md"), ("begins", "src1*"), ("equal", "src1"), ("capitals", "SRC1*"))])


_add("glob_names", glob_names, f"WITH {_CATALOG} SELECT id, true AS every, ends_with(name, '7.md') AS ends, starts_with(name, 'src1') AS begins, name = 'src1' AS equal, starts_with(name, 'SRC1') AS capitals FROM base")


def filter_by_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Any predicate on the columns of the catalog."""
    return fx.catalog(spark, sf_dir).filter((F.col("size") % 2 == 0) & F.col("name").contains("_1")).select("id", "size")


_add("filter_by_function", filter_by_function, f"WITH {_CATALOG} SELECT id, size FROM base WHERE size % 2 = 0 AND contains(name, '_1')")


def accessors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fx.catalog(spark, sf_dir)
    own = {"extension": catalog_ops.by_extension(rows, "MD"), "no extension": catalog_ops.by_extension(rows, ""), "files": catalog_ops.files(rows), "directories": catalog_ops.directories(rows)}
    return catalog_ops.union_roots([r.agg(F.lit(k).alias("kind"), F.count("*").alias("n"), F.coalesce(F.max("id"), F.lit(0)).alias("last_id")) for k, r in own.items()])


_add(
    "accessors",
    accessors,
    f"""WITH {_CATALOG} SELECT 'extension' AS kind, count(*) AS n, max(id) AS last_id FROM base WHERE extension = 'md' UNION ALL SELECT 'no extension', 0, 0
    UNION ALL SELECT 'files', count(*), max(id) FROM base WHERE NOT is_dir UNION ALL SELECT 'directories', count(*), max(id) FROM base WHERE is_dir""",
)


def id_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog_ops.id_sets(fx.catalog(spark, sf_dir)).select("kind", "value", "page", F.bitmap_count("ids").alias("n"))


_KINDS = "k AS (SELECT id, 'extension' AS kind, extension AS value FROM base WHERE extension <> '' UNION ALL SELECT id, 'type', CASE WHEN is_dir THEN 'directory' ELSE 'file' END FROM base)"
_add("id_sets", id_sets, f"WITH {_CATALOG}, {_KINDS} SELECT kind, value, id // 32768 + 1 AS page, count(*) AS n FROM k GROUP BY ALL")


def id_set_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    sets = catalog_ops.id_sets(fx.catalog(spark, sf_dir))
    return catalog_ops.ids_of(sets, "extension", "json").unionByName(catalog_ops.ids_of(sets, "type", "directory"))


_add("id_set_members", id_set_members, f"WITH {_CATALOG}, {_KINDS} SELECT id FROM k WHERE kind = 'extension' AND value = 'json' OR kind = 'type' AND value = 'directory'")


def scan_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fx.catalog(spark, sf_dir)
    status = F.when(excluded(F.col("path"), ["fr"]), "skipped").when(F.col("id") % 11 == 0, "error").otherwise("indexed")
    return catalog_ops.scan_counters(rows.select(status.alias("status")))


_add("scan_counters", scan_counters, f"WITH {_CATALOG}, s AS (SELECT CASE WHEN list_contains(string_split(path, '/'), 'fr') THEN 'skipped' WHEN id % 11 = 0 THEN 'error' ELSE 'indexed' END AS status FROM base) SELECT count(*) FILTER (status = 'indexed') AS indexed, count(*) FILTER (status = 'skipped') AS skipped, count(*) FILTER (status = 'error') AS error FROM s")


def content_allowed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fx.catalog(spark, sf_dir)
    return rows.select("id", files.allowed(F.col("extension")).alias("by_default"), files.allowed(F.upper("extension"), ["md", "BIN"]).alias("by_list"))


_add("content_allowed", content_allowed, f"WITH {_CATALOG} SELECT id, extension IN ('txt', 'md', 'json', 'log') AS by_default, extension = 'md' AS by_list FROM base")


def trigram_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Postings after rows were removed and others added."""
    rows = fx.parts(spark, sf_dir)
    gone = rows.filter("id % 3 = 0")
    table = trigrams.add(trigrams.remove(trigrams.postings(rows), gone), gone.withColumn("name", F.reverse("name")))
    return table.groupBy("trigram").agg(F.count("*").alias("n"), F.min("id").alias("first_id"))


_add(
    "trigram_update",
    trigram_update,
    f"""WITH {_PARTS}, changed AS (SELECT * REPLACE (CASE WHEN id % 3 = 0 THEN reverse(name) ELSE name END AS name) FROM base),
    cat AS (SELECT id, CASE WHEN length(name) BETWEEN 1 AND 2 THEN rpad(lower(name), 3, ' ') ELSE lower(name) END AS nk FROM changed),
    p AS (SELECT unnest({_CODES}) AS trigram, id FROM cat) SELECT trigram, count(*) AS n, min(id) AS first_id FROM p GROUP BY trigram""",
)


def trigram_legacy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows with repeats, of whole names and of the names' first two characters."""
    rows = fx.parts(spark, sf_dir)
    codes = trigrams.legacy(F.col("name"))
    return rows.select("id", F.array_join(codes, "|").alias("windows"), F.array_join(trigrams.legacy(F.substring("name", 1, 2)), "|").alias("short"), (trigrams.legacy_hash(codes[0]) > 0).alias("hashed"))


_add("trigram_legacy", trigram_legacy, f"WITH {_PARTS} SELECT id, array_to_string(list_transform(range(1, length(name) - 1), lambda i: substr(lower(name), i, 3)), '|') AS windows, lower(name[1:2]) AS short, true AS hashed FROM base")


def path_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parents as they are shown, and both kinds of separators."""
    path = F.regexp_replace("url", r"[?#].*\z", "")
    rows = fx.table(spark, sf_dir, "pages").select("page_id", F.regexp_replace(path, "^https?:/", "").alias("path"))
    return rows.select("page_id", fn.display_parent(F.col("path")).alias("shown"), fn.windows_path(F.concat(F.lit("\\\\?\\"), "path")).alias("windows"), fn.unix_path(fn.windows_path(F.col("path"))).alias("unix"))


_add(
    "path_forms",
    path_forms,
    r"""WITH p AS (SELECT page_id, regexp_replace(regexp_replace(url, '[?#].*\z', ''), '^https?:/', '') AS path FROM pages), q AS (SELECT *, regexp_extract(path, '^(.*)[/\\]', 1) AS parent FROM p)
    SELECT page_id, CASE WHEN parent = '' THEN path ELSE parent END AS shown, replace(path, '/', '\') AS windows, path AS unix FROM q""",
)


def times_since_epoch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order dates moved back so that some come before 1970."""
    at = F.col("o_orderdate").cast("timestamp_ntz") - F.make_dt_interval(F.lit(9500))
    return fx.table(spark, sf_dir, "orders").select("o_orderkey", F.date_format(fn.since_epoch(at), "yyyy-MM-dd HH:mm").alias("at"))


_add("times_since_epoch", times_since_epoch, "SELECT o_orderkey, strftime(greatest(CAST(o_orderdate AS TIMESTAMP) - to_days(9500), TIMESTAMP '1970-01-01'), '%Y-%m-%d %H:%M') AS at FROM orders")


def results_as_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    query = dsl.normalise(dsl.parse("src1"))
    return search.search(fx.catalog(spark, sf_dir), query, fx.AS_OF).select("id", catalog_ops.text_line().alias("line"))


_add(
    "results_as_text",
    results_as_text,
    f"""WITH {_CATALOG}, q AS ({_search_sql(['src1'])})
    SELECT base.id, CASE WHEN is_dir THEN '[D]' ELSE '[F]' END || '  ' || base.path || '  ' || CASE WHEN is_dir THEN '-' WHEN base.size >= 1048576 THEN printf('%.2f MB', base.size / 1048576.0::DOUBLE) WHEN base.size >= 1024 THEN printf('%.2f KB', base.size / 1024.0::DOUBLE) ELSE base.size || ' B' END || '  ' || strftime(modified, '%Y-%m-%d %H:%M') AS line
    FROM base JOIN q ON q.id = base.id""",
)


def results_as_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    query = dsl.normalise(dsl.parse("src1 ext:md"))
    rows = search.search(fx.catalog(spark, sf_dir), query, fx.AS_OF).select("id", "name", "path", "size", "is_dir")
    return rows.select("id", catalog_ops.json_line().alias("line"))


_add("results_as_json", results_as_json, f"""WITH q AS ({_search_sql(['src1'], "extension = 'md'")}) SELECT id, '{{"id":' || id || ',"name":"' || name || '","path":"' || path || '","size":' || size || ',"is_dir":false}}' AS line FROM q""")


def volume_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table of mounts made of nations: some virtual, some at no path, some lines too short."""
    kind = F.element_at(F.array(*[F.lit(x) for x in ("ext4", "proc", "xfs", "tmpfs")]), (F.col("n_nationkey") % 4 + 1).cast("int"))
    point = F.when(F.col("n_nationkey") % 5 == 0, "none").otherwise(F.concat(F.lit("/mnt/"), F.replace("n_name", F.lit(" "), F.lit("_"))))
    line = F.when(F.col("n_nationkey") % 7 == 0, F.concat_ws(" ", F.lit("dev"), point)).otherwise(F.concat_ws(" ", F.lit("dev"), point, kind, F.lit("rw 0 0")))
    path = new_path(spark, "mounts")
    fx.table(spark, sf_dir, "nation").select(line.alias("value")).write.text(path)
    return files.volumes(spark, path)


_add("volume_list", volume_list, "SELECT '/mnt/' || replace(n_name, ' ', '_') AS mount_point, CASE n_nationkey % 4 WHEN 0 THEN 'ext4' ELSE 'xfs' END AS fs_type FROM nation WHERE n_nationkey % 4 IN (0, 2) AND n_nationkey % 5 <> 0 AND n_nationkey % 7 <> 0")


def watch_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Watch events with two paths each, some of a kind that doesn't count."""
    kind = F.when(F.col("event_type") == "signup", "Create").when(F.col("event_type") == "error", "Remove").when(F.col("event_type") == "view", "Modify").otherwise("Access")
    e = fx.table(spark, sf_dir, "events")
    rows = e.select(kind.alias("kind"), F.array(F.concat(F.lit("/users/"), "user_id"), F.lit("/all")).alias("paths"), F.col("ts").alias("at"), F.col("event_id").alias("seq"))
    return log.from_watch(rows).select("event", "path", "seq")


_add("watch_events", watch_events, "SELECT CASE event_type WHEN 'signup' THEN 'Added' WHEN 'error' THEN 'Removed' ELSE 'Modified' END AS event, unnest(['/users/' || user_id, '/all']) AS path, event_id AS seq FROM events WHERE event_type IN ('signup', 'error', 'view')")


def _moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The change log in which purchases move a path."""
    e = fx.table(spark, sf_dir, "events").filter("event_type = 'purchase'").select(F.col("event_id").alias("seq"))
    rows = fx.changes(spark, sf_dir).join(e.withColumn("moved", F.lit(True)), "seq", "left")
    to = F.concat(F.lit("/moved"), "path")
    return rows.select(F.when(F.col("moved"), "Renamed").otherwise(F.col("event")).alias("event"), F.when(F.col("moved"), to).otherwise(F.col("path")).alias("path"), F.when(F.col("moved"), F.col("path")).alias("origin"), "at", "seq")


def wal_renames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog_ops.fold_changes(_moves(spark, sf_dir)).select("path", "event", "seq")


_MOVES = """m AS (SELECT CASE event_type WHEN 'purchase' THEN '/moved' ELSE '' END || '/users/' || user_id AS path, CASE event_type WHEN 'signup' THEN 'Added' WHEN 'purchase' THEN 'Added' WHEN 'error' THEN 'Removed' ELSE 'Modified' END AS event, ts, event_id AS seq FROM events
    UNION ALL SELECT '/users/' || user_id, 'Removed', ts, event_id FROM events WHERE event_type = 'purchase'),
    l AS (SELECT path, arg_max(event, (ts, seq, event <> 'Removed')) AS event, arg_max(seq, (ts, seq, event <> 'Removed')) AS seq FROM m GROUP BY path)"""
_add("wal_renames", wal_renames, f"WITH {_MOVES} SELECT path, event, seq FROM l")


def _now(spark: SparkSession, sf_dir: str, paths: DataFrame) -> DataFrame:
    """Catalog rows that paths have now."""
    name = fn.file_name(F.col("path"))
    return paths.select(F.xxhash64("path").alias("id"), name.alias("name"), "path", F.lit("").alias("extension"), F.length("path").cast("long").alias("size"), F.lit(fx.BASE).cast("timestamp_ntz").alias("modified"), F.lit(False).alias("is_dir"), F.lit(None).cast("string").alias("content_hash"))


def store_follows_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stored catalog that a stream of changes keeps current, by rewriting the buckets that change."""
    base = new_path(spark, "store")
    users = fx.table(spark, sf_dir, "events").select(F.concat(F.lit("/users/"), "user_id").alias("path")).distinct()
    storage.save(_now(spark, sf_dir, users.unionByName(users.select(F.concat(F.lit("/kept"), "path").alias("path")))), base)
    log.append_log(_moves(spark, sf_dir), f"{base}-log")
    log.follow(spark, f"{base}-log", base, f"{base}-state", lambda paths: _now(spark, sf_dir, paths)).awaitTermination()
    return storage.load(spark, base).select("path", "size", "name_lower")


_add("store_follows_log", store_follows_log, f"WITH {_MOVES} SELECT path, length(path) AS size, lower(regexp_extract(path, '([^/]*)\\z', 1)) AS name_lower FROM (SELECT path FROM l WHERE event <> 'Removed' UNION ALL SELECT DISTINCT '/kept/users/' || user_id FROM events)".replace("\\\\", "\\"))


def store_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Saved twice, the second time without directories, and loaded."""
    base = new_path(spark, "store")
    rows = fx.catalog(spark, sf_dir)
    storage.save(rows, base)
    storage.save(rows.filter("not is_dir"), base)
    info = storage.meta(base)
    out = storage.load(spark, base).select("id", "path", "size", "name_lower", "name_key")
    return out.withColumns({"generation": F.lit(info["generation"]).cast("long"), "stored": F.lit(info["doc_count"]).cast("long"), "has_bytes": F.lit(storage.size(base) > 0)})


_add("store_round_trip", store_round_trip, f"WITH {_CATALOG}, {_DERIVED} SELECT id, path, size, nl AS name_lower, nk AS name_key, 2::BIGINT AS generation, count(*) OVER () AS stored, true AS has_bytes FROM cat WHERE NOT is_dir")


def store_legacy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A store that is one JSON array of rows."""
    path = new_path(spark, "legacy")
    rows = fx.table(spark, sf_dir, "region").select(F.col("r_regionkey").cast("long").alias("id"), F.col("r_name").alias("name"), F.concat(F.lit("/"), "r_name").alias("path"), F.lit("").alias("extension"), F.lit(0).cast("long").alias("size"), F.lit(True).alias("is_dir"))
    rows.agg(F.to_json(F.collect_list(F.struct("*"))).alias("value")).write.text(path)
    return storage.load_legacy(spark, path).select("id", "path", "is_dir", F.col("modified").isNull().alias("no_time"))


_add("store_legacy", store_legacy, "SELECT r_regionkey::BIGINT AS id, '/' || r_name AS path, true AS is_dir, true AS no_time FROM region")


def wal_clear(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log that is cleared between two appends."""
    path = new_path(spark, "wal")
    rows = fx.changes(spark, sf_dir)
    log.append_log(rows, path)
    log.clear_log(spark, path)
    log.append_log(rows.filter("event = 'Added'"), path)
    return log.read_log(spark, path).groupBy("event").agg(F.count("*").alias("n"))


_add("wal_clear", wal_clear, "SELECT 'Added' AS event, count(*) AS n FROM events WHERE event_type = 'signup' HAVING count(*) > 0")
