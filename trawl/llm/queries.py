"""The registered queries of this subpackage: thin callers that derive the contracted columns."""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from trawl.llm.sharding import shard_documents

    return shard_documents(table(spark, sf_dir, "documents"), shards=8)


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from trawl.llm.packing import pack

    return pack(table(spark, sf_dir, "documents"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from trawl.llm.toxicity import toxicity_scores

    return toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from trawl.llm.exact_dedup import exact_duplicates

    out = exact_duplicates(table(spark, sf_dir, "documents"), keep="max")
    return out.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from trawl.llm.near_dedup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), words=3, percent=85)


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from trawl.llm.token_counts import token_counts

    return token_counts(table(spark, sf_dir, "documents"))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from trawl.llm.license_scan import license_scan

    return license_scan(table(spark, sf_dir, "documents"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from trawl.llm.decontamination import contaminated

    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from trawl.llm.quality import quality_scores

    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    from trawl.llm.chat_format import link_quotes

    return link_quotes(table(spark, sf_dir, "conversations"))


def chat_format_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quotation linking where messages do quote: every turn after the first quotes whole lines, a part or two levels of others."""
    from trawl.llm.chat_format import link_quotes

    rows = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text")
    order = Window.partitionBy("conv_id").orderBy("turn")
    last, before, opening = F.lag("text").over(order), F.lag("text", 2).over(order), F.first("text").over(order)
    kind = F.when(last.isNull(), -1).otherwise(F.col("turn") % 4)

    def quoted(text, sign="> "):
        return F.concat(F.lit(sign), F.replace(text, F.lit("\n"), F.lit(f"\n{sign}")), F.lit("\n"))

    quotes = F.when(kind == 0, quoted(opening)).when(kind == 1, quoted(last)).when(kind == 2, F.concat(F.coalesce(quoted(before, ">> "), F.lit("")), quoted(last)))
    quotes = quotes.when(kind == 3, quoted(F.substring(last, 1, 9)))
    return link_quotes(rows.withColumn("text", F.concat(F.coalesce(quotes, F.lit("")), "text")))


QUERIES = {f.__name__: f for f in (op1_sharding, op2_packing, op3_toxicity, op4_exact_dedup, op5_near_dedup, op6_token_counts, op7_license_scan, op8_decontamination, op9_quality, op10_chat_format, chat_format_quotes)}

#: Quotation linking by plain comparison of every quoted passage with every earlier message of its conversation.
_LINKS = r"""
        q AS (SELECT conv_id, turn, role, text, string_split(text, chr(10)) AS l FROM m),
        x AS (SELECT conv_id, turn, unnest(l) AS line, generate_subscripts(l, 1) AS place FROM q),
        y AS (SELECT *, length(regexp_replace(regexp_extract(line, '^((?:[ \t]{0,3}>)+)[ \t]?', 1), '[^>]', '', 'g')) AS level FROM x),
        z AS (SELECT *, place - row_number() OVER (PARTITION BY conv_id, turn, level ORDER BY place) AS run,
                     lower(trim(regexp_replace(regexp_replace(line, '^((?:[ \t]{0,3}>)+)[ \t]?', ''), '\s+', ' ', 'g'))) AS body FROM y WHERE level > 0),
        p AS (SELECT conv_id, turn, level, min(place) AS place, list(body ORDER BY place) FILTER (body <> '') AS b FROM z GROUP BY conv_id, turn, level, run HAVING max(body) <> ''),
        o AS (SELECT conv_id, turn, role, CASE WHEN regexp_matches(text, '(?m)^[ \t]{0,3}>') THEN regexp_replace(text, '(?m)^[ \t]{0,3}>[^\n]*(?:\n|\z)', '', 'g') ELSE text END AS own,
                     regexp_replace(text, '(?m)^[ \t]{0,3}>[^\n]*(?:\n|\z)', chr(10), 'g') AS apart FROM q),
        n AS (SELECT *, list_transform([own] || regexp_split_to_array(own, '\n\s*\n') || regexp_split_to_array(apart, '\n\s*\n'), lambda t: lower(trim(regexp_replace(t, '\s+', ' ', 'g')))) AS forms,
                     list_filter(list_transform(string_split(own, chr(10)), lambda t: lower(trim(regexp_replace(t, '\s+', ' ', 'g')))), lambda t: t <> '') AS own_lines FROM o),
        f AS (SELECT p.conv_id, p.turn, p.level, p.place, min(n.turn) AS origin FROM p JOIN n ON n.conv_id = p.conv_id AND n.turn < p.turn
              WHERE list_contains(n.forms, array_to_string(b, ' '))
                 OR list_contains(list_transform(range(1, len(n.own_lines) - len(b) + 2), lambda i: array_to_string(n.own_lines[i:i + len(b) - 1], ' ')), array_to_string(b, ' '))
                 OR (len(string_split(array_to_string(b, ' '), ' ')) >= 5 AND contains(' ' || n.forms[1] || ' ', ' ' || array_to_string(b, ' ') || ' '))
              GROUP BY p.conv_id, p.turn, p.level, p.place),
        c AS (SELECT conv_id, turn, count(*) AS n_quotes FROM p GROUP BY conv_id, turn),
        k AS (SELECT conv_id, turn, count(*) AS n_linked, max(origin) FILTER (level = 1) AS reply_to FROM f GROUP BY conv_id, turn),
        r AS (SELECT conv_id, turn, turn AS thread, 0::BIGINT AS depth FROM n
              UNION ALL SELECT r.conv_id, r.turn, k.reply_to, depth + 1 FROM r JOIN k ON k.conv_id = r.conv_id AND k.turn = r.thread WHERE k.reply_to IS NOT NULL),
        e AS (SELECT conv_id, turn, min(thread) AS thread, max(depth) AS depth FROM r GROUP BY conv_id, turn)
        SELECT conv_id, turn, role, own AS text, reply_to, thread, depth, coalesce(n_quotes, 0) AS n_quotes, coalesce(n_linked, 0) AS n_linked,
               row_number() OVER (PARTITION BY conv_id ORDER BY thread, turn, role, own) - 1 AS position
        FROM n JOIN e USING (conv_id, turn) LEFT JOIN c USING (conv_id, turn) LEFT JOIN k USING (conv_id, turn)"""

#: Words of a text after case folding, as far as lower case and the sharp s give it, and its shingles of five words.
_FOLDED = "regexp_extract_all(replace(lower(coalesce(text, '')), 'ß', 'ss'), '[^\\x20\\x09-\\x0D]+')"
_FIVES = "CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END"

SQL = {
    "op10_chat_format": "WITH RECURSIVE m AS (SELECT conv_id, turn::BIGINT AS turn, role, text FROM conversations)," + _LINKS,
    "chat_format_quotes": """
        WITH RECURSIVE v AS (SELECT conv_id, turn::BIGINT AS turn, role, text, lag(text) OVER w AS a, lag(text, 2) OVER w AS b, first_value(text) OVER w AS z
              FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
        m AS (SELECT conv_id, turn, role, CASE WHEN a IS NULL THEN '' WHEN turn % 4 = 0 THEN '> ' || replace(z, chr(10), chr(10) || '> ') || chr(10)
                     WHEN turn % 4 = 1 THEN '> ' || replace(a, chr(10), chr(10) || '> ') || chr(10)
                     WHEN turn % 4 = 2 THEN coalesce('>> ' || replace(b, chr(10), chr(10) || '>> ') || chr(10), '') || '> ' || replace(a, chr(10), chr(10) || '> ') || chr(10)
                     ELSE '> ' || replace(substr(a, 1, 9), chr(10), chr(10) || '> ') || chr(10) END || text AS text FROM v),""" + _LINKS,
    # every window that shares a shingle with an item, by its exact similarity, without fingerprints
    "op8_decontamination": f"""
        WITH dw AS (SELECT row_number() OVER () AS k, doc_id, {_FOLDED} AS w FROM documents),
        d AS (SELECT k, doc_id, {_FIVES} AS s FROM dw),
        iw AS (SELECT row_number() OVER () AS i, item_id, {_FOLDED} AS w FROM benchmark WHERE item_id IS NOT NULL),
        b AS (SELECT i, item_id, {_FIVES} AS s, len(w) AS n_words FROM iw WHERE len(w) > 0),
        t AS (SELECT g, 1 / (1 + ln(count(*))) AS weight FROM (SELECT unnest(list_distinct(s)) AS g FROM (SELECT DISTINCT s FROM b)) GROUP BY g),
        u AS (SELECT i, unnest(list_distinct(s)) AS g FROM b),
        a AS (SELECT i, min(weight) = max(weight) AS even, avg(weight) AS mean, sum(weight) AS total, count(*) AS n FROM u JOIN t USING (g) GROUP BY i),
        h AS (SELECT k, i, p - 1 AS p, g FROM (SELECT k, unnest(s) AS g, generate_subscripts(s, 1) AS p FROM d) JOIN u USING (g)),
        y AS (SELECT k, i, d.doc_id, b.item_id, d.s, least(len(b.s), len(d.s)) AS size, n_words FROM (SELECT DISTINCT k, i FROM h) JOIN d USING (k) JOIN b USING (i)
              WHERE 10 * least(len(b.s), len(d.s)) >= 8 * len(b.s)),
        o AS (SELECT DISTINCT k, i, unnest(range(greatest(0, p - size + 1), least(p, len(s) - size) + 1)) AS start FROM h JOIN y USING (k, i)),
        c AS (SELECT DISTINCT o.k, o.i, o.start, h.g FROM o JOIN y USING (k, i) JOIN h ON h.k = o.k AND h.i = o.i AND h.p BETWEEN o.start AND o.start + y.size - 1),
        e AS (SELECT k, i, start, sum(CASE WHEN even THEN 1 ELSE weight END) AS common, count(*) AS n_common FROM c JOIN t USING (g) JOIN a USING (i) GROUP BY k, i, start),
        v AS (SELECT doc_id, item_id, k, i, start, n_words, common / ((len(list_distinct(s[start + 1:start + size])) - n_common) * (CASE WHEN even THEN 1 ELSE mean END) + (CASE WHEN even THEN n ELSE total END)) AS similarity
              FROM e JOIN y USING (k, i) JOIN a USING (i))
        SELECT doc_id, item_id, round(similarity, 6) AS similarity, start::BIGINT AS start_word, n_words::BIGINT AS n_words FROM v WHERE similarity >= 0.8
        QUALIFY row_number() OVER (PARTITION BY k, i ORDER BY round(similarity, 12) DESC, start) = 1""",
    "op4_exact_dedup": f"""
        WITH d AS (SELECT doc_id, sha256(translate(coalesce(text, ''), '{ascii_uppercase}', '{ascii_lowercase}')) AS h FROM documents)
        SELECT doc_id, max(doc_id) OVER (PARTITION BY h) AS keep_id, count(*) OVER (PARTITION BY h) AS group_size,
               doc_id = max(doc_id) OVER (PARTITION BY h) AS kept, h AS text_sha256
        FROM d""",
    "op5_near_dedup": f"""
        WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{ascii_uppercase}', '{ascii_lowercase}'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
        s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
                                  ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s FROM d),
        u AS (SELECT doc_id, unnest(s) AS g FROM s),
        p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM u a JOIN u b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
        e AS (SELECT a, b FROM p JOIN s x ON x.doc_id = a JOIN s y ON y.doc_id = b WHERE 100 * n >= 85 * (len(x.s) + len(y.s) - n)),
        l AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
        r AS (SELECT doc_id, doc_id AS c FROM documents UNION SELECT r.doc_id, l.b FROM r JOIN l ON r.c = l.a)
        SELECT s.doc_id, len(any_value(s.s)) AS n_shingles, min(c) AS component_id, s.doc_id = min(c) AS kept FROM s JOIN r USING (doc_id) GROUP BY s.doc_id""",
}
