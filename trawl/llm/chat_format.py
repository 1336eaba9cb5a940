"""Quotation linking of conversations, in DataFrame operations only.

Lines that begin with quote signs are parsed into passages by level. Normalised quoted passages are hashed and joined
to the first message of the conversation that has the passage as its own text, as a paragraph, as a run of whole lines
or, from WORDS words on, as a run of whole words; of runs only those are hashed that begin as a passage does and are as
long. The message quoted at level 1 is the one replied to; threads follow replies to their first message.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trawl.llm import bitmaps
from trawl.llm.skew import HOT_KEYS, join_by_size
from trawl.llm.store import materialise

MARK = r"^((?:[ \t]{0,3}>)+)[ \t]?"
QUOTED = r"(?m)^[ \t]{0,3}>[^\n]*(?:\n|\z)"
ROUNDS = 64
#: Words from which a passage is also looked for as a part of a line; shorter ones stand in too many messages.
WORDS = 5
#: Rows from which a conversation's order is made in parts, and the number of parts.
LONG, PARTS = 1000, 64


def _normal(text: Column) -> Column:
    """Lower case, white space as single spaces, none at the ends."""
    return F.lower(F.trim(F.regexp_replace(text, r"\s+", " ")))


def _key(text: Column) -> Column:
    return F.sha2(_normal(text), 256)


def _own(text: Column) -> Column:
    """The text without quoted lines."""
    return F.regexp_replace(text, QUOTED, "")


def _lines(text: Column) -> Column:
    """The lines that aren't blank, each in normal form."""
    return F.filter(F.transform(F.split(text, "\n"), _normal), lambda line: line != "")


def _words(text: Column) -> Column:
    return F.filter(F.split(_normal(text), " "), lambda word: word != "")


def _joined(units: Column, at: Column | int, n: Column | int) -> Column:
    """n units from the place at on, counted from 0."""
    return F.array_join(F.slice(units, at + 1, n), " ")


def _passages(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, at, level, body): runs of lines with the same quote level, by the first line's place.

    Lines of a level that follow each other have the same difference between place and rank, so a passage is a group.
    """
    messages = messages.select("conv_id", "turn", "text", F.sha2("text", 256).alias("source")).dropDuplicates(["conv_id", "turn", "source"])
    lines = messages.select("conv_id", "turn", "source", F.posexplode(F.split("text", "\n")).alias("at", "line"))
    lines = lines.withColumn("level", F.length(F.regexp_replace(F.regexp_extract("line", MARK, 1), "[^>]", ""))).filter("level > 0")
    rank = F.row_number().over(Window.partitionBy("conv_id", "turn", "source", "level").orderBy("at"))
    lines = lines.select("conv_id", "turn", "source", "level", "at", (F.col("at") - rank).alias("run"), F.regexp_replace("line", MARK, "").alias("body"))
    runs = lines.groupBy("conv_id", "turn", "source", "level", "run").agg(F.min("at").alias("at"), F.array_sort(F.collect_list(F.struct("at", "body"))).alias("lines"))
    return runs.select("conv_id", "turn", "at", "level", F.array_join("lines.body", "\n").alias("body"))


def _threads(replies: DataFrame) -> DataFrame:
    """(conv_id, turn, thread, depth) for (conv_id, turn, reply_to): each round jumps twice as far.

    A message with very many replies is one row of the broadcast side, so its replies stay where they are.
    """
    keys = ["conv_id", "thread"]
    state = materialise(replies.select("conv_id", "turn", F.col("reply_to").alias("thread"), F.lit(1).cast("long").alias("depth")), "threads")
    total = state.count()
    for _ in range(ROUNDS):
        far = state.select("conv_id", F.col("turn").alias("thread"), F.col("thread").alias("far"), F.col("depth").alias("more"))
        heads = materialise(state.groupBy(*keys).agg(F.count("*").alias("_n")).join(far, keys, "left"), "heads")
        if heads.filter("far is not null").isEmpty():
            return state
        step = join_by_size(state, heads, keys, "_n", total)
        state = materialise(step.select("conv_id", "turn", F.coalesce("far", "thread").alias("thread"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth")), "threads")
    raise RuntimeError("threads did not settle")


def _marked(rows: DataFrame, keys: DataFrame, names: list[str]) -> DataFrame:
    """rows with _maybe, false only if keys doesn't have their ``names``; without a shuffle of rows."""
    keys = keys.select(*names).distinct()
    bits = bitmaps.bits_for(keys.count())
    pages = materialise(bitmaps.build(keys, F.xxhash64(*names), bits), "filter")
    return bitmaps.probe(rows, F.xxhash64(*names), pages, bits)


def _among(rows: DataFrame, keys: DataFrame, names: list[str]) -> DataFrame:
    return _marked(rows, keys, names).filter("_maybe").drop("_maybe")


def _runs(messages: DataFrame, quotes: DataFrame, units: Column, head: int) -> DataFrame:
    """(conv_id, turn, key): runs of units of messages (conv_id, turn, text) that may be quoted passages.

    quotes has the number of units (n) and the hash of the first ``head`` of them (first).
    """
    starts = quotes.groupBy("conv_id", "first").agg(F.collect_set("n").alias("counts"))
    starts = materialise(starts, "starts")
    message = ["conv_id", "turn", "source"]
    messages = messages.select("conv_id", "turn", F.sha2("text", 256).alias("source"), units.alias("own"))
    # the array is named twice, so it is made once and not within the function
    heads = F.transform(F.when(F.size("own") >= head, F.sequence(F.lit(0), F.size("own") - head)), lambda at: F.xxhash64(_joined(F.col("own"), at, head)))
    places = messages.select(*message, F.posexplode(heads).alias("at", "first"))
    places = materialise(_among(places, starts, ["conv_id", "first"]), "places")
    starts = starts.join(places.groupBy("conv_id", "first").agg(F.count("*").alias("_n")), ["conv_id", "first"])
    spans = join_by_size(places, starts, ["conv_id", "first"], "_n", places.count())
    spans = spans.select(*message, F.explode("counts").alias("n"), "at").groupBy(*message).agg(F.collect_set(F.struct("at", "n")).alias("spans"))
    spans = materialise(spans, "spans")
    spans = _among(messages, spans, ["conv_id", "turn"]).join(spans, message)
    keys = F.transform("spans", lambda s: F.sha2(_joined(F.col("own"), s["at"], s["n"]), 256))
    return spans.select("conv_id", "turn", F.explode(keys).alias("key"))


def _placed(rows: DataFrame) -> DataFrame:
    """rows with ``position``: 0, 1, 2 ... in each conversation by (thread, turn), null without conversation or turn.

    The few conversations that hold a large share of the rows, at most HOT_KEYS, are cut into ranges of that order by
    approximate quantiles, so no window holds one whole.
    """
    named, other = rows.filter("conv_id is not null and turn is not null"), rows.filter("conv_id is null or turn is null")
    total = rows.count()
    long = named.groupBy("conv_id").agg(F.count("*").alias("_n"), (2 * F.max(F.abs("turn")) + 2).cast("double").alias("_span"))
    long = materialise(long.filter(F.col("_n") > max(LONG, total // HOT_KEYS)).drop("_n"), "long")
    order = [F.col(c) for c in ("thread", "turn", "role", "text")]
    if long.isEmpty():
        named = named.withColumn("position", F.row_number().over(Window.partitionBy("conv_id").orderBy(*order)).cast("long") - 1)
        return named.unionByName(other.withColumn("position", F.lit(None).cast("long")))
    key = F.col("thread") * F.col("_span") + F.col("turn")
    cuts = named.join(F.broadcast(long), "conv_id").groupBy("conv_id", "_span")
    cuts = materialise(cuts.agg(F.percentile_approx(key, [i / PARTS for i in range(1, PARTS)], 10_000).alias("_cuts")), "cuts")
    part = F.when(F.col("_span").isNull(), 0).otherwise(F.size(F.filter("_cuts", lambda cut: cut < key)))
    named = named.join(F.broadcast(cuts), "conv_id", "left").withColumn("_part", part).drop("_span", "_cuts")
    sizes = named.join(F.broadcast(long.select("conv_id")), "conv_id").groupBy("conv_id", "_part").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("conv_id").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    sizes = materialise(sizes.select("conv_id", "_part", F.coalesce(before, F.lit(0)).alias("_before")), "sizes")
    at = F.row_number().over(Window.partitionBy("conv_id", "_part").orderBy(*order)) - 1
    named = named.withColumn("_at", at).join(F.broadcast(sizes), ["conv_id", "_part"], "left")
    named = named.withColumn("position", F.col("_at") + F.coalesce("_before", F.lit(0))).select(*rows.columns, "position")
    return named.unionByName(other.withColumn("position", F.lit(None).cast("long")))


def link_quotes(messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, turn, role, text, reply_to, thread, depth, n_quotes, n_linked, position), a row for each row of messages.

    text is without quoted lines; reply_to is the turn replied to: of the messages quoted at level 1 the last, each
    found as the first message with the passage, earlier than the quoting one; blank lines don't matter, nor do line
    breaks in passages of WORDS words or more, which may be parts of lines, cut between words. thread is the first turn of the chain
    of replies and depth its length; position is the place in the conversation in the order of (thread, turn), in which
    replies follow what they answer, null with a null conversation or turn; ties go by role and text. Messages
    that quote nothing, or nothing that is found, begin a thread at depth 0. n_quotes counts quoted passages that
    aren't blank, n_linked those that were found. A null text stays null; rows with a null conversation or turn are
    linked with nothing and have a null thread where the turn is null. Rows that repeat a conversation and turn are
    the same message: their quotes count together. An empty table gives no rows; other columns don't matter.
    """
    rows = messages.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), F.col(role_col).alias("role"), F.col(text_col).cast("string").alias("text"))
    quoting = rows.filter(F.col("text").rlike(r"(?m)^[ \t]{0,3}>") & F.col("conv_id").isNotNull() & F.col("turn").isNotNull())
    quotes = _passages(quoting).withColumn("lines", _lines(F.col("body"))).filter(F.size("lines") > 0)
    quotes = quotes.withColumn("words", F.split(F.array_join("lines", " "), " "))
    line, head = F.xxhash64(F.col("lines")[0]), F.xxhash64(_joined(F.col("words"), F.lit(0), WORDS))
    quotes = quotes.select("conv_id", "turn", "at", "level", F.sha2(F.array_join("lines", " "), 256).alias("key"), line.alias("line"), head.alias("head"), F.size("lines").alias("lines"), F.size("words").alias("words"))
    quotes = materialise(quotes.distinct(), "quotes")
    plain = F.when(F.col("text").rlike(r"(?m)^[ \t]{0,3}>"), _own(F.col("text"))).otherwise(F.col("text"))
    bare = rows.select("conv_id", "turn", "role", plain.alias("text"))
    total = quotes.count()
    none = {"reply_to": F.lit(None).cast("long"), "thread": F.col("turn"), **{c: F.lit(0).cast("long") for c in ("depth", "n_quotes", "n_linked")}}
    if not total:
        return _placed(bare.withColumns(none))

    asked = materialise(quotes.groupBy("conv_id", "key").agg(F.count("*").alias("_n")), "asked")
    # lines before and after a quoted one are in different paragraphs, though the text without quoted lines joins them
    apart = F.split(F.regexp_replace("whole", QUOTED, "\n"), r"\n\s*\n")
    forms = F.array_distinct(F.concat(F.array("text"), F.split("text", r"\n\s*\n"), apart, F.split("text", "\n")))
    # filters instead of joins with the messages: a conversation may hold a large share of them
    own = rows.select("conv_id", "turn", plain.alias("text"), F.col("text").alias("whole"))
    own = _among(own.filter("conv_id is not null and turn is not null and text is not null"), asked, ["conv_id"])
    keys = own.select("conv_id", "turn", F.explode(F.transform(forms, _key)).alias("key"))
    short = quotes.filter(f"lines > 1 and words < {WORDS}").selectExpr("conv_id", "line as first", "lines as n")
    long = quotes.filter(f"words >= {WORDS}").selectExpr("conv_id", "head as first", "words as n")
    for runs, units, head in ((short, _lines(F.col("text")), 1), (long, _words(F.col("text")), WORDS)):
        if not runs.isEmpty():
            keys = keys.unionByName(_runs(own, runs, units, head))
    own = _among(keys, asked, ["conv_id", "key"])
    first = own.groupBy("conv_id", "key").agg(F.min("turn").alias("origin")).join(asked, ["conv_id", "key"])
    found = join_by_size(quotes, first, ["conv_id", "key"], "_n", total).filter("origin < turn")
    found = materialise(found.select("conv_id", "turn", "at", "level", "origin"), "found")
    counts = quotes.groupBy("conv_id", "turn").agg(F.count("*").alias("n_quotes"))
    linked = found.groupBy("conv_id", "turn").agg(F.count("*").alias("n_linked"), F.max(F.when(F.col("level") == 1, F.col("origin"))).alias("reply_to"))
    threads = _threads(linked.filter("reply_to is not null").select("conv_id", "turn", "reply_to"))
    answers = materialise(counts.join(linked, ["conv_id", "turn"], "left").join(threads, ["conv_id", "turn"], "left"), "answers")
    marked = _marked(bare, answers, ["conv_id", "turn"])
    out = marked.filter("_maybe").drop("_maybe").join(answers, ["conv_id", "turn"], "left")
    zero = F.lit(0).cast("long")
    out = out.select("conv_id", "turn", "role", "text", "reply_to", F.coalesce("thread", "turn").alias("thread"), *[F.coalesce(c, zero).alias(c) for c in ("depth", "n_quotes", "n_linked")])
    return _placed(marked.filter(~F.col("_maybe")).drop("_maybe").withColumns(none).unionByName(out))
