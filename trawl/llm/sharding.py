"""Sharding by balanced label propagation.

Documents start in shards of equal numbers of rows. In each round the links of a document vote with their shards: it
asks to move where more of its neighbours are. Requests are granted under quotas that keep every shard's number of
rows: a move into a shard is paid for by a move out of it, of another request or of a document without links. Rounds
that ask for shards with such documents and rounds of exchanges between linked ones take turns. Rounds go
on until none helps, up to a bound of four a shard. The shard of a document without links is free, so it costs nothing to move it. Groups that are
still cut then are dealt one after the other into the rows that they hold, so fewer than there are shards stay cut.
"""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trawl.llm.ranking import PER_BUCKET, gapless
from trawl.llm.skew import join_by_size
from trawl.llm.store import materialise, settle

log = logging.getLogger(__name__)
#: Rounds that are run at most, or four a shard if that is more; reaching it is logged.
ROUNDS = 12


def quotas(asked: dict[tuple[int, int], int], free: dict[int, int], shards: int) -> tuple[dict, dict]:
    """(moves of linked documents, moves of free ones) by (from, to), so that as many rows enter a shard as leave it."""
    flow = {k: v for k, v in asked.items() if k[0] != k[1] and v > 0}

    def gain(s: int) -> int:
        return sum(v for (_, b), v in flow.items() if b == s) - sum(v for (a, _), v in flow.items() if a == s)

    changed = True
    while changed:
        changed = False
        for s in range(shards):
            excess = gain(s) - free.get(s, 0)
            for k in sorted((k for k in flow if k[1] == s), key=lambda k: flow[k]):
                if excess <= 0:
                    break
                cut = min(excess, flow[k])
                flow[k] -= cut
                excess -= cut
                changed = True
    out: dict[tuple[int, int], int] = {}
    give = [[s, gain(s)] for s in range(shards) if gain(s) > 0]
    take = [[s, -gain(s)] for s in range(shards) if gain(s) < 0]
    while give and take:
        n = min(give[0][1], take[0][1])
        out[give[0][0], take[0][0]] = n
        give[0][1] -= n
        take[0][1] -= n
        give, take = [g for g in give if g[1]], [t for t in take if t[1]]
    return {k: v for k, v in flow.items() if v}, out


def _round(state: DataFrame, votes: DataFrame, held: dict[int, int], free: dict[int, int], total: int, turn: int, exchange: bool) -> DataFrame | None:
    """state after the moves of a round, None if there are none; votes are those of groups in several shards.

    Rows ask for the shard in which most of their group is, ties by a hash that differs by group and turn. Without
    exchange only shards with unlinked rows are asked for, with it all that the group doesn't fill alone. A group asks
    for one shard, in which it has at least as many rows as where they come from, so each round with moves raises the
    sum of the squares of votes.
    """
    sizes = F.create_map(*[F.lit(x).cast("long") for s, n in held.items() for x in (s, n)])
    room = F.col("votes") < sizes[F.col("shard").cast("long")] if exchange else F.col("shard").isin([s for s, n in free.items() if n])
    rank = F.struct("votes", F.xxhash64("grp", "shard", F.lit(turn)).alias("tie"), "shard")
    best = votes.filter(room).groupBy("grp").agg(F.max(rank).alias("best"))
    wish = votes.join(best, "grp").select("grp", "shard", "votes", F.col("best.shard").alias("to"), F.col("best.votes").alias("there"))
    wish = materialise(wish.filter("there >= votes and to <> shard").drop("there"), "wishes")
    asked = {(r["shard"], r["to"]): r["n"] for r in wish.groupBy("shard", "to").agg(F.sum("votes").alias("n")).collect()}
    moves, back = quotas(asked, free, len(held))
    if not moves:
        return None
    # all who ask and the free documents of shards that give some back are numbered by (from, to); the first go
    asking = join_by_size(state.filter("linked"), wish, ["grp", "shard"], "votes", total).drop("votes")
    giving = state.filter(~F.col("linked") & F.col("shard").isin(sorted({a for a, _ in back}))).withColumn("to", F.lit(-1))
    numbered = gapless(asking.unionByName(giving.select(asking.columns)), ["shard", "to"], F.col("row"), [F.col("grp"), F.col("row")], total, "at")
    granted = [(a, b, 0, n, b) for (a, b), n in moves.items()]
    start: dict[int, int] = {}
    for (a, b), n in back.items():
        low = start.get(a, 0)
        granted.append((a, -1, low, low + n, b))
        start[a] = low + n
    granted = state.sparkSession.createDataFrame(granted, "shard int, to int, low long, high long, target int")
    moved = materialise(numbered.join(F.broadcast(granted), ["shard", "to"]).filter("at >= low and at < high").select("row", "target"), "moved")
    return materialise(state.join(moved, "row", "left").select("row", "grp", F.coalesce("target", "shard").alias("shard"), "linked"), "shards")


def _deal(state: DataFrame, votes: DataFrame, total: int) -> DataFrame:
    """state with the groups of votes, which are in several shards, dealt one after the other into the rows they hold.

    Large groups come first. Only groups across the end of a shard stay cut, fewer than there are shards. If that is no
    gain, state is returned.
    """
    groups = votes.groupBy("grp").agg(F.sum("votes").alias("size"), F.count("*").alias("pieces"))
    # offsets as in gapless(), by size class and hashed bucket; their number follows that of the groups still cut
    groups = materialise(groups, "cut")
    buckets = max(1, -(-groups.count() // PER_BUCKET)) * 4
    groups = groups.withColumn("_class", -F.floor(F.log2("size"))).withColumn("_bucket", F.pmod(F.xxhash64("grp"), F.lit(buckets)))
    offsets = groups.groupBy("_class", "_bucket").agg(F.sum("size").alias("_n"))
    offsets = offsets.withColumn("_before", F.sum("_n").over(Window.orderBy("_class", "_bucket")) - F.col("_n")).drop("_n")
    within = Window.partitionBy("_class", "_bucket").orderBy(F.desc("size"), "grp")
    groups = groups.withColumn("_in", F.sum("size").over(within) - F.col("size")).join(offsets, ["_class", "_bucket"])
    groups = groups.select("grp", "size", "pieces", (F.col("_before") + F.col("_in")).alias("start"))
    spans, low = [], 0
    for r in sorted(votes.groupBy("shard").agg(F.sum("votes").alias("n")).collect(), key=lambda r: (-r["n"], r["shard"])):
        spans.append((low, low + r["n"], r["shard"]))
        low += r["n"]
    spans = F.broadcast(state.sparkSession.createDataFrame(spans, "low long, high long, target int"))
    # a row for each group and shard it gets rows in: [first, last) of the group's rows
    parts = groups.join(spans, (F.col("start") < F.col("high")) & (F.col("start") + F.col("size") > F.col("low")))
    first, last = F.greatest(F.col("low") - F.col("start"), F.lit(0)), F.least(F.col("high") - F.col("start"), F.col("size"))
    parts = materialise(parts.select("grp", "size", first.alias("first"), last.alias("last"), "target"), "parts")
    if parts.count() >= groups.agg(F.sum("pieces")).first()[0]:
        return state
    whole, across = parts.filter("last - first = size"), parts.filter("last - first < size")
    rows = state.filter("linked").select("row", "grp")
    moved = join_by_size(rows, whole.select("grp", "size", "target"), ["grp"], "size", total).select("row", "target")
    split = gapless(rows.join(F.broadcast(across.select("grp").distinct()), "grp"), ["grp"], F.col("row"), [F.col("row")], total, "at")
    split = split.join(F.broadcast(across), "grp").filter("at >= first and at < last").select("row", "target")
    moved = materialise(moved.unionByName(split), "moved")
    return materialise(state.join(moved, "row", "left").select("row", "grp", F.coalesce("target", "shard").alias("shard"), "linked"), "shards")


def _rounds(state: DataFrame, held: dict[int, int], total: int, rounds: int) -> tuple[DataFrame, DataFrame | None]:
    """state after rounds, until one of each kind grants nothing, and the votes of groups still cut, None without any."""
    idle, votes = 0, None
    for turn in range(rounds + 1):
        votes = state.filter("linked").groupBy("grp", "shard").agg(F.count("*").alias("votes"))
        votes = votes.withColumn("pieces", F.count("*").over(Window.partitionBy("grp"))).filter("pieces > 1").drop("pieces")
        votes = materialise(votes, "votes")
        if votes.isEmpty():
            return state, None
        if turn == rounds or idle == 2:
            if idle < 2:
                log.warning("moves of round %d were still granted: shards keep what they have reached", rounds)
            break
        free = dict(state.filter("not linked").groupBy("shard").count().collect())
        after = _round(state, votes, held, free, total, turn, turn % 2 == 1 or not free)
        state, idle = (state, idle + 1) if after is None else (after, 0)
    return state, votes


def propagate(members: DataFrame, shards: int, rounds: int = ROUNDS) -> DataFrame:
    """(row, grp, shard) for members (row, grp): row is unique, rows of equal grp are linked.

    Shards hold equal numbers of rows, at most one apart, before and after each round. Only votes by group and shard
    and a matrix of shards x shards counts are gathered; the matrix alone reaches the driver. Before and after the dealing
    rounds end when none is granted, at most after ``rounds`` or four a shard, whichever is more.
    """
    members = materialise(members, "members")
    total = members.count()
    sizes = materialise(members.groupBy("grp").agg(F.count("*").alias("size")).filter("size > 1"), "groups")
    placed = gapless(members, [], F.col("row"), [F.col("row")], total, "at")
    placed = placed.select("row", "grp", F.pmod("at", F.lit(shards)).cast("int").alias("shard"))
    linked = join_by_size(placed, sizes, ["grp"], "size", total).withColumn("linked", F.lit(True)).drop("size")
    alone = placed.join(sizes.select("grp"), "grp", "left_anti").withColumn("linked", F.lit(False))
    state = materialise(linked.unionByName(alone.select(linked.columns)), "shards")
    held = {s: total // shards + (s < total % shards) for s in range(shards)}
    # a hot group fills about a shard in two rounds
    rounds = max(rounds, 4 * shards)
    state, votes = _rounds(state, held, total, rounds)
    if votes is None:
        return state
    # what is left finds no request against it; once dealt, unlinked rows may help again
    return _rounds(_deal(state, votes, total), held, total, rounds)[0]


def shard_documents(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) for every row of docs; law is ``rows``.

    Equal texts are linked, so a group is kept together as far as the quotas allow. size is the text's UTF-8 bytes
    plus one, 1 for a null text, which counts as empty. Shards differ by one row at most; slot is gapless from 0 in
    each. grown_shard is null under this law. Repeated rows and rows without id are placed like others; an empty table
    gives no rows; other columns of docs don't matter.
    """
    return settle(docs.sparkSession, lambda: _sharded(docs, shards, id_col, text_col), "sharded")


def _sharded(docs: DataFrame, shards: int, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text).cast("long").alias("text_crc32"),
        F.substring(F.unhex(F.sha2(text, 256)), 1, 16).alias("grp"),
        # unique within this table once written: the task in the upper bits, the row in the lower ones
        F.monotonically_increasing_id().alias("row"),
    )
    rows = materialise(rows, "rows")
    total = rows.count()
    placed = propagate(rows.select("row", "grp"), shards)
    out = rows.drop("grp").join(placed.select("row", "shard"), "row")
    out = gapless(out, ["shard"], F.col("row"), [F.col("row")], total, "slot")
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
