"""Near-duplicate classes: banded MinHash candidates, sequential Bayesian pruning, exact verification.

1. Each text becomes a signature and a key of its set of k-word shingles. Texts with the same set form a class, named
   by one of its rows, which goes on alone.
2. Buckets (band values) of several classes give candidates: all pairs of a small bucket, and of a larger one
   the pairs with its hub, the member that meets most others.
3. Candidate signatures are compared batch by batch; a pair is pruned once the posterior probability that it reaches
   the threshold is below the miss probability.
4. Survivors are verified on their full shingle sets, which are made for them alone: first each class with the partner
   it resembles most, then those of the other pairs that are still in different components.
5. Large buckets whose members are then still in several components are compared in blocks of a bounded number of
   rows, by signatures; each pair counts in the first band that it shares. Only rows with a likely partner in another
   component are compared again with their sets, in such blocks as well.
6. Components of all links; their names are the smallest ids of their rows.

Banding misses a pair at the threshold with at most MISS; so does the pruning. Nothing is capped.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from trawl.llm import bitmaps, kernel
from trawl.llm.graph import components
from trawl.llm.skew import beside, join_by_size
from trawl.llm.store import bounded_batches, materialise, settle

#: Probability of missing a pair at the threshold, for the bands and for the pruning each.
MISS = 1e-6
MOST_HASHES = 192
#: Hash values compared between two looks at the posterior.
BATCH = 30
#: Buckets up to this size give all their pairs.
SMALL = 4
#: Rows and shingles that a block of a large bucket holds on average, and so what a task holds of two blocks.
BLOCK_ROWS, BLOCK_SHINGLES = 1024, 1 << 20

_random = np.random.default_rng(4_099)
MULTIPLY = _random.integers(0, 1 << 31, MOST_HASHES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
ADD = _random.integers(0, 1 << 32, MOST_HASHES, dtype=np.uint32)


def banding(percent: int, miss: float = MISS) -> tuple[int, int]:
    """(bands, rows): the most selective rows whose bands miss a pair at the threshold with at most ``miss``."""
    best = (MOST_HASHES, 1)
    for rows in range(1, 17):
        bands = math.ceil(math.log(miss) / math.log1p(-((percent / 100) ** rows) + 1e-15))
        if bands * rows <= MOST_HASHES:
            best = (bands, rows)
    return best


def least_matches(percent: int, hashes: int, miss: float = MISS) -> list[tuple[int, int]]:
    """(compared, matches needed) after each batch: fewer matches leave the posterior, from a uniform prior, below ``miss``.

    P(similarity >= t | m of n match) = P(Binomial(n + 1, t) <= m).
    """
    t, out = percent / 100, []
    for n in [*range(BATCH, hashes, BATCH), hashes]:
        total, m = 0.0, -1
        while total < miss and m < n:
            m += 1
            total += math.exp(math.lgamma(n + 2) - math.lgamma(m + 1) - math.lgamma(n + 2 - m) + m * math.log(t) + (n + 1 - m) * math.log1p(-t)) if t < 1 else float(m == n)
        out.append((n, m))
    return out


def _sets(column: pa.Array, words: int) -> list[np.ndarray]:
    values, bounds = kernel.text_shingles(column, words)
    return [np.unique(values[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]


def signatures(sets: list[np.ndarray], hashes: int) -> np.ndarray:
    """Low 16 bits of the smallest hash under each of the functions; zero for empty sets."""
    out = np.zeros((len(sets), hashes), np.uint16)
    full = [i for i, s in enumerate(sets) if len(s)]
    start = 0
    while start < len(full):
        stop, held = start, 0
        while stop < len(full) and (stop == start or held + len(sets[full[stop]]) <= 1 << 15):
            held += len(sets[full[stop]])
            stop += 1
        own = full[start:stop]
        x = (np.concatenate([sets[i] for i in own]) >> np.uint64(32)).astype(np.uint32)
        at = np.cumsum([0] + [len(sets[i]) for i in own[:-1]])
        y, low = np.empty_like(x), np.empty((hashes, len(own)), np.uint32)
        for h in range(hashes):
            np.multiply(x, MULTIPLY[h], out=y)
            y += ADD[h]
            np.minimum.reduceat(y, at, out=low[h])
        out[own] = low.T.astype(np.uint16)
        start = stop
    return out


def band_keys(bands: int, rows: int) -> Column:
    """A hash of each band of ``sig``, which holds two bytes a hash value."""
    return F.array(*[F.xxhash64(F.lit(b), F.substring("sig", 1 + 2 * rows * b, 2 * rows)) for b in range(bands)])


def first_shared(x: np.ndarray, others: np.ndarray, rows: int) -> np.ndarray:
    """The first band in which each of the others agrees with x; the number of bands where there is none."""
    same = (others.reshape(len(others), len(x) // rows, rows) == x.reshape(1, -1, rows)).all(axis=2)
    return np.where(same.any(axis=1), same.argmax(axis=1), same.shape[1])


def set_key(values: np.ndarray) -> bytes:
    return hashlib.blake2b(values.tobytes(), digest_size=16).digest()


def _profile(words: int, hashes: int):
    schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("set_key", pa.binary()), ("sig", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in kernel.pieces(batch, "text"):
                sets = _sets(part.column(1), words)
                sigs = signatures(sets, hashes)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([set_key(s) if len(s) else None for s in sets], pa.binary()),
                        pa.array([x.tobytes() if len(s) else None for x, s in zip(sigs, sets, strict=True)], pa.binary()),
                    ],
                    schema=schema,
                )

    return run


def _text_sets(words: int):
    """Sets with their keys; a set is given once a task."""
    schema = pa.schema([("set_key", pa.binary()), ("set", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for batch in batches:
            for part in kernel.pieces(batch, "text"):
                own = {k: s for s in _sets(part.column(0), words) if (k := set_key(s)) not in seen}
                seen.update(own)
                yield pa.RecordBatch.from_arrays([pa.array(list(own), pa.binary()), pa.array([s.tobytes() for s in own.values()], pa.binary())], schema=schema)

    return run


def alike(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """100 * |a & b| >= percent * |a | b| for sorted sets without repeats."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a) or 100 * len(a) < percent * len(b):
        return False
    at = np.searchsorted(b, a)
    both = int(np.count_nonzero(b[np.minimum(at, len(b) - 1)] == a))
    return 100 * both >= percent * (len(a) + len(b) - both)


def _likely(percent: int, hashes: int):
    """Pairs that the posterior doesn't rule out, with the number of hash values that match."""
    looks = least_matches(percent, hashes)
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("same", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint16).reshape(batch.num_rows, hashes) for i in (2, 3))
            alive, same, done = np.arange(batch.num_rows), np.zeros(batch.num_rows, np.int64), 0
            for n, least in looks:
                same[alive] += (x[alive, done:n] == y[alive, done:n]).sum(axis=1)
                alive, done = alive[same[alive] >= least], n
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(alive)), batch.column(1).take(pa.array(alive)), pa.array(same[alive])], schema=schema)

    return run


def _verified(percent: int):
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [alike(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64), percent) for x, y in zip(batch.column(2), batch.column(3), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], schema=schema).filter(pa.array(keep, pa.bool_()))

    return run


class _Blocks:
    """The rows of one pair of blocks of a bucket."""

    def __init__(self, key: tuple, table: pa.Table, percent: int, hashes: int, rows: int):
        self.i, self.j = (k.as_py() for k in key[1:])
        self.block, self.ids, self.comp, self.sizes = (table.column(c).to_numpy() for c in ("block", "cid", "component", "size"))
        self.comp = self.comp.copy()
        self.sigs = np.frombuffer(b"".join(table.column("sig").to_pylist()), np.uint16).reshape(len(self.ids), hashes)
        self.band, self.percent, self.rows, self.looks = table.column("band")[0].as_py(), percent, rows, least_matches(percent, hashes)

    def partners(self, x: int) -> np.ndarray:
        """Rows of other components that x may be linked with and first meets in this band, likelier ones first."""
        if self.block[x] != self.i:
            return np.zeros(0, np.int64)
        others = np.flatnonzero((self.block == self.j) if self.i != self.j else (np.arange(len(self.ids)) > x))
        sizes, own = self.sizes[others], self.sizes[x]
        others = others[(self.comp[others] != self.comp[x]) & (100 * np.minimum(sizes, own) >= self.percent * np.maximum(sizes, own))]
        same, done = np.zeros(len(others), np.int64), 0
        for n, least in self.looks:
            same += (self.sigs[others, done:n] == self.sigs[x, done:n]).sum(axis=1)
            others, same, done = others[same >= least], same[same >= least], n
        others = others[np.argsort(-same, kind="stable")]
        return others[first_shared(self.sigs[x], self.sigs[others], self.rows) == self.band]


def _with_partners(percent: int, hashes: int, rows: int):
    """Rows of a pair of blocks that may be linked with a row of another component."""

    def run(key, table):
        b = _Blocks(key, table.combine_chunks(), percent, hashes, rows)
        some = np.zeros(len(b.ids), bool)
        for x in range(len(b.ids)):
            others = b.partners(x)
            some[others] = True
            some[x] |= len(others) > 0
        return table.select(["key", "band", "cid", "component", "size"]).filter(pa.array(some))

    return run


def _between(percent: int, hashes: int, rows: int):
    """Links between components among the rows of one pair of blocks."""

    def run(key, table):
        table = table.combine_chunks()
        b, found = _Blocks(key, table, percent, hashes, rows), []
        sets = [np.frombuffer(x, np.uint64) for x in table.column("set").to_pylist()]
        for x in range(len(b.ids)):
            for y in b.partners(x):
                if b.comp[y] != b.comp[x] and alike(sets[x], sets[y], percent):
                    found.append((int(b.ids[x]), int(b.ids[y])))
                    b.comp[b.comp == b.comp[y]] = b.comp[x]
        return pa.table({"a": pa.array([f[0] for f in found], pa.int64()), "b": pa.array([f[1] for f in found], pa.int64())})

    return run


def _filtered(rows: DataFrame, hashed: Column, keys: DataFrame, hashed_key: Column) -> DataFrame:
    """The rows whose hash is among those of keys, and a few others, without a shuffle."""
    bits = bitmaps.bits_for(keys.count())
    pages = materialise(bitmaps.build(keys, hashed_key, bits), "filter")
    return bitmaps.probe(rows, hashed, pages, bits).filter("_maybe").drop("_maybe")


class _Search:
    """Candidates, pruning and verification among the classes of a profile."""

    def __init__(self, profile: DataFrame, classes: DataFrame, texts: DataFrame, words: int, percent: int):
        self.classes, self.texts, self.words, self.percent = classes, texts, words, percent
        self.bands, self.rows = banding(percent)
        self.hashes = self.bands * self.rows
        # one row of each class; classes of one row, nearly all, are told by a filter
        own = profile.filter("n_shingles > 0").select("set_key", F.col("row").alias("cid"), F.col("n_shingles").alias("size"), "sig")
        several = classes.filter("copies > 1")
        bits = bitmaps.bits_for(several.count())
        marked = bitmaps.probe(own, F.xxhash64("set_key"), materialise(bitmaps.build(several, F.xxhash64("set_key"), bits), "filter"), bits).drop("set_key")
        self.reps = marked.filter(~F.col("_maybe")).unionByName(marked.filter("_maybe").join(classes.select("cid"), "cid", "left_semi")).drop("_maybe")

    def members(self) -> DataFrame:
        """(cid, band, key, n) for the buckets of several classes."""
        banded = self.reps.select("cid", F.posexplode(band_keys(self.bands, self.rows)).alias("band", "key"))
        buckets = materialise(banded.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1"), "buckets")
        some = _filtered(banded, F.col("key"), buckets, F.col("key"))
        return materialise(join_by_size(some, buckets, ["key"], "n", self.classes.count() * self.bands), "members")

    def pairs(self, members: DataFrame, met: DataFrame) -> DataFrame:
        """(a, b), a < b: all pairs of small buckets, of large ones those with the hub."""
        large, few = members.filter(F.col("n") > SMALL), members.filter(F.col("n") <= SMALL)
        hubs = large.join(met, "cid").groupBy("key", "n").agg(F.max(F.struct("met", -F.col("cid"))).alias("h")).select("key", "n", (-F.col("h.col2")).alias("hub"))
        star = join_by_size(large.select("cid", "key"), hubs, ["key"], "n", members.count()).select(F.col("cid").alias("a"), F.col("hub").alias("b"))
        pairs = few.select("key", F.col("cid").alias("a")).join(few.select("key", F.col("cid").alias("b")), "key").select("a", "b")
        pairs = star.unionByName(pairs).filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        return materialise(pairs.distinct(), "pairs")

    def sets(self, cids: DataFrame) -> DataFrame:
        """(cid, set) of classes, made again from texts that a filter of ids finds."""
        wanted = materialise(self.classes.join(cids, "cid", "left_semi").select("cid", "set_key", "id"), "wanted")
        found = _filtered(self.texts, F.xxhash64("doc_id"), wanted, F.xxhash64("id")).select("text")
        found = found.mapInArrow(_text_sets(self.words), "set_key binary, set binary")
        found = _filtered(found, F.xxhash64("set_key"), wanted, F.xxhash64("set_key")).join(wanted.select("set_key", "cid"), "set_key")
        return materialise(found.groupBy("set_key", "cid").agg(F.first("set").alias("set")).select("cid", "set"), "sets")

    def verified(self, pairs: DataFrame, sets: DataFrame) -> DataFrame:
        return materialise(beside(pairs, sets, "cid", "set").mapInArrow(_verified(self.percent), "a long, b long"), "verified")

    def blocks(self, rows: DataFrame, count: Column) -> DataFrame:
        """rows of buckets, once for each pair of the ``count`` blocks of its bucket that it is in, with signatures."""
        rows = rows.withColumn("blocks", count).withColumn("block", F.pmod(F.xxhash64("cid"), F.col("blocks")))
        rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
        return rows.withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")}).drop("blocks", "other")

    def components(self) -> DataFrame:
        """(id, component) of the classes that are linked with another."""
        members = self.members()
        if members.isEmpty():
            return members.select(F.col("cid").alias("id"), F.col("cid").alias("component"))
        met = materialise(members.groupBy("cid").agg(F.sum("n").alias("met")), "met")
        sigs = materialise(_filtered(self.reps, F.xxhash64("cid"), met, F.xxhash64("cid")), "signatures")
        likely = beside(self.pairs(members, met), sigs, "cid", "sig").mapInArrow(_likely(self.percent, self.hashes), "a long, b long, same long")
        likely = materialise(likely, "likely")

        ends = likely.select(F.col("a").alias("cid"), F.col("b").alias("to"), "same").unionByName(likely.select(F.col("b").alias("cid"), F.col("a").alias("to"), "same"))
        best = materialise(ends.groupBy("cid").agg(F.max(F.struct("same", "to")).alias("best")).select("cid", "best.to"), "best")
        first = materialise(best.select(F.least("cid", "to").alias("a"), F.greatest("cid", "to").alias("b")).distinct(), "first")
        sets = self.sets(best.select("cid"))
        links = self.verified(first, sets)
        joined = components(links)
        home = materialise(best.select("cid").join(joined.withColumnRenamed("id", "cid"), "cid", "left").select("cid", F.coalesce("component", "cid").alias("component")), "home")
        other = beside(likely.select("a", "b").join(first, ["a", "b"], "left_anti"), home, "cid", "component").filter("x <> y").select("a", "b")
        other = materialise(other, "other")
        if not other.isEmpty():
            ends = other.select(F.explode(F.array("a", "b")).alias("cid")).distinct()
            links = links.unionByName(self.verified(other, _filtered(sets, F.xxhash64("cid"), ends, F.xxhash64("cid"))))
            joined = components(links)

        here = members.filter(F.col("n") > SMALL).join(joined.withColumnRenamed("id", "cid"), "cid", "left").withColumn("component", F.coalesce("component", "cid"))
        here = materialise(here, "placed")
        split = here.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("_n")).filter("low <> high").select("key", "_n")
        rest = join_by_size(here, split, ["key"], "_n", here.count()).drop("_n")
        rest = self.blocks(rest, F.ceil(F.col("n") / F.lit(BLOCK_ROWS))).drop("n").join(sigs, "cid")
        columns = "key long, band int, cid long, component long, size long"
        rest = rest.groupBy("key", "i", "j").applyInArrow(_with_partners(self.percent, self.hashes, self.rows), columns)
        rest = materialise(rest.distinct(), "partners")
        if rest.isEmpty():
            return joined
        sizes = materialise(rest.groupBy("key").agg(F.count("*").alias("_n"), F.sum("size").alias("weight")), "sizes")
        rest = join_by_size(rest.drop("size"), sizes, ["key"], "_n", rest.count())
        rest = self.blocks(rest, F.greatest(F.ceil(F.col("_n") / F.lit(BLOCK_ROWS)), F.ceil(F.col("weight") / F.lit(BLOCK_SHINGLES)))).drop("_n", "weight")
        sets = sigs.join(self.sets(rest.select("cid").distinct()), "cid")
        more = rest.join(sets, "cid").groupBy("key", "i", "j").applyInArrow(_between(self.percent, self.hashes, self.rows), "a long, b long")
        more = materialise(more, "between")
        return joined if more.isEmpty() else components(links.unionByName(more))


def _profiled(texts: DataFrame, words: int, percent: int) -> DataFrame:
    """(doc_id, n_shingles, set_key, sig, row), written; row is unique."""
    bands, rows = banding(percent)
    profile = texts.mapInArrow(_profile(words, bands * rows), "doc_id long, n_shingles long, set_key binary, sig binary")
    return materialise(profile.withColumn("row", F.monotonically_increasing_id()), "profile")


def _placed(texts: DataFrame, words: int, percent: int) -> DataFrame:
    """(doc_id, n_shingles, set_key, component, component_id, alone) for each text; of rows without shingles keys are null.

    component is one number for all rows reachable, component_id the smallest id of them, null where none has one.
    alone is true where no other row is reachable.
    """
    profile = _profiled(texts, words, percent)
    sets = profile.filter("n_shingles > 0")
    classes = sets.groupBy("set_key").agg(F.min("doc_id").alias("id"), F.count("*").alias("copies"), F.min("row").alias("cid"))
    classes = materialise(classes, "classes")
    found = settle(texts.sparkSession, lambda: _Search(profile, classes, texts, words, percent).components(), "found")
    homes = materialise(classes.join(found.withColumnRenamed("id", "cid"), "cid", "left"), "homes")
    linked = homes.filter("component is not null")
    names = linked.groupBy("component").agg(F.min("id").alias("component_id"), F.count("*").alias("_n"))
    linked = join_by_size(linked, names, ["component"], "_n", classes.count())
    linked = linked.withColumn("alone", F.lit(False))
    alone = homes.filter("component is null").select("set_key", "copies", F.col("cid").alias("component"), F.col("id").alias("component_id"), (F.col("copies") == 1).alias("alone"))
    homes = materialise(alone.unionByName(linked.select(alone.columns)), "named")
    own = join_by_size(sets.select("doc_id", "n_shingles", "set_key"), homes, ["set_key"], "copies", profile.count()).drop("copies")
    none = {"component": F.lit(None).cast("long"), "component_id": F.lit(None).cast("long"), "alone": F.lit(True)}
    return own.unionByName(profile.filter("n_shingles = 0").select("doc_id", "n_shingles", "set_key").withColumns(none))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of docs.

    Words are runs of bytes other than space and 0x09-0x0D after lower-casing A-Z. A text with fewer than ``words``
    words has its whole sequence as its one shingle; an empty or null text has none and is linked with nothing.
    Texts are linked if 100 * |intersection| >= percent * |union|; component_id is the smallest id reachable, and the
    row with that id is kept. A row without id takes part in links: beside a row with an id it isn't kept; where no row
    reachable has one, component_id is null and kept is true. Rows that share an id are placed each by its own text,
    and stay apart in the result. Sets are held as 64-bit hashes of shingles. An empty table gives no rows. Other
    columns of docs don't matter.
    """
    bounded_batches(docs.sparkSession)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    out = settle(docs.sparkSession, lambda: _placed(texts, words, percent), "near")
    out = out.select("doc_id", "n_shingles", F.when(F.col("set_key").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def _keyed(rows: DataFrame, words: int, text_col: str, name: str) -> DataFrame:
    """rows with the key of each text's set as column ``name``."""
    names = rows.columns
    at = names.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in kernel.pieces(batch.rename_columns([f"c{i}" for i in range(len(names))]), f"c{at}"):
                keys = pa.array([set_key(s) if len(s) else None for s in _sets(part.column(at), words)], pa.binary())
                yield pa.RecordBatch.from_arrays([*part.columns, keys], names=[*names, name])

    return rows.mapInArrow(run, StructType([*rows.schema.fields, StructField(name, BinaryType())]))


def _verdicts(placed: DataFrame) -> DataFrame:
    """(doc_id, set_key, n, stays) of ids and sets whose rows go, or of whose n rows one stays; all others stay."""
    pairs = placed.filter("not alone").groupBy("doc_id", "set_key", "component", "component_id").agg(F.count("*").alias("n"))
    pairs = materialise(pairs.withColumn("head", F.col("doc_id").eqNullSafe(F.col("component_id"))), "pairs")
    heads = pairs.filter("head").select("component", "set_key", "doc_id", "n")
    # sets that share the smallest id, or have none: the first one stays
    several = heads.groupBy("component").agg(F.min("set_key").alias("first"), F.count("*").alias("_n")).filter("_n > 1")
    heads = join_by_size(heads, several, ["component"], "_n", pairs.count(), "left").withColumn("stays", F.coalesce(F.col("set_key") == F.col("first"), F.lit(True)))
    out = heads.filter("not stays or n > 1").select("doc_id", "set_key", "n", "stays")
    return out.unionByName(pairs.filter("not head").select("doc_id", "set_key", "n", F.lit(False).alias("stays")))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs, all columns, with one document of each near-duplicate class, the one with the smallest id.

    Of a class without ids one row stays, of rows that repeat id and set one; rows without shingles all stay. Rows that
    share an id are told apart by their sets. Rows whose id no row that goes has, by a filter, pass without a shuffle.
    """
    bounded_batches(docs.sparkSession)
    names = docs.columns
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    verdicts = settle(docs.sparkSession, lambda: _verdicts(materialise(_placed(texts, words, percent), "near")), "verdicts")
    key = "_set_key" + "_" * sum(n.startswith("_set_key") for n in names)
    number, none, stays, size = (key + c for c in ("i", "n", "s", "c"))
    ident = F.col(id_col).cast("long")
    bits = bitmaps.bits_for(verdicts.count())
    pages = materialise(bitmaps.build(verdicts, F.xxhash64("doc_id"), bits), "filter")
    marked = bitmaps.probe(docs, F.xxhash64(ident), pages, bits)
    maybe = _keyed(marked.filter("_maybe").drop("_maybe"), words, text_col, key).withColumns({number: F.coalesce(ident, F.lit(0)), none: ident.isNull()})
    known = verdicts.select(F.coalesce("doc_id", F.lit(0)).alias(number), F.col("doc_id").isNull().alias(none), F.col("set_key").alias(key), F.col("stays").alias(stays), F.col("n").alias(size))
    total = verdicts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    judged = join_by_size(maybe, known, [number, none, key], size, total, "left")
    others = judged.filter(F.col(stays).isNull()).unionByName(judged.filter(stays).dropDuplicates([number, none, key]))
    return marked.filter(~F.col("_maybe")).select(*names).unionByName(others.select(*names))
