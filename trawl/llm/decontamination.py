"""Benchmark decontamination by fingerprints of item-sized windows.

A document's windows of an item's number of words get SimHash fingerprints, sums of weighted shingle signs over prefix
sums. Only windows that share a shingle with an item are fingerprinted, since all others have similarity 0. A
multi-index looks fingerprints up: one table for each block of bits gives the items whose block differs in at most
RADIUS // BLOCKS bits, so that none within the radius is lost, as one of the blocks has at most that share of the
differing bits. Candidates within the radius are verified by the exact weighted Jaccard similarity of their shingle
sets; weights follow the number of different texts of the whole benchmark that have a shingle.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trawl.llm import kernel
from trawl.llm.store import bounded_batches, materialise

WORDS, SIMILARITY = 5, 0.8
#: Blocks, bits of each and the radius, the largest for which one of the blocks of a near fingerprint differs in two bits
#: at most. At similarity 0.8 a distance has a mean of about 20 and a deviation of about 4.
BLOCKS, WIDTH, RADIUS = 12, 11, 35
BITS, NEAR = BLOCKS * WIDTH, RADIUS // BLOCKS
#: Text of items that is sent to executors at once; a larger benchmark takes several passes of this size.
ITEM_BYTES = 4 << 20
#: Windows fingerprinted at once.
CHUNK = 4096
_ONES = np.array([bin(i).count("1") for i in range(1 << WIDTH)], np.uint8)
_FLIPS = np.flatnonzero(_ONES <= NEAR).astype(np.uint16)
_POWERS = (1 << np.arange(WIDTH)).astype(np.uint16)


def _signs(values: np.ndarray) -> np.ndarray:
    """BITS signs of each shingle, by three hashes of it."""
    words = np.stack([values, kernel.mix(values + kernel.U64(kernel.STEP)), kernel.mix(values ^ kernel.U64(kernel.STEP))], axis=1)
    bits = np.unpackbits(words.view(np.uint8).reshape(len(values), -1), axis=1, bitorder="little")[:, :BITS]
    return bits.astype(np.float64) * 2 - 1


def fingerprints(values: np.ndarray, weights: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
    """SimHash of the ``size`` shingles from each start, by blocks: (starts, BLOCKS)."""
    low, high = int(starts.min()), int(starts.max()) + size
    sums = np.concatenate((np.zeros((1, BITS)), np.cumsum(_signs(values[low:high]) * weights[low:high, None], axis=0)))
    at = starts - low
    bits = (sums[at + size] - sums[at]) > 1e-9
    return (bits.reshape(len(starts), BLOCKS, WIDTH) * _POWERS).sum(axis=2, dtype=np.uint16)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return _ONES[a ^ b].sum(axis=1, dtype=np.int64)


class BlockIndex:
    """A multi-index of fingerprints: for each block a table from its value to the fingerprints near in that block, as bits."""

    def __init__(self, prints: np.ndarray):
        self.prints = prints
        self.tables = np.zeros((BLOCKS, 1 << WIDTH, -(-len(prints) // 64)), np.uint64)
        for i, own in enumerate(prints):
            for b in range(BLOCKS):
                self.tables[b, own[b] ^ _FLIPS, i // 64] |= np.uint64(1 << (i % 64))

    def candidates(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places in prints, places in the index) of pairs that are near in some block."""
        found = self.tables[0][prints[:, 0]]
        for b in range(1, BLOCKS):
            found = found | self.tables[b][prints[:, b]]
        return np.nonzero(np.unpackbits(found.view(np.uint8).reshape(len(prints), -1), axis=1, bitorder="little"))

    def within(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """As candidates(), of pairs within the radius."""
        x, y = self.candidates(prints)
        near = distances(prints[x], self.prints[y]) <= RADIUS
        return x[near], y[near]


def case_folded(column: pa.Array) -> pa.Array:
    """Texts by Unicode case folding, as a benchmark's passage may stand in capitals; null stays null. Words stay words."""
    return pa.array([t if t is None else t.casefold() for t in column.to_pylist()], pa.string())


class Items:
    """A block of benchmark items: shingle sets with weights, and fingerprints by number of words."""

    def __init__(self, ids: list[int], texts: list[str | None], counts: dict[int, int] | None = None):
        """counts: for shingles of several different texts of the benchmark, their number; without it, texts are all there are."""
        data, offsets = kernel.buffers(case_folded(pa.array(texts, pa.string())))
        starts, ends, bounds = kernel.word_spans(data, offsets)
        values, at = kernel.shingles(kernel.word_hashes(data, starts, ends), bounds, WORDS)
        self.ids, self.sets, self.sizes = [], [], []
        for i, item in enumerate(ids):
            if at[i + 1] > at[i] and item is not None:
                self.ids.append(item)
                self.sets.append(values[at[i] : at[i + 1]])
                self.sizes.append(int(bounds[i + 1] - bounds[i]))
        self.unique = [np.unique(s) for s in self.sets]
        different = list({s.tobytes(): u for s, u in zip(self.sets, self.unique, strict=True)}.values())
        self.known, frequency = np.unique(np.concatenate(different) if different else np.zeros(0, kernel.U64), return_counts=True)
        if counts is not None:
            frequency = np.array([counts.get(v, 1) for v in self.known.tolist()], np.int64)
        # a shingle of many texts says less: weight 1 for one text, falling with the logarithm of the number of texts;
        # all others weigh as much as an item's own on average. None where weights are equal, as their scale doesn't matter
        weight = 1 / (1 + np.log(frequency))
        self.weights = [None if (w := weight[np.searchsorted(self.known, u)]).min() == w.max() else w for u in self.unique]
        self.where: dict[int, list[int]] = {}
        for i, s in enumerate(self.sets):
            for v in np.unique(s).tolist():
                self.where.setdefault(v, []).append(i)
        self.prints = [fingerprints(s, self.weigh(s, i), np.array([0]), len(s))[0] for i, s in enumerate(self.sets)]
        # items of equal size and equal weights of all shingles share the windows' fingerprints and an index
        self.groups: dict[tuple[int, int], list[int]] = {}
        for i, s in enumerate(self.sets):
            self.groups.setdefault((len(s), -1 if self.weights[i] is None else i), []).append(i)
        self.indexes: dict[tuple[int, int], BlockIndex] = {}
        mask = 1 << 20
        self.filter = np.zeros(mask, bool)
        self.filter[(self.known & np.uint64(mask - 1)).astype(np.int64)] = True

    def __getstate__(self):
        return vars(self) | {"indexes": {}}

    def index(self, group: tuple[int, int]) -> BlockIndex:
        """Made where it is first used, as tables are larger than what they are made of."""
        if group not in self.indexes:
            self.indexes[group] = BlockIndex(np.array([self.prints[i] for i in self.groups[group]]))
        return self.indexes[group]

    def weigh(self, values: np.ndarray, item: int) -> np.ndarray:
        """Weights for a comparison with an item: of its own shingles theirs, of all others their mean."""
        own, weights = self.unique[item], self.weights[item]
        if weights is None:
            return np.ones(len(values))
        at = np.minimum(np.searchsorted(own, values), len(own) - 1)
        return np.where(own[at] == values, weights[at], weights.mean())

    def hits(self, values: np.ndarray) -> np.ndarray:
        """Positions of shingles that an item has."""
        if not len(self.known):
            return np.zeros(0, np.int64)
        at = np.flatnonzero(self.filter[(values & np.uint64(len(self.filter) - 1)).astype(np.int64)])
        return at[self.known[np.minimum(np.searchsorted(self.known, values[at]), len(self.known) - 1)] == values[at]]

    def similarity(self, window: np.ndarray, item: int) -> float:
        window = np.unique(window)
        both = np.intersect1d(window, self.unique[item], assume_unique=True)
        common = self.weigh(both, item).sum()
        return float(common / (self.weigh(window, item).sum() + self.weigh(self.unique[item], item).sum() - common))

    def matches(self, values: np.ndarray, hits: np.ndarray, similarity: float) -> list[tuple[int, float, int, int]]:
        """(item, similarity, first word, words) of the most similar window of each item that a text contains."""
        near: dict[int, list[int]] = {}
        for p in hits.tolist():
            for i in self.where[int(values[p])]:
                near.setdefault(i, []).append(p)
        alike: dict[tuple[int, int], list[int]] = {}
        for i in near:
            alike.setdefault((len(self.sets[i]), -1 if self.weights[i] is None else i), []).append(i)
        best: dict[int, tuple[float, int, int]] = {}
        for group, items in alike.items():
            size = group[0]
            size_here = min(size, len(values))
            if size_here < similarity * size:
                continue
            last = len(values) - size_here
            # the union of the starts around each hit, without their overlaps: as many numbers as there are windows
            p = np.unique(np.concatenate([near[i] for i in items]))
            low, high = np.maximum(0, p - size_here + 1), np.minimum(p, last)
            low[1:] = np.maximum(low[1:], high[:-1] + 1)
            n = np.maximum(high - low + 1, 0)
            starts = np.repeat(low - (np.cumsum(n) - n), n) + np.arange(n.sum())
            for c in range(0, len(starts), CHUNK):
                own = starts[c : c + CHUNK]
                # far starts in a chunk would span a long text; each run of near starts is summed on its own
                for run in np.split(own, np.flatnonzero(np.diff(own) > 4 * size_here) + 1):
                    span = values[run[0] : run[-1] + size_here]
                    prints = fingerprints(span, self.weigh(span, items[0]), run - run[0], size_here)
                    for w, k in zip(*self.index(group).within(prints), strict=True):
                        i, s = self.groups[group][k], int(run[w])
                        if i not in near:
                            continue
                        found = self.similarity(values[s : s + size_here], i)
                        if found >= similarity and (i not in best or found > best[i][0]):
                            best[i] = (found, s, self.sizes[i])
        return [(self.ids[i], round(f, 6), s, n) for i, (f, s, n) in sorted(best.items())]


def _texts_by_shingle(rows: DataFrame, blocks: int) -> DataFrame:
    """(block, shingle, texts): each block's shingles that several different texts of the whole benchmark have."""
    schema = pa.schema([("text", pa.binary()), ("block", pa.int64()), ("shingle", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in kernel.pieces(batch, "text"):
                values, at = kernel.text_shingles(case_folded(part.column(1)), WORDS)
                for d, block in enumerate(part.column(0).to_pylist()):
                    own = values[at[d] : at[d + 1]]
                    if len(own):
                        text, own = hashlib.sha256(own.tobytes()).digest()[:16], np.unique(own).view(np.int64)
                        yield pa.RecordBatch.from_arrays([pa.array([text] * len(own), pa.binary()), pa.array([block] * len(own), pa.int64()), pa.array(own)], schema=schema)

    owned = rows.select(F.pmod(F.xxhash64("item_id"), F.lit(blocks)).alias("block"), "text").filter("text is not null")
    owned = materialise(owned.mapInArrow(run, "text binary, block long, shingle long").distinct(), "benchmark")
    several = owned.select("text", "shingle").distinct().groupBy("shingle").agg(F.count("*").alias("texts")).filter("texts > 1")
    return materialise(owned.select("block", "shingle").distinct().join(several, "shingle").select("block", "shingle", "texts"), "texts")


def item_blocks(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text") -> Iterator[Items]:
    """The benchmark in blocks of bounded size, in the order of ids; each is read on its own."""
    rows = benchmark.select(F.col(id_col).cast("long").alias("item_id"), F.col(text_col).cast("string").alias("text")).filter("item_id is not null")
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = max(1, -(-size // (ITEM_BYTES // 2)))
    several = None
    if blocks > 1:
        bounded_batches(benchmark.sparkSession)
        several = _texts_by_shingle(rows, blocks)
    for b in range(blocks):
        own = rows.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b).orderBy("item_id", "text").collect()
        if own or b == 0:
            # unsigned, as the kernel's
            counts = None if several is None else {r[0] % (1 << 64): r[1] for r in several.filter(F.col("block") == b).select("shingle", "texts").collect()}
            yield Items([r[0] for r in own], [r[1] for r in own], counts)


def _matcher(items: Items, similarity: float):
    schema = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("similarity", pa.float64()), ("start_word", pa.int64()), ("n_words", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in kernel.pieces(batch, "text"):
                values, at = kernel.text_shingles(case_folded(part.column(1)), WORDS)
                hits = items.hits(values)
                owner = np.searchsorted(at, hits, side="right") - 1
                rows = []
                for d in np.unique(owner):
                    doc = part.column(0)[int(d)].as_py()
                    rows += [(doc, *m) for m in items.matches(values[at[d] : at[d + 1]], hits[owner == d] - at[d], similarity)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return run


def contaminated(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, item_id, similarity, start_word, n_words): the best window of each item that a document contains.

    Words are runs of bytes other than space and 0x09-0x0D after Unicode case folding; shingles have five words, a
    shorter text its whole sequence. Null and empty texts and items match nothing; items without id don't count; a null doc_id
    stays null. Repeated rows are reported as often; ties go to the first window. Empty tables give no rows.
    """
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    out = None
    for items in item_blocks(benchmark):
        found = rows.mapInArrow(_matcher(items, similarity), "doc_id long, item_id long, similarity double, start_word long, n_words long")
        out = found if out is None else out.unionByName(found)
    return out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns, that contain no benchmark item; decided while reading, without a shuffle."""
    bounded_batches(docs.sparkSession)
    names, schema = docs.columns, docs.schema
    at = names.index(text_col)
    for items in item_blocks(benchmark):

        def run(batches: Iterator[pa.RecordBatch], items: Items = items) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                renamed = batch.rename_columns([f"c{i}" for i in range(len(names))])
                for part in kernel.pieces(renamed, f"c{at}"):
                    values, bounds = kernel.text_shingles(case_folded(part.column(at)), WORDS)
                    hits = items.hits(values)
                    owner = np.searchsorted(bounds, hits, side="right") - 1
                    clean = np.ones(part.num_rows, bool)
                    for d in np.unique(owner):
                        clean[d] = not items.matches(values[bounds[d] : bounds[d + 1]], hits[owner == d] - bounds[d], similarity)
                    yield part.filter(pa.array(clean)).rename_columns(names)

        docs = docs.mapInArrow(run, schema)
    return docs
