"""Packing of token sequences into windows by multiway Karmarkar-Karp differencing.

Each text is its token ids and the end id. Full windows are cut off its front; the rest is cut into fragments. The
fragments of a batch are partitioned into near-equal windows: sorted fragments form partial partitions, the two with
the largest differences are merged again and again, large windows of one on small ones of the other. If a window
exceeds the capacity, the number of windows rises and the batch is partitioned anew. Batches are made of whole
capacities less a small slack, so the first attempt mostly fits and padding is about the slack.
"""

from __future__ import annotations

import heapq
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trawl.llm import kernel
from trawl.llm.store import bounded_batches, materialise
from trawl.llm.tokenizers_ import default_path, load

CAPACITY, END_ID = 1024, 0
#: Windows in a batch, the free ids in each that a batch is made for, and the ids in a fragment at most.
WINDOWS, SLACK, FRAGMENT = 256, 5, 128
#: Words whose ids a worker remembers.
REMEMBERED = 400_000
#: New words encoded as one text.
TOGETHER = 1000
#: A single space between characters that are no white space: the byte-level split never has a token across it.
SAFE = re.compile(r"(?<=\S) (?=\S)")
#: Characters encoded at once of a text that isn't plain.
LONG = 1 << 16
_OTHER_WHITE = [chr(c) for c in range(0x3001) if chr(c).isspace() and chr(c) not in " \n"]


def is_plain(text: str) -> bool:
    """True if all white space are single spaces and single line feeds between other characters."""
    if not text or text[0] in " \n" or text[-1] in " \n" or "<|" in text:
        return False
    return not ("  " in text or "\n " in text or " \n" in text or "\n\n" in text or any(c in text for c in _OTHER_WHITE))


class WordIds:
    """Token ids of texts by their words; each distinct word is encoded once while it is remembered.

    The tokenizer splits before the space of a word and around a single line feed, so the ids of a plain text are
    those of its words, each with the space or line feed before it. A word of the memory that begins with a line feed
    has that, any other a space. ids are held as unsigned 32-bit little-endian bytes.
    """

    def __init__(self, path: str):
        self.tokenizer, self.known = load(path), {}
        self.begins = np.zeros(max(self.tokenizer.get_vocab().values()) + 1, bool)
        for piece, i in self.tokenizer.get_vocab().items():
            self.begins[i] = piece.startswith("\u0120") or piece == "\u010a"  # the vocabulary's signs for space and line feed

    def _encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, "<u4") for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _words(self, words: list[str]) -> dict[str, bytes]:
        """Many words as one text; each begins with a piece that has its space or line feed."""
        groups = [words[i : i + TOGETHER] for i in range(0, len(words), TOGETHER)]
        out = {}
        for group, ids in zip(groups, self._encode(["".join(w if w[0] == "\n" else " " + w for w in g) for g in groups]), strict=True):
            at = np.flatnonzero(self.begins[ids])
            if len(at) != len(group):
                raise ValueError("this tokenizer doesn't begin each word with a piece of its own")
            raw = ids.tobytes()
            bounds = [*(at * 4).tolist(), len(raw)]
            out.update(zip(group, [raw[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)], strict=True))
        return out

    def _whole(self, text: str) -> np.ndarray:
        parts, start = [], 0
        while len(text) - start > LONG and (cut := SAFE.search(text, start + LONG)):
            parts.append(text[start : cut.start()])
            start = cut.start()
        return np.concatenate(self._encode([*parts, text[start:]]))

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        words = [("\n" + t).replace("\n", " \n").split(" ")[1:] if is_plain(t) else None for t in texts]
        new = list(set().union(*[own for own in words if own]).difference(self.known))
        fresh = self._words(new)
        if len(self.known) + len(new) <= REMEMBERED:
            self.known |= fresh
            fresh = {}
        get, other = self.known.get, fresh.get
        out = []
        for text, own in zip(texts, words, strict=True):
            if own is None:
                out.append(self._whole(text) if text else np.zeros(0, "<u4"))
            else:  # without the line feed put before the first word
                raw = b"".join([get(w) or other(w) for w in own] if fresh else map(self.known.__getitem__, own))
                out.append(np.frombuffer(raw, "<u4")[1:])
        return out


@lru_cache(maxsize=1)
def word_ids(path: str) -> WordIds:
    """One for each worker process, so that its tasks share the remembered words."""
    return WordIds(path)


def difference(sizes: np.ndarray, windows: int) -> np.ndarray:
    """The window of each size, by multiway Karmarkar-Karp differencing of partial partitions."""
    if not len(sizes):
        return np.zeros(0, np.int64)
    order = np.argsort(-sizes, kind="stable")
    heap, members = [], []
    for t, start in enumerate(range(0, len(order), windows)):
        own = order[start : start + windows]
        sums = np.zeros(windows, np.int64)
        sums[: len(own)] = sizes[own]
        members.append([[i] for i in own] + [[] for _ in range(windows - len(own))])
        heap.append((-(int(sums.max()) - int(sums.min())), t, sums))
    heapq.heapify(heap)
    while len(heap) > 1:
        (_, a, x), (_, b, y) = heapq.heappop(heap), heapq.heappop(heap)
        down, up = np.argsort(-x, kind="stable"), np.argsort(y, kind="stable")
        sums = x[down] + y[up]
        members.append([members[a][i] + members[b][j] for i, j in zip(down, up, strict=True)])
        members[a] = members[b] = None
        heapq.heappush(heap, (-(int(sums.max()) - int(sums.min())), len(members) - 1, sums))
    out = np.zeros(len(sizes), np.int64)
    for w, own in enumerate(members[heap[0][1]]):
        out[own] = w
    return out


def partition(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, int]:
    """(window of each size, number of windows), as few windows as differencing fits into the capacity."""
    if len(sizes) and sizes.max() > capacity:
        raise ValueError("a size exceeds the capacity")
    windows = max(1, -(-int(sizes.sum()) // capacity))
    while True:
        at = difference(sizes, windows)
        if not len(sizes) or np.bincount(at, weights=sizes, minlength=windows).max() <= capacity:
            return at, windows
        windows += 1


class _Batch:
    """Fragments that are packed together."""

    def __init__(self, capacity: int, windows: int, slack: int):
        self.capacity, self.room = capacity, windows * (capacity - slack)
        self.pieces: list[tuple] = []
        self.held = 0

    def flush(self, sequence: int) -> tuple[list[tuple], int]:
        sizes = np.array([p[2] for p in self.pieces], np.int64)
        at, windows = partition(sizes, self.capacity)
        offsets, out = [0] * windows, []
        for piece, w in zip(self.pieces, at, strict=True):
            out.append((*piece, sequence + int(w), offsets[w]))
            offsets[w] += piece[2]
        used = {w: i for i, w in enumerate(sorted({int(w) for w in at}))}
        self.pieces, self.held = [], 0
        return [(*o[:-2], sequence + used[o[-2] - sequence], o[-1]) for o in out], sequence + len(used)


def _crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def pack(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a piece: (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset).

    A null text is empty and so is its end id alone. Each id of each row lies in exactly one piece; offsets are
    gapless in a sequence, and sequence ids are gapless from 0. Rows that repeat are packed as often; null ids stay
    null; an empty table gives no rows; other columns of docs don't matter.
    """
    if capacity < 2 * FRAGMENT:
        raise ValueError(f"the capacity is at least {2 * FRAGMENT}")
    bounded_batches(docs.sparkSession)
    path = path or default_path("byte_bpe_50k.json")
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence", pa.int64()), ("offset", pa.int64())])

    def rows(found: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found, strict=True), schema, strict=True)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, batch, sequence = word_ids(path), _Batch(capacity, WINDOWS, SLACK), 0
        for table in batches:
            for part in kernel.pieces(table, "text", 1 << 20):
                ids_of = encoder.encode([t or "" for t in part.column(1).to_pylist()])
                done = []
                for doc, ids in zip(part.column(0).to_pylist(), ids_of, strict=True):
                    ids = np.append(ids, np.uint32(end_id))
                    n, start = len(ids), 0
                    while n - start >= capacity:
                        done.append((doc, start, capacity, _crc(ids[start : start + capacity]), n, sequence, 0))
                        sequence, start = sequence + 1, start + capacity
                    while start < n:
                        length = min(FRAGMENT, n - start, batch.room - batch.held)
                        batch.pieces.append((doc, start, length, _crc(ids[start : start + length]), n))
                        start, batch.held = start + length, batch.held + length
                        if batch.held == batch.room:
                            found, sequence = batch.flush(sequence)
                            done += found
                if done:
                    yield rows(done)
        if batch.pieces:
            yield rows(batch.flush(sequence)[0])

    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    packed = texts.mapInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence long, offset long")
    packed = materialise(packed.withColumn("part", F.spark_partition_id()), "packed")
    # one row a task: where its sequences begin among all
    parts = packed.groupBy("part").agg((F.max("sequence") + 1).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select("part", before.alias("before"))
    out = packed.join(F.broadcast(parts), "part")
    return out.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("before") + F.col("sequence")).alias("sequence_id"), "offset")
