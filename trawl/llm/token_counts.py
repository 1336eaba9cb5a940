"""Token counts: texts are encoded in batches of about equal bytes inside an Arrow function that returns lengths only."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trawl.llm import kernel
from trawl.llm.store import bounded_batches
from trawl.llm.tokenizers_ import default_path, load

#: Bytes of text encoded by one call, and characters from which a text is split.
CALL_BYTES, LONG = 1 << 18, 1 << 16
_LETTER = "[0-9A-Za-z\u00c0-\u024f\u0391-\u03c9\u0400-\u04ff]"
#: A single space between letters or digits that no normalisation turns into white space or the space mark.
SAFE = re.compile(f"(?<={_LETTER}) (?={_LETTER})")


def split_safely(text: str, most: int = LONG) -> list[str]:
    """Parts of about ``most`` characters for sentencepiece, whose counts add up to the whole text's.

    The models' pieces have the space mark at their start only, so none spans a cut before a single space; the space
    itself goes, as each part gets the mark again at its start. Signs beside a space, the mark itself among them, may
    merge with it, so a cut is between letters or digits. A text without a safe boundary stays whole.
    """
    parts, start = [], 0
    while len(text) - start > most:
        cut = SAFE.search(text, start + most)
        if not cut:
            break
        parts.append(text[start : cut.start()])
        start = cut.end()
    return [*parts, text[start:]]


@lru_cache(maxsize=4)
def spans_spaces(path: str) -> bool:
    """True if a piece of the model has the space mark after another character: then no cut is safe."""
    processor = load(path)
    return any(re.search("[^▁]▁", processor.id_to_piece(i)) for i in range(processor.get_piece_size()))


def count_tokens(texts: list[str], path: str, long: int = LONG) -> list[int]:
    tokenizer = load(path)
    if not path.endswith(".model"):
        return [len(e) for e in tokenizer.encode_batch(texts, add_special_tokens=False)]
    if not any(len(t) > long for t in texts):
        return [len(ids) for ids in tokenizer.encode(texts, num_threads=1)]
    parts = [[t] if len(t) <= long or spans_spaces(path) else split_safely(t, long) for t in texts]
    sizes = iter([len(ids) for own in parts for ids in tokenizer.encode(own, num_threads=1)])
    return [sum(next(sizes) for _ in own) for own in parts]


def token_counts(docs: DataFrame, path: str | None = None, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for every row of docs, over whole texts.

    A null text is empty and has no tokens. Rows that repeat stay apart, a null id stays null, an empty table gives no
    rows, and other columns of docs don't matter. Special strings inside texts are handled as the library does.
    """
    bounded_batches(docs.sparkSession)
    path = path or default_path("piece_bpe_32k.model")
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("over_limit", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in kernel.pieces(batch, "text", CALL_BYTES):
                texts = [t or "" for t in part.column(1).to_pylist()]
                counts = count_tokens(texts, path)
                sizes = [len(t.encode()) for t in texts]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes, pa.int64()), pa.array(counts, pa.int64()), pa.array([n > limit for n in counts], pa.bool_())], schema=schema)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
