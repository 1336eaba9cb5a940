"""A one-hash Bloom filter of built-in bitmap functions, small enough to broadcast by construction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits in a bitmap of Spark's bitmap functions.
PAGE = 32_768
#: The largest filter: 2^27 bits are 16 MB, a bound that doesn't depend on the data. Beyond it the filter prunes less and stays right.
MOST_BITS = 1 << 27


def bits_for(n: int) -> int:
    """Sixteen bits a key, as a power of two between a page and MOST_BITS."""
    return min(MOST_BITS, max(PAGE, 1 << (16 * max(n, 1) - 1).bit_length()))


def build(keys: DataFrame, hashed: Column, bits: int) -> DataFrame:
    """(page, bitmap) of the hashes; at most bits / PAGE rows of 4 KB."""
    at = F.pmod(hashed, F.lit(bits)) + 1
    return keys.select(F.bitmap_bucket_number(at).alias("_page"), F.bitmap_bit_position(at).alias("_bit")).groupBy("_page").agg(F.bitmap_construct_agg("_bit").alias("_bitmap"))


def probe(rows: DataFrame, hashed: Column, pages: DataFrame, bits: int) -> DataFrame:
    """rows with the boolean _maybe: false only if the hash isn't in the filter. A map-side join with the few pages."""
    at = F.pmod(hashed, F.lit(bits)) + 1
    out = rows.withColumn("_at", at).withColumn("_page", F.bitmap_bucket_number("_at"))
    out = out.join(F.broadcast(pages), "_page", "left")
    byte = F.conv(F.hex(F.substring(F.col("_bitmap"), (F.bitmap_bit_position("_at") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("long")
    maybe = F.coalesce(F.getbit(byte, (F.bitmap_bit_position("_at") % 8).cast("int")) == 1, F.lit(False))
    return out.withColumn("_maybe", maybe).drop("_at", "_page", "_bitmap")
