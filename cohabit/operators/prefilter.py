"""A hash bitmap of wanted keys, applied where rows are scanned.

The bitmap has a fixed size (``chunks`` rows of 4 KB), whatever the number of keys, so it may be broadcast.  A semi join with it stands
below the first exchange; some rows that are not wanted pass (few, while the keys are few against the bits), none
that is wanted is lost, and an exact join follows.  A bitmap that is full lets everything pass.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of Spark's bitmaps, and bitmaps by default: 4 MB, 33.5 million bits.
BITS, CHUNKS = 32_768, 1024


def _place(columns: Sequence[Column], chunks: int) -> Column:
    return F.pmod(F.xxhash64(*columns), F.lit(chunks * BITS))


def hash_bitmap(keys: DataFrame, columns: Sequence[str], chunks: int = CHUNKS) -> DataFrame:
    """(_chunk, _bits): the hashes of the keys; nulls among them are skipped."""
    place = _place([F.col(c) for c in columns], chunks)
    known = keys.where(" and ".join(f"`{c}` is not null" for c in columns)).select(place.alias("_place"))
    return known.groupBy(F.floor(F.col("_place") / BITS).alias("_chunk")).agg(F.bitmap_construct_agg(F.col("_place") % BITS).alias("_bits"))


def may_hold(df: DataFrame, bitmap: DataFrame, columns: Sequence[str], chunks: int = CHUNKS) -> DataFrame:
    """Rows whose key the bitmap may hold."""
    place = _place([F.col(c) for c in columns], chunks)
    bit = place % BITS
    byte = F.conv(F.hex(F.substring(F.col("_bits"), F.floor(bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    held = F.call_function("shiftright", byte, (bit % 8).cast("int")).bitwiseAND(F.lit(1)) == 1
    return df.join(F.broadcast(bitmap), (F.floor(place / BITS) == F.col("_chunk")) & held, "left_semi")
