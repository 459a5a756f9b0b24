"""A blocked Bloom filter in DataFrame expressions: one 64-bit word per block."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words of a filter at most (8 bytes each): more keys only let more false hits pass.
MAX_BLOCKS = 1 << 20


def blocks_for(keys: int, limit: int = MAX_BLOCKS) -> int:
    """About sixteen bits a key, up to the limit."""
    blocks = 64
    while blocks < limit and blocks * 4 < keys:
        blocks *= 2
    return min(blocks, limit)


def _mask(key: Column) -> Column:
    """Four of the 64 bits of a block."""
    h = F.xxhash64(key, F.lit(7))
    bits = None
    for shift in (0, 6, 12, 18):
        place = F.shiftrightunsigned(h, shift).bitwiseAND(63).cast("int")
        bit = F.call_function("shiftleft", F.lit(1).cast("long"), place)
        bits = bit if bits is None else bits.bitwiseOR(bit)
    return bits


def bloom_words(keys: DataFrame, blocks: int) -> Column:
    """The filter of column ``key`` as a scalar: an array of ``blocks`` 64-bit words."""
    filled = keys.groupBy(F.pmod(F.xxhash64("key"), F.lit(blocks)).alias("id")).agg(
        F.bit_or(_mask(F.col("key"))).alias("word")
    )
    dense = keys.sparkSession.range(blocks).join(filled, "id", "left")
    ordered = F.array_sort(F.collect_list(F.struct("id", F.coalesce("word", F.lit(0).cast("long")).alias("word"))))
    return dense.agg(ordered.getField("word")).scalar()


def may_contain(words: Column | str, blocks: int, key: Column) -> Column:
    """False only for keys that the filter was not made of."""
    return F.element_at(words, (F.pmod(F.xxhash64(key), F.lit(blocks)) + 1).cast("int")).bitwiseAND(_mask(key)) == _mask(key)
