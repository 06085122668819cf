"""A blocked Bloom filter in native expressions.

One hash picks a 64-bit block; BITS further groups of its bits name bits of that block, all of which must be set. The
filter has at most MAX_BLOCKS blocks, 512 KB, whatever it holds, and travels as one scalar value; with more entries it
only lets more false positives through to whatever exact test follows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_BLOCKS = 65_536
BLOCKS_PER_ENTRY = 0.25
BITS = 6


def blocks_for(entries: int) -> int:
    """A power of two in proportion to the entries, 16 bits each, up to the bound."""
    blocks = 64
    while blocks < min(MAX_BLOCKS, BLOCKS_PER_ENTRY * entries):
        blocks *= 2
    return blocks


def _block(h: Column, blocks: int) -> Column:
    return F.shiftrightunsigned(h, 40).bitwiseAND(blocks - 1).cast("int")


def _mask(h: Column) -> Column:
    mask = F.lit(0).cast("long")
    for i in range(BITS):
        at = F.shiftrightunsigned(h, 6 * i).bitwiseAND(63).cast("int")
        mask = mask.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), at))
    return mask


def build(hashes: DataFrame, col: str, entries: int) -> Column:
    """The filter of a column of 64-bit hashes, as a scalar array of blocks."""
    blocks = blocks_for(entries)
    h = F.col(col)
    words = hashes.select(_block(h, blocks).alias("block"), _mask(h).alias("mask")).groupBy("block").agg(F.bit_or("mask").alias("word"))
    placed = words.agg(F.map_from_entries(F.collect_list(F.struct("block", "word"))).alias("m"))
    word = lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0).cast("long"))
    return placed.select(F.transform(F.sequence(F.lit(0), F.lit(blocks - 1)), word)).scalar()


def passes(words: Column, h: Column, entries: int) -> Column:
    """False only for hashes that are not in the filter built for that many entries."""
    return F.get(words, _block(h, blocks_for(entries))).bitwiseAND(_mask(h)) == _mask(h)
