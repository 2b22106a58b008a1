"""Bits of bounded size for a set of keys, to leave rows out of a shuffle.

A set bit says that a row's key may be in the set, one that is not set that it
surely is not: rows that may be in it are still joined or grouped exactly.  At
most 2^28 bits (32 MB) are broadcast whatever the number of keys; beyond that
more rows pass, and results stay the same."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_BITS = 28
_BLOCK = 15  # bits of a place inside one block, the size of ``bitmap_construct_agg``


def key_hash(keys: list[str]) -> Column:
    return F.xxhash64(*keys).alias("_h")


def _place(bits: int) -> tuple[Column, Column]:
    place = F.col("_h").bitwiseAND(F.lit((1 << bits) - 1))
    return F.shiftright(place, _BLOCK), place.bitwiseAND(F.lit((1 << _BLOCK) - 1))


def split_by_keys(df: DataFrame, hashes: DataFrame, keys: list[str], n: int) -> tuple[DataFrame | None, DataFrame | None]:
    """The rows of `df` whose key may have one of the `n` hashes (column _h, by
    ``key_hash``): all that do, and about one in twenty of the others until the
    bits run out; and the rest.  None where there surely are no such rows.
    `df` is read once for each part, and is shuffled in neither."""
    if any("collate" in df.schema[k].dataType.simpleString() for k in keys):
        return df, None  # equal texts have other hashes
    if not n:
        return None, df
    bits = min(MAX_BITS, max(_BLOCK, (16 * n).bit_length()))
    block, bit = _place(bits)
    # dealt by block first: each task has few of them, and not a part of every one
    blocks = hashes.select(block.alias("_block"), bit.alias("_bit")).repartition("_block").groupBy("_block").agg(F.bitmap_construct_agg("_bit").alias("_bits"))
    marked = df.withColumn("_h", key_hash(keys)).withColumns({"_block": block, "_bit": bit}).join(F.broadcast(blocks), "_block", "left")
    byte = F.conv(F.hex(F.substring("_bits", (F.shiftright("_bit", 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    may = F.coalesce(F.getbit(byte, F.col("_bit").bitwiseAND(F.lit(7)).cast("int")) == 1, F.lit(False))
    return marked.where(may).select(df.columns), marked.where(~may).select(df.columns)
