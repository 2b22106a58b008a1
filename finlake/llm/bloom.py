"""A bit filter of bounded size over 64-bit keys, to leave out rows before a
shuffle.  It only ever lets through too much: what passes is joined exactly
afterwards.  At most 2^27 bits (16 MB) reach the driver whatever the number of
keys; beyond that the filter lets more through, and results stay the same."""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_BITS = 27
_BLOCK = 16  # bits of a position inside one block


def _positions(key: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    key = key.astype(np.int64).view(np.uint64)
    mask = np.uint64((1 << bits) - 1)
    return (key & mask).astype(np.int64), ((key >> np.uint64(32)) & mask).astype(np.int64)


def build(keys: DataFrame, column: str) -> np.ndarray:
    """The filter's bits as bytes of 0 or 1 packed eight to one; keys must be
    well mixed hashes.  One small row per 2^16 positions reaches the driver."""
    n = keys.count()
    bits = min(MAX_BITS, max(_BLOCK, (16 * n).bit_length()))

    def positions(batches):
        for b in batches:
            for p in _positions(b.column(0).to_numpy(zero_copy_only=False), bits):
                p = np.unique(p)
                yield pa.RecordBatch.from_arrays([pa.array(p >> _BLOCK), pa.array(p & ((1 << _BLOCK) - 1))], ["block", "bit"])

    def block(key, table):
        b = np.zeros(1 << _BLOCK, bool)
        b[table.column("bit").to_numpy()] = True
        return pa.table({"block": [key[0].as_py()], "bits": [np.packbits(b).tobytes()]},
                        schema=pa.schema([("block", pa.int64()), ("bits", pa.binary())]))

    found = (keys.select(column).where(F.col(column).isNotNull()).mapInArrow(positions, "block long, bit long").distinct()
             .groupBy("block").applyInArrow(block, "block long, bits binary").collect())
    out = np.zeros(1 << (bits - 3), np.uint8)
    size = 1 << (_BLOCK - 3)
    for r in found:
        out[r["block"] * size:(r["block"] + 1) * size] = np.frombuffer(bytes(r["bits"]), np.uint8)
    return out


def contains(filter_: np.ndarray, key: np.ndarray) -> np.ndarray:
    bits = (8 * len(filter_)).bit_length() - 1
    ok = np.ones(len(key), bool)
    for p in _positions(key, bits):
        ok &= (filter_[p >> 3] >> (7 - (p & 7)).astype(np.uint8)) & 1 == 1
    return ok
