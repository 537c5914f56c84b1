"""Bloom filters, one for each class of hashes.

Tasks set bits with Spark's bitmap aggregate; bitmaps of 4 KB are merged by the
shuffle, and only finished ones come to the driver. A class gets bits for its
own number of hashes, so one that is rare is not drowned by one that is not.
If all together would pass the bound, the largest give way: a filter then lets
more through, and never drops anything that is in it.
"""

from __future__ import annotations

import sys

import numpy as np
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bits for each hash, of which two are set: about 1.4 % of other hashes pass.
BITS_PER_HASH = 16
#: Bytes of all filters of a broadcast.
FILTER_BYTES = 64 << 20
#: Bits of one bitmap of Spark's aggregate (2^15); no filter is smaller.
_BITMAP = 15


class BloomFilters:
    """``tables[m]`` are the bytes of class ``m``'s filter; their bits are a power of two."""

    def __init__(self, tables: dict[int, np.ndarray]):
        self.tables = tables

    def contains(self, m: int, hashes: np.ndarray) -> np.ndarray:
        table = self.tables.get(m)
        if table is None:
            return np.zeros(len(hashes), bool)
        mask = np.int64(8 * len(table) - 1)
        out = _bit(table, hashes & mask)
        maybe = np.flatnonzero(out)
        out[maybe] = _bit(table, ((hashes[maybe].view(np.uint64) >> np.uint64(32)).view(np.int64)) & mask)
        return out


def _bit(table: np.ndarray, at: np.ndarray) -> np.ndarray:
    return ((table[at >> 3] >> (at & 7).astype(np.uint8)) & 1).astype(bool)


def filter_bits(counts: dict[int, int], most_bytes: int) -> dict[int, int]:
    """Bits of each class's filter as powers of two."""
    bits = {m: max(_BITMAP, (BITS_PER_HASH * max(1, n) - 1).bit_length()) for m, n in counts.items()}
    while sum(1 << b for b in bits.values()) > 8 * most_bytes and max(bits.values()) > _BITMAP:
        bits[max(bits, key=lambda m: (bits[m], m))] -= 1
    return {m: min(b, 32) for m, b in bits.items()}


def build_filters(hashes: DataFrame, column: str = "seed") -> BloomFilters:
    """Filters over (m, ``column``) of all rows."""
    counts = {r["m"]: r["n"] for r in hashes.groupBy("m").agg(F.count("*").alias("n")).collect()}  # one row per class
    bits = filter_bits(counts, FILTER_BYTES)
    if not bits:
        return BloomFilters({})
    mask = F.create_map(*[F.lit(v) for m, b in bits.items() for v in (m, (1 << b) - 1)])[F.col("m")]
    value = F.col(column)
    at = F.explode(F.array(value.bitwiseAND(mask), F.shiftrightunsigned(value, 32).bitwiseAND(mask)))
    places = hashes.select("m", at.alias("at")).select("m", F.shiftright("at", _BITMAP).alias("bucket"), F.col("at").bitwiseAND((1 << _BITMAP) - 1).alias("bit"))
    tables = {m: np.zeros(1 << (b - 3), np.uint8) for m, b in bits.items()}
    size = 1 << (_BITMAP - 3)
    for r in places.groupBy("m", "bucket").agg(F.bitmap_construct_agg("bit").alias("map")).toLocalIterator():
        tables[r["m"]][r["bucket"] * size : (r["bucket"] + 1) * size] = np.frombuffer(r["map"], np.uint8)
    return BloomFilters(tables)


# Workers need not have this package installed: ship the functions themselves.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
