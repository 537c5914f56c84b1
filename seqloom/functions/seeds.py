"""Content-chosen seeds for containment joins.

A pattern of at least ``m`` bytes consists of ``m``-byte windows. From every
such window the seed with the smallest hash is kept (a minimizer). The choice
depends on the window alone, so each seed of a pattern is also a seed of every
text that contains it: equality of seeds loses no match. Neighbouring windows
mostly agree, so a text yields only about ``2L / (m - s + 2)`` seeds of length
``s``, and the sum over all length classes stays below a few rows per byte.

Containment of UTF-8 text equals containment of its bytes, so whole Arrow
buffers are hashed at once, without a Python step per row.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seqloom.functions.bloom import BloomFilters

# Length classes: a pattern uses the largest one that fits it.
CLASSES = (1, 2, 3, 4, 5, 6, 7, 8, 12, 16, 32, 64, 128, 256, 512, 1024, 2048, 4096)

_STEP = 1 << 17  # bytes hashed at a time, so that arrays stay in cache
_PIECE = 1 << 18  # bytes of texts whose seeds are held at a time, unless a single text is longer
_BASE = 0x9E3779B97F4A7C15
_MIX = np.uint64(0xD6E8FEB86659FD93)


def seed_length(m: int) -> int:
    """Seed length of class ``m``: short classes use the whole window."""
    return {12: 10, 16: 12, 32: 20}.get(m, min(m, 32))


class _Powers:
    """Powers of the hash base and of its inverse, grown on demand per worker."""

    up = np.ones(1, np.uint64)
    down = np.ones(1, np.uint64)

    @classmethod
    def upto(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            inverse = pow(_BASE, -1, 1 << 64)
            for name, base in (("up", _BASE), ("down", inverse)):
                steps = np.full(n, base, np.uint64)
                steps[0] = 1
                setattr(cls, name, np.cumprod(steps, dtype=np.uint64))
        return cls.up[:n], cls.down[:n]


def _mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h *= _MIX
    h ^= h >> np.uint64(29)
    return h


def _prefix_sums(data: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _Powers.upto(len(data))[0], out=sums[1:])
    return sums


def _window_hashes(sums: np.ndarray, s: int) -> np.ndarray:
    """Hash of every ``s``-byte window, from prefix sums."""
    n = len(sums) - s
    return _mixed((sums[s:] - sums[:-s]) * _Powers.upto(len(sums))[1][:n])


def _sliding_mins(h: np.ndarray, widths: list[int]) -> Iterator[np.ndarray]:
    """Minimum of each run of ``w`` values for ascending widths.

    Runs of a power of two are doubled; two overlapping ones cover any width.
    """
    size, low = 1, h
    for w in widths:
        while size * 2 <= w:
            low = np.minimum(low[:-size], low[size:])
            size *= 2
        yield low if w == size else np.minimum(low[: len(h) - w + 1], low[w - size :])


def _buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of an Arrow string column."""
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def _seeds(data: np.ndarray, offsets: np.ndarray, classes: list[int],
           keep: BloomFilters | None) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Per class the (row, seed) pairs, each once."""
    starts, ends, total = offsets[:-1], offsets[1:], int(offsets[-1])
    found: dict[int, list] = {m: [] for m in classes}
    same_length: dict[int, list[int]] = {}
    for m in classes:
        same_length.setdefault(seed_length(m), []).append(m)
    for lo in range(0, total, _STEP):
        sums = _prefix_sums(data[lo : lo + _STEP + classes[-1] - 1])
        for s, members in same_length.items():
            members = [m for m in members if m < len(sums)]
            if not members:
                continue
            hashes = _window_hashes(sums, s)
            for m, low in zip(members, _sliding_mins(hashes, [m - s + 1 for m in members])):
                low = low[:_STEP]
                fresh = np.ones(len(low), bool)
                fresh[1:] = low[1:] != low[:-1]
                first, last = np.searchsorted(starts, [lo, lo + len(low)])
                fresh[starts[first:last] - lo] = True
                at = np.flatnonzero(fresh)
                seed = _mixed(low[at] + np.uint64(m)).view(np.int64)
                if keep is not None:
                    hit = keep.contains(m, seed)
                    at, seed = at[hit], seed[hit]
                at = at + lo
                row = np.searchsorted(ends, at, side="right")
                inside = at + m <= ends[row]
                # Short seeds repeat in nearly every byte: what is held is each one once.
                found[m].append(_each_once([(row[inside], seed[inside])]))
    return {m: _each_once(pairs) if len(pairs) > 1 else pairs[0] for m, pairs in found.items() if pairs}


def pieces(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A batch, whose first column is a text, in runs of rows of ``_PIECE`` bytes
    at most or one row. What a task holds then follows from neither the rows nor
    the texts of a batch."""
    offsets = _buffers(batch.column(0))[1]
    lo = 0
    while lo < batch.num_rows:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + _PIECE, side="right")) - 1)
        yield batch.slice(lo, hi - lo)
        lo = hi


def _each_once(pairs: list) -> tuple[np.ndarray, np.ndarray]:
    row = np.concatenate([p[0] for p in pairs])
    seed = np.concatenate([p[1] for p in pairs])
    order = np.lexsort((seed, row))
    row, seed = row[order], seed[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (seed[1:] != seed[:-1])
    return row[new], seed[new]


def _text_seeds(column: pa.Array, classes: list[int], wanted: BloomFilters | None) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    data, offsets = _buffers(column)
    longest = int(np.diff(offsets).max(initial=0))
    fitting = [m for m in classes if m <= longest]
    return _seeds(data, offsets, fitting, wanted) if fitting else {}


def _pattern_seeds(column: pa.Array, classes: list[int], wanted: BloomFilters | None) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    edges = np.array(CLASSES)
    sizes = np.diff(_buffers(column)[1])
    own = edges[np.maximum(np.searchsorted(edges, sizes, side="right") - 1, 0)]
    found = {}
    for m in classes:
        mine = np.flatnonzero((own == m) & (sizes >= m))
        if len(mine):
            row, seed = _seeds(*_buffers(column.take(pa.array(mine))), [m], wanted)[m]
            found[m] = mine[row], seed
    return found


def seed_rows(batches: Iterator[pa.RecordBatch], carry: list[str], classes: list[int], own_class: bool,
              wanted: BloomFilters | None) -> Iterator[pa.RecordBatch]:
    """(carry..., m, seed) of batches (text, carry...), a batch for each piece."""
    seeds_of = _pattern_seeds if own_class else _text_seeds
    for batch in batches:
        for piece in pieces(batch):
            found = seeds_of(piece.column(0), classes, wanted)
            row = np.concatenate([r for r, _ in found.values()] or [np.zeros(0, np.int64)])
            if len(row):
                at = pa.array(row)
                size = np.repeat(np.fromiter(found, np.int64), [len(r) for r, _ in found.values()])
                yield pa.RecordBatch.from_arrays(
                    [piece.column(i + 1).take(at) for i in range(len(carry))]
                    + [pa.array(size), pa.array(np.concatenate([s for _, s in found.values()]))],
                    names=[*carry, "m", "seed"])


def with_seeds(df: DataFrame, text: str, carry: list[str], classes: list[int],
               own_class: bool, keep=None) -> DataFrame:
    """(carry..., m, seed): one row per row of ``df``, class and seed.

    ``own_class`` takes the seeds of a row as a pattern, else those of all
    ``classes`` (ascending) that fit it as a text. ``keep`` is a broadcast of
    the filters' tables; seeds outside them are dropped where they arise.
    """
    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return seed_rows(batches, carry, classes, own_class, BloomFilters(keep.value) if keep is not None else None)

    return df.select(F.col(text).alias("_text"), *carry).mapInArrow(
        rows_of, _with_longs(df, carry, "m", "seed"))


def with_end_windows(df: DataFrame, text: str, carry: list[str]) -> DataFrame:
    """(carry..., m, first, last, gap): the windows at both ends of a pattern.

    ``m`` is the largest power of two that fits, so the two windows, ``gap``
    bytes apart, cover the whole pattern.
    """
    def end_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = _buffers(batch.column(0))
            rows, out = [], []
            for i, (lo, hi) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
                if hi > lo:
                    m = 1 << ((hi - lo).bit_length() - 1)
                    ends = [_window_hashes(_prefix_sums(data[at : at + m]), m)[0] for at in (lo, hi - m)]
                    rows.append(i)
                    out.append((m, *(int(h.view(np.int64)) for h in ends), hi - lo - m))
            if rows:
                columns = [pa.array(c, pa.int64()) for c in zip(*out)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(i + 1).take(pa.array(rows)) for i in range(len(carry))] + columns,
                    names=[*carry, "m", "first", "last", "gap"])

    return df.select(F.col(text).alias("_text"), *carry).mapInArrow(
        end_rows, _with_longs(df, carry, "m", "first", "last", "gap"))


def with_windows(df: DataFrame, text: str, carry: list[str], sizes: list[int], keep=None) -> DataFrame:
    """(carry..., m, at, hash): all windows of the given sizes, in bytes.

    ``keep`` is a broadcast of the filters' tables, as for seeds.
    """
    def window_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = BloomFilters(keep.value) if keep is not None else None
        for batch in batches:
            data, offsets = _buffers(batch.column(0))
            starts, ends = offsets[:-1], offsets[1:]
            for lo in range(0, int(offsets[-1]), _STEP):
                for m in sizes:
                    sums = _prefix_sums(data[lo : lo + _STEP + m - 1])
                    if len(sums) <= m:
                        continue
                    h = _window_hashes(sums, m).view(np.int64)
                    at = np.arange(lo, lo + len(h))
                    if wanted is not None:
                        hit = wanted.contains(m, h)
                        at, h = at[hit], h[hit]
                    row = np.searchsorted(ends, at, side="right")
                    inside = at + m <= ends[row]
                    row, at, h = row[inside], at[inside], h[inside]
                    if len(row):
                        yield pa.RecordBatch.from_arrays(
                            [batch.column(i + 1).take(pa.array(row)) for i in range(len(carry))]
                            + [pa.array(np.full(len(row), m, np.int64)), pa.array(at - starts[row]), pa.array(h)],
                            names=[*carry, "m", "at", "hash"])

    return df.select(F.col(text).alias("_text"), *carry).mapInArrow(
        window_rows, _with_longs(df, carry, "m", "at", "hash"))


def _with_longs(df: DataFrame, carry: list[str], *names: str) -> T.StructType:
    return T.StructType([T.StructField(c, df.schema[c].dataType) for c in carry]
                        + [T.StructField(n, T.LongType()) for n in names])


# Workers need not have this package installed: ship the functions themselves.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
