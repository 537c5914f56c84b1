"""k-mers as integers, counted by the set of sources that have them.

A k-mer of at most ``MOST`` letters is a 63-bit integer of five bits a letter,
so windows are cut, told apart and counted as whole arrays. All lengths come
from one window at each position, of the greatest length, filled with zeros
where its stretch ends: the windows of a shorter length are the prefixes of
those. A task gives each of its windows once, as binary rows dealt by the
shortest prefix, so that all windows that share any prefix meet in one bucket
and every length is counted there, from one sort.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.functions.seeds import _buffers

#: The letters that fit, and the longest k-mer: five bits a letter and three for the sources.
LETTERS, MOST = "ABCDEFGHIJKLMNOPQRSTUVWXYZ*-.", 12
#: What an integer cannot hold, as a pattern.
FOREIGN = r"[^A-Z*.\-]"
_SIDES = 3
#: Letters cut at a time, windows held by a task before it deals them, and windows of a bucket aimed at.
_STEP, _HELD, _BUCKET = 1 << 20, 1 << 21, 1 << 21


def _each_once(codes: np.ndarray) -> np.ndarray:
    codes = np.sort(codes)
    new = np.ones(len(codes), bool)
    new[1:] = codes[1:] != codes[:-1]
    return codes[new]


def window_codes(data: np.ndarray, offsets: np.ndarray, side: np.ndarray, least: int, most: int, breaks: str) -> Iterator[np.ndarray]:
    """Codes of the windows of ``most`` letters at all positions, cut at ends of
    rows, foreign letters and ``breaks``; those of fewer than ``least`` are left out."""
    place = np.zeros(256, np.int64)
    for i, letter in enumerate(LETTERS):
        place[ord(letter)] = 0 if letter in breaks else i + 1
    starts = offsets[:-1]
    for lo in range(0, len(data), _STEP):
        hi = min(lo + _STEP, len(data))
        letters = place[data[lo : hi + most - 1]]
        n = hi - lo
        letters = np.concatenate([letters, np.zeros(n + most - 1 - len(letters), np.int64)])
        begins = np.zeros(len(letters), bool)
        first, last = np.searchsorted(starts, [lo, lo + len(letters)])
        begins[starts[first:last] - lo] = True
        code, inside = letters[:n].copy(), letters[:n] != 0
        for i in range(1, most):
            inside &= (letters[i : i + n] != 0) & ~begins[i : i + n]
            code = (code << 5) | np.where(inside, letters[i : i + n], 0)
        row = np.searchsorted(starts, np.arange(lo, hi), side="right") - 1
        code = (code << _SIDES) | side[row]
        yield _each_once(code[(code >> (5 * (most - least) + _SIDES)) & 31 != 0])


def _dealt(codes: np.ndarray, shift: int, buckets: int) -> pa.RecordBatch:
    prefix = (codes >> shift).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    bucket = ((prefix >> np.uint64(33)) % np.uint64(buckets)).astype(np.int32)
    order = np.argsort(bucket, kind="stable")
    bucket, codes = bucket[order], codes[order]
    at = np.flatnonzero(np.diff(bucket, prepend=-1))
    ends = np.append(at, len(codes))
    return pa.RecordBatch.from_arrays([pa.array(bucket[at]), pa.array([codes[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:])], pa.binary())],
                                      names=["bucket", "codes"])


def count_codes(codes: np.ndarray, ks: list[int]) -> dict[tuple[int, int], int]:
    """(k, sources as bits) to the number of distinct k-mers of exactly those sources."""
    codes = _each_once(codes)
    bits, found = (codes & ((1 << _SIDES) - 1)).astype(np.int8), {}
    for k in ks:
        prefix = codes >> (5 * (max(ks) - k) + _SIDES)
        whole = prefix & 31 != 0
        prefix, of = prefix[whole], bits[whole]
        if len(prefix):
            at = np.flatnonzero(np.diff(prefix, prepend=-1))
            each, n = np.unique(np.bitwise_or.reduceat(of, at), return_counts=True)
            found |= {(k, int(e)): int(c) for e, c in zip(each, n)}
    return found


def count_by_sides(sequences: DataFrame, ks: list[int], breaks: str) -> DataFrame:
    """(k, sides, n): distinct k-mers without foreign letters of (seq, side), by
    the sources that have them; bit ``side`` of ``sides`` stands for a source (0 to 2)."""
    ks, least, most = sorted(ks), min(ks), max(ks)
    total = sequences.agg(F.sum(F.octet_length("seq"))).first()[0] or 0
    buckets = 1 + total // _BUCKET

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            data, offsets = _buffers(batch.column(0))
            side = np.left_shift(1, batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64))
            for codes in window_codes(data, offsets, side, least, most, breaks):
                held.append(codes)
                size += len(codes)
                if size >= _HELD:
                    yield _dealt(_each_once(np.concatenate(held)), 5 * (most - least) + _SIDES, buckets)
                    held, size = [], 0
        if size:
            yield _dealt(_each_once(np.concatenate(held)), 5 * (most - least) + _SIDES, buckets)

    def count(rows: pa.Table) -> pa.Table:
        found = count_codes(np.concatenate([np.frombuffer(c.as_py(), np.int64) for c in rows.column("codes")]), ks)
        columns = [[k for k, _ in found], [sides for _, sides in found], list(found.values())]
        return pa.table([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.int64()))], names=["k", "sides", "n"])

    dealt = sequences.select("seq", "side").mapInArrow(cut, "bucket int, codes binary")
    return dealt.groupBy("bucket").applyInArrow(count, "k int, sides int, n bigint").groupBy("k", "sides").agg(F.sum("n").alias("n"))


# Workers need not have this package installed: ship the functions themselves.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
