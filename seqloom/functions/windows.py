"""Sliding windows over sequences as array expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from seqloom.functions.text import AMBIGUOUS_CLASS


def _slices(segment: Column, k: Column, as_bytes: bool) -> Column:
    # Cutting a binary value costs O(k); cutting a string scans it from its
    # start, which is quadratic in the length of the sequence.
    body = segment.cast("binary") if as_bytes else segment
    return F.transform(F.sequence(F.lit(1), F.length(segment) - k + 1),
                       lambda i: F.substring(body, i, k).cast("string"))


def _segments(seq: Column, skip_ambiguous: bool) -> Column:
    return F.split(seq, AMBIGUOUS_CLASS) if skip_ambiguous else F.array(seq)


def kmers(seq: Column, k: int | Column, skip_ambiguous: bool = True, as_bytes: bool = True) -> Column:
    """All windows of ``k`` letters; an empty array for shorter sequences.

    A window free of ambiguous codes lies within a stretch between them, so
    the sequence is split there once rather than testing each window.
    The length filter also keeps ``sequence`` from counting downwards.
    """
    k = F.lit(k) if isinstance(k, int) else k
    long_enough = F.filter(_segments(seq, skip_ambiguous), lambda s: F.length(s) >= k)
    return F.flatten(F.transform(long_enough, lambda s: _slices(s, k, as_bytes)))


def distinct_kmers(seq: Column, k: int | Column, skip_ambiguous: bool = True) -> Column:
    """Windows with repeats removed inside the row, before any shuffle.

    Text outside ASCII has characters of several bytes and takes the slower
    character path.
    """
    ascii_only = F.length(seq) == F.octet_length(seq)
    return F.array_distinct(
        F.when(ascii_only, kmers(seq, k, skip_ambiguous, as_bytes=True))
        .otherwise(kmers(seq, k, skip_ambiguous, as_bytes=False)))


def window_count(seq: Column, k: int) -> Column:
    """Number of windows, ambiguous ones included."""
    return F.greatest(F.length(seq) - k + 1, F.lit(0)).cast("bigint")


def clean_window_count(seq: Column, k: int) -> Column:
    """Number of windows without ambiguous codes."""
    return F.aggregate(F.split(seq, AMBIGUOUS_CLASS), F.lit(0).cast("bigint"),
                       lambda acc, s: acc + F.greatest(F.length(s) - k + 1, F.lit(0)))
