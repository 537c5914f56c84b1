"""Product codes of vectors in integers alone, compared in Walsh-Hadamard order.

A vector is cut into equal parts; each part's place has a codebook of entries.
Part and entries are padded with zeros to a power of two and transformed by the
Walsh-Hadamard matrix H, whose rows are in sequency order (by number of sign
changes). As |Hx - Hy|^2 = P |x - y|^2 for parts of P places, squared
differences of the transforms add up to P times the squared distance. Slow
signs hold most of what tells entries apart, so after a few places most entries
already exceed the whole distance of the best one so far and are dropped.
Everything is in integers, so equal distances are seen as equal: ties go to the
entry of lower index.

Where 64-bit integers could overflow, a batch is computed in Python's integers.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.llm.storage import store, text_batches

#: A component becomes the integer below SCALE times it.
SCALE = 4096
PARTS, ENTRIES, ROUNDS = 8, 16, 6
#: Digits of the sums of a round are added up by Spark in this base, so that no sum overflows.
LIMB_BITS = 32
#: Rows that are compared together.
BLOCK_ROWS = 4096
#: Labels that hold at least this share of the rows are joined by a broadcast: there can be no more of them than its inverse.
HOT_SHARE = 1 / 4096
LARGEST = 2**63 - 1


class Codebooks(NamedTuple):
    """``entries[part][entry]`` is a tuple of integers; all parts have ``width`` places."""

    width: int
    entries: list[list[tuple[int, ...]]]

    def sha256(self) -> str:
        """Digest of all components by part, entry and place, joined by commas."""
        return hashlib.sha256(",".join(str(v) for book in self.entries for e in book for v in e).encode()).hexdigest()


# ---- transform --------------------------------------------------------------

@cache
def sequency_order(places: int) -> np.ndarray:
    """Rows of the natural Hadamard matrix of a power of two, by number of sign changes."""
    rows = np.arange(places)
    signs = np.array([[bin(r & c).count("1") & 1 for c in rows] for r in rows])
    return np.argsort((signs[:, 1:] != signs[:, :-1]).sum(axis=1), kind="stable")


def transform(values: np.ndarray) -> np.ndarray:
    """Walsh-Hadamard transform of rows, padded with zeros to a power of two, in sequency order."""
    n, width = values.shape
    places = 1 << max(0, width - 1).bit_length()
    out = np.zeros((n, places), dtype=values.dtype)
    out[:, :width] = values
    step = 1
    while step < places:
        pairs = out.reshape(n, places // (2 * step), 2, step)
        out = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], axis=2).reshape(n, places)
        step *= 2
    return out[:, sequency_order(places)]


def nearest(parts: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Index of the nearest entry to each row, its squared distance, and the
    number of (row, entry, place) terms that were computed.

    Both hold integers of one kind. The first places give each row a leader,
    whose whole distance is the bound; entries beyond it are dropped place by
    place. Ties go to the lower index.
    """
    x, e = transform(parts), transform(entries)
    (n, places), k = x.shape, len(e)
    first = max(1, places // 4)
    part = sum((x[:, s, None] - e[None, :, s]) ** 2 for s in range(first))
    leader = part.argmin(axis=1) if n else np.zeros(0, dtype=np.int64)
    bound = part[np.arange(n), leader]
    for s in range(first, places):
        bound = bound + (x[:, s] - e[leader, s]) ** 2
    terms = n * (k * first + places - first)
    row, entry = np.nonzero(part <= bound[:, None])
    part = part[row, entry]
    for s in range(first, places):
        part = part + (x[row, s] - e[entry, s]) ** 2
        terms += len(row)
        alive = part <= bound[row]
        if not alive.all():
            row, entry, part = row[alive], entry[alive], part[alive]
    if not n:
        return np.zeros(0, dtype=np.int64), bound, terms
    # The leader of every row is left, so each row has a stretch; in it entries ascend.
    starts = np.searchsorted(row, np.arange(n))
    best = np.minimum.reduceat(part, starts)
    at = np.flatnonzero(part == best[row])
    found = at[np.searchsorted(row[at], np.arange(n))]
    return entry[found], best // places, terms


# ---- integers ---------------------------------------------------------------

def _integer(value: float) -> int:
    return int(value) * SCALE if abs(value) >= 2.0**53 else math.floor(value * SCALE)


def integers(values: np.ndarray, width: int) -> np.ndarray:
    """Components as integers; Python's own where sums of squares may leave 64 bits."""
    if float(np.abs(values).max(initial=0.0)) * SCALE < 2.0 ** ((58 - 3 * max(1, width).bit_length()) // 2):
        return np.floor(values * float(SCALE)).astype(np.int64)
    flat = np.empty(values.size, dtype=object)
    flat[:] = [_integer(v) for v in values.ravel().tolist()]
    return flat.reshape(values.shape)


def _as_array(entries: list[tuple[int, ...]], like: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The entries and the rows that they meet, in integers of one kind."""
    limit = 1 << ((58 - 3 * max(1, like.shape[1]).bit_length()) // 2)
    big = like.dtype == object or any(abs(v) >= limit for e in entries for v in e)
    kind = object if big else np.int64
    out = np.empty((len(entries), like.shape[1]), dtype=kind)
    for i, e in enumerate(entries):
        out[i] = list(e)
    return out, like.astype(kind)


def limbs(value: int) -> Iterator[tuple[int, int]]:
    """(number, digit) with value = sum of digit * 2^(LIMB_BITS * number); the last digit has the sign."""
    number, half = 0, 1 << (LIMB_BITS - 1)
    while not -half <= value < half:
        yield number, value & ((1 << LIMB_BITS) - 1)
        value >>= LIMB_BITS
        number += 1
    yield number, value


def _vectors(column: pa.Array, places: int) -> np.ndarray:
    """Rows of an Arrow list column as doubles, shorter ones padded with zeros."""
    sizes = np.asarray(column.value_lengths().to_numpy(zero_copy_only=False), dtype=np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if len(sizes) == 0 or (sizes == places).all():
        return flat.reshape(len(sizes), places)
    out = np.zeros((len(sizes), places))
    starts = np.cumsum(sizes) - sizes
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(starts, sizes)] = flat
    return out


# ---- training ---------------------------------------------------------------

def finite_vectors(vectors: DataFrame) -> DataFrame:
    """(vec_id, label, embedding) of rows whose vector has components, all of them finite."""
    def broken(c):
        return c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))

    exact = vectors.schema["embedding"].dataType.simpleString() in ("array<float>", "array<double>")
    embedding = F.col("embedding") if exact else F.col("embedding").cast("array<double>")
    kept = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "label", embedding.alias("embedding"))
    return kept.where(F.col("embedding").isNotNull() & (F.size("embedding") > 0) & ~F.exists("embedding", broken))


def train(kept: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> Codebooks:
    """Codebooks after ``rounds`` of assignment and replacement by means, from
    the first rows by (vec_id, vector); null ids come last.

    Every round is a pass over all rows. A task sends one row for each digit of
    each component's sum, and Spark adds them up: what comes to the driver has
    the size of the codebooks.
    """
    longest = kept.agg(F.max(F.size("embedding"))).first()[0] or 0
    width = -(-longest // parts)
    places = parts * width
    first = [r["embedding"] for r in kept.orderBy(F.asc_nulls_last("vec_id"), "embedding").select("embedding").limit(entries).collect()]
    starts = [[_integer(v) for v in e] + [0] * (places - len(e)) for e in first]
    books = Codebooks(width, [[tuple(s[p * width : (p + 1) * width]) for s in starts] for p in range(parts)])

    def sums(books: Codebooks):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            totals: dict[tuple[int, int, int], int] = {}
            for batch in batches:
                for low in range(0, batch.num_rows, BLOCK_ROWS):
                    rows = integers(_vectors(batch.column(0).slice(low, BLOCK_ROWS), places), width)
                    for p, book in enumerate(books.entries):
                        entry_rows, mine = _as_array(book, rows[:, p * width : (p + 1) * width])
                        chosen, _, _ = nearest(mine, entry_rows)
                        for k in np.unique(chosen).tolist():
                            of = mine[chosen == k]
                            for place, total in enumerate([len(of), *of.sum(axis=0).tolist()]):
                                totals[p, k, place] = totals.get((p, k, place), 0) + int(total)
            found = [(p, k, place, number, digit) for (p, k, place), total in totals.items() for number, digit in limbs(total)]
            columns = list(zip(*found, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["part", "entry", "place", "limb", "digit"])

        return run

    for _ in range(rounds if first else 0):
        digits = kept.select("embedding").mapInArrow(sums(books), "part long, entry long, place long, limb long, digit long")
        added = digits.groupBy("part", "entry", "place", "limb").agg(F.sum("digit").alias("digit")).collect()
        totals: dict[tuple[int, int, int], int] = {}
        for r in added:
            key = (r["part"], r["entry"], r["place"])
            totals[key] = totals.get(key, 0) + (r["digit"] << (LIMB_BITS * r["limb"]))
        new = [[tuple(totals[p, k, j + 1] // totals[p, k, 0] for j in range(width)) if (p, k, 0) in totals else e
                for k, e in enumerate(book)] for p, book in enumerate(books.entries)]
        books = Codebooks(width, new)
    return books


# ---- codes ------------------------------------------------------------------

def encode(kept: DataFrame, books: Codebooks) -> DataFrame:
    """(vec_id, label, code, error): two hex digits for each part, and the sum
    of squared distances; one beyond a long's largest value is given as that."""
    width, places = books.width, books.width * len(books.entries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, errors = [], []
            for low in range(0, batch.num_rows, BLOCK_ROWS):
                rows = integers(_vectors(batch.column("embedding").slice(low, BLOCK_ROWS), places), width)
                chosen, error = [], 0
                for p, book in enumerate(books.entries):
                    entry_rows, mine = _as_array(book, rows[:, p * width : (p + 1) * width])
                    index, distance, _ = nearest(mine, entry_rows)
                    chosen.append(index)
                    error = error + distance
                codes += [bytes(c).hex() for c in np.stack(chosen, axis=1).astype(np.uint8)]
                errors += [min(e, LARGEST) for e in error.tolist()]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array(codes, pa.string()), pa.array(errors, pa.int64())],
                                             names=["vec_id", "label", "code", "error"])

    label = kept.schema["label"].dataType.simpleString()
    return kept.select("vec_id", "label", "embedding").mapInArrow(run, f"vec_id long, label {label}, code string, error long")


def decode(codes: DataFrame, books: Codebooks) -> DataFrame:
    """Add ``approximation``: the entries that a code names, end to end, scaled back."""
    table = F.array(*[F.array(*[F.array(*[F.lit(v / SCALE) for v in e]) for e in book]) for book in books.entries])
    index = [F.conv(F.substring("code", 2 * p + 1, 2), 16, 10).cast("int") for p in range(len(books.entries))]
    return codes.withColumn("approximation", F.flatten(F.array(*[F.get(F.get(table, F.lit(p)), i) for p, i in enumerate(index)])))


def with_label_error(codes: DataFrame) -> DataFrame:
    """Add ``label_error``: the error of all rows of the same label, nulls together.

    Sums are made by the map side first; like errors they end at a long's
    largest value. Labels with a large share of the rows
    are few by definition and are joined where the rows are; the others by a
    shuffle.
    """
    sums = store(codes.groupBy("label").agg(F.coalesce(F.try_sum("error"), F.lit(LARGEST)).alias("label_error"), F.count("*").alias("n")), "label-errors")
    total = sums.agg(F.sum("n")).first()[0] or 0
    hot = F.col("n") >= HOT_SHARE * total
    same = F.col("l.label").eqNullSafe(F.col("r.label"))
    columns = [F.col(f"l.{c}") for c in codes.columns]
    often, rest = sums.where(hot), sums.where(~hot)
    near = codes.alias("l").join(F.broadcast(often.alias("r")), same).select(*columns, "r.label_error")
    if rest.isEmpty():
        return near
    far = codes.alias("l").join(F.broadcast(often.alias("r")), same, "left_anti").alias("l").join(rest.alias("r"), same)
    return near.unionByName(far.select(*columns, "r.label_error"))


def vector_codes(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """Code, error, error of the label and codebooks' digest of every vector.

    Rows without a vector, or with null or non-finite components, are left out;
    so are vectors without components. Shorter vectors than the longest, and
    parts of a length that does not divide, are padded with zeros. Repeated
    rows are rows; null ids and labels are kept. With fewer rows than entries a
    codebook has as many entries as rows. No vectors give no rows. Other
    columns are ignored.
    """
    text_batches(vectors.sparkSession)
    kept = store(finite_vectors(vectors), "vectors")
    books = train(kept, parts, entries, rounds)
    coded = store(encode(kept, books), "codes") if books.width else encode(kept, books)
    return with_label_error(coded).select("vec_id", "code", "error", "label_error", F.lit(books.sha256()).alias("codebooks_sha256"))
