"""Best-fit packing of documents into sequences by length patterns.

The plan is made from the histogram of piece lengths alone, so its cost hangs
on the sequence length and not on the number of documents. Patterns of few
lengths that fill a sequence are fitted to the histogram by non-negative least
squares; repeat counts are rounded and realised with exact lengths; what is
left goes by best fit into the gaps or into new sequences.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import combinations_with_replacement

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.llm.encoding import encoder
from seqloom.llm.ranges import running_sums
from seqloom.llm.storage import store, text_batches

#: Classes of lengths in the least-squares problem, and the most documents in a pattern.
CLASSES, PATTERN_DOCS = 128, 3
#: Pieces of one length that one task numbers.
PIECES_PER_CELL = 200_000

PIECE_SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long, ids binary"


def pieces(docs: DataFrame, tokenizer: str, max_tokens: int = 2048, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """Each document's ids and end id, cut every ``max_tokens``.

    A null text is empty: one piece with the end id alone. Repeated rows give
    repeated pieces. ``ids`` is null unless wanted.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end, step = encoder(tokenizer), np.array([end_id], dtype="<u4").tobytes(), 4 * max_tokens
        for batch in batches:
            rows: list[tuple] = []
            docs_, texts = batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()
            for doc, raw in zip(docs_, enc.encode_all(texts), strict=True):
                raw += end
                for n, at in enumerate(range(0, len(raw), step)):
                    part = raw[at : at + step]
                    rows.append((doc, n, at // 4, len(part) // 4, zlib.crc32(part), part if with_ids else None))
            columns = list(zip(*rows, strict=True)) or [[]] * 6
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "ids"])

    text_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(cut, PIECE_SCHEMA)


# ---- plan -------------------------------------------------------------------

def nnls(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least squares with x >= 0 by the active-set method of Lawson and Hanson."""
    gram, target = a.T @ a, a.T @ b
    x, free = np.zeros(a.shape[1]), np.zeros(a.shape[1], dtype=bool)
    tolerance = 1e-9 * max(1.0, float(np.abs(target).max(initial=0)))
    for _ in range(3 * a.shape[1]):
        gradient = target - gram @ x
        gradient[free] = -np.inf
        best = int(np.argmax(gradient))
        if gradient[best] <= tolerance:
            break
        free[best] = True
        while True:
            on = np.flatnonzero(free)
            trial = np.linalg.lstsq(a[:, on], b, rcond=None)[0]
            if (trial > 0).all():
                x[:] = 0
                x[on] = trial
                break
            bad = trial <= 0
            step = np.min(x[on][bad] / np.maximum(x[on][bad] - trial[bad], 1e-300))
            x[on] += step * (trial - x[on])
            free[on[bad & (x[on] <= 1e-12)]] = False
            x[~free] = 0
            if not free[best]:
                return x
    return x


def class_patterns(n_classes: int, most: int) -> list[tuple[int, ...]]:
    """Classes (1 to n_classes, in units of the class width) that add up to a full sequence."""
    found = []
    for k in range(1, most + 1):
        for head in combinations_with_replacement(range(1, n_classes + 1), k - 1):
            last = n_classes - sum(head)
            if last >= (head[-1] if head else 1):
                found.append((*head, last))
    return found


class _Plan:
    """Counts of lengths still to be placed, and groups of like sequences with room."""

    def __init__(self, counts: np.ndarray):
        self.cap, self.left = len(counts) - 1, counts.astype(np.int64).copy()
        self.open: dict[int, list[tuple[tuple[int, ...], int]]] = defaultdict(list)

    def put(self, lengths: tuple[int, ...], times: int) -> None:
        self.open[self.cap - sum(lengths)].append((lengths, times))

    def largest(self, low: int, high: int) -> int:
        """The largest length left in low..high, or 0."""
        found = np.flatnonzero(self.left[max(low, 1) : high + 1])
        return int(found[-1]) + max(low, 1) if len(found) else 0

    def realise(self, pattern: tuple[int, ...], times: int, width: int) -> None:
        """The larger classes take their longest lengths left; the last place is filled by best fit."""
        heads = sorted(pattern, reverse=True)[: max(1, len(pattern) - 1)]
        while times > 0:
            taken: list[int] = []
            room = self.cap
            for c in heads:
                length = self.largest((c - 1) * width + 1, min(c * width, room))
                if not length:
                    break
                taken.append(length)
                self.left[length] -= 1
                room -= length
            complete = len(taken) == len(heads)
            last = self.largest(1, room) if complete and len(pattern) > 1 else 0
            if last:
                taken.append(last)
                self.left[last] -= 1
            for length in taken:
                self.left[length] += 1
            if not complete:
                return
            need = {length: taken.count(length) for length in taken}
            k = min(times, *[int(self.left[length]) // n for length, n in need.items()])
            for length, n in need.items():
                self.left[length] -= k * n
            self.put(tuple(taken), k)
            times -= k

    def best_fit(self) -> None:
        """Longest first, each into the sequence with the least sufficient room."""
        for length in range(self.cap, 0, -1):
            n = int(self.left[length])
            while n:
                room = min((r for r, groups in self.open.items() if r >= length and groups), default=None)
                if room is None:
                    each = min(n, self.cap // length)
                    self.put((length,) * each, n // each)
                    n -= each * (n // each)
                    continue
                lengths, times = self.open[room].pop()
                k, each = min(times, n), 1
                if n >= times * 2:
                    each = min(room // length, n // times)
                if times > k:
                    self.open[room].append((lengths, times - k))
                self.put(lengths + (length,) * each, k)
                n -= k * each
            self.left[length] = 0


def plan_sequences(histogram: dict[int, int], max_tokens: int = 2048) -> list[tuple[tuple[int, ...], int]]:
    """(lengths in a sequence, number of such sequences) for all counted lengths."""
    counts = np.zeros(max_tokens + 1, dtype=np.int64)
    for length, n in histogram.items():
        counts[length] = n
    plan = _Plan(counts)
    if counts[max_tokens]:
        plan.put((max_tokens,), int(counts[max_tokens]))
        plan.left[max_tokens] = 0
    width = max(1, -(-max_tokens // CLASSES))
    n_classes = -(-max_tokens // width)
    patterns = [p for p in class_patterns(n_classes, PATTERN_DOCS) if len(p) > 1]
    by_class = np.zeros(n_classes)
    np.add.at(by_class, (np.arange(1, max_tokens + 1) - 1) // width, plan.left[1:])
    if patterns and by_class.any():
        a = np.zeros((n_classes, len(patterns)))
        for j, p in enumerate(patterns):
            for c in p:
                a[c - 1, j] += 1
        scale = by_class.max()
        repeats = np.floor(nnls(a, by_class / scale) * scale + 0.5).astype(np.int64)
        # Patterns with the longest documents first: their gaps are the hardest to fill.
        for j in sorted(np.flatnonzero(repeats), key=lambda j: -max(patterns[j])):
            plan.realise(patterns[j], int(repeats[j]), width)
    plan.best_fit()
    return [g for groups in plan.open.values() for g in groups if g[1]]


# ---- placing ----------------------------------------------------------------

def pack(parts: DataFrame, max_tokens: int = 2048, order: tuple[str, ...] = ("doc_id", "piece")) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to rows with a ``length`` of 1 to max_tokens.

    Rows of one length are interchangeable: they are numbered over all tasks in
    ``order`` and take the places that the plan has for their length. A common
    length is numbered in many cells. The plan is a few arrays whose size hangs
    on ``max_tokens``. No rows give no rows.
    """
    histogram = {r["length"]: r["n"] for r in parts.groupBy("length").agg(F.count("*").alias("n")).collect()}
    places: dict[int, list[tuple[int, int, int]]] = defaultdict(list)  # length -> (count, sequence, offset)
    sequence = 0
    for lengths, times in plan_sequences(histogram, max_tokens):
        offset = 0
        for length in lengths:
            places[length].append((times, sequence, offset))
            offset += length
        sequence += times
    starts, firsts, offsets, at = [], [], [], 0
    for length in sorted(places):
        for times, first, offset in places[length]:
            starts.append(at), firsts.append(first), offsets.append(offset)
            at += times
    starts, firsts, offsets = (np.array(x, dtype=np.int64) for x in (starts, firsts, offsets))

    salts = 1 + max(histogram.values(), default=0) // PIECES_PER_CELL
    hashed = F.xxhash64(*order)
    cells = parts.withColumns({"__salt": F.pmod(hashed, F.lit(salts)).cast("int"), "__one": F.lit(1).cast("long"), "__tie": hashed})
    numbered = running_sums(cells, ["length", "__salt"], ["__tie"], {"__number": "__one"}).drop("__salt", "__one", "__tie")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            number = batch.column("__number").to_numpy(zero_copy_only=False).astype(np.int64)
            k = np.searchsorted(starts, number, side="right") - 1
            new = [pa.array(firsts[k] + number - starts[k]), pa.array(offsets[k])]
            keep = [n for n in batch.schema.names if n != "__number"]
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in keep], *new], names=[*keep, "sequence_id", "offset"])

    kept = numbered.drop("__number")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema) + ", sequence_id long, offset long"
    ordered = numbered.select(*kept.columns, F.col("__number").cast("long").alias("__number"))
    return ordered.mapInArrow(place, schema)


def sequences(packed: DataFrame) -> DataFrame:
    """Token ids of each sequence and where each piece ends in it: pieces with
    ``ids`` end to end. A sequence has at most max_tokens pieces."""
    rows = packed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "length", "doc_id", "piece", "ids"))).alias("p"))
    joined = F.aggregate("p", F.lit(b"").cast("binary"), lambda acc, x: F.concat(acc, x["ids"]))
    return rows.select("sequence_id", joined.alias("ids"), F.col("p.length").alias("piece_lengths"), F.col("p.doc_id").alias("doc_ids"))


def document_packing(docs: DataFrame, tokenizer: str, max_tokens: int = 2048, end_id: int = 0) -> DataFrame:
    """Place of every piece of every document."""
    return pack(store(pieces(docs, tokenizer, max_tokens, end_id).drop("ids"), "pieces"), max_tokens)
