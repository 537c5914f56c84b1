"""Packing with little padding: cutting stock by column generation.

Every document gives as many whole sequences as it fills, and a rest. Rests go
by their length into classes of WIDTH tokens, and the linear program over
patterns of classes that fit into a sequence asks for the fewest sequences that
hold the histogram. Its columns are generated: the duals of the classes are the
values of a knapsack, whose best filling, by dynamic programming, is the next
pattern, until none is worth more than a sequence. The solution is rounded
down, what is left is filled by the same knapsack under the counts left, and
patterns are assigned to the rests of each class ranked by length, so that the
tokens in every sequence follow from the histogram alone.

What classes and rounding leave open is filled as well, for documents may be
cut: some whole sequences, or the emptiest ones if there are too few, are laid
end to end and cut into the gaps. The last tokens go into sequences of powers
of two, which need no padding, so no sequence has any.

The plan is made from at most MAX_TOKENS counts, whatever the table's size.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.llm.encoding import encoder
from seqloom.llm.ranges import running_sums
from seqloom.llm.storage import store, text_batches

MAX_TOKENS = 2048
#: Tokens in a class of lengths.
WIDTH = 8
#: A pattern enters while it is worth this much more than a sequence.
TOLERANCE = 1e-7
#: Documents whose rests of one length are numbered by one task.
DOCS_PER_CELL = 20_000

ENCODED_SCHEMA = "doc_id long, tie long, n_tokens long, whole long, rest int, ids binary"
PIECE_SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary"


# ---- linear program ---------------------------------------------------------

def price(values: np.ndarray, sizes: np.ndarray, most: np.ndarray | None, room: int) -> tuple[float, np.ndarray]:
    """The filling of a sequence of ``room`` units that is worth most.

    Dynamic programming over the room: without ``most`` any number of each
    class may be taken, with it no more than that many.
    """
    counts = np.zeros(len(sizes), dtype=np.int64)
    if most is None:
        best, taken = np.zeros(room + 1), np.full(room + 1, -1, dtype=np.int64)
        for r in range(1, room + 1):
            fits = sizes <= r
            worth = np.where(fits, best[np.maximum(r - sizes, 0)] + values, -1.0)
            k = int(worth.argmax())
            best[r] = best[r - 1]
            if worth[k] > best[r] + 1e-12:
                best[r], taken[r] = worth[k], k
        r = room
        while r > 0:
            if taken[r] < 0:
                r -= 1
            else:
                counts[taken[r]] += 1
                r -= int(sizes[taken[r]])
        return float(best[room]), counts
    best = np.zeros(room + 1)
    steps = []  # binary multiples of each class, so that each is taken or left
    for k in np.flatnonzero(most > 0):
        left, times = min(int(most[k]), room // int(sizes[k])), 1
        while left > 0:
            times = min(times, left)
            size, with_it = times * int(sizes[k]), best.copy()
            with_it[size:] = np.maximum(best[size:], best[: room + 1 - size] + times * values[k])
            steps.append((k, times, with_it > best + 1e-12))
            best, left, times = with_it, left - times, times * 2
    r = room
    for k, times, better in reversed(steps):
        if better[r]:
            counts[k] += times
            r -= times * int(sizes[k])
    return float(best[room]), counts


def fit_patterns(sizes: np.ndarray, demand: np.ndarray, room: int) -> list[tuple[np.ndarray, float]]:
    """Patterns and how often each is used, in the least number of sequences
    that hold ``demand[k]`` pieces of ``sizes[k]`` units, in fractions.

    Revised simplex with generated columns, from patterns of one class each.
    """
    m = len(sizes)
    if m == 0:
        return []
    each = room // sizes
    columns = np.diag(each.astype(float))
    inverse, used = np.diag(1.0 / each), demand / each
    for _ in range(50 * m + 100):
        duals = inverse.sum(axis=0)  # every pattern costs one sequence
        worth, pattern = price(duals, sizes, None, room)
        if worth <= 1 + TOLERANCE:
            break
        direction = inverse @ pattern
        rising = direction > 1e-10
        ratios = np.full(m, np.inf)
        ratios[rising] = np.maximum(used[rising], 0) / direction[rising]
        out = int(ratios.argmin())
        used = used - ratios[out] * direction
        used[out] = ratios[out]
        inverse[out] /= direction[out]
        others = np.arange(m) != out
        inverse[others] -= np.outer(direction[others], inverse[out])
        columns[:, out] = pattern
    return [(np.rint(columns[:, k]).astype(np.int64), max(0.0, float(used[k]))) for k in range(m)]


# ---- plan -------------------------------------------------------------------

class _Ranked:
    """The rests of one class by length: which ranks of which lengths are still free."""

    def __init__(self, lengths: list[tuple[int, int]]):
        self.runs = [[length, 0, n] for length, n in sorted(lengths, reverse=True)]

    def head(self) -> int:
        return self.runs[-1][2] if self.runs else 0

    def take(self, times: int) -> tuple[int, int]:
        """(length, first rank) of ``times`` rests of the shortest length left."""
        run = self.runs[-1]
        length, first = run[0], run[1]
        run[1] += times
        run[2] -= times
        if not run[2]:
            self.runs.pop()
        return length, first


#: ``times`` sequences alike: in each stand rests of the given lengths, the first of each of the given rank, the next ones following.
class Group(NamedTuple):
    slots: tuple[tuple[int, int], ...]
    times: int

    @property
    def filled(self) -> int:
        return sum(length for length, _ in self.slots)


def assign_ranks(pattern: np.ndarray, times: int, ranked: list[_Ranked]) -> Iterator[Group]:
    """Sequences of a pattern, with rests ranked by length: one group while no length runs out."""
    classes = np.flatnonzero(pattern)
    while times > 0:
        step = min(times, *[ranked[k].head() // int(pattern[k]) for k in classes])
        each = max(1, step)
        slots = []
        for k in classes:
            for _ in range(int(pattern[k])):
                slots.append(ranked[k].take(each))
        yield Group(tuple(slots), each)
        times -= each


def plan_groups(rests: dict[int, int], max_tokens: int = MAX_TOKENS, width: int = WIDTH) -> list[Group]:
    """Sequences that hold the counted rests of 1 to max_tokens - 1 tokens."""
    by_class: dict[int, list[tuple[int, int]]] = {}
    for length, n in rests.items():
        by_class.setdefault(-(-length // width), []).append((length, n))
    room = max(1, max_tokens // width)
    sizes = np.array(sorted(by_class), dtype=np.int64)
    ranked = [_Ranked(by_class[int(s)]) for s in sizes]
    demand = np.array([sum(n for _, n in by_class[int(s)]) for s in sizes], dtype=np.int64)
    # A class that is longer than a sequence in whole units still fits alone.
    units = np.minimum(sizes, room)
    groups: list[Group] = []
    left = demand.copy()
    fitted = fit_patterns(units, demand.astype(float), room)
    for pattern, used in sorted(fitted, key=lambda f: -f[1]):
        times = int(used + 1e-6)
        for k in np.flatnonzero(pattern):  # rounding in the simplex never takes more than there is
            times = min(times, int(left[k]) // int(pattern[k]))
        if times:
            left -= times * pattern
            groups += assign_ranks(pattern, times, ranked)
    while left.any():
        _, pattern = price(units.astype(float) + 1e-3 * units**2 / room, units, left, room)
        times = min(int(left[k]) // int(pattern[k]) for k in np.flatnonzero(pattern))
        left -= times * pattern
        groups += assign_ranks(pattern, times, ranked)
    return groups


class Plan(NamedTuple):
    """Where tokens go. Whole sequences numbered under ``cut_wholes`` and the
    slots that are marked lie end to end in a stream, which fills gaps."""

    cut_wholes: int
    first_whole: int
    slot_keys: np.ndarray  # (length << 40) + first rank, ascending
    slot_stream: np.ndarray  # does the slot lie in the stream?
    slot_place: np.ndarray  # its first sequence, or its place in the stream
    slot_offset: np.ndarray
    gap_starts: np.ndarray  # places of the stream at which gaps of another size begin
    gap_sizes: np.ndarray
    gap_sequences: np.ndarray
    gap_offsets: np.ndarray


RANK_BITS = 40


def plan_packing(rests: dict[int, int], wholes: int, max_tokens: int = MAX_TOKENS, width: int = WIDTH) -> Plan:
    """All sequences for ``rests[length]`` rests and ``wholes`` whole sequences."""
    groups = sorted(plan_groups(rests, max_tokens, width), key=lambda g: -g.filled)
    gaps = sum(g.times * (max_tokens - g.filled) for g in groups)
    cut_wholes = min(wholes, -(-gaps // max_tokens))
    supply = cut_wholes * max_tokens
    loose: list[Group] = []
    while gaps > supply:  # too few whole sequences: the emptiest of the others are cut in their place
        group = groups.pop()
        times = min(group.times, -(-(gaps - supply) // max_tokens))
        kept = group.times - times
        if kept:
            groups.append(Group(group.slots, kept))
        loose.append(Group(tuple((length, rank + kept) for length, rank in group.slots), times))
        gaps -= times * (max_tokens - group.filled)
        supply += times * group.filled
    keys, stream, place, offsets = [], [], [], []
    sequence, at = wholes - cut_wholes, cut_wholes * max_tokens
    gap_rows = []  # (size, first sequence, offset, number)
    for g in groups:
        offset = 0
        for length, rank in g.slots:
            keys.append((length << RANK_BITS) + rank), stream.append(False), place.append(sequence), offsets.append(offset)
            offset += length
        if g.filled < max_tokens:
            gap_rows.append((max_tokens - g.filled, sequence, g.filled, g.times))
        sequence += g.times
    for g in loose:
        for length, rank in g.slots:
            keys.append((length << RANK_BITS) + rank), stream.append(True), place.append(at), offsets.append(0)
            at += length * g.times
    rest = at - sum(size * n for size, _, _, n in gap_rows)
    size = max_tokens
    while rest:  # what is left of the stream: full sequences, then powers of two
        if n := rest // size:
            gap_rows.append((size, sequence, 0, n))
            sequence += n
            rest -= n * size
        size = 1 << (min(rest, size - 1).bit_length() - 1) if rest else size
    sizes = np.array([r[0] for r in gap_rows], dtype=np.int64)
    numbers = np.array([r[3] for r in gap_rows], dtype=np.int64)
    order = np.argsort(np.array(keys, dtype=np.int64), kind="stable")
    column = lambda values, kind=np.int64: np.array(values, dtype=kind)
    return Plan(cut_wholes, cut_wholes, column(keys)[order], column(stream, bool)[order], column(place)[order], column(offsets)[order],
                np.concatenate([[0], np.cumsum(sizes * numbers)])[:-1].astype(np.int64) if len(sizes) else column([]), sizes,
                column([r[1] for r in gap_rows]), column([r[2] for r in gap_rows]))


def stream_pieces(plan: Plan, begin: int, end: int) -> Iterator[tuple[int, int, int]]:
    """(length, sequence, offset) of the pieces into which places begin to end of the stream are cut."""
    while begin < end:
        k = int(np.searchsorted(plan.gap_starts, begin, side="right")) - 1
        size = int(plan.gap_sizes[k])
        number, inside = divmod(begin - int(plan.gap_starts[k]), size)
        length = min(size - inside, end - begin)
        yield length, int(plan.gap_sequences[k]) + number, int(plan.gap_offsets[k]) + inside
        begin += length


def places(plan: Plan, whole: int, rest: int, before: int, rank: int, max_tokens: int) -> Iterator[tuple[int, int, int]]:
    """(length, sequence, offset) of the pieces of a document with ``whole``
    whole sequences, of which ``before`` come from other documents, and a rest of that rank."""
    for n in range(before, before + whole):
        if n < plan.cut_wholes:
            yield from stream_pieces(plan, n * max_tokens, (n + 1) * max_tokens)
        else:
            yield max_tokens, n - plan.cut_wholes, 0
    if rest:
        key = (rest << RANK_BITS) + rank
        k = int(np.searchsorted(plan.slot_keys, key, side="right")) - 1
        step, place = key - int(plan.slot_keys[k]), int(plan.slot_place[k])
        if plan.slot_stream[k]:
            yield from stream_pieces(plan, place + step * rest, place + (step + 1) * rest)
        else:
            yield rest, place + step, int(plan.slot_offset[k])


# ---- documents --------------------------------------------------------------

def _wide(ids: bytes, n: int) -> bytes:
    return np.frombuffer(ids, dtype="<u2").astype("<u4").tobytes() if len(ids) == 2 * n else ids


def _narrow(ids: bytes) -> bytes:
    values = np.frombuffer(ids, dtype="<u4")
    return values.astype("<u2").tobytes() if int(values.max()) <= 0xFFFF else ids


def encoded(docs: DataFrame, tokenizer: str, max_tokens: int = MAX_TOKENS, end_id: int = 1) -> DataFrame:
    """(doc_id, tie, n_tokens, whole, rest, ids): each document's ids and end
    id, as little-endian integers of 16 bits if all fit, else of 32, and how it
    fills sequences. ``tie`` orders documents of one length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end = encoder(tokenizer), np.array([end_id], dtype="<u4").tobytes()
        for batch in batches:
            ids = [raw + end for raw in enc.encode_all(batch.column("text").to_pylist())]
            n = np.array([len(raw) // 4 for raw in ids], dtype=np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("tie"), pa.array(n), pa.array(n // max_tokens), pa.array((n % max_tokens).astype(np.int32)),
                 pa.array(map(_narrow, ids), pa.binary())],
                names=["doc_id", "tie", "n_tokens", "whole", "rest", "ids"])

    text_batches(docs.sparkSession)
    id_ = F.col("doc_id").cast("long")
    return docs.select(id_.alias("doc_id"), F.xxhash64(id_, "text").alias("tie"), "text").mapInArrow(run, ENCODED_SCHEMA)


def pack(rows: DataFrame, max_tokens: int = MAX_TOKENS, width: int = WIDTH) -> DataFrame:
    """Pieces of the rows of ``encoded``, with their ids and places.

    Rows with rests of one length are interchangeable and are numbered over all
    tasks, a common length in many cells; so are whole sequences. Ids travel
    once, with their row. No rows give no pieces.
    """
    counted = rows.groupBy("rest").agg(F.count("*").alias("n"), F.sum("whole").alias("whole")).collect()
    plan = plan_packing({r["rest"]: r["n"] for r in counted if r["rest"]}, sum(r["whole"] for r in counted), max_tokens, width)
    salts = 1 + max((r["n"] for r in counted), default=0) // DOCS_PER_CELL
    cells = rows.withColumns({"salt": F.pmod("tie", F.lit(salts)).cast("int"), "one": F.lit(1).cast("long")})
    numbered = running_sums(cells, ["rest", "salt"], ["tie"], {"number": "one", "before": "whole"})
    # Numbers run over all rests; a rank begins anew with each length.
    first, at = {}, 0
    for r in sorted(counted, key=lambda r: r["rest"]):
        first[r["rest"]], at = at, at + r["n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("doc_id", "n_tokens", "whole", "rest", "number", "before")
        kinds = [pa.int64()] * 7 + [pa.binary()]
        for batch in batches:
            out: list[tuple] = []
            ids = batch.column("ids")
            for i, (doc, n, whole, rest, number, before) in enumerate(zip(*[batch.column(c).to_pylist() for c in names], strict=True)):
                raw, start = _wide(ids[i].as_py(), n), 0
                for length, sequence, offset in places(plan, whole, rest, before, number - first[rest], max_tokens):
                    part = raw[4 * start : 4 * (start + length)]
                    out.append((doc, start, length, zlib.crc32(part), n, sequence, offset, part))
                    start += length
            columns = list(zip(*out, strict=True)) or [[]] * 8
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)],
                                             names=[c.split(" ")[0] for c in PIECE_SCHEMA.split(", ")])

    wanted = numbered.select("doc_id", "n_tokens", "whole", "rest", F.col("number").cast("long").alias("number"),
                             F.col("before").cast("long").alias("before"), "ids")
    return wanted.mapInArrow(run, PIECE_SCHEMA)


def document_packing(docs: DataFrame, tokenizer: str, max_tokens: int = MAX_TOKENS, end_id: int = 1) -> DataFrame:
    """Pieces of all documents without their ids.

    A null text is empty: its end id alone. Null and repeated doc_ids and
    repeated rows are documents of their own; other columns are ignored.
    """
    return pack(store(encoded(docs, tokenizer, max_tokens, end_id), "encoded"), max_tokens).drop("ids")
