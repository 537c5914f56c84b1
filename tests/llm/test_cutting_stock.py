import collections
import itertools
import zlib
from functools import lru_cache

import numpy as np
import pytest
from tokenizers import Tokenizer

from seqloom.llm import cutting_stock as cs
from seqloom.llm.encoding import vocabulary

BYTES = vocabulary("byte_bpe_50k.json")


@lru_cache
def tokenizer():
    return Tokenizer.from_file(BYTES)


def ids_of(text):
    return [*tokenizer().encode(text or "", add_special_tokens=False).ids, 1]


def power_of_two(n):
    return n & (n - 1) == 0


def check(rows, docs, cap):
    """Every id once, sequences without gaps; returns the padding."""
    found = collections.defaultdict(collections.Counter)
    by_sequence = collections.defaultdict(list)
    for r in rows:
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
        found[r["doc_id"], r["doc_tokens"]][r["start"], r["length"], r["ids_crc32"]] += 1
    wanted = collections.Counter((r["doc_id"], tuple(ids_of(r["text"]))) for r in docs)
    assert {(d, len(i)) for d, i in wanted} == set(found)
    for (doc, ids), _ in wanted.items():
        for start, length, crc in found[doc, len(ids)]:
            if crc == zlib.crc32(np.array(ids[start : start + length], "<u4").tobytes()):
                continue
            assert any(d == doc and len(i) == len(ids) and i != ids for d, i in wanted)
    covered, total = sum(r["length"] for r in rows), sum(len(i) * n for (_, i), n in wanted.items())
    assert covered == total
    for (doc, n), pieces in found.items():
        copies = sum(c for (d, i), c in wanted.items() if d == doc and len(i) == n)
        depth = collections.Counter()
        for (start, length, _), times in pieces.items():
            assert length > 0
            depth[start] += times
            depth[start + length] -= times
        level = list(itertools.accumulate(depth[k] for k in sorted(depth)))
        assert set(level[:-1]) == {copies} and min(depth) == 0 and max(depth) == n
    padding = 0
    for pieces in by_sequence.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= cap
        padding += 0 if power_of_two(at) else cap - at
    return padding, len(by_sequence), total


@pytest.mark.parametrize(("source", "cap"), [("docs", 2048), ("docs", 64), ("sample", 2048), ("sample", 100)])
def test_packing_is_whole_and_without_padding(request, source, cap):
    docs = request.getfixturevalue(source)
    padding, n, total = check(cs.document_packing(docs, BYTES, cap).collect(), docs.collect(), cap)
    assert padding == 0 and n <= total // cap + cap.bit_length()


def test_hot_lengths_are_numbered_in_cells(spark, monkeypatch):
    monkeypatch.setattr(cs, "DOCS_PER_CELL", 20)
    docs = spark.createDataFrame([(i, "same words here " * 9 if i % 3 else f"text {i} " * (i % 40)) for i in range(300)], "doc_id long, text string").repartition(3)
    assert check(cs.document_packing(docs, BYTES).collect(), docs.collect(), 2048)[0] == 0


def test_no_documents(no_docs):
    assert cs.document_packing(no_docs, BYTES).count() == 0


def test_ids_travel_with_pieces(docs):
    for r in cs.pack(cs.encoded(docs, BYTES, 64), 64).collect():
        assert len(r["ids"]) == 4 * r["length"] and zlib.crc32(bytes(r["ids"])) == r["ids_crc32"]


def test_wide_ids_stay_wide():
    for ids in ([1, 2, 65535], [70000, 1]):
        raw = np.array(ids, "<u4").tobytes()
        assert cs._wide(cs._narrow(raw), len(ids)) == raw


def test_knapsack_equals_brute_force():
    rng = np.random.default_rng(3)
    for _ in range(60):
        sizes = np.sort(rng.choice(np.arange(1, 12), 4, replace=False))
        values, most, room = rng.random(4), rng.integers(0, 4, 4), int(rng.integers(1, 24))
        for limit in (None, most):
            top = [range((room // s if limit is None else min(limit[k], room // s)) + 1) for k, s in enumerate(sizes)]
            best = max(sum(c * v for c, v in zip(p, values, strict=True)) for p in itertools.product(*top)
                       if sum(c * s for c, s in zip(p, sizes, strict=True)) <= room)
            worth, counts = cs.price(values, sizes, limit, room)
            assert worth == pytest.approx(best) and counts @ values == pytest.approx(best) and counts @ sizes <= room
            assert limit is None or (counts <= limit).all()


def test_linear_program_is_optimal():
    rng = np.random.default_rng(4)
    for _ in range(10):
        sizes, room = np.array([2, 3, 5, 7]), 12
        demand = rng.integers(1, 50, 4).astype(float)
        fitted = cs.fit_patterns(sizes, demand, room)
        assert sum(u * p for p, u in fitted) == pytest.approx(demand)
        assert all(p @ sizes <= room for p, _ in fitted)
        # Weak duality: values that no filling exceeds are a lower bound; the simplex ends with such.
        columns = np.array([p for p, _ in fitted], dtype=float).T
        duals = np.linalg.solve(columns.T, np.ones(4))
        assert cs.price(duals, sizes, None, room)[0] <= 1 + 1e-6
        assert sum(u for _, u in fitted) == pytest.approx(duals @ demand)


def test_plan_is_near_the_bound_and_places_every_rest():
    rng = np.random.default_rng(5)
    rests = {int(k): int(n) for k, n in enumerate(rng.poisson(40 * np.exp(-np.arange(2048) / 500))) if k and n}
    groups = cs.plan_groups(rests)
    placed = collections.Counter()
    for g in groups:
        assert g.filled <= 2048 and g.times > 0
        for length, _ in g.slots:
            placed[length] += g.times
    assert placed == rests
    total = sum(k * n for k, n in rests.items())
    assert sum(g.times for g in groups) <= 1.02 * total / 2048 + 5


@pytest.mark.parametrize(("rests", "wholes", "cap"), [({5: 1}, 0, 2048), ({1000: 7, 1100: 5}, 0, 2048), ({1: 3}, 4, 2048), ({99: 4, 50: 3}, 0, 100), ({}, 3, 2048)])
def test_small_plans_leave_no_padding(rests, wholes, cap):
    plan = cs.plan_packing(rests, wholes, cap)
    filled = collections.defaultdict(list)
    for n in range(wholes):
        for length, sequence, offset in cs.places(plan, 1, 0, n, 0, cap):
            filled[sequence].append((offset, length))
    for rest, n in rests.items():
        for rank in range(n):
            for length, sequence, offset in cs.places(plan, 0, rest, 0, rank, cap):
                filled[sequence].append((offset, length))
    for pieces in filled.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at == cap or power_of_two(at)
    assert sum(x for p in filled.values() for _, x in p) == wholes * cap + sum(k * n for k, n in rests.items())
