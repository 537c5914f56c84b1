import collections
import hashlib
import math
import random
from fractions import Fraction

import numpy as np
import pytest

from seqloom.llm import vector_codes as vc

SCHEMA = "vec_id long, embedding array<float>, label int, code string"


def brute(rows, parts=8, entries=16, rounds=6):
    """(codes and errors by row, codebooks' digest) in Python's integers."""
    kept = [r for r in rows if r[1] and all(v is not None and math.isfinite(v) for v in r[1])]
    if not kept:
        return [], None
    width = -(-max(len(r[1]) for r in kept) // parts)
    ints = [[math.floor(Fraction(v) * 4096) for v in r[1]] + [0] * (width * parts - len(r[1])) for r in kept]
    order = sorted(range(len(kept)), key=lambda i: (kept[i][0] is None, kept[i][0] or 0, kept[i][1]))
    cut = lambda v, p: v[p * width : (p + 1) * width]
    books = [[cut(ints[i], p) for i in order[:entries]] for p in range(parts)]
    distance = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    choose = lambda v, p: min((distance(cut(v, p), e), k) for k, e in enumerate(books[p]))
    for _ in range(rounds):
        new = []
        for p in range(parts):
            members = collections.defaultdict(list)
            for v in ints:
                members[choose(v, p)[1]].append(cut(v, p))
            new.append([[sum(c) // len(c) for c in zip(*members[k], strict=True)] if members[k] else e for k, e in enumerate(books[p])])
        books = new
    out = []
    for r, v in zip(kept, ints, strict=True):
        best = [choose(v, p) for p in range(parts)]
        out.append((r[0], r[2], "".join(f"{k:02x}" for _, k in best), sum(d for d, _ in best)))
    digest = hashlib.sha256(",".join(str(x) for book in books for e in book for x in e).encode()).hexdigest()
    return out, digest


def check(spark, rows, schema=SCHEMA):
    got = vc.vector_codes(spark.createDataFrame(rows, schema).repartition(3)).collect()
    expected, digest = brute(rows)
    total = collections.Counter()
    for _, label, _, error in expected:
        total[label] += error
    assert sorted(str((r["vec_id"], r["code"], r["error"], r["label_error"])) for r in got) == sorted(
        str((i, code, error, min(total[label], 2**63 - 1))) for i, label, code, error in expected)
    assert {r["codebooks_sha256"] for r in got} == {digest}


def test_codes_equal_brute_force(spark):
    random.seed(4)
    rows = [(i, [random.gauss(i % 3, 1) for _ in range(64)], i % 4 or None, "x") for i in range(150)]
    rows += [(200 + i, rows[3][1], 1, "x") for i in range(40)] + [(7, rows[7][1], 3, "x"), (None, rows[9][1], None, "x")]
    rows += [(500, None, 1, "x"), (501, [1.0] * 63 + [None], 1, "x"), (502, [float("nan")] * 64, 1, "x"), (503, [float("-inf")] + [0.0] * 63, 2, "x"), (504, [], 2, "x")]
    rows = [(a, b and [None if v is None else float(np.float32(v)) for v in b], c, d) for a, b, c, d in rows]
    check(spark, rows)


@pytest.mark.parametrize(("length", "scale"), [(64, 5e4), (8, 2.0), (20, 1.0), (64, 0.0), (16, 1e30)])
def test_odd_sizes_and_large_values(spark, length, scale):
    random.seed(length)
    rows = [(i - 3, [float(np.float32(random.uniform(-scale, scale))) for _ in range(length - (i == 5) * (scale == 1.0))], i % 2, "x") for i in range(30)]
    if scale < 1e20:
        check(spark, rows)
    else:  # errors end at the largest long
        got = vc.vector_codes(spark.createDataFrame(rows, SCHEMA)).collect()
        expected, digest = brute(rows)
        assert sorted((r["vec_id"], r["code"], r["error"]) for r in got) == sorted((i, c, min(e, 2**63 - 1)) for i, _, c, e in expected)
        assert {r["codebooks_sha256"] for r in got} == {digest} and all(r["label_error"] == 2**63 - 1 for r in got)


def test_few_and_no_rows(spark):
    check(spark, [(3, [0.5] * 16, 1, "x"), (2, [0.25] * 16, None, "x"), (2, [0.25] * 16, None, "x")])
    assert vc.vector_codes(spark.createDataFrame([], SCHEMA)).count() == 0
    assert vc.vector_codes(spark.createDataFrame([(1, None, 1, "x")], SCHEMA)).count() == 0


def test_transform_keeps_distances_and_orders_signs():
    rng = np.random.default_rng(0)
    for width in (1, 3, 8, 12):
        x, y = rng.integers(-999, 999, (2, 20, width))
        a, b = vc.transform(x), vc.transform(y)
        assert (((a - b) ** 2).sum(axis=1) == a.shape[1] * ((x - y) ** 2).sum(axis=1)).all()
    rows = vc.transform(np.eye(8, dtype=np.int64)).T
    assert [(r[1:] != r[:-1]).sum() for r in rows] == list(range(8))


def test_entries_are_dropped_early_and_ties_go_low():
    rng = np.random.default_rng(1)
    parts, entries = rng.integers(-5, 5, (500, 8)), rng.integers(-5, 5, (16, 8))
    entries[9] = entries[2]
    index, distance, _ = vc.nearest(parts, entries)
    whole = ((parts[:, None] - entries[None]) ** 2).sum(axis=2)
    assert (index == whole.argmin(axis=1)).all() and (distance == whole.min(axis=1)).all() and not (index == 9).any()
    smooth = np.cumsum(rng.integers(-100, 100, (500, 8)), axis=1)
    _, _, terms = vc.nearest(smooth, smooth[:16])
    assert terms < 0.6 * 500 * 16 * 8


def test_labels_beside_the_hot_ones(spark, monkeypatch):
    monkeypatch.setattr(vc, "HOT_SHARE", 0.2)
    random.seed(2)
    check(spark, [(i, [random.random() for _ in range(8)], None if i < 20 else i % 9, "x") for i in range(60)], SCHEMA.replace("float", "double"))


def test_decoding_gives_the_entries(spark):
    rows = spark.createDataFrame([(i, [i / 8.0] * 8, 0, "x") for i in range(10)], SCHEMA)
    kept = vc.finite_vectors(rows)
    books = vc.train(kept)
    for r in vc.decode(vc.encode(kept, books), books).collect():
        assert r["approximation"] == [r["vec_id"] / 8.0] * 8 and r["error"] == 0
