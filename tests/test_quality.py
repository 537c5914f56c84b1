import numpy as np
import pytest
from pyspark.sql import functions as F

from seqloom.operators import quality as ql


@pytest.fixture
def lookup(frame):
    rows = [(0, " gsr ", 0), (1, "GSR", 2), (2, "AAA", 0), (3, None, 1)]
    return ql.match_lookup(frame(rows, "idx bigint, peptide string, n_proteins int"))


def test_lookup_and_summary(frame, lookup):
    predictions = frame([(0, "['G','S[UNIMOD:21]','R']"), (1, "AAA"), (2, "CCC"), (3, None)],
                        "row int, instanovoplus_predictions string")
    annotated = ql.annotate_predictions(predictions, lookup)
    assert {r.row: r.match_status for r in annotated.collect()} == {0: True, 1: False, 2: None, 3: None}
    assert tuple(ql.annotation_summary(annotated).first()) == (4, 2, 1, 1, 2)


@pytest.mark.parametrize("direct", [1_000_000, 5])
def test_box_stats(frame, direct):
    rng = np.random.default_rng(3)
    groups = {"a": np.round(rng.normal(size=301), 2), "b": np.concatenate([rng.exponential(size=400), [1e9, -1e6], np.full(300, 0.5)]),
              "c": np.array([4.0]), "d": np.array([1.0, 2.0])}
    rows = [("m", s, float(v)) for s, values in groups.items() for v in values]
    got = ql.box_stats(frame(rows, "metric string, status string, value double"), direct_values=direct)
    for r in got.collect():
        v = groups[r.status]
        q1, median, q3 = np.percentile(v, [25, 50, 75])
        reach = 1.5 * (q3 - q1)
        low, high = min(v[v >= q1 - reach].min(), q1), max(v[v <= q3 + reach].max(), q3)
        assert r.n == len(v)
        assert np.allclose([r.q1, r.median, r.q3, r.whisker_low, r.whisker_high], [q1, median, q3, low, high])
    assert got.count() == 4


def test_values_skip_missing(frame):
    rows = [(True, 1.0, None), (False, float("nan"), 2.0), (None, 3.0, 3.0)]
    got = ql.metric_values(frame(rows, "match_status boolean, x double, y double"), ["x", "y"]).collect()
    assert sorted((r.metric, r.status, r.value) for r in got) == [("x", "MATCH", 1.0), ("y", "NO_MATCH", 2.0)]


def test_points_are_limited_and_stable(frame):
    rows = [("m", "MATCH" if i % 10 else "NO_MATCH", i, float(i)) for i in range(500)]
    values = frame(rows, "metric string, status string, id bigint, value double")
    first = ql.sampled_points(values, "id", limit=100).collect()
    again = ql.sampled_points(values.repartition(7), "id", limit=100).collect()
    assert sorted(first) == sorted(again)
    assert sum(r.status == "MATCH" for r in first) == 100 and sum(r.status == "NO_MATCH" for r in first) == 50


@pytest.mark.parametrize("limit", [1, 2, 5, 100])
def test_points_equal_the_plain_ranking(spark, frame, limit):
    rows = [(f"m{i % 30}", "MATCH", i // 3, float(i)) for i in range(3000)]
    values = frame(rows, "metric string, status string, id bigint, value double")
    hashed = values.withColumn("h", F.md5(F.concat_ws("_", F.lit("42"), F.col("id").cast("string")))).collect()
    groups = {}
    for r in hashed:
        groups.setdefault(r.metric, []).append((r.h, r.id))
    expected = sorted((m, i) for m, g in groups.items() for _, i in sorted(g)[:limit])
    assert sorted((r.metric, r.id) for r in ql.sampled_points(values, "id", limit=limit).collect()) == expected


def test_quartiles_end_with_infinities_and_huge_spans(frame):
    inf = float("inf")
    rows = [("m", v) for v in [-inf, inf, inf, -1.7e308, 1.7e308, *map(float, range(30))]]
    counted = ql.count_values(frame(rows, "metric string, value double"), ["metric"])
    r = ql.quartiles(counted, ["metric"], direct_values=5).first()
    q1, median, q3 = np.percentile([v for _, v in rows], [25, 50, 75])
    assert (r.n, r.q1, r.median, r.q3) == (len(rows), q1, median, q3)
