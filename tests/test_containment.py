import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from seqloom.functions import bloom as bl
from seqloom.functions import seeds as sd
from seqloom.operators import containment as ct
from seqloom.operators import dedup as dd


def seed_sets(texts, classes):
    data, offsets = sd._buffers(pa.array(texts))
    return {m: {(int(r), int(s)) for r, s in zip(*pairs)} for m, pairs in sd._seeds(data, offsets, classes, None).items()}


@pytest.mark.parametrize("m", [1, 3, 8, 12, 16, 32, 64, 256])
def test_seeds_of_a_part_are_seeds_of_the_whole(m):
    rng = random.Random(m)
    text = "".join(rng.choice("ACDEé") for _ in range(3000))
    whole = {s for _, s in seed_sets([text], [m])[m]}
    raw = text.encode()
    for _ in range(50):
        size = rng.randrange(m, 2 * m)
        at = rng.randrange(0, len(raw) - size)
        part = pa.array([raw[at:at + size]], pa.binary())
        data, offsets = sd._buffers(part)
        own = {int(s) for s in sd._seeds(data, offsets, [m], None)[m][1]}
        assert own and own <= whole


def test_seeds_do_not_cross_rows_or_depend_on_pieces(monkeypatch):
    rng = random.Random(1)
    texts = ["".join(rng.choice("ACDE") for _ in range(rng.choice([0, 5, 40, 700]))) for _ in range(60)]
    classes = [4, 16, 64]
    together = seed_sets(texts, classes)
    alone = {m: set() for m in classes}
    for i, text in enumerate(texts):
        for m, found in seed_sets([text], classes).items() if text else ():
            alone[m] |= {(i, s) for _, s in found}
    assert together == alone
    monkeypatch.setattr(sd, "_STEP", 50)
    assert seed_sets(texts, classes) == alone


def test_longer_classes_have_fewer_seeds():
    rng = random.Random(2)
    text = "".join(rng.choice("ACDEFGHIKL") for _ in range(100_000))
    sizes = [len(s) for _, s in sorted(seed_sets([text], [16, 32, 64, 128]).items())]
    assert sizes == sorted(sizes, reverse=True) and sum(sizes) < 0.8 * len(text)


def test_filters_hold_their_hashes_and_few_others(spark, monkeypatch):
    rng = np.random.default_rng(0)
    seeds = {m: rng.integers(-2**63, 2**63 - 1, n) for m, n in ((8, 20_000), (32, 300))}
    rows = spark.createDataFrame([(m, int(s)) for m, each in seeds.items() for s in each], "m bigint, seed bigint").repartition(3)
    others = rng.integers(-2**63, 2**63 - 1, 20_000)
    for most, passing in ((64 << 20, 0.02), (8192, 0.9)):  # where room is short the large class gives way
        monkeypatch.setattr(bl, "FILTER_BYTES", most)
        known = bl.build_filters(rows)
        assert all(known.contains(m, s).all() for m, s in seeds.items()) and not known.contains(64, others).any()
        assert known.contains(8, others).mean() < passing and known.contains(32, others).mean() < 0.02
        assert sum(len(t) for t in known.tables.values()) <= max(most, 2 * 4096)
    assert not bl.build_filters(rows.where("false")).tables


def test_texts_write_few_rows_for_few_patterns(frame, monkeypatch):
    """With room for about 1,000 seeds a class, a text of 200,000 letters gives a row for every 200 of them at most."""
    monkeypatch.setattr(bl, "FILTER_BYTES", 18 * 4096)
    rng = random.Random(9)
    text = "".join(rng.choice("ACDEFGHIKLMNPQRSTVWY") for _ in range(200_000))
    patterns = [text[at : at + rng.randint(9, 60)] for at in rng.sample(range(199_000), 60)]
    probes, hits = ct.seed_matches(frame([(w,) for w in patterns], "p string"), "p", "p", frame([(1, text)], "tid bigint, t string"), "t", ["tid"])
    assert probes.count() == len(set(patterns)) and hits.count() <= len(text) / 200


def words(rng, n, alphabet, sizes):
    return sorted({"".join(rng.choice(alphabet) for _ in range(rng.randint(*sizes))) for _ in range(n)})


@pytest.fixture(params=["filter", "shuffle"])
def seed_path(request, monkeypatch):
    if request.param == "shuffle":
        monkeypatch.setattr(bl, "FILTER_BYTES", 1)
        monkeypatch.setattr(ct, "CANDIDATE_BYTES", 0)
    return request.param


@pytest.mark.parametrize("alphabet, sizes", [("AB", (1, 12)), ("ABCD", (1, 40)), ("AéB", (1, 30))])
@pytest.mark.parametrize("hot", [2, 1_000_000])
def test_all_pairs_equal_nested_loop(frame, seed_path, monkeypatch, alphabet, sizes, hot):
    monkeypatch.setattr(ct, "PAIRS_PER_SEED", hot)
    rng = random.Random(str(alphabet))
    texts = words(rng, 120, alphabet, (1, 120))
    patterns = words(rng, 60, alphabet, sizes) + [t[3:3 + rng.randint(1, 90)] for t in texts[:60] if len(t) > 4]
    patterns = sorted(set(patterns))
    p = frame([(w,) for w in patterns], "p string")
    t = frame(list(enumerate(texts)), "tid bigint, t string")
    got = sorted((r.p, r.tid) for r in ct.containing_pairs(p, "p", "p", t, "t", "tid").collect())
    assert got == sorted((w, i) for w in patterns for i, text in enumerate(texts) if w in text)


@pytest.mark.parametrize("tries", [1, 64])
def test_first_container_with_scopes(frame, seed_path, monkeypatch, tries):
    monkeypatch.setattr(ct, "FIRST_TRIES", tries)
    rng = random.Random(tries)
    texts = [(f"f{i % 3}", i, w) for i, w in enumerate(words(rng, 150, "AB", (1, 25)))]
    patterns = words(rng, 60, "AB", (1, 14))
    p = frame([(w,) for w in patterns], "p string")
    t = frame(texts, "file string, pos int, t string")
    got = ct.first_container(p, "p", "p", t, "t", "t", order=["pos"], scope=["file"])
    want = {}
    for w in patterns:
        for file, pos, text in texts:
            if w in text and w != text:
                want.setdefault((w, file), (pos, text))
    assert {(r.p, r.file): (r.pos, r.t) for r in got.collect()} == want


def test_equal_hashes_are_settled(frame, monkeypatch):
    """Windows that hash alike must not change the result."""
    monkeypatch.setattr(ct, "FIRST_TRIES", 1)
    real = ct.with_windows, ct.with_end_windows
    blur = lambda df, *names: df.withColumns({n: F.pmod(n, F.lit(3)) for n in names})
    monkeypatch.setattr(ct, "with_windows", lambda d, t, c, s, keep=None: blur(real[0](d, t, c, s), "hash"))
    monkeypatch.setattr(ct, "with_end_windows", lambda *a: blur(real[1](*a), "first", "last"))
    rng = random.Random(5)
    texts = words(rng, 80, "AB", (1, 25))
    patterns = words(rng, 40, "AB", (1, 12))
    got = ct.first_container(frame([(w,) for w in patterns], "p string"), "p", "p",
                             frame(list(enumerate(texts)), "pos int, t string"), "t", "pos", order=["pos"])
    want = {w: min(holders) for w in patterns if (holders := [i for i, t in enumerate(texts) if w in t and w != t])}
    assert {r.p: r.pos for r in got.collect()} == want


def test_windows_at_both_ends_cover_the_pattern(frame, monkeypatch):
    monkeypatch.setattr(sd, "_STEP", 64)
    rng = random.Random(4)
    text = "".join(rng.choice("ACDé") for _ in range(300))
    rows = frame([(1, text), (2, ""), (3, "A")], "i int, t string")
    ends = {r.i: r for r in sd.with_end_windows(rows, "t", ["i"]).collect()}
    size = len(text.encode())
    assert set(ends) == {1, 3} and ends[1].m + ends[1].gap == size and ends[1].m * 2 > size
    where = {r["hash"]: r.at for r in sd.with_windows(rows, "t", ["i"], [ends[1].m]).collect()}
    assert where[ends[1].first] == 0 and where[ends[1]["last"]] == ends[1].gap


def test_no_patterns_and_no_texts(frame):
    none = frame([], "p string")
    some = frame([("AC",)], "p string")
    texts = frame([(1, "ACD")], "tid bigint, t string")
    assert ct.containing_pairs(none, "p", "p", texts, "t", "tid").count() == 0
    assert ct.containing_pairs(some, "p", "p", texts.limit(0), "t", "tid").count() == 0


# ---- de-duplication -------------------------------------------------------

RECORDS = [(0, "a", "ABCDEF"), (1, "b", "BCD"), (2, "c", "bcd"), (3, "d", "ZABCDE"), (4, "e", "CD"), (5, "f", ""), (6, "g", "ABC")]


def records(frame, rows):
    return frame(rows, "rec_idx bigint, id string, seq string").withColumn("seq", F.upper("seq"))


def test_dedup_fixture(frame):
    stages = dd.Dedup(records(frame, RECORDS))
    got = [tuple(r) for r in dd.sort_provenance(stages.provenance()).collect()]
    assert got == [("b", "c", "identical"), ("a", "b", "substring"), ("a", "g", "substring"), ("a", "e", "substring")]
    assert [r.id for r in stages.kept().orderBy("rec_idx").collect()] == ["a", "d", "f"]
    assert tuple(stages.summary().first()) == (7, 1, 3, 3)


def test_name_semantics(frame):
    rows = [(0, "x", "ABCDEF"), (1, "x", "BCD")]
    assert dd.Dedup(records(frame, rows)).kept().count() == 1
    assert dd.Dedup(records(frame, rows), name_semantics=True).kept().count() == 2


@pytest.mark.parametrize("tries", [1, 64])
def test_dedup_equals_nested_loop(frame, monkeypatch, tries):
    monkeypatch.setattr(ct, "FIRST_TRIES", tries)
    rng = random.Random(7)
    common = "".join(rng.choice("ACDE") for _ in range(90))
    rows = []
    for i in range(150):
        kind = rng.random()
        if kind < 0.4:  # cuts of one text: hot seeds, many containers
            at = rng.randrange(0, 60)
            seq = common[at:at + rng.randint(1, 90)]
        else:
            seq = "".join(rng.choice("ACDE") for _ in range(rng.randint(0, 40))) + (common if kind > 0.9 else "")
        rows.append((i, f"r{i}", seq))
    stages = dd.Dedup(records(frame, rows))
    unique = {}
    for i, _, seq in rows:
        unique.setdefault(seq, i)
    want = {}
    for seq, i in unique.items():
        holders = [(-len(s), j) for s, j in unique.items() if seq and seq in s and len(s) > len(seq)]
        if holders:
            want[i] = min(holders)[1]
    got = {r.rec_idx: r.absorber_idx for r in stages.absorbed.collect()}
    assert got == want
    kept = {r.rec_idx for r in stages.kept().collect()}
    assert set(got.values()) <= kept and kept == set(unique.values()) - set(want)


def test_seeds_of_a_batch_are_held_piece_by_piece(monkeypatch):
    # what a task holds does not follow from the texts of a batch.
    rng = np.random.default_rng(5)
    texts = [bytes(rng.integers(65, 91, n, dtype=np.uint8)) for n in rng.integers(0, 4000, 400)] + [b"A" * 70_000, b"", None]
    batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.binary()), pa.array(range(len(texts)))], names=["text", "id"])

    def seeds(own_class):
        return [sorted(zip(*(c.to_pylist() for c in b.columns))) for b in sd.seed_rows(iter([batch]), ["id"], list(sd.CLASSES), own_class, None)]

    for own_class in (False, True):
        monkeypatch.setattr(sd, "_PIECE", 1 << 30)
        whole = seeds(own_class)
        assert len(whole) == 1
        monkeypatch.setattr(sd, "_PIECE", 20_000)
        parts = seeds(own_class)
        assert sorted(r for p in parts for r in p) == whole[0]
        assert max(sum(len(texts[i]) for i in {r[0] for r in p}) for p in parts if len({r[0] for r in p}) > 1) <= 20_000


def test_memory_of_seeds_is_bounded():
    # all seeds of a batch were held at once, many times the size of its texts.
    import tracemalloc

    rng = np.random.default_rng(6)
    texts = [bytes(rng.integers(65, 91, 2000, dtype=np.uint8)) for _ in range(2000)]
    batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.binary()), pa.array(range(len(texts)))], names=["text", "id"])
    tracemalloc.start()
    try:
        rows = sum(b.num_rows for b in sd.seed_rows(iter([batch]), ["id"], list(sd.CLASSES), False, None))
        assert rows > 10_000_000 and tracemalloc.get_traced_memory()[1] < 200 << 20
    finally:
        tracemalloc.stop()
