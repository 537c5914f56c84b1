import pytest
from pyspark.sql import functions as F

from seqloom.operators import kmers as km
from seqloom.operators import latest
from seqloom.session import materialize

SHORT = [(0, "t1", "*macde*"), (1, "t2", "MAC"), (2, "t2", "ACD"), (3, "t3", "**"), (4, "t2", "*")]
LONG = [(0, "u1", "CDEXF"), (1, "u2", "ACD"), (2, "u3", "AC")]
REFERENCE = [(0, "r1", "MACW"), (1, "r2", "ACDY"), (2, "r2", "CDEK")]


@pytest.fixture
def sequences(frame):
    rows = [(*r, 1) for r in SHORT] + [(*r, 2) for r in LONG]
    return km.keyed_sequences(frame(rows, "rec_idx bigint, id string, seq string, side int"))


@pytest.fixture
def reference(frame):
    return km.record_stream(frame(REFERENCE, "rec_idx bigint, id string, seq string"))


def rows(df, *columns):
    return [tuple(r) for r in df.select(*columns).collect()]


def test_last_sequence_wins(sequences):
    got = sorted(rows(sequences, "side", "id", "seq", "rec_idx"))
    assert got == [(1, "t1", "MACDE", 0), (1, "t2", "ACD", 1), (2, "u1", "CDEXF", 0), (2, "u2", "ACD", 1), (2, "u3", "AC", 2)]


def test_piles(sequences):
    tagged = km.tagged_windows(sequences, [3])
    piles = km.pile_counts_by_kmer(tagged, "short", "long")
    got = rows(km.sort_piles(piles, "short", "long"), "kmer", "pile", "short_count", "long_count")
    assert got == [("ACD", "shared", 2, 1), ("CDE", "shared", 1, 1), ("MAC", "only_short", 1, 0)]
    assert sorted(rows(km.pile_postings(tagged), "kmer", "cell", "value")) == [
        ("ACD", 0, "t1"), ("ACD", 0, "t2"), ("ACD", 1, "u2"), ("CDE", 0, "t1"), ("CDE", 1, "u1"), ("MAC", 0, "t1")]


def test_counts_agree_with_postings(sequences, reference):
    tagged = km.tagged_windows(sequences, [2, 3], reference)
    counts = km.pile_counts_by_kmer(tagged, "a", "b", reference=True)
    postings = km.pile_postings(tagged).groupBy("kmer").pivot("cell", [0, 1, 2]).count().na.fill(0)
    want = sorted((r["kmer"], r["0"], r["1"], r["2"] > 0) for r in postings.collect() if r["0"] + r["1"])
    assert sorted(rows(counts, "kmer", "a_count", "b_count", "ref_match")) == want


def test_keep_ambiguous(sequences):
    piles = km.pile_counts_by_kmer(km.tagged_windows(sequences, [3], skip_ambiguous=False), "short", "long")
    assert {r.kmer for r in piles.collect() if r.pile == "only_long"} == {"DEX", "EXF"}


def test_annotation(sequences, reference):
    piles = km.pile_counts_by_kmer(km.tagged_windows(sequences, [3]), "short", "long")
    windows = km.windows(reference, [3])
    annotated = km.annotate(piles, km.reference_index(windows))
    assert sorted(rows(annotated, "kmer", "ref_match", "category")) == [
        ("ACD", True, "shared|in_reference"), ("CDE", True, "shared|in_reference"), ("MAC", True, "only_short|in_reference")]
    assert sorted(rows(km.reference_postings(annotated, windows), "kmer", "pile", "ref_protein")) == [
        ("ACD", "shared", "r2"), ("CDE", "shared", "r2"), ("MAC", "only_short", "r1")]
    one_less = km.reference_index(km.windows(reference.filter("rec_idx < 2"), [3]))
    got = dict(rows(km.annotate(piles, one_less), "kmer", "category"))
    assert got["CDE"] == "shared|novel"


def test_summaries(sequences, reference):
    counts = km.pile_counts_by_kmer(km.tagged_windows(sequences, [3], reference), "short", "long", reference=True)
    got = {r.category: r.n for r in km.category_summary(counts).collect()}
    assert got["shared|in_reference"] == 2 and got["TOTAL"] == 3 and got["NOVEL"] == 0
    table = {r.kmer_type: r["count"] for r in km.category_count_table(counts).collect()}
    assert table["shared_in_reference"] == 2 and table["only_long_novel"] is None
    piles = {r.pile: (r.n, round(r.pct, 1)) for r in km.pile_summary(counts, "short", "long").collect()}
    assert piles == {"shared": (2, 66.7), "only_short": (1, 33.3), "only_long": (0, 0.0), "TOTAL": (3, 100.0)}
    other = km.pile_counts_by_kmer(km.tagged_windows(sequences, [3], reference), "x", "y", reference=True)
    got = {r.category: r.n for r in km.category_summary(other).collect()}
    assert got["only_short|in_reference"] == 0 and got["TOTAL"] == 3


def test_metrics(sequences, frame):
    long = km.parse_metrics(sequences.filter("side = 2"), 3).first()
    assert (long.n_sequences, long.skipped_short, long.skipped_ambiguous) == (3, 1, 2)
    load = km.load_metrics(frame(SHORT, "rec_idx bigint, id string, seq string")).first()
    assert (load.n_records, load.empty, load.loaded, load.duplicates) == (5, 2, 2, 1)


def test_na_is_a_kmer(frame):
    seqs = frame([("p", "NAC", 1)], "id string, seq string, side int")
    got = {r.kmer for r in km.pile_counts_by_kmer(km.tagged_windows(seqs, [2])).collect()}
    assert got == {"NA", "AC"}


def test_errors(sequences):
    with pytest.raises(ValueError):
        km.windows(sequences, [0])
    with pytest.raises(ValueError):
        km.pile_counts_by_kmer(km.tagged_windows(sequences, [3]), "a", "a")


def test_shared_ids(frame):
    a = frame([("x",), ("y",), ("x",)], "id string")
    b = frame([("x",), ("z",)], "id string")
    assert rows(km.shared_ids(a, b), "id") == [("x",)]


def test_one_shuffle_for_piles_and_reference(sequences, reference):
    # The windows meet in one aggregation; that repeated ids are joined away before is another step, written out here.
    sequences = materialize(sequences)
    tagged = km.tagged_windows(sequences.select("id", "seq", "side").hint("rebalance"), [3], reference)
    plan = km.pile_counts_by_kmer(tagged, reference=True)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("hashpartitioning(kmer") == 1 and "Join" not in plan


def test_piles_partition_the_union(sequences):
    counts = km.pile_counts_by_kmer(km.tagged_windows(sequences, [2]))
    everything = km.windows(sequences, [2]).select("kmer").distinct()
    assert counts.count() == everything.count()
    assert counts.filter((F.col("file1_count") == 0) & (F.col("file2_count") == 0)).count() == 0


@pytest.mark.parametrize("most", [0, 500_000])
def test_texts_reach_the_windows_without_sorts(frame, monkeypatch, most):
    """Repeated ids are settled by numbers; while they are few no text is in an exchange or aggregation."""
    monkeypatch.setattr(latest, "REPEATED_KEYS", most)
    records = frame([(i, f"t{i % 7}", "ACDE" * (i % 3), 1 + i % 2) for i in range(60)], "rec_idx bigint, id string, seq string, side int")
    last, first, n = {}, {}, {}
    for r in records.collect():
        if r.seq:
            key = (r.side, r.id)
            n[key] = n.get(key, 0) + 1
            first[key] = min(first.get(key, r.rec_idx), r.rec_idx)
            last[key] = max(last.get(key, (-1, "")), (r.rec_idx, r.seq))
    kept = km.keyed_sequences(records.persist())
    assert sorted(rows(kept, "side", "id", "seq", "rec_idx", "n_records")) == sorted((*k, last[k][1], first[k], n[k]) for k in last)
    plan = km.windows(kept, [3])._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and (most == 0 or "hashpartitioning" not in plan)
    records.unpersist()


def test_pile_table_names_the_ids_of_both_sources(sequences, reference):
    # the table without a reference.
    got = rows(km.sort_piles(km.pile_table(km.tagged_windows(sequences, [3]), "short", "long"), "short", "long"),
               "kmer", "pile", "short_transcripts", "long_transcripts", "short_count", "long_count")
    assert got == [("ACD", "shared", "t1;t2", "u2", 2, 1), ("CDE", "shared", "t1", "u1", 1, 1), ("MAC", "only_short", "t1", "", 1, 0)]


def test_pile_table_names_the_ids_of_the_reference(sequences, reference):
    # every k-mer of the piles, those outside the reference too.
    got = rows(km.pile_table(km.tagged_windows(sequences, [3], reference), "short", "long", reference=True),
               "kmer", "short_transcripts", "long_transcripts", "ref_match", "ref_proteins", "category")
    assert sorted(got) == [("ACD", "t1;t2", "u2", True, "r2", "shared|in_reference"), ("CDE", "t1", "u1", True, "r2", "shared|in_reference"),
                           ("MAC", "t1", "", True, "r1", "only_short|in_reference")]
    alone = rows(km.pile_table(km.tagged_windows(sequences, [3], reference.filter("rec_idx = 0")), "short", "long", reference=True),
                 "kmer", "ref_match", "ref_proteins")
    assert sorted(alone) == [("ACD", False, ""), ("CDE", False, ""), ("MAC", True, "r1")]


@pytest.mark.parametrize(("ks", "skip"), [([8, 9, 10, 11], True), ([3], False), ([1, 12], True), ([2, 13], True)])
def test_counted_piles_equal_the_rows_of_piles(frame, monkeypatch, ks, skip):
    # F4, F8: integers in place of strings, whatever the letters and however they are cut.
    import random

    monkeypatch.setattr(km.pk, "_STEP", 50)
    monkeypatch.setattr(km.pk, "_HELD", 100)
    monkeypatch.setattr(km.pk, "_BUCKET", 300)
    rng = random.Random(len(ks))
    texts = ["".join(rng.choice("ACDX*" if i % 3 else "ACé1-~Z") for _ in range(rng.randrange(60))) for i in range(80)]
    rows_ = [(i, f"s{i}", t, 1 + i % 2) for i, t in enumerate(texts)] + [(99, "last", texts[3][5:], 2)]
    sequences = frame(rows_, "rec_idx bigint, id string, seq string, side int")
    reference = sequences.filter("rec_idx < 9").select("rec_idx", "id", F.substring("seq", 4, 30).alias("seq"))
    for ref in (None, reference):
        names = ["k", "pile"] + (["category", "ref_match"] if ref is not None else [])
        piles = km.pile_counts_by_kmer(km.tagged_windows(sequences, ks, ref, skip), "a", "b", reference=ref is not None)
        got = km.counted_piles(sequences, ks, "a", "b", ref, skip)
        assert sorted(rows(got, *names, "n_kmers")) == sorted(rows(piles.groupBy(*names).count(), *names, "count"))


def test_one_window_for_all_lengths():
    # F4, F8: a place gives one integer whatever the number of lengths, repeats once.
    import numpy as np

    data = np.frombuffer(b"ACDEFGHIKLMNPQRST" * 40, np.uint8)
    codes = list(km.pk.window_codes(data, np.array([0, len(data)]), np.array([2]), 8, 11, ""))
    assert len(codes) == 1 and len(codes[0]) <= 17 + 3
    assert km.pk.count_codes(codes[0], [8, 9, 10, 11]) == {(k, 2): 17 for k in (8, 9, 10, 11)}
