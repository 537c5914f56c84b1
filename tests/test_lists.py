import pytest
from pyspark.sql import functions as F

from seqloom.operators import hits as ht
from seqloom.operators import lists as ls
from seqloom.operators import matching as mt
from seqloom.operators import ordinals as od
from seqloom.sources.files import HIT_SCHEMA


def peptides(frame, label, *words):
    return frame([(label, i, w) for i, w in enumerate(words)], "label string, idx bigint, peptide string")


@pytest.fixture
def db(frame):
    return peptides(frame, "D", "AILK", "ALLK", "PEPTIDEK", "XPEPTIDE")


@pytest.fixture
def denovo(frame):
    return peptides(frame, "N", "ALIK", "PEPTIDE", "PEPTIDE", "ailk")


def test_exact_pairs_are_a_bag(frame, db, denovo):
    pairs = ls.expand_pairs(ls.exact_pairs(db, denovo))
    assert sorted((r.db_original, r.denovo_original) for r in pairs.collect()) == [("AILK", "ALIK"), ("ALLK", "ALIK")]
    twice = ls.exact_pairs(db.unionByName(db), denovo.unionByName(denovo))
    assert {r.n_pairs for r in twice.collect()} == {4}
    assert ls.expand_pairs(twice).count() == 8


def test_substring_only(db, denovo):
    got = ls.substring_pairs(denovo, ls.substring_containers(db, denovo))
    assert sorted((r.idx, r.denovo_original, r.db_containing_peptide) for r in got.collect()) == [
        (1, "PEPTIDE", "PEPTIDEK"), (2, "PEPTIDE", "PEPTIDEK")]


def test_exact_norm_is_not_substring(frame):
    db = peptides(frame, "D", "AAILKAA", "AILK")
    denovo = peptides(frame, "N", "ALLK")
    assert ls.substring_containers(db, denovo).count() == 0


def test_order_of_containers_is_by_first_norm(frame):
    # XAIB's norm comes first; its first original is reported.
    db = peptides(frame, "D", "XALB", "YAIBY", "XAIB")
    got = ls.substring_containers(db, peptides(frame, "N", "AIB")).first()
    assert got.db_original == "XALB"


def test_overlap_summary(frame, db, denovo):
    other = peptides(frame, "M", "WWW")
    both = denovo.unionByName(other)
    got = ls.overlap_summary(db, both, ls.substring_containers(db, both)).orderBy("denovo_file").collect()
    assert [tuple(r) for r in got] == [("D", "M", 0, 0, 0), ("D", "N", 2, 2, 4)]


def test_membership(db, denovo):
    lists = db.unionByName(denovo)
    venn = ls.sort_venn(ls.venn_counts(lists, ["D", "N"])).collect()
    assert [tuple(r) for r in venn] == [("D & N", 1), ("D", 2), ("N", 2)]
    shared = ls.shared_norms(lists, ["D", "N"])
    originals = ls.all_files_originals(lists, shared).orderBy("label", "idx").collect()
    assert [tuple(r) for r in originals] == [("ALLK", "D", 0, "AILK"), ("ALLK", "D", 1, "ALLK"), ("ALLK", "N", 0, "ALIK")]
    assert sum(r.peptide_count for r in venn) == ls.normalized(lists).select("norm").distinct().count()
    with pytest.raises(ValueError):
        ls.membership(lists, ["D", "D"])


def test_a_thousand_lists(frame):
    """Bits of lists beyond one long, and norms of all of them."""
    labels = [f"L{i:04d}" for i in range(1000)]
    rows = [(name, 0, "AIK") for name in labels] + [(name, 1, "PEP") for name in labels[62:65]] + [(labels[-1], 2, "ZZ")]
    lists = frame(rows, "label string, idx bigint, peptide string")
    assert [r.norm for r in ls.shared_norms(lists, labels).collect()] == ["ALK"]
    got = {(r.n_files, r.file_combination[:21]): r.peptide_count for r in ls.venn_counts(lists, labels).collect()}
    assert got == {(1000, "L0000 & L0001 & L0002"): 1, (3, "L0062 & L0063 & L0064"): 1, (1, "L0999"): 1}


def test_pairs_are_written_out_by_steps(frame, monkeypatch):
    monkeypatch.setattr(ls, "_PAIRS_PER_STEP", 4)
    counts = [1, 3, 4, 5, 15, 16, 17, 40, 64, 65, 130]
    pairs = frame([(f"p{n}", n) for n in counts], "db_original string, n_pairs bigint")
    got = {r.db_original: r["count"] for r in ls.expand_pairs(pairs).groupBy("db_original").count().collect()}
    assert got == {f"p{n}": n for n in counts}


def test_length_filter(frame):
    lines = frame([("ABCDEFG",), ("ABCDEFGH",), ("ABCDEFGH",), ("   ABCDE",)], "value string")
    assert sorted(r.value for r in ls.length_filter_distinct(lines).collect()) == ["   ABCDE", "ABCDEFGH"]


def test_ordinals(frame):
    rows = [(i * 7, f"p{i}") for i in range(200)]
    named = od.with_peptide_ids(frame(rows, "idx bigint, peptide string"), "t", ["idx"])
    got = [(r.ordinal, r.id, r.peptide) for r in named.orderBy("ordinal").collect()]
    assert got == [(i + 1, f"t_peptide_{i + 1}", f"p{i}") for i in range(200)]


# ---- peptides in proteins -------------------------------------------------

@pytest.fixture
def proteins(frame):
    return mt.protein_index(frame([(0, "pB", "MKLLT"), (1, "pA", "WWWWW"), (2, "pA", "akiit"), (3, "pC", "")],
                                  "rec_idx bigint, id string, seq string"))


def test_exact_match(frame, proteins):
    wanted = peptides(frame, "x", "KIL", "kll", "QQ", "KIL").drop("label")
    matches = mt.protein_matches(wanted, proteins)
    assert [tuple(r) for r in mt.match_counts(wanted, matches).orderBy("idx").collect()] == [(0, "KIL", 2), (1, "kll", 2), (2, "QQ", 0), (3, "KIL", 2)]
    got = [tuple(r) for r in mt.match_rows(wanted, matches).orderBy("idx", "rec_idx").select("idx", "peptide", "protein_id").collect()]
    assert got == [(0, "KIL", "pB"), (0, "KIL", "pA"), (1, "kll", "pB"), (1, "kll", "pA"), (2, "QQ", "NO_MATCH"), (3, "KIL", "pB"), (3, "KIL", "pA")]
    share = mt.matched_fraction(wanted, matches).first()
    assert (share.n_peptides, share.n_matched, share.pct) == (4, 3, 75.0)


def test_no_peptides(frame, proteins):
    wanted = peptides(frame, "x").drop("label")
    matches = mt.protein_matches(wanted, proteins)
    assert mt.match_rows(wanted, matches).count() == mt.match_counts(wanted, matches).count() == 0
    assert mt.matched_fraction(wanted, matches).first().pct == 0.0


def test_ungapped_hits(frame):
    proteins = mt.protein_index(frame([(0, "p", "AILAIL"), (1, "q", "ALLK")], "rec_idx bigint, id string, seq string"))
    wanted = peptides(frame, "x", "ALL").drop("label")
    got = mt.ungapped_hits(wanted, proteins, mt.protein_matches(wanted, proteins))
    assert sorted((r.subject_id, r.position, r.sseq, r.mismatch) for r in got.collect()) == [
        ("p", 1, "AIL", 1), ("p", 4, "AIL", 1), ("q", 1, "ALL", 0)]


# ---- alignment hits -------------------------------------------------------

@pytest.fixture
def hits(spark):
    rows = [("q1", "p2", 100.0, 4, 0, "AILK", "AILK"), ("q1", "p1", 75.0, 4, 1, "AILK", "ALLK"),
            ("q1", "p3", 75.0, 4, 1, "AILK", "AILR"), ("q1", "p4", 25.0, 4, 3, "AILK", "LLLL"),
            ("q2", "p1", 100.0, 3, 0, "AILK", "AILK"), ("q3", "p9", 75.0, 4, 0, "A-LK", "AILK")]
    return spark.createDataFrame([(*r, 0.1, 20.0) for r in rows], HIT_SCHEMA)


def test_hit_funnel_and_summary(hits):
    assert tuple(ht.hit_funnel(hits, 70, 1).first()) == (6, 5, 4, 3)
    kept = ht.filter_hits(hits, "t", 70, 1)
    assert kept.columns == ["tool", "query_id", "subject_id", "pident", "mismatch", "qseq", "sseq", "evalue"]
    subjects = ht.hit_subjects(kept)
    assert sorted(tuple(r) for r in subjects.collect()) == [("A-LK", "p9"), ("AILK", "p1"), ("AILK", "p2")]
    assert sorted(tuple(r) for r in ht.subject_counts(subjects, "t").collect()) == [("t", "A-LK", 1), ("t", "AILK", 2)]
    assert ht.subject_counts(subjects.limit(0), "t").columns == ["tool", "peptide", "n_proteins"]


def test_match_table_counts_and_names_proteins(frame, proteins):
    # ids in the order of the records, one row per input peptide.
    wanted = peptides(frame, "x", "KIL", "kll", "QQ", "KIL").drop("label")
    got = mt.match_table(wanted, mt.protein_matches(wanted, proteins)).orderBy("idx")
    assert [tuple(r) for r in got.select("idx", "peptide", "n_proteins", "protein_ids").collect()] == [
        (0, "KIL", 2, "pB;pA"), (1, "kll", 2, "pB;pA"), (2, "QQ", 0, "NO_MATCH"), (3, "KIL", 2, "pB;pA")]
