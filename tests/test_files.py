from pathlib import Path

import pytest

from seqloom import cli
from seqloom.plans import flows
from seqloom.sinks import files as sinks
from seqloom.sources import files as src


def put(tmp_path, name, text):
    path = tmp_path / name
    path.write_text(text)
    return str(path)


def lines(folder, header=True):
    """Rows of all part files in order; one header is kept."""
    out = []
    for i, part in enumerate(sorted(Path(folder).rglob("part-*"))):
        rows = part.read_text().splitlines()
        out += rows if not header or not out else rows[1:]
    return out


def records(df):
    return [(r.id, r.seq) for r in df.orderBy("rec_idx").collect()]


def test_fasta(spark, tmp_path):
    path = put(tmp_path, "a.fa", "junk\n>a first one\nAC\nd e\n\n>b\n>c x\r\nMK*\r\n")
    assert records(src.read_fasta(spark, path)) == [("a", "ACde"), ("b", ""), ("c", "MK*")]
    assert records(src.read_ordered_fasta(spark, path)) == [("a", "ACD E"), ("b", ""), ("c", "MK*")]


def test_fasta_without_preamble_and_with_bare_header(spark, tmp_path):
    path = put(tmp_path, "a.fa", ">a\nAC\n>\nDE\n")
    assert records(src.read_fasta(spark, path)) == [("a", "AC"), ("", "DE")]
    with pytest.raises(Exception, match="without a name"):
        src.read_ordered_fasta(spark, path).collect()


def test_fasta_order_over_files_and_splits(spark, tmp_path):
    names = []
    for f in ("z", "a"):
        names.append(put(tmp_path, f"{f}.fa", "".join(f">{f}{i}\n{'ACDE' * (i % 7)}\n" for i in range(400))))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        df = src.read_fasta(spark, names)
        assert df.rdd.getNumPartitions() > 4
        assert records(df) == [(f"{f}{i}", "ACDE" * (i % 7)) for f in ("z", "a") for i in range(400)]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_many_small_files_each_keep_their_first_record(spark, tmp_path):
    names = [put(tmp_path, f"f{i}.fa", f"{'x' if i == 2 else ''}\n>n{i}\nAC\n" if i % 2 == 0 else f">n{i}\nAC\n") for i in range(6)]
    assert [i for i, _ in records(src.read_fasta(spark, names))] == [f"n{i}" for i in range(6)]


def test_peptide_lists(spark, tmp_path):
    a = put(tmp_path, "a.txt", " AC \n\n\tde\nAC\n")
    assert [(r.label, r.peptide) for r in src.read_peptides(spark, a).orderBy("idx").collect()] == [
        ("a", "AC"), ("a", "de"), ("a", "AC")]
    (tmp_path / "b").mkdir()
    other = put(tmp_path / "b", "a.tsv", "X\n")
    with pytest.raises(ValueError):
        src.read_peptide_lists(spark, [a, other])


@pytest.mark.parametrize("name, k", [("kmers_k9.tsv", 9), ("a_k10_k2.tsv", 10), ("dir_k3/kmers_k11.tsv", 11)])
def test_k_of_name(name, k):
    assert src.k_of(name) == k


def test_bad_k_of_name():
    with pytest.raises(ValueError):
        src.k_of("kmers9.tsv")


def test_tables(spark, tmp_path):
    path = put(tmp_path, "p_k2.tsv", "kmer\tpile\tx_count\ty_count\nNA\tshared\t2\tbad\nNULL\tonly_x\t\t3.0\n")
    rows = src.read_piles(spark, path).orderBy("kmer").collect()
    assert [(r.kmer, r.x_count, r.y_count) for r in rows] == [("NA", 2, 0), ("NULL", 0, 3)]
    with pytest.raises(ValueError, match="lacks columns"):
        src.read_modified_peptides(spark, path)
    missing = put(tmp_path, "iso.txt", "isoform\tother\ni1\tx\n")
    assert [tuple(r)[1:] for r in src.read_isoforms(spark, missing).collect()] == [("i1", "")]
    csv = put(tmp_path, "p.csv", 'instanovoplus_predictions,b\n"[\'G\', \'S[x]\']",1\n')
    assert src.read_predictions(spark, csv).first()[0] == "['G', 'S[x]']"


def test_kmer_flow(spark, tmp_path):
    short = put(tmp_path, "s.fa", ">t1\n*macde*\n>t2\nMAC\n>t2\nACD\n>t3\n**\n")
    long = put(tmp_path, "l.fa", ">u1\nCDEXF\n>u2\nACD\n>u3\nAC\n")
    ref = put(tmp_path, "r.fa", ">r1\nMACW\n>r2\nACDY\n")
    out = str(tmp_path / "out")
    assert cli.main(["--log", str(tmp_path / "log"), "piles", "--file1", short, "--file2", long, "--label1", "short",
                     "--label2", "long", "--k", "3", "4", "--outdir", out]) == 0
    told = (tmp_path / "log").read_text()
    assert "only_short" in told and "read 7 records: 5 loaded, 1 empty, 1 with a repeated id" in told
    assert "k=3: 1 sequences too short, 2 ambiguous windows skipped; unique k-mers: 3 in short, 2 in long" in told
    assert lines(f"{out}/kmers_k3.tsv") == [
        "kmer\tpile\tshort_transcripts\tlong_transcripts\tshort_count\tlong_count",
        "ACD\tshared\tt1;t2\tu2\t2\t1", "CDE\tshared\tt1\tu1\t1\t1", "MAC\tonly_short\tt1\t\t1\t0"]
    done = flows.annotate_piles(spark, [f"{out}/kmers_k3.tsv"], ref, out, track_ids=True, split_categories=True)
    assert {r.category: r.n for r in done[f"{out}/kmers_k3.tsv"].collect()}["shared|novel"] == 1
    got = sorted(lines(f"{out}/kmers_k3_annotated.tsv"))
    assert got[0] == "ACD\tshared\tt1;t2\tu2\t2\t1\tTrue\tr2\tshared|in_reference"
    assert got[1] == "CDE\tshared\tt1\tu1\t1\t1\tFalse\t\tshared|novel"
    counts = {r.kmer_type: r["count"] for r in flows.count_categories(spark, f"{out}/k3_by_category").collect()}
    assert counts == {"only_long_in_reference": None, "only_long_novel": None, "only_short_in_reference": 1,
                      "only_short_novel": None, "shared_in_reference": 1, "shared_novel": 1}
    assert cli.main(["piles", "--file1", short, "--file2", long, "--label1", "x", "--label2", "x"]) == 1


def test_compare_flow(spark, tmp_path):
    d = put(tmp_path, "D.txt", "AILK\nALLK\nPEPTIDEK\nXPEPTIDE\n")
    n = put(tmp_path, "N.txt", "ALIK\nPEPTIDE\nPEPTIDE\nailk\n")
    m = put(tmp_path, "M.txt", "WWW\n")
    out = str(tmp_path / "out")
    flows.compare_lists(spark, [d], [n, m], out)
    assert Path(out, "overlap_summary.tsv").read_text().splitlines() == [
        "db_file\tdenovo_file\texact_overlap\tsubstring_only_overlap\ttotal_overlap", "D\tN\t2\t2\t4", "D\tM\t0\t0\t0"]
    assert Path(out, "venn_counts.tsv").read_text().splitlines()[:3] == ["file_combination\tpeptide_count", "D & N\t1", "D\t2"]
    assert sorted(lines(Path(out, "exact_overlaps", "D__N.tsv"))) == ["AILK\tALIK\tALLK", "ALLK\tALIK\tALLK", "D_original\tN_original\til_normalized"]
    assert not Path(out, "exact_overlaps", "D__M.tsv").exists()
    assert lines(Path(out, "substring_overlaps", "D__N.tsv")) == ["N_denovo\tD_db_containing_peptide"] + ["PEPTIDE\tPEPTIDEK"] * 2
    text = [part.read_text() for part in Path(out, "all_files_overlap.tsv").glob("part-*")]
    assert set(text) <= {"\n".join([*sinks.ALL_FILES_COMMENTS, "normalized_sequence\tD\tN\tM"]) + "\n"}
    both = str(tmp_path / "both")
    flows.compare_lists(spark, [d], [n], both)
    rows = [line for part in sorted(Path(both, "all_files_overlap.tsv").glob("part-*")) for line in part.read_text().splitlines()]
    assert rows[:2] == sinks.ALL_FILES_COMMENTS and [x for x in rows if x[0] != "#"][:2] == ["normalized_sequence\tD\tN", "ALLK\tAILK;ALLK\tALIK"]


def test_dedup_flow(spark, tmp_path):
    fasta = put(tmp_path, "in.fa", ">a\nABCDEF\n>b\nBCD\n>c\nbcd\n>d\nZABC\nDE\n>e\nCD\n>f\n>g\nABC\n")
    summary = flows.dedup_fasta(spark, fasta, str(tmp_path / "out")).first()
    assert tuple(summary) == (7, 1, 3, 3)
    assert lines(tmp_path / "out" / "in_dedup.fa", header=False) == [">a", "ABCDEF", ">d", "ZABCDE", ">f"]
    assert lines(tmp_path / "out" / "in_clusters.tsv") == [
        "representative_id\trelated_id\trelationship", "b\tc\tidentical", "a\tb\tsubstring", "a\tg\tsubstring", "a\te\tsubstring"]


def test_match_and_hit_flows(spark, tmp_path):
    peptides = put(tmp_path, "p.txt", "KIL\nkll\nQQ\nKIL\n")
    fasta = put(tmp_path, "r.fa", ">pB\nMKLLT\n>pA\nAKIIT\n")
    out = str(tmp_path / "m.tsv")
    assert flows.match_exact(spark, peptides, fasta, out).first().n_matched == 3
    assert lines(out) == ["peptide\tn_proteins\tprotein_ids", "KIL\t2\tpB;pA", "kll\t2\tpB;pA", "QQ\t0\tNO_MATCH", "KIL\t2\tpB;pA"]
    hits = put(tmp_path, "h.tsv", "q1\tp2\t100\t4\t0\tAILK\tAILK\t0.1\t9\nq1\tp1\t75\t4\t1\tAILK\tALLK\t0.1\t9\n")
    assert tuple(flows.parse_hits(spark, "t", hits, str(tmp_path / "s.tsv"), 70).first()) == (2, 2, 2, 2)
    assert lines(tmp_path / "s.tsv") == ["tool\tpeptide\tn_proteins\tprotein_ids", "t\tAILK\t2\tp1;p2"]
    flows.list_to_fasta(spark, peptides, "t", str(tmp_path / "q.fa"))
    assert lines(tmp_path / "q.fa", header=False)[:4] == [">t_peptide_1", "KIL", ">t_peptide_2", "kll"]


def test_extraction_flows(spark, tmp_path):
    ssl = put(tmp_path, "a.ssl", "x\tsequence\n1\tC[+57.02]AA\n2\t[only]\n3\t\n4\tAC\n")
    flows.extract_modified(spark, ssl, str(tmp_path / "a"))
    assert sorted(lines(tmp_path / "a", header=False)) == ["AC", "CAA"]
    csv = put(tmp_path, "p.csv", "instanovoplus_predictions,instanovoplus_prediction_log_probability,delta_mass_ppm\n"
              "\"['G', 'S[UNIMOD:21]', 'R']\",-0.5,1.5\n\"[]\",-1,2\n\"['A', 'A', 'A']\",-3,bad\n,1,1\n")
    flows.extract_token_lists(spark, csv, str(tmp_path / "t"))
    assert sorted(lines(tmp_path / "t", header=False)) == ["AAA", "GSR"]
    ref = put(tmp_path, "ref.tsv", "peptide\tn_proteins\n gsr \t0\nGSR\t2\nAAA\t0\n")
    summary = flows.prediction_quality(spark, csv, ref, str(tmp_path / "q"))
    assert tuple(summary.first()) == (4, 2, 1, 1, 2)
    assert len((tmp_path / "q" / "box_stats.tsv").read_text().splitlines()) == 4
    none = put(tmp_path, "none.tsv", "peptide\tn_proteins\nWWW\t1\n")
    with pytest.raises(ValueError, match="no prediction"):
        flows.prediction_quality(spark, csv, none, str(tmp_path / "q2"))
    iso = put(tmp_path, "iso.txt", "isoform\tORF_seq\ni1\tMK*\ni2\tNA\ni3\t*\ni4\tna\n")
    assert tuple(flows.isoforms_to_fasta(spark, iso, str(tmp_path / "i.fa")).first()) == (3, 1)
    assert lines(tmp_path / "i.fa", header=False) == [">i1", "MK", ">i3", "", ">i4", "na"]
    text = put(tmp_path, "l.txt", "ABCDEFGH\nABCDEFG\nABCDEFGH\nAAAAAAAAA\n")
    flows.filter_by_length(spark, text, str(tmp_path / "l"))
    assert lines(tmp_path / "l", header=False) == ["AAAAAAAAA", "ABCDEFGH"]


def test_positions_are_unique_over_the_files_of_a_folder(spark, tmp_path):
    folder = tmp_path / "match.tsv"
    folder.mkdir()
    for n in range(4):
        (folder / f"part-{n}.tsv").write_text("peptide\tn_proteins\n" + "".join(f"P{n}{i}\t{i}\n" for i in range(3)))
    rows = sorted((r.idx, r.peptide) for r in src.read_peptide_reference(spark, str(folder)).repartition(5).collect())
    assert len({i for i, _ in rows}) == 12 and [p for _, p in rows] == [f"P{n}{i}" for n in range(4) for i in range(3)]


def test_preambles_of_several_files(spark, tmp_path):
    (tmp_path / "a.fa").write_text("noise\n>x\nAA\n>y\nBB\n")
    (tmp_path / "b.fa").write_text(">z\nCC\n")
    (tmp_path / "c.fa").write_text("noise\nmore\n>w\nDD\n")
    rows = src.read_fasta(spark, [str(tmp_path / n) for n in ("c.fa", "a.fa", "b.fa")]).orderBy("rec_idx").collect()
    assert [(r.id, r.seq) for r in rows] == [("w", "DD"), ("x", "AA"), ("y", "BB"), ("z", "CC")]


def test_records_of_a_column(spark, frame):
    df = frame([(1, ">a b\nAC \r\nDE\t"), (2, "\nQ\x0b"), (3, ""), (4, None)], "n int, value string")
    rows = {r.n: (r.id, r.seq) for r in df.select("n", *src.fasta_fields(df.value)).collect()}
    assert rows == {1: ("a", "ACDE"), 2: ("", "Q"), 3: ("", ""), 4: (None, None)}
    spaced = df.filter("n = 1").select(*src.fasta_fields(df.value, inner_spaces=True)).first()
    assert tuple(spaced) == ("a", "ACDE")
    lines = frame([(1, " x y\t"), (2, " \x0b"), (3, None)], "n int, line string")
    assert [(r.n, r.peptide) for r in src.peptide_lines(lines, "line").collect()] == [(1, "x y")]


def test_typed_piles_of_a_frame(spark, frame):
    df = frame([(1, None, "7.9"), (2, "k", None), (3, "", "1e2"), (4, "NA", "x")], "n int, kmer string, a_count string")
    rows = [tuple(r) for r in src.typed_piles(df, keep=("n",)).orderBy("n").collect()]
    assert rows == [(1, "", 7), (2, "k", 0), (3, "", 100), (4, "NA", 0)]
