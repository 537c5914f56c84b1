"""The file-to-file flows: read, run the operators, write."""

from __future__ import annotations

import logging
from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from seqloom.functions import text as tx
from seqloom.operators import hits as ht
from seqloom.operators import kmers as km
from seqloom.operators import lists as ls
from seqloom.operators import matching as mt
from seqloom.operators import ordinals as od
from seqloom.operators import quality as ql
from seqloom.operators.dedup import Dedup
from seqloom.session import materialize
from seqloom.sinks import files as sinks
from seqloom.sources import files as src

log = logging.getLogger("seqloom")


def assign_piles(spark: SparkSession, file1: str, file2: str, outdir: str, label1: str = "file1",
                 label2: str = "file2", ks: Sequence[int] = (9,), keep_ambiguous: bool = False) -> DataFrame:
    """k-mer piles of two FASTA files, one table per k; returns the summary."""
    if label1 == label2:
        raise ValueError("the two labels must be different")
    for k in ks:
        if k < 1:
            raise ValueError(f"k must be >= 1, got {k}")
        if k > 30:
            log.warning("k=%d is very large; expect sparse results", k)
    records = (src.read_fasta(spark, file1).withColumn("side", F.lit(km.FILE1))
               .unionByName(src.read_fasta(spark, file2).withColumn("side", F.lit(km.FILE2))))
    # The figures are observed in the passes that do the work.
    load, parse, unique = Observation("load"), Observation("parse"), Observation("unique")
    sequences = materialize(km.keyed_sequences(records.observe(load, *km.load_figures())))
    common = km.shared_ids(sequences.filter("side = 1"), sequences.filter("side = 2")).count()
    if common:
        log.warning("%d ids appear in both files and cannot be told apart in the output", common)
    observed = sequences.observe(parse, *[figure for k in ks for figure in km.parse_figures(k, f"_{k}")])
    tagged = materialize(km.tagged_windows(observed, list(ks), skip_ambiguous=not keep_ambiguous))
    figures = [figure.alias(f"{name}_{k}") for k in ks for name, figure in _unique_of(k, label1, label2)]
    piles = materialize(km.pile_counts_by_kmer(tagged, label1, label2).observe(unique, *figures))
    _log_load(load.get, parse.get[f"n_sequences_{ks[0]}"])
    for k in ks:
        log.info("k=%d: %d sequences too short, %d ambiguous windows %s; unique k-mers: %d in %s, %d in %s", k, parse.get[f"skipped_short_{k}"],
                 parse.get[f"skipped_ambiguous_{k}"] or 0, "kept" if keep_ambiguous else "skipped", unique.get[f"unique_1_{k}"], label1,
                 unique.get[f"unique_2_{k}"], label2)
    for k in ks:
        postings = km.pile_postings(tagged.filter(F.col("k") == k))
        sinks.write_piles(piles.filter(F.col("k") == k), postings, f"{outdir}/kmers_k{k}.tsv", label1, label2)
    return km.pile_summary(piles, label1, label2)


def _unique_of(k: int, label1: str, label2: str) -> list[tuple[str, Column]]:
    of = F.col("k") == k
    return [(f"unique_{i}", F.count_if(of & (F.col(f"{label}_count") > 0))) for i, label in enumerate((label1, label2), 1)]


def _log_load(found: dict, loaded: int) -> None:
    log.info("read %d records: %d loaded, %d empty, %d with a repeated id", found["read"], loaded, found["empty"],
             found["read"] - found["empty"] - loaded)


def annotate_piles(spark: SparkSession, inputs: Sequence[str], reference: str, outdir: str,
                   track_ids: bool = False, split_categories: bool = False,
                   keep_ambiguous: bool = False) -> dict[str, DataFrame]:
    """Reference state for pile tables; returns a summary per input.

    The reference is read once; outputs are named after their input, so two
    inputs with the same k do not overwrite each other.
    """
    ks = {path: src.k_of(path) for path in inputs}
    load = Observation("reference")
    records = km.record_stream(src.read_fasta(spark, reference).observe(load, *km.load_figures()))
    windows = km.windows(records, sorted(set(ks.values())), not keep_ambiguous)
    summaries, indexes = {}, {}
    for path, k in sorted(ks.items(), key=lambda item: item[1]):
        own = windows.filter(F.col("k") == k)
        if k not in indexes:  # one index per k, whatever the number of inputs
            indexes[k] = materialize(km.reference_index(own))
            log.info("reference, k=%d: read %d records, %d empty; %d unique k-mers", k, load.get["read"], load.get["empty"], indexes[k].count())
        annotated = materialize(km.annotate(src.read_piles(spark, path), indexes[k]))
        stem = src.label_of(path)
        sinks.write_annotated(annotated, f"{outdir}/{stem}_annotated.tsv", km.reference_postings(annotated, own) if track_ids else None)
        if split_categories:
            name = f"k{k}_by_category" if len(set(ks.values())) == len(ks) else f"{stem}_by_category"
            sinks.write_by_category(annotated, f"{outdir}/{name}")
        summaries[path] = km.category_summary(annotated)
    return summaries


def count_categories(spark: SparkSession, folder: str) -> DataFrame:
    """Rows per category of a split output; null where a category is missing."""
    table = (spark.read.option("sep", "\t").option("header", True)
             .option("basePath", folder).csv(f"{folder}/category_safe=*"))
    return km.category_count_table(table.withColumnRenamed("category_safe", "category")
                                   if "category" not in table.columns else table)


def compare_lists(spark: SparkSession, db_files: Sequence[str], denovo_files: Sequence[str],
                  outdir: str) -> DataFrame:
    """All overlaps of database and de novo lists; returns the summary."""
    db, db_labels = src.read_peptide_lists(spark, list(db_files))
    denovo, denovo_labels = src.read_peptide_lists(spark, list(denovo_files))
    labels = db_labels + denovo_labels
    if len(set(labels)) != len(labels):
        raise ValueError(f"two input files share a label: {labels}")
    containers = materialize(ls.substring_containers(db, denovo))
    everything = db.unionByName(denovo)
    sinks.write_exact_pairs(materialize(ls.exact_pairs(db, denovo)), f"{outdir}/exact_overlaps")
    sinks.write_substring_pairs(materialize(ls.substring_pairs(denovo, containers)), f"{outdir}/substring_overlaps")
    shared = materialize(ls.shared_norms(everything, labels))
    sinks.write_all_files(shared, ls.all_files_originals(everything, shared), f"{outdir}/all_files_overlap.tsv", labels)
    sinks.write_venn(ls.venn_counts(everything, labels), f"{outdir}/venn_counts.tsv")
    # Every pair of files, also those of an empty list.
    found = ls.overlap_summary(db, denovo, containers)
    pairs = spark.createDataFrame([(a, b, i, j) for i, a in enumerate(db_labels) for j, b in enumerate(denovo_labels)],
                                  "db_file string, denovo_file string, i int, j int")
    summary = (pairs.join(found, ["db_file", "denovo_file"], "left").orderBy("i", "j").drop("i", "j")
               .na.fill(0, ["exact_overlap", "substring_only_overlap", "total_overlap"]))
    sinks.write_small_tsv(summary, f"{outdir}/overlap_summary.tsv")
    return summary


def dedup_fasta(spark: SparkSession, fasta: str, outdir: str, prefix: str | None = None,
                name_semantics: bool = False) -> DataFrame:
    """De-duplicated FASTA and its clusters; returns the summary."""
    prefix = prefix or src.label_of(fasta)
    stages = Dedup(src.read_ordered_fasta(spark, fasta), name_semantics)
    sinks.write_fasta(stages.kept(), f"{outdir}/{prefix}_dedup.fa", tx.FASTA_WIDTH)
    sinks.write_provenance(stages.provenance(), f"{outdir}/{prefix}_clusters.tsv")
    return stages.summary()


def match_exact(spark: SparkSession, peptides: str, fasta: str, out: str) -> DataFrame:
    """Protein ids per peptide, L and I equal; returns the matched share."""
    wanted = src.read_peptides(spark, peptides)
    proteins = materialize(mt.protein_index(src.read_fasta(spark, fasta)))
    matches = materialize(mt.protein_matches(wanted, proteins))
    sinks.write_matches(mt.match_counts(wanted, matches), mt.match_rows(wanted, matches), out)
    return mt.matched_fraction(wanted, matches)


def parse_hits(spark: SparkSession, tool: str, hits_tsv: str, out: str, min_pident: float = ht.MIN_IDENTITY,
               max_mismatch: int = ht.MAX_MISMATCH) -> DataFrame:
    """Summary of the accepted alignment hits; returns the filter funnel."""
    hits = src.read_hits(spark, hits_tsv)
    kept = ht.filter_hits(hits, tool, min_pident, max_mismatch)
    subjects = materialize(ht.hit_subjects(kept))
    sinks.write_hit_summary(ht.subject_counts(subjects, tool), subjects, out)
    return ht.hit_funnel(hits, min_pident, max_mismatch)


def list_to_fasta(spark: SparkSession, peptides: str, tool: str, out: str) -> None:
    """FASTA of a peptide list with numbered names."""
    lines = src.read_peptides(spark, peptides)
    named = od.with_peptide_ids(lines, tool, ["idx"])
    sinks.write_fasta(named.withColumnRenamed("peptide", "seq"), out, order=["ordinal"])


def isoforms_to_fasta(spark: SparkSession, table: str, out: str) -> DataFrame:
    """Protein FASTA of an isoform report; returns written and skipped counts."""
    isoforms = src.read_isoforms(spark, table)
    ok = mt.has_protein(F.col("ORF_seq"))
    kept = isoforms.filter(ok).select("idx", F.col("isoform").alias("id"),
                                      tx.strip_trailing_stops(F.col("ORF_seq")).alias("seq"))
    sinks.write_fasta(kept, out, order=["idx"])
    return isoforms.agg(F.count_if(ok).alias("written"), F.count_if(~ok).alias("skipped"))


def extract_modified(spark: SparkSession, table: str, out: str) -> None:
    """Bare peptides of a table with modified sequences, one per line."""
    rows = src.read_modified_peptides(spark, table)
    bare = rows.select(tx.peptide_from_modified(F.col("sequence")).alias("peptide"))
    sinks.write_lines(bare.filter(F.length("peptide") > 0), "peptide", out)


def extract_token_lists(spark: SparkSession, table: str, out: str) -> None:
    """Bare peptides of a table with token lists, one per line."""
    rows = src.read_predictions(spark, table)
    bare = rows.select(tx.tokens_to_sequence(F.col(src.PREDICTION)).alias("peptide"))
    sinks.write_lines(bare.filter(F.length("peptide") > 0), "peptide", out)


def filter_by_length(spark: SparkSession, lines: str, out: str) -> None:
    """Distinct lines of more than seven letters in sorted order."""
    kept = ls.length_filter_distinct(src.read_raw_lines(spark, lines))
    sinks.write_lines(kept.orderBy("value"), "value", out)


def prediction_quality(spark: SparkSession, predictions: str, reference: str, outdir: str) -> DataFrame:
    """Box statistics and drawn points, matched against unmatched predictions.

    Returns the annotation summary; fails when no prediction is in the
    reference, showing sample keys of both sides.
    """
    lookup = ql.match_lookup(src.read_peptide_reference(spark, reference))
    table = src.read_predictions(spark, predictions, metrics=True)
    table = table.withColumn("row", F.monotonically_increasing_id())
    annotated = materialize(ql.annotate_predictions(table, lookup, src.PREDICTION))
    summary = ql.annotation_summary(annotated)
    if not summary.first().n_found:
        keys = [r.key for r in annotated.select("key").limit(5).collect()]
        known = [r.key for r in lookup.select("key").limit(5).collect()]
        raise ValueError(f"no prediction is in the reference; predicted keys {keys}, reference keys {known}")
    values = ql.metric_values(annotated, [src.LOG_PROBABILITY, src.MASS_ERROR], "row")
    Path(outdir).mkdir(parents=True, exist_ok=True)
    sinks.write_small_tsv(ql.box_stats(values), f"{outdir}/box_stats.tsv")
    sinks.write_small_tsv(ql.sampled_points(values, "row"), f"{outdir}/points.tsv")
    return summary
