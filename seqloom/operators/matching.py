"""Peptides in proteins, exact up to leucine/isoleucine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqloom.functions import text as tx
from seqloom.operators.containment import containing_pairs
from seqloom.operators.latest import keep_one


def protein_index(records: DataFrame) -> DataFrame:
    """One row per id: last sequence, normalized form, first position.

    Stop marks and empty sequences are kept here.
    """
    kept = keep_one(records.select("id", "seq", "rec_idx"), ["id"], "rec_idx", last=True)
    return (kept.select("id", F.upper("seq").alias("seq"), F.col("first").alias("rec_idx"))
            .withColumn("norm", F.translate("seq", "I", "L")))


def protein_matches(peptides: DataFrame, proteins: DataFrame) -> DataFrame:
    """(norm, id, rec_idx): proteins holding each distinct normalized peptide."""
    wanted = peptides.select(tx.fold_li_upper(F.col("peptide")).alias("norm")).distinct()
    texts = proteins.select("id", "rec_idx", F.col("norm").alias("body"))
    return containing_pairs(wanted, "norm", "norm", texts, "body", "id", carry=["rec_idx"])


def match_counts(peptides: DataFrame, matches: DataFrame) -> DataFrame:
    """(idx, peptide, n_proteins): one row per input peptide, repeats included."""
    totals = matches.groupBy("norm").agg(F.count("*").alias("n_proteins"))
    return (peptides.withColumn("norm", tx.fold_li_upper(F.col("peptide"))).join(totals, "norm", "left")
            .select("idx", "peptide", F.coalesce("n_proteins", F.lit(0).cast("bigint")).alias("n_proteins")))


def match_table(peptides: DataFrame, matches: DataFrame) -> DataFrame:
    """(idx, peptide, n_proteins, protein_ids): one row per input peptide, repeats
    included. Ids follow the order of the protein records."""
    cells = matches.groupBy("norm").agg(F.count("*").alias("n_proteins"),
                                        tx.ordered_cell(F.col("rec_idx"), F.col("id")).alias("protein_ids"))
    return (peptides.withColumn("norm", tx.fold_li_upper(F.col("peptide"))).join(cells, "norm", "left")
            .select("idx", "peptide", F.coalesce("n_proteins", F.lit(0).cast("bigint")).alias("n_proteins"),
                    F.coalesce("protein_ids", F.lit(tx.NO_MATCH)).alias("protein_ids")))


def match_rows(peptides: DataFrame, matches: DataFrame) -> DataFrame:
    """(idx, peptide, protein_id, rec_idx): one row per input peptide and protein
    that holds it; a peptide without any has one row with ``NO_MATCH``."""
    return (peptides.withColumn("norm", tx.fold_li_upper(F.col("peptide"))).join(matches, "norm", "left")
            .select("idx", "peptide", F.coalesce("id", F.lit(tx.NO_MATCH)).alias("protein_id"), "rec_idx"))


def matched_fraction(peptides: DataFrame, matches: DataFrame) -> DataFrame:
    """Peptides, matched peptides and their share, without building cells."""
    hit = matches.select("norm").distinct().withColumn("hit", F.lit(True))
    marked = peptides.select(tx.fold_li_upper(F.col("peptide")).alias("norm")).join(hit, "norm", "left")
    n, m = F.count("*"), F.count("hit")
    return marked.agg(n.alias("n_peptides"), m.alias("n_matched"), tx.percent(m, n).alias("pct"))


def ungapped_hits(peptides: DataFrame, proteins: DataFrame, matches: DataFrame) -> DataFrame:
    """Alignment rows of the full-length, ungapped, L/I-equal hits.

    Every position where a peptide fits is one row in the layout of the
    alignment table. These are the rows of that kind a similarity search could
    pass through the hit filters; it has no scores and no partial or gapped
    alignments, and is not a similarity search.
    """
    query = (peptides.select(F.upper("peptide").alias("qseq")).distinct()
             .withColumn("norm", F.translate("qseq", "I", "L")))
    located = (query.join(matches.select("norm", "id"), "norm")
               .join(proteins.select("id", F.col("seq").cast("binary").alias("seq"),
                                     F.col("norm").cast("binary").alias("body")), "id"))
    # Folding I to L keeps every byte position; binary slices cost O(length).
    size = F.octet_length("norm")
    starts = F.filter(F.sequence(F.lit(1), F.octet_length("body") - size + 1),
                      lambda i: F.substring("body", i, size) == F.col("norm").cast("binary"))
    sseq = F.substring("seq", F.col("position"), size).cast("string")
    rows = (located.select("id", "qseq", "norm", "seq", F.explode(starts).alias("position"))
            .select(F.col("qseq").alias("query_id"), F.col("id").alias("subject_id"), "position",
                    F.length("norm").alias("length"), "qseq", sseq.alias("sseq")))
    letters = F.sequence(F.lit(1), F.col("length"))
    differ = F.filter(letters, lambda i: F.substring("qseq", i, F.lit(1)) != F.substring("sseq", i, F.lit(1)))
    return (rows.withColumn("mismatch", F.size(differ))
            .withColumn("pident", 100.0 * (F.col("length") - F.col("mismatch")) / F.col("length")))


def has_protein(orf: Column) -> Column:
    """An isoform with a sequence; tested before stop marks are removed."""
    return (orf != "") & (orf != tx.NOT_AVAILABLE)
