"""The operators as queries over the analytics tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.functions import text as tx
from seqloom.operators import dedup as dd
from seqloom.operators import hits as ht
from seqloom.operators import kmers as km
from seqloom.operators import lists as ls
from seqloom.operators import matching as mt
from seqloom.operators import ordinals as od
from seqloom.operators import quality as ql
from seqloom.session import materialize
from seqloom.sources import files as src
from seqloom.sources import tables as tb

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


# ---- k-mers ---------------------------------------------------------------

def _document_piles(spark, sf_dir, ks, *labels, reference=False, skip_ambiguous=True):
    sequences = km.keyed_sequences(tb.document_records(spark, sf_dir))
    ref = km.record_stream(tb.reference_records(spark, sf_dir)) if reference else None
    return km.counted_piles(sequences, ks, *labels, reference=ref, skip_ambiguous=skip_ambiguous)


def _turn_piles(spark, sf_dir, ks, *labels, reference=False):
    sequences = km.keyed_sequences(tb.turn_records(spark, sf_dir, own_ids=True))
    ref = km.record_stream(tb.reference_records(spark, sf_dir)) if reference else None
    return km.counted_piles(sequences, ks, *labels, reference=ref)


def _turn_windows(spark, sf_dir, ks, reference=False):
    sequences = km.keyed_sequences(tb.turn_records(spark, sf_dir, own_ids=True))
    ref = km.record_stream(tb.reference_records(spark, sf_dir)) if reference else None
    return km.tagged_windows(sequences, ks, ref)


@query
def kmer_category_counts_k9(spark, sf_dir):
    return km.category_summary(_document_piles(spark, sf_dir, [9], "short", "long", reference=True))


@query
def kmer_category_count_table_k9(spark, sf_dir):
    return km.category_count_table(_turn_piles(spark, sf_dir, [9], "short", "long", reference=True))


@query
def kmer_pile_summary(spark, sf_dir):
    return km.pile_summary(_document_piles(spark, sf_dir, [8, 9, 10, 11]), "file1", "file2")


@query
def kmer_unique_per_source(spark, sf_dir):
    return km.unique_kmers(_turn_piles(spark, sf_dir, [8, 9]), "file1", "file2")


@query
def kmer_pile_summary_keep_ambiguous(spark, sf_dir):
    return km.pile_summary(_document_piles(spark, sf_dir, [9], skip_ambiguous=False), "file1", "file2")


@query
def kmer_piles_k9(spark, sf_dir):
    table = km.pile_table(_turn_windows(spark, sf_dir, [9]), "short", "long")
    return km.sort_piles(table, "short", "long").drop("k")


@query
def kmer_postings_k9(spark, sf_dir):
    return _turn_windows(spark, sf_dir, [9]).select("kmer", "side", "id")


@query
def kmer_ref_annotate_k9(spark, sf_dir):
    piles = km.pile_counts_by_kmer(_turn_windows(spark, sf_dir, [9]), "short", "long").drop("k")
    reference = km.windows(km.record_stream(tb.reference_records(spark, sf_dir)), [9])
    return km.annotate(piles, km.reference_index(reference))


@query
def kmer_ref_proteins_k9(spark, sf_dir):
    tagged = _turn_windows(spark, sf_dir, [9], reference=True)
    return km.pile_table(tagged, "short", "long", reference=True).drop("k")


@query
def kmer_parse_metrics(spark, sf_dir):
    sequences = km.keyed_sequences(tb.document_records(spark, sf_dir))
    return km.parse_metrics(sequences, 9)


@query
def sequence_load_metrics(spark, sf_dir):
    return km.load_metrics(tb.turn_records(spark, sf_dir))


@query
def shared_ids(spark, sf_dir):
    sequences = km.record_stream(tb.turn_records(spark, sf_dir))
    return km.shared_ids(sequences.filter("side = 1"), sequences.filter("side = 2"))


# ---- peptide lists --------------------------------------------------------

def _db(spark, sf_dir):
    return tb.document_words(spark, sf_dir, F.concat(F.lit("docs_"), F.col("lang")))


def _denovo(spark, sf_dir):
    return tb.turn_words(spark, sf_dir, F.concat(F.lit("turns_"), F.col("role")))


def _labels(spark, sf_dir, turns=True):
    """Labels of the lists, one per input file, from the columns that name them."""
    langs = tb.load(spark, sf_dir, "documents").select(F.concat(F.lit("docs_"), F.col("lang")).alias("label"))
    roles = tb.load(spark, sf_dir, "conversations").select(F.concat(F.lit("turns_"), F.col("role")).alias("label"))
    found = (langs.unionByName(roles) if turns else langs).filter("label is not null").distinct()
    return sorted(r.label for r in found.collect())


@query
def li_exact_overlap(spark, sf_dir):
    return ls.exact_pairs(_db(spark, sf_dir), _denovo(spark, sf_dir))


@query
def li_substring_first_match(spark, sf_dir):
    denovo = _denovo(spark, sf_dir)
    pairs = ls.substring_pairs(denovo, ls.substring_containers(_db(spark, sf_dir), denovo))
    place = [F.get("idx", F.lit(i)).alias(name) for i, name in enumerate(("conv_id", "turn", "pos"))]
    return pairs.select("db_file", "denovo_file", *place, "denovo_original", "db_containing_peptide")


@query
def overlap_summary(spark, sf_dir):
    db, denovo = _db(spark, sf_dir), _denovo(spark, sf_dir)
    return ls.overlap_summary(db, denovo, ls.substring_containers(db, denovo))


@query
def venn_counts(spark, sf_dir):
    lists = _db(spark, sf_dir).unionByName(_denovo(spark, sf_dir))
    return ls.sort_venn(ls.venn_counts(lists, _labels(spark, sf_dir)))


@query
def shared_norms(spark, sf_dir):
    lists = _db(spark, sf_dir)
    return ls.shared_norms(lists, _labels(spark, sf_dir, turns=False))


@query
def all_files_overlap(spark, sf_dir):
    lists = _db(spark, sf_dir)
    rows = ls.all_files_originals(lists, ls.shared_norms(lists, _labels(spark, sf_dir, turns=False)))
    place = [F.get("idx", F.lit(i)).alias(name) for i, name in enumerate(("doc_id", "pos"))]
    return rows.select(F.col("norm").alias("normalized_sequence"), "label", *place, "peptide")


@query
def length_filter_distinct(spark, sf_dir):
    docs = tb.spread(tb.load(spark, sf_dir, "documents").select("text"))
    return ls.length_filter_distinct(docs.select(F.explode(F.split("text", "\n")).alias("value")))


@query
def list_to_fasta(spark, sf_dir):
    words = tb.document_words(spark, sf_dir).select("idx", "peptide")
    named = od.with_peptide_ids(words, "tool", ["idx"])
    return named.select("ordinal", tx.fasta_record(F.col("id"), F.col("peptide")).alias("record"))


# ---- peptides in proteins -------------------------------------------------

def _matches(spark, sf_dir):
    peptides = tb.flipped_items(spark, sf_dir)
    proteins = materialize(mt.protein_index(tb.document_records(spark, sf_dir)))  # read for seeds and to verify
    return peptides, proteins, mt.protein_matches(peptides, proteins)


@query
def exact_li_match(spark, sf_dir):
    peptides, _, matches = _matches(spark, sf_dir)
    return mt.match_table(peptides, matches)


@query
def matched_fraction(spark, sf_dir):
    peptides, _, matches = _matches(spark, sf_dir)
    return mt.matched_fraction(peptides, matches)


@query
def ungapped_li_hits(spark, sf_dir):
    hits = mt.ungapped_hits(*_matches(spark, sf_dir))
    return hits.select("query_id", "subject_id", F.col("position").cast("bigint").alias("position"),
                       F.col("length").cast("bigint").alias("length"),
                       F.col("mismatch").cast("bigint").alias("mismatch"), "pident", "qseq", "sseq")


# ---- de-duplication -------------------------------------------------------

def _dedup(spark, sf_dir):
    return dd.Dedup(tb.document_records(spark, sf_dir).select("rec_idx", "id", "seq"))


@query
def dedup_identical(spark, sf_dir):
    return _dedup(spark, sf_dir).identical().select("representative_id", "related_id", "relationship")


@query
def dedup_substring(spark, sf_dir):
    return _dedup(spark, sf_dir).substrings().select("representative_id", "related_id", "relationship")


@query
def dedup_provenance(spark, sf_dir):
    return dd.sort_provenance(_dedup(spark, sf_dir).provenance())


@query
def dedup_kept(spark, sf_dir):
    return _dedup(spark, sf_dir).kept()


@query
def dedup_summary(spark, sf_dir):
    return _dedup(spark, sf_dir).summary()


@query
def fasta_wrap60(spark, sf_dir):
    records = tb.document_records(spark, sf_dir)
    return records.select("rec_idx", tx.fasta_record(F.col("id"), F.col("seq"), tx.FASTA_WIDTH).alias("record"))


# ---- record parsing -------------------------------------------------------

def _raw_records(spark, sf_dir):
    """(doc_id, pos, value): texts cut at header marks, as the reader does."""
    return tb.fasta_texts(spark, sf_dir).select("doc_id", F.posexplode(F.split("text", "\n>")).alias("pos", "value"))


@query
def fasta_records(spark, sf_dir):
    return _raw_records(spark, sf_dir).select("doc_id", "pos", *src.fasta_fields(F.col("value")))


@query
def fasta_keyed(spark, sf_dir):
    parsed = _raw_records(spark, sf_dir).select(F.array("doc_id", F.col("pos").cast("bigint")).alias("rec_idx"), *src.fasta_fields(F.col("value")))
    return km.keyed_sequences(parsed).select("id", "seq", "n_records")


@query
def fasta_ordered(spark, sf_dir):
    name, seq = src.fasta_fields(F.col("value"), inner_spaces=True)
    return _raw_records(spark, sf_dir).select("doc_id", "pos", name, F.upper(seq).alias("seq"))


@query
def peptide_lines(spark, sf_dir):
    lines = tb.fasta_texts(spark, sf_dir).select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    return src.peptide_lines(lines, "line").select("doc_id", "pos", "peptide")


@query
def typed_pile_cells(spark, sf_dir):
    return src.typed_piles(tb.pile_cells(spark, sf_dir), keep=("event_id",))


# ---- text projections -----------------------------------------------------

@query
def strip_mods(spark, sf_dir):
    e = tb.modified_sequences(spark, sf_dir)
    return (e.select("event_id", tx.peptide_from_modified(F.col("sequence")).alias("peptide"))
            .filter(F.length("peptide") > 0))


@query
def token_list_to_sequence(spark, sf_dir):
    p = tb.predictions(spark, sf_dir)
    return p.select("event_id", tx.tokens_to_sequence(F.col("instanovoplus_predictions")).alias("peptide")).filter(
        F.length("peptide") > 0)


@query
def prediction_key(spark, sf_dir):
    p = tb.predictions(spark, sf_dir).select("event_id", tx.prediction_key(F.col("instanovoplus_predictions")).alias("key"))
    m = tb.modified_sequences(spark, sf_dir).select(
        (-F.col("event_id")).alias("event_id"), tx.prediction_key(F.col("sequence")).alias("key"))
    return p.unionByName(m)


@query
def qc_to_fasta(spark, sf_dir):
    kept = tb.isoforms(spark, sf_dir).filter(mt.has_protein(F.col("ORF_seq")))
    return kept.select("conv_id", "turn", tx.fasta_record(F.col("isoform"), tx.strip_trailing_stops(F.col("ORF_seq"))).alias("record"))


@query
def qc_counts(spark, sf_dir):
    ok = mt.has_protein(F.col("ORF_seq"))
    return tb.isoforms(spark, sf_dir).agg(F.count_if(ok).alias("written"), F.count_if(~ok).alias("skipped"))


# ---- alignment hits -------------------------------------------------------

@query
def blast_filter(spark, sf_dir):
    kept = ht.filter_hits(tb.alignment_hits(spark, sf_dir), "tool", min_pident=85.0)
    return kept.withColumn("mismatch", F.col("mismatch").cast("bigint"))


@query
def blast_summary(spark, sf_dir):
    kept = ht.filter_hits(tb.alignment_hits(spark, sf_dir), "tool", min_pident=85.0)
    return ht.subject_counts(ht.hit_subjects(kept), "tool")


@query
def blast_subjects(spark, sf_dir):
    return ht.hit_subjects(ht.filter_hits(tb.alignment_hits(spark, sf_dir), "tool", min_pident=85.0))


@query
def blast_funnel(spark, sf_dir):
    return ht.hit_funnel(tb.alignment_hits(spark, sf_dir))


# ---- prediction quality ---------------------------------------------------

METRICS = ["instanovoplus_prediction_log_probability", "delta_mass_ppm"]


def _annotated(spark, sf_dir):
    lookup = ql.match_lookup(tb.prediction_reference(spark, sf_dir))
    return ql.annotate_predictions(tb.predictions(spark, sf_dir), lookup)


@query
def match_lookup(spark, sf_dir):
    return _annotated(spark, sf_dir).select("event_id", "key", "match_status")


@query
def annotation_summary(spark, sf_dir):
    return ql.annotation_summary(_annotated(spark, sf_dir))


@query
def box_stats(spark, sf_dir):
    stats = ql.box_stats(ql.metric_values(_annotated(spark, sf_dir), METRICS))
    rounded = [F.round(c, 6).alias(c) for c in ("q1", "median", "q3", "whisker_low", "whisker_high")]
    return stats.select("metric", "status", "n", *rounded)


@query
def sampled_points(spark, sf_dir):
    return ql.sampled_points(ql.metric_values(_annotated(spark, sf_dir), METRICS, "event_id"), "event_id")
