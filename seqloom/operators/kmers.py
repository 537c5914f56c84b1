"""k-mer piles, reference membership and their summaries.

Everything that compares k-mers of several sources is one aggregation over the
tagged union of their windows: a single shuffle, pre-aggregated by the map
side, whatever the number of sources. Only counts travel through it unless the
ids are asked for.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqloom.functions import packed as pk
from seqloom.functions import text as tx
from seqloom.functions import windows as win
from seqloom.operators.latest import keep_one
from seqloom.session import materialize

# Category order of the summary and of the count table.
CATEGORY_ORDER = [
    "shared|in_reference",
    "shared|novel",
    "only_short|in_reference",
    "only_short|novel",
    "only_long|in_reference",
    "only_long|novel",
]
COUNT_TABLE_ORDER = [
    "only_long_in_reference",
    "only_long_novel",
    "only_short_in_reference",
    "only_short_novel",
    "shared_in_reference",
    "shared_novel",
]

FILE1, FILE2, REFERENCE = 1, 2, 0


def record_stream(records: DataFrame) -> DataFrame:
    """Cleaned, non-empty records; ids may repeat."""
    return (records.withColumn("seq", tx.clean_residues(F.col("seq")))
            .filter(F.col("seq") != ""))


def keyed_sequences(records: DataFrame) -> DataFrame:
    """One cleaned sequence per id (and ``side``): its last non-empty one.

    ``rec_idx`` is the position where the id appeared first.
    """
    keys = [c for c in ("side", "id") if c in records.columns]
    kept = keep_one(record_stream(records).select(*keys, "rec_idx", "seq"), keys, "rec_idx", last=True)
    return kept.select(*keys, "seq", F.col("first").alias("rec_idx"), F.col("n").alias("n_records"))


def shared_ids(first: DataFrame, second: DataFrame) -> DataFrame:
    """Ids present in both sources; they cannot be told apart in the output."""
    return first.select("id").intersect(second.select("id"))


def windows(sequences: DataFrame, ks: Sequence[int], skip_ambiguous: bool = True) -> DataFrame:
    """(k, kmer, id[, side]): the distinct windows of every row for all ``ks``."""
    for k in ks:
        if k < 1:
            raise ValueError(f"k must be >= 1, got {k}")
    carry = [c for c in ("id", "side") if c in sequences.columns]
    rows = sequences.select("seq", *carry)
    if len(ks) == 1:
        k, rows = ks[0], rows.withColumn("k", F.lit(ks[0]))
    else:
        k, rows = F.col("k"), rows.withColumn("k", F.explode(F.array(*map(F.lit, ks))))
    kmer = F.explode(win.distinct_kmers(F.col("seq"), k, skip_ambiguous)).alias("kmer")
    return rows.select("k", kmer, *carry)


def tagged_windows(sequences: DataFrame, ks: Sequence[int], reference: DataFrame | None = None,
                   skip_ambiguous: bool = True) -> DataFrame:
    """Windows of sided sequences, and of a reference as side 0."""
    out = windows(sequences, ks, skip_ambiguous)
    if reference is not None:
        other = windows(reference.select("id", "seq"), ks, skip_ambiguous)
        out = out.unionByName(other.withColumn("side", F.lit(REFERENCE)))
    return out


def _piles(tagged: DataFrame, label1: str, label2: str, reference: bool, cells: Sequence[Column] = ()) -> DataFrame:
    """Counts per k-mer. Its length tells k, so k is not shuffled."""
    if label1 == label2:
        raise ValueError("the two labels must be different")
    on1, on2 = F.col("side") == FILE1, F.col("side") == FILE2
    seen = [F.bool_or(F.col("side") == REFERENCE).alias("ref_match")] if reference else []
    return (tagged.groupBy("kmer")
            .agg(F.count_if(on1).alias("n1"), F.count_if(on2).alias("n2"), *seen, *cells)
            .withColumn("k", F.length("kmer")))


def pile_counts_by_kmer(tagged: DataFrame, label1: str = "file1", label2: str = "file2",
                        reference: bool = False) -> DataFrame:
    """Pile and counts of each k-mer, without its ids.

    With ``reference`` the windows of side 0 decide ``ref_match`` and the
    category in the same aggregation; k-mers only they have are dropped.
    """
    n1, n2 = F.col("n1"), F.col("n2")
    out = (_piles(tagged, label1, label2, reference)
           .filter((n1 > 0) | (n2 > 0))
           .withColumn("pile", tx.pile_label(n1, n2, label1, label2)))
    columns = ["k", "kmer", "pile", n1.alias(f"{label1}_count"), n2.alias(f"{label2}_count")]
    if reference:
        columns += ["ref_match", tx.category(F.col("pile"), F.col("ref_match")).alias("category")]
    return out.select(*columns)


def counted_piles(sequences: DataFrame, ks: Sequence[int], label1: str = "file1", label2: str = "file2",
                  reference: DataFrame | None = None, skip_ambiguous: bool = True) -> DataFrame:
    """(k, pile[, ref_match, category], n_kmers): how many k-mers of sided sequences are in each pile.

    The same numbers as rows of ``pile_counts_by_kmer``, from integers in place
    of strings. Windows that do not fit into one go by their text.
    """
    if label1 == label2:
        raise ValueError("the two labels must be different")
    rows = sequences.select("seq", F.col("side").cast("int").alias("side"))
    if reference is not None:
        rows = rows.unionByName(reference.select("seq", F.lit(REFERENCE).alias("side")))
    rows = materialize(rows)
    fits = max(ks) <= pk.MOST
    texts = windows(rows.filter(F.col("seq").rlike(pk.FOREIGN)), ks, skip_ambiguous).filter(F.col("kmer").rlike(pk.FOREIGN)) if fits \
        else windows(rows, ks, skip_ambiguous)
    counts = (texts.groupBy("kmer").agg(F.bit_or(F.expr("shiftleft(1, side)")).alias("sides"))
              .groupBy(F.length("kmer").alias("k"), "sides").agg(F.count("*").alias("n")))
    if fits:
        counts = counts.unionByName(pk.count_by_sides(rows, list(ks), tx.AMBIGUOUS_CLASS.strip("[]") if skip_ambiguous else ""))
    has = lambda side: F.col("sides").bitwiseAND(1 << side)
    out = (counts.filter((has(FILE1) > 0) | (has(FILE2) > 0))
           .withColumn("pile", tx.pile_label(has(FILE1), has(FILE2), label1, label2)))
    columns = ["k", "pile"]
    if reference is not None:
        out = out.withColumn("ref_match", has(REFERENCE) > 0)
        out = out.withColumn("category", tx.category(F.col("pile"), F.col("ref_match")))
        columns += ["ref_match", "category"]
    return out.groupBy(*columns).agg(F.sum("n").alias("n_kmers"))


def _tally(piles: DataFrame, condition: Column | None = None) -> Column:
    """Number of k-mers, all or some, of rows that stand for one each or for ``n_kmers``."""
    weight = F.col("n_kmers") if "n_kmers" in piles.columns else F.lit(1).cast("bigint")
    return F.coalesce(F.sum(weight if condition is None else F.when(condition, weight)), F.lit(0).cast("bigint"))


def pile_table(tagged: DataFrame, label1: str = "file1", label2: str = "file2", reference: bool = False) -> DataFrame:
    """The pile table with the ids of both sources in joined, sorted cells.

    ``reference`` adds ``ref_match``, the ids of the reference and ``category``.
    """
    ids = lambda side: tx.sorted_cell(F.when(F.col("side") == side, F.col("id")))
    cells = [ids(FILE1).alias(f"{label1}_transcripts"), ids(FILE2).alias(f"{label2}_transcripts")]
    if reference:
        cells.append(ids(REFERENCE).alias("ref_proteins"))
    n1, n2 = F.col("n1"), F.col("n2")
    out = (_piles(tagged, label1, label2, reference, cells)
           .filter((n1 > 0) | (n2 > 0))
           .withColumn("pile", tx.pile_label(n1, n2, label1, label2)))
    columns = ["k", "kmer", "pile", f"{label1}_transcripts", f"{label2}_transcripts",
               n1.alias(f"{label1}_count"), n2.alias(f"{label2}_count")]
    if reference:
        columns += ["ref_match", "ref_proteins", tx.category(F.col("pile"), F.col("ref_match")).alias("category")]
    return out.select(*columns)


def pile_postings(tagged: DataFrame) -> DataFrame:
    """(kmer, cell, value): every id of a k-mer, once; cell 0 and 1 are the two
    sources, 2 is the reference. The long form of the joined id cells."""
    cell = F.when(F.col("side") == REFERENCE, 2).otherwise(F.col("side") - 1)
    return tagged.select("kmer", cell.cast("int").alias("cell"), F.col("id").alias("value"))


def reference_postings(piles: DataFrame, reference: DataFrame) -> DataFrame:
    """(kmer, pile, ref_protein): each id of the reference that has a k-mer of the piles, once."""
    held = reference.select("kmer", F.col("id").alias("ref_protein")).distinct()
    return piles.select("kmer", "pile").join(held, "kmer").select("kmer", "pile", "ref_protein")


def pile_rank(pile: Column, label1: str) -> Column:
    """Shared first, then the first source, then the second."""
    return F.when(pile == "shared", 0).when(pile == f"only_{label1}", 1).otherwise(2)


def sort_piles(piles: DataFrame, label1: str, label2: str) -> DataFrame:
    """Shared first, then the first source, then the second; k-mers ascending."""
    keys = [c for c in ("k",) if c in piles.columns] + [pile_rank(F.col("pile"), label1), F.col("kmer")]
    return piles.orderBy(*keys)


def reference_index(reference: DataFrame) -> DataFrame:
    """Distinct k-mers of a reference."""
    return reference.select("kmer").distinct()


def annotate(piles: DataFrame, index: DataFrame) -> DataFrame:
    """Add reference state and category to an existing pile table. Spark chooses the join by size."""
    joined = piles.join(index.withColumn("ref_match", F.lit(True)), "kmer", "left")
    out = joined.withColumn("ref_match", F.coalesce(F.col("ref_match"), F.lit(False)))
    return out.select(*piles.columns, "ref_match", tx.category(F.col("pile"), F.col("ref_match")).alias("category"))


def pile_summary(piles: DataFrame, label1: str, label2: str) -> DataFrame:
    """Rows per pile with percentage, all three piles present, and their total, per k."""
    n = lambda name: _tally(piles, F.col("pile") == name)
    names = ["shared", f"only_{label1}", f"only_{label2}"]
    counted = piles.groupBy("k").agg(_tally(piles).alias("total"),
                                     *(n(name).alias(f"n{i}") for i, name in enumerate(names)))
    named = [*((name, F.col(f"n{i}")) for i, name in enumerate(names)), ("TOTAL", F.col("total"))]
    rows = F.array(*(F.struct(F.lit(name).alias("pile"), n.alias("n")) for name, n in named))
    return (counted.select("k", "total", F.explode(rows).alias("r"))
            .select("k", "r.pile", "r.n", tx.percent(F.col("r.n"), F.col("total")).alias("pct")))


def category_summary(annotated: DataFrame) -> DataFrame:
    """The six categories in their fixed order, then total and novel rows.

    Categories of other labels are in the total only.
    """
    agg = annotated.agg(_tally(annotated).alias("total"),
                        _tally(annotated, ~F.col("ref_match")).alias("novel"),
                        *(_tally(annotated, F.col("category") == c).alias(f"n{i}") for i, c in enumerate(CATEGORY_ORDER)))
    named = [(c, F.col(f"n{i}")) for i, c in enumerate(CATEGORY_ORDER)]
    named += [("TOTAL", F.col("total")), ("NOVEL", F.col("novel"))]
    rows = F.array(*(F.struct(F.lit(i).alias("ord"), F.lit(c).alias("category"), n.alias("n"))
                     for i, (c, n) in enumerate(named)))
    return (agg.select("total", F.explode(rows).alias("r"))
            .select("r.ord", "r.category", "r.n", tx.percent(F.col("r.n"), F.col("total")).alias("pct")))


def category_count_table(annotated: DataFrame) -> DataFrame:
    """K-mers per category file; null stands for a category without a file."""
    safe = F.translate("category", "|", "_")
    agg = annotated.agg(*(_tally(annotated, safe == c).alias(f"n{i}") for i, c in enumerate(COUNT_TABLE_ORDER)))
    rows = F.array(*(F.struct(F.lit(c).alias("kmer_type"), F.nullif(F.col(f"n{i}"), F.lit(0)).alias("count"))
                     for i, c in enumerate(COUNT_TABLE_ORDER)))
    return agg.select(F.explode(rows).alias("r")).select("r.kmer_type", "r.count")


def parse_figures(k: int, suffix: str = "") -> list[Column]:
    """Loaded sequences, those too short and ambiguous window occurrences, to aggregate or to observe."""
    seq = F.col("seq")
    return [F.count("*").alias(f"n_sequences{suffix}"), F.count_if(F.length(seq) < k).alias(f"skipped_short{suffix}"),
            F.sum(win.window_count(seq, k) - win.clean_window_count(seq, k)).alias(f"skipped_ambiguous{suffix}")]


def parse_metrics(sequences: DataFrame, k: int) -> DataFrame:
    return sequences.agg(*parse_figures(k))


def load_figures() -> list[Column]:
    """Records read and empty ones."""
    return [F.count("*").alias("read"), F.count_if(tx.clean_residues(F.col("seq")) == "").alias("empty")]


def unique_kmers(piles: DataFrame, label1: str, label2: str) -> DataFrame:
    """Unique k-mers of each source, and of both, per k."""
    both, only = F.col("pile") == "shared", lambda label: F.col("pile") == f"only_{label}"
    return piles.groupBy("k").agg(_tally(piles, both | only(label1)).alias(f"{label1}_unique"),
                                  _tally(piles, both | only(label2)).alias(f"{label2}_unique"), _tally(piles, both).alias("in_both"))


def load_metrics(records: DataFrame) -> DataFrame:
    """Records read, empty ones, ids loaded and repeated ids."""
    kept = keyed_sequences(records).agg(F.count("*").alias("loaded"),
                                        (F.sum("n_records") - F.count("*")).alias("duplicates"),
                                        F.sum("n_records").alias("non_empty"))
    read = records.agg(F.count("*").alias("n_records"))
    return (read.join(F.broadcast(kept))  # one row each
            .select("n_records", (F.col("n_records") - F.coalesce("non_empty", F.lit(0))).alias("empty"),
                    "loaded", F.coalesce("duplicates", F.lit(0)).alias("duplicates")))
