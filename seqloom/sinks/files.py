"""Writers. Large results become folders of part files, each written by the
task that holds its rows; only summaries of a bounded number of rows are
written as one file."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.functions import text as tx
from seqloom.operators.dedup import sort_provenance
from seqloom.operators.kmers import pile_rank
from seqloom.operators.lists import expand_pairs, sort_venn
from seqloom.sinks.cells import write_cells

# Comment lines of the all-files table.
ALL_FILES_COMMENTS = [
    "# Peptides (I/L-normalized) present in ALL input files",
    "# Original sequences from each file shown alongside",
]


def write_tsv(df: DataFrame, path: str) -> None:
    """Tab-separated part files with a header each."""
    _tsv(df).csv(path)


def _tsv(df: DataFrame):
    booleans = [c for c, t in df.dtypes if t == "boolean"]
    for c in booleans:
        df = df.withColumn(c, F.initcap(F.col(c).cast("string")))
    return (df.write.mode("overwrite").option("sep", "\t").option("header", True)
            .option("emptyValue", "").option("nullValue", "").option("escape", '"'))


def write_by_category(df: DataFrame, path: str) -> None:
    """One folder per observed category, ``|`` replaced in its name."""
    safe = df.withColumn("category_safe", F.translate("category", "|", "_"))
    _tsv(safe).partitionBy("category_safe").csv(path)


def write_fasta(df: DataFrame, path: str, width: int | None = None, order: list[str] = ("rec_idx",)) -> None:
    """FASTA part files of (id, seq) in order, wrapped when a width is given."""
    record = tx.fasta_record(F.col("id"), F.col("seq"), width).alias("value")
    sorted_rows = df.orderBy(*[c for c in order if c in df.columns])
    sorted_rows.select(record).write.mode("overwrite").text(path)


def write_lines(df: DataFrame, column: str, path: str) -> None:
    """One value per line."""
    df.select(F.col(column).alias("value")).write.mode("overwrite").text(path)


def write_provenance(edges: DataFrame, path: str) -> None:
    """De-duplication edges: identical ones first, then contained ones."""
    _tsv(sort_provenance(edges)).csv(path)


def _file_pairs(pairs: DataFrame) -> list[tuple[str, str, DataFrame]]:
    """The pairs of files that have rows, with their rows."""
    found = sorted(tuple(r) for r in pairs.select("db_file", "denovo_file").distinct().collect())  # one row per pair of input files
    return [(a, b, pairs.filter((F.col("db_file") == a) & (F.col("denovo_file") == b))) for a, b in found]


def write_exact_pairs(pairs: DataFrame, path: str) -> None:
    """The bag of exact pairs, one folder per pair of files with any, its labels in the header."""
    for a, b, own in _file_pairs(pairs):
        rows = expand_pairs(own).select(F.col("db_original").alias(f"{a}_original"), F.col("denovo_original").alias(f"{b}_original"), "il_normalized")
        _tsv(rows).csv(f"{path}/{a}__{b}.tsv")


def write_substring_pairs(pairs: DataFrame, path: str) -> None:
    """Substring pairs in list order, one folder per pair of files with any, its labels in the header."""
    for a, b, own in _file_pairs(pairs):
        rows = own.sort("idx").select(F.col("denovo_original").alias(f"{b}_denovo"), F.col("db_containing_peptide").alias(f"{a}_db_containing_peptide"))
        _tsv(rows).csv(f"{path}/{a}__{b}.tsv")


def write_piles(piles: DataFrame, postings: DataFrame, path: str, label1: str, label2: str) -> None:
    """Pile table of one k with the ids of both sources, in order of the piles."""
    ranked = piles.withColumn("rank", pile_rank(F.col("pile"), label1))
    values = postings.filter("cell < 2").join(ranked.select("kmer", "rank"), "kmer")
    write_cells(ranked, values, path, ["rank", "kmer"], ["kmer", "pile"], [f"{label1}_transcripts", f"{label2}_transcripts"],
                [f"{label1}_count", f"{label2}_count"])


def write_annotated(annotated: DataFrame, path: str, ref_proteins: DataFrame | None = None) -> None:
    """Annotated pile table; with ``ref_proteins`` (kmer, ref_protein) a cell of ids before the category."""
    if ref_proteins is None:
        write_tsv(annotated, path)
        return
    values = ref_proteins.select("kmer", F.lit(0).alias("cell"), F.col("ref_protein").alias("value"))
    before = [c for c in annotated.columns if c != "category"]
    write_cells(annotated, values, path, ["kmer"], before, ["ref_proteins"], ["category"])


def write_all_files(shared: DataFrame, originals: DataFrame, path: str, labels: list[str]) -> None:
    """Shared norms in sorted order with the originals of each file, repeats and order kept, below two comment lines."""
    cell = F.array_position(F.array(*map(F.lit, labels)), F.col("label")) - 1
    values = originals.select("norm", cell.alias("cell"), F.col("peptide").alias("value"), "idx")
    heads = shared.select("norm", F.col("norm").alias("normalized_sequence"))
    write_cells(heads, values, path, ["norm"], ["normalized_sequence"], labels, value_order=["idx"], comments=ALL_FILES_COMMENTS)


def write_matches(counts: DataFrame, rows: DataFrame, path: str) -> None:
    """Peptides in input order with the ids of their proteins in the order of the records."""
    values = rows.select("idx", F.lit(0).alias("cell"), F.col("protein_id").alias("value"), "rec_idx")
    write_cells(counts, values, path, ["idx"], ["peptide", "n_proteins"], ["protein_ids"], value_order=["rec_idx"])


def write_hit_summary(counts: DataFrame, subjects: DataFrame, path: str) -> None:
    """Query texts in sorted order with their subjects."""
    values = subjects.select("peptide", F.lit(0).alias("cell"), F.col("protein_id").alias("value"))
    write_cells(counts, values, path, ["peptide"], ["tool", "peptide", "n_proteins"], ["protein_ids"])


def write_small_tsv(df: DataFrame, path: str, max_rows: int = 100_000) -> None:
    """A summary as one file: a row per file, pair of files or category."""
    rows = df.limit(max_rows + 1).collect()
    if len(rows) > max_rows:
        raise ValueError(f"more than {max_rows} rows; use write_tsv")
    if "://" in path:  # not a path of this machine
        _tsv(df.coalesce(1)).csv(path)
        return
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    cells = lambda values: "\t".join("" if v is None else str(v) for v in values) + "\n"
    with open(path, "w") as out:
        out.write(cells(df.columns))
        out.writelines(cells(row) for row in rows)


def write_venn(counts: DataFrame, path: str) -> None:
    write_small_tsv(sort_venn(counts), path)
