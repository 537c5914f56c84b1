"""Readers: FASTA, line lists and delimited tables.

``rec_idx``/``idx`` is the position of a record in its input. It is ordered
but not dense: file number, then byte position of the split plus the row
within the task that reads it. Splits of a large file are read in parallel.
"""

from __future__ import annotations

import re
from pathlib import PurePosixPath

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seqloom.functions import text as tx

# Columns of the input formats.
HIT_SCHEMA = T.StructType([
    T.StructField("query_id", T.StringType()),
    T.StructField("subject_id", T.StringType()),
    T.StructField("pident", T.DoubleType()),
    T.StructField("length", T.IntegerType()),
    T.StructField("mismatch", T.IntegerType()),
    T.StructField("qseq", T.StringType()),
    T.StructField("sseq", T.StringType()),
    T.StructField("evalue", T.DoubleType()),
    T.StructField("bitscore", T.DoubleType()),
])
PREDICTION = "instanovoplus_predictions"
LOG_PROBABILITY = "instanovoplus_prediction_log_probability"
MASS_ERROR = "delta_mass_ppm"
K_IN_NAME = r"_k(\d+)"

_FILE_SHIFT = 1 << 44  # room for 16 TiB per file


def _position() -> Column:
    # A split that another one follows fills its task, so rows in front of it
    # cannot push its numbers past the start of the next split.
    row = F.monotonically_increasing_id() % F.lit(1 << 33)
    return F.col("_metadata.file_block_start") + row


def _input_files(spark: SparkSession, paths: list[str]) -> list[str]:
    """Files behind the paths, in the order given, by name inside a folder."""
    return list(dict.fromkeys(f for path in paths for f in sorted(spark.read.text(path).inputFiles())))


def _by_file(rows: DataFrame, files: list[str], position: str) -> DataFrame:
    """Put the file's number in front of a position, so that it is unique over all files."""
    if len(files) <= 1:
        return rows
    numbers = rows.sparkSession.createDataFrame(list(zip(files, range(len(files)))), "file string, number bigint")
    return (rows.join(F.broadcast(numbers), "file")  # one row per input file
            .withColumn(position, F.col("number") * _FILE_SHIFT + F.col(position)).drop("number"))


def _read_lines(spark: SparkSession, paths: str | list[str], line_sep: str = "\n") -> DataFrame:
    """(rec_idx, file, value): raw records in input order."""
    paths = [paths] if isinstance(paths, str) else list(paths)
    files = _input_files(spark, paths)
    # Row numbers are taken at the scan, before anything moves rows.
    raw = (spark.read.option("lineSep", line_sep).text(paths)
           .select("value", _position().alias("rec_idx"), F.input_file_name().alias("file")))
    return _by_file(raw, files, "rec_idx")


def _drop_preambles(raw: DataFrame) -> DataFrame:
    """Remove the text in front of the first header of a file."""
    first = F.min(F.struct("rec_idx", F.col("value").startswith(">").alias("marked"))).alias("first")
    # One row per input file.
    loose = raw.groupBy("file").agg(first).filter(~F.col("first.marked")).select("file", F.col("first.rec_idx").alias("rec_idx"))
    return raw.join(F.broadcast(loose), ["file", "rec_idx"], "left_anti")


def read_fasta(spark: SparkSession, paths: str | list[str], unnamed: bool = True,
               inner_spaces: bool = False) -> DataFrame:
    """(rec_idx, id, seq) of FASTA files; ids may repeat, sequences be empty.

    Records are split at header marks, so large files are read by many tasks.
    Text in front of the first header is ignored. A header without a name
    gives an empty id, or an error if not ``unnamed``. Spaces within sequence
    lines are dropped unless ``inner_spaces``.
    """
    paths = [paths] if isinstance(paths, str) else list(paths)
    raw = _drop_preambles(_read_lines(spark, paths, "\n>"))
    return raw.select("rec_idx", *fasta_fields(F.col("value"), unnamed, inner_spaces))


def fasta_fields(value: Column, unnamed: bool = True, inner_spaces: bool = False) -> tuple[Column, Column]:
    """Name and sequence of a record, a stretch of text between header marks."""
    # Only the first record of a file still has its mark.
    body = F.regexp_replace(F.regexp_replace(value, "\r\n?", "\n"), "^>", "")
    lines = F.split(body, "\n")
    name = F.split(tx.strip(lines[0]), r"\s+")[0]
    if not unnamed:
        name = F.when(name == "", F.raise_error(F.lit("FASTA header without a name")).cast("string")).otherwise(name)
    rows = F.transform(F.slice(lines, 2, F.size(lines)), lambda s: F.regexp_replace(s, r"\s+$", ""))
    seq = F.array_join(rows, "")
    return name.alias("id"), (seq if inner_spaces else F.replace(seq, F.lit(" "), F.lit(""))).alias("seq")


def read_ordered_fasta(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """FASTA as an ordered bag with upper-cased sequences."""
    return read_fasta(spark, paths, unnamed=False, inner_spaces=True).withColumn("seq", F.upper("seq"))


def read_peptides(spark: SparkSession, path: str, label: str | None = None) -> DataFrame:
    """(label, idx, peptide): stripped non-blank lines in order, case kept."""
    lines = _read_lines(spark, path).withColumnRenamed("rec_idx", "idx")
    return peptide_lines(lines, "value").select(F.lit(label or label_of(path)).alias("label"), "idx", "peptide")


def peptide_lines(lines: DataFrame, line: str) -> DataFrame:
    """Lines with ``peptide``, their stripped form; blank lines are left out."""
    return lines.withColumn("peptide", tx.strip(F.col(line))).filter(F.col("peptide") != "")


def read_peptide_lists(spark: SparkSession, paths: list[str]) -> tuple[DataFrame, list[str]]:
    """Several labelled lists in one frame, and the labels in order."""
    labels = [label_of(p) for p in paths]
    if len(set(labels)) != len(labels):
        raise ValueError(f"two input files share a label: {labels}")
    out = read_peptides(spark, paths[0], labels[0])
    for path, label in zip(paths[1:], labels[1:]):
        out = out.unionByName(read_peptides(spark, path, label))
    return out, labels


def read_raw_lines(spark: SparkSession, path: str) -> DataFrame:
    """(value): lines as they are."""
    return spark.read.text(path)


def label_of(path: str) -> str:
    """File name without directory and last suffix."""
    return PurePosixPath(path).stem


def k_of(path: str) -> int:
    """k from a name such as ``kmers_k9.tsv``."""
    found = re.search(K_IN_NAME, PurePosixPath(path).name)
    if not found:
        raise ValueError(f"cannot infer k from file name {path!r}; expected kmers_k<k>.tsv")
    return int(found.group(1))


def require_columns(df: DataFrame, columns: list[str], path: str) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"{path} lacks columns {missing}; found {df.columns}")
    return df


def read_table(spark: SparkSession, path: str, sep: str | None = None) -> DataFrame:
    """Delimited file with a header, all columns as text.

    The suffix decides the separator: .tsv and .txt are tab-separated. Text
    such as NA stays text.
    """
    if sep is None:
        sep = "\t" if PurePosixPath(path).suffix.lower() in (".tsv", ".txt") else ","
    return (spark.read.option("sep", sep).option("header", True).option("quote", '"').option("escape", '"')
            .option("multiLine", False).option("enforceSchema", False).csv(path))


def _read_ordered_table(spark: SparkSession, path: str, sep: str | None = None) -> DataFrame:
    """A table with ``idx``, the position of a row over all files of the path."""
    table = read_table(spark, path, sep).select("*", _position().alias("idx"), F.input_file_name().alias("file"))
    return _by_file(table, _input_files(spark, [path]), "idx").drop("file")


def read_modified_peptides(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated search result with a ``sequence`` column."""
    return require_columns(read_table(spark, path, "\t"), ["sequence"], path)


def read_predictions(spark: SparkSession, path: str, metrics: bool = False) -> DataFrame:
    """Predictions with token lists, with their metrics when asked for."""
    needed = [PREDICTION] + ([LOG_PROBABILITY, MASS_ERROR] if metrics else [])
    table = read_table(spark, path) if metrics else read_table(spark, path, ",")
    table = require_columns(table, needed, path)
    for name in needed[1:]:
        table = table.withColumn(name, F.col(name).try_cast("double"))
    return table


def read_peptide_reference(spark: SparkSession, path: str) -> DataFrame:
    """(idx, peptide, n_proteins) of a match table."""
    table = require_columns(_read_ordered_table(spark, path), ["peptide", "n_proteins"], path)
    return table.select("idx", "peptide", F.col("n_proteins").cast("int").alias("n_proteins"))


def read_isoforms(spark: SparkSession, path: str) -> DataFrame:
    """(idx, isoform, ORF_seq) of a tab-separated isoform report.

    A missing column reads as empty text.
    """
    table = _read_ordered_table(spark, path, "\t")
    cell = lambda c: F.coalesce(F.col(c), F.lit("")) if c in table.columns else F.lit("")
    return table.select("idx", tx.strip(cell("isoform")).alias("isoform"),
                        tx.strip(cell("ORF_seq")).alias("ORF_seq"))


def read_hits(spark: SparkSession, path: str) -> DataFrame:
    """Alignment hits: nine tab-separated columns without a header."""
    return spark.read.schema(HIT_SCHEMA).option("sep", "\t").csv(path)


def read_piles(spark: SparkSession, path: str) -> DataFrame:
    """Pile table; count columns as integers, unreadable ones 0."""
    return typed_piles(require_columns(read_table(spark, path, "\t"), ["kmer", "pile"], path))


def typed_piles(table: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Counts of a pile table as integers, other cells as text; columns of ``keep`` as they are."""
    cell = lambda c: tx.count_or_zero(F.col(c)) if c.endswith("_count") else F.coalesce(F.col(c), F.lit(""))
    return table.select(*[F.col(c) if c in keep else cell(c).alias(c) for c in table.columns])
