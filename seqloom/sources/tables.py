"""The analytics tables as the inputs the operators expect.

Every binding covers whole tables and whole texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.session import spread

# Words of a text as peptides, short ones as well.
WORD = "[A-Za-z]+"


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def residues(c: Column) -> Column:
    """Letters of a text as a sequence."""
    return F.upper(F.regexp_replace(c, "[^A-Za-z]+", ""))


def document_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(rec_idx, id, side, seq): documents as FASTA records of two files."""
    docs = load(spark, sf_dir, "documents").select("doc_id", "source", "text")
    side = F.when(F.col("source").isin("src0", "src1"), 1).otherwise(2)
    return spread(docs).select(F.col("doc_id").alias("rec_idx"), F.col("doc_id").cast("string").alias("id"),
                               side.alias("side"), residues(F.col("text")).alias("seq"))


def reference_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(rec_idx, id, seq): benchmark items as the reference proteome."""
    items = load(spark, sf_dir, "benchmark")
    return items.select(F.col("item_id").alias("rec_idx"), F.col("item_id").cast("string").alias("id"),
                        residues(F.col("text")).alias("seq"))


def turn_records(spark: SparkSession, sf_dir: str, own_ids: bool = False) -> DataFrame:
    """(rec_idx, id, side, seq): turns as records of one file per role. The id
    is the conversation, so it repeats within a role and its last turn counts;
    with ``own_ids`` every turn has an id of its own. Positions are [conv_id, turn]."""
    ident = F.concat_ws(".", "conv_id", "turn") if own_ids else F.col("conv_id").cast("string")
    turns = load(spark, sf_dir, "conversations")
    side = F.when(F.col("role") == "user", 1).otherwise(2)
    return spread(turns).select(F.array("conv_id", "turn").alias("rec_idx"),
                                ident.alias("id"), side.alias("side"),
                                residues(F.col("text")).alias("seq"))


def flipped_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(idx, peptide): benchmark items with I and L exchanged as peptides."""
    items = load(spark, sf_dir, "benchmark")
    return items.select(F.col("item_id").alias("idx"),
                        F.translate(residues(F.col("text")), "IL", "LI").alias("peptide"))


def _words(rows: DataFrame, label: Column, row: list[str], text: str) -> DataFrame:
    """(label, idx, peptide). ``idx`` is [row's key..., number of the word], which no two words share."""
    words = F.posexplode(F.regexp_extract_all(F.col(text), F.lit(WORD), 0))
    return (rows.select(label.alias("label"), *row, words)
            .select("label", F.array(*row, F.col("pos").cast("bigint")).alias("idx"), F.upper("col").alias("peptide")))


def document_words(spark: SparkSession, sf_dir: str, label: Column | None = None) -> DataFrame:
    """(label, idx, peptide): words of all documents, as one list or several."""
    docs = spread(load(spark, sf_dir, "documents").select("doc_id", "lang", "text"))
    return _words(docs, F.lit("documents") if label is None else label, ["doc_id"], "text")


def turn_words(spark: SparkSession, sf_dir: str, label: Column | None = None) -> DataFrame:
    """(label, idx, peptide): words of all turns with I and L exchanged.

    The exchange makes raw equality useless, so only the L/I rule finds them.
    """
    turns = spread(load(spark, sf_dir, "conversations"))
    words = _words(turns, F.lit("conversations") if label is None else label, ["conv_id", "turn"], "text")
    return words.withColumn("peptide", F.translate("peptide", "IL", "LI"))


def fasta_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, text): every document as the text of a FASTA file. Its header
    names the document; lines that begin with a to d are headers too."""
    docs = spread(load(spark, sf_dir, "documents").select("doc_id", "lang", "text"))
    head = F.concat(F.lit(">doc"), F.col("doc_id").cast("string"), F.lit(" "), F.coalesce("lang", F.lit("")), F.lit("\n"))
    return docs.select("doc_id", F.concat(head, F.regexp_replace(F.coalesce("text", F.lit("")), "\n([A-Da-d])", "\n>$1")).alias("text"))


def pile_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(event_id, kmer, pile, short_count, long_count): events as rows of a pile
    table whose cells are text: whole, padded and decimal numbers, exponents,
    words and nothing."""
    e = spread(load(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value"))
    n = F.col("user_id").cast("string")
    kind = F.col("event_id") % 6
    short = (F.when(kind == 0, n).when(kind == 1, F.concat(F.lit(" "), n, F.lit(" "))).when(kind == 2, F.concat(n, F.lit(".0")))
             .when(kind == 3, F.concat(n, F.lit("e1"))).when(kind == 4, F.lit("NA")))
    long = F.when(kind == 5, F.lit("")).otherwise(F.concat(F.lit("-"), n, F.lit(".75")))
    pile = F.when(kind == 4, F.lit(None).cast("string")).otherwise(F.lit("shared"))
    return e.select("event_id", F.upper("event_type").alias("kmer"), pile.alias("pile"), short.alias("short_count"), long.alias("long_count"))


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(event_id, prediction, metrics): events as token-list predictions.

    Tokens are the letters of the event type, the first one modified; values
    of 0.5 and less are missing.
    """
    e = spread(load(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value"))
    letters = F.split(F.upper("event_type"), "")
    tokens = F.concat(F.lit("['"), F.element_at(letters, 1), F.lit("[UNIMOD:4]"),
                      F.concat(F.lit("', '"), F.array_join(F.slice(letters, F.lit(2), F.size(letters)), "', '")), F.lit("']"))
    value = F.when(F.col("value") > 0.5, F.col("value"))
    return e.select("event_id", "user_id", tokens.alias("instanovoplus_predictions"),
                    value.alias("instanovoplus_prediction_log_probability"),
                    (F.col("user_id") - F.col("value")).alias("delta_mass_ppm"))


def prediction_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(idx, peptide, n_proteins): per event type the events of even users.

    Types are padded and in lower case; "view" is absent.
    """
    e = load(spark, sf_dir, "events")
    n = F.count_if((F.col("user_id") % 2 == 0) & F.col("event_type").isin("click", "purchase"))
    return (e.filter(F.col("event_type") != "view").groupBy("event_type").agg(n.cast("int").alias("n_proteins"))
            .select(F.xxhash64("event_type").alias("idx"), F.concat(F.lit(" "), "event_type", F.lit(" ")).alias("peptide"),
                    "n_proteins"))


def alignment_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alignment rows: each distinct word of the turns against a variation of
    itself (same, I to L, A to T, last letter lost), chosen by its length. A
    single letter that would be lost gives no row."""
    turns = spread(load(spark, sf_dir, "conversations"))
    word = F.explode(F.regexp_extract_all("text", F.lit(WORD), 0)).alias("w")
    words = turns.select(F.upper(F.col("role")).alias("role"), word).select("role", F.upper("w").alias("qseq")).distinct()
    kind = (F.length("qseq") + F.ascii("qseq")) % 4
    sseq = (F.when(kind == 0, F.col("qseq")).when(kind == 1, F.translate("qseq", "I", "L"))
            .when(kind == 2, F.translate("qseq", "A", "T")).otherwise(F.expr("left(qseq, length(qseq) - 1)")))
    rows = words.withColumn("sseq", sseq).where("sseq != ''").withColumn("length", F.length("sseq"))
    at = F.sequence(F.lit(1), F.col("length"))
    differ = F.size(F.filter(at, lambda i: F.substring("qseq", i, F.lit(1)) != F.substring("sseq", i, F.lit(1))))
    rows = rows.withColumn("mismatch", F.when(F.length("qseq") == F.col("length"), differ).otherwise(0))
    return rows.select(F.col("qseq").alias("query_id"), F.concat_ws("_", "role", "sseq").alias("subject_id"),
                       (100.0 * (F.col("length") - F.col("mismatch")) / F.col("length")).alias("pident"),
                       "length", "mismatch", "qseq", "sseq", F.lit(0.001).alias("evalue"), F.lit(30.0).alias("bitscore"))


def modified_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(event_id, sequence): event types with their properties as modifications."""
    e = load(spark, sf_dir, "events").select("event_id", "event_type", "props")
    name = F.upper("event_type")
    sequence = F.concat(F.lit(" "), F.expr("left(upper(event_type), 1)"), F.lit("["), "props", F.lit("]"),
                        F.expr("substring(upper(event_type), 2)"), F.lit("[UNIMOD:"), F.col("event_id").cast("string"),
                        F.lit("]"))
    return e.select("event_id", F.when(name == "ERROR", F.lit("[only a tag]")).otherwise(sequence).alias("sequence"))


def isoforms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(conv_id, turn, isoform, ORF_seq): turns as isoforms; a fifth lacks a
    sequence, the others end in none to two stop marks."""
    turns = load(spark, sf_dir, "conversations")
    seq = residues(F.col("text"))
    orf = F.when(F.length(seq) % 5 == 0, F.lit("NA")).otherwise(
        F.concat(seq, F.expr("repeat('*', cast(turn % 3 as int))")))
    return turns.select("conv_id", "turn", F.concat_ws(".", "conv_id", "turn").alias("isoform"), orf.alias("ORF_seq"))
