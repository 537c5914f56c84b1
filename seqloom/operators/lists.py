"""Comparison of peptide lists, with leucine and isoleucine equal.

A list is a bag (label, idx, peptide) in file order. Lists are reduced to
distinct peptides with their multiplicity before any join, so a peptide that
makes up a third of a list is one row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.functions import text as tx
from seqloom.operators.containment import first_container
from seqloom.session import materialize


def normalized(peptides: DataFrame) -> DataFrame:
    """Add the case-preserving I->L form."""
    return peptides.withColumn("norm", tx.fold_li(F.col("peptide")))


def _multiplicity(peptides: DataFrame, label: str, original: str, n: str) -> DataFrame:
    return (normalized(peptides)
            .groupBy(F.col("label").alias(label), "norm", F.col("peptide").alias(original))
            .agg(F.count("*").alias(n)))


def exact_pairs(db: DataFrame, denovo: DataFrame) -> DataFrame:
    """Pairs of originals with equal norms, for every pair of files.

    The bag of pairs is given as distinct pairs and their multiplicity
    ``n_pairs`` (occurrences on one side times the other), which never grows
    with the product. :func:`expand_pairs` writes the bag out.
    """
    a = _multiplicity(db, "db_file", "db_original", "n_db")
    b = _multiplicity(denovo, "denovo_file", "denovo_original", "n_denovo")
    return (a.join(b, "norm")
            .select("db_file", "denovo_file", "db_original", "denovo_original",
                    F.col("norm").alias("il_normalized"),
                    (F.col("n_db") * F.col("n_denovo")).alias("n_pairs")))


# Rows of a pair that one step writes out.
_PAIRS_PER_STEP = 1 << 16


def expand_pairs(pairs: DataFrame) -> DataFrame:
    """One row per pair of occurrences.

    A pair is written out by steps of 65,536 rows, and so are its steps, so no
    array is longer; steps are dealt over the tasks, so a pair that makes up
    most of the output does not stay with one.
    """
    size = _PAIRS_PER_STEP
    exact = lambda n, d: F.expr(f"({n} + {d - 1}L) div {d}L")
    steps = pairs.withColumn("_outer", F.explode(F.sequence(F.lit(0).cast("bigint"), exact("n_pairs", size * size) - 1)))
    inner = F.least(F.lit(size - 1).cast("bigint"), exact("n_pairs", size) - 1 - F.col("_outer") * size)
    steps = steps.withColumn("_inner", F.explode(F.sequence(F.lit(0).cast("bigint"), inner)))
    steps = steps.withColumn("_step", F.col("_outer") * size + F.col("_inner"))
    rows = F.least(F.lit(size).cast("bigint"), F.col("n_pairs") - F.col("_step") * size)
    dealt = steps.select(*pairs.columns, rows.alias("_rows")).hint("rebalance")
    return dealt.select("*", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("_rows"))).alias("_i")).drop("_i", "_rows", "n_pairs")


def substring_containers(db: DataFrame, denovo: DataFrame) -> DataFrame:
    """(norm, db_file, db_original): first database peptide strictly holding a
    de novo norm that has no exact match in that file.

    Database peptides come in the order in which their norm first occurs.
    Norms with an exact match in every file are taken out before the search,
    the others where they have one.
    """
    # Used three times: as texts, for exact norms and for the originals.
    firsts = (normalized(db).groupBy(F.col("label").alias("db_file"), F.col("norm").alias("db_norm"))
              .agg(F.min(F.struct("idx", "peptide")).alias("first"))
              .select("db_file", "db_norm", F.col("first.idx").alias("first_idx"), F.col("first.peptide").alias("db_original")))
    firsts = materialize(firsts)
    exact = firsts.select(F.col("db_norm").alias("norm"), "db_file")
    n_files = firsts.select(F.count_distinct("db_file")).first()[0]
    everywhere = exact.groupBy("norm").agg(F.count("*").alias("n")).filter(F.col("n") == n_files)
    wanted = materialize(normalized(denovo).select("norm").distinct().join(everywhere, "norm", "left_anti"))
    found = first_container(wanted, "norm", "norm", firsts.select("db_norm", "db_file", "first_idx"),
                            "db_norm", "db_norm", order=["first_idx"], scope=["db_file"])
    return (found.join(exact, ["norm", "db_file"], "left_anti")
            .join(firsts.select("db_file", "db_norm", "db_original"), ["db_file", "db_norm"])
            .select("norm", "db_file", "db_original"))


def substring_pairs(denovo: DataFrame, containers: DataFrame) -> DataFrame:
    """One row per de novo occurrence that is held by a longer peptide."""
    return (normalized(denovo).join(containers, "norm")
            .select("db_file", F.col("label").alias("denovo_file"), "idx",
                    F.col("peptide").alias("denovo_original"),
                    F.col("db_original").alias("db_containing_peptide")))


def overlap_summary(db: DataFrame, denovo: DataFrame, containers: DataFrame) -> DataFrame:
    """Exact, substring-only and total counts; every pair of files, zeros too.

    Counts come from norm multiplicities; no pair is written out for them.
    """
    def norms(peptides: DataFrame, label: str, n: str) -> DataFrame:
        return normalized(peptides).groupBy(F.col("label").alias(label), "norm").agg(F.count("*").alias(n))

    a, b = norms(db, "db_file", "n_db"), norms(denovo, "denovo_file", "n_denovo")
    key = ["db_file", "denovo_file"]
    exact = a.join(b, "norm").groupBy(*key).agg(F.sum(F.col("n_db") * F.col("n_denovo")).alias("e"))
    inner = containers.select("norm", "db_file").join(b, "norm").groupBy(*key).agg(F.sum("n_denovo").alias("s"))
    # File labels: one row per input file on either side.
    files = (db.select(F.col("label").alias("db_file")).distinct()
             .withColumn("_all", F.lit(1))
             .join(denovo.select(F.col("label").alias("denovo_file")).distinct()
                   .withColumn("_all", F.lit(1)), "_all").drop("_all"))
    zero = F.lit(0).cast("bigint")
    e, s = F.coalesce("e", zero), F.coalesce("s", zero)
    return (files.join(exact, key, "left").join(inner, key, "left")
            .select(*key, e.alias("exact_overlap"), s.alias("substring_only_overlap"),
                    (e + s).alias("total_overlap")))


# Lists whose membership one long holds.
_LISTS_PER_WORD = 63


def membership(peptides: DataFrame, labels: list[str]) -> DataFrame:
    """(norm, lists): bit ``i`` of ``lists`` tells whether list ``labels[i]`` has the norm.

    Bits are set by the map side and merged in one shuffle; a long holds 63
    lists, so a thousand of them are sixteen numbers. Labels repeat if two
    files share a stem, which is refused.
    """
    if len(set(labels)) != len(labels):
        raise ValueError(f"file labels must differ: {labels}")
    numbers = F.create_map(*[F.lit(v) for i, name in enumerate(labels) for v in (name, i)])[F.col("label")] if labels else F.lit(None).cast("int")
    numbered = normalized(peptides).select("norm", numbers.alias("number"))
    word, bit = F.floor(F.col("number") / _LISTS_PER_WORD), F.expr(f"shiftleft(1L, cast(number % {_LISTS_PER_WORD} as int))")
    words = [F.bit_or(F.when(word == w, bit).otherwise(F.lit(0).cast("bigint"))).alias(f"w{w}") for w in range(_words_of(labels))]
    return numbered.groupBy("norm").agg(*words).select("norm", F.array(*[f"w{w}" for w in range(_words_of(labels))]).alias("lists"))


def _words_of(labels: list[str]) -> int:
    return max(1, -(-len(labels) // _LISTS_PER_WORD))


def venn_counts(peptides: DataFrame, labels: list[str]) -> DataFrame:
    """Norms per exact combination of files; combinations seen only.

    Combinations are counted as bits and named afterwards.
    """
    counts = membership(peptides, labels).groupBy("lists").agg(F.count("*").alias("peptide_count"))
    has = [F.when(F.get("lists", F.lit(i // _LISTS_PER_WORD)).bitwiseAND(F.lit(1 << i % _LISTS_PER_WORD)) != 0, F.lit(name))
           for i, name in enumerate(labels)]
    return counts.select(F.array_sort(F.array_compact(F.array(*has))).alias("files"), "peptide_count").select(
        F.array_join("files", " & ").alias("file_combination"), F.size("files").alias("n_files"),
        "peptide_count")


def sort_venn(counts: DataFrame) -> DataFrame:
    return (counts.orderBy(F.desc("n_files"), F.split("file_combination", " & "))
            .select("file_combination", "peptide_count"))


def shared_norms(peptides: DataFrame, labels: list[str]) -> DataFrame:
    """Norms present in every file."""
    full = [(1 << min(_LISTS_PER_WORD, len(labels) - w * _LISTS_PER_WORD)) - 1 for w in range(_words_of(labels))]
    return membership(peptides, labels).filter(F.col("lists") == F.array(*[F.lit(v).cast("bigint") for v in full])).select("norm")


def all_files_originals(peptides: DataFrame, shared: DataFrame) -> DataFrame:
    """(norm, label, idx, peptide): every occurrence of the norms that all files have."""
    return normalized(peptides).join(shared, "norm", "left_semi").select("norm", "label", "idx", "peptide")


def length_filter_distinct(lines: DataFrame, column: str = "value", min_length: int = 8) -> DataFrame:
    """Distinct whole lines of at least ``min_length`` letters."""
    return lines.select(column).filter(F.length(column) >= min_length).distinct()
