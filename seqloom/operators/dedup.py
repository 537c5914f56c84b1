"""Collapsing a sequence set: identical records, then contained ones."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.operators.containment import first_container
from seqloom.operators.latest import keep_one
from seqloom.session import materialize


def unique_sequences(records: DataFrame) -> DataFrame:
    """First record of every sequence: (rec_idx, id, seq, digest, n, length).

    Records meet on a digest; which is the first one follows from positions.
    """
    kept = keep_one(records.select("rec_idx", "id", "seq", F.sha2("seq", 256).alias("digest")), ["digest"], "rec_idx", last=False)
    return kept.select("rec_idx", "id", "seq", "digest", "n", F.length("seq").alias("length"))


def identical_edges(records: DataFrame, unique: DataFrame) -> DataFrame:
    """(representative_id, related_id, relationship) of identical records."""
    first = unique.filter("n > 1").select("digest", F.col("rec_idx").alias("rep_idx"),
                                          F.col("id").alias("representative_id"))
    copies = records.select(F.sha2("seq", 256).alias("digest"), "rec_idx", F.col("id").alias("related_id"))
    return (copies.join(first, "digest").filter("rec_idx != rep_idx")
            .select("representative_id", "related_id", F.lit("identical").alias("relationship"),
                    F.col("rep_idx").alias("sort1"), F.col("rec_idx").alias("sort2")))


def absorbed_sequences(unique: DataFrame) -> DataFrame:
    """(rec_idx, absorber_idx): the longest, then earliest, longer container.

    Empty sequences are neither absorbed nor absorbers.
    """
    bodies = unique.filter("length > 0")
    texts = bodies.select(F.col("rec_idx").alias("absorber_idx"), F.col("seq").alias("text"),
                          (-F.col("length")).alias("shortness"))
    return (first_container(bodies.select("rec_idx", "seq"), "seq", "rec_idx", texts, "text", "absorber_idx",
                            order=["shortness", "absorber_idx"])
            .select("rec_idx", "absorber_idx"))


def substring_edges(unique: DataFrame, absorbed: DataFrame) -> DataFrame:
    """(representative_id, related_id, relationship) of absorbed sequences."""
    names = unique.select("rec_idx", "id", "length")
    absorber = names.select(F.col("rec_idx").alias("absorber_idx"), F.col("id").alias("representative_id"))
    return (absorbed.join(names, "rec_idx").join(absorber, "absorber_idx")
            .select("representative_id", F.col("id").alias("related_id"),
                    F.lit("substring").alias("relationship"),
                    (-F.col("length")).cast("bigint").alias("sort1"), F.col("rec_idx").alias("sort2")))


def kept_sequences(unique: DataFrame, absorbed: DataFrame, name_semantics: bool = False) -> DataFrame:
    """Representatives contained in no longer one.

    ``name_semantics`` keeps every representative that shares its name with a
    kept one, also an absorbed one.
    """
    kept = unique.join(absorbed.select("rec_idx"), "rec_idx", "left_anti")
    if name_semantics:
        kept = unique.join(kept.select("id").distinct(), "id", "left_semi")
    return kept.select("rec_idx", "id", "seq")


class Dedup:
    """The stages of one de-duplication, each computed at most once."""

    def __init__(self, records: DataFrame, name_semantics: bool = False):
        self.records = records
        self.name_semantics = name_semantics
        self.unique = materialize(unique_sequences(records))
        self._absorbed = None

    @property
    def absorbed(self) -> DataFrame:
        if self._absorbed is None:
            self._absorbed = materialize(absorbed_sequences(self.unique))
        return self._absorbed

    def identical(self) -> DataFrame:
        return identical_edges(self.records, self.unique)

    def substrings(self) -> DataFrame:
        return substring_edges(self.unique, self.absorbed)

    def kept(self) -> DataFrame:
        return kept_sequences(self.unique, self.absorbed, self.name_semantics)

    def provenance(self) -> DataFrame:
        """All edges: identical ones in input order, then longest first."""
        phases = [self.identical().withColumn("phase", F.lit(1)),
                  self.substrings().withColumn("phase", F.lit(2))]
        return phases[0].unionByName(phases[1])

    def summary(self) -> DataFrame:
        """Input, collapsed, absorbed and kept counts in one row."""
        kept = self.kept().agg(F.count("*").alias("representatives_kept"))
        totals = self.unique.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("input_entries"),
                                 F.count("*").alias("n_unique"))
        return (totals.join(F.broadcast(kept))  # one row each
                .select("input_entries", (F.col("input_entries") - F.col("n_unique")).alias("identical_collapsed"),
                        (F.col("n_unique") - F.col("representatives_kept")).alias("substrings_removed"),
                        "representatives_kept"))


def sort_provenance(edges: DataFrame) -> DataFrame:
    return (edges.orderBy("phase", "sort1", "sort2")
            .select("representative_id", "related_id", "relationship"))
