"""Containment joins: which texts hold a pattern as a substring.

Spark would plan ``contains`` as a nested loop over all pairs. Here both sides
meet on seeds (see :mod:`seqloom.functions.seeds`), each pattern is looked up
by its rarest seed only, and the few candidate pairs are then verified.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from seqloom.functions.bloom import build_filters
from seqloom.functions.seeds import CLASSES, with_end_windows, with_seeds, with_windows
from seqloom.session import materialize
from seqloom.session import spread as more_tasks

# Size up to which candidates are sent to all tasks; they are counted first.
CANDIDATE_BYTES = 64 << 20
# Texts per seed that are tried before the rest of a hot seed is.
FIRST_TRIES = 64
# Pairs of a pattern and a text that one seed may propose; beyond it matches are found by content.
PAIRS_PER_SEED = 1_000_000


def seed_matches(patterns: DataFrame, pattern: str, pattern_key: str,
                 texts: DataFrame, text: str, carry: list[str]) -> tuple[DataFrame, DataFrame]:
    """Look-up rows of the patterns and all text rows for seeds of patterns.

    Returns ``probes`` (pattern_key, size, seed, spread): per pattern its
    length in bytes, its rarest seed and the number of texts having it, and
    ``hits`` (carry..., text_size, seed). A pattern one of whose seeds occurs
    in no text is dropped. Texts give rows only for seeds that pass the
    patterns' filters, so what they write follows from the patterns; the few
    that pass by chance meet no probe.
    """
    spark = patterns.sparkSession
    sized = more_tasks(patterns).withColumn("size", F.octet_length(pattern).cast("bigint"))
    texts = texts.withColumn("text_size", F.octet_length(text).cast("bigint"))
    carry = [*carry, "text_size"]
    own = materialize(with_seeds(sized, pattern, [pattern_key, "size"], list(CLASSES), own_class=True))
    classes = sorted(r.m for r in own.select("m").distinct().collect())  # at most all classes
    keep = spark.sparkContext.broadcast(build_filters(own).tables)
    hits = materialize(with_seeds(texts, text, carry, classes, own_class=False, keep=keep).select(*carry, "seed"))
    spread = hits.groupBy("seed").agg(F.count("*").alias("spread"))
    probes = (own.join(spread, "seed", "left")
              .groupBy(pattern_key, "size")
              .agg(F.count("*").alias("n"), F.count("spread").alias("found"),
                   F.min("spread").alias("spread"), F.min_by("seed", "spread").alias("seed"))
              .filter("n = found").drop("n", "found"))
    return materialize(probes), hits


def _verify(pairs: DataFrame, patterns: DataFrame, pattern: str, pattern_key: str,
            texts: DataFrame, text: str, text_key: str) -> DataFrame:
    """Keep the candidate pairs where the text really holds the pattern.

    The candidates are counted first. When they and their patterns are few
    they go to the texts, which then need no shuffle.
    """
    pairs = materialize(pairs)
    total = pairs.agg(F.sum(F.col("size") + 64)).first()[0] or 0
    few = F.broadcast if total <= CANDIDATE_BYTES else (lambda df: df)
    known = set(pairs.columns)
    if pattern not in known:
        pairs = patterns.select(pattern_key, pattern).join(few(pairs), pattern_key)
    if text not in known:
        pairs = texts.select(text_key, text).join(few(pairs), text_key)
    return pairs.filter(F.contains(text, pattern))


_CONTENT = ["m", "first", "gap", "last"]


def _end_window_matches(open_patterns: DataFrame, pattern: str, pattern_key: str, texts: DataFrame, text: str,
                        text_columns: list[str], one_text: list[str],
                        longer: bool) -> tuple[DataFrame, DataFrame]:
    """Matches of patterns through the windows at both their ends.

    Returns ``ends`` (pattern_key, content...) and ``whole`` (text columns,
    content...), a row for each place where both windows stand at the right
    distance. The places are found per content, not per pattern, so the work
    is linear in the texts however many patterns share a passage.
    """
    ends = materialize(with_end_windows(open_patterns, pattern, [pattern_key]))
    sizes = sorted(r.m for r in ends.select("m").distinct().collect())  # one per power of two
    wanted = ends.select("m", F.explode(F.array("first", "last")).alias("hash"))
    keep = texts.sparkSession.sparkContext.broadcast(build_filters(wanted, "hash").tables)
    sized = texts.withColumn("text_size", F.octet_length(text).cast("bigint"))
    windows = materialize(with_windows(sized, text, [*text_columns, "text_size"], sizes, keep))
    room = F.col("text_size") - F.col("m") - F.col("gap")
    starts = (windows.withColumnRenamed("hash", "first")
              .join(ends.select("m", "first", "gap").distinct(), ["m", "first"])
              .filter(room > 0 if longer else room >= 0).drop("text_size")
              .withColumn("at", F.col("at") + F.col("gap")))
    second = windows.select(*one_text, "m", "at", F.col("hash").alias("last"))
    return ends, starts.join(second, [*one_text, "m", "at"])


def containing_pairs(patterns: DataFrame, pattern: str, pattern_key: str,
                     texts: DataFrame, text: str, text_key: str,
                     carry: list[str] = ()) -> DataFrame:
    """All (pattern_key, text_key, carry...) where the text holds the pattern.

    Keys must be unique on their side; a key may be the text itself. Where
    many patterns share a seed of many texts they go by their end windows, so
    only true matches of theirs become pairs.
    """
    columns = list(dict.fromkeys([text_key, *carry]))
    result = [pattern_key, *columns]
    probes, hits = seed_matches(patterns, pattern, pattern_key, texts, text, columns)

    def verified(pairs: DataFrame) -> DataFrame:
        return _verify(pairs, patterns, pattern, pattern_key, texts, text, text_key).select(*result)

    sharing = probes.groupBy("seed").agg(F.count("*").alias("sharing"))
    probes = materialize(probes.join(sharing, "seed"))
    hot = F.col("spread") * F.col("sharing") > PAIRS_PER_SEED
    pairs = probes.filter(~hot).join(hits, "seed").filter("text_size >= size").select(*result, "size")
    often = probes.filter(hot).select(pattern_key, "size")
    if often.isEmpty():
        return verified(pairs)
    bodies = patterns.select(*dict.fromkeys([pattern_key, pattern]))
    ends, whole = _end_window_matches(bodies.join(often, pattern_key, "left_semi"), pattern, pattern_key,
                                      texts, text, columns, [text_key], longer=False)
    matched = ends.join(whole.select(*columns, *_CONTENT).distinct(), _CONTENT).join(often, pattern_key)
    return verified(pairs.unionByName(matched.select(*result, "size")))


def first_container(patterns: DataFrame, pattern: str, pattern_key: str,
                    texts: DataFrame, text: str, text_key: str, order: list[str],
                    scope: list[str] = ()) -> DataFrame:
    """Per pattern (and ``scope`` of texts) the first longer text that holds it.

    ``order`` lists text columns, smallest first. A hot seed is tried on its
    first texts in order only. Patterns not found there are looked up by the
    windows at both their ends, which leaves true matches only, reduced to the
    first one per pattern content by the map tasks. So a seed shared by a
    third of all texts never gives all pairs, and no match is lost.
    """
    scope = list(scope)
    columns = list(dict.fromkeys([text_key, *scope, *order]))
    found = [c for c in columns if c not in scope]
    key = [pattern_key, *scope]
    result = [*key, *found]
    probes, hits = seed_matches(patterns, pattern, pattern_key, texts, text, columns)

    def best(pairs: DataFrame, keys: list[str]) -> DataFrame:
        first = F.min(F.struct(*dict.fromkeys([*order, text_key]))).alias("best")
        return pairs.groupBy(*keys).agg(first).select(*keys, *(F.col(f"best.{c}").alias(c) for c in found))

    def resolve(probe: DataFrame, hit: DataFrame, on: list[str]) -> DataFrame:
        pairs = probe.join(hit, on).filter("text_size > size").drop("seed", "spread", "text_size")
        sure = _verify(pairs, patterns, pattern, pattern_key, texts, text, text_key)
        return best(sure, key).select(*result)

    hot = probes.filter(F.col("spread") > FIRST_TRIES)
    if hot.isEmpty():
        return resolve(probes, hits, ["seed"])
    rank = F.row_number().over(W.partitionBy("seed", *scope).orderBy(*order))
    first = hits.withColumn("rank", rank).filter(F.col("rank") <= FIRST_TRIES).drop("rank")
    early = materialize(resolve(probes, first, ["seed"]))
    # Only seeds with more texts than were tried leave anything open.
    more = hits.groupBy("seed", *scope).agg(F.count("*").alias("n")).filter(F.col("n") > FIRST_TRIES).drop("n")
    late = materialize(hot.join(more, "seed").join(early.select(*key), key, "left_anti"))
    if late.isEmpty():
        return early
    bodies = patterns.select(*dict.fromkeys([pattern_key, pattern]))
    ends, whole = _end_window_matches(bodies.join(late.select(pattern_key).distinct(), pattern_key, "left_semi"),
                                      pattern, pattern_key, texts, text, columns,
                                      list(dict.fromkeys([text_key, *scope])), longer=True)
    matched = (late.drop("seed", "spread").join(ends, pattern_key)
               .join(best(whole, [*_CONTENT, *scope]), [*_CONTENT, *scope]).drop(*_CONTENT))
    matched = materialize(matched)
    sure = materialize(_verify(matched, patterns, pattern, pattern_key, texts, text, text_key).select(*result))
    done = early.unionByName(sure)
    # Equal hashes of different windows: settle those patterns pair by pair.
    doubtful = matched.select(*key).join(sure, key, "left_anti")
    if doubtful.isEmpty():
        return done
    return done.unionByName(resolve(late.join(doubtful, key, "left_semi"), hits, ["seed", *scope]))
