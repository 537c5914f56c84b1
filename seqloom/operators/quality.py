"""Prediction quality, matched against unmatched."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from seqloom.functions import text as tx
from seqloom.session import materialize

# Whisker reach in interquartile ranges, points drawn per group
# and the seed of their choice.
WHISKER_REACH = 1.5
MAX_POINTS = 2000
POINT_SEED = 42

# Hexadecimal digits of a point's hash that are counted: 65,536 prefixes per group.
_PREFIX_DIGITS = 4
_INFINITY = float("inf")

# Distinct values a group may have for its quantiles to be read off directly.
DIRECT_VALUES = 1_000_000


def match_lookup(reference: DataFrame) -> DataFrame:
    """(key, is_match): the last row of a repeated key decides."""
    key = tx.key_upper(F.col("peptide"))
    return (reference.select(key.alias("key"), (F.col("n_proteins").cast("int") > 0).alias("is_match"), "idx")
            .filter(F.col("key").isNotNull())
            .groupBy("key").agg(F.max_by("is_match", "idx").alias("is_match")))


def annotate_predictions(predictions: DataFrame, lookup: DataFrame,
                         column: str = "instanovoplus_predictions") -> DataFrame:
    """Add the key and the three-valued match state (null: not in reference)."""
    keyed = predictions.withColumn("key", tx.prediction_key(F.col(column)))
    return keyed.join(lookup.withColumnRenamed("is_match", "match_status"), "key", "left")


def annotation_summary(annotated: DataFrame) -> DataFrame:
    status = F.col("match_status")
    return annotated.agg(F.count("*").alias("n_total"), F.count(status).alias("n_found"),
                         F.count_if(status).alias("n_match"), F.count_if(~status).alias("n_nomatch"),
                         F.count_if(status.isNull()).alias("n_absent"))


def metric_values(annotated: DataFrame, metrics: list[str], *carry: str) -> DataFrame:
    """Long form (metric, status, value) of found rows with a value."""
    values = F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics))
    status = F.when(F.col("match_status"), F.lit("MATCH")).otherwise(F.lit("NO_MATCH"))
    return (annotated.filter(F.col("match_status").isNotNull())
            .select(status.alias("status"), *carry, F.explode(values).alias("v"))
            .select("v.metric", "status", *carry, "v.value").filter(F.col("value").isNotNull() & ~F.isnan("value")))


def count_values(values: DataFrame, keys: list[str]) -> DataFrame:
    """(keys..., value, n): copies of one value as one row."""
    return values.groupBy(*keys, "value").agg(F.count("*").alias("n"))


def quartiles(counted: DataFrame, keys: list[str], direct_values: int = DIRECT_VALUES) -> DataFrame:
    """Exact quartiles of counted values with linear interpolation.

    While a group has more distinct values than fit one task, a histogram
    narrows each wanted rank down to its bucket and the rows below are only
    counted. A few passes reach any size, and no group is collected.
    """
    quarters = F.array(*(F.struct(F.lit(name).alias("name"), F.lit(q).alias("q"))
                         for name, q in (("q1", 0.25), ("median", 0.5), ("q3", 0.75))))
    sizes = counted.groupBy(*keys).agg(F.sum("n").alias("total"))
    place = (F.col("total") - 1) * F.col("s.q")
    wanted = (sizes.select(*keys, "total", F.explode(quarters).alias("s"))
              .select(*keys, "total", "s.name", (place - F.floor(place)).alias("share"),
                      F.explode(F.array(F.struct(F.lit("lower").alias("end"), F.floor(place).alias("rank")),
                                        F.struct(F.lit("upper").alias("end"), F.ceil(place).alias("rank")))).alias("t"))
              .select(*keys, "total", "name", "share", "t.*"))
    # Six rows per group of the report.
    band = counted.join(F.broadcast(wanted), keys).withColumn("below", F.lit(0).cast("bigint"))
    group = [*keys, "name", "end"]
    widest = F.max("values").alias("widest")
    left = lambda: band.groupBy(*group).agg(F.count("*").alias("values")).agg(widest).first().widest or 0
    wide, last = left(), None
    while wide > direct_values and wide != last:
        band = materialize(_narrow(band, group))
        wide, last = left(), wide
    before = F.sum("n").over(W.partitionBy(*group).orderBy("value").rowsBetween(W.unboundedPreceding, -1))
    start = F.col("below") + F.coalesce(before, F.lit(0))
    found = (band.withColumn("start", start)
             .filter((F.col("start") <= F.col("rank")) & (F.col("rank") < F.col("start") + F.col("n"))))
    of = lambda name, end: F.max(F.when((F.col("name") == name) & (F.col("end") == end), F.col("value")))
    share = lambda name: F.max(F.when(F.col("name") == name, F.col("share")))
    quartile = lambda name: (
        of(name, "lower") + (of(name, "upper") - of(name, "lower")) * share(name)).alias(name)
    return found.groupBy(*keys).agg(F.max("total").alias("n"), *map(quartile, ("q1", "median", "q3")))


def _narrow(band: DataFrame, group: list[str], buckets: int = 1024) -> DataFrame:
    """Keep the bucket of each wanted rank and count the rows below it."""
    # All joined sides have at most ``buckets`` rows per wanted rank.
    finite = F.when(F.abs("value") < _INFINITY, F.col("value"))
    span = band.groupBy(*group).agg(F.min(finite).alias("least"), F.max(finite).alias("most"))
    # Halves, so that a span of the largest doubles does not overflow; the infinities have buckets of their own.
    width = F.col("most") / 2 - F.col("least") / 2
    place = F.floor((F.col("value") / 2 - F.col("least") / 2) / width * buckets)
    bucket = (F.when(F.col("value") == -_INFINITY, F.lit(-1)).when(F.col("value") == _INFINITY, F.lit(buckets))
              .when(width > 0, F.least(place, F.lit(buckets - 1))).otherwise(F.lit(0)))
    split = band.join(F.broadcast(span), group).withColumn("bucket", bucket).drop("least", "most")
    counts = split.groupBy(*group, "bucket").agg(F.sum("n").alias("rows"), F.first("below").alias("below"),
                                                 F.first("rank").alias("rank"))
    before = F.sum("rows").over(W.partitionBy(*group).orderBy("bucket").rowsBetween(W.unboundedPreceding, -1))
    start = F.col("below") + F.coalesce(before, F.lit(0))
    hit = (counts.withColumn("below", start)
           .filter((F.col("below") <= F.col("rank")) & (F.col("rank") < F.col("below") + F.col("rows")))
           .select(*group, "bucket", "below"))
    return split.drop("below").join(F.broadcast(hit), [*group, "bucket"]).drop("bucket")


def box_stats(values: DataFrame, keys: list[str] = ("metric", "status"),
              direct_values: int = DIRECT_VALUES) -> DataFrame:
    """Size, quartiles and whiskers per group, as a box plot draws them.

    A whisker ends at the last value within reach of the box, or at the box.
    """
    keys = list(keys)
    counted = materialize(count_values(values, keys))
    boxes = materialize(quartiles(counted, keys, direct_values))
    reach = (F.col("q3") - F.col("q1")) * WHISKER_REACH
    v = F.col("value")
    ends = (counted.drop("n").join(F.broadcast(boxes), keys)  # one row per group of the report
            .groupBy(*keys)
            .agg(F.min(F.when(v >= F.col("q1") - reach, v)).alias("low"),
                 F.max(F.when(v <= F.col("q3") + reach, v)).alias("high")))
    return (boxes.join(ends, keys)
            .select(*keys, "n", "q1", "median", "q3",
                    F.least("low", "q1").alias("whisker_low"), F.greatest("high", "q3").alias("whisker_high")))


def sampled_points(values: DataFrame, id_col: str, keys: list[str] = ("metric", "status"),
                   limit: int = MAX_POINTS, seed: int = POINT_SEED) -> DataFrame:
    """At most ``limit`` points per group, the same ones in every run.

    Points are taken in hash order. Counts by hash prefix tell up to which
    prefix a group reaches the limit; only the points up to there are ranked.
    """
    hashed = values.withColumn("hash", F.md5(F.concat_ws("_", F.lit(str(seed)), F.col(id_col).cast("string"))))
    hashed = hashed.withColumn("prefix", F.substring("hash", 1, _PREFIX_DIGITS))
    counts = hashed.groupBy(*keys, "prefix").agg(F.count("*").alias("n"))
    before = F.sum("n").over(W.partitionBy(*keys).orderBy("prefix").rowsBetween(W.unboundedPreceding, -1))
    # One row per group of the report.
    cut = (counts.withColumn("before", F.coalesce(before, F.lit(0))).filter(F.col("before") < limit)
           .groupBy(*keys).agg(F.max("prefix").alias("cut")))
    first = hashed.join(F.broadcast(cut), list(keys)).filter(F.col("prefix") <= F.col("cut"))
    whole = F.row_number().over(W.partitionBy(*keys).orderBy("hash", id_col))
    return first.withColumn("rank", whole).filter(F.col("rank") <= limit).select(values.columns)
