"""Document fingerprints from closed syncmers, in column expressions alone.

A text is read as units: runs of up to 32 characters without white space, so
words, and single characters in longer runs and in scripts written without
spaces, whose characters also end a run. K consecutive units are an anchor
if the least hash among the inner runs of S units stands at the first or the
last place (ties count). The choice looks at those K units alone, so equal
passages give equal anchors wherever they stand and edits disturb only the
anchors over them; of any K - S + 1 neighbouring positions at least one is
chosen. A text of fewer than K units has one anchor: all its units. A text of
so few more that no position is chosen has one as well: the first K units over
the least inner hash.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqloom.llm.ranges import MIN_LONG, null_first, range_of, splitters
from seqloom.llm.storage import store

# White space, and all but the blocks of scripts written without spaces (Thai, Lao, Tibetan, Myanmar,
# Khmer, Chinese, Japanese, full-width forms); what is most frequent is tried first.
_SPACE = r"\x20\x09-\x0D"
_WORD = (r"[\x21-\x{0DFF}\x{10A0}-\x{177F}\x{1800}-\x{2E7F}\x{A000}-\x{A9DF}\x{AA00}-\x{AA5F}\x{AA80}-\x{F8FF}\x{FB00}-\x{FE2F}"
         r"\x{FE50}-\x{FEFF}\x{FFF0}-\x{1FFFF}\x{40000}-\x{10FFFF}\x00-\x08\x0E-\x1F]")
UNIT = rf"(?<!{_WORD}){_WORD}{{1,32}}+(?!{_WORD})|[^{_SPACE}]"
K, S = 8, 2
#: Bytes of text of each range of documents, and the most ranges.
RANGE_BYTES, MAX_RANGES = 4 << 20, 1 << 16


def with_anchors(df: DataFrame, text: str, out: str, positions: bool = False) -> DataFrame:
    """Add ``out``: the anchors of a text in order, as 32-bit hashes.

    With ``positions``, structs (position, hash) where position is the index of
    the anchor's first unit. Null and empty texts have none.
    """
    inner = K - S + 1
    units, hashes, least = f"__{out}_units", f"__{out}_inner", f"__{out}_least"
    df = df.withColumn(units, F.transform(F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(UNIT), F.lit(0)), lambda w: F.xxhash64(w)))
    # Hash of the S units from each place on; of the last places fewer, which are cut off again.
    shifted = lambda c, n: F.slice(c, F.lit(n + 1), F.greatest(F.size(c) - n, F.lit(0)))
    df = df.withColumn(hashes, F.zip_with(F.slice(units, F.lit(1), F.greatest(F.size(units) - (S - 1), F.lit(0))), shifted(F.col(units), S - 1),
                                          lambda a, b: F.xxhash64(a, b)))
    # Least of 2, then of 4, then of all inner places, by shifting.
    span, current = 1, F.col(hashes)
    names = []
    while span < inner:
        step = min(span, inner - span)
        name = f"{least}_{span}"
        df = df.withColumn(name, F.zip_with(F.slice(current, F.lit(1), F.greatest(F.size(current) - step, F.lit(0))),
                                            shifted(current, step), lambda a, b: F.least(a, b)))
        names.append(name)
        current, span = F.col(name), span + step
    n = F.size(units)
    at_edge = lambda low, i: (F.get(F.col(hashes), i) == low) | (F.get(F.col(hashes), i + (inner - 1)) == low)
    where = f"__{out}_at"
    df = df.withColumn(where, F.filter(F.transform(current, lambda low, i: F.when(at_edge(low, i), i)), lambda i: i.isNotNull()))
    # A text of fewer than K - S + 1 positions may have none chosen.
    first_least = F.array_position(current, F.array_min(current)).cast("int") - 1
    df = df.withColumn(where, F.when(F.size(where) > 0, F.col(where)).otherwise(F.array(first_least)))
    # Every second inner hash covers the K units.
    anchor = lambda i: F.hash(*[F.get(F.col(hashes), i + j) for j in range(0, inner, S)], F.get(F.col(hashes), i + (inner - 1)))
    value = (lambda i: F.struct(i.alias("position"), anchor(i).alias("hash"))) if positions else anchor
    short = F.hash(F.array_join(F.transform(units, lambda h: h.cast("string")), " "))
    short = F.struct(F.lit(0).alias("position"), short.alias("hash")) if positions else short
    df = df.withColumn(out, F.when(n >= K, F.transform(where, value)).when(n > 0, F.array(short)).otherwise(F.array().cast(
        "array<struct<position:int,hash:int>>" if positions else "array<int>")))
    return df.drop(units, hashes, *names, where)


def likeness(a: str, b: str) -> Column:
    """Share of the anchors that two texts have in common, 0 to 1; two texts without any have no units and are alike."""
    both = F.size(F.array_union(a, b))
    return F.when(both == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / both)


def digest(anchors: str) -> Column:
    """The anchors as one string, eight hexadecimal digits each."""
    return F.array_join(F.transform(anchors, lambda h: F.lower(F.lpad(F.hex(h.cast("long").bitwiseAND(0xFFFFFFFF)), 8, "0"))), "")


def matches(left: DataFrame, right: DataFrame) -> DataFrame:
    """Positional matches between two tables of (id, anchors with positions):
    anchors that occur once in their text, joined by hash."""
    single = lambda df, side: (
        df.select(F.col("id").alias(f"{side}_id"), F.explode("anchors").alias("a"))
        .groupBy(f"{side}_id", F.col("a.hash").alias("hash")).agg(F.min("a.position").alias(f"{side}_position"), F.count("*").alias("n"))
        .where("n = 1").drop("n"))
    return single(left, "left").join(single(right, "right"), "hash").select(
        "left_id", "right_id", "left_position", "right_position")


def in_order(docs: DataFrame, columns: list[str]) -> tuple[DataFrame, object]:
    """(doc_id, columns and helpers; a window in which ``lead`` gives the next row by ascending doc_id).

    Documents are cut into ranges of ids by sampled splitters. A splitter is
    the key of the first row of its range, and that row is dealt to the range
    before as a guard as well, so no range needs a look at another. The last
    row is followed by the first. Null ids come first, equal ids are ordered by
    text. Rows with ``__guard`` are to be dropped at the end.
    """
    keys = ["__id", "__text"]
    keyed = docs.select("doc_id", *columns, null_first("doc_id").alias("__id"), F.xxhash64("text").alias("__text"),
                        (F.coalesce(F.octet_length("text"), F.lit(0)) + 16).alias("__w"))
    narrow = store(keyed.select(*keys, "__w"), "keys")
    total, first = narrow.agg(F.sum("__w"), F.min(F.struct(*keys))).first()
    head = tuple(first) if first else (MIN_LONG, 0)
    cuts = splitters(narrow, keys, "__w", min(MAX_RANGES, max(1, (total or 0) // RANGE_BYTES)))
    bounds = [head, *[b for b in cuts if b > head]]
    ranged = keyed.withColumn("__range", range_of(keyed, keys, bounds))
    table = F.from_json(F.lit(json.dumps([{"i": i, "t": t} for i, t in bounds])), "array<struct<i:bigint,t:bigint>>")
    below = F.get(table, F.col("__range") - 1)
    opens = (below["i"] == F.col("__id")) & (below["t"] == F.col("__text"))
    before = F.when(F.col("__range") == 1, F.lit(len(bounds))).otherwise(F.col("__range") - 1)
    own = F.struct(F.col("__range").alias("r"), F.lit(False).alias("g"))
    guard = F.struct(before.alias("r"), F.lit(True).alias("g"))
    dealt = ranged.select("doc_id", *columns, *keys, F.explode(F.when(opens, F.array(own, guard)).otherwise(F.array(own))).alias("__c"))
    dealt = dealt.select("doc_id", *columns, *keys, F.col("__c.r").alias("__range"), F.col("__c.g").alias("__guard"))
    return dealt, Window.partitionBy("__range").orderBy("__guard", *keys)


def document_fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited text, and their likeness.

    The edited text has its last quarter of code points replaced by as many of
    the next document's first, or by all where it is shorter. A null text is
    empty; an empty table gives no rows.
    """
    dealt, order = in_order(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")), ["text"])
    rows = dealt.withColumns({"n_chars": F.length("text").cast("long"), "__next": F.lead("text").over(order)})
    quarter = F.expr("cast(n_chars div 4 as int)")
    rows = rows.withColumn("__edited", F.when(F.col("__guard"), F.lit("")).otherwise(F.concat(
        F.substring("text", F.lit(1), F.col("n_chars").cast("int") - quarter), F.substring("__next", F.lit(1), quarter))))
    rows = rows.drop("__next")
    rows = with_anchors(with_anchors(rows, "text", "__own"), "__edited", "__other").drop("text")
    rows = rows.withColumn("__following", F.lead("__own").over(order)).where(~F.col("__guard"))
    return rows.select(
        "doc_id", "n_chars", F.sha2("__edited", 256).alias("edited_sha256"), digest("__own").alias("fingerprint"),
        digest("__other").alias("edited_fingerprint"), likeness("__own", "__other").alias("near_edited"),
        likeness("__own", "__following").alias("near_next"))
