"""Mixing sources to target weights by hierarchical budgeting.

A budget flows down a tree of domains, languages and sources. Every node splits
its budget among its children by weight, but no child gets more than its leaves
can supply; what a child cannot take goes to its siblings, and only what all
siblings together cannot take goes back to the ancestors. Leaves then take a
prefix of their documents in a seeded order, epoch after epoch.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqloom.llm.storage import store

#: Buckets of the seeded order in each leaf and epoch; a bucket's documents are summed by one task.
BUCKETS = 1024


def split_budget(budget: float, children: Mapping[str, tuple[float, float]]) -> dict[str, float]:
    """Share of each child (weight, supply): in proportion to weight up to the supply."""
    shares, left, open_ = {}, budget, dict(children)
    while open_:
        total = sum(w for w, _ in open_.values())
        full = {k: s for k, (w, s) in open_.items() if total <= 0 or left * w / total >= s} if total > 0 else {}
        if total <= 0:
            shares |= dict.fromkeys(open_, 0.0)
            break
        if not full:
            shares |= {k: left * w / total for k, (w, _) in open_.items()}
            break
        for k, s in full.items():
            shares[k] = s
            left -= s
            del open_[k]
        left = max(0.0, left)
    return shares


def leaf_budgets(supply: Mapping[tuple[str, ...], float], budget: float,
                 weights: Mapping[tuple[str, ...], float] | None = None) -> dict[tuple[str, ...], float]:
    """Budget of each leaf (a path of names). ``weights`` states a node's weight
    among its siblings by its path, or a path's prefix; the others weigh one."""
    weights = weights or {}

    def down(prefix: tuple[str, ...], share: float, leaves: list[tuple[str, ...]]) -> dict[tuple[str, ...], float]:
        if len(leaves) == 1 and leaves[0] == prefix:
            return {prefix: share}
        groups: dict[tuple[str, ...], list[tuple[str, ...]]] = {}
        for leaf in leaves:
            groups.setdefault(leaf[: len(prefix) + 1], []).append(leaf)
        shares = split_budget(share, {g: (float(weights.get(g, 1.0)), sum(supply[x] for x in own)) for g, own in groups.items()})
        return {k: v for g, own in groups.items() for k, v in down(g, shares[g], own).items()}

    return down((), min(budget, sum(supply.values())), sorted(supply)) if supply else {}


def mix(df: DataFrame, path: list[Column], size: Column, budget_share: float, max_epochs: int,
        weights: Mapping[tuple[str, ...], float] | None = None, order_by: tuple[str, ...] = ("doc_id", "text"), seed: int = 1) -> DataFrame:
    """Rows taken, once per epoch, with ``epoch`` (from 0) and ``mix_tokens``.

    ``budget_share`` is the budget as a share of all tokens. ``path`` are the
    levels of the tree; a null name is the empty name. A leaf with budget B and
    T tokens takes B div T whole epochs and of the next one the shortest prefix
    that reaches the rest, in an order that hashes seed, epoch and row. Rows
    with equal ``order_by`` values come in any order. Rows of no tokens are
    taken with the place where they stand. The number of leaves is that of the
    sources and small; a leaf of any size is summed in buckets. Columns named
    epoch or mix_tokens are replaced.
    """
    df = df.drop("epoch", "mix_tokens")
    levels = [f"__level{i}" for i in range(len(path))]
    rows = df.withColumns({**{n: F.coalesce(c.cast("string"), F.lit("")) for n, c in zip(levels, path, strict=True)},
                           "mix_tokens": F.coalesce(size.cast("long"), F.lit(0))})
    supply = {tuple(r[n] for n in levels): r["t"] for r in rows.groupBy(*levels).agg(F.sum("mix_tokens").alias("t")).collect()}
    budget = budget_share * sum(supply.values())
    budgets = leaf_budgets({k: float(t) * max_epochs for k, t in supply.items()}, budget, weights)
    spark = df.sparkSession
    plan = spark.createDataFrame(
        [(*leaf, int(min(max_epochs, b // supply[leaf])), float(b - (b // supply[leaf]) * supply[leaf])) if supply[leaf] else (*leaf, 0, 0.0)
         for leaf, b in budgets.items()], ", ".join(f"{n} string" for n in levels) + ", __whole int, __rest double")
    # One row per leaf of the tree.
    planned = rows.join(F.broadcast(plan), levels)
    hashed = F.xxhash64(F.lit(seed), F.col("epoch"), *order_by)
    # The last, partial epoch is the only one in which order matters.
    partial = planned.where("__rest > 0").withColumn("epoch", F.col("__whole")).withColumn("__order", hashed).withColumn(
        "__bucket", F.shiftrightunsigned("__order", 64 - (BUCKETS - 1).bit_length()).cast("int"))
    cells = partial.groupBy(*levels, "__bucket").agg(F.sum("mix_tokens").alias("__in"))
    before = Window.partitionBy(*levels).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)  # at most BUCKETS rows
    # Buckets that end before the rest is reached are taken whole, those that begin behind it not at all.
    # At most BUCKETS rows for each leaf of the tree.
    cells = store(cells.withColumn("__before", F.coalesce(F.sum("__in").over(before), F.lit(0))), "buckets")
    placed = partial.join(F.broadcast(cells), [*levels, "__bucket"])
    whole = placed.where("__before + __in <= __rest")
    inside = Window.partitionBy(*levels, "__bucket").orderBy(F.shiftrightunsigned("__order", 1), "__order", *order_by).rowsBetween(
        Window.unboundedPreceding, -1)
    cut = placed.where("__before < __rest and __before + __in > __rest").withColumn(
        "__at", F.col("__before") + F.coalesce(F.sum("mix_tokens").over(inside), F.lit(0))).where("__at < __rest").drop("__at")
    columns = [*[f"`{c}`" for c in df.columns], "epoch", "mix_tokens"]
    epochs = planned.where("__whole > 0").withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("__whole") - 1)))
    return epochs.select(*columns).unionByName(whole.select(*columns)).unionByName(cut.select(*columns))


def word_count(text: str = "text") -> Column:
    return F.size(F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)))


def document_path() -> list[Column]:
    """Domain, language and source of a document. The domain is the tens digit of the source's number."""
    number = F.try_to_number(F.regexp_extract(F.coalesce(F.col("source"), F.lit("")), r"([0-9]{1,9})$", 1), F.lit("999999999"))
    domain = F.when(F.col("source").isNull(), "").otherwise(F.concat(F.lit("domain"), F.coalesce(F.floor(number / 10), F.lit(0)).cast("string")))
    return [domain, F.col("lang"), F.col("source")]


#: Weights of the query and the pipeline; nodes not named weigh one.
WEIGHTS = {("domain0",): 3.0, ("domain1",): 2.0, ("domain0", "en"): 2.0, ("domain1", "en"): 2.0}


def mixed_documents(docs: DataFrame, budget_share: float = 0.6, max_epochs: int = 2) -> DataFrame:
    """(doc_id, epoch, lang, source, n_tokens) of the mixture, in tokens of white-space words."""
    narrow = store(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "lang", "source", F.xxhash64("text").alias("__text"),
                               word_count().cast("long").alias("__n")), "sizes")
    taken = mix(narrow, document_path(), F.col("__n"), budget_share, max_epochs, WEIGHTS, ("doc_id", "__text"))
    return taken.select("doc_id", "epoch", "lang", "source", F.col("mix_tokens").alias("n_tokens"))
