"""Near duplicates by MinHash with tensored banding.

Table keys are pairs of half-keys: one of ``HALVES`` from collection A with one
of as many from collection B, each half-key hashing ``ROWS`` minhashes. So
HALVES^2 tables of 2 * ROWS minhashes each need only 2 * HALVES * ROWS
minhashes. Two sets of similarity s share a table unless they share no half-key
of A or none of B; at s = 0.85 that is missed with 2 * (1 - 0.85^4)^16 = 1.5e-5.
A lower threshold takes more half-keys: at 0.8, 22 of them miss 1.9e-5.

Half-keys that occur once are dropped before pairs are formed. The members of a
half-key are compared with its most connected member, if they share a table
with it; half-keys whose members are one component then are settled, and so is
every table that they are half of. The members of any other table bucket with
several components are compared with the bucket's most connected member; where
the buckets of one such member then still hold several components, their whole
family is compared in blocks. All comparisons are exact, on full shingle sets.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seqloom.llm.graph import components
from seqloom.llm.storage import sheltered, store, text_batches

SHINGLE_WORDS = 5
HALVES, ROWS = 16, 4
#: A link is an intersection of at least this many hundredths of the union, if nothing else is asked for.
PERCENT = 85
#: The most pairs at the threshold that may share no table.
MISSED = 2e-5
#: Documents and shingles in a block of a family that is compared as a whole.
BLOCK_DOCS, BLOCK_SHINGLES = 512, 1 << 20

_FOLD = np.uint64(0x9E3779B97F4A7C15)


def halves_for(percent: int) -> int:
    """Half-keys of each collection, ``HALVES`` or as many more as a threshold needs."""
    if not 0 < percent <= 100:
        raise ValueError(f"percent must be 1 to 100, got {percent}")
    halves = HALVES
    while 2 * (1 - (percent / 100) ** ROWS) ** halves > MISSED:
        halves += 1
    return halves


@cache
def _minhashes(halves: int) -> tuple[np.ndarray, np.ndarray]:
    random = np.random.default_rng(20240229)
    times, plus = (random.integers(0, 1 << 63, 2 * halves * ROWS, dtype=np.uint64) for _ in range(2))
    return times * np.uint64(2) + np.uint64(1), plus


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the five-word shingles, A-Z lowered."""
    from xxhash import xxh3_64_intdigest

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, dtype=np.uint64)
    hashes = np.fromiter(map(xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))
    n = max(1, len(words) - SHINGLE_WORDS + 1)
    folded = hashes[:n].copy()
    with np.errstate(over="ignore"):
        for j in range(1, min(SHINGLE_WORDS, len(words))):
            folded = folded * _FOLD + hashes[j : j + n]
        return np.unique(_mix(folded + np.uint64(min(len(words), SHINGLE_WORDS))))


def half_keys(shingles: np.ndarray, halves: int = HALVES) -> np.ndarray:
    """The half-keys of A, then those of B."""
    times, plus = _minhashes(halves)
    least = np.full(len(times), np.iinfo(np.uint64).max, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for at in range(0, len(shingles), 1024):
            least = np.minimum(least, (times[:, None] * shingles[None, at : at + 1024] + plus[:, None]).min(axis=1))
        rows = least.reshape(2 * halves, ROWS)
        key = rows[:, 0].copy()
        for j in range(1, ROWS):
            key = key * _FOLD + _mix(rows[:, j])
        return _mix(key).view(np.int64)


def set_id(shingles: np.ndarray) -> int:
    """A 64-bit name of a set; equal sets are one node of the link graph."""
    with np.errstate(over="ignore"):
        return int(_mix(np.array([_mix(shingles ^ _FOLD).sum() + np.uint64(len(shingles))], dtype=np.uint64)).view(np.int64)[0])


def signatures(docs: DataFrame, halves: int = HALVES) -> DataFrame:
    """(doc_id, text_hash, n_shingles, node, halves). Without words or without an id, node is null."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, counts, nodes, keys, ends = batch.column("doc_id").to_pylist(), [], [], [], [0]
            for doc, text in zip(ids, batch.column("text"), strict=True):
                shingles = shingle_set(text.as_py())
                counts.append(len(shingles))
                named = len(shingles) > 0 and doc is not None
                nodes.append(set_id(shingles) if named else None)
                if named:
                    keys.append(half_keys(shingles, halves))
                ends.append(ends[-1] + 2 * halves * named)
            flat = np.concatenate(keys) if keys else np.empty(0, dtype=np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text_hash"), pa.array(counts, pa.int64()), pa.array(nodes, pa.int64()),
                 pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))],
                names=["doc_id", "text_hash", "n_shingles", "node", "halves"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_hash")).mapInArrow(
        sign, "doc_id long, text_hash long, n_shingles long, node long, halves array<long>")


def shared_halves(nodes: DataFrame) -> DataFrame:
    """(node, score, slot, half) of all half-keys with more than one member; a node's score counts the members it meets."""
    halves = store(nodes.select("node", F.posexplode("halves").alias("slot", "half")), "halves")
    shared = halves.groupBy("slot", "half").agg(F.count("*").alias("n")).where("n > 1")
    kept = halves.join(shared, ["slot", "half"]).groupBy("node").agg(
        F.collect_list(F.struct("slot", "half")).alias("h"), F.sum("n").alias("score"))  # at most 2 * n_halves
    return kept.select("node", "score", F.explode("h").alias("h")).select("node", "score", "h.*")


def half_stars(shared: DataFrame, n_halves: int = HALVES) -> DataFrame:
    """(a, b) of nodes that share a table, where a is the most connected member of both half-keys."""
    hubs = shared.groupBy("slot", "half").agg(F.max(F.struct("score", "node")).alias("hub"))
    meets = shared.join(hubs, ["slot", "half"]).select(F.col("hub.node").alias("a"), F.col("node").alias("b"), "slot").where("a <> b")
    return meets.groupBy("a", "b").agg(F.min("slot").alias("low"), F.max("slot").alias("high")).where(
        (F.col("low") < n_halves) & (F.col("high") >= n_halves)).select("a", "b")


def table_stars(shared: DataFrame, labels: DataFrame, n_halves: int = HALVES) -> DataFrame:
    """(hub, node) of all tables whose members have more than one label; the hub, its most connected member, included.

    Such a table's half-keys have more than one label each, so only those are
    paired. A table's rows pass its hub on as they stand sorted; of the rows, at
    most n_halves^2 a node, each task keeps one per pair.
    """
    labelled = store(shared.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node")), "halves")
    open_halves = labelled.groupBy("slot", "half").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high")
    sides = labelled.join(open_halves.select("slot", "half"), ["slot", "half"]).groupBy("node", "score", "label").agg(
        F.collect_list(F.struct("slot", "half")).alias("h")).select(
        "node", "score", "label", F.filter("h", lambda x: x["slot"] < n_halves).alias("a"), F.filter("h", lambda x: x["slot"] >= n_halves).alias("b"))
    tables = (sides.where((F.size("a") > 0) & (F.size("b") > 0))
              .select("node", "score", "label", F.explode("a").alias("a"), "b").select("node", "score", "label", "a", F.explode("b").alias("b"))
              .select(F.xxhash64("a.slot", "a.half", "b.slot", "b.half").alias("bucket"), "node", "score", "label"))
    of = Window.partitionBy("bucket")
    return tables.select("node", F.max(F.struct("score", "node")).over(of).alias("hub"), F.min("label").over(of).alias("low"),
                         F.max("label").over(of).alias("high")).where("low <> high").select(F.col("hub.node").alias("hub"), "node").distinct()


def candidate_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, shingles) of wanted (node, rep); the text that the node stands for is found by its id and told by its set."""
    found = docs.select(F.col("doc_id").cast("long").alias("rep"), "text").join(wanted, "rep")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, sets = [], []
            for node, text in zip(batch.column("node").to_pylist(), batch.column("text"), strict=True):
                shingles = shingle_set(text.as_py())
                if len(shingles) and set_id(shingles) == node:
                    nodes.append(node), sets.append(shingles.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(sets, pa.binary())], names=["node", "shingles"])

    return found.select("node", "text").mapInArrow(cut, "node long, shingles binary").dropDuplicates(["node"])


def linked(common: np.ndarray | int, a: np.ndarray | int, b: np.ndarray | int, percent: int = PERCENT) -> np.ndarray | bool:
    return 100 * common >= percent * (a + b - common)


def verified(edges: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The edges (a, b) whose full sets are linked."""
    pairs = edges.join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb")), "b").join(
        sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa")), "a")

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for sa, sb in zip(batch.column("sa"), batch.column("sb"), strict=True):
                x, y = (np.frombuffer(s.as_py(), dtype=np.uint64) for s in (sa, sb))
                at = np.searchsorted(y, x)
                at[at == len(y)] = 0
                keep.append(bool(linked(int((y[at] == x).sum()), len(x), len(y), percent)))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return pairs.select("a", "b", "sa", "sb").mapInArrow(test, "a long, b long")


def block_links(left: list[np.ndarray], right: list[np.ndarray] | None, percent: int = PERCENT) -> Iterator[tuple[int, int]]:
    """Linked pairs (i, j) between two lists of sets, or inside one, by exact counts of common shingles."""
    sets = left + (right or [])
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, column, seen = np.unique(flat, return_inverse=True, return_counts=True)
    shared = seen[column] > 1
    owner, column = owner[shared], column[shared]
    _, column = np.unique(column, return_inverse=True)
    n, m = len(left), len(right) if right is not None else len(left)
    common = np.zeros((n, m), dtype=np.float32)
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    width = 4096
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        lo, hi = np.searchsorted(column, [at, at + width])
        present = np.zeros((len(sets), width), dtype=np.float32)
        present[owner[lo:hi], column[lo:hi] - at] = 1
        common += present[:n] @ (present[n:] if right is not None else present).T
    a = np.array([len(s) for s in left])[:, None]
    b = np.array([len(s) for s in (right if right is not None else left)])[None, :]
    for i, j in np.argwhere(linked(np.rint(common).astype(np.int64), a, b, percent)):
        if right is not None or i < j:
            yield int(i), int(j)


def family_links(members: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Links inside families (family, node, label, n), all against all in blocks.

    Linked sets differ in size by a factor of 100 / percent at most, so blocks are
    cut by size class and only the same and the next class meet. Of the links
    found in a block, those that join two labels are returned, enough to
    connect what is connected.
    """
    sized = members.withColumn("size_class", F.floor(F.log(F.col("n").cast("double")) / float(np.log(100 / min(percent, 99)))).cast("int"))
    cells = sized.groupBy("family", "size_class").agg(F.count("*").alias("docs"), F.sum("n").alias("hashes")).select(
        "family", "size_class", F.ceil(F.greatest(F.col("docs") / BLOCK_DOCS, F.col("hashes") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
    after = cells.select("family", (F.col("size_class") - 1).alias("size_class"), F.col("blocks").alias("above"))
    below = cells.select("family", (F.col("size_class") + 1).alias("size_class"), F.col("blocks").alias("under"))
    placed = sized.join(cells, ["family", "size_class"]).join(after, ["family", "size_class"], "left").join(below, ["family", "size_class"], "left")
    placed = placed.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    span = lambda n: F.when(F.coalesce(n, F.lit(0)) > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    c, own = F.col("size_class"), F.col("block")
    task = lambda c1, b1, c2, b2, side: F.struct(c1.alias("c1"), b1.alias("b1"), c2.alias("c2"), b2.alias("b2"), F.lit(side).alias("side"))
    tasks = F.concat(
        F.transform(span(F.col("blocks")), lambda o: F.when(o < own, task(c, o, c, own, 1)).otherwise(task(c, own, c, o, 0))),
        F.transform(span(F.col("above")), lambda o: task(c, own, c + 1, o, 0)),
        F.transform(span(F.col("under")), lambda o: task(c - 1, o, c, own, 1)))
    dealt = placed.select("family", "node", "label", F.explode(tasks).alias("t")).select("family", "node", "label", "t.*").join(sets, "node")

    def compare(rows: pd.DataFrame) -> pd.DataFrame:
        first = rows.iloc[0]
        same = first.c1 == first.c2 and first.b1 == first.b2
        parts = [rows] if same else [rows[rows.side == 0], rows[rows.side == 1]]
        found: list[tuple[int, int]] = []
        if rows.label.nunique() > 1 and all(len(p) for p in parts):
            sets_ = [[np.frombuffer(s, dtype=np.uint64) for s in p.shingles] for p in parts]
            root = {x: x for x in rows.label}

            def top(x):
                while root[x] != x:
                    x = root[x]
                return x

            a, b = parts[0], parts[-1]
            for i, j in block_links(sets_[0], None if same else sets_[1], percent):
                x, y = top(a.label.iloc[i]), top(b.label.iloc[j])
                if x != y:
                    root[max(x, y)] = min(x, y)
                    found.append((int(a.node.iloc[i]), int(b.node.iloc[j])))
        return pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    return dealt.groupBy("family", "c1", "b1", "c2", "b2").applyInPandas(compare, "a long, b long")


def link_labels(docs: DataFrame, nodes: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(node, label) of all nodes with links."""
    halves = halves_for(percent)
    shared = store(shared_halves(nodes), "shared")
    stars = store(half_stars(shared, halves), "stars")
    named = nodes.select("node", "rep")
    near = lambda edges: edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct()
    sets = store(candidate_sets(docs, named.join(near(stars), "node")), "sets")
    links = store(verified(stars, sets, percent), "links")
    labels = components(links)
    met = store(table_stars(shared, labels, halves), "met")
    edges = store(met.where("hub <> node").select(F.col("hub").alias("a"), F.col("node").alias("b")).join(stars, ["a", "b"], "left_anti"), "stars")
    sets = sets.unionByName(store(candidate_sets(docs, named.join(near(edges).join(sets, "node", "left_anti"), "node")), "sets"))
    links = links.union(store(verified(edges, sets, percent), "links"))
    labels = components(links)
    labelled = met.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    undecided = labelled.groupBy("hub").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("hub")
    rest = store(labelled.join(undecided, "hub"), "rest")
    families = components(rest.select(F.col("hub").alias("a"), F.col("node").alias("b")))
    members = (rest.select("node", "label").distinct().join(families.select("node", F.col("label").alias("family")), "node")
               .join(nodes.select("node", F.col("n_shingles").alias("n")), "node"))
    more = store(family_links(store(members, "members"), sets, percent), "links")
    return components(links.union(more))


def duplicate_classes(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of documents."""
    return text_classes(docs, percent).drop("text_hash")


def text_classes(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(doc_id, text_hash, n_shingles, component_id, kept) for every row of documents.

    Equal sets are one node. Null or wordless texts have no shingles and are
    linked with nothing, like rows without an id, which are kept. Rows that
    repeat an id get a row each. An empty table gives none.
    """
    text_batches(docs.sparkSession)
    signed = store(signatures(docs, halves_for(percent)), "signatures")
    nodes = store(signed.where(F.col("node").isNotNull()).groupBy("node").agg(
        F.min(F.struct("doc_id", "n_shingles", "halves")).alias("s")).select(
            "node", F.col("s.doc_id").alias("rep"), "s.n_shingles", "s.halves"), "nodes")
    labels = store(link_labels(docs, nodes, percent), "labels")
    least = nodes.select("node", "rep").join(labels, "node").groupBy("label").agg(F.min("rep").alias("least"))
    named = nodes.select("node", "rep").join(labels, "node", "left").join(least, "label", "left").select(
        "node", F.coalesce("least", "rep").alias("component_id"))
    out = signed.drop("halves").join(named, "node", "left")
    component = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", "text_hash", "n_shingles", component.alias("component_id"),
                      F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def keep_one(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """One document of each class, with all its columns: the one with the least
    id. Rows that repeat an id and a text stay once; rows without an id are
    linked with nothing, but equal texts among them stay once too. Of rows
    that share an id, those go whose own text is a copy. Other columns may have any name."""
    docs, named = sheltered(docs, "doc_id", "text")
    gone = text_classes(docs, percent).where(~F.col("kept")).select(
        F.col("doc_id").alias("__gone_id"), F.col("text_hash").alias("__gone_text")).distinct()
    marked = docs.withColumns({"__gone_id": F.col("doc_id").cast("long"), "__gone_text": F.xxhash64("text")})
    left = marked.join(gone, ["__gone_id", "__gone_text"], "left_anti").dropDuplicates(["__gone_id", "__gone_text"])
    return named(left)
