"""A counterfactual-regularised toxicity classifier.

Logistic regression over the words of a text and their beginnings. Besides the
labels it fits a penalty: in labelled texts that mention a group, the mention
is swapped for others, and changes of the score are punished. So a group's name
carries no weight of its own, however often it stands in toxic texts. A text
without a mention gets one, and the same text with another name is its
counterpart: names that the labels never show are held to the same score as
well. A model states its number of pairs and their mean change of score.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqloom.llm.ranges import uniform
from seqloom.llm.storage import sheltered, store, text_batches

#: Group names that are swapped for one another, by kind, so that swaps stay grammatical.
IDENTITY_TERMS: tuple[tuple[str, ...], ...] = (
    ("women", "men", "girls", "boys", "wives", "husbands", "mothers", "fathers"),
    ("woman", "man", "girl", "boy", "mother", "father", "wife", "husband"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "catholic", "protestant", "atheist"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "catholics", "protestants", "atheists"),
    ("black", "white", "asian", "latino", "african", "european", "american", "arab"),
    ("gay", "lesbian", "bisexual", "straight", "transgender", "queer", "heterosexual"),
    ("immigrants", "refugees", "foreigners", "migrants", "natives", "citizens", "neighbours"),
    ("deaf", "blind", "disabled", "elderly", "old", "young"),
    ("frauen", "männer", "mädchen", "jungen", "ausländer", "muslime", "christen", "juden"),
    ("femmes", "hommes", "filles", "garçons", "étrangers", "musulmans", "chrétiens", "juifs"),
    ("mujeres", "hombres", "niñas", "niños", "extranjeros", "musulmanes", "cristianos", "judíos"),
)

#: About so many labelled rows are fitted at most, drawn by a hash of their id.
MAX_LABELLED = 20_000
#: Features: least number of texts, least distance of the two classes' shares in standard errors, and most in all.
MIN_TEXTS, MIN_Z, MAX_FEATURES = 3, 4.0, 20_000
#: Letters of a word's beginning that are a feature too.
PREFIX = 5
#: Weights of the penalty on weights and of that on score changes; swaps for each mention.
L2, COUNTERFACTUAL, SWAPS = 1e-3, 1.0, 4
Terms = tuple[tuple[str, ...], ...]
STEPS, RATE = 600, 0.1
#: Words whose weight a worker keeps.
MEMO_WORDS = 1 << 17

_WORD = re.compile(r"\w+")


def words(text: str | None) -> set[str]:
    return set(_WORD.findall((text or "").lower()))


def features(word: str) -> tuple[str, ...]:
    """A word and, marked by a star, its beginning."""
    return (word, word[:PREFIX] + "*") if len(word) > PREFIX else (word,)


@dataclass
class Classifier:
    bias: float
    weights: dict[str, float] = field(default_factory=dict)
    #: Counterfactual pairs of the fit, and the mean change of the log-odds between their texts.
    pairs: int = 0
    mean_change: float = 0.0

    @property
    def regularised(self) -> bool:
        return self.pairs > 0

    def word_weight(self, word: str) -> float:
        return sum(self.weights.get(f, 0.0) for f in features(word))

    def logit(self, text: str | None) -> float:
        return self.bias + sum(map(self.word_weight, words(text)))


class _Memo(dict):
    def __init__(self, model: Classifier):
        self.model = model

    def __missing__(self, word: str) -> float:
        weight = self.model.word_weight(word)
        if len(self) < MEMO_WORDS:
            self[word] = weight
        return weight


# ---- fit --------------------------------------------------------------------

def swapped(found: set[str], term: str, other: str) -> set[str]:
    return (found - {term}) | {other}


def counterfactuals(found: set[str], rng: np.random.Generator, terms: Terms = IDENTITY_TERMS) -> Iterator[tuple[str, str]]:
    """(mention, its replacement) for the group names in a text; for a text without any, one that is put in."""
    none = True
    for kind in terms:
        for term in sorted(found.intersection(kind)):
            none = False
            others = [t for t in kind if t != term]
            for k in rng.permutation(len(others))[:SWAPS]:
                yield term, others[k]
    kinds = [kind for kind in terms if len(kind) > 1]
    if none and kinds:
        kind = kinds[rng.integers(len(kinds))]
        a, b = rng.permutation(len(kind))[:2]
        yield kind[a], kind[b]


def minimise(rows: list[np.ndarray], labels: np.ndarray, pairs: list[tuple[np.ndarray, np.ndarray]], n: int) -> tuple[float, np.ndarray]:
    """Bias and weights of the least loss: mean log loss, squared weights, and
    squared score changes over swapped texts (features lost, features gained)."""

    def sparse(lists):
        return np.repeat(np.arange(len(lists)), [len(x) for x in lists]), np.concatenate(lists).astype(np.int64) if lists else np.empty(0, np.int64)

    r, c = sparse(rows)
    lost_r, lost_c = sparse([p[0] for p in pairs])
    got_r, got_c = sparse([p[1] for p in pairs])
    w, bias = np.zeros(n), float(np.log((labels.sum() + 0.5) / (len(labels) - labels.sum() + 0.5)))
    m, v, mb, vb = np.zeros(n), np.zeros(n), 0.0, 0.0
    for step in range(1, STEPS + 1):
        z = bias + np.bincount(r, weights=w[c], minlength=len(rows))
        error = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - labels) / len(rows)
        g = np.bincount(c, weights=error[r], minlength=n) + L2 / len(rows) * w
        if pairs:
            change = (np.bincount(got_r, weights=w[got_c], minlength=len(pairs)) - np.bincount(lost_r, weights=w[lost_c], minlength=len(pairs)))
            change *= COUNTERFACTUAL / len(pairs)
            g += np.bincount(got_c, weights=change[got_r], minlength=n) - np.bincount(lost_c, weights=change[lost_r], minlength=n)
        gb, rate = error.sum(), RATE * min(1.0, 2 * (1 - step / (STEPS + 1)))
        m, v, mb, vb = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g, 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        a, b = 1 - 0.9**step, 1 - 0.99**step
        w = w - rate * (m / a) / (np.sqrt(v / b) + 1e-8)
        bias -= rate * (mb / a) / (np.sqrt(vb / b) + 1e-8)
    return bias, w


def fit(labelled: DataFrame, terms: Terms = IDENTITY_TERMS) -> Classifier:
    """Fit (text, toxic) of a bounded number of rows; see ``training_rows``.

    ``terms`` are the group names to swap, by kind. A null text is empty.
    Without labels of both kinds there are no weights, and the bias states the
    share of toxic rows with half a row added to each side.
    """
    text_batches(labelled.sparkSession)
    labelled = store(labelled, "labelled")

    def occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, marks = [], []
            for text, toxic in zip(batch.column("text"), batch.column("toxic").to_pylist(), strict=True):
                own = {f for w in words(text.as_py()) for f in features(w)}
                found.extend(own), marks.extend([toxic] * len(own))
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.string()), pa.array(marks, pa.int32())], names=["feature", "toxic"])

    n, n_toxic = labelled.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    if not n_toxic or n_toxic == n:
        return Classifier(float(np.log((n_toxic + 0.5) / (n - n_toxic + 0.5))) if n else -4.6)
    share = F.col("n") / float(n)
    distance = (F.col("k") / float(n_toxic) - (F.col("n") - F.col("k")) / float(n - n_toxic)) / F.sqrt(
        share * (1 - share) * (1 / n_toxic + 1 / (n - n_toxic)) + 1e-12)
    chosen = (labelled.mapInArrow(occurrences, "feature string, toxic int").groupBy("feature")
              .agg(F.count("*").alias("n"), F.sum("toxic").alias("k")).where(f"n >= {MIN_TEXTS}")
              .withColumn("z", F.abs(distance)).where(f"z >= {MIN_Z}").orderBy(F.desc("z"), "feature").limit(MAX_FEATURES).collect())
    groups = {f for kind in terms for t in kind for f in features(t)}
    index = {f: i for i, f in enumerate(dict.fromkeys([*(r["feature"] for r in chosen), *sorted(groups)]))}

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = set(index)
        mentions = {t for kind in terms for t in kind}
        for batch in batches:
            rows, named = [], []
            for text in batch.column("text"):
                own = words(text.as_py())
                rows.append(sorted(index[f] for f in {f for w in own for f in features(w)} & known))
                named.append(sorted(own & mentions))
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array(rows, pa.list_(pa.int32())), pa.array(named, pa.list_(pa.string()))],
                                             names=["toxic", "features", "terms"])

    rows = labelled.select("text", "toxic").mapInArrow(encode, "toxic int, features array<int>, terms array<string>").toArrow().to_pylist()
    rows.sort(key=lambda r: (r["features"], r["terms"], r["toxic"]))
    rng, pairs = np.random.default_rng(7), []
    names = list(index)
    for r in rows:
        own = {names[i] for i in r["features"]}
        for term, other in counterfactuals(set(r["terms"]), rng, terms):
            stays = own if term not in r["terms"] else own - set(features(term))
            lost = [index[f] for f in features(term) if f not in stays]
            got = [index[f] for f in features(other) if f not in stays]
            pairs.append((np.array(lost, dtype=np.int64), np.array(got, dtype=np.int64)))
    bias, w = minimise([np.array(r["features"], dtype=np.int64) for r in rows], np.array([r["toxic"] for r in rows], dtype=float), pairs, len(index))
    change = float(np.mean([abs(w[got].sum() - w[lost].sum()) for lost, got in pairs])) if pairs else 0.0
    return Classifier(bias, {f: float(w[i]) for f, i in index.items() if w[i]}, len(pairs), change)


# ---- data -------------------------------------------------------------------

def fold(doc_id: str = "doc_id") -> Column:
    """Remainder of the id's checksum; rows of fold 0 are held out. A null id is in no fold."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5


def training_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(text, toxic) of labelled rows outside fold 0; of more than MAX_LABELLED
    about so many, drawn by a hash of the id. A doc_id labelled in two ways
    counts as toxic; null labels count as none."""
    usable = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & (fold() != 0))
    share = MAX_LABELLED / max(1, usable.count())
    known = (usable.where(uniform(F.col("doc_id").cast("long")) < share)
             .groupBy(F.col("doc_id").cast("long").alias("__labelled")).agg(F.max(F.col("toxic").cast("int")).alias("toxic")))
    texts = docs.select(F.col("doc_id").cast("long").alias("__id"), "text")
    # The labels are about MAX_LABELLED pairs of numbers, so texts need not be shuffled for them.
    return texts.join(F.broadcast(known), F.col("__id") == F.col("__labelled")).select("text", "toxic")


def with_score(docs: DataFrame, model: Classifier, out: str = "score") -> DataFrame:
    """All columns of ``docs`` and the probability of toxicity of the whole
    text. A null text is empty; ``out`` must be the name of no other column."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = _Memo(model)
        for batch in batches:
            z = np.array([model.bias + sum(map(memo.__getitem__, words(t.as_py()))) for t in batch.column("text")], dtype=float)
            found = pa.array(1 / (1 + np.exp(-np.clip(z, -40, 40))))
            yield pa.RecordBatch.from_arrays([*batch.columns, found], names=[*batch.schema.names, out])

    text_batches(docs.sparkSession)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema) + f", `{out}` double"
    return docs.mapInArrow(score, schema)


def document_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Score of every document, fitted outside fold 0. A null text is empty;
    every row gets a row; an empty table gives none."""
    model = fit(training_rows(docs, labels))
    scored = with_score(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), model)
    return scored.select("doc_id", F.coalesce(fold() == 0, F.lit(False)).alias("held_out"), "score",
                         (F.col("score") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents scored under 0.5, with all their columns whatever their
    names. Null texts are empty, rows without an id are scored as well, and
    repeated rows stay or go together."""
    model = fit(training_rows(docs, labels))
    rows, named = sheltered(docs, "text")
    return named(with_score(rows, model, "toxicity").where("toxicity < 0.5").drop("toxicity"))
