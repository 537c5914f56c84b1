"""Weak supervision of quality rules, in column expressions alone.

Rules look at counts of a text and vote good, bad, or not at all.
Expectation-maximisation over the votes of all documents estimates how often
each rule is right for good and for bad documents, and a document is kept if
its posterior probability of being good is high enough: one odd count does not
condemn a text, and no labels are used.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqloom.llm.storage import sheltered, store

WORD = r"[^\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
#: Documents under this many words fail, as do those with more than half their words in repeated windows.
LEAST_WORDS = 50
#: Posterior probability of being good from which a document is kept.
KEEP_FROM = 0.85
#: Means of the beta priors of how often a rule votes bad on good documents and on bad ones, and of the share of good ones.
FALSE_ALARM, DETECTION, GOOD = 0.01, 0.3, 0.85
#: Votes that a prior counts for; that of false alarms counts for a share of all documents as well, as rules are written to spare good text.
PRIOR_VOTES, PRIOR_SHARE = 20.0, 0.1


def _without(text: str, characters: str) -> Column:
    return F.length(text) - F.length(F.translate(text, characters, ""))


def with_counts(df: DataFrame, text: str = "text") -> DataFrame:
    """Add the counts that the rules look at, in columns named ``__q_...``.

    A null text counts as empty. Windows of three words are compared by 64-bit
    hashes, which differ for different words but for about one pair in 10^19.
    """
    df = df.withColumn("__q_text", F.coalesce(F.col(text), F.lit("")))
    df = df.withColumns({
        "__q_w": F.regexp_extract_all("__q_text", F.lit(WORD), F.lit(0)),
        "__q_l": F.filter(F.split("__q_text", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]")),
        "__q_chars": F.length(F.translate("__q_text", SPACES, "")),
        "__q_symbols": _without("__q_text", SYMBOLS),
        "__q_shouts": _without("__q_text", "!?"),
        "__q_letters": F.length(F.regexp_replace("__q_text", r"[^\p{L}]+", "")),
        "__q_upper": F.length(F.regexp_replace("__q_text", r"[^\p{Lu}]+", "")),
    })
    w, n = F.col("__q_w"), F.size("__q_w")
    df = df.withColumns({
        "__q_words": n,
        "__q_lines": F.size("__q_l"),
        "__q_dup_lines": F.size("__q_l") - F.size(F.array_distinct("__q_l")),
        "__q_h": F.transform(F.slice(w, F.lit(1), F.greatest(n - 2, F.lit(0))),
                             lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2))),
    })
    # Only a text with a repeated window is sorted; equal windows then are neighbours.
    repeats = F.size(F.array_distinct("__q_h")) < F.size("__q_h")
    df = df.withColumn("__q_s", F.when(repeats, F.array_sort(F.transform("__q_h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    s = F.col("__q_s")
    again = F.transform(s, lambda x, j: F.when((F.get(s, j - 1)["h"] == x["h"]) | (F.get(s, j + 1)["h"] == x["h"]), x["i"]))
    df = df.withColumn("__q_again", F.filter(again, lambda i: i.isNotNull()))
    covered = F.size(F.array_distinct(F.flatten(F.transform("__q_again", lambda i: F.array(i, i + 1, i + 2)))))
    return df.withColumn("__q_repeat", F.when(s.isNull(), F.lit(0)).otherwise(covered)).drop(
        "__q_text", "__q_w", "__q_l", "__q_h", "__q_s", "__q_again")


@dataclass(frozen=True)
class Rule:
    """A name, when it votes bad, and when it votes good; else it abstains."""

    name: str
    bad: str
    good: str


#: One rule for each count: two cuts of one count would bring the same fact as two witnesses.
RULES = (
    Rule("symbols", "__q_symbols * 10 > __q_words", "__q_symbols * 50 <= __q_words"),
    Rule("letters", "__q_letters * 10 < __q_chars * 8", "__q_letters * 100 >= __q_chars * 88"),
    Rule("capitals", "__q_upper * 10 > __q_letters * 4", "__q_upper * 10 <= __q_letters * 2"),
    Rule("shouting", "__q_shouts * 10 > __q_words * 3", "__q_shouts * 20 <= __q_words"),
    Rule("repeats", "__q_repeat * 10 > __q_words * 3", "__q_repeat * 10 <= __q_words"),
    Rule("lines", "__q_dup_lines * 10 > __q_lines * 3", "__q_dup_lines * 10 <= __q_lines"),
    Rule("word_length", "__q_chars < __q_words * 2 or __q_chars > __q_words * 15", "__q_chars between __q_words * 3 and __q_words * 12"),
)


def base_failed() -> Column:
    return (F.col("__q_words") < LEAST_WORDS) | (F.col("__q_repeat") * 100 > F.col("__q_words") * 50)


def with_votes(df: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Add ``__q_votes``: a letter for each rule: g, b, or - for an abstention. No words, no votes."""
    vote = lambda r: F.when(F.col("__q_words") == 0, "-").when(F.expr(r.bad), "b").when(F.expr(r.good), "g").otherwise("-")
    return df.withColumn("__q_votes", F.concat(*[vote(r) for r in rules]))


@dataclass(frozen=True)
class Model:
    """Share of good documents; for each rule, how often it votes b and g on
    good and on bad ones, where it votes. An abstention is no evidence."""

    good: float
    on_good: tuple[dict[str, float], ...]
    on_bad: tuple[dict[str, float], ...]

    def weight(self, rule: int, vote: str) -> float:
        """Log-odds of being good that a vote adds."""
        return 0.0 if vote == "-" else math.log(self.on_good[rule][vote] / self.on_bad[rule][vote])

    def log_odds(self, votes: str) -> float:
        return math.log(self.good / (1 - self.good)) + sum(self.weight(j, v) for j, v in enumerate(votes))

    def accuracy(self, rule: int) -> tuple[float, float]:
        """How often a vote of the rule is right: on good and on bad documents."""
        return self.on_good[rule]["g"], self.on_bad[rule]["b"]


def fit(patterns: dict[str, int], rounds: int = 300) -> Model:
    """Expectation-maximisation over the counted vote patterns of all documents.

    There are at most three to the power of the number of rules patterns,
    whatever the number of documents. All rates are posterior means under beta
    priors; that of false alarms also keeps the two classes from trading
    places. Without documents the priors stand.
    """
    width, total = len(next(iter(patterns), "")), sum(patterns.values())
    priors = ((FALSE_ALARM, PRIOR_VOTES + PRIOR_SHARE * total), (DETECTION, PRIOR_VOTES))
    start_good, start_bad = ({"b": mean, "g": 1 - mean} for mean, _ in priors)
    model = Model(GOOD, (start_good,) * width, (start_bad,) * width)
    for _ in range(rounds):
        good = {p: 1 / (1 + math.exp(-max(-500.0, min(500.0, model.log_odds(p))))) for p in patterns}
        share = (sum(n * good[p] for p, n in patterns.items()) + GOOD * PRIOR_VOTES) / (total + PRIOR_VOTES)
        on_good, on_bad = [], []
        for j in range(width):
            for (mean, weight), found, of in ((priors[0], on_good, good), (priors[1], on_bad, {p: 1 - g for p, g in good.items()})):
                seen = {v: weight * (mean if v == "b" else 1 - mean) + sum(n * of[p] for p, n in patterns.items() if p[j] == v) for v in "bg"}
                bad = seen["b"] / (seen["b"] + seen["g"])
                found.append({"b": bad, "g": 1 - bad})
        new = Model(share, tuple(on_good), tuple(on_bad))
        moved = abs(new.good - model.good) + sum(
            abs(x[v] - y[v]) for x, y in zip(new.on_good + new.on_bad, model.on_good + model.on_bad, strict=True) for v in "bg")
        model = new
        if moved < 1e-7:
            break
    return model


def fit_votes(voted: DataFrame) -> Model:
    return fit({r["__q_votes"]: r["n"] for r in voted.groupBy("__q_votes").agg(F.count("*").alias("n")).collect()})


def posterior(model: Model) -> Column:
    """Probability of being good from ``__q_votes``."""
    odds = F.lit(math.log(model.good / (1 - model.good)))
    for j in range(len(model.on_good)):
        vote = F.substring("__q_votes", j + 1, 1)
        odds = odds + F.when(vote == "g", model.weight(j, "g")).when(vote == "b", model.weight(j, "b")).otherwise(model.weight(j, "-"))
    return 1 / (1 + F.exp(-odds))


def document_quality(docs: DataFrame) -> DataFrame:
    """Counts and verdict of every document. Null texts are empty and fail;
    repeated rows each get their row; an empty table gives none."""
    counted = with_votes(with_counts(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))).drop("text")
    counted = store(counted, "votes")
    probability = posterior(fit_votes(counted))
    long = lambda c: F.col(f"__q_{c}").cast("long")
    return counted.select(
        "doc_id", long("words").alias("n_words"), long("chars").alias("word_chars"), long("symbols").alias("n_symbols"),
        long("dup_lines").alias("n_dup_lines"), long("repeat").alias("n_repeat_words"), base_failed().alias("base_failed"),
        (~base_failed() & (probability >= KEEP_FROM)).alias("kept"), probability.alias("p_good"))


def keep_good(docs: DataFrame) -> DataFrame:
    """The documents kept, with all their columns whatever their names. Null
    texts are empty and fail; repeated rows stay or go together.

    The counts are made once: rows are stored with their votes, and those kept
    are read from there.
    """
    rows, named = sheltered(docs, "text")
    voted = with_votes(with_counts(rows)).select(*rows.columns, base_failed().alias("failed"), F.col("__q_votes"))
    voted = store(voted, "voted")
    return named(voted.where(~F.col("failed") & (posterior(fit_votes(voted)) >= KEEP_FROM)))
