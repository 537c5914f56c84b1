import collections
import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from seqloom.llm import fingerprints, quality_rules, sharding
from seqloom.llm.ranges import range_of, running_sums, splitters

WORD = re.compile(r"[^\x20\x09-\x0D]+")


# ---- sharding ---------------------------------------------------------------

@pytest.mark.parametrize("source", ["docs", "sample"])
def test_shards_are_even_and_gapless(request, source):
    docs = request.getfixturevalue(source)
    rows = sharding.document_shards(docs, 5).collect()
    expected = sorted((str(r["doc_id"]), len((r["text"] or "").encode()) + 16, zlib.crc32((r["text"] or "").encode())) for r in docs.collect())
    assert sorted((str(r["doc_id"]), r["size"], r["text_crc32"]) for r in rows) == expected
    slots, sizes = collections.defaultdict(list), collections.Counter()
    for r in rows:
        slots[r["shard"]].append(r["slot"])
        sizes[r["shard"]] += r["size"]
        assert (r["law"], r["grown_shard"]) == ("bytes", None)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(sizes.values()) - sum(sizes.values()) / 5 <= max(r["size"] for r in rows)


def test_a_hot_key_is_cut_and_columns_may_clash(spark):
    rows = spark.range(3000).select(F.lit(7).cast("long").alias("k"), F.col("id").alias("i"), F.lit(10).cast("long").alias("w"),
                                    F.lit("x").alias("shard"), F.lit("y").alias("extra"), F.lit("z").alias("__range"))
    got = sharding.assign_shards(rows, ["k", "i"], "w", 4, range_bytes=500).collect()
    counts = collections.Counter(r["shard"] for r in got)
    assert len(got) == 3000 and set(counts) == {0, 1, 2, 3} and max(counts.values()) - min(counts.values()) <= 2
    assert got[0]["extra"] == "y" and got[0]["__range"] == "z"


def test_empty_table_has_no_shards(no_docs):
    assert sharding.document_shards(no_docs).count() == 0


def test_ranges_follow_the_bounds(spark):
    rows = spark.range(1000).select((F.col("id") % 10).alias("a"), F.col("id").cast("string").alias("b"), F.lit(1).cast("long").alias("w"))
    bounds = splitters(rows, ["a", "b"], "w", 40)
    assert len(bounds) > 20 and bounds == sorted(set(bounds))
    for r in rows.select("a", "b", range_of(rows, ["a", "b"], bounds).alias("r")).collect():
        assert r["r"] == sum(x <= (r["a"], r["b"]) for x in bounds)


def test_running_sums(spark):
    rows = spark.range(200).select((F.col("id") % 3).alias("m"), (F.col("id") % 5).alias("n"), "id", (F.col("id") * 2).alias("v"))
    got = sorted(running_sums(rows, ["m", "n"], ["id"], {"before": "v"}).collect(), key=lambda r: (r["m"], r["n"], r["id"]))
    at = 0
    for r in got:
        assert r["before"] == at
        at += r["v"]


# ---- quality rules ----------------------------------------------------------

def base(text):
    text = text or ""
    words = WORD.findall(text)
    n = len(words)
    windows = collections.Counter(tuple(words[i : i + 3]) for i in range(n - 2))
    covered = {j for i in range(n - 2) if windows[tuple(words[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    seen, dups = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dups += line in seen
            seen.add(line)
    failed = n < 50 or 100 * len(covered) > 50 * n
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dups, len(covered), failed


@pytest.mark.parametrize("source", ["docs", "sample"])
def test_counts_equal_brute_force(request, source):
    docs = request.getfixturevalue(source)
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    got = quality_rules.document_quality(docs).collect()
    assert sorted((str(r["doc_id"]), *[r[n] for n in names]) for r in got) == sorted((str(r["doc_id"]), *base(r["text"])) for r in docs.collect())
    assert not any(r["kept"] and r["base_failed"] for r in got)


def test_verdict_is_the_posterior_of_the_fitted_model(sample):
    voted = quality_rules.with_votes(quality_rules.with_counts(sample)).select("__q_votes")
    patterns = collections.Counter(r[0] for r in voted.collect())
    model = quality_rules.fit(patterns)
    got = voted.select("__q_votes", quality_rules.posterior(model).alias("p")).distinct().collect()
    for r in got:
        odds = model.log_odds(r["__q_votes"])
        assert r["p"] == pytest.approx(1 / (1 + 2.718281828459045 ** -odds), rel=1e-6)


def test_voting_junk_goes_and_prose_stays():
    good, bad = "ggggggggg", "bbbgggggg"
    model = quality_rules.fit({good: 900, bad: 60, "gggbbgggg": 50, "ggggggg-g": 40, "gggggggbg": 3})
    assert model.log_odds(good) > 0 and model.log_odds("gggggggbg") > 0 and model.log_odds("ggggggg-g") > 0
    assert model.log_odds(bad) < 0 and model.log_odds("gggbbgggg") < 0
    assert all(a > 0.9 for a, _ in map(model.accuracy, range(9)))


def test_planted_accuracies_are_recovered():
    """Votes drawn with known rates, conditionally independent; a fifth of the votes are abstentions."""
    rng = random.Random(11)
    alarms, detections, good_share = [0.005, 0.01, 0.02, 0.03, 0.05, 0.01, 0.002], [0.8, 0.6, 0.4, 0.7, 0.5, 0.3, 0.15], 0.8
    patterns = collections.Counter()
    for _ in range(30_000):
        rates = alarms if rng.random() < good_share else detections
        patterns["".join("-" if rng.random() < 0.2 else "b" if rng.random() < r else "g" for r in rates)] += 1
    model = quality_rules.fit(patterns)
    assert model.good == pytest.approx(good_share, abs=0.03)
    for j, (alarm, detection) in enumerate(zip(alarms, detections, strict=True)):
        assert model.on_good[j]["b"] == pytest.approx(alarm, abs=0.012) and model.on_bad[j]["b"] == pytest.approx(detection, abs=0.06)


def test_filter_keeps_whole_rows(docs, no_docs):
    clashing = docs.withColumns({"__q_extra": F.lit(1), "__q_text": F.lit("x"), "__q_words": F.lit(7), "failed": F.lit(False)})
    kept = quality_rules.keep_good(clashing)
    assert kept.columns == clashing.columns and kept.where("__q_text != 'x' or __q_words != 7 or failed").count() == 0
    verdict = sorted(str(r["doc_id"]) for r in quality_rules.document_quality(docs).where("kept").collect())
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == verdict
    assert quality_rules.keep_good(no_docs).count() == 0 and quality_rules.document_quality(no_docs).count() == 0


# ---- fingerprints -----------------------------------------------------------

@pytest.mark.parametrize(("source", "bytes_"), [("docs", 1 << 30), ("docs", 300), ("sample", 20_000)])
def test_edited_texts_and_likeness(request, monkeypatch, source, bytes_):
    monkeypatch.setattr(fingerprints, "RANGE_BYTES", bytes_)
    docs = request.getfixturevalue(source)
    got = fingerprints.document_fingerprints(docs).collect()
    rows = sorted(((r["doc_id"], r["text"] or "") for r in docs.collect()), key=lambda r: (r[0] is not None, r[0] or 0))
    expected = []
    for (doc, text), (_, after) in zip(rows, rows[1:] + rows[:1], strict=True):
        cut = len(text) // 4
        edited = text[: len(text) - cut] + after[:cut]
        expected.append((str(doc), len(text), hashlib.sha256(edited.encode()).hexdigest()))
    assert sorted((str(r["doc_id"]), r["n_chars"], r["edited_sha256"]) for r in got) == sorted(expected)
    texts = dict(rows)
    by_text = collections.defaultdict(set)
    for r in got:
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
        by_text[texts[r["doc_id"]]].add(r["fingerprint"])
    assert all(len(v) == 1 for v in by_text.values())
    assert not fingerprints.document_fingerprints(docs.where("false")).count()


def test_near_beats_next(sample):
    got = [r for r in fingerprints.document_fingerprints(sample).collect() if r["n_chars"] > 300]
    assert sum(r["near_edited"] > 0.3 for r in got) > 0.95 * len(got)
    assert sum(r["near_next"] < 0.1 for r in got) > 0.9 * len(got)


def anchors(units, k=fingerprints.K, s=fingerprints.S):
    """Positions of closed syncmers among units, with the hash of S units given."""
    inner = [units[i] for i in range(len(units))]
    found = []
    for i in range(len(units) - (k - s)):
        window = inner[i : i + k - s + 1]
        if min(window) in (window[0], window[-1]):
            found.append(i)
    return found


def test_anchors_are_closed_syncmers(spark):
    text = " ".join(f"w{(i * i) % 97}" for i in range(300))
    df = spark.createDataFrame([(text,)], "text string")
    units = text.split(" ")
    hashes = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(zip(units, units[1:], strict=False))], "i int, a string, b string")
    inner = [r["h"] for r in hashes.select("i", F.xxhash64(F.xxhash64("a"), F.xxhash64("b")).alias("h")).orderBy("i").collect()]
    got = fingerprints.with_anchors(df, "text", "found", positions=True).first()["found"]
    assert [a["position"] for a in got] == anchors(inner)


def test_passages_match_by_position(spark):
    shared = " ".join(f"s{i}" for i in range(80))
    left = spark.createDataFrame([("a", "intro words here " + shared)], "id string, text string")
    right = spark.createDataFrame([("b", shared + " and an end"), ("c", "nothing in common at all with the other text of this test")], "id string, text string")
    found = fingerprints.matches(*[fingerprints.with_anchors(x, "text", "anchors", positions=True) for x in (left, right)]).collect()
    assert len(found) > 10 and {(r["right_id"], r["left_position"] - r["right_position"]) for r in found} == {("b", 3)}


def test_short_texts_have_anchors(spark):
    texts = [(n, i, " ".join(f"{n:x}.{i:x}.{j:x}" for j in range(n))) for n in range(1, 16) for i in range(12)]
    df = spark.createDataFrame([*texts, (0, 0, ""), (0, 1, " \n")], "n int, i int, text string")
    df = fingerprints.with_anchors(fingerprints.with_anchors(df, "text", "a"), "text", "p", positions=True)
    got = df.select("n", "a", "p").collect()
    assert all((len(r["a"]) > 0) == (r["n"] > 0) and [x["hash"] for x in r["p"]] == r["a"] for r in got)
    assert all(0 <= x["position"] <= max(0, r["n"] - fingerprints.K) for r in got for x in r["p"])
    pairs = df.where("n in (0, 9)").select("n", "i", "a")
    pairs = pairs.alias("l").crossJoin(pairs.alias("r").select(F.col("n").alias("m"), F.col("i").alias("j"), F.col("a").alias("b")))
    for r in pairs.select("n", "i", "m", "j", fingerprints.likeness("a", "b").alias("like")).collect():
        assert r["like"] == (1.0 if r["n"] == r["m"] == 0 or (r["n"], r["i"]) == (r["m"], r["j"]) else 0.0)


@pytest.mark.parametrize("script", ["".join(chr(0x4E00 + i * 37) for i in range(300)), "".join(chr(0x0E01 + i * i % 46) for i in range(300)),
                                    "".join(hashlib.sha256(bytes([i])).hexdigest() for i in range(5))])
def test_unbroken_passages_match_at_any_offset(spark, script):
    rows = [("a", script), ("b", "q" * 3 + script), ("c", script[:100] + "q" + script[100:]), ("d", script[40:200])]
    rows += [("e", script[:100]), ("f", script[100:])]
    df = fingerprints.with_anchors(spark.createDataFrame(rows, "id string, text string"), "text", "anchors", positions=True)
    got = {r["id"]: [(x["position"], x["hash"]) for x in r["anchors"]] for r in df.collect()}
    hashes = {i: {h for _, h in found} for i, found in got.items()}
    assert len(got["a"]) > 40
    assert all(h in hashes["b"] for h in hashes["a"])
    assert all(h in hashes["c"] for p, h in got["a"] if p + fingerprints.K <= 100 or p >= 100)
    for name, low, high in (("d", 40, 200), ("e", 0, 100), ("f", 100, len(script))):
        assert {h for p, h in got["a"] if p >= low and p + fingerprints.K <= high} == hashes[name]
