import hashlib
import itertools
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from seqloom.llm import chat, mixing, near_dedup, queries, toxicity
from seqloom.llm.encoding import vocabulary
from seqloom.llm.graph import components
from seqloom.llm.storage import store

BYTES = vocabulary("byte_bpe_50k.json")


# ---- near duplicates --------------------------------------------------------

def shingles(text):
    words = (text or "").encode().lower().split()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def classes(rows):
    """Brute force over (doc_id, text): smallest doc_id reachable by links."""
    sets = [(d, shingles(t)) for d, t in rows]
    root = {d: d for d, _ in sets if d is not None}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for (a, x), (b, y) in itertools.combinations([s for s in sets if s[0] is not None and s[1]], 2):
        if 100 * len(x & y) >= 85 * len(x | y):
            a, b = top(a), top(b)
            root[max(a, b)] = min(a, b)
    return sorted((str(d), len(s), str(None if d is None else top(d)), d is None or top(d) == d) for d, s in sets)


def family(rng, n):
    """A text and n edited copies, from hardly to heavily changed, and copies of copies."""
    base = [f"w{rng.integers(400)}" for _ in range(150)]
    texts = [base]
    for i in range(n):
        words = list(texts[rng.integers(len(texts))] if i % 3 == 0 else base)
        for _ in range(int(rng.integers(0, 12))):
            words[rng.integers(len(words))] = f"e{rng.integers(10**6)}"
        texts.append(words)
    return [" ".join(t) for t in texts]


@pytest.mark.parametrize("block", [512, 16])
def test_classes_equal_brute_force(spark, docs, sample, monkeypatch, block):
    monkeypatch.setattr(near_dedup, "BLOCK_DOCS", block)
    rng = np.random.default_rng(5)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()] + [(1000 + r["doc_id"], r["text"]) for r in sample.collect()]
    rows += [(5000 + i, t) for i, t in enumerate(family(rng, 60) + family(rng, 8))]
    got = near_dedup.duplicate_classes(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"]), r["kept"]) for r in got) == classes(rows)


def test_one_of_each_group_stays(docs, no_docs):
    kept = near_dedup.keep_one(docs.withColumn("node", F.lit("n"))).collect()
    assert kept[0].asDict().keys() == {*docs.columns, "node"}
    ids = Counter(r["doc_id"] for r in kept)
    assert 0 in ids and 1 not in ids and ids[7] == 1 and 8 not in ids and {2, 3, 4} <= ids.keys()
    assert near_dedup.keep_one(no_docs).count() == 0 and near_dedup.duplicate_classes(no_docs).count() == 0


def test_rows_that_share_an_id_go_by_their_text(spark):
    copied, other = (" ".join(f"{c}{i}" for i in range(40)) for c in "ab")
    docs = spark.createDataFrame([(3, copied), (7, copied + " "), (7, other), (8, other)], "doc_id long, text string").repartition(2)
    assert sorted(tuple(r) for r in near_dedup.keep_one(docs).collect()) == [(3, copied), (7, other)]


def test_pipeline_links_from_80_percent(spark):
    from fractions import Fraction

    words = [f"w{i}" for i in range(504)]
    # 500 shingles; n new words at the end leave 500 - n of them, and 500 + n in the union.
    texts = {i: " ".join(words[: 504 - n] + [f"e{i}.{j}" for j in range(n)]) for i, n in enumerate([0, 55, 56, 50])}
    like = lambda x, y: Fraction(len(x & y), len(x | y))
    found = [like(shingles(texts[0]), shingles(t)) for t in texts.values()]
    assert [x >= Fraction(4, 5) for x in found] == [True, True, False, True] and max(found[1:]) < Fraction(85, 100)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    stage = dict(corpus_pipeline.STAGES)["near_dedup"]
    assert sorted(r["doc_id"] for r in stage(spark, docs, "").collect()) == [0, 2]
    assert near_dedup.keep_one(docs).count() == 4
    assert near_dedup.halves_for(85) == near_dedup.HALVES and 2 * (1 - 0.8**4) ** near_dedup.halves_for(80) < 2e-5


def test_near_copies_meet_without_a_row_for_each_table(spark, monkeypatch):
    words, other = [f"w{i}" for i in range(400)], [f"v{i}" for i in range(300)]
    texts = [" ".join(words[:i * 4] + ["new"] + words[i * 4 + 1:]) for i in range(40)] + [" ".join(words[:100] + other)]
    stored, store = {}, near_dedup.store

    def counted(df, name="table"):
        out = store(df, name)
        stored[name] = max(stored.get(name, 0), out.count())
        return out

    monkeypatch.setattr(near_dedup, "store", counted)
    rows = [(i, t) for i, t in enumerate(texts)]
    got = near_dedup.duplicate_classes(spark.createDataFrame(rows, "doc_id long, text string"), 80).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == {i: 0 if i < 40 else 40 for i in range(41)}
    assert max(stored.values()) <= 2 * near_dedup.halves_for(80) * len(rows)


def test_components(spark):
    chain = [(i, i + 1) for i in range(60)] + [(100, 101), (102, 101), (7, 7)]
    got = {r["node"]: r["label"] for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(61), 0), 100: 100, 101: 100, 102: 100}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# ---- chat -------------------------------------------------------------------

CONTROL = ["</s>", "[INST] ok [/INST]", "<|end|>", "<|user|>", "\\", "\\<|", "<|>", "<<SYS>>", "a|", "<", "|>", ""]


def test_turns_are_read_back():
    for role, text in itertools.product(["user", "a|>b", "<|", "", "x|", "\\"], CONTROL + [a + b for a, b in itertools.product(CONTROL, CONTROL)]):
        written, begin, end = chat.format_turn(role, text)
        assert chat.parse_turn(written) == (role, text)
        assert chat.unescape(written[begin:end]) == text
        assert not any(c in written[begin:end] for c in ("<|", "|>", "</s>", "[INST]", "[/INST]", "<<SYS>>"))


TURNS = [(i, k, "user" if k % 2 == 0 else "assistant", f"turn {k if k < 2 else (i % 3, k)} {CONTROL[k % 12]}") for i in range(30) for k in range(1 + i % 5)]
TURNS += [(50, 0, None, None), (50, None, "assistant", "early"), (50, 0, None, None), (None, 1, "assistant", "lost"), (51, 0, "assistant", "é漢\U0001f600")]


def digests(rows):
    grouped = defaultdict(list)
    for conv, turn, role, text in rows:
        grouped[conv].append((turn is not None, turn or 0, role or "", text or ""))
    out = []
    for conv, turns in grouped.items():
        turns.sort()
        said = "".join(t[3] for t in turns if t[2] == "assistant")
        whole = "".join(f"{t[2]}\n{t[3]}\n" for t in turns)
        out.append((str(conv), len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(said), hashlib.sha256(said.encode()).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize(("chars", "ranges"), [(1 << 18, 1 << 21), (60, 100)])
def test_conversations_survive(spark, monkeypatch, chars, ranges):
    monkeypatch.setattr(chat, "RANGE_CHARS", ranges)
    rows = spark.createDataFrame(TURNS, "conv_id long, turn long, role string, text string").withColumn("path", F.lit(1)).repartition(3)
    segments = chat.format_conversations(rows, BYTES, chars).cache()
    got = chat.read_conversations(segments).collect()
    names = ["n_turns", "turns_sha256", "loss_chars", "loss_sha256"]
    assert sorted((str(r["conv_id"]), *[r[n] for n in names]) for r in got) == digests(TURNS)
    if chars == 1 << 18:
        assert segments.agg(F.sum(F.size("node_parent"))).first()[0] < len(TURNS) / 1.5  # shared turns stand once
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(BYTES)
    for s in segments.collect():
        ids = np.frombuffer(s["token_ids"], "<u4")
        for k, parent in enumerate(s["node_parent"]):
            a, b = s["token_start"][k], s["token_end"][k]
            assert tokenizer.decode(ids[a:b].tolist(), skip_special_tokens=False) == s["text"][s["node_start"][k] : s["node_end"][k]]
            chain, p = [], k
            while p >= 0:
                chain = [*range(s["token_start"][p], s["token_end"][p]), *chain]
                p = s["node_parent"][p]
            spans = s["attention"][k]
            assert [i for x, y in zip(spans[::2], spans[1::2], strict=True) for i in range(x, y)] == chain
            assert s["position_ids"][a:b] == list(range(len(chain) - (b - a), len(chain)))


def test_shared_turns_stand_once_at_any_depth(spark):
    long = [f"t{i}" for i in range(60)]
    said = {1: [*long[:9], "x"], 2: [*long[:8], "z"], 3: [*long[:9], "y"], 4: [*long, "p"], 5: [*long[:50], "q"], 6: [*long, "r"]}
    rows = [(c, k, "user", t) for c, turns in said.items() for k, t in enumerate(turns)]
    segments = chat.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), BYTES)
    nodes = len({tuple(turns[: k + 1]) for turns in said.values() for k in range(len(turns))})
    assert [len(r["node_parent"]) for r in segments.collect()] == [nodes]


def test_segments_are_held_a_few_at_a_time(spark, monkeypatch, tmp_path):
    from pyarrow import parquet

    stored = {}

    def kept(df, name, *more):
        stored[name] = store(df, name, *more)
        return stored[name]

    monkeypatch.setattr(chat, "GROUP_BYTES", 1 << 20, raising=False)
    monkeypatch.setattr(chat, "store", kept)
    monkeypatch.setattr(queries, "store", kept)
    words = random.Random(3)
    rows = [(c, k, ("user", "assistant")[k], "".join(words.choices("abcdefghij kl", k=40_000))) for c in range(60) for k in range(2)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").coalesce(1).write.parquet(f"{tmp_path}/conversations.parquet")
    read = queries.op3_prefix_tree_chat(spark, str(tmp_path))
    told = "</s>[INST] ok [/INST]"
    expected = digests([*rows, (-7, 0, "user", told), (-7, 1, "assistant", told)])
    names = ["n_turns", "turns_sha256", "loss_chars", "loss_sha256"]
    assert sorted((str(r["conv_id"]), *[r[n] for n in names]) for r in read.collect()) == expected
    for name in ("paths", "segments"):
        footers = [parquet.ParquetFile(f.removeprefix("file:")).metadata for f in stored[name].inputFiles()]
        groups = [m.row_group(i) for m in footers for i in range(m.num_row_groups)]
        assert sum(g.num_rows for g in groups) == stored[name].count()
        assert all(g.num_rows == 1 or g.total_byte_size < 4 << 20 for g in groups)
    plan = read._jdf.queryExecution().executedPlan().toString()
    assert "text" in plan and not any(c in plan for c in ("token_ids", "position_ids", "attention"))


def test_no_conversations(spark):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.read_conversations(chat.format_conversations(empty, BYTES)).count() == 0


# ---- mixing -----------------------------------------------------------------

def test_shortages_go_to_siblings_first():
    supply = {("a", "x"): 10.0, ("a", "y"): 100.0, ("b", "z"): 1000.0}
    assert mixing.leaf_budgets(supply, 100) == {("a", "x"): 10.0, ("a", "y"): 40.0, ("b", "z"): 50.0}
    got = mixing.leaf_budgets(supply, 400)
    assert got == {("a", "x"): 10.0, ("a", "y"): 100.0, ("b", "z"): 290.0}
    assert mixing.leaf_budgets(supply, 80, {("a",): 3.0, ("a", "y"): 5.0}) == {("a", "x"): 10.0, ("a", "y"): 50.0, ("b", "z"): 20.0}
    assert mixing.leaf_budgets(supply, 10**9) == supply and mixing.leaf_budgets({}, 5) == {}


def test_leaves_take_prefixes_of_epochs(docs, no_docs, sample):
    for table, epochs, share in ((sample, 2, 0.7), (sample, 3, 1.6), (docs, 2, 0.5)):
        path, size = mixing.document_path(), mixing.word_count()
        taken = mixing.mix(table.withColumn("epoch", F.lit("old")), path, size, share, epochs, mixing.WEIGHTS).collect()
        names = table.withColumns({"d": path[0], "l": F.coalesce("lang", F.lit("")), "s": F.coalesce("source", F.lit("")), "n": size}).collect()
        supply, largest = Counter(), Counter()
        leaf_of = {}
        for r in names:
            leaf = (r["d"], r["l"], r["s"])
            leaf_of[r["lang"], r["source"]] = leaf
            supply[leaf] += r["n"]
            largest[leaf] = max(largest[leaf], r["n"])
        budgets = mixing.leaf_budgets({k: float(v) * epochs for k, v in supply.items()}, share * sum(supply.values()), mixing.WEIGHTS)
        got, per_epoch = Counter(), defaultdict(Counter)
        for r in taken:
            leaf = leaf_of[r["lang"], r["source"]]
            got[leaf] += r["mix_tokens"]
            per_epoch[leaf, r["epoch"]][r["doc_id"], r["text"]] += 1
        rows = Counter((r["doc_id"], r["text"]) for r in names)
        for leaf, budget in budgets.items():
            assert budget - 1e-6 <= got[leaf] <= budget + largest[leaf] or got[leaf] == supply[leaf] * epochs
        for counts in per_epoch.values():
            assert all(n <= rows[k] for k, n in counts.items())
    assert mixing.mix(no_docs, mixing.document_path(), mixing.word_count(), 0.5, 2).count() == 0


# ---- toxicity ---------------------------------------------------------------

def labelled(spark, n=400):
    rng = np.random.default_rng(2)
    rows = []
    for i in range(n):
        toxic = i % 5 == 0
        words = [f"w{rng.integers(50)}" for _ in range(20)]
        if toxic:
            words[3] = "moron"
        if i % 5 in (0, 1):  # the group is named mostly where the text is toxic
            words[7] = "muslims" if toxic or i % 3 == 0 else "christians"
        rows.append((" ".join(words), int(toxic)))
    return spark.createDataFrame(rows, "text string, toxic int")


def test_group_names_carry_no_weight(spark, monkeypatch):
    model = toxicity.fit(labelled(spark))
    assert model.logit("w1 moron w2") > 0 > model.logit("w1 muslims w2 w3") and model.logit("") < 0
    gap = abs(model.word_weight("muslims") - model.word_weight("christians"))
    monkeypatch.setattr(toxicity, "COUNTERFACTUAL", 0.0)
    free = toxicity.fit(labelled(spark))
    assert gap < 0.2 * abs(free.word_weight("muslims") - free.word_weight("christians"))


def test_pairs_arise_without_mentions(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    rows = toxicity.training_rows(docs, labels)
    model = toxicity.fit(rows)
    assert model.regularised and model.pairs >= rows.count() and 0 <= model.mean_change < 0.05
    own = toxicity.fit(labelled(spark), terms=(("muslims", "christians"), ("alone",)))
    assert own.pairs == labelled(spark).count() and not toxicity.fit(labelled(spark), terms=()).regularised


def test_batches_score_as_the_model_does(docs):
    model = toxicity.Classifier(-0.5, {"quick": 1.5, "brown": -0.25, "alpha": 0.125, "delta": 2.0, "wörds": 3.0, "epsil*": -4.0})
    for r in toxicity.with_score(docs.select("text"), model, "p").collect():
        assert r["p"] == pytest.approx(1 / (1 + np.exp(-model.logit(r["text"]))))


def test_stages_handle_odd_and_empty_tables(spark, docs, no_docs, tmp_path):
    spark.createDataFrame([(0, 1, 1), (5, 1, 0), (7, 0, 0), (8, 1, None), (None, 0, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    odd = docs.withColumns({"__toxicity": F.lit(1), "__q_words": F.lit("a"), "__gone_id": F.lit(2), "sequence": F.lit(3)})
    for table in (odd, odd.where("false"), odd.unionByName(odd)):
        kept = table
        for _, stage in corpus_pipeline.STAGES[:-1]:
            before, kept = kept, stage(spark, kept, str(tmp_path)).cache()
            assert kept.columns == before.columns and kept.exceptAll(before).count() == 0
        packed = corpus_pipeline.STAGES[-1][1](spark, kept, str(tmp_path)).collect()
        assert {r["doc_id"] for r in packed} == {r["doc_id"] for r in kept.collect()}


def test_scores_of_every_row(spark, docs, no_docs):
    labels = spark.createDataFrame([(0, 1), (0, 0), (5, None), (None, 1), (7, 0), (77, 1)], "doc_id long, toxic int")
    got = toxicity.document_toxicity(docs, labels).collect()
    assert len(got) == docs.count() and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got)
    import zlib

    assert all(r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)
    assert toxicity.document_toxicity(no_docs, labels).count() == 0
    assert toxicity.document_toxicity(docs, labels.where("false")).where("predicted = 1").count() == 0
    kept = toxicity.drop_toxic(docs.withColumn("score", F.lit("mine")), labels)
    assert kept.columns == [*docs.columns, "score"]


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    held = toxicity.document_toxicity(docs, labels).where("held_out").join(labels, "doc_id").collect()
    right = sum(r["predicted"] == r["toxic"] for r in held) / len(held)
    assert right > 0.9


# ---- pipeline ---------------------------------------------------------------

def test_stages_take_what_their_predecessor_kept(spark):
    sf_dir = "/root/testdata/sf0.001"
    docs = before = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, before, sf_dir).cache()
        assert docs.columns == before.columns
        assert docs.exceptAll(before).count() == 0 and docs.count() >= 0.5 * before.count(), name
        before = docs
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir)
    assert {r[0] for r in packed.select("doc_id").distinct().collect()} == {r["doc_id"] for r in docs.collect()}
    assert packed.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 2048").count() == 0
