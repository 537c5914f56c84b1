import random
import tracemalloc
import zlib
from functools import lru_cache

import numpy as np
import pytest
from tokenizers import Tokenizer

from seqloom.llm import packing, token_counts, token_files
from seqloom.llm.encoding import Encoder, vocabulary
from seqloom.llm.storage import shared_path

BYTES, WORDS = vocabulary("byte_bpe_50k.json"), vocabulary("word_bpe_49k.json")


@lru_cache
def tokenizer_of(path):
    return Tokenizer.from_file(path)


def plain(path, text):
    return tokenizer_of(path).encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("path", [BYTES, WORDS])
def test_pieces_encode_as_the_whole_text(path):
    rng, encoder, tokenizer = random.Random(3), Encoder(path), Tokenizer.from_file(path)
    letters = [*"ab Σ's \n\t\x1c\0 ́é<|>1½漢ςAİſ\xa0\xad", "<|endoftext|>", "<|startoftext|>", "  ", " \n", "'ll", "</w>", "</s>", " word", " été,", " Zoë.", " ĲĻ!"]
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 14))) for _ in range(5000)]
    for text, ids in zip(texts, encoder.encode_all(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids, repr(text)


def test_memo_overflow_changes_nothing(monkeypatch):
    monkeypatch.setattr("seqloom.llm.encoding.MEMO_BYTES", 2000)
    encoder = Encoder(BYTES)
    texts = [f"word{i} and word{i % 7} again" for i in range(40)] * 2
    got = [encoder.encode(t) for t in texts]
    assert [np.frombuffer(g, "<u4").tolist() for g in got] == [plain(BYTES, t) for t in texts]


@pytest.mark.parametrize("path", [BYTES, WORDS])
def test_known_words_are_not_encoded_again_with_signs(path, monkeypatch):
    encoder, given, encode = Encoder(path), [], Encoder._encode
    monkeypatch.setattr(Encoder, "_encode", lambda self, pieces: given.extend(pieces) or encode(self, pieces))
    first, then = "so été Bar and Bar, foo.\nBar 7 foo", "so, Bar. été.\nBar. foo, and.\nBar, and, 7"
    assert [np.frombuffer(ids, "<u4").tolist() for ids in encoder.encode_all([first])] == [plain(path, first)]
    before = len(given)
    assert [np.frombuffer(ids, "<u4").tolist() for ids in encoder.encode_all([then])] == [plain(path, then)]
    assert given[before:] == []


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@pytest.mark.parametrize("source", ["docs", "sample"])
def test_token_files_round_trip(spark, request, source):
    docs = request.getfixturevalue(source)
    path = shared_path(spark, "files")
    got = sorted((r["start"], r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in token_files.token_file_digest(docs, path, BYTES).collect())
    rows = [(r["doc_id"], [*plain(BYTES, r["text"]), 0]) for r in docs.collect()]
    assert sorted((str(d), n, c) for _, d, n, c in got) == sorted((str(d), len(i), crc(i)) for d, i in rows)
    order = [-(2**63) if d is None else d for _, d, _, _ in got]
    assert order == sorted(order)
    at = 0
    for start, _, n, _ in got:
        assert start == at
        at += n


def test_one_document_is_read_by_itself(spark, docs):
    path = shared_path(spark, "files")
    token_files.write_token_files(docs, path, BYTES)
    row = token_files.read_token_files(spark, path, doc_id=9).collect()
    text = docs.where("doc_id = 9").first()["text"]
    assert [np.frombuffer(r["ids"], "<u4").tolist() for r in row] == [[*plain(BYTES, text), 0]]
    assert token_files.read_token_files(spark, path, doc_id=12345).count() == 0


def test_no_documents_no_tokens(spark, no_docs):
    assert token_files.token_file_digest(no_docs, shared_path(spark, "files"), BYTES).count() == 0
    assert token_counts.limit_totals(token_counts.length_histogram(no_docs, BYTES)).count() == 0
    assert packing.document_packing(no_docs, WORDS).count() == 0


@pytest.mark.parametrize("source", ["docs", "sample"])
def test_histogram_answers_every_limit(request, source):
    docs = request.getfixturevalue(source)
    lengths = [len(plain(BYTES, r["text"])) for r in docs.collect()]
    totals = token_counts.limit_totals(token_counts.length_histogram(docs, BYTES)).cache()
    for r in totals.collect():
        c = r["length"]
        assert (r["n_docs"], r["docs_at_least"]) == (lengths.count(c), sum(x >= c for x in lengths))
        assert r["tokens_at_least"] == sum(x for x in lengths if x >= c)
        assert r["truncated_total"] == sum(min(x, c) for x in lengths)
        assert r["tokens_cut"] == sum(lengths) - r["truncated_total"]
        assert r["share_fitting"] == pytest.approx(sum(x <= c for x in lengths) / len(lengths))
    for limit in (0, 1, 100, 777, 10**6):
        assert token_counts.truncated_total(totals, limit) == sum(min(x, limit) for x in lengths)
    assert token_counts.quantile_length(totals, 0.5) == sorted(lengths)[(len(lengths) - 1) // 2]


def check_packing(rows, docs, cap):
    expected = []
    for d in docs.collect():
        ids = [*plain(WORDS, d["text"]), 0]
        expected += [(str(d["doc_id"]), k, at, len(ids[at : at + cap]), crc(ids[at : at + cap])) for k, at in enumerate(range(0, len(ids), cap))]
    assert sorted((str(r["doc_id"]), r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == sorted(expected)
    filled = {}
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        assert filled.get(r["sequence_id"], 0) == r["offset"]
        filled[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(filled.values()) <= cap
    return len(filled), -(-sum(filled.values()) // cap)


@pytest.mark.parametrize(("source", "cap"), [("docs", 2048), ("docs", 64), ("sample", 2048), ("sample", 100)])
def test_packing_is_whole_and_tight(request, source, cap):
    docs = request.getfixturevalue(source)
    n, least = check_packing(packing.document_packing(docs, WORDS, cap).collect(), docs, cap)
    assert n <= least + max(2, 0.03 * least)


def test_sequences_hold_the_ids(docs):
    packed = packing.pack(packing.pieces(docs, WORDS, 64, with_ids=True), 64)
    pieces = {(r["sequence_id"], r["offset"]): bytes(r["ids"]) for r in packed.collect()}
    for r in packing.sequences(packed).collect():
        own = [v for k, v in sorted(pieces.items()) if k[0] == r["sequence_id"]]
        assert bytes(r["ids"]) == b"".join(own) and r["piece_lengths"] == [len(x) // 4 for x in own]


def test_plan_places_every_length():
    rng = np.random.default_rng(0)
    for cap in (1, 2, 10, 300):
        counts = {length: int(n) for length, n in enumerate(rng.integers(0, 50, cap + 1)) if length and n}
        plan = packing.plan_sequences(counts, cap)
        placed = {}
        for lengths, times in plan:
            assert sum(lengths) <= cap and times > 0
            for length in lengths:
                placed[length] = placed.get(length, 0) + times
        assert placed == counts


def test_nnls_solves_and_stays_positive():
    rng = np.random.default_rng(1)
    for _ in range(20):
        a, b = rng.normal(size=(12, 8)), rng.normal(size=12)
        x = packing.nnls(a, b)
        gradient = a.T @ (a @ x - b)
        assert (x >= 0).all() and (gradient > -1e-6).all() and abs(gradient[x > 0]).max(initial=0) < 1e-6


def test_new_words_are_merged_by_lines(monkeypatch):
    """Asking the model for each new word by itself took most of the encoding's time."""
    encoder = Encoder(BYTES)
    text = " ".join(f"{a}{b}{c}" for a in ("thin", "Été", "on") for b in ("wher", "ß", "ti", "\xff") for c in ("ed", "an", "er,", "!?", "\n")) + " 漢 7 \xb5"
    given = []

    class Spy:
        def __getattr__(self, name):
            given.append(name)
            return getattr(tokenizer_of(BYTES), name)

    encoder._tokenizer = Spy()
    assert [np.frombuffer(ids, "<u4").tolist() for ids in encoder.encode_all([text, None, text])] == [plain(BYTES, text), [], plain(BYTES, text)]
    assert "model" not in given


@pytest.mark.parametrize("path", [BYTES, WORDS])
def test_memory_of_new_words_is_bounded(path):
    """A group's words and the remembered ones were held as Python objects."""
    rng, encoder = random.Random(5), Encoder(path)
    parts = ["an", "th", "er", "wh", "on", "ti", "ed", "in"]
    texts = [" ".join("".join(rng.choices(parts, k=7)) for _ in range(5000)) for _ in range(40)]
    tracemalloc.start()
    for _ in encoder.encode_all(texts):
        pass
    held, peak = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert held < 16 << 20 and peak < 80 << 20
