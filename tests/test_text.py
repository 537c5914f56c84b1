import ast
import random
import re

import pytest
from pyspark.sql import functions as F

from seqloom.functions import text as tx
from seqloom.functions import windows as win


def one(spark, value, fn):
    return spark.createDataFrame([(value,)], "v string").select(fn(F.col("v")).alias("r")).first().r


@pytest.mark.parametrize("value, bare", [
    ("C[+57.02]AA", "CAA"), ("[UNIMOD:1]S[UNIMOD:21]R", "SR"), ("A[b[c]]D", "A]D"), ("A]B[C", "A]B[C"),
    (" \tAC[x] ", "AC"), ("A[b\nc]D", "A[b\nc]D")])
def test_modifications(spark, value, bare):
    assert one(spark, value, tx.peptide_from_modified) == bare


@pytest.mark.parametrize("value, sequence", [
    ("['G', 'S[UNIMOD:21]', 'R']", "GSR"), ('["G", "R"]', "GR"), ("[]", ""), ("('G', 'R')", "GR"),
    ("['G', 'R',]", "GR"), ("'GS[x]'", "GS[x]")])
def test_strict_tokens(spark, value, sequence):
    assert one(spark, value, tx.tokens_to_sequence) == sequence


def test_strict_tokens_fail_on_other_text(spark):
    with pytest.raises(Exception, match="not a token list"):
        one(spark, "not a list", tx.tokens_to_sequence)


@pytest.mark.parametrize("value", ["['G'] junk", "[null, 'A']", "['A', 5]", "['A' 'B'", "[5]"])
def test_strict_tokens_fail_on_other_items(spark, value):
    with pytest.raises(Exception, match="not a token list"):
        one(spark, value, tx.tokens_to_sequence)


@pytest.mark.parametrize("value, key", [
    ("['G', 'S[UNIMOD:21]', 'R']", "GSR"), ("gs[UNIMOD:21]r", "GSR"), ("[bad", "[BAD"), ("[bad] x", "X"),
    ("GSR", "GSR"), (None, None), ("[42.01]PEPTIDE", "PEPTIDE"), ("[42]PEPTIDE", "PEPTIDE"), ("['G'] x", "X"),
    ("['G','S']R", "R"), ("['G', 5]", "G5")])
def test_lenient_key(spark, value, key):
    assert one(spark, value, tx.prediction_key) == key


def test_lenient_key_prints_literals_as_they_are(spark):
    items = ["'A'", '"B[x]"', "None", "True", "False", "5", "-5", "+5", "0", "-0", "00", "1e5", "1.5", "-2.", ".5", "1e16", "1.25e-7", "-0.0", "123456789.125",
             "1E+300", "1e-5", "0.0001", "'it\\'s'", "'\\x41'", "'\\u0042'", "' '", "1e400", "-1e400"]
    rng = random.Random(0)
    values = [f"[{i}]" for i in items] + [f"[{', '.join(rng.choices(items, k=rng.randint(0, 5)))}{rng.choice(['', ','])}]" for _ in range(200)]
    values += ["[05]", "[nope]", "['A' 'B']", "[[1]]", "[,]", "[1, ,2]"]

    def plain(value):
        try:
            joined = "".join(str(t) for t in ast.literal_eval(value))
        except (ValueError, SyntaxError):
            joined = value
        return re.sub(r"\[.*?\]", "", joined).strip().upper()

    got = spark.createDataFrame([(v,) for v in values], "v string").select("v", tx.prediction_key(F.col("v")).alias("r")).collect()
    assert {r.v: r.r for r in got if r.v not in ("[,]", "['A' 'B']", "[[1]]")} == {v: plain(v) for v in values if v not in ("[,]", "['A' 'B']", "[[1]]")}


@pytest.mark.parametrize("fn, value, expected", [
    (tx.fold_li, "AIi", "ALi"), (tx.fold_li_upper, "AIi", "ALL"), (tx.strip_stops, "**MK**", "MK"),
    (tx.strip_trailing_stops, "*MK*", "*MK"), (tx.clean_residues, "*macde*", "MACDE"),
    (tx.count_or_zero, "3.7", 3), (tx.count_or_zero, "x", 0), (tx.key_upper, " gsr\t", "GSR")])
def test_scalars(spark, fn, value, expected):
    assert one(spark, value, fn) == expected


def test_wrapping(spark):
    seq = "A" * 60 + "C" * 60 + "GG"
    rows = spark.createDataFrame([("a", seq), ("b", ""), ("c", "A" * 60)], "id string, seq string")
    got = [r.r for r in rows.select(tx.fasta_record(F.col("id"), F.col("seq"), 60).alias("r")).collect()]
    assert got == [">a\n" + "A" * 60 + "\n" + "C" * 60 + "\nGG", ">b", ">c\n" + "A" * 60]


@pytest.mark.parametrize("seq, k, skip, expected", [
    ("MACDE", 3, True, ["ACD", "CDE", "MAC"]), ("CDEXF", 3, True, ["CDE"]), ("CDEXF", 3, False, ["CDE", "DEX", "EXF"]),
    ("AC", 3, True, []), ("", 1, True, []), ("AAAA", 2, True, ["AA"]), ("ÄAÄA", 3, True, ["AÄA", "ÄAÄ"]),
    ("A*CC", 2, True, ["CC"])])
def test_windows(spark, seq, k, skip, expected):
    assert sorted(one(spark, seq, lambda c: win.distinct_kmers(c, k, skip))) == expected


def test_window_counts(spark):
    total = one(spark, "CDEXF", lambda c: win.window_count(c, 3) * 100 + win.clean_window_count(c, 3))
    assert total == 301
