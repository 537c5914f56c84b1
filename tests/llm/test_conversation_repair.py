import collections
import hashlib
import random
import re
import zlib
from functools import lru_cache

import pytest
from pyspark.sql import functions as F

from seqloom.llm import conversation_repair as cr

SCHEMA = "conv_id long, turn long, role string, text string, position int"
NAMES = {"u": "user", "a": "assistant"}


def damaged(rows):
    out = []
    for conv, turn, role, text, *_ in rows:
        role, text = " " if role is None else role, " " if text is None else text
        fault = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if fault == 0:
            continue
        text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
        out += [(conv, turn, "user" if fault == 4 else role, text)] * (2 if fault == 3 else 1)
    return out


def targets(n):
    yield ""
    for k in range(1, n + 3):
        yield "ua" * k
        yield "s" + "ua" * k


def best_repair(turns):
    """turns: (initial, must go, cut). Least (cost, audit) over all targets, without bands or blocks."""
    best = None
    for want in targets(len(turns)):
        @lru_cache(None)
        def go(i, j, want=want):
            ways = []
            if i == len(turns) and j == len(want):
                return (0, "")
            if i < len(turns):
                initial, must, cut = turns[i]
                ways.append((3, "D", i + 1, j))
                if j < len(want) and not must:
                    if initial == want[j]:
                        ways.append((cut, "K", i + 1, j + 1))
                    if want[j] in "ua":
                        ways.append((2 + cut, "R", i + 1, j + 1))
            if j < len(want) and want[j] in "ua":
                ways.append((2, "I", i, j + 1))
            tails = [(c, e, go(a, b)) for c, e, a, b in ways]
            return min(((c + t[0], e + t[1]) for c, e, t in tails if t), default=None)

        got = go(0, 0)
        if got and (best is None or got < best[0]):
            best = (got, want)
    return best


def brute(rows):
    by_conv = collections.defaultdict(list)
    for r in damaged(rows):
        by_conv[r[0]].append(r[1:])
    out = []
    for conv in {r[0] for r in rows}:
        own = sorted(by_conv[conv], key=lambda r: (r[0] is not None, r[0] or 0, hashlib.sha256(f"{len(r[1])}:{r[1]}{r[2]}".encode()).digest()))
        seen, turns, counts = set(), [], collections.Counter()
        for _, role, text in own:
            blank, again = not re.search(r"[^\x20\x09-\x0D]", text), (role, text) in seen
            cut = not blank and re.findall(r"[^\x20\x09-\x0D]", text)[-1] not in ".!?"
            seen.add((role, text))
            counts["blank" if blank else "duplicate" if again else "truncated" if cut else "fine"] += 1
            turns.append((role[:1], blank or again, int(cut)))
        illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(turns, turns[1:], strict=False))
        known = [t for t, _, _ in own if t is not None]
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        (cost, audit), want = best_repair(turns)
        lines, i = [], 0
        for e in audit:
            if e != "D":
                role = own[i][1] if e == "K" else NAMES[want[len(lines)]]
                lines.append(f"{role}:{'' if e == 'I' else own[i][2]}")
            i += e != "I"
        out.append((conv, gaps, counts["blank"], counts["duplicate"], counts["truncated"], illegal, cost, audit,
                    hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=str)


COLUMNS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def report(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in cr.repair_report(df).collect()), key=str)


def test_sample_equals_brute_force(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")
    assert report(df) == brute([tuple(r) for r in df.collect()])


@pytest.mark.parametrize("block", [3, 16])
def test_random_conversations_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(cr, "BLOCK_TURNS", block)
    cr.block_repairs.cache_clear()
    rng = random.Random(block)
    roles, texts = ["user", "assistant", "system", "u", "", "tool", "Assistant", None], ["Hi.", "No end", "ok!", " ", "", "Hi. \n", None, "why?\t", "é漢"]
    rows = []
    for conv in [*range(120), None]:
        for _ in range(rng.randint(1, 11)):
            rows.append((conv, rng.choice([None, *range(12), 10**12]), rng.choice(roles[: rng.randint(1, 8)]), rng.choice(texts) if rng.random() < 0.7 else f"t{rng.random()}.", 1))
    assert report(spark.createDataFrame(rows, SCHEMA).repartition(3)) == brute(rows)
    cr.block_repairs.cache_clear()


def test_long_conversations_go_by_blocks():
    rng = random.Random(5)
    for n in (15, 16, 17, 40):
        for kinds in ("uaUA-sx", "uaua-", "us", "ax"):
            turns = "".join(rng.choice(kinds) for _ in range(n))
            (cost, audit), _ = best_repair([(t.lower(), t == "-", int(t.isupper())) for t in turns])
            assert cr.repair_audit(turns) == (cost, audit), turns
    turns = "".join(rng.choice("uaUA-sx") for _ in range(2000))
    cost, audit = cr.repair_audit(turns)
    assert sum(e != "I" for e in audit) == len(turns) and cost > 0


def test_bands_change_nothing():
    rng = random.Random(6)
    for _ in range(300):
        turns = "".join(rng.choice("uaUA-s") for _ in range(rng.randint(0, 7)))
        for want in targets(4):
            wide = cr.align(turns, want, 10**6, True)
            if wide:
                assert cr.align(turns, want, wide[0], True) == wide
                assert cr.align(turns, want, wide[0] - 1, True) is None


def test_all_rows_dropped_and_empty_table(spark):
    dropped = next(c for c in range(10**6) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    df = spark.createDataFrame([(dropped, 0, "user", "Hi.", 1)], SCHEMA)
    assert report(df) == [(dropped, 0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())]
    assert report(df.where("false")) == []


def test_repaired_turns_read_well(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")
    turns = cr.damaged_turns(df)
    fixed = cr.repaired_turns(turns, cr.audits(turns)).groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("position", "role", "edit", "text"))).alias("t"))
    for r in fixed.collect():
        assert [t["position"] for t in r["t"]] == list(range(len(r["t"])))
        assert re.fullmatch("(s?(ua)+)?", "".join(t["role"][0] for t in r["t"]))
        assert all((t["edit"] == "I") <= (t["text"] == "") for t in r["t"])
