"""Repair of the turn structure of conversations by target alignment.

A well-formed conversation's roles read ``(s?(ua)+)?`` by their initials, so
for every length there is one target string at most. A conversation's turns are
aligned to the target of each feasible length by Wagner and Fischer's table:
Keep costs 0, Rerole 2, Delete 3, Insert 2, and a turn that ends in the middle
of a sentence costs 1 if it stays. Blank and repeated turns must be deleted.
A table is computed inside a band only: a cell that cannot lead to the cost of
the best target so far is left out (Ukkonen), and so is a whole length. Of the
cheapest alignments the one whose audit, the edits' initials in order, comes
first in ASCII is taken.

Long conversations are aligned in blocks of BLOCK_TURNS turns. A block is
aligned from each state in which it may begin (nothing yet, after a system
turn, a user or an assistant expected) to each in which it may end, again by
targets of every length, and the cheapest chain of blocks is kept. An inserted
turn belongs to the block of the turn behind it, so every block's audit ends in
the edit of its last turn; none is a prefix of another, and the chain's audit
is the least of all. Time is in proportion to the turns, memory to one byte of
each turn of a conversation beside its audit.

Null roles and texts become one space, as a role that fits nowhere and as a
blank text. Rows without a conv_id are one conversation. Rows of equal turn
are ordered by a digest of role and text, null turns first. Repeated rows are
duplicates of the first. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqloom.llm.storage import store, text_batches

REROLE, DELETE, INSERT, CUT = 2, 3, 2, 1
#: Turns that are aligned together, and the alignments of such blocks that a worker remembers.
BLOCK_TURNS, REMEMBERED = 16, 1 << 14
NAMES = {"s": "system", "u": "user", "a": "assistant"}
SPACES = " \t\n\x0b\x0c\r"
#: States between turns: nothing written, a system turn alone, an assistant expected, a user expected. A conversation may end in the first and last.
EMPTY, SYSTEM, WANTS_A, WANTS_U = range(4)
ENDS = (EMPTY, WANTS_U)
LARGEST = 2**63 - 1


# ---- alignment --------------------------------------------------------------

def target(state: int, end: int, length: int) -> str | None:
    """The roles of ``length`` turns that lead from one state to another, if there are any."""
    if length == 0:
        return "" if state == end else None
    if state != EMPTY:
        first = "au" if state == WANTS_A else "ua"
        written = (first * (length // 2 + 1))[:length]
        return written if end == (WANTS_A if written[-1] == "u" else WANTS_U) else None
    if end == SYSTEM:
        return "s" if length == 1 else None
    if end == EMPTY or (end == WANTS_U and length == 1):
        return None
    plain = (length % 2 == 0) == (end == WANTS_U)
    return ("ua" * (length // 2 + 1))[:length] if plain else "s" + ("ua" * (length // 2 + 1))[: length - 1]


def _stays(turn: str) -> tuple[str, int]:
    """The role of a turn and the cost of leaving it in: capitals end in the middle of a sentence."""
    return turn.lower(), CUT if turn.isupper() else 0


def align(turns: str, roles: str, most: int, open_end: bool) -> tuple[int, str] | None:
    """Least cost of at most ``most`` and the first audit of that cost that
    turn ``turns`` into ``roles``, or None.

    A turn is the initial of its role, ``x`` if it is none of the three, in
    capitals if its text is cut; ``-`` must be deleted. Only with ``open_end``
    may turns be inserted behind the last one.
    """
    n, m, far = len(turns), len(roles), 1 << 60
    forced = [0] * (n + 1)
    for i in range(n - 1, -1, -1):
        forced[i] = forced[i + 1] + (turns[i] == "-")

    def at_least(rows_left: int, free: int, wanted: int) -> int:
        """Cost below which ``free`` turns that may stay cannot become ``wanted`` ones."""
        return DELETE * (rows_left - free) + (INSERT * (wanted - free) if wanted > free else DELETE * (free - wanted))

    # cost[i][j]: least cost of the turns from i on against the roles from j on; cells outside the band are far.
    before = [i - (forced[0] - forced[i]) for i in range(n + 1)]  # turns before i that may stay
    cost = [[far] * (m + 1) for _ in range(n + 1)]
    for i in range(n, -1, -1):
        row, below = cost[i], cost[i + 1] if i < n else None
        free = before[n] - before[i]
        if i < n:
            turn = turns[i]
            role, extra = _stays(turn)
        for j in range(m, -1, -1):
            if at_least(i, before[i], j) + at_least(n - i, free, m - j) > most:
                continue
            best = far
            if i == n:
                best = 0 if j == m else row[j + 1] + INSERT if open_end and roles[j] != "s" else far
            else:
                best = below[j] + DELETE
                if j < m:
                    if row[j + 1] + INSERT < best and roles[j] != "s":
                        best = row[j + 1] + INSERT
                    if turn != "-":
                        if role == roles[j]:
                            stay = below[j + 1] + extra
                        else:
                            stay = below[j + 1] + extra + REROLE if roles[j] != "s" else far
                        if stay < best:
                            best = stay
            row[j] = best
    if cost[0][0] > most:
        return None
    audit, i, j = [], 0, 0
    while i < n or j < m:
        now = cost[i][j]
        if i < n and cost[i + 1][j] + DELETE == now:  # in ASCII order: D, I, K, R
            edit = "D"
        elif j < m and roles[j] != "s" and (i < n or open_end) and cost[i][j + 1] + INSERT == now:
            edit = "I"
        else:
            edit = "K" if _stays(turns[i])[0] == roles[j] else "R"
        audit.append(edit)
        i += edit != "I"
        j += edit != "D"
    return cost[0][0], "".join(audit)


@lru_cache(maxsize=REMEMBERED)
def block_repairs(turns: str, state: int, last: bool) -> tuple[tuple[int, int, str], ...]:
    """(end state, least cost, first audit) of a block for each state in which it may end."""
    free = sum(t != "-" for t in turns)
    forced = DELETE * (len(turns) - free)
    found = []
    for end in ENDS if last else range(4):
        best: tuple[int, str] | None = None
        longest = 2 * len(turns) + 4  # beyond this every further pair of roles is inserted
        for length in sorted(range(longest + 1), key=lambda x: abs(x - free)):
            roles = target(state, end, length)
            if roles is None:
                continue
            bound = forced + (INSERT * (length - free) if length > free else DELETE * (free - length))
            most = best[0] if best else DELETE * len(turns) + INSERT * length
            if bound <= most and (got := align(turns, roles, most, last)) and (best is None or got < best):
                best = got
        if best is not None:
            found.append((end, *best))
    return tuple(found)


def repair_audit(turns: str) -> tuple[int, str]:
    """Least cost and first audit of a conversation, block by block."""
    states = {EMPTY: (0, "")}
    blocks = [turns[i : i + BLOCK_TURNS] for i in range(0, len(turns), BLOCK_TURNS)] or [""]
    chains: list[dict[int, tuple[str, int]]] = []
    costs = {EMPTY: 0}
    # Forward: for each state the cheapest chain; equal costs are told apart by the audits, which are built only then.
    for number, block in enumerate(blocks):
        reached: dict[int, list[tuple[int, int, str]]] = {}
        for state, cost in costs.items():
            for end, more, audit in block_repairs(block, state, number == len(blocks) - 1):
                reached.setdefault(end, []).append((cost + more, state, audit))
        costs, back = {}, {}
        for end, ways in reached.items():
            least = min(w[0] for w in ways)
            ways = [w for w in ways if w[0] == least]
            best = ways[0]
            for other in ways[1:]:
                if _first(chains, other[1], other[2], best[1], best[2]):
                    best = other
            costs[end], back[end] = least, (best[2], best[1])
        chains.append(back)
    if not turns:
        return 0, ""
    ends = [e for e in ENDS if e in costs]
    least = min(costs[e] for e in ends)
    audits = [_chain(chains, len(chains), e) for e in ends if costs[e] == least]
    return least, min(audits)


def _chain(chains: list[dict[int, tuple[str, int]]], upto: int, state: int) -> str:
    parts = []
    for back in reversed(chains[:upto]):
        audit, state = back[state]
        parts.append(audit)
    return "".join(reversed(parts))


def _first(chains: list[dict[int, tuple[str, int]]], state: int, audit: str, other: int, its: str) -> bool:
    """Does the chain to ``state`` with ``audit`` come before the other one?"""
    a, b, differ = state, other, None
    for back in reversed(chains):
        if a == b:
            break
        (one, a), (two, b) = back[a], back[b]
        if one != two:
            differ = one < two  # an earlier block decides over a later one
    return audit < its if differ is None else differ


# ---- turns ------------------------------------------------------------------

def clean_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, same): nulls as spaces; ``same`` is a digest
    of role and text, by which rows of equal turn are ordered."""
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit(" ")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit(" ")).alias("text"))
    return rows.withColumn("same", same_turn())


def same_turn() -> Column:
    return F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256))


def _trimmed(text: str) -> Column:
    return F.rtrim(F.col(text), F.lit(SPACES))


def _order(*more: str) -> list:
    return [F.asc_nulls_first("turn"), "same", *more]


#: What the audits say of a conversation beside its id.
AUDIT_SCHEMA = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
_LEGAL = {"su", "ua", "au"}


def audits(turns: DataFrame) -> DataFrame:
    """One row per conversation of ``clean_turns``: its faults, the least cost of a repair and its audit.

    Texts stay where they are: a turn travels as its initial, its faults and
    its digest, and is read in order, a byte of it kept until its conversation ends.
    """
    body = _trimmed("text")
    initial = F.substring("role", 1, 1)
    narrow = turns.select("conv_id", "turn", "same", (body == "").alias("blank"), (~F.right(body, F.lit(1)).isin(".", "!", "?")).alias("cut"),
                          F.when(initial.isin("s", "u", "a"), initial).otherwise("x").alias("initial"))
    earlier = Window.partitionBy("conv_id", "same").orderBy(F.asc_nulls_first("turn"))
    marked = narrow.withColumn("again", F.row_number().over(earlier) > 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, held = (), None  # no id equals the empty tuple

        def close(conv, h) -> list:
            low, high, distinct = h["low"], h["high"], h["distinct"]
            gaps = 0 if low is None else min(high - low + 1 - distinct, LARGEST)
            cost, audit = repair_audit(h["turns"].decode())
            return [conv, gaps, h["blank"], h["duplicate"], h["truncated"], h["illegal"], cost, audit]

        def rows_of(batch):
            return zip(*[batch.column(c).to_pylist() for c in ("conv_id", "turn", "blank", "cut", "initial", "again")], strict=True)

        def out(rows: list) -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True)) or [[]] * 8
            types = [pa.int64()] * 7 + [pa.string()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)],
                                              names=[c.split(" ")[0] for c in AUDIT_SCHEMA.split(", ")])

        for batch in batches:
            done = []
            for conv, turn, blank, cut, initial, again in rows_of(batch):
                if current != conv or held is None:
                    if held is not None:
                        done.append(close(current, held))
                    current = conv
                    held = {"low": None, "high": None, "distinct": 0, "turns": bytearray(), "blank": 0, "duplicate": 0, "truncated": 0,
                            "illegal": 0, "before": None}
                if turn is not None and turn != held["high"]:  # turns ascend
                    held["low"] = turn if held["low"] is None else held["low"]
                    held["high"], held["distinct"] = turn, held["distinct"] + 1
                if held["before"] is not None and held["before"] + initial not in _LEGAL:
                    held["illegal"] += 1
                held["before"] = initial
                held["blank"] += blank
                held["duplicate"] += again and not blank
                held["truncated"] += cut and not (blank or again)
                held["turns"] += b"-" if blank or again else (initial.upper() if cut else initial).encode()
            if done:
                yield out(done)
        if held is not None:
            yield out([close(current, held)])

    # Of equal rows the first is the one that is no repetition.
    ordered = marked.repartition("conv_id").sortWithinPartitions("conv_id", *_order("again"))
    return ordered.mapInArrow(run, AUDIT_SCHEMA)


#: A turn after repair: where it stands in its conversation, its edit, and the turn it comes from (null if inserted).
REPAIRED_SCHEMA = "conv_id long, position long, role string, text string, edit string, turn long"


def repaired_turns(turns: DataFrame, audited: DataFrame) -> DataFrame:
    """The turns of the repaired conversations.

    Each partition holds whole conversations, in order of their turns; a later
    step without a shuffle may read them as a stream. A task holds one audit
    and one batch of rows.
    """
    text_batches(turns.sparkSession)
    heads = audited.select("conv_id", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"),
                           F.col("audit").alias("text"), F.lit(b"").alias("same"))
    rows = heads.unionByName(turns.select("conv_id", F.lit(1).alias("kind"), "turn", "role", "text", "same"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64())
        state: dict = {}

        def inserts(conv, out: list) -> None:
            """Turns that the audit inserts at the present place."""
            audit = state["audit"]
            while state["at"] < len(audit) and audit[state["at"]] == "I":
                write(conv, out, "I", NAMES[state["roles"][state["position"] % 2 ^ state["shift"]]], "", None)
                state["at"] += 1

        def write(conv, out: list, edit: str, role: str, text: str, turn) -> None:
            out.append((conv, state["position"], role, text, edit, turn))
            state["position"] += 1

        for batch in batches:
            out: list[tuple] = []
            for conv, kind, turn, role, text in zip(*[batch.column(c).to_pylist() for c in ("conv_id", "kind", "turn", "role", "text")], strict=True):
                if kind == 0:
                    length = sum(e != "D" for e in text)
                    # The target of an odd length begins with the system turn.
                    state = {"audit": text, "at": 0, "position": 0, "roles": "ua", "shift": length % 2, "left": sum(e != "I" for e in text)}
                else:
                    inserts(conv, out)
                    edit = state["audit"][state["at"]]
                    state["at"] += 1
                    state["left"] -= 1
                    if edit != "D":
                        write(conv, out, edit, role if edit == "K" else NAMES[state["roles"][state["position"] % 2 ^ state["shift"]]], text, turn)
                    if state["left"] == 0:
                        inserts(conv, out)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)],
                                                 names=[c.split(" ")[0] for c in REPAIRED_SCHEMA.split(", ")])

    ordered = rows.repartition("conv_id").sortWithinPartitions("conv_id", "kind", *_order())
    return ordered.mapInArrow(run, REPAIRED_SCHEMA)


def repaired_digests(repaired: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256) of ``role:text`` lines, read from the partitions of ``repaired_turns`` as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, digest = None, None

        def out(rows: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string())],
                                              names=["conv_id", "repaired_sha256"])

        for batch in batches:
            done = []
            for conv, position, role, text in zip(*[batch.column(c).to_pylist() for c in ("conv_id", "position", "role", "text")], strict=True):
                if position == 0:
                    if digest is not None:
                        done.append((current, digest.hexdigest()))
                    current, digest = conv, hashlib.sha256()
                else:
                    digest.update(b"\n")
                digest.update(f"{role}:{text}".encode())
            if done:
                yield out(done)
        if digest is not None:
            yield out([(current, digest.hexdigest())])

    return repaired.mapInArrow(run, "conv_id long, repaired_sha256 string")


# ---- the query's damage -----------------------------------------------------

def damaged_turns(conversations: DataFrame) -> DataFrame:
    """``clean_turns`` with the faults that a checksum of conversation and turn
    deals: a row dropped, emptied, stripped of its sentence ends, repeated, or given to the user."""
    rows = clean_turns(conversations)
    name = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    rows = rows.withColumn("fault", F.crc32(name.cast("binary")) % 20).where("fault != 0")
    text = F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("fault") == 4, "user").otherwise(F.col("role"))
    times = F.explode(F.when(F.col("fault") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), times.alias("copy")).drop("copy").withColumn("same", same_turn())


def repair_report(conversations: DataFrame) -> DataFrame:
    """Faults, audit and digest of the repair of every conversation after damage.

    A conversation that loses all its rows has zeros, an empty audit and the
    digest of nothing. No conversations give no rows.
    """
    turns = damaged_turns(conversations)
    audited = store(audits(turns), "audits")
    digests = repaired_digests(repaired_turns(turns, audited))
    ids = conversations.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    nothing = hashlib.sha256().hexdigest()
    joined = ids.alias("i").join(audited.alias("a"), F.col("i.conv_id").eqNullSafe(F.col("a.conv_id")), "left")
    joined = joined.join(digests.alias("d"), F.col("i.conv_id").eqNullSafe(F.col("d.conv_id")), "left")
    return joined.select("i.conv_id", *[F.coalesce(f"a.{c}", F.lit(0).cast("long")).alias(c) for c in counts],
                         F.coalesce("a.audit", F.lit("")).alias("audit"), F.coalesce("d.repaired_sha256", F.lit(nothing)).alias("repaired_sha256"))
