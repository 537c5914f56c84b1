"""Chat formatting with shared turns, as prefix trees.

Conversations that begin with the same turns share them: sorted by the path of
their turns, they are the depth-first walk of a prefix tree, and every turn is
written when it is first met. A segment is one stretch of that walk, with the
text, its tokens, and for each turn its parent, its position (what stands
before it in a conversation) and the token intervals that it may attend to.

A turn is written as ``<|role|>text<|end|>``. A backslash in a role or text is
doubled, and one is put inside every control string, so reading is exact.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.llm.encoding import encoder
from seqloom.llm.ranges import null_first, range_of, splitters
from seqloom.llm.storage import store, text_batches

#: Characters after which a segment ends, and the turns of a path that cut ranges; inside a range all turns order it.
SEGMENT_CHARS, KEY_TURNS = 1 << 18, 32
#: Characters of each range of paths, and the most ranges.
RANGE_CHARS, MAX_RANGES = 2 << 20, 1 << 14
#: Bytes of a row group where rows are whole conversations or segments.
GROUP_BYTES = 16 << 20

OPEN, CLOSE, END = "<|", "|>", "<|end|>"
# Control strings of common chat templates are <s> </s> [INST] [/INST] <<SYS>> <</SYS>> besides our own <| |>.
_CONTROL = re.compile(r"<(?=\||s>|/s>|<SYS>>|</SYS>>)|\|(?=>)|\[(?=INST\]|/INST\])")
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: m[0] + "\\", text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def format_turn(role: str, text: str) -> tuple[str, int, int]:
    """A turn as written, and where its text begins and ends in it."""
    head = OPEN + escape(role) + CLOSE
    body = escape(text)
    return head + body + END, len(head), len(head) + len(body)


def parse_turn(written: str) -> tuple[str, str]:
    close = written.index(CLOSE, len(OPEN))
    if not written.startswith(OPEN) or not written.endswith(END):
        raise ValueError("not a formatted turn")
    return unescape(written[len(OPEN) : close]), unescape(written[close + len(CLOSE) : len(written) - len(END)])


SEGMENT_SCHEMA = (
    "segment_range int, segment int, text string, token_ids binary, position_ids array<int>, "
    "node_parent array<int>, node_start array<int>, node_end array<int>, node_position array<int>, "
    "loss_start array<int>, loss_end array<int>, token_start array<int>, token_end array<int>, "
    "attention array<array<int>>, conv_id array<bigint>, leaf array<int>")


class _Segment:
    """A prefix tree that grows in depth-first order."""

    def __init__(self):
        self.parts, self.chars, self.tokens = [], 0, 0
        self.ids, self.positions = [], []
        self.nodes: dict[str, list] = {n: [] for n in (
            "node_parent", "node_start", "node_end", "node_position", "loss_start", "loss_end", "token_start", "token_end", "attention")}
        self.stack: list[tuple[tuple[str, str], int]] = []
        self.convs, self.leaves = [], []

    def add(self, conv_id: int | None, turns: list[tuple[str, str]], forms: dict[tuple[str, str], tuple[str, int, int, bytes]]) -> None:
        """Add a conversation; ``forms`` has every turn as written, where its text begins and ends, and its ids."""
        shared = 0
        while shared < min(len(turns), len(self.stack)) and self.stack[shared][0] == turns[shared]:
            shared += 1
        del self.stack[shared:]
        for turn in turns[shared:]:
            self._push(turn, *forms[turn])
        self.convs.append(conv_id), self.leaves.append(self.stack[-1][1])

    def _push(self, turn: tuple[str, str], written: str, begin: int, end: int, raw: bytes) -> None:
        n, parent = self.nodes, self.stack[-1][1] if self.stack else -1
        count = len(raw) // 4
        before = n["node_position"][parent] + n["node_end"][parent] - n["node_start"][parent] if parent >= 0 else 0
        token_before = self._token_position(parent)
        loss = turn[0] == "assistant"
        attend = list(n["attention"][parent]) if parent >= 0 else []
        if attend and attend[-1] == self.tokens:  # the parent ends where this turn begins
            attend[-1] = self.tokens + count
        else:
            attend += [self.tokens, self.tokens + count]
        values = (parent, self.chars, self.chars + len(written), before, self.chars + begin if loss else -1,
                  self.chars + end if loss else -1, self.tokens, self.tokens + count, attend)
        for name, value in zip(n, values, strict=True):
            n[name].append(value)
        self.parts.append(written), self.ids.append(raw)
        self.positions.append(np.arange(token_before, token_before + count, dtype=np.int32))
        self.chars += len(written)
        self.tokens += count
        self.stack.append((turn, len(n["node_parent"]) - 1))

    def _token_position(self, parent: int) -> int:
        a = self.nodes["attention"][parent] if parent >= 0 else []
        return sum(a[1::2]) - sum(a[::2])

    def batch(self, segment_range: int, segment: int) -> pa.RecordBatch:
        ints, nested = pa.list_(pa.int32()), pa.list_(pa.list_(pa.int32()))
        arrays = [pa.array([segment_range], pa.int32()), pa.array([segment], pa.int32()), pa.array(["".join(self.parts)]),
                  pa.array([b"".join(self.ids)], pa.binary()), pa.array([np.concatenate(self.positions)], ints),
                  *[pa.array([v], nested if k == "attention" else ints) for k, v in self.nodes.items()],
                  pa.array([self.convs], pa.list_(pa.int64())), pa.array([self.leaves], ints)]
        return pa.RecordBatch.from_arrays(arrays, names=[c.strip().split(" ")[0] for c in SEGMENT_SCHEMA.split(", ")])


def conversation_paths(conversations: DataFrame) -> DataFrame:
    """(conv_id, turns in order, path, key). Rows of a conversation are ordered
    by turn, role and text, nulls first; null roles and texts are empty; rows
    without a conv_id are one conversation. The path has a hash of every turn;
    the key has four digits of each of the first, and cuts ranges."""
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    grouped = conversations.groupBy(F.col("conv_id").cast("long").alias("conv_id")).agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    path = F.transform("turns", lambda t: F.xxhash64(t["role"], t["text"]))
    key = F.array_join(F.transform(F.slice("path", 1, KEY_TURNS), lambda h: F.lpad(F.hex(h.bitwiseAND(0xFFFF)), 4, "0")), "")
    size = F.aggregate("turns", F.lit(16).cast("long"), lambda acc, t: acc + F.length(t["text"]) + 16)
    return grouped.withColumn("path", path).select("conv_id", "turns", "path", key.alias("key"), size.alias("w"), null_first("conv_id").alias("id"))


def format_conversations(conversations: DataFrame, tokenizer: str, segment_chars: int = SEGMENT_CHARS) -> DataFrame:
    """Segments of the prefix trees of all conversations.

    Paths are range-partitioned by sampled splitters over (key, conv_id), so a
    tree that holds a third of all conversations is spread over many tasks;
    where a range or segment begins inside a tree, the turns above are written
    once more. A conversation is never cut. No conversations, no segments.
    """
    text_batches(conversations.sparkSession)
    paths = store(conversation_paths(conversations), "paths", GROUP_BYTES)
    keys = ["key", "id"]
    total = paths.agg(F.sum("w")).first()[0] or 0
    bounds = splitters(paths, keys, "w", min(MAX_RANGES, max(1, total // RANGE_CHARS)))
    ranged = paths.select(range_of(paths, keys, bounds).alias("range"), "path", "id", "conv_id", F.col("turns.role").alias("roles"), F.col("turns.text").alias("texts"))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        current, number, segment = None, 0, _Segment()
        for batch in batches:
            ranges, convs, roles, texts = (batch.column(c).to_pylist() for c in ("range", "conv_id", "roles", "texts"))
            turns = [list(zip(a, b, strict=True)) for a, b in zip(roles, texts, strict=True)]
            distinct = list(dict.fromkeys(turn for each in turns for turn in each))
            written = [format_turn(*turn) for turn in distinct]
            ids = enc.encode_all(w for w, _, _ in written)
            forms = {turn: (*w, raw) for turn, w, raw in zip(distinct, written, ids, strict=True)}
            for r, conv, each in zip(ranges, convs, turns, strict=True):
                if segment.convs and (r != current or segment.chars >= segment_chars):
                    yield segment.batch(current, number)
                    number, segment = (number + 1 if r == current else 0), _Segment()
                current = r
                segment.add(conv, each, forms)
        if segment.convs:
            yield segment.batch(current, number)

    return ranged.repartition("range").sortWithinPartitions("range", "path", "id").mapInArrow(build, SEGMENT_SCHEMA)


def read_conversations(segments: DataFrame) -> DataFrame:
    """Every conversation's digests, read back from the segments alone. Of
    stored segments only the columns of the text and its tree are fetched."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                text, parent = row["text"], row["node_parent"]
                turns = [parse_turn(text[a:b]) for a, b in zip(row["node_start"], row["node_end"], strict=True)]
                loss = [unescape(text[a:b]) if a >= 0 else None for a, b in zip(row["loss_start"], row["loss_end"], strict=True)]
                out: list[list] = [[] for _ in range(6)]
                for leaf in row["leaf"]:
                    path = []
                    while leaf >= 0:
                        path.append(leaf)
                        leaf = parent[leaf]
                    path.reverse()
                    whole, masked, chars = hashlib.sha256(), hashlib.sha256(), 0
                    for k in path:
                        role, said = turns[k]
                        whole.update(f"{role}\n{said}\n".encode())
                        if loss[k] is not None:
                            masked.update(loss[k].encode())
                            chars += len(loss[k])
                    values = (len(path), whole.hexdigest(), chars, masked.hexdigest(),
                              sum(row["node_end"][k] - row["node_start"][k] for k in path))
                    for column, value in zip(out[1:], values, strict=True):
                        column.append(value)
                out[0] = row["conv_id"]
                types = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)],
                                                 names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    text_batches(segments.sparkSession)
    used = segments.select("text", "node_parent", "node_start", "node_end", "loss_start", "loss_end", "conv_id", "leaf")
    return used.mapInArrow(read, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
