import resource
from pathlib import Path

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from seqloom.sinks import cells as cl


def read(path):
    return [part.read_text().splitlines() for part in sorted(Path(path).iterdir())]


@pytest.fixture
def table(frame, tmp_path):
    heads = frame([("b", "x", 2), ("a", "y\tz", 0), ("c", None, 1)], "k string, h string, n int")
    values = frame([("b", 1, "v2", 2), ("b", 1, "v1", 1), ("b", 0, "w", 0), ("c", 2, "u", 0), ("zz", 0, "lost", 0)], "k string, cell int, value string, pos int")

    def write(**more):
        path = str(tmp_path / "out")
        cl.write_cells(heads, values, path, ["k"], ["k", "h"], ["p", "q", "r"], **more)
        return read(path)

    return write


def test_lines_have_their_cells(table):
    parts = table(after=["n"], value_order=["pos"], comments=["# one"], empty="-")
    assert all(p[:2] == ["# one", "k\th\tp\tq\tr\tn"] for p in parts)
    assert [line for p in parts for line in p[2:]] == ["a\ty z\t-\t-\t-\t0", "b\tx\tw\tv1;v2\t-\t2", "c\t\t-\t-\tu\t1"]


def test_a_second_run_replaces_the_first(table):
    table()
    assert [line for p in table() for line in p[1:]] == ["a\ty z\t\t\t", "b\tx\tw\tv1;v2\t", "c\t\t\t\tu"]


def test_no_lines(frame, tmp_path):
    none = frame([], "k string, cell int, value string")
    cl.write_cells(none.select("k"), none, str(tmp_path / "out"), ["k"], ["k"], ["p"])
    assert all(p == ["k\tp"] for p in read(tmp_path / "out"))


def test_a_failed_task_leaves_nothing(frame, tmp_path):
    bad = frame([("a", 0)], "k string, cell int").withColumn("value", F.raise_error(F.lit("no")).cast("string"))
    with pytest.raises(Exception, match="no"):
        cl.write_cells(bad.select("k"), bad, str(tmp_path / "out"), ["k"], ["k"], ["p"])
    assert not Path(tmp_path, "out").exists() or not list(Path(tmp_path, "out").glob("part-*"))


def test_one_line_of_a_third_of_all_rows(spark, tmp_path):
    n = 300_000
    values = spark.range(n).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("k"), F.lit(0).alias("cell"),
                                   F.lpad(F.col("id").cast("string"), 7, "0").alias("value"))
    cl.write_cells(values.select("k").distinct(), values, str(tmp_path / "out"), ["k"], ["k"], ["ids"])
    lines = dict(line.split("\t") for p in read(tmp_path / "out") for line in p[1:])
    assert len(lines) == 1 + n - n // 3 and lines["hot"].split(";") == [f"{i:07d}" for i in range(0, n, 3)]


def test_a_long_line_is_streamed():
    """40 MB of one cell pass through buffers of one."""
    writer = cl.CellWriter({"path": "unused", "top": "k\tids\n", "cells": "1"}, True)
    rows, batches = 20_000, 20
    value = pa.array(["x" * 100] * rows)
    columns = lambda cell, v, head: [pa.array(["k"] * len(v)), pa.array([cell] * len(v), pa.int32()), v, pa.array([head] * len(v)), pa.array([""] * len(v))]
    names = ["line", "cell", "value", "head", "tail"]
    body = pa.RecordBatch.from_arrays(columns(0, value, ""), names=names)

    def stream():
        yield pa.RecordBatch.from_arrays(columns(-1, pa.array([""]), "k\t"), names=names)
        for _ in range(batches):
            yield body

    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    total = sum(map(len, writer.texts(stream())))
    assert total == len("k\tids\nk\t\n") + rows * batches * 101 - 1
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 30 << 10
