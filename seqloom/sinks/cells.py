"""Tables whose cells hold many values, written as a stream.

The tabular formats join all ids of a key into one cell. A cell may be longer
than a row of Spark can be, so no row ever holds one: a line arrives as its
head, one row with the fields around the cells, and its values, one row each.
Rows are range-partitioned by their line and sorted, and a task writes them one
after the other; it holds a batch of rows, whatever the length of a line.

The files are written by a data source of this module. Tasks write to a folder
beside the table and the driver moves complete files in, so that attempts that
fail or are repeated leave nothing behind.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass
from uuid import uuid4

import pyarrow as pa
from pyspark import TaskContext, cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

#: Bytes of text after which a task writes.
_BUFFER = 1 << 20


@dataclass
class _Written(WriterCommitMessage):
    name: str


class CellWriter(DataSourceArrowWriter):
    """Writes (line, cell, value, head, tail) rows that come in order as text."""

    def __init__(self, options: dict[str, str], overwrite: bool):
        self.path, self.top, self.cells = options["path"], options["top"], int(options["cells"])
        self.separator, self.empty = options.get("separator", ";"), options.get("empty", "")
        self.overwrite, self.folder = overwrite, f"_pending-{uuid4().hex}"

    def _target(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.path) if "://" in self.path else (fs.LocalFileSystem(), self.path)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        files, base = self._target()
        name = f"part-{TaskContext.get().partitionId():05d}-{uuid4().hex}.tsv"
        files.create_dir(f"{base}/{self.folder}", recursive=True)
        with files.open_output_stream(f"{base}/{self.folder}/{name}") as out:
            for text in self.texts(iterator):
                out.write(text.encode())
        return _Written(name)

    def texts(self, iterator: Iterator[pa.RecordBatch]) -> Iterator[str]:
        """The table's text in pieces."""
        parts, size = [self.top], len(self.top)
        line = tail = None
        at, fresh = 0, True

        def close() -> str:
            missing = ("\t" + self.empty) * (self.cells - 1 - at)
            return (self.empty if fresh else "") + missing + tail + "\n"

        for batch in iterator:
            for key, cell, value, head, after in zip(*[batch.column(c).to_pylist() for c in ("line", "cell", "value", "head", "tail")], strict=True):
                if cell < 0:
                    text = (close() if line is not None else "") + head
                    line, tail, at, fresh = key, after, 0, True
                elif key != line:
                    continue  # values of a line without a head
                else:
                    text = "".join((self.empty if fresh and n == 0 else "") + "\t" + (self.empty if at + n + 1 < cell else "") for n in range(cell - at))
                    if cell > at:
                        at, fresh = cell, True
                    text += value if fresh else self.separator + value
                    fresh = False
                parts.append(text)
                size += len(text)
                if size > _BUFFER:
                    yield "".join(parts)
                    parts, size = [], 0
        if line is not None:
            parts.append(close())
        yield "".join(parts)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        from pyarrow import fs

        files, base = self._target()
        if self.overwrite:
            for old in files.get_file_info(fs.FileSelector(base, allow_not_found=True)):
                if old.base_name != self.folder:
                    (files.delete_dir if old.type == fs.FileType.Directory else files.delete_file)(old.path)
        files.create_dir(base, recursive=True)
        for message in messages:
            if message is not None:
                files.move(f"{base}/{self.folder}/{message.name}", f"{base}/{message.name}")
        self._forget(files, base)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        self._forget(*self._target())

    def _forget(self, files, base: str) -> None:
        from pyarrow import fs

        if files.get_file_info(f"{base}/{self.folder}").type == fs.FileType.Directory:
            files.delete_dir(f"{base}/{self.folder}")


class CellTable(DataSource):
    @classmethod
    def name(cls) -> str:
        return "seqloom_cells"

    def schema(self) -> str:
        return "line string, cell int, value string, head string, tail string"

    def writer(self, schema, overwrite: bool) -> CellWriter:
        return CellWriter(dict(self.options), overwrite)


def fields(columns: list[str]) -> Column:
    """Columns as the text of a line's fields; nulls are empty, tabs and line breaks become spaces."""
    each = [F.translate(F.coalesce(F.col(c).cast("string"), F.lit("")), "\t\r\n", "   ") for c in columns]
    return F.concat_ws("\t", *each)


def write_cells(heads: DataFrame, values: DataFrame, path: str, order: list[str], before: list[str], cells: list[str],
                after: list[str] = (), value_order: list[str] = ("value",), comments: list[str] = (), empty: str = "") -> None:
    """Write one line per row of ``heads``: ``before`` columns, cells, ``after`` columns.

    ``order`` names the columns, in both frames, that identify a line and sort
    the lines. ``values`` has one row per value: ``order``, ``cell`` (number of
    the cell), ``value`` and what sorts a cell. A line without values has empty
    cells. Every part file begins with the comments and the names.
    """
    spark: SparkSession = heads.sparkSession
    spark.dataSource.register(CellTable)
    booleans = [c for c, t in heads.dtypes if t == "boolean"]
    heads = heads.withColumns({c: F.initcap(F.col(c).cast("string")) for c in booleans})
    within = [c for c in value_order if c not in order]
    tail = F.concat(F.lit("\t"), fields(list(after))) if after else F.lit("")
    top = heads.select(*order, F.lit(-1).alias("cell"), F.lit("").alias("value"), F.concat(fields(before), F.lit("\t")).alias("head"),
                       tail.alias("tail"), *[F.lit(None).cast(values.schema[c].dataType).alias(f"by_{c}") for c in within])
    rest = values.select(*order, F.col("cell").cast("int").alias("cell"), fields(["value"]).alias("value"), F.lit("").alias("head"),
                         F.lit("").alias("tail"), *[F.col(c).alias(f"by_{c}") for c in within])
    rows = top.unionByName(rest).repartitionByRange(*order).sortWithinPartitions(*order, "cell", *[f"by_{c}" for c in within])
    line = F.to_json(F.struct(*order))
    names = "\t".join([*before, *cells, *after])
    (rows.select(line.alias("line"), "cell", "value", "head", "tail").write.format("seqloom_cells").mode("overwrite")
     .option("path", path).option("cells", str(len(cells))).option("empty", empty)
     .option("top", "".join(f"{c}\n" for c in comments) + names + "\n").save())


# Workers need not have this package installed: ship the functions themselves.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
