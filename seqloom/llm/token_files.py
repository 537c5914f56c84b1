"""Token ids on disk: block files with a shared compression dictionary.

A block is one row of a Parquet table: ``shard``, ``block``, the dictionary's
SHA-256, ``index`` and ``payload``. The payload is the documents' frames end
to end, each compressed by itself. The index is the concatenation of four
arrays: document ids (int64), end offsets in the payload (uint64), token
counts (uint64) and the tokens before each document in its block (uint64).
A frame holds ids as unsigned 16-bit integers, or 32-bit where ``wide``.
The dictionary is a second table beside the blocks. Spark's writer commits
both, so a lost executor's blocks are written again.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.llm.encoding import encoder
from seqloom.llm.ranges import MIN_LONG, null_first, range_of, running_sums, splitters, uniform
from seqloom.llm.storage import store, text_batches

#: Compressed bytes after which a block is closed.
BLOCK_BYTES = 4 << 20
#: Bytes of text for each range of ids, and the most ranges.
RANGE_BYTES, MAX_RANGES = 16 << 20, 1 << 16
#: The dictionary is trained on about this many documents, those of at most so many bytes among them; drawn by a hash.
DICT_DOCS, DICT_DOC_BYTES, DICT_BYTES = 1000, 16 << 10, 64 << 10
LEVEL = 3

BLOCK_SCHEMA = ("shard int, block int, wide boolean, n_docs long, n_tokens long, first_id long, last_id long, "
                "dictionary_sha256 string, index binary, payload binary")
DOC_SCHEMA = "doc_id long, shard int, block int, local_start long, n_tokens long, ids binary"


def train_dictionary(docs: DataFrame, tokenizer: str, end_id: int) -> bytes:
    """A dictionary over serialized ids of a bounded sample. With too few
    documents to train on, their plain bytes serve as the dictionary."""
    import zstandard

    short = docs.where(F.octet_length("text") <= DICT_DOC_BYTES)
    share = DICT_DOCS / max(1, docs.select(F.count("*")).first()[0])
    rows = short.where(uniform(F.col("doc_id"), F.col("text")) < share).select("text").collect()
    enc = encoder(tokenizer)
    samples = [_frame_bytes(ids + _end(end_id))[1] for ids in enc.encode_all(r["text"] for r in rows)]
    try:
        return zstandard.train_dictionary(DICT_BYTES, samples, threads=0).as_bytes()
    except zstandard.ZstdError:
        return (b"".join(samples) or bytes(8))[:DICT_BYTES].ljust(8, b"\0")


def _end(end_id: int) -> bytes:
    return np.array([end_id], dtype="<u4").tobytes()


def _frame_bytes(ids: bytes) -> tuple[bool, bytes]:
    values = np.frombuffer(ids, dtype="<u4")
    wide = bool(len(values)) and int(values.max()) > 0xFFFF
    return wide, ids if wide else values.astype("<u2").tobytes()


def _codec(dictionary: bytes):
    import zstandard

    shared = zstandard.ZstdCompressionDict(dictionary)
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=shared), zstandard.ZstdDecompressor(dict_data=shared)


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end_id: int = 0) -> None:
    """Write every document's ids, followed by ``end_id``, in ascending doc_id order.

    Null texts are empty, null ids come first, equal ids are ordered by a hash
    of the text. Documents are range-partitioned by id with byte-weighted
    splitters; each range is sorted and streamed, so a task holds one block.
    """
    spark = docs.sparkSession
    text_batches(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    dictionary = train_dictionary(docs, tokenizer, end_id)
    sha = hashlib.sha256(dictionary).hexdigest()
    spark.createDataFrame([(sha, bytearray(dictionary), tokenizer, end_id)],
                          "sha256 string, dictionary binary, tokenizer string, end_id long").write.parquet(f"{path}/dictionary")
    keyed = docs.select("*", null_first("doc_id").alias("__id"), F.xxhash64("text").alias("__text"))
    keys = ["__id", "__text"]
    narrow = store(keyed.select(*keys, (F.coalesce(F.octet_length("text"), F.lit(0)) + 16).alias("w")), "keys")
    total = narrow.agg(F.sum("w")).first()[0] or 0
    bounds = splitters(narrow, keys, "w", min(MAX_RANGES, max(1, total // RANGE_BYTES)))

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, (packer, _) = encoder(tokenizer), _codec(dictionary)
        end, names, numbers = _end(end_id), BLOCK_SCHEMA.split(", "), {}
        shard, ids, frames, counts, wides, held = None, [], [], [], [], 0

        def close():
            # Frames of one block share a width: narrow ones are made wide again where any needs it.
            wide = any(wides)
            packed = [packer.compress(raw if wide else _frame_bytes(raw)[1]) for raw in frames] if wide else frames
            lengths = np.array(counts, dtype="<u8")
            index = b"".join([np.array(ids, dtype="<i8").tobytes(), np.cumsum([len(f) for f in packed]).astype("<u8").tobytes(),
                              lengths.tobytes(), (np.cumsum(lengths) - lengths).astype("<u8").tobytes()])
            numbers[shard] = numbers.get(shard, -1) + 1
            row = [shard, numbers[shard], wide, len(ids), int(lengths.sum()), ids[0], ids[-1], sha, index, b"".join(packed)]
            return pa.RecordBatch.from_arrays([pa.array([v], type=t) for v, t in zip(row, _BLOCK_TYPES, strict=True)],
                                              names=[n.split(" ")[0] for n in names])

        for batch in batches:
            shards, docs_, texts = (batch.column(c).to_pylist() for c in ("__range", "__id", "text"))
            for s, doc, raw in zip(shards, docs_, enc.encode_all(texts), strict=True):
                raw += end
                wide, small = _frame_bytes(raw)
                if ids and (s != shard or held >= BLOCK_BYTES or (any(wides) != wide)):
                    yield close()
                    ids, frames, counts, wides, held = [], [], [], [], 0
                shard = s
                frame = raw if wide else packer.compress(small)
                ids.append(doc), frames.append(frame), counts.append(len(raw) // 4), wides.append(wide)
                held += len(frame)
        if ids:
            yield close()

    ranged = keyed.select(range_of(keyed, keys, bounds).alias("__range"), *keys, "text")
    (ranged.repartition("__range").sortWithinPartitions("__range", *keys).drop("__text")
     .mapInArrow(blocks, BLOCK_SCHEMA).write.parquet(f"{path}/blocks"))


_BLOCK_TYPES = [pa.int32(), pa.int32(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(),
                pa.binary(), pa.binary()]


def _dictionary(spark: SparkSession, path: str) -> tuple[str, bytes]:
    row = spark.read.parquet(f"{path}/dictionary").first()
    if hashlib.sha256(row["dictionary"]).hexdigest() != row["sha256"]:
        raise ValueError("the dictionary of these token files is damaged")
    return row["sha256"], bytes(row["dictionary"])


def read_token_files(spark: SparkSession, path: str, doc_id: int | None = None, with_ids: bool = True) -> DataFrame:
    """Documents of token files, or the one wanted: only blocks whose range of
    ids holds it are read, and in them only its own frame is decompressed."""
    text_batches(spark)
    sha, dictionary = _dictionary(spark, path)
    blocks = spark.read.parquet(f"{path}/blocks")
    if doc_id is not None:
        blocks = blocks.where((F.col("first_id") <= doc_id) & (F.col("last_id") >= doc_id))

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, unpacker = _codec(dictionary)
        for batch in batches:
            for row in range(batch.num_rows):
                shard, block, wide, n, used, index, payload = (batch.column(c)[row].as_py() for c in (
                    "shard", "block", "wide", "n_docs", "dictionary_sha256", "index", "payload"))
                if used != sha:
                    raise ValueError("a block was written with another dictionary")
                ids = np.frombuffer(index, dtype="<i8", count=n)
                ends, counts, before = np.frombuffer(index, dtype="<u8", offset=8 * n).reshape(3, n)
                at = np.arange(n) if doc_id is None else np.flatnonzero(ids == doc_id)
                found, crcs = [], []
                for k in at:
                    raw = unpacker.decompress(payload[int(ends[k - 1]) if k else 0 : int(ends[k])])
                    raw = raw if wide else np.frombuffer(raw, dtype="<u2").astype("<u4").tobytes()
                    if len(raw) != 4 * int(counts[k]):
                        raise ValueError("a frame does not hold the ids its index states")
                    found.append(raw if with_ids else None), crcs.append(zlib.crc32(raw))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([None if i == MIN_LONG else i for i in ids[at].tolist()], pa.int64()), pa.array([shard] * len(at), pa.int32()),
                     pa.array([block] * len(at), pa.int32()), pa.array(before[at].astype("i8")), pa.array(counts[at].astype("i8")),
                     pa.array(crcs, pa.int64()), pa.array(found, pa.binary())],
                    names=["doc_id", "shard", "block", "local_start", "n_tokens", "ids_crc32", "ids"])

    return blocks.mapInArrow(documents, DOC_SCHEMA.replace("ids binary", "ids_crc32 long, ids binary"))


def with_starts(spark: SparkSession, path: str, docs: DataFrame) -> DataFrame:
    """Add ``start``: the ids of all documents before, over all files."""
    blocks = spark.read.parquet(f"{path}/blocks").select("shard", "block", F.col("n_tokens").alias("tokens"))
    starts = running_sums(blocks, ["shard", "block"], ["tokens"], {"block_start": "tokens"}).drop("tokens")
    return docs.join(starts, ["shard", "block"]).withColumn("start", F.col("block_start") + F.col("local_start"))


def token_file_digest(docs: DataFrame, path: str, tokenizer: str, end_id: int = 0) -> DataFrame:
    """Write, read back, and return each document's place, length and checksum."""
    write_token_files(docs, path, tokenizer, end_id)
    read = read_token_files(docs.sparkSession, path, with_ids=False)
    return with_starts(docs.sparkSession, path, read).select("doc_id", "start", "n_tokens", "ids_crc32")
