"""Files of token ids, each id in the fewest bits that hold the vocabulary.

A file holds whole documents in ascending id order::

    header   8 bytes magic, u4 bits per id, u4 ids per block, u8 documents, u8 ids
    blocks   ids packed without gaps, low bit first; each block begins at a byte
    footer   i8 document ids, u8 first id of each document and the end, u8 byte offset of each block and the end
    trailer  u8 offset of the footer, 8 bytes magic

The offsets give any document by one read of its blocks, which numpy unpacks at once. Each
task writes under a name of its own, and only names that the finished job reports count, so
a repeated task leaves at most a file that nobody reads. Blocks are written as they fill and
splits of documents are read by ranges, so neither side holds a file in memory.

Defined results: null is empty; each document ends with the end id; equal ids keep the order
of their texts; a null id comes first and is read back as null; an empty table gives no file; further
columns are ignored.
"""

from __future__ import annotations

import struct
import uuid
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fleetlint.llm.tables import map_arrow, shuffle_partitions, whole_text
from fleetlint.llm.tokens import batches_of_texts, library_encoder
from fleetlint.plans.storage import materialise

MAGIC = b"FLTOKEN1"
#: Ids per block, and documents that one reading task takes at most.
BLOCK_IDS, SPLIT_DOCS = 65_536, 8192
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
END_ID = 0
_HEADER, _TRAILER, _NULL = struct.Struct("<8sIIQQ"), struct.Struct("<Q8s"), -(2**63)


def bits_for(vocabulary: int) -> int:
    return max(1, (vocabulary - 1).bit_length())


def pack_bits(ids: np.ndarray, bits: int) -> bytes:
    """Ids of ``bits`` bits one after another, low bit first."""
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    spread = (ids.astype(np.uint32)[:, None] >> np.arange(bits, dtype=np.uint32)) & 1
    return np.packbits(spread.astype(np.uint8).ravel(), bitorder="little").tobytes()


def unpack_bits(data: bytes, bits: int, n: int) -> np.ndarray:
    if bits in (8, 16, 32):
        return np.frombuffer(data, f"<u{bits // 8}", n).astype(np.uint32)
    spread = np.unpackbits(np.frombuffer(data, np.uint8), count=n * bits, bitorder="little").reshape(n, bits)
    return spread.astype(np.uint32) @ (np.uint32(1) << np.arange(bits, dtype=np.uint32))


def open_store(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a URI and the path in it."""
    return fs.FileSystem.from_uri("file://" + uri.removeprefix("file:") if uri.startswith("file:/") and not uri.startswith("file://") else uri)


class Writer:
    """Writes one file; documents are added in order."""

    def __init__(self, uri: str, bits: int, block: int = BLOCK_IDS):
        store, path = open_store(uri)
        store.create_dir(path.rsplit("/", 1)[0], recursive=True)
        self.out, self.bits, self.block = store.open_output_stream(path), bits, block
        self.out.write(_HEADER.pack(MAGIC, bits, block, 0, 0))  # counts stand in the footer's tables
        self.at, self.ids, self.n_ids = _HEADER.size, [], 0
        self.waiting, self.docs, self.starts, self.offsets = 0, [], [0], [_HEADER.size]

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append(_NULL if doc_id is None else doc_id)
        self.n_ids += len(ids)
        self.starts.append(self.n_ids)
        self.ids.append(ids)
        self.waiting += len(ids)
        if self.waiting >= self.block:
            ids = np.concatenate(self.ids)
            full = len(ids) // self.block * self.block
            for i in range(0, full, self.block):
                self._write(ids[i:i + self.block])
            self.ids, self.waiting = [ids[full:]], len(ids) - full

    def _write(self, ids: np.ndarray) -> None:
        data = pack_bits(ids, self.bits)
        self.out.write(data)
        self.at += len(data)
        self.offsets.append(self.at)

    def close(self) -> None:
        if self.waiting:
            self._write(np.concatenate(self.ids))
        footer = self.at
        for values, kind in ((self.docs, "<i8"), (self.starts, "<u8"), (self.offsets, "<u8")):
            self.out.write(np.array(values, kind).tobytes())
        self.out.write(struct.pack("<QQ", len(self.docs), len(self.offsets) - 1))
        self.out.write(_TRAILER.pack(footer, MAGIC))
        self.out.close()


class Reader:
    """Random access to the documents of one file."""

    def __init__(self, uri: str):
        store, path = open_store(uri)
        self.file, self.held = store.open_input_file(path), (-1, np.zeros(0, np.uint32))
        size = self.file.size()
        magic, self.bits, self.block, _, _ = _HEADER.unpack(self.file.read_at(_HEADER.size, 0))
        tail = self.file.read_at(16 + _TRAILER.size, size - 16 - _TRAILER.size)
        n_docs, n_blocks = struct.unpack("<QQ", tail[:16])
        footer, end = _TRAILER.unpack(tail[16:])
        if magic != MAGIC or end != MAGIC:
            raise ValueError(f"{uri} is no file of token ids")
        table = self.file.read_at(8 * (2 * n_docs + n_blocks + 2), footer)
        self.doc_ids = np.frombuffer(table, "<i8", n_docs)
        self.starts = np.frombuffer(table, "<u8", n_docs + 1, 8 * n_docs).astype(np.int64)
        self.offsets = np.frombuffer(table, "<u8", n_blocks + 1, 8 * (2 * n_docs + 1)).astype(np.int64)

    def ids(self, first: int, last: int) -> np.ndarray:
        """The ids from place ``first`` to ``last`` (exclusive)."""
        if first >= last:
            return np.zeros(0, np.uint32)
        a, b = first // self.block, (last - 1) // self.block
        blocks = [self._block(k) for k in range(a, b + 1)]
        return (blocks[0] if a == b else np.concatenate(blocks))[first - a * self.block:last - a * self.block]

    def _block(self, k: int) -> np.ndarray:
        """The ids of a block; the last one read is kept, since documents in a row share it."""
        if self.held[0] != k:
            data = self.file.read_at(int(self.offsets[k + 1] - self.offsets[k]), int(self.offsets[k]))
            self.held = k, unpack_bits(data, self.bits, min(self.block, int(self.starts[-1]) - k * self.block))
        return self.held[1]

    def document(self, k: int) -> np.ndarray:
        return self.ids(int(self.starts[k]), int(self.starts[k + 1]))

    def close(self) -> None:
        self.file.close()


def write_tokens(docs: DataFrame, folder: str, tokenizer: str = TOKENIZER, end_id: int = END_ID,
                 id_column: str = "doc_id", text_column: str = "text", files: int | None = None) -> DataFrame:
    """Write files below ``folder``; returns ``part, path, n_docs, n_ids, base`` of each, in id order."""
    spark = docs.sparkSession
    texts = docs.select(docs[id_column].cast("long").alias("doc_id"), whole_text(docs, text_column).alias("text"))
    ordered = texts.repartitionByRange(files or shuffle_partitions(spark), "doc_id").sortWithinPartitions("doc_id", "text")

    def run(batches):
        from pyspark import TaskContext

        encoder, vocabulary = library_encoder(tokenizer)
        part, path, out = TaskContext.get().partitionId(), f"{folder}/part-{uuid.uuid4().hex}.ids", None
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            ids, rows = batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()
            for first, last in batches_of_texts(rows):
                out = out or Writer(path, bits_for(vocabulary))
                for doc_id, data in zip(ids[first:last], encoder.encode_texts(rows[first:last]), strict=True):
                    out.add(doc_id, np.frombuffer(data + end, "<u4"))
        if out:
            out.close()
            yield pa.RecordBatch.from_pylist([{"part": part, "path": path, "n_docs": len(out.docs), "n_ids": out.n_ids}])

    written = materialise(map_arrow(ordered, run, "part long, path string, n_docs long, n_ids long", uses_kept=True), "token-files")
    # one row per file: a running sum over the list of files
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return written.withColumn("base", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))


def read_tokens(spark: SparkSession, files: DataFrame, split_docs: int = SPLIT_DOCS) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of each document, read from the files."""
    splits = files.withColumn("first", F.explode(F.sequence(F.lit(0), F.col("n_docs") - 1, F.lit(split_docs))))
    splits = splits.repartition(shuffle_partitions(spark), "path", "first")

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                reader = Reader(row["path"])
                docs, starts, sizes, sums = [], [], [], []
                for k in range(row["first"], min(row["first"] + split_docs, row["n_docs"])):
                    ids = reader.document(k)
                    doc_id = int(reader.doc_ids[k])
                    docs.append(None if doc_id == _NULL else doc_id)
                    starts.append(row["base"] + int(reader.starts[k]))
                    sizes.append(len(ids))
                    sums.append(zlib.crc32(ids.astype("<u4").tobytes()))
                reader.close()
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (docs, starts, sizes, sums)],
                                                 ["doc_id", "start", "n_tokens", "ids_crc32"])

    return map_arrow(splits.select("path", "first", "n_docs", "base"), run,
                     "doc_id long, start long, n_tokens long, ids_crc32 long")
