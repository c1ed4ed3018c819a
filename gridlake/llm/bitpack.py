"""Token ids in fixed-width bit-packed files with block offsets.

A file holds whole documents: a header, blocks of ``BLOCK`` ids each stored in the fewest
bits that hold the vocabulary, then an index (block offsets, document ids, running counts)
and a trailer.  Any id is found by one division and one offset; a block unpacks with numpy.
Ids of consecutive documents run on through the blocks.

Files of one set follow ascending document ids.  A task writes its file under a name of its
own and reports it in the manifest; files of lost attempts are in no manifest and are ignored.
"""

from __future__ import annotations

import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridlake.session import stage, staging_path
from gridlake.sources.files import open_input, open_output

# Fixed values of the file format.
MAGIC = b"GLPK"
BLOCK = 1 << 16
HEADER = struct.Struct("<4sHHI")
TRAILER = struct.Struct("<QQQQ4s")

MANIFEST = "shard long, path string, n_docs long, n_ids long, n_bytes long"


def id_bits(vocabulary: int) -> int:
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Most significant bit first, padded with zero bits to a whole byte."""
    if bits in (8, 16, 32):
        return ids.astype(f">u{bits // 8}").tobytes()
    spread = np.unpackbits(ids.astype(">u4").view(np.uint8).reshape(-1, 4), axis=1)
    return np.packbits(spread[:, 32 - bits:].ravel()).tobytes()


def unpack(data: bytes, count: int, bits: int) -> np.ndarray:
    if bits in (8, 16, 32):
        return np.frombuffer(data, dtype=f">u{bits // 8}", count=count).astype("<u4")
    spread = np.zeros((count, 32), dtype=np.uint8)
    spread[:, 32 - bits:] = np.unpackbits(np.frombuffer(data, np.uint8), count=count * bits).reshape(count, bits)
    return np.packbits(spread, axis=1).view(">u4").ravel().astype("<u4")


class PackedWriter:
    """Streams documents into one file; holds one block and the index."""

    def __init__(self, sink, bits: int):
        self.sink, self.bits = sink, bits
        self.sink.write(HEADER.pack(MAGIC, 1, bits, BLOCK))
        self.at, self.offsets = HEADER.size, [HEADER.size]
        self.doc_ids, self.ends, self.pending, self.waiting, self.n_ids = [], [], [], 0, 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        if len(ids) and int(ids.max()) >> self.bits:
            raise ValueError(f"an id needs more than {self.bits} bits")
        self.n_ids += len(ids)
        self.doc_ids.append(doc_id)
        self.ends.append(self.n_ids)
        self.pending.append(ids)
        self.waiting += len(ids)
        if self.waiting >= BLOCK:
            joined = np.concatenate(self.pending)
            whole = len(joined) // BLOCK * BLOCK
            for i in range(0, whole, BLOCK):
                self._block(joined[i:i + BLOCK])
            self.pending, self.waiting = [joined[whole:].copy()], len(joined) - whole

    def _block(self, ids: np.ndarray) -> None:
        data = pack(ids, self.bits)
        self.sink.write(data)
        self.at += len(data)
        self.offsets.append(self.at)

    def close(self) -> int:
        if self.waiting:
            self._block(np.concatenate(self.pending))
        index = self.at
        known = np.array([d is not None for d in self.doc_ids], dtype=np.uint8)
        for part in (
            np.array(self.offsets, dtype="<i8"), np.array([d or 0 for d in self.doc_ids], dtype="<i8"),
            np.array(self.ends, dtype="<i8"), known,
        ):
            self.sink.write(part.tobytes())
            self.at += part.nbytes
        self.sink.write(TRAILER.pack(len(self.doc_ids), len(self.offsets) - 1, self.n_ids, index, MAGIC))
        return self.at + TRAILER.size


class PackedReader:
    """Random access to ids and documents of one file."""

    def __init__(self, source):
        self.source = source
        size = source.size()
        n_docs, n_blocks, self.n_ids, index, magic = TRAILER.unpack(self._at(size - TRAILER.size, TRAILER.size))
        start, _, self.bits, self.block = HEADER.unpack(self._at(0, HEADER.size))
        if magic != MAGIC or start != MAGIC:
            raise ValueError("not a packed token file, or cut short")
        data = self._at(index, size - TRAILER.size - index)
        cut = np.cumsum([0, 8 * (n_blocks + 1), 8 * n_docs, 8 * n_docs, n_docs])
        self.offsets = np.frombuffer(data[cut[0]:cut[1]], "<i8")
        self.doc_ids = np.frombuffer(data[cut[1]:cut[2]], "<i8")
        self.ends = np.frombuffer(data[cut[2]:cut[3]], "<i8")
        self.known = np.frombuffer(data[cut[3]:cut[4]], np.uint8)

    def _at(self, offset: int, length: int) -> bytes:
        self.source.seek(offset)
        data = self.source.read(length)
        if len(data) != length:
            raise OSError(f"{len(data)} of {length} bytes at {offset}")
        return data

    def read_block(self, number: int) -> np.ndarray:
        count = min(self.block, self.n_ids - number * self.block)
        low, high = int(self.offsets[number]), int(self.offsets[number + 1])
        return unpack(self._at(low, high - low), count, self.bits)

    def read(self, start: int, stop: int) -> np.ndarray:
        """Ids ``start`` to ``stop`` of the file."""
        if start >= stop:
            return np.zeros(0, dtype="<u4")
        first, last = start // self.block, (stop - 1) // self.block
        found = np.concatenate([self.read_block(b) for b in range(first, last + 1)])
        return found[start - first * self.block:stop - first * self.block]

    def documents(self):
        """(document id or None, start in the file, ids), reading each block once."""
        at, held, number = 0, np.zeros(0, dtype="<u4"), 0
        for doc_id, known, end in zip(self.doc_ids.tolist(), self.known.tolist(), self.ends.tolist()):
            parts, need = [], end - at
            while need > len(held):
                parts.append(held)
                need -= len(held)
                held, number = self.read_block(number), number + 1
            parts.append(held[:need])
            held = held[need:]
            yield doc_id if known else None, at, np.concatenate(parts)
            at = end


def write_tokens(
    docs: DataFrame, folder: str, tokenizer: str, end_id: int | None = None, shards: int | None = None,
    id_column: str = "doc_id", text_column: str = "text",
) -> DataFrame:
    """Encode whole texts and write them in ascending document id; returns the manifest.

    ``end_id`` is appended to each document.  Null texts count as empty, null ids sort first,
    equal ids by text; other columns are not read.  An empty table gives an empty manifest.
    """
    spark = docs.sparkSession
    shards = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(
        F.col(id_column).cast("long").alias("id"), F.coalesce(F.col(text_column), F.lit("")).alias("text")
    )
    rows = rows.repartitionByRange(shards, F.col("id"), F.xxhash64("text")).sortWithinPartitions("id", "text")
    tail = np.array([] if end_id is None else [end_id], dtype="<u4").tobytes()

    def write(batches):
        # imported in the task, so that its caches live as long as the worker
        from gridlake.llm import bitpack, encoders

        coder, writer, sink = encoders.encoder(tokenizer), None, None
        bits = bitpack.id_bits(coder.vocabulary)
        shard = TaskContext.get().partitionId()
        path = f"{folder}/tokens-{shard:06d}-{uuid.uuid4().hex[:12]}.bin"
        try:
            for batch in batches:
                for doc_id, text in zip(batch["id"].to_pylist(), batch["text"].to_pylist()):
                    if writer is None:
                        sink = open_output(path)
                        writer = bitpack.PackedWriter(sink, bits)
                    writer.add(doc_id, np.frombuffer(coder.encode(text) + tail, dtype="<u4"))
            if writer is None:
                return
            size = writer.close()
        finally:
            if sink is not None:
                sink.close()
        yield pa.RecordBatch.from_pydict({
            "shard": [shard], "path": [path], "n_docs": [len(writer.doc_ids)], "n_ids": [writer.n_ids], "n_bytes": [size],
        })

    return stage(rows.mapInArrow(write, MANIFEST), "token-manifest")


def read_tokens(manifest: DataFrame) -> DataFrame:
    """Documents of a file set in order: doc_id, start, n_tokens, ids_crc32, shard, shard_start."""
    # One row per file: the window is as small as the number of write tasks.
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    files = manifest.withColumn("base", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))
    shards = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long, shard long, shard_start long"

    def read(batches):
        from gridlake.llm import bitpack

        for batch in batches:
            for row in batch.to_pylist():
                with open_input(row["path"]) as source:
                    reader, out = bitpack.PackedReader(source), []
                    for doc_id, at, ids in reader.documents():
                        out.append((doc_id, row["base"] + at, len(ids), zlib.crc32(ids.tobytes()), row["shard"], at))
                        if len(out) == 4096:
                            yield _rows(out)
                            out = []
                    if out:
                        yield _rows(out)

    return files.repartitionById(shards, F.col("shard").cast("int")).mapInArrow(read, schema)


def _rows(out: list) -> pa.RecordBatch:
    names = ["doc_id", "start", "n_tokens", "ids_crc32", "shard", "shard_start"]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=names)


def packed_corpus(docs: DataFrame, tokenizer: str, end_id: int | None = None) -> DataFrame:
    """Write the file set into the shared folder and read every document back from it."""
    folder = staging_path(docs.sparkSession, "tokens")
    return read_tokens(write_tokens(docs, folder, tokenizer, end_id))
