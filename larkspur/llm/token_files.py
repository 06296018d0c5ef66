"""Token files: ids packed into the fewest bits the vocabulary needs, with offsets for random access.

A file, all numbers little-endian:

    blocks        of BLOCK ids each (the last may have fewer); every 64 ids fill `bits` 64-bit words
    block offsets one 64-bit byte offset for each block
    documents     64-bit ids, then a byte for each that says whether it is null, then 64-bit ends
    footer        MAGIC, bits, ids of a block, ids, documents, blocks (64 bits each after the magic)

The documents of a file are in ascending order, and so are the files by their number.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from larkspur.llm.storage import bounded, cut, new_path, open_fs, tasks, trimmed
from larkspur.llm.tokens import encoded, encoder

MAGIC = b"LKTOK001"
BLOCK = 1 << 14
#: Ids after which a writer begins another file.
FILE_IDS = 1 << 25
#: Bytes of text that one writing task takes, about.
WRITE_TASK = 16 << 20
_FOOTER = 8 + 5 * 8
_SHARDS = "part int, seq int, path string, n_docs long, n_tokens long"


def bits_for(vocabulary: int) -> int:
    """The fewest bits that hold every id below that number."""
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """ids in `bits` bits each; filled up with zeros to a multiple of 64 ids."""
    full = np.zeros(-(-len(ids) // 64) * 64, dtype=np.uint64)
    full[: len(ids)] = ids
    full = full.reshape(-1, 64)
    words = np.zeros((len(full), bits), dtype=np.uint64)
    for j in range(64):
        word, shift = divmod(j * bits, 64)
        words[:, word] |= full[:, j] << np.uint64(shift)
        if shift + bits > 64:
            words[:, word + 1] |= full[:, j] >> np.uint64(64 - shift)
    return words.astype("<u8").tobytes()


def unpack(data: bytes, bits: int, count: int) -> np.ndarray:
    """The first count ids of what pack() made."""
    words = np.frombuffer(data, "<u8").reshape(-1, bits)
    mask = np.uint64((1 << bits) - 1)
    out = np.empty((len(words), 64), dtype=np.uint32)
    for j in range(64):
        word, shift = divmod(j * bits, 64)
        value = words[:, word] >> np.uint64(shift)
        if shift + bits > 64:
            value = value | words[:, word + 1] << np.uint64(64 - shift)
        out[:, j] = value & mask
    return out.reshape(-1)[:count]


class Writer:
    """One token file, written block by block."""

    def __init__(self, path: str, bits: int):
        self.path, self.bits = path, bits
        self.out = open_fs(path, "w")
        self.left, self.offsets, self.at, self.tokens = np.zeros(0, np.uint32), [], 0, 0
        self.docs: list[np.ndarray] = []
        self.null: list[np.ndarray] = []
        self.ends: list[np.ndarray] = []

    def add(self, docs: pa.Array, ids: np.ndarray, first: np.ndarray) -> None:
        self.null.append(docs.is_null().to_numpy(zero_copy_only=False).astype(np.uint8))
        self.docs.append(docs.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
        self.ends.append(self.tokens + first[1:].astype(np.int64))
        self.tokens += len(ids)
        ids = np.concatenate((self.left, ids))
        whole = len(ids) // BLOCK * BLOCK
        for k in range(0, whole, BLOCK):
            self._block(ids[k : k + BLOCK])
        self.left = ids[whole:]

    def _block(self, ids: np.ndarray) -> None:
        data = pack(ids, self.bits)
        self.offsets.append(self.at)
        self.out.write(data)
        self.at += len(data)

    def close(self) -> tuple[int, int]:
        if len(self.left):
            self._block(self.left)
        docs = np.concatenate(self.docs)
        for part in (np.array(self.offsets, "<u8"), docs.astype("<i8"), np.concatenate(self.null), np.concatenate(self.ends).astype("<u8")):
            self.out.write(part.tobytes())
        self.out.write(MAGIC + np.array([self.bits, BLOCK, self.tokens, len(docs), len(self.offsets)], "<u8").tobytes())
        self.out.close()
        return len(docs), self.tokens


class TokenFile:
    """Random access to the documents of one file; reads only the blocks it needs."""

    def __init__(self, path: str):
        self.file = open_fs(path, "r")
        size = self.file.size()
        tail = self.file.read_at(_FOOTER, size - _FOOTER)
        if tail[:8] != MAGIC:
            raise ValueError(f"{path} is no token file")
        self.bits, self.block, self.tokens, n, blocks = (int(x) for x in np.frombuffer(tail[8:], "<u8"))
        at = size - _FOOTER - 17 * n - 8 * blocks
        table = self.file.read_at(size - _FOOTER - at, at)
        self.offsets = np.concatenate((np.frombuffer(table, "<u8", blocks), [at])).astype(np.int64)
        self.docs = np.frombuffer(table, "<i8", n, 8 * blocks)
        self.null = np.frombuffer(table, np.uint8, n, 8 * blocks + 8 * n).astype(bool)
        self.first = np.concatenate(([0], np.frombuffer(table, "<u8", n, 8 * blocks + 9 * n))).astype(np.int64)

    def ids(self, low: int, high: int) -> np.ndarray:
        """The ids from number low to before number high."""
        if high <= low:
            return np.zeros(0, np.uint32)
        b0, b1 = low // self.block, (high - 1) // self.block + 1
        data = self.file.read_at(int(self.offsets[b1] - self.offsets[b0]), int(self.offsets[b0]))
        return unpack(data, self.bits, high - b0 * self.block)[low - b0 * self.block :]

    def document(self, i: int) -> np.ndarray:
        return self.ids(int(self.first[i]), int(self.first[i + 1]))

    def close(self) -> None:
        self.file.close()


def _write(name: str, folder: str, bits: int, end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, writer = TaskContext.get().partitionId(), 0, None

        def row() -> pa.RecordBatch:
            docs, tokens = writer.close()
            return pa.RecordBatch.from_pylist([{"part": part, "seq": seq, "path": writer.path, "n_docs": docs, "n_tokens": tokens}], schema=pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())]))

        for batch in batches:
            for some, ids, first in encoded(batch, 1, name, end):
                # another attempt of this task writes files of other names, which no row names if it fails
                writer = writer or Writer(f"{folder}/{part:06d}-{seq:04d}-{uuid.uuid4().hex}.tok", bits)
                writer.add(some.column(0), ids, first)
                if writer.tokens >= FILE_IDS:
                    yield row()
                    writer, seq = None, seq + 1
        if writer:
            yield row()

    return run


def write_token_files(docs: DataFrame, tokenizer: str, vocabulary: int | None = None, end: int = 0, id_column: str = "doc_id", text_column: str = "text", folder: str | None = None) -> DataFrame:
    """Writes every text's ids, and end after each, in ascending order of the ids of docs; one row per file:

    part, seq (files are in the order of these two), path, n_docs, n_tokens, start (ids in all files before).

    A null text counts as empty; null ids come first; rows that share an id, also repeated rows, are all written, in any order, and
    by several tasks if they are many. A very long text is encoded whole.
    Other columns of docs are not used. An empty table gives no file. folder must be one that the driver and
    all executors share.
    """
    spark = docs.sparkSession
    folder = folder or new_path(spark, "tokens")
    open_fs(folder, "mkdir")
    bits = bits_for(vocabulary or encoder(tokenizer).size)
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    parts = tasks(rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0, WRITE_TASK)
    # texts are shuffled, not ids: compressed, they are the smaller of the two; rows that share an id, or have none, are told apart by their numbers
    rows = rows.withColumn("row", F.monotonically_increasing_id()).repartitionByRange(parts, "doc_id", "row").sortWithinPartitions("doc_id", "row").drop("row")
    files = cut(bounded(rows).mapInArrow(trimmed(_write(tokenizer, folder, bits, end)), _SHARDS), "token-files")
    # one row for each file of some 2**25 ids: the only thing that meets in one task
    before = Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)
    return files.withColumn("start", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))


def _read(with_ids: bool):
    kind = [("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())] + [("ids", pa.list_(pa.int32()))] * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                file = TokenFile(path)
                low, n = 0, len(file.docs)
                while low < n:
                    high = max(low + 1, int(np.searchsorted(file.first, file.first[low] + (1 << 20), side="right")) - 1)
                    ids = file.ids(int(file.first[low]), int(file.first[high])).astype("<u4")
                    first = file.first[low : high + 1] - file.first[low]
                    crc = [zlib.crc32(ids[a:b]) for a, b in zip(first[:-1], first[1:])]
                    columns = [pa.array(file.docs[low:high], mask=file.null[low:high]), pa.array(start + file.first[low:high]), pa.array(np.diff(first)), pa.array(crc, pa.int64())]
                    if with_ids:
                        columns.append(pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(ids.view("<i4"))))
                    yield pa.RecordBatch.from_arrays(columns, schema=pa.schema(kind))
                    low = high
                file.close()

    return run


def read_token_files(files: DataFrame, with_ids: bool = False) -> DataFrame:
    """One row per document of the files that write_token_files() returned: doc_id, start (ids of all documents
    before it), n_tokens (with the end id), ids_crc32 (of its ids as 32-bit integers), and ids if asked for.

    A document of a null or empty text has the end id alone; one without an id comes back without; repeated rows come back as often as they were written, and a very
    long text in one row. No files give an empty result. A file is one task's work, or with very many files, a few of them are."""
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids
    return bounded(files).select("path", "start").repartition(tasks(files.count(), 1), "path").mapInArrow(trimmed(_read(with_ids)), schema)
