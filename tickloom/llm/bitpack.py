"""Token ids in files, each id in as few bits as the vocabulary needs.

A file holds, in this order: the magic bytes; the ids of its documents, packed in blocks of
``BLOCK_IDS``; the byte offset of each block and of their end (uint64); the documents' ids (int64),
whether these are null (uint8), and their first ids' positions in the file and the end (uint64); and a
trailer of ``TRAILER``. Sixty-four ids of b bits fill b 64-bit words, lowest bits first, so that any
block unpacks by itself with 64 vector operations, and any span of ids is read by its blocks alone.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F, Window

from tickloom.llm import files
from tickloom.llm.tables import OWN
from tickloom.llm.tokens import encoder
from tickloom.session import scratch_path, written_once

MAGIC = b"TLTOKEN1"
#: Bits, documents, ids, blocks, offset of the block table; the magic bytes follow.
TRAILER = struct.Struct("<QQQQQ8s")
GROUP = 64
BLOCK_IDS = 64 * GROUP
END_ID = 0
#: Ids after which a writer goes on in a new file.
FILE_IDS = 1 << 25
#: Ids held at once by writer and reader, beyond those of one document.
HELD_IDS = 1 << 19

MANIFEST = "path string, part int, serial int, n_docs bigint, n_ids bigint"


def bits_for(vocabulary: int) -> int:
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Ids as ``bits``-wide fields; the last group of 64 is filled up with zeros."""
    groups = -(-len(ids) // GROUP)
    padded = np.zeros(groups * GROUP, dtype=np.uint64)
    padded[:len(ids)] = ids
    columns = np.ascontiguousarray(padded.reshape(groups, GROUP).T)
    words = np.zeros((bits, groups), dtype=np.uint64)
    for k in range(GROUP):
        word, shift = divmod(k * bits, 64)
        words[word] |= columns[k] << np.uint64(shift)
        if shift + bits > 64:
            words[word + 1] |= columns[k] >> np.uint64(64 - shift)
    return np.ascontiguousarray(words.T).astype("<u8").tobytes()


def unpack(packed: bytes, count: int, bits: int) -> np.ndarray:
    words = np.ascontiguousarray(np.frombuffer(packed, "<u8").reshape(-1, bits).T)
    columns = np.empty((GROUP, words.shape[1]), dtype=np.uint32)
    mask = np.uint64((1 << bits) - 1)
    for k in range(GROUP):
        word, shift = divmod(k * bits, 64)
        value = words[word] >> np.uint64(shift)
        if shift + bits > 64:
            value = value | words[word + 1] << np.uint64(64 - shift)
        columns[k] = value & mask
    return columns.T.reshape(-1)[:count]


class TokenWriter:
    """Appends documents to one file; call ``close`` at the end."""

    def __init__(self, stream: pa.NativeFile, bits: int) -> None:
        self.stream, self.bits = stream, bits
        self.doc_ids: list[np.ndarray] = []
        self.nulls: list[np.ndarray] = []
        self.sizes: list[np.ndarray] = []
        self.held: list[np.ndarray] = []
        self.n_held = self.n_ids = self.n_docs = 0
        self.at = len(MAGIC)
        self.blocks = [self.at]
        stream.write(MAGIC)

    def append(
        self, doc_ids: np.ndarray, nulls: np.ndarray, ids: np.ndarray, sizes: np.ndarray
    ) -> None:
        self.doc_ids.append(doc_ids)
        self.nulls.append(nulls)
        self.sizes.append(sizes)
        self.held.append(ids)
        self.n_held += len(ids)
        self.n_ids += len(ids)
        self.n_docs += len(doc_ids)
        if self.n_held >= HELD_IDS:
            self._flush(self.n_held // BLOCK_IDS * BLOCK_IDS)

    def _flush(self, count: int) -> None:
        ids = np.concatenate(self.held) if self.held else np.empty(0, np.uint32)
        packed = pack(ids[:count], self.bits)
        self.stream.write(packed)
        per_block = BLOCK_IDS // GROUP * self.bits * 8
        full, rest = divmod(len(packed), per_block)
        self.blocks += [self.at + per_block * (k + 1) for k in range(full)]
        self.at += len(packed)
        if rest:
            self.blocks.append(self.at)
        self.held, self.n_held = [ids[count:]], len(ids) - count

    def close(self) -> None:
        self._flush(self.n_held)
        table = self.at
        sizes = np.concatenate(self.sizes) if self.sizes else np.empty(0, np.int64)
        firsts = np.concatenate([[0], np.cumsum(sizes)])
        self.stream.write(np.array(self.blocks, "<u8").tobytes())
        self.stream.write(np.concatenate(self.doc_ids or [np.empty(0)]).astype("<i8").tobytes())
        self.stream.write(np.concatenate(self.nulls or [np.empty(0)]).astype("u1").tobytes())
        self.stream.write(firsts.astype("<u8").tobytes())
        self.stream.write(TRAILER.pack(
            self.bits, self.n_docs, self.n_ids, len(self.blocks) - 1, table, MAGIC))


class TokenFile:
    """Random access to one file."""

    def __init__(self, path: str) -> None:
        self.file = files.opened(path)
        size = self.file.size()
        self.bits, self.n_docs, self.n_ids, n_blocks, table, magic = TRAILER.unpack(
            self._bytes(size - TRAILER.size, TRAILER.size))
        if magic != MAGIC or self._bytes(0, len(MAGIC)) != MAGIC:
            raise ValueError(f"{path} is not a token file")
        raw = self._bytes(table, size - TRAILER.size - table)
        places = np.cumsum([0, 8 * (n_blocks + 1), 8 * self.n_docs, self.n_docs])
        self.blocks, self.doc_ids, self.nulls, self.firsts = (
            np.frombuffer(raw, kind, count, at) for kind, count, at in zip(
                ("<u8", "<i8", "u1", "<u8"),
                (n_blocks + 1, self.n_docs, self.n_docs, self.n_docs + 1), places.tolist()))

    def _bytes(self, at: int, count: int) -> bytes:
        self.file.seek(at)
        return self.file.read(count)

    def ids(self, first: int, stop: int) -> np.ndarray:
        """The ids at positions first to stop of the file."""
        if stop <= first:
            return np.empty(0, np.uint32)
        low, high = first // BLOCK_IDS, -(-stop // BLOCK_IDS)
        at, end = int(self.blocks[low]), int(self.blocks[high])
        count = min(high * BLOCK_IDS, self.n_ids) - low * BLOCK_IDS
        found = unpack(self._bytes(at, end - at), count, self.bits)
        return found[first - low * BLOCK_IDS:stop - low * BLOCK_IDS]

    def documents(self) -> Iterator[tuple[int, int, np.ndarray]]:
        """Runs of documents (first, stop, their ids), about ``HELD_IDS`` ids at a time."""
        first = 0
        while first < self.n_docs:
            reach = int(self.firsts[first]) + HELD_IDS
            stop = max(int(np.searchsorted(self.firsts, reach, "right")) - 1, first + 1)
            stop = min(stop, self.n_docs)
            yield first, stop, self.ids(int(self.firsts[first]), int(self.firsts[stop]))
            first = stop


def write_tokens(
    docs: DataFrame, folder: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text",
    end_id: int = END_ID, file_ids: int = FILE_IDS,
) -> DataFrame:
    """Encodes the texts and writes them in ascending id order; returns the stored list of files.

    Null ids come first; rows of one id are ordered by their text's hash. Rows are range-partitioned
    and sorted, a hot id over several partitions, and each task streams into files of bounded size.
    """
    own_id, text, tie, spread = (f"{OWN}{c}" for c in ("id", "text", "tie", "spread"))
    rows = docs.select(
        F.col(id_col).cast("bigint").alias(own_id), F.col(text_col).cast("string").alias(text),
        F.xxhash64(text_col).alias(tie), F.monotonically_increasing_id().alias(spread))
    ordered = rows.repartitionByRange(own_id, tie, spread).sortWithinPartitions(
        own_id, tie, spread).select(own_id, text)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        bits = bits_for(max(encode.vocabulary_size, end_id + 1))
        part = TaskContext.get().partitionId()
        pieces = _pieces(batches, encode, end_id)
        piece = next(pieces, None)
        serial = 0
        while piece is not None:
            path = f"{folder}/tokens-{part:06d}-{serial:06d}.bin"
            with files.written(path) as stream:
                writer = TokenWriter(stream, bits)
                while piece is not None and writer.n_ids < file_ids:
                    writer.append(*piece)
                    piece = next(pieces, None)
                writer.close()
            yield pa.RecordBatch.from_pydict({
                "path": [path], "part": pa.array([part], pa.int32()),
                "serial": pa.array([serial], pa.int32()),
                "n_docs": [writer.n_docs], "n_ids": [writer.n_ids]})
            serial += 1

    return written_once(ordered.mapInArrow(write, MANIFEST))


def _pieces(batches, encode, end_id: int) -> Iterator[tuple]:
    for batch in batches:
        column = batch.column(0)
        doc_ids = np.asarray(column.fill_null(0), dtype=np.int64)
        nulls = np.asarray(column.is_null())
        for row, ids, bounds in encode.encode(batch.column(1)):
            count = len(bounds) - 1
            ended = np.insert(ids, bounds[1:], end_id)
            yield doc_ids[row:row + count], nulls[row:row + count], ended, np.diff(bounds) + 1


def read_tokens(manifest: DataFrame) -> DataFrame:
    """Reads the files of a manifest: ``doc_id, start, n_tokens, ids_crc32`` per document.

    ``start`` counts the ids of all documents before it in all files. A task opens its files itself and
    holds about ``HELD_IDS`` ids at a time.
    """
    before = Window.orderBy("part", "serial").rowsBetween(Window.unboundedPreceding, -1)
    placed = manifest.withColumn("base", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))
    spread = placed.select("path", "base").repartition(max(1, manifest.count()))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, base in zip(*(c.to_pylist() for c in batch.columns)):
                stored = TokenFile(path)
                for first, stop, ids in stored.documents():
                    at = stored.firsts[first:stop + 1].astype(np.int64)
                    raw, cuts = ids.astype("<u4").tobytes(), (at - at[0]) * 4
                    sums = [zlib.crc32(raw[a:b]) for a, b in zip(cuts[:-1], cuts[1:])]
                    yield pa.RecordBatch.from_pydict({
                        "doc_id": pa.array(
                            stored.doc_ids[first:stop], mask=stored.nulls[first:stop] == 1),
                        "start": pa.array(at[:-1] + base), "n_tokens": pa.array(np.diff(at)),
                        "ids_crc32": pa.array(sums, pa.int64())})

    return spread.mapInArrow(
        read, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def token_table(
    docs: DataFrame, tokenizer: str, folder: str | None = None, **columns: str
) -> DataFrame:
    """Writes the documents' token files below the shared folder and reads them back.

    Null and empty texts are the end id alone. Null ids come first. Repeated rows are documents of
    their own. No rows give no files and no rows. Long texts are encoded whole. Other columns are not
    read, so their names cannot clash.
    """
    folder = folder or scratch_path(docs.sparkSession, "tokens")
    return read_tokens(write_tokens(docs, folder, tokenizer, **columns))
