"""Passages of many words that occur more than once in a corpus, found in prefix-partitioned suffix trees.

A suffix starts at every word. Only internal nodes of the tree that are at least ``size`` words deep matter, so a
suffix is followed for that many words, along an edge label of a few hashed symbols. Prefixes of labels, as long as
it takes, split the suffixes into groups that fit in memory; each group's subtree is its sorted labels with
the lengths of the prefixes that neighbours share. Leaves below one deep internal node are occurrences of a
repeat; the windows they start, joined where they overlap, are the maximal repeats of a text.

Most suffixes share no long prefix with another. A first, shallow tree shows that: every window of ``size`` words
has an anchor, the place of the least hash among its runs of ``ANCHOR`` words, so equal windows have equal runs
there. Only windows whose anchor's run occurs again enter the deep trees.

Texts are written once, in one file a task, and each file is read again to ask for its labels and to apply the
answers, which are bitmaps over the labels asked for. No text is shuffled.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import (
    ArrayType, BooleanType, LongType, StringType, StructField, StructType,
)

from tickloom.llm import files
from tickloom.llm.spans import hashes, runs, text_pieces, windows
from tickloom.session import scratch_path, written_once

SIZE = 35
#: Words of the runs that decide where a window has its anchor; a window of fewer words is its own run.
ANCHOR = 11
#: Symbols of 32 bits in a label of the deep trees; of 64 bits together in one number.
SYMBOLS = 4
#: Suffixes of a group.
GROUP = 1 << 20

#: Bytes of words: all but blanks.
WORD_BYTES = np.ones(256, dtype=bool)
WORD_BYTES[[0x20, *range(0x09, 0x0E)]] = False

PARTS = "path string, words bigint"
ASKS = "prefix string, path string, block bigint, first bigint, n bigint, labels binary, twice binary"

REPORT = pa.schema([
    ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()),
    ("repeated", pa.bool_()), ("spans", pa.list_(pa.list_(pa.int64()))), ("text", pa.string())])
REPORT_TYPE = StructType([
    StructField("n_words", LongType()), StructField("n_removed", LongType()),
    StructField("kept_sha256", StringType()), StructField("repeated", BooleanType()),
    StructField("spans", ArrayType(ArrayType(LongType()))), StructField("text", StringType())])


@dataclass(frozen=True)
class Piece:
    """The words of some consecutive texts."""

    row: int
    data: np.ndarray
    bounds: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    words: np.ndarray
    #: Number of the first word of each text, and of all.
    rows: np.ndarray

    def windows(self, size: int) -> np.ndarray:
        """First words of the windows that lie within one text."""
        at = np.arange(max(len(self.words) - size + 1, 0))
        text = np.searchsorted(self.rows, np.arange(len(self.words)), "right")
        return at[text[:len(at)] == text[len(self.words) - len(at):]]


def pieces(column: pa.Array) -> Iterator[Piece]:
    for row, data, bounds in text_pieces(column):
        starts, ends = runs(data, bounds, WORD_BYTES)
        yield Piece(row, data, bounds, starts, ends, hashes(data, starts, ends),
                    np.searchsorted(starts, bounds))


def least_places(values: np.ndarray, width: int) -> np.ndarray:
    """The first place of the least of each ``width`` consecutive values."""
    at, span = np.arange(len(values)), 1
    while span < width:
        step = min(span, width - span)
        right = values[step:] < values[:-step]
        values = np.where(right, values[step:], values[:-step])
        at = np.where(right, at[step:], at[:-step])
        span += step
    return at


@dataclass(frozen=True)
class Anchored:
    """The windows of a piece, their anchors, and the distinct anchors' places and hashes."""

    first: np.ndarray
    anchor: np.ndarray
    places: np.ndarray
    labels: np.ndarray


def anchored(piece: Piece, size: int) -> Anchored:
    run = min(ANCHOR, size)
    first = piece.windows(size)
    if not len(first):
        return Anchored(first, first, first, np.empty((0, 1), np.uint64))
    values = windows(piece.words, run)
    anchor = least_places(values, size - run + 1)[first]
    places = anchor[np.concatenate([[True], anchor[1:] != anchor[:-1]])]
    return Anchored(first, anchor, places, values[places, None])


def window_labels(piece: Piece, first: np.ndarray, size: int) -> np.ndarray:
    """The labels of suffixes: symbols for runs of words that together cover ``size`` words."""
    width = -(-size // SYMBOLS)
    symbols = windows(piece.words, width) >> np.uint64(32)
    at = [min(k * width, size - width) for k in range(SYMBOLS)]
    parts = [symbols[first + a] for a in at]
    return np.stack([a << np.uint64(32) | b for a, b in zip(parts[::2], parts[1::2])], axis=1)


def order_of(labels: np.ndarray) -> np.ndarray:
    return np.lexsort(labels.T[::-1])


def shared_symbols(labels: np.ndarray) -> np.ndarray:
    """How many symbols each of some sorted labels shares with the one before."""
    symbols = labels.astype(">u8").view(">u4").reshape(len(labels), -1)
    same = symbols[1:] == symbols[:-1]
    return np.concatenate([[0], np.cumprod(same, axis=1).sum(axis=1)]) if len(labels) else np.empty(0, int)


def deep_nodes(labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes at full depth of the subtree of sorted labels, as first leaf and leaf after the last."""
    deep = shared_symbols(labels) == 2 * labels.shape[1]
    first = np.flatnonzero(~deep)
    return first, np.append(first[1:], len(labels))


def prefix_ranges(labels: np.ndarray, digits: int) -> Iterator[tuple[str, int, int]]:
    """Ranges of sorted labels that share their first hexadecimal digits."""
    if not len(labels):
        return
    parts = []
    for k in range(labels.shape[1]):
        kept = min(max(digits - 16 * k, 0), 16)
        parts.append(labels[:, k] >> np.uint64(64 - 4 * kept) if kept else np.zeros(len(labels), np.uint64))
    keys = np.stack(parts, axis=1)
    first = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]).any(axis=1)]))
    for a, b in zip(first.tolist(), np.append(first[1:], len(labels)).tolist()):
        name = "".join(f"{int(value):016x}" for value in labels[a])[:digits]
        yield name, a, b


def _packed(flags: np.ndarray) -> bytes:
    return np.packbits(flags).tobytes()


def _flags(packed: bytes, count: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(packed, np.uint8), count=count).astype(bool)


def _asks(found: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]
    names = [c.split()[0] for c in ASKS.split(", ")]
    return pa.RecordBatch.from_arrays(
        [pa.array([f[i] for f in found], kind) for i, kind in enumerate(kinds)], names)


def _distinct(labels: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct labels, how often each occurs, and the number among them of each label."""
    order = order_of(labels)
    ordered = labels[order]
    new = np.concatenate([[True], (ordered[1:] != ordered[:-1]).any(axis=1)]) if len(labels) else \
        np.empty(0, bool)
    number = np.empty(len(labels), np.int64)
    number[order] = np.cumsum(new) - 1
    first = np.flatnonzero(new)
    return ordered[first], np.diff(np.append(first, len(labels))), number


def _opened(path: str) -> Iterator[pa.RecordBatch]:
    with files.opened(path) as source, pa.ipc.open_stream(source) as reader:
        yield from reader


def _part_pieces(path: str, text_at: int) -> Iterator[tuple[int, Piece]]:
    """The numbered pieces of a file; the numbers are the same each time."""
    block = 0
    for batch in _opened(path):
        for piece in pieces(batch.column(text_at)):
            yield block, piece
            block += 1


class Answers:
    """The bitmaps of one part: which labels of a piece occur again."""

    def __init__(self, rows: list[dict] | None) -> None:
        self.blocks: dict[int, list] = {}
        for row in rows or []:
            self.blocks.setdefault(row["block"], []).append((row["first"], row["n"], row["marks"]))

    def of(self, block: int, count: int) -> np.ndarray:
        marks = np.zeros(count, bool)
        for first, n, packed in self.blocks.get(block, ()):
            marks[first:first + n] = _flags(packed, n)
        return marks


#: Labels of a piece, given the answers so far.
Labels = Callable[[int, Piece, list], np.ndarray]


def write_parts(docs: DataFrame, text_col: str) -> DataFrame:
    """Writes the rows of each task to a file of its own; returns the stored list of files."""
    folder = scratch_path(docs.sparkSession, "texts")
    at = docs.columns.index(text_col)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batch = next(batches, None)
        if batch is None:
            return
        # A name for each attempt: the list holds those of the attempts that count.
        path, words = f"{folder}/{uuid.uuid4().hex}.arrows", 0
        options = pa.ipc.IpcWriteOptions(compression="zstd")
        with files.written(path) as sink, pa.ipc.new_stream(sink, batch.schema, options=options) as stream:
            while batch is not None:
                stream.write_batch(batch)
                for _, data, bounds in text_pieces(batch.column(at)):
                    words += len(runs(data, bounds, WORD_BYTES)[0])
                batch = next(batches, None)
        yield pa.RecordBatch.from_pydict({"path": [path], "words": [words]})

    return written_once(docs.mapInArrow(write, PARTS))


def _split(asks: DataFrame, most: int, digits: int) -> DataFrame:
    """The labels asked for, with prefixes lengthened until no group has more than ``most`` or one label."""
    settled: DataFrame | None = None
    while digits < 32:
        large = asks.groupBy("prefix").agg(F.sum("n").alias("all")).where(F.col("all") > most).select("prefix")
        large = written_once(large)
        if large.isEmpty():
            break
        rest = asks.join(large, "prefix", "left_anti").select(*asks.columns)
        settled = rest if settled is None else settled.unionByName(rest)
        digits += 2

        def longer(batches: Iterator[pa.RecordBatch], to: int = digits) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in batch.to_pylist():
                    labels = np.frombuffer(row["labels"], np.uint64).reshape(row["n"], -1)
                    twice = _flags(row["twice"], row["n"])
                    yield _asks([
                        (name, row["path"], row["block"], row["first"] + a, b - a, labels[a:b].tobytes(),
                         _packed(twice[a:b])) for name, a, b in prefix_ranges(labels, to)])

        asks = written_once(
            asks.join(large, "prefix", "left_semi").select(*asks.columns).mapInArrow(longer, ASKS))
    return asks if settled is None else settled.unionByName(asks)


def _subtree(group: pa.Table) -> pa.Table:
    """Which labels of a group are leaves of an internal node at full depth."""
    counts = group.column("n").to_pylist()
    labels = [np.frombuffer(blob, np.uint64).reshape(n, -1)
              for blob, n in zip(group.column("labels").to_pylist(), counts)]
    twice = [_flags(bits, n) for bits, n in zip(group.column("twice").to_pylist(), counts)]
    joined = np.concatenate(labels)
    order = order_of(joined)
    first, stop = deep_nodes(joined[order])
    repeated = np.concatenate(twice)
    sizes = stop - first
    within = np.repeat(np.logical_or.reduceat(repeated[order], first) | (sizes > 1), sizes)
    marks = np.empty(len(joined), bool)
    marks[order] = within
    cuts = np.cumsum([0, *counts]).tolist()
    return pa.table({
        "path": group.column("path"), "block": group.column("block"), "first": group.column("first"),
        "n": group.column("n"),
        "marks": pa.array([_packed(marks[a:b]) for a, b in zip(cuts, cuts[1:])], pa.binary())})


def answered(
    parts: DataFrame, told: list[str], labels: Labels, text_at: int, digits: int, most: int, out: str
) -> DataFrame:
    """Adds to each part, as ``out``, which of its labels occur again; ``told`` names earlier answers."""
    count = parts.count()

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                known = [Answers(row[name]) for name in told]
                for block, piece in _part_pieces(row["path"], text_at):
                    distinct, often, _ = _distinct(labels(block, piece, known))
                    yield _asks([
                        (name, row["path"], block, a, b - a, distinct[a:b].tobytes(), _packed(often[a:b] > 1))
                        for name, a, b in prefix_ranges(distinct, digits)])

    asks = written_once(parts.repartition(max(count, 1)).mapInArrow(ask, ASKS))
    found = _split(asks, most, digits).groupBy("prefix").applyInArrow(
        _subtree, "path string, block bigint, first bigint, n bigint, marks binary")
    by_part = found.groupBy("path").agg(
        F.collect_list(F.struct("block", "first", "n", "marks")).alias(out))
    return written_once(parts.join(by_part, "path", "left"))


def _report(piece: Piece, hit: np.ndarray, cleaned: bool) -> pa.StructArray:
    """One row for each text of a piece, given which words to remove."""
    # Kept words and one byte after each that does not end its text.
    last = np.zeros(len(hit), bool)
    last[piece.rows[1:][np.diff(piece.rows) > 0] - 1] = True
    after = piece.ends[~hit & ~(last & np.isin(piece.ends, piece.bounds))]
    data = piece.data.copy()
    steps = np.zeros(len(data) + 1, np.int8)
    steps[piece.starts[~hit]] += 1
    steps[piece.ends[~hit]] -= 1
    kept = np.cumsum(steps[:-1], dtype=np.int8) > 0
    kept[after], data[after] = True, 0x20
    ends = np.concatenate([[0], np.cumsum(kept)])[piece.bounds]
    raw = data[kept].tobytes()
    texts = [raw[a:b].rstrip(b" ") for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]
    count = np.concatenate([[0], np.cumsum(hit)])
    removed = count[piece.rows[1:]] - count[piece.rows[:-1]]
    edges = np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]])))
    spans: list[list] = [[] for _ in texts]
    for i in np.flatnonzero(removed).tolist():
        a, b = int(piece.rows[i]), int(piece.rows[i + 1])
        # Where one text ends removed and the next begins so, the run of the piece goes across.
        inner = edges[(edges > a) & (edges < b)].tolist()
        inner = [a] * bool(hit[a]) + inner + [b] * bool(hit[b - 1])
        spans[i] = [[x - a, y - a] for x, y in zip(inner[::2], inner[1::2])]
    columns = [np.diff(piece.rows), removed, [hashlib.sha256(t).hexdigest() for t in texts], removed > 0, spans,
               [t.decode() if n else None for t, n in zip(texts, removed)] if cleaned else [None] * len(texts)]
    return pa.StructArray.from_arrays(
        [pa.array(c, f.type) for c, f in zip(columns, REPORT)], fields=list(REPORT))


def find_repeats(
    docs: DataFrame, size: int = SIZE, text_col: str = "text", cleaned: bool = False, group: int = GROUP,
    out: str = "__repeats",
) -> DataFrame:
    """Adds to each document what of it is a repeat of ``size`` words or more, as struct ``out``.

    Words are what blanks separate, unchanged. The struct holds ``n_words, n_removed, kept_sha256, repeated,
    spans`` (maximal repeats as word ranges) and, if ``cleaned``, in ``text`` what is left of a text with
    repeats, one blank between words (null for others). A window of ``size`` words is a repeat if the same words
    also start anywhere else, in the same text or another; of copies, all are removed. Null, empty and short texts
    have no repeats; repeated rows are copies of each other. A text of any length is read whole, as a piece of its
    own where it is long. No documents give no rows. Documents keep all their columns, whatever their names, but for
    one named as ``out``.
    """
    text_at = docs.columns.index(text_col)
    parts = write_parts(docs, text_col)
    words = parts.agg(F.coalesce(F.sum("words"), F.lit(0))).first()[0]
    digits = 0
    while words >> 4 * digits > group:
        digits += 1

    def runs_asked(block: int, piece: Piece, known: list) -> np.ndarray:
        return anchored(piece, size).labels

    def candidates(block: int, piece: Piece, known: list) -> np.ndarray:
        """First words of the windows whose anchors' runs occur again."""
        found = anchored(piece, size)
        distinct, _, number = _distinct(found.labels)
        again = known[0].of(block, len(distinct))[number]
        return found.first[again[np.searchsorted(found.places, found.anchor)]] if len(again) else found.first

    def windows_asked(block: int, piece: Piece, known: list) -> np.ndarray:
        first = candidates(block, piece, known)
        if not len(first):
            return np.empty((0, SYMBOLS // 2), np.uint64)
        return window_labels(piece, first, size)

    parts = answered(parts, [], runs_asked, text_at, digits, group, "runs")
    parts = answered(parts, ["runs"], windows_asked, text_at, digits, group, "windows")

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for listed in batches:
            for row in listed.to_pylist():
                known = [Answers(row["runs"]), Answers(row["windows"])]
                block = 0
                for batch in _opened(row["path"]):
                    reports = []
                    for piece in pieces(batch.column(text_at)):
                        steps = np.zeros(len(piece.words) + 1, np.int64)
                        first = candidates(block, piece, known)
                        if len(first):
                            distinct, _, number = _distinct(window_labels(piece, first, size))
                            first = first[known[1].of(block, len(distinct))[number]]
                            np.add.at(steps, first, 1)
                            np.add.at(steps, first + size, -1)
                        reports.append(_report(piece, np.cumsum(steps[:-1]) > 0, cleaned))
                        block += 1
                    told = pa.concat_arrays(reports) if reports else pa.array([], pa.struct(list(REPORT)))
                    yield pa.RecordBatch.from_arrays([*batch.columns, told], names=[*batch.schema.names, out])

    schema = StructType([*docs.schema.fields, StructField(out, REPORT_TYPE)])
    return parts.repartition(max(parts.count(), 1)).mapInArrow(told, schema)
