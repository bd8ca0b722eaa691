"""Benchmark passages in training texts, found by their word windows.

A benchmark item is cut into windows of ``size`` consecutive words (an item with fewer words, but not
none, is one window). Hashes of the windows are broadcast while their number stays below a bound;
tasks slide over each training text and look every window up. A hit is verified by comparing its words.
Beyond the bound, the windows stay a distributed table that the hashes of the training windows are
joined with.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.functions import arrow_udf

from tickloom.llm.spans import BYTE_VALUES, LOWER, give_back, hashes, runs, text_pieces, windows
from tickloom.llm.tables import OWN
from tickloom.session import written_once

WINDOW = 10
#: Benchmark windows up to which their hashes are broadcast; each takes about 250 bytes.
BROADCAST_WINDOWS = 200_000

#: Bytes of words: digits, letters, and all of non-ASCII characters.
WORD_BYTES = np.zeros(256, dtype=bool)
WORD_BYTES[0x30:0x3A] = WORD_BYTES[0x41:0x5B] = WORD_BYTES[0x61:0x7B] = True
WORD_BYTES[0x80:] = True
LOWERED = BYTE_VALUES[LOWER]

WINDOWS = "item string, size int, hash bigint, words binary"


def normal_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> bytes:
    """The words in lower case, one blank between two."""
    lowered = LOWER[data[starts[0]:ends[-1]]].tobytes()
    low = int(starts[0])
    return b" ".join(lowered[a - low:b - low] for a, b in zip(starts.tolist(), ends.tolist()))


@dataclass(frozen=True)
class Piece:
    """The words of some consecutive texts of a column."""

    row: int
    data: np.ndarray
    bounds: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    words: np.ndarray
    #: Number of the first word of each text, and of all.
    rows: np.ndarray

    def normal(self, first: int, stop: int) -> bytes:
        return normal_words(self.data, self.starts[first:stop], self.ends[first:stop])

    def windows(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the windows that lie within one text, and their first words."""
        found = windows(self.words, size).astype(np.int64)
        text = np.searchsorted(self.rows, np.arange(len(self.words)), "right")
        first = np.flatnonzero(text[:len(found)] == text[size - 1:]) if len(found) else \
            np.empty(0, np.int64)
        return found[first], first


def pieces(column: pa.Array) -> Iterator[Piece]:
    for row, data, bounds in text_pieces(column):
        starts, ends = runs(data, bounds, WORD_BYTES)
        words = hashes(data, starts, ends, LOWERED)
        yield Piece(row, data, bounds, starts, ends, words, np.searchsorted(starts, bounds))


def item_windows(benchmark: DataFrame, size: int, id_col: str, text_col: str) -> DataFrame:
    """The distinct windows of the items; items without words have none."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.column(0).to_pylist()
            for piece in pieces(batch.column(1)):
                out: list[tuple] = []
                for i in range(len(piece.rows) - 1):
                    a, b = int(piece.rows[i]), int(piece.rows[i + 1])
                    width = min(size, b - a)
                    if width:
                        own = windows(piece.words[a:b], width).astype(np.int64).tolist()
                        out += [(names[piece.row + i], width, value,
                                 piece.normal(a + k, a + k + width))
                                for k, value in enumerate(own)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([o[c] for o in out], kind) for c, kind in enumerate(
                        (pa.string(), pa.int32(), pa.int64(), pa.binary()))],
                    ["item", "size", "hash", "words"])

    items = benchmark.where(F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("string").alias("item"), F.col(text_col).cast("string").alias("text"))
    return items.mapInArrow(cut, WINDOWS).distinct()


@dataclass(frozen=True)
class Known:
    """Benchmark windows as arrays: sorted hashes for each size, and who has which words."""

    hashes: dict[int, np.ndarray]
    items: dict[bytes, tuple[str, ...]]

    @classmethod
    def of(cls, rows: list) -> Known:
        sizes: dict[int, set] = {}
        items: dict[bytes, set] = {}
        for row in rows:
            sizes.setdefault(row["size"], set()).add(row["hash"])
            items.setdefault(bytes(row["words"]), set()).add(row["item"])
        return cls(
            {size: np.array(sorted(found), np.int64) for size, found in sizes.items()},
            {words: tuple(sorted(found)) for words, found in items.items()})

    def occurrences(self, piece: Piece) -> dict[int, list[tuple[int, int, tuple[str, ...]]]]:
        """Verified windows by text of the piece, as (first word, word after, items)."""
        found: dict[int, list] = {}
        for size, wanted in self.hashes.items():
            own, first = piece.windows(size)
            if not len(own):
                continue
            place = np.minimum(np.searchsorted(wanted, own), len(wanted) - 1)
            for k in first[wanted[place] == own].tolist():
                items = self.items.get(piece.normal(k, k + size))
                if items:
                    row = int(np.searchsorted(piece.rows, k, "right")) - 1
                    found.setdefault(row, []).append((k, k + size, items))
        return found


def covered(spans: list[tuple[int, int]], size: int) -> np.ndarray:
    """Which of ``size`` words lie in any span."""
    steps = np.zeros(size + 1, dtype=np.int64)
    for first, stop in spans:
        steps[first] += 1
        steps[stop] -= 1
    return np.cumsum(steps[:-1]) > 0


def _summary(names: set[str]) -> str:
    return hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()


REPORT = pa.schema([
    ("n_words", pa.int64()), ("n_hit", pa.int64()), ("n_items", pa.int64()),
    ("items_sha256", pa.string()), ("contaminated", pa.bool_()),
    ("items", pa.list_(pa.string())), ("text", pa.string())])
REPORT_TYPE = ("n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, "
               "contaminated boolean, items array<string>, text string")


def without(text: bytes, starts: np.ndarray, ends: np.ndarray, hit: np.ndarray) -> str:
    """The text without its hit words, each with what stands between it and the next word."""
    pieces, at = [], 0
    edges = np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]])))
    for first, stop in edges.reshape(-1, 2).tolist():
        pieces.append(text[at:int(starts[first])])
        at = int(starts[stop]) if stop < len(starts) else int(ends[stop - 1])
    pieces.append(text[at:])
    return b"".join(pieces).decode()


def _cleaned(text: bytes, known: Known) -> str:
    """The text without hit words; where a cut brings together another window, that goes too."""
    while True:
        [piece] = pieces(pa.array([text.decode()], pa.large_string()))
        spans = known.occurrences(piece).get(0)
        if not spans:
            return text.decode()
        hit = covered([s[:2] for s in spans], len(piece.words))
        text = without(text, piece.starts, piece.ends, hit).encode()


def report(piece: Piece, found: dict, known: Known | list[Known], cleaned: bool) -> pa.StructArray:
    """One row for each text of the piece; ``known`` may differ from text to text."""
    count = len(piece.rows) - 1
    n_hit, n_items = np.zeros(count, np.int64), np.zeros(count, np.int64)
    sums, items = [_summary(set())] * count, [[]] * count
    texts: list[str | None] = [None] * count
    for i, spans in found.items():
        a, b = int(piece.rows[i]), int(piece.rows[i + 1])
        hit = covered([(first - a, stop - a) for first, stop, _ in spans], b - a)
        names = {name for *_, owners in spans for name in owners}
        n_hit[i], n_items[i], sums[i], items[i] = hit.sum(), len(names), _summary(names), sorted(names)
        if cleaned:
            low, high = int(piece.bounds[i]), int(piece.bounds[i + 1])
            texts[i] = _cleaned(piece.data[low:high].tobytes(),
                                known if isinstance(known, Known) else known[i])
    columns = [np.diff(piece.rows), n_hit, n_items, sums, n_hit > 0, items, texts]
    return pa.StructArray.from_arrays(
        [pa.array(c, f.type) for c, f in zip(columns, REPORT)], fields=list(REPORT))


def _stacked(parts: list[pa.Array]) -> pa.Array:
    return pa.concat_arrays(parts) if parts else pa.array([], pa.struct(list(REPORT)))


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, text_col: str = "text",
    item_col: str = "item_id", item_text_col: str = "text", cleaned: bool = False,
    broadcast_windows: int = BROADCAST_WINDOWS, out: str = "__found",
) -> DataFrame:
    """Adds to each document what it shares with the benchmark, as struct ``out``.

    The struct holds ``n_words, n_hit, n_items, items_sha256, contaminated, items`` and, if ``cleaned``,
    in ``text`` the contaminated text without hit words, also those that only a cut brings together
    (null for others). A null or empty text has
    no words and no hits; items without an id, words or text have no windows, and no benchmark rows
    mean no hits; an item's repeated rows count once; repeated documents are reported each. Texts of any
    length are read whole, in pieces. Documents
    keep all their columns, whatever their names, but for one named as ``out``.
    """
    stored = written_once(item_windows(benchmark, size, item_col, item_text_col))
    if stored.count() > broadcast_windows:
        return _joined(docs, text_col, stored, cleaned, out)
    shared = docs.sparkSession.sparkContext.broadcast(pickle.dumps(Known.of(stored.collect())))
    loaded: list[Known] = []

    def found(texts: pa.Array) -> pa.Array:
        if not loaded:
            loaded.append(pickle.loads(shared.value))
        give_back()
        return _stacked([report(p, loaded[0].occurrences(p), loaded[0], cleaned) for p in pieces(texts)])

    return docs.withColumn(out, arrow_udf(found, REPORT_TYPE)(F.col(text_col).cast("string")))


def _joined(
    docs: DataFrame, text_col: str, stored: DataFrame, cleaned: bool, out: str
) -> DataFrame:
    """The same without a broadcast: window hashes of the documents meet those of the items in a join.

    Each text's distinct hashes are joined; the windows found come back to their text, where they are
    looked up and verified as before. A hash that many texts share is split by skew handling.
    """
    row, text = f"{OWN}row", F.col(text_col).cast("string")
    sizes = [r["size"] for r in stored.select("size").distinct().collect()]  # at most ``size`` rows
    numbered = written_once(docs.withColumn(row, F.monotonically_increasing_id()))

    def hashed(texts: pa.Array) -> pa.Array:
        lists = []
        for piece in pieces(texts):
            own: list[list] = [[] for _ in piece.rows[1:]]
            for width in sizes:
                values, first = piece.windows(width)
                at = np.searchsorted(first, piece.rows)
                for i in range(len(own)):
                    own[i] += [{"size": width, "hash": h}
                               for h in np.unique(values[at[i]:at[i + 1]]).tolist()]
            lists += own
        return pa.array(lists, pa.list_(pa.struct([("size", pa.int32()), ("hash", pa.int64())])))

    cut = arrow_udf(hashed, "array<struct<size int, hash bigint>>")
    met = (
        numbered.select(row, F.explode(cut(text)).alias("w")).select(row, "w.size", "w.hash")
        .join(stored, ["size", "hash"])
        .groupBy(row).agg(F.collect_list(F.struct("item", "size", "hash", "words")).alias("windows"))
        .select(F.col(row).alias(f"{OWN}met"), F.col("windows").alias(f"{OWN}windows")))

    def verified(texts: pa.Array, known: pa.Array) -> pa.Array:
        parts = []
        for piece in pieces(texts):
            own = [Known.of(known[piece.row + i].as_py() or []) for i in range(len(piece.rows) - 1)]
            found = {i: one.occurrences(piece).get(i, []) for i, one in enumerate(own) if one.items}
            parts.append(report(
                piece, {i: spans for i, spans in found.items() if spans}, own, cleaned))
        return _stacked(parts)

    result = numbered.join(met, F.col(row) == F.col(f"{OWN}met"), "left").withColumn(
        out, arrow_udf(verified, REPORT_TYPE)(text, F.col(f"{OWN}windows")))
    if cleaned:
        # A cut may bring together windows that the text did not have.
        again, text_left, deeper = f"{out}_again", f"{out}_left", f"{out}_next"
        result = written_once(result.drop(f"{OWN}met", f"{OWN}windows"))
        cut = result.where(F.col(out)["contaminated"]).select(
            F.col(row).alias(again), F.col(out)["text"].alias(text_left))
        if not cut.isEmpty():
            left = _joined(cut, text_left, stored, True, deeper).select(
                again, F.col(deeper)["text"].alias(text_left))
            result = result.join(left, F.col(row) == F.col(again), "left").withColumn(
                out, F.col(out).withField("text", F.coalesce(text_left, F.col(out)["text"])))
        result = result.drop(again, text_left)
    return result.drop(row, f"{OWN}met", f"{OWN}windows")
