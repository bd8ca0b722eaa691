"""Token ids of texts, with the ids of repeated pre-tokens looked up instead of computed again."""

from __future__ import annotations

import gc
import json
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer

from tickloom.llm.spans import give_back, hashes, mix, text_pieces

#: Pre-tokens remembered in each of the two generations of the cache.
REMEMBERED = 120_000
#: Bytes of text cut at once; the arrays made of them take some twenty times as much.
CUT_BYTES = 1 << 20

LETTER, DIGIT, SPACE, OTHER, FOREIGN = range(5)


def _byte_classes() -> np.ndarray:
    """Classes of the bytes of ASCII text and of U+00C0 to U+024F; FOREIGN: none of these."""
    classes = np.full(256, FOREIGN, dtype=np.uint8)
    classes[:0x80] = OTHER
    classes[[0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20]] = SPACE
    classes[0x30:0x3A] = DIGIT
    classes[0x41:0x5B] = classes[0x61:0x7B] = LETTER
    classes[0x80:0xC0] = LETTER  # continuation bytes
    classes[0xC3:0xCA] = LETTER
    return classes


CLASSES = _byte_classes()
#: Second bytes after 0xC3 of the two signs among those letters (multiplication and division).
SIGNS = (0x97, 0xB7)


def _byte_letters() -> dict[int, int]:
    """How byte-level vocabularies write a byte: printable ones as they are, others from 256 up."""
    kept = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = [b for b in range(256) if b not in kept]
    return {**{b: b for b in kept}, **{b: 256 + n for n, b in enumerate(rest)}}


BYTE_LETTERS = _byte_letters()


def pre_token_starts(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Marks where the byte-level pattern cuts texts without FOREIGN bytes.

    Runs of letters, digits or other signs, each with one blank before it; white space up to the last
    character before a run; English contractions after an apostrophe.
    """
    size = len(data)
    kinds = CLASSES[data]
    begins = np.zeros(size + 1, dtype=bool)
    begins[bounds] = True
    change = begins.copy()
    change[1:size] |= kinds[1:] != kinds[:-1]
    cuts = change.copy()
    # A run after white space takes a blank; otherwise the last white character stands alone.
    inner = np.flatnonzero(change[1:size] & ~begins[1:size]) + 1
    after = inner[(kinds[inner] != SPACE) & (kinds[inner - 1] == SPACE)]
    cuts[after - 1] = True
    cuts[after[data[after - 1] == 0x20]] = False
    # Contractions: a single apostrophe that no blank precedes, then letters.
    marks = np.flatnonzero((data == 0x27) & cuts[:size])
    marks = marks[marks + 1 < size]
    marks = marks[change[marks + 1] & ~begins[marks + 1] & (kinds[marks + 1] == LETTER)]
    if len(marks):
        ends = np.asarray(bounds)[np.searchsorted(bounds, marks, "right")]
        first = data[marks + 1]
        has_second = marks + 2 < ends
        second = np.where(has_second, data[np.minimum(marks + 2, size - 1)], 0)
        short = np.isin(first, np.frombuffer(b"stmd", np.uint8))
        pair = first.astype(np.uint16) << 8 | second
        long = np.isin(pair, [int.from_bytes(x, "big") for x in (b"re", b"ve", b"ll")])
        for chosen, length in ((short, 2), (long & ~short, 3)):
            cuts[marks[chosen] + 1] = False
            cuts[marks[chosen] + length] = True
    return np.flatnonzero(cuts[:size])


class Encoder:
    """Encodes string columns without special tokens, exactly as ``tokenizer.encode`` does.

    Texts of ASCII and Latin letters are cut here and their distinct pre-tokens go to the tokenizer's
    model once; other texts, and all texts of other kinds of tokenizers, go to it whole.
    """

    def __init__(self, path: str) -> None:
        self.tokenizer = Tokenizer.from_file(path)
        spec = json.loads(self.tokenizer.to_str())
        before = spec["pre_tokenizer"] or {}
        self.cuts_here = (
            spec["normalizer"] is None and before.get("type") == "ByteLevel"
            and before.get("use_regex") is True and before.get("add_prefix_space") is False
            and spec["model"].get("type") == "BPE" and not spec["model"].get("dropout"))
        self.added = [t["content"] for t in spec["added_tokens"]]
        self.recent: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}

    @property
    def vocabulary_size(self) -> int:
        return self.tokenizer.get_vocab_size()

    def _new_ids(self, pre_token: bytes) -> bytes:
        letters = pre_token.decode("latin-1").translate(BYTE_LETTERS)
        return array("I", [t.id for t in self.tokenizer.model.tokenize(letters)]).tobytes()

    def _ids_of(self, pre_tokens: list[bytes]) -> list[bytes]:
        """The ids of each pre-token as 32-bit integers in native order."""
        get, older = self.recent.get, self.older
        found = [get(p) for p in pre_tokens]
        for i, known in enumerate(found):
            if known is None:
                known = older.get(pre_tokens[i]) or self._new_ids(pre_tokens[i])
                found[i] = self.recent[pre_tokens[i]] = known
        if len(self.recent) > REMEMBERED:
            self.older, self.recent = self.recent, {}
        return found

    def _whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype=np.uint32)

    def encode(self, column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Yields (first row, ids, bounds of the rows' ids) for pieces of the column; null is empty."""
        column = pc.fill_null(column.cast(pa.large_string()), "")
        special = np.zeros(len(column), dtype=bool)
        for content in self.added:
            special |= np.asarray(pc.match_substring(column, content))
        for row, data, bounds in text_pieces(column, CUT_BYTES):
            count = len(bounds) - 1
            whole = special[row:row + count].copy()
            foreign = np.flatnonzero(CLASSES[data] == FOREIGN)
            signs = np.flatnonzero((data[:-1] == 0xC3) & np.isin(data[1:], SIGNS))
            whole[np.searchsorted(bounds, np.concatenate([foreign, signs]), "right") - 1] = True
            if not self.cuts_here:
                whole[:] = True
            if whole.all():
                flat, ends = np.empty(0, np.uint32), np.zeros(count + 1, np.int64)
            else:
                flat, ends = self._looked_up(data, bounds, whole)
            if whole.any():
                parts = [
                    self._whole(column[row + i].as_py()) if whole[i] else flat[ends[i]:ends[i + 1]]
                    for i in range(count)]
                flat = np.concatenate(parts) if parts else flat
                ends = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)
            yield row, flat, ends

    def _looked_up(
        self, data: np.ndarray, bounds: np.ndarray, skipped: np.ndarray
    ) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the rows that are not skipped, which have none here."""
        starts = pre_token_starts(data, bounds)
        ends = np.append(starts[1:], len(data))
        rows = np.searchsorted(bounds, starts, "right") - 1
        kept = ~skipped[rows]
        starts, ends, rows = starts[kept], ends[kept], rows[kept]
        names = hashes(data, starts, ends)
        # 128 bits: two polynomials over different byte values.
        second = hashes(data, starts, ends, OTHER_VALUES)
        _, first, inverse = np.unique(names ^ mix(second), return_index=True, return_inverse=True)
        raw = data.tobytes()
        if not np.array_equal(second[first][inverse], second):  # equal names of different spans
            found = self._ids_of([raw[a:b] for a, b in zip(starts.tolist(), ends.tolist())])
            flat = np.frombuffer(b"".join(found), np.uint32)
            sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
        else:
            found = self._ids_of([
                raw[a:b] for a, b in zip(starts[first].tolist(), ends[first].tolist())])
            known = np.frombuffer(b"".join(found), np.uint32)
            lengths = np.fromiter(map(len, found), np.int64, len(found)) // 4
            offsets = np.cumsum(lengths) - lengths
            sizes = lengths[inverse]
            before = np.cumsum(sizes) - sizes
            flat = known[np.arange(int(sizes.sum())) + np.repeat(offsets[inverse] - before, sizes)]
        per_row = np.bincount(rows, weights=sizes, minlength=len(bounds) - 1).astype(np.int64)
        return flat, np.concatenate([[0], np.cumsum(per_row)])


OTHER_VALUES = np.random.default_rng(77).integers(0, 1 << 64, 256, dtype=np.uint64)

_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The encoder of a vocabulary file; one for each worker process, with its cache."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def release() -> None:
    """Drops the encoders that an earlier stage left in this worker process, with all they remember."""
    _ENCODERS.clear()
    gc.collect()
    give_back()
