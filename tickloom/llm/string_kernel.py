"""The gap-weighted subsequence kernel of short strings against landmarks, vectorised.

A feature is a subsequence of three characters; each place where it occurs adds ``DECAY`` to the power of the
characters it spans, gaps included, up to ``SPAN``. Kernels with a landmark are divided by the landmark's
kernel with itself, so a string that holds the landmark has 1 however long it is, and inserted or
missing characters lower that a little.
"""

from __future__ import annotations

import re

import numpy as np

from tickloom.llm.spans import mix

DECAY = 0.7
SPAN = 7
#: Steps from the first to the second and the third character of a subsequence.
STEPS = [(near, far) for far in range(2, SPAN) for near in range(1, far)]

#: Longer strings are compared by windows of this size, each half over the one before.
LONGEST = 40
#: Strings handled at once.
BATCH = 1024

_PLAIN = re.compile(r"[\W_]+")


def pieces_of(token: str) -> list[str]:
    """What the kernel sees of a token in lower case: its letters and digits, in windows if it is long."""
    plain = token if token.isalnum() else _PLAIN.sub("", token)
    if len(plain) <= LONGEST:
        return [plain] if len(plain) > 2 else []
    return [plain[at:at + LONGEST] for at in range(0, len(plain) - LONGEST // 2, LONGEST // 2)]


def _occurrences(strings: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Subsequences within the span, as (string's number, feature, weight)."""
    sizes = np.fromiter(map(len, strings), np.int64, len(strings))
    letters = np.frombuffer("".join(strings).encode("utf-32-le"), np.uint32).astype(np.uint64)
    owner = np.repeat(np.arange(len(strings)), sizes)
    left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(letters))
    codes, owners, weights = [], [], []
    for near, far in STEPS:
        at = np.flatnonzero(left > far)
        codes.append(letters[at] << np.uint64(42) | letters[at + near] << np.uint64(21)
                     | letters[at + far])
        owners.append(owner[at])
        weights.append(np.full(len(at), DECAY ** (far + 1), dtype=np.float32))
    return np.concatenate(owners), np.concatenate(codes), np.concatenate(weights)


class Landmarks:
    """Strings of three characters or more that others are compared with.

    Similarities are 1 at most, and 0 below ``floor``.
    """

    def __init__(self, strings: list[str], floor: float = 0.0) -> None:
        self.strings, self.floor = strings, floor
        who, code, weight = _occurrences(strings)
        self.codes, place = np.unique(code, return_inverse=True)
        self.features = np.zeros((len(self.codes), len(strings)))
        np.add.at(self.features, (place, who), weight)
        own = (self.features ** 2).sum(axis=0)
        self.matrix = (self.features / own).astype(np.float32)
        self.known = np.zeros(1 << 16, dtype=bool)
        self.known[mix(self.codes) >> np.uint64(48)] = True

    def similarities(self, strings: list[str]) -> np.ndarray:
        """The kernel of each string with each landmark."""
        parts = [self._products(strings[at:at + BATCH]) for at in range(0, len(strings), BATCH)]
        out = np.vstack(parts) if parts else np.zeros((0, len(self.strings)), np.float32)
        out[out < self.floor] = 0
        return np.minimum(out, 1, out=out)

    def _products(self, strings: list[str]) -> np.ndarray:
        who, code, weight = _occurrences(strings)
        maybe = np.flatnonzero(self.known[mix(code) >> np.uint64(48)])
        who, code, weight = who[maybe], code[maybe], weight[maybe]
        place = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
        met = np.flatnonzero(self.codes[place] == code)
        met = met[np.argsort(who[met], kind="stable")]
        out = np.zeros((len(strings), len(self.strings)), dtype=np.float32)
        if len(met):
            rows, firsts = np.unique(who[met], return_index=True)
            out[rows] = np.add.reduceat(
                self.matrix[place[met]] * weight[met][:, None], firsts, axis=0)
        return out

    def whitening(self, ridge: float = 1e-3) -> np.ndarray:
        """The inverse square root of the landmarks' own kernel (the Nyström map)."""
        norms = np.sqrt((self.features ** 2).sum(axis=0))
        unit = self.features / norms
        own = unit.T @ unit
        values, vectors = np.linalg.eigh(own)
        return vectors / np.sqrt(np.maximum(values, 0) + ridge) @ vectors.T
