"""Toxic texts, by a support vector machine on a subsequence string kernel.

A sentence is as similar to a landmark, an insult met in training, as its most similar token is under the
gap-weighted subsequence kernel, so that gaps and inserted characters do not hide it. The Nyström map of these
similarities feeds a linear support vector machine. It learns from sentences: those of clean
documents, and of each toxic document the one that the machine itself finds most toxic, in some rounds, since
a label says only that some sentence is toxic. A text scores as its most toxic sentence does, on a logistic
curve fitted to whole documents.
"""

from __future__ import annotations

import pickle
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.functions import arrow_udf

from tickloom.llm.string_kernel import BATCH, Landmarks, pieces_of
from tickloom.llm.spans import give_back
from tickloom.llm.tokens import release
from tickloom.session import written_once

#: Labelled documents to learn from at most, those with the smallest hashes of their ids.
TOXIC_SAMPLE, CLEAN_SAMPLE = 3000, 6000
#: Sizes of the parts of tokens that may become landmarks, beside whole tokens.
PARTS = (4, 5)
#: Strings considered as landmarks, the documents that must have one, and the landmarks chosen.
CANDIDATES, LEAST_DOCUMENTS, LANDMARKS = 800, 3, 64
#: Similarity below which a token and a landmark have nothing in common.
FLOOR = 0.6
#: Sentences kept of a document in training, those closest to the landmarks.
SENTENCES = 16
#: Tokens after which a text without sentence ends is cut.
LONGEST_SENTENCE = 256
ROUNDS = 4
COST = 1.0
#: Tokens remembered by a worker, and looked at together.
REMEMBERED, TOGETHER = 150_000, 25_000

_ENDS = re.compile(r"(?<=[.!?])\s+|\n+")
_SPACED = re.compile(r"(?<!\S)(?:\w\s){2,}\w(?!\S)")


def sentences(text: str) -> Iterator[set[str]]:
    """The tokens of each sentence in lower case; letters that stand apart also come as one token."""
    for part in _ENDS.split(text.lower()):
        tokens = part.split()
        for at in range(0, len(tokens), LONGEST_SENTENCE):
            yield set(tokens[at:at + LONGEST_SENTENCE])
        joined = {"".join(m[0].split()) for m in _SPACED.finditer(part)}
        if joined:
            yield joined


class Similarities:
    """Similarity vectors of sentences, with those of tokens remembered."""

    def __init__(self, landmarks: Landmarks) -> None:
        self.landmarks = landmarks
        self._forget()

    def _forget(self) -> None:
        self.rows: dict[str, int] = {}
        self.vectors: list[np.ndarray] = []

    def _learn(self, tokens: set[str]) -> None:
        if len(self.rows) > REMEMBERED:
            self._forget()
        new = [t for t in tokens if t not in self.rows]
        owners = [(i, p) for i, t in enumerate(new) for p in pieces_of(t)]
        self.rows.update(dict.fromkeys(new, -1))
        for first in range(0, len(owners), BATCH):
            found = self.landmarks.similarities([p for _, p in owners[first:first + BATCH]])
            for k in np.flatnonzero(found.any(axis=1)).tolist():
                token = new[owners[first + k][0]]
                if self.rows[token] < 0:
                    self.rows[token] = len(self.vectors)
                    # A copy, since a view would keep all that was found with it.
                    self.vectors.append(found[k].copy())
                else:
                    at = self.rows[token]
                    self.vectors[at] = np.maximum(self.vectors[at], found[k])

    def of(self, texts: list[str | None]) -> Iterator[tuple[int, np.ndarray]]:
        """(text's number, vector) of every sentence that is similar to some landmark."""
        held: list[tuple[int, set[str]]] = []
        count = 0
        for i, text in enumerate(texts):
            for tokens in sentences(text or ""):
                held.append((i, tokens))
                count += len(tokens)
                if count >= TOGETHER:
                    yield from self._vectors(held)
                    held, count = [], 0
        yield from self._vectors(held)

    def _vectors(self, held: list[tuple[int, set[str]]]) -> Iterator[tuple[int, np.ndarray]]:
        if held:
            self._learn(set().union(*[tokens for _, tokens in held]))
        get = self.rows.__getitem__
        for i, tokens in held:
            rows = [r for r in map(get, tokens) if r >= 0]
            if rows:
                yield i, np.max([self.vectors[r] for r in rows], axis=0)


@dataclass(frozen=True)
class Model:
    """A fitted machine: landmarks, weights on similarities and bias, slope and shift of the curve."""

    landmarks: tuple[str, ...]
    weights: np.ndarray
    bias: float
    slope: float
    shift: float

    def probability(self, decision: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * decision + self.shift, -30, 30)))


def support_vectors(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Weights and bias of a linear machine with squared hinge loss, by Newton's method; y is -1 or 1."""
    x = np.hstack([x, np.ones((len(x), 1))])
    ridge = np.eye(x.shape[1])
    ridge[-1, -1] = 1e-6
    w = np.zeros(x.shape[1])

    def loss(w: np.ndarray) -> float:
        return w @ ridge @ w / 2 + COST * (weight * np.maximum(0, 1 - y * (x @ w)) ** 2).sum()

    for _ in range(50):
        inside = y * (x @ w) < 1
        near, scale = x[inside], 2 * COST * weight[inside]
        gradient = ridge @ w - near.T @ (scale * (y[inside] - near @ w))
        step = np.linalg.solve(ridge + (near.T * scale) @ near, gradient)
        size = 1.0
        while size > 1e-4 and loss(w - size * step) > loss(w):
            size /= 2
        w = w - size * step
        if np.abs(step).max() < 1e-6:
            break
    return w


def logistic(f: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the curve that fits 0 and 1 labels to decisions, by Newton's method."""
    x = np.column_stack([f, np.ones(len(f))])
    w = np.zeros(2)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (weight * (p - y)) + 1e-3 * w
        hessian = (x.T * (weight * p * (1 - p))) @ x + 1e-3 * np.eye(2)
        step = np.linalg.solve(hessian, gradient)
        w = w - step * min(1.0, 2.0 / max(np.abs(step).max(), 1e-12))
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0]), float(w[1])


def choose(docs_of: dict[str, np.ndarray], gain: dict[str, float], count: int) -> list[str]:
    """Strings that cover the toxic documents best; each cover of a document halves what the next adds.

    Strings that hold a chosen one or are part of it are left out.
    """
    docs_of = dict(docs_of)
    worth = {doc: 1.0 for docs in docs_of.values() for doc in docs}
    chosen: list[str] = []
    while docs_of and len(chosen) < count:
        best = max(sorted(docs_of), key=lambda p: gain[p] * sum(worth[d] for d in docs_of[p]))
        for d in docs_of.pop(best):
            worth[d] /= 2
        chosen.append(best)
        docs_of = {p: d for p, d in docs_of.items() if p not in best and best not in p}
    return chosen


def _pieces(sample: DataFrame) -> DataFrame:
    """The distinct strings of each document that may become landmarks: ``doc, label, piece``."""
    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            for doc, label, text in zip(*batch.columns):
                found = {p for s in sentences(text.as_py() or "") for w in s for p in pieces_of(w)}
                found |= {p[at:at + n] for p in found for n in PARTS for at in range(len(p) - n + 1)}
                yield pa.RecordBatch.from_arrays(
                    [pa.array([doc.as_py()] * len(found), pa.int64()),
                     pa.array([label.as_py()] * len(found), pa.int32()),
                     pa.array(sorted(found), pa.string())], ["doc", "label", "piece"])

    rows = sample.select(F.monotonically_increasing_id().alias("doc"), "label", "text")
    return rows.mapInArrow(distinct, "doc bigint, label int, piece string")


def _sample(labels: DataFrame, sizes: dict[int, int]) -> DataFrame:
    """At most so many labelled ids of each class, by the smallest hashes."""
    parts = [
        labels.where(F.col("label") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
        for label, most in sizes.items()]
    return parts[0].unionByName(parts[1])


def fit(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    label_col: str = "toxic", toxic_sample: int = TOXIC_SAMPLE, clean_sample: int = CLEAN_SAMPLE,
) -> Model:
    """Learns from a bounded sample of the labelled documents; only their texts are used.

    An id with several labels counts as toxic if one is; null ids and labels are ignored. Without toxic
    or without clean documents, or without a token that tells them apart, the model scores all texts
    alike, by the share of toxic labels (0 without labels). Of more documents than the sample holds, those with the
    smallest hashes of their ids count, equal hashes by id; repeated rows of a document count each. Sampled
    texts are read whole, whatever their length. Other columns, whatever their names, are not read.
    """
    known = written_once(labels.where(
        F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(
        F.col(id_col).alias("doc_id")).agg(F.max((F.col(label_col) != 0).cast("int")).alias("label")))
    total = {r["label"]: r["n"] for r in known.groupBy("label").agg(
        F.count(F.lit(1)).alias("n")).collect()}
    share = total.get(1, 0) / max(1, sum(total.values()))
    odds = np.log((share + 1e-6) / (1 - share + 1e-6))
    constant = Model((), np.zeros(0), 0.0, 0.0, float(odds))
    if len(total) < 2:
        return constant
    ids = _sample(known, {1: toxic_sample, 0: clean_sample})
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    # At most the two samples' ids are broadcast.
    sample = written_once(texts.join(F.broadcast(ids), "doc_id"))
    sizes = {r["label"]: r["n"] for r in sample.groupBy("label").agg(
        F.count(F.lit(1)).alias("n")).collect()}
    if len(sizes) < 2:
        return constant
    cut = written_once(_pieces(sample))
    counts = cut.groupBy("piece").agg(
        F.sum("label").alias("toxic"), F.sum(1 - F.col("label")).alias("clean")
    ).where(F.col("toxic") >= LEAST_DOCUMENTS)
    # What the string tells of a toxic document, times how many toxic documents have it.
    toxic, clean = F.col("toxic") / sizes[1], (F.col("clean") + 0.5) / (sizes[0] + 1)
    told = counts.withColumn("told", F.log(toxic / clean)).where("told > 0")
    top = written_once(told.orderBy(
        F.desc(F.col("toxic") * F.col("told")), "piece").limit(CANDIDATES))
    rows = top.collect()
    if not rows:
        return constant
    # Of parts of a token that tell the same, the longer one.
    gain = {r["piece"]: r["told"] * (1 + 0.01 * len(r["piece"])) for r in rows}
    # At most the toxic sample's numbers for each candidate.
    owners = cut.where("label = 1").join(F.broadcast(top.select("piece")), "piece").groupBy(
        "piece").agg(F.collect_set("doc").alias("docs")).toPandas()
    landmarks = tuple(choose(dict(zip(owners["piece"], owners["docs"])), gain, LANDMARKS))
    return _trained(sample, landmarks, total, sizes)


def _trained(sample: DataFrame, landmarks: tuple[str, ...], total: dict, sizes: dict) -> Model:
    names = list(landmarks)

    def vectors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        release()
        similar = Similarities(Landmarks(names, FLOOR))
        for batch in batches:
            own: dict[int, list] = {}
            for i, vector in similar.of(batch["text"].tolist()):
                own.setdefault(i, []).append(vector)
            out = []
            for i, found in own.items():
                nearest = sorted(found, key=lambda v: -v.max())[:SENTENCES]
                out += [(batch["doc"].iloc[i], batch["label"].iloc[i], v) for v in nearest]
            yield pd.DataFrame(out, columns=["doc", "label", "x"])

    rows = sample.withColumn("doc", F.monotonically_increasing_id()).select(
        "doc", "label", "text").mapInPandas(vectors, "doc bigint, label int, x array<float>")
    found = rows.toPandas().sort_values("doc", kind="stable", ignore_index=True)
    if found.empty:
        return Model((), np.zeros(0), 0.0, 0.0, float(np.log(total[1] / total[0])))
    x = np.stack(found["x"].to_numpy()).astype(np.float64)
    whitening = Landmarks(names).whitening()
    mapped = x @ whitening
    doc, label = found["doc"].to_numpy(), found["label"].to_numpy()
    toxic = label == 1
    # Sentences without any similarity: most of those of clean documents.
    blank = np.zeros((1, mapped.shape[1]))
    witness = toxic & _firsts(doc, x.max(axis=1))
    for _ in range(ROUNDS):
        used = witness | ~toxic
        w = support_vectors(
            np.vstack([mapped[used], blank]), np.append(np.where(toxic[used], 1.0, -1.0), -1.0),
            np.append(np.ones(used.sum()), sizes[0]))
        decision = mapped @ w[:-1] + w[-1]
        new = toxic & _firsts(doc, decision)
        if (new == witness).all():
            break
        witness = new
    best = pd.DataFrame({"doc": doc, "label": label, "f": decision}).groupby("doc").agg(
        label=("label", "first"), f=("f", "max"))
    best["f"] = best["f"].clip(lower=w[-1])
    f, y, weight = best["f"].to_numpy(), best["label"].to_numpy().astype(float), []
    per_class = {c: total[c] / sizes[c] for c in (0, 1)}
    weight = np.where(y == 1, per_class[1], per_class[0])
    for c in (0, 1):  # documents without similar sentences
        rest = sizes[c] - int((y == c).sum())
        f, y, weight = np.append(f, w[-1]), np.append(y, c), np.append(weight, rest * per_class[c])
    slope, shift = logistic(f, y, weight)
    return Model(landmarks, whitening @ w[:-1], float(w[-1]), max(slope, 0.0), shift)


def _firsts(doc: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Marks the row with the largest value of each document, the first of equals."""
    order = np.lexsort((np.arange(len(doc)), -value, doc))
    first = np.ones(len(doc), dtype=bool)
    first[1:] = doc[order][1:] != doc[order][:-1]
    out = np.zeros(len(doc), dtype=bool)
    out[order[first]] = True
    return out


def score(model: Model, text: Column) -> Column:
    """The probability, 0 to 1, that a text is toxic, by its most toxic sentence, however long it is.

    Null and empty texts have no toxic sentence. Equal texts score the same.
    """
    packed = pickle.dumps(model)
    held: list = []

    def scored(texts: pa.Array) -> pa.Array:
        if not held:
            release()
            own = pickle.loads(packed)
            held.extend([own, Similarities(Landmarks(list(own.landmarks), FLOOR))
                         if own.landmarks else None])
        give_back()
        own, similar = held
        best = np.full(len(texts), own.bias)
        if similar is not None:
            for i, vector in similar.of(_streamed(texts)):
                best[i] = max(best[i], float(vector @ own.weights) + own.bias)
        return pa.array(own.probability(best))

    return arrow_udf(scored, "double")(text.cast("string"))


def _streamed(texts: pa.Array) -> Iterator[str | None]:
    for text in texts:
        yield text.as_py()
