"""The best documents for each query text, found through bit-sliced Bloom signatures.

A document's signature has bits for each of its terms, and further bits for terms that occur several times.
Documents with signatures of one width stand in blocks, stored as slices: for every bit of the signature, a
bitmap over the documents of the block. The slices of a term, combined, mark all documents that hold it (and
a few that do not), so weighted sums of slices bound every score from above. Exact scores of the documents with the
highest bounds give a score that a query's last result reaches at least; every document whose bound reaches
it, too, is scored exactly.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, functions as F, Window
from pyspark.sql.functions import arrow_udf

from tickloom.llm.decontaminate import LOWERED, Piece, pieces
from tickloom.llm.spans import LOWER, hashes, mix
from tickloom.llm.tables import may_hold
from tickloom.llm.tokens import OTHER_VALUES
from tickloom.session import written_once

#: Occurrences from which a term has a further key in a signature.
LEVELS = (1, 2, 3, 5, 9)
#: Bits set for a key, and least bits of a signature for each key.
PROBES, BITS_PER_KEY = 4, 8
#: Least and largest width; a wider one would only bound the longest documents more closely.
NARROW, WIDE = 1 << 8, 1 << 22
#: Bits of a block of signatures, and most documents in it.
BLOCK_BITS, BLOCK_DOCS = 1 << 22, 2048
#: Terms of queries that are broadcast at once, about 40 bytes each; more queries take further turns.
QUERY_TERMS = 200_000
#: Terms of one query whose slices are summed at once.
TERMS_AT_ONCE = 256

OTHER_LOWERED = OTHER_VALUES[LOWER]
BLOCKS = "width bigint, ids array<bigint>, sizes array<bigint>, slices binary"


def other_names(piece: Piece, chosen: np.ndarray) -> np.ndarray:
    """A second hash of some words, by ascending number."""
    return hashes(piece.data, piece.starts[chosen], piece.ends[chosen], OTHER_LOWERED)


def term_counts(piece: Piece) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, hash and number of occurrences of each distinct term of each text."""
    rows = np.repeat(np.arange(len(piece.rows) - 1), np.diff(piece.rows))
    order = np.lexsort((piece.words, rows))
    rows, words = rows[order], piece.words[order]
    first = np.flatnonzero(np.concatenate(
        [[True], (rows[1:] != rows[:-1]) | (words[1:] != words[:-1])])) if len(rows) else rows
    return rows[first], words[first], np.diff(np.append(first, len(rows)))


def places(keys: np.ndarray, width: int) -> np.ndarray:
    """The bits of each key in a signature of that width, a power of two."""
    turns = np.arange(1, PROBES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return (mix(keys[..., None] + turns) & np.uint64(width - 1)).astype(np.int64)


def level_keys(words: np.ndarray) -> np.ndarray:
    """The keys of each term, a level in each column."""
    steps = np.arange(len(LEVELS), dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03)
    return mix(words[..., None] ^ steps)


def _block(width: int, held: list[tuple[int, int, np.ndarray]]) -> pa.RecordBatch:
    """One row with the slices of documents of one width, given as id, number of terms and keys."""
    docs = -(-len(held) // 8) * 8
    bits = np.zeros(width * docs, dtype=bool)
    for at, (_, _, keys) in enumerate(held):
        bits[places(keys, width).ravel() * docs + at] = True
    slices = np.packbits(bits).tobytes()
    return pa.RecordBatch.from_arrays([
        pa.array([width], pa.int64()),
        pa.array([[h[0] for h in held]], pa.list_(pa.int64())),
        pa.array([[h[1] for h in held]], pa.list_(pa.int64())),
        pa.array([slices], pa.binary())], ["width", "ids", "sizes", "slices"])


def signature_blocks(docs: DataFrame) -> DataFrame:
    """The index of documents (``doc_id, text``): rows of :data:`BLOCKS`; texts without terms are left out."""
    def built(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for batch in batches:
            names = batch.column(0).to_pylist()
            for piece in pieces(batch.column(1)):
                rows, words, counts = term_counts(piece)
                bounds = np.searchsorted(rows, np.arange(len(piece.rows)))
                sizes = np.diff(piece.rows).tolist()
                for i, size in enumerate(sizes):
                    if not size:
                        continue
                    own = slice(bounds[i], bounds[i + 1])
                    kept = counts[own, None] >= np.array(LEVELS)
                    keys = level_keys(words[own])[kept]
                    width = 1 << max(BITS_PER_KEY * len(keys) - 1, 1).bit_length()
                    width = min(max(width, NARROW), WIDE)
                    waiting = held.setdefault(width, [])
                    waiting.append((names[piece.row + i], size, keys))
                    if len(waiting) >= min(max(BLOCK_BITS // width, 8), BLOCK_DOCS):
                        yield _block(width, held.pop(width))
        for width, waiting in held.items():
            yield _block(width, waiting)

    return docs.mapInArrow(built, BLOCKS)


@dataclass(frozen=True)
class Queries:
    """Some queries: their distinct terms by ascending hash, and each query's terms with their repeats."""

    names: list
    words: np.ndarray
    others: np.ndarray
    terms: list[np.ndarray]
    repeats: list[np.ndarray]

    @classmethod
    def of(cls, rows: list) -> Queries:
        """From rows ``item, word, other, n``."""
        known = sorted({(r["word"] & (1 << 64) - 1, r["other"] & (1 << 64) - 1) for r in rows})
        number = {pair: i for i, pair in enumerate(known)}
        by_item: dict = {}
        for r in rows:
            pair = (r["word"] & (1 << 64) - 1, r["other"] & (1 << 64) - 1)
            by_item.setdefault(r["item"], []).append((number[pair], r["n"]))
        return cls(
            list(by_item), np.array([k[0] for k in known], np.uint64),
            np.array([k[1] for k in known], np.uint64),
            [np.array([t for t, _ in found], np.int64) for found in by_item.values()],
            [np.array([n for _, n in found], np.int64) for found in by_item.values()])

    def found(self, piece: Piece) -> tuple[np.ndarray, np.ndarray]:
        """Words of a piece that are terms of a query, and the numbers of these terms."""
        place = np.minimum(np.searchsorted(self.words, piece.words), len(self.words) - 1)
        hit = np.flatnonzero(self.words[place] == piece.words)
        term, other = place[hit], other_names(piece, hit)
        # Terms that differ but share the first hash follow each other.
        while len(term):
            wrong = np.flatnonzero(self.others[term] != other)
            more = wrong[(term[wrong] + 1 < len(self.words))]
            more = more[self.words[term[more] + 1] == self.words[term[more]]]
            if not len(more):
                break
            term[more] += 1
        right = self.others[term] == other
        return hit[right], term[right]


@dataclass(frozen=True)
class Scoring:
    """Queries with the weights of their terms, and what a score needs to know about the corpus."""

    queries: Queries
    weights: np.ndarray
    documents: int
    words: int

    def shares(self, sizes: np.ndarray) -> np.ndarray:
        """What the lengths of documents do to their scores."""
        return 25 + 75 * sizes * self.documents // self.words

    @staticmethod
    def impact(counts: np.ndarray, share: np.ndarray) -> np.ndarray:
        return 1_000_000_000 * counts // (1000 * counts + 8 * share)

    def bounds(self, width: int, sizes: np.ndarray, slices: np.ndarray) -> Iterator[np.ndarray]:
        """For each query, no less than the score of each document of a block."""
        share = self.shares(sizes)
        # A term found on a level occurs less often than the next level asks for, or on the last as often as fits.
        most = [np.minimum(n - 1, sizes) for n in LEVELS[1:]] + [sizes]
        impacts = [self.impact(n, share) for n in most]
        steps = np.stack([impacts[0], *[b - a for a, b in zip(impacts, impacts[1:])]])
        for terms, repeats in zip(self.queries.terms, self.queries.repeats):
            total = np.zeros((len(LEVELS), len(sizes)))
            for k in range(0, len(terms), TERMS_AT_ONCE):
                part = terms[k:k + TERMS_AT_ONCE]
                weight = (self.weights[part] * repeats[k:k + TERMS_AT_ONCE]).astype(np.float64)
                at = places(level_keys(self.queries.words[part]), width)
                marks = slices[at[..., 0]]
                for probe in range(1, PROBES):
                    marks = marks & slices[at[..., probe]]
                for level in range(len(LEVELS)):
                    held = np.flatnonzero(marks[:, level].any(axis=1))
                    if len(held):
                        bits = np.unpackbits(marks[held, level], axis=1, count=len(sizes))
                        total[level] += weight[held] @ bits
            yield (total.astype(np.int64) * steps).sum(axis=0)

    def scores(self, piece: Piece, wanted: list[list[int]]) -> list[list[int]]:
        """The exact scores of each text of a piece for the queries wanted for it."""
        words, terms = self.queries.found(piece)
        cuts = np.searchsorted(words, piece.rows)
        found = []
        for i, asked in enumerate(wanted):
            counts = np.bincount(terms[cuts[i]:cuts[i + 1]], minlength=len(self.weights))
            size = np.array(piece.rows[i + 1] - piece.rows[i])
            values = self.weights * self.impact(counts, self.shares(size))
            found.append([int(values[self.queries.terms[q]] @ self.queries.repeats[q]) for q in asked])
        return found


def query_terms(items: DataFrame) -> DataFrame:
    """The terms of query texts (``item, text``) as ``item, word, other, n``, by two hashes."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch.column(1)):
                rows = np.repeat(np.arange(len(piece.rows) - 1), np.diff(piece.rows)) + piece.row
                every = other_names(piece, np.arange(len(rows)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(rows)), pa.array(piece.words.view(np.int64)),
                     pa.array(every.view(np.int64))], ["item", "word", "other"])

    kind = dict(items.dtypes)["item"]
    found = items.distinct().mapInArrow(cut, f"item {kind}, word bigint, other bigint")
    return found.groupBy("item", "word", "other").agg(F.count(F.lit(1)).alias("n"))


def frequencies(docs: DataFrame, queries: Broadcast) -> DataFrame:
    """The number of documents that hold each term, as ``term, n``."""
    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(len(queries.value.words), np.int64)
        for batch in batches:
            for piece in pieces(batch.column(1)):
                words, terms = queries.value.found(piece)
                rows = np.searchsorted(piece.rows, words, "right") - 1
                pairs = np.unique(rows * len(sums) + terms)
                sums += np.bincount(pairs % len(sums), minlength=len(sums))
        held = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(sums[held])], ["term", "n"])

    return docs.mapInArrow(counted, "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("n"))


def _bounded(
    index: DataFrame, scoring: Broadcast, chosen: Callable[[int, np.ndarray, list], tuple]
) -> DataFrame:
    """Pairs (``query, doc_id, bound``) that ``chosen`` takes from a query's bounds in a block."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                width, ids = batch.column(0)[i].as_py(), batch.column(1)[i].values
                sizes = np.asarray(batch.column(2)[i].values)
                slices = np.frombuffer(batch.column(3)[i].as_buffer(), np.uint8).reshape(width, -1)
                out: list[list] = [[], [], []]
                for query, bounds in enumerate(scoring.value.bounds(width, sizes, slices)):
                    at = chosen(query, bounds)
                    for column, part in zip(out, (np.full(len(at), query), at, bounds[at])):
                        column.append(part)
                query, at, bound = (pa.array(np.concatenate(c).astype(np.int64)) for c in out)
                yield pa.RecordBatch.from_arrays([query, ids.take(at), bound], ["query", "doc_id", "bound"])

    return index.mapInArrow(run, "query bigint, doc_id bigint, bound bigint")


def _scored(docs: DataFrame, pairs: DataFrame, scoring: Broadcast) -> DataFrame:
    """Exact scores above 0 of pairs (``query, doc_id``), for all documents of that id."""
    kind = pa.list_(pa.struct([("query", pa.int64()), ("score", pa.int64())]))

    def exact(texts: pa.Array, asked: pa.Array) -> pa.Array:
        rows: list[list] = []
        for piece in pieces(texts):
            wanted = asked.slice(piece.row, len(piece.rows) - 1).to_pylist()
            for queries, scores in zip(wanted, scoring.value.scores(piece, wanted)):
                rows.append([{"query": q, "score": s} for q, s in zip(queries, scores) if s > 0])
        return pa.array(rows, kind)

    asked = written_once(pairs.groupBy("doc_id").agg(F.collect_set("query").alias("asked")))
    near = may_hold(asked.select("doc_id"), docs, "doc_id").join(asked, "doc_id")
    found = arrow_udf(exact, "array<struct<query: bigint, score: bigint>>")(F.col("text"), F.col("asked"))
    return near.select("doc_id", F.explode(found).alias("f")).select("f.query", "doc_id", "f.score")


def _best(pairs: DataFrame, value: str, count: int) -> DataFrame:
    """The highest pairs of each query, ranked from 1."""
    order = Window.partitionBy("query").orderBy(F.col(value).desc(), "doc_id")
    return pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= count)


def _turns(terms: DataFrame, most: int) -> tuple[int, list[int]]:
    """A number of turns, and those that have queries, so that the terms of each are few or of one query."""
    turns = max(1, -(-2 * terms.count() // most))
    while True:
        held = terms.groupBy(F.pmod(F.xxhash64("item"), F.lit(turns)).alias("turn")).agg(
            F.count(F.lit(1)).alias("terms"), F.min("item").alias("a"), F.max("item").alias("b"))
        if held.where(f"terms > {most} AND a <> b").isEmpty():
            return turns, sorted(r["turn"] for r in held.select("turn").collect())
        turns *= 2


def search(
    docs: DataFrame, items: DataFrame, count: int = 10, id_col: str = "doc_id", text_col: str = "text",
    item_col: str = "item_id", item_text_col: str = "text", query_terms_at_once: int = QUERY_TERMS,
) -> DataFrame:
    """The ``count`` documents with the highest scores above 0 for each item: ``item_id, rank, doc_id, score``.

    Scores are those of a length-normalised sum of term weights in integers; equal ones are ranked by smaller id.
    Null and empty texts, or texts without terms, count nowhere and are never found. Documents without an id
    count in the statistics but are not ranked. Repeated rows are documents of their own. Items without an id
    or terms have no results; an item's repeated rows count once, and different texts of one item are one query
    of all their terms. Texts of any length are read whole. Without documents or items there are no rows. Other
    columns, whatever their names, do not matter.
    """
    spark = docs.sparkSession
    given = docs.select(F.col(id_col).cast("bigint").alias("doc_id"),
                        F.col(text_col).cast("string").alias("text"))
    asked = items.where(F.col(item_col).isNotNull()).select(
        F.col(item_col).alias("item"), F.col(item_text_col).cast("string").alias("text"))
    terms = written_once(query_terms(asked))
    index = written_once(signature_blocks(given))
    total = index.select(
        F.sum(F.size("ids")).alias("documents"),
        F.sum(F.expr("aggregate(sizes, 0L, (a, b) -> a + b)")).alias("words")).first()
    kind = dict(terms.dtypes)["item"]
    results = spark.createDataFrame([], f"item_id {kind}, rank int, doc_id bigint, score bigint")
    turns, held = _turns(terms, query_terms_at_once) if total["documents"] else (1, [])
    for turn in held:
        queries = Queries.of(
            terms.where(F.pmod(F.xxhash64("item"), F.lit(turns)) == turn).collect())
        shared = spark.sparkContext.broadcast(queries)
        holding = np.zeros(len(queries.words), np.int64)
        for row in frequencies(given, shared).collect():
            holding[row["term"]] = row["n"]
        weights = np.array([math.floor(1000 * math.log((2 * total["documents"] + 2) / (2 * n + 1)))
                            for n in holding.tolist()], np.int64)
        scoring = spark.sparkContext.broadcast(
            Scoring(queries, weights, total["documents"], total["words"]))
        names = spark.createDataFrame(list(enumerate(queries.names)), f"query bigint, item_id {kind}")
        results = results.unionByName(_answers(given, index, scoring, count).join(
            F.broadcast(names), "query").select("item_id", "rank", "doc_id", "score"))
    return results


def _answers(docs: DataFrame, index: DataFrame, scoring: Broadcast, count: int) -> DataFrame:
    """The ranked documents of all queries of a turn as ``query, rank, doc_id, score``."""
    def highest(query: int, bounds: np.ndarray) -> np.ndarray:
        if len(bounds) > count:
            return np.argpartition(-bounds, count)[:count]
        return np.arange(len(bounds))

    named = F.col("doc_id").isNotNull()
    first = _best(_bounded(index, scoring, highest).where(named), "bound", count)
    sure = _best(_scored(docs, first, scoring), "score", count)
    reached = {r["query"]: r["score"] for r in sure.where(F.col("rank") == count).collect()}

    def possible(query: int, bounds: np.ndarray) -> np.ndarray:
        return np.flatnonzero(bounds >= reached.get(query, 1))

    pairs = _bounded(index, scoring, possible).where(named).select("query", "doc_id")
    return _best(_scored(docs, pairs, scoring), "score", count)
