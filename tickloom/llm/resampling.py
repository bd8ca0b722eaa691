"""Documents drawn so that their features resemble those of a target corpus.

Features are runs of one to ``longest`` words, hashed into buckets by CRC-32. A bucket's gain is the log ratio
of its share in the target to its share in all documents; a document's weight is the mean gain of its
features. Weights with Gumbel noise are ranked by a radix sort; the highest are a draw without replacement.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.functions import arrow_udf

from tickloom.llm.decontaminate import WORD_BYTES
from tickloom.llm.radix import radix_ranks
from tickloom.llm.spans import LOWER, runs, text_pieces
from tickloom.session import written_once

BUCKETS = 10_000
#: Longer words are hashed one by one.
SHORT = 64


def _byte_steps() -> np.ndarray:
    steps = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        steps = np.where(steps & 1, (steps >> 1) ^ np.uint32(0xEDB88320), steps >> 1)
    return steps


STEPS = _byte_steps()


def _zero_shifts() -> np.ndarray:
    """For each number of bytes up to SHORT, what every byte of a checksum becomes when that many follow."""
    shifts = np.empty((SHORT + 1, 4, 256), dtype=np.uint32)
    shifts[0] = np.arange(256, dtype=np.uint32) << (8 * np.arange(4, dtype=np.uint32))[:, None]
    for n in range(SHORT):
        shifts[n + 1] = STEPS[shifts[n] & 0xFF] ^ (shifts[n] >> 8)
    return shifts


SHIFTS = _zero_shifts()


def checksums(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """CRC-32 of each span of bytes, all spans a byte further at a time."""
    sizes = ends - starts
    order = np.argsort(np.uint8(SHORT + 1) - np.minimum(sizes, SHORT + 1).astype(np.uint8), kind="stable")
    at, falling = starts[order], sizes[order]
    state = np.full(len(starts), 0xFFFFFFFF, dtype=np.uint32)
    reach = np.bincount(np.minimum(sizes, SHORT), minlength=SHORT + 1)
    longer = len(starts) - np.cumsum(reach)  # spans with more than so many bytes
    for k in range(SHORT):
        n = int(longer[k])
        if not n:
            break
        state[:n] = STEPS[(state[:n] ^ data[at[:n] + k]) & 0xFF] ^ (state[:n] >> 8)
    out = np.empty_like(state)
    out[order] = ~state
    for i in order[:int((falling > SHORT).sum())].tolist():
        out[i] = zlib.crc32(data[starts[i]:ends[i]])
    return out


def joined_checksums(one: np.ndarray, two: np.ndarray, size: np.ndarray) -> np.ndarray:
    """CRC-32 of two spans in a row from those of each and the size of the second."""
    small = np.minimum(size, SHORT)
    out = two.copy()
    for k in range(4):
        out ^= SHIFTS[small, k, (one >> np.uint32(8 * k)) & 0xFF]
    for i in np.flatnonzero(size > SHORT).tolist():
        rest, state = int(size[i]), int(one[i])
        while rest:
            step = min(rest, SHORT)
            state = int(np.bitwise_xor.reduce(
                SHIFTS[step, np.arange(4), state >> np.arange(0, 32, 8) & 0xFF]))
            rest -= step
        out[i] = state ^ int(two[i])
    return out


def features(column: pa.Array, longest: int = 2) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Yields (buckets' hashes, first words, words) for pieces of a column.

    Hashes are those of all runs of words of the piece; the second array has the number of the text of each, the
    third the number of words of each text.
    """
    for _, data, bounds in text_pieces(column):
        data = LOWER[data]
        starts, ends = runs(data, bounds, WORD_BYTES)
        rows = np.searchsorted(bounds, starts, "right") - 1
        blank = np.uint32(0x20)
        last = checksums(data, starts, ends)
        sizes = ends - starts
        found, texts, run = [last], [rows], last
        for length in range(2, longest + 1):
            if len(starts) < length:
                break
            # A run of words, a blank, and the word after it.
            state = ~run[:-1]
            spaced = ~(STEPS[(state ^ blank) & 0xFF] ^ (state >> 8))
            run = joined_checksums(spaced, last[length - 1:], sizes[length - 1:])
            same = rows[length - 1:] == rows[:len(rows) - length + 1]
            found.append(run[same])
            texts.append(rows[:len(same)][same])
        yield (np.concatenate(found), np.concatenate(texts),
               np.bincount(rows, minlength=len(bounds) - 1))


def bucket_counts(docs: DataFrame, text_col: str, buckets: int, longest: int) -> DataFrame:
    """How many features of all texts lie in each bucket, as ``bucket, n``; each task sends one row a bucket."""
    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            for hashes, _, _ in features(batch.column(0), longest):
                sums += np.bincount(hashes % np.uint32(buckets), minlength=buckets)
        held = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(sums[held])], ["bucket", "n"])

    texts = docs.select(F.col(text_col).cast("string").alias("text"))
    return texts.mapInArrow(counted, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(docs: DataFrame, target: DataFrame, buckets: int) -> np.ndarray:
    """The gain of each bucket in thousandths, from the counts of both; ``buckets`` rows at most are read."""
    held = [np.zeros(buckets, dtype=np.int64) for _ in range(2)]
    for sums, counts in zip(held, (docs, target)):
        for row in counts.collect():
            sums[row["bucket"]] = row["n"]
    all_docs, all_target = (int(sums.sum()) for sums in held)
    return np.array([
        math.floor(1000 * math.log(
            float((t + 1) * (all_docs + buckets)) / float((s + 1) * (all_target + buckets))))
        for s, t in zip(held[0].tolist(), held[1].tolist())], dtype=np.int64)


def scored(text: Column, gain: np.ndarray, longest: int) -> Column:
    """A struct of ``n_words``, ``n_features`` and the weight of each text."""
    kind = pa.struct([("n_words", pa.int64()), ("n_features", pa.int64()), ("weight", pa.int64())])

    def weights(texts: pa.Array) -> pa.Array:
        parts = []
        for hashes, rows, words in features(texts, longest):
            values = gain[hashes % np.uint32(len(gain))]
            order = np.argsort(rows, kind="stable")
            counts = np.bincount(rows, minlength=len(words))
            sums = np.concatenate([[0], np.cumsum(values[order])])
            ends = np.cumsum(counts)
            total = sums[ends] - sums[ends - counts]
            parts.append(pa.StructArray.from_arrays(
                [pa.array(words.astype(np.int64)), pa.array(counts.astype(np.int64)),
                 pa.array(total // np.maximum(counts, 1))], fields=list(kind)))
        return pa.concat_arrays(parts) if parts else pa.array([], kind)

    return arrow_udf(weights, "n_words bigint, n_features bigint, weight bigint")(text.cast("string"))


def noise(name: Column, seed: int) -> Column:
    """Gumbel noise in thousandths, drawn by a document's id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), name.cast("string")).cast("binary"), 256)
    drawn = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((drawn + 0.5) / F.lit(float(1 << 32)))))


def resample(
    docs: DataFrame, target: DataFrame, percent: int = 25, min_words: int = 20, seed: int = 7,
    buckets: int = BUCKETS, longest: int = 2, id_col: str = "doc_id", text_col: str = "text",
    target_text_col: str = "text",
) -> DataFrame:
    """One row for each document: ``doc_id, n_words, n_features, weight, score, rank``.

    ``percent`` of the documents with at least ``min_words`` words are drawn, those with the highest scores; they
    are ranked from 1, ties by smaller id. Other ranks are null. Null and empty texts have no words and the
    weight 0. Documents without an id add to the counts, but have no score and are not drawn. Each repeated
    row is a document of its own; rows equal in id and score follow each other in any order. Texts of any length are
    read whole, in pieces. No documents give no rows, no target texts leave its counts at 0. Other columns,
    whatever their names, do not matter.
    """
    given = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    gain = gains(bucket_counts(given, "text", buckets, longest),
                 bucket_counts(target, target_text_col, buckets, longest), buckets)
    told = written_once(
        given.select("doc_id", scored(F.col("text"), gain, longest).alias("s"))
        .select("doc_id", "s.*")
        .withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)))
    may = F.col("doc_id").isNotNull() & (F.col("n_words") >= min_words)
    drawn = percent * told.where(may).count() // 100
    ranked = radix_ranks(told.where(may), [("score", True), ("doc_id", False)], "rank")
    rank = F.when(F.col("rank") < drawn, F.col("rank") + 1)
    return ranked.withColumn("rank", rank).unionByName(
        told.where(~may).withColumn("rank", F.lit(None).cast("bigint")))
