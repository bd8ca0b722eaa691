"""Training batches of similar lengths, with bucket boundaries that waste the least padding.

The lengths of all sequences are counted in one global histogram. Dynamic programming over it chooses
the boundaries; every sequence is padded to its bucket's. Inside a bucket, sequences fill batches up to a
budget of padded tokens.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.functions import arrow_udf

from tickloom.llm.spans import give_back
from tickloom.llm.tables import OWN, row_number_within
from tickloom.llm.tokens import encoder
from tickloom.session import written_once

BUCKETS = 16
BUDGET = 65_536


def token_counts(text: Column, tokenizer: str) -> Column:
    """Number of token ids of a text with an end id; null is empty."""
    def counted(texts: pa.Array) -> pa.Array:
        encode = encoder(tokenizer)
        give_back()
        sizes = [np.diff(bounds) + 1 for _, _, bounds in encode.encode(texts)]
        return pa.array(np.concatenate(sizes) if sizes else np.empty(0, np.int64), pa.int64())

    return arrow_udf(counted, "bigint")(text.cast("string"))


def best_boundaries(tops: list[int], counts: list[int], buckets: int) -> list[int]:
    """Of ascending lengths, the at most ``buckets`` that make the best boundaries: those with the fewest padded tokens.

    ``counts`` are the sequences of each length. The cost of a bucket is its boundary times its sequences, the last
    length is always a boundary, and of equal choices the smaller earlier boundary is made. With k - 1 buckets up
    to i solved, a further one from i to j costs a line in i taken at the j-th length, so a layer of the
    dynamic programme is the lower hull of these lines and takes time in proportion to the lengths.
    """
    size = len(tops)
    if not size:
        return []
    before = [0]
    for n in counts:
        before.append(before[-1] + n)
    cost = [t * n for t, n in zip(tops, before[1:])]
    choices = []
    for _ in range(min(buckets, size) - 1):
        new, chosen = [], []
        # Lines as (slope, value at 0, i); i = -1 is one bucket for all.
        hull: list[tuple[int, int, int]] = [(0, 0, -1)]
        first = 0
        for j, top in enumerate(tops):
            if j:
                line = (-before[j], cost[j - 1], j - 1)
                while len(hull) - first > 1:
                    (m1, b1, _), (m2, b2, _) = hull[-2:]
                    if (line[1] - b1) * (m1 - m2) > (b2 - b1) * (m1 - line[0]):
                        break
                    hull.pop()
                hull.append(line)
            while len(hull) - first > 1:
                (m1, b1, _), (m2, b2, _) = hull[first:first + 2]
                if b2 + m2 * top >= b1 + m1 * top:
                    break
                first += 1
            slope, value, i = hull[first]
            new.append(value + (slope + before[j + 1]) * top)
            chosen.append(i)
        cost = new
        choices.append(chosen)
    ends, j = [], size - 1
    for chosen in reversed(choices):
        ends.append(tops[j])
        j = chosen[j]
        if j < 0:
            break
    else:
        ends.append(tops[j])
    return sorted(ends)


def pack(
    docs: DataFrame, length: str, id_col: str = "doc_id", buckets: int = BUCKETS,
    budget: int = BUDGET,
) -> DataFrame:
    """Buckets and batches of sequences with a column of lengths, at least 1.

    Returns the documents' columns and ``bucket, pad_to, batch, slot``: the bucket's number from 0, the
    length its sequences are padded to, and the batch in the bucket and the place in the batch, both from
    0 without gaps, in id order. A batch holds ``budget // pad_to`` sequences, and at least one. Repeated
    rows are sequences of their own, null ids come first, and no rows give no batches. Input columns with
    the names of the new ones are replaced. The driver holds one count for each distinct length; n of these take
    n * n / 2 tokens at least, so for 10^13 tokens there are fewer than five million.
    """
    new = ("bucket", "pad_to", "batch", "slot")
    top = f"{OWN}top"
    kept = [c for c in docs.columns if c not in new]
    sized = written_once(docs.select(*kept).withColumn(top, F.col(length).cast("bigint")))
    histogram = sorted(
        (r[top], r["n"]) for r in sized.groupBy(top).agg(F.count(F.lit(1)).alias("n")).collect())
    tops = best_boundaries([t for t, _ in histogram], [n for _, n in histogram], buckets)
    bounds = F.array(*[F.lit(t).cast("bigint") for t in tops]) if tops else F.array(
        F.lit(0).cast("bigint"))
    bucket = F.size(F.filter(bounds, lambda b: b < F.col(top)))
    placed = sized.withColumn("bucket", bucket).withColumn("pad_to", F.get(bounds, F.col("bucket")))
    numbered = row_number_within(
        placed.drop(top), "bucket", [F.col(id_col), F.col(length)], f"{OWN}at")
    per_batch = F.greatest(F.floor(F.lit(budget) / F.col("pad_to")), F.lit(1))
    return numbered.withColumns({
        "batch": F.floor(F.col(f"{OWN}at") / per_batch).cast("bigint"),
        "slot": (F.col(f"{OWN}at") % per_batch).cast("bigint")}).select(*kept, *new)


def pack_documents(
    docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", **settings
) -> DataFrame:
    """``doc_id, n_tokens, bucket, pad_to, batch, slot`` of each document.

    Lengths are token ids with the end id, so null and empty texts have one. A text of any length is one sequence,
    alone in its batch if it is longer than the budget. Repeated rows are sequences of their own, rows of one id are
    ordered by length, no rows give no rows, and other columns are not read.
    """
    sized = docs.select(
        F.col(id_col).alias("doc_id"), token_counts(F.col(text_col), tokenizer).alias("n_tokens"))
    return pack(sized, "n_tokens", "doc_id", **settings)
