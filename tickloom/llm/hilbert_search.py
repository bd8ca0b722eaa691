"""Nearest neighbours by cosine along several shifted Hilbert curves.

Each curve orders all vectors by the Hilbert key of a projection of its own, shifted by an offset of its own. A
query's candidates are the vectors within a window of places around it on any curve, and are ranked by
their cosine in double precision. The window is measured, not guessed: the true neighbours of a bounded
sample of queries are found by comparing them with all vectors, and the window is the smallest that holds as
many of them as wanted.

Equal vectors are one node of the curves, so that neither a window nor a task fills up with copies; each
node keeps as many of its smallest ids as an answer can name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, Window
from pyspark.sql.functions import pandas_udf

from tickloom.llm.tables import OWN, row_number_within
from tickloom.session import written_once

CURVES, DIMENSIONS, BITS = 12, 8, 6
#: Vectors that the grids are laid over, and queries that the window is measured with.
GRID_SAMPLE, QUERY_SAMPLE = 10_000, 200
#: Part of the true neighbours of the sample that the window must hold.
RECALL = 0.97
#: Places of a block of a curve; a task holds some blocks' vectors at a time.
BLOCK = 4096
SEED = 5


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Places on the Hilbert curve of cells with ``bits``-bit coordinates (Skilling's transform)."""
    x = [c.astype(np.int64) for c in cells.T]
    top = 1 << (bits - 1)
    step = top
    while step > 1:
        below = step - 1
        for i in range(len(x)):
            inside = (x[i] & step) != 0
            swap = np.where(inside, 0, (x[0] ^ x[i]) & below)
            x[0] = np.where(inside, x[0] ^ below, x[0] ^ swap)
            if i:
                x[i] = x[i] ^ swap
        step >>= 1
    for i in range(1, len(x)):
        x[i] = x[i] ^ x[i - 1]
    turn = np.zeros_like(x[0])
    step = top
    while step > 1:
        turn = np.where((x[-1] & step) != 0, turn ^ (step - 1), turn)
        step >>= 1
    key = np.zeros_like(x[0])
    for bit in reversed(range(bits)):
        for c in x:
            key = key << 1 | ((c ^ turn) >> bit & 1)
    return key


def units(vectors: np.ndarray) -> np.ndarray:
    """Vectors of length one; scaled first, so that no square overflows."""
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


def cosines(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """Row by row, summed in the same order for equal rows."""
    a, b = (x / np.abs(x).max(axis=1, keepdims=True) for x in (one, two))
    return (a * b).sum(axis=1) / np.sqrt((a * a).sum(axis=1) * (b * b).sum(axis=1))


def _stacked(column) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.float64)


class Curves:
    """Projections, shifts and grid of each curve."""

    def __init__(self, sample: np.ndarray, curves: int, dimensions: int, bits: int) -> None:
        random = np.random.default_rng(SEED)
        size = sample.shape[1]
        dimensions = min(dimensions, size)
        self.bits = bits
        self.projections = [
            np.linalg.qr(random.standard_normal((size, dimensions)))[0] for _ in range(curves)]
        self.lows, self.widths = [], []
        for projection in self.projections:
            seen = sample @ projection
            low, high = seen.min(axis=0), seen.max(axis=0)
            width = np.maximum(high - low, 1e-9) * 1.25
            self.lows.append(low - random.random(dimensions) * 0.25 / 1.25 * width)
            self.widths.append(width)

    def keys(self, unit: np.ndarray) -> np.ndarray:
        """A row of keys, one for each curve, for each vector."""
        top = (1 << self.bits) - 1
        out = np.empty((len(unit), len(self.projections)), dtype=np.int64)
        for c, (projection, low, width) in enumerate(zip(
                self.projections, self.lows, self.widths)):
            cells = np.floor((unit @ projection - low) / width * (top + 1))
            out[:, c] = hilbert_keys(np.clip(cells, 0, top).astype(np.int64), self.bits)
        return out


def usable(vector: Column) -> Column:
    """Whether a vector has a direction: not null, all components finite, not all zero."""
    return F.coalesce(
        F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        & F.exists(vector, lambda x: x != 0), F.lit(False))


def _directions() -> dict[str, Column]:
    """Two hashes of a vector divided by its largest component, which is all that a cosine sees of it."""
    largest = F.array_max(F.transform("v", lambda x: F.abs(x.cast("double"))))
    divided = F.transform("v", lambda x: x.cast("double") / largest + F.lit(0.0))  # no negative zeros
    return {"k1": F.xxhash64(divided), "k2": F.xxhash64(F.lit(1), divided)}


def _nodes(rows: DataFrame, kept: int) -> DataFrame:
    """Distinct directions with the ``kept`` smallest ids that have them, as ``node, v, members``.

    Nodes are numbered by their smallest ids, so that of nodes with equal scores the smaller number comes first.
    """
    first = Window.partitionBy("k1", "k2").orderBy(F.col("id").asc_nulls_last(), "row")
    # Spark drops rows beyond the limit before they move.
    few = rows.withColumns(_directions()).withColumn(
        "n", F.row_number().over(first)).where(F.col("n") <= kept)
    grouped = few.groupBy("k1", "k2").agg(
        F.min_by("v", "n").alias("v"),
        F.array_sort(F.collect_list(F.struct("n", "id", "row"))).alias("members"))
    smallest = F.col("members")[0]
    return written_once(row_number_within(
        grouped.withColumn("all", F.lit(0)), "all",
        [smallest["id"].isNull(), smallest["id"], smallest["row"]], "node").drop("all"))


def _best(score: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` largest scores, and of all that rounding might put among them."""
    if len(score) <= k:
        return np.arange(len(score))
    return np.flatnonzero(score >= np.partition(score, len(score) - k)[len(score) - k] - 1e-9)


def _true_pairs(nodes: DataFrame, sample: DataFrame, k: int) -> DataFrame:
    """The nearest ``k`` other nodes of each sampled node, by comparing it with all."""
    rows = sample.select("node", "v").toPandas()  # at most QUERY_SAMPLE vectors
    names, queries = rows["node"].to_numpy(), units(_stacked(rows["v"]))

    def nearest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if batch.empty:
                continue
            own = batch["node"].to_numpy()
            score = queries @ units(_stacked(batch["v"])).T
            score[names[:, None] == own[None, :]] = -np.inf
            at = [_best(s, k) for s in score]
            yield pd.DataFrame({
                "query": np.repeat(names, [len(a) for a in at]),
                "node": own[np.concatenate(at)],
                "score": np.concatenate([s[a] for s, a in zip(score, at)])})

    found = nodes.select("node", "v").mapInPandas(
        nearest, "query bigint, node bigint, score double").where("score >= -2")
    place = Window.partitionBy("query").orderBy(F.desc("score"), "node")
    return found.withColumn("n", F.row_number().over(place)).where(F.col("n") <= k)


def measured_window(
    nodes: DataFrame, places: DataFrame, asked: DataFrame, k: int, recall: float, sample: int
) -> int:
    """The smallest window that holds the wanted part of the sample's true neighbours."""
    chosen = written_once(asked.orderBy(F.xxhash64("node"), "node").limit(sample))
    pairs = _true_pairs(nodes, chosen, k)
    one = places.select(F.col("node").alias("query"), "curve", F.col("place").alias("at"))
    apart = pairs.join(F.broadcast(chosen.select(F.col("node").alias("query"))), "query").join(
        one, "query").join(places, ["node", "curve"])
    need = apart.groupBy("query", "node").agg(
        F.min(F.abs(F.col("at") - F.col("place"))).alias("need")).select("need").toPandas()["need"]
    if need.empty:
        return 1
    ordered = np.sort(need.to_numpy())
    return int(ordered[min(len(ordered) - 1, int(np.ceil(recall * len(ordered))) - 1)])


def _scored(k: int, window: int):
    """Ranks the vectors of a block near each query of a group."""
    def scored(asked: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        out: dict[str, list] = {"query": [], "node": [], "score": []}
        if len(asked) and len(held):
            vectors, places = _stacked(held["v"]), held["place"].to_numpy()
            names, unit = held["node"].to_numpy(), units(vectors)
            originals = _stacked(asked["q"])
            order = np.argsort(places, kind="stable")
            vectors, places, names, unit = vectors[order], places[order], names[order], unit[order]
            own = units(originals)
            for i, (name, place) in enumerate(zip(asked["asker"], asked["at"])):
                low = np.searchsorted(places, place - window)
                high = np.searchsorted(places, place + window, "right")
                near = low + _best(unit[low:high] @ own[i], k)
                exact = cosines(np.repeat(originals[i:i + 1], len(near), axis=0), vectors[near])
                best = np.lexsort((names[near], -exact))[:k]
                out["query"] += [name] * len(best)
                out["node"] += names[near][best].tolist()
                out["score"] += exact[best].tolist()
        return pd.DataFrame(out).astype({"query": "int64", "node": "int64", "score": "float64"})

    return scored


def nearest(
    vectors: DataFrame, is_query: Column, k: int, id_col: str = "vec_id",
    vector_col: str = "embedding", recall: float = RECALL, curves: int = CURVES,
    dimensions: int = DIMENSIONS, bits: int = BITS, block: int = BLOCK,
) -> DataFrame:
    """The ``k`` nearest found of each query row: ``query_id, rank, vec_id, score``.

    Candidates are all rows but the query's own; ranks count from 1, nearest first, ties to the smaller
    id and null ids last. Vectors that are null or zero, or have null or non-finite components, take no
    part, nor do those of another size than most. With no more candidates than ``k``, all are found.
    Repeated rows are queries and candidates of their own; no rows give no rows. Other columns are only
    read by ``is_query``.
    """
    rows = written_once(vectors.select(
        F.col(id_col).alias("id"), F.col(vector_col).alias("v"),
        F.coalesce(is_query, F.lit(False)).alias("asks"),
        F.monotonically_increasing_id().alias("row")).where(usable(F.col("v"))))
    size = rows.groupBy(F.size("v").alias("s")).agg(F.count(F.lit(1)).alias("n")).orderBy(
        F.desc("n"), "s").limit(1).collect()
    rows = rows.where(F.size("v") == (size[0]["s"] if size else 0))
    # A node of its own copies answers for k + 1 rows, one of which may be the query.
    nodes = _nodes(rows.select("id", "v", "row"), k + 1)
    count = nodes.count()
    own = rows.where("asks").withColumns(_directions())
    asks = written_once(own.select("id", "row", "k1", "k2").join(
        nodes.select("k1", "k2", "node"), ["k1", "k2"]).select("id", "row", "node"))
    asked = nodes.join(asks.select("node").distinct(), "node").select("node", "v")
    if count:
        found = _found(nodes, written_once(asked), count, k, recall, curves, dimensions, bits, block)
    else:
        found = asked.select(F.col("node").alias("query"), "node", F.lit(0.0).alias("score"))
    answers = asks.withColumnRenamed("node", "query").join(found, "query").join(
        nodes.select("node", "members"), "node").select(
        F.col("id").alias("query_id"), F.col("row").alias(f"{OWN}row"), "score",
        F.explode("members").alias("m")).where(F.col("m.row") != F.col(f"{OWN}row"))
    place = Window.partitionBy(f"{OWN}row").orderBy(
        F.desc("score"), F.col("m.id").asc_nulls_last(), "m.row")
    return answers.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k).select(
        F.col("query_id").cast("bigint").alias("query_id"), "rank",
        F.col("m.id").cast("bigint").alias("vec_id"), "score")


def _found(
    nodes: DataFrame, asked: DataFrame, count: int, k: int, recall: float, curves: int,
    dimensions: int, bits: int, block: int,
) -> DataFrame:
    """Each asked node with itself and its nearest ``k`` others: ``query, node, score``."""
    sample = nodes.select("v").orderBy(F.xxhash64("node")).limit(GRID_SAMPLE).toPandas()
    lines = Curves(units(_stacked(sample["v"])), curves, dimensions, bits)

    @pandas_udf("array<bigint>")
    def keys(v: pd.Series) -> pd.Series:
        return pd.Series(list(lines.keys(units(_stacked(v))))) if len(v) else pd.Series([], dtype=object)

    keyed = nodes.select("node", F.posexplode(keys("v")).alias("curve", "key"))
    places = written_once(row_number_within(
        keyed, "curve", [F.col("key"), F.col("node")], "place").drop("key"))
    window = max(measured_window(nodes, places, asked, k, recall, QUERY_SAMPLE), k)
    vectors = nodes.select("node", "v")
    # Queries go in chunks to the blocks of their window, so both sides of a group have a bound.
    chunk = 16 * block
    held = places.join(vectors, "node").select(
        "curve", "place", "node", "v", F.floor(F.col("place") / block).cast("bigint").alias("block"))
    first = F.greatest(F.col("block") * block - window, F.lit(0))
    last = F.least((F.col("block") + 1) * block - 1 + window, F.lit(count - 1))
    held = held.withColumn("chunk", F.explode(F.sequence(
        F.floor(first / chunk).cast("bigint"), F.floor(last / chunk).cast("bigint"))))
    sought = places.join(asked, "node").select(
        F.col("curve").alias("on"), F.col("place").alias("at"), F.col("node").alias("asker"),
        F.col("v").alias("q"), F.floor(F.col("place") / chunk).cast("bigint").alias("part"),
        F.explode(F.sequence(
            F.floor(F.greatest(F.col("place") - window, F.lit(0)) / block).cast("bigint"),
            F.floor(F.least(F.col("place") + window, F.lit(count - 1)) / block).cast("bigint"),
        )).alias("from_block"))
    near = sought.groupBy("on", "from_block", "part").cogroup(
        held.groupBy("curve", "block", "chunk")).applyInPandas(
        _scored(k + 1, window), "query bigint, node bigint, score double")
    place = Window.partitionBy("query").orderBy(F.desc("score"), "node")
    # A node met on several curves scores the same each time.
    once = near.groupBy("query", "node").agg(F.max("score").alias("score"))
    return written_once(once.withColumn("n", F.row_number().over(place)).where(
        F.col("n") <= k + 1).drop("n"))
