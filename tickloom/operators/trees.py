"""Regression trees for every instrument at once, grown level by level from histograms.

Each feature of an instrument is cut at its quantiles into at most 256 bins of one byte. An instrument's rows are packed
into blocks of bounded size. A level of a tree needs, for each node, feature and bin, the sums of gradients and
hessians; the split of highest second-order gain follows from them.

An instrument with one block is fitted where its block is. Instruments with more blocks grow in step: one job a
level adds up the sums of all their blocks by (instrument, tree, node, feature, bin) and chooses all splits, however
many instruments there are. Both ways use the same sums and the same rule.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tickloom.operators.joins import join_per_stock
from tickloom.schemas import FEATURE_COLUMNS
from tickloom.session import written_once

BINS = 256
BLOCK_ROWS = 65_536
CHUNK_ROWS = 50_000
#: Error of the quantiles, as a share of an instrument's rows.
QUANTILE_ACCURACY = 20_000
#: Least gain of a split, and the share by which gains differ that count as equal.
LEAST_GAIN, TIE = 1e-6, 1e-10
#: Rounds after which finished trees are added to the stored predictions of the blocks.
KEEP_ROUNDS = 10

BLOCKS = ("stock_id int, block int, cuts array<array<double>>, base array<double>, days binary, bins binary, "
          "target binary, fold binary")
NODES = ("stock_id int, key int, tree int, node int, feature int, bin int, value double, low double, "
         "high double")
TREES = "stock_id int, key int, tree int, feature array<int>, threshold array<double>, value array<double>"


@dataclass(frozen=True)
class Boosting:
    """Trees that each fit what those before leave, by squared error.

    Key -1 is fitted on all rows, key f on those outside fold f.
    """

    rounds: int
    depth: int
    step: float
    keys: tuple[int, ...] = (-1,)
    penalty: float = 1.0
    least_weight: float = 1.0

    def gradients(self, block: "Block", key: int, predicted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        weight = (block.fold != key).astype(float)
        return (predicted - block.target) * weight, weight

    def shrunk(self, value):
        return value * self.step


@dataclass(frozen=True)
class Forest:
    """Independent trees on bootstrapped rows, whose mean is the prediction; a key is a tree."""

    trees: int
    depth: int
    seed: int
    rounds: int = 1
    penalty: float = 0.0
    least_weight: float = 1.0

    @property
    def keys(self) -> tuple[int, ...]:
        return tuple(range(self.trees))

    def gradients(self, block: "Block", key: int, predicted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        weight = poisson_weights(self.seed, block.stock_id, key, block.days)
        return (predicted - block.target) * weight, weight

    def shrunk(self, value):
        return value / self.trees


Growth = Boosting | Forest


def spread_bits(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers in which every bit depends on all (the splitmix64 finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _poisson_steps() -> np.ndarray:
    terms = np.exp(-1.0) / np.cumprod([1.0, *range(1, 20)])
    return np.cumsum(terms)


POISSON_STEPS = _poisson_steps()


def poisson_weights(seed: int, stock_id: int, tree: int, days: np.ndarray) -> np.ndarray:
    """How often a bootstrap draws each day, drawn by a hash: Poisson numbers of mean one."""
    state = np.full(len(days), seed, np.uint64)
    for part in (np.full(1, stock_id), np.full(1, tree), days):
        state = spread_bits(state + np.uint64(0x9E3779B97F4A7C15) * part.astype(np.int64).view(np.uint64))
    drawn = (state >> np.uint64(11)) / float(1 << 53)
    return np.searchsorted(POISSON_STEPS, drawn, "right").astype(float)


@dataclass
class Block:
    """Some rows of an instrument."""

    stock_id: int
    block: int
    cuts: list
    base: np.ndarray
    days: np.ndarray
    bins: np.ndarray
    target: np.ndarray
    fold: np.ndarray

    @classmethod
    def of(cls, row: dict) -> "Block":
        return cls(
            row["stock_id"], row["block"], row["cuts"], np.array(row["base"], float),
            np.frombuffer(row["days"], np.int32), np.frombuffer(row["bins"], np.uint8).reshape(
                -1, len(row["cuts"])),
            np.frombuffer(row["target"], float), np.frombuffer(row["fold"], np.int8))


def _one_by_one(batches) -> Iterator[dict]:
    """The rows of Arrow batches, of which only one is unpacked at a time."""
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1).to_pylist()[0]


class Tree:
    """Nodes numbered as in a heap; a node without a feature is a leaf."""

    def __init__(self, depth: int) -> None:
        size = 2 ** (depth + 1) - 1
        self.feature = np.full(size, -1)
        self.bin = np.zeros(size, int)
        self.value = np.zeros(size)

    def add(self, node, feature, bin_, value, low, high) -> None:
        """Evaluated nodes with their values and those of the children that a split makes."""
        self.value[node] = value
        self.feature[node], self.bin[node] = feature, bin_
        split = feature >= 0
        self.value[2 * node[split] + 1], self.value[2 * node[split] + 2] = low[split], high[split]

    def places(self, bins: np.ndarray, levels: int) -> np.ndarray:
        """The node of each row after so many levels; rows stay where they meet a leaf."""
        node = np.zeros(len(bins), int)
        rows = np.arange(len(bins))
        for _ in range(levels):
            feature = self.feature[node]
            right = bins[rows, np.maximum(feature, 0)] > self.bin[node]
            node = np.where(feature >= 0, 2 * node + 1 + right, node)
        return node


def histogram(bins: np.ndarray, node: np.ndarray, g: np.ndarray, h: np.ndarray, nodes: int) -> np.ndarray:
    """Sums of gradients and hessians by (node, feature, bin); rows of negative node and weight 0 are left out."""
    kept = np.flatnonzero((node >= 0) & (h > 0))
    features = bins.shape[1]
    cell = (node[kept, None] * features + np.arange(features)) * BINS + bins[kept]
    size = nodes * features * BINS
    sums = [np.bincount(cell.ravel(), np.repeat(v[kept], features), size) for v in (g, h)]
    return np.stack(sums).reshape(2, nodes, features, BINS)


def best_splits(sums: np.ndarray, growth: Growth) -> dict[str, np.ndarray]:
    """The split of highest gain of each node, the first feature and bin if several have it."""
    (g, h), lam = sums, growth.penalty
    low_g, low_h = g.cumsum(axis=2), h.cumsum(axis=2)
    all_g, all_h = low_g[:, :1, -1:], low_h[:, :1, -1:]
    high_g, high_h = all_g - low_g, all_h - low_h

    def part(a, b):
        return a * a / np.maximum(b + lam, 1e-300)

    gain = part(low_g, low_h) + part(high_g, high_h) - part(all_g, all_h)
    fits = (low_h >= growth.least_weight) & (high_h >= growth.least_weight)
    gain = np.where(fits, gain, -np.inf).reshape(len(g), -1)
    best = gain.max(axis=1)
    at = (gain >= (best - np.abs(best) * TIE)[:, None]).argmax(axis=1)
    rows = np.arange(len(g))
    splits = gain[rows, at] > LEAST_GAIN

    def leaf(a, b):
        return growth.shrunk(-a / np.maximum(b + lam, 1e-300))

    def chosen(values):
        return values.reshape(len(g), -1)[rows, at]

    return {
        "held": all_h[:, 0, 0] > 0, "feature": np.where(splits, at // BINS, -1), "bin": at % BINS,
        "value": leaf(all_g, all_h)[:, 0, 0], "low": leaf(chosen(low_g), chosen(low_h)),
        "high": leaf(chosen(high_g), chosen(high_h))}


def _level_of(tree: Tree, bins: np.ndarray, level: int) -> np.ndarray:
    """The number of each row's node within a level, negative for rows that stay above."""
    return tree.places(bins, level) - (2 ** level - 1)


def fit_block(block: Block, growth: Growth) -> Iterator[tuple[int, int, Tree]]:
    """All trees of an instrument that is one block, as (key, number, tree)."""
    for at, key in enumerate(growth.keys):
        predicted = np.full(len(block.target), block.base[min(at, len(block.base) - 1)])
        for number in range(growth.rounds):
            tree = Tree(growth.depth)
            g, h = growth.gradients(block, key, predicted)
            for level in range(growth.depth):
                node = _level_of(tree, block.bins, level)
                found = best_splits(histogram(block.bins, node, g, h, 2 ** level), growth)
                there = np.flatnonzero(found["held"])
                tree.add(there + 2 ** level - 1, *[
                    found[c][there] for c in ("feature", "bin", "value", "low", "high")])
                if (found["feature"][there] < 0).all():
                    break
            predicted = predicted + tree.value[tree.places(block.bins, growth.depth)]
            yield key, number, tree


def _tree_rows(found: list[tuple[int, int, int, Tree]], cuts: dict[int, list]) -> pa.RecordBatch:
    columns: list[list] = [[], [], [], [], [], []]
    for stock_id, key, number, tree in found:
        threshold = [cuts[stock_id][f][b] if f >= 0 and b < len(cuts[stock_id][f]) else 0.0
                     for f, b in zip(tree.feature.tolist(), tree.bin.tolist())]
        for column, value in zip(columns, (
                stock_id, key, number, tree.feature.tolist(), threshold, tree.value.tolist())):
            column.append(value)
    kinds = [pa.int32()] * 3 + [pa.list_(pa.int32()), pa.list_(pa.float64()), pa.list_(pa.float64())]
    return pa.RecordBatch.from_arrays(
        [pa.array(c, k) for c, k in zip(columns, kinds)],
        ["stock_id", "key", "tree", "feature", "threshold", "value"])


def quantile_cuts(train: DataFrame, features: Sequence[str]) -> DataFrame:
    """Per instrument the distinct quantiles of each feature; a value's bin is the number of cuts below it."""
    shares = F.array(*[F.lit(k / BINS) for k in range(1, BINS)])
    return train.groupBy("stock_id").agg(F.array(*[
        F.array_distinct(F.percentile_approx(F.col(c).cast("double"), shares, QUANTILE_ACCURACY))
        for c in features]).alias("cuts"), F.count(F.lit(1)).alias("_rows"))


def packed_blocks(
    train: DataFrame, bases: DataFrame, features: Sequence[str], target: str, block_rows: int
) -> DataFrame:
    """Blocks of at most about ``block_rows`` rows of an instrument, their days dealt out by hash."""
    known = quantile_cuts(train, features).join(bases, "stock_id").withColumn(
        "_blocks", F.ceil(F.col("_rows") / block_rows).cast("int")).drop("_rows")
    facts = written_once(known)
    rows = join_per_stock(
        train.select("stock_id", "trade_date", F.col(target).cast("double").alias("target"),
                     F.coalesce("fold", F.lit(-2)).cast("int").alias("fold"),
                     *[F.col(c).cast("double").alias(f"_x{i}") for i, c in enumerate(features)]),
        facts.select("stock_id", "_blocks"))
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("trade_date"), F.col("_blocks")).cast("int"))
    copies = facts.select("stock_id", "cuts", "base", F.explode(
        F.sequence(F.lit(0), F.col("_blocks") - 1)).alias("block"))

    def packed(key: tuple, part: pa.Table, fact: pa.Table) -> pa.Table:
        part = part.sort_by("trade_date")
        if not part.num_rows or not fact.num_rows:
            return pa.table({f.split()[0]: pa.array([], k) for f, k in zip(BLOCKS.split(", "), kinds)})
        cuts = fact.column("cuts")[0].as_py()
        bins = [np.searchsorted(cut, part.column(f"_x{i}").to_numpy()) for i, cut in enumerate(cuts)]
        values = [
            key[0].as_py(), key[1].as_py(), cuts, fact.column("base")[0].as_py(),
            part.column("trade_date").cast(pa.int32()).to_numpy().tobytes(),
            np.stack(bins, axis=1).astype(np.uint8).tobytes(), part.column("target").to_numpy().tobytes(),
            part.column("fold").to_numpy().astype(np.int8).tobytes()]
        return pa.table({f.split()[0]: pa.array([v], k) for f, v, k in zip(BLOCKS.split(", "), values, kinds)})

    kinds = [pa.int32(), pa.int32(), pa.list_(pa.list_(pa.float64())), pa.list_(pa.float64()),
             *[pa.binary()] * 4]
    return dealt.groupBy("stock_id", "block").cogroup(
        copies.groupBy("stock_id", "block")).applyInArrow(packed, BLOCKS)


def fit_trees(
    train: DataFrame, growth: Growth, bases: DataFrame, features: Sequence[str] = FEATURE_COLUMNS,
    target: str = "target", block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """The stored trees of all instruments, rows of :data:`TREES`.

    ``bases`` holds per instrument the array of values that the trees of each key start from. Rows need a target;
    instruments without rows have no trees.
    """
    blocks = written_once(packed_blocks(train, bases, features, target, block_rows))
    counts = blocks.groupBy("stock_id").agg(F.count(F.lit(1)).alias("_n"))
    several = written_once(counts.where("_n > 1").select("stock_id"))

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _one_by_one(batches):
            block = Block.of(row)
            yield _tree_rows([(block.stock_id, *found) for found in fit_block(block, growth)],
                             {block.stock_id: block.cuts})

    # A task for each few blocks: fitting one takes far longer than reading it.
    alone = blocks.join(several, "stock_id", "left_anti").select(*blocks.columns)
    tasks = alone.sparkSession.sparkContext.defaultParallelism * 3
    trees = alone.repartition(tasks, "stock_id").mapInArrow(fit, TREES)
    if not several.isEmpty():
        spread = written_once(blocks.join(several, "stock_id", "left_semi").select(*blocks.columns))
        trees = trees.unionByName(_in_step(spread, growth))
    return written_once(trees)


def _grown(rows: list | None, keys: Sequence[int], depth: int) -> dict[int, dict[int, Tree]]:
    """Trees by key and number from rows of :data:`NODES`."""
    found: dict[int, dict[int, list]] = {key: {} for key in keys}
    for row in rows or []:
        found[row["key"]].setdefault(row["tree"], []).append(row)
    trees: dict[int, dict[int, Tree]] = {key: {} for key in keys}
    for key, by_number in found.items():
        for number, nodes in by_number.items():
            tree = trees[key][number] = Tree(depth)
            columns = {c: np.array([n[c] for n in nodes]) for c in ("node", "feature", "bin", "value", "low", "high")}
            for at in np.argsort(columns["node"]):  # a parent's values first
                tree.add(*[columns[c][at:at + 1] for c in ("node", "feature", "bin", "value", "low", "high")])
    return trees


def _with_nodes(blocks: DataFrame, nodes: DataFrame | None) -> DataFrame:
    if nodes is None:
        return blocks.withColumn("nodes", F.lit(None).cast(f"array<struct<{NODES}>>"))
    by_stock = nodes.groupBy("stock_id").agg(F.collect_list(F.struct(*nodes.columns)).alias("nodes"))
    return blocks.join(by_stock, "stock_id", "left")


def _predictions(row: dict, block: Block, growth: Growth) -> np.ndarray:
    if row["predicted"] is not None:
        return np.frombuffer(row["predicted"], float).reshape(len(growth.keys), -1)
    starts = [block.base[min(at, len(block.base) - 1)] for at in range(len(growth.keys))]
    return np.repeat(np.array(starts, float)[:, None], len(block.target), axis=1)


def _in_step(blocks: DataFrame, growth: Growth) -> DataFrame:
    """The trees of instruments with several blocks: one job a level for all of them.

    The nodes of the last rounds are joined to each block; every ``KEEP_ROUNDS`` rounds their trees are
    added to the predictions stored with the blocks.
    """
    stored = blocks.withColumn("predicted", F.lit(None).cast("binary"))
    cuts = blocks.where("block = 0").select("stock_id", "cuts")
    recent: DataFrame | None = None
    finished: list[DataFrame] = []
    for number in range(growth.rounds):
        for level in range(growth.depth):
            cells = _with_nodes(stored, recent).mapInArrow(
                _cells(growth, number, level),
                "stock_id int, key int, node int, feature int, bin int, g double, h double")
            nodes = written_once(_chosen(cells, growth, number, level))
            recent = nodes if recent is None else recent.unionByName(nodes)
        if (number + 1) % KEEP_ROUNDS == 0 or number + 1 == growth.rounds:
            recent = written_once(recent)
            finished.append(recent)
            if number + 1 < growth.rounds:
                stored = written_once(_with_nodes(stored, recent).mapInArrow(
                    _added(growth), f"{BLOCKS}, predicted binary"))
                recent = None
    nodes = finished[0]
    for part in finished[1:]:
        nodes = nodes.unionByName(part)

    def assembled(key: tuple, part: pa.Table, fact: pa.Table) -> pa.Table:
        stock_id = key[0].as_py()
        trees = _grown(part.to_pylist(), growth.keys, growth.depth)
        known = {stock_id: fact.column("cuts")[0].as_py()} if fact.num_rows else {}
        return pa.Table.from_batches([_tree_rows(
            [(stock_id, k, n, t) for k, by in trees.items() for n, t in sorted(by.items())], known)])

    return nodes.groupBy("stock_id").cogroup(cuts.groupBy("stock_id")).applyInArrow(assembled, TREES)


def _cells(growth: Growth, number: int, level: int):
    """Sums of one block by key, node, feature and bin, where they are not empty."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _one_by_one(batches):
            block = Block.of(row)
            predicted = _predictions(row, block, growth)
            trees = _grown(row["nodes"], growth.keys, growth.depth)
            for at, key in enumerate(growth.keys):
                value = predicted[at]
                for n, tree in sorted(trees[key].items()):
                    if n < number:
                        value = value + tree.value[tree.places(block.bins, growth.depth)]
                tree = trees[key].get(number, Tree(growth.depth))
                node = _level_of(tree, block.bins, level)
                g, h = histogram(block.bins, node, *growth.gradients(block, key, value), 2 ** level)
                held = np.flatnonzero(h.ravel() > 0)
                place = np.unravel_index(held, h.shape)
                size = len(held)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(size, block.stock_id, np.int32)), pa.array(np.full(size, key, np.int32)),
                     *[pa.array(p.astype(np.int32)) for p in place],
                     pa.array(g.ravel()[held]), pa.array(h.ravel()[held])],
                    ["stock_id", "key", "node", "feature", "bin", "g", "h"])

    return run


def _added(growth: Growth):
    """Blocks whose predictions contain the trees joined to them."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = []
            for row in _one_by_one([batch]):
                block = Block.of(row)
                trees = _grown(row["nodes"], growth.keys, growth.depth)
                predicted = _predictions(row, block, growth).copy()
                for at, key in enumerate(growth.keys):
                    for _, tree in sorted(trees[key].items()):
                        predicted[at] += tree.value[tree.places(block.bins, growth.depth)]
                values.append(predicted.tobytes())
            names = [f.split()[0] for f in BLOCKS.split(", ")]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in names], pa.array(values, pa.binary())], [*names, "predicted"])

    return run


def _chosen(cells: DataFrame, growth: Growth, number: int, level: int) -> DataFrame:
    """The split of each node of a level, from the summed cells; rows of :data:`NODES`."""
    node = ["stock_id", "key", "node"]
    lam = F.lit(growth.penalty)
    sums = cells.groupBy(*node, "feature", "bin").agg(F.sum("g").alias("g"), F.sum("h").alias("h"))
    upto = W.partitionBy(*node, "feature").orderBy("bin")
    whole = W.partitionBy(*node, "feature")
    steps = sums.withColumns({
        "lg": F.sum("g").over(upto), "lh": F.sum("h").over(upto),
        "ag": F.sum("g").over(whole), "ah": F.sum("h").over(whole)})
    high_g, high_h = F.col("ag") - F.col("lg"), F.col("ah") - F.col("lh")

    def part(a: Column, b: Column) -> Column:
        return F.coalesce(F.try_divide(a * a, b + lam), F.lit(0.0))

    def leaf(a: Column, b: Column) -> Column:
        return growth.shrunk(F.coalesce(F.try_divide(-a, b + lam), F.lit(0.0)))

    fits = (F.col("lh") >= growth.least_weight) & (high_h >= growth.least_weight)
    gain = F.when(fits, part(F.col("lg"), F.col("lh")) + part(high_g, high_h) - part(F.col("ag"), F.col("ah")))
    highest = F.max("gain").over(W.partitionBy(*node))
    best = steps.withColumn("gain", F.coalesce(gain, F.lit(float("-inf")))).withColumn("top", highest).where(
        F.col("gain") >= F.col("top") - F.abs("top") * TIE).groupBy(*node).agg(F.min(F.struct(
        "feature", "bin", "gain",
        leaf(F.col("ag"), F.col("ah")).alias("value"), leaf(F.col("lg"), F.col("lh")).alias("low"),
        leaf(high_g, high_h).alias("high"))).alias("s"))
    return best.select(
        "stock_id", "key", F.lit(number).alias("tree"), (F.col("node") + 2 ** level - 1).cast("int").alias("node"),
        F.when(F.col("s.gain") > LEAST_GAIN, F.col("s.feature")).otherwise(-1).cast("int").alias("feature"),
        "s.bin", "s.value", "s.low", "s.high")


def predict_trees(
    rows: DataFrame, trees: DataFrame, bases: DataFrame, features: Sequence[str] = FEATURE_COLUMNS,
    key: Column | None = None, output: str = "predicted", chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Rows with the value of their instrument's trees, of those with the row's ``key`` if one is given.

    A long series is spread over chunks that each get a copy of the trees. Rows of instruments without trees are
    dropped; a missing feature goes to the right of every threshold.
    """
    sizes = rows.groupBy("stock_id").agg(F.ceil(F.count(F.lit(1)) / chunk_rows).cast("int").alias("_chunks"))
    sizes = written_once(sizes)
    chunked = join_per_stock(rows, sizes).withColumns({
        "_chunk": F.pmod(F.xxhash64("trade_date"), F.col("_chunks")).cast("int"),
        "_key": F.lit(None).cast("int") if key is None else key.cast("int")}).drop("_chunks")
    models = trees.groupBy("stock_id").agg(
        F.collect_list(F.struct("key", "tree", "feature", "threshold", "value")).alias("trees")
    ).join(bases, "stock_id").join(sizes, "stock_id").withColumn(
        "_chunk", F.explode(F.sequence(F.lit(0), F.col("_chunks") - 1))).drop("_chunks")
    schema = rows.withColumn(output, F.lit(0.0)).schema
    keyed = key is not None

    def scored(part: pa.Table, model: pa.Table) -> pa.Table:
        if not model.num_rows:
            part = part.slice(0, 0)
        names, values = part.column("_key").to_pylist(), np.zeros(part.num_rows)
        x = np.stack([part.column(c).to_numpy().astype(float) for c in features], axis=1)
        if part.num_rows:
            known = model.column("trees")[0].as_py()
            base = model.column("base")[0].as_py()
            keys = sorted({t["key"] for t in known})  # those of folds start from the value after the first
            own = np.array([-1 if n is None else n for n in names])
            values[:] = base[0]
            for one in keys:
                mine = own == one if keyed else np.ones(len(own), bool)
                if keyed:
                    values[mine] = base[one + 1]
                for tree in sorted((t for t in known if t["key"] == one), key=lambda t: t["tree"]):
                    values[mine] += _walked(x[mine], tree)
        return part.drop_columns(["_chunk", "_key"]).append_column(output, pa.array(values))

    ordered = chunked.select(*rows.columns, "_chunk", "_key")
    return ordered.groupBy("stock_id", "_chunk").cogroup(
        models.groupBy("stock_id", "_chunk")).applyInArrow(scored, schema)


def _walked(x: np.ndarray, tree: dict) -> np.ndarray:
    feature, threshold = np.array(tree["feature"]), np.array(tree["threshold"])
    node, rows = np.zeros(len(x), int), np.arange(len(x))
    for _ in range(int(np.log2(len(feature) + 1)) - 1):
        split = feature[node]
        right = ~(x[rows, np.maximum(split, 0)] <= threshold[node])
        node = np.where(split >= 0, 2 * node + 1 + right, node)
    return np.array(tree["value"])[node]
