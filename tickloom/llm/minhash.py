"""Near-duplicate texts by circulant MinHash, bands, and exact verification on whole shingle sets.

Two permutations make all coordinates of a signature: the first shuffles the hashed shingles, and the
second, shifted around by one more place for each coordinate, orders them; a coordinate is the smallest
place. Texts with equal shingle sets form a class, whose smallest document id stands for it in the search.

Classes that share a band are candidates. A group of many similar classes has many such pairs, but its
component needs few links. So pivots of each bucket are verified first, in rounds, and what they link is
contracted. In the end the candidates that still share bands with other components are compared by their
rarest shingles, of which linked sets share one, and every pair in different components that does is
verified. So the components are those of all candidate links, without all pairs of a group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, Window
from pyspark.sql.functions import arrow_udf

from tickloom.llm.components import components
from tickloom.llm.spans import BYTE_VALUES, LOWER, hashes, mix, runs, text_pieces, windows
from tickloom.llm.tables import may_hold
from tickloom.session import written_once

WORDS = 5
#: Similarity from which texts are linked, in per cent.
PERCENT = 80
#: A linked pair shares no band with probability (1 - 0.8^5)^40, about one in ten million.
BANDS, ROWS = 40, 5
#: Rounds of pivots, and pivots that a class is verified against in each.
ROUNDS, PIVOTS = 2, 3
#: Text handled at once, so that its shingles stay in the processor's cache.
PIECE = 1 << 18

#: Bytes of words: all but blank, tab, line feed, vertical tab, form feed and carriage return.
WORD_BYTES = np.ones(256, dtype=bool)
WORD_BYTES[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
LOWERED = BYTE_VALUES[LOWER]


def shingle_sets(column: pa.Array, size: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text.

    A shingle is ``size`` consecutive words, A-Z in lower case; fewer words are one shingle.
    """
    for _, data, bounds in text_pieces(column, PIECE):
        starts, ends = runs(data, bounds, WORD_BYTES)
        words = hashes(data, starts, ends, LOWERED)
        rows = np.searchsorted(starts, bounds)
        for a, b in zip(rows[:-1].tolist(), rows[1:].tolist()):
            yield np.unique(windows(words[a:b], min(size, b - a))) if b > a else words[:0]


# Odd factors of the permutations of the 32-bit integers.
SHUFFLE = (np.uint32(0x9E3779B1), np.uint32(0x85EBCA77))
ORDER = (np.uint32(0xC2B2AE3D), np.uint32(0x27D4EB2F))


def _permuted(x: np.ndarray, factors: tuple) -> np.ndarray:
    x = x * factors[0]
    x ^= x >> np.uint32(15)
    x *= factors[1]
    x ^= x >> np.uint32(13)
    return x


def signatures(sets: list[np.ndarray], coordinates: int) -> np.ndarray:
    """Circulant MinHash of non-empty sets: a row of coordinates for each."""
    places = _permuted((np.concatenate(sets) >> np.uint64(32)).astype(np.uint32), SHUFFLE)
    firsts = np.cumsum([0] + [len(s) for s in sets[:-1]])
    out = np.empty((coordinates, len(sets)), dtype=np.uint32)
    for k in range(coordinates):
        out[k] = np.minimum.reduceat(_permuted(places + np.uint32(k), ORDER), firsts)
    return out.T


def band_names(signature: np.ndarray, bands: int) -> np.ndarray:
    """A 64-bit name for each band of each row."""
    parts = signature.reshape(len(signature), bands, -1).astype(np.uint64)
    out = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), parts.shape[:2]).copy()
    for k in range(parts.shape[2]):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, k])
    return out.view(np.int64)


def _least_linked(percent: int) -> int:
    """Sets smaller than this are linked with equal sets only: one element more is too much."""
    return percent // (100 - percent) if percent < 100 else 1 << 62


FACTS = ("doc_id bigint, n_shingles bigint, class_a bigint, class_b bigint, bands array<bigint>")


def set_facts(docs: DataFrame, size: int, bands: int, rows: int, percent: int) -> DataFrame:
    """Size, fingerprint and bands of each document's shingle set (``doc_id``, ``text``)."""
    least = _least_linked(percent)

    def facts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done, held, weight = 0, [], 0
            for one in shingle_sets(batch.column(1), size):
                held.append(one)
                weight += len(one)
                if weight >= PIECE // 8:
                    yield described(batch.column(0).slice(done, len(held)), held)
                    done, held, weight = done + len(held), [], 0
            if held:
                yield described(batch.column(0).slice(done, len(held)), held)

    def described(doc_ids: pa.Array, sets: list[np.ndarray]) -> pa.RecordBatch:
        large = [i for i, s in enumerate(sets) if len(s) >= least]
        names: list = [None] * len(sets)
        if large:
            found = band_names(signatures([sets[i] for i in large], bands * rows), bands)
            for i, own in zip(large, found):
                names[i] = own
        sums = np.array([
            (mix(s).sum(dtype=np.uint64), mix(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64))
            for s in sets], dtype=np.uint64).view(np.int64)
        return pa.RecordBatch.from_arrays([
            doc_ids, pa.array([len(s) for s in sets], pa.int64()), pa.array(sums[:, 0]),
            pa.array(sums[:, 1]), pa.array(names, pa.list_(pa.int64()))],
            ["doc_id", "n_shingles", "class_a", "class_b", "bands"])

    return docs.select("doc_id", "text").mapInArrow(facts, FACTS)


def _stored_sets(docs: DataFrame, nodes: DataFrame, size: int) -> DataFrame:
    """The shingle sets of the nodes, as sorted 64-bit integers, written once."""
    def packed(texts: pa.Array) -> pa.Array:
        return pa.array([s.tobytes() for s in shingle_sets(texts, size)], pa.binary())

    maybe = may_hold(nodes, docs.select(F.col("doc_id").alias("node"), "text"), "node")
    chosen = maybe.join(nodes, "node", "left_semi")
    return written_once(chosen.select("node", arrow_udf(packed, "binary")(F.col("text")).alias("s")))


def _linked(percent: int) -> Column:
    """Whether two packed sets are similar enough."""
    def similar(one: pa.Array, two: pa.Array) -> pa.Array:
        out = []
        for a, b in zip(one, two):
            x = np.frombuffer(a.as_buffer(), np.uint64)
            y = np.frombuffer(b.as_buffer(), np.uint64)
            both = len(np.intersect1d(x, y, assume_unique=True))
            out.append(100 * both >= percent * (len(x) + len(y) - both))
        return pa.array(out, pa.bool_())

    return arrow_udf(similar, "boolean")(F.col("s_a"), F.col("s_b"))


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The linked ones of pairs (``a``, ``b``), on whole sets."""
    one = sets.select(F.col("node").alias("a"), F.col("s").alias("s_a"))
    two = sets.select(F.col("node").alias("b"), F.col("s").alias("s_b"))
    size_a, size_b = F.octet_length("s_a"), F.octet_length("s_b")
    near = 100 * F.least(size_a, size_b) >= percent * F.greatest(size_a, size_b)
    return pairs.join(one, "a").join(two, "b").where(near).where(_linked(percent)).select("a", "b")


def _pairs(one: str, two: str) -> list[Column]:
    return [F.least(one, two).alias("a"), F.greatest(one, two).alias("b")]


def _pivot_pairs(members: DataFrame, turn: int, pivots: int) -> DataFrame:
    """Each class with up to ``pivots`` pivots of its buckets that are in other components.

    A bucket's pivot is its class that meets most others in all buckets, since what lies in the middle
    of a group is linked with most of it; every other round, it is the one with the smallest hash.
    """
    draw = -F.col("weight") if turn % 2 == 0 else F.xxhash64(F.lit(turn), "node")
    drawn = F.struct(draw.alias("draw"), "node", "component")
    heads = members.groupBy("bucket").agg(
        F.min("component").alias("low"), F.max("component").alias("high"), F.min(drawn).alias("p")
    ).where("low < high").select("bucket", "p")
    met = members.join(heads, "bucket").where(F.col("component") != F.col("p.component"))
    chosen = met.groupBy("node").agg(F.slice(
        F.array_sort(F.collect_set(F.struct("p.draw", "p.node"))), 1, pivots).alias("ps"))
    return chosen.select("node", F.explode("ps.node").alias("pivot")).select(
        *_pairs("node", "pivot")).distinct()


def _cross_pairs(rare: DataFrame, percent: int) -> DataFrame:
    """Pairs of classes in different components that have a rare shingle in common.

    Before the first shingle that two sets share, nothing is shared: what is left of the smaller one must
    suffice for the similarity. For each shingle, the classes outside its largest component meet all others.
    """
    sizes = rare.groupBy("shingle", "component").agg(F.count(F.lit(1)).alias("n"))
    heads = sizes.groupBy("shingle").agg(
        F.max(F.struct("n", "component")).alias("top"), F.count(F.lit(1)).alias("k")
    ).where("k > 1").select("shingle", F.col("top.component").alias("largest"))
    opened = rare.join(heads, "shingle")
    few = opened.where("component != largest").select(
        "shingle", *[F.col(c).alias(f"one_{c}") for c in ("node", "component", "size", "place")])
    left = F.least(F.col("size") - F.col("place"), F.col("one_size") - F.col("one_place")) + 1
    enough = (100 + percent) * left >= percent * (F.col("size") + F.col("one_size"))
    met = few.join(opened, (few["shingle"] == opened["shingle"])
                   & (F.col("one_component") != F.col("component")) & enough)
    return met.select(*_pairs("one_node", "node")).distinct()


def _rare_shingles(sets: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Of each node's set, the rarest shingles: linked sets have one of them in common.

    With fewer than n - ceil(percent * n / 100) + 1 of a set's n shingles missing, one of so many
    remains in the other set; both list theirs in one order, rarest first. Shingles that no other node has
    count, but lead nowhere. So a set that differs too much from all others has nothing to compare.
    """
    def unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for node, packed in zip(batch.column(0), batch.column(1)):
                own = np.frombuffer(packed.as_buffer(), np.int64)
                for at in range(0, len(own), 1 << 16):
                    part = own[at:at + (1 << 16)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(part), node.as_py())),
                         pa.array(np.full(len(part), len(own))), pa.array(part)],
                        ["node", "size", "shingle"])

    rows = written_once(sets.join(nodes, "node", "left_semi").select("node", "s").mapInArrow(
        unpacked, "node bigint, size bigint, shingle bigint"))
    shared = rows.groupBy("shingle").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    met = rows.join(shared, "shingle")
    own = Window.partitionBy("node")
    missing = F.col("size") - F.ceil(F.col("size") * percent / 100) + 1
    alone = F.col("size") - F.count(F.lit(1)).over(own)
    place = F.row_number().over(own.orderBy("n", "shingle"))
    return met.withColumn("place", place + alone).where(F.col("place") <= missing).select(
        "node", "shingle", "size", "place")


def _open_pairs(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs of candidates in different components that may still be linked."""
    opened = members.groupBy("bucket").agg(
        F.min("component").alias("low"), F.max("component").alias("high")).where("low < high")
    labels = written_once(members.join(opened.select("bucket"), "bucket").select(
        "node", "component").distinct())
    rare = _rare_shingles(sets, labels.select("node"), percent)
    return _cross_pairs(rare.join(labels, "node"), percent)


def _merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """Labels (``node``, ``component``) after links between nodes."""
    at = labels.select(F.col("node").alias("a"), F.col("component").alias("x"))
    to = labels.select(F.col("node").alias("b"), F.col("component").alias("y"))
    edges = links.join(at, "a").join(to, "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
    moved = components(edges).select(
        F.col("node").alias("component"), F.col("component").alias("to"))
    return written_once(labels.join(moved, "component", "left").select(
        "node", F.coalesce("to", "component").alias("component")))


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = WORDS,
    percent: int = PERCENT, bands: int = BANDS, rows: int = ROWS, rounds: int = ROUNDS,
    pivots: int = PIVOTS,
) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` of each document.

    Documents are linked if their shingle sets share ``percent`` per cent of their union, and also if
    they share an id. ``component_id`` is the smallest id reachable. A null or empty text, or one without
    words, has an empty set and no links. A document without an id takes part in none, has no
    ``component_id`` and is kept. Repeated rows are returned each. Texts of any length are read whole, in
    pieces. No rows give no rows. Other columns are not read.
    """
    texts = docs.select(
        F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    facts = written_once(set_facts(texts, size, bands, rows, percent))
    named = facts.where("doc_id IS NOT NULL AND n_shingles > 0")
    classes = written_once(named.groupBy("class_a", "class_b", "n_shingles").agg(
        F.min("doc_id").alias("node"), F.first("bands").alias("bands")))
    in_bands = classes.where("bands IS NOT NULL").select("node", F.explode("bands").alias("bucket"))
    shared = in_bands.groupBy("bucket").agg(
        F.min("node").alias("low"), F.max("node").alias("high"), F.count(F.lit(1)).alias("n")
    ).where("low < high")
    candidates = in_bands.join(shared.select("bucket", "n"), "bucket").groupBy("node", "bucket").agg(
        F.max("n").alias("n"))
    candidates = written_once(candidates)
    nodes = written_once(candidates.groupBy("node").agg(F.sum("n").alias("weight")))
    candidates = candidates.join(nodes, "node").select("node", "bucket", "weight")
    nodes = nodes.select("node")
    sets = _stored_sets(texts, nodes, size)

    # Rows with one id and different texts: their classes belong together.
    key = ["class_a", "class_b", "n_shingles"]
    members = named.select("doc_id", *key).join(classes.select(*key, "node"), key)
    split = members.groupBy("doc_id").agg(
        F.min("node").alias("a"), F.max("node").alias("z")).where("a < z")
    links = members.join(split.select("doc_id", "a"), "doc_id").select(
        "a", F.col("node").alias("b")).where("a != b").distinct()
    labels = written_once(
        nodes.unionByName(links.select(F.explode(F.array("a", "b")).alias("node"))).distinct()
        .withColumn("component", F.col("node")))
    labels = _merged(labels, links)
    for turn in range(rounds + 1):
        placed = candidates.join(labels, "node")
        pairs = _pivot_pairs(placed, turn, pivots) if turn < rounds else _open_pairs(
            placed, sets, percent)
        pairs = written_once(pairs)
        found = written_once(_verified(pairs, sets, percent))
        labels = _merged(labels, found)

    owners = classes.select(*key, "node").join(labels, "node", "left").select(
        *key, F.coalesce("component", "node").alias("component"))
    placed = facts.drop("bands").join(owners, key, "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return placed.select("doc_id", "n_shingles", component.alias("component_id")).withColumn(
        "kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
