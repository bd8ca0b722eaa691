"""Shards by a weighted hash tree of regions, racks and shards.

A row descends from the root. At each level every child draws a number from the row's key and the
child's name, an exponential variate divided by the child's weight, and the smallest draw wins. A child
is thus chosen in proportion to its weight, and a changed weight moves rows only from or to the child it
belongs to; all other draws stay as they were.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, functions as F

from tickloom.llm.tables import OWN, row_number_within

HEADER_BYTES = 16


@dataclass(frozen=True)
class Topology:
    """Shards as (region, rack, shard, weight); a region or rack weighs what its shards weigh."""

    shards: tuple[tuple[int, int, int, float], ...]

    def __post_init__(self) -> None:
        names = [shard for _, _, shard, _ in self.shards]
        if not names or len(set(names)) < len(names) or min(w for *_, w in self.shards) <= 0:
            raise ValueError("a topology needs distinct shards with positive weights")

    @classmethod
    def uniform(cls, regions: int, racks: int, shards: int) -> Topology:
        """Equal weights, shards numbered in order."""
        per_region = racks * shards
        return cls(tuple(
            (n // per_region, n % per_region // shards, n, 1.0)
            for n in range(regions * per_region)))

    def grown(self, weight: float = 1.0) -> Topology:
        """One more shard, as the only one of a new region.

        Every old region keeps its weight, so only the new subtree draws rows to it, and it has no
        other shard they could reach.
        """
        regions, _, names, _ = zip(*self.shards)
        return replace(self, shards=(*self.shards, (max(regions) + 1, 0, max(names) + 1, weight)))

    def reweighted(self, weights: dict[int, float]) -> Topology:
        return replace(self, shards=tuple(
            (region, rack, shard, weights.get(shard, weight))
            for region, rack, shard, weight in self.shards))


def _children(topology: Topology) -> tuple[dict, dict, dict]:
    """Weights of the regions, of the racks of a region, and of the shards of a rack."""
    regions: dict = {}
    racks: dict = {}
    shards: dict = {}
    for region, rack, shard, weight in topology.shards:
        regions[region] = regions.get(region, 0.0) + weight
        inner = racks.setdefault(region, {})
        inner[rack] = inner.get(rack, 0.0) + weight
        shards.setdefault((region, rack), {})[shard] = weight
    return regions, racks, shards


def _draw(key: Column, *node: Column, weight: Column) -> Column:
    """An exponential variate for a key and a node, divided by the node's weight."""
    bits = F.shiftrightunsigned(F.xxhash64(key, *node), 11)
    return -F.log((bits.cast("double") + 0.5) / F.lit(float(1 << 53))) / weight


def _winner(key: Column, level: int, children: Column, *path: Column) -> Column:
    """The child, one of an array of (name, weight), with the smallest draw; ties: smaller name."""
    drawn = F.transform(children, lambda child: F.struct(
        _draw(key, F.lit(level), *path, child["name"], weight=child["weight"]).alias("draw"),
        child["name"].alias("name")))
    return F.array_min(drawn)["name"]


def _literal(children: dict) -> Column:
    return F.array(*[
        F.struct(F.lit(name).alias("name"), F.lit(weight).alias("weight"))
        for name, weight in sorted(children.items())])


def place(rows: DataFrame, key: str, topology: Topology, out: str = "shard") -> DataFrame:
    """Adds each row's shard, which only its key and the topology decide. A null key is a key."""
    regions, racks, shards = _children(topology)
    region, rack = F.col(f"{OWN}region"), F.col(f"{OWN}rack")
    rack_lists = F.create_map(*[
        c for name in sorted(racks) for c in (F.lit(name), _literal(racks[name]))])
    shard_lists = F.create_map(*[
        c for path in sorted(shards)
        for c in (F.concat_ws("/", *[F.lit(str(p)) for p in path]), _literal(shards[path]))])
    keyed = rows.withColumn(f"{OWN}region", _winner(F.col(key), 0, _literal(regions)))
    keyed = keyed.withColumn(f"{OWN}rack", _winner(F.col(key), 1, rack_lists[region], region))
    within = shard_lists[F.concat_ws("/", region.cast("string"), rack.cast("string"))]
    return keyed.withColumn(out, _winner(F.col(key), 2, within, region, rack)).drop(
        f"{OWN}region", f"{OWN}rack")


def shard_documents(
    docs: DataFrame, topology: Topology, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Each document's shard, its slot there, and its shard after the topology has grown by one.

    Returns ``doc_id, size, text_crc32, law, shard, slot, grown_shard`` under the law ``key``: only the
    id and the topology decide. Slots count from 0 without gaps, by id, checksum and size. A null or
    empty text has size 16 and checksum 0; a null id is a key like any other; repeated rows share a
    shard and have slots of their own; no rows give no rows. Other columns are neither read nor
    returned, so their names cannot clash. Hot ids fill one shard by that law, but no task.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    sized = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text) + HEADER_BYTES).cast("bigint").alias("size"),
        F.crc32(text.cast("binary")).cast("bigint").alias("text_crc32"),
        F.lit("key").alias("law"))
    placed = place(place(sized, "doc_id", topology), "doc_id", topology.grown(), "grown_shard")
    order = [F.col("doc_id"), F.col("text_crc32"), F.col("size")]
    return row_number_within(placed, "shard", order, "slot").select(
        "doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
