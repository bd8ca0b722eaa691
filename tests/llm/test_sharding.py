import math
import os
import struct
import zlib

import pytest
import xxhash

from tickloom.llm.queries import QUERIES
from tickloom.llm.sharding import Topology, place, shard_documents

DATA = "/root/testdata/sf0.001"
SCHEMA = "doc_id bigint, text string, shard string, slot int"


def test_contract_and_edges(spark):
    texts = ["", None, "é" * 3, "x" * 200_000] + [f"text {i % 7}" for i in range(400)]
    rows = [(i if i != 5 else None, t, "clash", -1) for i, t in enumerate(texts)]
    rows += rows[10:12]
    got = shard_documents(
        spark.createDataFrame(rows, SCHEMA), Topology.uniform(5, 2, 4)).collect()
    assert len(got) == len(rows)
    slots = {}
    for r in got:
        slots.setdefault(r.shard, []).append(r.slot)
        assert 0 <= r.shard < 40 and r.law == "key"
        assert r.grown_shard in (r.shard, 40)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert any(r.grown_shard == 40 for r in got)
    by_id = {}
    for r in got:
        assert by_id.setdefault(r.doc_id, r.shard) == r.shard
    for r in got:
        if r.doc_id is not None:
            body = (texts[r.doc_id] or "").encode()
            assert (r.size, r.text_crc32) == (len(body) + 16, zlib.crc32(body))


def test_hot_key_has_gapless_slots(spark):
    rows = [(7, f"copy {i % 3}", "", 0) for i in range(300)] + [(i, "", "", 0) for i in range(100)]
    got = shard_documents(spark.createDataFrame(rows, SCHEMA), Topology.uniform(2, 1, 2)).collect()
    slots = {}
    for r in got:
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_no_rows(spark):
    assert shard_documents(spark.createDataFrame([], SCHEMA), Topology.uniform(1, 1, 2)).count() == 0


def test_weights_and_confined_moves(spark):
    rows = spark.range(20_000).withColumnRenamed("id", "doc_id")
    before = Topology(((0, 0, 0, 1.0), (0, 0, 1, 1.0), (0, 1, 2, 2.0), (1, 0, 3, 4.0)))
    after = before.reweighted({1: 3.0})
    both = place(place(rows, "doc_id", before, "a"), "doc_id", after, "b").collect()
    shares = [sum(r.a == s for r in both) / 20_000 for s in range(4)]
    assert shares == pytest.approx([1 / 8, 1 / 8, 2 / 8, 4 / 8], abs=0.02)
    moved = [(r.a, r.b) for r in both if r.a != r.b]
    # Only the region, rack and shard whose weights grew receive rows; region 1 receives none.
    assert moved and all(b != 3 for _, b in moved)
    assert {b for a, b in moved if a in (0, 2)} <= {0, 1}


def test_topology_is_checked():
    with pytest.raises(ValueError):
        Topology(((0, 0, 0, 1.0), (0, 0, 0, 1.0)))
    with pytest.raises(ValueError):
        Topology(((0, 0, 0, 0.0),))


def plain_shard(doc_id, shards):
    """The descent recomputed in plain Python: xxHash over the key, the level and the path."""
    def draw(level, path, weight):
        state = 42 if doc_id is None else xxhash.xxh64_intdigest(struct.pack("<q", doc_id), seed=42)
        for part in (level, *path):
            state = xxhash.xxh64_intdigest(struct.pack("<i", part), seed=state)
        return -math.log(((state >> 11) + 0.5) / 2 ** 53) / weight

    path = ()
    for level in range(3):
        weights = {}
        for *names, weight in shards:
            if tuple(names[:level]) == path:
                weights[names[level]] = weights.get(names[level], 0.0) + weight
        path += (min(weights, key=lambda name: (draw(level, (*path, name), weights[name]), name)),)
    return path[-1]


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
def test_registered_query_equals_plain_python(spark):
    rows = QUERIES["op6_hash_tree_shards"](spark, DATA).collect()
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    old = [(n // 8, n % 8 // 4, n, 1.0) for n in range(40)]
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    slots = {}
    for r in rows:
        body = texts[r.doc_id].encode()
        assert (r.size, r.text_crc32) == (len(body) + 16, zlib.crc32(body))
        assert r.shard == plain_shard(r.doc_id, old)
        assert r.grown_shard == plain_shard(r.doc_id, [*old, (5, 0, 40, 1.0)])
        slots.setdefault(r.shard, []).append((r.doc_id, r.slot))
    for held in slots.values():
        assert [slot for _, slot in sorted(held)] == list(range(len(held)))
