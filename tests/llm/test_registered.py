"""Registered queries without SQL, run on the smallest tables and recomputed in plain Python."""

import os
import re
import zlib

import numpy as np
import pytest

from tickloom.llm.queries import QUERIES

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def documents(spark):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}


def test_op1_near_duplicates(spark):
    sets = {}
    for name, text in documents(spark).items():
        words = re.findall("[^\x20\x09-\x0D]+", text.translate(LOWER))
        sets[name] = {tuple(words[i:i + 4]) for i in range(max(len(words) - 3, min(len(words), 1)))}
    root = {name: name for name in sets}

    def find(name):
        while root[name] != name:
            name = root[name]
        return name

    names = sorted(sets)
    for i, a in enumerate(names):
        for b in names[i + 1:]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                low, high = sorted((find(a), find(b)))
                root[high] = low
    got = {r.doc_id: r for r in QUERIES["op1_minhash_near_dups"](spark, DATA).collect()}
    assert got.keys() == sets.keys()
    for name, r in got.items():
        assert (r.n_shingles, r.component_id, r.kept) == (len(sets[name]), find(name), find(name) == name)


def test_op2_least_padding(spark):
    rows = QUERIES["op2_length_buckets"](spark, DATA).collect()
    tops, counts = np.unique([r.n_tokens for r in rows], return_counts=True)
    before = np.concatenate([[0], np.cumsum(counts)])
    cost = tops * before[1:]
    for _ in range(15):
        cost = np.array([min([tops[j] * before[j + 1], *(cost[:j] + tops[j] * (before[j + 1] - before[1:j + 1]))])
                         for j in range(len(tops))])
    assert sum(r.pad_to for r in rows) == cost[-1] and len({r.pad_to for r in rows}) == 16
    assert sorted(r.doc_id for r in rows) == sorted(documents(spark))
    batches = {}
    for r in rows:
        batches.setdefault((r.bucket, r.batch), []).append(r)
    assert all(len(b) == 1 or len(b) * b[0].pad_to <= 65_536 for b in batches.values())


def test_op4_labels_held_out(spark):
    rows = QUERIES["op4_string_kernel_toxicity"](spark, DATA).collect()
    assert sorted(r.doc_id for r in rows) == sorted(documents(spark))
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)


def test_op5_nearest(spark):
    table = spark.read.parquet(f"{DATA}/embeddings.parquet").collect()
    vectors = {r.vec_id: np.array(r.embedding, float) for r in table if r.embedding is not None}
    unit = {i: v / np.linalg.norm(v) for i, v in vectors.items()}
    rows = QUERIES["op5_hilbert_neighbours"](spark, DATA).collect()
    asked = [i for i in vectors if i % 50 == 0]
    hits = 0
    for q in asked:
        own = sorted((r for r in rows if r.query_id == q), key=lambda r: r["rank"])
        assert [r["rank"] for r in own] == [1, 2, 3, 4, 5]
        assert [(-r.score, r.vec_id) for r in own] == sorted((-r.score, r.vec_id) for r in own)
        for r in own:
            assert r.vec_id != q and r.score == pytest.approx(float(unit[q] @ unit[r.vec_id]), abs=1e-12)
        best = sorted((-float(unit[q] @ unit[i]), i) for i in unit if i != q)[:5]
        hits += len({i for _, i in best} & {r.vec_id for r in own})
    assert len(rows) == 5 * len(asked) and hits >= 0.9 * 5 * len(asked)
