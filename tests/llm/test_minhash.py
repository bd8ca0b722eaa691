import random
import re

import numpy as np
import pytest

from tickloom.llm import minhash
from tickloom.llm.components import components

SCHEMA = "doc_id bigint, text string, kept string, component_id int"


def shingles(text, size):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    if not words:
        return frozenset()
    return frozenset(tuple(words[i:i + size]) for i in range(max(1, len(words) - size + 1)))


def brute(docs, size):
    ids = [d for d, _ in docs if d is not None]
    parent = {d: d for d in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    sets = [(d, shingles(t, size)) for d, t in docs if d is not None]
    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                a, b = sorted((find(a), find(b)))
                parent[b] = a
    return sorted((str(d), len(shingles(t, size)), str(find(d)) if d is not None else "None",
                   d is None or find(d) == d) for d, t in docs)


def variant(draw, words, share):
    return [draw.choice("abcdefgh") * 3 if draw.random() < share else w for w in words]


@pytest.mark.parametrize("size", [4, 5])
def test_against_brute_force(spark, size):
    draw = random.Random(size)
    docs = []
    for family in range(6):
        words = [f"w{draw.randrange(3000)}" for _ in range(draw.choice([3, 8, 60, 200]))]
        for _ in range(25):
            docs.append((len(docs) * 7 % 151 + 1000, " ".join(
                variant(draw, words, draw.choice([0, 0.01, 0.02, 0.05, 0.2])))))
    docs += [(1, None), (2, ""), (3, " \n\t"), (4, "One"), (5, "ONE"), (6, "one two"), (None, "one"),
             (7, "é É"), (8, "é é"), (9, "long " * 40_000), (10, "LONG " * 39_000), (4, "One")]
    frame = spark.createDataFrame([(*d, "clash", 1) for d in docs], SCHEMA)
    got = minhash.near_duplicates(frame, size=size, rounds=1).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id), r.kept) for r in got) \
        == brute(docs, size)


def test_rows_that_share_an_id_are_linked(spark):
    texts = ["a b c d e f", "p q r s t u", "p q r s t u", "unlike all the others here"]
    frame = spark.createDataFrame(list(zip([5, 5, 9, 7], texts)), "doc_id bigint, text string")
    got = {(r.doc_id, r.component_id) for r in minhash.near_duplicates(frame).collect()}
    assert got == {(5, 5), (9, 5), (7, 7)}


def test_no_rows(spark):
    assert minhash.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_signatures_estimate_similarity():
    draw = np.random.default_rng(1)
    shared = draw.integers(0, 1 << 63, 800, dtype=np.uint64)
    one = np.concatenate([shared, draw.integers(0, 1 << 63, 100, dtype=np.uint64)])
    two = np.concatenate([shared, draw.integers(0, 1 << 63, 100, dtype=np.uint64)])
    a, b = minhash.signatures([one, two], 2000)
    assert (a == b).mean() == pytest.approx(0.8, abs=0.04)
    assert len(set(minhash.band_names(np.stack([a, a]), 400).ravel())) == 400


def test_permutations_are_bijections():
    x = np.random.default_rng(2).choice(1 << 32, 100_000, replace=False).astype(np.uint32)
    for factors in (minhash.SHUFFLE, minhash.ORDER):
        assert len(np.unique(minhash._permuted(x, factors))) == len(x)


def test_components(spark):
    chain = [(i, i + 1) for i in range(20)]
    star = [(100, 100 + i) for i in range(1, 300)]
    edges = chain[::-1] + star + star[:5] + [(50, 50), (31, 30)]
    got = {(r.node, r.component) for r in components(
        spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    want = {(i, 0) for i in range(21)} | {(100 + i, 100) for i in range(300)} | {(30, 30), (31, 30)}
    assert got == want
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0
