import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa

from tickloom.llm import lexical_search
from tickloom.llm.decontaminate import pieces
from tickloom.llm.lexical_search import Queries, Scoring, level_keys, places, search, signature_blocks

WORD = re.compile("[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
random.seed(5)
VOCABULARY = [f"w{i}" for i in range(300)] + ["Straße", "ÄB", "The", "the", "THE"] * 20
DOCS = [(i, " ".join(random.choices(VOCABULARY, k=random.choice([1, 3, 30, 300])))) for i in range(400)]
DOCS += [(400 + i, DOCS[7][1]) for i in range(30)] + [
    (500, None), (501, ""), (502, "..."), (None, "w1 w2 w3"), (503, "the " * 30_000 + "w1"), (3, DOCS[3][1]),
    (-1, DOCS[7][1].upper())]
ITEMS = [(1, "w1 w2 w2 the"), (2, None), (3, "?!"), (4, DOCS[7][1]), (5, "missing words"), (5, "missing words"),
         (6, "w9"), (6, "w10 W9"), (None, "w1"), (7, " ".join(VOCABULARY) * 2)]


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, count):
    held = [(name, Counter(words(text)), len(words(text))) for name, text in docs if words(text)]
    total, length = len(held), sum(n for *_, n in held)
    df = Counter(t for _, found, _ in held for t in found)
    asked = {}
    for name, text in dict.fromkeys(items):
        if name is not None:
            asked.setdefault(name, Counter()).update(words(text))
    rows = []
    for item, terms in asked.items():
        scores = []
        for name, found, n in held:
            m = 25 + 75 * n * total // length
            score = sum(q * math.floor(1000 * math.log((2 * total + 2) / (2 * df[t] + 1)))
                        * (10**9 * found[t] // (1000 * found[t] + 8 * m)) for t, q in terms.items() if found[t])
            if score > 0 and name is not None:
                scores.append((-score, name))
        rows += [(item, k + 1, name, -s) for k, (s, name) in enumerate(sorted(scores)[:count])]
    return sorted(rows)


def test_equals_brute_force(spark):
    docs = spark.createDataFrame([(a, b, "x", 1) for a, b in DOCS], "doc_id long, text string, score string, rank int")
    items = spark.createDataFrame([(a, b, "x") for a, b in ITEMS], "item_id long, text string, query string")
    got = search(docs.repartition(3), items)
    assert sorted(map(tuple, got.collect())) == brute(DOCS, ITEMS, 10)
    # Queries that do not fit into one broadcast take turns.
    turns = search(docs, items.where("item_id < 7"), count=3, query_terms_at_once=5)
    assert sorted(map(tuple, turns.collect())) == brute(DOCS, ITEMS[:-1], 3)


def test_empty_tables(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string")
    items = spark.createDataFrame(ITEMS, "item_id string, text string")
    assert search(docs.limit(0), items).collect() == []
    assert search(docs, items.limit(0)).collect() == []


def test_bounds_hold(spark, monkeypatch):
    # Signatures too narrow for their documents overestimate more, but never less.
    monkeypatch.setattr(lexical_search, "WIDE", 1 << 8)
    texts = pa.array([t for _, t in DOCS if words(t)], pa.large_string())
    [piece] = pieces(texts)
    vocabulary = sorted({w for w in piece.words.tolist()})
    some = np.array(vocabulary[::3], np.uint64)
    others = np.zeros(len(some), np.uint64)
    queries = Queries([1], some, others, [np.arange(len(some))], [np.ones(len(some), np.int64)])
    scoring = Scoring(queries, np.arange(len(some)) * 7 % 50, len(texts), len(piece.words))
    rows, found, counts = lexical_search.term_counts(piece)
    held = []
    for i in range(len(texts)):
        own = rows == i
        keys = level_keys(found[own])[counts[own, None] >= np.array(lexical_search.LEVELS)]
        held.append((i, int(piece.rows[i + 1] - piece.rows[i]), keys))
    block = lexical_search._block(256, held)
    slices = np.frombuffer(block.column(3)[0].as_buffer(), np.uint8).reshape(256, -1)
    sizes = np.array([h[1] for h in held])
    [bound] = scoring.bounds(256, sizes, slices)
    for i in range(len(texts)):
        counted = dict(zip(found[rows == i].tolist(), counts[rows == i].tolist()))
        m = scoring.shares(sizes[i])
        score = sum(int(w) * (10**9 * counted[t] // (1000 * counted[t] + 8 * int(m)))
                    for t, w in zip(some.tolist(), scoring.weights) if t in counted)
        assert score <= bound[i]
    assert (places(some, 256) < 256).all()
    assert signature_blocks(spark.createDataFrame(DOCS, "doc_id long, text string")).count() > 1
