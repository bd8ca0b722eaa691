import hashlib
import random
import re
from collections import Counter

import numpy as np

from tickloom.llm import suffix_repeats
from tickloom.llm.suffix_repeats import deep_nodes, find_repeats, least_places, prefix_ranges

WORD = re.compile("[^\x20\x09-\x0D]+")
random.seed(9)
FRESH = iter(range(10**9))


def prose(count):
    return " ".join(f"{random.choice('abcdé')}{next(FRESH)}" for _ in range(count))


def documents():
    passage, other, whole = prose(60), prose(12), prose(50)
    docs = [(0, f"{prose(20)} {passage} {prose(7)}"), (1, f"{passage}\n{prose(30)}"),
            (2, f"{prose(30)}\t{passage.replace(' ', '  ')}"), (3, f"{prose(5)} {passage} {other} {prose(9)} {other}"),
            (4, whole), (5, whole), (5, whole), (6, whole.upper()), (7, " ".join(whole.split()[3:38])),
            (8, " ".join(whole.split()[3:37])), (9, None), (10, ""), (11, " \n "), (12, "same " * 300),
            (13, "a b c " * 40), (14, f"{other} {other} {other} {other}"), (None, passage), (15, prose(35)),
            (16, prose(40_000) + " " + passage), (17, "x" * 70_000), (18, "same " * 34)]
    # Two texts that end and begin with repeats follow each other.
    return docs + [(19, f"{prose(3)} {passage}"), (20, f"{passage} {prose(3)}"), (21, " ".join("ab" * 40))]


DOCS = documents()


def brute(docs, size):
    words = [WORD.findall(t or "") for _, t in docs]
    held = Counter(tuple(w[i:i + size]) for w in words for i in range(len(w) - size + 1))
    rows = []
    for (name, _), w in zip(docs, words):
        gone = {k for i in range(len(w) - size + 1) if held[tuple(w[i:i + size])] > 1 for k in range(i, i + size)}
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        spans = [k for k in sorted(gone) if k - 1 not in gone]
        rows.append((name, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest(), spans,
                     kept if gone else None))
    return sorted(rows, key=str)


def found(docs, **kwargs):
    rows = find_repeats(docs, cleaned=True, **kwargs).collect()
    for r in rows:
        spans = r["__repeats"]["spans"]
        assert sum(b - a for a, b in spans) == r["__repeats"]["n_removed"]
        assert r["__repeats"]["repeated"] == bool(spans)
    return sorted([(r.doc_id, r["__repeats"]["n_words"], r["__repeats"]["n_removed"], r["__repeats"]["kept_sha256"],
                    [a for a, _ in r["__repeats"]["spans"]], r["__repeats"]["text"]) for r in rows], key=str)


def test_equals_brute_force(spark):
    docs = spark.createDataFrame([(a, b, "x", "y") for a, b in DOCS], "doc_id long, text string, path string, runs string")
    assert found(docs.coalesce(1)) == brute(DOCS, 35)
    assert found(docs.repartition(3), size=8) == brute(DOCS, 8)


def test_groups_are_split(spark):
    # A bound far below the number of labels: prefixes grow until groups have one label.
    docs = spark.createDataFrame(DOCS[:16], "doc_id long, text string").repartition(3)
    assert found(docs, group=2, size=20) == brute(DOCS[:16], 20)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert find_repeats(none).collect() == []
    assert find_repeats(spark.createDataFrame([(1, None)], "doc_id long, text string")).first()[2]["n_words"] == 0


def test_least_places():
    values = np.array([random.randrange(5) for _ in range(200)], np.uint64)
    for width in (1, 2, 7, 24):
        want = [i + int(np.argmin(values[i:i + width])) for i in range(len(values) - width + 1)]
        assert least_places(values, width).tolist() == want


def test_subtrees():
    labels = np.array([[1, 5], [1, 5], [1, 6], [2, 5], [1 << 63, 0]], np.uint64)
    assert [a.tolist() for a in deep_nodes(labels)] == [[0, 2, 3, 4], [2, 3, 4, 5]]
    ranges = list(prefix_ranges(labels, 16))
    assert ranges == [(f"{1:016x}", 0, 3), (f"{2:016x}", 3, 4), ("8" + "0" * 15, 4, 5)]
    assert [r[1:] for r in prefix_ranges(labels, 32)] == [(0, 2), (2, 3), (3, 4), (4, 5)]
    assert list(prefix_ranges(labels, 0)) == [("", 0, 5)]
    assert suffix_repeats.shared_symbols(labels).tolist() == [0, 4, 3, 1, 0]
