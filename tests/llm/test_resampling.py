import hashlib
import math
import random
import re
import zlib
from collections import Counter

from tickloom.llm.radix import radix_ranks
from tickloom.llm.resampling import resample

WORD = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
random.seed(3)
VOCABULARY = ["alpha", "Beta", "straße", "x" * 63, "y" * 64, "z" * 65, "w" * 700, "42", "of", "the"]
TEXTS = [" ".join(random.choices(VOCABULARY, k=k)) for k in (1, 2, 19, 20, 21, 40, 200, 3000)]
DOCS = [(i, t) for i, t in enumerate(TEXTS)] + [
    (8, None), (9, ""), (10, "... !"), (11, TEXTS[6]), (12, TEXTS[6]), (12, TEXTS[6]), (None, TEXTS[5]),
    (-5, TEXTS[7]), (1 << 62, TEXTS[6])]
TARGET = [(1, "alpha beta of the"), (2, None), (3, "")]


def runs(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = WORD.findall(lowered)
    return words, words + [f"{a} {b}" for a, b in zip(words, words[1:])]


def brute(docs, target, percent):
    bucket = lambda f: zlib.crc32(f.encode()) % 10000
    held = Counter(bucket(f) for _, t in docs for f in runs(t)[1])
    aim = Counter(bucket(f) for _, t in target for f in runs(t)[1])
    s, t = sum(held.values()), sum(aim.values())
    gain = {b: math.floor(1000 * math.log((aim[b] + 1) * (s + 10000) / ((held[b] + 1) * (t + 10000))))
            for b in held}
    rows = []
    for name, text in docs:
        words, found = runs(text)
        weight = sum(gain[bucket(f)] for f in found) // len(found) if found else 0
        score = None
        if name is not None:
            h = int(hashlib.sha256(f"7:{name}".encode()).hexdigest()[:8], 16)
            score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append([name, len(words), len(found), weight, score, None])
    may = sorted((r for r in rows if r[0] is not None and r[1] >= 20), key=lambda r: (-r[4], r[0]))
    for place, row in enumerate(may[:percent * len(may) // 100]):
        row[5] = place + 1
    return sorted(map(str, rows))


def test_equals_brute_force(spark):
    docs = spark.createDataFrame([(a, b, "x", 1) for a, b in DOCS], "doc_id long, text string, score string, rank int")
    target = spark.createDataFrame(TARGET, "item_id long, text string")
    for percent in (0, 60):
        got = resample(docs.repartition(3), target, percent=percent)
        assert sorted(str(list(r)) for r in got.collect()) == brute(DOCS, TARGET, percent)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert resample(none, none).collect() == []
    docs = spark.createDataFrame(DOCS, "doc_id long, text string")
    assert sorted(str(list(r)) for r in resample(docs, none).collect()) == brute(DOCS, [], 25)


def test_radix_ranks(spark):
    values = [(random.randrange(-50, 50), random.randrange(-(1 << 63), 1 << 63), i) for i in range(3000)]
    values += [(7, 7, -1)] * 500
    rows = spark.createDataFrame(values, "a long, b long, i long").repartition(5)
    want = sorted(values, key=lambda v: (-v[0], v[1]))
    for bits in (11,):
        got = radix_ranks(rows, [("a", True), ("b", False)], "rank", bits, 5).collect()
        assert sorted(r["rank"] for r in got) == list(range(len(values)))
        assert [tuple(r)[:2] for r in sorted(got, key=lambda r: r["rank"])] == [v[:2] for v in want]
    same = radix_ranks(rows.where("i = -1"), [("a", False)], "rank").collect()
    assert sorted(r["rank"] for r in same) == list(range(500))
