import random

import numpy as np

from tickloom.llm import toxicity
from tickloom.llm.string_kernel import DECAY, SPAN, Landmarks, pieces_of
from pyspark.sql import functions as F

INSULTS = ["idiotic", "worthless", "pathetic", "scumbag"]
SYLLABLES = ["ba", "ne", "ro", "ti", "lu", "mo", "ka", "de", "si", "fo"]


def kernel(one, two):
    """All subsequences of three characters within the span, by brute force."""
    def features(text):
        out = {}
        for a in range(len(text)):
            for b in range(a + 1, len(text)):
                for c in range(b + 1, min(len(text), a + SPAN)):
                    key = text[a] + text[b] + text[c]
                    out[key] = out.get(key, 0) + DECAY ** (c - a + 1)
        return out
    x, y = features(one), features(two)
    return sum(w * y.get(k, 0) for k, w in x.items())


def test_kernel_against_brute_force():
    draw = random.Random(2)
    strings = ["".join(draw.choice("abcé") for _ in range(draw.randint(3, 12))) for _ in range(30)]
    got = Landmarks(strings[:8]).similarities(strings)
    for i, s in enumerate(strings):
        for j, z in enumerate(strings[:8]):
            assert abs(got[i, j] - min(1, kernel(s, z) / kernel(z, z))) < 1e-5


def test_gaps_and_inserted_characters():
    found = Landmarks(["idiot"]).similarities(
        ["idiot", "theidiots", "idxiot", *pieces_of("i.d.i.o.t"), "window"])[:, 0]
    assert min(found[0], found[1], found[3]) > 0.9999 and found[2] > 0.6 > 0.3 > found[4]
    assert pieces_of("a,") == [] and all(len(p) <= 40 for p in pieces_of("x" * 1000))


def corpus():
    draw = random.Random(9)
    docs, labels = [], []
    for i in range(600):
        words = ["".join(draw.choice(SYLLABLES) for _ in range(draw.randint(1, 4)))
                 for _ in range(draw.randint(5, 80))]
        toxic = i % 4 == 0
        if toxic:
            words.insert(draw.randrange(len(words)), draw.choice(INSULTS))
        text = " ".join(w + (". " if draw.random() < 0.1 else "") for w in words)
        docs.append((i, text, 0.5, "clash"))
        labels.append((i, int(toxic), 1))
    return docs, labels


def test_held_out_and_edges(spark):
    docs, labels = corpus()
    extra = [(1000, None, 0.5, ""), (1001, "", 0.5, ""), (1002, "bane " * 60_000 + "scumbag", 0.5, ""),
             (1003, "this is p a t h e t i c", 0.5, ""), (1004, "you wor-thl-ess", 0.5, ""),
             (1005, "idixotic", 0.5, ""), (None, "worthless", 0.5, "")]
    schema = "doc_id bigint, text string, score double, label string"
    frame = spark.createDataFrame(docs + docs[:3] + extra, schema)
    known = spark.createDataFrame(
        [r for r in labels if r[0] >= 200] + labels[300:310] + [(None, 1, 1), (205, None, 1)],
        "doc_id bigint, toxic int, text int")
    model = toxicity.fit(frame, known)
    got = frame.select("doc_id", "text", toxicity.score(model, F.col("text")).alias("s")).collect()
    assert all(0 <= r.s <= 1 for r in got) and len(got) == len(docs) + 3 + len(extra)
    by_id = {r.doc_id: r.s for r in got}
    held = [(by_id[i], toxic) for i, toxic, _ in labels if i < 200]
    assert np.mean([(s >= 0.5) == (t == 1) for s, t in held]) >= 0.97
    assert by_id[1000] < 0.3 and by_id[1001] < 0.3
    assert min(by_id[i] for i in (1002, 1003, 1004, 1005, None)) >= 0.5


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(1, "a text"), (2, None)], "doc_id bigint, text string")
    none = spark.createDataFrame([], "doc_id bigint, toxic int")
    one = spark.createDataFrame([(1, 1)], "doc_id bigint, toxic int")
    for labels, low, high in ((none, 0, 0.01), (one, 0.99, 1)):
        model = toxicity.fit(docs, labels)
        scores = docs.select(toxicity.score(model, F.col("text")).alias("s")).collect()
        assert all(low <= r.s <= high for r in scores)
    assert docs.limit(0).select(toxicity.score(model, F.col("text"))).count() == 0


def test_remembered_tokens_hold_no_more_than_themselves():
    draw = random.Random(5)
    words = ["".join(draw.choice(SYLLABLES) for _ in range(4)) for _ in range(6000)] + INSULTS
    similar = toxicity.Similarities(Landmarks(INSULTS, toxicity.FLOOR))
    found = [v for _, v in similar.of([" ".join(words)])]
    assert found and similar.vectors and all(v.base is None for v in similar.vectors)
    want = Landmarks(INSULTS, toxicity.FLOOR).similarities(words)
    assert np.allclose(np.max(found, axis=0), want.max(axis=0))
