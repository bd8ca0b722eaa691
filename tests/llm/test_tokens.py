import random
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tickloom.llm import bitpack, packing
from tickloom.llm.spans import hashes, runs, text_pieces
from tickloom.llm.tokens import Encoder

PATH = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id bigint, text string, start string, n_tokens int"


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


def test_encoder_equals_the_tokenizer(tokenizer):
    signs = ["a", "b", " ", "  ", "'", "'s", "'re", "ll", "\n", "1", ".", " '", "é", "ß", "\t",
             "<|endoftext|>", "×", "–", "s", "t", "Ł", "\x1c", "_", "日本"]
    draw = random.Random(3)
    texts = ["".join(draw.choice(signs) for _ in range(draw.randint(0, 12))) for _ in range(5000)]
    texts += [None, "", "word " * 50_000, "x" * 100_000]
    found = {}
    for row, flat, bounds in Encoder(PATH).encode(pa.array(texts)):
        for i in range(len(bounds) - 1):
            found[row + i] = flat[bounds[i]:bounds[i + 1]].tolist()
    want = [e.ids for e in tokenizer.encode_batch(
        [t or "" for t in texts], add_special_tokens=False)]
    assert [found[i] for i in range(len(texts))] == want


@pytest.mark.parametrize("bits", [1, 7, 16, 17, 31, 32])
def test_packing_round_trip(bits):
    ids = np.random.default_rng(bits).integers(0, 1 << bits, 1000, dtype=np.uint64)
    packed = bitpack.pack(ids, bits)
    assert len(packed) == -(-1000 // 64) * 8 * bits
    assert np.array_equal(bitpack.unpack(packed, 1000, bits), ids.astype(np.uint32))


def test_random_access(tmp_path):
    from tickloom.llm import files
    ids = np.arange(20_000, dtype=np.uint32) % 50_000
    path = f"file://{tmp_path}/one.bin"
    with files.written(path) as stream:
        writer = bitpack.TokenWriter(stream, 16)
        writer.append(np.array([4, 9]), np.array([False, False]), ids, np.array([5000, 15_000]))
        writer.close()
    stored = bitpack.TokenFile(path)
    assert np.array_equal(stored.ids(4090, 8300), ids[4090:8300])
    assert stored.ids(5, 5).size == 0 and stored.n_ids == 20_000
    assert [(a, b, len(x)) for a, b, x in stored.documents()] == [(0, 2, 20_000)]


def test_token_table(spark, tokenizer, monkeypatch):
    monkeypatch.setattr(bitpack, "HELD_IDS", 4096)
    rows = [(i * 3, f"some text number {i} " * (i % 9), "clash", i) for i in range(300)]
    rows += [(None, "no id", "", 0), (4, None, "", 0), (5, "", "", 0), (7, "long " * 30_000, "", 0)]
    rows += rows[:2]
    got = bitpack.token_table(
        spark.createDataFrame(rows, SCHEMA).repartition(5), PATH, file_ids=3000).collect()
    want = {}
    for doc_id, text, *_ in rows:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [0]
        raw = np.array(ids, "<u4").tobytes()
        want.setdefault(doc_id, []).append((len(ids), zlib.crc32(raw)))
    ordered = sorted(got, key=lambda r: r.start)
    assert [r.doc_id for r in ordered] == sorted(
        (r[0] for r in rows), key=lambda d: -1 if d is None else d)
    at = 0
    for r in ordered:
        assert r.start == at
        assert (r.n_tokens, r.ids_crc32) in want[r.doc_id]
        at += r.n_tokens
    empty = spark.createDataFrame([], SCHEMA)
    assert bitpack.token_table(empty, PATH).count() == 0


def test_spans_split_at_text_bounds():
    texts = pa.array(["ab", None, "", "cd e", "x" * 10])
    members = np.zeros(256, bool)
    members[97:123] = True
    spans = []
    for row, data, bounds in text_pieces(texts.slice(1), piece_bytes=4):
        starts, ends = runs(data, bounds, members)
        spans += [bytes(data[a:b]) for a, b in zip(starts, ends)]
    assert spans == [b"cd", b"e", b"x" * 10]
    data = np.frombuffer(b"word and word", np.uint8)
    names = hashes(data, np.array([0, 5, 9]), np.array([4, 8, 13]))
    assert names[0] == names[2] != names[1]


def brute_padding(tops, counts, buckets):
    from itertools import combinations
    best = None
    for size in range(min(buckets, len(tops))):
        for ends in combinations(range(len(tops) - 1), size):
            cost, at = 0, 0
            for e in (*ends, len(tops) - 1):
                cost += tops[e] * sum(counts[at:e + 1])
                at = e + 1
            best = cost if best is None else min(best, cost)
    return best


def test_boundaries_are_optimal():
    draw = np.random.default_rng(5)
    for buckets in (1, 2, 3, 4, 9) * 8:
        tops = np.unique(draw.integers(1, draw.choice([12, 500, 100_000]), 9)).tolist()
        counts = draw.integers(1, draw.choice([2, 50]), len(tops), endpoint=True).tolist()
        ends = packing.best_boundaries(tops, counts, buckets)
        assert len(ends) <= buckets and ends[-1] == tops[-1]
        cost = sum(int(c) * next(e for e in ends if e >= t) for t, c in zip(tops, counts))
        assert cost == brute_padding(tops, counts, buckets)


def test_boundaries_of_all_lengths_at_once():
    """Against the plain dynamic programme over some hundreds of lengths."""
    draw = np.random.default_rng(6)
    tops = np.unique(draw.integers(1, 60_000, 400))
    counts = draw.integers(1, 9, len(tops))
    before = np.concatenate([[0], np.cumsum(counts)])
    cost = tops * before[1:]
    for _ in range(15):
        cost = np.array([min([tops[j] * before[j + 1], *(cost[:j] + tops[j] * (before[j + 1] - before[1:j + 1]))])
                         for j in range(len(tops))])
    ends = packing.best_boundaries(tops.tolist(), counts.tolist(), 16)
    assert len(ends) == 16
    assert sum(int(c) * next(e for e in ends if e >= t) for t, c in zip(tops, counts)) == cost[-1]


def test_lengths_of_documents(spark):
    """Null, empty and very long texts, repeated rows and ids, columns with clashing names."""
    rows = [(1, None, "x"), (2, "", "x"), (None, "a b", "x"), (3, "word " * 60_000, "x"), (4, "a b", "x"), (4, "a b", "x")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, n_tokens string")
    got = packing.pack_documents(docs, PATH, buckets=2, budget=100).collect()
    sizes = sorted(r.n_tokens for r in got)
    assert sizes[:2] == [1, 1] and sizes[2] == sizes[4] and sizes[5] > 60_000
    # The longest text is padded to its own length.
    assert {r.pad_to for r in got} == {sizes[2], sizes[5]}


def test_pack(spark):
    lengths = [1, 1, 5, 255, 256, 257, 300, 511, 513, 1000, 70_000, 5, 5]
    rows = [(i if i != 3 else None, n, "clash") for i, n in enumerate(lengths)]
    frame = spark.createDataFrame(rows, "doc_id bigint, length int, bucket string")
    got = packing.pack(frame, "length", buckets=3, budget=2000).collect()
    assert len(got) == len(rows) and got[0].asDict().keys() == {
        "doc_id", "length", "bucket", "pad_to", "batch", "slot"}
    batches = {}
    for r in got:
        assert r.length <= r.pad_to
        batches.setdefault((r.bucket, r.batch), []).append(r)
    for (bucket, batch), rows in batches.items():
        assert sorted(r.slot for r in rows) == list(range(len(rows)))
        assert len(rows) == 1 or len(rows) * rows[0].pad_to <= 2000
        if (bucket, batch + 1) in batches:
            assert len(rows) == max(1, 2000 // rows[0].pad_to)
    assert packing.pack(frame.limit(0), "length").count() == 0
