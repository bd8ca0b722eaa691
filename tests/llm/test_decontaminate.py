import hashlib
import re

import pytest

from tickloom.llm.decontaminate import decontaminate

WORD = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
TEN = "one two three four five six seven eight nine ten"
ITEMS = [(1, f"{TEN} eleven"), (2, "Short ITEM"), (3, None), (4, "..."), (None, "no id here"),
         (5, TEN.upper()), (5, TEN.upper()), (10, "Straße café")]
DOCS = [(0, f"Before. {TEN}, eleven after"), (1, "a short item, and short\nitem"), (2, None), (3, ""),
        (4, "one two three four five six seven eight nine"), (5, "STRASSE straße CAFÉ café"),
        (6, "x " * 60_000 + TEN), (7, "nothing"), (7, "nothing"), (None, "short item"),
        (8, f"short {TEN} item tail")]


def words(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return WORD.findall(lowered)


def brute(text):
    own, hit, items = words(text), set(), set()
    for item, body in ITEMS:
        other = words(body)
        size = min(10, len(other))
        if item is None or not size:
            continue
        for k in range(len(other) - size + 1):
            for at in range(len(own) - size + 1):
                if own[at:at + size] == other[k:k + size]:
                    hit.update(range(at, at + size))
                    items.add(str(item))
    sha = hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
    return len(own), len(hit), len(items), sha, bool(hit)


@pytest.mark.parametrize("bound", [100_000, 0])
def test_against_brute_force(spark, bound):
    docs = spark.createDataFrame(
        [(i, t, 1, "x") for i, t in DOCS], "doc_id bigint, text string, n_hit int, items string")
    items = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    got = decontaminate(docs, items, broadcast_windows=bound, cleaned=True).collect()
    assert got[0].asDict().keys() == {"doc_id", "text", "n_hit", "items", "__found"}
    found = sorted((str(r.doc_id), r.text or "", *r["__found"][:5]) for r in got)
    assert found == sorted((str(i), t or "", *brute(t)) for i, t in DOCS)
    for r in got:
        clean = r["__found"]["text"]
        assert (clean is None) == (not r["__found"]["contaminated"])
        if clean is not None:
            assert not brute(clean)[4]
    by_id = {r.doc_id: r["__found"]["text"] for r in got}
    assert by_id[0] == "Before. after"
    assert by_id[8] == "tail"  # the first cut brings together a window


def test_empty_tables(spark):
    docs = spark.createDataFrame(DOCS, "doc_id bigint, text string")
    items = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    assert decontaminate(docs.limit(0), items).count() == 0
    got = decontaminate(docs, items.limit(0)).collect()
    assert len(got) == len(DOCS) and not any(r["__found"]["contaminated"] for r in got)
