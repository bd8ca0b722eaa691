import random

import corpus_pipeline
from tickloom.llm.line_dedup import EDITS, WITNESSES, dedup_lines, letter_counts, near_pairs, remaining
from tickloom.llm.queries import QUERIES
from pyspark.sql import functions as F

SCHEMA = "doc_id bigint, text string, line string, name int"


def distance(a, b, most=2):
    if abs(len(a) - len(b)) > most:
        return most + 1
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def brute(docs, least=32):
    last = 1 << 63
    first = {}
    for doc, text in docs:
        for line in (text or "").split("\n") if text is not None else []:
            if len(line) >= least:
                first[line] = min(first.get(line, last), last - 1 if doc is None else doc)
    ordered = sorted(first, key=lambda x: (first[x], x.encode()))
    gone = {b for i, b in enumerate(ordered) if any(distance(a, b) <= 2 for a in ordered[:i])}
    out = []
    for doc, text in docs:
        removed, seen = [], set()
        for k, line in enumerate(text.split("\n") if text is not None else []):
            own = last - 1 if doc is None else doc
            if len(line) >= least and (line in gone or first[line] != own or line in seen):
                removed.append(k)
            seen.add(line)
        out.append((doc, text, removed))
    return out


def edited(draw, line):
    chars = list(line)
    for _ in range(draw.randint(1, 3)):
        at = draw.randrange(len(chars))
        draw.choice([lambda: chars.insert(at, "ü"), lambda: chars.pop(at),
                     lambda: chars.__setitem__(at, "#")])()
    return "".join(chars)


def run(spark, docs):
    frame = spark.createDataFrame([(*d, "clash", 1) for d in docs], SCHEMA)
    marked = dedup_lines(frame)
    assert marked.columns == [*frame.columns, "__lines"]
    return marked.withColumn("rest", remaining(F.col("text"), F.col("__lines.removed"))).collect()


def test_against_brute_force(spark):
    draw = random.Random(4)
    base = ["".join(draw.choice("abcdefgh éü") for _ in range(draw.randint(28, 90)))
            for _ in range(40)]
    docs = []
    for i in range(60):
        lines = [draw.choice(base) for _ in range(4)] + [edited(draw, draw.choice(base))]
        draw.shuffle(lines)
        docs.append((draw.randrange(40), "\n".join(lines)))
    docs += [(None, base[0] + "\n" + base[1]), (100, None), (101, ""), (102, "\n\nshort\nshort"),
             (103, "y" * 50_000), (104, "y" * 300), (105, "y" * 299 + "z"), docs[3]]
    got = run(spark, docs)
    assert sorted((str(r.doc_id), str(r.text), r["__lines"].removed) for r in got) == sorted(
        (str(d), str(t), k) for d, t, k in brute(docs))
    for r in got:
        lines = r.text.split("\n") if r.text is not None else []
        assert r["__lines"].n_lines == len(lines)
        gone = set(r["__lines"].removed)
        if r.text is None:
            assert r.rest is None
        else:
            assert r.rest == "\n".join(x for k, x in enumerate(lines) if k not in gone)


def test_no_rows(spark):
    assert dedup_lines(spark.createDataFrame([], SCHEMA)).count() == 0


def test_one_line_in_all_documents(spark):
    line = "the same line stands in every document here"
    got = run(spark, [(i, f"{line}\nown {i}") for i in range(500)])
    assert [r.doc_id for r in got if not r["__lines"].removed] == [0]
    assert {r.rest for r in got if r.doc_id} == {f"own {i}" for i in range(1, 500)}


def test_copies_of_short_lines(spark):
    draw = random.Random(6)
    base = ["".join(draw.choice("abcdefgh é") for _ in range(draw.choice([1, 2, 5, 20, 31, 32, 33, 60])))
            for _ in range(50)] + ["", " ", "\t \r"]
    docs = [(draw.randrange(30), "\n".join(draw.choice(base) for _ in range(6))) for _ in range(40)]
    docs += [(None, "short\nshort"), (200, "short\n\n"), (201, "shorx\n\n \n "), (202, None), (203, "")]
    frame = spark.createDataFrame([(*d, "clash", 1) for d in docs], SCHEMA)
    got = dedup_lines(frame, short_copies=True).collect()
    last, first, want = 1 << 63, {}, []
    for doc, text in docs:
        for line in (text or "").split("\n"):
            first[line] = min(first.get(line, last), last - 1 if doc is None else doc)
    for doc, text, removed in brute(docs):
        seen, gone = set(), set(removed)
        for k, line in enumerate(text.split("\n") if text is not None else []):
            own = last - 1 if doc is None else doc
            if line.strip() and len(line) < 32 and (first[line] != own or line in seen):
                gone.add(k)
            seen.add(line)
        want.append((str(doc), str(text), sorted(gone)))
    assert sorted((str(r.doc_id), str(r.text), r["__lines"].removed) for r in got) == sorted(want)


def test_query_takes_copies_of_short_lines(spark, tmp_path):
    spark.createDataFrame([(1, "a line\n\nown"), (2, "a line\n\nother")], "doc_id bigint, text string").write.parquet(
        f"{tmp_path}/documents.parquet")
    got = QUERIES["op10_near_line_dedup"](spark, str(tmp_path)).collect()
    assert {r.doc_id: r.removed for r in got} == {1: [], 2: [0]}
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = corpus_pipeline.drop_repeated_lines(spark, docs, str(tmp_path)).collect()
    assert {r.doc_id: r.text for r in kept} == {1: "a line\n\nown", 2: "\nother"}


def of_one_kind(draw, count, digits):
    """Lines that share all but a number, some with a further edit or two."""
    out = []
    for _ in range(count):
        number = "".join(draw.choice("0123456789") for _ in range(digits))
        line = f"the station reported number {number} at its usual hour"
        for _ in range(draw.choice([0, 0, 0, 1, 1, 2])):
            line = edited(draw, line) if draw.random() < 0.5 else line + "."
        out.append(line)
    return out


def test_lines_of_one_kind_against_brute_force(spark):
    draw = random.Random(12)
    lines = of_one_kind(draw, 90, 6) + of_one_kind(draw, 60, 3) + ["=" * n for n in range(32, 60, 2)] + [
        "=" * draw.randint(5, 30) + str(draw.randint(100, 999)) + "=" * 25 for _ in range(25)]
    docs = [(draw.randrange(120), "\n".join(draw.sample(lines, 3))) for _ in range(70)]
    frame = spark.createDataFrame([(*d, "clash", 1) for d in docs], SCHEMA)
    want = sorted((d, t, k) for d, t, k in brute(docs))
    got = dedup_lines(frame, witnesses=1).collect()
    assert sorted((r.doc_id, r.text, r["__lines"].removed) for r in got) == want


def test_lines_that_meet_grow_with_a_group_and_not_its_square(spark):
    draw = random.Random(13)
    lines = sorted({f"the station reported number {draw.randrange(10 ** 12):012d} at its usual hour"
                    for _ in range(1500)})
    frame = spark.createDataFrame([(x, i) for i, x in enumerate(lines)], "line string, first bigint").withColumns({
        "chars": F.length("line"), "letters": letter_counts(F.col("line")), "name": F.xxhash64("line")})
    # Each line looks for three segments and meets the earliest under them, and is marked under each.
    assert near_pairs(frame, EDITS).count() <= 3 * (WITNESSES + 1) * len(lines)
