import glob
import os

import duckdb
import pytest

from tickloom.llm.licenses import TEMPLATES, scan_licenses
from tickloom.llm.queries import OP7_SQL, QUERIES

DATA = "/root/testdata/sf0.01"

MIT, GPL = "Released under the MIT License", "licensed under the GNU General Public License, version 3."
FILES = [
    ("LICENSE", "MIT\n\n" + MIT), ("a/x.py", "code"), ("a/b/LICENSE.txt", GPL), ("a/b/y.py", "more"),
    ("a/b/c/d/z.py", None), ("a/b/c/d/own.py", "# " + MIT + "\nbody"), ("a/bb/q.py", ""),
    ("top.py", "text " * 40_000), (None, MIT), (None, "nothing"), ("a/x.py", "code"),
    ("e/COPYING", "hello"), ("e/f.py", "All rights reserved\nReleased under the MIT license")]


def scan(spark, files, **settings):
    frame = spark.createDataFrame(
        [(p, t, "clash", 1) for p, t in files], "path string, text string, license string, n int")
    return scan_licenses(frame, "path", **settings)


def test_inheritance(spark):
    got = {(r.path, r.text): r for r in scan(spark, FILES).collect()}
    assert len(got) == len(set(FILES))
    found = {p: (r.own_license, r.license, r.license_dir) for (p, t), r in got.items() if p}
    assert found["LICENSE"] == ("MIT", "MIT", None) and got[FILES[0]].own_line == 2
    assert found["a/x.py"] == (None, "MIT", "")
    assert found["a/b/LICENSE.txt"] == ("GPL-3.0", "GPL-3.0", None)
    assert found["a/b/y.py"] == found["a/b/c/d/z.py"] == (None, "GPL-3.0", "a/b")
    assert found["a/b/c/d/own.py"] == ("MIT", "MIT", None)
    assert found["a/bb/q.py"] == found["top.py"] == found["e/COPYING"] == (None, "MIT", "")
    assert found["e/f.py"][0] in ("LicenseRef-Reserved", "MIT")
    assert got[(None, MIT)].license == "MIT" and got[(None, "nothing")].license is None
    assert scan(spark, FILES).count() == len(FILES)


def test_every_template_states_itself(spark):
    files = [(f"{i}/f", notice) for i, (_, notice) in enumerate(TEMPLATES)]
    got = {r.path: (r.own_license, round(r.own_score, 6)) for r in scan(spark, files).collect()}
    assert got == {f"{i}/f": (name, 1.0) for i, (name, _) in enumerate(TEMPLATES)}


def test_no_rows(spark):
    assert scan(spark, []).count() == 0


def test_common_words_weigh_little_however_many_files(spark):
    line = "This work is licensed under the GNU General Public License, version 3."
    files = [(f"{i}/f", f"this work is number {i}") for i in range(3000)] + [("own/f", line)]
    found = scan(spark, files).where("own_license IS NOT NULL").collect()
    assert [(r.path, r.own_license) for r in found] == [("own/f", "GPL-3.0")] and found[0].own_score > 0.9


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
def test_query_counts_the_frequency_of_every_word(spark):
    connection = duckdb.connect()
    for path in glob.glob(f"{DATA}/documents.parquet"):
        connection.execute(f"CREATE VIEW documents AS SELECT * FROM '{path}'")
    result = connection.execute(OP7_SQL)
    names = [d[0] for d in result.description]
    got = [tuple(r[c] for c in names) for r in QUERIES["op7_license_inheritance"](spark, DATA).collect()]
    assert got and sorted(map(str, got)) == sorted(map(str, result.fetchall()))
