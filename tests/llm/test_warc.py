import base64
import gzip
import hashlib

from tickloom.llm import files, warc

SCHEMA = "page_id bigint, url string, html string, payload string, offset int"


def digest(text):
    return base64.b32encode(hashlib.sha1(text.encode()).digest()).decode()


def rows():
    pages = [(i, f"http://host/{i}", f"<p>{i % 9}</p>" * (i % 5), "clash", 0) for i in range(200)]
    pages += [(500, None, None, "", 0), (501, "http://a b\r\nX: 1", "", "", 0),
              (502, "u", "\x1f\x8b\x08" * 50, "", 0), (503, "u", "é" * 100_000, "", 0),
              (None, "u", "<p>1</p>", "", 0), (None, "u", "only here", "", 0)]
    return pages + pages[7:9]


def test_round_trip_in_small_ranges(spark):
    pages = rows()
    got = warc.archive_table(
        spark.createDataFrame(pages, SCHEMA).repartition(3), range_bytes=700, file_bytes=5000,
    ).collect()
    assert len(got) == len(pages)
    key = lambda p: (p is None, p)
    first = {}
    for page_id, _, html, *_ in pages:
        first[html or ""] = min(first.get(html or "", page_id), page_id, key=key)
    want = {}
    for page_id, _, html, *_ in pages:
        body = html or ""
        want.setdefault(page_id, []).append((len(body.encode()), digest(body), first[body]))
    responses = {}
    for r in got:
        [owner] = {f for n, d, f in want[r.page_id] if (n, d) == (r.payload_bytes, r.payload_digest)}
        if r.record_type == "response":
            assert r.refers_to is None and r.page_id == owner
            responses[r.payload_digest] = responses.get(r.payload_digest, 0) + 1
        else:
            assert r.refers_to == owner
    repeated = {digest(html) for _, _, html, *_ in pages[7:9]}  # these pages are first
    assert {d: n for d, n in responses.items() if n != 1} == dict.fromkeys(repeated, 2)
    assert len(responses) == len(first)


def test_small_payloads_are_never_revisits(spark):
    pages = [(1, "u", "ab", "", 0), (2, "u", "ab", "", 0), (3, "u", "abcdef", "", 0),
             (4, "u", "abcdef", "", 0)]
    got = warc.archive_table(spark.createDataFrame(pages, SCHEMA), min_bytes=5).collect()
    assert sorted((r.page_id, r.record_type, r.refers_to) for r in got) == [
        (1, "response", None), (2, "response", None), (3, "response", None), (4, "revisit", 3)]


def test_no_rows(spark):
    assert warc.archive_table(spark.createDataFrame([], SCHEMA)).count() == 0


def test_payloads_and_standard_gzip(spark, tmp_path):
    pages = spark.createDataFrame([(1, "http://x/", "body one", "", 0)], SCHEMA)
    manifest = warc.write_archives(pages, f"file://{tmp_path}")
    path = manifest.first()["path"]
    content = gzip.decompress(open(path.removeprefix("file://"), "rb").read())
    assert content.startswith(b"WARC/1.1\r\nWARC-Type: response\r\n")
    assert content.endswith(b"\r\n\r\nbody one\r\n\r\n")
    row = warc.read_archives(manifest, with_payload=True).first()
    assert (bytes(row.payload), row.url, row.offset) == (b"body one", "http://x/", 0)


def test_every_range_owns_the_records_that_start_in_it(tmp_path):
    members = [warc.record(i, "u", bytes(range(256)) * (i % 4) + b"\x1f\x8b\x08", "D", "2024", "r")
               for i in range(30)]
    path = f"file://{tmp_path}/a.warc.gz"
    with files.written(path) as stream:
        stream.write(b"".join(members))
    starts = [sum(map(len, members[:i])) for i in range(30)]
    for step in (1 + len(members[0]) // 2, 333, 10**6):
        found = [r[6] for low in range(0, sum(map(len, members)), step)
                 for r in warc.records_in(path, low, low + step)]
        assert found == starts
