import gzip
import hashlib

import pytest

from trade_insights.llm import warc


def test_round_trip_of_pages(spark):
    big, other = "<p>été</p>" * 200, "x" * 999
    pages = [(i, f"http://a.example/{i} b", big) for i in range(30)] + [(100, None, big + "!"), (101, "http://b.example/", big + "!"), (50, "u", None), (51, "u", ""), (52, "u", other), (53, "u", other), (54, "u", "WARC/1.1\r\n\r\n" * 200), (55, "u", "\r\n\r\nHTTP/1.1\n\n" * 99), (29, "again", big), (60, "u", "y" * 3_000_000)]
    df = spark.createDataFrame([(*p, "z", 1) for p in pages], "page_id long, url string, html string, kind string, key int")
    rows = warc.round_trip(df).collect()
    assert all(r.digest_holds for r in rows)
    got = sorted((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to or -1) for r in rows)
    last = {}
    for i, _, html in pages:
        last[html or ""] = max(i, last.get(html or "", i))
    want = []
    for i, _, html in pages:
        data = (html or "").encode()
        again = len(data) >= 1000 and i < last[html or ""]
        want.append((i, len(data), hashlib.sha1(data).hexdigest(), "revisit" if again else "response", last[html or ""] if again else -1))
    assert got == sorted(want)


def test_archives_hold_few_records(spark, monkeypatch, tmp_path):
    """A hot payload, and many empty pages, in one task."""
    monkeypatch.setattr(warc, "ARCHIVE_RECORDS", 50)
    pages = [(i, "u", "hot " * 500 if i % 2 else "") for i in range(400)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").coalesce(1)
    warc.written(warc.revisited(warc.converted(warc.arc_files(df))).coalesce(1), str(tmp_path / "out"))
    files = sorted((tmp_path / "out").glob("part-*"))
    sizes = [sum(1 for _ in warc.warc_records(f.read_bytes())) for f in files]
    assert max(sizes) <= 50 and sum(sizes) == 401 and len(files) == 9
    rows = warc.round_trip(df).collect()
    assert sorted((r.page_id, r.record_type, r.refers_to) for r in rows) == [(i, "revisit" if i % 2 and i < 399 else "response", 399 if i % 2 and i < 399 else None) for i in range(400)]


def test_pages_without_key_are_kept(spark):
    df = spark.createDataFrame([(None, "u", "q" * 2000), (None, "u", "q" * 2000)], "page_id long, url string, html string")
    rows = warc.round_trip(df).collect()
    assert [(r.page_id, r.payload_bytes, r.record_type) for r in rows] == [(None, 2000, "response")] * 2


def record(line, block):
    return f"{line} {len(block)}\n".encode() + block + b"\n"


ARC1 = (record("filedesc://old.arc 0.0.0.0 19970101000000 text/plain", b"1 0 Org\nURL IP-address Archive-date Content-type Archive-length\n\n") + b"\n"
        + record("http://x.example/a b 1.2.3.4 19970102030405 text/html", b"HTTP/1.0 200 OK\r\nX-Page-Id: 7\r\n\r\n\xff\xfe\r\n\r\nbody")
        + record("dns:x.example 1.2.3.4 199701 text/dns", b"1.2.3") + b"\n" + record("ftp://x.example/f 1.2.3.4 19970102030405 text/plain", b"abcd"))


def test_versions_and_types_of_arc():
    found = list(warc.arc_records(ARC1))
    assert [f["URL"] for _, f, _, _ in found] == ["filedesc://old.arc", "http://x.example/a b", "dns:x.example", "ftp://x.example/f"]
    assert all(whole for *_, whole in found)
    assert warc.iso(found[2][1]["Archive-date"]) == "1997-01-01T00:00:00Z" and warc.iso("19970102030405") == "1997-01-02T03:04:05Z"
    two = b"filedesc://n.arc 0 20010101000000 text/plain 200 - - 0 n.arc 9\n2 0 Org\nX\n\nhttp://y/ 0 20010101000000 text/html 200 - - 99 n.arc 3\nabc\n"
    assert [(f.get("Filename"), b) for _, f, b, _ in warc.arc_records(two)] == [("n.arc", b"2 0 Org\nX"), ("n.arc", b"abc")]
    assert list(warc.arc_records(gzip.compress(ARC1))) == found
    assert [w for *_, w in warc.arc_records(ARC1[:-4])][-1] is False
    with pytest.raises(ValueError):
        list(warc.arc_records(ARC1 + b"junk\n"))


def test_converted_records_read_back(spark, tmp_path):
    files = spark.createDataFrame([("old.arc", bytearray(ARC1)), ("cut.arc", bytearray(ARC1[:-4])), (None, None)], "name string, content binary")
    path = str(tmp_path / "out")
    warc.written(warc.revisited(warc.converted(files)), path)
    rows = warc.read_back(spark, path).collect()
    assert sorted(r.kind for r in rows) == ["resource", "resource", "response", "response", "response", "response", "warcinfo", "warcinfo"]
    assert all(r.digest_holds for r in rows) and len({r.record_id for r in rows}) == 8
    assert [r.payload_bytes for r in rows if r.key == 7] == [10, 10]
    with_key = next(r for r in rows if r.key == 7)
    assert with_key.sha1 == hashlib.sha1(b"\xff\xfe\r\n\r\nbody").hexdigest() and with_key.uri == "http://x.example/a b"


def test_empty_table(spark):
    df = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.round_trip(df).collect() == []


def test_pages_with_urls_of_other_records(spark):
    pages = [(1, "dns:x.example", "one"), (2, "filedesc://x.arc", "2 0 Org"), (3, "http://x.example/", "three"), (4, "filedesc://", "")]
    rows = warc.round_trip(spark.createDataFrame(pages, "page_id long, url string, html string").coalesce(1)).collect()
    assert sorted((r.page_id, r.payload_bytes, r.payload_digest, r.digest_holds) for r in rows) == [(i, len(t), hashlib.sha1(t.encode()).hexdigest(), True) for i, _, t in pages]
