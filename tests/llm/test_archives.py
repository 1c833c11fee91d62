import hashlib
import io

import pytest

from cellgrid.llm import archives


@pytest.mark.parametrize("version", [1, 2])
def test_pages_round_trip(spark, version):
    big, big2 = "x" * 1000, "é" * 700
    rows = [(1, "http://a/", big), (2, "http://a/ b\n", big), (9, None, big), (3, "", None), (4, "http://b/", ""), (5, "u", "short"), (6, "u", "short"), (7, "u", big2), (8, "u", big2), (None, "n", "z" * 2000), (None, "n", "HTTP/1.1 200\r\n\r\nx")]
    pages = spark.createDataFrame([(*r, 7) for r in rows], "page_id long, url string, html string, key int").repartition(3)
    got = {}
    for r in archives.round_trip(pages, version).collect():
        got.setdefault(r["key"], []).append(r)
    assert sum(map(len, got.values())) == len(rows)
    best = {big: 9, big2: 8}
    for key, _, html in rows:
        if key is None:
            continue
        data, r = (html or "").encode(), got[key][0]
        to = best.get(html) if len(data) >= 1000 else None
        revisit = to is not None and to != key
        assert (r["payload_bytes"], r["payload_digest"]) == (len(data), hashlib.sha1(data).hexdigest())
        assert (r["record_type"], r["refers_to"]) == (("revisit", to) if revisit else ("response", None))
        assert r["date"] == "2008-01-02T03:04:05Z"
    assert sorted(r["payload_bytes"] for r in got[None]) == [17, 2000]


def test_empty_table(spark):
    assert archives.round_trip(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_files_roll_over(spark, monkeypatch):
    files = archives.Members("/tmp/cellgrid-none", "x")
    sinks = []

    class Sink(io.BytesIO):
        pass

    monkeypatch.setattr(archives, "create", lambda path: sinks.append(Sink()) or sinks[-1])
    monkeypatch.setattr(archives, "FILE_BYTES", 100)
    for i in range(20):
        files.add(hashlib.sha512(str(i).encode()).digest() * 2)
    assert files.manifest().num_rows == len(sinks) > 1


def test_arc_parsing():
    for version in (1, 2):
        # Content that looks like a header line is skipped by the declared length.
        blocks = [b"a\nhttp://x/ 0.0.0.0 20080102030405 text/html 3\nabc", b"", b"HTTP/1.1 200 OK\r\n\r\n\xff\x00"]
        data = archives.arc_head("f", version, "20080102030405") + b"".join(archives.arc_record("http://x/", "20080102030405", b, version) for b in blocks)
        found = list(archives.read_arc(io.BytesIO(data)))
        assert [b for _, b in found] == blocks
        assert set(found[0][0]) == set(archives.ARC_FIELDS[version])
    with pytest.raises(ValueError):
        list(archives.read_arc(io.BytesIO(data[:-3])))
    with pytest.raises(ValueError):
        list(archives.read_arc(io.BytesIO(b"http://x/ 0 1 t 4\n1 0 x")))
    assert archives.warc_date("1997") == "1997-01-01T00:00:00Z"
