import gzip
import hashlib
import io

from examlake.llm import queries, warc
from examlake.llm.common import new_path

SCHEMA = "page_id long, url string, html string, id string, payload string"


def test_round_trip(spark):
    big = "<p>é日本\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\n" + "x" * 1200
    rows = [(1, "http://a.example/x y", big), (2, "http://a.example/2", big), (3, None, None), (4, "https://b.example", ""), (5, "u", "y" * 999), (6, "u", "y" * 999), (9, "http://c/\r\nX: 1", big), (7, "u", "z" * 1000), (None, "u", "lost")]
    path = new_path(spark, "warc")
    warc.write(spark.createDataFrame([(*r, "q", "r") for r in rows], SCHEMA), path)
    records = warc.read(spark, path)
    assert records.groupBy("type").count().collect() and records.count() == 3 * 8
    got = {r["metadata"]["fields"]: r for r in warc.captures(records).collect()}
    assert len(got) == 8
    for page, _, html in rows[:-1]:
        r = got[f"capture: {page}\r\n"]
        want = (html or "").encode()
        assert r["payload_bytes"] == len(want) and r["digest"] == hashlib.sha1(want).hexdigest()
        assert r["type"] == ("revisit" if page in (1, 2) else "response")
        assert r["refers_to"] == (got["capture: 9\r\n"]["id"] if page in (1, 2) else None)
        assert r["request"]["head"].startswith("GET ") and r["response"]["head"].startswith("HTTP/1.1 200 OK")
        if r["type"] == "response":
            assert bytes(r["response"]["payload"]) == want


def test_keys_that_repeat_and_sizes(spark, monkeypatch):
    monkeypatch.setattr(warc, "FILES", ((1000, 3000), (5000, 48), (1 << 62, 3)))
    rows = [(1, "u", "a" * 1500), (1, "u", "b" * 1500), (1, "v", "a" * 1500), (2, "u", "a" * 1500), (2, "u", "a" * 1500), (3, "u", "c" * 9000), (3, "u", "short")]
    path = new_path(spark, "warc")
    warc.write(spark.createDataFrame([(k, u, h, "", "") for k, u, h in rows], SCHEMA), path)
    got = warc.captures(warc.read(spark, path)).collect()
    assert sorted((r["metadata"]["fields"].strip(), r["uri"], r["type"], r["payload_bytes"]) for r in got) == [
        ("capture: 1", "u", "response", 1500), ("capture: 1", "u", "revisit", 1500), ("capture: 1", "v", "revisit", 1500),
        ("capture: 2", "u", "response", 1500), ("capture: 3", "u", "response", 5), ("capture: 3", "u", "response", 9000),
    ]


def test_records_of_another_writer(spark, tmp_path):
    body = b"HTTP/1.1 200 OK\r\n\r\nhello"
    record = b"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:x>\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n" % (len(body), body)
    info = b"WARC/1.0\r\nWARC-Type: warcinfo\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    (tmp_path / "a.warc").write_bytes(info + record)
    buffer = io.BytesIO()
    for x in (info, record):  # a gzip member for each record
        buffer.write(gzip.compress(x))
    (tmp_path / "b.warc.gz").write_bytes(buffer.getvalue())
    got = warc.captures(warc.read(spark, str(tmp_path))).collect()
    assert [(r["id"], bytes(r["response"]["payload"]), r["request"], r["payload_bytes"]) for r in got] == [("<urn:x>", b"hello", None, 5)]


def test_empty_table_and_query(spark, sf):
    path = new_path(spark, "warc")
    warc.write(spark.createDataFrame([], SCHEMA), path)
    assert warc.captures(warc.read(spark, path)).count() == 0
    pages = {r["page_id"]: r["html"] or "" for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    got = queries.op6_warc(spark, sf).collect()
    assert {r["page_id"]: r["payload_digest"] for r in got} == {k: hashlib.sha1(v.encode()).hexdigest() for k, v in pages.items()} and len(got) == len(pages)
