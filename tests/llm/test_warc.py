"""Archives of captures: against plain SQL, an outside reading of the format, and records of other writers."""

from __future__ import annotations

import gzip
import hashlib
import io
import re

import duckdb
import pytest

from motionspark.llm import warc

ROWS = "page_id long, url string, html string"
LONG = "<p>é日𝒳</p>\r\n\r\nWARC/1.1\r\n" * 60


def rows_of(frame):
    key = lambda r: tuple((x is not None, x) for x in r)
    return sorted((tuple(r) for r in frame.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=key)


def pages():
    out = [(i, f"http://h/{i}", LONG if i % 3 else f"{LONG}{i % 5}") for i in range(40)]
    return [*out, (100, None, None), (101, "u", ""), (102, "a b\nc\té", "x" * 999), (103, "u", "x" * 999), (104, "u", "y" * 1000), (105, "u", "y" * 1000), (None, "u", LONG), (None, "u", "short"), (-5, "u", "z" * 5_000_000)]


def test_the_query_against_sql(spark, tmp_path):
    spark.createDataFrame(pages(), ROWS).selectExpr("*", "1 AS size", "'x' AS digest", "2 AS top").write.parquet(f"{tmp_path}/pages.parquet")
    got = rows_of(warc.op13_warc_captures(spark, str(tmp_path)))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    want = con.execute(f"SELECT page_id, payload_bytes, payload_digest, record_type, refers_to FROM ({warc.OP13_SQL})").fetchall()
    assert got == sorted(want, key=lambda r: tuple((x is not None, x) for x in r))
    assert sum(r[3] == "revisit" for r in got) == 26 + 9 + 1


def test_repeated_rows_and_empty_tables(spark):
    same = [(7, "u", LONG)] * 5 + [(3, "u", LONG)] * 2
    got = rows_of(warc.archive_pages(spark, spark.createDataFrame(same, ROWS), False).selectExpr("page_id", "response.payload_bytes", "response.payload_digest", "response.warc_type AS record_type", "refers_to"))
    assert [(r[0], r[3], r[4]) for r in got] == [(3, "revisit", 7)] * 2 + [(7, "response", None)] * 5
    assert warc.archive_pages(spark, spark.createDataFrame([], ROWS)).count() == 0


def test_archives_are_well_formed(spark, tmp_path):
    """Read by a plain parser: a member a record, identifiers unique, blocks as long as they say, payloads whole."""
    manifest = warc.write_archives(spark.createDataFrame(pages(), ROWS), f"file://{tmp_path}/w", most=2_000).collect()
    assert len(manifest) > 4
    ids, payloads = set(), {}
    for row in manifest:
        data = gzip.decompress(open(row.path.removeprefix("file://"), "rb").read())
        at = n = 0
        while at < len(data):
            head, _, rest = data[at:].partition(b"\r\n\r\n")
            fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
            size = int(fields["Content-Length"])
            assert head.startswith(b"WARC/1.1\r\n") and rest[size : size + 4] == b"\r\n\r\n"
            assert fields["WARC-Record-ID"] not in ids
            ids.add(fields["WARC-Record-ID"])
            if fields["WARC-Type"] == "response":
                payload = rest[:size].partition(b"\r\n\r\n")[2]
                payloads[hashlib.sha1(payload).hexdigest()] = payload
            assert re.fullmatch(r"[\x21-\x7E]*", fields.get("WARC-Target-URI", ""))
            at, n = at + len(head) + 4 + size + 4, n + 1
        assert n == row.n_records
    assert set(payloads.values()) == {(h or "").encode() for _, _, h in pages()}


@pytest.mark.parametrize("packed", [True, False])
def test_payloads_come_back(spark, tmp_path, packed):
    folder = f"file://{tmp_path}/w"
    manifest = warc.write_archives(spark.createDataFrame(pages(), ROWS), folder)
    if not packed:
        for row in manifest.collect():
            path = row.path.removeprefix("file://")
            data = gzip.decompress(open(path, "rb").read())
            open(path, "wb").write(data)
    got = warc.assemble(warc.read_archives(manifest)).collect()
    assert len(got) == len(pages())
    assert all(r.n_response == r.n_request == r.n_metadata == 1 for r in got)
    assert {bytes(r.response.payload) for r in got if r.response.warc_type == "response"} == {(h or "").encode() for _, _, h in pages()}
    assert all(r.request.http_line.startswith("GET ") and r.request.target_uri == r.response.target_uri for r in got)


def test_records_of_other_writers(spark, tmp_path):
    """Identifiers on either side, a metadata record that names the request, orphans, folded headers."""
    made = [
        warc.record("response", "<r1>", "d", b"HTTP/1.1 200 OK\r\nA: b\r\n  c\r\n\r\nbody", "application/http; msgtype=response"),
        warc.record("request", "<q1>", "d", b"GET / HTTP/1.1\r\n\r\n", "application/http; msgtype=request", Concurrent_To="<r1>"),
        warc.record("metadata", "<m1>", "d", b"via: x\r\n", "application/warc-fields", Concurrent_To="<q1>"),
        warc.record("metadata", "<m0>", "d", b"via: y\r\n", "application/warc-fields", Concurrent_To="<r1>"),
        warc.record("request", "<q2>", "d", b"GET /2 HTTP/1.1\r\n\r\n", "application/http; msgtype=request"),
        warc.record("response", "<r2>", "d", b"HTTP/1.1 404 No\r\n\r\n", "application/http; msgtype=response", Concurrent_To="<q2>"),
        warc.record("request", "<q3>", "d", b"GET /3 HTTP/1.1\r\n\r\n", "application/http; msgtype=request", Concurrent_To="<gone>"),
        warc.record("resource", "<s1>", "d", b"plain", "text/plain"),
    ]
    (tmp_path / "a.warc").write_bytes(b"".join(made))
    got = {r.capture_id: r for r in warc.assemble(warc.read_archives(spark.createDataFrame([(f"file://{tmp_path}/a.warc",)], "path string"))).collect()}
    assert set(got) == {"<r1>", "<r2>", "<q3>", "<s1>"}
    assert (got["<r1>"].request.record_id, got["<r1>"].metadata.fields, got["<r1>"].n_metadata) == ("<q1>", {"via": "y"}, 2)
    assert got["<r1>"].response.fields == {"a": "b c"} and bytes(got["<r1>"].response.payload) == b"body"
    assert got["<r2>"].request.record_id == "<q2>" and got["<r2>"].response.payload_bytes == 0
    assert got["<q3>"].response is None and got["<q3>"].request.http_line == "GET /3 HTTP/1.1"
    assert bytes(got["<s1>"].response.payload) == b"plain"


@pytest.mark.parametrize("cut", [1, 50, 300])
def test_broken_archives_raise(cut):
    whole = warc._packed(warc.record("resource", "<s1>", "d", bytes(range(256)) * 20, "text/plain"))
    with pytest.raises((ValueError, warc.zlib.error)):
        list(warc.parse(io.BytesIO(whole[:-cut])))
    wrong = warc.record("response", "<r>", "d", b"HTTP/1.1 200 OK\r\n\r\nbody", "application/http", Payload_Digest="sha1:" + "A" * 32)
    with pytest.raises(ValueError):
        list(warc.parse(io.BytesIO(wrong)))
