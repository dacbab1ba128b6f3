"""Operator 13: web captures as WARC archives, written, read back and put together again.

A capture is a transaction of three records: the response (or, where its payload is in the archives already, a
revisit that refers to the one response that holds it), the request and a metadata record, which name the first as the
record they are concurrent to. Archives are sequences of gzip members, one a record. The reader gives a row a record;
:func:`assemble` joins them through the identifiers, whichever side names the other and also where a metadata record
names the request, into one nested row a capture.

Payloads of equal digest and of at least ``LEAST_BYTES`` bytes are written once, by the row with the largest id. Payloads are
shuffled once, by digest, those of a hot digest to several tasks; a revisit's length is that of its HTTP header.

Defined cases: null html is an empty payload; a null id is smaller than any other and comes back null; rows repeated under
the largest id of their group are all responses; a null url gives no target, and what no URI may hold is
percent-encoded in it; payloads of any length are written whole; an empty table gives no archives and no rows; further
columns are ignored. Requests and metadata that no response belongs to are captures without one; of several requests
or metadata records of a capture the one of the least identifier stays, and their number is given. A broken archive raises.
"""

from __future__ import annotations

import base64
import hashlib
import io
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import dealt_join, fresh_path, saved, small_batches

LEAST_BYTES = 1000
#: An archive ends with the first capture beyond this size.
ARCHIVE_BYTES = 1 << 28
READ_BYTES = 1 << 15
LEVEL = 5
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"  # fixed value of the format
MAINS = ("response", "revisit", "resource")
MANIFEST = "path string, n_records long, n_bytes long"
RECORD = (
    "warc_type string, record_id string, concurrent_to array<string>, date string, target_uri string, refers_to string, "
    "content_type string, http_line string, payload_bytes long, payload_digest string, fields map<string,string>, payload binary"
)
_RECORD = pa.schema(
    [(n, pa.string()) for n in ("warc_type", "record_id")]
    + [("concurrent_to", pa.list_(pa.string()))]
    + [(n, pa.string()) for n in ("date", "target_uri", "refers_to", "content_type", "http_line")]
    + [("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("fields", pa.map_(pa.string(), pa.string())), ("payload", pa.binary())]
)
_NOT_URI = re.compile(rb"[^\x21-\x7E]")


def _urn(value: uuid.UUID) -> str:
    return f"<urn:uuid:{value}>"


def response_id(digest: str) -> str:
    """The identifier of the response that revisits of this payload refer to."""
    return _urn(uuid.UUID(bytes=hashlib.sha256(f"response {digest}".encode()).digest()[:16], version=5))


def record(kind: str, record_id: str, date: str, block: bytes, content_type: str, **more: str | None) -> bytes:
    """One record; further headers by their names, with ``_`` for ``-``."""
    head = [("WARC-Type", kind), ("WARC-Record-ID", record_id), ("WARC-Date", date)]
    head += [(f"WARC-{k.replace('_', '-')}", v) for k, v in more.items() if v is not None]
    head += [("Content-Type", content_type), ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"


def capture(page_id: int | None, url: str | None, payload: bytes | None, size: int, digest: str, own: str, refers: str | None, date: str) -> list[bytes]:
    """The records of one capture; ``refers``: the response that holds the payload, if it is not this one."""
    uri = None if url is None else _NOT_URI.sub(lambda m: b"%%%02X" % m[0][0], url.encode()).decode()
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    sha1 = "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode()
    common = {"Target_URI": uri, "Payload_Digest": sha1}
    http = "application/http; msgtype=response"
    if refers is None:
        first = record("response", own, date, head + (payload or b""), http, **common)
    else:
        first = record("revisit", own, date, head, http, **common, Profile=PROFILE, Refers_To=refers)
    asked = f"GET {uri or '/'} HTTP/1.1\r\n\r\n".encode()
    fields = b"" if page_id is None else f"page-id: {page_id}\r\n".encode()
    return [
        first,
        record("request", _urn(uuid.uuid4()), date, asked, "application/http; msgtype=request", Concurrent_To=own, Target_URI=uri),
        record("metadata", _urn(uuid.uuid4()), date, fields, "application/warc-fields", Concurrent_To=own, Target_URI=uri),
    ]


def _packed(data: bytes) -> bytes:
    c = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return c.compress(data) + c.flush()


def write_archives(pages: DataFrame, folder: str, least: int = LEAST_BYTES, date: str = "1970-01-01T00:00:00Z", most: int = ARCHIVE_BYTES) -> DataFrame:
    """Write ``pages`` (page_id, url, html) as archives into ``folder`` (a URI); returns the manifest, a row an archive.

    An archive's name holds the task attempt, and only those of attempts that succeeded are in the manifest.
    """
    small_batches(pages.sparkSession)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce("html", F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("size", F.octet_length("payload")).withColumn("digest", F.sha1("payload"))
    counts = rows.filter(F.col("size") >= least).groupBy("digest", "page_id").agg(F.count("*").alias("m")).groupBy("digest")
    groups = counts.agg(F.sum("m").alias("n"), F.max("page_id").alias("top"), F.coalesce(F.max_by("m", "page_id"), F.sum("m")).alias("n_top"))
    groups = saved(groups.filter("n > 1").withColumn("shared", F.lit(True)), "payloads")
    known = dealt_join(rows, groups, "digest", groups.select("digest", "n"), "page_id", "left")
    holds, shared = F.col("page_id").eqNullSafe(F.col("top")), F.coalesce("shared", F.lit(False))
    payload = F.when(shared & ~holds, None).otherwise(F.col("payload")).alias("payload")
    columns = ("page_id", "url", payload, "size", "digest", shared.alias("shared"))
    tied = groups.filter("n_top > 1").select("digest", "top", "shared")
    if tied.limit(1).count():  # rows repeated under the largest id: one task names them, so that one of them is the response referred to
        again = rows.join(tied, (rows["digest"] == tied["digest"]) & holds).drop(tied["digest"]).repartition("digest")
        known = known.filter(~(shared & holds & (F.col("n_top") > 1))).select(*columns).union(again.select(*columns))
    else:
        known = known.select(*columns)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, out, path, n, size, named = TaskContext.get(), None, "", 0, 0, set()

        def done() -> pa.RecordBatch:
            out.close()
            return pa.RecordBatch.from_pydict({"path": [path], "n_records": [n], "n_bytes": [size]})

        for batch in batches:
            for row in batch.to_pylist():
                if out is None:
                    path = f"{folder}/captures-{task.partitionId():06d}-{task.taskAttemptId()}-{uuid.uuid4().hex[:8]}.warc.gz"
                    store, inner = fs.FileSystem.from_uri(path)
                    store.create_dir(inner.rpartition("/")[0], recursive=True)
                    out, n = store.open_output_stream(inner, compression=None), 1
                    size = out.write(_packed(record("warcinfo", _urn(uuid.uuid4()), date, b"format: WARC File Format 1.1\r\n", "application/warc-fields")))
                target = response_id(row["digest"]) if row["shared"] else None
                if row["payload"] is None:
                    own, refers_to = _urn(uuid.uuid4()), target
                else:
                    own, refers_to = target if target and target not in named else _urn(uuid.uuid4()), None
                    named.update([target] if target else [])
                for data in capture(row["page_id"], row["url"], row["payload"], row["size"], row["digest"], own, refers_to, date):
                    size += out.write(_packed(data))
                    n += 1
                if size >= most:
                    yield done()
                    out = None
        if out is not None:
            yield done()

    return saved(known.mapInArrow(write, MANIFEST), "warc-manifest")


class _Chunks(io.RawIOBase):
    """The bytes of a file, unpacked if they are gzip members."""

    def __init__(self, file) -> None:
        self.parts, self.left = self._read(file), memoryview(b"")

    @staticmethod
    def _read(file) -> Iterator[bytes]:
        data = file.read(READ_BYTES)
        if data[:2] != b"\x1f\x8b":
            while data:
                yield data
                data = file.read(READ_BYTES)
            return
        unpack = zlib.decompressobj(31)
        while data:
            if part := unpack.decompress(data):
                yield part
            data = unpack.unused_data
            if unpack.eof:
                unpack, fresh = zlib.decompressobj(31), True
            else:
                fresh = False
            data = data or file.read(READ_BYTES)
        if not fresh:
            raise ValueError("the last gzip member is cut off")

    def readable(self) -> bool:
        return True

    def readinto(self, into) -> int:
        if not self.left:
            self.left = memoryview(next(self.parts, b""))
        n = min(len(into), len(self.left))
        into[:n] = self.left[:n]
        self.left = self.left[n:]
        return n


def _fields(lines: Iterator[bytes]) -> list[tuple[str, str]]:
    """Named fields up to an empty line; a line that begins with white space goes on with the one before."""
    out: list[tuple[str, str]] = []
    for line in lines:
        text = line.decode("utf-8", "replace").rstrip("\r\n")
        if not text:
            break
        if text[0] in " \t" and out:
            out[-1] = (out[-1][0], f"{out[-1][1]} {text.strip()}")
        else:
            name, _, value = text.partition(":")
            out.append((name.strip().lower(), value.strip()))
    return out


def _hex(digest: str | None) -> str | None:
    """A bare hex SHA-1 of a digest header, which may hold it in base 32 or in hex; None for other kinds."""
    kind, _, value = (digest or "").partition(":")
    if kind.lower() != "sha1":
        return None
    return base64.b32decode(value.upper()).hex() if len(value) == 32 else value.lower()


def parse(file, payloads: bool = True) -> Iterator[dict]:
    """The records of an archive as rows of ``RECORD``. A response's digest is that of the payload it holds."""
    stream = io.BufferedReader(_Chunks(file), READ_BYTES)
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no record begins with {line[:40]!r}")
        head = _fields(iter(stream.readline, b""))
        get = dict(head).get
        block = stream.read(size := int(get("content-length", "0")))
        if len(block) < size:
            raise ValueError("the last record is cut off")
        kind, row = get("warc-type"), dict.fromkeys(_RECORD.names)
        row |= {"warc_type": kind, "record_id": get("warc-record-id"), "concurrent_to": [v for k, v in head if k == "warc-concurrent-to"], "date": get("warc-date")}
        row |= {"target_uri": get("warc-target-uri"), "refers_to": get("warc-refers-to"), "content_type": get("content-type"), "payload_digest": _hex(get("warc-payload-digest"))}
        payload = block
        if (get("content-type") or "").startswith("application/http"):
            http, _, payload = block.partition(b"\r\n\r\n")
            first, *lines = http.split(b"\r\n")
            row["http_line"] = first.decode("utf-8", "replace")
            row["fields"] = _fields(iter(lines))
        elif (get("content-type") or "").startswith("application/warc-fields"):
            row["fields"] = _fields(iter(block.splitlines()))
        if kind == "revisit":
            row["payload_bytes"] = int(dict(row["fields"] or ()).get("content-length", "0"))
        else:
            digest = hashlib.sha1(payload).hexdigest()
            if kind == "response" and row["payload_digest"] not in (None, digest):
                raise ValueError(f"{row['record_id']} does not hold the payload of its digest")
            row |= {"payload_bytes": len(payload), "payload_digest": digest, "payload": payload if payloads else None}
        if row["fields"]:
            row["fields"] = list(dict(row["fields"]).items())  # of a repeated name the last
        yield row


def read_archives(manifest: DataFrame, payloads: bool = True) -> DataFrame:
    """Every record of the archives named in the column ``path``, an archive a task."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                store, inner = fs.FileSystem.from_uri(path)
                rows, held = [], 0
                with store.open_input_file(inner) as file:
                    try:
                        for row in parse(file, payloads):
                            rows.append(row)
                            held += len(row["payload"] or b"") + 500
                            if held > 1 << 22:
                                yield pa.RecordBatch.from_pylist(rows, _RECORD)
                                rows, held = [], 0
                    except (ValueError, zlib.error) as e:
                        raise ValueError(f"{path}: {e}") from e
                yield pa.RecordBatch.from_pylist(rows, _RECORD)

    return manifest.select("path").repartition(max(1, manifest.count())).mapInArrow(read, RECORD)


def capture_ids(records: DataFrame) -> DataFrame:
    """record_id and capture_id: a main record's own; else that of a main record it names or is named by, or, if there is none,
    that of another record beside it that has one; else its own. Of several the least."""
    named = records.select(F.col("record_id").alias("a"), F.explode(F.array_distinct("concurrent_to")).alias("b"))
    pairs = named.union(named.select("b", "a"))
    mains = records.filter(F.col("warc_type").isin(*MAINS)).select(F.col("record_id").alias("b"), F.col("record_id").alias("near")).distinct()
    near = pairs.join(mains, "b").groupBy("a").agg(F.min("near").alias("near"))
    far = pairs.join(near.select(F.col("a").alias("b"), F.col("near").alias("far")), "b").groupBy("a").agg(F.min("far").alias("far"))
    found = near.join(far, "a", "full").withColumnRenamed("a", "record_id")
    is_main = F.col("warc_type").isin(*MAINS)
    ids = records.select("record_id", is_main.alias("main")).distinct().join(found, "record_id", "left")
    return ids.groupBy("record_id").agg(F.min(F.when(F.col("main"), F.col("record_id")).otherwise(F.coalesce("near", "far", "record_id"))).alias("capture_id"))


def assemble(records: DataFrame) -> DataFrame:
    """One row a capture: capture_id, and nested ``response`` (or revisit), ``request`` and ``metadata``, with how many there were."""
    whole = F.struct(*[c for c in records.columns if c != "capture_id"])
    of = lambda *kinds: F.when(F.col("warc_type").isin(*kinds), F.col("record_id"))
    known = records.filter(F.col("warc_type") != "warcinfo").join(capture_ids(records), "record_id")
    aggs = []
    for name, kinds in {"response": MAINS, "request": ("request",), "metadata": ("metadata",)}.items():
        aggs += [F.min_by(whole, of(*kinds)).alias(name), F.count(of(*kinds)).alias(f"n_{name}")]
    return known.groupBy("capture_id").agg(*aggs)


def with_referred(captures: DataFrame, page_id: str = "page_id") -> DataFrame:
    """``captures`` with ``refers_to``: the ``page_id`` of the capture that a revisit refers to, null for others or if it is missing."""
    marked = captures.withColumn("_key", F.col("response.refers_to"))
    sizes = marked.filter("_key IS NOT NULL").groupBy("_key").agg(F.count("*").alias("n"))
    holders = captures.filter(F.col("response.warc_type") != "revisit").select(F.col("capture_id").alias("_key"), F.col(page_id).alias("refers_to"))
    again = dealt_join(marked.filter("_key IS NOT NULL"), holders, "_key", sizes, "capture_id", "left")
    return again.drop("_key").unionByName(marked.filter("_key IS NULL").drop("_key").withColumn("refers_to", F.lit(None).cast(captures.schema[page_id].dataType)))


def archive_pages(spark: SparkSession, pages: DataFrame, payloads: bool = True) -> DataFrame:
    """Write ``pages`` as archives in the shared folder, read them back and put their captures together, with their page_id."""
    manifest = write_archives(pages, fresh_path(spark, "warc"))
    captures = assemble(saved(read_archives(manifest, payloads), "warc-records"))
    return with_referred(saved(captures.withColumn("page_id", F.col("metadata.fields")["page-id"].cast("long")), "captures"))


def op13_warc_captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = archive_pages(spark, spark.read.parquet(f"{sf_dir}/pages.parquet"), payloads=False)
    return out.select("page_id", "response.payload_bytes", "response.payload_digest", F.col("response.warc_type").alias("record_type"), "refers_to")


OP13_SQL = f"""
WITH payloads AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages
), tops AS (
  SELECT *, CASE WHEN payload_bytes >= {LEAST_BYTES} THEN max(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS top FROM payloads
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN page_id IS DISTINCT FROM top THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM top THEN top END AS refers_to
FROM tops
"""
