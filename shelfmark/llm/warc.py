"""Web pages as WARC 1.1 archives and back, through a table of chunks that never needs a whole record in Python.

A payload travels as rows of (record key, chunk number, at most CHUNK bytes), which stand in order inside a partition.
``digested`` carries a SHA-1 from chunk to chunk. ``write_archives`` carries a compressor and a file the same way: each
record is a gzip member of its own, files end at FILE_BYTES, and what a task returns is a table of segments (file,
begin, end) of about SEGMENT_BYTES that begin and end between records. ``read_chunks`` and ``read_records`` deal the
segments over tasks and inflate each in blocks, so that one oversized record costs as much memory as a small one.

Records with equal payloads are found by digest and length: the one with the least key is a ``response``, the others are
``revisit`` records, which name it and have no payload. The payload of each response is shuffled once, to meet its
type; nothing else that is shuffled holds payloads.

A task that is lost after it wrote leaves a file that no segment names: names are new at each attempt, and the table of
segments is written by Spark, so readers see each record once. Archives go to any folder that ``pyarrow.fs`` opens by
its address and that driver and executors share.

Defined results: a null or empty payload has 0 bytes; rows with a null key are written without one and come last among
equal payloads; rows that are equal in key, address and payload are records of their own, told apart by a copy number;
rows with equal keys and different payloads are independent; a null address is left out; an empty table gives no
archives and no rows; extra columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from shelfmark.llm import common

#: Bytes of a payload in a row.
CHUNK = 1 << 18
#: Compressed bytes after which a segment, and a file, ends with the record that is being written.
SEGMENT_BYTES, FILE_BYTES = 8 << 20, 1 << 30
#: Payloads of fewer bytes are never revisits.
LEAST_BYTES = 0
#: There is no time of capture in a table of pages.
DATE = "1970-01-01T00:00:00Z"
LEVEL = 6

# Fixed values of the format.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = "application/http; msgtype=response"

_KEYS = ("k1", "k2")  # 128 bits that tell rows apart
_SEGMENT = "path string, begin long, end long, records long"
_HEADERS = "record_id string, record_type string, key string, uri string, refers_id string, declared string"


# --- the table of chunks --------------------------------------------------------------------------------------------


def chunked(rows: DataFrame, payload: str = "payload", size: int = CHUNK) -> DataFrame:
    """The other columns with ``n_bytes, chunk, n_chunks, data``: a row for each piece of a binary column, in order.

    A null or empty payload is one empty chunk.
    """
    kept = [c for c in rows.columns if c != payload]
    n = F.coalesce(F.octet_length(payload).cast("long"), F.lit(0).cast("long"))
    sized = rows.withColumn("n_bytes", n).withColumn("n_chunks", F.greatest(F.lit(1), F.ceil(F.col("n_bytes") / size)).cast("long"))
    cut = sized.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_chunks") - 1)))
    data = F.coalesce(F.substring(payload, (F.col("chunk") * size + 1).cast("int"), F.lit(size)), F.lit(b""))
    return cut.select(*kept, "n_bytes", "chunk", "n_chunks", data.alias("data"))


def _rows(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[tuple]:
    """Rows of a few columns, binary ones as views into the batch, not copies."""
    for batch in batches:
        columns = []
        for name in names:
            c = batch.column(name)
            columns.append((x.as_buffer() for x in c) if pa.types.is_binary(c.type) or pa.types.is_large_binary(c.type) else c.to_pylist())
        yield from zip(*columns)


def _base32(digest) -> str:
    return base64.b32encode(digest.digest()).decode()


def digested(chunks: DataFrame) -> DataFrame:
    """The other columns of a table of chunks with ``digest``, the payload's SHA-1 in base 32: a row for each record.

    The chunks of a record stand in one partition, in order, as ``chunked`` and ``read_chunks`` make them; others are an error.
    """
    kept = [c for c in chunks.columns if c not in ("chunk", "n_chunks", "data")]
    schema = StructType([chunks.schema[c] for c in kept]).add("digest", "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        out = to_arrow_schema(schema)
        sha, due = None, 0
        for batch in batches:
            ends, digests = [], []
            for i, (chunk, n, data) in enumerate(_rows([batch], ["chunk", "n_chunks", "data"])):
                if chunk != due:
                    raise ValueError("chunks of a record are apart or out of order")
                sha = sha if chunk else hashlib.sha1()
                sha.update(data)
                due = chunk + 1
                if due == n:
                    ends.append(i)
                    digests.append(_base32(sha))
                    due = 0
            own = batch.select(kept).take(pa.array(ends, pa.int64()))
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(own.columns, out)] + [pa.array(digests, pa.string())], schema=out)

    return chunks.mapInArrow(run, schema)


# --- which records are revisits ---------------------------------------------------------------------------------------


def _identified(pages: DataFrame, key: str, uri: str, payload: str) -> DataFrame:
    """``key, uri, payload, k1, k2``; the hashes follow from the row alone, so that they are the same in each read."""
    rows = pages.select(F.col(f"`{key}`").cast("string").alias("key"), F.col(f"`{uri}`").cast("string").alias("uri"), F.col(f"`{payload}`").cast("binary").alias("payload"), F.col(f"`{key}`").alias("rank"))
    told = [F.col("key").isNull(), "key", F.col("uri").isNull(), "uri", "payload"]
    return rows.select("*", *(F.xxhash64(F.lit(seed), *told).alias(k) for seed, k in enumerate(_KEYS)))


def typed(rows: DataFrame, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """``key, uri, k1, k2, n_bytes, digest, copies`` with the keys ``r1, r2`` of the response that has the same payload.

    Equal rows are counted before they are dealt out. Rows of one payload meet their response in a join whose sides are
    written tables, so that a payload that many records share can be split.
    """
    one = digested(chunked(rows))
    found = common.stored(one.groupBy("key", "uri", "rank", *_KEYS, "n_bytes", "digest").agg(F.count("*").alias("copies")))
    place = F.struct(F.col("rank").isNull().alias("no_rank"), "rank", F.col("uri").isNull().alias("no_uri"), "uri", *_KEYS)
    large = found.where(F.col("n_bytes") >= least_bytes)
    first = common.stored(large.groupBy("digest", "n_bytes").agg(F.min(place).alias("first")).select("digest", "n_bytes", F.col("first.k1").alias("r1"), F.col("first.k2").alias("r2")))
    met = found.join(first, ["digest", "n_bytes"], "left")
    return met.select("key", "uri", *_KEYS, "n_bytes", "digest", "copies", F.coalesce("r1", "k1").alias("r1"), F.coalesce("r2", "k2").alias("r2"))


def _record_id(k1: str, k2: str, copy: Column) -> Column:
    """A UUID of version 8 (custom) from the row's hash and its copy number."""
    hexed = F.md5(F.concat_ws(":", F.col(k1).cast("string"), F.col(k2).cast("string"), copy.cast("string")))
    part = lambda a, n: F.substring(hexed, a, n)
    return F.concat(F.lit("urn:uuid:"), part(1, 8), F.lit("-"), part(9, 4), F.lit("-8"), part(14, 3), F.lit("-8"), part(18, 3), F.lit("-"), part(21, 12))


#: Copy numbers are dealt out in blocks, so that no array grows with the number of copies.
_COPIES = 1 << 16


def _copies(rows: DataFrame, first: int) -> DataFrame:
    """A row for each copy number from ``first`` on."""
    last = F.col("copies") - 1
    blocks = rows.where(last >= first).withColumn("__block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(last / _COPIES))))
    low = F.greatest(F.col("__block") * _COPIES, F.lit(first))
    return blocks.withColumn("copy", F.explode(F.sequence(low, F.least(last, F.col("__block") * _COPIES + _COPIES - 1)))).drop("__block")


def records(pages: DataFrame, key: str = "page_id", uri: str = "url", payload: str = "html", least_bytes: int = LEAST_BYTES) -> DataFrame:
    """The table of chunks of all records to write: ``record_id, record_type, key, uri, refers_id, refers_uri, digest,
    n_bytes, chunk, n_chunks, data``; a revisit is one empty chunk, with the length of what it stands for."""
    rows = _identified(pages, key, uri, payload)
    all_typed = common.stored(typed(rows, least_bytes))
    own = (F.col("k1") == F.col("r1")) & (F.col("k2") == F.col("r2"))
    header = ["record_id", "record_type", "key", "uri", "refers_id", "refers_uri", "digest"]
    none = F.lit(None).cast("string")

    # one payload for each response; a small payload's copies are all responses, and have it each
    heads = all_typed.where(own).select(*_KEYS, "digest", F.when(F.col("n_bytes") >= least_bytes, F.lit(1)).otherwise(F.col("copies")).alias("copies"))
    bodies = rows.groupBy(*_KEYS).agg(F.any_value("key").alias("key"), F.any_value("uri").alias("uri"), F.any_value("payload").alias("payload"))
    responses = _copies(bodies.join(heads, list(_KEYS)), 0)
    responses = responses.select(_record_id("k1", "k2", F.col("copy")).alias("record_id"), F.lit("response").alias("record_type"), "key", "uri", none.alias("refers_id"), none.alias("refers_uri"), "digest", "payload")

    uris = all_typed.where(own).select(F.col("k1").alias("r1"), F.col("k2").alias("r2"), F.col("uri").alias("refers_uri"))
    others = all_typed.where((F.col("n_bytes") >= least_bytes) & (~own | (F.col("copies") > 1))).join(uris, ["r1", "r2"])
    again = _copies(others.where(~own), 0).unionByName(_copies(others.where(own), 1))
    revisits = again.select(
        _record_id("k1", "k2", F.col("copy")).alias("record_id"), F.lit("revisit").alias("record_type"), "key", "uri", _record_id("r1", "r2", F.lit(0)).alias("refers_id"), "refers_uri", "digest",
        "n_bytes", F.lit(0).cast("long").alias("chunk"), F.lit(1).cast("long").alias("n_chunks"), F.lit(b"").alias("data"),
    )
    return chunked(responses).select(*header, "n_bytes", "chunk", "n_chunks", "data").unionByName(revisits)


# --- archives -----------------------------------------------------------------------------------------------------------


def _header(record: dict, date: str) -> bytes:
    """WARC and HTTP header of a record, up to its payload."""
    revisit = record["record_type"] == "revisit"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {record['n_bytes']}\r\n\r\n"
    fields = [
        ("WARC-Type", record["record_type"]), ("WARC-Record-ID", f"<{record['record_id']}>"), ("WARC-Date", date),
        ("WARC-Target-URI", _safe(record["uri"])), ("WARC-Source-Key", None if record["key"] is None else quote(record["key"], safe="")), ("WARC-Payload-Digest", f"sha1:{record['digest']}"),
        ("WARC-Profile", PROFILE if revisit else None), ("WARC-Refers-To", f"<{record['refers_id']}>" if revisit else None), ("WARC-Refers-To-Target-URI", _safe(record["refers_uri"]) if revisit else None),
        ("Content-Type", HTTP), ("Content-Length", len(http) + (0 if revisit else record["n_bytes"])),
    ]
    return "".join(["WARC/1.1\r\n", *(f"{k}: {v}\r\n" for k, v in fields if v is not None), "\r\n", http]).encode()


def _safe(value: str | None) -> str | None:
    """An address on one line of ASCII: control characters, white space and letters beyond ASCII are escaped."""
    return None if value is None else quote(value, safe="!#$&'()*+,/:;=?@[]~%")


def _opened(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(path)


class _Writer:
    """Files of one task; ``segments`` lists what is closed."""

    def __init__(self, folder: str, date: str = DATE, segment_bytes: int = SEGMENT_BYTES, file_bytes: int = FILE_BYTES):
        self.fs, self.folder = _opened(folder)
        self.address, self.date, self.segment_bytes, self.file_bytes = folder, date, segment_bytes, file_bytes
        self.out, self.segments = None, []

    def begin(self, record: dict) -> None:
        if self.out is None:
            name = f"{uuid.uuid4().hex}.warc.gz"
            self.fs.create_dir(self.folder, recursive=True)
            self.out, self.path = self.fs.open_output_stream(f"{self.folder}/{name}", compression=None), f"{self.address}/{name}"
            self.at = self.first = self.count = 0
        self.declared, self.sha = record["digest"], hashlib.sha1()
        self.gzip = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
        self._put(self.gzip.compress(_header(record, self.date)))

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def add(self, data) -> None:
        self.sha.update(data)
        self._put(self.gzip.compress(data))

    def end(self, checked: bool) -> None:
        if checked and _base32(self.sha) != self.declared:
            raise ValueError("a payload isn't what its digest was made of")
        self._put(self.gzip.compress(b"\r\n\r\n") + self.gzip.flush())
        self.count += 1
        if self.at - self.first >= self.segment_bytes:
            self.cut()
        if self.at >= self.file_bytes:
            self.close()

    def cut(self) -> None:
        if self.count:
            self.segments.append((self.path, self.first, self.at, self.count))
            self.first, self.count = self.at, 0

    def close(self) -> None:
        if self.out is not None:
            self.cut()
            self.out.close()
            self.out = None


def write_archives(chunks: DataFrame, folder: str, date: str = DATE, segment_bytes: int = SEGMENT_BYTES, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Writes the records of ``records`` under ``folder``; ``path, begin, end, records`` of each segment.

    The job runs when this is called; the table of segments is stored beside the archives, in ``folder``/segments.
    """
    if ":/" not in folder and not folder.startswith("/"):
        raise ValueError("the folder is a whole path or an address")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["record_id", "record_type", "key", "uri", "refers_id", "refers_uri", "digest", "n_bytes", "chunk", "n_chunks", "data"]
        writer = _Writer(f"{folder}/archives", date, segment_bytes, file_bytes)
        for *values, chunk, n, data in _rows(batches, names):
            if not chunk:
                record = dict(zip(names, values))
                writer.begin(record)
            writer.add(data)
            if chunk + 1 == n:
                writer.end(record["record_type"] == "response")
        writer.close()
        yield pa.RecordBatch.from_pydict({n: pa.array([s[i] for s in writer.segments], pa.string() if n == "path" else pa.int64()) for i, n in enumerate(("path", "begin", "end", "records"))})

    chunks.mapInArrow(run, _SEGMENT).write.parquet(f"{folder}/segments")
    return chunks.sparkSession.read.schema(_SEGMENT).parquet(f"{folder}/segments")


def _inflated(path: str, begin: int, end: int, size: int) -> Iterator[tuple[bool, bytes]]:
    """Blocks of the gzip members between two places of a file, each with whether its member is done."""
    fs, name = _opened(path)
    with fs.open_input_file(name) as file:
        file.seek(begin)
        left, raw, member = end - begin, b"", zlib.decompressobj(31)
        while left or raw:
            if not raw:
                raw = file.read(min(left, size))
                if not raw:
                    raise EOFError(f"{path} ends early")
                left -= len(raw)
            block = member.decompress(raw, size)
            raw = member.unconsumed_tail
            if member.eof:
                raw, member = member.unused_data, zlib.decompressobj(31)
                yield True, block
            else:
                yield False, block


def _parsed(lines: list[str]) -> dict[str, str]:
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}


def _read(path: str, begin: int, end: int, size: int = CHUNK) -> Iterator[tuple[dict, int, int, bytes]]:
    """Of each record of a segment, chunk after chunk: its fields, the chunk's number, how many there are, and the bytes.

    Held at a time: the headers of one record and two blocks.
    """
    held, fields, due, at, total, ended = b"", None, 0, 0, 0, False
    for ended, block in _inflated(path, begin, end, size):
        held += block
        if fields is None and b"\r\n\r\n" in held:
            head, _, rest = held.partition(b"\r\n\r\n")
            warc = _parsed(head.decode().split("\r\n")[1:])
            http, found, body = rest.partition(b"\r\n\r\n")[0], b"\r\n\r\n" in rest, rest.partition(b"\r\n\r\n")[2]
            if warc.get("content-type", "").startswith("application/http"):
                if not found and not ended:
                    continue
                due = int(warc["content-length"]) - len(http) - 4
            else:
                due, body = int(warc["content-length"]), rest
            fields, held, at, total = warc, body, 0, max(1, -(-due // size))
        if fields is not None:
            while due > size and len(held) >= size:
                yield fields, at, total, held[:size]
                held, due, at = held[size:], due - size, at + 1
        if ended:
            if fields is None or len(held) < due + 4 or held[due : due + 4] != b"\r\n\r\n":
                raise ValueError(f"a record of {path} is cut short")
            while due > size:
                yield fields, at, total, held[:size]
                held, due, at = held[size:], due - size, at + 1
            yield fields, at, total, held[:due]
            held, fields = b"", None
    if held or fields is not None:
        raise ValueError(f"a record of {path} is cut short")


def _values(fields: dict) -> tuple:
    bare = lambda v: v and v.strip("<>")
    key = fields.get("warc-source-key")
    return bare(fields.get("warc-record-id")), fields.get("warc-type"), None if key is None else unquote(key), fields.get("warc-target-uri"), bare(fields.get("warc-refers-to")), (fields.get("warc-payload-digest") or "").removeprefix("sha1:") or None


def _each_segment(batches: Iterator[pa.RecordBatch], size: int = CHUNK) -> Iterator[tuple[dict, int, int, bytes]]:
    for path, begin, end in _rows(batches, ["path", "begin", "end"]):
        yield from _read(path, begin, end, size)


def _dealt(segments: DataFrame) -> DataFrame:
    return common.in_tasks(segments, "path", "begin")


def _batch(rows: list[tuple], schema: StructType) -> pa.RecordBatch:
    from pyspark.sql.pandas.types import to_arrow_schema

    out = to_arrow_schema(schema)
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(out)], schema=out)


def read_chunks(segments: DataFrame, size: int = CHUNK) -> DataFrame:
    """``record_id, record_type, key, uri, refers_id, declared, chunk, n_chunks, data``: the records of the segments."""
    schema = StructType.fromDDL(f"{_HEADERS}, chunk long, n_chunks long, data binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for fields, chunk, n, data in _each_segment(batches, size):
            rows.append((*_values(fields), chunk, n, data))
            held += len(data)
            if held >= common.PASS_BYTES or len(rows) == 4096:
                yield _batch(rows, schema)
                rows, held = [], 0
        if rows:
            yield _batch(rows, schema)

    return _dealt(segments).mapInArrow(run, schema)


def read_records(segments: DataFrame) -> DataFrame:
    """``record_id, record_type, key, uri, refers_id, declared, n_bytes, digest``: as ``digested(read_chunks(...))``, in the
    task that reads, so that payloads don't leave it."""
    schema = StructType.fromDDL(f"{_HEADERS}, n_bytes long, digest string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []
        for fields, chunk, n, data in _each_segment(batches):
            if not chunk:
                sha, size = hashlib.sha1(), 0
            sha.update(data)
            size += len(data)
            if chunk + 1 == n:
                rows.append((*_values(fields), size, _base32(sha)))
            if len(rows) == 4096:
                yield _batch(rows, schema)
                rows = []
        if rows:
            yield _batch(rows, schema)

    return _dealt(segments).mapInArrow(run, schema)


def resolved(found: DataFrame) -> DataFrame:
    """``key, uri, n_bytes, digest, record_type, refers_key, intact``: records with a revisit's payload looked up in its response.

    ``found`` is stored first: the revisits of one response can be split then. ``intact``: the payload has the digest
    that the record declares; a revisit whose response is missing has no length, no digest, and is not intact.
    """
    found = common.stored(found)
    plain = found.where("record_type <> 'revisit'").select("key", "uri", "n_bytes", "digest", "record_type", F.lit(None).cast("string").alias("refers_key"), F.col("digest").eqNullSafe(F.col("declared")).alias("intact"))
    heads = found.where("record_type = 'response'").select(F.col("record_id").alias("refers_id"), F.col("key").alias("refers_key"), F.col("n_bytes").alias("of_bytes"), F.col("digest").alias("of_digest"))
    again = found.where("record_type = 'revisit'").join(heads, "refers_id", "left")
    own = again.select("key", "uri", F.col("of_bytes").alias("n_bytes"), F.col("of_digest").alias("digest"), "record_type", "refers_key", F.col("of_digest").eqNullSafe(F.col("declared")).alias("intact"))
    return plain.unionByName(own)


def archive(pages: DataFrame, folder: str, key: str = "page_id", uri: str = "url", payload: str = "html", least_bytes: int = LEAST_BYTES, date: str = DATE, segment_bytes: int = SEGMENT_BYTES, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Writes a table of pages as archives under ``folder`` and returns the table of segments."""
    return write_archives(records(pages, key, uri, payload, least_bytes), folder, date, segment_bytes, file_bytes)


def round_trip(spark: SparkSession, pages: DataFrame, key: str = "page_id", uri: str = "url", payload: str = "html", least_bytes: int = LEAST_BYTES) -> DataFrame:
    """``page_id, payload_bytes, payload_digest, record_type, refers_to, intact`` of pages that were written and read back.

    The archives stand in the shared folder until their records are stored.
    """
    folder = f"{common.shared_dir(spark).rstrip('/')}/warc-{uuid.uuid4().hex}"
    back = resolved(read_records(archive(pages, folder, key, uri, payload, least_bytes)))
    common.remove(spark, folder)
    kind = pages.schema[key].dataType
    return back.select(
        F.col("key").cast(kind).alias("page_id"), F.col("n_bytes").alias("payload_bytes"), F.col("digest").alias("payload_digest"), "record_type", F.col("refers_key").cast(kind).alias("refers_to"), "intact"
    )


ORACLE_SQL = """
WITH raw AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS hexed FROM pages),
based AS (
  SELECT page_id, payload_bytes,
         array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
           1 + ((('0x' || substr(hexed, 1 + (i // 4) * 5, 5))::INT >> (5 * (3 - (i % 4)))::INT) & 31), 1)), '') AS payload_digest
  FROM raw),
least AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS first_id FROM based)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first_id THEN first_id END AS refers_to, true AS intact
FROM least
"""
