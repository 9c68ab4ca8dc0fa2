"""WARC archives as a table of record chunks: written and read as streams, with a running digest on every chunk."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.workspace import Workspace, session

#: Bytes of a record that one row holds at most.
CHUNK = 1 << 20
#: Payloads of fewer bytes are stored again rather than referred to.
LEAST_REVISIT = 1000
#: Bytes that an Arrow batch of chunks gathers before it is passed on.
BATCH_BYTES = 8 << 20
# Fixed value: the profile that marks a revisit by its payload's digest.
SAME_PAYLOAD = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CHUNKS = "record_id string, page_id long, chunk int, chunks int, digest_so_far string, data binary"


class Damaged(ValueError):
    """An archive that breaks the format, or whose digests don't hold."""


def _labelled(sha1: bytes) -> str:
    return "sha1:" + base64.b32encode(sha1).decode()


def record_pieces(record_id: str, url: str | None, payload: bytes | memoryview, refers_to: str | None, date: str, size: int = CHUNK, sha1: bytes | None = None) -> list[bytes | memoryview]:
    """A record's bytes in pieces of at most `size`. The payload (of the digest sha1) is sliced, never copied whole; heads
    of any length are sliced too. refers_to is the id of the record that a revisit stands for."""
    payload = memoryview(payload)
    sha1 = sha1 or hashlib.sha1(payload).digest()
    target = "".join(c for c in url or "about:blank" if c >= " ")
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    fields = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", f"<{record_id}>"), ("WARC-Date", date), ("WARC-Target-URI", target), ("WARC-Payload-Digest", _labelled(sha1)), ("Content-Type", "application/http;msgtype=response")]
    if refers_to is not None:
        fields += [("WARC-Profile", SAME_PAYLOAD), ("WARC-Refers-To", f"<{refers_to}>")]
    body = payload if refers_to is None else payload[:0]
    fields.append(("Content-Length", str(len(http) + len(body))))
    head = b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n" + http
    end = b"\r\n\r\n"
    if len(head) + len(body) + len(end) <= size:
        return [b"".join((head, body, end))]
    return [part[k : k + size] for part in (memoryview(head), body, end) for k in range(0, len(part), size)]


def record_name(page: int | None, sha1: bytes) -> str:
    """The WARC-Record-ID of a page's record. Page and payload alone decide it, so that a revisit can name the record
    that it stands for; rows that repeat both have one name, as they hold one record."""
    return f"urn:page:{'' if page is None else page}:{sha1.hex()}"


class Parser:
    """Reads records from pieces of a stream, holding no more than one piece and one record's head."""

    def __init__(self):
        self.held, self.state, self.left = b"", "head", 0
        self.record = None

    def feed(self, piece: bytes) -> Iterator[dict]:
        """Yields each record as its end arrives: its fields, payload_bytes and payload_sha1 (of what is stored)."""
        data = self.held + bytes(piece) if self.held else bytes(piece)
        self.held = b""
        while data:
            if self.state == "head":
                stop = data.find(b"\r\n\r\n")
                if stop < 0:
                    self.held = data
                    return
                lines = data[:stop].decode().split("\r\n")
                if not lines[0].startswith("WARC/1."):
                    raise Damaged("no record begins here")
                fields = dict(line.split(": ", 1) for line in lines[1:])
                self.record = {"fields": fields, "payload_bytes": 0, "sha1": hashlib.sha1()}
                self.left, self.state, data = int(fields["Content-Length"]), "http", data[stop + 4 :]
            elif self.state == "http":
                stop = data.find(b"\r\n\r\n")
                if stop < 0:
                    self.held = data
                    return
                http = dict(line.split(": ", 1) for line in data[:stop].decode().split("\r\n")[1:])
                self.record["told"] = int(http["Content-Length"])
                self.left -= stop + 4
                self.state, data = "body", data[stop + 4 :]
                if not self.left:
                    self.state = "end"
            elif self.state == "body":
                part, data = data[: self.left], data[self.left :]
                self.record["sha1"].update(part)
                self.record["payload_bytes"] += len(part)
                self.left -= len(part)
                if not self.left:
                    self.state = "end"
            if self.state == "end":
                if len(data) < 4:
                    self.held = data
                    return
                if data[:4] != b"\r\n\r\n":
                    raise Damaged("a record is longer than told")
                data, self.state = data[4:], "head"
                yield self._done()

    def _done(self) -> dict:
        r, f = self.record, self.record["fields"]
        told = base64.b32decode(f["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
        revisit = f["WARC-Type"] == "revisit"
        if not revisit and (told != r["sha1"].hexdigest() or r["told"] != r["payload_bytes"]):
            raise Damaged("the payload's digest or length doesn't hold")
        to = f.get("WARC-Refers-To", "").strip("<>").removeprefix("urn:page:").partition(":")[0]
        return {"record_id": f["WARC-Record-ID"].strip("<>"), "url": f["WARC-Target-URI"], "payload_bytes": r["told"], "payload_digest": told, "record_type": f["WARC-Type"], "refers_to": int(to) if to else None}

    def finish(self) -> None:
        if self.held or self.state != "head":
            raise Damaged("the stream ends within a record")


def parse(pieces: Iterable[bytes]) -> Iterator[dict]:
    """The records of a stream in pieces of any size."""
    parser = Parser()
    for piece in pieces:
        yield from parser.feed(piece)
    parser.finish()


def keepers(pages: DataFrame, key: str, html: str, least: int = LEAST_REVISIT) -> DataFrame:
    """_digest and _keeper: for each payload that several rows share, the largest key among them."""
    body = F.coalesce(F.col(html), F.lit("")).cast("binary")
    return pages.where(F.octet_length(html) >= least).groupBy(F.sha1(body).alias("_digest")).agg(F.max(key).alias("_keeper"), F.count("*").alias("_rows")).where("_rows > 1").drop("_rows")


def write_chunks(pages: DataFrame, ws: Workspace, key: str = "page_id", url: str = "url", html: str = "html", least: int = LEAST_REVISIT, size: int = CHUNK, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """The archive of `pages`, written as a table of chunks under the shared folder.

    record_id is a row's own; all its chunks carry it, their number, how many there are, and the digest of all bytes up
    to their end. Payloads shared by several rows are stored by the row with the largest key, and referred to by the others. Which
    payloads are shared is a table of its own, of which Spark checks the size before it chooses how to join it.
    """
    session(pages)
    shared = ws.table(keepers(pages, key, html, least), "keepers")
    body = F.coalesce(F.col(html), F.lit("")).cast("binary")
    rows = pages.select(F.col(key).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), body.alias("body"), F.when(F.octet_length(html) >= least, F.sha1(body)).alias("_digest"))
    rows = rows.join(shared, "_digest", "left").select("page_id", "url", "body", F.when(F.col("page_id").eqNullSafe(F.col("_keeper")), None).otherwise(F.col("_keeper")).alias("refers_to"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n, out, held = TaskContext.get().partitionId(), 0, [], 0
        for batch in batches:
            for page, target, body, to in zip(*batch.columns, strict=True):
                page, body, to = page.as_py(), memoryview(body.as_buffer()), to.as_py()
                name, n = f"{part}-{n}", n + 1
                digest = hashlib.sha1(body).digest()
                pieces = record_pieces(record_name(page, digest), target.as_py(), body, None if to is None else record_name(to, digest), date, size, digest)
                running, k = hashlib.sha1(), 0
                for piece in pieces:
                    running.update(piece)
                    out.append((name, page, k, len(pieces), running.hexdigest(), bytes(piece)))
                    k, held = k + 1, held + len(piece)
                    if held >= BATCH_BYTES:
                        yield _batch(out)
                        out, held = [], 0
        if out:
            yield _batch(out)

    return ws.table(rows.mapInArrow(write, CHUNKS), "chunks")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["record_id", "page_id", "chunk", "chunks", "digest_so_far", "data"])


def read_chunks(chunks: DataFrame) -> DataFrame:
    """One row per record of a chunk table: page_id, payload_bytes, payload_digest, record_type, refers_to, chunk_rows.

    Records in one chunk are read where they lie. The chunks of longer ones are brought together in order and streamed,
    so a task holds one chunk at a time. Every chunk's running digest is checked, and every payload's.
    """
    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, chunk_rows int"

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, parser, running, count = None, Parser(), None, 0
        for batch in batches:
            rows = []
            for record_id, page, k, told, data in zip(*(batch.column(c) for c in ("record_id", "page_id", "chunk", "digest_so_far", "data")), strict=True):
                record_id, k, data = record_id.as_py(), k.as_py(), memoryview(data.as_buffer())
                if k == 0:
                    parser.finish()
                    at, parser, running, count = record_id, Parser(), hashlib.sha1(), 0
                if record_id != at or k != count:
                    raise Damaged("a chunk is missing")
                running.update(data)
                count += 1
                if running.hexdigest() != told.as_py():
                    raise Damaged("a chunk's running digest doesn't hold")
                for r in parser.feed(data):
                    rows.append((page.as_py(), r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"], count))
            if rows:
                kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], schema.replace(" long", "").replace(" string", "").replace(" int", "").split(", "))
        parser.finish()

    short, long = chunks.where("chunks = 1"), chunks.where("chunks > 1")
    long = long.repartition("record_id").sortWithinPartitions("record_id", "chunk")
    return short.mapInArrow(read, schema).unionByName(long.mapInArrow(read, schema))


def archive_pages(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Writes a record for each row and reads the archive back: page_id, payload_bytes, payload_digest, record_type,
    refers_to, chunk_rows.

    A null payload is empty, a null url becomes about:blank. Of equal payloads of LEAST_REVISIT bytes or more, the rows
    with the largest key (repeated rows: each of them) are responses and the others revisit it; a null key counts as
    less than any. Columns other than the three named are not read; an empty table gives an empty result.
    """
    ws = Workspace(session(pages), "warc")
    return read_chunks(write_chunks(pages, ws, key, url, html))
