"""WARC archives as a chunked record table.

A record is a run of rows: record identifier, chunk number, a piece of its payload of at most ``chunk``
bytes, and the digest and length of all pieces so far. Payloads are cut into pieces by Spark before they
reach Python, a writer streams the pieces of one record after another into gzip members, and a reader
streams archives back into such rows, so no task holds a record whole in Python. Writer and reader carry
the SHA-1 along from piece to piece; either stops if it does not end at the digest that the record declares.

Equal payloads are stored once: the record with the largest id is the response, the others revisit it.
Which that is, is settled by aggregating narrow rows (id and digest) before payloads move.

Archives go to the workspace in the shared folder. A task writes files with new names and returns them
as rows; the table of these rows says which files count, so a task that is run again leaves no doubt.

Ids travel as text, so large ones next to nulls keep every digit. Payloads count as equal if SHA-1, a second hash
and size are.

Defined results: a null payload is empty; a null url is left out; a null id is written as such, revisits
if there is an id with the payload and otherwise is a response; repeated rows of the largest id are all
responses; an empty table makes no archives and no rows; other columns are not looked at.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casewright.llm.common import Workspace, bounded_batches

REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CHUNK = 64 << 10
INDEX = "archive string, page_id string, url string, record_type string, refers_to string, payload_digest string, chunk int, data binary, bytes_so_far long, digest_so_far string, last boolean"


def base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def roles(pages: DataFrame, least: int, id_col: str, html_col: str) -> DataFrame:
    """``pages`` as id, url, body, size, sha and the id of the response with an equal payload."""
    body = F.coalesce(pages[html_col].cast("string"), F.lit("")).cast("binary")
    rows = pages.select(pages[id_col].alias("id"), (pages["url"].cast("string") if "url" in pages.columns else F.lit(None).cast("string")).alias("url"), body.alias("body"))
    rows = rows.withColumns({"size": F.octet_length("body").cast("long"), "sha": F.sha1("body"), "other": F.xxhash64("body")})
    first = rows.groupBy("sha", "other", "size").agg(F.max("id").alias("first"))
    return rows.join(first, ["sha", "other", "size"]).withColumn("refers_to", F.when((F.col("size") >= least) & (F.col("id").isNull() | (F.col("id") != F.col("first"))), F.col("first")))


def write_warc(pages: DataFrame, ws: Workspace, least: int = 0, chunk: int = CHUNK, roll: int = 256 << 20, date: str = "2000-01-01T00:00:00Z", level: int = 2, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """Write the archives; returns ``archive, records, bytes``, a row for each file."""
    bounded_batches(pages.sparkSession)
    rows = roles(pages, least, id_col, html_col)
    chunks = F.when(F.col("refers_to").isNotNull(), 1).otherwise(F.greatest(F.lit(1), F.ceil(F.col("size") / chunk))).cast("int")
    rows = rows.withColumn("n", chunks).withColumn("k", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    piece = F.when(F.col("refers_to").isNull(), F.expr(f"substring(body, k * {int(chunk)} + 1, {int(chunk)})"))
    rows = rows.select(F.col("id").cast("string").alias("id"), "url", "size", "sha", F.col("refers_to").cast("string").alias("refers_to"), "n", "k", piece.alias("data"))
    folder = f"{ws.path}/archives"

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        system, path = fs.FileSystem.from_uri(folder)
        out = member = running = None
        name, records, size, made = "", 0, 0, []

        def put(data: bytes) -> None:
            nonlocal size
            if data:
                out.write(data)
                size += len(data)

        for batch in batches:
            for r in batch.itertuples(index=False):
                if r.k == 0:
                    if out is not None and size >= roll:
                        out.close()
                        made.append((name, records, size))
                        out = None
                    if out is None:
                        system.create_dir(path, recursive=True)
                        name, records, size = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                        out = system.open_output_stream(f"{path}/{name}", compression=None)
                    member, running = zlib.compressobj(level, zlib.DEFLATED, 31), hashlib.sha1()
                    records += 1
                    put(member.compress(_head(r, date)))
                if r.data is not None:
                    running.update(r.data)
                    put(member.compress(r.data))
                if r.k == r.n - 1:
                    if r.data is not None and running.hexdigest() != r.sha:
                        raise ValueError(f"the pieces of record {r.id} do not add up to its digest")
                    put(member.compress(b"\r\n\r\n") + member.flush())
        if out is not None:
            out.close()
            made.append((name, records, size))
        yield pd.DataFrame(made, columns=["archive", "records", "bytes"]).assign(archive=lambda d: folder + "/" + d["archive"].astype(str))

    return ws.keep(rows.mapInPandas(write, "archive string, records long, bytes long"), "manifest")


def _urn(value: str | None) -> str:
    """An id, as text, in a record's identifier."""
    return "<urn:page>" if value is None else f"<urn:page:{quote(value)}>"


def _id_in(urn: str | None) -> str | None:
    return None if urn is None or urn == "<urn:page>" else unquote(urn[len("<urn:page:") : -1])


def _head(r, date: str) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {r.size}\r\n\r\n".encode()
    revisit = r.data is None
    fields = [
        ("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", _urn(r.id)), ("WARC-Date", date),
        ("WARC-Payload-Digest", "sha1:" + base32(bytes.fromhex(r.sha))), ("Content-Type", "application/http;msgtype=response"), ("Content-Length", len(http) + (0 if revisit else r.size)),
    ]
    if revisit:
        fields[3:3] = [("WARC-Refers-To", _urn(r.refers_to)), ("WARC-Profile", REVISIT)]
    if r.url is not None:
        fields.insert(3, ("WARC-Target-URI", r.url.replace("\r", "%0D").replace("\n", "%0A")))
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode("utf-8", "surrogatepass") + b"\r\n" + http


class _Stream:
    """Bytes of an archive, plain or of gzip members, a piece at a time."""

    def __init__(self, raw, piece: int = 256 << 10):
        self.raw, self.piece, self.held, self.at = raw, piece, b"", 0
        head = raw.read(piece)
        self.member = zlib.decompressobj(31) if head[:2] == b"\x1f\x8b" else None
        self.rest = head

    def _more(self) -> bool:
        while True:
            data, self.rest = self.rest or self.raw.read(self.piece), b""
            if not data:
                return False
            if self.member is not None:
                out = self.member.decompress(data, self.piece)
                self.rest = self.member.unconsumed_tail
                if self.member.eof:
                    self.rest, self.member = self.member.unused_data, zlib.decompressobj(31)
                data = out
            if data:
                self.held, self.at = self.held[self.at :] + data, 0
                return True

    def line(self) -> bytes | None:
        while (end := self.held.find(b"\r\n", self.at)) < 0:
            if not self._more():
                return None
        line, self.at = self.held[self.at : end], end + 2
        return line

    def pieces(self, size: int, most: int) -> Iterator[bytes]:
        """``size`` bytes, at most ``most`` at once."""
        while size:
            want = min(size, most)
            while len(self.held) - self.at < want:
                if not self._more():
                    raise ValueError("the archive ends inside a record")
            yield self.held[self.at : self.at + want]
            self.at += want
            size -= want


def _fields(stream: _Stream) -> tuple[dict[str, str], int]:
    """Header fields up to the empty line, and the bytes they took."""
    out, taken = {}, 0
    while line := stream.line():
        taken += len(line) + 2
        key, _, value = line.partition(b":")
        out[key.strip().lower().decode()] = value.strip().decode("utf-8", "surrogatepass")
    return out, taken + 2


def records(raw, chunk: int = CHUNK) -> Iterator[tuple]:
    """The rows of one archive: page id, url, type, refers to, digest, chunk, data, bytes and digest so far, last."""
    stream = _Stream(raw)
    while (line := stream.line()) is not None:
        if not line:
            continue
        head, _ = _fields(stream)
        stream.line()  # the status line
        status = len("HTTP/1.1 200 OK\r\n")
        http, taken = _fields(stream)
        size = int(head["content-length"]) - taken - status
        digest, kind = head["warc-payload-digest"].removeprefix("sha1:"), head["warc-type"]
        start = (_id_in(head["warc-record-id"]), head.get("warc-target-uri"), kind, _id_in(head.get("warc-refers-to")), digest)
        if kind == "revisit":
            yield (*start, 0, None, int(http["content-length"]), digest, True)
            continue
        running, so_far, k = hashlib.sha1(), 0, 0
        for piece in stream.pieces(size, chunk) if size else [b""]:
            running.update(piece)
            so_far += len(piece)
            yield (*start, k, piece, so_far, base32(running.digest()), so_far == size)
            k += 1
        if base32(running.digest()) != digest:
            raise ValueError(f"record {start[0]} does not have its digest")


def read_warc(archives: DataFrame, id_type: str = "long", chunk: int = CHUNK, data: bool = True) -> DataFrame:
    """The chunked record table of the archives named in ``archives``; ``data`` off leaves the bytes out, read and checked all the same."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        names = [x.split()[0] for x in INDEX.split(", ")]
        for batch in batches:
            for archive in batch["archive"]:
                system, path = fs.FileSystem.from_uri(archive)
                with system.open_input_stream(path, compression=None) as raw:
                    rows, held = [], 0
                    for r in records(raw, chunk):
                        if not data and not r[-1]:
                            continue
                        rows.append((archive, *r) if data else (archive, *r[:6], None, *r[7:]))
                        held += len(r[6] or b"") if data else 0
                        if held > 8 << 20 or len(rows) >= 5000:
                            yield pd.DataFrame(rows, columns=names)
                            rows, held = [], 0
                    if rows:
                        yield pd.DataFrame(rows, columns=names)

    table = archives.select("archive").mapInPandas(read, INDEX)
    return table.withColumns({c: F.col(c).cast(id_type) for c in ("page_id", "refers_to")})


def round_trip(pages: DataFrame, ws: Workspace, least: int = 0, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """``page_id, payload_bytes, payload_digest, record_type, refers_to`` of the archives read back, revisits resolved."""
    made = write_warc(pages, ws, least, id_col=id_col, html_col=html_col)
    files = made.count()
    index = read_warc(made.repartition(max(1, files)), pages.schema[id_col].dataType.simpleString(), data=False)
    index = ws.keep(index.select("page_id", "record_type", "refers_to", "payload_digest", "bytes_so_far", "digest_so_far"), "index")
    whole = index.filter("record_type = 'response'").select("page_id", F.col("bytes_so_far").alias("payload_bytes"), F.col("digest_so_far").alias("payload_digest"), "record_type", "refers_to")
    stored = ws.keep(whole.filter("page_id is not null").select(F.col("page_id").alias("refers_to"), "payload_digest", "payload_bytes").distinct(), "stored")
    again = index.filter("record_type = 'revisit'").select("page_id", "payload_digest", "record_type", "refers_to").join(stored, ["refers_to", "payload_digest"])
    return whole.unionByName(again.select(whole.columns))
