"""WARC archives: one gzip member per record, written and read back sequentially by many tasks."""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator
from typing import BinaryIO
from urllib.parse import quote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallylane.llm.shared import materialise, new_folder, text_of

#: Payloads below this size are stored again rather than referred to.
LEAST = 1000
#: Revisits up to this number are broadcast (two longs each); more are joined by shuffling.
BROADCAST = 500_000
#: An archive is closed beyond so many bytes.
ROLL = 1 << 28
CHUNK = 1 << 16


def _sha1(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def member(record_id: str, url: str, payload: bytes, refers_to: str | None, date: str = "2024-01-01T00:00:00Z") -> bytes:
    """One record as a gzip member; a revisit has the HTTP head only, and the digest of the payload it stands for."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if refers_to else head + payload
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if refers_to else 'response'}", f"WARC-Record-ID: <{record_id}>", f"WARC-Date: {date}", f"WARC-Target-URI: {quote(url, safe=_URL)}",
             f"WARC-Payload-Digest: {_sha1(payload)}", f"WARC-Block-Digest: {_sha1(block)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    if refers_to:
        lines += [f"WARC-Refers-To: <{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + packer.flush()


_URL = ":/?#[]@!$&'()*+,;=%~"


class Member:
    """The bytes of one gzip member, decompressed as they are asked for; at most a chunk is held beyond that."""

    def __init__(self, stream: BinaryIO, rest: bytes):
        self.stream, self.raw = stream, rest
        self.unpacker = zlib.decompressobj(31)
        self.held = b""

    def more(self) -> bool:
        """Decompress one chunk more; false at the end of the member."""
        while not self.unpacker.eof:
            raw = self.unpacker.unconsumed_tail or self.raw or self.stream.read(CHUNK)
            self.raw = b""
            if not raw:
                raise ValueError("the archive ends inside a record")
            out = self.unpacker.decompress(raw, CHUNK)
            if out:
                self.held += out
                return True
        return False

    def until(self, mark: bytes, most: int = 1 << 20) -> bytes:
        """All bytes up to and with a mark."""
        searched = 0
        while (at := self.held.find(mark, max(0, searched - len(mark)))) < 0:
            searched = len(self.held)
            if searched > most or not self.more():
                raise ValueError("a record's head does not end")
        found, self.held = self.held[: at + len(mark)], self.held[at + len(mark) :]
        return found

    def chunks(self, size: int) -> Iterator[bytes]:
        """`size` bytes, in chunks."""
        while size:
            if not self.held and not self.more():
                raise ValueError("a record is shorter than its content length")
            found, self.held = self.held[:size], self.held[size:]
            size -= len(found)
            yield found

    def close(self) -> bytes:
        """Check the record's end; returns the bytes read beyond the member."""
        while self.more():
            pass
        if self.held != b"\r\n\r\n":
            raise ValueError("a record does not end with its content length")
        return self.unpacker.unused_data or self.raw


def _fields(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:] if x)}


def read_records(stream: BinaryIO, keep: bool = True) -> Iterator[dict]:
    """Records of an archive in order: head fields, HTTP fields, payload if kept, its size and digests.

    Digests are computed as the bytes pass; `valid` says whether the block's digest and, where the payload is in the record,
    the payload's digest are those stated.  Broken framing raises ValueError.
    """
    rest = stream.read(CHUNK)
    while rest:
        own = Member(stream, rest)
        head = own.until(b"\r\n\r\n")
        if not head.startswith(b"WARC/1."):
            raise ValueError("not a WARC record")
        fields = _fields(head)
        block, payload, size, kept, http, pending = hashlib.sha1(), hashlib.sha1(), 0, [], None, b""
        for part in own.chunks(int(fields["content-length"])):
            block.update(part)
            if http is None:
                pending += part
                at = pending.find(b"\r\n\r\n")
                if at < 0:
                    continue
                http, part = _fields(pending[:at]), pending[at + 4 :]
            payload.update(part)
            size += len(part)
            if keep:
                kept.append(part)
        rest = own.close() or stream.read(CHUNK)
        stated = {k: base64.b32decode(fields[f"warc-{k}-digest"].removeprefix("sha1:")) for k in ("block", "payload")}
        revisit = fields["warc-type"] == "revisit"
        valid = stated["block"] == block.digest() and (revisit or stated["payload"] == payload.digest())
        yield {"fields": fields, "http": http or {}, "payload": b"".join(kept) if keep and not revisit else None, "size": size, "digest": stated["payload"].hex(), "valid": valid}


def _filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def revisits(pages: DataFrame, key: str, body: str, least: int) -> DataFrame:
    """Key, SHA-1 and holder (largest key) of rows whose payload another row with a larger key has too; hashes are shuffled, not payloads."""
    payload = text_of(body).cast("binary")
    keyed = pages.select(F.col(key).alias("key"), F.sha1(payload).alias("sha"), F.octet_length(payload).alias("n")).where(F.col("n") >= least)
    holder = keyed.groupBy("sha").agg(F.max("key").alias("holder"), F.count("*").alias("copies")).where("copies > 1")
    return materialise(keyed.join(holder, "sha").where("key <> holder").select("key", "sha", "holder").distinct())


def write_archives(pages: DataFrame, folder: str, key: str = "page_id", url: str = "url", body: str = "html", least: int = LEAST) -> DataFrame:
    """Write a record for each row below `folder`; returns one row for each archive (path, records, bytes).

    Keys are whole numbers.  A payload of at least `least` bytes that several rows share is stored once, at the row with the
    largest key, and the others are revisits of it; rows that repeat a key are written each.  A null body is an empty payload, a null
    key or url an empty one.  Each task writes archives of its own to a temporary name and renames them when they are
    whole, so that a task may fail and run again.
    """
    known = revisits(pages, key, body, least)
    side = F.broadcast(known) if known.count() <= BROADCAST else known
    rows = pages.select(F.col(key).alias("key"), F.coalesce(F.col(url), F.lit("")).alias("url"), text_of(body).cast("binary").alias("body"))
    rows = rows.withColumn("sha", F.sha1("body")).join(side, ["key", "sha"], "left").select("key", "holder", "url", "body")

    def write(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        system, base = _filesystem(folder)
        system.create_dir(base, recursive=True)
        done, out, size = [], None, 0

        def close() -> None:
            out.close()
            system.move(f"{base}/.{name}-{task.taskAttemptId()}", f"{base}/{name}")
            done[-1][2] = size

        for batch in it:
            for k, holder, address, payload in zip(*(batch.column(i) for i in range(4)), strict=True):
                if out is None:
                    name = f"part-{task.partitionId():06d}-{len(done):04d}.warc.gz"
                    out, size = system.open_output_stream(f"{base}/.{name}-{task.taskAttemptId()}", compression=None), 0
                    done.append([f"{folder}/{name}", 0, 0])
                refers = f"urn:page:{holder.as_py()}" if holder.is_valid else None
                packed = member(f"urn:page:{k.as_py() if k.is_valid else ''}", address.as_py(), payload.as_buffer().to_pybytes(), refers)
                out.write(packed)
                size += len(packed)
                done[-1][1] += 1
                if size >= ROLL:
                    close()
                    out = None
        if out is not None:
            close()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(list(x)) for x in zip(*done, strict=True)], names=["path", "records", "bytes"])

    return materialise(rows.mapInArrow(write, "path string, records long, bytes long"))


READ = "record_id string, record_type string, url string, refers_to string, payload_bytes long, payload_digest string, valid boolean, payload binary"


def read_archives(archives: DataFrame, keep_payload: bool = False) -> DataFrame:
    """Records of the archives at `path`, each archive read once from start to end by one task."""

    def read(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("record_id", pa.string()), ("record_type", pa.string()), ("url", pa.string()), ("refers_to", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("valid", pa.bool_()), ("payload", pa.binary())])
        for batch in it:
            for path in batch.column(0).to_pylist():
                system, place = _filesystem(path)
                rows, held = [], 0
                with system.open_input_stream(place, compression=None) as stream:
                    for r in read_records(stream, keep_payload):
                        f = r["fields"]
                        full = int(r["http"].get("content-length", r["size"])) if f["warc-type"] == "revisit" else r["size"]
                        rows.append((f["warc-record-id"][1:-1], f["warc-type"], f.get("warc-target-uri", ""), f.get("warc-refers-to", "<>")[1:-1] or None, full, r["digest"], r["valid"], r["payload"]))
                        held += len(r["payload"] or b"")
                        if len(rows) >= 4096 or held > 1 << 25:
                            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, x, strict=True)) for x in rows], schema)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist([dict(zip(schema.names, x, strict=True)) for x in rows], schema)

    return archives.select("path").mapInArrow(read, READ)


def digest(pages: DataFrame) -> DataFrame:
    """Write the pages, read them back, and report each record; a record that fails its digest stops the query."""
    found = read_archives(write_archives(pages, new_folder(pages.sparkSession, "warc")))
    number = lambda c: F.substring_index(c, ":", -1).try_cast("long")
    checked = F.when(F.col("valid"), F.col("payload_digest")).otherwise(F.raise_error(F.concat(F.lit("digest mismatch in "), "record_id")))
    return found.select(number("record_id").alias("page_id"), "payload_bytes", checked.alias("payload_digest"), "record_type", number("refers_to").alias("refers_to"))


SQL = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
h AS (SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS holder FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN holder = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN holder <> page_id THEN holder END AS refers_to FROM h
"""
