"""WARC archives, read back as a chunked record table.

Writers stream each partition to one ``.warc.gz`` file of the shared folder, a gzip member per record,
under a temporary name that is renamed when whole; a task that is run again writes another file, and
only files of tasks that succeeded are in the manifest. Readers stream members and emit rows of record
identifier and chunk number with the digest and size so far, so that no record is held whole.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftframe.llm.common import cut, scratch_path, small_batches

CHUNK = 1 << 16
#: Bytes of chunks in one Arrow batch.
_FLUSH = 4 << 20
#: First records of repeated payloads that are broadcast at most.
BROADCAST_ROWS = 100_000
DATE = "1970-01-01T00:00:00Z"
MANIFEST = "path string, records long, bytes long"
CHUNKS = "page_id long, record_type string, refers_to long, chunk_no long, chunk binary, size_so_far long, sha1_so_far string, is_last boolean, payload_bytes long, payload_digest string"


class WarcError(ValueError):
    pass


def base32(sha1_hex: str) -> str:
    return base64.b32encode(bytes.fromhex(sha1_hex)).decode()


def _record(page_id, url, digest: str, size: int, first, is_response: bool) -> tuple[bytes, bytes]:
    """(WARC header, HTTP header) of a record; a revisit keeps the HTTP header, which has the payload's length."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    lines = ["WARC/1.1", f"WARC-Type: {'response' if is_response else 'revisit'}", f"WARC-Record-ID: <urn:page:{_id(page_id)}>"]
    if url:
        lines.append("WARC-Target-URI: " + "".join(c if c > " " else f"%{ord(c):02X}" for c in url))
    lines += [f"WARC-Date: {DATE}", f"WARC-Payload-Digest: sha1:{digest}"]
    if not is_response:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{_id(first)}>"]
    lines += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(http) + size * is_response}"]
    return ("\r\n".join(lines) + "\r\n\r\n").encode("utf-8", "surrogatepass"), http


def _store(uri: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a full URI; Hadoop's names for object stores are those of the same store here."""
    scheme, _, rest = uri.partition(":")
    if scheme == "file":  # with one slash or three
        rest = "///" + rest.lstrip("/")
    scheme = {"s3a": "s3", "s3n": "s3", "wasb": "abfs", "wasbs": "abfs"}.get(scheme, scheme)
    try:
        return pafs.FileSystem.from_uri(f"{scheme}:{rest}")
    except pa.ArrowInvalid as e:
        raise WarcError(f"archives can't be kept in {uri}: {e}") from None


def qualified(spark, path: str) -> str:
    """``path`` with the scheme and authority it has for Spark: of one without a scheme, those of the default file system."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(at).toString()


def _id(page_id) -> str:
    return "" if page_id is None else str(page_id)


def write(pages: DataFrame, uri: str, level: int = 1) -> DataFrame:
    """Writes a record per row of ``pages`` (page_id, url, html) and returns the manifest (path, records, bytes).

    Of records with equal payloads (null html: empty) those with the smallest page_id are responses,
    others revisit it. Rows that repeat the smallest page_id with that payload are responses too. A
    null page_id is a response only if its payload has no other. Other columns are ignored.
    """
    spark = pages.sparkSession
    small_batches(spark)
    base = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload"))
    keyed = base.withColumns({"sha1": F.sha1("payload"), "size": F.octet_length("payload").cast("long")})
    # most payloads are the only ones with their digest: only the others' firsts are joined, and payloads aren't moved if these are few
    several = keyed.groupBy("sha1", "size").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    several = cut(several.withColumn("known", F.lit(True)), "warc-firsts")
    told = keyed.join(F.broadcast(several) if several.count() <= BROADCAST_ROWS else several, ["sha1", "size"], "left")
    told = told.withColumn("first", F.when(F.col("known"), F.col("first")).otherwise(F.col("page_id")))
    told = told.withColumn("is_response", F.col("page_id").eqNullSafe(F.col("first")))
    told = told.select("page_id", "url", "sha1", "size", "first", "is_response", F.when(F.col("is_response"), F.col("payload")).alias("payload"))

    def archive(batches):
        store, folder = _store(uri)
        store.create_dir(folder, recursive=True)
        task = TaskContext.get()
        name = f"{task.partitionId():06d}-{uuid.uuid4().hex}.warc.gz"
        records, out = 0, None
        for batch in batches:
            for row in zip(*(batch.column(k) for k in range(7))):
                if out is None:
                    out = store.open_output_stream(f"{folder}/_temporary-{name}", compression=None)
                page_id, url, sha1, size, first, is_response = (x.as_py() for x in row[:6])
                pack = zlib.compressobj(level, zlib.DEFLATED, 31)
                out.write(pack.compress(b"".join(_record(page_id, url, base32(sha1), size, first, is_response))))
                if is_response:
                    whole = memoryview(row[6].as_buffer())
                    for at in range(0, size, CHUNK):
                        out.write(pack.compress(whole[at : at + CHUNK]))
                out.write(pack.compress(b"\r\n\r\n") + pack.flush())
                records += 1
        if out is not None:
            size = out.tell()
            out.close()
            store.move(f"{folder}/_temporary-{name}", f"{folder}/{name}")
            yield pa.RecordBatch.from_pydict({"path": [f"{uri}/{name}"], "records": [records], "bytes": [size]})

    return cut(told.mapInArrow(archive, MANIFEST), "warc-manifest")


class _Members:
    """Bytes of concatenated gzip members (or of a plain file), read on demand."""

    def __init__(self, source, size: int = 1 << 18):
        self.source, self.size, self.buffer, self.started = source, size, bytearray(), False
        self.left = source.read(size)
        self.gzip = self.left[:2] == b"\x1f\x8b"
        self.unpack = zlib.decompressobj(31) if self.gzip else None

    def _more(self) -> bool:
        if not self.left and self.gzip and self.started and not self.unpack.eof and (held := self.unpack.decompress(b"", self.size)):
            self.buffer += held  # output that the last call kept back
            self.left = self.unpack.unused_data
            return True
        if not self.left:
            self.left = self.source.read(self.size)
            if not self.left:
                if self.gzip and not self.unpack.eof and self.started:
                    raise WarcError("a gzip member ends early")
                return False
        if not self.gzip:
            self.buffer += self.left
            self.left = b""
            return True
        if self.unpack.eof:
            self.unpack = zlib.decompressobj(31)
        self.started = True
        self.buffer += self.unpack.decompress(self.left, self.size)
        self.left = self.unpack.unused_data if self.unpack.eof else self.unpack.unconsumed_tail
        return True

    def line(self) -> bytes:
        """Up to and with the next LF; all that is left at the end."""
        at = 0
        while (end := self.buffer.find(b"\n", at)) < 0:
            at = len(self.buffer)
            if not self._more():
                end = len(self.buffer) - 1
                break
        found = bytes(self.buffer[: end + 1])
        del self.buffer[: end + 1]
        return found

    def some(self, most: int) -> bytes:
        """At least one byte and ``most`` at most; empty at the end."""
        while not self.buffer and self._more():
            pass
        found = bytes(self.buffer[:most])
        del self.buffer[:most]
        return found


def _headers(source: _Members) -> dict[str, str]:
    found = {}
    while (line := source.line().rstrip(b"\r\n")) != b"":
        name, _, value = line.decode("utf-8", "replace").partition(":")
        found[name.strip().lower()] = value.strip()
    return found


def records(source, chunk: int = CHUNK):
    """Rows of CHUNKS for each response and revisit record of a file object; other records are skipped."""
    data = _Members(source)
    while True:
        start = data.line()
        if not start:
            return
        if start.strip() == b"":
            continue
        if not start.startswith(b"WARC/"):
            raise WarcError(f"a record starts with {start[:20]!r}")
        head = _headers(data)
        left = int(head["content-length"])
        kind, size = head.get("warc-type", ""), 0
        if "application/http" in head.get("content-type", ""):
            status = data.line()
            left -= len(status)
            while (line := data.line()) not in (b"\r\n", b"\n", b""):
                left -= len(line)
                if line.lower().startswith(b"content-length:"):
                    size = int(line.split(b":")[1])
            left -= len(line)
        page, first = (_page(head.get(k)) for k in ("warc-record-id", "warc-refers-to"))
        if kind == "revisit":
            digest = head.get("warc-payload-digest", "").removeprefix("sha1:")
            yield (page, kind, first, 0, None, size, digest, True, size, digest)
        sha1, seen, k = hashlib.sha1(), 0, 0
        while kind == "response":
            part = b""
            while len(part) < min(chunk, left) and (more := data.some(min(chunk, left) - len(part))):
                part += more
            left, seen, last = left - len(part), seen + len(part), len(part) == left
            if not part and left:
                raise WarcError("a record ends early")
            sha1.update(part)
            digest = base64.b32encode(sha1.digest()).decode()
            last = left == 0
            yield (page, kind, None, k, part, seen, digest, last, seen if last else None, digest if last else None)
            k += 1
            if last:
                break
        while left and (more := data.some(min(chunk, left))):
            left -= len(more)


def _page(uri: str | None) -> int | None:
    text = (uri or "").strip("<>").removeprefix("urn:page:")
    return int(text) if text.lstrip("-").isdigit() else None


def read(manifest: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """The chunk rows of the archives at ``path``, a task per few files; a payload of no bytes has one empty chunk.

    Revisits have one row without chunk; their size and digest are those in their headers. The last
    row of a record has payload_bytes and payload_digest. A damaged archive raises.
    """
    small_batches(manifest.sparkSession)
    names = [x.split()[0] for x in CHUNKS.split(", ")]
    kinds = [{"long": pa.int64(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_()}[x.split()[1]] for x in CHUNKS.split(", ")]

    def batch(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)

    def scan(batches):
        for paths in batches:
            for path in paths.column(0).to_pylist():
                store, at = _store(path)
                with store.open_input_stream(at, compression=None) as source:
                    rows, held = [], 0
                    for row in records(source, chunk):
                        rows.append(row)
                        held += len(row[4] or b"") + 200
                        if held >= _FLUSH:
                            yield batch(rows)
                            rows, held = [], 0
                    if rows:
                        yield batch(rows)

    files = manifest.select("path")
    return files.repartition(max(1, files.count())).mapInArrow(scan, CHUNKS)


def archive_and_read(pages: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Writes ``pages`` to archives in the shared folder and reads them back as chunk rows."""
    return read(write(pages, qualified(pages.sparkSession, scratch_path(pages.sparkSession, "warc"))), chunk)
