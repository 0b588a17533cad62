"""WARC archives: written with revisit records, read back by a reader that salvages damaged files.

Writing. Payloads are told apart by SHA-256 and length. Of equal payloads of at least ``LEAST`` bytes the
row with the smallest key is a response, the others are revisits that refer to it and hold no payload.
Digests alone are shuffled, one row per digest and task; pages stay where they are read, as long as the
repeated digests fit a checked broadcast. Every record is a gzip member of its own. A task writes
archives of about ``ARCHIVE`` bytes under names of its own attempt, and they count only once they
are in the table of archives, which Spark commits: an attempt that was lost leaves files that nobody
reads, and nothing is renamed.

Reading. Archives are read in pieces of ``PIECE`` bytes, one record in memory at a time. A member must
begin with the gzip signature, inflate with the right checksum, begin with a version line, hold as
many bytes as its header says, end in two empty lines, and match its block digest (and its payload
digest, where it holds the payload). After a check that fails the reader goes on from the next byte,
looks for the next signature (in a plain file: the next version line at the start of a line) from
which all checks hold, and reads on from there. What lies between is a gap: path, first byte, byte
behind the last, and the check that failed first. Bytes are either in a record or in a gap. A record
that a damaged plain record quotes whole, as its payload, passes for one.

Defined cases: a null payload is empty; empty and short payloads are responses; a null URL leaves out
its header, control characters in one are written as %XX; a null key is larger than any other
and comes back as null; rows with the smallest key of a payload are all responses; repeated rows are records
of their own; a column of any name may serve, others are not read; an empty table gives no archive, and reading
none gives no record.
"""

from __future__ import annotations

import base64
import hashlib
import io
import re
import uuid
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crowdcover.llm.common import batches, fresh_folder, small, written

#: Bytes of the shortest payload that is revisited.
LEAST = 100
#: Bytes after which a task begins a new archive.
ARCHIVE = 32 << 20
#: Bytes that are read from an archive, or inflated, at once.
PIECE = 1 << 16
#: Bytes of a header block beyond which it isn't one.
MOST_HEADER = 1 << 20

#: Tasks that read archives.
MOST_TASKS = 10_000

VERSION = "WARC/1.1"
SIGNATURE = b"\x1f\x8b\x08"
_VERSION_LINE = re.compile(rb"WARC/1\.[01]\r\n")
_CONTROL = re.compile(r"[\x00-\x20\x7f]")
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

_ARCHIVES = "path string, bytes long, records long"
_RECORDS = ("path string, start long, end long, record_type string, record_id string, key string, "
            "url string, payload_bytes long, payload_digest string, refers_to string, "
            "refers_to_key string, gap string, payload binary")


# --- writing ----------------------------------------------------------------------------------------

def _base32(digest: bytes) -> str:
    return "sha256:" + base64.b32encode(digest).decode().rstrip("=")


def record_id(key: int | None, digest: bytes) -> str:
    """The same for the same key and payload, so that a revisit can name a response it hasn't seen."""
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.sha256(b'%r ' % (key,) + digest).digest()[:16])}>"


def record(kind: str, headers: list[tuple[str, str]], block: bytes) -> bytes:
    """A record as bytes, without compression."""
    lines = [VERSION, f"WARC-Type: {kind}", *[f"{k}: {v}" for k, v in headers],
             f"WARC-Block-Digest: {_base32(hashlib.sha256(block).digest())}",
             f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    """``data`` as one gzip member, without a time or name."""
    press = zlib.compressobj(6, zlib.DEFLATED, 31)
    return press.compress(data) + press.flush()


def page_record(key: int | None, url: str | None, payload: bytes, first: int | None, date: str) -> bytes:
    """The response of a page, or its revisit where ``first``, another key, has the payload."""
    digest = hashlib.sha256(payload).digest()
    headers = [("WARC-Record-ID", record_id(key, digest)), ("WARC-Date", date),
               ("WARC-Payload-Digest", _base32(digest)), ("Content-Type", "application/http;msgtype=response")]
    if key is not None:
        headers.append(("X-Key", str(key)))
    if url is not None:
        headers.append(("WARC-Target-URI", _CONTROL.sub(lambda c: f"%{ord(c[0]):02X}", url)))
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    if first is None:
        return record("response", headers, head + payload)
    return record("revisit", [*headers, ("WARC-Refers-To", record_id(first, digest)),
                              ("WARC-Profile", PROFILE), ("X-Refers-To-Key", str(first))], head)


def _uri(folder: str) -> str:
    return folder if "://" in folder or folder.startswith("file:") else f"file://{folder}"


def write_archives(pages: DataFrame, key: str = "page_id", url: str = "url", payload: str = "html",
                   folder: str | None = None, date: str = "1970-01-01T00:00:00Z",
                   least: int = LEAST, size: int = ARCHIVE) -> DataFrame:
    """Writes ``pages`` to archives in ``folder``, which all executors reach; gives (path, bytes,
    records), one row per archive."""
    folder = folder or fresh_folder(pages)
    store, root = pyarrow.fs.FileSystem.from_uri(_uri(folder))
    store.create_dir(root, recursive=True)
    rows = pages.select(F.col(key).cast("long").alias("key"), F.col(url).cast("string").alias("url"),
                        F.coalesce(F.col(payload).cast("binary"), F.lit(b"")).alias("payload"))
    digest = F.when(F.length("payload") >= least, F.unhex(F.sha2("payload", 256)))
    rows = rows.withColumn("digest", digest)
    firsts = written(rows.where("digest IS NOT NULL").groupBy("digest").agg(
        F.min("key").alias("first"), F.count("*").alias("n")).where("n > 1 AND first IS NOT NULL").drop("n"))
    marked = rows.join(small(firsts, 200_000), "digest", "left").select(
        "key", "url", "payload", F.when(~F.col("key").eqNullSafe(F.col("first")), F.col("first")).alias("first"))

    def work(batches_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = pyarrow.fs.FileSystem.from_uri(_uri(folder))
        out, name, done, at, n = None, "", [], 0, 0

        def close() -> None:
            out.close()
            done.append((f"{folder.rstrip('/')}/{name}", at, n))

        for batch in batches_:
            for k, u, p, f in zip(*[batch.column(i) for i in range(4)]):
                if out is not None and at >= size:
                    close()
                    out = None
                if out is None:
                    name = f"{uuid.uuid4().hex}.warc.gz"  # of this attempt alone
                    out = store.open_output_stream(f"{root}/{name}", compression=None)
                    info = member(record("warcinfo", [
                        ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Date", date),
                        ("WARC-Filename", name), ("Content-Type", "application/warc-fields")],
                        b"format: WARC File Format 1.1\r\n"))
                    out.write(info)
                    at, n = len(info), 1
                data = member(page_record(k.as_py(), u.as_py(), p.as_py(), f.as_py(), date))
                out.write(data)
                at, n = at + len(data), n + 1
        if out is not None:
            close()
        yield pa.RecordBatch.from_arrays(
            [pa.array([d[0] for d in done], pa.string()), pa.array([d[1] for d in done], pa.int64()),
             pa.array([d[2] for d in done], pa.int64())], ["path", "bytes", "records"])

    return written(batches(marked, work, _ARCHIVES))


# --- reading ----------------------------------------------------------------------------------------

class Broken(Exception):
    """A check that failed."""


@dataclass
class Record:
    kind: str
    headers: dict[str, str]
    payload: bytes | None  # None: not in the record
    start: int = 0
    end: int = 0


@dataclass
class Gap:
    start: int
    end: int
    reason: str


@dataclass
class Source:
    """A file read in pieces: the last ones are kept, so that short steps back cost nothing."""

    file: io.IOBase
    size: int
    kept: dict[int, bytes] = field(default_factory=dict)

    def piece(self, number: int) -> bytes:
        if number not in self.kept:
            if len(self.kept) >= 4:
                self.kept.pop(next(iter(self.kept)))
            self.file.seek(number * PIECE)
            self.kept[number] = self.file.read(min(PIECE, self.size - number * PIECE))
        return self.kept[number]

    def pieces(self, at: int) -> Iterator[bytes]:
        while at < self.size:
            data = self.piece(at // PIECE)[at % PIECE:]
            yield data
            at += len(data)

    def find(self, at: int, pattern: bytes) -> int:
        """The first place of ``pattern`` from ``at`` on, or the end of the file."""
        tail, n = b"", len(pattern) - 1
        for data in self.pieces(at):
            found = (tail + data).find(pattern)
            if found >= 0:
                return at - len(tail) + found
            at += len(data)
            tail = (tail + data)[-n:]
        return self.size


def _header(data: bytes) -> tuple[dict[str, str], int] | None:
    """Fields of a header block and where the block ends; None if its end has not come yet."""
    end = data.find(b"\r\n\r\n", 0, MOST_HEADER)
    if end < 0:
        if len(data) >= MOST_HEADER:
            raise Broken("header")
        return None
    if not _VERSION_LINE.match(data):
        raise Broken("version")
    fields: dict[str, str] = {}
    last = ""
    for line in data[:end].split(b"\r\n")[1:]:
        text = line.decode("utf-8", "replace")
        if text[:1] in (" ", "\t") and last:
            fields[last] += " " + text.strip()
            continue
        name, colon, value = text.partition(":")
        if not colon:
            raise Broken("header")
        last = name.strip().lower()
        fields[last] = value.strip()
    if not fields.get("content-length", "").isdecimal() or "warc-type" not in fields:
        raise Broken("header")
    return fields, end + 4


def _matches(value: str, data: bytes) -> bool:
    """Whether a digest header fits ``data``; a method that isn't known is no failure."""
    method, _, digest = value.partition(":")
    if method.lower() not in ("sha1", "sha256", "md5"):
        return True
    own = hashlib.new(method.lower(), data)
    return digest.rstrip("=").upper() in (base64.b32encode(own.digest()).decode().rstrip("="),
                                          own.hexdigest().upper())


def checked(fields: dict[str, str], block: bytes) -> Record:
    """The record of a block that has the right length."""
    if "warc-block-digest" in fields and not _matches(fields["warc-block-digest"], block):
        raise Broken("block digest")
    kind = fields["warc-type"].lower()
    payload: bytes | None = block
    if fields.get("content-type", "").lower().startswith("application/http"):
        head = block.find(b"\r\n\r\n")
        payload = block[head + 4:] if head >= 0 else b""
    if kind == "revisit":
        payload = None
    elif "warc-payload-digest" in fields and not _matches(fields["warc-payload-digest"], payload):
        raise Broken("payload digest")
    return Record(kind, fields, payload)


def _gathered(stream: Iterator[bytes]) -> tuple[Record, int]:
    """The record at the start of ``stream``, and its bytes with the two empty lines."""
    data = bytearray()
    found = None
    for piece in stream:
        data += piece
        if found is None:
            if not _VERSION_LINE.match(data[:10]) and len(data) >= 10:
                raise Broken("version")
            found = _header(bytes(data[:MOST_HEADER]))
        if found is not None and len(data) >= found[1] + int(found[0]["content-length"]) + 4:
            break
    if found is None:
        raise Broken("end of data")
    fields, at = found
    end = at + int(fields["content-length"])
    if len(data) < end + 4:
        raise Broken("end of data")
    if data[end:end + 4] != b"\r\n\r\n":
        raise Broken("length")
    return checked(fields, bytes(data[at:end])), end + 4


def read_member(source: Source, at: int) -> Record:
    """The record of the gzip member at ``at``."""
    opened = zlib.decompressobj(31)
    used = 0

    def inflated() -> Iterator[bytes]:
        nonlocal used
        for data in source.pieces(at):
            used += len(data)
            out = b"-"
            while (data or len(out) == PIECE) and not opened.eof:  # a full piece: more may be held back
                yield (out := opened.decompress(data, PIECE))
                data = opened.unconsumed_tail
            if opened.eof:
                used -= len(opened.unused_data)
                return
        raise Broken("end of data")

    if next(source.pieces(at), b"")[:1] != SIGNATURE[:1]:
        raise Broken("signature")
    try:
        stream = inflated()
        found, size = _gathered(stream)
        total = len(b"".join(stream))  # what is left: nothing, but it brings the checksum
    except zlib.error as e:
        raise Broken("checksum" if "check" in str(e) else "inflate") from None
    if total:
        raise Broken("length")
    found.start, found.end = at, at + used
    return found


def read_plain(source: Source, at: int) -> Record:
    """The record that begins at ``at`` of a file without compression."""
    found, size = _gathered(source.pieces(at))
    found.start, found.end = at, at + size
    return found


def salvage(source: Source) -> Iterator[Record | Gap]:
    """Every record of ``source`` that passes its checks, and the gaps between, in order."""
    packed = next(source.pieces(0), b"")[:2] != b"WA"
    if packed and source.find(0, SIGNATURE) == source.size:
        packed = False
    read: Callable[[Source, int], Record] = read_member if packed else read_plain
    sign = SIGNATURE if packed else b"\nWARC/1."
    at, gap, reason = 0, None, ""
    while at < source.size:
        try:
            found = read(source, at)
        except Broken as e:
            if gap is None:
                gap, reason = at, str(e)
            at = source.find(at + 1, sign) if packed else source.find(at, sign) + 1
            continue
        if gap is not None:
            yield Gap(gap, at, reason)
            gap = None
        yield found
        at = found.end
    if gap is not None:
        yield Gap(gap, source.size, reason)


def _digest_of(found: Record) -> str | None:
    """Lower-case hex of the payload's SHA-256: of the payload itself, or of a revisit's header."""
    if found.payload is not None:
        return hashlib.sha256(found.payload).hexdigest()
    method, _, digest = found.headers.get("warc-payload-digest", "").partition(":")
    if method.lower() != "sha256":
        return None
    if len(digest) == 64:
        return digest.lower()
    return base64.b32decode(digest + "=" * (-len(digest) % 8)).hex()


def read_archives(archives: DataFrame, payloads: bool = True) -> tuple[DataFrame, DataFrame]:
    """(records, gaps) of the files in column ``path`` of ``archives``. Records: path, start, end,
    record_type, record_id, key, url, payload_bytes and payload_digest (of a revisit: null bytes, the
    digest it names), refers_to, refers_to_key, payload (null without ``payloads``). Gaps: path, start,
    end, reason. Both come from one table that is written."""
    names = [c.split()[0] for c in _RECORDS.split(", ")]

    def rows_of(path: str) -> Iterator[tuple]:
        store, place = pyarrow.fs.FileSystem.from_uri(_uri(path))
        with store.open_input_file(place) as file:
            for x in salvage(Source(file, file.size())):
                if isinstance(x, Gap):
                    yield path, x.start, x.end, *[None] * 8, x.reason, None
                    continue
                get = x.headers.get
                yield (path, x.start, x.end, x.kind, get("warc-record-id"), get("x-key"),
                       get("warc-target-uri"), None if x.payload is None else len(x.payload), _digest_of(x),
                       get("warc-refers-to"), get("x-refers-to-key"), None,
                       x.payload if payloads else None)

    def work(files: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), pa.int64(), pa.int64(), *[pa.string()] * 4, pa.int64(), *[pa.string()] * 4,
                 pa.binary()]

        def table(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

        for batch in files:
            for path in batch.column(0).to_pylist():
                rows, size = [], 0
                for row in rows_of(path):
                    rows.append(row)
                    size += len(row[-1] or b"") + 200
                    if size >= ARCHIVE // 4:
                        yield table(rows)
                        rows, size = [], 0
                if rows:
                    yield table(rows)

    # one archive after the other in a task, as many tasks as a cluster may have use for
    files = archives.select("path").repartition(max(1, min(archives.count(), MOST_TASKS)))
    found = written(batches(files, work, _RECORDS))
    return (found.where("gap IS NULL").drop("gap"),
            found.where("gap IS NOT NULL").select("path", "start", "end", F.col("gap").alias("reason")))


def resolved(records: DataFrame) -> DataFrame:
    """The responses and revisits of ``records``; a revisit gets the payload's bytes from the response it
    refers to (null where that is in a gap). One response counts where several have one id."""
    pages = records.where("record_type IN ('response', 'revisit')")
    revisits = pages.where("record_type = 'revisit'").drop("payload_bytes")
    wanted = written(revisits.groupBy("refers_to").agg(F.count("*").alias("n")).drop("n"))
    answers = written(pages.where("record_type = 'response'").join(
        small(wanted).withColumnRenamed("refers_to", "record_id"), "record_id", "left_semi").groupBy(
        F.col("record_id").alias("refers_to")).agg(F.max("payload_bytes").alias("payload_bytes")))
    return revisits.join(small(answers), "refers_to", "left").select(pages.columns).union(
        pages.where("record_type = 'response'"))
