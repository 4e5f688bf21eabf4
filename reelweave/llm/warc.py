"""WARC archives: a writer with revisit records and a salvage reader.

Writing. Each task writes its rows to archives of about ``ARCHIVE_BYTES``, one gzip
member per record, under names of its own attempt, in a folder that all executors share;
only names in the manifest, which Spark commits exactly once, are archives, so an attempt
that was lost leaves nothing behind that is read. Of pages with equal payloads of at
least ``REVISIT_BYTES`` bytes the one with the least id is a ``response`` and the others
are ``revisit`` records that carry its digest and length, not its bytes.

Reading. Archives are streams of gzip members or plain records. A member must inflate
with the right checksum; a record needs a version line, a length, its closing blank lines
and the digests it states. Where a check fails, the reader looks for the next offset at
which a valid record begins (a gzip magic whose member opens with a version line, or a
version line), recovers from there, and reports the bytes between as a quarantined gap.
Of a member that fails, the records before the first one that is damaged or cut are rows
if they state a block digest; if all its records pass and only its checksum does not, the
place of the damage is unknown and all of it is a gap. At most one member is in memory.

Nulls: a null html is the empty payload, always a response. A null page id is written as
such and always a response. Rows that repeat an id and payload are all responses if the
id is the least. An empty table writes nothing and reads nothing. Other columns do not
matter.
"""

from __future__ import annotations

import hashlib
import io
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelweave.llm.common import cut_lineage
from reelweave.session import shared_folder

#: Bytes of archives that one task reads, about.
READ_BYTES = 64 << 20
ARCHIVE_BYTES = 8 << 20
REVISIT_BYTES = 100
LEVEL = 1
CHUNK = 1 << 16
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD_URI = "urn:x-page:"
VERSION = b"WARC/1."
MAGIC = b"\x1f\x8b\x08"
RECORDS = (
    "archive string, kind string, start long, stop long, reason string, record_type string, record_id string, "
    "target_uri string, refers_to string, payload_digest string, payload_bytes long, payload binary"
)


def open_uri(uri: str, mode: str):
    """A stream in any store that Arrow knows; a bare path is local."""
    store, path = fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:/") else (fs.LocalFileSystem(), uri)
    if mode == "w":
        store.create_dir(path.rpartition("/")[0], recursive=True)
        return store.open_output_stream(path, compression=None)
    return store.open_input_file(path)


# records


def _id(page_id: int | None) -> str:
    return f"<{RECORD_URI}{'none' if page_id is None else page_id}>"


def page_of(record_id: str | None) -> int | None:
    tail = (record_id or "").strip("<>").removeprefix(RECORD_URI)
    return int(tail) if tail.lstrip("-").isdigit() else None


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str) -> bytes:
    """The bytes of one record, not compressed."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {_id(page_id)}",
        f"WARC-Date: {date}",
        "Content-Type: application/http; msgtype=response",
        f"WARC-Payload-Digest: sha256:{hashlib.sha256(payload).hexdigest()}",
        f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}",
        f"Content-Length: {len(block)}",
    ]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    if refers_to is not None:
        head += [f"WARC-Refers-To: {_id(refers_to)}", f"WARC-Profile: {PROFILE}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(data: bytes, level: int = LEVEL) -> bytes:
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


# writing


def with_revisits(pages: DataFrame) -> DataFrame:
    """``pages`` with ``refers_to``: the response's id where the page only repeats it.

    Digests travel without the payloads; the pages that repeat others are a stored table,
    whose known size decides how it is joined.
    """
    html = F.coalesce("html", F.lit(""))
    narrow = pages.where(F.col("page_id").isNotNull() & (F.octet_length(html) >= REVISIT_BYTES))
    narrow = narrow.select("page_id", F.unhex(F.sha2(html.cast("binary"), 256)).alias("digest"))
    first = narrow.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.max("page_id").alias("last")).where("last > refers_to")
    again = cut_lineage(narrow.join(first, "digest").where("page_id > refers_to").select("page_id", "refers_to").distinct())
    return pages.select("page_id", "url", "html").join(again, "page_id", "left")


def write_warc(pages: DataFrame, folder: str, *, date: str = "2024-01-01T00:00:00Z", archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes ``pages (page_id, url, html, refers_to)``; returns the manifest, a stored table."""

    def tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, name, size, count = None, "", 0, 0

        def closed() -> pa.RecordBatch:
            out.close()
            return pa.RecordBatch.from_pydict({"archive": [name], "records": pa.array([count], pa.int64()), "bytes": pa.array([size], pa.int64())})

        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                for page_id, url, html, refers_to in zip(*(c.to_pylist() for c in batch.slice(start, 256).columns)):
                    if out is None:
                        name, size, count = f"{folder}/{uuid.uuid4().hex}.warc.gz", 0, 0
                        out = open_uri(name, "w")
                    data = member(record(page_id, url, (html or "").encode(), refers_to, date))
                    out.write(data)
                    size += len(data)
                    count += 1
                    if size >= archive_bytes:
                        yield closed()
                        out = None
        if out is not None:
            yield closed()

    rows = pages.select(F.col("page_id").cast("long"), "url", "html", F.col("refers_to").cast("long"))
    return cut_lineage(rows.mapInArrow(tasks, "archive string, records long, bytes long"))


# reading


class Damage(Exception):
    """A record or member failed a check; ``data`` is what was inflated before."""

    data = b""


class Archive:
    """A seekable archive read piece by piece."""

    def __init__(self, stream):
        self.stream = stream
        self.size = stream.size() if callable(getattr(stream, "size", None)) else stream.seek(0, io.SEEK_END)

    def at(self, offset: int, n: int) -> bytes:
        self.stream.seek(offset)
        return self.stream.read(n)

    def find(self, mark: bytes, start: int) -> int:
        """First offset of ``mark`` from ``start``, or the size."""
        while start < self.size:
            piece = self.at(start, CHUNK + len(mark) - 1)
            here = piece.find(mark)
            if here >= 0:
                return start + here
            start += CHUNK
        return self.size

    def inflate(self, offset: int, most: int | None = None) -> tuple[bytes, int]:
        """The member at ``offset`` and where it ends; at most ``most`` bytes if given."""
        z = zlib.decompressobj(31)
        parts, total, pos = [], 0, offset
        try:
            while not z.eof:
                piece = self.at(pos, CHUNK)
                if not piece:
                    raise zlib.error("truncated")
                data = z.decompress(piece, 0 if most is None else max(1, most - total))
                parts.append(data)
                total += len(data)
                pos += len(piece)
                if most is not None and total >= most:
                    return b"".join(parts), pos
        except zlib.error as e:
            damage = Damage(f"member: {e}")
            damage.data = b"".join(parts) if most is not None else self._before(offset, pos)
            raise damage from None
        return b"".join(parts), pos - len(z.unused_data)

    def _before(self, offset: int, last: int) -> bytes:
        """What the member at ``offset`` inflates to before the error in the piece at ``last``."""
        z = zlib.decompressobj(31)
        parts = [z.decompress(self.at(pos, CHUNK)) for pos in range(offset, last, CHUNK)]
        try:
            for byte in self.at(last, CHUNK):
                parts.append(z.decompress(bytes([byte])))
        except zlib.error:
            pass
        return b"".join(parts)


def parse(data: bytes) -> tuple[dict[str, str], bytes, int]:
    """Headers, block and length of the record at the start of ``data``, all checks made."""
    if not data.startswith(VERSION):
        raise Damage("no version line")
    end = data.find(b"\r\n\r\n")
    if end < 0:
        raise Damage("headers do not end")
    headers = {}
    for line in data[:end].decode("utf-8", "replace").split("\r\n")[1:]:
        name, colon, value = line.partition(":")
        if not colon:
            raise Damage("header line without a colon")
        headers[name.strip().lower()] = value.strip()
    if not headers.get("content-length", "").isdigit():
        raise Damage("no content length")
    stop = end + 4 + int(headers["content-length"])
    block = data[end + 4 : stop]
    if data[stop : stop + 4] != b"\r\n\r\n":
        raise Damage("record does not end where its length says")
    _match(headers.get("warc-block-digest"), block, "block digest")
    return headers, block, stop + 4


def _match(stated: str | None, data: bytes, what: str) -> None:
    if stated and stated.startswith("sha256:") and stated != "sha256:" + hashlib.sha256(data).hexdigest():
        raise Damage(what)


def _row(headers: dict[str, str], block: bytes) -> dict:
    """What a record says of its page."""
    http, _, payload = block.partition(b"\r\n\r\n")
    kind = headers.get("warc-type", "")
    length = len(payload)
    if kind == "revisit":
        for line in http.split(b"\r\n"):
            name, _, value = line.partition(b":")
            if name.strip().lower() == b"content-length" and value.strip().isdigit():
                length = int(value)
    else:
        if "http" not in headers.get("content-type", ""):
            payload = block
            length = len(block)
        _match(headers.get("warc-payload-digest"), payload, "payload digest")
    digest = headers.get("warc-payload-digest", "").removeprefix("sha256:") or hashlib.sha256(payload).hexdigest()
    return {
        "record_type": kind,
        "record_id": headers.get("warc-record-id"),
        "target_uri": headers.get("warc-target-uri"),
        "refers_to": headers.get("warc-refers-to"),
        "payload_digest": digest,
        "payload_bytes": length,
        "payload": payload,
    }


def _plain(archive: Archive, pos: int) -> tuple[dict, int]:
    """The uncompressed record at ``pos`` and where it ends."""
    head = bytearray()
    while (end := head.find(b"\r\n\r\n", max(0, len(head) - CHUNK - 3))) < 0:
        more = archive.at(pos + len(head), CHUNK)
        head += more
        if not more or not head.startswith(VERSION):
            raise Damage("no record")
    length = next((int(v) for n, _, v in (x.partition(b":") for x in bytes(head[:end]).split(b"\r\n")) if n.strip().lower() == b"content-length" and v.strip().isdigit()), None)
    if length is None or pos + end + 8 + length > archive.size:
        raise Damage("no usable content length")
    headers, block, used = parse(archive.at(pos, end + 8 + length))
    return _row(headers, block), pos + used


def _at(archive: Archive, pos: int) -> tuple[list[dict], int, str | None]:
    """The records that begin at ``pos``, where the member or record ends, and why the rest of a member is lost."""
    if archive.at(pos, 3) != MAGIC:
        row, stop = _plain(archive, pos)
        return [row], stop, None
    reason = None
    try:
        data, stop = archive.inflate(pos)
    except Damage as e:
        data, stop, reason = e.data, pos + 1, str(e)
    rows, used, sound = [], 0, reason is None
    while used < len(data):
        try:
            headers, block, n = parse(data[used:] if used else data)
            if not sound and not headers.get("warc-block-digest", "").startswith("sha256:"):
                raise Damage("no digest in a damaged member")
            rows.append(_row(headers, block))
        except Damage as e:
            if not rows:
                raise Damage(reason or str(e)) from None
            return rows, stop, reason or str(e)
        used += n
    if reason or not rows:
        raise Damage(reason or "empty member")
    return rows, stop, None


def _opens(archive: Archive, pos: int) -> bool:
    """Whether a member or record plausibly begins here: a cheap look before the checks."""
    if archive.at(pos, 3) != MAGIC:
        return archive.at(pos, len(VERSION)) == VERSION
    try:
        return archive.inflate(pos, len(VERSION))[0].startswith(VERSION)
    except Damage:
        return False


def salvage(stream) -> Iterator[dict]:
    """Rows of an archive in order: ``kind`` is ``record`` or ``gap``, with offsets."""
    archive = Archive(stream)
    pos = 0
    while pos < archive.size:
        try:
            rows, stop, reason = _at(archive, pos)
        except Damage as e:
            rows, reason = [], str(e)
        if reason is None:
            for row in rows:
                yield {"kind": "record", "start": pos, "stop": stop, **row}
            pos = stop
            continue
        kept, rows, stop = rows, [], pos + 1
        while stop < archive.size:
            stop = min(archive.find(MAGIC, stop), archive.find(VERSION, stop))
            if stop >= archive.size:
                break
            if _opens(archive, stop):
                try:
                    _at(archive, stop)
                    break
                except Damage as e:
                    reason = f"{reason}; at {stop}: {e}" if len(reason) < 300 else reason
            stop += 1
        for row in kept:
            yield {"kind": "record", "start": pos, "stop": min(stop, archive.size), **row}
        yield {"kind": "gap", "start": pos, "stop": min(stop, archive.size), "reason": reason}
        pos = stop


def read_warc(archives: DataFrame, *, with_payload: bool = True, counted: bool = False) -> DataFrame:
    """Records and gaps of the archives named in column ``archive``; columns of ``RECORDS``.

    A task reads about ``READ_BYTES`` where column ``bytes`` tells sizes, else one archive. With
    ``counted``, an archive that has a gap or not as many records as column
    ``records`` says fails the read.
    """

    def tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([(n, {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}[t]) for n, t in (c.strip().split(" ") for c in RECORDS.split(","))])
        for batch in batches:
            stated = batch.column("records").to_pylist() if counted else [None] * batch.num_rows
            for name, records in zip(batch.column("archive").to_pylist(), stated):
                rows, size, count = [], 0, 0
                with open_uri(name, "r") as stream:
                    for row in salvage(stream):
                        if counted and row["kind"] == "gap":
                            raise ValueError(f"{name}: damaged at {row['start']}: {row['reason']}")
                        count += 1
                        payload = row.pop("payload", None) if not with_payload else row.get("payload")
                        rows.append({"archive": name, **row})
                        size += len(payload or b"") if with_payload else 200
                        if size >= 4 << 20:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows, size = [], 0
                if counted and count != records:
                    raise ValueError(f"{name}: {count} records read, {records} written")
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    # as many tasks as the archives' bytes ask for: the rows that name them are tiny
    measured = "bytes" in archives.columns
    size = archives.agg(F.count("*").alias("n"), (F.sum("bytes") if measured else F.count("*") * READ_BYTES).alias("bytes")).head()
    few = 2 * archives.sparkSession.sparkContext.defaultParallelism
    n = max(1, min(size["n"], max(few, -(-(size["bytes"] or 0) // READ_BYTES))))
    return archives.select("archive", *["records"] * counted).repartition(n, "archive").mapInArrow(tasks, RECORDS)


def round_trip(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """Writes all pages to archives in the shared folder and reads them back; fails if a record does not come back."""
    folder = f"{shared_folder(spark).rstrip('/')}/warc-{uuid.uuid4().hex}"
    manifest = write_warc(with_revisits(pages), folder)
    page = F.regexp_extract(F.col("record_id"), RECORD_URI + r"(-?\d+)>", 1)
    source = F.regexp_extract(F.col("refers_to"), RECORD_URI + r"(-?\d+)>", 1)
    rows = read_warc(manifest, with_payload=False, counted=True)
    return rows.select(
        F.nullif(page, F.lit("")).cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.nullif(source, F.lit("")).cast("long").alias("refers_to")
    )


def oracle() -> str:
    return f"""WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, octet_length(b)::BIGINT AS payload_bytes, sha256(b) AS payload_digest FROM p),
f AS (SELECT payload_digest, min(page_id) AS first FROM d WHERE payload_bytes >= {REVISIT_BYTES} GROUP BY payload_digest)
SELECT page_id, payload_bytes, d.payload_digest, CASE WHEN page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id > first THEN first END AS refers_to FROM d LEFT JOIN f USING (payload_digest)"""
