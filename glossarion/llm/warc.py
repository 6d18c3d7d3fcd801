"""WARC archives: written through Spark's own file commit, read back by byte ranges.

Each record is a gzip member of its own. A reading task owns the records that start inside its byte
range: it scans for gzip magic, takes a member whose decoded head is a WARC header, and from there goes
from member to member, past the range's end only for the last record's rest.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MAGIC = b"\x1f\x8b\x08"
#: Payloads below this size are written in full each time.
LEAST_SHARED = 100
_CHUNK = 1 << 20
#: An empty member, which ends in zero bytes like any member of under 16 MB.
_EMPTY = zlib.compressobj(9, zlib.DEFLATED, 31).flush()
_DATE = "2000-01-01T00:00:00Z"


def record(fields: list[tuple[str, str]], block: bytes) -> bytes:
    """A WARC/1.1 record as one gzip member; it ends in a zero byte (if need be, of an empty member after it)."""
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + f"Content-Length: {len(block)}\r\n\r\n"
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    member = z.compress(head.encode() + block + b"\r\n\r\n") + z.flush()
    return member if member[-1] == 0 else member + _EMPTY


def record_id(page_id: int | None) -> str:
    """A record's URN from a 64-bit id; null has one of its own."""
    n = (1 << 64) if page_id is None else page_id & ((1 << 64) - 1)
    h = f"{n:032x}"
    return f"<urn:uuid:{h[:8]}-{h[8:12]}-{h[12:16]}-{h[16:20]}-{h[20:]}>"


def id_of(urn: str) -> int | None:
    n = int(urn[len("<urn:uuid:") : -1].replace("-", ""), 16)
    return None if n >> 64 else n - (1 << 64) if n >> 63 else n


def page_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    fields = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", record_id(page_id)),
        ("WARC-Date", _DATE),
        ("WARC-Payload-Digest", f"sha256:{digest}"),
        ("X-Payload-Length", str(len(payload))),
    ]
    if url is not None:
        clean = "".join(f"%{b:02X}" if b <= 32 or b >= 127 else chr(b) for b in url.encode())
        fields.append(("WARC-Target-URI", clean))
    if revisit:
        fields += [("WARC-Refers-To", record_id(refers_to)), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    return record([*fields, ("Content-Type", "application/http;msgtype=response")], http + (b"" if revisit else payload))


def plan(pages: DataFrame) -> DataFrame:
    """pages (page_id, url, html) with payload binary, payload_digest, revisit boolean and refers_to.

    Of the rows whose payloads of LEAST_SHARED bytes or more are equal, that with the smallest page_id is the
    response and the others revisit it; of repeated rows with that id, each is a response. Digests are
    counted before the shuffle; the join's two sides are keyed differently from the aggregate, so that
    Spark shuffles both for the join and can split a payload that many pages share.
    """
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    pages = pages.select("page_id", "url", payload.alias("payload")).withColumn("payload_digest", F.sha2("payload", 256))
    large = F.octet_length("payload") >= LEAST_SHARED
    first = pages.filter(large & F.col("page_id").isNotNull()).groupBy(F.unhex("payload_digest").alias("d")).agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    first = first.filter("n > 1").select(F.lower(F.hex("d")).alias("k"), "first")
    joined = pages.withColumn("k", F.when(large, F.col("payload_digest")).otherwise(F.concat(F.lit("small "), F.coalesce(F.col("page_id").cast("string"), F.lit("")))))
    revisit = F.coalesce((F.col("first") != F.col("page_id")) | F.col("page_id").isNull() & F.col("first").isNotNull(), F.lit(False))
    return joined.join(first, "k", "left").select("page_id", "url", "payload", "payload_digest", revisit.alias("revisit"), F.when(revisit, F.col("first")).alias("refers_to"))


def write(pages: DataFrame, folder: str) -> None:
    """Write a record per row of pages (page_id bigint, url, html) into archives in folder, one per task.

    The text sink writes a record's bytes, and its line separator is the zero byte in which each record
    ends; so the files are plain concatenations of gzip members, under Spark's commit protocol. Null html
    counts as empty; null ids and urls are kept as such; an empty table writes no record.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 64):
                rows = batch.slice(i, 64).to_pylist()
                yield pa.RecordBatch.from_arrays([pa.array([page_record(r["page_id"], r["url"], r["payload"], r["payload_digest"], r["refers_to"], r["revisit"])[:-1] for r in rows], pa.binary())], names=["value"])

    plan(pages).mapInArrow(run, "value binary").select(F.col("value").cast("string").alias("value")).write.option("lineSep", "\u0000").text(folder)


class _Range:
    """Bytes of a file from an offset on, read in chunks."""

    def __init__(self, path: str):
        from pyarrow import fs

        store, name = fs.FileSystem.from_uri(path)
        self.file, self.size = store.open_input_file(name), store.get_file_info(name).size
        self.start, self.window = 0, b""

    def read(self, at: int, n: int) -> bytes:
        """Up to n bytes at an offset, from a window of the file that is read once."""
        at_end = min(at + n, self.size)
        if at >= at_end:
            return b""
        if at < self.start or at_end > self.start + len(self.window):
            self.start, self.window = at, self.file.read_at(min(max(n, _CHUNK), self.size - at), at)
        return self.window[at - self.start : at_end - self.start]


def member(source: _Range, at: int, head_only: bool = False) -> tuple[bytes, int] | None:
    """The member at an offset, decoded, and where it ends; None if there is none. head_only: its first bytes will do.

    Compressed bytes are fed in small, then larger pieces, as what is fed beyond the end is copied back.
    """
    z, out, pos, piece = zlib.decompressobj(31), [], at, 4096
    try:
        while not z.eof:
            chunk = source.read(pos, piece)
            if not chunk:
                return None
            got = z.decompress(chunk, 64) if head_only else z.decompress(chunk)
            out.append(got)
            pos += len(chunk)
            piece = min(2 * piece, _CHUNK)
            if head_only and (got or z.eof):
                return b"".join(out), pos
    except zlib.error:
        return None
    return b"".join(out), pos - len(z.unused_data)


def _next(source: _Range, at: int) -> int:
    """Where the next member with content starts, from the end of a member on: empty ones are passed over."""
    while at < source.size:
        head = member(source, at, head_only=True)
        if head is None or head[0]:
            break
        at = member(source, at)[1]
    return at


def records(path: str, start: int, end: int) -> Iterator[tuple[int, bytes | None]]:
    """(offset, decoded record) of the records that start in [start, end) of a file; None for a damaged one.

    A range that starts inside a record looks for the next header. A header that is itself damaged can't
    be found so; therefore a range whose last record ends in another one looks at what follows there, and
    reports it if it is no header. The bytes after a damaged record are searched for the next header.
    """
    source, at, synced = _Range(path), start, start == 0
    end = min(end, source.size)
    while at < end:
        if not synced:  # the next offset with gzip magic whose member decodes to a WARC header
            chunk = source.read(at, min(_CHUNK, end - at) + len(MAGIC) - 1)
            hit = chunk.find(MAGIC)
            if hit < 0 or at + hit >= end:
                at += max(1, len(chunk) - len(MAGIC) + 1)
                continue
            at += hit
            head = member(source, at, head_only=True)
            if head is None or not head[0].startswith(b"WARC/1."):
                at += 1
                continue
        found = member(source, at)
        if found is None or found[0] and not found[0].startswith(b"WARC/1."):
            yield at, None
            at, synced = at + 1, False
            continue
        if found[0]:
            yield at, found[0]
        at, synced = found[1], True
    if synced and end <= at < source.size:
        at = _next(source, at)
        head = member(source, at, head_only=True) if at < source.size else (b"WARC/1.", at)
        if head is None or not head[0].startswith(b"WARC/1."):
            yield at, None


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields (lower-case names) and the block of a decoded record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in head.decode("utf-8", "replace").split("\r\n")[1:])}
    return fields, rest[: int(fields.get("content-length", len(rest)))]


RECORD = "page_id bigint, url string, payload binary, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, path string, offset bigint"


def _row(path: str, offset: int, data: bytes) -> tuple:
    """A decoded record as a row of RECORD."""
    fields, block = parse(data)
    kind, stated = fields.get("warc-type"), fields.get("warc-payload-digest", "")
    body = block.partition(b"\r\n\r\n")[2] if kind == "response" else None
    digest = stated.removeprefix("sha256:") if stated.startswith("sha256:") else None
    if body is not None and digest is not None and hashlib.sha256(body).hexdigest() != digest:
        raise ValueError(f"{path}: payload of {fields.get('warc-record-id')} doesn't match its digest")
    own, refers, size = fields.get("warc-record-id"), fields.get("warc-refers-to"), fields.get("x-payload-length")
    return (id_of(own) if own else None, fields.get("warc-target-uri"), body, int(size) if size else None if body is None else len(body), digest, kind, id_of(refers) if refers else None, path, offset)


def read(spark: SparkSession, folder: str, range_bytes: int = 32 << 20, damaged: str = "raise") -> DataFrame:
    """The records of all archives in folder (see RECORD), by byte ranges of at most range_bytes.

    payload is what the record itself holds, null for a revisit; payload_bytes and payload_digest are of
    the full payload. A response's digest is computed anew, and a mismatch raises an error. So does a
    record that can't be decoded, with its file and offset; damaged="report" gives a row for it instead,
    of record_type `damaged`, and its path and offset. Files without records give no rows.
    """
    if damaged not in ("raise", "report"):
        raise ValueError(f"damaged must be raise or report, not {damaged!r}")
    ranges = (
        spark.read.format("binaryFile")
        .load(folder)
        .select("path", "length")
        .select("path", F.explode(F.sequence(F.lit(0).cast("bigint"), F.greatest(F.col("length") - 1, F.lit(0)), F.lit(range_bytes).cast("bigint"))).alias("start"))
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows, held = [], 0
                for offset, data in records(path, start, start + range_bytes):
                    if data is None and damaged == "raise":
                        raise ValueError(f"{path}: damaged record at offset {offset}")
                    rows.append(_row(path, offset, data) if data is not None else (None,) * 5 + ("damaged", None, path, offset))
                    held += len(rows[-1][2] or b"")
                    if held > 4 << 20 or len(rows) >= 1000:
                        yield _rows(rows)
                        rows, held = [], 0
                yield _rows(rows)

    return ranges.repartition("path", "start").mapInArrow(run, RECORD)


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64())
    names = [c.split()[0] for c in RECORD.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)
