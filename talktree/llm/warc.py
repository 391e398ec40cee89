"""WARC archives: write, read back, and an external index merge into capture histories.

Payloads that occur before are written as revisits.  The archives are WARC/1.1 files, each record a
gzip member of its own, so a capture's offset and length are where to seek in the file.  Each file starts
with a warcinfo record and ends when it holds enough bytes, however large its records are.  Spark's text
writer makes the files and its binary reader reads them, so they can lie in any store that Spark reaches.

Each archive gives a capture run, sorted by URL key and time.  Runs are cut at common key bounds and
dealt by range unsorted; each range's pieces of runs are merged by a loser tree, which gives globally
ordered capture histories.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import Scratch

#: Of a WARC file.
_END = "\r\n\r\n"
#: What a gzip member holds at most here, so that its last byte, the high one of its size, is zero.
_MEMBER = (1 << 24) - 1
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


@dataclass(frozen=True)
class WarcParams:
    """``file_bytes``: about how much one archive holds, uncompressed; ``merge_rows``: captures in one merged range."""

    file_bytes: int = 16 << 20
    compression: str = "gzip"
    merge_rows: int = 50_000
    min_revisit_bytes: int = 0
    first_second: int = 1_704_067_200


def url_key(url: str | None) -> str:
    """Sort-friendly form: host labels reversed, then path and query; lower case host, no scheme or port 80/443."""
    if not url:
        return ""
    try:
        parts = urlsplit(url.strip())
        host, port = (parts.hostname or "").lower(), parts.port
    except ValueError:
        return url
    if not host:
        return url
    labels = host.split(".")
    if labels[0] == "www":
        labels = labels[1:]
    key = ",".join(reversed(labels)) + (f":{port}" if port and port not in (80, 443) else "") + ")" + (parts.path or "/")
    return key + (f"?{parts.query}" if parts.query else "")


class LoserTree:
    """Merges sorted iterators: each inner node holds the loser of its match, the root's place the winner."""

    def __init__(self, runs: list[Iterator[tuple]]):
        self.runs = runs
        self.head: list[tuple | None] = [next(r, None) for r in runs]
        self.k = len(runs)
        self.tree = [-1] * max(self.k, 1)
        for i in range(self.k):
            self._replay(i)

    def _beats(self, a: int, b: int) -> bool:
        x, y = self.head[a], self.head[b]
        if x is None or y is None:
            return y is None and (x is not None or a < b)
        return (x, a) < (y, b)

    def _replay(self, i: int) -> None:
        """Plays leaf i up to the root; an empty place takes the first that comes."""
        node = (i + self.k) // 2
        while node > 0:
            other = self.tree[node]
            if other < 0:
                self.tree[node] = i
                return
            if self._beats(other, i):
                self.tree[node], i = i, other
            node //= 2
        self.tree[0] = i

    def __iter__(self) -> Iterator[tuple]:
        while self.k:
            i = self.tree[0]
            top = self.head[i]
            if top is None:
                return
            yield top
            self.head[i] = next(self.runs[i], None)
            self._replay(i)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        raw = [(x or "").encode("utf-8") for x in batch.column(2).to_pylist()]
        digest = [base64.b32encode(hashlib.sha1(x).digest()).decode() for x in raw]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([len(x) for x in raw], pa.int64()), pa.array(digest)], ["id", "url", "html", "tag", "bytes", "digest"])


def _record_id(*parts: Column) -> Column:
    h = F.md5(F.concat_ws("/", *parts).cast("binary"))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.substring(h, 13, 4), F.substring(h, 17, 4), F.substring(h, 21, 12)), F.lit(">"))


def _page_record(page: Column) -> Column:
    """The record of a page with some payload; a revisit names the one it refers to by this."""
    return _record_id(F.lit("page"), page.cast("string"), F.col("digest"), F.col("bytes").cast("string"))


def _warcinfo(first: bytes) -> bytes:
    """The record before an archive's records, with an id of its own that follows from the first of them."""
    name = uuid.UUID(bytes=hashlib.md5(b"warcinfo/" + first).digest())
    body = "software: talktree\r\nformat: WARC File Format 1.1\r\n"
    head = f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:{name}>\r\nWARC-Date: 2024-01-01T00:00:00Z\r\nContent-Type: application/warc-fields\r\nContent-Length: {len(body)}\r\n\r\n"
    return (head + body).encode()


def _archives(file_bytes: int, packed: bool):
    """Records to archives, a row for each, of about ``file_bytes`` of records, or of one longer record.

    The last bytes, which the writer puts back as its line end, are left out: a zero, or the end of a record.
    """
    end = _END.encode()

    def archive(parts: list[bytes]) -> pa.RecordBatch:
        whole = b"".join(parts)
        return pa.RecordBatch.from_arrays([pa.array([whole[:-1] if packed else whole[: -len(end)]], pa.binary())], ["value"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[bytes] = []
        held = 0
        form = gzip_record if packed else bytes
        for batch in batches:
            for value in batch.column(0):
                record = value.as_buffer().to_pybytes()
                if parts and held + len(record) > file_bytes:
                    yield archive(parts)
                    parts, held = [], 0
                if not parts:
                    parts.append(form(_warcinfo(record[:2048]) + end))
                parts.append(form(record + end))
                held += len(record)
        if parts:
            yield archive(parts)

    return run


def write_archives(pages: DataFrame, folder: str, params: WarcParams | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> None:
    """Writes a response or revisit record for each row to WARC files in ``folder``.

    Of rows with equal payloads of at least ``min_revisit_bytes``, the smallest id is the response
    and the others refer to it; rows without an id, and repeats of the smallest, are responses.  No two
    records have one id, rows that repeat each other included; a revisit names the record of one of them.
    Compressed files hold a gzip member for each record, though Spark's writer names them ``.txt``.
    """
    p = params or WarcParams()
    if p.compression not in ("gzip", "none"):
        raise ValueError(f"compression is gzip or none, not {p.compression}")
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"), F.monotonically_increasing_id().alias("tag"))
    rows = rows.mapInArrow(_digests, "id long, url string, html string, tag long, bytes long, digest string")
    own = rows.where("id is not null").groupBy("digest", "bytes", "id").agg(F.min("tag").alias("one"))
    first = own.where(F.col("bytes") >= p.min_revisit_bytes).groupBy("digest", "bytes").agg(F.min("id").alias("first"))
    rows = rows.join(own.join(first, ["digest", "bytes"], "left"), ["digest", "bytes", "id"], "left")
    lone = F.coalesce(F.col("tag") == F.col("one"), F.lit(False))
    record = F.when(lone, _page_record(F.col("id"))).otherwise(_record_id(F.lit("row"), F.col("tag").cast("string"), F.col("digest")))
    revisit = (F.col("id") > F.col("first")) & (F.col("bytes") >= p.min_revisit_bytes)
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    clean = F.regexp_replace(F.coalesce("url", F.lit("")), r"[\r\n]", "%0A")
    date = F.date_format(F.timestamp_seconds(F.lit(p.first_second) + F.pmod(F.coalesce("id", F.lit(0)), F.lit(1_000_000_000))), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("bytes").cast("string"), F.lit("\r\n\r\n"))
    body = F.when(F.col("revisit"), http).otherwise(F.concat(http, F.coalesce("html", F.lit(""))))
    text = F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.when(F.col("revisit"), F.lit("revisit")).otherwise(F.lit("response"))),
        line("WARC-Record-ID", record),
        line("WARC-Date", date),
        line("WARC-Target-URI", clean),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        line("X-Page-Id", F.coalesce(F.col("id").cast("string"), F.lit(""))),
        line("X-Payload-Length", F.col("bytes").cast("string")),
        F.when(F.col("url").isNull(), F.lit("X-No-URI: 1\r\n")).otherwise(F.lit("")),
        F.when(F.col("revisit"), F.concat(line("WARC-Profile", F.lit(_PROFILE)), line("WARC-Refers-To", _page_record(F.col("first"))), line("X-Refers-To-Page-Id", F.col("first").cast("string")))).otherwise(F.lit("")),
        line("Content-Type", F.lit("application/http;msgtype=response")),
        line("Content-Length", F.octet_length("body").cast("string")),
        F.lit("\r\n"),
        F.col("body"),
    )
    out = rows.withColumn("revisit", F.coalesce(revisit, F.lit(False))).withColumn("body", body)
    out = out.select(text.alias("value"))
    packed = p.compression == "gzip"
    out = out.mapInArrow(_archives(p.file_bytes, packed), "value binary").select(F.col("value").cast("string"))
    out.write.option("lineSep", "\0" if packed else _END).option("maxRecordsPerFile", 1).option("compression", "none").text(folder)


def gzip_record(record: bytes, limit: int = _MEMBER) -> bytes:
    """A record as a gzip member of its own; one above ``limit`` bytes as several members in a row."""
    return b"".join(gzip.compress(record[i : i + limit], mtime=0) for i in range(0, len(record), limit))


def _member(data: memoryview, at: int) -> tuple[bytes, int]:
    """The content of the gzip member that starts at ``at``, and where it ends."""
    inflate, out, step = zlib.decompressobj(31), [], 1 << 13
    while not inflate.eof:
        chunk = data[at : at + step]
        if not len(chunk):
            raise ValueError("the last gzip member has no end")
        out.append(inflate.decompress(chunk))
        at, step = at + len(chunk), step * 2
    return b"".join(out), at - len(inflate.unused_data)


def _headers(raw: bytes | bytearray, at: int = 0) -> tuple[dict[str, str], int] | None:
    """A record's headers and where its block starts; None if the headers have no end."""
    head = raw.find(b"\r\n\r\n", at)
    if not raw.startswith(b"WARC/", at):
        raise ValueError(f"no WARC record at byte {at}")
    if head < 0:
        return None
    return dict(line.split(": ", 1) for line in raw[at:head].decode("utf-8").split("\r\n")[1:]), head + 4


def _whole(record: bytearray) -> bool:
    found = _headers(record)
    return found is not None and len(record) >= found[1] + int(found[0]["Content-Length"]) + len(_END)


def read_archive(data: bytes) -> Iterator[tuple[int, int, dict[str, str], bytes]]:
    """As :func:`parse_archive`, of a plain or a record-wise compressed file; places are those in the file."""
    if data[:2] != b"\x1f\x8b":
        yield from parse_archive(data)
        return
    view, at = memoryview(data), 0
    while at < len(data):
        begin, record = at, bytearray()
        while not record or not _whole(record):
            part, at = _member(view, at)
            record += part
        for _, _, headers, block in parse_archive(bytes(record)):
            yield begin, at - begin, headers, block


def parse_archive(raw: bytes) -> Iterator[tuple[int, int, dict[str, str], bytes]]:
    """(offset, length, headers, block) of each record of an uncompressed WARC file's bytes."""
    at = 0
    while at < len(raw):
        found = _headers(raw, at)
        if found is None:
            raise ValueError(f"the headers at byte {at} have no end")
        headers, start = found
        end = start + int(headers["Content-Length"])
        if raw[end : end + 4] != b"\r\n\r\n":
            raise ValueError(f"the record at byte {at} has no end")
        yield at, end + 4 - at, headers, raw[start:end]
        at = end + 4


_CAPTURE = pa.schema(
    [("url_key", pa.string()), ("ts", pa.string()), ("page_id", pa.int64()), ("run", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("url", pa.string())]
    + [("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())]
)
_CAPTURE_SQL = "url_key string, ts string, page_id long, run string, offset long, length long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"


def _order(row: tuple) -> tuple:
    return (row[0], row[1], row[2] is not None, row[2] or 0, row[3], row[4])


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _CAPTURE)], schema=_CAPTURE)


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Archives (path, content) to their sorted capture runs; payloads are digested anew."""
    for batch in batches:
        for path, raw in zip(batch.column(0), batch.column(1)):
            name, rows = path.as_py().rsplit("/", 1)[-1], []
            data = raw.as_buffer().to_pybytes()
            for offset, length, h, block in read_archive(data):
                if h["WARC-Type"] not in ("response", "revisit"):
                    continue
                size, digest = int(h["X-Payload-Length"]), h["WARC-Payload-Digest"].removeprefix("sha1:")
                if h["WARC-Type"] == "response":
                    payload = block[block.index(b"\r\n\r\n") + 4 :]
                    if len(payload) != size or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
                        raise ValueError(f"{name}: the payload at byte {offset} is damaged")
                url = None if "X-No-URI" in h else h["WARC-Target-URI"]
                page, first = h["X-Page-Id"], h.get("X-Refers-To-Page-Id")
                rows.append((url_key(url), h["WARC-Date"], int(page) if page else None, name, offset, length, url, size, digest, h["WARC-Type"], int(first) if first else None))
            if rows:
                rows.sort(key=_order)
                yield _batch(rows)


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pieces of all runs in one key range to the merged captures.

    A shuffle hands pieces over one after another, mostly in their order; where a row is smaller than
    the one before it of its run, a further sorted piece begins, so any order of arrival is merged right.
    """
    pieces: list[list[tuple]] = []
    last: dict[str, list[tuple]] = {}
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            item, piece = (_order(row), row), last.get(row[3])
            if piece is None or item[0] < piece[-1][0]:
                piece = last[row[3]] = []
                pieces.append(piece)
            piece.append(item)
    out: list[tuple] = []
    for item in LoserTree([((k, n, r) for n, (k, r) in enumerate(piece)) for piece in pieces]):
        out.append(item[2])
        if len(out) >= 4096:
            yield _batch(out)
            out = []
    if out:
        yield _batch(out)


def read_captures(spark, folder: str, params: WarcParams | None = None) -> DataFrame:
    """All captures of the archives in ``folder``, ordered by URL key, time and page over the partitions."""
    p = params or WarcParams()
    scratch = Scratch(spark)
    files = spark.read.format("binaryFile").load(folder).where("length > 0").select("path", "content")
    runs = scratch.keep(files.mapInArrow(_runs, _CAPTURE_SQL), "runs")
    ranges = max(1, -(-runs.count() // p.merge_rows))
    return runs.repartitionByRange(ranges, "url_key", "ts", "page_id", "run", "offset").mapInArrow(_merge, _CAPTURE_SQL)


def archive_pages(pages: DataFrame, params: WarcParams | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Writes ``pages`` to WARC archives in the shared folder and returns the captures read back from them.

    A row for each page: ``id_col, payload_bytes, payload_digest, record_type, refers_to`` and the
    capture's place.  A null payload is an empty one, a null URL stays null; an empty table gives no
    rows.  Null ids are responses; repeated ids give a row each.  Other columns are not read.
    """
    folder = Scratch(pages.sparkSession).path("warc")
    write_archives(pages, folder, params, id_col, url_col, html_col)
    return read_captures(pages.sparkSession, folder, params).withColumnRenamed("page_id", id_col)
