"""Operator 2: WARC archives with revisit records, and capture histories by external index merge.

``assign`` gives each page its record: of pages with equal payloads of at least REVISIT_BYTES the one with the smallest
page_id is the response and the others revisit it. ``write_archives`` packs the records into WARC/1.1 files of gzip
members (one for each record), a binary row for each file of about ARCHIVE_BYTES. ``read_archives`` parses such files;
each is a run of index entries sorted by URL key and time. ``merge_runs`` deals the runs out by ranges of (URL key,
time, page) and merges, within each range, the runs' parts by a loser tree: the ranges in order are the global capture
history. A range is cut at (URL key, time, page), so a URL with very many captures spans several ranges.

Defined cases: null html is an empty payload; null url is an empty one, with an empty key; null page_id stays null and is
nobody's first unless all are; control characters in URLs are percent-encoded; rows of one page_id with equal payloads
are all responses if it is the smallest; an empty table gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

import gzip
import hashlib
import zlib
from collections.abc import Iterable, Iterator
from datetime import UTC, datetime, timedelta
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, small_batches

REVISIT_BYTES = 100
ARCHIVE_BYTES = 4 << 20
#: Pages have no time of capture: they are taken to be captured one second after another, by page_id.
FIRST_CAPTURE = datetime(2024, 1, 1, tzinfo=UTC)
#: Seconds from the first capture to the end of the calendar.
LAST_SECOND = 250_000_000_000
SAME_PAYLOAD = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

ENTRY = "archive string, place long, url_key string, captured string, page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def url_key(url: str) -> str:
    """Host labels in reverse, then path and query, in lower case: captures of a site sort together."""
    try:
        parts = urlsplit(url)
        host, port = parts.hostname or "", f":{parts.port}" if parts.port else ""
    except ValueError:
        return url.lower()
    query = f"?{parts.query}" if parts.query else ""
    return f"{','.join(reversed(host.split('.')))}{port}){parts.path or '/'}{query}".lower() if host else url.lower()


def assign(scratch: Scratch, pages: DataFrame) -> DataFrame:
    """page_id, url, html, payload_digest, refers_to (null: a response)."""
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"), html.alias("html"))
    digests = scratch.cut(rows.select("page_id", F.sha2(F.col("html").cast("binary"), 256).alias("digest"), F.octet_length("html").alias("n")))
    first = digests.filter(f"n >= {REVISIT_BYTES}").groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("copies")).filter("copies > 1").select("digest", "first")
    again = digests.join(first, "digest").filter("page_id <> first").select(F.col("page_id").alias("_page"), "digest", "first").distinct()
    whole = rows.withColumn("payload_digest", F.sha2(F.col("html").cast("binary"), 256))
    same = (F.col("page_id") == F.col("_page")) & (F.col("payload_digest") == F.col("digest"))
    return whole.join(again, same, "left").select("page_id", "url", "html", "payload_digest", F.col("first").alias("refers_to"))


def record(page: int | None, url: str, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    name = lambda x: f"<urn:page:{'' if x is None else x}>"
    safe = "".join(c if c >= " " and c != "\x7f" else f"%{ord(c):02X}" for c in url)
    when = FIRST_CAPTURE + timedelta(seconds=(page or 0) % LAST_SECOND)
    revisit = refers_to is not None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode() + (b"" if revisit else payload)
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {name(page)}", f"WARC-Date: {when:%Y-%m-%dT%H:%M:%SZ}", f"WARC-Target-URI: {safe}", f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(http)}"]
    if revisit:
        head += [f"WARC-Profile: {SAME_PAYLOAD}", f"WARC-Refers-To: {name(refers_to)}"]
    return gzip.compress("\r\n".join(head).encode() + b"\r\n\r\n" + http + b"\r\n\r\n", 4, mtime=0)


def members(data: bytes, chunk: int = 1 << 16) -> Iterator[tuple[int, bytes]]:
    """(place, content) of each gzip member. The archive is fed in chunks, so that what a member leaves over is never more
    than one: the work stays in proportion to the archive."""
    view, at = memoryview(data), 0
    while at < len(view):
        unzip, parts, end = zlib.decompressobj(31), [], at
        while not unzip.eof and end < len(view):
            parts.append(unzip.decompress(view[end : end + chunk]))
            end = min(end + chunk, len(view))
        if not unzip.eof:
            raise ValueError(f"cut off record at {at}")
        yield at, b"".join(parts)
        at = end - len(unzip.unused_data)


def parse(place: int, content: bytes) -> tuple:
    """An index entry, all of it from the record."""
    head, _, block = content.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in head.decode().split("\r\n")[1:])
    block = block[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = next(int(line[16:]) for line in http.decode().split("\r\n") if line.startswith("Content-Length: "))
    number = lambda x: int(x[10:-1]) if x and x != "<urn:page:>" else None
    digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
    if fields["WARC-Type"] == "response" and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
        raise ValueError(f"damaged record at {place}")
    return place, url_key(fields["WARC-Target-URI"]), fields["WARC-Date"], number(fields["WARC-Record-ID"]), size, digest, fields["WARC-Type"], number(fields.get("WARC-Refers-To"))


def write_archives(records: DataFrame) -> DataFrame:
    """archive and data, a row for each file; records as from ``assign``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[bytes] = []
        size = 0

        def packed() -> pa.RecordBatch:
            data = b"".join(parts)
            return pa.RecordBatch.from_arrays([pa.array([f"{hashlib.sha256(data).hexdigest()[:24]}.warc.gz"]), pa.array([data], pa.binary())], names=["archive", "data"])

        for batch in small_batches(batches):
            for row in batch.to_pylist():
                parts.append(record(row["page_id"], row["url"], row["html"].encode(), row["payload_digest"], row["refers_to"]))
                size += len(parts[-1])
                if size >= ARCHIVE_BYTES:
                    yield packed()
                    parts.clear()
                    size = 0
        if parts:
            yield packed()

    return records.mapInArrow(run, "archive string, data binary")


KINDS = (pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
NAMES = [c.split()[0] for c in ENTRY.split(", ")]


def _order(entry: tuple) -> tuple:
    """Entries by URL key, time and page; archive and place make the order total."""
    return entry[2], entry[3], -1 if entry[4] is None else entry[4], entry[0], entry[1]


def _batch(rows: list[tuple], kinds=KINDS, names=NAMES) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def read_archives(archives: DataFrame) -> DataFrame:
    """Index entries, those of an archive sorted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch.column("archive").to_pylist(), batch.column("data").to_pylist(), strict=True):
                yield _batch(sorted(((name, *parse(*m)) for m in members(data)), key=_order))

    return archives.mapInArrow(run, ENTRY)


class LoserTree:
    """Merges sorted runs: inner nodes hold the loser of the match below, the winner goes up; one match a level an item."""

    def __init__(self, runs: Iterable[Iterable[tuple]], key):
        self.runs, self.key = [iter(r) for r in runs], key
        self.k = max(1, len(self.runs))
        self.head = [self._pull(i) for i in range(len(self.runs))] or [None]
        self.tree = [-1] * self.k
        for i in range(self.k):
            self._replay(i)

    def _pull(self, i: int):
        item = next(self.runs[i], None)
        return None if item is None else (self.key(item), i, item)

    def _beats(self, a: int, b: int) -> bool:
        x, y = self.head[a], self.head[b]
        return x is not None and (y is None or x[:2] < y[:2])

    def _replay(self, i: int) -> None:
        node = (i + self.k) // 2
        while node > 0:
            other = self.tree[node]
            if other < 0:  # still building: wait here for the other side
                self.tree[node] = i
                return
            if self._beats(other, i):
                self.tree[node], i = i, other
            node //= 2
        self.tree[0] = i

    def __iter__(self) -> Iterator[tuple]:
        while (best := self.head[self.tree[0]]) is not None:
            yield best[2]
            self.head[best[1]] = self._pull(best[1])
            self._replay(best[1])


def merge_runs(entries: DataFrame, ranges: int) -> DataFrame:
    """The entries with ``range_no`` and ``range_place``: ordered by these two they are the global history."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: dict[str, list[tuple]] = {}
        number = None
        for batch in batches:
            *columns, where = (batch.column(c).to_pylist() for c in [*NAMES, "range_no"])
            number = where[0] if where else number
            for row in zip(*columns, strict=True):
                parts.setdefault(row[0], []).append(row)
        for part in parts.values():  # a run's part arrives in order unless its task was tried again
            if any(_order(a) > _order(b) for a, b in zip(part, part[1:], strict=False)):
                part.sort(key=_order)
        out = []
        for place, row in enumerate(LoserTree(parts.values(), _order)):
            out.append((*row, number, place))
            if len(out) == 5000:
                yield _batch(out, (*KINDS, pa.int32(), pa.int64()), [*NAMES, "range_no", "range_place"])
                out = []
        if out:
            yield _batch(out, (*KINDS, pa.int32(), pa.int64()), [*NAMES, "range_no", "range_place"])

    dealt = entries.repartitionByRange(ranges, "url_key", "captured", "page_id").withColumn("range_no", F.spark_partition_id())
    return dealt.mapInArrow(run, f"{ENTRY}, range_no int, range_place long")


def histories(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """Writes the archives of pages, reads them back and returns their merged index with ``history_place``, an entry's place in
    the global history: its place in its range after the sizes of the ranges before. A range takes about 100,000 entries."""
    with Scratch(spark) as scratch:
        archives = scratch.cut(write_archives(assign(scratch, pages)))
        entries = scratch.cut(read_archives(archives))
        ranges = max(spark.sparkContext.defaultParallelism, entries.count() // 100_000)
        merged = scratch.cut(merge_runs(entries, ranges), keep=True)
    sizes = merged.groupBy("range_no").agg(F.count("*").alias("_n"))  # a row a range
    before = Window.orderBy("range_no").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("range_no", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    return merged.join(starts, "range_no").withColumn("history_place", F.col("_start") + F.col("range_place")).drop("_start")
