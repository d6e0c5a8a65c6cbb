"""WARC archives with a two-level capture index.

Writing: every task appends one gzip member per record to archives of its own in
a shared folder and returns (key, file, offset, length).  Archive names are drawn
per attempt; only those named by the stored captures are read, so a repeated or
lost task leaves at most an unread file.

Index: captures sorted by reversed-host URL key go to index parts of compressed
blocks.  Beside each part stands its sparse directory, the first key and the
place of every block; the first keys of the parts are the level above, as many as
there are partitions.

Reading: a task finds the part by binary search over the parts' first keys, the
block by binary search over the part's directory, reads that block's range, and
then the record's range in the archive.

Defined cases: a null or empty page is an empty payload; a null url has the empty
key; a null page_id is lowest among equal payloads; rows repeated with the
largest page_id are all responses; an empty table gives no archive and no rows.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
import zlib
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from urllib.parse import urlsplit

import pyarrow as pa
from pyarrow.fs import FileSystem
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import new_path, staged

#: Payloads of fewer bytes are stored again rather than referred to.
REVISIT_BYTES = 1000
ARCHIVE_BYTES = 256_000_000
BLOCK_LINES = 1000
DATE = "2024-01-01T00:00:00Z"


def url_key(url: str | None) -> str:
    """org,example,www)/path?query: host reversed, without scheme, port and fragment."""
    try:
        parts = urlsplit((url or "").strip())
        host = (parts.hostname or "").rstrip(".")
    except ValueError:
        return (url or "").strip().lower().replace("\t", "%09").replace("\n", "%0A")
    if not host:
        return (url or "").strip().replace("\t", "%09").replace("\n", "%0A")
    path = (parts.path or "/") + (f"?{parts.query}" if parts.query else "")
    return f"{','.join(reversed(host.split('.')))}){path}".replace("\t", "%09").replace("\n", "%0A")


def capture_key(url: str | None, page: int | None) -> str:
    """Sorts by URL key, then page; pages below zero and null have their own marks.

    Without blanks and line ends, which separate fields and lines of the index:
    the bytes that are sorted are the bytes that are stored.
    """
    mark = "-" if page is None else f"n{(1 << 63) + page:020d}" if page < 0 else f"p{page:020d}"
    return f"{url_key(url).replace(' ', '%20').replace(chr(13), '%0D')}\t{mark}"


# -- records ----------------------------------------------------------------

def _name(page: int | None) -> str:
    return f"<urn:x-page:{'none' if page is None else page}>"


def _page(name: str) -> int | None:
    value = name[len("<urn:x-page:"):-1]
    return None if value == "none" else int(value)


def record(page: int | None, url: str | None, payload: bytes, refers_to: int | None, refers_url: str | None,
           revisit: bool) -> bytes:
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", _name(page)), ("WARC-Date", DATE)]
    if url:
        head.append(("WARC-Target-URI", url.replace("\r", "%0D").replace("\n", "%0A")))
    head.append(("WARC-Payload-Digest", f"sha1:{digest}"))
    if revisit:
        head += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
                 ("WARC-Refers-To", _name(refers_to))]
        if refers_url:
            head.append(("WARC-Refers-To-Target-URI", refers_url.replace("\r", "%0D").replace("\n", "%0A")))
    head += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    lines = "".join(f"{k}: {v}\r\n" for k, v in head)
    return gzip.compress(f"WARC/1.1\r\n{lines}\r\n".encode() + block + b"\r\n\r\n", 6, mtime=0)


def parse_record(member: bytes) -> tuple[dict[str, str], bytes, bytes]:
    """Headers, HTTP header and payload of one gzip member."""
    raw = zlib.decompress(member, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[:int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    return fields, http, payload


# -- writing ----------------------------------------------------------------

def decide_revisits(pages: DataFrame, least: int = REVISIT_BYTES) -> DataFrame:
    """(page_id, digest, refers_to, refers_url) of the pages that repeat a later page's payload."""
    html = F.coalesce("html", F.lit(""))
    facts = (pages.select("page_id", "url", F.sha1(html.cast("binary")).alias("digest"), F.octet_length(html).alias("bytes"))
             .filter(F.col("bytes") >= least))
    heads = (facts.groupBy("digest").agg(F.max(F.struct("page_id", "url")).alias("head"), F.count("*").alias("n"))
             .filter("n > 1").select("digest", F.col("head.page_id").alias("refers_to"), F.col("head.url").alias("refers_url")))
    return (facts.join(heads, "digest").filter(~F.col("page_id").eqNullSafe(F.col("refers_to")))
            .select("page_id", "digest", "refers_to", "refers_url").distinct())


@dataclass
class Archive:
    """Captures (key, file, offset, length) of the archives under a folder."""

    folder: str
    captures: DataFrame


def write_archives(pages: DataFrame, folder: str | None = None, least: int = REVISIT_BYTES,
                   archive_bytes: int = ARCHIVE_BYTES) -> Archive:
    """One record per row of pages (page_id, url, html)."""
    folder = folder or new_path(pages.sparkSession, "warc")
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    seen = decide_revisits(pages, least).withColumnsRenamed({"page_id": "__page", "digest": "__digest"})
    own = F.sha1(F.coalesce("html", F.lit("")).cast("binary"))
    rows = (pages.join(seen, pages["page_id"].eqNullSafe(F.col("__page")) & (own == F.col("__digest")), "left")
            .select("page_id", "url", F.col("html").cast("binary").alias("html"), "refers_to", "refers_url",
                    F.col("__digest").isNotNull().alias("revisit")))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = FileSystem.from_uri(folder)
        fs.create_dir(root, recursive=True)
        name, out, at = None, None, 0
        try:
            for batch in batches:
                found = []
                for page, url, html, refers_to, refers_url, revisit in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                    member = record(page, url, html or b"", refers_to, refers_url, revisit)
                    if out is None or at + len(member) > archive_bytes:
                        if out is not None:
                            out.close()
                        name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                        out = fs.open_output_stream(f"{root}/{name}", compression=None)
                    out.write(member)
                    found.append((capture_key(url, page), name, at, len(member)))
                    at += len(member)
                keys, names, offsets, lengths = zip(*found, strict=True) if found else ((), (), (), ())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys, pa.string()), pa.array(names, pa.string()), pa.array(offsets, pa.int64()),
                     pa.array(lengths, pa.int64())], ["key", "file", "offset", "length"])
        finally:
            if out is not None:
                out.close()

    return Archive(folder, staged(rows.mapInArrow(write, "key string, file string, offset long, length long"), "captures"))


# -- the index --------------------------------------------------------------

@dataclass
class Index:
    """Index parts under a folder; parts: (first key, part name) in order, one per partition that had rows."""

    folder: str
    parts: list[tuple[bytes, str]]


def build_index(archive: Archive, block_lines: int = BLOCK_LINES) -> Index:
    """Sort the captures into parts of compressed blocks, each part with its directory."""
    folder = f"{archive.folder}/index"
    # The whole key is unique but for repeated rows, so ranges are even however hot a host is.
    # Bytes order as Python orders them.
    ordered = (archive.captures.select(F.col("key").cast("binary").alias("key"), "file", "offset", "length")
               .repartitionByRange("key", "file", "offset").sortWithinPartitions("key", "file", "offset"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = FileSystem.from_uri(folder)
        name, out, at, lines, first, directory = uuid.uuid4().hex, None, 0, [], None, []

        def close_block():
            nonlocal at, lines
            block = zlib.compress(b"".join(lines), 6)
            out.write(block)
            directory.append(lines[0].split(b" ")[0] + b" %d %d\n" % (at, len(block)))
            at, lines = at + len(block), []

        for batch in batches:
            for key, file, offset, length in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if out is None:
                    fs.create_dir(root, recursive=True)
                    out, first = fs.open_output_stream(f"{root}/{name}.idx", compression=None), key
                lines.append(b"%s %s %d %d\n" % (key, file.encode(), offset, length))
                if len(lines) == block_lines:
                    close_block()
        if out is not None:
            if lines:
                close_block()
            out.close()
            with fs.open_output_stream(f"{root}/{name}.dir", compression=None) as d:
                d.write(b"".join(directory))
            yield pa.RecordBatch.from_arrays([pa.array([first], pa.binary()), pa.array([name], pa.string())], ["first", "part"])

    parts = ordered.mapInArrow(write, "first binary, part string").collect()  # one row a partition
    return Index(folder, sorted((bytes(r["first"]), r["part"]) for r in parts))


class Finder:
    """Two binary searches, then one range read; a few directories and blocks are remembered."""

    def __init__(self, index: Index):
        self.fs, self.root = FileSystem.from_uri(index.folder)
        self.firsts, self.names = [p[0] for p in index.parts], [p[1] for p in index.parts]
        self.directory = lru_cache(maxsize=4)(self._directory)
        self.block = lru_cache(maxsize=8)(self._block)

    def _directory(self, part: int) -> tuple[list[bytes], list[tuple[int, int]]]:
        with self.fs.open_input_file(f"{self.root}/{self.names[part]}.dir") as f:
            rows = [line.rsplit(b" ", 2) for line in f.read().splitlines()]
        return [r[0] for r in rows], [(int(r[1]), int(r[2])) for r in rows]

    def _block(self, part: int, block: int) -> tuple[list[bytes], list[tuple[bytes, int, int]]]:
        at, length = self.directory(part)[1][block]
        with self.fs.open_input_file(f"{self.root}/{self.names[part]}.idx") as f:
            f.seek(at)
            rows = [line.split(b" ") for line in zlib.decompress(f.read(length)).splitlines()]
        return [r[0] for r in rows], [(r[1], int(r[2]), int(r[3])) for r in rows]

    def find(self, key: bytes) -> Iterator[tuple[bytes, int, int]]:
        """Every capture of a key, in order; repeated keys may go on in the next block or part."""
        part = max(0, bisect_left(self.firsts, key) - 1)
        while part < len(self.firsts) and self.firsts[part] <= key:
            firsts, _ = self.directory(part)
            block = max(0, bisect_left(firsts, key) - 1)
            while block < len(firsts) and firsts[block] <= key:
                keys, places = self.block(part, block)
                at = bisect_left(keys, key)
                while at < len(keys) and keys[at] == key:
                    yield places[at]
                    at += 1
                block += 1
            part += 1


def lookup(index: Index, queries: DataFrame) -> DataFrame:
    """(file, offset, length) of every capture of the keys of queries (page_id, url)."""
    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [capture_key(u, p).encode() for p, u in zip(*[c.to_pylist() for c in batch.columns], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.binary())], ["key"])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder(index)
        for batch in batches:
            met = [place for key in batch.column(0).to_pylist() for place in finder.find(key)]
            files, offsets, lengths = zip(*met, strict=True) if met else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [pa.array([f.decode() for f in files], pa.string()), pa.array(offsets, pa.int64()), pa.array(lengths, pa.int64())],
                ["file", "offset", "length"])

    asked = queries.select(F.col("page_id").cast("long").alias("page_id"), "url").mapInArrow(keys, "key binary").distinct()
    # In key order a task meets each block once.
    return (asked.repartitionByRange("key").sortWithinPartitions("key")
            .mapInArrow(find, "file string, offset long, length long"))


def read_records(archive: Archive, places: DataFrame) -> DataFrame:
    """(page_id, url, record_type, refers_to, payload_bytes, payload_digest, payload): one range read each."""
    folder = archive.folder

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = FileSystem.from_uri(folder)
        held = (None, None)
        for batch in batches:
            found = []
            for file, offset, length in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if held[0] != file:
                    if held[1] is not None:
                        held[1].close()
                    held = file, fs.open_input_file(f"{root}/{file}")
                held[1].seek(offset)
                head, http, payload = parse_record(held[1].read(length))
                stated = base64.b32decode(head["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
                revisit = head["WARC-Type"] == "revisit"
                if not revisit and hashlib.sha1(payload).hexdigest() != stated:
                    raise ValueError(f"{file} at {offset}: the payload does not have the digest of its record")
                size = int(http.decode().rpartition("Content-Length: ")[2])
                found.append((_page(head["WARC-Record-ID"]), head.get("WARC-Target-URI"), head["WARC-Type"],
                              _page(head["WARC-Refers-To"]) if revisit else None, size, stated, None if revisit else payload))
            kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary())
            columns = zip(*found, strict=True) if found else [()] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
                                             ["page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest", "payload"])

    return places.repartition("file", F.floor(F.col("offset") / 16_000_000)).sortWithinPartitions("file", "offset").mapInArrow(
        read, "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary")
