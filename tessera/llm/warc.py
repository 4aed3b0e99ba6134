"""WARC archives with a two-level capture index.

Archives hold one gzip member for each record. The index sorts the captures by reversed-host URL key into compressed blocks;
a sparse directory has the first and last key of each block. A lookup binary-searches the directory, reads the range of one
block, binary-searches its lines and reads the ranges of the records. Files go to the shared folder through pyarrow's file systems, so a local
mount, HDFS or an object store serve alike. A file's name is new for each attempt of a task: what a lost or repeated task left is
never referred to.
"""

from __future__ import annotations

import base64
import bisect
import gzip
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import boxed, materialize, scratch_path

#: Bytes after which a new archive begins, captures in an index block, and the gap up to which two record ranges are read as one.
ARCHIVE_BYTES, BLOCK_LINES, GAP = 1 << 30, 3000, 1 << 16
#: Keys that the rows of one payload are dealt to where they meet what they refer to.
SALTS = 8
DATE = "1970-01-01T00:00:00Z"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"

CAPTURES = "page_id long, key string, file string, at long, length long"
RECORDS = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def url_key(url: Column) -> Column:
    """Host labels reversed and comma-joined, a bracket, then path and query, lower-cased; what follows # goes. Null: empty."""
    u = F.lower(F.coalesce(url.cast("string"), F.lit("")))
    rest = F.regexp_replace(F.regexp_replace(u, r"#[\s\S]*\z", ""), r"\A[a-z][a-z0-9+.-]*://", "")
    host = F.regexp_extract(rest, r"\A([^/?]*)", 1)
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), F.substring(rest, F.char_length(host) + 1, F.char_length(rest)))


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, sha1: str, refers_to: int | None) -> bytes:
    """A record as one gzip member. A revisit has the headers of the HTTP response, but no payload."""
    kind = "response" if refers_to is None else "revisit"
    block = HTTP + (payload if refers_to is None else b"")
    head = {
        "WARC-Type": kind,
        "WARC-Record-ID": f"<urn:page:{'' if page_id is None else page_id}>",
        "WARC-Date": DATE,
        "WARC-Target-URI": json.dumps(url)[1:-1] if url is not None else None,
        "Content-Type": "application/http; msgtype=response",
        "WARC-Payload-Digest": f"sha1:{sha1}",
        "WARC-Payload-Length": len(payload),
    }
    if refers_to is not None:
        head |= {"WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "WARC-Refers-To": f"<urn:page:{refers_to}>"}
    lines = [f"{k}: {v}" for k, v in head.items() if v is not None]
    raw = "\r\n".join(["WARC/1.1", *lines, f"Content-Length: {len(block)}", "", ""]).encode() + block + b"\r\n\r\n"
    return gzip.compress(raw, 1, mtime=0)


def parse(member: bytes) -> tuple:
    """A row of RECORDS from a gzip member; the digest of a response is taken of its payload."""
    raw = gzip.decompress(member)
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    payload = block.partition(b"\r\n\r\n")[2]
    page = lambda x: int(x[len("<urn:page:") : -1]) if len(x) > len("<urn:page:>") else None
    url = json.loads(f'"{fields["WARC-Target-URI"]}"') if "WARC-Target-URI" in fields else None
    if fields["WARC-Type"] == "response":
        return page(fields["WARC-Record-ID"]), url, len(payload), digest(payload), "response", None, payload
    return page(fields["WARC-Record-ID"]), url, int(fields["WARC-Payload-Length"]), fields["WARC-Payload-Digest"].removeprefix("sha1:"), "revisit", page(fields["WARC-Refers-To"]), None


def _table(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)


_CAPTURES = pa.schema([("page_id", pa.int64()), ("key", pa.string()), ("file", pa.string()), ("at", pa.int64()), ("length", pa.int64())])
_DIRECTORY = pa.schema([("first", pa.string()), ("last", pa.string()), ("file", pa.string()), ("at", pa.int64()), ("length", pa.int64()), ("captures", pa.int64())])
_BLOCKS = pa.schema([("key", pa.string()), ("file", pa.string()), ("at", pa.int64()), ("length", pa.int64())])
_RECORDS = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])


def _open(root: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(root if "://" in root else f"file://{root}")


def write(pages: DataFrame, root: str, least: int = 0) -> DataFrame:
    """Write a record for every row of pages (page_id, url, html) under root; gives the captures, kept as a table.

    Of rows whose payloads are equal and have `least` bytes or more, those with the largest page_id are responses, the others
    revisit it; smaller ones are responses. A null html is an empty payload; a null page_id comes before all others. Only digests of payloads that
    occur repeatedly are joined; the rows of a payload are dealt to SALTS keys there.
    """
    payload = F.coalesce(F.col("html").cast("string"), F.lit(""))
    base = boxed(pages, "page_id", "url", "html").select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("html"), url_key(F.col("url")).alias("key"))
    sha1 = F.sha1(F.col("html").cast("binary"))
    copies = base.where(F.octet_length("html") >= least).groupBy(sha1.alias("sha1")).agg(F.max("page_id").alias("first_id"), F.count("*").alias("n")).where("n > 1").select("sha1", "first_id")
    copies = materialize(copies, "copies").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    dealt = base.withColumns({"own": sha1, "of": F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int")})
    rows = dealt.join(copies, (F.col("own") == F.col("sha1")) & (F.col("of") == F.col("salt")) & (F.octet_length("html") >= least), "left")
    refers = F.when(F.col("page_id").eqNullSafe(F.col("first_id")), None).otherwise(F.col("first_id"))
    rows = rows.select("page_id", "url", "key", "html", "own", refers.alias("refers_to"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base_path = _open(root)
        out, path, at = None, "", 0
        for batch in batches:
            made = []
            for page, url, key, html, own, refers_to in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
                if out is None or at >= ARCHIVE_BYTES:
                    if out:
                        out.close()
                    store.create_dir(base_path, recursive=True)
                    path, at = f"{uuid.uuid4().hex}.warc.gz", 0
                    out = store.open_output_stream(f"{base_path}/{path}", compression=None)
                data = record(page, url, html.encode(), base64.b32encode(bytes.fromhex(own)).decode(), refers_to)
                out.write(data)
                made.append((page, key, path, at, len(data)))
                at += len(data)
            yield _table(made, _CAPTURES)
        if out:
            out.close()

    return materialize(rows.mapInArrow(run, CAPTURES), "captures")


@dataclass(frozen=True)
class Index:
    """An index: `root` has archives and blocks, `directory` is the sparse directory as sorted rows."""

    root: str
    directory: DataFrame


def build(captures: DataFrame, root: str, block_lines: int = BLOCK_LINES) -> Index:
    """Sort captures by key and page into compressed blocks under root. One host with a third of all captures is cut like any other range."""
    ordered = captures.repartitionByRange("key", "page_id", "file", "at").sortWithinPartitions("key", "page_id", "file", "at")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base_path = _open(root)
        out, path, at, lines, keys = None, "", 0, [], []

        def flush() -> tuple:
            nonlocal out, path, at
            if out is None:
                store.create_dir(base_path, recursive=True)
                path = f"{uuid.uuid4().hex}.idx"
                out = store.open_output_stream(f"{base_path}/{path}", compression=None)
            data = zlib.compress("\n".join(lines).encode(), 6)
            out.write(data)
            row = (keys[0], keys[-1], path, at, len(data), len(lines))
            at += len(data)
            lines.clear()
            keys.clear()
            return row

        for batch in batches:
            made = []
            for page, key, file, start, length in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                lines.append(json.dumps([key, page, file, start, length]))
                keys.append(key)
                if len(lines) >= block_lines:
                    made.append(flush())
            yield _table(made, _DIRECTORY)
        if lines:
            yield _table([flush()], _DIRECTORY)
        if out:
            out.close()

    made = ordered.select("page_id", "key", "file", "at", "length").mapInArrow(run, "first string, last string, file string, at long, length long, captures long")
    return Index(root, materialize(made, "directory"))


class _Directory:
    """The part of the directory that may hold keys from low to high, as rows (first, last, file, at, length)."""

    def __init__(self, rows: list[tuple]) -> None:
        self.rows = sorted(rows)
        self.lasts = sorted((r[1], i) for i, r in enumerate(self.rows))

    def find(self, key: str) -> Iterator[tuple]:
        """Blocks are in order and don't overlap but in their end keys: the first whose last key isn't before `key`, and on while they start with it."""
        i = bisect.bisect_left(self.lasts, (key, -1))
        while i < len(self.rows) and self.rows[i][0] <= key:
            yield self.rows[i]
            i += 1


def _tasks(df: DataFrame) -> int:
    """Tasks for rows that are small beside the work that they stand for: adaptive execution would merge them by their size."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def locate(index: Index, keys: DataFrame) -> DataFrame:
    """The captures of every different key of `keys` (key).

    Sorted keys meet the directory by range, and each task reads its own part of it; then (key, block) pairs are dealt out by block, so a key that many
    blocks hold is searched by many tasks. A null key is in no index. Captures come in batches of bounded size.
    """
    path = index.directory._tessera_path
    root = index.root

    def direct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.dataset as ds

        dir_store, dir_path = _open(path)
        table = ds.dataset(dir_path, filesystem=dir_store, format="parquet", exclude_invalid_files=False)
        for batch in batches:
            wanted = batch.column(0).to_pylist()
            if not wanted:
                continue
            part = table.to_table(filter=(ds.field("last") >= wanted[0]) & (ds.field("first") <= wanted[-1]), columns=_DIRECTORY.names[:5])
            directory = _Directory(list(zip(*(part.column(c).to_pylist() for c in _DIRECTORY.names[:5]), strict=True)))
            yield _table([(k, *block[2:5]) for k in wanted for block in directory.find(k)], _BLOCKS)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = _open(root)
        now, lines, found = None, [], []
        for batch in batches:
            for key, *block in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if now != block:
                    with store.open_input_file(f"{base}/{block[0]}") as f:
                        now, lines = block, [json.loads(x) for x in zlib.decompress(f.read_at(block[2], block[1])).decode().split("\n")]
                for i in range(bisect.bisect_left(lines, key, key=lambda x: x[0]), len(lines)):
                    if lines[i][0] != key:
                        break
                    _, page, file, at, length = lines[i]
                    found.append((page, key, file, at, length))
                if len(found) >= 4096:
                    yield _table(found, _CAPTURES)
                    found = []
        yield _table(found, _CAPTURES)

    ordered = keys.where("key is not null").select("key").distinct().repartitionByRange("key").sortWithinPartitions("key")
    pairs = ordered.mapInArrow(direct, "key string, file string, at long, length long")
    return pairs.repartition(_tasks(keys), "file", "at").sortWithinPartitions("file", "at", "key").mapInArrow(search, CAPTURES)


def fetch(index: Index, captures: DataFrame, payloads: bool = True, chunk: int = 16 << 20) -> DataFrame:
    """The records of captures: pointers meet by archive and stretch of it, near ranges are read as one."""
    root = index.root

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = _open(root)
        for batch in batches:
            rows = list(zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True))
            done = 0
            while done < len(rows):
                file, low, length = rows[done]
                high, end = low + length, done + 1
                while end < len(rows) and rows[end][0] == file and rows[end][1] <= high + GAP and rows[end][1] - low < 1 << 22:
                    high = max(high, rows[end][1] + rows[end][2])
                    end += 1
                with store.open_input_file(f"{base}/{file}") as f:
                    data = f.read_at(high - low, low)
                found = [parse(data[at - low : at - low + n]) for _, at, n in rows[done:end]]
                yield _table(found if payloads else [(*r[:6], None) for r in found], _RECORDS)
                done = end

    near = captures.select("file", "at", "length").withColumn("stretch", F.expr(f"at div {chunk}"))
    near = near.repartition(_tasks(captures), "file", "stretch").sortWithinPartitions("file", "at").select("file", "at", "length")
    return near.mapInArrow(run, RECORDS)


def round_trip(pages: DataFrame, least: int = 0) -> DataFrame:
    """Write archives and index for pages, then read every capture back through lookups of all keys: (page_id, payload_bytes, payload_digest, record_type, refers_to) and url.

    A page is one row; repeated rows come back repeatedly, and rows with one page_id and payload have the same type. A null url is one key of its own, a
    null html an empty payload, a null page_id comes before all others. A payload is held whole, one at a time. Empty table: no rows. Other columns are ignored.
    """
    root = scratch_path(pages.sparkSession, "warc")
    captures = write(pages, root, least)
    index = build(captures, root)
    found = locate(index, boxed(pages, "url").select(url_key(F.col("url")).alias("key")))
    return fetch(index, materialize(found, "found"), payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url")
