"""WARC archives with a two-level capture index.

``write``: every page becomes one gzip member of an archive, a response, or a
revisit of the response with the same payload.  ``build_index``: capture lines,
keyed by reversed host and path, are sorted over all archives and cut into
gzip blocks; each index file ends with a sparse directory of its blocks (first
key, place), and ``IndexFiles`` names the key range of each file.  ``lookup``:
keys are sent to the files whose range holds them; there a binary search in the
directory finds the blocks, a range read gets each, and range reads at the places
its lines name get the records, which go on in batches of a few megabytes.  No archive is read through.

Archives and index files are ordinary files under the shared checkpoint folder,
written with ``pyarrow.fs`` (local and mounted folders, HDFS, S3, GCS).  A file's
name holds the task attempt, and only files named by committed rows are read, so
a task that is lost or run twice leaves unread files behind at worst.

Defined cases: null html is an empty payload, which is deduplicated like any
other; rows with the smallest id of a payload are responses, also if they repeat
it; a null id comes after all others; a null url has the key ``-``; empty
tables give no archives; other columns are ignored.
"""

from __future__ import annotations

import base64
import bisect
import gzip
import hashlib
import json
import struct
import uuid
import zlib
from urllib.parse import urlsplit

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from listenlens.llm.common import store, text_key
from listenlens.session import scratch_path

MIN_REVISIT_BYTES = 0
ARCHIVE_BYTES = 64 << 20
BLOCK_LINES = 512
# blocks between flushes of an index file, which bounds a worker's memory
LEVEL = 4
DATE = "1970-01-01T00:00:00Z"
# archives a worker keeps open
OPEN_FILES = 32
# payload bytes and rows a reader gathers before it hands them on
BATCH_BYTES, BATCH_ROWS = 4 << 20, 10_000
_NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def surt(url: str | None) -> str:
    """Sort-friendly key: reversed host, port unless it is the scheme's own, path and query."""
    if not url:
        return "-"
    try:
        u = urlsplit(url.strip())
        host, port = (u.hostname or "").rstrip("."), u.port
    except ValueError:
        return url
    if not host:
        return url
    own = {"http": 80, "https": 443}.get(u.scheme)
    key = ",".join(reversed(host.split("."))) + (f":{port}" if port and port != own else "") + ")"
    return key + (u.path or "/") + (f"?{u.query}" if u.query else "")


def digest32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page: str, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_NAMESPACE, f'{page}:{digest}')}>"


def _safe(value: str) -> str:
    """A header value stays on its line."""
    return value.replace("\r", "%0D").replace("\n", "%0A")


def record(page: str, url: str | None, payload: bytes, first: str | None) -> tuple[bytes, str, str]:
    """(gzip member, payload digest, type); ``first`` is the id key of the response to revisit."""
    digest = digest32(payload)
    kind = "response" if first is None else "revisit"
    http = (f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n").encode()
    block = http + (payload if first is None else b"")
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {record_id(page, digest)}", f"WARC-Date: {DATE}",
            *([f"WARC-Target-URI: {_safe(url)}"] if url else []), "Content-Type: application/http; msgtype=response",
            f"WARC-Payload-Digest: sha1:{digest}", f"X-Page-Id: {_safe(page)}"]
    if first is not None:
        head += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: {record_id(first, digest)}", f"X-Refers-To-Page-Id: {_safe(first)}"]
    head.append(f"Content-Length: {len(block)}")
    raw = "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"
    z = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return z.compress(raw) + z.flush(), digest, kind


def parse(member: bytes) -> tuple[dict[str, str], int, bytes]:
    """(WARC headers, full payload size, payload held by the record) of one gzip member."""
    raw = zlib.decompress(member, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    headers = dict(line.split(": ", 1) for line in head.decode("utf-8", "surrogatepass").split("\r\n")[1:])
    block = rest[:int(headers["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(http.rsplit(b"Content-Length: ", 1)[1].split(b"\r\n")[0])
    return headers, size, payload


def _folder(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


class _Out:
    """One output file: a list of parts at known places."""

    def __init__(self, folder: str, stem: str):
        filesystem, path = _folder(folder)
        filesystem.create_dir(path)
        context = TaskContext.get()
        self.name = f"{stem}-{context.partitionId():05d}-{context.taskAttemptId()}-{uuid.uuid4().hex[:6]}"
        self.file, self.size = filesystem.open_output_stream(f"{path}/{self.name}"), 0

    def add(self, data: bytes) -> int:
        at, self.size = self.size, self.size + len(data)
        self.file.write(data)
        return at


# ---- archives ------------------------------------------------------------------

def write(pages: DataFrame, folder: str, min_revisit_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """Write one record per page row; returns the captures (key, page, file, offset, length), stored."""
    p = pages.select(text_key("page_id").alias("page"), "page_id", F.col("url").cast("string").alias("url"),
                     F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    p = p.withColumn("digest", F.sha1(F.col("html").cast("binary")))
    firsts = (p.filter(F.octet_length("html") >= min_revisit_bytes).groupBy("digest")
              .agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(F.col("page_id").isNull().alias("last"), "page_id")).alias("least"))
              .filter("n > 1").select("digest", F.col("least.page_id").alias("page_id")).withColumn("first", text_key("page_id"))
              .select("digest", "first"))

    def run(batches):
        out = None
        for batch in batches:
            rows = {c: [] for c in ("key", "page", "file", "offset", "length")}
            for page, url, html, first in zip(*(batch.column(c).to_pylist() for c in ("page", "url", "html", "first"))):
                if out is None or out.size >= ARCHIVE_BYTES:
                    if out:
                        out.file.close()
                    out = _Out(folder, "archive")
                payload = html.encode("utf-8", "surrogatepass")
                member, _, _ = record(page, url, payload, first if first != page else None)
                for c, v in zip(rows, (surt(url), page, out.name, out.add(member), len(member))):
                    rows[c].append(v)
            yield pa.RecordBatch.from_pydict(rows, schema=_CAPTURE)
        if out:
            out.file.close()

    return store(p.join(firsts, "digest", "left").select("page", "url", "html", "first")
                 .mapInArrow(run, "key string, page string, file string, offset long, length long"), "warc-captures")


_CAPTURE = pa.schema([("key", pa.string()), ("page", pa.string()), ("file", pa.string()),
                      ("offset", pa.int64()), ("length", pa.int64())])


# ---- index ---------------------------------------------------------------------

def build_index(captures: DataFrame, folder: str) -> DataFrame:
    """Sort the captures into index files; returns (file, first, last, blocks, captures), stored."""
    def run(batches):
        out, directory, lines, keys, n = None, [], [], [], 0

        def flush():
            data = gzip.compress("\n".join(lines).encode("utf-8", "surrogatepass"), LEVEL, mtime=0)
            directory.append((keys[0], out.add(data), len(data)))

        last = None
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in _CAPTURE.names)):
                if out is None:
                    out = _Out(folder, "index")
                lines.append(json.dumps(row))
                keys.append(row[0])
                last, n = row[0], n + 1
                if len(lines) == BLOCK_LINES:
                    flush()
                    lines, keys = [], []
        if out:
            if lines:
                flush()
            foot = gzip.compress(json.dumps(directory).encode("utf-8", "surrogatepass"), LEVEL, mtime=0)
            out.add(foot)
            out.add(struct.pack("<q", len(foot)))
            out.file.close()
            yield pa.RecordBatch.from_pydict({"file": [out.name], "first": [directory[0][0]], "last": [last],
                                              "blocks": [len(directory)], "captures": [n]})

    return store(captures.repartitionByRange("key", "page", "offset").sortWithinPartitions("key", "page", "offset")
                 .mapInArrow(run, "file string, first string, last string, blocks long, captures long"), "warc-index")


class IndexFile:
    """One index file: its directory is read at once, its blocks by range when needed."""

    def __init__(self, file):
        self.file = file
        size = file.size()
        file.seek(size - 8)
        foot, = struct.unpack("<q", file.read(8))
        file.seek(size - 8 - foot)
        self.directory = json.loads(gzip.decompress(file.read(foot)))
        self.first = [d[0] for d in self.directory]
        self.at, self.lines = -1, []

    def block(self, i: int) -> list:
        if i != self.at:
            _, offset, length = self.directory[i]
            self.file.seek(offset)
            text = gzip.decompress(self.file.read(length)).decode("utf-8", "surrogatepass")
            self.at, self.lines = i, [json.loads(x) for x in text.split("\n")]
        return self.lines

    def blocks(self, key: str) -> range:
        """Blocks that may hold a key, by binary search in the directory; a key may run over blocks."""
        return range(max(bisect.bisect_left(self.first, key) - 1, 0), bisect.bisect_right(self.first, key))

    def find(self, key: str, block: int):
        """Captures of a key in one block, by binary search."""
        lines = self.block(block)
        j = bisect.bisect_left(lines, key, key=lambda x: x[0])
        while j < len(lines) and lines[j][0] == key:
            yield lines[j]
            j += 1


def locate(batches, index_folder: str):
    """A (key, file, block) row for each block that may hold a (key, file) row's captures."""
    ix_fs, ix_path = _folder(index_folder)
    name, ix = None, None
    for batch in batches:
        rows = []
        for key, file in zip(batch.column("key").to_pylist(), batch.column("file").to_pylist()):
            if file != name:
                if ix:
                    ix.file.close()
                name, ix = file, IndexFile(ix_fs.open_input_file(f"{ix_path}/{file}"))
            for i in ix.blocks(key):
                rows.append((key, file, i))
                if len(rows) >= BATCH_ROWS:
                    yield _batch(rows, _PLACE)
                    rows = []
        yield _batch(rows, _PLACE)


def read_records(batches, index_folder: str, archive_folder: str):
    """Records of (key, file, block) rows; a batch goes out as soon as it holds BATCH_BYTES."""
    ix_fs, ix_path = _folder(index_folder)
    ar_fs, ar_path = _folder(archive_folder)
    name, ix, archives = None, None, {}
    rows, held = [], 0
    for batch in batches:
        for key, file, block in zip(*(batch.column(c).to_pylist() for c in _PLACE.names)):
            if file != name:
                if ix:
                    ix.file.close()
                name, ix = file, IndexFile(ix_fs.open_input_file(f"{ix_path}/{file}"))
            for _, _, archive, offset, length in ix.find(key, block):
                if archive not in archives:
                    if len(archives) >= OPEN_FILES:
                        archives.pop(next(iter(archives))).close()
                    archives[archive] = ar_fs.open_input_file(f"{ar_path}/{archive}")
                archives[archive].seek(offset)
                headers, size, payload = parse(archives[archive].read(length))
                rows.append((key, headers["X-Page-Id"], headers["WARC-Type"], size,
                             headers["WARC-Payload-Digest"].removeprefix("sha1:"), headers.get("X-Refers-To-Page-Id"), payload))
                held += len(payload)
                if held >= BATCH_BYTES or len(rows) >= BATCH_ROWS:
                    yield _batch(rows, _RECORD)
                    rows, held = [], 0
    yield _batch(rows, _RECORD)


def _batch(rows: list, schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def lookup(urls: DataFrame, index: DataFrame, index_folder: str, archive_folder: str) -> DataFrame:
    """Records of the given urls (column ``url``): key, page, record_type, payload_bytes,
    payload_digest, refers_to, payload.

    The files' key ranges (one row a file) are sent to every task.  A url's
    captures are found however many files they run over; they are read a block at a
    time, by different tasks, and no task holds more than BATCH_BYTES of payload and
    one record.
    """
    spark = urls.sparkSession
    ranges = sorted((r["first"], r["last"], r["file"]) for r in index.select("first", "last", "file").collect())
    shared = spark.sparkContext.broadcast(ranges)

    def route(batches):
        firsts = [r[0] for r in shared.value]
        for batch in batches:
            keys, files = [], []
            for key in {surt(u) for u in batch.column("url").to_pylist()}:
                # files are in key order: the last that starts before the key, then on
                i = max(bisect.bisect_left(firsts, key) - 1, 0)
                while i < len(firsts) and firsts[i] <= key:
                    if shared.value[i][1] >= key:
                        keys.append(key)
                        files.append(shared.value[i][2])
                    i += 1
            yield pa.RecordBatch.from_pydict({"key": keys, "file": files},
                                             schema=pa.schema([("key", pa.string()), ("file", pa.string())]))

    keys = urls.select(F.col("url").cast("string").alias("url")).distinct()
    # a row stands for a block of captures, so rows are dealt out by block, as many parts
    # as a shuffle has: their own few bytes say nothing of the payloads to read
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return (keys.mapInArrow(route, "key string, file string").distinct()
            .repartitionByRange("file", "key").sortWithinPartitions("file", "key")
            .mapInArrow(lambda batches: locate(batches, index_folder), "key string, file string, block int")
            .repartition(parts, "file", "block").sortWithinPartitions("file", "block", "key")
            .mapInArrow(lambda batches: read_records(batches, index_folder, archive_folder),
                        "key string, page string, record_type string, payload_bytes long, payload_digest string, "
                              "refers_to string, payload binary"))


_PLACE = pa.schema([("key", pa.string()), ("file", pa.string()), ("block", pa.int32())])
_RECORD = pa.schema([("key", pa.string()), ("page", pa.string()), ("record_type", pa.string()), ("payload_bytes", pa.int64()),
                     ("payload_digest", pa.string()), ("refers_to", pa.string()), ("payload", pa.binary())])


def round_trip(pages: DataFrame, min_revisit_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """Write archives and index, then look up every url of the pages.

    Returns page_id, payload_bytes, payload_digest, record_type, refers_to.
    """
    spark = pages.sparkSession
    archives, indexes = scratch_path(spark, "warc"), scratch_path(spark, "warc-index-files")
    index = build_index(write(pages, archives, min_revisit_bytes), indexes)
    kind = pages.schema["page_id"].dataType
    back = lambda c: F.when(F.col(c) != "", F.expr(f"substr({c}, 2)")).cast(kind)
    return (lookup(pages, index, indexes, archives)
            .select(back("page").alias("page_id"), "payload_bytes", "payload_digest", "record_type",
                    back("refers_to").alias("refers_to"), F.length("payload").cast("long").alias("held_bytes")))
