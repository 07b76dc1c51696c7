"""Web archives with a two-level capture index.

Pages become WARC records, compressed one by one and written in the order of
their keys: host reversed, then path, date, id and digest. Of pages with equal
payloads of at least ``min_revisit`` bytes the one with the largest id is a
response, the others revisit it and hold no payload.

The index has a line for each capture, in key order. Lines are packed into
compressed blocks; each index file has a sparse directory with the first key of
every block, and one row per index file, with its first key, is all that the
driver sees (a task writes one file). A lookup searches the files' first keys,
then that file's directory, then the block, each by bisection, and reads ranges
of bytes only.

Files lie in the folder that all executors share and are named anew by each
attempt of a task; what a failed attempt left behind is in no index.

Ids are whole numbers.

Cases: a null html is an empty payload; a null url has an empty key before the
id; a page without an id is a response of its own; of pages that tie in payload
the largest id is the response, and rows that repeat an id, url and payload are
repeated records of one kind; a very long payload is one record, held by one
task at a time; an empty table gives an empty archive; extra columns are
ignored, whatever their names.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import json
import uuid
import zlib
from collections import OrderedDict
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.batches import SLICE, slices
from quern.llm.reputation import url_host
from quern.shared import Scratch

DATE = "2024-01-01T00:00:00Z"
BLOCK_LINES = 3000
LEVEL = 4
#: Bytes after which a task begins another archive.
ROLL = 1 << 30
OPEN_FILES, OPEN_BLOCKS = 32, 4


def capture_key(page_id: Column, url: Column, digest: Column) -> Column:
    """``org,example,www)/path?query 20240101000000 id digest``, so that a site's captures stand together."""
    host = F.array_join(F.reverse(F.split(url_host(url), r"\.", -1)), ",")
    rest = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^#]*)", 1), F.lit(""))
    clean = F.regexp_replace(rest, r"[\x00-\x20]", "%20")
    return F.concat(F.regexp_replace(host, r"[\x00-\x20]", "%20"), F.lit(")"), clean, F.lit(" " + "".join(c for c in DATE if c.isdigit()) + " "), F.coalesce(F.lpad(page_id.cast("string"), 20, "0"), F.lit("-")), F.lit(" "), digest)


def base32_digest(hexed: str) -> str:
    return base64.b32encode(bytes.fromhex(hexed)).decode()


def _record(kind: str, page: str, url: str | None, digest: str, n: int, refers: str | None, payload: bytes) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n}\r\n\r\n".encode()
    body = http + payload
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{page}>", f"WARC-Date: {DATE}", "Content-Type: application/http;msgtype=response", f"WARC-Payload-Digest: sha1:{digest}", f"Payload-Length: {n}"]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    if refers is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers}>"]
    head.append(f"Content-Length: {len(body)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def gzip_member(data: bytes, level: int = LEVEL) -> bytes:
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def parse_record(member: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and payload of one compressed record; raises if it isn't whole."""
    z = zlib.decompressobj(31)
    raw = z.decompress(member) + z.flush()
    if not z.eof:
        raise ValueError("record cut short")
    head, _, rest = raw.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    headers = dict(x.split(": ", 1) for x in lines)
    body = rest[: int(headers["Content-Length"])]
    if not first.startswith("WARC/") or rest[len(body) :] != b"\r\n\r\n" or len(body) != int(headers["Content-Length"]):
        raise ValueError("no whole record")
    return headers, body.partition(b"\r\n\r\n")[2]


class _Writer:
    """Appends to files of a shared folder, each under a name that no other attempt uses."""

    def __init__(self, root: str, kind: str):
        self.root, self.kind, self.out, self.at, self.name = root, kind, None, 0, ""

    def add(self, data: bytes) -> tuple[str, int, int]:
        if self.out is None or self.at > ROLL:
            self.close()
            self.name, self.at = f"{self.kind}-{uuid.uuid4().hex}.gz", 0
            where, path = fs.FileSystem.from_uri(self.root)
            where.create_dir(path, recursive=True)
            self.out = where.open_output_stream(f"{path}/{self.name}", compression=None)
        at = self.at
        self.out.write(data)
        self.at += len(data)
        return self.name, at, len(data)

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.out = None


class _Reader:
    """Ranges of bytes of files in a shared folder; a few files stay open."""

    def __init__(self, root: str):
        self.where, self.path = fs.FileSystem.from_uri(root)
        self.files: OrderedDict[str, pa.NativeFile] = OrderedDict()

    def read(self, name: str, at: int, size: int) -> bytes:
        f = self.files.pop(name, None) or self.where.open_input_file(f"{self.path}/{name}")
        self.files[name] = f
        if len(self.files) > OPEN_FILES:
            self.files.popitem(last=False)[1].close()
        return f.read_at(size, at)


class CaptureArchive:
    """Archives and index of a table of pages."""

    def __init__(self, root: str, top: list[tuple[str, str, int, int]]):
        """``top``: for each index file its first key, name, and the range of its directory."""
        self.root, self.top = root, sorted(top)

    @staticmethod
    def write(pages: DataFrame, *, page_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_revisit: int = 0, block_lines: int = BLOCK_LINES) -> CaptureArchive:
        scratch = Scratch(pages.sparkSession, "warc")
        root = scratch.path("archive")
        payload = F.coalesce(F.col(payload_col).cast("binary"), F.lit("").cast("binary"))
        src = pages.select(F.col(page_col).alias("page"), F.col(url_col).alias("url"), payload.alias("payload")).withColumns({"digest": F.sha1("payload"), "n": F.octet_length("payload").cast("long")})
        src = src.withColumn("key", capture_key(F.col("page"), F.col("url"), F.col("digest")))
        narrow = scratch.put(src.select("key", "page", "digest", "n"))
        first = narrow.where((F.col("n") >= min_revisit) & F.col("page").isNotNull()).groupBy("digest", "n").agg(F.max("page").alias("response"), F.count("*").alias("copies")).where("copies > 1")
        revisits = narrow.join(first, ["digest", "n"]).where("page <> response").select("key", F.col("response").cast("string").alias("refers")).distinct()
        # what a page refers to comes just before it, so that payloads are shuffled once
        none = F.lit(None)
        rows = src.select("key", F.lit(1).alias("kind"), F.col("page").cast("string").alias("page"), "url", "digest", "n", none.cast("string").alias("refers"), "payload").union(
            revisits.select("key", F.lit(0).alias("kind"), none.cast("string"), none.cast("string"), none.cast("string"), none.cast("long"), "refers", none.cast("binary")),
        )

        def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            archive, index = _Writer(root, "warc"), _Writer(root, "cdx")
            key_now, refers_now, lines, firsts = None, None, [], []

            def block() -> None:
                if lines:
                    firsts.append([lines[0].partition("\t")[0], *index.add(gzip_member("\n".join(lines).encode()))])
                    lines.clear()

            for b in slices(batches, 7):
                for key, kind, page, url, digest, n, refers, data in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    if kind == 0:
                        key_now, refers_now = key, refers
                        continue
                    to = refers_now if key == key_now else None
                    name, at, size = archive.add(gzip_member(_record("response" if to is None else "revisit", page or "-", url, base32_digest(digest), n, to, data if to is None else b"")))
                    lines.append(f"{key}\t{json.dumps([name, at, size])}")
                    if len(lines) >= block_lines:
                        block()
            block()
            archive.close()
            top = []
            if firsts:
                index.close()
                directory = _Writer(root, "dir")
                name, at, size = directory.add(gzip_member(json.dumps(firsts).encode()))
                directory.close()
                top = [(firsts[0][0], name, at, size)]
            cols = list(zip(*top, strict=True)) or [()] * 4
            kinds = (pa.string(), pa.string(), pa.int64(), pa.int64())
            yield pa.record_batch([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["key", "name", "at", "size"])

        dealt = rows.repartitionByRange(_tasks(pages), "key").sortWithinPartitions("key", "kind")
        written = scratch.put(dealt.mapInArrow(write, "key string, name string, at long, size long"))
        return CaptureArchive(root, [tuple(r) for r in written.collect()])  # a row for each index file

    def lookup(self, wanted: DataFrame, payloads: bool = True) -> DataFrame:
        """``wanted(key, ...)`` with each capture's record type, payload and headers; the payload of a revisit is null.

        Rows without a capture have null in the new columns; a payload whose
        digest isn't the record's raises. Without ``payloads`` they are read and
        tested, but not returned. Reading in key
        order makes each task read its ranges of few files one after another.
        """
        root, top = self.root, self.top
        rest = wanted.columns
        shared = wanted.sparkSession.sparkContext.broadcast(top)

        def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            look = CaptureReader(root, shared.value)
            for b in (part for batch in batches for part in look.parts(batch)):
                found = [look.find(k) for k in b.column("key").to_pylist()]
                got = [look.record(x) if x else (None, None) for x in found]
                head = lambda name: pa.array([h.get(name) if h else None for h, _ in got], pa.string())
                yield pa.record_batch([
                    *(b.column(c) for c in rest), head("WARC-Type"), head("WARC-Payload-Digest"), head("Payload-Length"), head("WARC-Refers-To"), head("WARC-Record-ID"), pa.array([p if payloads and h and h["WARC-Type"] == "response" else None for h, p in got], pa.binary()),
                ], names=[*rest, "record_type", "digest", "payload_length", "refers", "record_id", "payload"])

        kinds = ", ".join(f"{c} {wanted.schema[c].dataType.simpleString()}" for c in rest)
        dealt = wanted.repartitionByRange(_tasks(wanted), "key").sortWithinPartitions("key")
        return dealt.mapInArrow(find, f"{kinds}, record_type string, digest string, payload_length string, refers string, record_id string, payload binary")


class CaptureReader:
    """Lookups by bisection: index files, their directories, blocks, lines."""

    def __init__(self, root: str, top: list[tuple[str, str, int, int]]):
        self.files, self.top, self.firsts = _Reader(root), top, [t[0] for t in top]
        self.directories: OrderedDict[str, list] = OrderedDict()
        self.blocks: OrderedDict[tuple[str, int], tuple[list[str], list[str]]] = OrderedDict()

    def _kept(self, cache: OrderedDict, key, make):
        value = cache.pop(key, None)
        value = cache[key] = make() if value is None else value
        if len(cache) > OPEN_BLOCKS:
            cache.popitem(last=False)
        return value

    def _lines(self, name: str, at: int, size: int) -> tuple[list[str], list[str]]:
        pairs = [x.split("\t") for x in zlib.decompress(self.files.read(name, at, size), 31).decode().split("\n")]
        return [p[0] for p in pairs], [p[1] for p in pairs]

    def find(self, key: str | None) -> list | None:
        """Archive, place and size of the capture, or None."""
        i = bisect.bisect_right(self.firsts, key) - 1 if key is not None else -1
        if i < 0:
            return None
        _, name, at, size = self.top[i]
        directory = self._kept(self.directories, name, lambda: json.loads(zlib.decompress(self.files.read(name, at, size), 31)))
        _, name, at, size = directory[max(0, bisect.bisect_right(directory, [key, "\U0010ffff"]) - 1)]
        keys, places = self._kept(self.blocks, (name, at), lambda: self._lines(name, at, size))
        j = bisect.bisect_left(keys, key)
        return json.loads(places[j]) if j < len(keys) and keys[j] == key else None

    def parts(self, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        """The batch in parts whose records take about ``SLICE`` bytes in their files."""
        begin, total = 0, 0
        for i, key in enumerate(batch.column("key").to_pylist()):
            n = (self.find(key) or (None, 0, 0))[2]
            if i > begin and total + n > SLICE:
                yield batch.slice(begin, i - begin)
                begin, total = i, 0
            total += n
        if batch.num_rows > begin:
            yield batch.slice(begin)

    def record(self, place: list) -> tuple[dict[str, str], bytes]:
        headers, payload = parse_record(self.files.read(*place))
        if headers["WARC-Type"] == "response" and (len(payload) != int(headers["Payload-Length"]) or headers["WARC-Payload-Digest"] != "sha1:" + base32_digest(hashlib.sha1(payload).hexdigest())):
            raise ValueError(f"{place}: the payload isn't what its record says")
        return headers, payload


def _tasks(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def read_back(archive: CaptureArchive, pages: DataFrame, *, page_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """``page_id, payload_bytes, payload_digest, record_type, refers_to`` of every page, from its record; a wrong digest raises."""
    payload = F.coalesce(F.col(payload_col).cast("binary"), F.lit("").cast("binary"))
    wanted = pages.select(F.col(page_col).alias("page_id"), capture_key(F.col(page_col), F.col(url_col), F.sha1(payload)).alias("key"))
    got = archive.lookup(wanted, payloads=False)
    refers = F.regexp_extract("refers", "page:(-?[0-9]+)", 1)
    return got.select("page_id", F.col("payload_length").cast("long").alias("payload_bytes"), F.regexp_replace("digest", "^sha1:", "").alias("payload_digest"), "record_type", F.when(F.col("refers").isNotNull(), refers).cast("long").alias("refers_to"))
