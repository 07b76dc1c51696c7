"""Append-only files of commands, as a source and a sink.

A command is an array of bulk strings: ``*n``, then ``$bytes`` and the string
for each argument, all ended by CR LF. Files are written by the text writer
from built-in expressions, in ranges of the log's order. Strings may hold any
character, line ends too, so reading needs a parser; it runs file by file, so a
log should be kept in files of moderate size, as the sink leaves them (Spark
hands over a file as one binary value, of 2 GB at most).
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.shared import ship

CRLF = b"\r\n"
#: Bytes of a file that are parsed at once.
PIECE = 1 << 20


class ProtocolError(ValueError):
    pass


class Framer:
    """Commands of a stream of bytes that comes in pieces: each ``feed`` gives those that are whole by then."""

    def __init__(self):
        self.data, self.begun = bytearray(), 0

    def feed(self, piece: bytes) -> Iterator[tuple[int, list[str]]]:
        """``(offset, arguments)``, the offset in the whole stream; what isn't whole waits for more."""
        self.data += piece
        at = 0
        while (found := self._command(at)) is not None:
            args, end = found
            yield self.begun + at, args
            at = end
        del self.data[:at]
        self.begun += at

    def _head(self, at: int, mark: bytes, what: str) -> tuple[int, int] | None:
        """The number of a line that begins with ``mark``, and where the next line begins."""
        end = self.data.find(CRLF, at)
        if at < len(self.data) and self.data[at : at + 1] != mark:
            raise ProtocolError(f"expected {what} at {self.begun + at}")
        if end < 0:
            return None
        number = bytes(self.data[at + 1 : end])
        if not number.removeprefix(b"-").isdigit():
            raise ProtocolError(f"expected {what} at {self.begun + at}")
        return int(number), end + 2

    def _command(self, at: int) -> tuple[list[str], int] | None:
        if at >= len(self.data) or (head := self._head(at, b"*", "array of bulk strings")) is None:
            return None
        (count, at), args = head, []
        for _ in range(count):
            if (head := self._head(at, b"$", "a bulk string")) is None:
                return None
            size, at = head
            if at + size + 2 > len(self.data):
                return None
            args.append(self.data[at : at + size].decode("utf-8", "replace"))
            at += size + 2
        return args, at


def parse_commands(data: bytes, piece: int = PIECE) -> Iterator[tuple[int, list[str]]]:
    """``(offset, arguments)`` of each whole command; an unfinished one at the end is left out."""
    framer = Framer()
    for at in range(0, len(data), piece):
        yield from framer.feed(data[at : at + piece])


def _parsed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """``file, at, cmd, args`` of files, some thousand commands at a time."""
    for b in batches:
        for name, data in zip(b["path"], b["content"], strict=True):
            commands = parse_commands(data)
            while rows := list(islice(commands, 10_000)):
                yield pd.DataFrame({"file": name, "at": [r[0] for r in rows], "cmd": [r[1][0].upper() if r[1] else "" for r in rows], "args": [r[1] for r in rows]})


def encode_command(args: Column) -> Column:
    """The wire form of an array of strings, without the last line end."""
    each = F.transform(args, lambda a: F.concat(F.lit("$"), F.octet_length(a).cast("string"), F.lit("\r\n"), a))
    return F.concat(F.lit("*"), F.size(args).cast("string"), F.lit("\r\n"), F.array_join(each, "\r\n"))


def write(log: DataFrame, path: str, files: int | None = None, mode: str = "append") -> None:
    """Append ``log(seq, args)`` in order of ``seq``; file names sort as the log does within one call."""
    n = files or int(log.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = log.repartitionByRange(n, "seq").sortWithinPartitions("seq")
    ordered.select(encode_command(F.col("args")).alias("value")).write.mode(mode).option("lineSep", "\r\n").text(path)


def read(spark: SparkSession, path: str, db: int = 0) -> DataFrame:
    """``file, at, db, cmd, args``: (file, at) is the order of the log."""
    ship(spark)
    raw = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").load(path).select("path", "content")
    return raw.mapInPandas(_parsed, "file string, at long, cmd string, args array<string>").withColumn("db", F.lit(db))


def tail(spark: SparkSession, path: str) -> DataFrame:
    """New files of the log as a stream, parsed as they come."""
    ship(spark)
    schema = "path string, modificationTime timestamp, length long, content binary"
    raw = spark.readStream.schema(schema).format("binaryFile").option("pathGlobFilter", "*.txt").load(path)
    return raw.select("path", "content").mapInPandas(_parsed, "file string, at long, cmd string, args array<string>")
