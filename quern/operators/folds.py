"""Folding a log of commands key by key, where the effect of each depends on all before it.

``fold`` runs every single-key command that changes strings, lists, hashes, sets
or sorted sets, in order, and gives the rows that are left. Commands on several
keys that don't depend on each other (MSET, DEL of many) are split with
``split_keys`` before; those that carry values from key to key need the engine.

A key's log is sorted within its group and held by one task. Where a command
only overwrites or adds, the grouped forms of ``commandlog`` and the other
modules do without that.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.shared import ship

#: ``pos`` orders lists, ``name`` is a field or member; ``error`` tells of commands that were refused.
ROWS = "type string, pos long, name string, value string, score double, due_ms long, errors long"


class Refused(Exception):
    pass


def _places(n: int, start: int, stop: int) -> tuple[int, int]:
    lo, hi = (x + n if x < 0 else x for x in (start, stop))
    return max(lo, 0), min(hi, n - 1)


def _integer(text: str) -> int:
    try:
        n = int(text)
    except ValueError:
        raise Refused("value is not an integer or out of range") from None
    if not -(1 << 63) <= n < 1 << 63 or not text.lstrip("-").isdigit():
        raise Refused("value is not an integer or out of range")
    return n


def _number(text: str) -> float:
    try:
        x = float(text)
    except ValueError:
        raise Refused("value is not a valid float") from None
    if x - x != 0:
        raise Refused("value is not a valid float")
    return x


def plain(x: float) -> str:
    return str(int(x)) if x.is_integer() and abs(x) < 1e21 else repr(x)


class Cell:
    """One key: its type, its value, and the time it falls due."""

    def __init__(self):
        self.type, self.value, self.due = None, None, None

    def clear(self) -> None:
        self.type = self.value = self.due = None

    def of(self, kind: str, make: Callable):
        if self.type is None:
            self.type, self.value = kind, make()
        elif self.type != kind:
            raise Refused("WRONGTYPE Operation against a key holding the wrong kind of value")
        return self.value

    def text(self) -> str:
        return self.of("string", str)

    # strings
    def set(self, value, *options):
        options, due, keep = list(options), None, False
        while options:
            o = options.pop(0).upper()
            if o in ("NX", "XX"):
                if (self.type is not None) == (o == "NX"):
                    return
            elif o == "KEEPTTL":
                keep = True
            elif o in ("EXAT", "PXAT"):
                due = _integer(options.pop(0)) * (1000 if o == "EXAT" else 1)
            elif o != "GET":
                raise Refused("syntax error")
        self.type, self.value, self.due = "string", value, due if due is not None else self.due if keep else None

    def setnx(self, value):
        self.set(value, "NX")

    def getset(self, value):
        self.text()
        self.set(value)

    def append(self, value):
        self.value = self.text() + value

    def incrby(self, by):
        old = self.text()
        n = (_integer(old) if old else 0) + _integer(str(by))
        self.value = str(_integer(str(n)))

    def incr(self):
        self.incrby("1")

    def decr(self):
        self.incrby("-1")

    def decrby(self, by):
        self.incrby(str(-_integer(by)))

    def incrbyfloat(self, by):
        old = self.text()
        self.value = plain((_number(old) if old else 0.0) + _number(by))

    def setrange(self, offset, new):
        at = _integer(offset)
        self.value = (old := self.text()).ljust(at, "\0")[:at] + new + old[at + len(new) :]

    # lists
    def lpush(self, *values):
        self.of("list", deque).extendleft(values)

    def rpush(self, *values):
        self.of("list", deque).extend(values)

    def lpop(self):
        if self.of("list", deque):
            self.value.popleft()

    def rpop(self):
        if self.of("list", deque):
            self.value.pop()

    def lset(self, i, value):
        own = self.of("list", deque)
        at = _integer(i) + (len(own) if _integer(i) < 0 else 0)
        if not 0 <= at < len(own):
            raise Refused("index out of range")
        own[at] = value

    def ltrim(self, start, stop):
        own = self.of("list", deque)
        lo, hi = _places(len(own), _integer(start), _integer(stop))
        self.value = deque(x for i, x in enumerate(own) if lo <= i <= hi)

    def lrem(self, count, value):
        own, n = list(self.of("list", deque)), _integer(count)
        left, out = abs(n) or len(own), []
        for x in reversed(own) if n < 0 else own:
            if x == value and left:
                left -= 1
            else:
                out.append(x)
        self.value = deque(reversed(out) if n < 0 else out)

    # hashes, sets, sorted sets
    def hset(self, *pairs):
        self.of("hash", dict).update(zip(pairs[::2], pairs[1::2], strict=True))

    hmset = hset

    def hdel(self, *fields):
        for f in fields:
            self.of("hash", dict).pop(f, None)

    def sadd(self, *members):
        self.of("set", set).update(members)

    def srem(self, *members):
        self.of("set", set).difference_update(members)

    def zadd(self, *pairs):
        for score, member in zip(pairs[::2], pairs[1::2], strict=True):
            self.of("zset", dict)[member] = _number(score)

    def zrem(self, *members):
        for m in members:
            self.of("zset", dict).pop(m, None)

    def zincrby(self, by, member):
        own = self.of("zset", dict)
        own[member] = own.get(member, 0.0) + _number(by)

    # keys
    def delete(self):
        self.clear()

    def persist(self):
        self.due = None

    def pexpireat(self, ms):
        if self.type is not None:
            self.due = _integer(ms)

    def expireat(self, s):
        self.pexpireat(str(_integer(s) * 1000))

    def rows(self) -> list[tuple]:
        """``pos, name, value, score`` of what is left; an empty container is no key."""
        v = self.value
        if self.type == "string":
            return [(None, None, v, None)]
        if self.type == "list":
            return [(i, None, x, None) for i, x in enumerate(v)]
        if self.type == "hash":
            return [(None, f, x, None) for f, x in v.items()]
        if self.type == "set":
            return [(None, m, None, None) for m in sorted(v)]
        return [(None, m, None, s) for m, s in sorted(v.items())] if self.type == "zset" else []


COMMANDS = {name.upper(): name for name in vars(Cell) if not name.startswith("_") and name not in ("clear", "of", "text", "rows", "delete")} | {"DEL": "delete"}


def split_keys(log: DataFrame) -> DataFrame:
    """``log(seq, db, cmd, args)`` as ``db, key, seq, cmd, args`` by key; MSET and DEL of many keys are one command a key."""
    args, n = F.col("args"), F.size("args")
    pairs = F.transform(F.sequence(F.lit(0), F.floor(n / 2).cast("int") - 1), lambda i: F.struct(F.get("args", i * 2).alias("key"), F.array(F.get("args", i * 2 + 1)).alias("args")))
    each = F.transform(args, lambda k: F.struct(k.alias("key"), F.array().cast("array<string>").alias("args")))
    own = F.array(F.struct(args[0].alias("key"), F.slice(args, F.lit(2), F.greatest(n - 1, F.lit(0))).alias("args")))
    parts = F.when(F.col("cmd") == "MSET", pairs).when(F.col("cmd") == "DEL", each).otherwise(own)
    return log.where("size(args) > 0").select("db", "seq", F.when(F.col("cmd") == "MSET", "SET").otherwise(F.col("cmd")).alias("cmd"), F.explode(parts).alias("_x")).select("db", F.col("_x.key").alias("key"), "seq", "cmd", F.col("_x.args").alias("args"))


def fold(log: DataFrame) -> DataFrame:
    """``db, key`` and ``ROWS`` left by ``log(db, key, seq, cmd, args)``.

    A refused command changes nothing and counts in ``errors``. Keys without a
    value have no rows. A command that isn't known here raises, so that no log
    is folded in part.
    """
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        cell, errors = Cell(), 0
        pdf = pdf.sort_values("seq", kind="stable")
        for cmd, args in zip(pdf["cmd"], pdf["args"], strict=True):
            if cmd not in COMMANDS:
                raise ValueError(f"{cmd} can't be folded by key")
            try:
                getattr(cell, COMMANDS[cmd])(*args)
            except Refused:
                errors += 1
            except (TypeError, IndexError, ValueError):  # a wrong number of arguments
                errors += 1
            if cell.type not in (None, "string") and not cell.value:
                cell.clear()
        rows = cell.rows()
        names = ["pos", "name", "value", "score"]
        out = pd.DataFrame(rows, columns=names)
        out["pos"] = out["pos"].astype("Int64")
        out["score"] = out["score"].astype("float64")
        out.insert(0, "type", cell.type)
        out.insert(0, "key", pdf["key"].iloc[0])
        out.insert(0, "db", pdf["db"].iloc[0])
        out["due_ms"] = pd.array([cell.due] * len(out), dtype="Int64")
        out["errors"] = errors
        return out

    ship(log.sparkSession)
    kinds = {c: log.schema[c].dataType.simpleString() for c in ("db", "key")}
    ordered = log.withColumn("seq", F.row_number().over(_by_key())) if "struct" in log.schema["seq"].dataType.simpleString() else log
    return ordered.groupBy("db", "key").applyInPandas(run, f"db {kinds['db']}, key {kinds['key']}, {ROWS}")


def _by_key():
    from pyspark.sql import Window

    return Window.partitionBy("db", "key").orderBy("seq")
