"""A facade with a method for each command: ``Engine(spark).zadd("Z", {"a": 1.0})``.

Values live in one table a type. Reads return DataFrames; writes replace a table
by what the operators make of it, and cut its lineage in the shared folder after
every ``CUT`` writes. A key past its time doesn't exist, for reads and writes
alike, and a command on a key of another type raises ``CommandError``; both are
told by one small query a command. For bulk work use the operators.

``call`` takes commands by name, as the shell does, minds permissions, keeps the
slow log, tells subscribers of changes, and queues between MULTI and EXEC.
"""

from __future__ import annotations

import json
import re
import time
from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions import embedders
from quern.operators import acl, bits, docindex, folds, geo, hashes, jsondoc, jsonedit, keyspace, lists, notify, sets, sketches, streams, strings, timeseries, vectorgraph, vectors, zsets
from quern.shared import Scratch
from quern.sources import aof, snapshot

SCHEMAS = {
    "string": "key string, value string", "list": "key string, pos long, value string", "hash": "key string, field string, value string", "set": "key string, member string",
    "zset": "key string, member string, score double", "geo": "key string, member string, lon double, lat double", "ts": "key string, ts long, value double", "hll": "key string, idx int, rho int",
    "stream": "key string, arrival long, id string, fields map<string,string>", "vector": "key string, id string, insert_order long, embedding array<double>", "json": "key string, doc string",
    "bit": "key string, bit long", "cuckoo": "key string, fp int, lo long, hi long, n long", "expiry": "key string, due_ms long", "ts_meta": "key string, retention_ms long",
    "ts_rule": "src string, dst string, agg string, bucket_ms long", "group": "key string, grp string, last_id string", "pending": "key string, grp string, id string, arrival long, consumer string",
}
#: Tables that hold no values of their own.
BESIDE = ("cuckoo", "expiry", "ts_meta", "ts_rule", "group", "pending")
VALUES = tuple(k for k in SCHEMAS if k not in BESIDE)
CUT = 8
SLOW_US, SLOW_KEPT = 1000, 128
KV, ITEM = "key string, value string, pos int", "key string, item string"


class CommandError(ValueError):
    pass


class Engine:
    def __init__(self, spark: SparkSession, tables: dict[str, DataFrame] | None = None, clock: Callable[[], int] | None = None):
        """``clock`` gives the present in milliseconds."""
        self.spark, self.scratch, self.writes, self.count, self.queue = spark, Scratch(spark, "engine"), 0, 0, None
        self.now = clock or (lambda: int(time.time() * 1000))
        self.databases: dict[int, dict[str, DataFrame]] = {0: self._fresh() | (tables or {})}
        self.filled: dict[int, set[str]] = {0: set(tables or ())}  # tables that were written; the others are empty
        self.db, self.user, self.users = 0, "default", acl.Users()
        self.flags, self.subscribers, self.inbox = "", {}, {}
        self.slow: list[tuple] = []
        self.calls, self.began = 0, self.now()
        self.catalog, self.graphs = docindex.Catalog(), {}

    # tables
    def _fresh(self) -> dict[str, DataFrame]:
        return {k: self.spark.createDataFrame([], s) for k, s in SCHEMAS.items()}

    @property
    def tables(self) -> dict[str, DataFrame]:
        return self.databases[self.db]

    def _rows(self, rows: Iterable[tuple], schema: str) -> DataFrame:
        """``schema``, or the name of a table."""
        return self.spark.createDataFrame(list(rows), SCHEMAS.get(schema, schema))

    def _put(self, kind: str, df: DataFrame) -> None:
        self.writes += 1
        self.filled.setdefault(self.db, set()).add(kind)
        self.tables[kind] = self.scratch.put(df) if self.writes % CUT == 0 else df

    def _written(self, kinds: Iterable[str] = SCHEMAS) -> list[str]:
        return [k for k in kinds if k in self.filled.get(self.db, ())]

    def _replace(self, kind: str, new: DataFrame, *keys: str) -> None:
        self._put(kind, self.tables[kind].where(~F.col("key").isin(*keys)).union(new.select(*self.tables[kind].columns)))

    def _next(self) -> int:
        self.count += 1
        return self.count

    def _found(self, *keys: str) -> dict[str, str]:
        """Type by key of those that exist; what has expired is removed."""
        parts = [self.tables[k].where(F.col("key").isin(*keys)).select("key", F.lit(k).alias("type"), F.lit(None).cast("long").alias("due_ms")) for k in self._written(VALUES)]
        if not parts:
            return {}
        parts.append(self.tables["expiry"].where(F.col("key").isin(*keys)).select("key", F.lit("").alias("type"), "due_ms"))
        rows = reduce(DataFrame.union, parts).distinct().collect()  # a row or two for each key asked for
        gone = {r.key for r in rows if r.due_ms is not None and r.due_ms <= self.now()}
        if gone:
            self.delete(*gone)
        return {r.key: r.type for r in rows if r.type and r.key not in gone}

    def _typed(self, kind: str, *keys: str) -> None:
        """Raise if a key holds a value of another type."""
        if any(t != kind for t in self._found(*keys).values()):
            raise CommandError("WRONGTYPE Operation against a key holding the wrong kind of value")

    def _own(self, kind: str, *keys: str) -> DataFrame:
        """The keys' rows, once their type is found to be right."""
        self._typed(kind, *keys)
        return self.tables[kind].where(F.col("key").isin(*keys))

    def _live(self, kind: str) -> DataFrame:
        due = self.tables["expiry"].where(F.col("due_ms") <= self.now())
        return self.tables[kind].join(due, "key", "left_anti")

    # keys
    def keyspace(self) -> DataFrame:
        parts = [self.tables[k].select("key", F.lit(k).alias("type")) for k in self._written(VALUES) or VALUES[:1]]
        every = sets.union_all(*parts).distinct().join(self.tables["expiry"], "key", "left")
        return every.where(F.col("due_ms").isNull() | (F.col("due_ms") > self.now()))

    def keys(self, pattern: str = "*") -> DataFrame:
        return keyspace.keys(self.keyspace(), pattern).select("key")

    def scan(self, cursor: int = 0, match: str | None = None, count: int = 10) -> DataFrame:
        return keyspace.scan(self.keyspace(), "key", cursor=cursor, count=count, match=match).select("key")

    def type(self, key: str) -> DataFrame:
        return keyspace.type_of(self.keyspace(), self._rows([(key,)], "key string"))

    def exists(self, *keys: str) -> DataFrame:
        return keyspace.exists(self.keyspace(), self._rows([(k,) for k in keys], "key string"))

    def delete(self, *keys: str) -> None:
        for kind in self._written():
            if kind != "ts_rule":
                self._put(kind, self.tables[kind].where(~F.col("key").isin(*keys)))

    def rename(self, src: str, dst: str, only_new: bool = False) -> int:
        there = self._found(src, dst)
        if src not in there:
            raise CommandError("no such key")
        if src == dst or (only_new and dst in there):
            return int(src == dst and not only_new)
        names = self._rows([(src, dst)], "src string, dst string")
        self.delete(dst)
        for kind in self._written():
            if kind != "ts_rule":
                self._put(kind, keyspace.rename(self.tables[kind], names))
        return 1

    def renamenx(self, src: str, dst: str) -> int:
        return self.rename(src, dst, True)

    def randomkey(self) -> DataFrame:
        return keyspace.random_key(self.keyspace(), self._next())

    def dbsize(self) -> DataFrame:
        return self.keyspace().agg(F.count("*").alias("n_keys"))

    def flushdb(self) -> None:
        self.databases[self.db], self.filled[self.db] = self._fresh(), set()

    def flushall(self) -> None:
        self.databases, self.filled = {0: self._fresh()} | ({self.db: self._fresh()} if self.db else {}), {}

    def select(self, db: int) -> None:
        self.db = int(db)
        self.databases.setdefault(self.db, self._fresh())

    def _due(self, key: str, due_ms: int | None) -> None:
        if due_ms is not None or "expiry" in self._written():
            self._replace("expiry", self._rows([(key, due_ms)] if due_ms is not None else [], "expiry"), key)

    def expire_at(self, key: str, due_ms: int) -> int:
        """1 if there is such a key; a time that has passed removes it."""
        if key not in self._found(key):
            return 0
        if int(due_ms) <= self.now():
            self.delete(key)
        else:
            self._due(key, int(due_ms))
        return 1

    def pexpireat(self, key: str, ms: int) -> int:
        return self.expire_at(key, int(ms))

    def expireat(self, key: str, seconds: int) -> int:
        return self.expire_at(key, int(seconds) * 1000)

    def expire(self, key: str, seconds: int) -> int:
        return self.expire_at(key, self.now() + int(seconds) * 1000)

    def pexpire(self, key: str, ms: int) -> int:
        return self.expire_at(key, self.now() + int(ms))

    def pttl(self, key: str) -> int:
        if key not in self._found(key):
            return -2
        due = self.tables["expiry"].where(F.col("key") == key).first()
        return due.due_ms - self.now() if due else -1

    def ttl(self, key: str) -> int:
        left = self.pttl(key)
        return -(-left // 1000) if left >= 0 else left

    def persist(self, key: str) -> None:
        self._due(key, None)

    def sweep(self, now_ms: int | None = None) -> int:
        """Remove what has expired, and tell how many keys that were; none of them comes to the driver."""
        now = self.now() if now_ms is None else now_ms
        gone = self.scratch.put(self.tables["expiry"].where(F.col("due_ms") <= now).select("key"))
        n = gone.count()
        if n:
            for kind in self._written():
                if kind != "ts_rule":
                    self._put(kind, keyspace.delete(self.tables[kind], gone))
        return n

    # strings
    def set(self, key: str, value: str, *, nx: bool = False, xx: bool = False, get: bool = False, keepttl: bool = False, ex: int | None = None, px: int | None = None, exat: int | None = None, pxat: int | None = None):
        """The old value with ``get``, else whether it was set; any value of another type is replaced."""
        if nx and xx:
            raise CommandError("syntax error")
        if any(x is not None and int(x) <= 0 for x in (ex, px)):
            raise CommandError("value is not an integer or out of range")
        there = self._found(key)
        old = None
        if there.get(key) == "string" and get:
            old = self.tables["string"].where(F.col("key") == key).first().value
        if (nx and key in there) or (xx and key not in there):
            return None if get else False
        if there.get(key, "string") != "string":
            kept = self.tables["expiry"]
            self.delete(key)
            self.tables["expiry"] = kept
        self._put("string", strings.mset(self.tables["string"], self._rows([(key, str(value), 0)], KV)))
        due = self.now() + int(ex) * 1000 if ex is not None else self.now() + int(px) if px is not None else int(exat) * 1000 if exat is not None else int(pxat) if pxat is not None else None
        if due is not None or not keepttl:
            self._due(key, due)
        return old if get else True

    def _text(self, key: str) -> str | None:
        row = self.get(key).first()
        return row.value if row else None

    def _change(self, key: str, value: str) -> None:
        """A new value that leaves the time to live."""
        self._put("string", strings.mset(self.tables["string"], self._rows([(key, value, 0)], KV)))

    def get(self, key: str) -> DataFrame:
        return self._own("string", key).select("value")

    def mget(self, *keys: str) -> DataFrame:
        return strings.mget(self._live("string"), self._rows(enumerate(keys), "pos int, key string")).orderBy("pos")

    def mset(self, pairs: dict[str, str]) -> None:
        self.delete(*pairs)
        self._put("string", strings.mset(self.tables["string"], self._rows([(k, str(v), i) for i, (k, v) in enumerate(pairs.items())], KV)))

    def msetnx(self, pairs: dict[str, str]) -> int:
        if self._found(*pairs):
            return 0
        self.mset(pairs)
        return 1

    def setnx(self, key: str, value: str) -> int:
        return int(self.set(key, value, nx=True))

    def setex(self, key: str, seconds: int, value: str) -> None:
        self.set(key, value, ex=seconds)

    def psetex(self, *_) -> None:
        raise CommandError("unknown command PSETEX")

    def getset(self, key: str, value: str) -> str | None:
        old = self._text(key)
        self.set(key, value)
        return old

    def getdel(self, key: str) -> str | None:
        old = self._text(key)
        self.delete(key)
        return old

    def getex(self, key: str, *, ex: int | None = None, px: int | None = None, persist: bool = False) -> str | None:
        old = self._text(key)
        if any(x is not None and int(x) <= 0 for x in (ex, px)):
            raise CommandError("value is not an integer or out of range")
        if old is not None and (persist or ex is not None or px is not None):
            self._due(key, None if persist else self.now() + (int(ex) * 1000 if ex is not None else int(px)))
        return old

    def append(self, key: str, suffix: str) -> None:
        self._change(key, (self._text(key) or "") + suffix)

    def incrby(self, key: str, by: int = 1) -> int:
        old = self._text(key)
        if old and not re.fullmatch(r"-?\d+", old):
            raise CommandError("value is not an integer or out of range")
        new = int(old or 0) + int(by)
        if not -(1 << 63) <= new < 1 << 63:
            raise CommandError("value is not an integer or out of range")
        self._change(key, str(new))
        return new

    def incr(self, key: str) -> int:
        return self.incrby(key, 1)

    def decr(self, key: str) -> int:
        return self.incrby(key, -1)

    def decrby(self, key: str, by: int) -> int:
        return self.incrby(key, -int(by))

    def incrbyfloat(self, key: str, by: float) -> str:
        try:
            new = float(self._text(key) or 0) + float(by)
        except ValueError:
            raise CommandError("value is not a valid float") from None
        self._change(key, folds.plain(new))
        return folds.plain(new)

    def strlen(self, key: str) -> DataFrame:
        return self.get(key).select(strings.strlen(F.col("value")).alias("n_bytes"))

    def getrange(self, key: str, start: int, end: int) -> DataFrame:
        return self.get(key).select(strings.getrange(F.col("value"), int(start), int(end)).alias("value"))

    substr = getrange

    def setrange(self, key: str, offset: int, text: str) -> None:
        old = (self._text(key) or "").ljust(int(offset), "\0")
        self._change(key, old[: int(offset)] + text + old[int(offset) + len(text) :])

    # bitmaps
    def setbit(self, key: str, bit: int, on: int) -> int:
        own = self._own("bit", key)
        old = own.where(F.col("bit") == int(bit)).count()
        rest = own.where(F.col("bit") != int(bit))
        self._replace("bit", rest.union(self._rows([(key, int(bit))], "bit")) if int(on) else rest, key)
        return old

    def getbit(self, key: str, bit: int) -> DataFrame:
        return bits.getbit(self._own("bit", key), self._rows([(key, int(bit))], "bit")).select("on")

    def bitcount(self, key: str, start: int | None = None, end: int | None = None) -> DataFrame:
        return bits.bitcount(self._own("bit", key), start, end).select("n_bits")

    def bitpos(self, key: str, on: int, start: int = 0, end: int | None = None) -> DataFrame:
        return bits.bitpos(self._own("bit", key), int(on), start, end).select("pos")

    def bitop(self, op: str, dest: str, *keys: str) -> None:
        own = self._own("bit", *keys)
        width = own.agg(F.max("bit")).first()[0] if op.upper() == "NOT" else None
        found = bits.bitop(own, op.upper(), list(keys), (width // 8 + 1) * 8 if width is not None else 0)
        self.delete(dest)
        self._put("bit", self.tables["bit"].union(found.select(F.lit(dest).alias("key"), "bit")))

    def bitfield(self, key: str, *ops: tuple) -> list[int | None]:
        """Subcommands as in ``bits.bitfield``, over the key's bitmap."""
        on = [r.bit for r in self._own("bit", key).collect()]
        n = max(on, default=-1) // 8 + 1
        data = sum(1 << (n * 8 - 1 - b) for b in on).to_bytes(n, "big")
        new, replies = bits._run(data, list(ops))
        if new != data:
            left = [(key, i) for i in range(len(new) * 8) if new[i // 8] >> (7 - i % 8) & 1]
            self._replace("bit", self._rows(left, "bit"), key)
        return replies

    def bitfield_ro(self, key: str, *fields: tuple) -> list[int]:
        return self.bitfield(key, *(("GET", *f) for f in fields))

    # lists
    def _push(self, key: str, values: tuple[str, ...], left: bool) -> int:
        own = self._own("list", key)
        n = own.count()
        if left:
            new = own.select("key", (F.col("pos") + len(values)).alias("pos"), "value").union(self._rows([(key, i, v) for i, v in enumerate(reversed(values))], "list"))
        else:
            new = own.union(self._rows([(key, n + i, v) for i, v in enumerate(values)], "list"))
        self._replace("list", new, key)
        return n + len(values)

    def lpush(self, key: str, *values: str) -> int:
        return self._push(key, values, True)

    def rpush(self, key: str, *values: str) -> int:
        return self._push(key, values, False)

    def lpop(self, key: str) -> str | None:
        return self._pop(key, lists.lpop, lists.after_lpop)

    def rpop(self, key: str) -> str | None:
        return self._pop(key, lists.rpop, lists.after_rpop)

    def _pop(self, key: str, take, rest) -> str | None:
        own = self._own("list", key)
        got = take(own).first()
        self._replace("list", rest(own), key)
        return got.value if got else None

    def blpop(self, *keys: str) -> tuple[str, str] | None:
        """The head of the first list that has one; nothing waits here."""
        return next(((k, v) for k in keys if (v := self.lpop(k)) is not None), None)

    def brpop(self, *keys: str) -> tuple[str, str] | None:
        return next(((k, v) for k in keys if (v := self.rpop(k)) is not None), None)

    def lrange(self, key: str, start: int, stop: int) -> DataFrame:
        return lists.lrange(self._own("list", key), int(start), int(stop)).orderBy("pos").select("value")

    def lindex(self, key: str, i: int) -> DataFrame:
        return lists.lindex(self._own("list", key), int(i)).select("value")

    def lset(self, key: str, i: int, value: str) -> None:
        own = self._own("list", key)
        n = own.count()
        if not -n <= int(i) < n:
            raise CommandError("index out of range" if n else "no such key")
        self._replace("list", lists.lset(own, int(i), F.lit(value)), key)

    def llen(self, key: str) -> DataFrame:
        return self._own("list", key).agg(F.count("*").alias("length"))

    def ltrim(self, key: str, start: int, stop: int) -> None:
        self._replace("list", lists.ltrim(self._own("list", key), int(start), int(stop)), key)

    def lrem(self, key: str, count: int, value: str) -> None:
        self._replace("list", lists.lrem(self._own("list", key), int(count), F.lit(value)), key)

    def lmove(self, src: str, dst: str, from_side: str = "RIGHT", to_side: str = "LEFT") -> str | None:
        own = self._own("list", src, dst)
        ends = (lists.lpop if from_side.upper() == "LEFT" else lists.rpop)(own.where(F.col("key") == src)).first()
        if ends is None:
            return None
        if src == dst:
            (self.lpop if from_side.upper() == "LEFT" else self.rpop)(src)
            self._push(dst, (ends.value,), to_side.upper() == "LEFT")
        else:
            self._replace("list", lists.lmove(self.tables["list"], src, dst, from_side.upper(), to_side.upper()), src, dst)
        return ends.value

    def rpoplpush(self, src: str, dst: str) -> str | None:
        return self.lmove(src, dst)

    # hashes
    def hset(self, key: str, fields: dict[str, str]) -> int:
        own = self._own("hash", key)
        new = self._rows([(key, f, str(v)) for f, v in fields.items()], "hash")
        added = hashes.hset_new_fields(new, own).first()
        self._put("hash", self.tables["hash"].join(new.select("key", "field"), ["key", "field"], "left_anti").union(new))
        return added.added if added else 0

    hmset = hset

    def hget(self, key: str, field: str) -> DataFrame:
        return hashes.hget(self._own("hash", key), field).select("value")

    def hmget(self, key: str, *fields: str) -> DataFrame:
        wanted = self._rows(enumerate(fields), "pos int, field string")
        return wanted.join(self._own("hash", key).select("field", "value"), "field", "left").orderBy("pos").select("value")

    def hgetall(self, key: str) -> DataFrame:
        return self._own("hash", key).select("field", "value")

    def hdel(self, key: str, *fields: str) -> None:
        self._typed("hash", key)
        self._put("hash", hashes.hdel(self.tables["hash"], self._rows([(key, f) for f in fields], "key string, field string")))

    def hexists(self, key: str, field: str) -> DataFrame:
        return self._own("hash", key).agg(F.count(F.when(F.col("field") == field, 1)).cast("int").alias("present"))

    def hlen(self, key: str) -> DataFrame:
        return self._own("hash", key).agg(F.count("*").alias("n_fields"))

    def hkeys(self, key: str) -> DataFrame:
        return self._own("hash", key).select("field")

    def hvals(self, key: str) -> DataFrame:
        return self._own("hash", key).select("value")

    def hstrlen(self, key: str, field: str) -> DataFrame:
        return hashes.hstrlen(self._own("hash", key), field).select("n_bytes")

    def hscan(self, key: str, cursor: int = 0, match: str | None = None, count: int = 10) -> DataFrame:
        return keyspace.scan(self._own("hash", key), "field", cursor=cursor, count=count, match=match, key="field").select("field", "value")

    # sets
    def sadd(self, key: str, *members: str) -> int:
        own = self._own("set", key)
        new = self._rows([(key, m) for m in dict.fromkeys(members)], "set").join(own, ["key", "member"], "left_anti")
        n = new.count()
        self._replace("set", own.union(new), key)
        return n

    def srem(self, key: str, *members: str) -> None:
        self._typed("set", key)
        self._put("set", sets.srem(self.tables["set"], self._rows([(key, m) for m in members], "set")))

    def sismember(self, key: str, member: str) -> DataFrame:
        return self.smismember(key, member)

    def smismember(self, key: str, *members: str) -> DataFrame:
        wanted = self._rows([(i, key, m) for i, m in enumerate(members)], "pos int, key string, member string")
        there = self._own("set", key).withColumn("_there", F.lit(1))
        return wanted.join(there, ["key", "member"], "left").orderBy("pos").select(F.coalesce("_there", F.lit(0)).alias("present"))

    def smembers(self, key: str) -> DataFrame:
        return sets.smembers(self._own("set", key), key)

    def scard(self, key: str) -> DataFrame:
        return self._own("set", key).agg(F.count("*").alias("n_members"))

    def sinter(self, *keys: str) -> DataFrame:
        return sets.sinter(self._own("set", *keys), list(keys))

    def sunion(self, *keys: str) -> DataFrame:
        return sets.sunion(self._own("set", *keys), list(keys))

    def sdiff(self, first: str, *rest: str) -> DataFrame:
        return sets.sdiff(self._own("set", first, *rest), first, list(rest))

    def _store_set(self, dest: str, members: DataFrame) -> int:
        members = self.scratch.put(members)
        self.delete(dest)
        self._put("set", sets.store(self.tables["set"], dest, members))
        return members.count()

    def sinterstore(self, dest: str, *keys: str) -> int:
        return self._store_set(dest, self.sinter(*keys))

    def sunionstore(self, dest: str, *keys: str) -> int:
        return self._store_set(dest, self.sunion(*keys))

    def sdiffstore(self, dest: str, *keys: str) -> int:
        return self._store_set(dest, self.sdiff(*keys))

    def smove(self, src: str, dst: str, member: str) -> int:
        there = self._own("set", src, dst).where((F.col("key") == src) & (F.col("member") == member)).count()
        if there:
            self._put("set", sets.smove(self.tables["set"], self._rows([(src, dst, member)], "src string, dst string, member string")))
        return there

    def spop(self, key: str, count: int = 1) -> DataFrame:
        popped, rest = sets.spop(self._own("set", key), int(count), self._next())
        popped = self.scratch.put(popped)
        self._replace("set", rest, key)
        return popped.select("member")

    def srandmember(self, key: str, count: int = 1) -> DataFrame:
        return sets.srandmember(self._own("set", key), int(count), self._next()).select("member")

    def sscan(self, key: str, cursor: int = 0, match: str | None = None, count: int = 10) -> DataFrame:
        return keyspace.scan(self._own("set", key), "member", cursor=cursor, count=count, match=match, key="member").select("member")

    # sorted sets
    def zadd(self, key: str, scores: dict[str, float]) -> int:
        own = self._own("zset", key)
        new = self._rows([(key, m, float(s), 1) for m, s in scores.items()], "key string, member string, score double, seq int")
        added = new.join(own, ["key", "member"], "left_anti").count()
        self._replace("zset", zsets.zadd(own.withColumn("seq", F.lit(0)).union(new)), key)
        return added

    def zrem(self, key: str, *members: str) -> None:
        self._typed("zset", key)
        self._put("zset", zsets.zrem(self.tables["zset"], self._rows([(key, m) for m in members], "key string, member string")))

    def zincrby(self, key: str, by: float, member: str) -> float:
        old = self.zscore(key, member).first().score
        self.zadd(key, {member: (old or 0.0) + float(by)})
        return (old or 0.0) + float(by)

    def zscore(self, key: str, member: str) -> DataFrame:
        return zsets.zscore(self._own("zset", key), self._rows([(key, member)], "key string, member string")).select("score")

    def zcard(self, key: str) -> DataFrame:
        return self._own("zset", key).agg(F.count("*").alias("n_members"))

    def zrange(self, key: str, start: int, stop: int, reverse: bool = False) -> DataFrame:
        return zsets.zrange(self._own("zset", key), int(start), int(stop), reverse).orderBy("rank").select("member", "score")

    def zrevrange(self, key: str, start: int, stop: int) -> DataFrame:
        return self.zrange(key, start, stop, True)

    def zrangebyscore(self, key: str, low: float, high: float) -> DataFrame:
        return zsets.zrangebyscore(self._own("zset", key), float(low), float(high)).orderBy("score", "member").select("member", "score")

    def zrank(self, key: str, member: str, reverse: bool = False) -> DataFrame:
        return zsets.zrank(self._own("zset", key), reverse).where(F.col("member") == member).select("rank")

    def zrevrank(self, key: str, member: str) -> DataFrame:
        return self.zrank(key, member, True)

    def _zpop(self, key: str, count: int, largest: bool) -> list[str]:
        popped, rest = zsets.zpop(self._own("zset", key), int(count), largest)
        got = [r.member for r in popped.collect()]
        self._replace("zset", rest, key)
        return got

    def zpopmin(self, key: str, count: int = 1) -> list[str]:
        return self._zpop(key, count, False)

    def zpopmax(self, key: str, count: int = 1) -> list[str]:
        return self._zpop(key, count, True)

    def zscan(self, key: str, cursor: int = 0, match: str | None = None, count: int = 10) -> DataFrame:
        return keyspace.scan(self._own("zset", key), "score", "member", cursor=cursor, count=count, match=match, key="member").select("member", "score")

    # sketches
    def pfadd(self, key: str, *items: str) -> int:
        self._typed("hll", key)
        new = sketches.pfadd(self._rows([(key, i) for i in items], ITEM))
        changed = sketches.pfadd_changed(self.tables["hll"], new).first()
        self._put("hll", self.tables["hll"].union(new).groupBy("key", "idx").agg(F.max("rho").alias("rho")))
        return changed.changed if changed else 0

    def pfcount(self, *keys: str) -> DataFrame:
        return sketches.pfcount_union(self._own("hll", *keys), list(keys))

    def pfmerge(self, dest: str, *keys: str) -> None:
        merged = sketches.pfmerge(self._own("hll", *keys), list(keys), dest)
        self._replace("hll", merged, dest)

    def cf_reserve(self, key: str, capacity: int) -> int:
        """The number of buckets that such a filter has."""
        return sketches.buckets_of(int(capacity))

    def cf_add(self, key: str, *items: str) -> None:
        new = sketches.cf_add(self._rows([(key, i) for i in items], ITEM))
        self._put("cuckoo", self.tables["cuckoo"].union(new).groupBy("key", "fp", "lo", "hi").agg(F.sum("n").alias("n")))

    cf_madd = cf_insert = cf_add

    def cf_addnx(self, key: str, *items: str) -> list[int]:
        out = []
        for i in items:
            new = not self.cf_exists(key, i).first().present
            if new:
                self.cf_add(key, i)
            out.append(int(new))
        return out

    cf_insertnx = cf_addnx

    def cf_exists(self, key: str, *items: str) -> DataFrame:
        return sketches.cf_exists(self.tables["cuckoo"], self._rows([(key, i) for i in items], ITEM))

    cf_mexists = cf_exists

    def cf_del(self, key: str, item: str) -> int:
        there = self.cf_exists(key, item).first().present
        self._put("cuckoo", sketches.cf_delete(self.tables["cuckoo"], self._rows([(key, item)], ITEM)))
        return there

    # time series
    def ts_create(self, key: str, retention_ms: int | None = None) -> None:
        self._typed("ts", key)
        self._put("ts_meta", timeseries.create(self.tables["ts_meta"], self._rows([(key, retention_ms, self._next())], "key string, retention_ms long, seq int")))

    def ts_add(self, key: str, ts: int, value: float) -> None:
        last = self.ts_get(key).first()
        if last and ts < last.ts:
            raise CommandError("TSDB: timestamp is older than the last one")
        own = self.tables["ts"].where((F.col("key") == key) & (F.col("ts") != ts)).union(self._rows([(key, ts, float(value))], "ts"))
        self._replace("ts", timeseries.retain_each(own, self.tables["ts_meta"]), key)

    def ts_get(self, key: str) -> DataFrame:
        return timeseries.last(self._own("ts", key)).select("ts", "value")

    def ts_range(self, key: str, start: int, end: int, agg: str | None = None, bucket_ms: int | None = None) -> DataFrame:
        ruled = [tuple(r) for r in self.tables["ts_rule"].where(F.col("dst") == key).collect()]  # the rules of one series
        if ruled:
            src = self._own("ts", *(r[0] for r in ruled))
            own = timeseries.rules(src, self._rows(ruled, "ts_rule")).select("key", F.col("bucket").alias("ts"), "value")
        else:
            own = self._own("ts", key)
        if agg is None:
            return timeseries.between(own, start, end).orderBy("ts").select("ts", "value")
        return timeseries.buckets(own, start, end, agg, bucket_ms).orderBy("bucket").select("bucket", "value")

    def ts_createrule(self, src: str, dst: str, agg: str, bucket_ms: int) -> None:
        if agg not in timeseries.AGGREGATES or int(bucket_ms) <= 0:
            raise CommandError("syntax error")
        self._put("ts_rule", self.tables["ts_rule"].union(self._rows([(src, dst, agg, int(bucket_ms))], "ts_rule")))

    def ts_deleterule(self, src: str, dst: str) -> None:
        self._put("ts_rule", self.tables["ts_rule"].where(~((F.col("src") == src) & (F.col("dst") == dst))))

    # places
    def geoadd(self, key: str, *places: tuple[float, float, str]) -> None:
        bad = [m for lon, lat, m in places if not (-180 <= lon <= 180 and -90 <= lat <= 90)]
        if bad:
            raise CommandError("invalid longitude,latitude pair")
        self._typed("geo", key)
        new = self._rows([(key, m, float(lon), float(lat)) for lon, lat, m in places], "geo")
        self._put("geo", self.tables["geo"].join(new.select("key", "member"), ["key", "member"], "left_anti").union(new))

    def geopos(self, key: str, *members: str) -> DataFrame:
        return geo.geopos(self._own("geo", key), self._rows([(key, m) for m in members], "key string, member string")).select("member", "lon", "lat")

    def geodist(self, key: str, a: str, b: str, unit: str = "m") -> DataFrame:
        return geo.geodist(self._own("geo", key), self._rows([(key, a, b)], "key string, a string, b string"), unit).select("dist")

    def geosearch(self, key: str, lon: float, lat: float, radius: float, unit: str = "m", count: int | None = None) -> DataFrame:
        return geo.search_radius(self._own("geo", key), lon, lat, radius, unit, count).orderBy("dist", "member").select("member", "dist")

    georadius = geosearch

    def georadiusbymember(self, key: str, member: str, radius: float, unit: str = "m") -> DataFrame:
        own = self._own("geo", key)
        return geo.members_around(own, radius, unit, self._rows([(key, member)], "key string, member string")).select("member", "dist")

    def geosearchstore(self, dest: str, key: str, lon: float, lat: float, radius: float, unit: str = "m") -> int:
        found = self.scratch.put(geo.store(geo.search_radius(self._own("geo", key), lon, lat, radius, unit), dest))
        self.delete(dest)
        self._put("zset", self.tables["zset"].union(found))
        return found.count()

    def geohash(self, key: str, *members: str) -> DataFrame:
        return self._own("geo", key).where(F.col("member").isin(*members)).select("member", geo.geohash(F.col("lon"), F.col("lat")).alias("hash"))

    # JSON documents
    def json_set(self, key: str, path: str, value: str) -> None:
        own = self._own("json", key).first()
        doc = self._rows([(key, own.doc if own else None)], "json")
        if own is None and jsondoc.steps(path):
            doc = self._rows([(key, "{}")], "json")
        self._replace("json", doc.select("key", jsonedit.set_value(F.col("doc"), path, F.lit(value)).alias("doc")), key)

    def json_get(self, key: str, path: str = "$") -> DataFrame:
        return self._own("json", key).select(jsonedit.value_at(F.col("doc"), path).alias("value"))

    def json_mget(self, *keys: str, path: str = "$") -> DataFrame:
        wanted = self._rows(enumerate(keys), "pos int, key string")
        return wanted.join(self._live("json"), "key", "left").orderBy("pos").select(jsonedit.value_at(F.col("doc"), path).alias("value"))

    def _json(self, key: str, edited: Callable[[Column], Column]) -> str | None:
        row = self._own("json", key).select("key", edited(F.col("doc")).alias("x")).first()
        x = row.x if row else self._rows([(key, None)], "json").select(edited(F.col("doc")).alias("x")).first().x
        if x.error is not None:
            raise CommandError(x.error)
        if row:
            self._replace("json", self._rows([(key, x.doc)] if x.doc is not None else [], "json"), key)
        return x.reply

    def json_del(self, key: str, path: str = "$") -> int:
        return int(self._json(key, lambda d: jsonedit.delete(d, path)))

    json_forget = json_del

    def json_arrappend(self, key: str, path: str, *values: str) -> int:
        return int(self._json(key, lambda d: jsonedit.arrappend(d, path, *map(F.lit, values))))

    def json_arrinsert(self, key: str, path: str, index: int, *values: str) -> int:
        return int(self._json(key, lambda d: jsonedit.arrinsert(d, path, int(index), *map(F.lit, values))))

    def json_arrpop(self, key: str, path: str = "$", index: int = -1) -> str | None:
        return self._json(key, lambda d: jsonedit.arrpop(d, path, int(index)))

    def json_arrtrim(self, key: str, path: str, start: int, stop: int) -> int:
        return int(self._json(key, lambda d: jsonedit.arrtrim(d, path, int(start), int(stop))))

    def json_arrindex(self, key: str, path: str, value: str, start: int = 0, stop: int | None = None) -> DataFrame:
        return self._own("json", key).select(jsonedit.arrindex(F.col("doc"), path, F.lit(value), start, stop).alias("at"))

    def json_strappend(self, key: str, path: str, text: str) -> int:
        return int(self._json(key, lambda d: jsonedit.strappend(d, path, F.lit(text))))

    def json_numincrby(self, key: str, path: str, by: float) -> str:
        return self._json(key, lambda d: jsonedit.numincrby(d, path, float(by)))

    def json_nummultby(self, key: str, path: str, by: float) -> str:
        return self._json(key, lambda d: jsonedit.nummultby(d, path, float(by)))

    def json_toggle(self, key: str, path: str) -> int:
        return int(self._json(key, lambda d: jsonedit.toggle(d, path)))

    def json_clear(self, key: str, path: str = "$") -> int:
        return int(self._json(key, lambda d: jsonedit.clear(d, path)) or 0)

    def json_type(self, key: str, path: str = "$") -> DataFrame:
        return self._own("json", key).select(jsondoc.type_of(F.col("doc"), path).alias("type"))

    def json_objkeys(self, key: str, path: str = "$") -> DataFrame:
        return self._own("json", key).select(jsonedit.objkeys(F.col("doc"), path).alias("names"))

    def json_objlen(self, key: str, path: str = "$") -> DataFrame:
        return self._own("json", key).select(jsonedit.objlen(F.col("doc"), path).alias("n"))

    def json_arrlen(self, key: str, path: str = "$") -> DataFrame:
        return self._own("json", key).select(jsondoc.arrlen(F.col("doc"), path).alias("n"))

    def json_strlen(self, key: str, path: str = "$") -> DataFrame:
        return self._own("json", key).select(jsondoc.strlen(F.col("doc"), path).alias("n"))

    # streams
    def xadd(self, key: str, id_: str, fields: dict[str, str]) -> str:
        self._typed("stream", key)
        arrival = self._next()
        id_ = f"{self.now()}-{arrival}" if id_ == "*" else id_
        self._put("stream", self.tables["stream"].union(self._rows([(key, arrival, id_, fields)], "stream")))
        return id_

    def xrange(self, key: str, start: str = "-", end: str = "+") -> DataFrame:
        return streams.xrange(self._own("stream", key), start, end).orderBy("arrival").select("id", "fields")

    def xlen(self, key: str) -> DataFrame:
        return self._own("stream", key).agg(F.count("*").alias("length"))

    def xread(self, after: dict[str, str], count: int | None = None) -> DataFrame:
        return streams.xread(self._own("stream", *after), self._rows(after.items(), "key string, last_id string"), count).select("key", "id", "fields")

    def xgroup_create(self, key: str, grp: str, start: str = "$") -> None:
        made = streams.xgroup_create(self._own("stream", key), grp, start)
        self._put("group", self.tables["group"].where(~((F.col("key") == key) & (F.col("grp") == grp))).union(made))

    def xreadgroup(self, key: str, grp: str, consumer: str, count: int | None = None) -> DataFrame:
        """Entries that the group has not delivered yet; they are pending until they are acknowledged."""
        group = self.tables["group"].where((F.col("key") == key) & (F.col("grp") == grp))
        new = streams.xread(self._own("stream", key), group.select("key", "last_id"), count).select("key", F.lit(grp).alias("grp"), "id", "arrival", F.lit(consumer).alias("consumer"), "fields")
        new = self.scratch.put(new)
        self._put("pending", self.tables["pending"].union(new.drop("fields")))
        moved = self.tables["group"].join(streams.group_positions(new).withColumnRenamed("last_id", "_last"), ["key", "grp"], "left")
        self._put("group", moved.select("key", "grp", F.coalesce("_last", "last_id").alias("last_id")))
        return new.orderBy("arrival").select("id", "fields")

    def xack(self, key: str, grp: str, *ids: str) -> int:
        before = self.tables["pending"]
        acks = self._rows([(key, grp, i) for i in ids], "key string, grp string, id string")
        n = before.join(acks, ["key", "grp", "id"], "left_semi").count()
        self._put("pending", streams.xack(before, acks))
        return n

    def xpending(self, key: str, grp: str) -> DataFrame:
        return streams.xpending(self.tables["pending"].where((F.col("key") == key) & (F.col("grp") == grp)))

    def xclaim(self, key: str, grp: str, consumer: str, *ids: str) -> None:
        claims = self._rows([(key, grp, i, consumer) for i in ids], "key string, grp string, id string, new_consumer string")
        self._put("pending", streams.xclaim(self.tables["pending"], claims))

    def xdel(self, key: str, *ids: str) -> None:
        self._typed("stream", key)
        self._put("stream", streams.xdel(self.tables["stream"], self._rows([(key, i) for i in ids], "key string, id string")).select(*self.tables["stream"].columns))

    def xtrim(self, key: str, maxlen: int) -> None:
        self._replace("stream", streams.xtrim(self._own("stream", key), int(maxlen)), key)

    def xinfo_stream(self, key: str) -> DataFrame:
        return streams.xinfo_stream(self._own("stream", key))

    def xinfo_groups(self, key: str) -> DataFrame:
        return self.tables["group"].where(F.col("key") == key).join(streams.xinfo_groups(self.tables["pending"]).drop("last_delivered_id"), ["key", "grp"], "left").fillna(0, ["consumers", "pending"])

    # vectors
    def vec_add(self, key: str, id_: str, vector: list[float]) -> None:
        own = self._own("vector", key)
        first = own.first()
        if first and len(first.embedding) != len(vector):
            raise CommandError("vector dimension mismatch")
        old = own.where(F.col("id") == id_).first()
        new = self._rows([(key, id_, old.insert_order if old else self._next(), [float(x) for x in vector])], "vector")
        self._replace("vector", own.where(F.col("id") != id_).union(new), key)
        self.graphs.pop(key, None)

    def vec_search(self, key: str, query: list[float], k: int, metric: str = "euclidean") -> DataFrame:
        """By the graph where one was made and nothing was added since, else exactly."""
        if key in self.graphs and metric == "euclidean":
            asked = self._rows([(0, [float(x) for x in query])], "query int, q array<double>")
            return vectorgraph.search(self.graphs[key][0], asked, k, ef=self.graphs[key][2]).orderBy("rank").select("id", "dist")
        return vectors.search(self._own("vector", key), query, k, metric)

    def vec_createindex(self, key: str, m: int = vectorgraph.M, ef: int = vectorgraph.EF) -> None:
        self.graphs[key] = (self.scratch.put(vectorgraph.build(self._own("vector", key).drop("key"), m=m)), m, ef)

    def vec_rebuild(self, key: str) -> None:
        self.vec_createindex(key, *(self.graphs[key][1:] if key in self.graphs else ()))

    def vec_stats(self, key: str) -> DataFrame:
        return vectorgraph.stats(self.graphs[key][0]) if key in self.graphs else vectors.stats(self._own("vector", key))

    def _pair(self, key: str, a: str, b: str) -> DataFrame:
        own = self._own("vector", key)
        return own.where(F.col("id") == a).select(F.col("embedding").alias("a")).crossJoin(own.where(F.col("id") == b).select(F.col("embedding").alias("b")))  # one row

    def vec_addvec(self, key: str, a: str, b: str) -> DataFrame:
        return self._pair(key, a, b).select(vectors.add(F.col("a"), F.col("b")).alias("embedding"))

    def vec_subvec(self, key: str, a: str, b: str) -> DataFrame:
        return self._pair(key, a, b).select(vectors.subtract(F.col("a"), F.col("b")).alias("embedding"))

    def vec_dot(self, key: str, a: str, b: str) -> DataFrame:
        return self._pair(key, a, b).select(vectors.dot(F.col("a"), F.col("b")).alias("dot"))

    def vec_embedadd(self, key: str, id_: str, provider: str, payload: str) -> None:
        made = embedders.embed(self._rows([(payload,)], "payload string"), provider).first()
        self.vec_add(key, id_, made.embedding)

    vec_embed = vec_embedadd

    def emb_register(self, name: str, make) -> None:
        embedders.register(name, make)

    def emb_list(self) -> list[str]:
        return embedders.names()

    # documents
    def doc_indexcreate(self, name: str, prefix: str, schema: dict[str, str]) -> None:
        self.catalog.create(name, prefix, schema)

    def doc_indexdrop(self, name: str) -> bool:
        return self.catalog.drop(name)

    def doc_indexlist(self) -> list[str]:
        return self.catalog.names()

    def _documents(self, name: str) -> DataFrame:
        """The JSON values under an index's prefix, with its fields as columns."""
        if name not in self.catalog.indexes:
            raise CommandError("no such index")
        prefix, text, numbers = self.catalog.indexes[name]
        own = self._live("json").where(F.col("key").startswith(prefix))
        field = lambda f: F.try_variant_get(jsondoc.parsed(F.col("doc")), "$." + f, "string")
        return own.select(F.col("key").alias("doc"), *(field(f).alias(f) for f in text), *(field(f).try_cast("double").alias(f) for f in numbers))

    def doc_search(self, name: str, query: str, field: str | None = None, low: float | None = None, high: float | None = None, offset: int = 0, count: int = 10) -> DataFrame:
        """Indexes are views: they hold what the documents hold."""
        text, numbers = self.catalog.build(name, self._documents(name))
        return docindex.search(text, query, numbers if field else None, field, low, high, offset, count)

    def doc_aggregate(self, name: str, group: str, reduce_: str = "COUNT", field: str | None = None) -> DataFrame:
        return docindex.aggregate(self._documents(name), group, reduce_, field)

    def search(self, docs: DataFrame, fields: list[str], query: str, **options) -> DataFrame:
        return docindex.search(docindex.postings(docs, fields), query, **options)

    # messages
    def subscribe(self, client: str, *channels: str) -> int:
        for c in channels:
            self.subscribers.setdefault(c, set()).add(client)
        return sum(client in s for s in self.subscribers.values())

    def unsubscribe(self, client: str, *channels: str) -> int:
        for c in channels or tuple(self.subscribers):
            self.subscribers.get(c, set()).discard(client)
        return sum(client in s for s in self.subscribers.values())

    def publish(self, channel: str, payload: str) -> int:
        """How many clients got it; ``messages`` hands a client what it got."""
        to = self.subscribers.get(channel, ())
        for client in to:
            self.inbox.setdefault(client, []).append((channel, payload))
        return len(to)

    def messages(self, client: str) -> list[tuple[str, str]]:
        return self.inbox.pop(client, [])

    def _tell(self, command: str, key: str) -> None:
        letter = next((c for c, names in notify.CLASSES.items() if command in names), None)
        if not self.flags or letter is None or not ("A" in self.flags or letter in self.flags):
            return
        if "E" in self.flags:
            self.publish(f"__keyevent@{self.db}__:{command.lower()}", key)
        if "K" in self.flags:
            self.publish(f"__keyspace@{self.db}__:{key}", command.lower())

    # server
    def ping(self, message: str = "PONG") -> str:
        return message

    def echo(self, message: str) -> str:
        return message

    def info(self, section: str | None = None) -> DataFrame:
        """``section, name, value``: server, stats and keyspace, or one of them."""
        facts = [
            ("server", "spark_version", self.spark.version), ("server", "uptime_ms", str(self.now() - self.began)), ("server", "db", str(self.db)), ("server", "role", "master"),
            ("stats", "commands", str(self.calls)), ("stats", "slowlog_len", str(len(self.slow))), ("stats", "channels", str(sum(map(bool, self.subscribers.values())))), ("stats", "users", str(len(self.users.names()))),
        ]
        counts = self.keyspace().groupBy("type").agg(F.count("*").alias("n"), F.count("due_ms").alias("due"))
        kept = counts.select(F.lit("keyspace").alias("section"), F.col("type").alias("name"), F.concat(F.lit("keys="), "n", F.lit(",expires="), "due").alias("value"))
        every = self._rows(facts, "section string, name string, value string").union(kept)
        return every if section is None else every.where(F.col("section") == section.lower())

    def config_get(self, name: str) -> dict[str, str]:
        return {name: self.flags} if name.lower() == "notify-keyspace-events" else {}

    def config_set(self, name: str, value: str) -> None:
        if name.lower() != "notify-keyspace-events":
            raise CommandError("unsupported CONFIG SET parameter")
        self.flags = value

    def auth(self, *given: str) -> None:
        name, password = given if len(given) > 1 else ("default", given[0])
        if not self.users.authenticated(name, password):
            raise CommandError("invalid user or password")
        self.user = name

    def acl_setuser(self, name: str, *rules: str) -> None:
        self.users.set_user(name, *rules)

    def acl_deluser(self, *names: str) -> int:
        return sum(self.users.del_user(n) for n in names)

    def acl_list(self) -> list[str]:
        return self.users.listing()

    def acl_users(self) -> list[str]:
        return self.users.names()

    def acl_whoami(self) -> str:
        return self.user

    def slowlog_get(self, count: int = 10) -> list[tuple]:
        """Number, milliseconds, microseconds taken, command and arguments, newest first."""
        return self.slow[::-1][:count]

    def slowlog_len(self) -> int:
        return len(self.slow)

    # transactions, calls by name, persistence
    def multi(self) -> None:
        self.queue = []

    def discard(self) -> None:
        self.queue = None

    def execute(self) -> list:
        queued, self.queue = self.queue or [], None
        return [self.call(name, *args, **options) for name, args, options in queued]

    def call(self, name: str, *args, **options):
        """A command by name; queued between ``multi`` and ``execute``."""
        upper = name.upper()
        method = {"DEL": "delete", "EXEC": "execute", "INCR": "incrby"}.get(upper, name.lower().replace(".", "_").replace(" ", "_"))
        f = getattr(type(self), method, None)
        if method.startswith("_") or method in OWN or not callable(f):
            raise CommandError(f"unknown command {name}")
        if self.queue is not None and method not in ("execute", "discard"):
            self.queue.append((name, args, options))
            return "QUEUED"
        keys = tuple(a for a in args[: None if method in ("delete", "mget", "exists") else 1] if isinstance(a, str)) if method not in KEYLESS else ()
        refused = None if method in ("auth", "acl_whoami") else self.users.refusal(self.user, upper.split(" ")[0], keys)
        if refused:
            raise CommandError(refused)
        began, self.calls = time.perf_counter(), self.calls + 1
        out = getattr(self, method)(*args, **options)
        took = int((time.perf_counter() - began) * 1e6)
        if took >= SLOW_US:
            self.slow = [*self.slow, (self._next(), self.now(), took, upper, args)][-SLOW_KEPT:]
        for k in keys:
            self._tell(upper, k)
        return out

    def pipeline(self, commands: Iterable[tuple]) -> list:
        return [self.call(*c) for c in commands]

    def save(self, root: str) -> int:
        return snapshot.save(self.tables, root)

    @classmethod
    def load(cls, spark: SparkSession, root: str) -> Engine:
        return cls(spark, snapshot.load(spark, root))

    def replay(self, path: str) -> None:
        """What an append-only file leaves: its commands on single keys, MSET and DEL, folded key by key in one query."""
        log = aof.read(self.spark, path)
        left = self.scratch.put(folds.fold(folds.split_keys(log.select(F.struct("file", "at").alias("seq"), "db", "cmd", F.expr("slice(args, 2, greatest(size(args) - 1, 0))").alias("args")))))
        touched = left.select("key").distinct()
        for kind in VALUES:
            self._put(kind, keyspace.delete(self.tables[kind], touched))
        columns = {"string": ("key", "value"), "list": ("key", "pos", "value"), "hash": ("key", F.col("name").alias("field"), "value"), "set": ("key", F.col("name").alias("member")), "zset": ("key", F.col("name").alias("member"), "score")}
        for kind, cols in columns.items():
            self._put(kind, self.tables[kind].union(left.where(F.col("type") == kind).select(*cols)))
        self._put("expiry", keyspace.delete(self.tables["expiry"], touched).union(left.where("due_ms IS NOT NULL").select("key", "due_ms").distinct()))


#: Methods that are no commands, and commands whose first argument is no key.
OWN = ("call", "pipeline", "keyspace", "load", "messages", "expire_at", "search", "now", "tables")
KEYLESS = (
    "ping", "echo", "info", "keys", "scan", "dbsize", "randomkey", "flushdb", "flushall", "select", "multi", "discard", "execute", "publish", "subscribe", "unsubscribe", "auth", "config_get", "config_set",
    "acl_setuser", "acl_deluser", "acl_list", "acl_users", "acl_whoami", "slowlog_get", "slowlog_len", "emb_register", "emb_list", "save", "replay", "sweep", "bitop", "mset", "msetnx", "xread", "doc_indexlist",
)


def rendered(reply) -> str:
    """A reply as lines of text."""
    if isinstance(reply, DataFrame):
        reply = [tuple(r) if len(r) > 1 else r[0] for r in reply.collect()]
    if reply is None:
        return "OK"
    if isinstance(reply, (list, tuple)):
        return "\n".join(f"{i}) {x}" for i, x in enumerate(reply, 1)) or "(empty)"
    return json.dumps(reply, ensure_ascii=False) if isinstance(reply, dict) else str(reply)
