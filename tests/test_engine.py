"""Commands of the engine, by method, by name and in the shell."""

import pytest

from quern import cli
from quern.engine import CommandError, Engine
from quern.sources import aof


class Clock:
    def __init__(self):
        self.ms = 1_000_000

    def __call__(self):
        return self.ms


@pytest.fixture
def clock():
    return Clock()


@pytest.fixture
def e(spark, clock):
    return Engine(spark, clock=clock)


def col(df):
    return [r[0] for r in df.collect()]


def test_expiry_holds_for_reads_and_writes(e, clock):
    e.set("k", "v", ex=2)
    e.rpush("l", "a")
    assert e.ttl("k") == 2 and e.pttl("l") == -1 and e.ttl("none") == -2 and e.expire("none", 5) == 0 and e.expire("l", 1) == 1
    clock.ms += 1500
    assert col(e.get("k")) == ["v"] and col(e.lrange("l", 0, -1)) == [] and col(e.keys("*")) == ["k"]
    assert e.set("k", "w", keepttl=True) and e.ttl("k") == 1
    clock.ms += 500
    assert col(e.get("k")) == [] and e.setnx("k", "x") == 1 and e.ttl("k") == -1
    e.sadd("l", "now a set")
    assert e.getex("k", px=10) == "x" and e.getex("k", persist=True) == "x" and e.ttl("k") == -1
    e.set("p", "1", px=10)
    clock.ms += 10
    assert e.sweep() == 1 and sorted(col(e.keys("*"))) == ["k", "l"]
    assert e.expireat("k", 1) == 1 and col(e.exists("k")) == [0]


def test_types_are_minded_and_set_replaces_any(e):
    e.rpush("k", "a")
    for refused in (lambda: e.get("k"), lambda: e.hget("k", "f"), lambda: e.smembers("k"), lambda: e.zrange("k", 0, 1), lambda: e.xrange("k"), lambda: e.geoadd("k", (1.0, 1.0, "m")), lambda: e.pfadd("k", "x"),
                    lambda: e.xadd("k", "1-0", {"a": "b"}), lambda: e.vec_add("k", "i", [1.0]), lambda: e.ts_add("k", 1, 1.0), lambda: e.json_get("k"), lambda: e.incrby("k")):
        with pytest.raises(CommandError):
            refused()
    assert e.set("k", "v", get=True) is None and col(e.get("k")) == ["v"] and e.dbsize().first()[0] == 1
    assert e.set("k", "w", get=True) == "v" and e.set("k", "x", nx=True) is False and e.set("new", "x", xx=True) is False
    e.set("n", str(2**63 - 1))
    with pytest.raises(CommandError):
        e.incr("n")
    with pytest.raises(CommandError):
        e.set("k", "v", ex=0)


def test_strings_and_bits(e):
    e.mset({"a": "1", "b": "2"})
    assert e.msetnx({"b": "3", "c": "4"}) == 0 and e.msetnx({"c": "4"}) == 1 and e.getset("a", "9") == "1" and e.getdel("a") == "9"
    assert e.decrby("c", 5) == -1 and e.incrbyfloat("c", 1.5) == "0.5" and col(e.substr("b", 0, 0)) == ["2"]
    assert e.rename("b", "d") == 1 and e.renamenx("d", "c") == 0 and col(e.get("d")) == ["2"]
    with pytest.raises(CommandError):
        e.rename("none", "x")
    assert e.setbit("m", 1, 1) == 0 and e.setbit("m", 1, 1) == 1 and col(e.getbit("m", 1)) == [1] and col(e.bitcount("m")) == [1] and col(e.bitpos("m", 1)) == [1]
    assert e.bitfield("f", ("SET", "i8", 0, 5), ("GET", "i8", "#0"), ("INCRBY", "i8", 0, 3), ("OVERFLOW", "SAT"), ("INCRBY", "u8", "#1", 300)) == [0, 5, 8, 255] and e.bitfield_ro("f", ("u16", 0)) == [8 * 256 + 255]
    e.bitop("OR", "o", "m", "f")
    assert sorted(r.bit for r in e.tables["bit"].where("key = 'o'").collect()) == [1, 4, *range(8, 16)]
    e.bitop("NOT", "x", "m")
    assert col(e.bitcount("x")) == [7]


def test_collections(e):
    e.rpush("l", "a", "b", "c", "b")
    e.lrem("l", 1, "b")
    assert col(e.lrange("l", 0, -1)) == ["a", "c", "b"] and e.rpoplpush("l", "m") == "b" and e.lmove("l", "l", "LEFT", "RIGHT") == "a" and col(e.lrange("l", 0, -1)) == ["c", "a"]
    e.ltrim("l", 1, 1)
    assert col(e.lindex("l", 0)) == ["a"] and e.blpop("none", "m") == ("m", "b")
    with pytest.raises(CommandError):
        e.lset("l", 5, "x")
    assert e.hset("h", {"a": "1", "bb": "22"}) == 2 and col(e.hmget("h", "bb", "none")) == ["22", None] and col(e.hexists("h", "a")) == [1] and col(e.hlen("h")) == [2]
    assert sorted(col(e.hkeys("h"))) == ["a", "bb"] and col(e.hstrlen("h", "bb")) == [2] and col(e.hscan("h", match="b*")) == ["bb"]
    assert e.sadd("s", "a", "b", "c") == 3 and e.sadd("s", "a") == 0 and e.smove("s", "t", "a") == 1 and col(e.smismember("s", "a", "b")) == [0, 1] and col(e.scard("s")) == [2]
    assert e.sunionstore("u", "s", "t") == 3 and e.sinterstore("i", "s", "t") == 0 and len(col(e.spop("u", 2))) == 2 and col(e.scard("u")) == [1] and len(col(e.srandmember("s", -4))) == 4
    assert e.zadd("z", {"a": 1, "b": 2, "c": 3}) == 3 and e.zincrby("z", 5, "a") == 6.0 and e.zpopmax("z") == ["a"] and e.zpopmin("z") == ["b"] and col(e.zcard("z")) == [1] and col(e.zrevrank("z", "c")) == [0]


def test_json_and_documents(e):
    e.json_set("doc:1", "$", '{"title":"hello","tags":["a"],"n":1,"on":true}')
    assert e.json_arrappend("doc:1", "$.tags", '"b"') == 2 and col(e.json_get("doc:1", "$.tags")) == ['["a","b"]'] and e.json_numincrby("doc:1", "$.n", 2) == "3" and e.json_toggle("doc:1", "$.on") == 0
    assert e.json_strappend("doc:1", "$.title", "!") == 6 and e.json_arrpop("doc:1", "$.tags") == '"b"' and e.json_del("doc:1", "$.on") == 1 and col(e.json_objkeys("doc:1")) == [["title", "tags", "n"]]
    with pytest.raises(CommandError):
        e.json_toggle("doc:1", "$.n")
    e.json_set("doc:2", "$.a[1]", "1")
    assert col(e.json_get("doc:2")) == ['{"a":[null,1]}'] and col(e.json_mget("doc:2", "none", path="$.a")) == ["[null,1]", None]
    e.doc_indexcreate("i", "doc:", {"title": "TEXT", "n": "NUMERIC"})
    assert col(e.doc_search("i", "ell")) == ["doc:1"] and col(e.doc_search("i", "hello", "n", 4, 9)) == [] and e.doc_indexlist() == ["i"]
    assert sorted(map(tuple, e.doc_aggregate("i", "title").collect())) == [("hello!", 1), ("undefined", 1)] and e.json_del("doc:2") == 1 and col(e.keys("*")) == ["doc:1"]


def test_streams_series_and_vectors(e):
    for i in range(3):
        e.xadd("x", f"{i}-0", {"n": str(i)})
    e.xgroup_create("x", "g", "0-0")
    assert col(e.xreadgroup("x", "g", "c1", 1)) == ["1-0"] and col(e.xreadgroup("x", "g", "c2")) == ["2-0"] and col(e.xreadgroup("x", "g", "c2")) == []
    e.xclaim("x", "g", "c3", "1-0")
    assert e.xpending("x", "g").first().consumers == "c2,c3" and e.xack("x", "g", "1-0", "9-0") == 1 and e.xinfo_groups("x").first().pending == 1
    e.xtrim("x", 2)
    assert col(e.xlen("x")) == [2]
    e.ts_create("t", 10)
    for ts in (1, 5, 20):
        e.ts_add("t", ts, ts)
    e.ts_createrule("t", "day", "max", 10)
    assert [tuple(r) for r in e.ts_range("t", 0, 99).collect()] == [(20, 20.0)] and [tuple(r) for r in e.ts_range("day", 0, 99).collect()] == [(20, 20.0)]
    for i, v in (("a", [1, 0]), ("b", [0, 1]), ("c", [1, 1])):
        e.vec_add("v", i, v)
    e.vec_createindex("v", 2, 8)
    assert col(e.vec_search("v", [1.0, 0.1], 1)) == ["a"] and e.vec_stats("v").first().n_links > 0 and col(e.vec_dot("v", "a", "c")) == [1.0] and col(e.vec_addvec("v", "a", "b")) == [[1.0, 1.0]]


def test_server_commands(e, clock):
    e.call("CONFIG SET", "notify-keyspace-events", "KEA")
    e.subscribe("me", "__keyevent@0__:set", "__keyspace@0__:k")
    e.call("SET", "k", "v")
    assert e.messages("me") == [("__keyevent@0__:set", "k"), ("__keyspace@0__:k", "set")] and e.unsubscribe("me") == 0 and e.publish("x", "y") == 0
    assert e.config_get("notify-keyspace-events") == {"notify-keyspace-events": "KEA"} and e.slowlog_len() >= 1 and e.slowlog_get(1)[0][3] == "SET"
    e.acl_setuser("bob", "on", ">pw", "+get", "+set", "~a*")
    assert e.acl_users() == ["default", "bob"] and e.acl_list()[1] == "user bob on >1 rescommands+2 reskeys+1" and e.acl_whoami() == "default"
    with pytest.raises(CommandError):
        e.call("AUTH", "bob", "wrong")
    e.call("AUTH", "bob", "pw")
    e.call("SET", "a1", "x")
    for refused in (("SET", "k", "x"), ("HGET", "a1", "f")):
        with pytest.raises(CommandError):
            e.call(*refused)
    assert {r.name: r.value for r in e.info("stats").collect()}["commands"] == "5"
    assert e.info("keyspace").first().value.startswith("keys=") and e.users.table(e.spark).count() == 2 and e.acl_deluser("bob", "default") == 1
    e.select(1)
    assert e.dbsize().first()[0] == 0


def test_replay(spark, e, tmp_path):
    rows = [["SET", "k", "1"], ["INCR", "k"], ["RPUSH", "l", "a", "b"], ["LPOP", "l"], ["HSET", "h", "f", "v"], ["ZADD", "z", "2", "m"], ["SADD", "s", "x"], ["SET", "gone", "1"], ["DEL", "gone", "none"], ["PEXPIREAT", "h", "99999999999999"], ["MSET", "a", "1", "b", "2"]]
    aof.write(spark.createDataFrame(list(enumerate(rows)), "seq long, args array<string>"), f"file://{tmp_path}/log", 2)
    e.set("l", "of another type before")
    e.replay(f"file://{tmp_path}/log")
    assert sorted(col(e.keys("*"))) == ["a", "b", "h", "k", "l", "s", "z"] and col(e.get("k")) == ["2"] and col(e.lrange("l", 0, -1)) == ["b"] and e.ttl("h") > 0 and col(e.zscore("z", "m")) == [2.0]


def test_shell(e, tmp_path):
    lines = ['SET "a key" \'v\\n1\' EX 10', 'GET "a key"', "", "zadd z 1 a 2 b", "ZRANGE z 0 -1", "HSET h f 1", "HGETALL h", "INCRBY n x", "NOSUCH", "JSON.SET d $ '{\"a\":1}'", "JSON.GET d $.a", "GET none", "SCAN 0 MATCH a* COUNT 5", "QUIT", "GET n"]
    want = ["True", "1) v\n1", "2", "1) ('a', 1.0)\n2) ('b', 2.0)", "1", "1) ('f', '1')", "ERR value is not a number", "ERR unknown command NOSUCH", "OK", "1) 1", "(empty)", "1) a key"]
    assert list(cli.answers(e, lines)) == want
    assert list(cli.answers(e, ["SAVE"], f"file://{tmp_path}/s")) == ["1"]


def test_every_command_is_a_method():
    names = """SET GET EXISTS APPEND STRLEN INCR DECR INCRBY DECRBY GETRANGE SETRANGE MGET MSET SETNX MSETNX SETEX PSETEX GETSET GETDEL GETEX INCRBYFLOAT SUBSTR SETBIT GETBIT BITCOUNT BITPOS BITOP BITFIELD BITFIELD_RO
    LPUSH RPUSH LPOP RPOP LRANGE LINDEX LSET LLEN LTRIM LREM RPOPLPUSH LMOVE BLPOP BRPOP EXPIRE TTL PERSIST PTTL PEXPIRE EXPIREAT PEXPIREAT TYPE DBSIZE RANDOMKEY RENAME RENAMENX HSET HMSET HGET HDEL HEXISTS HLEN HKEYS HVALS
    HGETALL HMGET HSTRLEN HSCAN SADD SREM SISMEMBER SMISMEMBER SMEMBERS SCARD SINTER SUNION SDIFF SMOVE SPOP SRANDMEMBER SUNIONSTORE SINTERSTORE SDIFFSTORE SSCAN ZADD ZREM ZINCRBY ZRANK ZREVRANK ZSCORE ZCARD ZRANGE ZREVRANGE
    ZRANGEBYSCORE ZPOPMIN ZPOPMAX ZSCAN GEOADD GEODIST GEOSEARCH GEOHASH GEOPOS GEOSEARCHSTORE GEORADIUS GEORADIUSBYMEMBER TS.CREATE TS.ADD TS.CREATERULE TS.DELETERULE TS.RANGE TS.GET FLUSHDB FLUSHALL KEYS SCAN SELECT
    JSON.SET JSON.GET JSON.DEL JSON.ARRAPPEND JSON.NUMMULTBY JSON.TOGGLE JSON.CLEAR JSON.MGET JSON.TYPE JSON.OBJKEYS JSON.OBJLEN JSON.ARRLEN JSON.ARRPOP JSON.ARRINSERT JSON.ARRTRIM JSON.ARRINDEX JSON.STRAPPEND JSON.STRLEN
    JSON.NUMINCRBY JSON.FORGET VEC.ADD VEC.SEARCH VEC.CREATEINDEX VEC.REBUILD VEC.STATS VEC.ADDVEC VEC.SUBVEC VEC.DOT EMB.REGISTER EMB.LIST VEC.EMBEDADD XADD XRANGE XLEN XREAD XREADGROUP XACK XDEL XTRIM XPENDING XCLAIM PFADD
    PFCOUNT PFMERGE DOC.INDEXCREATE DOC.INDEXDROP DOC.INDEXLIST DOC.SEARCH DOC.AGGREGATE CF.RESERVE CF.ADD CF.ADDNX CF.EXISTS CF.DEL CF.MADD CF.MEXISTS CF.INSERT CF.INSERTNX PING ECHO INFO AUTH MULTI DISCARD PUBLISH SUBSCRIBE UNSUBSCRIBE""".split()
    missing = [n for n in names if not callable(getattr(Engine, n.lower().replace(".", "_"), None))]
    assert missing == []
