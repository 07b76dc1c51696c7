"""Literal vectors for each value type, through the facade and the operators."""

import pytest
from pyspark.sql import functions as F

from quern.engine import CommandError, Engine
from quern.operators import bits, docindex, geo, jsondoc, jsonedit, keyspace, lists, sketches, streams, strings, timeseries, vectors, zsets


def col(df, c=0):
    return [r[c] for r in df.collect()]


@pytest.fixture
def e(spark):
    return Engine(spark, clock=lambda: 0)


def test_strings(e):
    e.set("foo", "bar")
    assert col(e.get("foo")) == ["bar"] and e.exists("foo").first()[0] == 1
    e.delete("foo")
    assert col(e.get("foo")) == [] and e.exists("foo").first()[0] == 0
    e.set("s", "a")
    e.append("s", "bc")
    assert col(e.get("s")) == ["abc"] and col(e.strlen("s")) == [3]
    e.set("n", "1")
    assert e.incrby("n") == 2 and e.incrby("n", -1) == 1
    with pytest.raises(CommandError):
        e.incrby("s")
    e.set("t", "hello world")
    assert col(e.getrange("t", 0, 4)) == ["hello"]
    e.setrange("t", 6, "spark")
    assert col(e.get("t")) == ["hello spark"]
    assert col(e.mget("n", "none", "t"), 2) == ["1", None, "hello spark"]
    with pytest.raises(CommandError):
        e.psetex("k", 1, "v")


def test_collections(e):
    e.lpush("L", "b", "a")
    e.rpush("L", "c")
    assert col(e.lrange("L", 0, -1)) == ["a", "b", "c"]
    e.lset("L", 1, "B")
    assert col(e.lrange("L", 0, -1)) == ["a", "B", "c"] and e.lpop("L") == "a" and e.rpop("L") == "c" and col(e.llen("L")) == [1]
    e.hset("H", {"f1": "v1", "f2": "v2"})
    e.hset("H", {"f3": "v3"})
    e.hdel("H", "f2")
    assert sorted(tuple(r) for r in e.hgetall("H").collect()) == [("f1", "v1"), ("f3", "v3")] and col(e.hget("H", "f3")) == ["v3"]
    e.sadd("A", "a", "b", "c")
    e.sadd("B", "b", "c", "d")
    assert sorted(col(e.sinter("A", "B"))) == ["b", "c"] and sorted(col(e.sunion("A", "B"))) == ["a", "b", "c", "d"] and col(e.sdiff("A", "B")) == ["a"]
    e.zadd("Z", {"a": 1, "b": 2, "c": 3})
    assert col(e.zrange("Z", 0, -1)) == ["a", "b", "c"] and col(e.zrangebyscore("Z", 1, 2)) == ["a", "b"] and col(e.zrank("Z", "b")) == [1]
    e.zrem("Z", "b")
    assert col(e.zrange("Z", 0, -1)) == ["a", "c"]
    with pytest.raises(CommandError, match="WRONGTYPE"):
        e.sadd("Z", "x")


def test_sketches_and_series(e):
    assert e.pfadd("h", "foo", "bar", "zap") == 1 and e.pfadd("h", "foo") == 0
    e.pfadd("i", "a", "b", "c", "foo")
    assert col(e.pfcount("h")) == [3] and col(e.pfcount("h", "i")) == [6]
    e.pfmerge("h", "i")
    assert col(e.pfcount("h")) == [4]  # what the destination held doesn't count
    e.cf_add("c", "x", "y")
    assert [r.present for r in e.cf_exists("c", "x", "y", "nothing").orderBy("item").collect()] == [0, 1, 1]
    e.ts_add("t", 1, 10)
    e.ts_add("t", 2, 20)
    assert tuple(e.ts_get("t").first()) == (2, 20.0) and len(col(e.ts_range("t", 0, 10))) == 2
    with pytest.raises(CommandError):
        e.ts_add("t", 1, 5)
    e.ts_add("t", 25, 1)
    assert [tuple(r) for r in e.ts_range("t", 3, 30, "sum", 10).collect()] == [(23, 1.0)]


def test_places_and_vectors(e):
    e.geoadd("Sicily", (13.361389, 38.115556, "Palermo"), (15.087269, 37.502669, "Catania"))
    assert col(e.geodist("Sicily", "Palermo", "Catania"))[0] == pytest.approx(166274.1516, abs=1e-3)
    assert col(e.geosearch("Sicily", 15, 37, 200, "km")) == ["Catania", "Palermo"]
    assert dict(tuple(r) for r in e.geohash("Sicily", "Palermo", "Catania").collect()) == {"Palermo": "sqc8b49rny0", "Catania": "sqdtr74hyu0"}
    with pytest.raises(CommandError):
        e.geoadd("Sicily", (200, 0, "nowhere"))
    e.vec_add("v", "id1", [1, 0, 0])
    e.vec_embed("v", "id2", "json", "[0, 1, 0]")
    assert col(e.vec_search("v", [1, 0, 0], 1)) == ["id1"] and len(col(e.vec_search("v", [1, 0, 0], 5, "cosine"))) == 2
    with pytest.raises(CommandError):
        e.vec_add("v", "id3", [1])


def test_streams_keys_and_transactions(e, tmp_path, spark):
    e.xadd("s", "1-0", {"a": "1"})
    e.xadd("s", "2-0", {"a": "2"})
    assert col(e.xlen("s")) == [2] and col(e.xrange("s")) == ["1-0", "2-0"] and col(e.xrange("s", "2-0")) == ["2-0"]
    e.set("k", "v")
    e.expire_at("k", 1000)
    assert e.sweep(999) == 0 and e.sweep(1000) == 1 and col(e.get("k")) == []
    e.multi()
    assert e.call("SET", "k", "1") == "QUEUED" and e.call("INCR", "k") == "QUEUED"
    assert len(e.call("EXEC")) == 2 and col(e.get("k")) == ["2"]
    e.multi()
    e.call("SET", "k", "3")
    e.discard()
    assert col(e.get("k")) == ["2"] and sorted(col(e.keys("*"))) == ["k", "s"] and col(e.dbsize()) == [2]
    root = f"file://{tmp_path}/snap"
    e.save(root)
    again = Engine.load(spark, root)
    assert col(again.get("k")) == ["2"] and col(again.xlen("s")) == [2]
    done, got = e.pipeline([("SET", "p", "1"), ("GET", "p")])
    assert done is True and col(got) == ["1"]
    assert e.ping() == "PONG" and e.call("ECHO", "x") == "x" and {r.name: r.value for r in e.info("keyspace").collect()} == {"string": "keys=2,expires=0", "stream": "keys=1,expires=0"}
    e.flushall()
    assert col(e.dbsize()) == [0]
    with pytest.raises(CommandError):
        e.call("NOSUCH")


def test_edges(spark):
    z = spark.createDataFrame([("z", m, s) for m, s in (("a", 1.0), ("b", 1.0), ("c", 2.0))], "key string, member string, score double")
    assert [r.member for r in zsets.zrank(z, True).orderBy("rank").collect()] == ["c", "b", "a"]
    assert zsets.zrange(z, 2, 1).count() == 0 and [r.member for r in zsets.zrange(z, -2, -1).orderBy("rank").collect()] == ["b", "c"]
    assert [r.member for r in zsets.zpop(z, 0)[0].collect()] == ["a"]
    li = spark.createDataFrame([("l", i, v) for i, v in enumerate("abaca")], "key string, pos long, value string")
    assert [r.value for r in lists.lrem(li, -2, F.lit("a")).orderBy("pos").collect()] == ["a", "b", "c"]
    one = spark.range(1)
    got = one.select(*(bits.field_incr(F.lit(250), F.lit(10), 8, False, m) for m in ("SAT", "WRAP", "FAIL"))).first()
    assert tuple(got) == (255, 4, None)
    full = spark.createDataFrame([("k", i) for i in range(8)], "key string, bit long")
    assert bits.bitpos(full, 0).first().pos == 8
    s = spark.createDataFrame([("s", 1, "10-0"), ("s", 2, "9-0")], "key string, arrival long, id string")
    assert [r.id for r in streams.xrange(s, "9-0").collect()] == ["9-0"]
    t = spark.createDataFrame([("t", 1, 5, 1.0), ("t", 2, 3, 2.0), ("t", 3, 5, 3.0)], "key string, seq long, ts long, value double")
    assert [tuple(r) for r in timeseries.add(t).collect()] == [("t", 5, 3.0)]
    v = spark.createDataFrame([("a", 1, [1.0]), ("b", 2, [1.0])], "id string, insert_order long, embedding array<double>")
    assert [r.id for r in vectors.search(v, [1.0], 2).collect()] == ["b", "a"]
    assert one.select(sketches.fnv1a(F.lit("foo"))).first()[0] == 2851307223
    assert one.select(strings.setrange(F.lit("ab"), 4, F.lit("x"))).first()[0] == "ab\0\0x"
    assert keyspace.glob_regex("a.*?") == r"(?s)^a\..*.$"


def test_json_paths(spark):
    d = spark.createDataFrame([("k", '{"name":"alice","tags":["a"],"a":[{"b":1},{}]}')], "key string, doc string")
    c = F.col("doc")
    assert tuple(d.select(jsondoc.get(c, "$.name"), jsondoc.get(c, "$.a[*].b"), jsondoc.type_of(c, "$.tags"), jsondoc.get(c, "$.none")).first()) == ('"alice"', "[1,null]", "array", None)
    assert jsondoc.update_path(d, "$.x[2].y", F.lit('"z"')).select(jsondoc.get(c, "$.x")).first()[0] == '[null,null,{"y":"z"}]'
    assert jsondoc.update_path(d, "$.tags[0]", None).select(jsondoc.get(c, "$.tags")).first()[0] == "[]"
    assert d.select(jsondoc.descend(c, "$..b")).first()[0] == "[1]"
    assert jsondoc.steps("$.a['b c'][3][*].*") == ["a", "b c", 3, "*", "*"]
    assert d.select(jsondoc.get(jsondoc.without_member(c, "a"), "$.a"), jsonedit.clear(c)["doc"]).first() == (None, "{}")


def test_geo_boxes_lose_nothing(spark):
    import random

    rng = random.Random(5)
    places = spark.createDataFrame([("g", str(i), rng.uniform(-180, 180), rng.uniform(-90, 90)) for i in range(400)], "key string, member string, lon double, lat double").cache()
    d = geo.distance_m(F.lit(170.0), F.lit(70.0), F.col("lon"), F.col("lat"))
    for km in (500.0, 3000.0, 15000.0):
        brute = {r.member for r in places.where(d <= km * 1000).collect()}
        assert {r.member for r in geo.search_radius(places, 170.0, 70.0, km, "km").collect()} == brute
    edge = [("g", f"e{i}", lon, lat) for i, (lon, lat) in enumerate([(180.0, 0.0), (-180.0, 0.0), (179.99, 89.99), (0.0, 90.0), (0.0, -90.0), (-179.9, -60.0), (179.9, -60.0), (12.0, 89.0), (-168.0, 89.0)])]
    places = places.union(spark.createDataFrame(edge, places.schema)).cache()
    a, b = places.alias("a"), places.alias("b")
    metres = geo.distance_m(F.col("a.lon"), F.col("a.lat"), F.col("b.lon"), F.col("b.lat"))
    for km in (1.0, 800.0, 2500.0, 9000.0, 20100.0):
        pairs = [(r.centre, r.member) for r in geo.members_around(places, km, "km").collect()]
        brute = a.join(b, metres <= km * 1000).select("a.member", "b.member")
        assert sorted(pairs) == sorted(tuple(r) for r in brute.collect())


def test_json_changes_of_odd_documents(spark):
    docs = [None, "no json", '"text"', "[1, 2.50, 3e2]", '{"b": 1, "a": {"x": [1, {"y": "é"}]}}', "12", "true", "null", "{}"]
    df = spark.createDataFrame(list(enumerate(docs)), "key int, doc string")
    d = F.col("doc")
    of = lambda c: [tuple(r.x) for r in df.select(c.alias("x"), "key").orderBy("key").collect()]
    missing = (None, None, "path does not exist")
    assert of(jsonedit.arrappend(d, "$", F.lit("{}"))) == [missing, ("no json", None, "path is not an array"), ('"text"', None, "path is not an array"), ("[1,2.5,300,{}]", "4", None)] + [(x, None, "path is not an array") for x in docs[4:]]
    assert of(jsonedit.strappend(d, "$", F.lit('"!"')))[:3] == [missing, ('"no json!"', "8", None), ('"text!"', "5", None)]
    assert of(jsonedit.numincrby(d, "$", 0.5))[5] == ("12.5", "12.5", None) and of(jsonedit.toggle(d, "$"))[6] == ("false", "0", None)
    assert of(jsonedit.arrpop(d, "$.a.x", 0))[4] == ('{"b":1,"a":{"x":[{"y":"é"}]}}', "1", None) and of(jsonedit.arrpop(d))[0] == (None, None, None)
    assert of(jsonedit.clear(d))[3:6] == [("[]", "1", None), ("{}", "1", None), ("12", "0", None)]
    assert of(jsonedit.delete(d, "$.a.x[1].y"))[4] == ('{"b":1,"a":{"x":[1,{}]}}', "1", None) and of(jsonedit.delete(d, "$"))[0] == (None, "0", None)
    plain = [r[0] for r in df.select(jsonedit.set_value(d, "$.n[1]", F.lit("1.0")).alias("x"), "key").orderBy("key").collect()]
    assert plain[0] == plain[1] == '{"n":[null,1]}' and plain[4].startswith('{"b":1,"a"')
    assert [r[0] for r in df.select(jsonedit.value_at(d, "$..y").alias("x"), "key").orderBy("key").collect()][4].endswith('"é"]')
    assert jsondoc.update_path(df.withColumn("other", F.lit(1)), "$.q", F.lit("2")).columns == ["key", "doc", "other"]
    assert df.select(jsondoc.descend(d, "$..x").alias("x")).where("x IS NOT NULL").count() == 8
    with pytest.raises(ValueError):
        jsonedit.toggle(d, "$.a[*]")


def test_document_index(spark):
    docs = spark.createDataFrame([("doc:1", "hello", ["x", "Red Fox"], 10), ("doc:2", "hello world", None, 15), ("other:1", "hello", None, 1)], "doc string, title string, tags array<string>, views int")
    c = docindex.Catalog()
    with pytest.raises(ValueError):
        c.create("i", "doc:", {"title": "TAG"})
    c.create("i", "doc:", {"title": "TEXT", "tags": "TEXT", "views": "NUMERIC"})
    text, numbers = c.build("i", docs)
    found = lambda *a, **k: sorted(col(docindex.search(text, *a, **k)))
    assert found("ell") == ["doc:1", "doc:2"] and found("hello fox") == ["doc:1"] and found("hello", numbers, "views", 12, 20) == ["doc:2"]
    assert c.names() == ["i"] and c.drop("i") and not c.drop("i")
    assert [tuple(r) for r in docindex.aggregate(docs.withColumn("none", F.lit(None)), "none").collect()] == [("undefined", 3)]
