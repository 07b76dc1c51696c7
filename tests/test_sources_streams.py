"""Logs, snapshots and streaming forms."""

import random
import time

import pytest
from pyspark.sql import functions as F

from quern.operators import commandlog, folds, sets, sketches, streams, timeseries, vectorgraph, vectors
from quern.plans import bind
from quern.shared import Scratch
from quern.sources import aof, snapshot
from quern.streaming import groups, live, rules


def test_protocol():
    data = b"*2\r\n$3\r\nGET\r\n$5\r\na\r\nbc\r\n*1\r\n$4\r\nPING\r\n*2\r\n$3\r\nSET\r\n$2\r\nx"
    assert [c for _, c in aof.parse_commands(data)] == [["GET", "a\r\nbc"], ["PING"]]
    with pytest.raises(aof.ProtocolError):
        list(aof.parse_commands(b"+OK\r\n"))


def test_commands_in_pieces():
    commands = [["SET", "k", "v\r\n*2\r\n"], ["PING"], [], ["SET", "é", ""]]
    data = b"".join(b"*%d\r\n" % len(c) + b"".join(b"$%d\r\n%s\r\n" % (len(a.encode()), a.encode()) for a in c) for c in commands)
    for size in (1, 2, 3, 7, 1000):
        framer, got = aof.Framer(), []
        for at in range(0, len(data), size):
            got += framer.feed(data[at : at + size])
        assert [c for _, c in got] == commands and not framer.data
        assert [a for a, _ in got] == [a for a, _ in aof.parse_commands(data, size)] == [a for a, _ in aof.parse_commands(data)]
    for bad in (b"*x\r\n", b"*1\r\n+1\r\n", b"$1\r\n"):
        with pytest.raises(aof.ProtocolError):
            list(aof.parse_commands(bad))


def test_log_round_trip(spark, tmp_path):
    rows = [(i, ["SET", f"k{i % 7}", f"v é\r\n{i}" if i % 3 else ""]) for i in range(100)]
    log = spark.createDataFrame(rows, "seq long, args array<string>")
    path = f"file://{tmp_path}/log"
    aof.write(log, path, 3)
    got = [r.args for r in aof.read(spark, path).orderBy("file", "at").collect()]
    assert got == [a for _, a in rows]
    q = aof.tail(spark, path).writeStream.format("memory").queryName("tailed").option("checkpointLocation", f"file://{tmp_path}/c").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("tailed").count() == 100


def test_snapshot(spark, tmp_path):
    root = f"file://{tmp_path}/s"
    assert snapshot.load(spark, root) == {}
    assert snapshot.save({"a": spark.range(3), "b": spark.range(2)}, root) == 1
    bg = snapshot.BackgroundSave()
    bg.start({"a": spark.range(5)}, root)
    assert bg.wait() == 2
    assert snapshot.load(spark, root)["a"].count() == 5 and snapshot.load(spark, root, 1)["b"].count() == 2


def _stream(spark, df, tmp_path, name, files=3):
    path = f"file://{tmp_path}/{name}"
    df.repartition(files).write.parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def _drain(df, name, tmp_path, mode):
    df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", f"file://{tmp_path}/{name}-c").trigger(availableNow=True).start().awaitTermination()
    return df.sparkSession.table(name)


def test_rule_stream_equals_batch(spark, sf, tmp_path):
    s = bind.series(spark, sf)
    src = _stream(spark, s.select("key", F.timestamp_millis("ts").alias("time"), "value"), tmp_path, "rule")
    got = _drain(rules.rule(src, "sum", "1 day", "60 days"), "ruled", tmp_path, "complete")
    want = {(r.key, r.bucket): r.value for r in timeseries.rule(s, "sum", 86_400_000).collect()}
    have = {(r.key, r.b): r.value for r in got.select("key", F.unix_millis("bucket").alias("b"), "value").collect()}
    assert have.keys() == want.keys() and all(have[k] == pytest.approx(want[k]) for k in want)


def test_rules_start_and_stop(spark, sf, tmp_path):
    s = bind.series(spark, sf).select("key", F.timestamp_millis("ts").alias("time"), "value")
    made = rules.RuleSet(_stream(spark, s, tmp_path, "ruleset", 1), f"file://{tmp_path}/rules")
    made.create("click", "click:max", "max", "1 day", once=True)
    made.running["click", "click:max"].awaitTermination()
    assert made.delete("click:max") == 1 and made.delete("click:max") == 0
    assert spark.read.parquet(f"file://{tmp_path}/rules/click:max").count() > 10  # days behind the watermark


def test_samples_in_order_across_batches(spark, tmp_path):
    rng = random.Random(1)
    rows = [("a" if rng.random() < 0.5 else "b", rng.randrange(50) + i // 4, float(i), i) for i in range(120)]
    path = tmp_path / "samples"
    for n in range(3):
        spark.createDataFrame(rows[n * 40 : n * 40 + 40], "key string, ts long, value double, seq long").coalesce(1).write.mode("append").parquet(f"file://{path}")
        time.sleep(1.1)  # files are read in order of their times
    src = spark.readStream.schema("key string, ts long, value double, seq long").option("maxFilesPerTrigger", 1).parquet(f"file://{path}")
    got = {r.seq for r in _drain(rules.accept(src), "accepted", tmp_path, "append").collect()}
    want = {r.seq for r in timeseries.accept(spark.createDataFrame(rows, "key string, ts long, value double, seq long")).collect()}
    assert got == want


def test_groups_across_batches(spark, tmp_path):
    path = f"file://{tmp_path}/entries"
    schema = "key string, grp string, op string, id string, arrival long"
    spark.createDataFrame([("s", "g", "add", f"{i:02d}-0", i) for i in range(10)], schema).coalesce(1).write.mode("append").parquet(path)
    entries = spark.readStream.schema(schema).parquet(path)

    def run():
        entries_ = groups.deliver(entries, 3)
        entries_.writeStream.format("parquet").option("path", f"file://{tmp_path}/out").option("checkpointLocation", f"file://{tmp_path}/gc").trigger(availableNow=True).start().awaitTermination()
        return spark.read.parquet(f"file://{tmp_path}/out")

    first = run().where("what = 'delivered'")
    assert [r.consumer for r in first.orderBy("arrival").collect()] == [f"c{i % 3}" for i in range(10)]
    spark.createDataFrame([("s", "g", "ack", "04-0", 10), ("s", "g", "ack", "99-0", 11), ("s", "g", "add", "05-0", 12), ("s", "g", "add", "10-0", 13)], schema).coalesce(1).write.mode("append").parquet(path)
    out = run()
    assert [(r.id, r.consumer) for r in out.where("what = 'acked'").collect()] == [("04-0", "c1")]
    assert out.where("what = 'delivered' AND arrival > 9").select("id").collect() == [("10-0",)]


def test_live_forms(spark, sf, tmp_path):
    items = bind.items(spark, sf)
    folder, checkpoint = f"file://{tmp_path}/registers", f"file://{tmp_path}/lr"
    path = f"file://{tmp_path}/items"
    first, second = items.where("item % 2 = 0"), items.where("item % 2 = 1")
    first.repartition(3).write.parquet(path)
    source = spark.readStream.schema(items.schema).option("maxFilesPerTrigger", 1).parquet(path)
    live.consume(source, live.LiveRegisters(spark, folder), checkpoint).awaitTermination()
    second.write.mode("append").parquet(path)
    regs = live.LiveRegisters(spark, folder)  # as after a restart
    live.consume(source, regs, checkpoint).awaitTermination()
    assert sorted(map(tuple, regs.count().collect())) == sorted(map(tuple, sketches.pfcount(sketches.pfadd(items)).collect()))
    regs(first, regs._whole()[-1])  # a batch that comes again, with fewer rows
    assert live.LiveRegisters(spark, f"{folder}-none").count().count() == 0
    subs = spark.createDataFrame([("news", 1), ("news", 2), ("other", 3)], "channel string, client int")
    msgs = _stream(spark, spark.createDataFrame([("news", "hello"), ("quiet", "x")], "channel string, payload string"), tmp_path, "msgs", 1)
    assert _drain(live.publish(msgs, subs), "published", tmp_path, "append").count() == 2


def test_values_expire_in_a_stream(spark, tmp_path):
    """The stream's timers bring batches without end, so it is stopped once the rows waited for are there."""
    path, schema = f"file://{tmp_path}/writes", "key string, value string, seq int"
    write = lambda rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
    write([("a", "1", 1), ("b", "2", 2), ("a", "3", 3)])
    out = live.getset_expiring(spark.readStream.schema(schema).parquet(path), 1500)
    q = out.writeStream.format("memory").queryName("expiring").outputMode("update").option("checkpointLocation", f"file://{tmp_path}/x").trigger(processingTime="1 second").start()

    def rows(n):
        until = time.time() + 60
        while time.time() < until and q.isActive and spark.table("expiring").count() < n:
            time.sleep(0.3)
        return [(r.key, r.old_value, r.value) for r in spark.table("expiring").collect()]

    try:
        assert set(rows(2)) == {("a", None, "3"), ("b", None, "2")}
        time.sleep(2)
        write([("a", "4", 4)])
        assert rows(3)[2] == ("a", None, "4")  # the value before has expired
    finally:
        q.stop()


def test_folded_logs(spark):
    rows = [("s", "SET", ["1"]), ("s", "INCRBY", ["4"]), ("s", "APPEND", ["0"]), ("s", "INCR", []), ("s", "LPUSH", ["x"]), ("s", "SET", ["n", "NX"]), ("s", "PEXPIREAT", ["99"]), ("s", "SET", ["7", "KEEPTTL"]),
            ("l", "RPUSH", ["a", "b", "c", "b"]), ("l", "LREM", ["-1", "b"]), ("l", "LSET", ["-1", "z"]), ("l", "LSET", ["9", "z"]), ("l", "LTRIM", ["1", "-1"]), ("h", "HSET", ["f", "1", "g", "2"]), ("h", "HDEL", ["f"]),
            ("z", "ZADD", ["1", "a", "2", "b"]), ("z", "ZINCRBY", ["2.5", "a"]), ("e", "SADD", ["x"]), ("e", "SREM", ["x"]), ("e", "SET", ["now a string"]), ("g", "SET", ["x"]), ("g", "DEL", [])]
    log = spark.createDataFrame([(0, k, i, c, a) for i, (k, c, a) in enumerate(rows)], "db int, key string, seq int, cmd string, args array<string>")
    got = {}
    for r in folds.fold(log).collect():
        got.setdefault(r.key, []).append((r.type, r.pos, r.name, r.value, r.score, r.due_ms, r.errors))
    assert got == {
        "s": [("string", None, None, "7", None, 99, 1)], "l": [("list", 0, None, "b", None, None, 1), ("list", 1, None, "z", None, None, 1)], "h": [("hash", None, "g", "2", None, None, 0)],
        "z": [("zset", None, "a", None, 3.5, None, 0), ("zset", None, "b", None, 2.0, None, 0)], "e": [("string", None, None, "now a string", None, None, 0)],
    }
    many = spark.createDataFrame([(0, 0, "MSET", ["a", "1", "b", "2"]), (1, 0, "DEL", ["a", "c"]), (2, 0, "APPEND", ["b", "!"])], "seq int, db int, cmd string, args array<string>")
    assert [(r.key, r.value) for r in folds.fold(folds.split_keys(many)).collect()] == [("b", "2!")]
    with pytest.raises(Exception, match="can't be folded"):
        folds.fold(log.withColumn("cmd", F.lit("RENAME"))).count()
    with pytest.raises(Exception, match="no command on a list"):
        commandlog.fold_lists(spark.createDataFrame([("k", 1, "SADD", "x")], "key string, seq int, cmd string, arg string")).collect()


def test_resynchronisation(spark):
    log = spark.createDataFrame([(i, ["SET", f"k{i}", "v" * i]) for i in range(50)], "seq long, args array<string>")
    ends = {r.seq: r.ends for r in commandlog.offsets(log).collect()}
    mode, rest = commandlog.psync(log, "a", "a", ends[40])
    assert mode == "CONTINUE" and sorted(r.seq for r in rest.collect()) == list(range(41, 50))
    assert commandlog.psync(log, "a", "b", ends[40])[0] == commandlog.psync(log, "a", "a", ends[40] + 1)[0] == commandlog.psync(log, "a", "a", ends[3], backlog=100)[0] == "FULLRESYNC"


def test_graph_search_with_the_registered_parameters(spark):
    """Recall against the exact join, and the share of vectors whose distance is taken, on the largest table."""
    d = "/root/testdata/sf0.1"
    v = bind.vectors(spark, d)
    q = v.where("id % 50 = 0").select(F.col("id").alias("query"), F.col("embedding").alias("q"))
    exact = {(r.query, r.id) for r in vectors.knn_join(v, q, 5).collect()}
    graph = Scratch(spark, "test").put(vectorgraph.build(v))
    found = vectorgraph.search(graph, q, 5).collect()
    assert len(exact & {(r.query, r.id) for r in found}) >= 0.9 * len(exact)
    looked = {r.query: r.looked_at for r in found}
    assert sum(looked.values()) < 0.2 * v.count() * len(looked)
    shards = Scratch(spark, "test").put(vectorgraph.build(v, shard_rows=300))
    again = {(r.query, r.id) for r in vectorgraph.search(shards, q, 5).collect()}
    assert shards.select("shard").distinct().count() == 7 and len(exact & again) >= 0.9 * len(exact)


def test_graph_of_odd_vectors(spark):
    rows = [(i, i, [float(i), 0.0]) for i in range(5)] + [(9, 9, [1.0, 0.0]), (10, 10, None), (11, 11, [1.0]), (12, 12, [])]
    v = spark.createDataFrame(rows, "id long, insert_order long, embedding array<double>")
    q = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [1.0]), ("c", None)], "query string, q array<double>")
    graph = Scratch(spark, "test").put(vectorgraph.build(v))
    assert [(r.query, r.id, r.dist) for r in vectorgraph.search(graph, q, 3).orderBy("rank").collect()][:2] == [("a", 9, 0.0), ("a", 1, 0.0)]
    assert vectorgraph.search(graph, q.where("false"), 3).count() == 0 and vectorgraph.build(v.where("false")).count() == 0
    exact = {(r.query, r.id): r.rank for r in vectors.knn_join(v, q, 2).collect()}
    assert exact == {("a", 9): 1, ("a", 1): 2, ("b", 11): 1}
    zero = vectors.knn_join(v, q, 9, "cosine").collect()
    assert {r.id for r in zero if r.query == "a"} == {1, 2, 3, 4, 9}  # a vector without length has no angle


def test_random_and_approximate(spark, sf):
    s = bind.sets(spark, sf)
    popped, rest = sets.spop(s, 3)
    assert popped.join(s, ["key", "member"], "left_anti").count() == 0 and popped.count() + rest.count() == s.count()
    drawn = sets.srandmember(s, -20).collect()
    assert len(drawn) == 20 * s.select("key").distinct().count() and len(set(drawn)) < len(drawn)
    ids = streams.auto_ids(spark.createDataFrame([("s", 5, 1), ("s", 5, 2), ("s", 6, 3)], "key string, ms long, arrival long"))
    assert [r.id for r in ids.orderBy("arrival").collect()] == ["5-0", "5-1", "6-0"]
    x = sketches.native_distinct(spark.range(20000).selectExpr("'k' AS key", "cast(id AS string) AS item")).first().n_distinct
    y = sketches.pfcount(sketches.pfadd(spark.range(20000).selectExpr("'k' AS key", "cast(id AS string) AS item"))).first().n_distinct
    assert abs(x - 20000) < 3 * 0.0081 * 20000 and abs(y - 20000) < 3 * 0.0081 * 20000
