"""What a query must not do on larger tables: plans, rows and memory that grow faster than the input."""

import time

import duckdb
import pyarrow as pa
from pyspark.sql import functions as F

from quern.operators import bits, geo, notify, sketches
from quern.plans import registry


def written(spark, tmp_path, **tables):
    """A folder of small tables of one's own."""
    for name, df in tables.items():
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


def agrees(spark, folder, name, *tables):
    """The query's rows and those of its SQL."""
    con = duckdb.connect()
    for t in tables:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet/*.parquet'")
    rel = con.execute(registry.oracle_sql()[name])
    columns = [c[0] for c in rel.description]
    got = registry.queries()[name](spark, folder).select(*columns)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == sorted(rel.fetchall(), key=repr)


def test_delivery_counts_messages_before_they_meet_subscribers(spark, sf):
    plan = registry.queries()["pubsub_delivery"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" in plan and "Aggregate" not in plan.split("Join")[0]
    msgs = spark.createDataFrame([(1, "a", "x"), (2, "a", "y"), (3, "b", "z"), (4, None, "z"), (5, "d", "z")], "seq int, channel string, payload string")
    subs = spark.createDataFrame([("a", "p"), ("a", "p"), ("a", "q"), ("b", "q"), ("c", "q"), (None, "q")], "channel string, client string")
    one_by_one = notify.publish(msgs, subs).groupBy("client", "channel").agg(F.count("*").alias("n_messages"))
    assert {tuple(r) for r in notify.delivered(msgs, subs).collect()} == {tuple(r) for r in one_by_one.collect()} == {("p", "a", 2), ("q", "a", 2), ("q", "b", 1)}


def test_insertnx_of_more_items_than_a_filter_of_that_capacity_holds(spark, tmp_path):
    e = spark.range(6000).select(F.col("id").alias("event_id"), (F.col("id") * 7 % 5000).alias("user_id"), F.lit("click").alias("event_type"))
    agrees(spark, written(spark, tmp_path, events=e), "cf_insertnx", "events")


def test_filters_are_filled_batch_by_batch(spark):
    items = spark.range(600).select(F.when(F.col("id") % 3 > 0, F.concat(F.lit("k"), F.col("id") % 3)).alias("key"), (F.col("id") * 11 % 150).cast("string").alias("item"), F.col("id").alias("seq"))
    items = items.union(spark.createDataFrame([("k1", None, 600)], items.schema))
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
        filled = sketches.cf_fill(items, 1024, only_new=True)
        assert "FlatMapGroups" not in filled._jdf.queryExecution().optimizedPlan().toString()  # one that holds all rows of a key in Python
        got = {(r.key, r.item, r.seq): r.added for r in filled.collect()}
        full = sketches.cf_fill(items, 16, 4, 20).groupBy("key").agg(F.min("added").alias("least")).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    assert got.pop(("k1", None, 600)) == 0 and len(full) == 3 and {r.least for r in full} == {0}
    assert got == {(r.key, r.item, r.seq): r.added for r in sketches.cf_addnx(items.where("item IS NOT NULL")).collect()}


def test_bit_fields_by_columns_are_those_row_by_row():
    ops = [("INCRBY", "u8", 5, 250), ("GET", "i64", "#0"), ("OVERFLOW", "SAT"), ("INCRBY", "i7", 60, 90), ("SET", "u63", 3, -1), ("OVERFLOW", "FAIL"), ("INCRBY", "i64", 1, -(1 << 63)), ("SET", "u64", 70, 1 << 64), ("INCRBY", "u64", 2, (1 << 64) - 1), ("OVERFLOW", "WRAP"), ("INCRBY", "i64", "#0", 1 << 70), ("GET", "i5", 140)]
    values = pa.array([b"", None, b"\xff" * 9, b"\x80" + bytes(7), b"abc", bytes(range(40, 60))], pa.binary())
    for batch in (values, values.slice(2), values.slice(0, 0)):
        got = bits.run_batch(batch, ops)
        assert got.to_pylist() == bits._by_rows(batch, ops).to_pylist()
        assert bits.run_batch(batch, []).to_pylist() == bits._by_rows(batch, []).to_pylist()
    long = pa.array([b"\1" * (bits.SHORT + 1), b"\2", None], pa.binary())
    assert bits.run_batch(long, ops).to_pylist() == bits._by_rows(long, ops).to_pylist()
    packed = pa.array([i.to_bytes(8, "big") for i in range(100_000)], pa.binary())
    start = time.process_time()
    bits.run_batch(packed, [("INCRBY", "u8", "#7", 200), ("OVERFLOW", "SAT"), ("INCRBY", "u8", 48, 230), ("SET", "i64", 0, -1), ("GET", "u64", "#0")])
    assert time.process_time() - start < 0.5  # seconds if it is done row by row


def test_places_of_a_full_cell_are_dealt_over_tasks(spark, monkeypatch):
    places = spark.range(300).select(F.lit("g").alias("key"), F.col("id").cast("string").alias("member"), (F.col("id") % 20 / 10).alias("lon"), (F.col("id") / 20 / 10).alias("lat"))
    want = sorted(geo.members_around(places, 60.0, "km").select("centre", "member").collect())
    monkeypatch.setattr(geo, "TASK_PAIRS", 5_000)
    near = geo.members_around(places, 60.0, "km")
    assert sorted(near.select("centre", "member").collect()) == want
    rows = [r[1] for r in near.groupBy(F.spark_partition_id()).count().collect()]
    assert len(rows) > 4 and max(rows) < len(want) / 3
    monkeypatch.setattr(geo, "BROADCAST_PLACES", 0)
    assert sorted(geo.members_around(places, 60.0, "km").select("centre", "member").collect()) == want
