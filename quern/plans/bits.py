"""Queries of bitmaps and bit fields."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.operators import bits as bt
from quern.plans import bind as b
from quern.plans.registry import add
from quern.sources.tables import load

TWO = ["click", "view", "error"]


def _probes(s, d):
    return load(s, d, "customer").select(F.lit("click").alias("key"), F.col("c_custkey").alias("bit"))


def _flips(s, d):
    return load(s, d, "events").select(F.col("event_type").alias("key"), F.col("user_id").alias("bit"), (F.floor("value") % 2).cast("int").alias("on"), F.struct("ts", "event_id").alias("seq"))


def _some(s, d):
    """Bitmaps with gaps: a tenth of each event's value, in whole numbers, beside its user."""
    return load(s, d, "events").select(F.col("event_type").alias("key"), F.floor(F.col("value") * F.col("user_id") / 10).cast("long").alias("bit")).distinct()


SOME = "(SELECT DISTINCT event_type AS key, floor(value * user_id / 10)::BIGINT AS bit FROM events)"

add(
    "bit_setbit",
    lambda s, d: bt.setbit(_flips(s, d)),
    "SELECT key, bit FROM (SELECT event_type AS key, user_id AS bit, arg_max(floor(value)::BIGINT % 2, (ts, event_id)) AS o FROM events GROUP BY 1, 2) WHERE o = 1",
)
add(
    "bit_getbit",
    lambda s, d: bt.getbit(b.bits(s, d), _probes(s, d)),
    f"SELECT 'click' AS key, c_custkey AS bit, (c_custkey IN (SELECT bit FROM {b.BITS} AS b WHERE key = 'click'))::INT AS on FROM customer".replace(" AS on ", ' AS "on" '),
)
add("bit_bitcount", lambda s, d: bt.bitcount(b.bits(s, d)), "SELECT event_type AS key, count(DISTINCT user_id) AS n_bits FROM events GROUP BY 1")
add(
    "bit_bitcount_range",
    lambda s, d: bt.bitcount(_some(s, d), 2, 9),
    f"SELECT key, count(*) AS n_bits FROM {SOME} AS b WHERE bit BETWEEN 16 AND 79 GROUP BY key",
)
add(
    "bit_bitcount_tail",
    lambda s, d: bt.bitcount(_some(s, d), -4, -1),
    f"SELECT key, count(*) AS n_bits FROM (SELECT *, max(bit) OVER (PARTITION BY key) // 8 + 1 AS n FROM {SOME} AS b) WHERE bit >= (n - 4) * 8 GROUP BY key",
)
POS = """
WITH s AS (SELECT key, bit FROM {some} AS b), n AS (SELECT key, max(bit) // 8 + 1 AS n FROM s GROUP BY key), r AS (SELECT key, n, {lo} AS lo, {hi} AS hi FROM n),
p AS (SELECT key, n, lo, hi, unnest(range((lo * 8)::BIGINT, ((hi + 1) * 8)::BIGINT + 1)) AS p FROM r)
SELECT p.key, coalesce(min(CASE WHEN {test} THEN p.p END), -1)::BIGINT AS pos FROM p LEFT JOIN s ON s.key = p.key AND s.bit = p.p GROUP BY p.key"""
SET_TEST, CLEAR_TEST = "s.bit IS NOT NULL AND p.p < (hi + 1) * 8", "s.bit IS NULL OR p.p = (hi + 1) * 8"
for name, on, args, lo, hi in (("set", 1, (1,), "1", "n - 1"), ("clear", 0, (0,), "0", "n - 1"), ("set_range", 1, (3, -2), "3", "n - 2"), ("clear_range", 0, (-3, -1), "greatest(n - 3, 0)", "n - 1")):
    add(f"bit_bitpos_{name}", lambda s, d, on=on, args=args: bt.bitpos(_some(s, d), on, *args), POS.format(some=SOME, lo=lo, hi=hi, test=SET_TEST if on else CLEAR_TEST))
_SET = [f"(SELECT bit FROM {SOME} AS b WHERE key = '{k}')" for k in TWO]
add("bitop_and", lambda s, d: bt.bitop(_some(s, d), "AND", TWO), " INTERSECT ".join(_SET))
add("bitop_or", lambda s, d: bt.bitop(_some(s, d), "OR", TWO), " UNION ".join(_SET))
add(
    "bitop_xor",
    lambda s, d: bt.bitop(_some(s, d), "XOR", TWO),
    f"SELECT bit FROM {SOME} AS b WHERE key IN ('click', 'view', 'error') GROUP BY bit HAVING count(*) % 2 = 1",
)
add(
    "bitop_not",
    lambda s, d: bt.bitop(_some(s, d), "NOT", ["click"], 160),
    f"SELECT unnest(range(160)) AS bit EXCEPT SELECT bit FROM {SOME} AS b WHERE key = 'click'",
)


def _fields(s, d):
    q = load(s, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").cast("long").alias("q"), (F.col("l_extendedprice") % 256).cast("long").alias("p"))
    return q.withColumn("packed", F.shiftleft(F.col("q"), 8).bitwiseOR(F.col("p")))


FIELDS = "(SELECT l_orderkey, l_linenumber, l_quantity::BIGINT AS q, floor(l_extendedprice % 256)::BIGINT AS p FROM lineitem)"
KEYS = "l_orderkey, l_linenumber"
add(
    "bitfield_get",
    lambda s, d: _fields(s, d).select("l_orderkey", "l_linenumber", bt.field_get(F.col("packed"), 8, 48, 64).alias("q"), bt.field_get(F.col("packed"), 8, 56, 64, True).alias("p")),
    f"SELECT {KEYS}, q, CASE WHEN p >= 128 THEN p - 256 ELSE p END AS p FROM {FIELDS} AS f",
)
add(
    "bitfield_set",
    lambda s, d: _fields(s, d).select("l_orderkey", "l_linenumber", bt.field_set(F.col("packed"), 8, 46, F.col("q") + 250).alias("packed")),
    f"SELECT {KEYS}, ((q + 250) % 256) * 256 + p AS packed FROM {FIELDS} AS f",
)
for mode, sql in (("wrap", "(q + 230) % 256"), ("sat", "least(255, q + 230)"), ("fail", "CASE WHEN q + 230 <= 255 THEN q + 230 END")):
    add(f"bitfield_{mode}", lambda s, d, m=mode.upper(): _fields(s, d).select("l_orderkey", "l_linenumber", bt.field_incr(F.col("q"), F.lit(230), 8, False, m).alias("n")), f"SELECT {KEYS}, ({sql})::BIGINT AS n FROM {FIELDS} AS f")
add(
    "bitfield_signed_wrap",
    lambda s, d: _fields(s, d).select("l_orderkey", "l_linenumber", bt.field_incr(F.col("q"), F.lit(100), 8, True).alias("n")),
    f"SELECT {KEYS}, CASE WHEN q + 100 > 127 THEN q + 100 - 256 ELSE q + 100 END AS n FROM {FIELDS} AS f",
)


def _strings(s, d):
    """Quantity and price as the last two bytes of eight."""
    return _fields(s, d).withColumn("bytes", F.unhex(F.lpad(F.hex("packed"), 16, "0")))


OPS = [("GET", "u8", "#6"), ("INCRBY", "u8", "#7", 200), ("OVERFLOW", "SAT"), ("INCRBY", "u8", 48, 230), ("OVERFLOW", "FAIL"), ("INCRBY", "i8", "#5", 200), ("SET", "i64", 0, -1), ("GET", "u64", "#0"), ("INCRBY", "u63", 1, 1), ("GET", "i5", 70)]
add(
    "bitfield_many",
    lambda s, d: _strings(s, d).select("l_orderkey", "l_linenumber", F.explode(F.array(bt.bitfield(F.col("bytes"), OPS))).alias("x")).select("l_orderkey", "l_linenumber", F.hex("x.value").alias("left"), *(F.col("x.replies")[i].cast("string").alias(f"r{i}") for i in range(8))),
    f"""
SELECT {KEYS}, 'FFFFFFFFFFFFFFFF' AS "left", q::VARCHAR AS r0, ((p + 200) % 256)::VARCHAR AS r1, least(q + 230, 255)::VARCHAR AS r2, NULL::VARCHAR AS r3, (least(q + 230, 255) * 256 + (p + 200) % 256)::VARCHAR AS r4,
  '18446744073709551615' AS r5, NULL::VARCHAR AS r6, '0' AS r7 FROM {FIELDS} AS f""",
)
add(
    "bitfield_ro",
    lambda s, d: _strings(s, d).select("l_orderkey", "l_linenumber", bt.bitfield_ro(F.col("bytes"), [("u16", 48), ("i8", "#7"), ("u64", 0)]).alias("r")).select("l_orderkey", "l_linenumber", *(F.col("r")[i].cast("long").alias(f"r{i}") for i in range(3))),
    f"""
SELECT {KEYS}, q * 256 + p AS r0, CASE WHEN p >= 128 THEN p - 256 ELSE p END AS r1, q * 256 + p AS r2 FROM {FIELDS} AS f""",
)
