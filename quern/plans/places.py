"""Queries of places and vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.functions import embedders
from quern.operators import geo as g
from quern.operators import vectorgraph as vg
from quern.operators import vectors as v
from quern.plans import bind as b
from quern.plans.registry import add
from quern.shared import Scratch
from quern.sources.tables import load

LON, LAT, KM = 15.0, 37.0, 3000.0


def _haversine(a: str, c: str) -> str:
    h = f"(pow(sin(radians({c}.lat - {a}.lat) / 2), 2) + cos(radians({a}.lat)) * cos(radians({c}.lat)) * pow(sin(radians({c}.lon - {a}.lon) / 2), 2))"
    return f"(2 * 6372793.490855331::DOUBLE * atan2(sqrt({h}), sqrt(1 - {h})))"


CENTRE = f"(SELECT {LON}::DOUBLE AS lon, {LAT}::DOUBLE AS lat)"
DIST = f"(SELECT g.*, {_haversine('c', 'g')} AS m FROM {b.GEO} AS g, {CENTRE} AS c)"


def _members(s, d):
    return load(s, d, "supplier").select(F.lit("suppliers").alias("key"), F.when(F.col("s_suppkey") % 2 == 0, F.col("s_suppkey").cast("string")).otherwise("none").alias("member")).distinct()


def _pairs(s, d):
    return load(s, d, "supplier").select(F.lit("suppliers").alias("key"), F.col("s_suppkey").cast("string").alias("a"), (F.col("s_suppkey") % 17 + 1).cast("string").alias("b"))


add(
    "geo_add",
    lambda s, d: g.geoadd(b.geo(s, d).withColumn("lat", F.col("lat") * 1.2).withColumn("seq", F.col("member"))),
    f"SELECT key, member, lon, lat * 1.2::DOUBLE AS lat FROM {b.GEO} AS g WHERE abs(lat * 1.2::DOUBLE) <= 90",
)
add("geo_pos", lambda s, d: g.geopos(b.geo(s, d), _members(s, d)), f"""
WITH m AS (SELECT DISTINCT CASE WHEN s_suppkey % 2 = 0 THEN s_suppkey::VARCHAR ELSE 'none' END AS member FROM supplier)
SELECT 'suppliers' AS key, m.member, lon, lat FROM m LEFT JOIN {b.GEO} AS g USING (member)""")
for name, unit, per in (("m", "m", 1.0), ("units", "mi", 1609.340383398085)):
    add(f"geo_dist_{name}", lambda s, d, u=unit: g.geodist(b.geo(s, d), _pairs(s, d), u).withColumn("dist", F.round("dist", 2)), f"""
SELECT 'suppliers' AS key, x.member AS a, (x.member::BIGINT % 17 + 1)::VARCHAR AS b, round({_haversine('x', 'y')} / {per}::DOUBLE, 2) AS dist FROM {b.GEO} AS x LEFT JOIN {b.GEO} AS y ON y.member = (x.member::BIGINT % 17 + 1)::VARCHAR""")
_CODE = " || ".join(f"substr('0123456789bcdefghjkmnpqrstuvwxyz', (1 + {' + '.join(f'(({chr(120 + (c * 5 + k) % 2)} >> {24 - (c * 5 + k) // 2}) & 1) * {16 >> k}' for k in range(5))})::INT, 1)" for c in range(10))
add(
    "geo_hash",
    lambda s, d: b.geo(s, d).select("member", g.geohash(F.col("lon"), F.col("lat")).alias("hash")),
    f"""
SELECT member, {_CODE} || '0' AS hash FROM (SELECT member, least(floor((lon + 180) / 360 * 33554432), 33554431)::BIGINT AS x, least(floor((lat + 90) / 180 * 33554432), 33554431)::BIGINT AS y FROM {b.GEO} AS g)""",
)
add(
    "geo_search_radius",
    lambda s, d: g.search_radius(b.geo(s, d), LON, LAT, KM, "km", 7).select("member", F.round("dist", 4).alias("dist")),
    f"SELECT member, round(m / 1000, 4) AS dist FROM {DIST} AS d WHERE m <= {KM} * 1000 ORDER BY m, member LIMIT 7",
)
add(
    "geo_search_desc",
    lambda s, d: g.search_radius(b.geo(s, d), LON, LAT, 9000.0, "km", 5, True).select("member", F.round("dist", 4).alias("dist")),
    f"SELECT member, round(m / 1000, 4) AS dist FROM {DIST} AS d WHERE m <= 9000000 ORDER BY m DESC, member LIMIT 5",
)
add(
    "geo_search_box",
    lambda s, d: g.search_box(b.geo(s, d), LON, LAT, 6000.0, 4000.0, "km").select("member", F.round("dist", 4).alias("dist")),
    f"""
SELECT member, round(m / 1000, 4) AS dist FROM {DIST} AS d WHERE abs(lat - {LAT}) <= 2000000 / 111320::DOUBLE AND abs(lon - {LON}) <= 3000000 / (111320::DOUBLE * cos(radians({LAT}::DOUBLE)))""",
)
add(
    "geo_search_member",
    lambda s, d: g.members_around(b.geo(s, d), 1500.0, "km").select("centre", "member", F.round("dist", 3).alias("dist")),
    f"""
SELECT x.member AS centre, y.member, round({_haversine('x', 'y')} / 1000, 3) AS dist FROM {b.GEO} AS x, {b.GEO} AS y WHERE {_haversine('x', 'y')} <= 1500000""",
)
add(
    "geo_store",
    lambda s, d: g.store(g.search_radius(b.geo(s, d), LON, LAT, KM, "km"), "near").withColumn("score", F.round("score", 4)),
    f"SELECT 'near' AS key, member, round(m / 1000, 4) AS score FROM {DIST} AS d WHERE m <= {KM} * 1000",
)
add(
    "geo_radius_withcoord",
    lambda s, d: g.search_radius(b.geo(s, d), LON, LAT, 10_000.0 * KM, "ft").select("member", "lon", "lat", g.geohash(F.col("lon"), F.col("lat")).alias("hash"), F.round("dist", 1).alias("dist")),
    f"""
SELECT member, lon, lat, {_CODE} || '0' AS hash, round(m / 0.3048::DOUBLE, 1) AS dist FROM (SELECT *, least(floor((lon + 180) / 360 * 33554432), 33554431)::BIGINT AS x, least(floor((lat + 90) / 180 * 33554432), 33554431)::BIGINT AS y FROM {DIST} AS d) WHERE m / 0.3048::DOUBLE <= 30000000""",
)

Q = "(SELECT embedding AS q FROM embeddings WHERE vec_id = 0)"
EUC = "round(sqrt(list_sum(list_transform(list_zip(embedding::DOUBLE[], q::DOUBLE[]), lambda z: (z[1] - z[2]) * (z[1] - z[2])))), 6)"
DOT = "list_sum(list_transform(list_zip({a}::DOUBLE[], {b}::DOUBLE[]), lambda z: z[1] * z[2]))"
COS = f"round(1 - {DOT.format(a='embedding', b='q')} / (sqrt({DOT.format(a='embedding', b='embedding')}) * sqrt({DOT.format(a='q', b='q')})), 6)"


def _query(s, d):
    return list(load(s, d, "embeddings").where("vec_id = 0").first().embedding)


def _queries(s, d):
    return load(s, d, "embeddings").where("vec_id % 50 = 0").select(F.col("vec_id").alias("query"), F.col("embedding").alias("q"))


def _writes(s, d):
    """Two vectors for each id."""
    return load(s, d, "embeddings").select(F.floor(F.col("vec_id") / 2).cast("long").alias("id"), "embedding", F.col("vec_id").alias("seq"))


def _arith(s, d, f):
    one = F.array(*map(F.lit, _query(s, d)))
    return b.vectors(s, d).select("id", F.round(f(F.col("embedding"), one), 6).alias("x"))


add(
    "vec_search_euclid",
    lambda s, d: v.search(b.vectors(s, d), _query(s, d), 10).withColumn("dist", F.round("dist", 6)),
    f"SELECT vec_id AS id, {EUC} AS dist FROM embeddings, {Q} AS q ORDER BY dist, vec_id DESC LIMIT 10",
)
add(
    "vec_search_cosine",
    lambda s, d: v.search(b.vectors(s, d), _query(s, d), 10, "cosine").select("id", (F.round("dist", 6) + 0.0).alias("dist")),
    f"SELECT vec_id AS id, abs({COS}) AS dist FROM embeddings, {Q} AS q ORDER BY dist, vec_id DESC LIMIT 10",
)
add(
    "vec_knn_join",
    lambda s, d: v.knn_join(b.vectors(s, d), _queries(s, d), 5).select("query", "id", F.round("dist", 6).alias("dist"), F.col("rank").cast("long").alias("rank")),
    f"""
WITH x AS (SELECT a.vec_id AS query, e.vec_id AS id, {EUC.replace('embedding::', 'e.embedding::').replace('q::', 'a.embedding::')} AS dist FROM embeddings AS e, embeddings AS a WHERE a.vec_id % 50 = 0)
SELECT query, id, dist, row_number() OVER (PARTITION BY query ORDER BY dist, id DESC) AS rank FROM x QUALIFY rank <= 5""",
)
add("vec_dot", lambda s, d: _arith(s, d, v.dot), f"SELECT vec_id AS id, round({DOT.format(a='embedding', b='q')}, 6) AS x FROM embeddings, {Q} AS q")
for name, f, op in (("addvec", v.add, "+"), ("subvec", v.subtract, "-")):
    add(f"vec_{name}", lambda s, d, f=f: b.vectors(s, d).select("id", F.inline(F.transform(f(F.col("embedding"), F.array(*map(F.lit, _query(s, d)))), lambda x, i: F.struct(i.cast("long").alias("i"), (F.round(x, 6) + 0.0).alias("x"))))), f"""
SELECT vec_id AS id, unnest(range(64)) AS i, unnest(list_transform(list_zip(embedding::DOUBLE[], q::DOUBLE[]), lambda z: round(z[1] {op} z[2], 6) + 0::DOUBLE)) AS x FROM embeddings, {Q} AS q""")
add(
    "vec_embedadd_json",
    lambda s, d: embedders.embed(load(s, d, "events").select("event_id", F.concat(F.lit('{"vector":['), F.col("user_id").cast("string"), F.lit(",1.5]}")).alias("payload")), "json").select("event_id", F.col("embedding")[0].alias("a"), F.col("embedding")[1].alias("b")),
    "SELECT event_id, user_id::DOUBLE AS a, 1.5::DOUBLE AS b FROM events",
)
add(
    "vec_add",
    lambda s, d: v.upsert(_writes(s, d)).select("id", "insert_order", F.round(F.col("embedding")[0].cast("double"), 6).alias("x0")),
    """
SELECT id, min(seq) AS insert_order, round(arg_max(x, seq)::DOUBLE, 6) AS x0 FROM (SELECT vec_id // 2 AS id, vec_id AS seq, embedding[1] AS x FROM embeddings) GROUP BY id""",
)
add("vec_stats", lambda s, d: v.stats(b.vectors(s, d)), "SELECT count(*) AS n_vectors, max(len(embedding)) AS dim FROM embeddings")
def _graph(s, d):
    return Scratch(s, "graph").put(vg.build(b.vectors(s, d)))


add(
    "vec_graph_stats",
    lambda s, d: vg.stats(_graph(s, d)).select("n_vectors", "dim", "n_shards"),
    "SELECT count(*) AS n_vectors, max(len(embedding)) AS dim, 1::BIGINT AS n_shards FROM embeddings",
)
add(
    "vec_graph_search",
    lambda s, d: vg.search(_graph(s, d), _queries(s, d), 5).select("query", "id", F.round("dist", 6).alias("dist"), F.col("rank").cast("long").alias("rank")),
)
