"""Places as ``(key, member, lon, lat)`` rows: distances, hashes, radius and box searches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The sphere, units, degrees and the alphabet of hashes.
RADIUS_M = 6372793.490855331
UNITS = {"m": 1.0, "km": 1000.0, "mi": 1609.340383398085, "ft": 0.3048}
METRES_A_DEGREE = 111320.0
BASE32 = "0123456789bcdefghjkmnpqrstuvwxyz"
#: Pairs of a centre and a place that a task compares, about.
TASK_PAIRS = 4_000_000
#: Places up to which they are broadcast to those tasks.
BROADCAST_PLACES = 1_000_000


def geoadd(writes: DataFrame) -> DataFrame:
    """``writes(key, member, lon, lat, seq)``: the last place of each member, if it is on the globe."""
    ok = writes.where("lon BETWEEN -180 AND 180 AND lat BETWEEN -90 AND 90")
    return ok.groupBy("key", "member").agg(F.max_by(F.struct("lon", "lat"), "seq").alias("x")).select("key", "member", "x.*")


def distance_m(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Haversine."""
    u, v = F.sin(F.radians(lat2 - lat1) / 2), F.sin(F.radians(lon2 - lon1) / 2)
    a = u * u + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * v * v
    return 2 * RADIUS_M * F.atan2(F.sqrt(a), F.sqrt(1 - a))


def in_unit(metres: Column, unit: str) -> Column:
    return metres / UNITS[unit]


def geopos(geo: DataFrame, requested: DataFrame) -> DataFrame:
    return requested.join(geo, ["key", "member"], "left").select("key", "member", "lon", "lat")


def geodist(geo: DataFrame, pairs: DataFrame, unit: str = "m") -> DataFrame:
    """``pairs(key, a, b)`` with ``dist``, null where a member is missing."""
    a = geo.select("key", F.col("member").alias("a"), F.col("lon").alias("_lon1"), F.col("lat").alias("_lat1"))
    b = geo.select("key", F.col("member").alias("b"), F.col("lon").alias("_lon2"), F.col("lat").alias("_lat2"))
    both = pairs.join(a, ["key", "a"], "left").join(b, ["key", "b"], "left")
    return both.select("key", "a", "b", in_unit(distance_m(*map(F.col, ("_lon1", "_lat1", "_lon2", "_lat2"))), unit).alias("dist"))


def geohash(lon: Column, lat: Column) -> Column:
    """Eleven characters: 25 bits of each axis, interleaved, and a zero."""
    cell = lambda x, lo, span: F.least(F.floor((x - lo) / span * (1 << 25)), F.lit((1 << 25) - 1)).cast("long")
    x, y = cell(lon, -180.0, 360.0), cell(lat, -90.0, 180.0)
    bit = lambda v, i: F.shiftright(v, i).bitwiseAND(F.lit(1))
    chars = []
    for c in range(10):
        code = F.lit(0).cast("long")
        for k in range(5):
            at = c * 5 + k
            code = code * 2 + bit(x if at % 2 == 0 else y, 24 - at // 2)
        chars.append(F.substring(F.lit(BASE32), code.cast("int") + 1, F.lit(1)))
    return F.concat(*chars, F.lit("0"))


def bounding_box(geo: DataFrame, lon: float, lat: float, metres: float) -> DataFrame:
    """Places that may lie within the distance: a range of latitudes, and of longitudes away from the poles and the date line."""
    import math

    dlat = math.degrees(metres / RADIUS_M) * 1.000001
    out = geo.where(F.col("lat").between(lat - dlat, lat + dlat))
    top = max(abs(lat - dlat), abs(lat + dlat))
    if top < 89:
        dlon = math.degrees(math.asin(min(1.0, math.sin(min(math.radians(dlat), math.pi / 2)) / math.cos(math.radians(lat))))) * 1.000001 if math.sin(min(math.radians(dlat), math.pi / 2)) < math.cos(math.radians(lat)) else 360
        if lon - dlon >= -180 and lon + dlon <= 180:
            out = out.where(F.col("lon").between(lon - dlon, lon + dlon))
    return out


def search_radius(geo: DataFrame, lon: float, lat: float, radius: float, unit: str = "m", count: int | None = None, descending: bool = False) -> DataFrame:
    """Members within the radius with ``dist``, nearest first; a bounded top-k where ``count`` is given."""
    metres = radius * UNITS[unit]
    d = distance_m(F.lit(float(lon)), F.lit(float(lat)), F.col("lon"), F.col("lat"))
    found = bounding_box(geo, lon, lat, metres).withColumn("_m", d).where(F.col("_m") <= metres).withColumn("dist", in_unit(F.col("_m"), unit)).drop("_m")
    if count is None:
        return found
    return found.orderBy(F.desc("dist") if descending else F.asc("dist"), "member").limit(count)


def search_box(geo: DataFrame, lon: float, lat: float, width: float, height: float, unit: str = "m") -> DataFrame:
    """Members of a box of degrees that approximates the given lengths, with ``dist``."""
    import math

    dlat = height * UNITS[unit] / 2 / METRES_A_DEGREE
    dlon = width * UNITS[unit] / 2 / (METRES_A_DEGREE * math.cos(math.radians(lat)))
    box = geo.where(F.col("lat").between(lat - dlat, lat + dlat) & F.col("lon").between(lon - dlon, lon + dlon))
    return box.withColumn("dist", in_unit(distance_m(F.lit(float(lon)), F.lit(float(lat)), F.col("lon"), F.col("lat")), unit))


def _on_unit_sphere(lon: str, lat: str) -> tuple[Column, Column, Column]:
    a, b = F.radians(lon), F.radians(lat)
    return F.cos(b) * F.cos(a), F.cos(b) * F.sin(a), F.sin(b)


def search_around(geo: DataFrame, centres: DataFrame, radius: float, unit: str = "m") -> DataFrame:
    """``key, centre, member, dist`` for every centre of ``centres(key, centre, clon, clat)`` at once.

    An equality join on cells: bands of latitude of at least the radius, each
    cut into cells of longitude that are at least as wide as the radius is
    there, a whole number of them around the globe. A centre is looked up in its
    cell and those beside it in its band and the two next to it, so work grows
    with what lies near. Around the poles a band is one cell. The exact distance
    follows.

    Pairs grow with the square of what a cell holds, and tables too small to be
    dealt out by their bytes have many. So they are counted by cell first: from
    ``TASK_PAIRS`` on there is a task for each so many. Up to ``BROADCAST_PLACES``
    go to all tasks and centres are dealt; of more, the centres of a cell with
    over a quarter of a task's pairs are dealt into shares that each meet all
    its places.
    """
    import math

    metres = radius * UNITS[unit]
    angle = min(metres / RADIUS_M * 1.000001, math.pi)
    size = max(math.degrees(angle), 1e-4)
    band_of = lambda c: F.floor((F.col(c) + 90) / size).cast("long")

    def n_cells(band: Column) -> Column:
        """Of a band, so that centres up to a band away find all within the radius one cell to either side."""
        top = F.greatest(F.abs((band - 1) * size - 90), F.abs((band + 2) * size - 90))
        width = F.lit(math.sin(min(max(angle, math.radians(1e-4)), math.pi / 2))) / F.cos(F.radians(top))
        return F.when((top >= 90) | (width >= 1) | F.lit(angle >= math.pi / 2), 1).otherwise(F.greatest(F.floor(360 / (F.degrees(F.asin(width)) * 1.000001)), F.lit(1))).cast("long")

    def cell(lon: Column, band: Column) -> Column:
        return F.least(F.floor((lon + 180) / 360 * n_cells(band)), n_cells(band) - 1).cast("long")

    places = geo.withColumn("_band", band_of("lat")).withColumn("_cell", cell(F.col("lon"), F.col("_band")))
    around = centres.withColumn("_band", F.explode(F.sequence(band_of("clat") - 1, band_of("clat") + 1)))
    beside = F.array_distinct(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda k: F.pmod(cell(F.col("clon"), F.col("_band")) + k, n_cells(F.col("_band")))))
    around = around.withColumn("_cell", F.explode(beside))
    places = places.withColumns(dict(zip(("_x", "_y", "_z"), _on_unit_sphere("lon", "lat"), strict=True)))
    around = around.withColumns(dict(zip(("_cx", "_cy", "_cz"), _on_unit_sphere("clon", "clat"), strict=True)))
    chord = sum(((F.col(f"_{c}") - F.col(f"_c{c}")) * (F.col(f"_{c}") - F.col(f"_c{c}")) for c in "xyz"), F.lit(0.0))  # squared; spares far pairs the angles

    by = ["key", "_band", "_cell"]
    pairs = places.groupBy(by).agg(F.count("*").alias("_a")).join(around.groupBy(by).agg(F.count("*").alias("_b")), by).withColumn("_pairs", F.col("_a").cast("double") * F.col("_b"))
    total = pairs.agg(F.sum("_pairs")).first()[0] or 0.0
    if total > TASK_PAIRS:
        tasks = math.ceil(total / TASK_PAIRS)
        if places.count() <= BROADCAST_PLACES:
            places, around = F.broadcast(places), around.repartition(tasks, "centre", *by)
        else:
            shares = pairs.select(*by, F.least(F.ceil(F.col("_pairs") / TASK_PAIRS * 4), F.col("_b")).cast("int").alias("_shares"))
            places = places.join(shares, by).withColumn("_share", F.explode(F.sequence(F.lit(0), F.col("_shares") - 1))).drop("_shares")
            around = around.join(shares, by).withColumn("_share", F.pmod(F.xxhash64("centre"), F.col("_shares")).cast("int")).drop("_shares")
            at = F.struct(*by, "_share").alias("_at")
            places = places.select(at, "member", "lon", "lat", "_x", "_y", "_z").repartition(tasks, "_at")
            around = around.select(at, "key", "centre", "clon", "clat", "_cx", "_cy", "_cz").repartition(tasks, "_at")
            by = ["_at"]
    d = distance_m(F.col("clon"), F.col("clat"), F.col("lon"), F.col("lat"))
    near = places.join(around, by).where(chord <= (2 * math.sin(angle / 2)) ** 2 + 1e-9).withColumn("_m", d).where(F.col("_m") <= metres)
    return near.select("key", "centre", "member", in_unit(F.col("_m"), unit).alias("dist"))


def members_around(geo: DataFrame, radius: float, unit: str = "m", members: DataFrame | None = None) -> DataFrame:
    """GEORADIUSBYMEMBER for all members, or those of ``members(key, member)``."""
    own = geo if members is None else geo.join(members, ["key", "member"], "left_semi")
    return search_around(geo, own.select("key", F.col("member").alias("centre"), F.col("lon").alias("clon"), F.col("lat").alias("clat")), radius, unit)


def store(found: DataFrame, dest: str, with_distance: bool = True) -> DataFrame:
    """A sorted set of the members, scored by distance or 0."""
    return found.select(F.lit(dest).alias("key"), "member", (F.col("dist") if with_distance else F.lit(0.0)).alias("score"))
