"""Keyspace operators over ``(db, key, type, expire_at, ...)`` tables.

Each takes whole tables and works on all keys at once; ``now`` is always an
argument, so that results are the same in every run.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def glob_regex(pattern: str) -> str:
    """An anchored regular expression for a glob of ``*`` and ``?``."""
    return "(?s)^" + "".join({"*": ".*", "?": "."}.get(c, re.escape(c)) for c in pattern) + "$"


def matches(col: Column, pattern: str) -> Column:
    """A literal prefix becomes a range that reaches the scan; the rest is a regular expression."""
    prefix = re.match(r"[^*?]*", pattern)[0]
    if pattern == prefix:
        return col == pattern
    test = col.startswith(prefix) if prefix else F.lit(True)
    return test if pattern == prefix + "*" else test & col.rlike(glob_regex(pattern))


def live(df: DataFrame, now: Column, expire: str = "expire_at") -> DataFrame:
    """Rows that haven't expired: a key expires at its instant, not after."""
    return df.where(F.col(expire).isNull() | (F.col(expire) > now))


def keys(df: DataFrame, pattern: str, key: str = "key") -> DataFrame:
    return df.where(matches(F.col(key), pattern))


def scan(df: DataFrame, *order: str, cursor: int = 0, count: int = 10, match: str | None = None, key: str = "key") -> DataFrame:
    """A page of the whole table, in a total order; a bounded top-k, not a sort of everything."""
    found = df if match is None else keys(df, match, key)
    return found.orderBy(*order).offset(cursor).limit(count)


def scan_each(df: DataFrame, key: str, *order: str | Column, cursor: int = 0, count: int = 10) -> DataFrame:
    """A page of every key's rows, for the scans of hashes, sets and sorted sets."""
    n = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return df.withColumn("_n", n).where(F.col("_n").between(cursor + 1, cursor + count)).drop("_n")


def exists(df: DataFrame, requested: DataFrame, key: str = "key") -> DataFrame:
    """``n_exists``: how many of the requested keys exist; a key asked for twice counts twice."""
    return requested.join(df.select(key).distinct(), key, "left_semi").agg(F.count("*").alias("n_exists"))


def delete(df: DataFrame, dropped: DataFrame, key: str = "key") -> DataFrame:
    return df.join(dropped.select(key).distinct(), key, "left_anti")


def rename(df: DataFrame, names: DataFrame, key: str = "key", only_new: bool = False) -> DataFrame:
    """``names(src, dst)``: rows move from src to dst and replace what is there; with ``only_new`` they don't where dst exists.

    A key renamed to itself stays as it is.
    """
    moves = names.join(df.select(F.col(key).alias("src")).distinct(), "src", "left_semi").where("src <> dst")
    if only_new:
        moves = moves.join(df.select(F.col(key).alias("dst")).distinct(), "dst", "left_anti")
    gone = moves.select(F.col("dst").alias(key))
    kept = df.join(gone, key, "left_anti").join(moves, F.col(key) == F.col("src"), "left")
    return kept.select(*(F.coalesce("dst", key).alias(key) if c == key else c for c in df.columns))


def type_of(df: DataFrame, requested: DataFrame, key: str = "key", kind: str = "type") -> DataFrame:
    """``key, type`` for requested keys, ``none`` where there is no such key; vector indexes show as hashes."""
    shown = F.when(F.col(kind) == "vec_index", "hash").otherwise(F.coalesce(F.col(kind), F.lit("none")))
    return requested.join(df.select(key, kind), key, "left").select(key, shown.alias("type"))


def dbsize(df: DataFrame, db: str = "db") -> DataFrame:
    return df.groupBy(db).agg(F.count("*").alias("n_keys"))


def random_key(df: DataFrame, seed: int, key: str = "key") -> DataFrame:
    """One key, the same for the same seed."""
    return df.orderBy(F.xxhash64(key, F.lit(seed)), key).limit(1).select(key)


def flush(df: DataFrame, db: int | None = None) -> DataFrame:
    """Without the keys of one database, or without any."""
    return df.where(F.lit(False)) if db is None else df.where(F.col("db") != db)


def select_db(df: DataFrame, db: int) -> DataFrame:
    return df.where(F.col("db") == db)


def touch_expiry(df: DataFrame, changes: DataFrame, now: Column, key: str = "key") -> DataFrame:
    """``changes(key, ttl_ms)``: sets ``expire_at``; a ttl that isn't positive removes the key at once."""
    joined = df.join(changes, key, "left").where("ttl_ms IS NULL OR ttl_ms > 0")
    due = F.when(F.col("ttl_ms").isNotNull(), F.timestamp_millis(F.unix_millis(now) + F.col("ttl_ms"))).otherwise(F.col("expire_at"))
    return joined.select(*(due.alias(c) if c == "expire_at" else c for c in df.columns))


def persist(df: DataFrame, keys_: DataFrame, key: str = "key") -> DataFrame:
    """Without expiry for the given keys."""
    hit = df.join(keys_.select(key).distinct().withColumn("_hit", F.lit(True)), key, "left")
    return hit.select(*(F.when(F.col("_hit"), F.lit(None)).otherwise(F.col(c)).alias(c) if c == "expire_at" else c for c in df.columns))


def ttl(df: DataFrame, requested: DataFrame, now: Column, unit_ms: int = 1000, key: str = "key") -> DataFrame:
    """``key, ttl``: -2 without the key, -1 without expiry, else what remains, rounded up."""
    found = requested.join(live(df, now).select(key, "expire_at", F.lit(True).alias("_there")), key, "left")
    left = F.ceil((F.unix_millis("expire_at") - F.unix_millis(now)) / unit_ms).cast("long")
    return found.select(key, F.when(F.col("_there").isNull(), -2).when(F.col("expire_at").isNull(), -1).otherwise(left).cast("long").alias("ttl"))
