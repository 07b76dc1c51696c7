"""Messages, keyspace notifications, cache invalidation, permissions and the slow log, from logs of commands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The commands that are notified, by the letter of their class; an event has its command's name.
CLASSES = {
    "$": ("SET", "SETNX", "SETEX", "APPEND", "SETRANGE", "INCR", "INCRBY", "DECR", "DECRBY"),
    "g": ("DEL", "EXPIRE", "PEXPIRE", "EXPIREAT", "PEXPIREAT", "PERSIST"),
    "l": ("LPUSH", "RPUSH", "LPOP", "RPOP", "LSET"),
    "s": ("SADD", "SREM", "SPOP", "SMOVE", "SUNIONSTORE", "SINTERSTORE", "SDIFFSTORE"),
    "h": ("HSET", "HDEL", "HMSET"),
    "z": ("ZADD", "ZREM"),
    "x": ("EXPIRED",),
}


def publish(messages: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """``seq, client, channel, payload``: each message for each of its channel's subscribers."""
    return messages.join(subscriptions.select("channel", "client").distinct(), "channel").select("seq", "client", "channel", "payload")


def delivered(messages: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """``client, channel, n_messages``: how many messages each subscriber gets. They are counted once a channel, before the join."""
    n = messages.groupBy("channel").agg(F.count("*").alias("n_messages"))
    return subscriptions.select("client", "channel").distinct().join(n, "channel").select("client", "channel", "n_messages")


def receivers(messages: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """``seq, receivers``: what PUBLISH returns. Subscribers are counted once a channel, before the join."""
    n = subscriptions.select("channel", "client").distinct().groupBy("channel").agg(F.count("*").alias("_n"))
    return messages.join(n, "channel", "left").select("seq", F.coalesce("_n", F.lit(0)).cast("long").alias("receivers"))


def subscriptions_at_end(log: DataFrame) -> DataFrame:
    """``log(client, channel, seq, op)`` of SUBSCRIBE and UNSUBSCRIBE: who listens to what at the end."""
    return log.groupBy("client", "channel").agg(F.max_by("op", "seq").alias("op")).where("op = 'SUBSCRIBE'").select("client", "channel")


def _class_of(cmd: Column) -> Column:
    out = F.lit(None).cast("string")
    for letter, commands in CLASSES.items():
        out = F.when(cmd.isin(*commands), letter).otherwise(out)
    return out


def expirations(keys: DataFrame, after_ms: Column, now_ms: Column) -> DataFrame:
    """``seq, db, cmd, key``: an EXPIRED for each of ``keys(db, key, due_ms)`` that falls due after one sweep and by the next.

    ``seq`` is the time it fell due; together with the commands of a log these
    rows go through ``notifications``.
    """
    due = F.col("due_ms")
    return keys.where((due > after_ms) & (due <= now_ms)).select(due.alias("seq"), "db", F.lit("EXPIRED").alias("cmd"), "key")


def notifications(log: DataFrame, flags: str) -> DataFrame:
    """``seq, channel, payload`` for ``log(seq, db, cmd, key)`` under flags such as ``KEA``.

    K and E choose the two kinds of channel, A stands for all classes.
    """
    wanted = set("g$lshzx") if "A" in flags else set(flags) & set("g$lshzx")
    told = log.withColumns({"_class": _class_of(F.upper("cmd")), "_event": F.lower("cmd")}).where(F.col("_class").isin(sorted(wanted)))
    kinds = []
    db = F.col("db").cast("string")
    if "E" in flags:
        kinds.append(F.struct(F.concat(F.lit("__keyevent@"), db, F.lit("__:"), F.col("_event")).alias("channel"), F.col("key").alias("payload")))
    if "K" in flags:
        kinds.append(F.struct(F.concat(F.lit("__keyspace@"), db, F.lit("__:"), F.col("key")).alias("channel"), F.col("_event").alias("payload")))
    if not kinds:
        return told.where(F.lit(False)).select("seq", F.lit("").alias("channel"), F.lit("").alias("payload"))
    return told.select("seq", F.inline(F.array(*kinds)))


def invalidations(accesses: DataFrame) -> DataFrame:
    """``client, key, seq`` of messages for ``accesses(client, key, seq, op)``, op R or W.

    A key that a client has read is announced to it at the next write, once.
    Per client and key the reads since the last write need no pairing: a read
    is announced at the write that follows the run it is in.
    """
    writes = accesses.where("op = 'W'").select("key", F.col("seq").alias("wseq"))
    reads = accesses.where("op = 'R'").select("client", "key", "seq")
    marked = reads.select("key", "seq", "client", F.lit(0).alias("w")).union(writes.select("key", F.col("wseq").alias("seq"), F.lit(None).cast(reads.schema["client"].dataType).alias("client"), F.lit(1).alias("w")))
    ahead = Window.partitionBy("key").orderBy("seq").rowsBetween(1, Window.unboundedFollowing)
    nxt = marked.withColumn("wseq", F.min(F.when(F.col("w") == 1, F.col("seq"))).over(ahead)).where("w = 0 AND wseq IS NOT NULL")
    return nxt.select("client", "key", F.col("wseq").alias("seq")).distinct()


def broadcasts(writes: DataFrame, prefixes: DataFrame) -> DataFrame:
    """``client, key, seq`` for every write whose key begins with a client's prefix.

    Prefixes are joined by equality, each write meeting its key's beginnings of
    the lengths that some prefix has.
    """
    lengths = sorted(r.n for r in prefixes.select(F.length("prefix").alias("n")).distinct().collect())
    starts = F.array(*(F.when(F.length("key") >= n, F.substring("key", 1, n)) for n in lengths)) if lengths else F.array().cast("array<string>")
    each = writes.withColumn("prefix", F.explode(F.array_compact(starts)))
    return each.join(prefixes, "prefix").select("client", "key", "seq").distinct()


def permitted(log: DataFrame, users: DataFrame) -> DataFrame:
    """``log(seq, user, cmd, key)`` with ``allowed``: the command is on the user's list and some pattern fits the key.

    ``users(user, enabled, all_commands, commands, all_keys, patterns)``, patterns as globs of ``*`` and ``?``.
    """
    quoted = lambda p: F.concat(F.lit("(?s)^"), F.replace(F.replace(F.regexp_replace(p, r"([.+^${}()|\[\]\\])", r"\\$1"), F.lit("*"), F.lit(".*")), F.lit("?"), F.lit(".")), F.lit("$"))
    key_ok = F.col("all_keys") | F.exists("patterns", lambda p: F.rlike(F.col("key"), quoted(p)))
    cmd_ok = F.col("all_commands") | F.array_contains("commands", F.col("cmd"))
    joined = log.join(users, "user", "left")
    return joined.select("seq", "user", "cmd", "key", F.coalesce(F.col("enabled") & cmd_ok & key_ok, F.lit(False)).alias("allowed"))


def slowlog(log: DataFrame, threshold_us: float = 1000, keep: int = 128) -> DataFrame:
    """The last ``keep`` commands of ``log(id, duration_us)`` at or over the threshold, newest first."""
    return log.where(F.col("duration_us") >= threshold_us).orderBy(F.desc("id")).limit(keep)
