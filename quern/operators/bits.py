"""Bitmaps as distinct ``(key, bit)`` rows, and bit fields packed into integers or byte strings.

Bit 0 is the first bit of the first byte. A bitmap's size grows with its set
bits only; the packed form counts bits per 32,768-bit block. Fields of up to 62
bits of one integer are expressions; ``bitfield`` runs any list of subcommands
over fields of up to 64 bits of a byte string, in Arrow batches, short strings
by columns and long ones row by row.
"""

from __future__ import annotations

import re
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ALL64 = (1 << 64) - 1
#: Bytes of a string up to which a batch of them is worked on by columns.
SHORT = 256
REPLIES = pa.list_(pa.decimal128(20, 0))


def setbit(writes: DataFrame) -> DataFrame:
    """``writes(key, bit, on, seq)``: bits whose last write is 1."""
    return writes.groupBy("key", "bit").agg(F.max_by("on", "seq").alias("on")).where("on = 1").select("key", "bit")


def getbit(bits: DataFrame, probes: DataFrame) -> DataFrame:
    return probes.join(bits.withColumn("_on", F.lit(1)), ["key", "bit"], "left").select("key", "bit", F.coalesce("_on", F.lit(0)).alias("on"))


def bitcount(bits: DataFrame, start: int | None = None, end: int | None = None) -> DataFrame:
    """Set bits of each key, within a range of bytes (both included) if given; negative bytes count from the end.

    Packed by block before they are shuffled: one bitmap a key, block and task.
    """
    if start is not None:
        if start < 0 or end < 0:
            n = F.floor(F.max("bit").over(Window.partitionBy("key")) / 8).cast("long") + 1
            lo, hi = (F.greatest(n + x, F.lit(0)) if x < 0 else F.lit(x) for x in (start, end))
        else:
            lo, hi = F.lit(start), F.lit(end)
        bits = bits.withColumns({"_lo": lo * 8, "_hi": hi * 8 + 7}).where("bit BETWEEN _lo AND _hi")
    packed = bits.groupBy("key", F.bitmap_bucket_number("bit").alias("block")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("m"))
    return packed.groupBy("key").agg(F.sum(F.bitmap_count("m")).cast("long").alias("n_bits"))


def bitpos(bits: DataFrame, on: int, start: int = 0, end: int | None = None) -> DataFrame:
    """The first bit that is set, or not set, of each key from byte ``start`` to byte ``end``, both included.

    Negative bytes count from the key's last. Without a set bit it is -1; without
    a clear one, the first bit behind the range. The first clear bit follows the
    first set bit whose successor is missing.
    """
    n = F.floor(F.max("bit") / 8).cast("long") + 1
    ranges = bits.groupBy("key").agg(n.alias("_n"))
    lo = F.greatest(F.lit(start) if start >= 0 else F.col("_n") + start, F.lit(0))
    hi = F.lit(2**60) if end is None else F.lit(end) if end >= 0 else F.col("_n") + end
    ranges = ranges.withColumns({"_lo": lo.cast("long"), "_hi": F.least(hi, F.col("_n") - 1).cast("long")})
    inside = bits.join(ranges, "key").where((F.col("bit") >= F.col("_lo") * 8) & (F.col("bit") < (F.col("_hi") + 1) * 8))
    nothing = F.col("_hi") < F.col("_lo")
    beyond = F.col("_lo") >= F.col("_n")
    if on:
        found = inside.groupBy("key").agg(F.min("bit").alias("_p"))
        return ranges.join(found, "key", "left").select("key", F.when(beyond | nothing, -1).otherwise(F.coalesce("_p", F.lit(-1))).cast("long").alias("pos"))
    gap = inside.withColumn("_next", F.lead("bit").over(Window.partitionBy("key").orderBy("bit"))).where("_next IS NULL OR _next > bit + 1")
    first = inside.groupBy("key").agg(F.min("bit").alias("_first")).join(gap.groupBy("key").agg((F.min("bit") + 1).alias("_end")), "key")
    clear = F.when(F.col("_first") == F.col("_lo") * 8, F.col("_end")).otherwise(F.col("_lo") * 8)
    return ranges.join(first, "key", "left").select("key", F.when(beyond, F.col("_n") * 8).when(nothing, -1).otherwise(clear).cast("long").alias("pos"))


def bitop(bits: DataFrame, op: str, keys: list, width: int | None = None) -> DataFrame:
    """``bit`` rows of AND, OR, XOR or NOT (up to ``width`` bits); one grouped count for any number of keys."""
    own = bits.where(F.col("key").isin(keys))
    if op == "NOT":
        spark = bits.sparkSession
        return spark.range(width).select(F.col("id").alias("bit")).join(own.select("bit"), "bit", "left_anti")
    n = own.groupBy("bit").agg(F.count("*").alias("_n"))
    test = {"AND": F.col("_n") == len(set(keys)), "OR": F.lit(True), "XOR": F.col("_n") % 2 == 1}[op]
    return n.where(test).select("bit")


def field_get(packed: Column, width: int, offset: int, total: int = 64, signed: bool = False) -> Column:
    """The field of ``width`` bits at ``offset`` from the top of a ``total``-bit integer; fields of up to 62 bits."""
    raw = F.shiftrightunsigned(packed, total - offset - width).bitwiseAND(F.lit((1 << width) - 1))
    return F.when(raw >= (1 << (width - 1)), raw - (1 << width)).otherwise(raw) if signed else raw


def field_set(packed: Column, width: int, offset: int, value: Column, total: int = 62) -> Column:
    at = total - offset - width
    keep = packed.bitwiseAND(F.lit(((1 << total) - 1) ^ (((1 << width) - 1) << at)))
    return keep.bitwiseOR(F.shiftleft(value.bitwiseAND(F.lit((1 << width) - 1)), at))


def field_incr(value: Column, by: Column, width: int, signed: bool = False, overflow: str = "WRAP") -> Column:
    """The field after an increment: WRAP around, SATurate, or null on FAIL."""
    lo, hi = (-(1 << (width - 1)), (1 << (width - 1)) - 1) if signed else (0, (1 << width) - 1)
    total = value + by
    if overflow == "WRAP":
        return F.pmod(total - lo, F.lit(1 << width)) + lo
    if overflow == "SAT":
        return F.greatest(F.lit(lo), F.least(F.lit(hi), total))
    return F.when(total.between(lo, hi), total)


def field_at(kind: str, offset: str | int) -> tuple[int, int, bool]:
    """Offset in bits, width and sign of a field such as ``u8`` at 16 or ``#2``, which counts in fields."""
    m = re.fullmatch(r"([ui])(\d+)", kind.lower())
    at = re.fullmatch(r"(#?)(\d+)", str(offset))
    if not m or not at or not 1 <= int(m[2]) <= 64:
        raise ValueError("syntax error")
    width = int(m[2])
    return int(at[2]) * (width if at[1] else 1), width, m[1] == "i"


def _run(data: bytes, ops: list[tuple]) -> tuple[bytes, list[int | None]]:
    policy, replies = "WRAP", []
    for name, *args in ops:
        if name == "OVERFLOW":
            policy = args[0]
            continue
        offset, width, signed = field_at(args[0], args[1])
        n = max(len(data), -(-(offset + width) // 8)) if name != "GET" else len(data)
        padded = data.ljust(max(n, -(-(offset + width) // 8)), b"\0")
        total, mask = len(padded) * 8, (1 << width) - 1
        at = total - offset - width
        word = int.from_bytes(padded, "big")
        raw = word >> at & mask
        old = raw - (1 << width) if signed and raw >> (width - 1) else raw
        if name == "GET":
            replies.append(old)
            continue
        new = args[2] + (old if name == "INCRBY" else 0)
        lo, hi = (-(1 << (width - 1)), (1 << (width - 1)) - 1) if signed else (0, mask)
        if not lo <= new <= hi:
            if policy == "FAIL":
                replies.append(None)
                continue
            new = max(lo, min(hi, new)) if policy == "SAT" else (new - lo) % (1 << width) + lo
        data = (word & ~(mask << at) | (new & mask) << at).to_bytes(len(padded), "big")
        replies.append(old if name == "SET" else new)
    return data, replies


def _end(ops: list[tuple]) -> int:
    """The bytes that the fields of some subcommands reach."""
    return max((-(-sum(field_at(*args[:2])[:2]) // 8) for name, *args in ops if name != "OVERFLOW"), default=0)


def _decimals(numbers: np.ndarray, signed: bool, known: np.ndarray) -> np.ndarray:
    """Numbers of 64 bits as decimals, 16 bytes each, low half first."""
    out = np.zeros((len(numbers), 2), np.uint64)
    out[:, 0] = numbers
    if signed:
        out[:, 1] = np.where(numbers.view(np.int64) < 0, np.uint64(ALL64), np.uint64(0))
    out[~known] = 0
    return out


def _changed(old: np.ndarray, arg: int, width: int, signed: bool, policy: str) -> tuple[np.ndarray, np.ndarray]:
    """Fields after ``arg`` is added, and where that is allowed.

    ``old`` and the result are 64-bit patterns. No sum is taken before it is known to fit: the room up to each bound is
    compared with the number first.
    """
    lo, hi = (-(1 << (width - 1)), (1 << (width - 1)) - 1) if signed else (0, (1 << width) - 1)
    kind = np.int64 if signed else np.uint64
    value = old.view(kind)
    if arg >= 0:
        beyond, edge = (value > kind(hi - arg) if hi - arg >= lo else np.ones(len(old), bool)), hi
    else:
        beyond, edge = (value < kind(lo - arg) if lo - arg <= hi else np.ones(len(old), bool)), lo
    total = old + np.uint64(arg & ALL64)  # modulo 2 ** 64
    if policy == "SAT":
        total = np.where(beyond, np.uint64(edge & ALL64), total)
    elif policy == "WRAP" and width < 64:
        total = total & np.uint64((1 << width) - 1)
        if signed:
            total = np.where(total >> np.uint64(width - 1) != 0, total | np.uint64(ALL64 ^ ((1 << width) - 1)), total)
    return total, ~beyond if policy == "FAIL" else np.ones(len(old), bool)


def _run_columns(data: np.ndarray, sizes: np.ndarray, ops: list[tuple]) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """``_run`` for the rows of a matrix of bytes, zeros behind each row's size; changes both, and gives decimals and where they are known."""
    policy, replies, there = "WRAP", [], []
    every = np.ones(len(data), bool)
    u = np.uint64
    for name, *args in ops:
        if name == "OVERFLOW":
            policy = args[0]
            continue
        offset, width, signed = field_at(args[0], args[1])
        first, last = offset // 8, (offset + width - 1) // 8
        spare = (last + 1) * 8 - offset - width  # bits of the last byte behind the field
        mask = u((1 << width) - 1)
        raw = np.zeros(len(data), u)
        for i in range(first, last + 1):
            left = (last - i) * 8 - spare
            byte = data[:, i].astype(u)
            raw |= byte << u(left) if left >= 0 else byte >> u(-left)
        raw &= mask
        old = np.where(raw >> u(width - 1) != 0, raw | u(ALL64 ^ int(mask)), raw) if signed else raw
        if name == "GET":
            replies.append(_decimals(old, signed, every))
            there.append(every)
            continue
        start = np.zeros(len(data), u) if name == "SET" else old
        new, ok = _changed(start, args[2], width, signed, policy)
        put = np.where(ok, new & mask, raw)
        for i in range(first, last + 1):
            left = (last - i) * 8 - spare
            part, over = (put >> u(left), mask >> u(left)) if left >= 0 else (put << u(-left), mask << u(-left))
            own = np.uint8(int(over) & 255)
            data[:, i] = (data[:, i] & np.uint8(255 ^ int(own))) | (part & u(255)).astype(np.uint8) & own
        np.maximum(sizes, np.where(ok, last + 1, 0), out=sizes)
        replies.append(_decimals(old if name == "SET" else new, signed, ok))
        there.append(ok)
    return sizes, replies, there


def _by_columns(values: pa.Array, ops: list[tuple]) -> pa.StructArray:
    """``bitfield`` of short strings; nulls are empty."""
    n = len(values)
    values = values.cast(pa.binary()).fill_null(b"")
    ends = np.frombuffer(values.buffers()[1], np.int32, n + 1, values.offset * 4).astype(np.int64)
    sizes = np.diff(ends)
    wide = max(int(sizes.max(initial=0)), _end(ops), 1)
    data = np.zeros((n, wide), np.uint8)
    if sizes.sum():
        data[np.arange(wide) < sizes[:, None]] = np.frombuffer(values.buffers()[2], np.uint8)[ends[0] : ends[-1]]
    sizes, replies, there = _run_columns(data, sizes, ops)
    at = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    out = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(at), pa.py_buffer(data[np.arange(wide) < sizes[:, None]])])
    k = len(replies)
    numbers = np.ascontiguousarray(np.stack(replies, axis=1)) if k else np.zeros((0, 2), np.uint64)
    known = np.packbits(np.stack(there, axis=1).ravel(), bitorder="little") if k else np.zeros(0, np.uint8)
    flat = pa.Array.from_buffers(pa.decimal128(20, 0), n * k, [pa.py_buffer(known), pa.py_buffer(numbers)])
    lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * k), flat)
    return pa.StructArray.from_arrays([out, lists], ["value", "replies"])


def _by_rows(values: pa.Array, ops: list[tuple]) -> pa.StructArray:
    done = [_run(v if v is not None else b"", ops) for v in values.to_pylist()]
    replies = pa.array([[None if r is None else Decimal(r) for r in d[1]] for d in done], REPLIES)
    return pa.StructArray.from_arrays([pa.array([d[0] for d in done], pa.binary()), replies], ["value", "replies"])


def run_batch(values: pa.Array, ops: list[tuple]) -> pa.StructArray:
    """``bitfield`` of a batch: by columns where each string, and what the fields reach, is short."""
    longest = pa.compute.max(pa.compute.binary_length(values)).as_py() or 0
    return _by_columns(values, ops) if max(longest, _end(ops)) <= SHORT else _by_rows(values, ops)


def bitfield(value: Column, ops: list[tuple]) -> Column:
    """``value, replies`` of a byte string under subcommands in order; a null value is an empty string.

    ``("GET", kind, offset)``, ``("SET", kind, offset, number)``, ``("INCRBY",
    kind, offset, number)`` and ``("OVERFLOW", "WRAP" | "SAT" | "FAIL")``, which
    holds for those after it. A refused change replies with null.
    """
    for name, *args in ops:
        if name not in ("GET", "SET", "INCRBY", "OVERFLOW") or (name == "OVERFLOW" and args[0] not in ("WRAP", "SAT", "FAIL")):
            raise ValueError("syntax error")
        if name != "OVERFLOW":
            field_at(args[0], args[1])

    @F.arrow_udf("value binary, replies array<decimal(20,0)>")
    def run(values: pa.Array) -> pa.Array:
        return run_batch(values, ops)

    return run(value)


def bitfield_ro(value: Column, fields: list[tuple[str, str | int]]) -> Column:
    """The numbers of some fields."""
    return bitfield(value, [("GET", kind, offset) for kind, offset in fields])["replies"]
