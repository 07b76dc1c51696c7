"""A shell for the engine: ``python -m quern.cli [folder]`` reads commands line by line, quoted as in a shell.

With a folder the engine begins with the snapshot there, and SAVE writes one.
"""

from __future__ import annotations

import inspect
import json
import sys
from collections.abc import Iterable, Iterator

from quern.engine import CommandError, Engine, rendered

#: Options that take no word after them, and those that take one.
FLAGS, VALUED = {"NX", "XX", "GET", "KEEPTTL", "PERSIST"}, {"EX", "PX", "EXAT", "PXAT", "MATCH", "COUNT", "M", "EF"}
WITH_OPTIONS = {"SET", "GETEX", "SCAN", "HSCAN", "SSCAN", "ZSCAN", "VEC.CREATEINDEX"}
#: Commands whose second word is part of the name.
TWO_WORDS = {"CONFIG", "ACL", "XGROUP", "XINFO", "SLOWLOG"}
ESCAPES = {"n": "\n", "r": "\r", "t": "\t"}


def words(line: str) -> list[str]:
    """The line cut at spaces; quotes hold words together, and within them a backslash escapes, ``\\xNN`` by number."""
    out, now, quote, i = [], None, "", 0
    while i < len(line):
        c = line[i]
        if quote and c == "\\" and i + 1 < len(line):
            i += 1
            code = line[i + 1 : i + 3]
            if line[i] == "x" and len(code) == 2 and all(x in "0123456789abcdefABCDEF" for x in code):
                now, i = now + chr(int(code, 16)), i + 2
            else:
                now += ESCAPES.get(line[i], line[i])
        elif c == quote:
            quote = ""
        elif not quote and c in "'\"":
            quote, now = c, now or ""
        elif not quote and c == " ":
            if now:
                out.append(now)
            now = None
        else:
            now = (now or "") + c
        i += 1
    return out + ([now] if now else [])


def _pairs(rest: list[str]) -> dict[str, str]:
    if len(rest) % 2:
        raise CommandError("wrong number of arguments")
    return dict(zip(rest[::2], rest[1::2], strict=True))


def _shaped(name: str, rest: list[str]) -> list:
    """Arguments whose form differs from a row of words."""
    if name in ("MSET", "MSETNX"):
        return [_pairs(rest)]
    if name in ("HSET", "HMSET"):
        return [rest[0], _pairs(rest[1:])]
    if name == "ZADD":
        return [rest[0], {m: float(s) for s, m in zip(rest[1::2], rest[2::2], strict=True)}]
    if name == "XADD":
        return [*rest[:2], _pairs(rest[2:])]
    if name == "GEOADD":
        return [rest[0], *((float(x), float(y), m) for x, y, m in zip(rest[1::3], rest[2::3], rest[3::3], strict=True))]
    if name in ("VEC.ADD", "VEC.SEARCH"):
        at = 2 if name == "VEC.ADD" else 1
        return [json.loads(w) if i == at else w for i, w in enumerate(rest)]
    if name == "DOC.INDEXCREATE":
        return [rest[0], rest[2], _pairs(rest[4:])]
    return rest


def command(line: str) -> tuple[str, list, dict]:
    """Name, arguments and options of a line."""
    name, *rest = words(line)
    name = name.upper()
    if name in TWO_WORDS and rest:
        name, rest = f"{name} {rest[0].upper()}", rest[1:]
    plain, options, i = [], {}, 0
    while i < len(rest):
        word = rest[i].upper()
        if name in WITH_OPTIONS and word in FLAGS and i > 0:
            options[word.lower()] = True
        elif name in WITH_OPTIONS and word in VALUED and i + 1 < len(rest) and i > 0:
            options[word.lower()] = rest[i + 1] if word == "MATCH" else int(rest[i + 1])
            i += 1
        else:
            plain.append(rest[i])
        i += 1
    return name, _numbers(name, _shaped(name, plain)), options


def _numbers(name: str, args: list) -> list:
    """Words become numbers where the engine's method asks for them."""
    method = getattr(Engine, name.lower().replace(".", "_").replace(" ", "_"), None)
    if not callable(method):
        return args
    kinds = [str(p.annotation).split(" ")[0] for p in inspect.signature(method).parameters.values() if p.kind is p.POSITIONAL_OR_KEYWORD][1:]
    made = {"int": int, "float": float}
    try:
        return [made[k](a) if isinstance(a, str) and k in made else a for a, k in zip(args, kinds, strict=False)] + args[len(kinds) :]
    except ValueError:
        raise CommandError("value is not a number") from None


def answers(engine: Engine, lines: Iterable[str], folder: str | None = None) -> Iterator[str]:
    """The reply to each line, until QUIT."""
    for line in lines:
        if not words(line):
            continue
        try:
            name, args, options = command(line)
            if name in ("QUIT", "EXIT"):
                return
            if name == "SAVE" and folder and not args:
                args = [folder]
            yield rendered(engine.call(name, *args, **options))
        except (CommandError, TypeError, ValueError, IndexError) as e:
            yield f"ERR {e}"


def main() -> None:
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.appName("quern").getOrCreate()
    folder = sys.argv[1] if len(sys.argv) > 1 else None
    engine = Engine.load(spark, folder) if folder else Engine(spark)
    for reply in answers(engine, sys.stdin, folder):
        print(reply, flush=True)


if __name__ == "__main__":
    main()
