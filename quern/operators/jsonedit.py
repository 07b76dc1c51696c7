"""Changes of JSON documents at a path: the changed document, the reply, and the error if there is one.

Every change is an Arrow-batched function of the document column, for no
built-in expression writes into a document at a depth that isn't fixed. Members
keep their order and untouched parts their values. A path may not hold
wildcards. A text that is no JSON is a string value; a null document, which is
a key that doesn't exist, stays null.

Numbers are printed as whole where they are whole; ``reply`` is text: a length,
a number, a flag as 0 or 1, or what was taken out as JSON.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from quern.operators.jsondoc import MISSING, at_path, delete_path, dumped, loaded, set_path, steps

EDITED = "doc string, reply string, error string"
NO_PATH, NO_ARRAY, NO_STRING, NO_NUMBER, NO_FLAG = "path does not exist", "path is not an array", "path is not a string", "path is not a number", "path is not a boolean"


class _Refused(Exception):
    pass


def _expect(node, ok: bool, kind: str):
    if node is MISSING and kind == NO_ARRAY:
        raise _Refused(NO_PATH)
    if not ok:
        raise _Refused(kind)
    return node


def _array(node) -> list:
    return _expect(node, isinstance(node, list), NO_ARRAY)


def _number(node):
    return _expect(node, isinstance(node, (int, float)) and not isinstance(node, bool), NO_NUMBER)


def _edit(doc: Column, path: str, change: Callable, *args: Column, absent: str | None = NO_PATH) -> Column:
    """``change(node, *args)`` gives the new node, or ``MISSING`` to leave it, and the reply.

    ``absent`` is the error for a key that doesn't exist.
    """
    parts = steps(path)
    if "*" in parts or "**" in parts:
        raise ValueError("path may not contain wildcard for write operation")

    @F.pandas_udf(EDITED)
    def edit(docs: pd.Series, *columns: pd.Series) -> pd.DataFrame:
        out = []
        for d, *own in zip(docs, *columns, strict=True):
            if d is None:
                out.append((None, None, absent))
                continue
            root = loaded(d)
            try:
                new, reply = change(at_path(root, parts), *own)
            except _Refused as e:
                out.append((d, None, str(e)))
                continue
            out.append((d if new is MISSING else dumped(set_path(root, parts, new)), reply, None))
        return pd.DataFrame(out, columns=["doc", "reply", "error"])

    return edit(doc, *args)


def arrappend(doc: Column, path: str, *values: Column) -> Column:
    """JSON values behind the array's end; replies with its length."""
    def change(node, *new):
        node = _array(node) + [loaded(v) for v in new]
        return node, str(len(node))

    return _edit(doc, path, change, *values)


def arrinsert(doc: Column, path: str, index: int, *values: Column) -> Column:
    """Before ``index``; a negative one counts from behind the end; both are clamped."""
    def change(node, *new):
        at = index if index >= 0 else len(_array(node)) + index + 1
        at = min(max(at, 0), len(_array(node)))
        node = node[:at] + [loaded(v) for v in new] + node[at:]
        return node, str(len(node))

    return _edit(doc, path, change, *values)


def arrpop(doc: Column, path: str = "$", index: int = -1) -> Column:
    """Replies with the element as JSON, null where there is none."""
    def change(node):
        at = index + len(node) if isinstance(node, list) and index < 0 else index
        if not isinstance(node, list) or not 0 <= at < len(node):
            return MISSING, None
        return node[:at] + node[at + 1 :], dumped(node[at])

    return _edit(doc, path, change, absent=None)


def arrtrim(doc: Column, path: str, start: int, stop: int) -> Column:
    """Elements from ``start`` to ``stop``, both included; replies with their number."""
    def change(node):
        n = len(_array(node))
        lo, hi = (max(x + n if x < 0 else x, 0) for x in (start, stop))
        node = node[lo : hi + 1] if lo <= hi else []
        return node, str(len(node))

    return _edit(doc, path, change)


def arrindex(doc: Column, path: str, value: Column, start: int = 0, stop: int | None = None) -> Column:
    """The first place from ``start`` to ``stop``, both included, that holds the JSON value, or -1."""
    parts = steps(path)

    @F.pandas_udf("long")
    def find(docs: pd.Series, values: pd.Series) -> pd.Series:
        out = []
        for d, v in zip(docs, values, strict=True):
            node = MISSING if d is None else at_path(loaded(d), parts)
            items = [dumped(x) for x in node] if isinstance(node, list) else []
            n = len(items)
            lo = max(start + n if start < 0 else start, 0)
            hi = n - 1 if stop is None else min(stop + n if stop < 0 else stop, n - 1)
            wanted = dumped(loaded(v))
            out.append(next((i for i in range(lo, hi + 1) if items[i] == wanted), -1))
        return pd.Series(out, dtype="int64")

    return find(doc, value)


def _numbers(doc: Column, path: str, by: float, calculated: Callable) -> Column:
    if not math.isfinite(by):
        raise ValueError("value is not a valid float")

    def change(node):
        new = calculated(_number(node), by)
        return new, dumped(new)

    return _edit(doc, path, change)


def numincrby(doc: Column, path: str, by: float) -> Column:
    return _numbers(doc, path, by, lambda a, b: a + b)


def nummultby(doc: Column, path: str, by: float) -> Column:
    return _numbers(doc, path, by, lambda a, b: a * b)


def strappend(doc: Column, path: str, text: Column) -> Column:
    """JSON text or a bare one behind the string; replies with its length in UTF-16 units."""
    def change(node, more):
        more = loaded(more)
        new = _expect(node, isinstance(node, str), NO_STRING) + (more if isinstance(more, str) else dumped(more))
        return new, str(len(new.encode("utf-16-le")) // 2)

    return _edit(doc, path, change, text)


def toggle(doc: Column, path: str) -> Column:
    def change(node):
        new = not _expect(node, isinstance(node, bool), NO_FLAG)
        return new, str(int(new))

    return _edit(doc, path, change)


def clear(doc: Column, path: str = "$") -> Column:
    """Empty containers; replies with 1 where there is one, and 0 else."""
    def change(node):
        return (type(node)(), "1") if isinstance(node, (list, dict)) else (MISSING, "0")

    return _edit(doc, path, change, absent=None)


def set_value(doc: Column, path: str, value: Column) -> Column:
    """JSON text at a path: missing parents are made, arrays filled with null, scalars in the way replaced.

    A key that doesn't exist begins as null, so that the path makes its document.
    """
    parts = steps(path)

    @F.pandas_udf("string")
    def put(docs: pd.Series, values: pd.Series) -> pd.Series:
        return pd.Series([dumped(set_path(None if d is None else loaded(d), parts, loaded(v))) for d, v in zip(docs, values, strict=True)], dtype=object)

    return put(doc, value)


def delete(doc: Column, path: str) -> Column:
    """Without what is at the path; replies with 1 where there was something. At ``$`` the document itself goes."""
    parts = steps(path)

    @F.pandas_udf(EDITED)
    def remove(docs: pd.Series) -> pd.DataFrame:
        out = []
        for d in docs:
            root = MISSING if d is None else loaded(d)
            if root is MISSING or (parts and at_path(root, parts) is MISSING):
                out.append((d, "0", None))
            else:
                out.append((dumped(delete_path(root, parts)) if parts else None, "1", None))
        return pd.DataFrame(out, columns=["doc", "reply", "error"])

    return remove(doc)


def value_at(doc: Column, path: str = "$") -> Column:
    """The value as JSON, null without the path; members in their order. Wildcards give an array of all matches."""
    from quern.operators.jsondoc import find_all

    parts = steps(path)
    many = "*" in parts or "**" in parts

    @F.pandas_udf("string")
    def read(docs: pd.Series) -> pd.Series:
        def one(d):
            if d is None:
                return None
            node = find_all(loaded(d), parts) if many else at_path(loaded(d), parts)
            return None if node is MISSING or (many and not node) else dumped(node)

        return pd.Series([one(d) for d in docs], dtype=object)

    return read(doc)


def objkeys(doc: Column, path: str = "$") -> Column:
    """Names of an object's members in order, null where there is no object."""
    parts = steps(path)

    @F.pandas_udf("array<string>")
    def names(docs: pd.Series) -> pd.Series:
        found = [MISSING if d is None else at_path(loaded(d), parts) for d in docs]
        return pd.Series([list(x) if isinstance(x, dict) else None for x in found], dtype=object)

    return names(doc)


def objlen(doc: Column, path: str = "$") -> Column:
    return F.when(objkeys(doc, path).isNotNull(), F.size(objkeys(doc, path))).cast("long")
