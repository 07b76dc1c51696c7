"""JSON documents in a text column, read and changed by path.

Reads go through ``variant``, so that quoting survives and a wildcard gives an
array with null for members that lack the path. Changes at the first level
rebuild the object from its map of members; ``update_path``, and the changes in
``jsonedit``, reach any depth, batch by batch, where no expression can.
"""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.shared import ship

MEMBERS = "map<string,variant>"
class MISSING:
    """Stands for no value; a class, since workers know it by name."""


STEP = re.compile(r"""\.\.|\.\*|\.([^.\[\]]+)|\['([^']*)'\]|\[(\d+)\]|\[(\*)\]""")


def parsed(doc: Column) -> Column:
    return F.try_parse_json(doc)


def get(doc: Column, path: str = "$") -> Column:
    """The value as JSON text, null where there is none; one ``[*]`` gives an array."""
    if "[*]" in path:
        head, tail = path.split("[*]", 1)
        items = F.try_variant_get(parsed(doc), head, "array<variant>")
        return F.to_json(F.transform(items, lambda x: F.try_variant_get(x, "$" + tail, "variant")), {"ignoreNullFields": "false"}) if tail else F.to_json(items)
    return F.to_json(F.try_variant_get(parsed(doc), path, "variant"))


def mget(docs: DataFrame, requested: DataFrame, path: str) -> DataFrame:
    """``requested(pos, key)`` with the value at the path of each."""
    return requested.join(docs, "key", "left").select("pos", "key", get(F.col("doc"), path).alias("value"))


def type_of(doc: Column, path: str = "$") -> Column:
    """null, array, string, number, boolean or object; no value without the path."""
    schema = F.schema_of_variant(F.try_variant_get(parsed(doc), path, "variant"))
    return (
        F.when(schema.startswith("OBJECT"), "object").when(schema.startswith("ARRAY"), "array").when(schema == "STRING", "string").when(schema == "BOOLEAN", "boolean")
        .when(schema == "VOID", "null").when(schema.isNotNull(), "number")
    )


def _array(doc: Column, path: str) -> Column:
    return F.try_variant_get(parsed(doc), path, "array<variant>")


def arrlen(doc: Column, path: str = "$") -> Column:
    return F.size(_array(doc, path)).cast("long")


def strlen(doc: Column, path: str) -> Column:
    return F.length(F.try_variant_get(parsed(doc), path, "string")).cast("long")


def with_member(doc: Column, name: str, value: Column) -> Column:
    """The object with a member set to JSON text; members come in order of their names."""
    members = F.try_variant_get(parsed(doc), "$", MEMBERS)
    rest = F.map_filter(members, lambda k, v: k != name)
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(F.transform_values(F.map_concat(rest, F.create_map(F.lit(name), F.parse_json(value))), lambda k, v: v)), lambda a, b: F.when(a["key"] < b["key"], -1).when(a["key"] > b["key"], 1).otherwise(0))))


def without_member(doc: Column, name: str) -> Column:
    return F.to_json(F.map_filter(F.try_variant_get(parsed(doc), "$", MEMBERS), lambda k, v: k != name))


def steps(path: str) -> list:
    """Names, places and ``*`` of a path; ``..`` is ``**``."""
    out, at = [], 1 if path.startswith("$") else 0
    path = path if path.startswith("$") else "." + path if path and path[0] not in ".[" else path
    while at < len(path):
        m = STEP.match(path, at)
        if not m:
            raise ValueError(f"no path: {path}")
        word = m.group()
        if word == "..":
            out.append("**")
            at = m.end() - (0 if path[m.end() : m.end() + 1] == "[" else 1)
            continue
        out.append("*" if word in (".*", "[*]") else int(m[3]) if m[3] else m[1] if m[1] is not None else m[2])
        at = m.end()
    return out


def find_all(doc, path: list) -> list:
    """Values at a path with wildcards, in document order; a missing member is None."""
    if not path:
        return [doc]
    step, rest = path[0], path[1:]
    children = list(doc.values()) if isinstance(doc, dict) else doc if isinstance(doc, list) else []
    if step == "*":
        return [x for c in children for x in find_all(c, rest)]
    if step == "**":
        own = find_all(doc, rest) if not isinstance(rest[0], str) or rest[0] == "*" or (isinstance(doc, dict) and rest[0] in doc) else []
        return own + [x for c in children for x in find_all(c, path)]
    if isinstance(doc, list) and isinstance(step, int):
        return find_all(doc[step], rest) if step < len(doc) else [None]
    return find_all(doc[step], rest) if isinstance(doc, dict) and step in doc else [None]


def _whole(text: str) -> int | float:
    x = float(text)
    return int(x) if x.is_integer() and abs(x) < 1e21 else x


def _finite(text: str):
    raise ValueError(text)


def loaded(text: str | None):
    """The JSON value of a text; a text that is none is a string, without one layer of quotes."""
    if text is None:
        return None
    try:
        return json.loads(text, parse_float=_whole, parse_constant=_finite)
    except ValueError:
        return text[1:-1] if len(text) > 1 and text[0] == text[-1] and text[0] in "'\"" else text


def _printed(x):
    if isinstance(x, float):
        return int(x) if x.is_integer() and abs(x) < 1e21 else x if x - x == 0 else None
    if isinstance(x, dict):
        return {k: _printed(v) for k, v in x.items()}
    return [_printed(v) for v in x] if isinstance(x, list) else x


def dumped(value) -> str:
    """JSON without spaces, numbers printed as whole where they are; None and numbers that aren't finite are null."""
    return json.dumps(_printed(value), separators=(",", ":"), ensure_ascii=False)


def at_path(doc, path: list):
    """The value at a path of names and places, or ``MISSING``."""
    for step in path:
        if isinstance(step, int) and isinstance(doc, list) and step < len(doc):
            doc = doc[step]
        elif not isinstance(step, int) and isinstance(doc, dict) and step in doc:
            doc = doc[step]
        else:
            return MISSING
    return doc


def descend(doc_col: Column, path: str) -> Column:
    """JSON array of all matches of a path with ``..`` or several wildcards; built-in expressions reach one level only."""
    parts = steps(path)

    @F.pandas_udf("string")
    def walk(docs: pd.Series) -> pd.Series:
        return docs.map(lambda d: None if d is None else dumped(find_all(loaded(d), parts)))

    return walk(doc_col)


def set_path(doc, path: list, value):
    """A document with the value at the path; missing parents are made, arrays filled with null, scalars in the way replaced."""
    if not path:
        return value
    step, rest = path[0], path[1:]
    if isinstance(step, int):
        out = list(doc) if isinstance(doc, list) else []
        out += [None] * (step + 1 - len(out))
        out[step] = set_path(out[step], rest, value)
        return out
    out = dict(doc) if isinstance(doc, dict) else {}
    out[step] = set_path(out.get(step), rest, value)
    return out


def delete_path(doc, path: list):
    """A document without the value at the path."""
    if not path:
        return None
    step, rest = path[0], path[1:]
    if isinstance(doc, list) and isinstance(step, int) and step < len(doc):
        return doc[:step] + ([] if not rest else [delete_path(doc[step], rest)]) + doc[step + 1 :]
    if isinstance(doc, dict) and step in doc:
        return {k: (delete_path(v, rest) if k == step else v) for k, v in doc.items() if k != step or rest}
    return doc


def update_path(docs: DataFrame, path: str, value: Column | None) -> DataFrame:
    """``docs(key, doc, ...)`` with JSON text set at any path, or with the path removed where ``value`` is None."""
    from quern.operators import jsonedit

    ship(docs.sparkSession)
    new = jsonedit.delete(F.col("doc"), path)["doc"] if value is None else jsonedit.set_value(F.col("doc"), path, value)
    return docs.withColumn("doc", new)
