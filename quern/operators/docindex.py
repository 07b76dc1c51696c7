"""Inverted index over documents: postings, numeric fields, search and grouping."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def tokens(text: Column) -> Column:
    """Distinct runs of a-z and 0-9, lowered."""
    return F.array_distinct(F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda x: x != ""))


def query_tokens(query: str) -> list[str]:
    return list(dict.fromkeys(t for t in re.split("[^a-z0-9]+", query.lower()) if t))


def postings(docs: DataFrame, fields: list[str], doc: str = "doc") -> DataFrame:
    """``field, term, doc`` of text fields; a field may hold a text or an array of texts."""
    each = []
    for f in fields:
        text = F.array_join(F.col(f), " ") if docs.schema[f].dataType.typeName() == "array" else F.col(f)
        found = F.coalesce(tokens(text), F.array().cast("array<string>"))
        each.append(F.struct(F.lit(f).alias("field"), found.alias("terms")))
    return docs.select(doc, F.inline(F.array(*each))).select("field", F.explode("terms").alias("term"), doc)


class Catalog:
    """Named indexes: key prefix, text fields and numeric fields of each."""

    def __init__(self):
        self.indexes: dict[str, tuple[str, list[str], list[str]]] = {}

    def create(self, name: str, prefix: str, schema: dict[str, str]) -> None:
        bad = set(schema.values()) - {"TEXT", "NUMERIC"}
        if bad or not schema:
            raise ValueError(f"fields are TEXT or NUMERIC, not {sorted(bad)}")
        self.indexes[name] = (prefix, [f for f, k in schema.items() if k == "TEXT"], [f for f, k in schema.items() if k == "NUMERIC"])

    def drop(self, name: str) -> bool:
        return self.indexes.pop(name, None) is not None

    def names(self) -> list[str]:
        return sorted(self.indexes)

    def build(self, name: str, docs: DataFrame, doc: str = "doc") -> tuple[DataFrame, DataFrame | None]:
        """Postings and numbers of the documents under the index's prefix."""
        prefix, text, numbers = self.indexes[name]
        own = docs.where(F.col(doc).cast("string").startswith(prefix))
        return postings(own, text, doc), numeric(own, numbers, doc) if numbers else None


def numeric(docs: DataFrame, fields: list[str], doc: str = "doc") -> DataFrame:
    """``field, doc, num`` of numeric fields."""
    return docs.select(doc, F.inline(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).cast("double").alias("num")) for f in fields)))).where("num IS NOT NULL").select("field", doc, "num")


def update(index: DataFrame, changed: DataFrame, fields: list[str], doc: str = "doc") -> DataFrame:
    """Postings with those of the changed documents replaced."""
    return index.join(changed.select(doc), doc, "left_anti").select("field", "term", doc).union(postings(changed, fields, doc))


def remove(index: DataFrame, dropped: DataFrame, doc: str = "doc") -> DataFrame:
    return index.join(dropped.select(doc), doc, "left_anti")


def frequencies(index: DataFrame) -> DataFrame:
    return index.groupBy("term").agg(F.count("*").alias("n_docs"))


def search(index: DataFrame, query: str, numbers: DataFrame | None = None, field: str | None = None, low: float | None = None, high: float | None = None, offset: int | None = None, count: int = 10, doc: str = "doc") -> DataFrame:
    """Documents in which some term holds each of the query's words, within a range of a numeric field.

    One pass over the postings whatever the number of words; the range is a
    semi-join. With ``offset`` a page in order of the documents.
    """
    words = query_tokens(query)
    hits = F.array_compact(F.array(*(F.when(F.contains("term", F.lit(w)), F.lit(i)) for i, w in enumerate(words))))
    found = index.select(doc, F.explode(hits).alias("w")).groupBy(doc).agg(F.count_distinct("w").alias("n")).where(F.col("n") == len(words)).select(doc)
    if numbers is not None:
        found = found.join(numbers.where((F.col("field") == field) & F.col("num").between(low, high)).select(doc), doc, "left_semi")
    return found if offset is None else found.orderBy(doc).offset(offset).limit(count)


def aggregate(docs: DataFrame, group: str, reduce: str = "COUNT", field: str | None = None) -> DataFrame:
    """``grp`` with the count of documents or the sum of a field's finite values; a missing group is ``undefined``."""
    grp = F.coalesce(F.col(group).cast("string"), F.lit("undefined")).alias("grp")
    if reduce == "COUNT":
        return docs.groupBy(grp).agg(F.count("*").alias("value"))
    x = F.col(field).cast("double")
    return docs.groupBy(grp).agg(F.coalesce(F.sum(F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)), F.lit(0.0)).alias("value"))
