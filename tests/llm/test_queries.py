"""Registered queries, their SQL on the small tables, and the pipeline."""

import hashlib
import random
import re
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quern.llm import neardup, pii, quality, queries

TABLES = "documents pages labels".split()
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, sf, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    df = queries.queries()[name](spark, sf)
    rel = con.execute(queries.oracle_sql()[name])
    columns = [c[0] for c in rel.description]
    assert sorted(columns) == sorted(df.columns)
    plain = lambda v: float(f"{v:.9g}") if isinstance(v, float) else v
    key = lambda rows: sorted(repr(tuple(map(plain, r))) for r in rows)
    assert key(df.select(*columns).collect()) == key(rel.fetchall())


def test_ten_queries():
    assert sorted(int(q[2:].split("_")[0]) for q in queries.queries()) == list(range(1, 11))


def test_pipeline(spark, sf):
    """Each stage against its rule on its own input; the result against the library."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out, before = {}, docs
    for name, stage in corpus_pipeline.STAGES:
        out[name] = spark.createDataFrame((d := stage(spark, before, sf)).collect(), d.schema)
        if name != "tokens":
            assert out[name].columns == docs.columns
        before = out[name]
    stats = {r.doc_id: r for r in queries.queries()["op5_quality"](spark, sf).collect()}
    assert {r.doc_id for r in out["quality"].collect()} == {k for k, r in stats.items() if r.kept}
    found = neardup.near_duplicates(out["quality"]).collect()
    assert {r.doc_id for r in out["near-duplicates"].collect()} == {r.doc_id for r in found if r.kept}
    clean = out["personal data"].select("doc_id", "text").collect()
    assert not any(re.search(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+\.[A-Za-z]", r.text) for r in clean) and len(clean) == out["near-duplicates"].count()
    mixed = out["source mix"].collect()
    own = {r.source: r.n for r in out["personal data"].groupBy("source").agg(F.sum(F.size(F.regexp_extract_all("text", F.lit(WORD.pattern), F.lit(0)))).alias("n")).collect()}
    copies = Counter(r.doc_id for r in mixed)
    assert max(copies.values()) <= 2 and sum(len(WORD.findall(r.text)) for r in mixed) <= 1.5 * sum(own.values())
    from quern.llm.pieces import PieceModel

    lib = PieceModel.open(queries.piece_model()).library
    want = Counter((r.doc_id, hashlib.sha256(",".join(map(str, lib.encode(r.text))).encode()).hexdigest()) for r in mixed)
    assert Counter((r.doc_id, r.ids_sha256) for r in out["tokens"].collect()) == want
    assert Counter((r.doc_id, r.ids_sha256) for r in corpus_pipeline.run(spark, sf).collect()) == want
    assert pii.KINDS[:4] == ("email", "ip", "card", "phone")


def _odd(spark, docs):
    """Documents with null, empty and very long texts, null and repeated ids, ties, repeated rows, and columns with names of the stages' own."""
    rng = random.Random(9)
    kept = [r.text for r in quality.well_formed(docs).where("lang = 'en'").orderBy("doc_id").limit(60).collect()]
    pool = [w for t in kept for w in t.split()]
    text = lambda n: " ".join(rng.choice(pool) for _ in range(n))  # noqa: E731  like the prose around it
    long_, some, other, third = text(40_000), text(90), text(90), text(90)
    rows = [
        (9001, None, None, None), (9002, "", "en", "src0"), (9003, " \n ", "en", None), (None, some, "en", "src0"), (None, text(90), "en", "src0"), (9004, long_, "en", "src0"), (9005, long_ + " end", "en", "src1"),
        (9006, other, None, None), (9006, other, None, None), (9006, third, "xx", "src0"), (9007, "mail me@example.org now " * 30, "en", "src0"),
    ]
    odd = spark.createDataFrame([(i, t, lang, src, len(t or "")) for i, t, lang, src in rows], docs.schema)
    clash = {"_row": F.lit(1), "size": F.lit("x"), "taken": F.lit(2.5), "kept": F.lit(False), "id": F.lit(0), "text_": F.lit("t"), "component_id": F.lit(3), "n_tokens": F.lit("n"), "_id": F.lit(8), "spans": F.lit("s")}
    return docs.union(odd).withColumns(clash)


def test_pipeline_of_odd_documents(spark, sf, tmp_path):
    docs = _odd(spark, spark.read.parquet(f"{sf}/documents.parquet"))
    docs.write.parquet(f"{tmp_path}/odd/documents.parquet")
    before, out = docs, {}
    for name, stage in corpus_pipeline.STAGES:
        out[name] = spark.createDataFrame((d := stage(spark, before, sf)).collect(), d.schema)
        if name != "tokens":
            assert out[name].columns == docs.columns and out[name].where("size <> 'x' OR kept OR id <> 0 OR spans <> 's'").count() == 0
        before = out[name]
    ids = {k: Counter(r[0] for r in v.select("doc_id").collect()) for k, v in out.items()}
    assert not {9001, 9002, 9003, 9007} & ids["quality"].keys() and ids["quality"][None] == 2 and ids["quality"][9006] == 3  # short and repetitive texts go
    assert ids["near-duplicates"][9004] == 1 and 9005 not in ids["near-duplicates"] and ids["near-duplicates"][9006] == 1 and ids["near-duplicates"][None] == 2
    assert ids["personal data"] == ids["near-duplicates"] and set(ids["source mix"]) <= set(ids["personal data"]) and max(ids["source mix"].values()) <= 4
    run = corpus_pipeline.run(spark, f"{tmp_path}/odd").collect()
    assert Counter(r.ids_sha256 for r in run) == Counter(r.ids_sha256 for r in out["tokens"].collect())


def test_stages_alone_on_odd_documents(spark, sf):
    docs = _odd(spark, spark.read.parquet(f"{sf}/documents.parquet").limit(5))
    by = dict(corpus_pipeline.STAGES)
    kept = by["near-duplicates"](spark, docs, sf).collect()
    assert {9001, 9002, 9003} <= {r.doc_id for r in kept} and sum(r.doc_id == 9006 for r in kept) == 1
    texts = {r.doc_id: r.text for r in by["personal data"](spark, docs, sf).collect()}
    assert texts[9001] is None and texts[9002] == "" and "@" not in texts[9007]
    assert not {9001, 9002, 9003} & {r.doc_id for r in by["source mix"](spark, docs, sf).collect()}
    tokens = {r.doc_id: r.n_tokens for r in by["tokens"](spark, docs, sf).collect()}
    assert tokens[9001] == tokens[9002] == 0 and tokens[9004] > 40_000


def test_empty_tables(spark, sf, tmp_path):
    for t in TABLES:
        spark.read.parquet(f"{sf}/{t}.parquet").where("false").write.parquet(f"{tmp_path}/{t}.parquet")
    for name, query in {**queries.queries(), "pipeline": corpus_pipeline.run}.items():
        assert query(spark, str(tmp_path)).count() == 0, name
