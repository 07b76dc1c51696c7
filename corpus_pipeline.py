"""A corpus pipeline: quality, near-duplicates, personal data, source mix, tokens.

Each stage takes the documents that the one before it kept and returns
documents, but for the last, which returns a row of token ids' digests for each
copy that the mix took. ``run`` writes what a stage returns as Parquet in the
folder that all executors share and reads it again for the next, so that an
executor lost later costs no stage that is done.

Cases: a null, empty or very short text fails the quality rules and goes, so
later stages see none unless they are called alone: then near-duplicates keeps
texts without words and rows without an id, personal data leaves a null text
null, the mix takes no text without words, and tokens gives an empty text no ids.
Rows that repeat an id stay one document, the first by a hash of the row; of
near copies the smallest id stays; ties in the mix are ordered by a hash of the
row. A null language or source is a value of its own. Further columns are
carried to the stage before the last, whatever their names. Very long texts pass
whole through every stage. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quern.llm.mixing import mixed_corpus
from quern.llm.neardup import deduplicated
from quern.llm.pieces import piece_digests
from quern.llm.pii import without_personal_data
from quern.llm.quality import well_formed
from quern.llm.queries import piece_model
from quern.shared import Scratch
from quern.sources.tables import load


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return well_formed(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return deduplicated(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without_personal_data(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixed_corpus(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return piece_digests(docs, piece_model())


STAGES = [("quality", quality), ("near-duplicates", near_duplicates), ("personal data", personal_data), ("source mix", mix), ("tokens", tokens)]

#: Shingle signatures, fitted span weights and token ids can't be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = load(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        done = scratch.put(stage(spark, docs, sf_dir), f"stage{i}")
        if i:
            scratch.drop(docs)
            scratch.release()
        docs = done
    return docs
