"""The corpus pipeline: from raw documents to sampled token ids.

Each stage takes (spark, docs, sf_dir), works on all that the stage before it
kept, and returns the columns of documents; the last returns the encoded
corpus. ``run`` writes each stage's result to the shared folder and rereads it;
at the end only the result's table is left there.

1. quality rules: documents that the label model rejects go.
2. n-gram Jaccard join: of each component of near duplicates (five words,
   similarity 0.8) the document with the least id stays.
3. secret scans: secrets in texts are replaced; no document goes.
4. mixing: each document is there as often as the mix takes it, in order of
   training position; what a source has beyond its share isn't taken.
5. SentencePiece: sampled segmentations, seeded by row key.

A mixed row's n_chars is that of its redacted text. Null and empty texts fail the first stage's base rule; extra columns are
carried through; empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.llm import mixing, neardup, pieces, quality, secrets
from waymark.llm.common import materialize, remove_written, table, written_so_far

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardup.keep_one_of_each(docs)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    redacted = secrets.redact(docs)
    return redacted.withColumn("n_chars", F.length("text").cast(redacted.schema["n_chars"].dataType)) if "n_chars" in docs.columns else redacted


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix_documents(docs, mixing.FIXED_WEIGHTS)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pieces.encode(docs, keep=("lang", "source")).withColumn("n_tokens", F.size("ids").cast("long"))


STAGES: list[tuple[str, Stage]] = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_duplicates),
    ("secret scans", secret_scans),
    ("mixing sources to target weights", mix_sources),
    ("SentencePiece encoding and decoding", encode_pieces),
]

#: The label model, near-duplicate components and sampling can't be put in SQL; tests/llm/test_pipeline.py runs all stages in plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs, since = table(spark, sf_dir, "documents"), written_so_far()
    for i, (_, stage) in enumerate(STAGES):
        docs = materialize(stage(spark, docs, sf_dir), f"stage{i}")
    remove_written(spark, since, keep=1)
    return docs
