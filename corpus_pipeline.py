"""Corpus pipeline: quality filter, near-duplicate removal, passage removal, packing. Each
stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes the result of each
stage as Parquet into the shared folder and reads it back as the next one's docs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lakestrata.llm import bagminhash, packing, passages, quality
from lakestrata.llm.common import lighten, materialise, release, small_batches, table


def prepare(spark: SparkSession) -> None:
    """Before a stage: small batches for Python, and executors without the last stage's garbage."""
    small_batches(spark)
    lighten(spark)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; it learns from the labelled ones.

    Null and empty texts are scored like any other and mostly go. Repeated rows share their
    score, so all of them stay or go; a doc_id with two labels teaches nothing. Null doc_ids
    are scored, never learnt from. Very long texts are scored whole. No labels: the score is
    one half for all, which is below the threshold, so nothing stays. Empty table: no rows.
    All columns pass through, whatever their names."""
    prepare(spark)
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class: that of the smallest doc_id.

    Texts without a word, null ones too, and rows without a doc_id all stay. Repeated rows and
    doc_ids: one row of a class stays; where two texts share the smallest doc_id, that of the
    smaller hash. Very long texts are compared whole. Empty table: no rows. All columns pass
    through, whatever their names."""
    prepare(spark)
    return bagminhash.keep_one(docs)


def passage_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages that stood in an earlier one, by doc_id and place.

    Null and empty texts stay as they are. A null doc_id comes first in order. Repeated rows of
    one doc_id and text are one document and are cut alike. Texts that lose all their words
    go; no word that is not repeated is cut, but for those within an alike paragraph. Very
    long texts are taken whole. Empty table: no rows. n_chars follows the text; all other
    columns pass through, whatever their names."""
    prepare(spark)
    return passages.clean(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of packed sequences.

    Null and empty texts: the end id alone. Null and repeated doc_ids: a document for each row,
    in order of doc_id and text hash, ties by place. Long texts are cut into pieces. Empty
    table: no rows. Of the columns only doc_id and text are read."""
    prepare(spark)
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("passages", passage_stage),
    ("packing", packing_stage),
]
#: The classifier and the signatures are beyond SQL: tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
        release(spark)
    return docs
