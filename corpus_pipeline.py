"""A training corpus from raw documents, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
as Parquet and reread as the next one's documents. All but the last return the
columns of ``documents``. Stages that run Python bound the Arrow batches of the
session by bytes, from then on: their result is computed later, when the caller
writes it.

In all stages an empty table gives an empty one, extra columns pass through
whatever their names (but for the last stage, which returns pieces), and rows
without an id are documents like others.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from frameloom.llm import exact, language, near, packing, quality
from frameloom.llm.shared import bounded_batches, clear, fold, mark, written


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or of no clear language, go.

    Null and empty texts have no letter. Rows without ``lang`` are not learned
    from but judged like others; if nothing can be learned from, no language is
    known and every row goes. Very long texts are read whole; ties between
    languages and repeated rows are judged alike.
    """
    bounded_batches(spark)
    return language.keep_known(docs, language.train(docs, only_where=fold("doc_id", 5) != 0))


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are toxic or of low quality go.

    A null or empty text is judged by the thresholds alone. Null ratings are
    ignored, of several the least counts, and without any rating all documents
    stay. Very long texts are read whole; a probability of exactly one half
    stays; repeated rows are judged alike.
    """
    bounded_batches(spark)
    ratings = quality.grades_of(spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.keep_good(docs, quality.train(docs, ratings))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the largest id stays.

    Null counts as empty. Repeated rows of one id tie and stay together; rows
    without an id stay only where no equal one has an id. Texts of any length
    are compared by their digest.
    """
    return exact.keep_one(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, the one with the least id, stays.

    Texts without words are linked with nothing and stay. Repeated rows of one
    id stay together, as do rows without an id. Very long texts are compared
    whole; a similarity of exactly 0.8 links.
    """
    bounded_batches(spark)
    return near.keep_one(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences.

    A null or empty text is the end id alone; longer texts than a sequence are
    cut; ties in length go by id; repeated rows are packed each.
    """
    bounded_batches(spark)
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language_id", language_id),
    ("quality_classifier", quality_classifier),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("best_fit_packing", best_fit_packing),
]

#: SQL can express neither the models nor the packing; the tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, applied to the documents table. What a stage wrote on its way is deleted when its result is stored."""
    docs, since = spark.read.parquet(f"{sf_dir}/documents.parquet"), mark()
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
        clear(spark, since, docs)
    return STAGES[-1][1](spark, docs, sf_dir)
