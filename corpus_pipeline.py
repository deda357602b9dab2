"""Pipeline over documents: language, near duplicates, personal data, mixture, pieces.

Each stage takes (spark, docs, sf_dir) and works on whatever its predecessor kept;
all but the last return the columns of documents. Rows that can't be judged are
treated as each operator's docstring says: texts without letters leave at the
first stage, nulls in other columns pass, repeated rows count as copies, and an
empty table goes through empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sparkloom.llm import language_id, mixing, pii_crf, sentencepiece_spans, setsketch
from sparkloom.llm.common import cut, table


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is one of those known; the others go."""
    return language_id.keep_identified(docs, language_id.train(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return setsketch.drop_near_duplicates(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by labels."""
    return pii_crf.mask_pii(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources repeated to their target weights, shuffled."""
    return mixing.mix(docs)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of each document with their byte spans."""
    return sentencepiece_spans.encode(docs)


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("personal_data", personal_data), ("mixture", mixture), ("pieces", pieces)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages' result over documents; what each returns is written before the next reads it."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = cut(docs)
    return docs


#: The kernels, sketches, the random field and the segmentation aren't SQL; tests hold each stage against brute force.
ORACLE_SQL = None
