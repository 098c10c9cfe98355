"""A training-data pipeline over `documents`; its stages are operators of transmuta.llm.

STAGES are (name, function) pairs; a function takes (spark, docs, sf_dir) and returns a DataFrame. run() writes each
stage as Parquet into the shared folder and rereads it as the next one's docs.

Defined results, for every stage: null, empty and very long texts are kept as they are (a text without words is linked with
nothing, has nothing to cut, takes no words of a mix, and has no ids); null sources are one source; rows with a null id are
kept by the first three stages, as nothing is known of them; rows that share an id are one document to the second stage and
stay or go together; ties go to the smaller id, and to rows alike in id and text alike; an empty table stays empty, whatever the labels;
columns of any other name stay as they are, and the ids of the last stage are in `ids`, or in `_ids` where documents have such a column.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from transmuta.functions.materialize import Written
from transmuta.llm import bpe, minhash, mixing, repeats, toxicity
from transmuta.llm.tables import table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on the labels, does not predict toxic."""
    return toxicity.clean_documents(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near-duplicates."""
    return minhash.distinct_documents(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without the passages that an earlier one has; n_chars follows the text."""
    return repeats.deduplicated_documents(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: a document taken twice is two rows."""
    return mixing.mixed_documents(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_chars, ids: token ids of each row's text."""
    return bpe.encode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("repeated_passages", cut_repeats),
    ("mixing", mix_sources),
    ("byte_bpe", tokenize),
]

#: SQL cannot express the learned and the suffix stages; tests/llm/test_pipeline_rows.py compares run() with a chain of plain Python stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = Written(stage(spark, docs, sf_dir), f"pipeline-{name}").df
    return docs
