"""A training-data pipeline over ``documents``: five stages, each one corpus operator.

Every stage takes all rows that the one before kept.  The first four return the
columns of ``documents``; the last returns packed pieces.

Defined results, for each stage: an empty table gives none, columns beside ``doc_id``,
``text``, ``lang``, ``source`` and ``n_chars`` pass through whatever their names, and

* quality rules: a null or empty text goes; a null language, or none in the table, is
  judged by the text's script; rows that repeat are judged alike.
* n-gram Jaccard: of rows that tie, repeats included, the first by id and text stays,
  null ids before others; texts without words all stay.
* suffix array: a null text stays null; a text that repeats as a whole goes at every
  place; rows that repeat an id are documents of their own.
* secret scan: a null or empty text stays as it is, a null source is no path; very long
  secrets are masked whole.
* packing: a null text is empty and holds the end id alone; rows that repeat, null ids
  included, are packed each; a text of any length is cut into full sequences.
"""

from __future__ import annotations

import public_tokenizers as tokenizers_of
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm import jaccard, packing, quality, secrets, suffix
from palimpsest.llm.common import checkpointed, table
from palimpsest.llm.queries import FERTILITY_VOCABULARIES


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or the fertility bands go."""
    return quality.kept_documents(docs, FERTILITY_VOCABULARIES, tokenizers_of.PATTERN)


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five words, similarity 0.8 or more) the first stays."""
    return jaccard.one_of_each(docs, k=5, num=80, den=100)


def suffix_array(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings of 200 bytes or more that repeat anywhere are cut out; documents left empty go."""
    return suffix.deduped_documents(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked in the texts."""
    vocabulary = tokenizers_of.path("byte_bpe_50k.tiktoken")
    return secrets.masked_documents(docs, secrets.default_forest(vocabulary), vocabulary)


def sequence_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of all documents, packed into sequences."""
    pieces = packing.token_pieces(docs, tokenizers_of.path("word_bpe_49k.json"))
    return packing.pack(pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids"), docs.count())


STAGES = [
    ("quality_rules", quality_rules),
    ("ngram_jaccard", ngram_jaccard),
    ("suffix_array", suffix_array),
    ("secret_scan", secret_scan),
    ("sequence_packing", sequence_packing),
]

#: Tokenizers, forests and suffix arrays have no SQL form; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = checkpointed(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
