"""From raw documents to packed training sequences: five stages, each an operator of flowquarry.llm.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; its rows are written as Parquet and read again as
the next stage's docs.

Defined cases, in every stage: repeated rows are rows of their own, and very long texts are worked on whole; an empty
table gives an empty one; columns beside doc_id, text, lang, source and n_chars go along unchanged up to the last
stage, whatever their names, and the last stage reads doc_id and text only. What a stage does with nulls, empty texts
and ties is said with the stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from flowquarry.llm import language_id, mixing, packing, simhash, substring_index
from flowquarry.llm.common import saved, table


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is found with a score of 0.5 or more.

    Null texts, empty texts and texts without a letter have no language and go, as do all texts where no row has a
    lang to learn from. A tie between languages goes to the first by code point. Null ids and sources stay.
    """
    return language_id.keep_identified(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near-duplicates.

    Null and wordless texts are near-duplicates of each other. Rows that share the smallest id of a group, and rows
    with a null id, all stay.
    """
    return simhash.keep_one_of_each(docs)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that an earlier one has; those with nothing left go.

    Texts that lose nothing, null and empty ones among them, stay as they are. Rows of one id take nothing from each
    other, and rows with a null id neither lose nor take. n_chars follows the text.
    """
    return substring_index.strip_repeats(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often, as far and in the order that the mix takes them.

    Null and wordless texts have no words to take and go. A null source is a source of its own. Documents with the
    same place in their source's order, those with one id, follow each other by size.
    """
    return mixing.mix(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents and the sequences that they make.

    Null and empty texts are their end token alone. Rows of one id, such as repeats, are packed each on its own, and
    rows with a null id come first.
    """
    return packing.pack(docs)


STAGES = [
    ("language_id", identify_language),
    ("simhash_near_dedup", drop_near_duplicates),
    ("substring_dedup", drop_repeated_passages),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Tokenizing is beyond SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir), name)
    return docs
