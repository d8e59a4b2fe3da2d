"""A training-corpus pipeline of five stages over `documents`.

Each stage reads all that its predecessor kept, from Parquet, and all but the last return the
columns of `documents`:

1. language ID: documents whose language cannot be told (`und`) are rejected;
2. exact dedup: of texts that are equal after lower-casing A-Z the largest doc_id stays;
3. n-gram Jaccard join: one document of each group of near duplicates stays (the least doc_id);
4. mixing: sources are brought to their target weights; a document taken twice comes twice;
5. packing: sequences of at most 2048 tokens, one row per piece.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from folioforge.llm import bfd_packing, language_id, lsh_forest, lsm_dedup, pareto_mix
from folioforge.llm.common import fold, stored, table


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose language can be told, in their own columns.

    Null and empty texts and texts without a letter go; null ids and null languages are no reason to
    go; repeated rows are judged each; without any learned language all rows go; an empty table stays.
    """
    model = language_id.train(docs.where(fold("doc_id", 5) != 0).select("doc_id", "text", "lang"))
    return language_id.predict(docs, model).where(f"_lang_pred <> '{language_id.UNKNOWN}'").select(*docs.columns)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row for each text that is equal after lower-casing A-Z: the one with the largest doc_id.

    Null counts as the empty text; a null id stays only if no equal text has an id; of rows that repeat
    id and text one stays; an empty table stays.
    """
    return lsm_dedup.distinct_rows(docs, keep="max")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row for each class of near copies: that of the least doc_id; texts without words all stay.

    Rows are told apart by id and words: another text under the id of a near copy stays, of near copies
    without ids one stays, and of rows that repeat id and words one stays; an empty table stays.
    """
    return lsh_forest.one_of_each(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows that the mix takes, as often as it takes them (twice at most).

    Null sources are a source; null and repeated ids have copies of their own, row by row; texts
    without words come only as whole copies of their source; an empty table stays.
    """
    return pareto_mix.mix_rows(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all rows in sequences; a row that comes twice is packed twice, a null text is the end id."""
    return bfd_packing.pack(docs, bfd_packing.default_tokenizer())


STAGES = [
    ("language_id", identify_language),
    ("exact_dedup", drop_exact_copies),
    ("ngram_jaccard_join", drop_near_copies),
    ("mix_sources", mix_sources),
    ("packing", pack_sequences),
]

#: Language identification and tokenisation are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs, name)
    return docs
