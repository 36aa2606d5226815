"""A corpus pipeline: raw documents in, packed token sequences out.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and
read again as the next stage's docs.  All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docframe.functions.names import fresh
from docframe.llm import langid, mixing, packing, quality, queries, simhash
from docframe.llm.common import materialize, table

#: Near copies: shingles of so many words, alike by so much.
SHINGLE_WORDS, LEAST_LIKENESS = 5, 0.8


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter, null texts, and those that no learned language fits.

    If no document has a language to learn from, only texts without a letter go.  Repeated rows and
    null ids are judged like any other; an empty table stays empty.
    """
    model = langid.learn(docs)
    if not model.languages:
        return docs.where(F.col("text").rlike("\\p{L}"))
    lang, score, fits = fresh(docs.columns, "lang", "score", "fits")
    return langid.classify(docs, model, (lang, score, fits)).where(F.col(fits)).select(docs.columns)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose probability of good quality is below one half.

    Null and empty texts have that of a text without words.  Equal texts go or stay together,
    repeated rows too; without labels all stay.  An empty table stays empty.
    """
    scorer = quality.learn(docs, table(spark, sf_dir, "labels"))
    (score,) = fresh(docs.columns, "quality")
    return quality.classify(docs, scorer, score).where(F.col(score) >= 0.5).select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of the smallest doc_id of every class of texts whose five-word shingles are alike by 0.8 or more.

    Null, empty and blank texts are one class.  Of rows that repeat a doc_id one stays; rows without
    an id stay.  An empty table stays empty.
    """
    return simhash.keep_one(docs, LEAST_LIKENESS, SHINGLE_WORDS)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Puts all documents in the order of the mix; each file is one stretch of it.

    Null sources are a source of their own; texts do not matter.  Rows that repeat a doc_id and source stand
    side by side.  An empty table stays empty.
    """
    return mixing.in_order(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the documents, in the order of the mix, into sequences of 2048 tokens.

    A scan takes files by size, so the order is made again: equal documents have equal places.
    Null texts are empty; repeated rows and null ids are packed like any other.  An empty table
    gives no pieces.
    """
    return packing.pack_documents(mixing.in_order(docs), queries.tokenizer_path("word_bpe_49k.json"))


STAGES = [
    ("language_id", language_id),
    ("quality_classifier", quality_classifier),
    ("near_duplicates", near_duplicates),
    ("source_mix", source_mix),
    ("packing", pack),
]

#: Trained models and tokenizers have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
