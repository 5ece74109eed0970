"""The corpus pipeline: five stages from raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before kept; its result is written
as Parquet and read again as the next stage's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from murkwater.llm import bpe, jaccard, langid, packing, quality, substring
from murkwater.llm.shared import written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules' votes keep; those that fail the base rules go too."""
    return quality.kept(docs.select(COLUMNS))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised: some letters, and a posterior of at least one half.

    If there is no labelled document to learn a language from, all documents with letters. A null text has
    none and goes; repeated rows are judged alike; a null doc_id makes no difference.
    """
    model = langid.fit(docs)
    if not model.languages:
        return docs.select(COLUMNS).where(F.col("text").rlike(r"\p{L}"))
    return langid.identify(docs.select(COLUMNS), model).where("lang_pred <> 'und' and score >= 0.5").select(COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of least doc_id of each group that links of at least 0.8 connect.

    Rows without doc_id stay, as do all rows of a doc_id that stays.
    """
    docs = docs.select(COLUMNS)
    kept = jaccard.jaccard_classes(docs.select("doc_id", "text")).where("doc_id = component_id").select(F.col("doc_id").alias("kept_id")).distinct()
    return docs.join(kept, F.col("doc_id") == F.col("kept_id"), "left_semi").union(docs.where("doc_id is null"))


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the words that repeated 13-word windows cover; a text that loses none stays as it is.

    A document of which nothing is left goes, one without words too. Rows without doc_id keep all words.
    """
    cut = substring.remove_duplicate_spans(docs.select(COLUMNS), as_they_are=True)
    kept = cut.where("n_words > n_removed").withColumn("n_chars", F.length("text").cast("long"))
    return kept.select(COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 1024 tokens, with their tokens.

    A null or empty text is the end token alone; each repeated row is packed; a null doc_id stays null.
    """
    path = public_tokenizers.path("byte_bpe_50k.json")
    vocabulary, added = bpe.Vocabulary.of_json(path)
    return packing.pack(docs, vocabulary, added, path, most=1024)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("substring_dedup", substring_dedup),
    ("pack", pack),
]

#: SQL can't fit the vote model or the language model, nor encode tokens: tests compare with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder before the next; the last stage's rows."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
