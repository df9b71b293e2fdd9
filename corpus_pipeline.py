"""From raw documents to packed training sequences, in four stages.

Each stage takes (spark, docs, sf_dir) and returns documents with the columns it was given, the last one the pieces of
packed sequences. ``run`` writes every stage's result to the shared folder and reads it again for the next.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.llm import packing, quality, simhash, substring_dedup
from tidewell.llm.common import named, stored
from tidewell.sources.dataset import Dataset

SCORE = "score of the quality classifier"  # no table has a column of this name


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject, unchanged."""
    model = quality.train(docs, Dataset(spark, sf_dir).table("labels"), positives=3000, unlabelled=6000)
    return quality.with_score(docs, model, SCORE).where(named(SCORE) >= 0.5).drop(SCORE)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity 0.8 or more), unchanged."""
    return simhash.similar_rows(docs, shingle=5)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the 35-word windows that occur elsewhere too; those that lose nothing keep their text as it is.

    A document that loses all its words stays, with an empty text. ``n_chars`` follows the text.
    """
    inner = {name: f"c{k}" for k, name in enumerate(docs.columns)}  # no column can clash with the operator's own
    rows = docs.select(*[named(name).alias(alias) for name, alias in inner.items()])
    identity, text = inner["doc_id"], inner["text"]
    rest = [alias for alias in inner.values() if alias != identity]
    found = substring_dedup.remove_repeats(rows, window=35, id_column=identity, text_column=text, carry=rest)
    kept = F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col(text))
    values = {
        **inner, "doc_id": F.col("id"), "text": kept, "n_chars": F.coalesce(F.length(kept), F.lit(0)).cast("bigint")
    }
    return found.select(*[F.col(v).alias(n) if isinstance(v, str) else v.alias(n) for n, v in values.items()])


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document in sequences of at most 2048 tokens: one row per piece, with its token ids."""
    path = public_tokenizers.path("word_bpe_49k.json")
    return packing.pack_documents(docs, path, 2048, 0, keep_ids=True).withColumnRenamed("id", "doc_id")


STAGES = [
    ("quality classifier", keep_quality),
    ("SimHash near-dedup", drop_near_copies),
    ("substring dedup", cut_repeats),
    ("best-fit packing", pack),
]

ORACLE_SQL = None  # classifier scores, fingerprints and token ids have no SQL form


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = Dataset(spark, sf_dir).table("documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
