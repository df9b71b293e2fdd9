"""Terms that tell a text from the others of its language."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.functions.columns import col
from tidewell.operators.ranking import top_n_per_key
from tidewell.session import materialise

STOP_SHARE = 0.25  # a term in at least this share of a language's texts says nothing about one of them
SHORTEST = 3
COMMON_TERMS = 300_000  # terms that are sent to all tasks, most common first


def term_counts(df: DataFrame, key: str, text: str, language: str | None = None, shortest: int = SHORTEST) -> DataFrame:
    """(key, lang, term, uses): how often each text uses each of its terms; a null text has none.

    Terms of one text sit in one task, so they combine before the shuffle.
    """
    words = F.split(F.lower(col(text)), r"[^\p{L}\p{N}_]+")
    lang = col(language) if language else F.lit("")
    terms = df.select(col(key).alias("key"), lang.alias("lang"), F.explode(words).alias("term"))
    return terms.where(F.length("term") >= shortest).groupBy("key", "lang", "term").agg(F.count(F.lit(1)).alias("uses"))


def document_frequencies(counted: DataFrame) -> DataFrame:
    """(lang, term, texts, share, stop): in how many texts of its language a term occurs, from one pass over them."""
    sizes = counted.groupBy("lang").agg(F.count_distinct("key").alias("all")).withColumnRenamed("lang", "of")
    found = counted.groupBy("lang", "term").agg(F.count(F.lit(1)).alias("texts"))
    share = F.col("texts") / F.col("all")
    joined = found.join(sizes, F.col("lang").eqNullSafe(F.col("of"))).drop("of")
    return joined.withColumns({"share": share, "stop": share >= STOP_SHARE})


def keywords(
    df: DataFrame, key: str, text: str, n: int = 5, language: str | None = None, shortest: int = SHORTEST
) -> DataFrame:
    """(key, term, uses, weight): the n terms of each text with the highest weight, ties by term.

    The weight is the number of uses times the logarithm of how many texts of the language there are for one that has the
    term. Terms of a quarter of a language's texts or more are its stop words and left out: they are learned, so they need
    no list. Frequencies of common terms are broadcast, only rows of the others meet theirs in a shuffle.
    """
    counted = materialise(term_counts(df, key, text, language, shortest))  # read for the corpus and for the texts
    frequencies = materialise(document_frequencies(counted))
    # Terms in this many texts or more are COMMON_TERMS at most, and make up nearly all rows: these need no shuffle.
    often = (frequencies.agg(F.sum("texts")).first()[0] or 0) // COMMON_TERMS + 1
    same = [F.col("lang").eqNullSafe(F.col("of")), F.col("term") == F.col("word")]
    looked_up = frequencies.select(F.col("lang").alias("of"), F.col("term").alias("word"), "texts", "all", "stop")
    common = F.broadcast(looked_up.where(F.col("texts") >= often))
    rare = counted.join(common, same, "left_anti").join(looked_up.where(F.col("texts") < often), same)
    weight = F.col("uses") * F.log((F.col("all") + 1) / (F.col("texts") + 1))
    weighed = counted.join(common, same).unionByName(rare).where("NOT stop")
    weighed = weighed.select("key", "term", "uses", F.round(weight, 9).alias("weight"))
    best = top_n_per_key(weighed, ["key"], [F.desc("weight"), F.asc("term")], n)
    return best.select(F.col("key").alias(key), "term", "uses", "weight")


def stop_words(df: DataFrame, key: str, text: str, language: str | None = None) -> DataFrame:
    """(lang, term, texts): the learned stop words of each language."""
    return document_frequencies(materialise(term_counts(df, key, text, language))).where("stop").select("lang", "term", "texts")
