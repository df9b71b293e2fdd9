"""Row-local text functions as Spark columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Cell texts that stand for a missing value.
INVALID_TOKENS = ("", "na", "n/a", "null", "none", "nan", "undefined")

# The five roles.
ROLES = ("ceo", "admin", "data_analyst", "sales_manager", "sector_head")

# Keyword to data request, first match wins.
QUERY_INTENTS = (
    (("trend",), "trend_analysis"),
    (("forecast", "predict"), "forecasting"),
    (("risk",), "risk_analysis"),
    (("compare", "ranking"), "sector_comparison"),
)

# Keyword to chat topic, first match wins.
CHAT_TOPICS = (
    (("upload", "dataset"), "uploads"),
    (("clean", "algorithm", "quality"), "cleaning"),
    (("visual", "graph", "chart"), "visualizations"),
    (("report",), "reports"),
)

# Unicode white space, as characters to trim and as a pattern class.
SPACES = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B)))
    + "\u2028\u2029\u202f\u205f\u3000"
)
SPACE_CLASS = r"\p{Z}\x09-\x0d\x1c-\x1f\x85"
SECTOR_MARK = "__sector__"


def strip(column: Column) -> Column:
    """Trim Unicode white space on both ends."""
    return F.trim(column, F.lit(SPACES))


def clean_text(column: Column) -> Column:
    """Lower case, keep only letters, digits, underscore and white space, then trim. Null stays null."""
    return strip(F.regexp_replace(F.lower(column), rf"[^\p{{L}}\p{{N}}_{SPACE_CLASS}]", ""))


def is_invalid_token(column: Column) -> Column:
    return F.lower(strip(column)).isin(*INVALID_TOKENS)


def sector_key(column: Column) -> Column:
    """A key made of ``[a-z0-9_]``; null and empty become ``unknown``."""
    key = F.regexp_replace(F.lower(strip(column)), "[^a-z0-9]+", "_")
    return F.coalesce(F.nullif(F.regexp_replace(key, "^_+|_+$", ""), F.lit("")), F.lit("unknown"))


def sector_label(algorithm: Column) -> Column:
    """The sector part of a variant's algorithm name, ``all`` for the whole result."""
    return F.when(
        algorithm.contains(SECTOR_MARK), F.regexp_extract(algorithm, rf"^.*?{SECTOR_MARK}((?s:.*))$", 1)
    ).otherwise("all")


def normalise_role(column: Column) -> Column:
    """One of the five roles, or empty when unknown."""
    role = F.translate(F.lower(strip(F.coalesce(column, F.lit("")))), "- ", "__")
    return F.when(role.isin(*ROLES), role).otherwise("")


def company_code(column: Column) -> Column:
    """The number in ``company_<number>``; null when the text has another form."""
    digits = F.regexp_extract(strip(column), r"(?i)^company_(\d+)$", 1)
    return F.nullif(digits, F.lit("")).try_cast("int")


def first_keyword(column: Column, table, default: str) -> Column:
    """The label of the first entry with a keyword inside the lower-cased text."""
    lowered = F.lower(column)
    tag = None
    for words, label in table:
        hit = lowered.contains(words[0])
        for word in words[1:]:
            hit = hit | lowered.contains(word)
        tag = F.when(hit, label) if tag is None else tag.when(hit, label)
    return tag.otherwise(default)


def query_intent(column: Column) -> Column:
    return first_keyword(column, QUERY_INTENTS, "help")


def chat_topic(column: Column) -> Column:
    return first_keyword(column, CHAT_TOPICS, "help")
