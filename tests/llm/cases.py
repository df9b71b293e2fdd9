"""Small tables that hold the awkward cases: nulls, empty and long texts, ties, repeated rows, clashing names."""

from __future__ import annotations

import random

LONG = ("wort " * 3 + "naïve 12,5% — 'twas\t\n\n  x ") * 400

TEXTS = [
    (1, "Hello world, it's 12 o'clock."),
    (2, "Hello world, it's 12 o'clock."),
    (3, None),
    (4, ""),
    (5, " \n\t  "),
    (6, LONG),
    (7, "a" * 3000),
    (8, "ab" * 900 + " " * 300 + "ß İ Σίσυφος 日本語 🙂 ▁▁ \x1c\x85　é"),
    (9, "<|endoftext|> </s> <unk> <|STARTOFTEXT|>"),
    (9, "another text of the same id"),
    (9, "another text of the same id"),
    (None, "no id"),
    (None, None),
]


def documents(spark, rows=None, parts: int = 3):
    """``rows`` of (doc_id, text) beside columns whose names the operators use themselves."""
    rows = TEXTS if rows is None else rows
    full = [(i, t, "clash", n, 0.5, "x", [n]) for n, (i, t) in enumerate(rows)]
    names = "doc_id long, text string, id string, n_tokens long, score double, kept string, ids array<int>"
    return spark.createDataFrame(full, names).repartition(parts)


def random_texts(seed: int, letters: str, count: int, words: int) -> list[str]:
    rng = random.Random(seed)
    return [" ".join(rng.choice(letters) for _ in range(rng.randint(0, words))) for _ in range(count)]


def by_text(rows) -> list:
    return sorted(rows, key=repr)
