"""Keywords beside a plain count, with common terms broadcast and the others joined."""

import math
from collections import Counter

import pytest

from tidewell.operators import keywords

TEXTS = [
    (1, "en", "the cat and the dog saw one cat"), (2, "en", "the dog ran"), (3, None, "the cat lone word"), (3, None, "lone cat"),
    (4, "en", None), (5, "de", "der Hund und der Kater"), (6, "de", "Hund Kater Maus Maus"), (7, "en", "cat dog bird bird fish"),
    (8, "en", "oak elm ash"), (9, "en", "oak yew fir"), (10, "en", "ivy fern moss"), (11, "en", "oak moss"), (12, "en", "elm"),
]


def plain(n: int):
    uses = Counter((k, lang, w) for k, lang, text in TEXTS for w in (text or "").lower().split() if len(w) >= 3)
    texts = Counter((lang, w) for _, lang, w in uses)
    all_ = Counter(lang for _, lang in {(k, lang) for k, lang, _ in uses})
    found = {}
    for (k, lang, w), u in uses.items():
        if texts[lang, w] / all_[lang] < keywords.STOP_SHARE:
            found.setdefault(k, []).append((-round(u * math.log((all_[lang] + 1) / (texts[lang, w] + 1)), 9), w, u))
    return {k: [(w, u, -m) for m, w, u in sorted(rows)[:n]] for k, rows in found.items()}


@pytest.mark.parametrize("common", [1, 8, 1000])
def test_keywords_need_no_shuffle_of_common_terms(spark, monkeypatch, common):
    monkeypatch.setattr(keywords, "COMMON_TERMS", common, raising=False)
    df = spark.createDataFrame(TEXTS, "id long, lang string, text string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = keywords.keywords(df, "id", "text", 2, "lang")
        plan = found._jdf.queryExecution().executedPlan().toString()
        got = {}
        for r in sorted(found.collect(), key=lambda r: (r["id"], -r["weight"], r["term"])):
            got.setdefault(r["id"], []).append((r["term"], r["uses"], pytest.approx(r["weight"], abs=1e-8)))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert plain(2) == got and len(got) > 5
    assert plan.count("BroadcastHashJoin") >= 2
