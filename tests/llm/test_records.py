import base64
import hashlib
import random
import zlib

import numpy as np
import pytest

from tests.llm.cases import LONG, TEXTS, by_text, documents
from tidewell.llm import chat, merkle, quality, warc


def test_loser_tree_merges_any_number_of_runs():
    rng = random.Random(0)
    for n in range(20):
        runs = [sorted(rng.randint(0, 30) for _ in range(rng.randint(0, 9))) for _ in range(n)]
        assert list(warc.LoserTree(runs, lambda x: x)) == sorted(x for run in runs for x in run)


PAGES = [
    (k, url, html)
    for k, (url, html) in enumerate(
        (url, html)
        for html in (None, "", "a\r\n\r\nb", "é\r\n\r\n", "WARC/1.1\r\n\r\n", "x" * 50_000, "a\r\n\r\nb")
        for url in (None, "http://a.b/x y\n", "https://Blog.Ex.com:80/p?q#f", "http://[bad", "é://ü")
    )
] + [(None, "u", "solo"), (None, "u", ""), (34, "again", "x"), (34, "again", "x")]


def pages(spark, rows=None):
    names = "page_id long, url string, html string, payload int, id string"
    return spark.createDataFrame([(*row, 1, "x") for row in (PAGES if rows is None else rows)], names).repartition(4)


@pytest.mark.parametrize("least", [0, 3])
def test_archives_read_back_as_written(spark, tmp_path, least):
    index = warc.archive_index(pages(spark), least, path=f"file://{tmp_path}/w").collect()
    newest = {}
    for i, _, html in PAGES:
        if i is not None:
            newest[html or ""] = max(newest.get(html or "", -1), i)
    want = []
    for i, _, html in PAGES:
        data = (html or "").encode()
        other = newest.get(html or "")
        revisit = len(data) >= least and other is not None and i != other
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        want.append((i, len(data), digest, "revisit" if revisit else "response", other if revisit else None))
    found = [(r.id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in index]
    assert by_text(found) == by_text(want)
    merged = sorted(index, key=lambda r: r.position)
    keys = [(r.url_key, r.date) for r in merged]
    assert keys == sorted(keys)
    texts = warc.read_archives(spark, f"file://{tmp_path}/w", keep_payload=True).where("record_type = 'response'").collect()
    sent = {(i, html or "") for i, _, html in PAGES}
    assert {(int(r.id) if r.id else None, r.payload) for r in texts} <= sent


def test_ranges_merge_like_one(spark):
    captures = warc.stored(warc.read_archives(spark, _written(spark)), "captures")
    whole = [tuple(r)[:-1] for r in warc.merge_captures(captures).orderBy("position").collect()]
    parts = [tuple(r)[:-1] for r in warc.merge_captures(captures, 5).orderBy("position").collect()]
    assert [row[5:7] for row in whole] == [row[5:7] for row in parts] and sorted(map(repr, whole)) == sorted(map(repr, parts))


def _written(spark, compression="gzip") -> str:
    path = warc.new_path(spark, "warc")
    rows = spark.createDataFrame([(k, f"http://h/{k % 3}", f"p{k}", k % 5) for k in range(40)], "id long, url string, payload string, seconds long")
    warc.write_archives(rows.repartition(6), path, compression=compression)
    return path


def test_packed_and_plain_files_read_alike(spark):
    found = []
    for compression in ("gzip", "none"):
        rows = warc.read_archives(spark, _written(spark, compression), keep_payload=True).drop("run", "place").collect()
        found.append(by_text(tuple(r) for r in rows))
    assert found[0] == found[1] and len(found[0]) == 40


def test_files_are_bounded_by_their_bytes(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "FILE_BYTES", 4000)
    monkeypatch.setattr(warc, "SIZES", (100, 1000, 1 << 31))
    rng = random.Random(2)
    rows = [(k, f"u{k}", "x" * rng.choice([0, 3, 90, 400, 999, 1500, 20_000]) + str(k)) for k in range(300)]
    index = warc.archive_index(pages(spark, rows).coalesce(1), path=f"file://{tmp_path}/w").collect()
    assert by_text((r.id, r.payload_bytes, r.record_type) for r in index) == by_text((k, len(t), "response") for k, _, t in rows)
    held = {}
    for r in index:
        held.setdefault(r.run, []).append(r.payload_bytes)
    assert all(sum(sizes) <= 4000 or len(sizes) == 1 for sizes in held.values()) and len(held) > 60


def test_no_pages(spark):
    assert warc.archive_index(pages(spark, [])).count() == 0


def test_base32(spark):
    from pyspark.sql import functions as F

    digests = [hashlib.sha1(bytes([k])).digest() for k in range(20)]
    got = spark.createDataFrame([(d.hex(),) for d in digests], "h string").select(warc.base32(F.col("h"))).collect()
    assert [r[0] for r in got] == [base64.b32encode(d).decode() for d in digests]


def test_leaves_make_up_the_text_and_lines_parse():
    for _, text in TEXTS:
        assert "".join(merkle.LEAF.findall(text or "")) == (text or "")
        tree = merkle.grow(text or "")
        assert merkle.parse(tree.line()) == tree
        assert sum(count for _, count in tree.sections) == len(tree.leaves)


def test_an_edit_is_located_and_moves_no_other_section():
    paragraphs = [f"Paragraph {k} speaks of {k * 7} things. It ends here with {k}.\n" for k in range(200)]
    old = merkle.grow("".join(paragraphs))
    paragraphs[100] = "Something else stands here now, and it is longer than what was here before.\n"
    new = merkle.grow("".join(paragraphs))
    assert old.root != new.root
    changed = merkle.changed_leaves(new, old)
    assert 1 <= len(changed) <= 4 and merkle.changed_leaves(new, new) == []
    assert len({d for d, _ in new.sections} - {d for d, _ in old.sections}) <= 2
    assert 0.97 < merkle.likeness(old, new) < 1 and merkle.likeness(old, old) == 1
    assert merkle.likeness(merkle.grow(""), old) == 0


def test_repeated_sections_that_go_or_move_are_located():
    def tree(*sections):
        leaves = tuple(leaf for section in sections for leaf in (section + "1", section + "2"))
        return merkle.Tree("-".join(sections), tuple((section, 2) for section in sections), leaves)

    assert merkle.changed_leaves(tree("s", "s"), tree("s")) == [2, 3]
    assert merkle.changed_leaves(tree("s"), tree("s", "s")) == []
    assert merkle.changed_leaves(tree("s", "a", "b", "s", "c"), tree("s", "a", "b", "c")) == [6, 7]
    assert merkle.changed_leaves(tree("s", "a", "b", "s", "c"), tree("s", "s", "a", "b", "c")) == [6, 7]
    assert merkle.changed_leaves(tree("s", "s", "a", "b", "c"), tree("s", "a", "b", "s", "c")) in ([0, 1], [2, 3])


def plain_edits(rows):
    ordered = sorted(rows, key=lambda row: (row[0] is None, -(row[0] or 0), row[1] or ""))
    out = []
    for k, (i, text) in enumerate(ordered):
        text, following = text or "", ordered[(k + 1) % len(ordered)][1] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        one, other, after = merkle.grow(text), merkle.grow(edited), merkle.grow(following)
        digest = hashlib.sha256(edited.encode()).hexdigest()
        likes = merkle.likeness(one, other), merkle.likeness(one, after)
        out.append((i, len(text), digest, one.line(), other.line(), *likes))
    return out


@pytest.mark.parametrize(
    "rows",
    [
        [(k * 3 % 50, f"doc {k}. " * k) for k in range(50)] + TEXTS + [(48, "x"), (0, "")],
        [(None, "a b"), (None, "c")], [(5, "only")], [(4, "a. b"), (4, "a. b")], [],
    ],
)
def test_fingerprint_edits(spark, monkeypatch, rows):
    monkeypatch.setattr(merkle, "RANGE_ROWS", 3)
    out = merkle.fingerprint_edits(documents(spark, rows)).collect()
    assert by_text(tuple(r) for r in out) == by_text(plain_edits(rows))
    lines = merkle.fingerprints(documents(spark, rows)).collect()
    assert by_text(tuple(r) for r in lines) == by_text((i, merkle.grow(t or "").line()) for i, t in rows)


LETTERS = ["\\", "###", "#", "</turn>", "<", "/turn>", " ", "a", "\n", ":", "é", "n"]


def random_turns(rng):
    role = lambda: "".join(rng.choice(LETTERS) for _ in range(3)) if rng.random() < 0.3 else rng.choice(["user", "assistant", ""])
    return [(role(), "".join(rng.choice(LETTERS) for _ in range(rng.randint(0, 9)))) for _ in range(rng.randint(0, 5))]


def test_the_template_can_be_undone():
    rng = random.Random(1)
    for _ in range(5000):
        turns = random_turns(rng)
        assert list(chat.read_turns(chat.turn_template(turns))) == turns


def test_spans_hold_the_texts_also_over_segments():
    rng = random.Random(2)
    for _ in range(200):
        turns = random_turns(rng) + random_turns(rng)
        renderer, output = chat.Renderer(chat.turn_template, segment=3), ""
        for role, text in turns:
            part, span = renderer.add((role, text))
            output += part
            assert output[span.start : span.stop] == part
            assert chat.unescape(output[span.text_start : span.text_stop]) == text
        assert output == chat.turn_template(turns) and not renderer.rewrites


def test_a_template_that_rewrites_history_is_found(spark):
    def last_only(turns):
        return "".join(f"[{r}]{t if r != 'assistant' or k == len(turns) - 1 else ''}" for k, (r, t) in enumerate(turns))

    rows = [(1, k, "assistant" if k % 2 else "user", f"t{k}") for k in range(6)] + [(2, 1, "user", "hi")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = chat.format_conversations(table, last_only).orderBy("id", "place").collect()
    assert [r.rewrites for r in out] == [False, False, True, True, True, True, False]
    assert [r.loss for r in out] == [False, True] + [False] * 5
    assert [r.start is None for r in out] == [r.rewrites for r in out]

    def counted(turns):  # depends on turns that a new segment no longer has
        return "".join(f"<{k}>{t}" for k, (_, t) in enumerate(turns))

    renderer = chat.Renderer(counted, segment=2)
    for k in range(5):
        renderer.add(("user", f"t{k}"))
    assert renderer.rewrites


def test_long_conversations_are_rendered_from_their_start(spark):
    def numbered(turns):
        return "".join(f"<{k} after {turns[max(k - 1, 0)][0]}>{t}" for k, (_, t) in enumerate(turns))

    def last_forty(turns):
        return "".join(f"[{r}]{t}" for r, t in turns[-40:])

    turns = [("assistant" if k % 2 else "user", f"t{k}") for k in range(100)]
    table = spark.createDataFrame([(1, k, *turn) for k, turn in enumerate(turns)], "conv_id long, turn long, role string, text string")
    out = chat.format_conversations(table, numbered).orderBy("place").collect()
    whole = numbered(turns)
    assert "".join(r.part for r in out) == whole and not any(r.rewrites for r in out)
    assert [whole[r.text_start : r.text_stop] for r in out] == [text for _, text in turns]
    assert [r.loss for r in out] == [role == "assistant" for role, _ in turns]
    out = chat.format_conversations(table, last_forty).orderBy("place").collect()
    assert [r.rewrites for r in out] == [False] * 40 + [True] * 60


CONVERSATIONS = [
    (1, 2, "assistant", "second"), (1, 1, "user", "first"), (1, 3, None, None), (1, None, "assistant", "zeroth"),
    (2, 1, "assistant", ""), (2, 1, "assistant", "tie"), (2, 1, "assistant", "tie"), (None, 1, "assistant", LONG),
    (None, 2, "user", "\\### Assistant: </turn> ok"), (3, 1, "assistant", "\\### Assistant: </turn> ok"),
] + [(4, k, "assistant" if k % 2 else "user", f"turn {k} \\ </turn>") for k in range(150)]


def test_digests_are_read_back(spark):
    names = "conv_id long, turn long, role string, text string, id int, part string"
    table = spark.createDataFrame([(*row, 1, "x") for row in CONVERSATIONS], names).repartition(4)
    out = chat.conversation_digests(chat.format_conversations(table)).collect()
    want = []
    for conv in (None, 1, 2, 3, 4):
        rows = sorted(
            (turn is not None, turn or 0, role or "", text or "") for i, turn, role, text in CONVERSATIONS if i == conv
        )
        turns = [(role, text) for *_, role, text in rows]
        said = "".join(f"{role}\n{text}\n" for role, text in turns)
        loss = "".join(text for role, text in turns if role == "assistant")
        digests = hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()
        want.append((conv, len(turns), *digests, len(chat.turn_template(turns)), False))
    assert by_text(tuple(r) for r in out) == by_text(want)
    assert chat.conversation_digests(chat.format_conversations(table.where("false"))).count() == 0


def written(rng, junk):
    words = ["".join(rng.choice("abcdefghiklmnoprstu") for _ in range(rng.randint(2, 8))) for _ in range(rng.randint(30, 90))]
    return " ".join(word.upper() + "!!" for word in words) if junk else " ".join(words).capitalize() + "."


def labelled(spark, n=600):
    rng = random.Random(4)
    junk = [rng.random() < 0.2 for _ in range(n)]
    rows = [(k, written(rng, junk[k])) for k in range(n)]
    labels = [(k, int(not junk[k]), 0) for k in range(0, n, 2)] + [(None, 1, 0), (3, None, 0)]
    return junk, rows, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_classifier_tells_held_out_texts_apart(spark):
    junk, rows, labels = labelled(spark)
    docs = documents(spark, rows + TEXTS[2:])
    model = quality.train(docs, labels)
    out = quality.classify(docs, model).collect()
    assert len(out) == len(rows) + len(TEXTS) - 2
    own = {r.id: r for r in out if r.id is not None and r.id > 9}
    for k, row in own.items():
        assert row.held_out == (zlib.crc32(str(k).encode()) % 3 == 1)
    held = [(row.predicted == (not junk[k])) for k, row in own.items() if row.held_out]
    assert len(held) > 100 and np.mean(held) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in out)
    assert abs(model.prior - np.mean([not junk[k] for k in range(0, 600, 2) if zlib.crc32(str(k).encode()) % 3 != 1])) < 0.01
    assert quality.classify(docs.where("false"), model).count() == 0


def test_positives_are_drawn_from_those_that_have_a_text(spark, monkeypatch):
    _, rows, _ = labelled(spark)
    labels = spark.createDataFrame([(k, 1, 0) for k in range(50_000)], "doc_id long, quality int, toxic int")
    taken = []
    monkeypatch.setattr(quality, "fit", lambda positive, unlabelled, prior: taken.append(len(positive)))
    quality.train(documents(spark, rows), labels, positives=150, unlabelled=10)
    assert taken == [150]


def test_held_out_labels_are_never_read(spark):
    _, rows, labels = labelled(spark, 200)
    docs = documents(spark, rows)
    flipped = labels.withColumn("quality", quality.F.when(quality.held_out("doc_id"), 0).otherwise(labels.quality))
    one, other = quality.train(docs, labels), quality.train(docs, flipped)
    assert np.array_equal(one.weights, other.weights) and one.bias == other.bias


def test_without_labels_every_text_scores_the_prior(spark):
    _, rows, labels = labelled(spark, 20)
    model = quality.train(documents(spark, rows), labels.where("false"), prior=0.7)
    assert {round(r.score, 6) for r in quality.classify(documents(spark), model).collect()} == {0.7}


def test_the_risk_is_never_negative():
    rng = np.random.default_rng(0)
    good, bad = rng.normal(1, 1, (200, 4)).astype("f4"), rng.normal(-1, 1, (100, 4)).astype("f4")
    model = quality.fit(good[:100], np.concatenate([good[100:], bad]), 0.5)
    assert np.isfinite(model.weights).all()
    assert (model.score(good) > 0.5).mean() > 0.9 > 0.1 > (model.score(bad) > 0.5).mean()


def test_scores_do_not_depend_on_the_other_columns(spark):
    _, rows, labels = labelled(spark, 60)
    docs = documents(spark, rows)
    model = quality.train(docs, labels)
    scored = quality.with_score(docs, model, "own.score")
    assert scored.columns == [*docs.columns, "own.score"] and scored.count() == 60
