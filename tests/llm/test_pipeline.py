import random
import zlib

import numpy as np
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from tests.llm.cases import by_text, documents
from tests.llm.test_copies import plain_repeats
from tidewell.llm.common import stored
from tidewell.llm.queries import LLM_ORACLES, LLM_QUERIES
from tidewell.sources.dataset import Dataset

FOLDER = "/root/testdata/sf0.001"

COLUMNS = {
    "op1_byte_bpe": "doc_id n_tokens ids_sha256 decoded_sha256",
    "op2_simhash": "doc_id fingerprint component_id",
    "op3_token_counts": "doc_id n_bytes n_tokens over_limit",
    "op4_warc": "page_id payload_bytes payload_digest record_type refers_to",
    "op5_merkle_fingerprint": "doc_id n_chars edited_sha256 fingerprint edited_fingerprint near_edited near_next",
    "op6_substring_dedup": "doc_id n_words n_removed kept_sha256",
    "op7_embedding_join": "vec_id n_links component_id kept",
    "op8_chat_format": "conv_id n_turns turns_sha256 loss_chars loss_sha256 formatted_chars",
    "op9_best_fit_packing": "doc_id piece start length ids_crc32 sequence_id offset",
    "op10_quality_classifier": "doc_id held_out score predicted",
    "op11_structure_repair": "conv_id gaps blank duplicate truncated illegal cost audit repaired_sha256",
    "op12_whitening": "vec_id component n deviation whitened explained identity_error",
    "op13_stratified_shards": "doc_id size text_crc32 law shard slot grown_shard",
}


@pytest.mark.parametrize("name", COLUMNS)
def test_queries_return_a_row_for_each_input(spark, name):
    out = entry.queries()[name](spark, FOLDER)
    assert out.columns[: len(COLUMNS[name].split())] == COLUMNS[name].split()
    data = Dataset(spark, FOLDER)
    tables = {"op4": "pages", "op7": "embeddings", "op8": "conversations", "op11": "conversations", "op12": "embeddings"}
    table = tables.get(name.split("_")[0], "documents")
    key = out.columns[0]
    want = {r[0] for r in data.table(table).select(key).collect()} | ({-7} if name.startswith("op8") else set())
    found = [r[0] for r in out.select(key).collect()]
    assert set(found) == want and (len(found) == len(want) or name.startswith(("op9", "op12")))


def test_registered():
    assert set(LLM_QUERIES) == set(COLUMNS) and set(LLM_ORACLES) <= set(LLM_QUERIES)
    assert "pipeline" in entry.queries() and len(corpus_pipeline.STAGES) == 4


def corpus(rng):
    """Prose, junk, near copies and a passage that documents share; (doc_id, text, kind)."""
    word = lambda: "".join(rng.choice("abcdefghiklmnoprstu") for _ in range(rng.randint(3, 8)))
    prose = lambda n: [word() for _ in range(n)]
    passage = prose(50)
    rows = []
    for _ in range(240):
        rows.append((" ".join(prose(rng.randint(60, 150))).capitalize() + ".\nNext line.", "clean"))
    for _ in range(60):
        rows.append((" ".join(w.upper() + "!!" for w in prose(rng.randint(60, 150))), "junk"))
    for k in range(8):
        body = prose(70)
        rows.append((" ".join(body[:35] + passage + body[35:]), "passage"))
    for k in range(6):
        body = prose(200)
        rows.append((" ".join(body), "clean"))
        for copy in range(3):
            other = list(body)
            other[rng.randrange(200)] = word()
            rows.append((" ".join(other), "copy"))
    return [(k, text, kind) for k, (text, kind) in enumerate(rows)]


def test_stages(spark, tmp_path):
    rows = corpus(random.Random(8))
    docs = spark.createDataFrame([(k, t, "en", "src0", len(t)) for k, t, _ in rows], Dataset(spark, FOLDER).table("documents").schema)
    labels = spark.createDataFrame([(k, int(kind != "junk"), 0) for k, _, kind in rows], "doc_id long, quality int, toxic int")
    folder = f"file://{tmp_path}"
    labels.write.parquet(f"{folder}/labels.parquet")
    docs.repartition(3).write.parquet(f"{folder}/documents.parquet")
    now = spark.read.parquet(f"{folder}/documents.parquet")
    kinds = {k: kind for k, _, kind in rows}
    text = {k: t for k, t, _ in rows}
    for name, stage in corpus_pipeline.STAGES:
        before = now
        now = stored(stage(spark, before, folder), "stage")
        if name == "best-fit packing":
            break
        assert now.columns == docs.columns and now.dtypes == docs.dtypes
        ids = {r.doc_id for r in now.collect()}
        if name == "quality classifier":
            assert np.mean([k in ids for k, kind in kinds.items() if kind != "junk"]) > 0.98
            assert np.mean([k in ids for k, kind in kinds.items() if kind == "junk"]) < 0.1
            assert all(r.text == text[r.doc_id] for r in now.collect())
        elif name == "SimHash near-dedup":
            there = {r.doc_id for r in before.collect()}
            assert all(k in ids for k in there if kinds[k] in ("clean", "passage"))
            assert not any(k in ids for k in there if kinds[k] == "copy" and all(k - d in there for d in (1, 2, 3)))
        else:
            sent = before.collect()
            want = []
            for r, (_, gone, kept) in zip(sent, plain_repeats([r.text for r in sent], 35)):
                left = kept if gone else r.text
                want.append((r.doc_id, left, "en", "src0", len(left)))
            assert by_text(tuple(r) for r in now.collect()) == by_text(want)
            assert all(len(r.text.split()) == 70 for r in now.collect() if kinds[r.doc_id] == "passage")
    assert {r.doc_id for r in now.collect()} == ids
    whole = corpus_pipeline.run(spark, folder)
    keys = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert by_text(whole.select(keys).collect()) == by_text(now.select(keys).collect())


def test_packed_sequences_hold_their_token_ids(spark):
    out = corpus_pipeline.pack(spark, documents(spark), FOLDER).collect()
    assert out and all(len(r.ids) == r.length and zlib.crc32(np.array(r.ids, "i4").tobytes()) == r.ids_crc32 for r in out)


def test_stages_take_awkward_rows(spark):
    """Nulls, empty and repeated rows: what each stage keeps of them, row by row."""
    given = documents(spark).select("doc_id", "text", "id", "score").withColumn("n_chars", corpus_pipeline.F.lit(0).cast("bigint"))
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, given.where("false"), FOLDER).collect() == []
        rows = [tuple(r) for r in given.collect()]
        out = [tuple(r) for r in stage(spark, given, FOLDER).collect()]
        if name == "quality classifier":
            assert not set(out) - set(rows) and len(out) <= len(rows)
        elif name == "SimHash near-dedup":
            sets = {}
            for row in rows:
                key = " ".join((row[1] or "").lower().split(" ")) if (row[1] or "").strip() else ""
                if key not in sets or (row[0] is None, row[0] or 0) < (sets[key][0] is None, sets[key][0] or 0):
                    sets[key] = row
            assert {(r[0], r[1] or "") for r in out if r[0] is not None} <= {(r[0], r[1] or "") for r in rows}
            assert len(out) == len(sets)
        elif name == "substring dedup":
            want = []
            for row, (_, gone, kept) in zip(rows, plain_repeats([r[1] for r in rows], 35)):
                text = kept if gone else row[1]
                want.append((row[0], text, *row[2:4], len(text or "")))
            assert by_text(out) == by_text(want)
        else:
            assert sorted(set(map(repr, (r[0] for r in out)))) == sorted(set(map(repr, (r[0] for r in rows))))
