"""Each registered query over its whole table against plain computations, and texts larger than every part size."""

import base64
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import tiktoken
from tokenizers import Tokenizer

import corpus_pipeline
from tests.llm.cases import by_text, documents
from tests.llm.test_copies import Groups, plain_print, plain_repeats, plain_vectors
from tests.llm.test_records import plain_edits
from tidewell.llm import byte_bpe, embedding_join, merkle, packing, quality, simhash, substring_dedup, token_counts, warc
from tidewell.llm.queries import LLM_QUERIES

SF = "/root/testdata/sf0.001"
RANKS, PIECES, WORDS = (
    public_tokenizers.path(name) for name in ("byte_bpe_50k.tiktoken", "piece_bpe_32k.model", "word_bpe_49k.json")
)


@pytest.fixture(scope="module")
def texts(spark):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]


@pytest.fixture(scope="module")
def bytes_library():
    with open(RANKS, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def rows_of(spark, name, columns):
    return [tuple(r) for r in LLM_QUERIES[name](spark, SF).select(*columns.split()).collect()]


def digest(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


def test_op1(spark, texts, bytes_library):
    want = []
    for i, text in texts:
        ids = bytes_library.encode_ordinary(text or "")
        want.append((i, len(ids), digest(" ".join(map(str, ids))), digest(text or "")))
    assert by_text(rows_of(spark, "op1_byte_bpe", "doc_id n_tokens ids_sha256 decoded_sha256")) == by_text(want)


def test_op2(spark, texts):
    prints = [plain_print(text) for _, text in texts]
    groups = Groups(len(texts))
    for a, one in enumerate(prints):
        for b in range(a):
            if (one ^ prints[b]).bit_count() <= 3:
                groups.join(a, b)
    least = {}
    for k, (i, _) in enumerate(texts):
        least[groups.find(k)] = min(i, least.get(groups.find(k), i))
    want = [(i, f"{prints[k]:016x}", least[groups.find(k)]) for k, (i, _) in enumerate(texts)]
    assert by_text(rows_of(spark, "op2_simhash", "doc_id fingerprint component_id")) == by_text(want)


def test_op3(spark, texts):
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    counts = [len(ids) for ids in library.encode([t or "" for _, t in texts], num_threads=1)]
    want = [(i, len((t or "").encode()), n, n > 4096) for (i, t), n in zip(texts, counts)]
    assert by_text(rows_of(spark, "op3_token_counts", "doc_id n_bytes n_tokens over_limit")) == by_text(want)


def test_op4(spark):
    pages = [(r.page_id, (r.html or "").encode()) for r in spark.read.parquet(f"{SF}/pages.parquet").collect()]
    newest = {}
    for i, data in pages:
        newest[data] = max(i, newest.get(data, i))
    want = []
    for i, data in pages:
        revisit = newest[data] != i
        sha = base64.b32encode(hashlib.sha1(data).digest()).decode()
        want.append((i, len(data), sha, "revisit" if revisit else "response", newest[data] if revisit else None))
    columns = "page_id payload_bytes payload_digest record_type refers_to"
    assert by_text(rows_of(spark, "op4_warc", columns)) == by_text(want)


def test_op5(spark, texts):
    columns = "doc_id n_chars edited_sha256 fingerprint edited_fingerprint near_edited near_next"
    assert by_text(rows_of(spark, "op5_merkle_fingerprint", columns)) == by_text(plain_edits(texts))


def test_op6(spark, texts):
    want = [(i, n, gone, digest(kept)) for (i, _), (n, gone, kept) in zip(texts, plain_repeats([t for _, t in texts], 35))]
    assert by_text(rows_of(spark, "op6_substring_dedup", "doc_id n_words n_removed kept_sha256")) == by_text(want)


def test_op7(spark):
    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    assert by_text(rows_of(spark, "op7_embedding_join", "vec_id n_links component_id kept")) == by_text(plain_vectors(rows, 0.93))


def test_op7_with_links_in_several_cells(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(embedding_join, "CELL", 100)
    monkeypatch.setattr(embedding_join, "PART", 64)
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(60, 64))
    rows = [(k, (centres[k % 60] + rng.normal(size=64) * rng.choice([0.1, 0.27, 0.6])).astype("f4").tolist(), k % 3) for k in range(1500)]
    rows += [(1500 + k, rows[0][1], 0) for k in range(200)]  # a hot vector
    folder = f"file://{tmp_path}"
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{folder}/embeddings.parquet")
    found = LLM_QUERIES["op7_embedding_join"](spark, folder).collect()
    want = plain_vectors(rows, 0.93)
    assert by_text(tuple(r) for r in found) == by_text(want)
    assert sum(n > 0 for _, n, _, _ in want) > 500 and len({c for _, _, c, _ in want}) > 300


def test_op8(spark):
    rows = spark.read.parquet(f"{SF}/conversations.parquet").collect()
    talks = {-7: [(0, "user", "\\### Assistant: </turn> ok"), (1, "assistant", "\\### Assistant: </turn> ok")]}
    for r in rows:
        talks.setdefault(r.conv_id, []).append((r.turn, r.role or "", r.text or ""))
    want = []
    for conv, turns in talks.items():
        turns.sort()
        said = "".join(f"{role}\n{text}\n" for _, role, text in turns)
        loss = "".join(text for _, role, text in turns if role == "assistant")
        want.append((conv, len(turns), digest(said), len(loss), digest(loss)))
    assert by_text(rows_of(spark, "op8_chat_format", "conv_id n_turns turns_sha256 loss_chars loss_sha256")) == by_text(want)


def check_packing(rows, texts, most):
    library = Tokenizer.from_file(WORDS)
    coded = library.encode_batch([t or "" for _, t in texts], add_special_tokens=False)
    want, total = [], 0
    for (i, _), one in zip(texts, coded):
        ids = np.array([*one.ids, 0], "<u4")
        total += len(ids)
        for piece, at in enumerate(range(0, len(ids), most)):
            part = ids[at : at + most]
            want.append((i, piece, at, len(part), zlib.crc32(part.tobytes())))
    assert by_text(r[:5] for r in rows) == by_text(want)
    places = {}
    for r in rows:
        places.setdefault(r[5], []).append((r[6], r[3]))
    for spans in places.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= most
    return len(places), -(-total // most)


def test_op9(spark, texts):
    rows = rows_of(spark, "op9_best_fit_packing", "doc_id piece start length ids_crc32 sequence_id offset")
    used, least = check_packing(rows, texts, 2048)
    assert used <= 1.01 * least + 1


def test_op10(spark, texts):
    rows = rows_of(spark, "op10_quality_classifier", "doc_id held_out score predicted")
    assert {i for i, *_ in rows} == {i for i, _ in texts} and len(rows) == len(texts)
    assert all(held == (zlib.crc32(str(i).encode()) % 3 == 1) for i, held, *_ in rows)
    assert all(0 <= score <= 1 and predicted == (score >= 0.5) for *_, score, predicted in rows)
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    right = [predicted == labels[i] for i, held, _, predicted in rows if held and labels.get(i) is not None]
    assert len(right) > 5 and np.mean(right) > 0.9


def five_word_sets(text):
    words = (text or "").encode().lower().split()
    return frozenset(b" ".join(words[k : k + 5]) for k in range(max(1, len(words) - 4))) if words else frozenset()


def test_pipeline_rows(spark):
    """Exact rows of every stage after the classifier, whose rows are judged by their labels."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    good = corpus_pipeline.stored(stages["quality classifier"](spark, docs, SF), "good")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    ids = {r.doc_id for r in good.collect()}
    assert np.mean([(i in ids) == bool(q) for i, q in labels.items() if q is not None]) > 0.95
    rows = sorted(good.collect(), key=lambda r: r.doc_id)
    sets, groups = [five_word_sets(r.text) for r in rows], Groups(len(rows))
    for a, one in enumerate(sets):
        for b in range(a):
            shared = len(one & sets[b])
            if one == sets[b] or shared * 5 >= (len(one) + len(sets[b]) - shared) * 4:
                groups.join(a, b)
    kept = corpus_pipeline.stored(stages["SimHash near-dedup"](spark, good, SF), "kept")
    assert by_text(kept.collect()) == by_text(r for k, r in enumerate(rows) if groups.find(k) == k)
    sent = kept.collect()
    cut = corpus_pipeline.stored(stages["substring dedup"](spark, kept, SF), "cut")
    want = []
    for r, (_, gone, left) in zip(sent, plain_repeats([r.text for r in sent], 35)):
        text = left if gone else r.text
        want.append({**r.asDict(), "text": text, "n_chars": len(text or "")})
    assert by_text(tuple(r) for r in cut.collect()) == by_text(tuple(w[c] for c in cut.columns) for w in want)
    packed = stages["best-fit packing"](spark, cut, SF)
    columns = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    used, least = check_packing([tuple(r) for r in packed.select(*columns).collect()], [(w["doc_id"], w["text"]) for w in want], 2048)
    assert used <= 1.01 * least + 1


# very long texts


@pytest.fixture(scope="module")
def long_text():
    """Over 8 MB: larger than a slice, a block and every part that an operator reads at once."""
    rng = random.Random(11)
    words = ["".join(rng.choice("abcdefghiklmnoprstuvwéß") for _ in range(rng.randint(1, 9))) for _ in range(20_000)]
    return " ".join(rng.choice(words) + rng.choice(["", "", "", ",", ".\n", " 12"]) for _ in range(1_350_000))


def test_tokens_of_a_very_long_text(spark, long_text, bytes_library):
    rows = [(1, long_text), (2, "short"), (3, "x" * 200_000)]
    assert len(long_text.encode()) > 8 << 20
    docs = documents(spark, rows)
    want = [(i, bytes_library.encode_ordinary(t)) for i, t in rows[:2]]
    found = {r.id: r for r in byte_bpe.encode_documents(docs.where("doc_id < 3"), RANKS, public_tokenizers.PATTERN).collect()}
    assert [(i, found[i].ids) for i, _ in rows[:2]] == want and bytes(found[1].decoded) == long_text.encode()
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    counted = {r.id: r.n_tokens for r in token_counts.count_tokens(docs, PIECES, 4096).collect()}
    assert counted == {i: len(library.encode(t, num_threads=1)) for i, t in rows}
    packed = packing.pack_documents(docs, WORDS, 2048, 0)
    check_packing([tuple(r) for r in packed.collect()], rows, 2048)


def test_prints_and_features_of_a_very_long_text(long_text):
    text = " ".join(long_text.split()[:100_000])  # more shingles than a part of them
    assert simhash.fingerprint(text.encode()) == plain_print(text)
    data = long_text.encode()
    kinds = quality.TABLE[np.frombuffer(data, "u1")].astype("i8")
    found = quality.features(data)
    single = np.bincount(kinds, minlength=quality.CLASSES)
    double = np.bincount(kinds[:-1] * quality.CLASSES + kinds[1:], minlength=quality.CLASSES**2)
    assert np.allclose(found[: quality.CLASSES], np.sqrt(single / len(data)), atol=1e-6)
    assert np.allclose(found[quality.CLASSES : -quality.STATS], np.sqrt(double / len(data)), atol=1e-6)


def test_copies_inside_very_long_texts(spark, long_text):
    words = long_text.split()
    passage = " ".join(words[500:600])
    rows = [(1, " ".join(words[:100_000])), (2, " ".join([*words[200_000:300_000], *words[500:600]])), (3, passage)]
    out = {r.id: (r.n_words, r.n_removed) for r in substring_dedup.remove_repeats(documents(spark, rows)).collect()}
    assert out == {1: (100_000, 100), 2: (100_100, 100), 3: (100, 100)}
    near = [(1, long_text), (2, long_text + " one more word"), (3, "another"), (4, long_text)]
    kept = simhash.similar_rows(documents(spark, near)).select("doc_id").collect()
    assert sorted(r.doc_id for r in kept) == [1, 3]
    found = merkle.fingerprint_edits(documents(spark, near)).collect()
    assert by_text(tuple(r) for r in found) == by_text(plain_edits(near))


def test_a_page_of_fifty_megabytes(spark, tmp_path):
    page = "<p>" + "large page é\r\n\r\n" * 3_000_000
    rows = [(1, "http://a.b/", page), (2, "http://a.b/", page), (3, "http://a.b/c", "small")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    found = {r.id: r for r in warc.archive_index(pages, path=f"file://{tmp_path}/w").collect()}
    data = page.encode()
    assert len(data) > 50_000_000 and {i: r.payload_bytes for i, r in found.items()} == {1: len(data), 2: len(data), 3: 5}
    assert found[1].record_type == "revisit" and found[1].refers_to == 2 and found[2].record_type == "response"
    assert found[2].payload_digest == base64.b32encode(hashlib.sha1(data).digest()).decode()

