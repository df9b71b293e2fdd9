import base64
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
import sentencepiece
import tiktoken
from tokenizers import Tokenizer

from tests.llm.cases import TEXTS, by_text, documents
from tidewell.llm import byte_bpe, packing, token_counts

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
WORDS = public_tokenizers.path("word_bpe_49k.json")


def odd_texts(seed: int, letters: list[str]) -> list[str]:
    rng = random.Random(seed)
    made = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 30))) for _ in range(3000)]
    points = [chr(c) + "a" + chr(c) + " " + chr(c) * 2 + "1\n" + chr(c) for c in range(1, 0x3200)]
    return made + points + ["a" * 5000, "ab" * 3000, " " * 2000 + "x"]


@pytest.fixture(scope="module")
def ranks():
    with open(RANKS, "rb") as file:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in file)}


@pytest.fixture(scope="module")
def library(ranks):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_byte_bpe_equals_the_library(library):
    tokens = byte_bpe.load_ranks(open(RANKS, "rb").read())
    encoder = byte_bpe.BlockEncoder(tokens, public_tokenizers.PATTERN)
    texts = odd_texts(1, list("aab  \n\t's12é .!\x1c\xa0"))
    for text, ids in zip(texts, encoder.encode(texts)):
        assert ids.tolist() == library.encode_ordinary(text)
        assert encoder.decode(ids) == text.encode()


def test_merges_of_lower_rank_go_first():
    # "bc" makes a pair of lower rank than its own: after one such merge the word must look again
    tokens = [bytes([b]) for b in range(256)] + [b"xbc", b"xb", b"bc", b"bcx"]
    ranks = byte_bpe.RankFile(tokens)
    assert ranks.merges.early.any()

    def plain(word):
        parts = [bytes([b]) for b in word]
        while True:
            found = [(ranks.ranks[a + b], k) for k, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks.ranks]
            if not found:
                return [ranks.ranks[p] for p in parts]
            _, k = min(found)
            parts[k : k + 2] = [parts[k] + parts[k + 1]]

    rng = random.Random(5)
    words = [bytes(rng.choice(b"xbc") for _ in range(rng.randint(1, 12))) for _ in range(300)]
    ids, counts = ranks.encode(words)
    for word, own in zip(words, np.split(ids, np.cumsum(counts)[:-1])):
        whole = ranks.ranks.get(word)
        assert own.tolist() == ([whole] if whole is not None else plain(word))


def test_encode_documents(spark, library):
    out = byte_bpe.encode_documents(documents(spark), RANKS, public_tokenizers.PATTERN).collect()
    want = [(i, library.encode_ordinary(t or ""), (t or "").encode()) for i, t in TEXTS]
    assert by_text((r.id, r.ids, bytes(r.decoded)) for r in out) == by_text(want)


def test_piece_counts_equal_the_library():
    merger = token_counts.PieceMerger(open(PIECES, "rb").read())
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    texts = odd_texts(2, list("aab   \n's12é .!▁tthe　"))
    texts += [" " * n + word for n in range(120) for word in ("", "the", "\n", "<s> </s>")]
    assert merger.count_texts(texts).tolist() == [len(ids) for ids in library.encode(texts, num_threads=1)]


def test_count_tokens(spark):
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    out = token_counts.count_tokens(documents(spark), PIECES, limit=100).collect()
    want = []
    for i, text in TEXTS:
        n = len(library.encode(text or ""))
        want.append((i, len((text or "").encode()), n, n > 100))
    assert by_text(tuple(r) for r in out) == by_text(want)


def test_word_ids_equal_the_library():
    own = packing.WordTokenizer(open(WORDS, "rb").read())
    library = Tokenizer.from_file(WORDS)
    texts = odd_texts(3, [*"aab   \n\t's12é .!\x1c\x85İΣÄ̈　A", "<|endoftext|>", "<|ENDOFTEXT|>"])
    texts += ["  lead and trail \u2003 wide\x85line\xa0glue ", "Ünïcode ǅ ŉ ß", "汉字 漢字 test 汉字", "x" * 5000 + " \x1f y", ""]
    texts += [f"{chr(c)} a{chr(c)}b{chr(c)}., {chr(c).upper()}x!? {chr(c)}'s {chr(c)}9" for c in range(0x21, 0x250)]
    texts += ["don't we'll 12ab3 a.b,c ... \"quoted\" (x) a-b_c ab" + "c" * 300 + "!!! " + "xyz" * 200, "the " * 50 + "The THE thé"]
    want = [[*one.ids, 7] for one in library.encode_batch(texts, add_special_tokens=False)]
    for part in (texts, texts, texts[3:20]):  # also from what is known already, and from the middle of an array
        ids, rows = own.encode(pa.array(["cut off", None, *part, "cut off"]).slice(2, len(part)), 7)
        found = [ids[a:b].tolist() for a, b in zip(rows, rows[1:])]
        assert found == [want[texts.index(text)] for text in part]
    ids, rows = own.encode(pa.array([None, ""], pa.string()), 7)
    assert ids.tolist() == [7, 7] and rows.tolist() == [0, 1, 2]


def test_pair_table_finds_all_pairs_and_no_others():
    rng = random.Random(3)
    for count in (1, 7, 3000):
        pairs = {(rng.randrange(500), rng.randrange(500)): rank for rank in range(count)}
        table = packing.PairTable(pairs, 500)
        asked = [*pairs, *((rng.randrange(500), rng.randrange(500)) for _ in range(4000))]
        left, right = (np.array(side, "i4") for side in zip(*asked))
        assert table(left, right).tolist() == [pairs.get(pair, packing.PairTable.NONE) for pair in asked]


def test_word_ids_do_not_depend_on_what_is_remembered(monkeypatch):
    monkeypatch.setattr(packing, "KNOWN_WORDS", 3)
    own = packing.WordTokenizer(open(WORDS, "rb").read())
    fresh = packing.WordTokenizer(open(WORDS, "rb").read())
    for text in odd_texts(4, [*"aab  's1é.!"]):
        monkeypatch.setattr(packing, "KNOWN_WORDS", 3)
        found = own.encode(pa.array([text]), 0)[0].tolist()
        monkeypatch.setattr(packing, "KNOWN_WORDS", 500_000)
        assert found == fresh.encode(pa.array([text]), 0)[0].tolist()


def test_plan_uses_every_piece_once_and_few_bins():
    rng = random.Random(0)
    for lengths in (
        [rng.randint(1, 64) for _ in range(500)], [40] * 9, [64] * 3 + [1] * 5, [], [rng.randint(20, 34) for _ in range(300)],
    ):
        bins = packing.plan_bins(dict(Counter(lengths)), 64)
        used = Counter()
        for times, sizes in bins:
            assert times > 0 and sum(size * n for size, n in sizes) <= 64
            for size, n in sizes:
                used[size] += times * n
        assert used == Counter(lengths)
    many = [rng.randint(1, 64) for _ in range(5000)]
    assert sum(times for times, _ in packing.plan_bins(dict(Counter(many)), 64)) <= 1.01 * -(-sum(many) // 64) + 1


def test_two_better_fitting_pieces_take_the_place_of_the_smallest():
    # greedy filling takes 6 and 3 and leaves 1; 2 + 2 in place of 3 leaves nothing
    first = packing.plan_bins({6: 1, 3: 1, 2: 2}, 10)[0]
    assert first == (1, [(6, 1), (2, 2)])


def test_pack_documents(spark):
    library = Tokenizer.from_file(WORDS)
    out = packing.pack_documents(documents(spark), WORDS, 64, 0, keep_ids=True).collect()
    want = []
    for i, text in TEXTS:
        ids = library.encode(text or "", add_special_tokens=False).ids + [0]
        want += [(i, n, at, ids[at : at + 64]) for n, at in enumerate(range(0, len(ids), 64))]
    assert by_text((r.id, r.piece, r.start, r.ids) for r in out) == by_text(want)
    places = {}
    for r in out:
        assert r.length == len(r.ids) and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for spans in places.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 64


def test_empty_tables(spark):
    none = documents(spark).where("false")
    assert byte_bpe.encode_documents(none, RANKS, public_tokenizers.PATTERN).count() == 0
    assert token_counts.count_tokens(none, PIECES).count() == 0
    assert packing.pack_documents(none, WORDS).count() == 0


def test_idle_workers_hold_no_words(spark):
    definition = open(WORDS, "rb").read()
    assert packing.cut_documents(documents(spark), WORDS, 64, 0, keep_ids=True).count() > 0

    def held(batches):
        for batch in batches:
            known = len(packing.word_tokenizer(definition).known)
            yield pa.RecordBatch.from_arrays([pa.array([known] * batch.num_rows, pa.int64())], ["known"])

    rows = spark.range(64, numPartitions=16).mapInArrow(held, "known bigint").collect()
    assert {row["known"] for row in rows} == {0}


def test_a_vocabulary_has_a_bounded_size(tmp_path, monkeypatch):
    from tidewell.llm import common

    monkeypatch.setattr(common, "MAX_VOCABULARY_BYTES", 3)
    (tmp_path / "v").write_bytes(b"1234")
    with pytest.raises(ValueError):
        common.vocabulary_bytes(str(tmp_path / "v"))
