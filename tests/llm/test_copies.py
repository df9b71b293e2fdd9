import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
import xxhash

from tests.llm.cases import TEXTS, by_text, documents, random_texts
from tidewell import session
from tidewell.llm import common, embedding_join, simhash, substring_dedup

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile("[^\x20\x09-\x0d]+")


class Groups:
    """Plain union of numbers."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        while self.up[x] != x:
            x = self.up[x]
        return x

    def join(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)


def plain_print(text, shingle=3):
    words = WORD.findall((text or "").translate(LOWER))
    if not words:
        return 0
    shingles = [" ".join(words[k : k + shingle]) for k in range(max(1, len(words) - shingle + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << bit for bit in range(64) if 2 * sum(h >> bit & 1 for h in hashes) > len(hashes))


def test_fingerprint():
    for _, text in TEXTS + [(0, "É Straße A-Z"), (0, "one"), (0, "x y"), (0, "q w e")]:
        assert simhash.fingerprint((text or "").encode()) == plain_print(text)


@pytest.mark.parametrize("radius", [1, 2, 3, 5])
@pytest.mark.parametrize("words", [1, 2])
def test_bit_sliced_links_equal_brute_force(radius, words):
    rng = np.random.default_rng(radius)
    base = rng.integers(0, 2**63, (30, words), dtype="u8")
    prints = base[rng.integers(0, 30, 700)]
    for row in prints:
        for bit in rng.integers(0, 64 * words, rng.integers(0, 5)):
            row[bit // 64] ^= np.uint64(1) << np.uint64(bit % 64)
    groups = np.sort(rng.integers(0, 6, 700))
    plain = Groups(700)
    for a in range(700):
        gaps = np.bitwise_count(prints ^ prints[a]).sum(axis=1)
        for b in np.flatnonzero((gaps <= radius) & (groups == groups[a])):
            plain.join(a, int(b))
    assert simhash.linked(prints, groups, radius).tolist() == [plain.find(k) for k in range(700)]


@pytest.mark.parametrize("part", [8192, 16])
def test_near_duplicates_equal_brute_force(spark, monkeypatch, part):
    monkeypatch.setattr(simhash, "PART", part)
    base = " ".join(f"w{k}" for k in range(400))
    texts = [base + f" tail{k}" for k in range(40)] + random_texts(1, "abc", 40, 4) + [base.upper()] * 3
    rows = TEXTS + list(enumerate(texts, 100))
    out = simhash.near_duplicates(documents(spark, rows)).collect()
    prints = [plain_print(text) for _, text in rows]
    groups = Groups(len(rows))
    for a in range(len(rows)):
        for b in range(a):
            if (prints[a] ^ prints[b]).bit_count() <= 3:
                groups.join(a, b)
    least = {}
    for k, (i, _) in enumerate(rows):
        root = groups.find(k)
        least[root] = min((x for x in (least.get(root), i) if x is not None), default=None)
    want = [(i, prints[k], least[groups.find(k)]) for k, (i, _) in enumerate(rows)]
    assert by_text((r.id, r.fp % 2**64, r.component_id) for r in out) == by_text(want)
    assert len(set(least.values())) < len(rows) - 30  # the near copies did link


def test_bucket_keys_lose_no_pair(spark):
    rng = np.random.default_rng(0)
    rows = []
    for n in range(200):
        one = other = int(rng.integers(0, 2**63))
        for bit in rng.choice(64, 3, replace=False):
            other ^= 1 << int(bit)
        rows += [(n, one - 2**64 if one >> 63 else one), (n, other - 2**64 if other >> 63 else other)]
    from pyspark.sql import functions as F

    keys = spark.createDataFrame(rows, "n int, fp long").select("n", F.explode(simhash._keys(F.col("fp"), 3)).alias("k"))
    met = keys.groupBy("n", "k").count().where("count = 2").select("n").distinct()
    assert met.count() == 200


def test_similar_rows_keeps_one_of_each_group(spark):
    rng = np.random.default_rng(3)
    vocabulary = [f"w{k}" for k in range(5000)]
    rows, number = [], 0
    for group in range(12):
        words = [vocabulary[k] for k in rng.integers(0, 5000, 300)]
        for copy in range(4):
            edited = list(words)
            for place in rng.choice(300, 3 * (copy > 0), replace=False):
                edited[place] = "edit"
            rows.append((number, " ".join(edited)))
            number += 1
    rows += [(900, ""), (901, None), (902, "one two"), (903, "one three"), (None, rows[0][1])]
    docs = documents(spark, rows + [rows[0]])
    out = simhash.similar_rows(docs)
    assert out.columns == docs.columns
    kept = sorted(r.doc_id for r in out.collect())
    assert kept == [4 * group for group in range(12)] + [900, 902, 903]
    assert simhash.similar_rows(docs.where("false")).count() == 0


def at_similarity(rng, shared, own):
    """Two texts without common words but one run, whose five-word shingles have the Jaccard similarity shared/(shared+own)."""
    words = [f"w{rng.integers(1 << 60)}" for _ in range(shared + own + 4)]
    half = own // 2  # each text has the shared shingles and half of the others
    return " ".join(words[: shared + half + 4]), " ".join(words[half:])


@pytest.mark.parametrize("nodes", [4096, 8])
def test_only_texts_of_the_similarity_are_copies(spark, monkeypatch, nodes):
    monkeypatch.setattr(simhash, "ALIKE_NODES", nodes)
    rng = np.random.default_rng(9)
    texts, want = [], []
    for shared, own in [(140, 60), (156, 44), (160, 40), (164, 36)] * 10:  # 0.7, 0.78, 0.8, 0.82
        want += [len(texts)] + [len(texts) + 1] * (shared < 160)
        texts += at_similarity(rng, shared, own)
    words = [f"v{k}" for k in range(1500)]
    for k in range(30):  # pages of a family, each 0.7 like the next
        want.append(len(texts))
        texts.append(" ".join(words[36 * k : 36 * k + 204]))
    for k in range(30):  # each 0.82 like the next, the ends not at all
        want += [len(texts)] * (k == 0)
        texts.append(" ".join(f"x{j}" for j in range(20 * k, 20 * k + 204)))
    kept = simhash.similar_rows(documents(spark, list(enumerate(texts)))).collect()
    assert sorted(r.doc_id for r in kept) == want


def plain_repeats(texts, window):
    rows = [(text or "").encode().split() for text in texts]
    seen = Counter(tuple(row[k : k + window]) for row in rows for k in range(len(row) - window + 1))
    out = []
    for row in rows:
        gone = set()
        for k in range(len(row) - window + 1):
            if seen[tuple(row[k : k + window])] > 1:
                gone.update(range(k, k + window))
        kept = b" ".join(word for k, word in enumerate(row) if k not in gone)
        out.append((len(row), len(gone), kept.decode()))
    return out


@pytest.mark.parametrize(
    "letters, window, gram, hot",
    [("ab", 5, 3, 20_000), ("abcd", 5, 3, 5), ("abcdefghijklmnopqrstuvwxyz", 6, 2, 2), ("a", 7, 9, 3)],
)
def test_remove_repeats_equals_brute_force(spark, monkeypatch, letters, window, gram, hot):
    monkeypatch.setattr(substring_dedup, "HOT", hot)
    base = random_texts(window, letters, 40, 40)
    texts = base + [f"{a} {b}" for a, b in zip(base, base[7:])] + [base[0]] * 3
    rows = TEXTS + list(enumerate(texts, 100)) + [(None, base[3])]
    out = substring_dedup.remove_repeats(documents(spark, rows, 5), window, gram, carry=["n_tokens"])
    want = [(i, *found) for (i, _), found in zip(rows, plain_repeats([t for _, t in rows], window))]
    assert out.columns == ["id", "n_tokens", "n_words", "n_removed", "kept"]
    assert by_text((r.id, r.n_words, r.n_removed, r.kept) for r in out.collect()) == by_text(want)


def test_a_factor_ends_inside_a_repeat():
    # the second run's factor ends before the repeat that crosses its end does
    block = substring_dedup.Block(3)
    for text in (b"a b c d", b"c d e f", b"a b c d e f"):
        block.add(text, len(text.split()) - 2)
    assert [marks.tolist() for marks in block.marks] == [[True] * 2, [True] * 2, [True, True, True, True]]


def test_remove_repeats_of_nothing(spark):
    assert substring_dedup.remove_repeats(documents(spark).where("false")).count() == 0


def plain_vectors(rows, threshold):
    groups, links, sound = Groups(len(rows)), [0] * len(rows), {}
    for k, (_, vector, label) in enumerate(rows):
        if vector and label is not None and all(x is not None and np.isfinite(x) for x in vector) and any(vector):
            sound.setdefault((label, len(vector)), []).append(k)
    for places in sound.values():
        units = np.array([rows[k][1] for k in places], "f8")
        units /= np.abs(units).max(axis=1)[:, None]
        units /= np.linalg.norm(units, axis=1)[:, None]
        near = units @ units.T >= threshold
        for a, k in enumerate(places):
            links[k] = int(near[a].sum()) - 1
            for b in np.flatnonzero(near[a]):
                groups.join(k, places[b])
    least = {}
    for k, (i, _, _) in enumerate(rows):
        root = groups.find(k)
        least[root] = min((x for x in (least.get(root), i) if x is not None), default=None)
    return [(i, links[k], least[groups.find(k)], i == least[groups.find(k)]) for k, (i, _, _) in enumerate(rows)]


@pytest.mark.parametrize("cell, part", [(2048, 2048), (40, 2048), (40, 16)])
def test_near_vectors_equal_brute_force(spark, monkeypatch, cell, part):
    monkeypatch.setattr(embedding_join, "CELL", cell)
    monkeypatch.setattr(embedding_join, "PART", part)
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(12, 5))
    rows = [
        (k, (centres[rng.integers(12)] + rng.normal(size=5) * 0.25).tolist(), int(rng.integers(2))) for k in range(500)
    ]
    rows += [(600, *rows[0][1:])] * 3 + [(None, *rows[1][1:]), (700, None, 1), (701, [0.0] * 5, 1), (707, [], 0)]
    rows += [(702, [1.0, None, 0.0, 0.0, 0.0], 1), (703, [float("nan")] * 5, 0), (704, [1.0, 2.0], 0), (None, None, None)]
    rows += [(705, [1.0, 2.0], None), (706, [2.0, 4.0], 0), (708, [1e200, 2e200], 0), (709, [float("inf"), 1.0], 0)]
    names = "vec_id long, embedding array<double>, label int, node int, id string"
    table = spark.createDataFrame([(*row, 7, "x") for row in rows], names).repartition(4)
    out = embedding_join.near_vectors(table, 0.9).collect()
    assert by_text(tuple(r) for r in out) == by_text(plain_vectors(rows, 0.9))


@pytest.mark.parametrize("threshold", [0.93, 0.5, -0.2, 1.5])
@pytest.mark.parametrize("chunk", [1 << 23, 3000])
def test_near_vectors_in_rounds_equal_brute_force(spark, monkeypatch, threshold, chunk):
    for name, value in (("CELL", 60), ("PART", 40), ("FILE", 1500), ("CHUNK", chunk)):
        monkeypatch.setattr(embedding_join, name, value)
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(9, 48))
    vectors = [centres[k % 9] + rng.normal(size=48) * rng.choice([0.02, 0.15, 0.3, 3]) for k in range(400)]
    rows = [(k, v.astype("f4").tolist(), "ab"[k % 2]) for k, v in enumerate(vectors)]
    rows += [(1000 + k, *rows[5][1:]) for k in range(150)] + [(2000 + k, rows[5][1], "c") for k in range(3)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label string").repartition(3)
    want = plain_vectors(rows, threshold)
    if threshold > 1:  # equal vectors count all the same
        same = [sum(x[1:] == r[1:] for x in rows) - 1 for r in rows]
        first = {(tuple(v), label): k for k, v, label in reversed(rows)}
        want = [(k, n, first[tuple(v), label], k == first[tuple(v), label]) for (k, v, label), n in zip(rows, same)]
    assert by_text(tuple(r) for r in embedding_join.near_vectors(table, threshold).collect()) == by_text(want)


def test_near_vectors_are_stored_once(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(embedding_join, "CELL", 20)
    paths = []
    for module in (embedding_join, session):
        monkeypatch.setattr(module, "new_path", lambda *_: paths.append(f"file://{tmp_path}/{len(paths)}") or paths[-1], raising=False)
    monkeypatch.setattr(common, "new_path", session.new_path)
    vectors = np.random.default_rng(4).normal(size=(3000, 64)).astype("f4")  # no cell is apart from others
    table = spark.createDataFrame([(k, v.tolist(), 0) for k, v in enumerate(vectors)], "vec_id long, embedding array<float>, label int")
    assert embedding_join.near_vectors(table).where("n_links = 0").count() == 3000
    assert paths and sum(f.stat().st_size for f in tmp_path.rglob("*.parquet") if f.is_file()) < 2 * vectors.nbytes


@pytest.mark.parametrize("spread", [0.02, 0.25, 3])
def test_balls_meet_tile_by_tile(monkeypatch, spread):
    monkeypatch.setattr(embedding_join, "TILE", 16)
    rng, theta = np.random.default_rng(7), math.acos(0.93)
    vectors = (rng.normal(size=(7, 64))[rng.integers(7, size=300)] + rng.normal(size=(300, 64)) * spread).astype("f4")
    units = embedding_join._units(vectors, 64)
    middle = embedding_join._middles(units.astype("f4"), math.cos(theta / 2 * 0.999) + embedding_join._slack(64))
    assert ((units * units[middle]).sum(axis=1) >= math.cos(theta / 2)).all()
    balls = [[m, *(k for k in np.flatnonzero(middle == m).tolist() if k != m)] for m in np.unique(middle).tolist()]
    angles = [0.0 if len(b) == 1 else math.acos((units[b] @ units[b[0]]).min() - 1e-5) for b in balls]
    table = pa.table({
        "ball": [b[0] for b in balls], "angle": angles, "nodes": balls, "ns": [[2] * len(b) for b in balls],
        "part": pa.array([b[0] // 100 for b in balls], pa.int32()), "values": [vectors[b].tobytes() for b in balls],
    })
    sent = embedding_join._Space(table.filter(pc.less(table["part"], 2)), 64, True)
    mine, other = embedding_join._Links(embedding_join._Space(table, 64, True)), embedding_join._Links(sent)
    embedding_join._meet(mine, other, 1, 0.93, theta)
    pairs = (units @ units.T >= 0.93) & (middle[:, None] != middle)
    pairs &= (np.minimum(middle[:, None], middle) < 200)  # one of the two was sent
    found = np.zeros(300, "i8")
    for side in (mine, other):
        found[side.space.node] += side.links + np.repeat(side.whole, np.diff(side.space.ends))
    assert found.tolist() == (pairs.sum(axis=1) * 2).tolist()


def test_equal_vectors_get_one_cell():
    rng = np.random.default_rng(5)
    vectors, pivots = rng.normal(size=(501, 64)), embedding_join._whole(rng.normal(size=(40, 64)))
    whole = embedding_join._whole(vectors)
    alone = np.concatenate([whole[k : k + 1] @ pivots.T for k in range(len(whole))])
    assert (alone == whole @ pivots.T).all()


def test_near_vectors_of_nothing(spark):
    table = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert embedding_join.near_vectors(table).count() == 0
