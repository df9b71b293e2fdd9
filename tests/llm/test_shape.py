"""Conversation repair, whitening and sharding against plain computations."""

import random
import re
import zlib
from collections import Counter, defaultdict
from hashlib import md5, sha256

import numpy as np
import pytest

from tests.llm.cases import LONG, TEXTS, by_text, documents
from tidewell.llm import repair, sharding, whitening
from tidewell.llm.queries import LLM_ORACLES, LLM_QUERIES

SF = "/root/testdata/sf0.001"
SHOWN = re.compile(r"[^\x20\x09-\x0D]")


# conversations


def plain_cheapest(rows):
    """(cost, edits) by relaxing (cost, edits) pairs from the end, row by row; rows are (initial, fault)."""
    best = {0: (0, ""), 1: (6, "II"), 2: (3, "I"), 3: (0, "")}
    for initial, fault in reversed(rows):
        extra = 3 if fault == repair.TRUNCATED else 0
        now = {}
        for state in range(4):
            found = [(best[state][0] + 4, "D" + best[state][1])]
            if fault not in (repair.BLANK, repair.DUPLICATE):
                heads = [("R", 3, {2: 3}.get(state, 2))]
                if initial == "s" and state == 0:
                    heads.append(("K", 0, 1))
                if initial == ("a" if state == 2 else "u"):
                    heads.append(("K", 0, {"a": 3, "u": 2}[initial]))
                found += [(best[to][0] + cost + extra, letter + best[to][1]) for letter, cost, to in heads]
            now[state] = min(found)
        for _ in range(4):
            for state in range(4):
                cost, edits = now[3 if state == 2 else 2]
                now[state] = min(now[state], (cost + 3, "I" + edits))
        best = now
    return best[0]


def plain_repair(rows, damaged=True):
    """Every conversation of (conv_id, turn, role, text), one row after the other."""
    talks = defaultdict(list)
    for conv, turn, role, text in rows:
        talk = talks[conv]
        role, text = " " if role is None else role, " " if text is None else text
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        draw = zlib.crc32(key.encode()) % 20 if damaged else 5
        if draw == 0:
            continue
        text = "" if draw == 1 else re.sub("[.!?]", "", text) if draw == 2 else text
        role = "user" if draw == 4 else role
        talk += [(turn, role, text)] * (2 if draw == 3 else 1)
    out = {}
    for conv, talk in talks.items():
        digest = lambda r: sha256(f"{len(r[1])}:{r[1]}:{r[2]}".encode()).hexdigest()
        talk.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], digest(r)))
        seen, faults = set(), []
        for _, role, text in talk:
            shown = SHOWN.findall(text)
            fault = repair.SOUND if shown and shown[-1] in ".!?" else repair.TRUNCATED
            fault = repair.BLANK if not shown else repair.DUPLICATE if (role, text) in seen else fault
            seen.add((role, text))
            faults.append(fault)
        cost, audit = plain_cheapest([(r[1][:1], f) for r, f in zip(talk, faults)])
        said, left = [], iter(talk)
        for edit in audit:
            row = None if edit == "I" else next(left)
            follows = "assistant" if said and said[-1][0][:1] == "u" else "user"
            if edit != "D":
                said.append((row[1] if edit == "K" else follows, row[2] if row else ""))
        initials = "".join(role[0] for role, _ in said)
        assert re.fullmatch("(s?(ua)+)?", initials)
        turns = {r[0] for r in talk if r[0] is not None}
        pairs = [a[1][:1] + b[1][:1] for a, b in zip(talk, talk[1:])]
        counts = Counter(faults)
        out[conv] = (
            max(turns) - min(turns) + 1 - len(turns) if turns else 0,
            *(counts[f] for f in (repair.BLANK, repair.DUPLICATE, repair.TRUNCATED)),
            sum(p not in ("su", "ua", "au") for p in pairs),
            cost,
            audit,
            sha256("\n".join(f"{r}:{t}" for r, t in said).encode()).hexdigest(),
        )
    return out


def talks(spark, rows):
    names = "conv_id long, turn long, role string, text string, id string, cost int, place double"
    return spark.createDataFrame([(*r, "x", 1, 0.5) for r in rows], names).repartition(4)


def random_talks(seed, count, longest):
    rng = random.Random(seed)
    said = ["yes.", "no", "", " \t", "why?", "ok!", None, "long " * 50 + ".", "é ü"]
    rows = []
    for conv in range(count):
        for turn in range(rng.randint(1, longest)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", None, ""])
            rows.append((conv, turn if rng.random() < 0.9 else None, role, rng.choice(said)))
    return rows


@pytest.mark.parametrize("seed", range(3))
def test_auction_finds_the_cheapest_and_least_edits(seed):
    rng = random.Random(seed)
    for size in [0, 1, 2, 3, 5, 31, 32, 33, 64, 100, 300]:
        for _ in range(12):
            rows = [(rng.choice("suuaa-"), rng.choice([0, 0, 0, 1, 2, 3])) for _ in range(size)]
            cost, edits = repair.cheapest("".join(f"{a}{f}" for a, f in rows).encode())
            assert (cost, "".join(edits)) == plain_cheapest(rows)


def test_prices_are_feasible_and_tight_along_the_trace():
    arcs, end = repair.lattice("u0s0a3a0u2", tuple(c for c, _ in repair.END))
    price = repair.auction(arcs, end, range(4))
    assert all(price[node] <= cost + price[to] for node, out in enumerate(arcs) for _, cost, to in out)
    assert price[0] == plain_cheapest([("u", 0), ("s", 0), ("a", 3), ("a", 0), ("u", 2)])[0]


@pytest.mark.parametrize("damaged", [True, False])
def test_repair_equals_a_plain_pass(spark, damaged):
    rows = random_talks(1, 60, 14) + [(None, 0, "user", "hi."), (None, None, None, None)]
    rows += [(900, k, "assistant" if k % 2 else "user", f"turn {k}." if k % 7 else "again.") for k in range(700)]
    rows += [(901, 3, "user", "same.")] * 90 + [(902, None, "user", "a.")] * 3 + [(903, 0, "user", LONG * 30)]
    rows += [(904, -(2**62), "user", "low."), (904, 2**61, "assistant", "high.")]
    found = repair.repair_conversations(talks(spark, rows), damaged=damaged).collect()
    want = plain_repair(rows, damaged)
    assert {r[0]: tuple(r)[1:] for r in found} == want and len(found) == len(want)


def test_conversations_that_lose_all_rows_stay(spark):
    lost = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    row = repair.repair_conversations(talks(spark, [(lost, 0, "user", "hi.")]), damaged=True).collect()
    assert [tuple(r) for r in row] == [(lost, 0, 0, 0, 0, 0, 0, "", sha256(b"").hexdigest())]
    assert repair.repair_conversations(talks(spark, []), damaged=True).collect() == []


def test_repair_query_over_its_whole_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    found = LLM_QUERIES["op11_structure_repair"](spark, SF)
    assert found.columns == "conv_id gaps blank duplicate truncated illegal cost audit repaired_sha256".split()
    assert {r[0]: tuple(r)[1:] for r in found.collect()} == plain_repair(rows)


# vectors


def vectors(spark, rows):
    names = "vec_id long, embedding array<float>, id string, component int, n int, vector double"
    return spark.createDataFrame([(i, v, "x", 0, 0, 0.5) for i, v in rows], names).repartition(3)


def plain_whitening(matrix):
    """(whitened up to sign, explained, exact deviations) by an eigendecomposition of the covariance."""
    x = np.floor(1024 * np.asarray(matrix, "f4").astype("f8")) + 100000
    n, sums = len(x), x.sum(axis=0)
    centred = x - sums / n
    cov = centred.T @ centred / n
    values, axes = np.linalg.eigh(cov)
    values, axes = values[::-1][:8], axes[:, ::-1][:, :8]
    off = n * x.astype(object) - sums.astype(object)
    return centred @ axes / np.sqrt(values), values / np.trace(cov), [int(v) for v in (off**2).sum(axis=1)]


def check_whitening(found, ids, matrix):
    white, share, deviation = plain_whitening(matrix)
    kept = white.shape[1]
    got = np.full(white.shape, np.nan)
    for r in found:
        got[ids.index(r.id), r.component - 1] = r.whitened
        assert r.n == len(ids) and r.deviation == deviation[ids.index(r.id)]
        assert abs(r.explained - share[r.component - 1]) <= 1e-10 * share[r.component - 1] and r.identity_error < 1e-9
    assert len(found) == len(ids) * kept
    sign = np.sign((got * white).sum(axis=0))
    assert np.abs(got * sign - white).max() < 1e-6


def test_whitening_equals_an_eigendecomposition(spark):
    rng = np.random.default_rng(0)
    matrix = (rng.normal(size=(400, 12)) * np.geomspace(1, 0.02, 12)).astype("f4")
    ids = list(range(400))
    rows = [(i, v.tolist()) for i, v in zip(ids, matrix)]
    broken = [(500, None), (501, []), (502, [None] * 12), (503, [float("nan")] * 12), (504, [float("inf")] * 12)]
    found = whitening.whiten_vectors(vectors(spark, rows + broken)).collect()
    check_whitening(found, ids, matrix)


def test_badly_conditioned_vectors(spark):
    rng = np.random.default_rng(1)
    basis = np.linalg.qr(rng.normal(size=(10, 10)))[0]
    matrix = (rng.normal(size=(300, 10)) * np.geomspace(3e5, 1, 10) @ basis).astype("f4")
    rows = [(i, v.tolist()) for i, v in enumerate(matrix)]
    model = whitening.fit(vectors(spark, rows))[10]
    x = np.floor(1024 * matrix.astype("f8")) + 100000
    singular = np.linalg.svd(x - x.mean(axis=0), compute_uv=False)
    assert np.allclose(np.sqrt(model.variances * 300), singular[:8], rtol=1e-8) and model.identity_error < 1e-8


def test_directions_without_variance_give_no_rows(spark):
    rng = np.random.default_rng(2)
    part = rng.normal(size=(50, 3)).astype("f4")
    matrix = np.hstack([part, part, np.ones((50, 2), "f4")])
    model = whitening.fit(vectors(spark, [(i, v.tolist()) for i, v in enumerate(matrix)]))[8]
    assert len(model.variances) == 3 and model.identity_error < 1e-9
    assert whitening.whiten_vectors(vectors(spark, [(1, [0.5, 0.25])] * 4)).collect() == []
    assert whitening.whiten_vectors(vectors(spark, [])).collect() == []


def test_few_vectors_widths_repeats_and_null_ids(spark):
    rows = [(1, [1.0, 0.0]), (None, [0.0, 2.0]), (1, [1.0, 0.0]), (7, [3.0]), (8, [4.0]), (9, [9.0])]
    found = whitening.whiten_vectors(vectors(spark, rows)).collect()
    assert Counter((r.id, r.n) for r in found) == {(1, 3): 2, (None, 3): 1, (7, 3): 1, (8, 3): 1, (9, 3): 1}
    with pytest.raises(Exception, match="too large"):
        whitening.fit(vectors(spark, [(1, [1e30, 1.0])]))


def test_deviations_beyond_a_long_are_exact():
    model = whitening.Whitening(10**9, np.array([0, 0]), np.eye(2), np.ones(2), np.ones(2), 1)
    assert whitening._deviations(np.array([[10**6, 5]]), model) == [10**30 + 25 * 10**18]


def test_whitening_query_over_its_whole_table(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    found = LLM_QUERIES["op12_whitening"](spark, SF)
    assert found.columns == "vec_id component n deviation whitened explained identity_error".split()
    check_whitening(found.withColumnRenamed("vec_id", "id").collect(), [r.vec_id for r in rows], [r.embedding for r in rows])


# shards


def sharded(rows, shards, seed="0"):
    """(id, source, text) rows with their shards, by plain sorting."""
    by_source = defaultdict(list)
    for i, source, text in rows:
        data = (text or "").encode()
        draw = md5(f"{seed}:{'' if i is None else i}".encode()).hexdigest()
        key = (draw, i is not None, i or 0, len(data) + 16, zlib.crc32(data))
        by_source[source].append((key, i, source, len(data) + 16, zlib.crc32(data)))
    line = []
    for source, members in by_source.items():
        for r, (_, *row) in enumerate(sorted(members)):
            line.append((((2 * r + 1) / (2 * len(members)), source is not None, source or "", r), row))
    line.sort(key=lambda x: x[0])
    starts = [-(-s * len(line) // shards) for s in range(shards + 1)]
    return [(*row, s, p - starts[s]) for p, (_, row) in enumerate(line) for s in [p * shards // max(1, len(line))]]


def sources(spark, rows):
    names = "doc_id long, source string, text string, id string, shard int, slot int, size string, salt int"
    return spark.createDataFrame([(*r, "x", 1, 2, "y", 3) for r in rows], names).repartition(3)


CASES = [(i, ["a", "b", None, "", "c"][k % 5], t) for k, (i, t) in enumerate(TEXTS)] + [(9, "a", "same")] * 40


@pytest.mark.parametrize("shards", [1, 3, 40, 500])
def test_shards_equal_plain_sorting(spark, shards):
    found = sharding.shard_rows(sources(spark, CASES), shards).collect()
    got = [(r.id, r.source, r.size, r.text_crc32, r.shard, r.slot) for r in found]
    assert by_text(got) == by_text(sharded(CASES, shards))
    assert {(r.law, r.grown_shard) for r in found} == {("rows", None)}


def test_every_shard_holds_the_mixture(spark):
    rows = [(i, "hot" if i % 3 else f"s{i % 8}", "text" if i % 4 else f"t{i}") for i in range(6000)]
    found = sharding.shard_rows(sources(spark, rows), 40, seed="7").collect()
    sizes = Counter(r.shard for r in found)
    assert set(sizes.values()) == {150} and len(sizes) == 40
    totals = Counter(r.source for r in found)
    for (_, source), n in Counter((r.shard, r.source) for r in found).items():
        assert abs(n - totals[source] / 40) <= 2
    assert sharding.shard_rows(sources(spark, []), 40).collect() == []
    with pytest.raises(ValueError):
        sharding.shard_rows(sources(spark, []), 0)


def test_written_shards_hold_carried_texts_in_slot_order(spark, tmp_path):
    rows = [(i, f"s{i % 3}", f"text {i}" * (1 + i % 5)) for i in range(200)]
    given = sources(spark, rows).withColumnRenamed("text", "a text`.")
    found = sharding.shard_rows(given, 7, text_column="a text`.", carry=["a text`."])
    sharding.write_shards(found, f"file://{tmp_path}/shards")
    back = spark.read.parquet(f"file://{tmp_path}/shards").collect()
    assert by_text((r.id, r["a text`."]) for r in back) == by_text((i, t) for i, _, t in rows)
    for shard in range(7):
        one = spark.read.parquet(f"file://{tmp_path}/shards/shard={shard}").collect()
        assert sorted(r.slot for r in one) == list(range(len(one)))
    with pytest.raises(ValueError):
        sharding.shard_rows(documents(spark).withColumnRenamed("id", "shard"), 7, source_column="kept", carry=["shard"])


def test_shard_query_is_plain_sorting(spark):
    rows = [(r.doc_id, r.source, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    found = LLM_QUERIES["op13_stratified_shards"](spark, SF).collect()
    got = [(r.doc_id, r.size, r.text_crc32, r.shard, r.slot) for r in found]
    assert by_text(got) == by_text((i, *rest) for i, _, *rest in sharded(rows, 40)) and "op13_stratified_shards" in LLM_ORACLES
