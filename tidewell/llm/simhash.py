"""SimHash near duplicates by bit-sliced comparison of fingerprints.

Fingerprints that differ in at most ``radius`` bits agree on all bits of some blocks of bits, so they meet in a bucket
of a table keyed by these blocks. Inside buckets the fingerprints are stored as vertical bit planes: one machine word
holds the same bit of 64 fingerprints. A shift by s lanes sets every fingerprint against the one s places further on,
the differing bits are added by carry-save counters for all lanes of a word together, and words whose lanes all exceed
the radius are abandoned. Buckets give spanning links only; components are contracted over distinct fingerprints.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from fractions import Fraction
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.llm.common import bytes_of, kind, named, pick, slices, stored
from tidewell.operators.segment import connected_components

SEED = 42
PART = 8192  # a bucket of more distinct fingerprints is compared part against part
CHUNK = 1 << 16
ALIKE_NODES, ALIKE_SHINGLES = 4096, 1 << 21  # texts and shingles of a part whose sets are compared
FULL = np.uint64(2**64 - 1)


def fingerprint(text: bytes, shingle: int = 3) -> int:
    """64-bit SimHash of the shingles of words (ASCII white space apart, A-Z lowered); 0 without words."""
    words = text.lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), "i8", len(words)) + 1)
    starts = np.append(0, ends[:-1])
    last = max(1, len(words) - shingle + 1)
    ends = ends[min(shingle, len(words)) - 1 :] - 1
    ones = np.zeros(64, "i8")
    for at in range(0, last, CHUNK):
        parts = [line[a:b] for a, b in zip(starts[at : min(at + CHUNK, last)].tolist(), ends[at : at + CHUNK].tolist())]
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, parts, repeat(SEED)), "<u8", len(parts))
        bits = np.unpackbits(hashes.view("u1").reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype="i8")
    return int.from_bytes(np.packbits(2 * ones > last, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, shingle: int = 3, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, fp): the fingerprint of each row as a signed 64-bit integer; a null text has no words."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            found = np.array([fingerprint(text, shingle) for text in bytes_of(batch, "text")], "u8")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view("i8"))], ["id", "fp"])

    return pick(docs, id=id_column, text=text_column).mapInArrow(run, f"id {kind(docs, id_column)}, fp bigint")


def _planes(prints: np.ndarray) -> np.ndarray:
    """Bit planes: row b holds bit b of all fingerprints, 64 to a word."""
    bits = np.unpackbits(prints.view("u1").reshape(len(prints), -1), axis=1, bitorder="little")
    return _words(bits.T)


def _words(bits: np.ndarray) -> np.ndarray:
    packed = np.packbits(bits, axis=-1, bitorder="little")
    pad = -packed.shape[-1] % 8
    packed = np.pad(packed, [(0, 0)] * (packed.ndim - 1) + [(0, pad)])
    return np.ascontiguousarray(packed).view("<u8")


def _shifted(planes: np.ndarray, lanes: int) -> np.ndarray:
    """Planes moved down by a number of lanes."""
    word, bit = divmod(lanes, 64)
    moved = np.zeros_like(planes)
    moved[..., : planes.shape[-1] - word] = planes[..., word:]
    if bit:
        upper = np.zeros_like(planes)
        upper[..., : max(0, planes.shape[-1] - word - 1)] = planes[..., word + 1 :]
        moved = (moved >> np.uint64(bit)) | (upper << np.uint64(64 - bit))
    return moved


def _within(planes: np.ndarray, others: np.ndarray, valid: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """(words, lanes): words that hold lanes at most ``radius`` bits apart, and these lanes as bits."""
    live = np.flatnonzero(valid)
    over = ~valid[live]
    counters = [np.zeros(len(live), "u8") for _ in range(radius.bit_length())]
    for first in range(0, len(planes), 8):
        if not len(live):
            break
        for carry in planes[first : first + 8, live] ^ others[first : first + 8, live]:
            for k, counter in enumerate(counters):
                counters[k], carry = counter ^ carry, counter & carry
            over |= carry
        more, equal = np.zeros(len(live), "u8"), np.full(len(live), FULL)
        for k in range(len(counters) - 1, -1, -1):
            if radius >> k & 1:
                equal &= counters[k]
            else:
                more |= equal & counters[k]
                equal &= ~counters[k]
        keep = (over | more) != FULL
        if not keep.all():  # all lanes of these words exceed the radius
            live, over, more = live[keep], over[keep], more[keep]
            counters = [counter[keep] for counter in counters]
    return live, ~(over | more) if len(live) else live.astype("u8")


def linked(prints: np.ndarray, groups: np.ndarray, radius: int) -> np.ndarray:
    """For each fingerprint the place of the first one it is linked to, directly or not, inside its group.

    ``prints`` has one word for each 64 bits of a fingerprint; ``groups`` is sorted, and only members of one group are
    compared.
    """
    prints = np.ascontiguousarray(prints).reshape(len(prints), -1)
    root = np.arange(len(prints))
    starts = np.flatnonzero(np.append(True, groups[1:] != groups[:-1]))
    sizes = np.repeat(np.diff(np.append(starts, len(groups))), np.diff(np.append(starts, len(groups))))
    shift, place = 0, root
    while True:
        shift += 1
        if shift & (shift - 1) == 0:  # lay out anew the groups that are still large enough
            place = np.flatnonzero(sizes > shift)
            planes, group = (_planes(prints[place]), groups[place]) if len(place) else (None, None)
        if len(place) <= shift or not (sizes[place] > shift).any():
            break
        valid = _words(np.append(group[shift:] == group[:-shift], np.zeros(shift, bool)))
        words, lanes = _within(planes, _shifted(planes, shift), valid, radius)
        if not len(words):
            continue
        hits = np.flatnonzero(np.unpackbits(lanes.view("u1"), bitorder="little"))
        hits = words[hits // 64] * 64 + hits % 64
        left, right = place[hits], place[hits + shift]
        apart = root[left] != root[right]
        if apart.any():
            for a, b in zip(left[apart].tolist(), right[apart].tolist()):
                while root[a] != a:
                    a = root[a]
                while root[b] != b:
                    b = root[b]
                root[max(a, b)] = min(a, b)
            while (root[root] != root).any():
                root = root[root]
    return root


def _keys(fp: Column, radius: int) -> Column:
    """Array of (table, key): bits of the blocks on which two linked fingerprints must agree somewhere."""
    blocks = radius + 2
    edges = [64 * k // blocks for k in range(blocks + 1)]
    masks = [sum(1 << bit for bit in range(a, b)) for a, b in zip(edges, edges[1:])]
    tables = [masks[a] | masks[b] for a, b in combinations(range(blocks), 2)]
    signed = [mask - (1 << 64) if mask >> 63 else mask for mask in tables]
    return F.array(*[
        F.struct(F.lit(n).alias("table"), fp.bitwiseAND(F.lit(mask)).alias("key")) for n, mask in enumerate(signed)
    ])


def links(prints: DataFrame, keys: Column, radius: int, words: Sequence[str] = ("fp",), node: str = "fp") -> DataFrame:
    """(a, b): links between nodes that connect the same ones as all pairs within ``radius`` bits in a bucket do.

    ``words`` are the columns of a fingerprint, 64 bits each; ``keys`` gives the buckets of a row as (table, key).
    """
    placed = prints.select(F.col(node).alias("node"), *words, F.explode(keys).alias("k"))
    placed = placed.select("node", *words, "k.table", "k.key")
    sizes = placed.groupBy("table", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    own = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
    meetings = F.transform(
        F.sequence(F.lit(0), F.col("parts") - 1),
        lambda other: F.struct(F.least("own", other).alias("i"), F.greatest("own", other).alias("j")),
    )
    met = placed.join(sizes, ["table", "key"]).withColumn("parts", F.ceil(F.col("n") / PART).cast("int"))
    met = met.withColumn("own", own).withColumn("m", F.explode(meetings))
    group = ["table", "key", "i", "j"]
    met = met.select("node", *words, "table", "key", "m.i", "m.j").repartition(*group).sortWithinPartitions(*group)
    width = 1 + len(words)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        rows = 0
        for batch in batches:
            held.append(np.stack([column.to_numpy(zero_copy_only=False).astype("i8") for column in batch.columns]))
            rows += batch.num_rows
            if rows >= CHUNK:
                block = np.concatenate(held, axis=1)
                change = np.flatnonzero((block[width:, 1:] != block[width:, :-1]).any(axis=0))
                end = change[-1] + 1 if len(change) else 0  # the last group may go on in the next batch
                yield from compare(block[:, :end])
                held, rows = [block[:, end:]], block.shape[1] - end
        if rows:
            yield from compare(np.concatenate(held, axis=1))

    def compare(block: np.ndarray) -> Iterator[pa.RecordBatch]:
        if not block.shape[1]:
            return
        groups = np.append(0, np.cumsum((block[width:, 1:] != block[width:, :-1]).any(axis=0)))
        root = linked(np.ascontiguousarray(block[1:width].T).view("u8"), groups, radius)
        moved = np.flatnonzero(root != np.arange(len(root)))
        yield pa.RecordBatch.from_arrays([pa.array(block[0, moved]), pa.array(block[0, root[moved]])], ["a", "b"])

    return met.mapInArrow(run, "a bigint, b bigint")


def near_duplicates(
    docs: DataFrame, shingle: int = 3, radius: int = 3, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """(id, fp, component_id): fingerprint of each row, and the smallest id reachable over links, its own included.

    Rows with fingerprints at most ``radius`` bits apart are linked. A null or empty text has fingerprint zero and is
    linked like any other; repeated rows keep their rows; a null id is kept, but names a component only if no other
    id can; an empty table gives an empty one. Other columns are not carried.
    """
    rows = stored(fingerprints(docs, shingle, id_column, text_column), "fingerprints")
    prints = rows.groupBy("fp").agg(F.min("id").alias("least"))
    roots = connected_components(links(prints, _keys(F.col("fp"), radius), radius))
    named = prints.join(roots, F.col("fp") == F.col("node"), "left")
    named = named.select("fp", "least", F.coalesce("component", "fp").alias("root"))
    smallest = named.groupBy("root").agg(F.min("least").alias("component_id"))
    return rows.join(named.join(smallest, "root").select("fp", "component_id"), "fp").select("id", "fp", "component_id")


def _odd_numbers(count: int, seed: int) -> np.ndarray:
    """Multipliers that mix 64-bit hashes anew."""
    names = [f"{seed}-{k}" for k in range(count)]
    return np.array([xxhash.xxh64_intdigest(name) | 1 for name in names], "u8")


def shingle_set(text: bytes, shingle: int) -> np.ndarray:
    """The set of a text's shingles as ascending 64-bit hashes; empty without words."""
    found = text.lower().split()
    if not found:
        return np.zeros(0, "u8")
    line = b" ".join(found)
    ends = np.cumsum(np.fromiter(map(len, found), "i8", len(found)) + 1)
    starts = np.append(0, ends[:-1])[: max(1, len(found) - shingle + 1)].tolist()
    ends = (ends[min(shingle, len(found)) - 1 :] - 1).tolist()
    parts = {line[a:b] for a, b in zip(starts, ends)}
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, parts, repeat(SEED)), "u8", len(parts)))


def wide_print(hashes: np.ndarray, words: int, tables: int, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """(fingerprint of 64 bits for each word, bucket keys) of a set of shingles.

    A key joins ``rows`` smallest values of the shingles under different mixings, so two texts of similarity s share one
    with probability s to the power ``rows``.
    """
    if not len(hashes):
        return np.zeros(words, "u8"), np.zeros(tables, "u8")
    ones = np.zeros(64 * words, "i8")
    least = np.full(tables * rows, FULL)
    mixes, turns = _odd_numbers(words, 1), _odd_numbers(tables * rows, 2)
    for at in range(0, len(hashes), 4096):
        some = hashes[at : at + 4096, None]
        mixed = some * mixes
        mixed ^= mixed >> np.uint64(32)
        mixed *= turns[0]
        mixed ^= mixed >> np.uint64(29)
        bits = np.unpackbits(np.ascontiguousarray(mixed).view("u1"), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype="i4")
        least = np.minimum(least, (some * turns).min(axis=0))
    print_ = np.packbits(2 * ones > len(hashes), bitorder="little").view("u8")
    keys = least.reshape(tables, rows)
    joined = keys[:, 0].copy()
    for k in range(1, rows):
        joined = (joined ^ (joined >> np.uint64(31))) * turns[1] + keys[:, k]
    return print_, joined


def alike(
    sets: Sequence[np.ndarray], prints: np.ndarray, sides: np.ndarray, radius: int, least: Fraction
) -> np.ndarray:
    """For each set the place of the first one it is linked to, directly or not, by a Jaccard similarity of ``least``.

    Sets are compared whose prints differ in at most ``radius`` bits, each pair exactly unless it is linked already.
    With two different ``sides`` only sets of different sides are compared.
    """
    up, down = least.numerator, least.denominator
    sizes, root = np.array([len(one) for one in sets]), np.arange(len(sets))
    known, places = np.unique(np.concatenate(sets), return_inverse=True)
    places = np.split(places, np.cumsum(sizes)[:-1])
    marks, across = np.zeros(len(known), bool), bool((sides != sides[0]).any())
    for a in range(len(sets) - 1):
        small, large = np.minimum(sizes[a + 1 :], sizes[a]), np.maximum(sizes[a + 1 :], sizes[a])
        open_ = (root[a + 1 :] != root[a]) & (small * down >= large * up)
        if across:
            open_ &= sides[a + 1 :] != sides[a]
        others = np.flatnonzero(open_) + a + 1
        others = others[np.bitwise_count(prints[others] ^ prints[a]).sum(axis=1, dtype="i8") <= radius]
        if not len(others):
            continue
        marks[places[a]] = True
        starts = np.append(0, np.cumsum(sizes[others])[:-1])
        shared = np.add.reduceat(marks[np.concatenate([places[b] for b in others])], starts, dtype="i8")
        marks[places[a]] = False
        near = others[shared * down >= (sizes[a] + sizes[others] - shared) * up]
        if len(near):
            merged = np.append(root[near], root[a])
            root[np.isin(root, merged)] = merged.min()
    return root


def similar_links(members: DataFrame, shingle: int, radius: int, least: Fraction, prints: Sequence[str]) -> DataFrame:
    """(a, b): links between nodes that connect the same ones as all pairs of a group that ``alike`` compares do.

    ``members`` has (root, node, size, text) and the prints, ``root`` naming the group. A group too large for a task is
    compared part against part.
    """
    sums = members.groupBy("root").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("total"))
    parts = F.greatest(F.ceil(F.col("n") / ALIKE_NODES), F.ceil(F.col("total") / ALIKE_SHINGLES), F.lit(1)).cast("int")
    met = members.join(sums.select("root", parts.alias("parts")), "root")
    met = met.withColumn("own", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    meetings = F.transform(
        F.sequence(F.lit(0), F.col("parts") - 1),
        lambda other: F.struct(F.least("own", other).alias("i"), F.greatest("own", other).alias("j")),
    )
    group = ["root", "i", "j"]
    met = met.withColumn("m", F.explode(meetings)).withColumns({"i": F.col("m.i"), "j": F.col("m.j")})
    met = met.select(*group, "own", "node", *prints, "text").repartition(*group).sortWithinPartitions(*group, "node")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            numbers = np.stack([batch.column(k).to_numpy(zero_copy_only=False) for k in range(batch.num_columns - 1)])
            keys, texts = numbers[:3].T, bytes_of(batch, "text")
            ends = [*(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(keys)]
            for start, end in zip([0, *ends], ends):
                if start == end:
                    continue
                key = tuple(keys[start].tolist())
                if key != now:
                    yield from compare(held)
                    now, held = key, []
                held.append((numbers[3:, start:end], [shingle_set(text, shingle) for text in texts[start:end]]))
        yield from compare(held)

    def compare(held: list[tuple[np.ndarray, list[np.ndarray]]]) -> Iterator[pa.RecordBatch]:
        if not held:
            return
        block, sets = np.concatenate([one for one, _ in held], axis=1), [one for _, some in held for one in some]
        root = alike(sets, np.ascontiguousarray(block[2:].T).view("u8"), block[0], radius, least)
        moved = np.flatnonzero(root != np.arange(len(root)))
        if len(moved):
            yield pa.RecordBatch.from_arrays([pa.array(block[1, moved]), pa.array(block[1, root[moved]])], ["a", "b"])

    return met.mapInArrow(run, "a bigint, b bigint")


def similar_rows(
    docs: DataFrame,
    shingle: int = 5,
    similarity: float = 0.8,
    radius: int = 64,
    words: int = 4,
    tables: int = 16,
    rows: int = 4,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """``docs`` without the rows that have a similar one of smaller id: one row of each group stays, unchanged.

    Two texts are similar if their sets of shingles have a Jaccard similarity of ``similarity`` or more. Candidates are
    texts whose wide fingerprints differ in at most ``radius`` bits. That many differing bits leave no block of bits
    alike, so buckets are keyed by minima of the shingles' hashes instead; inside buckets the comparison is the bit-sliced
    one. Its links only gather groups of candidates; inside these, pairs within the radius are compared by their sets, and
    only pairs that are similar link. With the defaults, by the binomial spread, 64 bits lose about 1 of 100,000 pairs at
    exactly 0.8, and the buckets 2 of 10,000.

    A null text has no words, and texts without words are similar to each other. Of a group the row of the smallest id
    stays, a null id being the largest; of rows equal in that too any one. All columns are kept; an empty table stays
    empty.
    """
    prints = [f"print{k}" for k in range(words)]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, names[1]):
            sets = [shingle_set(text, shingle) for text in bytes_of(batch, names[1])]
            made = [wide_print(hashes, words, tables, rows) for hashes in sets]
            fps = np.stack([one[0] for one in made]).view("i8")
            keys = np.stack([one[1] for one in made]).view("i8")
            offsets = pa.array(np.arange(len(made) + 1, dtype="i4") * tables)
            lists = pa.ListArray.from_arrays(offsets, pa.array(keys.ravel()))
            more = [pa.array(np.ascontiguousarray(fps[:, k])) for k in range(words)]
            nodes = np.array([xxhash.xxh64_intdigest(hashes.tobytes()) for hashes in sets], "u8").view("i8")
            more += [lists, pa.array(nodes), pa.array([len(hashes) for hashes in sets], pa.int64())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], [*names, *prints, "keys", "node", "size"])

    order = [id_column, text_column, *(c for c in docs.columns if c not in (id_column, text_column))]
    inner = docs.select(*[named(c).alias(f"c{k}") for k, c in enumerate(order)])  # no name can clash
    names = inner.columns
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in inner.schema)
    schema = f"{kinds}, {', '.join(f'{c} bigint' for c in prints)}, keys array<bigint>, node bigint, size bigint"
    found = stored(inner.mapInArrow(run, schema).withColumn("nr", F.monotonically_increasing_id()), "prints")
    first = F.struct(F.col("c0").isNull().alias("none"), F.col("c0").alias("id"), F.col("nr"))
    distinct = found.groupBy("node", "size", *prints).agg(F.min(first).alias("first"), F.first("keys").alias("keys"))
    distinct = stored(distinct, "nodes")  # one row for each set of shingles
    keys = F.transform("keys", lambda key, k: F.struct(k.alias("table"), key.alias("key")))
    near = connected_components(links(distinct, keys, radius, prints, "node"))
    members = distinct.join(near.withColumnRenamed("component", "root"), "node")
    members = members.select("root", "node", "size", *prints, F.col("first.nr").alias("nr"))
    members = members.join(found.select("nr", F.col("c1").alias("text")), "nr")
    roots = connected_components(similar_links(members, shingle, radius, Fraction(str(similarity)), prints))
    grouped = distinct.select("node", "first").join(roots, "node", "left")
    kept = grouped.groupBy(F.coalesce("component", "node").alias("root")).agg(F.min("first").alias("first"))
    rest = found.select(*names, "nr").join(kept.select(F.col("first.nr").alias("nr")), "nr", "left_semi")
    return rest.select(*[F.col(f"c{k}").alias(c) for k, c in enumerate(order)]).select(*map(named, docs.columns))


def hex_print(fp: Column) -> Column:
    """16 lowercase hex digits."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
