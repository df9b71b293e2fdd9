"""Document fingerprints as Merkle trees over paragraphs and sections.

Leaves are sentences, and paragraphs are nodes over their sentences; a section ends at a paragraph whose digest says so,
so that an edit moves the borders of no other section. A fingerprint holds the root, the digests of the sections and
those of the leaves: equal roots mean equal texts, sections that differ locate an edit, and the leaves that two trees
share, counted with their repeats, give their likeness.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from difflib import SequenceMatcher
from hashlib import sha256
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.llm.common import kind, pick, slices, spark_of, texts_of

LEAF = re.compile(r"[^\n]{0,24}[^\n.!?|]{0,160}(?:[.!?|]+[ \t]*|\n+)?")  # a sentence or some cells; longer ones are cut
SECTION = 8  # one paragraph of so many ends a section
DIGEST = 16  # bytes of inner digests
LEAF_HEX = 10  # hex digits that a fingerprint keeps of a leaf
RANGE_ROWS = 20_000  # rows that a range of ids should have
RANGES = 1 << 14  # ranges at most
NAMES = ["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]


@dataclass(frozen=True)
class Tree:
    """Digests of a text: root, sections with the number of leaves under each, and leaves."""

    root: str
    sections: tuple[tuple[str, int], ...]
    leaves: tuple[str, ...]

    def line(self) -> str:
        """The fingerprint as one string."""
        sections = ",".join(f"{digest}*{count}" for digest, count in self.sections)
        return f"{self.root}/{sections}/{','.join(self.leaves)}"


def grow(text: str) -> Tree:
    """The tree of a text; the empty text has a root and nothing below."""
    leaves, sections, section, paragraph = [], [], [], []
    count = 0

    def close_section() -> None:
        nonlocal section, count
        sections.append((sha256(b"s" + b"".join(section)).digest()[:DIGEST], count))
        section, count = [], 0

    for leaf in LEAF.findall(text):
        if not leaf:
            continue
        digest = sha256(b"l" + leaf.encode()).digest()[:DIGEST]
        leaves.append(digest)
        paragraph.append(digest)
        count += 1
        if leaf.endswith("\n") or len(paragraph) == 64:
            whole = sha256(b"p" + b"".join(paragraph)).digest()[:DIGEST]
            section.append(whole)
            paragraph = []
            if whole[0] % SECTION == 0:
                close_section()
    if paragraph:
        section.append(sha256(b"p" + b"".join(paragraph)).digest()[:DIGEST])
    if section:
        close_section()
    root = sha256(b"r" + b"".join(digest for digest, _ in sections)).hexdigest()[: 2 * DIGEST]
    return Tree(
        root,
        tuple((digest.hex(), leaves_below) for digest, leaves_below in sections),
        tuple(digest.hex()[:LEAF_HEX] for digest in leaves),
    )


def parse(line: str) -> Tree:
    """The tree that a fingerprint string holds."""
    root, sections, leaves = line.split("/")
    pairs = (part.split("*") for part in sections.split(",") if part)
    return Tree(root, tuple((digest, int(count)) for digest, count in pairs), tuple(filter(None, leaves.split(","))))


def changed_leaves(one: Tree, other: Tree) -> list[int]:
    """Places of the leaves of ``one`` that an alignment with ``other`` leaves over: sections in order, then their leaves.

    Repeated sections count, and of sections in another order the ones out of line are moved. What ``one`` lacks is found
    from the other side.
    """
    if one.root == other.root:
        return []
    out = []
    at, there = ([0, *accumulate(count for _, count in tree.sections)] for tree in (one, other))
    for start, stop, first, last in _unequal(one.sections, other.sections):
        ours, theirs = one.leaves[at[start] : at[stop]], other.leaves[there[first] : there[last]]
        for begin, end, _, _ in _unequal(ours, theirs):
            out.extend(range(at[start] + begin, at[start] + end))
    return out


def _unequal(one: tuple, other: tuple) -> Iterator[tuple[int, int, int, int]]:
    return (code[1:] for code in SequenceMatcher(None, one, other, autojunk=False).get_opcodes() if code[0] != "equal")


def likeness(one: Tree, other: Tree) -> float:
    """Share of leaves that two trees have in common, repeats counted; 1 for equal roots."""
    if one.root == other.root:
        return 1.0
    total = len(one.leaves) + len(other.leaves)
    shared = (Counter(one.leaves) & Counter(other.leaves)).total()
    return min(2.0 * shared / total, 1 - 1e-9) if total else 1.0


def half_replaced(text: str, following: str) -> str:
    """The text with its last half of code points replaced by as many first ones of the following text, or all."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _ranges(rows: DataFrame) -> list[int]:
    """Ids that end ranges of about equal size, the largest id last; actual ids, so that ranges can share them."""
    known = rows.where(F.col("key").isNotNull())
    least = int(spark_of(rows).conf.get("spark.sql.shuffle.partitions"))
    parts = min(RANGES, max(1, least, -(-known.count() // RANGE_ROWS)))
    shares = [k / parts for k in range(1, parts + 1)]
    found = known.agg(F.percentile_approx("key", shares, 10 * parts).alias("q"), F.max("key").alias("most")).first()
    return sorted({*(found["q"] or []), *([found["most"]] if found["most"] is not None else [])})


def _place(ends: list[int]) -> tuple[Column, Column]:
    """(number of the range of ``key``, whether the key ends it): a search in blocks, then inside one block."""
    if not ends:
        return F.lit(0), F.lit(False)
    width = math.isqrt(len(ends) - 1) + 1
    table = F.array(*map(F.lit, ends)).cast("array<bigint>")
    tops = F.array(*map(F.lit, ends[width - 1 :: width])).cast("array<bigint>")
    below = lambda values: F.size(F.filter(values, lambda end: end < F.col("key")))
    block = below(tops) * width
    place = F.coalesce(block + below(F.slice(table, block + 1, width)), F.lit(0))
    return F.when(F.col("key").isNull(), 0).otherwise(place), F.coalesce(F.get(table, place) == F.col("key"), F.lit(False))


def fingerprint_edits(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) for every row.

    The next document is the one of the next smaller id, after the smallest id the one of the largest; a single
    document is its own next. Ids are integers; null ids come after all others. Rows that share an id follow one another by
    text. A null text counts as the empty one; texts are taken whole; an empty table gives an empty one; other columns are
    not carried. Rows are dealt by ranges of ids in one shuffle of the texts; a range also gets the first row of the next
    range, so that every row meets its next document in one task.
    """
    rows = pick(docs, id=id_column, text=text_column)
    rows = rows.select("id", F.col("id").cast("bigint").alias("key"), F.coalesce("text", F.lit("")).alias("text"))
    ends = _ranges(rows.select("key"))
    place, first = _place(ends)  # the row that ends a range is its first in descending order
    placed = rows.withColumns({"place": place, "first": first})
    home = F.struct(F.col("place").alias("range"), F.lit(False).alias("guest"))
    guest = F.struct(((F.col("place") + 1) % max(1, len(ends))).alias("range"), F.lit(True).alias("guest"))
    placed = placed.withColumn("at", F.explode(F.when(F.col("first"), F.array(home, guest)).otherwise(F.array(home))))
    placed = placed.select("id", "text", "at.range", "at.guest", "key").repartitionById(max(1, len(ends)), F.col("range").cast("int"))
    placed = placed.sortWithinPartitions("range", "guest", F.col("key").desc_nulls_last(), "text").drop("key")
    schema = (
        f"id {kind(docs, id_column)}, n_chars bigint, edited_sha256 string, fingerprint string,"
        " edited_fingerprint string, near_edited double, near_next double"
    )
    return placed.mapInArrow(_compared(), schema)


def _compared():
    """Rows of a range in descending order in, each with its successor; ranges follow one another, guests come last."""
    def row_of(row: tuple, following: tuple) -> tuple:
        identity, text, tree = row
        edited = half_replaced(text, following[1])
        other = grow(edited)
        digest = sha256(edited.encode()).hexdigest()
        return identity, len(text), digest, tree.line(), other.line(), likeness(tree, other), likeness(tree, following[2])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = first = last = None  # range, its first row, the row that waits for its successor
        types: list[pa.DataType] = []

        def made(rows: list[tuple]) -> pa.RecordBatch:
            columns = [pa.array(column, kind) for column, kind in zip(zip(*rows), types)]
            return pa.RecordBatch.from_arrays(columns, NAMES)

        for batch in slices(batches, "text", 1 << 20):
            if not types:
                types += [batch.schema.field(0).type, pa.int64(), *[pa.string()] * 3, *[pa.float64()] * 2]
            rows = []
            for identity, text, place, guest in zip(*(column.to_pylist() for column in batch.columns)):
                if place != now:
                    if last:  # without a guest the range is the whole table
                        rows.append(row_of(last, first))
                    now, first, last = place, None, None
                if guest and not last:
                    continue
                row = (identity, text, grow(text))
                if last:
                    rows.append(row_of(last, row))
                first = first or row
                last = None if guest else row
            if rows:
                yield made(rows)
        if last:
            yield made([row_of(last, first)])

    return run


def fingerprints(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, fingerprint) for every row, without a shuffle; a null text counts as the empty one."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            lines = [grow(text).line() for text in texts_of(batch, "text")]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lines, pa.string())], ["id", "fingerprint"])

    return pick(docs, id=id_column, text=text_column).mapInArrow(run, f"id {kind(docs, id_column)}, fingerprint string")
