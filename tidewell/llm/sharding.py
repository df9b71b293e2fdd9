"""Shards of equal row counts whose mixture of sources is that of the whole table.

Rows are shuffled by a seeded digest inside each source and ranked there. A row's fractional rank (rank + 1/2) / n spreads
the n rows of its source evenly over 0 to 1, so that any stretch of the table in the order of fractional ranks holds every
source in proportion. That order is cut into stretches of equal length.

Both ranks come from a range-partitioned sort: a row's place in its partition plus the rows of the partitions before it.
No source, however large, is one group of a window or one task, and only counts per partition are gathered.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.llm.common import named, pick, stored

LAW = "rows"  # the law of size that holds: counts at most one apart
ROW_BYTES = 16  # what a row counts beside its text
IN_PART = (1 << 33) - 1  # the bits of a generated id that count rows inside a partition


def _numbered(rows: DataFrame, order: Sequence[Column], label: str) -> DataFrame:
    """``rows`` sorted over range partitions and written, with ``part`` and ``idx``, their place in it."""
    ranges = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = ranges.withColumn("place", F.monotonically_increasing_id())
    placed = placed.withColumns({"part": F.shiftright("place", 33), "idx": F.col("place").bitwiseAND(F.lit(IN_PART))})
    return stored(placed.drop("place"), label)


def _with_offsets(rows: DataFrame, group: str | None, rank: str, total: str) -> DataFrame:
    """Adds ``rank`` (from 0, in the whole group or table) and ``total`` (its rows) to numbered rows.

    Ranges are contiguous, so (group, part) has at most as many pairs as there are groups and partitions together.
    """
    keys = ([group] if group else []) + ["part"]
    counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("here"), F.min("idx").alias("first"))
    whole = Window.partitionBy(*([group] if group else []))
    before = whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        *[F.col(k).alias(f"of_{k}") for k in keys],
        (F.coalesce(F.sum("here").over(before), F.lit(0)) - F.col("first")).alias("offset"),
        F.sum("here").over(whole).alias(total),
    )
    on = [F.col(k).eqNullSafe(F.col(f"of_{k}")) for k in keys]
    joined = rows.join(offsets, on, "inner").withColumn(rank, F.col("offset") + F.col("idx"))
    return joined.drop("offset", "part", "idx", *[f"of_{k}" for k in keys])


def shard_rows(
    rows: DataFrame,
    shards: int,
    seed: str = "0",
    id_column: str = "doc_id",
    source_column: str = "source",
    text_column: str = "text",
    carry: Sequence[str] = (),
) -> DataFrame:
    """(id, source, size, text_crc32, law, shard, slot, grown_shard, then ``carry``): every row with its place in a shard.

    The law is ``rows``: shards are numbered from 0, their counts differ by one at most, slots run from 0 without gaps.
    Size is the text's UTF-8 bytes plus 16. ``grown_shard`` is null, as one more shard moves rows of all shards.

    A null source is a source of its own. A null text counts no bytes and has the checksum of an empty one; texts are only
    measured, so very long ones are as good as others. Rows of a null or repeated id are told apart by size and checksum,
    and identical rows are interchangeable; all of them get places of their own. Rows of equal texts are no unit: they are
    spread like all others, as shards of equal counts could not hold a large group together. With fewer rows than shards
    some shards stay empty; an empty table gives an empty result. ``carry`` names further columns, in whole; no name of
    the input can clash, as carried columns keep their names only where the result does not use them.
    """
    if shards < 1:
        raise ValueError("there must be a shard")
    kept = {name: f"carried {k}" for k, name in enumerate(carry)}
    clash = set(kept) & set(COLUMNS)
    if clash:
        raise ValueError(f"the result has columns of these names itself: {sorted(clash)}")
    text = F.coalesce(F.col("text"), F.lit(""))
    narrow = pick(rows, id=id_column, source=source_column, text=text_column, **{v: k for k, v in kept.items()})
    narrow = narrow.select(
        "id",
        "source",
        (F.octet_length(text) + F.lit(ROW_BYTES)).cast("bigint").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit("")))).alias("draw"),
        F.monotonically_increasing_id().alias("salt"),  # splits identical rows among ranges
        *[named(v) for v in kept.values()],
    )
    order = ["source", "draw", "id", "size", "text_crc32", "salt"]
    drawn = _numbered(narrow, [F.col(c).asc_nulls_first() for c in order], "shuffled").drop("draw", "salt")
    ranked = _with_offsets(drawn, "source", "rank", "n")
    fraction = ((F.col("rank") * 2 + 1).cast("double") / (F.col("n") * 2).cast("double")).alias("fraction")
    ranked = ranked.select(*[c for c in ranked.columns if c != "n"], fraction)
    mixed = _numbered(ranked, [F.col("fraction"), F.col("source").asc_nulls_first(), F.col("rank")], "interleaved")
    mixed = _with_offsets(mixed, None, "position", "total").drop("rank")
    shard = F.floor(F.col("position").cast("decimal(28,0)") * shards / F.col("total")).cast("int")
    start = F.ceil(F.col("shard").cast("decimal(28,0)") * F.col("total") / shards).cast("bigint")
    mixed = mixed.withColumn("shard", shard).withColumn("slot", F.col("position") - start)
    out = mixed.withColumns({"law": F.lit(LAW), "grown_shard": F.lit(None).cast("int")})
    return out.select(*COLUMNS, *[named(v).alias(k) for k, v in kept.items()])


COLUMNS = "id source size text_crc32 law shard slot grown_shard".split()


def write_shards(sharded: DataFrame, path: str) -> None:
    """A folder ``shard=k`` for each shard. Rows come in slot order from file to file, as ranges of positions are tasks."""
    sharded.write.partitionBy("shard").parquet(path)
