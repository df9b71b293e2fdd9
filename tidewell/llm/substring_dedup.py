"""Exact removal of repeated word windows by relative Lempel-Ziv parsing against indexed reference blocks.

Every window of ``window`` words chooses the smallest of its hashed word k-grams as its anchor, so equal windows choose
equal anchors. Neighbouring windows with one anchor form a run. Anchors that occur once are dropped after one light
shuffle; the runs of the others go, as text, to the reference block of their anchor. A block indexes the windows it has
seen and factors each run greedily against them: a factor of at least one window is copied at its full length, and the
windows that cross a factor's end are looked up one by one. Factors mark both of their sides as duplicate spans.

Runs carry a digest of their words. Runs of one anchor that are equal are counted by it, combined in each task: all their
windows are duplicates, and only one of them goes to a block as text. A passage that fills a third of the corpus so reaches
its block once; an anchor with very many different runs is dealt out by the windows themselves.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm.byte_bpe import numbering
from tidewell.llm.common import blocks, bytes_of, kind, pick, slices, stored

WINDOW = 35
GRAM = 8
MIX = np.uint64(0x9E3779B97F4A7C15)  # odd, so multiplying by it loses nothing
UNMIX = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
FINISH = np.uint64(0xFF51AFD7ED558CCD)
HOT = 20_000  # an anchor with more runs is dealt out by window
BLOCK_BYTES = 16 << 20


def _mixed(values: np.ndarray) -> np.ndarray:
    values = (values ^ (values >> np.uint64(33))) * FINISH
    return values ^ (values >> np.uint64(29))


def window_runs(
    rows: Iterable[list[bytes]], window: int = WINDOW, gram: int = GRAM
) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For each list of words the runs of windows with one anchor: (anchor, first window, windows, weight, digest).

    The weight is 2 if the anchor's words stand in the text more than once, so that even a single run may repeat itself. The
    digest is one of the words of the run, wherever it stands.
    """
    number = numbering()
    places = [np.fromiter(map(number.__getitem__, words), "i4", len(words)) for words in rows]
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, number), "u8", len(number))
    inside = window - min(gram, window) + 1  # k-grams in a window
    for place in places:
        windows = len(place) - window + 1
        if windows < 1:
            yield np.empty(0, "u8"), *[np.empty(0, "i8")] * 3, np.empty(0, "u8")
            continue
        words = hashes[place]
        grams = windows + inside - 1
        total = np.zeros(grams, "u8")
        for k in range(min(gram, window)):
            total = total * MIX + words[k : k + grams]
        total = _mixed(total)
        least, width = total, 1
        while width < inside:  # sliding minimum by doubling
            step = min(width, inside - width)
            least = np.minimum(least[: len(least) - step], least[step:])
            width += step
        first = np.flatnonzero(np.append(True, least[1:] != least[:-1]))
        anchor = least[first]
        ordered = np.sort(total)
        twice = ordered[1:][ordered[1:] == ordered[:-1]]
        weight = 1 + np.isin(anchor, twice) if len(twice) else np.ones(len(first), "i8")
        count = np.diff(np.append(first, windows))
        # Words weighed by falling powers sum up to a polynomial, which a power of the start makes free of the place.
        down, up = (np.cumprod(np.append(np.uint64(1), np.full(len(words), base)), dtype="u8") for base in (UNMIX, MIX))
        behind = np.append(np.uint64(0), np.cumsum(words * down[:-1], dtype="u8"))
        digest = _mixed((behind[first + count + window - 1] - behind[first]) * up[first])
        yield anchor, first, count, weight, digest


def _keyed(docs: DataFrame, id_column: str, text_column: str, carry: Sequence[str] = ()) -> DataFrame:
    """(a, b, id, text, carried columns): a and b name a row by its id and text.

    Rows equal in both share them, as their results agree.
    """
    rows = pick(docs, id=id_column, text=text_column, **{f"c{k}": name for k, name in enumerate(carry)})
    a, b = F.xxhash64("id", "text").alias("a"), F.xxhash64("text", "id").alias("b")
    return rows.select(a, b, *rows.columns)


class Block:
    """A reference block: an index from window text to the run that shows it first, and greedy factoring against it."""

    def __init__(self, window: int):
        self.window = window
        self.clear()

    def clear(self) -> None:
        self.index: dict[bytes, tuple[int, int]] = {}
        self.whole: dict[bytes, int] = {}
        self.runs: list[tuple[bytes, list[int], list[int]]] = []  # text, starts and stops of its words
        self.marks: list[np.ndarray] = []  # per run: windows that occur elsewhere too

    def add(self, text: bytes, count: int) -> int:
        """Factor a run of ``count`` windows against the runs before it, then index what is new in it."""
        window, index = self.window, self.index
        same = self.whole.setdefault(text, len(self.runs))
        if same < len(self.runs):  # a factor as long as the run
            self.runs.append(self.runs[same])
            self.marks.append(np.ones(count, bool))
            self.marks[same][:] = True
            return len(self.runs) - 1
        sizes = np.fromiter(map(len, text.split(b" ")), "i8", count + window - 1)
        stops = (np.cumsum(sizes + 1) - 1).tolist()
        starts = (np.cumsum(sizes + 1) - 1 - sizes).tolist()
        me = len(self.runs)
        marks = np.zeros(count, bool)
        self.runs.append((text, starts, stops))
        self.marks.append(marks)
        at = 0
        while at < count:
            key = text[starts[at] : stops[at + window - 1]]
            seen = index.get(key)
            if seen is None:
                index[key] = (me, at)
                at += 1
                continue
            other, there = seen
            length = self._factor(me, at, other, there)
            marks[at : at + length] = True
            self.marks[other][there : there + length] = True
            at += length  # the windows from here on cross the factor's end: each is looked up
        return me

    def _factor(self, me: int, at: int, other: int, there: int) -> int:
        """Windows by which the match of two equal windows goes on to the right."""
        window = self.window
        text, starts, stops = self.runs[me]
        text2, starts2, stops2 = self.runs[other]
        most = min(len(stops) - at, len(stops2) - there) - window + 1
        if most <= 1:
            return 1
        low, high = 1, most  # longest common prefix by bisection over word ends
        while low < high:
            middle = (low + high + 1) // 2
            a = text[starts[at] : stops[at + window + middle - 2]]
            if a == text2[starts2[there] : stops2[there + window + middle - 2]]:
                low = middle
            else:
                high = middle - 1
        return low


def _stretches(marks: np.ndarray) -> list[tuple[int, int]]:
    """[first, stop) of the stretches of marked windows."""
    edges = np.flatnonzero(np.diff(np.concatenate([[False], marks, [False]]).astype("i1")))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist()))


def _anchor_rows(window: int, gram: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "text", BLOCK_BYTES):
            found = window_runs((text.split() for batch in block for text in bytes_of(batch, "text")), window, gram)
            for batch in block:
                parts = [next(found) for _ in range(batch.num_rows)]
                row = pa.array(np.repeat(np.arange(len(parts)), [len(part[0]) for part in parts]))
                anchor, first, count, weight, digest = (np.concatenate([part[k] for part in parts]) for k in range(5))
                ends = [batch.column(0).take(row), batch.column(1).take(row)]
                out = [anchor.view("i8"), first.astype("i4"), count.astype("i4"), weight.astype("i4"), digest.view("i8")]
                names = ["a", "b", "anchor", "first", "windows", "weight", "digest"]
                yield pa.RecordBatch.from_arrays([*ends, *map(pa.array, out)], names)

    return run


def _run_rows(window: int):
    """Runs of documents with repeated anchors as rows for the reference blocks; spans settled here pass through."""
    names = ["anchor", "sub", "run", "windows", "settled", "a", "b", "first"]
    types = [pa.int64(), pa.int32(), pa.binary(), pa.int32(), pa.bool_(), pa.int64(), pa.int64(), pa.int32()]

    def pieces(line: bytes, starts: list[int], stops: list[int], hit: dict) -> Iterator[tuple[int, int, int]]:
        """(sub-block, first window, windows): a run, or for a hot anchor its windows by their text."""
        first, count = hit["first"], hit["windows"]
        subs = -(-hit["n"] // HOT)
        if subs == 1:
            yield 0, first, count
            return
        begin, last = first, None
        for at in range(first, first + count):
            sub = xxhash.xxh64_intdigest(line[starts[at] : stops[at + window - 1]]) % subs
            if last is not None and sub != last:
                yield last, begin, at - begin
                begin = at
            last = sub
        yield last, begin, first + count - begin

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "text", BLOCK_BYTES):
            met: dict[tuple[int, bytes], list] = {}  # (sub-block, text) -> [anchor, windows, first row or None]
            spans: list[tuple[int, int, int, int]] = []
            for batch in block:
                keys = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())
                for (a, b), text, hits in zip(keys, bytes_of(batch, "text"), batch.column(batch.num_columns - 1).to_pylist()):
                    words = text.split()
                    line = b" ".join(words)
                    sizes = np.fromiter(map(len, words), "i8", len(words))
                    stops = np.cumsum(sizes + 1) - 1
                    starts, stops = (stops - sizes).tolist(), stops.tolist()
                    for hit in hits:
                        for sub, first, count in pieces(line, starts, stops, hit):
                            key = (sub, line[starts[first] : stops[first + count + window - 2]])
                            known = met.get(key)
                            if hit["whole"]:  # its spans are known, here it only shows its windows to others
                                if known is None:
                                    met[key] = [hit["anchor"], count, None]
                                elif known[2] is not None:
                                    spans.append((*known[2], count))
                                    known[2] = None
                                continue
                            if known is None:
                                met[key] = [hit["anchor"], count, (a, b, first)]
                                continue
                            if known[2] is not None:
                                spans.append((*known[2], count))
                                known[2] = None
                            spans.append((a, b, first, count))
            rows = [
                (anchor, sub, text, count, one is None, *(one or (None, None, None)))
                for (sub, text), (anchor, count, one) in met.items()
            ]
            rows += [(b, -1, None, count, True, a, b, first) for a, b, first, count in _joined(spans)]
            for at in range(0, len(rows), 5000):
                columns = zip(*rows[at : at + 5000])
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)

    return run


def _joined(spans: list[tuple[int, int, int, int]]) -> Iterator[tuple[int, int, int, int]]:
    """Spans (a, b, first, windows) with those that touch or overlap made one."""
    spans.sort()
    now = None
    for a, b, first, count in spans:
        if now and now[:2] == (a, b) and first <= now[2] + now[3]:
            now = (a, b, now[2], max(now[3], first + count - now[2]))
        else:
            if now:
                yield now
            now = (a, b, first, count)
    if now:
        yield now


def _factored(window: int):
    """Reference blocks: rows sorted by anchor and sub-block in, duplicate spans (a, b, start, stop) of words out."""

    def finish(block: Block, origin: list) -> Iterator[tuple[int, int, int, int]]:
        for marks, (settled, a, b, first) in zip(block.marks, origin):
            if not settled:
                for begin, stop in _stretches(marks):
                    yield a, b, first + begin, first + stop - 1 + window
        block.clear()
        origin.clear()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["a", "b", "start", "stop"]
        types = [pa.int64(), pa.int64(), pa.int32(), pa.int32()]

        def made(rows: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

        block, origin, now, out = Block(window), [], None, []
        for batch in slices(batches, "run"):
            for anchor, sub, text, count, settled, a, b, first in zip(*(c.to_pylist() for c in batch.columns)):
                if sub < 0:
                    out.append((a, b, first, first + count - 1 + window))
                    continue
                if (anchor, sub) != now:
                    out.extend(finish(block, origin))
                    now = (anchor, sub)
                block.add(text, count)
                origin.append((settled, a, b, first))
            if out:
                yield made(out)
                out = []
        out.extend(finish(block, origin))
        if out:
            yield made(out)

    return run


def _kept(carried: int):
    names = ["id", *[f"c{k}" for k in range(carried)], "n_words", "n_removed", "kept"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            totals, removed, texts = [], [], []
            for text, spans in zip(bytes_of(batch, "text"), batch.column(batch.num_columns - 1).to_pylist()):
                words = text.split()
                totals.append(len(words))
                if spans:
                    edges = np.zeros(len(words) + 1, "i4")
                    for span in spans:
                        edges[span["start"]] += 1
                        edges[span["stop"]] -= 1
                    words = [word for word, cover in zip(words, np.cumsum(edges).tolist()) if not cover]
                removed.append(totals[-1] - len(words))
                texts.append(b" ".join(words))
            kept = pa.array(texts, pa.binary()).cast(pa.string())
            found = [pa.array(totals, pa.int64()), pa.array(removed, pa.int64()), kept]
            yield pa.RecordBatch.from_arrays([batch.column(0), *batch.columns[2:-1], *found], names)

    return run


def duplicate_spans(
    docs: DataFrame, window: int = WINDOW, gram: int = GRAM, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """(a, b, start, stop): stretches of words covered by windows that start elsewhere too; a and b name the row."""
    return _spans(_keyed(docs, id_column, text_column), window, gram)


def _spans(rows: DataFrame, window: int, gram: int) -> DataFrame:
    schema = "a bigint, b bigint, anchor bigint, first int, windows int, weight int, digest bigint"
    anchors = stored(rows.select("a", "b", "text").mapInArrow(_anchor_rows(window, gram), schema), "anchors")
    often = anchors.groupBy("anchor").agg(F.sum("weight").alias("n")).where("n > 1").select("anchor")
    repeated = stored(anchors.join(often, "anchor"), "repeated")
    run = ["anchor", "digest", "windows"]
    place = F.struct("a", "b", "first")
    same = repeated.groupBy(*run).agg(F.count(F.lit(1)).alias("copies"), F.min(place).alias("one"))
    different = same.groupBy("anchor").agg(F.count(F.lit(1)).alias("n"))
    shown = same.join(different, "anchor").select(
        "one.a", "one.b", F.struct("one.first", "windows", "anchor", "n", (F.col("copies") > 1).alias("whole")).alias("hit")
    )
    hits = shown.groupBy("a", "b").agg(F.collect_set("hit").alias("hits"))  # bounded by the text
    runs = rows.join(hits, ["a", "b"]).mapInArrow(
        _run_rows(window),
        "anchor bigint, sub int, run binary, windows int, settled boolean, a bigint, b bigint, first int",
    )
    runs = runs.repartition("anchor", "sub").sortWithinPartitions("anchor", "sub")
    spans = "a bigint, b bigint, start int, stop int"
    whole = repeated.join(same.where("copies > 1").select(*run), run)
    stop = (F.col("first") + F.col("windows") - 1 + window).cast("int")
    whole = whole.select("a", "b", F.col("first").alias("start"), stop.alias("stop"))
    return whole.unionByName(runs.mapInArrow(_factored(window), spans))


def remove_repeats(
    docs: DataFrame,
    window: int = WINDOW,
    gram: int = GRAM,
    id_column: str = "doc_id",
    text_column: str = "text",
    carry: Sequence[str] = (),
) -> DataFrame:
    """(id, carried columns, n_words, n_removed, kept): texts without the words of windows that also start elsewhere.

    Words are what ASCII white space parts; kept words are joined by one space. Windows are judged on the input. A null
    text has no words; texts shorter than a window stay whole; rows that repeat an id, or all of a row, are documents of
    their own, so a repeated row of at least a window loses all its words; an empty table gives an empty one. Only the
    columns named in ``carry`` are carried.
    """
    rows = _keyed(docs, id_column, text_column, carry)
    spans = _spans(rows, window, gram).groupBy("a", "b")
    spans = spans.agg(F.collect_set(F.struct("start", "stop")).alias("spans"))  # bounded by the text
    joined = rows.join(spans, ["a", "b"], "left").drop("a", "b")
    carried = "".join(f"c{k} {kind(docs, name)}, " for k, name in enumerate(carry))
    schema = f"id {kind(docs, id_column)}, {carried}n_words bigint, n_removed bigint, kept string"
    return joined.mapInArrow(_kept(len(carry)), schema).toDF("id", *carry, "n_words", "n_removed", "kept")
