"""Best-two-fit packing of token sequences, planned on the histogram of lengths.

Pieces of equal length are interchangeable, so the plan needs only how many pieces there are of each length (at most
``capacity`` numbers). One bin is filled greedily with the longest pieces that fit; if a gap is left, its smallest piece
gives way to the two unpacked pieces that fill the widened gap best. The same bin is then repeated as long as its lengths
last, which is what packing bin after bin would choose, so the number of distinct bins does not grow with the corpus.
Pieces find their places by their rank among the pieces of their length: all per-row work is joins and windows.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewell.llm.byte_bpe import MergeReplay, gather
from tidewell.llm.common import give_back, kind, pick, slices, spark_of, stored, vocabulary_bytes

SLICE_BYTES = 4 << 20  # of texts that are encoded together
KNOWN_WORDS, KNOWN_BYTES = 1_000_000, 64 << 20  # what a process remembers of words before it begins anew
LONG = 128  # bytes of a piece that is merged in rounds
FOREIGN = re.compile("[^\x00-\u024f]")  # beyond these, lower-casing and normal forms are the library's
SPECIAL = "<|"  # fixed value: how the special tokens of the vocabulary begin
# Latin letters up to U+024F, but for the one whose lower case is two characters, and ASCII punctuation but for the
# apostrophe, which begins matches of its own.
LETTERS = r"A-Za-z\x{aa}\x{b5}\x{ba}\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{12f}\x{131}-\x{24f}"
PUNCTUATION = r"!-&(-/:;=-@\[-`{}~"
PLAIN = f"^(?P<body>[{LETTERS}]+)(?P<tail>[{PUNCTUATION}]*)$"
IDS = pa.list_(pa.int32())


def plan_bins(counts: dict[int, int], capacity: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Bins for ``counts`` (length -> number of pieces): [(number of equal bins, [(length, pieces per bin), ...]), ...]."""
    left = np.zeros(capacity + 1, "i8")
    for length, count in counts.items():
        if not 0 < length <= capacity:
            raise ValueError(f"a piece of {length} does not fit a bin of {capacity}")
        left[length] = count
    bins = []
    while True:
        sizes = np.flatnonzero(left)
        if not len(sizes):
            return bins
        need: dict[int, int] = {}
        gap = capacity
        at = len(sizes)
        while at and gap >= sizes[0]:  # greedily, longest first
            at = min(at - 1, int(np.searchsorted(sizes, gap, side="right")) - 1)
            if at < 0:
                break
            size = int(sizes[at])
            need[size] = min(gap // size, int(left[size]))
            gap -= need[size] * size
        if gap and sum(need.values()) > 1:
            smallest = min(need)
            pair = _best_two(left, need, sizes, gap + smallest, smallest)
            if pair:
                need[smallest] -= 1
                for size in pair:
                    need[size] = need.get(size, 0) + 1
                need = {size: n for size, n in need.items() if n}
        times = min(int(left[size]) // n for size, n in need.items())
        for size, n in need.items():
            left[size] -= times * n
        bins.append((times, sorted(need.items(), reverse=True)))


def _best_two(left: np.ndarray, need: dict[int, int], sizes: np.ndarray, gap: int, least: int) -> tuple[int, int] | None:
    """Two unpacked lengths whose sum is closest to ``gap`` from below and over ``least``."""
    free = np.array([left[s] - need.get(s, 0) for s in sizes.tolist()])
    sizes, free = sizes[free > 0], free[free > 0]
    sizes = sizes[sizes < gap]
    free = free[: len(sizes)]
    if not len(sizes):
        return None
    at = np.searchsorted(sizes, gap - sizes, side="right") - 1  # longest partner of each
    lone = (at == np.arange(len(sizes))) & (free < 2)
    at = np.where(lone, at - 1, at)
    total = np.where(at >= 0, sizes + sizes[np.maximum(at, 0)], 0)
    best = int(np.argmax(total))
    return (int(sizes[best]), int(sizes[at[best]])) if total[best] > least else None


def assign(pieces: DataFrame, capacity: int) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to stored ``pieces`` with columns part, length and an order of their own.

    ``part`` is any split of the rows into bounded parts; a piece's rank is its rank in its part and length, after
    the pieces of that length in earlier parts.
    """
    spark = spark_of(pieces)
    by_part = pieces.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n"))
    total = by_part.groupBy("length").agg(F.sum("n").alias("n"))
    counts = {row["length"]: row["n"] for row in total.collect()}  # at most ``capacity`` rows
    slots, sequence = [], 0
    taken = dict.fromkeys(counts, 0)
    for times, bin_sizes in plan_bins(counts, capacity):
        offset = 0
        for length, n in bin_sizes:
            slots.append((length, taken[length], taken[length] + times * n, n, sequence, offset))
            taken[length] += times * n
            offset += length * n
        sequence += times
    places = spark.createDataFrame(
        slots, "s_length bigint, first bigint, beyond bigint, per_bin bigint, base bigint, at bigint"
    )
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = by_part.withColumn("skip", F.coalesce(F.sum("n").over(earlier), F.lit(0))).select(
        F.col("part").alias("s_part"), F.col("length").alias("p_length"), "skip"
    )
    inside = Window.partitionBy("part", "length").orderBy("id", "piece", "ids_crc32")
    ranked = pieces.withColumn("rank", F.row_number().over(inside) - 1)
    ranked = ranked.join(starts, (F.col("part") == F.col("s_part")) & (F.col("length") == F.col("p_length")))
    ranked = ranked.withColumn("rank", F.col("rank") + F.col("skip"))
    fits = (F.col("length") == F.col("s_length")) & (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("beyond"))
    placed = ranked.join(F.broadcast(places), fits)  # bounded: a few rows for each length up to the capacity
    turn = F.col("rank") - F.col("first")
    return placed.withColumns({
        "sequence_id": F.col("base") + F.floor(turn / F.col("per_bin")).cast("bigint"),
        "offset": F.col("at") + (turn % F.col("per_bin")) * F.col("length"),
    })


class PairTable:
    """Ranks of pairs of symbols: a hash table with open addressing in two arrays, looked up for many pairs at once."""

    NONE = 0x7FFFFFFF

    def __init__(self, pairs: dict[tuple[int, int], int], size: int):
        self.size = size
        self.bits = max(4, (4 * len(pairs)).bit_length())
        keys = np.array([left * size + right for left, right in pairs], "i8")
        ranks = np.fromiter(pairs.values(), "i4", len(pairs))
        self.keys = np.full(1 << self.bits, -1, "i8")
        self.ranks = np.full(1 << self.bits, self.NONE, "i4")
        place = self._place(keys)
        while len(keys):
            free = self.keys[place] < 0
            spots, firsts = np.unique(place[free], return_index=True)
            won = np.flatnonzero(free)[firsts]
            self.keys[spots], self.ranks[spots] = keys[won], ranks[won]
            left = np.ones(len(keys), bool)
            left[won] = False
            keys, ranks, place = keys[left], ranks[left], (place[left] + 1) & (len(self.keys) - 1)

    def _place(self, keys: np.ndarray) -> np.ndarray:
        spread = keys.astype("u8") * np.uint64(0x9E3779B97F4A7C15)  # fixed value: the usual multiplier of such hashes
        return (spread >> np.uint64(64 - self.bits)).astype("i8")

    def __call__(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair, ``NONE`` for pairs that do not merge."""
        keys = left.astype("i8") * self.size + right
        place = self._place(keys)
        there = self.keys[place]
        out = np.where(there == keys, self.ranks[place], self.NONE)
        open_ = np.flatnonzero((there != keys) & (there >= 0))
        while len(open_):
            place[open_] = (place[open_] + 1) & (len(self.keys) - 1)
            there = self.keys[place[open_]]
            hit = there == keys[open_]
            out[open_[hit]] = self.ranks[place[open_[hit]]]
            open_ = open_[~hit & (there >= 0)]
        return out


def merge_words(symbol: np.ndarray, lengths: np.ndarray, rank_of: PairTable, token: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(symbols of all words in turn, number of each) after all merges; words have a symbol at least.

    In a round every unfinished word merges its pair of lowest rank, the leftmost of equals.
    """
    word = np.arange(len(lengths))
    rank = np.full(len(symbol), PairTable.NONE, "i4")
    rank[:-1] = rank_of(symbol[:-1], symbol[1:])
    rank[np.cumsum(lengths) - 1] = PairTable.NONE
    found_words, found_lengths, found_symbols = [], [], []
    while len(lengths):
        starts = np.cumsum(lengths) - lengths
        best = np.minimum.reduceat((rank.astype("i8") << 32) | np.arange(len(rank)), starts)
        at, lowest = best & 0xFFFFFFFF, best >> 32
        done = lowest == PairTable.NONE
        kept = np.ones(len(symbol), bool)
        if done.any():
            over = np.repeat(done, lengths)
            found_words.append(word[done])
            found_lengths.append(lengths[done])
            found_symbols.append(symbol[over])
            kept = ~over
            word, lengths, starts, at, lowest = word[~done], lengths[~done], starts[~done], at[~done], lowest[~done]
        symbol[at] = token[lowest]
        kept[at + 1] = False
        symbol, rank = symbol[kept], rank[kept]
        old, lengths = starts, lengths - 1
        starts = np.cumsum(lengths) - lengths
        at += starts - old
        rank[at] = PairTable.NONE
        right = at[at + 1 < starts + lengths]
        rank[right] = rank_of(symbol[right], symbol[right + 1])
        left = at[at > starts] - 1
        rank[left] = rank_of(symbol[left], symbol[left + 1])
    if not found_words:
        return symbol, lengths
    order = np.argsort(np.concatenate(found_words), kind="stable")
    sizes = np.concatenate(found_lengths)
    return gather(np.concatenate(found_symbols), sizes, order), sizes[order]


class WordTokenizer:
    """Ids of texts under a BPE definition that drops white space and marks word ends.

    Texts are split at ASCII white space and their words numbered in Arrow; a word that was met before keeps its
    ids, the new ones of a slice are merged together. Words of Latin letters that may end in punctuation stay in Arrow up
    to their bytes; other words are split one by one. Words beyond Latin letters, where normal forms and new characters
    matter, and words that hold a special token go to the library in one call; the tests hold all ids against it. No
    match of the split pattern reaches over white space, so words can be encoded on their own.
    """

    def __init__(self, definition: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs one task per core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_buffer(definition)
        parts = json.loads(definition)
        model, steps = parts["model"], parts["pre_tokenizer"]["pretokenizers"]
        normal = [step["type"] for step in parts["normalizer"]["normalizers"]]
        suffix = model["end_of_word_suffix"]
        if not suffix or normal != ["NFC", "Replace", "Lowercase"] or [s["type"] for s in steps] != ["Split", "ByteLevel"]:
            raise ValueError("only lower-cased byte-level BPE with marked word ends is supported")
        pattern = steps[0]["pattern"]["Regex"]
        self.split = regex.compile(pattern).findall
        # Whether letters and a tail of punctuation are two matches of this pattern is asked of the pattern itself.
        if self.split("aé.,") != ["aé", ".,"]:
            raise ValueError("only patterns that part words from punctuation are supported")
        self.special = [token["content"] for token in parts["added_tokens"]]
        vocabulary = model["vocab"]
        letters = byte_letters()
        self.inner = np.array([vocabulary[letter] for letter in letters], "i4")
        self.final = np.array([vocabulary[letter + suffix] for letter in letters], "i4")
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        pairs = {(vocabulary[a], vocabulary[b]): rank for rank, (a, b) in enumerate(merges)}
        self.token = np.array([vocabulary[a + b] for a, b in merges], "i4")
        size = 1 + max(vocabulary.values())
        self.rank_of = PairTable(pairs, size)
        self.replay = MergeReplay(pairs, self.token, size)
        self.forget()

    def forget(self) -> None:
        self.known = pa.array([], pa.large_string())
        self.lists = pa.array([], IDS)

    def _learn(self, words: pa.Array) -> np.ndarray:
        """The place of each word's ids in ``lists``; new words are encoded."""
        if len(self.known) > KNOWN_WORDS or self.known.nbytes + self.lists.nbytes > KNOWN_BYTES:
            self.forget()
        place = pc.index_in(words, value_set=self.known)
        fresh = pc.is_null(place)
        number = pc.fill_null(place, -1).to_numpy().astype("i8")
        new = words.filter(fresh)
        if len(new):
            number[fresh.to_numpy(zero_copy_only=False)] = len(self.known) + np.arange(len(new))
            self.known = pa.concat_arrays([self.known, new])
            self.lists = pa.concat_arrays([self.lists, self._words(new)])
        return number

    def encode(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in turn, where each text's ids begin and the last one's end); each text ends by ``end_id``."""
        words = pc.ascii_split_whitespace(pc.fill_null(texts, "").cast(pa.large_string()))
        coded = words.flatten().dictionary_encode()
        edges = words.offsets.to_numpy().astype("i8")
        edges -= edges[0]
        number = self._learn(coded.dictionary) + 1  # number 0 is the end
        chosen = np.insert(number[coded.indices.to_numpy()], edges[1:], 0)
        found = pa.concat_arrays([pa.array([[end_id]], IDS), self.lists]).take(pa.array(chosen))
        return found.flatten().to_numpy(), found.offsets.to_numpy()[edges + np.arange(len(edges))]

    def _words(self, words: pa.Array) -> pa.ListArray:
        """The ids of each word."""
        parts = pc.extract_regex(words, PLAIN)
        plain = pc.is_valid(parts)
        is_plain = plain.to_numpy(zero_copy_only=False)
        parts = parts.filter(plain)
        bodies, tails = pc.utf8_lower(parts.field("body")), parts.field("tail")
        others = words.filter(pc.invert(plain)).to_pylist()
        is_special = np.array([
            bool(FOREIGN.search(word)) or (SPECIAL in word and any(token in word for token in self.special)) for word in others
        ], bool)
        split = [self.split(word.lower()) for word, special in zip(others, is_special.tolist()) if not special]
        foreign = [word for word, special in zip(others, is_special.tolist()) if special]
        pieces = pa.concat_arrays([bodies, tails, pa.array(list(chain.from_iterable(split)), pa.large_string())])
        coded = pieces.dictionary_encode()
        ids, widths = self._pieces(coded.dictionary)
        index = coded.indices.to_numpy()
        n = len(bodies)
        pair = np.column_stack([index[:n], index[n : 2 * n]]).ravel()
        counts = np.fromiter(map(len, split), "i8", len(split))
        behind = np.append(0, np.cumsum(widths[index[2 * n :]]))
        edges = np.append(0, np.cumsum(counts))
        library = self.tokenizer.encode_batch(foreign, add_special_tokens=False)
        groups = [
            (np.flatnonzero(is_plain), widths[pair].reshape(-1, 2).sum(axis=1), gather(ids, widths, pair)),
            (np.flatnonzero(~is_plain)[~is_special], np.diff(behind[edges]), gather(ids, widths, index[2 * n :])),
            (
                np.flatnonzero(~is_plain)[is_special],
                np.fromiter((len(one.ids) for one in library), "i8", len(library)),
                np.fromiter(chain.from_iterable(one.ids for one in library), "i4"),
            ),
        ]
        places, sizes, flat = (np.concatenate(column) for column in zip(*groups))
        lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)), pa.int32()), pa.array(flat, pa.int32()))
        return lists.take(pa.array(np.argsort(places, kind="stable")))

    def _pieces(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all pieces in turn, number of ids of each); an empty piece has none."""
        lengths = pc.binary_length(pieces).to_numpy().astype("i8")
        letters = np.frombuffer(pieces.buffers()[2] or b"", "u1")[: lengths.sum()]
        symbol = self.inner[letters]
        ends = np.cumsum(lengths)[lengths > 0] - 1
        symbol[ends] = self.final[letters[ends]]
        widths = lengths.copy()
        short = np.repeat(lengths <= LONG, lengths)
        few, sizes = merge_words(symbol[short], lengths[(lengths > 0) & (lengths <= LONG)], self.rank_of, self.token)
        widths[(lengths > 0) & (lengths <= LONG)] = sizes
        if short.all():
            return few, widths
        # Rounds cost a long piece the square of its length; a replay finds its pairs through an index.
        rest, owner = symbol[~short], np.repeat(np.arange(len(lengths)), lengths)[~short]
        self.replay.replay(rest, owner)
        alive = rest >= 0
        is_long = lengths > LONG
        widths[is_long] = np.bincount(owner[alive], minlength=len(lengths))[is_long]
        out = np.empty(widths.sum(), "i4")
        where = np.repeat(is_long, widths)
        out[where], out[~where] = rest[alive], few
        return out, widths


@lru_cache(maxsize=1)
def word_tokenizer(definition: bytes) -> WordTokenizer:
    """One tokenizer for a worker process; the words that it has met are dropped at the end of a task."""
    return WordTokenizer(definition)


def byte_letters() -> list[str]:
    """The letter by which byte-level vocabularies write each byte: printable ones themselves, the others from U+0100 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = iter(range(0x100, 0x200))
    return [chr(byte) if byte in shown else chr(next(hidden)) for byte in range(256)]


def cut_documents(
    docs: DataFrame,
    tokenizer_path: str,
    capacity: int = 2048,
    end_id: int = 0,
    id_column: str = "doc_id",
    text_column: str = "text",
    keep_ids: bool = False,
) -> DataFrame:
    """(part, id, piece, start, length, ids_crc32[, ids]): each text's ids and ``end_id``, cut into pieces.

    Only documents of more than ``capacity`` ids are cut; the last piece may be shorter. A null or empty text is
    ``end_id`` alone. Texts are encoded whole, slices of about 4 MB together; a longer text is a slice of its own.
    """
    shared = spark_of(docs).sparkContext.broadcast(vocabulary_bytes(tokenizer_path))

    def cut(batch: pa.RecordBatch, tokenizer: WordTokenizer) -> pa.RecordBatch:
        ids, rows = tokenizer.encode(batch.column(1), end_id)
        pieces = -(-np.diff(rows) // capacity)
        of = np.repeat(np.arange(len(pieces)), pieces)
        piece = np.arange(len(of)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        start = piece * capacity
        first = rows[of] + start
        length = np.minimum(rows[of + 1] - first, capacity)
        view = memoryview(ids.astype("<u4", copy=False)).cast("B")
        crc = [zlib.crc32(view[4 * at : 4 * (at + n)]) for at, n in zip(first.tolist(), length.tolist())]
        out = [batch.column(0).take(pa.array(of)), pa.array(piece, pa.int32()), pa.array(start, pa.int64())]
        out += [pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
        if keep_ids:  # pieces stand in the order of their ids
            out.append(pa.ListArray.from_arrays(pa.array(np.append(first, len(ids)), pa.int32()), pa.array(ids)))
        names = ["id", "piece", "start", "length", "ids_crc32", "ids"]
        return pa.RecordBatch.from_arrays(out, names[: len(out)])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = word_tokenizer(shared.value)
        try:
            for batch in slices(batches, "text", SLICE_BYTES):
                yield cut(batch, tokenizer)
        finally:  # the worker waits for its next task without the words of this one
            tokenizer.forget()
            give_back()

    schema = f"id {kind(docs, id_column)}, piece int, start bigint, length bigint, ids_crc32 bigint"
    pieces = pick(docs, id=id_column, text=text_column).mapInArrow(run, schema + (", ids array<int>" if keep_ids else ""))
    return pieces.withColumn("part", F.spark_partition_id())


def pack_documents(
    docs: DataFrame,
    tokenizer_path: str,
    capacity: int = 2048,
    end_id: int = 0,
    id_column: str = "doc_id",
    text_column: str = "text",
    keep_ids: bool = False,
) -> DataFrame:
    """(id, piece, start, length, ids_crc32[, ids], sequence_id, offset): every piece in a sequence of ``capacity`` ids.

    Sequences are filled without gaps from offset 0. A null text counts as the empty one; null or repeated ids are kept
    (rows that share an id are documents of their own); an empty table gives an empty one; other columns are not
    carried. The pieces are written once, as their histogram must be complete before the first one is placed.
    """
    pieces = stored(cut_documents(docs, tokenizer_path, capacity, end_id, id_column, text_column, keep_ids), "pieces")
    kept = ["id", "piece", "start", "length", "ids_crc32", *(["ids"] if keep_ids else [])]
    return assign(pieces, capacity).select(*kept, "sequence_id", "offset")
