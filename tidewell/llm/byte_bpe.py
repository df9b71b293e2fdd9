"""Byte-level BPE encoding and decoding by merge replay over the distinct pre-tokens of a block of texts.

The corpus of a replay is a block of documents. Its distinct pre-tokens are laid out as one array of symbols. An
inverted index leads from a pair (named by the token it makes) to the positions where it stands; the merges are
applied in rank order, each at all of its positions, and only the two neighbours of a merged symbol enter the index
anew. Each distinct pre-token is so encoded once per block. A block is bounded in bytes, so a task's memory is too.
"""

from __future__ import annotations

import base64
import re
from collections import defaultdict
from collections.abc import Iterable, Iterator, Sequence
from heapq import heapify, heappop, heappush
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from tidewell.llm.common import blocks, kind, pick, spark_of, texts_of, vocabulary_bytes

# The characters with the Unicode property White_Space.
WHITE = r" \t\n\x0b\x0c\r\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
CHUNKS = re.compile(f"[{WHITE}]*[^{WHITE}]+|[{WHITE}]+")
BLOCK_BYTES = 16 << 20


def load_ranks(data: bytes) -> list[bytes]:
    """The tokens of a rank file by id; ids without a token are empty."""
    pairs = [line.split() for line in data.splitlines() if line.strip()]
    tokens = [b""] * (1 + max(int(rank) for _, rank in pairs))
    for token, rank in pairs:
        tokens[int(rank)] = base64.b64decode(token)
    return tokens


class MergeReplay:
    """Applies merges in rank order to many words at once.

    ``pairs`` maps (left id, right id) to the rank of their merge, ``token`` each rank to the id that the merge makes.
    """

    def __init__(self, pairs: dict[tuple[int, int], int], token: np.ndarray, size: int):
        self.size, self.token = size, token
        table = sorted((left * size + right, rank) for (left, right), rank in pairs.items())
        self.pairs = np.array([key for key, _ in table] or [-1], "i8")
        self.made = np.array([rank for _, rank in table] or [-1], "i4")
        # Merges that can form a pair of lower rank than their own: after one of these the word must look again.
        rank_of = np.full(size, -1)
        rank_of[token] = np.arange(len(token))
        self.early = np.zeros(len(token), bool)
        for side in (self.pairs // size, self.pairs % size):
            rank = rank_of[side]
            self.early[rank[(rank >= 0) & (self.made < rank)]] = True

    def joined(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of the token that each pair makes, or -1."""
        key = left.astype("i8") * self.size + right
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        return np.where(self.pairs[at] == key, self.made[at], -1)

    def replay(self, symbol: np.ndarray, word: np.ndarray) -> None:
        """Merge the symbols of all words in place; a symbol merged into its left neighbour becomes -1."""
        n = len(symbol)
        if n < 2:
            return
        after = np.arange(1, n + 1, dtype="i4")
        before = np.arange(-1, n - 1, dtype="i4")
        last = np.append(word[1:] != word[:-1], True)
        after[last] = -1
        before[np.append(True, last[:-1])] = -1
        pair = np.full(n, -1, "i4")  # rank of the pair that starts here
        first = np.flatnonzero(~last)
        pair[first] = self.joined(symbol[first], symbol[first + 1])
        order = first[np.argsort(pair[first], kind="stable")]
        found, starts = np.unique(pair[order], return_index=True)
        whole = dict(zip(found.tolist(), np.split(order, starts[1:])))
        whole.pop(-1, None)
        index: dict[int, list[int]] = {rank: [] for rank in whole}  # rank -> positions found since
        queue = list(index)
        heapify(queue)
        while queue:
            rank = heappop(queue)
            later = index.pop(rank, None)
            if later is None:
                continue
            spots = whole.pop(rank, None)
            if later:
                spots = np.unique(np.array(later if spots is None else np.append(spots, later)))
            spots = spots[pair[spots] == rank]  # others went into a merge meanwhile
            if not len(spots):
                continue
            right = after[spots]
            lapped = right[:-1] == spots[1:]
            if lapped.any():  # of overlapping pairs the left one goes first
                steps = np.arange(len(spots))
                begin = np.maximum.accumulate(np.where(np.append(True, ~lapped), steps, 0))
                keep = (steps - begin) % 2 == 0
                spots, right = spots[keep], right[keep]
            if self.early[rank]:
                keep = np.append(True, word[spots[1:]] != word[spots[:-1]])
                if not keep.all():
                    index[rank] = spots[~keep].tolist()
                    heappush(queue, rank)
                    spots, right = spots[keep], right[keep]
            symbol[spots] = self.token[rank]
            symbol[right] = -1
            pair[right] = -1
            beyond = after[right]
            after[spots] = beyond
            has = beyond >= 0
            before[beyond[has]] = spots[has]
            pair[spots] = -1
            left = before[spots]
            left = left[left >= 0]
            touched = np.append(spots[has], left)
            if not len(touched):
                continue
            ranks = self.joined(symbol[touched], symbol[after[touched]])
            pair[touched] = ranks
            for more, at in zip(ranks.tolist(), touched.tolist()):
                if more >= 0:
                    there = index.get(more)
                    if there is None:
                        index[more] = [at]
                        heappush(queue, more)
                    else:
                        there.append(at)


class RankFile:
    """Encodes words under a rank file: a token's id is the rank of the merge that makes it."""

    def __init__(self, tokens: Sequence[bytes]):
        self.ranks = ranks = {token: rank for rank, token in enumerate(tokens) if token}
        missing = [b for b in range(256) if bytes([b]) not in ranks]
        if missing:
            raise ValueError(f"the vocabulary lacks {len(missing)} single bytes")
        self.singles = np.array([ranks[bytes([b])] for b in range(256)], "i4")
        pairs = {
            (left, right): rank
            for rank, token in enumerate(tokens)
            for at in range(1, len(token))
            if (left := ranks.get(token[:at])) is not None and (right := ranks.get(token[at:])) is not None
        }
        self.merges = MergeReplay(pairs, np.arange(len(tokens), dtype="i4"), len(tokens))

    def encode(self, words: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words in turn, number of ids of each word). A word that is a token itself is that token."""
        whole = np.array([self.ranks.get(word, -1) for word in words], "i4")
        lengths = np.fromiter(map(len, words), "i8", len(words))
        lengths[whole >= 0] = 1
        word = np.repeat(np.arange(len(words)), lengths)
        symbol = np.empty(len(word), "i4")
        rest = whole[word] < 0
        text = b"".join([w for w, rank in zip(words, whole.tolist()) if rank < 0])
        symbol[rest] = self.singles[np.frombuffer(text, "u1")]
        symbol[~rest] = whole[word[~rest]]
        self.merges.replay(symbol, word)
        alive = symbol >= 0
        return symbol[alive], np.bincount(word[alive], minlength=len(words))


def numbering() -> defaultdict:
    """Numbers its keys in the order in which they are first looked up."""
    numbers: defaultdict = defaultdict()
    numbers.default_factory = numbers.__len__
    return numbers


def gather(flat: np.ndarray, lengths: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    """The chosen runs of ``flat`` (run k has ``lengths[k]`` values) one after another."""
    starts = np.cumsum(lengths) - lengths
    sizes = lengths[chosen]
    shift = starts[chosen] - (np.cumsum(sizes) - sizes)
    return flat[np.arange(sizes.sum()) + np.repeat(shift, sizes)]


class BlockEncoder:
    """Encodes a block of texts: their distinct chunks (white space and what follows it) are encoded once, together.

    No pre-token reaches over a change from non-space to white space, so chunks can be encoded on their own.
    """

    def __init__(self, tokens: Sequence[bytes], pattern: str):
        self.ranks = RankFile(tokens)
        self.split = regex.compile(pattern).findall
        self.letters = np.frombuffer(b"".join(tokens), "u1")
        self.widths = np.fromiter(map(len, tokens), "i8", len(tokens))

    def encode(self, texts: Iterable[str]) -> Iterator[np.ndarray]:
        """Ids of each text."""
        number = numbering()
        rows = [np.fromiter(map(number.__getitem__, CHUNKS.findall(text)), "i4") for text in texts]
        parts = [self.split(chunk) for chunk in number]
        word = numbering()
        chosen = np.fromiter(map(word.__getitem__, chain.from_iterable(parts)), "i4")
        ids, lengths = self.ranks.encode([text.encode() for text in word])
        ids = gather(ids, lengths, chosen)
        counts = np.fromiter(map(len, parts), "i8", len(parts))
        edges = np.append(0, np.cumsum(lengths[chosen]))[np.append(0, np.cumsum(counts))]
        starts, sizes = edges[:-1], np.diff(edges)
        for row in rows:
            size = sizes[row]
            shift = starts[row] - (np.cumsum(size) - size)
            yield ids[np.arange(size.sum()) + np.repeat(shift, size)]

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes that a sequence of ids stands for."""
        return gather(self.letters, self.widths, ids).tobytes()


def encode_documents(
    docs: DataFrame, ranks_path: str, pattern: str, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """(id, ids, decoded): the ids of each text, and the bytes that decoding these ids gives.

    One row per input row, in one pass without a shuffle; other columns are not carried. A null text counts as the
    empty one, which has no ids; null or repeated ids are kept as they are; an empty table gives an empty one. Texts
    are taken whole, at any length.
    """
    shared = spark_of(docs).sparkContext.broadcast(load_ranks(vocabulary_bytes(ranks_path)))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = None
        for block in blocks(batches, "text", BLOCK_BYTES):
            encoder = encoder or BlockEncoder(shared.value, pattern)
            rows = encoder.encode(text for batch in block for text in texts_of(batch, "text"))
            for batch in block:
                ids = [next(rows) for _ in range(batch.num_rows)]
                offsets = np.cumsum([0, *map(len, ids)], dtype="i4")
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids).astype("i4")))
                decoded = pa.array([encoder.decode(part) for part in ids], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0), lists, decoded], ["id", "ids", "decoded"])

    schema = f"id {kind(docs, id_column)}, ids array<int>, decoded binary"
    return pick(docs, id=id_column, text=text_column).mapInArrow(run, schema)
