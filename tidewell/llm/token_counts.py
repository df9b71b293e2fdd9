"""Token counts under a piece vocabulary by rank-synchronous merging of ragged arrays.

The distinct chunks of a block of texts lie in one flat array of symbols, cut into sequences. In every round each
unfinished sequence finds its own lowest-rank pair and all sequences merge theirs at once; finished sequences leave
the arrays, and the symbols that survive are counted. Rows are then sums over their chunks.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm.byte_bpe import numbering
from tidewell.llm.common import blocks, kind, pick, spark_of, texts_of, vocabulary_bytes

SPACE = "▁"  # fixed value: stands for a space inside pieces
CHUNKS = re.compile(" *[^ ]+| +")
BLOCK_BYTES = 16 << 20
NEVER = np.int32(2**31 - 1)
NORMAL, USER_DEFINED, BYTE = 1, 4, 6  # fixed values: piece types


class PieceMerger:
    """Counts the pieces of words under a BPE piece model with byte fallback and without normalisation."""

    def __init__(self, model: bytes):
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        proto.ParseFromString(model)
        trainer, norm = proto.trainer_spec, proto.normalizer_spec
        plain = norm.escape_whitespaces and not norm.remove_extra_whitespaces and not norm.precompiled_charsmap
        types = {piece.type for piece in proto.pieces}
        if trainer.model_type != trainer.BPE or not plain or USER_DEFINED in types or BYTE not in types:
            raise ValueError("only BPE piece models with byte fallback, plain text and no own symbols are supported")
        self.prefix = " " if norm.add_dummy_prefix else ""
        scores = {piece.piece: piece.score for piece in proto.pieces if piece.type == NORMAL}
        if any(a != SPACE and b == SPACE for piece in scores for a, b in zip(piece, piece[1:])):
            raise ValueError("a piece holds a space after a letter, so words cannot be taken one by one")
        strings = list(dict.fromkeys([*scores, *(c for piece in scores for c in piece)]))
        ids = {string: i for i, string in enumerate(strings)}
        self.base = len(strings)  # the ids base .. base + 3 are characters of 1 to 4 bytes outside all pieces
        widths = [1 if s in scores else len(s.encode()) for s in strings]
        self.weights = np.array([*widths, 1, 2, 3, 4], "i8")
        point = np.arange(0x110000)
        self.symbols = (self.base + (point >= 0x80) + (point >= 0x800) + (point >= 0x10000)).astype("i4")
        for string, i in ids.items():
            if len(string) == 1:
                self.symbols[ord(string)] = i
        order = {score: rank for rank, score in enumerate(sorted(set(scores.values()), reverse=True))}
        count = np.bincount([order[score] for score in scores.values()], minlength=len(order))
        self.first_only = count > 1  # pieces of equal score: the leftmost pair goes first
        self.side = self.base + 4
        pairs = []
        for piece, score in scores.items():
            for at in range(1, len(piece)):
                left, right = ids.get(piece[:at]), ids.get(piece[at:])
                if left is not None and right is not None:
                    pairs.append((left * self.side + right, order[score], ids[piece]))
        pairs.sort()
        self.pairs = np.array([p[0] for p in pairs] or [-1], "i8")
        self.ranks = np.array([p[1] for p in pairs] or [NEVER], "i4")
        self.merged = np.array([p[2] for p in pairs] or [0], "i4")
        rank_of = np.full(self.side, -1)
        for piece, score in scores.items():
            rank_of[ids[piece]] = order[score]
        for part in (self.pairs // self.side, self.pairs % self.side):  # a merge that makes a pair of lower rank
            known = rank_of[part]
            self.first_only[known[(known >= 0) & (self.ranks < known)]] = True
        self.neighbours = np.unique(
            np.array([ord(a) << 21 | ord(b) for piece in scores for a, b in zip(piece, piece[1:])], "i8")
        )
        self.period = self._period(scores)

    @staticmethod
    def _period(scores: dict[str, float]) -> int:
        """Length of the longest piece of spaces, if a run of so many spaces always ends as that one piece.

        Pieces of spaces share one score below all others, so runs merge from the left; 0 where that doesn't hold.
        """
        runs = {len(p): s for p, s in scores.items() if set(p) == {SPACE} and len(p) > 1}
        others = [s for p, s in scores.items() if set(p) != {SPACE}]
        if not runs or len(set(runs.values())) > 1 or (others and max(runs.values()) >= min(others)):
            return 0
        longest, stack = max(runs), []
        for _ in range(longest):
            stack.append(1)
            while len(stack) > 1 and stack[-1] + stack[-2] in runs:
                stack.append(stack.pop() + stack.pop())
        return longest if stack == [longest] else 0

    def pairing(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Places in the pair table, -1 where two symbols never join."""
        key = left.astype("i8") * self.side + right
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        return np.where(self.pairs[at] == key, at, -1)

    def count(self, words: Sequence[str]) -> np.ndarray:
        """Number of tokens of each word (spaces as ``SPACE``)."""
        counts = np.zeros(len(words), "i8")
        if self.period:
            words = list(words)
            for i, word in enumerate(words):
                if word.startswith(SPACE * (4 * self.period)):  # whole periods of a long run of spaces stand alone
                    run = len(word) - len(word.lstrip(SPACE))
                    gone = (run - 2 * self.period) // self.period
                    counts[i] = gone
                    words[i] = word[gone * self.period :]
        points = np.frombuffer("".join(words).encode("utf-32-le"), "<u4").astype("i8")
        if not len(points):
            return counts
        word = np.repeat(np.arange(len(words)), np.fromiter(map(len, words), "i8", len(words)))
        bond = points[:-1] << 21 | points[1:]
        at = np.minimum(np.searchsorted(self.neighbours, bond), max(0, len(self.neighbours) - 1))
        joint = (self.neighbours[at] == bond) if len(self.neighbours) else np.zeros(len(bond), bool)
        # no piece holds two such neighbours, so a sequence ends between them
        sequence = np.append(0, np.cumsum(~joint | (word[1:] != word[:-1])))
        self._merge(self.symbols[points], sequence, word, counts)
        return counts

    def _merge(self, symbol: np.ndarray, sequence: np.ndarray, word: np.ndarray, counts: np.ndarray) -> None:
        same = np.append(sequence[1:] == sequence[:-1], False)
        place = np.full(len(symbol), -1)
        at = np.flatnonzero(same)
        place[at] = self.pairing(symbol[at], symbol[at + 1])
        while len(symbol):
            rank = np.where(place >= 0, self.ranks[place], NEVER)
            starts = np.flatnonzero(np.append(True, sequence[1:] != sequence[:-1]))
            sizes = np.diff(np.append(starts, len(symbol)))
            best = np.minimum.reduceat(rank, starts)
            done = best == NEVER
            if done.any():
                over = np.repeat(done, sizes)
                counts += np.bincount(word[over], self.weights[symbol[over]], len(counts)).astype("i8")
                symbol, sequence, word, place, rank = (a[~over] for a in (symbol, sequence, word, place, rank))
                sizes, best = sizes[~done], best[~done]
                if not len(symbol):
                    break
            lowest = np.repeat(best, sizes)
            spots = np.flatnonzero(rank == lowest)
            lapped = spots[1:] == spots[:-1] + 1
            steps = np.arange(len(spots))
            begin = np.maximum.accumulate(np.where(np.append(True, ~lapped), steps, 0))
            keep = (steps - begin) % 2 == 0  # of overlapping pairs the left one goes first
            keep &= ~self.first_only[lowest[spots]] | np.append(True, sequence[spots[1:]] != sequence[spots[:-1]])
            spots = spots[keep]
            symbol[spots] = self.merged[place[spots]]
            stay = np.ones(len(symbol), bool)
            stay[spots + 1] = False
            moved = spots - np.arange(len(spots))  # places of the merged symbols after the others have gone
            symbol, sequence, word, place = symbol[stay], sequence[stay], word[stay], place[stay]
            touched = np.unique(np.append(moved, moved[moved > 0] - 1))
            place[touched] = -1
            touched = touched[touched < len(symbol) - 1]
            touched = touched[sequence[touched] == sequence[touched + 1]]
            place[touched] = self.pairing(symbol[touched], symbol[touched + 1])

    def count_texts(self, texts: Iterable[str]) -> np.ndarray:
        """Number of tokens of each text."""
        number = numbering()
        rows = []
        for text in texts:
            text = (self.prefix + text).replace(SPACE, " ") if text else ""
            rows.append(np.fromiter(map(number.__getitem__, CHUNKS.findall(text)), "i4"))
        counts = self.count([chunk.replace(" ", SPACE) for chunk in number])
        return np.array([counts[row].sum() for row in rows], "i8")


def count_tokens(
    docs: DataFrame, model_path: str, limit: int = 4096, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) for each row, in one pass without a shuffle; other columns are not carried.

    A null text counts as the empty one: 0 bytes, 0 tokens. Null or repeated ids are kept as they are, an empty table
    gives an empty one, and texts are taken whole at any length.
    """
    shared = spark_of(docs).sparkContext.broadcast(vocabulary_bytes(model_path))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merger = None
        for block in blocks(batches, "text", BLOCK_BYTES):
            merger = merger or PieceMerger(shared.value)
            counts = merger.count_texts(text for batch in block for text in texts_of(batch, "text"))
            done = 0
            for batch in block:
                part = pa.array(counts[done : done + batch.num_rows])
                done += batch.num_rows
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), part], ["id", "n_bytes", "n_tokens"])

    schema = f"id {kind(docs, id_column)}, n_bytes bigint, n_tokens bigint"
    rows = pick(docs, id=id_column, text=text_column)
    rows = rows.withColumn("n_bytes", F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint"))
    return rows.mapInArrow(run, schema).withColumn("over_limit", F.col("n_tokens") > limit)
