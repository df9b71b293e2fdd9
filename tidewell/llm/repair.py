"""Repair of the turn structure of conversations by cheapest edits, found with auction shortest paths.

The lattice of a conversation has a node for each row boundary and state of the output (nothing yet, after a system turn,
after a user turn, after an assistant turn). Arcs keep, rerole or delete the next row, or insert an empty turn, at whole
costs. The auction algorithm holds a price for each node and a path from the origin: where the last node's price is below
what its best arc offers, the price rises and the path contracts by a node, else the path extends along that arc. Prices
stay feasible duals, so that once paths from all entries have reached the end, every cheapest path consists of arcs whose
cost equals the fall in price. Of these tight arcs those that lead to the end are traced in the order of their letters.

Long conversations are solved a stretch of rows at a time from the end: the prices at a stretch's entries are what its
predecessor pays at its exits, and the trace runs through the stretches in order. A stretch is known by its rows' letters
and its exit prices, so stretches alike are solved once in a task.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from functools import lru_cache
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.llm.common import kind, pick

KEEP, REROLE, DELETE, INSERT, CUT = 0, 3, 4, 3, 3  # costs; CUT is what an undeleted truncated row adds
STRETCH = 32  # rows of a lattice that is solved at once
KNOWN = 1 << 15  # solved stretches that a task remembers
STATES = 4  # nothing yet, after s, after u, after a
LEGAL = {"su", "ua", "au"}
NEXT = {0: "u", 1: "u", 2: "a", 3: "u"}  # the turn that may follow a state, besides s at the beginning
AFTER = {"s": 1, "u": 2, "a": 3}
NAMES = {"u": "user", "a": "assistant"}
END = ((0, ""), (2 * INSERT, "II"), (INSERT, "I"), (0, ""))  # what is left to do after the last row: cost, edits
SOUND, BLANK, DUPLICATE, TRUNCATED = range(4)
VISIBLE = r"[^\x20\x09-\x0D]"
OUTSIDE = "\x20\x09\x0a\x0b\x0c\x0d"


def lattice(letters: str, exits: tuple[int, ...]) -> tuple[list[list[tuple[str, int, int]]], int]:
    """(arcs of each node as (letter, cost, head), the end node) for rows given by two letters each: initial and fault.

    Node ``4 i + state`` stands before row i; the end is reached from the nodes behind the last row at ``exits``.
    """
    rows = len(letters) // 2
    end = STATES * (rows + 1)
    arcs: list[list[tuple[str, int, int]]] = [[] for _ in range(end + 1)]
    for i in range(rows):
        initial, fault = letters[2 * i], int(letters[2 * i + 1])
        extra = CUT if fault == TRUNCATED else 0
        for state in range(STATES):
            here, wanted = STATES * i + state, NEXT[state]
            out = arcs[here]
            out.append(("D", DELETE, here + STATES))
            out.append(("I", INSERT, STATES * i + AFTER[wanted]))
            if fault not in (BLANK, DUPLICATE):
                if initial == wanted or (initial == "s" and state == 0):
                    out.append(("K", KEEP + extra, STATES * (i + 1) + AFTER[initial]))
                out.append(("R", REROLE + extra, STATES * (i + 1) + AFTER[wanted]))
    for state, cost in enumerate(exits):
        arcs[STATES * rows + state].append(("", cost, end))
    return arcs, end


def auction(arcs: list[list[tuple[str, int, int]]], end: int, origins: Iterable[int]) -> list[int]:
    """Prices under which all cheapest paths from the origins to ``end`` are tight. Costs are whole and not negative."""
    price = [0] * len(arcs)
    for origin in origins:
        path = [origin]
        while path[-1] != end:
            node = path[-1]
            best, head = min((cost + price[to], to) for _, cost, to in arcs[node])
            if price[node] < best:
                price[node] = best
                if len(path) > 1:
                    path.pop()
            else:
                path.append(head)
    return price


def trace(arcs: list[list[tuple[str, int, int]]], end: int, price: list[int], origin: int) -> tuple[str, int]:
    """(letters of the tight path that is least in ASCII, its last node before ``end``)."""
    tight = [[(a, to) for a, cost, to in out if price[node] == cost + price[to]] for node, out in enumerate(arcs)]
    leads: dict[int, bool] = {end: True}

    def reaches(start: int) -> bool:
        stack = [start]
        while stack:
            node = stack[-1]
            heads = [to for _, to in tight[node]]
            if node in leads or any(leads.get(to) for to in heads):
                leads.setdefault(node, True)
                stack.pop()
                continue
            unknown = [to for to in heads if to not in leads]
            if unknown:  # tight arcs form no cycle, as no cycle of the lattice is free
                stack.append(unknown[0])
            else:
                leads[node] = False
                stack.pop()
        return leads[start]

    node, letters = origin, []
    while True:
        letter, head = min((a, to) for a, to in tight[node] if reaches(to))
        if head == end:
            return "".join(letters), node
        letters.append(letter)
        node = head


@lru_cache(KNOWN)
def solve(letters: str, exits: tuple[int, ...]) -> tuple[tuple[int, ...], tuple[tuple[str, int], ...]]:
    """(cost from each entry state, (edits, exit state) of each) for one stretch."""
    arcs, end = lattice(letters, exits)
    price = auction(arcs, end, range(STATES))
    traces = tuple(trace(arcs, end, price, state) for state in range(STATES))
    return tuple(price[:STATES]), tuple((edits, node % STATES) for edits, node in traces)


def cheapest(letters: bytes) -> tuple[int, list[str]]:
    """(cost, edits stretch by stretch) of the cheapest repair of rows given by two letters each.

    Holds the letters and four prices a stretch. The last piece of edits has no rows: what is inserted at the end.
    """
    step = 2 * STRETCH
    stretches = [letters[i : i + step].decode("ascii") for i in range(0, len(letters), step)]
    exits = [tuple(cost for cost, _ in END)]
    base = 0
    for stretch in reversed(stretches):
        prices, _ = solve(stretch, exits[-1])
        least = min(prices)
        base += least
        exits.append(tuple(p - least for p in prices))
    cost = base + exits[-1][0]
    edits, state = [], 0
    for k, stretch in enumerate(stretches):
        part, state = solve(stretch, exits[len(stretches) - 1 - k])[1][state]
        edits.append(part)
    edits.append(END[state][1])
    return cost, edits


class Conversation:
    """Takes the rows of one conversation twice: first what they are like, then their texts."""

    def __init__(self):
        self.letters = bytearray()
        self.low = self.high = None
        self.distinct = 0
        self.counts = [0, 0, 0, 0]
        self.illegal = 0
        self.last: str | None = None
        self.edits: Iterator[str] | None = None
        self.cost, self.audit, self.state = 0, "", 0
        self.digest, self.first = sha256(), True

    def look(self, turn, initial: str, fault: int, again: int) -> None:
        """A row, and ``again`` further ones like it behind it."""
        if turn is not None and turn != self.high:
            self.distinct += 1
            self.low = turn if self.low is None else self.low
            self.high = turn
        seen = initial if initial in AFTER else "-"
        for code, times in ((fault, 1), (BLANK if fault == BLANK else DUPLICATE, again)):
            self.counts[code] += times
            self.letters += f"{seen}{code}".encode() * times
        if self.last is not None:
            self.illegal += self.last + initial not in LEGAL
        self.illegal += again * (initial + initial not in LEGAL)
        self.last = initial

    def plan(self) -> None:
        if self.edits is None:
            self.cost, parts = cheapest(bytes(self.letters))
            self.letters = bytearray()
            self.audit = "".join(parts)
            self.edits = iter(self.audit)

    def read(self, role: str, text: str, times: int) -> None:
        for _ in range(times):
            for edit in self.edits:
                if edit == "I":
                    self._say(NAMES[NEXT[self.state]], "")
                    continue
                if edit != "D":
                    self._say(role if edit == "K" else NAMES[NEXT[self.state]], text)
                break

    def _say(self, role: str, text: str) -> None:
        self.digest.update(f"{'' if self.first else chr(10)}{role}:{text}".encode())
        self.first = False
        self.state = AFTER[role[:1]]

    def row(self) -> tuple:
        self.plan()
        for _ in self.edits:  # insertions at the end
            self._say(NAMES[NEXT[self.state]], "")
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.distinct
        counts = self.counts[BLANK], self.counts[DUPLICATE], self.counts[TRUNCATED]
        return gaps, *counts, self.illegal, self.cost, self.audit, self.digest.hexdigest()


def damage(rows: DataFrame) -> DataFrame:
    """(id, turn, role, text, times) of rows with these columns after deterministic damage; nulls become one space.

    The checksum of ``id:turn`` modulo 20 decides: 0 drops the row, 1 empties its text, 2 removes full stops, exclamation
    and question marks, 3 repeats it, 4 makes it the user's.
    """
    space = F.lit(" ")
    identity, turn = (F.coalesce(F.col(c).cast("string"), space) for c in ("id", "turn"))
    draw = F.crc32(F.concat(identity, F.lit(":"), turn)) % 20
    drawn = rows.withColumn("draw", draw).where("draw <> 0")
    text = F.coalesce("text", space)
    text = F.when(F.col("draw") == 1, "").when(F.col("draw") == 2, F.translate(text, ".!?", "")).otherwise(text)
    role = F.when(F.col("draw") == 4, "user").otherwise(F.coalesce("role", space))
    times = F.when(F.col("draw") == 3, 2).otherwise(1).cast("bigint")
    return drawn.select("id", "turn", role.alias("role"), text.alias("text"), times.alias("times"))


def _fault(text: Column) -> Column:
    """Blank, truncated or sound by the text alone."""
    shown = F.rtrim(text, F.lit(OUTSIDE))
    return F.when(shown == "", BLANK).when(F.substring(shown, -1, 1).isin(".", "!", "?"), SOUND).otherwise(TRUNCATED)


def repair_conversations(
    rows: DataFrame,
    damaged: bool = False,
    id_column: str = "conv_id",
    turn_column: str = "turn",
    role_column: str = "role",
    text_column: str = "text",
) -> DataFrame:
    """(id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256): one row per conversation.

    Rows are read by turn, null turns first, those of one turn by role and the text's digest. With ``damaged`` they are damaged beforehand; without it
    nulls of role and text become one space too. Conversations that have lost all rows give zeros, an empty audit and the
    digest of nothing. A null id is a conversation of its own; repeated rows are duplicates of the first; an empty table
    gives an empty result; other columns are not carried.

    Identical rows are counted before anything is shuffled by conversation, and duplicates at other turns are found by an
    aggregate that combines in each task. The digest over a conversation's texts and its audit need its rows in order, so
    a conversation is one stream through one task, which holds two letters a row and no texts.
    """
    given = pick(rows, id=id_column, turn=turn_column, role=role_column, text=text_column)
    if damaged:
        kept = damage(given)
    else:
        filled = {c: F.coalesce(c, F.lit(" ")) for c in ("role", "text")}
        kept = given.withColumns(filled).withColumn("times", F.lit(1).cast("bigint"))
    counted = kept.groupBy("id", "turn", "role", "text").agg(F.sum("times").alias("times"))
    said = counted.withColumn("said", F.sha2(F.concat_ws(":", F.length("role"), "role", "text"), 256))
    looks = said.select("id", "turn", "role", "said", "times", _fault(F.col("text")).alias("fault"))
    # turns are compared with nulls first: (whether there is one, the turn)
    at = F.struct(F.col("turn").isNotNull(), F.col("turn"))
    first = looks.groupBy(F.col("id").alias("i"), F.col("said").alias("s")).agg(F.min(at).alias("at"))
    first = first.select("i", "s", F.col("at.turn").alias("t"), F.lit(False).alias("later"))
    same = [F.col(a).eqNullSafe(F.col(b)) for a, b in (("id", "i"), ("said", "s"), ("turn", "t"))]
    looks = looks.join(first, same, "left").withColumn("later", F.coalesce("later", F.lit(True)))
    fault = F.when((F.col("fault") != BLANK) & F.col("later"), DUPLICATE).otherwise(F.col("fault")).cast("int")
    nothing = {c: F.lit(None).cast(t) for c, t in (("turn", kind(given, "turn")), ("role", "string"), ("text", "string"))}
    place = F.struct(F.col("turn").isNotNull().alias("has"), "turn", "role", "said").alias("place")
    looks = looks.select(
        "id", F.lit(1).alias("phase"), place, F.substring("role", 1, 1).alias("role"), nothing["text"].alias("text"),
        "times", fault.alias("fault"),
    )
    texts = said.select("id", F.lit(2).alias("phase"), place, "role", "text", "times", F.lit(SOUND).alias("fault"))
    names = given.groupBy("id").agg(F.count(F.lit(1)).alias("times"))
    nowhere = F.lit(None).cast(looks.schema["place"].dataType).alias("place")
    names = names.select(
        "id", F.lit(0).alias("phase"), nowhere, nothing["role"].alias("role"), nothing["text"].alias("text"), "times",
        F.lit(SOUND).alias("fault"),
    )
    stream = names.unionByName(looks).unionByName(texts).repartition("id").sortWithinPartitions("id", "phase", "place")
    stream = stream.select("id", "phase", F.col("place.turn").alias("turn"), "role", "text", "times", "fault")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = identity = last = None
        for whole in batches:
            for batch in (whole.slice(start, 1000) for start in range(0, whole.num_rows, 1000)):
                done = []
                for name, phase, turn, role, text, times, fault in zip(*(c.to_pylist() for c in batch.columns)):
                    if phase == 0:
                        if now is not None:
                            done.append((identity, *now.row()))
                        now, identity = Conversation(), name
                    elif phase == 1:
                        now.look(turn, role, fault, times - 1)
                    else:
                        now.plan()
                        now.read(role, text, times)
                if done:
                    yield _made(done, batch.schema.field(0).type)
                last = batch.schema.field(0).type
        if now is not None:
            yield _made([(identity, *now.row())], last)

    return stream.mapInArrow(
        run,
        f"id {kind(given, 'id')}, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint,"
        " cost bigint, audit string, repaired_sha256 string",
    )


REPAIRED = "id gaps blank duplicate truncated illegal cost audit repaired_sha256".split()


def _made(rows: list[tuple], identity: pa.DataType) -> pa.RecordBatch:
    types = [identity, *[pa.int64()] * 6, pa.string(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], REPAIRED)
