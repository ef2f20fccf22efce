"""Operator 13, conversation structure repair by an auction shortest-path algorithm.

A conversation of n turns is a lattice of (n + 1) x 4 nodes: turns seen, and what the kept roles spell so far. Arcs are the edits
(keep, rerole, delete, insert) with integer costs. A path grows from the origin along the arc that is best by cost plus price;
where a node's price falls below that of its best arc it rises to it and the path draws back. At the end no arc is dearer by
prices than by cost, and the path is tight, so every cheapest path consists of tight arcs alone. Of the tight arcs that
lead to the end, the one with the least letter is taken at each node, which spells the least of all cheapest audits.

Long conversations are solved in blocks of turns from the back, each with its exits priced exactly by the block behind it, so
the work grows with the turns and not with their square.

Every row travels twice in one shuffle: first without its text, to be judged, then with it, to be hashed as it streams by. A
task keeps a few bytes a turn and no texts; SHA-256 goes through a conversation in order, so its rows pass one task.

Defined cases: nulls of role and text count as one space, a null conv_id is a conversation of its own. A role that begins with
none of s, u, a can't be kept. Turns are in order with nulls first, ties by role, then by a hash of the text; repeated rows
stay rows (and are faults of the duplicate kind). A conversation that loses all its rows has zeros, an empty audit and the
hash of the empty string. An empty table gives an empty result. Only the named columns are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, WORD

SOUND, TRUNCATED, FAULTY = 0, 1, 2  # what a turn's fault is to the lattice
KEEP, REROLE, DELETE, INSERT, MEND = 0, 3, 4, 3, 3
#: What the roles spell so far: nothing, s, ..u, ..a. The role that may come next, and where it leads.
NEXT, THEN = "uuau", (2, 2, 3, 2)
STATES, ENDS = 4, (0, 3)
BLOCK = 64  # turns of a lattice solved at once
OUT = "conv_id {}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def arcs(i: int, q: int, turns: list[tuple[str, int]]) -> list[tuple[str, int, int, int]]:
    """(letter, cost, i, q) of the edits from a node, by letter. turns: role initial and fault."""
    out = []
    if i < len(turns):
        initial, fault = turns[i]
        out.append(("D", DELETE, i + 1, q))
        out.append(("I", INSERT, i, THEN[q]))
        if fault != FAULTY:
            mend = MEND if fault == TRUNCATED else 0
            if initial == NEXT[q]:
                out.append(("K", KEEP + mend, i + 1, THEN[q]))
            elif initial == "s" and q == 0:
                out.append(("K", KEEP + mend, i + 1, 1))
            out.append(("R", REROLE + mend, i + 1, THEN[q]))
    else:
        out.append(("I", INSERT, i, THEN[q]))
    return out


def auction(turns: list[tuple[str, int]], exits: list[int | None]) -> list[int]:
    """Prices of the nodes, i * STATES + q. exits: what it costs to end at (len(turns), q), None where nothing may.

    The first four prices are the exact costs to the end, as each of these nodes has been an origin; the prices stay in use.
    """
    n = len(turns)
    out = [[(c, j * STATES + r) for _, c, j, r in arcs(k // STATES, k % STATES, turns)] for k in range((n + 1) * STATES)]
    end = (n + 1) * STATES
    for q, c in enumerate(exits):
        if c is not None:
            out[n * STATES + q].append((c, end))
    # a first guess that no arc contradicts: the least that each turn must cost, and the cheapest exit
    price = [0] * (end + 1)
    floor = min(c for c in exits if c is not None)
    for i in range(n, -1, -1):
        if i < n:
            fault = turns[i][1]
            floor += DELETE if fault == FAULTY else MEND if fault == TRUNCATED else 0
        price[i * STATES : (i + 1) * STATES] = [floor] * STATES
    for origin in range(STATES):
        path = [origin]
        while path[-1] != end:
            k = path[-1]
            best, to = min((c + price[j], j) for c, j in out[k])
            if price[k] < best:
                price[k] = best
                if len(path) > 1:
                    path.pop()
            else:
                path.append(to)
    return price


def repair(turns: list[tuple[str, int]], block: int = BLOCK) -> tuple[int, str]:
    """The least cost of edits that make the roles legal, and the least audit of that cost."""
    exits: list[int | None] = [0 if q in ENDS else None for q in range(STATES)]
    solved = []
    for at in range((max(0, len(turns) - 1)) // block * block, -1, -block):
        part = turns[at : at + block]
        price = auction(part, exits)
        solved.append((part, exits, price))
        exits = list(price[:STATES])
    q, audit = 0, []
    for k, (part, ends, price) in enumerate(reversed(solved)):
        letters, q = _trace(part, ends, price, q, k + 1 == len(solved))
        audit.append(letters)
    return exits[0], "".join(audit)


def _trace(turns: list[tuple[str, int]], exits: list[int | None], price: list[int], q: int, last: bool) -> tuple[str, int]:
    """The least letters along tight arcs that lead out of the block, and where they leave it.

    A block's exits come before the insertions at its end, as those stand in the next block, too; the last block's count.
    """
    n = len(turns)
    tight = lambda i, q, c, j, r: price[i * STATES + q] == c + price[j * STATES + r]
    leads = [[False] * STATES for _ in range(n + 1)]
    for i in range(n, -1, -1):
        if i == n:
            for r in range(STATES):
                leads[i][r] = exits[r] is not None and price[i * STATES + r] == exits[r]
        again = True
        while again:  # insertions stay at i
            again = False
            for r in range(STATES):
                if not leads[i][r] and any(leads[j][s] and tight(i, r, c, j, s) for x, c, j, s in arcs(i, r, turns) if i < n or last):
                    leads[i][r] = again = True
    i, out = 0, []
    while i < n or (last and not (exits[q] is not None and price[i * STATES + q] == exits[q])):
        x, i, q = next((x, j, s) for x, c, j, s in arcs(i, q, turns) if leads[j][s] and tight(i, q, c, j, s))
        out.append(x)
    return "".join(out), q


class Conversation:
    """One conversation as its rows stream by: judged first, then written."""

    def __init__(self) -> None:
        self.turns: list[tuple[str, int]] = []
        self.seen: set[tuple[str, int, int]] = set()
        self.blank = self.duplicate = self.truncated = self.illegal = self.distinct = self.cost = 0
        self.first: int | None = None
        self.last: int | None = None
        self.audit: str | None = None
        self.at = self.state = self.written = 0
        self.sha = hashlib.sha256()

    def judge(self, turn: int | None, role: str, t1: int, t2: int, blank: bool, truncated: bool) -> None:
        """The next row in order, after damage, by what is known without its text."""
        if turn is not None and turn != self.last:
            self.first, self.last, self.distinct = turn if self.first is None else self.first, turn, self.distinct + 1
        same = (role, t1, t2)
        repeated = same in self.seen
        self.seen.add(same)
        self.blank += blank
        self.duplicate += repeated and not blank
        self.truncated += truncated and not blank and not repeated
        if self.turns:
            self.illegal += self.turns[-1][0] + role[:1] not in ("su", "ua", "au")
        self.turns.append((role[:1], FAULTY if blank or repeated else TRUNCATED if truncated else SOUND))

    def solve(self) -> None:
        self.cost, self.audit = repair(self.turns)
        self.seen.clear()

    def _write(self, role: str, text: str) -> None:
        self.sha.update(f"{chr(10) if self.written else ''}{role}:{text}".encode(errors="surrogatepass"))
        self.written += 1

    def _inserted(self) -> None:
        while self.audit[self.at : self.at + 1] == "I":
            self._write("user" if NEXT[self.state] == "u" else "assistant", "")
            self.state = THEN[self.state]
            self.at += 1

    def write(self, role: str, text: str) -> None:
        """The next row in order, with its text."""
        if self.audit is None:
            self.solve()
        self._inserted()
        letter = self.audit[self.at]
        self.at += 1
        if letter == "R":
            role = "user" if NEXT[self.state] == "u" else "assistant"
        if letter != "D":
            self._write(role, text)
            self.state = 1 if role[:1] == "s" else THEN[self.state]

    def result(self) -> tuple:
        if self.audit is None:
            self.solve()
        self._inserted()
        gaps = 0 if self.first is None else self.last - self.first + 1 - self.distinct
        return gaps, self.blank, self.duplicate, self.truncated, self.illegal, self.cost, self.audit, self.sha.hexdigest()


def damaged(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, copies): each row's text and role after damage, and how often it stands there, 0 if dropped."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")) % 20
    known = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), space("role").alias("role"), space("text").alias("text"), kind.alias("kind"))
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    return known.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.when(F.col("kind") == 0, 0).when(F.col("kind") == 3, 2).otherwise(1).alias("copies"))


def repaired(rows: DataFrame) -> DataFrame:
    """The columns of OUT for every conv_id of rows (conv_id, turn, role, text, copies)."""
    blank = ~F.col("text").rlike(WORD)
    cut = ~F.right(F.rtrim("text", F.lit(SPACES)), F.lit(1)).isin(".", "!", "?")
    known = rows.select("*", F.xxhash64("text").alias("t1"), F.xxhash64(F.lit(13), "text").alias("t2"), blank.alias("blank"), cut.alias("cut"))
    # each row without its text, then, if it is there, with it
    passes: Column = F.when(F.col("copies") == 0, F.array(F.lit(0))).when(F.col("copies") == 1, F.array(F.lit(1), F.lit(2))).otherwise(F.array(*map(F.lit, (1, 1, 2, 2))))
    twice = known.withColumn("pass", F.explode(passes)).withColumn("text", F.when(F.col("pass") == 2, F.col("text")))
    order = (F.asc_nulls_first("conv_id"), "pass", F.asc_nulls_first("turn"), "role", "t1", "t2")
    placed = twice.select("conv_id", "pass", "turn", "role", "text", "t1", "t2", "blank", "cut").repartition("conv_id").sortWithinPartitions(*order)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        now, who = None, None
        for b in batches:
            kind = b.schema.field(0).type
            for conv, step, turn, role, text, t1, t2, blank, cut in zip(*(c.to_pylist() for c in b.columns)):
                if now is None or conv != who:
                    if now:
                        out.append((who, *now.result()))
                    now, who = Conversation(), conv
                    if len(out) >= 5000:
                        yield _batch(out, kind)
                        out = []
                if step == 1:
                    now.judge(turn, role, t1, t2, blank, cut)
                elif step == 2:
                    now.write(role, text)
        if now:
            yield _batch([*out, (who, *now.result())], kind)

    return placed.mapInArrow(work, OUT.format(rows.schema["conv_id"].dataType.simpleString()))


def _batch(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    names = [c.split()[0] for c in OUT.split(", ")]
    kinds = [kind, *[pa.int64()] * 6, pa.string(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)
