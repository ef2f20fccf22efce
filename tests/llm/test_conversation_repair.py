"""Conversation repair against a search over whole edit sequences."""

import hashlib
import random
import re
import zlib

from pyspark.sql import functions as F

from lexmesh.llm import conversation_repair as repair
from lexmesh.llm.queries import QUERIES

LEGAL = re.compile(r"(s?(ua)+)?")
CONVERSATIONS = "conv_id long, turn long, role string, text string"


def spelled(step):
    """The last letter that (last letter, next letter) leaves, None where the pattern has no such step."""
    return {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}.get(step)


def search(turns):
    """(cost, audit), least first, of all edits that spell the pattern; turns are (initial, fault)."""
    best = {"": (0, "")}

    def insert():
        for _ in range(4):
            for state, (cost, audit) in list(best.items()):
                for x in "ua":
                    if (to := spelled((state, x))) is not None:
                        best[to] = min(best.get(to, (1 << 30, "")), (cost + 3, audit + "I"))

    for initial, fault in turns:
        insert()
        new = {}

        def offer(state, cost, audit, new=new):
            new[state] = min(new.get(state, (1 << 30, "")), (cost, audit))

        for state, (cost, audit) in best.items():
            offer(state, cost + 4, audit + "D")
            if fault != repair.FAULTY:
                extra = 3 * (fault == repair.TRUNCATED)
                if (to := spelled((state, initial))) is not None:
                    offer(to, cost + extra, audit + "K")
                for x in "ua":
                    if (to := spelled((state, x))) is not None:
                        offer(to, cost + 3 + extra, audit + "R")
        best = new
    insert()
    return min(best[s] for s in ("", "a") if s in best)


def test_repairs_are_cheapest_and_least():
    rng = random.Random(6)
    for k in range(600):
        turns = [(rng.choice("uuuaaas "), rng.choice([0, 0, 0, 1, 2])) for _ in range(rng.randint(0, 9) if k % 12 else rng.randint(60, 150))]
        assert repair.repair(turns) == repair.repair(turns, block=3) == repair.repair(turns, block=1) == search(turns), turns


def test_prices_contradict_no_arc():
    rng = random.Random(7)
    for _ in range(50):
        turns = [(rng.choice("uas"), rng.choice([0, 1, 2])) for _ in range(12)]
        price = repair.auction(turns, [0, None, None, 0])
        for k in range(13 * repair.STATES):
            assert all(price[k] <= c + price[j * repair.STATES + r] for _, c, j, r in repair.arcs(k // repair.STATES, k % repair.STATES, turns))


def apply(rows):
    """op13's row of one conversation's damaged rows, in order, by definition."""
    turns, seen, counts = [], set(), {"blank": 0, "duplicate": 0, "truncated": 0}
    for turn, role, text in rows:
        bare = text.strip(" \t\n\x0b\x0c\r")
        fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None
        seen.add((role, text))
        if fault:
            counts[fault] += 1
        turns.append((role[:1], {None: 0, "truncated": 1}.get(fault, 2)))
    illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(turns, turns[1:]))
    known = [t for t, _, _ in rows if t is not None]
    gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
    cost, audit = search(turns)
    out, left = [], list(rows)
    for x in audit:
        need = "user" if not out or out[-1][0][:1] in ("s", "a") else "assistant"
        _, role, text = (None, need, "") if x == "I" else left.pop(0)
        if x != "D":
            out.append((need if x == "R" else role, text))
    assert LEGAL.fullmatch("".join(r[:1] for r, _ in out))
    return gaps, *counts.values(), illegal, cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest()


def check(spark, folder, rows):
    spark.createDataFrame(rows, CONVERSATIONS).withColumns({c: F.lit("z") for c in ("kind", "copies", "pass", "t1", "blank", "cut")}).repartition(4).write.parquet(f"{folder}/conversations.parquet")
    by = {}
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        by.setdefault(conv, []).extend([(turn, "user" if kind == 4 else role, text)] * {0: 0, 3: 2}.get(kind, 1))
    want = {conv: apply(sorted(r, key=lambda x: (x[0] is not None, x[0] or 0, x[1]))) for conv, r in by.items()}
    got = {r[0]: tuple(r)[1:] for r in QUERIES["op13_conversation_repair"](spark, str(folder)).collect()}
    assert got == want
    return got


def test_query_by_brute_force(spark, tmp_path):
    rng = random.Random(8)
    rows = []
    for conv in range(250):
        roles = ["system"] * (conv % 5 == 0) + ["user", "assistant"] * rng.randint(1, 5)
        rows += [(conv, t, r if rng.random() < 0.9 else rng.choice(["user", "assistant", "system", "tool"]), rng.choice(["Yes.", "No!", "well", "Say?\n", f"Number {rng.random()}.", f"Ends {rng.random()}"])) for t, r in enumerate(roles)]
    rows += [(1000, 3 * t, "user" if t % 2 == 0 else "assistant", f"Turn {t}.") for t in range(400)]
    check(spark, tmp_path, rows)


def test_odd_rows(spark, tmp_path):
    rows = [(1, None, "user", "A."), (1, None, "assistant", "B."), (2, None, None, None), (None, 1, "user", "Hi."), (None, None, "assistant", "Hm."), (3, 5, "user", "x."), (3, 5, "user", "x."), (4, 1, "", "Nothing."), (4, 2, "user", ""), (5, 7, "assistant", "Long. " * 20_000)]
    dropped = [t for t in range(200) if zlib.crc32(f"6:{t}".encode()) % 20 == 0]
    got = check(spark, tmp_path, rows + [(6, t, "user", "Gone.") for t in dropped])
    assert dropped and got[6] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
