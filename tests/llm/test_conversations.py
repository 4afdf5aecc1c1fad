import hashlib
import itertools
import random
import sys
import zlib
from collections import defaultdict
from functools import lru_cache

import pytest

from brute import SF
from fleetrisk.llm import conversations as conv
from fleetrisk.llm.common import table

NEXT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}


def damage(rows):
    """{conv_id: [(turn, role, text)]} after damage, in order; dropped conversations stay with no row."""
    found = defaultdict(list)
    for c, t, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        found[c]
        if kind == 0:
            continue
        if kind == 1:
            text = ""
        if kind == 2:
            text = "".join(x for x in text if x not in ".!?")
        if kind == 4:
            role = "user"
        found[c] += [(t, role, text)] * (2 if kind == 3 else 1)
    for group in found.values():
        group.sort(key=lambda r: (r[0] is not None, r[0] or 0, hashlib.md5(f"{r[1]}\0{r[2]}".encode()).hexdigest()))
    return found


def cheapest(rows):
    """(cost, audit) by recursion over suffixes; rows: (initial, must go, truncated)."""
    @lru_cache(None)
    def best(i, q, inserts):
        found = []
        if inserts < 4:
            to = next(NEXT[q, x] for x in "ua" if (q, x) in NEXT)
            cost, audit = best(i, to, inserts + 1)
            found.append((cost + 5, "I" + audit))
        if i == len(rows):
            return min([(0, "")] if q in (0, 3) else found, default=(10 ** 9, ""))
        initial, gone, cut = rows[i]
        cost, audit = best(i + 1, q, 0)
        found.append((cost + 2, "D" + audit))
        if not gone:
            if (q, initial) in NEXT:
                cost, audit = best(i + 1, NEXT[q, initial], 0)
                found.append((cost + 5 * cut, "K" + audit))
            for x in "ua":
                if (q, x) in NEXT:
                    cost, audit = best(i + 1, NEXT[q, x], 0)
                    found.append((cost + 1 + 5 * cut, "R" + audit))
        return min(found)

    sys.setrecursionlimit(20_000)
    return best(0, 0, 0)


def expected(rows):
    counts, seen, symbols = [0, 0, 0], set(), []
    for _, role, text in rows:
        body = text.strip(" \t\n\v\f\r")
        fault = 0 if not body else 1 if (role, text) in seen else 2 if body[-1] not in ".!?" else None
        seen.add((role, text))
        if fault is not None:
            counts[fault] += 1
        symbols.append((role[:1], fault in (0, 1), fault == 2))
    cost, audit = cheapest(tuple(symbols))
    left, q, at = [], 0, 0
    for letter in audit:
        role, text = ("", "") if letter == "I" else rows[at][1:]
        at += letter != "I"
        if letter == "D":
            continue
        if letter in "IR":
            role = "assistant" if q == 2 else "user"
        q = NEXT[q, role[0]]
        left.append(f"{role}:{text}")
    turns = {t for t, _, _ in rows} - {None}
    pairs = [a[1][:1] + b[1][:1] for a, b in itertools.pairwise(rows)]
    return (max(turns) - min(turns) + 1 - len(turns) if turns else 0, *counts, sum(p not in ("su", "ua", "au") for p in pairs), cost, audit,
            hashlib.sha256("\n".join(left).encode()).hexdigest())


def found(df):
    return {r[0]: tuple(r[1:]) for r in df.select([c.split()[0] for c in conv.RESULT.split(", ")]).collect()}


def test_tables_are_the_rows_one_by_one():
    t = conv.tables()
    assert len(t.vectors) < 100 and all(min(v) == 0 for v in t.vectors)
    rng = random.Random(1)
    for _ in range(300):
        symbols = [rng.randrange(9) for _ in range(rng.randrange(12))]
        behind = rng.randrange(len(t.vectors))
        vector = t.vectors[behind]
        for s in reversed(symbols):
            vector = conv.before_row(s, vector)
        import numpy as np

        at, cost = t.segment_map(np.array(symbols, np.uint8))
        assert tuple(c + cost[behind] for c in t.vectors[at[behind]]) == vector


def random_rows(rng, conversations, longest):
    texts = ["Yes.", "No!", "why", "so it goes?", "  ", "", "fine", None, "a b c.", "\t\n", "é…"]
    roles = ["user", "assistant", "user", "assistant", "system", "tool", "", None]
    return [(c, t if rng.random() > 0.03 else None, rng.choice(roles), rng.choice(texts) if rng.random() < 0.5 else f"text {rng.random()}.")
            for c in range(conversations) for t in range(rng.randrange(1, longest)) if rng.random() > 0.05]


def test_random_conversations_are_brute_force(spark):
    rows = random_rows(random.Random(5), 120, 14)
    rows += [(None, 1, "user", "Hi."), (None, None, None, None), (7, 3, "user", "twin."), (7, 3, "user", "twin.")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumnRenamed("turn", "turn")
    got = found(conv.repair(df.selectExpr("*", "1 as seg", "'x' as tie", "2 as audit")))
    assert got == {c: expected(r) for c, r in damage(rows).items()}


@pytest.mark.parametrize("longest", [400])
def test_a_conversation_over_many_partitions(spark, longest):
    rng = random.Random(9)
    rows = [(5, t, rng.choice(["user", "assistant", "system"]), rng.choice(["same.", f"t{t % 40}.", f"own {t}", f"end {t}!"])) for t in range(longest)]
    rows += [(5, 3, "user", "same.")] * 30 + random_rows(rng, 5, 6) + [(9, 1, "user", "x" * 3_000_000 + ".")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        got = found(conv.repair(df))
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert got == {c: expected(r) for c, r in damage(rows).items()}


def test_empty_table_and_given_table(spark):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert conv.repair(empty).count() == 0
    df = table(spark, SF, "conversations")
    rows = [(r.conv_id, r.turn, r.role, r.text) for r in df.collect()]
    assert found(conv.repair(df)) == {c: expected(r) for c, r in damage(rows).items()}
