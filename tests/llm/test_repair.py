"""Repair of conversations: tables against plain dynamic programming, conversations over several tasks against one."""

import hashlib
import random
import re
import zlib
from functools import lru_cache

import numpy as np
import pytest

from tessella.llm import queries, repair

RNG = random.Random(11)
NAMES = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
BLANK = re.compile(r"[\x20\x09-\x0D]*")


def plain(rows):
    """The contract, row by row; ``rows``: role, text in order, after damage. Costs and audits by memoised search."""
    seen, marked = set(), []
    for role, text in rows:
        body = text.rstrip(" \t\n\x0b\x0c\r")
        fault = "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else ""
        seen.add((role, text))
        marked.append((role, text, fault))

    @lru_cache(None)
    def best(at, said):  # said: the letter of the last turn, or "" before the first
        options, put = [], ()
        for k in range(4):  # so many inserts, then the row or the end
            wanted = "a" if said == "u" else "u"
            name = "user" if wanted == "u" else "assistant"
            add = lambda cost, edit, turn, rest: options.append((2 * k + cost + rest[0], "I" * k + edit + rest[1], (*put, *turn, *rest[2])))  # noqa: E731, B023
            if at == len(marked) and said in ("", "a"):
                add(0, "", (), (0, "", ()))
            if at < len(marked):
                role, text, fault = marked[at]
                add(3, "D", (), best(at + 1, said))
                if fault not in ("blank", "duplicate"):
                    more = fault == "truncated"
                    if role[:1] == wanted or (role[:1] == "s" and said == ""):
                        add(more, "K", ((role, text),), best(at + 1, role[:1]))
                    add(2 + more, "R", ((name, text),), best(at + 1, wanted))
            put, said = (*put, (name, "")), wanted
        return min(options)

    cost, audit, turns = best(0, "")
    letters = [r[:1] for r, _, _ in marked]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(letters, letters[1:]))
    count = lambda f: sum(x == f for _, _, x in marked)
    told = "\n".join(f"{r}:{t}" for r, t in turns)
    return count("blank"), count("duplicate"), count("truncated"), illegal, cost, audit, hashlib.sha256(told.encode()).hexdigest()


def expected(table):
    """``table``: conv, turn, role, text as given; nulls are None."""
    spaced = lambda x: " " if x is None else str(x)
    convs = {}
    for conv, turn, role, text in table:
        rows = convs.setdefault(conv, [])
        role, text = spaced(role), spaced(text)
        f = zlib.crc32(f"{spaced(conv)}:{spaced(turn)}".encode()) % 20
        text = "" if f == 1 else re.sub("[.!?]", "", text) if f == 2 else text
        role = "user" if f == 4 else role
        rows += [(turn is not None, turn or 0, role, text)] * (0 if f == 0 else 2 if f == 3 else 1)
    out = []
    for conv, rows in convs.items():
        rows.sort(key=lambda r: (r[0], r[1], r[2].encode(), r[3].encode()))
        turns = {t for there, t, _, _ in rows if there}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        out.append((conv, gaps, *plain([(r, t) for _, _, r, t in rows])))
    return sorted(out, key=str)


def got(table):
    pieces = repair.repair(repair.damage(table), copies_col="copies")
    return sorted((tuple(r[n] for n in NAMES) for r in repair.conversations(pieces).collect()), key=str)


def talk(n_convs, longest):
    texts = ["Yes.", "No", "Well!", "", " \t\n", "so?  ", "é.", "…", None, "a\x0b.\x0c", "x" * 50 + "."]
    roles = ["user", "assistant", "system", "user", "assistant", None, "", "tool", "ub", "Assistant"]
    rows = []
    for conv in [*range(n_convs), None]:
        for k in range(RNG.randint(1, longest)):
            rows.append((conv, RNG.choice([k, k, k, k + RNG.randint(0, 3), None]), RNG.choice(roles), RNG.choice(texts)))
    return rows + rows[:20]


def test_tables_equal_plain_search():
    t = repair.tables()
    assert len(t.vectors) < 255 and t.next.shape == (len(t.vectors), repair.SYMBOLS**repair.BLOCK)
    letters = {0: ("user", ""), 1: ("system", "s."), 2: ("system", "s"), 3: ("user", "u."), 4: ("user", "u"), 5: ("assistant", "a."), 6: ("assistant", "a"), 7: ("x", "x."), 8: ("x", "x")}
    for _ in range(3000):
        symbols = np.array([RNG.randrange(9) for _ in range(RNG.randint(0, 11))], np.uint8)
        rows = [(letters[s][0], letters[s][1] and f"{k}{letters[s][1]}") for k, s in enumerate(symbols.tolist())]
        edits, state, cost = t.trace(symbols)
        more, _, _ = repair._closing(state)
        assert (cost, "".join(edits) + more) == plain(rows)[4:6]


def test_summaries_equal_the_whole():
    t = repair.tables()
    for _ in range(300):
        symbols = np.array([RNG.randrange(9) for _ in range(RNG.randint(1, 40))], np.uint8)
        at = RNG.randint(0, len(symbols))
        a, b = symbols[:at], symbols[at:]
        left, states = t.summary(b)
        first, entry, _ = t.trace(a, int(left[0]), 0)
        second, end, _ = t.trace(b, 0, entry)
        assert (first + second, end) == t.trace(symbols)[:2]
        assert end == states[0][entry]


@pytest.mark.parametrize("chunk", [1, 3, 2048])
def test_repair_equals_brute_force(spark, monkeypatch, chunk):
    monkeypatch.setattr(repair, "CHUNK_ROWS", chunk)
    rows = talk(60, 9) + [(999, k, RNG.choice(["user", "assistant"]), RNG.choice(["Yes.", "No", "Hm!"])) for k in range(120)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    table = table.selectExpr("*", "'x' AS audit", "1 AS cost", "'y' AS seq", "5 AS copies", "role AS letter").repartition(5)
    assert got(table) == expected(rows)


def test_hot_conversation_and_long_texts(spark):
    rows = [(7, k, "user" if k % 3 else "assistant", "same." if k % 2 else f"n{k}") for k in range(900)] + [(8, 0, "user", "a. " * 400_000), (8, 1, "assistant", "b" * 1_000_000)] + [(9, 5, "user", "again.")] * 300
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(6)
    assert got(table) == expected(rows)


def test_odd_tables(spark):
    schema = "conv_id string, turn int, role string, text string"
    assert got(spark.createDataFrame([], schema)) == []
    rows = [("a b", None, "user", "x."), ("a b", None, None, None), (None, None, None, None), ("é", 3, "system", "s.")]
    assert got(spark.createDataFrame(rows, schema)) == expected(rows)
    dropped = next(k for k in range(1000) if zlib.crc32(f"{k}:0".encode()) % 20 == 0)
    assert got(spark.createDataFrame([(dropped, 0, "user", "x.")], "conv_id long, turn long, role string, text string")) == [(dropped, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


def test_query_equals_brute_force(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    rows = [tuple(r) for r in table.select("conv_id", "turn", "role", "text").collect()]
    found = queries.QUERIES["op12_repair"](spark, sf_dir).collect()
    assert sorted((tuple(r[n] for n in NAMES) for r in found), key=str) == expected(rows)
