import hashlib
import random
import re
import zlib
from functools import lru_cache

import pytest
from pyspark.sql import functions as F

from paperloom.llm import structure
from paperloom.llm.queries import damaged, repaired_conversations

SCHEMA = "conv_id long, turn long, role string, text string"
WORD = re.compile(r"[^\x20\x09-\x0D]")


def harmed(rows):
    for c, t, role, text in rows:
        role, text = role if role is not None else " ", text if text is not None else " "
        case = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        if case == 1:
            text = ""
        if case == 2:
            text = re.sub("[.!?]", "", text)
        if case == 4:
            role = "user"
        for _ in range({0: 0, 3: 2}.get(case, 1)):
            yield c, t, role, text


def model(rows):
    """Rows of one conversation after damage, repaired by comparing (cost, letters) of all ways."""
    same = lambda r: hashlib.md5(f"{len(r[2])}:{r[2]}:{r[3]}".encode()).digest()
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, same(r)))
    seen, faults = set(), []
    for r in rows:
        solid = WORD.findall(r[3])
        faults.append("blank" if not solid else "duplicate" if r[2:] in seen else "truncated" if solid[-1] not in ".!?" else None)
        seen.add(r[2:])
    follow = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}

    @lru_cache(None)
    def best(i, state, inserted):
        """(cost, letters, rows) from row i on."""
        ways = []
        if i == len(rows) and state in ("", "a"):
            ways.append((0, "", ()))
        if inserted < 2:
            for role in {"user", "assistant"}:
                if role[0] in follow[state]:
                    c, s, t = best(i, role[0], inserted + 1)
                    ways.append((c + 5, "I" + s, (f"{role}:", *t)))
        if i < len(rows):
            c, s, t = best(i + 1, state, 0)
            ways.append((c + 2, "D" + s, t))
            if faults[i] not in ("blank", "duplicate"):
                extra = 5 * (faults[i] == "truncated")
                _, _, role, text = rows[i]
                if role[:1] in follow[state]:
                    c, s, t = best(i + 1, role[:1], 0)
                    ways.append((c + extra, "K" + s, (f"{role}:{text}", *t)))
                for new in ("user", "assistant"):
                    if new[0] in follow[state]:
                        c, s, t = best(i + 1, new[0], 0)
                        ways.append((c + extra + 1, "R" + s, (f"{new}:{text}", *t)))
        return min(ways, default=(10**9, "", ()))

    cost, audit, lines = best(0, "", 0)
    turns = [r[1] for r in rows if r[1] is not None]
    initials = [r[2][:1] for r in rows]
    return {
        "gaps": max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0,
        **{f: faults.count(f) for f in ("blank", "duplicate", "truncated")},
        "illegal": sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])),
        "cost": cost, "audit": audit, "repaired_sha256": hashlib.sha256("\n".join(lines).encode()).hexdigest()}


def talk(r, conv, n):
    words = ["Yes.", "no", "What? ", "ok.\n", "fine! ", "a b", " ", "", "x. ", "é", None]
    roles = ["user", "assistant"] * 6 + ["system", "tool", "User", "", None, "super"]
    turns = list(range(n))
    for _ in range(n // 5):
        turns[r.randrange(n)] = r.choice([None, 0, 3, n + 4])
    return [(conv, t, r.choice(roles) if r.random() < 0.4 else roles[i % 2], r.choice(words) if r.random() < 0.5 else f"say {i}.") for i, t in enumerate(turns)]


def corpus(seed, n, longest=9):
    r = random.Random(seed)
    rows = [x for c in range(n) for x in talk(r, c, r.randint(1, longest))]
    rows += talk(r, None, 6) + rows[:5] + [(10**6 + i, 0, "user", "Gone.") for i in range(40)]
    r.shuffle(rows)
    return rows


def check(spark, rows):
    frame = spark.createDataFrame(rows, SCHEMA)
    got = {r["conv_id"]: r.asDict() for r in repaired_conversations(frame).collect()}
    want = {c: model([x for x in harmed(rows) if x[0] == c]) for c in {x[0] for x in rows}}
    assert len(got) == len(want)
    for c, w in want.items():
        assert {"conv_id": c} | w == got[c], c


def test_repairs_equal_all_ways(spark):
    check(spark, corpus(1, 150))


def test_pieces_of_a_long_conversation(spark, monkeypatch):
    """Cuts fall anywhere; costs and states pass from piece to piece."""
    monkeypatch.setattr(structure, "PIECE", 3)
    check(spark, corpus(2, 30, 40))


@pytest.mark.parametrize("block", [1, 2, 3])
def test_block_length_changes_nothing(block):
    r, own, other = random.Random(block), structure.Tables(block), structure.tables()
    for _ in range(200):
        symbols = [r.randrange(9) for _ in range(r.randrange(1, 30))]
        assert own.trace(symbols, structure.FINAL, 0, True) == other.trace(symbols, structure.FINAL, 0, True)
        assert own.matrix(symbols) == other.matrix(symbols)
    assert len(own.vectors) == len(other.vectors) < 400


def test_damage_is_that_of_the_rule(spark):
    rows = corpus(3, 60)
    got = sorted(map(tuple, damaged(spark.createDataFrame(rows, SCHEMA)).select("conv_id", "turn", "role", "text").collect()), key=str)
    assert got == sorted(harmed(rows), key=str)


def test_empty_table_and_clashing_names(spark):
    frame = spark.createDataFrame(corpus(4, 5), SCHEMA).withColumns({"k": F.lit(1), "at": F.lit("x"), "row": F.lit(None), "same": F.lit(2)})
    summary, repaired = structure.repair(frame)
    assert summary.count() == len({r["conv_id"] for r in frame.collect()})
    assert "D" not in {r["edit"] for r in repaired.collect()}
    for table in structure.repair(frame.limit(0)):
        assert table.count() == 0
    assert repaired_conversations(frame.limit(0)).count() == 0
