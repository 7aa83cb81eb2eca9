"""Conversation repair against exhaustive and plain dynamic programming."""
import hashlib
import itertools
import random
import re
import zlib

import pytest

from helixframe.llm import op11_conversations as C

SPACE = " \t\n\x0b\x0c\r"


def apply(rows, audit):
    """Roles and texts that an audit gives, or None if its keeps and inserts do not read (s?(ua)+)?."""
    out, k, last = [], 0, ""
    for x in audit:
        nxt = "assistant" if last == "u" else "user"
        if x == "I":
            out.append((nxt, ""))
            last = nxt[0]
            continue
        role, text = rows[k]
        k += 1
        if x == "D":
            continue
        if x == "R":
            role = nxt
        if not role:
            return None
        out.append((role, text))
        last = role[0]
    return out if re.fullmatch("(s?(ua)+)?", "".join(r[0] for r, _ in out)) else None


def price(faults, audit):
    cost, k = 0, 0
    for x in audit:
        if x == "I":
            cost += 5
            continue
        if x == "D":
            cost += 2
        elif faults[k] in ("blank", "duplicate"):
            return None
        else:
            cost += (x == "R") + 5 * (faults[k] == "truncated")
        k += 1
    return cost


def faults_of(rows):
    seen, out = set(), []
    for role, text in rows:
        shown = text.strip(SPACE)
        out.append("blank" if not shown else "duplicate" if (role, text) in seen else "truncated" if shown[-1] not in ".!?" else None)
        seen.add((role, text))
    return out


def by_steps(rows):
    """Plain forward pass: least (cost, audit) for each state."""
    best = {0: (0, "")}

    def better(d, k, v):
        if k not in d or v < d[k]:
            d[k] = v

    def inserted(best):
        best = dict(best)
        for _ in range(3):
            for s, (c, a) in list(best.items()):
                better(best, C._NEXT[s], (c + 5, a + "I"))
        return best

    for (role, _), fault in zip(rows, faults_of(rows)):
        new = {}
        for s, (c, a) in inserted(best).items():
            better(new, s, (c + 2, a + "D"))
            if fault not in ("blank", "duplicate"):
                more = 5 * (fault == "truncated")
                to, after = {"s": (1, (0,)), "u": (2, (0, 1, 3)), "a": (3, (2,))}.get(role[:1], (None, ()))
                if s in after:
                    better(new, to, (c + more, a + "K"))
                better(new, C._NEXT[s], (c + 1 + more, a + "R"))
        best = new
    return min(v for s, v in inserted(best).items() if s in (0, 3))


def by_enumeration(rows):
    faults, best = faults_of(rows), None
    for letters in itertools.product("DKR", repeat=len(rows)):
        for gaps in itertools.product(("", "I", "II"), repeat=len(rows) + 1):
            audit = "".join(g + x for g, x in zip(gaps, [*letters, ""]))
            cost = price(faults, audit)
            if cost is not None and (best is None or (cost, audit) < best) and apply(rows, audit) is not None:
                best = (cost, audit)
    return best


def plain(table):
    """The contract, row by row, from (conv_id, turn, role, text)."""
    convs = {}
    for cid, turn, role, text in table:
        rows = convs.setdefault(cid, [])
        shown = lambda x: " " if x is None else str(x)
        kind = zlib.crc32(f"{shown(cid)}:{shown(turn)}".encode()) % 20
        role, text = shown(role), shown(text)
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        rows += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    out = []
    for cid, rows in convs.items():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        turns = [t for t, _, _ in rows if t is not None]
        pairs = [(r, x) for _, r, x in rows]
        faults = faults_of(pairs)
        cost, audit = by_steps(pairs)
        lines = "\n".join(f"{r}:{x}" for r, x in apply(pairs, audit))
        out.append((cid, max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *[faults.count(f) for f in ("blank", "duplicate", "truncated")],
                    sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(pairs)), cost, audit, hashlib.sha256(lines.encode()).hexdigest()))
    return sorted(out, key=str)


def some_rows(r, n):
    texts = ["Yes.", "No!", "why", "", " \t\n", "a. b", "Yes. ", "é?"]
    return [(r.choice(["user", "assistant", "system", "user", "assistant", "tool", "User", "u", " "]), r.choice(texts)) for _ in range(n)]


def items_of(rows):
    return [(role[:1], "D" if f in ("blank", "duplicate") else "T" if f else "P", 1) for (role, _), f in zip(rows, faults_of(rows))]


def test_search_equals_enumeration():
    r = random.Random(1)
    for n in [0, 1, 2, 3, 4] * 12:
        rows = some_rows(r, n)
        assert C.cheapest(items_of(rows), 0, (0, 3), True) == by_enumeration(rows) == by_steps(rows)


def test_search_equals_steps_on_long_rows():
    r = random.Random(2)
    for n in [8, 20, 60, 300] * 10:
        rows = some_rows(r, n)
        assert C.cheapest(items_of(rows), 0, (0, 3), True) == by_steps(rows)


def test_chunks_join_to_the_whole():
    r = random.Random(3)
    for n in [3, 7, 12, 25] * 10:
        items = items_of(some_rows(r, n))
        cuts = sorted(r.sample(range(1, n), r.randint(1, 2)))
        parts = [items[a:b] for a, b in zip([0, *cuts], [*cuts, n])]
        paths = None
        for k, p in enumerate(parts):
            last = k == len(parts) - 1
            mine = {(s, t): x for s in (range(4) if k else (0,)) for t, ends in ([(0, (0, 3))] if last else [(t, (t,)) for t in range(4)]) if (x := C.cheapest(p, s, ends, last))}
            paths = mine if paths is None else C._joined(paths, mine)
        assert paths[0, 0] == C.cheapest(items, 0, (0, 3), True)


def table():
    r = random.Random(4)
    rows = []
    for cid in [*range(120), None, -5]:
        n = r.choice([1, 2, 3, 5, 9]) if cid != 7 else 200
        for k, (role, text) in enumerate(some_rows(r, n)):
            if cid != 7 or k % 3:
                text = text + (f" {k}." if r.random() < 0.5 else "")
            rows.append((cid, r.choice([k, k, k, k * 3, None, max(0, k - 1)]), r.choice([role, role, role, None]), r.choice([text, text, text, None])))
    rows += rows[:30] + [rows[40]] * 40  # repeated rows
    rows += [(500, None, "user", "x."), (500, None, "assistant", "y."), (501, 1, "", "z."), (502, 3, "user", "long " * 50_000 + "."), (503, 2, "user", " " * 1_000_000),
             (503, 4, "assistant", "\n" * 1_000_000 + "x"), (504, 2**62, "user", "a."), (504, -(2**62), "user", "b.")]
    return rows


@pytest.mark.parametrize("chunk,fan,parts", [(1024, 32, 3), (3, 2, 7), (1, 3, 1)])
def test_equals_plain_version(spark, chunk, fan, parts):
    rows = table()
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS n", "2 AS pos", "'x' AS ck", "3 AS fault", "4 AS idx").repartition(parts)
    got = C.repair(df, chunk, fan)
    assert got.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    want = [w if w[0] != 504 or w[1] < 2**63 else (w[0], None, *w[2:]) for w in plain(rows)]
    assert sorted([tuple(r) for r in got.collect()], key=str) == sorted(want, key=str)
    assert C.repair(df.limit(0)).count() == 0


def test_repaired_turns(spark):
    df = spark.createDataFrame([("a", 0, "assistant", "Hi.", 1), ("a", 1, "user", "Why?", 2), ("a", 2, "assistant", "So.", 1), ("b", 0, "user", "", 1)],
                               "conv_id string, turn long, role string, text string, copies long")
    got = sorted(tuple(r) for r in C.repaired_turns(df).collect())
    assert got == [("a", 0, "K", "user", "Why?"), ("a", 1, "K", "assistant", "So.")]


def test_oracle_on_awkward_rows():
    """The SQL twin gives the plain answers too, beyond what the given tables hold."""
    import duckdb
    import pyarrow as pa
    rows = [r for r in table() if r[0] != 504]
    con = duckdb.connect()
    con.register("conversations", pa.table([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.string(), pa.string()))], names=["conv_id", "turn", "role", "text"]))
    assert sorted(con.execute(C.ORACLE).fetchall(), key=str) == sorted([w for w in plain(rows)], key=str)
