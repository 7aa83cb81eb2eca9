"""Conversation structure repair: the cheapest edits that make the roles of a conversation read ``(s?(ua)+)?``.

Edits: Keep (0), Rerole to user or assistant (1), Delete (2; required for blank and repeated rows), Insert an empty user or assistant
row (5); a truncated row that stays costs 5 more.  The edit lattice has a node for each (rows read, role state).  ``cheapest`` searches
it by bidirectional Dijkstra: a heap from the start and one from the end meet, all crossings of equal cost are finished, and the least
audit string over all of them is read off by walking both trees in step, so no node carries a string.

No group is gathered whole.  Equal rows of a conversation are one row with a multiplicity; positions come from a range-partitioned index;
the lattice is cut into ``CHUNK_ROWS`` rows, each chunk is solved from every state to every state, and chunks are joined ``FAN_IN`` at a
time (cost and audit of each pair of states).  Inserts before a row belong to its chunk, so audits of one chunk hold equally many row
letters and end in one: none is the beginning of another, and the least whole is made of least parts.  The repaired text streams
through one task for each conversation, sorted, holding the audit and one row.

States: 0 nothing yet, 1 after system, 2 after user, 3 after assistant; 0 and 3 may end.  Letters: D, I, K, R.

Defined cases: null role and text are one space; null turns come first; rows of one turn stand in the order of role, then text; a null
conv_id is a conversation of its own; an empty role has no initial, so it can't be kept and breaks the order; repeated rows are
duplicates (equal turns included); a conversation without rows after the damage has zeros, the empty audit and the hash of the empty
text; other columns are ignored; an empty table gives no rows; a gap count beyond 63 bits is null.
"""
from __future__ import annotations

import hashlib
from heapq import heappop, heappush

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixframe.llm.common import pieces, staged
from helixframe.operators.indexing import dense_index

CHUNK_ROWS = 1024
FAN_IN = 32
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
SPACES = " \t\n\x0b\x0c\r"
_NEXT = (2, 2, 3, 2)  # the state that an inserted or reroled row leads to
_BEFORE = ((), (), (0, 1, 3), (2,))
_KEPT = {"s": (1, (0,)), "u": (2, (0, 1, 3)), "a": (3, (2,))}  # initial: state it leads to, states it may follow
_LEGAL = ("su", "ua", "au")


# ---------------------------------------------------------------- the search
def _moves(items, i, st, tail):
    """(letter, cost, i, state) of the edits possible at a node, in ASCII order of their letters."""
    here = items[i] if i < len(items) else None
    if here:
        yield "D", DELETE * here[2], i + 1, st
    if here or tail:
        yield "I", INSERT, i, _NEXT[st]
    if here and here[1] != "D":
        more = TRUNCATED if here[1] == "T" else 0
        to, after = _KEPT.get(here[0], (None, ()))
        if st in after:
            yield "K", KEEP + more, i + 1, to
        yield "R", REROLE + more, i + 1, _NEXT[st]


def _moves_back(items, i, st, tail):
    """(cost, i, state) of the nodes from which an edit leads to this one."""
    if i < len(items) or tail:
        for p in _BEFORE[st]:
            yield INSERT, i, p
    if i:
        initial, kind, n = items[i - 1]
        yield DELETE * n, i - 1, st
        if kind != "D":
            more = TRUNCATED if kind == "T" else 0
            to, after = _KEPT.get(initial, (None, ()))
            if to == st:
                for p in after:
                    yield KEEP + more, i - 1, p
            for p in _BEFORE[st]:
                yield REROLE + more, i - 1, p


def cheapest(items, entry: int, ends, tail: bool):
    """(cost, audit) of the cheapest, then ASCII-least edits from state ``entry`` before the first item to one of the states ``ends`` behind
    the last, or None.  ``items``: (role initial, kind, n), kind D for n rows that must go, T truncated, P plain; ``tail`` allows inserts at the end."""
    start = (0, entry)
    goals = {(len(items), e) for e in ends}
    ahead, back = {start: 0}, {g: 0 for g in goals}
    heaps = [[(0, start)], [(0, g) for g in sorted(goals)]]
    settled = [set(), set()]
    best = 0 if start in goals else float("inf")
    while heaps[0] and heaps[1] and heaps[0][0][0] + heaps[1][0][0] <= best:  # equal: all crossings of the best cost are finished
        side = 0 if heaps[0][0][0] <= heaps[1][0][0] else 1
        cost, node = heappop(heaps[side])
        if node in settled[side]:
            continue
        settled[side].add(node)
        mine, other = (ahead, back) if side == 0 else (back, ahead)
        moves = ((w, (i, s)) for _, w, i, s in _moves(items, *node, tail)) if side == 0 else ((w, (i, s)) for w, i, s in _moves_back(items, *node, tail))
        for w, to in moves:
            if cost + w < mine.get(to, float("inf")):
                mine[to] = cost + w
                heappush(heaps[side], (cost + w, to))
            if to in other:
                best = min(best, cost + w + other[to])
    if best == float("inf"):
        return None
    settled[0].add(start)
    settled[1] |= goals  # their distance is exact, even if one heap ran dry before the other began
    # nodes of the forward tree from which a crossing of the best cost is reached
    live, stack = set(), []
    for node in settled[0]:
        if node in settled[1] and ahead[node] + back[node] == best or any(
                (i, s) in settled[1] and ahead[node] + w + back[i, s] == best for _, w, i, s in _moves(items, *node, tail)):
            live.add(node)
            stack.append(node)
    while stack:
        node = stack.pop()
        for w, i, s in _moves_back(items, *node, tail):
            if (i, s) in settled[0] and (i, s) not in live and ahead[i, s] + w == ahead[node]:
                live.add((i, s))
                stack.append((i, s))
    out, cost, node = [], 0, start
    while not (node in goals and cost == best):
        for letter, w, i, s in _moves(items, *node, tail):
            to, c = (i, s), cost + w
            if to in settled[1] and c + back[to] == best or to in live and c == ahead[to]:
                out.append(letter * items[node[0]][2] if letter == "D" else letter)
                cost, node = c, to
                break
        else:
            raise AssertionError("a crossing of the best cost must go on")
    return best, "".join(out)


def _joined(a: dict, b: dict) -> dict:
    """Paths {(from, to): (cost, audit)} through two neighbouring chunks."""
    out = {}
    for (s, u), (c, x) in a.items():
        for (v, t), (d, y) in b.items():
            if u == v:
                p = (c + d, x + y)
                if (s, t) not in out or p < out[s, t]:
                    out[s, t] = p
    return out


def _illegal(before: str | None, after: str | None) -> int:
    return int(before is not None and after is not None and before + after not in _LEGAL)


# ---------------------------------------------------------------- rows
def damaged(conv: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, turn, role, text, copies): the rows left after the rule-made damage; the key of the rule is crc32 of ``conv_id:turn``."""
    as_text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.pmod(F.crc32(F.encode(F.concat(as_text(conv_id), F.lit(":"), as_text(turn)), "UTF-8")), F.lit(20))
    d = conv.select(F.col(conv_id).alias("conv_id"), F.col(turn).alias("turn"), as_text(role).alias("role"), as_text(text).alias("text"), kind.alias("kind")).where("kind <> 0")
    return d.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"),
                    F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
                    F.when(F.col("kind") == 3, 2).otherwise(1).cast("bigint").alias("copies"))


def _key(c: str) -> Column:
    return F.when(F.col(c).isNull(), F.lit("n")).otherwise(F.concat(F.lit("c"), F.col(c).cast("string")))


def positioned(rows: DataFrame) -> DataFrame:
    """(ck, turn, role, text, n, pos): equal rows as one with their number, and their place in the conversation ``ck``."""
    r = rows.groupBy(_key("conv_id").alias("ck"), "turn", "role", "text").agg(F.sum("copies").alias("n"))
    return dense_index(r, ["turn", "role", "text"], ["ck"], name="pos").select("ck", "turn", "role", "text", "n", "pos")


def judged(placed: DataFrame) -> DataFrame:
    """(ck, pos, turn, n, initial, fault): the fault of the first of ``n`` equal rows (blank, duplicate, truncated or null); the others are duplicates, or blank like it."""
    shown = F.rtrim("text", F.lit(SPACES))
    same = F.sha2(F.concat_ws(":", F.length("role").cast("string"), "role", "text"), 256)
    r = placed.select("ck", "pos", "turn", "n", F.substring("role", 1, 1).alias("initial"), same.alias("same"), (shown == "").alias("blank"),
                      (~F.substring(shown, -1, 1).isin(".", "!", "?")).alias("cut"))
    first = r.where("not blank").groupBy("ck", "same").agg(F.min(F.struct("turn")).alias("first"))
    r = r.join(first, ["ck", "same"], "left")
    fault = F.when(F.col("blank"), "blank").when(~F.col("turn").eqNullSafe(F.col("first.turn")), "duplicate").when(F.col("cut"), "truncated")
    return r.select("ck", "pos", "turn", "n", "initial", fault.alias("fault"))


_PATHS = "array<struct<s:int,t:int,cost:bigint,audit:string>>"
_CHUNK_SQL = f"ck string, chunk bigint, head string, foot string, illegal bigint, paths {_PATHS}"
_CHUNK = pa.schema([("ck", pa.string()), ("chunk", pa.int64()), ("head", pa.string()), ("foot", pa.string()), ("illegal", pa.int64()),
                    ("paths", pa.list_(pa.struct([("s", pa.int32()), ("t", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())])))])


def _chunk_row(ck, chunk, head, foot, illegal, paths: dict) -> dict:
    return {"ck": ck, "chunk": chunk, "head": head, "foot": foot, "illegal": illegal,
            "paths": [{"s": s, "t": t, "cost": c, "audit": a} for (s, t), (c, a) in sorted(paths.items())]}


def _solve(batches):
    """Rows (ck, chunk, chunks, rows) to chunk rows: the cheapest paths from every state that may enter to every state that may leave."""
    for batch in batches:
        for part in pieces(batch, 64):
            out = []
            for ck, chunk, chunks, rows in zip(*(part.column(c).to_pylist() for c in range(4))):
                items, illegal, before = [], 0, None
                for r in rows:
                    forced = r["fault"] in ("blank", "duplicate")
                    items.append((r["initial"], "D" if forced else "T" if r["fault"] == "truncated" else "P", r["n"] if forced else 1))
                    if not forced and r["n"] > 1:
                        items.append((r["initial"], "D", r["n"] - 1))
                    illegal += _illegal(before, r["initial"]) + (r["n"] - 1) * _illegal(r["initial"], r["initial"])
                    before = r["initial"]
                last, paths = chunk == chunks - 1, {}
                for s in (range(4) if chunk else (0,)):
                    for t, ends in ([(0, (0, 3))] if last else [(t, (t,)) for t in range(4)]):
                        found = cheapest(items, s, ends, last)
                        if found:
                            paths[s, t] = found
                out.append(_chunk_row(ck, chunk, rows[0]["initial"], before, illegal, paths))
            yield pa.RecordBatch.from_pylist(out, schema=_CHUNK)


def _fold(batches):
    """Rows (ck, chunk, parts) to chunk rows: neighbouring chunks joined in order."""
    for batch in batches:
        for i in range(batch.num_rows):
            ck, chunk, parts = (batch.column(c)[i].as_py() for c in range(3))
            paths, illegal = None, 0
            for k, p in enumerate(parts):
                mine = {(x["s"], x["t"]): (x["cost"], x["audit"]) for x in p["paths"]}
                paths = mine if paths is None else _joined(paths, mine)
                illegal += p["illegal"] + (_illegal(parts[k - 1]["foot"], p["head"]) if k else 0)
            yield pa.RecordBatch.from_pylist([_chunk_row(ck, chunk, parts[0]["head"], parts[-1]["foot"], illegal, paths)], schema=_CHUNK)


def solved(faults: DataFrame, chunk_rows: int = CHUNK_ROWS, fan_in: int = FAN_IN) -> DataFrame:
    """(ck, illegal, cost, audit) of every conversation that has rows."""
    at = F.floor(F.col("pos") / chunk_rows).cast("bigint")
    sizes = faults.groupBy("ck").agg((F.max(at) + 1).alias("chunks"))
    rows = faults.groupBy("ck", at.alias("chunk")).agg(F.sort_array(F.collect_list(F.struct("pos", "initial", "fault", "n"))).alias("rows"))
    solved_rows = staged(rows.join(sizes, "ck").select("ck", "chunk", "chunks", "rows").mapInArrow(_solve, _CHUNK_SQL))
    most = faults.agg(F.max(at)).first()[0] or 0  # one number: the chunks of the longest conversation, less one
    while most:
        parts = solved_rows.groupBy("ck", F.floor(F.col("chunk") / fan_in).cast("bigint").alias("up")).agg(
            F.sort_array(F.collect_list(F.struct("chunk", "head", "foot", "illegal", "paths"))).alias("parts"))
        solved_rows = staged(parts.mapInArrow(_fold, _CHUNK_SQL))
        most //= fan_in
    end = F.col("paths")[0]
    return solved_rows.select("ck", "illegal", end["cost"].alias("cost"), end["audit"].alias("audit"))


# ---------------------------------------------------------------- repaired text
def _walk(batches):
    """Rows (ck, pos, role, text, n), sorted, each conversation led by its audit (pos -1, in the text), to (ck, letter, role, text) of every edit."""
    ck, audit, at, st = None, "", 0, 0

    def inserts():
        nonlocal at, st
        while at < len(audit) and audit[at] == "I":
            at, st = at + 1, _NEXT[st]
            yield ck, "I", "user" if st == 2 else "assistant", ""

    for batch in batches:
        for part in pieces(batch):
            for key, pos, role, text, n in zip(*(part.column(c).to_pylist() for c in range(5))):
                if pos < 0:
                    yield from inserts()
                    ck, audit, at, st = key, text, 0, 0
                    yield ck, "", None, None
                    continue
                for _ in range(n):
                    yield from inserts()
                    letter, at = audit[at], at + 1
                    if letter == "K":
                        st = _KEPT[role[0]][0]
                        yield ck, "K", role, text
                    elif letter == "R":
                        st = _NEXT[st]
                        yield ck, "R", "user" if st == 2 else "assistant", text
                    elif letter != "D":
                        raise ValueError("audit and rows do not fit")
    yield from inserts()


def _hashes(batches):
    """(ck, sha) of the repaired ``role:text`` lines, hashed as they stream by."""
    out, ck, sha, some = [], None, None, False
    schema = pa.schema([("ck", pa.string()), ("sha", pa.string())])
    for key, letter, role, text in _walk(batches):
        if not letter:
            if ck is not None:
                out.append({"ck": ck, "sha": sha.hexdigest()})
            ck, sha, some = key, hashlib.sha256(), False
            if len(out) >= 1000:
                yield pa.RecordBatch.from_pylist(out, schema=schema)
                out = []
            continue
        sha.update((("\n" if some else "") + role + ":" + text).encode())
        some = True
    if ck is not None:
        out.append({"ck": ck, "sha": sha.hexdigest()})
    if out:
        yield pa.RecordBatch.from_pylist(out, schema=schema)


_TURN = pa.schema([("ck", pa.string()), ("position", pa.int64()), ("edit", pa.string()), ("role", pa.string()), ("text", pa.string())])


def _turns(batches):
    """The repaired rows themselves, numbered within the conversation."""
    out, n, size = [], 0, 0
    for key, letter, role, text in _walk(batches):
        if not letter:
            n = 0
            continue
        out.append({"ck": key, "position": n, "edit": letter, "role": role, "text": text})
        n, size = n + 1, size + len(text)
        if len(out) >= 500 or size > 1 << 20:
            yield pa.RecordBatch.from_pylist(out, schema=_TURN)
            out, size = [], 0
    if out:
        yield pa.RecordBatch.from_pylist(out, schema=_TURN)


def _stream(placed: DataFrame, audits: DataFrame) -> DataFrame:
    lead = audits.select("ck", F.lit(-1).cast("bigint").alias("pos"), F.lit("").alias("role"), F.col("audit").alias("text"), F.lit(0).cast("bigint").alias("n"))
    both = lead.unionAll(placed.select("ck", "pos", "role", "text", "n"))
    return both.repartition("ck").sortWithinPartitions("ck", "pos")


def repaired_turns(rows: DataFrame, chunk_rows: int = CHUNK_ROWS, fan_in: int = FAN_IN) -> DataFrame:
    """(conv_id, position, edit, role, text): the repaired conversations of ``rows`` (conv_id, turn, role, text, copies)."""
    placed = positioned(rows)
    out = _stream(placed, solved(staged(judged(placed)), chunk_rows, fan_in)).mapInArrow(_turns, "ck string, position bigint, edit string, role string, text string")
    return out.select(_id_of(rows.schema["conv_id"].dataType), "position", "edit", "role", "text")


def _id_of(kind) -> Column:
    return F.when(F.col("ck") != "n", F.substring("ck", 2, 1 << 30)).cast(kind).alias("conv_id")


def repair(conv: DataFrame, chunk_rows: int = CHUNK_ROWS, fan_in: int = FAN_IN) -> DataFrame:
    """Contract columns for every conversation of ``conv`` after the rule-made damage."""
    placed = positioned(damaged(conv))
    faults = staged(judged(placed))
    some = lambda f, n: F.coalesce(F.sum(F.when(F.col("fault") == f, n)), F.lit(0))
    wide = lambda c: c.cast("decimal(20,0)")
    extra = F.when(F.coalesce("fault", F.lit("")).isin("blank", "duplicate"), 0).otherwise(F.col("n") - 1)
    facts = faults.groupBy("ck").agg(
        F.coalesce((wide(F.max("turn")) - wide(F.min("turn")) + 1 - F.countDistinct("turn")).try_cast("bigint"), F.when(F.count("turn") == 0, 0)).alias("gaps"),
        some("blank", F.col("n")).alias("blank"), (some("duplicate", F.col("n")) + F.sum(extra)).alias("duplicate"),
        some("truncated", F.lit(1)).alias("truncated"))
    answers = solved(faults, chunk_rows, fan_in)
    hashes = _stream(placed, answers).mapInArrow(_hashes, "ck string, sha string")
    ids = conv.select("conv_id").distinct().withColumn("ck", _key("conv_id"))
    out = ids.join(facts.join(answers, "ck").join(hashes, "ck"), "ck", "left")
    empty = hashlib.sha256(b"").hexdigest()
    known = F.col("cost").isNotNull()
    counts = [F.when(known, F.col(c)).otherwise(0).cast("bigint").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select("conv_id", *counts,
                      F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("sha", F.lit(empty)).alias("repaired_sha256"))


def _oracle() -> str:
    """The same answers by a forward pass in SQL: a state is kept as its padded cost followed by its audit, so the least text is the least pair."""
    pad, digits = 9, "000000000"
    add = lambda x, w, letter: f"(lpad((substr({x}, 1, {pad})::BIGINT + {w})::VARCHAR, {pad}, '0') || substr({x}, {pad + 1}) || '{letter}')"
    least = lambda *xs: f"list_min([{', '.join(xs)}])"
    none, more = "NULL::VARCHAR", "(CASE r[2] WHEN 'T' THEN 5 ELSE 0 END)"
    open_ = least("a[1]", "a[2]", "a[4]")
    keep = lambda initial, x: f"(CASE WHEN r[1] = '{initial}' THEN {add(x, more, 'K')} END)"
    step = f"""CASE r[2] WHEN 'I' THEN [a[1], a[2], {least('a[3]', add(open_, 5, 'I'))}, a[4]] WHEN 'J' THEN [a[1], a[2], a[3], {least('a[4]', add('a[3]', 5, 'I'))}]
      WHEN 'D' THEN [{', '.join(add(f'a[{k}]', 2, 'D') for k in (1, 2, 3, 4))}]
      ELSE [{add('a[1]', 2, 'D')}, {least(add('a[2]', 2, 'D'), keep('s', 'a[1]'))}, {least(add('a[3]', 2, 'D'), keep('u', open_), add(open_, f'1 + {more}', 'R'))},
            {least(add('a[4]', 2, 'D'), keep('a', 'a[3]'), add('a[3]', f'1 + {more}', 'R'))}] END"""
    spaces = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    return f"""
WITH k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key FROM conversations),
h AS (SELECT *, xor(list_reduce(list_transform(string_split(key, ''), lambda c: ord(c)::BIGINT), lambda a, b: list_reduce(range(8), lambda x, i: xor(x >> 1, CASE WHEN x & 1 = 1 THEN 3988292384 ELSE 0 END), xor(a, b)),
      4294967295::BIGINT), 4294967295) % 20 AS kind FROM k),
d AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
      unnest(range(CASE WHEN kind = 3 THEN 2 ELSE 1 END)) AS copy FROM h WHERE kind <> 0),
c AS (SELECT conv_id, row_number() OVER () AS ck FROM (SELECT DISTINCT conv_id FROM conversations)),
n AS (SELECT c.ck, turn, role, text, row_number() OVER (PARTITION BY c.ck ORDER BY turn NULLS FIRST, role, text, copy) AS pos, rtrim(text, {spaces}) AS shown
      FROM d JOIN c ON d.conv_id IS NOT DISTINCT FROM c.conv_id),
f AS (SELECT *, left(role, 1) AS initial, lag(left(role, 1)) OVER (PARTITION BY ck ORDER BY pos) AS before,
      CASE WHEN shown = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY ck, role, text ORDER BY pos) > 1 THEN 'duplicate' WHEN right(shown, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault FROM n),
s AS (SELECT ck, coalesce(max(turn)::HUGEINT - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count(*) FILTER (WHERE fault = 'blank') AS blank, count(*) FILTER (WHERE fault = 'duplicate') AS duplicate,
      count(*) FILTER (WHERE fault = 'truncated') AS truncated, count(*) FILTER (WHERE before IS NOT NULL AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal,
      flatten(list([['', 'I'], ['', 'J'], [initial, CASE fault WHEN 'blank' THEN 'D' WHEN 'duplicate' THEN 'D' WHEN 'truncated' THEN 'T' ELSE 'P' END]] ORDER BY pos)) || [['', 'I'], ['', 'J']] AS rows FROM f GROUP BY ck),
b AS (SELECT *, list_reduce(rows, lambda a, r: {step}, ['{digits}', {none}, {none}, {none}]) AS ends FROM s),
w AS (SELECT ck, gaps, blank, duplicate, truncated, illegal, substr(list_min([ends[1], ends[4]]), 1, {pad})::BIGINT AS cost, substr(list_min([ends[1], ends[4]]), {pad + 1}) AS audit FROM b),
e AS (SELECT ck, unnest(string_split(audit, '')) AS letter, generate_subscripts(string_split(audit, ''), 1) AS ix FROM w WHERE audit <> ''),
g AS (SELECT *, count(*) FILTER (WHERE letter <> 'I') OVER (PARTITION BY ck ORDER BY ix) AS pos, count(*) FILTER (WHERE letter <> 'D') OVER (PARTITION BY ck ORDER BY ix) AS nth FROM e),
j AS (SELECT g.*, f.role, f.text, f.initial FROM g LEFT JOIN f ON f.ck = g.ck AND f.pos = g.pos AND g.letter <> 'I' WHERE letter <> 'D'),
t AS (SELECT *, coalesce(max(CASE WHEN nth = 1 AND letter = 'K' AND initial = 's' THEN 1 END) OVER (PARTITION BY ck), 0) AS led FROM j),
o AS (SELECT ck, sha256(string_agg(CASE WHEN letter = 'K' THEN role WHEN (nth - led) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN letter = 'I' THEN '' ELSE text END, chr(10) ORDER BY nth)) AS sha FROM t GROUP BY ck)
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit, coalesce(sha, sha256('')) AS repaired_sha256
FROM c LEFT JOIN w ON w.ck = c.ck LEFT JOIN o ON o.ck = c.ck
"""


ORACLE = _oracle()
