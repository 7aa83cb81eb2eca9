"""Near duplicates where ids are shared or missing: rows are what is linked."""
import random

import pytest

from helixframe.llm import op10_minhash

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    w = (text or "").translate(LOWER).split()
    return {tuple(w[i:i + 4]) for i in range(max(1, len(w) - 3))} if w else set()


def groups(rows):
    """Group number of every row (None without shingles) and the smallest id of each."""
    sets, root = [shingles(t) for _, t in rows], list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 80 * len(a | sets[j]):
                root[find(i)] = find(j)
    return [find(i) if s else None for i, s in enumerate(sets)]


def some_rows():
    r = random.Random(7)
    rows = []
    for g in range(8):
        base = [f"w{r.randrange(400)}" for _ in range(60)]
        for c in range(5):
            text = list(base)
            if c:
                text[r.randrange(60)] = f"x{g}{c}"
            rows.append((r.choice([g, g, 20 + c, 99, None]), " ".join(text)))
    rows += rows[:6] + [(99, "one"), (99, "two"), (None, "one"), (None, None), (None, None), (99, ""), (5, "  "), (3, "w" * 100_000), (None, "w" * 100_000)]
    rows += [(None, "lonely text without an id at all")] * 3
    return rows


@pytest.mark.parametrize("parts", [1, 3, 17])
def test_rows_equal_brute_force(docs_of, parts):
    rows = some_rows()
    of = groups(rows)
    least = {}
    for (i, _), g in zip(rows, of):
        if i is not None:
            least[g] = min(i, least.get(g, i))
    want = sorted((str(i), len(shingles(t)), str(i if g is None else least.get(g)), i is not None and i == (i if g is None else least[g])) for (i, t), g in zip(rows, of))
    got = op10_minhash.near_duplicates(docs_of(rows).repartition(parts))
    assert sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"]), r["kept"]) for r in got.collect()) == want


@pytest.mark.parametrize("parts", [1, 17])
def test_one_row_of_each_group_stays(docs_of, parts):
    rows = some_rows()
    of = groups(rows)
    kept = [(r["doc_id"], r["text"]) for r in op10_minhash.one_of_each(docs_of(rows).repartition(parts)).collect()]
    group_of = {(i, t): g for (i, t), g in zip(rows, of)}
    with_words = [group_of[k] for k in kept if group_of[k] is not None]
    assert sorted(with_words) == sorted({g for g in of if g is not None})  # one of each
    for k in kept:
        g = group_of[k]
        if g is not None:
            ids = [i for (i, _), h in zip(rows, of) if h == g and i is not None]
            assert k[0] == (min(ids) if ids else None)
    empty = sorted(str(k) for k in kept if group_of[k] is None)
    assert empty == sorted({str(k) for k, g in zip(rows, of) if g is None})
