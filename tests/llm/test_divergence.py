"""Source divergence audit against a plain version in whole numbers."""
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from helixframe.llm import op12_divergence as D


def plain(rows, least, top):
    """rows: (text, lang, source)."""
    count, df, groups = defaultdict(Counter), defaultdict(Counter), set()
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        terms = re.findall("[^\x00-\x40\x5B-\x60\x7B-\x7F]+", low)
        count[lang, source].update(terms)
        df[lang].update(set(terms))
    out = []
    for lang, source in groups:
        kept = sorted(t for t, n in df[lang].items() if n >= least)
        sources = [s for a, s in groups if a == lang]
        shares = {}
        for s in [*sources, None]:
            c = sum((count[lang, x] for x in sources), Counter()) if s is None else count[lang, s]
            n = sum(c[t] for t in kept)
            shares[s] = {t: 1 + 10**9 * (c[t] + 2) // (n + 2 * len(kept)) for t in kept}
        f = lambda p, q: (p - q) ** 2 // (p + q)
        p = shares[source]
        parts = {"pair": [(o, sum(f(p[t], shares[o][t]) for t in kept)) for o in sources if o != source],
                 "term": [(t, f(p[t], shares[None][t])) for t in kept if count[lang, source][t] and p[t] > shares[None][t]]}
        for part, items in parts.items():
            items.sort(key=lambda x: (-x[1], x[0].encode()))
            out += [(lang, source, part, i, v, k + 1) for k, (i, v) in enumerate(items) if part == "pair" or k < top]
    return sorted(out)


def corpus(seed, sources, docs, words):
    r = random.Random(seed)
    vocab = ["".join(r.choice("abcXYZäß語") for _ in range(r.randint(1, 4))) for _ in range(words)]
    rows = []
    for _ in range(docs):
        source = r.choice(sources)
        k = sources.index(source)
        text = " ".join(r.choice(vocab[k % 7:] if r.random() < 0.5 else vocab) for _ in range(r.randint(0, 30)))
        rows.append((re.sub(" ", lambda m: r.choice([" ", "1", "-", "\n", "\x7f", "@"]), text), r.choice(["en", "de"]), source))
    return rows


EDGES = [(None, "en", "s1"), ("", None, None), ("one two", None, None), ("1 2 3", "xx", "s9"), ("1", "xx", "s8"), ("a", "en", "only here"), ("a", "", ""), ("word " * 5000, "en", "s0"), (" " * 100_000, "en", "s0"),
         ("x" * 100_000, "en", "s0"), ("same text", "fr", "b"), ("same text", "fr", "a"), ("same text", "fr", "é"), ("same text", "fr", "z")]


@pytest.mark.parametrize("seed,n_sources,docs,least,block,parts", [(1, 4, 60, 2, 4096, 3), (2, 70, 300, 3, 8, 7), (3, 2, 10, 10, 1, 1)])
def test_equals_brute_force(spark, seed, n_sources, docs, least, block, parts):
    rows = corpus(seed, [f"s{i}" for i in range(n_sources)], docs, 40) + EDGES + EDGES[10:12]
    df = spark.createDataFrame(rows, "text string, lang string, source string").selectExpr("*", "1 AS n", "2 AS term", "'x' AS item", "3 AS doc_id", "4 AS g").repartition(parts)
    got = D.divergence(df, least=least, top=3, block_terms=block)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(tuple(r) for r in got.collect()) == plain(rows, least, 3)
    assert D.divergence(df.limit(0)).count() == 0


def test_flush_does_not_change_counts(spark, monkeypatch):
    rows = corpus(4, ["a", "b"], 50, 30)
    monkeypatch.setattr(D, "FLUSH", 3)
    df = spark.createDataFrame(rows, "text string, lang string, source string")
    assert sorted(tuple(r) for r in D.divergence(df, least=2, top=3).collect()) == plain(rows, 2, 3)


@pytest.mark.parametrize("columns", [4, 64, 4096])
def test_level_products(columns):
    rng = np.random.default_rng(0)
    counts = rng.integers(0, 6, (200, 9)) * rng.integers(0, 2, (200, 9))
    counts[7] = rng.integers(10**9, 10**13, 9)  # beyond 63 bits when scaled
    totals = [int(x) for x in counts.sum(0)]
    want = np.zeros((9, 9), object)
    p = [[1 + 10**9 * (int(c) + 2) // (totals[g] + 400) for c in counts[:, g]] for g in range(9)]
    for a in range(9):
        for b in range(9):
            want[a, b] = sum((x - y) ** 2 // (x + y) for x, y in zip(p[a], p[b]))
    assert (D.level_products(counts, totals, 200, columns) == want).all()
