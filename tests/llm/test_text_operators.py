"""Each text operator against a plain rule on small rows, and on edge rows and empty tables."""
import hashlib
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from helixframe.llm import op1_pii, op2_licences, op3_sentencepiece, op4_decontaminate, op5_toxicity, op6_suffixes, op9_tokens, op10_minhash

from .conftest import EDGE, PROSE

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


# ---- personal data
PATTERNS = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
            ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]


def plain_spans(text):
    out = []
    for k, (kind, p) in enumerate(PATTERNS):
        for m in re.finditer(p, text):
            d = re.sub(r"\D", "", m.group())
            luhn = sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0
            if (kind == "email" or kind == "ip" and all(int(x) <= 255 for x in m.group().split(".")) or kind == "card" and 12 <= len(d) <= 19 and luhn
                    or kind == "phone" and 9 <= len(d) <= 15):
                out.append((m.start(), k, m.end()))
    return sorted(out)


TRICKY = ["a@b.c@d.e x", "a@b.c_d@e.f", "..@x.y a@b a@b. a@b.c.", "1.2.3.4.5.6.7.8.9 300.1.1.1 0255.1.2.3 1.2.3", "4111 1111 1111 1111 and 4111-1111-1111-1112",
          "+1 (389) 555-5010, +12 3, ++49 30 1234567- x", "ü@b.de é1.2.3.4", "", "@", "+" * 50 + "1" * 30, "1" * 3000, "a" * 3000 + "@", "1.1.1.1@2.2", "0000000000000000 7.7.7.7"]


@pytest.mark.parametrize("text", TRICKY)
def test_base_spans(text):
    assert op1_pii.base_spans(text) == plain_spans(text)


def test_terms_that_give_an_entity_away(docs_of):
    near = [(i, f"{tree} the zebracorn desk write bob@x.org today {tree}") for i, tree in enumerate("ashen birch cedar dogwood elmwood hazel".split())]
    far = [(100 + i, f"the desk is here today and nothing else number {i}") for i in range(60)]
    docs = docs_of(near + far)
    rows = by_id(op1_pii.scan(docs))
    text = dict(near)[0]
    terms = {text[int(a):int(b)] for kind, a, b in (s.split(":") for s in rows[0]["spans"].split(",")) if kind == "term"}
    assert "zebracorn" in terms and "the" not in terms and "desk" not in terms
    assert rows[0]["n_email"] == 1 and rows[100]["spans"] == "" and rows[100]["n_term"] == 0
    clean = by_id(op1_pii.sanitised(docs))
    assert clean[0].asDict().keys() == set(docs.columns) and "zebracorn" not in clean[0]["text"] and "<EMAIL>" in clean[0]["text"]
    assert clean[100]["text"] == dict(far)[100]


def test_terms_of_a_rare_entity_are_judged(docs_of):
    """A few texts that share a word nobody else has give an entity away; one document never does."""
    far = [(100 + i, f"the desk is here today write number {i}") for i in range(60)]
    once, again = "the zebracorn desk write bob@x.org today", "a zebracorn for bob@x.org"
    rows = by_id(op1_pii.scan(docs_of([(0, once), (1, again), (2, f"{again} too"), *far])))
    assert rows[0]["spans"] == "term:4:13,email:25:34" and rows[0]["n_term"] == 1 and rows[1]["n_term"] == 1
    assert all(rows[100 + i]["n_term"] == 0 for i in range(60))
    rows = by_id(op1_pii.scan(docs_of([(0, once), *far])))
    assert rows[0]["spans"] == "email:25:34" and all(r["n_term"] == 0 for r in rows.values())


def plain_disclosing(rows):
    """{term: share} from (id, text) rows, counted one by one."""
    from collections import defaultdict
    from math import log2
    docs = {}
    for i, text in rows:
        docs.setdefault((i, text), 0)
        docs[i, text] += 1
    n = sum(docs.values())
    n_t, n_e, n_te = defaultdict(int), defaultdict(int), defaultdict(int)
    for (i, text), c in docs.items():
        spans = op1_pii.base_spans(text)
        who = {op1_pii.entity(text, s, k, e) for s, k, e in spans}
        for t in {w.lower() for w in op1_pii.WORD.findall(text)}:
            n_t[t] += c
        for e in who:
            n_e[e] += c
            for t in {w for w, _, _ in op1_pii.outside(text, spans)}:
                n_te[e, t] += c
    out = {}
    for (e, t), c in n_te.items():
        if n_e[e] < n:
            p = n_e[e] / n
            share = log2((c + p) / (n_t[t] + 1) / p) / -log2(p) - op1_pii.DOUBT / c
            if share >= 0.8:
                out[t] = max(share, out.get(t, 0))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_disclosing_equals_brute_force(docs_of, seed):
    r = random.Random(seed)
    vocab = ["".join(r.choice("abcdef") for _ in range(4)) for _ in range(300)]
    rows = []
    for i in range(400):
        words = [r.choice(vocab) for _ in range(r.randint(0, 8))]
        if r.random() < 0.2:
            who = r.randrange(25)
            words += [f"p{who}@x.org", f"secret{chr(97 + who)}", r.choice(["", f"+1 555 010 {1000 + who}"])]
        r.shuffle(words)
        rows.append((i if r.random() < 0.9 else None, " ".join(words)))
    rows += rows[:40] + [(900 + k, rows[k][1]) for k in range(40)]
    docs = docs_of(rows)
    found = op1_pii.found_rows(docs, "doc_id", "text")
    got = {x["t"]: x["share"] for x in op1_pii.disclosing(docs, found, len(rows), "text").collect()}
    want = plain_disclosing(rows)
    assert got.keys() == want.keys() and any(t.startswith("secret") for t in got)
    assert all(got[t] == pytest.approx(want[t], abs=1e-9) for t in want)


def test_terms_are_replaced_at_all_their_places(docs_of):
    filler = "the desk is here today " * 30
    near = [(i, f"write bob@x.org today {filler} Zebracorn {filler} zebracorn") for i in range(4)]
    far = [(50, "a zebracorn without the address"), *((100 + i, f"{filler} write number {i} without address") for i in range(60))]
    rows, clean = (by_id(f(docs_of(near + far))) for f in (op1_pii.scan, op1_pii.sanitised))
    for i, text in near + far:
        want = [f"term:{m.start()}:{m.end()}" for m in re.finditer("zebracorn", text, re.I)]
        assert [s for s in rows[i]["spans"].split(",") if s.startswith("term")] == want and rows[i]["n_term"] == len(want)
        assert "zebracorn" not in clean[i]["text"].lower()


def test_a_word_joins_its_terms_once(docs_of):
    """The words of twenty tasks are summed before they meet the terms: the join sees a word once, not once for each task."""
    docs = docs_of([(k, f"alpha beta word{k % 3}") for k in range(200)]).repartition(20)
    n_t = op1_pii.frequencies_of(docs, docs.selectExpr("explode(array('alpha', 'worda', 'beta')) AS t").distinct(), "text")
    assert sorted(map(tuple, n_t.collect())) == [("alpha", 200), ("beta", 200)]
    lines = [x.strip(" :+-|") for x in n_t._jdf.queryExecution().optimizedPlan().toString().splitlines()]
    join = next(k for k, x in enumerate(lines) if x.startswith("Join"))
    assert lines[join].startswith("Join Inner") and lines[join + 1].startswith(("Aggregate [t", "Filter"))
    assert not any(x.startswith("Aggregate") for x in lines[:join])


def test_pii_edges(docs_of):
    out = op1_pii.scan(docs_of(EDGE)).collect()
    assert len(out) == len(EDGE) and all(r["base_sha256"] == hashlib.sha256(b"").hexdigest() for r in out)
    kept = op1_pii.sanitised(docs_of(EDGE)).collect()
    assert sorted(map(str, (r["text"] for r in kept))) == sorted(map(str, (t for _, t in EDGE)))
    assert op1_pii.scan(docs_of([])).count() == 0


# ---- licences
def test_licences(docs_of):
    rows = [(1, "Under CC-BY, cc by!\nall rights reserved"), (2, "Released under the MIT License."), (3, "released the license"),
            (4, "x " * 200 + "this work is licensed under the GNU general public license " + "y " * 200), (5, "ALL rights\nreserved. cc\nby")]
    out = by_id(op2_licences.licence_scan(docs_of(rows)))
    assert (out[1]["n_words"], out[1]["n_base"], out[1]["first_word"], out[1]["last_word"], out[1]["base_labels"]) == (8, 3, 1, 5, "cc-by,reserved")
    assert out[2]["base_labels"] == "" and out[2]["labels"] == "mit" and out[2]["score"] == 1.0
    assert out[3]["labels"] == "" and out[3]["first_word"] is None
    assert out[4]["base_labels"] == "gpl" and out[4]["labels"] == "gpl" and out[4]["first_word"] == 207
    assert (out[5]["n_base"], out[5]["first_word"], out[5]["last_word"]) == (2, 0, 3)
    edge = op2_licences.licence_scan(docs_of(EDGE)).collect()
    assert len(edge) == len(EDGE) and all(r["labels"] == "" and r["score"] == 0 for r in edge)
    assert op2_licences.licence_scan(docs_of([])).count() == 0


def ordered(template: str, w: list[str]) -> bool:
    """The template's words one after the other, three other words at most between two of them."""
    ends = {k for k, x in enumerate(w) if x == template.split()[0]}
    for word in template.split()[1:]:
        ends = {k for e in ends for k in range(e + 1, min(e + 5, len(w))) if w[k] == word}
    return bool(ends)


def test_containment_join_is_exact(docs_of):
    vocab = sorted({w for _, t in op2_licences.TEMPLATES for w in t.split()}) + ["filler", "more"]
    rows = [(i, "\n".join(" ".join(vocab[(i * 7 + j * (3 + r)) % len(vocab)] for j in range(5 + (i + r) % 90)) for r in range(4))) for i in range(60)]
    r = random.Random(3)
    for i in range(60, 160):  # notices with words put in, taken out or exchanged, among others
        w = r.choice(op2_licences.TEMPLATES)[1].split()
        for _ in range(r.randrange(6)):
            k = r.randrange(len(w))
            w = r.choice([w[:k] + [r.choice(vocab)] * r.randrange(5) + w[k:], w[:k] + w[k + 1:], w[:k] + w[k + 1:k + 2] + w[k:k + 1] + w[k + 2:]]) or ["x"]
        rows.append((i, r.choice([" ", "\n"]).join(r.choices(vocab, k=r.randrange(100)) + w + r.choices(vocab, k=r.randrange(100)))))
    got = {r["doc_id"]: (r["labels"], round(r["score"], 9)) for r in op2_licences.licence_scan(docs_of(rows), phrases=[("zz zz", "zz")]).collect()}
    every = set()
    for i, text in rows:
        labels, best = set(), 0.0
        w = text.split()
        for b in [w] if len(w) <= 64 else [w[k:k + 64] for k in range(0, len(w) - 32, 32)]:
            for label, t in op2_licences.TEMPLATES:
                n, share = len(set(t.split())), len(set(t.split()) & set(b))
                if share == n and n < 16 and ordered(t, w) or n >= 16 and share >= math.ceil(0.8 * n):
                    labels.add(label)
                    best = max(best, share / n)
        assert got[i] == (",".join(sorted(labels)), round(best, 9)), text
        every |= labels
    assert every == {label for label, _ in op2_licences.TEMPLATES}


def test_licence_lines_get_their_own_label_alone(docs_of):
    bsd = "Redistribution and use in source and binary forms, with or without\nmodification, are permitted"
    mit = "Permission is hereby granted, free of charge, to any person\nobtaining a copy of this software\nand associated documentation files"
    gpl = "This program is free software: you can redistribute it and/or modify\nit under the terms of the GNU\nGeneral Public License"
    cases = [("This work is licensed under the GNU General Public License, version 3.", "gpl"), ("Released under the GPL: see the license", ""), ("licensed under CC BY 4.0", "cc-by"),
             ("subject to the terms of the Mozilla Public License version 2", ""), ("Licensed under the Apache License, Version 2.0", "apache"),
             ("This Source Code Form is subject to the terms of the Mozilla\nPublic License, v. 2.0", "mpl"), ("Released under the terms of the MIT License", "mit"),
             ("Released under the Apache license. Not so the mit. A license", ""), (bsd, "bsd"), (mit, "mit"), (gpl, "gpl")]
    filler = "sed ut perspiciatis unde omnis iste natus error sit voluptatem\n"
    rows = [(k, f"{filler * n}{text}\n{filler * n}") for k, (text, _) in enumerate(cases) for n in (0, 1, 9)]
    for k, labels in [(r["doc_id"], r["labels"]) for r in op2_licences.licence_scan(docs_of(rows)).collect()]:
        assert labels == cases[k][1], cases[k]


# ---- SentencePiece
def test_codec_equals_the_library(docs_of):
    import sentencepiece
    sp = sentencepiece.SentencePieceProcessor(model_file=op3_sentencepiece.MODEL)
    texts = ["hello  world\nfoo", " lead and trail ", "naïve 日本語 🎉 ².", "a" * 200 + "b", "x=1;\r\nif (a) {\r\n}\r\n", "tab\there", "Donau" * 30, "don't", "12345"]
    rows = [(i, t) for i, t in enumerate(texts)] + [(50 + i, f"unit{i} {PROSE[i % 2]}") for i in range(40)]
    out = by_id(op3_sentencepiece.decode(op3_sentencepiece.encode(docs_of(rows))))
    for i, t in rows:
        assert (i, out[i]["ids"], out[i]["decoded"]) == (i, sp.encode(t), t)


def test_codec_over_many_batches(docs_of, monkeypatch):
    import sentencepiece
    sp = sentencepiece.SentencePieceProcessor(model_file=op3_sentencepiece.MODEL)
    for name, value in (("BATCH_WORDS", 30), ("HELD_UNITS", 50), ("KNOWN", 10), ("SAMPLE", 2)):
        monkeypatch.setattr(op3_sentencepiece, name, value)
    rows = [(i, " ".join(words(i % 17, 25))) for i in range(60)]
    out = by_id(op3_sentencepiece.encode(docs_of(rows).coalesce(2)))
    assert all(out[i]["ids"] == sp.encode(t) and out[i]["round_trip"] for i, t in rows)


def test_codec_edges(docs_of):
    out = op3_sentencepiece.round_trip(docs_of(EDGE)).collect()
    assert len(out) == len(EDGE) and all(r["round_trip"] for r in out)
    assert op3_sentencepiece.round_trip(docs_of([])).count() == 0


# ---- benchmark passages
def words(seed, n):
    return [f"w{(seed * 7919 + i * i * 31 + i * 17) % 5003}" for i in range(n)]


def test_decontamination(spark, docs_of):
    item = words(1, 40)
    swapped = [("zz" if i % 6 == 3 else w) for i, w in enumerate(item)]  # every sixth word is another
    rows = [(1, " ".join(words(2, 50) + item + words(3, 50))), (2, " ".join(words(4, 60) + swapped)), (3, " ".join(words(5, 200))), (4, " ".join(item[10:30])),
            (5, "one two three four five six"), (6, " ".join(item[:8] + words(6, 30))), (7, " ".join(words(2, 30)).upper() + ", " + "; ".join(item).upper())]
    bench = spark.createDataFrame([(10, " ".join(item)), (11, "one two three four five six"), (12, None), (13, "")], "item_id long, text string")
    out = op4_decontaminate.contaminated(docs_of(rows), bench)
    assert {(r["doc_id"], r["item_id"]) for r in out.collect()} == {(1, 10), (2, 10), (4, 10), (5, 11), (7, 10)}
    left = op4_decontaminate.clean(docs_of(rows), bench)
    assert {r["doc_id"] for r in left.collect()} == {3, 6} and left.columns == docs_of(rows).columns
    assert [(r["doc_id"], r["item_id"]) for r in op4_decontaminate.contaminated(docs_of(EDGE), bench).collect()] == [(None, 11)]  # the row without an id
    assert op4_decontaminate.clean(docs_of(EDGE), bench).count() == len(EDGE) - 1
    assert op4_decontaminate.contaminated(docs_of([]), bench).count() == 0 and op4_decontaminate.contaminated(docs_of(rows), bench.limit(0)).count() == 0


def test_decontamination_over_the_broadcast_bound(spark, docs_of, monkeypatch):
    monkeypatch.setattr(op4_decontaminate, "BROADCAST_SEEDS", 0)
    item = words(1, 40)
    bench = spark.createDataFrame([(10, " ".join(item))], "item_id long, text string")
    assert [r["doc_id"] for r in op4_decontaminate.contaminated(docs_of([(1, " ".join(words(2, 50) + item)), (2, " ".join(words(5, 90)))]), bench).collect()] == [1]


def test_masks_meet_every_window_that_counts():
    from itertools import combinations
    for n in range(op4_decontaminate.SPAN, op4_decontaminate.WINDOW + 1):
        seen = [{at + k for k, c in enumerate(m) if c == "1"} for m in op4_decontaminate.MASKS for at in range(n - len(m) + 1)]
        for other in combinations(range(n), n - math.ceil(op4_decontaminate.SHARE * n - 1e-9)):
            assert any(s.isdisjoint(other) for s in seen), (n, other)


def test_short_items_and_documents_with_substitutions(spark, docs_of):
    item = words(1, 40)
    short = item[:12]
    rows = [(1, " ".join(words(2, 30) + ["zz" if i in (3, 8) else w for i, w in enumerate(short)] + words(3, 30))), (2, " ".join(item[20:28])),
            (3, " ".join(words(2, 30) + ["zz" if i in (3, 6, 8) else w for i, w in enumerate(short)] + words(3, 30)))]
    bench = spark.createDataFrame([(10, " ".join(item)), (11, " ".join(short))], "item_id long, text string")
    assert {(r["doc_id"], r["item_id"]) for r in op4_decontaminate.contaminated(docs_of(rows), bench).collect()} == {(1, 11), (2, 10)}


def test_items_of_one_to_four_words(spark, docs_of):
    rows = [(1, "say Zebracorn, now"), (2, "red green blue yellow"), (3, "red blue green yellow"), (4, " ".join(words(2, 40) + ["red", "green", "blue"])), (5, "red green")]
    bench = spark.createDataFrame([(10, "zebracorn"), (11, "red green blue yellow"), (12, "red green blue"), (13, "green yellow")], "item_id long, text string")
    out = op4_decontaminate.contaminated(docs_of(rows), bench)
    assert {(r["doc_id"], r["item_id"]) for r in out.collect()} == {(1, 10), (2, 11), (2, 12), (3, 13), (4, 12)}


# ---- toxicity
def test_toxicity_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    out = op5_toxicity.toxicity(docs, labels).join(labels, "doc_id").where("held_out").select("predicted", "toxic").toPandas()
    assert (out.predicted == out.toxic).mean() > 0.95 and out.predicted[out.toxic == 1].mean() > 0.7 and out.predicted[out.toxic == 0].mean() < 0.03


def test_toxicity_edges(spark, docs_of):
    labels = spark.createDataFrame([(i, i % 2, None) for i in range(20)], "doc_id long, toxic int, quality int")
    rows = [(i, ("stupid clown trash " if i % 2 else "calm green meadow ") * 30) for i in range(20)]
    out = by_id(op5_toxicity.toxicity(docs_of(rows), labels))
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in out.values())
    edge = op5_toxicity.toxicity(docs_of(EDGE), labels).collect()
    assert len(edge) == len(EDGE) and all(0 <= r["score"] <= 1 for r in edge)
    none = op5_toxicity.kept(docs_of(EDGE), labels.limit(0))
    assert none.count() == len(EDGE) and none.columns == docs_of(EDGE).columns
    assert op5_toxicity.toxicity(docs_of([]), labels).count() == 0


# ---- repeated bytes
def plain_repeats(rows):
    seen, out = set(), {}
    for doc, text in sorted(rows):
        b = (text or "").encode()
        hit = bytearray(len(b))
        for i in range(len(b) - 99):
            if b[i:i + 100] in seen:
                hit[i:i + 100] = b"\1" * 100
            seen.add(b[i:i + 100])
        kept = bytes(c for c, h in zip(b, hit) if not h)
        out[doc] = (len(b), sum(hit), sum(1 for i, h in enumerate(hit) if h and not (i and hit[i - 1])), hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("hot", [256, 1])
def test_repeats_equal_brute_force(docs_of, hot):
    p = " ".join(words(9, 60))
    rows = [(i, " ".join(words(20 + i, 30)) + p[(i * 13) % 90:200 + (i * 29) % 150] + " ".join(words(40 + i, 20))) for i in range(12)]
    rows += [(50, "ab" * 400), (51, "x" * 99), (52, "x" * 100), (53, "x" * 350), (54, p), (55, p), (56, "ü" * 120), (57, None), (58, ""), (59, p[:99])]
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in op6_suffixes.remove_repeats(docs_of(rows).repartition(5), hot=hot).collect()}
    assert got == plain_repeats(rows)


def test_repeats_of_chunked_texts_and_edges(docs_of, monkeypatch):
    monkeypatch.setattr(op6_suffixes, "CHUNK", 512)
    p = " ".join(words(9, 400))
    rows = [(1, p), (2, p[700:1900] + "q" + p[100:900]), (3, " ".join(words(8, 300)) + p[50:260])]
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in op6_suffixes.remove_repeats(docs_of(rows)).collect()}
    assert got == plain_repeats(rows)
    out = op6_suffixes.remove_repeats(docs_of(EDGE)).collect()
    first = [r for r in out if r["doc_id"] == 1]
    assert len(out) == len(EDGE) and len(first) == 2 and all(r["n_removed"] == 0 for r in first)  # rows repeated under one id are one document
    assert [r["n_removed"] for r in out if r["doc_id"] == 6] == [len(PROSE[0])]
    assert op6_suffixes.remove_repeats(docs_of([])).count() == 0


# ---- token counts
@pytest.mark.parametrize("block", [7, 1 << 18])
def test_token_counts(docs_of, block):
    with open(op9_tokens.TOKENIZER, "rb") as f:
        enc = op9_tokens.load_encoding(f.read())
    rows = [(i, " ".join(words(i, i % 23))) for i in range(30)] + [(90, None), (91, "<|endoftext|> x"), (92, "a  b   c " * 50)]
    got = {r["doc_id"]: r["n_tokens"] for r in op9_tokens.token_counts(docs_of(rows), block_tokens=block).collect()}
    assert got == {i: len(enc.encode_ordinary(t or "")) for i, t in rows}
    assert op9_tokens.token_counts(docs_of(EDGE)).count() == len(EDGE) and op9_tokens.token_counts(docs_of([])).count() == 0


def test_long_texts_are_cut_where_tokens_cannot_reach():
    with open(op9_tokens.TOKENIZER, "rb") as f:
        enc = op9_tokens.load_encoding(f.read())
    for text in ("one  two three\n four " * 40, "x" * 500, " lead" + " y" * 300, "a, b; c " * 90):
        parts = op9_tokens.safe_parts(text, 50)
        assert "".join(parts) == text and [t for p in parts for t in enc.encode_ordinary(p)] == enc.encode_ordinary(text)


# ---- near copies
def plain_groups(rows, n=4, percent=80):
    sets = {}
    for d, t in rows:
        w = re.findall("[^\x20\x09-\x0d]+", (t or "").translate(LOWER))
        sets[d] = {tuple(w[i:i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {d: (len(s), find(d)) for d, s in sets.items()}


def near_rows():
    base = [words(70 + g, 60) for g in range(4)]
    rows = []
    for g, b in enumerate(base):
        for c in range(12):
            w = list(b)
            for k in range(c % 5):
                w[(c * 11 + k * 17) % 60] = f"edit{c}_{k}"
            rows.append((g * 100 + c, " ".join(w)))
    return rows + [(900, None), (901, ""), (902, "two words"), (903, "Two  WORDS"), (904, "three words here")]


@pytest.mark.parametrize("rounds, block", [(3, 256), (1, 3)])
def test_near_copies_equal_brute_force(docs_of, rounds, block):
    rows = near_rows()
    out = op10_minhash.near_duplicates(docs_of(rows).repartition(6), rounds=rounds, block=block)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in out.collect()} == plain_groups(rows)


def test_pairs_settled_are_not_carried_on(spark):
    """A bucket of two that sizes rule out has no members at all, and a pivot leaves its bucket after its round."""
    rows = spark.createDataFrame([(1, 79, 7), (2, 100, 7), (3, 80, 8), (4, 100, 8), (5, 10, 9), (6, 100, 9), (7, 90, 9), (8, 50, 10)], "rep long, n long, bucket long")
    assert sorted(tuple(r) for r in op10_minhash.shared_buckets(rows, 80).collect()) == [(8, 2), (9, 3)]
    members = spark.createDataFrame([(8, 3, 3), (8, 4, 4), (9, 5, 5), (9, 6, 6), (9, 7, 5)], "bucket long, rep long, comp long")
    met = op10_minhash.with_pivot(members, F.col("rep"))
    assert sorted((r["bucket"], r["rep"], r["p"], r["m"]) for r in met.collect()) == [(8, 3, 4, 2), (9, 5, 7, 3), (9, 6, 7, 3)]
    assert sorted(tuple(r) for r in op10_minhash.star_pairs(met).collect()) == [(4, 3), (7, 6)]  # 5 and 7 are connected


def test_near_copies_edges(docs_of):
    out = op10_minhash.near_duplicates(docs_of(EDGE)).collect()
    assert len(out) == len(EDGE)
    assert {r["component_id"] for r in out if r["doc_id"] in (1, 6)} == {1} and all(r["n_shingles"] == 0 for r in out if r["doc_id"] in (2, 3, 7))
    one = op10_minhash.one_of_each(docs_of(EDGE + [(None, PROSE[0])]))
    assert sorted(str(r["doc_id"]) for r in one.collect()) == sorted(map(str, [1, 2, 3, None, None, 4, 5, 7])) and one.columns == docs_of(EDGE).columns
    assert op10_minhash.near_duplicates(docs_of([])).count() == 0


def test_one_signature_coordinate_is_a_circular_shift():
    table = op10_minhash.signature_tables(5)
    assert all(table[c][k] == table[(c + k) % op10_minhash.RING][0] for c in (0, 7, op10_minhash.RING - 2) for k in range(5))
