"""Licence scan: exact containment join of text blocks with licence templates.

All DataFrame functions.  A text is lower-cased (A-Z) and read as words, across line breaks, in half-overlapping
blocks of ``BLOCK`` words, so that every run of ``BLOCK`` / 2 words lies in one block.  A block meets a whole notice
when it holds at least ``THETA`` of the notice's distinct words, and a short template (fewer than ``WHOLE`` distinct words: a
part of those would fit the line of another licence) when it holds all.  A short template counts only where the document also has its
words in their order, at most ``GAP`` other words between two of them.  Words are ordered by their frequency over the blocks of the whole corpus,
rare first.  A block that meets a template T must hold one of T's first |T| - need + 1
words (prefix filter), have at least ``need`` words (length filter), and leave enough words
after the shared one on both sides (positional filter); what passes is verified exactly.
Templates and phrases are short lists given by the caller, so their tables are small by
construction; only their words are counted and the counts are the one thing collected.

Defined cases: null or empty text has no words, null first/last word, empty labels, score 0;
repeated rows are judged alike, also under one id; an empty table gives no rows; other
columns are ignored.  Long texts are exploded by block, never cut.
"""
from __future__ import annotations

import math
from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixframe.llm.common import ascii_lower, staged, text_of

# Phrases with their labels.
PHRASES = [("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved")]
# Licence notices as commonly published (words only), with the label each stands for.
TEMPLATES = [
    ("apache", "licensed under the apache license version"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("cc-by-nc", "licensed under cc by nc"),
    ("cc-by-sa", "licensed under a creative commons attribution sharealike license"),
    ("gpl", "this work is licensed under the gnu general public license version"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license"),
    ("reserved", "copyright all rights reserved"),
]
THETA, WHOLE, GAP = 0.8, 16, 3
BLOCK = 64
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_text(text: Column) -> Column:
    """The words of a text, joined by single spaces."""
    return F.trim(F.regexp_replace(ascii_lower(text), NOT_WORD, " "))


def _spaces(c: Column) -> Column:
    return F.length(c) - F.length(F.replace(c, F.lit(" "), F.lit("")))


def phrase_places(words: str, phrases=PHRASES) -> list[Column]:
    """n_words, n_base, first_word, last_word, base (array of labels) from a column of joined words."""
    w = F.col(words)
    n = F.when(w == "", F.lit(0)).otherwise(_spaces(w) + 1).cast("bigint")
    padded = F.concat(F.lit(" "), w, F.lit(" "))
    count, first, last, labels = [], [], [], []
    for phrase, label in phrases:
        parts = F.split(padded, f" (?={phrase} )", -1)
        has = padded.contains(f" {phrase} ")
        count.append(F.when(has, F.size(parts) - 1).otherwise(0))
        first.append(F.when(has, _spaces(parts[0])))
        last.append(F.when(has, n - _spaces(F.element_at(parts, -1))))
        labels.append(F.when(has, F.lit(label)))
    return [n.alias("n_words"), sum(count[1:], count[0]).cast("bigint").alias("n_base"), F.array_min(F.array(*first)).cast("bigint").alias("first_word"),
            F.array_max(F.array(*last)).cast("bigint").alias("last_word"), F.array_sort(F.array_distinct(F.array_compact(F.array(*labels)))).alias("base")]


def blocks_of(docs: DataFrame, key: list[str], words: str, size: int = BLOCK) -> DataFrame:
    """(key, w): the distinct words of each block as an array; ``words``: the words of a text joined by spaces."""
    split = docs.select(*key, F.split(F.col(words), " ").alias("w"))
    starts = F.when(F.size("w") <= size, F.array(F.lit(1))).otherwise(F.expr(f"sequence(1, size(w) - {size // 2}, {size // 2})"))
    return split.select(*key, "w", F.explode(starts).alias("at")).select(*key, F.array_distinct(F.slice("w", F.col("at"), size)).alias("w"))


def needed(template: str, theta: float) -> int:
    """How many of a template's distinct words a block must hold."""
    n = len(set(template.split()))
    return n if n < WHOLE else math.ceil(theta * n - 1e-9)


def in_order(template: str) -> str:
    """A pattern for a template's words in their order, over words between single spaces."""
    return " " + f"(?: [^ ]+){{0,{GAP}}} ".join(template.split()) + " "


def in_order_templates(words: str, templates=TEMPLATES) -> Column:
    """The templates (by number) whose words a text has in order; whole notices are not asked for it."""
    padded, found = F.concat(F.lit(" "), F.col(words), F.lit(" ")), []
    for t, (_, template) in enumerate(templates):
        parts = sorted(set(template.split()), key=lambda x: (-len(x), x))
        if len(parts) >= WHOLE:
            found.append(F.lit(t))
            continue
        has = padded.contains(f" {parts[0]} ")
        for x in parts[1:]:
            has = has & padded.contains(f" {x} ")
        found.append(F.when(F.when(has, padded.rlike(in_order(template))).otherwise(False), F.lit(t)))
    return F.array_compact(F.array(*found))


def contained_templates(docs: DataFrame, key: list[str], words: str, templates=TEMPLATES, theta: float = THETA) -> DataFrame:
    """(key, t, containment): every block and template (by number) that meet, best containment of each template and key."""
    sets = [(t, sorted(set(template.split()))) for t, (_, template) in enumerate(templates)]
    vocabulary = sorted(set(chain.from_iterable(s for _, s in sets)))
    need = [needed(template, theta) for _, template in templates]
    lit = lambda xs: F.array(*[F.lit(x) for x in xs])
    # only words of templates can be shared; the block's own size stays for the length filter
    shared = blocks_of(docs, key, words).select(*key, F.size("w").alias("n"), F.array_intersect("w", lit(vocabulary)).alias("w")).where(F.size("w") >= min(need))
    shared = staged(shared)  # read twice: to count the words and to join them
    counted = shared.select(F.explode("w").alias("word")).groupBy("word").count().collect()  # at most one row per template word
    freq = {r["word"]: r["count"] for r in counted}
    order = sorted(vocabulary, key=lambda x: (freq.get(x, 0), x))
    rank = {x: i + 1 for i, x in enumerate(order)}
    spark = docs.sparkSession
    prefix, ranked = [], []
    for (t, s), k in zip(sets, need):
        r = sorted(rank[x] for x in s)
        ranked.append((t, r))
        prefix += [(t, r[i], i, k, len(r)) for i in range(len(r) - k + 1)]
    rare = sorted({p[1] for p in prefix})
    table = spark.createDataFrame(prefix, "t int, r int, i int, need int, size int")
    tsets = spark.createDataFrame(ranked, "t int, tr array<int>")
    seen = shared.where(F.arrays_overlap("w", lit([order[r - 1] for r in rare])))
    seen = seen.select(*key, "n", F.array_sort(F.transform("w", lambda x: F.array_position(lit(order), x).cast("int"))).alias("br"))
    pairs = seen.select(*key, "n", "br", F.posexplode("br").alias("j", "r")).join(F.broadcast(table), "r")
    bound = F.lit(1) + F.least(F.col("size") - 1 - F.col("i"), F.size("br") - 1 - F.col("j"))
    # positional filter: words shared before this one, itself, and what can follow
    pairs = pairs.where((F.col("n") >= F.col("need")) & (F.least("i", "j") + bound >= F.col("need"))).join(F.broadcast(tsets), "t")
    share = F.size(F.array_intersect("br", "tr"))
    met = pairs.where(share >= F.col("need")).select(*key, "t", (share / F.col("size")).alias("containment"))
    return met.groupBy(*key, "t").agg(F.max("containment").alias("containment"))


def licence_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", phrases=PHRASES, templates=TEMPLATES, theta: float = THETA) -> DataFrame:
    d = docs.select(F.col(id_col).alias("_id"), text_of(text_col).alias("_text"))
    d = d.withColumn("_h", F.xxhash64("_text")).withColumn("_k", F.coalesce(F.col("_id").cast("string"), F.lit("")))
    d = d.select("_id", "_k", "_h", words_text(F.col("_text")).alias("_w"))
    met = contained_templates(d, ["_k", "_h"], "_w", templates, theta)
    met = met.groupBy("_k", "_h").agg(F.collect_list(F.struct("t", "containment")).alias("met"))  # as many as templates at most
    base = d.select("_id", "_k", "_h", *phrase_places("_w", phrases), in_order_templates("_w", templates).alias("ordered"))
    out = base.join(met, ["_k", "_h"], "left")
    out = out.withColumn("met", F.filter(F.coalesce("met", F.array().cast("array<struct<t:int,containment:double>>")), lambda m: F.array_contains("ordered", m["t"])))
    names = F.array(*[F.lit(label) for label, _ in templates])
    labels = F.array_sort(F.array_union("base", F.transform("met", lambda m: names[m["t"]])))
    return out.select(F.col("_id").alias(id_col), "n_words", "n_base", "first_word", "last_word", F.array_join("base", ",").alias("base_labels"),
                      F.array_join(labels, ",").alias("labels"),
                      F.when(F.size("base") > 0, F.lit(1.0)).otherwise(F.coalesce(F.array_max(F.transform("met", lambda m: m["containment"])), F.lit(0.0))).alias("score"))


def _oracle(phrases=PHRASES, templates=TEMPLATES, theta: float = THETA, size: int = BLOCK) -> str:
    """The same rows by plain comparison of every block with every template."""
    at = {label: f"list_filter(range(1, len(w) + 1), lambda i: {' AND '.join(f'w[i + {k}] = {x!r}' for k, x in enumerate(p.split()))})" for p, label in phrases}
    pattern = lambda t: in_order(t) if len(set(t.split())) < WHOLE else ""
    rows = ", ".join(f"('{label}', {sorted(set(t.split()))!r}, {needed(t, theta)}, '{pattern(t)}')" for label, t in templates)
    places = ", ".join(f"{expr} AS p{k}" for k, expr in enumerate(at.values()))
    every = "list_concat(" * (len(at) - 1) + "p0" + "".join(f", p{k})" for k in range(1, len(at)))
    labels = "list_filter([" + ", ".join(f"CASE WHEN len(p{k}) > 0 THEN '{x}' END" for k, x in enumerate(at)) + "], lambda x: x IS NOT NULL)"
    word = "'[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'"
    return f"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), {word}) AS w FROM documents),
b AS (SELECT doc_id, len(w) AS n, {places} FROM d),
base AS (SELECT doc_id, n, {every} AS p, list_sort({labels}) AS l FROM b),
blocks AS (SELECT doc_id, list_distinct(w[s:s + {size - 1}]) AS w FROM (SELECT doc_id, w, unnest(CASE WHEN len(w) <= {size} THEN [1]
  ELSE range(1, len(w) - {size // 2} + 1, {size // 2}) END) AS s FROM d)),
tm AS (SELECT * FROM (VALUES {rows}) v(label, tw, need, pattern)),
met AS (SELECT doc_id, label, pattern, max(len(list_intersect(w, tw)) / len(tw)::DOUBLE) AS c FROM blocks, tm WHERE len(list_intersect(w, tw)) >= need GROUP BY ALL),
own AS (SELECT met.doc_id, list(DISTINCT label) AS l, max(c) AS best FROM met JOIN d USING (doc_id)
  WHERE regexp_matches(' ' || array_to_string(d.w, ' ') || ' ', pattern) GROUP BY met.doc_id)
SELECT base.doc_id, n AS n_words, len(p) AS n_base, list_min(p) - 1 AS first_word, list_max(p) - 1 AS last_word, array_to_string(base.l, ',') AS base_labels,
  array_to_string(list_sort(list_distinct(list_concat(base.l, coalesce(own.l, [])))), ',') AS labels,
  CASE WHEN len(base.l) > 0 THEN 1.0 ELSE coalesce(own.best, 0.0) END AS score
FROM base LEFT JOIN own ON own.doc_id = base.doc_id"""


ORACLE = _oracle()
