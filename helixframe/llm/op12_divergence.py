"""Source divergence audit: how far the word shares of the sources of a language lie apart, in exact integers.

For each language the terms of enough documents are kept.  A group is a (language, source); its share of a term is the fixed-point
number p = 1 + floor(SCALE * (count + 2) / (N + 2 V)).  p depends on the count alone, so two groups are compared by their joint table
of count levels: with the one-hot matrix X of a block of terms (a column for each (group, level), one 1 for each term and group) the
product of X's transpose with X counts the terms of every pair of levels.  Those tables are exact (at most BLOCK_TERMS in float32) and
are priced level pair by level pair; only the summed price of two groups leaves a block.

Terms are dealt to blocks by hash, and groups to column blocks of ``COLUMN_GROUPS``, so a block holds at most about BLOCK_TERMS terms of
2 * COLUMN_GROUPS groups whatever the size of a language or source; within a task the rows of a block are halved until its columns fit
``COLUMNS``.  Counting combines in the task before the shuffle, one row for each (language, source, term) and flush.

Defined cases: null text, lang and source are the empty string; a group without terms takes part with count 0; a language without kept
terms gives 0 for all pairs and no term rows; rows are documents, so repeated rows count as often as they stand; other columns are
ignored; an empty table gives no rows.  Ties in value go by the UTF-8 bytes of the item.
"""
from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helixframe.llm.common import pieces, staged, text_of, tidy

SCALE = 1_000_000_000
MIN_DOCUMENTS = 10
TOP_TERMS = 10
BLOCK_TERMS = 4096
COLUMN_GROUPS = 64
COLUMNS = 2048
FLUSH = 200_000

# Upper case A-Z to lower case; every byte that belongs to no term becomes a space.  Bytes of 0x80 and more are letters of their own.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_COUNTS = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])


def _counted(batches):
    """Rows (lang, source, term, n, docs), combined over a task's documents and flushed when ``FLUSH`` pairs are held; term '' counts the documents of a group."""
    held, size = {}, 0

    def flushed():
        cols = [[], [], [], [], []]
        for (lang, source), terms in held.items():
            cols[0] += [lang] * len(terms)
            cols[1] += [source] * len(terms)
            cols[2] += [t.decode("utf-8", "replace") for t in terms]
            cols[3] += [v[0] for v in terms.values()]
            cols[4] += [v[1] for v in terms.values()]
        return pa.record_batch([pa.array(c, t) for c, t in zip(cols, _COUNTS.types)], schema=_COUNTS)

    from collections import Counter
    for batch in batches:
        for part in pieces(batch):
            for lang, source, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(2)):
                terms = held.setdefault((lang, source), {})
                before = len(terms)
                for t, n in [(b"", 0), *Counter(text.as_buffer().to_pybytes().translate(_FOLD).split()).items()]:
                    v = terms.get(t)
                    if v is None:
                        terms[t] = [n, 1]
                    else:
                        v[0] += n
                        v[1] += 1
                size += len(terms) - before
                if size >= FLUSH:
                    yield flushed()
                    held, size = {}, 0
    if held:
        yield flushed()
    held = None
    tidy()


def term_counts(docs: DataFrame, lang: str = "lang", source: str = "source", text: str = "text", partitions: int | None = None) -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents of every term of every group; term '' holds the number of documents."""
    d = docs.select(text_of(lang).alias("lang"), text_of(source).alias("source"), text_of(text).cast("binary").alias("text"))
    c = d.mapInArrow(_counted, "lang string, source string, term string, n bigint, docs bigint")
    c = c.repartition(partitions, "lang", "term") if partitions else c.repartition("lang", "term")
    return c.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def kept_terms(counts: DataFrame, least: int = MIN_DOCUMENTS) -> DataFrame:
    """(lang, term, n, of: array of (source, n)) of the terms in at least ``least`` documents of the language.  The array holds one entry for each source."""
    t = counts.where("term <> ''").groupBy("lang", "term").agg(F.sum("docs").alias("df"), F.sum("n").alias("n"), F.collect_list(F.struct("source", "n")).alias("of"))
    return t.where(F.col("df") >= least).drop("df")


def share(count: Column, total: Column, terms: Column) -> Column:
    """p, by decimals that hold counts up to 10^19 without loss."""
    d = lambda c: c.cast("decimal(20,0)")
    top = F.lit(SCALE).cast("decimal(10,0)") * d(count + 2)
    return F.lit(1) + F.call_function("div", top, d(total + 2 * terms))


def price(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / (p + q)): both are at most SCALE + 1, so the square fits 63 bits."""
    return F.call_function("div", (p - q) * (p - q), p + q)


def _shares(levels: np.ndarray, total: int, terms: int) -> np.ndarray:
    if len(levels) and int(levels.max()) < 9_000_000_000:  # SCALE * (count + 2) fits 63 bits
        return 1 + (levels + 2) * SCALE // (total + 2 * terms)
    return np.array([1 + SCALE * (int(c) + 2) // (total + 2 * terms) for c in levels], np.int64)


def level_products(counts: np.ndarray, totals: list[int], terms: int, columns: int = COLUMNS) -> np.ndarray:
    """Summed price of every pair of columns of ``counts`` (terms x groups): one-hot levels times their transpose, priced where the product is not 0."""
    rows, groups = counts.shape
    if not rows:
        return np.zeros((groups, groups), np.int64)
    found = [np.unique(counts[:, g], return_inverse=True) for g in range(groups)]
    width = np.cumsum([0, *[len(v) for v, _ in found]])
    if width[-1] > columns and rows > 1:
        return sum(level_products(part, totals, terms, columns) for part in (counts[:rows // 2], counts[rows // 2:]))
    onehot = np.zeros((rows, width[-1]), np.float32)
    for g, (_, at) in enumerate(found):
        onehot[np.arange(rows), width[g] + at] = 1
    p = np.concatenate([_shares(v, totals[g], terms) for g, (v, _) in enumerate(found)])
    of = np.repeat(np.arange(groups), np.diff(width))
    joint = onehot.T @ onehot  # terms of every pair of (group, level): whole numbers up to the rows of the block
    a, b = np.nonzero(joint)
    keep = of[a] < of[b]
    a, b = a[keep], b[keep]
    f = (p[a] - p[b]) ** 2 // (p[a] + p[b])
    out = np.zeros((groups, groups), np.int64)
    np.add.at(out, (of[a], of[b]), f * joint[a, b].astype(np.int64))
    return out + out.T


def _block(pdf: pd.DataFrame) -> pd.DataFrame:
    """One block of terms and pair of column blocks: rows without a term carry the groups (n their total, terms the kept terms of the language)."""
    lang, i, j = pdf["lang"].iloc[0], int(pdf["i"].iloc[0]), int(pdf["j"].iloc[0])
    head = pdf[pdf["term"].isna()].sort_values("g")
    body = pdf[pdf["term"].notna()]
    ids = head["g"].to_numpy()
    at, names = pd.factorize(body["term"])
    counts = np.zeros((len(names), len(ids)), np.int64)
    counts[at, np.searchsorted(ids, body["g"].to_numpy())] = body["n"].to_numpy()
    value = level_products(counts, [int(x) for x in head["n"]], int(head["terms"].iloc[0]))
    side = (ids // COLUMN_GROUPS) == i
    a, b = np.nonzero(np.outer(side, ~side) if i != j else np.triu(np.ones_like(value, bool), 1))
    return pd.DataFrame({"lang": lang, "a": ids[a], "b": ids[b], "value": value[a, b]})


def divergence(docs: DataFrame, lang: str = "lang", source: str = "source", text: str = "text", least: int = MIN_DOCUMENTS, top: int = TOP_TERMS,
               block_terms: int = BLOCK_TERMS) -> DataFrame:
    """(lang, source, part, item, value, rank): part ``pair`` compares each group with every other source of its language, part ``term``
    names the ``top`` terms whose share in the group lies above that in the language."""
    counts = staged(term_counts(docs, lang, source, text))
    kept = staged(kept_terms(counts, least))
    langs = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("terms"), F.sum("n").alias("total"))
    entries = kept.select("lang", "term", F.col("n").alias("n_lang"), F.explode("of").alias("e")).select("lang", "term", "n_lang", F.col("e.source").alias("source"), F.col("e.n").alias("n"))
    totals = entries.groupBy("lang", "source").agg(F.sum("n").alias("n"))
    groups = counts.where("term = ''").select("lang", "source").join(totals, ["lang", "source"], "left").join(langs, "lang", "left")
    # a row for each group: numbered within its language
    groups = groups.select("lang", "source", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n", "terms", "total")],
                           (F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1).alias("g"))
    groups = staged(groups)

    # every (block of terms, pair of column blocks) holds a row for each of its groups and for each count above 0
    blocks = F.greatest(F.lit(1), F.ceil(F.col("terms") / block_terms)).cast("int")
    last = groups.groupBy("lang").agg(F.floor(F.max("g") / COLUMN_GROUPS).cast("int").alias("last"))
    numbered = groups.join(last, "lang")
    own = F.floor(F.col("g") / COLUMN_GROUPS).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("last")), lambda o: F.struct(F.least(own, o).alias("i"), F.greatest(own, o).alias("j")))
    heads = numbered.select("lang", F.lit(None).cast("string").alias("term"), "g", "n", "terms", F.explode(F.sequence(F.lit(0), blocks - 1)).alias("tb"), "last")
    body = entries.select("lang", "source", "term", "n").join(numbered.select("lang", "source", "g", "terms", "last"), ["lang", "source"])
    body = body.select("lang", "term", "g", "n", "terms", F.pmod(F.xxhash64("term"), blocks).cast("int").alias("tb"), "last")
    cells = heads.unionByName(body).select("lang", "term", "g", "n", "terms", "tb", F.explode(pairs).alias("p")).select("lang", "term", "g", "n", "terms", "tb", "p.i", "p.j")
    value = cells.groupBy("lang", "tb", "i", "j").applyInPandas(_block, "lang string, a int, b int, value bigint")
    value = value.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    both = value.select("lang", F.explode(F.array(F.struct(F.col("a").alias("g"), F.col("b").alias("h")), F.struct(F.col("b").alias("g"), F.col("a").alias("h")))).alias("e"), "value")
    names = groups.select("lang", "g", "source")
    pair = (both.select("lang", "e.g", "e.h", "value").join(names, ["lang", "g"])
            .join(names.select("lang", F.col("g").alias("h"), F.col("source").alias("item")), ["lang", "h"]).select("lang", "source", "item", "value"))

    of = entries.join(groups.select("lang", "source", F.col("n").alias("total_g"), "terms", "total"), ["lang", "source"])
    p, q = share(F.col("n"), F.col("total_g"), F.col("terms")), share(F.col("n_lang"), F.col("total"), F.col("terms"))
    term = of.select("lang", "source", F.col("term").alias("item"), p.alias("p"), q.alias("q")).where("p > q").select("lang", "source", "item", price(F.col("p"), F.col("q")).alias("value"))

    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    ranked = lambda d, part: d.withColumn("rank", F.row_number().over(order)).withColumn("part", F.lit(part))
    out = ranked(pair, "pair").unionByName(ranked(term, "term").where(F.col("rank") <= top))
    return out.select("lang", "source", "part", "item", F.col("value").cast("bigint").alias("value"), "rank")


ORACLE = """
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
w AS (SELECT r, lang, source, unnest(regexp_extract_all(t, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM d),
k AS (SELECT lang, term, count(*)::HUGEINT AS n FROM w GROUP BY lang, term HAVING count(DISTINCT r) >= 10),
c AS (SELECT w.lang, w.source, w.term, count(*)::HUGEINT AS n FROM w JOIN k ON k.lang = w.lang AND k.term = w.term GROUP BY ALL),
l AS (SELECT lang, count(*)::HUGEINT AS v, sum(n)::HUGEINT AS total FROM k GROUP BY lang),
g AS (SELECT s.lang, s.source, coalesce((SELECT sum(n) FROM c WHERE c.lang = s.lang AND c.source = s.source), 0)::HUGEINT AS total, coalesce(l.v, 0)::HUGEINT AS v
  FROM (SELECT DISTINCT lang, source FROM d) s LEFT JOIN l ON l.lang = s.lang),
p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + (1000000000 * (coalesce(c.n, 0) + 2)) // (g.total + 2 * g.v) AS p
  FROM g JOIN k ON k.lang = g.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
q AS (SELECT k.lang, k.term, 1 + (1000000000 * (k.n + 2)) // (l.total + 2 * l.v) AS q FROM k JOIN l ON l.lang = k.lang),
pr AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
x AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(pr.value, 0)::BIGINT AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pr ON pr.lang = a.lang AND pr.source = a.source AND pr.item = b.source
  UNION ALL SELECT p.lang, p.source, 'term', p.term, ((p - q) * (p - q) // (p + q))::BIGINT FROM p JOIN q ON q.lang = p.lang AND q.term = p.term WHERE n > 0 AND p > q),
z AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item))::INTEGER AS rank FROM x)
SELECT lang, source, part, item, value, rank FROM z WHERE part = 'pair' OR rank <= 10
"""
