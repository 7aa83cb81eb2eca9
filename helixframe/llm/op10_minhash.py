"""Near-duplicate documents by circulant MinHash.

One permutation sends a shingle to a cell of a ring, a second one, shifted circularly
by k, gives signature coordinate k: with the second permutation written twice in a row, all
coordinates of a shingle are one contiguous slice, and a signature is the element-wise
minimum of slices.  Signatures are banded; documents that share a band value are candidates and
every link is confirmed on the full shingle sets.

Components, not pairs, are wanted, so a bucket is not expanded into its pairs:

1. Documents with equal shingle sets are one class; classes go on.
2. Star rounds: each bucket compares its members with one pivot (first the member with most
   bucket mates, then random ones) and the links so far give components.  A pivot has then met all its
   mates and leaves the bucket, and a bucket of fewer than two ends; so does, before any round, one of two members
   whose set sizes alone rule a link out (most chance meetings are such, and their number grows with the square of the rows).
3. Buckets whose members still lie in several components are settled exactly: all members outside the
   bucket's main component meet all members, in blocks of at most ``BLOCK`` x ``BLOCK`` classes, and only
   confirmed links leave a block.

So no pair that shares a bucket goes unchecked unless its two ends are connected already.
With 32 bands of 5 a pair at the threshold is missed with probability 3e-6.

Defined cases: null or empty text has no shingles and links with nothing; a text with fewer
words is one shingle; repeated rows are one class and each is returned; rows are what is linked, so
two texts under one id are two rows, each with the links of its text, and sharing an id links nothing;
a row with a null id is linked like any other, and its component_id is the smallest id of its
component (null where no row of it has one); an empty table gives no rows; other columns are
ignored; long texts are read whole.
"""
from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.llm.common import components, staged, tidy
from helixframe.llm.shingles import WordHashes, mixed, shingle_set, words

BANDS, ROWS, RING, SEED = 32, 5, 1 << 22, 20240
BLOCK = 256


def signature_tables(k: int):
    """(windows over the doubled second permutation): row c holds the k coordinates of ring cell c."""
    second = np.random.Generator(np.random.PCG64(SEED)).permutation(RING).astype(np.int32)
    return np.lib.stride_tricks.sliding_window_view(np.concatenate([second, second[:k]]), k)


def signature(shingles: np.ndarray, table, k: int) -> np.ndarray:
    cells = (mixed(shingles ^ np.uint64(SEED)) % np.uint64(RING)).astype(np.int64)
    out = np.full(k, RING, np.int32)
    for at in range(0, len(cells), 2048):
        np.minimum(out, table[cells[at:at + 2048]].min(axis=0), out=out)
    return out


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    part = sig.reshape(bands, rows).astype(np.uint64)
    key = np.arange(1, bands + 1, dtype=np.uint64)
    for r in range(rows):
        key = mixed(key * np.uint64(0x9E3779B97F4A7C15) + part[:, r])
    return key.astype(np.int64)


def keyed_rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, k, h, text): ``h`` hashes the text, and ``k`` is the id, or ``h`` for a row without one, so that every row can be found again by (k, h)."""
    h = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    return docs.select(F.col(id_col).cast("bigint").alias("id"), F.coalesce(F.col(id_col).cast("bigint"), h).alias("k"), h.alias("h"), F.col(text_col).alias("text"))


def signed_rows(rows_in: DataFrame, n: int, bands: int, rows: int) -> DataFrame:
    """(id, k, h, n_shingles, f1, f2, bands): f1, f2 name the shingle set."""

    def run(batches):
        hashes, table = WordHashes(), signature_tables(bands * rows)
        for batch in batches:
            out = [[], [], [], []]
            for text in batch.column(3):
                s = shingle_set(words(text.as_py()), hashes, n)
                out[0].append(len(s))
                out[1].append(int(s.sum(dtype=np.uint64).astype(np.int64)))
                out[2].append(int(mixed(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64).astype(np.int64)))
                out[3].append(band_keys(signature(s, table, bands * rows), bands, rows) if len(s) else None)
            yield pa.record_batch([*batch.columns[:3], *[pa.array(x, pa.int64()) for x in out[:3]], pa.array(out[3], pa.list_(pa.int64()))],
                                  names=["id", "k", "h", "n_shingles", "f1", "f2", "bands"])
        hashes = table = batch = out = s = None
        tidy()

    return rows_in.mapInArrow(run, "id bigint, k bigint, h bigint, n_shingles bigint, f1 bigint, f2 bigint, bands array<bigint>")


def sets_of(rows_in: DataFrame, wanted: DataFrame, n: int) -> DataFrame:
    """(rep, s) for the wanted (k, h, rep): one text of each class travels by its key."""

    def run(batches):
        hashes = WordHashes()
        for batch in batches:
            s = [shingle_set(words(t.as_py()), hashes, n) for t in batch.column(1)]
            yield pa.record_batch([batch.column(0), pa.array([x.astype(np.int64) for x in s], pa.list_(pa.int64()))], names=["rep", "s"])
        hashes = batch = s = None
        tidy()

    found = rows_in.select("k", "h", "text").join(wanted, ["k", "h"]).select("rep", "text").mapInArrow(run, "rep bigint, s array<bigint>")
    return found.dropDuplicates(["rep"])  # a row that stands several times


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets meet the threshold."""
    p = pairs.join(sets.select(F.col("rep").alias("a"), F.col("s").alias("sa")), "a")
    p = p.join(sets.select(F.col("rep").alias("b"), F.col("s").alias("sb")), "b")
    na, nb, both = F.size("sa"), F.size("sb"), F.size(F.array_intersect("sa", "sb"))
    p = p.where(F.least(na, nb) * 100 >= F.greatest(na, nb) * percent)
    return p.where(both * 100 >= (na + nb - both) * percent).select("a", "b")


def labelled(members: DataFrame, comp: DataFrame | None) -> DataFrame:
    if comp is None:
        return members.withColumn("comp", F.col("rep"))
    return members.join(comp.withColumnRenamed("node", "rep"), "rep", "left").withColumn("comp", F.coalesce("component", "rep")).drop("component")


def shared_buckets(spread_rows: DataFrame, percent: int) -> DataFrame:
    """(bucket, c): buckets of c > 1 members, without those of two whose sizes ``n`` cannot meet the threshold."""
    per = spread_rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("c"), F.min("n").alias("n0"), F.max("n").alias("n1"))
    return per.where((F.col("c") > 2) | (F.col("c") == 2) & (F.col("n0") * 100 >= F.col("n1") * percent)).select("bucket", "c")


def with_pivot(members: DataFrame, order) -> DataFrame:
    """The members other than their bucket's pivot, with the pivot ``p``, its component ``pc`` and the bucket's size ``m``; ``order``: the pivot is the member with the largest."""
    top = members.withColumn("_o", order).groupBy("bucket").agg(F.max(F.struct("_o", F.col("rep").alias("p"), F.col("comp").alias("pc"))).alias("t"), F.count(F.lit(1)).alias("m"))
    return members.join(top.select("bucket", "t.p", "t.pc", "m"), "bucket").where("rep <> p")


def star_pairs(met: DataFrame) -> DataFrame:
    """Distinct (pivot, member) over the buckets of ``with_pivot``, but for those connected already."""
    return met.where("comp <> pc").select(F.greatest("rep", "p").alias("a"), F.least("rep", "p").alias("b")).distinct()


def joined(comp: DataFrame | None, found: DataFrame) -> DataFrame:
    """The components once the links found are added; without any they stay as they are."""
    if comp is None:
        return components(found)
    found = staged(found)
    if found.isEmpty():
        return comp
    return components(comp.select(F.col("node").alias("a"), F.col("component").alias("b")).unionAll(found))


def open_buckets(members: DataFrame) -> DataFrame:
    """Members of buckets that still hold several components, with the bucket's size and main component."""
    per = members.groupBy("bucket", "comp").agg(F.count(F.lit(1)).alias("c"))
    per = per.groupBy("bucket").agg(F.sum("c").alias("m"), F.max(F.struct("c", "comp")).alias("top"), F.count(F.lit(1)).alias("k")).where("k > 1")
    return members.join(per.select("bucket", "m", F.col("top.comp").alias("main"), (F.col("m") - F.col("top.c")).alias("o")), "bucket")


def settled(rest: DataFrame, sets: DataFrame, percent: int, block: int) -> DataFrame:
    """Confirmed links between members outside the main component and all members of an open bucket, block by block."""
    chunk = lambda n, salt: F.pmod(F.xxhash64(F.lit(salt), "bucket", "rep"), F.greatest(F.lit(1), F.ceil(F.col(n) / block)).cast("bigint"))
    all_of = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), F.greatest(F.lit(0).cast("bigint"), F.ceil(F.col(n) / block).cast("bigint") - 1)))
    target = rest.select("bucket", "rep", "comp", F.lit(0).alias("asks"), chunk("m", 1).alias("t"), all_of("o").alias("q"))
    asking = rest.where("comp <> main").select("bucket", "rep", "comp", F.lit(1).alias("asks"), all_of("m").alias("t"), chunk("o", 2).alias("q"))
    rows = target.unionAll(asking.select(*target.columns)).join(sets, "rep")

    def block_links(pdf: pd.DataFrame) -> pd.DataFrame:
        t, q = pdf[pdf.asks == 0], pdf[pdf.asks == 1]
        out = []
        if len(t) and len(q):
            size = t.s.map(len).to_numpy()
            flat, owner = np.concatenate(t.s.to_list()), np.repeat(np.arange(len(t)), size)
            o = np.argsort(flat, kind="stable")
            flat, owner = flat[o], owner[o]
            tr, tc = t.rep.to_numpy(), t.comp.to_numpy()
            for rep, comp, s in zip(q.rep, q.comp, q.s):
                lo, hi = np.searchsorted(flat, s, "left"), np.searchsorted(flat, s, "right")
                n = hi - lo
                at = np.repeat(hi - np.cumsum(n), n) + np.arange(n.sum())
                both = np.bincount(owner[at], minlength=len(t))
                hit = (both * 100 >= (size + len(s) - both) * percent) & (tc != comp)
                out += [(max(rep, x), min(rep, x)) for x in tr[hit]]
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return rows.select("bucket", "t", "q", "rep", "comp", "asks", "s").groupBy("bucket", "t", "q").applyInPandas(block_links, "a bigint, b bigint").distinct()


def grouped(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 4, percent: int = 80, bands: int = BANDS, rows: int = ROWS,
            rounds: int = 3, block: int = BLOCK) -> DataFrame:
    """(id, k, h, n_shingles, group, first_id), one row for each row of ``docs``: ``group`` names the component (null without shingles), ``first_id`` is its smallest id."""
    keyed = keyed_rows(docs, id_col, text_col)
    signed = staged(signed_rows(keyed, n, bands, rows))
    classes = signed.where("n_shingles > 0").groupBy("n_shingles", "f1", "f2").agg(F.min("id").alias("id0"), F.min(F.struct("k", "h")).alias("at"), F.first("bands").alias("bands"))
    classes = staged(classes.withColumn("rep", F.xxhash64("n_shingles", "f1", "f2")))  # a class is named by its set, not by an id that other texts may share
    spread = classes.select("rep", F.col("n_shingles").alias("n"), F.explode("bands").alias("bucket"))
    members = staged(spread.join(shared_buckets(spread, percent), "bucket").select("bucket", "rep", "c"))
    weight = members.groupBy("rep").agg(F.sum("c").alias("w"))
    sets = staged(sets_of(keyed, classes.join(weight, "rep").select("at.k", "at.h", "rep"), n))
    members = staged(members.select("bucket", "rep").join(weight.select("rep", "w"), "rep"))
    comp = None
    for k in range(rounds):
        order = F.col("w") if k == 0 else F.xxhash64(F.lit(k), "bucket", "rep")
        met = staged(with_pivot(labelled(members, comp), order))
        comp = joined(comp, confirmed(star_pairs(met), sets, percent))
        members = met.where("m > 2").select("bucket", "rep", "w")
    rest = open_buckets(labelled(members, comp))
    comp = joined(comp, settled(rest, sets, percent, block))
    of_class = classes.select("n_shingles", "f1", "f2", "rep", "id0").join(comp.withColumnRenamed("node", "rep"), "rep", "left")
    first = of_class.where("component is not null").groupBy("component").agg(F.min("id0").alias("id1"))
    of_class = of_class.join(first, "component", "left").select("n_shingles", "f1", "f2", F.coalesce("component", "rep").alias("group"),
                                                                F.when(F.col("component").isNull(), F.col("id0")).otherwise(F.col("id1")).alias("first_id"))
    return signed.drop("bands").join(of_class, ["n_shingles", "f1", "f2"], "left").select("id", "k", "h", "n_shingles", "group", "first_id")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 4, percent: int = 80, **options) -> DataFrame:
    """(id, n_shingles, component_id, kept), one row for each row of ``docs``."""
    g = grouped(docs, id_col, text_col, n, percent, **options)
    cid = F.coalesce("first_id", "id")
    return g.select(F.col("id").alias(id_col), "n_shingles", cid.alias("component_id"), F.coalesce(F.col("id") == cid, F.lit(False)).alias("kept"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 4, percent: int = 80) -> DataFrame:
    """One row of ``docs`` for each group: that with the smallest id (a row without an id only where the group has none), then with the
    smallest text hash.  Rows without shingles stay, equal ones (id and text) once."""
    g = staged(grouped(docs, id_col, text_col, n, percent).select("id", "k", "h", "group"))
    least = g.where("group is not null").groupBy("group").agg(F.min(F.struct(F.col("id").isNull().alias("bare"), F.col("k").alias("k"), F.col("h").alias("h"))).alias("w"))
    stay = least.select("w.bare", "w.k", "w.h").unionAll(g.where("group is null").select(F.col("id").isNull(), "k", "h")).distinct()
    names = docs.columns
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.col(id_col).cast("bigint").isNull().alias("bare"),
                        F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("h"), F.col(id_col).cast("bigint").alias("k"))
    keyed = keyed.withColumn("k", F.coalesce("k", "h"))
    return keyed.join(stay.select("bare", "k", "h"), ["bare", "k", "h"], "left_semi").dropDuplicates(["bare", "k", "h"]).select(*[F.col(f"row.`{c}`") for c in names])


ORACLE = """
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, unnest(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
  ELSE list_transform(range(1, len(w) - 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3]) END)) AS g FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l0 AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
l AS (SELECT a, b FROM l0 UNION ALL SELECT b, a FROM l0),
r(a, b) AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a, min(b) AS m FROM r GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least(d.doc_id, coalesce(c.m, d.doc_id)) AS component_id, d.doc_id <= coalesce(c.m, d.doc_id) AS kept
FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN c ON c.a = d.doc_id"""
