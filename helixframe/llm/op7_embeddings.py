"""Near-duplicate vectors by randomised-rotation binary codes.

Vectors are compared within a label.  Equal vectors are one class.  Seeded random rotations turn a class's
unit vector o into the sign code of R o; the stored factor f = <code, R o> / sqrt(d) corrects the estimate
<o, q> ~ <code(o), R q> / (sqrt(d) f), which is unbiased, with standard error sqrt((1 - f^2) / f^2 / (d - 1)).

1. Slices of b code bits are bucket keys.  b follows the number of classes (about ``LOAD`` chance classes a bucket, whatever the size), and there are so
   many slices that a pair at the threshold shares none of them with probability ``MISS`` at most.
2. Buckets are compared in blocks of at most ``BLOCK`` x ``BLOCK`` classes.  A pair whose estimate plus
   ``SIGMAS`` standard errors stays below the threshold is dropped; every other pair is computed exactly in double
   precision.  A pair found in several tables counts in the first only.
3. A block returns, for each class, its number of links and one edge of a spanning forest, never its pairs.

Defined cases: a null label, a null, zero or empty vector and one with null or non-finite components links with nothing (0 links, its own
component, kept); vectors of different lengths are not compared; repeated rows are vectors of their own; a row without
an id is returned with 0 links, a null component and kept false; an empty table gives no rows; other columns are ignored.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.llm.common import components, spread, staged

SEED, MISS, LOAD = 4711, 1e-6, 16
BLOCK, SIGMAS, PAIRS = 512, 6.0, 50_000


def plan(n: int, threshold: float) -> tuple[int, int]:
    """(slices, bits) for n classes: two vectors at the threshold agree in one bit with probability 1 - angle / pi."""
    bits = int(np.clip(np.ceil(np.log2(max(n, 2) / LOAD)), 8, 30))
    agree = (1 - np.arccos(threshold) / np.pi) ** bits
    return int(np.ceil(np.log(MISS) / np.log(1 - agree))), bits


def rotation(d: int, k: int) -> np.ndarray:
    """The k-th random orthogonal matrix of size d."""
    q, r = np.linalg.qr(np.random.Generator(np.random.PCG64([SEED, d, k])).standard_normal((d, d)))
    return q * np.sign(np.diag(r))


def table_keys(unit: np.ndarray, tables: int, bits: int) -> np.ndarray:
    """(rows, tables): ``bits`` sign bits for each table, from as many rotations as that takes."""
    d = unit.shape[1]
    codes = np.concatenate([unit @ rotation(d, k).T > 0 for k in range(-(-tables * bits // d))], axis=1)[:, :tables * bits]
    return codes.reshape(len(unit), tables, bits) @ (1 << np.arange(bits))


def keyed_rows(classes: DataFrame, tables: int, bits: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            size = batch.column(1).value_lengths().to_numpy()
            keys = np.empty(len(size), object)
            for d in np.unique(size):
                at = np.flatnonzero(size == d)
                x = np.array(batch.column(1).take(pa.array(at)).to_pylist(), np.float64)
                got = table_keys(x / np.linalg.norm(x, axis=1, keepdims=True), tables, bits)
                for i, row in zip(at, got):
                    keys[i] = row.astype(np.int32)
            yield pa.record_batch([batch.column(0), pa.array(list(keys), pa.list_(pa.int32()))], names=["rep", "keys"])

    return classes.select("rep", "v").mapInArrow(run, "rep bigint, keys array<int>")


def block_links(rows: DataFrame, threshold: float, sigmas: float) -> DataFrame:
    """(rep, n, root): links of each class within one block, and the smallest class it reaches there.

    ``rows``: (bucket, ci, cj, side, t, rep, mult, v, keys); a block is one (bucket, ci, cj), its rows stand together, and all blocks of an Arrow batch are
    worked on at once, pair by pair in slices of ``PAIRS``."""

    def links(t: pa.Table):
        get = lambda c: t.column(c).to_numpy()
        v, keys = (t.column(c).combine_chunks() for c in ("v", "keys"))
        v, keys = (x if isinstance(x, pa.Array) else x.chunk(0) for x in (v, keys))
        size = v.value_lengths().to_numpy()
        block = np.cumsum(np.concatenate([[0], (get("bucket")[1:] != get("bucket")[:-1]) | (get("ci")[1:] != get("ci")[:-1]) | (get("cj")[1:] != get("cj")[:-1])]))
        side, table, rep, mult = get("side"), get("t"), get("rep"), get("mult")
        k = keys.flatten().to_numpy().reshape(len(rep), -1)
        flat, begin = v.flatten().to_numpy(), np.concatenate([[0], np.cumsum(size)])
        for d in np.unique(size):
            at = np.flatnonzero(size == d)
            x = flat[begin[at][:, None] + np.arange(d)]
            yield from links_of(x / np.linalg.norm(x, axis=1, keepdims=True), block[at], side[at], table[at], rep[at], mult[at], k[at])

    def links_of(x, block, side, table, rep, mult, keys):
        n, d = x.shape
        r = x @ rotation(d, 0).T
        code, f = np.sign(r), np.abs(r).sum(1) / np.sqrt(d)
        error = sigmas * np.sqrt(np.maximum(0, 1 - f ** 2) / f ** 2 / max(1, d - 1))
        last = np.searchsorted(block, block, "right")
        cross = np.searchsorted(block * 2 + side, block * 2 + 1)  # where the other side of the block begins
        start = np.where(cross == last, np.arange(1, n + 1), np.where(side == 0, cross, last))
        some = np.cumsum(last - start)
        found = [[], []]
        for a in range(0, int(some[-1]) if n else 0, PAIRS):
            pair = np.arange(a, min(a + PAIRS, int(some[-1])))
            i = np.searchsorted(some, pair, "right")
            j = last[i] - (some[i] - pair)
            may = np.einsum("ij,ij->i", code[i], r[j]) / (np.sqrt(d) * f[i]) + error[i] >= threshold
            i, j = i[may], j[may]
            # a pair that met in an earlier table was counted there
            new = ~((keys[i] == keys[j]) & (np.arange(keys.shape[1]) < table[i][:, None])).any(1)
            i, j = i[new], j[new]
            exact = np.einsum("ij,ij->i", x[i], x[j]) >= threshold
            found[0].append(i[exact])
            found[1].append(j[exact])
        i, j = (np.concatenate(z) if z else np.empty(0, np.int64) for z in found)
        if not len(i):
            return
        count, low = np.zeros(n, np.int64), rep.copy()
        np.add.at(count, i, mult[j])
        np.add.at(count, j, mult[i])
        while True:  # smallest rep that is reachable inside the block
            was = low.copy()
            np.minimum.at(low, i, low[j])
            np.minimum.at(low, j, low[i])
            if (was == low).all():
                break
        hit = count > 0
        yield pa.record_batch([pa.array(z[hit], pa.int64()) for z in (rep, count, low)], names=["rep", "n", "root"])

    def run(batches):
        held = None
        for batch in batches:
            part = pa.Table.from_batches([batch])
            t = part if held is None else pa.concat_tables([held, part])
            if not t.num_rows:
                continue
            tail = np.logical_and.reduce([t.column(c).to_numpy() == t.column(c)[-1].as_py() for c in ("bucket", "ci", "cj")])
            cut = int(np.flatnonzero(tail)[0])
            if cut:
                yield from links(t.slice(0, cut))
            held = t.slice(cut)
        if held is not None and held.num_rows:
            yield from links(held)

    n = spread(rows.sparkSession)
    dealt = rows.select("bucket", "ci", "cj", "side", "t", "rep", "mult", "v", "keys").repartition(n, "bucket", "ci", "cj").sortWithinPartitions("bucket", "ci", "cj", "side")
    return dealt.mapInArrow(run, "rep bigint, n bigint, root bigint")


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = 0.98, block: int = BLOCK, sigmas: float = SIGMAS) -> DataFrame:
    """(id, n_links, component_id, kept), one row for each row of ``vectors``."""
    v = F.col(vector_col).cast("array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.select(F.col(id_col).cast("bigint").alias("id"), F.col(label_col).cast("string").alias("label"), v.alias("v"),
                          F.coalesce(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & ~bad & F.exists(v, lambda x: x != 0), F.lit(False)).alias("ok"))
    rows = rows.withColumn("h1", F.xxhash64("label", "v")).withColumn("h2", F.xxhash64(F.lit("v"), "v", "label"))
    classes = staged(rows.where("ok").groupBy("h1", "h2").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("mult"), F.first("label").alias("label"), F.first("v").alias("v")))
    keyed = staged(keyed_rows(classes, *plan(classes.count(), threshold)))
    light = keyed.join(classes.select("rep", "label", F.size("v").alias("d")), "rep").select("rep", "label", "d", F.posexplode("keys").alias("t", "key"))
    light = light.select("rep", "t", F.xxhash64("label", "d", "t", "key").alias("bucket"))
    sizes = light.groupBy("bucket").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    members = light.join(sizes, "bucket").withColumn("k", F.greatest(F.lit(1), F.ceil(F.col("c") / block)).cast("int"))
    members = members.withColumn("q", F.pmod(F.xxhash64(F.lit(SEED), "rep"), F.col("k")).cast("int"))
    meets = F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("o")
    members = members.select("rep", "t", "bucket", "q", meets)  # chunk q meets chunk o, as the left side where q <= o
    members = members.select("rep", "t", "bucket", F.least("q", "o").alias("ci"), F.greatest("q", "o").alias("cj"), F.when(F.col("q") <= F.col("o"), 0).otherwise(1).alias("side"))
    full = members.join(classes.select("rep", "mult", "v").join(keyed, "rep"), "rep")
    found = staged(block_links(full, threshold, sigmas))
    links = found.groupBy("rep").agg(F.sum("n").alias("n"))
    comp = components(found.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    of_class = classes.select("h1", "h2", "rep", "mult").join(links, "rep", "left").join(comp.withColumnRenamed("node", "rep"), "rep", "left")
    of_class = of_class.select("h1", "h2", (F.coalesce("n", F.lit(0)) + F.col("mult") - 1).alias("n"), F.coalesce("component", "rep").alias("cid"))
    out = rows.where("ok").select("id", "h1", "h2").join(of_class, ["h1", "h2"]).select("id", F.col("n").alias("n_links"), F.col("cid").alias("component_id"))
    out = out.unionAll(rows.where("not ok").select("id", F.lit(0).cast("bigint"), "id"))
    return out.select(F.col("id").alias(id_col), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"))


ORACLE = """
WITH RECURSIVE e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings),
ok AS (SELECT vec_id, label, v, sqrt(list_dot_product(v, v)) AS n FROM e WHERE label IS NOT NULL AND v IS NOT NULL AND list_dot_product(v, v) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.label = b.label AND a.vec_id <> b.vec_id AND list_dot_product(a.v, b.v) / (a.n * b.n) >= 0.98),
r(a, b) AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a, min(b) AS m FROM r GROUP BY a),
k AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT e.vec_id, coalesce(k.n, 0)::BIGINT AS n_links, least(e.vec_id, coalesce(c.m, e.vec_id)) AS component_id, e.vec_id <= coalesce(c.m, e.vec_id) AS kept
FROM e LEFT JOIN k ON k.a = e.vec_id LEFT JOIN c ON c.a = e.vec_id"""
