"""View shaping (P1-P9) and batch planning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixframe.operators import encode as EN
from helixframe.operators.indexing import dense_index


def resolve_views(df: DataFrame, cols: list[str] | None = None, keys: list[str] | None = None) -> DataFrame:
    """P1 + P2: roles by column count (default: all columns but the keys); 1 column is a self pair; nulls become ' '."""
    keys = list(keys or [])
    cols = [c for c in df.columns if c not in keys] if cols is None else cols
    if len(cols) == 1:
        c0 = EN.null_fill(F.col(cols[0]))
        return df.select(*keys, c0.alias("sent0"), c0.alias("sent1"))
    if len(cols) in (2, 3):
        return df.select(*keys, *[EN.null_fill(F.col(c)).alias(f"sent{i}") for i, c in enumerate(cols)])
    raise ValueError(f"a corpus has 1, 2 or 3 text columns, got {len(cols)}")


def encode_views(df: DataFrame, cols: list[str], lookup, keys: list[str],
                 max_len: int = EN.MAX_SEQ_LEN) -> DataFrame:
    """P3 + T1-T3: every view encoded once; (keys, input_ids, attention_mask) as array<array<int>>."""
    v = resolve_views(df, cols, keys)
    sents = [c for c in v.columns if c.startswith("sent")]
    enc = F.array(*[EN.truncate(lookup(F.slice(EN.words(F.col(c)), 1, max_len - 2)), max_len)
                    for c in sents])
    return v.select(*keys, enc.alias("_t")).select(
        *keys, F.transform("_t", lambda t: EN.pad(t, max_len)).alias("input_ids"),
        F.transform("_t", lambda t: EN.mask_of(t, max_len)).alias("attention_mask"))


def flatten_views(df: DataFrame, keys: list[str], col: str = "input_ids") -> DataFrame:
    """T5: (bs, num_sent, len) -> one row per (item, view)."""
    return df.select(*keys, F.posexplode(col).alias("view", col))


def restore_views(flat: DataFrame, keys: list[str], col: str = "input_ids") -> DataFrame:
    """T5 inverse: ordered re-collection per item (bounded by num_sent <= 3)."""
    return (flat.groupBy(*keys)
            .agg(F.array_sort(F.collect_list(F.struct("view", col))).alias("_v"))
            .select(*keys, F.col(f"_v.{col}").alias(col)))


def alias_labels(df: DataFrame) -> DataFrame:
    """P5: `label` or `label_ids` -> `labels`."""
    for c in ("label", "label_ids"):
        if c in df.columns:
            return df.withColumnRenamed(c, "labels")
    return df


def _bin_of(keyed: DataFrame, key: str, frac: float, few: int) -> tuple[str, int, int]:
    """(prefix, rest, total): of the rows in key order the first int(frac * n) are those of smaller prefix and ``rest`` of those with this prefix.

    ``key`` holds 32 hex digits; each round counts the next ``DIGITS`` digits of the rows in the crossing bin, at most 16 ** DIGITS counts.
    """
    prefix, below, k, total = "", 0, 0, None
    for d in range(DIGITS, 32 + 1, DIGITS):
        rows = keyed if not prefix else keyed.where(F.substring(key, 1, d - DIGITS) == prefix)
        counts = sorted((r["p"], r["n"]) for r in rows.groupBy(F.substring(key, 1, d).alias("p")).agg(F.count(F.lit(1)).alias("n")).collect())
        if total is None:
            total = sum(n for _, n in counts)
            k = int(frac * total)
        if k <= 0 or k >= total:
            return "", k, total
        for p, n in counts:
            if below + n > k:
                break
            below += n
        prefix = p
        if n <= few:
            break
    return prefix, k - below, total


DIGITS = 4  # hex digits a round: 65,536 counts reach the driver at most


def seeded_head(df: DataFrame, id_col: str, seed: int, frac: float, few: int = 10_000) -> DataFrame:
    """Exact replayable sample - order by md5(seed:id), keep the first int(frac*n).

    The position is selected, not sorted for: histograms of the key's leading digits close in on the bin that holds the last kept row
    (each round one pass over the id alone, and the second pass sees 1 / 65,536 of the rows), and only that bin, ``few`` rows or rows of equal
    keys, gets positions.  The table itself is filtered where it stands.  Rows repeated under one id are cut in any order.
    """
    keyed = df.withColumn("_key", F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(id_col).cast("string"))))
    prefix, rest, total = _bin_of(keyed.select("_key"), "_key", frac, few)
    if not prefix:
        return df if rest > 0 else df.limit(0)
    at = F.substring("_key", 1, len(prefix))
    head = keyed.where(at < prefix).drop("_key")
    if not rest:
        return head
    edge = dense_index(keyed.where(at == prefix), ["_key", id_col], name="_pos").where(F.col("_pos") < rest)
    return head.unionByName(edge.drop("_key", "_pos"))


def epoch_plan(n: Column, batch_size: int, accum: int = 1, drop_last: bool = False, epochs: float = 1.0, max_steps: int = -1) -> list[Column]:
    """T13 rules from the number of samples: batches, steps_per_epoch, max_steps, epochs.

    Steps per epoch are the whole groups of ``accum`` batches, one at least; a positive ``max_steps`` sets the
    epochs (rounded up), else ``epochs`` sets the steps."""
    n_batches = (F.floor(n / F.lit(batch_size)) if drop_last else F.ceil(n / F.lit(batch_size))).cast("bigint")
    per = F.greatest((n_batches / accum).cast("bigint"), F.lit(1).cast("bigint"))
    if max_steps > 0:
        steps, ep = F.lit(max_steps).cast("bigint"), F.ceil(F.lit(max_steps) / per)
    else:
        steps, ep = F.ceil(per * F.lit(float(epochs))), F.lit(-int(-epochs // 1))
    return [n_batches.alias("batches"), per.alias("steps_per_epoch"), steps.cast("bigint").alias("max_steps"), ep.cast("bigint").alias("epochs")]


def batch_plan(df: DataFrame, order_cols: list[str], batch_size: int, accum: int = 1, drop_last: bool = False) -> DataFrame:
    """batch = idx div batch_size; per batch its size, full flag and optimizer step of the epoch.

    Batches after the last whole group of ``accum`` belong to no step (null), unless the epoch has one step only."""
    d = dense_index(df, order_cols)
    b = d.groupBy((F.col("idx") / batch_size).cast("bigint").alias("batch")).agg(
        F.count(F.lit(1)).alias("n"))
    if drop_last:
        b = b.where(F.col("n") == batch_size)
    per = epoch_plan(df.agg(F.count(F.lit(1))).scalar(), batch_size, accum, drop_last)[1]
    step = (F.col("batch") / accum).cast("bigint")
    return b.select("batch", "n", (F.col("n") == batch_size).alias("full_batch"), F.when(step < per, step).alias("step"))


def head_trim(df: DataFrame, idx_col: str, n: int) -> DataFrame:
    """The sampler pads by repeating samples at the tail; keep the first n."""
    return df.where(F.col(idx_col) < n)


def stack_partitions(parts: dict[str, DataFrame]) -> DataFrame:
    """Row-wise concatenation over named partitions."""
    out = None
    for name, d in parts.items():
        d = d.withColumn("partition", F.lit(name))
        out = d if out is None else out.unionByName(d)
    return out


def fuse_modalities(a: DataFrame, b: DataFrame, key: str = "vec_id") -> DataFrame:
    """Feature-wise concat per sample; a sample in one modality only, or with two labels, fails the job.

    The checks sit inside the output columns, so the optimiser cannot drop them."""
    la, lb = F.col("a.label"), F.col("b.label")
    ea, eb = F.col("a.embedding"), F.col("b.embedding")
    j = a.withColumn("_in", F.lit(True)).alias("a").join(b.withColumn("_in", F.lit(True)).alias("b"), key, "full_outer")
    both = F.col("a._in") & F.col("b._in")
    missing = F.raise_error(F.lit("modalities differ in their samples"))
    return j.select(
        F.when(both, F.col(key)).otherwise(missing).alias(key),
        F.when(both, F.concat(ea, eb)).otherwise(missing).alias("embedding"),
        F.when(both & la.eqNullSafe(lb), la).otherwise(F.raise_error(F.lit("modalities disagree on a label or a sample"))).alias("label"))
