"""Corpus encoding: tokens, vocabulary, ids, truncation, padding, masks.

The tokenizer files of the original model are not published, so tokenising
is re-aimed to a corpus job: whitespace words (or overlapping k-mers for DNA),
a frequency vocabulary of the top V tokens, and an id lookup.  The
vocabulary has at most V rows (a proven bound), so it is broadcast as a hash
table and the lookup runs in an Arrow-batched pandas UDF: no join and no
shuffle of the corpus.  (Spark map values are searched linearly, which
costs O(V) per token, so a map column is not used.)
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helixframe.functions.hashing import uniform
from helixframe.session import bounded_batches

# Special token ids (pad id 0 as in the model's generation config).
PAD_ID, UNK_ID, CLS_ID, SEP_ID, MASK_ID = 0, 1, 2, 3, 4
N_SPECIAL = 5
VOCAB_SIZE = 4096
MAX_SEQ_LEN = 128
WS = "[ \\t\\n\\r\\f]+"


def null_fill(c: Column) -> Column:
    """A null sequence becomes a single space."""
    return F.coalesce(c, F.lit(" "))


def words(text: Column) -> Column:
    """Whitespace tokens of a text (empty strings dropped)."""
    return F.filter(F.split(null_fill(text), WS), lambda t: t != F.lit(""))


def kmers(seq: Column, k: int = 6) -> Column:
    """Overlapping k-mers of a sequence (empty when shorter than k)."""
    n = F.length(seq)
    return F.when(n >= k, F.transform(F.sequence(F.lit(1), n - k + 1),
                                      lambda i: F.substring(seq, i, k))) \
        .otherwise(F.array().cast("array<string>"))


def vocabulary(tokens: DataFrame, col: str = "tokens", size: int = VOCAB_SIZE) -> DataFrame:
    """T1 vocabulary: (token, id, count) for the top ``size - 5`` tokens.

    Order: count descending, then token; ids start after the specials.  The
    counting is a partially aggregated shuffle; the top-V is a bounded
    take-ordered, so only V rows ever meet in one task.
    """
    counts = (tokens.select(F.explode(col).alias("token"))
              .groupBy("token").agg(F.count(F.lit(1)).alias("count")))
    top = counts.orderBy(F.desc("count"), F.asc("token")).limit(size - N_SPECIAL)
    w = Window.orderBy(F.desc("count"), F.asc("token"))  # over <= V rows
    return top.select("token", (F.row_number().over(w) + N_SPECIAL - 1).cast("int").alias("id"),
                      "count")


class Lookup:
    """Token array -> id array (unknown -> UNK_ID) with a broadcast vocabulary.

    The vocabulary is as large as its maker asked for (``vocabulary(size=...)``); all tokens
    of an Arrow batch are looked up by one vectorised ``index_in``.
    """

    def __init__(self, vocab: DataFrame):
        bounded_batches(vocab.sparkSession)
        t = vocab.select("token", "id").toArrow()
        bc = vocab.sparkSession.sparkContext.broadcast((t.column(0).combine_chunks(), t.column(1).combine_chunks()))

        @F.arrow_udf("array<int>")
        def _ids(tokens: pa.Array) -> pa.Array:
            names, ids = bc.value
            flat = pc.index_in(tokens.flatten().cast(names.type), value_set=names)
            got = pc.fill_null(ids.take(flat), UNK_ID).cast(pa.int32())
            sizes = pc.fill_null(pc.list_value_length(tokens), 0).to_numpy(zero_copy_only=False)
            ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
            out = pa.ListArray.from_arrays(pa.array(ends), got)
            return out if not tokens.null_count else pc.if_else(tokens.is_valid(), out, pa.scalar(None, out.type))

        self._fn = _ids

    def __call__(self, tokens: Column) -> Column:
        return self._fn(tokens)


def truncate(ids: Column, max_len: int = MAX_SEQ_LEN) -> Column:
    """[CLS] + first max_len-2 ids + [SEP]."""
    return F.concat(F.array(F.lit(CLS_ID)), F.slice(ids, 1, max_len - 2), F.array(F.lit(SEP_ID)))


def pad(ids: Column, length: Column | int = MAX_SEQ_LEN) -> Column:
    """Right-pad with PAD_ID up to ``length``."""
    L = F.lit(length) if isinstance(length, int) else length
    return F.concat(ids, F.array_repeat(F.lit(PAD_ID), F.greatest(L - F.size(ids), F.lit(0))))


def mask_of(ids: Column, length: Column | int = MAX_SEQ_LEN) -> Column:
    """Attention mask: 1 for real tokens, 0 for padding."""
    L = F.lit(length) if isinstance(length, int) else length
    return F.transform(F.sequence(F.lit(1), L),
                       lambda i: F.when(i <= F.size(ids), F.lit(1)).otherwise(F.lit(0)))


def encode(df: DataFrame, text_col: str, lookup: Lookup, max_len: int = MAX_SEQ_LEN,
           padded: bool = True, out: str = "input_ids") -> DataFrame:
    """Tokens, truncation before the lookup (only kept tokens are looked up), padding, mask."""
    ids = F.concat(F.array(F.lit(CLS_ID)), lookup(F.slice(words(F.col(text_col)), 1, max_len - 2)),
                   F.array(F.lit(SEP_ID)))
    if not padded:
        return df.withColumn(out, ids)
    return df.withColumn("_ids", ids).withColumn(out, pad(F.col("_ids"), max_len)) \
        .withColumn("attention_mask", mask_of(F.col("_ids"), max_len)).drop("_ids")


def batch_pad_length(lengths: Column, batch: str, max_len: int | None = MAX_SEQ_LEN,
                     multiple: int | None = None) -> Column:
    """T4: pad length of a batch = longest in batch, capped, rounded up to a multiple."""
    longest = F.max(lengths).over(Window.partitionBy(batch))
    if max_len is not None:
        longest = F.least(longest, F.lit(max_len))
    if multiple:
        longest = (F.ceil(longest / F.lit(multiple)) * F.lit(multiple)).cast("int")
    return longest.cast("int")


def mlm_corrupt(token: Column, seed: int, keys: list[Column], pos: Column, prob: float = 0.15,
                vocab_size: int = VOCAB_SIZE) -> tuple[Column, Column]:
    """T6 on exploded (key..., pos, token) rows: returns (corrupted id, label; -100 = ignore).

    A non-special position is selected if u_sel < prob; of the selected, 80 %
    become MASK_ID (u_mask < 0.8), half of the rest a uniform random id in
    [0, vocab) (u_rand < 0.5, id = floor(u_rid * vocab)), the rest stay.
    Padding and [CLS]/[SEP] are special.  Draws are md5 uniforms of
    (seed, purpose, keys..., pos), so they replay on any partitioning.
    """
    def u(purpose):
        return uniform(F.lit(seed), F.lit(purpose), *keys, pos)

    special = token.isin(PAD_ID, CLS_ID, SEP_ID)
    sel = (~special) & (u("sel") < prob)
    new = F.when(sel, F.when(u("mask") < 0.8, F.lit(MASK_ID))
                 .when(u("rand") < 0.5, F.floor(u("rid") * vocab_size).cast("int"))
                 .otherwise(token)).otherwise(token)
    label = F.when(sel, token).otherwise(F.lit(-100))
    return new, label
