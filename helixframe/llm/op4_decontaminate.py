"""Benchmark decontamination by spaced seeds.

All DataFrame functions.  A text is lower-cased and read as words of letters and digits, each
hashed to 64 bits.  At every word position each fixed mask hashes the words it selects and ignores the
others, so a substituted word spoils only the masks that select it.  In a window of 4 to ``WINDOW`` words at least one mask at one
place escapes every allowed set of substitutions (tested by enumeration), so no window that would count is missed.  Seeds of documents meet seeds of the
benchmark in an equi-join; on the diagonal of each hit windows of ``WINDOW`` words are compared word by
word, and one counts when ``SHARE`` of its words agree (it is shorter only where the item or the document is).

The seeds of the benchmark are broadcast when they number ``BROADCAST_SEEDS`` at most (counted first), else the join is
shuffled.  Seed rows hold no text.  Documents with a hit are told to the tasks by a bitmap of bounded size, so that only their texts
are shuffled, to their diagonals; of each diagonal only the words that lie beside the item meet it.

Defined cases: null or empty texts (of either table) and items without words match nothing; an item shorter
than the masks must be met in all its words; a document of one to three words is met only by items it holds whole; repeated rows count under their id once; ids
are not negative and null ids are kept; empty tables give no rows; other columns are ignored; texts are read whole.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixframe.llm.common import staged, text_of

# 1: the word is hashed, 0: it may be any word.
MASKS = ["1111", "11011", "10111", "11101"]
SPAN = 4
WINDOW, SHARE = 16, 0.8
BROADCAST_SEEDS = 1_000_000
BITMAP_BITS = 1 << 26  # 8 MB of bits


def word_hashes(text: Column) -> Column:
    words = F.split(F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " ")), " ")
    return F.transform(F.filter(words, lambda w: w != ""), lambda w: F.xxhash64(w))


def _seed(m: int, mask: str) -> Column:
    at = [F.expr(f"h[i + {k}]") for k, c in enumerate(mask) if c == "1"]
    return F.when(F.col("i") + len(mask) <= F.col("n"), F.xxhash64(F.lit(m), *at))


def seeds(rows: DataFrame, masks: list[str]) -> DataFrame:
    """The rows (n words, hashes h) once for each position i and mask m that fits, with the seed; h itself stays behind."""
    least, keep = min(map(len, masks)), [c for c in rows.columns if c != "h"]
    at = rows.where(F.col("n") >= least).select("*", F.explode(F.sequence(F.lit(0), F.col("n") - least)).alias("i"))
    return at.select(*keep, "i", F.posexplode(F.array(*[_seed(m, x) for m, x in enumerate(masks)])).alias("m", "seed")).where("seed is not null")


def row_key(id_col: str, text_col: str) -> list[Column]:
    return [F.coalesce(F.col(id_col).cast("bigint"), F.lit(-1)).alias("_k0"), F.xxhash64(text_of(text_col)).alias("_k1")]


def hit_bitmap(found: DataFrame) -> DataFrame:
    """(word, bits): one bit in ``BITMAP_BITS`` for each key of ``found``; at most BITMAP_BITS / 64 rows however many keys there are."""
    at = found.select(_bit().alias("bit"))
    return at.groupBy(F.shiftright("bit", 6).alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(bit & 63 as int)))").alias("bits"))


def _bit() -> Column:
    return F.pmod(F.xxhash64(F.lit("bitmap"), "_k0", "_k1"), F.lit(BITMAP_BITS))


# Start of the windows of a diagonal d (position in the document minus position in the item), counted in the item, where enough words agree.
# a and e: first and end position in the item that lie inside the document; same: word by word, whether the two agree from a on.
GOOD = f"filter(sequence(a, e - len), s -> size(filter(slice(same, s - a + 1, len), z -> z)) >= ceil({SHARE} * len - 1e-9))"


def hits(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text",
         masks: list[str] = MASKS) -> DataFrame:
    """(_k0, _k1, item_id, d, len, good): verified windows of each document and item, by diagonal."""
    items = bench.select(F.col(item_col).alias("item_id"), word_hashes(text_of(item_text)).alias("h")).withColumn("n", F.size("h")).distinct()
    items = staged(items.where("n > 0").withColumn("item", F.monotonically_increasing_id()))
    lengths = sorted(r["n"] for r in items.where(f"n < {SPAN}").select("n").distinct().collect())  # a few small numbers
    every = [*masks, *("1" * k for k in lengths)]
    size = F.element_at(F.array(*[F.lit(len(x)) for x in every]), F.col("m") + 1)
    # masks apply to items that have room for them; a shorter item has one seed, of all its words
    own = seeds(items, every).where(F.when(F.col("n") >= SPAN, F.col("m") < len(masks)).otherwise(size == F.col("n")))
    own = staged(own.select("item", F.col("i").alias("j"), "seed"))
    small = own.count() <= BROADCAST_SEEDS  # an item of n words has n seeds or more, so its hashes are bounded with them
    at_hand = F.broadcast if small else lambda x: x
    rows = docs.select(*row_key(id_col, text_col), word_hashes(text_of(text_col)).alias("h")).withColumn("n", F.size("h"))
    met = seeds(rows, every).select("_k0", "_k1", "i", "seed").join(at_hand(own), "seed")
    met = met.select("_k0", "_k1", "item", (F.col("i") - F.col("j")).alias("d")).distinct()
    met = met.join(at_hand(items.select("item", F.col("n").alias("ilen"))), "item")
    found = staged(met.groupBy("_k0", "_k1").agg(F.collect_list(F.struct("item", "ilen", "d")).alias("x")))
    # texts of documents without a hit stay where they are: a bitmap of bounded size goes to them
    text = docs.select(*row_key(id_col, text_col), text_of(text_col).alias("_t")).withColumn("_bit", _bit())
    text = text.join(F.broadcast(hit_bitmap(found)), F.shiftright("_bit", 6) == F.col("word")).where("shiftright(bits, cast(_bit & 63 as int)) & 1L = 1L")
    text = text.select("_k0", "_k1", "_t").join(found.hint("merge"), ["_k0", "_k1"]).dropDuplicates(["_k0", "_k1"])
    one = text.select("_k0", "_k1", "x", word_hashes(F.col("_t")).alias("h")).select("_k0", "_k1", "h", F.size("h").alias("n"), F.explode("x").alias("y"))
    one = one.select("_k0", "_k1", "h", "n", "y.*").selectExpr("*", f"least({WINDOW}, n, ilen) AS len", "greatest(0, -d) AS a", "least(ilen, n - d) AS e").where("e - a >= len")
    # of the document only the words on the diagonal go on to meet those of the item
    part = one.select("_k0", "_k1", "item", "d", "len", "a", "e", F.expr("slice(h, a + d + 1, e - a)").alias("dh"))
    both = part.join(at_hand(items.select("item", "item_id", F.col("h").alias("ih"))), "item")
    same = F.zip_with("dh", F.slice("ih", F.col("a") + 1, F.col("e") - F.col("a")), lambda x, y: x == y)
    checked = both.select("_k0", "_k1", "item_id", "d", "len", "a", "e", same.alias("same")).select("_k0", "_k1", "item_id", "d", "len", F.expr(GOOD).alias("good"))
    return checked.where(F.size("good") > 0)


def contaminated(docs: DataFrame, bench: DataFrame) -> DataFrame:
    """(doc_id, item_id, n_windows, first_word, last_word) for every document that holds text of an item."""
    found = hits(docs, bench)
    return found.groupBy(F.when(F.col("_k0") >= 0, F.col("_k0")).alias("doc_id"), "item_id").agg(
        F.sum(F.size("good")).alias("n_windows"), F.min(F.array_min("good") + F.col("d")).cast("bigint").alias("first_word"),
        F.max(F.array_max("good") + F.col("d") + F.col("len") - 1).cast("bigint").alias("last_word"))


def clean(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` without text of an item."""
    found = staged(hits(docs, bench, id_col, text_col).select("_k0", "_k1").distinct())
    return docs.select("*", *row_key(id_col, text_col)).join(found, ["_k0", "_k1"], "left_anti").select(*docs.columns)


ORACLE = f"""
WITH t AS (SELECT DISTINCT doc_id, coalesce(text, '') AS text FROM documents),
d AS (SELECT row_number() OVER () AS r, doc_id, list_filter(string_split(regexp_replace(lower(text), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'), ' '), lambda w: w <> '') AS w FROM t),
b AS (SELECT row_number() OVER () AS q, * FROM (SELECT DISTINCT item_id, list_filter(string_split(regexp_replace(lower(coalesce(text, '')), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'), ' '), lambda w: w <> '') AS iw FROM benchmark)),
-- a window that counts holds two neighbouring words that agree, or is one word long
dg AS (SELECT r, unnest(range(len(w))) AS i, unnest(list_transform(range(1, len(w) + 1), lambda k: w[k] || ' ' || coalesce(w[k + 1], ''))) AS g FROM d WHERE len(w) > 0),
bg AS (SELECT q, unnest(range(len(iw) - 1)) AS j, unnest(list_transform(range(1, len(iw)), lambda k: iw[k] || ' ' || iw[k + 1])) AS g FROM b WHERE len(iw) > 1),
c AS (SELECT DISTINCT r, q, i - j AS o FROM dg JOIN bg ON dg.g = bg.g
      UNION SELECT r, q, i FROM (SELECT r, unnest(range(len(w))) AS i, unnest(w) AS g FROM d) x JOIN b ON len(iw) = 1 AND iw[1] = g),
p AS (SELECT doc_id, item_id, w, iw, o, least({WINDOW}, len(w), len(iw)) AS n, greatest(0, -o) AS a, least(len(iw), len(w) - o) AS e
      FROM c JOIN d ON d.r = c.r JOIN b ON b.q = c.q WHERE len(w) >= {SPAN} OR len(iw) <= len(w)),
g AS (SELECT doc_id, item_id, o, n, list_filter(range(a, e - n + 1), lambda s: len(list_filter(range(n), lambda k: w[s + o + k + 1] = iw[s + k + 1])) >= ceil({SHARE} * n - 1e-9)) AS good FROM p)
SELECT doc_id, item_id, sum(len(good))::BIGINT AS n_windows, min(good[1] + o)::BIGINT AS first_word, max(good[-1] + o + n - 1)::BIGINT AS last_word
FROM g WHERE len(good) > 0 GROUP BY doc_id, item_id
"""
