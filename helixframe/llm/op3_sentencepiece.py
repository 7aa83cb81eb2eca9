"""SentencePiece encoding as a relational lattice, and decoding.

A text becomes ``▁`` + text with ``▁`` for spaces, and is cut into units (runs of letters or of other signs with the ``▁`` before them)
that no piece can reach across, as the piece table itself is made to confirm.  The distinct units of a batch are exploded into their substrings of bounded length, an equi-join with the piece
table (the size of a vocabulary, so it is broadcast) keeps the substrings that are pieces, the surviving edges
are grouped by unit, and a Spark higher-order ``aggregate`` folds each unit's lattice into its segmentation.

The public model is of the BPE kind: its scores are merge ranks, not log-probabilities, and the best-scoring path is
not its encoding.  The fold therefore runs the model's merges over the lattice: the state is the set of
boundaries as bits, and a merge removes the boundary inside the best edge (highest score, then leftmost) whose two halves are
symbols now.  The result equals the library's ids.

The most frequent units of a sample, ``KNOWN`` at most, are encoded first, once, and broadcast (their number bounds them); the batches encode the rest.
No text is shuffled: a batch's unit rows come before its document rows, narrow steps keep that order, and
the last step looks the units of each document up in the batch's own table (it fails rather than guess if a unit is missing).  Memory is bounded
by the batch: it is closed after the document that brings it to ``BATCH_WORDS`` distinct words or ``BATCH_CHARS`` characters; units are held over batches up to ``HELD_UNITS``.

Defined cases: null and empty texts have no ids; ``▁`` in a text reads as a space, as in the library; characters outside the table become byte
pieces; a unit of more than ``BITS`` symbols is merged in the last step by the same rule; repeated rows are encoded alike;
null ids are kept; an empty table gives no rows; other columns are ignored; texts are encoded whole.
"""
from __future__ import annotations

import hashlib
import re
from array import array
from collections import Counter
from itertools import accumulate, chain, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from helixframe.llm.common import pieces, staged, text_of, tidy

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
BATCH_WORDS, BATCH_CHARS, BITS = 200_000, 1 << 22, 60
KNOWN, SAMPLE, HELD_UNITS, EDGE_ROWS = 300_000, 4, 300_000, 65_536

# Rows of the stream: k >= 0 is a unit (word), MAP the units of the batch's words, DOC a document; doc: its payload.
_ROWS, MAP, DOC = "k int, word string, doc binary", -2, -1
_EDGES = "k int, word string, doc binary, n int, edges array<struct<i:bigint,e:bigint>>"
# An edge as one number: unit, first symbol, symbols, rank (NONE for the row that carries the unit itself).
NONE = (1 << 16) - 1


class Vocabulary:
    """Pieces with id and rank (0 is merged first; equal scores share a rank), and the ids of the 256 bytes."""

    def __init__(self, path: str = MODEL):
        import sentencepiece
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.bytes = {int(sp.id_to_piece(i)[3:5], 16): i for i in range(n) if sp.is_byte(i)}
        usable = [i for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        order = {s: r for r, s in enumerate(sorted({sp.get_score(i) for i in usable}, reverse=True))}
        self.ids = {sp.id_to_piece(i): i for i in usable}
        self.rank = {sp.id_to_piece(i): order[sp.get_score(i)] for i in usable}
        self.longest = max(map(len, self.ids))
        # units: letters, other signs, or one digit or space, after any ▁; characters of pieces that such a cut would part count as signs
        split = lambda extra: f"▁*[^\\W\\d_▁{extra}]+|▁*(?:[^\\w\\s▁]|[_{extra}])+|▁*[\\s\\S]|▁+"
        parted = lambda unit: [p for p in self.ids if len(re.findall(unit, p)) > 1]
        self.unit = split(re.escape("".join(sorted({c for p in parted(split("")) for c in p if re.match(r"[\w\s]", c)}))))
        if parted(self.unit) or len(self.bytes) != 256:
            raise ValueError("pieces that reach over a unit boundary, or no byte pieces")

    def table(self, spark) -> DataFrame:
        return spark.createDataFrame([(p, r) for p, r in self.rank.items() if len(p) > 1], "piece string, rank int")

    def decoder(self):
        """ids -> text"""
        piece = [b""] * (max(*self.ids.values(), *self.bytes.values()) + 1)
        for p, i in self.ids.items():
            piece[i] = p.replace("▁", " ").encode()
        for b, i in self.bytes.items():
            piece[i] = bytes([b])
        return lambda ids: b"".join([piece[i] for i in ids]).decode("utf-8", "replace")[1:]

    def ids_of(self, symbols: list[str]) -> list[int]:
        out = []
        for s in symbols:
            i = self.ids.get(s)
            if i is not None:
                out.append(i)
            else:
                out += [self.bytes[b] for b in s.encode()]
        return out


def merged(word: str, rank: dict[str, int]) -> list[str]:
    """The merges of one long unit: best adjacent pair first, leftmost on ties (a heap over linked symbols)."""
    import heapq
    sym, left, right = list(word), list(range(-1, len(word) - 1)), [*range(1, len(word)), -1]
    heap = []

    def offer(i):
        j = right[i]
        if j >= 0 and (r := rank.get(sym[i] + sym[j])) is not None:
            heapq.heappush(heap, (r, i, len(sym[i]), len(sym[j])))

    for i in range(len(word)):
        offer(i)
    while heap:
        _, i, a, b = heapq.heappop(heap)
        j = right[i] if sym[i] else -1
        if j < 0 or len(sym[i]) != a or len(sym[j]) != b:
            continue
        sym[i], sym[j], right[i] = sym[i] + sym[j], "", right[j]
        if right[j] >= 0:
            left[right[j]] = i
        offer(i)
        if left[i] >= 0:
            offer(left[i])
    return [s for s in sym if s]


def word_list(text: str) -> list[str]:
    """Words after a space each; a run of spaces stays with the word behind it, as further ``▁``."""
    words = text.replace("▁", " ").split(" ")
    if "" in words:
        words = [w[1:] for w in re.findall("▁+[^▁]*", "▁" + "▁".join(words))]
    return words


def frequent_units(docs: DataFrame, text_col: str, unit: str) -> list[str]:
    """The most frequent units of the words in a sample of rows (one in ``SAMPLE`` by a hash of the text): all above the least count that leaves ``KNOWN`` at most."""

    def run(batches):
        n, find = Counter(), re.compile(unit).findall
        for batch in batches:
            for text in batch.column(0):
                for w in word_list(text.as_py()):
                    n[w] += 1
        out = Counter()
        for w, c in n.items():
            for u in find("▁" + w):
                out[u] += c
        yield pa.record_batch([pa.array(list(out), pa.string()), pa.array(list(out.values()), pa.int64())], names=["u", "c"])
        n = out = None
        tidy()

    text = docs.select(text_of(text_col).alias("t")).where(f"t <> '' and pmod(xxhash64(t), {SAMPLE}) = 0").mapInArrow(run, "u string, c bigint")
    counted = staged(text.groupBy("u").agg(F.least(F.sum("c"), F.lit(10_000)).alias("c")).where("c > 1"))  # read twice
    left, least = KNOWN, 10_001
    for r in counted.groupBy("c").count().orderBy(F.desc("c")).collect():  # 10,000 rows at most
        left -= r["count"]
        if left < 0:
            break
        least = r["c"]
    return sorted(counted.where(F.col("c") >= least).select("u").toArrow().column(0).to_pylist())


class Numbers(dict):
    """Consecutive numbers for keys as they are first seen; keys of ``known`` have theirs already."""

    def __init__(self, known=()):
        self.known = known
        self.first = len(known)

    def __missing__(self, key):
        if key in self.known:
            return self.known[key]
        self[key] = n = self.first + len(self)
        return n


def known_units(docs: DataFrame, text_col: str, v: "Vocabulary", table: DataFrame) -> tuple[list[str], array, array]:
    """The frequent units, encoded once for all tasks through the same lattice and fold as all others: the units, where the ids of
    each begin, and all ids end to end.  Which units are known changes no result."""
    units = frequent_units(docs, text_col, v.unit)
    if not units:
        return [], array("q", [0]), array("i")
    spark = docs.sparkSession
    rows = spark.createDataFrame(pa.table({"k": pa.array(range(len(units)), pa.int32()), "word": units})).select("k", "word", F.lit(None).cast("binary").alias("doc"))
    found = grouped(lattice(rows, table, v.longest)).select("k", "n", F.expr(FOLD).alias("bounds")).toArrow()  # KNOWN rows of three numbers at most
    ids: list = [None] * len(units)
    for k, n, bounds in zip(*(c.to_pylist() for c in found.columns)):
        ids[k] = v.ids_of(symbols(units[k], n, bounds, v.rank))
    return units, array("q", [0, *accumulate(map(len, ids))]), array("i", [x for run in ids for x in run])


def symbols(word: str, n: int, bounds: int | None, rank: dict[str, int]) -> list[str]:
    """The pieces of a unit between its last boundaries; a unit too long for the fold is merged here."""
    if bounds is None:
        return merged(word, rank)
    if bounds == (1 << n) + 1:
        return [word]
    cuts = [c for c in range(n + 1) if bounds >> c & 1]
    return [word[a:b] for a, b in zip(cuts[:-1], cuts[1:])]


def unit_rows(docs: DataFrame, id_col: str, text_col: str, unit: str, known) -> DataFrame:
    """Per batch: a row for each distinct unit that neither is known nor stood in an earlier batch of the task, one that tells the units of each distinct word, one for each document (id, md5, words)."""

    def run(batches):
        seen = {u: i for i, u in enumerate(known.value.split(" "))} if known.value else {}
        units, told, words, out, chars = Numbers(seen), 0, Numbers(), [], 0
        find = re.compile(unit).findall

        def rows(k, word, doc):
            return pa.record_batch([pa.array(k, pa.int32()), pa.array(word, pa.string()), pa.array(doc, pa.binary())], names=["k", "word", "doc"])

        def flush():
            ends, flat = array("q", [0]), array("i")
            for w in words:
                flat.extend(map(units.__getitem__, find("▁" + w)))
                ends.append(len(flat))
            listed = islice(units, told, None)  # units of earlier batches are known to the last step already
            for at in range(told, len(units), 20_000):
                part = list(islice(listed, 20_000))
                yield rows(range(units.first + at, units.first + at + len(part)), part, [None] * len(part))
            yield rows([MAP], [None], [len(ends).to_bytes(8, "little") + ends.tobytes() + flat.tobytes()])
            for at in range(0, len(out), 512):
                part = out[at:at + 512]
                yield rows([DOC] * len(part), [None] * len(part), part)

        for batch in batches:
            for part in pieces(batch):
                for i, text in zip(part.column(0).to_pylist(), part.column(1)):
                    text = text.as_py()
                    found = word_list(text) if text else []
                    at = np.fromiter(map(words.__getitem__, found), np.int32, len(found))
                    mark = hashlib.md5(text.replace("▁", " ").encode()).digest()
                    out.append((b"\0" * 9 if i is None else b"\1" + i.to_bytes(8, "little", signed=True)) + mark + at.tobytes())
                    chars += len(text)
                    if len(words) >= BATCH_WORDS or chars >= BATCH_CHARS:
                        yield from flush()
                        words, out, chars, told = Numbers(), [], 0, len(units)
                        if told >= HELD_UNITS:
                            units, told = Numbers(seen), 0
        yield from flush()
        units = words = out = seen = batch = part = text = found = at = None
        tidy()

    return docs.select(F.col(id_col).cast("bigint"), text_of(text_col)).mapInArrow(run, _ROWS)


def lattice(rows: DataFrame, table: DataFrame, longest: int) -> DataFrame:
    """(e, word, doc): the edges of each unit of at most ``BITS`` symbols; the unit's own row comes first, other rows pass through."""
    n = F.length("word")
    use = (F.col("k") >= 0) & (n <= BITS)
    sub = rows.select("k", "word", "doc", n.alias("n"), F.explode_outer(F.when(use, F.sequence(F.lit(0), F.greatest(n - 2, F.lit(0))))).alias("s"))
    lens = F.when(F.col("s") == 0, F.sequence(F.lit(1), F.least(F.lit(longest), "n"))).when(F.col("s") > 0, F.sequence(F.lit(2), F.least(F.lit(longest), F.col("n") - F.col("s"))))
    sub = sub.select("k", "word", "doc", "s", F.explode_outer(lens).alias("len")).withColumn("piece", F.col("word").substr(F.col("s") + 1, F.col("len")))
    keyed = table.select(F.xxhash64("piece").alias("hash"), F.col("piece").alias("same"), "rank")
    sub = sub.withColumn("hash", F.xxhash64("piece")).join(F.broadcast(keyed), "hash", "left")  # a long key; the strings decide
    sub = sub.withColumn("rank", F.when(F.col("piece") == F.col("same"), F.col("rank")))
    own = F.col("s").isNull() | ((F.col("s") == 0) & (F.col("len") == 1))
    sub = sub.where(F.col("rank").isNotNull() | own)
    big = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("bigint")
    edge = F.shiftleft(big("k"), 27) + F.shiftleft(big("s"), 21) + F.shiftleft(big("len"), 16) + F.coalesce(F.col("rank"), F.lit(NONE))
    return sub.select(F.when(F.col("k") < 0, F.col("k").cast("bigint")).otherwise(edge).alias("e"), F.when(own, F.col("word")).alias("word"), "doc")


def _pairs(inside: np.ndarray, ends: np.ndarray) -> pa.StructArray:
    return pa.StructArray.from_arrays([pa.array(inside), pa.array(ends)], names=["i", "e"])


def grouped(edges: DataFrame) -> DataFrame:
    """One row a unit again, its edges in merge order as two bit masks each: the boundaries inside (i) and the two at the ends (e).

    An edge that is a half of a longer one of no later rank has the bit ``MARK`` in ``e``: once it merges, merges may no longer come in the order of their ranks."""

    def run(batches):
        held, rows = [], 0  # edges gathered so far; the last unit may go on in the next batch

        def other(t):
            m = t.num_rows
            none = pa.ListArray.from_arrays(pa.array([0] * (m + 1), pa.int32()), _pairs(np.empty(0, np.int64), np.empty(0, np.int64)))
            return pa.record_batch([t.column(0).cast(pa.int32()), t.column(1), t.column(2), pa.array([0] * m, pa.int32()), none], names=["k", "word", "doc", "n", "edges"])

        def emit(t):
            e = t.column(0).to_numpy()
            k, s, ln, rank = e >> 27, (e >> 21) & 63, (e >> 16) & 31, e & NONE
            first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
            unit = np.repeat(np.arange(len(first)), np.diff(np.concatenate([first, [len(k)]])))
            use = rank != NONE
            u, a, b, r = unit[use], s[use], (s + ln)[use], rank[use]
            half = np.zeros(len(u), bool)
            for o, x in ((np.arange(len(u))[::-1], a), (np.argsort((u << 12) | (b << 6) | a), b)):  # equal begins (ends) together, longest first
                same = (u[o] << 6) | x[o]
                lower = r[o] - (np.cumsum(np.concatenate([[0], same[1:] != same[:-1]])[:len(o)]) << 17)  # so that a later group starts anew below
                half[o[1:]] |= (np.minimum.accumulate(lower)[:-1] <= lower[1:]) & (same[1:] == same[:-1])
            o = np.argsort((u << 27) | (r << 11) | (a << 5) | (b - a))
            u, a, b = u[o], a[o].astype(np.uint64), b[o].astype(np.uint64)
            one = np.uint64(1)
            ends = (one << a) | (one << b) | (half[o].astype(np.uint64) << np.uint64(62))
            inside = ((one << b) - one) ^ ((one << (a + one)) - one)
            offsets = pa.array(np.searchsorted(u, np.arange(len(first) + 1)).astype(np.int32))
            word = t.column(1).take(pa.array(first))
            return pa.record_batch([pa.array(k[first], pa.int32()), word, pa.nulls(len(first), pa.binary()), pc.utf8_length(word),
                                    pa.ListArray.from_arrays(offsets, _pairs(inside.astype(np.int64), ends.astype(np.int64)))], names=["k", "word", "doc", "n", "edges"])

        def whole():
            return pa.Table.from_batches(held).combine_chunks().to_batches()[0]

        for batch in batches:
            e = batch.column(0).to_numpy()
            turns = [0, *(np.flatnonzero((e[1:] < 0) != (e[:-1] < 0)) + 1), len(e)]
            for a, b in zip(turns[:-1], turns[1:]):
                if a == b:
                    continue
                part = batch.slice(a, b - a)
                if e[a] < 0:
                    if held:
                        yield emit(whole())
                        held, rows = [], 0
                    yield other(part)
                    continue
                held.append(part)
                rows += b - a
                if rows >= EDGE_ROWS:
                    part = whole()
                    k = part.column(0).to_numpy() >> 27
                    cut = int(np.searchsorted(k, k[-1]))
                    if cut:
                        yield emit(part.slice(0, cut))
                    held, rows = [part.slice(cut)], len(k) - cut
        if held:
            yield emit(whole())
        held = batch = part = e = k = None
        tidy()

    return edges.mapInArrow(run, _EDGES)


# The fold over the lattice: boundaries 0..n as bits.  An edge merges when its ends are boundaries around exactly one more.  Edges come in merge
# order, so one pass settles a unit, unless an edge with MARK merged: that takes the bit MARK from the state, the pass gives null, and
# the unit is folded by steps that each take the first edge that merges.
MARK = 1 << 62
_START = f"shiftleft(1L, n + 1) - 1L + {MARK}L"
FOLD = f"""
CASE WHEN k >= 0 AND n <= {BITS} THEN coalesce(
  aggregate(edges, {_START}, (acc, x) -> CASE WHEN (acc & x.e) = x.e AND bit_count(acc & x.i) = 1 THEN acc ^ (acc & (x.i | (x.e & {MARK}L))) ELSE acc END,
    acc -> CASE WHEN acc >= {MARK}L THEN acc - {MARK}L END),
  aggregate(sequence(1, greatest(least(n - 1, size(edges)), 1)), {_START}, (acc, step) ->
    acc ^ (acc & coalesce(try_element_at(filter(edges, x -> (acc & x.e) = x.e AND bit_count(acc & x.i) = 1), 1).i, 0L)), acc -> acc - {MARK}L)) END
"""


def longer_batches(spark) -> None:
    """Arrow batches of many rows but few bytes: an edge has some ten bytes, a text can have megabytes."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "16384")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(1 << 20))


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str = MODEL) -> DataFrame:
    """(id, ids array<int>, round_trip): the ids of each text, and whether decoding them gives the text back."""
    v = Vocabulary(model)
    longer_batches(docs.sparkSession)
    table = v.table(docs.sparkSession)
    units, *runs = known_units(docs, text_col, v, table)
    # one string, as no unit has a space: a worker keeps a broadcast for as long as it idles, and a list of strings is many times as large
    known, known_runs = (docs.sparkSession.sparkContext.broadcast(x) for x in (" ".join(units), runs))
    rows = lattice(unit_rows(docs, id_col, text_col, v.unit, known), table, v.longest)
    folded = grouped(rows).select("k", "word", "doc", "n", F.expr(FOLD).alias("bounds"))

    def run(batches):
        text_of_ids = v.decoder()
        start = known_runs.value
        begin, flat = start[0][:], start[1][:]  # ids of all units of the batch end to end, and where each begins
        words = None
        for batch in (part for whole in batches for part in pieces(whole, 2048)):
            ids, out, same = [], [], []
            k = batch.column(0).to_numpy()
            turns = [0, *(np.flatnonzero((k[1:] < 0) != (k[:-1] < 0)) + 1), len(k)]
            for a, b in zip(turns[:-1], turns[1:]):
                if a == b:
                    continue
                if k[a] >= 0:
                    if k[a] == len(start[0]) - 1:
                        begin, flat = start[0][:], start[1][:]
                    if k[a] != len(begin) - 1 or k[b - 1] - k[a] != b - 1 - a:
                        raise RuntimeError("units out of order")
                    many, found = unit_ids(batch.slice(a, b - a), v)
                    begin.extend((len(flat) + np.cumsum(many)).tolist())
                    flat.frombytes(found.astype(np.int32).tobytes())
                    continue
                for row, doc in zip(k[a:b].tolist(), batch.column(2).slice(a, b - a).to_pylist()):
                    if row == MAP:
                        m = int.from_bytes(doc[:8], "little")
                        words = joined_runs(np.frombuffer(doc, np.int64, m, 8), np.frombuffer(doc, np.int32, -1, 8 + 8 * m), np.array(begin), np.array(flat, np.int32))
                    else:
                        found = take_runs(*words, np.frombuffer(doc, np.int32, -1, 25))
                        ids.append(int.from_bytes(doc[1:9], "little", signed=True) if doc[0] else None)
                        out.append(found)
                        same.append(hashlib.md5(text_of_ids(found.tolist()).encode()).digest() == doc[9:25])
            yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(out, pa.list_(pa.int32())), pa.array(same, pa.bool_())], names=["id", "ids", "round_trip"])
        begin = flat = words = batch = ids = out = same = found = None
        tidy()

    return folded.mapInArrow(run, "id bigint, ids array<int>, round_trip boolean").withColumnRenamed("id", id_col)


def unit_ids(rows: pa.RecordBatch, v: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """How many ids each unit of some folded rows has, and all ids end to end."""
    words, n, bounds = rows.column(1).to_pylist(), rows.column(3), rows.column(4)
    if bounds.null_count:
        runs = [v.ids_of(symbols(*unit, v.rank)) for unit in zip(words, n.to_pylist(), bounds.to_pylist())]
        return np.array(list(map(len, runs))), np.array(list(chain.from_iterable(runs)))
    unit, cut = np.nonzero((bounds.to_numpy()[:, None] >> np.arange(BITS + 1)) & 1)
    inner = np.flatnonzero(unit[1:] == unit[:-1])
    unit, a, b = unit[inner], cut[inner], cut[inner + 1]
    found = [words[u][x:y] for u, x, y in zip(unit.tolist(), a.tolist(), b.tolist())]
    get, size = v.ids.get, np.ones(len(found), np.int64)
    ids = np.array([get(x, -1) for x in found], np.int64)
    lost = np.flatnonzero(ids < 0)
    if len(lost):
        raw = [[v.bytes[x] for x in found[i].encode()] for i in lost.tolist()]
        size[lost] = list(map(len, raw))
        ids = np.repeat(ids, size)
        ids[ids < 0] = list(chain.from_iterable(raw))
    return np.bincount(unit, size, len(words)).astype(np.int64), ids


def take_runs(begin: np.ndarray, flat: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The runs ``flat[begin[i]:begin[i + 1]]`` of all i in ``at``, end to end."""
    size = begin[at + 1] - begin[at]
    end = np.cumsum(size)
    return flat[np.repeat(begin[at] - end + size, size) + np.arange(int(end[-1]) if len(end) else 0)]


def joined_runs(word_begin, word_units, begin, flat):
    """Runs of ids for each word, from its units and their runs."""
    size = (begin[1:] - begin[:-1])[word_units]
    total = np.concatenate([[0], np.cumsum(size)])
    return total[word_begin], take_runs(begin, flat, word_units)


def decode(encoded: DataFrame, ids_col: str = "ids", model: str = MODEL, out: str = "decoded") -> DataFrame:
    """``encoded`` with the text of its ids: pieces joined, runs of byte pieces read as UTF-8, the leading space dropped."""
    v = Vocabulary(model)
    at = encoded.columns.index(ids_col)

    def run(batches):
        text_of_ids = v.decoder()
        for batch in batches:
            for part in pieces(batch):
                text = [None if x is None else text_of_ids(x) for x in part.column(at).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(text, pa.string())], names=[*part.schema.names, out])

    return encoded.mapInArrow(run, T.StructType([*encoded.schema.fields, T.StructField(out, T.StringType())]))


def round_trip(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """(doc_id, n_tokens, ids_hash, round_trip): the ids of every whole text, each decoded again and compared with its text."""
    return encode(docs, model=model).select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"), F.xxhash64("ids").alias("ids_hash"), "round_trip")
