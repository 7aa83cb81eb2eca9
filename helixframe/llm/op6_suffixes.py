"""Exact removal of repeated byte strings by sampled suffixes, sorted one bucket at a time.

A byte goes when a ``LENGTH``-byte string over it starts earlier as well (smaller id, or the same document further left).

A suffix array of every position would shuffle each text a hundredfold.  As in blockwise suffix sorting, only a sample of
suffixes is sorted, one bucket (a hash range of their first ``BLOCK`` bytes) per task, and the order of the sample answers for the
other suffixes.  The sample must cover: of two equal strings, the suffixes at one common offset must both be in
it.  A periodic difference cover gives that with 9 positions in 73; here the sampled offset is chosen by content (the least hash among the
blocks of the string), which gives the same guarantee with 2 in 78 (see the README for the sizes).  So every string belongs to one
sampled suffix, and a sampled suffix (name: its block; context: all strings that belong to it) is one short row.

1. Rows with a context seen earlier are removed whole: the first of each (name, context) is found per batch, then per bucket.
2. A name with several contexts is a long tie: the first row of each context fetches its bytes and the strings are
   compared per name and offset.  A name with more than ``HOT`` contexts is split by string instead, so it spreads over all tasks.
3. Covered bytes are the union of the removed strings; each document's spans meet its text by a join.

Rows of equal (name, context) are reduced per batch before each shuffle, so a hot passage costs one row per task.

Defined cases: null text is empty; texts under ``LENGTH`` bytes lose nothing; rows repeated under one id with equal text are one document and get
equal results; different texts under one id are ordered by a hash; a null id sorts last; an empty table gives no rows; other columns are
ignored; long texts are read in overlapping chunks, none is cut.
"""
from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.llm.common import spread, staged, text_of, tidy

LENGTH, BLOCK, CHUNK, HOT = 100, 24, 1 << 20, 256
_LAST = (1 << 63) - 1


def random_words(seed: int, n: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64(seed)).integers(0, 1 << 64, n, np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class RangeHash:
    """64-bit hashes of any byte range of a buffer from one running sum of powers."""

    def __init__(self, seed: int, capacity: int):
        table = random_words(seed, 257)
        self.of_byte, base = table[:256], table[256] | np.uint64(1)
        inverse = np.uint64(pow(int(base), -1, 1 << 64))
        self.up = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(capacity, base)]))
        self.down = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(capacity, inverse)]))

    def load(self, buf: np.ndarray) -> None:
        self.sums = np.concatenate([[np.uint64(0)], np.add.accumulate(self.of_byte[buf] * self.up[:len(buf)])])

    def of(self, a, b) -> np.ndarray:
        return mix((self.sums[b] - self.sums[a]) * self.down[a] + (b - a).astype(np.uint64))


def least_blocks(h: np.ndarray, width: int) -> np.ndarray:
    """Leftmost position of the least value in every window of ``width``."""
    at, have = np.arange(len(h), dtype=np.int32), 1
    while have < width:
        s = min(have, width - have)
        take = h[s:] < h[:-s]
        h, at = np.where(take, h[s:], h[:-s]), np.where(take, at[s:], at[:-s])
        have += s
    return at


def packed(mark: int, pos, low, high):
    """mark (17 bits), position (32), least and greatest offset of its strings (7 each): sorts by mark, position."""
    return (np.int64(mark) << 46) | (pos.astype(np.int64) << 14) | (low.astype(np.int64) << 7) | high.astype(np.int64)


def unpacked(pk: np.ndarray):
    return pk >> 46, (pk >> 14) & 0xFFFFFFFF, (pk >> 7) & 127, pk & 127


def text_mark(data: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(data, digest_size=4).digest(), "little") & 0x1FFFF


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.coalesce(F.col(id_col).cast("bigint"), F.lit(_LAST)).alias("doc"), text_of(text_col).alias("text"))


def chunks(column_doc, column_text):
    """Batches of (doc, mark, base, bytes): whole texts, or overlapping parts of a long one, up to ``CHUNK`` bytes together."""
    held, size, seen = [], 0, set()
    for doc, value in zip(column_doc.to_pylist(), column_text):
        data = value.as_buffer().to_pybytes()
        if len(data) < LENGTH:
            continue
        key = (doc, hashlib.blake2b(data, digest_size=16).digest())
        if key in seen:
            continue
        seen.add(key)
        mark = text_mark(data)
        for base in range(0, len(data) - LENGTH + 1, CHUNK):
            part = data[base:base + CHUNK + LENGTH - 1]
            if size and size + len(part) > CHUNK:
                yield held
                held, size = [], 0
            held.append((doc, mark, base, part))
            size += len(part)
    if held:
        yield held


def sampled_rows(docs: DataFrame) -> DataFrame:
    """(name, ctx, doc, pk) of all sampled suffixes; ctx is null where the batch itself has shown the context to be repeated."""

    def run(batches):
        block, range_ = (RangeHash(s, CHUNK + 2 * LENGTH) for s in (11, 12))
        for batch in batches:
            for held in chunks(batch.column(0), batch.column(1)):
                held.sort(key=lambda x: x[:3])
                size = np.array([len(x[3]) for x in held])
                first = np.concatenate([[0], np.cumsum(size)])
                buf = np.frombuffer(b"".join(x[3] for x in held), np.uint8)
                block.load(buf)
                range_.load(buf)
                every = np.arange(len(buf) - BLOCK + 1)
                at = least_blocks(block.of(every, every + BLOCK), LENGTH - BLOCK + 1)
                start = np.concatenate([np.arange(a, b - LENGTH + 1) for a, b in zip(first[:-1], first[1:])])
                own = np.repeat(np.arange(len(held)), size - LENGTH + 1)
                p = at[start].astype(np.int64)
                turn = np.concatenate([[True], (p[1:] != p[:-1]) | (own[1:] != own[:-1])])
                f = np.flatnonzero(turn)
                last = np.concatenate([f[1:], [len(p)]]) - 1
                p, own, i, j = p[f], own[f], start[f], start[last]
                high, low = p - i, p - j
                name = block.of(p, p + BLOCK)
                ctx = mix(range_.of(i, j + LENGTH) + (high * 128 + low).astype(np.uint64))
                doc = np.array([x[0] for x in held], np.int64)[own]
                base = np.array([x[2] for x in held], np.int64)[own] - first[:-1][own]
                pk = packed(0, p + base, low, high) | (np.array([x[1] for x in held], np.int64)[own] << 46)
                o = np.argsort(name ^ mix(ctx), kind="stable")  # rows stand in document order: the first of equals is the earliest
                key = (name ^ mix(ctx))[o]
                again = np.zeros(len(o), bool)
                again[o[1:]] = key[1:] == key[:-1]
                yield pa.record_batch([pa.array(np.where(again, mix(pk.astype(np.uint64)), name).astype(np.int64)), pa.array(ctx.astype(np.int64), mask=again), pa.array(doc), pa.array(pk)],
                                      names=["name", "ctx", "doc", "pk"])
        block = range_ = held = batch = None
        tidy()

    return docs.mapInArrow(run, "name bigint, ctx bigint, doc bigint, pk bigint")


def bucket_firsts(rows: DataFrame, ties: bool) -> DataFrame:
    """Sorts each bucket of (name, ctx, doc, pk) and tells (doc, pk, kind, name): kind 1 repeats an earlier row, kind 2 is the first of
    one of several contexts of a name (only where ``ties`` are asked for).  Rows without ctx pass as kind 1."""
    n = spread(rows.sparkSession)
    dealt = rows.repartition(n, "name").sortWithinPartitions("name", "ctx", "doc", "pk")

    def run(batches):
        last, waiting = None, None  # last row; the first row of its name while no second context is known
        for batch in batches:
            known = batch.column(1).is_valid().to_numpy(zero_copy_only=False)
            name, ctx, doc, pk = (batch.column(c).fill_null(0).to_numpy() for c in range(4))
            out = [(doc[~known], pk[~known], np.ones((~known).sum(), np.int32), name[~known])]
            name, ctx, doc, pk = (x[known] for x in (name, ctx, doc, pk))
            if len(name):
                before = last if last is not None else (name[0] ^ 1, ctx[0] ^ 1, doc[0] ^ 1, pk[0] ^ 1)
                prev = [np.concatenate([[b], x[:-1]]) for b, x in zip(before, (name, ctx, doc, pk))]
                new_name = name != prev[0]
                new_ctx = new_name | (ctx != prev[1])
                equal = ~new_ctx & (doc == prev[2]) & (pk == prev[3])
                rep = ~new_ctx & ~equal
                out.append((doc[rep], pk[rep], np.ones(rep.sum(), np.int32), name[rep]))
                if ties:
                    edge = new_ctx & ~new_name
                    group = np.cumsum(new_name)  # 0: still the name of the last batch
                    if waiting is not None and edge[group == 0].any():
                        out.append(tuple(np.array([x]) for x in (waiting[0], waiting[1], 2, waiting[2])))
                        waiting = None
                    many = np.zeros(group[-1] + 1, bool)
                    many[group[edge]] = True
                    show = edge | (new_name & many[group])
                    out.append((doc[show], pk[show], np.full(show.sum(), 2, np.int32), name[show]))
                    if group[-1]:
                        i = int(np.flatnonzero(new_name)[-1])
                        waiting = None if many[group[-1]] else (doc[i], pk[i], name[i])
                last = (name[-1], ctx[-1], doc[-1], pk[-1])
            yield pa.record_batch([pa.array(np.concatenate([x[c] for x in out]).astype(t)) for c, t in enumerate((np.int64, np.int64, np.int32, np.int64))], names=["doc", "pk", "kind", "name"])

    return dealt.mapInArrow(run, "doc bigint, pk bigint, kind int, name bigint")


def zipped(docs: DataFrame) -> DataFrame:
    """(doc, mark, z): texts as compressed bytes, as they travel to the rows of their document."""

    def run(batches):
        import zstandard
        c = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            data = [x.as_buffer().to_pybytes() for x in batch.column(1)]
            yield pa.record_batch([batch.column(0), pa.array([text_mark(x) for x in data], pa.int64()), pa.array([c.compress(x) for x in data], pa.binary())], names=["doc", "mark", "z"])

    return docs.mapInArrow(run, "doc bigint, mark bigint, z binary")


def tie_strings(edges: DataFrame, docs: DataFrame) -> DataFrame:
    """The bytes of tied rows: (name, doc, pk, ctx) with all strings of a row, or, for hot names, a row for each string
    (name and w: two hashes of the string with its offset; pk with that offset only; w 0 where the batch has it already)."""
    listed = edges.groupBy("doc", F.shiftright("pk", 46).alias("mark")).agg(F.collect_list(F.struct("name", "pk", "hot")).alias("rows"))
    joined = zipped(docs).join(listed, ["doc", "mark"]).select("doc", "z", "rows")

    def run(batches):
        import zstandard
        d = zstandard.ZstdDecompressor()
        one, two = (RangeHash(s, 4 * LENGTH) for s in (13, 14))
        schema = pa.schema([("name", pa.int64()), ("doc", pa.int64()), ("pk", pa.int64()), ("ctx", pa.binary()), ("w", pa.int64())])
        for batch in batches:
            docs_, z, lists = batch.column(0).to_pylist(), batch.column(1), batch.column(2)
            out, seen, done, hot_rows = [[], [], [], [], []], set(), set(), []
            for doc, zz, rows in zip(docs_, z, lists):
                if (doc, one_of := rows.values.field(1)[0].as_py() >> 46) in done:
                    continue
                done.add((doc, one_of))
                text = d.decompress(zz.as_buffer().to_pybytes())
                names, pks, hots = (rows.values.field(f) for f in range(3))
                mark, pos, low, high = unpacked(pks.to_numpy())
                for name, pk, hot, p, lo, hi in zip(names.to_pylist(), pks.to_pylist(), hots.to_pylist(), pos.tolist(), low.tolist(), high.tolist()):
                    ctx = text[p - hi:p - lo + LENGTH]
                    if not hot:
                        for x, v in zip(out, (name, doc, pk, ctx, None)):
                            x.append(v)
                    else:
                        hot_rows.append((doc, pk, name, ctx, hi, lo))
                if len(out[0]) > 50_000:
                    yield pa.record_batch([pa.array(x, t) for x, t in zip(out, schema.types)], schema=schema)
                    out = [[], [], [], [], []]
            hot_rows.sort(key=lambda r: r[:2])
            for doc, pk, name, ctx, hi, lo in hot_rows:
                buf = np.frombuffer(ctx, np.uint8)
                one.load(buf)
                two.load(buf)
                a = np.arange(hi - lo + 1)
                off = (hi - a).astype(np.uint64)
                w1, w2 = mix(one.of(a, a + LENGTH) + off), mix(two.of(a, a + LENGTH) ^ np.uint64(name & ((1 << 64) - 1)))
                for x, y, l in zip(w1.astype(np.int64).tolist(), w2.astype(np.int64).tolist(), off.tolist()):
                    again = (x, y) in seen
                    seen.add((x, y))
                    for c, v in zip(out, (x, doc, (pk >> 14 << 14) | (l << 7) | l, None, 0 if again else y or 1)):
                        c.append(v)
                if len(out[0]) > 50_000:
                    yield pa.record_batch([pa.array(x, t) for x, t in zip(out, schema.types)], schema=schema)
                    out = [[], [], [], [], []]
            yield pa.record_batch([pa.array(x, t) for x, t in zip(out, schema.types)], schema=schema)

    return joined.mapInArrow(run, "name bigint, doc bigint, pk bigint, ctx binary, w bigint")


def settled_ties(tied: DataFrame) -> DataFrame:
    """(doc, pk) of the tied strings that start earlier as well; offsets in pk are narrowed to runs of such strings.

    The rows of a name (``HOT`` at most, as counted before) are taken together: strings of one name and offset are compared by hash."""
    dealt = tied.repartition(spread(tied.sparkSession), "name").sortWithinPartitions("name", "doc", "pk")

    def settle(t: pa.Table):
        name, doc, pk = (t.column(c).to_numpy() for c in range(3))
        twice = np.concatenate([[False], (name[1:] == name[:-1]) & (doc[1:] == doc[:-1]) & (pk[1:] == pk[:-1])])
        if twice.any():  # a document that stands in the table more than once
            t = t.filter(pa.array(~twice))
            name, doc, pk = (t.column(c).to_numpy() for c in range(3))
        _, pos, low, high = unpacked(pk)
        size = high - low + 1
        data = t.column(3).combine_chunks()
        data = data if isinstance(data, pa.Array) else data.chunk(0)
        offsets = np.frombuffer(data.buffers()[1], np.int32)[data.offset:data.offset + len(data) + 1].astype(np.int64)
        buf = np.frombuffer(data.buffers()[2], np.uint8)[offsets[0]:offsets[-1]]
        h = RangeHash(15, len(buf) + 1)
        h.load(buf)
        row = np.repeat(np.arange(len(name)), size)
        k = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
        a = (offsets[:-1] - offsets[0])[row] + k
        off = high[row] - k
        key = mix(h.of(a, a + LENGTH) + off.astype(np.uint64)) ^ mix(name.astype(np.uint64))[row]
        o = np.argsort(key, kind="stable")
        again = np.zeros(len(o), bool)
        again[o[1:]] = key[o[1:]] == key[o[:-1]]
        # runs of removed strings of one row
        r = np.flatnonzero(again)
        if not len(r):
            return None
        cut = np.concatenate([[True], (r[1:] != r[:-1] + 1) | (row[r[1:]] != row[r[:-1]])])
        f = np.flatnonzero(cut)
        l = np.concatenate([f[1:], [len(r)]]) - 1
        hi, lo, ro = off[r[f]], off[r[l]], row[r[f]]
        return pa.record_batch([pa.array(doc[ro]), pa.array((pk[ro] >> 14 << 14) | (lo << 7) | hi)], names=["doc", "pk"])

    def run(batches):
        held = None
        for batch in batches:
            for at in range(0, batch.num_rows, 20_000):
                part = batch.slice(at, 20_000)
                t = pa.Table.from_batches([part]) if held is None else pa.concat_tables([held, pa.Table.from_batches([part])])
                name = t.column(0).to_numpy()
                cut = int(np.flatnonzero(name == name[-1])[0])
                if cut and (got := settle(t.slice(0, cut))) is not None:
                    yield got
                held = t.slice(cut)
        if held is not None and held.num_rows and (got := settle(held)) is not None:
            yield got

    return dealt.mapInArrow(run, "doc bigint, pk bigint")


def covered(docs: DataFrame, removed: DataFrame) -> DataFrame:
    """(doc, n_bytes, n_removed, n_spans, kept): the texts without the bytes of their removed strings."""
    listed = removed.groupBy("doc", F.shiftright("pk", 46).alias("mark")).agg(F.collect_list("pk").alias("rows"))
    joined = zipped(docs).join(listed, ["doc", "mark"], "left").select("doc", "z", "rows")

    def run(batches):
        import zstandard
        d = zstandard.ZstdDecompressor()
        for batch in batches:
            ids, n, gone, spans, sha = [], [], [], [], []
            for doc, z, rows in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                text = d.decompress(z.as_buffer().to_pybytes())
                a = b = np.empty(0, np.int64)
                if rows.is_valid:
                    _, pos, low, high = unpacked(rows.values.to_numpy())
                    o = np.argsort(pos - high)
                    a, e = (pos - high)[o], np.maximum.accumulate((pos - low + LENGTH)[o])
                    new = np.concatenate([[True], a[1:] > e[:-1]])
                    a, b = a[new], e[np.concatenate([np.flatnonzero(new)[1:] - 1, [len(e) - 1]])]
                kept, at = [], 0
                for x, y in zip(a.tolist(), b.tolist()):
                    kept.append(text[at:x])
                    at = y
                kept.append(text[at:])
                ids.append(None if doc == _LAST else doc)
                n.append(len(text))
                gone.append(int((b - a).sum()))
                spans.append(len(a))
                sha.append(hashlib.sha256(b"".join(kept)).hexdigest())
            yield pa.record_batch([pa.array(ids, pa.int64()), *[pa.array(x, pa.int64()) for x in (n, gone, spans)], pa.array(sha, pa.string())],
                                  names=["doc", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return joined.mapInArrow(run, "doc bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT) -> DataFrame:
    rows = keyed(docs, id_col, text_col)
    told = staged(bucket_firsts(sampled_rows(rows), True))
    edges = told.where("kind = 2").select("name", "doc", "pk")
    busy = edges.groupBy("name").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > hot).select("name", F.lit(True).alias("_hot"))
    edges = edges.join(staged(busy), "name", "left").withColumn("hot", F.coalesce("_hot", F.lit(False)))
    tied = staged(tie_strings(edges, rows))
    few = settled_ties(tied.where("w is null").select("name", "doc", "pk", "ctx"))
    many = tied.where("w is not null").select("name", F.when(F.col("w") != 0, F.col("w")).alias("ctx"), "doc", "pk")
    many = bucket_firsts(many, False).select("doc", "pk")
    removed = told.where("kind = 1").select("doc", "pk").unionAll(few).unionAll(many)
    out = covered(rows, removed)
    return out.withColumnRenamed("doc", id_col)
