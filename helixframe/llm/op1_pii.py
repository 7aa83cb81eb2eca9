"""Personal data: patterns, and terms that give a protected entity away.

Patterns find e-mail addresses, IP addresses, card and phone numbers.  Each value is a protected
entity e.  The words of the documents that hold it are its terms t.  With document counts over
the whole corpus, t discloses e by PMI(t; e) = log2(n(t, e) N / (n(t) n(e))) bits out of the IC(e) = log2(N / n(e)) bits that e
holds.  The share n(t, e) / n(t) of t's documents is smoothed by ``PRIOR`` documents of the base rate n(e) / N, so few documents give
less than many.  From the share of IC(e) so reached ``DOUBT`` / k is taken, k being the documents that hold both: the lower confidence bound of a
proportion seen k times out of k at a level that tightens with the information claimed, (n(e) / N) ** DOUBT.  One observation so never reaches ``GENERALISE``,
in a corpus of any size; two do from some hundred documents on.  A term whose disclosure reaches ``GENERALISE``
of IC(e) for any e is generalised to a tag, from ``REMOVE`` on it is removed: at all its places, in every document of the corpus.

Everything is counted by Spark: document frequencies are counted per batch before the shuffle; entities held by the same documents
are judged as one; of a document's words only those rare enough to reach ``GENERALISE`` for an entity of it are paired with that
entity.  The flagged terms meet the places of words by an equi-join.  Neither lists nor spans pass through the driver: a bitmap of
``SLOTS`` bits, set where a flagged term's checksum falls, keeps most other words out of that join (and decides nothing else).

Defined cases: null text is empty (no spans); rows repeated under one id are equal and get equal spans; rows with equal id and different text
are told apart by a hash of the text; null ids are kept; an empty table gives no rows; other columns pass through ``sanitised`` untouched.
"""
from __future__ import annotations

import hashlib
import re
from collections import Counter
from zlib import crc32

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.llm.common import pieces, staged, text_of, tidy

PRIOR, DOUBT, GENERALISE, REMOVE = 1.0, 0.21, 0.8, 0.95  # DOUBT is more than 1 - GENERALISE
SLOTS = 1 << 25
HELD_WORDS = 200_000
KINDS = ["email", "ip", "card", "phone", "term"]
# Characters of the patterns.
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
DOTTED = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3,}")  # only from the start of a digit run: a later start fails alike, and a long run is read once
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
DIGITS = re.compile(r"[0-9]")
WORD = re.compile(r"[^\W\d_]{3,}")


def emails(text: str):
    """Each @ closes one candidate: its local part reaches left to the previous match at most."""
    end = 0
    for m in DOMAIN.finditer(text):
        at = start = m.start()
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        if start < at:
            end = m.end()
            yield start, end


def ips(text: str):
    """A chain of dotted numbers holds one candidate in each four numbers, from its left."""
    for m in DOTTED.finditer(text):
        at, parts = m.start(), m.group().split(".")
        for i in range(0, len(parts) - 3, 4):
            four = parts[i:i + 4]
            start = at + sum(map(len, parts[:i])) + i
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in four):
                yield start, start + sum(map(len, four)) + 3


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def cards(text: str):
    for m in CARD.finditer(text):
        d = "".join(DIGITS.findall(m.group()))
        if 12 <= len(d) <= 19 and luhn(d):
            yield m.span()


def phones(text: str):
    for m in PHONE.finditer(text):
        if 9 <= len(DIGITS.findall(m.group())) <= 15:
            yield m.span()


FINDERS = [emails, ips, cards, phones]


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of all pattern matches, by start, then kind."""
    return sorted((s, k, e) for k, f in enumerate(FINDERS) for s, e in f(text))


def entity(text: str, s: int, k: int, e: int) -> str:
    return f"{KINDS[k]}:" + (text[s:e].lower() if k == 0 else "".join(DIGITS.findall(text[s:e])) if k > 1 else text[s:e])


def outside(text: str, taken: list[tuple[int, int, int]]):
    """(word, start, end) of the words outside of pattern matches (``taken``, by start)."""
    k, end = 0, 0
    for m in WORD.finditer(text):
        a, b = m.span()
        while k < len(taken) and taken[k][0] < b:
            end = max(end, taken[k][2])
            k += 1
        if end <= a:
            yield m.group().lower(), a, b


_FOUND = "k1 bigint, k2 bigint, id bigint, counts array<bigint>, base string, sha string, who array<string>, words array<string>"


def found_rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row a document: pattern counts and spans, its entities, and its words if it has any entity."""

    def run(batches):
        for batch in batches:
            for part in pieces(batch):
                counts, base, sha, who, words = [], [], [], [], []
                for value in part.column(3):
                    text = value.as_py()
                    spans = base_spans(text)
                    n = Counter(k for _, k, _ in spans)
                    counts.append([n[k] for k in range(4)])
                    base.append(",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans))
                    sha.append(hashlib.sha256(base[-1].encode()).hexdigest())
                    who.append(sorted({entity(text, s, k, e) for s, k, e in spans}))
                    words.append(sorted({w for w, _, _ in outside(text, spans)}) if spans else [])
                strings = pa.list_(pa.string())
                yield pa.record_batch([*part.columns[:3], pa.array(counts, pa.list_(pa.int64())), pa.array(base), pa.array(sha), pa.array(who, strings), pa.array(words, strings)],
                                      names=["k1", "k2", "id", "counts", "base", "sha", "who", "words"])
        batch = part = text = value = counts = base = sha = who = words = spans = None
        tidy()

    return _keyed(docs, id_col, text_col).mapInArrow(run, _FOUND)


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = text_of(text_col)
    return docs.select(F.coalesce(F.col(id_col).cast("bigint"), F.lit(-1)).alias("k1"), F.xxhash64(text).alias("k2"), F.col(id_col).cast("bigint").alias("id"), text.alias("text"))


def document_frequencies(docs: DataFrame, text_col: str) -> DataFrame:
    """(t, n): documents that hold each word, counted in each task (``HELD_WORDS`` words at a time) before the shuffle."""

    def run(batches):
        n = Counter()
        rows = lambda: pa.record_batch([pa.array(list(n), pa.string()), pa.array(list(n.values()), pa.int64())], names=["t", "n"])
        for batch in batches:
            for value in batch.column(0):
                n.update({w.lower() for w in WORD.findall(value.as_py())})
                if len(n) >= HELD_WORDS:
                    yield rows()
                    n.clear()
        yield rows()
        n.clear()
        tidy()

    return docs.select(text_of(text_col).alias("t")).mapInArrow(run, "t string, n bigint")


def frequencies_of(docs: DataFrame, terms: DataFrame, text_col: str) -> DataFrame:
    """(t, n_t): documents that hold each of the distinct ``terms``.

    The counts of all tasks are summed before the join, so a word takes part in it once, however many tasks saw it.  (An inner join: a semi
    join may be moved below the sum.)"""
    return document_frequencies(docs, text_col).groupBy("t").agg(F.sum("n").alias("n_t")).join(terms, "t")


def disclosing(docs: DataFrame, found: DataFrame, n_docs: int, text_col: str, generalise: float = GENERALISE) -> DataFrame:
    """(t, share): terms that disclose at least ``generalise`` of an entity's information, with the largest share."""
    held = found.where(F.size("who") > 0)
    mentions = held.select("k1", "k2", F.explode("who").alias("e")).groupBy("k1", "k2", "e").agg(F.count(F.lit(1)).alias("c"))  # c: rows of the document
    doc = F.struct("k1", "k2")
    # entities of the same documents share every count, so one of them stands for all
    same = [F.sum(F.xxhash64(F.lit(k), doc).cast("decimal(38,0)")).alias(f"s{k}") for k in (0, 1)]
    ents = mentions.groupBy("e").agg(F.sum("c").alias("n_e"), *same).groupBy("n_e", "s0", "s1").agg(F.min("e").alias("e")).where(F.col("n_e") < n_docs)
    base = F.col("n_e") / float(n_docs)
    # no word of more documents reaches the share, as n_te is n_e at most
    least = F.lit(generalise) + F.lit(DOUBT) / F.col("n_e")
    most = (F.col("n_e") + PRIOR * base) / F.pow(base, 1 - least) - PRIOR + 1e-6
    who = staged(mentions.join(ents.where(least <= 1).select("e", "n_e", most.alias("most")), "e"))
    near = held.join(who.select("k1", "k2").distinct(), ["k1", "k2"], "left_semi")
    words = near.select("k1", "k2", F.explode("words").alias("t")).distinct()
    n_t = frequencies_of(docs, words.select("t").distinct(), text_col)
    top = who.agg(F.max("most")).first()[0]
    pair = words.join(n_t.where(F.col("n_t") <= F.lit(top)), "t").join(who, ["k1", "k2"]).where("n_t <= most")
    pair = pair.groupBy("e", "t").agg(F.sum("c").alias("n_te"), F.first("n_t").alias("n_t"), F.first("n_e").alias("n_e"))
    pmi = F.log2((F.col("n_te") + PRIOR * base) / (F.col("n_t") + PRIOR) / base)
    share = pmi / -F.log2(base) - F.lit(DOUBT) / F.col("n_te")
    return pair.select("t", share.alias("share")).where(F.col("share") >= generalise).groupBy("t").agg(F.max("share").alias("share"))


def bitmap(flagged: DataFrame) -> bytes:
    """``SLOTS`` bits, set at the checksums of the flagged terms: as long for any number of them."""
    slot = F.crc32("t") % SLOTS
    rows = flagged.groupBy(F.floor(slot / 32768).cast("int").alias("b")).agg(F.bitmap_construct_agg(slot % 32768).alias("bits")).collect()
    out = bytearray(SLOTS // 8)
    for r in rows:
        out[4096 * r["b"]:4096 * (r["b"] + 1)] = r["bits"]
    return bytes(out)


def places(docs: DataFrame, id_col: str, text_col: str, bits: bytes) -> DataFrame:
    """(k1, k2, t, s, f): the places of words that the bitmap lets pass, in all documents."""
    struct = ["k1", "k2", "t", "s", "f"]

    def flagged(word: str) -> int:
        at = crc32(word.encode()) % SLOTS
        return bits[at >> 3] >> (at & 7) & 1

    def run(batches):
        for batch in batches:
            for part in pieces(batch):
                rows = []
                for k1, k2, value in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(3)):
                    text = value.as_py()
                    hit = {w for w in {x.lower() for x in WORD.findall(text)} if flagged(w)}
                    if hit:
                        rows += [(k1, k2, w, a, b) for w, a, b in outside(text, base_spans(text)) if w in hit]
                if rows:
                    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.int32()]
                    yield pa.record_batch([pa.array(x, t) for x, t in zip(zip(*rows), kinds)], names=struct)
        batch = part = rows = hit = None
        tidy()

    return _keyed(docs, id_col, text_col).mapInArrow(run, "k1 bigint, k2 bigint, t string, s int, f int")


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", generalise: float = GENERALISE):
    """(rows, term spans): a row for each document with its pattern spans, and (k1, k2, own) with the term spans as an array."""
    found = staged(found_rows(docs, id_col, text_col))
    flagged = staged(disclosing(docs, found, found.count(), text_col, generalise))
    spans = places(docs, id_col, text_col, bitmap(flagged)).join(flagged, "t").groupBy("k1", "k2", "s", "f").agg(F.max("share").alias("share"))
    own = spans.groupBy("k1", "k2").agg(F.collect_list(F.struct("s", "f", "share")).alias("own"))  # at most the words of one document
    return found.drop("who", "words"), own


def scan(docs: DataFrame) -> DataFrame:
    found, own = find_personal_data(docs)
    kind = " ".join(KINDS)
    split = F.transform(F.filter(F.split("base", ","), lambda x: x != ""), lambda x: F.split(x, ":"))
    base = F.transform(split, lambda p: F.struct(p[1].cast("int").alias("s"), F.array_position(F.array(*[F.lit(k) for k in kind.split()]), p[0]).cast("int").alias("k"), p[2].cast("int").alias("f")))
    term = F.transform(F.coalesce("own", F.array().cast("array<struct<s:int,f:int,share:double>>")), lambda x: F.struct(x["s"].alias("s"), F.lit(5).alias("k"), x["f"].alias("f")))
    every = F.array_sort(F.concat(base, term))
    names = F.array(*[F.lit(k) for k in KINDS])
    text = F.array_join(F.transform(every, lambda x: F.concat_ws(":", F.element_at(names, x["k"]), x["s"], x["f"])), ",")
    n = [F.col("counts")[k].alias(f"n_{KINDS[k]}") for k in range(4)]
    return found.join(own, ["k1", "k2"], "left").select(F.col("id").alias("doc_id"), *n, F.col("sha").alias("base_sha256"), text.alias("spans"), F.size(term).cast("bigint").alias("n_term"))


def replaced(text: str, own: list, remove: float = REMOVE) -> str:
    """The text with its pattern matches and terms generalised to tags or removed; of overlapping spans the union is replaced once."""
    spans = sorted([(s, e, f"<{KINDS[k].upper()}>") for s, k, e in base_spans(text)] + [(x["s"], x["f"], "" if x["share"] >= remove else "<TERM>") for x in own])
    out, at = [], 0
    for s, e, tag in spans:
        if s >= at:
            out += [text[at:s], tag]
        at = max(at, e)
    return "".join([*out, text[at:]])


def sanitised(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the personal data of its text replaced; a null text stays null."""
    _, own = find_personal_data(docs, id_col, text_col)
    key = [F.coalesce(F.col(id_col).cast("bigint"), F.lit(-1)).alias("_k1"), F.xxhash64(text_of(text_col)).alias("_k2")]
    joined = docs.select("*", *key).join(own.select(F.col("k1").alias("_k1"), F.col("k2").alias("_k2"), F.col("own").alias("_own")), ["_k1", "_k2"], "left")
    joined = joined.select(*docs.columns, "_own")
    at, n = docs.columns.index(text_col), len(docs.columns)

    def run(batches):
        for batch in batches:
            for part in pieces(batch):
                new = [None if t is None else replaced(t, o or []) for t, o in zip((x.as_py() for x in part.column(at)), part.column(n).to_pylist())]
                cols = [pa.array(new, part.column(at).type) if i == at else part.column(i) for i in range(n)]
                yield pa.RecordBatch.from_arrays(cols, names=part.schema.names[:n])
        batch = part = new = cols = None
        tidy()

    return joined.mapInArrow(run, docs.schema)
