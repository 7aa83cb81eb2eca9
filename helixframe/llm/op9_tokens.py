"""Token counts from flat, unindexed token files: a vectorised separator scan.

``write_token_blocks`` encodes texts and lays the ids end to end, each document closed
by the end-of-document id, in fixed-size little-endian blocks that know nothing of
documents (one file per input partition; a side list keeps the ids in file order).
``scan_blocks`` searches every block for the separator with one numpy comparison, and
the boundaries across blocks are stitched by a prefix scan over the few summary rows of
a file: running token offset and the last separator before each block.

Defined cases: a null or empty text has 0 tokens; a null id is kept; repeated rows are
counted one by one; an empty table gives no rows; other columns are ignored.  A document
may span any number of blocks.  Documents are encoded whole.
"""
from __future__ import annotations

import base64
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from helixframe.llm.common import pieces, staged, text_of, tidy

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the published pre-split pattern of that vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
EOD = 50256
BLOCK_TOKENS = 1 << 18
CUT_CHARS = 1 << 16
LONG_PIECE = 4096  # characters up to which the tokenizer gets a piece of the pre-split whole
LONG_RUN = r"\s{%d,}|\S{%d,}" % (LONG_PIECE, CUT_CHARS)  # what its own pre-split cannot take: it recurses over a run

_OUT = "file int, seq bigint, data binary, first bigint, ids array<bigint>"


def load_ranks(rank_lines: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in (x.split() for x in rank_lines.splitlines() if x)}


def load_encoding(rank_lines: bytes):
    import tiktoken
    return tiktoken.Encoding("flat", pat_str=PATTERN, mergeable_ranks=load_ranks(rank_lines), special_tokens={})


def safe_parts(text: str, size: int = CUT_CHARS) -> list[str]:
    """Cuts a long text before single spaces between two non-spaces, where no token can reach across."""
    out, at = [], 0
    while len(text) - at > size:
        cut = text.find(" ", at + size)
        while cut >= 0 and (cut + 1 >= len(text) or text[cut - 1].isspace() or text[cut + 1].isspace()):
            cut = text.find(" ", cut + 1)
        if cut < 0:
            break
        out.append(text[at:cut])
        at = cut
    return [*out, text[at:]]


def merged(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Byte-pair ids of one piece by a heap of neighbouring pairs, lowest rank and then leftmost first: n log n for a piece of any length."""
    n = len(piece)
    end, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n  # a part starts at its index and ends at end[i], where the next starts
    get = ranks.get
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := get(piece[i:i + 2])) is not None]
    heapify(heap)
    while heap:
        _, i, to = heappop(heap)
        j = end[i]
        if not alive[i] or j >= n or end[j] != to:
            continue  # one of the two has been merged since
        alive[j], end[i] = False, to
        if to < n:
            before[to] = i
            r = get(piece[i:end[to]])
            if r is not None:
                heappush(heap, (r, i, end[to]))
        h = before[i]
        if h >= 0:
            r = get(piece[h:to])
            if r is not None:
                heappush(heap, (r, h, to))
    return [ranks[piece[i:end[i]]] for i in range(n) if alive[i]]


def encoded(enc, ranks: dict[bytes, int], text: str) -> list[int]:
    """The ids of ``text``.  Runs of white space or of anything else that the tokenizer's pre-split can't take are split here by the same pattern,
    and pieces too long for its merging are merged by ``merged``."""
    import regex
    if not regex.search(LONG_RUN, text):
        return enc.encode_ordinary(text)
    out = []
    for m in regex.finditer(PATTERN, text):
        piece = m.group()
        out += enc._encode_single_piece(piece) if len(piece) <= LONG_PIECE else merged(piece.encode(), ranks)
    return out


def write_token_blocks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = TOKENIZER,
                       block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Rows (file, seq, data) of the flat files, and rows (file, first, ids) of the side list."""
    with open(tokenizer, "rb") as f:
        rank_lines = f.read()

    def run(batches):
        enc, ranks, file = load_encoding(rank_lines), load_ranks(rank_lines), TaskContext.get().partitionId()
        schema = pa.schema([("file", pa.int32()), ("seq", pa.int64()), ("data", pa.binary()), ("first", pa.int64()), ("ids", pa.list_(pa.int64()))])
        row = lambda seq, data, first, ids: pa.record_batch([pa.array([x], t) for x, t in zip((file, seq, data, first, ids), schema.types)], schema=schema)
        held, size, seq, first = [], 0, 0, 0
        end = np.array([EOD], np.uint16)
        for batch in batches:
            for part in pieces(batch):
                ids, texts = part.column(0).to_pylist(), part.column(1).to_pylist()
                yield row(None, None, first, ids)
                first += len(ids)
                for text in texts:
                    for x in safe_parts(text):
                        held.append(np.array(encoded(enc, ranks, x), np.uint16))
                        size += len(held[-1])
                    held.append(end)
                    size += 1
                    if size >= block_tokens:
                        flat = np.concatenate(held)
                        for at in range(0, size - size % block_tokens, block_tokens):
                            yield row(seq, flat[at:at + block_tokens].tobytes(), None, None)
                            seq += 1
                        held = [flat[size - size % block_tokens:]]
                        size = len(held[0])
        if size:
            yield row(seq, np.concatenate(held).tobytes(), None, None)
        held = batch = part = texts = enc = ranks = None
        tidy()

    return docs.select(F.col(id_col).cast("bigint"), text_of(text_col)).mapInArrow(run, _OUT)


def scan_blocks(blocks: DataFrame, eod: int = EOD) -> DataFrame:
    """(file, ordinal, n_tokens) of every document that a separator closes, from rows (file, seq, data)."""

    def scan(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                flat = np.frombuffer(batch.column(2)[i].as_buffer(), "<u2")
                at = np.flatnonzero(flat == eod)
                yield pa.record_batch([batch.column(0).slice(i, 1), batch.column(1).slice(i, 1), pa.array([len(flat)], pa.int64()),
                                       pa.array([at.tolist()], pa.list_(pa.int64()))], names=["file", "seq", "n", "at"])

    found = blocks.select("file", "seq", "data").mapInArrow(scan, "file int, seq bigint, n bigint, at array<bigint>")
    before = Window.partitionBy("file").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    found = found.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0)))
    found = found.withColumn("last", F.when(F.size("at") > 0, F.col("base") + F.expr("try_element_at(at, -1)")))
    found = found.select("file", "at", "base", F.coalesce(F.max("last").over(before), F.lit(-1)).alias("prior"),
                         F.coalesce(F.sum(F.size("at")).over(before), F.lit(0)).alias("ordinal"))
    ends = found.where(F.size("at") > 0).select("file", "at", "base", "prior", "ordinal", F.posexplode("at").alias("k", "end"))
    return ends.select("file", (F.col("ordinal") + F.col("k")).alias("ordinal"),
                       F.when(F.col("k") == 0, F.col("base") + F.col("end") - F.col("prior") - 1)
                       .otherwise(F.col("end") - F.expr("try_element_at(at, k)") - 1).alias("n_tokens"))


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = TOKENIZER,
                 block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    flat = staged(write_token_blocks(docs, id_col, text_col, tokenizer, block_tokens))
    counts = scan_blocks(flat.where("data is not null"))
    order = flat.where("ids is not null").select("file", "first", F.posexplode("ids").alias("k", id_col))
    order = order.select("file", (F.col("first") + F.col("k")).alias("ordinal"), id_col)
    return order.join(counts, ["file", "ordinal"]).select(id_col, F.col("n_tokens").cast("bigint"))
