"""WARC archives: writing with segmentation and revisits, reading with segment reassembly.

``write_warc`` puts a record for each row into gzip archives in a shared folder.  A payload travels as an HTTP response in
chunked transfer framing; a block longer than ``SEGMENT_BYTES`` is cut into a first record and continuation records that name
it as their origin.  Of equal payloads of at least ``REVISIT_BYTES`` the one with the smallest page id is a response and the
others are revisits of it.  Only digests and ids are compared for that; payloads move only where repeats exceed the broadcast bound.

``read_warc`` streams the archives, one task for each file, and decodes whole records on the way.  Segments are grouped by
origin identifier and sorted by segment number, and a streaming decoder runs over them: it holds one segment, never a payload.
The numbering, the stated total length, the framing and the stated digest are verified.

Defined cases: null html is the empty payload; a null url gives a record without target; line breaks in a url are percent-encoded;
a null page id is kept and is never the smallest (a group of null ids only is all response); rows repeated under the smallest
id are all responses; records repeated in the archives (same identifier, same segment) count once for the payload and once
each as rows; other columns are ignored; an empty table gives an empty archive and no rows.  A record that fails verification
stays, with null payload facts and the reason in ``status``; a continuation whose first record is in no archive gives no row.
"""
from __future__ import annotations

import hashlib
import uuid
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.llm.common import pieces, staged, text_of
from helixframe.session import checkpoint_dir

CHUNK_BYTES = 4096
SEGMENT_BYTES = 16384
REVISIT_BYTES = 100
BROADCAST_ROWS = 200_000
WRITTEN = "2026-01-01T00:00:00Z"  # WARC-Date: a parameter, so that a repeated task writes the same bytes
CRLF = "\r\n"
HTTP_HEAD = f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Transfer-Encoding: chunked{CRLF}{CRLF}"
# Fixed value: the profile name of the format for revisits of an identical payload.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _bytes_as_text(b: Column) -> Column:
    return b.cast("string")


def _field(name: str, value: Column) -> Column:
    """A header line, empty where the value is null."""
    return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit(CRLF)), F.lit(""))


def _urn(*parts: Column) -> Column:
    """``<urn:uuid:...>`` from the digest of the parts (version and variant digits set), so that repeated tasks agree."""
    h = F.md5(F.concat_ws("|", *parts))
    cut = lambda a, n: F.substring(h, a, n)
    return F.concat(F.lit("<urn:uuid:"), cut(1, 8), F.lit("-"), cut(9, 4), F.lit("-4"), cut(14, 3), F.lit("-8"), cut(18, 3), F.lit("-"), cut(21, 12), F.lit(">"))


def _pieces_of(b: Column, n: Column, size: int) -> Column:
    """Array of binaries of ``size`` bytes at most."""
    starts = F.when(n > 0, F.sequence(F.lit(0), ((n - 1) / size).cast("int"))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.substring(b, i * size + 1, F.lit(size)))


def _chunked(b: Column, n: Column, chunk: int) -> Column:
    """``b`` in chunked transfer framing, as text that holds the raw bytes."""
    framed = F.transform(_pieces_of(b, n, chunk), lambda c: F.concat(F.lower(F.hex(F.octet_length(c))), F.lit(CRLF), _bytes_as_text(c), F.lit(CRLF)))
    return F.concat(F.array_join(framed, ""), F.lit(f"0{CRLF}{CRLF}"))


def first_of_equal(pages: DataFrame) -> DataFrame:
    """(digest, first_id) of payloads that several rows share and that are long enough for a revisit."""
    keys = pages.where(F.col("n") >= REVISIT_BYTES).groupBy("digest").agg(F.count(F.lit(1)).alias("m"), F.min("page_id").alias("first_id"))
    return keys.where("m > 1 and first_id is not null").select("digest", "first_id")


def warc_records(pages: DataFrame, id_col: str = "page_id", url: str = "url", html: str = "html", chunk: int = CHUNK_BYTES,
                 segment: int = SEGMENT_BYTES, written: str = WRITTEN, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """One column ``value``: each row a record (its header and block, without the two closing line breaks)."""
    p = pages.select(F.col(id_col).cast("bigint").alias("page_id"), F.col(url).alias("url"), F.encode(text_of(html), "UTF-8").alias("b"))
    p = p.select("*", F.octet_length("b").alias("n"), F.sha2("b", 256).alias("digest"))
    shared = staged(first_of_equal(p))
    if shared.count() <= broadcast_rows:
        shared = F.broadcast(shared)
    p = p.join(shared, "digest", "left")
    p = p.withColumn("revisit", F.coalesce(F.col("first_id") != F.coalesce("page_id", F.col("first_id") - 1), F.lit(False)))
    http = F.when(F.col("revisit"), F.lit(HTTP_HEAD)).otherwise(F.concat(F.lit(HTTP_HEAD), _chunked(F.col("b"), F.col("n"), chunk)))
    own = _urn(F.coalesce(F.col("page_id").cast("string"), F.lit("none")), "digest")
    p = p.select("page_id", "digest", "revisit", F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A").alias("url"), own.alias("rid"),
                 F.when(F.col("revisit"), _urn(F.col("first_id").cast("string"), "digest")).alias("refers"), http.cast("binary").alias("block"))
    p = p.withColumn("size", F.octet_length("block"))
    s = p.select("*", F.posexplode(_pieces_of(F.col("block"), F.col("size"), segment)).alias("k", "part")).drop("block")
    more, segmented, last = F.col("k") > 0, F.col("size") > segment, (F.col("k") + 1) * segment >= F.col("size")
    head = F.concat(
        F.lit(f"WARC/1.1{CRLF}WARC-Type: "), F.when(more, "continuation").when(F.col("revisit"), "revisit").otherwise("response"), F.lit(CRLF),
        _field("WARC-Record-ID", F.when(more, _urn("rid", F.col("k").cast("string"))).otherwise(F.col("rid"))), F.lit(f"WARC-Date: {written}{CRLF}"),
        _field("WARC-Target-URI", F.col("url")), _field("X-Page-ID", F.when(~more, F.col("page_id").cast("string"))),
        _field("WARC-Payload-Digest", F.when(~more, F.concat(F.lit("sha256:"), "digest"))),
        _field("WARC-Profile", F.when(F.col("revisit"), F.lit(PROFILE))), _field("WARC-Refers-To", F.col("refers")),
        _field("WARC-Segment-Origin-ID", F.when(more, F.col("rid"))), _field("WARC-Segment-Number", F.when(segmented, (F.col("k") + 1).cast("string"))),
        _field("WARC-Segment-Total-Length", F.when(segmented & last, F.col("size").cast("string"))),
        _field("Content-Type", F.when(~more, F.lit("application/http; msgtype=response"))), _field("Content-Length", F.octet_length("part").cast("string")), F.lit(CRLF))
    return s.select(F.concat(head, _bytes_as_text(F.col("part"))).alias("value"))


def write_warc(pages: DataFrame, path: str, **options) -> None:
    """Writes gzip archives to ``path``, one for each input partition; files appear when the job commits."""
    (warc_records(pages, **options).write.option("lineSep", CRLF * 2).option("compression", "gzip").option("zlib.compress.level", "BEST_SPEED").text(path))


class _Payload:
    """Streaming decoder of an HTTP response block: ``feed`` bytes, then ``close``."""

    def __init__(self, http: bool, keep: bool):
        self.mode, self.held, self.need, self.n, self.sha, self.total = "head" if http else "plain", b"", 0, 0, hashlib.sha256(), 0
        self.kept = [] if keep else None

    def _take(self, data: bytes) -> None:
        self.n += len(data)
        self.sha.update(data)
        if self.kept is not None:
            self.kept.append(bytes(data))

    def _line(self, data: bytes, at: int):
        """The line that starts at ``at`` and where the next begins, or None if it isn't complete."""
        end = data.find(b"\r\n", at)
        return None if end < 0 else (data[at:end], end + 2)

    def feed(self, data: bytes) -> None:
        self.total += len(data)
        data, at, self.held = self.held + data, 0, b""
        while at < len(data):
            if self.mode == "head":
                end = data.find(b"\r\n\r\n", at)
                if end < 0:
                    break
                fields = data[at:end].lower().split(b"\r\n")
                self.mode = "size" if any(f.replace(b" ", b"") == b"transfer-encoding:chunked" for f in fields) else "plain"
                at = end + 4
            elif self.mode == "plain":
                self._take(data[at:])
                at = len(data)
            elif self.mode == "data":
                part = data[at:at + self.need]
                self._take(part)
                at, self.need = at + len(part), self.need - len(part)
                if not self.need:
                    self.mode = "gap"
            elif self.mode in ("size", "gap", "trailer"):
                found = self._line(data, at)
                if found is None:
                    break
                line, at = found
                if self.mode == "gap":
                    self.mode = "bad" if line else "size"
                elif self.mode == "trailer":
                    self.mode = "trailer" if line else "end"
                else:
                    digits = line.split(b";")[0].strip()
                    ok = digits and not digits.strip(b"0123456789abcdefABCDEF")
                    self.need = int(digits, 16) if ok else 0
                    self.mode = "bad" if not ok else "data" if self.need else "trailer"
            else:  # bytes behind the last chunk, or after a fault
                self.mode, at = "bad", len(data)
        self.held = data[at:]

    def close(self, declared: str | None, fault: str | None = None):
        """(n_bytes, digest, status, payload) with nulls where verification fails."""
        if not fault and self.mode not in ("plain", "end"):
            fault = "bad framing"
        digest = self.sha.hexdigest()
        if not fault and declared and declared.lower().startswith("sha256:") and declared[7:].lower() != digest:
            fault = "digest mismatch"
        if fault:
            return None, None, fault, None
        return self.n, digest, "ok", None if self.kept is None else b"".join(self.kept)


_FACTS = [("n_bytes", pa.int64()), ("digest", pa.string()), ("status", pa.string()), ("payload", pa.binary())]
_RECORD = pa.schema([("kind", pa.string()), ("record_id", pa.string()), ("page_id", pa.int64()), ("target_uri", pa.string()), ("refers_to", pa.string()),
                     ("origin", pa.string()), ("segment", pa.int64()), ("total", pa.int64()), ("http", pa.bool_()), ("declared", pa.string()), ("block", pa.binary()), *_FACTS])
_RECORD_SQL = ("kind string, record_id string, page_id bigint, target_uri string, refers_to string, origin string, segment bigint, total bigint, http boolean, "
               "declared string, block binary, n_bytes bigint, digest string, status string, payload binary")
_FACTS_SQL = "origin string, n_bytes bigint, digest string, status string, payload binary"


def _number(fields: dict, name: str):
    v = fields.get(name, "")
    return int(v) if v.isascii() and v.lstrip("-").isdigit() else None


def _record(fields: dict, block: bytes, short: bool, keep: bool) -> dict:
    """A row for a parsed record: whole responses are decoded here, segments keep their block."""
    kind, segment = fields.get("warc-type"), _number(fields, "warc-segment-number")
    row = dict.fromkeys(_RECORD.names)
    row.update(kind=kind, record_id=fields.get("warc-record-id"), page_id=_number(fields, "x-page-id"), target_uri=fields.get("warc-target-uri"),
               refers_to=fields.get("warc-refers-to"), origin=fields.get("warc-segment-origin-id") or fields.get("warc-record-id"), segment=segment,
               total=_number(fields, "warc-segment-total-length"), http=fields.get("content-type", "").lower().startswith("application/http"),
               declared=fields.get("warc-payload-digest"))
    if short:
        row["status"] = "bad length"
    elif segment is not None or kind == "continuation":
        row["block"] = block
    elif kind != "revisit":
        d = _Payload(row["http"], keep)
        d.feed(block)
        row["n_bytes"], row["digest"], row["status"], row["payload"] = d.close(row["declared"])
    return row


def _parse(keep: bool):
    """Function over batches (line, file, split start) of archive lines: yields batches of records."""

    def run(batches):
        rows, held = [], 0
        fields, need, parts, file = None, None, [], None  # between records / in a header (need is None) / in a block

        def done(short: bool):
            nonlocal fields, need, parts, held
            if fields is not None:
                block = b"".join(parts)
                rows.append(_record(fields, block, short, keep))
                held += len(block) if rows[-1]["block"] is not None or keep else 0
            fields, need, parts = None, None, []

        for batch in batches:
            for part in pieces(batch, 4096):
                for line, f, start in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(2).to_pylist()):
                    if f != file:
                        done(True)  # a file that ends inside a record
                        file = f
                        if start:
                            raise ValueError("an archive was split: only gzip archives, which Spark reads in one piece, can be longer than spark.sql.files.maxPartitionBytes")
                    if fields is None:
                        if line.startswith(b"WARC/1."):
                            fields = {}
                        continue
                    if need is None:
                        if line:
                            name, _, value = line.partition(b":")
                            fields[name.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
                            continue
                        need = _number(fields, "content-length")
                        if need is None or need < 0:
                            done(True)
                        elif not need:
                            done(False)
                        continue
                    if len(line) > need:  # the block is longer than it says
                        parts.append(line[:need])
                        done(True)
                        continue
                    parts.append(line)
                    need -= len(line)
                    if need:
                        parts.append(b"\r\n"[:need])
                        need -= len(parts[-1])
                    if not need:
                        done(False)
                if len(rows) >= 512 or held > 4 << 20:
                    yield pa.RecordBatch.from_pylist(rows, schema=_RECORD)
                    rows, held = [], 0
        done(True)
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=_RECORD)

    return run


def warc_lines(spark: SparkSession, path: str) -> DataFrame:
    lines = spark.read.option("lineSep", CRLF).text(path)
    return lines.select(F.col("value").cast("binary").alias("line"), F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))


def _assemble(keep: bool):
    """Function over segments sorted by (origin, segment): one row of payload facts for each origin."""

    def run(batches):
        names = ["origin", "segment", "total", "http", "declared", "block"]

        def rows():
            for batch in batches:
                for i in range(batch.num_rows):  # one segment at a time
                    yield [batch.column(c)[i].as_py() for c in names]

        for origin, group in groupby(rows(), key=lambda r: r[0]):
            d, fault, last, total, declared = None, None, 0, None, None
            for _, segment, t, http, said, block in group:
                if d is None:
                    d, declared = _Payload(bool(http), keep), said
                if segment is None or segment != last + 1:
                    fault = fault or ("repeated segment" if segment == last else "missing segment")
                last, total = segment or last, t if t is not None else total
                d.feed(block)
            if not fault:
                fault = "missing segment" if total is None else "length mismatch" if total != d.total else None
            yield pa.RecordBatch.from_pylist([dict(zip(("origin", "n_bytes", "digest", "status", "payload"), (origin, *d.close(declared, fault))))],
                                             schema=pa.schema([("origin", pa.string()), *_FACTS]))

    return run


def segment_payloads(records: DataFrame, keep: bool = False) -> DataFrame:
    """(origin, n_bytes, digest, status, payload): segments grouped by origin and put in order by number; repeated records count once."""
    s = records.where("block is not null").select("origin", "segment", "total", "http", "declared", "block", F.sha2("block", 256).alias("same"))
    s = s.groupBy("origin", "segment", "same").agg(*[F.first(c).alias(c) for c in ("total", "http", "declared", "block")])
    s = s.select("origin", "segment", "total", "http", "declared", "block")
    return s.repartition("origin").sortWithinPartitions("origin", "segment").mapInArrow(_assemble(keep), _FACTS_SQL)


def read_warc(spark: SparkSession, path: str, with_payload: bool = False) -> DataFrame:
    """One row for each response, revisit or other first record: page_id, target_uri, record_id, record_type, refers_to (the page id of the
    response that a revisit names), n_bytes, digest and status of the full payload (that of the named response for a revisit), and the payload itself
    ``with_payload``.  Records of all archives below ``path`` are read; a continuation may lie in another archive than its origin."""
    records = staged(warc_lines(spark, path).mapInArrow(_parse(with_payload), _RECORD_SQL))
    facts = ["n_bytes", "digest", "status", "payload"]
    heads = records.where("coalesce(kind, '') <> 'continuation'").select(
        "page_id", "target_uri", "record_id", F.col("kind").alias("record_type"), "refers_to", "segment", *facts)
    whole = heads.where("status is not null").withColumn("refers", F.lit(None).cast("bigint"))
    rest = heads.where("status is null").drop(*facts).withColumn("key", F.when(F.col("record_type") == "revisit", F.col("refers_to")).otherwise(F.col("record_id")))
    # ids are compared as text; a record without an id finds nothing and keeps its row
    segments = staged(segment_payloads(records, with_payload))
    named = heads.where("record_type <> 'revisit'").select(F.col("record_id").alias("key"), F.col("page_id").alias("refers"), *facts)
    named = named.where("status is not null").unionAll(named.drop(*facts).join(segments.withColumnRenamed("origin", "key"), "key").select(*named.columns))
    named = named.dropDuplicates(["key"])
    rest = rest.join(named, "key", "left").withColumn("status", F.coalesce("status", F.lit("origin not found")))
    cols = ["page_id", "target_uri", "record_id", "record_type", *facts]
    both = whole.select(*cols, "refers").unionAll(rest.select(*cols, F.when(F.col("record_type") == "revisit", F.col("refers")).alias("refers")))
    return both.select("page_id", "target_uri", "record_id", "record_type", F.col("refers").alias("refers_to"), "n_bytes", "digest", "status", *(["payload"] if with_payload else []))


def archive_folder(spark: SparkSession) -> str:
    return f"{checkpoint_dir(spark).rstrip('/')}/warc-{uuid.uuid4().hex}"


def query(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """Contract columns for the whole table, read back from the archives."""
    path = archive_folder(spark)
    write_warc(pages, path)
    r = read_warc(spark, path)
    return r.select("page_id", F.col("n_bytes").alias("payload_bytes"), F.col("digest").alias("payload_digest"), "record_type", "refers_to")


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
f AS (SELECT page_id, strlen(h) AS payload_bytes, sha256(h) AS payload_digest, min(page_id) OVER (PARTITION BY h) AS first_id FROM p)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 100 AND first_id IS DISTINCT FROM page_id AND first_id IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND first_id IS DISTINCT FROM page_id AND first_id IS NOT NULL THEN first_id END AS refers_to
FROM f
"""
