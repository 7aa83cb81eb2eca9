"""WARC archives: brute force over awkward payloads, and archives of other makers."""
import hashlib

import pytest

from helixframe.llm import op13_warc as W

LURE = "WARC/1.1\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"  # a payload that looks like records
ROWS = [(1, "http://a/\r\nx", "x" * 50), (2, None, "x" * 50), (3, "u", "é\r\r\n" * 60), (4, "u", "é\r\r\n" * 60), (None, "u", "é\r\r\n" * 60), (5, "u", None), (5, "u", ""),
        (6, "u", LURE * 9000), (7, "u", LURE * 9000), (3, "u", "é\r\r\n" * 60), (None, None, "ü" * 40000), (None, None, "ü" * 40000), (8, "a", "\r" * 20000 + "\n" * 5),
        (9, "a", "😀" * 30000), (10, "", "y" * 100), (11, "", "y" * 100), (12, "", "z" * 99), (13, "", "z" * 99), (14, "", " " * 1_000_000), (15, "", "\n" * 1_000_000)]


def plain(rows):
    first = {}
    for i, _, h in rows:
        if i is not None and len((h or "").encode()) >= 100:
            first[h] = min(i, first.get(h, i))
    out = []
    for i, _, h in rows:
        b = (h or "").encode()
        to = first.get(h or "")
        again = to is not None and to != i
        out.append((i, len(b), hashlib.sha256(b).hexdigest(), "revisit" if again else "response", to if again else None))
    return sorted(out, key=str)


@pytest.fixture
def pages(spark):
    df = spark.createDataFrame(ROWS, "page_id long, url string, html string")
    return df.selectExpr("*", "1 AS n", "2 AS digest", "'x' AS b", "'y' AS block", "3 AS size", "4 AS k", "5 AS first_id")


@pytest.mark.parametrize("parts,bound", [(1, 100), (7, 0)])  # with and without a broadcast of the shared digests
def test_equals_brute_force(spark, pages, parts, bound):
    path = W.archive_folder(spark)
    W.write_warc(pages.repartition(parts), path, broadcast_rows=bound)
    got = W.read_warc(spark, path, with_payload=True).collect()
    assert {r["status"] for r in got} == {"ok"}
    assert all(hashlib.sha256(r["payload"]).hexdigest() == r["digest"] for r in got)
    assert sorted([(r["page_id"], r["n_bytes"], r["digest"], r["record_type"], r["refers_to"]) for r in got], key=str) == plain(ROWS)


def test_query_and_empty_table(spark, pages):
    got = W.query(spark, pages)
    assert got.columns == ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    assert sorted([tuple(r) for r in got.collect()], key=str) == plain(ROWS)
    assert W.query(spark, pages.limit(0)).count() == 0


def test_sizes_of_chunks_and_segments(spark, pages):
    """One byte a chunk or a segment: every boundary falls inside characters and line breaks."""
    path = W.archive_folder(spark)
    few = pages.where("page_id in (1, 3, 4, 5, 10)")
    W.write_warc(few, path, chunk=1, segment=3)
    got = W.read_warc(spark, path).collect()
    want = plain([r for r in ROWS if r[0] in (1, 3, 4, 5, 10)])
    assert sorted([(r["page_id"], r["n_bytes"], r["digest"], r["record_type"], r["refers_to"]) for r in got], key=str) == want


def _record(kind, rid, block, **fields):
    head = f"WARC/1.0\r\nwarc-type: {kind}\r\nWARC-Record-ID: <{rid}>\r\n" + "".join(f"{k.replace('_', '-')}: {v}\r\n" for k, v in fields.items())
    return head + f"Content-Length: {len(block.encode())}\r\n\r\n" + block


HTTP = "HTTP/1.1 200 OK\r\ntransfer-encoding:  Chunked\r\n\r\n"


def test_faults_are_told(spark):
    """Archives of another maker: a lost segment, a wrong total, repeated records, broken framing, wrong lengths and digests."""
    def segments(rid, block, numbers, total, cut=10):
        cuts = [block[i:i + cut] for i in range(0, len(block), cut)]
        out = []
        for k in numbers:
            extra = {"WARC_Segment_Number": k + 1}
            if k + 1 == len(cuts):
                extra["WARC_Segment_Total_Length"] = total
            if k:
                out.append(_record("continuation", f"{rid}-{k}", cuts[k], WARC_Segment_Origin_ID=f"<{rid}>", **extra))
            else:
                out.append(_record("response", rid, cuts[k], Content_Type="application/http", **extra))
        return out

    body = HTTP + "5;x=1\r\nhello\r\n6\r\n world\r\n0\r\nTrailer: 1\r\n\r\n"
    n = len(range(0, len(body), 10))
    records = [_record("warcinfo", "i", "software: x\r\n", Content_Type="application/warc-fields"), *segments("good", body, [*range(n), 2], len(body)),
               *segments("mixed", body, list(range(n))[::-1], len(body)), *segments("lost", body, [k for k in range(n) if k != 1], len(body)), *segments("long", body, range(n), 999),
               _record("response", "frame", HTTP + "zz\r\nhello\r\n0\r\n\r\n", Content_Type="application/http"), _record("response", "open", HTTP + "5\r\nhello\r\n", Content_Type="application/http"),
               _record("response", "plain", "HTTP/1.0 200 OK\r\n\r\nhello world", Content_Type="application/http", WARC_Payload_Digest="sha256:" + "0" * 64),
               _record("resource", "raw", "hello world"), _record("revisit", "again", HTTP, WARC_Refers_To="<good>"), _record("revisit", "blind", HTTP, WARC_Refers_To="<none>"),
               _record("response", "short", "abc").replace("Content-Length: 3", "Content-Length: 2")]
    path = W.archive_folder(spark)
    spark.createDataFrame([(r,) for r in records], "value string").coalesce(1).write.option("lineSep", "\r\n\r\n").option("compression", "gzip").text(path)
    got = {r["record_id"].strip("<>"): (r["n_bytes"], r["status"]) for r in W.read_warc(spark, path).collect()}
    hello = (11, "ok")
    assert got == {"i": (13, "ok"), "good": hello, "mixed": hello, "lost": (None, "missing segment"), "long": (None, "length mismatch"), "frame": (None, "bad framing"),
                   "open": (None, "bad framing"), "plain": (None, "digest mismatch"), "raw": hello, "again": hello, "blind": (None, "origin not found"), "short": (None, "bad length")}
