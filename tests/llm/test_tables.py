"""Vectors, URLs and the pipeline."""
import math

import numpy as np
import pytest

import corpus_pipeline
from helixframe.llm import op7_embeddings, op8_urls
from helixframe.llm.common import components
from helixframe.llm.queries import LLM_QUERIES


def plain_links(rows, threshold=0.98):
    ok = [r for r in rows if r[0] is not None and r[2] is not None and r[1] and all(x is not None and math.isfinite(x) for x in r[1]) and any(r[1])]
    unit = {id(r): np.array(r[1], float) / np.linalg.norm(r[1]) for r in ok}
    root, n = {r[0]: r[0] for r in rows}, {r[0]: 0 for r in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(ok):
        for b in ok[:i]:
            if a[2] == b[2] and len(a[1]) == len(b[1]) and unit[id(a)] @ unit[id(b)] >= threshold:
                n[a[0]] += 1
                n[b[0]] += 1
                x, y = find(a[0]), find(b[0])
                root[max(x, y)] = min(x, y)
    return {k: (n[k], find(k)) for k in root}


@pytest.mark.parametrize("block", [512, 4])
def test_vectors_equal_brute_force(spark, block):
    rng = np.random.default_rng(5)
    rows = []
    for g in range(6):
        base = rng.standard_normal(64)
        for c in range(9):
            rows.append((len(rows), [float(np.float32(x)) for x in base + rng.standard_normal(64) * (0.0 if c < 3 else 0.1)], g % 2))
    k = len(rows)
    rows += [(k, None, 1), (k + 1, [0.0] * 64, 1), (k + 2, [float("nan")] + [1.0] * 63, 1), (k + 3, [None] + [1.0] * 63, 1), (k + 4, rows[0][1], None), (k + 5, [], 1),
             (k + 6, rows[0][1][:10], 0), (k + 7, [float("inf")] * 64, 0), (k + 8, [0.5 * x for x in rows[0][1]], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").selectExpr("*", "1 AS rep", "2 AS v", "'b' AS bucket", "3 AS n")
    out = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in op7_embeddings.near_vectors(df.repartition(5), block=block).collect()}
    assert out == plain_links(rows)


def test_vector_edges(spark):
    rows = [(1, [1.0, 0.0], 0), (1, [1.0, 0.0], 0), (None, [1.0, 0.0], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    assert sorted(str(tuple(r)) for r in op7_embeddings.near_vectors(df).collect()) == sorted(["(1, 1, 1, True)", "(1, 1, 1, True)", "(None, 0, None, False)"])
    assert op7_embeddings.near_vectors(df.limit(0)).count() == 0


def test_estimate_is_unbiased_and_bounded():
    rng = np.random.default_rng(1)
    x, y = rng.standard_normal((2, 400, 64))
    y = x + 0.3 * y
    x, y = (v / np.linalg.norm(v, axis=1, keepdims=True) for v in (x, y))
    r = op7_embeddings.rotation(64, 0)
    assert np.allclose(r @ r.T, np.eye(64))
    code, f = np.sign(x @ r.T), np.abs(x @ r.T).sum(1) / 8
    est = (code * (y @ r.T)).sum(1) / (8 * f)
    error = est - (x * y).sum(1)
    sigma = np.sqrt((1 - f ** 2) / f ** 2 / 63)
    assert abs(error.mean()) < 0.01 and (np.abs(error) < op7_embeddings.SIGMAS * sigma).all()


URLS = [("http://a.example.org/es/x", "example.org/es/", "block"), ("https://example.org/en/12#q", "example.org/en/1", "block"), ("https://x.org", None, "allow"),
        ("ftp://x.org/", "org/", "allow"), ("http://EXAMPLE.com/fr/?a", "com/fr/", "allow"), ("http://notexample.org/es/", "org/", "allow"), ("http://a.com/de/1/", "com/de/", "block"),
        ("a.com/de/1", None, "allow"), (None, None, "allow"), ("http://www.spam-farm.net/p.html?x=1", None, "block"), ("https://spam-farm.net/p/", None, "block"), ("http://fine.net/p", None, "allow"),
        ("http://spam-farm.org/a", "org/", "allow"), ("x://y?://z.org/", None, "allow")]


def test_urls(spark):
    df = spark.createDataFrame([(i, u) for i, (u, _, _) in enumerate(URLS)], "page_id long, url string").selectExpr("*", "'q' AS host", "'p' AS canon", "1 AS block")
    out = {r["page_id"]: r for r in op8_urls.query(spark, df).collect()}
    for i, (u, rule, verdict) in enumerate(URLS):
        assert (u, out[i]["rule"], out[i]["verdict"]) == (u, rule, verdict)
    assert (out[1]["host"], out[1]["path"]) == ("example.org", "/en/12") and (out[7]["host"], out[7]["path"]) == ("", "")
    assert op8_urls.query(spark, df.limit(0)).count() == 0


def test_bloom_filter_over_the_broadcast_bound(spark, monkeypatch):
    monkeypatch.setattr(op8_urls, "BROADCAST_BYTES", 0)
    pages = spark.range(500).selectExpr("id AS page_id", "concat('h', id, '.net/p') AS canon", "concat('h', id, '.net') AS host", "'/p' AS path")
    out = op8_urls.filter_urls(pages, pages.where("page_id % 7 = 0").select("canon"))
    assert out.where("listed").count() == 72 and out.where("listed <> (page_id % 7 = 0)").count() == 0 and out.count() == 500


def test_components(spark):
    rng = np.random.default_rng(2)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 120, (90, 2))] + [(i, i + 1) for i in range(200, 260)] + [(300, i) for i in range(301, 360)]
    root = {x: x for p in pairs for x in p}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {x: find(x) for x in root if any(a != b and x in (a, b) for a, b in pairs)}


def test_queries_are_registered():
    import __spark_entry__ as E
    for n in range(1, 11):
        assert sum(name.startswith(f"op{n}_") for name in E.queries()) == 1
    assert "pipeline" in E.queries() and set(LLM_QUERIES) <= set(E.queries())


def test_pipeline(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert 4 <= len(corpus_pipeline.STAGES) <= 5
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        from helixframe.llm.common import staged
        out = staged(stage(spark, kept, sf))
        assert out.columns == docs.columns, name
        assert 0 < out.count() <= kept.count(), name
        kept = out
    last = corpus_pipeline.STAGES[-1][1](spark, kept, sf)
    assert last.count() == kept.count() and last.where("not round_trip").count() == 0
    run = corpus_pipeline.run(spark, sf)
    assert sorted(r["doc_id"] for r in run.select("doc_id").collect()) == sorted(r["doc_id"] for r in kept.select("doc_id").collect())
    assert corpus_pipeline.STAGES[0][1](spark, docs.limit(0), sf).columns == docs.columns
