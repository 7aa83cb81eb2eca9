"""Selection of the head against a plain sort."""
import hashlib

import pytest

from helixframe.operators import shape as SH


def _want(ids, seed, frac):
    key = lambda i: (hashlib.md5(f"{seed}:{i}".encode()).hexdigest(), i)
    return sorted(sorted(ids, key=key)[:int(frac * len(ids))])


@pytest.mark.parametrize("frac", [0.0, 0.001, 0.1, 0.5, 0.999, 1.0])
@pytest.mark.parametrize("few", [1, 10_000])  # 1: refined to the end
def test_head_equals_sorting(spark, frac, few):
    df = spark.range(3000, numPartitions=5).selectExpr("id", "id * 2 AS v")
    got = SH.seeded_head(df, "id", 7, frac, few)
    assert got.columns == ["id", "v"]
    assert sorted(r["id"] for r in got.collect()) == _want(range(3000), 7, frac)


def test_repeated_ids_and_empty_table(spark):
    ids = [1] * 500 + list(range(2, 302))
    df = spark.createDataFrame([(i,) for i in ids], "id long").repartition(4)
    for frac in (0.1, 0.3, 0.8):
        assert sorted(r["id"] for r in SH.seeded_head(df, "id", 3, frac, few=5).collect()) == _want(ids, 3, frac)
    assert SH.seeded_head(df.limit(0), "id", 3, 0.5).count() == 0


def test_only_the_crossing_bin_is_indexed(spark, monkeypatch):
    seen = []
    real = SH.dense_index
    monkeypatch.setattr(SH, "dense_index", lambda d, *a, **k: seen.append(d.count()) or real(d, *a, **k))
    assert SH.seeded_head(spark.range(5000), "id", 1, 0.4, few=10).count() == 2000
    assert len(seen) <= 1 and all(n <= 10 for n in seen)
