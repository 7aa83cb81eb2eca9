import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from helixframe.operators import contrastive as C


def _batches(spark, Z1, Z2, Z3=None):
    rows = []
    for i in range(len(Z1)):
        r = (0, i, Z1[i].tolist(), Z2[i].tolist())
        rows.append(r + ((Z3[i].tolist(),) if Z3 is not None else ()))
    schema = "batch long, pos int, z1 array<double>, z2 array<double>" + (
        ", z3 array<double>" if Z3 is not None else "")
    return spark.createDataFrame(rows, schema)


def _cos(a, b):
    return a @ b / (max(np.linalg.norm(a), 1e-8) * max(np.linalg.norm(b), 1e-8))


def test_loss_by_hand_n2(spark):
    rng = np.random.default_rng(0)
    Z1, Z2, Z3 = rng.normal(size=(2, 3)), rng.normal(size=(2, 3)), rng.normal(size=(2, 3))
    t, lam, m, w = 0.05, 0.2, 0.1, 0.5
    lg = C.logits(_batches(spark, Z1, Z2, Z3), t, lam, m, w, num_sent=3)
    got = C.batch_losses(lg).collect()[0]["loss"]
    N = 2
    losses = []
    for i in range(N):
        row = []
        for j in range(N):
            row.append(_cos(Z1[i], Z2[j]) / t - (m / t if i == j else 0))
        for j in range(N):
            row.append(_cos(Z1[i], Z3[j]) / t + (w if i == j else 0))
        for j in range(N):
            n_j = lam * Z2[j] + (1 - lam) * Z2[(j + 1) % N]
            v = 0.0 if j == (i - 1) % N else _cos(Z1[i], n_j) / t
            row.append(v + (w if i == j else 0))
        for j in range(N):
            a_i = lam * Z1[i] + (1 - lam) * Z1[(i + 1) % N]
            v = 0.0 if j == (i + 1) % N else _cos(a_i, Z2[j]) / t
            row.append(v + (w if i == j else 0))
        losses.append(math.log(sum(math.exp(x) for x in row)) - row[i])
    assert got == pytest.approx(np.mean(losses))


def test_batch_of_one_masked_cell_is_weight(spark):
    Z = np.array([[1.0, 2.0, 0.5]])
    lg = C.logits(_batches(spark, Z, Z), 0.05, 0.2, 0.0, 0.7, num_sent=2)
    vals = {r["block"]: r["logit"] for r in lg.collect()}
    assert vals["B"] == pytest.approx(0.7) and vals["D"] == pytest.approx(0.7)


def test_hashed_embedding_sums_before_the_shuffle(spark):
    from helixframe.operators import pooling as PO
    df = spark.createDataFrame([(1, ["a", "b", "a"]), (1, ["c"]), (2, []), (3, None), (None, ["a"])], "k long, tokens array<string>")
    e = PO.hashed_embedding(df, "k", "tokens", 8, 5)
    got = sorted(((r["k"], [round(v, 9) for v in r["embedding"]]) for r in e.collect()), key=str)
    one = {t: PO.hashed_embedding(spark.createDataFrame([(1, [t])], "k long, tokens array<string>"), "k", "tokens", 8, 5).collect()[0]["embedding"] for t in "abc"}
    whole = [2 * one["a"][i] + one["b"][i] + one["c"][i] for i in range(8)]
    size = max(sum(v * v for v in whole) ** 0.5, 1e-12)
    zero = [0.0] * 8
    assert got == sorted([(1, [round(v / size, 9) for v in whole])] * 2 + [(2, zero), (3, zero), (None, zero)], key=str)
    assert e._jdf.queryExecution().optimizedPlan().toString().count("Aggregate [") == 1


def test_masked_lm_loss_of_extreme_logits(spark):
    """Logits far apart and far from 0, infinite and missing ones, against a plain logsumexp; the sums of a position meet before the shuffle."""
    import math
    from helixframe.operators import contrastive as C
    inf = math.inf
    cases = [[0.5, -0.25, 1.0], [900.0, 100.0, 899.0], [-5000.0, -5001.0, -4999.5], [128.0, 127.9, 384.1], [-inf, 2.0, 1.0], [3.0, None, 4.0], [1e300, 0.0, -1e300]]
    rows = [(1, p, v, x, 2) for p, xs in enumerate(cases) for v, x in enumerate(xs)] + [(2, 0, v, 1e9, -100) for v in range(3)]
    lg = spark.createDataFrame(rows, "seq long, pos long, vocab int, logit double, label int")
    want = []
    for xs in cases:
        top = max(x for x in xs if x is not None)
        want.append(top + math.log(sum(math.exp(x - top) for x in xs if x is not None)) - xs[2])
    for part in (cases[:-1], cases[-1:]):  # the last position alone: its loss would drown the others
        ps = [cases.index(c) for c in part]
        got = C.masked_lm_loss(lg.where(F.col("pos").isin(ps))).first()[0]
        assert math.isclose(got, sum(want[p] for p in ps) / len(ps), rel_tol=1e-9)
    for odd in (inf, math.nan):
        bad = spark.createDataFrame([(1, 0, 0, odd, 1), (1, 0, 1, 2.0, 1)], lg.schema)
        assert math.isnan(C.masked_lm_loss(bad).first()[0])
    plan = C.masked_lm_loss(lg)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Window") < plan.rindex("Aggregate")  # sums first, then the window over them


def test_lookup_bounds_its_batches(spark):
    from helixframe.operators import encode as EN
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    try:
        spark.conf.set(key, "10000")
        tokens = spark.createDataFrame([(["a", "b", "a"],)], "tokens array<string>")
        look = EN.Lookup(EN.vocabulary(tokens))
        assert int(spark.conf.get(key)) <= 1024 and tokens.select(look(F.col("tokens")).alias("i")).first()[0] == [5, 6, 5]
        spark.conf.set(key, "512")
        EN.Lookup(EN.vocabulary(tokens))
        assert spark.conf.get(key) == "512"
    finally:
        spark.conf.set(key, before)
