"""Spark plan == DuckDB oracle on the smallest driver tables (a fast subset)."""
import math

import duckdb
import pytest

import __spark_entry__ as E
from helixframe.sources.tables import TABLES

from conftest import SF_SMALL

FAST = ["k6_contingency", "k7_ami", "k8_ari", "q3_cos_mean", "q6_cos_hist", "c6_contrastive_loss",
        "t1_vocabulary", "t3_pad_mask", "t6_mlm_mask", "p2_view_roles", "v2_average_precision",
        "v5_bootstrap_se", "x2_best_so_far", "x6_loss_repair", "e2_pool_avg", "e14_hashed_embedding",
        "s10_sanitize_filename", "k3_knn_graph", "t11_scatter_rows", "q7_align_uniform_record",
        "st1_stream_encode", "k15_silhouette"]


def _norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 6) + 0.0)
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(_norm(x) for x in v) + "]"
    return "null" if v is None else str(v)


def _rows(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted("|".join(_norm(r[i]) for i in order) for r in rows)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return c


def test_every_oracle_has_a_query():
    assert set(E.oracle_sql()) <= set(E.queries())


@pytest.mark.parametrize("name", FAST)
def test_matches_oracle(spark, con, name):
    df = E.queries()[name](spark, SF_SMALL)
    res = con.sql(E.oracle_sql()[name])
    assert sorted(df.columns) == sorted(res.columns)
    assert _rows(df.columns, [tuple(r) for r in df.collect()]) == _rows(res.columns, res.fetchall())
