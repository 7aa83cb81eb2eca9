"""npz source: round trips, foreign files, pruning, commit protocol."""
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from helixframe.sources import npz as Z


def _frame(spark, n, parts=3):
    return spark.range(n, numPartitions=parts).select(
        F.col("id").alias("vec_id"), F.array(*[(F.col("id") * k + 0.5).cast("float") for k in range(4)]).alias("embeddings"), (F.col("id") % 3).cast("int").alias("y_true"),
        (F.col("id") % 2 == 0).alias("flag"), F.array(F.col("id"), -F.col("id")).alias("pair"))


def test_round_trip_and_tasks(spark, tmp_path):
    p = str(tmp_path / "e")
    df = _frame(spark, 1000)
    Z.write_npz(df, p, max_rows=100)
    files = Z.npz_files(p)
    assert len(files) == 12  # 334 + 333 + 333 rows, 100 a file
    back = Z.read_npz(spark, p)
    assert back.schema == df.schema or [f.dataType.simpleString() for f in back.schema] == [f.dataType.simpleString() for f in df.schema]
    assert sorted(map(str, back.collect())) == sorted(map(str, df.collect()))
    assert back.select(F.spark_partition_id()).distinct().count() == 12
    one = np.load(files[0])
    assert one["embeddings"].dtype == np.float32 and one["embeddings"].shape == (100, 4) and one["y_true"].dtype == np.int32
    Z.write_npz(df.limit(10), p)
    assert Z.read_npz(spark, p).count() == 1010
    Z.write_npz(df.limit(10), p, mode="overwrite")
    assert Z.read_npz(spark, p).count() == 10
    assert not [f for f in os.listdir(p) if f.startswith("_")]


def test_foreign_files_and_pruning(spark, tmp_path):
    """Files as numpy writes them: compressed and not, Fortran order, other integer widths; a broken array that nobody asks for."""
    a, y = np.arange(60, dtype=np.float64).reshape(20, 3), np.arange(20)
    np.savez_compressed(tmp_path / "a.npz", embeddings=a, y_true=y)
    os.makedirs(tmp_path / "sub")
    np.savez(tmp_path / "sub" / "b.npz", embeddings=np.asfortranarray(a + 100), y_true=y + 100)
    np.savez(tmp_path / "_hidden.npz", embeddings=a, y_true=y)
    np.savez(tmp_path / ".tmp.c.npz", embeddings=a, y_true=y)
    rows = Z.read_npz(spark, str(tmp_path), ["file", "row", "embeddings", "y_true"]).collect()
    assert sorted((os.path.basename(r["file"]), r["row"], r["embeddings"], r["y_true"]) for r in rows) == sorted(
        [("a.npz", i, a[i].tolist(), i) for i in range(20)] + [("b.npz", i, (a[i] + 100).tolist(), i + 100) for i in range(20)])
    only = Z.read_npz(spark, str(tmp_path), ["y_true"])
    assert only.columns == ["y_true"] and sorted(r[0] for r in only.collect()) == [*range(20), *range(100, 120)]
    assert Z.read_npz(spark, str(tmp_path), ["row"]).agg(F.sum("row")).first()[0] == 2 * 190
    assert Z.read_npz(spark, str(tmp_path / "a.npz")).count() == 20

    broken = tmp_path / "broken"
    os.makedirs(broken)
    np.savez(broken / "x.npz", vectors=np.array([[1], "x"], dtype=object), y_pred=np.arange(3, dtype=np.uint16))
    assert [tuple(r) for r in Z.read_npz(spark, str(broken), ["y_pred"]).collect()] == [(0,), (1,), (2,)]
    np.savez(broken / "y.npz", y_pred=np.arange(3, dtype=np.uint16), other=np.arange(4))
    with pytest.raises(Exception, match="differ in length"):
        Z.read_npz(spark, str(broken / "y.npz"), ["y_pred", "other"]).collect()


def test_batches_bound_what_is_held(spark, tmp_path):
    np.savez_compressed(tmp_path / "a.npz", x=np.arange(10_000))
    spark.dataSource.register(Z.NpzDataSource)
    df = spark.read.format("npz").option("batch_rows", "7").load(str(tmp_path))
    assert df.agg(F.sum("x"), F.count("x")).first() == (sum(range(10_000)), 10_000)


def test_failed_and_killed_writes_show_nothing(spark, tmp_path):
    p = str(tmp_path / "e")
    Z.write_npz(_frame(spark, 30), p)
    before = Z.npz_files(p)
    for bad in ("IF(vec_id = 25, NULL, y_true)", "IF(vec_id = 25, raise_error('stop'), y_true)"):
        with pytest.raises(Exception):  # noqa: B017  (a failing task ends the job)
            Z.write_npz(_frame(spark, 30).withColumn("y_true", F.expr(bad).cast("int")), p)
        assert Z.npz_files(p) == before and not [f for f in os.listdir(p) if f.startswith("_")]
    with pytest.raises(Exception, match="unequal length"):
        Z.write_npz(spark.createDataFrame([([1.0],), ([1.0, 2.0],)], "x array<double>").coalesce(1), str(tmp_path / "u"))
    # a driver that died: in the middle of the tasks, and in the middle of the commit
    w = Z.NpzWriter(_frame(spark, 1).schema, p, False, 10, True)
    open(f"{p}/_job-{w.job}/part-0-{w.job}.npz", "wb").close()
    assert Z.npz_files(p) == before
    open(f"{p}/{Z.MARKER}{w.job}", "wb").close()
    open(f"{p}/part-0-{w.job}.npz", "wb").close()
    assert Z.npz_files(p) == before
    assert Z.read_npz(spark, p).count() == 30


def test_empty(spark, tmp_path):
    p = str(tmp_path / "none")
    Z.write_npz(_frame(spark, 0), p)
    assert Z.npz_files(p) == []
    assert Z.read_npz(spark, p, schema="vec_id bigint").count() == 0
    with pytest.raises(Exception, match="needs a schema"):
        Z.read_npz(spark, p).count()
    with pytest.raises(Exception, match="no array type"):
        Z.write_npz(spark.createDataFrame([("a",)], "s string"), p)
