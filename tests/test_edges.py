"""Edge rows from FIXTURES.md: null/empty text, long text, all-zero vector,
mask of zeros, every sample unclustered, file-name rules."""
import math

import pytest
from pyspark.sql import functions as F

from helixframe.operators import encode as EN
from helixframe.operators import pooling as PO
from helixframe.operators import scores as S
from helixframe.sources import io as IO


def test_null_empty_and_long_text_encode(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, " ".join(["w"] * 300)), (4, "a b a")],
                               "doc_id long, text string")
    vocab = EN.vocabulary(df.select(EN.words(F.col("text")).alias("tokens")))
    out = {r["doc_id"]: r for r in EN.encode(df, "text", EN.Lookup(vocab)).collect()}
    assert out[1]["input_ids"][:3] == [EN.CLS_ID, EN.SEP_ID, EN.PAD_ID]  # null -> " " -> no tokens
    assert out[2]["attention_mask"][:3] == [1, 1, 0]
    assert len(out[3]["input_ids"]) == 128 and out[3]["input_ids"][127] == EN.SEP_ID
    assert sum(out[3]["attention_mask"]) == 128


def test_mask_of_zeros_gives_nan_pool(spark):
    rows = [(0, 3, 0, 0, [1.0, 2.0]), (0, 3, 1, 0, [3.0, 4.0])]
    h = spark.createDataFrame(rows, "seq_id long, layer int, pos int, mask int, h array<double>")
    pooled = PO.pool(h, "avg", 4).collect()[0]["pooled"]
    assert all(math.isnan(v) for v in pooled)


def test_every_sample_unclustered(spark):
    df = spark.createDataFrame([(i, i % 3, -1, [float(i), 1.0]) for i in range(9)],
                               "vec_id long, label long, cluster long, embedding array<double>")
    r = S.cluster_ratios(df).collect()[0]
    assert r["num_cluster_pred"] == 0 and r["ratio_clustered"] == 0.0
    sheet = {x["metric"]: x["value"] for x in S.score_sheet(df).collect()}
    assert "AMI_clus" not in sheet and "CHS_pred" not in sheet and "CHS_true" in sheet


def test_sanitize_filename_rules(spark):
    df = spark.createDataFrame([("  ..a/b:c*d?é.. ",), (".hidden.",)], "t string")
    plain = [r[0] for r in df.select(IO.sanitize_filename(F.col("t"))).collect()]
    assert plain == ["a-bcd", "hidden"]
    dot = [r[0] for r in df.select(IO.sanitize_filename(F.col("t"), allow_dotfiles=True)).collect()]
    assert dot == ["..a-bcd", ".hidden"]


def test_corpus_format_rule():
    assert IO.corpus_format("/x/train.csv") == ("csv", ",")
    assert IO.corpus_format("/x/train_tsv.csv") == ("csv", "\t")
    assert IO.corpus_format("/x/a.json")[0] == "json"
    with pytest.raises(ValueError):
        IO.corpus_format("/x/a.parquet")


def test_single_vector_and_zero_vector(spark):
    from helixframe.operators import quality as Q
    one = spark.createDataFrame([(0, [0.0, 0.0, 0.0])], "vec_id long, embedding array<double>")
    m = Q.cosine_moments(one).collect()[0]
    assert m["e_costheta"] == 0.0 and m["v_costheta"] is None
    assert Q.uniformity(one).collect()[0]["uniform_t2"] is None
    h = {r["bin"]: r["count"] for r in Q.cosine_histogram(one).collect()}
    assert h[10] == 1 and sum(h.values()) == 1
