"""Toxicity by compression distance.

Two raw zstandard dictionaries are put together from counts over a bounded sample of labelled rows, one for toxic and
one for ordinary text (zstandard's own trainer finds far less, see the README).  Both end in the same common words; in front
stand the ``N_PIECES`` word beginnings that set the class apart (highest count times log rate ratio).  Every whole text is cut into windows of
``WINDOW`` words, each window is compressed with both dictionaries, and the differences in length
give a few features (gain per 100 bytes, largest gains, shares and counts of windows with a gain or loss of ``GAIN``).  A
logistic curve, calibrated on the same sample, turns them into a score; 0.5 is the threshold.

Bounds of the fit (parameters): ``SAMPLE`` labelled rows, the lowest by a hash of the id.  The piece
and word counts of the sample are aggregated by Spark; only the chosen pieces and the sample's
features (ten numbers a row) reach the driver.

Defined cases: null or empty text has no window and all features 0; rows without an id are
scored and never learnt from; a label given twice counts as its maximum; without labelled rows of both classes
every score is 0; an empty table gives no rows.  Columns of the input pass through untouched.
"""
from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from helixframe.llm.common import pieces, tidy

SAMPLE = 6000
WINDOW, GAIN, LEVEL, N_FEATURES = 8, 1, 9, 10
N_PIECES, RATIO, N_COMMON, MIN_COUNT, PER_DOC = 40, 6.0, 2500, 8, 5
PIECE_CHARS = range(4, 11)
WORD = re.compile(r"[^\W\d_]+")


def learnable(doc_id: Column) -> Column:
    """True for rows whose labels may be learnt from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 != 0, F.lit(False))


def sample_rows(docs: DataFrame, labels: DataFrame, size: int = SAMPLE) -> DataFrame:
    """(text, toxic) of at most ``size`` labelled rows outside the held-out fold."""
    ids = labels.where(learnable(F.col("doc_id")) & F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    ids = ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(size)
    return docs.select("doc_id", F.col("text")).where(F.col("text").isNotNull()).join(F.broadcast(ids), "doc_id").select("text", F.col("toxic").cast("int").alias("toxic"))


def counted(rows: DataFrame) -> DataFrame:
    """(toxic, kind, piece, c): word beginnings (p), words (w) and documents (n) of each class."""

    def run(batches):
        for batch in batches:
            total = Counter()
            for text, toxic in zip(batch.column(0), batch.column(1).to_pylist()):
                own = Counter()
                for word, c in Counter(WORD.findall(text.as_py().lower())).items():
                    total[(toxic, "w", word)] += c
                    for k in PIECE_CHARS:
                        if len(word) + 1 >= k:
                            own[" " + word[:k - 1]] += c
                for piece, c in own.items():
                    total[(toxic, "p", piece)] += min(c, PER_DOC)
                total[(toxic, "n", "")] += 1
            keys = list(total)
            yield pa.record_batch([pa.array([k[0] for k in keys], pa.int32()), pa.array([k[1] for k in keys]), pa.array([k[2] for k in keys]),
                                   pa.array([total[k] for k in keys], pa.int64())], names=["toxic", "kind", "piece", "c"])
        batch = total = own = keys = None
        tidy()

    return rows.mapInArrow(run, "toxic int, kind string, piece string, c bigint")


def chosen(candidates: list[tuple[str, int]], n: int) -> list[str]:
    """Best first; of pieces that begin one another the longer one stays while it keeps 70 % of the count."""
    out: list[str] = []
    count = dict(candidates)
    for piece, c in candidates:
        near = [i for i, o in enumerate(out) if o.startswith(piece) or piece.startswith(o)]
        if near:
            if len(piece) > len(out[near[0]]) and c >= 0.7 * count[out[near[0]]]:
                out[near[0]] = piece
        elif len(out) < n:
            out.append(piece)
    return out


class Model:
    """Two dictionaries and the calibrated curve; plain values, so it travels with a task."""

    def __init__(self, toxic: bytes, ordinary: bytes):
        self.toxic, self.ordinary = toxic, ordinary
        self.mean = self.scale = self.weights = None

    def compressors(self):
        import zstandard
        return [zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_RAWCONTENT),
                                         write_content_size=False, write_checksum=False, write_dict_id=False) for d in (self.ordinary, self.toxic)]

    @staticmethod
    def features(text: str | None, ordinary, toxic) -> list[float]:
        words = WORD.findall((text or "").lower())
        if not words:
            return [0.0] * N_FEATURES
        windows = [(" " + " ".join(words[i:i + WINDOW])).encode() for i in range(0, len(words), WINDOW)]
        gain = np.array([len(ordinary.compress(w)) - len(toxic.compress(w)) for w in windows], float)
        top = np.sort(gain)[::-1]
        n, once, twice, less = len(gain), (gain >= GAIN).sum(), (gain >= 2 * GAIN).sum(), (gain <= -GAIN).sum()
        return [100 * gain.sum() / sum(map(len, windows)), top[0], top[:3].mean(), once / n, twice / n, less / n, np.log1p(once), np.log1p(twice), np.log1p(n), np.log1p(less)]

    def calibrate(self, x: np.ndarray, y: np.ndarray) -> None:
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-9
        a, w = self.inputs(x), np.zeros(2 * x.shape[1] + 1)
        for _ in range(60):
            p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
            w = w + np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + 1e-2 * np.eye(len(w)), a.T @ (y - p) - 1e-2 * w)
        self.weights = w

    def inputs(self, x: np.ndarray) -> np.ndarray:
        z = np.tanh((x - self.mean) / self.scale / 2)
        return np.c_[2 * z, z * z, np.ones(len(x))]

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.inputs(x) @ self.weights, -30, 30)))


def fit(docs: DataFrame, labels: DataFrame, size: int = SAMPLE) -> Model | None:
    rows = sample_rows(docs, labels, size).persist()
    try:
        by = counted(rows).groupBy("kind", "piece").agg(*[F.coalesce(F.sum(F.when(F.col("toxic") == k, F.col("c"))), F.lit(0)).alias(f"c{k}") for k in (0, 1)]).persist()
        n = by.where("kind = 'n'").first()
        if n is None or not n["c0"] or not n["c1"]:
            by.unpersist()
            return None
        best = []
        for own, other in ((1, 0), (0, 1)):
            rate = ((F.col(f"c{own}") + 0.5) / float(n[f"c{own}"])) / ((F.col(f"c{other}") + 0.5) / float(n[f"c{other}"]))
            top = by.where(f"kind = 'p' and c{own} >= {MIN_COUNT}").where(rate > RATIO)
            top = top.orderBy((F.col(f"c{own}") * F.log(rate)).desc(), F.length("piece").desc(), "piece").limit(20 * N_PIECES)
            best.append("".join(chosen([(r["piece"], r[f"c{own}"]) for r in top.collect()], N_PIECES)))
        common = by.where("kind = 'w'").orderBy(F.desc("c0"), "piece").limit(N_COMMON).collect()
        by.unpersist()
        shared = "".join(" " + r["piece"] for r in common)
        toxic, ordinary = best
        model = Model((toxic + shared).encode(), (ordinary[:len(toxic)] + shared).encode())

        def run(batches):
            c = model.compressors()
            for batch in batches:
                x = [model.features(t.as_py(), *c) for t in batch.column(0)]
                yield pa.record_batch([batch.column(1), pa.array(x, pa.list_(pa.float64()))], names=["toxic", "x"])

        got = rows.mapInArrow(run, "toxic int, x array<double>").collect()  # ten numbers for each row of the bounded sample
        got.sort(key=lambda r: (r["toxic"], r["x"]))
        model.calibrate(np.array([r["x"] for r in got]), np.array([float(r["toxic"]) for r in got]))
        return model
    finally:
        rows.unpersist()


def scored(docs: DataFrame, model: Model | None, text_col: str = "text", score: str = "_score") -> DataFrame:
    """``docs`` with one more column: the score of each whole text."""
    if model is None:
        return docs.withColumn(score, F.lit(0.0))
    at = docs.columns.index(text_col)

    def run(batches):
        c = model.compressors()
        for batch in batches:
            for part in pieces(batch, 512):
                x = np.array([model.features(t.as_py(), *c) for t in part.column(at)]).reshape(-1, N_FEATURES)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(model.scores(x))], names=[*part.schema.names, score])
        batch = part = x = None
        tidy()

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(score, T.DoubleType())]))


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    model = fit(docs, labels)
    out = scored(docs.select("doc_id", "text"), model)
    return out.select("doc_id", F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False)).alias("held_out"),
                      F.col("_score").alias("score"), (F.col("_score") >= 0.5).cast("int").alias("predicted"))


def kept(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are not toxic, with the columns of ``docs``."""
    return scored(docs, fit(docs, labels)).where("_score < 0.5").drop("_score")
