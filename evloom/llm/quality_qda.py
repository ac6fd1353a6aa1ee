"""Quality classifier: regularised quadratic discriminant analysis.

Statistics of the whole text, transformed towards normality, are the inputs. Class means and scatter
come from one distributed pass over the labelled training rows (sums of x and of x x', added up a
task), so nothing of a document reaches the driver. Only texts with labels are read for it, SAMPLE of
them at most; then each text is scored once, without keeping its statistics. Each class covariance is shrunk towards the
pooled one, and both towards a sphere; Cholesky factors are computed once and kept with the model.
A score is the logistic of a calibrated difference of the two Mahalanobis log densities.
"""

from __future__ import annotations

import operator
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import slices, texts_of
from .common import checked, durable, small_batches

DIM = 20
FEATURES = "held_out boolean, x array<double>, y long"
#: Labelled rows that the model is fitted on, at most.
SAMPLE = 200_000
#: Bins of the log-odds histogram that calibration is fitted on, and the range they cover.
BINS, REACH = 2000, 200.0
LETTERS = np.r_[65:91, 97:123]
_END = re.compile(rb"[.!?][\"')\]]*[ \t\r]*(?:\n|\Z)")


def features(text: str) -> np.ndarray:
    """Transformed statistics of a whole text; all zero for one without words."""
    raw = text.encode("utf-8", "replace")
    words = raw.split()
    n = len(words)
    if not n:
        return np.zeros(DIM)
    h = np.bincount(np.frombuffer(raw, np.uint8), minlength=256).astype(float)
    solid = len(raw) - h[9:14].sum() - h[32]
    low = [w.lower() for w in words]
    lines = [x for x in raw.split(b"\n") if x.strip()]
    share = lambda a, b: np.log((a + 0.2) / (b + 20))
    letters = h[LETTERS].sum()
    p = h[h > 0] / len(raw)
    distinct = len(set(low))
    pairs = len(set(zip(low, low[1:], strict=False)))
    same = sum(map(operator.eq, low, low[1:]))
    return np.array([
        np.log1p(n), np.log(solid / n), share(h[65:91].sum(), letters), share(h[[35, 42, 36, 37, 38, 124, 60, 62]].sum(), n), share(h[33], n),
        share(h[124], n), share(h[[35, 36, 37, 38, 42, 64]].sum(), n), share(h[48:58].sum(), solid), share(h[46], n), share(h[44], n),
        np.log(distinct) - 0.8 * np.log(n), share(same, n), share(n - 1 - pairs, n), share(len(lines) - len(set(lines)), len(lines)), np.log(solid / len(lines)),
        share(h[128:].sum(), solid), float(-(p * np.log(p)).sum()), share(len(_END.findall(raw)), len(lines)), share(max(0, h[46] - h[65:91].sum()), n), share(h[[40, 41, 43, 47, 58, 61, 95]].sum(), n),
    ])


def fold(doc_id: int | None) -> int:
    """crc32 of the id as text, mod 5; 0 is held out. A null id is held out."""
    return 0 if doc_id is None else zlib.crc32(str(doc_id).encode()) % 5


def featured(docs: DataFrame, id_col: str, text_col: str, label_col: str) -> DataFrame:
    """FEATURES' columns of labelled rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                ids = part.column("doc_id").to_pylist()
                x = pa.array([features(t) for t in texts_of(part)], pa.list_(pa.float64()))
                yield pa.record_batch([pa.array([fold(i) == 0 for i in ids]), x, part.column("y")], ["held_out", "x", "y"])

    return docs.selectExpr(f"cast(`{id_col}` as long) as doc_id", f"`{text_col}` as text", f"`{label_col}` as y").mapInArrow(run, FEATURES)


@dataclass
class Model:
    mean: np.ndarray  # a class a row
    factor: np.ndarray  # inverse Cholesky factors
    offset: np.ndarray  # log prior - log determinant
    slope: float = 1.0
    shift: float = 0.0

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        d = [self.offset[k] - 0.5 * (((x - self.mean[k]) @ self.factor[k].T) ** 2).sum(1) for k in (0, 1)]
        return np.clip(d[1] - d[0], -REACH, REACH)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.log_odds(x) + self.shift, -35, 35)))

    def of(self, texts: list[str]) -> np.ndarray:
        """The scores of whole texts."""
        return self.score(np.array([features(t) for t in texts]).reshape(-1, DIM))


def shrunk(n: np.ndarray, s: np.ndarray, ss: np.ndarray, pooled: float, sphere: float) -> Model:
    """The model of counts, sums and sums of squares by class."""
    n1 = np.maximum(n, 1.0)
    mean = s / n1[:, None]
    cov = [ss[k] / n1[k] - np.outer(mean[k], mean[k]) for k in (0, 1)]
    both = (n[0] * cov[0] + n[1] * cov[1]) / max(n.sum(), 1)
    scale = np.sqrt(np.maximum(np.diag(both), 1e-6))
    factor, offset = [], []
    for k in (0, 1):
        c = ((1 - pooled) * cov[k] + pooled * both) / np.outer(scale, scale)
        c = (1 - sphere) * c + sphere * max(np.trace(c) / DIM, 1e-3) * np.eye(DIM)
        low = np.linalg.cholesky(c)
        factor.append(np.linalg.inv(low) / scale)
        offset.append(np.log((n[k] + 1) / (n.sum() + 2)) - np.log(np.diag(low)).sum())
    return Model(mean, np.array(factor), np.array(offset))


def fit(rows: DataFrame, pooled: float = 0.2, sphere: float = 0.02) -> Model:
    """The model from all rows of (x, y); y is 0 or 1. With no rows of a class: its prior alone."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, s, ss = np.zeros(2), np.zeros((2, DIM)), np.zeros((2, DIM, DIM))
        for batch in batches:
            y = batch.column("y").to_numpy(zero_copy_only=False)
            x = np.array(batch.column("x").to_pylist(), float).reshape(-1, DIM)
            for k in (0, 1):
                own = x[y == k]
                n[k] += len(own)
                s[k] += own.sum(0)
                ss[k] += own.T @ own
        flat = np.concatenate([n, s.ravel(), ss.ravel()])
        yield pa.record_batch([pa.array(np.arange(len(flat))), pa.array(flat)], ["k", "v"])

    size = 2 + 2 * DIM + 2 * DIM * DIM
    flat = np.zeros(size)
    for r in rows.mapInArrow(sums, "k long, v double").groupBy("k").agg(F.sum("v").alias("v")).collect():  # `size` rows
        flat[r.k] = r.v
    model = shrunk(flat[:2], flat[2 : 2 + 2 * DIM].reshape(2, DIM), flat[2 + 2 * DIM :].reshape(2, DIM, DIM), pooled, sphere)

    def histogram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros((2, BINS), np.int64)
        for batch in batches:
            y = batch.column("y").to_numpy(zero_copy_only=False).astype(int)
            odds = model.log_odds(np.array(batch.column("x").to_pylist(), float).reshape(-1, DIM))
            np.add.at(seen, (y, np.minimum(((odds + REACH) * BINS / (2 * REACH)).astype(int), BINS - 1)), 1)
        y, k = np.nonzero(seen)
        yield pa.record_batch([pa.array(y), pa.array(k), pa.array(seen[y, k])], ["y", "k", "n"])

    seen = np.zeros((2, BINS))
    for r in rows.mapInArrow(histogram, "y long, k long, n long").groupBy("y", "k").agg(F.sum("n").alias("n")).collect():  # 2 * BINS rows
        seen[r.y, r.k] = r.n
    model.slope, model.shift = platt(seen)
    return model


def platt(seen: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic curve through the histogram, by Newton steps with a weak prior at (1, 0)."""
    z = (np.arange(BINS) + 0.5) * 2 * REACH / BINS - REACH
    w, total = np.array([1.0, 0.0]), seen.sum(0)
    design = np.stack([z, np.ones(BINS)], 1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -35, 35)))
        grad = design.T @ (seen[1] - total * p) - (w - [1.0, 0.0])
        hess = (design * (total * p * (1 - p))[:, None]).T @ design + np.eye(2)
        step = np.linalg.solve(hess, grad)
        w = w + step * min(1.0, 1.0 / max(np.abs(step).max(), 1e-9))
    return float(max(w[0], 1e-3)), float(w[1])


def fitted(docs: DataFrame, labels: DataFrame, sample: int, id_col: str, text_col: str) -> Model:
    """The model from the texts of at most `sample` labelled rows, by the order of their ids' hashes."""
    y = labels.where("quality in (0, 1)").selectExpr("cast(doc_id as long) as y_id", "cast(quality as long) as y")
    y = durable(y.where("y_id is not null").orderBy(F.xxhash64("y_id"), "y_id", "y").limit(sample), "labels")
    found = docs.join(checked(y, 80), F.col(id_col).cast("long") == F.col("y_id"))  # SAMPLE rows are always sent
    return fit(durable(featured(found, "y_id", text_col, "y").where("not held_out").select("x", "y"), "labelled"))


def quality(docs: DataFrame, labels: DataFrame, *, cut: float = 0.3, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted for every row of `docs`.

    Learns from rows of `labels` (doc_id, quality) whose fold is not 0, at most `sample` of all
    labelled ones. Null or empty text: a row of zeros, scored like any; very long texts: whole. Null
    id: held out. Null or other labels: not learned from. Labels that repeat an id: each counts.
    Repeated rows: each scored. A score of `cut` counts as 1. Empty documents: no rows; no labels:
    every score is 0.5. Columns other than the id, the text and quality, whatever their names, are not
    read.
    """
    small_batches(docs.sparkSession)
    docs = docs.selectExpr(f"cast(`{id_col}` as long) as doc_id", f"`{text_col}` as text")
    shared = docs.sparkSession.sparkContext.broadcast(fitted(docs, labels, sample, "doc_id", "text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                score = shared.value.of(texts_of(part))
                held = pa.array([fold(i) == 0 for i in part.column("doc_id").to_pylist()])
                yield pa.record_batch([part.column("doc_id"), held, pa.array(score), pa.array((score >= cut).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return docs.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def keep_good(docs: DataFrame, labels: DataFrame, *, cut: float = 0.3, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` without the rows scored under `cut`, all columns as they were, whatever their names.

    Only texts go to Python, and only scores come back; nothing is shuffled. Nulls, repeated rows,
    long texts, empty tables and ties: as in quality().
    """
    small_batches(docs.sparkSession)
    slim = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(fitted(slim, labels, sample, "doc_id", "text"))

    @F.arrow_udf("double")
    def score(text: pa.Array) -> pa.Array:
        parts = [shared.value.of([t or "" for t in text.slice(lo, 512).to_pylist()]) for lo in range(0, len(text), 512)]
        return pa.array(np.concatenate(parts) if parts else np.zeros(0))

    return docs.where(score(F.col(f"`{text_col}`")) >= cut)
