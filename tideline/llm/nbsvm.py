"""Quality classifier: naive Bayes support vectors (Wang and Manning).

Indicators of hashed n-grams, scaled by the class log-count ratios, go into a linear model with
hinge loss, fitted by dual coordinate descent (Hsieh et al.). Margins become probabilities by a
logistic fit. N-grams are of bytes (1 to 3), of word shapes, and of doubled words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import materialise, utf8

DIMS = 1 << 18
#: Classes of bytes for the shapes; every other byte stands for itself.
_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[ord("a") : ord("z") + 1] = ord("a")
_SHAPE[ord("A") : ord("Z") + 1] = ord("A")
_SHAPE[ord("0") : ord("9") + 1] = ord("0")
_SHAPE[0x80:] = ord("a")
_SHAPE[[9, 11, 12, 13]] = 32
#: Shares of words equal to the word before them, in per cent, each an indicator.
_DOUBLED = (1, 5, 10, 20, 40, 60, 80)
_LAST = np.zeros(DIMS, np.int32)


def _hash(codes: np.ndarray, salt: int) -> np.ndarray:
    x = (codes.astype(np.uint32) + np.uint32(salt)) * np.uint32(2654435761)
    x ^= x >> np.uint32(15)
    return (x * np.uint32(2246822519)) >> np.uint32(14)


def features(text: bytes | None) -> np.ndarray:
    """Distinct feature numbers of a text; a text without words has none."""
    if not text or not text.strip():
        return np.zeros(0, np.int64)
    raw = np.frombuffer(text, np.uint8)
    found = []
    wide = raw.astype(np.uint32)
    found.append(_hash(wide, 1))
    if len(wide) > 1:
        two = wide[:-1] | wide[1:] << np.uint32(8)
        found.append(_hash(two, 1 << 24))
    if len(wide) > 2:
        found.append(_hash(two[:-1] | wide[2:] << np.uint32(16), 1 << 25))
    shape = _SHAPE[raw]
    runs = shape[np.r_[True, shape[1:] != shape[:-1]]].astype(np.uint32)
    if len(runs) > 3:
        found.append(_hash(runs[:-3] | runs[1:-2] << np.uint32(8) | runs[2:-1] << np.uint32(16) | runs[3:] << np.uint32(24), 3))
    words = text.split()
    twice = sum(map(bytes.__eq__, words, words[1:]))
    doubled = [k for k, share in enumerate(_DOUBLED) if 100 * twice >= share * len(words)]
    found.append(_hash(np.array(doubled, np.uint32), 1 << 26))
    found = np.concatenate(found)
    order = np.arange(len(found), dtype=np.int32)
    _LAST[found] = order  # of equal numbers, the last one stays
    return found[_LAST[found] == order].astype(np.int64)


@dataclass(frozen=True)
class Model:
    weights: np.ndarray  # of DIMS features, the log-count ratio included
    bias: float
    slope: float
    offset: float

    def margin(self, x: np.ndarray) -> float:
        return float(self.weights[x].sum() / np.sqrt(max(1, len(x))) + self.bias)

    def score(self, text: bytes | None) -> float:
        z = self.slope * self.margin(features(text)) + self.offset
        return float(1.0 / (1.0 + np.exp(-np.clip(z, -40, 40))))


def log_count_ratio(rows: list[np.ndarray], y: np.ndarray, alpha: float = 1.0) -> np.ndarray:
    """Log ratio of the classes' smoothed shares of each feature; labels are 1 and -1."""
    counts = {s: np.full(DIMS, alpha) for s in (1, -1)}
    for x, s in zip(rows, y.tolist()):
        counts[s][x] += 1
    return np.log(counts[1] / counts[1].sum()) - np.log(counts[-1] / counts[-1].sum())


def dual_coordinate_descent(rows: list[np.ndarray], ratio: np.ndarray, y: np.ndarray, c: np.ndarray, epochs: int, seed: int) -> tuple[np.ndarray, float]:
    """Hinge loss with upper bounds c on the duals; the bias is a feature of value 1.

    The value of feature k in a row of n is ratio[k] / sqrt(n); values are not stored.
    """
    w, b = np.zeros(DIMS), 0.0
    alpha = np.zeros(len(rows))
    scale = np.array([1 / np.sqrt(max(1, len(x))) for x in rows])
    diag = np.array([float(ratio[x] @ ratio[x]) * s * s + 1.0 for x, s in zip(rows, scale)])
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        moved = 0.0
        for i in rng.permutation(len(rows)):
            x = rows[i]
            v = ratio[x] * scale[i]
            g = y[i] * (float(w[x] @ v) + b) - 1.0
            new = min(max(alpha[i] - g / diag[i], 0.0), c[i])
            if step := (new - alpha[i]) * y[i]:
                w[x] += step * v
                b += step
                alpha[i] = new
                moved = max(moved, abs(step))
        if moved < 1e-4:
            break
    return w, b


def logistic_fit(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Platt's smoothed targets, by Newton steps with a small ridge."""
    pos, neg = (y > 0).sum(), (y < 0).sum()
    t = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -40, 40)))
        g = np.array([((p - t) * margin).sum() + 1e-3 * a, (p - t).sum()])
        h = p * (1 - p)
        m = np.array([[(h * margin * margin).sum() + 1e-3, (h * margin).sum()], [(h * margin).sum(), h.sum() + 1e-6]])
        step = np.linalg.solve(m, g)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-9:
            break
    return float(a), float(b)


def fit(rows: list[np.ndarray], labels: list[int], beta: float = 0.25, cost: float = 1.0, epochs: int = 12, seed: int = 5) -> Model:
    """Fit on feature rows with labels 0 or 1; classes weigh alike. The logistic scores are fitted to margins of five folds at every size. With fewer than two rows of either class the score is the smoothed prior."""
    y = np.where(np.array(labels, int) > 0, 1, -1) if labels else np.zeros(0, int)
    pos, neg = int((y > 0).sum()), int((y < 0).sum())
    if min(pos, neg) < 2:
        return Model(np.zeros(DIMS), 0.0, 0.0, float(np.log((pos + 1) / (neg + 1))))
    def train(use: np.ndarray) -> tuple[np.ndarray, float]:
        r = log_count_ratio([rows[i] for i in use], y[use])
        n = len(use)
        c = np.where(y[use] > 0, cost * n / (2 * max(1, (y[use] > 0).sum())), cost * n / (2 * max(1, (y[use] < 0).sum())))
        w, b = dual_coordinate_descent([rows[i] for i in use], r, y[use], c, epochs, seed)
        mean = float(np.abs(w).sum() / max(1, np.count_nonzero(w)))
        return r * ((1 - beta) * mean + beta * w), b

    everything = np.arange(len(y))
    folds = 5
    fold = np.zeros(len(y), int)
    for s in (1, -1):
        fold[y == s] = np.arange((y == s).sum()) % folds
    unseen = np.zeros(len(y))
    for k in range(folds):
        model = Model(*train(everything[fold != k]), 1.0, 0.0)
        unseen[fold == k] = [model.margin(rows[i]) for i in everything[fold == k]]
    return Model(*train(everything), *logistic_fit(unseen, y))


def held_out(id_col: str = "doc_id", folds: int = 5):
    """crc32 of the id as text divides by folds; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % folds == 0, F.lit(False))


def train_classifier(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", max_rows: int = 12_000, max_bytes: int = 256 << 20) -> Model:
    """Fit on labelled rows that are not held out, in order of id hash, up to two bounds.

    The fit takes at most max_rows rows and max_bytes of feature numbers (4 bytes each) to the
    driver, and stops at the first row beyond either; equal ids are ordered by label and
    features, so a rerun takes the same rows. Labels other than 0 and 1 and null ids are left
    out. The chosen labels, bounded too, are broadcast to the scan of the texts.
    """
    usable = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & ~held_out(id_col))
    chosen = usable.select(F.col(id_col).cast("long").alias("_id"), F.col(label_col).cast("int").alias("_y")).orderBy(F.xxhash64("_id"), "_id", "_y").limit(max_rows)
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "_id").select("_id", "_y", "text")

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [features(t).astype(np.int32).tobytes() for t in utf8(b.column(2))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(x, pa.binary())], names=["id", "y", "x"])

    found = materialise(rows.mapInArrow(extract, "id long, y int, x binary"), "nbsvm-rows")
    got, held = [], 0
    for r in found.orderBy(F.xxhash64("id"), "id", "y", "x").limit(max_rows).toLocalIterator():
        held += len(r["x"])
        if held > max_bytes:
            break
        got.append((r["y"], np.frombuffer(r["x"], np.int32)))
    order = np.random.default_rng(3).permutation(len(got))
    return fit([got[i][1] for i in order], [got[i][0] for i in order])


def score_texts(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """One row per input row: doc_id, held_out, score, predicted; from the whole text and nothing else."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = [held.value.score(t) for t in utf8(b.column(2))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(s, pa.float64())], names=["doc_id", "held_out", "score"])

    out = docs.select(F.col(id_col).cast("long"), held_out(id_col).alias("held_out"), F.col(text_col)).mapInArrow(scan, "doc_id long, held_out boolean, score double")
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def classify(docs: DataFrame, labels: DataFrame, max_rows: int = 12_000, threshold: float = 0.3) -> DataFrame:
    """Scores of all rows of docs by a model of the labels outside the held-out fold; empty texts have the score of no feature."""
    return score_texts(docs, train_classifier(docs, labels, max_rows=max_rows), threshold=threshold)


def keep_accepted(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """The rows of docs, with all their columns, whose score reaches the threshold."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array([held.value.score(t) >= threshold for t in utf8(b.column(at))], pa.bool_()))

    return docs.mapInArrow(scan, docs.schema)
