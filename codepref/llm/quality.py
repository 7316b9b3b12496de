"""Quality classifier by compression.

One zstandard dictionary is trained on good and one on bad labelled texts. A
text is compressed whole with each; the normalised difference of the two sizes,
next to the normalised sizes themselves, goes through a logistic calibration that
is fitted on labelled texts which the dictionaries have not seen. With too few
texts for the dictionary trainer the texts themselves are the dictionaries.

Defined cases: a null text counts as empty; an empty text gets the calibration's
value for empty compressed sizes; labels that are null, or differ for one
document, teach nothing; with labels of one class only (or none) every score is
the share of good labels (0.5 without labels). Repeated rows are scored alike.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codepref.llm.common import crc_mod, hash60

#: Bound of the training sample: at most so many labelled texts of each class,
#: the first by a hash of the id, and of these at most so many bytes.
SAMPLE_ROWS = 4000
SAMPLE_BYTES = 24 << 20
DICT_BYTES = 64 << 10
LEVEL = 3


@dataclass(frozen=True)
class Model:
    good: bytes
    bad: bytes
    trained: bool
    mean: tuple[float, ...]
    scale: tuple[float, ...]
    weights: tuple[float, ...]
    level: int = LEVEL

    def coders(self):
        kind = zstandard.DICT_TYPE_AUTO if self.trained else zstandard.DICT_TYPE_RAWCONTENT
        out = []
        for raw in (self.good, self.bad):
            d = zstandard.ZstdCompressionDict(raw, dict_type=kind)
            d.precompute_compress(level=self.level)
            out.append(zstandard.ZstdCompressor(level=self.level, dict_data=d))
        return out

    def score(self, texts: list[bytes], coders=None) -> np.ndarray:
        if not self.weights:
            return np.full(len(texts), self.mean[0])
        x = (_features(texts, coders or self.coders()) - np.array(self.mean)) / np.array(self.scale)
        z = np.c_[np.ones(len(x)), x] @ np.array(self.weights)
        return 1.0 / (1.0 + np.exp(-np.clip(z, -500, 500)))


def _features(texts: list[bytes], coders) -> np.ndarray:
    sizes = np.array([[len(c.compress(t)) for c in coders] for t in texts], dtype=float).reshape(-1, 2)
    raw = np.array([len(t) for t in texts], dtype=float) + 16.0
    good, bad = sizes[:, 0], sizes[:, 1]
    return np.c_[(bad - good) / (bad + good), (bad - good) / raw, np.log(good / raw), np.log(bad / raw)]


def _dictionary(texts: list[bytes], size: int) -> bytes | None:
    try:
        return zstandard.train_dictionary(size, texts).as_bytes()
    except zstandard.ZstdError:  # too few texts for the trainer
        return None


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3):
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    z = np.c_[np.ones(len(x)), (x - mean) / scale]
    w = np.zeros(z.shape[1])
    pull = ridge * len(y) * np.r_[1e-6, np.ones(z.shape[1] - 1)]
    for _ in range(40):
        p = 1.0 / (1.0 + np.exp(-np.clip(z @ w, -500, 500)))
        hess = (z * (p * (1 - p))[:, None]).T @ z + np.diag(pull + 1e-9)
        step = np.linalg.solve(hess, z.T @ (p - y) + pull * w)
        w = w - step
        if np.abs(step).max() < 1e-10:
            break
    return mean, scale, w


def fit(sample: list[tuple[bytes, int]], dict_bytes: int = DICT_BYTES, level: int = LEVEL) -> Model:
    """Fit on (text, label) pairs: two thirds build the dictionaries, and the
    calibration is fitted on the other third (on all, if that lacks a class)."""
    labels = np.array([y for _, y in sample], dtype=float)
    if len(set(labels)) < 2:
        return Model(b"", b"", False, (float(labels.mean()) if len(labels) else 0.5,), (), ())
    teach = {c: [t for i, (t, y) in enumerate(x for x in sample if x[1] == c) if i % 3 != 2 and t] for c in (0, 1)}
    rest = [x for c in (0, 1) for i, x in enumerate(x for x in sample if x[1] == c) if i % 3 == 2]
    raw = {c: _dictionary(teach[c], dict_bytes) for c in (0, 1)}
    trained = all(raw.values())
    if not trained:  # few texts: the texts themselves are the dictionaries
        raw = {c: b"\n".join(teach[c])[-dict_bytes:] or b"\n" for c in (0, 1)}
    draft = Model(raw[1], raw[0], trained, (), (), (), level)
    fold = rest if len({y for _, y in rest}) == 2 else sample
    x = _features([t for t, _ in fold], draft.coders())
    mean, scale, w = _logistic(x, np.array([y for _, y in fold], dtype=float))
    return Model(raw[1], raw[0], trained, tuple(mean), tuple(scale), tuple(w), level)


def training_sample(docs: DataFrame, labels: DataFrame, label: str = "quality", fold: int = 4, held: int = 2,
                    rows: int = SAMPLE_ROWS, limit: int = SAMPLE_BYTES) -> list[tuple[bytes, int]]:
    """The bounded sample of labelled texts, the same on every run.

    The ids are chosen from the labels alone (``rows`` of each class), so the
    side that is broadcast to the texts has at most 2 * ``rows`` ids."""
    known = (labels.select(F.col("doc_id").alias("_id"), F.col(label).alias("_y"))
             .where(F.col("_id").isNotNull() & F.col("_y").isin(0, 1) & (crc_mod(F.col("_id"), fold) != held))
             .groupBy("_id").agg(F.min("_y").alias("_y"), F.max("_y").alias("_top")).where("_y = _top").drop("_top")
             .withColumn("_h", hash60(F.col("_id"), ":quality")))
    chosen = None
    for c in (0, 1):
        part = known.where(F.col("_y") == c).orderBy("_h", "_id").limit(rows)
        chosen = part if chosen is None else chosen.unionByName(part)
    texts = docs.select(F.col("doc_id").alias("_id"), F.coalesce("text", F.lit("")).cast("binary").alias("_t"))
    found = texts.join(F.broadcast(chosen), "_id")
    total = found.groupBy("_id", "_y", "_h").agg(F.max(F.length("_t")).alias("_n"))
    sizes = sorted((r["_y"], r["_h"], r["_id"], r["_n"]) for r in total.collect())  # at most 2 * rows ids
    keep, used = [], {0: 0, 1: 0}
    for y, _, i, n in sizes:
        if used[y] + n <= limit // 2:
            used[y] += n
            keep.append(i)
    if not keep:
        return []
    ids = docs.sparkSession.createDataFrame([(i,) for i in keep], "_id long")
    got = found.join(F.broadcast(ids), "_id").groupBy("_y", "_h", "_id").agg(F.min("_t").alias("_t")).collect()
    return [(bytes(r["_t"]), r["_y"]) for r in sorted(got, key=lambda r: (r["_y"], r["_h"], r["_id"]))]


def score(docs: DataFrame, model: Model, out: str = "score") -> DataFrame:
    """``docs`` with a score from 0 to 1 (higher: good likelier) per whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        m = shared.value
        coders = m.coders() if m.weights else None
        for texts in batches:
            yield pd.Series(m.score([t.encode("utf-8", "surrogatepass") if t else b"" for t in texts], coders))

    return docs.withColumn(out, scored(F.col("text")))


def train(docs: DataFrame, labels: DataFrame, **options) -> Model:
    return fit(training_sample(docs, labels, **options))
