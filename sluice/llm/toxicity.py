"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic documents are the positives; all documents are the unlabelled rest. The
classifier is linear over the distinct features of a whole text (its words, their first
five characters and their character 4-grams, hashed), and minimises the class-prior
corrected risk prior * R_p+ + max(0, R_u- - prior * R_p-) of the logistic loss: where
the estimate of the negative risk falls below zero, the step goes the other way.

Fitting takes bounded samples, `positives` and `unlabelled` documents, picked by a hash
of their ids, and keeps the `selected` features most typical of the positives. The prior
is the rate of toxic labels among the labelled documents that may be used. Features,
model and score see the text alone; labels of held-out documents are never read.

Null and empty texts have no features and get the model's bias. Documents without a
label are scored as any other. Without a positive label the score is 0 everywhere.
Null ids are carried (fold 0, held out), repeated rows are scored each, extra columns
are ignored, an empty table gives an empty result.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold, in_slices, lots, tidy

DIM, POSITIVES, UNLABELLED, SELECTED, FOLDS = 1 << 18, 2_000, 5_000, 4_096, 5
_WORD = re.compile(r"\w+")


def features_of(word: str) -> set[int]:
    padded = f"^{word}$"
    names = {"w" + word, "p" + word[:5], *(padded[i : i + 4] for i in range(len(padded) - 3))}
    return {xxhash.xxh32_intdigest(n.encode("utf-8", "surrogatepass")) & (DIM - 1) for n in names}


def _rounds(data: np.ndarray) -> np.ndarray:
    """xxh32 of the rows of a matrix of under 16 bytes a row."""
    rows, size = data.shape
    turn = lambda h, n: (h << np.uint32(n)) | (h >> np.uint32(32 - n))
    h = np.full(rows, (374761393 + size) & 0xFFFFFFFF, np.uint32)
    for at in range(0, size - 3, 4):
        four = np.ascontiguousarray(data[:, at : at + 4]).view("<u4")[:, 0]
        h = turn(h + four * np.uint32(3266489917), 17) * np.uint32(668265263)
    for at in range(size // 4 * 4, size):
        h = turn(h + data[:, at].astype(np.uint32) * np.uint32(374761393), 11) * np.uint32(2654435761)
    h = (h ^ (h >> np.uint32(15))) * np.uint32(2246822519)
    h = (h ^ (h >> np.uint32(13))) * np.uint32(3266489917)
    return h ^ (h >> np.uint32(16))


def _slice_hashes(data: np.ndarray, start: np.ndarray, size: np.ndarray, together: int = 1_000_000) -> np.ndarray:
    """xxh32 of slices of bytes, those of one length together."""
    out = np.empty(len(start), np.uint32)
    for n in np.flatnonzero(np.bincount(size)).tolist():
        rows = np.flatnonzero(size == n)
        if n >= 16:
            whole = data.tobytes()
            out[rows] = [xxhash.xxh32_intdigest(whole[i : i + n]) for i in start[rows].tolist()]
            continue
        for i in range(0, len(rows), together):
            out[rows[i : i + together]] = _rounds(data[start[rows[i : i + together]][:, None] + np.arange(n)])
    return out


def _marked(names: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Names as UTF-8 one after the other, the place of each character (and the end), the number of characters before each name (and in all)."""
    data = np.frombuffer("".join(names).encode("utf-8", "surrogatepass"), np.uint8)
    places = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))
    return data, places, np.concatenate([[0], np.cumsum([len(n) for n in names])])


def features_of_all(words: list[str], chosen: np.ndarray | None = None) -> list[bytes]:
    """The (chosen) features of each word as bytes, those of `features_of` in any order; one may be there twice."""
    found, owners = [], []
    for names in (["w" + w for w in words], ["p" + w[:5] for w in words]):
        data, places, ends = _marked(names)
        found.append(_slice_hashes(data, places[ends[:-1]], np.diff(places[ends])))
        owners.append(np.arange(len(words)))
    data, places, ends = _marked([f"^{w}$" for w in words])
    count = np.diff(ends) - 3
    first = np.repeat(ends[:-1] - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
    found.append(_slice_hashes(data, places[first], places[first + 4] - places[first]))
    owners.append(np.repeat(np.arange(len(words)), count))
    flat, owner = np.concatenate(found) & np.uint32(DIM - 1), np.concatenate(owners)
    if chosen is not None:
        kept = chosen[flat]
        flat, owner = flat[kept], owner[kept]
    flat = flat[np.argsort(owner, kind="stable")].astype("<u4").tobytes()
    sizes = np.bincount(owner, minlength=len(words))
    ends, out = np.cumsum(sizes).tolist(), [b""] * len(words)
    for i in np.flatnonzero(sizes).tolist():
        out[i] = flat[4 * ends[i - 1] if i else 0 : 4 * ends[i]]
    return out


class _Pieces(dict):
    """White-space separated piece -> bytes of the (chosen) features of its words.

    New pieces are learned many at once. There are two generations of up to about `limit`
    pieces: when the younger one is full it becomes the older, whose pieces return when used.
    """

    def __init__(self, chosen: np.ndarray | None = None, limit: int = 200_000):
        self.chosen, self.limit, self.older = chosen, limit, {}

    def _learn(self, pieces: list[str]) -> None:
        found = [(p, _WORD.findall(p.lower())) for p in pieces]
        words = list({w: None for _, each in found for w in each})
        known = dict(zip(words, features_of_all(words, self.chosen), strict=True)) if words else {}
        for piece, each in found:
            self[piece] = known[each[0]] if len(each) == 1 else b"".join([known[w] for w in each])

    def distinct(self, texts: list[str | None]) -> list[np.ndarray]:
        """The distinct (chosen) features of each text, in order."""
        split = [(t or "").split() for t in texts]
        if len(self) >= self.limit:
            self.older = dict(self)
            self.clear()
        missing = [p for p in set().union(*split) if p not in self]
        if self.older:
            back = {p: self.older[p] for p in missing if p in self.older}
            self.update(back)
            missing = [p for p in missing if p not in back]
        for a, b in in_slices(missing, 200_000):
            self._learn(missing[a:b])
        return [np.unique(np.frombuffer(b"".join(map(self.__getitem__, each)), "<u4")) for each in split]


@dataclass
class Model:
    weights: np.ndarray  # of all hashed features, 0 for those not selected
    bias: float
    trained: bool

    def score(self, features: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-(self.bias + self.weights[features].sum())))) if self.trained else 0.0


def fit(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, selected: int = SELECTED, steps: int = 150, rate: float = 0.05, decay: float = 1e-3) -> Model:
    """nnPU by full-batch Adam over the selected features of the samples."""
    weights = np.zeros(DIM, np.float64)
    if not positive or not unlabelled:
        return Model(weights, 0.0, False)
    seen = [np.bincount(np.concatenate(x).astype(np.int64), minlength=DIM) for x in (positive, unlabelled)]
    p, u = seen[0] / len(positive), seen[1] / len(unlabelled)
    lift = (p - u) / np.sqrt(u * (1 - u) / len(positive) + 1 / len(positive) ** 2)
    order = np.argsort(-lift, kind="stable")[:selected]
    keep = order[(lift[order] > 4) & (seen[0][order] >= 3)]
    if not len(keep):
        return Model(weights, 0.0, False)
    place = np.full(DIM, -1, np.int64)
    place[keep] = np.arange(len(keep))

    def matrix(docs):
        cols = [place[d] for d in docs]
        cols = [c[c >= 0] for c in cols]
        return np.concatenate(cols), np.repeat(np.arange(len(cols)), [len(c) for c in cols]), len(cols)

    mats = [matrix(positive), matrix(unlabelled)]
    theta, bias = np.zeros(len(keep)), -1.0
    m, v = np.zeros(len(keep) + 1), np.zeros(len(keep) + 1)
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -40, 40)))
    for step in range(1, steps + 1):
        z = [np.bincount(rows, theta[cols], minlength=n) + bias for cols, rows, n in mats]
        risk_minus = np.mean(np.logaddexp(0, z[1])) - prior * np.mean(np.logaddexp(0, z[0]))
        slope_u = sigmoid(z[1]) / len(z[1])
        slope_p_minus = -prior * sigmoid(z[0]) / len(z[0])
        slope_p_plus = -prior * sigmoid(-z[0]) / len(z[0])
        if risk_minus >= 0:
            slopes = (slope_p_plus + slope_p_minus, slope_u)
        else:  # non-negative correction: climb back out of the negative estimate
            slopes = (-slope_p_minus, -slope_u)
        grad = sum(np.bincount(cols, s[rows], minlength=len(keep)) for (cols, rows, _), s in zip(mats, slopes, strict=True))
        grad = np.append(grad + decay * prior * theta, sum(s.sum() for s in slopes))
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        move = rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        theta, bias = theta - move[:-1], bias - move[-1]
    weights[keep] = theta
    return Model(weights, float(bias), True)


def _sampled(ids: DataFrame, most: int, count: int) -> DataFrame:
    """About `most` of `count` rows, by a hash of the id, so the same at every run."""
    if count <= most:
        return ids
    return ids.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(most / count * (1 << 30)))


def train(docs: DataFrame, labels: DataFrame, folds: int = FOLDS, positives: int = POSITIVES, unlabelled: int = UNLABELLED, **options) -> Model:
    """docs: doc_id, text; labels: doc_id, toxic. Reads no label and learns from no text of fold 0."""
    usable = labels.filter((fold(F.col("doc_id"), folds) != 0) & F.col("toxic").isNotNull()).select("doc_id", "toxic")
    n, toxic = usable.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.when(F.col("toxic") == 1, 1).otherwise(0)), F.lit(0))).first()
    if not toxic:
        return Model(np.zeros(DIM), 0.0, False)
    prior = min(max(toxic / n, 0.01), 0.5)
    chosen = F.broadcast(_sampled(usable.filter("toxic = 1").select("doc_id"), positives, toxic).distinct())
    open_docs = docs.filter(fold(F.col("doc_id"), folds) != 0).select("doc_id", "text")
    sampled = _sampled(open_docs, unlabelled, open_docs.select("doc_id").count())

    def run(batches):
        pieces = _Pieces()
        for batch in lots(batches, 1):
            yield pa.RecordBatch.from_arrays([pa.array([x.tobytes() for x in pieces.distinct(batch.column(1).to_pylist())], pa.binary())], names=["features"])

    collected = [
        [np.frombuffer(r[0], "<u4") for r in part.select("doc_id", "text").mapInArrow(run, "features binary").collect()]
        for part in (open_docs.join(chosen, "doc_id", "left_semi"), sampled)
    ]
    return fit(*collected, prior, **options)


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = FOLDS, **options) -> DataFrame:
    """One row per row of docs: doc_id, held_out, score, predicted."""
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))
    model = rows.sparkSession.sparkContext.broadcast(train(rows, labels, folds, **options))

    def run(batches):
        pieces = _Pieces(model.value.weights != 0)
        for batch in lots(batches, 1):
            yield pa.RecordBatch.from_arrays([batch.column(0), _scores(model.value, pieces, batch.column(1))], names=["doc_id", "score"])

    scored = rows.mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", (fold(F.col("doc_id"), folds) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def _scores(model: Model, pieces: _Pieces, texts: pa.Array) -> pa.Array:
    return pa.array([model.score(x) for x in pieces.distinct(texts.to_pylist())], pa.float64())


def reject(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs without the rows predicted toxic, all columns; every row is judged by its own text."""
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))
    model = rows.sparkSession.sparkContext.broadcast(train(rows, labels, **options))
    at = [c.lower() for c in docs.columns].index(text_col.lower())

    def run(batches):
        pieces = _Pieces(model.value.weights != 0)
        for batch in lots(batches, at):
            yield batch.filter(pc.less(_scores(model.value, pieces, batch.column(at)), 0.5))

    return docs.mapInArrow(tidy(run), docs.schema)
