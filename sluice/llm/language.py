"""Language identification in two steps: family, then closely related languages within it.

A text is the bag of the character 1- to 4-grams of its words, hashed and counted over
the whole text. Families are found from the training texts: the languages' mean vectors
are merged, closest pair first, into about as many groups as the square root of the
number of languages. One-versus-one linear support vector machines (squared hinge loss)
choose the family, then the language within it, by votes and then by margins.

Fitting takes about `per_language` texts of each language, `most` at most in all, picked
by a hash of their ids; of more than `most` languages it takes the most frequent. It reads text and lang of the training fold alone; prediction
reads text alone. A text that is null or without a letter is `und` with score 0. Rows
without a language are predicted but not learned from. Without any training text all
texts are `und`. Repeated rows are predicted each, extra columns are ignored, an empty
table gives an empty result.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold, lots

#: SCALE brings vectors of gram shares to about length 1.
DIM, PER_LANGUAGE, MOST, FOLDS, HELD, SCALE = 4_096, 500, 8_000, 4, 2, 12.0
_NO_DIGITS = re.compile(r"[^\W\d_]+")


class _Grams(dict):
    """Gram -> its place among DIM; emptied when full."""

    def __missing__(self, gram: str) -> int:
        if len(self) >= 300_000:
            self.clear()
        self[gram] = place = xxhash.xxh32_intdigest(gram.encode("utf-32-le", "surrogatepass")) % DIM
        return place


_places = _Grams()


def letters(text: str) -> list[str]:
    """The runs of letters of a lower-cased text; numerals such as fractions are no letters."""
    found = _NO_DIGITS.findall(text)
    if all(map(str.isalpha, found)):
        return found
    return [w for x in found for w in "".join(c if c.isalpha() else " " for c in x).split()]


def grams(word: str) -> list[int]:
    padded = f"^{word}$"
    n = len(padded)
    return [_places[padded[i : i + size]] for size in (1, 2, 3, 4) for i in range(n - size + 1)]


def vector(text: str | None) -> np.ndarray | None:
    """Gram counts of a text over their sum, times SCALE; None if it has no letter."""
    counts: dict[str, int] = {}
    for w in letters((text or "").lower()):
        counts[w] = counts.get(w, 0) + 1
    if not counts:
        return None
    out = np.zeros(DIM)
    for w, n in counts.items():
        np.add.at(out, grams(w), n)
    return out / out.sum() * SCALE


def svm(x: np.ndarray, y: np.ndarray, cost: float = 10.0, steps: int = 80) -> tuple[np.ndarray, float]:
    """Weights and bias of a linear classifier for y in {-1, 1}: accelerated descent on the squared hinge."""
    n = len(y)
    balance = np.where(y > 0, n / (2 * max((y > 0).sum(), 1)), n / (2 * max((y < 0).sum(), 1)))
    w, b = np.zeros(x.shape[1], np.float32), 0.0
    vw, vb = w.copy(), b
    rate = 1 / (1 + 4 * cost)
    for k in range(steps):
        slack = np.maximum(0, 1 - y * (x @ vw + vb)) * balance
        gw = vw - 2 * cost / n * (x.T @ (slack * y).astype(np.float32))
        gb = -2 * cost / n * float((slack * y).sum())
        nw, nb = vw - rate * gw, vb - rate * gb
        vw, vb = nw + k / (k + 3) * (nw - w), nb + k / (k + 3) * (nb - b)
        w, b = nw, nb
    return w, float(b)


def families(centres: dict[str, np.ndarray]) -> list[list[str]]:
    """Groups of languages, closest mean vectors merged first (average linkage)."""
    groups = [[k] for k in sorted(centres)]
    near = lambda g, h: float(np.mean([centres[a] @ centres[b] / (np.linalg.norm(centres[a]) * np.linalg.norm(centres[b])) for a in g for b in h]))
    while len(groups) > max(1, round(len(centres) ** 0.5)):
        i, j = max(combinations(range(len(groups)), 2), key=lambda p: near(groups[p[0]], groups[p[1]]))
        groups[i] += groups.pop(j)
    return [sorted(g) for g in groups]


@dataclass
class Model:
    groups: list[list[str]]
    pairs: list[tuple[tuple, tuple]]  # the two sides of each classifier, families or languages
    weights: np.ndarray
    biases: np.ndarray

    def choose(self, options: list[tuple], margins: np.ndarray) -> tuple[tuple, float]:
        votes, sums, least = dict.fromkeys(options, 0), dict.fromkeys(options, 0.0), dict.fromkeys(options, 20.0)
        for (a, b), z in zip(self.pairs, margins, strict=True):
            if a in votes and b in votes:
                votes[a if z >= 0 else b] += 1
                for side, s in ((a, z), (b, -z)):
                    sums[side] += s
                    least[side] = min(least[side], s)
        best = max(options, key=lambda o: (votes[o], sums[o]))
        return best, 1 / (1 + np.exp(-3 * least[best]))

    def predict(self, margins: np.ndarray) -> tuple[str, float]:
        family, p = self.choose([tuple(g) for g in self.groups], margins)
        if len(family) == 1:
            return family[0], float(p)
        language, q = self.choose([(x,) for x in family], margins)
        return language[0], float(p * q)


def fit(samples: list[tuple[str, np.ndarray]]) -> Model | None:
    if not samples:
        return None
    names = np.array([s[0] for s in samples])
    x = np.stack([s[1] for s in samples]).astype(np.float32)
    groups = families({n: x[names == n].mean(axis=0) for n in sorted(set(names))})
    pairs, weights, biases = [], [np.zeros(DIM)], [0.0]
    units = [[tuple(g) for g in groups], *([(n,) for n in g] for g in groups)]
    for options in units:
        for a, b in combinations(options, 2):
            if (a, b) in pairs:
                continue
            rows = np.isin(names, [*a, *b])
            w, bias = svm(x[rows], np.where(np.isin(names[rows], a), 1.0, -1.0).astype(np.float32))
            pairs.append((a, b)), weights.append(w), biases.append(bias)
    return Model(groups, pairs, np.stack(weights[1:] or [np.zeros(DIM)]), np.array(biases[1:] or [0.0]))


def train(docs: DataFrame, folds: int = FOLDS, held: int = HELD, per_language: int = PER_LANGUAGE, most: int = MOST) -> Model | None:
    """docs: doc_id, text, lang."""
    usable = docs.filter((fold(F.col("doc_id"), folds) != held) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = {r[0]: r[1] for r in usable.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(most).collect()}
    if not counts:
        return None
    each = max(1, min(per_language, most // len(counts)))
    limits = F.create_map(*[F.lit(v) for k, n in counts.items() for v in (k, int(min(1.0, each / n) * (1 << 30)))])
    picked = usable.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < limits[F.col("lang")]).select("lang", "text")

    def run(batches):
        for batch in batches:
            got = [(n, v.astype("<f2").tobytes()) for n, v in zip(batch.column(0).to_pylist(), map(vector, batch.column(1).to_pylist()), strict=True) if v is not None]
            yield pa.RecordBatch.from_arrays([pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.binary())], names=["lang", "x"])

    return fit(sorted(((r[0], np.frombuffer(r[1], "<f2").astype(np.float32)) for r in picked.mapInArrow(run, "lang string, x binary").collect()), key=lambda s: s[0]))


class _Pieces(dict):
    """White-space separated piece -> float32 bytes: the margins of its grams, and their number."""

    def __init__(self, model: Model, limit: int = 500_000):
        self.weights, self.limit = np.ascontiguousarray(model.weights.T, np.float32), limit

    def learn(self, pieces: set[str], together: int = 2_000) -> None:
        """Takes up the pieces that are new, many at a time; empties itself first if they are too many."""
        new = [p for p in pieces if p not in self]
        if len(self) + len(new) > self.limit:
            self.clear()
            new = list(pieces)
        for first in range(0, len(new), together):
            lot = new[first : first + together]
            ids = [[g for w in letters(p.lower()) for g in grams(w)] for p in lot]
            counts = np.array([len(x) for x in ids])
            rows = np.zeros((len(lot), self.weights.shape[1] + 1), "<f4")
            rows[:, -1] = counts
            some = counts > 0
            if some.any():
                begin = np.cumsum(counts) - counts
                rows[some, :-1] = np.add.reduceat(self.weights[np.array([g for x in ids for g in x])], begin[some], axis=0)
            self.update(zip(lot, map(bytes, rows), strict=True))


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", folds: int = FOLDS, held: int = HELD, **options) -> DataFrame:
    """One row per row of docs: doc_id, held_out, lang_pred, score."""
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"), docs[lang_col].alias("lang"))
    model = rows.sparkSession.sparkContext.broadcast(train(rows, folds, held, **options))

    def run(batches):
        m = model.value
        pieces = _Pieces(m) if m else None
        for batch in lots(batches, 1):
            langs, scores = [], []
            split = [t.split() if m and t else [] for t in batch.column(1).to_pylist()]
            if m:
                pieces.learn(set().union(*split))
            for words in split:
                got = ("und", 0.0)
                if words:
                    flat = np.frombuffer(b"".join(map(pieces.__getitem__, words)), "<f4").reshape(-1, len(m.biases) + 1)
                    total = flat.sum(axis=0, dtype=np.float64)
                    if total[-1]:
                        got = m.predict(total[:-1] / total[-1] * SCALE + m.biases)
                langs.append(got[0]), scores.append(got[1])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "lang_pred", "score"])

    found = rows.select("doc_id", "text").mapInArrow(run, "doc_id long, lang_pred string, score double")
    return found.select("doc_id", (fold(F.col("doc_id"), folds) == held).alias("held_out"), "lang_pred", "score")
