"""Quality classifier: rules from tree paths, weighted by a lasso logistic fit, compiled into one Spark column."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .textstats import FEATURES, labelled, with_stats

#: (feature number, at least, threshold)
Condition = tuple[int, bool, float]


@dataclass(frozen=True)
class Ensemble:
    intercept: float
    rules: tuple[tuple[tuple[Condition, ...], float], ...]

    def column(self) -> Column:
        """The score as one expression of FEATURES' columns."""
        z = F.lit(self.intercept)
        for conditions, weight in self.rules:
            hold = F.lit(True)
            for f, at_least, t in conditions:
                c = F.col(FEATURES[f])
                hold = hold & (c >= F.lit(t) if at_least else c < F.lit(t))
            z = z + F.when(hold, F.lit(weight)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.intercept)
        for conditions, weight in self.rules:
            z += weight * _holds(conditions, x)
        return 1 / (1 + np.exp(-z))


def _holds(conditions: tuple[Condition, ...], x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), bool)
    for f, at_least, t in conditions:
        out &= x[:, f] >= t if at_least else x[:, f] < t
    return out


def _tree(x: np.ndarray, r: np.ndarray, rows: np.ndarray, cuts: list[np.ndarray], depth: int, least: int, path: tuple, paths: list, f_out: np.ndarray) -> None:
    """Grow a regression tree on the residuals r; paths gets the conjunction of every node below the root."""
    best = None
    if depth and len(rows) >= 2 * least:
        y = r[rows]
        for f, c in enumerate(cuts):
            if not len(c):
                continue
            at = np.searchsorted(c, x[rows, f], "right")
            n, s = np.bincount(at, minlength=len(c) + 1), np.bincount(at, weights=y, minlength=len(c) + 1)
            nl, sl = np.cumsum(n)[:-1], np.cumsum(s)[:-1]
            nr, sr = len(rows) - nl, y.sum() - sl
            gain = np.where((nl >= least) & (nr >= least), sl**2 / np.maximum(nl, 1) + sr**2 / np.maximum(nr, 1), -1)
            k = int(gain.argmax())
            if gain[k] >= 0 and (best is None or gain[k] > best[0]):
                best = (gain[k], f, float(c[k]))
    if best is None or best[0] <= r[rows].sum() ** 2 / max(len(rows), 1) + 1e-12:
        f_out[rows] += 0.3 * r[rows].mean() if len(rows) else 0
        return
    _, f, t = best
    up = x[rows, f] >= t
    for at_least, part in ((False, rows[~up]), (True, rows[up])):
        # A later bound on a feature replaces a wider one of the same side.
        own = tuple(c for c in path if c[:2] != (f, at_least)) + ((f, at_least, t),)
        paths.append(own)
        _tree(x, r, part, cuts, depth - 1, least, own, paths, f_out)


def _lasso(m: np.ndarray, y: np.ndarray, penalty: float, steps: int = 250) -> tuple[float, np.ndarray]:
    """Logistic loss + penalty * |w|, by proximal gradient with momentum. The intercept isn't penalised."""
    n, k = m.shape
    rate = 4 * n / (np.linalg.norm(np.hstack([m, np.ones((n, 1))]), 2) ** 2 + 1e-12)
    w = v = np.zeros(k)
    b = c = 0.0
    t = 1.0
    for _ in range(steps):
        g = 1 / (1 + np.exp(-(m @ v + c))) - y
        new = v - rate * (m.T @ g) / n
        new = np.sign(new) * np.maximum(np.abs(new) - rate * penalty, 0)
        nb, s = c - rate * g.mean(), (1 + (1 + 4 * t * t) ** 0.5) / 2
        v, c = new + (t - 1) / s * (new - w), nb + (t - 1) / s * (nb - b)
        w, b, t = new, nb, s
    return b, w


def fit(rows: list, trees: int = 24, depth: int = 3, bins: int = 32, least: int = 10, penalty: float = 2e-3, seed: int = 7) -> Ensemble:
    """rows: FEATURES and _y.  With no rows the score is 1/2; with one class it is that class's share, smoothed."""
    rows = sorted(rows, key=lambda r: (r["_id"], r["_y"]))
    x = np.array([[r[f] for f in FEATURES] for r in rows], float).reshape(-1, len(FEATURES))
    y = np.array([1.0 if r["_y"] == 1 else 0.0 for r in rows])
    prior = (y.sum() + 1) / (len(y) + 2)
    start = float(np.log(prior / (1 - prior)))
    if len(set(y)) < 2:
        return Ensemble(start, ())
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(x.shape[1])]
    draw, z, paths = np.random.default_rng(seed), np.full(len(y), start), []
    for _ in range(trees):
        r = y - 1 / (1 + np.exp(-z))
        part = np.sort(draw.permutation(len(y))[: max(2 * least, len(y) // 2)])
        out = np.zeros(len(y))
        own: list = []
        _tree(x, r, part, cuts, depth, least, (), own, out)
        z += 4 * out
        paths += own
    rules = [p for p in dict.fromkeys(tuple(sorted(p)) for p in paths)]
    m = np.array([_holds(p, x) for p in rules], float).T
    # Rules that hold for the same rows count once.
    seen: dict[bytes, int] = {}
    chosen = [seen.setdefault(m[:, k].tobytes(), k) == k and 0 < m[:, k].mean() < 1 for k in range(m.shape[1])]
    rules, m = [p for p, c in zip(rules, chosen, strict=True) if c], m[:, chosen]
    if not rules:
        return Ensemble(start, ())
    b, w = _lasso(m, y, penalty)
    return Ensemble(float(b), tuple((p, float(v)) for p, v in zip(rules, w, strict=True) if abs(v) > 1e-6))


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3 == 1


def score(docs: DataFrame, labels: DataFrame, most_labels: int = 20_000) -> DataFrame:
    """One row for each row of docs: doc_id, held_out, score, predicted.

    The ensemble is fitted on at most ``most_labels`` labelled documents that
    aren't held out (crc32 of the doc_id as text, modulo 3, is not 1), and
    scores every text as one column expression in the scan's projection, without
    a shuffle.  Its inputs are statistics of the text alone.

    Null text: scored as empty.  Null doc_id: as the empty string for the fold.
    Repeated rows: scored alike.  Empty labels: every score is 1/2.  Empty
    documents: empty result.  Other columns are not read.
    """
    learn = labels.where(~held_out(labels["doc_id"]))
    model = fit(labelled(docs, learn, most_labels))
    stats = with_stats(docs.select(docs["doc_id"].alias("doc_id"), docs["text"].alias("text")), ["doc_id"])
    scored = stats.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), model.column().alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
