"""Quality classifier: a sparse rule ensemble.

Boosted shallow trees over text statistics give rules, the conjunctions along their paths; a logistic regression with an
L1 penalty (FISTA) weighs the rules and leaves most at zero; what is left is one sum of Spark conditional expressions, so
scoring costs the statistics alone. The strength of the penalty is chosen on a part of the training rows.

The fit reads at most ``max_rows`` labelled rows that are not held out (crc32 of the id as text, mod 5, is not 0); every
document is scored. Inputs of a score are ratios of counts of the text only.

Defined results: null and empty texts score by their zero counts. Without labels of both classes every score is the share
of label 1, or 0.5 without labels. A null id is not held out. Repeated rows get a row each; other columns don't matter.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pointweave.llm.common import unclaimed
from pointweave.llm.labelled import training_rows
from pointweave.llm.rulelists import Condition
from pointweave.llm.stats import count_column, ratio_columns

Rule = tuple[Condition, ...]


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def bins(x: np.ndarray, n: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Each value's bin, and the thresholds between a feature's bins: bin > k is value > threshold k."""
    cuts = []
    for column in x.T:
        at = np.unique(np.quantile(column, np.linspace(0, 1, n + 1), method="nearest"))
        cuts.append((at[1:] + at[:-1]) / 2)
    return np.stack([np.searchsorted(c, v, side="left") for c, v in zip(cuts, x.T, strict=True)], axis=1), cuts


def tree(binned: np.ndarray, cuts: list[np.ndarray], gradient: np.ndarray, weight: np.ndarray, depth: int, min_leaf: int) -> tuple[list[Rule], np.ndarray]:
    """The rules of all nodes below the root, and each row's Newton step."""
    rules: list[Rule] = []
    step = np.zeros(len(binned))

    def node(rows: np.ndarray, path: Rule) -> None:
        g, h = gradient[rows].sum(), weight[rows].sum()
        best = (1e-6, -1, -1)
        if len(path) < depth:
            for k, cut in enumerate(cuts):
                if not len(cut):
                    continue
                size = len(cut) + 1
                gs = np.cumsum(np.bincount(binned[rows, k], gradient[rows], size))[:-1]
                hs = np.cumsum(np.bincount(binned[rows, k], weight[rows], size))[:-1]
                ns = np.cumsum(np.bincount(binned[rows, k], minlength=size))[:-1]
                gain = gs**2 / (hs + 1) + (g - gs) ** 2 / (h - hs + 1) - g**2 / (h + 1)
                gain[(ns < min_leaf) | (len(rows) - ns < min_leaf)] = -1
                at = int(np.argmax(gain))
                best = max(best, (float(gain[at]), -k, -at))
        if best[1:] == (-1, -1) and best[0] <= 1e-6:
            step[rows] = g / (h + 1)
            return
        k, at = -best[1], -best[2]
        above = binned[rows, k] > at
        for side in (True, False):
            rule = (*path, Condition(k, side, float(cuts[k][at])))
            rules.append(rule)
            node(rows[above == side], rule)

    node(np.arange(len(binned)), ())
    return rules, step


def simple(rule: Rule) -> Rule:
    """Of conditions on the same side of a feature, the strictest."""
    tight: dict[tuple[int, bool], float] = {}
    for c in rule:
        key = c.feature, c.above
        tight[key] = max(tight.get(key, c.threshold), c.threshold) if c.above else min(tight.get(key, c.threshold), c.threshold)
    return tuple(Condition(f, a, t) for (f, a), t in sorted(tight.items()))


def holds(rules: list[Rule], x: np.ndarray) -> np.ndarray:
    return np.stack([reduce(np.logical_and, (c.holds(x) for c in r)) for r in rules], axis=1).astype(float) if rules else np.zeros((len(x), 0))


def lasso(a: np.ndarray, y: np.ndarray, penalty: float, steps: int = 250) -> tuple[float, np.ndarray]:
    """Intercept and weights of the L1-penalised logistic loss, by FISTA."""
    n, m = a.shape
    w, b = np.zeros(m), float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
    top = np.ones(m)
    for _ in range(20):  # the greatest singular value, by powers
        top = a.T @ (a @ top)
        top /= max(1e-12, np.linalg.norm(top))
    speed = 4 * n / (1.1 * np.linalg.norm(a @ top) ** 2 + n)
    v, c, t = w.copy(), b, 1.0
    for _ in range(steps):
        r = (sigmoid(a @ v + c) - y) / n
        new_w, new_b = v - speed * (a.T @ r), c - speed * r.sum()
        new_w = np.sign(new_w) * np.maximum(np.abs(new_w) - speed * penalty, 0)
        new_t = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, c = new_w + (t - 1) / new_t * (new_w - w), new_b + (t - 1) / new_t * (new_b - b)
        w, b, t = new_w, new_b, new_t
    return float(b), w


class Ensemble:
    """intercept and (rule, weight) pairs."""

    def __init__(self, intercept: float, terms: list[tuple[Rule, float]]):
        self.intercept, self.terms = intercept, terms

    def scores(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(self.intercept + holds([r for r, _ in self.terms], x) @ np.array([w for _, w in self.terms]))

    def column(self, ratios: dict[str, Column]) -> Column:
        terms = [F.when(reduce(lambda a, b: a & b, (c.column(ratios) for c in r)), F.lit(w)).otherwise(F.lit(0.0)) for r, w in self.terms]
        total = F.lit(self.intercept)
        for k in range(0, len(terms), 8):
            total = total + reduce(lambda a, b: a + b, terms[k : k + 8])
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def learn(x: np.ndarray, y: np.ndarray, *, n_trees: int = 20, depth: int = 3, n_bins: int = 48, rate: float = 0.3, min_leaf: int = 8, max_rules: int = 160, penalties: tuple[float, ...] = (0.003, 0.001, 0.0003), seed: int = 11) -> Ensemble:
    if not len(y) or y.min() == y.max():
        share = y.mean() if len(y) else 0.5
        return Ensemble(float(np.log((share + 1e-6) / (1 - share + 1e-6))), [])
    rng = np.random.default_rng(seed)
    binned, cuts = bins(x, n_bins)
    z, found = np.full(len(y), np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6))), {}
    for _ in range(n_trees):
        p = sigmoid(z)
        rows = rng.random(len(y)) < 0.6
        columns = rng.random(x.shape[1]) < 0.7
        some = [c if on else c[:0] for c, on in zip(cuts, columns, strict=True)]
        rules, _ = tree(binned[rows], some, (y - p)[rows], (p * (1 - p))[rows], depth, min_leaf)
        for rule in map(simple, rules):
            found.setdefault(rule, None)
        # the step of all rows, from the leaves of this tree
        leaves = [r for r in rules if len(r) == depth or not any(o[: len(r)] == r and len(o) > len(r) for o in rules)]
        for leaf in leaves:
            at = reduce(np.logical_and, (c.holds(x) for c in leaf))
            z[at] += rate * (y - p)[at].sum() / ((p * (1 - p))[at].sum() + 1)
    rules = list(found)
    a = holds(rules, x)
    same: dict[bytes, int] = {}  # rules that hold for the same rows count once
    for k in range(len(rules)):
        same.setdefault(np.packbits(a[:, k] > 0).tobytes(), k)
    first = sorted(same.values())
    a, rules = np.ascontiguousarray(a[:, first]), [rules[k] for k in first]
    train = rng.random(len(y)) < 0.8
    if train.all() or not train.any() or y[train].min() == y[train].max():
        train[:] = True
    test = ~train if (~train).any() else train
    losses = []
    for penalty in penalties:
        b, w = lasso(a[train], y[train], penalty, 150)
        p = np.clip(sigmoid(a[test] @ w + b), 1e-6, 1 - 1e-6)
        losses.append(-(y[test] * np.log(p) + (1 - y[test]) * np.log(1 - p)).mean())
    b, w = lasso(a, y, penalties[int(np.argmin(losses))])
    top = sorted(np.flatnonzero(np.abs(w) > 1e-4), key=lambda k: -abs(w[k]))[:max_rules]
    b, w = lasso(a[:, top], y, penalties[int(np.argmin(losses))])
    return Ensemble(b, [(rules[k], float(v)) for k, v in zip(top, w, strict=True) if abs(v) > 1e-4])


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", *, max_rows: int = 12_000) -> Ensemble:
    x, label = training_rows(docs, labels, id_col, text_col, label_col, max_rows)
    return learn(x, (label > 0).astype(float))


def scored(docs: DataFrame, model: Ensemble, text_col: str = "text", counted: str = "counts", out: str = "score") -> DataFrame:
    """docs with the struct ``counted`` and the score in ``out``; a column of docs that has one of these names is an error."""
    unclaimed(docs, counted, out)
    return docs.withColumn(counted, count_column(F.col(text_col))).withColumn(out, model.column(ratio_columns(counted)))
