"""Quality rules as a learned decision list.

Sequential covering over labelled statistics: a rule for the rejected class is grown condition by condition (the threshold
of the greatest FOIL gain) on two thirds of the rows, pruned from its end on the other third, and kept if it is precise
there; the rows that it covers go, and the next rule is learned, until some draws in a row give no precise one. The ordered rules become one Spark
conditional expression: the first rule that holds rejects, a document that none holds for is kept.

The fit reads at most ``max_rows`` labelled rows (a bounded sample, by hash of the id); the rules then judge all documents.

Defined results: null and empty texts have no words and fail the base. Without labels of both classes the list is empty
and keeps all. Rows are judged independently, so repeated rows get a row each, and ids (null ones too) don't matter; an empty
table gives no rows. Other columns stay as they are.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pointweave.llm.common import unclaimed
from pointweave.llm.labelled import training_rows
from pointweave.llm.stats import RATIOS, count_column, ratio_columns

NAMES = list(RATIOS)


@dataclass(frozen=True)
class Condition:
    feature: int
    above: bool
    threshold: float

    def holds(self, x: np.ndarray) -> np.ndarray:
        return x[:, self.feature] > self.threshold if self.above else x[:, self.feature] <= self.threshold

    def column(self, ratios: dict[str, Column]) -> Column:
        value = ratios[NAMES[self.feature]]
        return value > F.lit(self.threshold) if self.above else value <= F.lit(self.threshold)

    def __str__(self) -> str:
        return f"{NAMES[self.feature]} {'>' if self.above else '<='} {self.threshold:.6g}"


def thresholds(x: np.ndarray, n: int) -> list[Condition]:
    """Conditions at the middles between neighbouring quantiles of each feature."""
    out = []
    for k in range(x.shape[1]):
        cuts = np.unique(np.quantile(x[:, k], np.linspace(0, 1, n + 1), method="nearest"))
        for t in ((cuts[1:] + cuts[:-1]) / 2).tolist():
            out += [Condition(k, True, t), Condition(k, False, t)]
    return out


def grow(held: np.ndarray, bad: np.ndarray, max_conditions: int) -> list[int]:
    """held: whether each condition (row) holds for each document. The conditions of a rule, in order."""
    covered, rule = np.ones(len(bad), bool), []
    while len(rule) < max_conditions:
        p0, n0 = (covered & bad).sum(), (covered & ~bad).sum()
        if n0 == 0:
            break
        p = (held[:, covered & bad]).sum(axis=1)
        n = (held[:, covered & ~bad]).sum(axis=1)
        gain = p * (np.log2((p + 1e-9) / np.maximum(p + n, 1)) - np.log2(p0 / (p0 + n0)))
        best = int(np.argmax(gain))
        if gain[best] <= 1e-6 or best in rule:
            break
        rule.append(best)
        covered &= held[best]
    return rule


def covers(held: np.ndarray, bad: np.ndarray, rule: list[int]) -> tuple[int, int]:
    """How many bad and other documents the rule covers."""
    covered = np.logical_and.reduce(held[rule], axis=0)
    return int((covered & bad).sum()), int((covered & ~bad).sum())


def learn(x: np.ndarray, bad: np.ndarray, *, n_thresholds: int = 64, max_rules: int = 16, max_conditions: int = 3, min_precision: float = 0.95, min_cover: int = 3, max_tries: int = 4, seed: int = 7) -> list[list[Condition]]:
    """The ordered rules, each a conjunction that rejects."""
    rules: list[list[Condition]] = []
    if not len(x) or bad.all() or not bad.any():
        return rules
    conditions = thresholds(x, n_thresholds)
    # where bad documents are rare, quantiles of their own as well
    conditions = list(dict.fromkeys(conditions + thresholds(x[bad], n_thresholds // 2)))
    held = np.stack([c.holds(x) for c in conditions])
    rng, tries = np.random.default_rng(seed), 0
    left = np.ones(len(x), bool)
    while len(rules) < max_rules and tries < max_tries and (bad & left).any():
        growing = rng.random(len(x)) < 2 / 3  # dealt anew for each rule and after a rule that wasn't precise
        tries += 1
        a, b = left & growing, left & ~growing
        rule = grow(held[:, a], bad[a], max_conditions) if (bad & a).any() else []
        if not rule:
            continue
        cuts = [rule[:k] for k in range(len(rule), 0, -1)]
        worth = [(p - n) / max(1, p + n) for p, n in (covers(held[:, b], bad[b], r) for r in cuts)]
        best = cuts[int(np.argmax(worth))]  # of equal ones the longest, which rejects least
        p, n = covers(held[:, left], bad[left], best)
        unseen_p, unseen_n = covers(held[:, b], bad[b], best)
        if p < min_cover or p < min_precision * (p + n) or unseen_p < min_precision * (unseen_p + unseen_n):
            continue
        tries = 0
        rules.append(simplified([conditions[k] for k in best]))
        left &= ~np.logical_and.reduce(held[best], axis=0)
    return rules


def simplified(rule: list[Condition]) -> list[Condition]:
    """The same rule without conditions that another one of the same feature and direction implies."""
    tight: dict[tuple[int, bool], Condition] = {}
    for c in rule:
        other = tight.get((c.feature, c.above))
        if other is None or (c.threshold > other.threshold) == c.above:
            tight[c.feature, c.above] = c
    return list(tight.values())


def keeps(rules: list[list[Condition]], ratios: dict[str, Column]) -> Column:
    """The ordered conditional expression: true where no rule rejects."""
    if not rules:
        return F.lit(True)
    chain = None
    for rule in rules:
        holds = reduce(lambda a, b: a & b, (c.column(ratios) for c in rule))
        chain = F.when(holds, F.lit(False)) if chain is None else chain.when(holds, F.lit(False))
    return chain.otherwise(F.lit(True))


def base_failed(counted: str, min_words: int = 50, repeat_percent: int = 50) -> Column:
    """Too few words, or too many in repeated windows, by the struct of counts."""
    n = F.col(f"{counted}.n_words")
    return (n < min_words) | (100 * F.col(f"{counted}.n_repeat_words") > repeat_percent * n)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", *, max_rows: int = 20_000, **base) -> list[list[Condition]]:
    """Rules for what the base passes: documents that fail it aren't learned from. base: as for ``judged``."""
    x, label = training_rows(docs, labels, id_col, text_col, label_col, max_rows, lambda counted: base_failed(counted, **base))
    return learn(x, label == 0)


def judged(docs: DataFrame, rules: list[list[Condition]], text_col: str = "text", counted: str = "counts", out: str = "kept", base: str = "base_failed", *, min_words: int = 50, repeat_percent: int = 50) -> DataFrame:
    """docs with the struct ``counted``, ``base`` (too few words, or too many in repeated windows) and ``out``; a column of docs
    that has one of these names is an error."""
    unclaimed(docs, counted, out, base)
    df = docs.withColumn(counted, count_column(F.col(text_col)))
    df = df.withColumn(base, base_failed(counted, min_words, repeat_percent))
    return df.withColumn(out, ~F.col(base) & keeps(rules, ratio_columns(counted)))
