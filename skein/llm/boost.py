"""Gradient boosted trees over binned features, scored as plain SQL expressions.

Training needs only the counts of labels per combination of feature bins. They come from one
grouped aggregation whose result is bounded by the product of the bins, so boosting itself is
a small driver computation; scoring is a sum of CASE expressions that Catalyst compiles.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Most combinations of bins that may come to the driver.
CELLS = 20_000


@dataclass(frozen=True)
class Leaf:
    value: float


@dataclass(frozen=True)
class Split:
    """Rows whose ``feature`` is at most ``cut`` go left."""

    feature: str
    cut: int
    left: Leaf | Split
    right: Leaf | Split


@dataclass(frozen=True)
class Model:
    """``steps`` are (least score, probability) of the calibrated levels, ascending."""

    trees: tuple[Leaf | Split, ...]
    threshold: float
    steps: tuple[tuple[float, float], ...] = ()

    def total(self, row: dict[str, int]) -> float:
        return sum(_leaf(t, row) for t in self.trees)


def cells(examples: DataFrame, features: list[str], label: str) -> list[tuple[tuple[int, ...], int, int]]:
    """(bins, positives, negatives) per combination of bins."""
    rows = examples.groupBy(*features).agg(F.sum(F.col(label).cast("long")).alias("_p"), F.count("*").alias("_n")).orderBy(*features).limit(CELLS + 1).collect()
    if len(rows) > CELLS:
        raise ValueError(f"over {CELLS} combinations of feature bins")
    return [(tuple(r[f] for f in features), r["_p"], r["_n"] - r["_p"]) for r in rows]


Cells = list[tuple[tuple[int, ...], int, int]]


def fit(table: Cells, features: list[str], trees: int = 12, depth: int = 3, rate: float = 0.5) -> Model:
    """Logistic loss, Newton leaves; selects nothing before ``calibrated``."""
    scores = [0.0] * len(table)
    made: list[Leaf | Split] = []
    for _ in range(trees):
        grads = []
        for (_, p, n), s in zip(table, scores, strict=True):
            q = 1 / (1 + math.exp(-s))
            grads.append((p * (1 - q) - n * q, (p + n) * q * (1 - q)))
        tree = _grow(table, grads, features, list(range(len(table))), depth, rate)
        made.append(tree)
        scores = [s + _leaf(tree, dict(zip(features, row[0], strict=True))) for row, s in zip(table, scores, strict=True)]
    return Model(tuple(made), math.inf)


def calibrated(model: Model, table: Cells, features: list[str], least: float = 0.9) -> Model:
    """The model with isotonic probabilities of held-out rows, selecting from probability ``least`` on."""
    scored = sorted((model.total(dict(zip(features, row, strict=True))), p, n) for row, p, n in table)
    levels: list[list[float]] = []  # least score, positives, rows
    for s, p, n in scored:
        if levels and s == levels[-1][0]:
            levels[-1][1] += p
            levels[-1][2] += p + n
        else:
            levels.append([s, p, p + n])
        while len(levels) > 1 and levels[-2][1] * levels[-1][2] >= levels[-1][1] * levels[-2][2]:
            _, p_last, n_last = levels.pop()
            levels[-1][1] += p_last
            levels[-1][2] += n_last
    steps = tuple((s, p / n) for s, p, n in levels)
    chosen = [s for s, q in steps if q >= least]
    return Model(model.trees, chosen[0] - 1e-9 if chosen else math.inf, steps)


def _grow(table, grads, features, rows, depth, rate):
    g, h = sum(grads[i][0] for i in rows), sum(grads[i][1] for i in rows)
    leaf = Leaf(round(rate * g / (h + 1.0), 9))
    if not depth or len(rows) < 2:
        return leaf
    best = (1e-6, None)
    for f in range(len(features)):
        sums: dict[int, list[float]] = {}
        for i in rows:
            s = sums.setdefault(table[i][0][f], [0.0, 0.0])
            s[0] += grads[i][0]
            s[1] += grads[i][1]
        gl = hl = 0.0
        for v in sorted(sums)[:-1]:
            gl, hl = gl + sums[v][0], hl + sums[v][1]
            gain = gl * gl / (hl + 1) + (g - gl) ** 2 / (h - hl + 1) - g * g / (h + 1)
            if gain > best[0]:
                best = (gain, (f, v))
    if best[1] is None:
        return leaf
    f, v = best[1]
    parts = [i for i in rows if table[i][0][f] <= v], [i for i in rows if table[i][0][f] > v]
    return Split(features[f], v, *(_grow(table, grads, features, part, depth - 1, rate) for part in parts))


def _leaf(tree: Leaf | Split, row: dict[str, int]) -> float:
    while isinstance(tree, Split):
        tree = tree.left if row[tree.feature] <= tree.cut else tree.right
    return tree.value


def _expression(tree: Leaf | Split, of: Column) -> Column:
    if isinstance(tree, Leaf):
        return F.lit(tree.value)
    return F.when(of.getField(tree.feature) <= tree.cut, _expression(tree.left, of)).otherwise(_expression(tree.right, of))


def score(model: Model, of: Column) -> Column:
    """The score of a struct of feature bins."""
    total = F.lit(0.0)
    for tree in model.trees:
        total = total + _expression(tree, of)
    return total
