"""Gradient-boosted trees over counted feature cells, and their scores as SQL expressions."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

Row = tuple[int, ...]


@dataclass
class Node:
    """A split "feature <= cut" or, without children, a value."""

    value: float = 0.0
    feature: int = -1
    cut: int = 0
    low: "Node | None" = None
    high: "Node | None" = None

    def score(self, row: Row) -> float:
        node = self
        while node.low is not None:
            node = node.low if row[node.feature] <= node.cut else node.high
        return node.value

    def expression(self, columns: list[Column]) -> Column:
        if self.low is None:
            return F.lit(self.value)
        return F.when(columns[self.feature] <= self.cut, self.low.expression(columns)).otherwise(self.high.expression(columns))


def _grow(cells: list[tuple[Row, float, float]], depth: int, shrink: float, damp: float) -> Node:
    """cells: features, gradient, curvature."""
    g, h = sum(c[1] for c in cells), sum(c[2] for c in cells)
    best, gain = None, 1e-6
    if depth:
        for f in range(len(cells[0][0])):
            sums: dict[int, list[float]] = {}
            for row, a, b in cells:
                x = sums.setdefault(row[f], [0.0, 0.0])
                x[0] += a
                x[1] += b
            a = b = 0.0
            for cut in sorted(sums)[:-1]:
                a, b = a + sums[cut][0], b + sums[cut][1]
                won = a * a / (b + damp) + (g - a) ** 2 / (h - b + damp) - g * g / (h + damp)
                if won > gain:
                    best, gain = (f, cut), won
    if best is None:
        return Node(value=round(-shrink * g / (h + damp), 9))
    f, cut = best
    low, high = [c for c in cells if c[0][f] <= cut], [c for c in cells if c[0][f] > cut]
    return Node(feature=f, cut=cut, low=_grow(low, depth - 1, shrink, damp), high=_grow(high, depth - 1, shrink, damp))


@dataclass
class Boosted:
    trees: list[Node]

    def score(self, row: Row) -> float:
        return sum(t.score(row) for t in self.trees)

    def expression(self, columns: list[Column]) -> Column:
        total = F.lit(0.0)
        for t in self.trees:
            total = total + t.expression(columns)
        return total


def fit(cells: list[tuple[Row, int, int]], rounds: int = 24, depth: int = 3, shrink: float = 0.3, damp: float = 1.0) -> Boosted:
    """Logistic boosting on (features, negatives, positives) cells, so that time follows the number of cells."""
    score, trees = [0.0] * len(cells), []
    for _ in range(rounds):
        steps = []
        for (row, neg, pos), s in zip(cells, score, strict=True):
            p = 1 / (1 + math.exp(-s))
            steps.append((row, (neg + pos) * p - pos, (neg + pos) * p * (1 - p)))
        tree = _grow(steps, depth, shrink, damp)
        trees.append(tree)
        score = [s + tree.score(row) for s, (row, _, _) in zip(score, cells, strict=True)]
    return Boosted(trees)


def few_errors(wrong: int, n: int, rate: float) -> float:
    """Probability of at most so many errors among n at the given rate (binomial)."""
    log = lambda k: math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(rate) + (n - k) * math.log(1 - rate)
    return math.fsum(math.exp(log(k)) for k in range(wrong + 1))


def threshold(model: Boosted, cells: list[tuple[Row, int, int]], precision: float, risk: float) -> float:
    """The lowest score from which the precision is certain but for the risk; infinity if none is.

    Scores are tried from the highest on, the first at which cells without an error would be enough: each must have
    so few errors that at a lower precision the binomial probability of as few is at most the risk. The first score
    that fails ends the search, so the risk holds for all of them together.
    """
    scored = sorted(((model.score(row), neg, pos) for row, neg, pos in cells), reverse=True)
    least = math.ceil(math.log(risk) / math.log(precision))
    best, n, p = math.inf, 0, 0
    for i, (s, neg, pos) in enumerate(scored):
        n, p = n + neg, p + pos
        if n + p < least or i + 1 < len(scored) and scored[i + 1][0] == s:
            continue
        if few_errors(n, n + p, 1 - precision) > risk:
            break
        best = s
    return best
