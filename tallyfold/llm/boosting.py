"""Gradient-boosted trees over binned numbers, from exact sums that can be taken of any pieces of the rows in any order."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np

#: Bins of a feature; groups of rows that are dealt to the rounds; of these groups, how many a round sees of a small table.
BINS, STRATA, MOST_STRATA = 64, 20, 7
#: Sums are taken of whole multiples of one part in this many, so that they do not depend on the order of the rows.
UNIT = 2.0**30


#: Rows that walk down a tree together, few enough for a processor's cache.
WALKED = 65_536


def walked(columns: np.ndarray, feature: np.ndarray, limit: np.ndarray, most: float) -> np.ndarray:
    """The node of the level below the given ones that every row comes to, counted from 0; ``columns`` has one row per feature.

    Rows above the limit of a node go right, none where it is ``most`` or more. All nodes are compared with whole columns, and each
    level's bits are chosen by those of the levels before.
    """
    if columns.shape[1] > WALKED:
        return np.concatenate([walked(x, feature, limit, most) for x in _parts(columns)])
    # plain numbers take the type of the columns
    bits, feature, limit = [], feature.tolist(), limit.tolist()
    out, first = np.zeros(columns.shape[1], np.intp if len(feature) > 127 else np.uint8), 0
    while first < len(feature):
        # None: all go left
        above = [None if limit[i] >= most else (columns[feature[i]] > limit[i]).view(np.uint8) for i in range(first, 2 * first + 1)]
        for bit in bits:
            half = len(above) // 2
            above = [_chosen(bit, *pair) for pair in zip(above[:half], above[half:], strict=True)]
        bits.append(above[0])
        out += out
        if above[0] is not None:
            out += above[0]
        first = 2 * first + 1
    return out


def _chosen(bit: np.ndarray | None, no: np.ndarray | None, yes: np.ndarray | None) -> np.ndarray | None:
    if bit is None or yes is no is None:
        return no
    if no is None:
        return np.bitwise_and(yes, bit, out=yes)
    if yes is None:
        return np.greater(no, bit, out=no.view(bool)).view(np.uint8)
    np.bitwise_xor(yes, no, out=yes)
    np.bitwise_and(yes, bit, out=yes)
    return np.bitwise_xor(yes, no, out=yes)


def _parts(columns: np.ndarray) -> list[np.ndarray]:
    return [columns[:, i : i + WALKED] for i in range(0, columns.shape[1], WALKED)]


def added(total: np.ndarray, columns: np.ndarray, features: np.ndarray, limits: np.ndarray, values: np.ndarray, most: float) -> np.ndarray:
    """Add to ``total`` what trees say of the rows, one tree after the other."""
    at = 0
    for x in _parts(columns):
        part = total[at : at + x.shape[1]]
        for feature, limit, value in zip(features, limits, values, strict=True):
            part += value.take(walked(x, feature, limit, most).astype(np.intp))
        at += x.shape[1]
    return total


@dataclass
class Trees:
    """Complete trees of one depth: ``feature`` and ``threshold`` of the inner nodes, ``value`` of the leaves, one row per tree."""

    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray
    base: float

    def margins(self, x: np.ndarray) -> np.ndarray:
        """Log odds of rows before calibration, above zero for the label 1."""
        return self.totals(np.ascontiguousarray(np.asarray(x, np.float32).T), self.threshold, np.inf)

    def totals(self, columns: np.ndarray, limits: np.ndarray, most: float) -> np.ndarray:
        """The same of rows given as one row per feature, in other units than those of ``threshold`` (``limits``)."""
        return added(np.full(columns.shape[1], self.base), columns, self.feature, limits, self.value, most)


@dataclass
class Grown:
    """Trees on bins: ``feature`` and ``cut`` of the inner nodes (bins above the cut go right), ``value`` of the leaves."""

    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray
    base: float

    def advance(self, binned: np.ndarray, score: np.ndarray, first: int, last: int) -> np.ndarray:
        """Add what the trees from ``first`` up to ``last`` say; ``binned`` has one row per feature."""
        return added(score.copy(), binned, self.feature[first:last], self.cut[first:last], self.value[first:last], BINS)

    def trees(self, thresholds: list[np.ndarray]) -> Trees:
        """The same trees on numbers; ``thresholds`` has, per feature, the number that each cut stands for."""
        out = np.full(self.cut.shape, np.inf, np.float32)
        for at in zip(*np.nonzero(self.cut < BINS), strict=True):
            out[at] = thresholds[self.feature[at]][self.cut[at]]
        return Trees(self.feature, out, self.value, self.base)


def dealt(r: int, few: int) -> list[int]:
    """The groups of rows that a round sees: ``few`` in turn, so that all are seen equally often after every ``STRATA`` rounds."""
    return [(few * r + i) % STRATA for i in range(few)]


def slopes(score: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and second derivatives of the logistic loss in whole units."""
    p = 1 / (1 + np.exp(-score))
    return np.rint(w * (y - p) * UNIT), np.rint(w * p * (1 - p) * UNIT)


def sums(seen: np.ndarray, g: np.ndarray, h: np.ndarray, feature: np.ndarray, cut: np.ndarray, level: int) -> np.ndarray:
    """Sums of ``g`` and ``h`` by feature, node and bin; the rows go down the tree grown so far to that level.

    Below the first level only the left nodes have sums: what their parents have beyond them are those of the right ones (``whole``).
    """
    inner, count = 2**level - 1, summed_nodes(level)
    node = walked(seen, feature[:inner], cut[:inner], BINS)
    if level:
        left = np.flatnonzero((node & 1) == 0)
        seen, g, h, node = seen.take(left, axis=1), g[left], h[left], node[left] >> 1
    local = node.astype(np.intp) * BINS
    out = np.empty((2, len(seen), count * BINS))
    for j, bins in enumerate(seen):
        place = local + bins
        out[0, j], out[1, j] = np.bincount(place, g, count * BINS), np.bincount(place, h, count * BINS)
    return out.reshape(2, len(seen), count, BINS)


def summed_nodes(level: int) -> int:
    return 2 ** max(level - 1, 0)


def whole(summed: np.ndarray, above: np.ndarray | None) -> np.ndarray:
    """The sums of all nodes of a level from those of the left ones and of the level above; whole numbers, so nothing is lost."""
    return summed if above is None else np.stack([summed, above - summed], axis=3).reshape(*summed.shape[:2], -1, BINS)


def grow(histograms: Callable, cuts: list[int], base: float, rounds: int, depth: int, rate: float = 0.2, columns: float = 0.4, pull: float = 5.0, seed: int = 1) -> Grown:
    """Newton boosting of the logistic loss; every round sees its groups of rows (``dealt``) and a share of the columns.

    ``histograms(r, out, used, feature, cut, level)`` gives the ``sums`` over the rows of round ``r``, whose scores are those of the
    trees of ``out`` before ``r``; ``feature`` counts within ``used``. ``cuts`` are the numbers of cuts of the features. ``pull`` shrinks leaves with little weight.
    Equal rows give equal trees, however they are split and ordered.
    """
    rng = np.random.default_rng(seed)
    inner = 2**depth - 1
    out = Grown(np.zeros((rounds, inner), np.intp), np.full((rounds, inner), BINS, np.int32), np.zeros((rounds, inner + 1)), base)
    for r in range(rounds):
        used = np.flatnonzero(rng.random(len(cuts)) < columns)
        used = used if len(used) else np.arange(len(cuts))
        feature, cut, summed = np.zeros(inner, np.intp), np.full(inner, BINS, np.int32), None
        for level in range(depth):
            first, count = 2**level - 1, 2**level
            summed = whole(histograms(r, out, used, feature, cut, level), summed)
            a, b = summed.cumsum(-1) / UNIT
            ta, tb = a[..., -1:], b[..., -1:]
            gain = a**2 / (b + pull) + (ta - a) ** 2 / (tb - b + pull) - ta**2 / (tb + pull)
            gain[np.arange(BINS) >= np.array([cuts[j] for j in used])[:, None, None] + np.zeros((1, count, 1), int)] = -1
            flat = gain.transpose(1, 0, 2).reshape(count, -1)
            top = flat.argmax(1)
            for i in range(count):
                j, at = divmod(int(top[i]), BINS)
                if flat[i, top[i]] > 1e-6:
                    feature[first + i], cut[first + i] = j, at
                if level == depth - 1:
                    at = min(int(cut[first + i]), BINS - 1)
                    left = a[feature[first + i], i, at], b[feature[first + i], i, at]
                    right = ta[0, i, 0] - left[0], tb[0, i, 0] - left[1]
                    out.value[r, 2 * i : 2 * i + 2] = [rate * gs / (hs + pull) for gs, hs in (left, right)]
        out.feature[r], out.cut[r] = used[feature], cut
    return out


@dataclass
class Part:
    """Rows of one group in memory: bins (one row per feature), labels, weights, and their scores by the first ``known`` trees."""

    binned: np.ndarray
    y: np.ndarray
    w: np.ndarray
    score: np.ndarray | None = None
    known: int = 0


def in_memory(parts: Callable[[int], list[tuple[Part, float]]]) -> Callable:
    """``histograms`` over parts in memory; ``parts`` gives those of a round, with what their weights are multiplied by."""
    now: dict = {"round": -1, "rows": ()}

    def histograms(r: int, out: Grown, used: np.ndarray, feature: np.ndarray, cut: np.ndarray, level: int) -> np.ndarray:
        if now["round"] != r:
            seen = []
            for part, times in parts(r):
                score = np.full(len(part.y), out.base) if part.score is None else part.score
                part.score, part.known = out.advance(part.binned, score, part.known, r), r
                seen.append((part.binned[used], *slopes(part.score, part.y, part.w * times)))
            now["round"], now["rows"] = r, [np.concatenate(x, axis=-1) for x in zip(*seen, strict=True)]
        return sums(*now["rows"], feature, cut, level) if now["rows"] else np.zeros((2, len(used), summed_nodes(level), BINS))

    return histograms


def boost(x: np.ndarray, y: np.ndarray, w: np.ndarray, rounds: int, depth: int, seed: int = 1) -> Trees:
    """Trees fitted to all rows of a table of numbers in memory; ``w`` weighs the rows (its mean should be about 1)."""
    edges = [np.unique(np.quantile(column, np.linspace(0, 1, BINS + 1)[1:-1], method="lower")) for column in x.T]
    binned = np.stack([np.searchsorted(e, column, side="left") for e, column in zip(edges, x.T, strict=True)]).astype(np.uint8)
    group = np.random.default_rng(seed).integers(0, STRATA, len(y))
    groups = [Part(binned[:, group == s], y[group == s], w[group == s]) for s in range(STRATA)]
    prior = float(np.clip((w * y).sum() / max(w.sum(), 1e-9), 0.01, 0.99))
    grown = grow(in_memory(lambda r: [(groups[s], 1.0) for s in dealt(r, MOST_STRATA)]), [len(e) for e in edges], float(np.log(prior / (1 - prior))), rounds, depth, seed=seed)
    return grown.trees(edges)
