"""Hashed word and character n-grams of texts, and the small solvers that learn from them."""

from __future__ import annotations

import numpy as np

from . import textbytes as tb

#: The bigram of a word with itself; texts that repeat words share it whatever the word is.
_SAME = np.uint64(0x5BD1E995)
GROUPS = 5
#: Words after the first in a repeat shape: which of them equal their predecessor.
_SHAPE = 8


class Group:
    """Feature numbers of one kind; text d has index[starts[d]:ends[d]]."""

    def __init__(self, index: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> None:
        self.index, self.starts, self.ends = index, starts, ends


def hashed(texts: tb.Texts, words: tb.Words, hashes: np.ndarray, bits: int) -> list[Group]:
    """Word unigrams and bigrams, shapes of repetition in 9-word runs, character (byte) 3- and 4-grams, each as a number below 2**bits."""
    mask, o = np.uint64((1 << bits) - 1), words.offsets
    out = [Group((hashes & mask).astype(np.int64), o[:-1], o[1:])]
    two = hashes[:-1] * np.uint64(0x9FB21C651E98DF25) + hashes[1:] if len(hashes) > 1 else np.zeros(0, np.uint64)
    if len(two):
        two[hashes[1:] == hashes[:-1]] = _SAME
    out.append(Group((tb.mix(two) & mask).astype(np.int64), o[:-1], np.maximum(o[1:] - 1, o[:-1])))
    same = np.append(hashes[1:] == hashes[:-1], False) if len(hashes) else np.zeros(0, bool)
    same[np.maximum(o[1:], 1)[o[1:] > o[:-1]] - 1] = False
    n = max(len(hashes) - _SHAPE, 0)
    shape = np.zeros(n, np.uint64)
    for j in range(_SHAPE):
        shape = shape * np.uint64(2) + same[j : j + n]
    out.append(Group((tb.mix(shape + np.uint64(977)) & mask).astype(np.int64), np.minimum(o[:-1], n), np.minimum(np.maximum(o[1:] - _SHAPE, o[:-1]), n)))
    d, p = texts.data.astype(np.uint32), texts.offsets
    for k in (3, 4):
        if len(d) >= k:
            h = d[: len(d) - k + 1].copy()
            for j in range(1, k):
                h <<= np.uint32(8)
                h |= d[j : len(d) - k + 1 + j]
            h *= np.uint32(0x9E3779B1 + 2 * k)
            h >>= np.uint32(32 - bits)
            h = h.astype(np.int64)
        else:
            h = np.zeros(0, np.int64)
        out.append(Group(h, p[:-1], np.maximum(p[1:] - (k - 1), p[:-1])))
    return out


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def platt(scores: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and intercept of a calibrated probability, fitted to smoothed targets by Newton's method."""
    pos, neg = float(y.sum()), float(len(y) - y.sum())
    if not pos or not neg:
        return 1.0, 0.0
    target = np.where(y == 1, (pos + 1) / (pos + 2), 1 / (neg + 2))
    scale = float(np.std(scores)) or 1.0
    x = np.stack([scores / scale, np.ones(len(y))])
    w = np.array([1.0, 0.0])
    for _ in range(50):
        p = sigmoid(w @ x)
        hess = (x * np.maximum(p * (1 - p), 1e-9)) @ x.T + 1e-4 * np.eye(2)
        step = np.linalg.solve(hess, x @ (p - target) + 1e-4 * w)
        w -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return float(max(w[0], 1e-3) / scale), float(w[1])


class LogisticModel:
    """Logistic regression over mean weights: a text scores the mean weight of its features in each
    group, summed over the groups, so its length has no influence."""

    def __init__(self, bits: int) -> None:
        self.bits = bits
        self.weights = np.zeros((GROUPS, 1 << bits), np.float32)
        self.bias, self.slope, self.shift = 0.0, 1.0, 0.0
        self.constant: float | None = None

    def raw(self, groups: list[Group]) -> np.ndarray:
        out = np.full(len(groups[0].starts), self.bias)
        for w, g in zip(self.weights, groups, strict=True):
            out += tb.segment_sums(w[g.index], g.starts, g.ends) / np.maximum(g.ends - g.starts, 1)
        return out

    def probability(self, groups: list[Group]) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(groups[0].starts), self.constant)
        return np.round(sigmoid(self.slope * self.raw(groups) + self.shift), 9)

    @classmethod
    def fit(cls, texts: list[str], labels: list[int], *, bits: int = 16, rounds: int = 60, l2: float = 1e-6) -> LogisticModel:
        """AdaGrad on the mean log-loss, both classes weighing the same; every fifth row is left out and calibrates."""
        model, y = cls(bits), np.array(labels, float)
        if len(set(labels)) < 2:
            model.constant = float(labels[0]) if labels else 1.0
            return model
        size = 1 << bits
        cells: list[np.ndarray] = []
        values: list[np.ndarray] = []
        for groups, d in each_text(texts, bits):
            row, value = [], []
            for k, g in enumerate(groups):
                own = g.index[g.starts[d] : g.ends[d]]
                if len(own):
                    at, n = np.unique(own, return_counts=True)
                    row.append(at + k * size)
                    value.append(n / len(own))
            cells.append(np.concatenate(row or [np.zeros(0, np.int64)]).astype(np.int32))
            values.append(np.concatenate(value or [np.zeros(0)]).astype(np.float32))
        held = np.arange(len(texts)) % 5 == 4
        fit = np.flatnonzero(~held)
        if len(set(y[fit])) < 2 or len(set(y[held])) < 2:
            held[:], fit = True, np.arange(len(texts))
        lengths = np.array([len(cells[i]) for i in fit])
        at, value = np.concatenate([cells[i] for i in fit]), np.concatenate([values[i] for i in fit])
        row = np.repeat(np.arange(len(fit)), lengths)
        target = y[fit]
        weight = np.where(target == 1, 0.5 / max(target.sum(), 1), 0.5 / max((1 - target).sum(), 1))
        w, square = np.zeros(GROUPS * size), np.full(GROUPS * size, 1e-12)
        for _ in range(rounds):
            p = sigmoid(np.bincount(row, weights=w[at] * value, minlength=len(fit)) + model.bias)
            error = weight * (p - target)
            grad = np.bincount(at, weights=error[row] * value, minlength=GROUPS * size) + l2 * w
            square += grad * grad
            w -= 0.5 * grad / np.sqrt(square)
            model.bias -= 0.5 * float(error.sum())
        model.weights = w.reshape(GROUPS, size).astype(np.float32)
        raw = np.array([float((w[cells[i]] * values[i]).sum()) + model.bias for i in np.flatnonzero(held)])
        model.slope, model.shift = platt(raw, y[held])
        return model


def each_text(texts: list[str], bits: int):
    """Yields the feature groups of a slice and the number of each text in it."""
    for i in range(0, len(texts), 64):
        part = tb.of(texts[i : i + 64])
        words = part.words(tb.NON_SPACE)
        groups = hashed(part, words, tb.word_hashes(part.data, words), bits)
        for d in range(len(part)):
            yield groups, d


#: Added to the squared length of a row, so that texts of a few n-grams lean on the bias.
_SHORT = 300.0


def present(groups: list[Group], d: int, flags: np.ndarray) -> np.ndarray:
    """The sorted distinct features of text d; `flags` is all false before and after."""
    for g in groups:
        flags[g.index[g.starts[d] : g.ends[d]]] = True
    at = np.flatnonzero(flags)
    flags[at] = False
    return at


class NbSvm:
    """A linear SVM over n-gram indicators, each scaled by the log of the ratio of its shares in the two
    classes; every row is scaled by its length. Scores are Platt-calibrated on rows left out of the fit."""

    def __init__(self, bits: int) -> None:
        self.bits = bits
        self.ratio = np.zeros(1 << bits, np.float32)
        self.weights = np.zeros(1 << bits, np.float32)
        self.bias, self.slope, self.shift = 0.0, 1.0, 0.0
        self.constant: float | None = None

    def margins(self, groups: list[Group], flags: np.ndarray) -> np.ndarray:
        out = np.empty(len(groups[0].starts))
        product, square = self._product, self._square
        for d in range(len(out)):
            at = present(groups, d, flags)
            norm = (float(square[at].sum()) + _SHORT) ** 0.5
            out[d] = float(product[at].sum()) / norm + self.bias
        return out

    def ready(self) -> NbSvm:
        r = self.ratio.astype(np.float64)
        self._product, self._square = r * self.weights, r * r
        return self

    def probability(self, groups: list[Group], flags: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(groups[0].starts), self.constant)
        return np.round(sigmoid(self.slope * self.margins(groups, flags) + self.shift), 9)

    @classmethod
    def fit(cls, texts: list[str], labels: list[int], *, bits: int = 17, alpha: float = 1.0, cost: float = 1.0, epochs: int = 12) -> NbSvm:
        model, y = cls(bits), np.array(labels, int)
        if len(set(labels)) < 2:
            model.constant = float(labels[0]) if labels else 1.0
            return model
        flags = np.zeros(1 << bits, bool)
        rows = [present(groups, d, flags).astype(np.int32) for groups, d in each_text(texts, bits)]
        held = np.arange(len(rows)) % 5 == 4
        fit = np.flatnonzero(~held)
        if len(set(y[fit])) < 2 or len(set(y[held])) < 2:
            held[:], fit = True, np.arange(len(rows))
        share = np.full((2, 1 << bits), alpha)
        for i in fit:
            share[y[i], rows[i]] += 1
        share /= share.sum(axis=1, keepdims=True)
        ratio = np.log(share[1] / share[0])
        model.ratio = ratio.astype(np.float32)
        w, bias = dual_coordinate_descent([rows[i] for i in fit], 2 * y[fit] - 1, ratio, cost, epochs)
        model.weights, model.bias = w.astype(np.float32), bias
        model.ready()
        margins = []
        for i in np.flatnonzero(held):
            norm = (float(model._square[rows[i]].sum()) + _SHORT) ** 0.5
            margins.append(float(model._product[rows[i]].sum()) / norm + bias)
        model.slope, model.shift = platt(np.array(margins), y[held])
        return model


def dual_coordinate_descent(rows: list[np.ndarray], signs: np.ndarray, ratio: np.ndarray, cost: float, epochs: int) -> tuple[np.ndarray, float]:
    """min |w|^2/2 + C * sum of hinge losses, solved in the dual one coordinate at a time (with a bias feature of 1)."""
    w, bias = np.zeros(len(ratio)), 0.0
    values = []
    for r in rows:
        v = ratio[r]
        values.append(v / (float(v @ v) + _SHORT) ** 0.5)
    diagonal = np.array([float(v @ v) + 1 for v in values])
    n, alphas = len(rows), np.zeros(len(rows))
    limit = cost
    order = np.random.default_rng(0)
    for _ in range(epochs):
        moved = 0.0
        for i in order.permutation(n):
            s = int(signs[i])
            gradient = s * (float(w[rows[i]] @ values[i]) + bias) - 1
            new = min(max(alphas[i] - gradient / diagonal[i], 0.0), limit)
            if (step := new - alphas[i]) != 0:
                alphas[i] = new
                w[rows[i]] += step * s * values[i]
                bias += step * s
                moved = max(moved, abs(step))
        if moved < 1e-3:
            break
    return w, bias
