"""Arrays that remember what they were made of, for gradients: reverse-mode differentiation in numpy."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np


def _erf(x: np.ndarray) -> np.ndarray:
    return np.vectorize(math.erf, otypes=[float])(x)


class Var:
    """An array, and for each array it was made of how a gradient goes back there."""

    def __init__(self, value: np.ndarray, made_of: tuple[tuple[Var, Callable[[np.ndarray], np.ndarray]], ...] = ()):
        self.value, self.made_of, self.grad = value, made_of, None

    def __add__(self, other: Var) -> Var:
        return Var(self.value + other.value, ((self, lambda g: _fitted(g, self.value.shape)), (other, lambda g: _fitted(g, other.value.shape))))

    def __mul__(self, other: Var) -> Var:
        return Var(self.value * other.value, ((self, lambda g: _fitted(g * other.value, self.value.shape)), (other, lambda g: _fitted(g * self.value, other.value.shape))))

    def __matmul__(self, other: Var) -> Var:
        return Var(self.value @ other.value, ((self, lambda g: g @ other.value.T), (other, lambda g: self.value.T @ g)))

    def scaled(self, factor: float) -> Var:
        return Var(self.value * factor, ((self, lambda g: g * factor),))

    def reshaped(self, *shape: int) -> Var:
        return Var(self.value.reshape(shape), ((self, lambda g: g.reshape(self.value.shape)),))

    def total(self, axis: int | None = None) -> Var:
        spread = lambda g: np.broadcast_to(g if axis is None else np.expand_dims(g, axis), self.value.shape)
        return Var(self.value.sum(axis=axis), ((self, spread),))

    def rows(self, at: np.ndarray) -> Var:
        def back(g: np.ndarray) -> np.ndarray:
            out = np.zeros_like(self.value)
            np.add.at(out, at, g)
            return out

        return Var(self.value[at], ((self, back),))

    def into(self, at: np.ndarray, size: int) -> Var:
        """Rows added up at their places."""
        out = np.zeros((size, *self.value.shape[1:]))
        np.add.at(out, at, self.value)
        return Var(out, ((self, lambda g: g[at]),))

    def back(self) -> None:
        """Gradients of this number for all it was made of."""
        order, seen, todo = [], set(), [(self, False)]
        while todo:
            v, done = todo.pop()
            if done:
                order.append(v)
            elif id(v) not in seen:
                seen.add(id(v))
                todo.append((v, True))
                todo += [(p, False) for p, _ in v.made_of]
        for v in order:
            v.grad = None
        self.grad = np.ones_like(self.value)
        for v in reversed(order):
            for p, send in v.made_of:
                g = send(v.grad)
                p.grad = g if p.grad is None else p.grad + g


def _fitted(g: np.ndarray, shape: tuple[int, ...]) -> np.ndarray:
    """A gradient summed over the axes along which an array was repeated."""
    g = g.sum(axis=tuple(range(g.ndim - len(shape))))
    return g.sum(axis=tuple(k for k, n in enumerate(shape) if n == 1 and g.shape[k] != 1), keepdims=True) if g.shape != shape else g


def joined(parts: list[Var], axis: int) -> Var:
    edges = np.cumsum([0, *(p.value.shape[axis] for p in parts)])
    part = lambda k: lambda g: np.take(g, range(edges[k], edges[k + 1]), axis=axis)
    return Var(np.concatenate([p.value for p in parts], axis=axis), tuple((p, part(k)) for k, p in enumerate(parts)))


def gelu(x: Var) -> Var:
    v = x.value
    if not v.size:
        return x
    half = 0.5 * (1 + _erf(v / math.sqrt(2)))
    return Var(v * half, ((x, lambda g: g * (half + v * np.exp(-v * v / 2) / math.sqrt(2 * math.pi))),))


def leaky(x: Var, slope: float = 0.2) -> Var:
    factor = np.where(x.value > 0, 1.0, slope)
    return Var(x.value * factor, ((x, lambda g: g * factor),))


def normed(x: Var, scale: Var, shift: Var) -> Var:
    """Rows with mean 0 and variance 1, then scaled and shifted."""
    centred = x.value - x.value.mean(axis=-1, keepdims=True)
    spread = np.sqrt((centred * centred).mean(axis=-1, keepdims=True) + 1e-5)
    unit = centred / spread
    out = Var(unit, ((x, lambda g: (g - g.mean(axis=-1, keepdims=True) - unit * (g * unit).mean(axis=-1, keepdims=True)) / spread),))
    return out * scale + shift


def shares_by(logits: Var, at: np.ndarray, size: int) -> Var:
    """The softmax of rows over all rows of the same place, column by column."""
    top = np.full((size, *logits.value.shape[1:]), -np.inf)
    np.maximum.at(top, at, logits.value)
    e = np.exp(logits.value - top[at])
    total = np.zeros(top.shape)
    np.add.at(total, at, e)
    share = e / (total[at] + 1e-16)

    def back(g: np.ndarray) -> np.ndarray:
        sums = np.zeros(top.shape)
        np.add.at(sums, at, g * share)
        return share * (g - sums[at])

    return Var(share, ((logits, back),))


def mean_and_max(x: Var) -> Var:
    """One row: the means of all columns, then their greatest values."""
    v, best = x.value, x.value.argmax(axis=0)
    columns = v.shape[1]

    def back(g: np.ndarray) -> np.ndarray:
        out = np.repeat(g[:, :columns] / len(v), len(v), axis=0)
        out[best, np.arange(columns)] += g[0, columns:]
        return out

    return Var(np.concatenate([v.mean(axis=0), v.max(axis=0)])[None], ((x, back),))


def softmax(x: Var) -> Var:
    e = np.exp(x.value - x.value.max(axis=-1, keepdims=True))
    p = e / e.sum(axis=-1, keepdims=True)
    return Var(p, ((x, lambda g: p * (g - (g * p).sum(axis=-1, keepdims=True))),))


def sigmoid(x: Var) -> Var:
    p = 1 / (1 + np.exp(-x.value))
    return Var(p, ((x, lambda g: g * p * (1 - p)),))


def cross_entropy(logits: Var, label: np.ndarray, weight: np.ndarray) -> Var:
    """Mean of weighted negative log shares of the labels."""
    p = softmax(logits).value
    at, n = np.arange(len(label)), len(label)

    def back(g: np.ndarray) -> np.ndarray:
        out = p.copy()
        out[at, label] -= 1
        return out * (g * weight / n)[:, None]

    return Var(np.asarray((-np.log(p[at, label]) * weight).sum() / n), ((logits, back),))


def smooth_l1(x: Var, target: np.ndarray) -> Var:
    """Mean of d * d / 2 for distances d below 1, of d - 1 / 2 beyond."""
    d = x.value - target
    near = np.abs(d) < 1
    return Var(np.asarray(np.where(near, d * d / 2, np.abs(d) - 0.5).mean()), ((x, lambda g: g * np.where(near, d, np.sign(d)) / max(d.size, 1)),))
