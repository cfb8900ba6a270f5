"""Reverse-mode differentiation of what a network is made of, over numpy arrays."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np


class Node:
    """A value, and how a gradient of it becomes one of what it was made of."""

    __slots__ = ("value", "grad", "made_of")

    def __init__(self, value: np.ndarray, made_of: tuple[tuple[Node, Callable[[np.ndarray], np.ndarray]], ...] = ()):
        self.value, self.grad, self.made_of = value, None, made_of


def backward(end: Node) -> None:
    """Adds the gradient of a number by every node that it was made of to that node's `grad`."""
    order: list[Node] = []
    seen: set[int] = set()
    todo = [(end, False)]
    while todo:
        node, done = todo.pop()
        if done:
            order.append(node)
        elif id(node) not in seen:
            seen.add(id(node))
            todo.append((node, True))
            todo += [(parent, False) for parent, _ in node.made_of]
    end.grad = np.ones_like(end.value)
    for node in reversed(order):
        for parent, of in node.made_of:
            found = of(node.grad)
            parent.grad = found if parent.grad is None else parent.grad + found


def _like(grad: np.ndarray, shape: tuple[int, ...]) -> np.ndarray:
    """A gradient summed over what broadcasting repeated."""
    grad = grad.sum(axis=tuple(range(grad.ndim - len(shape))))
    return grad.sum(axis=tuple(i for i, n in enumerate(shape) if n == 1 and grad.shape[i] != 1), keepdims=True)


def add(a: Node, b: Node) -> Node:
    return Node(a.value + b.value, ((a, lambda d: _like(d, a.value.shape)), (b, lambda d: _like(d, b.value.shape))))


def times(a: Node, by: np.ndarray | float) -> Node:
    """By a constant."""
    return Node(a.value * by, ((a, lambda d: d * by),))


def matmul(a: Node, b: Node) -> Node:
    left = lambda d: _like(d @ np.swapaxes(b.value, -1, -2), a.value.shape)
    right = lambda d: _like(np.swapaxes(a.value, -1, -2) @ d, b.value.shape)
    return Node(a.value @ b.value, ((a, left), (b, right)))


def turned(a: Node, axes: tuple[int, ...]) -> Node:
    return Node(a.value.transpose(axes), ((a, lambda d: d.transpose(np.argsort(axes))),))


def shaped(a: Node, shape: tuple[int, ...]) -> Node:
    return Node(a.value.reshape(shape), ((a, lambda d: d.reshape(a.value.shape)),))


def cut(a: Node, part: slice) -> Node:
    def back(d: np.ndarray) -> np.ndarray:
        out = np.zeros_like(a.value)
        out[part] = d
        return out

    return Node(a.value[part], ((a, back),))


def rows(table: Node, ids: np.ndarray) -> Node:
    def back(d: np.ndarray) -> np.ndarray:
        out = np.zeros_like(table.value)
        np.add.at(out, ids, d)
        return out

    return Node(table.value[ids], ((table, back),))


def positive(a: Node) -> Node:
    return Node(np.maximum(a.value, 0), ((a, lambda d: d * (a.value > 0)),))


def log_softmax(x: np.ndarray) -> np.ndarray:
    x = x - x.max(axis=-1, keepdims=True)
    return x - np.log(np.exp(x).sum(axis=-1, keepdims=True))


def softmax(a: Node) -> Node:
    y = np.exp(log_softmax(a.value))
    return Node(y, ((a, lambda d: (d - (d * y).sum(axis=-1, keepdims=True)) * y),))


def layer_norm(a: Node, weight: Node, bias: Node, eps: float = 1e-5) -> Node:
    scale = 1 / np.sqrt(a.value.var(axis=-1, keepdims=True) + eps)
    x = (a.value - a.value.mean(axis=-1, keepdims=True)) * scale

    def back(d: np.ndarray) -> np.ndarray:
        d = d * weight.value
        return scale * (d - d.mean(axis=-1, keepdims=True) - x * (d * x).mean(axis=-1, keepdims=True))

    return Node(x * weight.value + bias.value, ((a, back), (weight, lambda d: _like(d * x, weight.value.shape)), (bias, lambda d: _like(d, bias.value.shape))))


def divergence(logits: Node, true: np.ndarray) -> Node:
    """Of target distributions from softmax(logits), summed and divided by the number of sequences."""
    log = log_softmax(logits.value)
    entropy = np.where(true > 0, true * np.log(np.where(true > 0, true, 1.0)), 0.0)
    value = np.asarray((entropy - true * log).sum() / len(true))
    return Node(value, ((logits, lambda d: d * (np.exp(log) * true.sum(axis=-1, keepdims=True) - true) / len(true)),))
