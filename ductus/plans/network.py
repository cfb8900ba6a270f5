"""An encoder-decoder network in numpy: what a checkpoint holds, its logits, greedy decoding, loss and progress.

Weights are arrays under the names that PyTorch's Transformer gives them, e.g. from numpy.load of an .npz file. The
layers are written over ductus.plans.gradients, so the same code runs and trains (ductus.plans.training) a network.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np

from ductus.operators.vocab import EOS, PAD, SOS, UNK
from ductus.plans import gradients as g

Weights = dict[str, np.ndarray]


@dataclass(frozen=True)
class Architecture:
    width: int = 512
    layers: int = 4
    heads: int = 8
    source_size: int = 0
    target_size: int = 0

    @property
    def hidden(self) -> int:
        return 4 * self.width


def architecture(weights: Weights, layers: int = 4, heads: int = 8) -> Architecture:
    """The architecture that the weights' names and shapes tell; the number of heads isn't in them."""
    found = [int(k.split(".")[3]) for k in weights if k.startswith("transformer.encoder.layers.")]
    source, target = (weights.get(f"{side}_embedding.weight") for side in ("src", "tgt"))
    width = source.shape[1] if source is not None else Architecture.width
    return Architecture(width, max(found) + 1 if found else layers, heads, 0 if source is None else len(source), 0 if target is None else len(target))


def load(path: str) -> Weights:
    """The arrays of an .npz file."""
    with np.load(path) as found:
        return {k: found[k] for k in found.files}


def positions(length: int, width: int) -> np.ndarray:
    """Sines at even and cosines at odd places, of wavelengths that grow geometrically."""
    angle = np.arange(length)[:, None] * np.exp(np.arange(0, width, 2) * (-math.log(10000.0) / width))
    out = np.zeros((length, width))
    out[:, 0::2], out[:, 1::2] = np.sin(angle), np.cos(angle)[:, : width // 2]
    return out


class Network:
    """Post-norm encoder-decoder layers with multi-head attention, over sequences of ids (sequences x places).

    Padding is masked where sequences attend to themselves; decoders don't look ahead. dropout: the chance that a
    value is left out, while training only.
    """

    def __init__(self, weights: Weights, heads: int = 8, dropout: float = 0.0, seed: int = 42):
        self.weights = {k: g.Node(v) for k, v in weights.items()}
        self.of, self.dropout, self.random = architecture(weights, heads=heads), dropout, np.random.default_rng(seed)

    def _dropped(self, x: g.Node) -> g.Node:
        return g.times(x, (self.random.random(x.value.shape) >= self.dropout) / (1 - self.dropout)) if self.dropout else x

    def _linear(self, x: g.Node, name: str) -> g.Node:
        return g.add(g.matmul(x, g.turned(self.weights[f"{name}.weight"], (1, 0))), self.weights[f"{name}.bias"])

    def _norm(self, x: g.Node, name: str) -> g.Node:
        return g.layer_norm(x, self.weights[f"{name}.weight"], self.weights[f"{name}.bias"])

    def _attend(self, x: g.Node, memory: g.Node, name: str, allowed: np.ndarray | None = None) -> g.Node:
        heads, width = self.of.heads, self.of.width
        w, b = self.weights[f"{name}.in_proj_weight"], self.weights[f"{name}.in_proj_bias"]

        def part(y: g.Node, i: int) -> g.Node:
            one = slice(i * width, (i + 1) * width)
            out = g.add(g.matmul(y, g.turned(g.cut(w, one), (1, 0))), g.cut(b, one))
            return g.turned(g.shaped(out, (*out.value.shape[:2], heads, width // heads)), (0, 2, 1, 3))

        q, k, v = part(x, 0), part(memory, 1), part(memory, 2)
        scores = g.times(g.matmul(q, g.turned(k, (0, 1, 3, 2))), 1 / math.sqrt(width // heads))
        if allowed is not None:
            scores = g.add(scores, g.Node(np.where(allowed, 0.0, -np.inf)))
        mixed = g.turned(g.matmul(self._dropped(g.softmax(scores)), v), (0, 2, 1, 3))
        return self._linear(g.shaped(mixed, x.value.shape), f"{name}.out_proj")

    def _layer(self, x: g.Node, name: str, allowed: np.ndarray, memory: g.Node | None = None) -> g.Node:
        x = self._norm(g.add(x, self._dropped(self._attend(x, x, f"{name}.self_attn", allowed))), f"{name}.norm1")
        if memory is not None:
            x = self._norm(g.add(x, self._dropped(self._attend(x, memory, f"{name}.multihead_attn"))), f"{name}.norm2")
        hidden = self._dropped(g.positive(self._linear(x, f"{name}.linear1")))
        return self._norm(g.add(x, self._dropped(self._linear(hidden, f"{name}.linear2"))), f"{name}.norm{2 if memory is None else 3}")

    def _embedded(self, ids: np.ndarray, side: str) -> g.Node:
        x = g.times(g.rows(self.weights[f"{side}_embedding.weight"], ids), math.sqrt(self.of.width))
        return self._dropped(g.add(x, g.Node(positions(ids.shape[1], self.of.width))))

    def encoded(self, ids: np.ndarray) -> g.Node:
        x, allowed = self._embedded(ids, "src"), (ids != PAD)[:, None, None, :]
        for i in range(self.of.layers):
            x = self._layer(x, f"transformer.encoder.layers.{i}", allowed)
        return self._norm(x, "transformer.encoder.norm")

    def decoded(self, memory: g.Node, ids: np.ndarray) -> g.Node:
        x = self._embedded(ids, "tgt")
        allowed = np.tri(ids.shape[1], dtype=bool)[None, None] & (ids != PAD)[:, None, None, :]
        for i in range(self.of.layers):
            x = self._layer(x, f"transformer.decoder.layers.{i}", allowed, memory)
        return self._linear(self._norm(x, "transformer.decoder.norm"), "fc_out")

    def encode(self, ids: list[int]) -> g.Node:
        """Of one sequence."""
        return self.encoded(np.array([ids]))

    def logits(self, memory: g.Node, ids: list[int]) -> np.ndarray:
        """A row of logits after every prefix of ids."""
        return self.decoded(memory, np.array([ids])).value[0]

    def step(self, source: list[int]) -> Callable[[list[int]], list[float]]:
        """Log probabilities of the next token after a prefix, for a source."""
        memory = self.encode(source)
        return lambda prefix: g.log_softmax(self.logits(memory, prefix)[-1]).tolist()


def greedy(step: Callable[[list[int]], list[float]], longest: int = 100, start: int = SOS, end: int = EOS) -> list[int]:
    """The most likely token after each prefix until the end; no token is banned, the first of equal ones wins."""
    tokens = [start]
    for _ in range(longest):
        best = int(np.argmax(step(tokens)))
        if best == end:
            break
        tokens.append(best)
    return tokens


def shown(tokens: list[int], chars: dict[int, str]) -> str:
    """The text of tokens without specials."""
    return "".join(chars.get(t, "") for t in tokens if t not in (PAD, SOS, EOS, UNK))


def smoothed(target: np.ndarray, size: int, padding: int = PAD, smoothing: float = 0.1) -> np.ndarray:
    """Target distributions (sequences x places x vocabulary): smoothed, nothing for padding."""
    true = np.full((*target.shape, size), smoothing / (size - 2))
    np.put_along_axis(true, target[..., None], 1 - smoothing, axis=-1)
    true[..., padding] = 0
    true[target == padding] = 0
    return true


def smoothed_loss(logits: np.ndarray, target: np.ndarray, padding: int = PAD, smoothing: float = 0.1) -> float:
    """Divergence of smoothed targets from the predictions, by sequence; padding counts nothing."""
    return float(g.divergence(g.Node(logits), smoothed(target, logits.shape[-1], padding, smoothing)).value)


@dataclass
class Progress:
    """Mean losses by epoch, the least one, and whether to stop after `patience` epochs without a lesser one."""

    patience: int
    best: float = float("inf")
    since: int = 0

    def epoch(self, losses: list[float]) -> float:
        mean = sum(losses) / len(losses) if losses else float("inf")
        self.best, self.since = (mean, 0) if mean < self.best else (self.best, self.since + 1)
        return mean

    @property
    def stop(self) -> bool:
        """Never with a patience of 0."""
        return 0 < self.patience <= self.since
