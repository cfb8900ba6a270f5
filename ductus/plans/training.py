"""Training the network on pairs of id lists, in one process or by the tasks of a cluster.

A task trains from the epoch's weights over its own batches; the tasks' weights are averaged by their batches (local
updates with averaging). So lines stay where they are and each task sends one set of weights, at most MAX_TASKS of them.
"""

from __future__ import annotations

import os
import pickle
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ductus.operators.vocab import PAD
from ductus.plans import gradients as g
from ductus.plans.network import Network, Progress, Weights, smoothed

MAX_TASKS = 64
Pair = tuple[list[int], list[int]]


@dataclass(frozen=True)
class Settings:
    epochs: int = 50
    batch: int = 32
    heads: int = 8
    dropout: float = 0.2
    rate: float = 0.001
    decay: float = 0.0001  # of the weights, as a part of their gradient
    smoothing: float = 0.1
    accumulate: int = 1  # batches a step
    longest_gradient: float = 1.0
    betas: tuple[float, float] = (0.9, 0.997)
    epsilon: float = 1e-9
    factor: float = 0.5  # of the rate, after more than `plateau` epochs without a lesser loss
    plateau: int = 5
    patience: int = 0  # epochs without a lesser loss until it stops; 0: it doesn't
    save_every: int = 5
    seed: int = 42


def initial(source_size: int, target_size: int, width: int = 512, layers: int = 4, seed: int = 42) -> Weights:
    """Uniform weights within sqrt(6 / (inputs + outputs)); biases 0, norms 1."""
    random, out = np.random.default_rng(seed), {}

    def matrix(name: str, a: int, b: int) -> None:
        out[name] = random.uniform(-1, 1, (a, b)) * np.sqrt(6 / (a + b))

    def linear(name: str, a: int, b: int) -> None:
        matrix(f"{name}.weight", b, a)
        out[f"{name}.bias"] = np.zeros(b)

    matrix("src_embedding.weight", source_size, width)
    matrix("tgt_embedding.weight", target_size, width)
    for side, attentions in (("encoder", ["self_attn"]), ("decoder", ["self_attn", "multihead_attn"])):
        for i in range(layers):
            at = f"transformer.{side}.layers.{i}"
            for a in attentions:
                matrix(f"{at}.{a}.in_proj_weight", 3 * width, width)
                out[f"{at}.{a}.in_proj_bias"] = np.zeros(3 * width)
                linear(f"{at}.{a}.out_proj", width, width)
            linear(f"{at}.linear1", width, 4 * width)
            linear(f"{at}.linear2", 4 * width, width)
            for k in range(len(attentions) + 1):
                out[f"{at}.norm{k + 1}.weight"], out[f"{at}.norm{k + 1}.bias"] = np.ones(width), np.zeros(width)
        out[f"transformer.{side}.norm.weight"], out[f"transformer.{side}.norm.bias"] = np.ones(width), np.zeros(width)
    linear("fc_out", width, target_size)
    return out


def padded(sequences: list[list[int]]) -> np.ndarray:
    out = np.full((len(sequences), max(map(len, sequences))), PAD)
    for row, s in zip(out, sequences):
        row[: len(s)] = s
    return out


def batches(pairs: Iterable[Pair], size: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    held: list[Pair] = []
    for pair in pairs:
        held.append(pair)
        if len(held) == size:
            yield padded([a for a, _ in held]), padded([b for _, b in held])
            held = []
    if held:
        yield padded([a for a, _ in held]), padded([b for _, b in held])


def loss(network: Network, source: np.ndarray, target: np.ndarray, smoothing: float) -> g.Node:
    """Of predicting each target token from those before it."""
    logits = network.decoded(network.encoded(source), target[:, :-1])
    return g.divergence(logits, smoothed(target[:, 1:], logits.value.shape[-1], PAD, smoothing))


@dataclass
class Adam:
    """Steps of Adam, with the two running means of each weight."""

    settings: Settings
    rate: float
    steps: int = 0
    means: dict[str, np.ndarray] = field(default_factory=dict)
    squares: dict[str, np.ndarray] = field(default_factory=dict)

    def step(self, weights: dict[str, g.Node]) -> None:
        """By the weights' gradients, shortened together to the longest allowed; they are gone afterwards."""
        s = self.settings
        length = np.sqrt(sum(float((n.grad**2).sum()) for n in weights.values() if n.grad is not None))
        shorter = min(1.0, s.longest_gradient / (length + 1e-6))
        self.steps += 1
        for name, node in weights.items():
            if node.grad is None:
                continue
            d = node.grad * shorter + s.decay * node.value
            m = self.means[name] = s.betas[0] * self.means.get(name, 0.0) + (1 - s.betas[0]) * d
            v = self.squares[name] = s.betas[1] * self.squares.get(name, 0.0) + (1 - s.betas[1]) * d * d
            m, v = m / (1 - s.betas[0] ** self.steps), v / (1 - s.betas[1] ** self.steps)
            node.value = node.value - self.rate * m / (np.sqrt(v) + s.epsilon)
            node.grad = None


def train_epoch(weights: Weights, pairs: Iterable[Pair], settings: Settings, adam: Adam, seed: int = 42) -> tuple[Weights, list[float]]:
    """The weights after all batches, and the batches' losses."""
    network, losses, held = Network(weights, settings.heads, settings.dropout, seed), [], 0
    for source, target in batches(pairs, settings.batch):
        found = loss(network, source, target, settings.smoothing)
        losses.append(float(found.value))
        g.backward(g.times(found, 1 / settings.accumulate))
        held += 1
        if held == settings.accumulate:
            adam.step(network.weights)
            held = 0
    if held:
        adam.step(network.weights)
    return {k: n.value for k, n in network.weights.items()}, losses


def evaluate(weights: Weights, pairs: Iterable[Pair], settings: Settings) -> list[float]:
    """The batches' losses, without dropout."""
    network = Network(weights, settings.heads)
    return [float(loss(network, a, b, settings.smoothing).value) for a, b in batches(pairs, settings.batch)]


def train(weights: Weights, epoch, losses_of, settings: Settings, folder: str | None = None) -> tuple[Weights, list[tuple[float, float]], Progress]:
    """The weights of the least validation loss, (training, validation) losses by epoch, and the progress.

    epoch: (weights, rate, number) -> (weights, losses); losses_of: weights -> validation losses. folder: the best
    weights and those of every few epochs are written there as .npz files.
    """
    progress, rate, best, history, waited = Progress(settings.patience), settings.rate, weights, [], 0
    for k in range(settings.epochs):
        weights, losses = epoch(weights, rate, k)
        before = progress.best
        value = progress.epoch(losses_of(weights))
        history.append((sum(losses) / max(len(losses), 1), value))
        better = value < before
        if better:
            best = weights
        waited = 0 if better else waited + 1
        if waited > settings.plateau:
            rate, waited = rate * settings.factor, 0
        if folder:
            os.makedirs(folder, exist_ok=True)
            for name, on in (("best", better), (f"epoch_{k + 1}", (k + 1) % settings.save_every == 0)):
                if on:
                    np.savez(os.path.join(folder, f"{name}.npz"), **weights)
        if progress.stop:
            break
    return best, history, progress


def train_locally(weights: Weights, pairs: list[Pair], validation: list[Pair], settings: Settings, folder: str | None = None):
    """train() in this process; each epoch has its own order of the pairs."""
    adam = Adam(settings, settings.rate)

    def epoch(weights: Weights, rate: float, k: int) -> tuple[Weights, list[float]]:
        adam.rate = rate
        order = np.random.default_rng((settings.seed, k)).permutation(len(pairs))
        return train_epoch(weights, (pairs[i] for i in order), settings, adam, settings.seed + k)

    return train(weights, epoch, lambda w: evaluate(w, validation or pairs, settings), settings, folder)


def _in_task(blob: bytes, rate: float, k: int, settings: Settings):
    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = pickle.loads(blob)
        pairs = (pair for batch in found for pair in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
        if rate:
            weights, losses = train_epoch(weights, pairs, settings, Adam(settings, rate), settings.seed + k)
        else:
            losses = evaluate(weights, pairs, settings)
        if losses:
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(weights, 5) if rate else b""], pa.binary()), pa.array([losses], pa.list_(pa.float64()))], ["weights", "losses"])

    return run


def train_on_cluster(weights: Weights, pairs: DataFrame, validation: DataFrame, settings: Settings, tasks: int = 8, folder: str | None = None):
    """train() over tables source, target (arrays of ids)."""
    if not 0 < tasks <= MAX_TASKS:
        raise ValueError(f"1 to {MAX_TASKS} tasks")
    schema = "weights binary, losses array<double>"

    def results(df: DataFrame, weights: Weights, rate: float, k: int) -> list:
        return df.select("source", "target").mapInArrow(_in_task(pickle.dumps(weights, 5), rate, k, settings), schema).collect()

    def epoch(weights: Weights, rate: float, k: int) -> tuple[Weights, list[float]]:
        found = results(pairs.repartition(tasks), weights, rate, k)
        if not found:
            return weights, []
        parts, counts = [pickle.loads(r.weights) for r in found], [len(r.losses) for r in found]
        return {n: np.average([p[n] for p in parts], axis=0, weights=counts) for n in weights}, [x for r in found for x in r.losses]

    def losses_of(weights: Weights) -> list[float]:
        return [x for r in results(validation.repartition(tasks), weights, 0.0, 0) for x in r.losses]

    return train(weights, epoch, losses_of, settings, folder)
