"""The network in numpy: masks, decoding, loss, and its place among the modes."""

import math

import numpy as np
import pytest

from ductus.plans import gradients, modes, network, training


def weights(width=8, layers=2, sizes=(9, 7), seed=1):
    rng = np.random.default_rng(seed)
    out = {"src_embedding.weight": rng.normal(size=(sizes[0], width)), "tgt_embedding.weight": rng.normal(size=(sizes[1], width))}

    def linear(name, a, b):
        out[f"{name}.weight"], out[f"{name}.bias"] = rng.normal(size=(b, a)) / math.sqrt(a), rng.normal(size=b) / 9

    def norm(name):
        out[f"{name}.weight"], out[f"{name}.bias"] = 1 + rng.normal(size=width) / 9, rng.normal(size=width) / 9

    for side, attentions in (("encoder", ["self_attn"]), ("decoder", ["self_attn", "multihead_attn"])):
        for i in range(layers):
            at = f"transformer.{side}.layers.{i}"
            for a in attentions:
                out[f"{at}.{a}.in_proj_weight"], out[f"{at}.{a}.in_proj_bias"] = rng.normal(size=(3 * width, width)) / 3, rng.normal(size=3 * width) / 9
                linear(f"{at}.{a}.out_proj", width, width)
            linear(f"{at}.linear1", width, 4 * width)
            linear(f"{at}.linear2", 4 * width, width)
            for k in range(len(attentions) + 1):
                norm(f"{at}.norm{k + 1}")
        norm(f"transformer.{side}.norm")
    linear("fc_out", width, sizes[1])
    return out


def test_architecture_and_file(tmp_path):
    w = weights()
    np.savez(tmp_path / "m.npz", **w)
    found = network.load(str(tmp_path / "m.npz"))
    assert set(found) == set(w) and all((found[k] == w[k]).all() for k in w)
    a = network.architecture(found, heads=2)
    assert (a.width, a.layers, a.heads, a.hidden, a.source_size, a.target_size) == (8, 2, 2, 32, 9, 7)
    assert network.architecture({}) == network.Architecture()


def test_later_tokens_change_nothing_before_them():
    net = network.Network(weights(), heads=2)
    memory = net.encode([1, 4, 5, 2])
    a, b = net.logits(memory, [1, 3, 4, 5]), net.logits(memory, [1, 3, 6])
    assert np.allclose(a[:2], b[:2]) and not np.allclose(a[2], b[2])
    assert not np.allclose(net.encode([1, 4, 5, 2]).value[0, 0], net.encode([1, 4, 6, 2]).value[0, 0])
    assert np.allclose(network.positions(3, 4)[2], [math.sin(2), math.cos(2), math.sin(0.02), math.cos(0.02)])


def test_one_head_by_hand():
    """Attention over two places, written out."""
    w = weights(width=4, layers=1)
    net = network.Network(w, heads=1)
    x = np.random.default_rng(2).normal(size=(2, 4))
    name = "transformer.encoder.layers.0.self_attn"
    q, k, v = (x @ w[f"{name}.in_proj_weight"][4 * i : 4 * i + 4].T + w[f"{name}.in_proj_bias"][4 * i : 4 * i + 4] for i in range(3))
    rows = []
    for i in range(2):
        e = [math.exp(sum(q[i][d] * k[j][d] for d in range(4)) / 2) for j in range(2)]
        rows.append(sum(e[j] / sum(e) * v[j] for j in range(2)))
    want = np.array(rows) @ w[f"{name}.out_proj.weight"].T + w[f"{name}.out_proj.bias"]
    node = gradients.Node(x[None])
    assert np.allclose(net._attend(node, node, name).value[0], want)


def test_decoding():
    net = network.Network(weights(), heads=2)
    step = net.step([1, 4, 5, 2])
    tokens = network.greedy(step, longest=12)
    assert tokens[0] == 1 and 2 not in tokens and len(tokens) <= 13
    assert all(tokens[k] == int(np.argmax(step(tokens[:k]))) for k in range(1, len(tokens)))
    wide = modes.beam_search(step, width=3, longest=12, banned=())
    narrow = modes.beam_search(step, width=1, longest=12, banned=())
    assert narrow[0][0][: len(tokens)] == tokens and wide[0][1] >= narrow[0][1] - 1e-9 or len(wide[0][0]) != len(narrow[0][0])
    assert network.shown([1, 3, 5, 0, 4, 2], {4: "a", 5: "b"}) == "ba"


def test_loss_by_hand_and_progress():
    logits = np.array([[[0.0, 1.0, 2.0, 0.5], [1.0, 1.0, 0.0, 0.0]]])
    target = np.array([[2, 0]])
    p = [math.exp(x) / sum(map(math.exp, logits[0, 0])) for x in logits[0, 0]]
    want = 0.9 * math.log(0.9 / p[2]) + 0.05 * math.log(0.05 / p[1]) + 0.05 * math.log(0.05 / p[3])
    assert network.smoothed_loss(logits, target) == pytest.approx(want)
    run = network.Progress(patience=2)
    assert [run.epoch(x) for x in ([3.0, 1.0], [2.0], [1.0], [4.0])] == [2.0, 2.0, 1.0, 4.0]
    assert run.best == 1.0 and run.since == 1 and not run.stop
    run.epoch([])
    assert run.stop


def test_a_network_as_generator(spark):
    w = weights()
    chars = {4: "a", 5: "b", 6: "c"}

    def load():
        net = network.Network(w, heads=2)
        ids = lambda t: [1, *({"a": 4, "b": 5}.get(c, 3) for c in t), 2]
        return lambda texts: [[(network.shown(tokens, chars), score, len(tokens)) for tokens, score in modes.beam_search(net.step(ids(t)), width=2, longest=6)] for t in texts]

    rows = spark.createDataFrame([(1, "ab"), (2, "b"), (2, None), (None, " ")], "k int, text string")
    got = modes.normalise(rows, 2, ["k"], generator=modes.NeuralGenerator(load)).collect()
    want = {t: found[0][0] for t, found in zip(("ab", "b"), load()(["ab", "b"]))}
    assert sorted(((r.k, r.text, r.normalised) for r in got), key=str) == sorted([(1, "ab", want["ab"]), (2, "b", want["b"]), (2, None, None), (None, " ", "")], key=str)


def test_padding_changes_nothing():
    net = network.Network(weights(), heads=2)
    a = net.encoded(np.array([[1, 4, 5, 2]])).value[0]
    b = net.encoded(np.array([[1, 4, 5, 2, 0, 0], [1, 3, 3, 3, 3, 2]])).value[0, :4]
    assert np.allclose(a, b)


def test_gradients_against_differences():
    w = training.initial(7, 6, width=4, layers=1, seed=3)
    source, target = np.array([[1, 4, 5, 2], [1, 6, 2, 0]]), np.array([[1, 4, 3, 2], [1, 5, 2, 0]])
    value = lambda w: float(training.loss(network.Network(w, 2), source, target, 0.1).value)
    net = network.Network(w, 2)
    gradients.backward(training.loss(net, source, target, 0.1))
    rng = np.random.default_rng(1)
    for name, node in net.weights.items():
        at = tuple(rng.integers(0, n) for n in node.value.shape)
        more, less = ({**w, name: w[name].copy()} for _ in range(2))
        more[name][at] += 1e-5
        less[name][at] -= 1e-5
        found = 0.0 if node.grad is None else node.grad[at]
        assert found == pytest.approx((value(more) - value(less)) / 2e-5, abs=1e-6), name


def copying(n, seed=1):
    rng = np.random.default_rng(seed)
    rows = [[1, *rng.integers(4, 7, rng.integers(1, 4)).tolist(), 2] for _ in range(n)]
    return [(r, r) for r in rows]


def test_training_learns_to_copy(tmp_path):
    settings = training.Settings(epochs=25, batch=16, heads=2, dropout=0.0, rate=0.01, save_every=10)
    w = training.initial(7, 7, width=16, layers=1)
    best, history, progress = training.train_locally(w, copying(200), copying(40, 2), settings, str(tmp_path))
    assert history[-1][0] < 0.5 * history[0][0] and progress.best == min(v for _, v in history)
    assert {p.name for p in tmp_path.iterdir()} == {"best.npz", "epoch_10.npz", "epoch_20.npz"}
    net = network.Network(network.load(str(tmp_path / "best.npz")), 2)
    assert sum(network.greedy(net.step(a), longest=6)[1:] == a[1:-1] for a, _ in copying(30, 3)) >= 27


def test_steps_of_adam_and_stopping():
    settings = training.Settings(rate=0.1, decay=0.0, longest_gradient=1.0)
    node = gradients.Node(np.array([1.0, 2.0]))
    adam = training.Adam(settings, 0.1)
    node.grad = np.array([3.0, -4.0])
    adam.step({"x": node})
    assert node.value == pytest.approx([0.9, 2.1]) and adam.means["x"] == pytest.approx([0.06, -0.08], rel=1e-5) and node.grad is None
    rates = []

    def epoch(w, rate, k):
        rates.append(rate)
        return w, [1.0]

    *_, progress = training.train({}, epoch, lambda w: [1.0], training.Settings(epochs=20, rate=1.0, patience=9))
    assert progress.stop and rates == [1.0] * 7 + [0.5] * 3


def test_training_on_a_cluster(spark):
    settings = training.Settings(epochs=6, batch=8, heads=2, dropout=0.1, rate=0.01)
    rows = spark.createDataFrame(copying(160), "source array<int>, target array<int>")
    w = training.initial(7, 7, width=8, layers=1)
    best, history, progress = training.train_on_cluster(w, rows, spark.createDataFrame(copying(30, 2), rows.schema), settings, tasks=2)
    assert len(history) == 6 and progress.best < history[0][1] and set(best) == set(w)
    with pytest.raises(ValueError):
        training.train_on_cluster(w, rows, rows, settings, tasks=1000)
