"""Networks on given weights against plain loops."""

import math

import numpy as np
import pytest

from cragline.operators import neural, reconstruct

W = reconstruct.seeded_weights(4, 4, 3, 5, 1)
KIND = "tile long, patch int, values array<double>, masked boolean, token string, `odd name` string"


def norm(x, scale):
    mean = sum(x) / len(x)
    var = sum((v - mean) ** 2 for v in x) / len(x)
    return [(v - mean) / math.sqrt(var + 1e-5) * a + b for v, a, b in zip(x, *scale.tolist())]


def one(values, patch, hidden):
    x = norm([sum(a * b for a, b in zip(values, row)) for row in W["embed"]], W["embed_scale"])
    token = [a + b for a, b in zip(x, W["place"][patch])]
    token = list(W["mask"][0]) if hidden else token
    x = [a + b for a, b in zip(token, W["again"][patch])]
    for k in range(4):
        x = [sum(a * b for a, b in zip(x, row)) + row[-1] for row in W[f"dense{k}"]]
        if k < 3:
            x = norm([0.5 * v * (1 + math.erf(v / math.sqrt(2))) for v in x], W[f"scale{k}"])
    return token, x


@pytest.mark.parametrize("hide", [False, True])
def test_reconstruction(spark, hide):
    draw = np.random.default_rng(7)
    rows = [(t, p, draw.normal(size=4).tolist(), bool(p % 2), "clash", "kept") for t in range(3) for p in range(4)]
    rows += [rows[0], (8, 1, None, True, "", ""), (8, None, [1.0] * 4, True, "", ""), (8, 2, [1.0, None, 1.0, 1.0], False, "", ""), (9, 3, [2.0] * 4, None, "", "")]
    got = reconstruct.reconstructed(spark.createDataFrame(rows, KIND), W, hide).collect()
    assert len(got) == len(rows) and got[0].asDict().keys() == {"tile", "patch", "values", "masked", "odd name", "token", "predicted"}
    want = {(t, p): one(v, p, hide and bool(m)) for t, p, v, m, *_ in rows if p is not None and v is not None and None not in v}
    for r in got:
        if (r.tile, r.patch) in want:
            assert np.allclose(r.token, want[r.tile, r.patch][0], atol=1e-12) and np.allclose(r.predicted, want[r.tile, r.patch][1], atol=1e-11)
        elif r.patch == 2:
            assert all(map(math.isnan, r.predicted))
        else:
            assert r.token is None and r.predicted is None
    loss = {r.tile: (r.loss, r.n) for r in reconstruct.masked_loss(reconstruct.reconstructed(spark.createDataFrame(rows[:12], KIND), W, hide)).collect()}
    for t in range(3):
        errors = [np.mean((((v := np.array(x[2])) - v.mean()) / np.sqrt(v.var(ddof=1) + 1e-6) - want[t, x[1]][1]) ** 2) for x in rows[:12] if x[0] == t and x[3]]
        assert loss[t][1] == 2 and abs(loss[t][0] - np.mean(errors)) < 1e-10


def test_empty_and_wrong_patches(spark):
    assert reconstruct.reconstructed(spark.createDataFrame([], KIND), W).count() == 0
    for bad in ((1, 0, [1.0], True, "", ""), (1, 4, [1.0] * 4, True, "", "")):
        with pytest.raises(Exception, match="patches must"):
            reconstruct.reconstructed(spark.createDataFrame([bad], KIND), W).collect()


def test_weight_tables(spark):
    kind = "name string, row int, values array<double>"
    back = reconstruct.weights_from(spark.createDataFrame(reconstruct.as_rows(W)[::-1], kind))
    assert back.keys() == W.keys() and all(np.array_equal(back[k], W[k]) for k in W)
    assert reconstruct.weights_from(spark.createDataFrame([], kind)) == {}
    with pytest.raises(ValueError, match="bound"):
        reconstruct.weights_from(spark.createDataFrame(reconstruct.as_rows(W), kind), most=10)
    for rows, text in (([("a", 0, [1.0]), ("a", 2, [1.0])], "gaps"), ([("a", 0, [1.0]), ("a", 1, [1.0, 2.0])], "gaps"), ([("a", 0, [1.0]), ("a", 0, [1.0])], "twice")):
        with pytest.raises(ValueError, match=text):
            reconstruct.weights_from(spark.createDataFrame(rows, kind))


def test_stochastic_passes_are_forward_passes_with_seeded_masks(spark):
    draw = np.random.default_rng(3)
    x, edges = draw.random((6, 4)), [(a, b) for a in range(6) for b in range(6) if a != b and (a + b) % 3]
    network = neural.seeded_network(4, 2)
    nodes = spark.createDataFrame([(1, 10 + i, *map(float, v)) for i, v in enumerate(x)], "tile long, id long, a double, b double, c double, d double")
    ends = spark.createDataFrame([(1, 10 + a, 10 + b) for a, b in edges], "tile long, src long, dst long")
    src, dst = (np.array(v) for v in zip(*edges))
    runs = []
    for k in range(4):
        keep = [np.array([np.random.default_rng([k, i, 10 + n]).random(w) >= 0.2 for n in range(6)]) / 0.8 for i, w in enumerate((32, 8))]
        runs.append(neural.forward(x, src, dst, x[:, :2], network, keep))
    got = sorted(neural.stochastic_scores(nodes, ends, list("abcd"), network, 4).collect(), key=lambda r: r.id)
    assert np.allclose([r["mean"] for r in got], np.mean(runs, 0)) and np.allclose([r["variance"] for r in got], np.var(runs, 0, ddof=1))


def test_error_function():
    x = np.r_[np.linspace(-7, 7, 20001), np.inf, -np.inf, 0.0]
    assert np.abs(neural.erf(x) - [math.erf(v) for v in x]).max() < 1e-13 and np.isnan(neural.erf(np.array([np.nan]))[0])
