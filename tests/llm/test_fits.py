"""The toxicity fit against its own loss written out plainly, its counterfactuals against enumeration; wide windows of the quality rules."""

import math
import random

import pytest
from test_llm import brute_measures

from glossarion.llm import quality, toxicity

TERMS = (("aa", "bb"), ("cc", "dd", "ee"))


def plain_loss(weights, bias, sample, counterfactual, l2):
    """Row by row: label loss with both labels weighing alike, mean squared score change, and the penalty on weights."""
    z = lambda active: bias + sum(weights.get(f, 0.0) for f in set(active))
    out = l2 * (sum(w * w for w in weights.values()) + 1e-3 * bias * bias)
    for label in (0, 1):
        rows = [f for y, f, _ in sample if y == label]
        out += sum(math.log1p(math.exp(-z(f) if label else z(f))) for f in rows) / (2 * len(rows))
    changes = [(lost, gained) for _, _, c in sample for lost, gained in c]
    moved = [sum(weights.get(f, 0.0) for f in lost) - sum(weights.get(f, 0.0) for f in gained) for lost, gained in changes]
    return out + counterfactual * sum(m * m for m in moved) / max(1, len(moved))


@pytest.mark.parametrize("counterfactual", [0.0, 1.0, 30.0])
def test_fit_is_the_optimum_of_the_plain_loss(counterfactual):
    rng = random.Random(5)
    vocabulary = ["aa", "bb", "cc", "dd", "ee", "bad", "awful", "nice", "tree", "stone", "river"]
    sample = []
    for i in range(160):
        words = {rng.choice(vocabulary) for _ in range(4)}
        toxic = int(("bad" in words or "awful" in words) ^ (rng.random() < 0.1) or ("aa" in words and rng.random() < 0.5))
        sample.append((toxic, sorted(toxicity.text_features(words)), toxicity.counterfactuals(words, TERMS, i)))
    model = toxicity.fit(sample, counterfactual=counterfactual, min_docs=1)
    best = plain_loss(model.weights, model.bias, sample, counterfactual, 3e-4)
    for f in [*model.weights, "bias"]:
        for step in (1e-3, -1e-3):
            w = dict(model.weights)
            bias = model.bias + (step if f == "bias" else 0)
            if f != "bias":
                w[f] += step
            assert plain_loss(w, bias, sample, counterfactual, 3e-4) >= best - 1e-9
    # the gradient by differences is small beside that of a model without weights
    slope = lambda w, b, f: (plain_loss({**w, f: w.get(f, 0) + 1e-5}, b, sample, counterfactual, 3e-4) - plain_loss({**w, f: w.get(f, 0) - 1e-5}, b, sample, counterfactual, 3e-4)) / 2e-5
    assert max(abs(slope(model.weights, model.bias, f)) for f in model.weights) < 2e-3 < max(abs(slope({}, 0.0, f)) for f in model.weights)


def test_counterfactuals_by_enumeration():
    rng = random.Random(6)
    names = [a for line in TERMS for a in line]
    after = {line[i]: line[(i + 1) % len(line)] for line in TERMS for i in range(len(line))}
    for number in range(200):
        words = {rng.choice([*names, "x", "stone", "tree", "river", "so"]) for _ in range(rng.randint(0, 6))}
        held = words & set(names) or {TERMS[number % 2][number // 2 % len(TERMS[number % 2])]}
        whole, rest = words | held, words - held
        want = [{after[w] for w in held} | rest, rest]
        for (lost, gained), to in zip(toxicity.counterfactuals(words, TERMS, number), want, strict=True):
            a, b = toxicity.text_features(whole), toxicity.text_features(to)
            assert (set(lost), set(gained)) == (a - b, b - a)


def test_wide_windows_are_counted_as_narrow_ones(spark, monkeypatch):
    """Texts above the packed width take the other way, with the same results."""
    rng = random.Random(7)
    rows = [(i, "".join(rng.choice(["a ", "b ", "C# ", "\n", "dd "]) for _ in range(n))) for i, n in enumerate([0, 3, 7, 8, 9, 15, 40, 200] * 4)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    want = {i: brute_measures(t) for i, t in rows}
    for width in (1 << 24, 8):
        monkeypatch.setattr(quality, "_PACKED", width)
        assert {r["doc_id"]: tuple(r[m] for m in quality.MEASURES) for r in quality.ledger(df).collect()} == want
