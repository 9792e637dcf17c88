"""Likeness, gradients and preference fits against plain versions that enumerate everything."""

import itertools
import random
from collections import Counter

import numpy as np

from talentloom.llm import crf, imatch, ranking

VOWELS = ("ba", "ke", "ti", "no", "ru", "sa", "mi", "lo")


def words(rng, n):
    return " ".join("".join(rng.choice(VOWELS) for _ in range(rng.randint(1, 3))) for _ in range(n))


def test_likeness_of_a_table_equals_plain_sets(spark):
    rng, band = random.Random(8), (0.05, 0.4)
    texts = {i: words(rng, rng.randint(3, 80)) for i in range(30)} | {50: "solo", 51: "Ke BA ti", 52: "solo solo"}
    texts[60] = texts[3]
    ids = sorted(texts, reverse=True)
    df = Counter(t for x in texts.values() for t in set(imatch.terms(x)))
    inside = {t for t, n in df.items() if band[0] * len(texts) <= n <= band[1] * len(texts)}

    def subsets(text):
        chosen = imatch.terms(text) & inside or imatch.terms(text)
        return [frozenset(t for t in chosen if imatch.memberships(t) >> s & 1) for s in range(imatch.SUBSETS)]

    def alike(a, b):
        pairs = [(x, y) for x, y in zip(subsets(a), subsets(b), strict=True) if x or y]
        return sum(x == y for x, y in pairs) / len(pairs)

    got = {r["doc_id"]: r for r in imatch.compare_edits(
        spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3), band).collect()}
    assert set(got) == set(texts)
    for at, i in enumerate(ids):
        text, following = texts[i], texts[ids[(at + 1) % len(ids)]]
        third = len(text) // 3
        changed = text[:len(text) - third] + following[:third]
        assert abs(got[i]["near_edited"] - alike(text, changed)) < 1e-12
        assert abs(got[i]["near_next"] - alike(text, following)) < 1e-12
    assert got[3]["fingerprint"] == got[60]["fingerprint"]


def test_crf_gradients_equal_finite_differences():
    random_, sizes = np.random.default_rng(4), np.array([4, 1, 3])
    scores, moves = random_.normal(size=(8, 3)), random_.normal(size=(3, 3))

    def log_sum(scores, moves):
        total, start = 0.0, 0
        for n in sizes:
            own = scores[start:start + n]
            paths = [sum(own[t, p[t]] for t in range(n)) + sum(moves[p[t], p[t + 1]] for t in range(n - 1))
                     for p in itertools.product(range(3), repeat=int(n))]
            total, start = total + np.log(np.sum(np.exp(paths))), start + n
        return total

    def slopes(place, at):
        step = np.zeros_like(place)
        step[at] = 1e-5
        return step

    chance = crf.forward_backward(scores, sizes, moves)
    own = np.exp(scores - scores.max(axis=1, keepdims=True))
    inner = np.array([1, 2, 3, 6, 7])
    joint = crf._pair_chances(own, chance, inner, moves, sizes)
    for at in np.ndindex(scores.shape):
        step = slopes(scores, at)
        assert abs((log_sum(scores + step, moves) - log_sum(scores - step, moves)) / 2e-5 - chance[at]) < 1e-6
    for at in np.ndindex(moves.shape):
        step = slopes(moves, at)
        assert abs((log_sum(scores, moves + step) - log_sum(scores, moves - step)) / 2e-5 - joint[at]) < 1e-6


def test_preferences_are_fitted_over_all_pairs():
    random_ = np.random.default_rng(6)
    good = np.arange(240) % 3 > 0
    rows = random_.normal(size=(240, 3)) + np.where(good, 0.8, 0.0)[:, None] * np.array([1, 0, -1])
    model = ranking.fit(rows, good, 0.25)

    def strength(row):  # bins by counting edges
        at = [f * ranking.BINS + sum(e <= x for e in model.edges[f]) for f, x in enumerate(row)]
        return sum(model.weights[i] for i in at)

    strengths = np.array([strength(r) for r in rows])
    assert np.allclose(model.scores(rows), 1 / (1 + np.exp(model.threshold - strengths)))
    decay = ranking._DECAY

    def loss(weights):  # every pair of a good and a bad row
        x = ranking._binned(rows, model.edges) @ weights
        return np.mean(np.log1p(np.exp(x[~good][None, :] - x[good][:, None]))) + decay / 2 * weights @ weights

    least = loss(model.weights)
    assert least < 0.75 * loss(np.zeros_like(model.weights))
    for _ in range(40):
        step = random_.normal(size=model.weights.shape)
        assert loss(model.weights + 0.5 * step / np.linalg.norm(step)) > least - 1e-3
    weight = np.where(good, 0.75 / good.sum(), 0.25 / (~good).sum())
    assert abs(weight[strengths < model.threshold].sum() - 0.25) < 0.02
    assert ranking.fit(rows, np.ones(240, bool), 0.25) is None
