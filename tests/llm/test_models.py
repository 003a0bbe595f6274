"""The language mixtures and the attention model against plain recomputation."""

from __future__ import annotations

import itertools
import math
import random

import numpy as np

from strandlight.llm import language_id, quality_classifier


def model_of(r: random.Random, letters: dict[str, str]) -> language_id.Model:
    p = np.full((language_id.SLOTS, len(letters)), 0.2)
    for k, x in enumerate(letters.values()):
        text = " ".join("".join(r.choice(x) for _ in range(r.randrange(1, 8))) for _ in range(300))
        p[:, k] += np.bincount(language_id.grams(text)[0], minlength=language_id.SLOTS)
    return language_id.Model(list(letters), np.log(p / p.sum(axis=0)).astype(np.float32))


def likelihoods(model: language_id.Model, text: str) -> list[list[float]]:
    """Scaled word likelihoods, word by word."""
    out = []
    for word in text.split():
        ll = [sum(float(model.log_p[s, k]) for s in language_id.grams(word)[0]) for k in range(len(model.languages))]
        out.append([math.exp(max(x - max(ll), -60.0)) for x in ll])
    return out


def best_share(e: list[list[float]], a: int, b: int) -> tuple[float, float]:
    """(share of a, log-likelihood) of the best mixture of two languages, on a grid."""
    return max(((x, sum(math.log(x * w[a] + (1 - x) * w[b]) for w in e)) for x in np.linspace(0.0005, 0.9995, 1000)), key=lambda y: y[1])


def test_mixtures_against_a_grid():
    r = random.Random(3)
    model = model_of(r, {"A": "abcdefg", "B": "efghijk", "C": "uvwxyzé"})
    for share in (0.0, 0.3, 0.6, 0.9):
        words = ["".join(r.choice("abcdefg" if r.random() < share else "uvwxyzé") for _ in range(r.randrange(2, 8))) for _ in range(80)]
        text = " ".join(words)
        e = likelihoods(model, text)
        single = max((sum(math.log(w[k]) for w in e), -k) for k in range(3))
        pairs = {(a, b): best_share(e, a, b) for a, b in itertools.combinations(range(3), 2)}
        (a, b), (x, fit) = max(pairs.items(), key=lambda y: y[1][1])
        name, score, shares = language_id.mixture(model, text)
        if fit - 0.5 * math.log(len(e)) > single[0] + 1:
            assert set(shares) >= {model.languages[k] for k, s in ((a, x), (b, 1 - x)) if s > 0.05}
            assert abs(shares[model.languages[a]] - x) < 0.06
        elif fit - 0.5 * math.log(len(e)) < single[0] - 1:
            assert shares == {model.languages[-single[1]]: 1.0}
        assert name == max(shares, key=lambda k: shares[k]) and score == shares[name]


def test_slices_change_nothing(monkeypatch):
    r = random.Random(4)
    model = model_of(r, {"A": "abcdefg", "B": "efghijk", "C": "uvwxyzé"})
    text = " ".join("".join(r.choice(r.choice(["abcdefg", "uvwxyzé"])) for _ in range(r.randrange(1, 40))) for _ in range(300)) + " " + "ab" * 4000
    slots, starts = language_id.grams(text)
    whole = np.concatenate(list(language_id._word_blocks(model, slots, starts)))
    want = language_id.mixture(model, text)
    monkeypatch.setattr(language_id, "BLOCK", 100)
    parts = np.concatenate(list(language_id._word_blocks(model, slots, starts)))
    assert np.allclose(whole, parts, rtol=1e-3) and np.allclose(whole[:300], likelihoods(model, text)[:300], rtol=1e-3)
    got = language_id.mixture(model, text)
    assert got[0] == want[0] and np.allclose([*got[2].values()], [*want[2].values()], atol=1e-3)


def loss(w: dict[str, np.ndarray], bags: list[np.ndarray], labels: np.ndarray) -> float:
    """The weighted log loss, bag by bag, as the score reads the weights."""
    weight = np.where(labels == 1, len(labels) / (2 * labels.sum()), len(labels) / (2 * (len(labels) - labels.sum())))
    p = np.array([quality_classifier.Model(w).score(x)[0] for x in bags])
    return float((-weight * (labels * np.log(p) + (1 - labels) * np.log(1 - p))).mean())


def test_a_step_follows_the_gradient():
    r = np.random.default_rng(0)
    bags = [r.standard_normal((n, quality_classifier.FEATURES)).astype(np.float32) / 4 for n in (1, 3, 2, 5)]
    labels = np.array([0, 1, 1, 0], np.float32)
    start = quality_classifier._init(0)
    # one step of Adam moves each weight by the rate against the sign of its gradient
    after = quality_classifier.fit(bags, labels, epochs=1, batch=4, rate=1e-3, decay=0.0).w
    wide = {k: x.astype(np.float64) for k, x in start.items()}
    right = total = 0
    for k in wide:
        for at in list(np.ndindex(wide[k].shape))[:: max(1, wide[k].size // 12)]:
            old, h = wide[k][at], 1e-5
            wide[k][at] = old + h
            up = loss(wide, bags, labels)
            wide[k][at] = old - h
            down = loss(wide, bags, labels)
            wide[k][at] = old
            slope = (up - down) / (2 * h)
            if abs(slope) > 1e-5:
                total += 1
                right += np.sign(after[k][at] - start[k][at]) == -np.sign(slope)
    assert total > 40 and right >= 0.97 * total


def test_an_ideographic_space_ends_a_word():
    text = "　".join(["word"] * 1000)
    assert len(quality_classifier.passages(text)) == 16 == len(quality_classifier.passages(text.replace("　", " ")))
