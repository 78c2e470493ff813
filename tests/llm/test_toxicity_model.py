"""The Kneser-Ney models of op3 against counts in dictionaries."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from pedigree.llm import toxicity
from pedigree.llm.toxicity import DISCOUNT, ORDER, SHARED

EDGE, END = toxicity._EDGE, toxicity._END


def _grams(word, n):
    s = [EDGE] * (ORDER - 1) + list(word) + [END]
    return [tuple(s[t - n + 1 : t + 1]) for t in range(ORDER - 1, len(s))]


def _brute(words, weights):
    """n-gram -> log-ratio of the two classes, above the shared orders, by the definition."""
    raw = {n: [Counter(), Counter()] for n in range(1, ORDER + 1)}
    for word, *per_class in zip(words, *weights):
        for n in raw:
            for g in _grams(word, n):
                for y in (0, 1):
                    raw[n][y][g] += per_class[y]

    def count(n, y):
        if n == ORDER:
            return raw[n][y]
        before = Counter(g[1:] for g, c in raw[n + 1][y].items() if c > 0)  # distinct symbols before it
        return {g: raw[n][y][g] if g[0] == EDGE else before[g] for g in raw[n][y]}

    out, lower = {}, [defaultdict(lambda: 1 / toxicity._SYMBOLS)] * 2
    for n in range(1, ORDER + 1):
        c = [count(n, y) for y in (0, 1)]
        own = c if n > SHARED else [{g: c[0][g] + c[1][g] for g in c[0]}] * 2
        p = []
        for y in (0, 1):
            total, kinds = Counter(), Counter()
            for g, x in own[y].items():
                total[g[:-1]] += x
                kinds[g[:-1]] += x > 0
            level = {}
            for g, x in own[y].items():
                t, base = total[g[:-1]], lower[y][g[1:]]
                level[g] = max(x - DISCOUNT, 0) / t + DISCOUNT * min(kinds[g[:-1]], t / DISCOUNT) / t * base if t > 0 else base
            p.append(level)
        lower = p
        if n > SHARED:
            out |= {g: math.log(max(p[1][g], 1e-12)) - math.log(max(p[0][g], 1e-12)) for g in p[0] if raw[n][0][g] + raw[n][1][g] > 0}
    return out


def _flat(words):
    data = np.frombuffer(b"".join(words), np.uint8)
    ends = np.cumsum([len(w) for w in words])
    return data, ends - [len(w) for w in words], ends


@pytest.mark.parametrize("seed", range(6))
def test_ratios_against_dictionaries(seed):
    rng = random.Random(seed)
    spell = lambda: bytes(rng.choice(b"abcd") for _ in range(rng.choice([1, 2, 3, 5, 8, 20])))
    words = sorted({spell() for _ in range(40)})
    weights = np.array([[rng.choice([0, 0, 1, 2, 7]) for _ in words] for _ in range(4)], float)  # two folds of each class
    for folds in ([0], [1], [0, 1]):
        both = [sum(weights[y * 2 + f] for f in folds) for y in (0, 1)]
        known = _brute(words, both)
        model = toxicity._Counts(*_flat(words), weights).ratios(folds, 2)
        asked = words + [spell() for _ in range(30)]
        want = []
        for word in asked:
            grams = {n: _grams(word, n) for n in range(SHARED + 1, ORDER + 1)}
            want.append(sum(next((known[g[t]] for n, g in sorted(grams.items(), reverse=True) if g[t] in known), 0.0) for t in range(len(word) + 1)))
        assert model.words(*_flat(asked)) == pytest.approx(want, abs=1e-4)
