"""Recall of operator 3 by item length and kind of edits, within the allowed edits."""

import random

import numpy as np
import pytest

from msgscope.llm import leaks

ITEMS = 60


def edited(rng, words, kind, mark):
    n = len(words)
    k, w = int(n * leaks.EDITS + 1e-9), words[:]
    if kind == "spread":
        for p in rng.sample(range(n), k):
            w[p] = f"{mark}e{p}"
    elif kind == "first":  # evenly over the first power of two of words
        for j in range(k):
            w[j * (1 << (n.bit_length() - 1)) // k] = f"{mark}e{j}"
    elif kind == "block":
        a = rng.randrange(n - k + 1)
        w[a : a + k] = [f"{mark}e{j}" for j in range(k)]
    else:
        for j in range(k):
            p, r = rng.randrange(len(w)), rng.randrange(3)
            w[p : p + (r > 0)] = [] if r == 1 else [f"{mark}e{j}"]
    return w


@pytest.mark.parametrize("kind", ["spread", "first", "block", "mixed"])
@pytest.mark.parametrize("n", [5, 7, 15, 16, 31, 59, 127, 255, 511])
def test_recall(n, kind):
    rng = random.Random(n)
    own = [[f"w{i}x{j}" for j in range(n)] for i in range(ITEMS)]
    texts = [" ".join([f"a{i}x{j}" for j in range(40 + rng.randrange(40))] + edited(rng, w, kind, i) + [f"b{i}x{j}" for j in range(40)]) for i, w in enumerate(own)]
    raw = [t.encode() for t in texts]
    off = np.concatenate([[0], np.cumsum([len(t) for t in raw])]).astype(np.int64)
    best = leaks.Items([" ".join(w) for w in own]).matches(*leaks.plain_words(np.frombuffer(b"".join(raw), np.uint8), off))
    assert all(row == item for row, item in best)
    assert len(best) >= 0.97 * ITEMS
