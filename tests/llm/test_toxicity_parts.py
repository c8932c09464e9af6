"""The parts of the toxicity operator by their definitions: lexicon, features, splits, calibration, score."""

import math
import random

import numpy as np
from llm_tables import prose

from veldtext.llm import toxicity as X


def features_by_definition(text, lexicon):
    """The row of NAMES, token by token."""
    tokens = text.split()
    rows = []
    for token in tokens:
        word = X.bare(token)
        whole = lexicon.get("=" + word, 0.0)
        begin = max([lexicon.get(word[:n], 0.0) for n in X.BEGINNINGS if len(word) >= n], default=0.0)
        letters = sum(c.isalpha() for c in word)
        mixed = 0 < letters < len(word)
        plain = "".join(c for c in token.lower().translate(X.ALIKE) if c.isalpha())
        read = lexicon.get("=" + plain, 0.0) if mixed else 0.0
        upper = sum(c.isupper() for c in token)
        rows.append(
            {
                "weight": max(whole, begin, read), "whole": whole > 0, "begin": begin > 0, "read": read > 0, "second": word in X.SECOND, "upper": upper,
                "caps": upper > 1 and upper == letters, "!": token.count("!"), "?": token.count("?"), "marks": sum(not c.isalnum() for c in token),
                "mixed": mixed, "thrice": any(a == b == c and a.isalpha() for a, b, c in zip(word, word[1:], word[2:])), "single": len(word) == 1,
            }
        )
    n, chars = len(tokens), max(1, len(text))
    if not n:
        return [0.0] * len(X.NAMES)
    total = {k: sum(r[k] for r in rows) for k in rows[0]}
    hit = [k for k, r in enumerate(rows) if r["weight"] > 0]
    near = sum(any(r["second"] for r in rows[max(0, k - 3) : k + 4]) for k in hit)
    return [
        len(hit) / n, total["weight"] / n, total["weight"], max(r["weight"] for r in rows), total["whole"], total["begin"], total["read"], near, near / n,
        total["second"] / n, total["upper"] / chars, total["caps"] / n, total["!"] / n, total["?"] / n, total["marks"] / chars, total["mixed"] / n,
        total["thrice"] / n, total["single"] / n, math.log1p(n),
    ]


def test_features():
    rng = random.Random(2)
    lexicon = {"=rude": 1.5, "=stink": 0.75, "=word": 0.25, "rude": 0.5, "stin": 1.25, "stinker"[:6]: 2.0, "=i": 0.125}
    parts = ["rude", "RUDE!", "r00de", "rud3", "st1nk", "stinkers", "word.", "you", "YOUR", "I", "a1b", "sooo", "!!!", "?", "(you)", "ünïk", "Stink?!", "$tink", "--", "1", "yyy"]
    texts = [" ".join(rng.choices(parts, k=rng.randint(0, 14))) for _ in range(400)] + ["", "  ", "x" * 10_000]
    got = X.Features(lexicon).rows(texts)
    want = np.array([features_by_definition(t, lexicon) for t in texts])
    assert np.allclose(got, want, rtol=1e-6, atol=1e-9)


def test_features_with_a_small_memory(monkeypatch):
    texts = [prose(k, 30) for k in range(20)]
    whole = X.Features({"=" + w: 1.0 for w in texts[3].split()}).rows(texts)
    for name in ("MOST_TOKENS", "MOST_CHARS"):
        monkeypatch.setattr(X, name, 20)
        small = X.Features({"=" + w: 1.0 for w in texts[3].split()})
        assert np.array_equal(np.concatenate([small.rows([t]) for t in texts]), whole)


def test_lexicons(spark):
    rng = random.Random(5)
    rows = []
    for k in range(400):
        toxic = int(k % 4 == 0)
        words = prose(k, 20, 60).split() + (["badword" + "xyz"[k % 3], "rotten"] if toxic and rng.random() < 0.8 else [])
        rows.append((" ".join(words), toxic, k // 4 % 2))
    found = X._lexicons(spark.createDataFrame(rows, "text string, toxic int, fold int"))
    for folds, lexicon in zip(((0,), (1,), (0, 1)), found, strict=True):
        own = [r for r in rows if r[2] in folds]
        size = [sum(r[1] == t for r in own) for t in (0, 1)]
        counts = {}
        for text, toxic, _ in own:
            for term in {t for w in {X.bare(x) for x in text.split()} - {""} for t in X.terms_of(w)}:
                counts.setdefault(term, [0, 0])[toxic] += 1
        want = {}
        for term, (b, a) in counts.items():
            share = size[1] / sum(size)
            g = 2 * (a * math.log(a / ((a + b) * share)) + (b * math.log(b / ((a + b) * (1 - share))) if b else 0)) if a else 0
            if a >= X.LEAST_ROWS and a > (a + b) * share and g >= X.LEAST_G:
                want[term] = math.log((a + 0.5) / (size[1] + 1)) - math.log((b + 0.5) / (size[0] + 1))
        assert lexicon.keys() == want.keys() and all(abs(lexicon[t] - w) < 1e-9 for t, w in want.items()) and "=rotten" in want


def test_first_split_is_the_best():
    rng = np.random.default_rng(7)
    x = rng.integers(0, 12, (300, 3)).astype(float)
    y = (x[:, 1] > 6).astype(float)
    y[rng.random(300) < 0.1] = 1
    made = X.Trees(rounds=1, depth=1).fit(x, y)
    p = y.mean()
    gradient, curve = p - y, np.full(300, p * (1 - p))
    best = max(
        (
            gradient[x[:, f] <= c].sum() ** 2 / (curve[x[:, f] <= c].sum() + 1) + gradient[x[:, f] > c].sum() ** 2 / (curve[x[:, f] > c].sum() + 1),
            (f, c),
        )
        for f in range(3)
        for c in range(11)
    )[1]
    (feature, cut), leaf = made.grown[0][0][0], made.grown[0][1]
    assert (int(feature[0]), float(cut[0])) == best
    right = x[:, best[0]] > best[1]
    assert np.allclose(leaf, [-0.15 * gradient[side].sum() / (curve[side].sum() + 1) for side in (~right, right)])
    assert np.allclose(made.margins(x), math.log(p / (1 - p)) + np.where(right, leaf[1], leaf[0]))


def test_isotonic_is_the_min_max_of_means():
    rng = np.random.default_rng(3)
    for _ in range(30):
        m, y = rng.permutation(40).astype(float), rng.integers(0, 2, 40).astype(float)
        knots, values = X.isotonic(m, y)
        rising = y[np.argsort(m)]
        want = [max(min(rising[j : k + 1].mean() for k in range(i, 40)) for j in range(i + 1)) for i in range(40)]
        assert np.allclose(np.interp(np.sort(m), knots, values), want)


def test_score_is_the_calibrated_margin():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(200, 3))
    y = (x[:, 0] + rng.normal(size=200) > 0).astype(float)
    trees = X.Trees(rounds=10).fit(x, y)
    margin = trees.margins(x)
    knots, values = X.isotonic(margin, y)
    got = X.Scorer({}, trees, knots, values, 0.5).scores(x)
    assert np.allclose(got, 0.999 * np.interp(margin, knots, values) + 0.001 / (1 + np.exp(-margin))) and got.min() >= 0 and got.max() <= 1
