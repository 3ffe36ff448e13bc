"""Operator 9: features, trees and calibration against plain loops; recall on held-out rows."""

import math
import random
import re
import zlib

import numpy as np
import pytest

from lithograph.llm import queries, toxicity
from lithograph.llm.toxicity import BEGINNINGS, DRAWN, EDGES, INSIDE, LOOKALIKES, NEAR, SECOND_PERSON


def brute_features(text: str, lexicon: dict[str, float]) -> list[float]:
    """Word by word, letter by letter: the columns of toxicity.NAMES."""
    raw = [b.decode("utf-8", "replace") for b in text.encode().split()]
    ws = [w.lower().strip(EDGES) for w in raw]
    own = [lexicon.get(w, 0.0) for w in ws]
    start = [max([lexicon.get(w[:k] + "*", 0.0) for k in BEGINNINGS if len(w) > k], default=0.0) for w in ws]
    second = [w in SECOND_PERSON for w in ws]
    odd = [bool(INSIDE.search(w)) for w in ws]
    hidden = [o and not v and lexicon.get(w.translate(LOOKALIKES).strip(EDGES), 0.0) > 0 for w, o, v in zip(ws, odd, own, strict=True)]
    near = sum(1 for i, v in enumerate(own) if v > 0 and any(second[max(0, i - NEAR) : i + NEAR + 1]))
    n, size = max(len(ws), 1), max(len(text.encode()), 1)
    upper, letters = len(re.findall("[A-Z]", text)), len(re.findall("[A-Za-z]", text))
    hits, starts = sum(v > 0 for v in own), sum(v > 0 for v in start)
    shouted = sum(len(w) > 2 and w.encode().isupper() for w in raw)
    return [
        math.log1p(len(ws)), hits, hits / n, max(own, default=0.0), sum(own) / n, starts / n, sum(start) / n, max(start, default=0.0), near / n, sum(second) / n,
        upper / max(letters, 1), shouted / n, text.count("!") / size, text.count("?") / size, sum(odd) / n, sum(hidden) / n, sum(bool(DRAWN.search(w.lower())) for w in ws) / n,
    ]


LEXICON = {"idiot": 3.0, "stup*": 2.0, "scum": 1.5, "trash": 4.0, "ängst*": 0.5}
TEXTS = [
    "", " \n ", "You are an IDIOT!!", "idiot " * 30 + "you", "1d1ot sc*m tr@sh", "stupidity is stooopid?", "Ängstlich du, ihr SCUM", "a b c d e you f g h i j idiot", "x" * 4000, "ÜBER ÉTÉ abc ABC ABCD! ?", "no.w sc-um s.c.u.m",
]


def test_features_equal_plain_loops():
    rng = random.Random(3)
    words = "you idiot stupid 1diot TRASH trash, soooo what? du! a b c d e".split()
    texts = TEXTS + [" ".join(rng.choices(words, k=rng.randrange(40))) for _ in range(60)]
    got = toxicity.features([t.encode() for t in texts], LEXICON)
    assert np.allclose(got, [brute_features(t, LEXICON) for t in texts])
    assert np.allclose(got, np.concatenate([toxicity.features([t.encode()], LEXICON) for t in texts]))


def brute_boost(x, y, trees, depth):
    """Margins on x of the same trees, grown by trying every limit of every feature in turn."""
    share = min(max(y.mean(), 1e-3), 1 - 1e-3)
    margin = np.full(len(y), np.log(share / (1 - share)))
    limits = [sorted({*np.quantile(x[:, j], np.linspace(0, 1, toxicity.BINS + 1)[1:-1]), 0.0}) for j in range(x.shape[1])]
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = y - p, np.maximum(p * (1 - p), 1e-6)
        add = np.zeros(len(y))

        def grow(rows, level):
            best = None
            if level < depth and len(rows) >= 2 * toxicity.LEAST_ROWS:
                worth = lambda r: g[r].sum() ** 2 / (h[r].sum() + 1)  # noqa: B023, E731
                for j, limit in ((j, t) for j, ts in enumerate(limits) for t in ts):
                    left, right = rows[x[rows, j] <= limit], rows[x[rows, j] > limit]
                    if min(len(left), len(right)) >= toxicity.LEAST_ROWS and (gain := worth(left) + worth(right) - worth(rows)) > (best[0] + 1e-9 if best else 1e-3):
                        best = (gain, left, right)
            if best:
                grow(best[1], level + 1)
                grow(best[2], level + 1)
            elif len(rows):
                add[rows] = toxicity.SHRINK * g[rows].sum() / (h[rows].sum() + 1)  # noqa: B023

        grow(np.arange(len(y)), 0)
        margin = margin + add
    return margin


def test_trees_equal_plain_loops(monkeypatch):
    monkeypatch.setattr(toxicity, "TREES", 4)
    rng = np.random.default_rng(5)
    x = np.round(rng.normal(size=(150, 3)), 2)
    y = (x[:, 0] + x[:, 1] * x[:, 2] + rng.normal(size=150) > 0.3).astype(float)
    assert np.allclose(toxicity.boost(x, y).margin(x), brute_boost(x, y, 4, toxicity.DEPTH), atol=1e-6)


def test_calibration_is_the_best_monotone_fit():
    rng = np.random.default_rng(1)
    m, y = np.round(rng.normal(size=60), 1), rng.integers(0, 2, 60).astype(float)
    at, value = toxicity.isotonic(m, y)
    got = np.interp(m, at, value)
    ms = sorted(set(m))
    mean = lambda lo, hi: y[(m >= lo) & (m <= hi)].mean()
    want = {v: max(min(mean(lo, hi) for hi in ms if hi >= v) for lo in ms if lo <= v) for v in ms}  # the min-max formula
    assert np.allclose(got, [want[v] for v in m])


def test_folds_do_not_follow_the_order():
    rows = [(f"text {i}", i % 2) for i in range(2000)]
    fold = toxicity.folds(rows)
    assert set(fold) == set(range(toxicity.FOLDS)) and all(abs((fold == k).mean() - 1 / toxicity.FOLDS) < 0.05 for k in range(toxicity.FOLDS))
    assert (toxicity.folds(rows[::-1])[::-1] == fold).all() and (toxicity.folds(rows, 1) != fold).any()


def auc(score, truth):
    pairs = [(a > b) + 0.5 * (a == b) for a in score[truth == 1] for b in score[truth == 0]]
    return np.mean(pairs)


def test_recall_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    truth = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    got = [r for r in queries.op9_toxicity(spark, sf).collect() if zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1 and truth.get(r["doc_id"]) is not None]
    y, score = np.array([truth[r["doc_id"]] for r in got]), np.array([r["score"] for r in got])
    hit = np.array([r["predicted"] for r in got]) == 1
    assert hit[y == 1].mean() >= 0.92 and y[hit].mean() >= 0.97 and auc(score, y) >= 0.98


@pytest.mark.parametrize("rows", [[], [("a", 1)], [("a b", 1), ("c", 1)], [("a b", 0)] * 9])
def test_too_few_rows_give_the_share(rows):
    want = np.mean([y for _, y in rows]) if rows else 0.5
    assert toxicity.train(rows).scores([b"x"])[0] == want
