"""Toxicity: gradient-boosted trees over dense features, calibrated by isotonic regression (operator 9).

Features of a whole text: densities of a lexicon of words and of one of word beginnings, how many hits
stand within ``NEAR`` words of a second-person word, capitals, loud punctuation, and rates of
obfuscated words (digits or signs inside a word, drawn-out letters, hits that show only once signs are
read as letters). Training takes at most ``ROWS`` labelled training documents (the documented bound,
within the bytes that ``common.labelled_sample`` states), dealt into ``FOLDS`` folds by a hash of the text: lexicons, trees and calibration are
cross-fitted, so every row serves all three and no stage sees how well the one before it knows its own rows.

Prediction is a map without shuffle; lexicons and trees are broadcast and have a fixed bound
(``LEXICON`` entries, ``TREES`` trees of ``DEPTH``).

Defined cases: a null or empty text has zero features and gets the score of those; without training
rows of both labels every score is the share of label 1, or 0.5 without any.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lithograph.llm.common import by_bytes, filled, labelled_sample, lengths, seg_sum, small_batches, text_bytes, word_ids

ROWS, LEXICON, NEAR = 6000, 20_000, 5
TREES, DEPTH, BINS, SHRINK, LEAST_ROWS, FOLDS = 60, 3, 32, 0.2, 8, 5

#: Second-person words of the four languages: fixed values.
SECOND_PERSON = frozenset(
    "you your yours yourself yourselves u ur du dich dir dein deine deinen deiner deinem euch euer eure ihr sie ihnen tu te toi ton ta tes vous votre vos tú ti tus tuyo usted ustedes vosotros os".split()
)
#: Signs that stand for letters: fixed values.
LOOKALIKES = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i", "+": "t", "*": None, ".": None, "-": None, "_": None})
EDGES = ".,;:!?\"'()[]{}<>«»“”‘’…-_*#%&$|/\\~"
DRAWN = re.compile(r"([^\W\d_])\1\1")
INSIDE = re.compile(r"[^\W\d_][\d@$*.!+_-]+[^\W\d_]")
BEGINNINGS = (4, 5, 6)
NAMES = ["words", "hits", "density", "strongest", "weight", "beginnings", "beginning_weight", "strongest_beginning", "near_second_person", "second_person", "capitals", "shouted", "exclaimed", "asked", "obfuscated", "hidden_hits", "drawn"]


def _clean(word: str) -> str:
    return word.strip(EDGES)


def learn_lexicon(rows: list[tuple[str, int]], least: int = 3, odds: float = 1.5) -> dict[str, float]:
    """Log-odds of words and of word beginnings (marked by a trailing ``*``) that toxic rows favour.

    An entry needs ``least`` different words before it: what near copies of one text repeat has one.
    """
    count: dict[int, Counter] = {0: Counter(), 1: Counter()}
    before: dict[str, set[str]] = defaultdict(set)
    n = Counter(label for _, label in rows)
    for text, label in rows:
        ws = [_clean(x) for x in text.lower().split()]
        entries = [(last, e) for last, w in zip(["", *ws], ws, strict=False) if w for e in (w, *(w[:k] + "*" for k in BEGINNINGS if len(w) > k))]
        count[label].update({e for _, e in entries})
        if label:
            for last, e in entries:
                if len(before[e]) < least:
                    before[e].add(last)
    out = {}
    for w, c in count[1].items():
        if len(before[w]) >= least and (v := math.log((c + 0.1) / (n[1] + 0.2)) - math.log((count[0][w] + 0.1) / (n[0] + 0.2))) >= odds:
            out[w] = round(min(v, 6.0), 4)
    return dict(sorted(out.items(), key=lambda x: (-x[1], x[0]))[:LEXICON])


def _word_traits(word: bytes, lexicon: dict[str, float]) -> tuple[float, float, bool, bool, float, bool]:
    """Weight, weight of its beginning, second person, obfuscated, weight once deciphered, drawn out."""
    raw = word.decode("utf-8", "replace").lower()
    w = _clean(raw)
    own = lexicon.get(w, 0.0)
    start = max((lexicon.get(w[:k] + "*", 0.0) for k in BEGINNINGS if len(w) > k), default=0.0)
    odd = bool(INSIDE.search(w))
    hidden = 0.0
    if odd and not own:
        plain = _clean(w.translate(LOOKALIKES))
        hidden = lexicon.get(plain, 0.0)
    return own, start, w in SECOND_PERSON, odd, hidden, bool(DRAWN.search(w))


def features(rows: list[bytes], lexicon: dict[str, float], memory: dict[bytes, tuple] | None = None) -> np.ndarray:
    """(texts, features) of whole texts; the columns are NAMES."""
    memory = {} if memory is None else memory
    words = [r.split() for r in rows]
    ids, owner, distinct = word_ids(words)
    if len(memory) > 200_000:
        memory.clear()
    traits = np.zeros((len(distinct), 6))
    for i, w in enumerate(distinct):
        t = memory.get(w)
        if t is None:
            t = _word_traits(w, lexicon)
            if len(w) <= 16:
                memory[w] = t
        traits[i] = t
    own, start, second, odd, hidden, drawn = traits[ids].T if len(ids) else np.zeros((6, 0))
    n = len(rows)
    total = lambda v: np.bincount(owner, v, n)
    n_words = np.bincount(owner, minlength=n).astype(float)
    some = np.maximum(n_words, 1)
    most = lambda v: _most(v, owner, n)
    ends = np.cumsum(n_words).astype(int)
    starts = ends - n_words.astype(int)
    run = np.concatenate([[0], np.cumsum(second)])
    place = np.arange(len(ids))
    near = run[np.minimum(place + NEAR + 1, ends[owner])] - run[np.maximum(place - NEAR, starts[owner])] > 0
    hit = own > 0
    buf = np.frombuffer(b"".join(rows), np.uint8)
    stop = np.cumsum(lengths(rows))
    begin = stop - lengths(rows)
    count = lambda m: seg_sum(m.astype(np.uint8), begin, stop)
    upper, letters = count((buf >= 65) & (buf <= 90)), count(((buf | 32) >= 97) & ((buf | 32) <= 122))
    size = np.maximum(stop - begin, 1)
    shouted = np.array([len(w) > 2 and w.isupper() for w in distinct], float)[ids] if len(ids) else np.zeros(0)
    return np.stack(
        [
            np.log1p(n_words), total(hit), total(hit) / some, most(own), total(own) / some,
            total(start > 0) / some, total(start) / some, most(start),
            total(hit & near) / some, total(second) / some,
            upper / np.maximum(letters, 1), total(shouted) / some,
            count(buf == 33) / size, count(buf == 63) / size,
            total(odd) / some, total(hidden > 0) / some, total(drawn) / some,
        ],
        1,
    )


def _most(v: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros(n)
    np.maximum.at(out, owner, v)
    return out


@dataclass
class Trees:
    """Complete binary trees: feature and limit of each inner node, value of each leaf."""

    prior: float
    feature: list[np.ndarray]
    limit: list[np.ndarray]
    value: list[np.ndarray]

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.prior)
        rows = np.arange(len(x))
        for f, t, v in zip(self.feature, self.limit, self.value, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (x[rows, f[node]] > t[node])
            out += v[node - len(f)]
        return out


def boost(x: np.ndarray, y: np.ndarray) -> Trees:
    """Second-order boosting of the logistic loss; splits at quantiles of each feature."""
    share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    out = Trees(float(np.log(share / (1 - share))), [], [], [])
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(x.shape[1])]
    edges = [np.unique(np.concatenate([e, [0.0]])) for e in edges]
    bins = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], 1)
    margin = np.full(len(y), out.prior)
    inner = (1 << DEPTH) - 1
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-margin))
        g, h = y - p, np.maximum(p * (1 - p), 1e-6)
        feature, limit = np.zeros(inner, np.int64), np.full(inner, np.inf)
        node = np.zeros(len(y), np.int64)
        for at in range(inner):
            own = node == at
            if own.sum() >= 2 * LEAST_ROWS:
                best = (1e-3, 0, np.inf, 0)
                gs, hs = g[own].sum(), h[own].sum()
                for j, e in enumerate(edges):
                    b = bins[own, j]
                    size = len(e) + 1
                    gl, hl, nl = (np.cumsum(np.bincount(b, w, size))[:-1] for w in (g[own], h[own], None))
                    gain = gl**2 / (hl + 1) + (gs - gl) ** 2 / (hs - hl + 1) - gs**2 / (hs + 1)
                    gain[(nl < LEAST_ROWS) | (own.sum() - nl < LEAST_ROWS)] = -1
                    if len(gain) and gain.max() > best[0]:
                        k = int(gain.argmax())
                        best = (float(gain[k]), j, float(e[k]), k)
                feature[at], limit[at] = best[1], best[2]
            node = np.where(own, 2 * at + 1 + (x[:, feature[at]] > limit[at]), node)
        leaf = node - inner
        size = inner + 1
        value = SHRINK * np.bincount(leaf, g, size) / (np.bincount(leaf, h, size) + 1)
        margin += value[leaf]
        out.feature.append(feature)
        out.limit.append(limit)
        out.value.append(value)
    return out


def isotonic(margin: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the non-decreasing fit (pool adjacent violators) of y on margin; blocks start as ties."""
    at, where = np.unique(margin, return_inverse=True)
    weight = np.bincount(where).astype(float)
    mean = np.bincount(where, y) / weight
    blocks: list[list[float]] = []  # mean, weight, first knot, last knot
    for m, w, x in zip(mean.tolist(), weight.tolist(), at.tolist(), strict=True):
        blocks.append([m, w, x, x])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            m2, w2, _, last = blocks.pop()
            b = blocks[-1]
            b[0], b[1], b[3] = (b[0] * b[1] + m2 * w2) / (b[1] + w2), b[1] + w2, last
    knots = [(x, b[0]) for b in blocks for x in ([b[2]] if b[2] == b[3] else [b[2], b[3]])]
    return np.array([k[0] for k in knots]), np.array([k[1] for k in knots])


@dataclass
class Model:
    lexicon: dict[str, float]
    trees: Trees | None
    knots: tuple[np.ndarray, np.ndarray]

    def scores(self, rows: list[bytes], memory: dict | None = None) -> np.ndarray:
        if self.trees is None:
            return np.full(len(rows), float(self.knots[1][0]))
        return np.clip(np.interp(self.trees.margin(features(rows, self.lexicon, memory)), *self.knots), 0, 1)


def folds(rows: list[tuple[str, int]], salt: int = 0) -> np.ndarray:
    """The fold of each row, by a hash of its text and so apart from any order of ids; equal texts share one."""
    return np.array([xxhash.xxh64_intdigest(t.encode("utf-8", "surrogatepass"), seed=salt) % FOLDS for t, _ in rows], np.int64)


def train(rows: list[tuple[str, int]], salt: int = 0) -> Model:
    """Lexicons, trees and calibration from (text, label) rows, cross-fitted in FOLDS folds.

    A row's features come from lexicons of the other folds, and the margin that calibrates it from trees
    of the other folds, so every row serves each stage and none is scored by what has seen it. The model
    that scores documents has lexicons and trees of all rows.
    """
    y = np.array([label for _, label in rows], float)
    fold = folds(rows, salt)
    inside = [fold == k for k in range(FOLDS) if (fold == k).any()]
    if any(len(set(y[~own])) < 2 for own in inside) or len(inside) < 2:
        return Model({}, None, (np.zeros(1), np.array([y.mean() if rows else 0.5])))
    texts = [t.encode("utf-8", "surrogatepass") for t, _ in rows]
    x = np.zeros((len(rows), len(NAMES)))
    for own in inside:
        lexicon = learn_lexicon([r for r, is_own in zip(rows, own, strict=True) if not is_own])
        x[own] = features([t for t, is_own in zip(texts, own, strict=True) if is_own], lexicon)
    margin = np.zeros(len(rows))
    for own in inside:
        margin[own] = boost(x[~own], y[~own]).margin(x[own])
    return Model(learn_lexicon(rows), boost(x, y), isotonic(margin, y))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score (0 to 1) of every row."""
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)

    def run(batches):
        memory: dict[bytes, tuple] = {}
        for batch in filled(batches):
            rows = text_bytes(batch)
            out = [shared.value.scores(rows[lo:hi], memory) for lo, hi in by_bytes(rows, 1_500_000)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(out), pa.float64())], ["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")


def classify(docs: DataFrame, labels: DataFrame, training: Column, threshold: float = 0.7) -> DataFrame:
    """Trains on labelled rows that ``training`` (a column over labels) holds for; scores every document."""
    model = train(labelled_sample(docs, labels, "toxic", training, ROWS))
    return score(docs, model).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
