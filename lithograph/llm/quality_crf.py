"""Quality classifier: a linear-chain conditional random field over lines (operator 2).

Each line of a text is good or bad. A line's features are its own measures and those of the lines
before and after it; two neighbouring labels have a transition weight. Training maximises the
conditional likelihood on at most ``ROWS`` labelled training documents (the documented bound), where
every line carries its document's label. Prediction runs forward-backward over all lines of a text
and aggregates the marginals, weighted by the lines' lengths, into the document's score. Documents of
a batch are the lanes of the recursions; a text of over ``LONG`` lines is a chain of its own, whose
features are made ``BLOCK`` lines at a time and whose recursions hold two numbers a line. No shuffle.

The training sample: at most ``ROWS`` documents of at most ``LONG`` lines, within the bytes that
``common.labelled_sample`` states.

Defined cases: a null or empty text is one empty line and gets that line's marginal; labels that
repeat for a document count once (the largest); without any training row every score is 0.5.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lithograph.llm.common import by_bytes, filled, labelled_sample, lengths, seg_sum, small_batches, text_bytes, word_ids

ROWS, STEPS, RATE, DECAY = 2500, 150, 0.1, 1e-4
LONG, BLOCK = 2000, 20_000

_B = np.arange(256)
_KINDS = {
    "upper": np.isin(_B, list(range(65, 91))),
    "lower": np.isin(_B, list(range(97, 123))) | (_B >= 0xC0),
    "digit": np.isin(_B, list(range(48, 58))),
    "symbol": np.isin(_B, list(b"#*$%&|<>=~^_\\{}[]@/+")),
    "loud": np.isin(_B, list(b"!?")),
    "stop": np.isin(_B, list(b".,;:'\"()-")),
    "space": np.isin(_B, list(b" \t\r\x0b\x0c")),
    "char": (_B < 0x80) | (_B >= 0xC0),
}


def own_features(flat: list[bytes], copy: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Measures of each line by itself, and its length in code points; ``copy``: 1 where it repeats a line before it."""
    buf = np.frombuffer(b"".join(flat), np.uint8)
    ends = np.cumsum(lengths(flat))
    starts = ends - lengths(flat)
    n = {k: seg_sum(m.astype(np.uint8)[buf], starts, ends).astype(np.float64) for k, m in _KINDS.items()}
    chars = np.maximum(n["char"], 1)
    words = [x.split() for x in flat]
    ids, line, _ = word_ids(words)
    n_words = np.fromiter(map(len, words), np.int64, len(flat))
    if len(ids):
        key = np.sort(line * (int(ids.max()) + 1) + ids)
        first = np.concatenate([[True], key[1:] != key[:-1]])
        distinct = np.bincount((key // (int(ids.max()) + 1))[first], minlength=len(flat))
        again = np.concatenate([[False], (ids[1:] == ids[:-1]) & (line[1:] == line[:-1])])
        doubled = np.bincount(line[again], minlength=len(flat))
    else:
        distinct = doubled = np.zeros(len(flat), np.int64)
    some = np.maximum(n_words, 1)
    letters = n["upper"] + n["lower"]
    own = np.stack(
        [
            n["upper"] / np.maximum(letters, 1),
            letters / chars,
            n["digit"] / chars,
            np.sqrt(n["symbol"] / chars),
            np.sqrt(n["loud"] / chars),
            n["stop"] / chars,
            n["space"] / chars,
            1 - distinct / some,
            doubled / some,
            copy,
            np.log1p(chars) / 6,
            np.minimum(chars / some, 30) / 10,
            (n_words == 0).astype(float),
        ],
        1,
    )
    return own, n["char"]


def with_neighbours(own: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Each line's measures, those of the lines before and after it in its text, a bias, and marks of a text's ends."""
    k = own.shape[1]
    x = np.zeros((len(own), 3 * k + 3))
    x[:, :k] = own
    same = owner[1:] == owner[:-1]
    inner = np.flatnonzero(same)
    x[inner + 1, k : 2 * k] = own[inner]
    x[inner, 2 * k : 3 * k] = own[inner + 1]
    x[:, 3 * k] = 1
    x[1:, 3 * k + 1], x[:-1, 3 * k + 2] = ~same, ~same
    x[:1, 3 * k + 1] = x[-1:, 3 * k + 2] = 1
    return x


def line_features(rows: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of every line, its length in code points and its row."""
    lines = [r.split(b"\n") for r in rows]
    counts = np.fromiter(map(len, lines), np.int64, len(rows))
    owner = np.repeat(np.arange(len(rows)), counts)
    flat = [x for ls in lines for x in ls]
    copy = np.zeros(len(flat))
    at = 0
    for ls in lines:
        if len(ls) > 1:
            seen: set[bytes] = set()
            for k, x in enumerate(ls):
                if x and x in seen:
                    copy[at + k] = 1
                seen.add(x)
        at += len(ls)
    own, chars = own_features(flat, copy)
    return with_neighbours(own, owner), chars, owner


@dataclass
class Field:
    """Weights of the label 'good' against 'bad', the transitions' weights (2 x 2), and the slope and
    offset of the logistic map from a document's mean marginal to its score."""

    state: np.ndarray
    step: np.ndarray
    slope: float = 0.0
    offset: float = 0.0


def forward_backward(odds: np.ndarray, step: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Marginals of 'good' for each line, expected transitions (2 x 2), and the log partition of all chains.

    ``odds``: a line's score for good less that for bad, chain after chain; ``counts``: lines of a chain.
    """
    order = np.argsort(-counts, kind="stable")
    first = (np.cumsum(counts) - counts)[order]
    size = counts[order]
    emit = np.ones((len(odds), 2))
    top = np.maximum(odds, 0)
    emit[:, 0], emit[:, 1] = np.exp(-top), np.exp(odds - top)
    move = np.exp(step)
    alpha, scale = np.empty((len(odds), 2)), np.empty(len(odds))
    longest = int(size[0]) if len(size) else 0
    active = np.searchsorted(-size, -np.arange(1, longest + 1), side="right")  # chains with a line at t
    for t in range(longest):
        at = first[: active[t]] + t
        a = emit[at] if t == 0 else (alpha[at - 1] @ move) * emit[at]
        s = a.sum(1)
        scale[at] = s
        alpha[at] = a / s[:, None]
    beta = np.ones((len(odds), 2))
    pairs = np.zeros((2, 2))
    for t in range(longest - 2, -1, -1):
        at = first[: active[t + 1]] + t
        after = beta[at + 1] * emit[at + 1] / scale[at + 1][:, None]
        pairs += move * (alpha[at].T @ after)
        beta[at] = after @ move.T
    both = alpha * beta
    return both[:, 1] / both.sum(1), pairs, float(np.log(scale).sum() + top.sum())


def train(rows: list[tuple[str, int]]) -> Field | None:
    """Maximum conditional likelihood by Adam on (text, label) rows."""
    if not rows:
        return None
    x, _, owner = line_features([t.encode("utf-8", "surrogatepass") for t, _ in rows])
    counts = np.bincount(owner, minlength=len(rows))
    y = np.array([label for _, label in rows])[owner]
    same = owner[1:] == owner[:-1]
    seen = np.zeros((2, 2))
    np.add.at(seen, (y[:-1][same], y[1:][same]), 1)
    w, step = np.zeros(x.shape[1]), np.zeros((2, 2))
    m, v = [np.zeros_like(w), np.zeros_like(step)], [np.zeros_like(w), np.zeros_like(step)]
    for i in range(1, STEPS + 1):
        p, pairs, _ = forward_backward(x @ w, step, counts)
        grads = [x.T @ (y - p) / len(y) - DECAY * w, (seen - pairs) / len(y) - DECAY * step]
        for weight, g, a, b in zip((w, step), grads, m, v, strict=True):
            a += 0.1 * (g - a)
            b += 0.01 * (g * g - b)
            weight += RATE * (a / (1 - 0.9**i)) / (np.sqrt(b / (1 - 0.99**i)) + 1e-8)
    field = Field(w, step)
    field.slope, field.offset = _logistic(mean_marginals(field, [t.encode("utf-8", "surrogatepass") for t, _ in rows]), np.array([label for _, label in rows], float))
    return field


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.02) -> tuple[float, float]:
    """Slope and offset of a ridge logistic regression of y on x, by Newton's method."""
    z = np.stack([x, np.ones_like(x)], 1)
    w = np.zeros(2)
    for _ in range(30):
        p = 1 / (1 + np.exp(-(z @ w)))
        g = z.T @ (y - p) - ridge * w
        h = (z * np.maximum(p * (1 - p), 1e-9)[:, None]).T @ z + ridge * np.eye(2)
        w += np.clip(np.linalg.solve(h, g), -5, 5)
    return float(max(w[0], 1e-6)), float(w[1])


def document_scores(field: Field, rows: list[bytes]) -> np.ndarray:
    """Score of each text: its mean marginal on the scale of the training documents' labels."""
    return 1 / (1 + np.exp(-(field.slope * mean_marginals(field, rows) + field.offset)))


def mean_marginals(field: Field, rows: list[bytes]) -> np.ndarray:
    """Mean marginal of 'good' over the lines of each text, weighted by their lengths."""
    out = np.empty(len(rows))
    longer = np.fromiter((r.count(b"\n") >= LONG for r in rows), bool, len(rows))
    for k in np.flatnonzero(longer).tolist():
        out[k] = long_mean(field, rows[k])
    if longer.all():
        return out
    rows = [r for r, x in zip(rows, longer, strict=True) if not x]
    x, chars, owner = line_features(rows)
    counts = np.bincount(owner, minlength=len(rows))
    p, _, _ = forward_backward(x @ field.state, field.step, counts)
    weight = np.maximum(chars, 1e-3)  # a text of empty lines only has the mean of their marginals
    out[~longer] = np.clip(np.bincount(owner, p * weight, len(rows)) / np.bincount(owner, weight, len(rows)), 0, 1)
    return out


def long_mean(field: Field, row: bytes, block: int = BLOCK) -> float:
    """``mean_marginals`` of one text of any number of lines: of a line only its score, its weight and one message stay."""
    ends = np.append(np.flatnonzero(np.frombuffer(row, np.uint8) == 10), len(row))
    starts = np.append(0, ends[:-1] + 1)
    n = len(ends)
    part = lambda i, j: row[starts[i] : ends[j - 1]].split(b"\n")
    blocks = [(i, min(i + block, n)) for i in range(0, n, block)]
    digest = np.concatenate([np.fromiter((xxhash.xxh64_intdigest(x) for x in part(i, j)), np.uint64, j - i) for i, j in blocks])
    copy = np.ones(n)
    copy[np.unique(digest, return_index=True)[1]] = 0
    copy[ends == starts] = 0
    odds, weight = np.empty(n), np.empty(n)
    for i, j in blocks:
        lo, hi = max(i - 1, 0), min(j + 1, n)  # a line more on both sides, for the neighbours' measures
        own, chars = own_features(part(lo, hi), copy[lo:hi])
        x = with_neighbours(own, np.zeros(hi - lo, int))[i - lo : j - lo]
        k = own.shape[1]
        x[:, 3 * k + 1] = x[:, 3 * k + 2] = 0
        x[0, 3 * k + 1], x[-1, 3 * k + 2] = i == 0, j == n
        odds[i:j], weight[i:j] = x @ field.state, np.maximum(chars[i - lo : j - lo], 1e-3)
    (m00, m01), (m10, m11) = np.exp(field.step - field.step.max()).tolist()
    emit = np.exp(np.clip(odds, -300, 300))
    forward = np.empty(n)  # the odds of 'good' given the lines up to here
    f = 1.0
    for i, j in blocks:
        out = []
        for k, e in enumerate(emit[i:j].tolist(), i):
            f = e if k == 0 else min(1e300, e * (m01 + f * m11) / (m00 + f * m10))
            out.append(f)
        forward[i:j] = out
    b = 1.0  # what the lines behind say for 'good' against 'bad'
    total = 0.0
    for i, j in reversed(blocks):
        for k in range(j - 1, i - 1, -1):
            both = forward[k] * b
            total += weight[k] * (both / (1 + both) if both < 1e300 else 1.0)
            e = min(1e300, emit[k] * b)
            b = (m10 + e * m11) / (m00 + e * m01)
    return float(np.clip(total / weight.sum(), 0, 1))


def score(docs: DataFrame, field: Field | None) -> DataFrame:
    """doc_id, score (0 to 1) of every row."""
    spark = docs.sparkSession
    small_batches(spark)
    model = spark.sparkContext.broadcast(field)

    def run(batches):
        for batch in filled(batches):
            rows = text_bytes(batch)
            out = [np.full(hi - lo, 0.5) if model.value is None else document_scores(model.value, rows[lo:hi]) for lo, hi in by_bytes(rows, 1_000_000, (len(r) + 50 * min(r.count(b"\n"), LONG) for r in rows))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(out), pa.float64())], ["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")


def classify(docs: DataFrame, labels: DataFrame, training: Column, threshold: float = 0.3) -> DataFrame:
    """Trains on labelled rows that ``training`` (a column over labels) holds for; scores every document."""
    field = train([r for r in labelled_sample(docs, labels, "quality", training, ROWS) if r[0].count("\n") < LONG])
    return score(docs, field).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
