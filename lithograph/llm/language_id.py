"""Language identification by a bidirectional gated recurrent network over bytes (operator 4).

Every byte of a text is a position. Texts are cut into windows of ``WINDOW`` bytes; one network reads
each window forwards, one backwards, and both states label every position with a probability for each
language. A document's probabilities are the means over the positions of all its windows, whole texts
included. Training is backpropagation through time in numpy on the driver, on at most
``ROWS_PER_LANGUAGE`` training documents of each language, ``WINDOWS_PER_ROW`` windows of each: the
documented bound of the sample. The sample is drawn by a hash of doc_id, so it is the same each run.

Prediction reads text only. It is a map without shuffle: windows of many documents are the lanes of
small matrices, so time steps are vector operations and long texts simply have more lanes.

Defined cases: ``und`` with score 0 if the text is null or has no letter, or if there is no training
row; otherwise the most probable language (ties: the first in order) and its probability.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lithograph.llm.common import by_bytes, filled, small_batches, text_bytes

WINDOW, HIDDEN = 128, 8
ROWS_PER_LANGUAGE, WINDOWS_PER_ROW = 600, 2
STEPS, LANES, TRAIN_WINDOW, RATE, SEED = 260, 192, 64, 0.02, 7
PAD = 256
#: accepted() also turns away texts whose best language has less than this many times the mean probability
#: of a chance label, 1 / languages: the parameter of the rejection.
REJECT = 1.2
LETTER = re.compile(r"[^\W\d_]")


@dataclass
class Network:
    """Input table, recurrent matrix and bias of each direction; the label layer. Rows r, z, n of a gate block."""

    languages: list[str]
    inputs: list[np.ndarray]  # (3h, 257) a direction, column PAD is padding
    recur: list[np.ndarray]  # (3h, h)
    bias: list[np.ndarray]  # (h, 1): inside the candidate's reset product
    label: list[np.ndarray]  # (languages, h)
    label_bias: np.ndarray  # (languages, 1)


def _start(languages: list[str], h: int, rng: np.random.Generator) -> Network:
    w = lambda *s, k: (rng.standard_normal(s) * k).astype(np.float32)
    return Network(languages, [w(3 * h, PAD + 1, k=0.3) for _ in "fb"], [w(3 * h, h, k=0.5 / np.sqrt(h)) for _ in "fb"], [np.zeros((h, 1), np.float32) for _ in "fb"], [w(len(languages), h, k=0.3) for _ in "fb"], np.zeros((len(languages), 1), np.float32))


def _squash(x: np.ndarray, scratch: np.ndarray) -> np.ndarray:
    """x / (1 + |x|) in place: the candidate's activation, and twice the gates' less one.

    It takes a fraction of the time of exp and tanh and trains as well here.
    """
    np.abs(x, out=scratch)
    scratch += 1
    x /= scratch
    return x


def position_logits(net: Network, windows: np.ndarray) -> np.ndarray:
    """(time, languages, lanes): label logits at every position; windows: (time, lanes) byte values or PAD."""
    steps, lanes = windows.shape
    h, k = net.bias[0].shape[0], len(net.languages)
    out = np.empty((steps, k, lanes), np.float32)
    out[:] = net.label_bias
    for way in (0, 1):
        # the label layer reads a state in the product that the next step needs anyway
        table, b, both = net.inputs[way], net.bias[way], np.concatenate([net.recur[way], net.label[way]])
        state = np.zeros((h, lanes), np.float32)
        x, g, scratch = np.empty((3 * h, lanes), np.float32), np.empty((3 * h + k, lanes), np.float32), np.empty((2 * h, lanes), np.float32)
        gates, cand = g[: 2 * h], g[2 * h : 3 * h]
        last = None
        for t in range(steps) if way == 0 else range(steps - 1, -1, -1):
            np.take(table, windows[t], axis=1, out=x, mode="clip")
            np.matmul(both, state, out=g)
            if last is not None:
                out[last] += g[3 * h :]
            last = t
            gates += x[: 2 * h]
            _squash(gates, scratch)
            gates += 1
            gates *= 0.5
            cand += b
            cand *= g[:h]
            cand += x[2 * h :]
            _squash(cand, scratch[:h])
            state -= cand
            state *= g[h : 2 * h]
            state += cand
        if last is not None:
            out[last] += net.label[way] @ state
    return out


def _gradients(net: Network, windows: np.ndarray, target: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """Loss and gradients (inputs, recur, bias, label of each direction, then label_bias) through time."""
    steps, lanes = windows.shape
    h, k = net.bias[0].shape[0], len(net.languages)
    p = np.exp(position_logits(net, windows))
    p /= p.sum(1, keepdims=True)
    real = (windows != PAD).astype(np.float32)
    total = real.sum()
    hit = np.zeros((k, lanes), np.float32)
    hit[target, np.arange(lanes)] = 1
    loss = -float((np.log((p * hit).sum(1) + 1e-9) * real).sum() / total)
    d_logits = (p - hit) * real[:, None] / total
    grads: list[np.ndarray] = []
    for way in (0, 1):
        table, u, b, v = net.inputs[way], net.recur[way], net.bias[way], net.label[way]
        order = list(range(steps)) if way == 0 else list(range(steps - 1, -1, -1))
        state, kept = np.zeros((h, lanes), np.float32), []
        for t in order:
            x, g = table[:, windows[t]], u @ state
            rz = g[: 2 * h] + x[: 2 * h]
            rz /= 1 + np.abs(rz)  # the gate is (1 + rz) / 2, its slope (1 - |rz|)^2 / 2
            inner = g[2 * h :] + b
            cand = x[2 * h :] + (rz[:h] + 1) * 0.5 * inner
            cand /= 1 + np.abs(cand)
            kept.append((t, state, rz, inner, cand))
            state = cand + (rz[h:] + 1) * 0.5 * (state - cand)
        d_table, d_u, d_b, d_v = np.zeros_like(table), np.zeros_like(u), np.zeros_like(b), np.zeros_like(v)
        d_state = np.zeros((h, lanes), np.float32)
        after = state
        for t, before, rz, inner, cand in reversed(kept):
            gate = (rz + 1) * 0.5
            slope = 0.5 * (1 - np.abs(rz)) ** 2
            d_v += d_logits[t] @ after.T
            d_state = d_state + v.T @ d_logits[t]
            d_cand = d_state * (1 - gate[h:]) * (1 - np.abs(cand)) ** 2
            d_z = d_state * (before - cand) * slope[h:]
            d_inner = d_cand * gate[:h]
            d_r = d_cand * inner * slope[:h]
            d_g = np.concatenate([d_r, d_z, d_inner])
            d_x = np.concatenate([d_r, d_z, d_cand])
            d_u += d_g @ before.T
            d_b += d_inner.sum(1, keepdims=True)
            for row in range(3 * h):
                d_table[row] += np.bincount(windows[t], d_x[row], PAD + 1)
            d_state = d_state * gate[h:] + u.T @ d_g
            after = before
        grads += [d_table, d_u, d_b, d_v]
    return loss, [*grads, d_logits.sum((0, 2))[:, None]]


def _weights(net: Network) -> list[np.ndarray]:
    return [w for way in (0, 1) for w in (net.inputs[way], net.recur[way], net.bias[way], net.label[way])] + [net.label_bias]


def train(rows: list[tuple[bytes, str]], steps: int = STEPS, seed: int = SEED) -> Network | None:
    """Fits the network to (window, language) rows by Adam; languages weigh alike."""
    rows = sorted((r for r in rows if r[0]), key=lambda r: (r[1], r[0]))
    languages = sorted({r[1] for r in rows})
    if not languages:
        return None
    rng = np.random.default_rng(seed)
    net = _start(languages, HIDDEN, rng)
    by = [[np.frombuffer(t, np.uint8) for t, lang in rows if lang == x] for x in languages]
    weights = _weights(net)
    m, s = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
    for step in range(1, steps + 1):
        target = rng.integers(0, len(languages), LANES)
        windows = np.full((TRAIN_WINDOW, LANES), PAD, np.int64)
        for lane, k in enumerate(target.tolist()):
            t = by[k][rng.integers(len(by[k]))]
            at = rng.integers(0, max(1, len(t) - TRAIN_WINDOW + 1))
            part = t[at : at + TRAIN_WINDOW]
            windows[: len(part), lane] = part
        _, grads = _gradients(net, windows, target)
        rate = RATE * min(1.0, 2 * (1 - step / (steps + 1)))
        for w, g, a, b in zip(weights, grads, m, s, strict=True):
            np.clip(g, -1, 1, out=g)
            a += 0.1 * (g - a)
            b += 0.01 * (g * g - b)
            w -= rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-8)
    return net


def document_probabilities(net: Network, rows: list[bytes], lanes: int = 2048) -> np.ndarray:
    """(documents, languages): mean probabilities over all positions of each text; empty texts: zeros."""
    k = len(net.languages)
    out, places = np.zeros((len(rows), k), np.float64), np.zeros(len(rows))
    buf = np.frombuffer(b"".join(rows), np.uint8)
    lens = np.fromiter(map(len, rows), np.int64, len(rows))
    count = -(-lens // WINDOW)
    owner = np.repeat(np.arange(len(rows)), count)
    first = np.repeat(np.cumsum(lens) - lens, count) + WINDOW * (np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count))
    size = np.minimum(WINDOW, np.repeat(np.cumsum(lens), count) - first)
    order = np.argsort(-size, kind="stable")  # short windows together: their matrices end early
    for lo in range(0, len(order), lanes):
        part = order[lo : lo + lanes]
        steps = int(size[part].max())
        at = first[part][None, :] + np.arange(steps)[:, None]
        real = np.arange(steps)[:, None] < size[part][None, :]
        windows = np.where(real, buf[np.minimum(at, len(buf) - 1)], PAD).astype(np.int64)
        p = position_logits(net, windows)  # states lie in (-1, 1), so logits are small
        np.exp(p, out=p)
        p *= (real / p.sum(1))[:, None]
        sums = p.sum(0)
        for j in range(k):
            out[:, j] += np.bincount(owner[part], sums[j], len(rows))
        places += np.bincount(owner[part], size[part], len(rows))
    return out / np.maximum(places, 1)[:, None]


def sample(docs: DataFrame, training: Column, most: int = ROWS_PER_LANGUAGE) -> list[tuple[bytes, str]]:
    """Training windows: at most ``most`` documents of each language, those with the smallest hashes of doc_id.

    Estimates of each language's different ids give a limit of the hash below which some four times as
    many lie, so only these are told apart and brought to the driver, at every size. A doc_id counts
    once a language.
    """
    rows = docs.select("doc_id", "text", "lang").where(training & F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.approx_count_distinct("doc_id").alias("n")).collect()}  # one row a language
    if not counts:
        return []
    spark, kind = docs.sparkSession, dict(docs.dtypes)["doc_id"]
    limits = spark.createDataFrame([(lang, min(1.0, 4 * most / max(n, 1))) for lang, n in sorted(counts.items())], "lang string, share double")
    place = F.xxhash64("doc_id")
    low = rows.select("doc_id", "lang").join(F.broadcast(limits), "lang").where(place <= (F.col("share") - 0.5) * F.lit(2.0**64))
    by: dict[str, list[tuple[int, int]]] = {lang: [] for lang in counts}
    for r in low.groupBy("lang", "doc_id").agg(F.first(place).alias("place")).collect():
        by[r["lang"]].append((r["place"], r["doc_id"]))
    taken = [(doc_id, lang) for lang, ids in sorted(by.items()) for _, doc_id in sorted(ids)[:most]]
    if not taken:
        return []
    chosen = spark.createDataFrame(taken, f"doc_id {kind}, lang string")
    size = 4 * TRAIN_WINDOW
    parts = [F.substring("text", F.pmod(F.xxhash64("doc_id", F.lit(i)), F.greatest(F.length("text") - size + 1, F.lit(1))).cast("int") + 1, F.lit(size)) for i in range(WINDOWS_PER_ROW)]
    found = rows.join(F.broadcast(chosen), ["doc_id", "lang"]).groupBy("doc_id", "lang").agg(F.min(F.array(*parts)).alias("parts"))
    return [(part.encode(), r["lang"]) for r in found.collect() for part in r["parts"]]


def predict(docs: DataFrame, net: Network | None) -> DataFrame:
    """doc_id, lang_pred, score and the probability of each language (a map), for every row."""
    spark = docs.sparkSession
    small_batches(spark)
    model = spark.sparkContext.broadcast(net)  # some 30 kB, whatever the input

    def run(batches):
        net = model.value
        for batch in filled(batches):
            rows, labels, scores = text_bytes(batch), [], []
            for lo, hi in by_bytes(rows, 2_000_000):
                part = rows[lo:hi]
                lettered = [net is not None and LETTER.search(x.decode("utf-8", "replace")) is not None for x in part]
                if net is None:
                    labels += ["und"] * len(part)
                    scores += [0.0] * len(part)
                    continue
                p = document_probabilities(net, part)
                best = p.argmax(1)
                labels += [net.languages[b] if ok else "und" for b, ok in zip(best.tolist(), lettered, strict=True)]
                scores += [min(1.0, float(p[i, b])) if ok else 0.0 for i, (b, ok) in enumerate(zip(best.tolist(), lettered, strict=True))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(labels, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, lang_pred string, score double")


def identify(docs: DataFrame, training: Column) -> DataFrame:
    """Trains on the rows of ``docs`` that ``training`` holds for and labels every row."""
    return predict(docs, train(sample(docs, training)))


def accepted(docs: DataFrame, net: Network | None, reject: float = REJECT) -> DataFrame:
    """The rows of ``docs`` that have a language; those labelled ``und`` go, and those where no language
    reaches ``reject`` times the share of a chance label. All columns as they came."""
    spark = docs.sparkSession
    small_batches(spark)
    model = spark.sparkContext.broadcast(net)

    def run(batches):
        for batch in filled(batches):
            rows, keep = text_bytes(batch), []
            for lo, hi in by_bytes(rows, 2_000_000):
                some = [model.value is not None and LETTER.search(x.decode("utf-8", "replace")) is not None for x in rows[lo:hi]]
                if any(some):
                    sure = document_probabilities(model.value, rows[lo:hi]).max(1) >= min(0.95, reject / len(model.value.languages))
                    some = (sure & np.array(some)).tolist()
                keep.extend(some)
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(keep, pa.bool_())) for c in batch.columns], schema=batch.schema)

    return docs.mapInArrow(run, docs.schema)
