"""Quality rules: base counts and a hashed n-gram likelihood ratio (operator 5).

The base part counts words, symbols, repeated lines and repeated three-word windows of each text. The
method compares two multinomials over hashed n-grams of ``GRAM`` bytes: one of a trusted target, one of
the raw corpus. A document's score is the sum of log(target / raw) over its n-grams divided by their
number, and it is kept if the score reaches ``THRESHOLD``: the same document always gets the same
verdict for the same tables.

Both multinomials count every row of their tables, whole texts. Each task adds its batches up in
vectors of ``BUCKETS`` counts and hands on the buckets it has seen; the sums are ``BUCKETS`` rows
whatever the input, so the table of weights that is broadcast has a fixed size.

Defined cases: null and empty texts have zero counts and fail the base rules; a text shorter than an
n-gram scores 0; an empty target leaves the ratio at zero for all n-grams, so the base rules decide.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lithograph.llm.common import by_bytes, filled, lengths, seg_sum, small_batches, text_bytes, word_ids

GRAM, BUCKETS, SMOOTHING, THRESHOLD = 4, 1 << 16, 1.0, -0.25
#: Fixed values of the base rules.
LEAST_WORDS, REPEAT_PERCENT = 50, 50
SYMBOLS = b"#*$%&|<>"
WHITE = b"\x20\x09\x0a\x0b\x0c\x0d"

IS_SYMBOL = np.isin(np.arange(256), list(SYMBOLS)).astype(np.uint8)
IS_WHITE = np.isin(np.arange(256), list(WHITE))
#: Bytes that begin a code point which is not white.
IS_CHAR = (~IS_WHITE & ((np.arange(256) < 0x80) | (np.arange(256) >= 0xC0))).astype(np.uint8)


def _joined(rows: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    buf = np.frombuffer(b"".join(rows), np.uint8)
    ends = np.cumsum(lengths(rows))
    return buf, np.concatenate([[0], ends[:-1]]).astype(np.int64), ends


def _pairs(a: np.ndarray, b: np.ndarray, many: int) -> np.ndarray:
    """One integer for each pair (a, b), b < many, equal exactly where the pairs are."""
    if len(a) and int(a.max()) >= (1 << 62) // max(1, many):
        a = np.unique(a, return_inverse=True)[1]
    return a * many + b


def base_counts(rows: list[bytes]) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of each text."""
    buf, starts, ends = _joined(rows)
    words = [r.split() for r in rows]
    ids, owner, number = word_ids(words)
    n_words = np.fromiter(map(len, words), np.int64, len(rows))
    repeat = np.zeros(len(ids), bool)
    if len(ids) >= 3:
        inside = owner[2:] == owner[:-2]
        at = np.flatnonzero(inside)
        key = _pairs(_pairs(_pairs(owner[at], ids[at], len(number)), ids[at + 1], len(number)), ids[at + 2], len(number))
        order = np.argsort(key, kind="stable")
        same = key[order][1:] == key[order][:-1]
        again = np.zeros(len(at), bool)
        again[order[1:][same]] = True
        again[order[:-1][same]] = True
        for k in range(3):
            repeat[at[again] + k] = True
    dup = np.zeros(len(rows), np.int64)
    for i, r in enumerate(rows):
        if b"\n" in r:
            lines = [x for x in r.split(b"\n") if x.strip(WHITE)]
            dup[i] = len(lines) - len(set(lines))
    return {
        "n_words": n_words,
        "word_chars": seg_sum(IS_CHAR[buf], starts, ends),
        "n_symbols": seg_sum(IS_SYMBOL[buf], starts, ends),
        "n_dup_lines": dup,
        "n_repeat_words": np.bincount(owner[repeat], minlength=len(rows)),
    }


def gram_buckets(buf: np.ndarray) -> np.ndarray:
    """The bucket of the n-gram that begins at each byte but the last ones."""
    if len(buf) < GRAM:
        return np.empty(0, np.uint32)
    x = np.zeros(len(buf) - GRAM + 1, np.uint32)
    for k in range(GRAM):
        x |= buf[k : len(buf) - GRAM + 1 + k].astype(np.uint32) << np.uint32(8 * k)
    x *= np.uint32(0x9E3779B1)
    return x >> np.uint32(32 - (BUCKETS - 1).bit_length())


def _own(starts: np.ndarray, ends: np.ndarray, n: int) -> np.ndarray:
    """Which of ``n`` n-gram positions lie within one text."""
    ok = np.ones(n, bool)
    for k in range(1, GRAM):
        at = ends[:-1] - k
        ok[at[(at >= 0) & (at < n)]] = False
    return ok


def gram_counts(docs: DataFrame) -> DataFrame:
    """bucket, n: how often the n-grams of a bucket occur in all texts."""
    small_batches(docs.sparkSession)

    def run(batches):
        total = np.zeros(BUCKETS, np.int64)
        for batch in filled(batches):
            rows = text_bytes(batch)
            for lo, hi in by_bytes(rows):
                buf, starts, ends = _joined(rows[lo:hi])
                grams = gram_buckets(buf)
                total += np.bincount(grams[_own(starts, ends, len(grams))], minlength=BUCKETS)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(total[seen], pa.int64())], ["bucket", "n"])

    return docs.select("text").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def log_ratios(target: DataFrame, raw: DataFrame) -> np.ndarray:
    """Weight of each bucket: log of its smoothed share in the target over its share in the raw corpus."""
    shares = []
    for df in (target, raw):
        counts = np.zeros(BUCKETS)
        for r in gram_counts(df).collect():  # BUCKETS rows at most
            counts[r["bucket"]] = r["n"]
        shares.append((counts + SMOOTHING) / (counts.sum() + SMOOTHING * BUCKETS) if counts.any() else None)
    if shares[0] is None or shares[1] is None:
        return np.zeros(BUCKETS, np.float32)
    return np.log(shares[0] / shares[1]).astype(np.float32)


def scores(rows: list[bytes], weights: np.ndarray) -> np.ndarray:
    """Length-normalised log-likelihood ratio of each text."""
    buf, starts, ends = _joined(rows)
    grams = gram_buckets(buf)
    n = np.maximum(ends - starts - GRAM + 1, 0)
    if not len(grams):
        return np.zeros(len(rows))
    starts = np.minimum(starts, len(grams))
    return seg_sum(weights[grams], starts, np.minimum(starts + n, len(grams))) / np.maximum(n, 1)


def judge(docs: DataFrame, weights: np.ndarray, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, the base counts, base_failed, score, kept of every row."""
    spark = docs.sparkSession
    small_batches(spark)
    model = spark.sparkContext.broadcast(weights)
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

    def run(batches):
        for batch in filled(batches):
            rows, parts = text_bytes(batch), []
            for lo, hi in by_bytes(rows, 1_500_000):
                c = base_counts(rows[lo:hi])
                parts.append([*[c[n] for n in names], scores(rows[lo:hi], model.value)])
            cols = [np.concatenate(x) for x in zip(*parts, strict=True)]
            failed = (cols[0] < LEAST_WORDS) | (100 * cols[4] > REPEAT_PERCENT * cols[0])
            kept = ~failed & (cols[5] >= threshold)
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, pa.int64()) for c in cols[:5]], pa.array(failed), pa.array(cols[5], pa.float64()), pa.array(kept)], ["doc_id", *names, "base_failed", "score", "kept"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, score double, kept boolean")


def rules(docs: DataFrame, trusted: DataFrame) -> DataFrame:
    """Judges ``docs`` against a trusted target of texts; both are counted whole."""
    return judge(docs, log_ratios(trusted, docs))
