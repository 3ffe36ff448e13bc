"""Operator 5's verdict and operator 8's odd rows, written out in plain Python."""

import collections
import math
import re

import pytest
from pyspark.sql import functions as F

from lithograph.llm import chunk_store, decontaminate, queries, quality_rules, url_filter
from lithograph.llm.common import shared_dir


def bucket(gram: bytes) -> int:
    """The multiplicative hash of a gram's bytes as a little-endian number, by its highest bits."""
    bits = (quality_rules.BUCKETS - 1).bit_length()
    return (int.from_bytes(gram, "little") * 0x9E3779B1 % (1 << 32)) >> (32 - bits)


def grams(text) -> list[int]:
    b = (text or "").encode()
    return [bucket(b[i : i + quality_rules.GRAM]) for i in range(len(b) - quality_rules.GRAM + 1)]


def brute_verdicts(texts, trusted):
    """score and kept of each text: the mean log ratio of its grams' smoothed shares in both corpora."""
    good, raw = collections.Counter(g for t in trusted for g in grams(t)), collections.Counter(g for t in texts for g in grams(t))
    share = lambda c, g: (c[g] + quality_rules.SMOOTHING) / (sum(c.values()) + quality_rules.SMOOTHING * quality_rules.BUCKETS)
    ratio = {g: math.log(share(good, g) / share(raw, g)) if good and raw else 0.0 for g in raw}
    out = []
    for t in texts:
        own, ws = grams(t), re.findall(r"[^\x20\x09-\x0D]+", t or "")
        score = sum(ratio[g] for g in own) / max(len(own), 1)
        windows = collections.Counter(zip(ws, ws[1:], ws[2:], strict=False))
        repeated = {k + j for k, w in enumerate(zip(ws, ws[1:], ws[2:], strict=False)) if windows[w] > 1 for j in range(3)}
        failed = len(ws) < 50 or 100 * len(repeated) > 50 * len(ws)
        out.append((failed, score, not failed and score >= quality_rules.THRESHOLD))
    return out


def test_verdicts_equal_plain_python(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    good = {r["doc_id"] for r in spark.read.parquet(f"{sf}/labels.parquet").where("quality = 1").collect()}
    rows = sorted((r["doc_id"], r["text"]) for r in docs.collect())
    want = dict(zip([i for i, _ in rows], brute_verdicts([t for _, t in rows], [t for i, t in rows if i in good]), strict=True))
    got = queries.op5_quality_rules(spark, sf).collect()
    assert len(got) == len(rows)
    for r in got:
        failed, score, kept = want[r["doc_id"]]
        assert r["base_failed"] == failed and r["score"] == pytest.approx(score, abs=1e-5)
        assert r["kept"] == kept or abs(score - quality_rules.THRESHOLD) < 1e-5
    assert len({r["kept"] for r in got}) == 2


def test_verdicts_of_odd_rows(spark):
    texts = [None, "", "abc", "é" * 9, "word " * 60, " ".join(f"w{i}" for i in range(70)), " ".join(f"w{i}" for i in range(70))]
    docs = spark.createDataFrame([(i % 6, t, 2.0, True) for i, t in enumerate(texts)], "doc_id long, text string, score double, kept boolean")
    got = sorted((r["base_failed"], r["score"], r["kept"]) for r in quality_rules.rules(docs, docs.where("doc_id = 5")).collect())
    want = sorted(brute_verdicts(texts, [texts[5]]))
    assert [(f, k) for f, _, k in got] == [(f, k) for f, _, k in want] and [s for _, s, _ in got] == pytest.approx([s for _, s, _ in want], abs=1e-4)


def test_urls_of_odd_rows(spark):
    rows = [(None, "http://a.net/de/1"), (1, "http://a.net/de/1"), (1, "http://a.net/de/1"), (2, None), (2, ""), (3, "HTTP://Example.ORG/es/#x")]
    pages = spark.createDataFrame([(*r, "h", "p", "v") for r in rows], "page_id long, url string, host string, path string, verdict string")
    got = collections.Counter((r["page_id"], r["rule"], r["verdict"]) for r in url_filter.judge(pages, url_filter.RULES).collect())
    assert got == {(None, "net/de/", "block"): 1, (1, "net/de/", "block"): 2, (2, None, "allow"): 2, (3, "org/es/", "block"): 1}


def test_one_chunk_in_all_documents(spark):
    """A text that all share is stored once, and every document's ids come back whole."""
    from lithograph.llm import bpe

    shared = " ".join(f"boilerplate{i % 97} line {i}" for i in range(3000))
    docs = spark.createDataFrame([(i, shared) for i in range(60)] + [(100, shared + " and more"), (101, "")], "doc_id long, text string")
    path = shared_dir(spark)
    chunk_store.write_store(docs, path, bpe.default_vocabulary(), 2)
    got = chunk_store.verify(spark, path).collect()
    assert len(got) == 62 and all(r["whole"] for r in got)
    assert len({(r["n_tokens"], r["ids_crc32"]) for r in got}) == 3


def test_items_without_id_are_no_items(spark):
    items = spark.createDataFrame([(None, "one two three four five six seven"), (1, "a b c d e f g")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "one two three four five six seven"), (2, "x a b c d e f g y")], "doc_id long, text string")
    assert {r["doc_id"] for r in decontaminate.contaminated(docs, items).select(F.col("doc_id")).collect()} == {2}


def test_rules_are_the_contracts():
    """The list of operator 8's contract, word by word, and a URL under each rule of net."""
    want = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block")]
    assert url_filter.RULES == want
    root = url_filter.build(url_filter.RULES)
    assert url_filter.longest(root, "a.net", "/de/1") == ("net", "/de/", "allow")
    assert url_filter.longest(root, "a.example.net", "/de/81") == ("example.net", "/de/8", "block")
