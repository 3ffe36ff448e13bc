"""The manifest of the chunk store: its roots, and what verify says of lost and repeated recipes."""

import collections

import pytest

from lithograph.llm import bpe, chunk_store
from lithograph.llm.common import shared_dir

pytest.importorskip("tokenizers")
VOCABULARY = bpe.default_vocabulary()


def test_chunk_store_notices_lost_and_repeated_recipes(spark):
    assert all(tree_root(x) == chunk_store.merkle(x) for x in ([bytes([i]) * 32 for i in range(n)] for n in range(40)))
    odd = spark.createDataFrame([(i, f"text {i % 9} " * (i + 1)) for i in range(12)] + [(4, "again"), (4, "again")], "doc_id long, text string")
    path = shared_dir(spark)
    chunk_store.write_store(odd, path, VOCABULARY, 2)
    rows = chunk_store._recipes(spark, path).collect()
    schema = "doc_id long, n_tokens long, root binary, chunks array<binary>, part int"
    by_part = collections.defaultdict(list)
    for r in rows:
        by_part[r["part"]].append(r)
    for m in spark.read.parquet(f"{path}/manifest").collect():
        own = sorted(by_part[m["part"]], key=lambda r: (r["doc_id"], bytes(r["root"])))
        assert m["documents"] == len(own) and bytes(m["root"]) == chunk_store.merkle([chunk_store.leaf(r["doc_id"], bytes(r["root"])) for r in own])
    assert all(r["whole"] for r in chunk_store.verify(spark, path).collect())
    for changed in (rows[1:], rows[:-1], [*rows, rows[0]]):
        spark.createDataFrame(changed, schema).write.mode("overwrite").parquet(f"{path}/recipes")
        assert not any(r["whole"] for r in chunk_store.verify(spark, path).collect())


def tree_root(leaves):
    tree = chunk_store.Tree()
    for x in leaves:
        tree.add(x)
    return tree.root()
