"""Token counts by distinct pre-tokens, without the ids of any document (operator 13).

A byte-level vocabulary cuts a text into pre-tokens and encodes each for itself, so a document's count
is the sum over its distinct pre-tokens of their frequency times their own count. Four steps:

1. every task counts the pre-tokens of its texts; one aggregation makes a row of each distinct one,
   whose tokens the library's model counts once;
2. the most frequent of them, ``HEAD`` at most by a histogram of their occurrences, are broadcast; their
   keys have at most ``KEY_BYTES`` bytes (longer ones go by a digest), which bounds the table whatever the
   corpus. No other one can make more than a ``HEAD``-th of all occurrences, so a shuffle has no hot key;
3. the frequencies of each document meet the broadcast table where they are counted; what it lacks is a
   row each and joins the other pre-tokens by sort and merge;
4. one sum a document.

Frequencies carry (doc_id, hash and length of the text), never the text; special tokens that a text
spells out are one token each, as in the library.

Defined cases: a null text is the empty one (0 bytes, 0 tokens); every input row gives one output row,
repeated rows and null ids included; a text of any length is read in blocks that end where a pre-token
ends; an empty table gives an empty one; other columns are not read.
"""

from __future__ import annotations

import functools
import hashlib
import json
import math
import operator
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lithograph.llm.bpe import byte_symbols
from lithograph.llm.common import by_bytes, filled, shared_dir, small_batches, text_bytes, written

#: The broadcast pre-tokens are at most so many, their keys at most so long; characters read at once; pre-tokens that a task holds.
HEAD, KEY_BYTES, BLOCK, HELD = 1 << 18, 64, 1 << 20, 500_000
#: Pattern of byte-level pre-tokens: a fixed value.
PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: Outside these blocks engines of different Unicode versions may disagree on letters; such texts are cut by the library itself.
SETTLED = [(0x0, 0x52F), (0x2000, 0x206F), (0x20A0, 0x20BF), (0x3000, 0x9FFF), (0xAC00, 0xD7A3), (0x1F300, 0x1F64F)]
UNSETTLED = re.compile("[^" + "".join(f"{re.escape(chr(a))}-{re.escape(chr(b))}" for a, b in SETTLED) + "]")
#: No pre-token goes on from a character to white space behind it.
BREAK = regex.compile(r"(?<=\S)\s")


def default_vocabulary() -> str:
    """Path of the public vocabulary file that the query uses."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Pieces:
    """The pre-tokens of texts, and the tokens of a pre-token, by a byte-level vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre, added = spec["pre_tokenizer"], spec.get("added_tokens", [])
        if spec.get("normalizer") or pre["type"] != "ByteLevel" or not pre.get("use_regex", True) or pre["add_prefix_space"] or any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in added):
            raise ValueError(f"{path}: supported are byte-level vocabularies without normaliser, prefix and bounds of special tokens")
        self.path = path
        special = sorted((t["content"] for t in added), key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, special))) if special else None
        self.symbols = dict(enumerate(byte_symbols()))

    @functools.cached_property
    def library(self):
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def parts(self, text: str) -> Iterator[str]:
        """Blocks of a text between special tokens, each ending with a pre-token."""
        for part in self.special.split(text) if self.special else [text]:
            at = 0
            while len(part) - at > BLOCK and (m := BREAK.search(part, at + BLOCK)):
                yield part[at : m.start()]
                at = m.start()
            yield part[at:]

    def counts(self, text: str) -> Counter:
        """Frequency of each pre-token."""
        out: Counter = Counter()
        for part in self.parts(text):
            if part.isascii() or not UNSETTLED.search(part):
                out.update(PIECES.findall(part) if len(part) < BLOCK // 8 else map(operator.itemgetter(0), PIECES.finditer(part)))
            else:
                out.update(part[a:b] for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(part))
        return out

    def n_special(self, text: str) -> int:
        return sum(1 for _ in self.special.finditer(text)) if self.special else 0

    def n_tokens(self, piece: bytes) -> int:
        """Tokens of one pre-token, given as UTF-8."""
        return len(self.library.model.tokenize(piece.decode("latin-1").translate(self.symbols)))


@functools.lru_cache(maxsize=2)
def pieces_of(path: str) -> Pieces:
    """A worker reads a vocabulary once."""
    return Pieces(path)


def _pieces(docs: DataFrame, vocabulary: str) -> DataFrame:
    """piece, n: what each task has counted, combined over its texts."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool, held = pieces_of(vocabulary), Counter()

        def rows():
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["piece", "n"])

        for batch in filled(batches):
            for text in text_bytes(batch):
                held.update(tool.counts(text.decode("utf-8", "replace")))
                if len(held) > HELD:
                    yield rows()
                    held.clear()
        if held:
            yield rows()

    return docs.select("text").mapInArrow(run, "piece string, n long")


def _key(piece: Column) -> Column:
    """A pre-token, or a digest of one that is longer than KEY_BYTES."""
    return F.when(F.octet_length(piece) <= KEY_BYTES, piece).otherwise(F.concat(F.lit("sha256:"), F.sha2(piece.cast("binary"), 256)))


def short_key(piece: str) -> str:
    """The same in Python."""
    if len(piece) <= KEY_BYTES // 4 or len(raw := piece.encode("utf-8", "replace")) <= KEY_BYTES:
        return piece
    return "sha256:" + hashlib.sha256(raw).hexdigest()


def distinct_pieces(docs: DataFrame, vocabulary: str, path: str) -> DataFrame:
    """key, n, tokens of every distinct pre-token of the corpus: its occurrences and its own tokens; a stored table."""
    found = _pieces(docs, vocabulary).groupBy("piece").agg(F.sum("n").alias("n")).select(_key(F.col("piece")).alias("key"), "piece", "n")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = pieces_of(vocabulary)
        for batch in filled(batches):
            tokens = [tool.n_tokens(p) for p in text_bytes(batch, "piece")]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(tokens, pa.int64())], ["key", "n", "tokens"])

    return written(found.mapInArrow(run, "key string, n long, tokens long"), path)


def frequent(pieces: DataFrame, most: int) -> dict[str, int]:
    """Tokens of the most frequent pre-tokens, ``most`` at most: those above a bound of their number of occurrences."""
    step = F.floor(F.log2("n") * 16)  # some 1,000 steps at most, whatever the corpus
    steps = sorted(((r["step"], r["count"]) for r in pieces.groupBy(step.alias("step")).count().collect()), reverse=True)
    least, held = math.inf, 0
    for at, count in steps:
        held += count
        if held > most:
            break
        least = at
    found = pieces.where(step >= F.lit(float(least))).select("key", "tokens").toArrow()
    return dict(zip(found["key"].to_pylist(), found["tokens"].to_pylist(), strict=True))


def _frequencies(docs: DataFrame, vocabulary: str, known: dict[str, int]) -> DataFrame:
    """doc_id, hash, n_bytes, key, n, copies: the frequencies of a document's pre-tokens that are not ``known``.

    One row more a document has no key: it holds the tokens of its known pre-tokens and special tokens,
    and counts the copy.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", F.xxhash64(text).alias("hash"), F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(known)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool, tokens_of = pieces_of(vocabulary), shared.value.get
        for batch in filled(batches):
            raw, document = text_bytes(batch), batch.select([0, 1, 2])
            for lo, hi in by_bytes(raw, 2_000_000):
                keys, n, sizes = [], [], []
                for text in raw[lo:hi]:
                    text = text.decode("utf-8", "replace")
                    at, total = len(n), tool.n_special(text)
                    keys.append(None)
                    n.append(0)
                    for piece, count in tool.counts(text).items():
                        key = short_key(piece)
                        tokens = tokens_of(key)
                        if tokens is None:
                            keys.append(key)
                            n.append(count)
                        else:
                            total += count * tokens
                    n[at] = total
                    sizes.append(len(n) - at)
                own = document.take(pa.array(np.repeat(np.arange(lo, hi), sizes)))
                copies = [k is None for k in keys]
                yield pa.RecordBatch.from_arrays([*own.columns, pa.array(keys, pa.string()), pa.array(n, pa.int64()), pa.array(copies).cast(pa.int64())], ["doc_id", "hash", "n_bytes", "key", "n", "copies"])

    return rows.mapInArrow(run, f"doc_id {kind}, hash long, n_bytes long, key string, n long, copies long")


def counted(docs: DataFrame, vocabulary: str, limit: int = 1024, head: int = HEAD) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every row; ``head`` bounds the pre-tokens that are broadcast."""
    spark = docs.sparkSession
    small_batches(spark)
    pieces = distinct_pieces(docs, vocabulary, f"{shared_dir(spark)}/pieces")
    rows = _frequencies(docs, vocabulary, frequent(pieces, head))
    # a row without key finds nothing; keys of their own spread such rows (no pre-token has a digit behind another sign)
    spread = F.coalesce("key", F.concat(F.lit("\x00"), F.col("hash").cast("string")))
    rated = rows.withColumn("key", spread).join(pieces.select("key", "tokens").hint("merge"), "key", "left")
    document = ["doc_id", "hash", "n_bytes"]
    whole = rated.groupBy(*document).agg(F.sum(F.col("n") * F.coalesce("tokens", F.lit(1))).alias("n"), F.sum("copies").alias("copies"))
    n_tokens = F.expr("n div copies")
    # repeated rows come back in two steps, so that no array grows with their number alone
    many = whole.select("doc_id", "n_bytes", n_tokens.alias("n_tokens"), "copies", F.explode(F.sequence(F.lit(0), F.expr("(copies - 1) div 4096"))).alias("block"))
    each = many.select("doc_id", "n_bytes", "n_tokens", F.explode(F.sequence(F.lit(1), F.least(F.lit(4096), F.col("copies") - 4096 * F.col("block")))))
    return each.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
