"""Boolean text search over a positional index: phrases, OR and negation, ranked by how densely the words cover a text.

The index has a row (term, id, position) for every word. It is written once, sorted by term and dealt by
ranges of (term, id), so a search reads only the row groups of its terms and a frequent term spreads over
many files. A phrase is found by arithmetic: its j-th word at position p votes for a start at p - j, and a
start with a vote of every word is an occurrence; one aggregation, which combines before the shuffle.

A search is words and "quoted phrases", all of which must occur; ``-`` before one forbids it; ``or``
between two parts that hold such lists is enough of either. Rank: for each part that holds, the sum
over its covers (the shortest stretches with an occurrence of all it asks for) of 0.1 / (1 + other words).
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lithograph.functions.scalars import TERM, terms

COVER = 0.1
PART = re.compile(r'(-?)(?:"([^"]*)"?|([^\s"]+))')


@dataclass(frozen=True)
class Literal:
    """Words that stand next to each other, asked for or forbidden."""

    words: tuple[str, ...]
    negated: bool = False


def parsed(search: str) -> list[list[Literal]]:
    """The alternatives of a search, each a list of literals. Parts without any word are left out."""
    out: list[list[Literal]] = [[]]
    for minus, quoted, plain in PART.findall(search):
        if plain.lower() == "or" and not minus:
            out.append([])
        elif words := tuple(re.findall(TERM.replace("A-Z", ""), (quoted or plain).lower())):
            out[-1].append(Literal(words, bool(minus)))
    return [x for x in out if x]


def positions(texts: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """term, id, position of every word, from 0."""
    return texts.select(F.col(id_col).alias("id"), F.posexplode(terms(F.col(text_col))).alias("position", "term")).select("term", "id", "position")


def write_index(texts: DataFrame, id_col: str, text_col: str, path: str) -> None:
    """Stores the positional index of a table."""
    positions(texts, id_col, text_col).repartitionByRange("term", "id").sortWithinPartitions("term", "id", "position").write.parquet(path)


def occurrences(index: DataFrame, literals: list[Literal]) -> DataFrame:
    """lit, id, start, end: where each literal, by its number, occurs."""
    spark = index.sparkSession
    asked = [(n, j, w, len(x.words)) for n, x in enumerate(literals) for j, w in enumerate(x.words)]
    words = spark.createDataFrame(asked, "lit int, j int, term string, k int")  # as long as the search
    rows = index.where(F.col("term").isin(sorted({w for _, _, w, _ in asked}))).join(F.broadcast(words), "term")
    found = rows.groupBy("lit", "id", (F.col("position") - F.col("j")).alias("start"), "k").agg(F.count("*").alias("n")).where("n = k")
    return found.select("lit", "id", "start", (F.col("start") + F.col("k") - 1).alias("end"))


def _covers(found: DataFrame, numbers: list[int], words: int) -> DataFrame:
    """id, rank: the covers of one alternative's literals."""
    near = Window.partitionBy("id").orderBy("end")  # all that ends here or before
    last = [F.max(F.when(F.col("lit") == n, F.col("start"))).over(near).alias(f"last{n}") for n in numbers]
    rows = found.where(F.col("lit").isin(numbers)).select("id", "end", *last)
    whole = F.lit(True)
    for n in numbers:
        whole = whole & F.col(f"last{n}").isNotNull()
    begin = F.least(*[f"last{n}" for n in numbers]) if len(numbers) > 1 else F.col(f"last{numbers[0]}")
    covers = rows.where(whole).groupBy("id", begin.alias("begin")).agg(F.min("end").alias("end"))
    other = F.greatest(F.col("end") - F.col("begin") + 1 - words, F.lit(0))
    return covers.groupBy("id").agg(F.sum(COVER / (1 + other)).alias("rank"))


def search(index: DataFrame, query: str, every: DataFrame | None = None) -> DataFrame:
    """id, rank of the texts that a search finds.

    ``every``(id) is needed where an alternative only forbids: such texts may have no word of the index.
    """
    alternatives = parsed(query)
    literals = list(dict.fromkeys(Literal(x.words) for part in alternatives for x in part))
    number = {x.words: n for n, x in enumerate(literals)}
    found = occurrences(index, literals)
    out = None
    for part in alternatives:
        must = sorted({number[x.words] for x in part if not x.negated})
        never = sorted({number[x.words] for x in part if x.negated})
        if must:
            hits = _covers(found, must, sum(len(literals[n].words) for n in must))
        elif every is not None:
            hits = every.select("id", F.lit(0.0).alias("rank")).distinct()
        else:
            raise ValueError(f"{query!r} has an alternative that only forbids: pass the ids of all texts")
        if never:
            hits = hits.join(found.where(F.col("lit").isin(never)).select("id"), "id", "left_anti")
        out = hits if out is None else out.unionByName(hits)
    if out is None:
        return index.select("id").limit(0).withColumn("rank", F.lit(0.0))
    return out.groupBy("id").agg(F.round(F.sum("rank"), 6).alias("rank"))


def stored_search(spark: SparkSession, path: str, query: str) -> DataFrame:
    """A search of a stored index."""
    return search(spark.read.parquet(path), query)
