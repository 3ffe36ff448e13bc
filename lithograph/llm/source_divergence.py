"""Source divergence audit: how far the sources of a language lie apart, and by which terms (operator 11).

1. Tasks count occurrences and documents of each (lang, source, term), combined over their texts; one
   aggregation sums them. A row without term marks that a group occurs, so groups without terms stay.
2. Terms in at least ``LEAST`` documents of their language are pivoted into wide vectors: one row a
   (lang, term) with an array of counts, one place for each source of the language in order.
3. Higher-order functions turn counts into smoothed shares, exact integers, and emit what a term adds to
   each pair of sources; the sums over terms are combined before the shuffle, so what travels is a row a
   pair and task. The largest terms of a group go through a group limit before its window.

Arrays are as long as a language has sources, never as long as it has terms or documents. The table of
groups (their sources and sums) is broadcast up to ``GROUPS`` rows, else joined by sort and merge; as the
result has a row for each pair of sources of a language, it is about the square root of that.

Shares of up to 10^38 / 10^9 occurrences are exact: the arithmetic is by decimals.

Defined cases: null text, lang and source count as ''; repeated rows count as documents of their own;
an empty table gives an empty result; doc_id and other columns are not read; terms of any length are
kept whole, and long texts are read in blocks that end between terms.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lithograph.llm.common import filled, shared_dir, small_batches, text_bytes, written

#: Documents of a language that a term needs, terms of a group that are listed, the smoothing count and the scale of a share.
LEAST, TOP, PRIOR, SCALE = 30, 50, 5, 1_000_000_000
#: Groups up to which their table is broadcast; terms that a task holds; bytes of a text read at once.
GROUPS, HELD, BLOCK = 100_000, 300_000, 4_000_000
#: Bytes of terms: letters, A-Z lowered, and everything beyond ASCII; other bytes part terms.
TERM_BYTES = bytes(b if b >= 128 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


def term_blocks(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text, block by block."""
    text = text.translate(TERM_BYTES)
    at = 0
    while at < len(text):
        end = len(text) if len(text) - at <= BLOCK else text.find(b" ", at + BLOCK)
        end = len(text) if end < 0 else end
        yield text[at:end].split()
        at = end


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n, docs: occurrences and documents of every term; a row with null term for each group."""
    rows = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: dict[tuple, Counter] = defaultdict(Counter)
        docs: dict[tuple, Counter] = defaultdict(Counter)
        held = 0

        def out() -> Iterator[pa.RecordBatch]:
            for (lang, source), counts in n.items():
                own = docs[lang, source]
                columns = [[lang] * len(counts), [source] * len(counts), list(counts), list(counts.values()), [own[t] for t in counts]]
                kinds = [pa.string(), pa.string(), pa.binary(), pa.int64(), pa.int64()]
                arrays = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
                arrays[2] = arrays[2].cast(pa.string())
                yield pa.RecordBatch.from_arrays(arrays, ["lang", "source", "term", "n", "docs"])

        for batch in filled(batches):
            for lang, source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), text_bytes(batch), strict=True):
                counts, seen = n[lang, source], Counter()
                before = len(counts)
                counts[None] = 0
                for terms in term_blocks(text):
                    seen.update(terms)
                counts.update(seen)
                docs[lang, source].update(seen.keys())
                held += len(counts) - before
                if held > HELD:
                    yield from out()
                    n.clear(), docs.clear()
                    held = 0
        yield from out()

    counted = rows.mapInArrow(run, "lang string, source string, term string, n long, docs long")
    return counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(SCALE * (count + PRIOR) / (total + PRIOR * terms)), exact."""
    whole = lambda c: c.cast("decimal(20,0)")
    quotient = F.call_function("div", (whole(count + PRIOR) * F.lit(SCALE).cast("decimal(11,0)")), whole(total + PRIOR * terms))
    return F.lit(1) + quotient


def wide_terms(counts: DataFrame, sources: DataFrame, least: int) -> DataFrame:
    """lang, term, total, counts: a row for each kept term, with its count in every source of its language."""
    kept = counts.where("term is not null").groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("total"), F.map_from_entries(F.collect_list(F.struct("source", "n"))).alias("by_source"))
    rows = kept.where(F.col("docs") >= least).join(sources, "lang")
    return rows.select("lang", "term", "total", F.transform("sources", lambda s: F.coalesce(F.try_element_at("by_source", s), F.lit(0))).alias("counts"))


def audit(docs: DataFrame, least: int = LEAST, top: int = TOP, groups_most: int = GROUPS) -> DataFrame:
    """lang, source, part, item, value, rank: distances between sources (pair) and the terms a source favours (term)."""
    small_batches(docs.sparkSession)
    folder = shared_dir(docs.sparkSession)
    counts = written(term_counts(docs), f"{folder}/counts")
    groups = counts.where("term is null").select("lang", "source")
    n_groups = groups.count()
    sized = F.broadcast if n_groups <= groups_most else lambda df: df.hint("merge")
    sources = groups.groupBy("lang").agg(F.sort_array(F.collect_list("source")).alias("sources"))
    wide = written(wide_terms(counts, sized(sources), least), f"{folder}/wide")

    # sums over the kept terms: of each source, of the language, and how many terms there are
    sums = wide.select("lang", F.posexplode("counts").alias("place", "n")).groupBy("lang", "place").agg(F.sum("n").alias("n"), F.count("*").alias("terms"))
    totals = sums.groupBy("lang").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "n"))), lambda x: x["n"]).alias("ns"), F.sum("n").alias("n"), F.max("terms").alias("terms"))
    totals = written(totals.join(sources.hint("merge"), "lang"), f"{folder}/totals")
    own = F.zip_with("counts", "ns", lambda c, n: share(c, n, F.col("terms")))
    shares = wide.join(sized(totals), "lang").select("lang", "term", "sources", "counts", own.alias("p"), share(F.col("total"), F.col("n"), F.col("terms")).alias("q"))

    # a row of each source, then one of each later source: no array is longer than a language has sources
    first = shares.select("lang", "p", F.posexplode("p").alias("a", "pa"))
    later = F.when(F.col("a") + 1 < F.size("p"), F.sequence(F.col("a") + 1, F.size("p") - 1))
    both = first.select("lang", "a", F.explode(F.transform(later, lambda b: F.struct(b.alias("b"), F.abs(F.col("pa") - F.get("p", b)).alias("f")))).alias("x"))
    far = both.groupBy("lang", "a", F.col("x.b").alias("b")).agg(F.sum("x.f").alias("value"))
    pairs = sources.select("lang", "sources", F.posexplode("sources").alias("i", "source")).select("lang", "source", "i", F.posexplode("sources").alias("j", "item")).where("i <> j")
    pairs = pairs.withColumns({"a": F.least("i", "j"), "b": F.greatest("i", "j")}).join(far.hint("merge"), ["lang", "a", "b"], "left")
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0)).cast("long").alias("value"))

    place = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    favoured = F.filter(F.arrays_zip("sources", "counts", "p"), lambda x: (x["counts"] > 0) & (x["p"] > F.col("q")))
    terms = shares.select("lang", "q", F.col("term").alias("item"), F.explode(favoured).alias("x"))
    terms = terms.select("lang", F.col("x.sources").alias("source"), F.lit("term").alias("part"), "item", (F.col("x.p") - F.col("q")).cast("long").alias("value"))
    terms = terms.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= top)
    return pairs.withColumn("rank", F.row_number().over(place)).unionByName(terms)


#: The audit in SQL; the letters of terms are lowered one by one, as lower() would change others too.
ORACLE = r"""
WITH docs AS (SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
found AS (SELECT row, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs),
kept AS (SELECT lang, term FROM found GROUP BY lang, term HAVING count(DISTINCT row) >= 30),
v AS (SELECT lang, count(*)::HUGEINT AS v FROM kept GROUP BY lang),
groups AS (SELECT DISTINCT lang, source FROM docs),
n AS (SELECT lang, source, term, count(*)::HUGEINT AS n FROM found JOIN kept USING (lang, term) GROUP BY lang, source, term),
dense AS (SELECT g.lang, g.source, k.term, coalesce(n.n, 0)::HUGEINT AS n FROM groups g JOIN kept k USING (lang) LEFT JOIN n ON n.lang = g.lang AND n.source = g.source AND n.term = k.term),
p AS (SELECT d.lang, source, term, n, 1 + (1000000000::HUGEINT * (n + 5)) // (sum(n) OVER (PARTITION BY d.lang, source) + 5 * v)::HUGEINT AS p FROM dense d JOIN v USING (lang)),
whole AS (SELECT lang, term, sum(n)::HUGEINT AS n FROM dense GROUP BY lang, term),
q AS (SELECT w.lang, term, 1 + (1000000000::HUGEINT * (n + 5)) // (sum(n) OVER (PARTITION BY w.lang) + 5 * v)::HUGEINT AS q FROM whole w JOIN v USING (lang)),
far AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS f FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f, 0)::BIGINT AS value FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN far ON far.lang = a.lang AND far.source = a.source AND far.item = b.source),
terms AS (SELECT p.lang, p.source, 'term' AS part, term AS item, (p - q)::BIGINT AS value FROM p JOIN q USING (lang, term) WHERE p.n > 0 AND p > q)
SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms)
QUALIFY part = 'pair' OR rank <= 50
"""
