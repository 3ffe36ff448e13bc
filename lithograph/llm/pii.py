"""Personal data by weak supervision, in DataFrame functions alone (operator 7).

Base spans are e-mail addresses, IP addresses, card numbers and phone numbers by fixed patterns. On
top, tokens that might be credentials are candidates: maximal runs of key characters that have a digit
or follow a key word, outside base spans. Labelers vote on each candidate (1 private, -1 not, 0 no vote): patterns of the
token, a gazetteer of key words before it, and its context. Expectation-maximisation over the counts
of vote patterns estimates how reliable each labeler is, without any labels; the resulting
probabilities train a logistic span classifier on features of the span, and the classifier decides.

All rows of the corpus are voted on; what reaches the driver are counts by (votes, features), whose
number is bounded by the number of patterns (3 to the power of labelers times 2 to the power of
features) and not by the input. Positions come from splitting a text at the pattern: the lengths
of pieces and matches add up to code-point offsets. No shuffle but that count.

The patterns match the same spans as their plain forms; look-behinds and possessive quantifiers only
keep the matcher from starting again inside a run, so long texts take linear time and no deep stack.
Candidates are searched in the text with base spans hidden, and folds append to short lists, so the
time of a text grows with its length whatever the number of its spans.

Defined cases: a null or empty text has no spans (empty ``spans``, sha256 of nothing); repeated rows
each get a row; without any candidate nothing is added to the base spans.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ["email", "ip", "card", "phone", "secret"]
PART = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})"
#: Patterns of the base kinds; see the module's text for what was added to the plain forms.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Words that announce a credential: fixed values.
GAZETTEER = "password|passwd|passphrase|pwd|passwort|kennwort|contraseña|clave|mot de passe|token|secret|api[ _-]?key|access[ _-]?key|private[ _-]?key|credential|bearer|auth"
#: A word of the gazetteer, with what a variable's name may add to it, and what separates it from a value.
NAMED = rf"(?:{GAZETTEER})(?:[_-][\w-]{{0,16}}|[0-9]{{1,4}})?\W{{0,6}}"
#: Runs of key characters that have a digit anywhere, or follow a word of the gazetteer, and are no part of a base span.
CANDIDATE = rf"(?<![A-Za-z0-9+/_\ufdd0-])(?=[A-Za-z0-9+/_-]{{8}})(?:(?=[A-Za-z+/_-]*+[0-9])|(?<=(?=[abckmpstABCKMPST])(?i:{NAMED.replace('ñ', '[ñÑ]')})))[A-Za-z0-9+/_-]++(?!\ufdd0)"
CONTEXT = 32
SPAN = "array<struct<start:int,rank:int,stop:int,kind:string>>"
MATCHES = "array<struct<start:int,stop:int,text:string,before:string>>"
#: Numbers that a fold appends to one list, and code points of a piece of text: what bounds the copying of each.
ROWS, PIECE = 256, 1024
#: Two code points that Unicode reserves for a program's own use: what stands for a base span's key
#: characters, and what marks the ends of matches. A text that has them is searched with U+FFFD there.
USED, MARK = "\ufdd0", "\ufdd1"
KEY = "A-Za-z0-9+/_-"


def _let(value: Column, use) -> Column:
    """use(value), with the value computed once a row: Catalyst doesn't copy it to where it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _running(values: Column, join) -> Column:
    """array<int>: the join (a sum, or the greatest) of all values up to each one.

    A fold copies what it has gathered at each step, so it gathers numbers only, ``ROWS`` at a time;
    each part starts from the join of the parts before it.
    """

    def part(xs: Column, start: Column) -> Column:
        state = F.struct(start.alias("at"), F.array().cast("array<int>").alias("out"))
        return F.aggregate(xs, state, lambda a, x: F.struct(join(a["at"], x).alias("at"), F.array_append(a["out"], join(a["at"], x)).alias("out")), lambda a: a["out"])

    def parts(xs: Column) -> Column:
        sums = part(F.transform(xs, lambda x: F.aggregate(x, F.lit(0), join)), F.lit(0))
        return _let(sums, lambda s: F.flatten(F.transform(xs, lambda x, i: part(x, F.coalesce(F.get(s, i - 1), F.lit(0))))))

    return _let(values, lambda v: _let(F.transform(F.sequence(F.lit(1), F.size(v), F.lit(ROWS)), lambda i: F.slice(v, i, F.lit(ROWS))), parts))


def _pieces(text: Column, pattern: str) -> Column:
    """What is between the matches of a pattern (leftmost, not overlapping), and the matches, in turn."""
    return F.split(F.regexp_replace(text, pattern, f"{MARK}$0{MARK}"), MARK, -1)


def _matches(pieces: Column, make, kind: str) -> Column:
    """array of make(match, start, stop, place in the pieces), of type ``kind``."""
    ends = _running(F.transform(pieces, F.length), lambda a, x: a + x)
    made = _let(ends, lambda e: F.transform(F.sequence(F.lit(1), F.size(pieces) - 2, F.lit(2)), lambda i: make(F.get(pieces, i), F.get(e, i - 1), F.get(e, i), i)))
    return F.when(F.size(pieces) > 1, made).otherwise(F.array().cast(kind))


def _rebuilt(text: Column, spans: Column, render) -> Column:
    """The text with its spans (sorted, a variable) replaced: render(own, kind, fresh) gives what stands for a span.

    A span that begins within the ones before it is not ``fresh`` and has what reaches beyond them as its
    ``own`` text. The text is cut from pieces of fixed length, as taking a part out of a long string
    reads it from the start.
    """

    def cut(pieces: Column, a: Column, b: Column) -> Column:
        first = lambda i: F.greatest(a - i * PIECE, F.lit(0))
        part = lambda i: F.substring(F.get(pieces, i), first(i) + 1, F.least(b - i * PIECE, F.lit(PIECE)) - first(i))
        whole = lambda n: F.floor(n / PIECE).cast("int")
        return F.when(a < b, F.array_join(F.transform(F.sequence(whole(a), whole(b - 1)), part), "")).otherwise("")

    def build(both: Column) -> Column:
        pieces, reach = both["pieces"], both["reach"]

        def one(x: Column, i: Column) -> Column:
            before = F.coalesce(F.get(reach, i - 1), F.lit(0))
            begin = F.greatest(before, x["start"])
            return F.concat(cut(pieces, before, begin), render(cut(pieces, begin, F.get(reach, i)), x["kind"], x["start"] >= before))

        # the last piece ends where the text does
        return F.concat(F.array_join(F.transform(spans, one), ""), cut(pieces, F.element_at(reach, -1), F.size(pieces) * PIECE))

    reach = _running(F.transform(spans, lambda x: x["stop"]), lambda a, x: F.greatest(a, x))
    both = F.struct(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0)).alias("pieces"), reach.alias("reach"))
    return F.when(F.size(spans) == 0, text).otherwise(_let(both, build))


def _luhn(digits: Column) -> Column:
    """Whether a string of digits passes Luhn's test."""
    values = F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise((2 * c.cast("int")) % 10 + F.floor(c.cast("int") / 5).cast("int")))
    return F.aggregate(values, F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0))) % 10 == 0


def _valid(kind: Column, text: Column) -> Column:
    digits = F.regexp_replace(text, "[^0-9]", "")
    return (
        F.when(kind == "ip", text.rlike(rf"^{PART}(?:\.{PART}){{3}}$"))
        .when(kind == "card", F.length(digits).between(12, 19) & F.when(F.length(digits) <= 19, _luhn(digits)).otherwise(F.lit(False)))
        .when(kind == "phone", F.length(digits).between(9, 15))
        .otherwise(F.lit(True))
    )


def _base(text: Column, digits: Column) -> Column:
    """The base spans, sorted; texts without a kind's telltale character skip its pattern."""
    some = {"email": F.contains(text, F.lit("@")), "phone": F.contains(text, F.lit("+"))}
    searched = [F.struct(F.lit(KINDS.index(k)).alias("rank"), F.lit(k).alias("kind"), F.when(some.get(k, digits), _pieces(text, p)).otherwise(F.array(F.lit(""))).alias("pieces")) for k, p in PATTERNS.items()]
    make = lambda x: lambda match, start, stop, i: F.struct(start.alias("start"), x["rank"].alias("rank"), stop.alias("stop"), F.when(_valid(x["kind"], match), x["kind"]).alias("kind"))
    return F.array_sort(F.filter(F.flatten(F.transform(F.array(*searched), lambda x: _matches(x["pieces"], make(x), SPAN))), lambda s: s["kind"].isNotNull()))


def _vote(yes: Column, no: Column | None = None) -> Column:
    out = F.when(yes, 1)
    return (out.when(no, -1) if no is not None else out).otherwise(0).cast("int")


def votes(x: Column) -> dict[str, Column]:
    """The labelers' votes on a candidate x (struct text, before)."""
    t, before = x["text"], F.lower(x["before"])
    return {
        "pattern_hex": _vote(t.rlike("^[0-9a-f]{16,}$|^[0-9A-F]{16,}$"), t.rlike("^[0-9]+$")),
        "pattern_mixed": _vote(t.rlike("[0-9].*[A-Za-z].*[0-9]") & (F.length(t) >= 12), t.rlike("^[0-9][0-9/_-]*$|^[A-Za-z]+[0-9]{1,4}$|^[^0-9]+$")),
        "gazetteer": _vote(before.rlike(f"{NAMED}$"), ~before.rlike(rf"(?:{GAZETTEER})")),
        "context_assigned": _vote(before.rlike("[=:]\\s{0,2}[\"']?$"), before.rlike("[a-zà-ÿ.,;!?)]\\s+$")),
        "context_quoted": _vote(before.rlike("[\"'`]$")),
    }


def span_features(x: Column) -> dict[str, Column]:
    """Yes-or-no features of a candidate for the span classifier."""
    t, before = x["text"], F.lower(x["before"])
    digits = F.length(F.regexp_replace(t, "[^0-9]", ""))
    return {
        "long": F.length(t) >= 16,
        "very_long": F.length(t) >= 32,
        "letters": t.rlike("[A-Za-z]"),
        "hex": t.rlike("^[0-9a-fA-F]+$"),
        "many_digits": digits * 4 >= F.length(t),
        "all_digits": digits == F.length(t),
        "no_digits": digits == 0,
        "assigned": before.rlike("[=:]\\s{0,2}[\"']?$"),
        "named": before.rlike(f"{NAMED}$"),
        "after_space": before.rlike("\\s$"),
    }


def _promising(text: Column) -> Column:
    """Whether a text may have candidates: it has a digit or a word of the gazetteer."""
    return text.rlike("[0-9]") | text.rlike(f"(?iu:{GAZETTEER})")


def _candidates(text: Column, base: Column) -> Column:
    """The candidates outside the base spans."""

    def found(pieces: Column) -> Column:
        # a candidate has 8 characters at least, so the context lies within the last nine pieces
        near = lambda i: F.array_join(F.transform(F.sequence(F.greatest(i - 9, F.lit(0)), i - 1), lambda j: F.substring(F.get(pieces, j), -CONTEXT, CONTEXT)), "")
        return _matches(pieces, lambda match, start, stop, i: F.struct(start.alias("start"), stop.alias("stop"), match.alias("text"), F.substring(near(i), -CONTEXT, CONTEXT).alias("before")), MATCHES)

    hidden = _rebuilt(text, base, lambda own, kind, fresh: F.regexp_replace(own, f"[{KEY}]", USED))
    return F.when(_promising(text), _let(_pieces(hidden, CANDIDATE), found)).otherwise(F.array().cast(MATCHES))


def spans_column() -> Column:
    """struct(base, candidates) of the columns text and digits: base spans (sorted) and candidates."""
    clean = F.replace(F.replace("text", F.lit(USED), F.lit("\ufffd")), F.lit(MARK), F.lit("\ufffd"))
    return _let(clean, lambda t: _let(_base(t, F.col("digits")), lambda b: F.struct(b.alias("base"), _candidates(t, b).alias("candidates"))))


def with_spans(docs: DataFrame, found: Column | None = None) -> DataFrame:
    """The rows with columns text (null: empty), digits, and found (``spans_column``, which may be given as it is long to build)."""
    rows = docs.withColumn("text", F.coalesce("text", F.lit(""))).withColumn("digits", F.col("text").rlike("[0-9]"))
    return rows.withColumn("found", spans_column() if found is None else found)


def reliabilities(rows: list[tuple[tuple[int, ...], int]], rounds: int = 60) -> tuple[float, list[tuple[dict[int, float], dict[int, float]]]]:
    """Share of private spans and each labeler's vote distribution for both classes, by EM.

    ``rows``: vote patterns and their counts. Responsibilities start from the sum of votes, so the
    class that labelers vote for is the private one.
    """
    total = sum(n for _, n in rows)
    width = len(rows[0][0])
    belief = [1 / (1 + math.exp(-1.5 * sum(v))) for v, _ in rows]
    share, tables = 0.5, []
    for _ in range(rounds):
        share = min(max((sum(b * n for b, (_, n) in zip(belief, rows, strict=True)) + 1) / (total + 2), 1e-3), 1 - 1e-3)
        tables = []
        for k in range(width):
            pair = []
            for own in (belief, [1 - b for b in belief]):
                mass = {v: 0.5 for v in (-1, 0, 1)}
                for b, (vs, n) in zip(own, rows, strict=True):
                    mass[vs[k]] += b * n
                whole = sum(mass.values())
                pair.append({v: m / whole for v, m in mass.items()})
            tables.append(tuple(pair))
        belief = [_posterior(vs, share, tables) for vs, _ in rows]
    return share, tables


def _posterior(vs: tuple[int, ...], share: float, tables: list) -> float:
    odds = math.log(share / (1 - share)) + sum(math.log(t[0][v] / t[1][v]) for t, v in zip(tables, vs, strict=True))
    return 1 / (1 + math.exp(-max(-50.0, min(50.0, odds))))


def train(candidates: DataFrame) -> list[float] | None:
    """Weights (bias first) of the span classifier; ``candidates`` has one struct column x for each candidate."""
    vs, fs = votes(F.col("x")), span_features(F.col("x"))
    counts = candidates.select(*[c.alias(f"v_{k}") for k, c in vs.items()], *[c.cast("int").alias(f"f_{k}") for k, c in fs.items()]).groupBy(*[f"v_{k}" for k in vs], *[f"f_{k}" for k in fs]).count()
    rows = sorted(((tuple(r[f"v_{k}"] for k in vs), tuple(r[f"f_{k}"] for k in fs), r["count"]) for r in counts.collect()))  # bounded by the patterns
    if not rows:
        return None
    by_votes: dict[tuple, int] = {}
    for v, _, n in rows:
        by_votes[v] = by_votes.get(v, 0) + n
    share, tables = reliabilities(sorted(by_votes.items()))
    total = sum(n for *_, n in rows)
    weights = [0.0] * (len(fs) + 1)
    for _ in range(400):  # full-batch gradient of the soft cross-entropy, with a small ridge
        grads = [-0.002 * w for w in weights]
        for v, f, n in rows:
            x = (1, *f)
            p = 1 / (1 + math.exp(-max(-50.0, min(50.0, sum(w * a for w, a in zip(weights, x, strict=True))))))
            e = (_posterior(v, share, tables) - p) * n / total
            for i, a in enumerate(x):
                grads[i] += e * a
        weights = [w + 4.0 * g for w, g in zip(weights, grads, strict=True)]
    return weights


def _probability(x: Column, weights: list[float]) -> Column:
    total = F.lit(weights[0])
    for w, f in zip(weights[1:], span_features(x).values(), strict=True):
        total = total + F.when(f, w).otherwise(0.0)
    return 1 / (1 + F.exp(-total))


def _digest(spans: str) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")


def find(docs: DataFrame, threshold: float = 0.7) -> DataFrame:
    """The rows (all columns of ``docs``; text: null becomes empty) with base and all (sorted spans)."""
    names = [c for c in docs.columns if c != "text"]
    keep = {c: f"_own_{i}" for i, c in enumerate(names)}  # the work columns can't clash with the table's
    renamed = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in keep.items()], "text")
    found = spans_column()
    work = with_spans(renamed, found)
    # explode would make Spark compute the candidates once more, to drop rows without any
    candidates = with_spans(docs.select("text").where(_promising(F.col("text"))), found).select(F.explode_outer("found.candidates").alias("x")).where("x is not null")
    weights = train(candidates)
    added = F.array().cast(SPAN)
    if weights is not None:
        chosen = F.filter("found.candidates", lambda c: _probability(c, weights) >= threshold)
        added = F.transform(chosen, lambda c: F.struct(c["start"].alias("start"), F.lit(KINDS.index("secret")).alias("rank"), c["stop"].alias("stop"), F.lit("secret").alias("kind")))
    out = work.withColumn("all", F.array_sort(F.concat("found.base", added)))
    return out.select(*[F.col(n).alias(c) for c, n in keep.items()], "text", F.col("found.base").alias("base_spans"), F.col("all").alias("all_spans"))


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans of every row."""
    found = find(docs.select("doc_id", "text"))
    count = lambda k: F.size(F.filter("base_spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *[count(k) for k in PATTERNS], F.sha2(_digest("base_spans").cast("binary"), 256).alias("base_sha256"), _digest("all_spans").alias("spans"))


def redact(docs: DataFrame) -> DataFrame:
    """The rows with every span of their text replaced by its kind in brackets; overlapping spans become one."""
    found = find(docs.select(*[F.col(f"`{c}`").alias(f"_doc_{i}") for i, c in enumerate(docs.columns) if c != "text"], "text"))
    clean = _let(F.col("all_spans"), lambda spans: _rebuilt(F.col("text"), spans, lambda own, kind, fresh: F.when(fresh, F.concat(F.lit("["), F.upper(kind), F.lit("]"))).otherwise("")))
    return found.select(*[clean.alias("text") if c == "text" else F.col(f"_doc_{i}").alias(c) for i, c in enumerate(docs.columns)])
