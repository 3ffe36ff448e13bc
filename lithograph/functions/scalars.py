"""Scalar functions on columns; all stay in the JVM and within code generation where Spark allows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TERM = "[A-Za-z_][A-Za-z0-9_]*|[0-9]+"


def terms(text: Column) -> Column:
    """Identifiers and numbers of a text, lower-cased, in order."""
    return F.regexp_extract_all(F.lower(text), F.lit(TERM.replace("A-Z", "")), F.lit(0))


def query_terms(text: Column, limit: int = 16) -> Column:
    """The first distinct terms of a query."""
    return F.slice(F.array_distinct(terms(text)), 1, limit)


def token_estimate(text: Column) -> Column:
    """Runs of non-space characters, one at least."""
    return F.greatest(F.lit(1), F.size(F.regexp_extract_all(text, F.lit("\\S+"), F.lit(0))))


def slug(text: Column) -> Column:
    """Lower-case words joined by hyphens; 'page' if nothing is left."""
    out = F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.coalesce(F.when(out != "", out), F.lit("page"))


def humanized(stem: Column) -> Column:
    """A file's stem as words: no leading test_, camel case split, words capitalised (capitals are kept)."""
    text = F.regexp_replace(F.regexp_replace(stem, "^test_", ""), "([a-z0-9])([A-Z])", "$1 $2")
    words = F.filter(F.split(F.regexp_replace(text, "[_-]+", " "), " +"), lambda w: w != "")
    return F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1 << 20))), " ")


def without_doubled_words(text: Column) -> Column:
    """Adjacent words that are equal but for case become one."""
    words = F.split(text, " ")
    kept = F.filter(F.transform(words, lambda w, i: F.when((i > 0) & (F.lower(w) == F.lower(F.get(words, i - 1))), F.lit(None)).otherwise(w)), lambda w: w.isNotNull())
    return F.array_join(kept, " ")


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def extension(path: Column) -> Column:
    """The last suffix of a path's name with its dot; empty if it has none."""
    return F.regexp_extract(base_name(path), "^.+(\\.[^.]+)$", 1)


def parent_dir(path: Column) -> Column:
    return F.when(F.contains(path, F.lit("/")), F.regexp_replace(path, "/[^/]*$", "")).otherwise(F.lit(""))


def normal_path(path: Column) -> Column:
    return F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), "^/+|/+$", "")


def epoch(stamp: Column) -> Column:
    """Seconds of an ISO time; null if it can't be read. Times without a zone are UTC."""
    return F.unix_timestamp(F.try_to_timestamp(F.trim(stamp)))


def integer_or(text: Column, default: int = 0) -> Column:
    return F.coalesce(text.try_cast("long"), F.lit(default))


def web_base(url: Column) -> Column:
    """Address of a repository's web page from a git URL."""
    out = F.regexp_replace(F.trim(url), "^git@([^:]+):", "https://$1/")
    return F.regexp_replace(F.regexp_replace(out, "^ssh://git@", "https://"), "(\\.git)?/?$", "")


def quoted_path(path: Column) -> Column:
    """Percent-encoded path that keeps its slashes."""
    return F.replace(F.replace(F.url_encode(path), F.lit("%2F"), F.lit("/")), F.lit("+"), F.lit("%20"))


def citations(markdown: Column) -> Column:
    """Distinct citation ids of markers such as [[S3]], in order."""
    return F.array_distinct(F.regexp_extract_all(markdown, F.lit("\\[\\[(S\\d+)\\]\\]"), F.lit(1)))


def redacted(text: Column, limit: int = 1600) -> Column:
    """Keys, bearer tokens of authorization headers and assigned API keys replaced; cut to a length."""
    out = F.regexp_replace(text, "sk-[A-Za-z0-9_-]{8,}", "[redacted]")
    out = F.regexp_replace(out, "(?i)(authorization[\"']?\\s*[:=]\\s*[\"']?bearer\\s+)[A-Za-z0-9._~+/=-]+", "$1[redacted]")
    out = F.regexp_replace(out, "(?i)(api[_-]?key[\"']?\\s*[:=]\\s*[\"']?)[^\\s,;\"']+", "$1[redacted]")
    return F.substring(out, 1, limit)


def markdown_faults(text: Column, title: Column) -> Column:
    """array<string>: what a page lacks, of a first heading, its title there, and a further heading."""
    first = F.regexp_extract(text, "(?m)\\A\\s*# +(.+?)\\s*$", 1)
    return F.array_compact(F.array(F.when(first == "", "no first heading"), F.when((first != "") & (first != title), "another title"), F.when(~text.rlike("(?m)^## +\\S"), "no section")))


def without_source_lines(text: Column) -> Column:
    """Lines that begin with ``Sources:`` go where they stand outside of fences; runs of blank lines become one."""
    lines = F.split(text, "\n")
    state = F.struct(F.lit(False).alias("fenced"), F.array().cast("array<string>").alias("out"))

    def add(acc: Column, x: Column) -> Column:
        fence = F.startswith(F.ltrim(x), F.lit("```"))
        drop = ~acc["fenced"] & F.ltrim(x).rlike("^(?:\\*\\*)?Sources:")
        return F.struct((acc["fenced"] != fence).alias("fenced"), F.when(drop, acc["out"]).otherwise(F.array_append(acc["out"], x)).alias("out"))

    kept = F.aggregate(lines, state, add, lambda acc: F.array_join(acc["out"], "\n"))
    return F.regexp_replace(F.regexp_replace(kept, "\n{3,}", "\n\n"), "\\A\\s+|\\s+\\z", "")


def canonical_json(columns: dict[str, Column]) -> Column:
    """JSON of named values, keys in order, with the spaces of ``, `` and ``: `` between them."""
    parts = [F.concat(F.lit(f'"{k}": '), F.coalesce(F.to_json(F.array(columns[k])), F.lit("[null]"))) for k in sorted(columns)]
    inner = [F.regexp_replace(p, '^("[^"]*": )\\[(?s)(.*)\\]$', "$1$2") for p in parts]
    return F.concat(F.lit("{"), F.concat_ws(", ", *inner), F.lit("}"))


def normal_name(name: Column) -> Column:
    """A community's name in one form: runs of white space are a space, no quotes or stops around it."""
    return F.regexp_replace(F.regexp_replace(F.trim(name), "\\s+", " "), "^[\"'`.:]+|[\"'`.:]+$", "")


# Names that say nothing.
GENERIC_NAMES = ["community", "module", "component", "group", "cluster", "misc", "other", "unknown", "untitled"]


def is_generic_name(name: Column) -> Column:
    """Whether a name is empty or only one of the words that say nothing, with a number or without."""
    return F.lower(normal_name(name)).rlike("^(?:(?:" + "|".join(GENERIC_NAMES) + ")\\s*#?\\d*)?$")


def json_object(text: Column) -> Column:
    """The outermost {...} of a noisy text; empty if there is none."""
    return F.regexp_extract(text, "(?s)\\{.*\\}", 0)


def line_label(start: Column, end: Column) -> Column:
    return F.when(start.isNull(), F.lit("")).when(end.isNull() | (end == start), F.concat(F.lit("L"), start.cast("string"))).otherwise(F.concat(F.lit("L"), start.cast("string"), F.lit("-L"), end.cast("string")))


def joined_route(prefix: Column, path: Column) -> Column:
    """A route's prefix and path with one slash between them and one in front."""
    both = F.concat(F.lit("/"), F.regexp_replace(prefix, "^/+|/+$", ""), F.lit("/"), F.regexp_replace(path, "^/+|/+$", ""))
    out = F.regexp_replace(F.regexp_replace(both, "/+", "/"), "/$", "")
    return F.when(out == "", F.lit("/")).otherwise(out)


def diagram_label(text: Column, limit: int = 80) -> Column:
    """Text that can stand in a diagram's label."""
    return F.substring(F.replace(F.replace(F.regexp_replace(text, "\\s+", " "), F.lit('"'), F.lit("'")), F.lit("|"), F.lit("/")), 1, limit)


def digest_id(owner: str, kind: str, parts: list[Column], size: int) -> Column:
    """owner:kind: and the first characters of the sha1 of the parts joined by a bar."""
    return F.concat(F.lit(f"{owner}:{kind}:"), F.substring(F.sha1(F.concat_ws("|", *parts)), 1, size))
