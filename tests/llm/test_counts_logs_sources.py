"""Operators 11 to 13 against brute force, on small tables and on odd rows."""

import collections
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from lithograph.llm import log_reassembly, queries, source_divergence, token_counts
from lithograph.llm.common import shared_dir
from tests.oracle import connection, rows

tokenizers = pytest.importorskip("tokenizers")
VOCABULARY = token_counts.default_vocabulary()
ODD = ["", None, "a", " \n\t ", "don't DON'T ''s x''st it's 've", "<|endoftext|> hi <|endoftext|>x<|endof", "ΑΣ ΣΑΣ İstanbul ǅ", "é ́a  x y\x1cz\x1f\x85k", "日本語テキスト123 ٣٤ 😀😀 ​", "a" * 5000, "a  \n\n  b   ", "क़ ẞ ﬁ Å ՘ \U00010940", "\n\n\n", "word " * 20000]


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(VOCABULARY)


def counts_of(library, data):
    found = library.encode_batch([t or "" for _, t in data], add_special_tokens=False)
    return sorted(((i, len((t or "").encode()), len(e.ids), len(e.ids) > 1024) for (i, t), e in zip(data, found, strict=True)), key=repr)


@pytest.mark.parametrize("head", [token_counts.HEAD, 8])
def test_token_counts_equal_the_library(spark, library, head):
    data = [*enumerate(ODD), (4, ODD[4]), (4, ODD[4]), (4, "other text"), (None, None), (None, "x y"), (None, "x y")]
    docs = spark.createDataFrame([(t, i, "k", 1, 2) for i, t in data], "text string, doc_id long, key string, n long, tokens long")
    assert sorted(map(tuple, token_counts.counted(docs, VOCABULARY, head=head).collect()), key=repr) == counts_of(library, data)
    assert token_counts.counted(docs.limit(0), VOCABULARY).count() == 0


def test_token_counts_of_the_documents(spark, sf, library):
    data = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(map(tuple, queries.op13_token_counts(spark, sf).collect()), key=repr) == counts_of(library, data)


def test_blocks_and_special_strings_do_not_change_counts(library, monkeypatch):
    tool = token_counts.Pieces(VOCABULARY)
    monkeypatch.setattr(token_counts, "BLOCK", 7)
    for text in [t for t in ODD if t and len(t) < 1000] + ["one  two\tthree " * 20, "a<|endoftext|><|endoftext|> b"]:
        n = sum(k * tool.n_tokens(p.encode()) for p, k in tool.counts(text).items()) + tool.n_special(text)
        assert n == len(library.encode(text, add_special_tokens=False).ids)


def test_settled_characters_are_cut_as_the_library_does(library):
    cut = library.pre_tokenizer.pre_tokenize_str
    every = [c for a, b in token_counts.SETTLED for c in range(a, b + 1)]
    for at in range(0, len(every), 4000):
        text = "".join(f"x{chr(c)}x 1{chr(c)}1 !{chr(c)}!\n" for c in every[at : at + 4000])
        assert [m.span() for m in token_counts.PIECES.finditer(text)] == [b for _, b in cut(text)]


def test_frequent_pieces_are_bounded(spark, sf):
    pieces = token_counts.distinct_pieces(spark.read.parquet(f"{sf}/documents.parquet"), VOCABULARY, shared_dir(spark))
    every = sorted((r["n"] for r in pieces.collect()), reverse=True)
    for head in (0, 10, 100, 1000, len(every)):
        known = token_counts.frequent(pieces, head)
        assert len(known) <= head and (head < 1000 or len(known) > head // 2)
        assert not known or min(r["n"] for r in pieces.where(F.col("key").isin(list(known)[:50])).collect()) >= every[head - 1]
    assert pieces.where(F.octet_length("key") > token_counts.KEY_BYTES + 7).isEmpty()


def brute_audit(data, least, top):
    """The contract's rows from (lang, source, text)."""
    docs = [(g or "", s or "", re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))) for g, s, t in data]
    out = []
    for lang in {g for g, _, _ in docs}:
        df = collections.Counter(t for g, _, ts in docs if g == lang for t in set(ts))
        kept = {t for t, n in df.items() if n >= least}
        by = collections.defaultdict(collections.Counter)
        for g, s, ts in docs:
            if g == lang:
                by[s].update(t for t in ts if t in kept)
        share = lambda c: {t: 1 + 10**9 * (c[t] + 5) // (sum(c.values()) + 5 * len(kept)) for t in kept}  # noqa: B023, E731
        q, p = share(sum(by.values(), collections.Counter())), {s: share(c) for s, c in by.items()}
        for s in by:
            pairs = [(sum(abs(p[s][t] - p[o][t]) for t in kept), o) for o in by if o != s]
            terms = [(p[s][t] - q[t], t) for t in kept if by[s][t] > 0 and p[s][t] > q[t]]
            for part, found, most in (("pair", pairs, None), ("term", terms, top)):
                out += [(lang, s, part, item, v, r) for r, (v, item) in enumerate(sorted(found, key=lambda x: (-x[0], x[1].encode()))[:most], 1)]
    return sorted(out)


def test_source_divergence_equals_brute_force(spark, sf):
    rng = random.Random(4)
    words = ["Äther", "äther", "one", "ONE", "two2two", "three-four", "日本", "x", "ÉTÉ", "y\x00z", "rare"]
    data = [(rng.choice(["en", "de", None, ""]), rng.choice(["a", "b", None, "ü", "c"]), " ".join(rng.choices(words, range(11, 0, -1), k=rng.randrange(12)))) for _ in range(300)]
    data += [("fr", "only", None), ("fr", "other", "!!! 12"), ("one", "group", "one one one")] + [data[0]] * 3
    docs = spark.createDataFrame([(*x, "t", 1, "p") for x in data], "lang string, source string, text string, term string, n long, part string")
    for groups in (source_divergence.GROUPS, 0):  # by broadcast, and by sort and merge
        assert sorted(map(tuple, source_divergence.audit(docs, 5, 4, groups).collect())) == brute_audit(data, 5, 4)
    assert source_divergence.audit(docs.limit(0)).count() == 0
    got = queries.op11_source_divergence(spark, sf)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    want = connection(sf).sql(source_divergence.ORACLE)
    assert rows(got.columns, map(tuple, got.collect())) == rows(want.columns, want.fetchall())


def test_terms_of_a_long_text_are_whole(monkeypatch):
    text = ("One, two; " * 50 + "x" * 40 + "é" * 9).encode()
    whole = [t for b in source_divergence.term_blocks(text) for t in b]
    monkeypatch.setattr(source_divergence, "BLOCK", 5)
    assert [t for b in source_divergence.term_blocks(text) for t in b] == whole and len(whole) == 101


def brute_replay(data, toxic, every, keys):
    """Record by record: the contract's rows from (doc_id, source, text)."""
    crc = lambda s: zlib.crc32(s.encode())
    log = []
    for i, source, text in data:
        if i is not None:
            h = crc(str(i))
            m = h % 41
            kind = "commit" if m < 2 else "abort" if m < 3 else "savepoint" if m < 5 else "rollback" if m < 7 else "change"
            key = h // 100 % keys
            log.append((i, source, kind, key, None if kind != "change" or text is None or i in toxic else crc(f"{key}:{text}")))
    log.sort(key=lambda r: (r[0], r[1] is not None, r[1] or "", r[4] is not None, r[4] or 0))
    pending, mark, store, out, commits = collections.defaultdict(list), collections.defaultdict(int), {}, [], 0

    def undo(source, since, kind, by):
        out.extend((kind, i, by, key) for i, key, _ in pending[source][since:])
        del pending[source][since:]

    def state():
        out.append(("state", -(-commits // every), len(store), sum(store.values())))

    for i, source, kind, key, value in log:
        if kind == "change":
            pending[source].append((i, key, value))
        elif kind == "savepoint":
            mark[source] = len(pending[source])
        elif kind == "rollback":
            undo(source, mark[source], "rollback", i)
        else:
            if kind == "abort":
                undo(source, 0, "abort", i)
            else:
                for _, k, v in pending[source]:
                    store.pop(k, None)
                    if v is not None:
                        store[k] = v
                commits += 1
                if commits % every == 0:
                    state()
            pending[source], mark[source] = [], 0
    if commits % every:
        state()
    for source in list(pending):
        undo(source, 0, "abort", None)
    return sorted(out, key=repr)


@pytest.mark.parametrize("n, every, keys, largest, fan", [(500, 2, 7, 20, 2), (500, 16, 3000, 500_000, 256), (60, 1, 1, 1, 3), (0, 16, 3000, 10, 2)])
def test_replay_equals_record_by_record(spark, n, every, keys, largest, fan):
    rng = random.Random(n + every)
    data = [(i * 3 + rng.randrange(3), rng.choice(["hot", "hot", "a", None, "", "ü"]), rng.choice([None, "", "x", "é" * 9])) for i in range(n)]
    data += [data[k] for k in range(0, n, 9)] + [(i, "other", "same id") for i, _, _ in data[::11]] + [(None, "a", "x")] * min(n, 2)
    rng.shuffle(data)
    toxic = {i for i, _, _ in data[::7]}
    marks = [(i, 1, 5) for i in toxic] + [(i, 0, 5) for i in list(toxic)[:9]] + [(None, 1, 5), (data[1][0], None, 5)] if n else []
    labels = spark.createDataFrame(marks, "doc_id long, toxic int, source int")
    docs = spark.createDataFrame([(*x, "k", 1, 2) for x in data], "doc_id long, source string, text string, kind string, number long, chunk long").repartition(3)
    got = log_reassembly.replay(docs, labels, every, keys, largest, fan)
    assert got.columns == ["kind", "id", "n", "value"]
    assert sorted(map(tuple, got.collect()), key=repr) == brute_replay(data, toxic - {None}, every, keys)


def test_replay_of_the_documents(spark, sf):
    data = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "source", "text").collect()]
    toxic = {r["doc_id"] for r in spark.read.parquet(f"{sf}/labels.parquet").where("toxic = 1").collect()}
    got = sorted(map(tuple, queries.op12_log_reassembly(spark, sf).collect()), key=repr)
    assert got == brute_replay(data, toxic, 16, 3000)
    assert got == sorted(connection(sf).sql(log_reassembly.ORACLE).fetchall(), key=repr)


@pytest.mark.parametrize("fan", [2, 3, 50])
def test_scans_equal_a_loop(spark, fan):
    rng = random.Random(fan)
    data = [(rng.choice(["a", None, "b"]), p, rng.choice([None, 1, 2, 3]), rng.choice([None, 9])) for p in rng.sample(range(70), 40)]
    seen, want, total, sums = {}, set(), 0, set()
    for group, p, x, y in sorted(data, key=lambda r: r[1]):
        last = seen.get(group, (None, None))
        want.add((group, p, *last))
        sums.add((p, total))
        seen[group] = (last[0] if x is None else x, last[1] if y is None else y)
        total += x or 0
    df = spark.createDataFrame(data, "grp string, p long, x long, y long").withColumn("v", F.struct("x", "y")).select("grp", "p", "v")
    got = log_reassembly.carried(df, ["grp"], "p", shared_dir(spark), fan)
    assert {(r["grp"], r["p"], *(r["before"] or (None, None))) for r in got.collect()} == want
    got = log_reassembly.running(df.select("p", F.struct(F.coalesce("v.x", F.lit(0)).alias("x")).alias("v")), "p", shared_dir(spark), fan)
    assert {(r["p"], r["before"]["x"]) for r in got.collect()} == sums
