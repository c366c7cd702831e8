"""Periodic runs, target resampling and token counts beside plain versions."""

import hashlib
import math
import random
import re
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerloom.llm import periodic_runs, target_resampling, token_counts

from . import brute

LOWER = brute.LOWER


def docs(spark, rows, schema="doc_id long, text string"):
    return spark.createDataFrame(rows, schema)


# --- periodic runs ----------------------------------------------------------------------------

def plain_runs(words, shortest=12):
    n, best = len(words), {}
    for q in range(1, n // 2 + 1):
        i = q
        while i < n:
            j = i
            while j < n and words[j] == words[j - q]:
                j += 1
            if j - i + q >= max(shortest, 2 * q):
                best.setdefault((i - q, j - i + q), q)
            i = max(j, i + 1)
    return sorted(((s, m, q) for (s, m), q in best.items()), key=lambda r: (r[0], r[2]))


@st.composite
def texts(draw):
    words = draw(st.lists(st.integers(0, draw(st.sampled_from([0, 1, 2, 4, 40]))), max_size=120))
    for _ in range(draw(st.integers(0, 3))):
        if len(words) > 4:
            a = draw(st.integers(0, len(words) - 1))
            p, e = draw(st.integers(1, len(words) // 3)), draw(st.integers(a, len(words)))
            words[a:e] = [words[a + (i - a) % p] for i in range(a, e)]
    return words


@given(texts(), st.sampled_from([12, 12, 2, 3, 7, 13]))
@settings(max_examples=400, deadline=None)
def test_runs_are_those_of_all_lags(words, shortest):
    assert periodic_runs.runs(periodic_runs.word_ids(words), shortest) == plain_runs(words, shortest)


@pytest.mark.parametrize("words", [
    [0] * 60, ([0] * 20 + [1]) * 4, list(range(10)) * 5, [0, 1, 0] * 8, [0, 1] * 5, [0, 1] * 6, [3] + [0, 1, 2, 0, 1] * 7 + [4],
    ([0, 1, 2] * 4 + [3]) * 3, [], [1], list(range(30))])
def test_runs_of_known_texts(words):
    assert periodic_runs.runs(periodic_runs.word_ids(words)) == plain_runs(words)


def test_long_texts_of_few_words():
    assert periodic_runs.runs(periodic_runs.word_ids([b"a"] * 500_000)) == [(0, 500_000, 1)]
    found = periodic_runs.runs(periodic_runs.word_ids(([0] * 3000 + [1]) * 40))
    assert len(found) == 41 and (0, 3001 * 40, 3001) in found
    a, b = [0], [0, 1]
    while len(b) < 30_000:
        a, b = b, b + a
    assert len(periodic_runs.runs(periodic_runs.word_ids(b))) > 1000


def plain_tail(doc, words):
    h = zlib.crc32(str(doc).encode())
    g, n = h // 10, len(words)
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def test_runs_of_rows(spark):
    rng = random.Random(4)
    rows = [(i, rng.choice([" ", "\n", "\t \x0b"]).join(rng.choice(["a", "É", "c\xa0d"]) for _ in range(rng.choice([0, 1, 5, 80])))) for i in range(120)]
    rows += [(500, None), (None, "a " * 20), (3, "x " * 15), (3, "x " * 15), (501, " \n"), (502, "w " * 400_000)]
    table = docs(spark, [(i, t, 1, "x", 2) for i, t in rows], "doc_id long, text string, runs int, collapsed string, n_words int")
    made = table.withColumn("text", periodic_runs.repeated_tails(table.doc_id, table.text))
    got = sorted(((r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in periodic_runs.find_runs(made).collect()), key=repr)
    want = []
    for doc, text in rows:
        words = re.findall("[^\x20\x09-\x0D]+", text or "")
        if doc is not None:
            words = plain_tail(doc, words)
        found = plain_runs(words) if len(words) < 1000 else [(0, 400_000, 1)]
        dropped = {i for s, m, q in found for i in range(s + q, s + m)}
        want.append((doc, len(words), found, " ".join(w for i, w in enumerate(words) if i not in dropped)))
    assert got == sorted(want, key=repr)
    assert any(zlib.crc32(str(i).encode()) % 10 == 0 and t for i, t in rows[:120])
    assert periodic_runs.find_runs(docs(spark, [])).count() == 0


# --- target resampling ------------------------------------------------------------------------

def plain_features(text, longest):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    return len(words), [" ".join(words[i:i + k]) for k in range(1, longest + 1) for i in range(len(words) - k + 1)]


def plain_sample(rows, aims, longest, buckets, percent, least, seed):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    source, target, read = [0] * buckets, [0] * buckets, {}
    for doc, text in rows:
        n, found = plain_features(text, longest)
        read[doc] = n, [bucket(f) for f in found]
        for b in read[doc][1]:
            source[b] += 1
    for text in aims:
        for f in plain_features(text, longest)[1]:
            target[bucket(f)] += 1
    s_all, t_all, out = sum(source), sum(target), {}
    gain = [math.floor(1000 * math.log((t + 1) * (s_all + buckets) / ((s + 1) * (t_all + buckets)))) for s, t in zip(source, target)]
    for doc, (n, found) in read.items():
        weight = sum(gain[b] for b in found) // len(found) if found else 0
        h = int(hashlib.sha256(f"{seed}:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        out[doc] = [n, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None]
    drawn = sorted((d for d in out if out[d][0] >= least), key=lambda d: (-out[d][3], d is None, d or 0))
    for rank, doc in enumerate(drawn[:percent * len(drawn) // 100], 1):
        out[doc][4] = rank
    return {d: tuple(v) for d, v in out.items()}


@pytest.mark.parametrize("longest", [1, 3])
def test_sample_is_that_of_plain_counts(spark, longest):
    rng = random.Random(6)
    word = lambda: rng.choice(["ab", "Ab", "É", "é", "x9", "中国", "\xa0", "q"])
    say = lambda n: rng.choice([" ", ", ", "\x00", "_-"]).join(word() for _ in range(n))
    rows = [(i, say(rng.choice([0, 1, 4, 5, 30, 200]))) for i in range(150)] + [(900, None), (901, ""), (None, say(40)), (902, " ,.")]
    aims = [say(20) for _ in range(5)] + [None, ""]
    table = docs(spark, [(i, t, 1, 2, 3) for i, t in rows], "doc_id long, text string, score int, rank int, _row int")
    found = target_resampling.sample(table, docs(spark, list(enumerate(aims)), "item_id long, text string"), longest=longest, buckets=50, percent=40, least_words=5)
    got = {r.doc_id: (r.n_words, r.n_features, r.weight, r.score, r["rank"]) for r in found.collect()}
    assert got == plain_sample(rows, aims, longest, 50, 40, 5, 2024)


@pytest.mark.parametrize("longest", [1, 2, 4])
def test_features_in_portions(monkeypatch, longest):
    monkeypatch.setattr(target_resampling, "AT_ONCE", 9)
    rng = random.Random(longest)
    own = target_resampling.Features(longest, 997)
    for _ in range(60):
        text = "".join(rng.choice(["a", "B", "é", "中", " ", ".", "\n"]) for _ in range(rng.choice([0, 3, 40, 200])))
        n, found = own.of(text.encode())
        plain_n, plain = plain_features(text, longest)
        assert n == plain_n and sorted(found.tolist()) == sorted(zlib.crc32(f.encode()) % 997 for f in plain)


def test_sample_of_little(spark):
    rows = [(7, "one two")] * 4 + [(8, "three " * 30)]
    aim = docs(spark, [(1, "three")])
    found = target_resampling.sample(docs(spark, rows), aim, percent=50, least_words=1).collect()
    assert sorted(r["rank"] for r in found if r["rank"]) == [1, 2]
    assert len({(r.weight, r.score) for r in found if r.doc_id == 7}) == 1
    empty = docs(spark, [])
    assert target_resampling.sample(empty, aim).count() == 0
    assert [r["rank"] for r in target_resampling.sample(docs(spark, rows), empty).collect()] == [None] * 5


def test_numbers_are_ranks(spark):
    from pyspark.sql import functions as F
    rows = spark.range(5000).withColumn("score", F.col("id") % 7)
    found = target_resampling.numbered(rows, [F.desc("score"), F.asc("id")]).orderBy("rank").collect()
    assert [r["rank"] for r in found] == list(range(1, 5001)) and [(-r.score, r.id) for r in found] == sorted((-r.score, r.id) for r in found)


# --- token counts -----------------------------------------------------------------------------

@pytest.fixture(scope="module")
def counter():
    tokenizers = pytest.importorskip("public_tokenizers")
    return token_counts.TokenCounter(tokenizers.path("piece_bpe_32k.model"))


KINDS = ["the of a hello tion ing 中 国 é 𐍈 ▁ \n \t 0 000 == ---- aaaa a xx <s> </s> <0x41> der".split(" "), ["a"], list("abcdefgh"), list("  \n-=aé"), list("中国日本𐍈")]


@given(st.sampled_from(KINDS).flatmap(lambda k: st.tuples(st.sampled_from(["", " ", "  "]), st.lists(st.sampled_from(k), min_size=30, max_size=300))),
       st.sampled_from([8, 16, 32, 64]), st.sampled_from([1, 2, 6, 12]))
@settings(max_examples=300, deadline=None)
def test_spliced_chunks_are_the_whole(counter, parts, chunk, overlap):
    text = parts[0].join(parts[1])
    counter.chunk, counter.overlap = chunk, overlap
    assert counter.count([text])[0][0] == len(counter.whole.encode(text))
    counter.chunk, counter.overlap = token_counts.CHUNK, token_counts.OVERLAP


@pytest.mark.parametrize("text", ["a" * 1_000_000, "the house, and " * 70_000, " " * 300_000, "ab" * 300_000, "𐍈" * 60_000])
def test_huge_texts(counter, text):
    n, chunks = counter.count([text])[0]
    assert n == len(counter.whole.encode(text)) and 1 < chunks < len(text) // 2_000


def test_counts_of_rows(spark, counter):
    rng = random.Random(8)
    rows = [(i, " ".join(rng.choice(KINDS[0]) for _ in range(rng.choice([0, 1, 50])))) for i in range(50)]
    rows += [(60, None), (None, "a b"), (1, "x"), (1, "x"), (61, "word " * 20_000)]
    table = docs(spark, [(i, t, 1, 2) for i, t in rows], "doc_id long, text string, n_tokens int, n_bytes int")
    got = sorted(((r.doc_id, r.n_bytes, r.n_tokens) for r in token_counts.count_tokens(table).collect()), key=repr)
    assert got == sorted(((i, len((t or "").encode()), len(counter.whole.encode(t or ""))) for i, t in rows), key=repr)
    assert token_counts.count_tokens(docs(spark, [])).count() == 0


# --- the queries ------------------------------------------------------------------------------

@pytest.mark.parametrize("name", ["op11_periodic_runs", "op12_target_resampling"])
def test_queries_beside_sql(spark, name):
    import duckdb

    import __spark_entry__ as entry
    directory = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{directory}/{t}.parquet'")
    found = entry.queries()[name](spark, directory)
    want = con.execute(f"SELECT {', '.join(found.columns)} FROM ({entry.oracle_sql()[name]})").fetchall()
    assert sorted(map(tuple, found.collect())) == sorted(want, key=lambda r: r[0])


def test_token_query_counts_whole_texts(spark, counter):
    import __spark_entry__ as entry
    directory = "/root/testdata/sf0.001"
    want = {r.doc_id: len(counter.whole.encode(r.text or "")) for r in spark.read.parquet(f"{directory}/documents.parquet").collect()}
    found = entry.queries()["op13_token_counts"](spark, directory).collect()
    assert {r.doc_id: r.n_tokens for r in found} == want and all(r.over_limit == (r.n_tokens > 4096) for r in found)
