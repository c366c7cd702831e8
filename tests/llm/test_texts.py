import base64
import bz2
import gzip
import hashlib
import lzma
import random
import time
import urllib.parse
import zlib

import pytest

from ledgerloom.llm import decontaminate, html_extract, importance_sample, language_id, secret_scan, spot_signatures, url_filter

from . import brute


def docs(spark, rows, schema="doc_id long, text string"):
    return spark.createDataFrame(rows, schema)


# --- benchmark --------------------------------------------------------------------------------

def test_benchmark_hits(spark):
    rng = random.Random(1)
    word = lambda: rng.choice(["a", "b", "É", "c1", "Ö"])
    items = [(i, rng.choice([" ", "-", ", "]).join(word() for _ in range(rng.choice([0, 1, 3, 5, 8])))) for i in range(12)] + [(99, None), (3, "a b")]
    rows = [(i, rng.choice([" ", "\n", "\x00!"]).join(word() for _ in range(rng.choice([0, 2, 30])))) for i in range(40)] + [(50, None), (None, "a b c1"), (1, "a")]
    patterns = brute.windows(items, 4)
    benchmark = docs(spark, items, "item_id long, text string")
    table = docs(spark, [(i, t, 1, "x") for i, t in rows], "doc_id long, text string, n_hit int, items string")
    for block_bytes in (1 << 20, 8):
        found = decontaminate.hits(table, benchmark, width=4, block_bytes=block_bytes).collect()
        got = sorted((r.doc_id if r.doc_id is not None else -1, r.n_words, r.n_hit, tuple(r["items"])) for r in found)
        assert got == sorted((i if i is not None else -1, n, h, tuple(who)) for i, t in rows for n, h, who in [brute.hits(t, patterns)])
        texts = dict(rows)
        for r in found:
            assert sum(s["last"] - s["first"] for s in r.spans) == r.n_hit
            for s in r.spans:
                assert len(brute.benchmark_words((texts[r.doc_id] if r.doc_id != 1 else "")[s["start"]:s["end"]])) == s["last"] - s["first"] or r.doc_id == 1
    assert decontaminate.hits(table, docs(spark, [], "item_id long, text string")).agg({"n_hit": "sum"}).first()[0] == 0
    assert decontaminate.hits(docs(spark, []), benchmark).count() == 0


# --- language ---------------------------------------------------------------------------------

ENGLISH, GERMAN = "the house and the garden with that", "das haus und der garten mit dem"


def labelled(spark, n=40):
    rng = random.Random(2)
    say = lambda words: " ".join(rng.choice(words.split()) for _ in range(30)) + "."
    rows = [(i, say(ENGLISH if i % 2 else GERMAN), "en" if i % 2 else "de") for i in range(n)] + [(900 + i, "дом и сад с тем", "ru") for i in range(5)]
    return docs(spark, rows + [(800, None, "en"), (801, "x", None), (None, "the house", "en")], "doc_id long, text string, lang string")


def test_languages_and_spans(spark):
    model = language_id.learn(labelled(spark))
    assert model.languages == ["de", "en", "ru"]
    mixed = ("the house and the garden with that " * 3).strip() + " " + ("das haus und der garten mit dem " * 5).strip()
    rows = [(1, "and the garden"), (2, "und der garten"), (3, None), (4, ""), (5, "12 !?"), (6, mixed), (7, "сад"), (None, "the"), (1, "and the garden")]
    found = language_id.predict(docs(spark, rows), model).collect()
    got = {r.doc_id: (r.lang_pred, round(r.score, 2)) for r in found if r.doc_id is not None}
    assert len(found) == len(rows) and got[1] == ("en", 1.0) and got[2] == ("de", 1.0) and got[7] == ("ru", 1.0)
    assert got[3] == got[4] == got[5] == ("und", 0.0) and got[6][0] == "de" and 0.5 < got[6][1] < 0.8
    spans = next(r.spans for r in found if r.doc_id == 6)
    assert [(s["lang"], mixed[s["start"]:s["end"]].split()[0]) for s in spans] == [("en", "the"), ("de", "das")]


def test_nothing_learned_and_nothing_asked(spark):
    model = language_id.learn(docs(spark, [(1, None, None)], "doc_id long, text string, lang string"))
    assert [tuple(r)[2:4] for r in language_id.predict(docs(spark, [(1, "abc")]), model).collect()] == [("und", 0.0)]
    assert language_id.predict(docs(spark, []), model).count() == 0
    rows = docs(spark, [(1, "a", "b", 2)], "doc_id long, text string, lang_pred string, row int")
    assert language_id.label_rows(rows, model).select("row.*").columns == rows.columns


@pytest.mark.parametrize("texts", [3, 40])
def test_best_paths_are_best(texts):
    import itertools

    import numpy as np
    rng = np.random.default_rng(texts)
    length = rng.integers(0, 6, texts)
    first = np.concatenate(([0], np.cumsum(length)))
    scores = rng.normal(0, 3, (first[-1], 3))
    label = language_id.label_words(scores, first, 2.0)

    def worth(path, a):
        return sum(scores[a + i, s] for i, s in enumerate(path)) - 2.0 * sum(x != y for x, y in zip(path, path[1:]))
    for a, n in zip(first, length):
        if n:
            assert worth(label[a:a + n], a) == pytest.approx(max(worth(p, a) for p in itertools.product(range(3), repeat=int(n))))


# --- secrets ----------------------------------------------------------------------------------

SECRET = 'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962"'


@pytest.mark.parametrize("wrap", [
    lambda s: s, urllib.parse.quote, lambda s: urllib.parse.quote(urllib.parse.quote(s)), lambda s: base64.b64encode(s.encode()).decode(),
    lambda s: base64.b64encode(gzip.compress(base64.b64encode(s.encode()))).decode(), lambda s: "".join(f"\\u{ord(c):04x}" for c in s),
    lambda s: "".join(f"&#{ord(c)};" for c in s), lambda s: urllib.parse.quote(base64.b64encode(s.encode()).decode())])
def test_secrets_are_found_in_layers(wrap):
    inner = wrap(SECRET)
    text = f"Anfang é {inner} Ende"
    base, spans, skipped = secret_scan.scan(text)
    assert not skipped and {0, 2} <= {k for _, k, _ in spans} and set(base) <= set(spans)
    start, end = text.index(inner), text.index(inner) + len(inner)
    assert all(start <= s < e <= end for s, _, e in spans)


def test_base_rules_and_edges(spark):
    rows = [(1, "password=abc token=secret"), (2, "api-key: x API_KEY = 'abcdef1'"), (3, "AKIA" + "A" * 15 + " AKIA" + "B" * 16), (4, "f" * 23 + "g" + "0" * 24), (5, None), (6, ""),
            (None, "secret:token:abcdef"), (1, "ſecret=abcdefg")]
    found = {(r.doc_id, i): [(s["kind"], s["start"], s["end"]) for s in r.spans] for i, r in enumerate(secret_scan.find_secrets(docs(spark, rows).coalesce(1)).collect())}
    assert list(found.values()) == [[("assign", 13, 25)], [("assign", 11, 29)], [("access", 20, 40)], [("hex", 24, 48)], [], [], [], []]
    assert secret_scan.find_secrets(docs(spark, [])).count() == 0


def test_cycles_and_bombs_end():
    text = base64.b64encode(gzip.compress(b"a" * (1 << 25))).decode()
    assert secret_scan.scan(text)[2] == 1
    deep = SECRET
    for _ in range(12):
        deep = base64.b64encode(deep.encode()).decode()
    assert secret_scan.scan(deep)[1]
    assert secret_scan.scan("%25" * 50)[1] == []


def quoted_bytes(data):
    return "".join(chr(b) if 33 <= b < 127 and chr(b) not in "\\'\"" else f"\\x{b:02x}" for b in data)


@pytest.mark.parametrize("wrap", [
    lambda s: base64.b64encode(s.encode()).decode(), lambda s: base64.b64encode(gzip.compress(s.encode())).decode(),
    lambda s: urllib.parse.quote(gzip.compress(s.encode())), lambda s: urllib.parse.quote_plus(zlib.compress(s.encode())),
    lambda s: "b'" + quoted_bytes(bz2.compress(s.encode())) + "'", lambda s: "b'" + quoted_bytes(zlib.compress(s.encode())) + "'",
    lambda s: base64.b64encode(s.encode("latin-1", "replace") + b"\xff\xfe").decode(), lambda s: base64.b64encode(gzip.compress(b"\xe9" + s.encode())).decode(),
    lambda s: base64.b64encode(gzip.compress(b"x" * 30) + gzip.compress(s.encode())).decode()])
@pytest.mark.parametrize("sign", ["\u00a0", "\u202f", "\u3000", "\u200b", "\ufeff", "\f", "\0", ""])
def test_layers_that_are_not_all_readable(wrap, sign):
    inner = wrap(f"{sign}Seite{sign} {SECRET} {sign}\n")
    text = f"Anfang data={inner} Ende"
    _, spans, skipped = secret_scan.scan(text)
    assert not skipped and {0, 2} <= {k for _, k, _ in spans}
    assert all(text.index(inner) <= s < e <= text.index(inner) + len(inner) for s, _, e in spans)


def test_large_layers_are_scanned_to_their_end(monkeypatch):
    monkeypatch.setattr(secret_scan, "MOST_UNWRAPPED", 1 << 16)
    lines = b"".join(b"line %d of many, that says nothing\n" % i for i in range(20_000))
    wrapped = base64.encodebytes(lines[:200_000] + SECRET.encode())
    for compress in (gzip.compress, bz2.compress, lzma.compress, lambda b: gzip.compress(bz2.compress(b))):
        for inside in (SECRET.encode() + b"\n" + lines, lines + SECRET.encode(), lines[:65_500] + SECRET.encode() + lines[65_500:], lines + wrapped):
            text = f"data={base64.b64encode(compress(inside)).decode()} Ende"
            assert {(s, k, e) for s, k, e in secret_scan.scan(text)[1] if k != 1} >= {(5, 0, len(text) - 5), (5, 2, len(text) - 5)}


def test_a_long_line_keeps_all_its_layers(monkeypatch):
    monkeypatch.setattr(secret_scan, "MOST_UNWRAPPED", 1 << 10)
    plain, other = SECRET, SECRET.replace("token", "secret")
    twice = urllib.parse.quote("".join(f"\\u{ord(c):04x}" for c in other))
    once = "password %3D " + urllib.parse.quote('"abcdefg"')
    text = " ".join(["word"] * 20_000 + [urllib.parse.quote(plain), twice, "&#100;", once] + ["word"] * 20_000)
    spans = secret_scan.scan(text)[1]
    for part in (urllib.parse.quote(plain), twice, once):
        at = text.index(part)
        assert any(k == 0 and at <= s < e <= at + len(part) for s, k, e in spans)


# --- pages ------------------------------------------------------------------------------------

P = "Lorem ipsum dolor sit amet, consectetur adipiscing elit, sed do eiusmod tempor incididunt ut labore et dolore magna aliqua."


@pytest.mark.parametrize("html, text", [
    (None, ""), ("", ""), ("<p></p>", ""), ("a &lt;b&gt;&nbsp;\n c", "a <b> c"),
    (f"<nav><a href=x>Home</a></nav><article><h1>T</h1><p>{P}<p>x<b>y</b>z<br>w</article><footer>f</footer>", f"T {P} xyz w"),
    (f"<div id=header>h</div><div class=sidebar><p>{P}</div><div class=content><p>{P}</p><ul><li>a<li>b</ul><p>c</p></div><div class=comments><p>{P}{P}</div>", f"{P} a b c"),
    (f"<main><form><p>{P}</p></form><section><p>{P}</section><script>var a='<p>{P}</p>'</script><style>p{{}}</style><!-- {P} --></main>", P),
    (f"<article><div class='cookie-notice'>{P}</div><p>{P}</p><aside>{P}</aside><div class=ad>buy</div></article>", P),
])
def test_main_text(html, text):
    assert html_extract.main_text(html) == text


ARTICLE = "<body><article><p>" + "A long enough, quiet sentence about stones. " * 5 + "</p>"


@pytest.mark.parametrize("end", ["", ">", "</article><p>last"])
@pytest.mark.parametrize("piece", ["<a ", '<a b="', "<a b='", "<!--", "<!", "</", "</a ", "<script>", "<style>x", "<p><button><div>", "<ul><li><b>", "<i><div><b></i>"])
def test_broken_markup_costs_its_length(piece, end):
    """A megabyte of what is never closed; the article before it stays."""
    begun = time.perf_counter()
    assert html_extract.main_text(ARTICLE + piece * (2 ** 20 // len(piece)) + end).startswith("A long enough, quiet sentence")
    assert time.perf_counter() - begun < 60


@pytest.mark.parametrize("html", ["<ul><li>" + "<b>" * 50_000 + "<li></li>" * 50_000, "<i><div>" + "<b>" * 50_000 + "</i>" * 100_000,
                                  "<p><button>" + "<div>" * 100_000, '<div class="' + "-advert_" * 100_000 + 'x">'])
def test_deep_pages_cost_their_length(html):
    begun = time.perf_counter()
    html_extract.main_text(ARTICLE + html)
    assert time.perf_counter() - begun < 60


@pytest.mark.parametrize("html, text", [
    ("<p>x <3 y < z</p>", "x <3 y < z"),
    ("<p>one<!-->two<!--->three<!-- a > b --!>four</p>", "onetwothreefour"),
    ("<p>a<?php echo ?>b<![CDATA[c]]>d</ e>f</>g</p>", "abdfg"),
    ("<P CLASS=x>a<BR/>b</P ><p>c", "a b c"),
    ("<p title='a > b'>in</p><p title=\"it's > \">out</p>", "in out"),
    ("<script>if (a </b) '<p>no</p>'</SCRIPT ><p>yes</p>", "yes"),
    ("<p>kept</p><p title=\"open>lost</p>", "kept"),
    ("<p>&amp;lt; &#8364; &nosuch; &eacute</p>", "&lt; \u20ac &nosuch; \u00e9"),
])
def test_tags_as_browsers_read_them(html, text):
    assert html_extract.main_text(html) == text


@pytest.mark.parametrize("html, text", [
    (f"<main><article>{f'<p>{P}' * 5}</article><article>{f'<p>{P}' * 2}</article></main>", " ".join([P] * 7)),
    (f"<main><h1>Title</h1><article>{f'<p>{P}' * 5}</article><p>{P}</p></main>", " ".join(["Title"] + [P] * 6)),
    (f"<main><h1>Title</h1><div><article><p>{P}<p>{P}</article></div><article><div><div><div>{f'<p>{P}' * 4}</div></div></div></article></main>", " ".join(["Title"] + [P] * 6)),
    (f"<body><h1>Title</h1><main><p>{P}<p>{P}</main><article><a href=x>{P}</a></article></body>", f"Title {P} {P}"),
])
def test_siblings_of_an_article_stay(html, text):
    assert html_extract.main_text(html) == text


def test_page_rows(spark):
    rows = [(1, None, None, 3), (None, "u", f"<p>{P}" * 2000, 1), (1, "u", "", 2)]
    found = html_extract.extract(docs(spark, rows, "page_id long, url string, html string, text int")).collect()
    assert sorted(len(r.text) for r in found) == [0, 0, 2000 * (len(P) + 1) - 1]
    assert html_extract.extract(docs(spark, [], "page_id long, url string, html string")).count() == 0


# --- urls -------------------------------------------------------------------------------------

URLS = "page_id long, url string, host int, score string"


def test_rules_and_models(spark):
    rows = [(i, f"http://a{i}.example.org/fr/{i}", 0, "") for i in range(60)] + [(100 + i, f"https://pills{i}.net/buy/{i}", 0, "") for i in range(60)]
    rows += [(1000, "http://b.example.org/en/7", 0, ""), (1001, "https://pills.com/buy/9", 0, ""), (1002, "HTTP://X.Example.NET/en/a?b", 0, ""), (1003, None, 0, ""), (1004, "no url", 0, ""),
             (1005, "http://x.net", 0, ""), (1006, "http://net/", 0, ""), (1007, "http://xnet/", 0, ""), (1008, "a://b.example.com/de/?c#d", 0, ""), (None, "http://b.example.org/en/7", 0, "")]
    found = {r.page_id: r for r in url_filter.judge(docs(spark, rows, URLS)).collect()}
    assert len(found) == len(rows)
    assert found[1000].verdict == "allow" and found[1001].verdict == "block" and found[1000].rule is None and found[None].verdict == "allow"
    assert (found[1002].host, found[1002].path, found[1002].rule, found[1002].verdict) == ("x.example.net", "/en/a", "example.net/en/", "allow")
    assert (found[1003].host, found[1003].path, found[1003].rule) == ("", "", None) == (found[1004].host, found[1004].path, found[1004].rule)
    assert found[1005].rule is None and found[1006].rule == "net/" and found[1007].rule is None and found[1008].rule == "example.com/de/"


def test_no_rules_and_no_pages(spark):
    assert [r.verdict for r in url_filter.judge(docs(spark, [(1, "http://a/", 0, "")], URLS)).collect()] == ["allow"]
    assert url_filter.judge(docs(spark, [], URLS)).count() == 0


def test_ratios_are_interpolated_counts(spark):
    """Witten-Bell by hand, one level up from single characters."""
    import math
    grams = [("ab", 3, 1), ("ac", 1, 0), ("bb", 0, 2), ("cb", 0, 0)]
    found = {r.gram: r.ratio for r in url_filter.ratios(docs(spark, grams, "gram string, yes long, no long"), order=1).collect()}

    def p(side, gram):
        one = {}
        for g, *n in grams:
            one[g[1]] = one.get(g[1], 0) + n[side]
        low = (one[gram[1]] + 1) / (sum(one.values()) + len(one) + 1)
        after = [n[side] for g, *n in grams if g[0] == gram[0]]
        total, kinds = sum(after), sum(x > 0 for x in after)
        mine = next(n[side] for g, *n in grams if g == gram)
        return (mine + kinds * low) / (total + kinds) if total + kinds else low
    assert found == pytest.approx({g: math.log(p(0, g)) - math.log(p(1, g)) for g, *_ in grams})


# --- fingerprints -----------------------------------------------------------------------------

def test_edits_and_likeness(spark):
    rng = random.Random(4)
    say = lambda n: " ".join(rng.choice(["the", "of", "und", *[f"wort{i}" for i in range(50)]]) for _ in range(n))
    rows = [(10, say(300)), (7, say(5)), (3, None), (25, ""), (30, "!!!"), (31, say(2000)), (40, say(30)), (41, "x")]
    rows += [(42, rows[0][1])]
    found = {r.id: r for r in spot_signatures.with_edits(docs(spark, rows)).collect()}
    ids = sorted(i for i, _ in rows)
    texts = {i: t or "" for i, t in rows}
    for i, following in zip(ids, ids[1:] + ids[:1]):
        k = len(texts[i]) // 4
        assert found[i].edited == texts[i][:len(texts[i]) - k] + texts[following][:k]
        assert sorted(found[i].next_signs) == sorted(found[following].signs)
    assert found[10].signs == found[42].signs and found[3].signs == [] and len(found[30].signs) == 1
    again = spot_signatures.with_edits(docs(spark, [*rows, (10, "another"), (None, "abcd" * 3)])).collect()
    assert len(again) == len(rows) + 2 and next(r.edited for r in again if r.id is None) == "abcdabcda"
    assert spot_signatures.with_edits(docs(spark, [])).count() == 0 and spot_signatures.with_edits(docs(spark, [(1, "abcdefgh")])).first().edited == "abcdefab"


def test_near_duplicates_are_those_of_all_pairs(spark):
    rng = random.Random(5)
    rows = []
    for g in range(8):
        base = [rng.choice(["the", "of", *[f"w{g}x{i}" for i in range(30)]]) for _ in range(120)]
        for k in range(4):
            text = list(base)
            for _ in range(k):
                text[rng.randrange(len(text))] = f"new{rng.randrange(99)}"
            rows.append((len(rows), " ".join(text)))
    table = docs(spark, rows)
    signs = {r[0]: set(r[1]) for r in table.select("doc_id", spot_signatures.signatures(table.text)).collect()}
    signs = {min(i for i, s in signs.items() if s == t): t for t in signs.values()}
    want = {(a, b) for a in signs for b in signs if a < b and signs[a] != signs[b] and len(signs[a] & signs[b]) >= 0.8 * len(signs[a] | signs[b])}
    assert {(r.x, r.y) for r in spot_signatures.near_duplicates(table).collect()} == want and want


# --- resampling -------------------------------------------------------------------------------

def test_resampling_prefers_what_reads_like_the_target(spark):
    rng = random.Random(6)
    say = lambda words, n=40: " ".join(rng.choice(words.split()) for _ in range(n))
    rows = [(i, say(ENGLISH)) for i in range(60)] + [(100 + i, say("buy $$$ cheap pills ### now")) for i in range(60)] + [(200, None), (201, ""), (5, say(ENGLISH))]
    picked = importance_sample.sample(docs(spark, rows), docs(spark, [(i,) for i in range(30)], "doc_id long"), 61)
    got = [r.doc_id for r in picked.collect()]
    assert len(got) == 61 and sum(i < 100 for i in got) == 61
    even = importance_sample.sample(docs(spark, rows), docs(spark, [], "doc_id long"), 10)
    assert even.count() == 10 and importance_sample.sample(docs(spark, []), docs(spark, [], "doc_id long"), 0).count() == 0


def test_largest_is_exact_with_ties(spark):
    rng = random.Random(7)
    values = [(i, rng.choice([1.5, -2.0, 1e9, rng.uniform(-5, 5)])) for i in range(500)] + [(900, None), (901, float("nan"))]
    table = docs(spark, values, "doc_id long, v double")
    for k in (1, 37, 250, 502, 600):
        got = sorted(r.v if r.v is not None and r.v == r.v else -1e99 for r in importance_sample.largest(table, "v", k).collect())
        want = sorted((v if v is not None and v == v else -1e99 for _, v in values), reverse=True)[:k]
        assert got == pytest.approx(sorted(want), abs=2e-6)


def test_hashes_are_those_of_the_words_whatever_surrounds_them():
    import numpy as np
    import pyarrow as pa

    from ledgerloom.llm import common
    texts = [b"Alpha beta", b"", None, b"beta  ALPHA\n", "é beta".encode(), b"x" * 5000]
    space = np.zeros(256, dtype=bool)
    space[[32, 10]] = True
    seen = {}
    for size in (1, 20, 1 << 20):
        words = []
        for _, data, offsets in common.blocks(pa.array(texts, pa.binary()), size):
            starts, ends, first = common.word_bounds(data, offsets, space)
            hashes = common.word_hashes(data, starts, ends, common.byte_values())
            words += [(bytes(data[a:b]).lower(), int(h)) for a, b, h in zip(starts, ends, hashes)]
        assert [w for w, _ in words] == [b"alpha", b"beta", b"beta", b"alpha", "é".encode(), b"beta", b"x" * 5000]
        for w, h in words:
            assert seen.setdefault(w, h) == h
    assert len(set(seen.values())) == len(seen)
    assert hashlib.sha256(b"").hexdigest()  # the digest of no spans
