import random
import re
from fractions import Fraction

import pytest

import corpus_pipeline
from ledgerloom.llm import jaccard_join as J
from ledgerloom.llm import common, line_dedup, packing

from . import brute

DOCS = "doc_id long, text string, lang string, source string, n_chars long, n int, rest string, key string"


def docs(spark, rows, schema="doc_id long, text string"):
    return spark.createDataFrame(rows, schema)


def near_copies(seed, groups=6, size=9, words=60):
    """Groups of texts with a few words changed, sharing a passage and a line."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcde") for _ in range(3))
    passage = [word() for _ in range(20)]
    rows, n = [], 0
    for _ in range(groups):
        base = [word() for _ in range(rng.randrange(4, words))]
        for _ in range(rng.randrange(1, size)):
            text = list(base)
            for _ in range(rng.randrange(0, 4)):
                text[rng.randrange(len(text))] = word()
            if rng.random() < 0.4:
                text += passage
            rows.append((n, rng.choice([" ", "\n", "\t "]).join(text)))
            n += 1
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed, frequent, long_list, block, threshold", [
    (1, 200, 64, 1 << 18, Fraction(4, 5)), (2, 2, 64, 1 << 18, Fraction(4, 5)), (3, 2, 2, 60, Fraction(4, 5)), (4, 1, 3, 200, Fraction(1, 2)), (5, 3, 2, 50, Fraction(9, 10))])
def test_components_are_those_of_all_pairs(spark, monkeypatch, seed, frequent, long_list, block, threshold):
    monkeypatch.setattr(J, "LONG_LIST", long_list)
    monkeypatch.setattr(J, "BLOCK", block)
    rows = near_copies(seed)
    found = J.similar_components(docs(spark, rows).repartition(5), threshold=threshold, least_frequent=frequent).collect()
    want = brute.components(rows, threshold.numerator, threshold.denominator)
    assert {r.id: r.component_id for r in found} == want
    assert {r.id: r.n_shingles for r in found} == {i: len(brute.shingles(t)) for i, t in rows}


def test_one_large_group_and_a_text_that_links_two(spark, monkeypatch):
    monkeypatch.setattr(J, "LONG_LIST", 8)
    base = [f"w{i}" for i in range(100)]
    rows = [(i, " ".join(base[:i % 37] + [f"x{i}"] + base[i % 37 + 1:])) for i in range(60)] + [(100 + i, " ".join(base)) for i in range(30)]
    rows += [(200, " ".join(f"v{i}" for i in range(100))), (201, None), (202, ""), (203, "  \n"), (204, "one two"), (205, "ONE\ttwo")]
    found = {r.id: r.component_id for r in J.similar_components(docs(spark, rows)).collect()}
    assert found == brute.components(rows)


def test_nulls_repeats_and_other_columns(spark):
    text = " ".join(f"w{i}" for i in range(30))
    rows = [(1, text, None, None, None, 1, "r", "k"), (1, text, None, None, None, 1, "r", "k"), (2, text.upper(), "x", "y", 5, 2, "r", "k"),
            (3, None, None, None, None, None, None, None), (None, text, None, None, None, None, None, None), (4, text + " more words here now", None, None, 1, 1, "", "")]
    found = sorted((r.id or 0, r.n_shingles, r.component_id or 0) for r in J.similar_components(docs(spark, rows, DOCS)).collect())
    assert found == [(0, 26, 0), (1, 26, 1), (1, 26, 1), (2, 26, 1), (3, 0, 3), (4, 30, 1)]
    assert J.similar_components(docs(spark, [], DOCS)).count() == 0


def test_rows_of_one_id_are_one_vertex(spark):
    a, b = " ".join(f"a{i}" for i in range(20)), " ".join(f"b{i}" for i in range(20))
    rows = [(5, a), (5, b), (7, a), (9, b), (6, "z")]
    assert {r.id: r.component_id for r in J.similar_components(docs(spark, rows)).collect()} == {5: 5, 7: 5, 9: 5, 6: 6}


def test_an_id_of_many_texts_links_them_all(spark):
    texts = [" ".join(f"{c}{i}" for i in range(20)) for c in "abcd"]
    rows = [(i + 1, t) for i, t in enumerate(texts)] + [(9, t) for t in texts]
    assert {(r.id, r.component_id) for r in J.similar_components(docs(spark, rows)).collect()} == {(i, 1) for i in (1, 2, 3, 4, 9)}


@pytest.mark.parametrize("seed, marks, rows_sent", [(1, 1 << 25, 0), (3, 64, 0), (4, 64, 1 << 16)])
def test_components_with_crowded_marks_and_sorted_joins(spark, monkeypatch, seed, marks, rows_sent):
    monkeypatch.setattr(J, "LONG_LIST", 3)
    monkeypatch.setattr(J, "MARKS", marks)
    monkeypatch.setattr(common, "BROADCAST_ROWS", rows_sent)
    rows = near_copies(seed)
    found = J.similar_components(docs(spark, rows), least_frequent=2).collect()
    assert {r.id: r.component_id for r in found} == brute.components(rows)


def test_what_is_broadcast_does_not_grow_with_the_documents(spark, monkeypatch):
    monkeypatch.setattr(common, "BROADCAST_ROWS", 50)
    source = spark.range(400).selectExpr("id", "cast(concat_ws(' ', 'a b c d e', id % 7) as binary) as text")
    pairs = common.stage(spark.range(200).selectExpr("id as x", "id + 200 as y"), "pairs")
    compared = J._compared(source, pairs, 5, 1 << 64)
    plan = compared._jdf.queryExecution().executedPlan().toString()
    sent = [plan[at:].split("Scan parquet", 1)[1].split("\n", 1)[0] for at in (m.start() for m in re.finditer("BroadcastExchange", plan))]
    assert sent and all("bitmap" in s for s in sent)  # none of the ids, none of the pairs
    want = {(x, x + 200): (1 if x % 7 != (x + 200) % 7 else 2) for x in range(200)}
    assert {(r.x, r.y): r.shared for r in compared.collect()} == want


# --- lines ------------------------------------------------------------------------------------

def test_boilerplate_lines(spark):
    rows = [(i, f"Own line {i}\n  ALL rights reserved. \n\nshared by two {i // 2}", f"s{i % 5}") for i in range(20)]
    rows += [(100, None, "s1"), (101, "", "s1"), (102, "all rights reserved.", None), (103, "few sites", "s1"), (104, "few sites", "s2"), (105, "\tfew sites", "s1")]
    found = line_dedup.remove_boilerplate(docs(spark, rows, "doc_id long, text string, source string"), min_sites=5).collect()
    got = {r.doc_id: (r.text, r.n_lines, r.n_removed) for r in found}
    assert got[0] == (rows[0][1], 4, 0)
    assert all(got[i] == (f"Own line {i}\n\nshared by two {i // 2}", 4, 1) for i in range(1, 20))
    assert got[100] == (None, 0, 0) and got[101] == ("", 1, 0) and got[102] == ("", 1, 1)
    assert all(got[i][2] == 0 for i in (103, 104, 105))


def test_line_counts_near_the_threshold_are_exact(spark):
    rows = [(s * 1000 + k, f"on {k} sites", f"site{s}") for k in range(1, 30) for s in range(k)]
    found = line_dedup.remove_boilerplate(docs(spark, rows, "doc_id long, text string, source string"), min_sites=15, precision=4).collect()
    assert {r.doc_id % 1000 for r in found if r.n_removed} == set(range(15, 30))


def test_a_passage_needs_fewer_sites_than_a_short_line(spark):
    passage, short, four = (" ".join(f"{w}{i}" for i in range(n)) for w, n in (("p", 20), ("s", 19), ("f", 30)))
    sites = ["hot"] * 11 + ["s1", "s2", "s3", "s4"]
    rows = [(i, f"own {i}\n{passage}\n{short}" + ("" if site == "s4" else f"\n{four}"), site) for i, site in enumerate(sites)]
    rows += [(100 + i, f"filler {i}", "hot" if i % 3 == 0 else f"s{i % 20}") for i in range(60)]
    table = docs(spark, rows, "doc_id long, text string, source string")
    got = {r.doc_id: r.text for r in corpus_pipeline.remove_lines(spark, table, "").collect()}
    assert got[0] == rows[0][1]
    assert all(got[i] == rows[i][1].replace(f"\n{passage}", "") for i in range(1, 15))
    assert all(got[i] == t for i, t, _ in rows[15:])
    assert sum(r.n_removed for r in line_dedup.remove_boilerplate(table).collect()) == 0


def test_line_columns_clash_and_repeat(spark):
    schema = "doc_id long, text string, source string, n_lines int, gone string, id long, row string, a int, site string"
    rows = [(1, "x\ny", f"s{i}", 7, "g", 3, "r", 1, "t") for i in range(6)] + [(None, "x", "s9", 1, "", 1, "", 1, "")]
    out = line_dedup.remove_boilerplate(docs(spark, rows, schema), min_sites=3)
    assert out.columns == [*[f.split()[0] for f in schema.split(", ")], "n_lines_", "n_removed"]
    assert sorted((r.doc_id or 0, r.text, r.n_lines, r.n_lines_, r.n_removed) for r in out.collect()) == [(0, "x", 1, 1, 0)] + [(1, "y", 7, 2, 1)] * 6
    assert line_dedup.remove_boilerplate(docs(spark, [], schema)).count() == 0


# --- packing ----------------------------------------------------------------------------------

@pytest.fixture(scope="module")
def tokenizer():
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer
    return Tokenizer.from_file(public.path("word_bpe_49k.json"))


TEXTS = ["", None, "Hello, world. It's 3.14, isn't it?", "Straße ÄÖ, É.  x", "a" * 500, "I\u0307. \u0130, x", "tab\tand\nline ...,, . _, !. 中文, 가", "\x1c, \x0b.",
         "<|endoftext|> <|ENDOFTEXT|>, x", " ".join(f"word{i}" for i in range(9000))]


def test_pieces_are_the_tokenizers_ids(spark, tokenizer):
    import zlib

    import numpy as np
    rows = list(enumerate(TEXTS)) + [(3, TEXTS[3]), (None, "no id")]
    found = packing.pieces(docs(spark, rows), limit=100).collect()
    got = {}
    for r in found:
        got.setdefault((r.doc_id, r.piece), []).append((r.start, r.length, r.ids_crc32))
    for i, t in rows:
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [1]
        for k in range(0, len(ids), 100):
            part = ids[k:k + 100]
            assert (k, len(part), zlib.crc32(np.array(part, dtype="<u4").tobytes())) in got[i, k // 100], (t, k)
    assert len(found) == sum(-(-(len(tokenizer.encode(t or "", add_special_tokens=False).ids) + 1) // 100) for _, t in rows)


def test_ids_of_words_are_the_tokenizers(tokenizer):
    """Signs, contractions, control characters and letters of every kind, in words of all forms."""
    import numpy as np
    import public_tokenizers
    rng = random.Random(9)
    signs = list("aAbBzZ'stredvlm.,!?#$%&*<|>=\"09 \t\n éÉßøÿĀāĭįĺİıſǺªº²½×÷Σσ漢\xa0\xad\u0300\u0307\u200d\u2126\x00\x1f\x7f\x85🙂")
    texts = ["".join(rng.choice(signs) if rng.random() < 0.9 else rng.choice(["<|endoftext|>", "<|", "'re", "don't", "I'VE"]) for _ in range(rng.randrange(15)))
             for _ in range(20_000)]
    texts += [f"x{c}y {c} {c}{c}.a" for c in map(chr, range(0x3000))]
    encoder = packing.WordEncoder(public_tokenizers.path("word_bpe_49k.json"))
    for text, ids in zip(texts, encoder.encode(texts)):
        assert ids == np.array(tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes(), ascii(text)


@pytest.mark.parametrize("block", [10_000, 40])
def test_packing_is_gapless_and_tight(spark, block):
    rng = random.Random(block)
    rows = [(i, i // 2, 0, 0, rng.choice([rng.randrange(1, 100), 100, 34, 33]), i) for i in range(600)]
    cut = docs(spark, rows, packing.PIECES)
    out = packing.pack(cut, limit=100, block=block).collect()
    assert sorted((r.doc_id, r.length, r.ids_crc32) for r in out) == sorted((r[1], r[4], r[5]) for r in rows)
    sequences = {}
    for r in out:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 100
    least = -(-sum(r[4] for r in rows) // 100)
    assert len(sequences) <= 1.06 * least


def test_nothing_to_pack(spark):
    assert packing.pack(docs(spark, [], packing.PIECES)).count() == 0


def test_genetic_steps_improve_a_poor_packing():
    import numpy as np
    rng = np.random.default_rng(3)
    lengths = np.sort(np.concatenate([rng.integers(20, 40, 300), 100 - rng.integers(20, 40, 300)]))[::-1]
    alone = np.arange(len(lengths))
    best = packing.evolve(lengths, [alone, alone[::-1].copy()], 100, 4, 6, rng)
    fill = np.bincount(best, weights=lengths)
    assert fill.max() <= 100 and len(fill) < 0.7 * len(lengths)
