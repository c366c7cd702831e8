import os
import random

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from ledgerloom.llm import common, packing  # noqa: E402

from . import brute  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, score int"
SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(8)
    say = lambda words, n: " ".join(rng.choice(words) for _ in range(n))
    english, german = [f"the{a}ing" for a in "abcdefgh"], [f"ge{a}ung" for a in "äöübcdfg"]
    rows = []
    for i in range(60):
        words, lang = (english, "en") if i % 3 else (german, "de")
        rows.append([i, f"{say(words, 50)}\nAll rights reserved", lang, f"s{i % 14}"])
    rows += [[100, rows[1][1], "en", "s1"], [101, rows[1][1] + " more", "en", "s2"], [102, "12 !", "en", "s1"], [103, None, None, None], [104, "", "en", "s3"],
             [105, "All rights reserved", "en", "s3"], [106, say(english, 50) + "\n" + say(["benchthe", "quiz"], 12), "en", "s4"], [107, rows[4][1], "en", "s5"], [107, rows[4][1], "en", "s5"]]
    docs = [(i, t, lang, s, len(t) if t else None, "r", 1) for i, t, lang, s in rows]
    items = [(1, next(r[1] for r in rows if r[0] == 106).split("\n")[-1]), (2, None)]
    folder = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame(docs, SCHEMA).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, docs, items


def test_every_stage_against_plain_versions(spark, corpus):
    folder, _, items = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    kept = {}
    for name, f in corpus_pipeline.STAGES[:-1]:
        before = docs.collect()
        docs = corpus_pipeline.stage(f(spark, docs, folder), name)
        after = docs.collect()
        assert docs.columns == columns
        kept[name] = before, after
    ids = lambda rows: sorted(r.doc_id for r in rows)
    before, after = kept["language_id"]
    assert ids(before) == sorted(ids(after) + [102, 103, 104])
    before, after = kept["line_dedup"]
    assert set(ids(before)) - set(ids(after)) == {105}
    assert sum("All rights reserved" in r.text.split("\n") for r in after) == 1 and all(r.n_chars == len(r.text) for r in after)
    before, after = kept["ngram_jaccard_join"]
    root = brute.components([(r.doc_id, r.text) for r in before])
    assert ids(after) == sorted(i for i in set(ids(before)) if root[i] == i) and 107 not in ids(after)
    before, after = kept["benchmark_decontamination"]
    patterns = brute.windows(items)
    assert ids(after) == sorted(r.doc_id for r in before if not brute.hits(r.text, patterns)[1]) and set(ids(before)) - set(ids(after)) == {106}
    packed = corpus_pipeline.run(spark, folder).collect()
    assert {r.doc_id for r in packed} == set(ids(after))
    want = {(r.doc_id, r.length, r.ids_crc32) for r in packing.pieces(docs).collect()}
    assert {(r.doc_id, r.length, r.ids_crc32) for r in packed} == want


def test_an_empty_corpus(spark, corpus, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables")
def test_registered_queries_have_the_contract_columns(spark):
    import __spark_entry__ as entry
    queries = entry.queries()
    columns = {
        "op1_": "doc_id held_out lang_pred score", "op2_": "doc_id n_assign n_access n_hex base_sha256 spans", "op3_": "doc_id text", "op4_": "doc_id",
        "op5_": "page_id host path rule verdict", "op6_": "doc_id n_chars edited_sha256 fingerprint edited_fingerprint near_edited near_next",
        "op7_": "doc_id n_words n_hit n_items items_sha256 contaminated", "op8_": "page_id url text n_chars",
        "op9_": "doc_id piece start length ids_crc32 sequence_id offset", "op10_": "doc_id n_shingles component_id"}
    for prefix, wanted in columns.items():
        name, = [q for q in queries if q.startswith(prefix)]
        out = queries[name](spark, SMALL)
        assert set(wanted.split()) <= set(out.columns), name
        assert out.count() > 0, name
    assert queries["pipeline"] is corpus_pipeline.run


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables")
def test_held_out_accuracy(spark):
    import __spark_entry__ as entry
    out = entry.queries()["op1_language_id"](spark, SMALL)
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "lang")
    rows = out.where("held_out").join(docs, "doc_id").selectExpr("avg(double(lang = lang_pred)) AS share", "count(*) AS n").first()
    assert rows.n > 30 and rows.share > 0.95


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables")
def test_line_query_equals_its_sql(spark):
    import duckdb

    import __spark_entry__ as entry
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SMALL}/documents.parquet'")
    want = sorted(con.execute(f"SELECT doc_id, text, n_lines, n_removed FROM ({entry.oracle_sql()['op3_line_dedup']})").fetchall())
    assert sorted(tuple(r) for r in entry.queries()["op3_line_dedup"](spark, SMALL).select("doc_id", "text", "n_lines", "n_removed").collect()) == want


def test_kept_ids_are_not_broadcast_beyond_the_bound(spark, monkeypatch):
    monkeypatch.setattr(common, "BROADCAST_ROWS", 20)
    rows = [(i, " ".join(f"w{i}x{j}" for j in range(9)), "en", "s", 1, "r", 1) for i in [*range(30), 7, 7]] + [(None, "a b c d e f", "en", "s", 1, "r", 1)]
    kept = corpus_pipeline.drop_near_duplicates(spark, spark.createDataFrame(rows, SCHEMA), "")
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == list(range(30)) and kept.where("doc_id is null").count() == 1
