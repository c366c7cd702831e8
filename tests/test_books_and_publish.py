import pytest
from pyspark.sql import functions as F

from ledgerloom.functions.containment import candidate_pairs, containing_pairs
from ledgerloom.functions.sizing import fits
from ledgerloom.functions.staging import settle
from ledgerloom.functions.text import nan_to_null, utf8_audit
from ledgerloom.operators import accounts as acc
from ledgerloom.operators import ledger as booking
from ledgerloom.operators import profile, reconcile
from ledgerloom.plans import pipeline, publish
from ledgerloom.sources import books
from ledgerloom.sources import journal as journal_source

ACCOUNTS = [("1000", "资产", 1, None), ("1100", "银行存款", 2, "1000"), ("2301", "应付OL押金", 1, None), ("4000", "收入", 1, None), ("4300", "收入OL", 2, "4000")]


def test_recon_by_id(spark):
    schema = "account string, cr double, dr double, net double"
    ours = spark.createDataFrame([("1", 10.0, 0.0, 10.0), ("2", 5.0, 5.0, 0.0), ("3", 1.0, 0.0, 1.0)], schema)
    theirs = spark.createDataFrame([("1", 10.005, 0.0, 10.0), ("2", 7.0, 5.0, 2.0), ("4", 1.0, 1.0, 0.0)], schema)
    got = sorted((r.account, r.field, r.diff) for r in reconcile.by_id(ours, theirs).collect())
    assert got == [("2", "cr", -2.0), ("2", "net", -2.0), ("3", "all", None), ("4", "all", None)]


def test_recon_by_name_alias_order(spark):
    ours = spark.createDataFrame([("组委工资", -10.0), ("投资收入", 3.0), ("其他", 1.0)], "account string, net double")
    theirs = spark.createDataFrame([("讲师组委工资", -10.0), ("投资收益", 4.0), ("投资收入", 5.0), ("备注", 9.0), ("新", 2.0), ("零", 0.0)], "account string, net double")
    got = sorted((r.account, r.ours, r.reference) for r in reconcile.by_name(ours, theirs).collect())
    # The group of 投资收益 comes first, so its own label is tried before 投资收入.
    # Both labels count as covered by our 投资收入.
    assert got == sorted([("投资收入", 3.0, 4.0), ("其他", 1.0, None), ("新", None, 2.0)])


def test_book_headers():
    found = books.find_book_columns(["ord", "Account Code", "CR", "Debit amount", "余额"], order="ord")
    assert found == {"account": "Account Code", "cr": "CR", "dr": "Debit amount", "net": "余额"}
    assert books.find_book_columns(["a", "b", "c"], {"account": 1, "cr": "c", "dr": 9})["account"] == "b"
    assert books.find_book_columns(["x", "y"])["account"] == "x"
    assert books.period_column(["cat", "2022", "2023", "2024Q1"], "2024Q1", "cat") == "2024Q1"
    assert books.period_column(["cat", "a", "b", "c", "d"], "2024Q1", "cat") == "c"


def test_quarter_number(spark):
    df = spark.createDataFrame([("2020Q1",), ("2021Q2-3",), ("2022Q4",)], "p string")
    assert [r[0] for r in df.select(books.quarter_number(F.col("p"))).collect()] == [1, None, 4]


def test_legacy_codes(make, spark):
    labels = spark.createDataFrame([("1100",), ("银行存款",), ("收入OL线上",), ("存款",), ("OL收入4301",), ("zzz",)], "old_code string")
    got = {r.old_code: (r.code, r.match_rank) for r in acc.map_legacy_codes(labels, make.accounts(*ACCOUNTS)).collect()}
    assert got == {"1100": ("1100", 1), "银行存款": ("1100", 2), "收入OL线上": ("4000", 3), "存款": ("1100", 3), "OL收入4301": ("4000", 3), "zzz": ("zzz", 5)}


@pytest.mark.parametrize("limit", [1000, 0])
def test_containment_is_complete(spark, limit):
    texts = ["abcabc", "a", "", "xyz", "日本語テキスト", "bca"]
    needles = ["a", "ab", "bca", "cab", "日本", "語テキ", "q", "abcabcd"]
    t = spark.createDataFrame(list(enumerate(texts)), "k int, text string")
    n = spark.createDataFrame([(x,) for x in needles], "needle string")
    got = {(r.k, r.needle) for r in containing_pairs(t, "k", "text", n, "needle", limit).collect()}
    assert got == {(i, x) for i, s in enumerate(texts) for x in needles if x in s}


def test_a_piece_of_all_texts_makes_no_candidates(spark):
    texts = [f"transfer {i:04d} of the house {'wallet' if i % 50 == 0 else ''}" for i in range(400)]
    needles = ["transfer 0007", "house wallet", "the house", "transfer of", "r 00", "日本"]
    t = spark.createDataFrame(list(enumerate(texts)), "k int, text string")
    n = spark.createDataFrame([(x,) for x in needles], "needle string")
    want = {(i, x) for i, s in enumerate(texts) for x in needles if x in s}
    found = candidate_pairs(t, "k", "text", n, "needle", hot=40).collect()
    per_needle = {x: sum(r.needle == x for r in found) for x in needles}
    assert {(r.k, r.needle) for r in found} >= want and len(found) <= 1.2 * len(want)
    assert per_needle["transfer 0007"] <= 40 and per_needle["transfer of"] == per_needle["日本"] == 0
    pairs = containing_pairs(t, "k", "text", n, "needle", hot=40)
    assert {(r.k, r.needle) for r in pairs.collect()} == want
    assert "NestedLoop" not in pairs._jdf.queryExecution().executedPlan().toString()


def test_needles_of_every_length(spark):
    import random
    rng = random.Random(2)
    texts = ["".join(rng.choice("abé") for _ in range(rng.randrange(0, 60))) for _ in range(40)] + [None, "ab" * 40]
    needles = sorted({"".join(rng.choice("abé") for _ in range(n)) for n in range(1, 30) for _ in range(3)} | {t[3:3 + n] for t in texts if t for n in range(1, 26)} - {""})
    t = spark.createDataFrame(list(enumerate(texts)), "k int, text string")
    n = spark.createDataFrame([(x,) for x in needles] + [(None,), ("",)], "needle string")
    for hot in (0, 3):
        got = {(r.k, r.needle) for r in containing_pairs(t, "k", "text", n, "needle", hot).collect()}
        assert got == {(i, x) for i, s in enumerate(texts) if s for x in needles if x in s}


def test_fits_and_settle(spark):
    df = spark.range(100).withColumn("s", F.repeat(F.lit("x"), 100))
    assert fits(df) and not fits(df, max_rows=99) and not fits(df, max_bytes=1000)
    out = settle(df, "t")
    assert out.count() == 100 and "FileScan" in out._jdf.queryExecution().toString()


def test_utf8_and_nan(spark):
    df = spark.createDataFrame([(1, "中文é"), (2, None)], "id int, s string")
    row = utf8_audit(df, "id", ["s"]).first()
    assert (row.is_valid, row.n_bytes, row.n_chars, row.round_trip) == (True, 8, 3, "中文é")
    broken = spark.range(1).selectExpr("1 AS id", "CAST(X'61ff62' AS STRING) AS s")
    row = utf8_audit(broken, "id", ["s"]).first()
    assert row.is_valid is False and row.round_trip == "a�b"
    assert nan_to_null(spark.createDataFrame([(float("nan"), 1)], "a double, b int")).first().a is None


def test_unmatched_profile(make):
    rows = make.journal(*[(f"J{i}", "x", 1, "2024-01-01") for i in range(7)], ("K", " ", 1, "2024-01-01"))
    got = {r.old_type: (r["count"], r.sample_ids) for r in profile.unmatched_profile(rows).collect()}
    assert got == {"x": (7, "J0, J1, J2, J3, J4 ..."), "(blank)": (1, "K")}


def books_of(make):
    rules = make.rules(
        ("R-1", 'old_type == "OL"', "收入OL", 10, "CR", "OL"), ("R-2", 'old_type == "OL"', "银行存款", 10, "DR", "OL"),
        ("R-3", 'old_type == "OL" and "alipay" in description', "收入OL", 20, "CR", "OL"), ("R-4", "year =", "收入OL", 20, "CR", "OL"))
    journal = make.journal(("A-1", "OL", 500, "2024-01-05"), ("A-2", "OL", -50, "2023-02-05"), ("B-3", "Odd", 5, "2024-01-01"), ("I-4", "OL", 0, "2024-01-01"),
                           ("A-5", "__MISSING_TYPE__", 7, "2024-05-01", "alipay pay"))
    return journal, rules, make.accounts(*ACCOUNTS)


def test_run(make, spark, tmp_path):
    journal, rules, accounts = books_of(make)
    out = pipeline.run(journal, rules, accounts, str(tmp_path / "out"), F.lit("2030-01-01").cast("timestamp"), run_arguments={"user": "u"})
    assert {k: out["statistics"][k] for k in ("journal_entries", "journal_entries_skipped", "ledger_entries", "unmatched_entries", "rules_applied")} == {
        "journal_entries": 4, "journal_entries_skipped": 1, "ledger_entries": 5, "unmatched_entries": 2, "rules_applied": 4}
    detail = spark.read.parquet(out["paths"]["categorization"])
    assert detail.count() == 5 and {r.year for r in detail.select("year").collect()} == {2023, 2024}
    assert "65%" in spark.read.parquet(out["paths"]["entries"]).filter("entry_id = 'A-5'").first().notes
    yearly = spark.read.parquet(out["paths"]["account_summary_by_year"])
    assert yearly.filter("row_kind = 'TOTAL'").first().entry_count == 5
    assert {r.account for r in books.published_by_id(yearly, 2024).collect()} == {"1100", "4300", "2301"}
    assert spark.read.parquet(out["paths"]["audit_metadata"]).first().user == "u"


def test_report_sets(make, spark, tmp_path):
    journal, rules, accounts = books_of(make)
    booked = pipeline.booked(journal, rules, accounts)
    ledger = booking.ledger(booked)
    paths = publish.quarterly_report_set(ledger, accounts, str(tmp_path / "q"))
    assert spark.read.parquet(paths["quarterly_totals"]).filter("row_kind = 'TOTAL'").count() == 2
    paths = publish.review_set(booked, ledger, None, accounts, str(tmp_path / "r"))
    assert spark.read.parquet(paths["comparison"]).count() == 7
    paths = publish.audit_export(booked, str(tmp_path / "a"), {"user": "u", "timestamp": "t"})
    assert spark.read.option("header", True).csv(paths["lineage_csv"]).filter("user = 'u'").count() == 9
    nested = spark.read.json(paths["records_json"])
    assert nested.select(F.sum(F.size("generated_entries"))).first()[0] == 9 and nested.select(F.sum(F.size("applied_rules"))).first()[0] == 4


def test_error_report(make, spark, tmp_path):
    from ledgerloom.operators import issue_tables as issues
    from ledgerloom.operators import quality_input as qi
    journal, rules, accounts = books_of(make)
    found = qi.validate_inputs(journal, rules, accounts, F.lit("2030-01-01").cast("timestamp"))
    detected = issues.detect(found)
    paths = publish.error_report_set(detected, issues.warnings(found), journal, str(tmp_path / "e"), booked=pipeline.booked(journal, rules, accounts))
    assert spark.read.parquet(paths["summary"]).first().total_errors == detected.count() == 3
    assert spark.read.parquet(paths["validation"]).first().overall_status == "fail"


def test_sheets_run(make, spark, tmp_path):
    journal, rules, accounts = books_of(make)
    with pytest.raises(journal_source.YearMismatch):
        pipeline.run_sheets(journal.withColumn("sheet", F.lit("2024")), rules, accounts, str(tmp_path / "s0"))
    summary = {r.sheet: (r.journal_entries, r.ledger_entries, r.unmatched_entries) for r in pipeline.run_sheets(journal, rules, accounts, str(tmp_path / "s1")).collect()}
    assert summary == {"2023": (1, 2, 0), "2024": (3, 3, 2)}
    assert spark.read.parquet(str(tmp_path / "s1/ledger")).filter("sheet = 2024").count() == 3


def test_published_set(make, spark, tmp_path):
    rows, directory = make.accounts(*ACCOUNTS), str(tmp_path / "set")
    assert publish.published(spark, directory) == {}
    first = publish.publish_set(spark, directory, lambda f: publish.write_tables({"a": rows, "b": rows}, f))

    def broken(folder):
        publish.write_table(rows.limit(1), f"{folder}/a")
        raise InterruptedError

    with pytest.raises(InterruptedError):
        publish.publish_set(spark, directory, broken)
    assert publish.published(spark, directory) == first and spark.read.parquet(first["a"]).count() == 5
    second = publish.publish_set(spark, directory, lambda f: publish.write_tables({"a": rows.limit(2)}, f))
    assert publish.published(spark, directory) == second and spark.read.parquet(first["b"]).count() == 5


def test_run_publishes_at_the_end(make, spark, tmp_path, monkeypatch):
    journal, rules, accounts = books_of(make)
    directory, as_of = str(tmp_path / "out"), F.lit("2030-01-01").cast("timestamp")
    out = pipeline.run(journal, rules, accounts, directory, as_of)
    assert publish.published(spark, directory) == out["paths"]
    typed, records, found = (spark.read.parquet(out["paths"][n]) for n in ("entries", "records", "issues"))
    counted = pipeline.statistics(typed, records, rules, found).first().asDict()
    assert out["statistics"] == counted == spark.read.parquet(out["paths"]["statistics"]).first().asDict()

    def lost(*args):
        raise InterruptedError

    monkeypatch.setattr(publish, "unified_report", lost)
    with pytest.raises(InterruptedError):
        pipeline.run(journal, rules, accounts, directory, as_of)
    assert publish.published(spark, directory) == out["paths"] and records.count() == 4


def test_counted_write(spark, tmp_path):
    counts = [F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("id"), F.lit(0)).alias("total")]
    assert publish.write_counted(spark.range(0, 100, 1, 7), str(tmp_path / "a"), counts) == {"n": 100, "total": 4950}
    assert publish.write_counted(spark.range(0), str(tmp_path / "b"), counts) == {"n": 0, "total": 0}
    assert publish.write_counted(spark.range(10).repartition(3).where("id < 0"), str(tmp_path / "c"), counts) == {"n": 0, "total": 0}


def test_append(make, spark, tmp_path):
    rows = make.accounts(*ACCOUNTS)
    path = publish.write_table(rows, str(tmp_path / "t"))
    publish.write_table(rows, path, mode="append")
    assert spark.read.parquet(path).count() == 10
