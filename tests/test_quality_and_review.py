import decimal
import random
import statistics

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions.median import double_median, value_counts
from ledgerloom.functions.numbering import previous_value, running_number
from ledgerloom.operators import aggregate as agg
from ledgerloom.operators import fixes
from ledgerloom.operators import issue_tables as issues
from ledgerloom.operators import ledger as booking
from ledgerloom.operators import quality_input as qi
from ledgerloom.operators import quality_output as qo
from ledgerloom.operators import review, typing



def test_composite_duplicates(make):
    rows = make.journal(("A", "T", 5, "2024-01-01"), ("B", "T", 5, "2024-01-01"), ("B", "T", 5, "2024-01-01"), ("C", "T", 6, "2024-01-01"))
    found = qi.duplicate_row_issues(rows).orderBy("src_row").collect()
    assert [r.entry_id for r in found] == ["A", "B", "B"] and len({r.message for r in found}) == 1
    assert "2 rows of group" in found[0].message and qi.duplicate_members(rows).count() == 3


def test_duplicate_ids(make):
    rows = make.journal(*[("A", "T", i, "2024-01-01") for i in range(50)], ("B", "T", 1, "2024-01-01"))
    assert qi.duplicate_id_issues(rows).count() == 49


def test_input_validation(make):
    rules = make.rules(("R-1", 'old_type == "OL"', "A1", 1, "CR", "OL"))
    rows = make.journal(("JE-1", "OL", 0, "2024-01-01"), ("JE-2", "XX", 2_000_000_000, "2026-04-01"))
    found = qi.validate_inputs(rows, rules, None, F.lit("2025-01-01").cast("timestamp"))
    assert sorted(r.issue_type for r in found.collect()) == ["future_date", "large_amount", "mixed_quarters", "mixed_years", "unmatched_type", "zero_amount"]
    assert not qi.is_valid(found) and qi.is_valid(found.filter("kind = 'warning'"))
    counts = qi.processed_counts(found, rows, rules).first()
    assert (counts.entries_processed, counts.rules_processed, counts.error_count, counts.warning_count) == (3, 1, 1, 5)
    assert qi.unmatched_type_issues(rows, rules.limit(0)).count() == 0


def test_year_correction(spark):
    df = spark.createDataFrame([(1999, "2024-05-01"), (2999, None), (None, "2023-01-01"), (2020, "2024-01-01"), (1000, None)], "y int, d string")
    assert [r[0] for r in df.select(qi.correct_year(F.col("y"), F.col("d").cast("date"))).collect()] == [2024, 2100, 2023, 2020, 2000]


def test_output_checks(make):
    accounts = make.accounts(("A1", "a", 1, None), ("A1-1", "b", 2, "A1"), ("A1-2", "c", 2, "A1"))
    journal = make.journal(("J1", "T", 400, "2024-01-01"), ("J2", "T", 5, "2024-01-01"), ("J3", "T", 7, "2024-01-01"))
    ledger = make.ledger(("J1", "A1-1", 400, "2024-01-01", "CR"), ("J2", "A1-2", 700, "2024-01-02", "CR"), ("X", "A1", 1000, "2024-01-01", "CR"), ("J1", "zz", 1, "2024-01-01", "CR"))
    found = qo.validate_output(journal, ledger, agg.quarterly(ledger, accounts), accounts).collect()
    assert sorted((r.issue_type, r.entry_id) for r in found if r.entry_id) == [
        ("amount_mismatch", "J1"), ("amount_mismatch", "J2"), ("date_mismatch", "J2"), ("missing_entry", "J3")]
    assert sorted(r.issue_type for r in found if not r.entry_id) == ["hierarchy_mismatch", "invalid_account_code", "orphaned_entry"]
    assert {r.source_entry_id for r in qo.unbalanced_sources(ledger).collect()} == {"J1", "J2", "X"}


def test_duplicate_aggregates(make, spark):
    rows = spark.createDataFrame([(i, "A", 1, 2024, decimal.Decimal(i)) for i in range(6)], "ord bigint, account_code string, quarter int, year int, total_amount decimal(18,2)")
    said = [r.message for r in agg.duplicate_aggregates(rows).orderBy("src_row").collect()]
    assert len(said) == 5 and said[0].endswith("total 0.00 and 1.00") and said[4].endswith("total 4.00 and 5.00")


def test_transformation_checks(make):
    rules = make.rules(("R-1", 'old_type == "x"', "A1", 1, None), ("R-2", 'old_type == "y"', "A1", 1, None)).withColumn("generates_multiple", F.col("rule_id") == "R-2")
    booked = booking.book(make.journal(("J", "x", 5, "2024-01-01"), ("K", "y", -5, "2024-01-01"), ("L", "z", 5, "2024-01-01")), rules)
    found = qo.transformation_issues(booked, rules, make.accounts(("A1", "a", 1, None)))
    assert sorted((r.entry_id, r.issue_type) for r in found.collect()) == [
        ("K", "amount_mismatch"), ("K", "incomplete_one_to_many"), ("L", "amount_mismatch"), ("L", "invalid_account_code"), ("L", "invalid_account_code"), ("L", "unexpected_state")]
    changed = rules.withColumn("condition", F.lit('old_type == "other"'))
    for limit in (20_000, 0):
        from ledgerloom.operators.matching import rule_mismatches
        assert rule_mismatches(booked, changed, limit).count() == 2
        assert rule_mismatches(booked, rules, limit).count() == 0


def test_numbering(spark):
    df = spark.range(0, 1000, 7).selectExpr("id AS ord")
    rows = running_number(df, "ord", block=50).orderBy("ord").collect()
    assert [r.number for r in rows] == list(range(1, len(rows) + 1))
    keyed = df.withColumn("k", F.col("ord") % 3)
    seen, out = {}, previous_value(keyed, ["k"], "ord", "ord", block=64).orderBy("ord").collect()
    for r in out:
        assert (r.previous, r.is_first) == (seen.get(r.k), r.k not in seen)
        seen[r.k] = r.ord


@pytest.mark.parametrize("n", [1, 2, 7, 100, 1001])
def test_exact_median(spark, n):
    rng = random.Random(n)
    values = [rng.choice([rng.randrange(100), rng.randrange(10 ** 15)]) for _ in range(n)]
    df = spark.createDataFrame([(v,) for v in values], "v bigint")
    assert tuple(double_median(value_counts(df, F.col("v"))).first()) == (n, round(2 * statistics.median(values)))
    assert tuple(double_median(value_counts(df.filter("v < 0"), F.col("v"))).first()) == (0, None)


def test_outliers(make):
    amounts = [500 + 60 * i for i in range(11)]
    ledger = make.ledger(*[(f"J{i}", "A", a, "2024-01-01", "DR") for i, a in enumerate(amounts + [1_000_000])])
    found = review.amount_outliers(ledger).collect()
    assert [r.reason for r in found] == ["Unusually large amount: 1,000,000.00 (median: 830.00)"]
    same = make.ledger(*[(f"J{i}", "A", 5, "2024-01-01", "DR") for i in range(9)])
    assert review.amount_outliers(same).count() == 0 and review.amount_outliers(same.limit(2)).count() == 0


def test_review_flags(make, spark):
    rules = make.rules(("R-1", 'old_type == "OL"', "A1", 1, "CR"), ("R-2", 'old_type == "OL"', "A2", 1, "DR"))
    journal = make.journal(("J1", "OL", 5, "2024-01-01"), ("J2", "__MISSING_TYPE__", 6, "2024-01-01"))
    booked = booking.book(journal, rules)
    ledger = booking.ledger(booked)
    rows = [("error", 0, 0, "amount", "missing_field", "m1", None, "J1"), ("warning", 1, 0, "amount", "zero_amount", "w", None, "J2"),
            ("error", 0, 3, "f", "syntax_error", "lost", None, None), ("error", 0, 0, "f", "missing_field", "line", None, "LE-J1-R-1"), ("warning", 0, 0, "f", "x", "ignored", None, None)]
    issue_table = spark.createDataFrame(rows, "kind string, src_row bigint, row_number bigint, field_name string, issue_type string, message string, actual_value string, entry_id string")
    flags = review.review_flags(booked, ledger, issue_table, make.accounts(("A1", "a", 1, None)))
    got = sorted((r.status, r.entry_id, r.reason) for r in flags.collect())
    assert got == sorted([
        ("no_match", "J2", "No matching rule found for this journal entry"), ("missing_type", "J2", review.MISSING_TYPE_REASON),
        ("validation_error", "LE-J1-R-1", "m1 (Row 0, Field: amount)"), ("validation_error", "LE-J1-R-2", "m1 (Row 0, Field: amount)"),
        ("validation_error", "LE-J1-R-1", "lost (Row 3, Field: f)"), ("validation_error", "LE-J1-R-1", "line (Row 0, Field: f)"),
        ("validation_warning", "J2", "w"), ("missing_account", "LE-J1-R-2", "Account code 'A2' not found in hierarchy"),
        ("multiple_rules", "J1", "Multiple rules (2) matched this entry")])
    last = {r.entry_id: r.status for r in review.last_flag_per_line(flags).collect()}
    assert last["LE-J1-R-2"] == "missing_account" and last["J2"] == "validation_warning"
    first = {r.source_entry_id: r.status for r in review.first_flag_per_source(flags).collect()}
    assert first == {"J1": "validation_error", "J2": "no_match"}
    table = review.comparison(booked, flags).orderBy("src_row", "line_no").collect()
    assert [(r.journal_entry_id, r.ledger_entry_id, r.status_icon) for r in table] == [
        ("J1", "LE-J1-R-1", "⚠"), ("J1", "LE-J1-R-2", "⚠"), ("J2", "NO MATCH", "⚠")]
    flagged = review.flagged_entries(flags, ledger, journal).orderBy(*review.flagged_order()).collect()
    assert flagged[0].severity == "Error" and flagged[-1].severity == "Info" and flagged[-1].account_code == "N/A (Journal Entry)"
    board = review.dashboard(journal, ledger, flags, issue_table).first()
    assert (board.entries_needing_review, board.info_items, board.errors_detected, board.total_ledger_entries) == (9, 1, 3, 2)


def test_inference(make, spark):
    rules = make.rules(*[(f"R-{i}", f'old_type == "{t}" and "{k}" in description', "A", 1, "CR", t) for i, (t, k) in enumerate(
        [("OL", "alipay"), ("OL", "wechat"), ("OL", "wallet"), ("CR", "bank"), ("CR", "tip")])])
    texts = {"alipay wechat wallet": ("OL", 1.0), "bank only": ("CR", 0.65), "alipay wechat bank": ("OL", 2 / 3), "tip alipay": ("OL", 0.5), "none": None}
    rows = make.journal(*[(f"J{i}", "__MISSING_TYPE__", 5, "2024-01-01", d) for i, d in enumerate(texts)], ("K", "OL", 1, "2024-01-01", "bank"))
    for limit in (500, 0):
        out = typing.suggest(rows.filter(typing.is_missing_type()), typing.keyword_index(rules), limit).collect()
        got = {r.description: r.suggestion and (r.suggestion.suggested_type, r.suggestion.confidence) for r in out}
        assert got == {k: v and (v[0], pytest.approx(v[1])) for k, v in texts.items()}
        typed = {r.entry_id: (r.old_type, r.notes) for r in typing.infer_types(rows, rules, limit).collect()}
        assert typed["J0"] == ("OL", None) and typed["K"] == ("OL", None) and typed["J4"] == ("__MISSING_TYPE__", None)
        assert typed["J1"][1] == "[型别建议/Type suggestion: CR (65%) — 关键词匹配 / Keyword match: bank]"


def test_fixes(make, spark):
    known = spark.createDataFrame([(0, "OL"), (1, "CR"), (2, "DR")], "ord int, known_type string")
    values = spark.createDataFrame([("0L",), ("ol",), ("OL",), ("XL",), ("C",)], "value string")
    assert {r.value: (r.suggested_value, r.confidence) for r in fixes.type_fixes(values, known).collect()} == {"0L": ("OL", "high"), "ol": ("OL", "high")}
    accounts = make.accounts(("A1", "a", 1, None), ("B22", "b", 1, None), ("B33", "c", 1, None))
    values = spark.createDataFrame([("a1",), ("A2",), ("B23",), ("B2X",), ("B22",), ("QQQ",)], "value string")
    assert {r.value: (r.suggested_value, r.confidence) for r in fixes.account_fixes(values, accounts).collect()} == {
        "a1": ("A1", "high"), "A2": ("A1", "medium"), "B2X": ("B22", "medium"), "B22": ("B22", "medium")}


def test_close_codes_are_not_broadcast(spark):
    codes = spark.range(1000).selectExpr("id AS ord", "concat('C', id) AS code")
    values = spark.range(1000).selectExpr("concat('C', id, 'x') AS value")
    fixed = fixes.account_fixes(values, codes)
    assert "BroadcastHashJoin" not in fixed._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
    assert fixed.count() == 0


def test_severity_and_texts(spark):
    rows = [("error", 0, 4, "account_code", "syntax_error", "Code does not exist", "Z9", "R-7")]
    detected = issues.detect(spark.createDataFrame(rows, "kind string, src_row bigint, row_number bigint, field_name string, issue_type string, message string, actual_value string, entry_id string"), "rule_error")
    row = detected.select("rule_id", "entry_id", "severity", issues.message("en").alias("en"), issues.message("zh").alias("zh"), issues.quick_fix().alias("q")).first()
    assert (row.rule_id, row.entry_id, row.severity, row.q) == ("R-7", None, "error", None)
    assert row.en == ("**Rule Error: Account Code**\n\nThe value 'Z9' referenced in 'account_code' does not exist in the system. Code does not exist\n\n"
                      "**Details:** Actual value: Z9, Rule ID: R-7\n\n**Location:** Row 4, Mapping Rule: R-7\n\n"
                      "**How to fix:** Update 'account_code' to use a valid account code. Check the account hierarchy for available codes.")
    assert row.zh.startswith("**规则错误：account_code**") and "第 4 行，映射规则：R-7" in row.zh


@pytest.mark.parametrize("valid, expected", [(None, 0.5), (4, 1.0), (0, 0.0)])
def test_confidence(make, spark, valid, expected):
    schema = "kind string, src_row bigint, row_number bigint, field_name string, issue_type string, message string, actual_value string, entry_id string"
    table = spark.createDataFrame([("error", 0, 0, "f", "missing_field", "m", None, "J")] * 2, schema)
    entries = make.journal(*[(f"J{i}", "T", 1, "2024-01-01") for i in range(4)])
    row = issues.validation_summary(issues.detect(table), table.limit(0), entries, valid).first()
    assert (row.confidence, row.overall_status, row.error_rate, row.entries_valid) == (expected, "fail", 0.5, valid or 2)


def test_dashboard_checks_the_inputs_once(spark, monkeypatch):
    from workload import review as queries
    from workload.tables import QUERIES
    calls, checked = [], queries.qi.validate_inputs
    monkeypatch.setattr(queries.qi, "validate_inputs", lambda *a: calls.append(a) or checked(*a))
    QUERIES["review_dashboard"](spark, "/root/testdata/sf0.001")
    assert len(calls) == 1


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_ids_are_grouped_before_repeated_ones_are_looked_up(make):
    """entries without repeated ids are not shuffled a second time."""
    rows = make.journal(*[(f"J{i}", "T", i, "2024-01-01") for i in range(20)])
    found = qi.duplicate_id_issues(rows)
    assert "Exchange hashpartitioning" not in _plan(found) and found.count() == 0
    assert [r.entry_id for r in qi.duplicate_id_issues(rows.unionByName(make.journal(("J0", "T", 1, "2024-01-01")).withColumn("src_row", F.lit(99).cast("bigint")))).collect()] == ["J0"]


def test_lines_and_issues_are_counted_without_sorting(make, spark):
    """what is as large as the ledger or the issues is counted by whole numbers, so that it is not sorted to be counted."""
    ledger = make.ledger(("J1", "a", 1, "2024-01-01", "CR"), ("J2", "a", 1, "2024-01-01", "DR"))
    lines = _plan(review._lines_by_source(ledger))
    # Only the last step, beside the issues, sorts.
    assert "partial_min(r0" not in lines and lines.count("SortAggregate") <= 2 and "HashAggregate(keys=[source_entry_id" in lines.split("REPARTITION_BY_COL")[1]
    assert "SortAggregate" not in lines.split("REPARTITION_BY_COL")[1]


def test_repeated_ids_on_several_lines(make, spark):
    """Equal lines of a source with different line numbers are one flag, with the first and last place over all of them."""
    ledger = make.ledger(*[("J1", "a", 1, "2024-01-01", "CR")] * 4, ("J2", "a", 1, "2024-01-01", "CR")).withColumns({
        "entry_id": F.concat(F.lit("LE-"), "source_entry_id"), "line_no": F.when(F.col("src_row") % 2 == 0, 2).otherwise(1)})
    issues_of = spark.createDataFrame(
        [("error", 7, 0, "f", "missing_field", "m", None, "J1"), ("error", 3, 0, "f", "zero_amount", "m", None, "J1"),
         ("warning", 1, 0, "f", "large_amount", "w", None, "LE-J2"), ("error", None, 0, "f", "rule_conflict", "n", None, None)],
        "kind string, src_row bigint, row_number bigint, field_name string, issue_type string, message string, actual_value string, entry_id string")
    found = {r.reason: r for r in review.issue_flags(issues_of, ledger).collect()}
    both = found["m (Row 0, Field: f)"]
    assert (both.entry_id, both.source_entry_id, both.occurrences) == ("LE-J1", "J1", 8)
    assert (both.first_at["rank"], both.first_at.row, both.first_at.line_row, both.first_at.line) == (5, 7, 0, 2)
    assert (both.last_at["rank"], both.last_at.row, both.last_at.line_row, both.last_at.line) == (6, 3, 3, 1)
    assert (found["w"].entry_id, found["w"].source_entry_id, found["w"].occurrences) == ("LE-J2", "J2", 1)
    assert (found["n (Row 0, Field: f)"].entry_id, found["n (Row 0, Field: f)"].source_entry_id) == ("LE-J1", None)


def test_outlier_bounds_are_exact(make, spark):
    """Amounts on a bound are usual, a cent beyond is not; a bound beyond every amount leaves none out."""
    amounts = ["10.00", "10.01", "10.02", "10.03", "10.04", "10.07", "10.08", "9.97", "9.96"]
    rows = spark.createDataFrame([(decimal.Decimal(a),) for a in amounts], "amount decimal(18,2)")
    middle = statistics.median(decimal.Decimal(a) for a in amounts)
    far = 5 * statistics.median(abs(decimal.Decimal(a) - middle) for a in amounts)
    edge = [middle - far, middle + far, middle - far - decimal.Decimal("0.01"), middle + far + decimal.Decimal("0.01")]
    low = spark.createDataFrame([(a,) for a in edge], "amount decimal(18,2)").withColumn("b", review.amount_bounds(rows))
    assert [r[0] for r in low.select(review._outlier(F.col("b"))[0]).collect()] == [None, None, "small", "large"]
    huge = spark.createDataFrame([(decimal.Decimal(a),) for a in ("1", "2", "4000000000000000", "9000000000000000", "9999999999999999")], "amount decimal(18,2)")
    assert review.amount_outliers(huge).count() == 0
