"""Checks of the booked ledger against journal, accounts and aggregates."""

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.issues import check, emit, union_all
from ..functions.sizing import sized
from ..schemas import TOLERANCE
from .aggregate import duplicate_aggregates, tie_out
from .ledger import ledger as lines_of
from .ledger import line, line_numbers
from .matching import rule_mismatches


def _cent():
    return F.lit(TOLERANCE).cast("decimal(18,2)")


def _money_text(column):
    return column.cast("string")


def missing_and_orphans(journal: DataFrame, ledger: DataFrame) -> DataFrame:
    """Journal ids without ledger lines, and ledger sources without a journal row.

    Both sides meet in one grouping by id, combined before the shuffle.
    """
    both = journal.select("entry_id", F.lit(True).alias("known"), F.lit(False).alias("booked")).unionByName(
        ledger.select(F.col("source_entry_id").alias("entry_id"), F.lit(False).alias("known"), F.lit(True).alias("booked")))
    ids = both.groupBy("entry_id").agg(F.max("known").alias("known"), F.max("booked").alias("booked")).filter(~F.col("known") | ~F.col("booked"))
    missing = check(
        F.col("known"), "missing_entry", "completeness",
        F.concat(F.lit("Journal entry "), F.col("entry_id"),
                 F.lit(" was not transformed to any ledger entries. "
                       "Entry may have had no matching rules or transformation failed.")),
        F.col("entry_id"))
    orphan = check(
        F.col("booked"), "orphaned_entry", "completeness",
        F.concat(F.lit("Ledger entry references source entry "), F.col("entry_id"),
                 F.lit(" which does not exist in journal entries.")),
        F.col("entry_id"))
    return emit(ids, [missing, orphan], F.when(F.col("known"), F.col("entry_id")), F.lit(None))


def accuracy_issues(journal: DataFrame, ledger: DataFrame) -> DataFrame:
    """Every booked journal id: sum of its lines against the signed amount, and its date.

    A CR/DR pair stores the amount twice and unsigned, so balanced pairs differ here by design;
    `unbalanced_sources` is the check that debits equal credits.
    """
    # Distinct dates per source are bounded by the calendar.
    lines = ledger.groupBy(F.col("source_entry_id").alias("entry_id")).agg(
        F.sum("amount").alias("line_sum"), F.sort_array(F.collect_set(F.to_date("date"))).alias("line_dates"))
    last = journal.groupBy("entry_id").agg(F.max_by(F.struct("src_row", "amount", "date"), "src_row").alias("j"))
    rows = last.join(lines, "entry_id").select(
        "entry_id", "j.src_row", "j.amount", F.to_date("j.date").alias("day"), "line_sum", "line_dates")
    total, own = _money_text(F.col("line_sum").cast("decimal(28,2)")), _money_text(F.col("amount"))
    days = F.concat(F.lit("["), F.array_join(F.transform("line_dates", lambda d: d.cast("string")), ", "), F.lit("]"))
    day = F.col("day").cast("string")
    return emit(rows, [
        check(F.abs(F.col("line_sum") - F.col("amount")) > _cent(), "amount_mismatch", "accuracy",
              F.concat(F.lit("Amount mismatch for entry "), F.col("entry_id"), F.lit(": journal amount "), own,
                       F.lit(" != sum of ledger entries "), total),
              F.concat(F.lit("journal="), own, F.lit(", ledger_sum="), total)),
        check(~F.array_contains("line_dates", F.col("day")), "date_mismatch", "accuracy",
              F.concat(F.lit("Date mismatch for entry "), F.col("entry_id"), F.lit(": journal date "), day,
                       F.lit(" not found in ledger entries (ledger dates: "), days, F.lit(")")),
              F.concat(F.lit("journal="), day, F.lit(", ledger="), days)),
    ])


def unbalanced_sources(ledger: DataFrame) -> DataFrame:
    """Sources whose debits and credits differ."""
    side = F.when(F.col("ledger_type") == "DR", F.col("amount")).otherwise(-F.col("amount"))
    return ledger.groupBy("source_entry_id").agg(
        F.sum(side).cast("decimal(28,2)").alias("imbalance"), F.count(F.lit(1)).alias("n_lines")
    ).filter(F.col("imbalance") != 0)


def unknown_account_issues(ledger: DataFrame, accounts: DataFrame) -> DataFrame:
    """Account codes (by code only) that the hierarchy lacks, with count and sample sources."""
    unknown = ledger.join(sized(accounts.select(F.col("code").alias("account_code"))), "account_code", "left_anti")
    counts = unknown.groupBy("account_code").agg(F.count(F.lit(1)).alias("n"))
    # The rank limit is applied before the shuffle as well, so five rows per code and split travel.
    firsts = unknown.withColumn(
        "rn", F.row_number().over(W.partitionBy("account_code").orderBy("src_row", "line_no"))).filter("rn <= 5")
    samples = firsts.groupBy("account_code").agg(
        F.array_join(F.sort_array(F.collect_set("source_entry_id")), ", ").alias("samples"))
    return emit(counts.join(samples, "account_code"), [check(
        F.lit(True), "invalid_account_code", "account_structure",
        F.concat(F.lit("Account code '"), F.col("account_code"), F.lit("' used in "), F.col("n").cast("string"),
                 F.lit(" ledger entry(ies) does not exist in account hierarchy. Affected source entries: "),
                 F.col("samples")),
        F.col("account_code"))], F.lit(None), F.lit(None))


def hierarchy_mismatch_issues(aggregates: DataFrame, accounts: DataFrame) -> DataFrame:
    rows = tie_out(aggregates, accounts, strict=False)
    calculated, actual = _money_text(F.col("children_total")), _money_text(F.col("total_amount"))
    return emit(rows, [check(
        F.lit(True), "hierarchy_mismatch", "consistency",
        F.concat(F.lit("Level "), F.col("level").cast("string"), F.lit(" account "), F.col("account_code"),
                 F.lit(" total mismatch in Q"), F.col("quarter").cast("string"), F.lit(" "), F.col("year").cast("string"),
                 F.lit(": expected "), calculated, F.lit(" (sum of level "), (F.col("level") + 1).cast("string"),
                 F.lit(" accounts), got "), actual),
        F.concat(F.lit("calculated="), calculated, F.lit(", actual="), actual))], F.lit(None), F.lit(None))


def validate_output(journal: DataFrame, ledger: DataFrame, aggregates: DataFrame | None = None,
                    accounts: DataFrame | None = None, aggregate_ord: str | None = None) -> DataFrame:
    """All output checks as one issue table."""
    parts = [missing_and_orphans(journal, ledger)]
    if aggregates is not None and accounts is not None:
        parts.append(hierarchy_mismatch_issues(aggregates, accounts))
    parts.append(accuracy_issues(journal, ledger))
    if accounts is not None:
        parts.append(unknown_account_issues(ledger, accounts))
    if aggregates is not None and aggregate_ord is not None:
        parts.append(duplicate_aggregates(aggregates, aggregate_ord))
    return union_all(parts)


def _with_lines(booked: DataFrame) -> DataFrame:
    """Booked rows with the amounts of their lines, their number and their sum."""
    zero = F.lit(0).cast("decimal(28,2)")
    amounts = F.transform(line_numbers(include_unmatched=True), lambda no: line(no)["amount"])
    return booked.withColumn("amounts", amounts).withColumns({
        "n_lines": F.size("amounts"),
        "line_sum": F.aggregate("amounts", zero, lambda acc, x: (acc + x).cast("decimal(28,2)"))})


def transformation_issues(booked: DataFrame, rules: DataFrame, accounts: DataFrame | None = None) -> DataFrame:
    """Checks of each booked row; all but the account lookup happen inside the row."""
    rows = _with_lines(booked)
    own, total = _money_text(F.col("amount")), _money_text(F.col("line_sum"))
    gap = F.abs(F.col("line_sum") - F.col("amount"))
    n_lines = F.col("n_lines").cast("string")
    local = emit(rows, [
        check(F.col("no_match") & (F.col("n_lines") > 0), "unexpected_state", "rule_match",
              F.concat(F.lit("Entry "), F.col("entry_id"),
                       F.lit(" marked as no-match but has ledger entries. This indicates a logic error.")),
              F.concat(F.lit("no_match=True, entries="), n_lines)),
        check((F.col("n_lines") > 0) & (gap > _cent()), "amount_mismatch", "amount_preservation",
              F.concat(F.lit("Amount mismatch for entry "), F.col("entry_id"), F.lit(": journal entry amount "), own,
                       F.lit(" != sum of ledger entries "), total, F.lit(" (difference: "), _money_text(gap.cast("decimal(28,2)")), F.lit(")")),
              F.concat(F.lit("journal="), own, F.lit(", ledger_sum="), total)),
    ])
    multiple = rows.filter(F.col("n_lines") == 1).select(
        "src_row", "entry_id", "n_lines", F.explode(F.array("cr_rule", "dr_rule")).alias("r")).filter("r.generates_multiple")
    incomplete = emit(multiple, [check(
        F.lit(True), "incomplete_one_to_many", "completeness",
        F.concat(F.lit("Rule "), F.col("r.rule_id"), F.lit(" has generates_multiple=True for entry "), F.col("entry_id"),
                 F.lit(", but only "), n_lines, F.lit(" ledger entry(ies) were created. Expected multiple ledger entries.")),
        F.concat(F.lit("entries_created="), n_lines))])
    mismatch = emit(rule_mismatches(booked, rules), [check(
        F.lit(True), "rule_mismatch", "rule_correctness",
        F.concat(F.lit("Rule "), F.col("rule_id"), F.lit(" was applied to entry "), F.col("entry_id"),
                 F.lit(" but condition '"), F.col("condition"), F.lit("' does not match entry data")),
        F.col("condition"))])
    parts = [local, mismatch, incomplete]
    if accounts is not None:
        lines = lines_of(booked, include_unmatched=True).select(
            "src_row", F.col("source_entry_id").alias("entry_id"), "account_code", F.col("entry_id").alias("line_id"))
        unknown = lines.join(sized(accounts.select(F.col("code").alias("account_code"))), "account_code", "left_anti")
        parts.append(emit(unknown, [check(
            F.lit(True), "invalid_account_code", "account_code",
            F.concat(F.lit("Account code '"), F.col("account_code"), F.lit("' in ledger entry "), F.col("line_id"),
                     F.lit(" does not exist in account hierarchy")),
            F.col("account_code"))]))
    return union_all(parts)


def post_transform_errors(booked: DataFrame, accounts: DataFrame | None = None) -> DataFrame:
    """Per matched row: error texts for amount and unknown accounts, as rows."""
    rows = _with_lines(booked.filter(~F.col("no_match")))
    own, total = _money_text(F.col("amount")), _money_text(F.col("line_sum"))
    amount = rows.filter(F.abs(F.col("line_sum") - F.col("amount")) > _cent()).select(
        "src_row", "entry_id", F.concat(F.lit("Amount mismatch: journal entry amount "), own,
                                        F.lit(" != sum of ledger entries "), total).alias("message"))
    if accounts is None:
        return amount
    lines = lines_of(booked).select("src_row", F.col("source_entry_id").alias("entry_id"), "account_code")
    unknown = lines.join(sized(accounts.select(F.col("code").alias("account_code"))), "account_code", "left_anti").select(
        "src_row", "entry_id",
        F.concat(F.lit("Account code "), F.col("account_code"), F.lit(" not found in hierarchy")).alias("message"))
    return amount.unionByName(unknown)


def unreferenced_lines(journal: DataFrame, ledger: DataFrame) -> DataFrame:
    """Ledger lines that do not name the journal entry of their row."""
    return ledger.join(journal.select("src_row", F.col("entry_id").alias("own_id")), "src_row").filter(
        F.col("own_id") != F.col("source_entry_id")).select("src_row", "entry_id", "source_entry_id", "own_id")


def id_difference(left: DataFrame, right: DataFrame, column: str) -> DataFrame:
    """Distinct values of a column on the left that the right lacks."""
    return left.select(column).subtract(right.select(column))
