"""Review flags, outliers, dashboard, preview, comparison and the flagged list."""

import decimal
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.sizing import fits
from ..functions.staging import settle
from ..functions.text import strip
from ..functions.median import double_median, value_counts
from ..schemas import MISSING_TYPE, MONEY
from .accounts import lookup
from .ledger import line, line_numbers
from .matching import has_rule
from .ordering import severity_rank
from .typing import HINT

MAD_FACTOR = 5
# Texts of the review tables.
MISSING_TYPE_REASON = "Journal type is missing; please classify this entry (类型/Type) or add rules to infer it"
STATUS_LABELS = {
    "no_match": "No Matching Rule", "missing_type": "Missing Journal Type",
    "validation_error": "Validation Error", "validation_warning": "Validation Warning",
    "unusual_amount": "Unusual Amount", "missing_account": "Missing Account",
    "multiple_rules": "Multiple Rules",
}
ACTIONS = {
    "no_match": "Review journal entry and add/update mapping rule",
    "missing_type": "Fill journal Type (类型) or add rules so the tool can infer it",
    "validation_error": "Fix data error in journal entry",
    "validation_warning": "Review warning - may need correction",
    "unusual_amount": "Verify amount is correct",
    "missing_account": "Verify account code or update hierarchy",
    "multiple_rules": "Review rule priority - may need adjustment",
}
ICONS = {"critical": "✗", "error": "⚠", "warning": "!"}
OTHER_ICON, OK_ICON = "ℹ", "✓"
FLAG_COLUMNS = ["entry_id", "status", "reason", "severity", "source_entry_id", "first_at", "last_at", "occurrences"]
# Order in which the input checks report, for "first" and "last" flag of an entry.
CHECK_ORDER = ["syntax_error", "invalid_field_reference", "invalid_account_code", "rule_conflict", "missing_field",
               "zero_amount", "large_amount", "future_date", "duplicate_entry", "unmatched_type"]


def _choice(key: Column, values: dict, default) -> Column:
    out = default if isinstance(default, Column) else F.lit(default)
    for k, v in values.items():
        out = F.when(key == k, v).otherwise(out)
    return out


def _at(stage: int, row=None, line_row=None, line_no=None) -> Column:
    """Place of a flag in the order in which the checks report."""
    def number(c, kind):
        return (F.lit(0) if c is None else F.col(c)).cast(kind)
    return F.struct(
        F.lit(stage).alias("stage"), F.lit(0).alias("rank"),
        (F.lit(-1).cast("bigint") if row is None else number(row, "bigint")).alias("row"), F.lit(0).alias("sub"),
        number(line_row, "bigint").alias("line_row"), number(line_no, "int").alias("line"))


def _flag(failed: Column, status: str, reason, severity: str, at: Column) -> tuple[Column, Column]:
    return F.coalesce(failed, F.lit(False)), F.struct(
        F.lit(status).alias("status"), (reason if isinstance(reason, Column) else F.lit(reason)).alias("reason"),
        F.lit(severity).alias("severity"), at.alias("at"))


def _flagged(df: DataFrame, flags: list, source: str) -> DataFrame:
    """All flags of a table from one scan of it."""
    raised = reduce(lambda x, y: x | y, [failed for failed, _ in flags])
    rows = df.filter(raised).select(
        "entry_id", F.col(source).alias("source_entry_id"),
        F.explode(F.array(*[F.when(failed, flag) for failed, flag in flags])).alias("f"))
    return rows.filter(F.col("f").isNotNull()).select(
        "entry_id", "f.status", "f.reason", "f.severity", "source_entry_id", F.col("f.at").alias("first_at"),
        F.col("f.at").alias("last_at"), F.lit(1).cast("bigint").alias("occurrences"))


def _no_match() -> tuple:
    return _flag(F.col("no_match"), "no_match", "No matching rule found for this journal entry", "error", _at(1, "src_row"))


def _missing_type() -> tuple:
    hinted = F.concat(F.lit(f"{MISSING_TYPE_REASON}. 自动推断建议 (低置信度): "), F.col("notes"))
    reason = F.when(F.contains("notes", F.lit(HINT)), hinted).otherwise(F.lit(MISSING_TYPE_REASON))
    return _flag(strip("old_type") == MISSING_TYPE, "missing_type", reason, "error", _at(2, "src_row"))


def _multiple_rules() -> tuple:
    return _flag(has_rule("cr") & has_rule("dr"), "multiple_rules", "Multiple rules (2) matched this entry", "info", _at(7, "src_row"))


def no_match_flags(booked: DataFrame) -> DataFrame:
    return _flagged(booked, [_no_match()], "entry_id")


def missing_type_flags(journal: DataFrame) -> DataFrame:
    return _flagged(journal, [_missing_type()], "entry_id")


def multiple_rule_flags(booked: DataFrame) -> DataFrame:
    """Rows with a credit and a debit rule, that is every ordinary pair."""
    return _flagged(booked, [_multiple_rules()], "entry_id")


def _lines_by_source(ledger: DataFrame) -> DataFrame:
    """(source_entry_id, line_id) with the number of lines and the first and last place.

    Equal lines are counted per line number, so that this needs whole numbers only and no sort; what is left of a
    source is put together where it meets the issues.
    """
    counted = ledger.groupBy("source_entry_id", F.col("entry_id").alias("line_id"), "line_no").agg(
        F.count(F.lit(1)).alias("n"), F.min("src_row").alias("r0"), F.max("src_row").alias("r1"))
    return counted.repartition("source_entry_id").groupBy("source_entry_id", "line_id").agg(
        F.sum("n").alias("n_lines"), F.min(F.struct(F.col("r0").alias("src_row"), "line_no")).alias("l0"),
        F.max(F.struct(F.col("r1").alias("src_row"), "line_no")).alias("l1"))


def _named_lines(issues: DataFrame, ledger: DataFrame) -> DataFrame:
    """(own_line, line_source) of the lines whose own id an issue may name: the source of the first line of that id.

    Hashes of ids find them, without moving the ids of all lines; the caller joins on the ids themselves.
    """
    digest = F.xxhash64("entry_id").alias("_digest")
    asked = issues.select(digest)
    asked = F.broadcast(asked) if fits(asked) else asked.hint("merge")  # files of digests are far smaller than a hash table of them
    met = settle(ledger.select(digest).join(asked, "_digest", "left_semi").distinct(), "line-ids")
    return ledger.withColumn("_digest", digest).join(met, "_digest", "left_semi").groupBy(F.col("entry_id").alias("own_line")).agg(
        F.min_by("source_entry_id", F.struct("src_row", "line_no")).alias("line_source"))


def issue_flags(issues: DataFrame, ledger: DataFrame) -> DataFrame:
    """Issues become flags on the ledger lines of the journal entry they name.

    An id that is not a source is a line id, or stands for itself; an error without id flags the
    first ledger line. Equal issues and equal lines are counted before they meet, and
    `occurrences` keeps the product, so a hot id is never paired row by row.
    """
    from .issue_tables import severity as severity_of
    known = F.array(*[F.lit(c) for c in CHECK_ORDER])
    is_error = F.col("kind") == "error"
    rank = F.array_position(known, F.col("issue_type")).cast("int")
    reason = F.when(is_error, F.concat(
        F.col("message"), F.lit(" (Row "), F.col("row_number").cast("string"), F.lit(", Field: "),
        F.col("field_name"), F.lit(")"))).otherwise(F.col("message"))
    # Equal issues are counted per check by whole numbers only, then put together where they meet the lines.
    counted = issues.select(
        "entry_id", "src_row", rank.alias("check"), reason.alias("reason"),
        F.when(is_error, "validation_error").otherwise("validation_warning").alias("status"),
        F.when(is_error, severity_of(F.col("issue_type"))).otherwise("warning").alias("severity"),
    ).groupBy("entry_id", "reason", "status", "severity", "check").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.coalesce("src_row", F.lit(-1).cast("bigint"))).alias("r0"),
        F.max(F.coalesce("src_row", F.lit(-1).cast("bigint"))).alias("r1"))

    def place(row):
        # Errors are ordered by check and then row, warnings by row and then check.
        failed = F.col("status") == "validation_error"
        return F.struct(
            F.when(failed, 3).otherwise(4).alias("stage"), F.when(failed, F.col("check")).otherwise(0).alias("rank"),
            F.col(row).alias("row"), F.when(failed, 0).otherwise(F.col("check")).alias("sub"))

    def together(parts):
        return parts.groupBy("entry_id", "reason", "status", "severity").agg(
            F.sum("n").alias("n"), F.min(place("r0")).alias("p0"), F.max(place("r1")).alias("p1"))

    def at(p, line_row, line):
        return F.struct(F.col(f"{p}.stage"), F.col(f"{p}.rank"), F.col(f"{p}.row"), F.col(f"{p}.sub"),
                        F.coalesce(line_row, F.lit(0).cast("bigint")).alias("line_row"),
                        F.coalesce(line, F.lit(0)).alias("line"))

    named = together(counted.filter(F.coalesce(F.col("entry_id") != "", F.lit(False))).repartition("entry_id"))
    by_source = _lines_by_source(ledger)
    joined = named.join(by_source, named["entry_id"] == by_source["source_entry_id"], "left").join(
        _named_lines(issues, ledger), F.col("entry_id") == F.col("own_line"), "left")
    is_source = F.col("line_id").isNotNull()
    placed = joined.select(
        F.coalesce("line_id", "entry_id").alias("entry_id"), "status", "reason", "severity",
        F.when(is_source, F.col("entry_id")).otherwise(F.coalesce("line_source", "entry_id")).alias("source_entry_id"),
        at("p0", F.col("l0.src_row"), F.col("l0.line_no")).alias("first_at"),
        at("p1", F.col("l1.src_row"), F.col("l1.line_no")).alias("last_at"),
        (F.col("n") * F.coalesce("n_lines", F.lit(1))).alias("occurrences"))
    first_line = ledger.agg(F.min_by("entry_id", F.struct("src_row", "line_no"))).scalar()
    nameless = together(counted.filter(
        ~F.coalesce(F.col("entry_id") != "", F.lit(False)) & (F.col("status") == "validation_error"))).withColumn("line_id", first_line).filter(F.col("line_id").isNotNull())
    general = nameless.select(
        F.col("line_id").alias("entry_id"), "status", "reason", "severity",
        F.lit(None).cast("string").alias("source_entry_id"),
        at("p0", F.lit(None), F.lit(None)).alias("first_at"), at("p1", F.lit(None), F.lit(None)).alias("last_at"),
        F.col("n").alias("occurrences"))
    return placed.unionByName(general)


def _unknown_account() -> tuple:
    unknown = F.col("ledger_id").isNull() & F.coalesce(F.col("account_code") != "", F.lit(False))
    reason = F.concat(F.lit("Account code '"), F.col("account_code"), F.lit("' not found in hierarchy"))
    return _flag(unknown, "missing_account", reason, "warning", _at(5, None, "src_row", "line_no"))


def missing_account_flags(ledger: DataFrame, accounts: DataFrame) -> DataFrame:
    """Lines whose account is neither a code nor a name."""
    return _flagged(lookup(ledger, accounts), [_unknown_account()], "source_entry_id")


def _cents(column) -> Column:
    return (F.col(column) * 100).cast("bigint")


def amount_bounds(ledger: DataFrame) -> Column:
    """Struct (low, high, med2), null without spread: the least and the greatest amount that is not unusual, exact,
    and twice the median in cents. A bound beyond every amount is null.

    The lines are counted once per cent value; both medians come from these counts, which are written once.
    """
    counts = settle(value_counts(ledger, _cents("amount")), "cents")
    middle = double_median(counts)
    away = counts.select(F.abs(2 * F.col("v") - middle.select("med2").scalar()).alias("v"), "n").groupBy("v").agg(F.sum("n").alias("n"))
    spread = double_median(away).select(F.col("med2").alias("dev4"))
    row = middle.withColumn("dev4", spread.scalar())
    med4, far = 2 * F.col("med2").cast("decimal(28,0)"), MAD_FACTOR * F.col("dev4").cast("decimal(28,0)")

    def amount(quarters: Column, whole) -> Column:
        cents = whole(quarters * F.lit(decimal.Decimal("0.25")))
        return (cents * F.lit(decimal.Decimal("0.01"))).try_cast(MONEY)

    bounds = F.when((F.col("n") >= 3) & (F.col("dev4") > 0), F.struct(
        amount(med4 - far, F.ceil).alias("low"), amount(med4 + far, F.floor).alias("high"), F.col("med2")))
    return row.select(bounds).scalar()


def _outlier(bounds: Column) -> tuple[Column, Column]:
    """("large", "small" or NULL, reason) of a line."""
    size = F.when(F.col("amount") > bounds["high"], "large").when(F.col("amount") < bounds["low"], "small")
    return size, F.concat(
        F.lit("Unusually "), size, F.lit(" amount: "), F.format_number("amount", 2),
        F.lit(" (median: "), F.format_number(bounds["med2"] / 200, 2), F.lit(")"))


def amount_outliers(ledger: DataFrame) -> DataFrame:
    """Lines beyond median -/+ 5 median absolute deviations, with the reason text."""
    size, reason = _outlier(F.col("_bounds"))
    rows = ledger.withColumn("_bounds", amount_bounds(ledger)).withColumns({"size": size, "reason": reason})
    return rows.filter(F.col("size").isNotNull()).drop("_bounds")


def _unusual_amount(bounds: Column) -> tuple:
    size, reason = _outlier(bounds)
    return _flag(size.isNotNull(), "unusual_amount", reason, "warning", _at(6, None, "src_row", "line_no"))


def unusual_amount_flags(ledger: DataFrame) -> DataFrame:
    return _flagged(ledger.withColumn("_bounds", amount_bounds(ledger)), [_unusual_amount(F.col("_bounds"))], "source_entry_id")


def review_flags(booked: DataFrame, ledger: DataFrame, issues: DataFrame | None = None,
                 accounts: DataFrame | None = None) -> DataFrame:
    """All flags of a run; `occurrences` counts equal ones. Rows and lines are scanned once each."""
    out = _flagged(booked, [_no_match(), _missing_type(), _multiple_rules()], "entry_id")
    of_lines = [_unusual_amount(F.col("_bounds"))]
    lines = ledger
    if accounts is not None:
        lines, of_lines = lookup(ledger, accounts), [_unknown_account(), *of_lines]
    lines = lines.withColumn("_bounds", amount_bounds(ledger))
    out = out.unionByName(_flagged(lines, of_lines, "source_entry_id"))
    if issues is not None:
        out = out.unionByName(issue_flags(issues, ledger))
    return out.select(*FLAG_COLUMNS)


def last_flag_per_line(flags: DataFrame) -> DataFrame:
    return flags.groupBy("entry_id").agg(
        F.max_by(F.struct("status", "severity", "reason"), "last_at").alias("f")).select("entry_id", "f.*")


def first_flag_per_source(flags: DataFrame) -> DataFrame:
    return flags.filter(F.col("source_entry_id").isNotNull()).groupBy("source_entry_id").agg(
        F.min_by(F.struct("status", "severity", "reason"), "first_at").alias("f")).select("source_entry_id", "f.*")


def icon(severity: Column) -> Column:
    return F.when(severity.isNull(), OK_ICON).otherwise(_choice(severity, ICONS, OTHER_ICON))


def preview(ledger: DataFrame, flags: DataFrame) -> DataFrame:
    """Every ledger line with the icon and reason of its last flag."""
    last = last_flag_per_line(flags).select("entry_id", "severity", "reason")
    return ledger.join(last, "entry_id", "left").select(
        icon(F.col("severity")).alias("status_icon"), "entry_id", F.col("account_code").alias("ledger_id"),
        "account_code", "account_path", "description", "amount", "date", "quarter", "year", "source_entry_id",
        "rule_applied", F.coalesce("reason", F.lit("")).alias("review_reason"), "src_row", "line_no")


def comparison(booked: DataFrame, flags: DataFrame | None = None) -> DataFrame:
    """Every journal row beside its ledger lines; rows without lines read NO MATCH.

    The lines are the row's own, so nothing is joined but the first flag of the entry.
    """
    no = F.col("no")
    own = line(no)
    rows = booked.withColumn("no", F.explode_outer(line_numbers())).select(
        "src_row", F.coalesce(no, F.lit(0)).alias("line_no"), F.col("entry_id").alias("journal_entry_id"),
        F.col("description").alias("journal_description"), F.col("amount").alias("journal_amount"),
        F.col("date").alias("journal_date"), F.coalesce("old_type", F.lit("")).alias("journal_type"),
        F.when(no.isNull(), "NO MATCH").otherwise(own["entry_id"]).alias("ledger_entry_id"),
        *[F.when(no.isNotNull(), own[c]).alias(a) for c, a in (
            ("account_code", "account_code"), ("account_path", "account_path"), ("amount", "ledger_amount"),
            ("rule_applied", "rule_applied"), ("quarter", "quarter"), ("year", "year"))])
    if flags is None:
        rows = rows.withColumn("severity", F.lit(None).cast("string"))
    else:
        first = first_flag_per_source(flags).select(F.col("source_entry_id").alias("journal_entry_id"), "severity")
        rows = rows.join(first, "journal_entry_id", "left")
    return rows.select(icon(F.col("severity")).alias("status_icon"), *[c for c in rows.columns if c != "severity"])


def flagged_entries(flags: DataFrame, ledger: DataFrame, journal: DataFrame) -> DataFrame:
    """Flags with the ledger line they name, else the journal entry, else neither; and what to do."""
    spot = F.struct("src_row", "line_no")
    by_id = ledger.groupBy("entry_id").agg(F.max_by(F.struct(
        "account_code", "account_path", "description", "amount", "date", "source_entry_id", "rule_applied"), spot).alias("g"))
    entries = journal.groupBy(F.col("entry_id").alias("j_id")).agg(
        F.max_by(F.struct("description", "amount", "date"), "src_row").alias("j"))
    rows = flags.join(by_id, "entry_id", "left")
    rows = rows.join(entries.withColumnRenamed("j", "own"), F.col("entry_id") == F.col("j_id"), "left").drop("j_id")
    rows = rows.join(entries.withColumnRenamed("j", "src"), F.col("source_entry_id") == F.col("j_id"), "left").drop("j_id")
    entry = F.coalesce("own", "src")
    g, in_ledger, in_journal = F.col("g"), F.col("g").isNotNull(), F.coalesce("own", "src").isNotNull()

    def pick(line, own, nothing):
        return F.when(in_ledger, line).when(in_journal, own).otherwise(nothing)

    named = F.coalesce("source_entry_id", "entry_id")
    none = F.lit("N/A")
    return rows.select(
        icon(F.col("severity")).alias("status_icon"), F.initcap("severity").alias("severity"), "entry_id",
        pick(g["account_code"], F.lit("N/A (Journal Entry)"), none).alias("account_code"),
        pick(g["account_path"], F.lit("N/A (Journal Entry)"), none).alias("account_path"),
        pick(g["description"], entry["description"], F.lit("Entry not found in ledger or journal")).alias("description"),
        pick(g["amount"], entry["amount"], F.lit(None)).alias("amount"),
        pick(g["date"], entry["date"], F.lit(None)).alias("date"),
        pick(g["source_entry_id"], named, named).alias("source_entry_id"),
        pick(g["rule_applied"], F.lit("N/A (No transformation)"), none).alias("rule_applied"),
        F.initcap(F.replace("status", F.lit("_"), F.lit(" "))).alias("issue_type"), "reason",
        _choice(F.col("status"), ACTIONS, "Review entry").alias("action_needed"),
        severity_rank(F.col("severity")).alias("severity_rank"), "occurrences")


def flagged_order() -> list[Column]:
    return [F.col("severity_rank"), F.col("entry_id")]


def dashboard(journal: DataFrame, ledger: DataFrame, flags: DataFrame, issues: DataFrame | None = None) -> DataFrame:
    """One row: journal and ledger size, flags by severity, issues found."""
    def of(severity):
        return F.coalesce(F.sum(F.when(F.col("severity") == severity, F.col("occurrences"))), F.lit(0)).cast("bigint")

    row = flags.agg(
        F.coalesce(F.sum("occurrences"), F.lit(0)).cast("bigint").alias("entries_needing_review"),
        of("critical").alias("critical_issues"), of("error").alias("error_flags"),
        of("warning").alias("warning_flags"), of("info").alias("info_items"))
    extra = {"total_journal_entries": journal.agg(F.count(F.lit(1))).scalar(),
             "total_ledger_entries": ledger.agg(F.count(F.lit(1))).scalar()}
    if issues is not None:
        extra["_issues"] = issues.agg(F.struct(F.count_if(F.col("kind") == "error").alias("e"), F.count_if(F.col("kind") == "warning").alias("w"))).scalar()
    row = row.withColumns(extra)
    if issues is None:
        return row
    return row.withColumns({"errors_detected": F.col("_issues.e"), "warnings_detected": F.col("_issues.w")}).drop("_issues")


def flags_by_status(flags: DataFrame) -> DataFrame:
    """Per status: label, number of flags and the severity of the first flag."""
    return flags.groupBy("status").agg(
        F.sum("occurrences").alias("count"), F.min_by("severity", "first_at").alias("severity")).select(
        "status", _choice(F.col("status"), STATUS_LABELS, F.initcap(F.replace("status", F.lit("_"), F.lit(" ")))).alias("label"),
        "count", F.initcap("severity").alias("severity"))
