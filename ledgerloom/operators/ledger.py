"""Journal rows to credit / debit ledger lines.

Everything is decided inside the journal row: `book` keeps one row per journal row with the two
applied rules. A line is such a row and a line number, so the ledger is one explode over at most
three numbers and every column of a line is an expression that is computed only when it is used.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip
from ..schemas import (
    DEPOSIT_ACCOUNT, DEPOSIT_MARK, DEPOSIT_MARK_LATIN, DEPOSIT_SPLIT, LEDGER_COLUMNS, NO_MATCH_RULE,
    SPLIT_TYPE, SPLIT_YEAR, UNMATCHED_CODE, UNMATCHED_PATH,
)
from .matching import MAX_RULES, has_rule, pick_rules

BOOKED = ["cr_rule", "dr_rule", "splits", "no_match"]
#: What a line takes from a rule.
LINE_FIELDS = ("rule_id", "account_code", "known", "path", "name_code", "name_path", "split_path")


def _yes(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False))


def book(
    journal: DataFrame, rules: DataFrame, accounts: DataFrame | None = None,
    split_deposits: bool = True, max_rules: int = MAX_RULES,
) -> DataFrame:
    """Journal rows with cr_rule, dr_rule, splits (deposit is booked apart) and no_match."""
    picked = pick_rules(journal, rules, accounts, max_rules)
    splits = (
        F.lit(split_deposits) & (strip("old_type") == SPLIT_TYPE) & (F.col("amount") > 0)
        & (F.year("date") == SPLIT_YEAR) & F.col("cr_rule.name_path").isNotNull()
        & F.col("dr_rule.name_path").isNotNull() & F.col("cr_rule.split_path").isNotNull()
    )
    return picked.select(
        *journal.columns, "cr_rule", "dr_rule", _yes(splits).alias("splits"),
        (~has_rule("cr") & ~has_rule("dr")).alias("no_match"))


def _swaps() -> Column:
    """Whether both sides change places.

    Deposits are written the wrong way round in the rules, so they swap unless the amount is
    negative. A negative amount on an income account (found by name) is a reversal and swaps.
    """
    kind = strip("old_type")
    deposit = kind.contains(DEPOSIT_MARK) | F.lower(kind).contains(DEPOSIT_MARK_LATIN)
    reversal = (F.col("amount") < 0) & _yes(F.startswith("cr_rule.name_code", F.lit("4")))
    return F.when(deposit, F.col("amount") >= 0).otherwise(reversal)


def line_numbers(include_unmatched: bool = False) -> Column:
    """Numbers of the lines of a booked row: credit 1, debit 2; debit, income, deposit when split.

    A rule with an unknown account leaves no line. Unmatched rows have two placeholder lines.
    """
    def numbers(*n):
        return F.array(*[F.lit(i) for i in n]) if n else F.array().cast("array<int>")

    credit, debit = _yes(F.col("cr_rule.known")), _yes(F.col("dr_rule.known"))
    return (
        F.when(F.col("no_match"), numbers(1, 2) if include_unmatched else numbers())
        .when(F.col("splits"), numbers(1, 2, 3)).when(credit & debit, numbers(1, 2))
        .when(credit, numbers(1)).when(debit, numbers(2)).otherwise(numbers()))


def for_lines(booked: DataFrame) -> DataFrame:
    """Booked rows with those attributes of their rules that lines and flags are made of."""
    return booked.withColumns({side: F.struct(*[F.col(f"{side}.{c}") for c in LINE_FIELDS]) for side in ("cr_rule", "dr_rule")})


def line(no: Column) -> dict[str, Column]:
    """The columns of line `no` of a booked row."""
    cr, dr, splits, empty = F.col("cr_rule"), F.col("dr_rule"), F.col("splits"), F.col("no_match")
    credit = F.when(splits, no != 1).otherwise(no == 1)
    deposit = splits & (no == 3)
    first_is_debit = F.when(no == 1, "DR").otherwise("CR")
    gross = F.abs("amount")
    part = F.least(F.lit(DEPOSIT_SPLIT).cast("decimal(18,2)"), gross)

    def of_rule(field):
        return F.when(credit, cr[field]).otherwise(dr[field])

    rule = F.when(empty, NO_MATCH_RULE).otherwise(of_rule("rule_id"))
    suffix = (
        F.when(empty, F.concat(F.lit("-"), first_is_debit))
        .when(splits & (no == 2), "-OL").when(deposit, "-OL-D").otherwise(""))
    side = F.when(empty | splits, first_is_debit).when((no == 1) != _swaps(), "CR").otherwise("DR")
    return {
        "line_no": no,
        "entry_id": F.concat(F.lit("LE-"), F.col("entry_id"), F.lit("-"), rule, suffix),
        "account_code": F.when(empty, UNMATCHED_CODE).when(deposit, DEPOSIT_ACCOUNT).otherwise(of_rule("account_code")),
        "account_path": F.when(empty, UNMATCHED_PATH).when(deposit, cr["split_path"])
        .when(splits, of_rule("name_path")).otherwise(of_rule("path")),
        "amount": F.when(deposit, part).when(splits & (no == 2), gross - part).otherwise(gross).cast("decimal(18,2)"),
        "date": F.col("date"), "description": F.col("description"), "source_entry_id": F.col("entry_id"),
        "rule_applied": rule, "quarter": F.quarter("date"), "year": F.year("date"), "ledger_type": side,
    }


def ledger(booked: DataFrame, include_unmatched: bool = False, keep: list[str] | None = None) -> DataFrame:
    """One row per ledger line. Placeholder lines of unmatched rows only on request.

    `keep` names journal columns to carry along, e.g. the sheet.
    """
    lines = booked.withColumn("_no", F.explode(line_numbers(include_unmatched)))
    columns = line(F.col("_no"))
    return lines.select("src_row", *[columns[c].alias(c) for c in LEDGER_COLUMNS if c != "src_row"], *(keep or []))


def lines_array(include_unmatched: bool = True) -> Column:
    """The lines of a booked row as an array of structs, for nested records."""
    return F.transform(line_numbers(include_unmatched), lambda no: F.struct(
        *[c.alias(name) for name, c in line(no).items()]))


def unmatched(booked: DataFrame) -> DataFrame:
    """Journal rows for which no rule was applied."""
    return booked.filter("no_match").drop(*BOOKED)


def transform(journal, rules, accounts=None, **options):
    """(ledger of the matched rows, unmatched journal rows)."""
    booked = book(journal, rules, accounts, **options)
    return ledger(booked), unmatched(booked)


def transform_entry(journal, rules, accounts, entry_id: str) -> DataFrame:
    """The booked row of one journal entry; the filter reaches the scan."""
    return book(journal.filter(F.col("entry_id") == entry_id), rules, accounts)
