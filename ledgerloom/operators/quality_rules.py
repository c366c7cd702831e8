"""Checks of a rule table. Broken rules are left out, doubtful ones are only reported."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip
from ..functions.conditions import FIELD_KINDS, read, unknown_fields, well_formed
from ..functions.issues import check, emit, union_all
from ..functions.sizing import compact, fits, spread
from ..functions.staging import settle
from .accounts import lookup


def _syntax() -> tuple[Column, Column]:
    return check(~well_formed(F.col("condition")), "syntax_error", "condition",
                 F.concat(F.lit("Invalid rule syntax: "), F.col("condition")), F.col("condition"))


def _without_type() -> tuple[Column, Column]:
    lacking = (F.coalesce("old_type", F.lit("")) == "") & (F.coalesce("new_type", F.lit("")) == "")
    return check(lacking, "missing_field", "old_type,new_type",
                 "At least one of 'old_type' or 'new_type' must be specified")


def syntax_issues(rules: DataFrame) -> DataFrame:
    return emit(rules, [_syntax()], "rule_id", "rule_ord")


def field_issues(rules: DataFrame) -> DataFrame:
    """One issue per name in a condition that is not a journal field."""
    valid = ", ".join(sorted(FIELD_KINDS))
    rows = rules.select("rule_ord", "rule_id", "condition",
                        F.explode(unknown_fields(F.col("condition"))).alias("name"))
    return emit(rows, [check(
        F.lit(True), "invalid_field_reference", "condition",
        F.concat(F.lit("Field '"), F.col("name"), F.lit(f"' in condition does not exist in JournalEntry. Valid fields: {valid}")),
        F.col("condition"))], "rule_id", "rule_ord")


def type_issues(rules: DataFrame) -> DataFrame:
    return emit(rules, [_without_type()], "rule_id", "rule_ord")


def _with_accounts(rules: DataFrame, accounts: DataFrame) -> DataFrame:
    """Rules with their account (ledger_id is NULL when unknown) and a description of the chart."""
    first = accounts.orderBy("ord").limit(10)
    codes = first.agg(F.array_join(F.sort_array(F.collect_list("code")), ", ")).scalar()
    samples = first.orderBy("ord").limit(5).agg(F.array_join(F.sort_array(F.collect_list("name")), ", ")).scalar()
    return lookup(rules, accounts).select(
        *rules.columns, "ledger_id", accounts.agg(F.count(F.lit(1))).scalar().alias("n_accounts"),
        codes.alias("codes"), samples.alias("samples"))


def _unknown_account() -> tuple[Column, Column]:
    more = F.when(F.col("n_accounts") > 10,
                  F.concat(F.lit(", ... ("), F.col("n_accounts").cast("string"), F.lit(" total)"))).otherwise(F.lit(""))
    return check(
        F.col("ledger_id").isNull(), "invalid_account_code", "account_code",
        F.concat(F.lit("Account code/name '"), F.col("account_code"),
                 F.lit("' does not exist in account hierarchy. Available codes: "), F.col("codes"), more,
                 F.lit(". Sample names: "), F.col("samples")),
        F.col("account_code"))


def account_issues(rules: DataFrame, accounts: DataFrame) -> DataFrame:
    """Rules whose account is neither a code nor a name. They stay in use."""
    return emit(_with_accounts(rules, accounts), [_unknown_account()], "rule_id", "rule_ord")


CONFLICT_KEYS = ["norm", "priority", "side"]


def _keyed(rules: DataFrame) -> DataFrame:
    return rules.select(
        "rule_ord", "rule_id", "account_code", F.lower(strip("condition")).alias("norm"), "priority",
        F.coalesce("ledger_type", F.lit("")).alias("side"))


def conflicts(rules: DataFrame, *more: Column) -> DataFrame:
    """Same condition, priority and side but several accounts: counts and extremes per group."""
    return _grouped(_keyed(rules), *more)


def _grouped(keyed: DataFrame, *more: Column) -> DataFrame:
    return keyed.groupBy(*CONFLICT_KEYS).agg(
        F.count(F.lit(1)).alias("n_rules"), F.min("account_code").alias("lo"), F.max("account_code").alias("hi"),
        F.min("rule_ord").alias("first_ord"), *more,
    ).filter(F.col("lo") != F.col("hi"))


def conflict_members(rules: DataFrame) -> DataFrame:
    """The rules of each conflict, as rows. The rules are read once for their groups and for themselves."""
    keyed = settle(_keyed(rules), "keyed")
    return keyed.join(_grouped(keyed).select(*CONFLICT_KEYS), CONFLICT_KEYS).select(
        *CONFLICT_KEYS, "rule_ord", "rule_id", "account_code")


def conflict_issues(rules: DataFrame) -> DataFrame:
    """One issue per conflict, with its size and the extremes of its accounts; `conflict_members` holds its rules."""
    side = F.when(F.col("side") != "", F.concat(F.lit(" ("), F.col("side"), F.lit(")"))).otherwise(F.lit(""))
    size = F.concat(F.col("n_rules").cast("string"), F.lit(" rules"))
    return emit(conflicts(rules), [check(
        F.lit(True), "rule_conflict", "condition,account_code",
        F.concat(F.lit("Multiple rules with same condition, priority ("), F.col("priority").cast("string"),
                 F.lit("), and ledger_type"), side, F.lit(" but different account codes: "), F.concat_ws(" .. ", "lo", "hi"),
                 F.lit(". Rule IDs: "), size),
        F.col("norm"))], size, "first_ord")


def duplicate_rule_ids(rules: DataFrame) -> DataFrame:
    """Rule ids are expected to be unique; the ones that are not."""
    return rules.groupBy("rule_id").agg(F.count(F.lit(1)).alias("n_rows")).filter("n_rows > 1")


def valid_rules(rules: DataFrame) -> DataFrame:
    """Rules that can be applied: readable condition, known fields, a type on one side."""
    return _valid(rules if fits(rules) else spread(rules, "rule_ord"))


def _valid(rules: DataFrame) -> DataFrame:
    known = read(F.col("condition"))
    return rules.filter(known["readable"] & (F.size(known["unknown"]) == 0) & ~_without_type()[0])


def rule_table_issues(rules: DataFrame, accounts: DataFrame | None = None) -> DataFrame:
    """All rule issues. An unreadable condition hides the other checks of that rule."""
    rules = compact(rules) if fits(rules) else spread(rules, "rule_ord")
    readable = well_formed(F.col("condition"))
    rows, later = rules, [_without_type()]
    if accounts is not None:
        rows, later = _with_accounts(rules, accounts), [_without_type(), _unknown_account()]
    checks = [_syntax(), *[(readable & failed, issue) for failed, issue in later]]
    return union_all([
        emit(rows, checks, "rule_id", "rule_ord"), field_issues(rules.filter(readable)),
        conflict_issues(_valid(rules))])
