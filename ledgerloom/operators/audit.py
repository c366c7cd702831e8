"""Audit and lineage tables: projections of the booked rows.

The flat tables are exploded over line numbers; only `audit_records` builds nested records.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import TOTAL
from .ledger import ledger, line, line_numbers, lines_array
from .matching import RULE_FIELDS, applied_rules, has_rule

RUN_FIELDS = ("user", "system_version", "rule_version")


def _run(run: dict | None, *names) -> list[Column]:
    run = run or {}
    return [F.lit(run.get(n)).cast("string").alias(n) for n in names]


def _run_text(run: dict | None) -> list[Column]:
    run = run or {}
    return [F.lit(run.get(n) or "").alias(n) for n in RUN_FIELDS]


def _rules_array() -> Column:
    def only(rule):
        return F.struct(*[F.col(rule)[f].alias(f) for f in RULE_FIELDS])

    cr, dr = has_rule("cr"), has_rule("dr")
    return (F.when(cr & dr, F.array(only("cr_rule"), only("dr_rule"))).when(cr, F.array(only("cr_rule")))
            .when(dr, F.array(only("dr_rule"))).otherwise(F.slice(F.array(only("cr_rule")), 1, 0)))


def audit_records(booked: DataFrame, run: dict | None = None) -> DataFrame:
    """One nested record per journal row: source, rules, lines and the arguments of the run."""
    source = F.struct("entry_id", "year", "description", "old_type", "amount", "date", "quarter", "notes")
    return booked.select(
        "src_row", "entry_id", *_run(run, "timestamp"), source.alias("source_entry"),
        _rules_array().alias("applied_rules"), lines_array().alias("generated_entries"), "no_match",
        *_run(run, *RUN_FIELDS))


def record_of(rows: DataFrame, entry_id: str) -> DataFrame:
    """Booked rows or audit records of one entry; the filter reaches the scan."""
    return rows.filter(F.col("entry_id") == entry_id)


def rows_by_rule(booked: DataFrame, rule_id: str) -> DataFrame:
    uses = (F.col("cr_rule.rule_id") == rule_id) | (F.col("dr_rule.rule_id") == rule_id)
    return booked.filter(F.coalesce(uses, F.lit(False)))


def all_lines(booked: DataFrame) -> DataFrame:
    """Every generated line, placeholders of unmatched entries included."""
    return ledger(booked, include_unmatched=True)


def n_lines() -> Column:
    return F.size(line_numbers(include_unmatched=True))


def transformation_path() -> Column:
    """Journal Entry X → Rule R (account) → n Ledger Entry(ies), for a booked row."""
    def step(side):
        rule = F.col(f"{side}_rule")
        return F.when(has_rule(side), F.concat(
            F.lit("→ Rule "), rule["rule_id"], F.lit(" ("), rule["account_code"], F.lit(")")))

    start = F.concat(F.lit("Journal Entry "), F.col("entry_id"))
    end = F.concat(F.lit("→ "), n_lines().cast("string"), F.lit(" Ledger Entry(ies)"))
    return F.when(F.col("no_match"), F.concat(start, F.lit(" → No matching rules → No transformation"))) \
        .otherwise(F.concat_ws(" ", start, step("cr"), step("dr"), end))


def yes_no(flag: Column) -> Column:
    return F.when(flag, "Yes").otherwise("No")


def transformations(booked: DataFrame, run: dict | None = None) -> DataFrame:
    """Flat table: one row per journal row, rule ids joined, number of lines."""
    return booked.select(
        "src_row", "entry_id", *_run(run, "timestamp"), *_run_text(run),
        F.col("description").alias("source_description"), F.col("amount").alias("source_amount"),
        F.col("date").alias("source_date"),
        F.concat_ws(", ", "cr_rule.rule_id", "dr_rule.rule_id").alias("applied_rules"),
        n_lines().alias("generated_entries_count"), yes_no(F.col("no_match")).alias("no_match"))


def relationships(booked: DataFrame) -> DataFrame:
    """Edges journal entry -> rule -> ledger line."""
    return all_lines(booked).select(
        F.col("source_entry_id").alias("journal_entry_id"), F.col("rule_applied").alias("rule_id"),
        F.col("entry_id").alias("ledger_entry_id"), "account_code", "amount")


def lineage(booked: DataFrame, run: dict | None = None) -> DataFrame:
    """One row per generated line with the arguments of the run."""
    return ledger(booked, include_unmatched=True, keep=["no_match"]).select(
        F.col("source_entry_id").alias("journal_entry_id"),
        F.lit((run or {}).get("timestamp")).cast("string").alias("transformation_timestamp"),
        F.col("rule_applied").alias("rule_id"), F.col("entry_id").alias("ledger_entry_id"), "account_code",
        "amount", "date", "no_match", *_run_text(run))


def entries(booked: DataFrame) -> DataFrame:
    """Journal rows (line 0) and their lines in one table, ordered by (src_row, line_no)."""
    no = F.col("no")
    own = line(no)
    source = {"entry_id": F.col("entry_id"), "source_entry_id": F.lit(""), "account_code": F.col("old_type"),
              "amount": F.col("amount"), "rule_applied": F.lit(""), "quarter": F.col("quarter"), "year": F.col("year")}
    rows = booked.withColumn("no", F.explode(F.concat(F.array(F.lit(0)), line_numbers(include_unmatched=True))))
    return rows.select(
        "src_row", no.alias("line_no"), F.when(no == 0, "Journal").otherwise("Ledger").alias("entry_type"),
        "date", "description",
        *[F.when(no == 0, mine).otherwise(own[c]).alias(c) for c, mine in source.items()])


def audit_summary(booked: DataFrame) -> DataFrame:
    """One row: transformations, matched, unmatched, lines, distinct rules, gross amount, average."""
    # A split deposit has three lines that sum to twice the amount, like any pair.
    gross = F.abs("amount") * F.when(F.col("splits"), 2).otherwise(n_lines())
    row = booked.agg(
        F.count(F.lit(1)).alias("total_transformations"), F.count_if(~F.col("no_match")).alias("matched_entries"),
        F.count_if("no_match").alias("unmatched_entries"),
        F.coalesce(F.sum(n_lines()), F.lit(0)).cast("bigint").alias("total_ledger_entries"),
        F.coalesce(F.sum(gross), F.lit(0)).cast(TOTAL).alias("total_amount"))
    return row.withColumns({
        "unique_rules_applied": rule_usage(booked).agg(F.count(F.lit(1))).scalar(),
        "average_ledger_entries_per_journal": F.when(
            F.col("total_transformations") > 0,
            F.col("total_ledger_entries") / F.col("total_transformations")).otherwise(0.0)})


def rule_usage(booked: DataFrame) -> DataFrame:
    """Every applied rule with its attributes (first seen) and number of uses."""
    return booked.select("src_row", applied_rules()).filter("r is not null").groupBy("r.rule_id").agg(
        F.min_by(F.struct("r.condition", "r.account_code", "r.description", "r.priority", "r.generates_multiple"),
                 "src_row").alias("a"),
        F.count(F.lit(1)).alias("usage_count"),
    ).select("rule_id", "a.condition", "a.account_code", F.coalesce("a.description", F.lit("")).alias("description"),
             "a.priority", yes_no(F.col("a.generates_multiple")).alias("generates_multiple"), "usage_count")


def one_rule_usage(booked: DataFrame, rule_id: str) -> DataFrame:
    """Uses, lines and gross amount of one rule."""
    used = rows_by_rule(booked, rule_id)
    own = all_lines(used).filter(F.col("rule_applied") == rule_id).agg(
        F.count(F.lit(1)).alias("n_lines"), F.coalesce(F.sum("amount"), F.lit(0)).cast(TOTAL).alias("total_amount"))
    return own.select(F.lit(rule_id).alias("rule_id"), used.agg(F.count(F.lit(1))).scalar().alias("usage_count"),
                      "n_lines", "total_amount")


def metadata(booked: DataFrame, run: dict | None = None) -> DataFrame:
    """Run arguments and summary numbers as one row."""
    return audit_summary(booked).select(*_run(run, *RUN_FIELDS, "start_time", "end_time"), "*")


def audit_set(booked: DataFrame, run: dict | None = None) -> dict[str, DataFrame]:
    """The five audit tables by name."""
    return {"metadata": metadata(booked, run), "transformations": transformations(booked, run),
            "rules": rule_usage(booked), "entries": entries(booked), "relationships": relationships(booked)}
