"""Display order and display columns of the ledger."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip
from .accounts import lookup


def prefix_rank(source_id: Column) -> Column:
    """Wallet rows (A), interest (I), bank (B), then everything else."""
    first = F.upper(F.substring(strip(source_id), 1, 1))
    return F.when(first == "A", 0).when(first == "I", 1).when(first == "B", 2).otherwise(3)


def signed_display(amount: Column, ledger_type: Column) -> Column:
    """Debits positive, everything else negative."""
    return F.when(F.coalesce(F.upper(ledger_type) == "DR", F.lit(False)), amount).otherwise(-amount)


def categorization_order() -> list[Column]:
    return [F.col("year"), F.coalesce(F.col("quarter"), F.quarter("date")), F.col("date"),
            prefix_rank(F.col("source_entry_id")), F.coalesce(F.col("source_entry_id"), F.lit("")),
            F.col("src_row"), F.col("line_no")]


def categorization(ledger: DataFrame, accounts: DataFrame | None = None) -> DataFrame:
    """The detail table: ledger id and level by code then name, signed amount, sort keys kept."""
    if accounts is None:
        found = ledger.withColumns({"ledger_id": F.col("account_code"), "level": F.lit(0)})
    else:
        found = lookup(ledger, accounts).withColumns({
            "ledger_id": F.coalesce("ledger_id", "account_code"),
            "level": F.coalesce("account_level", F.lit(0))})
    return found.select(
        "entry_id", "ledger_id", "account_code", "account_path", "level",
        F.coalesce("ledger_type", F.lit("")).alias("ledger_type"), "description",
        signed_display(F.col("amount"), F.col("ledger_type")).alias("signed_amount"),
        "date", "quarter", "year", "source_entry_id", "rule_applied", "src_row", "line_no")


def hierarchy_view(ledger: DataFrame, accounts: DataFrame | None = None) -> DataFrame:
    """Ledger lines with their level; with a hierarchy, lines outside of it are left out."""
    if accounts is None:
        return ledger.withColumn("level", F.lit(0))
    found = lookup(ledger, accounts).withColumn("level", F.coalesce("account_level", F.lit(0)))
    return found.filter(F.col("level").between(1, 4)).select(*ledger.columns, "level")


def hierarchy_order() -> list[Column]:
    return [F.col(c) for c in ("level", "account_code", "date", "src_row", "line_no")]


SEVERITY_RANK = {"critical": 0, "error": 1, "warning": 2, "info": 3}


def severity_rank(severity: Column) -> Column:
    out = F.lit(4)
    for name, rank in SEVERITY_RANK.items():
        out = F.when(severity == name, rank).otherwise(out)
    return out


def capped(df: DataFrame, order: list, n: int) -> DataFrame:
    """The first n rows of a printed list, each with `n_more`, the number of rows that are not printed."""
    total = df.agg(F.count(F.lit(1))).scalar()
    return df.orderBy(*order).limit(n).withColumn("n_more", F.greatest(total - n, F.lit(0)))
